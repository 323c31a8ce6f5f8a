"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, heavy: bool = False) -> DataFrame:
    """A table of the folder; ``heavy`` says that much work per row follows, see ``spread``."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if heavy else df


def spread(df: DataFrame) -> DataFrame:
    """A scan over too few row groups to occupy half of the cores, spread over all of them.

    Only for a plain scan, whose number of splits is known without running anything. A
    table of many splits, as any large one, is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


_SHIPPED: set[str] = set()


def _own_folder(name: str) -> str:
    """A temporary folder of the driver that goes with the process."""
    path = tempfile.mkdtemp(prefix=f"carryover-{name}-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def ship_code(spark: SparkSession) -> None:
    """Gives the executors this package, once per application, so that UDFs import it there."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(_own_folder("code"), "carryover_code.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for at, folders, files in os.walk(package):
            folders[:] = [f for f in folders if f != "__pycache__"]
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(at, name)
                    z.write(full, os.path.join("carryover", os.path.relpath(full, package)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    A cluster names it in ``spark.checkpoint.dir``; a machine-local folder is
    used only when the session has none and runs in a single JVM (tests).
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if named:
        sc.setCheckpointDir(named)
        return named
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = _own_folder("checkpoints")
    sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint (survives the loss of executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
