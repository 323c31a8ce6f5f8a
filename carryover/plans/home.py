"""The registry of sources: resolving a path to a source, registering it, finding moves."""

from __future__ import annotations

import base64
import hashlib
import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carryover.functions.canonical_json import canonical, strict_load
from carryover.functions.identity import SATELLITE_PREFIX
from carryover.functions.secrets import check_policy
from carryover.plans.schemas import validate
from carryover.sinks.envelope import INDEX_MARK
from carryover.sinks.files import read_or_none, replace_file, safe_join

log = logging.getLogger(__name__)

REGISTRY = T.StructType([T.StructField("satellite_id", T.StringType(), False), T.StructField("path", T.StringType()), T.StructField("label", T.StringType())])


def derive_satellite_id(path: str, prefix: str = SATELLITE_PREFIX) -> str:
    """The same as the column expression, for one path on the driver."""
    raw = hashlib.sha256(prefix.encode() + b"\0" + path.encode()).digest()[:5]
    return base64.b32encode(raw).decode().lower()


@dataclass(frozen=True)
class Resolved:
    satellite_id: str
    how: str  # explicit, path, derived


def resolve(registry: list[tuple[str, str | None]], path: str, explicit: str | None = None) -> Resolved:
    """Explicit id before a registered path before the derived id; an occupied id is refused."""
    by_id, by_path = dict(registry), {p: i for i, p in registry if p}
    if explicit:
        if by_id.get(explicit) not in (None, path):
            raise ValueError(f"{explicit} belongs to another path")
        return Resolved(explicit, "explicit")
    if path in by_path:
        return Resolved(by_path[path], "path")
    made = derive_satellite_id(path)
    if made in by_id:
        raise ValueError(f"{made} is taken by another path")
    return Resolved(made, "derived")


def register(registry: DataFrame, satellite_id: str, path: str, label: str | None = None) -> DataFrame:
    """The registry with one more source; ids and paths stay unique and aren't blank."""
    if not satellite_id.strip() or not path.strip():
        raise ValueError("an id and a path are needed")
    if registry.where((registry.satellite_id == satellite_id) | (registry.path == path)).limit(1).count():
        raise ValueError("the id or path is registered")
    return registry.unionByName(registry.sparkSession.createDataFrame([(satellite_id, path, label)], REGISTRY))


def empty_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], REGISTRY)


CONTROL = ".control"


def init_home(root: str, action: str = "pass") -> list[str]:
    """Creates what a home lacks and says what it created; what is there stays. The log begins with the first run."""
    check_policy(action, set())
    made = []
    for name, data in (("index.md", f"{INDEX_MARK}\n# Index\n"), (f"{CONTROL}/config.json", canonical({"gate": action, "satellites": []}) + "\n")):
        at = safe_join(root, name)
        if read_or_none(at) is None:
            replace_file(at, data.encode(), None)
            made.append(name)
    return made


def read_config(root: str) -> dict:
    """The home's settings: gate action, allowlist and satellites; raises ValueError where they don't hold."""
    data = read_or_none(safe_join(root, f"{CONTROL}/config.json"))
    config = strict_load((data or b'{"gate":"pass"}').decode())
    validate("settings", config)
    check_policy(config.get("gate", "pass"), set(config.get("allowlist", [])))
    sats = config.get("satellites", [])
    if len({s["satellite_id"] for s in sats}) != len(sats) or len({s["path"] for s in sats if s.get("path")}) != len([s for s in sats if s.get("path")]):
        raise ValueError("satellites aren't unique")
    return config


def write_config(root: str, config: dict) -> None:
    validate("settings", config)
    at = safe_join(root, f"{CONTROL}/config.json")
    replace_file(at, (canonical(config) + "\n").encode(), read_or_none(at))


def file_receipt(entries: DataFrame, root: str, satellite_id: str, run_id: str) -> str:
    """Files the entries of a run; a run is filed once."""
    path = f"{root}/{CONTROL}/receipts/satellite_id={satellite_id}/run={run_id}"
    entries.write.mode("errorifexists").parquet(path)
    return path


def read_receipts(spark: SparkSession, root: str, satellite_id: str | None = None) -> DataFrame:
    """All filed entries, or those of one satellite (read from its folder only)."""
    df = spark.read.option("basePath", f"{root}/{CONTROL}/receipts").parquet(f"{root}/{CONTROL}/receipts")
    return df.where(F.col("satellite_id") == satellite_id) if satellite_id else df


def discovered(candidates: DataFrame, registry: DataFrame) -> DataFrame:
    """(path, records, satellite_id, registered): folders that were found, with what is known of them."""
    known = registry.select("path", "satellite_id")
    return candidates.join(known, "path", "left").withColumn("registered", F.col("satellite_id").isNotNull())


# Exit codes from mild to grave.
SEVERITY = [0, 3, 4, 1]


def worst_exit(codes: list[int]) -> int:
    return max(codes, key=lambda c: SEVERITY.index(c) if c in SEVERITY else len(SEVERITY), default=0)


def sync(satellites: list[tuple[str, str | None]], run_one: Callable[[str, str], int]) -> int:
    """Plans and applies one satellite after the other and goes on after a failure.

    Never in parallel: each run moves the state that the next is compared with.
    """
    codes = []
    for satellite_id, path in satellites:
        if path is None:
            continue
        try:
            codes.append(run_one(satellite_id, path))
        except Exception:
            log.exception("%s failed", satellite_id)
            codes.append(1)
    return worst_exit(codes)
