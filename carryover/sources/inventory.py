"""Files of a folder or a ZIP archive as a DataFrame of paths and bytes."""

from __future__ import annotations

import os
import re
import stat
import zipfile
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "path string, length bigint, content binary"


def refuse_special(root: str) -> None:
    """Raises ValueError for links, special files and names that aren't UTF-8; any read error aborts."""

    def fail(e: OSError) -> None:
        raise e

    for at, folders, files in os.walk(root, onerror=fail):
        for name in folders + files:
            full = os.path.join(at, name)
            name.encode("utf-8")
            mode = os.lstat(full).st_mode
            if not (stat.S_ISDIR(mode) or stat.S_ISREG(mode)):
                raise ValueError(f"{full} is a link or special file")


def scan_folder(spark: SparkSession, root: str, control: str = ".control", check: bool = True) -> DataFrame:
    """(path, length, content) of all files under ``root`` outside the control folder, paths relative."""
    if check and os.path.isdir(root):
        refuse_special(root)
    prefix = re.escape(root.rstrip("/")) + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    relative = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*(?=/)", ""), f"^{prefix}", "")
    return files.select(relative.alias("path"), "length", "content").where(~F.col("path").startswith(f"{control}/"))


def check_names(names: list[str], modes: list[int] | None = None) -> list[str]:
    """The names without ``.`` segments; raises ValueError if any of the archive is unsafe."""
    out = []
    for k, name in enumerate(names):
        parts = [p for p in name.split("/") if p not in ("", ".")]
        if not parts or name.startswith("/") or ".." in parts or "\\" in name or "\0" in name or re.match(r"[A-Za-z]:", name):
            raise ValueError(f"unsafe name {name!r}")
        if modes and stat.S_ISLNK(modes[k]):
            raise ValueError(f"{name!r} is a link")
        out.append("/".join(parts))
    if twice := [n for n, c in Counter(out).items() if c > 1]:
        raise ValueError(f"names occur twice: {twice[:3]}")
    return out


def scan_zip(spark: SparkSession, archive: str, partitions: int | None = None) -> DataFrame:
    """(path, length, content) of the members; all names are checked before any byte is read.

    The driver reads the directory only. Members are spread over tasks, each of which
    opens the archive; CRC errors and unknown compression fail the job.
    """
    with zipfile.ZipFile(archive) as z:
        infos = z.infolist()
    names = check_names([i.filename for i in infos], [i.external_attr >> 16 for i in infos])
    members = [(i.filename, n) for i, n in zip(infos, names, strict=True) if not i.is_dir()]
    rows = spark.createDataFrame(members, "member string, path string").repartition(partitions or max(1, min(len(members), spark.sparkContext.defaultParallelism * 4)))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with zipfile.ZipFile(archive) as z:
            for pdf in parts:
                for member, path in zip(pdf["member"], pdf["path"], strict=True):
                    data = z.read(member)
                    yield pd.DataFrame({"path": [path], "length": [len(data)], "content": [data]})

    return rows.mapInPandas(run, FILES)


def manifest(files: DataFrame) -> DataFrame:
    """(path, sha256, bytes, status) of an inventory before any reader claims a file."""
    return files.select("path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("sha256"), F.col("length").alias("bytes"), F.lit("unclaimed").alias("status"))
