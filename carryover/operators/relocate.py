"""Sources that moved: overlap of (record id, content hash) fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fewest matched records, and their least share of the round, to suspect a move.
FLOOR, RATIO = 5, 0.6


def relocation_candidates(current: DataFrame, known: DataFrame, source: str, record: str, digest: str, floor: int = FLOOR, ratio: float = RATIO) -> DataFrame:
    """(source, candidate, matched, total, ratio): known sources whose records turn up under another name.

    Fingerprints are distinct per source before they meet, so repeated rows cost
    nothing; pairs of sources are counted with a map-side part. Null ids or digests match
    nothing.
    """
    prints = lambda df: df.where(F.col(record).isNotNull() & F.col(digest).isNotNull() & F.col(source).isNotNull()).select(F.col(source).alias("s"), F.col(record).alias("r"), F.col(digest).alias("d")).distinct()
    now, before = prints(current), prints(known)
    total = now.groupBy("s").agg(F.count("*").alias("total"))
    met = now.join(before.withColumnRenamed("s", "candidate"), ["r", "d"]).where("s <> candidate").groupBy("s", "candidate").agg(F.count("*").alias("matched"))
    out = met.where(F.col("matched") >= floor).join(total, "s").withColumn("ratio", F.col("matched") / F.col("total"))
    return out.where(F.col("ratio") >= ratio).select(F.col("s").alias(source), "candidate", "matched", "total", "ratio")
