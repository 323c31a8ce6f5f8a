"""What changed between consecutive full snapshots of a table.

Keys are spread over hash ranges that are the leaves of a tree. The digest of a leaf
combines 128 bits of row digests by exclusive or, so order and file layout don't matter;
that of an inner node combines its children's. Consecutive snapshots are compared from the root down, only below nodes
that differ, and rows are looked at only in leaves that differ. The number of leaves
follows the number of keys, every level is a DataFrame, and rows travel as a key and a
SHA-256 of the compared columns, never as bodies. All parts start from one exchange of
rows by key, which the planner reuses.

Defined results: rows with a null key or snapshot belong to no key and are left out;
a key delivered twice in a snapshot counts once, as it was received last (ties: the
highest digest, so the result doesn't depend on order); the snapshot before is the
latest existing one; an empty table and a single snapshot have no changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAN_BITS = 6
#: Snapshots whose numbers go to all tasks; more are joined by shuffle.
MOST_BROADCAST = 100_000


def tree_bits(keys: int, keys_per_leaf: int = 4) -> int:
    """Bits of the leaf number, a multiple of FAN_BITS, for about ``keys_per_leaf``."""
    bits = FAN_BITS
    while (keys >> bits) > keys_per_leaf and bits < 48:
        bits += FAN_BITS
    return bits


def keyed_rows(df: DataFrame, key: str, snapshot: str, compared: list[Column], received: Column, bits: int) -> DataFrame:
    """(snapshot, key, leaf, digest): one row per key and snapshot."""
    tagged = F.concat_ws("", *(F.when(c.isNull(), "n").otherwise(F.concat(F.lit("v"), F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in compared))
    rows = df.where(F.col(key).isNotNull() & F.col(snapshot).isNotNull()).select(F.col(snapshot).cast("bigint").alias("snapshot"), F.col(key).alias("key"), received.alias("received"), F.unhex(F.sha2(tagged, 256)).alias("digest"))
    last = rows.groupBy("snapshot", "key").agg(F.max(F.struct("received", "digest"))["digest"].alias("digest"))
    return last.withColumn("leaf", F.shiftrightunsigned(F.xxhash64("key"), 64 - bits))


def merkle_levels(rows: DataFrame, bits: int) -> list[DataFrame]:
    """[(snapshot, node, d1, d2)] from the root's children down to the leaves.

    A level follows from the one below.
    """
    hashed = rows.select("snapshot", "leaf", F.xxhash64("key", "digest").alias("h1"), F.xxhash64(F.lit(7), "digest", "key").alias("h2"))
    level = hashed.groupBy("snapshot", F.col("leaf").alias("node")).agg(F.bit_xor("h1").alias("d1"), F.bit_xor("h2").alias("d2"), F.count("*").alias("n"))
    levels = [level]
    for _ in range(bits // FAN_BITS - 1):
        level = level.groupBy("snapshot", F.shiftrightunsigned("node", FAN_BITS).alias("node")).agg(F.bit_xor("d1").alias("d1"), F.bit_xor("d2").alias("d2"), F.sum("n").alias("n"))
        levels.append(level)
    return levels[::-1]


def _pairs(df: DataFrame, order: DataFrame) -> DataFrame:
    """Each row twice: on the new side of its snapshot, on the old side of the next."""
    sides = F.array(F.struct(F.col("snapshot").alias("pair"), F.lit(True).alias("new")), F.struct(F.col("following").alias("pair"), F.lit(False).alias("new")))
    return df.join(order, "snapshot").withColumn("_side", F.explode(sides)).where("_side.pair IS NOT NULL AND (_side.pair > first_snapshot)").select("*", "_side.pair", "_side.new").drop("_side", "following", "first_snapshot", "snapshot")


def snapshot_changes(df: DataFrame, key: str, snapshot: str, compared: list[Column], received: Column, keys_per_leaf: int = 4) -> DataFrame:
    """(key, snapshot_no, change): ``added``, ``removed`` or ``changed`` against the snapshot before.

    Starts one small job that counts rows per snapshot, to size the tree and to know
    which snapshots exist; the list of snapshots is the only thing the driver sees.
    """
    counts = df.where(F.col(snapshot).isNotNull()).groupBy(F.col(snapshot).cast("bigint").alias("s")).count()
    biggest, several = counts.agg(F.coalesce(F.max("count"), F.lit(0)), F.count("*")).first()
    bits = tree_bits(biggest, keys_per_leaf)
    order = counts.select(F.col("s").alias("snapshot")).withColumn("following", F.lead("snapshot").over(Window.orderBy("snapshot"))).withColumn("first_snapshot", F.min("snapshot").over(Window.orderBy("snapshot")))
    order = F.broadcast(order) if several <= MOST_BROADCAST else order
    rows = keyed_rows(df, key, snapshot, compared, received, bits)
    differing = None
    for level in merkle_levels(rows, bits):
        sides = _pairs(level, order)
        if differing is not None:
            sides = sides.withColumn("parent", F.shiftrightunsigned("node", FAN_BITS)).join(differing.select("pair", F.col("node").alias("parent")), ["pair", "parent"], "left_semi")
        old, new = (F.when(F.col("new") == side, F.struct("d1", "d2", "n")) for side in (False, True))
        differing = sides.groupBy("pair", "node").agg(F.max(old).alias("o"), F.max(new).alias("w")).where(~F.col("o").eqNullSafe(F.col("w"))).select("pair", "node")
    touched = _pairs(rows, order).join(differing.withColumnRenamed("node", "leaf"), ["pair", "leaf"], "left_semi")
    old, new = (F.max(F.when(F.col("new") == side, F.col("digest"))) for side in (False, True))
    return (
        touched.groupBy("pair", "key")
        .agg(old.alias("o"), new.alias("w"))
        .where(~F.col("o").eqNullSafe(F.col("w")))
        .select(F.col("key").alias(key), F.col("pair").alias("snapshot_no"), F.when(F.col("o").isNull(), "added").when(F.col("w").isNull(), "removed").otherwise("changed").alias("change"))
    )
