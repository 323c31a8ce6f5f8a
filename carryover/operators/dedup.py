"""Exact duplicates: one representative per key, the others name it.

The window runs over keys and order columns only, never over bodies, and ranks with
``min_by``-style aggregates, so a group of copies that holds much of the table is
pre-aggregated before the shuffle and never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_key(metadata: list[Column], body: Column) -> Column:
    """64 bytes: digests of the metadata that must agree (nulls apart) and of the folded body."""
    tagged = F.concat_ws("", *(F.when(c.isNull(), "n").otherwise(F.concat(F.lit("v"), F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string"))) for c in metadata)) if metadata else F.lit("")
    return F.concat(F.sha2(tagged, 256), F.sha2(F.coalesce(body, F.lit("")), 256))


def exact_duplicates(df: DataFrame, ident: str, key: str, preference: list[Column] | None = None, eligible: Column | None = None) -> DataFrame:
    """``df`` with (duplicate_of, group_size): the representative of each eligible row, null for itself.

    The representative is the least by ``preference``, then by ``ident``. Rows that
    aren't eligible or have a null key stand for themselves. Rows repeated under one id
    share its answer. New columns that clash with existing ones replace them.
    """
    ok = F.coalesce(eligible, F.lit(False)) if eligible is not None else F.lit(True)
    order = F.struct(*[p.alias(f"p{n}") for n, p in enumerate(preference or [])], F.col(ident).alias("i"))
    base = df.drop("duplicate_of", "group_size").withColumn("_ok", ok & F.col(key).isNotNull())
    best = base.where("_ok").groupBy(key).agg(F.min(order)["i"].alias("_best"), F.count("*").alias("_n")).where("_n > 1")
    joined = base.join(best, key, "left")
    other = F.col("_ok") & F.col("_best").isNotNull() & (F.col("_best") != F.col(ident))
    return joined.withColumns({"duplicate_of": F.when(other, F.col("_best")), "group_size": F.when(F.col("_ok") & F.col("_n").isNotNull(), F.col("_n")).otherwise(1)}).drop("_ok", "_best", "_n")


def resolve_aliases(current: DataFrame, aliases: DataFrame, ident: str, key: str) -> DataFrame:
    """Former duplicates against the present batch: (ident, representative, status).

    ``aliases`` has (ident, representative): what an earlier run recorded. ``still``:
    both are present and their keys still agree; ``changed``: the keys differ now;
    ``absent``: the representative isn't in the batch.
    """
    mine = current.select(F.col(ident), F.col(key).alias("k"))
    rep = current.select(F.col(ident).alias("representative"), F.col(key).alias("rk"))
    joined = aliases.select(ident, "representative").join(mine, ident).join(rep, "representative", "left")
    return joined.select(ident, "representative", F.when(F.col("rk").isNull(), "absent").when(F.col("k") == F.col("rk"), "still").otherwise("changed").alias("status"))
