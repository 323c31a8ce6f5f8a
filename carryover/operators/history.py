"""Joins of the present against what earlier runs recorded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_per_chain(df: DataFrame, chain: list[str], order: list[Column], payload: list[str]) -> DataFrame:
    """The newest row of each chain and how many share its order (``ties``).

    One aggregate with a map-side part; a chain of any length is never sorted. Among
    tied rows the greatest payload is given, so the result is the same for any layout.
    """
    rank = F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)])
    body = F.struct(*payload)
    newest = df.groupBy(*chain).agg(F.max(F.struct(rank.alias("r"), body.alias("b"))).alias("m"))
    marked = df.select(*(F.col(c) for c in chain), rank.alias("r"))
    null_safe = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in chain]
    on = null_safe[0]
    for c in null_safe[1:]:
        on = on & c
    counted = marked.groupBy(*chain, "r").agg(F.count("*").alias("ties"))
    on = on & F.col("x.m.r").eqNullSafe(F.col("y.r"))
    return newest.alias("x").join(counted.alias("y"), on).select(*(F.col(f"x.{c}").alias(c) for c in chain), "x.m.b.*", "y.ties")


def carry_forward(previous: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the previous state whose key is gone: they stay on record as ``source_missing``."""
    return previous.join(current.select(*keys).distinct(), keys, "left_anti").withColumn("reason", F.lit("source_missing"))


def merge_latest(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Union in which a row of ``new`` replaces the row of the same key in ``old``."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))


def violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that should be unique and aren't, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def latest_run(df: DataFrame, moment: str, run: str) -> DataFrame:
    """All rows of the newest run; two runs of one moment are told apart by their id."""
    newest = df.agg(F.max(F.struct(moment, run)).alias("m")).select(F.col(f"m.{run}").alias(run)).where(F.col(run).isNotNull())
    return df.join(newest, run, "left_semi")
