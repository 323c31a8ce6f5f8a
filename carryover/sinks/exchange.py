"""Records as rows of a JSON exchange format, merged by id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carryover.functions.identity import content_hash, owner_hash
from carryover.functions.text import exchange_kind


def projection(df: DataFrame) -> DataFrame:
    """``df`` with (kind, owner, address, observed, hash_holds)."""
    return df.withColumns(
        {
            "kind": exchange_kind(F.col("source_kind")),
            "owner": owner_hash(F.col("source.system"), F.col("scope_qualifier")),
            "address": F.concat("scope", F.lit("/"), F.coalesce("scope_qualifier", F.lit("-"))),
            "observed": F.coalesce("updated_at", "created_at"),
            "hash_holds": F.col("content_hash") == content_hash(F.col("content")),
        }
    )


def merge_by_id(old: DataFrame, new: DataFrame, ident: str) -> DataFrame:
    """All rows of both; a row of ``new`` replaces the one of its id, rows of others stay."""
    from carryover.operators.history import merge_latest

    return merge_latest(old, new, [ident])


def contradictions(rows: DataFrame, ident: str) -> DataFrame:
    """(ident, field): projected fields that don't follow from the record they came with."""
    fields = ["kind", "owner", "address", "observed"]
    given = rows.select("*", *(F.col(f).alias(f"_{f}") for f in fields))
    again = projection(given.drop(*fields))
    bad = F.array_compact(F.array(*(F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f)) for f in fields)))
    return again.select(ident, F.explode(bad).alias("field"))


def write_rows(df: DataFrame, path: str) -> None:
    """One JSON object a line, in files of even size; a rerun replaces the whole folder."""
    df.write.mode("overwrite").json(path)
