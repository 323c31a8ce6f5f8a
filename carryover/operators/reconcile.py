"""Three-way comparison of records: what was settled, what the source says, what the target holds.

One full outer join on the key and one ordered CASE; which side changed is derived from
hashes, never from bodies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def three_way(prior: DataFrame, source: DataFrame, target: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, prior_hash, source_hash, target_hash, outcome) of each key of any side.

    Each side has one row per key. Outcomes, first that holds: ``unchanged``,
    ``converged`` (both changed alike), ``source_changed``, ``target_changed``,
    ``conflict`` (both changed apart), ``new`` (source only), ``target_untracked``
    (target only), ``both_new`` (alike or apart, without history), ``source_missing``,
    ``deleted_in_target``, ``gone`` (history only). A null digest is a value of its own.
    """
    side = lambda df, name: df.where(F.col(key).isNotNull()).select(F.col(key), F.coalesce(F.col(digest), F.lit("")).alias(name))
    p, s, t = side(prior, "prior_hash"), side(source, "source_hash"), side(target, "target_hash")
    all_ = p.join(s, key, "full").join(t, key, "full")
    has_p, has_s, has_t = (F.col(c).isNotNull() for c in ("prior_hash", "source_hash", "target_hash"))
    same_s, same_t = F.col("source_hash") == F.col("prior_hash"), F.col("target_hash") == F.col("prior_hash")
    outcome = (
        F.when(has_p & has_s & has_t & same_s & same_t, "unchanged")
        .when(has_p & has_s & has_t & (F.col("source_hash") == F.col("target_hash")), "converged")
        .when(has_p & has_s & has_t & same_t, "source_changed")
        .when(has_p & has_s & has_t & same_s, "target_changed")
        .when(has_p & has_s & has_t, "conflict")
        .when(has_s & ~has_p & ~has_t, "new")
        .when(has_t & ~has_p & ~has_s, "target_untracked")
        .when(has_s & has_t, "both_new")
        .when(has_p & has_t, "source_missing")
        .when(has_p & has_s, "deleted_in_target")
        .otherwise("gone")
    )
    return all_.withColumn("outcome", outcome)


def field_differences(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, status, differing): read-back against what was written, field by field.

    ``status`` is ``verified``, ``mismatch``, ``missing`` (not read back) or
    ``unexpected``; ``differing`` lists the fields of a mismatch. Null equals null.
    """
    names = {f: f"f{k}" for k, f in enumerate(fields)}
    a = left.select(F.col(key), F.struct(*(F.col(f).alias(n) for f, n in names.items())).alias("w"))
    b = right.select(F.col(key), F.struct(*(F.col(f).alias(n) for f, n in names.items())).alias("r"))
    both = a.join(b, key, "full")
    differing = F.array_compact(F.array(*(F.when(~F.col(f"w.{n}").eqNullSafe(F.col(f"r.{n}")), F.lit(f)) for f, n in names.items())))
    present = F.col("w").isNotNull() & F.col("r").isNotNull()
    return both.select(
        key,
        F.when(F.col("r").isNull(), "missing").when(F.col("w").isNull(), "unexpected").when(F.size(differing) == 0, "verified").otherwise("mismatch").alias("status"),
        F.when(present, differing).otherwise(F.array().cast("array<string>")).alias("differing"),
    )
