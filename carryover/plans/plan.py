"""Plan, apply, receipt: nothing is written before a digest-bound plan is accepted.

A plan is a DataFrame of entries (one per record and target) and a digest of what it was
made from. ``apply`` makes the plan again, compares the digest, writes through a sink,
reads the target back, and files a receipt; entries of earlier receipts whose source is
gone are carried forward.

The digest is exact for any number of entries and needs no order: each entry is hashed,
entries are summed per hash range by the executors, and the driver hashes the 4096 sums.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carryover.functions.canonical_json import digest
from carryover.functions.secrets import holds_secret
from carryover.operators.history import carry_forward, merge_latest, violations
from carryover.operators.reconcile import field_differences, three_way

RANGES = 4096


class StaleBasis(RuntimeError):
    """What a plan was made from isn't what is there now."""

    exit_code = 4


class Incomplete(RuntimeError):
    """Some records were rejected, unresolved or read back otherwise."""

    exit_code = 3


@dataclass
class Plan:
    entries: DataFrame
    digest: str
    target: str


def frame_digest(df: DataFrame, columns: list[str]) -> str:
    """Digest of the rows as a multiset, whatever their order and layout."""
    tagged = F.concat_ws("", *(F.when(F.col(c).isNull(), "n").otherwise(F.concat(F.lit("v"), F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string"))) for c in columns))
    h = df.select(F.sha2(tagged, 256).alias("h"))
    piece = lambda k: F.conv(F.substring("h", 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")
    parts = h.groupBy(F.conv(F.substring("h", 1, 3), 16, 10).cast("int").alias("range")).agg(F.count("*").alias("n"), *(F.sum(piece(k)).alias(f"s{k}") for k in range(5)))
    rows = sorted([r[0], *(str(x) for x in r[1:])] for r in parts.collect())
    return digest([columns, rows])


def make_plan(records: DataFrame, prior: DataFrame, target_state: DataFrame, target: str) -> Plan:
    """(canonical_id, prior_hash, source_hash, target_hash, disposition, reason) of each record.

    ``records``, ``prior`` and ``target_state`` have (canonical_id, content_hash).
    Ids that hold a secret abort, since masking would change them.
    """
    for name, df in (("records", records), ("prior", prior), ("target", target_state)):
        if bad := violations(df.select("canonical_id"), ["canonical_id"]).limit(1).collect():
            raise ValueError(f"{name}: {bad[0][0]} occurs {bad[0][1]} times")
    if records.where(holds_secret(F.col("canonical_id"))).limit(1).count():
        raise ValueError("an identity holds a secret")
    state = three_way(prior, records, target_state, "canonical_id", "content_hash")
    write = F.col("outcome").isin("new", "source_changed")
    skip = F.col("outcome").isin("unchanged", "converged", "source_missing", "deleted_in_target", "gone")
    entries = state.withColumns({"disposition": F.when(write, "accepted").when(skip, "omitted").otherwise("unresolved"), "reason": F.when(~write, F.col("outcome"))}).drop("outcome")
    return Plan(entries, frame_digest(entries, entries.columns), target)


def summary(plan: Plan) -> DataFrame:
    """(disposition, reason, n)."""
    return plan.entries.groupBy("disposition", "reason").agg(F.count("*").alias("n"))


def exit_code(plan: Plan) -> int:
    """3 while any record is unresolved or rejected, else 0."""
    return 3 if plan.entries.where("disposition IN ('unresolved', 'rejected')").limit(1).count() else 0


@contextmanager
def phase(name: str, started: list[bool]):  # noqa: ANN201
    """Says in which phase an error came, and whether anything may have been written."""
    try:
        yield
    except (StaleBasis, Incomplete):
        raise
    except Exception as e:
        raise RuntimeError(f"{name} failed; {'the target may be partly written' if started[0] else 'nothing was written'}: {e}") from e


def apply_plan(accepted_digest: str, again: Callable[[], Plan], records: DataFrame, write: Callable[[DataFrame], DataFrame], read_back: Callable[[], DataFrame], receipts: DataFrame | None, run_id: str, fields: list[str]) -> DataFrame:
    """Receipt entries (run_id, canonical_id, disposition, verification, differing).

    ``again`` makes the plan from what is there now; a digest other than the accepted
    one raises StaleBasis. ``write`` takes the accepted records and returns a frame
    that is materialised once; ``read_back`` reads the target afresh.
    """
    started = [False]
    with phase("planning", started):
        plan = again()
        if plan.digest != accepted_digest:
            raise StaleBasis("the plan isn't what was accepted")
        chosen = records.join(plan.entries.where("disposition = 'accepted'").select("canonical_id"), "canonical_id", "left_semi")
    with phase("writing", started):
        started[0] = True
        write(chosen).write.format("noop").mode("overwrite").save()
    with phase("reading back", started):
        seen = read_back()
        seen = seen.join(chosen.select("canonical_id"), "canonical_id", "left_semi")
        checked = field_differences(chosen, seen, "canonical_id", fields)
        entries = plan.entries.join(checked, "canonical_id", "left").select(F.lit(run_id).alias("run_id"), "canonical_id", "disposition", "reason", F.col("status").alias("verification"), F.array_join("differing", ",").alias("differing"))
        if receipts is None:
            return entries
        # what its source no longer has stays on record, as omitted and not verified by this run
        missing = carry_forward(receipts.select("canonical_id"), entries, ["canonical_id"])
        none = F.lit(None).cast("string")
        return entries.unionByName(missing.select(F.lit(run_id).alias("run_id"), "canonical_id", F.lit("omitted").alias("disposition"), "reason", none.alias("verification"), none.alias("differing")))


def merge_verdicts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Decisions by conflict, new ones in place of old."""
    return merge_latest(old, new, ["cluster_id"])
