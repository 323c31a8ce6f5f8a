"""What becomes of each planned record: one ordered decision over joined history, target state and verdicts.

Every rule is a condition over one joined row; the first that holds decides. Joins are by
key (record and target, target id, conflict cluster), so nothing is compared with
everything, and a hot target is spread by the record's own key.

Inputs (one row per key, extra columns are ignored):

* ``planned``: target, canonical_id, target_id, record_hash, content_hash, projection_hash
  (of the bytes the writer would leave, null where it can't say), key (duplicates agree in
  it), status and code of the writer, gate_status and gate_code (null: passed),
  own_cluster, and the writer's can_update, reads_back, round_trips.
* ``history``: target, canonical_id, and the records as they were written last: own and
  alias, each STRUCT<canonical_id, target_id, record_hash, content_hash, target_hash,
  verified> or null.
* ``state``: target, target_id, canonical_id, record_hash, target_hash (null: no bytes),
  classification (``unmanaged``, ``managed_invalid`` or null), envelope_hash, home_fields, key.
* ``verdicts``: cluster_id, canonical_ids, bases (``source`` and ``home``) that a person kept.
* ``shared``: target, modified - whether files that records share moved since they were written.

Defined results: a record without history or state is new; null hashes equal null;
verdicts that keep both sides decide nothing; a target that ``shared`` doesn't list is
unmodified.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carryover.functions.identity import cluster_id
from carryover.operators.dedup import exact_duplicates

CLUSTER_DOMAIN = "carryover:conflict:v1"
#: What a home file's own block is called where that block itself was edited.
ENVELOPE_FIELD = "/frontmatter/record"

# Fixed values: (rule, status, code) of each outcome, in the order in which rules are tried.
RULES = [
    ("gate", None, None),
    ("writer", None, None),
    ("unverified", "unresolved", "target_modified"),
    ("unmanaged", "unresolved", "target_unmanaged"),
    ("managed_invalid", "unresolved", "target_modified"),
    ("unreadable", "unresolved", "target_modified"),
    ("deleted", "omitted", "deleted_in_target"),
    ("alias_foreign", "unresolved", "target_modified"),
    ("unchanged", "omitted", "already_migrated"),
    ("converged", "omitted", "already_migrated"),
    ("unprojectable", "unresolved", "target_modified"),
    ("verdict_source_fixed", "omitted", "target_unsupported"),
    ("verdict_source", None, None),
    ("verdict_home", "omitted", "home_modified"),
    ("conflict", "unresolved", "conflict"),
    ("home_edited", "omitted", "home_modified"),
    ("home_unclear", "unresolved", "target_modified"),
    ("source_fixed", "omitted", "target_unsupported"),
    ("source_changed", None, None),
    ("alias_changed", "unresolved", "target_modified"),
    ("alias_fixed", "omitted", "target_unsupported"),
    ("alias", None, None),
    ("untracked", "unresolved", "target_untracked"),
    ("new", None, None),
]


def decide(planned: DataFrame, history: DataFrame, state: DataFrame, verdicts: DataFrame, shared: DataFrame) -> DataFrame:
    """(target, canonical_id, rule, status, code, detail, basis, cluster_id) of each planned record.

    ``basis`` says what a later run has to start from: ``observed`` (the home state that an
    approved write replaces) or ``settled`` (both sides as they are), else null.
    """
    j = _joined(planned, history, state)
    own, written = F.col("own").isNotNull(), F.col("prior").isNotNull()
    present = F.col("s.canonical_id").isNotNull()
    source_moved = F.when(F.col("round_trips"), ~F.col("record_hash").eqNullSafe(F.col("prior.record_hash"))).otherwise(~F.col("content_hash").eqNullSafe(F.col("prior.content_hash")))
    home_moved = ~F.col("s.record_hash").eqNullSafe(F.col("prior.record_hash")) | ~F.col("s.target_hash").eqNullSafe(F.col("prior.target_hash"))
    edited = F.when(F.size("s.home_fields") > 0, F.col("s.home_fields")).when(F.col("s.envelope_hash") != F.col("prior.record_hash"), F.array(F.lit(ENVELOPE_FIELD))).otherwise(F.array().cast("array<string>"))
    j = j.withColumns({"source_moved": source_moved, "home_moved": home_moved, "edited": edited, "cluster_id": cluster_id(CLUSTER_DOMAIN, F.col("canonical_id"), F.col("prior.record_hash"), F.col("record_hash"), F.col("s.target_hash"))})
    j = _with_verdicts(j, verdicts)
    keeps = lambda side: F.coalesce(F.array_contains("kept", side), F.lit(False))
    both = own & F.col("source_moved") & F.col("home_moved")
    only_source, only_home = keeps("source") & ~keeps("home"), keeps("home") & ~keeps("source")
    attributed = F.size("edited") > 0
    conditions = {
        "gate": F.col("gate_status").isNotNull(),
        "writer": ~F.col("status").isin("accepted", "transformed"),
        "unverified": written & ~(F.col("prior.verified") & F.col("reads_back")),
        "unmanaged": written & ~present & F.col("s.classification").eqNullSafe("unmanaged"),
        "managed_invalid": written & ~present & F.col("s.classification").eqNullSafe("managed_invalid"),
        "unreadable": written & ~present & F.col("s.target_hash").isNotNull(),
        "deleted": written & ~present,
        "alias_foreign": written & ~own & (F.col("s.canonical_id") != F.col("prior.canonical_id")),
        "unchanged": own & ~F.col("source_moved") & ~F.col("home_moved"),
        "converged": both & (F.col("projection_hash") == F.col("s.target_hash")),
        "unprojectable": both & F.col("projection_hash").isNull(),
        "verdict_source_fixed": both & only_source & ~F.col("can_update"),
        "verdict_source": both & only_source,
        "verdict_home": both & only_home & attributed,
        "conflict": both,
        "home_edited": own & F.col("home_moved") & attributed,
        "home_unclear": own & F.col("home_moved"),
        "source_fixed": own & ~F.col("can_update"),
        "source_changed": own,
        "alias_changed": written & F.col("home_moved"),
        "alias_fixed": written & ~F.col("can_update"),
        "alias": written,
        "untracked": F.col("own_bytes").isNotNull(),
    }
    rule: Column | None = None
    for name, condition in conditions.items():
        held = F.coalesce(condition, F.lit(False))
        rule = F.when(held, name) if rule is None else rule.when(held, name)
    j = j.withColumn("rule", rule.otherwise("new"))
    fixed = lambda k: F.coalesce(*(F.when(F.col("rule") == r[0], r[k]) for r in RULES if r[k]))
    j = j.withColumns({
        "w_status": F.when(F.col("rule") == "gate", F.col("gate_status")).otherwise(F.coalesce(fixed(1), F.col("status"))),
        "w_code": F.when(F.col("rule") == "gate", F.col("gate_code")).otherwise(F.coalesce(fixed(2), F.when(F.col("rule") == "writer", F.col("code")))),
        "detail": F.when(F.col("rule").isin("verdict_home", "home_edited"), F.array_join("edited", ",")).when(F.col("rule") == "conflict", F.col("cluster_id")).when(F.col("rule").endswith("_fixed"), F.lit("/content")),
        "basis": F.when(F.col("rule").isin("verdict_source", "verdict_source_fixed"), "observed").when(F.col("rule") == "verdict_home", "settled"),
    })
    return _deduplicated(_overridden(j, shared), state)


def _joined(planned: DataFrame, history: DataFrame, state: DataFrame) -> DataFrame:
    """``planned`` with own, alias, prior (own, else alias), s (state where prior wrote) and own_bytes."""
    past = history.select("target", "canonical_id", "own", "alias")
    j = planned.join(past, ["target", "canonical_id"], "left").withColumn("prior", F.coalesce("own", "alias"))
    at = state.select(F.col("target").alias("_t"), F.col("target_id").alias("_i"), F.struct("canonical_id", "record_hash", "target_hash", "classification", "envelope_hash", "home_fields", "key").alias("s"))
    j = j.join(at, (F.col("target") == F.col("_t")) & (F.col("prior.target_id") == F.col("_i")), "left").drop("_t", "_i")
    bytes_at = state.where("target_hash IS NOT NULL").select("target", "target_id", F.col("target_hash").alias("own_bytes"))
    return j.join(bytes_at, ["target", "target_id"], "left")


def _with_verdicts(j: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Adds kept (sides that the verdict on this conflict keeps) and excluded (by one on the record's own cluster)."""
    kept = verdicts.select("cluster_id", F.col("bases").alias("kept"))
    others = verdicts.select(F.col("cluster_id").alias("own_cluster"), F.col("canonical_ids").alias("_chosen"))
    j = j.join(kept, "cluster_id", "left").join(others, "own_cluster", "left")
    return j.withColumn("excluded", F.coalesce(~F.array_contains("_chosen", F.col("canonical_id")), F.lit(False))).drop("_chosen")


def _overridden(j: DataFrame, shared: DataFrame) -> DataFrame:
    """Verdicts on whole clusters, then files that records share, go over what was decided."""
    j = j.join(shared.select("target", F.col("modified").alias("_modified")), "target", "left")
    out = F.col("excluded") & (F.col("rule") != "gate")
    j = j.withColumns({
        "rule": F.when(out, "verdict_excluded").otherwise(F.col("rule")), "w_status": F.when(out, "omitted").otherwise(F.col("w_status")),
        "w_code": F.when(out, "verdict_excluded").otherwise(F.col("w_code")), "detail": F.when(out, F.col("own_cluster")).otherwise(F.col("detail")),
    })
    moved = F.coalesce(F.col("_modified"), F.lit(False)) & eligible(F.col("w_status"), F.col("w_code"))
    return j.withColumns({
        "rule": F.when(moved, "shared_modified").otherwise(F.col("rule")), "w_status": F.when(moved, "unresolved").otherwise(F.col("w_status")),
        "w_code": F.when(moved, "target_modified").otherwise(F.col("w_code")), "detail": F.when(~moved, F.col("detail")),
    }).drop("_modified")


def eligible(status: Column, code: Column) -> Column:
    """Whether a decision leaves the record in the target, so that duplicates may refer to it."""
    return status.isin("accepted", "transformed") | F.coalesce(code == "already_migrated", F.lit(False))


def _deduplicated(j: DataFrame, state: DataFrame) -> DataFrame:
    """Former duplicates against the batch or the target, then one representative for each key."""
    ok = eligible(F.col("w_status"), F.col("w_code"))
    # a former duplicate: its representative may be in the batch, else what the target holds counts
    rep = j.where(ok).select(F.col("target").alias("_t"), F.col("canonical_id").alias("_r"), F.col("key").alias("_batch_key"))
    refers = ok & F.col("own").isNull() & F.col("alias").isNotNull()
    j = j.join(rep, (F.col("target") == F.col("_t")) & (F.col("alias.canonical_id") == F.col("_r")), "left").drop("_t")
    same = F.coalesce(F.col("_batch_key"), F.col("s.key")).eqNullSafe(F.col("key"))
    still, apart = refers & same & F.col("_r").isNull(), refers & ~same & F.col("own_bytes").isNotNull()
    j = j.withColumns({
        "rule": F.when(still, "alias_duplicate").when(apart, "alias_untracked").otherwise(F.col("rule")), "detail": F.when(still, F.col("alias.canonical_id")).otherwise(F.col("detail")),
        "w_code": F.when(still, "duplicate_of").when(apart, "target_untracked").otherwise(F.col("w_code")), "w_status": F.when(still, "omitted").when(apart, "unresolved").otherwise(F.col("w_status")),
    })
    j = j.withColumn("_key", F.concat_ws("\0", "target", "key"))
    first = [~F.coalesce(F.col("own.verified"), F.lit(False)), ~F.coalesce(F.col("w_code") == "already_migrated", F.lit(False))]
    j = exact_duplicates(j, "canonical_id", "_key", first, eligible(F.col("w_status"), F.col("w_code")))
    twice = F.col("duplicate_of").isNotNull()
    return j.select(
        "target", "canonical_id", F.when(twice, "duplicate").otherwise(F.col("rule")).alias("rule"), F.when(twice, "omitted").otherwise(F.col("w_status")).alias("status"),
        F.when(twice, "duplicate_of").otherwise(F.col("w_code")).alias("code"), F.when(twice, F.col("duplicate_of")).otherwise(F.col("detail")).alias("detail"), "basis", "cluster_id",
    )


def clusters(decided: DataFrame, planned: DataFrame, state: DataFrame, history: DataFrame) -> DataFrame:
    """(cluster_id, canonical_id, basis, content_hash, record_hash): both candidates of each conflict."""
    open_ = decided.where("rule = 'conflict'").select("target", "canonical_id", "cluster_id")
    source = open_.join(planned, ["target", "canonical_id"]).select("cluster_id", "canonical_id", F.lit("source").alias("basis"), "content_hash", "record_hash")
    where = history.select("target", "canonical_id", F.col("own.target_id").alias("target_id"))
    held = state.select("target", "target_id", F.col("target_hash").alias("content_hash"), "record_hash")
    return source.unionByName(open_.join(where, ["target", "canonical_id"]).join(held, ["target", "target_id"]).select("cluster_id", "canonical_id", F.lit("home").alias("basis"), "content_hash", "record_hash"))
