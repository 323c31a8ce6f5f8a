"""The gate: what may leave for a target, by what the whole record holds and what its owner allows.

One scan over the record as JSON finds secrets in values and keys of every field; one
ordered expression turns findings, consent and deletion into a disposition.

Defined results: a record without consent counts as exportable; a null deletion intent
and tombstone as none; the first rule in the order of fields, then of rules, is named.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carryover.canonical import record_json
from carryover.functions.identity import content_hash
from carryover.functions.secrets import holds_secret, json_findings

REFERENCE_TEXT = "[Secret reference: value not exported]"


def refuse_identities(df: DataFrame, columns: list[str]) -> None:
    """Raises ValueError if an identity holds a secret, since masking would change it; never says which text."""
    held = [F.when(holds_secret(F.col(c)), F.lit(c)) for c in columns if c in df.columns]
    bad = df.select(F.coalesce(*held).alias("c")).where("c IS NOT NULL").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['c']} holds a secret")


def gated(records: DataFrame, action: str = "pass", allowlist: frozenset[str] = frozenset()) -> DataFrame:
    """``records`` with sensitive_findings, gate_status and gate_code (null: passed).

    Precedence: a reference to a secret is omitted and its text replaced; then the first
    blocked finding, a forbidden export, a disabled memory, a wish to delete.
    """
    has = lambda *path: records.select(".".join(path)).columns if path[0] in records.columns else []
    no = F.lit(False)
    consent = lambda name: F.coalesce(~F.col(f"consent.{name}"), no) if has("consent") and name in records.schema["consent"].dataType.names else no
    gone = [F.col(c).isNotNull() for c in ("deletion_intent", "tombstone") if c in records.columns]
    reference = F.coalesce(F.col("source_kind") == "secretRef", no)
    found = records.withColumn("sensitive_findings", json_findings(record_json(records), action, allowlist))
    rule = F.get(F.filter("sensitive_findings", lambda x: x["disposition"] == "blocked"), F.lit(0))["rule_id"]
    deleted = gone[0] | gone[1] if len(gone) == 2 else gone[0] if gone else no
    found = found.withColumn("_rule", rule)
    cases = [
        (reference, "omitted", F.lit("secret_reference_unsupported")),
        (F.col("_rule").isNotNull(), "rejected", F.col("_rule")),
        (consent("exportable"), "rejected", F.lit("consent_export_disabled")),
        (consent("memory_enabled"), "unresolved", F.lit("memory_disabled")),
        (deleted, "unresolved", F.lit("deletion_needs_decision")),
    ]
    status, code = F.when(cases[0][0], cases[0][1]), F.when(cases[0][0], cases[0][2])
    for condition, s, c in cases[1:]:
        status, code = status.when(condition, s), code.when(condition, c)
    text = F.when(reference, REFERENCE_TEXT).otherwise(F.col("content"))
    return found.withColumns({"gate_status": status, "gate_code": code, "content": text, "content_hash": F.when(reference, content_hash(F.lit(REFERENCE_TEXT))).otherwise(F.col("content_hash"))}).drop("_rule")


def summary(gated_records: DataFrame, by: list[str]) -> DataFrame:
    """``by`` and (total, findings, blocked, allowlisted)."""
    count = lambda how: F.sum(F.size(F.filter("sensitive_findings", lambda x: x["disposition"] == how))).alias(how)
    return gated_records.groupBy(*by).agg(F.count("*").alias("total"), F.sum(F.size("sensitive_findings")).alias("findings"), count("blocked"), count("allowlisted"))
