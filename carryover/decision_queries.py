"""Queries over decisions: histories, target states and verdicts are derived from the digests of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carryover.operators import decide as dec
from carryover.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

_PAST = "struct<canonical_id:string,target_id:string,record_hash:string,content_hash:string,target_hash:string,verified:boolean>"


def planted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """(planned, history, state, verdicts, shared) for three targets: each digit of an id's digest decides one thing.

    Target ``b`` doesn't round-trip record ids; files that records of ``c`` share moved.
    """
    # two digits make records copies of each other, so that some have a former representative
    r = table(spark, d, "canonical_record").select(F.col("canonical_id").alias("id")).distinct().withColumn("ch", F.md5(F.substring(F.md5("id"), 20, 2)))
    rep = r.groupBy("ch").agg(F.min("id").alias("rep"))
    digit = lambda k: F.conv(F.substring(F.md5("id"), k, 1), 16, 10).cast("int")
    r = r.join(rep, "ch").withColumn("target", F.explode(F.array(*map(F.lit, "abc")))).withColumns({f"d{k}": digit(k) for k in range(1, 15)})
    text = lambda *parts: F.md5(F.concat(*(p if not isinstance(p, str) else F.lit(p) if p in ("f", "p") else F.col(p) for p in parts)))
    moved = lambda k, mark: F.when(F.col(f"d{k}") < 8, "").otherwise(mark)
    at = lambda c: F.concat(F.lit("t"), c)
    own = F.when(F.col("d2") < 10, F.struct(F.col("id").alias("canonical_id"), at("id").alias("target_id"), text("id", "ch").alias("record_hash"), F.col("ch").alias("content_hash"), text("f", "id").alias("target_hash"), (F.col("d3") != 0).alias("verified")))
    alias = F.when((F.col("d2") < 13) & (F.col("id") != F.col("rep")), F.struct(F.col("rep").alias("canonical_id"), at("rep").alias("target_id"), text("rep", "ch").alias("record_hash"), F.col("ch").alias("content_hash"), text("f", "rep").alias("target_hash"), (F.col("d3") != 0).alias("verified")))
    home = text("f", "id", moved(5, "h"))
    planned = r.select(
        "target", F.col("id").alias("canonical_id"), at("id").alias("target_id"), text("id", "ch", moved(1, "s")).alias("record_hash"), F.concat("ch", moved(1, "s")).alias("content_hash"),
        F.when(F.col("d7") < 4, home).when(F.col("d7") >= 8, text("p", "id")).alias("projection_hash"), F.col("ch").alias("key"),
        F.when(F.col("d9") == 0, "rejected").when(F.col("d9") == 1, "transformed").otherwise("accepted").alias("status"), F.when(F.col("d9") == 0, "redact_unsupported").alias("code"),
        F.when(F.col("d8") == 0, "rejected").alias("gate_status"), F.when(F.col("d8") == 0, "aws-access-token").alias("gate_code"),
        F.when(F.col("d12") == 0, F.concat(F.lit("c"), "id", "target")).alias("own_cluster"), (F.col("d10") != 0).alias("can_update"), F.lit(True).alias("reads_back"), (F.col("target") != "b").alias("round_trips"),
    )
    history = r.select("target", F.col("id").alias("canonical_id"), own.cast(_PAST).alias("own"), F.when(F.col("d2") >= 10, alias).cast(_PAST).alias("alias"))
    record = F.col("d4") >= 4
    state = r.where("d4 <> 0 AND (d2 < 13 OR d4 < 4)").select(
        "target", at("id").alias("target_id"), F.when(F.col("d4") == 4, "x").when(record, F.col("id")).alias("canonical_id"), F.when(record, text("id", "ch", moved(5, "h"))).alias("record_hash"), home.alias("target_hash"),
        F.when(F.col("d4") == 2, "unmanaged").when(F.col("d4") == 3, "managed_invalid").alias("classification"), F.when(record, F.when(F.col("d6").between(5, 9), "other").otherwise(text("id", "ch"))).alias("envelope_hash"),
        F.when(F.col("d6") < 5, F.array(F.lit("/body"))).otherwise(F.array().cast("array<string>")).alias("home_fields"), F.when(F.col("d14") == 0, "other").otherwise(F.col("ch")).alias("key"),
    )
    sides = F.when(F.col("d11") < 8, F.array(F.lit("source"))).when(F.col("d11") < 12, F.array(F.lit("home"))).otherwise(F.array(F.lit("source"), F.lit("home")))
    conflict = dec.cluster_id(dec.CLUSTER_DOMAIN, F.col("id"), text("id", "ch"), text("id", "ch", moved(1, "s")), home)
    # conflicts of a record with the same states on several targets are one
    verdicts = r.where("d11 >= 4").select(conflict.alias("cluster_id"), F.array("id").alias("canonical_ids"), sides.alias("bases")).distinct().unionByName(
        r.where("d12 = 0").select(F.concat(F.lit("c"), "id", "target").alias("cluster_id"), F.array(F.when(F.col("d13") < 8, F.col("id")).otherwise("other")).alias("canonical_ids"), F.lit(None).cast("array<string>").alias("bases"))
    )
    return planned, history, state, verdicts, spark.createDataFrame([("a", False), ("c", True)], "target string, modified boolean")


def decision_table(spark: SparkSession, d: str) -> DataFrame:
    """Every record on three targets: which rule decides, and how."""
    return dec.decide(*planted(spark, d)).select("target", "canonical_id", "rule", "status", "code", F.when(F.col("rule") != "conflict", F.col("detail")).alias("detail"), "basis")


def conflict_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Both sides of each open conflict."""
    planned, history, state, verdicts, shared = planted(spark, d)
    return dec.clusters(dec.decide(planned, history, state, verdicts, shared), planned, state, history).select("canonical_id", "basis", "content_hash", "record_hash", "cluster_id")


def _n(k: int, h: str = "h") -> str:
    return f"('0x' || substr({h}, {k}, 1))::INT"


_DECIDED = f"""WITH g AS (SELECT DISTINCT canonical_id AS id, md5(substr(md5(canonical_id), 20, 2)) AS ch FROM canonical_record), m AS (SELECT id, ch, md5(id) AS h, min(id) OVER (PARTITION BY ch) AS rep FROM g),
r AS (SELECT id, ch, h, rep, t AS target, CASE WHEN {_n(2)} < 10 THEN 'own' WHEN {_n(2)} < 13 AND id <> rep THEN 'alias' END AS past, {_n(3)} <> 0 AS verified, {_n(1)} >= 8 AS source_moved, {_n(7)} AS proj, {_n(10)} <> 0 AS can_update, {_n(11)} AS verdict FROM m, (VALUES ('a'), ('b'), ('c')) v(t)),
st AS (SELECT id, {_n(4)} AS kind, {_n(5)} >= 8 AS home_moved, {_n(6)} AS fields, CASE WHEN {_n(14)} = 0 THEN 'other' ELSE ch END AS key FROM m WHERE {_n(4)} <> 0 AND ({_n(2)} < 13 OR {_n(4)} < 4)),
j AS (SELECT r.*, coalesce(s.kind, 0) AS kind, s.home_moved, CASE WHEN s.fields < 5 THEN '/body' WHEN s.fields < 10 THEN '{dec.ENVELOPE_FIELD}' ELSE '' END AS edited, s.key AS skey, o.id IS NOT NULL AS own_bytes FROM r LEFT JOIN st s ON s.id = CASE past WHEN 'own' THEN r.id WHEN 'alias' THEN rep END LEFT JOIN st o ON o.id = r.id),
k AS (SELECT *, past = 'own' AS own, past IS NOT NULL AS written FROM j),
c AS (SELECT *, CASE WHEN {_n(8)} = 0 THEN 'gate' WHEN {_n(9)} = 0 THEN 'writer' WHEN written AND NOT verified THEN 'unverified' WHEN written AND kind = 2 THEN 'unmanaged' WHEN written AND kind = 3 THEN 'managed_invalid' WHEN written AND kind = 1 THEN 'unreadable' WHEN written AND kind = 0 THEN 'deleted'
WHEN past = 'alias' AND kind = 4 THEN 'alias_foreign' WHEN own AND NOT source_moved AND NOT home_moved THEN 'unchanged'
WHEN own AND source_moved AND home_moved THEN CASE WHEN proj < 4 THEN 'converged' WHEN proj < 8 THEN 'unprojectable' WHEN verdict BETWEEN 4 AND 7 AND NOT can_update THEN 'verdict_source_fixed' WHEN verdict BETWEEN 4 AND 7 THEN 'verdict_source' WHEN verdict BETWEEN 8 AND 11 AND edited <> '' THEN 'verdict_home' ELSE 'conflict' END
WHEN own AND home_moved THEN CASE WHEN edited <> '' THEN 'home_edited' ELSE 'home_unclear' END WHEN own AND NOT can_update THEN 'source_fixed' WHEN own THEN 'source_changed'
WHEN written AND home_moved THEN 'alias_changed' WHEN written AND NOT can_update THEN 'alias_fixed' WHEN written THEN 'alias' WHEN own_bytes THEN 'untracked' ELSE 'new' END AS rule1 FROM k),
e AS (SELECT *, CASE WHEN rule1 <> 'gate' AND {_n(12)} = 0 AND {_n(13)} >= 8 THEN 'verdict_excluded' ELSE rule1 END AS rule2 FROM c),
f AS (SELECT *, rule2 IN ('unchanged', 'converged', 'verdict_source', 'source_changed', 'alias', 'new') AS stays FROM e), p AS (SELECT *, CASE WHEN stays AND target = 'c' THEN 'shared_modified' ELSE rule2 END AS rule3, stays AND target <> 'c' AS ok FROM f),
q AS (SELECT p.*, x.id IS NOT NULL AS in_batch, coalesce(x.ch, p.skey) = p.ch AS same FROM p LEFT JOIN (SELECT id, target, ch FROM p WHERE ok) x ON x.id = p.rep AND x.target = p.target AND p.past = 'alias'),
u AS (SELECT *, CASE WHEN ok AND past = 'alias' AND same AND NOT in_batch THEN 'alias_duplicate' WHEN ok AND past = 'alias' AND NOT same AND own_bytes THEN 'alias_untracked' ELSE rule3 END AS rule4 FROM q),
w AS (SELECT *, ok AND rule4 = rule3 AS ok2, first_value(id) OVER (PARTITION BY target, ch, ok AND rule4 = rule3 ORDER BY CASE WHEN own AND verified THEN 0 ELSE 1 END, CASE WHEN rule4 IN ('unchanged', 'converged') THEN 0 ELSE 1 END, id) AS lead FROM u),
z AS (SELECT *, CASE WHEN ok2 AND lead <> id THEN 'duplicate' ELSE rule4 END AS rule FROM w)"""

DECISION_SQL = f"""{_DECIDED} SELECT target, id AS canonical_id, rule, CASE WHEN rule IN ('gate', 'writer') THEN 'rejected' WHEN rule IN ('deleted', 'unchanged', 'converged', 'verdict_source_fixed', 'verdict_home', 'home_edited', 'source_fixed', 'alias_fixed', 'verdict_excluded', 'alias_duplicate', 'duplicate') THEN 'omitted'
WHEN rule IN ('verdict_source', 'source_changed', 'alias', 'new') THEN CASE WHEN {_n(9)} = 1 THEN 'transformed' ELSE 'accepted' END ELSE 'unresolved' END AS status,
CASE rule WHEN 'gate' THEN 'aws-access-token' WHEN 'writer' THEN 'redact_unsupported' WHEN 'unmanaged' THEN 'target_unmanaged' WHEN 'deleted' THEN 'deleted_in_target' WHEN 'unchanged' THEN 'already_migrated' WHEN 'converged' THEN 'already_migrated' WHEN 'verdict_home' THEN 'home_modified' WHEN 'home_edited' THEN 'home_modified' WHEN 'conflict' THEN 'conflict'
WHEN 'verdict_source_fixed' THEN 'target_unsupported' WHEN 'source_fixed' THEN 'target_unsupported' WHEN 'alias_fixed' THEN 'target_unsupported' WHEN 'untracked' THEN 'target_untracked' WHEN 'alias_untracked' THEN 'target_untracked' WHEN 'verdict_excluded' THEN 'verdict_excluded' WHEN 'alias_duplicate' THEN 'duplicate_of' WHEN 'duplicate' THEN 'duplicate_of'
WHEN 'new' THEN NULL WHEN 'alias' THEN NULL WHEN 'source_changed' THEN NULL WHEN 'verdict_source' THEN NULL ELSE 'target_modified' END AS code,
CASE WHEN rule IN ('verdict_home', 'home_edited') THEN edited WHEN rule IN ('verdict_source_fixed', 'source_fixed', 'alias_fixed') THEN '/content' WHEN rule = 'verdict_excluded' THEN 'c' || id || target WHEN rule = 'alias_duplicate' THEN rep WHEN rule = 'duplicate' THEN lead END AS detail,
CASE WHEN rule1 IN ('verdict_source', 'verdict_source_fixed') THEN 'observed' WHEN rule1 = 'verdict_home' THEN 'settled' END AS basis FROM z"""

QUERIES |= {f.__name__: f for f in (decision_table, conflict_candidates)}
SQL["decision_table"] = DECISION_SQL
SQL["conflict_candidates"] = f"""{_DECIDED}, x AS (SELECT *, 'sha256:' || sha256('{dec.CLUSTER_DOMAIN}' || id || md5(id || ch) || md5(id || ch || 's') || md5('f' || id || 'h')) AS cluster_id FROM z WHERE rule = 'conflict')
SELECT id AS canonical_id, 'source' AS basis, ch || 's' AS content_hash, md5(id || ch || 's') AS record_hash, cluster_id FROM x UNION ALL SELECT id, 'home', md5('f' || id || 'h'), md5(id || ch || 'h'), cluster_id FROM x"""
