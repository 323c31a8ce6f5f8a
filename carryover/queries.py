"""Queries over the driver's tables for the core operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carryover import decision_queries, record_queries
from carryover.functions.instants import not_exact_utc, utc_micros
from carryover.operators.drift import canonical_names, consistent_table, fused_schema, schema_changes, table_schema
from carryover.operators.nested import flatten_json, flatten_typed
from carryover.operators.snapshots import snapshot_changes
from carryover.session import table


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """One UTC instant for each value that isn't yet in the canonical form."""
    text = lambda c: c.cast("string")
    memory = table(spark, d, "memory", heavy=True).select(F.lit("memory").alias("src"), text(F.col("row_no")).alias("rec_key"), F.col("created_at").alias("value"), F.col("home_zone").alias("zone"))
    files = (
        table(spark, d, "memories")
        .select("export_no", "home_zone", F.posexplode("memory_files.updated_at").alias("pos", "value"))
        .select(F.lit("memories").alias("src"), F.concat_ws("/", text(F.col("export_no")), text(F.col("pos"))).alias("rec_key"), "value", F.col("home_zone").alias("zone"))
    )
    receipts = table(spark, d, "receipts").select(F.lit("receipts").alias("src"), text(F.col("receipt_no")).alias("rec_key"), F.col("created_at").alias("value"), F.col("site_zone").alias("zone"))
    return (
        memory.unionByName(files)
        .unionByName(receipts)
        .where(F.col("value").isNotNull() & not_exact_utc(F.col("value")))
        .select("src", "rec_key", utc_micros(F.col("value"), F.col("zone")).alias("utc_us"))
        .where("utc_us IS NOT NULL")
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Flat child tables of nested files, documents and JSON extras, with their place."""
    shape = lambda df, name, key: df.select(F.lit(name).alias("child_table"), F.col(key).cast("bigint").alias("parent_key"), F.col("pos").alias("child_pos"), F.col("child_key"))
    files = flatten_typed(table(spark, d, "memories"), "export_no", "memory_files", {"child_key": "path"})
    docs = flatten_typed(table(spark, d, "projects"), "project_no", "docs", {"child_key": "uuid"})
    extra = flatten_json(table(spark, d, "memory", heavy=True), "row_no", "extra").withColumnRenamed("row_pointer", "child_key")
    blank = lambda df: df.withColumn("child_key", F.coalesce("child_key", F.lit("")))
    return shape(blank(files), "memory_files", "export_no").unionByName(shape(blank(docs), "docs", "project_no")).unionByName(shape(extra, "extra", "row_no"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Ids added, removed or changed between consecutive snapshots of ``memory``."""
    body = F.coalesce("content", "text")
    return snapshot_changes(table(spark, d, "memory"), "id", "snapshot_no", [body, F.coalesce("deleted", F.lit(False))], F.struct("received_at", "row_no"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Every change of shape between neighbouring files of a feed."""
    return schema_changes(table(spark, d, "raw_export", heavy=True), "feed_id", "file_no", "payload")


def p6_schema(spark: SparkSession, d: str) -> DataFrame:
    """The fused tagged-union schema of each file family."""
    return fused_schema(table(spark, d, "raw_export"), "file_family", "feed_id", "file_no", "payload")


def _consistent(spark: SparkSession, d: str, family: str) -> DataFrame:
    raw = table(spark, d, "raw_export", heavy=True).where(F.col("file_family") == family)
    # both are bounded by the number of distinct key paths, not by rows
    schema = table_schema(raw, "feed_id", "file_no", "payload")
    renames = [tuple(r) for r in schema_changes(raw, "feed_id", "file_no", "payload").where("change = 'renamed'").select("feed_id", "old_path", "new_path").distinct().orderBy("feed_id", "old_path", "new_path").collect()]
    return consistent_table(raw, {}, schema, ["feed_id", "file_no", "line_no"], "payload", canonical_names(renames))


def p6_memory_table(spark: SparkSession, d: str) -> DataFrame:
    """All ``memory`` export lines in one consistent table."""
    return _consistent(spark, d, "memory")


def p6_memories_table(spark: SparkSession, d: str) -> DataFrame:
    """All ``memories`` export lines in one consistent table."""
    return _consistent(spark, d, "memories")


def queries() -> dict:
    own = (p2_found, p3_found, p5_found, p6_found, p6_schema, p6_memory_table, p6_memories_table)
    return {f.__name__: f for f in own} | record_queries.QUERIES | decision_queries.QUERIES


P3_SQL = """WITH r AS (SELECT id, snapshot_no::BIGINT AS s, max(coalesce(content, text)) AS b, bool_or(coalesce(deleted, false)) AS x FROM memory WHERE id IS NOT NULL GROUP BY 1, 2)
SELECT coalesce(n.id, o.id) AS id, coalesce(n.s, o.s + 1) AS snapshot_no, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM (SELECT * FROM r WHERE s > (SELECT min(s) FROM r)) n FULL JOIN (SELECT * FROM r WHERE s < (SELECT max(s) FROM r)) o ON n.id = o.id AND n.s = o.s + 1
WHERE o.id IS NULL OR n.id IS NULL OR n.b IS DISTINCT FROM o.b OR n.x <> o.x"""

P2_SQL = """WITH RECURSIVE e AS (SELECT row_no, '' AS p, extra::JSON AS v FROM memory WHERE extra IS NOT NULL AND json_valid(extra)
UNION ALL SELECT row_no, p || '/' || replace(replace(k, '~', '~0'), '/', '~1'), v FROM (SELECT row_no, p, unnest(CASE json_type(v) WHEN 'ARRAY' THEN list_transform(range(json_array_length(v)::BIGINT), lambda i: i::VARCHAR) ELSE json_keys(v) END) AS k,
unnest(CASE json_type(v) WHEN 'ARRAY' THEN json_extract(v, '$[*]') ELSE json_extract(v, '$.*') END) AS v FROM e WHERE json_type(v) IN ('ARRAY', 'OBJECT'))),
a AS (SELECT row_no, p, unnest(range(json_array_length(v)::BIGINT)) AS i FROM e WHERE json_type(v) = 'ARRAY')
SELECT 'extra' AS child_table, row_no AS parent_key, i AS child_pos, p || '/' || i AS child_key FROM a
UNION ALL SELECT 'memory_files', export_no, i, coalesce(memory_files[i + 1].path, '') FROM (SELECT export_no, memory_files, unnest(range(len(memory_files))) AS i FROM memories)
UNION ALL SELECT 'docs', project_no, i, coalesce(docs[i + 1].uuid, '') FROM (SELECT project_no, docs, unnest(range(len(docs))) AS i FROM projects)"""

P5_SQL = r"""WITH v AS (SELECT 'memory' AS src, row_no::VARCHAR AS rec_key, created_at AS v, home_zone AS z FROM memory UNION ALL SELECT 'receipts', receipt_no::VARCHAR, created_at, site_zone FROM receipts
UNION ALL SELECT 'memories', export_no || '/' || i, memory_files[i + 1].updated_at, home_zone FROM (SELECT *, unnest(range(len(memory_files))) AS i FROM memories)),
w AS (SELECT src, rec_key, z, regexp_replace(v, '^[\s\x{a0}\x{202f}]+|[\s\x{a0}\x{202f}]+$', '', 'g') AS s FROM v WHERE NOT regexp_full_match(v, '\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z')),
e AS (SELECT src, rec_key, z, s, CASE
WHEN regexp_matches(s, '^\d{4}-?\d{2}-?\d{2}(?:[Tt]|\s+)\d{2}:?\d{2}') THEN regexp_extract(s, '^(\d{4})-?(\d{2})-?(\d{2})(?:[Tt]|\s+)(\d{2}):?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?\s*(.*)$', ['y', 'm', 'd', 'h', 'i', 's', 'f', 'r'])
WHEN regexp_matches(s, '^[A-Z][a-z]{2}, \d') THEN regexp_extract(s, '^[A-Z][a-z]{2}, (\d{1,2}) ([A-Z][a-z]{2}) (\d{4}) (\d{2}):(\d{2}):(\d{2})()\s*(.*)$', ['d', 'm', 'y', 'h', 'i', 's', 'f', 'r'])
WHEN regexp_matches(s, '^\d{1,2}\.\d{1,2}\.\d{4}\s+\d') THEN regexp_extract(s, '^(\d{1,2})\.(\d{1,2})\.(\d{4})\s+(\d{1,2}):(\d{2})(?::(\d{2}))?()\s*(.*)$', ['d', 'm', 'y', 'h', 'i', 's', 'f', 'r'])
WHEN regexp_matches(s, '^(1[3-9]|[23]\d)/\d') THEN regexp_extract(s, '^(\d{1,2})/(\d{1,2})/(\d{4}),?\s+(\d{1,2}):(\d{2})(?::(\d{2}))?()[\s\x{202f}\x{a0}]*(.*)$', ['d', 'm', 'y', 'h', 'i', 's', 'f', 'r'])
WHEN regexp_matches(s, '^\d{1,2}/(1[3-9]|[23]\d)/') THEN regexp_extract(s, '^(\d{1,2})/(\d{1,2})/(\d{4}),?\s+(\d{1,2}):(\d{2})(?::(\d{2}))?()[\s\x{202f}\x{a0}]*(.*)$', ['m', 'd', 'y', 'h', 'i', 's', 'f', 'r'])
WHEN regexp_matches(s, '^[A-Z][a-z]{2} \d{1,2}, \d{4} ') THEN regexp_extract(s, '^([A-Z][a-z]{2}) (\d{1,2}), (\d{4}) (\d{1,2}):(\d{2})(?::(\d{2}))?()[\s\x{202f}\x{a0}]*(.*)$', ['m', 'd', 'y', 'h', 'i', 's', 'f', 'r'])
WHEN regexp_matches(s, ' Uhr$') THEN regexp_extract(s, '^(\d{1,2})\. (\pL+) (\d{4}), (\d{1,2}):(\d{2})(?::(\d{2}))?()( Uhr)$', ['d', 'm', 'y', 'h', 'i', 's', 'f', 'r'])
WHEN regexp_matches(s, '^\d{4}年') THEN regexp_extract(s, '^(\d{4})年(\d{1,2})月(\d{1,2})日\s*(\d{1,2}):(\d{2})(?::(\d{2}))?()(.*)$', ['y', 'm', 'd', 'h', 'i', 's', 'f', 'r']) END AS c,
CASE WHEN regexp_full_match(s, '\d{9,20}(\.\d+)?') THEN s END AS n FROM w),
f AS (SELECT *, try_cast(c.y AS INT) AS y, coalesce(try_cast(c.m AS INT), nullif(list_position(['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'], lower(c.m)), 0),
list_position(['januar', 'februar', 'märz', 'april', 'mai', 'juni', 'juli', 'august', 'september', 'oktober', 'november', 'dezember'], lower(c.m))) AS m, try_cast(c.d AS INT) AS d,
CASE WHEN regexp_matches(c.r, '^[AaPp][Mm]$') THEN CASE WHEN try_cast(c.h AS INT) BETWEEN 1 AND 12 THEN try_cast(c.h AS INT) % 12 + CASE WHEN lower(c.r) = 'pm' THEN 12 ELSE 0 END END ELSE try_cast(c.h AS INT) END AS h,
try_cast(c.i AS INT) AS i, coalesce(try_cast(c.s AS INT), 0) AS sec, coalesce(try_cast(rpad(substr(c.f, 1, 6), 6, '0') AS INT), 0) AS us, CASE WHEN regexp_matches(c.r, '^[AaPp][Mm]$|^ Uhr$') THEN '' ELSE c.r END AS r FROM e),
g AS (SELECT *, CASE WHEN y >= 1 AND m BETWEEN 1 AND 12 AND h BETWEEN 0 AND 23 AND i < 60 AND sec < 60 THEN try_cast(format('{:04d}-{:02d}-{:02d} {:02d}:{:02d}:{:02d}', y, m, d, h, i, sec) AS TIMESTAMP) END AS t,
regexp_extract(r, '^([+−-])(\d{2}):?(\d{2})(?:\[.*\])?$', ['g', 'h', 'm']) AS o, CASE WHEN regexp_full_match(r, '[A-Z][A-Za-z_]+/[A-Za-z_/]+') THEN r WHEN r = '' THEN z END AS zone FROM f),
k AS (SELECT *, CASE WHEN r IN ('Z', 'z', 'UTC', 'GMT') THEN 0 WHEN o.h <> '' THEN (try_cast(o.h AS INT) * 60 + try_cast(o.m AS INT)) * CASE WHEN o.g = '+' THEN 1 ELSE -1 END
WHEN (z, r) IN (('Europe/Berlin', 'CET'), ('Europe/Paris', 'CET'), ('Europe/London', 'BST')) THEN 60 WHEN (z, r) IN (('Europe/Berlin', 'CEST'), ('Europe/Paris', 'CEST')) THEN 120
WHEN (z, r) IN (('America/New_York', 'EST'), ('America/Chicago', 'CDT')) THEN -300 WHEN (z, r) = ('America/New_York', 'EDT') THEN -240 WHEN (z, r) = ('America/Chicago', 'CST') THEN -360
WHEN (z, r) = ('America/Los_Angeles', 'PST') THEN -480 WHEN (z, r) = ('America/Los_Angeles', 'PDT') THEN -420 WHEN (z, r) = ('Asia/Tokyo', 'JST') THEN 540 WHEN (z, r) = ('Asia/Shanghai', 'CST') THEN 480
WHEN (z, r) = ('Asia/Kolkata', 'IST') THEN 330 WHEN (z, r) = ('Australia/Sydney', 'AEST') THEN 600 WHEN (z, r) = ('Australia/Sydney', 'AEDT') THEN 660 END AS minutes, t AT TIME ZONE zone AS late FROM g),
q AS (SELECT src, rec_key, CASE WHEN n IS NOT NULL THEN CASE WHEN length(split_part(n, '.', 1)) <= 11 THEN try_cast(split_part(n, '.', 1) AS HUGEINT) * 1000000 + coalesce(try_cast(rpad(substr(split_part(n, '.', 2), 1, 6), 6, '0') AS INT), 0) WHEN length(n) <= 14 THEN try_cast(n AS HUGEINT) * 1000 WHEN length(n) <= 17 THEN try_cast(n AS HUGEINT) ELSE try_cast(n AS HUGEINT) // 1000 END
WHEN minutes IS NOT NULL THEN epoch_us(t) + us - minutes * 60000000::BIGINT WHEN (late - INTERVAL 1 HOUR) AT TIME ZONE zone = t THEN epoch_us(late - INTERVAL 1 HOUR) + us WHEN late AT TIME ZONE zone = t THEN epoch_us(late) + us END AS utc_us FROM k)
SELECT src, rec_key, utc_us::BIGINT AS utc_us FROM q WHERE utc_us IS NOT NULL"""

_NODES_SQL = """WITH RECURSIVE r AS MATERIALIZED (SELECT row_number() OVER () AS rn, feed_id, file_no::BIGINT AS file_no, payload::JSON AS v FROM raw_export WHERE CASE WHEN json_valid(payload) THEN json_type(payload) = 'OBJECT' ELSE false END),
e AS (SELECT rn, feed_id, file_no, '' AS p, '' AS o, true AS keyed, v FROM r UNION ALL
SELECT rn, feed_id, file_no, CASE WHEN arr THEN p || '[]' WHEN p = '' THEN k ELSE p || '.' || k END, o || printf('%05d', i), NOT arr, x FROM (SELECT rn, feed_id, file_no, p, o, json_type(v) = 'ARRAY' AS arr,
unnest(CASE json_type(v) WHEN 'ARRAY' THEN list_transform(range(json_array_length(v)::BIGINT), lambda q: '') ELSE json_keys(v) END) AS k, unnest(CASE json_type(v) WHEN 'ARRAY' THEN json_extract(v, '$[*]') ELSE json_extract(v, '$.*') END) AS x,
unnest(range(CASE json_type(v) WHEN 'ARRAY' THEN json_array_length(v)::BIGINT ELSE len(json_keys(v)) END)) AS i FROM e WHERE json_type(v) IN ('ARRAY', 'OBJECT'))),
n AS MATERIALIZED (SELECT rn, feed_id, file_no, p, o, v::VARCHAR AS v, CASE json_type(v) WHEN 'VARCHAR' THEN 's' WHEN 'BOOLEAN' THEN 'b' WHEN 'OBJECT' THEN 'o' WHEN 'ARRAY' THEN 'a' ELSE 'n' END AS t FROM e WHERE keyed AND p <> '' AND json_type(v) <> 'NULL')"""

P6_SQL = _NODES_SQL + """,
paths AS MATERIALIZED (SELECT feed_id, file_no, p, string_agg(DISTINCT t, '' ORDER BY t) AS ts FROM n GROUP BY ALL),
files AS (SELECT feed_id, file_no, lag(file_no) OVER (PARTITION BY feed_id ORDER BY file_no) AS before FROM (SELECT DISTINCT feed_id, file_no::BIGINT AS file_no FROM raw_export)),
d AS MATERIALIZED (SELECT f.feed_id, f.file_no, f.before, p, max(CASE WHEN x.file_no = f.before THEN ts END) AS o, max(CASE WHEN x.file_no = f.file_no THEN ts END) AS w FROM files f JOIN paths x ON f.feed_id = x.feed_id AND x.file_no IN (f.file_no, f.before) WHERE f.before IS NOT NULL GROUP BY ALL HAVING o IS DISTINCT FROM w),
rec AS MATERIALIZED (SELECT DISTINCT n.feed_id, n.file_no, coalesce(json_extract_string(r.v, '$.account_uuid'), json_extract_string(r.v, '$.id')) AS k, p, val FROM (SELECT rn, feed_id, file_no, p, string_agg(v, chr(1) ORDER BY o) AS val FROM n GROUP BY ALL) n JOIN r USING (rn) WHERE coalesce(json_extract_string(r.v, '$.account_uuid'), json_extract_string(r.v, '$.id')) IS NOT NULL),
held AS (SELECT d.feed_id, d.file_no, d.p AS op, a.k, a.val FROM d JOIN rec a ON a.feed_id = d.feed_id AND a.file_no = d.before AND a.p = d.p WHERE d.w IS NULL AND EXISTS (SELECT 1 FROM rec b WHERE b.feed_id = d.feed_id AND b.file_no = d.file_no AND b.k = a.k)),
total AS (SELECT feed_id, file_no, op, count(DISTINCT k) AS total FROM held GROUP BY ALL),
m AS (SELECT h.feed_id, h.file_no, h.op, d.p AS np, count(DISTINCT h.k) AS hits FROM held h JOIN d ON d.feed_id = h.feed_id AND d.file_no = h.file_no AND d.o IS NULL JOIN rec b ON b.feed_id = h.feed_id AND b.file_no = h.file_no AND b.k = h.k AND b.p = d.p AND b.val = h.val GROUP BY ALL),
best AS (SELECT * FROM m JOIN total USING (feed_id, file_no, op) WHERE 2 * hits > total QUALIFY row_number() OVER (PARTITION BY feed_id, file_no, op ORDER BY hits DESC, np) = 1),
ren AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY feed_id, file_no, np ORDER BY hits DESC, op) = 1)
SELECT feed_id, file_no, 'renamed' AS change, op AS old_path, np AS new_path FROM ren
UNION ALL SELECT feed_id, file_no, CASE WHEN o IS NULL THEN 'added' WHEN w IS NULL THEN 'removed' ELSE 'type_changed' END, CASE WHEN o IS NULL THEN '' ELSE p END, CASE WHEN w IS NULL THEN '' ELSE p END FROM d
WHERE NOT EXISTS (SELECT 1 FROM ren WHERE ren.feed_id = d.feed_id AND ren.file_no = d.file_no AND d.p IN (op, np))"""

P6_SCHEMA_SQL = _NODES_SQL + """,
f AS (SELECT DISTINCT feed_id, file_family AS family FROM raw_export)
SELECT family, path, array_to_string(list_filter(['string', 'number', 'boolean', 'object', 'array'], lambda x: list_contains(ts, x[1])), ',') AS types, files, first_file, last_file
FROM (SELECT family, p AS path, list(DISTINCT t) AS ts, count(DISTINCT (n.feed_id, n.file_no)) AS files, min(n.file_no) AS first_file, max(n.file_no) AS last_file FROM n JOIN f ON n.feed_id = f.feed_id GROUP BY ALL)"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_SQL, "p3_found": P3_SQL, "p5_found": P5_SQL, "p6_found": P6_SQL, "p6_schema": P6_SCHEMA_SQL} | record_queries.SQL | decision_queries.SQL
