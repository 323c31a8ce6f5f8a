"""Queries for record identity, parsing, gating, history and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carryover.functions import identity as ident
from carryover.functions import secrets
from carryover.functions import text as txt
from carryover.operators import gate
from carryover.operators.coverage import json_leaves, unreported
from carryover.operators.dedup import duplicate_key, exact_duplicates, resolve_aliases
from carryover.operators.history import carry_forward, latest_per_chain, merge_latest, violations
from carryover.operators.reconcile import field_differences, three_way
from carryover.operators.relocate import relocation_candidates
from carryover.session import table
from carryover.sources import exports

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Fixed value for the SQL side: the White_Space class in its notation.
_WS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _fold_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '{_WS}+', ' ', 'g'), '^ | $', '', 'g')"


def _b32_sql(digest: str, hex_chars: int) -> str:
    v = f"('0x' || substr({digest}, 1 + 5 * i, 5))::BIGINT"
    letters = " || ".join(f"substr('abcdefghijklmnopqrstuvwxyz234567', (1 + (({v} >> {s}) & 31))::BIGINT, 1)" for s in (15, 10, 5, 0))
    return f"array_to_string(list_transform(range({hex_chars // 5}), lambda i: {letters}), '')"


def _nth(k: int) -> str:
    """SQL for the number of the newest delivery but ``k``."""
    return f"(SELECT DISTINCT snapshot_no FROM memory WHERE snapshot_no IS NOT NULL ORDER BY 1 DESC LIMIT 1 OFFSET {k})"


def _deliveries(spark: SparkSession, d: str) -> list[int]:
    """The numbers of the three newest deliveries, newest first; what isn't there is -1."""
    m = table(spark, d, "memory").where("snapshot_no IS NOT NULL")
    found = [r[0] for r in m.select("snapshot_no").distinct().orderBy(F.desc("snapshot_no")).limit(3).collect()]
    return [*found, -1, -1, -1][:3]


@query("SELECT doc_id, 'sha256:' || sha256(text) AS content_hash FROM documents")
def content_hash_docs(spark: SparkSession, d: str) -> DataFrame:
    """Content hash of every document."""
    return table(spark, d, "documents").select("doc_id", ident.content_hash(F.col("text")).alias("content_hash"))


@query(f"""SELECT canonical_id AS given_id, {_b32_sql("h", 40)} AS record_id, regexp_full_match(canonical_id, '[a-z2-7]{{32}}') AS well_formed
FROM (SELECT canonical_id, sha256(source.system || chr(0) || coalesce(source.satellite_id, '') || chr(0) || source_record_id) AS h FROM canonical_record)""")
def canonical_ids(spark: SparkSession, d: str) -> DataFrame:
    """Source-derived identity of every record, and whether the id it came with is well formed."""
    r = table(spark, d, "canonical_record")
    return r.select(F.col("canonical_id").alias("given_id"), ident.canonical_id(F.col("source.system"), F.col("source.satellite_id"), F.col("source_record_id")).alias("record_id"), ident.valid_record_id(F.col("canonical_id")).alias("well_formed"))


@query(f"""SELECT receipt_no, {_b32_sql("h", 10)} AS derived_id, coalesce(regexp_full_match(satellite_id, '[a-z2-7]{{8}}'), false) AS well_formed
FROM (SELECT receipt_no, satellite_id, sha256('{ident.SATELLITE_PREFIX}' || chr(0) || coalesce(location, '')) AS h FROM receipts)""")
def satellite_ids(spark: SparkSession, d: str) -> DataFrame:
    """Satellite id that each location would get."""
    r = table(spark, d, "receipts")
    return r.select("receipt_no", ident.satellite_id(F.col("location")).alias("derived_id"), ident.valid_satellite_id(F.col("satellite_id")).alias("well_formed"))


@query("""SELECT source.system AS system, source_locator AS path, 'sha256:' || sha256(content) AS sha256, octet_length(encode(content)) AS bytes, count(*) AS copies
FROM canonical_record WHERE source_locator NOT LIKE '.control/%' GROUP BY ALL""")
def inventory_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Path, digest and size of every source item outside the control folder."""
    r = table(spark, d, "canonical_record").where(~F.col("source_locator").startswith(".control/"))
    return r.groupBy(F.col("source.system").alias("system"), F.col("source_locator").alias("path"), ident.content_hash(F.col("content")).alias("sha256"), F.octet_length("content").cast("bigint").alias("bytes")).agg(F.count("*").alias("copies"))


@query(f"""WITH t AS (SELECT doc_id, text, list_filter(str_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\t-\\r \\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]'))[1] AS l FROM documents),
u AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(l, '\\A{_WS}+|{_WS}+\\z', '', 'g'), '\\A#+', ''), '\\A{_WS}+', ''), '{_WS}+\\z', '') AS f FROM t)
SELECT doc_id, 'sha256:' || sha256({_fold_sql("text")}) AS folded_hash, coalesce(CASE WHEN f <> '' THEN substring(f, 1, 80) END, 'Memory ' || doc_id) AS title,
coalesce(nullif(trim(lower(regexp_replace(f, '[^A-Za-z0-9]+', '-', 'g')), '-'), ''), 'note-' || substring(doc_id::VARCHAR, 1, 12)) AS slug FROM u""")
def fold_title_slug(spark: SparkSession, d: str) -> DataFrame:
    """Folded hash, title and slug of every document."""
    docs = table(spark, d, "documents")
    ident_text = F.col("doc_id").cast("string")
    heading = txt.title(F.col("text"), F.lit(""), 1_000_000)
    return docs.select("doc_id", ident.content_hash(txt.fold_whitespace(F.col("text"))).alias("folded_hash"), txt.title(F.col("text"), ident_text).alias("title"), txt.slug(F.when(heading != "Memory ", heading), ident_text).alias("slug"))


@query("""SELECT coalesce(kind, type) AS source_kind, CASE WHEN coalesce(kind, type) IN ('profile', 'preference', 'instruction') THEN 'dna' ELSE 'standard' END AS dna_class,
coalesce(coalesce(kind, type) NOT IN ('profile', 'preference', 'instruction', 'project', 'tool'), true) AS inferred,
CASE coalesce(kind, type) WHEN 'profile' THEN 'identity' WHEN 'identity' THEN 'identity' WHEN 'instruction' THEN 'procedural' WHEN 'procedural' THEN 'procedural' WHEN 'episodic' THEN 'episodic' WHEN 'working' THEN 'working' ELSE 'semantic' END AS exchange_kind,
count(*) AS n FROM memory GROUP BY ALL""")
def classify_kind(spark: SparkSession, d: str) -> DataFrame:
    """Classes of the kinds found in memories."""
    k = F.coalesce("kind", "type")
    return table(spark, d, "memory").groupBy(k.alias("source_kind"), txt.dna_class(k).alias("dna_class"), txt.kind_is_inferred(k).alias("inferred"), txt.exchange_kind(k).alias("exchange_kind")).agg(F.count("*").alias("n"))


@query("""SELECT row_no, coalesce(id, 'sha256:' || sha256(coalesce(content, text))) AS source_record_id, 'sha256:' || sha256(coalesce(content, text)) AS content_hash, enabled IS DISTINCT FROM false AS memory_enabled,
CASE WHEN content IS NULL AND text IS NULL THEN 'missing_memory_content' WHEN content <> text THEN 'conflicting_memory_content' END AS anomaly FROM memory WHERE deleted IS DISTINCT FROM true""")
def saved_memories(spark: SparkSession, d: str) -> DataFrame:
    """Saved memories as records; deleted ones are left out, odd ones are told about."""
    return exports.saved_memories(table(spark, d, "memory")).select("row_no", "source_record_id", "content_hash", "memory_enabled", "anomaly")


@query("SELECT snapshot_no, count(*) AS registered, count(*) FILTER (WHERE deleted) AS deleted, count(*) FILTER (WHERE content IS NULL AND text IS NULL) AS without_content FROM memory GROUP BY 1")
def reader_counters(spark: SparkSession, d: str) -> DataFrame:
    """What a reader counts per delivery."""
    count_if = lambda c, n: F.count_if(c).alias(n)
    return table(spark, d, "memory").groupBy("snapshot_no").agg(F.count("*").alias("registered"), count_if(F.col("deleted"), "deleted"), count_if(F.col("content").isNull() & F.col("text").isNull(), "without_content"))


@query("""WITH m AS (SELECT export_no, account_uuid, memory_files IS NOT NULL AS has_files, conversations_memory, project_memories, unnest(range(len(memory_files))) AS pos, memory_files FROM memories),
f AS (SELECT export_no, coalesce(account_uuid, 'unknown_account') || ':' || coalesce(memory_files[pos + 1].path, '#' || pos) AS source_record_id, 'memory_file' AS part, pos::BIGINT AS pos, 'sha256:' || sha256(memory_files[pos + 1].content) AS content_hash, CASE WHEN memory_files[pos + 1].path IS NULL OR memory_files[pos + 1].content IS NULL THEN 'invalid_memory_file' END AS anomaly FROM m)
SELECT * FROM f
UNION ALL SELECT export_no, coalesce(account_uuid, 'unknown_account') || ':conversations', 'conversations', 0, 'sha256:' || sha256(conversations_memory), NULL FROM memories WHERE memory_files IS NULL AND conversations_memory IS NOT NULL
UNION ALL SELECT export_no, coalesce(account_uuid, 'unknown_account') || ':conversations', 'conversations', 0, 'sha256:' || sha256(conversations_memory), 'legacy_memory_fields_not_reimported' FROM memories WHERE memory_files IS NOT NULL AND conversations_memory IS NOT NULL
UNION ALL SELECT export_no, coalesce(account_uuid, 'unknown_account') || ':project:' || e.key, 'project', 0, 'sha256:' || sha256(e.value), CASE WHEN e.has_files THEN 'legacy_memory_fields_not_reimported' WHEN e.value IS NULL THEN 'invalid_project_memory' END FROM (SELECT export_no, account_uuid, memory_files IS NOT NULL AS has_files, unnest(map_entries(project_memories)).key AS key, unnest(map_entries(project_memories)).value AS value FROM memories) e""")
def account_memories(spark: SparkSession, d: str) -> DataFrame:
    """Files and older memory fields of account exports as records."""
    return exports.account_memories(table(spark, d, "memories"))


@query("""WITH p AS (SELECT project_no, uuid, docs, unnest(range(len(docs))) AS pos FROM projects)
SELECT project_no, coalesce(docs[pos + 1].uuid, coalesce(uuid, '') || '/' || coalesce(docs[pos + 1].filename, '')) AS source_record_id, 'document' AS part, pos::BIGINT AS pos, 'standard' AS dna_class, 'sha256:' || sha256(docs[pos + 1].content) AS content_hash, CASE WHEN docs[pos + 1].content IS NULL THEN 'missing_project_content' END AS anomaly FROM p
UNION ALL SELECT project_no, coalesce(uuid, '') || '#instructions', 'instructions', 0, 'dna', 'sha256:' || sha256(prompt_template), NULL FROM projects WHERE regexp_matches(prompt_template, '\\S')""")
def project_records(spark: SparkSession, d: str) -> DataFrame:
    """Project documents and instructions as records."""
    return exports.project_records(table(spark, d, "projects"))


@query("""WITH f AS (SELECT export_no, unnest(range(len(memory_files)))::BIGINT AS pos, memory_files FROM memories), g AS (SELECT export_no, pos, memory_files[pos + 1].content AS c FROM f),
h AS (SELECT *, regexp_matches(c, '\\A---\\r?\\n') AS opened, regexp_matches(c, '(?s)\\A---\\r?\\n(?:(.*?)\\r?\\n)??---(?:\\r?\\n(.*))?\\z') AS closed FROM g)
SELECT export_no, pos, CASE WHEN closed THEN regexp_extract(c, '(?s)\\A---\\r?\\n(?:(.*?)\\r?\\n)??---(?:\\r?\\n(.*))?\\z', 1) END AS front,
'sha256:' || sha256(CASE WHEN closed THEN regexp_extract(c, '(?s)\\A---\\r?\\n(?:(.*?)\\r?\\n)??---(?:\\r?\\n(.*))?\\z', 2) ELSE c END) AS body_hash, opened AND NOT closed AS unclosed FROM h WHERE c IS NOT NULL""")
def front_matter_split(spark: SparkSession, d: str) -> DataFrame:
    """Front matter and body of every memory file."""
    files = table(spark, d, "memories").select("export_no", F.posexplode("memory_files.content").alias("pos", "c")).where("c IS NOT NULL")
    parts = txt.front_matter(F.col("c"))
    return files.select("export_no", F.col("pos").cast("bigint").alias("pos"), parts.alias("p")).select("export_no", "pos", "p.front", ident.content_hash(F.col("p.body")).alias("body_hash"), "p.unclosed")


_PROMPT = r"^\[([^\]]+)\]\s+\[([^\]]+)\]\s+(.+)$"
_BREAKS = r"[\n\r\x{85}\x{2028}\x{2029}]"


@query(f"""WITH l AS (SELECT row_no, '[' || coalesce(created_at, '') || '] [' || coalesce(kind, 'none') || '] ' || regexp_replace(coalesce(content, text), '{_BREAKS}', ' ', 'g') AS line FROM memory WHERE coalesce(content, text) IS NOT NULL),
p AS (SELECT row_no, trim(regexp_extract(line, '{_PROMPT}', 1)) AS day, trim(regexp_extract(line, '{_PROMPT}', 2)) AS kind, trim(regexp_extract(line, '{_PROMPT}', 3)) AS body, regexp_matches(line, '{_PROMPT}') AS ok FROM l),
k AS (SELECT *, sha256(day || chr(0) || kind || chr(0) || {_fold_sql("body")}) AS identity FROM p)
SELECT row_no, CASE WHEN NOT ok THEN 'invalid_prompt_line' WHEN row_number() OVER (PARTITION BY CASE WHEN ok THEN identity ELSE row_no::VARCHAR END ORDER BY row_no) > 1 THEN 'duplicate_prompt_line' WHEN day <> 'unknown' AND NOT (regexp_matches(day, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') AND try_cast(day AS DATE) IS NOT NULL) THEN 'invalid_prompt_date' END AS anomaly, CASE WHEN ok THEN kind END AS kind FROM k""")
def prompt_lines(spark: SparkSession, d: str) -> DataFrame:
    """Memories written as prompt lines and read back: the first of equal lines wins."""
    m = table(spark, d, "memory", heavy=True)
    body = F.regexp_replace(F.coalesce("content", "text"), _BREAKS, " ")
    lines = m.select("row_no", F.concat(F.lit("["), F.coalesce("created_at", F.lit("")), F.lit("] ["), F.coalesce("kind", F.lit("none")), F.lit("] "), body).alias("line")).where("line IS NOT NULL")
    return exports.prompt_lines(lines, "row_no", "line").select("row_no", "anomaly", "kind")


@query("""SELECT doc_id, 'password-assignment' AS rule_id, octet_length(encode(text)) + 10 AS start_byte, octet_length(encode(text)) + 42 AS end_byte, 'blocked' AS disposition FROM documents WHERE text IS NOT NULL""")
def gate_findings(spark: SparkSession, d: str) -> DataFrame:
    """Secrets found after a password line is added to every document, with byte spans."""
    docs = _with_password(table(spark, d, "documents", heavy=True))
    found = docs.select("doc_id", F.explode(secrets.findings(F.col("text"), "/content", "block")).alias("f"))
    return found.select("doc_id", "f.rule_id", F.col("f.start").alias("start_byte"), F.col("f.end").alias("end_byte"), "f.disposition")


@query("SELECT doc_id, 'sha256:' || sha256(text || chr(10) || 'password=[secret]') AS masked_hash FROM documents WHERE text IS NOT NULL")
def mask_text(spark: SparkSession, d: str) -> DataFrame:
    """The same documents with secrets masked."""
    return _with_password(table(spark, d, "documents", heavy=True)).select("doc_id", ident.content_hash(secrets.masked(F.col("text"))).alias("masked_hash"))


def _with_password(docs: DataFrame) -> DataFrame:
    return docs.where("text IS NOT NULL").select("doc_id", F.concat("text", F.lit("\npassword="), F.md5("text")).alias("text"))


# One made-up token for each rule, in their order; the last two overlap.
_TOKENS = [
    "sk-" + "a1B2c3D4e5F6g7H8i9J0" + "T3BlbkFJ" + "k1L2m3N4o5P6q7R8s9T0", "sk-ant-api03-" + "x" * 93 + "AA", "AKIA" + "ABCDEFGHIJKLMNOP", "ghp_" + "z" * 36, "github_pat_" + "w" * 82,
    "-----BEGIN PRIVATE KEY-----" + "M" * 70 + "-----END PRIVATE KEY-----", "password=" + "correcthorse", "password=ghp_" + "y" * 36,
]


def _digit(k: int) -> str:
    return f"('0x' || substr(md5(canonical_id), {k}, 1))::INT"


_GATED = f"""WITH r AS (SELECT DISTINCT canonical_id, scope, source_kind, content, tags FROM canonical_record), v AS (SELECT canonical_id, scope, CASE WHEN {_digit(3)} = 3 THEN 'secretRef' ELSE source_kind END AS kind, {_digit(3)} AS d3,
content || CASE {_digit(1)} {' '.join(f"WHEN {k} THEN ' {t}'" for k, t in enumerate(_TOKENS))} ELSE '' END AS content, CASE WHEN {_digit(2)} = 0 THEN ' {_TOKENS[2]} ' ELSE '' END AS tag, CASE WHEN {_digit(4)} = 0 THEN '{{"{_TOKENS[3]}": 1}}' ELSE '' END AS extra FROM r),
rules(rule, pattern, rank) AS (VALUES {', '.join(f"('{n}', '{p}', {k})" for k, (n, p) in enumerate(secrets.RULES.items()))}),
h AS (SELECT canonical_id, rule, field * 10 + rank AS place, len(regexp_extract_all(t, pattern, 1)) AS hits FROM (SELECT canonical_id, content AS t, 1 AS field FROM v UNION ALL SELECT canonical_id, extra, 2 FROM v UNION ALL SELECT canonical_id, tag, 3 FROM v), rules),
f AS (SELECT canonical_id, sum(hits)::BIGINT AS findings, sum(hits) FILTER (WHERE rule = 'github-pat')::BIGINT AS allowed, min_by(rule, place) FILTER (WHERE hits > 0 AND rule <> 'github-pat') AS first FROM h GROUP BY 1),
g AS (SELECT v.canonical_id, scope, findings, allowed, CASE WHEN kind = 'secretRef' THEN 'omitted' WHEN first IS NOT NULL OR d3 = 0 THEN 'rejected' WHEN d3 IN (1, 2) THEN 'unresolved' END AS gate_status,
CASE WHEN kind = 'secretRef' THEN 'secret_reference_unsupported' WHEN first IS NOT NULL THEN first WHEN d3 = 0 THEN 'consent_export_disabled' WHEN d3 = 1 THEN 'memory_disabled' WHEN d3 = 2 THEN 'deletion_needs_decision' END AS gate_code FROM v JOIN f ON v.canonical_id = f.canonical_id)"""


def _gated(spark: SparkSession, d: str) -> DataFrame:
    """Records with planted tokens in three fields, consents and wishes to delete, through the gate; one rule is allowed."""
    r = table(spark, d, "canonical_record", heavy=True).select("canonical_id", "scope", "source_kind", "content", "tags").distinct()
    digit = lambda k: F.conv(F.substring(F.md5("canonical_id"), k, 1), 16, 10).cast("int")
    token = F.coalesce(*(F.when(digit(1) == k, f" {t}") for k, t in enumerate(_TOKENS)), F.lit(""))
    none = lambda t: F.lit(None).cast(t)
    consent = F.struct((digit(3) != 0).alias("exportable"), none("string").alias("retention"), none("array<string>").alias("redact"), (digit(3) != 1).alias("memory_enabled"))
    planted = r.select(
        "canonical_id", "scope", F.when(digit(3) == 3, "secretRef").otherwise(F.col("source_kind")).alias("source_kind"), F.concat("content", token).alias("content"), ident.content_hash(F.col("content")).alias("content_hash"), consent.alias("consent"),
        F.when(digit(2) == 0, F.array_append(F.coalesce("tags", F.array().cast("array<string>")), F.lit(_TOKENS[2]))).otherwise(F.col("tags")).alias("tags"), F.when(digit(4) == 0, F.lit(f'{{"{_TOKENS[3]}": 1}}')).alias("source_extra"), F.when(digit(3) == 2, "owner").alias("deletion_intent"),
    )
    return gate.gated(planted, "block", frozenset({"github-pat"}))


@query(f"{_GATED} SELECT canonical_id, gate_status, gate_code, findings FROM g")
def gate_dispositions(spark: SparkSession, d: str) -> DataFrame:
    """What the gate says of each record, and why: secrets anywhere in it, consent, deletion."""
    return _gated(spark, d).select("canonical_id", "gate_status", "gate_code", F.size("sensitive_findings").cast("bigint").alias("findings"))


@query(f"{_GATED} SELECT scope, count(*) AS total, sum(findings)::BIGINT AS findings, sum(findings - allowed)::BIGINT AS blocked, sum(allowed)::BIGINT AS allowlisted FROM g GROUP BY 1")
def gate_summary(spark: SparkSession, d: str) -> DataFrame:
    """Records and findings by scope: all, blocked, allowed."""
    return gate.summary(_gated(spark, d), ["scope"])


_DEDUP_META = "coalesce(scope, '~') || chr(1) || coalesce(scope_qualifier, '~') || chr(1) || coalesce(dna_class, '~') || chr(1) || coalesce(evidence_level, '~') || chr(1) || coalesce(source_kind, '~')"


@query(f"""WITH r AS (SELECT DISTINCT canonical_id, {_DEDUP_META} AS meta, sha256({_fold_sql("content")}) AS body FROM canonical_record)
SELECT canonical_id, CASE WHEN min(canonical_id) OVER w <> canonical_id THEN min(canonical_id) OVER w END AS duplicate_of, count(*) OVER w AS group_size FROM r WINDOW w AS (PARTITION BY meta, body)""")
def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Records whose metadata and folded body agree: one stands for all."""
    r = table(spark, d, "canonical_record")
    meta = [F.col(c) for c in ("scope", "scope_qualifier", "dna_class", "evidence_level", "source_kind")]
    keyed = r.select("canonical_id", duplicate_key(meta, txt.fold_whitespace(F.col("content"))).alias("k")).distinct()
    return exact_duplicates(keyed, "canonical_id", "k").select("canonical_id", "duplicate_of", "group_size")


@query(f"""SELECT disposition, count(*) AS n, min(record_id) AS first, max(content_hash) AS last FROM (SELECT record_id, content_hash, CASE WHEN rank = 1 THEN 'accepted' ELSE 'duplicate_of' END AS disposition
FROM (SELECT record_id, 'sha256:' || sha256(text) AS content_hash, row_number() OVER (PARTITION BY sha256({_fold_sql("text")}) ORDER BY record_id) AS rank FROM (SELECT text, {_b32_sql("sha256('documents' || chr(0) || chr(0) || doc_id)", 40)} AS record_id FROM documents WHERE text IS NOT NULL))) GROUP BY 1""")
def document_dispositions(spark: SparkSession, d: str) -> DataFrame:
    """Documents as records: identity, hash, and what exact deduplication makes of them."""
    docs = table(spark, d, "documents", heavy=True).where("text IS NOT NULL")
    made = docs.select(ident.canonical_id(F.lit("documents"), F.lit(""), F.col("doc_id").cast("string")).alias("record_id"), ident.content_hash(F.col("text")).alias("content_hash"), duplicate_key([], txt.fold_whitespace(F.col("text"))).alias("k"))
    marked = exact_duplicates(made, "record_id", "k")
    how = F.when(F.col("duplicate_of").isNull(), "accepted").otherwise("duplicate_of")
    return marked.groupBy(how.alias("disposition")).agg(F.count("*").alias("n"), F.min("record_id").alias("first"), F.max("content_hash").alias("last"))


@query(f"""WITH r AS (SELECT DISTINCT id, sha256(coalesce(content, text, '')) AS body, snapshot_no FROM memory WHERE id IS NOT NULL),
p AS (SELECT body, min(id) AS rep FROM r WHERE snapshot_no = {_nth(1)} GROUP BY 1 HAVING count(*) > 1), a AS (SELECT r.id, p.rep FROM r JOIN p USING (body) WHERE snapshot_no = {_nth(1)} AND r.id <> p.rep), c AS (SELECT id, body FROM r WHERE snapshot_no = {_nth(0)})
SELECT a.id, a.rep AS representative, CASE WHEN x.id IS NULL THEN 'absent' WHEN x.body = c.body THEN 'still' ELSE 'changed' END AS status FROM a JOIN c ON a.id = c.id LEFT JOIN c x ON x.id = a.rep""")
def alias_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Duplicates of one snapshot against the next: do they still stand for each other?"""
    keyed = table(spark, d, "memory").where("id IS NOT NULL").select("id", "snapshot_no", F.sha2(F.coalesce("content", "text", F.lit("")), 256).alias("k")).distinct()
    last, previous, _ = _deliveries(spark, d)
    before = exact_duplicates(keyed.where(F.col("snapshot_no") == previous), "id", "k").where("duplicate_of IS NOT NULL").select("id", F.col("duplicate_of").alias("representative"))
    return resolve_aliases(keyed.where(F.col("snapshot_no") == last), before, "id", "k")


@query("""WITH r AS (SELECT satellite_id, received_at, run_id FROM receipts), m AS (SELECT satellite_id, max(received_at) AS received_at FROM r GROUP BY 1)
SELECT m.satellite_id, max(r.run_id) AS run_id, m.received_at, count(*) AS ties FROM m JOIN r ON m.satellite_id IS NOT DISTINCT FROM r.satellite_id AND m.received_at IS NOT DISTINCT FROM r.received_at GROUP BY ALL""")
def latest_receipt(spark: SparkSession, d: str) -> DataFrame:
    """The newest receipt of each satellite, and how many share its time."""
    return latest_per_chain(table(spark, d, "receipts"), ["satellite_id"], [F.col("received_at")], ["run_id", "received_at"])


@query("""WITH r AS (SELECT target, writer, location, received_at, run_id FROM receipts WHERE doc_kind = 'receipt'), m AS (SELECT target, writer, location, max(received_at) AS received_at FROM r GROUP BY ALL)
SELECT m.target, m.writer, m.location, max(r.run_id) AS run_id, m.received_at, count(*) AS ties FROM m JOIN r ON m.target IS NOT DISTINCT FROM r.target AND m.writer IS NOT DISTINCT FROM r.writer AND m.location IS NOT DISTINCT FROM r.location AND m.received_at IS NOT DISTINCT FROM r.received_at GROUP BY ALL""")
def shared_basis(spark: SparkSession, d: str) -> DataFrame:
    """The newest receipt of any satellite for each target, writer and location."""
    receipts = table(spark, d, "receipts").where("doc_kind = 'receipt'")
    return latest_per_chain(receipts, ["target", "writer", "location"], [F.col("received_at")], ["run_id", "received_at"])


@query(f"""WITH c AS (SELECT DISTINCT id FROM memory WHERE snapshot_no = {_nth(0)}), p AS (SELECT DISTINCT id, account_uuid FROM memory WHERE snapshot_no = {_nth(1)} AND id IS NOT NULL) SELECT id, account_uuid, 'source_missing' AS reason FROM p WHERE id NOT IN (SELECT id FROM c WHERE id IS NOT NULL)""")
def carry_forward_missing(spark: SparkSession, d: str) -> DataFrame:
    """Memories on record whose source no longer has them."""
    m = table(spark, d, "memory").where("id IS NOT NULL")
    last, before, _ = _deliveries(spark, d)
    return carry_forward(m.where(F.col("snapshot_no") == before).select("id", "account_uuid").distinct(), m.where(F.col("snapshot_no") == last), ["id"])


@query("""WITH n AS (SELECT path, source, count(*) AS n FROM documents WHERE path IS NOT NULL AND lang = 'en' GROUP BY ALL), o AS (SELECT path, source, count(*) AS n FROM documents WHERE path IS NOT NULL GROUP BY ALL)
SELECT path, source, n, 'new' AS side FROM n UNION ALL SELECT path, source, n, 'old' FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.path = o.path AND n.source = o.source)""")
def verdict_merge(spark: SparkSession, d: str) -> DataFrame:
    """New decisions replace old ones of the same key."""
    docs = table(spark, d, "documents").where("path IS NOT NULL")
    new = docs.where("lang = 'en'").groupBy("path", "source").agg(F.count("*").alias("n")).withColumn("side", F.lit("new"))
    old = docs.groupBy("path", "source").agg(F.count("*").alias("n")).withColumn("side", F.lit("old"))
    return merge_latest(old, new, ["path", "source"])


@query("""WITH p AS (SELECT DISTINCT 'a' || account_uuid AS s, id AS r, sha256(coalesce(content, text, '')) AS dg, snapshot_no FROM memory WHERE id IS NOT NULL AND account_uuid IS NOT NULL),
n AS (SELECT DISTINCT s || '-' || snapshot_no AS s, r, dg FROM p), t AS (SELECT s, count(*) AS total FROM n GROUP BY 1), m AS (SELECT a.s, b.s AS candidate, count(*) AS matched FROM n a JOIN n b ON a.r = b.r AND a.dg = b.dg AND a.s <> b.s GROUP BY ALL HAVING count(*) >= 5)
SELECT m.s AS satellite, candidate, matched, total, matched / total::DOUBLE AS ratio FROM m JOIN t ON m.s = t.s WHERE matched / total::DOUBLE >= 0.6""")
def relocation_candidates_found(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries of an account that look like another one that moved."""
    m = table(spark, d, "memory").where("account_uuid IS NOT NULL")
    prints = m.select(F.concat(F.lit("a"), "account_uuid", F.lit("-"), F.col("snapshot_no").cast("string")).alias("satellite"), "id", F.sha2(F.coalesce("content", "text", F.lit("")), 256).alias("dg"))
    return relocation_candidates(prints, prints, "satellite", "id", "dg")


_SIDE = "SELECT id, max(sha256(coalesce(content, text, '') || '|' || coalesce(kind, ''))) AS h FROM memory WHERE snapshot_no = {} AND id IS NOT NULL GROUP BY 1"


@query(f"""WITH p AS ({_SIDE.format(_nth(2))}), t AS ({_SIDE.format(_nth(1))}), s AS ({_SIDE.format(_nth(0))})
SELECT coalesce(p.id, s.id, t.id) AS id, CASE WHEN p.h = s.h AND p.h = t.h THEN 'unchanged' WHEN p.h IS NOT NULL AND s.h = t.h THEN 'converged' WHEN p.h = t.h AND s.h IS NOT NULL THEN 'source_changed' WHEN p.h = s.h AND t.h IS NOT NULL THEN 'target_changed'
WHEN p.h IS NOT NULL AND s.h IS NOT NULL AND t.h IS NOT NULL THEN 'conflict' WHEN p.h IS NULL AND t.h IS NULL THEN 'new' WHEN p.h IS NULL AND s.h IS NULL THEN 'target_untracked' WHEN p.h IS NULL THEN 'both_new' WHEN t.h IS NOT NULL THEN 'source_missing' WHEN s.h IS NOT NULL THEN 'deleted_in_target' ELSE 'gone' END AS outcome
FROM p FULL JOIN s ON p.id = s.id FULL JOIN t ON coalesce(p.id, s.id) = t.id""")
def reconcile_dispositions(spark: SparkSession, d: str) -> DataFrame:
    """The third newest delivery as settled state, the newest as source, the one between as target."""
    last, before, first = _deliveries(spark, d)
    prior, target, source = _sides(spark, d, first, before, last)
    return three_way(prior, source, target, "id", "h").select("id", "outcome")


def _sides(spark: SparkSession, d: str, *numbers: int) -> list[DataFrame]:
    m = table(spark, d, "memory").where("id IS NOT NULL")
    digest = F.sha2(F.concat(F.coalesce("content", "text", F.lit("")), F.lit("|"), F.coalesce("kind", F.lit(""))), 256)
    return [m.where(F.col("snapshot_no") == n).groupBy("id").agg(F.max(digest).alias("h")) for n in numbers]


@query(f"""WITH p AS ({_SIDE.format(_nth(2))}), t AS ({_SIDE.format(_nth(1))}), s AS ({_SIDE.format(_nth(0))})
SELECT p.id, 'sha256:' || sha256('conflict' || p.id || p.h || s.h || t.h) AS cluster_id FROM p JOIN s ON p.id = s.id JOIN t ON p.id = t.id WHERE p.h <> s.h AND p.h <> t.h AND s.h <> t.h""")
def conflict_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Identity of each conflict between source and target."""
    last, before, first = _deliveries(spark, d)
    prior, target, source = _sides(spark, d, first, before, last)
    conflicts = three_way(prior, source, target, "id", "h").where("outcome = 'conflict'")
    return conflicts.select("id", ident.cluster_id("conflict", F.col("id"), F.col("prior_hash"), F.col("source_hash"), F.col("target_hash")).alias("cluster_id"))


@query(f"""WITH p AS ({_SIDE.format(_nth(1))}), s AS ({_SIDE.format(_nth(0))}), o AS (SELECT CASE WHEN p.h IS NULL THEN 'accepted' WHEN s.h IS NULL THEN 'omitted' WHEN p.h = s.h THEN 'already_migrated' ELSE 'transformed' END AS disposition FROM p FULL JOIN s ON p.id = s.id)
SELECT disposition, count(*) AS n, CASE WHEN disposition IN ('accepted', 'transformed') THEN 0 ELSE 3 END AS exit_class FROM o GROUP BY ALL""")
def plan_summary(spark: SparkSession, d: str) -> DataFrame:
    """Records to write, to change, settled and missing, with the exit class each leads to."""
    last, before, _ = _deliveries(spark, d)
    prior, source = _sides(spark, d, before, last)
    both = prior.withColumnRenamed("h", "p").join(source.withColumnRenamed("h", "s"), "id", "full")
    how = F.when(F.col("p").isNull(), "accepted").when(F.col("s").isNull(), "omitted").when(F.col("p") == F.col("s"), "already_migrated").otherwise("transformed")
    return both.groupBy(how.alias("disposition")).agg(F.count("*").alias("n")).withColumn("exit_class", F.when(F.col("disposition").isin("accepted", "transformed"), 0).otherwise(3))


@query("""WITH r AS (SELECT DISTINCT canonical_id, scope, scope_qualifier FROM canonical_record)
SELECT scope || coalesce(': ' || scope_qualifier, '') AS label, count(*) AS entries, min(line) AS first, max(line) AS last, sum(('0x' || substr(md5(line), 1, 8))::BIGINT)::BIGINT AS digest FROM (SELECT *, '- [' || canonical_id || '](memories/' || canonical_id || '.md)' AS line FROM r) GROUP BY 1""")
def scope_index(spark: SparkSession, d: str) -> DataFrame:
    """Index entries per scope label: how many, first, last, and a digest of all lines."""
    from carryover.sinks.notes import index_lines, index_summary

    r = table(spark, d, "canonical_record").select("canonical_id", "scope", "scope_qualifier").distinct()
    return index_summary(index_lines(r))


@query("""SELECT canonical_id, CASE source_kind WHEN 'profile' THEN 'identity' WHEN 'identity' THEN 'identity' WHEN 'instruction' THEN 'procedural' WHEN 'procedural' THEN 'procedural' WHEN 'episodic' THEN 'episodic' WHEN 'working' THEN 'working' ELSE 'semantic' END AS kind,
'carryover:sha256:' || sha256(source.system || chr(0) || coalesce(scope_qualifier, 'user')) AS owner, scope || '/' || coalesce(scope_qualifier, '-') AS address, coalesce(updated_at, created_at) AS observed, content_hash = 'sha256:' || sha256(content) AS hash_holds, count(*) AS copies FROM canonical_record GROUP BY ALL""")
def exchange_projection(spark: SparkSession, d: str) -> DataFrame:
    """Records as rows of the exchange format."""
    from carryover.sinks.exchange import projection

    return projection(table(spark, d, "canonical_record")).groupBy("canonical_id", "kind", "owner", "address", "observed", "hash_holds").agg(F.count("*").alias("copies"))


@query("SELECT vec_id, len(embedding)::INT AS dim, len(embedding) <> 64 AS wrong_dim, len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 AS not_finite FROM embeddings")
def vector_checks(spark: SparkSession, d: str) -> DataFrame:
    """Length and finiteness of every vector."""
    e = table(spark, d, "embeddings")
    odd = F.exists("embedding", lambda x: F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(True)))
    return e.select("vec_id", F.size("embedding").alias("dim"), (F.size("embedding") != 64).alias("wrong_dim"), odd.alias("not_finite"))


@query(f"""WITH a AS (SELECT id, max(content) AS content, max(kind) AS kind, max(created_at) AS created_at FROM memory WHERE snapshot_no = {_nth(1)} AND id IS NOT NULL GROUP BY 1), b AS (SELECT id, max(content) AS content, max(kind) AS kind, max(created_at) AS created_at FROM memory WHERE snapshot_no = {_nth(0)} AND id IS NOT NULL GROUP BY 1)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'missing' WHEN a.id IS NULL THEN 'unexpected' WHEN d = '' THEN 'verified' ELSE 'mismatch' END AS status, CASE WHEN a.id IS NULL OR b.id IS NULL THEN '' ELSE d END AS differing
FROM (SELECT a, b, concat_ws(',', CASE WHEN a.content IS DISTINCT FROM b.content THEN 'content' END, CASE WHEN a.kind IS DISTINCT FROM b.kind THEN 'kind' END, CASE WHEN a.created_at IS DISTINCT FROM b.created_at THEN 'created_at' END) AS d FROM a FULL JOIN b ON a.id = b.id)""")
def readback_verify(spark: SparkSession, d: str) -> DataFrame:
    """One delivery as what was written, the next as what was read back."""
    m = table(spark, d, "memory").where("id IS NOT NULL")
    fields = ["content", "kind", "created_at"]
    side = lambda n: m.where(F.col("snapshot_no") == n).groupBy("id").agg(*(F.max(c).alias(c) for c in fields))
    last, before, _ = _deliveries(spark, d)
    return field_differences(side(before), side(last), "id", fields).select("id", "status", F.array_join("differing", ",").alias("differing"))


@query("""SELECT source.satellite_id AS satellite_id, CASE WHEN count(DISTINCT source.system) = 0 THEN 'unknown' WHEN count(DISTINCT source.system) = 1 THEN min(source.system) ELSE 'mixed' END AS system, count(DISTINCT source.system) AS systems, count(*) AS records FROM canonical_record GROUP BY 1""")
def source_detection(spark: SparkSession, d: str) -> DataFrame:
    """The system behind each satellite, or that there are several."""
    n = F.count_distinct("source.system")
    return table(spark, d, "canonical_record").groupBy(F.col("source.satellite_id").alias("satellite_id")).agg(F.when(n == 0, "unknown").when(n == 1, F.min("source.system")).otherwise("mixed").alias("system"), n.alias("systems"), F.count("*").alias("records"))


@query("SELECT run_id, target, count(*) AS n FROM receipts GROUP BY ALL HAVING count(*) > 1")
def uniqueness_violations(spark: SparkSession, d: str) -> DataFrame:
    """Receipts filed twice."""
    return violations(table(spark, d, "receipts"), ["run_id", "target"])


_NESTED = """WITH RECURSIVE n AS (SELECT event_id, event_type, '{"p": ' || props || ', "t/y": {"kind": "' || event_type || '", "list": [1, {"a": 2}], "none": null, "empty": {}}, "id": ' || event_id || '}' AS j FROM events),
e AS (SELECT event_id, event_type, '' AS leaf, j::JSON AS v FROM n UNION ALL SELECT event_id, event_type, leaf || '/' || replace(replace(k, '~', '~0'), '/', '~1'), x FROM (SELECT event_id, event_type, leaf, unnest(json_keys(v)) AS k, unnest(json_extract(v, '$.*')) AS x FROM e WHERE json_type(v) = 'OBJECT')),
l AS (SELECT event_id, event_type, leaf, CASE json_type(v) WHEN 'VARCHAR' THEN v->>'$' WHEN 'ARRAY' THEN NULL WHEN 'OBJECT' THEN NULL WHEN 'NULL' THEN 'null' ELSE v::VARCHAR END AS value FROM e WHERE json_type(v) <> 'OBJECT' OR len(json_keys(v)) = 0)"""


def _nested_events(spark: SparkSession, d: str) -> DataFrame:
    """Events with their properties inside a deeper document."""
    e = table(spark, d, "events")
    deep = F.concat(F.lit('{"p": '), "props", F.lit(', "t/y": {"kind": "'), "event_type", F.lit('", "list": [1, {"a": 2}], "none": null, "empty": {}}, "id": '), F.col("event_id").cast("string"), F.lit("}"))
    return e.select("event_id", "event_type", deep.alias("props"))


@query(f"{_NESTED} SELECT event_id, leaf, value FROM l")
def event_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Every leaf of nested event documents; an array is one leaf."""
    return json_leaves(_nested_events(spark, d), "event_id", "props")


@query(f"{_NESTED} SELECT event_id, leaf FROM l WHERE leaf <> '/id' AND NOT (event_type = 'click' AND (leaf LIKE '/p/%' OR leaf = '/t~1y/kind'))")
def unreported_fields(spark: SparkSession, d: str) -> DataFrame:
    """Leaves that no reader mapped: all map the id, clicks also a whole object and one leaf of another."""
    e = _nested_events(spark, d)
    mapped = e.select("event_id", F.explode(F.when(F.col("event_type") == "click", F.array(F.lit("/id"), F.lit("/p"), F.lit("/t~1y/kind"))).otherwise(F.array(F.lit("/id")))).alias("path"))
    return unreported(json_leaves(e, "event_id", "props"), mapped, "event_id").select("event_id", "leaf")


@query("SELECT doc_id, len(list_filter(str_split_regex(text, '\\r?\\n'), lambda x: regexp_matches(x, '^\\s*-\\s+\\[[^\\]]+\\]\\([^)]+\\)'))) AS links FROM documents WHERE text IS NOT NULL")
def index_link_counts(spark: SparkSession, d: str) -> DataFrame:
    """List items that begin with a link, per document."""
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", txt.index_links(F.col("text")).alias("links"))


@query("""WITH a AS (SELECT CAST(received_at AS DATE) AS day, id, snapshot_no FROM memory WHERE id IS NOT NULL), f AS (SELECT id, min(snapshot_no) AS first FROM a GROUP BY 1)
SELECT day, count(*) FILTER (WHERE snapshot_no = first) AS added, count(*) FILTER (WHERE snapshot_no > first) AS updated FROM a JOIN f USING (id) GROUP BY 1""")
def change_log(spark: SparkSession, d: str) -> DataFrame:
    """Per day, rows of records first seen then and of known ones."""
    a = table(spark, d, "memory").where("id IS NOT NULL").select(F.to_date("received_at").alias("day"), "id", "snapshot_no")
    first = a.groupBy("id").agg(F.min("snapshot_no").alias("first"))
    return a.join(first, "id").groupBy("day").agg(F.count_if(F.col("snapshot_no") == F.col("first")).alias("added"), F.count_if(F.col("snapshot_no") > F.col("first")).alias("updated"))


@query(f"""WITH r AS (SELECT *, sha256(source.system || chr(0) || coalesce(source.satellite_id, '') || chr(0) || source_record_id) AS h FROM canonical_record),
f AS (SELECT canonical_id, unnest(list_filter([
CASE WHEN scope NOT IN ('user', 'project', 'agent', 'session', 'tenant', 'wing', 'room') THEN 'vocabulary:/scope' END, CASE WHEN dna_class NOT IN ('dna', 'standard') THEN 'vocabulary:/dna_class' END,
CASE WHEN evidence_level NOT IN ('measured', 'official', 'third_party', 'inferred') THEN 'vocabulary:/evidence_level' END, CASE WHEN provenance.actor_kind NOT IN ('user', 'agent', 'model', 'import', 'scan') THEN 'vocabulary:/provenance/actor_kind' END,
CASE WHEN NOT regexp_full_match(canonical_id, '[a-z2-7]{{32}}') THEN 'shape:/canonical_id' END, CASE WHEN NOT regexp_full_match(content_hash, 'sha256:[0-9a-f]{{64}}') THEN 'shape:/content_hash' END,
CASE WHEN content_hash <> 'sha256:' || sha256(content) THEN 'derived:/content_hash' END, CASE WHEN canonical_id <> {_b32_sql("h", 40)} THEN 'derived:/canonical_id' END,
CASE WHEN canonical_id IS NULL THEN 'missing:/canonical_id' END, CASE WHEN source IS NULL THEN 'missing:/source' END, CASE WHEN source_record_id IS NULL THEN 'missing:/source_record_id' END, CASE WHEN source_locator IS NULL THEN 'missing:/source_locator' END,
CASE WHEN scope IS NULL THEN 'missing:/scope' END, CASE WHEN content IS NULL THEN 'missing:/content' END, CASE WHEN content_hash IS NULL THEN 'missing:/content_hash' END, CASE WHEN dna_class IS NULL THEN 'missing:/dna_class' END,
CASE WHEN provenance IS NULL THEN 'missing:/provenance' END, CASE WHEN evidence_level IS NULL THEN 'missing:/evidence_level' END], lambda x: x IS NOT NULL)) AS problem FROM r)
SELECT canonical_id, problem, count(*) AS n FROM f GROUP BY ALL""")
def record_problems(spark: SparkSession, d: str) -> DataFrame:
    """Rules that records break."""
    from carryover.canonical import problems

    return problems(table(spark, d, "canonical_record")).groupBy("canonical_id", "problem").agg(F.count("*").alias("n"))


@query("""SELECT event_id, md5(CASE WHEN event_type = 'click' THEN '' ELSE '"p": ' || p || ', ' END || '"t/y": {"empty": {}, ' || CASE WHEN event_type = 'click' THEN '' ELSE '"kind": "' || event_type || '", ' END || '"list": [1, {"a": 2}], "none": null}}') AS rest FROM (SELECT event_id, event_type, '{"k": ' || json_extract_string(props, '$.k') || '}' AS p FROM events)""".replace("md5(CASE", "md5('{' || CASE"))
def preserved_fields(spark: SparkSession, d: str) -> DataFrame:
    """What is left of nested event documents when readers have mapped theirs (digest of the JSON text)."""
    from carryover.operators.coverage import preserved

    e = _nested_events(spark, d).withColumn("mapped", F.when(F.col("event_type") == "click", F.array(F.lit("/id"), F.lit("/p"), F.lit("/t~1y/kind"))).otherwise(F.array(F.lit("/id"))))
    return preserved(e, "props", "mapped", "rest").select("event_id", F.md5("rest").alias("rest"))


@query(r"""WITH t AS (SELECT receipt_no, upper(trim(created_at, ' ')) AS v FROM receipts), u AS (SELECT receipt_no, v, regexp_full_match(v, '\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})') AS shaped, regexp_full_match(v, '\d{1,11}(\.\d{1,9})?') AS number FROM t)
SELECT receipt_no, CASE WHEN shaped AND try_cast(v[1:10] AS DATE) IS NOT NULL AND v[12:13]::INT < 24 AND v[15:16]::INT < 60 AND v[18:19]::INT < 60 THEN v
WHEN number THEN strftime(epoch_ms(str_split(v, '.')[1]::BIGINT * 1000), '%Y-%m-%dT%H:%M:%S') || CASE WHEN rtrim(regexp_extract(v, '\.(\d+)$', 1), '0') <> '' THEN '.' || rtrim(regexp_extract(v, '\.(\d+)$', 1), '0') ELSE '' END || 'Z' END AS time_text FROM u""")
def time_texts(spark: SparkSession, d: str) -> DataFrame:
    """Exact time texts of receipts, where they are RFC 3339 or Unix seconds."""
    return table(spark, d, "receipts").select("receipt_no", txt.rfc3339_text(F.col("created_at")).alias("time_text"))


@query("""SELECT row_no, coalesce(CASE WHEN json_valid(extra) THEN CASE json_type(extra) WHEN 'ARRAY' THEN json_array_length(extra) WHEN 'OBJECT' THEN len(json_keys(extra)) ELSE 1 END END, 0)::BIGINT AS parts FROM memory WHERE extra IS NOT NULL""")
def extra_parts(spark: SparkSession, d: str) -> DataFrame:
    """How many top-level parts each JSON extra has (0 where it isn't JSON)."""
    from carryover.operators.nested import flatten_json

    m = table(spark, d, "memory").where("extra IS NOT NULL")
    trees = flatten_json(m, "row_no", "extra", roots=True)
    top = trees.where("table_path = ''").groupBy("row_no").agg(F.count("*").alias("n"))
    kinds = trees.where("pos IS NULL").select("row_no", "kind")
    keys = F.coalesce(F.size(F.json_object_keys("extra")), F.lit(0))
    joined = m.select("row_no", keys.alias("keys")).join(kinds, "row_no").join(top, "row_no", "left")
    return joined.select("row_no", F.when(F.col("kind") == "object", F.col("keys")).when(F.col("kind") == "array", F.coalesce("n", F.lit(0))).when(F.col("kind") == "invalid", 0).otherwise(1).cast("bigint").alias("parts"))
