"""Queries over the driver's tables for the operators of this subpackage."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carryover.llm.leaks import find_leaks
from carryover.llm.mixing import Plan
from carryover.llm.neardup import classes, id_pairs, links, texts
from carryover.llm.pii import find_pii, redact
from carryover.llm.sentences import sentences
from carryover.session import table


def _free_texts(spark: SparkSession, d: str) -> DataFrame:
    """(src, rec_key, content) of all texts that may hold personal data."""
    memory = table(spark, d, "memory", heavy=True).select(F.lit("memory").alias("src"), F.col("row_no").cast("string").alias("rec_key"), "content")
    nested = lambda name, key, array: (
        table(spark, d, name, heavy=True)
        .select(key, F.posexplode(f"{array}.content").alias("pos", "content"))
        .select(F.lit(name).alias("src"), F.concat_ws("/", F.col(key).cast("string"), F.col("pos").cast("string")).alias("rec_key"), "content")
    )
    return memory.unionByName(nested("memories", "export_no", "memory_files")).unionByName(nested("projects", "project_no", "docs"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Each personal item in free text, with its type and place."""
    return find_pii(_free_texts(spark, d), ["src", "rec_key"], "content", table(spark, d, "person_lexicon")).select("src", "rec_key", "pii_kind", "start_pos")


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    """All free texts with typed placeholders."""
    return redact(_free_texts(spark, d), "content", table(spark, d, "person_lexicon")).select("src", "rec_key", "redacted")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold 12 words (zh and ja: 20 letters or digits) of an item in a row."""
    leaks = find_leaks(table(spark, d, "documents", heavy=True), table(spark, d, "eval_item"), edits=0)
    return leaks.select("doc_id", "item_id").distinct()


def p7_near(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a passage of an item within one edit, and the run they share exactly."""
    return find_leaks(table(spark, d, "documents", heavy=True), table(spark, d, "eval_item"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The chosen documents and how often each is taken."""
    return Plan(table(spark, d, "documents", heavy=True), table(spark, d, "mix_target")).chosen()


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share each source gets, against its target."""
    return Plan(table(spark, d, "documents", heavy=True), table(spark, d, "mix_target")).report()


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """The place of every sentence of every document."""
    return sentences(table(spark, d, "documents", heavy=True), bodies=False).select("doc_id", "start_pos", "end_pos")


def p9_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Every sentence of every document, with its number and text."""
    return sentences(table(spark, d, "documents", heavy=True))


def _near_duplicate_sources(spark: SparkSession, d: str) -> list[tuple[str, DataFrame]]:
    """(src, texts): the last snapshot of ``memory`` and all of ``canonical_record``."""
    memory = table(spark, d, "memory", heavy=True).select("snapshot_no", "id", "content")
    last = memory.agg(F.max("snapshot_no")).first()[0]
    records = table(spark, d, "canonical_record", heavy=True).select(F.col("canonical_id").alias("id"), "content")
    return [("memory", texts(memory.where(F.col("snapshot_no") == last), "content", "id", 40)), ("canonical_record", texts(records, "content", "id", 40))]


def _side_by_side(make, sources: list[tuple[str, DataFrame]]) -> list[DataFrame]:  # noqa: ANN001
    """``make`` of each source; their jobs share the cluster instead of waiting for each other."""
    with ThreadPoolExecutor(len(sources)) as pool:
        return list(pool.map(lambda s: make(*s), sources))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of ids whose contents share at least 0.6 of their 5-character substrings."""
    parts = _side_by_side(lambda name, src: id_pairs(links(src), src).select(F.lit(name).alias("src"), "id_a", "id_b"), _near_duplicate_sources(spark, d))
    return parts[0].unionByName(parts[1])


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each id with the class of alike contents it belongs to, and its number of links."""
    parts = _side_by_side(lambda name, src: classes(links(src), src).select(F.lit(name).alias("src"), F.col("i").alias("id"), "class_id", "n_links"), _near_duplicate_sources(spark, d))
    return parts[0].unionByName(parts[1])


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_classes, p4_found, p4_redacted, p7_found, p7_near, p8_mix, p8_shares, p9_found, p9_sentences)}


P1_SQL = r"""WITH s AS (SELECT 'memory' AS src, id, content FROM memory WHERE snapshot_no = (SELECT max(snapshot_no) FROM memory) UNION ALL SELECT 'canonical_record', canonical_id, content FROM canonical_record),
k AS (SELECT * FROM (SELECT DISTINCT src, id, trim(regexp_replace(lower(content), '[^\p{L}\p{N}]+', ' ', 'g')) AS t FROM s WHERE content IS NOT NULL AND id IS NOT NULL) WHERE length(t) >= 40),
u AS (SELECT src, t, dense_rank() OVER (ORDER BY src, t) AS u, list_distinct(list_transform(range(1, length(t) - 3), lambda i: substr(t, i, 5))) AS g FROM (SELECT DISTINCT src, t FROM k)),
x AS (SELECT src, u, len(g) AS c, unnest(g) AS g FROM u),
p AS (SELECT a.u AS ua, b.u AS ub FROM x a JOIN x b ON a.src = b.src AND a.g = b.g AND a.u < b.u GROUP BY a.u, b.u, a.c, b.c HAVING count(*) >= 0.6 * (a.c + b.c - count(*)) - 1e-9),
m AS (SELECT k.src, k.id, u.u FROM k JOIN u ON k.src = u.src AND k.t = u.t)
SELECT DISTINCT a.src, least(a.id, b.id) AS id_a, greatest(a.id, b.id) AS id_b FROM m a JOIN (SELECT ua, ub FROM p UNION ALL SELECT DISTINCT u, u FROM m) q ON a.u = q.ua JOIN m b ON b.u = q.ub WHERE a.id <> b.id"""


# DuckDB has no NFKC: the full-width forms are put in place by hand, others don't occur in the tables
_WIDE = "".join(chr(0xFF10 + k) for k in range(10)) + "".join(chr(a + k) for a in (0xFF21, 0xFF41) for k in range(26))
_NARROW = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_WORDS = rf"string_split_regex(trim(regexp_replace(lower(regexp_replace(nfc_normalize(translate(text, '{_WIDE}', '{_NARROW}')), '\p{{Cf}}+', '', 'g')), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')"

P7_SQL = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text <> ''),
i AS (SELECT item_id, lower(left(lang, 2)) IN ('zh', 'ja') AS dense, {_WORDS} AS w FROM eval_item),
c AS (SELECT item_id, array_to_string(w, '') AS s FROM i WHERE dense), e AS (SELECT doc_id, array_to_string(w, '') AS s FROM d),
iw AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i WHERE NOT dense)), dw AS (SELECT doc_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
ic AS (SELECT DISTINCT item_id, substr(s, k, 20) AS g FROM (SELECT item_id, s, unnest(range(1, length(s) - 18)) AS k FROM c)), dc AS (SELECT doc_id, substr(s, k, 20) AS g FROM (SELECT doc_id, s, unnest(range(1, length(s) - 18)) AS k FROM e))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (g) UNION SELECT DISTINCT doc_id, item_id FROM dc JOIN ic USING (g)"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_SQL, "p7_found": P7_SQL}
