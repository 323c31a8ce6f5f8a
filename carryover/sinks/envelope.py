"""Managed notes: a whole record inside the front matter of a Markdown file, and what owners edited there.

Front matter holds fields that people read (title, tags, sources, who made it) and the
record itself as canonical JSON; the body is the content. The file is the fact: an edited
body or tag list is adopted into the record that is read back, while provenance stays as
the envelope has it and is only reported.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carryover.canonical import DDL, completed, record_json, record_type, with_record_hash
from carryover.functions.canonical_json import canonical_text
from carryover.functions.identity import canonical_id, content_hash
from carryover.functions.text import front_matter, title
from carryover.functions.yaml_subset import front_matter_json

# The keys of a managed note and its version; a text that names a key claims to be one.
MARK, RECORD, VERSION = "carryover_note", "record", "1"
CLAIM = rf"""(?m)(?:^[ \t]*|[,{{][ \t]*)["']?{MARK}["']?[ \t]*:"""
INDEX_MARK, LOG_MARK = "<!-- carryover:index:v1 -->", "<!-- carryover:log:v1 -->"


def _json_of(value: Column) -> Column:
    return F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def native(df: DataFrame) -> dict[str, Column]:
    """What people read: (title, sources, generated, tags) of records, null where a record has none.

    Only people, agents and models are authors; a scan or an import isn't.
    """
    actor, kind = F.col("provenance.actor"), F.col("provenance.actor_kind")
    author = F.when(kind == "user", F.when(actor.startswith("human:"), actor).otherwise(F.concat(F.lit("human:"), actor))).when(kind.isin("agent", "model"), actor)
    source = F.struct(F.col("source_record_id").alias("id"), F.col("source_locator").alias("resource"), author.alias("author"), F.col("updated_at").alias("last_modified"))
    return {
        "title": title(F.col("content"), F.col("canonical_id")), "sources": F.array(source),
        "generated": F.when(author.isNotNull() & F.col("updated_at").isNotNull(), F.struct(author.alias("by"), F.col("updated_at").alias("at"))), "tags": F.col("tags"),
    }


def rendered(records: DataFrame) -> DataFrame:
    """(canonical_id, target_id, path, note) of records of the canonical type."""
    df = completed(records)
    shown = [F.when(c.isNotNull(), F.concat(F.lit(f"{name}: "), _json_of(c))) for name, c in native(df).items()]
    whole = canonical_text(record_json(df.drop("content")))
    front = F.concat_ws("\n", F.lit("type: Memory"), *shown, F.lit(f'{MARK}: "{VERSION}"'), F.concat(F.lit(f"{RECORD}: "), whole))
    target = F.concat(F.lit("memories/"), "canonical_id")
    return df.select("canonical_id", target.alias("target_id"), F.concat(target, F.lit(".md")).alias("path"), F.concat(F.lit("---\n"), front, F.lit("\n---\n"), "content").alias("note"))


def restored(files: DataFrame) -> DataFrame:
    """What the notes of an inventory hold (path, content): one row per file.

    Adds target_id, target_hash, classification (``unmanaged``, ``managed_invalid`` or
    null), the record with owners' edits adopted (its fields are null without one),
    record_hash, envelope_hash, and home_fields: pointers of what was edited.
    """
    text = F.when(F.is_valid_utf8("content"), F.decode("content", "UTF-8"))
    doc = files.select("path", content_hash(F.col("content")).alias("target_hash"), text.alias("text")).withColumn("p", front_matter(F.col("text")))
    # text before the closing line decides whether a damaged note claims to be managed
    head = F.when(F.col("p.unclosed"), F.col("text")).otherwise(F.col("p.front"))
    doc = doc.withColumns({"claims": F.coalesce(head.rlike(CLAIM), F.lit(False)), "y": front_matter_json(F.col("p.front"))})
    v = lambda path: F.get_json_object("y.json", path)
    # a generator keeps the parsed record apart, so that it isn't parsed again for each field
    doc = doc.select("*", F.explode(F.array(F.when(F.col("claims") & (v(f"$.{MARK}") == VERSION), F.from_json(v(f"$.{RECORD}"), DDL)))).alias("e"))
    made = canonical_id(F.col("e.source.system"), F.col("e.source.satellite_id"), F.col("e.source_record_id"))
    valid = F.coalesce(F.col("e.canonical_id") == made, F.lit(False))
    doc = doc.withColumn("valid", valid).withColumn("classification", F.when(F.col("valid"), None).when(F.col("claims"), "managed_invalid").otherwise("unmanaged"))
    raw = v("$.tags")
    listed, wrong = F.from_json(raw, "array<string>"), raw.isNotNull() & raw.startswith("{")
    tags = F.when(raw.isNull(), F.lit(None).cast("array<string>")).when(raw.startswith("["), listed).otherwise(F.array(raw))
    names = record_type().names
    base = doc.select(
        "path", F.regexp_replace("path", r"\.md$", "").alias("target_id"), "target_hash", "classification", "valid", "y", F.col("e.content_hash").alias("_stored"), F.col("e.tags").alias("_tags"), tags.alias("_new_tags"), wrong.alias("_wrong"), content_hash(F.col("p.body")).alias("_body_hash"),
        *(F.when(F.col("valid"), F.col("p.body") if c == "content" else F.col(f"e.{c}")).alias(c) for c in names),
    )
    stored = with_record_hash(base).withColumnRenamed("record_hash", "envelope_hash")
    adopted = stored.withColumns({"content_hash": F.when(F.col("valid"), F.col("_body_hash")), "tags": F.when(F.col("_wrong"), F.col("_tags")).otherwise(F.col("_new_tags"))})
    now = with_record_hash(adopted)
    shown = native(now)
    same = lambda name: F.get_json_object("y.json", f"$.{name}").eqNullSafe(F.get_json_object(F.to_json(F.struct(shown[name].alias("x"))), "$.x"))
    edits = [
        (F.col("_stored") != F.col("_body_hash"), "/body"), (~F.col("_tags").eqNullSafe(F.col("_new_tags")) | F.col("_wrong"), "/frontmatter/tags"),
        (~same("title"), "/frontmatter/title"), (~same("sources"), "/frontmatter/sources"), (~same("generated"), "/frontmatter/generated"),
    ]
    fields = F.when(F.col("valid"), F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in edits)))).otherwise(F.array().cast("array<string>"))
    return now.withColumns({"home_fields": fields, "record_hash": F.when(F.col("valid"), F.col("record_hash")), "envelope_hash": F.when(F.col("valid"), F.col("envelope_hash"))}).drop("_stored", "_tags", "_new_tags", "_wrong", "_body_hash", "valid", "y")


def edit_anomalies(notes: DataFrame) -> DataFrame:
    """(path, code, line, field_path): what owners edited in notes of ``restored``."""
    codes = {"/body": "note_body_changed", "/frontmatter/title": "note_title_divergent", "/frontmatter/sources": "note_provenance_divergent", "/frontmatter/generated": "note_provenance_divergent"}
    told = notes.select("path", F.explode("home_fields").alias("field_path"))
    code = F.coalesce(*(F.when(F.col("field_path") == f, c) for f, c in codes.items()))
    return told.select("path", code.alias("code"), F.lit(None).cast("bigint").alias("line"), "field_path").where("code IS NOT NULL")


def owned_index(text: str | None) -> bool:
    """Whether an index is one of ours: our mark is its first line."""
    return text is not None and text.split("\n", 1)[0].rstrip("\r") == INDEX_MARK


def owned_log(text: str | None) -> dict[str, list[str]] | None:
    """Day -> lines of a log of ours, newest first; None for others; a damaged one raises ValueError."""
    lines = (text or "").split("\n")
    if lines[0].rstrip("\r") != LOG_MARK:
        return None
    if len(lines) < 2 or lines[1].rstrip("\r") != "# Log":
        raise ValueError("the log has no heading")
    days: dict[str, list[str]] = {}
    for raw in lines[2:]:
        line = raw.rstrip("\r")
        if line.startswith("## "):
            day = line[3:]
            date.fromisoformat(day)
            if days and (day >= next(reversed(days)) or not any(x.strip() for x in days[next(reversed(days))])):
                raise ValueError("days of a log are unique, filled and fall")
            days[day] = []
        elif days:
            days[next(reversed(days))].append(line)
        elif line.strip():
            raise ValueError("an entry of the log has no day")
    if not days or not any(x.strip() for x in days[next(reversed(days))]):
        raise ValueError("the log is empty")
    return days


def logged(days: dict[str, list[str]] | None, day: str, added: int, updated: int) -> str:
    """The log with one more event under its day."""
    days = dict(days or {})
    if days and next(iter(days)) > day:
        raise ValueError("the log has a later day")
    event = f"- +{added} ~{updated}"
    days = {day: [event, *[x for x in days.pop(day, []) if x.strip()]]} | days
    return "\n".join([LOG_MARK, "# Log", *(x for d, lines in days.items() for x in (f"## {d}", *(y for y in lines if y.strip())))]) + "\n"
