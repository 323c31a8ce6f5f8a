"""A directory of Markdown notes with front matter, an index by scope and a change log.

Notes are rendered as columns and written by the tasks, one file per record, each in
one step; running a task again writes the same bytes. Index and log are aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carryover.functions.text import front_matter
from carryover.sinks.files import read_or_none, replace_file, safe_join

FRONT_FIELDS = ["canonical_id", "scope", "scope_qualifier", "dna_class", "evidence_level", "source_kind", "source_locator", "created_at", "updated_at", "content_hash"]


def escape_title(title: Column) -> Column:
    """Brackets and backslashes of a link text, escaped."""
    return F.regexp_replace(title, r"([\[\]\\])", r"\\$1")


def rendered(df: DataFrame) -> DataFrame:
    """(path, note): front matter lines with JSON strings, then the body as it is."""
    # a JSON string is a valid double-quoted YAML scalar
    line = lambda f: F.when(F.col(f).isNotNull(), F.concat(F.lit(f"{f}: "), F.regexp_extract(F.to_json(F.struct(F.col(f).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)))
    front = F.concat_ws("\n", *(line(f) for f in FRONT_FIELDS if f in df.columns))
    return df.select(F.concat(F.lit("memories/"), "canonical_id", F.lit(".md")).alias("path"), F.concat(F.lit("---\n"), front, F.lit("\n---\n"), "content").alias("note"))


def write_notes(df: DataFrame, root: str) -> DataFrame:
    """Writes every note of ``df`` under ``root`` (a folder all tasks see): (path, status) of each.

    Status is ``written``, ``unchanged`` or ``untracked`` (other bytes are there; they
    stay). Lazy: the files are written when the result is used; doing so again is safe.
    """
    notes = rendered(df)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            status = []
            for path, note in zip(pdf["path"], pdf["note"], strict=True):
                at, data = safe_join(root, path), note.encode()
                there = read_or_none(at)
                if there is None:
                    replace_file(at, data, None)
                    status.append("written")
                else:
                    status.append("unchanged" if there == data else "untracked")
            yield pd.DataFrame({"path": list(pdf["path"]), "status": status})

    return notes.mapInPandas(run, "path string, status string")


def read_notes(spark: SparkSession, root: str) -> DataFrame:
    """(path, canonical_id, front, body, unclosed) of the notes under ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(f"{root}/memories")
    text = F.decode("content", "UTF-8")
    parts = files.where(F.is_valid_utf8("content")).select(F.regexp_extract("path", r"(memories/[^/]+\.md)$", 1).alias("path"), front_matter(text).alias("p"))
    value = F.regexp_extract("p.front", r"(?m)^canonical_id: (\".*\")$", 1)
    return parts.select("path", F.from_json(F.concat(F.lit('{"v":'), F.when(value != "", value).otherwise("null"), F.lit("}")), "v string")["v"].alias("canonical_id"), "p.front", "p.body", "p.unclosed")


def index_lines(df: DataFrame) -> DataFrame:
    """(label, canonical_id, line): the index line of each record under its scope."""
    label = F.concat("scope", F.coalesce(F.concat(F.lit(": "), "scope_qualifier"), F.lit("")))
    line = F.concat(F.lit("- ["), "canonical_id", F.lit("](memories/"), "canonical_id", F.lit(".md)"))
    return df.select(label.alias("label"), "canonical_id", line.alias("line"))


def index_summary(lines: DataFrame) -> DataFrame:
    """(label, entries, first, last, digest) of each scope; the digest doesn't depend on order."""
    part = F.conv(F.substring(F.md5("line"), 1, 8), 16, 10).cast("bigint")
    return lines.groupBy("label").agg(F.count("*").alias("entries"), F.min("line").alias("first"), F.max("line").alias("last"), F.sum(part).alias("digest"))


def write_index(lines: DataFrame, path: str) -> None:
    """Index files in order of scope and id: ranges of lines, so that no scope is gathered in one task."""
    ordered = lines.repartitionByRange("label", "canonical_id").sortWithinPartitions("label", "canonical_id")
    ordered.select(F.concat_ws("\t", "label", "line").alias("value")).write.mode("overwrite").text(path)


def prepend_log(old: str | None, day: str, added: int, updated: int) -> str:
    """The change log with an event on top; days are unique and fall."""
    lines = (old or "# Log\n").split("\n")
    event = f"- +{added} ~{updated}"
    head, rest = lines[0], [x for x in lines[1:] if x]
    days = [x for x in rest if x.startswith("## ")]
    if days and days[0] == f"## {day}":
        rest.insert(1, event)
    elif days and days[0][3:] > day:
        raise ValueError("the log has a later day")
    else:
        rest = [f"## {day}", event, *rest]
    return "\n".join([head, *rest]) + "\n"


def divergence(read: DataFrame, records: DataFrame) -> DataFrame:
    """(canonical_id, changed): what owners edited in their copies since they were written.

    ``changed`` lists ``/content`` and front matter fields; an id that isn't in
    ``records`` is ``unmanaged``, a note without an id isn't listed.
    """
    kept = [f for f in FRONT_FIELDS if f != "canonical_id" and f in records.columns]
    line = lambda f: F.regexp_extract("front", rf'(?m)^{f}: (".*")$', 1)
    text = lambda f: F.from_json(F.concat(F.lit('{"v":'), F.when(line(f) != "", line(f)).otherwise("null"), F.lit("}")), "v string")["v"]
    ours = records.select("canonical_id", F.struct("content", *kept).alias("r"))
    both = read.where("canonical_id IS NOT NULL").join(ours, "canonical_id", "left")
    changed = F.array_compact(F.array(F.when(~F.col("body").eqNullSafe(F.col("r.content")), F.lit("/content")), *(F.when(~text(f).eqNullSafe(F.col(f"r.{f}").cast("string")), F.lit(f"/{f}")) for f in kept)))
    return both.select("canonical_id", F.when(F.col("r").isNull(), F.array(F.lit("unmanaged"))).otherwise(changed).alias("changed")).where(F.size("changed") > 0)
