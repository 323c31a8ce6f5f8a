"""Markdown files as records: front matter, body, kind, tags and scope from the path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carryover.functions.identity import canonical_id, content_hash
from carryover.functions.text import dna_class, front_matter, index_links, kind_is_inferred

# Files that only list others.
REGISTERED_ONLY = ["MEMORY.md", "index.md", "log.md"]
PROJECT_PATH = r"(?:^|/)projects/([^/]+)/memory(?:/|$)"


def _scalar(name: str):  # noqa: ANN202
    """A plain or quoted scalar of a front matter line, null where there is none."""
    raw = F.regexp_extract("p.front", rf"(?m)^{name}:[ \t]*(.*?)[ \t]*\r?$", 1)
    quoted = F.regexp_replace(raw, r"^([\"'])(.*)\1$", "$2")
    return F.when(raw != "", quoted)


def _listed(name: str):  # noqa: ANN202
    """An inline or block list of a front matter key."""
    inline = F.regexp_extract("p.front", rf"(?m)^{name}:[ \t]*\[(.*?)\][ \t]*\r?$", 1)
    block = F.regexp_extract("p.front", rf"(?ms)^{name}:[ \t]*\r?\n((?:[ \t]*-[^\n]*\n?)+)", 1)
    clean = lambda xs: F.filter(F.transform(xs, lambda x: F.regexp_replace(F.trim(x), r"^([\"'])(.*)\1$", "$2")), lambda x: x != "")
    return F.when(inline != "", clean(F.split(inline, ","))).when(block != "", clean(F.transform(F.split(block, "\n"), lambda x: F.regexp_replace(x, r"^\s*-\s*", ""))))


def markdown_records(files: DataFrame, satellite: str = "") -> DataFrame:
    """Records of the Markdown files of an inventory; files that aren't UTF-8 carry an anomaly.

    A note is registered only, with the number of its links, if it is an index. Notes
    whose front matter has a permalink are told apart (``notes``); notes that name
    ``node_type: memory`` belong to the project of their path, else to their folder.
    """
    md = files.where(F.lower("path").endswith(".md") & ~F.col("path").endswith(".chatgpt.md"))
    text = F.when(F.is_valid_utf8("content"), F.decode("content", "UTF-8"))
    parsed = md.select("path", text.alias("text")).withColumn("p", front_matter(F.col("text")))
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    fields = parsed.withColumns({"kind": _scalar("type"), "title": F.coalesce(_scalar("name"), _scalar("title")), "permalink": _scalar("permalink"), "tags": _listed("tags"), "created": _scalar("created"), "modified": F.coalesce(_scalar("modified"), _scalar("updated_at")), "node": F.regexp_extract("p.front", r"(?m)^[ \t]*node_type:[ \t]*(\S+)", 1)})
    project = F.regexp_extract("path", PROJECT_PATH, 1)
    folder = F.regexp_extract("path", r"([^/]+)/[^/]*$", 1)
    in_project = F.col("node") == "memory"
    system = F.when(F.col("permalink").isNotNull(), "notes").when(in_project, "project_memory").otherwise("markdown")
    record_id = F.coalesce("permalink", "path")
    registered = name.isin(REGISTERED_ONLY)
    return fields.select(
        "path",
        system.alias("system"),
        canonical_id(system, F.lit(satellite), record_id).alias("canonical_id"),
        record_id.alias("source_record_id"),
        F.when(in_project, "project").otherwise("user").alias("scope"),
        F.when(in_project, F.when(project != "", project).otherwise(folder)).alias("scope_qualifier"),
        F.col("p.body").alias("content"),
        content_hash(F.col("p.body")).alias("content_hash"),
        F.col("kind").alias("source_kind"),
        dna_class(F.col("kind")).alias("dna_class"),
        F.when(kind_is_inferred(F.col("kind")), "inferred").otherwise("measured").alias("evidence_level"),
        "tags",
        F.col("created").alias("created_at"),
        F.coalesce("modified", "created").alias("updated_at"),
        registered.alias("registered_only"),
        F.when(registered, index_links(F.col("text"))).alias("links"),
        F.array_compact(
            F.array(
                F.when(F.col("text").isNull(), "invalid_utf8"),
                F.when(F.col("p.unclosed"), "frontmatter_unclosed"),
                F.when(in_project & (project == ""), "project_scope_relative_fallback"),
                F.when(F.col("permalink").isNotNull() & F.col("p.body").rlike(r"\[\[[^\]]+\]\]"), "relations_body_only"),
            )
        ).alias("anomalies"),
    )
