"""Exports of chat services, held in tables, as records.

One record per item with its native id, content hash and the anomaly that a reader
tells about instead of failing. Row-level damage never stops a run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carryover.functions.identity import content_hash
from carryover.functions.text import calendar_date, fold_whitespace


def saved_memories(df: DataFrame) -> DataFrame:
    """Saved memories: the body is ``content``, else ``text``; deleted ones are left out.

    Adds source_record_id (the id, else the body's hash), body, content_hash,
    memory_enabled (null counts as enabled) and anomaly.
    """
    body = F.coalesce("content", "text")
    anomaly = F.when(body.isNull(), "missing_memory_content").when(F.col("content") != F.col("text"), "conflicting_memory_content")
    return df.where(~F.coalesce("deleted", F.lit(False))).withColumns(
        {"body": body, "content_hash": content_hash(body), "source_record_id": F.coalesce("id", content_hash(body)), "memory_enabled": F.coalesce("enabled", F.lit(True)), "anomaly": anomaly}
    )


def account_memories(df: DataFrame) -> DataFrame:
    """Memory files of account exports; older fields are records only where there is no file list."""
    account = F.coalesce("account_uuid", F.lit("unknown_account"))
    row = lambda d, rid, part, pos, body, anomaly: d.select("export_no", rid.alias("source_record_id"), F.lit(part).alias("part"), pos.cast("bigint").alias("pos"), content_hash(body).alias("content_hash"), anomaly.alias("anomaly"))
    files = df.select("export_no", "account_uuid", F.posexplode("memory_files").alias("pos", "f"))
    bad = F.when(F.col("f.path").isNull() | F.col("f.content").isNull(), "invalid_memory_file")
    told = F.when(F.col("memory_files").isNotNull(), "legacy_memory_fields_not_reimported")
    older = df.where("conversations_memory IS NOT NULL")
    projects = df.select("export_no", "account_uuid", "memory_files", F.explode("project_memories").alias("project", "body"))
    return (
        row(files, F.concat(account, F.lit(":"), F.coalesce("f.path", F.concat(F.lit("#"), F.col("pos").cast("string")))), "memory_file", F.col("pos"), F.col("f.content"), bad)
        .unionByName(row(older, F.concat(account, F.lit(":conversations")), "conversations", F.lit(0), F.col("conversations_memory"), told))
        .unionByName(row(projects, F.concat(account, F.lit(":project:"), "project"), "project", F.lit(0), F.col("body"), F.coalesce(told, F.when(F.col("body").isNull(), "invalid_project_memory"))))
    )


def project_records(df: DataFrame) -> DataFrame:
    """Documents of projects, and a record of instructions for each template that isn't blank."""
    docs = df.select("project_no", "uuid", F.posexplode("docs").alias("pos", "x"))
    made = docs.select(
        "project_no", F.coalesce("x.uuid", F.concat(F.coalesce("uuid", F.lit("")), F.lit("/"), F.coalesce("x.filename", F.lit("")))).alias("source_record_id"), F.lit("document").alias("part"), F.col("pos").cast("bigint").alias("pos"),
        F.lit("standard").alias("dna_class"), content_hash(F.col("x.content")).alias("content_hash"), F.when(F.col("x.content").isNull(), "missing_project_content").alias("anomaly"),
    )
    rules = df.where(F.col("prompt_template").rlike(r"\S")).select(
        "project_no", F.concat(F.coalesce("uuid", F.lit("")), F.lit("#instructions")).alias("source_record_id"), F.lit("instructions").alias("part"), F.lit(0).cast("bigint").alias("pos"),
        F.lit("dna").alias("dna_class"), content_hash(F.col("prompt_template")).alias("content_hash"), F.lit(None).cast("string").alias("anomaly"),
    )
    return made.unionByName(rules)


PROMPT_LINE = r"^\[([^\]]+)\]\s+\[([^\]]+)\]\s+(.+)$"


def prompt_lines(df: DataFrame, order: str, line: str) -> DataFrame:
    """Lines ``[date] [kind] content``: (day, kind, body, anomaly) beside the columns of ``df``.

    The first of equal lines by ``order`` wins, whatever the spaces inside them; a group of
    equal lines of any size is found by one aggregate, not by sorting it.
    """
    # one pass lays the parts out behind marks; a line that doesn't fit has none
    laid = F.split(F.regexp_replace(line, PROMPT_LINE, "\u0001$1\u0001$2\u0001$3"), "\u0001", 4)
    part = lambda k: F.when(F.size("_laid") == 4, F.get("_laid", F.lit(k)))
    nul = F.lit("\0")
    # a generator keeps the parts apart, so that a line isn't parsed again for each of them
    parsed = df.select("*", F.explode(F.array(laid)).alias("_laid")).withColumns({"day": F.trim(part(1)), "kind": F.trim(part(2)), "body": F.trim(part(3))})
    parsed = parsed.withColumn("identity", F.sha2(F.concat("day", nul, "kind", nul, fold_whitespace(F.col("body"))), 256))
    good = parsed.where("identity IS NOT NULL")
    first = good.groupBy("identity").agg(F.min(order).alias("_first"))
    anomaly = F.when(F.col(order) != F.col("_first"), "duplicate_prompt_line").when((F.col("day") != "unknown") & ~calendar_date(F.col("day")), "invalid_prompt_date")
    none = F.lit(None).cast("string")
    told = good.join(first, "identity").select(*df.columns, "day", "kind", "body", anomaly.alias("anomaly"))
    # lines that don't fit have no identity and stay out of the join
    return told.unionByName(parsed.where("identity IS NULL").select(*df.columns, none.alias("day"), none.alias("kind"), none.alias("body"), F.lit("invalid_prompt_line").alias("anomaly")))


def source_shape(names: DataFrame, path: str) -> DataFrame:
    """Which reader a file belongs to by its name, with evidence from files beside it.

    Adds parent, claim (``saved_memories``, ``prompt_log``, ``account_export``,
    ``markdown``, ``ambiguous`` or null). An ambiguous name is settled by a file of one
    service in the same folder, through a semi join on the folder.
    """
    base = names.withColumns({"parent": F.regexp_extract(path, r"^(.*/)?[^/]*$", 1), "name": F.regexp_extract(path, r"([^/]*)$", 1)})
    own = (
        F.when(F.col("name").isin("memory.json", "saved_memories.json", "memories.chatgpt.json", "user.json"), "saved_memories")
        .when(F.col("name").endswith(".chatgpt.md"), "prompt_log")
        .when(F.col("name").isin("projects.json", "users.json"), "account_export")
        .when(F.col("name").isin("memories.json", "conversations.json"), "ambiguous")
        .when(F.lower("name").endswith(".md"), "markdown")
    )
    claimed = base.withColumn("own", own)
    folder = claimed.where(F.col("own").isin("saved_memories", "prompt_log", "account_export")).groupBy("parent").agg(F.bool_or(F.col("own") != "account_export").alias("_chat"), F.bool_or(F.col("own") == "account_export").alias("_account"))
    joined = claimed.join(folder, "parent", "left")
    settled = F.when(F.col("own") != "ambiguous", F.col("own")).when(F.col("own").isNull(), F.col("own")).when(F.col("_chat") & ~F.col("_account"), "saved_memories").when(F.col("_account") & ~F.col("_chat"), "account_export").otherwise("ambiguous")
    return joined.withColumn("claim", settled).drop("own", "name", "_chat", "_account")


def claims_twice(claims: DataFrame, path: str, reader: str) -> DataFrame:
    """Paths that more than one reader claims; a run must refuse them."""
    return claims.groupBy(path).agg(F.count_distinct(reader).alias("n")).where("n > 1")


MEMORY_ITEM = "struct<id:string,content:string,text:string,kind:string,type:string,enabled:boolean,deleted:boolean,created_at:string,updated_at:string>"
ACCOUNT = "struct<account_uuid:string,memory_files:array<struct<path:string,content:string,type:string,updated_at:string>>,conversations_memory:string,project_memories:map<string,string>>"
PROJECT = "struct<uuid:string,name:string,docs:array<struct<uuid:string,filename:string,content:string>>,prompt_template:string>"


def _documents(files: DataFrame, item: str, envelope: str | None) -> DataFrame:
    """(path, pos, x): the items of JSON files that hold an array, or an object with the array ``envelope``."""
    text = F.when(F.is_valid_utf8("content"), F.decode("content", "UTF-8"))
    listed = F.from_json("t", f"array<{item}>")
    if envelope:
        listed = F.when(F.ltrim("t").startswith("{"), F.from_json("t", f"struct<{envelope}:array<{item}>>")[envelope]).otherwise(listed)
    return files.select("path", text.alias("t")).select("path", F.posexplode(listed).alias("pos", "x"))


def read_saved_memories(files: DataFrame) -> DataFrame:
    """Records of saved-memory files of an inventory (a bare array, or ``{"memory": [...]}``)."""
    return saved_memories(_documents(files, MEMORY_ITEM, "memory").select("path", "pos", "x.*"))


def read_account_exports(files: DataFrame) -> DataFrame:
    """Records of account-memory files of an inventory; ``export_no`` is the place in the file."""
    return account_memories(_documents(files, ACCOUNT, None).select(F.col("pos").alias("export_no"), "x.*"))


def read_projects(files: DataFrame) -> DataFrame:
    """Records of project files of an inventory; ``project_no`` is the place in the file."""
    return project_records(_documents(files, PROJECT, None).select(F.col("pos").alias("project_no"), "x.*"))


def read_prompt_logs(files: DataFrame) -> DataFrame:
    """Prompt lines of log files; files in order of path, lines in order of place."""
    text = F.when(F.is_valid_utf8("content"), F.decode("content", "UTF-8"))
    lines = files.select("path", F.posexplode(F.split(text, r"\r?\n")).alias("n", "line")).withColumn("line", F.trim("line"))
    kept = lines.where((F.col("line") != "") & ~F.col("line").startswith("```"))
    return prompt_lines(kept.withColumn("place", F.struct("path", "n")), "place", "line").withColumns({"line_no": F.col("n") + 1}).drop("n", "place")


def transcript_counts(files: DataFrame) -> DataFrame:
    """(path, conversations, valid): files of conversations are registered and counted, their turns never read."""
    text = F.when(F.is_valid_utf8("content"), F.decode("content", "UTF-8"))
    shells = F.from_json("t", "array<struct<mapping:map<string,string>,chat_messages:array<string>>>")
    return files.select("path", text.alias("t")).select("path", F.coalesce(F.size(shells), F.lit(0)).cast("bigint").alias("conversations"), F.coalesce(shells.isNotNull() & ~F.exists(shells, lambda x: x["mapping"].isNull() & x["chat_messages"].isNull()), F.lit(False)).alias("valid"))
