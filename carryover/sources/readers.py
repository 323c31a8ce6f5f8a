"""The readers of files: who claims which file, and the records, anomalies and counts each yields.

All readers work on an inventory (path, length, content) and give frames; a file is
looked at once per frame that is used. JSON is kept as VARIANT, so unknown fields stay
with their record in ``source_extra``. A damaged row becomes an anomaly and the run goes
on; a damaged file is an error that stops a plan.

Defined results: an empty inventory gives empty frames; a null body is an anomaly and no
record; rows that repeat an identity are all given and are refused later, by the plan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from carryover.canonical import record_type
from carryover.functions.identity import canonical_id, content_hash
from carryover.functions.text import KNOWN_KINDS, calendar_date, dna_class, fold_whitespace, front_matter, index_links, kind_is_inferred, rfc3339_text
from carryover.functions.yaml_subset import front_matter_json
from carryover.operators.coverage import json_leaves, preserved
from carryover.sinks import envelope
from carryover.sources.exports import PROMPT_LINE

# Names of files that tell a service.
CHAT_FILES = ["memory.json", "saved_memories.json", "memories.chatgpt.json"]
ADAPTER_VERSION, EXPORT_VERSION = "1", "unknown"

ANOMALY = "path string, code string, line bigint, field_path string"
COUNTS = "path string, registered_count bigint, deleted_count bigint"
UNAVAILABLE = "system string, layer string, reason string"


@dataclass
class Output:
    """What a reader gives: records of the canonical type beside path and fields, and what it has to tell."""

    records: DataFrame
    anomalies: DataFrame
    counts: DataFrame
    errors: DataFrame
    unavailable: DataFrame

    def __add__(self, other: Output) -> Output:
        pair = lambda name: getattr(self, name).unionByName(getattr(other, name))
        return Output(pair("records"), pair("anomalies"), pair("counts"), pair("errors"), pair("unavailable"))


def _empty(files: DataFrame, ddl: str | StructType) -> DataFrame:
    return files.sparkSession.createDataFrame([], ddl)


def text_of(files: DataFrame) -> DataFrame:
    """(path, text): null text where the bytes aren't UTF-8."""
    return files.select("path", F.when(F.is_valid_utf8("content"), F.decode("content", "UTF-8")).alias("text"))


def _has(x: Column, *names: str) -> Column:
    found = F.try_variant_get(x, f"$.{names[0]}", "variant").isNotNull()
    for n in names[1:]:
        found = found | F.try_variant_get(x, f"$.{n}", "variant").isNotNull()
    return found


def _kind(x: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(x, path, "variant"))


def _string(x: Column, path: str) -> Column:
    """The value at ``path`` if it is a string, else null."""
    return F.when(_kind(x, path) == "STRING", F.try_variant_get(x, path, "string"))


def _items(x: Column, path: str = "$") -> Column:
    return F.try_variant_get(x, path, "array<variant>")


def claims(files: DataFrame, control: str = ".control", home: bool = False) -> DataFrame:
    """(path, reader, layer, registered_only): at most one row per reader and file.

    Names that several services use are settled by the shape of the file, else by a file
    of one service in exactly the same folder. In a ``home``, index and log at the top are
    registered only.
    """
    names = files.where(~F.col("path").startswith(f"{control}/")).select("path", "content", F.regexp_extract("path", r"^(.*/)?[^/]*$", 1).alias("parent"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"))
    shared, note = F.col("name").isin("memories.json", "conversations.json"), F.col("path").endswith(".md") & ~F.col("path").endswith(".chatgpt.md")
    text = F.when((shared | note) & F.is_valid_utf8("content"), F.decode("content", "UTF-8"))
    seen = names.withColumn("text", text).drop("content").withColumn("v", F.when(shared, F.try_parse_json("text")))
    any_has = lambda *keys: F.coalesce(F.exists(_items(F.col("v")), lambda x: _has(x, *keys)), F.lit(False))
    account_keys = ("account_uuid", "memory_files", "conversations_memory", "project_memories")
    is_memories, is_talks = F.col("name") == "memories.json", F.col("name") == "conversations.json"
    prompts = F.col("path").endswith(".chatgpt.md")
    marker = F.col("name").isin([*CHAT_FILES, "user.json"]) | prompts
    seen = seen.withColumns({
        "chat_shape": is_memories & (F.coalesce(_has(F.col("v"), "memory"), F.lit(False)) | any_has("content", "text")),
        "account_shape": is_memories & (F.coalesce(_has(F.col("v"), *account_keys), F.lit(False)) | any_has(*account_keys)),
        "nothing": is_memories & F.coalesce(F.size(_items(F.col("v"))) == 0, F.lit(False)),
        "talk": F.when(is_talks & any_has("mapping"), "chat").when(is_talks & any_has("chat_messages", "messages"), "account"),
        "marker": marker, "front": F.try_parse_json(F.coalesce(front_matter_json(F.when(note, front_matter(F.col("text"))["front"]))["json"], F.lit("{}"))),
    }).withColumn("permalink", note & F.coalesce(_string(F.col("front"), "$.permalink").isNotNull() & ~_has(F.col("front"), envelope.MARK), F.lit(False)))
    sure = F.col("name").isin("projects.json", "users.json")
    beside = seen.groupBy("parent").agg(
        F.bool_or(F.col("marker")).alias("marked"), F.bool_or(F.col("marker") | F.col("chat_shape")).alias("chat"),
        F.count_if(sure | F.col("account_shape")).alias("accounts"), F.count_if(F.col("nothing")).alias("nothings"),
    )
    j = seen.join(beside, "parent")
    empty_account = F.col("nothing") & ~F.col("marked")
    account_near = (F.col("accounts") > 0) | ~F.col("marked") & (F.col("nothings") > 0)
    chat = (
        F.when(F.col("name").isin(CHAT_FILES), "saved_memory")
        .when(is_memories & (F.col("chat_shape") | F.col("chat")), "saved_memory")
        .when(prompts, "prompt_extract")
        .when(F.col("name") == "user.json", "instruction")
        .when(is_talks & (F.col("talk").eqNullSafe("chat") | F.col("chat")), "transcript")
    )
    account = (
        F.when(is_memories & (F.col("account_shape") | empty_account | account_near & ~F.col("chat_shape")), "saved_memory")
        .when(F.col("name") == "projects.json", "project_doc")
        .when(F.col("name") == "users.json", "account_metadata")
        .when(is_talks & (F.col("talk").eqNullSafe("account") | account_near & ~F.col("talk").eqNullSafe("chat")), "transcript")
    )
    index = F.col("name") == "MEMORY.md"
    if home:
        index = index | F.col("path").isin("index.md", "log.md")
    managed = F.coalesce(_has(F.col("front"), envelope.MARK), F.lit(False))
    markdown = F.when(note & ~F.col("permalink"), F.when(index, "index").when(managed, "managed").otherwise("memory"))
    linked = F.when(note & F.col("permalink"), "note").when(F.col("name") == "memory.db", "vector_index")
    row = lambda reader, layer: F.when(layer.isNotNull(), F.struct(F.lit(reader).alias("reader"), layer.alias("layer")))
    each = F.array_compact(F.array(row("chat", chat), row("account", account), row("markdown", markdown), row("notes", linked)))
    out = j.select("path", F.explode(each).alias("c")).select("path", "c.*")
    return out.withColumn("registered_only", F.col("layer").isin("transcript", "instruction", "account_metadata", "index", "vector_index"))


def _record(df: DataFrame, system: Column, satellite: str, ident: str, **columns: Column) -> DataFrame:
    """``df`` (path, locator, body, kind, fields, mapped, ...) as canonical records beside path and fields."""
    lit = F.lit
    made = {
        "source": F.struct(system.alias("system"), lit(ADAPTER_VERSION).alias("adapter_version"), lit(EXPORT_VERSION).alias("export_version"), lit(satellite or None).cast("string").alias("satellite_id")),
        "source_record_id": F.col(ident), "source_locator": F.col("locator"), "scope": lit("user"), "content": F.col("body"), "content_hash": content_hash(F.col("body")),
        "dna_class": dna_class(F.col("kind")), "source_kind": F.col("kind"), "canonical_id": canonical_id(system, lit(satellite), F.col(ident)), "evidence_level": lit("third_party"),
    }
    who = {"actor": F.concat(lit("process:"), system), "actor_kind": lit("import"), "method": lit("import"), "evidence": lit(None).cast("array<struct<source_ref:string,weight:double>>")} | {k: columns.pop(k) for k in ("actor", "actor_kind", "method", "evidence") if k in columns}
    made["provenance"] = F.struct(who["actor"].alias("actor"), who["actor_kind"].alias("actor_kind"), who["method"].alias("method"), F.col("locator").alias("source_ref"), who["evidence"].alias("evidence"))
    made |= columns
    # a kind that is missing or unknown makes the class a guess
    made["evidence_level"] = F.when(kind_is_inferred(F.col("kind")), "inferred").otherwise(made["evidence_level"])
    full = preserved(df.select("path", "fields", "mapped", *(c.alias(n) for n, c in made.items())), "fields", "mapped")
    made["source_extra"] = F.col("source_extra")
    return full.select("path", "fields", "mapped", *(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in made else F.lit(None).cast(f.dataType).alias(f.name) for f in record_type().fields))


def _anomalies(df: DataFrame, *cases: tuple[Column, str, str], line: Column | None = None, at: str = "locator") -> DataFrame:
    """One row per case (condition, code, field path) that holds."""
    each = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(code).alias("code"), F.lit(field).alias("field_path"))) for c, code, field in cases)))
    where = (line if line is not None else F.lit(None)).cast("bigint")
    return df.select(F.col(at).alias("path"), where.alias("line"), F.explode(each).alias("c")).select("path", "c.code", "line", "c.field_path")


def _errors(df: DataFrame, bad: Column, why: str) -> DataFrame:
    return df.where(F.coalesce(bad, F.lit(True))).select("path", F.lit(why).alias("error")).distinct()


def _mapped(*cases: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*(F.when(c, F.lit(p)) for c, p in cases)))


def _parsed(files: DataFrame) -> DataFrame:
    """(path, v): the JSON of each file, null where it isn't."""
    return text_of(files).select("path", F.try_parse_json("text").alias("v"))


def read_saved(files: DataFrame, satellite: str = "") -> Output:
    """Saved memories of a chat service: an array, or an object that holds it as ``memory``."""
    doc = _parsed(files).withColumn("bare", _items(F.col("v")).isNotNull()).withColumn("items", F.coalesce(_items(F.col("v")), _items(F.col("v"), "$.memory")))
    x = F.col("x")
    item = doc.select("path", "bare", F.posexplode("items").alias("pos", "x")).withColumn("locator", F.concat("path", F.lit("#"), F.when(F.col("bare"), "").otherwise("/memory"), F.lit("/"), F.col("pos").cast("string")))
    item = item.withColumns({"deleted": F.coalesce(F.try_variant_get(x, "$.deleted", "boolean"), F.lit(False)), "c": _string(x, "$.content"), "t": _string(x, "$.text"), "given": _string(x, "$.id")})
    kind_at = F.when(_has(x, "kind"), "/kind").otherwise("/type")
    conflict = F.col("c").isNotNull() & F.col("t").isNotNull() & (F.col("c") != F.col("t"))
    item = item.withColumns({"body": F.coalesce("c", "t"), "conflict": F.coalesce(conflict, F.lit(False)), "kind": F.when(_has(x, "kind"), _string(x, "$.kind")).otherwise(_string(x, "$.type")), "enabled": F.try_variant_get(x, "$.enabled", "boolean"), "created": rfc3339_text(F.try_variant_get(x, "$.created_at", "string")), "updated": rfc3339_text(F.try_variant_get(x, "$.updated_at", "string"))})
    live = item.where(~F.col("deleted"))
    kept = live.where("body IS NOT NULL AND NOT conflict").withColumns({
        "fields": F.to_json("x"), "ident": F.coalesce("given", content_hash(F.col("body"))),
        "mapped": _mapped((F.col("c").isNotNull(), "/content"), (F.col("t").isNotNull(), "/text"), (F.col("given").isNotNull(), "/id"), (F.col("kind").isNotNull() & (kind_at == "/kind"), "/kind"), (F.col("kind").isNotNull() & (kind_at == "/type"), "/type"), (F.col("enabled").isNotNull(), "/enabled"), (F.col("created").isNotNull(), "/created_at"), (F.col("updated").isNotNull(), "/updated_at")),
    })
    consent = F.when(F.col("enabled").isNotNull(), F.struct(F.lit(None).cast("boolean").alias("exportable"), F.lit(None).cast("string").alias("retention"), F.lit(None).cast("array<string>").alias("redact"), F.col("enabled").alias("memory_enabled")))
    records = _record(kept, F.lit("chat"), satellite, "ident", consent=consent, created_at=F.col("created"), updated_at=F.col("updated"))
    told = _anomalies(live, (F.col("body").isNull(), "missing_memory_content", "/text"), (F.col("conflict"), "conflicting_memory_content", "/content"))
    # what the envelope holds beside the memories belongs to no record
    rest = json_leaves(text_of(files), "path", "text").join(doc.where("NOT bare").select("path"), "path", "left_semi").where("leaf IS NOT NULL AND leaf <> '/memory'")
    told = told.unionByName(rest.select("path", F.lit("uncarried_export_field").alias("code"), F.lit(None).cast("bigint").alias("line"), F.col("leaf").alias("field_path")))
    counts = item.groupBy("path").agg(F.lit(0).cast("bigint").alias("registered_count"), F.count_if("deleted").alias("deleted_count"))
    bad_kind = live.where(~F.coalesce(F.when(_has(x, "kind"), _kind(x, "$.kind")).otherwise(_kind(x, "$.type")).isin("STRING", "VOID"), F.lit(True)))
    return Output(records, told, counts, _errors(doc, F.col("items").isNull(), "no array of memories").unionByName(_errors(bad_kind, F.lit(True), "a kind is no text")), _empty(files, UNAVAILABLE))


def read_prompts(files: DataFrame, satellite: str = "") -> Output:
    """Lines ``[date] [kind] content`` of prompt logs; the first of equal lines, by path and place, is the record."""
    text = text_of(files)
    lines = text.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("n", "raw")).select("path", (F.col("n") + 1).cast("bigint").alias("n"), F.regexp_replace("raw", r"^\s+|\s+$", "").alias("line"))
    lines = lines.where((F.col("line") != "") & ~F.col("line").startswith("```"))
    # one pass lays date, kind and content out; what doesn't fit keeps no mark
    laid = F.split(F.regexp_replace("line", PROMPT_LINE, "\u0001$1\u0001$2\u0001$3"), "\u0001", 4)
    part = lambda k: F.when(F.size(laid) == 4, F.get(laid, F.lit(k)))
    parsed = lines.select("path", "n", F.trim(part(1)).alias("day"), F.trim(part(2)).alias("kind"), part(3).alias("body"))
    good, nul = parsed.where("body IS NOT NULL"), F.lit("\0")
    good = good.withColumns({"ident": content_hash(F.concat("day", nul, "kind", nul, fold_whitespace(F.col("body")))), "locator": F.concat("path", F.lit(":"), F.col("n").cast("string"))})
    # the places of first lines; a line that much of the logs repeat shrinks before it travels
    first = good.groupBy("ident").agg(F.min(F.struct("path", "n")).alias("f"))
    j = good.join(first, "ident").withColumn("copy", (F.col("f.path") != F.col("path")) | (F.col("f.n") != F.col("n")))
    kept = j.where("NOT copy").withColumns({"fields": F.to_json(F.struct(F.col("day").alias("date"), "kind", F.col("body").alias("content"))), "mapped": F.array(F.lit("/content"), F.lit("/kind"))})
    records = _record(kept, F.lit("chat"), satellite, "ident", method=F.lit("prompt_extract"))
    told = parsed.where("body IS NULL").select("path", F.lit("invalid_prompt_line").alias("code"), F.col("n").alias("line"), F.lit("").alias("field_path"))
    told = told.unionByName(_anomalies(j.where("copy"), (F.lit(True), "duplicate_prompt_line", ""), line=F.col("n"), at="path"))
    told = told.unionByName(_anomalies(kept, (~F.col("kind").isin(KNOWN_KINDS), "unknown_source_kind", "/kind"), ((F.col("day") != "unknown") & ~calendar_date(F.col("day")), "invalid_prompt_date", "/date"), line=F.col("n")))
    return Output(records, told, _empty(files, COUNTS), _errors(text, F.col("text").isNull(), "not UTF-8"), _empty(files, UNAVAILABLE))


def read_accounts(files: DataFrame, satellite: str = "") -> Output:
    """Memory files of account exports; older fields are records only where an account has no list of files."""
    doc = _parsed(files)
    x, f = F.col("x"), F.col("f")
    account = doc.withColumn("items", _items(F.col("v"))).select("path", F.posexplode("items").alias("n", "x")).withColumns({"given": _string(F.col("x"), "$.account_uuid"), "listed": _has(F.col("x"), "memory_files"), "at": F.concat("path", F.lit("#/"), F.col("n").cast("string"))})
    owner = F.coalesce("given", F.lit("unknown_account"))
    meta = F.to_json(F.struct(F.col("given").alias("account_uuid")))
    each = account.select("*", F.posexplode(_items(x, "$.memory_files")).alias("pos", "f")).withColumns({"locator": F.concat("at", F.lit("/memory_files/"), F.col("pos").cast("string")), "place": _string(f, "$.path"), "body": _string(f, "$.content"), "updated": rfc3339_text(F.try_variant_get(f, "$.updated_at", "string"))})
    each = each.withColumn("p", front_matter(F.col("body")))
    front = front_matter_json(F.col("p.front"))["json"]
    each = each.withColumn("kind", F.coalesce(_string(f, "$.type"), F.when(~_has(f, "type"), F.get_json_object(front, "$.type"))))
    whole = F.col("place").isNotNull() & F.col("body").isNotNull()
    kept = each.where(whole).withColumns({
        "ident": F.concat(owner, F.lit(":"), "place"), "fields": F.concat(F.lit('{"file":'), F.to_json("f"), F.lit(',"account":'), meta, F.lit("}")),
        "mapped": _mapped((F.lit(True), "/file/content"), (F.lit(True), "/file/path"), (F.col("given").isNotNull(), "/account/account_uuid"), (_has(f, "type"), "/file/type"), (F.col("updated").isNotNull(), "/file/updated_at")),
    })
    records = _record(kept, F.lit("account"), satellite, "ident", updated_at=F.col("updated"), owner_declared=F.col("given"))
    told = _anomalies(each, (~F.coalesce(whole, F.lit(False)), "invalid_memory_file", ""), (F.coalesce(F.col("p.unclosed"), F.lit(False)), "frontmatter_unclosed", "/file/content"))
    legacy = _has(x, "conversations_memory", "project_memories")
    told = told.unionByName(_anomalies(account.withColumn("locator", F.col("at")), (F.col("listed") & legacy, "legacy_memory_fields_not_reimported", "")))
    old = account.where(~F.col("listed"))
    talk = old.withColumns({"body": _string(x, "$.conversations_memory"), "locator": F.concat("at", F.lit("/conversations_memory")), "ident": F.concat(owner, F.lit(":conversations")), "kind": F.lit(None).cast("string"), "fields": meta, "mapped": F.array(F.lit("/account_uuid"))}).where("body IS NOT NULL")
    project = old.select("*", F.explode(F.try_variant_get(x, "$.project_memories", "map<string,variant>")).alias("name", "pv")).withColumns({"body": _string(F.col("pv"), "$"), "locator": F.concat("at", F.lit("/project_memories/"), "name"), "ident": F.concat(owner, F.lit(":project:"), "name"), "kind": F.lit(None).cast("string"), "fields": meta, "mapped": F.array(F.lit("/account_uuid"))})
    records = records.unionByName(_record(talk, F.lit("account"), satellite, "ident")).unionByName(_record(project.where("body IS NOT NULL"), F.lit("account"), satellite, "ident", scope=F.lit("project"), scope_qualifier=F.col("name")))
    told = told.unionByName(_anomalies(project, (F.col("body").isNull(), "invalid_project_memory", "")))
    return Output(records, told, _empty(files, COUNTS), _errors(doc, _items(F.col("v")).isNull(), "no array of accounts"), _empty(files, UNAVAILABLE))


def read_project_files(files: DataFrame, satellite: str = "") -> Output:
    """Documents of projects, and instructions from templates that aren't blank."""
    doc = _parsed(files)
    x, y = F.col("x"), F.col("y")
    project = doc.select("path", F.posexplode(_items(F.col("v"))).alias("n", "x")).withColumns({"at": F.concat("path", F.lit("#/"), F.col("n").cast("string")), "name": _string(F.col("x"), "$.name")})
    project = project.withColumn("pid", F.coalesce(_string(x, "$.uuid"), content_hash(F.coalesce("name", F.lit("unknown")))))
    meta = F.to_json(F.struct(F.col("pid").alias("uuid"), "name"))
    each = project.select("*", F.posexplode(_items(x, "$.docs")).alias("pos", "y")).withColumns({"locator": F.concat("at", F.lit("/docs/"), F.col("pos").cast("string")), "body": _string(y, "$.content"), "kind": _string(y, "$.type")})
    kept = each.where("body IS NOT NULL").withColumns({
        "ident": F.coalesce(_string(y, "$.uuid"), F.concat("pid", F.lit("/"), F.coalesce(_string(y, "$.filename"), content_hash(F.col("body"))))), "fields": F.concat(F.lit('{"doc":'), F.to_json("y"), F.lit(',"project":'), meta, F.lit("}")),
        "mapped": F.array(F.lit("/doc/content"), F.lit("/doc/uuid"), F.lit("/project/uuid")),
    })
    rules = project.withColumns({"body": _string(x, "$.prompt_template"), "locator": F.concat("at", F.lit("/prompt_template")), "ident": F.concat("pid", F.lit("#instructions")), "kind": F.lit("instruction"), "fields": meta, "mapped": F.array(F.lit("/uuid"))}).where(F.col("body").rlike(r"\S"))
    in_project = {"scope": F.lit("project"), "scope_qualifier": F.col("pid")}
    records = _record(kept, F.lit("account"), satellite, "ident", **in_project).unionByName(_record(rules, F.lit("account"), satellite, "ident", **in_project))
    bad = project.where(~F.coalesce(_kind(x, "$.prompt_template").isin("STRING", "VOID"), F.lit(True)))
    return Output(records, _anomalies(each, (F.col("body").isNull(), "missing_project_content", "/content")), _empty(files, COUNTS), _errors(doc, _items(F.col("v")).isNull(), "no array of projects").unionByName(_errors(bad, F.lit(True), "a template is no text")), _empty(files, UNAVAILABLE))


def read_registered(files: DataFrame, layer: str) -> Output:
    """Files that are counted and never read into records: transcripts, user data, indexes, vector stores."""
    none = Output(_no_records(files), _empty(files, ANOMALY), _empty(files, COUNTS), _empty(files, "path string, error string"), _empty(files, UNAVAILABLE))
    zero = F.lit(0).cast("bigint").alias("deleted_count")
    if layer == "index":
        none.counts = text_of(files).select("path", F.coalesce(index_links(F.col("text")), F.lit(0)).cast("bigint").alias("registered_count"), zero)
    elif layer == "vector_index":
        none.anomalies = files.select("path", F.lit("derived_vector_index_not_migrated").alias("code"), F.lit(None).cast("bigint").alias("line"), F.lit("").alias("field_path"))
    elif layer == "transcript":
        doc = _parsed(files)
        shaped = F.forall(_items(F.col("v")), lambda t: _has(t, "mapping", "chat_messages", "messages"))
        none.counts = doc.select("path", F.coalesce(F.size(_items(F.col("v"))), F.lit(0)).cast("bigint").alias("registered_count"), zero)
        none.errors = _errors(doc, ~F.coalesce(shaped, F.lit(False)), "no array of conversations")
    else:
        none.counts = files.select("path", F.lit(1).cast("bigint").alias("registered_count"), zero)
        none.unavailable = files.select(F.lit("chat" if layer == "instruction" else "account").alias("system"), F.lit(layer).alias("layer"), F.lit("The place of these fields isn't verified; the file is registered, not read.").alias("reason")).distinct()
    return none


def _no_records(files: DataFrame) -> DataFrame:
    own = StructType([StructField("path", StringType()), StructField("fields", StringType()), StructField("mapped", ArrayType(StringType()))])
    return _empty(files, StructType(own.fields + record_type().fields))


def read_markdown(files: DataFrame, satellite: str = "", linked: bool = False) -> Output:
    """Notes with front matter; ``linked``: notes of a vault that are known by their permalink."""
    doc = text_of(files).withColumn("p", front_matter(F.col("text"))).withColumn("y", front_matter_json(F.col("p.front")))
    doc = doc.withColumns({"locator": F.col("path"), "body": F.col("p.body"), "v": F.try_parse_json(F.coalesce("y.json", F.lit("{}")))})
    v = F.col("v")
    in_project = F.coalesce(_string(v, "$.metadata.node_type") == "memory", F.lit(False)) if not linked else F.lit(False)
    slug, parent = F.regexp_extract("path", r"(?:^|/)projects/([^/]+)/memory/[^/]", 1), F.regexp_extract("path", r"^(?:(.*)/)?[^/]*$", 1)
    near = F.when(slug != "", slug).otherwise(parent)
    qualifier = F.when(in_project, F.concat_ws("/", F.lit(satellite or None), F.when(near != "", near)) if satellite else near)
    session = _string(v, "$.metadata.originSessionId")
    kind_at = F.when(in_project, "/frontmatter/metadata/type").otherwise("/frontmatter/type")
    kind = F.when(in_project, _string(v, "$.metadata.type")).otherwise(_string(v, "$.type"))
    kind_type = F.when(in_project, _kind(v, "$.metadata.type")).otherwise(_kind(v, "$.type"))
    stamp = lambda path: rfc3339_text(F.try_variant_get(v, path, "string"))
    updated = F.coalesce(stamp("$.modified"), stamp("$.created")) if linked else F.when(in_project, stamp("$.metadata.modified")).otherwise(stamp("$.updated_at"))
    tags = F.when(_kind(v, "$.tags") == "ARRAY<STRING>", F.try_variant_get(v, "$.tags", "array<string>")).when(_kind(v, "$.tags") == "STRING", F.array(F.try_variant_get(v, "$.tags", "string")))
    doc = doc.withColumns({"kind": kind, "tag_list": tags, "updated": updated, "ident": _string(v, "$.permalink") if linked else F.col("path"), "in_project": in_project, "qualifier": qualifier, "session": F.when(in_project, session)})
    when_at = F.when(stamp("$.modified").isNotNull(), "/frontmatter/modified").otherwise("/frontmatter/created") if linked else F.when(in_project, "/frontmatter/metadata/modified").otherwise("/frontmatter/updated_at")
    doc = doc.withColumns({
        "fields": F.concat(F.lit('{"body":'), F.regexp_extract(F.to_json(F.struct(F.col("body").alias("b"))), r'(?s)^\{"b":(.*)\}$', 1), F.lit(',"frontmatter":'), F.coalesce("y.json", F.lit("{}")), F.lit("}")),
        "mapped": F.array_compact(F.array(F.lit("/body"), F.when(F.col("kind").isNotNull(), kind_at), F.when(F.col("tag_list").isNotNull(), "/frontmatter/tags"), F.when(F.col("updated").isNotNull(), when_at), F.when(F.col("in_project"), "/frontmatter/metadata/node_type"), F.when(F.col("session").isNotNull(), "/frontmatter/metadata/originSessionId"), F.when(F.lit(linked), "/frontmatter/permalink"))),
    })
    whole = doc.where("text IS NOT NULL AND ident IS NOT NULL")
    evidence = F.when(F.col("session").isNotNull(), F.array(F.struct(F.concat(F.lit("session:"), "session").alias("source_ref"), F.lit(None).cast("double").alias("weight"))))
    system = F.lit("notes") if linked else F.when(F.col("in_project"), "project_memory").otherwise("markdown")
    records = _record(
        whole, system, satellite, "ident", actor=F.lit("process:filesystem"), actor_kind=F.lit("scan"), method=F.lit("filesystem"), evidence=evidence, evidence_level=F.lit("measured"), tags=F.col("tag_list"), updated_at=F.col("updated"),
        scope=F.when(F.col("in_project"), "project").otherwise("user"), scope_qualifier=F.col("qualifier"),
    )
    told = _anomalies(doc, (F.coalesce(F.col("p.unclosed"), F.lit(False)), "frontmatter_unclosed", ""), (F.col("in_project") & (slug == ""), "project_scope_relative_fallback", "/scope_qualifier"), (F.lit(linked) & F.coalesce(F.col("body").rlike(r"\[\[[^\]]+\]\]"), F.lit(False)), "relations_body_only", "/body"))
    errors = _errors(doc, F.col("text").isNull(), "not UTF-8").unionByName(_errors(doc.where("y.error IS NOT NULL"), F.lit(True), "front matter can't be read")).unionByName(_errors(doc.where(~F.coalesce(kind_type.isin("STRING", "VOID"), F.lit(True))), F.lit(True), "a kind is no text"))
    return Output(records, told, _empty(files, COUNTS), errors, _empty(files, UNAVAILABLE))


def read_managed(files: DataFrame, satellite: str = "") -> Output:
    """Notes that hold a whole record: it is restored with its own identity, and what owners edited is adopted and told."""
    notes = envelope.restored(files)
    kinds = {f.name: f.dataType for f in record_type().fields}
    whole = notes.where("canonical_id IS NOT NULL").select("path", F.lit("{}").alias("fields"), F.array().cast("array<string>").alias("mapped"), *(F.col(c).cast(t).alias(c) for c, t in kinds.items()))
    return Output(whole, envelope.edit_anomalies(notes), _empty(files, COUNTS), _errors(notes, F.col("classification").isNotNull(), "a managed note is damaged"), _empty(files, UNAVAILABLE))


READERS = {
    ("markdown", "managed"): read_managed,
    ("chat", "saved_memory"): read_saved, ("chat", "prompt_extract"): read_prompts, ("account", "saved_memory"): read_accounts, ("account", "project_doc"): read_project_files,
    ("markdown", "memory"): read_markdown, ("notes", "note"): lambda files, satellite: read_markdown(files, satellite, linked=True),
}
EXPORT_BUNDLES = {"chat", "account"}
