"""Schemas that drift between files: one fused schema, one table, every change reported.

Each valid line is read into paths with a tag for the JSON type of every value. The
tagged unions of lines fuse by bitwise or, first inside a task, then per file. Files
follow each other inside their feed; what vanishes and what appears between two
neighbours is compared by the values that shared records carry, joined on the value's
digest, so no pairs of paths or records are spelled out. Only lines of files where both
happened are read again, and only for the paths that moved.

``consistent_table`` splits paths of conflicting types into one typed branch per tag
plus a canonical text, under one name of renamed paths, in array elements too.

Defined results: invalid lines and JSON that isn't an object have no paths; files
without a valid line still count as files; null values don't count; lines delivered
twice count once; records without a key take no part in finding renames; null feed or
file numbers are left out, since nothing can be before or after them.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carryover.session import cut

# Tags of the JSON types.
TAGS = {"string": 1, "number": 2, "boolean": 4, "object": 8, "array": 16}
RECORD_KEYS = ("account_uuid", "id")


def _no_constant(name: str) -> None:
    raise ValueError(name)


def read_object(text: str | None) -> dict | None:
    """The object that ``text`` holds, or None."""
    try:
        value = json.loads(text, parse_constant=_no_constant) if text else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def tag(value: object) -> int:
    if isinstance(value, bool):
        return TAGS["boolean"]
    if isinstance(value, str):
        return TAGS["string"]
    if isinstance(value, dict):
        return TAGS["object"]
    return TAGS["array"] if isinstance(value, list) else TAGS["number"]


#: Tags beside those of the types: what decides the column type of a number.
FRACTION, PAST_DOUBLE, PAST_LONG = 32, 64, 128
#: Keys of an object that isn't a map, and columns a table may have.
MOST_KEYS, MOST_PATHS = 1000, 20_000


def wide_tag(value: object) -> int:
    """``tag``, and for numbers whether they are fractions or too large for a type."""
    bits = tag(value)
    if bits != TAGS["number"]:
        return bits
    if isinstance(value, float):
        return bits | (FRACTION if math.isfinite(value) else FRACTION | PAST_DOUBLE)
    if abs(value) > 2**53:
        bits |= PAST_DOUBLE
    return bits if -(2**63) <= value < 2**63 else bits | PAST_LONG


def number_type(tags: int) -> str:
    """The column type that holds all numbers of a path exactly: bigint, double, or their text."""
    if not tags & (FRACTION | PAST_LONG):
        return "bigint"
    return "double" if not tags & PAST_DOUBLE else "string"


def tagged_paths(record: dict, tag_of: Callable[[object], int] = tag) -> dict[str, list]:
    """path -> [tags, values in order] of all keys with a non-null value."""
    found: dict[str, list] = {}
    todo: list[tuple[str, object]] = [("", record)]
    while todo:
        at, node = todo.pop()
        if isinstance(node, list):
            todo += [(at + "[]", x) for x in reversed(node) if isinstance(x, dict | list)]
            continue
        below = []
        for k, v in node.items():
            if v is None:
                continue
            path = f"{at}.{k}" if at else k
            entry = found.setdefault(path, [0, []])
            entry[0] |= tag_of(v)
            entry[1].append(v)
            if isinstance(v, dict | list):
                below.append((path, v))
        todo += reversed(below)
    return found


def _digest(value: object) -> int:
    text = json.dumps(value, sort_keys=True, ensure_ascii=False).encode("utf-8", "surrogatepass")
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "big", signed=True)


def _record_key(record: dict, names: tuple[str, ...]) -> str | None:
    return next((str(record[n]) for n in names if record.get(n) is not None), None)


def _lines(df: DataFrame, feed: str, file: str, payload: str) -> DataFrame:
    return df.where(F.col(feed).isNotNull() & F.col(file).isNotNull()).select(F.col(feed).cast("bigint").alias("feed_id"), F.col(file).cast("bigint").alias("file_no"), F.col(payload).alias("payload"))


def file_paths(lines: DataFrame, wide: bool = False) -> DataFrame:
    """(feed_id, file_no, path, tags): the fused tagged union of each file; with ``wide_tag`` if asked for."""
    tag_of = wide_tag if wide else tag

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fused: dict[tuple, int] = {}
            for feed, file, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for path, (tags, _) in tagged_paths(read_object(text) or {}, tag_of).items():
                    fused[feed, file, path] = fused.get((feed, file, path), 0) | tags
            keys = list(zip(*fused, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(keys[0], pa.int64()), pa.array(keys[1], pa.int64()), pa.array(keys[2], pa.string()), pa.array(fused.values(), pa.int32())], names=["feed_id", "file_no", "path", "tags"])

    parts = lines.mapInArrow(run, "feed_id bigint, file_no bigint, path string, tags int")
    return parts.groupBy("feed_id", "file_no", "path").agg(F.bit_or("tags").alias("tags"))


def record_values(lines: DataFrame, wanted: DataFrame, names: tuple[str, ...] = RECORD_KEYS) -> DataFrame:
    """(feed_id, file_no, record, path, digest) of the keyed records of some files.

    ``wanted`` has (feed_id, file_no, paths): one row per file, what to look at there.
    Path '' is the record itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths: dict[tuple, set] = {}
        for batch in batches:
            rows: dict[tuple, None] = {}
            for n, (feed, file, text) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)):
                record = read_object(text)
                key = record and _record_key(record, names)
                if key is not None:
                    if (feed, file) not in paths:
                        paths[feed, file] = set(batch.column(3)[n].as_py())
                    asked = paths[feed, file]
                    rows[feed, file, key, "", 0] = None
                    for path, (_, values) in tagged_paths(record).items():
                        if path in asked:
                            rows[feed, file, key, path, _digest(values)] = None
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names=["feed_id", "file_no", "record", "path", "digest"])

    return lines.join(wanted, ["feed_id", "file_no"]).select("feed_id", "file_no", "payload", "paths").mapInArrow(run, "feed_id bigint, file_no bigint, record string, path string, digest bigint")


def schema_changes(df: DataFrame, feed: str, file: str, payload: str, names: tuple[str, ...] = RECORD_KEYS) -> DataFrame:
    """(feed_id, file_no, change, old_path, new_path) of each file against the one before it."""
    lines = _lines(df, feed, file, payload)
    paths = cut(file_paths(lines))  # one row per path and file; the payloads are read twice in all
    by_feed = Window.partitionBy("feed_id").orderBy("file_no")
    files = cut(lines.select("feed_id", "file_no").distinct().withColumn("following", F.lead("file_no").over(by_feed)).withColumn("before", F.lag("file_no").over(by_feed)))
    sides = F.array(F.struct(F.col("file_no").alias("pair"), F.col("before").isNotNull().alias("used"), F.lit(True).alias("new")), F.struct(F.col("following").alias("pair"), F.col("following").isNotNull().alias("used"), F.lit(False).alias("new")))

    def sided(rows: DataFrame) -> DataFrame:
        """Each row as part of its own file and as part of what the next file is compared with."""
        twice = rows.join(files, ["feed_id", "file_no"]).withColumn("_s", F.explode(sides)).where("_s.used")
        return twice.select("feed_id", F.col("_s.pair").alias("pair"), F.col("_s.new").alias("new"), *(c for c in rows.columns if c not in ("feed_id", "file_no"))).withColumnRenamed("pair", "file_no")

    tags = lambda side: F.max(F.when(F.col("new") == side, F.col("tags")))
    diff = sided(paths).groupBy("feed_id", "file_no", "path").agg(tags(False).alias("o"), tags(True).alias("w")).where(~F.col("o").eqNullSafe(F.col("w")))
    diff = cut(diff)
    moved = diff.where("o IS NULL OR w IS NULL")

    # records of both files: which vanished values turn up under an appeared path
    pairs = moved.groupBy("feed_id", "file_no").agg(F.count("o").alias("gone"), F.count("w").alias("come")).where("gone > 0 AND come > 0").select("feed_id", "file_no")
    looked_at = moved.join(pairs, ["feed_id", "file_no"], "left_semi").select("feed_id", "file_no", "path", F.col("o").isNull().alias("new")).union(pairs.select("feed_id", "file_no", F.lit(""), F.lit(True)))
    # back from the pair to the file on either side
    before = files.select("feed_id", "file_no", "before")
    place = moved.join(pairs, ["feed_id", "file_no"], "left_semi").join(before, ["feed_id", "file_no"])
    wanted = place.groupBy("feed_id", F.when(F.col("o").isNull(), F.col("file_no")).otherwise(F.col("before")).alias("file_no")).agg(F.collect_set("path").alias("paths"))
    values = cut(sided(record_values(lines, wanted, names)).join(looked_at, ["feed_id", "file_no", "path", "new"], "left_semi").distinct())
    records = values.where("new AND path = ''").select("feed_id", "file_no", "record")
    held = values.where("NOT new AND path <> ''").join(records, ["feed_id", "file_no", "record"], "left_semi").select("feed_id", "file_no", "record", F.col("path").alias("old_path"), "digest")
    carried = values.where("new AND path <> ''").select("feed_id", "file_no", "record", F.col("path").alias("new_path"), "digest")
    total = held.groupBy("feed_id", "file_no", "old_path").agg(F.count_distinct("record").alias("total"))
    matched = held.join(carried, ["feed_id", "file_no", "record", "digest"]).groupBy("feed_id", "file_no", "old_path", "new_path").agg(F.count_distinct("record").alias("matches"))
    likely = matched.join(total, ["feed_id", "file_no", "old_path"]).where("2 * matches > total").select("feed_id", "file_no", "old_path", "new_path", "matches")
    # the best new path of each old one, then the best old path of each new one: most matches, the same parent, by name
    parent = lambda c: F.regexp_extract(c, r"(?s)^(.*)\.[^.]*$", 1)
    best = lambda df, mine, other: df.withColumn("_n", F.row_number().over(Window.partitionBy("feed_id", "file_no", mine).orderBy(F.desc("matches"), F.desc("near"), other))).where("_n = 1").drop("_n")
    renamed = best(best(likely.withColumn("near", parent("old_path") == parent("new_path")), "old_path", "new_path"), "new_path", "old_path")

    left = lambda name: renamed.select("feed_id", "file_no", F.col(name).alias("path"), F.col("old_path").alias("r_old"), F.col("new_path").alias("r_new"))
    ends = left("old_path").unionByName(left("new_path"))
    told = diff.join(ends, ["feed_id", "file_no", "path"], "left")
    return (
        told.where("r_new IS NULL OR r_new = path")
        .select(
            "feed_id", "file_no",
            F.when(F.col("r_new").isNotNull(), "renamed").when(F.col("o").isNull(), "added").when(F.col("w").isNull(), "removed").otherwise("type_changed").alias("change"),
            F.when(F.col("r_new").isNotNull(), F.col("r_old")).when(F.col("o").isNull(), "").otherwise(F.col("path")).alias("old_path"),
            F.when(F.col("r_new").isNotNull(), F.col("r_new")).when(F.col("w").isNull(), "").otherwise(F.col("path")).alias("new_path"),
        )
    )


def fused_schema(df: DataFrame, family: str, feed: str, file: str, payload: str) -> DataFrame:
    """(family, path, types, files, first_file, last_file): the tagged union of each family."""
    paths = file_paths(_lines(df, feed, file, payload))
    families = df.select(F.col(feed).cast("bigint").alias("feed_id"), F.col(family).alias("family")).distinct()
    types = F.array_join(F.array_compact(F.array(*(F.when(F.col("tags").bitwiseAND(F.lit(v)) != 0, F.lit(k)) for k, v in TAGS.items()))), ",")
    return (
        paths.join(families, "feed_id").groupBy("family", "path")
        .agg(F.bit_or("tags").alias("tags"), F.count("*").alias("files"), F.min("file_no").alias("first_file"), F.max("file_no").alias("last_file"))
        .select("family", "path", types.alias("types"), "files", "first_file", "last_file")
    )


def table_schema(df: DataFrame, feed: str, file: str, payload: str, most_keys: int = MOST_KEYS) -> dict[str, int]:
    """path -> wide tags of all lines, for ``consistent_table``.

    An object with more than ``most_keys`` different keys is a map whose keys are data:
    it stays one path, tagged as an object, and what is below it isn't spelled out.
    """
    paths = file_paths(_lines(df, feed, file, payload), wide=True).groupBy("path").agg(F.bit_or("tags").alias("tags"))
    above = lambda c: F.regexp_extract(c, r"(?s)^(.*)\.[^.]*$", 1)
    maps = paths.groupBy(above("path").alias("map")).agg(F.count("*").alias("n")).where((F.col("n") > most_keys) & (F.col("map") != "")).select("map")
    steps = F.split("path", r"\.")
    chain = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "."))
    inside = paths.where(F.size(steps) > 1).select("path", F.explode(chain).alias("map")).join(maps, "map", "left_semi").select("path").distinct()
    rows = paths.join(inside, "path", "left_anti").limit(MOST_PATHS + 1).collect()
    if len(rows) > MOST_PATHS:
        raise ValueError(f"more than {MOST_PATHS} paths")
    return {r["path"]: r["tags"] for r in rows}


def consistent_table(df: DataFrame, renames: dict[str, str], schema: dict[str, int], keep: list[str], payload: str, by_feed: dict[int, dict[str, str]] | None = None, feed: str = "feed_id") -> DataFrame:
    """One row per valid line: ``keep``, then a column per object path of ``schema`` (path -> tags).

    ``renames`` maps old to newest names; ``by_feed``, of ``canonical_names``, maps the
    names of each feed instead, and a line that holds two names of one field keeps the
    second in the column of its own name. A path of one scalar type is a column of that
    type; otherwise it has a branch ``path__type`` per type and the canonical text
    ``path``. Numbers are bigint, double or text, whichever holds all of them exactly; an
    object none of whose keys are in ``schema`` is a column of JSON text. Column names that clash with ``keep`` get the prefix ``value_``, those that
    differ from another in case alone an underscore at the end. Arrays are
    JSON text whose objects are laid out in the same way, by paths inside the array.
    """
    own = by_feed is not None
    linked = {path for names in (by_feed or {}).values() for path in names}

    def target(path: str, names: dict[str, str] | None) -> str:
        if own:
            return (names or {}).get(path, path)
        while path in renames and renames[path] in schema and renames[path] != path:
            path = renames[path]
        return path

    newest: dict[str, int] = {}
    for path, tags in schema.items():
        into = {target(path, n) for n in by_feed.values()} | {path} if own and path in linked else {target(path, None)}
        for name in into:
            newest[name] = newest.get(name, 0) | tags
    arrow = {"string": pa.string(), "boolean": pa.bool_(), "bigint": pa.int64(), "double": pa.float64()}
    spark = lambda path, k: number_type(newest[path]) if k == "number" else "boolean" if k == "boolean" else "string"
    kinds_of = {path: [k for k, v in TAGS.items() if tags & v] for path, tags in newest.items()}
    parents = {p.rpartition(".")[0] for p in newest}
    spelled = {p.rpartition(".")[0] for p in schema}
    #: objects that are laid out as the paths below them
    laid = {path for path, kinds in kinds_of.items() if kinds == ["object"] and path in parents}
    canonical = {name for names in (by_feed or {}).values() for name in names.values()}
    label, used = {}, set()  # names that differ in case alone would clash in files
    for path in sorted(kinds_of, key=lambda p: (p in linked and p not in canonical, p)):
        if path not in laid and "[]" not in path:
            label[path] = f"value_{path}" if path in keep else path
            while label[path].lower() in used:
                label[path] += "_"
            used.add(label[path].lower())
    columns: list[tuple[str, str, str]] = []  # name, path, type or '' for the canonical text
    for path, kinds in sorted(kinds_of.items()):
        if path in laid or "[]" in path:
            continue
        name = label[path]
        columns += [(name, path, kinds[0])] if len(kinds) == 1 else [(name, path, ""), *((f"{name}__{k}", path, k) for k in kinds)]
    kept = df.select(*keep, *([F.col(feed).cast("bigint").alias("_feed")] if own else []), payload)
    names = [*keep, *(c[0] for c in columns)]
    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name not in (payload, "_feed")), *(f"`{n}` {spark(p, k)}" for n, p, k in columns)])
    text = lambda v: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, sort_keys=True)

    def flat(record: dict, at: str, named: dict[str, str] | None) -> dict[str, object]:
        """path -> value of an object at ``at``, under canonical names; arrays are laid out."""
        found, todo = [], [(at, record)]
        while todo:
            above, node = todo.pop()
            for k, v in node.items():
                if v is not None:
                    path = f"{above}.{k}" if above else k
                    found.append((path, v))
                    if isinstance(v, dict) and path in spelled:
                        todo.append((path, v))
        out: dict[str, object] = {}
        for path, v in sorted(found, key=lambda x: target(x[0], named) != x[0]):  # a field under its own name goes first
            name = target(path, named)
            v = laid_out(v, path, named) if isinstance(v, list) else v
            if name in out and path not in out:
                name = path
            out.setdefault(name, v)
        return out

    def laid_out(values: list, path: str, named: dict[str, str] | None) -> list:
        made = []
        for v in values:
            if isinstance(v, list):
                v = laid_out(v, path + "[]", named)
            elif isinstance(v, dict):
                cells: dict[str, object] = {}
                for name, x in flat(v, path + "[]", named).items():
                    inner = next((name[len(p) + 3 :] for p in (target(path, named), path) if name.startswith(p + "[].")), name)
                    kinds = kinds_of.get(name, [])
                    if len(kinds) > 1:
                        cells[inner] = text(x)
                        cells[f"{inner}__{next(k for k, b in TAGS.items() if b == tag(x))}"] = x
                    elif name not in laid or not x:
                        cells[inner] = x
                v = cells
            made.append(v)
        return made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = [], []
            feeds = batch.column(len(keep)).to_pylist() if own else [None] * batch.num_rows
            for n, line in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                record = read_object(line)
                if record is not None:
                    rows.append(flat(record, "", by_feed.get(feeds[n]) if own else None))
                    at.append(n)
            take = pa.array(at, pa.int64())
            made = []
            for _, path, kind in columns:
                cells = [r.get(path) for r in rows]
                if not kind:
                    made.append(pa.array([None if v is None else text(v) for v in cells], pa.string()))
                else:
                    bit = TAGS[kind]
                    cells = [v if v is not None and tag(v) == bit else None for v in cells]
                    made_of = {"double": float, "string": text}.get(spark(path, kind), lambda v: v)
                    made.append(pa.array([None if v is None else made_of(v) for v in cells], arrow[spark(path, kind)]))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in range(len(keep))), *made], names=names)

    return kept.mapInArrow(run, ddl)


def canonical_names(renames: list[tuple[int, str, str]]) -> dict[int, dict[str, str]]:
    """feed -> {path: canonical path} from all (feed, old path, new path).

    Names linked in any feed are one field. Its canonical path is the name most feeds
    start from, so that feeds which never renamed it hold it there too; a feed maps only
    the names that it linked itself.
    """
    head: dict[str, str] = {}

    def find(path: str) -> str:
        while head.setdefault(path, path) != path:
            path = head[path]
        return path

    starts: dict[str, int] = {}
    for _, old, new in renames:
        head[find(new)] = find(old)
        starts[old] = starts.get(old, 0) + 1
        starts[new] = starts.get(new, 0) - 1
    best: dict[str, str] = {}
    for path in sorted(starts, key=lambda p: (-starts[p], p)):
        best.setdefault(find(path), path)
    out: dict[int, dict[str, str]] = {}
    for feed, old, new in renames:
        out.setdefault(feed, {}).update({old: best[find(old)], new: best[find(new)]})
    return out


def acyclic(renames: dict[str, str]) -> dict[str, str]:
    """``renames`` without the links that would lead back (a name given up and taken again)."""
    out: dict[str, str] = {}
    for old, new in renames.items():
        at = new
        while at in out and at != old:
            at = out[at]
        if at != old:
            out[old] = new
    return out
