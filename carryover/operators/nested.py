"""Deeply nested records to flat tables that keep parent-child links.

``flatten_json`` reads JSON text with the streaming reader: each record becomes
path-value-ordinal triples, the triples are grouped by their repeated ancestor and each
group is pivoted, inside the record, into rows of one table. A record never leaves its
task, so nothing is shuffled whatever the depth. ``pivot`` gives one of those tables
its columns.

``flatten_typed`` takes nested columns the same way: only the leaves that are asked for
are read, written as JSON by the JVM, and parsed into triples like any other record.

Defined results: a null, empty or invalid document has no rows (``flatten_json`` keeps
an ``invalid`` root row when asked), an empty array has no children, a null element is a
child with no cells, repeated elements and repeated records are all kept, and a leaf
that clashes with a key column is prefixed with ``value_``, an output of
``flatten_json`` that clashes with the key with ``child_``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carryover.functions.jsonstream import pointer, triples

CELLS = T.MapType(T.StringType(), T.StringType())


def _tables(text: str) -> list[tuple]:
    """(table, row, parent row, position, kind, cells) of each object or array element."""
    rows: dict[tuple, list] = {}
    for t in triples(text):
        # the nearest repeated ancestor, the element itself included
        cut = next((k for k in range(len(t.path), 0, -1) if isinstance(t.path[k - 1], int)), 0)
        owner = t.path[:cut]
        row = rows.get(owner)
        if row is None:
            above = next((k for k in range(cut - 1, 0, -1) if isinstance(t.path[k - 1], int)), 0)
            table = pointer(tuple("*" if isinstance(p, int) else p for p in owner[:-1]))
            row = rows[owner] = [table if cut else None, pointer(owner), pointer(t.path[:above]) if cut else None, owner[-1] if cut else None, t.kind, []]
        if t.value is not None and t.kind != "null":
            row[5].append((pointer(t.path[cut:]), t.value))
    return [tuple(r) for r in rows.values()]


def flatten_json(df: DataFrame, key: str, column: str, roots: bool = False) -> DataFrame:
    """(key, table_path, row_pointer, parent_pointer, pos, kind, cells) of each array element.

    ``table_path`` is the JSON pointer of the array with ``*`` for positions,
    ``row_pointer`` that of the element, ``parent_pointer`` that of the enclosing
    element ('' for the record). ``cells`` maps leaf paths inside the element to their
    text. With ``roots`` each record also has a row of its own (``pos`` null), of kind
    ``invalid`` where it isn't JSON.
    """
    src = df.where(F.col(column).isNotNull()).select(F.col(key).alias("k"), F.col(column).alias("v"))
    fields = {"table_path": T.StringType(), "row_pointer": T.StringType(), "parent_pointer": T.StringType(), "pos": T.LongType(), "kind": T.StringType(), "cells": CELLS}
    schema = T.StructType([T.StructField(key, src.schema["k"].dataType), *(T.StructField(f"child_{n}" if n == key else n, t) for n, t in fields.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out, at = batch.column(0), [], []
            for n, text in enumerate(batch.column(1).to_pylist()):
                try:
                    rows = _tables(text)
                except ValueError:
                    rows = [(None, "", None, None, "invalid", [])] if roots else []
                for r in rows:
                    if roots or r[3] is not None:
                        out.append(r)
                        at.append(n)
            cols = list(zip(*out, strict=True)) if out else [()] * 6
            types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string())]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=[f.name for f in schema])

    return src.mapInArrow(run, schema)


def pivot(children: DataFrame, key: str, table_path: str, leaves: list[str]) -> DataFrame:
    """One child table of ``flatten_json`` with a column for each leaf pointer."""
    taken = {key, "row_pointer", "parent_pointer", "pos"}
    name = lambda leaf: (leaf.strip("/").replace("/", "_") or "value")
    return children.where(F.col("table_path") == table_path).select(
        key, "row_pointer", "parent_pointer", "pos",
        *(F.try_element_at("cells", F.lit(x)).alias(f"value_{name(x)}" if name(x) in taken else name(x)) for x in leaves),
    )


def repeated_ancestors(schema: T.StructType) -> dict[str, list[str]]:
    """Array column path -> scalar leaf paths below it, nested arrays apart ('' is the record)."""
    groups: dict[str, list[str]] = {"": []}

    def walk(kind: T.DataType, path: str, group: str) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, f"{path}.{f.name}" if path else f.name, group)
        elif isinstance(kind, T.ArrayType):
            groups[path] = []
            walk(kind.elementType, path, path)
        else:
            groups[group].append(path)

    walk(schema, "", "")
    return groups


def flatten_typed(df: DataFrame, key: str, array: str, leaves: dict[str, str], extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per element of ``array``: key, 0-based pos, and ``leaves`` (name -> path in the element).

    A null element is a row whose leaves are null; a null or empty array has none. Leaves
    that are arrays or structs come as JSON text. Leaves that clash are prefixed with
    ``value_``, the position with ``child_``.
    """
    place = "child_pos" if key == "pos" else "pos"
    kept = {k: v for k, v in (extra or {}).items() if k not in {key, place}}
    taken = {key, place, *kept}
    # one array per leaf, so that the scan reads no other, side by side again as elements
    column = lambda p: F.col(f"{array}.{p}" if p else array)
    kinds = [f.dataType.elementType for f in df.select(*(column(p).alias(f"l{n}") for n, p in enumerate(leaves.values()))).schema]
    atomic = [not isinstance(k, T.ArrayType | T.StructType | T.MapType) for k in kinds]
    cells = [column(p) if plain else F.transform(column(p), lambda x: F.to_json(F.struct(x.alias("v")))) for p, plain in zip(leaves.values(), atomic, strict=True)]
    source = df.select(F.struct(F.col(key).alias("k"), F.struct(F.lit(0), *(v.alias(k) for k, v in kept.items())).alias("x")).alias("_parent"), F.to_json(F.arrays_zip(*(c.alias(f"l{n}") for n, c in enumerate(cells)))).alias("_json"))
    rows = pivot(flatten_json(source, "_parent", "_json"), "_parent", "", [f"/l{n}" for n in range(len(cells))])
    back = lambda n: F.col(f"l{n}").cast(kinds[n]) if atomic[n] else F.regexp_extract(f"l{n}", r'(?s)\A\{"v":(.*)\}\z', 1)
    return rows.select(F.col("_parent.k").alias(key), *(F.col(f"_parent.x.{k}").alias(k) for k in kept), F.col("pos").alias(place), *((back(n) if atomic[n] else F.when(back(n) != "", back(n))).alias(f"value_{name}" if name in taken else name) for n, name in enumerate(leaves)))
