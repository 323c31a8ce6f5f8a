"""Field coverage: every leaf of a source record is mapped, or told about."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carryover.functions.jsonstream import pointer, triples


def json_leaves(df: DataFrame, key: str, column: str, arrays_whole: bool = True) -> DataFrame:
    """(key, leaf, value): each scalar leaf of a JSON text by its pointer.

    With ``arrays_whole`` an array is one leaf; its value is null. Empty objects are
    leaves too. Texts that aren't JSON have the single leaf null.
    """
    src = df.where(F.col(column).isNotNull()).select(F.col(key).alias("k"), F.col(column).alias("v"))
    ddl = f"`{key}` {src.schema['k'].dataType.simpleString()}, leaf string, value string"

    def leaves(text: str) -> list[tuple[str | None, str | None]]:
        try:
            nodes = triples(text)
        except ValueError:
            return [(None, None)]
        out, parents = [], {t.path[:-1] for t in nodes if t.path}
        for t in nodes:
            if arrays_whole and t.ordinals:
                continue
            if t.kind == "array" and (arrays_whole or t.path not in parents) or t.kind == "object" and t.path not in parents or t.value is not None:
                out.append((pointer(t.path), t.value))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for n, text in enumerate(batch.column(1).to_pylist()):
                found = leaves(text)
                rows += found
                at += [n] * len(found)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=[key, "leaf", "value"])

    return src.mapInArrow(run, ddl)


def unreported(leaves: DataFrame, mapped: DataFrame, key: str) -> DataFrame:
    """Leaves that no mapped path of the same record equals or contains.

    ``mapped`` has (key, path). Each leaf is spelled out as its chain of ancestors and
    joined by equality, so the plan is a hash join and no prefix comparison of all
    with all.
    """
    parts = F.split("leaf", "/")
    chain = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    known = leaves.where("leaf IS NOT NULL").withColumn("path", F.explode(chain)).join(mapped.select(key, "path").distinct(), [key, "path"], "left_semi").select(key, "leaf").distinct()
    return leaves.where("leaf IS NOT NULL").join(known, [key, "leaf"], "left_anti")


def without_mapped(text: str | None, mapped: list[str] | None) -> str | None:
    """The JSON object less the pointers that were mapped; null where nothing is left or it isn't an object."""
    if text is None:
        return None
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return None
    if not isinstance(value, dict):
        return None
    for path in sorted(set(mapped or []), key=len):
        keys = [k.replace("~1", "/").replace("~0", "~") for k in path.split("/")[1:]]
        holders: list[tuple[dict, str]] = []
        node: object = value
        for k in keys:
            if not isinstance(node, dict) or k not in node:
                break
            holders.append((node, k))
            node = node[k]
        else:
            while holders:  # drop the leaf, and objects that it leaves empty
                holder, k = holders.pop()
                del holder[k]
                if holder or not holders:
                    break
    return json.dumps(value, ensure_ascii=False, sort_keys=True) if value else None


def preserved(df: DataFrame, column: str, mapped: str, into: str = "source_extra") -> DataFrame:
    """``df`` with what no reader mapped: ``column`` (JSON object) less the pointers in the array ``mapped``."""

    @F.pandas_udf("string")
    def rest(texts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([without_mapped(t if isinstance(t, str) else None, None if p is None else list(p)) for t, p in zip(texts, paths, strict=True)], dtype=object)

    return df.withColumn(into, rest(F.col(column), F.col(mapped)))
