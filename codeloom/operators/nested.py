"""Deeply nested semi-structured records as flat, linked tables.

Method: a depth-first traversal gives every node of a record an interval (pre, post); a node
lies inside another exactly if its interval does. Nodes are written out per type and children
find their owner by interval containment.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions.keys import plain_key
from codeloom.runtime import table

#: Fields whose elements are children, by their name without case and separators.
CHILD_FIELDS = {
    "params": "params",
    "imports": "imports",
    "callerclassifications": "caller_classifications",
    "hardcodedartifacts": "hardcoded_artifacts",
}
#: Other fields that tell a record from a wrapper around it.
RECORD_FIELDS = {"id", "path", "functions", "impact", "contenthash", "description", "name", *CHILD_FIELDS}

NODE_SCHEMA = "record_id string, node string, pre int, post int, pos int, sub_pos int, own_id string, own_path string"


def _plain(name: str) -> str:
    return "".join(ch for ch in name if ch.isalnum()).lower()


def _embedded(value):
    """A string that holds a JSON object or array, read; anything else as it is."""
    for _ in range(4):
        if not isinstance(value, str):
            return value
        text = value.strip()
        if text[:1] not in ("{", "[", '"'):
            return value
        try:
            value = json.loads(text)
        except (ValueError, RecursionError):
            return value
    return value


def _balanced_end(text: str, start: int) -> int:
    """Index behind the bracket that closes text[start], or -1 if it stays open."""
    depth, quoted, i = 0, False, start
    while i < len(text):
        ch = text[i]
        if quoted:
            if ch == "\\":
                i += 1
            elif ch == '"':
                quoted = False
        elif ch == '"':
            quoted = True
        elif ch in "{[":
            depth += 1
        elif ch in "}]":
            depth -= 1
            if depth == 0:
                return i + 1
        i += 1
    return -1


#: The beginning of a JSON object, as against a brace in a remark.
_OPENED = re.compile(r'\{\s*"')


def read_payload(payload: str | None):
    """The JSON object in a payload, whatever stands around it (fences, remarks, quoting); None if there is no complete one."""
    if not payload:
        return None
    text = payload.strip("﻿ \t\r\n")
    try:
        value = _embedded(json.loads(text))
    except (ValueError, RecursionError):
        value, at = None, text.find("{")
        while at >= 0:
            end = _balanced_end(text, at)
            if end < 0:
                if _OPENED.match(text, at):
                    return None  # an object that was cut off: what is complete within it is no record
                at = text.find("{", at + 1)  # a brace of the remark around the record
                continue
            try:
                value = json.loads(text[at:end])
                break
            except (ValueError, RecursionError):
                at = text.find("{", end)
    if isinstance(value, list):
        value = next((x for x in map(_embedded, value) if isinstance(x, dict)), None)
    for _ in range(4):
        if not isinstance(value, dict) or any(_plain(k) in RECORD_FIELDS for k in value):
            break
        inner = [x for x in map(_embedded, value.values()) if isinstance(x, dict)]
        if len(inner) != 1:
            break
        value = inner[0]
    return value if isinstance(value, dict) else None


def _field(obj: dict, *names: str):
    for k, v in obj.items():
        if _plain(k) in names and isinstance(v, str) and v.strip():
            return v
    return None


def label_nodes(record: dict) -> list[tuple]:
    """(node, pre, post, pos, sub_pos, own_id, own_path) of a record's typed nodes.

    Every node takes part in the numbering. node is record, function, artifact_values or a
    child type. A null element takes a place but is no node; a lone object counts as an array
    of one, as does a bare string; own_id of functions held in a map is the map key.
    """
    out: list[tuple] = []
    clock = 0
    path = _field(record, "path", "file")
    # (value, type, pos, sub_pos, own_id) to enter, or the index in out of a typed node to close
    stack: list = [(record, "record", -1, -1, _field(record, "id", "fnid") or path)]
    while stack:
        top = stack.pop()
        if isinstance(top, int):
            row = out[top]
            out[top] = (*row[:2], clock, *row[3:])
            clock += 1
            continue
        value, kind, pos, sub, own = top
        pre = clock
        clock += 1
        if kind:
            out.append((kind, pre, pre, pos, sub, own, path if kind == "record" else None))
            stack.append(len(out) - 1)
        inner: list = []
        if isinstance(value, dict):
            for k, v in value.items():
                name = _plain(k)
                if name in CHILD_FIELDS:
                    v = _embedded(v)
                    items = v if isinstance(v, list) else [] if v is None or v == "" or v == {} else [v]
                    inner += [(_embedded(x), CHILD_FIELDS[name], i, -1, None) for i, x in enumerate(items) if x is not None]
                elif name == "functions":
                    v = _embedded(v)
                    if isinstance(v, dict) and any(isinstance(_embedded(x), dict) for x in v.values()):
                        inner += [(x, "function", i, -1, key) for i, (key, y) in enumerate(v.items()) if isinstance(x := _embedded(y), dict)]
                    else:
                        for i, y in enumerate(v if isinstance(v, list) else [v]):
                            x = _embedded(y)
                            if isinstance(x, dict):
                                fn = _field(x, "id", "fnid") or (f"{path}::{_field(x, 'name')}" if path and _field(x, "name") else None)
                                inner.append((x, "function", i, -1, fn))
                elif kind == "hardcoded_artifacts" and name in ("value", "values", "valuelist"):
                    v = _embedded(v)
                    if isinstance(v, list):
                        inner += [(x, "artifact_values", pos, i, None) for i, x in enumerate(v) if x is not None]
                elif isinstance(v := _embedded(v), (dict, list)):
                    inner.append((v, None, -1, -1, None))
        elif isinstance(value, list):
            inner = [(x, None, -1, -1, None) for x in map(_embedded, value) if isinstance(x, (dict, list))]
        stack.extend(reversed(inner))
    return out


def _shred(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
    for batch in batches:
        rows = []
        for rid, payload in zip(batch["record_id"], batch["payload"]):
            record = read_payload(payload)
            if record is not None:
                rows += [(rid, *x) for x in label_nodes(record)]
        yield pd.DataFrame(rows, columns=names)


def record_nodes(records: DataFrame) -> DataFrame:
    """Interval-labelled nodes of records(record_id, payload, received_at).

    Of repeated record ids the row received last holds (at equal times the greater payload).
    Rows without id, and payloads without a complete JSON object, give nothing.
    """
    last = records.where("record_id is not null").groupBy("record_id").agg(F.max(F.struct("received_at", "payload")).alias("m"))
    return last.select("record_id", F.col("m.payload").alias("payload")).mapInPandas(_shred, NODE_SCHEMA)


def child_tables(nodes: DataFrame) -> DataFrame:
    """(record_id, child, owner_id, pos, sub_pos): every child under the id of its owner.

    A function or record owns the children whose interval lies in its own; the innermost
    function goes before the record. Files own their imports by path.
    """
    w = Window.partitionBy("record_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def opened(kind: str):
        return F.last(F.when(F.col("node") == kind, F.struct("post", "own_id", "own_path")), ignorenulls=True).over(w)

    linked = nodes.withColumn("fn", opened("function")).withColumn("rec", opened("record"))
    inside = F.col("fn.post") > F.col("post")
    owner = F.when(F.col("node") == "imports", F.coalesce("rec.own_path", "rec.own_id")).when(inside, F.col("fn.own_id")).otherwise(F.col("rec.own_id"))
    rows = linked.where(~F.col("node").isin("record", "function"))
    return rows.select("record_id", F.col("node").alias("child"), plain_key(owner).alias("owner_id"), "pos", "sub_pos")


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return child_tables(record_nodes(table(spark, root, "raw_records")))
