"""Tool-call linking for chat data.

* Calls and results are hash-joined by conversation and identifier.
* Calls are put in an order in which each follows the calls it names in ``after``.  Where every named
  call has an earlier place already, the places serve as they are; in conversations with a dependency
  that points forward a call's position is the length of its longest chain of dependencies, and what has
  none lies on or behind a cycle.  Such a conversation is sorted in one task if its calls and
  dependencies, counted first, are at most ``MOST_IN_TASK``; larger ones are peeled in rounds over
  distributed rows, which give the same positions.  Calls of one position may run in any order.
* Arguments are parsed and validated against the schema of the tool's name.
* Call and result become one JSON text in canonical form: keys sorted, no spaces, shortest numbers,
  no escapes but those JSON needs.

Output: one row per identifier, ``conv_id``, ``call_id``, ``name``, ``position``, ``status``,
``errors`` and ``record``.  Rows are never grouped by conversation, so a conversation may hold any
share of them.

Status, the first that holds: ``orphan_result`` (no call), ``cycle``, ``missing_dependency``,
``no_result``, ``linked``.  Rules for special cases: rows with a null conversation or identifier are
reported as ``unidentified`` and linked with nothing; of calls (or results) with one identifier the
one of smallest place, then smallest text, counts, and ``n_calls`` and ``n_results`` tell how many
there were; null arguments are invalid JSON, and so are numbers beyond a double or of thousands of
digits and values nested deeper than ``MOST_NESTED``; half a surrogate pair is written as its escape; a
tool without a schema has the error ``unknown tool``; an unknown type in a schema fits no value, other
keywords of a wrong kind and a schema that is no object are passed over (``false`` allows nothing);
empty tables give no rows.
"""

from __future__ import annotations

import json
import math
import re
from collections import deque
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perennial.functions.storage import materialize

#: Schemas travel to every task; more than this many bytes of them are refused.
MOST_SCHEMA_BYTES = 64 << 20
#: Calls and dependencies of one conversation that a task sorts.
MOST_IN_TASK = 1 << 20
#: Arguments nested deeper are refused.
MOST_NESTED = 200
KEY = ["conv_id", "call_id"]
_BRACKETS = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}]')

_KINDS = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
    "number": lambda v: isinstance(v, int | float) and not isinstance(v, bool),
    "integer": lambda v: isinstance(v, int | float) and not isinstance(v, bool) and v == math.floor(v),
}


def _limit(schema: dict, name: str, default: float) -> float:
    limit = schema.get(name)
    return limit if isinstance(limit, int | float) and not isinstance(limit, bool) else default


def _listed(schema: dict, name: str) -> list:
    return schema[name] if isinstance(schema.get(name), list) else []


def violations(value: Any, schema: Any, path: str = "$") -> list[str]:
    """Where ``value`` breaks the schema: type, enum, bounds, lengths, properties and items."""
    if not isinstance(schema, dict):
        return [f"{path}: not allowed"] if schema is False else []
    kinds = schema.get("type")
    if kinds is not None:
        kinds = [str(k) for k in (kinds if isinstance(kinds, list) else [kinds])]
        if not any(_KINDS.get(k, lambda v: False)(value) for k in kinds):
            return [f"{path}: not {' or '.join(kinds)}"]
    out = []
    if isinstance(schema.get("enum"), list) and canonical(value) not in map(canonical, schema["enum"]):
        out.append(f"{path}: not listed")
    if _KINDS["number"](value):
        if value < _limit(schema, "minimum", -math.inf):
            out.append(f"{path}: below minimum")
        if value > _limit(schema, "maximum", math.inf):
            out.append(f"{path}: above maximum")
    if isinstance(value, str | list):
        unit = "Length" if isinstance(value, str) else "Items"
        if len(value) < _limit(schema, f"min{unit}", 0):
            out.append(f"{path}: too short")
        if len(value) > _limit(schema, f"max{unit}", math.inf):
            out.append(f"{path}: too long")
    if isinstance(value, list) and "items" in schema:
        for i, item in enumerate(value):
            out += violations(item, schema["items"], f"{path}[{i}]")
    if isinstance(value, dict):
        known = schema.get("properties")
        known = known if isinstance(known, dict) else {}
        out += [f"{path}.{k}: missing" for k in _listed(schema, "required") if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{path}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{path}.{k}: not allowed")
    return out


def _plain(value: Any) -> Any:
    """Whole floats as integers, so that equal numbers have one form."""
    if isinstance(value, float) and abs(value) < 1e16 and value == int(value):
        return int(value)
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, list) else value


_HALF = re.compile("[\ud800-\udfff]")


def _whole(text: str) -> str:
    """Half characters, which no encoding holds, as escapes."""
    return _HALF.sub(lambda m: f"\\u{ord(m.group()):04x}", text)


def canonical(value: Any) -> str:
    return _whole(json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def _no_constant(name: str):
    raise ValueError(name)


def _finite(text: str) -> float:
    number = float(text)
    if math.isinf(number):
        raise ValueError(text)
    return number


def _nested(text: str) -> bool:
    """Whether brackets outside strings open more than ``MOST_NESTED`` levels."""
    depth = 0
    for token in _BRACKETS.findall(text):
        depth += (token in "[{") - (token in "]}")
        if depth > MOST_NESTED:
            return True
    return False


def parse(text: str | None) -> tuple[Any, bool]:
    try:
        if _nested(text or ""):
            return None, False
        return json.loads(text or "", parse_constant=_no_constant, parse_float=_finite), True
    except ValueError:
        return None, False


_RECORD = T.StructType().add("errors", T.ArrayType(T.StringType())).add("record", T.StringType())


def _recorder(schemas: dict[str, str]):
    @F.arrow_udf(_RECORD)
    def record(
        conv: pa.Array, call: pa.Array, name: pa.Array, arguments: pa.Array, content: pa.Array
    ) -> pa.Array:
        known = {k: parse(s)[0] for k, s in schemas.items()}
        rows = []
        for c, i, n, a, r in zip(*[x.to_pylist() for x in (conv, call, name, arguments, content)]):
            errors, value = [], None
            if n is not None or a is not None:
                value, ok = parse(a)
                if not ok:
                    errors, value = ["$: not JSON"], a
                elif n not in known:
                    errors = ["unknown tool"]
                else:
                    errors = violations(value, known[n])
            whole = {"arguments": value, "call_id": i, "content": r, "conv_id": c, "name": n}
            rows.append({"errors": [_whole(e) for e in errors], "record": canonical(whole)})
        return pa.array(
            rows, pa.struct([("errors", pa.list_(pa.string())), ("record", pa.string())])
        )

    return record


def _first(rows: DataFrame, fields: list[str], count: str) -> DataFrame:
    """One row per identifier, and how many there were."""
    order = F.min(F.struct(*fields)).alias("_first")
    picked = rows.groupBy(*KEY).agg(order, F.count(F.lit(1)).alias(count))
    return picked.select(*KEY, *[F.col("_first")[f].alias(f) for f in fields], count)


def chain_lengths(calls: list[str], edges: list[tuple[str, str]]) -> list[int | None]:
    """Longest chain of dependencies below each call, none on or behind a cycle; ``edges`` are pairs of
    a call and one that it follows."""
    waits, followers = dict.fromkeys(calls, 0), {}
    for call, parent in edges:
        waits[call] += 1
        followers.setdefault(parent, []).append(call)
    level = {c: 0 for c, n in waits.items() if not n}
    queue = deque(level)
    while queue:
        parent = queue.popleft()
        for call in followers.get(parent, ()):
            waits[call] -= 1
            if not waits[call]:
                level[call] = level[parent] + 1
                queue.append(call)
    return [level.get(c) for c in calls]


def _positions(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """``level`` of the calls of conversations that have a forward dependency; null on a cycle."""
    nodes = calls.select(*KEY)
    links = edges.select("conv_id", "call_id", F.col("parent").alias("on"))
    sizes = nodes.select("conv_id").unionByName(links.select("conv_id")).groupBy("conv_id").count()
    large = materialize(sizes.where(F.col("count") > MOST_IN_TASK).select("conv_id"), "large")
    kind = calls.schema["conv_id"].dataType.simpleString()

    def sort(key: tuple, own: pd.DataFrame, on: pd.DataFrame) -> pd.DataFrame:
        names = own["call_id"].tolist()
        levels = chain_lengths(names, list(zip(on["call_id"], on["on"])))
        return pd.DataFrame(
            {"conv_id": own["conv_id"], "call_id": names, "level": pd.array(levels, "Int64")}
        )

    def sorted_in_tasks(nodes: DataFrame, links: DataFrame) -> DataFrame:
        both = nodes.groupBy("conv_id").cogroup(links.groupBy("conv_id"))
        return both.applyInPandas(sort, f"conv_id {kind}, call_id string, level long")

    if large.isEmpty():
        return sorted_in_tasks(nodes, links)
    small = sorted_in_tasks(*[rows.join(large, "conv_id", "left_anti") for rows in (nodes, links)])
    return small.unionByName(_peeled(*[rows.join(large, "conv_id", "left_semi") for rows in (calls, edges)]))


def _peeled(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """The same by rounds: each places the calls whose dependencies are placed."""
    keyed = edges.select("conv_id", "call_id", F.col("parent").alias("on"))
    left = materialize(calls.select(*KEY), "unplaced")
    placed, rounds = None, 0
    while not left.isEmpty():
        waits = keyed.join(left.withColumnRenamed("call_id", "on"), ["conv_id", "on"], "left_semi")
        blocked = waits.select(*KEY).distinct()
        ready = materialize(
            left.join(blocked, KEY, "left_anti").withColumn("level", F.lit(rounds).cast("long")), "ready"
        )
        if ready.isEmpty():
            cyclic = left.withColumn("level", F.lit(None).cast("long"))
            return cyclic if placed is None else placed.unionByName(cyclic)
        placed = ready if placed is None else placed.unionByName(ready)
        left = materialize(left.join(ready, KEY, "left_anti"), "unplaced")
        rounds += 1
    return placed if placed is not None else calls.select(*KEY, F.lit(0).cast("long").alias("level"))


def link_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """Link ``calls`` (conv_id, call_id, place, name, arguments, after) with ``results`` (conv_id,
    call_id, place, content); ``schemas`` has (name, schema).  Other columns are ignored."""
    size = schemas.agg(F.sum(F.octet_length("schema") + F.octet_length("name"))).first()[0] or 0
    if size > MOST_SCHEMA_BYTES:
        raise ValueError(f"{size} bytes of schemas")
    record = _recorder(
        {r["name"]: r["schema"] for r in schemas.orderBy("name", "schema").collect() if r["name"]}
    )
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    own = materialize(
        _first(calls.where(named), ["place", "name", "arguments", "after"], "n_calls"), "calls"
    )
    answers = _first(results.where(named), ["place", "content"], "n_results").select(
        *KEY, "content", "n_results"
    )
    edges = own.select(*KEY, "place", F.explode(F.array_distinct("after")).alias("parent"))
    parents = own.select("conv_id", F.col("call_id").alias("parent"), F.col("place").alias("before"))
    edges = materialize(
        edges.where("parent IS NOT NULL").join(parents, ["conv_id", "parent"], "left"), "edges"
    )
    missing = edges.where("before IS NULL").select(*KEY, F.lit(True).alias("missing")).distinct()
    turned = edges.where("before >= place OR (before IS NOT NULL AND place IS NULL)")
    turned = materialize(turned.select("conv_id").distinct(), "turned")
    placed = own.join(missing, KEY, "left")
    if turned.isEmpty():
        placed = placed.withColumn("level", F.col("place").cast("long")).withColumn("peeled", F.lit(False))
    else:
        there = own.join(turned, "conv_id", "left_semi")
        inner = edges.where("before IS NOT NULL").join(turned, "conv_id", "left_semi")
        levels = _positions(there, inner).withColumn("peeled", F.lit(True))
        placed = placed.join(levels, KEY, "left").withColumn(
            "level", F.when(F.col("peeled"), F.col("level")).otherwise(F.col("place").cast("long"))
        )
    linked = placed.join(answers.hint("shuffle_hash"), KEY, "full_outer")
    status = (
        F.when(F.col("n_calls").isNull(), "orphan_result")
        .when(F.col("peeled") & F.col("level").isNull(), "cycle")
        .when(F.col("missing"), "missing_dependency")
        .when(F.col("n_results").isNull(), "no_result")
        .otherwise("linked")
    )
    none = F.lit(None)
    nameless = (
        calls.where(~named)
        .select("conv_id", "call_id", "name", "arguments", none.cast("string").alias("content"))
        .unionByName(
            results.where(~named).select(
                "conv_id", "call_id", none.cast("string").alias("name"),
                none.cast("string").alias("arguments"), "content",
            )
        )
        .withColumn("position", none.cast("long"))
        .withColumn("status", F.lit("unidentified"))
        .withColumn("n_calls", none.cast("long"))
        .withColumn("n_results", none.cast("long"))
    )
    rows = linked.select(
        *KEY, "name", "arguments", "content", F.col("level").alias("position"), status.alias("status"),
        "n_calls", "n_results",
    ).unionByName(nameless)
    made = rows.withColumn("_r", record(*KEY, "name", "arguments", "content"))
    return made.select(
        *KEY, "name", "position", "status", F.coalesce("n_calls", F.lit(0)).alias("n_calls"),
        F.coalesce("n_results", F.lit(0)).alias("n_results"), "_r.errors", "_r.record",
    )
