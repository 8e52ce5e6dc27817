"""Requests and replies as JSON: recipes, facts, plans and answers."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame

from ..functions.scalar import fnv1a
from . import compiler, encoded, layout
from .facts import Fact
from .plan import Plan, Query
from .recipe import KINDS, LEAVES, Recipe

INTERVALS = {"Delta": 256, "UnsignedDelta": 256, "RLE": 32, "Patch": 32, "Nullable": 256}
#: Rows of an answer that a reply may hold; longer answers are read from the DataFrame of ``answer``.
MOST_ROWS = 10_000


def parse_recipe(name: str) -> Recipe:
    """``Dictionary(RLE@32(BitPack))``: the inverse of a recipe's name; a missing interval is the usual one."""
    head, _, rest = name.strip().partition("(")
    kind, _, at = head.partition("@")
    if kind not in KINDS or (bool(rest) and not rest.endswith(")")) or bool(rest) == (kind in LEAVES):
        raise ValueError(f"{name!r} is not a recipe")
    return Recipe(kind, parse_recipe(rest[:-1]) if rest else None, int(at) if at else INTERVALS.get(kind, 0))


def parse_query(q: dict, rows: int) -> Query:
    def need(key: str) -> int:
        if not isinstance(q.get(key), int):
            raise ValueError(f"a query of kind {q.get('kind')} needs {key!r}")
        return q[key]

    left, right = q.get("left", 0), q.get("right", rows)
    match q.get("kind"):
        case "get":
            return Query("Get", need("row"))
        case "sum":
            return Query("Sum", left, right)
        case "between":
            return Query("Between", left, right, need("low"), need("high"))
        case "filter_between":
            return Query("Filter", low=need("low"), high=need("high"))
        case "filter_equals":
            return Query("Filter", equals=need("value"))
        case "count_equals":
            return Query("Count", equals=need("value"))
    raise ValueError(f"unknown query kind {q.get('kind')!r}")


def fact_dict(f: Fact) -> dict:
    return {"scope": f.scope, "property": f.prop, "parameter": f.param, "evidence": f.evidence, "assumptions": sorted(f.assumes)}


def plan_dict(p: Plan) -> dict:
    ops = [{"op": o.name, "parameter": o.param, "cites": [fact_dict(f) for f in o.cites]} for o in p.ops]
    return {"query": asdict(p.query), "ops": ops, "output": p.output}


def signature(plans: list[Plan]) -> str:
    """Hash of the plans' canonical JSON, whatever data they are for."""
    return f"{fnv1a(json.dumps([plan_dict(p) for p in plans], sort_keys=True).encode()):016x}"


def answer(df: DataFrame, request: dict) -> DataFrame:
    c = compiler.column(df, parse_recipe(request["recipe"]))
    return compiler.run(parse_query(request["query"], c.checked.rows), c)


def serve(df: DataFrame, request: str) -> str:
    """One request about the column ``df``: {"op": recipes | encode | facts | compile | run, "recipe", "query"}."""
    r = json.loads(request)
    op = r.get("op")
    if op == "recipes":
        return json.dumps({"recipes": sorted(KINDS), "leaves": sorted(LEAVES), "intervals": INTERVALS})
    if op not in ("encode", "facts", "compile", "run"):
        raise ValueError(f"unknown op {op!r}")
    c = compiler.column(df, parse_recipe(r["recipe"]))
    if op == "encode":
        fields = encoded.field_bytes(c)
        size = layout.page_bytes(fields, layout.dependencies(c.recipe))
        return json.dumps({"recipe": c.recipe.name(), "rows": c.checked.rows, "numbers": c.numbers, "fields": [{"kind": k, "bytes": n} for k, n in fields], "page_bytes": size, "nulls": c.checked.nulls})
    if op == "facts":
        return json.dumps({"recipe": c.recipe.name(), "rows": c.checked.rows, "facts": [fact_dict(f) for f in c.facts]})
    plan = compiler.compile_query(parse_query(r["query"], c.checked.rows), c)
    if op == "compile":
        return json.dumps(plan_dict(plan) | {"signature": signature([plan])})
    rows = compiler.lower(plan, c).limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"the answer has over {MOST_ROWS} rows; use answer()")
    return json.dumps({"plan": plan_dict(plan), "answer": sorted(({k: int(v) if v is not None else None for k, v in x.asDict().items()} for x in rows), key=lambda x: [(v is None, v or 0) for v in x.values()])})
