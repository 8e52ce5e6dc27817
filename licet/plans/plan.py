"""Queries, plan operations and the licence check."""

from __future__ import annotations

from dataclasses import dataclass

from .facts import Fact


@dataclass(frozen=True)
class Query:
    kind: str  # Get, Sum, Between, Filter, Count
    left: int = 0
    right: int = 0
    low: int = 0
    high: int = 0
    equals: int | None = None


@dataclass(frozen=True)
class Op:
    name: str
    param: int | None = None
    cites: tuple[Fact, ...] = ()


@dataclass(frozen=True)
class Plan:
    query: Query
    ops: tuple[Op, ...]
    output: str  # ExactScalar or ExactRanges
    source: str = ""


class NotLicensed(ValueError):
    """A plan skips work without a fact that permits it."""


SKIPS = {"SearchMonotone", "ProbeSparseFence", "SearchPiecewise", "TranslateDictionaryRange", "CountRuns"}


def entails(fact: Fact, op: Op) -> bool:
    if op.name in ("SearchMonotone", "ProbeSparseFence"):
        return fact.prop == "NonDecreasing" and fact.scope in ("AllRows", "NonNullRows")
    if op.name == "SearchPiecewise":
        return fact.prop == "PiecewiseNonDecreasing" and fact.scope == "AllRows" and fact.param == op.param
    if op.name == "TranslateDictionaryRange":
        return fact.prop == "OrderPreserving" and fact.scope == "Mapping"
    if op.name == "CountRuns":
        return fact.prop == "RunIndex" and fact.scope == "Physical"
    return False


def check_authorization(plan: Plan, facts: list[Fact], source: str = "") -> None:
    """Every skip cites a proven fact that entails it; nothing else cites any."""
    if not plan.ops:
        raise NotLicensed("an empty plan")
    if plan.source != source:
        raise NotLicensed("the facts are about other data")
    for op in plan.ops:
        if op.name in SKIPS and not op.cites:
            raise NotLicensed(f"{op.name} cites no fact")
        if op.name not in SKIPS and op.cites:
            raise NotLicensed(f"{op.name} needs no fact")
        for f in op.cites:
            if f not in facts:
                raise NotLicensed(f"{f.prop} is not proven")
            if not entails(f, op):
                raise NotLicensed(f"{f.prop} does not permit {op.name}")


KNOWN = SKIPS | {"DecodeRow", "AggregateEncoded", "CountExact", "MaterializeRows"}


def validate_plan(plan: Plan) -> None:
    """A plan has steps, all of a known name, the last of which gives its output, and parameters only where they mean something."""
    if not plan.ops:
        raise ValueError("an empty plan")
    for op in plan.ops:
        if op.name not in KNOWN:
            raise ValueError(f"{op.name} is no step")
        if (op.param is not None) != (op.name == "SearchPiecewise"):
            raise ValueError(f"{op.name} has a wrong parameter")
    if plan.output != ("ExactRanges" if plan.query.kind in ("Between", "Filter") else "ExactScalar"):
        raise ValueError("the output does not fit the query")
