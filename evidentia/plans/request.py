"""Requests: what may be asked, checked before any table is read."""

from __future__ import annotations

import argparse
import re
from dataclasses import dataclass, field
from datetime import UTC, datetime

from evidentia.schema import CAUSES

POINT, TREND, TRAJECTORY, CAUSAL = "point-in-time", "trend-comparison", "trajectory", "causal-chain"
#: Bounds of one request (fixed values).
MAX_ENTITIES, MAX_PREDICATES, MAX_ROWS = 64, 256, 10_000
OPERATIONS = {
    POINT: ("read", "reconstruct", "project", "gaps"),
    TREND: ("read", "aggregate", "compare", "project", "gaps"),
    TRAJECTORY: ("read", "build-trajectory", "aggregate", "project", "gaps"),
    CAUSAL: ("read", "build-causal-chain", "project", "gaps"),
}


class BadRequest(ValueError):
    """The request cannot be asked."""


def instant(value: str | datetime) -> datetime:
    """UTC microseconds without a zone; text must be RFC 3339 with a zone."""
    if isinstance(value, str):
        m = re.fullmatch(r"(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)(\.\d{1,9})?(Z|[+-]\d\d:\d\d)", value)
        if not m:
            raise BadRequest(f"not an RFC 3339 instant: {value}")
        fraction = ((m[2] or ".0")[1:7]).ljust(6, "0")
        try:
            value = datetime.fromisoformat(f"{m[1]}.{fraction}{'+00:00' if m[3] == 'Z' else m[3]}")
        except ValueError as e:
            raise BadRequest(str(e)) from e
    return value.astimezone(UTC).replace(tzinfo=None) if value.tzinfo else value


@dataclass(frozen=True)
class At:
    label: str
    instant: datetime


@dataclass(frozen=True)
class Between:
    """A half-open window."""

    label: str
    start: datetime
    end: datetime

    def __post_init__(self):
        if self.end <= self.start:
            raise BadRequest("a window must end after it starts")


@dataclass(frozen=True)
class Request:
    intent: str
    entity_ids: tuple[str, ...]
    selections: tuple[At | Between, ...]
    predicates: tuple[str, ...] = ()
    match: str = "all"
    known_as_of: datetime | None = None
    limit: int = 0
    operations: tuple[str, ...] = field(default=(), compare=False)


def normalize(r: Request) -> Request:
    """Sorted and checked: one point, two windows in order of start, or one window; limits only where rows are listed."""
    if r.intent not in OPERATIONS:
        raise BadRequest(f"unknown intent {r.intent}")
    ids = [i.strip() for i in r.entity_ids]
    if not ids or not all(ids) or len(ids) > MAX_ENTITIES or len(set(ids)) != len(ids):
        raise BadRequest("entity ids must be present, distinct and few")
    if r.match not in ("all", "any"):
        raise BadRequest("match is all or any")
    predicates = list(r.predicates)
    if r.intent == CAUSAL:
        if predicates != [CAUSES]:
            raise BadRequest("a causal request has the causal predicate alone")
    if not all(p.strip() for p in predicates) or len(predicates) > MAX_PREDICATES or len(set(predicates)) != len(predicates):
        raise BadRequest("predicates must be distinct and few")
    want = {POINT: (At,), TREND: (Between, Between)}.get(r.intent, (Between,))
    if len(r.selections) != len(want) or not all(isinstance(s, k) for s, k in zip(r.selections, want, strict=True)):
        raise BadRequest(f"{r.intent} has other selections")
    labels = [s.label for s in r.selections]
    if not all(x.strip() for x in labels) or len(set(labels)) != len(labels):
        raise BadRequest("labels must be distinct")
    if r.intent == TREND and r.selections[1].start <= r.selections[0].start:
        raise BadRequest("the second window must start later")
    listed = r.intent in (TRAJECTORY, CAUSAL)
    if listed and not 1 <= r.limit <= MAX_ROWS or not listed and r.limit:
        raise BadRequest("only trajectory and causal requests have a limit, of 1 to 10000")
    return Request(r.intent, tuple(sorted(ids)), r.selections, tuple(sorted(predicates)), r.match, r.known_as_of, r.limit, OPERATIONS[r.intent])


def window(label: str, text: str) -> Between:
    if text.count("/") != 1:
        raise BadRequest("a window is start/end")
    return Between(label, *(instant(x) for x in text.split("/")))


def parse(argv: list[str]) -> tuple[Request, str]:
    """A request and the output format from command-line words."""
    top = argparse.ArgumentParser(prog="evidentia query", exit_on_error=False)
    sub = top.add_subparsers(dest="kind", required=True)
    for kind in ("point", "trend", "trajectory", "causal"):
        p = sub.add_parser(kind, exit_on_error=False)
        p.add_argument("--entity", action="append", required=True)
        p.add_argument("--entity-match", default="all", choices=("all", "any"))
        if kind != "causal":
            p.add_argument("--predicate", action="append", default=[])
        p.add_argument("--known-as-of")
        p.add_argument("--output", default="text", choices=("text", "json"))
        for name in {"point": ("--at",), "trend": ("--before", "--after")}.get(kind, ("--between",)):
            p.add_argument(name, required=True)
        if kind in ("trajectory", "causal"):
            p.add_argument("--limit", type=int, required=True)
    try:
        a = top.parse_args(argv)
    except argparse.ArgumentError as e:
        raise BadRequest(str(e)) from e
    selections = {
        "point": lambda: (At("point", instant(a.at)),), "trend": lambda: (window("before", a.before), window("after", a.after)),
        "trajectory": lambda: (window("between", a.between),), "causal": lambda: (window("between", a.between),),
    }[a.kind]()
    known = instant(a.known_as_of) if a.known_as_of else None
    intent = {"point": POINT, "trend": TREND, "trajectory": TRAJECTORY, "causal": CAUSAL}[a.kind]
    predicates = (CAUSES,) if intent == CAUSAL else tuple(a.predicate)
    return normalize(Request(intent, tuple(a.entity), selections, predicates, a.entity_match, known, getattr(a, "limit", 0))), a.output


def from_proposal(text: str, entity_ids: tuple[str, ...]) -> Request:
    """The request that a planner proposed as strict JSON; the planner never sees or names entity ids."""
    from evidentia.operators.extraction import strict_json

    x = strict_json(text)
    if not isinstance(x, dict) or set(x) != {"status", "reason", "intent", "entity_match", "predicates", "selections", "knowledge_scope", "chronology_limit"}:
        raise BadRequest("proposal members")
    if x["status"] != "planned":
        raise BadRequest(f"the planner declined: {x['reason']}")
    selections = []
    for s in x["selections"]:
        if set(s) == {"label", "at"}:
            selections.append(At(s["label"], instant(s["at"])))
        elif set(s) == {"label", "start", "end"}:
            selections.append(Between(s["label"], instant(s["start"]), instant(s["end"])))
        else:
            raise BadRequest("selection members")
    scope = x["knowledge_scope"]
    known = None if scope == "current" else instant(scope)
    return normalize(Request(x["intent"], entity_ids, tuple(selections), tuple(x["predicates"]), x["entity_match"], known, x["chronology_limit"] or 0))


def ask(question: str, planner, entity_ids: tuple[str, ...]) -> Request:
    """The planner (question -> JSON) is asked without the ids; a question that holds one is refused."""
    if any(i in question for i in entity_ids):
        raise BadRequest("a question may not name entity ids")
    return from_proposal(planner(question), entity_ids)
