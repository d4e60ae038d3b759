"""The rules of state, trend, trajectory and causality on small literal tables and against a plain model."""

import random
from datetime import datetime, timedelta
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from evidentia import schema
from evidentia.functions import timeaxis as ta
from evidentia.operators import causal, state, trajectory

T0 = datetime(2032, 1, 1)
COLS = schema.OBSERVATION


def day(n):
    return None if n is None else T0 + timedelta(days=n)


def obs(i, predicate, value, kind, start, end, recorded=0, status="observed", subject="e1"):
    return (f"o{i}", "entity", subject, predicate, "text", value, kind, day(start), day(end), day(recorded), status)


def lit(n):
    return F.lit(day(n)).cast("timestamp_ntz")


def frames(spark, rows, unsupported=()):
    links = [(r[0], f"ev:{r[0]}", "contradicting" if r[0] in unsupported else "supporting") for r in rows]
    return spark.createDataFrame(rows, COLS), spark.createDataFrame(links, schema.EVIDENCE_LINK)


def outcomes(spark, rows, lo, hi, unsupported=(), cutoff=None):
    o, links = frames(spark, rows, unsupported)
    keys = state.aggregate(state.candidates(o, links, cutoff), *ta.in_window(lit(lo), lit(hi)))[2]
    return {(r["subject_ref"], r["predicate"]): (r["outcome"], r["object_ref"]) for r in keys.collect()}


def test_reasons_in_order(spark):
    rows = [
        obs(1, "resolved", "a", "interval", 0, None), obs(2, "resolved", "a", "instant", 3, None, status="hypothesized"),
        obs(3, "time", "a", "interval", 0, None), obs(4, "time", "b", "window", 2, 4), obs(5, "hypo", "a", "interval", 0, 9, status="hypothesized"),
        obs(6, "conflict", "a", "interval", 0, 5), obs(7, "conflict", "b", "instant", 4, None),
        obs(8, "several", "a", "interval", 0, 2), obs(9, "several", "b", "interval", 2, 5), obs(10, "counter", "a", "interval", 0, 5),
        obs(11, "blocked", "a", "interval", 0, 5), obs(12, "blocked", "a", "interval", 0, 5), obs(13, "gone", "a", "interval", 0, 5, status="rejected"),
        obs(14, "outside", "a", "instant", 10, None), obs(15, "unknown", "a", "unknown", None, None),
    ]
    got = outcomes(spark, rows, 0, 10, unsupported={"o10", "o12"})
    assert {k[1]: v for k, v in got.items()} == {
        "resolved": ("resolved", "a"), "time": ("temporal-uncertainty", None), "hypo": ("hypothesized", None), "conflict": ("conflicting-values", None),
        "several": ("multiple-states-in-window", None), "counter": ("counterevidence-only", None), "blocked": ("counterevidence-only", None),
        "unknown": ("temporal-uncertainty", None),
    }


def test_keys_are_not_joined_text(spark):
    rows = [obs(1, "c", "x", "interval", 0, 5, subject="a:b"), obs(2, "b:c", "y", "interval", 0, 5, subject="a")]
    assert len(outcomes(spark, rows, 0, 10)) == 2


def test_cutoff_is_inclusive(spark):
    rows = [obs(1, "p", "a", "interval", 0, None, recorded=2), obs(2, "p", "b", "interval", 0, None, recorded=3)]
    assert outcomes(spark, rows, 0, 10, cutoff=day(2))[("e1", "p")] == ("resolved", "a")
    assert outcomes(spark, rows, 0, 10)[("e1", "p")] == ("conflicting-values", None)


def test_repeats_and_divergence(spark):
    o, _ = frames(spark, [obs(1, "p", "a", "interval", 0, 1)])
    assert state.dedupe_observations(o.unionByName(o)).count() == 1
    with pytest.raises(Exception, match="divergent"):
        state.dedupe_observations(o.unionByName(o.withColumn("object_ref", F.lit("b")))).collect()


def test_point_and_before(spark):
    rows = [obs(1, "p", "a", "interval", 0, 5), obs(2, "p", "a", "instant", 5, None), obs(3, "p", "a", "window", 4, 6), obs(4, "p", "a", "interval", None, None)]
    o, _ = frames(spark, rows)
    at, before = ta.at_point(lit(5)), ta.just_before(lit(5))
    got = [tuple(r) for r in o.select(at[0], at[1], before[0], before[1]).collect()]
    assert got == [(False, False, True, False), (True, False, False, False), (False, True, False, True), (True, False, True, False)]


def test_trend(spark):
    rows = [
        obs(1, "changed", "a", "interval", 0, 3), obs(2, "changed", "b", "interval", 5, 8), obs(3, "added", "b", "interval", 5, 8),
        obs(4, "removed", "a", "interval", 0, 3), obs(5, "same", "a", "interval", 0, None), obs(6, "open", "a", "interval", 0, 3), obs(7, "open", "b", "window", 5, 8),
    ]
    o, links = frames(spark, rows)
    c = state.candidates(o, links)
    parts = [state.aggregate(c, *ta.in_window(lit(a), lit(b)))[2].withColumn("label", F.lit(n)) for n, a, b in (("x", 0, 4), ("y", 5, 9))]
    got = {r["predicate"]: r["change"] for r in state.compare(parts[0].unionByName(parts[1]), "x", "y").collect()}
    assert got == {"changed": "changed", "added": "added", "removed": "removed", "open": "unresolved"}


# a plain model of the rules, one key at a time, pieces cut at the boundaries of all keys


def reach(r):
    k, s, e = r[6], r[7], r[8]
    lo = s or datetime.min
    return lo, (lo + timedelta(microseconds=1) if k == "instant" else e or datetime.max)


def solve(rows, test):
    keys = {}
    for r in rows:
        if r[10] != "rejected" and (m := test(r)):
            cls = "t" if m == "u" or r[10] == "hypothesized" else "s"
            keys.setdefault((r[2], r[3]), []).append((cls, m, r))
    out = {}
    for k, found in keys.items():
        s = {r[5] for c, _, r in found if c == "s"}
        rest = [(m, r[5]) for c, m, r in found if c == "t" and r[5] not in s]
        clash = any(a[5] != b[5] and reach(a)[0] < reach(b)[1] and reach(b)[0] < reach(a)[1] for a, b in combinations([r for c, _, r in found if c == "s"], 2))
        if len(s) == 1 and not rest:
            out[k] = ("resolved", next(iter(s)))
        else:
            why = "temporal-uncertainty" if any(m == "u" for m, _ in rest) else "hypothesized" if rest else "conflicting-values" if clash else "multiple-states-in-window"
            out[k] = (why, None)
    return out


def model_window(rows, lo, hi):
    def test(r):
        if r[6] == "unknown":
            return "u"
        a, b = reach(r)
        return ("u" if r[6] == "window" else "e") if a < hi and b > lo else ""

    return solve(rows, test)


def model_transitions(rows, lo, hi):
    cuts = {lo}
    for r in rows:
        if r[10] != "rejected" and r[6] != "unknown":
            cuts |= {t for t in (r[7],) if t and lo <= t < hi} | {t for t in (r[8],) if t and r[6] != "instant" and lo < t < hi}
    cuts = sorted(cuts)

    def before(r):
        if r[6] == "unknown":
            return "u"
        ok = r[6] != "instant" and (r[7] is None or r[7] < lo) and (r[8] is None or r[8] >= lo)
        return ("u" if r[6] == "window" else "e") if ok else ""

    states = [solve(rows, before)] + [model_window(rows, a, b) for a, b in zip(cuts, [*cuts[1:], hi], strict=True)]
    out = set()
    for at, old, new in zip(cuts, states, states[1:], strict=False):
        for k in old.keys() | new.keys():
            a, b = (x.get(k, ("", None)) for x in (old, new))
            a, b = (x[1] if x[0] == "resolved" else None for x in (a, b))
            if a != b:
                out.add((*k, at, "added" if a is None else "removed" if b is None else "changed", a, b))
    return out


def random_rows(seed, n=24):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rnd.choice(schema.EXTENT_KINDS)
        a, b = sorted(rnd.sample(range(12), 2))
        start = None if kind == "unknown" or kind == "interval" and rnd.random() < 0.2 else a
        end = None if kind in ("unknown", "instant") or kind == "interval" and rnd.random() < 0.2 else b
        rows.append(obs(i, rnd.choice("pq"), rnd.choice("xyz"), kind, start, end, status=rnd.choice(["observed"] * 4 + ["hypothesized", "rejected"]), subject=f"{seed}-{rnd.choice('ab')}"))
    return rows


def test_random_windows_and_permutation(spark):
    rows = [(f"{s}{r[0]}", *r[1:]) for s in range(40) for r in random_rows(s, 8)]
    want = model_window(rows, day(3), day(8))
    assert outcomes(spark, rows, 3, 8) == want
    random.Random(1).shuffle(rows)
    assert outcomes(spark, rows, 3, 8) == want


@pytest.mark.parametrize("seed,whole", [(1, 100_000), (2, 100_000), (3, 0), (4, 0)])
def test_random_trajectories(spark, seed, whole, monkeypatch):
    monkeypatch.setattr(trajectory, "WHOLE", whole)  # 0: every key is split by time
    rows = random_rows(seed, 30)
    o, links = frames(spark, rows)
    cands = state.candidates(o, links)
    moves = trajectory.transitions(cands, day(2), day(9)).cache()
    got = {(r["subject_ref"], r["predicate"], r["instant"], r["change"], r["before_object_ref"], r["after_object_ref"]) for r in moves.collect()}
    assert got == model_transitions(rows, day(2), day(9))
    by_id = {r[0]: r for r in rows}
    told = trajectory.material(cands, moves, day(2), day(9)).collect()
    for r in told:
        row = by_id[r["obs_id"]]
        assert (row[2], row[3], row[5]) == (r["subject_ref"], r["predicate"], r["object_ref"])
        assert r["outcome"] != "resolved" or r["cls"] == "s"
    for m in moves.collect():
        own = [r for r in told if all(r[c] == m[c] for c in ("subject_ref", "predicate", "instant"))]
        for side in ("before", "after"):
            values = {r["object_ref"] for r in own if r["side"] == side}
            if m[f"{side}_outcome"] == "resolved":
                assert values == {m[f"{side}_object_ref"]}
            else:
                assert bool(values) == (m[f"{side}_outcome"] is not None)


@pytest.mark.parametrize("whole", [100_000, 0])
def test_one_key_with_very_many_rows(spark, whole, monkeypatch):
    """A key that holds most rows is split by time, for overlaps and for transitions, with the plain rule's results."""
    monkeypatch.setattr(state, "WHOLE", whole)
    rows = [obs(i, "p", "xyz"[i % 3], "interval", i * 3, i * 3 + (4 if i == 77 else 3)) for i in range(400)]
    assert outcomes(spark, rows, 0, 2000) == model_window(rows, day(0), day(2000))
    rows[77] = obs(77, "p", "y", "interval", 231, 234)
    assert outcomes(spark, rows, 0, 2000) == model_window(rows, day(0), day(2000))
    assert {v[0] for v in outcomes(spark, rows, 0, 2000).values()} == {"multiple-states-in-window"}


def test_several_selections_in_one_pass(spark):
    rows = [(f"{s}{r[0]}", *r[1:]) for s in range(10) for r in random_rows(s, 8)]
    o, links = frames(spark, rows)
    cands = state.candidates(o, links)
    spread, eligible, uncertain = state.labelled(cands, {"a": ta.in_window(lit(1), lit(5)), "b": ta.in_window(lit(4), lit(9))})
    keys = state.aggregate(spread, eligible, uncertain, sel=["label"])[2].collect()
    for label, lo, hi in (("a", 1, 5), ("b", 4, 9)):
        assert {(r["subject_ref"], r["predicate"]): (r["outcome"], r["object_ref"]) for r in keys if r["label"] == label} == model_window(rows, day(lo), day(hi))


def test_causal_keeps_rejected_and_drops_uncertain(spark):
    rows = [obs(1, schema.CAUSES, "b", "interval", 0, 5, status="rejected"), obs(2, schema.CAUSES, "b", "instant", 1, None), obs(3, schema.CAUSES, "c", "window", 0, 5), obs(4, "other", "b", "interval", 0, 5)]
    o, links = frames(spark, rows, unsupported={"o2"})
    got = causal.in_order(causal.causal_links(o, links, day(0), day(9))).collect()
    assert [(r["effect_ref"], r["n_observations"], r["n_supporting"], r["n_contradicting"], r["first_bound"]) for r in got] == [("b", 2, 1, 1, day(0))]
