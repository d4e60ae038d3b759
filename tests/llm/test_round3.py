"""Fill-in-middle, funnels and decontamination against plain rules, and on odd rows and tables."""

import datetime
import hashlib
import random
import re
from bisect import bisect_right
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from evidentia.llm import decontam, funnel
from evidentia.llm.decontam import contaminated
from evidentia.llm.fim import SENTINELS, Units, fill_in_middle, restored
from evidentia.llm.funnel import Funnel, funnel_counts

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "The cat sat, on the mat"), (5, "x" * 5000), (6, "日本 é́😀 <|endoftext|> \x00\x1c"), (7, "a <P> b"), (8, "<S><P><M>"), (9, "<<P" + "z" * 9 + "S>"), (10, "one"), (10, "one"), (10, "two three"),
    (None, "no id"), (None, None), (11, "\n\nlines\r\n" * 50), (12, "1234567890" * 20),
]
CLASH = ["text_crc32", "n", "form", "output", "cut", "h1", "h3", "digest", "id", "item", "spans", "items", "n_words", "window", "shingle", "place", "slot", "part", "at", "own", "client", "link", "next", "unit", "funnel", "dense"]


def with_clashes(df):
    return df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASH) if c not in df.columns))


def odd(spark, rows=None):
    return with_clashes(spark.createDataFrame(ODD if rows is None else rows, "doc_id long, text string"))


def pieces(rnd, n):
    return "".join(rnd.choice(["a", "Z", "P", "S", "M", "<", ">", " ", "1", "é", "\n", "日", "😀", "<P>", "<M>", "word"]) for _ in range(rnd.randrange(n)))


def test_units_are_those_of_the_pattern():
    rnd = random.Random(3)
    for _ in range(3000):
        text = pieces(rnd, 30)
        units, found = Units(text), UNIT.findall(text)
        assert units.n == len(found) and units.sentinel == any(s in text for s in SENTINELS)
        assert [units.end_of(r) for r in range(len(found) + 1)] == [len("".join(found[:r])) for r in range(len(found) + 1)]


def fim(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by the plain rule."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = UNIT.findall(text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(s in text for s in SENTINELS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle(spark):
    rnd = random.Random(4)
    rows = ODD + [(i, pieces(rnd, 60)) for i in range(100, 400)] + [(900 + i, "word, " * 150_000) for i in range(5)]
    out = fill_in_middle(odd(spark, rows)).withColumn("back", restored(F.col("output"), F.col("form")))
    got = Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in out.collect())
    assert got == Counter((i, *fim(i, t), t or "") for i, t in rows)
    assert {k[2] for k in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(odd(spark, [])).collect() == []


def hits(text, items, window):
    """(words, hit words, items) by the plain rule."""
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    hit, named = set(), set()
    for item, other in items:
        own = WORD.findall((other or "").translate({c: c + 32 for c in range(65, 91)}))
        m = min(len(own), window)
        windows = {tuple(own[i : i + m]) for i in range(len(own) - m + 1)} if m else set()
        for i in range(len(words) - m + 1) if m else ():
            if tuple(words[i : i + m]) in windows:
                hit |= set(range(i, i + m))
                named.add(item)
    return len(words), sorted(hit), sorted(str(x) for x in named if x is not None)


def test_contaminated(spark, monkeypatch):
    rnd = random.Random(6)
    say = lambda n: "".join(rnd.choice(["a ", "b ", "b, ", "Cc-", "longerthaneight ", "é_", "日本 ", "7\n"]) for _ in range(n))
    items = [(i, say(rnd.choice([0, 1, 2, 3, 5, 9, 10, 11, 25]))) for i in range(40)] + [(3, say(12)), (None, say(8)), (50, None), (51, ""), (52, "..."), (10, say(6))]
    items += [(60 + i, items[5][1]) for i in range(5)]
    rows = [(i, say(rnd.randrange(40))) for i in range(150)] + [(200 + i, say(9) + items[rnd.randrange(len(items))][1].__str__() + " " + say(5)) for i in range(100)] + ODD
    rows += [(300, say(30_000) + items[7][1]), (301, rows[0][1]), (301, rows[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").select("*", F.lit(1).alias("item"), F.lit(2).alias("window"), F.lit(3).alias("block"))
    for window, block in ((4, 1 << 18), (10, 1 << 18), (4, 60)):
        got = Counter((r["doc_id"], r["n_words"], tuple(x for s in r["spans"] for x in range(s["begin"], s["end"])), tuple(r["items"]), r["n_hit"]) for r in contaminated(odd(spark, rows), bench, window=window, block=block).collect())
        want = Counter()
        for i, t in rows:
            n, hit, named = hits(t, items, window)
            want[i, n, tuple(hit), tuple(named), len(hit)] += 1
        assert got == want
        assert sum(n for k, n in want.items() if k[4]) > 30
    none = contaminated(odd(spark), bench.limit(0)).collect()
    assert len(none) == len(ODD) and all(r["n_hit"] == 0 and r["items"] == [] and r["spans"] == [] for r in none)
    assert contaminated(odd(spark, []), bench).collect() == []


FUNNELS = [Funnel("A", ("view", "click", "view", "purchase"), "error"), Funnel("B", ("signup", "view", "click", "purchase"), "error"), Funnel("C", ("click", "click", "purchase", "view"), "signup"), Funnel("D", ("view", "view"), "click")]


def funnels_by_rule(rows, within):
    at = defaultdict(set)
    for c, k, t in rows:
        if None not in (c, k, t):
            at[c, k].add(t)
    at = {k: sorted(v) for k, v in at.items()}

    def later(c, k, t):
        own = at.get((c, k), [])
        i = bisect_right(own, t)
        return own[i] if i < len(own) else None

    out = {}
    for f in FUNNELS:
        for c in {c for c, k in at if k == f.steps[0]}:
            n, times = [0] * 4, [[] for _ in range(4)]
            for t in at[c, f.steps[0]]:
                n[0] += 1
                for s in range(1, len(f.steps)):
                    b, e = later(c, f.steps[s], t), later(c, f.excluded, t)
                    if b is None or b - t > within or (e is not None and e <= b):
                        break
                    n[s] += 1
                    times[s].append(b - t)
                    t = b
            deepest = max(s + 1 for s in range(4) if n[s])
            out[f.name, c] = (*n, deepest, *[sorted(x)[(len(x) + 1) // 2 - 1] if x else None for x in times[1:]])
    depths = Counter((k[0], v[4]) for k, v in out.items())
    return {k: (*v, depths[k[0], v[4]]) for k, v in out.items()}


def clicks(spark, rows):
    start = datetime.datetime(1970, 1, 1)
    made = [(c, k, None if t is None else start + datetime.timedelta(microseconds=t)) for c, k, t in rows]
    return with_clashes(spark.createDataFrame(made, "client_id long, kind string, ts timestamp_ntz"))


def test_funnels(spark, monkeypatch):
    monkeypatch.setattr(funnel, "CHUNK", 50)
    rnd = random.Random(5)
    for span, within, dense in ((200_000_000, 9_000_000, 1 << 18), (2_000_000, 900_000, 5), (20_000, 64, 3)):
        rows = []
        for _ in range(1500):
            kind = rnd.choice(["view", "view", "click", "click", "purchase", "error" if rnd.random() < 0.3 else "view", "signup", "other", None])
            t = rnd.randrange(-span, span)
            rows.append((rnd.choice([1, 1, 1, 2, 3, None, 4]), kind, rnd.choice([t, t // 1000 * 1000]) if rnd.random() < 0.98 else None))
        rows += rows[:100]
        got = {(r["funnel"], r["client_id"]): tuple(r)[2:] for r in funnel_counts(clicks(spark, rows), FUNNELS, within=within, dense_rows=dense).collect()}
        assert got == funnels_by_rule(rows, within)
        assert any(v[3] for v in got.values())


def test_funnels_of_odd_tables(spark):
    assert funnel_counts(clicks(spark, []), FUNNELS).collect() == []
    assert funnel_counts(clicks(spark, [(None, "view", 1), (1, None, 1), (1, "view", None), (1, "error", 5)]), FUNNELS).collect() == []
    # rows at one microsecond don't follow each other; a step at just 15 minutes is reached, an exclusion at the step's own time bars it
    m = 900_000_000
    rows = [(1, "view", 0), (1, "click", 0), (2, "view", 0), (2, "click", m), (3, "view", 0), (3, "click", m + 1), (4, "view", 0), (4, "click", 9), (4, "error", 9), (5, "view", 0), (5, "error", 0), (5, "click", 9), (5, "error", 10)]
    got = {r["client_id"]: (r["n1"], r["n2"], r["deepest"], r["t2"]) for r in funnel_counts(clicks(spark, rows), FUNNELS).where("funnel = 'A'").collect()}
    assert got == {1: (1, 0, 1, None), 2: (1, 1, 2, m), 3: (1, 0, 1, None), 4: (1, 0, 1, None), 5: (1, 1, 2, 9)}
    named = clicks(spark, rows).withColumn("client_id", F.concat(F.lit("c"), "client_id"))
    assert {r["client_id"] for r in funnel_counts(named, FUNNELS).collect()} == {"c1", "c2", "c3", "c4", "c5"}


def test_shingles_of_all_widths_are_counted():
    words = decontam.Words([b"a b c", b"A"])
    assert len(words.shingles(1)) == 4 and words.hash[0] == words.hash[3] and words.joined(0, 3) == b"a b c"


def test_pipeline_stages_take_any_columns_and_no_rows(spark, tmp_path):
    """Columns named like the stages' own, in a stored table and a made one, come out as they went in; empty tables stay empty."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    names = ["_row", "_in", "_file", "_place", "_number", "_metadata", "_id", "_group", "row", "id", "n", "cid", "_ROW_"]
    words = "the cat sat on the mat and the dog lay by the door of the old house near the river"
    rows = [(1, words), (1, words), (2, f"{words} today"), (None, words), (3, None), (4, "")]
    made = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("en").alias("lang"), F.lit("s").alias("source"), *(F.lit(f"v{i}").alias(c) for i, c in enumerate(names)))
    made.write.parquet(str(tmp_path / "docs"))
    for docs in (made, spark.read.parquet(str(tmp_path / "docs"))):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            if name != "packing":
                assert out.columns == docs.columns, name
                assert all(r[c] == f"v{i}" for r in out.collect() for i, c in enumerate(names)), name
            else:
                assert Counter(r["doc_id"] for r in out.collect()) == Counter(i for i, _ in rows)
            none = stage(spark, docs.limit(0), sf)
            assert none.collect() == [] and (name == "packing" or none.columns == docs.columns), name


def test_packing_of_rows_that_are_alike(spark):
    """Rows without ids and with one text each have a place of their own, though nothing tells them apart."""
    from public_tokenizers import path

    from evidentia.llm.packing import Limits, pack

    rows = odd(spark, [(None, "a b c")] * 400 + [(7, "a b c")] * 300 + [(None, None)] * 200)
    out = pack(rows, path("word_bpe_49k.json"), limits=Limits(tokens=64)).collect()
    assert Counter(r["doc_id"] for r in out) == Counter({None: 600, 7: 300})
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        held.sort()
        assert held[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(held, held[1:], strict=False)) and held[-1][0] + held[-1][1] <= 64
