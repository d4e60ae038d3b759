"""The corpus operators against brute force, libraries and round trips, and on odd rows and tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from evidentia.llm import exact_dedup, hilbert_shards, language, near_dedup, packing, ppm, quality, sp_sampling, tiff, token_count
from evidentia.llm.components import components

SF = "/root/testdata/sf0.001"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
BYTE_BPE, WORD_BPE, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))

#: Nulls, empty and blank texts, repeated texts and rows, odd characters, a long word, a long text.
ODD = [
    (1, None, "en", "s"), (2, "", "en", None), (3, " \t\n", None, "s"), (4, "the cat sat on the mat", "en", "s"), (5, "the  cat sat\non the mat", "de", "s"), (6, "The CAT sat on the mat", "en", "s"),
    (7, "x" * 5000, "en", "s"), (8, "日本 é́😀 ▁ <|endoftext|> \x00\x1c", None, None), (9, "word " * 4000, "fr", "t"), (10, "one", "fr", "t"), (10, "one", "fr", "t"), (None, "no id", None, None), (11, "two words", "es", "s"),
    (12, "the cat sat on the mat", "en", "s"),
]
CLASH = ["text_crc32", "size", "shard", "cell", "bucket", "keep_id", "kept", "norm", "h", "id", "n", "score", "rank", "length", "pages", "key", "block", "held_out", "component", "fp"]


def odd(spark, rows=None):
    df = spark.createDataFrame(ODD if rows is None else rows, "doc_id long, text string, lang string, source string")
    return df.select("*", *(F.lit(i).alias(c) for i, c in enumerate(CLASH)))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (7, 0, 0), (9, 0, 0), (6, 1, 0), (None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "exact": lambda df: exact_dedup.exact_groups(df), "near": lambda df: near_dedup.near_duplicates(df, width=3, similar=(85, 100)), "shards": lambda df: hilbert_shards.hilbert_shards(df),
    "tokens": lambda df: token_count.token_counts(df, BYTE_BPE), "ppm": lambda df: ppm.ppm_scores(df), "pack": lambda df: packing.pack(df, WORD_BPE), "lang": lambda df: language.languages(df),
    "quality": lambda df: quality.quality_scores(df, labels(df.sparkSession)), "tiff": lambda df: tiff.tiff_files(tiff.store_payloads(df)).drop("media", "pages"),
    "pieces": lambda df: sp_sampling.sample_pieces(df, PIECES, decode=True),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_tables(spark, name):
    rows = OPERATORS[name](odd(spark)).collect()
    if name == "pack":
        assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(r[0] for r in ODD)
    else:
        assert Counter(r["doc_id"] for r in rows) == Counter(r[0] for r in ODD)
    assert OPERATORS[name](odd(spark, [])).collect() == []


def test_large_ids_beside_null_ids(spark):
    """Ids that floating point can't hold, in one batch with a null id, come back as they are."""
    big = 2**60 + 1
    df = odd(spark, [(big, "the cat sat", "en", "s"), (None, "the cat sat", "en", "s"), (big + 2, "le chat", "fr", "s")]).coalesce(1)
    for name, operator in OPERATORS.items():
        assert Counter(r["doc_id"] for r in operator(df).collect()) == Counter([big, None, big + 2]), name


def test_values_of_odd_rows(spark):
    """What null, empty, blank and repeated rows give, operator by operator."""
    by = lambda name: {r["doc_id"]: r for r in OPERATORS[name](odd(spark)).collect()}
    tokens, packed, shards, ppm_, pieces, exact, near, lang, grade = map(by, ("tokens", "pack", "shards", "ppm", "pieces", "exact", "near", "lang", "quality"))
    for i in (1, 2):
        assert (tokens[i]["n_bytes"], tokens[i]["n_tokens"], tokens[i]["over_limit"]) == (0, 0, False)
        assert (packed[i]["piece"], packed[i]["start"], packed[i]["length"], packed[i]["ids_crc32"]) == (0, 0, 1, zlib.crc32(np.array([1], "<u4").tobytes()))
        assert (shards[i]["size"], shards[i]["text_crc32"]) == (1, 0)
        assert (ppm_[i]["n_tokens"], ppm_[i]["n_known"]) == (1, 1) and -20 < ppm_[i]["score"] < 0
        assert (pieces[i]["n_bytes"], pieces[i]["n_pieces"], bytes(pieces[i]["decoded"])) == (0, 1, b"")
        assert (near[i]["n_shingles"], near[i]["component_id"], near[i]["kept"]) == (0, i, True)
        assert (lang[i]["lang_pred"], lang[i]["score"]) == ("und", 0.0) and 0 <= grade[i]["score"] <= 1
    assert near[3]["n_shingles"] == 0 and ppm_[3]["n_tokens"] == 1 and lang[3]["lang_pred"] == "und"
    assert (exact[1]["keep_id"], exact[1]["group_size"], exact[2]["keep_id"], exact[2]["kept"]) == (1, 2, 1, False)
    assert exact[3]["keep_id"] == 3 and exact[3]["text_sha256"] == hashlib.sha256(b" ").hexdigest()
    assert exact[10]["group_size"] == 2 and exact[10]["kept"] and exact[None]["keep_id"] is None and exact[None]["kept"]
    assert (near[None]["component_id"], near[None]["kept"], near[None]["n_shingles"]) == (None, False, 1)
    assert ppm_[4]["score"] == ppm_[6]["score"] and grade[4]["score"] == grade[12]["score"]
    files = {r["doc_id"]: r for r in tiff.tiff_files(tiff.store_payloads(odd(spark)), joined=True).collect()}
    for i in (1, 2):
        assert bytes(files[i]["payload"]) == b" " * 192 and files[i]["error"] is None and files[i]["n_bytes"] == 0


def test_long_texts(spark):
    """Texts of a megabyte, with and without spaces, go through every operator whole."""
    rnd = random.Random(8)
    words = [f"w{rnd.randrange(5000)}" for _ in range(180_000)]
    rows = [(0, " ".join(words), "en", "s"), (1, " ".join(words[:-1]), "en", "s"), (2, "".join(rnd.choice("abcdefghij") for _ in range(1_000_000)), "xx", "s"), (3, "日本語" * 120_000, "ja", "s"), (4, "short text", "en", "s")]
    df = odd(spark, rows)
    sizes = {r[0]: len(r[1].encode()) for r in rows}
    got = {r["doc_id"]: r for r in OPERATORS["near"](df).collect()}
    assert [got[i]["component_id"] for i in range(5)] == [0, 0, 2, 3, 4] and got[0]["n_shingles"] > 170_000
    lib = Tokenizer.from_file(BYTE_BPE)
    assert {r["doc_id"]: r["n_tokens"] for r in OPERATORS["tokens"](df).collect()} == {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t, *_ in rows}
    assert all(bytes(r["decoded"]).decode() == rows[r["doc_id"]][1] for r in OPERATORS["pieces"](df).collect())
    files = tiff.tiff_files(tiff.store_payloads(df), joined=True).collect()
    assert all(bytes(r["payload"])[: sizes[r["doc_id"]]] == rows[r["doc_id"]][1].encode() for r in files)
    starts = defaultdict(list)
    for r in OPERATORS["pack"](df).collect():
        starts[r["doc_id"]].append((r["start"], r["length"]))
    assert all([s for s, _ in sorted(x)] == list(range(0, sum(n for _, n in x), 4096)) for x in starts.values())
    assert {r["size"] for r in OPERATORS["shards"](df).collect()} == {n + 1 for n in sizes.values()}
    assert all(r["score"] < 0 for r in OPERATORS["ppm"](df).collect()) and len(OPERATORS["exact"](df).collect()) == 5
    assert len(OPERATORS["lang"](df).collect()) == len(OPERATORS["quality"](df).collect()) == 5


def patterned():
    """Two words of 1,024 letters that any polynomial over 64 bits with an odd base hashes alike."""
    one = "".join("ab"[i.bit_count() % 2] for i in range(1024))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_words_of_patterned_letters_differ(spark):
    from evidentia.llm.common import LONG_WORD, word_hashes

    one, two = patterned()
    rows = [(1, one, "en", "s"), (2, two, "en", "s")]
    assert [r["component_id"] for r in sorted(OPERATORS["near"](odd(spark, rows)).collect(), key=lambda r: r["doc_id"])] == [1, 2]
    scores = {r["doc_id"]: r["n_known"] for r in ppm.ppm_scores(odd(spark, rows), held_out=lambda c: c == 2).collect()}
    assert scores == {1: 2, 2: 1}
    texts = [b"One  two", b"", b" ", b"x" * (LONG_WORD + 1) + b" " + b"X" * (LONG_WORD + 1), b"abcdefgh abcdefghi abcdefg\0"]
    h, n = word_hashes(texts)
    words = [w.lower() for t in texts for w in WORD.findall(t)]
    assert n.tolist() == [len(WORD.findall(t)) for t in texts] and [[a == b for b in words] for a in words] == [[a == b for b in h.tolist()] for a in h.tolist()]


def test_near_duplicates_of_repeated_ids(spark):
    """An id with several texts has the links of each of them; a null id has none, nor has a row without words."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(3, a), (5, a + " end"), (5, b), (9, b + " end"), (9, b + " end"), (11, c), (None, a), (None, None), (12, None), (12, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df, width=3, similar=(85, 100)).collect())
    assert got == Counter([(3, 3, True), (5, 3, False), (5, 3, False), (9, 3, False), (9, 3, False), (11, 11, True), (None, None, False), (None, None, False), (12, 12, True), (12, 11, False)])


def test_ppm_all_held_out(spark):
    rows = ppm.ppm_scores(odd(spark), held_out=lambda c: F.lit(True)).collect()
    assert len(rows) == len(ODD) and {(r["n_known"], r["train_tokens"]) for r in rows} == {(0, 0)}
    for r in rows:
        n = {x[0]: len((x[1] or "").encode()) for x in ODD}[r["doc_id"]]
        assert r["score"] == pytest.approx(-(n + 1) * math.log10(256)) and r["base_score"] == pytest.approx(0, abs=1e-12)


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for a, b in edges for x in (a, b) if a != b}


def test_exact_with_weak_hash(spark):
    rows = [(i, random.Random(i % 7).choice(["a b", "a  b", "c", "d\te", ""]) + str(i % 3), None, None) for i in range(60)]
    got = exact_dedup.exact_groups(odd(spark, rows), text_hash=lambda c: F.octet_length(c)).collect()
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t)].append(i)
    want = {(i, min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    assert {tuple(r) for r in got} == want


def test_curve_is_hilberts():
    for dims in (2, 3):
        cells = hilbert_shards.curve(2, dims)
        assert sorted(cells) == list(range(4**dims))
        place = {h: [c >> 2 * (dims - 1 - d) & 3 for d in range(dims)] for c, h in enumerate(cells)}
        assert all(sum(abs(x - y) for x, y in zip(place[i], place[i + 1], strict=True)) == 1 for i in range(4**dims - 1))


def test_shards(spark, docs, texts):
    rows = hilbert_shards.hilbert_shards(docs).collect()
    by = defaultdict(list)
    for r in rows:
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
        by[r["shard"]].append(r)
    assert set(by) == set(range(8)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    last = -1
    for s in range(8):
        part = sorted(by[s], key=lambda r: r["slot"])
        assert [r["slot"] for r in part] == list(range(len(part)))
        for r in part:
            assert r["hilbert"] >= last
            last = r["hilbert"]


def test_shards_against_a_sort(spark, docs, texts):
    """The same cells and order as a sort of all rows makes by the plain rule, and what the runs prune."""
    rows = {r["doc_id"]: r for r in hilbert_shards.hilbert_shards(docs).collect()}
    given = {r["doc_id"]: r for r in docs.collect()}
    n = len(given)

    def step_of(column):
        every = sorted((r[column] is not None, r[column] or "") for r in given.values())
        return {v: every.index(v) * 16 // n for v in set(every)}

    lang, source = step_of("lang"), step_of("source")
    curve = hilbert_shards.curve()
    for i, r in given.items():
        at = (lang[(r["lang"] is not None, r["lang"] or "")], source[(r["source"] is not None, r["source"] or "")], min(15, (len(texts[i].encode()) + 1).bit_length() - 1))
        assert (rows[i]["lang_step"], rows[i]["source_step"], rows[i]["size_step"]) == at and rows[i]["hilbert"] == curve[at[0] << 8 | at[1] << 4 | at[2]]
    order = sorted(rows.values(), key=lambda r: (r["shard"], r["slot"]))
    assert [r["hilbert"] for r in order] == sorted(r["hilbert"] for r in order)
    assert [r["shard"] for r in order] == [p * 8 // n for p in range(n)]
    seen = {}
    for k, r in enumerate(order):  # equal texts of a cell are neighbours
        key = (r["hilbert"], texts[r["doc_id"]])
        assert seen.get(key, k - 1) == k - 1
        seen[key] = k
    for column in ("lang", "source"):
        for value in {r[column] for r in given.values()}:
            held = {rows[i]["shard"] for i, r in given.items() if r[column] == value}
            spans = defaultdict(list)
            for i, r in given.items():
                spans[rows[i]["shard"]].append(r[column] or "")
            read = {s for s, v in spans.items() if min(v) <= (value or "") <= max(v)}
            assert held <= read  # least and largest value of a file never hide a row
    files = defaultdict(list)
    for i, r in given.items():
        files[rows[i]["shard"]].append(r["lang"] or "")
    skipped = sum(not min(v) <= x <= max(v) for x in {r["lang"] or "" for r in given.values()} for v in files.values())
    assert skipped >= 8, skipped  # of four languages and eight files


def test_shards_split_a_hot_text(spark):
    rows = [(i, "copy" if i % 3 else f"text {i}", "en", "s") for i in range(900)] + [(None, None, None, None)] * 40
    out = hilbert_shards.hilbert_shards(odd(spark, rows)).collect()
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
    assert sorted(map(len, by.values())) == [117] * 4 + [118] * 4 and all(sorted(v) == list(range(len(v))) for v in by.values())
    places = [k for k, r in enumerate(sorted(out, key=lambda r: (r["shard"], r["slot"]))) if r["doc_id"] is not None and r["doc_id"] % 3]
    assert places[-1] - places[0] + 1 == len(places) == 600


def test_shards_of_many_values(spark):
    """However many values a column has, a step is a range of them: the same steps as by a sort of all rows."""
    rnd = random.Random(9)
    rows = [(i, f"text {i}", f"l{rnd.randrange(6000):05d}" if i % 50 else None, "s" if i % 3 else "t") for i in range(9000)]
    out = {r["doc_id"]: r for r in hilbert_shards.hilbert_shards(odd(spark, rows)).collect()}
    assert sorted(Counter(r["shard"] for r in out.values()).values()) == [1125] * 8
    order = sorted(rows, key=lambda r: (r[2] is not None, r[2] or ""))
    before = {}
    for place, r in enumerate(order):
        before.setdefault(r[2], place)
    assert {i: r["lang_step"] for i, r in out.items()} == {r[0]: before[r[2]] * 16 // len(rows) for r in rows}
    assert {r["source_step"] for r in out.values()} == {0, sum(r[3] == "s" for r in rows) * 16 // len(rows)}


def strange():
    rnd = random.Random(1)
    pool = ["a", "b", " ", "  ", "\n", "'s", "é", "É", "İ", "ß", "中", "١", "1", "!", "<|endoftext|>", "\x1c", "\x85", "\xa0", "e", "́", "😀", "the", "aaaa", "Σ", "_", "\r\n", "’s", "﻿"]
    return ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 30))) for _ in range(3000)] + ["a" * 4000, "ab" * 2000, " " * 500]


def test_token_counts_as_the_library(texts):
    all_ = [*texts.values(), *strange()]
    want = [len(e.ids) for e in Tokenizer.from_file(BYTE_BPE).encode_batch(all_, add_special_tokens=False)]
    assert token_count.Counter(BYTE_BPE, ("<|endoftext|>",)).count(all_).tolist() == want


def test_word_ids_as_the_library(texts):
    all_ = [*texts.values(), *strange()]
    flat, counts = packing.WordIds(WORD_BPE).ids(all_)
    want = [e.ids for e in Tokenizer.from_file(WORD_BPE).encode_batch(all_, add_special_tokens=False)]
    assert counts.tolist() == list(map(len, want)) and flat.tolist() == [i for ids in want for i in ids]


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("documents", [4096, 5])
def test_best_fit_plan(rule, documents):
    rnd = np.random.default_rng(5)
    for n in (1, 40, 3000):
        lengths = np.minimum(100, rnd.lognormal(3, 1, n).astype(int) + 1)
        limits = packing.Limits(tokens=100, documents=documents, attention=10_000, rule=rule)
        u, c = np.unique(lengths, return_counts=True)
        plan = packing.best_fit(dict(zip(u.tolist(), c.tolist(), strict=True)), limits)
        rank = np.empty(n, np.int64)
        seen = Counter()
        for i, x in enumerate(lengths.tolist()):
            rank[i] = seen[x]
            seen[x] += 1
        bins, offsets = plan.place(lengths, rank)
        held = defaultdict(list)
        for b, o, x in zip(bins.tolist(), offsets.tolist(), lengths.tolist(), strict=True):
            held[b].append((o, x))
        assert set(held) == set(range(plan.bins))
        for part in held.values():
            part.sort()
            assert [o for o, _ in part] == np.cumsum([0, *(x for _, x in part)])[:-1].tolist()
            assert sum(x for _, x in part) <= 100 and len(part) <= documents and sum(x * x for _, x in part) <= 10_000
        if documents > 100:
            assert plan.bins <= math.ceil(lengths.sum() / 100) * 1.06 + 1


def plain_best_fit(lengths, limits):
    """Vector best-fit decreasing piece by piece: the feasible bin with the least weighted residual norm after it."""
    cap = (limits.tokens, limits.documents, limits.attention)
    bins = []
    for x in sorted(lengths, reverse=True):
        need, best = (x, 1, x * x), None
        for i, room in enumerate(bins):
            if all(r >= n for r, n in zip(room, need)):
                norm = sum(w * ((r - n) / c) ** 2 for w, r, n, c in zip(limits.weights, room, need, cap))
                if best is None or norm < best[0]:
                    best = (norm, i)
        if best is None:
            bins.append(cap)
            best = (0, len(bins) - 1)
        bins[best[1]] = tuple(r - n for r, n in zip(bins[best[1]], need))
    return Counter(bins)


#: Limits of which one, two or all three bind, and weights under which another capacity leads.
TIGHT = {
    "tokens": packing.Limits(tokens=100, documents=4096, attention=10**9), "documents": packing.Limits(tokens=100, documents=3, attention=10**9),
    "attention": packing.Limits(tokens=100, documents=4096, attention=10_000, weights=(0.01, 0.01, 1.0)),
    "all": packing.Limits(tokens=100, documents=6, attention=10_000, weights=(1.0, 1.0, 1.0)), "by documents": packing.Limits(tokens=100, documents=6, attention=10_000, weights=(0.01, 1.0, 0.01)),
}


def planned(lengths, limits):
    """Residual capacities of each bin of the plan."""
    u, c = np.unique(lengths, return_counts=True)
    plan = packing.best_fit(dict(zip(u.tolist(), c.tolist(), strict=True)), limits)
    seen, rooms = Counter(), defaultdict(lambda: (limits.tokens, limits.documents, limits.attention))
    for x in lengths:
        b, _ = plan.place(np.array([x]), np.array([seen[x]]))
        seen[x] += 1
        rooms[int(b[0])] = tuple(r - n for r, n in zip(rooms[int(b[0])], (x, 1, x * x)))
    return Counter(rooms.values()), plan.bins


@pytest.mark.parametrize("name", TIGHT)
def test_best_fit_against_one_piece_at_a_time(name):
    rnd = np.random.default_rng(7)
    for n in (1, 30, 400):
        lengths = np.minimum(100, rnd.lognormal(2.6, 0.9, n).astype(int) + 1).tolist()
        got, bins = planned(lengths, TIGHT[name])
        want = plain_best_fit(lengths, TIGHT[name])
        assert got == want and bins == sum(want.values())
        assert all(min(room) >= 0 for room in got)


def test_every_capacity_can_decide():
    """Each limit alone forces more bins than the tokens do, and the weights change which bin a piece takes."""
    lengths = [60, 50, 40, 30, 20, 10] + [2] * 30
    free = planned(lengths, packing.Limits(tokens=100, documents=4096, attention=10_000))[1]
    assert planned(lengths, packing.Limits(tokens=100, documents=4, attention=10_000))[1] >= math.ceil(len(lengths) / 4) > free
    rnd = np.random.default_rng(3)
    differ = Counter()
    for _ in range(20):
        lengths = np.minimum(100, rnd.lognormal(2.8, 1.3, 60).astype(int) + 1).tolist()
        rooms = [planned(lengths, packing.Limits(tokens=100, documents=5, attention=10_000, weights=w))[0] for w in ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))]
        differ.update(i for i in (1, 2) if rooms[i] != rooms[0])
    assert min(differ[1], differ[2]) >= 5, differ


def test_pack_under_all_limits(docs):
    """The whole operator with tight limits on documents: every sequence keeps all three, few more bins than the bound."""
    limits = packing.Limits(tokens=4096, documents=4, attention=4096 * 4096, weights=(1.0, 1.0, 0.2))
    rows = packing.pack(docs, WORD_BPE, limits=limits).collect()
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append(r["length"])
    assert all(sum(x) <= 4096 and len(x) <= 4 and sum(n * n for n in x) <= 4096**2 for x in held.values())
    bound = max(math.ceil(sum(r["length"] for r in rows) / 4096), math.ceil(len(rows) / 4))
    assert bound <= len(held) <= bound * 1.25
    assert len(held) > math.ceil(sum(r["length"] for r in rows) / 4096)  # the documents' limit decides here


def test_pack_documents(docs, texts):
    rows = packing.pack(docs, WORD_BPE).collect()
    lib = Tokenizer.from_file(WORD_BPE)
    by = defaultdict(dict)
    for r in rows:
        by[r["doc_id"]][r["piece"]] = r
    for i, t in texts.items():
        ids = [*lib.encode(t, add_special_tokens=False).ids, 1]
        for p in range(0, len(ids), 4096):
            part, r = ids[p : p + 4096], by[i].pop(p // 4096)
            assert (r["start"], r["length"], r["ids_crc32"]) == (p, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
        assert not by[i]
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for part in bins.values():
        part.sort()
        assert [o for o, _ in part] == np.cumsum([0, *(n for _, n in part)])[:-1].tolist() and sum(n for _, n in part) <= 4096
    assert len(bins) <= math.ceil(sum(r["length"] for r in rows) / 4096) + 1


def test_ppm_against_a_trie(docs, texts):
    got = {r["doc_id"]: r for r in ppm.ppm_scores(docs).collect()}
    low = {i: bytes(b + 32 if 65 <= b <= 90 else b for b in t.encode()) for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    trie, words = defaultdict(Counter), Counter()
    for i, t in low.items():
        if not held[i]:
            u = b"\xff" * ppm.ORDER + t + b"\xfe"
            for j in range(ppm.ORDER, len(u)):
                for k in range(ppm.ORDER + 1):
                    trie[u[j - k : j]][u[j]] += 1
            words.update(WORD.findall(t))
            words[None] += 1
    n, v = sum(words.values()), len(words)
    for i in list(texts)[:50]:
        u, score = b"\xff" * ppm.ORDER + low[i] + b"\xfe", 0.0
        for j in range(ppm.ORDER, len(u)):
            out = set()
            for k in range(ppm.ORDER, -1, -1):
                seen = trie.get(u[j - k : j])
                if not seen:
                    continue
                total, kinds = sum(c for x, c in seen.items() if x not in out), sum(x not in out for x in seen)
                if u[j] in seen:
                    score += math.log10((2 * seen[u[j]] - 1) / (2 * total))
                    break
                if kinds:
                    score += math.log10(kinds / (2 * total))
                out |= set(seen)
            else:
                score -= math.log10(256 - len(out))
        own = [*WORD.findall(low[i]), None]
        base = sum(math.log10((words[x] + 1) / (n + v + 1)) for x in own)
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(own), sum(words[x] > 0 for x in own), n)
        assert r["score"] == pytest.approx(score, rel=1e-9) and r["base_score"] == pytest.approx(base, rel=1e-9)


def test_ppm_is_a_distribution():
    paths = ppm.paths([b"abracadabra", b"banana band", b"cab"], ppm.ORDER)
    path, count = np.unique(paths, return_counts=True)
    code, n = np.unique(np.concatenate([ppm.paths([x], 2) for x in (b"abracadabra", b"banana band", b"cab")]), return_counts=True)
    low = ppm.Low.of(code, n)
    for ctx in {int(p) >> 8 for p in path} | {0x7A7A7A7A, 0x7A7A7A62}:
        mine = {int(p): c for p, c in zip(path, count, strict=True)}
        every = [ctx << 8 | s for s in range(256)]
        same = sorted(set(every) | {p for p in mine if (p >> 8) & 0xFFFFFF == ctx & 0xFFFFFF})
        lp = ppm.log_probabilities(np.array(same), np.array([mine.get(p, 0) for p in same]), low)
        assert sum(10**x for p, x in zip(same, lp, strict=True) if p >> 8 == ctx) == pytest.approx(1, abs=1e-9)


def labels_of(spark):
    return spark.read.parquet(f"{SF}/labels.parquet").collect()


def accuracy(rows, truth, name):
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    return sum(truth[r["doc_id"]] == r[name] for r in held) / len(held)


def test_quality_held_out(spark):
    sf = SF.replace("0.001", "0.01")
    marks = spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.quality_scores(spark.read.parquet(f"{sf}/documents.parquet"), marks).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert accuracy(rows, {r["doc_id"]: r["quality"] for r in marks.collect()}, "predicted") >= 0.97


def test_quality_stage_rejects_what_op6_rejects(spark):
    import corpus_pipeline
    from evidentia.llm.queries import QUERIES

    sf = SF.replace("0.001", "0.01")
    rows = QUERIES["op6_quality"](spark, sf).collect()
    out = corpus_pipeline.quality(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).collect()
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in rows if r["predicted"]}
    assert any(0.5 <= r["score"] < 0.7 for r in rows)


def plain_features(text):
    """The classifier's statistics by the plain rule, text by text."""
    raw = (text or "").encode()
    out = dict.fromkeys(quality.FEATURES, 0.0)
    if not raw:
        return list(out.values())
    kinds = {"lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "blank": (32, 9), "line": (10, 11, 12, 13), "stop": b".,;:'\"-()", "mark": b"!?"}
    kind = lambda b: next((k for k, v in kinds.items() if b in v), "high" if b > 127 else "control" if b < 32 or b == 127 else "sign")
    n = Counter(map(kind, raw))
    words, lines = WORD.findall(raw), [x for x in raw.split(b"\n") if x.strip()]
    lower = [w.lower() for w in words]
    out["log_bytes"] = math.log1p(len(raw))
    for k in n:
        out[f"share_{k}"] = n[k] / len(raw)
    letters = Counter(raw.lower())
    out["entropy"] = -sum(c / len(raw) * math.log2(c / len(raw)) for c in letters.values())
    out["upper_of_letters"] = n["upper"] / max(1, n["upper"] + n["lower"])
    out["signs_a_word"], out["marks_a_word"] = n["sign"] / max(1, len(words)), n["mark"] / max(1, len(words))
    out["mean_word"] = (len(raw) - n["blank"] - n["line"]) / max(1, len(words))
    if words:
        sizes = [len(w) for w in words]
        mean = sum(sizes) / len(sizes)
        out["spread_word"] = math.sqrt(sum((x - mean) ** 2 for x in sizes) / len(sizes))
        out["distinct_words"], out["top_word"] = len(set(lower)) / len(words), max(Counter(lower).values()) / len(words)
    if lines:
        out["repeated_lines"], out["mean_line"] = 1 - len(set(lines)) / len(lines), math.log1p(len(raw) / len(lines))
    return list(out.values())


def test_quality_against_a_plain_lookup(spark, docs, texts):
    """Scores of the query's own model equal the sum of its tables, looked up feature by feature and pair by pair."""
    marks = spark.read.parquet(f"{SF}/labels.parquet")
    got = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, marks).collect()}
    own = {r["doc_id"]: r["quality"] for r in marks.collect() if r["quality"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["doc_id"] in texts}
    x = {i: plain_features(t) for i, t in texts.items()}
    for i in list(texts)[:60]:
        assert np.allclose(quality.text_features([texts[i]])[0], x[i], atol=1e-9), i
    order = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    known = sorted(own, key=lambda i: order[i])
    model = quality.fit(quality.text_features([texts[i] for i in known]), np.array([own[i] for i in known], float))
    for i in list(texts)[:60]:
        bins = [sum(v >= e for e in edges) for v, edges in zip(x[i], model.edges, strict=True)]
        z = model.intercept + sum(t[b] for t, b in zip(model.tables, bins, strict=True))
        z += sum(t[bins[f]][bins[g]] for (f, g), t in zip(model.pairs, model.pair_tables, strict=True))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-6), i


def test_quality_without_labels(spark):
    rows = quality.quality_scores(odd(spark), labels(spark).where("false")).collect()
    assert {r["score"] for r in rows} == {0.5}


def test_additive_model_finds_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality.FEATURES)))
    y = ((x[:, 2] > 0.5) ^ (x[:, 7] > 0.5)).astype(float)
    model = quality.fit(x[:2000], y[:2000], rounds=30)
    assert (7, 2) in model.pairs and ((model.score(x[2000:]) > 0.5) == (y[2000:] > 0.5)).mean() > 0.95


def test_language_held_out(spark):
    df = spark.read.parquet(SF.replace("0.001", "0.01") + "/documents.parquet")
    rows = language.languages(df).collect()
    assert accuracy(rows, {r["doc_id"]: r["lang"] for r in df.collect()}, "lang_pred") >= 0.97
    got = {r["doc_id"]: r["lang_pred"] for r in language.languages(odd(spark)).collect()}
    assert got[1] == got[2] == got[3] == "und" and got[4] in ("en", "de", "fr", "es")


def test_language_stage_rejects_what_the_kernel_has_not_learnt(spark, docs, texts):
    import corpus_pipeline

    rnd = random.Random(1)
    strange = ["".join(rnd.choice("qwxzkjvbgpf") for _ in range(300)), "これは日本語の文章です。今日は天気がいいですね。", "Это русский текст, который ядро не учило."]
    more = spark.createDataFrame(list(enumerate(strange, 10**6)), "doc_id long, text string")
    out = corpus_pipeline.language(spark, docs.unionByName(more, allowMissingColumns=True), SF)
    assert {r["doc_id"] for r in out.collect()} == {i for i, t in texts.items() if language.has_letter(t)}


def test_letters():
    assert [language.has_letter(t) for t in (None, "", "12 ½ ² _ !", "1é", "中")] == [False, False, False, True, True]


def test_language_kernel_is_the_mean_cosine():
    raws = [b"the cat", b"der Hund da", b"le chat la"]
    k = language.fit(raws, ["en", "de", "fr"])
    grams = lambda r, n: {r.lower()[i : i + n] for i in range(len(r) - n + 1)}
    want = [[sum(len(grams(a, n) & grams(b, n)) / math.sqrt(len(grams(a, n)) * len(grams(b, n))) for n in (1, 2, 3)) / 3 for b in (raws[1], raws[0], raws[2])] for a in raws]
    assert np.allclose(k.block(raws), want, atol=1e-5)


def test_language_against_plain_regression(spark, docs, texts):
    """Predictions equal those of a kernel by sets of grams and a ridge regression solved as a dense system."""
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    spot = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    each, classes = 8, {}
    for i, t in texts.items():
        if t and lang[i] and zlib.crc32(str(i).encode()) % 3 != 1 and len(t.encode()) <= language.LEARNT_BYTES:
            key = (lang[i], spot[i] % each)
            classes[key] = min(classes.get(key, (1 << 63, 0)), (spot[i], i))
    known = [i for _, i in sorted(classes.values()) if language.has_letter(texts[i])]
    names = sorted({lang[i] for i in known})
    marks = [i for name in names for i in [j for j in known if lang[j] == name][:32]]

    def spread(code, k):  # the grams of three bytes are hashed to 2^17 columns
        return code if k < 3 else (code * 0x9E3779B1 & 0xFFFFFFFF) >> 15

    grams = {i: [frozenset(spread(int.from_bytes(w[j : j + k], "big"), k) for j in range(len(w) - k + 1)) for k in (1, 2, 3)] for i, w in ((i, bytes(b + 32 if 65 <= b <= 90 else b for b in t.encode())) for i, t in texts.items())}
    kernel = lambda a, b: sum(len(x & y) / math.sqrt(max(1, len(x)) * max(1, len(y))) for x, y in zip(grams[a], grams[b])) / 3
    k_nm, k_mm = (np.array([[kernel(a, b) for b in marks] for a in rows]) for rows in (known, marks))
    y = np.array([[1.0 if lang[i] == n else -1.0 for n in names] for i in known])
    weights = np.linalg.solve(k_nm.T @ k_nm + 1e-4 * len(known) * k_mm + 1e-8 * len(known) * np.eye(len(marks)), k_nm.T @ y)
    got = {r["doc_id"]: r for r in language.languages(docs, each=each).collect()}
    for i, t in list(texts.items())[:80]:
        if language.has_letter(t):
            f = np.array([kernel(i, b) for b in marks]) @ weights
            assert got[i]["score"] == pytest.approx(min(1, max(0, (f.max() + 1) / 2)), abs=2e-2) and (got[i]["lang_pred"] == names[int(f.argmax())] or np.diff(np.sort(f)[-2:])[0] < 0.02)


def test_language_sample_is_bounded(spark, docs, monkeypatch):
    """A dirty language column: the languages with most texts are learnt; long texts are predicted, not learnt from."""
    monkeypatch.setattr(language, "LANGUAGES", 3)
    dirty = docs.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("zz"), "doc_id")).otherwise(F.col("lang")))
    own = dirty.where("lang is not null and text is not null and pmod(crc32(cast(cast(doc_id as string) as binary)), 3) <> 1").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(3).collect()
    rows = language.languages(dirty).collect()
    assert len(rows) == docs.count() and {r["lang_pred"] for r in rows} - {"und"} <= {r["lang"] for r in own}


def near_truth(texts, width, num, den):
    sets = {}
    for i, t in texts.items():
        w = [x.lower() for x in WORD.findall(t.encode())]
        sets[i] = frozenset(tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))) if w else frozenset()
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and find(a) != find(b):
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def crowd(n, seed=0):
    """Texts around one theme, each with a few words changed: many alike, many only nearly."""
    rnd = random.Random(seed)
    theme = [f"w{rnd.randrange(400)}" for _ in range(120)]
    out = {}
    for i in range(n):
        w = list(theme)
        for _ in range(rnd.randrange(7)):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(5000)}"
        out[i] = " ".join(w)
    return out


@pytest.mark.parametrize("width,num", [(3, 85), (5, 80)])
def test_near_duplicates_against_all_pairs(spark, texts, width, num, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "NEEDED", 0)
    monkeypatch.setattr(near_dedup, "FEW", 4)
    all_ = texts | {i + 10_000: t for i, t in crowd(120).items()} | {20_000: "a b", 20_001: "A  b", 20_002: "a", 20_003: "b a"}
    df = spark.createDataFrame(list(all_.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df, width=width, similar=(num, 100)).collect()}
    assert got == near_truth(all_, width, num, 100)


def test_multi_index_meets_all_pairs_within():
    index = near_dedup.Index.plan(85, 100)
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 16, (400, index.symbols)).astype("<u2")
    b = a.copy()
    for row in b:
        row[rng.choice(index.symbols, index.within, replace=False)] ^= 1
    ka, kb = near_dedup.index_keys(a), near_dedup.index_keys(b)
    assert all(set(x) & set(y) for x, y in zip(ka.tolist(), kb.tolist(), strict=True))
    assert index.miss <= 1e-6


@pytest.mark.parametrize("num", [85, 80])
def test_pairs_that_share_a_key_are_left_out_by_the_whole_distance_only(num):
    import pandas as pd

    index = near_dedup.Index.plan(num, 100)
    s, n = num / 100, near_dedup.WIDE
    no_key = (1 - s**5 - 5 * (1 - s) * s**4) ** index.chunks
    far = sum(math.comb(n, k) * (1 - s) ** k * s ** (n - k) for k in range(index.wide_within + 1, n + 1))
    assert no_key + far <= index.miss + 1e-15 <= 1e-6
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, index.width, np.uint8)
    for change, stays in ((index.wide_within, True), (index.wide_within + 1, False)):
        # all symbols of the chunks but the first chunk's may differ, far more than `within`
        b = a.copy()
        chunked = min(change, index.symbols - near_dedup.CHUNK)
        b[2 * near_dedup.CHUNK : 2 * near_dedup.CHUNK + 2 * chunked : 2] ^= 1
        b[2 * index.symbols : 2 * index.symbols + change - chunked] ^= 1
        assert chunked > index.within
        pairs = pd.DataFrame({"a": [2], "b": [3], "sig_a": [a.tobytes()], "sig_b": [b.tobytes()]})
        assert sum(map(len, near_dedup._close(index)(iter([pairs])))) == stays
        member = lambda cid, sig: cid.to_bytes(8, "big") * 2 + (50).to_bytes(8, "big") + bytes(4) + sig.tobytes()
        key = near_dedup.index_keys(a[: 2 * index.symbols].copy().view("<u2")[None])[0].view(np.int64)[0]
        block = pd.DataFrame({"key": [key], "lead": [1], "parts": [1], "i": [0], "j": [0], "members": [[member(2, a), member(3, b)]]})
        assert sum(map(len, near_dedup._block_pairs(index)(iter([block])))) == stays


def test_tiff_codecs():
    rnd = random.Random(2)
    for n in (0, 1, 5, 300, 4000, 20000):
        for kinds in (1, 2, 10, 256):
            d = bytes(rnd.choices(range(kinds), k=n))
            assert tiff.lzw_decode(tiff.lzw_encode(d)) == d and tiff.packbits_decode(tiff.packbits_encode(d)) == d


def test_tiff_layouts_and_faults(spark):
    rng = np.random.default_rng(1)
    pages = [rng.integers(0, 9, (r, w, s), np.uint8) for r, w, s in ((1, 64, 3), (70, 40, 1), (256, 64, 3), (33, 33, 4))]
    for compression in (tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS):
        for predictor in (1, 2):
            for tiled in (False, True):
                data = tiff.write_tiff(pages, [(compression, predictor, tiled)] * 4)
                for want, (tags, image) in zip(pages, tiff.read_tiff(data), strict=True):
                    assert (image == want).all() and tags[tiff.COMPRESSION] == [compression]
    files = [(1, bytearray(data)), (2, None), (3, bytearray(b"II*\0\x08\0\0\0")), (4, bytearray(data[: len(data) // 2])), (5, bytearray(b"junk"))]
    rows = tiff.tiff_pages(spark.createDataFrame(files, "doc_id long, media binary").withColumn("width", F.lit(0))).collect()
    assert [r["page"] for r in sorted(rows, key=lambda r: (r["doc_id"], r["page"] or 0)) if r["doc_id"] == 1] == [0, 1, 2, 3]
    assert {r["doc_id"] for r in rows if r["error"]} == {2, 3, 4, 5}


def test_tiff_goes_on_after_an_unreadable_page(spark):
    import struct

    pages = [np.full((20, 16, 1), v, np.uint8) for v in (1, 2, 3)]
    data = tiff.write_tiff(pages, [(tiff.NONE, 1, False)] * 3)
    bits = [struct.pack("<HHIHH", tiff.BITS, 3, 1, n, 0) for n in (8, 16)]
    spot = data.index(bits[0], data.index(bits[0]) + 1)
    data = data[:spot] + bits[1] + data[spot + len(bits[1]) :]
    rows = tiff.tiff_pages(spark.createDataFrame([(1, bytearray(data))], "doc_id long, media binary")).collect()
    assert [(r["page"], bytes(r["data"])) for r in rows] == [(0, pages[0].tobytes()), (2, pages[2].tobytes())] and all(r["error"] for r in rows)


def plain_tiff(order, tags, blobs):
    """A TIFF of one page: tags as {tag: numbers}, its strips or tiles as given."""
    import struct

    out, tags = bytearray({"<": b"II", ">": b"MM"}[order] + struct.pack(order + "HI", 42, 0)), dict(tags)
    offsets = []
    for blob in blobs:
        offsets.append(len(out))
        out += blob
    where = (tiff.TILES, tiff.TILE_BYTES) if tiff.TILE_WIDTH in tags else (tiff.STRIPS, tiff.STRIP_BYTES)
    tags |= {where[0]: offsets, where[1]: [len(x) for x in blobs]}
    fields = []
    for tag, values in sorted(tags.items()):
        raw = struct.pack(f"{order}{len(values)}I", *values)
        if len(raw) > 4:
            spot = struct.pack(order + "I", len(out))
            out += raw
            raw = spot
        fields.append(struct.pack(order + "HHI", tag, 4, len(values)) + raw)
    out[4:8] = struct.pack(order + "I", len(out))
    return bytes(out + struct.pack(order + "H", len(fields)) + b"".join(fields) + bytes(4))


def test_tiff_fixed_streams():
    """Streams written out by hand: the PackBits example of its note, the LZW example of the format's text."""
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    assert tiff.packbits_decode(packed) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    stream = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.lzw_decode(stream) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6]) and tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == stream
    assert tiff.lzw_decode(tiff.lzw_encode(bytes(10**6)), 5000)[:5000] == bytes(5000)


@pytest.mark.parametrize("order", "<>")
def test_tiff_sample_formats(order):
    rng = np.random.default_rng(4)
    size = {tiff.WIDTH: [10], tiff.HEIGHT: [6], tiff.ROWS_PER_STRIP: [4], tiff.COMPRESSION: [tiff.DEFLATE]}
    bits = rng.integers(0, 2, (6, 10, 1), np.uint8)
    blobs = [zlib.compress(np.packbits(bits[y : y + 4, :, 0], axis=1).tobytes()) for y in (0, 4)]
    (_, got), *_ = tiff.read_tiff(plain_tiff(order, size, blobs))
    assert (got == bits).all()
    for kind, want in (("u2", 1), ("i2", 2), ("u4", 1), ("f4", 3), ("f8", 3)):
        image = (rng.normal(size=(6, 10, 3)) * 1000).astype(kind) if kind[0] != "u" else rng.integers(0, 60000, (6, 10, 3)).astype(kind)
        item = int(kind[1])
        head = size | {tiff.BITS: [8 * item] * 3, tiff.SAMPLES: [3], tiff.FORMAT: [want] * 3}
        stored = image.astype(order + kind)
        for predictor in (1, 3 if want == 3 else 2):
            for planar in (1, 2):
                parts = [stored[y : y + 4, :, p : p + 1] for p in range(3) for y in (0, 4)] if planar == 2 else [stored[y : y + 4] for y in (0, 4)]
                blobs = []
                for part in parts:
                    if predictor == 2:
                        wide = part.astype(f"u{item}")
                        part = np.concatenate((wide[:, :1], wide[:, 1:] - wide[:, :-1]), axis=1).astype(f"{order}u{item}")
                        raw = part.tobytes()
                    elif predictor == 3:
                        by = np.frombuffer(part.astype(f">f{item}").tobytes(), np.uint8).reshape(len(part), -1, item).transpose(0, 2, 1).reshape(len(part), -1, part.shape[2])
                        raw = np.concatenate((by[:, :1], by[:, 1:] - by[:, :-1]), axis=1).tobytes()
                    else:
                        raw = part.tobytes()
                    blobs.append(zlib.compress(raw))
                (_, got), *_ = tiff.read_tiff(plain_tiff(order, head | {tiff.PREDICTOR: [predictor], tiff.PLANAR: [planar]}, blobs))
                assert got.dtype == np.dtype(kind) and (got == image).all(), (kind, predictor, planar)


def test_tiff_damaged_files_give_faults_only(spark):
    """Thousands of damaged files: the reader raises Broken and nothing else, and decodes no more than its bound."""
    rnd = random.Random(9)
    rng = np.random.default_rng(1)
    pages = [rng.integers(0, 9, (r, w, s), np.uint8) for r, w, s in ((5, 64, 3), (40, 33, 1))]
    whole = [tiff.write_tiff(pages, [(c, p, t)] * 2) for c in (tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS) for p in (1, 2) for t in (False, True)]
    size = {tiff.WIDTH: [8], tiff.HEIGHT: [8], tiff.BITS: [8]}
    bad = [plain_tiff("<", size | more, [bytes(64)]) for more in ({tiff.ROWS_PER_STRIP: [0]}, {tiff.TILE_WIDTH: [0], tiff.TILE_HEIGHT: [0]}, {tiff.WIDTH: [2**31], tiff.HEIGHT: [2**31]}, {tiff.COMPRESSION: [99]}, {tiff.WIDTH: []})]
    for _ in range(4000):
        data = bytearray(rnd.choice(whole))
        for _ in range(rnd.randint(1, 6)):
            data[rnd.choice((rnd.randrange(len(data)), rnd.randrange(max(0, len(data) - 400), len(data))))] = rnd.choice((0, 255, rnd.randrange(256)))
        bad.append(bytes(data[: rnd.choice((len(data), rnd.randrange(len(data))))]))
    faults = 0
    for data in bad:
        try:
            assert sum(i.nbytes for _, i in tiff.read_tiff(data, 1 << 22) if i is not None) <= 1 << 22
        except tiff.Broken:
            faults += 1
    assert faults > 2000
    rows = tiff.tiff_files(spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(bad[:300])], "doc_id long, media binary")).collect()
    assert len(rows) == 300 and all(r["error"] for r in rows[:5])


def test_tiff_bomb_is_bounded():
    bomb = plain_tiff("<", {tiff.WIDTH: [1 << 14], tiff.HEIGHT: [1 << 14], tiff.BITS: [8], tiff.COMPRESSION: [tiff.DEFLATE]}, [zlib.compress(bytes(1 << 28))])
    with pytest.raises(tiff.Broken):
        list(tiff.read_tiff(bomb, 1 << 20))


def test_tiff_query(spark, texts):
    from evidentia.llm.queries import QUERIES

    for r in QUERIES["op1_tiff_pages"](spark, SF).collect():
        raw = texts[r["doc_id"]].encode()
        pay = raw + b" " * ((-len(raw) % 192) if raw else 192)
        media = tiff.payload_tiff(texts[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:]))
        assert (r["media_bytes"], r["media_sha256"], r["error"]) == (len(media), hashlib.sha256(media).hexdigest(), None)


def test_sampled_pieces(spark, docs, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    one = {r["doc_id"]: bytes(r["ids"]) for r in sp_sampling.sample_pieces(docs, PIECES).collect()}
    two = {r["doc_id"]: bytes(r["ids"]) for r in sp_sampling.sample_pieces(docs.repartition(7), PIECES).collect()}
    other = {r["doc_id"]: bytes(r["ids"]) for r in sp_sampling.sample_pieces(docs, PIECES, seed=1).collect()}
    assert one == two and one != other
    frame = spark.createDataFrame([(i, bytearray(x)) for i, x in one.items()], "doc_id long, ids binary")
    for r in sp_sampling.decode_pieces(frame, PIECES).collect():
        assert bytes(r["decoded"]).decode() == texts[r["doc_id"]]
    i = next(i for i, t in texts.items() if t and t.isascii())
    assert model.decode(np.frombuffer(one[i], "<u4").tolist()) == texts[i]


def test_long_segments_are_sampled_alike(monkeypatch):
    """Segments summed and sampled one by one have the pieces that they have together; long units are parted anywhere."""
    rnd = random.Random(4)
    texts = ["a" * 900, "xyz" * 200, "日本語" * 200, "".join(rnd.choice("etaoin") for _ in range(3000)), "plain words here", "é" * 50]
    keys = np.arange(len(texts))
    want = sp_sampling.Sampler(PIECES, 1.0).sample(texts, keys)
    for name, value in (("ALONE", 8), ("WINDOW", 256)):
        monkeypatch.setattr(sp_sampling, name, value)
        got = sp_sampling.Sampler(PIECES, 1.0).sample(texts, keys)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_long_runs_are_merged_as_the_library():
    rnd = random.Random(6)
    runs = ["".join(rnd.choice("etaoinshr") for _ in range(n)) for n in (1025, 3000)] + ["a" * 2001, "ab" * 900, "日本語" * 700, "short", ""]
    want = [len(e.ids) for e in Tokenizer.from_file(BYTE_BPE).encode_batch(runs, add_special_tokens=False)]
    assert token_count.Counter(BYTE_BPE, ()).count(runs).tolist() == want
    flat, counts = packing.WordIds(WORD_BPE).ids(runs)
    assert flat.tolist() == [i for e in Tokenizer.from_file(WORD_BPE).encode_batch(runs, add_special_tokens=False) for i in e.ids]


def test_sampling_has_the_lattice_distribution():
    s = sp_sampling.Sampler(PIECES, 0.7)
    p = s.pieces
    ids = {x: i for i, x in reversed(list(enumerate(p.surface))) if x and i not in set(p.byte.tolist())}

    def paths(x):
        if not x:
            yield (), 0.0
        for n in range(1, len(x) + 1):
            if x[:n] in ids:
                for rest, w in paths(x[n:]):
                    yield (ids[x[:n]], *rest), w + 0.7 * p.weight[ids[x[:n]]]

    want = {a: math.exp(w) for a, w in paths(b" thed")}
    total, n = sum(want.values()), 30_000
    flat, counts = s.sample(["thed"] * n, np.arange(n))
    got, at = Counter(), 0
    for k in counts.tolist():
        got[tuple(flat[at : at + k].tolist())] += 1
        at += k
    for a, w in want.items():
        assert abs(got[a] / n - w / total) < 4 * math.sqrt(w / total / n) + 1e-3


@pytest.mark.parametrize("stored", [True, False])
def test_pipeline_stages_judge_each_row(spark, docs, stored, tmp_path):
    """Rows that repeat an id, with the same text or another, and rows without an id."""
    import corpus_pipeline

    def stage(name, rows):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
        if stored:
            df.write.parquet(str(tmp_path / name))
            df = spark.read.parquet(str(tmp_path / name))
        out = dict(corpus_pipeline.STAGES)[name](spark, df, SF)
        assert out.columns == df.columns
        return Counter((r["doc_id"], r["text"]) for r in out.collect())

    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs.collect()]
    marked = {r["doc_id"] for r in labels_of(spark)}
    verdict = {r["doc_id"]: r["predicted"] for r in quality.quality_scores(docs, spark.read.parquet(f"{SF}/labels.parquet"), threshold=0.7).collect()}
    good = next(r for r in rows if verdict[r[0]] and r[0] not in marked)
    bad = next(r for r in rows if not verdict[r[0]])
    more = [(None, *bad[1:]), (good[0], *bad[1:]), (None, *good[1:])]
    want = Counter((r[0], r[1]) for r in rows if verdict[r[0]]) + Counter([(None, good[1])])
    assert stage("quality", rows + more) == want

    more = [(None, "12 34", None, None), (4, "12 34", None, None), (4, "the cat sat on the mat", "en", "s")]
    unlearnt = {ODD[7][1], "no id"}  # no language is given for these, and the others share few grams with them
    want = Counter((r[0], r[1]) for r in ODD + more if r[1] not in unlearnt and language.has_letter(r[1]))
    assert stage("language", ODD + more) == want

    long = "word " * 4000
    more = [(None, "the cat sat on the mat", "en", "s"), (None, "no id", None, None), (10, long, "fr", "t"), (4, "the cat sat on the mat", "en", "s")]
    for name, alike in (("exact_dedup", lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")), ("near_dedup", lambda t: tuple(WORD.findall((t or "").lower().encode())))):
        groups = defaultdict(list)
        for n, r in enumerate(ODD + more):
            groups[alike(r[1]) or ((n,) if name == "near_dedup" else "")].append(r[:2])
        ids = Counter(min((r[0] is None, r[0] or 0) for r in g) for g in groups.values())
        got = stage(name, ODD + more)
        assert Counter((i is None, i or 0) for i, _ in got.elements()) == ids and got[(10, "one")] == 1 and got[(10, long)] == 0
        assert got[(None, "no id")] == 1 and sum(got.values()) == len(groups)


def test_pipeline(spark, docs, texts):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "exact_dedup", "near_dedup", "packing"]
    frame, kept = docs, dict(texts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, SF)
        assert frame.columns == docs.columns
        out = {r["doc_id"] for r in frame.collect()}
        if name == "exact_dedup":
            first = {}
            for i in sorted(kept):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", kept[i]), i)
            assert out == set(first.values())
        if name == "near_dedup":
            assert out == {i for i, (_, c) in near_truth(kept, 5, 80, 100).items() if c == i}
        kept = {i: t for i, t in kept.items() if i in out}
    marks = dict(duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall())
    good = corpus_pipeline.quality(spark, docs, SF)
    assert sum(marks.get(r["doc_id"]) == 0 for r in good.collect()) <= 1
    final = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in final.collect()} == set(kept)
