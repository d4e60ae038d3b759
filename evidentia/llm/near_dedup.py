"""Near duplicates: b-bit MinHash signatures met by a multi-index Hamming join, confirmed on full shingle sets."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, mix, small_batches, steps, word_hashes
from .components import components

#: Symbols a chunk has; one of them may differ, so a chunk has this many keys of one symbol less.
CHUNK = 5
#: Symbols of the whole signature; those outside the chunks (8 bits each) only refine the distance.
WIDE = 256
#: Members a comparison block of one key holds at about most (some 300 bytes each); two blocks meet in a task.
BLOCK = 2048
#: Pairs of two blocks that go on as rows; of more, the two blocks' sets are brought together once.
FEW = 64
#: Bytes of full sets that are gathered for two blocks at most; beyond it each pair brings its own two sets.
GATHERED = 16 << 20
#: Classes (24 bytes each) that are sent to all texts at most.
NEEDED = 1 << 20
#: Shingles of full sets that a worker sends on at once.
SENT = 1 << 18


def beyond(within: int, p: float, n: int = WIDE) -> float:
    """The chance that more than `within` of n symbols differ if each does with chance p."""
    return math.fsum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(within + 1, n + 1))


@dataclass(frozen=True)
class Index:
    """How signatures are split: `chunks` chunks of CHUNK 16-bit symbols, of which one may differ.

    By the pigeonhole principle two signatures of distance `within` = 2 * chunks - 1 at most agree in some
    chunk but for one symbol, so they share a key: every such pair is met. So are most pairs further apart;
    what shares a key is only left out if the whole signature differs in more than `wide_within` symbols.
    `miss` bounds the chance that a pair of just the wanted similarity shares no key or lies beyond that.
    """

    threshold_num: int
    threshold_den: int
    chunks: int
    wide_within: int
    miss: float

    @property
    def symbols(self) -> int:
        return self.chunks * CHUNK

    @property
    def within(self) -> int:
        return 2 * self.chunks - 1

    @classmethod
    def plan(cls, num: int, den: int, miss: float = 1e-6) -> "Index":
        s = num / den
        off = 1 - (s**CHUNK + CHUNK * (1 - s) * s ** (CHUNK - 1))
        chunks = max(2, math.ceil(math.log(miss) / math.log(max(off, 1e-12))))
        wide_within = next(w for w in range(WIDE + 1) if off**chunks + beyond(w, 1 - s) <= miss)
        return cls(num, den, chunks, wide_within, off**chunks + beyond(wide_within, 1 - s))

    @property
    def width(self) -> int:
        """Bytes of a stored signature."""
        return 2 * self.symbols + (WIDE - self.symbols)


def shingle_sets(texts, width: int):
    """Each text's distinct `width`-word shingles as sorted 64-bit hashes; fewer words form one shingle."""
    weights = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    for _, raws in steps(texts):
        h, counts = word_hashes(raws)
        at = 0
        for n in counts.tolist():
            w = h[at : at + n]
            at += n
            if n == 0:
                yield np.empty(0, np.uint64)
                continue
            k = min(n, width)
            total = np.full(n - k + 1, k, np.uint64)
            for i in range(k):
                total += w[i : n - k + 1 + i] * weights[i]
            yield np.unique(mix(total))


_RULE = np.random.Generator(np.random.PCG64(20240501))
_A = _RULE.integers(0, 1 << 32, WIDE, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _RULE.integers(0, 1 << 32, WIDE, dtype=np.uint64).astype(np.uint32)


def signature(hashes: np.ndarray, index: Index) -> bytes:
    """The smallest value of WIDE hash functions, cut to 16 bits in the chunks and to 8 bits after them."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(WIDE, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(short), 2048):
        part = short[None, i : i + 2048] * _A[:, None]
        part += _B[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    low = (low ^ (low >> np.uint32(15))) * np.uint32(0x9E3779B1)
    low >>= np.uint32(16)
    return low[: index.symbols].astype("<u2").tobytes() + low[index.symbols :].astype(np.uint8).tobytes()


def index_keys(symbols: np.ndarray) -> np.ndarray:
    """(n, chunks * CHUNK) keys of n rows of 16-bit symbols: for each chunk and each symbol left out of it."""
    n, k = symbols.shape
    chunks = symbols.reshape(n, k // CHUNK, CHUNK).astype(np.uint64)
    out = np.empty((n, k // CHUNK, CHUNK), np.uint64)
    for e in range(CHUNK):
        key = np.zeros((n, k // CHUNK), np.uint64)
        for i in range(CHUNK):
            if i != e:
                key = (key << np.uint64(16)) | chunks[:, :, i]
        salt = mix(np.arange(k // CHUNK, dtype=np.uint64) * np.uint64(CHUNK) + np.uint64(e + 1))
        out[:, :, e] = mix(key ^ salt[None, :])
    return out.reshape(n, k)


def _sets(width: int, index: Index):
    def run(batches):
        for pdf in batches:
            out = []
            for i, s in enumerate(shingle_sets(pdf["text"], width)):
                if len(s):
                    # order-free fingerprint of the whole set in two independent 64-bit sums
                    a, b = int(np.sum(mix(s + np.uint64(1)))), int(np.sum(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))))
                    out.append((pdf["id"].iat[i], pdf["words"].iat[i], len(s), (a & (1 << 64) - 1).to_bytes(8, "big") + (b & (1 << 64) - 1).to_bytes(8, "big"), signature(s, index)))
                else:
                    out.append((pdf["id"].iat[i], pdf["words"].iat[i], 0, None, None))
            yield pd.DataFrame(out, columns=["id", "words", "n", "fp", "sig"])

    return run


def _keys(index: Index):
    def run(batches):
        for pdf in batches:
            if len(pdf):
                sig = np.frombuffer(b"".join(pdf["sig"]), np.uint8).reshape(len(pdf), index.width)
                keys = index_keys(sig[:, : 2 * index.symbols].copy().view("<u2"))
                yield pd.DataFrame({"key": keys.ravel().view(np.int64), "cid": np.repeat(pdf["cid"].to_numpy(np.int64), keys.shape[1])})

    return run


def _distances(a: np.ndarray, b: np.ndarray, index: Index) -> np.ndarray:
    """Differing symbols of the whole signature."""
    cut = 2 * index.symbols
    near = (a[..., :cut].copy().view("<u2") != b[..., :cut].copy().view("<u2")).sum(axis=-1)
    return near + (a[..., cut:] != b[..., cut:]).sum(axis=-1)


def _close(index: Index):
    """Of pairs with both signatures, those within the distance."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                a, b = (np.frombuffer(b"".join(pdf[c]), np.uint8).reshape(len(pdf), index.width) for c in ("sig_a", "sig_b"))
                yield pdf.loc[_distances(a, b, index) <= index.wide_within, ["a", "b"]]

    return run


def _block_pairs(index: Index):
    """Of the members of one key (two blocks at most), pairs of different components within the distance.

    A pair meets under each key it shares; it is given under the first only: that of the first chunk with
    one difference at most, leaving out that symbol or the first.
    """
    record = np.dtype([("cid", ">i8"), ("label", ">i8"), ("n", ">i8"), ("part", ">i4"), ("sig", np.uint8, index.width)])

    def run(batches):
        for pdf in batches:
            rows = []
            for key, lead, parts, i, j, members in zip(pdf["key"], pdf["lead"], pdf["parts"], pdf["i"], pdf["j"], pdf["members"], strict=True):
                a_out, b_out = [], []
                m = np.frombuffer(b"".join(members), record)
                m = m[np.argsort(m["cid"], kind="stable")]
                cid, label, n = (m[c].astype(np.int64) for c in ("cid", "label", "n"))
                part, sig = m["part"], m["sig"]
                symbols = sig[:, : 2 * index.symbols].copy().view("<u2")
                place = int(np.flatnonzero(index_keys(symbols[:1])[0].view(np.int64) == key)[0])
                chunk, left_out = divmod(place, CHUNK)
                for r in range(len(m) - 1):
                    rest = slice(r + 1, None)
                    ok = (label[rest] != label[r]) & (cid[rest] != lead) & (cid[r] != lead)
                    if i != j:
                        ok &= part[rest] != part[r]
                    lo, hi = np.minimum(n[rest], n[r]), np.maximum(n[rest], n[r])
                    ok &= lo * index.threshold_den >= hi * index.threshold_num
                    at = np.flatnonzero(ok) + r + 1
                    if not len(at):
                        continue
                    at = at[_distances(sig[at], sig[r], index) <= index.wide_within]
                    if not len(at):
                        continue
                    differ = (symbols[at] != symbols[r]).reshape(len(at), index.chunks, CHUNK)
                    errors = differ.sum(axis=2)
                    first = (errors <= 1).argmax(axis=1)
                    spot = differ[np.arange(len(at)), first]
                    out_at = np.where(spot.any(axis=1), spot.argmax(axis=1), 0)
                    at = at[(first == chunk) & (out_at == left_out)]
                    a_out.append(np.full(len(at), cid[r]))
                    b_out.append(cid[at])
                if a_out:
                    found = np.stack([np.concatenate(a_out), np.concatenate(b_out)], axis=1)
                    if len(found):
                        rows.append((lead, parts, i, j, len(found), found.tobytes()))
            yield pd.DataFrame(rows, columns=["lead", "parts", "i", "j", "n", "pairs"])

    return run


def _pair_rows(batches):
    for pdf in batches:
        pairs = np.frombuffer(b"".join(pdf["pairs"]), np.int64).reshape(-1, 2)
        yield pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})


def _pair_members(batches):
    for pdf in batches:
        for lead, parts, i, j, raw in zip(pdf["lead"], pdf["parts"], pdf["i"], pdf["j"], pdf["pairs"], strict=True):
            yield pd.DataFrame({"cid": np.unique(np.frombuffer(raw, np.int64))}).assign(lead=lead, parts=parts, i=i, j=j)[["lead", "parts", "i", "j", "cid"]]


def _full_sets(width: int):
    def run(batches):
        for pdf in batches:
            cids, lo, held, size = pdf["cid"].to_numpy(np.int64), 0, [], 0
            for s in shingle_sets(pdf["text"], width):
                held.append(s.view(np.int64))
                size += len(s)
                if size > SENT or lo + len(held) == len(cids):
                    yield pd.DataFrame({"cid": cids[lo : lo + len(held)], "full": held})
                    lo, held, size = lo + len(held), [], 0

    return run


def _alike(a: np.ndarray, b: np.ndarray, index: Index) -> bool:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return index.threshold_den * both >= index.threshold_num * (len(a) + len(b) - both)


def _confirm_blocks(index: Index):
    """Of two blocks' pairs those alike, leaving out pairs that the links found so far already join."""

    def run(batches):
        for pdf in batches:
            for cids, fulls, lists in zip(pdf["cids"], pdf["fulls"], pdf["lists"], strict=True):
                sets = {int(c): np.sort(np.asarray(f, np.int64)) for c, f in zip(cids, fulls, strict=True)}
                root = {c: c for c in sets}

                def find(x, root=root):
                    while root[x] != x:
                        root[x] = root[root[x]]
                        x = root[x]
                    return x

                links = []
                for a, b in np.frombuffer(b"".join(lists), np.int64).reshape(-1, 2).tolist():
                    if (x := find(a)) != (y := find(b)) and _alike(sets[a], sets[b], index):
                        root[max(x, y)] = min(x, y)
                        links.append((a, b))
                yield pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)

    return run


def _made_sets(needed: DataFrame, reps: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The full shingle sets of the classes needed, made again from a whole text of each.

    The classes needed are counted: few go to the texts, so that only their texts are dealt; of more than NEEDED all
    texts are dealt by id.
    """
    own = cut_lineage(reps.join(needed.distinct(), "cid", "left_semi").select("cid", "id", "words"))
    few = own.count() <= NEEDED
    sets = texts.join(F.broadcast(own) if few else own, ["id", "words"]).dropDuplicates(["id", "words", "cid"])
    return cut_lineage(sets.select("cid", "text").mapInPandas(_full_sets(width), "cid long, full array<bigint>"))


def _ids(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid")))


def _confirmed(pairs: DataFrame, sets: DataFrame, index: Index) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; the sets are met and compared without leaving the engine."""
    both = pairs.join(sets.select(F.col("cid").alias("a"), F.col("full").alias("full_a")), "a")
    both = both.join(sets.select(F.col("cid").alias("b"), F.col("full").alias("full_b")), "b")
    both = both.select("a", "b", F.size("full_a").alias("n_a"), F.size("full_b").alias("n_b"), F.size(F.array_intersect("full_a", "full_b")).alias("same"))
    same, either = F.col("same").cast("long"), F.col("n_a").cast("long") + F.col("n_b") - F.col("same")
    return cut_lineage(both.where(same * index.threshold_den >= either * index.threshold_num).select("a", "b"))


def _confirmed_blocks(blocks: DataFrame, members: DataFrame, sets: DataFrame, index: Index) -> DataFrame:
    """The same for blocks' pair lists: a set is brought once to each two blocks, not once to each pair.

    Two blocks of long texts, whose sets together pass GATHERED bytes, are confirmed pair by pair instead.
    """
    place = ["lead", "parts", "i", "j"]
    held = members.join(sets, "cid")
    large = cut_lineage(held.groupBy(*place).agg(F.sum(F.size("full").cast("long") * 8).alias("bytes")).where(F.col("bytes") > GATHERED).select(*place))
    one_by_one = blocks.join(large, place, "left_semi").mapInPandas(_pair_rows, "a long, b long")
    held = held.join(large, place, "left_anti").groupBy(*place).agg(F.sort_array(F.collect_list(F.struct("cid", "full"))).alias("held"))
    held = held.select(*place, F.col("held.cid").alias("cids"), F.col("held.full").alias("fulls"))
    both = held.join(blocks.groupBy(*place).agg(F.collect_list("pairs").alias("lists")), place)
    return cut_lineage(both.mapInPandas(_confirm_blocks(index), "a long, b long")).unionByName(_confirmed(one_by_one, sets, index))


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similar: tuple[int, int] = (80, 100), miss: float = 1e-6
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable over links), kept.

    Words are runs without space, tab or line ends, A-Z lower-cased; a document's set holds its distinct
    `width`-word shingles (the whole sequence if it has fewer words), as 64-bit hashes: two documents' shingles
    agree wrongly by chance only. Documents are linked when den * |a & b| >= num * |a | b|. Texts without words
    (null, empty, blank) have 0 shingles and link with nothing. Rows that repeat an id are one document with
    several texts: the links of each of its texts are the id's links, and every row has its own text's
    n_shingles. A row with a null id links nothing; its component_id is null and kept is false. An empty table
    gives no rows; other columns don't matter.

    1. Documents with equal sets form a class at once (a hash of the set, combined before its shuffle); only
       one representative goes on, so exact copies cost nothing below.
    2. Each representative's signature is split; its chunk keys, one symbol left out of each, find the pairs,
       and the distance of the whole signatures leaves out those far apart. A pair of exactly the wanted
       similarity shares no key or lies too far apart with chance `miss` at most.
    3. Each member of a key is compared with the key's smallest member: rows linear in the members. The
       components of the links confirmed on full sets settle most keys.
    4. Keys whose members still are in several components are compared in full, in blocks of bounded size,
       leaving out what shares a component: members of the lead's component meet only those outside it, so they
       are sent once for each block of outsiders, not once for each block of the crowd. Only pairs within the
       signature distance leave a block, each under one key, and are confirmed on full sets. A crowd of alike
       texts has many such pairs: there each two blocks of the crowd meet in one task, with each set once.
    """
    small_batches(df)
    index = Index.plan(*similar, miss=miss)
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("words", F.xxhash64("text"))
    docs = texts.withColumn("id", F.col("id").cast("string")).mapInPandas(_sets(width, index), "id string, words long, n long, fp binary, sig binary")
    docs = cut_lineage(docs.withColumn("id", F.col("id").cast("long")))
    named = docs.where("fp is not null and id is not null")
    # a class is known by its smallest id, so that the first of a crowd leads its keys; where one id is the smallest of
    # several classes (ids may repeat) by a hash of its set
    classes = cut_lineage(named.groupBy("fp").agg(F.min("id").alias("first")))
    alike = classes.groupBy("first").agg(F.count("*").alias("classes"))
    number = F.when(F.col("classes") == 1, F.col("first")).otherwise(F.xxhash64("fp"))
    classes = cut_lineage(classes.join(alike, "first").select("fp", "first", number.alias("cid")))
    reps = named.join(classes.select("fp", F.col("first").alias("id"), "cid"), ["fp", "id"]).select("cid", "id", "words", "n", "sig")
    reps = cut_lineage(reps.dropDuplicates(["cid"]))

    members = reps.select("cid", "sig").mapInPandas(_keys(index), "key long, cid long")
    shared = members.groupBy("key").agg(F.min("cid").alias("lead"), F.count("*").alias("size")).where("size > 1")
    members = cut_lineage(members.join(shared, "key").select("key", "cid", "lead", "size"))

    signed = reps.select("cid", "n", "sig")
    pairs = members.where("cid <> lead").select(F.col("cid").alias("a"), F.col("lead").alias("b")).distinct()
    pairs = pairs.join(signed.select(F.col("cid").alias("a"), F.col("sig").alias("sig_a")), "a")
    pairs = pairs.join(signed.select(F.col("cid").alias("b"), F.col("sig").alias("sig_b")), "b")
    pairs = cut_lineage(pairs.mapInPandas(_close(index), "a long, b long"))
    links = _confirmed(pairs, _made_sets(_ids(pairs), reps, texts, width), index)
    settled = cut_lineage(components(links, "a", "b"))

    label = F.coalesce(F.col("component"), F.col("cid"))
    labelled = members.join(settled, members["cid"] == settled["node"], "left").select("key", "cid", "lead", "size", label.alias("label"))
    open_keys = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min_by("label", "cid").alias("main")).where("low < high")
    rest = labelled.join(open_keys.select("key", "main"), "key").withColumn("inner", F.col("label") == F.col("main"))
    counts = rest.groupBy("key").agg(F.count_if("inner").alias("n_main"), F.count_if(~F.col("inner")).alias("n_other"))
    parts = [F.ceil(F.col(n) / BLOCK).cast("int").alias(p) for n, p in (("n_main", "p_main"), ("n_other", "p_other"))]
    rest = rest.join(counts.select("key", *parts), "key").join(signed, "cid")
    # those of the lead's component need not meet each other, only the others, who meet all
    part = F.when(F.col("inner"), F.pmod(F.xxhash64("cid"), F.col("p_main"))).otherwise(F.col("p_main") + F.pmod(F.xxhash64("cid"), F.col("p_other"))).cast("int")
    rest = rest.withColumn("part", part).withColumn("parts", F.shiftleft(F.col("p_main").cast("long"), 32) + F.col("p_other"))
    big_endian = [F.unhex(F.lpad(F.hex(F.col(c)), 16, "0")) for c in ("cid", "label", "n")]
    rest = rest.withColumn("member", F.concat(*big_endian, F.unhex(F.lpad(F.hex("part"), 8, "0")), "sig"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.when(F.col("inner"), F.col("p_main")).otherwise(F.lit(0)), F.col("p_main") + F.col("p_other") - 1)))
    blocks = rest.groupBy("key", "lead", "parts", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    blocks = blocks.agg(F.collect_list("member").alias("members"))
    found = cut_lineage(blocks.mapInPandas(_block_pairs(index), "lead long, parts long, i int, j int, n int, pairs binary"))
    pairs = found.where(F.col("n") <= FEW).mapInPandas(_pair_rows, "a long, b long")
    many = found.where(F.col("n") > FEW)
    crowd = cut_lineage(many.mapInPandas(_pair_members, "lead long, parts long, i int, j int, cid long").distinct())
    sets = _made_sets(_ids(pairs).unionByName(crowd.select("cid")), reps, texts, width)

    # an id with several sets joins their classes
    several = named.groupBy("id").agg(F.min(F.xxhash64("fp")).alias("low"), F.max(F.xxhash64("fp")).alias("high")).where("low < high").select("id")
    several = named.join(several, "id", "left_semi").select("id", "fp").distinct().join(classes.select("fp", "cid"), "fp").select("id", "cid")
    several = cut_lineage(several)
    same_id = several.join(several.groupBy("id").agg(F.min("cid").alias("lead")), "id").select(F.col("cid").alias("a"), F.col("lead").alias("b"))

    edges = settled.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(same_id)
    edges = edges.unionByName(_confirmed(pairs, sets, index)).unionByName(_confirmed_blocks(many, crowd, sets, index))
    final = components(edges, "a", "b").select(F.col("node").alias("cid"), "component")
    linked = final.join(classes.select("cid", "first"), "cid")
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    linked = linked.join(least, "component").select("cid", "least")
    of_class = classes.join(linked, "cid", "left").select("fp", F.coalesce("least", "first").alias("component"))
    out = docs.where("fp is not null").select("id", "n", "fp").join(of_class, "fp", "left").drop("fp")
    out = out.unionByName(docs.where("fp is null").select("id", "n", F.lit(None).cast("long").alias("component")))
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept")
    )
