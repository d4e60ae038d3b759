"""The queries of the corpus operators, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


def op5_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hilbert_shards import hilbert_shards

    out = hilbert_shards(table(spark, sf_dir, "documents"), shards=8)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
        "hilbert", "lang_step", "source_step", "size_step",
    )


def op1_tiff_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tiff import store_payloads, tiff_files

    read = tiff_files(store_payloads(table(spark, sf_dir, "documents")), joined=True)
    return read.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), F.expr("array_join(transform(pages, p -> p.feature), ' ')").alias("feature"),
        F.size("pages").alias("n_pages"), "error",
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_count import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op3_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ppm import ppm_scores

    return ppm_scores(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def op7_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .sp_sampling import sample_pieces

    out = sample_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), theta=1.0, seed=0, decode=True)
    return out.select("doc_id", "n_bytes", "n_pieces", F.crc32("ids").alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import Limits, pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1, limits=Limits(tokens=4096))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import languages

    return languages(table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), width=3, similar=(85, 100))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fim import fill_in_middle, restored

    out = fill_in_middle(table(spark, sf_dir, "documents"))
    back = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_ordered_funnels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .funnel import Funnel, funnel_counts

    funnels = [
        Funnel("A", ("view", "click", "view", "purchase"), "error"), Funnel("B", ("signup", "view", "click", "purchase"), "error"),
        Funnel("C", ("click", "click", "purchase", "view"), "signup"),
    ]
    return funnel_counts(table(spark, sf_dir, "clicks"), funnels, within=15 * 60 * 1_000_000)


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contaminated

    out = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_tiff_pages, op2_token_counts, op3_ppm_scores, op4_exact_dedup, op5_hilbert_shards, op6_quality, op7_sampled_pieces, op8_best_fit_packing, op9_language_id, op10_near_dedup, op11_fill_in_middle, op12_ordered_funnels, op13_decontaminate)
}

ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm""",
    "op11_fill_in_middle": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
h AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u,
  CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2, CAST('0x' || d[17:24] AS BIGINT) AS h3, CAST('0x' || d[25:32] AS BIGINT) AS h4 FROM t),
c AS (SELECT *, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END AS output FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(output) AS output_sha256, sha256(text) AS restored_sha256 FROM o""",
    "op12_ordered_funnels": r"""
WITH r AS (SELECT DISTINCT client_id, kind, epoch_us(ts) AS tm FROM clicks WHERE client_id IS NOT NULL AND kind IS NOT NULL AND ts IS NOT NULL),
f(funnel, k1, k2, k3, k4, ex) AS (VALUES ('A', 'view', 'click', 'view', 'purchase', 'error'), ('B', 'signup', 'view', 'click', 'purchase', 'error'), ('C', 'click', 'click', 'purchase', 'view', 'signup')),
s1 AS (SELECT funnel, client_id, tm AS a1, k2, k3, k4, ex FROM r JOIN f ON kind = k1),
x2 AS (SELECT s.*, n.tm AS b FROM s1 s ASOF LEFT JOIN r n ON s.client_id = n.client_id AND s.k2 = n.kind AND s.a1 < n.tm),
y2 AS (SELECT s.*, e.tm AS e FROM x2 s ASOF LEFT JOIN r e ON s.client_id = e.client_id AND s.ex = e.kind AND s.a1 < e.tm),
s2 AS (SELECT * EXCLUDE (b, e), CASE WHEN b - a1 <= 900000000 AND (e IS NULL OR e > b) THEN b END AS a2 FROM y2),
x3 AS (SELECT s.*, n.tm AS b FROM s2 s ASOF LEFT JOIN r n ON s.client_id = n.client_id AND s.k3 = n.kind AND s.a2 < n.tm),
y3 AS (SELECT s.*, e.tm AS e FROM x3 s ASOF LEFT JOIN r e ON s.client_id = e.client_id AND s.ex = e.kind AND s.a2 < e.tm),
s3 AS (SELECT * EXCLUDE (b, e), CASE WHEN b - a2 <= 900000000 AND (e IS NULL OR e > b) THEN b END AS a3 FROM y3),
x4 AS (SELECT s.*, n.tm AS b FROM s3 s ASOF LEFT JOIN r n ON s.client_id = n.client_id AND s.k4 = n.kind AND s.a3 < n.tm),
y4 AS (SELECT s.*, e.tm AS e FROM x4 s ASOF LEFT JOIN r e ON s.client_id = e.client_id AND s.ex = e.kind AND s.a3 < e.tm),
s4 AS (SELECT * EXCLUDE (b, e), CASE WHEN b - a3 <= 900000000 AND (e IS NULL OR e > b) THEN b END AS a4 FROM y4),
g AS (SELECT funnel, client_id, count(*) AS n1, count(a2) AS n2, count(a3) AS n3, count(a4) AS n4,
  CAST(1 + max(CASE WHEN a4 IS NOT NULL THEN 3 WHEN a3 IS NOT NULL THEN 2 WHEN a2 IS NOT NULL THEN 1 ELSE 0 END) AS INTEGER) AS deepest,
  list_sort(list(a2 - a1) FILTER (a2 IS NOT NULL)) AS l2, list_sort(list(a3 - a2) FILTER (a3 IS NOT NULL)) AS l3, list_sort(list(a4 - a3) FILTER (a4 IS NOT NULL)) AS l4
  FROM s4 GROUP BY funnel, client_id)
SELECT funnel, client_id, n1, n2, n3, n4, deepest, l2[(n2 + 1) // 2] AS t2, l3[(n3 + 1) // 2] AS t3, l4[(n4 + 1) // 2] AS t4, count(*) OVER (PARTITION BY funnel, deepest) AS same_depth FROM g""",
    "op13_decontaminate": r"""
WITH lowered AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, row_number() OVER () AS r FROM documents),
d AS (SELECT r, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') AS win FROM i, LATERAL (SELECT unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS k) WHERE len(w) > 0),
dw AS (SELECT r, m, k, array_to_string(w[k:k + m - 1], ' ') AS win FROM d, (SELECT DISTINCT m FROM iw), LATERAL (SELECT unnest(generate_series(1, len(w) - m + 1)) AS k)),
hit AS (SELECT r, k, dw.m AS m, item FROM dw JOIN iw ON dw.win = iw.win AND dw.m = iw.m),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM hit, LATERAL (SELECT unnest(generate_series(k, k + m - 1)) AS p) GROUP BY r),
x AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN x USING (r)""",
}
