"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuespark.llm import bpe, html_main, knn, langid, near_dup, packing, quality, secret_scan, suffix_dedup, toxicity
from cuespark.llm._util import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))[0]


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept_bytes", 256).alias("kept_sha256"),
    )


def op4_html_main(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages"))


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(bpe.lengths(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN), F.col("n_tokens"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_secret_scan,
        op2_quality_rules,
        op3_suffix_dedup,
        op4_html_main,
        op5_near_dup,
        op6_language_id,
        op7_packing,
        op8_toxicity,
        op9_byte_bpe,
        op10_top_k,
    )
    return {f.__name__: f for f in own}


def _secret_sql() -> str:
    quote = lambda x: x.replace("'", "''")
    parts, base = [], []
    for k, (kind, pattern, group, least) in enumerate(secret_scan.RULES):
        p = quote(pattern)
        part = (
            f"(SELECT coalesce(list({{'s': s, 'k': {k}, 'e': s + length(m[i])}}), []) FROM ("
            f"SELECT i, m, coalesce(list_sum(list_transform(g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s "
            f"FROM (SELECT regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {group}) AS c, string_split_regex(t, '{p}') AS g), "
            f"unnest(range(1, length(m) + 1)) AS u(i) WHERE length(c[i]) >= {least}))"
        )
        parts.append(f"{part} AS l{k}")
        if kind in secret_scan.BASE_KINDS:
            base.append(k)
    names = "[" + ", ".join(f"'{kind}'" for kind, *_ in secret_scan.RULES) + "]"
    text = lambda ls: f"array_to_string(list_transform(list_sort({ls}), lambda x: {names}[x.k + 1] || ':' || x.s::BIGINT || ':' || x.e::BIGINT), ',')"
    some = "flatten([" + ", ".join(f"l{k}" for k in base) + "])"
    whole = "flatten([" + ", ".join(f"l{k}" for k in range(len(secret_scan.RULES))) + "])"
    counts = ", ".join(f"length(l{k})::BIGINT AS n_{secret_scan.RULES[k][0]}" for k in base)
    return (
        f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (SELECT doc_id, {', '.join(parts)} FROM d) "
        f"SELECT doc_id, {counts}, sha256({text(some)}) AS base_sha256, {text(whole)} AS spans FROM f"
    )


_SUFFIX_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, k, substr(h, 2 * k + 1, 100) AS s FROM d, unnest(range(0, length(h) // 2 - 49)) AS u(k)),
f AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s),
b AS (SELECT w.doc_id, w.k FROM w JOIN f USING (s) WHERE f.m < w.doc_id),
g AS (SELECT doc_id, k, CASE WHEN k <= lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 50 THEN 0 ELSE 1 END AS n FROM b),
i AS (SELECT doc_id, k, sum(n) OVER (PARTITION BY doc_id ORDER BY k) AS r FROM g),
s AS (SELECT doc_id, min(k) AS a, max(k) + 50 AS z FROM i GROUP BY doc_id, r),
p AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS y FROM s),
c AS (SELECT p.doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS last,
        string_agg(substr(h, 2 * y + 1, 2 * (a - y)), '' ORDER BY a) AS front FROM p JOIN d USING (doc_id) GROUP BY p.doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
    sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""

_NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS x FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN length(x) = 1 THEN x[1] ELSE x[k] || ' ' || x[k + 1] END AS sh
        FROM w, unnest(range(1, greatest(length(x), 2))) AS u(k) WHERE length(x) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (sh) WHERE a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS to_id FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.to_id = e.a),
m AS (SELECT doc_id, min(to_id) AS component_id FROM r GROUP BY doc_id)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.component_id, w.doc_id) AS component_id,
    w.doc_id = coalesce(m.component_id, w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.doc_id = w.doc_id
"""

# rows are told apart by their number, as an id can be repeated
_TOP_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v, row_number() OVER () AS n FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND length(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, q.n, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
        FROM v q JOIN v c ON q.n <> c.n WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_scan": _secret_sql(), "op3_suffix_dedup": _SUFFIX_SQL, "op5_near_dup": _NEAR_SQL, "op10_top_k": _TOP_SQL}
