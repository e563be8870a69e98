"""Every stage of the pipeline against a plain version of it, on rows with null ids, null and empty texts, repeated rows and ids."""

import itertools
import random
import re
import sys

import public_tokenizers
import pytest
import tiktoken
from pyspark import cloudpickle
from pyspark.sql import functions as F

import corpus_pipeline
from cuespark.llm import bpe, langid

# executors cannot import this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RNG = random.Random(21)
WORDS = {"aa": "und der die ich nicht wasser über haus gehen baum".split(), "bb": "the and of with water house going tree what here".split()}
KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(n, lang="bb"):
    return " ".join(RNG.choice(WORDS[lang]) + RNG.choice(["", "", "s", "ed"]) for _ in range(n))


BASE = prose(80)
PASSAGE = prose(30) + " über é"
SECRET = prose(20) + " token = 'abcdef0123456789abcdef0123456789' AKIA" + "B2" * 9 + " " + prose(20)
ROWS = [
    *((k, prose(40, "aa" if k % 2 else "bb"), "aa" if k % 2 else "bb") for k in range(24)),
    (100, BASE, "bb"), (101, BASE + " more", "bb"), (102, BASE, "bb"), (103, BASE, "bb"), (103, BASE, "bb"), (104, prose(60), "bb"), (104, prose(50), "bb"),
    (105, prose(20) + " " + PASSAGE + " " + prose(20), "bb"), (106, prose(25) + " " + PASSAGE + prose(25), "bb"), (107, SECRET, "bb"), (108, SECRET, "bb"),
    (None, BASE, "bb"), (None, prose(40), "bb"), (109, None, "bb"), (110, "", None), (111, "12 34 --", "bb"), (112, "qx zvk wpj gqy xkz vvq", "bb"), (113, prose(3000), None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, x, lang, "s", None if x is None else len(x)) for i, x, lang in ROWS], KIND).repartition(3)


def key(rows):
    return sorted(((tuple(r) if not isinstance(r, tuple) else r) for r in rows), key=repr)


def texts(df):
    return key((r.doc_id, r.text) for r in df.collect())


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_language_stage(spark, docs):
    model = langid.fit(docs)
    assert model.languages == ["aa", "bb"]
    samples = langid.sample(docs, "doc_id", "text", "lang")
    grams = {lang: [g for t in xs for g in langid.gram_hashes(t).tolist()] for lang, xs in samples.items()}
    part = lambda lang, g: grams[lang].count(g) / len(grams[lang])
    known = {lang: {g for g in set(xs) if xs.count(g) > 1 and part(lang, g) >= 0.5 * max(part(x, g) for x in grams)} for lang, xs in grams.items()} if sum(map(len, grams.values())) < 9000 else None

    def wanted(text):
        if not text or not any(x.isalpha() for x in text):
            return False
        if known is None:
            return langid.stands_out(model, text)
        own = langid.gram_hashes(text).tolist()
        a, b = sorted((sum(g in known[lang] for g in own) / len(own) for lang in known), reverse=True)
        return a >= 0.4 and a - b >= 0.05 * (1 - a)

    got = stage("language ID")(spark, docs, "")
    assert got.columns == docs.columns
    want = [(i, x) for i, x, _ in ROWS if wanted(x)]
    assert texts(got) == key(want)
    assert {109, 110, 111, 112}.isdisjoint(i for i, _ in want) and len(want) == len(ROWS) - 4
    assert stage("language ID")(spark, docs.limit(0), "").count() == 0


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def test_near_duplicate_stage(spark, docs):
    parent = {i: i for i, *_ in ROWS if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, s), (j, t) in itertools.combinations([(i, shingles(x)) for i, x, _ in ROWS if i is not None], 2):
        if s and t and 100 * len(s & t) >= 80 * len(s | t):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    got = stage("MinHash near-dedup")(spark, docs, "")
    assert got.columns == docs.columns
    assert texts(got) == key((i, x) for i, x, _ in ROWS if i is None or root(i) == i)
    assert {101, 102, 103, 108}.isdisjoint(r.doc_id for r in got.collect())
    assert stage("MinHash near-dedup")(spark, docs.limit(0), "").count() == 0


def test_suffix_stage(spark, docs):
    raw = [(i, (x or "").encode()) for i, x, _ in ROWS]
    first = {}
    for i, x in raw:
        for k in range(len(x) - 49 if i is not None else 0):
            first[x[k : k + 50]] = min(i, first.get(x[k : k + 50], i))

    def cut(i, x):
        gone = bytearray(len(x))
        for k in range(len(x) - 49 if i is not None else 0):
            if first[x[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        # a character that a cut divides goes whole
        return bytes(b for b, g in zip(x, gone, strict=True) if not g).decode("utf-8", "ignore")

    got = stage("suffix-array dedup")(spark, docs, "")
    assert got.columns == docs.columns
    assert texts(got) == key((i, cut(i, x)) for i, x in raw)
    assert all(r.n_chars == len(r.text) for r in got.collect())
    assert stage("suffix-array dedup")(spark, docs.limit(0), "").count() == 0


def test_secret_stage(spark, docs, tmp_path):
    want = [(i, x if x is None else x.replace("token = 'abcdef0123456789abcdef0123456789", "[SECRET]").replace("AKIA" + "B2" * 9, "[SECRET]")) for i, x, _ in ROWS]
    got = stage("secret scans")(spark, docs, "")
    assert got.columns == docs.columns and texts(got) == key(want)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got.collect())
    spark.conf.set(corpus_pipeline.LEDGER, f"{tmp_path}/ledger")
    try:
        for _ in range(2):
            assert texts(stage("secret scans")(spark, docs, "")) == key(want)
        ledger = spark.read.parquet(f"{tmp_path}/ledger")
        assert ledger.count() == len({x or "" for _, x, _ in ROWS})
    finally:
        spark.conf.unset(corpus_pipeline.LEDGER)
    assert stage("secret scans")(spark, docs.limit(0), "").count() == 0


def test_packing_stage(spark, docs):
    ranks = bpe.read_ranks(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    wanted = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = stage("packing")(spark, docs, "").collect()
    assert key((r.doc_id, r.n_tokens) for r in got) == key((i, len(wanted.encode_ordinary(x or ""))) for i, x, _ in ROWS)
    ends = {r.bucket: r.bucket_tokens for r in got}
    assert all(r.bucket_tokens == ends[r.bucket] == r.n_tokens + r.padding and r.padding >= 0 for r in got)
    # sixteen buckets leave no padding but where lengths differ in more than sixteen values
    assert len(ends) == min(16, len({r.n_tokens for r in got}))
    assert len({(r.batch, r.slot) for r in got}) == len(got)
    assert stage("packing")(spark, docs.limit(0), "").count() == 0


def test_run(spark, tmp_path, docs):
    """run() is the stages one after another, each over all that the one before kept."""
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
    names = ["doc_id", "n_tokens", "bucket", "bucket_tokens", "batch", "slot", "padding", "oversize"]
    got = corpus_pipeline.run(spark, str(tmp_path)).select(names)
    assert key(got.collect()) == key(now.select(names).collect()) and 0 < got.count() < len(ROWS)
    left = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/3").where(F.col("doc_id").isNotNull()).collect()}
    assert {109, 110, 111, 112, 101, 102, 103, 108}.isdisjoint(left) and PASSAGE in left[105] and PASSAGE not in left[106] and left[107].count("[SECRET]") == 2
