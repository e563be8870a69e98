"""Operators against brute force, on a small table with nulls, empty, very long, tied and repeated texts, and clashing columns."""

import base64
import bisect
import hashlib
import itertools
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark import cloudpickle
from pyspark.sql import functions as F

from cuespark.llm import bpe, html_main, knn, langid, near_dup, packing, quality, secret_scan, suffix_dedup, toxicity

# executors cannot import this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RNG = random.Random(7)
WORDS = {"aa": "und der die ich nicht wasser über haus gehen baum".split(), "bb": "the and of with water house going tree what here".split()}


def prose(n, lang="bb"):
    return " ".join(RNG.choice(WORDS[lang]) + RNG.choice(["", "", "s", "ed"]) for _ in range(n))


LONG = prose(30_000)
PASSAGE = prose(40)
SECRET = 'x token = "' + "0123456789abcdef" * 2 + '" secret=token: abcdefgh password=ab AKIA' + "A1" * 9 + " é " + "f" * 30
BASE = prose(60)
TEXTS = [
    None, "", " ", "ü", "one", "ONE", LONG, PASSAGE, prose(20) + PASSAGE + prose(20), PASSAGE + "é" * 40, BASE, BASE + " extra", BASE, SECRET,
    SECRET, "a" * 500, "ab" * 300, "line one here\nline one here\n\nline two", *(prose(50, "aa") for _ in range(12)), *(prose(50) for _ in range(12)),
    "123 456", "<b>&amp; tag</b> #*$%",
]


@pytest.fixture(scope="module")
def rows():
    return [(k, t, "aa" if 18 <= k < 30 else "bb", "src", 7) for k, t in enumerate(TEXTS)] + [(10, BASE, "bb", "src", 7)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    kind = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, kept boolean, label bigint, g bigint, rep bigint, place int"
    return spark.createDataFrame([(*r, 1.0, False, 1, 1, 1, 1) for r in rows], kind).repartition(3)


def collected(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def same(rows, df, want, *names):
    assert collected(df, "doc_id", *names) == sorted(((r[0], *want(r)) for r in rows), key=repr)


def base_spans(text):
    rules = [
        (re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
        (re.compile("AKIA[A-Z0-9]+"), 0, 20),
        (re.compile("[0-9a-f]+"), 0, 24),
    ]
    found = sorted((m.start(), k, m.end()) for k, (rx, g, n) in enumerate(rules) for m in rx.finditer(text or "") if len(m[g]) >= n)
    return found, ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in found)


def test_secrets(spark, rows, docs):
    got, new = secret_scan.scan(docs)
    want = lambda r: (*(sum(x[1] == k for x in base_spans(r[1])[0]) for k in range(3)), hashlib.sha256(base_spans(r[1])[1].encode()).hexdigest())
    same(rows, got, want, "n_assign", "n_access", "n_hex", "base_sha256")
    assert base_spans(SECRET)[0]
    # nothing is scanned twice; a change of the rules makes all unseen; new versions alone are scanned
    assert secret_scan.unseen(docs, new).count() == 0
    assert secret_scan.unseen(docs, new, rules=secret_scan.RULES[:3]).count() == len({r[1] or "" for r in rows})
    more = docs.unionByName(docs.limit(1).withColumn("text", F.lit("password=abcdefgh")).withColumn("doc_id", F.lit(99).cast("long")))
    again, added = secret_scan.scan(more, new)
    assert added.count() == 1 and again.where("doc_id = 99").first().spans == "assign:0:17"
    masked = {r.doc_id: r.text for r in secret_scan.redact(docs).collect()}
    assert masked[13] == 'x [SECRET]" secret=token: abcdefgh password=ab [SECRET] é [SECRET]' and masked[0] is None and masked[7] == PASSAGE
    assert secret_scan.scan(docs.limit(0))[0].count() == 0


def test_a_kept_ledger(spark, tmp_path, rows, docs):
    """Runs one after another scan what is new alone, and give what one scan of all gives."""
    path = f"{tmp_path}/ledger"
    half = docs.where("doc_id < 20")
    first, n = secret_scan.scan_kept(half, path)
    own = lambda some: {r[1] or "" for r in some}
    assert n == len(own(r for r in rows if r[0] < 20))
    again, m = secret_scan.scan_kept(docs, path)
    assert m == len(own(rows)) - n and secret_scan.scan_kept(docs, path)[1] == 0
    names = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    assert collected(again, *names) == collected(secret_scan.scan(docs)[0], *names) == collected(secret_scan.scan_kept(docs, path)[0], *names)
    assert secret_scan.scan_kept(docs.limit(0), path)[1] == 0 and first.count() == half.count()
    masked = collected(secret_scan.redact(docs, path), "doc_id", "text")
    assert masked == collected(secret_scan.redact(docs), "doc_id", "text") == collected(secret_scan.redact(docs, f"{tmp_path}/other"), "doc_id", "text")
    assert secret_scan.scan_kept(docs, f"{tmp_path}/other")[1] == 0


def test_masks_are_the_union_of_spans(spark):
    own = random.Random(8)
    parts = ["token=", "AKIA" + "Q7" * 9, "0123456789abcdef" * 2, " ", "é", "password: ", "ghp_" + "a1" * 20, "x", "eyJhbGciOiJI.eyJzdWIiOiIx.abcdefghij-_k"]
    texts = ["".join(own.choices(parts, k=9)) for _ in range(200)] + ["", None, "é" * 5 + "token=abcdefgh"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    spans = {r.doc_id: r.spans for r in secret_scan.scan(df)[0].collect()}
    got = {r.doc_id: r.text for r in secret_scan.redact(df).collect()}
    for k, text in enumerate(texts):
        hidden, out = bytearray(len(text or "")), ""
        cuts = [tuple(map(int, x.split(":")[1:])) for x in spans[k].split(",") if x]
        for a, z in cuts:
            hidden[a:z] = b"\1" * (z - a)
        for at, c in enumerate(text or ""):
            out += c if not hidden[at] else "" if at and hidden[at - 1] else "[SECRET]"
        assert got[k] == (None if text is None else out)


def test_whole_keys_are_masked(spark):
    own = random.Random(7)
    lines = [base64.b64encode(own.randbytes(48)).decode() for _ in range(30)]
    head, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    keys = [
        "\n".join((head, *lines, end)),
        "\\n".join((head, *lines, end)),
        "\r\n".join((head, "Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,00AA", "", *lines, end)),
        "\n".join((head, *lines)),
        head,
    ]
    texts = [f"{front}{key} - the rest" for key in keys for front in ("an é: ", "secret: ")]
    df = spark.createDataFrame([(None if k % 3 == 0 else k, k, x) for k, x in enumerate(texts)], "doc_id bigint, k bigint, text string")
    spans = {r.k: r.spans for r in df.drop("doc_id").transform(lambda x: secret_scan.scan(x, key_col="k")[0]).collect()}
    masked = {r.k: r.text for r in secret_scan.redact(df).collect()}
    for k, x in enumerate(texts):
        front, key = x[: x.index(head)], keys[k // 2]
        assert f"pem:{len(front)}:{len(front) + len(key)}" in spans[k].split(",")
        # "secret: -----BEGIN" is a span as well, so there the union of spans begins with that word
        assert masked[k] == f"{'' if front == 'secret: ' else front}[SECRET] - the rest"


def test_quality(spark, rows, docs):
    def want(r):
        text = r[1] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        marked = {k + j for k, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if windows[w] > 1 for j in range(3)}
        seen, dup = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        failed = len(words) < 50 or 100 * len(marked) > 50 * len(words)
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(marked), failed

    got = quality.quality(docs)
    same(rows, got, want, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert not got.where("kept and base_failed").count() and quality.quality(docs.limit(0)).count() == 0


def test_suffixes(spark, rows, docs):
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(i, (t or "").encode())
    first = {}
    for i in sorted(texts):
        for k in range(len(texts[i]) - 49):
            first.setdefault(texts[i][k : k + 50], i)

    def want(r):
        raw, out = (r[1] or "").encode(), []
        for k in range(len(raw) - 49):
            if first[raw[k : k + 50]] < r[0]:
                if out and k <= out[-1][1]:
                    out[-1] = (out[-1][0], k + 50)
                else:
                    out.append((k, k + 50))
        kept = bytearray()
        last = 0
        for a, b in out:
            kept += raw[last:a]
            last = b
        return len(raw), out, bytes(kept + raw[last:])

    got = suffix_dedup.remove_repeats(docs, carry=("lang",))
    have = sorted(((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept_bytes)) for r in got.collect()), key=repr)
    assert have == sorted(((r[0], *want(r)) for r in rows), key=repr)
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_suffix_ranks():
    text = np.frombuffer(bytes(RNG.choice(b"ab") for _ in range(40)) * 9 + bytes(RNG.choice(b"abc") for _ in range(300)) + bytes(100), np.uint8)
    at = np.array(sorted(RNG.sample(range(len(text) - 100), 250)))
    windows = [text[p : p + 50].tobytes() for p in at]
    assert suffix_dedup.suffix_ranks(text, at).tolist() == [bisect.bisect_left(sorted(windows), w) for w in windows]
    assert all((a + s) % 16 in suffix_dedup.COVER and (b + s) % 16 in suffix_dedup.COVER for a in range(16) for b in range(16) for s in [suffix_dedup._SHIFT[a][b]])


def shingle_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))
    return frozenset(tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))) if words else frozenset()


@pytest.mark.parametrize(("words", "percent"), [(2, 80), (5, 80)])
def test_near_duplicates(spark, rows, docs, words, percent):
    sets = [shingle_set(r[1], words) for r in rows]
    parent = {r[0]: r[0] for r in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, s), (b, t) in itertools.combinations(zip((r[0] for r in rows), sets, strict=True), 2):
        if s and t and 100 * len(s & t) >= percent * len(s | t):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = near_dup.near_duplicates(docs, words=words, percent=percent)
    same(rows, got, lambda r: (len(shingle_set(r[1], words)), root(r[0]), root(r[0]) == r[0]), "n_shingles", "component_id", "kept")
    if words == 2:
        assert near_dup.near_duplicates(docs.limit(0)).count() == 0


def test_near_guarantee():
    """Signatures that differ in at most 2 * CHUNKS - 1 places share a key."""
    s = np.array([RNG.randrange(1 << 16) for _ in range(near_dup.PLACES)], "<u2")
    for _ in range(200):
        t = s.copy()
        for k in RNG.sample(range(near_dup.PLACES), 2 * near_dup.CHUNKS - 1):
            t[k] ^= 1
        assert set(near_dup.keys(s[None]).ravel().tolist()) & set(near_dup.keys(t[None]).ravel().tolist())


@pytest.mark.parametrize("block", [300, 900, 5000])
def test_blocks_of_a_group(spark, monkeypatch, block):
    """Groups and keys that are cut into blocks give the classes that all pairs give: near copies of a middle, chains, two middles, repeated ids."""
    own = random.Random(block)
    new = lambda n: [f"w{own.randrange(10**6)}" for _ in range(n)]

    def changed(words, n):
        out = list(words)
        for j in own.sample(range(len(out)), n):
            out[j] = f"x{own.randrange(10**6)}"
        return out

    base = new(60)
    some = [changed(base, k % 5) for k in range(40)]
    chain = [base]
    for _ in range(12):
        chain.append(changed(chain[-1], 3))
    second = changed(chain[-1], 3)
    some += chain[1:] + [changed(second, k % 4) for k in range(15)] + [new(60) for _ in range(5)]
    rows = [(k, " ".join(x)) for k, x in enumerate(some)] + [(7, " ".join(changed(base, 2))), (8, None), (500, ""), (500, " ".join(changed(base, 1)))]
    sets = [(i, shingle_set(x, 2)) for i, x in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, s), (j, t) in itertools.combinations(sets, 2):
        if s and t and 100 * len(s & t) >= 80 * len(s | t):
            x, y = root(i), root(j)
            parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(near_dup, "KEY_BLOCK", 7)
    monkeypatch.setattr(near_dup, "GROUP_BLOCK", block)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(df).collect()}
    assert got == {i: root(i) for i in got} and len(set(got.values())) < len(got) - 30


def test_language(spark, rows, docs):
    model = langid.fit(docs)
    assert model.languages == ["aa", "bb"]
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert all(got[r[0]].lang_pred == r[2] for r in rows if 18 <= r[0] < 42)
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (0, 1, 2, 42))
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.doc_id for r in langid.accepted(docs, model).collect()}.isdisjoint({0, 1, 2, 42})
    assert langid.identify(docs.limit(0), langid.fit(docs.limit(0))).count() == 0
    none = langid.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert none.languages == [] and langid.identify(docs, none).where("lang_pred <> 'und'").count() == 0 and langid.accepted(docs, none).count() == 0
    lost = docs.withColumn("doc_id", F.when(F.col("doc_id") != 7, F.col("doc_id")))
    assert langid.identify(lost, model).where("doc_id is null and not held_out and lang_pred = 'bb'").count() == 1


def plain_shares(samples, text):
    """The shares with sets in place of filters."""
    grams = lambda x: langid.gram_hashes(x).tolist()
    counts = {lang: Counter(g for t in texts for g in grams(t)) for lang, texts in samples.items()}
    part = lambda lang, g: counts[lang][g] / max(1, counts[lang].total())
    sets = {lang: {g for g, n in c.items() if n >= 2 and part(lang, g) >= 0.5 * max(part(x, g) for x in counts)} for lang, c in counts.items()}
    own = grams(text)
    return [sum(g in sets[lang] for g in own) / len(own) for lang in sorted(samples)]


def test_language_against_sets():
    """Bit-sliced filters, corrected for false positives, give the shares of exact sets; the decision needs a language that stands out."""
    samples = {lang: [prose(60, lang) for _ in range(40)] for lang in WORDS}
    model = langid.train(samples)
    own = random.Random(3)
    noise = [" ".join("".join(own.choices("abcdefghijklmnopqrstuvwxyz", k=own.randrange(2, 9))) for _ in range(60)) for _ in range(40)]
    for text in [prose(30, "aa"), prose(30), prose(10, "aa") + " " + prose(10), *noise[:10]]:
        want = plain_shares(samples, text)
        assert np.abs(langid.shares(model, text) - want).max() < 0.01
        if max(want) - min(want) > 0.05:
            assert langid.predict(model, text)[0] == sorted(samples)[int(np.argmax(want))]
    assert not any(langid.stands_out(model, x) for x in [*noise, "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności", "12 34", "", None])
    assert all(langid.stands_out(model, prose(20, lang)) for lang in WORDS for _ in range(20))
    many = langid.train({**samples, **{f"x{k}": [" ".join(noise[k::40] * 2)] for k in range(20)}})
    assert all(langid.stands_out(many, prose(20, lang)) for lang in WORDS for _ in range(20))


def test_more_languages_than_a_word_has_bits(spark):
    own = random.Random(6)
    words = {f"l{k:02}": ["".join(own.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)] for k in range(70)}
    texts = {lang: [" ".join(own.choices(w, k=60 if lang < "l60" else 20)) for _ in range(3)] for lang, w in words.items()}
    model = langid.train(texts)
    assert model.languages == sorted(words)
    assert [langid.predict(model, " ".join(w))[0] for w in words.values()] == list(words)
    docs = spark.createDataFrame([(k * 9 + j, x, lang) for k, (lang, xs) in enumerate(texts.items()) for j, x in enumerate(xs * 3)], "doc_id bigint, text string, lang string")
    assert set(langid.sample(docs, "doc_id", "text", "lang")) == set(words)


def test_toxicity(spark):
    def make(k):
        bad = k % 3 == 0
        group = RNG.choice(["women", "men"]) if bad else RNG.choice(["", "men"])
        return k, prose(20) + (" " + RNG.choice(["scumbag", "idiot"]) if bad else "") + " " + group + " " + prose(20), int(bad)

    data = [make(k) for k in range(300)]
    docs = spark.createDataFrame([(a, b, 0.5) for a, b, _ in data] + [(1000, None, 0.5), (1001, "", 0.5)], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(a, 1, c) for a, _, c in data] + [(None, 1, 1), (5, 1, None)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.classify(docs, model).collect()}
    held = [(i, y) for i, _, y in data if got[i].held_out]
    assert held and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert np.mean([got[i].predicted == y for i, y in held]) > 0.95
    assert got[1000].score == got[1001].score and got[1000].predicted == 0
    # a mention of a group moves the score less than it does without the penalty
    train = [(b, c) for a, b, c in data]
    vocabulary = sorted(set().union(*(toxicity.features(b) for b, _ in train)))
    change = lambda m: abs(m.weights.get("women", 0) - m.weights.get("men", 0))
    assert toxicity.classify(docs.limit(0), model).count() == 0 and toxicity.fit(docs.limit(0), labels).weights == {}
    fair = toxicity.fit_weights([b for b, _ in train], [c for _, c in train], vocabulary)
    plain = toxicity.fit_weights([b for b, _ in train], [c for _, c in train], vocabulary, swaps=0)
    assert change(fair) < 0.5 * change(plain)
    assert toxicity.classify(docs, toxicity.fit(docs, labels.limit(0))).where("predicted = 1").count() == 0


def test_neutral_mentions(spark):
    """Groups that stand mostly in toxic texts of the sample: neutral texts that mention them are not called toxic for it, insults are."""
    own = random.Random(12)
    groups = ["women", "muslims", "immigrants", "gay", "black"]
    insults = ["scumbag", "idiot", "vermin"]

    def make(bad):
        mention = own.choice(groups) if own.random() < (0.9 if bad else 0.05) else ""
        return " ".join([prose(15), own.choice(insults) if bad and own.random() < 0.6 else "", mention, prose(15)])

    data = [(make(k % 4 == 0), int(k % 4 == 0)) for k in range(800)]
    vocabulary = sorted(f for f, n in Counter(f for x, _ in data for f in toxicity.features(x)).items() if n >= 4)
    fair, plain = (toxicity.fit_weights([x for x, _ in data], [y for _, y in data], vocabulary, swaps=k) for k in (2, 0))
    neutral = [f"{prose(15)} {g} {prose(15)}" for g in groups for _ in range(20)]
    bad = [f"{prose(15)} {i} {g} {prose(15)}" for g in groups for i in insults for _ in range(4)]
    called = lambda m, some: sum(toxicity.score(m, x) >= toxicity.THRESHOLD for x in some)
    assert called(plain, neutral) > 90 and called(fair, neutral) < 0.5 * called(plain, neutral)
    assert called(fair, bad) >= 0.95 * len(bad)
    for x in neutral[::20]:
        moved = lambda m: abs(toxicity.score(m, x) - toxicity.score(m, toxicity.swapped(x, 0)))  # noqa: B023, E731
        assert moved(fair) <= moved(plain) + 1e-9


def test_toxicity_of_odd_rows(spark):
    """Long texts, repeated rows and ids, ties, nulls, and columns whose names clash."""
    texts = [LONG + " scumbag", "scumbag scumbag", "scumbag", None, "", "fine words", "fine words", "words fine"]
    train = [(f"{'scumbag' if k % 2 else ''} {prose(12)}", k % 2) for k in range(60)]
    rows = [(1000 + k, x) for k, x in enumerate(texts)] + [(1005, "fine words"), (None, "scumbag")] + [(k, x) for k, (x, _) in enumerate(train)]
    docs = spark.createDataFrame([(i, x, 1, 1, "q") for i, x in rows], "doc_id bigint, text string, toxic int, y int, x string")
    labels = spark.createDataFrame([(k, y, "t", "l") for k, (_, y) in enumerate(train)] + [(0, 0, "t", "l"), (3, None, "t", "l")], "doc_id bigint, toxic int, text string, lang string")
    model = toxicity.fit(docs, labels)
    got = toxicity.classify(docs, model).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(by[1005]) == 2 and len({r.score for k in (1005, 1006, 1007) for r in by[k]}) == 1
    assert by[1001][0].score == by[1002][0].score == by[None][0].score > 0.3 and by[1000][0].predicted == 1 and not by[None][0].held_out
    assert by[1003][0].score == by[1004][0].score < 0.3


def test_bpe(spark, rows, docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    wanted = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def want(r):
        ids = np.array(wanted.encode_ordinary(r[1] or ""), "<u4")
        return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()

    same(rows, bpe.encode(docs, path, public_tokenizers.PATTERN), want, "n_tokens", "ids_sha256", "decoded_sha256")
    merges = bpe.Merges(ranks)
    texts = ["".join(RNG.choice("abé c1 ") for _ in range(RNG.randrange(80))) for _ in range(400)] + ["a" * 3000, "😀日本" * 50]
    for text, ids in zip(texts, bpe.Encoder(merges, public_tokenizers.PATTERN).encode(texts), strict=True):
        assert ids.tolist() == wanted.encode_ordinary(text) and merges.decode(ids) == text.encode()
    assert bpe.encode(docs.limit(0), path, public_tokenizers.PATTERN).count() == 0


def cost(ends, lengths, counts):
    return sum((min(e for e in ends if e >= x) - x) * c for x, c in zip(lengths, counts, strict=True))


def test_boundaries():
    for _ in range(300):
        n = RNG.randrange(1, 10)
        lengths, counts, most = sorted(RNG.sample(range(RNG.choice([12, 90, 5000])), n)), [RNG.choice([1, 2, 9, 1000]) for _ in range(n)], RNG.randrange(1, 6)
        best = min(cost((*cut, lengths[-1]), lengths, counts) for r in range(min(most, n)) for cut in itertools.combinations(lengths[:-1], r))
        ends = packing.boundaries(lengths, counts, most)
        assert len(ends) <= most and set(ends) <= set(lengths) and cost(ends, lengths, counts) == best
    # against quadratic dynamic programming
    lengths = sorted(RNG.sample(range(65_000), 250))
    counts = [RNG.randrange(1, 10**6) for _ in lengths]
    best = {0: 0}
    for _ in range(7):
        best = {j: min(best[i] + sum((lengths[j - 1] - x) * k for x, k in zip(lengths[i:j], counts[i:j], strict=True)) for i in range(j) if i in best) for j in range(1, 251)} | {0: 0}
    assert cost(packing.boundaries(lengths, counts, 7), lengths, counts) == best[250]


def test_packing(spark, rows, docs):
    docs = docs.unionByName(docs.where("doc_id = 10").withColumn("doc_id", F.lit(None).cast("bigint")))
    rows = [*rows, *((None, *r[1:]) for r in rows if r[0] == 10)]
    words = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x or ""))
    for budget, buckets in ((300, 4), (65_536, 16), (5, 2)):
        got = packing.pack(docs, budget=budget, buckets=buckets).collect()
        key = lambda x: (x[0] is None, x)
        assert sorted(((r.doc_id, r.n_tokens) for r in got), key=key) == sorted(((r[0], words(r[1])) for r in rows), key=key)
        assert all(r.padding == r.bucket_tokens - r.n_tokens >= 0 and r.oversize == (r.n_tokens > budget) for r in got)
        assert all(r.padding == 0 and sum(x.batch == r.batch for x in got) == 1 for r in got if r.oversize)
        by = Counter(r.n_tokens for r in got if not r.oversize)
        own = sorted(by)
        ends = {r.bucket_tokens for r in got if not r.oversize}
        assert len(ends) <= buckets and ends <= set(own)
        want = min(cost((*cut, own[-1]), own, [by[x] for x in own]) for k in range(min(buckets, 4)) for cut in itertools.combinations(own[:-1], k)) if len(own) < 40 and buckets <= 4 else None
        assert want is None or sum(r.padding for r in got) == want
        batches = Counter(r.batch for r in got)
        assert all(n * next(r.bucket_tokens for r in got if r.batch == b) <= budget or n == 1 for b, n in batches.items())
        assert len({(r.batch, r.slot) for r in got}) == len(got)
    assert packing.pack(docs.limit(0)).count() == 0
    one = spark.createDataFrame([(1, "a " * 70_000), (2, "b c")], "doc_id bigint, text string")
    assert {(r.doc_id, r.bucket_tokens, r.padding, r.oversize) for r in packing.pack(one).collect()} == {(1, 70_000, 0, True), (2, 2, 0, False)}
    assert packing.pack(one.where("doc_id = 1")).first().oversize and packing.pack(one, F.lit(None).cast("int")).where("n_tokens = 0").count() == 2


def test_packing_by_tokens(spark, docs):
    """The lengths are those of the encoder."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    n = bpe.lengths(docs, path, public_tokenizers.PATTERN)
    assert collected(n, "doc_id", "n_tokens") == collected(bpe.encode(docs, path, public_tokenizers.PATTERN), "doc_id", "n_tokens")
    assert collected(packing.pack(n, F.col("n_tokens")), "doc_id", "n_tokens") == collected(n, "doc_id", "n_tokens")
    encoder = bpe.Encoder(bpe.Merges(bpe.read_ranks(path)), public_tokenizers.PATTERN)
    odd = " \t\n\x0b\x1c\x1f\x85\xa0\u2003\u3000'"
    texts = ["".join(RNG.choice(odd + "ab1é. sdt") for _ in range(RNG.randrange(40))) for _ in range(3000)] + ["it's we'll  a 's 't", "a b c", " ", "", "日本 語 ١٢ x"]
    assert encoder.lengths(texts) == [len(x) for x in encoder.encode(texts)]
    assert encoder.lengths(texts[::-1]) == [len(x) for x in encoder.encode(texts[::-1])]


def test_html():
    page = (
        '<html><head><title>T</title><style>p{}</style></head><body><header><h2>Site</h2></header><nav><ul><li><a href="x">Home</a></li></ul></nav>'
        '<div class="ad">Buy this, now.</div><article><h1>Title &amp; more</h1><p>First <b>bold</b>ed,\n words\tof text, and more. &#233;<p>Second. <script>var a="</p>";</script>'
        '<form><p>Name, please.</p></form></article><aside>Side, notes.</aside><div id="comments"><p>I disagree, with all of it, really.</p></div><footer>&copy;</footer></body></html>'
    )
    assert html_main.main_text(page) == "Title & more First bolded, words of text, and more. é Second."
    assert html_main.main_text(page.replace("article>", "div>")).startswith("Title & more First")
    assert [html_main.main_text(x) for x in (None, "", "<", "<p", "a < b", "<p>x")] == ["", "", "<", "", "a < b", "x"]
    assert html_main.main_text("<div>" * 3000 + "deep, text." + "</div>" * 10) == "deep, text."


def test_html_keeps_short_parts():
    long, short = "Words of a long part, and more of them. " * 100, "A short part, of some words. " * 20
    parts = [f"<section><p>{long}</p></section>", "<h2>Between</h2>", f"<section><p>{short}</p></section>"]
    want = f"{long.strip()} Between {short.strip()}"
    assert html_main.main_text(f"<body><div>{''.join(parts)}</div></body>") == want
    assert html_main.main_text(f"<body>{''.join(parts)}</body>".replace("section>", "article>")) == want
    wrapped = [f"Paragraph {k}, " + "with words, " * n + "and an end." for k, n in enumerate((100, 12, 80, 15))]
    assert html_main.main_text("<body><div>" + "".join(f"<div><p>{x}</p></div>" for x in wrapped) + "</div></body>") == " ".join(wrapped)


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>a b.</p>", "z"), (2, None, None, "z"), (2, None, None, "z")], "page_id bigint, url string, html string, text string")
    assert collected(html_main.extract(df), "page_id", "text", "n_chars") == [(1, "a b.", 4), (2, "", 0), (2, "", 0)]


def test_large_buckets_are_dealt_anew(spark, monkeypatch):
    """With buckets that never fit, the same bytes go, in steps."""
    own = random.Random(4)
    common = "https://www.example.org/a/very/common/beginning/of/lines/that/all/texts/hold "
    part = [" ".join(own.choices(WORDS["bb"], k=12)) for _ in range(30)]
    texts = [" ".join(common[: own.randrange(20, len(common))] + own.choice(part) + own.choice(["", "é", "x" * 70]) for _ in range(12)) for _ in range(60)] + [" " * 300, "ab" * 90]
    texts += texts[:5] + [None, "short"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "doc_id bigint, text string").repartition(4)
    raw = [(x or "").encode() for x in texts]
    first = {}
    for i, x in enumerate(raw):
        for k in range(len(x) - 49):
            first.setdefault(x[k : k + 50], i)
    want = {}
    for i, x in enumerate(raw):
        gone = np.zeros(len(x), bool)
        for k in range(len(x) - 49):
            if first[x[k : k + 50]] < i:
                gone[k : k + 50] = True
        want[i] = bytes(b for b, g in zip(x, gone, strict=True) if not g)
    rounds = []
    stored = suffix_dedup.stored
    monkeypatch.setattr(suffix_dedup, "stored", lambda *x: (rounds.append(1), stored(*x))[1])
    assert {r.doc_id: bytes(r.kept_bytes) for r in suffix_dedup.remove_repeats(df).collect()} == want and len(rounds) == 2
    # the limit reaches the executors with the function
    monkeypatch.setattr(suffix_dedup, "_sorter", _small)
    assert {r.doc_id: bytes(r.kept_bytes) for r in suffix_dedup.remove_repeats(df).collect()} == want and len(rounds) > 4


def _small(n, step):
    def work(batches):
        from cuespark.llm import suffix_dedup  # the executor's own

        suffix_dedup.HOLD_BYTES, suffix_dedup.STEPS = 2000, 3
        try:
            yield from suffix_dedup._sorter(n, step)(batches)
        finally:
            suffix_dedup.HOLD_BYTES, suffix_dedup.STEPS = 24 << 20, 8

    return work
