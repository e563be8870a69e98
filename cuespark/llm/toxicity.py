"""Toxicity by a counterfactual-regularised linear classifier.

Features are the presence of words and of word beginnings (inflected forms share a stem), each scaled by the logarithm of
its odds in toxic texts, so that a word that only toxic texts have needs little evidence more.
The loss is logistic, plus a penalty on the squared change of the logit when the identity
terms of a labelled text are swapped for other terms of their set, plus L2: a bare mention of
a group then can't move the score. Vocabulary and weights are fitted on a bounded sample of the labelled rows,
which the executors cut down to the distinct words of each text before the driver gets it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespark.llm._util import arrow_map, pieces, stored

#: Bounds of the sample the weights are fitted on: rows of each label.
TRAIN_TOXIC = 5000
TRAIN_OTHER = 7000
#: The sample comes to the driver in so many parts, one after another.
READS = 64
#: At most so many features, those that tell most about the label first; each in at least so many documents.
FEATURES = 4_000
LEAST_DOCS = 4
PREFIXES = (4, 5, 6)
THRESHOLD = 0.3
L2 = 3e-3
SWAP = 1.0
CACHE = 500_000
ROUNDS = 400
#: Added to counts before their odds are taken.
PRIOR = 0.5
# Sets of identity terms; a term is swapped for the others of its set.
IDENTITY_SETS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrant", "refugee", "foreigner", "citizen"),
    ("immigrants", "refugees", "foreigners", "citizens"),
    ("old", "young", "elderly"),
    ("deaf", "blind", "disabled"),
)
_WORD = re.compile(r"[^\W\d_]+")


@dataclass
class Model:
    """weights by feature; bias."""

    weights: dict[str, float]
    bias: float


def features(text: str | None) -> set[str]:
    """Words of letters in lower case; of longer words also their beginnings, marked by a final '*'."""
    words = set(_WORD.findall(text.lower())) if text else set()
    out = set(words)
    for n in PREFIXES:
        out.update(w[:n] + "*" for w in words if len(w) > n)
    return out


def swapped(text: str, step: int) -> str:
    """text with every identity term replaced by the one step places on in its set; the rest stays."""
    return _WORD.sub(lambda m: _NEXT.get(m[0].lower(), (m[0],))[step % len(_NEXT.get(m[0].lower(), (m[0],)))], text)


_NEXT = {w: (*s[k + 1 :], *s[:k]) for s in IDENTITY_SETS for k, w in enumerate(s)}


def fit_weights(texts: list[str], labels: list[int], vocabulary: list[str], swaps: int = 2) -> Model:
    """Minimise logistic loss + SWAP * mean squared logit change under swaps + L2, by accelerated gradient steps.

    Each weight's step follows a bound on its own curvature: the sum over a feature's rows of that row's features.
    """
    index = {w: k for k, w in enumerate(vocabulary)}
    d = len(vocabulary)
    y = np.asarray(labels, float)
    n = len(texts)
    if not n or not d or y.min() == y.max():
        return Model({}, -4.0 if not n or not y.any() else 4.0)
    found = [sorted(index[f] for f in features(x) if f in index) for x in texts]
    row = np.repeat(np.arange(n), [len(f) for f in found])
    col = np.fromiter((k for f in found for k in f), np.int64, len(row))
    toxic, other = ((np.bincount(col, z[row], d) + PRIOR) / (z.sum() + 2 * PRIOR) for z in (y, 1 - y))
    size = np.abs(np.log(toxic / other))
    mass = np.bincount(row, size[col], n)
    # what differs between a text and the text with its identity terms swapped
    change: list[tuple[int, int, int]] = []
    n_pairs = 0
    for x, own in zip(texts, found, strict=True):
        for s in (swapped(x, k) for k in range(swaps)):
            if s != x:
                now = {index[f] for f in features(s) if f in index}
                change += [(n_pairs, f, 1) for f in sorted(set(own) - now)] + [(n_pairs, f, -1) for f in sorted(now.difference(own))]
                n_pairs += 1
    pair, feature, sign = np.array(change, np.int64).reshape(-1, 3).T
    step = sign * size[feature]
    curve = 0.25 / n * np.bincount(col, size[col] * (mass[row] + 1), d) + L2
    if n_pairs:
        curve += 2 * SWAP / n_pairs * np.bincount(feature, np.abs(step) * np.bincount(pair, np.abs(step), n_pairs)[pair], d)
    w, b = np.zeros(d), np.log(y.mean() / (1 - y.mean()))
    vw, vb = w.copy(), b
    for t in range(ROUNDS):
        z = np.bincount(row, (size * vw)[col], n) + vb
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g = np.bincount(col, size[col] * (p - y)[row], d) / n + L2 * vw
        if n_pairs:
            g += 2 * SWAP / n_pairs * np.bincount(feature, step * np.bincount(pair, step * vw[feature], n_pairs)[pair], d)
        nw, nb = vw - g / curve, vb - (p - y).mean() / (0.25 * (mass.mean() + 1))
        m = t / (t + 3)
        vw, vb = nw + m * (nw - w), nb + m * (nb - b)
        w, b = nw, nb
    return Model({v: float(x) for v, x in zip(vocabulary, w * size, strict=True) if abs(x) > 1e-4}, float(b))


def score(model: Model, text: str | None, cache: dict[str, tuple[str, ...]] | None = None) -> float:
    """cache: of the model's features by word, filled here; emptied when it holds CACHE words."""
    cache = {} if cache is None else cache
    if len(cache) > CACHE:
        cache.clear()
    found: set[str] = set()
    for word in set(_WORD.findall(text.lower())) if text else ():
        own = cache.get(word)
        if own is None:
            own = cache[word] = tuple(f for f in features(word) if f in model.weights)
        if own:
            found.update(own)
    z = model.bias + sum(model.weights[f] for f in sorted(found))
    return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on labelled rows that are not held out: a sample bounded by TRAIN_TOXIC and TRAIN_OTHER, by hash of the id.

    Labels other than 0 and 1, null ones included, and rows with a null id don't count; of several labels of an id the
    larger does. Documents without text are left out; rows that repeat an id are all taken. Without a label of each kind the
    model has no weights, and scores all texts alike. Documents' and labels' other columns are ignored.
    """
    marks = (
        labels.select(F.col(id_col).alias("i"), F.col("toxic").alias("y"))
        .where(F.col("i").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("i")))
        .groupBy("i")
        .agg(F.max("y").alias("y"))
    )
    counts = {r["y"]: r["count"] for r in marks.groupBy("y").count().collect()}
    keep = F.lit(False)
    for y, most in ((1, TRAIN_TOXIC), (0, TRAIN_OTHER)):
        if n := counts.get(y, 0):
            part = min(1.0, most / n)
            keep = keep | ((F.col("y") == y) & (F.pmod(F.xxhash64("i"), F.lit(1 << 20)) < int(part * (1 << 20)) + (part == 1.0)))
    chosen = F.broadcast(marks.where(keep))  # at most about TRAIN_TOXIC + TRAIN_OTHER rows of two numbers
    picked = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("x")).where("x is not null").join(chosen, "i")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "x", 8 << 20):
            own = [" ".join(sorted(set(_WORD.findall(x.lower())))) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.string()), batch.column(2)], ["i", "x", "y"])

    schema = f"i {picked.schema['i'].dataType.simpleString()}, x string, y {picked.schema['y'].dataType.simpleString()}"
    texts, ys, df = [], [], {}
    # the scan runs on all executors; the driver then reads the bounded sample alone, in order of the ids
    for r in stored(arrow_map(picked.select("i", "x", "y"), words, schema), "toxicity-sample").repartitionByRange(READS, "i").sortWithinPartitions("i", "x").toLocalIterator(prefetchPartitions=True):
        for f in features(r["x"]):
            df.setdefault(f, [0, 0])[r["y"]] += 1
        texts.append(r["x"])
        ys.append(int(r["y"]))
    total = max(1, len(ys))
    pos = max(1, sum(ys))
    told = {}
    for f, (n0, n1) in df.items():
        if n0 + n1 >= LEAST_DOCS:
            expected = (n0 + n1) * pos / total
            told[f] = (n1 - expected) ** 2 / (expected + 1.0) + (n1 - expected) ** 2 / (n0 + n1 - expected + 1.0)
    vocabulary = sorted(sorted(told, key=lambda f: (-told[f], f))[:FEATURES])
    del df
    return fit_weights(texts, ys, vocabulary)


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row. Null and empty texts get the bias alone.

    Repeated rows give repeated rows, null ids pass through and count as not held out, an empty table gives no rows; other columns
    are ignored. Long texts are read whole. Equal sets of words have equal scores. The model is bounded by FEATURES and is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, cache = shared.value, {}
        for batch in pieces(batches, "cs_text", 8 << 20):
            got = [score(own, x, cache) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(got, pa.float64()),
                    pa.array([int(x >= THRESHOLD) for x in got], pa.int32()),
                ],
                [id_col, "held_out", "score", "predicted"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("cs_held"), F.col(text_col).alias("cs_text"))
    return arrow_map(rows, work, f"`{id_col}` {kind}, held_out boolean, score double, predicted int")
