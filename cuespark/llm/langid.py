"""Language identification by bit-sliced Bloom filters of character n-grams.

Training counts the n-grams of a bounded sample of labelled texts per language and puts each
language's characteristic n-grams into a Bloom filter. All filters share their hash
positions, so they are stored bit-sliced: the language bits of a position side by side, in as many words as they take. ANDing the
words at an n-gram's positions returns every language whose filter contains it. A text's
score per language is the popcount over its n-grams, corrected for that filter's measured rate of false
positives; the best language is returned.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespark.llm._util import arrow_map, pieces, stored

#: A bounded sample of labelled rows is trained on: at most so many rows a language, and so many characters of them in total.
TRAIN_ROWS = 3000
TRAIN_CHARS = 4_000_000
ORDERS = (2, 3, 4)
GRAMS_PER_LANGUAGE = 60_000
#: An n-gram goes to a language's filter if its share there is at least this part of its largest share in any language.
SHARE = 0.5
LOG2_SLOTS = 21
HASHES = 3
UNDETERMINED = "und"
_MULT = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


@dataclass
class Model:
    """languages in order of their bits; table: by slot a byte for up to 8 languages, else one uint64 for every 64; rates: false positives per language."""

    languages: list[str]
    table: np.ndarray
    rates: np.ndarray
    counts: np.ndarray


def gram_hashes(text: str, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """A 64-bit hash for each n-gram of the folded text: lower case, every run of non-letters one space."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(points) == 0:
        return np.empty(0, np.uint64)
    plain = ((points >= 97) & (points <= 122)) | (points >= 0xC0)
    points = np.where(plain, points, np.uint64(32))
    keep = np.ones(len(points), bool)
    keep[1:] = plain[1:] | plain[:-1]
    points = np.concatenate(([np.uint64(32)], points[keep], [np.uint64(32)]))
    out = []
    with np.errstate(over="ignore"):
        h = points * _MULT[0]
        h ^= h >> np.uint64(29)
        for n in range(2, max(orders) + 1):  # each order extends the one before
            if len(points) < n:
                break
            h = (h[:-1] ^ points[n - 1 :]) * _MULT[0]
            h ^= h >> np.uint64(29)
            if n in orders:
                out.append(h)
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def slots(h: np.ndarray, log2_slots: int = LOG2_SLOTS) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        return [((h * _MULT[k + 1]) >> np.uint64(64 - log2_slots)).astype(np.int64) for k in range(HASHES)]


def contains(model: Model, h: np.ndarray) -> np.ndarray:
    """Language bits of each n-gram."""
    bits = None
    for s in slots(h, int(math.log2(len(model.table)))):
        bits = model.table[s] if bits is None else bits & model.table[s]
    return bits


def bits_of(bits: np.ndarray, k: int) -> np.ndarray:
    """The words that hold the bit of language k."""
    return bits if bits.ndim == 1 else bits[:, k // 64]


def known(bits: np.ndarray, k: int) -> int:
    """In how many rows of bits language k has its bit."""
    return np.count_nonzero(bits_of(bits, k) & bits.dtype.type(1 << k % 64))


def train(samples: dict[str, list[str]]) -> Model:
    """A model of {language: texts}, of all of its languages."""
    languages = sorted(samples)
    counts: list[Counter] = []
    for lang in languages:
        c: Counter = Counter()
        for text in samples[lang]:
            keys, n = np.unique(gram_hashes(text), return_counts=True)
            c.update(dict(zip(keys.tolist(), n.tolist(), strict=True)))
        counts.append(c)
    totals = [max(1, sum(c.values())) for c in counts]
    best: dict[int, float] = {}
    for c, total in zip(counts, totals, strict=True):
        for key, n in c.items():
            best[key] = max(best.get(key, 0.0), n / total)
    table = np.zeros(1 << LOG2_SLOTS, np.uint8) if len(languages) <= 8 else np.zeros((1 << LOG2_SLOTS, -(-len(languages) // 64)), np.uint64)
    sizes = []
    for k, (c, total) in enumerate(zip(counts, totals, strict=True)):
        own = [key for key, n in c.most_common() if n >= 2 and n / total >= SHARE * best[key]][:GRAMS_PER_LANGUAGE]
        sizes.append(len(own))
        for s in slots(np.array(own, np.uint64)):
            bits_of(table, k)[s] |= table.dtype.type(1 << k % 64)
    fill = np.array([known(table, k) / len(table) for k in range(len(languages))])
    return Model(languages, table, fill**HASHES, np.array(sizes))


def shares(model: Model, text: str | None) -> np.ndarray | None:
    """The share of the text's n-grams that each language knows, corrected for its filter's false positives; None if there is nothing to go by."""
    if not text or not model.languages or not any(x.isalpha() for x in text):
        return None
    h = gram_hashes(text)
    if not len(h):
        return None
    bits = contains(model, h)
    if model.table.dtype == np.uint8:
        n = np.bincount(bits, minlength=256)
        hits = n @ ((np.arange(256)[:, None] >> np.arange(len(model.languages))) & 1)
    else:
        hits = np.array([known(bits, k) for k in range(len(model.languages))])
    return np.clip((hits / len(h) - model.rates) / (1 - model.rates), 0, 1)


def predict(model: Model, text: str | None) -> tuple[str, float]:
    """(language, score 0 to 1): the corrected share of n-grams that the language knows, against all languages' shares."""
    share = shares(model, text)
    if share is None:
        return UNDETERMINED, 0.0
    k = int(np.argmax(share))
    total = share.sum()
    return model.languages[k], float(share[k] / total) if total > 0 else 0.0


def stands_out(model: Model, text: str | None) -> bool:
    """Whether the best language knows LEAST_KNOWN of the n-grams, and more than the next one by MARGIN of those it doesn't know.

    Both are shares of the text's own n-grams, so neither changes with the number of languages.
    """
    share = shares(model, text)
    if share is None:
        return False
    best, *rest = sorted(share, reverse=True)
    return bool(best >= LEAST_KNOWN and best - (rest[0] if rest else 0) >= MARGIN * (1 - best))


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> dict[str, list[str]]:
    """A bounded sample of labelled rows for training, by hash of the id, alike for every language.

    About TRAIN_ROWS rows of each language reach the driver, whose texts are kept up to TRAIN_CHARS. Rows with equal ids are taken or left together.
    """
    rows = docs.select(F.col(id_col).alias("i"), F.col(lang_col).alias("l"), F.length(text_col).alias("n")).where(
        F.col("l").isNotNull() & (F.col("n") > 0) & ~held_out(F.col("i"))
    )
    order = F.xxhash64("i")
    # a fixed share of each larger language's hash range, so that the expected number is the bound; of the others all
    large = rows.groupBy("l").count().where(F.col("count") > TRAIN_ROWS).orderBy("l").collect()
    parts = [F.lit(x) for r in large for x in (r["l"], int(TRAIN_ROWS / r["count"] * (1 << 20)))]
    share = F.pmod(order, F.lit(1 << 20)) < F.coalesce(F.create_map(*parts)[F.col("l")], F.lit(1 << 20)) if parts else F.lit(True)
    picked = docs.select(F.col(id_col).alias("i"), F.col(lang_col).alias("l"), F.col(text_col).alias("x")).where(
        F.col("l").isNotNull() & (F.length("x") > 0) & ~held_out(F.col("i")) & share
    )
    out: dict[str, list[str]] = {}
    chars: Counter = Counter()
    # the scan runs on all executors; the driver then reads the bounded sample alone, in an order that no file layout changes
    for r in stored(picked, "language-sample").orderBy(order, "i").toLocalIterator(prefetchPartitions=True):
        if chars[r["l"]] < TRAIN_CHARS:
            out.setdefault(r["l"], []).append(r["x"])
            chars[r["l"]] += len(r["x"])
    return out


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from rows that have a language and are not held out.

    Rows with a null id count as not held out; rows with null or empty text or a null language are left out. A table without such
    rows gives a model without languages, for which every text is `und`. Of repeated rows all count.
    """
    return train(sample(docs, id_col, text_col, lang_col))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score) of every row. Null text or text without a letter is `und`, score 0.

    The model's size is 2^LOG2_SLOTS words for every 64 languages, whatever the rows, so it is broadcast. Repeated rows give
    repeated rows; other columns are ignored; ties go to the language that sorts first.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in pieces(batches, "cs_text", 8 << 20):
            got = [predict(own, x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([x[0] for x in got], pa.string()),
                    pa.array([x[1] for x in got], pa.float64()),
                ],
                [id_col, "held_out", "lang_pred", "score"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), held_out(F.col(id_col)).alias("cs_held"), F.col(text_col).alias("cs_text"))
    return arrow_map(rows, work, f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double")


#: What accepted() asks of the best language; see stands_out(). Random words have 0.16 at most, texts of a language not learned about 0.2.
LEAST_KNOWN, MARGIN = 0.4, 0.05


def accepted(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose text has a language that stands out.

    Null texts and texts without a letter go. Null ids don't matter, repeated rows share their fate, an empty table stays empty;
    without any labelled row no language is known and all rows go. Long texts are read whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in pieces(batches, text_col, 8 << 20):
            yield batch.filter(pa.array([stands_out(own, x) for x in batch.column(batch.schema.get_field_index(text_col)).to_pylist()], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)
