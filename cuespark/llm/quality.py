"""Quality rules: word and line counts, and compression bands.

A document is compressed by zstandard as a whole and, if longer than a chunk, in fixed chunks, the
last of which ends with the text (it can overlap the one before), so that every byte is in one. Text that compresses
much better than prose of its length repeats itself; text that hardly compresses is noise.
The limits depend on the length, as short texts compress less. Letters that UTF-8 writes as two or
three bytes are recoded first (coded()), so that one limit holds for all alphabets. One pass, no shuffle.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from cuespark.llm._util import arrow_map

SYMBOLS = b"#*$%&|<>"
LEVEL = 3
CHUNK_BYTES = 1024
#: (bytes, least, most ratio of bytes to compressed bytes); between two lengths the limits follow the logarithm of the length.
#: Least lies between noise (random or base64 words, random Han) and the lowest of 3,000 pieces of prose, most some 15 to 30 % over the highest.
#: Under 96 bytes noise and prose can't be told apart, and only repetition is judged.
LIMITS = (
    (64, 0.0, 1.60),
    (95, 0.0, 1.65),
    (96, 0.95, 1.65),
    (128, 1.00, 1.80),
    (192, 1.10, 1.90),
    (256, 1.15, 2.00),
    (384, 1.22, 2.15),
    (512, 1.29, 2.25),
    (768, 1.36, 2.40),
    (1024, 1.43, 2.55),
    (2048, 1.50, 2.75),
    (4096, 1.55, 2.95),
    (8192, 1.57, 3.10),
    (16384, 1.58, 3.30),
    (65536, 1.60, 3.60),
    (1 << 20, 1.60, 4.00),
)
#: The share of chunks outside the limits of their length that is let pass.
CHUNK_SHARE = 0.3
#: Letters beyond ASCII that get a byte of their own; of a text with more than a share of others the UTF-8 is judged as it is.
ALPHABET, OTHER_SHARE = 127, 0.1
#: The first code point of scripts whose letters are thousands.
DENSE = "\u2e80"
MIN_WORDS = 50

SCHEMA = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "ratio double, n_chunks bigint, n_chunks_out bigint, base_failed boolean, kept boolean"
)


def measures(text: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of UTF-8 bytes.

    bytes.split() divides at exactly space and 0x09-0x0D; code points are the bytes that do
    not continue a character.
    """
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    chars = len(joined.translate(None, _CONTINUES))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.split(None, 1)]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if n >= 3 and len(windows) < n - 2:
        last = -1
        for k, w in enumerate(zip(words, words[1:], words[2:], strict=False)):
            if windows[w] > 1:
                repeated += k + 2 - max(last, k - 1)
                last = k + 2
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


_CONTINUES = bytes(range(0x80, 0xC0))


def coded(text: bytes) -> list[bytes]:
    """The forms of UTF-8 to judge: text of any alphabet has in one of them the size and the ratio of Latin text.

    One has a byte for each of the ALPHABET most frequent code points beyond ASCII and four for others, unless
    others are over OTHER_SHARE of all; the UTF-8 as it is is the other, where that is so or letters of thousands (Han,
    Hangul ...) are over OTHER_SHARE: its ratio is near that of Latin text then. Text in ASCII has one form.
    """
    if text.isascii():
        return [text]
    whole = text.decode("utf-8", "replace")
    own = {c for c in set(whole) if c > "\x7f"}
    rest: list[str] = []
    forms = []
    if len(own) > ALPHABET or max(own) >= DENSE:
        counts = Counter(c for c in whole if c > "\x7f")
        rest = sorted(own, key=lambda c: (-counts[c], c))[ALPHABET:]
        others = sum(counts[c] for c in rest) > OTHER_SHARE * len(whole)
        if others or sum(n for c, n in counts.items() if c >= DENSE) > OTHER_SHARE * len(whole):
            forms.append(text)
            if others:
                return forms
        own.difference_update(rest)
    table = {ord(c): 0x80 + k for k, c in enumerate(sorted(own))}
    table |= {ord(c): "\xff" + ord(c).to_bytes(3).decode("latin-1") for c in rest}
    return [whole.translate(table).encode("latin-1"), *forms]


_SIZES = [n for n, *_ in LIMITS]


def limits(size: int) -> tuple[float, float]:
    """(least, most) ratio of a text of so many bytes."""
    k = bisect_right(_SIZES, size)
    if k in (0, len(LIMITS)):
        return LIMITS[min(k, len(LIMITS) - 1)][1:]
    (n, *low), (m, *high) = LIMITS[k - 1], LIMITS[k]
    part = math.log(size / n) / math.log(m / n)
    return tuple(a + part * (b - a) for a, b in zip(low, high, strict=True))


def judged(text: bytes, press: zstandard.ZstdCompressor) -> tuple[float, int, int, bool]:
    """(ratio of the whole, chunks, chunks outside their limits, verdict) of a form of a text."""
    size = len(text)
    ratio = size / len(press.compress(text))
    low, high = limits(size)
    starts = [*range(0, size - CHUNK_BYTES, CHUNK_BYTES), size - CHUNK_BYTES] if size > CHUNK_BYTES else []
    least, most = limits(CHUNK_BYTES)
    out = sum(not least <= CHUNK_BYTES / len(press.compress(text[k : k + CHUNK_BYTES])) <= most for k in starts)
    return ratio, len(starts), out, low <= ratio <= high and out <= CHUNK_SHARE * len(starts)


def in_band(text: bytes, press: zstandard.ZstdCompressor) -> tuple[float, int, int, bool]:
    """judged() of the first form that passes, else of the first. Empty text passes."""
    first = None
    for form in coded(text) if text else []:
        got = judged(form, press)
        if got[3]:
            return got
        first = first or got
    return first or (1.0, 0, 0, True)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: its id and SCHEMA. Null or empty text has no words and fails.

    base_failed: under MIN_WORDS words, or over half of the words in repeated 3-word windows.
    kept: not base_failed, and within the compression bands. Null ids pass through, repeated rows give repeated rows, an
    empty table an empty one; other columns are ignored. Long texts are read whole, one at a time.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            rows = []
            for value in batch.column(1):
                text = value.as_buffer().to_pybytes() if value.is_valid else b""
                m = measures(text)
                failed = m[0] < MIN_WORDS or 100 * m[4] > 50 * m[0]
                ratio, chunks, out, passed = in_band(text, press)
                rows.append((*m, ratio, chunks, out, failed, passed and not failed))
            kinds = [pa.int64()] * 5 + [pa.float64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
            columns = zip(*rows, strict=True) if rows else [[]] * 10
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                [id_col, *(x.split()[0] for x in SCHEMA.split(", "))],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(id_col, text_col), work, f"`{id_col}` {kind}, {SCHEMA}")


def keep_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids of documents that are kept; see quality()."""
    return quality(docs, id_col, text_col).where("kept").select(id_col)
