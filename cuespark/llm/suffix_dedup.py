"""Repeated passages by blockwise suffix sorting with a difference cover.

Suffixes are the starts of WINDOW-byte strings. They are dealt to buckets by content (the least hashed GRAM in their window
names the bucket), so equal strings meet; a run of suffixes of one bucket travels as one
segment of text. Buckets are sorted one at a time: a bucket's suffixes are ordered by their
first PERIOD bytes, and ties by the ranks of the difference-cover sample, which is sorted
first: of any two suffixes, both have a sampled suffix at one same offset under PERIOD. A
suffix that has the rank of one in a document with a smaller id marks its bytes as removed.

Equal segments are combined before they are shuffled and again in their bucket, and only
suffixes whose fingerprint is not unique in the bucket are sorted, so passages held by very
many documents cost one segment each map task. A bucket that grows over HOLD_BYTES isn't held:
its segments are combined and dealt anew, by another hash of the grams, to buckets of their own,
which are sorted in a next step. So no task holds more, however common a gram is. The bytes removed are exact.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespark.llm._util import arrow_map, partitions, pieces, stored

WINDOW = 50
GRAM = 12
PERIOD = 16
COVER = (0, 1, 2, 5, 8)
#: Text that a map task deals out at a time; text that is hashed at a time; segments that a bucket holds on average.
BLOCK_BYTES = 12 << 20
SLICE_BYTES = 1 << 15
BUCKET_BYTES = 8 << 20
#: Segments of a bucket hold this many times the text, about.
SPREAD = 3.5
#: Buckets are sorted in so many rounds, each with a scan of its own, so that a part of the segments alone is on the disk; all of them take 3.7 times the input.
ROUNDS = 2
#: Text of segments that a task holds of one bucket; a bucket of more is dealt anew to FANOUT buckets, with another hash each time, in STEPS steps at most.
HOLD_BYTES = 24 << 20
FANOUT = 64
STEPS = 8
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_SHIFT = [[next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)]


def _mixed(step: int) -> np.uint64:
    """An odd multiplier for each step; the first has _M3."""
    x = np.uint64(int.from_bytes(hashlib.sha256(b"%d" % step).digest()[:8], "little"))
    return x | np.uint64(1) if step else _M3


def bucket_of(text: np.ndarray, buckets: int, step: int = 0) -> np.ndarray:
    """The bucket of the window that starts at each place; text has at least WINDOW bytes. Each step has a hash of its own."""
    own = _mixed(step)
    n = len(text) - WINDOW + 1
    out = np.empty(n, np.int32)
    with np.errstate(over="ignore"):
        for at in range(0, n, SLICE_BYTES):
            part = text[at : min(at + SLICE_BYTES, n) + WINDOW - 1].astype(np.uint64)
            w2 = part[:-1] | part[1:] << np.uint64(8)
            w4 = w2[:-2] | w2[2:] << np.uint64(16)
            w8 = w4[:-4] | w4[4:] << np.uint64(32)
            h = w8[:-4] * _M1 + w4[8:] * _M2
            h ^= h >> np.uint64(31)
            low = ((h * own) >> np.uint64(32)).astype(np.uint32)
            width = WINDOW - GRAM + 1
            span = 1
            while 2 * span <= width:
                low = np.minimum(low[:-span], low[span:])
                span *= 2
            if width > span:
                low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
            mixed = (low.astype(np.uint64) * _M1) >> np.uint64(32)
            out[at : at + len(low)] = ((mixed & np.uint64(0xFFFFFFFF)) * np.uint64(buckets)) >> np.uint64(32)
    return out


def _write(docs: list[tuple[int, int]], doc: np.ndarray, start: np.ndarray, sizes: np.ndarray, text: bytes) -> bytes:
    used, doc = np.unique(doc, return_inverse=True)
    table = np.array([docs[k] for k in used.tolist()], np.int64).reshape(-1, 2)
    head = struct.pack("<III", len(table), len(doc), len(text))
    return zstandard.ZstdCompressor(level=1).compress(
        b"".join((head, table.tobytes(), doc.astype("<u4").tobytes(), start.astype("<u4").tobytes(), sizes.astype("<u4").tobytes(), text))
    )


def _read(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(documents as id and key, document of each segment, starts, sizes, text)."""
    raw = zstandard.ZstdDecompressor().decompress(raw)
    d, n, t = struct.unpack_from("<III", raw)
    at = 12
    table = np.frombuffer(raw, np.int64, 2 * d, at).reshape(-1, 2)
    at += 16 * d
    three = [np.frombuffer(raw, "<u4", n, at + 4 * n * k).astype(np.int64) for k in range(3)]
    return table, *three, raw[at + 12 * n : at + 12 * n + t]


def _dealer(buckets: int, doc_parts: int, turn: int = 0, rounds: int = 1):
    """Texts to segments of this turn's buckets; spans that a smaller document of the same block settles go straight to their document's part."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "cs_text", BLOCK_BYTES):
            rows = sorted(
                (i, key, text.as_buffer().to_pybytes())
                for i, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True)
                if i is not None and text.is_valid and len(text.as_buffer()) >= WINDOW
            )
            spans: list[tuple[int, int, int, int]] = []
            first: dict[bytes, int] = {}
            own: list[tuple[int, int, bytes]] = []
            for i, key, text in rows:
                least = first.setdefault(text, i)
                if least < i:
                    if turn == 0:
                        spans.append((i, key, 0, len(text)))
                elif not own or own[-1][:2] != (i, key):
                    own.append((i, key, text))
            del rows
            first.clear()
            if own:
                whole = b"".join(t for *_, t in own)
                text = np.frombuffer(whole, np.uint8)
                ends = np.cumsum([len(t) for *_, t in own])
                starts = np.concatenate(([0], ends[:-1]))
                to = bucket_of(text, buckets)
                # windows that run into the next document belong to no bucket
                for e in ends[:-1].tolist():
                    to[max(0, e - WINDOW + 1) : e] = -1
                cuts = np.concatenate(([0], np.flatnonzero(to[1:] != to[:-1]) + 1, [len(to)]))
                begin, stop, to = cuts[:-1], cuts[1:] + WINDOW - 1, to[cuts[:-1]]
                good = (to >= 0) & (to % rounds == turn)
                begin, stop, to = begin[good], stop[good], to[good]
                doc = np.searchsorted(ends, begin, "right")
                seen: dict[bytes, int] = {}
                keep = np.ones(len(begin), bool)
                ids = [i for i, *_ in own]
                keys = [k for _, k, _ in own]
                offsets = starts.tolist()
                for k, (a, b, d) in enumerate(zip(begin.tolist(), stop.tolist(), doc.tolist(), strict=True)):
                    if ids[seen.setdefault(whole[a:b], d)] < ids[d]:
                        keep[k] = False
                        a -= offsets[d]
                        b -= offsets[d]
                        if spans and spans[-1][0] == ids[d] and spans[-1][1] == keys[d] and spans[-1][2] <= a <= spans[-1][3]:
                            spans[-1] = (*spans[-1][:3], max(b, spans[-1][3]))
                        else:
                            spans.append((ids[d], keys[d], a, b))
                seen.clear()
                begin, stop, to, doc = begin[keep], stop[keep], to[keep], doc[keep]
                order = np.argsort(to, kind="stable")
                to = to[order]
                table = [(i, key) for i, key, _ in own]
                del own
                names, blobs = [], []
                at = np.concatenate(([0], np.flatnonzero(to[1:] != to[:-1]) + 1, [len(to)])) if len(to) else [0]
                for a, b in zip(at, at[1:], strict=False):
                    pick = order[a:b]
                    x, y = begin[pick], stop[pick]
                    text = b"".join([whole[c:d] for c, d in zip(x.tolist(), y.tolist(), strict=True)])
                    blobs.append(_write(table, doc[pick], x - starts[doc[pick]], y - x, text))
                    names.append(int(to[a]))
                yield _batch([0] * len(names), names, blobs)
            if spans:
                yield _spans(spans, doc_parts)

    return work


def _batch(kinds: list[int], places: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(kinds, pa.int32()), pa.array(places, pa.int64()), pa.array(blobs, pa.binary())], ["kind", "place", "blob"]
    )


def _part_of(ids: np.ndarray, doc_parts: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (((ids.astype(np.uint64) * _M1) >> np.uint64(33)) % np.uint64(doc_parts)).astype(np.int64)


def _spans(spans: list[tuple[int, int, int, int]], doc_parts: int) -> pa.RecordBatch:
    """Spans (id, key, start, end), packed by the part of their document."""
    rows = np.array(spans, np.int64)
    part = _part_of(rows[:, 0], doc_parts)
    order = np.argsort(part, kind="stable")
    rows, part = rows[order], part[order]
    at = np.concatenate(([0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]))
    press = zstandard.ZstdCompressor(level=1)
    return _batch(
        [1] * (len(at) - 1),
        part[at[:-1]].tolist(),
        [press.compress(np.ascontiguousarray(rows[a:b].T).tobytes()) for a, b in zip(at, at[1:], strict=False)],
    )


def _word(text: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place as one number that orders like them."""
    out = np.zeros(len(places), np.uint64)
    for k in range(8):
        out = out << np.uint64(8) | text[places + k]
    return out


def _refined(rank: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Ranks (numbers of smaller ones) by rank, then key."""
    counts = np.bincount(rank, minlength=len(rank))
    tied = np.flatnonzero(counts[rank] > 1)
    if not len(tied):
        return rank
    order = tied[np.lexsort((key[tied], rank[tied]))]
    r, k = rank[order], key[order]
    n = np.arange(len(order))
    new = np.concatenate(([True], r[1:] != r[:-1]))
    group = np.maximum.accumulate(np.where(new, n, 0))
    new[1:] |= k[1:] != k[:-1]
    out = rank.copy()
    out[order] = r + np.maximum.accumulate(np.where(new, n, 0)) - group
    return out


def cover_ranks(text: np.ndarray, sample: np.ndarray) -> dict[int, np.ndarray]:
    """Ranks of the sampled suffixes by their first h bytes, for each h that ties need: WINDOW - PERIOD + 1 to WINDOW."""
    rank = np.zeros(len(sample), np.int64)
    steps = range(0, WINDOW, 8)
    for k in steps:
        key = _word(text, sample + k)
        if WINDOW - k < 8:
            key >>= np.uint64(8 * (8 - WINDOW + k))
        rank = _refined(rank, key)
    order = np.argsort(rank, kind="stable")
    common = np.zeros(max(0, len(order) - 1), np.int64)  # bytes that each has in common with the next
    going = np.ones(len(common), bool)
    a, b = sample[order[:-1]], sample[order[1:]]
    for k in range(WINDOW):
        going &= text[a + k] == text[b + k]
        common += going
    out = {}
    for h in range(WINDOW - PERIOD + 1, WINDOW + 1):
        own = np.empty(len(sample), np.int64)
        own[order] = np.concatenate(([0], np.cumsum(common < h))) if len(order) else order
        out[h] = own
    return out


def suffix_ranks(text: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
    """Of each suffix, the number of suffixes given whose first WINDOW bytes are smaller: its place in the suffix array.

    text has 64 bytes more than any window. Suffixes of each residue modulo PERIOD are
    merged with those of each other residue by (rank of the first PERIOD bytes, rank of the
    cover sample at the offset that the two residues share).
    """
    n = len(suffixes)
    head = _refined(_refined(np.zeros(n, np.int64), _word(text, suffixes)), _word(text, suffixes + 8))
    near = np.zeros(len(text) + 1, np.int32)
    np.add.at(near, suffixes, 1)
    np.add.at(near, suffixes + PERIOD, -1)
    wanted = np.isin(np.arange(PERIOD), COVER)
    sample = np.flatnonzero(np.cumsum(near[:-1]) > 0)
    sample = sample[wanted[sample % PERIOD]]
    ranks = cover_ranks(text, sample)
    residue = suffixes % PERIOD
    of = [np.flatnonzero(residue == a) for a in range(PERIOD)]
    at = {}
    for a in range(PERIOD):
        for d in {_SHIFT[a][b] for b in range(PERIOD)}:
            at[a, d] = np.searchsorted(sample, suffixes[of[a]] + d)
    scale = len(sample) + 1
    out = np.zeros(n, np.int64)
    for a in range(PERIOD):
        if not len(of[a]):
            continue
        for b in range(PERIOD):
            if not len(of[b]):
                continue
            d = _SHIFT[a][b]
            by = ranks[WINDOW - d]
            mine = head[of[a]] * scale + by[at[a, d]]
            other = mine if a == b else head[of[b]] * scale + by[at[b, d]]
            out[of[a]] += np.searchsorted(np.sort(other), mine, "left")
    return out


def fingerprints(text: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the WINDOW bytes from each place; text has at least that many."""
    n = len(text) - WINDOW + 1
    out = np.empty(n, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, n, SLICE_BYTES):
            h = (text[at : min(at + SLICE_BYTES, n) + WINDOW - 1].astype(np.uint64) + np.uint64(1)) * _M1
            span = 1
            while 2 * span <= WINDOW:
                h = (h[:-span] ^ (h[:-span] >> np.uint64(29))) * _M2 + h[span:]
                span *= 2
            rest = WINDOW - span
            out[at : at + len(h) - rest] = (h[: len(h) - rest] ^ (h[: len(h) - rest] >> np.uint64(31))) * _M3 + h[rest:]
    return out


def _gathered(blobs: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(distinct segments, and of every segment its number there, its document as id and key, its start)."""
    number: dict[bytes, int] = {}
    which: list[np.ndarray] = []
    docs, starts = [], []
    for raw in blobs:
        table, doc, start, sizes, text = _read(raw)
        ends = np.cumsum(sizes)
        cut = [text[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
        which.append(np.fromiter((number.setdefault(s, len(number)) for s in cut), np.int64, len(cut)))
        docs.append(table[doc])
        starts.append(start)
    return list(number), np.concatenate(which), np.concatenate(docs), np.concatenate(starts)


def deal_again(blobs: list[bytes], place: int, step: int, doc_parts: int) -> Iterator[pa.RecordBatch]:
    """Segments of a part of a bucket to buckets of the next step; those that a smaller document of the part has as well go as spans at once."""
    number, of, doc, start = _gathered(blobs)
    least = np.full(len(number), np.iinfo(np.int64).max)
    np.minimum.at(least, of, doc[:, 0])
    sizes = np.fromiter(map(len, number), np.int64, len(number))
    whole = doc[:, 0] > least[of]
    if whole.any():
        yield _spans(np.stack((doc[whole, 0], doc[whole, 1], start[whole], start[whole] + sizes[of[whole]]), 1), doc_parts)
    mine = np.flatnonzero(~whole)
    text = b"".join(number)
    begins = np.cumsum(sizes) - sizes
    to = bucket_of(np.frombuffer(text, np.uint8), FANOUT, step)
    for e in begins[1:].tolist():  # windows that run into the next segment belong to no bucket
        to[max(0, e - WINDOW + 1) : e] = -1
    cuts = np.concatenate(([0], np.flatnonzero(to[1:] != to[:-1]) + 1, [len(to)]))
    begin, stop, to = cuts[:-1], cuts[1:] + WINDOW - 1, to[cuts[:-1]]
    begin, stop, to = begin[to >= 0], stop[to >= 0], to[to >= 0]
    segment = np.searchsorted(begins, begin, "right") - 1
    # of each distinct segment the occurrences in its smallest document go on
    mine = mine[np.argsort(of[mine], kind="stable")]
    left = np.searchsorted(of[mine], np.arange(len(number)), "left")
    times = (np.searchsorted(of[mine], np.arange(len(number)), "right") - left)[segment]
    piece = np.repeat(np.arange(len(segment)), times)
    one = mine[np.arange(len(piece)) + np.repeat(left[segment] - (np.cumsum(times) - times), times)]
    order = np.argsort(to[piece], kind="stable")
    piece, one = piece[order], one[order]
    pairs, pair = np.unique(doc[one], axis=0, return_inverse=True)
    table = [tuple(x) for x in pairs.tolist()]
    at = np.concatenate(([0], np.flatnonzero(np.diff(to[piece])) + 1, [len(piece)]))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        x, y = begin[piece[a:b]], stop[piece[a:b]]
        part = b"".join([text[c:d] for c, d in zip(x.tolist(), y.tolist(), strict=True)])
        blob = _write(table, pair.ravel()[a:b], start[one[a:b]] + x - begins[segment[piece[a:b]]], y - x, part)
        yield _batch([2], [place * FANOUT + int(to[piece[a]])], [blob])


def sort_bucket(blobs: list[bytes]) -> list[tuple[int, int, int, int]]:
    """Spans (id, key, start, end) to remove, of all segments of one bucket."""
    number, of, doc, start = _gathered(blobs)
    sizes = np.fromiter(map(len, number), np.int64, len(number))
    text = np.frombuffer(b"".join(number) + bytes(2 * WINDOW), np.uint8)
    number.clear()
    least = np.full(len(sizes), np.iinfo(np.int64).max)
    np.minimum.at(least, of, doc[:, 0])
    out = []
    whole = doc[:, 0] > least[of]
    if whole.any():
        out.append(np.stack((doc[whole, 0], doc[whole, 1], start[whole], start[whole] + sizes[of[whole]]), 1))
    begins = np.cumsum(sizes) - sizes
    counts = sizes - WINDOW + 1
    segment = np.repeat(np.arange(len(sizes)), counts)
    places = np.arange(len(segment)) + np.repeat(begins - (np.cumsum(counts) - counts), counts)
    prints = fingerprints(text[: int(sizes.sum()) + WINDOW])[places]
    ordered = np.sort(prints)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    del ordered
    if len(again):
        again = np.unique(again)
        spot = np.minimum(np.searchsorted(again, prints), len(again) - 1)
        chosen = np.flatnonzero(again[spot] == prints)
        del prints, spot
        rank = suffix_ranks(text, places[chosen])
        smallest = np.full(len(rank), np.iinfo(np.int64).max)
        np.minimum.at(smallest, rank, least[segment[chosen]])
        bad = chosen[smallest[rank] < least[segment[chosen]]]
        if len(bad):  # windows one after another in a segment make one span
            new = np.concatenate(([True], (bad[1:] != bad[:-1] + 1) | (segment[bad[1:]] != segment[bad[:-1]])))
            a = bad[new]
            b = bad[np.concatenate((new[1:], [True]))]
            seg, low, high = segment[a], places[a] - begins[segment[a]], places[b] - begins[segment[a]] + WINDOW
            # spans hold for the segment's occurrences in its smallest document
            mine = np.flatnonzero(~whole)
            mine = mine[np.argsort(of[mine], kind="stable")]
            left, right = np.searchsorted(of[mine], seg, "left"), np.searchsorted(of[mine], seg, "right")
            times = right - left
            span = np.repeat(np.arange(len(seg)), times)
            one = mine[np.arange(len(span)) + np.repeat(left - (np.cumsum(times) - times), times)]
            out.append(np.stack((doc[one, 0], doc[one, 1], start[one] + low[span], start[one] + high[span]), 1))
    return np.concatenate(out) if out else np.empty((0, 4), np.int64)


def _sorter(doc_parts: int, step: int = 0):
    """Rows of buckets, in order: spans of sorted ones (kind 1), segments of those that are too large, dealt anew (kind 2)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        at, size, large = None, 0, False

        def done() -> Iterator[pa.RecordBatch]:
            if large:
                yield from deal_again(held, at, step + 1, doc_parts)
            elif len(got := sort_bucket(held)):
                yield _spans(got, doc_parts)

        for batch in batches:
            for kind, place, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if kind == 1:  # spans that are settled pass through
                    yield _batch([1], [place], [blob.as_py()])
                    continue
                if held and place != at:
                    yield from done()
                    held, size, large = [], 0, False
                elif size > HOLD_BYTES and step < STEPS:
                    large = True
                    yield from done()
                    held, size = [], 0
                large = large and place == at
                at = place
                held.append(blob.as_py())
                size += zstandard.frame_content_size(held[-1])
        if held:
            yield from done()

    return work


def merged(spans: np.ndarray) -> np.ndarray:
    """Spans (start, end) in order, those that overlap or touch as one."""
    if not len(spans):
        return spans
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    end = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate(([True], spans[1:, 0] > end[:-1]))
    return np.stack((spans[new, 0], end[np.concatenate((new[1:], [True]))]), 1)


def _remover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a part: first the spans of its documents, then their texts; further columns pass through."""
    at, spans = None, np.empty((0, 4), np.int64)
    held: list[np.ndarray] = []
    ready = False
    for whole in batches:
        for batch in pieces([whole], "cs_text", 8 << 20):
            rows = []
            for part, blob, i, key, text in zip(
                batch.column(0).to_pylist(), batch.column(2), batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(5), strict=True
            ):
                if part != at:
                    at, held, ready = part, [], False
                    spans = np.empty((0, 4), np.int64)
                if blob.is_valid:
                    raw = zstandard.ZstdDecompressor().decompress(blob.as_py())
                    held.append(np.frombuffer(raw, np.int64).reshape(4, -1).T)
                    continue
                if not ready:
                    if held:
                        spans = np.concatenate(held)
                        spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
                        held = []
                    ready = True
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                own = spans[:0, 2:]
                if i is not None and len(spans):
                    a, b = np.searchsorted(spans[:, 0], [i, i + 1] if i < np.iinfo(np.int64).max else [i, i])
                    b = b if i < np.iinfo(np.int64).max else len(spans)
                    own = merged(spans[a:b][spans[a:b, 1] == key][:, 2:])
                kept, last = [], 0
                for x, y in own.tolist():
                    kept.append(raw[last:x])
                    last = y
                kept.append(raw[last:])
                rows.append((i, len(raw), [{"start": x, "end": y} for x, y in own.tolist()], b"".join(kept)))
            if rows:
                ids, sizes, lists, texts = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array(sizes, pa.int64()),
                        pa.array(lists, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        pa.array(texts, pa.binary()),
                        *(c.filter(batch.column(2).is_null()) for c in batch.columns[6:]),
                    ],
                    ["cs_id", "n_bytes", "spans", "kept_bytes", *batch.schema.names[6:]],
                )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, n_bytes, spans, kept_bytes, *carry) of every row: the byte ranges removed, and what is left of the text.

    A byte goes if a WINDOW-byte string over it also starts in a document with a smaller id;
    strings are judged on the texts as given. Null text counts as empty; texts under WINDOW
    bytes are kept. Repeated rows give repeated rows and don't remove each other; rows with a
    null id take no part and are kept. Other columns than those to carry are ignored.
    """
    n = partitions(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = int(max(4 * n * ROUNDS, total * SPREAD / BUCKET_BYTES))
    rows = docs.select(F.col(id_col).cast("long").alias("cs_id"), F.xxhash64(text_col).alias("cs_key"), F.col(text_col).alias("cs_text"))
    kind = "kind int, place bigint, blob binary"
    found = []
    for turn in range(ROUNDS):
        dealt = arrow_map(rows, _dealer(buckets, n, turn, ROUNDS), kind)
        for step in range(STEPS + 1):
            sorted_out = dealt.repartition(n, "kind", "place").sortWithinPartitions("kind", "place").mapInArrow(_sorter(n, step), kind)
            found.append(stored(sorted_out, "suffix-spans"))
            dealt = found[-1].where("kind = 2")
            if dealt.isEmpty():
                break
    spans = reduce(DataFrame.unionByName, (x.where("kind = 1").select(F.col("place").cast("int").alias("place"), "blob") for x in found))
    names = ["place", "cs_id", "cs_key", "cs_text", *(f"cs_c{k}" for k in range(len(carry)))]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            own = _part_of(pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), n)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *batch.columns], names)

    kinds = [docs.schema[c].dataType.simpleString() for c in carry]
    carried = "".join(f", cs_c{k} {kind}" for k, kind in enumerate(kinds))
    whole = rows.select("*") if not carry else docs.select(
        F.col(id_col).cast("long").alias("cs_id"),
        F.xxhash64(text_col).alias("cs_key"),
        F.col(text_col).alias("cs_text"),
        *(F.col(c).alias(f"cs_c{k}") for k, c in enumerate(carry)),
    )
    texts = arrow_map(whole, part, f"place int, cs_id bigint, cs_key bigint, cs_text string{carried}")
    none = lambda kind: F.lit(None).cast(kind)
    both = texts.select("place", F.lit(1).alias("kind"), none("binary").alias("blob"), *names[1:]).unionByName(
        spans.select(
            "place",
            F.lit(0).alias("kind"),
            "blob",
            none("long").alias("cs_id"),
            none("long").alias("cs_key"),
            none("string").alias("cs_text"),
            *(none(kind).alias(f"cs_c{k}") for k, kind in enumerate(kinds)),
        )
    )
    out = (
        both.repartition(n, "place")
        .sortWithinPartitions("place", "kind")
        .mapInArrow(_remover, f"cs_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept_bytes binary{carried}")
    )
    return out.select(F.col("cs_id").alias(id_col), "n_bytes", "spans", "kept_bytes", *(F.col(f"cs_c{k}").alias(c) for k, c in enumerate(carry)))
