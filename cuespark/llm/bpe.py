"""Byte-level BPE by corpus-level merge replay.

The distinct pretokens of a block of texts form one token array. An inverted index leads from
a merge's rank to the positions where that pair of neighbours stands; merges are replayed
over the whole array, lowest rank first, and only the neighbours of a merged pair are looked
at again. Ids of texts are then gathered from those of their pretokens. One pass over the
corpus, no shuffle: the index is bounded by BLOCK_CHARS characters of text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespark.llm._util import arrow_map, pieces

BLOCK_CHARS = 8 << 20
#: A task holds this many bytes of pretokens it has met; then it forgets them.
CACHE_BYTES = 24 << 20
_NONE = np.int32(1 << 30)


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a line holds a token in base64 and its rank."""
    out = {}
    for line in Path(path).read_bytes().splitlines():
        if line:
            token, rank = line.split()
            out[base64.b64decode(token)] = int(rank)
    return out


class Merges:
    """Ranks as arrays: pair_rank(left, right) is the rank of the token they join to, or _NONE."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte_ids = np.array([ranks[bytes([x])] for x in range(256)], np.int32)
        keys, values = [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        self.bits = max(10, (4 * len(keys)).bit_length())
        self.slot_keys = np.full((1 << self.bits) + 64, -1, np.int64)
        self.slot_ranks = np.full((1 << self.bits) + 64, _NONE, np.int32)
        slots = self._slot(np.array(keys, np.int64)).tolist()
        for key, value, slot in zip(keys, values, slots, strict=True):
            while self.slot_keys[slot] != -1:
                slot += 1
            self.slot_keys[slot] = key
            self.slot_ranks[slot] = value
        self.by_pair = dict(zip(keys, values, strict=True))
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.flat = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; negative ids (ends of words) give _NONE."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        slot = self._slot(keys)
        out = np.full(len(keys), _NONE, np.int32)
        todo = np.arange(len(keys))
        while len(todo):
            at = self.slot_keys[slot[todo]]
            hit = at == keys[todo]
            out[todo[hit]] = self.slot_ranks[slot[todo[hit]]]
            todo = todo[~hit & (at != -1)]
            slot[todo] += 1
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        sizes = self.lengths[ids]
        ends = np.cumsum(sizes)
        if not len(ids):
            return b""
        return self.flat[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1])].tobytes()


def replay(words: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words one after another, number of ids of each word). Words aren't empty.

    A rank's positions are merged together, left to right. Where one merge in a word opens a
    pair of lower rank, that word's remaining positions of this rank wait until the lower
    ranks are done, as they would if the word were encoded alone.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    n = int(sizes.sum())
    if not n:
        return np.empty(0, np.int32), sizes
    # one empty place before each word, and one at the end, keeps words apart
    at = np.arange(n) + np.repeat(np.arange(1, len(words) + 1), sizes)
    total = n + len(words) + 1
    tok = np.full(total, -1, np.int32)
    tok[at] = merges.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    nxt = np.arange(1, total + 1)
    prv = np.arange(-1, total - 1)
    rank = np.full(total, _NONE, np.int32)
    rank[:-1] = merges.pair_ranks(tok[:-1], tok[1:])
    word = np.zeros(total, np.int32)
    word[at] = np.repeat(np.arange(len(words), dtype=np.int32), sizes)

    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def add(positions: np.ndarray, ranks: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        positions, ranks = positions[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for part, r in zip(np.split(positions, cuts), ranks[np.concatenate(([0], cuts))].tolist(), strict=True):
            if r not in index:
                index[r] = []
                heapq.heappush(heap, r)
            index[r].append(part)

    if len(found := np.flatnonzero(rank != _NONE)):
        add(found, rank[found])
    by_pair, none = merges.by_pair, int(_NONE)
    while heap:
        r = heapq.heappop(heap)
        parts = index.pop(r)
        p = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
        p = p[rank[p] == r]
        if not len(p):
            continue
        while len(p) >= 12:  # of each word the first position of this rank, then its next one, ...
            first = np.ones(len(p), bool)
            first[1:] = word[p[1:]] != word[p[:-1]]
            one, p = p[first], p[~first]
            q = nxt[one]
            after = nxt[q]
            tok[one] = r
            tok[q] = -2
            rank[q] = _NONE
            nxt[one] = after
            prv[after] = one
            before = prv[one]
            rank[one] = new_right = merges.pair_ranks(tok[one], tok[after])
            rank[before] = new_left = merges.pair_ranks(tok[before], tok[one])
            positions, ranks = np.concatenate((one, before)), np.concatenate((new_right, new_left))
            valid = ranks != _NONE
            if valid.any():
                positions, ranks = positions[valid], ranks[valid]
                add(positions, ranks)
                if len(p) and (lower := ranks < r).any():
                    wait = np.isin(word[p], word[positions[lower]])
                    if wait.any():
                        add(p[wait], np.full(int(wait.sum()), r, np.int32))
                        p = p[~wait]
            p = p[rank[p] == r]
        waits = -1
        for x in p.tolist():
            if rank[x] != r:
                continue
            if word[x] == waits:
                index.setdefault(r, []) or heapq.heappush(heap, r)
                index[r].append(np.array([x]))
                continue
            q = int(nxt[x])
            after = int(nxt[q])
            tok[x] = r
            tok[q] = -2
            rank[q] = _NONE
            nxt[x] = after
            prv[after] = x
            before = int(prv[x])
            for a, b in ((x, after), (before, x)):
                left, right = int(tok[a]), int(tok[b])
                got = by_pair.get(left << 32 | right, none) if left >= 0 and right >= 0 else none
                rank[a] = got
                if got != none:
                    if got not in index:
                        index[got] = []
                        heapq.heappush(heap, got)
                    index[got].append(np.array([a]))
                    if got < r:
                        waits = int(word[x])
    live = tok >= 0
    return tok[live], np.bincount(word[live], minlength=len(words))


class Encoder:
    """Encodes blocks of texts; keeps the ids of pretokens it has met, up to CACHE_BYTES."""

    def __init__(self, merges: Merges, pattern: str) -> None:
        self.merges, self.find = merges, regex.compile(pattern).findall
        self.known: dict[str, int] = {}
        self._forget()

    def _forget(self) -> None:
        self.known.clear()
        self.held = 0
        self.ids = np.empty(0, np.int32)
        self.counts = np.empty(0, np.int64)
        self.starts = np.empty(0, np.int64)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text. A pretoken that is a token itself has that one id."""
        for own in self._pretokens(texts):
            sizes = self.counts[own]
            ends = np.cumsum(sizes)
            n = int(ends[-1]) if len(ends) else 0
            yield self.ids[np.repeat(self.starts[own] - (ends - sizes), sizes) + np.arange(n)]

    def lengths(self, texts: list[str]) -> list[int]:
        """The number of ids of each text."""
        return [int(self.counts[own].sum()) for own in self._pretokens(texts)]

    def _pretokens(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of each text's pretokens, all of them known then."""
        if self.held > CACHE_BYTES:
            self._forget()
        known, number, fresh = self.known, [], []
        for text in texts:
            own = self.find(text)
            new = list(set(own).difference(known))
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            fresh += new
            number.append(np.fromiter(map(known.__getitem__, own), np.int64, len(own)))
        if fresh:
            words = [w.encode() for w in fresh]
            whole = np.fromiter((self.merges.ranks.get(w, -1) for w in words), np.int32, len(words))
            ids, counts = replay([w for w, k in zip(words, whole.tolist(), strict=True) if k < 0], self.merges)
            own = np.ones(len(words), np.int64)
            own[whole < 0] = counts
            filled = np.empty(int(own.sum()), np.int32)
            single = np.repeat(whole >= 0, own)
            filled[single], filled[~single] = whole[whole >= 0], ids
            ids, counts = filled, own
            self.held += sum(map(len, words))
            self.ids = np.concatenate((self.ids, ids))
            self.counts = np.concatenate((self.counts, counts))
            self.starts = np.concatenate(([0], np.cumsum(self.counts)[:-1]))
        return number


def lengths(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens) of every row, as encode() counts them; null text has none. Other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(Merges(read_ranks(ranks_path)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, pattern)
        for batch in pieces(batches, "cs_text", BLOCK_CHARS):
            n = encoder.lengths([x or "" for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], [id_col, "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(docs.select(F.col(id_col), F.col(text_col).alias("cs_text")), work, f"`{id_col}` {kind}, n_tokens bigint")


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every row; null text counts as empty.

    ids_sha256 is over the ids as little-endian 32-bit numbers; decoded_sha256 over the bytes
    the ids decode to. Repeated rows give repeated rows; other columns are ignored. The
    vocabulary is read on the driver and broadcast: its size doesn't depend on the corpus.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Merges(read_ranks(ranks_path)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, pattern)
        for batch in pieces(batches, "cs_text", BLOCK_CHARS):
            rows = []
            for ids in encoder.encode([x or "" for x in batch.column(1).to_pylist()]):
                raw = ids.astype("<u4").tobytes()
                whole = encoder.merges.decode(ids)
                rows.append(
                    (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(whole).hexdigest(), ids.tolist() if with_ids else None)
                )
            n, a, b, c = zip(*rows, strict=True)
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays.append(pa.array(c, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return arrow_map(docs.select(F.col(id_col), F.col(text_col).alias("cs_text")), work, schema)
