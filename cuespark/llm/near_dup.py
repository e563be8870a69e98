"""MinHash near-duplicates by a multi-index Hamming join.

A document's set of word shingles gives a signature of CHUNKS * WIDTH b-bit minima. The
signature is split into CHUNKS chunks; by the pigeonhole principle two signatures that differ
in at most 2 * CHUNKS - 1 places differ in at most one place of some chunk. Each chunk is
therefore looked up once for each place that may be wrong, by its other places. All pairs within that distance
meet under one key at least, and that distance is the limit for candidates.

Documents that meet under a key and whose whole signatures are near are joined to candidate
groups, and links in a group are confirmed on full shingle sets. Neither step lists pairs: it walks
from member to member over those not reached yet, and emits one link for each one reached.
Keys of many documents are cut into blocks, and every pair of blocks is walked. A large group is first held against its
middle, the member nearest to the majority of its signatures, by a join that isn't gathered anywhere; only the members that
aren't linked to the middle are cut into blocks, each of which is walked with itself and with every block of the group.
Copies of one set are one member throughout.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespark.llm._util import arrow_map, components, dropped, partitions, stored

CHUNKS, WIDTH = 16, 5
PLACES = CHUNKS * WIDTH
#: Signatures of a candidate pair differ in at most so many places, which the keys find for certain; a pair at 0.8 differs in more with a probability of 1.2e-5.
FAR = 2 * CHUNKS - 1
#: A block holds about so many members under a key, or shingles in a group.
KEY_BLOCK = 4096
GROUP_BLOCK = 200_000
_SEEDS = np.array([int.from_bytes(hashlib.sha256(b"%d" % k).digest()[:8], "little") for k in range(2 * PLACES)], np.uint64)
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M3
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text: A-Z lowered, words between ASCII white space.

    With fewer words the whole sequence is one shingle; without words there is none.
    """
    own = text.lower().split()
    if not own:
        return np.empty(0, np.uint64)
    n = min(words, len(own))
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))
    with np.errstate(over="ignore"):
        out = np.full(len(own) - n + 1, n, np.uint64)
        for k in range(n):
            out = _mix(out * _M1 + h[k : len(h) - n + 1 + k] * _M2)
    return np.unique(out)


def signature(own: np.ndarray) -> np.ndarray:
    """The 16 bits kept of each minimum over the set."""
    least = np.full(PLACES, ~np.uint64(0))
    with np.errstate(over="ignore"):
        for at in range(0, len(own), 1 << 14):
            part = own[at : at + (1 << 14)]
            for k in range(PLACES):
                least[k] = min(least[k], (part * (_SEEDS[k] | np.uint64(1)) + _SEEDS[PLACES + k]).min())
        return (_mix(least) >> np.uint64(48)).astype("<u2")


def keys(signatures: np.ndarray) -> np.ndarray:
    """(rows, PLACES) keys: of chunk c, place w left out, the chunk's other places."""
    s = signatures.astype(np.uint64).reshape(-1, CHUNKS, WIDTH)
    out = np.empty((len(s), CHUNKS, WIDTH), np.uint64)
    with np.errstate(over="ignore"):
        for w in range(WIDTH):
            rest = np.full(s.shape[:2], w, np.uint64)
            for k in range(WIDTH):
                if k != w:
                    rest = _mix(rest * _M1 + s[:, :, k])
            out[:, :, w] = _mix(rest * _M1 + np.arange(CHUNKS, dtype=np.uint64)[None, :])
    return out.reshape(len(s), PLACES).view(np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(cs_id, n_shingles, digest of the set, signature) of every row; digest and signature are null for an empty set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, signs = [], [], []
            for value in batch.column(1):
                own = shingles(value.as_buffer().to_pybytes(), words) if value.is_valid else np.empty(0, np.uint64)
                n.append(len(own))
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                signs.append(signature(own).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(signs, pa.binary())],
                ["cs_id", "n_shingles", "digest", "sign"],
            )

    return arrow_map(
        docs.select(F.col(id_col).cast("long").alias("cs_id"), F.col(text_col).alias("cs_text")),
        work,
        "cs_id bigint, n_shingles bigint, digest binary, sign binary",
    )


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        signs = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(-1, PLACES)
        ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), PLACES)
        yield pa.RecordBatch.from_arrays([pa.array(keys(signs).ravel()), pa.array(ids)], ["key", "rep"])


def grouped(
    walk: Callable[[list[pa.RecordBatch]], tuple[np.ndarray, np.ndarray]],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Feeds walk the rows of each run of equal (g, bi, bj), which are sorted; its links are the output."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def out(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            a, b = walk(rows)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            run = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)], 1)
            cuts = (np.flatnonzero((run[1:] != run[:-1]).any(1)) + 1).tolist()
            if last is not None and last != tuple(run[0]):
                yield out(held)
                held = []
            if not cuts:
                held.append(batch)
            else:
                held.append(batch.slice(0, cuts[0]))
                yield out(held)
                if len(cuts) > 1:  # whole runs in this batch
                    links = [walk([batch.slice(a, b - a)]) for a, b in zip(cuts, cuts[1:], strict=False)]
                    a, b = (np.concatenate([x[k] for x in links]) for k in (0, 1))
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                held = [batch.slice(cuts[-1])]
            last = tuple(run[-1])
        if held:
            yield out(held)

    return work


def _ids(rows: list[pa.RecordBatch], name: str) -> np.ndarray:
    return np.concatenate([r.column(r.schema.get_field_index(name)).to_numpy(zero_copy_only=False) for r in rows])


def walk_signatures(rows: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what signature distances of at most FAR connect."""
    ids = _ids(rows, "rep")
    if len(ids) < 2:
        return ids[:0], ids[:0]
    signs = np.frombuffer(b"".join(x for r in rows for x in r.column(r.schema.get_field_index("sign")).to_pylist()), "<u2").reshape(-1, PLACES)
    if len(ids) == 2:
        near = int((signs[0] != signs[1]).sum()) <= FAR
        return (ids[:1], ids[1:]) if near else (ids[:0], ids[:0])
    left = np.arange(len(ids))
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    todo: list[int] = []
    while len(left):
        if not todo:
            todo.append(int(left[0]))
            left = left[1:]
        x = todo.pop()
        near = (signs[left] != signs[x]).sum(1) <= FAR
        if near.any():
            hit = left[near]
            a.append(np.full(len(hit), ids[x]))
            b.append(ids[hit])
            todo += hit.tolist()
            left = left[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (ids[:0], ids[:0])


def set_walker(words: int, percent: int) -> Callable[[list[pa.RecordBatch]], tuple[np.ndarray, np.ndarray]]:
    """Links that connect what 100 * intersection >= percent * union connects, from full sets.

    Of two blocks, only links from one to the other are given: links inside come from the block alone.
    """

    def walk(rows: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
        ids, blocks = _ids(rows, "rep"), _ids(rows, "block")
        cross = rows[0].column(1)[0].as_py() != rows[0].column(2)[0].as_py()
        if len(ids) < 2:
            return ids[:0], ids[:0]
        sets = [
            shingles(x.as_buffer().to_pybytes(), words) if x.is_valid else np.empty(0, np.uint64)
            for r in rows
            for x in r.column(r.schema.get_field_index("cs_text"))
        ]
        sizes = np.array([len(s) for s in sets])
        values, flat = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.concatenate(([0], np.cumsum(sizes)))
        mark = np.zeros(len(values), bool)
        left = np.flatnonzero(sizes > 0)
        a, b, todo = [], [], []
        part, bounds = flat, starts[:-1]  # shingles of the rows that are left, and where each row's begin
        part = np.concatenate([flat[starts[k] : starts[k + 1]] for k in left]) if len(left) else flat[:0]
        bounds = np.concatenate(([0], np.cumsum(sizes[left])[:-1])) if len(left) else sizes[:0]
        while len(left):
            if not todo:
                todo.append(int(left[0]))
                part, bounds, left = part[sizes[left[0]] :], bounds[1:] - sizes[left[0]], left[1:]
                continue
            x = todo.pop()
            own = flat[starts[x] : starts[x + 1]]
            mark[own] = True
            common = np.add.reduceat(mark[part], bounds, dtype=np.int64)
            mark[own] = False
            near = 100 * common >= percent * (sizes[left] + sizes[x] - common)
            if near.any():
                hit = left[near]
                put = hit if not cross else hit[blocks[hit] != blocks[x]]
                a.append(np.full(len(put), ids[x]))
                b.append(ids[put])
                todo += hit.tolist()
                part = part[np.repeat(~near, sizes[left])]
                left = left[~near]
                bounds = np.concatenate(([0], np.cumsum(sizes[left])[:-1])) if len(left) else sizes[:0]
        return (np.concatenate(a), np.concatenate(b)) if a else (ids[:0], ids[:0])

    return walk


def _pairs_of_blocks(rows: DataFrame, group: str) -> DataFrame:
    """rows with cs_blocks to rows with g, bi, bj: every pair of blocks of a group, a block with itself included."""
    block = F.pmod(F.xxhash64("rep"), F.col("cs_blocks"))
    return (
        rows.withColumn("block", block)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cs_blocks") - 1)))
        .withColumn("bi", F.least("block", "other"))
        .withColumn("bj", F.greatest("block", "other"))
        .withColumn("g", F.col(group))
    )


def _against_middle(words: int, percent: int):
    """Rows (label, rep, text, middle, text of the middle): whether the two are linked."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, middle = None, np.empty(0, np.uint64)
        for batch in batches:
            linked = []
            for text, m, raw in zip(batch.column(2), batch.column(3).to_pylist(), batch.column(4), strict=True):
                if m != at:
                    at, middle = m, shingles(raw.as_buffer().to_pybytes(), words)
                own = shingles(text.as_buffer().to_pybytes(), words)
                common = len(np.intersect1d(own, middle, assume_unique=True))
                linked.append(100 * common >= percent * (len(own) + len(middle) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(linked, pa.bool_())], ["label", "rep", "middle", "linked"])

    return work


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, rep, sign) to (label, rep, places of the signature as numbers)."""
    for batch in batches:
        signs = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u2").astype(np.int32)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(signs), PLACES).cast(pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["label", "rep", "places"])


def middles(groups: DataFrame) -> DataFrame:
    """(label, middle) of groups (label, rep, sign): the member whose signature is nearest to each place's most frequent value."""
    own = stored(arrow_map(groups, _places, "label bigint, rep bigint, places array<int>"), "near-places")
    most = (
        own.select("label", F.posexplode("places").alias("at", "value"))
        .groupBy("label", "at", "value")
        .count()
        .groupBy("label", "at")
        .agg(F.max_by("value", F.struct("count", "value")).alias("value"))
        .groupBy("label")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("most"))
    )
    far = F.aggregate(F.zip_with("places", "most", lambda a, b: (a != b).cast("int")), F.lit(0), lambda n, x: n + x)
    near = own.hint("merge").join(stored(most, "near-majority"), "label").select("label", "rep", far.alias("far"))
    return near.groupBy("label").agg(F.min_by("rep", F.struct("far", "rep")).alias("middle"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 2, percent: int = 80
) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row.

    component_id: the smallest id reachable over links, the row's own included; kept: the id is that.
    Null text and text without words have an empty set and no links. Rows that repeat an id
    share its component. Rows with a null id take no part: null component_id, kept. Other columns are ignored.
    """
    n = partitions(docs.sparkSession)
    sketch = stored(sketches(docs, id_col, text_col, words), "near-sketch")
    members = stored(
        sketch.where("digest is not null and cs_id is not null")
        .groupBy("digest")
        .agg(F.min("cs_id").alias("rep"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("sign").alias("sign")),
        "near-members",
    )
    # a member makes PLACES keys, so its few bytes are dealt to all tasks first
    keyed = arrow_map(members.select("rep", "sign").repartition(n), _keyed, "key bigint, rep bigint")
    live = stored(
        keyed.groupBy("key")
        .agg(F.count("*").alias("n"))
        .where("n > 1")
        .select("key", F.ceil(F.col("n") / KEY_BLOCK).alias("cs_blocks")),
        "near-keys",
    )
    met = stored(keyed.join(live, "key"), "near-met")
    near = (
        _pairs_of_blocks(met.join(members.select("rep", "sign"), "rep"), "key")
        .select("g", "bi", "bj", "rep", "sign")
        .repartition(n, "g", "bi", "bj")
        .sortWithinPartitions("g", "bi", "bj")
        .mapInArrow(grouped(walk_signatures), "a bigint, b bigint")
    )
    links = stored(near.distinct(), "near-links")
    groups = stored(components(links), "near-groups")
    dropped(live, met, links)
    blocks = (
        groups.join(members.select(F.col("rep").alias("node"), "n_shingles"), "node")
        .groupBy("label")
        .agg(F.greatest(F.lit(1).cast("long"), F.ceil(F.sum("n_shingles") / GROUP_BLOCK)).alias("cs_blocks"))
    )
    chosen = groups.select(F.col("node").alias("rep"), "label").join(blocks, "label")
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("cs_text")).where("rep is not null and cs_text is not null")
    # rows that repeat an id bring all their texts; the ids of candidates grow with the corpus, so they are never broadcast
    held = stored(texts.join(stored(chosen, "near-chosen").hint("merge"), "rep"), "near-texts")
    pairs = _pairs_of_blocks(held.where("cs_blocks = 1"), "label").select("g", "bi", "bj", "block", "rep", "cs_text")
    large, direct = held.where("cs_blocks > 1"), None
    if not large.isEmpty():
        signs = members.select("rep", "sign", "n_shingles")
        middle = stored(middles(chosen.where("cs_blocks > 1").select("label", "rep").join(signs, "rep").select("label", "rep", "sign")), "near-middles")
        central = stored(
            middle.join(large.select(F.col("rep").alias("middle"), F.col("cs_text").alias("cs_middle")), "middle").groupBy("label", "middle").agg(F.min("cs_middle").alias("cs_middle")),
            "near-central",
        )
        # the label's middle is one row, so AQE can split a large group over many tasks
        seen = large.select("label", "rep", "cs_text").hint("merge").join(central, "label").select("label", "rep", "cs_text", "middle", "cs_middle")
        linked = stored(arrow_map(seen, _against_middle(words, percent), "label bigint, rep bigint, middle bigint, linked boolean"), "near-linked")
        direct = linked.where("linked and rep <> middle").select(F.col("middle").alias("a"), F.col("rep").alias("b"))
        size = lambda c: F.ceil(F.coalesce(F.sum(F.when(c, F.col("n_shingles"))), F.lit(0)) / GROUP_BLOCK)
        counts = stored(
            linked.join(signs.select("rep", "n_shingles"), "rep").groupBy("label").agg(size(~F.col("linked")).alias("apart"), size(F.col("linked")).alias("about")).where("apart > 0"),
            "near-apart",
        )
        role = linked.groupBy("label", "rep").agg(F.min("linked").alias("linked"))
        dealt = large.select("rep", "cs_text").join(role, "rep").hint("merge").join(counts, "label")
        own = F.pmod(F.xxhash64("rep"), F.when(F.col("linked"), F.col("about")).otherwise(F.col("apart"))) + F.when(F.col("linked"), F.col("apart")).otherwise(0)
        last = F.when(F.col("linked"), F.col("apart")).otherwise(F.col("apart") + F.col("about")) - 1
        pairs = pairs.unionByName(
            dealt.withColumn("block", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
            .select(F.col("label").alias("g"), F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"), "block", "rep", "cs_text")
        )
    confirmed = (
        pairs.repartition(n, "g", "bi", "bj")
        .sortWithinPartitions("g", "bi", "bj")
        .mapInArrow(grouped(set_walker(words, percent)), "a bigint, b bigint")
    )
    confirmed = confirmed if direct is None else confirmed.unionByName(direct)
    sure = stored(confirmed, "near-confirmed")
    linked = components(sure)
    classes = stored(
        members.join(linked.withColumnRenamed("node", "rep"), "rep", "left")
        .where("copies > 1 or label is not null")
        .select("digest", F.coalesce("label", "rep").alias("class")),
        "near-classes",
    )
    dropped(members, groups, sure, held)
    own = F.col("cs_id")
    component = F.when(own.isNotNull(), F.coalesce("class", own))
    return (
        sketch.join(classes, "digest", "left")
        .select(own.alias(id_col), "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
    )
