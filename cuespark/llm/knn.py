"""Exact top-k search by inner product over KD-trees, one tree per shard.

Space is cut by a coarse tree of medians (of a bounded sample, which decides the layout alone), so a shard holds
neighbours and has a tight box. Each shard's own tree splits at the median of its widest dimension and keeps a tight
bounding box per node. A query walks a tree best-first: the box bounds its inner product from above, and nodes that
can't reach the k-th best score are left. A query is first answered in its own shard; that k-th score
goes with it to those other shards alone whose box can reach it, in blocks of queries.

Rows that hold the same vector have the same score, so of each vector the k + 1 smallest ids are candidates, and
each vector that is asked for is searched once: copies are neither gathered nor searched again.
"""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cuespark.llm._util import arrow_map, partitions, stored

K = 5
SHARD_ROWS = 4096
LEAF_ROWS = 256
BLOCK_QUERIES = 256
#: Leaves of the coarse tree at most, and rows of the sample its medians are taken from; more shards are parts of a leaf, by hash.
MOST_LEAVES = 1024
SAMPLE_ROWS = 20_000
#: Blocks of queries that a task takes to one shard's tree; a tree that more blocks go to is read by more tasks.
VISIT_BLOCKS = 256
LONG = (-(1 << 63), (1 << 63) - 1)


def quantised(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): floor(256 * x) of each component, without rows that take no part."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    usable = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    )
    return vectors.where(usable).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * 256)).alias("v")
    )


def matrix(rows: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    """Vectors as one matrix; shorter vectors are filled up with zeros."""
    if isinstance(rows, pa.ChunkedArray):
        rows = rows.combine_chunks()
    offsets = rows.offsets.to_numpy()
    flat = rows.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]] if len(rows) else np.empty(0, np.int64)
    sizes = np.diff(offsets)
    width = int(sizes.max()) if len(sizes) else 0
    if len(sizes) and sizes.min() == width:
        return flat.reshape(len(sizes), width).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


class Coarse:
    """A tree of medians alone: node arrays axis, cut, left child (right follows) or -1, and leaf number."""

    def __init__(self, rows: np.ndarray, leaves: int) -> None:
        self.axis, self.cut, self.child, self.leaf = [0], [0], [-1], [-1]
        todo = [(0, np.arange(len(rows)), max(1, leaves))]
        self.leaves = 0
        while todo:
            node, part, n = todo.pop()
            own = rows[part]
            spread = own.max(0).astype(float) - own.min(0) if n > 1 and len(part) > 1 and rows.shape[1] else np.zeros(1)
            axis = int(spread.argmax())
            if spread[axis] <= 0:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            values = own[:, axis]
            cut = int(np.sort(values)[len(values) // 2])
            if cut == values.min():
                cut = int(values[values > cut].min())
            left = values < cut
            self.axis[node], self.cut[node], self.child[node] = axis, cut, len(self.axis)
            for k, side in enumerate((left, ~left)):
                todo.append((len(self.axis), part[side], (n + 1 - k) // 2))
                for x, v in ((self.axis, 0), (self.cut, 0), (self.child, -1), (self.leaf, -1)):
                    x.append(v)

    def place(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each row; missing components count as 0."""
        out = np.zeros(len(rows), np.int32)
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, part = todo.pop()
            if self.child[node] < 0:
                out[part] = self.leaf[node]
                continue
            axis = self.axis[node]
            values = rows[part, axis] if axis < rows.shape[1] else np.zeros(len(part), np.int64)
            left = values < self.cut[node]
            todo += [(self.child[node], part[left]), (self.child[node] + 1, part[~left])]
        return out


class Tree:
    """ids and rows in leaf order; node arrays: first row, end row, left child (right follows), box."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, first, end, child, low, high) -> None:
        self.ids, self.rows, self.first, self.end, self.child, self.low, self.high = ids, rows, first, end, child, low, high

    @classmethod
    def build(cls, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF_ROWS) -> Tree:
        order = np.arange(len(ids))
        first, end, child, low, high = [0], [len(ids)], [-1], [rows.min(0)], [rows.max(0)]
        todo = [0]
        while todo:
            node = todo.pop()
            a, b = first[node], end[node]
            if b - a <= leaf:
                continue
            width = high[node].astype(float) - low[node].astype(float)
            if not len(width) or width.max() <= 0:
                continue  # copies of one vector stay one leaf: its box is a point
            axis, middle = int(width.argmax()), (a + b) // 2
            part = order[a:b]
            order[a:b] = part[np.argpartition(rows[part, axis], middle - a)]
            child[node] = len(first)
            for c, d in ((a, middle), (middle, b)):
                todo.append(len(first))
                first.append(c)
                end.append(d)
                child.append(-1)
                low.append(rows[order[c:d]].min(0))
                high.append(rows[order[c:d]].max(0))
        return cls(ids[order], rows[order], np.array(first), np.array(end), np.array(child), np.array(low), np.array(high))

    def dump(self) -> bytes:
        np.savez(out := io.BytesIO(), **vars(self))
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Tree:
        return cls(**np.load(io.BytesIO(raw)))

    def search(self, queries: np.ndarray, k: int, worst: np.ndarray) -> list[list[tuple[int, int, bool]]]:
        """For each query up to k (score, vec_id, whether the vector is the query's), best first, smaller ids first among equals.

        worst: the k-th score known from elsewhere; lower scores are not returned. Scores are
        exact; those beyond a long are held at its limits.
        """
        width = max(self.rows.shape[1], queries.shape[1])
        own, low, high, asked = (
            np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (self.rows, self.low, self.high, queries)
        )
        kind = exact_kind(own, asked)
        rows, low, high, queries = (m.astype(kind) for m in (own, low, high, asked))
        bounds = box_bounds(queries, low, high)
        out = []
        for q in range(len(queries)):
            least = int(worst[q])
            best: list[tuple[int, int, int]] = []  # a heap of (score, -id, -row): its first is the worst
            bound = bounds[q]
            heap = [(-bound[0], 0)]
            while heap:
                b, node = heapq.heappop(heap)
                limit = best[0][0] if len(best) == k else least
                if -b < limit:
                    break
                c = int(self.child[node])
                if c >= 0:
                    heapq.heappush(heap, (-bound[c], c))
                    heapq.heappush(heap, (-bound[c + 1], c + 1))
                    continue
                a, e = self.first[node], self.end[node]
                scores = rows[a:e] @ queries[q]
                near = np.flatnonzero(scores >= limit)
                if len(near) > 4 * k:  # the k best, and those equal to the k-th, as ids decide among them
                    cut = np.partition(scores[near], len(near) - k)[len(near) - k]
                    near = near[scores[near] >= cut]
                    near = near[np.lexsort((self.ids[a:e][near], -scores[near]))][:k]
                for x in near.tolist():
                    one = (min(max(int(scores[x]), LONG[0]), LONG[1]), -int(self.ids[a + x]), -(a + x))
                    if len(best) < k:
                        heapq.heappush(best, one)
                    elif one > best[0]:
                        heapq.heapreplace(best, one)
            out.append([(s, -i, bool((own[-x] == asked[q]).all())) for s, i, x in sorted(best, reverse=True)])
        return out


def exact_kind(a: np.ndarray, b: np.ndarray) -> type:
    """The type in which inner products of rows of a and b are exact."""
    top = [int(np.abs(m.astype(object)).max()) if m.size else 0 for m in (a, b)]
    return np.float64 if top[0] * top[1] * max(1, a.shape[1]) < 1 << 53 else object


def box_bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(queries, boxes): what the inner product with a row in the box is at most."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


_TREES = "leaf int, sub int, tree binary, low array<bigint>, high array<bigint>"
_FOUND = "qid bigint, score bigint, vec_id bigint, same boolean"
_VISIT = f"{_FOUND}, leaf int, sub int, block binary"


def _packed(**arrays: np.ndarray) -> bytes:
    np.savez(out := io.BytesIO(), **arrays)
    return out.getvalue()


def _build(batch: pa.Table) -> pa.Table:
    tree = Tree.build(batch.column("vec_id").to_numpy(), matrix(batch.column("v")))
    return pa.table(
        {
            "leaf": pa.array([batch.column("leaf")[0].as_py()], pa.int32()),
            "sub": pa.array([batch.column("sub")[0].as_py()], pa.int32()),
            "tree": pa.array([tree.dump()], pa.binary()),
            "low": pa.array([tree.low[0].tolist()], pa.list_(pa.int64())),
            "high": pa.array([tree.high[0].tolist()], pa.list_(pa.int64())),
        }
    )


def _box(batch: pa.Table) -> pa.Table:
    low, high = matrix(batch.column("low")), matrix(batch.column("high"))
    return pa.table(
        {
            "leaf": pa.array([batch.column("leaf")[0].as_py()], pa.int32()),
            "low": pa.array([low.min(0).tolist()], pa.list_(pa.int64())),
            "high": pa.array([high.max(0).tolist()], pa.list_(pa.int64())),
        }
    )


def _placer(coarse: Coarse):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = coarse.place(matrix(batch.column(batch.schema.get_field_index("v"))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int32())], [*batch.schema.names, "leaf"])

    return work


def _found_batch(qids: list[int], found: list[list[tuple[int, int, bool]]], leaf=None, sub=None, block=None) -> pa.RecordBatch:
    rows = [(q, *x, None, None, None) for q, f in zip(qids, found, strict=True) for x in f]
    if block is not None:
        rows.append((None, None, None, None, leaf, sub, block))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.binary()]
    columns = zip(*rows, strict=True) if rows else [[]] * 7
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["qid", "score", "vec_id", "same", "leaf", "sub", "block"]
    )


def _answer_home(k: int):
    """Rows of a shard: its tree, then its queries. Out: what they find, and the queries in blocks with their k-th score."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, at = None, None
        ids: list[int] = []
        held: list = []

        def answered() -> pa.RecordBatch:
            rows = matrix(pa.array(held, pa.list_(pa.int64())))
            found = tree.search(rows, k, np.full(len(ids), LONG[0])) if tree is not None else [[] for _ in ids]
            worst = np.array([f[-1][0] if len(f) == k else LONG[0] for f in found], np.int64)
            return _found_batch(ids, found, *at, _packed(ids=np.array(ids), rows=rows, worst=worst))

        for batch in batches:
            for leaf, sub, raw, qid, v in zip(*(batch.column(n).to_pylist() for n in range(5)), strict=True):
                if at != (leaf, sub) or len(ids) == BLOCK_QUERIES:
                    if ids:
                        yield answered()
                        ids, held = [], []
                    if at != (leaf, sub):
                        tree, at = None, (leaf, sub)
                if raw is not None:
                    tree = Tree.load(raw)
                else:
                    ids.append(qid)
                    held.append(v)
        if ids:
            yield answered()

    return work


def _reach(leaves: list[int], low: np.ndarray, high: np.ndarray):
    """Blocks of queries to the leaves whose box reaches their k-th score: one smaller block for each leaf."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for home, sub, raw in zip(*(batch.column(n).to_pylist() for n in range(3)), strict=True):
                block = np.load(io.BytesIO(raw))
                width = max(low.shape[1], block["rows"].shape[1])
                rows, a, b = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (block["rows"], low, high))
                kind = exact_kind(rows, np.concatenate((a, b)))
                reach = box_bounds(*(m.astype(kind) for m in (rows, a, b))) >= block["worst"][:, None]
                for n, leaf in enumerate(leaves):
                    if len(pick := np.flatnonzero(reach[:, n])):
                        out.append((leaf, home, sub, _packed(ids=block["ids"][pick], rows=block["rows"][pick], worst=block["worst"][pick])))
            columns = zip(*out, strict=True) if out else [[]] * 4
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["leaf", "home", "home_sub", "block"])

    return work


def _visit(k: int):
    """Rows of a shard: its tree, then blocks of queries from other shards."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, at = None, None
        for batch in batches:
            for leaf, sub, raw, block in zip(*(batch.column(n) for n in range(4)), strict=True):
                place = leaf.as_py(), sub.as_py()
                if raw.is_valid:
                    tree, at = Tree.load(raw.as_py()), place
                elif at == place:
                    asked = np.load(io.BytesIO(block.as_py()))
                    yield _found_batch(asked["ids"].tolist(), tree.search(asked["rows"], k, asked["worst"])).select(["qid", "score", "vec_id", "same"])

    return work


def top_k(
    vectors: DataFrame, k: int = K, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """(query_id, rank, vec_id, score) of every row whose id is divisible by `every`, against all other rows.

    Vectors that are null or hold null or non-finite components take no part, nor do rows with a null id; an empty vector
    scores 0; a shorter vector counts as filled up with zeros. Rows that repeat an id are rows of their own: each is a
    candidate for the others, and each that is asked for has its ranks. Ties go to the smaller id. An empty table gives no
    rows; other columns are ignored. The driver holds a sample of SAMPLE_ROWS vectors and a box for each of at most MOST_LEAVES leaves.
    """
    n = partitions(vectors.sparkSession)
    usable = quantised(vectors, id_col, vector_col)
    width = k + 1
    first = W.partitionBy("v").orderBy("vec_id")
    pool = stored(usable.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= width).drop("_n"), "knn-pool")
    asked = stored(
        usable.where(F.col("vec_id") % every == 0).groupBy("v").agg(F.count("*").alias("copies")).select(F.monotonically_increasing_id().alias("qid"), "v"),
        "knn-asked",
    )
    total = pool.count()
    share = int(min(1.0, SAMPLE_ROWS / max(1, total)) * (1 << 20))
    leaves = min(MOST_LEAVES, math.ceil(total / shard_rows))
    sample = pool.where(F.pmod(F.xxhash64("v"), F.lit(1 << 20)) < share).select("v").toArrow().column("v") if leaves > 1 else pa.chunked_array([], pa.list_(pa.int64()))
    coarse = Coarse(matrix(sample), leaves)
    place = _placer(coarse)
    placed = stored(arrow_map(pool, place, "vec_id bigint, v array<bigint>, leaf int"), "knn-placed")
    counts = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}
    parts = [max(1, math.ceil(counts.get(x, 0) / shard_rows)) for x in range(coarse.leaves)]
    subs = F.element_at(F.array(*map(F.lit, parts)), F.col("leaf") + 1)
    sub = F.pmod(F.xxhash64("v"), subs).cast("int")
    trees = stored(placed.withColumn("sub", sub).groupBy("leaf", "sub").applyInArrow(_build, _TREES), "knn-trees")
    queries = arrow_map(asked, place, "qid bigint, v array<bigint>, leaf int").withColumn("sub", sub)
    null = lambda kind: F.lit(None).cast(kind)
    home = stored(
        trees.select("leaf", "sub", "tree", null("bigint").alias("qid"), null("array<bigint>").alias("v"))
        .unionByName(queries.select("leaf", "sub", null("binary").alias("tree"), "qid", "v"))
        .repartition(n, "leaf", "sub")
        .sortWithinPartitions("leaf", "sub", F.col("qid").isNotNull())
        .mapInArrow(_answer_home(width), _VISIT),
        "knn-home",
    )
    boxes = trees.select("leaf", "low", "high").groupBy("leaf").applyInArrow(_box, "leaf int, low array<bigint>, high array<bigint>").toArrow()
    reach = _reach(boxes.column("leaf").to_pylist(), matrix(boxes.column("low")), matrix(boxes.column("high")))
    sent = stored(
        arrow_map(home.where("block is not null").select("leaf", "sub", "block"), reach, "leaf int, home int, home_sub int, block binary")
        .withColumn("sub", F.explode(F.sequence(F.lit(0), subs - 1)))
        .where("not (leaf = home and sub = home_sub)"),
        "knn-sent",
    )
    salts = max(1, math.ceil(home.where("block is not null").count() / VISIT_BLOCKS))
    visits = (
        trees.select("leaf", "sub", "tree", null("binary").alias("block"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        .unionByName(
            sent.select("leaf", "sub", null("binary").alias("tree"), "block", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int").alias("salt"))
        )
        .repartition(n, "leaf", "sub", "salt")
        .sortWithinPartitions("leaf", "sub", "salt", F.col("block").isNotNull())
        .select("leaf", "sub", "tree", "block")
        .mapInArrow(_visit(width), _FOUND)
    )
    best = W.partitionBy("qid").orderBy(F.desc("score"), "vec_id", F.desc("same"))
    found = (
        home.where("qid is not null")
        .select("qid", "score", "vec_id", "same")
        .unionByName(visits)
        .withColumn("n", F.row_number().over(best))
        .where(F.col("n") <= width)
        .groupBy("qid")
        .agg(F.array_sort(F.collect_list(F.struct("n", "score", "vec_id", "same"))).alias("found"))
    )
    answers = stored(asked.hint("merge").join(found, "qid"), "knn-answers").select("v", "found")
    rows = usable.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v").hint("merge").join(answers, "v")
    # of the k + 1 best the row itself goes, or else the last
    own = F.array_position(F.transform("found", lambda x: x["same"] & (x["vec_id"] == F.col("query_id"))), F.lit(True))
    rest = F.slice(F.filter("found", lambda x, at: at + 1 != F.col("own")), 1, k)
    return (
        rows.withColumn("own", own)
        .select("query_id", F.posexplode(rest).alias("at", "x"))
        .select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")
    )
