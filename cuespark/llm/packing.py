"""Packing into optimal length buckets.

The global histogram has a bin for each length up to the token budget, so it is bounded. Dynamic programming over the
bins chooses the bucket boundaries that minimise padding, exactly, in whole numbers. In a bucket every document is padded to the
boundary, and as many as fit the token budget make a batch. Buckets are dealt out to shards
whose number follows from the histogram, so that a bucket with most of the rows is not
gathered anywhere; each shard leaves at most one batch that isn't full. A document over the budget is marked, and a batch of
its own without padding.
"""

from __future__ import annotations

import math
from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cuespark.llm._util import stored

BUCKETS = 16
TOKEN_BUDGET = 65_536
SHARD_ROWS = 20_000


def word_count(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text; null has none."""
    flat = F.trim(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "))
    # between two words stands one run of spaces
    return F.when(flat == "", 0).otherwise(F.size(F.split(flat, " +", -1))).cast("long")


def boundaries(lengths: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """Ends of at most `buckets` buckets with the least sum of (end - length) * count. lengths ascend.

    A bucket of bins i to j - 1 costs end[j-1] * (c[j] - c[i]) - (w[j] - w[i]), with c and w running sums of counts and of tokens. For
    a given j that is a line in end[j-1] for each i, so each layer walks the lower hull of lines whose slopes fall as i grows.
    """
    n = len(lengths)
    if not n:
        return []
    c, w = [0], [0]
    for x, k in zip(lengths, counts, strict=True):
        c.append(c[-1] + k)
        w.append(w[-1] + x * k)
    best: list[int | None] = [0] + [None] * n
    cuts: list[list[int]] = []
    for _ in range(min(buckets, n)):
        now: list[int | None] = [0] + [None] * n
        cut = [0] * (n + 1)
        hull: list[tuple[int, int, int]] = []  # (slope, height, i)
        at = 0
        for j in range(1, n + 1):
            if (b := best[j - 1]) is not None:
                m, h = -c[j - 1], b + w[j - 1]
                while len(hull) > at + 1 and (hull[-1][1] - hull[-2][1]) * (hull[-1][0] - m) >= (h - hull[-1][1]) * (hull[-2][0] - hull[-1][0]):
                    hull.pop()
                if not hull or hull[-1][0] > m:
                    hull.append((m, h, j - 1))
            x = lengths[j - 1]
            while at + 1 < len(hull) and hull[at + 1][0] * x + hull[at + 1][1] < hull[at][0] * x + hull[at][1]:
                at += 1
            now[j] = hull[at][0] * x + hull[at][1] + x * c[j] - w[j]
            cut[j] = hull[at][2]
        best = now
        cuts.append(cut)
    out, j = [], n
    for cut in reversed(cuts):
        if j == 0:
            break
        out.append(lengths[j - 1])
        j = cut[j]
    return out[::-1]


def pack(
    docs: DataFrame,
    length: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = BUCKETS,
    budget: int = TOKEN_BUDGET,
) -> DataFrame:
    """(id, n_tokens, bucket, bucket_tokens, batch, slot, padding, oversize) of every row.

    length: tokens of a row, see bpe.lengths(); the words of the text by default. Lengths are stored once. Null text or a null
    length counts as 0. A document longer than the budget is oversize: a batch of its own, padded to nothing, in a bucket after the last.
    Rows of a bucket are ordered by a hash of the id, then the id and the length; rows that repeat an id are packed each, rows with a
    null id as well, ties in any order. An empty table gives no rows. The driver gets the histogram alone, of at most budget + 2 rows.
    batch names bucket, shard and number. Other columns are ignored.
    """
    n = F.coalesce((word_count(F.col(text_col)) if length is None else length).cast("long"), F.lit(0))
    rows = stored(docs.select(F.col(id_col), n.alias("cs_n")), "packing-lengths")
    over = budget + 1
    histogram = sorted(tuple(r) for r in rows.groupBy(F.least("cs_n", F.lit(over)).alias("bin")).count().collect())
    beyond = histogram.pop()[1] if histogram and histogram[-1][0] == over else 0
    ends = boundaries([x for x, _ in histogram], [x for _, x in histogram], buckets)
    sizes = [0] * len(ends) + [beyond]
    for x, k in histogram:
        sizes[bisect_left(ends, x)] += k
    per = [*(max(1, budget // max(1, e)) for e in ends), 1]
    # whole batches a shard, so that few batches stay partly filled
    shards = [max(1, k // (math.ceil(SHARD_ROWS / p) * p)) for k, p in zip(sizes, per, strict=True)]
    pick = lambda xs: F.element_at(F.array(*(F.lit(int(x)).cast("long") for x in xs)), F.col("bucket") + 1)
    bucket = F.size(F.filter(F.array(*(F.lit(e).cast("long") for e in [*ends, *[budget] * (not ends)])), lambda e: e < F.col("cs_n")))
    dealt = (
        rows.withColumn("bucket", F.when(F.col("cs_n") > budget, len(ends)).otherwise(bucket).cast("int"))
        .withColumn("cs_hash", F.xxhash64(F.col(id_col)))
        .withColumn("cs_shard", F.pmod(F.xxhash64("cs_hash", "cs_n"), pick(shards)))
    )
    within = W.partitionBy("bucket", "cs_shard").orderBy("cs_hash", id_col, "cs_n")
    placed = dealt.withColumn("cs_rank", F.row_number().over(within).cast("long") - 1)
    end = F.when(F.col("bucket") == len(ends), F.col("cs_n")).otherwise(pick([*ends, 0]))
    return placed.select(
        F.col(id_col),
        F.col("cs_n").alias("n_tokens"),
        "bucket",
        end.alias("bucket_tokens"),
        F.concat_ws(":", "bucket", "cs_shard", F.floor(F.col("cs_rank") / pick(per))).alias("batch"),
        F.pmod(F.col("cs_rank"), pick(per)).alias("slot"),
        (end - F.col("cs_n")).alias("padding"),
        (F.col("cs_n") > budget).alias("oversize"),
    )
