"""Secret scans with an incremental blob ledger.

Every historical version of a file is addressed by the SHA-256 of its content. The ledger
holds one row for each (blob, rule version) that has been scanned, with its spans. A scan
groups versions by content (map-side first, so a group of copies is combined before it is
shuffled), drops the pairs the ledger already has, runs the rules on what is left, and
joins spans back to all paths that hold the blob. DataFrame functions only.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from cuespark.llm._util import stored

# Fixed values: (kind, pattern, group whose length counts, its least length), in order of kind.
RULES: tuple[tuple[str, str, int, int], ...] = (
    (
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
        r"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    # the block up to its END line (up to eight single hyphens are in its headers), else the base64 lines that follow
    (
        "pem",
        r"""-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----(?:[^-]*(?:-[^-]+){0,8}-----END [A-Z0-9 ]*PRIVATE KEY-----"""
        r"""|(?:[\x20\t\r\n]|\\[nr]){0,8}[A-Za-z0-9+/=]{16,}[A-Za-z0-9+/=\\\r\n]*)?""",
        0,
        1,
    ),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    ("forge", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 20),
)
BASE_KINDS = ("assign", "access", "hex")
LEDGER_SCHEMA = (
    "blob string, rule_version string, n_assign bigint, n_access bigint, n_hex bigint, "
    "base_list string, spans string"
)


def rule_version(rules=RULES) -> str:
    """Names the content of the rules: any change makes every blob unseen again."""
    return hashlib.sha256(json.dumps(rules).encode()).hexdigest()[:16]


def empty_ledger(spark: SparkSession) -> DataFrame:
    fields = (x.strip().split() for x in LEDGER_SCHEMA.split(","))
    return spark.range(0).select(*(F.lit(None).cast(kind).alias(name) for name, kind in fields))


def address(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _found(text: Column, number: int, rule) -> Column:
    """Of one rule: array of (kind number, code points before the match, of the match, kept)."""
    kind, pattern, group, least = rule
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    counted = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    zipped = F.arrays_zip(
        F.transform(F.slice(gaps, 1, F.size(whole)), F.char_length).alias("gap"),
        F.transform(whole, F.char_length).alias("size"),
        F.transform(counted, lambda x: F.char_length(x) >= least).alias("kept"),
    )
    return F.when(text.rlike(pattern), zipped)


def scan_blobs(blobs: DataFrame, rules=RULES) -> DataFrame:
    """blobs (blob, blob_text) to ledger rows; every blob gets one, also where nothing is found.

    Positions are code points: match k starts after the sum of gaps and matches before it, a
    running sum over the matches of one blob and kind. Null text counts as empty.
    """
    version = rule_version(rules)
    text = F.coalesce(F.col("blob_text"), F.lit(""))
    found = blobs.select(
        "blob", *(_found(text, k, rule).alias(f"k{k}") for k, rule in enumerate(rules))
    )
    any_found = " or ".join(f"k{k} is not null" for k in range(len(rules)))
    by_kind = F.array(
        *(F.struct(F.lit(k).alias("kind"), F.col(f"k{k}").alias("m")) for k in range(len(rules)))
    )
    each = (
        found.select(
            "blob",
            F.explode(
                F.when(F.expr(any_found), F.filter(by_kind, lambda x: x["m"].isNotNull())).otherwise(F.slice(by_kind, 1, 1))
            ).alias("x"),
        )
        .select("blob", F.col("x.kind").alias("kind"), F.posexplode_outer("x.m").alias("pos", "m"))
    )
    upto = W.partitionBy("blob", "kind").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum(F.expr("m.gap + m.size").cast("long")).over(upto)).select(
        "blob",
        "kind",
        (F.col("end") - F.col("m.size")).alias("start"),
        "end",
        (F.col("pos").isNotNull() & F.col("m.kept")).alias("kept"),
    )
    names = F.array(*(F.lit(kind) for kind, *_ in rules))
    span = F.when(F.col("kept"), F.struct("start", "kind", "end"))
    base = [k for k, rule in enumerate(rules) if rule[0] in BASE_KINDS]

    def count(kind: str) -> Column:
        k = next((k for k, rule in enumerate(rules) if rule[0] == kind), -1)
        return F.count_if(F.col("kept") & (F.col("kind") == k)).alias(f"n_{kind}")

    def listed(spans: Column) -> Column:
        return F.array_join(
            F.transform(
                F.array_sort(spans),
                lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"]),
            ),
            ",",
        )

    return placed.groupBy("blob").agg(
        F.lit(version).alias("rule_version"),
        *(count(kind) for kind in BASE_KINDS),
        listed(F.collect_list(F.when(F.col("kind").isin(base), span))).alias("base_list"),
        listed(F.collect_list(span)).alias("spans"),
    )


def unseen(versions: DataFrame, ledger: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """(blob, blob_text) of each distinct content that the ledger lacks under these rules."""
    blobs = (
        versions.select(address(F.col(text_col)).alias("blob"), F.col(text_col).alias("blob_text"))
        .groupBy("blob")
        .agg(F.first("blob_text").alias("blob_text"))
    )
    seen = ledger.where(F.col("rule_version") == rule_version(rules)).select("blob")
    return blobs.join(seen, "blob", "left_anti")


def scan(
    versions: DataFrame, ledger: DataFrame | None = None, key_col: str = "doc_id", text_col: str = "text", rules=RULES
) -> tuple[DataFrame, DataFrame]:
    """(one row per row of versions, ledger rows that are new and stored).

    Null and empty texts share the empty blob and have no spans; repeated rows give repeated
    rows; other columns of versions are ignored. The new ledger rows are written to the shared
    folder before the join, so a lost executor never causes another scan.
    """
    spark = versions.sparkSession
    ledger = empty_ledger(spark) if ledger is None else ledger.select("blob", "rule_version", "n_assign", "n_access", "n_hex", "base_list", "spans")
    new = stored(scan_blobs(unseen(versions, ledger, text_col, rules), rules), "secret-ledger")
    known = ledger.where(F.col("rule_version") == rule_version(rules)).unionByName(new).where("spans <> ''")
    paths = versions.select(F.col(key_col), address(F.col(text_col)).alias("blob"))
    zero = F.lit(0).cast("long")
    result = paths.join(known.drop("rule_version"), "blob", "left").select(
        F.col(key_col),
        *(F.coalesce(f"n_{kind}", zero).alias(f"n_{kind}") for kind in BASE_KINDS),
        F.sha2(F.coalesce("base_list", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"),
    )
    return result, new


def opened(spark: SparkSession, path: str) -> DataFrame:
    """The ledger kept at a path; empty if there is none yet. Runs that ended at the same time can both have added a blob: it counts once."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return empty_ledger(spark)
    return spark.read.schema(LEDGER_SCHEMA).parquet(path).dropDuplicates(["blob", "rule_version"])


def scan_kept(
    versions: DataFrame, path: str, key_col: str = "doc_id", text_col: str = "text", rules=RULES
) -> tuple[DataFrame, int]:
    """(scan() against the ledger at path, number of blob and rule-version pairs that were scanned).

    New pairs are appended to the ledger in one commit, so the next run scans none of them; a run that fails before leaves it as it was.
    """
    result, new = scan(versions, opened(versions.sparkSession, path), key_col, text_col, rules)
    scanned = new.count()
    if scanned:
        new.write.mode("append").parquet(path)
    return result, scanned


def masked(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """text with the union of spans (as scan() lists them) replaced by mask; spans that overlap or touch are one. Null stays null.

    ASCII text is cut as bytes, so the time is linear; in other text each span costs a walk from the text's start.
    """
    number = lambda x, k: F.element_at(F.split(x, ":"), k).cast("int")
    each = F.array_sort(F.transform(F.split(spans, ","), lambda x: F.struct(number(x, 2).alias("a"), number(x, 3).alias("z"))))
    kind = "array<struct<a:int,z:int>>"

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["a"].alias("a"), F.greatest(last["z"], x["z"]).alias("z"))
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))
        return F.when((F.size(done) > 0) & (x["a"] <= F.try_element_at(done, F.lit(-1))["z"]), joined).otherwise(F.concat(done, F.array(x))).cast(kind)

    whole = F.aggregate(F.slice(each, 2, F.size(each)), F.slice(each, 1, 1).cast(kind), add)
    begin = F.concat(F.array(F.lit(0)), F.transform(whole, lambda x: x["z"]))
    end = F.concat(F.transform(whole, lambda x: x["a"]), F.array(F.char_length(text)))
    gaps = F.arrays_zip(begin.alias("a"), end.alias("z"))
    ascii_only = F.char_length(text) == F.octet_length(text)
    raw = text.cast("binary")
    fast = F.transform(gaps, lambda g: F.substring(raw, g["a"] + 1, g["z"] - g["a"]).cast("string"))
    slow = F.transform(gaps, lambda g: F.substring(text, g["a"] + 1, g["z"] - g["a"]))
    return F.array_join(F.when(ascii_only, fast).otherwise(slow), mask)


def redact(
    docs: DataFrame,
    ledger: DataFrame | str | None = None,
    key_col: str = "doc_id",
    text_col: str = "text",
    rules=RULES,
    mask: str = "[SECRET]",
) -> DataFrame:
    """docs with the secrets that a scan finds masked in the text; all other columns stay.

    ledger: a table, or the path of one that is kept. All rules are judged on the text as given, and the union of their spans is
    masked. Rows without a finding keep their text; null stays null. Findings are looked up by content, so rows without a key are
    masked too. An empty table stays empty; repeated rows are masked alike.
    """
    spark = docs.sparkSession
    known = opened(spark, ledger) if isinstance(ledger, str) else empty_ledger(spark) if ledger is None else ledger
    _, new = scan(docs, known, key_col, text_col, rules)
    both = known.where(F.col("rule_version") == rule_version(rules)).select("blob", "spans").unionByName(new.select("blob", "spans"))
    hit = stored(both.where("spans <> ''").select(F.col("blob").alias("cs_key"), F.col("spans").alias("cs_spans")).dropDuplicates(["cs_key"]), "secret-hits")
    if isinstance(ledger, str):
        new.write.mode("append").parquet(ledger)
    joined = docs.join(hit, address(F.col(text_col)) == F.col("cs_key"), "left")
    text = F.when(F.col("cs_spans").isNotNull(), masked(F.col(text_col), F.col("cs_spans"), mask)).otherwise(F.col(text_col))
    return joined.withColumn(text_col, text).select(*docs.columns)
