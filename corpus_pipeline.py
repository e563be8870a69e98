"""A training-data pipeline over documents: five stages, each the whole of what the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the docs of the next. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuespark.llm import bpe, langid, near_dup, packing, secret_scan, suffix_dedup
from cuespark.llm._util import dropped, stored

#: Stages on word shingles take five words and a similarity of 0.8.
WORDS, PERCENT = 5, 80
#: The vocabulary that lengths are counted by; the setting that names a secret ledger.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
LEDGER = "spark.cuespark.secret.ledger"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a language that stands out, go. Null text goes. Rows with a null id are judged like others.

    What stands out is learned from the labelled rows of docs themselves; without any, all go.
    """
    return langid.accepted(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.

    Rows with a null id, null or empty text stay, and so do rows that repeat an id that stays. An empty table stays empty.
    """
    marks = near_dup.near_duplicates(docs, words=WORDS, percent=PERCENT)
    gone = marks.where("not kept").select("doc_id").distinct()
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has are cut out; characters cut in two go whole.

    All documents stay; null text becomes empty. Rows that repeat an id don't cut each other; rows with a null id are left as they are.
    """
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    cut = suffix_dedup.remove_repeats(docs, carry=rest)
    text = F.coalesce(F.try_validate_utf8(F.col("kept_bytes").cast("string")), _whole_characters(F.col("kept_bytes")))
    done = cut.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long"))
    return done.select(*docs.columns)


def _whole_characters(raw):
    """The bytes as text without the characters that a cut has divided."""
    return F.replace(F.make_valid_utf8(raw.cast("string")), F.lit("�"), F.lit(""))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; all documents stay, null text stays null, rows with a null id are masked too.

    The setting LEDGER names a ledger that is kept: blobs that an earlier run has scanned are not scanned again.
    """
    return secret_scan.redact(docs, spark.conf.get(LEDGER, None)).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batch of every document, by the tokens of the byte-level vocabulary; see packing.pack() for nulls, ties and long texts."""
    lengths = bpe.lengths(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return packing.pack(lengths, F.col("n_tokens"))


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("secret scans", secrets),
    ("packing", packed),
]

#: SQL can express neither the learned language stage nor the encoder; the tests compare every stage with a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; the tables between them are deleted once the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        done, docs = docs, stored(out, f"stage-{k}")
        if k:
            dropped(done)
    return docs
