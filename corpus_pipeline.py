"""Corpus pipeline: toxicity, line dedup, near-duplicate join, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return the
columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelspark.llm.common import bound_batches, checkpoint_dir, read_table
from voxelspark.llm.decontaminate import remove_contaminated
from voxelspark.llm.line_spread import dedup_lines
from voxelspark.llm.ngram_join import keep_one
from voxelspark.llm.packing import pack
from voxelspark.llm.queries import tokenizer_path
from voxelspark.llm.toxicity import drop_toxic

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go.

    Null and empty texts are scored as texts without words; null ids are carried and count as held out. Repeated rows
    are scored alone. An empty table stays empty, extra columns go. Texts are read whole.
    """
    bound_batches(spark)
    return drop_toxic(docs.select(*COLUMNS), read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines leave the texts; n_chars follows. Documents without a line left stay, with an empty text.

    Null texts stay null, null sources count as no site, null ids are carried. Repeated rows lose the same lines. An
    empty table stays empty, extra columns go. Texts of any length are read whole.
    """
    bound_batches(spark)
    return dedup_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays.

    Null ids come last; of rows that repeat in id and text one stays; ties go by a hash of both. Null texts and texts
    without words are linked with nothing and stay. An empty table stays empty, extra columns go. Texts are read whole.
    """
    bound_batches(spark)
    return keep_one(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that copy a benchmark item go.

    Null and empty texts copy nothing and stay. Rows that share an id share a verdict, those with a null id too.
    An empty table stays empty, extra columns go. Texts are read whole.
    """
    bound_batches(spark)
    return remove_contaminated(docs.select(*COLUMNS), read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens.

    Null and empty texts are one piece, the end id. Each row is a document of its own, repeated or not; null ids are
    carried. An empty table gives no rows. Texts are packed whole.
    """
    bound_batches(spark)
    return pack(docs.select(*COLUMNS), tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Suffix arrays, alignments and tokenizers are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{name}")
    return docs
