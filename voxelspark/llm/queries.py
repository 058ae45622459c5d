"""Queries of the text operators over the whole driver tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe_count import token_counts
from .common import bound_batches, read_table
from .decontaminate import contaminated
from .line_spread import dedup_lines
from .ngram_join import jaccard_components
from .packing import pack
from .pii import find_pii, pii_digest
from .repetition import repetition_rules
from .sharding import assign_shards, lookup_table
from .suffix_dedup import remove_repeats
from .toxicity import score_toxicity

SHARDS = [f"shard-{i:03d}" for i in range(100)]
TABLE_SIZE = 65537


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_rules(read_table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return assign_shards(docs, "doc_id", SHARDS, size=TABLE_SIZE)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed_lines", F.md5("text").alias("kept_md5"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(find_pii(read_table(spark, sf_dir, "documents")))


def _bounded(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = {
        "op1_repetition": op1_repetition,
        "op2_token_counts": op2_token_counts,
        "op3_sharding": op3_sharding,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_packing": op5_packing,
        "op6_decontamination": op6_decontamination,
        "op7_ngram_join": op7_ngram_join,
        "op8_toxicity": op8_toxicity,
        "op9_line_spread": op9_line_spread,
        "op10_pii": op10_pii,
    }
    return {name: _bounded(query) for name, query in every.items()}


def _op3_sql() -> str:
    table = ",".join(map(str, lookup_table(SHARDS, TABLE_SIZE)))
    return f"""
    WITH lookup AS (SELECT string_split('{table}', ',') t)
    SELECT doc_id, source, n_chars, CAST(slot AS INTEGER) slot,
           'shard-' || lpad(t[slot + 1], 3, '0') shard
    FROM (SELECT doc_id, source, n_chars,
                 CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::UBIGINT % {TABLE_SIZE} AS BIGINT) slot
          FROM documents), lookup"""


OP9_SQL = """
    WITH parts AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) p FROM documents),
    wide AS (SELECT line FROM parts WHERE length(trim(line, ' ')) >= 16 GROUP BY line HAVING count(DISTINCT source) >= 10)
    SELECT doc_id, count(*) n_lines, count(w.line) n_removed_lines,
           md5(coalesce(string_agg(parts.line, chr(10) ORDER BY p) FILTER (WHERE w.line IS NULL), '')) kept_md5
    FROM parts LEFT JOIN wide w ON parts.line = w.line GROUP BY doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op3_sharding": _op3_sql(), "op9_line_spread": OP9_SQL}
