"""Line dedup by distinct-site spread.

A HyperLogLog sketch of sites for each line hash, merged by aggregation, tells on how many sites a line stands. Lines
whose estimate is within the sketch's error of the threshold get an exact distinct count. Lines on enough sites are
boilerplate and leave every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_stash, row_key, stash

LG_K = 12


def _counts(line: Column, min_chars: int) -> Column:
    return F.length(F.trim(line)) >= min_chars


def line_hashes(docs: DataFrame, text_col: str, min_chars: int, *columns: Column) -> DataFrame:
    """The hash of every line that counts, beside the given columns."""
    lines = docs.select(*columns, F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).alias("line"))
    return lines.where(_counts(F.col("line"), min_chars)).select(*[c for c in lines.columns if c != "line"], F.xxhash64("line").alias("h"))


def spread_lines(docs: DataFrame, text_col: str, site_col: str, min_sites: int, min_chars: int) -> DataFrame:
    """Hashes of the lines that stand on at least ``min_sites`` distinct sites."""
    lines = line_hashes(docs, text_col, min_chars, F.col(site_col).cast("string").alias("site"))
    band = 3 * 1.04 / (1 << LG_K) ** 0.5
    estimate = F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K)))
    spread = stash(lines.groupBy("h").agg(estimate.alias("sites")).where(F.col("sites") >= int(min_sites * (1 - band))))
    upper = min_sites * (1 + band) + 1
    near = spread.where(F.col("sites") < upper).select("h")
    exact = lines.join(near, "h", "left_semi").groupBy("h").agg(F.count_distinct("site").alias("sites")).where(F.col("sites") >= min_sites)
    out = stash(spread.where(F.col("sites") >= upper).select("h").union(exact.select("h")))
    drop_stash(spread)
    return out


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", *, min_sites: int = 10, min_chars: int = 16) -> DataFrame:
    """All columns, the text without boilerplate lines, and n_lines and n_removed_lines (longs, replaced if present).

    Lines are cut at newlines; those shorter than ``min_chars`` without outer spaces never count. Null text: kept
    null, no lines. Empty text: one empty line, kept. Null site: counts as no site. Rows that repeat each lose the
    same lines. Null ids and extra columns are carried. An empty table stays empty. Only hashes are shuffled by line;
    a text moves once, by its row's key.
    """
    boilerplate = spread_lines(docs, text_col, site_col, min_sites, min_chars)
    key = row_key(id_col, text_col)
    hits = line_hashes(docs, text_col, min_chars, *key).join(boilerplate, "h").groupBy("k_id", "k_text").agg(F.collect_set("h").alias("k_hits"))
    mark = "k"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    own_id, own_text, hit_list = f"{mark}1", f"{mark}2", f"{mark}5"
    keyed = docs.select("*", key[0].alias(own_id), key[1].alias(own_text))
    found = hits.toDF(f"{mark}3", f"{mark}4", hit_list)
    same = keyed[own_id].eqNullSafe(found[f"{mark}3"]) & (keyed[own_text] == found[f"{mark}4"])
    joined = keyed.join(found.hint("shuffle_hash"), same, "left")
    lines = F.split(F.col(text_col), "\n", -1)
    gone = lambda line: _counts(line, min_chars) & F.array_contains(F.col(hit_list), F.xxhash64(line))
    kept = F.when(F.col(hit_list).isNull(), F.col(text_col)).otherwise(F.array_join(F.filter(lines, lambda line: ~gone(line)), "\n"))
    n_gone = F.when(F.col(hit_list).isNull(), F.lit(0)).otherwise(F.size(F.filter(lines, gone)))
    n_lines = F.when(F.col(text_col).isNull(), F.lit(0)).otherwise(F.size(lines))
    columns = [kept.alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in ("n_lines", "n_removed_lines")]
    return joined.select(*columns, n_lines.cast("long").alias("n_lines"), n_gone.cast("long").alias("n_removed_lines"))
