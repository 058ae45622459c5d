"""Reports and statistics of long-form results (id, label, metric, value)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Name of a statistic -> aggregate.
STATISTICS: dict[str, Callable[[str], Column]] = {"MEAN": F.avg, "STD": F.stddev_pop}


def statistics(results: DataFrame, functions: dict[str, Callable[[str], Column]] | None = None) -> DataFrame:
    """(label, metric, statistic, value) of all ids, in one aggregate; STD is of the population."""
    functions = functions or STATISTICS
    wide = results.groupBy("label", "metric").agg(*[f("value").alias(n) for n, f in functions.items()])
    pairs = ", ".join(f"'{n}', CAST(`{n}` AS DOUBLE)" for n in functions)
    return wide.selectExpr("label", "metric", f"stack({len(functions)}, {pairs}) AS (statistic, value)")


def pivot(results: DataFrame, metrics: Sequence[str], missing: str = "n/a", precision: int | None = None) -> DataFrame:
    """A row for each id and label that occur, a text column for each metric in sorted order."""
    metrics = sorted(metrics)
    cells = results.groupBy("id", "label").pivot("metric", metrics).agg(F.first("value"))
    frame = results.select("id").distinct().join(results.select("label").distinct(), F.lit(True))
    text = lambda c: F.col(c).cast("string") if precision is None else F.format_string(f"%.{precision}f", F.col(c).cast("double"))
    joined = frame.join(cells, ["id", "label"], "left")
    return joined.select("id", "label", *[F.when(F.col(m).isNull(), F.lit(missing)).otherwise(text(m)).alias(m) for m in metrics])


def console_lines(table: DataFrame, order: Sequence[str]) -> DataFrame:
    """One text column: fields padded to their column's width and two spaces, the last one to its width."""
    names = table.columns
    texts = table.select(*[F.col(c).cast("string").alias(c) for c in names])
    width = texts.agg(*[F.greatest(F.max(F.length(c)), F.lit(len(c))).alias(f"w_{c}") for c in names])
    wide = texts.join(F.broadcast(width), F.lit(True))  # one row of widths
    padded = [F.rpad(F.col(c), F.col(f"w_{c}") + (2 if c != names[-1] else 0), " ") for c in names]
    return wide.select(*order, F.concat(*padded).alias("line")) if order else wide.select(F.concat(*padded).alias("line"))


def write_csv(table: DataFrame, path: str, delimiter: str = ";") -> None:
    """Upper-case header; ids appear as SUBJECT."""
    named = table.toDF(*[("SUBJECT" if c == "id" else c).upper() for c in table.columns])
    named.write.mode("overwrite").option("header", True).option("sep", delimiter).csv(path)


def print_console(table: DataFrame, order: Sequence[str], out: Callable[[str], None] = print) -> None:
    for row in console_lines(table, order).orderBy(*order).toLocalIterator():
        out(row["line"])
