"""Evaluation: label masks, confusion counts in one aggregate, metrics on top of it, statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as M
from . import surface as S

Label = int | Sequence[int]


def label_masks(df: DataFrame, labels: dict[str, Label], keys: Sequence[str] = ("subject",)) -> DataFrame:
    """One row for each voxel and label; a label may merge several values."""
    if not labels:
        raise ValueError("no labels are given")
    parts = []
    for name, value in labels.items():
        values = [value] if isinstance(value, int) else list(value)
        parts.append(F.struct(F.lit(name).alias("label"), F.col("pred").isin(values).cast("int").alias("pred"), F.col("ref").isin(values).cast("int").alias("ref")))
    kept = [c for c in df.columns if c not in ("pred", "ref", "label")]
    return df.select(*kept, F.inline(F.array(*parts)))


def confusion(df: DataFrame, keys: Sequence[str] = ("subject",)) -> DataFrame:
    """tp, tn, fp, fn as doubles and n for each key; values other than 0 and 1 count in n alone."""
    cell = lambda p, r: F.count_if((F.col("pred") == p) & (F.col("ref") == r)).cast("double")
    return df.groupBy(*keys).agg(cell(1, 1).alias("tp"), cell(0, 0).alias("tn"), cell(1, 0).alias("fp"), cell(0, 1).alias("fn"), F.count("*").cast("double").alias("n"))


def evaluate_counts(df: DataFrame, metrics: Sequence[str] | None = None, keys: Sequence[str] = ("subject",)) -> DataFrame:
    """Metrics of binary masks, a column each, from one aggregate."""
    metrics = list(M.COUNT_METRICS) if metrics is None else list(metrics)
    return confusion(df, keys).select(*keys, *[F.expr(M.COUNT_METRICS[m]).cast("double").alias(m) for m in metrics])


def long_results(wide: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Results as rows of (keys, metric, value)."""
    pairs = ", ".join(f"'{m}', `{m}`" for m in metrics)
    return wide.selectExpr(*keys, f"stack({len(metrics)}, {pairs}) AS (metric, value)")


@dataclass(frozen=True)
class Metric:
    """A metric of one's own: its name and an SQL expression over tp, tn, fp, fn and n."""

    name: str
    expression: str


def _spatial(masks: DataFrame, wanted: set[str], keys: Sequence[str], spacing: Sequence[float]) -> dict[str, DataFrame]:
    """Tables (keys, metric) of the metrics that need places of voxels; the surface ones share their distances."""
    out: dict[str, DataFrame] = {}
    if wanted & {"HDRFDST", "SURFDICE", "SURFOVLP"}:
        distances = S.surface_distances(masks, spacing, keys)
        make = {"HDRFDST": S.hausdorff, "SURFDICE": S.surface_dice, "SURFOVLP": S.surface_overlap}
        out |= {m: f(distances, masks, keys=keys) for m, f in make.items() if m in wanted}
    if "AVGDIST" in wanted:
        out["AVGDIST"] = S.average_distance(masks, spacing, keys=keys)
    if "MAHLNBS" in wanted:
        out["MAHLNBS"] = mahalanobis(masks, keys)
    return out


def evaluate_segmentation(df: DataFrame, labels: dict[str, Label], metrics: Sequence[str | Metric] = M.SEGMENTATION_METRICS, keys: Sequence[str] = ("subject",), spacing: Sequence[float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Long-form results of label maps: one aggregate over all labels and expressions on it, joined with the tables of
    metrics that need places (z, y, x) of voxels. Any of ``SEGMENTATION_METRICS``, and metrics of one's own."""
    own = [*keys, "label"]
    names = [m.name if isinstance(m, Metric) else m for m in metrics]
    voxel = float(spacing[0] * spacing[1] * spacing[2])
    known = M.COUNT_METRICS | {side: M.volume(side, voxel) for side in ("PREDVOL", "REFVOL")} | {m.name: m.expression for m in metrics if isinstance(m, Metric)}
    masks = label_masks(df, labels, keys)
    spatial = _spatial(masks, set(names) - known.keys(), own, spacing)
    if unknown := [m for m in names if m not in known and m not in spatial]:
        raise ValueError(f"unknown metrics: {', '.join(unknown)}")
    out = confusion(masks, own).select(*own, *[F.expr(known[m]).cast("double").alias(m) for m in names if m in known])
    for table in spatial.values():
        out = out.join(table, own)
    return long_results(out, own, names)


class SegmentationEvaluator:
    """Labels and metrics of an evaluation, and the results of all calls since the last ``clear``."""

    def __init__(self, metrics: Sequence[str | Metric] = M.SEGMENTATION_METRICS, labels: dict[str, Label] | None = None) -> None:
        self.metrics, self.labels = list(metrics), dict(labels or {})
        self.results: DataFrame | None = None

    def add_label(self, label: Label, description: str) -> None:
        self.labels[description] = label

    def evaluate(self, df: DataFrame, keys: Sequence[str] = ("subject",), spacing: Sequence[float] = (1.0, 1.0, 1.0)) -> DataFrame:
        """Results of these label maps; they are added to ``results``."""
        out = evaluate_segmentation(df, self.labels, self.metrics, keys, spacing)
        self.results = out if self.results is None else self.results.unionByName(out)
        return out

    def clear(self) -> None:
        self.results = None


def with_information(results: DataFrame, column: str, value: str) -> DataFrame:
    """A constant text beside each result."""
    return results.withColumn(column, F.lit(value))


def regression_sums(df: DataFrame, keys: Sequence[str] = ("subject",)) -> DataFrame:
    diff = F.col("ref") - F.col("pred")
    return df.groupBy(*keys).agg(F.count("*").cast("double").alias("n"), F.sum(F.abs(diff)).alias("s_abs"), F.sum(diff * diff).alias("s_sq"), F.max("ref").alias("hi"), F.min("ref").alias("lo"), F.var_samp("ref").alias("var"))


def evaluate_continuous(df: DataFrame, metrics: Sequence[str] = ("MAE", "MSE", "RMSE", "NRMSE", "R2", "PSNR"), keys: Sequence[str] = ("subject",)) -> DataFrame:
    return regression_sums(df, keys).select(*keys, *[F.expr(M.CONTINUOUS[m]).cast("double").alias(m) for m in metrics])


def area(df: DataFrame, side: str, slice_number: int = -1, spacing: Sequence[float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """Area of a mask in a slice, the middle one if none is named."""
    where = F.expr("CAST(n_z DIV 2 AS INT)") if slice_number < 0 else F.lit(slice_number)
    depth = df.groupBy("subject").agg((F.max("z") + 1).alias("n_z"), *[F.sum(F.when(F.col("z") == z, F.col(side)).otherwise(0)).alias("s") for z in [slice_number] if slice_number >= 0])
    if slice_number >= 0:
        total = depth.select("subject", F.col("s"))
    else:
        by_slice = df.groupBy("subject", "z").agg(F.sum(side).alias("s"))
        total = by_slice.join(depth.select("subject", where.alias("middle")), "subject").where("z = middle").select("subject", "s")
    return total.select("subject", (F.col("s") * spacing[1] * spacing[2]).cast("double").alias("value"))


def mahalanobis(df: DataFrame, keys: Sequence[str] = ("subject",)) -> DataFrame:
    """Distance of the means of two masks under their pooled covariance, in voxels; empty: infinity, singular: NaN."""
    aggregates: list[Column] = []
    for side in ("pred", "ref"):
        inside = F.col(side) == 1
        aggregates.append(F.count_if(inside).cast("double").alias(f"n_{side}"))
        pick = {a: F.when(inside, F.col(a).cast("double")) for a in "xyz"}
        aggregates += [F.avg(pick[a]).alias(f"m_{side}_{a}") for a in "xyz"]
        aggregates += [F.covar_samp(pick[a], pick[b]).alias(f"c_{side}_{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")]
    sums = df.groupBy(*keys).agg(*aggregates)
    pooled = {ab: f"(n_pred*c_pred_{ab}+n_ref*c_ref_{ab})/(n_pred+n_ref)" for ab in ("xx", "xy", "xz", "yy", "yz", "zz")}
    sums = sums.select(*keys, "n_pred", "n_ref", *[F.expr(f"m_pred_{a}-m_ref_{a}").alias(f"d{a}") for a in "xyz"], *[F.expr(f"CASE WHEN n_pred+n_ref = 0 THEN 0D ELSE {e} END").alias(ab) for ab, e in pooled.items()])
    det = "(xx*(yy*zz-yz*yz)-xy*(xy*zz-yz*xz)+xz*(xy*yz-yy*xz))"
    form = "(dx*dx*(yy*zz-yz*yz)+dy*dy*(xx*zz-xz*xz)+dz*dz*(xx*yy-xy*xy)+2*dx*dy*(xz*yz-xy*zz)+2*dx*dz*(xy*yz-xz*yy)+2*dy*dz*(xy*xz-xx*yz))"
    value = f"CASE WHEN n_pred = 0 OR n_ref = 0 THEN {M.INF} WHEN abs({det}) < 1e-12 THEN {M.NAN} ELSE sqrt(abs({form}/{det})) END"
    return sums.select(*keys, F.expr(value).alias("MAHLNBS"))


def ssim(df: DataFrame, keys: Sequence[str] = ("subject", "z"), window: int = 7) -> DataFrame:
    """Structural similarity of 2-D images (y, x, pred, ref): mean over windows that lie inside; range: largest reference.

    Window sums are running sums over rows and columns, so no voxel is copied.
    """
    from pyspark.sql import Window as W

    r = window // 2
    sums = {"p": F.col("pred"), "g": F.col("ref"), "pp": F.col("pred") * F.col("pred"), "gg": F.col("ref") * F.col("ref"), "pg": F.col("pred") * F.col("ref")}
    along_x = W.partitionBy(*keys, "y").orderBy("x").rowsBetween(-r, r)
    along_y = W.partitionBy(*keys, "x").orderBy("y").rowsBetween(-r, r)
    whole = W.partitionBy(*keys)
    step = df.select(*keys, "y", "x", F.max("ref").over(whole).alias("hi"), *[F.sum(c).over(along_x).alias(n) for n, c in sums.items()], F.count("*").over(along_x).alias("k"))
    step = step.select(*keys, "y", "x", "hi", *[F.sum(n).over(along_y).alias(n) for n in sums], F.sum("k").over(along_y).alias("k"))
    inner = step.where(F.col("k") == window * window)
    n = float(window * window)
    mean = {a: f"({a}/{n})" for a in ("p", "g")}
    cov = {ab: f"(({ab}/{n}-{mean[ab[0]]}*{mean[ab[1]]})*{n}/{n - 1})" for ab in ("pp", "gg", "pg")}
    c1, c2 = "pow(0.01*hi,2)", "pow(0.03*hi,2)"
    top = f"(2*{mean['p']}*{mean['g']}+{c1})*(2*{cov['pg']}+{c2})"
    bottom = f"(({mean['p']}*{mean['p']}+{mean['g']}*{mean['g']}+{c1})*({cov['pp']}+{cov['gg']}+{c2}))"
    return inner.groupBy(*keys).agg(F.avg(F.expr(f"CASE WHEN {bottom} = 0 THEN 1.0 ELSE {top}/{bottom} END")).alias("SSIM"))
