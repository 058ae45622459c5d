"""Queries of the image operators over the driver tables, and the same in SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import indexing as U
from .functions import metrics as M
from .operators import assemble as A
from .operators import dataset as D
from .operators import evaluate as E
from .operators import extract as X
from .operators import filters as L
from .operators import report as P
from .operators import surface as S
from .operators import transform as T
from .plans import fixtures as V
from .plans.fixtures import with_views
from .sources import images as I

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def r6(c: str | Column) -> Column:
    return (F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)).cast("double")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[r6(c).alias(c) if c in columns else F.col(c) for c in df.columns])


VOX = "subject, z, y, x"


def vox(body: str, *more: str) -> str:
    return with_views("voxels", body, *more)


# Metrics of counts, areas and volumes.

COUNTS = """c AS (SELECT subject, CAST(count(*) FILTER (WHERE pred = 1 AND ref = 1) AS DOUBLE) tp, CAST(count(*) FILTER (WHERE pred = 0 AND ref = 0) AS DOUBLE) tn,
    CAST(count(*) FILTER (WHERE pred = 1 AND ref = 0) AS DOUBLE) fp, CAST(count(*) FILTER (WHERE pred = 0 AND ref = 1) AS DOUBLE) fn, CAST(count(*) AS DOUBLE) n FROM {} GROUP BY subject)"""


def _of_cells(form: str) -> str:
    """A sum over the four cells of the table: v is a cell's count, p and r are its sums in prediction and reference."""
    cells = {"tp": ("(tp+fp)", "(tp+fn)"), "tn": ("(tn+fn)", "(tn+fp)"), "fp": ("(tp+fp)", "(tn+fp)"), "fn": ("(tn+fn)", "(tp+fn)")}
    return "(" + "+".join(f"coalesce({form.format(v=v, p=p, r=r)}, 0)" for v, (p, r) in cells.items()) + ")"


_C2 = "(({0})*(({0})-1)/2)"
_TOGETHER, _IN_P, _IN_R, _ALL = _of_cells(_C2.replace("{0}", "{v}")), f"({_C2.format('tp+fp')}+{_C2.format('tn+fn')})", f"({_C2.format('tp+fn')}+{_C2.format('tn+fp')})", _C2.format("n")
_MIXED = "(tp+fn > 0 AND tn+fp > 0 AND tp+fp > 0 AND tn+fn > 0)"
_MEAN = "((2*tp+fp+fn)/(2*n))"
_BETWEEN = f"(2*(tp*pow(1-{_MEAN}, 2)+tn*pow({_MEAN}, 2)+(fp+fn)*pow(0.5-{_MEAN}, 2))/(n-1))"
_AGREE = "(((tp+fp)*(tp+fn)+(tn+fn)*(tn+fp))/(n*n))"
#: The definitions of the metrics, written for the SQL alone: the library's own expressions are held against them.
COUNT_SQL = {
    "DICE": "coalesce(2*tp/nullif((tp+fp)+(tp+fn), 0), 1)",
    "JACRD": "coalesce(tp/nullif(n-tn, 0), 1)",
    "ADJRIND": f"coalesce(({_TOGETHER}-{_IN_P}*{_IN_R}/nullif({_ALL}, 0))/nullif(({_IN_P}+{_IN_R})/2-{_IN_P}*{_IN_R}/nullif({_ALL}, 0), 0), 0)",
    "AUC": "CASE WHEN tp+fn = 0 THEN '-inf' WHEN tn+fp = 0 THEN 'nan' ELSE (tp/(tp+fn)+tn/(tn+fp))/2 END",
    "KAPPA": f"coalesce(((tp+tn)/n-{_AGREE})/nullif(1-{_AGREE}, 0), '-inf')",
    "RNDIND": f"coalesce(({_ALL}+2*{_TOGETHER}-{_IN_P}-{_IN_R})/nullif({_ALL}, 0), 'nan')",
    "VOLSMTY": "coalesce(1-abs((tp+fp)-(tp+fn))/nullif((tp+fp)+(tp+fn), 0), '-inf')",
    "MUTINF": f"CASE WHEN {_MIXED} THEN {_of_cells('{v}/n*log2(nullif({v}*n/({p}*{r}), 0))')} ELSE '-inf' END",
    "ACURCY": "coalesce(1-(fp+fn)/nullif(n, 0), 0)",
    "FALLOUT": "coalesce(fp/nullif(fp+tn, 0), 'nan')",
    "FNR": "coalesce(fn/nullif(fn+tp, 0), 'nan')",
    "FMEASR": "CASE WHEN tp+fn = 0 THEN 'nan' WHEN tp = 0 THEN 0 ELSE 2/((tp+fp)/tp+(tp+fn)/tp) END",
    "PRCISON": "coalesce(tp/nullif(tp+fp, 0), 0)",
    "SNSVTY": "coalesce(1-fn/nullif(tp+fn, 0), '-inf')",
    "SPCFTY": "coalesce(1-fp/nullif(tn+fp, 0), 'nan')",
    "TP": "tp",
    "TN": "tn",
    "FP": "fp",
    "FN": "fn",
    "GCOERR": f"CASE WHEN {_MIXED} THEN (fp+fn+least(tp*fn/(tp+fn)+tn*fp/(tn+fp), tp*fp/(tp+fp)+tn*fn/(tn+fn)))/n ELSE 'inf' END",
    "VARINFO": f"CASE WHEN {_MIXED} THEN -{_of_cells('{v}/n*log2(nullif({v}*{v}/({p}*{r}), 0))')} ELSE '-inf' END",
    "ICCORR": f"CASE WHEN n < 2 THEN 'nan' ELSE coalesce(({_BETWEEN}-(fp+fn)/(2*n))/nullif({_BETWEEN}+(fp+fn)/(2*n), 0), '-inf') END",
    "PROBDST": "coalesce((fp+fn)/nullif(2*tp, 0), -1)",
}


def _count_metric(name: str) -> None:
    @query(f"metric_{name.lower()}", with_views("masks", f"SELECT subject, round(CAST({COUNT_SQL[name]} AS DOUBLE), 6) + 0.0 AS value FROM c", COUNTS.format("masks")))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return E.evaluate_counts(V.masks(spark, sf_dir), [name]).select("subject", r6(name).alias("value"))


for _name in M.COUNT_METRICS:
    _count_metric(_name)


@query("confusion_matrix", with_views("multilabel", """SELECT subject, label, CAST(count(*) FILTER (WHERE p = 1 AND r = 1) AS DOUBLE) tp, CAST(count(*) FILTER (WHERE p = 0 AND r = 0) AS DOUBLE) tn,
    CAST(count(*) FILTER (WHERE p = 1 AND r = 0) AS DOUBLE) fp, CAST(count(*) FILTER (WHERE p = 0 AND r = 1) AS DOUBLE) fn, CAST(count(*) AS DOUBLE) n
    FROM (SELECT subject, 'one' label, CAST(pred = 1 AS INT) p, CAST(ref = 1 AS INT) r FROM multilabel UNION ALL SELECT subject, 'two', CAST(pred = 2 AS INT), CAST(ref = 2 AS INT) FROM multilabel) GROUP BY subject, label"""))
def confusion_matrix(spark, sf_dir):
    return E.confusion(E.label_masks(V.multilabel(spark, sf_dir), {"one": 1, "two": 2}), ["subject", "label"])


_MERGED = """c AS (SELECT subject, label, CAST(count(*) FILTER (WHERE p AND r) AS DOUBLE) tp, CAST(count(*) FILTER (WHERE NOT p AND NOT r) AS DOUBLE) tn, CAST(count(*) FILTER (WHERE p AND NOT r) AS DOUBLE) fp, CAST(count(*) FILTER (WHERE NOT p AND r) AS DOUBLE) fn, CAST(count(*) AS DOUBLE) n
    FROM (SELECT subject, 'two' label, pred = 2 p, ref = 2 r FROM multilabel UNION ALL SELECT subject, 'any', pred IN (1, 2), ref IN (1, 2) FROM multilabel) GROUP BY subject, label)"""


@query("eval_segmentation", with_views("masks", f"""SELECT subject, 'fg' label, 'DICE' metric, round(CAST({COUNT_SQL['DICE']} AS DOUBLE), 6) AS value FROM c UNION ALL
    SELECT subject, 'fg', 'SNSVTY', round(CAST({COUNT_SQL['SNSVTY']} AS DOUBLE), 6) FROM c""", COUNTS.format("masks")))
def eval_segmentation(spark, sf_dir):
    return rounded(E.evaluate_segmentation(V.masks(spark, sf_dir), {"fg": 1}, ["DICE", "SNSVTY"]), "value")


@query("eval_merged_labels", with_views("multilabel", f"SELECT subject, label, 'DICE' metric, round(CAST({COUNT_SQL['DICE']} AS DOUBLE), 6) AS value FROM c", _MERGED))
def eval_merged_labels(spark, sf_dir):
    return rounded(E.evaluate_segmentation(V.multilabel(spark, sf_dir), {"two": 2, "any": (1, 2)}, ["DICE"]), "value")


@query("eval_all_segmentation", with_views("binary", "SELECT subject, " + ", ".join(f'round(CAST({e} AS DOUBLE), 6) + 0.0 "{m}"' for m, e in COUNT_SQL.items()) + " FROM c", COUNTS.format("binaries")))
def eval_all_segmentation(spark, sf_dir):
    return rounded(E.evaluate_counts(V.binary(spark, sf_dir)), *M.COUNT_METRICS)


@query("metric_information", with_views("masks", f"SELECT subject, round(CAST({COUNT_SQL['DICE']} AS DOUBLE), 6) AS value, 'run-1' run FROM c", COUNTS.format("masks")))
def metric_information(spark, sf_dir):
    dice = E.evaluate_counts(V.masks(spark, sf_dir), ["DICE"]).select("subject", r6("DICE").alias("value"))
    return E.with_information(dice, "run", "run-1")


for _side, _column in (("PREDVOL", "pred"), ("REFVOL", "ref")):

    @query(f"metric_{_side.lower()}", with_views("masks", f"SELECT subject, CAST(sum({_column}) * 0.5 AS DOUBLE) AS value FROM masks GROUP BY subject"))
    def _volume(spark, sf_dir, side=_side):
        return E.confusion(V.masks(spark, sf_dir)).select("subject", F.expr(M.volume(side, 0.5)).cast("double").alias("value"))


for _side, _column in (("predarea", "pred"), ("refarea", "ref")):

    @query(f"metric_{_side}", with_views("blobs", f"SELECT subject, CAST(sum({_column}) AS DOUBLE) AS value FROM blobs WHERE z = 6 GROUP BY subject"))
    def _area(spark, sf_dir, column=_column):
        return E.area(V.blobs(spark, sf_dir), column)


_POOL = ", ".join(f"(np*covar_p_{k}+nr*covar_r_{k})/(np+nr) {k}" for k in ("xx", "xy", "xz", "yy", "yz", "zz"))
_COV = ", ".join(f"covar_samp({k[0]}, {k[1]}) FILTER (WHERE {c} = 1) covar_{c[0]}_{k}" for c in ("pred", "ref") for k in ("xx", "xy", "xz", "yy", "yz", "zz"))


@query("metric_mahlnbs", with_views("blobs", """SELECT subject, round(sqrt(abs((dx*dx*(yy*zz-yz*yz)+dy*dy*(xx*zz-xz*xz)+dz*dz*(xx*yy-xy*xy)+2*dx*dy*(xz*yz-xy*zz)+2*dx*dz*(xy*yz-xz*yy)+2*dy*dz*(xy*xz-xx*yz))
    / (xx*(yy*zz-yz*yz)-xy*(xy*zz-yz*xz)+xz*(xy*yz-yy*xz)))), 6) AS value FROM q""",
    f"""m AS (SELECT subject, count(*) FILTER (WHERE pred = 1) np, count(*) FILTER (WHERE ref = 1) nr, {_COV},
      avg(x) FILTER (WHERE pred = 1) - avg(x) FILTER (WHERE ref = 1) dx, avg(y) FILTER (WHERE pred = 1) - avg(y) FILTER (WHERE ref = 1) dy, avg(z) FILTER (WHERE pred = 1) - avg(z) FILTER (WHERE ref = 1) dz FROM blobs GROUP BY subject)""",
    f"q AS (SELECT subject, dx, dy, dz, {_POOL} FROM m)"))
def metric_mahlnbs(spark, sf_dir):
    return E.mahalanobis(V.blobs(spark, sf_dir)).select("subject", r6("MAHLNBS").alias("value"))


# Continuous metrics.

CONTINUOUS_SQL = {
    "MAE": "avg(abs(pred-ref))",
    "MSE": "avg(pow(pred-ref, 2))",
    "RMSE": "sqrt(avg(pow(pred-ref, 2)))",
    "NRMSE": "coalesce(sqrt(avg(pow(pred-ref, 2)))/nullif(max(ref)-min(ref), 0), 'nan')",
    "R2": "coalesce(1-avg(pow(pred-ref, 2))/nullif(var_pop(ref), 0), 'nan')",
    "PSNR": "CASE WHEN max(abs(pred-ref)) = 0 THEN 'inf' WHEN max(ref) = 0 THEN '-inf' ELSE 20*log10(abs(max(ref)))-10*log10(avg(pow(pred-ref, 2))) END",
}


def _continuous(name: str) -> None:
    @query(f"metric_{name.lower()}", with_views("regression", f"SELECT subject, round(CAST({CONTINUOUS_SQL[name]} AS DOUBLE), 6) AS value FROM regression GROUP BY subject"))
    def run(spark, sf_dir):
        return E.evaluate_continuous(V.regression(spark, sf_dir), [name]).select("subject", r6(name).alias("value"))


for _name in M.CONTINUOUS:
    _continuous(_name)


@query("metric_ssim", with_views("cubes", """SELECT subject, round(avg((2*mp*mg+pow(0.01*hi,2))*(2*cpg+pow(0.03*hi,2))/((mp*mp+mg*mg+pow(0.01*hi,2))*(cpp+cgg+pow(0.03*hi,2)))), 6) AS value FROM w GROUP BY subject""",
    "i AS (SELECT subject, z, y, x, value + 2 p, lead(value, 1, value) OVER (PARTITION BY subject, y, x ORDER BY z) + 2 g FROM cubes)",
    """w AS (SELECT a.subject, a.z, max(h.hi) hi, avg(b.p) mp, avg(b.g) mg, var_samp(b.p) cpp, var_samp(b.g) cgg, covar_samp(b.p, b.g) cpg
        FROM i a JOIN i b ON a.subject = b.subject AND a.z = b.z AND abs(a.y-b.y) <= 3 AND abs(a.x-b.x) <= 3 JOIN (SELECT subject, z, max(g) hi FROM i GROUP BY subject, z) h ON a.subject = h.subject AND a.z = h.z
        WHERE a.y BETWEEN 3 AND 4 AND a.x BETWEEN 3 AND 4 GROUP BY a.subject, a.z, a.y, a.x)"""))
def metric_ssim(spark, sf_dir):
    from pyspark.sql import Window

    after = F.lead("value").over(Window.partitionBy("subject", "y", "x").orderBy("z"))
    images = V.cubes(spark, sf_dir).select("subject", "z", "y", "x", (F.col("value") + 2).alias("pred"), (F.coalesce(after, "value") + 2).alias("ref"))
    return E.ssim(images).groupBy("subject").agg(r6(F.avg("SSIM")).alias("value"))


# Surface distances.

_AREAS = "[" + ",".join(repr(a) for a in S.areas()) + "]"


def _surface_sql(body: str) -> str:
    offsets = ", ".join(f"({1 - a}, {1 - b}, {1 - c}, {w})" for (a, b, c), w in S.WEIGHTS.items())
    corners = " UNION ALL ".join(f"SELECT subject, '{s}' side, z+dz z, y+dy y, x+dx x, sum(w) code FROM blobs, (VALUES {offsets}) o(dz, dy, dx, w) WHERE {s} = 1 GROUP BY 1, 2, 3, 4, 5" for s in ("pred", "ref"))
    surfels = f"surfels AS (SELECT subject, side, z, y, x, CAST(code AS INTEGER) code, CAST({_AREAS}[CAST(code AS INTEGER) + 1] AS DOUBLE) area FROM ({corners}) WHERE code <> 255)"
    near = "d AS (SELECT a.subject, a.side, a.z, a.y, a.x, a.area, sqrt(min((a.z-b.z)*(a.z-b.z)+(a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x))) d FROM surfels a JOIN surfels b ON a.subject = b.subject AND a.side <> b.side GROUP BY ALL)"
    return with_views("blobs", body, surfels, near)


def _distances(spark, sf_dir):
    return S.surface_distances(V.blobs(spark, sf_dir))


@query("surface_elements", _surface_sql("SELECT subject, z, y, x, code, round(area, 6) area FROM surfels WHERE side = 'pred'"))
def surface_elements(spark, sf_dir):
    return rounded(S.surface_elements(V.blobs(spark, sf_dir), "pred"), "area")


@query("surface_distances", _surface_sql("SELECT subject, side, count(*) n, round(sum(d), 6) AS total, round(max(d), 6) AS largest FROM d GROUP BY subject, side"))
def surface_distances(spark, sf_dir):
    return _distances(spark, sf_dir).groupBy("subject", "side").agg(F.count("*").alias("n"), r6(F.sum("d")).alias("total"), r6(F.max("d")).alias("largest"))


@query("metric_hdrfdst", _surface_sql("""SELECT subject, round(max(v), 6) AS value FROM (SELECT subject, side, coalesce(min(d) FILTER (WHERE share >= 0.95), max(d)) v
    FROM (SELECT subject, side, d, sum(area) OVER (PARTITION BY subject, side ORDER BY d, area ROWS UNBOUNDED PRECEDING) / sum(area) OVER (PARTITION BY subject, side) share FROM d) GROUP BY subject, side) GROUP BY subject"""))
def metric_hdrfdst(spark, sf_dir):
    return S.hausdorff(_distances(spark, sf_dir), V.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("subject")), 95).select("subject", r6("HDRFDST").alias("value"))


@query("metric_surfdice", _surface_sql("SELECT subject, round(sum(area) FILTER (WHERE d <= 1) / sum(area), 6) AS value FROM d GROUP BY subject"))
def metric_surfdice(spark, sf_dir):
    return S.surface_dice(_distances(spark, sf_dir), V.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("subject"))).select("subject", r6("SURFDICE").alias("value"))


@query("metric_surfovlp", _surface_sql("SELECT subject, round(sum(area) FILTER (WHERE d <= 1) / sum(area), 6) AS value FROM d WHERE side = 'pred' GROUP BY subject"))
def metric_surfovlp(spark, sf_dir):
    return S.surface_overlap(_distances(spark, sf_dir), V.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("subject"))).select("subject", r6("SURFOVLP").alias("value"))


@query("metric_avgdist", with_views("blobs", """SELECT subject, round(avg(m), 6) AS value FROM (SELECT subject, side, avg(d) m FROM
    (SELECT a.subject, a.side, a.z, a.y, a.x, sqrt(min((a.z-b.z)*(a.z-b.z)+(a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x))) d FROM v a JOIN v b ON a.subject = b.subject AND a.side <> b.side GROUP BY ALL) GROUP BY subject, side) GROUP BY subject""",
    "v AS (SELECT subject, 'pred' side, z, y, x FROM blobs WHERE pred = 1 UNION ALL SELECT subject, 'ref', z, y, x FROM blobs WHERE ref = 1)"))
def metric_avgdist(spark, sf_dir):
    return S.average_distance(V.blobs(spark, sf_dir)).select("subject", r6("AVGDIST").alias("value"))


def _every_sql() -> str:
    """The 30 metrics of the evaluator on blobs: counts, and the tables that the single queries have in their SQL."""
    wide = {m: COUNT_SQL[m] for m in M.SEGMENTATION_METRICS if m in COUNT_SQL} | {"PREDVOL": "tp+fp", "REFVOL": "tp+fn"}
    tables = {"HDRFDST": "metric_hdrfdst_100", "SURFDICE": "metric_surfdice", "SURFOVLP": "metric_surfovlp", "AVGDIST": "metric_avgdist", "MAHLNBS": "metric_mahlnbs"}
    parts = [f"(SELECT subject, '{m}' metric, round(CAST({e} AS DOUBLE), 6) + 0.0 AS value FROM c)" for m, e in wide.items()]
    for m, name in tables.items():
        body = SQL["metric_hdrfdst"].replace("share >= 0.95", "share >= 1") if m == "HDRFDST" else SQL[name]
        parts.append(f"(SELECT subject, '{m}' metric, value + 0.0 AS value FROM ({body}))")
    return with_views("blobs", "SELECT subject, 'fg' AS label, metric, value FROM (" + " UNION ALL ".join(parts) + ")", COUNTS.format("blobs"))


@query("eval_every_metric", _every_sql())
def eval_every_metric(spark, sf_dir):
    evaluator = E.SegmentationEvaluator(M.SEGMENTATION_METRICS)
    evaluator.add_label(1, "fg")
    return rounded(evaluator.evaluate(V.blobs(spark, sf_dir)), "value")


@query("eval_user_metric", with_views("masks", "SELECT subject, 'fg' AS label, 'MISSED' metric, round(CAST((fp+fn)/n AS DOUBLE), 6) AS value FROM c", COUNTS.format("masks")))
def eval_user_metric(spark, sf_dir):
    return rounded(E.evaluate_segmentation(V.masks(spark, sf_dir), {"fg": 1}, [E.Metric("MISSED", "(fp + fn) / n")]), "value")


# Indexing, datasource, extraction, selection.

_SHAPE = "shape AS (SELECT subject, CAST(max(z)+1 AS INTEGER) nz, CAST(max(y)+1 AS INTEGER) ny, CAST(max(x)+1 AS INTEGER) nx FROM voxels GROUP BY subject)"
_NUM = "CAST(row_number() OVER (ORDER BY subject, axis, z0, y0, x0) - 1 AS BIGINT) sample_index"
_SLICE_NUMBERS = "s AS (SELECT subject, z, CAST(row_number() OVER (ORDER BY subject, z) - 1 AS BIGINT) sample_index FROM (SELECT DISTINCT subject, z FROM voxels))"
_COLS = "subject, CAST(z0 AS INTEGER) z0, CAST(z1 AS INTEGER) z1, CAST(y0 AS INTEGER) y0, CAST(y1 AS INTEGER) y1, CAST(x0 AS INTEGER) x0, CAST(x1 AS INTEGER) x1"


def _samples_sql(inner: str) -> str:
    return vox(f"SELECT {_COLS}, {_NUM} FROM ({inner})", _SHAPE)


_SLICES = "SELECT subject, 0 axis, range z0, range+1 z1, 0 y0, ny y1, 0 x0, nx x1 FROM (SELECT *, unnest(range(nz)) AS range FROM shape)"
_PATCHES = "SELECT subject, 0 axis, a*4 z0, a*4+4 z1, b*4 y0, b*4+4 y1, c*4 x0, c*4+4 x1 FROM (SELECT *, unnest(range(ny // 4)) b FROM (SELECT *, unnest(range(nz // 4)) a FROM shape)), range(2) t(c)"


def _source(spark, sf_dir, indexing: X.Indexing | None = None) -> X.Datasource:
    return X.Datasource(V.voxels(spark, sf_dir), indexing or X.EmptyIndexing())


def _indexing(name: str, indexing: X.Indexing, sql: str) -> None:
    @query(name, _samples_sql(sql))
    def run(spark, sf_dir):
        return _source(spark, sf_dir, indexing).samples()


_indexing("idx_empty", X.EmptyIndexing(), "SELECT subject, 0 axis, 0 z0, nz z1, 0 y0, ny y1, 0 x0, nx x1 FROM shape")
_indexing("idx_slice", X.SliceIndexing((0,)), _SLICES)
_indexing("idx_slice_multi", X.SliceIndexing((0, 2)), _SLICES + " UNION ALL SELECT subject, 1, 0, nz, 0, ny, range, range+1 FROM (SELECT *, unnest(range(nx)) AS range FROM shape)")
_indexing("idx_voxel", X.VoxelIndexing(), "SELECT subject, 0 axis, z z0, z+1 z1, y y0, y+1 y1, x x0, x+1 x1 FROM voxels")
_indexing("idx_patch_complete", X.PatchIndexing((4, 4, 4)), _PATCHES)
_indexing("idx_patch_incomplete", X.PatchIndexing((3, 3, 3), False), "SELECT subject, 0 axis, a*3 z0, a*3+3 z1, b*3 y0, b*3+3 y1, c*3 x0, c*3+3 x1 FROM (SELECT *, unnest(range((nz+2)//3)) a FROM shape), range(3) t(b), range(3) u(c)")


@query("index_expression", vox("SELECT subject, y, x, value FROM voxels WHERE z = 3 AND y >= 2 AND y < 5"))
def index_expression(spark, sf_dir):
    return X.extract(V.voxels(spark, sf_dir), X.index_bounds([3, (2, 5)], [0, 1]))


@query("datasource_items", vox("SELECT s.sample_index, v.subject, 0 z, v.y, v.x, v.value FROM voxels v JOIN s ON v.subject = s.subject AND v.z = s.z", _SLICE_NUMBERS))
def datasource_items(spark, sf_dir):
    return _source(spark, sf_dir, X.SliceIndexing((0,))).items()


@query("datasource_subset", vox(f"SELECT {_COLS}, {_NUM} FROM ({_SLICES} WHERE subject IN (2, 5))", _SHAPE))
def datasource_subset(spark, sf_dir):
    return _source(spark, sf_dir).with_indexing(X.SliceIndexing((0,)), [2, 5]).samples()


@query("datasource_len", vox("SELECT count(*) n FROM (SELECT DISTINCT subject, z FROM voxels)"))
def datasource_len(spark, sf_dir):
    return _source(spark, sf_dir, X.SliceIndexing((0,))).samples().agg(F.count("*").alias("n"))


@query("direct_extract", vox("SELECT subject, z, y, x, value FROM voxels WHERE subject = 4 AND z >= 1 AND z < 6"))
def direct_extract(spark, sf_dir):
    return _source(spark, sf_dir).direct_extract(4, X.index_bounds((1, 6), 0))


@query("ext_data_slice", vox("SELECT subject, y, x, value FROM voxels WHERE z = 2"))
def ext_data_slice(spark, sf_dir):
    return X.extract(V.voxels(spark, sf_dir), X.index_bounds(2, 0))


@query("ext_data_patch", vox("SELECT v.subject, CAST(z//4 AS INTEGER) pz, CAST(y//4 AS INTEGER) py, CAST(x//4 AS INTEGER) px, CAST(z%4 AS INTEGER) z, CAST(y%4 AS INTEGER) y, CAST(x%4 AS INTEGER) x, value FROM voxels v JOIN shape s ON v.subject = s.subject WHERE z < nz//4*4", _SHAPE))
def ext_data_patch(spark, sf_dir):
    return X.patch_items(V.voxels(spark, sf_dir), (4, 4, 4))


@query("ext_data_full", vox("SELECT subject, count(*) n, round(sum(value), 6) AS total FROM voxels GROUP BY subject"))
def ext_data_full(spark, sf_dir):
    return V.voxels(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("n"), r6(F.sum("value")).alias("total"))


@query("ext_pad_zero", with_views("cubes", """SELECT g.subject, CAST(pz AS INTEGER) pz, CAST(py AS INTEGER) py, CAST(px AS INTEGER) px, CAST(z AS INTEGER) z, CAST(y AS INTEGER) y, CAST(x AS INTEGER) x, coalesce(value, 0.0) AS value
    FROM (SELECT subject, a.range pz, b.range py, c.range px, d.range z, e.range y, f.range x FROM (SELECT subject, max(z) + 1 nz FROM cubes GROUP BY subject) JOIN range(2) a ON a.range < nz // 4, range(2) b, range(2) c, range(6) d, range(6) e, range(6) f) g
    LEFT JOIN (SELECT subject s, z vz, y vy, x vx, value FROM cubes) ON s = subject AND vz = pz*4+z-1 AND vy = py*4+y-1 AND vx = px*4+x-1"""))
def ext_pad_zero(spark, sf_dir):
    return X.padded_items(V.cubes(spark, sf_dir), (4, 4, 4), (1, 1, 1))


_TWO = "two AS (SELECT subject, z, y, x, 'T1' entry, value FROM voxels UNION ALL SELECT subject, z, y, x, 'T2', value * 2 FROM voxels)"


@query("ext_selective", vox("SELECT subject, z, y, x, entry, value, CASE entry WHEN 'T2' THEN 0 ELSE 1 END AS channel FROM two", _TWO))
def ext_selective(spark, sf_dir):
    return X.selective(X.two_channels(V.voxels(spark, sf_dir)), ["T2", "T1"])


def _hash_sql(seed: int, key: str) -> str:
    return f"CAST(('0x' || substr(md5('{seed}:' || {key}), 1, 8))::UBIGINT AS BIGINT)"


@query("ext_random", vox(f"SELECT * FROM two WHERE entry = CASE {_hash_sql(7, 'subject')} % 2 WHEN 0 THEN 'T1' ELSE 'T2' END", _TWO))
def ext_random(spark, sf_dir):
    return X.random_entry(X.two_channels(V.voxels(spark, sf_dir)), ["T1", "T2"], 7).select("subject", "z", "y", "x", "entry", "value")


@query("ext_names", vox("SELECT sample_index, subject, 'T1,T2' AS names FROM s", _SLICE_NUMBERS))
def ext_names(spark, sf_dir):
    listed = create_names(spark, sf_dir)
    out = _source(spark, sf_dir, X.SliceIndexing((0,))).with_extractor(X.extract_names(listed)).items()
    return out.select("sample_index", "subject", F.array_join("images", ",").alias("names"))


@query("ext_datasource", vox("SELECT s.sample_index, v.subject, v.y, v.x, v.value, 'T1,T2' AS names, n.nz FROM voxels v JOIN s ON v.subject = s.subject AND v.z = s.z JOIN shape n ON n.subject = v.subject", _SLICE_NUMBERS, _SHAPE))
def ext_datasource(spark, sf_dir):
    """Voxels, names and shapes of samples by one composed extractor."""
    v = V.voxels(spark, sf_dir)
    parts = X.compose_extractors(X.extract_data, X.extract_names(create_names(spark, sf_dir)), X.extract_table(X.shapes(v).select("subject", "nz")))
    out = _source(spark, sf_dir, X.SliceIndexing((0,))).with_extractor(parts).items()
    return out.select("sample_index", "subject", "y", "x", "value", F.array_join("images", ",").alias("names"), "nz")


@query("datasource_patches", vox(f"SELECT s.sample_index, v.subject, CAST(v.z - z0 AS INTEGER) z, CAST(v.y - y0 AS INTEGER) y, CAST(v.x - x0 AS INTEGER) x, value FROM voxels v JOIN s ON v.subject = s.subject AND v.z >= z0 AND v.z < z1 AND v.y >= y0 AND v.y < y1 AND v.x >= x0 AND v.x < x1", _SHAPE,
    f"s AS (SELECT {_COLS}, {_NUM} FROM (SELECT subject, 0 axis, a*3 z0, a*3+3 z1, b*3 y0, b*3+3 y1, c*3 x0, c*3+3 x1 FROM (SELECT *, unnest(range((nz+2)//3)) a FROM shape), range(3) t(b), range(3) u(c)))"))
def datasource_patches(spark, sf_dir):
    return _source(spark, sf_dir, X.PatchIndexing((3, 3, 3), False)).items()


@query("datasource_item", vox("SELECT s.sample_index, v.subject, 0 z, v.y, v.x, v.value FROM voxels v JOIN s ON v.subject = s.subject AND v.z = s.z WHERE s.sample_index = 7", _SLICE_NUMBERS))
def datasource_item(spark, sf_dir):
    return _source(spark, sf_dir, X.SliceIndexing((0,))).item(7)


@query("ext_pad_sides", with_views("cubes", """SELECT g.subject, CAST(pz AS INTEGER) pz, CAST(py AS INTEGER) py, CAST(px AS INTEGER) px, CAST(z AS INTEGER) z, CAST(y AS INTEGER) y, CAST(x AS INTEGER) x, value
    FROM (SELECT subject, nz, a.range pz, b.range py, c.range px, d.range z, e.range y, f.range x FROM (SELECT subject, max(z) + 1 nz FROM cubes GROUP BY subject) JOIN range(3) a ON a.range < (nz + 2) // 3, range(2) b, range(1) c, range(4) d, range(7) e, range(8) f) g
    JOIN (SELECT subject s, z vz, y vy, x vx, value FROM cubes) ON s = subject AND vz = greatest(0, least(nz - 1, pz*3+z-1)) AND vy = greatest(0, least(7, py*5+y)) AND vx = x"""))
def ext_pad_sides(spark, sf_dir):
    """Other paddings on each side, the edge repeated, incomplete patches kept."""
    return X.padded_items(V.cubes(spark, sf_dir), (3, 5, 8), ((1, 0), (0, 2), (0, 0)), pad=X.pad_edge, ignore_incomplete=False)


@query("ext_subject", vox("SELECT DISTINCT subject, 'subject-' || subject AS name FROM voxels"))
def ext_subject(spark, sf_dir):
    return _source(spark, sf_dir).subjects().select("subject", F.concat(F.lit("subject-"), F.col("subject").cast("string")).alias("name"))


QUERIES["scan_subjects"], SQL["scan_subjects"] = ext_subject, SQL["ext_subject"]


@query("ext_indexing", _samples_sql(_SLICES))
def ext_indexing(spark, sf_dir):
    return _source(spark, sf_dir, X.SliceIndexing((0,))).samples()


@query("ext_image_properties", vox("SELECT subject, array_to_string([nx, ny, nz], ',') size, '1,1,1' spacing FROM shape", _SHAPE))
def ext_image_properties(spark, sf_dir):
    text = lambda c, kind: F.array_join(F.transform(c, lambda x: x.cast(kind).cast("string")), ",")
    return D.image_properties(V.voxels(spark, sf_dir)).select("subject", text("size", "int").alias("size"), text("spacing", "int").alias("spacing"))


QUERIES["create_image_props"], SQL["create_image_props"] = ext_image_properties, SQL["ext_image_properties"]


@query("ext_shape", vox("SELECT subject, nz, ny, nx FROM shape", _SHAPE))
def ext_shape(spark, sf_dir):
    return X.shapes(V.voxels(spark, sf_dir))


QUERIES["scan_shape"], SQL["scan_shape"] = ext_shape, SQL["ext_shape"]


@query("ext_compose", vox("SELECT subject, 'subject-' || subject AS name, nz, ny, nx FROM shape", _SHAPE))
def ext_compose(spark, sf_dir):
    return ext_subject(spark, sf_dir).join(ext_shape(spark, sf_dir), "subject")


def _select(name: str, selection: X.Selection, having: str) -> None:
    keys = "subject, z"

    @query(name, with_views("masks", f"SELECT {keys} FROM masks GROUP BY {keys} HAVING {having}"))
    def run(spark, sf_dir):
        return selection.select(V.masks(spark, sf_dir), ["subject", "z"])


_select("sel_non_constant", X.NonConstant("ref"), "min(ref) <> max(ref)")
_select("sel_non_black", X.NonBlack(0.3), "max(value) > 0.3")
_select("sel_with_foreground", X.WithForeground("ref"), "max(ref) <> 0")
_select("sel_subject", X.OfSubjects([1, 3]), "min(subject) IN (1, 3)")
_select("sel_compose", X.Compose([X.NonBlack(0.3), X.OfSubjects([1, 3, 5])]), "max(value) > 0.3 AND min(subject) IN (1, 3, 5)")
_select("sel_percentile", X.Percentile(45.0, "ref"), "min(ref) >= quantile_cont(ref, 0.45)")


@query("sel_non_constant_axis", with_views("masks", "SELECT DISTINCT subject, z FROM (SELECT subject, z, y FROM masks GROUP BY subject, z, y HAVING min(ref) <> max(ref))"))
def sel_non_constant_axis(spark, sf_dir):
    return X.NonConstantAlong(1, "ref").select(V.masks(spark, sf_dir), ["subject", "z"])


@query("select_indices", vox("SELECT sample_index FROM s WHERE hi > 0.3", "s AS (SELECT CAST(row_number() OVER (ORDER BY subject, z) - 1 AS BIGINT) sample_index, hi FROM (SELECT subject, z, max(value) hi FROM voxels GROUP BY subject, z))"))
def select_indices(spark, sf_dir):
    return X.select_indices(_source(spark, sf_dir, X.SliceIndexing((0,))), X.NonBlack(0.3))


@query("backend_generator", SQL["datasource_items"])
def backend_generator(spark, sf_dir):
    return datasource_items(spark, sf_dir)


@query("backend_items", vox("SELECT subject, z, round(sum(value), 6) AS total FROM voxels GROUP BY subject, z"))
def backend_items(spark, sf_dir):
    return V.voxels(spark, sf_dir).groupBy("subject", "z").agg(r6(F.sum("value")).alias("total"))


@query("backend_subset_sequential", vox("SELECT p.pos, s.* FROM s JOIN (VALUES (0, 5), (1, 0), (2, 17)) p(pos, i) ON s.sample_index = p.i", "s AS (SELECT CAST(row_number() OVER (ORDER BY subject, z) - 1 AS BIGINT) sample_index, subject, z z0 FROM (SELECT DISTINCT subject, z FROM voxels))"))
def backend_subset_sequential(spark, sf_dir):
    listed = spark.range(1).select(F.posexplode(F.array(*[F.lit(i).cast("long") for i in (5, 0, 17)])).alias("pos", "sample_index"))
    return _source(spark, sf_dir, X.SliceIndexing((0,))).samples().join(listed, "sample_index").select("pos", "sample_index", "subject", "z0")


# Transforms and augmentation.


def _transform(name: str, transform: T.Transform, sql: str, *more: str, view: str = "voxels", round_value: bool = False) -> None:
    @query(name, with_views(view, sql, *more))
    def run(spark, sf_dir):
        df = {"voxels": V.voxels, "cubes": V.cubes}[view](spark, sf_dir).select("subject", "z", "y", "x", "value")
        out = transform(df)
        return rounded(out, "value") if round_value else out


_ST = "st AS (SELECT *, min(value) OVER p lo, max(value) OVER p hi, avg(value) OVER p m, stddev_pop(value) OVER p s FROM voxels WINDOW p AS (PARTITION BY subject{}))"
_transform("tfm_intensity_rescale", T.intensity_rescale(0, 255), f"SELECT {VOX}, round((value-lo)/(hi-lo)*255, 6) AS value FROM st", _ST.format(""), round_value=True)
_transform("tfm_intensity_rescale_channel", T.intensity_rescale(0, 1, ("subject", "z")), f"SELECT {VOX}, round((value-lo)/(hi-lo), 6) AS value FROM st", _ST.format(", z"), round_value=True)
_transform("tfm_intensity_norm", T.intensity_normalization(), f"SELECT {VOX}, round((value-m)/s, 6) + 0.0 AS value FROM st", _ST.format(""), round_value=True)
_transform("tfm_intensity_norm_channel", T.intensity_normalization(("subject", "z")), f"SELECT {VOX}, round((value-m)/s, 6) + 0.0 AS value FROM st", _ST.format(", z"), round_value=True)
_transform("tfm_lambda", T.value_transform(lambda v: v * v), f"SELECT {VOX}, round(value*value, 6) AS value FROM voxels", round_value=True)
_transform("tfm_compose", T.compose(T.intensity_rescale(0, 1), T.value_transform(lambda v: v + 1)), f"SELECT {VOX}, round((value-lo)/(hi-lo)+1, 6) AS value FROM st", _ST.format(""), round_value=True)
_transform("tfm_clip_percentile", T.clip_percentile(95), f"SELECT {VOX}, round(greatest(a.value, c), 6) + 0.0 AS value FROM a JOIN b USING (subject)",
           "a AS (SELECT subject, z, y, x, least(value, q) AS value FROM voxels JOIN (SELECT subject, quantile_cont(value, 0.95) q FROM voxels GROUP BY subject) USING (subject))", "b AS (SELECT subject, quantile_cont(value, 0.05) c FROM a GROUP BY subject)", round_value=True)
_transform("tfm_reshape", T.reshape((8, 8, 8), (4, 16, -1)), "SELECT subject, CAST(f//128 AS INTEGER) z, CAST(f//8%16 AS INTEGER) y, CAST(f%8 AS INTEGER) x, value FROM (SELECT *, z*64+y*8+x f FROM cubes)", view="cubes")
_transform("tfm_permute", T.permute((2, 0, 1)), "SELECT subject, x z, z y, y x, value FROM voxels")
_transform("tfm_squeeze", T.compose(lambda df: df.where("z = 0"), T.squeeze(0)), "SELECT subject, y, x, value FROM voxels WHERE z = 0")
_transform("tfm_unsqueeze", T.unsqueeze(), f"SELECT {VOX}, value, 0 channel FROM voxels")
_transform("tfm_size_crop", T.size_correction((None, 5, 4)), f"SELECT subject, z, CAST(y-1 AS INTEGER) y, CAST(x-2 AS INTEGER) x, value FROM voxels WHERE y BETWEEN 1 AND 5 AND x BETWEEN 2 AND 5")
_transform("tfm_size_pad", T.size_correction((None, 9, 11), -1.0), """SELECT g.subject, g.z, CAST(b.range AS INTEGER) y, CAST(c.range AS INTEGER) x, coalesce(v.value, -1.0) AS value FROM (SELECT DISTINCT subject, z FROM voxels) g, range(9) b, range(11) c
    LEFT JOIN voxels v ON v.subject = g.subject AND v.z = g.z AND v.y = b.range AND v.x = c.range - 1""")
_transform("tfm_random_crop", T.random_crop({"y": 5, "x": 3}, 11), f"""SELECT subject, z, CAST(y-dy AS INTEGER) y, CAST(x-dx AS INTEGER) x, value FROM (SELECT *, {_hash_sql(11, 'subject')} % 4 dy, {_hash_sql(12, 'subject')} % 6 dx FROM voxels)
    WHERE y-dy BETWEEN 0 AND 4 AND x-dx BETWEEN 0 AND 2""")
_transform("aug_random_crop", T.random_crop({"y": 5, "x": 3}, 21, False), f"""SELECT subject, z, CAST(y-dy AS INTEGER) y, CAST(x-dx AS INTEGER) x, value FROM (SELECT *, {_hash_sql(21, 'subject')} % 3 dy, {_hash_sql(22, 'subject')} % 5 dx FROM voxels)
    WHERE y-dy BETWEEN 0 AND 4 AND x-dx BETWEEN 0 AND 2""")
_transform("aug_mirror", T.random_mirror(1, 3, 0.5), f"SELECT subject, z, CAST(CASE WHEN {_hash_sql(1003, 'subject')} < 2147483648 THEN 7-y ELSE y END AS INTEGER) y, x, value FROM voxels")
_transform("aug_rot90", T.random_rotation90((1, 2), 5), f"""SELECT subject, z, CAST(CASE k WHEN 1 THEN 7-x WHEN 2 THEN 7-y ELSE x END AS INTEGER) y, CAST(CASE k WHEN 1 THEN y WHEN 2 THEN 7-x ELSE 7-y END AS INTEGER) x, value
    FROM (SELECT *, {_hash_sql(5, 'subject')} % 3 + 1 k FROM voxels)""")
_transform("aug_shift", T.random_shift(2, 9, 3), f"SELECT subject, z, y, CAST((x + {_hash_sql(9, 'subject')} % 6 - 3 + 8) % 8 AS INTEGER) x, value FROM voxels")


@query("tfm_relabel", "SELECT l_orderkey, l_linenumber, CAST(CASE l_linenumber WHEN 5 THEN 7 WHEN 3 THEN 7 ELSE l_linenumber END AS INTEGER) AS value FROM lineitem")
def tfm_relabel(spark, sf_dir):
    df = V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("value"))
    return T.relabel_chain({3: 5, 7: 3})(df)


@query("tfm_mask", with_views("masks", f"SELECT {VOX}, CASE WHEN ref = 0 THEN -9.0 ELSE value END AS value FROM masks"))
def tfm_mask(spark, sf_dir):
    m = V.masks(spark, sf_dir)
    return T.mask(m, "ref", 0, -9.0)(m.select("subject", "z", "y", "x", "value"))


@query("aug_elastic")
def aug_elastic(spark, sf_dir):
    return T.elastic_deformation(3, 4, 1.0)(V.voxels(spark, sf_dir))


# Assembly.


def _slice_chunks(spark, sf_dir) -> DataFrame:
    return V.voxels(spark, sf_dir).select("subject", F.col("z").cast("long").alias("sample_index"), F.col("z").cast("long").alias("arrival"), "z", "y", "x", "value")


@query("asm_subject_slices", vox(f"SELECT {VOX}, value FROM voxels"))
def asm_subject_slices(spark, sf_dir):
    return A.assemble_subjects(_slice_chunks(spark, sf_dir), X.shapes(V.voxels(spark, sf_dir)))


@query("asm_subject_patches", with_views("cubes", f"SELECT {VOX}, CASE WHEN z >= 2 THEN value + 1 ELSE value END AS value FROM cubes"))
def asm_subject_patches(spark, sf_dir):
    cubes = V.cubes(spark, sf_dir)
    first = cubes.where("z < 5").select("subject", F.lit(0).cast("long").alias("sample_index"), F.lit(0).cast("long").alias("arrival"), "z", "y", "x", "value")
    second = cubes.where("z >= 2").select("subject", F.lit(1).cast("long").alias("sample_index"), F.lit(1).cast("long").alias("arrival"), "z", "y", "x", (F.col("value") + 1).alias("value"))
    return A.assemble_subjects(first.unionByName(second), X.shapes(cubes))


@query("asm_subject_missing", vox(f"SELECT {VOX}, CASE WHEN z % 3 = 0 THEN 0.0 ELSE value END AS value FROM voxels"))
def asm_subject_missing(spark, sf_dir):
    return A.assemble_subjects(_slice_chunks(spark, sf_dir).where("z % 3 <> 0"), X.shapes(V.voxels(spark, sf_dir)))


@query("asm_ready", vox("SELECT DISTINCT subject FROM voxels WHERE subject NOT IN (SELECT subject FROM voxels WHERE z = 50)"))
def asm_ready(spark, sf_dir):
    chunks = _slice_chunks(spark, sf_dir)
    return A.ready_subjects(chunks.where("z <> 50"), chunks)


@query("asm_interaction", vox(f"SELECT {VOX}, value * 2 AS value FROM voxels"))
def asm_interaction(spark, sf_dir):
    return A.assemble_subjects(_slice_chunks(spark, sf_dir), X.shapes(V.voxels(spark, sf_dir)), interact=lambda c: c.withColumn("value", F.col("value") * 2))


@query("asm_closed", vox("SELECT subject FROM shape WHERE subject < (SELECT max(subject) FROM shape)", _SHAPE))
def asm_closed(spark, sf_dir):
    """Slices that come subject by subject."""
    items = _source(spark, sf_dir, X.SliceIndexing((0,))).samples()
    return A.closed_subjects(items.withColumn("arrival", F.col("sample_index")))


@query("tfm_loop_entries", vox("SELECT subject, z, y, x, entry, round(CASE entry WHEN 'T2' THEN (value-m)/s ELSE value END, 6) + 0.0 AS value FROM (SELECT *, avg(value) OVER w m, stddev_pop(value) OVER w s FROM two WINDOW w AS (PARTITION BY subject, entry))", _TWO))
def tfm_loop_entries(spark, sf_dir):
    two = X.two_channels(V.voxels(spark, sf_dir)).select("subject", "z", "y", "x", "entry", "value")
    return rounded(T.loop_entries(T.intensity_normalization, ["T2"])(two), "value")


@query("asm_planes_mean", vox(f"SELECT {VOX}, round((value + value * 3) / 2, 6) + 0.0 AS value FROM voxels"))
def asm_planes_mean(spark, sf_dir):
    z = _slice_chunks(spark, sf_dir)
    x = z.withColumn("sample_index", F.col("x").cast("long")).withColumn("value", F.col("value") * 3)
    return rounded(A.assemble_planes([z, x], X.shapes(V.voxels(spark, sf_dir))), "value")


@query("asm_planes_ready", SQL["asm_ready"])
def asm_planes_ready(spark, sf_dir):
    z = _slice_chunks(spark, sf_dir)
    x = z.withColumn("sample_index", F.col("x").cast("long"))
    return A.planes_ready([(z.where("z <> 50"), z), (x, x)])


@query("asm_subject_2d", vox("SELECT subject, y, x, arg_max(value, z) AS value FROM voxels GROUP BY subject, y, x"))
def asm_subject_2d(spark, sf_dir):
    return A.assemble_2d(_slice_chunks(spark, sf_dir).select("subject", "y", "x", "arrival", "value"))


# Reports.

_RESULTS = f"""res AS (SELECT 's' || subject id, 'fg' AS label, 'DICE' metric, round(CAST({COUNT_SQL['DICE']} AS DOUBLE), 6) AS value FROM c UNION ALL SELECT 's' || subject, 'fg', 'JACRD', round(CAST({COUNT_SQL['JACRD']} AS DOUBLE), 6) FROM c WHERE subject <> 3)"""


def _results(spark, sf_dir) -> DataFrame:
    wide = E.evaluate_counts(V.masks(spark, sf_dir), ["DICE", "JACRD"])
    rows = E.long_results(wide, ["subject"], ["DICE", "JACRD"]).where("NOT (subject = 3 AND metric = 'JACRD')")
    return rows.select(F.concat(F.lit("s"), F.col("subject").cast("string")).alias("id"), F.lit("fg").alias("label"), "metric", r6("value").alias("value"))


@query("stats_mean_std", with_views("masks", "SELECT label, metric, 'MEAN' statistic, round(avg(value), 6) AS value FROM res GROUP BY ALL UNION ALL SELECT label, metric, 'STD', round(stddev_pop(value), 6) FROM res GROUP BY ALL", COUNTS.format("masks"), _RESULTS))
def stats_mean_std(spark, sf_dir):
    return rounded(P.statistics(_results(spark, sf_dir)), "value")


QUERIES["report_stats_csv"], SQL["report_stats_csv"] = stats_mean_std, SQL["stats_mean_std"]


@query("stats_custom", with_views("masks", "SELECT label, metric, 'MAX' statistic, round(max(value), 6) AS value FROM res GROUP BY ALL", COUNTS.format("masks"), _RESULTS))
def stats_custom(spark, sf_dir):
    return rounded(P.statistics(_results(spark, sf_dir), {"MAX": F.max}), "value")


@query("report_csv_pivot", with_views("masks", """SELECT id, label, coalesce(printf('%.3f', max(value) FILTER (WHERE metric = 'DICE')), 'n/a') "DICE", coalesce(printf('%.3f', max(value) FILTER (WHERE metric = 'JACRD')), 'n/a') "JACRD" FROM res GROUP BY id, label""", COUNTS.format("masks"), _RESULTS))
def report_csv_pivot(spark, sf_dir):
    return P.pivot(_results(spark, sf_dir), ["JACRD", "DICE"], precision=3)


@query("report_console", with_views("masks", """SELECT rpad(id, 4, ' ') || rpad(label, 7, ' ') || rpad(coalesce(printf('%.3f', max(value) FILTER (WHERE metric = 'DICE')), 'n/a'), 7, ' ') || rpad(coalesce(printf('%.3f', max(value) FILTER (WHERE metric = 'JACRD')), 'n/a'), 5, ' ') line FROM res GROUP BY id, label""", COUNTS.format("masks"), _RESULTS))
def report_console(spark, sf_dir):
    return P.console_lines(report_csv_pivot(spark, sf_dir), []).select("line")


@query("report_stats_console", with_views("masks", "SELECT rpad(label, 7, ' ') || rpad(metric, 8, ' ') || rpad(statistic, 11, ' ') || rpad(v, 5, ' ') line FROM (SELECT label, metric, 'MAX' statistic, printf('%.3f', max(value)) v FROM res GROUP BY ALL)", COUNTS.format("masks"), _RESULTS))
def report_stats_console(spark, sf_dir):
    table = stats_custom(spark, sf_dir).select("label", "metric", "statistic", F.format_string("%.3f", "value").alias("value"))
    return P.console_lines(table, []).select("line")


# Filters.

_transform("flt_zscore", L.normalize_z_score(), f"SELECT {VOX}, round((value-m)/s, 6) + 0.0 AS value FROM st", _ST.format(""), round_value=True)
_transform("flt_rescale", L.rescale_intensity(-1, 1), f"SELECT {VOX}, round((value-lo)/(hi-lo)*2-1, 6) + 0.0 AS value FROM st", _ST.format(""), round_value=True)
_transform("flt_binary_threshold", L.binary_threshold(0.5), f"SELECT {VOX}, CASE WHEN value BETWEEN 0 AND 0.5 THEN 0 ELSE 1 END AS value FROM voxels")
_transform("flt_size_two_sided", L.correct_size((4, 10), True, 2.0), """SELECT g.subject, g.z, CAST(b.range AS INTEGER) y, CAST(c.range AS INTEGER) x, coalesce(v.value, 2.0) AS value FROM (SELECT DISTINCT subject, z FROM voxels) g, range(10) b, range(4) c
    LEFT JOIN voxels v ON v.subject = g.subject AND v.z = g.z AND v.y = b.range - 1 AND v.x = c.range + 2""")
_transform("flt_size_one_sided", L.correct_size((4, 10), False, 2.0), """SELECT g.subject, g.z, CAST(b.range AS INTEGER) y, CAST(c.range AS INTEGER) x, coalesce(v.value, 2.0) AS value FROM (SELECT DISTINCT subject, z FROM voxels) g, range(10) b, range(4) c
    LEFT JOIN voxels v ON v.subject = g.subject AND v.z = g.z AND v.y = b.range - 2 AND v.x = c.range + 4""")
_transform("flt_pipeline", L.FilterPipeline([L.rescale_intensity(0, 1), L.binary_threshold(0.5)]).execute, f"SELECT {VOX}, CASE WHEN (value-lo)/(hi-lo) BETWEEN 0 AND 0.5 THEN 0 ELSE 1 END AS value FROM st", _ST.format(""))


def _relabel(name: str, changes: dict, case: str) -> None:
    @query(name, f"SELECT l_orderkey, l_linenumber, CAST(CASE {case} ELSE l_linenumber END AS INTEGER) AS value FROM lineitem")
    def run(spark, sf_dir):
        return L.relabel(changes)(V.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_linenumber").alias("value")))


_relabel("flt_relabel", {3: 5, 7: 3}, "WHEN l_linenumber = 3 THEN 7 WHEN l_linenumber = 5 THEN 3")
_relabel("flt_relabel_multi", {9: (1, 5)}, "WHEN l_linenumber IN (1, 5) THEN 9")

_COMPONENTS = """RECURSIVE fg AS (SELECT subject, z, y, x, (z*8+y)*8+x id FROM cubes WHERE pred = 1),
edge AS (SELECT a.subject, a.id a, b.id b FROM fg a JOIN fg b ON a.subject = b.subject AND abs(a.z-b.z)+abs(a.y-b.y)+abs(a.x-b.x) = 1),
reach AS (SELECT subject, id, id root FROM fg UNION SELECT r.subject, e.b, r.root FROM reach r JOIN edge e ON e.subject = r.subject AND e.a = r.id WHERE e.b > r.root),
comp AS (SELECT subject, id, min(root) root FROM reach GROUP BY subject, id),
best AS (SELECT subject, root, row_number() OVER (PARTITION BY subject ORDER BY count(*) DESC, root) k FROM comp GROUP BY subject, root)"""


def _components_sql(value: str) -> str:
    head = with_views("cubes", "").removeprefix("WITH ").rstrip()
    return f"WITH RECURSIVE {head}, {_COMPONENTS.removeprefix('RECURSIVE ')} SELECT c.subject, c.z, c.y, c.x, CAST(coalesce({value}, 0) AS INTEGER) AS value FROM cubes c LEFT JOIN comp m ON m.subject = c.subject AND m.id = (c.z*8+c.y)*8+c.x LEFT JOIN best b ON b.subject = m.subject AND b.root = m.root AND b.k <= 2"


def _largest(name: str, consecutive: bool, value: str) -> None:
    @query(name, _components_sql(value))
    def run(spark, sf_dir):
        cubes = V.cubes(spark, sf_dir).select("subject", "z", "y", "x", F.col("pred").alias("value"))
        return L.largest_components(2, consecutive)(cubes)


_largest("flt_largest_cc", False, "CASE WHEN b.k IS NOT NULL THEN 1 END")
_largest("flt_largest_cc_consecutive", True, "b.k")


@query("flt_otsu_mask", vox(f"SELECT {VOX}, CAST(value > t AS INTEGER) AS value FROM voxels JOIN best USING (subject)",
    "h AS (SELECT subject, CASE WHEN hi = lo THEN 0 ELSE least(199, CAST(floor((value-lo)/((hi-lo)/200)) AS INTEGER)) END bin, CAST(count(*) AS DOUBLE) c, any_value(lo) lo, any_value(hi) hi FROM (SELECT *, min(value) OVER (PARTITION BY subject) lo, max(value) OVER (PARTITION BY subject) hi FROM voxels) GROUP BY subject, bin)",
    "cum AS (SELECT *, sum(c) OVER r w0, sum(c*bin) OVER r s0, sum(c) OVER p w, sum(c*bin) OVER p s FROM h WINDOW r AS (PARTITION BY subject ORDER BY bin), p AS (PARTITION BY subject))",
    "best AS (SELECT subject, lo+(bin+1)*(hi-lo)/200 t FROM (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY round(CASE WHEN w0 = w THEN -1 ELSE w0*(w-w0)*pow(s0/w0-(s-s0)/(w-w0),2) END, 6) DESC, bin) k FROM cum) WHERE k = 1)"))
def flt_otsu_mask(spark, sf_dir):
    return L.otsu_mask()(V.voxels(spark, sf_dir))


@query("flt_anisotropic", with_views("cubes", f"SELECT {VOX}, round(value + 0.125 * (" + " + ".join(f"{d}*exp({d}*{d}/(k*-18.0))" for d in ("n_y", "p_y", "n_x", "p_x")) + "), 6) + 0.0 AS value FROM (SELECT *, avg(g) OVER (PARTITION BY subject, z) k FROM d)",
    "d AS (SELECT *, pow((n_y-p_y)/2, 2) + pow((n_x-p_x)/2, 2) g FROM (SELECT subject, z, y, x, value, coalesce(lead(value) OVER ys, value)-value n_y, coalesce(lag(value) OVER ys, value)-value p_y, coalesce(lead(value) OVER xs, value)-value n_x, coalesce(lag(value) OVER xs, value)-value p_x FROM cubes WINDOW ys AS (PARTITION BY subject, z, x ORDER BY y), xs AS (PARTITION BY subject, z, y ORDER BY x)))"))
def flt_anisotropic(spark, sf_dir):
    return rounded(L.anisotropic_diffusion(1)(V.cubes(spark, sf_dir).select("subject", "z", "y", "x", "value")), "value")


@query("flt_histogram_match", vox(f"SELECT {VOX}, round(CASE WHEN value < a[1] THEN value-a[1]+b[1] WHEN value < a[2] THEN b[1]+(value-a[1])/(a[2]-a[1])*(b[2]-b[1]) ELSE b[2]+(value-a[2])/(a[3]-a[2])*(b[3]-b[2]) END, 6) + 0.0 AS value FROM voxels JOIN q USING (subject)",
    "q AS (SELECT subject, quantile_cont(value, [0, 0.5, 1]) a, list_transform(quantile_cont(value, [0, 0.5, 1]), lambda v: v * 2 + 1) b FROM (SELECT *, avg(value) OVER (PARTITION BY subject) m FROM voxels) WHERE value >= m GROUP BY subject)"))
def flt_histogram_match(spark, sf_dir):
    df = V.voxels(spark, sf_dir)
    return rounded(L.match_histogram(df.withColumn("value", F.col("value") * 2 + 1))(df), "value")


@query("flt_n4")
def flt_n4(spark, sf_dir):
    stacks = V.stacks(spark, sf_dir).withColumn("value", F.col("value") + 5)
    out = L.correct_bias(levels=2, iterations=3, keys=("subject", "stack"))(stacks)
    return out.select("subject", (F.col("stack") * V.EDGE + F.col("z")).alias("z"), "y", "x", "value")


@query("flt_registration")
def flt_registration(spark, sf_dir):
    slices = V.voxels(spark, sf_dir)
    return L.register_images(slices, iterations=5, bins=8, keys=("subject", "z"))(slices)


# Dataset creation and storage.

_FILES = "SELECT subject_index, category, entry, path FROM files"


@query("src_subject_file", with_views("files", "SELECT subject_index, count(*) n, count(DISTINCT category || entry) n_distinct FROM files GROUP BY subject_index"))
def src_subject_file(spark, sf_dir):
    return V.files(spark, sf_dir).groupBy("subject_index").agg(F.count("*").alias("n"), F.count_distinct("category", "entry").alias("n_distinct"))


@query("src_get_all_files", with_views("files", "SELECT subject_index, string_agg(entry || '=' || path, ',' ORDER BY entry) files FROM files GROUP BY subject_index"))
def src_get_all_files(spark, sf_dir):
    pairs = F.array_sort(F.transform(F.map_entries("files"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return D.all_files(V.files(spark, sf_dir)).select("subject_index", F.array_join(pairs, ",").alias("files"))


@query("create_names_check", with_views("files", "SELECT category, count(DISTINCT e) versions, min(e) AS names FROM (SELECT category, subject_index, string_agg(entry, ',' ORDER BY entry) e FROM files GROUP BY 1, 2) GROUP BY category"))
def create_names_check(spark, sf_dir):
    return D.consistent_names(V.files(spark, sf_dir))


_ROOT = "root AS (SELECT array_to_string(a[1:(SELECT min(i) FROM range(1, 100) t(i) WHERE i > len(a) OR a[i] IS DISTINCT FROM b[i]) - 1], '/') file_root FROM (SELECT string_split(min(path), '/') a, string_split(max(path), '/') b FROM files))"


@query("create_file_root", with_views("files", "SELECT file_root FROM root", _ROOT))
def create_file_root(spark, sf_dir):
    return D.file_root(V.files(spark, sf_dir))


@query("create_rel_files", with_views("files", "SELECT subject_index, category, entry, file_root, substr(path, length(file_root) + 2) rel_path FROM files, root", _ROOT))
def create_rel_files(spark, sf_dir):
    return D.relative_files(V.files(spark, sf_dir)).select("subject_index", "category", "entry", "file_root", "rel_path")


QUERIES["ext_files"], SQL["ext_files"] = create_rel_files, SQL["create_rel_files"]


@query("create_concat", vox("SELECT subject, z, y, x, 0 channel, 'T1' entry, value FROM voxels UNION ALL SELECT subject, z, y, x, 1, 'T2', value * 2 FROM voxels"))
def create_concat(spark, sf_dir):
    v = V.voxels(spark, sf_dir)
    return D.stack_channels([("T1", v), ("T2", v.withColumn("value", F.col("value") * 2))])


@query("create_shapes", vox("SELECT subject, nz, ny, nx, 2 nchannel FROM shape", _SHAPE))
def create_shapes(spark, sf_dir):
    return D.stored_shapes(create_concat(spark, sf_dir))


@query("create_names", "SELECT * FROM (VALUES ('images', 0, 'T1'), ('images', 1, 'T2')) t(category, channel, entry)")
def create_names(spark, sf_dir):
    return D.names(create_concat(spark, sf_dir).withColumn("category", F.lit("images")))


def _shared(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the session names. Only a local master gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _stored(spark: SparkSession, sf_dir: str) -> str:
    """A dataset of two channels."""
    path = _shared(spark, "dataset")
    D.create_dataset(create_concat(spark, sf_dir).withColumn("category", F.lit("images")), path)
    return path


@query("sink_data_roundtrip", vox("SELECT subject, z, y, x, channel, value FROM (SELECT *, 0 channel FROM voxels UNION ALL SELECT subject, z, y, x, value * 2, 1 FROM voxels)"))
def sink_data_roundtrip(spark, sf_dir):
    return D.get_reader(spark, _stored(spark, sf_dir)).voxels("images").select("subject", "z", "y", "x", "channel", "value")


QUERIES["create_dataset"], SQL["create_dataset"] = sink_data_roundtrip, SQL["sink_data_roundtrip"]


@query("scan_slice", vox("SELECT subject, y, x, value FROM voxels WHERE z = 3"))
def scan_slice(spark, sf_dir):
    stored = D.get_reader(spark, _stored(spark, sf_dir)).voxels("images").where("channel = 0 AND z = 3")
    return stored.select("subject", "y", "x", "value")


@query("fn_bytes_to_string", "SELECT n_nationkey, n_name AS name FROM nation")
def fn_bytes_to_string(spark, sf_dir):
    return V.table(spark, sf_dir, "nation").select("n_nationkey", D.bytes_to_string(F.col("n_name").cast("binary")).alias("name"))


@query("fn_subject_entry", "SELECT n_nationkey, lpad(CAST(n_nationkey AS VARCHAR), 2, '0') entry FROM nation")
def fn_subject_entry(spark, sf_dir):
    return V.table(spark, sf_dir, "nation").select("n_nationkey", D.entry_name(F.col("n_nationkey"), F.lit(25)).alias("entry"))


@query("props_equality", vox("SELECT a.subject s, b.subject t, a.nz = b.nz same FROM shape a JOIN shape b ON a.subject + 1 = b.subject", _SHAPE))
def props_equality(spark, sf_dir):
    p = D.image_properties(V.voxels(spark, sf_dir))
    props = p.select("subject", F.struct("size", "origin", "spacing", "direction").alias("p"))
    other = props.select((F.col("subject") - 1).cast("int").alias("subject"), F.col("subject").alias("t"), F.col("p").alias("q"))
    return props.join(other, "subject").select(F.col("subject").alias("s"), "t", D.same_geometry("p", "q").alias("same"))


@query("conv_grid_to_flat", vox("SELECT subject, CAST((z*8+y)*8+x AS INTEGER) flat, value FROM voxels"))
def conv_grid_to_flat(spark, sf_dir):
    return V.voxels(spark, sf_dir).select("subject", D.grid_to_flat(8, 8).cast("int").alias("flat"), "value")


@query("conv_flat_to_grid", vox(f"SELECT {VOX}, value FROM voxels"))
def conv_flat_to_grid(spark, sf_dir):
    flat = conv_grid_to_flat(spark, sf_dir)
    return flat.select("subject", *D.flat_to_grid(F.col("flat"), 8, 8), "value")


def _image_files(spark, sf_dir) -> DataFrame:
    """Each subject as the bytes of an image file."""
    return I.encode_files(D.to_slices(V.voxels(spark, sf_dir)))


def _subject_of(df: DataFrame) -> DataFrame:
    return df.withColumn("subject", F.split("path", r"\.")[0].cast("int"))


@query("src_load_image", vox(f"SELECT {VOX}, 0 channel, value FROM voxels"))
def src_load_image(spark, sf_dir):
    return _subject_of(I.decode_voxels(_image_files(spark, sf_dir))).select("subject", "z", "y", "x", "channel", "value")


@query("ext_filesystem", vox("SELECT subject, y, x, value FROM voxels WHERE z = 4"))
def ext_filesystem(spark, sf_dir):
    return X.extract(_subject_of(I.decode_voxels(_image_files(spark, sf_dir))), X.index_bounds(4, 0)).select("subject", "y", "x", "value")


def _image_catalogue(spark, sf_dir, **given: tuple[str, float]) -> tuple[DataFrame, DataFrame]:
    """Masks of the blobs as image files with a spacing of 2: the catalogue and the files' bytes.

    ``given`` names each entry's category and side; numbers of categories' channels follow its order.
    """
    listed, contents, channels = None, None, {}
    slices = V.blobs(spark, sf_dir)
    for entry, (category, side) in given.items():
        channel = channels[category] = channels.get(category, -1) + 1
        files = I.encode_files(D.to_slices(slices.withColumn("value", F.col(side).cast("double"))), spacing=(2.0, 2.0, 2.0)).withColumn("path", F.concat(F.lit(f"/scans/{entry}/"), "path"))
        ids = V.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("subject_index"))
        rows = ids.select("subject_index", F.col("subject_index").alias("subject"), F.lit(category).alias("category"), F.lit(channel).alias("channel"), F.lit(entry).alias("entry"), F.concat(F.lit(f"/scans/{entry}/"), "subject_index", F.lit(".mha")).alias("path"))
        listed = rows if listed is None else listed.unionByName(rows)
        contents = files if contents is None else contents.unionByName(files)
    return listed, contents


def _traversed(spark, sf_dir) -> D.Reader:
    """A dataset made from image files."""
    path = _shared(spark, "traversed")
    listed, contents = _image_catalogue(spark, sf_dir, P=("images", "pred"), Q=("images", "ref"), GT=("labels", "ref"))
    D.Traverser().traverse(listed, D.default_callbacks(D.get_writer(spark, path)), D.LoadImages(contents))
    return D.get_reader(spark, path)


@query("create_traverse", with_views("blobs", """SELECT subject, z, y, x, 'images' category, 0 channel, 'P' entry, CAST(pred AS DOUBLE) AS value FROM blobs
    UNION ALL SELECT subject, z, y, x, 'images', 1, 'Q', CAST(ref AS DOUBLE) FROM blobs UNION ALL SELECT subject, z, y, x, 'labels', 0, 'GT', CAST(ref AS DOUBLE) FROM blobs"""))
def create_traverse(spark, sf_dir):
    reader = _traversed(spark, sf_dir)
    return reader.voxels("images").unionByName(reader.voxels("labels")).select("subject", "z", "y", "x", "category", "channel", "entry", "value")


@query("create_geometry", "SELECT CAST(n_nationkey AS INTEGER) subject, '13,13,13' size, '2,2,2' spacing, '0,0,0' origin FROM nation")
def create_geometry(spark, sf_dir):
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("int").cast("string")), ",").alias(c)
    return _traversed(spark, sf_dir).properties().select("subject", text("size"), text("spacing"), text("origin"))


@query("create_files", "SELECT CAST(n_nationkey AS INTEGER) subject, category, channel, entry, '/scans' file_root, entry || '/' || n_nationkey || '.mha' rel_path FROM nation, (VALUES ('images', 0, 'P'), ('images', 1, 'Q'), ('labels', 0, 'GT')) t(category, channel, entry)")
def create_files(spark, sf_dir):
    return _traversed(spark, sf_dir).files()


@query("scan_subject_entries", "SELECT CAST(n_nationkey AS INTEGER) subject, lpad(CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS VARCHAR), CAST(length(CAST(count(*) OVER () AS VARCHAR)) AS INTEGER), '0') entry FROM nation")
def scan_subject_entries(spark, sf_dir):
    return _traversed(spark, sf_dir).subject_entries()


@query("eval_spacing_of_files", "SELECT subject, CAST(2 * value AS DOUBLE) AS value FROM (" + SQL["metric_hdrfdst"] + ")")
def eval_spacing_of_files(spark, sf_dir):
    """Hausdorff distance under the spacing that the files state."""
    reader = _traversed(spark, sf_dir)
    images = reader.voxels("images").groupBy("subject", "z", "y", "x").pivot("entry", ["P", "Q"]).agg(F.max("value").cast("int"))
    masks = images.withColumnsRenamed({"P": "pred", "Q": "ref"})
    return S.hausdorff(S.surface_distances(masks, reader.spacing()), masks, 95).select("subject", r6(F.col("HDRFDST") / 2).alias("value")).withColumn("value", F.col("value") * 2)


@query("ext_filesystem_datasource", with_views("blobs", "SELECT s.sample_index, subject, y, x, CAST(pred AS DOUBLE) AS value FROM blobs JOIN s USING (subject, z)", "s AS (SELECT subject, z, CAST(row_number() OVER (ORDER BY subject, z) - 1 AS BIGINT) sample_index FROM (SELECT DISTINCT subject, z FROM blobs))"))
def ext_filesystem_datasource(spark, sf_dir):
    """Samples whose voxels come from files, loaded by one's own function, under another root folder."""
    listed, contents = _image_catalogue(spark, sf_dir, P=("images", "pred"))
    moved = contents.withColumn("path", F.regexp_replace("path", "^/scans/P", "/elsewhere"))
    take = lambda files: I.decode_voxels(moved.join(files, "path", "left_semi"))
    files = D.relative_files(listed)
    source = X.Datasource(V.blobs(spark, sf_dir).select("subject", "z", "y", "x"), X.SliceIndexing((0,)))
    return source.with_extractor(X.extract_from_files(files, take, "/elsewhere")).items().select("sample_index", "subject", "y", "x", "value")


@query("sink_fill", vox(f"SELECT {VOX}, CASE WHEN subject = 2 THEN 0.0 ELSE value END AS value FROM voxels"))
def sink_fill(spark, sf_dir):
    """A part of a stored entry is written anew."""
    writer = D.get_writer(spark, _shared(spark, "fill"))
    v = V.voxels(spark, sf_dir)
    writer.write("data", v, ["subject"])
    writer.fill("data", v.where("subject = 2").withColumn("value", F.lit(0.0)), ["subject"])
    return D.get_reader(spark, writer.path).read("data").select("subject", "z", "y", "x", "value")


@query("sink_overwrite", vox("SELECT subject, z, y, x, value FROM voxels"))
def sink_overwrite(spark, sf_dir):
    """A reserved entry is written, then overwritten as a whole."""
    writer = D.get_writer(spark, _shared(spark, "overwrite"))
    v = V.voxels(spark, sf_dir)
    writer.reserve("data", "subject int, z int, y int, x int, value double")
    writer.write("data", v.withColumn("value", F.lit(0.0)))
    writer.write("data", v)
    return D.get_reader(spark, writer.path).read("data").select("subject", "z", "y", "x", "value")


@query("udtf_patches", with_views("cubes", "SELECT s.subject, CAST(a.range*4 AS INTEGER) z0, CAST(b.range*4 AS INTEGER) y0, CAST(c.range*4 AS INTEGER) x0 FROM (SELECT subject, max(z) + 1 nz FROM cubes GROUP BY subject) s JOIN range(2) a ON a.range < nz // 4, range(2) b, range(2) c"))
def udtf_patches(spark, sf_dir):
    U.register(spark)
    X.shapes(V.cubes(spark, sf_dir)).createOrReplaceTempView("voxelspark_shapes")
    return spark.sql("SELECT s.subject, p.z0, p.y0, p.x0 FROM voxelspark_shapes s, LATERAL patch_index(s.nz, s.ny, s.nx, 4, 4, 4) p")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
