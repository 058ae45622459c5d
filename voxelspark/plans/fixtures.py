"""Voxel views of the driver tables: the inputs of the queries, and the same views as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EDGE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as images: label is the subject, a vector is an 8 x 8 slice, its rank in the label is z."""
    rank = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    ranked = table(spark, sf_dir, "embeddings").select(F.col("label").cast("int").alias("subject"), rank.cast("int").alias("z"), "embedding")
    flat = ranked.select("subject", "z", F.posexplode("embedding").alias("p", "v"))
    return flat.select("subject", "z", F.expr(f"CAST(p DIV {EDGE} AS INT)").alias("y"), (F.col("p") % EDGE).cast("int").alias("x"), F.col("v").cast("double").alias("value"))


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction: value above 0. Reference: the same of the next slice."""
    after = Window.partitionBy("subject", "y", "x").orderBy("z")
    vox = voxels(spark, sf_dir)
    return vox.select("*", (F.col("value") > 0).cast("int").alias("pred"), (F.coalesce(F.lead("value").over(after), "value") > 0).cast("int").alias("ref"))


def cubes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All masks as images of eight slices, a million to a label at most; a label's last image may be shorter."""
    subject, z = F.expr(f"CAST(subject * 1000000 + z DIV {EDGE} AS INT)"), (F.col("z") % EDGE).cast("int")
    return masks(spark, sf_dir).select(subject.alias("subject"), z.alias("z"), "y", "x", "value", "pred", "ref")


def stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All voxels as images of eight slices: stack is the image's number in its subject, z counts within it.

    A subject's last stack is shorter where its slices don't fill it.
    """
    stack, z = F.expr(f"CAST(z DIV {EDGE} AS INT)"), (F.col("z") % EDGE).cast("int")
    return voxels(spark, sf_dir).select("subject", stack.alias("stack"), z.alias("z"), "y", "x", "value")


def blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two balls in a 13 x 13 x 13 grid for each nation."""
    axis = F.sequence(F.lit(0), F.lit(12))
    grid = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("subject"), F.col("n_regionkey").cast("int").alias("r"), F.explode(axis).alias("z"))
    grid = grid.select("*", F.explode(axis).alias("y")).select("*", F.explode(axis).alias("x"))
    pred = F.expr("(z-6)*(z-6)+(y-6)*(y-6)+(x-6)*(x-6) <= 6+3*r")
    ref = F.expr("(z-6-subject%3)*(z-6-subject%3)+(y-6)*(y-6)+(x-7)*(x-7) <= 9+2*(subject%4)")
    return grid.select("subject", "z", "y", "x", pred.cast("int").alias("pred"), ref.cast("int").alias("ref"))


def multilabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as labelled voxels of their supplier."""
    code = F.expr("CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END")
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("subject"), code.alias("pred"), F.expr("CASE l_linestatus WHEN 'O' THEN 2 ELSE 1 END").alias("ref"))


def regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity", "l_extendedprice")
    joined = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(F.col("l_suppkey").alias("subject"), (F.col("l_quantity") * F.col("p_retailprice") / 1000).alias("pred"), (F.col("l_extendedprice") / 1000).alias("ref"))


def binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").select(F.col("lang").alias("subject"), F.col("quality").alias("pred"), F.col("toxic").alias("ref"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files of subjects: two pages make a subject, its categories are images and labels."""
    page = table(spark, sf_dir, "pages").select("page_id", "url")
    category = F.when(F.col("page_id") % 2 == 0, "images").otherwise("labels")
    entry = F.when(F.col("page_id") % 2 == 0, "T1").otherwise("GT")
    return page.select(F.expr("CAST(page_id DIV 2 AS INT)").alias("subject_index"), category.alias("category"), entry.alias("entry"), F.col("url").alias("path"))


SQL = {
    "voxels": f"""voxels AS (SELECT CAST(label AS INTEGER) subject, CAST(z AS INTEGER) z, CAST(p // {EDGE} AS INTEGER) y, CAST(p % {EDGE} AS INTEGER) x, CAST(v AS DOUBLE) AS value
        FROM (SELECT label, z, unnest(embedding) v, generate_subscripts(embedding, 1) - 1 p
              FROM (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 z FROM embeddings)))""",
    "masks": """masks AS (SELECT *, CAST(value > 0 AS INTEGER) pred, CAST(lead(value, 1, value) OVER (PARTITION BY subject, y, x ORDER BY z) > 0 AS INTEGER) AS ref FROM voxels)""",
    "cubes": f"cubes AS (SELECT CAST(subject * 1000000 + z // {EDGE} AS INTEGER) subject, CAST(z % {EDGE} AS INTEGER) z, y, x, value, pred, ref FROM masks)",
    "blobs": """blobs AS (SELECT subject, z, y, x,
            CAST((z-6)*(z-6)+(y-6)*(y-6)+(x-6)*(x-6) <= 6+3*r AS INTEGER) pred,
            CAST((z-6-subject%3)*(z-6-subject%3)+(y-6)*(y-6)+(x-7)*(x-7) <= 9+2*(subject%4) AS INTEGER) AS ref
        FROM (SELECT CAST(n_nationkey AS INTEGER) subject, CAST(n_regionkey AS INTEGER) r, CAST(a.range AS INTEGER) z, CAST(b.range AS INTEGER) y, CAST(c.range AS INTEGER) x
              FROM nation, range(13) a, range(13) b, range(13) c))""",
    "multilabel": """multilabel AS (SELECT l_suppkey subject, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END pred, CASE l_linestatus WHEN 'O' THEN 2 ELSE 1 END AS ref FROM lineitem)""",
    "regression": """regression AS (SELECT l_suppkey subject, l_quantity * p_retailprice / 1000 pred, l_extendedprice / 1000 AS ref FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "binary": """binaries AS (SELECT lang subject, quality pred, toxic AS ref FROM labels JOIN documents USING (doc_id))""",
    "files": """files AS (SELECT CAST(page_id // 2 AS INTEGER) subject_index, CASE WHEN page_id % 2 = 0 THEN 'images' ELSE 'labels' END category, CASE WHEN page_id % 2 = 0 THEN 'T1' ELSE 'GT' END entry, url path FROM pages)""",
}
NEEDS = {"masks": ["voxels"], "cubes": ["voxels", "masks"]}


def with_views(names: str, body: str, *more: str) -> str:
    """SQL with the named views, and more common table expressions, before its body."""
    wanted: list[str] = []
    for name in names.split():
        for one in [*NEEDS.get(name, []), name]:
            if one not in wanted:
                wanted.append(one)
    return "WITH " + ",\n".join([*(SQL[n] for n in wanted), *more]) + "\n" + body
