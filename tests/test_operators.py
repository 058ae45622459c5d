"""Cases of image operators with known results."""

import numpy as np
import pytest

from voxelspark import queries as Q
from voxelspark.functions import metrics as M
from voxelspark.operators import assemble as A
from voxelspark.operators import dataset as D
from voxelspark.operators import evaluate as E
from voxelspark.operators import extract as X
from voxelspark.operators import filters as L
from voxelspark.operators import surface as S
from voxelspark.operators import transform as T
from voxelspark.plans import fixtures as V
from voxelspark.sources import images


def table(spark, array, subject=0):
    array = np.asarray(array)
    array = array.reshape((1,) * (3 - array.ndim) + array.shape)
    rows = [(subject, *map(int, i), float(v)) for i, v in np.ndenumerate(array)]
    rows = [(s, z, y, x, v) for s, z, y, x, v in rows]
    return spark.createDataFrame(rows, "subject int, z int, y int, x int, value double")


def array_of(df):
    rows = df.collect()
    out = np.zeros(tuple(max(r[a] for r in rows) + 1 for a in "zyx"))
    for r in rows:
        out[r.z, r.y, r.x] = r.value
    return out


IMAGE = np.zeros((5, 5))
for _x, _y in [(0, 0), (2, 0), (2, 1), (4, 0), (4, 1), (4, 2)]:
    IMAGE[_y, _x] = 1


@pytest.mark.parametrize(("n", "consecutive", "total"), [(1, False, 3), (2, False, 5), (3, False, 6), (3, True, 10)])
def test_largest_components(spark, n, consecutive, total):
    out = array_of(L.largest_components(n, consecutive)(table(spark, IMAGE)))
    assert out.sum() == total


def test_largest_components_needs_one():
    with pytest.raises(ValueError, match="at least one"):
        L.largest_components(0)


def test_z_score(spark):
    out = array_of(L.normalize_z_score()(table(spark, [[1, 2, 3, 4]])))
    assert np.allclose(out.ravel(), [-1.3416407864999, -0.44721359549996, 0.44721359549996, 1.3416407864999], atol=1e-12)


def test_size_correction_two_dimensions(spark):
    image = np.random.default_rng(0).integers(0, 10, (5, 5))
    out = array_of(L.correct_size((4, 6))(table(spark, image)))[0]
    assert out.shape == (6, 4)
    assert np.array_equal(out[:-1], image[:, :-1])


def test_size_correction_three_dimensions(spark):
    image = np.random.default_rng(1).integers(0, 10, (5, 4, 2))
    both = array_of(L.correct_size((4, 4, 3))(table(spark, image)))
    assert both.shape == (3, 4, 4)
    assert np.array_equal(both[:, :, 1:-1], image[1:-1])
    one = array_of(L.correct_size((4, 4, 3), two_sided=False)(table(spark, image)))
    assert np.array_equal(one[:, :, 2:], image[2:])


def test_size_correction_pads_with_constant(spark):
    assert (array_of(L.correct_size((4, 6), pad_constant=1)(table(spark, np.ones((5, 3))))) == 1).all()
    with pytest.raises(ValueError, match="reference shape"):
        L.correct_size(None)


def test_relabel(spark):
    image = np.zeros((4, 4))
    image[1, 1] = image[1, 2] = 5
    image[3, 3] = 1
    out = array_of(L.relabel({3: 5, 2: 1})(table(spark, image)))[0]
    assert out[1, 1] == out[1, 2] == 3 and out[3, 3] == 2
    many = array_of(L.relabel({3: (1, 5)})(table(spark, image)))[0]
    assert many[1, 1] == many[1, 2] == many[3, 3] == 3


def test_relabel_chain_and_simultaneous_differ(spark):
    df = table(spark, [[5.0]])
    assert T.relabel_chain({3: 5, 7: 3})(df).first().value == 7
    assert L.relabel({3: 5, 7: 3})(df).first().value == 3


EMPTY_CASES = {"both": ([0, 0, 0], [0, 0, 0]), "pred": ([0, 0, 0], [0, 1, 1]), "ref": ([1, 0, 0], [0, 0, 0]), "full": ([1, 1, 1], [1, 1, 1]), "one": ([1], [1])}
INF, NAN = float("inf"), float("nan")
EXPECTED = {
    "DICE": [1, 0, 0, 1, 1],
    "SNSVTY": [-INF, 0, -INF, 1, 1],
    "SPCFTY": [1, 1, 2 / 3, NAN, NAN],
    "PRCISON": [0, 0, 0, 1, 1],
    "FNR": [NAN, 1, NAN, 0, 0],
    "VOLSMTY": [-INF, 0, 0, 1, 1],
    "MUTINF": [-INF, -INF, -INF, -INF, -INF],
    "PROBDST": [-1, -1, -1, 0, 0],
    "GCOERR": [INF, INF, INF, INF, INF],
}


def test_metric_edge_cases(spark):
    rows = [(k, p, r) for k, (ps, rs) in EMPTY_CASES.items() for p, r in zip(ps, rs, strict=True)]
    out = {r.subject: r for r in E.evaluate_counts(spark.createDataFrame(rows, "subject string, pred int, ref int"), list(EXPECTED)).collect()}
    for metric, values in EXPECTED.items():
        got = [out[k][metric] for k in EMPTY_CASES]
        assert np.allclose(got, values, equal_nan=True), metric


def test_metrics_against_numpy(spark):
    rng = np.random.default_rng(2)
    p, r = rng.integers(0, 2, 200), rng.integers(0, 2, 200)
    df = spark.createDataFrame([(0, int(a), int(b)) for a, b in zip(p, r, strict=True)], "subject int, pred int, ref int")
    out = E.evaluate_counts(df).first().asDict()
    same_p, same_r = p[:, None] == p[None], r[:, None] == r[None]
    upper = np.triu(np.ones((200, 200), bool), 1)
    assert np.isclose(out["RNDIND"], (same_p == same_r)[upper].mean())
    joint = np.array([[((p == i) & (r == j)).mean() for j in (0, 1)] for i in (0, 1)])
    mi = (joint * np.log2(joint / np.outer(joint.sum(1), joint.sum(0)))).sum()
    assert np.isclose(out["MUTINF"], mi) and out["VARINFO"] >= 0
    assert np.isclose(out["DICE"], 2 * out["JACRD"] / (1 + out["JACRD"]))
    m = (p + r) / 2
    ssw = ((p - m) ** 2 + (r - m) ** 2).sum() / 200
    ssb = 2 * ((m - m.mean()) ** 2).sum() / 199
    assert np.isclose(out["ICCORR"], (ssb - ssw) / (ssb + ssw))
    assert set(M.SEGMENTATION_METRICS) >= set(M.OVERLAP_METRICS) and len(M.SEGMENTATION_METRICS) == 30


def test_surface_distance_by_brute_force(spark):
    rng = np.random.default_rng(3)
    masks = rng.random((2, 4, 5, 3)) < 0.3
    rows = [(0, *map(int, i), int(masks[0][i]), int(masks[1][i])) for i in np.ndindex(4, 5, 3)]
    df = spark.createDataFrame(rows, "subject int, z int, y int, x int, pred int, ref int")
    got = S.surface_distances(df, (2.0, 1.0, 0.5)).collect()
    corners = []
    for m in masks:
        padded = np.pad(m, 1).astype(int)
        code = sum(w * padded[a : a + 5, b : b + 6, c : c + 4] for (a, b, c), w in S.WEIGHTS.items())
        corners.append(np.argwhere((code > 0) & (code < 255)) * [2, 1, 0.5])
    for side, own, other in (("pred", *corners), ("ref", *corners[::-1])):
        want = sorted(np.sqrt(((own[:, None] - other[None]) ** 2).sum(2)).min(1))
        assert np.allclose(sorted(r.d for r in got if r.side == side), want)
    assert len(S.areas()) == 256


def test_index_expressions():
    assert X.index_bounds(3) == {0: (3, 4, True)}
    assert X.index_bounds([None, (1, 4)], [0, 2]) == {0: (None, None, False), 2: (1, 4, False)}
    with pytest.raises(ValueError, match="unknown index"):
        X.index_bounds("a")


def test_mirror_and_permute_are_involutions(spark):
    df = table(spark, np.arange(24).reshape(2, 3, 4))
    once = T.random_mirror(1, 0)(df)
    assert np.array_equal(array_of(T.random_mirror(1, 0)(once)), array_of(df))
    assert np.array_equal(array_of(T.permute((2, 0, 1))(df)), array_of(df).transpose(2, 0, 1))
    assert np.array_equal(array_of(T.reshape((2, 3, 4), (4, 3, -1))(df)), np.arange(24).reshape(4, 3, 2))


def test_reader_round_trip(spark, tmp_path):
    v = table(spark, np.arange(24).reshape(2, 3, 4))
    D.create_dataset(D.stack_channels([("T1", v)]).selectExpr("*", "'images' AS category"), str(tmp_path / "set"))
    reader = D.get_reader(spark, str(tmp_path / "set"))
    assert reader.has("data") and not reader.has("none")
    assert np.array_equal(array_of(reader.voxels("images")), np.arange(24).reshape(2, 3, 4))
    with pytest.raises(ValueError, match="no reader"):
        D.get_reader(spark, "x.unknown")


def test_subject_files_reject_clashes(spark):
    with pytest.raises(ValueError, match="several categories"):
        D.subject_files({"a": {"images": {"T1": "x"}, "labels": {"T1": "y"}}}, spark)


def test_image_files(spark, tmp_path):
    array = np.arange(24, dtype="<f4").reshape(2, 3, 4)
    for compressed in (False, True):
        data = images.write_mha(array, [1.0, 2.0, 3.0], compressed=compressed)
        got, info = images.parse_mha(data)
        assert np.array_equal(got, array) and info["size"] == [4, 3, 2] and info["spacing"] == [1.0, 2.0, 3.0]
    (tmp_path / "a.mha").write_bytes(data)
    df = images.load_voxels(spark, str(tmp_path / "a.mha"))
    assert df.count() == 24 and df.where("z = 1 AND y = 2 AND x = 3").first().value == 23
    assert images.load_properties(spark, str(tmp_path / "a.mha")).first().size == [4, 3, 2]


def test_streamed_assembly(spark, tmp_path):
    from voxelspark.streaming import assembler as G

    rows = [(s, z, z, z, 3, [float(s), float(z)]) for s in (1, 2) for z in (2, 0, 1) if (s, z) != (2, 1)]
    spark.createDataFrame(rows, G.CHUNK_SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(G.CHUNK_SCHEMA).parquet(str(tmp_path / "in"))
    q = G.assemble_stream(stream).writeStream.format("memory").queryName("assembled").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    out = sorted((r.subject, r.z, r.data[1]) for r in spark.table("assembled").collect())
    assert out == [(1, 0, 0.0), (1, 1, 1.0), (1, 2, 2.0)]


def test_command_filter(spark):
    import sys

    copy = [sys.executable, "-c", "import shutil, sys; shutil.copy(sys.argv[1], sys.argv[2])"]
    df = table(spark, np.arange(6).reshape(2, 3))
    assert np.array_equal(array_of(L.run_command(copy, enabled=True)(df)), array_of(df))
    with pytest.raises(PermissionError):
        L.run_command(copy)


def test_registration_recovers_a_shift(spark):
    y, x = np.indices((24, 24))
    blob = lambda cy, cx: np.exp(-((y - cy) ** 2 / 30 + (x - cx) ** 2 / 12)) * 100
    fixed, moving = (table(spark, blob(*c)).select("subject", "y", "x", "value") for c in ((12, 12), (14, 10)))
    out = L.register_images(fixed, bins=16, iterations=40)(moving)
    got = np.zeros((24, 24))
    for r in out.collect():
        got[r.y, r.x] = r.value
    assert np.abs(got - blob(12, 12)).mean() < np.abs(blob(14, 10) - blob(12, 12)).mean() / 3


def registered_alone(target, image, bins, iterations, factors=(2, 1)):
    """One image moved rigidly onto another, by NumPy's histograms."""

    def moved(p):
        m = np.array([[np.cos(p[0]), -np.sin(p[0])], [np.sin(p[0]), np.cos(p[0])]])
        grid = np.stack(np.meshgrid(*map(np.arange, target.shape), indexing="ij"), axis=-1) - (np.array(target.shape) - 1) / 2
        at = grid @ m.T + p[1:] + (np.array(image.shape) - 1) / 2
        i0 = np.floor(at).astype(int)
        (y, x), (fy, fx) = np.moveaxis(i0, -1, 0), np.moveaxis(at - i0, -1, 0)
        padded = np.pad(image, 1)
        pick = lambda a, b: padded[np.clip(a + 1, 0, padded.shape[0] - 1), np.clip(b + 1, 0, padded.shape[1] - 1)]
        return (pick(y, x) * (1 - fx) + pick(y, x + 1) * fx) * (1 - fy) + (pick(y + 1, x) * (1 - fx) + pick(y + 1, x + 1) * fx) * fy

    def score(p, factor):
        joint = np.histogram2d(target[::factor, ::factor].ravel(), moved(p)[::factor, ::factor].ravel(), bins)[0]
        joint /= joint.sum()
        with np.errstate(divide="ignore", invalid="ignore"):
            return float(np.nansum(joint * np.log(joint / np.outer(joint.sum(1), joint.sum(0)))))

    p = np.zeros(3)
    for factor in factors:
        step, best = np.array([0.1, factor, factor]), score(p, factor)
        for _ in range(iterations):
            tried = [p + s * step * e for e in np.eye(3) for s in (1, -1)]
            values = [score(q, factor) for q in tried]
            if max(values) > best + 1e-9:
                best, p = max(values), tried[int(np.argmax(values))]
            else:
                step = step / 2
                if step.max() < 1e-3:
                    break
    return moved(p)


def test_registration_in_blocks_equals_one_by_one(spark, monkeypatch):
    """Images of several sizes, alone on either side, under a null key, larger than a block and cut by Arrow's batches."""
    rng = np.random.default_rng(3)
    fixed, moving, want = [], [], {}
    rows_of = lambda k, a: [(k, *map(int, i), float(v)) for i, v in np.ndenumerate(a)]
    for k in [None, *range(40)]:
        n = k or 0
        target, image = rng.normal(size=(6 + n % 2, 5)), np.round(rng.normal(size=(6, 5 + n % 3)), n % 4)
        if n % 13 != 12:
            fixed += rows_of(k, target)
        if n % 13 != 11:
            moving += rows_of(k, image)
            want[k] = image if n % 13 == 12 else registered_alone(target, image, 6, 8)
    monkeypatch.setattr(L, "CELLS", 100)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        tables = (spark.createDataFrame(rows, "subject long, y int, x int, value double").repartition(3, "value") for rows in (fixed, moving))
        fixed, moving = tables
        out = L.register_images(fixed, bins=6, iterations=8)(moving).collect()
        itself = [sorted(map(str, L.register_images(moving, bins=6, iterations=8)(d).collect())) for d in (moving, moving.select("*"))]
        assert itself[0] == itself[1]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    got = {}
    for r in out:
        assert (r.y, r.x) not in got.setdefault(r.subject, {})
        got[r.subject][r.y, r.x] = r.value
    assert got.keys() == want.keys()
    for k, image in want.items():
        assert got[k] == {tuple(map(int, i)): v for i, v in np.ndenumerate(image)}


def test_registration_of_many_small_images_is_done_together(spark):
    """No call for each image: a block takes less than a tenth of the time that its images take alone."""
    import time

    images = np.random.default_rng(0).normal(size=(256, 8, 8))
    L.registered_images(images[:8], images[:8], "rigid", 8, 5, (2, 1))
    began = time.process_time()
    out = L.registered_images(images, images, "rigid", 8, 5, (2, 1))
    together = time.process_time() - began
    began = time.process_time()
    assert all(np.array_equal(out[i], registered_alone(images[i], images[i], 8, 5)) for i in range(64))
    assert together < 4 * (time.process_time() - began) / 10
    plan = L.register_images(table(spark, images[0]))(table(spark, images[0]))._jdf.queryExecution().toString()
    assert "CoGroup" not in plan


def test_bias_correction_flattens(spark):
    rng = np.random.default_rng(0)
    truth = np.where(rng.random((6, 12, 12)) < 0.5, 50.0, 100.0)
    field = np.exp(np.linspace(-0.4, 0.4, 12))[None, None, :]
    df = table(spark, truth * field)
    mask = table(spark, np.ones_like(truth))
    out = array_of(L.correct_bias(mask)(df))
    spread = lambda a: np.std(np.log(a[truth == 100]))
    assert spread(out) < spread(truth * field) * 0.7


@pytest.mark.parametrize("name", ["aug_elastic", "flt_n4", "flt_registration"])
def test_queries_without_sql_use_every_vector(spark, name):
    """Each voxel of the table comes out once: no vector of a label is left out, the last, shorter stack included."""
    sf = "/root/testdata/sf0.001"
    place = ["subject", "z", "y", "x"]
    out = Q.queries()[name](spark, sf)
    assert out.columns == [*place, "value"]
    got = sorted(tuple(r)[:4] for r in out.collect())
    assert got == sorted(tuple(r) for r in V.voxels(spark, sf).select(*place).collect())
    assert len(got) == 64 * V.table(spark, sf, "embeddings").count() and max(z for _, z, _, _ in got) >= V.EDGE


def test_surface_areas_of_plain_cells():
    """One corner, a rectangle between two, a whole side; a code and its complement are alike."""
    from voxelspark.operators.surface import areas

    one, wide = areas(), areas((2.0, 3.0, 5.0))
    assert len(one) == 256 and one[0] == one[255] == 0
    assert abs(one[1] - 3**0.5 / 8) < 1e-12 and abs(one[3] - 0.5**0.5) < 1e-12 and one[15] == 1.0 and wide[15] == 15.0
    assert all(abs(wide[k] - wide[255 - k]) < 1e-9 for k in range(256) if bin(k).count("1") != 4)


def test_evaluator_collects_and_clears(spark):
    from voxelspark.operators.evaluate import Metric, SegmentationEvaluator, evaluate_segmentation

    rows = [(1, 0, 0, x, x % 2, x % 3) for x in range(6)]
    df = spark.createDataFrame(rows, "subject int, z int, y int, x int, pred int, ref int")
    evaluator = SegmentationEvaluator(["DICE", "HDRFDST", Metric("HALF", "tp / 2")])
    evaluator.add_label(1, "one")
    evaluator.add_label((1, 2), "any")
    first = {(r.label, r.metric): r.value for r in evaluator.evaluate(df, spacing=(1.0, 1.0, 2.0)).collect()}
    assert len(first) == 6 and first["one", "HALF"] == 0.5 and first["any", "HALF"] == 1.0
    evaluator.evaluate(df)
    assert evaluator.results.count() == 12
    evaluator.clear()
    assert evaluator.results is None
    with pytest.raises(ValueError, match="unknown"):
        evaluate_segmentation(df, {"one": 1}, ["NOPE"])


def test_distance_map_by_brute_force(monkeypatch):
    rng = np.random.default_rng(0)
    for block in (1, 50, 1 << 21):
        monkeypatch.setattr(S, "BLOCK", block)
        for share in (0.0, 0.05, 0.7):
            seeds, spacing = rng.random(rng.integers(1, 8, 3)) < share, rng.choice([0.5, 1, 3.3], 3)
            places, cells = np.argwhere(seeds) * spacing, np.indices(seeds.shape).reshape(3, -1).T * spacing
            want = np.sqrt(((cells[:, None] - places[None]) ** 2).sum(-1).min(1)) if len(places) else np.full(len(cells), np.inf)
            assert np.allclose(S.distance_map(seeds, spacing).ravel(), want)


class EveryOtherSlice(X.Indexing):
    """An indexing of one's own, without arithmetic."""

    def __call__(self, shape):
        at = shape.selectExpr("*", "explode(sequence(0, nz - 1, 2)) AS at")
        return at.selectExpr("subject", "CAST(at DIV 2 AS BIGINT) AS own", "at AS z0", "at + 1 AS z1", "0 AS y0", "ny AS y1", "0 AS x0", "nx AS x1")


@pytest.mark.parametrize("indexing", [X.EmptyIndexing(), X.SliceIndexing((0, 2)), X.VoxelIndexing(), X.PatchIndexing((2, 2, 3)), X.PatchIndexing((2, 2, 3), False), EveryOtherSlice()], ids=lambda i: type(i).__name__)
def test_samples_items_and_single_items_agree(spark, indexing):
    first, second = np.arange(60.0).reshape(3, 4, 5), np.arange(24.0).reshape(4, 2, 3)
    source = X.Datasource(table(spark, first, 1).union(table(spark, second, 2)), indexing)
    samples = {r.sample_index: r for r in source.samples().collect()}
    assert sorted(samples) == list(range(len(source))) and len(source) > 0
    got = {}
    for r in source.items().collect():
        got.setdefault(r.sample_index, {})[r.z, r.y, r.x] = r.value
    for i, s in samples.items():
        part = (first if s.subject == 1 else second)[s.z0 : s.z1, s.y0 : s.y1, s.x0 : s.x1]
        assert got[i] == {k: v for k, v in np.ndenumerate(part)}
    last = max(samples)
    assert {(r.z, r.y, r.x): r.value for r in source.item(last).collect()} == got[last]
    with pytest.raises(IndexError):
        source.item(last + 1)


def test_extractors_compose_and_take_one_sample(spark):
    source = X.Datasource(table(spark, np.arange(12.0).reshape(3, 2, 2)), X.SliceIndexing((0,)))
    names = spark.createDataFrame([("images", 1, "T2"), ("images", 0, "T1"), ("labels", 0, "GT")], "category string, channel int, entry string")
    parts = X.compose_extractors(X.extract_data, X.extract_names(names, ("images", "labels")), X.extract_indexing)
    rows = source.with_extractor(parts).item(1).collect()
    assert sorted(r.value for r in rows) == [4, 5, 6, 7]
    assert {(tuple(r.images), tuple(r.labels), r.z0) for r in rows} == {(("T1", "T2"), ("GT",), 1)}
    with pytest.raises(ValueError, match="extractor"):
        X.compose_extractors()


@pytest.mark.parametrize(("pad", "mode"), [(X.pad_constant, "constant"), (X.pad_edge, "edge"), (X.pad_reflect, "reflect")])
def test_padding_as_numpy_does(spark, pad, mode):
    image = np.random.default_rng(0).random((4, 5, 6))
    out = X.padded_items(table(spark, image), (4, 5, 6), ((1, 2), (0, 3), 2), pad=pad)
    assert np.allclose(array_of(out.drop("pz", "py", "px")), np.pad(image, ((1, 2), (0, 3), (2, 2)), mode=mode))


def test_traversal_keeps_geometry(spark, tmp_path, caplog):
    arrays = {}
    for subject in ("a", "b"):
        for entry in ("T1", "T2", "GT"):
            arrays[subject, entry] = np.random.default_rng(len(arrays)).integers(0, 9, (2, 3, 4)).astype("u1")
            (tmp_path / f"{subject}_{entry}.mha").write_bytes(images.write_mha(arrays[subject, entry], [1.0, 2.0, 3.0], [5.0, 0.0, 0.0]))
    place = lambda s, e: str(tmp_path / f"{s}_{e}.mha")
    files = D.subject_files({s: {"images": {"T1": place(s, "T1"), "T2": place(s, "T2")}, "labels": {"GT": place(s, "GT")}} for s in "ab"}, spark)
    target = str(tmp_path / "set")
    callback = D.ComposeCallback([D.MonitoringCallback(), D.default_callbacks(D.get_writer(spark, target))])
    with caplog.at_level("INFO"):
        D.Traverser().traverse(files, callback, transform=lambda v: v.withColumn("value", v.value * 2))
    assert caplog.messages == ["start dataset creation", "2 subjects", "dataset creation finished"]
    reader = D.get_reader(spark, target)
    assert reader.spacing() == (3.0, 2.0, 1.0)
    assert {tuple(r.origin) for r in reader.properties().collect()} == {(5.0, 0.0, 0.0)}
    assert sorted(r.rel_path for r in reader.files().collect()) == sorted(f"{s}_{e}.mha" for s, e in arrays)
    assert [(r.subject, r.entry) for r in reader.subject_entries().orderBy("subject").collect()] == [("a", "0"), ("b", "1")]
    for (subject, entry), array in arrays.items():
        stored = reader.voxels("labels" if entry == "GT" else "images").where(f"subject = '{subject}' AND entry = '{entry}'")
        assert np.array_equal(array_of(stored), array * 2.0)
    only = D.Traverser("labels").load(files)
    assert {r.entry for r in only.voxels.select("entry").distinct().collect()} == {"GT"}
    with pytest.raises(ValueError, match="callback"):
        D.Traverser().traverse(files, None)
    with pytest.raises(ValueError, match="no writer"):
        D.get_writer(spark, "x.unknown")


def test_closed_subjects(spark):
    chunks = spark.createDataFrame([(1, 0, 0), (2, 1, 1), (1, 2, 2), (3, 3, 3)], "subject int, sample_index long, arrival long")
    ids = lambda df: sorted(r.subject for r in df.collect())
    assert ids(A.closed_subjects(chunks)) == [1, 2]
    assert ids(A.closed_subjects(chunks, last_batch=True)) == [1, 2, 3]
    with pytest.raises(ValueError, match="assembled"):
        A.assembled_subject(chunks, A.closed_subjects(chunks), 3)


def test_loop_entries_raise_if_one_is_missing(spark):
    two = X.two_channels(table(spark, np.arange(4.0).reshape(2, 2)))
    out = T.loop_entries(lambda keys: T.intensity_rescale(0, 1, keys), ["T1", "T2"])(two)
    assert out.agg({"value": "max"}).first()[0] == 1
    with pytest.raises(Exception, match="aren't all there"):
        T.loop_entries(lambda keys: T.intensity_rescale(0, 1, keys), ["T1", "T3"])(two).collect()
    with pytest.raises(ValueError, match="is needed"):
        T.checked(1, str)


def test_elastic_deformation_moves_a_share(spark):
    image = np.random.default_rng(0).random((40, 8, 8))
    df = table(spark, image)
    moved = lambda p: (array_of(T.elastic_deformation(1, p=p)(df)) != image).any(axis=(1, 2)).sum()
    assert moved(0.0) == 0 and 0 < moved(0.5) < 40 and moved(1.0) == 40


def test_images_are_unpacked_piece_by_piece(spark):
    """Two images of 6 million voxels in one partition (64 MB each, but small as stored) take no worker 300 MB."""
    import threading

    import psutil

    image = np.zeros((96, 256, 256))
    image[95, 255, 254] = 7
    files = spark.createDataFrame([(f"{n}.mha", images.write_mha(image, compressed=True)) for n in (1, 2)], "path string, content binary").coalesce(1)
    peak, over = [0], threading.Event()

    def watch():
        while not over.wait(0.02):
            for child in psutil.Process().children(recursive=True):
                try:
                    if "python" in child.name():
                        peak[0] = max(peak[0], child.memory_info().rss)
                except psutil.Error:
                    pass

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        out = images.decode_voxels(files)
        assert out.count() == 2 * image.size
        assert sorted(map(tuple, out.where("value > 0").collect())) == [(f"{n}.mha", 95, 255, 254, 0, 7.0) for n in (1, 2)]
    finally:
        over.set()
        watcher.join()
    assert 0 < peak[0] < 300e6


def test_image_files_from_slices_in_any_order_and_batch(spark):
    """Slices come in pieces of three and leave as one file for each key, in order of z; other shapes are refused."""
    rng = np.random.default_rng(5)
    want = {k: rng.normal(size=(11 + k, 3, 2 + k)) for k in range(4)}
    rows = [(k, z, a.shape[2], s.ravel().tolist()) for k, a in want.items() for z, s in enumerate(a)]
    slices = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], "subject int, z int, width int, data array<double>").repartition(3)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        files = {r.path: bytes(r.content) for r in images.encode_files(slices, spacing=(1.0, 2.0, 3.0)).collect()}
        assert files.keys() == {f"{k}.mha" for k in want}
        for k, a in want.items():
            array, info = images.parse_mha(files[f"{k}.mha"])
            assert np.array_equal(array, a) and info["spacing"] == [1.0, 2.0, 3.0]
        with pytest.raises(Exception, match="the same shape"):
            images.encode_files(slices.withColumn("subject", slices.subject % 2)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


@pytest.mark.parametrize("compressed", [True, False])
def test_image_streams_equal_their_arrays(spark, compressed):
    """Parts of any length; a file that ends early or has a broken sum fails."""
    image = np.arange(6 * 7 * 5, dtype="<f4").reshape(6, 7, 5)
    data = images.write_mha(image, compressed=compressed)
    for n in (1, 4, 209, 210, 1000):
        assert np.array_equal(np.concatenate(list(images.open_mha(data).parts(n))), image.ravel())
    for broken in [data[:-1], data[:-20], *([data[:-1] + bytes([data[-1] ^ 1])] if compressed else [])]:
        with pytest.raises((ValueError, OSError, images.zlib.error)):
            list(images.open_mha(broken).parts(50))
    files = spark.createDataFrame([("a.mha", data)], "path string, content binary")
    got = {(r.z, r.y, r.x): r.value for r in images.decode_voxels(files).collect()}
    assert got == {tuple(map(int, i)): float(v) for i, v in np.ndenumerate(image)}
    assert images.decode_properties(files).first().asDict()["size"] == [5, 7, 6]
