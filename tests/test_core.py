"""Estimators, formats, streaming and kernels against numpy and invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import images as kernels
from lumenfold.functions import strings
from lumenfold.operators import estimators, healpix, map_em, particles, sampling, spectral
from lumenfold.sources import stacks, star
from lumenfold.streaming import accumulate


def table_of(spark, images, **more):
    names = list(more)
    rows = [(i, [float(v) for v in image.ravel()], *(float(more[n][i]) for n in names)) for i, image in enumerate(images)]
    return spark.createDataFrame(rows, ", ".join(["id long", "pixels array<double>", *(f"{n} double" for n in names)]))


def blobs(n, count, seed=0):
    """Images of two kinds with noise."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:n, :n]
    kinds = [np.exp(-((x - 2) ** 2 + (y - 3) ** 2) / 3), np.exp(-((x - 5) ** 2 + (y - 5) ** 2) / 3)]
    labels = rng.integers(0, 2, count)
    return np.stack([kinds[k] + rng.normal(0, 0.1, (n, n)) for k in labels]), labels, kinds


def test_global_index_and_blocks(spark):
    df = spark.range(103).select((F.col("id") * 7 % 103).alias("k")).repartition(5)
    indexed, total = particles.with_global_index(df, ["k"])
    assert total == 103 and all(r.k == r.ord for r in indexed.collect())
    blocks = [r.block for r in particles.split_equally(df, ["k"], 7).orderBy("k").collect()]
    assert blocks == sorted(blocks) and [blocks.count(b) for b in range(1, 8)] == [15] * 5 + [14] * 2
    assert particles.with_global_index(df.where("false"), ["k"])[0].count() == 0


def test_mass_threshold_matches_a_sort(spark):
    rng = np.random.default_rng(0)
    w = rng.random(500)
    df = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate(w)], "u int, i int, w double")
    got = particles.significant_counts(df, "u", "w", "i", 0.9).first()
    falling = np.sort(w)[::-1]
    k = int(np.argmax(np.cumsum(falling) > 0.9 * w.sum())) + 1
    assert got.nr_significant == k and got.threshold == falling[k - 1]


def test_number_text(spark):
    values = [0.0, 1.5, 1e-4, 123456.0, -2.25]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(strings.number_text(F.col("v"))).collect()]
    assert got == ["    0.000000", "    1.500000", "1.000000e-04", "1.234560e+05", "   -2.250000"]


def test_fourier_matches_numpy_and_shifts(spark):
    rng = np.random.default_rng(1)
    image = rng.normal(size=(8, 8))
    long = spectral.long_spectrum(spectral.fourier(table_of(spark, [image])).drop("pixels"))
    f = np.fft.rfft2(image) / 64
    for r in long.collect():
        assert abs(complex(r.re, r.im) - f[r.ky % 8, r.kx]) < 1e-12
    moved = spectral.shifted(long, 2.0, 3.0, 8).collect()
    g = np.fft.rfft2(np.roll(image, (3, 2), (0, 1))) / 64
    assert all(abs(complex(r.re, r.im) - g[r.ky % 8, r.kx]) < 1e-12 for r in moved)


def test_kernels_on_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, [1.0, 2.0, 3.0, 4.0])], "id int, pixels array<double>")
    got = {r.id: r.pixels for r in spectral.image_kernel(df, lambda a: a * 2).collect()}
    assert got == {1: None, 2: [2.0, 4.0, 6.0, 8.0]}


def test_image_kernels():
    rng = np.random.default_rng(2)
    image = rng.normal(size=(16, 16))
    assert np.allclose(kernels.center(kernels.center(image), False), image)
    assert np.allclose(kernels.translate(image, 3, -2), np.roll(image, (-2, 3), (0, 1)))
    assert np.allclose(kernels.rotate(kernels.rotate(image, 90), -90)[3:14, 3:14], image[3:14, 3:14])
    assert np.allclose(kernels.low_pass(image, 20), image)
    smooth = kernels.low_pass(image, 3)
    assert abs(kernels.fourier_resize(smooth, 32).mean() - smooth.mean()) < 1e-9
    assert kernels.soft_mask(image, 4, 2)[0, 0] == pytest.approx(kernels.soft_mask(image, 4, 2)[0, 1])


def test_projection_and_reconstruction(spark):
    n = 8
    z, y, x = np.mgrid[:n, :n, :n] - n // 2
    volume = np.exp(-((x - 1) ** 2 + y**2 + (z + 1) ** 2) / 4)
    flat = kernels.project(volume, np.eye(3))
    assert np.corrcoef(flat.ravel(), volume.sum(0).ravel())[0, 1] > 0.99
    views = healpix.centres(1)
    angles = [(rot, tilt, psi) for rot, tilt in views for psi in (0.0, 45.0)]
    images = [kernels.project(volume, estimators.euler(*a)) for a in angles]
    df = table_of(spark, images, rot=[a[0] for a in angles], tilt=[a[1] for a in angles], psi=[a[2] for a in angles])
    back = estimators.reconstruct_volume(df)
    assert np.corrcoef(back.ravel(), volume.ravel())[0, 1] > 0.9
    assert np.corrcoef(estimators.reconstruct_volume(df, rounds=5).ravel(), volume.ravel())[0, 1] > 0.8


def test_classes_2d_find_two_kinds(spark):
    images, labels, kinds = blobs(8, 120)
    model = estimators.classify_2d(table_of(spark, images).repartition(3), 2, 12)
    match = [[np.corrcoef(r, k.ravel())[0, 1] for k in kinds] for r in model.references]
    assert max(match[0]) > 0.97 and max(match[1]) > 0.97 and np.argmax(match[0]) != np.argmax(match[1])
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(model.history[1:], model.history[2:])) or estimators.stalled(model.history)
    assert abs(model.shares.sum() - 1) < 1e-9


def test_classes_3d_run(spark):
    n = 6
    z, y, x = np.mgrid[:n, :n, :n] - n // 2
    volume = np.exp(-((x - 1) ** 2 + y**2 + z**2) / 3)
    views = healpix.centres(0)
    df = table_of(spark, [kernels.project(volume, estimators.euler(r, t, 0.0)) for r, t in views] * 2)
    out, shares, history = estimators.classify_3d(df, np.stack([volume * 0.5, volume[::-1] * 0.5]), views, 2)
    assert out.shape == (2, n, n, n) and abs(shares.sum() - 1) < 1e-9 and len(history) == 2


def test_latent_map_orders_a_curve(spark):
    rng = np.random.default_rng(5)
    t = np.linspace(0, 1, 90)
    points = np.stack([np.cos(3 * t), np.sin(3 * t), t, t * 0], 1) + rng.normal(0, 0.02, (90, 4))
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(points)], "id long, pixels array<double>")
    model = estimators.fit_latent_map(df, 9, 15)
    assert model.history[-1] > model.history[0]
    placed = [r.class_no for r in estimators.assign_nodes(df, model).orderBy("id").collect()]
    assert abs(np.corrcoef(placed, t)[0, 1]) > 0.95
    fine = estimators.fine_classes(df, model, 3)
    assert fine.count() == 90 and fine.where("fine_class < 1").count() == 0
    mean, values, vectors = estimators.principal_axes(df, 2)
    assert np.allclose(mean, points.mean(0)) and np.allclose(values, np.sort(np.linalg.eigvalsh(np.cov(points.T, bias=True)))[::-1][:2])


def test_star_round_trip(spark, tmp_path):
    text = "\ndata_\n\nloop_\n_rlnImageName #1\n_rlnMicrographName #2\n_rlnDefocusU #3\n_rlnOdd #4\n0000001@stack.mrcs mic_b 10000.0 q\n0000002@stack.mrcs mic_a oops r\n"
    path = tmp_path / "in.star"
    path.write_text(text)
    df = star.read_star(spark, str(path))
    rows = df.orderBy("inner_id").collect()
    assert [(r.ImageName, r.DefocusU, r.extra["Odd"]) for r in rows] == [("0000001@stack.mrcs", 10000.0, "q"), ("0000002@stack.mrcs", 0.0, "r")]
    assert star.count_rows(spark, str(path)) == 2 and len(star.with_defaults(df).columns) == 43 + 2
    numbered = star.grouped(df.withColumn("GroupName", F.lit("g")))
    assert {r.MicrographName: r.GroupNumber for r in numbered.collect()} == {"mic_a": 1, "mic_b": 2}
    star.write_star(df, str(tmp_path / "out"))
    back = star.read_star(spark, str(tmp_path / "out"))
    assert [r.ImageName for r in back.orderBy("inner_id").collect()] == [r.ImageName for r in rows]
    (tmp_path / "one.star").write_text("data_\nloop_\n_rlnImageName #1\n0000001@stack.mrcs\n")
    with pytest.raises(ValueError):
        star.read_star(spark, str(tmp_path / "one.star"))


def test_model_blocks_round_trip(spark, tmp_path):
    blocks = {"data_model_general": [{"ReferenceDimensionality": "2", "Sigma": "0.5"}], "data_model_classes": [{"ReferenceImage": "1@a.mrcs", "ClassDistribution": "0.25"}, {"ReferenceImage": "2@a.mrcs", "ClassDistribution": "0.75"}]}
    assert star.parse_blocks(star.format_blocks(blocks)) == blocks
    star.write_model(spark, blocks, str(tmp_path / "model"))
    found = star.read_model(spark, str(tmp_path / "model"))
    assert found["data_model_classes"].count() == 2
    (tmp_path / "plan.txt").write_text("# fine\n1,3\nnothing\n2, 5\n")
    assert [tuple(r) for r in star.read_class_list(spark, str(tmp_path / "plan.txt")).orderBy("class_no").collect()] == [(1, 3), (2, 5)]


def test_stacks_round_trip(spark, tmp_path):
    images = np.random.default_rng(7).normal(size=(10, 8, 8)).astype(np.float32)
    mrcs, dat, back = (str(tmp_path / n) for n in ("a.mrcs", "a.dat", "b.mrcs"))
    stacks.write_mrc(mrcs, images)
    stacks.convert(mrcs, dat)
    stacks.convert(dat, back)
    assert np.array_equal(stacks.read_mrc(back), images)
    swapped = tmp_path / "be.mrc"
    raw = np.frombuffer(open(mrcs, "rb").read(), "<i4")
    swapped.write_bytes(raw.astype(">i4").tobytes())
    assert np.array_equal(stacks.read_mrc(str(swapped)), images)
    got = stacks.read_stacks(spark, [mrcs], slice_images=3)
    assert all(np.array_equal(np.array(r.pixels, np.float32), images[r["index"] - 1].ravel()) for r in got.collect())
    named = spark.createDataFrame([(f"{i:07d}@{mrcs}",) for i in (2, 7)], "ImageName string")
    assert stacks.join_images(named, got).count() == 2
    with pytest.raises(ValueError):
        stacks.convert(mrcs, "x.png")


def test_streaming_sums_equal_a_batch(spark, tmp_path):
    images, labels, _ = blobs(4, 30)
    df = table_of(spark, images, weight=np.ones(30)).withColumn("class_no", F.col("id") % 3)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    accumulate.accumulate(stream, str(tmp_path / "sums"), str(tmp_path / "ck")).awaitTermination()
    got = {(r.class_no, r.p): r.average for r in accumulate.class_averages(spark, str(tmp_path / "sums")).collect()}
    for k in range(3):
        mean = images[k::3].reshape(10, -1).sum(0) / (10 + 0.01)
        assert all(abs(got[k, p] - mean[p]) < 1e-9 for p in range(16))


def test_grids_and_groups(spark):
    assert healpix.centres(1).shape == (48, 2)
    v = healpix.centres(2)
    unit = np.stack([np.cos(np.radians(v[:, 0])) * np.sin(np.radians(v[:, 1])), np.sin(np.radians(v[:, 0])) * np.sin(np.radians(v[:, 1])), np.cos(np.radians(v[:, 1]))], 1)
    assert np.abs(unit.mean(0)).max() < 1e-9 and len(np.unique(unit.round(6), axis=0)) == 192
    assert [len(sampling.point_group(g)) for g in ("C1", "C4", "D3", "T", "O", "I")] == [1, 4, 6, 12, 24, 60]
    grid = healpix.directions(spark, 1)
    assert sampling.asymmetric_unit(grid, "C", 2).count() in range(24, 30)
    with pytest.raises(ValueError):
        sampling.asymmetric_unit(grid, "Q")


def test_more_kernels():
    rng = np.random.default_rng(8)
    y, x = np.mgrid[:16, :16] - 8
    image = np.exp(-((x - 2) ** 2 + y**2) / 8)
    assert np.corrcoef(kernels.rotate_fourier(image, 90)[2:14, 2:14].ravel(), kernels.rotate(image, 90)[2:14, 2:14].ravel())[0, 1] > 0.98
    flat = kernels.elliptical_low_pass(rng.normal(size=(16, 16)), 2, 4)
    assert flat.std() < 0.8
    data, weight = rng.normal(size=(8, 8, 8)) + 0j, np.ones((8, 8, 8))
    total, heavy = kernels.symmetrise(data, weight, sampling.point_group("C2"))
    assert total[4, 4, 4] == pytest.approx(2 * data[4, 4, 4]) and heavy[4, 4, 4] == pytest.approx(2)
    h = kernels.hermitian(data)
    assert np.allclose(h[1:, 1:, 1:], np.conj(h[1:, 1:, 1:][::-1, ::-1, ::-1]))
    uneven = np.where(x[:8, :8, None] + np.zeros(8) > -4, 4.0, 1.0)
    even = kernels.gridding_weights(uneven)
    assert (even * uneven).std() < uneven.std() / 4
    assert (kernels.wiener_weights(weight, np.full(4, 0.5), 1) >= weight).all()
    assert kernels.spline_zoom(np.sin(np.arange(9) / 2), (17,))[::2] == pytest.approx(np.sin(np.arange(9) / 2))


def test_symmetry_files_reports_and_state(spark, tmp_path):
    from lumenfold.sources import reports

    assert len(reports.parse_symmetry("rot_axis 3 0 0 1 ; z\n# none\nmirror_plane 0 0 1\n")) == 6
    assert len(reports.parse_symmetry("D4")) == 8
    counts = healpix.directions(spark, 0).withColumn("n", F.col("pixel") + 1)
    lines = [r.line for r in reports.orientation_lines(counts).collect()]
    assert len(lines) == 12 and all(".cylinder" in line for line in lines)
    assert "open #0 a.mrc" in reports.viewer_script("a.mrc", "r.mrc", 3, 9)
    for i in (1, 2, 2):
        reports.save_state(spark, str(tmp_path / "state"), i, {"w": np.arange(6.0).reshape(2, 3) * i}, {"sigma2": 0.5})
    last, arrays, values = reports.load_state(spark, str(tmp_path / "state"))
    assert last == 2 and np.array_equal(arrays["w"], np.arange(6.0).reshape(2, 3) * 2) and values == {"sigma2": 0.5}


def test_priors_and_units(spark):
    grid = healpix.directions(spark, 2)
    priors = spark.createDataFrame([(1, 0.0, 45.0), (2, 100.0, 90.0)], "id int, prior_rot double, prior_tilt double")
    near = sampling.near_prior(priors, 2, 5.0)
    assert near.groupBy("id").agg(F.sum("weight").alias("s")).where("abs(s - 1) > 1e-9").count() == 0
    assert sampling.near_prior(priors, 2, 1e-3).count() == 2
    z, a, b = np.array([0, 0, 1.0]), np.array([1.0, 0, 1]), np.array([1.0, 1, 1])
    assert 0 < sampling.half_space_unit(grid, sampling.unit_planes([z, a, b])).count() < 30
    assert abs(sampling.perturbed(0.0, 10.0, 0.7, 1)) <= 2.5


def test_deep_2d_gives_every_image_a_node(spark, sf_dir):
    from lumenfold.plans import estimator_queries
    from lumenfold.sources.tables import images

    got = estimator_queries.deep_2d(spark, sf_dir).collect()
    ids = [r.vec_id for r in images(spark, sf_dir).select("vec_id").collect()]
    assert sorted(r.vec_id for r in got) == sorted(ids)
    assert len({r.class_no for r in got}) > 1 and all(1 <= r.node <= 5 for r in got)


def unit_vectors(angles):
    rot, tilt = np.radians(np.asarray(angles)).T
    return np.stack([np.cos(rot) * np.sin(tilt), np.sin(rot) * np.sin(tilt), np.cos(tilt)], 1)


@pytest.mark.parametrize("order", [0, 1, 3])
def test_pixels_by_columns_and_arrays(spark, order):
    rows = healpix.with_ring(healpix.directions(spark, order), "pixel", order, "ring")
    found = healpix.with_pixel(rows, "rot", "tilt", order, "back").orderBy("pixel").toPandas()
    assert (found.back == found.pixel).all() and sorted(found.ring) == list(range(12 * 4**order))
    assert np.allclose(unit_vectors(found[["rot", "tilt"]]), unit_vectors(healpix.centres(order)))
    by_ring = found.sort_values("ring")
    assert (np.diff(by_ring.tilt) > -1e-9).all() and ((np.diff(by_ring.rot) > 0) | (np.diff(by_ring.tilt) > 1e-9)).all()


def test_pixels_at_poles_and_edges(spark):
    rows = spark.createDataFrame([(r, t) for r in (-720.0, -45.0, 0.0, 90.0, 359.999, 360.0) for t in (0.0, 1e-7, 48.189685, 90.0, 131.81, 180.0)], "rot double, tilt double")
    found = healpix.with_pixel(rows, "rot", "tilt", 2).toPandas()
    assert found.pixel.between(0, 191).all()
    near = unit_vectors(healpix.centres(2)[found.pixel]) * unit_vectors(found[["rot", "tilt"]])
    assert (near.sum(1) > np.cos(np.radians(15))).all()


def test_pixel_neighbours():
    for order in (1, 2):
        around = healpix.neighbours(order)
        assert (around < 0).sum() == 24 and (around < 0).sum(1).max() == 1
        assert all(i in around[j] for i, row in enumerate(around) for j in row if j >= 0)
        v = unit_vectors(healpix.centres(order))
        fine = unit_vectors(healpix.centres(order + 3)).reshape(len(v), -1, 3)
        for i, row in enumerate(around):
            gap = np.degrees(np.arccos(np.clip((fine[i] @ fine.reshape(-1, 3).T).max(0), -1, 1))).reshape(len(v), -1).min(1)
            far = np.setdiff1d(np.arange(len(v)), [*row, i])
            assert gap[far].min() > 29.0 / 2**order


def test_near_prior_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    draws = [(i, float(r), float(t)) for i, (r, t) in enumerate(zip(rng.uniform(-180, 180, 60), np.degrees(np.arccos(rng.uniform(-1, 1, 60)))))] + [(60, 10.0, 0.0), (61, 0.0, 180.0)]
    priors = spark.createDataFrame(draws, "id int, prior_rot double, prior_tilt double")
    for sigma in (0.01, 2.0, 9.0, 30.0):
        got = {(r.id, r.pixel): r.weight for r in sampling.near_prior(priors, 3, sigma).collect()}
        angle = np.degrees(np.arccos(np.clip(unit_vectors([d[1:] for d in draws]) @ unit_vectors(healpix.centres(3)).T, -1, 1)))
        want = {(i, int(k)) for i, row in enumerate(angle) for k in np.flatnonzero(row <= 3 * sigma)}
        lone = {i for i in range(62)} - {i for i, _ in want}
        assert want <= set(got) and {i for i, _ in set(got) - want} == lone and len(got) == len(want) + len(lone)


def test_star_with_long_headers_earlier_blocks_and_null_groups(spark, tmp_path):
    names = ["ImageName", "MicrographName", "DefocusU", *[f"Own{i}" for i in range(240)]]
    body = [" ".join([f"{i:07d}@s.mrcs", f"m{i % 7}", str(1000.0 + i), *[f"{i}_{k}" for k in range(240)]]) for i in range(50)]
    text = ["# " + "x" * 80] * 300 + ["data_optics", "loop_", "_rlnVoltage #1", "_rlnMagnification #2", "300 50000", "", "data_particles", "loop_"]
    text += [f"_rln{n} #{i + 1}" for i, n in enumerate(names)] + body + ["", "after the body @s.mrcs is nothing"]
    (tmp_path / "a.star").write_text("\n".join(text) + "\n")
    got = star.read_star(spark, str(tmp_path / "a.star")).orderBy("inner_id").collect()
    assert [r.DefocusU for r in got] == [1000.0 + i for i in range(50)] and got[9].extra["Own239"] == "9_239" and len(got[0].extra) == 240
    rows = spark.createDataFrame([(i, f"{i:07d}@a.mrcs", f"m{i % 3}", None if i % 4 == 0 else f"g{i % 2}") for i in range(400)], "inner_id long, ImageName string, MicrographName string, GroupName string")
    star.write_star(rows.repartition(5), str(tmp_path / "out"), ["ImageName", "MicrographName"])
    files = [p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")]
    assert files == ["part-00000.txt"]
    back = star.read_star(spark, str(tmp_path / "out")).orderBy("inner_id").collect()
    assert [r.ImageName for r in back] == [f"{i:07d}@a.mrcs" for i in range(400)]
    numbered = star.grouped(rows)
    assert numbered.count() == 400 and numbered.select("GroupNumber").distinct().count() == 3


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from lumenfold import session

    conf = SimpleNamespace(get=lambda *a: None)
    context = SimpleNamespace(getConf=lambda: conf, master="spark://host:7077")
    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_dir(SimpleNamespace(sparkContext=context, conf=conf))


def test_map_em_likelihood_grows_and_classes_are_found(spark):
    images, labels, kinds = blobs(8, 90, 3)
    plane = map_em.Plane(8)
    rng = np.random.default_rng(1)
    ctf = 0.6 + 0.4 * np.cos(np.outer(1 + np.arange(90) % 3, plane.kx**2 + plane.ky**2) / 9)
    seen = np.stack([plane.image(t * c) for t, c in zip(plane.transform(images.reshape(90, -1)), ctf)])
    rows = [(i, [float(v) for v in seen[i].ravel()], [float(v) for v in ctf[i]], i % 2) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, pixels array<double>, ctf array<double>, g int").repartition(3)
    model = map_em.classify(df, 2, 8, ctf="ctf", group="g", seed=4)
    assert all(b >= a - 1e-6 * abs(a) for a, b in zip(model.history, model.history[1:]))
    match = [[np.corrcoef(r.ravel(), k.ravel())[0, 1] for k in kinds] for r in model.images]
    assert max(match[0]) > 0.95 and max(match[1]) > 0.95 and np.argmax(match[0]) != np.argmax(match[1])
    found = map_em.assign(df, model, [(0.0, 0.0, 0.0)], ctf="ctf", group="g").orderBy("id").select("found.*").collect()
    same = np.mean([r.class_no == found[0].class_no for r in found] == (labels == labels[0]))
    assert max(same, 1 - same) > 0.97
    averages = map_em.class_averages(df.withColumn("k", F.col("id") % 2 + 1).withColumn("w", F.lit(0.5)), 2, "k", "w")
    assert np.allclose(averages[0].ravel(), 0.5 * seen[::2].sum(0).ravel() / (0.5 * 45 + 0.01), atol=0.02)


def test_map_em_second_pass_and_poses(spark):
    rng = np.random.default_rng(2)
    y, x = np.mgrid[:12, :12] - 6
    kind = np.exp(-((x - 1.5) ** 2 / 2 + (y + 1) ** 2 / 6)) + 0.5 * np.exp(-((x + 2) ** 2 + (y - 2) ** 2))
    moves = [(rng.choice([0.0, 90.0, 180.0, 270.0]), float(rng.integers(-1, 2)), float(rng.integers(-1, 2))) for _ in range(40)]
    images = [estimators.posed(kind, m) + rng.normal(0, 0.03, (12, 12)) for m in moves]
    df = table_of(spark, images)
    coarse = map_em.classify(df, 1, 5, step=90.0, reach=1.5, shift=1.0)
    fine = map_em.classify(df, 1, 5, step=90.0, reach=1.5, shift=1.0, order=1)
    for model in (coarse, fine):
        assert all(np.isfinite(model.history)) and 0 < model.pmax[-1] <= 1
    w = np.array([[0.6, 0.3995, 0.0004, 0.0001], [0.25, 0.25, 0.25, 0.25]])
    assert map_em.significant(w).tolist() == [[True, True, False, False], [True] * 4]
    poses, parent = map_em.children([(0.0, 0.0, 0.0), (90.0, 1.0, 0.0)], 90.0, 1.0, 1)
    assert len(poses) == 16 and (np.bincount(parent) == 8).all() and abs(np.mean([p[0] for p in poses[:8]])) < 1e-9


def test_latent_map_with_factors_equals_one_without(spark):
    rng = np.random.default_rng(7)
    points = rng.normal(size=(60, 6))
    df = spark.createDataFrame([(i, [float(v) for v in p], [1.0] * 6, [2.0] * 6, [float(2 * v) for v in p]) for i, p in enumerate(points)], "id long, pixels array<double>, one array<double>, two array<double>, double array<double>")
    plain = estimators.fit_latent_map(df, 4, 3)
    assert np.allclose(estimators.fit_latent_map(df, 4, 3, ctf="one").nodes, plain.nodes)
    assert estimators.latent_basis([3, 4], 2).shape == (12, 2 * 3 + 1)
    with pytest.raises(ValueError):
        estimators.latent_basis([3, 4], 1)


def test_leading_axes_by_projection(spark, monkeypatch):
    rng = np.random.default_rng(9)
    points = rng.normal(size=(80, 30)) * np.array([9.0, 5.0, 3.0, *[0.3] * 27]) @ np.linalg.qr(rng.normal(size=(30, 30)))[0]
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(points)], "id long, pixels array<double>")
    whole = estimators.principal_axes(df, 3)
    monkeypatch.setattr(estimators, "EXACT_PIXELS", 8)
    part = estimators.principal_axes(df, 3)
    assert np.allclose(whole[1], part[1], rtol=1e-4) and np.allclose(np.abs((whole[2] * part[2]).sum(0)), 1, atol=1e-3)


def test_local_test_against_whole_windows():
    from lumenfold.operators import local_resolution as lr

    rng = np.random.default_rng(4)
    volume = rng.normal(size=(9, 8, 8))
    w, basis, reach = lr.kernels(3.0, 1.0)
    test, rest = lr.correlations(volume, w, basis, reach)
    size = 2 * reach + 1
    rows = np.lib.stride_tricks.sliding_window_view(volume, (size,) * 3).reshape(-1, size**3)
    constant = np.sqrt(w)[:, None] / np.linalg.norm(np.sqrt(w))
    inner = basis / np.where(w > 0, np.sqrt(w), 1)[:, None]
    assert np.allclose(inner.T @ inner, np.eye(basis.shape[1]), atol=1e-8) and np.allclose(inner[:, :1], constant)
    assert np.allclose(test.ravel(), ((rows @ basis[:, 1:]) ** 2).sum(1))
    assert np.allclose(rest.ravel(), (rows**2 @ w) - ((rows @ basis) ** 2).sum(1))


def test_state_files_by_field(spark, tmp_path):
    from lumenfold.sources import state

    spectra = {"ReferenceTau2": np.arange(10.0).reshape(2, 5)}
    state.write_model_state(spark, str(tmp_path / "m"), 8, np.array([0.25, 0.75]), np.ones((1, 5)), ["only"], [7], np.array([1.5]), spectra, np.full((2, 12), 1 / 12), LogLikelihood=-3.25)
    got = state.read_model_state(spark, str(tmp_path / "m"))
    assert got["general"]["LogLikelihood"] == -3.25 and got["general"]["NrClasses"] == 2 and got["group_names"] == ["only"] and got["group_sizes"] == [7]
    assert np.array_equal(got["spectra"]["ReferenceTau2"], spectra["ReferenceTau2"]) and got["shares"].tolist() == [0.25, 0.75]
    with pytest.raises(ValueError, match="no sampling field"):
        state.write_sampling(spark, str(tmp_path / "s"), np.zeros((1, 2)), Nothing=1)
    with pytest.raises(ValueError, match="NumberOfIterations"):
        state.write_optimiser(spark, str(tmp_path / "o"), "run", 1)


def test_noise_masks_and_small_numerics():
    from lumenfold.functions import numerics

    image = np.full((16, 16), 5.0)
    a, b = (kernels.noise_mask(image, 4.0, 1.0, np.full(9, 0.5 / 256), s) for s in (1, 2))
    assert a[8, 8] == 5.0 and np.array_equal(a, kernels.noise_mask(image, 4.0, 1.0, np.full(9, 0.5 / 256), 1)) and not np.array_equal(a, b)
    outside = kernels.grid(16) > 5
    assert 0.6 < np.concatenate([a[outside], b[outside]]).std() < 1.5
    assert numerics.grid_peak(lambda c: -((c[0] - 37) ** 2) - (c[1] - 3) ** 2, [(0, 64), (0, 16)]) == ((37, 3), 0)
    low, high = numerics.bracket(lambda v: (v - 40) ** 2, 0.0, 1.0)
    assert low < 40 < high and numerics.clear_peaks([0, 3, 0, 2, 0, 5, 0], 2.5) == [1, 5] and numerics.clear_peaks([0, 3, 0, 2, 0], 0, 3) == [1]
    assert numerics.convolve(np.array([1.0, 2, 3]), np.array([1.0, 1])).tolist() == [1, 3, 5, 3]


def test_star_writes_what_differs_from_the_defaults(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"{i}@a.mrcs", "" if i % 2 else None, i % 3) for i in range(9)], "inner_id long, ImageName string, GroupName string, ClassNumber int")
    star.write_star(star.with_defaults(rows).withColumn("DefocusU", F.lit(5.0)), str(tmp_path / "a"))
    back = star.read_star(spark, str(tmp_path / "a"))
    assert set(back.columns) == {"inner_id", "ImageName", "ClassNumber", "DefocusU", "DefocusAngle", "extra"}
    assert [r.ClassNumber for r in back.orderBy("inner_id").collect()] == [i % 3 for i in range(9)]
    star.write_star(rows.withColumn("GroupName", F.when(F.col("inner_id") > 4, "g")), str(tmp_path / "b"))
    assert [r.GroupName for r in star.read_star(spark, str(tmp_path / "b")).orderBy("inner_id").collect()] == [""] * 5 + ["g"] * 4


def test_map_em_finds_a_volume(spark):
    rng = np.random.default_rng(5)
    n = 10
    z, y, x = np.mgrid[:n, :n, :n]
    truth = sum(np.exp(-((x - a) ** 2 + (y - b) ** 2 + (z - c) ** 2) / 3) for a, b, c in ((4, 5, 3), (7, 4, 5), (5, 7, 6)))
    directions, plane = healpix.centres(0), map_em.Plane(n)
    ctf = [0.5 + 0.5 * np.cos((plane.kx**2 + plane.ky**2) * (1 + i % 3) / 20) for i in range(72)]
    images = []
    for i in range(72):
        f = plane.transform(kernels.project(truth, estimators.euler(*directions[i % 12], 60.0 * (i % 6))).ravel()[None])[0] * ctf[i]
        images.append(kernels.translate(plane.image(f), *[(1, 0), (0, -1), (0, 0)][i % 3]) + rng.normal(0, 0.05, (n, n)))
    rows = [(i, [float(v) for v in im.ravel()], [float(v) for v in ctf[i]], i % 2) for i, im in enumerate(images)]
    df = spark.createDataFrame(rows, "id long, pixels array<double>, ctf array<double>, g int").repartition(2)
    first = truth * 0.5 + rng.normal(0, 0.02, truth.shape)
    noise = map_em.start(df, 1, 2, group="g").sigma2
    model = map_em.classify_volumes(df, map_em.Volumes(first[None], np.ones(1), noise), directions, 3, 60.0, 1.0, 1.0, tau2_fudge=4.0, cc_first=True, ctf="ctf", group="g")
    assert np.corrcoef(model.volumes[0].ravel(), truth.ravel())[0, 1] > 0.9 and model.history[2] > model.history[1] and model.shares[0] == 1
    assert 0.7 < (model.volumes[0] * truth).sum() / (truth**2).sum() < 1.3


def test_pictures(tmp_path):
    from lumenfold.sources import pictures

    images = np.arange(5 * 9.0).reshape(5, 3, 3)
    shown = pictures.montage(images, 2)
    assert shown.shape == (9, 6) and shown[0, 0] == 0 and shown[2, 2] == 255 and not shown[6:, 3:].any()
    pictures.write_bmp(str(tmp_path / "a.bmp"), shown[:, :5])
    assert np.array_equal(pictures.read_bmp(str(tmp_path / "a.bmp")), shown[:, :5])
    pictures.write_tiff(str(tmp_path / "a.tif"), [pictures.grey(i) for i in images])
    pages = pictures.read_tiff(str(tmp_path / "a.tif"))
    assert len(pages) == 5 and all(np.array_equal(p, pictures.grey(i)) for p, i in zip(pages, images))
    assert not pictures.grey(np.ones((2, 2))).any()


@pytest.mark.parametrize("name, unit, n", [("C4", "C", 4), ("C2", "C", 2), ("D2", "D", 2)])
def test_seams_hold_no_equivalents(spark, name, unit, n):
    part = sampling.asymmetric_unit(healpix.directions(spark, 2), unit, n)
    operations = sampling.point_group(name)
    kept = sampling.thinned_seams(part, operations, 2).toPandas()
    before = part.toPandas().sort_values("pixel")
    v, pixel, gone = unit_vectors(before[["rot", "tilt"]]), before.pixel.to_numpy(), set()
    for i in range(len(v)):
        for r in operations:
            gone |= {int(pixel[i]) for j in np.flatnonzero(np.linalg.norm(v - r @ v[i], axis=1) < 1e-6) if pixel[j] < pixel[i]}
    assert set(kept.pixel) == set(pixel.tolist()) - gone and (name != "C2" or gone)
