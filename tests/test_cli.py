"""The command line on a small stack."""

import numpy as np
import pytest

from lumenfold import cli
from lumenfold.functions import images as kernels
from lumenfold.operators import estimators
from lumenfold.operators.healpix import centres
from lumenfold.sources import stacks, star


@pytest.fixture
def data(tmp_path):
    rng = np.random.default_rng(0)
    y, x = np.mgrid[:8, :8]
    kinds = [np.exp(-((x - 2) ** 2 + (y - 3) ** 2) / 3), np.exp(-((x - 5) ** 2 + (y - 5) ** 2) / 3)]
    images = np.stack([kinds[i % 2] + rng.normal(0, 0.1, (8, 8)) for i in range(60)]).astype(np.float32)
    stacks.write_mrc(str(tmp_path / "s.mrcs"), images)
    rows = "".join(f"{i + 1:07d}@s.mrcs mic_{i % 3} {2 * (i % 2) + 1} 0.5 0.0 1.0 0.0\n" for i in range(60))
    labels = ["ImageName", "MicrographName", "ClassNumber", "MaxValueProbDistribution", "AnglePsi", "OriginX", "OriginY"]
    head = "data_\n\nloop_\n" + "".join(f"_rln{n} #{i + 1}\n" for i, n in enumerate(labels))
    (tmp_path / "in.star").write_text(head + rows)
    return tmp_path, images


def test_option_rules(tmp_path, capsys):
    more = tmp_path / "more"
    more.write_text("-o out")
    command, o = cli.parse(["sml", "--i", "a.star", "-K", "8", "-iter", "3", "-angpix", "1", "-nonsense", "5", "-pca", "-options", str(more)])
    assert command == "sml" and o["i"] == "a.star" and o["pca"] == "1" and o["o"] == "out" and o["alpha"] == "0.01"
    assert "nonsense" in capsys.readouterr().err
    with pytest.raises(cli.OptionError):
        cli.parse(["sml", "-i", "x"])
    with pytest.raises(cli.OptionError):
        cli.parse(["nothing"])


def test_table_commands(spark, data):
    path, images = data
    cli.run(["clean", "-i", f"{path}/in.star", "-o", f"{path}/clean.star"], spark)
    assert {r.ClassNumber for r in star.read_star(spark, f"{path}/clean.star").collect()} == {1, 2}
    cli.run(["select", "-i", f"{path}/in.star", "-o", f"{path}/sel.star", "-class", "3"], spark)
    chosen = star.read_star(spark, f"{path}/sel.star").orderBy("inner_id").collect()
    assert [r.ImageName for r in chosen] == [f"{i + 1:07d}@sel.mrcs" for i in range(30)]
    assert np.allclose(stacks.read_mrc(f"{path}/sel.mrcs"), images[1::2])
    cli.run(["classaverage", "-i", f"{path}/in.star", "-o", f"{path}/avg.mrcs", "-K", "3", "-angpix", "1"], spark)
    got = stacks.read_mrc(f"{path}/avg.mrcs")
    assert np.allclose(got[0], 0.5 * images[::2].sum(0) / (0.5 * 30 + 0.01), atol=1e-5) and not got[1].any()
    cli.run(["adjust", "-i", f"{path}/in.star", "-o", f"{path}/adj"], spark)
    assert np.allclose(stacks.read_mrc(f"{path}/adj.mrcs")[0][1:7, 1:7], np.roll(images[0], 1, 1)[1:7, 1:7], atol=1e-5)
    assert star.read_star(spark, f"{path}/adj.star").where("OriginX <> 0").count() == 0


def test_estimator_commands(spark, data, capsys):
    path, _ = data
    cli.run(["map2d", "-i", f"{path}/in.star", "-o", f"{path}/m", "-K", "2", "-iter", "6", "-angpix", "1", "-tau2_fudge", "1", "-oversampling", "0", "-psi_step", "360", "-offset_range", "0"], spark)
    classes = [r.ClassNumber for r in star.read_star(spark, f"{path}/m.star").orderBy("ImageName").collect()]
    assert len(classes) == 60 and classes[::2].count(classes[0]) > 27 and classes[1::2].count(classes[1]) > 27 and {*classes} == {1, 2}
    cli.run(["sml", "-i", f"{path}/in.star", "-o", f"{path}/g", "-K", "4", "-iter", "3", "-angpix", "1"], spark)
    assert stacks.read_mrc(f"{path}/g.mrcs").shape == (4, 8, 8)
    cli.run(["sml", "-i", f"{path}/in.star", "-o", f"{path}/two", "-K", "3,4", "-iter", "2", "-angpix", "1", "-dimension", "2"], spark)
    assert stacks.read_mrc(f"{path}/two.mrcs").shape == (12, 8, 8)
    (path / "fine.txt").write_text("# class,k\n1,3\n3,4\n")
    cli.run(["sml", "-i", f"{path}/in.star", "-o", f"{path}/f", "-K", "3", "-iter", "2", "-angpix", "1", "-search", f"{path}/fine.txt"], spark)
    fine = star.read_star(spark, f"{path}/f_fine.star").collect()
    assert len(fine) == 60 and max(r.ClassNumber for r in fine) <= 7 and min(r.ClassNumber for r in fine) >= 1
    cli.run(["convert", "-i", f"{path}/g.mrcs", "-o", f"{path}/g.dat"])
    cli.run(["desc", "-i", f"{path}/g.mrcs"])
    assert "shape (4, 8, 8)" in capsys.readouterr().out


def test_map2d_with_transfer_functions_and_a_second_pass(spark, tmp_path):
    rng = np.random.default_rng(6)
    n, pixel = 16, 4.0
    y, x = np.mgrid[:n, :n]
    kinds = [np.exp(-((x - 6) ** 2 + (y - 7) ** 2) / 4), np.exp(-((x - 10) ** 2 / 9 + (y - 9) ** 2 / 3))]
    defocus = [12000.0 + 3000 * (i % 5) for i in range(80)]
    seen = [np.fft.irfft2(np.fft.rfft2(kinds[i % 2]) * kernels.ctf_image(n, pixel, d, d, 0.0), s=(n, n)) for i, d in enumerate(defocus)]
    stacks.write_mrc(str(tmp_path / "s.mrcs"), (np.stack(seen) + rng.normal(0, 0.05, (80, n, n))).astype(np.float32))
    labels = ["ImageName", "MicrographName", "GroupName", "DefocusU", "DefocusV", "DefocusAngle", "Voltage", "SphericalAberration", "AmplitudeContrast"]
    rows = "".join(f"{i + 1:07d}@s.mrcs mic_{i % 4} g{i % 2 + i % 3} {d} {d} 0.0 300.0 2.7 0.1\n" for i, d in enumerate(defocus))
    (tmp_path / "in.star").write_text("data_\n\nloop_\n" + "".join(f"_rln{k} #{i + 1}\n" for i, k in enumerate(labels)) + rows)
    options = ["map2d", "-i", f"{tmp_path}/in.star", "-o", f"{tmp_path}/m", "-K", "2", "-iter", "8", "-angpix", "4", "-tau2_fudge", "4", "-oversampling", "1", "-psi_step", "360", "-offset_range", "1", "-offset_step", "1", "-ctf", "1", "-norm", "1"]
    cli.run(options, spark)
    found = star.read_star(spark, f"{tmp_path}/m.star").orderBy("inner_id").collect()
    classes = [r.ClassNumber for r in found]
    assert classes[::2].count(classes[0]) > 36 and classes[1::2].count(classes[1]) > 36 and classes[0] != classes[1]
    assert all(0 < r.MaxValueProbDistribution <= 1 and r.NrOfSignificantSamples >= 1 for r in found)
    # references are free of the transfer function
    got = stacks.read_mrc(f"{tmp_path}/m.mrcs")[classes[0] - 1]
    assert np.corrcoef(got.ravel(), kinds[0].ravel())[0, 1] > 0.8


def test_map3d_searches_shifts_and_fine_angles(spark, tmp_path):
    rng = np.random.default_rng(5)
    z, y, x = np.mgrid[:12, :12, :12]
    truth = sum(np.exp(-((x - a) ** 2 + (y - b) ** 2 + (z - c) ** 2) / 3) for a, b, c in ((5, 6, 4), (8, 5, 6), (6, 8, 7)))
    views = [(*centres(0)[i % 12], 60.0 * (i % 6)) for i in range(36)]
    moved = [kernels.translate(kernels.project(truth, estimators.euler(*v)), *[(2, 0), (0, -2), (0, 0)][i % 3]) for i, v in enumerate(views)]
    stacks.write_mrc(str(tmp_path / "s.mrcs"), (np.stack(moved) + rng.normal(0, 0.01, (36, 12, 12))).astype(np.float32))
    stacks.write_mrc(str(tmp_path / "ref.mrc"), truth.astype(np.float32))
    head = "data_\n\nloop_\n_rlnImageName #1\n_rlnMicrographName #2\n"
    (tmp_path / "in.star").write_text(head + "".join(f"{i + 1:07d}@s.mrcs mic_0\n" for i in range(36)))
    options = ["map3d", "-i", f"{tmp_path}/in.star", "-o", f"{tmp_path}/v", "-ref", f"{tmp_path}/ref.mrc", "-K", "1", "-iter", "4", "-angpix", "1", "-healpix_order", "0", "-offset_step", "2", "-offset_range", "2"]
    cli.run(options, spark)
    volume = stacks.read_mrc(f"{tmp_path}/v_class001.mrc")
    assert np.corrcoef(volume.ravel(), truth.ravel())[0, 1] > 0.9
    cli.run([*options[:8], "1", "-iter", "2", *options[11:], "-sym", "C2", "-firstiter_cc"], spark)
    turned = stacks.read_mrc(f"{tmp_path}/v_class001.mrc")[1:, 1:, 1:]
    assert np.corrcoef(turned.ravel(), turned[:, ::-1, ::-1].ravel())[0, 1] > 0.97
    with pytest.raises(cli.OptionError):
        cli.run([*options, "-norm", "1"], spark)


def test_reconstruct_with_transfer_functions_and_symmetry(spark, tmp_path):
    rng = np.random.default_rng(8)
    n, pixel = 12, 4.0
    z, y, x = np.mgrid[:n, :n, :n]
    one = np.exp(-((x - 8) ** 2 + (y - 6) ** 2 + (z - 5) ** 2) / 3) + 0.6 * np.exp(-((x - 7) ** 2 + (y - 8) ** 2 + (z - 7) ** 2) / 3)
    truth = one.copy()
    truth[:, 1:, 1:] += one[:, :0:-1, :0:-1]  # two-fold about z
    views = [(*d, psi) for d in centres(1) for psi in (0.0, 45.0)]
    defocus = [12000.0 + 3000 * (i % 5) for i in range(len(views))]
    seen = [np.fft.irfft2(np.fft.rfft2(kernels.project(truth, estimators.euler(*v))) * kernels.ctf_image(n, pixel, d, d, 0.0), s=(n, n)) for v, d in zip(views, defocus)]
    stacks.write_mrc(str(tmp_path / "s.mrcs"), (np.stack(seen) + rng.normal(0, 0.01, (len(views), n, n))).astype(np.float32))
    labels = ["ImageName", "MicrographName", "AngleRot", "AngleTilt", "AnglePsi", "DefocusU", "DefocusV", "DefocusAngle", "Voltage", "SphericalAberration", "AmplitudeContrast"]
    rows = "".join(f"{i + 1:07d}@s.mrcs mic_0 {v[0]} {v[1]} {v[2]} {d} {d} 0.0 300.0 2.7 0.1\n" for i, (v, d) in enumerate(zip(views, defocus)))
    (tmp_path / "in.star").write_text("data_\n\nloop_\n" + "".join(f"_rln{k} #{i + 1}\n" for i, k in enumerate(labels)) + rows)
    plain = ["reconstruct", "-i", f"{tmp_path}/in.star", "-angpix", "4", "-iter", "0"]
    found = {}
    for name, more in {"no": [], "ctf": ["-ctf", "1"], "all": ["-ctf", "1", "-sym", "c2", "-maxres", "9.6"]}.items():
        cli.run([*plain, "-o", f"{tmp_path}/{name}.mrc", *more], spark)
        found[name] = np.corrcoef(stacks.read_mrc(f"{tmp_path}/{name}.mrc").ravel(), truth.ravel())[0, 1]
    assert found["ctf"] > 0.8 and found["all"] > 0.8 and abs(found["no"]) < found["ctf"]


@pytest.mark.parametrize(
    "command, wrong",
    [("sml", k) for k in (["-pca"], ["-precision", "1e-3"], ["-weightedsum", "0"], ["-K", "4,8"])]
    + [("reconstruct", ["-refdim", "2"]), ("map3d", ["-norm", "1"])],
)
def test_options_that_are_not_built_are_refused(command, wrong):
    needed = {k: "0" for k, v in cli.COMMANDS[command].items() if v is None}
    plain = [command, *[x for k, v in needed.items() for x in (f"-{k}", v)]]
    cli.refuse_unbuilt(*cli.parse(plain))
    with pytest.raises(cli.OptionError, match=wrong[0]):
        cli.run(plain + wrong)
