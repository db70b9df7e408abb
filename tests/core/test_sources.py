import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In

from sparkspec.config import Clustering
from sparkspec.operators import standards
from sparkspec.sources import formats, readers, writers


def test_spectra_csv_round_trip(spark, tmp_path):
    d = tmp_path / "in" / "S1"
    d.mkdir(parents=True)
    (d / "Data.csv").write_text('Spectrum #,Frame ID,Particle #,x,y,Fe_at%,O_at%,Fe_w%,O_w%,An er w%,r_squared,redchi_sq,Quant_flag,Comments,Spectrum\n1,A0,,0.100,0.200,40.12,59.88,70.0,30.0,-1.5,0.99,1.2,0,"ok, fine","[0,1,2.5]"\n2,A0,3,0.1,0.2,,,,,,,,2,,"[]"\n')
    rows = readers.read_spectra(spark, f"file://{tmp_path}/in/S1").orderBy("spectrum_id").collect()
    assert rows[0].sample_id == "S1" and rows[0].at_fr == pytest.approx({"Fe": 0.4012, "O": 0.5988}) and rows[0].an_err == pytest.approx(-0.015)
    assert rows[0].counts == [0, 1, 2.5] and rows[0].comments == "ok, fine" and rows[0].particle_id is None and rows[0].cluster_id is None
    assert rows[1].at_fr is None and rows[1].w_fr is None and rows[1].particle_id == 3 and rows[1].quant_flag == 2
    table = writers.spectra_table(readers.read_spectra(spark, f"file://{tmp_path}/in/S1"), ["Fe", "O"], spark.createDataFrame([("S1", 1, 0)], "sample_id string, spectrum_id long, cluster_id int"))
    assert "Background" not in table.columns and "Cluster_ID" in table.columns
    writers.write_csv(table, f"file://{tmp_path}/out")
    again = readers.read_spectra(spark, f"file://{tmp_path}/out", "S1").orderBy("spectrum_id").collect()
    assert again[0].at_fr == rows[0].at_fr and again[0].counts == rows[0].counts and again[0].cluster_id == 0
    with pytest.raises(Exception):
        writers.write_csv(table, f"file://{tmp_path}/out")


def test_msa(spark, tmp_path):
    (tmp_path / "a.msa").write_text("#FORMAT : EMSA\n#NPOINTS : 4\n#OFFSET : 5\n#XPERCHAN : 10\n#SPECTRUM : data\n1.0,\nfoo\n2\n3\n#ENDOFDATA :\n")
    r = readers.read_msa(spark, f"file://{tmp_path}/a.msa").first()
    assert r.counts == [1, 2, 3, 0] and r.energy == [5, 15, 25, 35] and r.meta["FORMAT"] == "EMSA"


def test_sample_dir(spark, tmp_path):
    for d in ("x/S1", "x/y/S2"):
        (tmp_path / d).mkdir(parents=True)
        (tmp_path / d / "Data.csv").write_text("a\n")
    root = f"file://{tmp_path}/x"
    assert readers.sample_dir(spark, root, "S1").endswith("x/S1") and readers.sample_dir(spark, root, "S2").endswith("x/y/S2")
    with pytest.raises(FileNotFoundError):
        readers.sample_dir(spark, root, "S3")
    (tmp_path / "x/y/S1").mkdir()
    (tmp_path / "x/y/S1/Data.csv").write_text("a\n")
    with pytest.raises(ValueError):
        readers.sample_dir(spark, root, "S1")


def test_standards_library_round_trip(spark, tmp_path):
    entry = lambda i, pb, use: {"ID": i, "Formula": "Fe", "Std_type": "bulk", "datetime": "d", "Corrected_PB": pb, "Measured_PB": pb, "Stdev_PB": 1.0, "Use_for_mean_calc": use, "Mean_Z": {"Z": 26.0}}
    (tmp_path / "EDS_Stds_15keV.json").write_text(json.dumps({"point": {"Fe_Ka1": [entry("a", 10.0, True), entry("b", 20.0, True), {"ID": "Mean", "datetime": "d", "Corrected_PB": 1.0, "Stdev_PB": 0.0}]}}))
    lib = readers.read_standards(spark, f"file://{tmp_path}/EDS_Stds_15keV.json", 15.0)
    assert sorted((r.std_id, r.beam_kev) for r in lib.collect()) == [("a", 15), ("b", 15)]
    means = standards.standard_means(lib, ["mode", "el_line"])
    text = json.loads(writers.standards_json(lib, means).first().value)
    assert [e["ID"] for e in text["point"]["Fe_Ka1"]] == ["a", "b", "Mean"] and text["point"]["Fe_Ka1"][2]["Corrected_PB"] == 15.0


def test_latest_calibration(spark, tmp_path):
    at = f"file://{tmp_path}/cal"
    for stamp, off in (("20240101", 0.1), ("20250101", 0.25)):
        writers.detector_calibration(spark, at, "point", 4.3, off, 0.0100000049, stamp)
    rows = readers.read_detector_calibrations(spark, f"{at}/*")
    assert {(r.mode, r.offset, r.scale) for r in rows.collect()} == {("point", 0.1, 0.01), ("point", 0.25, 0.01)}
    with pytest.raises(ValueError):
        readers.check_mode("map", ["point"])


def test_clustering_info_has_null_not_nan():
    assert json.loads(writers.clustering_info(3, 2, 1, 0.5, None, {"clustering_cfg": {"k": Clustering().k}}, "t"))["sil_score"] is None


def test_particles_and_histogram(spark):
    from sparkspec.operators import stats

    df = spark.createDataFrame([(i, "A", float(i)) for i in range(1, 11)] + [(11, "A", None)], "particle_id long, frame_id string, diameter double")
    r = stats.particle_statistics(df, ["frame_id"]).first()
    assert (r.n, r.mean, r.median) == (10, 5.5, 5.5) and r.d10 == pytest.approx(1.9) and r.stdev == pytest.approx(2.8722813)
    h = stats.histogram(df, "diameter", 3).orderBy("bin").collect()
    assert [x.n for x in h] == [3, 3, 4] and h[-1].hi == pytest.approx(10)
    assert [r.particle_id for r in stats.missing_particles(df, [1, 99]).collect()] == [99]
    assert stats.drop_particles(df, ids=[1], frames=["B"]).count() == 10


def test_images(spark):
    import numpy as np

    from sparkspec.operators import images

    mask = np.zeros((40, 60), bool)
    mask[5:12, 5:15] = True
    mask[7:9, 8:10] = False
    mask[12, 15] = True
    mask[30:38, 50:60] = True
    labels, g = images.components(mask.astype(np.uint8) * 255)
    assert labels.max() == 2 and g.loc[0, "area"] == 70 - 4 + 1 and tuple(g.loc[0, ["x0", "y0", "x1", "y1"]]) == (5, 5, 16, 13)
    assert images.fill_holes(mask)[8, 8] and images.label(mask, diagonal=False).max() == 3
    image = np.where(images.fill_holes(mask), 220, 10).astype(np.uint8)
    df = spark.createDataFrame([("i", 40, 60, 0.5, image.tobytes()), ("none", 0, 0, 0.5, b"")], "image_id string, height int, width int, pixel_size_um double, pixels binary")
    rows = images.segment_particles(df, least_um2=1.0).collect()
    assert len(rows) == 1 and rows[0].x0 >= 3 and rows[0].diameter_um == pytest.approx(2 * np.sqrt(rows[0].area_um2 / np.pi))
    yx = np.argwhere(images.erode(np.ones((31, 31), bool), 3))
    assert yx.min() == 3 and yx.max() == 27
    pts = np.argwhere(np.ones((20, 20)))
    near = images.random_spots(pts, 5, 4.0)
    assert len(near) == 5 and min(np.hypot(*(a - b)) for i, a in enumerate(near) for b in near[:i]) > 4
    assert len(images.even_spots(pts, 4)) == 4 and len(images.random_spots(pts[:3], 5, 100)) == 3
    bumps = np.zeros((50, 50), np.uint8)
    bumps[10:13, 10:13], bumps[35:38, 35:38] = 250, 240
    spots = images.peak_spots(bumps, np.ones((50, 50), int), n=3, threshold=100, radius=8)
    assert sorted(map(tuple, spots.tolist())) == [(11, 11), (36, 36)]
    with pytest.raises(ValueError):
        images.register_model("threshold_bright", lambda i, s: i)
    df = spark.createDataFrame([(1, float(x), float(y)) for y, x in pts], "p int, x double, y double")
    assert images.select_spots(df, ["p"], n=3, method="even").count() == 3


def _files(tmp_path):
    rng = np.random.default_rng(3)
    for s in ("S1", "S2", "S3"):
        (tmp_path / "m" / s).mkdir(parents=True)
        for i in range(4):
            head = "#FORMAT : EMSA\n#npoints : 5\n#OFFSET : -0.5\n#XPERCHAN : 10\n#TITLE : a : b\n#TITLE : last\n" if i else "no header\n"
            body = "".join(f"{rng.integers(0, 9)},\n" for _ in range(3 + i)) + "foo\n1_0\n 2.5e1 \r\n"
            (tmp_path / "m" / s / f"{i}.msa").write_text(head + "#SPECTRUM : data\n" + body + "#ENDOFDATA :\n")
    (tmp_path / "m" / "S1" / "notes.txt").write_text("x")
    return f"file://{tmp_path}/m"


def test_emsa_format_equals_the_reader(spark, tmp_path):
    root = _files(tmp_path)
    got = formats.load(spark, "emsa", root)
    want = {r.path.split("file:")[-1].lstrip("/"): (r.meta, r.energy, r.counts) for r in readers.read_msa(spark, f"{root}/*/*.msa").collect()}
    rows = got.collect()
    assert len(rows) == 12 and {r.path.lstrip("/"): (r.meta, r.energy, r.counts) for r in rows} == want
    some = got.where("sample_id in ('S1', 'S3') and spectrum_id = '2' and size(counts) > 1")
    assert sorted((r.sample_id, r.spectrum_id) for r in some.collect()) == [("S1", "2"), ("S3", "2")]
    narrow = formats.load(spark, "emsa", root, "spectrum_id string, meta map<string,string>").where("spectrum_id = '1'")
    assert [r.meta["TITLE"] for r in narrow.collect()] == ["last"] * 3 and narrow.columns == ["spectrum_id", "meta"]


def test_filters_choose_the_files(tmp_path):
    """Files that a filter by key leaves out are in no partition, and those of other filters are left to Spark."""
    from pyspark.sql.types import StringType, StructField, StructType

    root = _files(tmp_path)
    schema = StructType([StructField(c, StringType()) for c in ("sample_id", "spectrum_id")])
    reader = formats.EmsaReader(schema, {"path": root})
    other = EqualTo(("meta",), "x")
    assert list(reader.pushFilters([In(("sample_id",), ("S1", "S3")), EqualTo(("sample_id",), "S3"), EqualTo(("spectrum_id",), "2"), other, EqualTo(("spectrum_id", "x"), "1")])) == [other, EqualTo(("spectrum_id", "x"), "1")]
    parts = reader.partitions()
    assert [p[1:] for part in parts for p in part.paths] == [("S3", "2")] and list(reader.read(parts[0])) == [("S3", "2")]
    small = formats.EmsaReader(schema, {"path": root, "bytes": "200"})
    assert 3 < len(small.partitions()) <= 12 and sum(len(p.paths) for p in small.partitions()) == 12
    none = formats.EmsaReader(schema, {"path": root})
    list(none.pushFilters([EqualTo(("sample_id",), "S9")]))
    assert list(none.read(none.partitions()[0])) == []


def test_spectra_format_equals_the_reader(spark, tmp_path):
    for s, extra in (("S1", ""), ("S2", "Background,")):
        (tmp_path / s).mkdir()
        head = f"Spectrum #,Frame ID,Particle #,x,y,Fe_at%,O_at%,Fe_w%,O_w%,An er w%,r_squared,redchi_sq,Quant_flag,Comments,{extra}Spectrum\n"
        more = '"[1,2]",' if extra else ""
        (tmp_path / s / "Data.csv").write_text(head + f'1,A0,,0.100,0.200,40.12,59.88,70.0,30.0,-1.5,0.99,1.2,0,"ok, ""fine""\nand more",{more}"[0,1,2.5]"\n2,A0,3.0,0.1,0.2,,,nan,,,,,2,,{more}"[]"\n3,,,,,,,,,,,,,,{"," if extra else ""}\n')
    got = formats.load(spark, "spectra_csv", f"file://{tmp_path}")
    for s in ("S1", "S2"):
        want = readers.read_spectra(spark, f"file://{tmp_path}/{s}").select(*got.columns).orderBy("spectrum_id").collect()
        assert got.where(F.col("sample_id") == s).orderBy("spectrum_id").collect() == want
    assert got.select("comments").where("spectrum_id = 1 and sample_id = 'S2'").first().comments == 'ok, "fine"\nand more'


def test_clusters_of_an_analysis_folder(spark, tmp_path):
    (tmp_path / "Clusters.csv").write_text(",n_points,Fe_at%\n0,42,3.07\n1,1,0.36\n")
    at = f"file://{tmp_path}/Clusters.csv"
    (one,) = readers.read_clusters(spark, at, ignore=(1,)).collect()
    assert one.cluster_id == 0 and one.n_points == "42"
    with pytest.raises(ValueError):
        readers.read_clusters(spark, at)


def test_particles_of_image_files(spark, tmp_path):
    """Image files become rows, their particles sizes and statistics; a bright core is found inside a particle."""
    from sparkspec.operators.images import bright_regions
    from sparkspec.plans.analyze import particle_sizes

    image = np.zeros((80, 100), np.uint8)
    image[10:30, 10:30] = 200
    image[40:70, 50:90] = 180
    image[0:5, 0:5] = 250  # at the border
    (tmp_path / "i.raw").write_bytes(image.tobytes())
    rows = readers.read_images(spark, f"file://{tmp_path}/i.raw", 100, 80, 0.5)
    r = particle_sizes(rows).first()
    assert r.n == 2 and r.min == pytest.approx(2 * np.sqrt(400 * 0.25 / np.pi), rel=0.1) and r.max == pytest.approx(2 * np.sqrt(1200 * 0.25 / np.pi), rel=0.1)
    grain = np.full((90, 90), 50, np.uint8)
    grain[40:50, 40:50] = 220
    labels = bright_regions(grain, np.ones((90, 90), np.uint8), threshold=150, pixel_um=0.1, margin_um=1.0)
    assert labels.max() == 1 and (labels > 0).sum() == 100 and (labels[40:50, 40:50] > 0).all()
