from pyspark.sql import functions as F

from fringeworks.operators.simulate import observed_rows
from fringeworks.sources import parset, store, text
from fringeworks.sources.driver_tables import table


def test_vis_store_round_trip_and_update(spark, sf_dir, tmp_path):
    vis = table(spark, sf_dir, "vis").limit(500)
    path = str(tmp_path / "a.vis")
    store.write_vis(vis, path)
    back = store.read_vis(spark, path)
    assert back.count() == 500 and back.where("ms IS NULL OR sigma_spectrum IS NOT NULL").count() == 0
    one = back.where("scan = 3").withColumn("flag", F.lit(True)).select(*vis.columns)
    store.replaced_partition(spark.createDataFrame(one.collect(), one.schema), path, "scan")
    again = store.read_vis(spark, path)
    assert again.count() == 500 and again.where("scan = 3 AND NOT flag").count() == 0


def test_wide_and_long(spark):
    rows = [(r, c, float(c), -float(c), c == 2) for r in range(3) for c in range(4)]
    long = spark.createDataFrame(rows, "row_id int, chan int, re double, im double, flag boolean")
    back = store.to_long(store.to_wide(long, ["row_id"]), ["row_id"])
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_cube_round_trip(spark, tmp_path):
    rows = [("i", 0, c, x, y, float(x + 10 * y + 100 * c)) for c in range(2) for x in range(4) for y in range(3)]
    px = spark.createDataFrame(rows, "image string, pol int, chan int, x int, y int, value double")
    store.write_cube(px, str(tmp_path / "cube"))
    assert sorted(map(tuple, store.read_cube(spark, str(tmp_path / "cube")).select("image", "pol", "chan", "x", "y", "value").collect())) == sorted(rows)


def test_gain_and_scan_files(spark, tmp_path):
    g = spark.createDataFrame([("g11", 3, 0, 1.25, -0.5), ("g22", 4, 1, 0.0, 2.0)], "kind string, antenna int, beam int, re double, im double")
    text.write_gains(g, str(tmp_path / "gains"))
    assert sorted(map(tuple, text.read_gains(spark, str(tmp_path / "gains")).collect())) == sorted(map(tuple, g.collect()))
    (tmp_path / "scans.txt").write_text("0 1.0 2.0\n5 2.5 3.0\n\n")
    assert sorted(map(tuple, text.read_scans(spark, str(tmp_path / "scans.txt")).collect())) == [(0, 86400.0, 172800.0), (5, 216000.0, 259200.0)]


def test_selection_from_a_parset(spark, sf_dir):
    vis = table(spark, sf_dir, "vis")
    got = parset.selection(parset.parse("beams = [0, 1]\nscans = [2]\nchannels = [0, 8]"))(vis).count()
    assert got == vis.where("feed1 IN (0, 1) AND feed2 IN (0, 1) AND scan = 2 AND chan BETWEEN 0 AND 7").count()


def test_simulated_rows(spark):
    a = spark.createDataFrame([(i, float(i), float(i * i), 0.0) for i in range(5)], "antenna int, x double, y double, z double")
    assert observed_rows(spark, a, 3, 1.0, 2, -0.5).count() == 3 * 2 * 10
    assert observed_rows(spark, a, 3, 1.0, 2, -0.5, autocorrelations=True).count() == 3 * 2 * 15


def test_worker_paths():
    assert store.rank_paths("a%w.ms", 2) == ["a0.ms", "a1.ms"] and store.rank_paths("a.ms", 2) == ["a.ms"]


def test_command_line(spark, sf_dir, tmp_path):
    from fringeworks import cli

    store.write_vis(table(spark, sf_dir, "vis").limit(300), str(tmp_path / "a.vis"))
    (tmp_path / "split.in").write_text(f'dataset = "{tmp_path}/a.vis"\nout = "{tmp_path}/out"\nbeams = [0, 1, 2]\nchannel = [1, 16]\nwidth = 4\nnchan = 16\n')
    assert cli.main(["split", str(tmp_path / "split.in")]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).where("out_chan NOT BETWEEN 0 AND 3").count() == 0
    assert cli.main(["nothing"]) == 2
