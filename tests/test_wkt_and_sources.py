"""Parsing, readers, writers, generators and streams."""

import pytest
from pyspark.sql import functions as F

from loomspace.functions.wkt import format_point, with_geometry, wkt_box, wkt_point
from loomspace.operators.joins import rjoin_pairs
from loomspace.plans import apps
from loomspace.sources import generators, readers
from loomspace.streaming.ranges import stream_pairs, stream_range_filter

TEXTS = {
    "POINT(1.5 2)": (1.5, 2.0, 1.5, 2.0), " point (  1.5e0\t+2.0 ) ": (1.5, 2.0, 1.5, 2.0), "SRID=4326;POINT Z (1 2 9)": (1.0, 2.0, 1.0, 2.0), "Point(-0.0 0)": (0.0, 0.0, 0.0, 0.0),
    "POLYGON ((3 1, 3 5, 0 5, 0 1, 3 1))": (0.0, 1.0, 3.0, 5.0), "polygon((0 1,3 1,3 5,0 5,0 1))": (0.0, 1.0, 3.0, 5.0),
    "POINT(180 90)": (180.0, 90.0, 180.0, 90.0), "POINT(.5 -.5)": (0.5, -0.5, 0.5, -0.5),
    "POINT EMPTY": None, "": None, None: None, "POINT(1)": None, "POINT(1 abc)": None, "POINT(1 2": None, "PONT(1 2)": None, "POINT(NaN 1)": None, "POINT(inf 0)": None, "POINT(1 1e400)": None,
    "1;2": None, "POINT(181 0)": None, "POLYGON((0 0, 1 1))": None, "POLYGON((0 0, 1 0, 300 1, 0 1, 0 0))": None, "POINT(1, )": None, "null": None, "POINT(" + "1" * 100_000 + " 2)": None,
}


def test_spellings(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "id long, geom string").withColumn("geometry", F.lit("x")).withColumn("x1", F.lit("x"))
    got = {r["id"]: tuple(r["geometry"])[:4] for r in with_geometry(df, "geom").collect()}
    assert got == {i: v for i, v in enumerate(TEXTS.values()) if v}
    same = {r["id"]: tuple(r["g"])[:4] for r in df.select("id", wkt_box(F.col("geom")).alias("g")).filter("g IS NOT NULL").collect()}
    assert same == got
    points = {r["id"] for r in with_geometry(df, "geom", points_only=True).collect()}
    assert points == {r["id"] for r in df.select("id", wkt_point(F.col("geom")).alias("g")).filter("g IS NOT NULL").collect()} == {i for i, (t, v) in enumerate(TEXTS.items()) if v and "point" in t.lower()}
    assert with_geometry(df.limit(0), "geom").count() == 0


def test_parse_runs_once_for_each_text(spark):
    df = with_geometry(spark.createDataFrame([("POINT(1 2)",)], "geom string"), "geom").filter("geometry.x1 > 0").select("geometry.x1", "geometry.y2")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract(") <= 3


def test_text_sources(spark, tmp_path):
    def written(name, lines):
        (tmp_path / name).write_text("\n".join(lines))
        return str(tmp_path / name)

    wkt = written("wkt", ["POINT (1 2)", "bad", "POINT(3.5 -4)", "POLYGON((9 9, 9 1, 2 3, 2 9, 9 9))", ""])
    assert {tuple(r) for r in readers.read_wkt_points(spark, wkt).collect()} == {(1.0, 2.0, "1"), (3.5, -4.0, "1")}
    assert readers.read_wkt_query_points(spark, wkt).columns == ["x", "y"]
    assert [tuple(r) for r in readers.read_wkt_boxes(spark, wkt).collect()] == [(9.0, 9.0, 2.0, 3.0)]
    lat = written("lat", ["2,1,hello", "x,1,no", "4, 3 ,", "5,6"])
    assert {tuple(r) for r in readers.read_lat_lon_text(spark, lat).collect()} == {(1.0, 2.0, "hello"), (3.0, 4.0, "")}
    xy = written("xy", ["1,2,hi", "3,4", "bad"])
    assert {tuple(r) for r in readers.read_xy_text(spark, xy).collect()} == {(1.0, 2.0, "hi"), (3.0, 4.0, "xxxx")}
    readers.csv_to_wkt(spark, lat, str(tmp_path / "out"))
    assert {tuple(r)[:2] for r in readers.read_wkt_points(spark, str(tmp_path / "out")).collect()} == {(1.0, 2.0), (3.0, 4.0), (6.0, 5.0)}
    readers.write_wkt(readers.from_rows(spark, [(1.25, -2.0, "a"), (None, 1.0, "b")]), str(tmp_path / "again"))
    assert {tuple(r)[:2] for r in readers.read_wkt_points(spark, str(tmp_path / "again")).collect()} == {(1.25, -2.0)}
    readers.sample_and_rewrite(spark, written("ws", ["a  b c", "d e", "f g h"]), str(tmp_path / "sampled"), 1.0, 2)
    assert {r[0] for r in spark.read.text(str(tmp_path / "sampled")).collect()} == {"c,b,a", "h,g,f"}


def test_roundtrip_of_coordinates(spark):
    df = spark.createDataFrame([(1, 0.1, -33.333), (2, 1e-7, 89.99999), (3, None, 1.0)], "id long, x float, y float")
    back = with_geometry(df.select("id", "x", "y", format_point(F.col("x"), F.col("y")).alias("line")), "line")
    assert back.filter("x = geometry.x1 AND y = geometry.y1").count() == 2


def test_apps(spark, tmp_path):
    (tmp_path / "p").write_text("POINT(1 1)\nPOINT(2 2)\nPOINT(9 9)")
    (tmp_path / "b").write_text("POLYGON((0 0, 0 3, 3 3, 3 0, 0 0))\nPOLYGON((50 50, 50 51, 51 51, 51 50, 50 50))")
    (tmp_path / "t").write_text("1,1,An Apple\n2,2,pear\n80,80,apple")
    at = lambda n: str(tmp_path / n)
    assert sorted(r["n"] for r in apps.range_join(spark, at("p"), at("b")).collect()) == [0, 2]
    assert apps.nearest_join(spark, at("p"), at("p"), 2).count() == 6
    assert apps.text_range(spark, at("t"), (0, 0, 5, 5), ["APPLE"]).count() == 1
    assert [r["value"] for r in apps.nearest_of(spark, at("t"), 2.0, 2.0, 2).collect()] == ["pear", "An Apple"]


def test_generators(spark):
    u = generators.uniform_points(spark, 1000, 3000, 100, 5, 7)
    low = u.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    assert 5 <= low[0] and low[1] < 3005 and 7 <= low[2] and low[3] < 107
    assert u.exceptAll(generators.uniform_points(spark, 1000, 3000, 100, 5, 7)).count() == 0
    g = generators.gaussian_points(spark, 20000, (6.0, 6.0)).agg(F.avg("x"), F.var_samp("x"), F.var_samp("y"), F.covar_samp("x", "y")).first()
    assert abs(g[0] - 6) < 1.5 and abs(g[1] / 1000 - 1) < 0.1 and abs(g[2] / 3000 - 1) < 0.1 and abs(g[3]) < 60
    assert generators.random_boxes(spark, 500, 100, 50, 3).filter("x2 < x1 OR y2 < y1 OR x2 - x1 > 3.001").count() == 0


def test_streams(spark, tmp_path):
    rows = [(i, float(i % 7), float(i % 5)) for i in range(50)]
    data = spark.createDataFrame(rows, "id long, x float, y float")
    data.write.parquet(str(tmp_path / "in"))
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 2.0), (2, 1.0, 1.0, 6.0, 1.0), (3, 5.0, 5.0, 1.0, 1.0)], "bid long, x1 float, y1 float, x2 float, y2 float")
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    for name, made, want in (("a", stream_range_filter(stream, (0, 0, 2, 2)), data.filter("x <= 2 AND y <= 2").select("id")), ("b", stream_pairs(stream, boxes), rjoin_pairs(data, boxes).select("id", "bid"))):
        q = made.writeStream.format("memory").queryName(f"out_{name}").option("checkpointLocation", str(tmp_path / f"cp_{name}")).start()
        q.processAllAvailable()
        q.stop()
        got = spark.table(f"out_{name}").select(*want.columns)
        assert got.count() > 0 and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


@pytest.mark.parametrize("missing", ["x", "y"])
def test_null_coordinates_format_to_null(spark, missing):
    df = spark.createDataFrame([(None if missing == "x" else 1.0, None if missing == "y" else 1.0)], "x float, y float")
    assert df.select(format_point(F.col("x"), F.col("y"))).first()[0] is None
