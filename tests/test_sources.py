"""Files: catalogues, manifests, cached signals, the chunk index."""

import json

from momentlens.sources import backends, files


def test_catalogue(spark, tmp_path):
    for name, n in (("b.mp4", 2000), ("a.MKV", 2000), ("c.mp4", 10), ("d.txt", 5000)):
        (tmp_path / name).write_bytes(b"x" * n)
    assert [r["name"] for r in files.catalogue(spark, str(tmp_path), least=1000).collect()] == ["a.MKV", "b.mp4"]
    assert [r["name"] for r in files.catalogue(spark, str(tmp_path), "*.mp4").collect()] == ["b.mp4", "c.mp4"]


def test_probe(spark):
    text = json.dumps({"format": {"duration": "12.5"}, "streams": [{"r_frame_rate": "0/0"}, {"r_frame_rate": "30000/1001", "width": 1920, "height": 1080}]})
    r = files.probed(spark.createDataFrame([(text,)], "json string")).first()
    assert (r["duration"], round(r["fps"], 2), r["width"]) == (12.5, 29.97, 1920)


def test_manifest_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("v", "B", 5.0, 9.0), ("v", "A", 0.0, 4.0)], "source string, label string, start double, end double")
    files.write_manifest(d, str(tmp_path / "m"), "source", ["label", "start", "end"], "start")
    assert [(r["source"], r["label"], r["start"]) for r in files.read_manifest(spark, str(tmp_path / "m")).orderBy("pos").collect()] == [("v", "A", 0.0), ("v", "B", 5.0)]


def test_signal_cache_is_incremental(spark, tmp_path):
    path = str(tmp_path / "signals")
    d = spark.createDataFrame([("a", "clip", 0, 1.0), ("a", "flow", 0, 2.0)], "asset string, signal string, idx int, value double")
    assert files.cache_signals(d, path) == 2
    assert files.cache_signals(d.unionByName(spark.createDataFrame([("b", "clip", 0, 3.0)], d.schema)), path) == 1
    assert files.cached_signals(spark, path, ["clip"]).count() == 2


def test_index_is_incremental(spark, tmp_path):
    path = str(tmp_path / "index")
    d = backends.embedded(spark.createDataFrame([("v", 0.0, 30.0), ("v", 25.0, 55.0)], "source string, start double, end double"), "source", backends.HashBackend(8))
    assert files.add_chunks(d, path, "m") == 2
    assert files.add_chunks(d, path, "m") == 0
    assert files.add_chunks(d, path, "other") == 2


def test_concat_list(spark, tmp_path):
    d = spark.createDataFrame([("b.mp4", 1), ("a'1.mp4", 0)], "file string, rank int")
    files.concat_list(d, str(tmp_path / "list"))
    lines = next((tmp_path / "list").glob("part-*")).read_text().splitlines()
    assert len(lines) == 2 and lines[1] == "file 'b.mp4'" and lines[0].startswith("file 'a'")


def test_enriched_manifest(spark, tmp_path):
    d = spark.createDataFrame([("v", "B", 5.0, 9.0), ("v", "A", 0.0, 4.0)], "source string, label string, start double, end double")
    files.write_manifest(d, str(tmp_path / "m"), "source", ["label", "start", "end"], "start")
    files.enrich_manifest(spark, str(tmp_path / "m"), spark.createDataFrame([("B", 0.25)], "label string, focal_x double"), str(tmp_path / "out"))
    got = files.read_manifest(spark, str(tmp_path / "out")).orderBy("pos").collect()
    assert [(r["label"], r["start"], r["focal_x"]) for r in got] == [("A", 0.0, 0.5), ("B", 5.0, 0.25)]


def test_report_round_trip(spark, sf, tmp_path):
    from momentlens.queries.report_queries import _reports

    d = _reports(spark, sf)
    files.write_report(d, str(tmp_path / "report"))
    back = files.read_report(spark, str(tmp_path / "report"))
    assert back.schema.simpleString() == d.schema.simpleString() and sorted(map(str, back.collect())) == sorted(map(str, d.collect()))


def test_index_rows_name_their_source(spark, tmp_path):
    d = backends.embedded(spark.createDataFrame([("/films/v.mp4", 0.0, 30.0)], "source string, start double, end double"), "source", backends.HashBackend(8))
    files.add_chunks(d, str(tmp_path / "index"), "m")
    r = spark.read.parquet(str(tmp_path / "index")).first()
    assert (r["source_name"], r["duration"], r["model"]) == ("v.mp4", 30.0, "m")
