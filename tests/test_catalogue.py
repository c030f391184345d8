"""Queries against their SQL, and what lies around them: registry, sources, streams, command line."""

from __future__ import annotations

import json
import os
import struct
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tests.oracle import connect, difference
from veracast.plans import catalogue, registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUICK = "tab_missing tab_uniqueness tab_outliers tab_correlation tab_kanonymity tab_uniformity_brand tab_tv_similarity tab_ks_similarity tab_coherence_kendall feat_precision feat_recall_instances feat_mmd_linear ts_uniqueness ts_crosscorr img_brightness coco_completeness coco_uniqueness prep_profile prep_encode prep_impute_mode prep_row_to_text metric_catalogue metric_selection stream_windows".split()


@pytest.mark.parametrize("name", QUICK)
def test_query_agrees_with_sql(spark, name):
    said = difference(catalogue.queries()[name](spark, SF), connect(SF), catalogue.oracle_sql()[name])
    assert not said or said.startswith("(close"), said


def test_every_query_has_a_name_and_most_have_sql():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries()) and len(catalogue.oracle_sql()) > 70


def test_selection(spark):
    all_ = registry.registry(spark)
    got = registry.select(all_, "tabular", "input_val", "none", "dataset", groups="privacy").collect()
    assert [r.name for r in got] == ["KAnonymityScore"]
    assert registry.select(all_, "text", "input_val").count() == 0
    assert registry.select_named(all_, ["DTW", "MMD"], "time_series", "synthesis_val").count() == 2
    with pytest.raises(registry.NotFound):
        registry.select_named(all_, ["DTW"], "tabular", "synthesis_val")
    assert len({(e[3]) for e in registry.ENTRIES}) == 45 and len(registry.ENTRIES) == 59


def test_report(spark):
    one = spark.createDataFrame([("a", None, 1.0), (None, "mean", 2.0)], "key string, stat string, value double")
    two = spark.createDataFrame([("x", "instance", 3.0), ("y", "instance", 4.0)], "key string, stat string, value double")
    out = registry.report(registry.evaluate({"One": lambda: one, "Two": lambda: two}), 2, ["x", "y"])
    assert out["dataset_level"]["raw_data_metrics"]["One"] == {"dtype": "numeric", "subtype": "float", "value": 1.0, "stats": {"mean": 2.0}}
    assert out["instance_level"]["raw_data_metrics"]["Two"]["value"] == [3.0, 4.0] and out["instance_level"]["instance_names"] == ["x", "y"] and out["errors"] is None
    json.dumps(out)
    with pytest.raises(registry.NotImplemented_):
        registry.evaluate({})


def test_tables_from_files(spark, tmp_path):
    from veracast.sources.tables import read_table

    (tmp_path / "a").mkdir()
    (tmp_path / "a/t.csv").write_text("x,y\n1,a\n2,b\n")
    (tmp_path / "t.json").write_text(json.dumps({"schema": {"fields": []}, "data": [{"x": 1, "y": "a"}, {"x": 2, "y": None}]}))
    (tmp_path / "t.xml").write_text("<data><row><x>1</x><y>a</y></row><row><x>2</x></row></data>")
    for path in ("a/t.csv", "t.json", "t.xml", "a"):
        df = read_table(spark, str(tmp_path / path))
        assert df.columns == ["x", "y"] and sorted(r.x for r in df.collect()) == [1, 2]
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        read_table(spark, str(tmp_path / "none"))


def test_waveforms(spark, tmp_path):
    from veracast.sources.signals import read_headers, read_signals

    (tmp_path / "g").mkdir()
    (tmp_path / "g/R1.hea").write_text("R1 2 500 3\nR1.mat 16x1+4 1000.0(0)/mv 16 0 -1 2 0 I\nR1.mat 16x1+4 500.0(10)/mv 16 0 -1 2 0 II\n# Age: 62\n# Sex: Female\n# Dx: 1,22\n")
    (tmp_path / "g/R1.mat").write_bytes(b"head" + struct.pack("<6h", 1000, 510, 2000, 10, -500, 260))
    h = read_headers(spark, str(tmp_path)).first()
    assert (h.record, h.n_sig, h.fs, h.n_samples, h.leads, h.age, h.sex, h.dx) == ("R1", 2, 500, 3, ["I", "II"], 62, "Female", ["1", "22"])
    got = {(r.channel, r.t): r.v for r in read_signals(spark, str(tmp_path)).collect()}
    assert got == {(0, 0): 1.0, (1, 0): 1.0, (0, 1): 2.0, (1, 1): 0.0, (0, 2): -0.5, (1, 2): 0.5}


def test_pictures_from_files(spark, tmp_path):
    from veracast.sources.images import listed_images, read_images

    def bmp(path, pixels):  # rows from the bottom, blue first
        h, w = len(pixels), len(pixels[0])
        pad = -w * 3 % 4
        body = b"".join(b"".join(bytes(p[::-1]) for p in row) + bytes(pad) for row in pixels[::-1])
        path.write_bytes(b"BM" + struct.pack("<IHHI", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 0, 0, 0, 0) + body)

    bmp(tmp_path / "p.bmp", [[(255, 0, 0), (0, 255, 0)], [(0, 0, 255), (9, 8, 7)]])
    (tmp_path / "bad.png").write_bytes(b"nothing")
    got = read_images(spark, str(tmp_path)).collect()
    assert [(r.image, r.height, r.width, bytes(r.data)) for r in got] == [("p", 2, 2, bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 9, 8, 7]))]
    (tmp_path / "list.jsonl").write_text(json.dumps({"image": str(tmp_path / "p.bmp")}) + "\n")
    assert listed_images(spark, str(tmp_path / "list.jsonl")).count() == 1


def test_streams_agree_with_tables(spark, tmp_path):
    from veracast.streaming import windows

    rows = [(f"2024-01-0{d} 0{h}:00:00", t, v) for d in (1, 2) for h in range(4) for t, v in (("a", float(h)), ("b", None), ("a", 2.0))]
    df = spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
    updates = windows.run_available(windows.quality_by_window(stream, late="30 days"), str(tmp_path / "out"))
    got = windows.latest(updates, ["start", "event_type"])
    want = windows.quality_by_window(df)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and want.count() == 4


def test_command_line(spark, tmp_path):
    from veracast import cli

    (tmp_path / "t.csv").write_text("a,b,c\n" + "".join(f"{i},{i % 7},{i * 0.5}\n" for i in range(60)))
    (tmp_path / "u.csv").write_text("a,b,c\n" + "".join(f"{i},{(i + 1) % 7},{i * 0.4}\n" for i in range(60)))
    out = cli.audit(spark, "tabular", "input_val", str(tmp_path / "t.csv"))
    metrics = out["dataset_level"]["raw_data_metrics"]
    assert out["dataset_level"]["num_instances"] == 60 and metrics["DimCurseScore"]["value"] == 20.0 and metrics["MissingScore"]["stats"]["row_mean"] == 0.0
    out = cli.audit(spark, "tabular", "synthesis_val", str(tmp_path / "u.csv"), str(tmp_path / "t.csv"), ["StatisticalSimScore", "CoherenceScore"])
    assert set(out["dataset_level"]["raw_data_metrics"]) == {"StatisticalSimScore", "CoherenceScore"}
    with pytest.raises(registry.NotFound):
        cli.audit(spark, "tabular", "input_val", str(tmp_path / "t.csv"), metrics=["None"])
    with pytest.raises(registry.BadInput):
        cli.audit(spark, "tabular", "synthesis_val", str(tmp_path / "t.csv"))


def test_entry_imports_without_the_corpus_operators():
    code = "import sys\nclass No:\n  def find_spec(self, name, path=None, target=None):\n    if name.startswith('veracast.llm'): raise ModuleNotFoundError(name, name=name)\nsys.meta_path.insert(0, No())\nimport __spark_entry__ as e\nassert 'tab_missing' in e.queries() and not any(n.startswith('op') for n in e.queries())"
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=here)
