import json

import numpy as np
import pytest

from lanternfish.operators import exact, results
from lanternfish.sources import files
from lanternfish.streaming.lookup import stream_search


def test_fvecs(spark, tmp_path):
    x = np.random.default_rng(0).random((50, 3), np.float32)
    rows = np.concatenate([np.full((50, 1), 3, np.int32).view(np.float32), x], 1)
    rows.tofile(tmp_path / "a.fvecs")
    got = files.read_fvecs(spark, str(tmp_path / "a.fvecs")).orderBy("row").collect()
    assert np.allclose([r.vector for r in got], x)
    rows[7, 0] = np.array([4], np.int32).view(np.float32)[0]
    rows.tofile(tmp_path / "b.fvecs")
    with pytest.raises(Exception, match="different sizes"):
        files.read_fvecs(spark, str(tmp_path / "b.fvecs")).collect()


def test_csv_and_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,0.5,2\n0,1,3\n")
    assert sorted((r.label, r.vector) for r in files.read_csv(spark, str(tmp_path / "a.csv")).collect()) == [(0, [1.0, 3.0]), (1, [0.5, 2.0])]
    points = files.read_csv(spark, str(tmp_path / "a.csv"))
    files.write_text(points, str(tmp_path / "out"))
    assert sorted(r.vector for r in files.read_text(spark, str(tmp_path / "out")).collect()) == [[0.5, 2.0], [1.0, 3.0]]
    (tmp_path / "labels.txt").write_text("3\n4.0\n")
    assert sorted(r.label for r in files.read_labels(spark, str(tmp_path / "labels.txt")).collect()) == [3, 4]


def test_catalog(spark):
    sets = files.catalog(spark)
    assert sets["uniform"](10, 4).count() == 10 and len(sets["split_line"](10, 2).first().vector) == 2


def test_results(spark):
    rows = results.no_results(spark)
    for m, v in (("a", 1.0), ("a", 0.5), ("b", 1.0)):
        rows = results.add(rows, dataset="d", k=3, method=m, param_name="n", param_value=v, quality_name="recall", quality=v / 2, seconds=v)
    assert json.loads(results.to_json(rows))["d"]["3"]["a"]["n"]["recall"] == {"parameters": [0.5, 1.0], "quality": [0.25, 0.5], "time": [0.5, 1.0]}
    assert results.remove(rows, "a").count() == 1
    assert results.wide(rows).filter("param_value = 1").first().b_quality == 0.5


def test_stream(spark, tmp_path):
    base = files.uniform_points(spark, 30, 3)
    base.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(base.schema).parquet(str(tmp_path / "in"))
    got = []
    query = stream_search(stream, base, 2, lambda df, n: got.extend(df.collect()), str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, got)) == sorted(map(tuple, exact.exact_search(base, base, 2).collect()))
