"""The command, and stored exact neighbours."""

import pytest

from lanternfish.__main__ import main
from lanternfish.operators.exact import exact_graph
from lanternfish.operators.prep import uniform_points
from lanternfish.operators.truth import ground_truth, ground_truths


def test_command(spark, tmp_path):
    out = str(tmp_path / "graph")
    found = main(["--points", "300", "--k", "5", "--trees", "2", "--min-leaf", "8", "--max-leaf", "24", "--out", out], spark)
    assert found["neighbours"] == 1500 == spark.read.parquet(out).count()
    with pytest.raises(SystemExit):
        main(["--data", "csv"], spark)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_ground_truth_is_written_once_and_sliced(spark, tmp_path):
    points = uniform_points(spark, 60, 3)
    path = str(tmp_path / "truth")
    want = rows(exact_graph(points, 4))
    assert rows(ground_truth(points, path, 4, 8)) == want
    assert rows(ground_truth(points.limit(0), path, 4, 8)) == want  # read, not found again
    for k, own in ((9, False), (4, True)):
        with pytest.raises(ValueError):
            ground_truth(points, path, k, 20, own)
    several = ground_truths({"a": points, "none": points.limit(0)}, str(tmp_path), 4, 8)
    assert rows(several["a"]) == want and rows(several["none"]) == []
