import json

import pytest
from pyspark.sql import functions as F

from sorimill.operators import measure
from sorimill.operators.normalize import normalize


def test_benchmark(spark, tmp_path):
    samples = measure.run_benchmark(spark, {"normalizer": ("사과 3개는 ", normalize)}, repeats=2, rows=3, sizes=(10, 25))
    rows = samples.collect()
    assert [(r.size, r.phase, r.turn) for r in rows] == [(10, "cold", 0), (10, "warm", 1), (10, "warm", 2), (25, "cold", 0), (25, "warm", 1), (25, "warm", 2)]
    assert all(r.seconds > 0 and r.peak_bytes > 0 for r in rows)
    measure.write_report(samples, f"{tmp_path}/report")
    report = [json.loads(x.value) for x in spark.read.text(f"{tmp_path}/report").collect()]
    assert sorted((r["size"], r["phase"], r["iterations"]) for r in report) == [(10, "cold", 1), (10, "warm", 2), (25, "cold", 1), (25, "warm", 2)]
    with pytest.raises(ValueError):
        measure.run_benchmark(spark, {}, repeats=0)


def test_corpus(spark):
    got = spark.createDataFrame([("가나다", 7), ("ab", 1)], "s string, n int").select(measure.corpus(F.col("s"), F.col("n")).alias("t")).collect()
    assert [r.t for r in got] == ["가나다가나다가", "a"]
