from pathlib import Path

from pyspark.sql import functions as F

from tessera.operators import selector as L
from tests.test_selector import rows


def test_search_writes_what_it_reads_and_deletes_it(spark):
    folder = Path(spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://"))
    left = lambda: {p for p in folder.rglob("part-*")}
    data = [r for i in range(40) for r in [(f"s{i}", f"t{i}", 0.8 + i % 3 / 30, 1.0, 1.0), (f"s{i}", f"x{i}", 0.78, 0.0, 0.3), (f"n{i}", f"y{i}", 0.4, 0.0, 0.3)]]
    refs = spark.createDataFrame([(f"s{i}", f"t{i}") for i in range(40)] + [("s1", "t1"), ("s2", None), ("z", "t1")], "src string, tgt string")
    frame = L.frame(rows(spark, data)).withColumn("unread", F.lit("u" * 1000))
    assert {(r.src, r.tgt, r.label) for r in L.labelled(frame, refs).collect()} == {(s, t, int(t[0] == "t")) for s, t, *_ in data}
    before = left()
    choice = L.choose(frame, refs, folds=1, backgrounds=(0.1, 0.5), resolves=(False,), grid=[0.3, 0.5, 0.7])
    assert choice.metrics["f1"] == 1.0 and [t["background"] for t in choice.trials] == [0.1, 0.5]
    assert left() == before
