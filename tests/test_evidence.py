from pyspark.sql import functions as F

from tessera.functions import providers
from tessera.operators import evidence as E


def test_item_matrix_and_links(spark):
    items = lambda rows: spark.createDataFrame(rows, "iri string, item string, rel_vec array<double>, nb_vec array<double>")
    s, t = items([("s", "i1", [1.0, 0.0], [1.0, 0.0]), ("s", "i2", [0.0, 1.0], [0.0, 1.0])]), items([("t", "j1", [1.0, 0.0], [0.0, 1.0]), ("t", "j2", [0.0, 0.0], [0.0, 2.0])])
    cells = E.item_matrix(spark.createDataFrame([("s", "t")], "src string, tgt string"), s, t)
    assert {(r.i, r.j): r.score for r in cells.collect()} == {("i1", "j1"): 0.5, ("i1", "j2"): 0.0, ("i2", "j1"): 0.5, ("i2", "j2"): 0.5}
    assert {r.i: r.score for r in E.best_support(cells).collect()} == {"i1": 0.5, "i2": 0.5}
    assert E.label_pair(cells).first().score == 0.5


def test_packets_and_attributions(spark):
    rows = [("s", "t", "src", "hierarchy", k, f"h{k}") for k in range(5)] + [("s", "t", "tgt", "object", 0, "o")]
    packet = E.evidence_packet(spark.createDataFrame(rows, "src string, tgt string, side string, channel string, pos int, text string")).first().packet
    assert packet == "src hierarchy: h0\nsrc hierarchy: h1\nsrc hierarchy: h2\ntgt object: o"
    loo = E.leave_one_out(spark.createDataFrame([("s", "t", 0.9, 0.6), ("s", "t", 0.9, 0.8), ("s", "t", 0.9, 0.95)], "src string, tgt string, full double, without double"))
    assert [round(r.attribution, 6) for r in loo.orderBy("without").collect()] == [0.75, 0.25, 0.0]


def test_metrics_and_encoding(spark):
    m = E.label_metrics(spark.createDataFrame([("a", ["x y", "z"]), ("b", [])], "iri string, labels array<string>")).orderBy("iri").collect()
    assert [(r.n_labels, r.words, r.max_words, r.avg_words) for r in m] == [(2, 3, 2, 1.5), (0, 0, 0, 0.0)]
    enc = providers.encode(spark.createDataFrame([("a", "same"), ("b", "same"), ("c", None)], "iri string, t string"), "t").orderBy("iri").collect()
    assert enc[0].vector == enc[1].vector and enc[2].vector is None
    grid = E.grid_trials({"a": spark.range(2), "b": spark.range(3)})
    assert grid.columns == ["a", "b"] and grid.count() == 6
