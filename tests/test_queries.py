import pytest

import __spark_entry__ as entry
from tests.conftest import SF
from tests.oracle import assert_same
from tessera.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, name):
    df = registry.QUERIES[name](spark, SF)
    if name in registry.ORACLE:
        assert_same(df, registry.ORACLE[name], SF)
    else:
        assert df.count() > 0


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_graph_and_ranking_queries_cover_every_start(spark):
    ids = lambda table, key, mark="": {f"{mark}{r[0]}" for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).distinct().collect()}
    starts = lambda name, key: {str(r[0]) for r in registry.QUERIES[name](spark, SF).select(key).distinct().collect()}
    assert starts("G2_neighbourhood_all", "start") == ids("orders", "o_orderkey", "o")
    assert starts("G4_greedy_context", "start") == ids("customer", "c_custkey", "c")
    assert starts("S6_K2_ranking_round_trip_all", "src") == ids("lineitem", "l_orderkey")


def test_histogram_counts_every_pair_and_the_edges(spark):
    from tessera.sources import sinks

    got = registry.QUERIES["K16_histogram_all"](spark, SF).collect()
    assert sum(r.n for r in got) == registry.view(spark, SF, "pairs").count() and {r.bin for r in got} <= set(range(1, 11))
    values = spark.createDataFrame([(i / 10,) for i in range(11)] + [(-0.1,), (1.01,), (None,)], "x double")
    assert {r.bin: r.n for r in sinks.histogram(values, "x", 0.0, 1.0, 10).collect()} == {0: 1, **{b: 1 for b in range(1, 10)}, 10: 2, 11: 1}
