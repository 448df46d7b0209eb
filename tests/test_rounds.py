import pytest

from tessera.llm import triejoin
from tessera.operators import graph as G


def test_closure_goes_to_any_depth(spark):
    chain = spark.createDataFrame([(f"n{i:02}", "r", f"n{i + 1:02}") for i in range(23)], "src string, rel string, dst string")
    got = {(r["sub"], r["sup"]): r.depth for r in G.closure(chain).collect()}
    assert got == {(f"n{i:02}", f"n{j:02}"): j - i for i in range(24) for j in range(i + 1, 24)}


def test_unfinished_components_are_an_error(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)], "a long, b long")
    with pytest.raises(RuntimeError):
        triejoin.connect(links, rounds=1)
    assert {tuple(r) for r in triejoin.connect(links).collect()} == {(i, 0) for i in range(1, 21)}
