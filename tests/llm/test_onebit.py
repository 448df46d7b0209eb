import numpy as np

from tessera.llm import onebit
from tests.conftest import SF01
from tests.oracle import assert_same


def brute(ids, vectors, queries, k):
    out = {}
    for i in queries:
        score = {j: float(np.dot(vectors[i], vectors[j])) for j in ids if j != i}
        out[i] = sorted(score, key=lambda j: (-score[j], j))[:k]
    return out


def test_query_equals_brute_force(spark):
    from tessera.llm.queries import OP1_SQL, op1_onebit_search

    assert_same(op1_onebit_search(spark, SF01), OP1_SQL, SF01)


def test_recall_over_small_blocks(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(600, 32))
    v[100:160] = v[7]  # ties
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    v = v.astype(np.float32).astype(np.float64)
    want = brute(range(600), v, range(0, 600, 20), 10)
    got = {}
    for r in onebit.search(df, lambda i: i % 20 == 0, 10, query_block=8, index_block=100).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert np.mean([len(set(got[q]) & set(want[q])) / 10 for q in want]) >= 0.97
    assert got[100] == want[100]


def test_estimates_are_unbiased_and_bounds_hold():
    rng = np.random.default_rng(4)
    v, q = rng.normal(size=(4000, 64)), rng.normal(size=(20, 64))
    for bits in (64, 512):
        turn = onebit.rotation(64, bits=bits)
        guess, error = onebit.estimate(q, turn, *onebit.encode(v, turn))
        diff = guess - q @ v.T
        # the standard error of the mean of independent estimates is a 280th of their spread; four of it
        assert abs(diff.mean()) < 4 / 280 * diff.std() and (np.abs(diff) <= error).mean() > 0.999
    turn = onebit.rotation(13, bits=3)
    guess, error = onebit.estimate(q[:, :13], turn, *onebit.encode(v[:, :13], turn))
    assert (np.abs(guess - q[:, :13] @ v[:, :13].T) <= error).mean() > 0.99


def test_recall_and_share_reranked_on_a_whole_table(spark, monkeypatch):
    rows = spark.read.parquet(f"{SF01.replace('0.01', '0.1')}/embeddings.parquet").toPandas()
    ids, v = rows["vec_id"].to_numpy(), np.stack(rows["embedding"]).astype(np.float64)
    asked, measured = np.flatnonzero(ids % 20 == 0), []
    turn, exact = onebit.rotation(v.shape[1]), onebit.inner
    monkeypatch.setattr(onebit, "inner", lambda a, b: (measured.append(len(a)), exact(a, b))[1])
    hits = 0
    for at, numbers, _ in onebit.search_block(ids[asked], v[asked], ids, v, onebit.encode(v, turn), turn, 20):
        score = np.where(ids == ids[asked[at]], -np.inf, v @ v[asked[at]])
        hits += len(set(numbers.tolist()) & set(np.argsort(-score)[:20].tolist()))
    assert hits >= 0.99 * 20 * len(asked)
    assert sum(measured) < 0.25 * len(ids) * len(asked)


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, [0.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, id string, v int")
    got = [(r.query_id, r["rank"], r.vec_id) for r in onebit.search(df, lambda i: i % 20 == 0, 5).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20), (0, 2, 1), (20, 1, 0), (20, 2, 1)]
    assert onebit.search(df.where("false"), lambda i: i % 20 == 0, 5).count() == 0
