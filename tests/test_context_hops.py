from pyspark.sql import functions as F

from tessera.operators import graph as G


def test_context_paths_keep_the_callers_hops(spark):
    edges = [("a", f"n{i}", "r", f"n{i + 1}") for i in range(1, 9)] + [("a", "a", "r", "n1")]
    context = spark.createDataFrame(edges, "start string, src string, rel string, dst string").withColumn("ic", F.lit(1.0)).withColumn("cost", F.lit(1))
    first = lambda hops: {(r.src, r.dst) for r in G.greedy_context(context, hops, hops=hops).collect()}
    assert first(2) == {("a", "n1"), ("n1", "n2")}
    assert len(first(9)) == 9
    # the best path counts even where its reward is negative, and a longer one that pays is better
    one = context.where("src = 'a' OR src = 'n1'").withColumn("ic", F.when(F.col("src") == "a", 0.05).otherwise(9.0))
    assert len(G.greedy_context(one, 9, hops=1).collect()) == 1
    assert len(G.greedy_context(one, 9, hops=2).collect()) == 2


def test_path_methods(spark):
    edges = [("a", "b", 1.0, 1), ("b", "c", 5.0, 1), ("a", "d", 3.0, 2), ("d", "e", 0.1, 1), ("c", "a", 9.0, 9)]
    context = spark.createDataFrame([("a", s, "r", d, i, c) for s, d, i, c in edges], "start string, src string, rel string, dst string, ic double, cost int")
    paths = lambda method, budget, hops: [(r.src, r.dst) for r in G.greedy_context(context, budget, 0.0, hops, method).orderBy("pos").collect()]
    assert paths("dp", 2, 2) == [("a", "b"), ("b", "c")]
    assert paths("dp", 2, 1) == [("a", "d")]
    assert paths("lagrangian", 2, 2) == [("a", "b"), ("b", "c")]
    assert paths("local", 3, 2) == [("a", "d"), ("d", "e")]
    # edges point one way: nothing is reached against them
    assert G.greedy_context(context.where("src = 'b'"), 9, 0.0, 2).count() == 0


def test_forward_edges_leave_out_what_shares_a_hub(spark):
    hub = [(f"c{i}", "in", "n") for i in range(40)] + [("n", "of", "r"), ("r", "of", "w")]
    edges = spark.createDataFrame(hub, "src string, rel string, dst string")
    starts = edges.where("rel = 'in'").select(F.col("src").alias("node"))
    context = G.forward_edges(edges, starts, 2)
    assert {tuple(r) for r in context.collect()} == {(f"c{i}", *e) for i in range(40) for e in ((f"c{i}", "in", "n"), ("n", "of", "r"))}
    scored = lambda rows: rows.withColumn("ic", F.length("dst") * 0.5).withColumn("cost", F.lit(3))
    wide = scored(G.neighbourhood(edges, starts, 2))
    for method in ("dp", "lagrangian", "local"):
        cover = lambda rows: {tuple(r) for r in G.greedy_context(rows, 12, -1.0, 2, method).collect()}  # noqa: E731, B023
        assert cover(scored(context)) == cover(wide) and len(cover(wide)) == 80


def test_contexts_of_many_starts_stay_apart(spark):
    rows = [(f"s{i}", f"s{i}", "r", f"t{k}", 1.0, 1) for i in range(3000) for k in range(5)]
    context = spark.createDataFrame(rows, "start string, src string, rel string, dst string, ic double, cost int")
    got = G.greedy_context(context, 5, 0.0, 1).groupBy("start").agg(F.count_distinct("dst").alias("n"), F.max("pos").alias("p")).collect()
    assert len(got) == 3000 and {(r.n, r.p) for r in got} == {(5, 4)}


def test_context_queries_make_rows_in_proportion_to_the_starts(spark):
    """Neighbourhoods of two hops hold every customer of a nation for each of them."""
    from tessera.plans import extended, registry
    from tests.conftest import SF

    context = extended._contexts(lambda n: registry.view(spark, SF, n))
    assert context.groupBy("start").count().agg(F.max("count")).first()[0] <= 2


def test_shortest_paths_meet_in_the_middle(spark):
    import random
    from itertools import product

    rnd = random.Random(3)
    names = [f"v{i}" for i in range(14)]
    pairs = {tuple(rnd.sample(names, 2)) for _ in range(17)}
    edges = spark.createDataFrame([(a, "r", b) for a, b in sorted(pairs)], "src string, rel string, dst string")
    near = {n: sorted({b for a, b in pairs if a == n} | {a for a, b in pairs if b == n}) for n in names}
    wanted = [(a, b) for a, b in product(names, names) if rnd.random() < 0.3]
    for most in range(5):
        want = {}
        for start in names:
            front, seen, found = {start: [start]}, {start}, []
            for _ in range(most + 1):
                found += [(len(p) - 1, p) for n, p in front.items() if (start, n) in wanted]
                after = {}
                for n, p in front.items():
                    for b in near[n]:
                        if b not in seen:
                            after[b] = min(after.get(b, [*p, b]), [*p, b])
                front, seen = after, seen | set(after)
            if found:
                want[start] = min(found)
        got = G.shortest_paths(edges, spark.createDataFrame(wanted, "start string, node string"), most).collect()
        assert {r.start: (r.d, r.path) for r in got} == want and all(r.path[-1] == r.node for r in got)
