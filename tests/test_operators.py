import pytest
from pyspark.sql import functions as F

from tessera.functions import registry as named
from tessera.functions import scalars as S
from tessera.functions import text as X
from tessera.operators import analytics as A
from tessera.operators import fusion as C
from tessera.operators import graph as G
from tessera.operators import pairs as P
from tessera.operators import retrieval as R
from tessera.operators import selection as M
from tessera.operators import study as U
from tessera.sources import sinks as K
from tessera.sources import tables as T


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def pairs(spark, rows):
    return spark.createDataFrame(rows, "src string, tgt string, score double")


@pytest.mark.parametrize(("text", "want"), [("Crohn’s Disease", "crohn disease"), ("renalCell_carcinoma-Type", "renal cell carcinoma type"), ("Sjögren  (ﬁne)!", "sjogren fine"), (None, ""), ("", "")])
def test_normalisation(spark, text, want):
    assert one(spark, X.normalize(F.lit(text).cast("string"))) == want


def test_keys_and_grams(spark):
    assert one(spark, X.token_key(X.normalize(F.lit("Disease of the Heart")))) == one(spark, X.token_key(X.normalize(F.lit("the heart of disease"))))
    assert one(spark, X.char_grams(F.lit("ab"))) == [" ab", "ab "] and one(spark, X.char_grams(F.lit(""))) == []
    assert one(spark, X.compact_key(F.lit("Ä-b_1"))) == "äb1"


def test_annotation_priorities(spark):
    rows = [("http://x#hasExactSynonym", "heart attack", 1 / 30), ("http://x/P107", "one two three", 0.05), ("http://x#definition", "some text", None), ("http://x#altLabel", "see http://a.b", None), ("http://x#label", "X:123", None), ("http://x#label", "gene ontology", None)]
    df = spark.createDataFrame([r[:2] for r in rows], "p string, v string")
    got = [r.x for r in df.select(X.annotation_priority(F.col("v"), F.col("p")).alias("x")).collect()]
    assert [None if g is None else round(g, 9) for g in got] == [None if r[2] is None else round(r[2], 9) for r in rows]


def test_lexical_retrieval_golden(spark):
    s = spark.createDataFrame([("a", "s1", "renal carcinoma")], "rec string, iri string, normalized string")
    t = spark.createDataFrame([("b", "t1", "renal cell carcinoma"), ("c", "t2", "heart failure")], "rec string, iri string, normalized string")
    got = {r.tgt: r.score for r in R.sparse_cosine(s, t, 5).collect()}
    assert got["t1"] > 0.7 and "t2" not in got


def test_channel_union_golden(spark):
    r = R.union_channels(pairs(spark, [("s", "t_sem", 0.8)]), pairs(spark, [("s", "t_lexical", 0.82)]), 1).collect()
    assert [(x.tgt, x.score, x.channels) for x in r] == [("t_lexical", 0.82, "lexical")]


def test_candidate_recall_golden(spark):
    cands = pairs(spark, [("a", "x", 0.9), ("a", "y", 0.8), ("b", "z", 0.7), ("b", "w", 0.9)])
    refs = pairs(spark, [("a", "x", 1.0), ("b", "z", 1.0), ("c", "q", 1.0), ("d", "r", 1.0)])
    r = P.candidate_recall(cands, refs, pairs(spark, [("c", "q", 1.0)]), refs.where("false")).first()
    assert (r.n_refs, r.hits, r.oracle_hits, r.recall, r.oracle_recall, r.rank_median, r.rank_p90) == (4, 2, 3, 0.5, 0.75, 1.5, 1.9)


def test_miss_buckets_partition_the_missed(spark):
    refs, cands = pairs(spark, [(x, "t", 1.0) for x in "abcde"]), pairs(spark, [(x, "t", 0.5) for x in "bcde"])
    preds, gone = pairs(spark, [("c", "u", 0.9), ("e", "t", 0.9)]), pairs(spark, [("d", "t", 0.0)])
    assert {r.bucket: r.n for r in P.miss_buckets(refs, cands, preds, gone).collect()} == {"absent": 1, "rejected": 1, "wrong_selected": 1, "abstained": 1}


def test_exact_pair_survives_target_conflict(spark):
    preds = spark.createDataFrame([("s2", "t1", 0.99, 0), ("s3", "t2", 0.8, 1)], "src string, tgt string, score double, pos long")
    exact = spark.createDataFrame([("s1", "t1", 1.0, 0)], "src string, tgt string, score double, pos long")
    assert {(r.src, r.tgt) for r in P.final_alignment(preds, exact, 1, 1).collect()} == {("s1", "t1"), ("s3", "t2")}


def test_fusion_identities_and_neutral_evidence(spark):
    rows = [(i, i * 7 % 5, (i * 13 % 11) / 10, (i * 5 % 7) / 6, (i * 3 % 5) / 4, (i % 4) / 3, (i % 3) / 2, (i * 11 % 10) / 9) for i in range(60)] + [(99, 0, 0.5, None, None, None, None, 0.0)]
    df = spark.createDataFrame(rows, "src long, tgt long, s_lex double, s_hier double, s_sim double, q_hier double, q_sim double, q_lex double")
    f = C.fuse_outer(C.fuse_channels(df, ["hier", "sim"]))
    e = A.identities(f, ["hier", "sim"]).first()
    assert e.omega_error < 1e-9 and e.mixture_error < 1e-9
    n = f.where("src = 99").first()
    assert (n.S_struct, n.Q_struct, n.S_base, n.U) == (0.5, 0.0, 0.5, 1.0)
    d = df.select("src", "tgt", F.lit(0.9).alias("p_yes"))
    a = C.attribute(C.arbitrate(f, d), ["hier", "sim"])
    assert a.where("abs(I_label + I_struct + I_llm - 1) > 1e-9").count() == 0
    muted = C.fuse_channels(df, ["hier", "sim"], muted=["sim"])
    assert muted.where("omega_sim <> 0").count() == 0
    even = C.fuse_channels(df, ["hier", "sim"], uniform=True)
    assert even.where("omega_hier <> 0.5 OR omega_sim <> 0.5").count() == 0


def test_selector_windows(spark):
    df = pairs(spark, [("a", "x", 0.9), ("a", "y", 0.5), ("a", "z", 0.5), ("b", "x", 0.3)])
    got = {(r.src, r.tgt): (round(r.gap, 6), r.rank_score) for r in M.group_features(df, "score").collect()}
    assert got == {("a", "x"): (0.4, 1.0), ("a", "y"): (-0.4, 0.5), ("a", "z"): (-0.4, 0.0), ("b", "x"): (0.0, 1.0)}
    assert M.softmax(df, "score", ["src"]).groupBy("src").agg(F.sum("prob").alias("p")).where("abs(p - 1) > 1e-9").count() == 0


def test_threshold_ties_take_the_higher(spark):
    d = spark.createDataFrame([(0.95, 1, True), (0.2, 0, False)], "p_match double, label int, has_ref boolean")
    assert M.tune_threshold(d, [0.3, 0.5, 0.9]).first().threshold == 0.9


def test_learned_models_order_a_separable_set(spark):
    rows = [(f"s{i}", f"t{j}", 1 if j == 0 else 0, float(j == 0) + i % 3 * 0.01, 1.0) for i in range(12) for j in range(3)]
    df = spark.createDataFrame(rows, "src string, tgt string, label int, f double, sample_weight double")
    w, m, s = M.fit_rank_model(df, ["f"])
    assert w[0] > 0
    w, m, s, b = M.fit_accept_model(df, ["f"])
    p = M.linear_score(df, ["f"], w, m, s, b).withColumn("p", S.sigmoid(F.col("rank_utility")))
    assert p.where("(label = 1) <> (p > 0.5)").count() == 0


def test_graph_operators(spark):
    e = spark.createDataFrame([("a", "is", "b"), ("b", "is", "c"), ("a", "is", "c"), ("c", "is", "d"), ("x", "is", "x")], "src string, rel string, dst string")
    assert {(r["sub"], r["sup"], r.depth) for r in G.closure(e).collect()} == {("a", "b", 1), ("a", "c", 1), ("b", "c", 1), ("c", "d", 1), ("a", "d", 2), ("b", "d", 2)}
    assert {(r["sub"], r["sup"]) for r in G.direct_parents(e).collect()} == {("a", "b"), ("b", "c"), ("c", "d")}
    starts = spark.createDataFrame([("a", "d")], "start string, node string")
    assert G.distances(e, starts).first().d == 2
    hood = G.neighbourhood(e, starts.select(F.col("start").alias("node")), 1)
    assert {(r.src, r.dst) for r in hood.collect()} == {("a", "b"), ("b", "c"), ("a", "c")}
    got = G.greedy_context(hood.withColumn("ic", F.lit(1.0)).withColumn("cost", F.lit(2)), 4).collect()
    assert len(got) == 2 and {r.start for r in got} == {"a"}


def test_diverse_selection_and_budget(spark):
    items = spark.createDataFrame([("p", "r1", 0.9, 0.0, 0, 3), ("p", "r1", 0.8, 0.0, 1, 3), ("p", "r1", 0.7, 0.0, 2, 1), ("p", "r2", 0.1, 0.0, 3, 9)], "g string, rel string, score double, tie double, pos int, size int")
    assert [r.pos for r in C.diverse_top(items, ["g"], "rel", "score", "tie", 2, 3).orderBy("pos").collect()] == [0, 1, 3]
    assert [r.pos for r in C.trim_to_budget(items, ["g"], "size", 6).orderBy("pos").collect()] == [0, 1]
    assert [r.pos for r in C.trim_to_budget(items, ["g"], "size", 1).collect()] == [0]


def test_candidate_files(spark, tmp_path):
    (tmp_path / "c.tsv").write_bytes(b"SrcEntity\tTgtEntity\tTgtCandidates\r\ns1\tt1\t['t1', 't2']\r\ns2\tt3\t[('t3', 0.2), ('t4', 0.9)]\r\n")
    got = {(r.src, r.tgt, r.score, r["rank"]) for r in T.read_ranking(spark, str(tmp_path / "c.tsv")).collect()}
    assert got == {("s1", "t1", 1.0, 1), ("s1", "t2", 0.5, 2), ("s2", "t4", 0.9, 1), ("s2", "t3", 0.2, 2)}
    (tmp_path / "m.csv").write_text("a,b,Score\nx,y,0.9\nnull,NA,0.2\nz,w,\n")
    assert {tuple(r) for r in T.read_mappings(spark, str(tmp_path / "m.csv")).collect()} == {("x", "y", 0.9), ("null", None, 0.2), ("z", "w", 0.0)}
    assert T.read_reference(spark, str(tmp_path / "m.csv")).count() == 2


def test_alignment_xml_and_triples(spark, tmp_path):
    (tmp_path / "a.rdf").write_text('<rdf:RDF xmlns:rdf="r"><Alignment><map><Cell><entity1 rdf:resource="u#a"/><entity2 rdf:resource="v#b"/><measure>0.5</measure></Cell></map><map><Cell><entity1 rdf:resource="u#c"/></Cell></map></Alignment></rdf:RDF>')
    assert [tuple(r) for r in T.read_alignment_xml(spark, str(tmp_path / "a.rdf")).collect()] == [("u#a", "v#b", 0.5)]
    (tmp_path / "t.nt").write_text(f'<u#a> <{T.RDF_TYPE}> <{T.CLASS_TYPES[0]}> .\n<u#a> <{T.RDFS_SUBCLASS}> <u#b> .\n<u#a> <{T.RDFS_LABEL}> "A \\"x\\""@en .\n_:b1 <{T.RDFS_SUBCLASS}> <u#b> .\n')
    t = T.read_ntriples(spark, str(tmp_path / "t.nt"))
    assert [r.iri for r in T.classes(t).collect()] == ["u#a"]
    assert [(r.src, r.dst) for r in T.project(t, True).collect()] == [("u#a", "u#b")]
    assert T.annotations(t).count() == 1


def test_dump_checks(spark):
    df = spark.createDataFrame([("1.5", "true"), ("2", "0")], "n string, b string")
    assert [tuple(r) for r in T.checked_dump(df, ["n", "b"], ["n"], ["b"]).collect()] == [(1.5, 1), (2.0, 0)]
    with pytest.raises(ValueError):
        T.checked_dump(df, ["b", "n"], [], [])
    with pytest.raises(Exception, match="n: "):
        T.checked_dump(df.select(F.lit("inf").alias("n"), "b"), ["n", "b"], ["n"], ["b"]).collect()
    with pytest.raises(ValueError):
        K.dump(df)


def test_logs_and_answers(spark, tmp_path):
    (tmp_path / "a.log").write_text("Total: 3 minutes\nTotal: 5 minutes\nend")
    assert T.last_match(T.log_lines(spark, str(tmp_path / "a.log")), r"Total: (\d+) minutes", 1).first().g1 == "5"
    assert one(spark, X.first_json(F.lit('ok ```json\n{"a": 1}\n```'))) == '{"a": 1}'
    assert one(spark, X.complete_sentences(F.lit("One. Two! Three? Four. Five. Six"), 4)) == "One. Two! Three? Four."
    assert one(spark, X.duration(F.lit(93784))) == "1:02:03:04"


def test_taxonomy_and_shortlist_error(spark):
    rows = [("a", 1, 0.5, 5, False, True), ("b", -1, 0.5, 5, False, False), ("c", 9, 0.5, 5, False, False), ("d", 2, 0.5, 5, True, False), ("e", 2, 0.01, 5, False, False), ("f", 2, 0.5, 1, False, False), ("g", 2, 0.5, 9, False, False)]
    df = spark.createDataFrame(rows, "src string, gold_rank int, lead double, evidence int, llm_used boolean, top1_correct boolean")
    assert [r.category for r in A.failure_taxonomy(df).orderBy("src").collect()] == ["correct", "gold_absent", "gold_below_top_k", "llm_overturned", "near_tie", "thin_evidence", "misranked"]
    panels = spark.createDataFrame([("a", 1, 1)], "src string, gold_rank int, panel_rank int")
    with pytest.raises(Exception, match="too few"):
        U.final_selection(U.shortlist(panels, 2, 4), 2, 1).collect()


def test_registry_and_chain(spark):
    @named.register("metric", "rows_over")
    def rows_over(df, least=0):
        return df.where(F.col("id") >= least)

    with pytest.raises(ValueError):
        named.register("metric", "rows_over")(rows_over)
    assert named.chain(spark.range(10), [named.find("metric", "rows_over")], least=7, other=1).count() == 3


def test_incremental_scoring(spark, tmp_path):
    from tessera.streaming.incremental import score_new_pairs

    spark.range(5).write.parquet(str(tmp_path / "in"))
    run = lambda: score_new_pairs(spark, str(tmp_path / "in"), "id long", lambda df: df.withColumn("s", F.col("id") * 2), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    run()
    spark.range(5, 8).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8


def test_ties_in_score_and_position_go_to_the_smaller_other_end(spark):
    none = spark.createDataFrame([], "src long, tgt long, score double, pos long")
    for turn in (1, -1):
        rows = [(1, 7, 0.5, 3), (1, 5, 0.5, 3), (1, 6, 0.5, 3), (2, 6, 0.5, 3)][::turn]
        preds = spark.createDataFrame(rows, "src long, tgt long, score double, pos long").coalesce(1)
        assert [(r.src, r.tgt) for r in P.final_alignment(preds, none, 1, None).orderBy("src").collect()] == [(1, 5), (2, 6)]
        assert [(r.src, r.tgt) for r in P.top_by(preds, "tgt", 1).orderBy("tgt").collect()] == [(1, 5), (1, 6), (1, 7)]


def test_exact_matches_pair_classes_once(spark):
    """Copies of a label make one class a side; an entity with several labels counts with all of its keys."""
    src = spark.createDataFrame([(i, "Heart  failure") for i in range(0, 40, 2)] + [(100, "failure heart"), (100, "Heart-Failure"), (102, "kidney"), (104, None), (106, "")], "iri long, label string")
    tgt = spark.createDataFrame([(i, "heart failure") for i in range(1, 40, 2)] + [(101, "failure, heart"), (103, "Kidney"), (105, "kid ney")], "iri long, label string")
    got = {(r.src, r.tgt): r.near for r in R.exact_matches(src, tgt).collect()}
    want = {(a, b): False for a in [*range(0, 40, 2), 100] for b in range(1, 40, 2)} | {(a, 101): a != 100 for a in [*range(0, 40, 2), 100]} | {(102, 103): False, (102, 105): False}
    assert got == want and R.exact_matches(src, tgt).count() == len(want)
    assert {(r.src, r.tgt) for r in R.exact_matches(src, tgt, near_only=True).collect()} == {p for p, near in want.items() if near}
    assert R.match_classes(src).select("cls").distinct().count() == 3


def test_best_targets_by_blocks_equal_the_sparse_join(spark):
    import random

    rnd = random.Random(5)
    words = "alpha beta gamma delta heart renal cell failure acute left".split()
    rows = [(i, i, " ".join(rnd.choices(words, k=rnd.choice([1, 2, 2, 3])))) for i in range(160)] + [(200, 200, ""), (201, 201, "")]
    rec = spark.createDataFrame(rows, "rec long, iri long, normalized string")
    s, t = rec.where("iri % 2 = 0"), rec.where("iri % 2 = 1")
    want = R.limit_by_source(R.sparse_cosine(s, t).withColumn("k", F.round("score", 9)), 5, "k").collect()
    for block in (16, 2048):
        got = R.sparse_topk(s, t, 5, block).collect()
        assert len(got) == len(want) and {(r.src, r.tgt): round(r.score, 9) for r in got} == {(r.src, r.tgt): round(r.score, 9) for r in want}
