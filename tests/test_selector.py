import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import analytics as A
from tessera.operators import channels as H
from tessera.operators import checks as Q
from tessera.operators import records as D
from tessera.operators import retrieval as R
from tessera.operators import selector as L

COLUMNS = "src string, tgt string, pair_score double, distinctive double, s_diff double"


def rows(spark, data):
    out = spark.createDataFrame(data, COLUMNS)
    for c in ("s_label", "S_struct", "s_hier", "s_sim", "s_attr", "cand_sim", "cand_sim_prob"):
        out = out.withColumn(c, F.lit(0.5))
    return out.withColumn("cand_share_log", F.lit(0.0))


def test_distinctive_evidence_beats_a_slightly_higher_score(spark):
    got = L.heuristic(L.frame(rows(spark, [("s", "a", 0.80, 0.0, 1.0), ("s", "b", 0.79, 1.0, 1.0)])))
    assert [r.tgt for r in got.where("winner").collect()] == ["b"]


def test_abstained_sources_score_nothing(spark):
    got = L.heuristic(L.frame(rows(spark, [("s", "a", 0.1, 0.0, 0.0), ("s", "b", 0.1, 0.0, 0.0), ("t", "a", 0.95, 1.0, 1.0)]))).collect()
    assert {r.src: (r.abstained, r.S_select == 0) for r in got} == {"s": (True, True), "t": (False, False)}
    assert all(0 <= r.no_match <= 1 and r.reason == ("no_match" if r.abstained else "numeric") for r in got)


def test_arbitration_moves_the_winner_and_vetoes(spark):
    base = L.heuristic(L.frame(rows(spark, [("s", "a", 0.9, 0.5, 1.0), ("s", "b", 0.9, 0.5, 1.0), ("u", "c", 0.9, 1.0, 1.0)])))
    said = spark.createDataFrame([("s", "b", "Equivalent", 1.0), ("u", "NO_MATCH", "none", 1.0)], "src string, winner string, relation string, confidence double")
    got = {(r.src, r.tgt): r for r in L.arbitrated(base, said).collect()}
    before = {(r.src, r.tgt): r for r in base.collect()}
    assert got["s", "b"].winner and abs(got["s", "b"].utility - min(1, before["s", "b"].utility + 0.15)) < 1e-9 and abs(got["s", "a"].utility - before["s", "a"].utility + 0.15) < 1e-9
    assert got["u", "c"].no_match > before["u", "c"].no_match and got["u", "c"].llm_used
    taken = spark.createDataFrame([("s", "a", True), ("u", "c", True), ("v", "d", True)], "src string, tgt string, accepted boolean")
    assert {(r.src, r.tgt, r.accepted) for r in L.veto(taken, said).collect()} == {("s", "a", True), ("u", "c", False), ("v", "d", True)}
    assert {(r.src, r.tgt) for r in L.veto(taken, said, True).where("accepted").collect()} == {("s", "b"), ("v", "d")}


def test_calibrated_selector_keeps_the_right_winners(spark):
    data, refs = [], []
    for i in range(60):
        good = 0.8 + 0.1 * (i % 3) / 3
        data += [(f"s{i}", f"t{i}", good, 1.0, 1.0), (f"s{i}", f"x{i}", good - 0.02, 0.0, 0.3), (f"n{i}", f"y{i}", 0.4, 0.0, 0.3)]
        refs.append((f"s{i}", f"t{i}"))
    refs = spark.createDataFrame(refs, "src string, tgt string")
    pairs = rows(spark, data)
    frame = L.frame(pairs)
    choice = L.choose(frame, refs, folds=2, backgrounds=(0.25,), grid=[i / 20 for i in range(1, 20)])
    assert choice.metrics["f1"] == 1.0 and len(choice.rank.features) == 17 and len(choice.accept.features) == 10
    got = L.calibrated(frame, refs, choice).collect()
    assert {(r.src, r.tgt) for r in got if r.winner} == {(f"s{i}", f"t{i}") for i in range(60)}
    assert all((r.S_select > 0) == r.winner and r.reason == ("calibrated_no_match" if r.abstained else "calibrated") for r in got)
    # with too few positive sources, or none, the heuristic; in local mode the rows as they are
    assert "no_match" in L.select(pairs, refs.limit(3)).columns and "no_match" in L.select(pairs).columns
    assert L.select(pairs, mode="local").columns == pairs.columns


def test_prompts_name_the_best_five(spark):
    f = L.frame(rows(spark, [("s", f"t{i}", i / 10, 0.0, 1.0) for i in range(8)]))
    briefs = spark.createDataFrame([("s", "t7", "b" * 2000)], "src string, tgt string, brief string")
    r = L.prompts(f, briefs).first()
    assert [x.tgt for x in r.ids] == ["t7", "t6", "t5", "t4", "t3"] and [x.id for x in r.ids] == ["C1", "C2", "C3", "C4", "C5"]
    assert r.prompt.split("\n")[0] == "C1. t7 | score 0.7000 | evidence: " + "b" * 1200


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    for x in (rng.integers(0, 9, 500).astype(float), rng.normal(size=333), np.array([3.0])):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double").repartition(5)
        got = A.quantiles(df, "v", [0, 0.1, 0.5, 0.9, 1]).first().q
        assert np.allclose(got, np.quantile(x, [0, 0.1, 0.5, 0.9, 1]))
    assert A.quantiles(df.where("false"), "v", [0.5]).first().q is None


def test_aliases_are_taken_greedily_under_caps(spark):
    labels = spark.createDataFrame([("e", "Heart")], "iri string, label string")
    many = [("e", "http://x#hasRelatedSynonym", f"related thing {i}") for i in range(6)]
    notes = many + [("e", "http://x#hasExactSynonym", "cardiac organ"), ("e", "http://x#hasRelatedSynonym", "Cardiac-Organ"), ("e", "http://x#definition", "an organ that pumps")]
    got = R.candidate_texts(labels, spark.createDataFrame(notes, "iri string, prop string, value string")).first().texts
    assert got[0] == "Heart" and got[1] == "cardiac organ" and "Cardiac-Organ" not in got and "an organ that pumps" not in got
    assert sum(t.startswith("related") for t in got) == 4


def test_channels_without_evidence_are_neutral(spark):
    pairs = spark.createDataFrame([("a", "b"), ("a", "c")], "src string, tgt string")
    kinds = "iri string, pos int, rel string, ic double, spec double, weight double, vec array<double>, rel_vec array<double>"
    s = spark.createDataFrame([("a", 1, "r", 0.5, 1.0, 1.0, [1.0, 0.0], [1.0, 0.0])], kinds)
    t = spark.createDataFrame([("b", 1, "r", 0.5, 1.0, 1.0, [1.0, 0.0], [1.0, 0.0])], kinds)
    for name, got in (("lex", H.label(pairs, s, t)), ("isa", H.hierarchy(pairs, s, t, "isa", 2)), ("sim", H.similarity(pairs, s, t, 2))):
        by = {r.tgt: (r[f"s_{name}"], r[f"q_{name}"]) for r in got.collect()}
        assert by["b"][0] == pytest.approx(1.0) and by["b"][1] > 0 and by["c"] == (0.5, 0.0)
    # one side alone still speaks of differences; attributes never speak against a pair
    assert {r.tgt: r.s_diff for r in H.difference(pairs, s, t).collect()} == {"b": 1.0, "c": 0.5}
    far = t.withColumn("vec", F.array(F.lit(-1.0), F.lit(0.0)))
    assert H.attributes(pairs, s, far, H.bank(s), H.bank(far)).where("s_attr < 0.5").count() == 0


def test_checks_find_what_is_wrong(spark):
    bad = spark.createDataFrame([("x", 1, 3, 1.2, [0.0, 0.5, 0.5])], "table string, bin int, n long, rate double, edges array<double>")
    got = {r.check: r.passed for r in Q.bins(bad, spark.createDataFrame([("x", 4)], "table string, rows long")).collect()}
    assert got == {"one to ten": True, "numbered from one": True, "one edge more": False, "edges rise": False, "none is empty": True, "rates within 0 and 1": False, "counts make the total": False}
    assert [r.passed for r in Q.contract(bad, "t", 2, ["table"], ["rate"]).collect()] == [False, True, True]


def test_missing_records_are_errors(spark):
    ranking = spark.createDataFrame([("s", "a", 1), ("s", "b", 2)], "src string, tgt string, rank int")
    records = ranking.where("rank = 1").select("src", "tgt", F.lit(1).alias("x"))
    assert D.selected_records(ranking, ranking, records, 1).count() == 1
    with pytest.raises(Exception, match="no record for"):
        D.selected_records(ranking, ranking, records, 2).collect()
