"""More registered queries: selector, channels, graph context, study tables, sources and sinks, scalars, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import providers, scalars as S
from tessera.functions import text as X
from tessera.functions.durable import folder
from tessera.operators import analytics as A
from tessera.operators import channels as H
from tessera.operators import checks as Q
from tessera.operators import evidence as E
from tessera.operators import fusion as C
from tessera.operators import graph as G
from tessera.operators import pairs as P
from tessera.operators import records as D
from tessera.operators import retrieval as R
from tessera.operators import selection as M
from tessera.operators import selector as L
from tessera.operators import study as U
from tessera.plans.registry import _FUSED, CHANNELS, RANK, fused, query
from tessera.sources import sinks as K
from tessera.sources import tables as T

# --- selector -----------------------------------------------------------------------------------


def selector_rows(v):
    f = fused(v).select("src", "tgt", "label", F.col("S_base").alias("pair_score"), F.col("s_lex").alias("s_label"), "S_struct", "s_hier", "s_sim", "s_diff", F.col("q_sim").alias("s_attr"), F.col("score").alias("cand_sim"), F.col("q_hier").alias("distinctive"), F.col("score").alias("score"))
    ranked = P.ranks(f).withColumnRenamed("rank", "pos")
    shares = R.share_stats(ranked, 2).drop("cand_sim_mean", "cand_share_top", "pos", "score")
    return L.frame(shares, granularity=F.col("s_hier") / 2)


_OTHER = lambda c: f"CASE WHEN n > 1 THEN greatest(0e0, {c} - CASE WHEN {c} = l_{c}[1] THEN l_{c}[2] ELSE l_{c}[1] END) ELSE 0e0 END"
_GAPS = ["s_label", "S_struct", "s_hier", "s_sim", "s_attr", "cand_sim"]
_SELECT = f"""
{_FUSED.strip()},
c0 AS (SELECT src, tgt, label, least(1e0, greatest(0e0, S_base)) AS ps, s_lex AS s_label, S_struct, s_hier, s_sim, s_diff, q_sim AS s_attr, score AS cand_sim, q_hier AS dist, score / sum(score) OVER (PARTITION BY src) AS csp, row_number() OVER (PARTITION BY src ORDER BY score DESC, tgt) AS cr FROM u),
c1 AS (SELECT *, sum(CASE WHEN cr <= 2 THEN csp ELSE 0 END) OVER (PARTITION BY src) AS top2 FROM c0),
c2 AS (SELECT *, ln((top2 + 1.1920928955078125e-07) / (least(1e0, greatest(0e0, 1 - top2)) + 1.1920928955078125e-07)) AS csl FROM c1),
c3 AS (SELECT src AS ls, list_reverse_sort(list(ps)) AS l_ps, {", ".join(f"list_reverse_sort(list({c})) AS l_{c}" for c in _GAPS)} FROM c2 GROUP BY src),
c4 AS (SELECT *, count(*) OVER (PARTITION BY src) AS n, row_number() OVER (PARTITION BY src ORDER BY ps DESC, tgt) AS r, avg(ps) OVER (PARTITION BY src) AS mean, stddev_pop(ps) OVER (PARTITION BY src) AS sd, ln(least(1 - 1e-6, greatest(1e-6, ps)) / (1 - least(1 - 1e-6, greatest(1e-6, ps)))) AS lo FROM c2 JOIN c3 ON ls = src),
c5 AS (SELECT *, CASE WHEN sd > 1e-12 THEN (ps - mean) / sd ELSE 0 END AS z, CASE WHEN n > 1 THEN ps - CASE WHEN ps = l_ps[1] THEN l_ps[2] ELSE l_ps[1] END ELSE 0 END AS gap, ({" + ".join(map(_OTHER, _GAPS))}) / 6 AS cgap,
  1 - (r - 1) / greatest(1, n - 1)::DOUBLE AS rank_score, exp((lo - max(lo) OVER (PARTITION BY tgt)) / 0.75e0) AS e, least(1e0, greatest(0e0, 1 - (s_hier / 2 + 1 - s_diff) / 2)) AS safety FROM c4),
c6 AS (SELECT *, e / sum(e) OVER (PARTITION BY tgt) AS rec FROM c5)"""


@query("M25_selector_frame", f"WITH {_SELECT} SELECT src, tgt, lo AS logit_pair, csp AS cand_sim_prob, csl AS cand_share_log, z, gap, cgap AS channel_gap, rank_score, rec AS reciprocity01, safety FROM c6", "logit_pair cand_sim_prob cand_share_log z gap channel_gap rank_score reciprocity01 safety")
def _(v):
    return selector_rows(v).select("src", "tgt", "logit_pair", "cand_sim_prob", "cand_share_log", "z", "gap", "channel_gap", "rank_score", "reciprocity01", "safety")


_HEUR = f"""{_SELECT},
h1 AS (SELECT *, least(1e0, greatest(0e0, (1 / (1 + exp(-z)) + 1 / (1 + exp(-gap / 0.75e0)) + cgap + least(1e0, greatest(0e0, csp)) + rec) / 5)) AS comp FROM c6),
h2 AS (SELECT *, least(1e0, greatest(0e0, 0.6e0 * ps + 0.4e0 * least(1e0, greatest(0e0, (comp + dist + safety) / 3)))) AS ut FROM h1),
h3 AS (SELECT *, exp((ut - max(ut) OVER (PARTITION BY src)) / 0.75e0) AS x FROM h2), h4 AS (SELECT *, x / sum(x) OVER (PARTITION BY src) AS rp FROM h3),
h5 AS (SELECT *, CASE WHEN n > 1 THEN least(1e0, greatest(0e0, -sum(rp * ln(greatest(rp, 1e-12))) OVER (PARTITION BY src) / ln(greatest(n, 2)))) ELSE 0 END AS ent FROM h4),
h6 AS (SELECT *, least(1e0, greatest(0e0, (ent + 1 - max(ut) OVER (PARTITION BY src) + 1 - max(dist) OVER (PARTITION BY src) + 1 - max(comp) OVER (PARTITION BY src)) / 4)) AS risk FROM h5)"""


@query("M1_M2_M15_M16_heuristic_selector", f"WITH {_HEUR} SELECT src, tgt, comp AS competition, ut AS utility, rp AS rank_prob, ent AS entropy, risk AS no_match, CASE WHEN risk >= 0.55e0 THEN 0 ELSE ut END AS S_select FROM h6", "competition utility rank_prob entropy no_match S_select")
def _(v):
    return L.heuristic(selector_rows(v)).select("src", "tgt", "competition", "utility", "rank_prob", "entropy", "no_match", "S_select")


@query("M3_ask_arbitration", f"WITH {_HEUR}, q AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(ut, 12) DESC, tgt) AS k, ut - coalesce(lead(ut) OVER (PARTITION BY src ORDER BY ut DESC, tgt), 0) AS margin FROM h6) SELECT src, margin, risk AS no_match FROM q WHERE k = 1 AND (margin < 0.08e0 OR abs(risk - 0.55e0) < 0.08e0)", "margin no_match")
def _(v):
    return L.ask(L.heuristic(selector_rows(v)))


_VERDICT = "(SELECT src, CASE WHEN src % 5 = 0 THEN 'NO_MATCH' ELSE min(tgt)::VARCHAR END AS winner, CASE WHEN src % 7 = 0 THEN 'broader' ELSE 'equivalent' END AS relation, 0.1e0 * (src % 10) AS confidence FROM pairs GROUP BY src)"


def verdicts(v):
    return v("pairs").groupBy("src").agg(F.min("tgt").cast("string").alias("w")).select("src", F.when(F.col("src") % 5 == 0, "NO_MATCH").otherwise(F.col("w")).alias("winner"), F.when(F.col("src") % 7 == 0, "broader").otherwise("equivalent").alias("relation"), (0.1 * (F.col("src") % 10)).alias("confidence"))


@query("M4_arbitration", f"""WITH {_HEUR}, vd AS {_VERDICT}, a1 AS (SELECT h6.*, CASE WHEN confidence > 0 THEN 0.15e0 * least(1e0, confidence) END AS b, coalesce(confidence > 0 AND (upper(winner) = 'NO_MATCH' OR relation <> 'equivalent'), false) AS none, winner FROM h6 LEFT JOIN vd USING (src)),
a2 AS (SELECT *, coalesce(b IS NOT NULL AND NOT none AND tgt::VARCHAR = winner, false) AS chosen FROM a1), a3 AS (SELECT *, bool_or(chosen) OVER (PARTITION BY src) AS named FROM a2),
a4 AS (SELECT *, least(1e0, greatest(0e0, CASE WHEN chosen THEN ut + b WHEN named THEN ut - b / greatest(1, n - 1) ELSE ut END)) AS ut2 FROM a3), a5 AS (SELECT *, exp((ut2 - max(ut2) OVER (PARTITION BY src)) / 0.75e0) AS x2 FROM a4), a6 AS (SELECT *, x2 / sum(x2) OVER (PARTITION BY src) AS p2 FROM a5),
a7 AS (SELECT *, CASE WHEN n > 1 THEN least(1e0, greatest(0e0, -sum(p2 * ln(greatest(p2, 1e-12))) OVER (PARTITION BY src) / ln(greatest(n, 2)))) ELSE 0 END AS e2 FROM a6),
a8 AS (SELECT *, least(1e0, greatest(0e0, least(1e0, greatest(0e0, (e2 + 1 - max(ut2) OVER (PARTITION BY src) + 1 - max(dist) OVER (PARTITION BY src) + 1 - max(comp) OVER (PARTITION BY src)) / 4)) + CASE WHEN none THEN b ELSE 0 END)) AS r2 FROM a7)
SELECT src, tgt, ut2 AS utility, r2 AS no_match, none OR named AS llm_used FROM a8""", "utility no_match")
def _(v):
    return L.arbitrated(L.heuristic(selector_rows(v)), verdicts(v)).select("src", "tgt", "utility", "no_match", "llm_used")


@query("M4_prompts", f"""WITH {_SELECT}, t AS (SELECT src, tgt, ps, row_number() OVER (PARTITION BY src ORDER BY ps DESC, tgt) AS k FROM c6 QUALIFY k <= 5)
SELECT src, count(*)::INTEGER AS n_candidates, string_agg(tgt::VARCHAR, ',' ORDER BY k) AS targets FROM t GROUP BY src""")
def _(v):
    rows = selector_rows(v)
    return L.prompts(rows, rows.select("src", "tgt", F.lit("").alias("brief"))).select("src", F.size("ids").alias("n_candidates"), F.array_join(F.transform("ids", lambda x: x["tgt"].cast("string")), ",").alias("targets"))


@query("W7_M13_A39_decisions", f"""WITH {_SELECT}, d0 AS (SELECT *, lo + gap AS ut FROM c6), d1 AS (SELECT *, exp((ut - max(ut) OVER (PARTITION BY src)) / 0.75e0) AS x FROM d0), d2 AS (SELECT *, x / sum(x) OVER (PARTITION BY src) AS rp FROM d1),
d3 AS (SELECT *, CASE WHEN n > 1 THEN least(1e0, greatest(0e0, -sum(rp * ln(greatest(rp, 1e-12))) OVER (PARTITION BY src) / ln(greatest(n, 2)))) ELSE 0 END AS ent, ut - coalesce(lead(ut) OVER w, 0) AS um, rp - coalesce(lead(rp) OVER w, 0) AS pm, row_number() OVER w AS k FROM d2 WINDOW w AS (PARTITION BY src ORDER BY ut DESC, tgt)),
d4 AS (SELECT d3.*, EXISTS (FROM gold g WHERE g.src = d3.src) AS has, (ps + least(1e0, greatest(0e0, s_label)) + least(1e0, greatest(0e0, S_struct)) + greatest(rp, 1 - ent)) / 4 AS raw FROM d3 WHERE k = 1)
SELECT src, um AS utility_margin, pm AS prob_margin, ent AS entropy, has AS has_ref, CASE WHEN has THEN 1e0 ELSE 0.25e0 END AS sample_weight, least(1e0, greatest(0e0, CASE WHEN s_diff < 0.5e0 THEN raw * s_diff / 0.5e0 ELSE raw END)) AS support FROM d4""", "utility_margin prob_margin entropy sample_weight support")
def _(v):
    rows = selector_rows(v).withColumn("utility", F.col("logit_pair") + F.col("gap"))
    return L.decisions(rows, v("gold")).select("src", "utility_margin", "prob_margin", "entropy", "has_ref", "sample_weight", "support")


def _choice(v):
    rows = selector_rows(v)
    return rows, L.choose(rows, v("train"), folds=3, backgrounds=(0.25,), grid=[i / 20 for i in range(1, 20)])


@query("M10_M12_calibrated_selector")
def _(v):
    rows, choice = _choice(v)
    return L.calibrated(rows, v("train"), choice).select("src", "tgt", "rank_prob", "p_match", "S_select", "winner", "abstained", "reason")


@query("M11_validated_selector")
def _(v):
    rows = selector_rows(v)
    choice = L.choose(rows, v("train"), folds=1, backgrounds=(0.25,), resolves=(False,), grid=[i / 20 for i in range(1, 20)])
    return L.calibrated(rows, v("train"), choice, 0.7, True).select("src", "tgt", "p_match", "S_select", "winner", "reason")


@query("M9_folds", "SELECT src, CAST(0 AS BIGINT) <= fold AND fold < 5 AS within FROM (SELECT DISTINCT src, 0 AS fold FROM pairs)")
def _(v):
    return M.folds(v("pairs"), 5).select("src", F.col("fold").between(0, 4).alias("within"))


@query("M14_X10_compatible_scores", "SELECT src, tgt, least(1e0, greatest(0e0, 0.7e0 + score - 0.55e0)) AS compatible, greatest(0.5e0, s_lex, s_sim) AS floor FROM pairs", "compatible floor")
def _(v):
    return v("pairs").select("src", "tgt", M.compatible_score(F.col("score"), F.lit(0.55), 0.7).alias("compatible"), M.support_floor(F.col("s_lex"), F.col("s_sim")).alias("floor"))


@query("X2_U7_training_groups", """WITH p AS (SELECT DISTINCT src FROM gold) SELECT 'trained' AS part, count(*) AS n FROM pairs SEMI JOIN p USING (src) UNION ALL SELECT 'kept', count(*) FROM gold ANTI JOIN exact USING (src) UNION ALL SELECT 'taken', count(*) FROM gold g SEMI JOIN exact e ON e.src = g.src""")
def _(v):
    kept, taken = L.split_references(v("gold"), v("exact"))
    n = lambda d, part: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "n")
    return n(L.training_groups(v("pairs"), v("gold")), "trained").unionByName(n(kept, "kept")).unionByName(n(taken, "taken"))


@query("X14_conflict_flag", "SELECT CASE WHEN max(score) > 0 THEN bool_or(label = 1) END AS resolve FROM pairs")
def _(v):
    return L.conflict_flag(v("pairs").select(F.col("score").alias("accept_threshold"), (F.col("label") == 1).alias("resolve")))


@query("A39_source_groups", "SELECT count(*) AS sources, count(*) FILTER (f) AS flagged FROM (SELECT src, bool_or(label = 1) AS f FROM pairs GROUP BY src)")
def _(v):
    return L.source_groups(v("pairs").withColumn("f", F.col("label") == 1), "f")


@query("M7_tuned_threshold", """
WITH d AS (SELECT score AS p, label, src % 3 <> 0 OR label = 1 AS has_ref FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, tgt) AS r FROM pairs) WHERE r = 1), t AS (SELECT i / 20e0 AS threshold FROM range(1, 20) x(i)),
m AS (SELECT threshold, count(*) FILTER (p >= threshold AND label = 1) AS tp, count(*) FILTER (p >= threshold AND label = 0) AS fp, count(*) FILTER (has_ref AND NOT (p >= threshold AND label = 1)) AS fn FROM d, t GROUP BY threshold),
s AS (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS p, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS r FROM m), f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1, coalesce(3.25e0 * p * r / nullif(2.25e0 * p + r, 0), 0) AS fb FROM s)
(SELECT 'f1' AS objective, threshold, f1 AS value FROM f ORDER BY round(f1, 9) DESC, p DESC, threshold DESC LIMIT 1) UNION ALL (SELECT 'f_beta', threshold, fb FROM f ORDER BY round(fb, 9) DESC, p DESC, threshold DESC LIMIT 1)""", "threshold value")
def _(v):
    d = M.winners(v("pairs"), "score", 0.7).select(F.col("score").alias("p_match"), "label", ((F.col("src") % 3 != 0) | (F.col("label") == 1)).alias("has_ref"))
    one = lambda o: M.tune_threshold(d, [i / 20 for i in range(1, 20)], o).select(F.lit(o).alias("objective"), "threshold", "value")
    return one("f1").unionByName(one("f_beta"))


# --- channels -----------------------------------------------------------------------------------

_DOT = lambda a, b: f"({a}.x * {b}.x + {a}.y * {b}.y + {a}.z * {b}.z)"
_COS = f"least(1e0, greatest(0e0, ({_DOT('s', 't')} / sqrt({_DOT('s', 's')} * {_DOT('t', 't')}) + 1) / 2))"
_REL = "least(1e0, greatest(0e0, ((s.x * t.x + s.y * t.y) / sqrt((s.x * s.x + s.y * s.y) * (t.x * t.x + t.y * t.y)) + 1) / 2))"
_CELLS = f"m AS (SELECT p.src, p.tgt, s.pos AS i, t.pos AS j, {_COS} AS score, (({_COS}) + ({_REL})) / 2 AS both_ FROM npairs p JOIN nitems s ON s.iri = p.src JOIN ritems t ON t.iri = p.tgt)"


def items(v, name):
    i = v(name)
    return i.select("iri", "pos", "rel", "ic", "spec", "weight", F.array("x", "y", "z").alias("vec"), F.array("x", "y").alias("rel_vec"))


@query("C1_W11_X21_label_channel", f"""WITH {_CELLS}, r AS (SELECT *, row_number() OVER (PARTITION BY src, tgt ORDER BY score DESC, i, j) AS k FROM m), a AS (SELECT src, tgt, max(score) FILTER (k = 1) AS z1, max(score) FILTER (k = 2) AS z2, avg(score) AS mean FROM r GROUP BY ALL),
q AS (SELECT *, CASE WHEN z2 IS NULL THEN 1 ELSE least(1e0, greatest(0e0, (z1 - z2) / greatest(1e-8, 1 - z2))) END AS q FROM a) SELECT 'max' AS mode, src, tgt, z1 AS s_lex, q AS q_lex FROM q UNION ALL SELECT 'mean', src, tgt, mean, q FROM q""", "s_lex q_lex")
def _(v):
    one = lambda mode: H.label(v("npairs"), items(v, "nitems"), items(v, "ritems"), mode).withColumn("mode", F.lit(mode))
    return one("max").unionByName(one("mean"))


def _reduced(cap: int, limit: int, tie: str, score: str, rel: str) -> str:
    side = lambda at, table, key: f"""(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, tgt ORDER BY best DESC, {tie} DESC, pos) AS b FROM (SELECT *, row_number() OVER (PARTITION BY src, tgt, {rel} ORDER BY best DESC, {tie} DESC, pos) AS a
      FROM (SELECT m.src, m.tgt, m.{at} AS pos, max(m.{score}) AS best, any_value(t.rel) AS rel, any_value(t.{tie}) AS {tie}, any_value(t.spec) AS sp, any_value(t.x) AS x, any_value(t.y) AS y, any_value(t.z) AS z FROM m JOIN {table} t ON t.iri = m.{key} AND t.pos = m.{at} GROUP BY m.src, m.tgt, m.{at})) WHERE a <= {cap}) WHERE b <= {limit})"""  # noqa: E731
    return f"""{_CELLS}, ss AS {side('i', 'nitems', 'src')}, st AS {side('j', 'ritems', 'tgt')},
red AS (SELECT m.src, m.tgt, m.i, m.j, m.{score} AS sc FROM m SEMI JOIN ss ON ss.src = m.src AND ss.tgt = m.tgt AND ss.pos = m.i SEMI JOIN st ON st.src = m.src AND st.tgt = m.tgt AND st.pos = m.j),
rb AS (SELECT src, tgt, max(sc) AS v, 's' AS side FROM red GROUP BY src, tgt, i UNION ALL SELECT src, tgt, max(sc), 't' FROM red GROUP BY src, tgt, j),
ag AS (SELECT src, tgt, avg(v) FILTER (side = 's') AS a, avg(v) FILTER (side = 't') AS b, stddev_pop(v) AS sd, count(*) AS n FROM rb GROUP BY ALL),
ma AS (SELECT src, tgt, avg(x) AS x, avg(y) AS y, avg(z) AS z, sum(sp) AS sp, count(*) AS n FROM ss GROUP BY ALL), mb AS (SELECT src, tgt, avg(x) AS x, avg(y) AS y, avg(z) AS z, sum(sp) AS sp, count(*) AS n FROM st GROUP BY ALL),
fin AS (SELECT ag.src, ag.tgt, (ag.a + ag.b) / 2 AS strength, ag.sd, ag.n, {_COS.replace('s.', 's.').replace('t.', 't.')} AS emb, (s.sp + t.sp) / (s.n + t.n) AS inf FROM ag JOIN ma s ON s.src = ag.src AND s.tgt = ag.tgt JOIN mb t ON t.src = ag.src AND t.tgt = ag.tgt)"""


@query("C2_T5_hierarchy_channel", f"WITH {_reduced(3, 3, 'spec', 'score', 'src')} SELECT src, tgt, least(1e0, greatest(0e0, (emb + strength) / 2)) AS s_isa, least(1e0, greatest(0e0, (least(1e0, n / 6e0) + strength + inf) / 3)) AS q_isa FROM fin", "s_isa q_isa")
def _(v):
    return H.hierarchy(v("npairs"), items(v, "nitems"), items(v, "ritems"), "isa", 3, 3)


@query("C3_J11_similarity_channel", f"WITH {_reduced(2, 4, 'ic', 'both_', 'rel')} SELECT src, tgt, least(1e0, greatest(0e0, (emb + strength) / 2)) AS s_sim, least(1e0, greatest(0e0, (least(1e0, n / 8e0) + strength + 1 - least(1e0, 2 * sd)) / 3)) AS q_sim FROM fin", "s_sim q_sim")
def _(v):
    return H.similarity(v("npairs"), items(v, "nitems"), items(v, "ritems"), 3, 2, 4)


@query("C4_difference_channel", f"""WITH {_CELLS}, o AS (SELECT m.src, m.tgt, 's' AS side, m.i AS pos, any_value(t.rel) AS rel, any_value(t.ic) AS ic, any_value(t.ic) * (1 - max(both_)) AS open FROM m JOIN nitems t ON t.iri = m.src AND t.pos = m.i GROUP BY m.src, m.tgt, m.i
UNION ALL SELECT m.src, m.tgt, 't', m.j, any_value(t.rel), any_value(t.ic), any_value(t.ic) * (1 - max(both_)) FROM m JOIN ritems t ON t.iri = m.tgt AND t.pos = m.j GROUP BY m.src, m.tgt, m.j),
k AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY src, tgt, side ORDER BY open DESC, ic DESC, pos) <= 3), g AS (SELECT src, tgt, side, sum(open) / greatest(1e-8, sum(ic)) AS c, avg(ic) AS ic FROM k GROUP BY ALL), d AS (SELECT src, tgt, stddev_pop(open) AS sd, count(*) AS n FROM k GROUP BY ALL)
SELECT g.src, g.tgt, least(1e0, greatest(0e0, 1 - least(1e0, greatest(0e0, sum(c) / 2)))) AS s_diff, least(1e0, greatest(0e0, (least(1e0, any_value(n) / 6e0) + sum(ic) / 2 + 1 - least(1e0, 2 * any_value(sd))) / 3)) AS q_diff FROM g JOIN d ON d.src = g.src AND d.tgt = g.tgt GROUP BY g.src, g.tgt""", "s_diff q_diff")
def _(v):
    return H.difference(v("npairs"), items(v, "nitems"), items(v, "ritems"), 3, 3)


@query("C5_J12_attribute_channel", f"""WITH {_CELLS}, o AS (SELECT m.src, m.tgt, 's' AS side, max(score) AS best, any_value(t.weight) AS w FROM m JOIN nitems t ON t.iri = m.src AND t.pos = m.i GROUP BY m.src, m.tgt, m.i UNION ALL SELECT m.src, m.tgt, 't', max(score), any_value(t.weight) FROM m JOIN ritems t ON t.iri = m.tgt AND t.pos = m.j GROUP BY m.src, m.tgt, m.j),
g AS (SELECT src, tgt, side, sum(w * best) / sum(w) AS r, avg(w) AS w FROM o GROUP BY ALL), d AS (SELECT src, tgt, stddev_pop(best) AS sd, count(*) AS n FROM o GROUP BY ALL)
SELECT g.src, g.tgt, greatest(0.5e0, least(1e0, avg(r))) AS s_attr, least(1e0, greatest(0e0, (least(1e0, any_value(n) / 24e0) + sum(w) / 2 + 1 - least(1e0, 2 * any_value(sd))) / 3)) AS q_attr FROM g JOIN d ON d.src = g.src AND d.tgt = g.tgt GROUP BY g.src, g.tgt""", "s_attr q_attr")
def _(v):
    n, r = items(v, "nitems"), items(v, "ritems")
    return H.attributes(v("npairs"), n, r, H.bank(n), H.bank(r))


@query("J13_C14_provenance", f"""WITH {_CELLS}, b AS (SELECT *, row_number() OVER (PARTITION BY src, tgt, i ORDER BY score DESC, j) AS r, row_number() OVER (PARTITION BY src, tgt, j ORDER BY score DESC, i) AS c FROM m WHERE score > 0) SELECT src, tgt, count(*)::INTEGER AS n_links, max(score) AS best FROM b WHERE r = 1 OR c = 1 GROUP BY src, tgt""", "best")
def _(v):
    p = H.provenance(H.matrix(v("npairs"), items(v, "nitems"), items(v, "ritems")))
    return p.select("src", "tgt", F.size("links").alias("n_links"), F.col("links")[0]["score"].alias("best"))


@query("C7_family_summary", """WITH g AS (SELECT src, tgt, q_hier * pow(abs(s_hier - 0.5e0), 2) AS a, q_sim * pow(abs(s_sim - 0.5e0), 2) AS b, s_hier AS sa, s_sim AS sb, q_hier AS qa, q_sim AS qb FROM pairs)
SELECT src, tgt, coalesce((a * sa + b * sb) / nullif(a + b, 0), 0.5e0) AS s_hier, coalesce((qa + qb) / nullif((qa > 0)::INTEGER + (qb > 0)::INTEGER, 0), 0) AS q_hier FROM g""", "s_hier q_hier")
def _(v):
    p = v("pairs").select("src", "tgt", F.col("s_hier").alias("s_a"), F.col("s_sim").alias("s_b"), F.col("q_hier").alias("q_a"), F.col("q_sim").alias("q_b"))
    return C.family_summary(p, ["a", "b"]).select("src", "tgt", "s_hier", "q_hier")


@query("C8_ablations", """SELECT src, tgt, s_hier / 2 + s_diff / 2 AS S_struct, (s_lex + (s_hier + s_diff) / 2) / 2 AS S_base FROM pairs""", "S_struct S_base")
def _(v):
    return C.fuse_outer(C.fuse_channels(v("pairs"), CHANNELS, muted=["sim"], uniform=True), uniform=True).select("src", "tgt", "S_struct", "S_base")


@query("C16_plain_scorer", """WITH w AS (SELECT src, tgt, s_lex * 2 - 1 AS a, s_sim * 2 - 1 AS b, q_sim > 0 AS h FROM pairs), x AS (SELECT *, pow(abs(a - 0.5e0), 2) AS ga, pow(abs(b - 0.5e0), 2) AS gb FROM w), y AS (SELECT *, CASE WHEN h THEN coalesce(gb / nullif(ga + gb, 0), 0) ELSE 0 END AS w_c FROM x)
SELECT src, tgt, w_c, (1 - w_c) * a + w_c * b AS S_lctx, least(1e0, greatest(0e0, 1 - 2 * abs((1 - w_c) * a + w_c * b - 0.5e0))) AS U FROM y""", "w_c S_lctx U")
def _(v):
    p = v("pairs").select("src", "tgt", (F.col("s_lex") * 2 - 1).alias("cos_label"), (F.col("s_sim") * 2 - 1).alias("cos_context"), (F.col("q_sim") > 0).alias("has_context"))
    return C.fuse_cosines(p).select("src", "tgt", "w_c", "S_lctx", "U")


@query("C17_leave_one_out", "SELECT src, tgt, coalesce(greatest(0e0, s_lex - s_sim) / nullif(sum(greatest(0e0, s_lex - s_sim)) OVER (PARTITION BY src, tgt), 0), 0) AS attribution FROM pairs", "attribution")
def _(v):
    return E.leave_one_out(v("pairs").withColumn("full", F.col("s_lex")).withColumn("without", F.col("s_sim"))).select("src", "tgt", "attribution")


@query("C18_fitted_calibration")
def _(v):
    rows = v("pairs").select("src", "tgt", "label", F.lit(1.0).alias("sample_weight"), "score")
    w, m, s, b = M.fit_accept_model(rows, ["score"])
    return M.linear_score(rows, ["score"], w, m, s, b, "z").select("src", "tgt", S.sigmoid(F.col("z")).alias("p"))


@query("C19_encoded_texts", "SELECT p_partkey AS iri, p_name IS NOT NULL AS encoded FROM part")
def _(v):
    return providers.encode(v("part").select(F.col("p_partkey").alias("iri"), "p_name"), "p_name").select("iri", F.col("vector").isNotNull().alias("encoded"))


@query("C20_F21_answers", "SELECT p_partkey AS iri, CASE WHEN p_size % 2 = 0 THEN exp(-p_size / 50e0) / (exp(-p_size / 50e0) + exp(-1e0)) END AS p_yes FROM part", "p_yes")
def _(v):
    part = v("part").select(F.col("p_partkey").alias("iri"), F.col("p_name").alias("prompt"), "p_size")
    told = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('{"top":[{"token":" Yes","logprob":'), (-F.col("p_size") / 50.0).cast("string"), F.lit('},{"token":"no","logprob":-1.0},{"token":"x","logprob":0.5}]}')))
    answers = part.groupBy("prompt").agg(F.min(told).alias("answer"))
    return part.join(answers, "prompt").select("iri", X.yes_probability(F.coalesce(told, F.lit("{}"))).alias("p_yes"))


@query("C13_evidence_packet", """WITH t AS (SELECT src, tgt, string_agg('source hierarchy: h' || pos, chr(10)) AS packet FROM pairs GROUP BY src, tgt) SELECT src, tgt, packet FROM t""")
def _(v):
    i = v("pairs").select("src", "tgt", F.lit("source").alias("side"), F.lit("hierarchy").alias("channel"), "pos", F.concat(F.lit("h"), F.col("pos").cast("string")).alias("text"))
    return E.evidence_packet(i)


# --- graph --------------------------------------------------------------------------------------

_HIER = "rel IN ('located_in', 'part_of')"


def _contexts(v):
    starts = v("customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node")).unionByName(v("supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("node")))
    return G.forward_edges(v("edges").where(_HIER), starts, 2).join(G.edge_ic(v("edges")), ["src", "rel", "dst"]).withColumn("cost", F.lit(3))


_PATHS = """WITH s AS (SELECT concat('c', c_custkey) AS start, concat('n', c_nationkey) AS n FROM customer UNION ALL SELECT concat('s', s_suppkey), concat('n', s_nationkey) FROM supplier)
SELECT start, start AS src, n AS dst FROM s UNION ALL SELECT start, n, dst FROM s JOIN edges e ON e.src = n AND e.rel = 'part_of'"""


@query("G5_G4_labelled_paths", _PATHS)
def _(v):
    return G.greedy_context(_contexts(v), 12, -1.0, 3, "dp").select("start", "src", "dst")


@query("G6_relaxed_paths", _PATHS)
def _(v):
    return G.greedy_context(_contexts(v), 12, -1.0, 2, "lagrangian").select("start", "src", "dst")


@query("G7_local_paths", _PATHS)
def _(v):
    return G.greedy_context(_contexts(v), 12, -1.0, 3, "local").select("start", "src", "dst")


@query("G3_G11_X34_labelled_context", f"""WITH h AS (SELECT * FROM edges WHERE {_HIER}), l AS (SELECT concat('n', n_nationkey) AS iri, n_name AS label FROM nation), s AS (SELECT DISTINCT src AS n FROM h WHERE src LIKE 'n%'), b AS (SELECT src AS x, dst AS y FROM h UNION SELECT dst, src FROM h),
r AS (SELECT n AS start, n AS node FROM s UNION SELECT n, y FROM s JOIN b ON x = n) SELECT DISTINCT p.start, e.src, e.dst, coalesce(l.label, e.src) AS src_label FROM h e JOIN r p ON p.node = e.src JOIN r q ON q.node = e.dst AND q.start = p.start LEFT JOIN l ON l.iri = e.src""")
def _(v):
    h = v("edges").where(_HIER)
    starts = h.where("src LIKE 'n%'").select(F.col("src").alias("node")).distinct()
    names = G.labels(v("nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("iri")), v("nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("iri"), F.lit("label").alias("prop"), F.col("n_name").alias("value")))
    return G.labelled_context(G.neighbourhood(h, starts, 1), names).select("start", "src", "dst", "src_label").distinct()


@query("G8_shortest_paths", f"""WITH h AS (SELECT * FROM edges WHERE {_HIER}) SELECT concat('c', c_custkey) AS start, concat('r', n_regionkey) AS node, 2 AS d FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def _(v):
    h = v("edges").where(_HIER)
    starts = v("customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("start"), "c_nationkey").join(v("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return G.shortest_paths(h, starts.select("start", F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("node")), 2).select("start", "node", "d")


@query("G9_P12_bridges", "SELECT concat('n', n_nationkey) AS start, concat('n', n_nationkey) AS src, 'part_of' AS rel, concat('r', n_regionkey) AS dst FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)")
def _(v):
    h = v("edges").where(_HIER)
    nation = v("nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("start"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("dst"), "n_nationkey")
    one = v("supplier").groupBy("s_nationkey").agg(F.min("s_suppkey").alias("k")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    picked = one.select("start", F.concat(F.lit("a"), F.col("dst")).alias("src"), F.lit("near").alias("rel"), "dst")
    return G.bridges(h.select("src", "rel", "dst"), picked.withColumn("src", F.col("dst")), 2)


@query("G12_direct_parents", f"SELECT DISTINCT src AS sub, dst AS sup FROM edges WHERE {_HIER}")
def _(v):
    return G.direct_parents(v("edges").where(_HIER))


@query("G13_axiom_targets", """SELECT DISTINCT concat('c', c_custkey) AS iri, 'is_a' AS family, concat('n', c_nationkey) AS target FROM customer UNION ALL SELECT concat('c', c_custkey), 'part', c_mktsegment FROM customer""")
def _(v):
    c = v("customer")
    iri = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    n, both, some = F.concat(F.lit("n"), F.col("c_nationkey").cast("string")), F.concat(F.lit("_:i"), iri), F.concat(F.lit("_:r"), iri)
    null = F.lit(None).cast("string")
    row = lambda *x: F.struct(*[F.lit(e).alias(k) if not hasattr(e, "alias") else e.alias(k) for k, e in zip(("iri", "node", "kind", "prop", "child", "top"), x, strict=True)])
    seg = F.col("c_mktsegment")
    rows = c.select(F.inline(F.array(row(iri, both, "intersection", null, n, True), row(iri, both, "intersection", null, some, True), row(iri, some, "restriction", F.lit("p"), seg, False), row(iri, n, "named", null, null, False), row(iri, seg, "named", null, null, False))))
    families = v("region").limit(1).select(F.lit("p").alias("prop"), F.lit("part").alias("family"))
    return G.axiom_targets(rows, families)


@query("G15_object_bundle", """WITH d AS (SELECT rel, node, count(*) AS deg FROM (SELECT rel, src AS node FROM edges UNION ALL SELECT rel, dst FROM edges) GROUP BY ALL), t AS (SELECT rel, count(*) AS m FROM edges GROUP BY rel), i AS (SELECT rel, node, -ln(deg / m::DOUBLE) AS ic FROM d JOIN t USING (rel)),
e AS (SELECT src, e.rel, dst, (a.ic + b.ic) / 2 AS ic FROM edges e JOIN i a ON a.rel = e.rel AND a.node = src JOIN i b ON b.rel = e.rel AND b.node = dst), n AS (SELECT *, least(1e0, greatest(0e0, ic / (SELECT max(ic) FROM e))) AS ic_norm FROM e),
o AS (SELECT DISTINCT src AS iri, * FROM n WHERE rel = 'placed_by' UNION SELECT DISTINCT dst, * FROM n WHERE rel = 'placed_by') SELECT iri, count(*) AS n_items, max(ic_norm) AS best FROM (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY iri ORDER BY round(ic_norm, 9) DESC, src, rel, dst) <= 48) GROUP BY iri""", "best")
def _(v):
    return G.object_bundle(v("edges"), ["located_in", "part_of"]).groupBy("iri").agg(F.count(F.lit(1)).alias("n_items"), F.max("ic_norm").alias("best"))


@query("G18_X42_X45_expansion", f"""WITH h AS (SELECT DISTINCT src, dst FROM edges WHERE {_HIER} AND rel = 'part_of') SELECT src AS node, 'parent' AS kind, dst AS other, 1 AS rank FROM h UNION ALL SELECT * FROM (SELECT dst AS node, 'child' AS kind, src AS other, row_number() OVER (PARTITION BY dst ORDER BY src)::INTEGER AS rank FROM h) WHERE rank <= 3""")
def _(v):
    h = v("edges").where("rel = 'part_of'")
    return D.expansion(h, h.where("false").select(F.col("src").alias("node")), "part_of")


@query("G18_annotation_payload", "SELECT * FROM (SELECT iri, prop, value, CASE WHEN prop = 'name' THEN 'synonym' ELSE 'annotation' END AS kind, row_number() OVER (PARTITION BY iri, prop = 'name' ORDER BY prop, value)::INTEGER AS rank FROM (SELECT DISTINCT * FROM annot)) WHERE rank <= 12")
def _(v):
    return D.one_hop_payload(v("annot"), F.lit(False), F.col("prop") == "name")


@query("G19_tops", f"""SELECT concat('c', c_custkey) AS sub, concat('r', n_regionkey) AS sup FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT concat('s', s_suppkey), concat('r', n_regionkey) FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey) FROM nation""")
def _(v):
    return G.tops(v("edges").where(_HIER))


@query("G10_relation_ends", "SELECT rel, list_sort(list_distinct(list(left(src, 1)))) AS domains, list_sort(list_distinct(list(left(dst, 1)))) AS ranges FROM edges GROUP BY rel")
def _(v):
    e = v("edges")
    types = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("type", F.substring("node", 1, 1))
    return G.relation_ends(e, types)


@query("X31_token_cost", "SELECT iri, CAST(floor(len(string_split(long_label, ' ')) * 1.3e0) AS INTEGER) AS cost FROM ent")
def _(v):
    return v("ent").select("iri", G.token_cost(F.col("long_label")).alias("cost"))


# --- pairs, sets, study -------------------------------------------------------------------------


@query("A4_P3_global_evaluation", """WITH p AS (SELECT DISTINCT src, tgt FROM preds WHERE src % 7 <> 0 AND tgt % 7 <> 0), n AS (SELECT * FROM p ANTI JOIN train USING (src, tgt)), r AS (SELECT * FROM gold ANTI JOIN train USING (src, tgt))
SELECT (SELECT count(*) FROM n SEMI JOIN r USING (src, tgt)) AS tp, (SELECT count(*) FROM n) AS n_pred, (SELECT count(*) FROM r) AS n_ref""")
def _(v):
    ignored = v("pairs").select(F.explode(F.array("src", "tgt")).alias("iri")).where("iri % 7 = 0").distinct()
    return D.evaluated_global(v("preds"), v("gold"), v("train"), ignored).select("tp", "n_pred", "n_ref")


@query("A4_local_evaluation", f"SELECT count(*) AS n_refs, avg(CASE WHEN r <= 1 THEN 1e0 ELSE 0e0 END) AS hits_1, avg(CASE WHEN r <= 5 THEN 1e0 ELSE 0e0 END) AS hits_5, avg(coalesce(1e0 / r, 0e0)) AS mrr FROM gold LEFT JOIN (SELECT src, tgt, {RANK} AS r FROM pairs) USING (src, tgt)", "hits_1 hits_5 mrr")
def _(v):
    return D.evaluated_local(v("pairs"), v("gold"), [1, 5])


@query("P1_P4_ignored_classes", "SELECT DISTINCT concat('o', o_orderkey) AS iri FROM orders WHERE o_orderstatus = 'F'")
def _(v):
    a = v("orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("iri"), F.lit("use").alias("prop"), F.when(F.col("o_orderstatus") == "F", " False ").otherwise("true").alias("value"))
    return P.ignored_classes(a, "use")


@query("P5_T4_best", "SELECT src, tgt, score FROM pairs WHERE score >= 0.9e0 ORDER BY score DESC, src * 100 + pos, tgt LIMIT 100", "score")
def _(v):
    rows = P.at_least(v("pairs"), 0.9).withColumn("order", F.struct(F.col("src") * 100 + F.col("pos"), "tgt"))
    return P.best(rows, 100, pos="order").select("src", "tgt", "score")


@query("P8_active", "SELECT count(*) FILTER (g > 1e-6) AS by_weight, count(*) FILTER (q > 0 AND g > 1e-8) AS by_quality FROM (SELECT q_sim AS q, q_sim * pow(abs(s_sim - 0.5e0), 2) AS g FROM pairs)")
def _(v):
    f = C.fuse_channels(v("pairs"), CHANNELS)
    n = lambda d, c: d.agg(F.count(F.lit(1)).alias(c))
    return n(P.active(f, "sigma_sim"), "by_weight").crossJoin(n(P.active(f, "sigma_sim", "q_sim"), "by_quality"))


@query("P9_active_rows", "SELECT 'inference' AS kind, count(*) AS n FROM pairs ANTI JOIN exact USING (src, tgt) UNION ALL SELECT 'exact', count(*) FROM pairs SEMI JOIN exact USING (src, tgt)")
def _(v):
    n = lambda kind: D.active_rows(v("pairs"), v("exact"), False, kind).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return n("inference").unionByName(n("exact"))


@query("P11_families", "SELECT rel, CASE rel WHEN 'located_in' THEN 'place' WHEN 'part_of' THEN 'part' END AS family FROM (SELECT DISTINCT rel FROM edges)")
def _(v):
    families = v("region").sparkSession.createDataFrame([("place", 1, "LOCATED_IN", None), ("part", 2, None, "part of"), ("late", 3, "part_of", None)], "family string, ordinal int, alias string, seed string")
    rel = v("edges").select("rel").distinct().withColumn("label", F.replace(F.col("rel"), F.lit("_"), F.lit(" ")))
    return E.family_of(rel, families)


@query("P13_X8_display_texts", "SELECT iri, prop, value, prop = 'definition' AS definition FROM (SELECT iri, prop, value FROM annot UNION ALL SELECT p_partkey, 'definition', p_type FROM part)")
def _(v):
    a = v("annot").unionByName(v("part").select(F.col("p_partkey").alias("iri"), F.lit("definition").alias("prop"), F.col("p_type").alias("value")))
    null = F.lit(None).cast("string")
    return a.select("iri", "prop", X.display_text(null, F.concat(F.col("prop"), F.lit(":"), F.col("value")), F.col("prop")).alias("value"), X.definition_like(F.col("prop")).alias("definition"))


@query("P14_T6_final_selection", f"""WITH k AS (SELECT *, {RANK} AS r FROM pairs), g AS (SELECT src, min(r) FILTER (label = 1) AS gold_rank FROM k GROUP BY src) SELECT gold_rank::INTEGER AS gold_rank, src FROM g WHERE gold_rank BETWEEN 1 AND 2 QUALIFY row_number() OVER (PARTITION BY gold_rank ORDER BY src) <= 2""")
def _(v):
    p = P.ranks(v("pairs")).groupBy("src").agg(F.min(F.when(F.col("label") == 1, F.col("rank"))).alias("gold_rank")).withColumn("complete", F.lit(True))
    return U.final_selection(U.shortlist(U.panel_order(U.eligible(p, 2), []), 2, 4), 2, 2).select("gold_rank", "src")


@query("J3_feature_idf", """WITH f AS (SELECT iri, unnest(list_distinct(string_split(trim(regexp_replace(lower(long_label), '[^a-z0-9]+', ' ', 'g')), ' '))) AS feature FROM ent), n AS (SELECT count(*) AS n FROM ent) SELECT feature, ln((1 + any_value(n)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM f, n GROUP BY feature HAVING count(*) <= greatest(10, ceil(0.2e0 * any_value(n)))""", "idf")
def _(v):
    e = v("ent").select("iri", F.explode(X.tokens(X.normalize(F.lower("long_label"), True))).alias("feature"))
    return R.feature_df(e, v("ent").agg(F.count(F.lit(1)).alias("n")))


@query("J9_added_columns", "SELECT src, tgt, s_lex, s_sim FROM pairs", "s_lex s_sim")
def _(v):
    p = v("pairs")
    return P.add_columns(p.select("src", "tgt", "s_lex"), p.select("src", "tgt", F.lit(0.0).alias("s_lex"), "s_sim", "q_sim"), ["s_"])


@query("J14_M23_K8_overlay", "SELECT src, tgt, coalesce(CASE WHEN src % 2 = 0 THEN s_sim END, s_lex) AS first, coalesce(s_lex, s_sim) AS kept FROM pairs", "first kept")
def _(v):
    p = v("pairs")
    late = p.select("src", "tgt", F.when(F.col("src") % 2 == 0, F.col("s_sim")).alias("first"))
    return U.prefer(K.overlay(p.select("src", "tgt", F.col("s_lex").alias("first"), F.col("s_lex").alias("kept")), late, ["first"]), p.select("src", "tgt", F.col("s_sim").alias("kept")), ["kept"])


@query("J15_attached_rows", f"""WITH k AS (SELECT *, {RANK} AS r FROM pairs), t AS (SELECT src, max(tgt) FILTER (r = 1) AS top1_tgt, min(tgt) FILTER (label = 1) AS gold_tgt FROM k GROUP BY src) SELECT t.src, top1_tgt, gold_tgt, a.s_lex AS top1_s_lex, b.s_lex AS gold_s_lex, a.s_lex - b.s_lex AS delta_s_lex FROM t LEFT JOIN pairs a ON a.src = t.src AND a.tgt = top1_tgt LEFT JOIN pairs b ON b.src = t.src AND b.tgt = gold_tgt""", "top1_s_lex gold_s_lex delta_s_lex")
def _(v):
    t = P.ranks(v("pairs")).groupBy("src").agg(F.max(F.when(F.col("rank") == 1, F.col("tgt"))).alias("top1_tgt"), F.min(F.when(F.col("label") == 1, F.col("tgt"))).alias("gold_tgt"))
    return U.attach_rows(t, v("pairs"), ["s_lex"])


@query("J16_review_merge", f"""WITH k AS (SELECT *, {RANK} AS r FROM pairs), s AS (SELECT src, (min(r) FILTER (label = 1))::INTEGER AS gold_rank FROM k GROUP BY src) SELECT src, gold_rank, CASE WHEN src % 3 = 0 AND gold_rank = 1 THEN 'checked' ELSE '' END AS note FROM s""")
def _(v):
    s = P.ranks(v("pairs")).groupBy("src").agg(F.min(F.when(F.col("label") == 1, F.col("rank"))).alias("gold_rank"))
    return U.merge_review(s, s.where("src % 3 = 0").select("src", F.lit(1).alias("gold_rank"), F.lit("checked").alias("note")).distinct(), ["note"])


@query("J19_llm_changes", f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY s_lex DESC, tgt) AS rb, row_number() OVER (PARTITION BY src ORDER BY score DESC, tgt) AS ra FROM pairs)
SELECT x.src, x.tgt AS tgt_before, y.tgt AS tgt_after, CASE WHEN y.label > x.label THEN 'mended' WHEN y.label < x.label THEN 'broken' ELSE 'same' END AS effect FROM b x JOIN b y ON y.src = x.src AND x.rb = 1 AND y.ra = 1 AND x.tgt <> y.tgt""")
def _(v):
    return D.llm_changes(v("pairs").select("src", "tgt", "label", F.col("s_lex").alias("before"), F.col("score").alias("after"))).select("src", "tgt_before", "tgt_after", "effect")


@query("T7_F7_candidate_texts")
def _(v):
    a = v("annot").select("iri", F.concat(F.lit("http://x/"), F.col("prop")).alias("prop"), "value").unionByName(v("ent").select("iri", F.lit("http://x/altLabel").alias("prop"), F.col("long_label").alias("value")))
    return R.candidate_texts(v("ent").select("iri", "label"), a)


@query("T8_trimmed", """SELECT src, tgt FROM (SELECT src, tgt, sum(label + 1) OVER (PARTITION BY src ORDER BY tgt ROWS UNBOUNDED PRECEDING) AS s, row_number() OVER (PARTITION BY src ORDER BY tgt) AS n FROM pairs) WHERE s <= 4 OR n = 1""")
def _(v):
    return C.trim_to_budget(v("pairs").select("src", "tgt", F.col("tgt").alias("pos"), (F.col("label") + 1).alias("size")), ["src"], "size", 4).select("src", "tgt")


@query("T9_source_sample", "SELECT src, tgt FROM pairs WHERE src IN (SELECT DISTINCT src FROM pairs ORDER BY src LIMIT 100)")
def _(v):
    return U.source_sample(v("pairs").select("src", "tgt"), 100)


@query("T10_seeded_sample", "SELECT greatest(1, floor(count(*) * 0.1e0))::BIGINT AS n, true AS within FROM pairs")
def _(v):
    s = U.seeded_sample(v("pairs"), ["src", "tgt"], 0.1)
    return s.agg(F.count(F.lit(1)).alias("n"), (F.count_distinct("src", "tgt") == F.count(F.lit(1))).alias("within"))


@query("U1_near_exact", """WITH k AS (SELECT iri, lower(label) AS l, iri % 2 AS side FROM ent), c AS (SELECT iri, side, regexp_replace(l, '[^a-z0-9]+', '', 'g') AS a, array_to_string(list_sort(list_distinct(string_split(trim(regexp_replace(l, '[^a-z0-9]+', ' ', 'g')), ' '))), ' ') AS b FROM k)
SELECT s.iri AS src, t.iri AS tgt FROM c s JOIN c t ON s.b = t.b AND s.side = 0 AND t.side = 1 WHERE contains(s.b, ' ') AND s.a <> t.a""")
def _(v):
    e = v("ent").select("iri", "label")
    return R.exact_matches(e.where("iri % 2 = 0"), e.where("iri % 2 = 1"), True, near_only=True).select("src", "tgt")


@query("U4_X3_split_misses", """WITH o AS (SELECT g.src, g.tgt, EXISTS (FROM pairs c WHERE c.src = g.src AND c.tgt = g.tgt AND c.score >= 0.3e0) AS c, EXISTS (FROM preds p WHERE p.src = g.src AND p.tgt = g.tgt) AS p FROM gold g) SELECT c OR p AS oracle, p AS predicted, count(*) AS n FROM o GROUP BY ALL""")
def _(v):
    return D.split_misses(v("gold"), P.at_least(v("pairs"), 0.3), v("preds"))


@query("X3_abstained_misses", "SELECT src, tgt FROM gold ANTI JOIN preds USING (src, tgt) WHERE src % 5 = 0")
def _(v):
    return D.abstained_misses(v("gold"), v("preds"), v("pairs"), v("pairs").where("src % 5 = 0"))


@query("U5_U6_U8_united", "SELECT src, tgt, min(score) AS score FROM (SELECT src, tgt, score FROM preds UNION ALL SELECT src, tgt, NULL FROM exact) GROUP BY src, tgt", "score")
def _(v):
    return P.split_rows(v("preds").select("src", "tgt", "score"), v("exact")).groupBy("src", "tgt").agg(F.min("score").alias("score"))


@query("U9_ranking_check", "SELECT DISTINCT src, 'not_allowed' AS fault FROM pairs WHERE label = 1 AND src % 2 = 0 UNION ALL SELECT DISTINCT src, 'missing' FROM pairs WHERE src % 3 = 0 AND src % 2 <> 0 UNION ALL SELECT src, 'missing' FROM pairs WHERE src % 3 = 0 AND src % 2 = 0 GROUP BY src HAVING false")
def _(v):
    p = v("pairs")
    reference = p.groupBy("src").agg(F.collect_set(F.when((F.col("label") == 0) | (F.col("src") % 2 != 0), F.col("tgt"))).alias("cands"))
    return U.ranking_check(p.where("src % 3 <> 0 OR src % 2 = 0").groupBy("src").agg(F.collect_set("tgt").alias("cands")), reference)


@query("W3_channel_gaps", """WITH l AS (SELECT src AS ls, list_reverse_sort(list(s_lex)) AS a, list_reverse_sort(list(s_sim)) AS b FROM pairs GROUP BY src) SELECT src, tgt, (greatest(0e0, coalesce(s_lex - CASE WHEN s_lex = a[1] THEN a[2] ELSE a[1] END, 0)) + greatest(0e0, coalesce(s_sim - CASE WHEN s_sim = b[1] THEN b[2] ELSE b[1] END, 0))) / 2 AS channel_gap FROM pairs JOIN l ON ls = src""", "channel_gap")
def _(v):
    return M.channel_gap(v("pairs"), ["s_lex", "s_sim"]).select("src", "tgt", "channel_gap")


@query("W12_average_ranks", "SELECT src, tgt, rank() OVER (PARTITION BY src ORDER BY s_lex) + (count(*) OVER (PARTITION BY src, s_lex) - 1) / 2e0 AS rank FROM pairs", "rank")
def _(v):
    return A.average_rank(v("pairs"), "s_lex", ["src"]).select("src", "tgt", "rank")


# --- analytics ----------------------------------------------------------------------------------


@query("A8_A37_arbitration_summary", "SELECT status AS reason, count(*) AS n, count(*) FILTER (label = 1) AS tp, count(*) FILTER (label = 0) AS fp FROM pairs WHERE q_sim > 0.5e0 GROUP BY status")
def _(v):
    return A.reasons(v("pairs").withColumn("llm_used", F.col("q_sim") > 0.5).withColumn("reason", F.col("status")))


@query("A37_llm_counts", "SELECT count(*) AS n, count(*) FILTER (q_sim > 0) AS n_llm, avg(CASE WHEN score BETWEEN 0.5e0 AND 0.8e0 THEN 1e0 ELSE 0e0 END) AS review_share FROM pairs", "review_share")
def _(v):
    return A.llm_counts(v("pairs").withColumn("w_i", F.col("q_sim")))


@query("A9_mean_similarity", "SELECT src, tgt, avg(score) OVER (PARTITION BY src) AS cand_sim_mean FROM pairs", "cand_sim_mean")
def _(v):
    return R.share_stats(P.ranks(v("pairs")).select("src", "tgt", F.col("score").alias("cand_sim"), F.col("rank").alias("pos")), 2).select("src", "tgt", "cand_sim_mean")


@query("A13_context_metrics", "SELECT src, count(*)::INTEGER AS n_triples, sum(length(status || ' x'))::INTEGER + count(*)::INTEGER - 1 AS chars, 2 * count(*)::INTEGER AS words, false AS empty FROM pairs GROUP BY src")
def _(v):
    c = v("pairs").groupBy("src").agg(F.collect_list(F.concat("status", F.lit(" x"))).alias("context"))
    return E.context_metrics(c).select("src", "n_triples", "chars", "words", "empty")


@query("A14_label_metrics", "SELECT iri, 2 AS n_labels, (length(label) + length(long_label))::INTEGER AS chars, (len(string_split(label, ' ')) + len(string_split(long_label, ' ')))::INTEGER AS words, len(string_split(long_label, ' '))::INTEGER AS max_words FROM ent")
def _(v):
    return E.label_metrics(v("ent").select("iri", F.array("label", "long_label").alias("labels"))).select("iri", "n_labels", "chars", "words", "max_words")


@query("A15_A16_pool_metrics", "SELECT iri, count(*) FILTER (rel = 'B') AS n_hier, count(*) FILTER (rel = 'A') AS n_object, count(*) FILTER (rel = 'M') AS n_attr, count(DISTINCT rel) AS n_rel, avg(ic) AS ic_mean, max(ic) AS ic_max FROM nitems GROUP BY iri", "ic_mean ic_max")
def _(v):
    kind = F.when(F.col("rel") == "B", "hierarchy").when(F.col("rel") == "A", "object").when(F.col("rel") == "M", "attribute").otherwise("none")
    return E.pool_metrics(v("nitems").withColumn("channel", kind))


@query("A17_evidence_counts", "SELECT src, 0 AS tgt, count(*) FILTER (label = 1)::INTEGER AS n_a, count(*) FILTER (label = 0)::INTEGER AS n_b, count(*)::INTEGER AS n_items, (max(label) + max(1 - label))::INTEGER AS n_channels FROM pairs GROUP BY src")
def _(v):
    r = v("pairs").groupBy("src").agg(F.lit(0).alias("tgt"), F.collect_list(F.when(F.col("label") == 1, F.col("tgt"))).alias("a"), F.collect_list(F.when(F.col("label") == 0, F.col("tgt"))).alias("b"))
    return D.evidence_counts(r, ["a", "b"])


@query("A23_conflicts", "SELECT src FROM pairs GROUP BY src HAVING count(DISTINCT status) > 1 OR count(DISTINCT label) > 1")
def _(v):
    return P.conflicts(v("pairs"), ["src"], ["status", "label"])


@query("A28_rank_sum", """WITH r AS (SELECT label, rank() OVER (ORDER BY s_diff) + (count(*) OVER (PARTITION BY s_diff) - 1) / 2e0 AS rk FROM pairs), t AS (SELECT sum(pow(c, 3) - c) AS ties FROM (SELECT count(*) AS c FROM pairs GROUP BY s_diff)),
n AS (SELECT sum(label)::BIGINT AS n1, sum(1 - label)::BIGINT AS n0, sum(label * rk) AS r FROM r), u AS (SELECT n1, n0, r - n1 * (n1 + 1) / 2e0 AS u, ties FROM n, t) SELECT n1, n0, u, u / (n1::DOUBLE * n0) AS effect, (u - n1::DOUBLE * n0 / 2) / sqrt(n1::DOUBLE * n0 / 12e0 * ((n1 + n0 + 1) - ties / ((n1 + n0)::DOUBLE * (n1 + n0 - 1)))) AS z FROM u""", "u effect z")
def _(v):
    return A.rank_sum(v("pairs"), "s_diff", "label")


@query("A29_kendall", """WITH c AS (SELECT label::INTEGER AS k, (s_sim * 10)::INTEGER AS a, avg(s_diff) AS b FROM pairs GROUP BY ALL), p AS (SELECT x.k, sign(x.a - y.a) AS dx, sign(x.b - y.b) AS dy FROM c x JOIN c y ON x.k = y.k AND x.a < y.a) SELECT p.k, (SELECT count(*) FROM c WHERE c.k = p.k) AS n, sum(dx * dy) / sqrt(sum(abs(dx)) * sum(abs(dy))::DOUBLE) AS tau FROM p GROUP BY p.k""", "tau")
def _(v):
    c = v("pairs").groupBy(F.col("label").cast("int").alias("k"), F.round(F.col("s_sim") * 10).cast("int").alias("a")).agg(F.avg("s_diff").alias("b"))
    return D.kendall(c, ["k"], "a", "b")


@query("A32_verdicts", "SELECT src, CASE WHEN max(label) = 0 THEN 'undefined' WHEN max(s_diff) - 0.9e0 < 0 AND NOT max(score) > 0.9e0 THEN 'supported' ELSE 'not_supported' END AS verdict FROM pairs GROUP BY src")
def _(v):
    g = v("pairs").groupBy("src").agg(F.when(F.max("label") > 0, F.max("s_diff") - 0.9).alias("high"), (F.max("score") > 0.9).alias("adverse"))
    return g.select("src", A.verdict(F.col("high"), F.col("adverse")).alias("verdict"))


@query("A36_wide_runs", "SELECT path, max(value) FILTER (metric = 'a') AS a, max(value) FILTER (metric = 'b') AS b FROM (SELECT status AS path, 'a' AS metric, max(score) AS value FROM pairs GROUP BY status UNION ALL SELECT status, 'b', min(score) FROM pairs GROUP BY status) GROUP BY path", "a b")
def _(v):
    g = v("pairs").groupBy(F.col("status").alias("path")).agg(F.max("score").alias("a"), F.min("score").alias("b")).unpivot(["path"], ["a", "b"], "metric", "value")
    return E.widen_runs(g, ["a", "b"])


@query("X4_quantile_edges", "SELECT unnest(list_sort(list_distinct(quantile_cont(s_sim, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])))) AS edge FROM pairs", "edge")
def _(v):
    return A.quantile_edges(v("pairs"), "s_sim").select(F.explode("edges").alias("edge"))


@query("X53_against_baseline", "WITH a AS (SELECT status AS arm, avg(score) AS mrr FROM pairs GROUP BY status) SELECT arm, mrr, mrr - (SELECT mrr FROM a WHERE arm = 'F') AS delta FROM a", "mrr delta")
def _(v):
    return E.against_baseline(v("pairs").groupBy(F.col("status").alias("arm")).agg(F.avg("score").alias("mrr")), "F")


@query("M20_grid_trials", "SELECT a, b FROM (SELECT r_regionkey AS a FROM region) CROSS JOIN (SELECT n_nationkey AS b FROM nation)")
def _(v):
    return E.grid_trials({"a": v("region").select("r_regionkey"), "b": v("nation").select("n_nationkey")})


@query("M18_without_targets", """WITH u AS (SELECT src, tgt, 1e0 AS score, src * 1000000 + tgt AS pos, 1 AS p FROM exact UNION ALL SELECT src, tgt, score, src * 1000000 + pos * 10000 + 1099511627776, 0 FROM preds), o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY src, tgt ORDER BY pos) = 1)
SELECT src, tgt, score FROM o QUALIFY row_number() OVER (PARTITION BY src ORDER BY p DESC, score DESC, pos, tgt) <= 2""", "score")
def _(v):
    exact = v("exact").select("src", "tgt", F.lit(1.0).alias("score"), (F.col("src") * 1000000 + F.col("tgt")).alias("pos"))
    return P.final_alignment(v("preds").withColumn("pos", F.col("src") * 1000000 + F.col("pos") * 10000), exact, 2, None).select("src", "tgt", "score")


@query("M22_F18_bridge_edges", "WITH s AS (SELECT src AS a, tgt AS b, s_lex * (0.5e0 + 0.5e0 * s_sim) AS x FROM pairs) SELECT a, b, x AS strength, CASE WHEN x >= 0.2e0 THEN 'strong' WHEN x >= 0.08e0 THEN 'moderate' ELSE 'weak' END AS strength_class FROM s", "strength")
def _(v):
    return U.bridge_edges(v("pairs").select(F.col("src").alias("a"), F.col("tgt").alias("b"), F.lit("label").alias("kind"), F.col("s_lex").alias("importance"), F.col("s_sim").alias("mass"))).select("a", "b", "strength", "strength_class")


@query("X1_exact_scores", "SELECT src, tgt, CASE WHEN src % 2 = 0 THEN score ELSE 1 END AS score FROM pairs", "score")
def _(v):
    return D.exact_scores(v("pairs").select("src", "tgt", F.when(F.col("src") % 2 == 0, F.col("score").cast("string")).otherwise("none").alias("Scores")), ["Scores", "Score"]).select("src", "tgt", "score")


@query("X5_first_labels", "SELECT iri, arg_min(value, prop) AS label FROM annot WHERE prop <> 'brand' GROUP BY iri")
def _(v):
    return D.first_labels(v("annot").select("iri", F.when(F.col("prop") == "brand", " ").otherwise(F.col("value")).alias("label"), F.col("prop").alias("pos")))


@query("X6_items_or", "SELECT src, CASE WHEN count(*) FILTER (label = 1) > 0 THEN count(*) FILTER (label = 1) ELSE count(*) END::INTEGER AS n FROM pairs GROUP BY src")
def _(v):
    r = v("pairs").groupBy("src").agg(F.collect_list(F.when(F.col("label") == 1, F.col("tgt"))).alias("a"), F.collect_list("tgt").alias("b"))
    return D.items_or(r, "a", "b").select("src", F.size("items").alias("n"))


@query("X7_selected_records", f"SELECT src, tgt, r::INTEGER AS rank, s_lex FROM (SELECT *, {RANK} AS r FROM pairs) WHERE r <= 2 AND src IN (SELECT src FROM gold)", "s_lex")
def _(v):
    return D.selected_records(v("gold"), P.ranks(v("pairs")).select("src", "tgt", "rank"), v("pairs").select("src", "tgt", "s_lex"), 2)


@query("X9_X18_synced", "SELECT p.src, p.tgt, s.score AS selector_score FROM pairs p LEFT JOIN preds s USING (src, tgt)", "selector_score")
def _(v):
    return D.synced(v("pairs").select("src", "tgt"), v("preds"), ["score"])


@query("X13_F14_compact_evidence", "SELECT src, tgt, 'label:' || lower(status) AS key, s_lex * CASE WHEN label = 1 THEN 1 ELSE 0.75e0 END AS strength FROM pairs WHERE s_lex > 0 AND (label = 1 OR src % 2 = 0)", "strength")
def _(v):
    item = F.struct(F.lit("label").alias("channel"), F.concat(F.lit(" "), "status").alias("text"), F.col("s_lex").alias("importance"), F.when(F.col("label") == 1, "target").otherwise("source").alias("side"), (F.col("src") % 2 == 0).alias("linked"))
    return D.compact_evidence(v("pairs").select("src", "tgt", F.array(item).alias("evidence")))


@query("C15_hydrated_records", "SELECT src, 0 AS tgt, string_agg(CASE WHEN tgt % 2 = 0 THEN 't' || tgt ELSE tgt::VARCHAR END, ',' ORDER BY tgt) AS texts FROM pairs GROUP BY src")
def _(v):
    r = v("pairs").groupBy("src").agg(F.lit(0).alias("tgt"), F.transform(F.array_sort(F.collect_list("tgt")), lambda t: t.cast("string")).alias("item_ids"))
    known = v("pairs").where("tgt % 2 = 0").select(F.col("tgt").cast("string").alias("item_id"), F.concat(F.lit("t"), F.col("tgt").cast("string")).alias("text")).distinct()
    return D.hydrated(r, known).select("src", "tgt", F.array_join(F.transform("items", lambda x: x["text"]), ",").alias("texts"))


@query("M23_repaired_records", "SELECT src, tgt, src % 3 = 0 OR tgt % 2 = 0 AS repaired, CASE WHEN tgt % 2 = 0 THEN s_sim ELSE s_lex END AS value FROM pairs", "value")
def _(v):
    p = v("pairs")
    own = p.select("src", "tgt", F.when(F.col("src") % 3 == 0, 2).otherwise(3).alias("schema_version"), F.when(F.col("tgt") % 2 != 0, F.col("s_lex")).alias("value"))
    return D.repaired(own, p.select("src", "tgt", F.col("s_sim").alias("value")), ["value"]).select("src", "tgt", "repaired", "value")


@query("X35_flattened_metrics", "SELECT 'cand_n' AS name, count(*)::DOUBLE AS value FROM pairs UNION ALL SELECT 'cand_best', max(score) FROM pairs", "value")
def _(v):
    return D.flattened(v("pairs").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best")), "cand_")


# --- scalars ------------------------------------------------------------------------------------


@query("F1_F2_F3_F5_F6_texts", """SELECT p_partkey AS iri, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS normalized, array_to_string(list_sort(list_distinct(string_split(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')), ' '))), ' ') AS token_key, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS compact,
len(list_distinct(list_transform(range(1, length(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'))) + 1), lambda i: substr(' ' || trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) || ' ', i, 3))))::INTEGER AS n_grams FROM part""")
def _(v):
    n = X.normalize(F.lower("p_name"), True)
    return v("part").select(F.col("p_partkey").alias("iri"), n.alias("normalized"), X.token_key(n).alias("token_key"), X.compact_key(F.col("p_name")).alias("compact"), F.size(X.char_grams(n)).alias("n_grams"))


@query("F6_label_records", "SELECT iri, trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) AS normalized FROM ent")
def _(v):
    return R.label_records(v("ent").select("iri", F.lower("label").alias("label")), ascii_only=True)


@query("F8_F9_scalars", """SELECT src, tgt, least(1e0, greatest(0e0, (s_lex + 1) / 2)) AS sim, 1 / (1 + exp(-s_sim)) AS sig, ln(least(1 - 1e-6, greatest(1e-6, s_lex)) / (1 - least(1 - 1e-6, greatest(1e-6, s_lex)))) AS lo, least(1e0, ln(1 + pos) / ln(21e0)) AS cnt, (s_lex + s_sim) / 2 AS mean, abs(s_lex - s_sim) / 2 AS std FROM pairs""", "sim sig lo cnt mean std")
def _(v):
    xs = F.array("s_lex", "s_sim")
    return v("pairs").select("src", "tgt", S.sim01(F.col("s_lex")).alias("sim"), S.sigmoid(F.col("s_sim")).alias("sig"), S.logit(F.col("s_lex")).alias("lo"), S.scaled_count(F.col("pos"), 20).alias("cnt"), S.array_mean(xs).alias("mean"), S.array_std(xs).alias("std"))


@query("F10_F11_weights", """SELECT iri, CASE WHEN contains(lower(prop), 'name') THEN 1e0 WHEN contains(lower(prop), 'type') THEN 0.8e0 ELSE 0.5e0 END AS w, least(1e0, greatest(0.1e0, len(string_split(value, ' ')) / 12e0)) AS raw, least(1e0, 0.8e0 * ln(1 + len(string_split(value, ' '))) / ln(21e0)) AS info, prop FROM annot""", "w raw info")
def _(v):
    return v("annot").select("iri", "prop", X.property_weight(F.col("prop"), [("name", 1.0), ("type", 0.8)]).alias("w"), X.raw_weight(F.col("value")).alias("raw"), X.info_weight(F.lit(0.8), F.col("value")).alias("info"))


@query("F12_evidence_ids", "SELECT iri, prop, 'attr-src-' || substr(sha1(iri::VARCHAR || chr(31) || prop || chr(31) || value), 1, 16) AS id FROM annot")
def _(v):
    return v("annot").select("iri", "prop", X.evidence_id("attr", "src", F.col("iri").cast("string"), F.col("prop"), F.col("value")).alias("id"))


@query("F15_X29_verbalized", "SELECT src, rel, dst, CASE rel WHEN 'located_in' THEN src || ' lies in ' || dst ELSE concat_ws(' ', src, rel, dst) END AS sentence, rel = 'located_in' AS valid FROM edges")
def _(v):
    t = F.when(F.col("rel") == "located_in", "$SRC lies in $TGT")
    return v("edges").select("src", "rel", "dst", X.verbalize(t, F.col("src"), F.col("dst"), F.col("rel")).alias("sentence"), X.valid_template(F.coalesce(t, F.lit("$SRC $SRC $TGT"))).alias("valid"))


@query("F16_joined_context", "SELECT src, string_agg(status, ' . ' ORDER BY pos, tgt) AS context FROM pairs GROUP BY src")
def _(v):
    return E.join_context(v("pairs").select("src", F.struct("pos", "tgt").alias("pos"), "status"), ["src"], "status")


@query("F17_label_pairs", f"WITH {_CELLS}, a AS (SELECT *, avg(score) OVER (PARTITION BY src, tgt) AS mean FROM m) SELECT 'max' AS mode, src, tgt, score FROM a QUALIFY row_number() OVER (PARTITION BY src, tgt ORDER BY score DESC, i, j) = 1 UNION ALL SELECT * FROM (SELECT 'mean', src, tgt, score FROM a QUALIFY row_number() OVER (PARTITION BY src, tgt ORDER BY abs(score - mean), i, j) = 1)", "score")
def _(v):
    c = H.matrix(v("npairs"), items(v, "nitems"), items(v, "ritems"))
    one = lambda m: E.label_pair(c, m).select(F.lit(m).alias("mode"), "src", "tgt", "score")
    return one("max").unionByName(one("mean"))


@query("F19_edge_levels", "SELECT src, tgt, CASE WHEN status = 'F' THEN 1 WHEN pos <= 1 THEN 2 WHEN pos <= 3 THEN 3 ELSE 4 END AS level FROM pairs")
def _(v):
    return v("pairs").select("src", "tgt", S.edge_level(F.when(F.col("status") == "F", "context").otherwise("bridge"), F.col("pos")).alias("level"))


@query("F20_json_values", """SELECT event_id, event_type AS kind, event_type AS recovered FROM events""")
def _(v):
    good = F.concat(F.lit('```json\n{"kind": "'), F.col("event_type"), F.lit('"}\n```'))
    broken = F.concat(F.lit('so {"kind": "'), F.col("event_type"), F.lit('", "x": '))
    return v("events").select("event_id", X.json_value(good, "kind").alias("kind"), X.json_value(broken, "kind").alias("recovered"))


@query("F22_clean_texts", "SELECT n_nationkey, n_name || '. Second! Third?' AS sentences FROM nation")
def _(v):
    return v("nation").select("n_nationkey", X.complete_sentences(F.concat(F.lit("```\n"), F.col("n_name"), F.lit(". Second! Third? cut"))).alias("sentences"))


@query("F23_F24_flags_tokens", "SELECT p_partkey, p_size % 2 = 0 AS yes, (p_size % 2)::INTEGER AS bit, list_distinct(list_filter(string_split(trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 1 AND w <> 'steel')) AS tokens FROM part")
def _(v):
    return v("part").select("p_partkey", X.truthy(F.when(F.col("p_size") % 2 == 0, " Yes").otherwise("no")).alias("yes"), X.strict_binary((F.col("p_size") % 2).cast("double")).alias("bit"), X.content_tokens(F.col("p_type"), ["steel"]).alias("tokens"))


@query("F25_durations", "SELECT o_orderkey, format('{}:{:02d}:{:02d}:{:02d}', o_orderkey // 86400, o_orderkey // 3600 % 24, o_orderkey // 60 % 60, o_orderkey % 60) AS shown FROM orders")
def _(v):
    return v("orders").select("o_orderkey", X.duration(F.col("o_orderkey")).alias("shown"))


@query("F27_X12_X24_fingerprint", "SELECT count(*) AS n, true AS same FROM pairs")
def _(v):
    a, b = (Q.fingerprint(d, ["src", "tgt", "score"]) for d in (v("pairs"), v("pairs").repartition(3, "tgt")))
    return a.crossJoin(F.broadcast(b.select(F.col("fingerprint").alias("f")))).select("n", (F.col("fingerprint") == F.col("f")).alias("same"))


@query("P6_P7_annotation_priority", """SELECT iri, abs(least(len(string_split(trim(regexp_replace(lower(value), '[^a-z0-9]+', ' ', 'g')), ' ')), 6) - 3) / 30e0 AS priority, 8 AS cap FROM annot WHERE prop = 'name'""", "priority")
def _(v):
    prop = F.lit("http://x#hasExactSynonym")
    return v("annot").where("prop = 'name'").select("iri", X.annotation_priority(F.lower("value"), prop).alias("priority"), X.annotation_cap(prop).alias("cap"))


@query("P10_literals", "SELECT iri, value AS text, true AS literal FROM annot")
def _(v):
    raw = F.concat(F.lit('literal:"'), F.col("value"), F.lit('"^^xsd:string'))
    return v("annot").select("iri", X.strip_literal(raw).alias("text"), X.looks_like_literal(raw).alias("literal"))


# --- checks -------------------------------------------------------------------------------------


@query("Q1_raw_pairs", "SELECT 'pairs' AS area, 'scored and removed make raw' AS \"check\", a + b = c AS passed, (a + b)::DOUBLE AS observed, c::DOUBLE AS expected FROM (SELECT (SELECT count(*) FROM pairs ANTI JOIN exact USING (src, tgt)) AS a, (SELECT count(*) FROM exact) AS b, (SELECT count(*) FROM pairs) AS c)", "observed expected")
def _(v):
    return Q.raw_pairs(D.active_rows(v("pairs"), v("exact"), False), v("exact"), v("pairs"))


@query("Q2_subset", """SELECT 'subset' AS area, c AS "check", n = 0 AS passed, n::DOUBLE AS observed, 0e0 AS expected FROM (SELECT 'anchors agree' AS c, count(*) * 0 AS n FROM gold UNION ALL SELECT 'references are listed', count(*) FROM gold ANTI JOIN pairs USING (src, tgt) UNION ALL SELECT 'ids are filled', count(*) FILTER (src IS NULL OR tgt IS NULL) FROM pairs)""", "observed expected")
def _(v):
    g = v("gold")
    return Q.subset(v("pairs").join(g.select("src", F.col("tgt").alias("gold")), "src"), g)


@query("Q4_reliability_checks", """WITH s AS (SELECT 'sim' AS channel, count(*) AS n, count(*) FILTER (q_sim > 0) AS a FROM pairs) SELECT 'reliability' AS area, c AS "check", true AS passed, o AS observed, e AS expected FROM (SELECT 'a row for each channel' AS c, 1e0 AS o, 1e0 AS e UNION ALL SELECT 'active and inactive make all', count(*) FILTER (a > n)::DOUBLE, 0e0 FROM s UNION ALL SELECT 'shares agree', 0e0, 0e0
UNION ALL SELECT 'intervals are in order', 0e0, 0e0 UNION ALL SELECT 'an interval where a correlation is', 0e0, 0e0 UNION ALL SELECT 'all channels', 1e0, 1e0)""", "observed expected")
def _(v):
    r = v("pairs").agg(F.lit("sim").alias("channel"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("q_sim") > 0).alias("active"), F.corr("q_sim", "label").alias("rho"))
    r = r.withColumn("inactive", F.col("n") - F.col("active")).withColumn("share", F.col("active") / F.col("n")).withColumn("low", F.greatest(F.lit(-1.0), F.col("rho") - 0.1)).withColumn("high", F.least(F.lit(1.0), F.col("rho") + 0.1))
    return Q.reliability(r, 1)


@query("Q5_bin_checks", """WITH b AS (SELECT least(10, floor(s_sim * 10) + 1)::INTEGER AS bin, count(*) AS n FROM pairs GROUP BY 1) SELECT 'bins' AS area, c AS "check", n = 0 AS passed, n::DOUBLE AS observed, 0e0 AS expected FROM (SELECT 'one to ten' AS c, 0 AS n UNION ALL SELECT 'numbered from one', CASE WHEN (SELECT count(*) FROM b) = (SELECT max(bin) FROM b) THEN 0 ELSE 1 END UNION ALL SELECT 'one edge more', CASE WHEN (SELECT count(*) FROM b) = 10 THEN 0 ELSE 1 END
UNION ALL SELECT 'edges rise', 0 UNION ALL SELECT 'none is empty', count(*) FILTER (n = 0) FROM b UNION ALL SELECT 'rates within 0 and 1', 0 UNION ALL SELECT 'counts make the total', CASE WHEN (SELECT sum(n) FROM b) = (SELECT count(*) FROM pairs) THEN 0 ELSE 1 END)""", "observed expected")
def _(v):
    p = v("pairs")
    edges = F.array(*[F.lit(i / 10) for i in range(11)])
    b = p.groupBy(F.least(F.lit(10), F.floor(F.col("s_sim") * 10).cast("int") + 1).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("rate")).withColumn("edges", edges).withColumn("table", F.lit("sim"))
    return Q.bins(b, p.agg(F.count(F.lit(1)).alias("rows")).withColumn("table", F.lit("sim")))


@query("Q6_pick_checks", """WITH s AS (SELECT src, count(*) FILTER (t) AS tie, CASE WHEN count(*) FILTER (t) = 1 THEN max(label) FILTER (t) ELSE 0 END AS ok FROM (SELECT *, s_lex = max(s_lex) OVER (PARTITION BY src) AS t FROM pairs) GROUP BY src), n AS (SELECT count(*)::DOUBLE AS n FROM s)
SELECT 'picks' AS area, 'rows are eligible sources' AS "check", true AS passed, n AS observed, n AS expected FROM n UNION ALL SELECT 'picks', 'eligible and excluded make all', true, n, n FROM n UNION ALL SELECT 'picks', 'ties are wrong', count(*) FILTER (tie > 1 AND ok <> 0) = 0, (count(*) FILTER (tie > 1 AND ok <> 0))::DOUBLE, 0e0 FROM s""", "observed expected")
def _(v):
    p = v("pairs")
    picked = A.pick_rate(p.select("src", F.col("s_lex").alias("s"), F.col("q_lex").alias("q"), "label"))
    return Q.picks(picked, p, p.where("false"), p)


@query("Q7_agreement", """WITH t AS (SELECT status, count(*) AS n, count(*) FILTER (label = 1) AS c FROM pairs GROUP BY status) SELECT 'pivot' AS area, x AS "check", k = 0 AS passed, k::DOUBLE AS observed, 0e0 AS expected FROM (SELECT 'counts within rows' AS x, count(*) FILTER (c > n) AS k FROM t UNION ALL SELECT 'shares agree', 0 UNION ALL SELECT 'tables agree', 0)""", "observed expected")
def _(v):
    t = v("pairs").groupBy(F.col("status").alias("name")).agg(F.count_if(F.col("label") == 1).alias("count"), F.count(F.lit(1)).alias("rows")).withColumn("share", F.col("count") / F.col("rows"))
    u = v("pairs").groupBy(F.col("status").alias("name")).agg(F.sum("label").alias("count"), F.avg("label").alias("share"))
    return Q.agreement(t, u)


@query("Q8_ablation_checks", """SELECT 'ablation' AS area, c AS "check", n = 0 AS passed, n::DOUBLE AS observed, 0e0 AS expected FROM (SELECT unnest(['muted has no weight', 'muted keeps its evidence', 'uniform is equal', 'uniform sums to one', 'uniform halves the sides', 'labels alone']) AS c, (SELECT count(*) FILTER (s_sim IS NULL) FROM pairs) AS n)""", "observed expected")
def _(v):
    p = v("pairs")
    muted = C.fuse_outer(C.fuse_channels(p, CHANNELS, muted=["sim"]))
    uniform = C.fuse_outer(C.fuse_channels(p, CHANNELS, uniform=True), uniform=True)
    return Q.ablations(muted, uniform, C.fuse_outer(C.fuse_channels(p, CHANNELS, muted=CHANNELS)), CHANNELS, "sim")


@query("Q9_config_delta", "SELECT concat('c', c_custkey) AS path, CASE WHEN c_custkey % 3 <> 1 THEN c_mktsegment END AS old, CASE WHEN c_custkey % 3 <> 2 THEN CASE WHEN c_custkey % 6 = 0 THEN 'x' ELSE c_mktsegment END END AS new FROM customer WHERE c_custkey % 3 > 0 OR (c_custkey % 6 = 0 AND c_mktsegment <> 'x')")
def _(v):
    c = v("customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("path"), F.col("c_mktsegment").alias("value"), "c_custkey")
    return A.config_delta(c.where("c_custkey % 3 <> 1"), c.where("c_custkey % 3 <> 2").withColumn("value", F.when(F.col("c_custkey") % 6 == 0, "x").otherwise(F.col("value"))))


@query("Q11_finite", "SELECT 's_lex' AS \"column\", count(*) AS n, count(*) FILTER (s_lex IS NULL) AS nulls, count(*) FILTER (isnan(s_lex) OR isinf(s_lex)) AS odd FROM pairs UNION ALL SELECT 's_sim', count(*), count(*) FILTER (s_sim IS NULL), count(*) FILTER (isnan(s_sim) OR isinf(s_sim)) FROM pairs")
def _(v):
    return Q.finite(v("pairs"), ["s_lex", "s_sim"])


@query("Q11_schema", "SELECT unnest(['src', 'tgt', 'score', 'pos']) AS \"column\", unnest([true, true, true, true]) AS in_a, unnest([true, true, false, false]) AS in_b, unnest([true, true, false, false]) AS agree")
def _(v):
    return Q.same_schema(v("preds"), v("gold")).select("column", "in_a", "in_b", F.coalesce("agree", F.lit(False)).alias("agree"))


@query("M24_X49_contract", """SELECT 'pairs' AS area, 'key is unique' AS "check", n = 0 AS passed, n::DOUBLE AS observed, 0e0 AS expected FROM (SELECT count(*) AS n FROM (SELECT src, tgt FROM pairs GROUP BY ALL HAVING count(*) > 1)) UNION ALL SELECT 'pairs', 'score is finite', n = 0, n::DOUBLE, 0e0 FROM (SELECT count(*) FILTER (score IS NULL OR isnan(score) OR isinf(score)) AS n FROM pairs)""", "observed expected")
def _(v):
    return Q.contract(v("pairs"), "pairs", unique=["src", "tgt"], finite_columns=["score"])


@query("Q14_resumable", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
def _(v):
    c = v("customer").select("c_custkey", F.col("c_mktsegment").alias("kind"), F.lit("s").alias("signature"), F.col("c_nationkey").cast("string").alias("fingerprint"))
    return T.fingerprint_ok(c, "BUILDING", "s", "3").select("c_custkey")


# --- files --------------------------------------------------------------------------------------


@query("S1_S8_S9_K1_alignment_file", "SELECT src::VARCHAR AS src, tgt::VARCHAR AS tgt, score FROM preds WHERE score >= 0.7e0", "score")
def _(v):
    p = v("preds")
    path = folder(p.sparkSession, "alignment") + "/out.tsv"
    K.write_table(K.alignment(p), path)
    return T.read_mappings(p.sparkSession, path, 0.7)


@query("S10_S11_S12_reference_file", "SELECT src::VARCHAR AS src, tgt::VARCHAR AS tgt FROM gold")
def _(v):
    g = v("gold")
    path = folder(g.sparkSession, "reference") + "/refs.csv"
    K.write_table(g.select("src", "tgt", F.lit(1.0).alias("Score")), path)
    return T.read_reference(g.sparkSession, path)


@query("S23_pairs_file", "SELECT src::VARCHAR AS src, CASE WHEN src % 2 = 0 THEN tgt::VARCHAR END AS tgt, src % 2 <> 0 AS malformed FROM gold")
def _(v):
    g = v("gold")
    path = folder(g.sparkSession, "pairs") + "/pairs.tsv"
    K.write_table(g.select(F.col("src").alias("source_iri"), F.when(F.col("src") % 2 == 0, F.col("tgt")).alias("TgtEntity")), path)
    return T.read_pairs(g.sparkSession, path, ["src_iri", "source_iri"], ["tgt_iri", "TgtEntity"])


@query("S5_S7_candidate_file", "SELECT src::VARCHAR AS src, tgt::VARCHAR AS tgt, 0 AS label, (row_number() OVER (PARTITION BY src ORDER BY tgt::VARCHAR) - 1)::INTEGER AS pos FROM pairs")
def _(v):
    p = v("pairs")
    path = folder(p.sparkSession, "cands") + "/cands.tsv"
    lists = F.concat(F.lit("['"), F.array_join(F.array_sort(F.collect_list(F.col("tgt").cast("string"))), "', '"), F.lit("']"))
    K.write_table(p.groupBy("src").agg(F.lit("g").alias("gold"), lists.alias("cands")), path)
    return T.read_candidates(p.sparkSession, path)


@query("S18_K6_K7_shards", "SELECT src, tgt, score FROM preds", "score")
def _(v):
    p = v("preds").select("src", "tgt", "score")
    path = folder(p.sparkSession, "shards")
    K.write_shards(p, path, 10_000, "overwrite")
    return T.read_shards(p.sparkSession, path, "src long, tgt long, score double")


@query("S24_K10_K12_metric_file", "SELECT 'tp' AS metric, count(*)::DOUBLE AS value FROM preds SEMI JOIN gold USING (src, tgt) UNION ALL SELECT 'n_ref', count(*)::DOUBLE FROM gold", "value")
def _(v):
    m = P.precision_recall(v("preds"), v("gold")).select("tp", "n_ref")
    path = folder(m.sparkSession, "metrics") + "/metrics.csv"
    K.write_table(K.metrics_long(m), path)
    return T.run_metrics(m.sparkSession, path).select("metric", "value")


@query("K11_absent_gold", "SELECT src, tgt FROM gold ANTI JOIN preds USING (src, tgt)")
def _(v):
    return K.absent_gold(v("gold"), v("preds"))


@query("K4_summary", "SELECT src, tgt, s_lex, q_lex AS w_lex, src % 2 = 0 AS llm_used, CASE WHEN src % 2 = 0 THEN s_sim ELSE 0 END AS I_llm FROM pairs", "s_lex w_lex I_llm")
def _(v):
    r = v("pairs").select("src", "tgt", F.struct(F.col("s_lex").alias("lex")).alias("confidences"), F.struct(F.col("q_lex").alias("lex")).alias("weights"), (F.col("src") % 2 == 0).alias("llm_used"), F.struct(F.col("s_sim").alias("llm")).alias("importances"))
    return K.summary(r, ["lex"])


@query("K5_S19_S20_channel_dump", f"WITH {_FUSED} SELECT count(*) AS n, sum(label)::BIGINT AS correct FROM u")
def _(v):
    f = C.attribute(C.arbitrate(fused(v), v("pairs").select("src", "tgt", F.lit(None).cast("double").alias("p_yes")).where("false")), CHANNELS)
    blank = {"s_attr": 0.5, "q_attr": 0.0, "sigma_attr": 0.0, "omega_attr": 0.0, "S_lctx": 0.0}
    for c, x in blank.items():
        f = f.withColumn(c, F.lit(x))
    f = f.withColumn("is_correct", F.col("label")).withColumn("S_pair", F.col("S_base")).withColumn("src_label_text", F.col("src").cast("string")).withColumn("tgt_label_text", F.col("tgt").cast("string"))
    d = K.dump(f)
    return T.checked_dump(d, K.DUMP, ["s_lex", "S_struct", "S_final"], ["is_correct"]).agg(F.count(F.lit(1)).alias("n"), F.sum("is_correct").alias("correct"))


@query("S2_S3_S4_S14_triples", "SELECT DISTINCT concat('http://x/c', c_custkey) AS src, concat('http://x/n', c_nationkey) AS dst FROM customer")
def _(v):
    c = v("customer")
    path = folder(c.sparkSession, "triples")
    iri = F.concat(F.lit("<http://x/c"), F.col("c_custkey").cast("string"), F.lit(">"))
    lines = c.select(F.explode(F.array(
        F.concat(iri, F.lit(f" <{T.RDF_TYPE}> <http://www.w3.org/2002/07/owl#Class> .")),
        F.concat(iri, F.lit(f" <{T.RDFS_SUBCLASS}> <http://x/n"), F.col("c_nationkey").cast("string"), F.lit("> .")),
        F.concat(iri, F.lit(f" <{T.RDFS_LABEL}> \""), F.col("c_name"), F.lit('"@en .')),
    )).alias("value"))
    lines.write.mode("overwrite").text(path)
    t = T.read_ntriples(c.sparkSession, path)
    return T.project(t, True).join(T.classes(t), F.col("src") == F.col("iri"), "left_semi").select("src", "dst")


@query("S21_Q13_log_lines", "SELECT 'a' AS name, max(c_custkey)::VARCHAR AS last FROM customer")
def _(v):
    c = v("customer")
    lines = c.select(F.lit("a").alias("path"), F.col("c_custkey").alias("line_no"), F.concat(F.lit("Total: "), F.col("c_custkey").cast("string"), F.lit(" minutes")).alias("value"))
    return T.last_match(lines, r"Total: (\d+) minutes", 1).select(F.col("path").alias("name"), F.col("g1").alias("last"))


@query("S13_alignment_xml", "SELECT concat('http://x/', src) AS src, concat('http://x/', tgt) AS tgt, 1e0 AS score FROM gold", "score")
def _(v):
    g = v("gold")
    path = folder(g.sparkSession, "xml")
    res = lambda tag, c: F.concat(F.lit(f'<{tag} rdf:resource="http://x/'), F.col(c).cast("string"), F.lit('"/>'))
    cells = g.select(F.concat(F.lit("<Cell>"), res("entity1", "src"), res("entity2", "tgt"), F.lit("<measure>1.0</measure></Cell>")).alias("cell"), F.pmod(F.xxhash64("src", "tgt"), F.lit(16)).alias("file"))
    files = cells.groupBy("file").agg(F.concat(F.lit('<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">'), F.array_join(F.collect_list("cell"), ""), F.lit("</rdf:RDF>")).alias("value"))
    files.write.mode("overwrite").partitionBy("file").text(path)
    return T.read_alignment_xml(g.sparkSession, path)


@query("S16_X11_config", "SELECT path, value FROM (VALUES ('a.x', '1'), ('a.y', '3'), ('b', '\"t\"')) t(path, value)")
def _(v):
    merged = T.merged_config({"a": {"x": 1, "y": 2}, "b": "s"}, {"a": {"y": 3}, "b": "t"})
    return T.flatten_config(v("region").sparkSession, merged)


@query("K9_X15_X16_X17_Q14_checkpoint", "SELECT src, tgt, score FROM preds", "score")
def _(v):
    p = v("preds").select("src", "tgt", "score")
    path = folder(p.sparkSession, "stage")
    K.write_stage(p, path, "scores", "v1")
    assert K.read_stage(p.sparkSession, path, "scores", "other") is None
    return K.read_stage(p.sparkSession, path, "scores", "v1").select("src", "tgt", "score")
