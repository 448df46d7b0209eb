"""Registered queries: every operator bound to the driver's tables, each with SQL for DuckDB where SQL can express it.

Views give the tables the roles of an alignment task: lineitem rows are scored candidate pairs of
orders and parts, returned ones are the reference, and keys, names and vectors play entities.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

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

#: Views in the SQL that both engines read. The first dedupes lineitem to one row for each pair.
VIEWS = {
    "pairs": """
SELECT l_orderkey AS src, l_partkey AS tgt, l_linenumber AS pos, l_linestatus AS status, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
       l_discount * 10e0 AS s_lex, l_tax * 12.5e0 AS s_hier, (l_quantity - 1e0) / 49e0 AS s_sim, ((l_orderkey * 7 + l_partkey * 13) % 101) / 100e0 AS s_diff,
       ((l_orderkey * 3 + l_partkey * 5) % 11) / 10e0 AS q_lex, ((l_orderkey + l_partkey * 7) % 11) / 10e0 AS q_hier,
       ((l_orderkey * 5 + l_partkey) % 6) / 5e0 AS q_sim, ((l_orderkey + l_partkey) % 4) / 3e0 AS q_diff, l_quantity / 50e0 AS score
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_suppkey) AS rn FROM {lineitem}) WHERE rn = 1""",
    "gold": "SELECT src, tgt FROM {pairs} WHERE label = 1",
    "train": "SELECT src, tgt FROM {pairs} WHERE label = 1 AND src % 2 = 0",
    "exact": "SELECT src, tgt FROM {pairs} WHERE label = 1 AND status = 'F' AND src % 3 = 0",
    "preds": "SELECT src, tgt, score, pos FROM {pairs} WHERE score >= 0.6e0",
    "ent": "SELECT p_partkey AS iri, p_name AS label, concat_ws(' ', p_name, p_type, p_brand) AS long_label FROM {part}",
    "edges": """
SELECT concat('c', c_custkey) AS src, 'located_in' AS rel, concat('n', c_nationkey) AS dst FROM {customer}
UNION ALL SELECT concat('s', s_suppkey), 'located_in', concat('n', s_nationkey) FROM {supplier}
UNION ALL SELECT concat('n', n_nationkey), 'part_of', concat('r', n_regionkey) FROM {nation}
UNION ALL SELECT concat('o', o_orderkey), 'placed_by', concat('c', o_custkey) FROM {orders}""",
    "annot": """
SELECT p_partkey AS iri, 'brand' AS prop, p_brand AS value FROM {part}
UNION ALL SELECT p_partkey, 'type', p_type FROM {part} UNION ALL SELECT p_partkey, 'name', p_name FROM {part}""",
    "npairs": "SELECT concat('n', n_nationkey) AS src, concat('r', n_regionkey) AS tgt FROM {nation}",
    "nitems": """
SELECT concat('n', c_nationkey) AS iri, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS pos, substr(c_mktsegment, 1, 1) AS rel, least(1e0, n / 40e0) AS ic, 1e0 / length(c_mktsegment) AS spec, length(c_mktsegment) / 12e0 AS weight, x, y, z
FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n, avg(c_acctbal) / 1e4 AS x, count(*) / 5e1 AS y, (max(c_acctbal) - min(c_acctbal)) / 1.2e4 - 0.5e0 AS z FROM {customer} GROUP BY c_nationkey, c_mktsegment)""",
    "ritems": """
SELECT concat('r', n_regionkey) AS iri, row_number() OVER (PARTITION BY n_regionkey ORDER BY c_mktsegment) AS pos, substr(c_mktsegment, 1, 1) AS rel, least(1e0, n / 200e0) AS ic, 1e0 / length(c_mktsegment) AS spec, length(c_mktsegment) / 12e0 AS weight, x, y, z
FROM (SELECT n_regionkey, c_mktsegment, count(*) AS n, avg(c_acctbal) / 9e3 AS x, count(*) / 25e1 AS y, (max(c_acctbal) - min(c_acctbal)) / 1.3e4 - 0.5e0 AS z FROM {customer} JOIN {nation} ON n_nationkey = c_nationkey GROUP BY n_regionkey, c_mktsegment)""",
    "vec": "SELECT vec_id AS iri, embedding AS vector, label FROM {embeddings}",
}
CHANNELS = ["hier", "sim", "diff"]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_DEPENDS = {"gold": ["pairs"], "train": ["pairs"], "exact": ["pairs"], "preds": ["pairs"]}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or a view over tables."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needs = {n: view(spark, sf_dir, n) for n in [*TABLES, *_DEPENDS.get(name, [])] if "{" + n + "}" in VIEWS[name]}
    return spark.sql(VIEWS[name], **needs)


def _ctes() -> str:
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({t.format(**{k: k for k in [*TABLES, *VIEWS]})})" for n, t in VIEWS.items())


HEAD = _ctes()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def rounded(df: DataFrame) -> DataFrame:
    """Doubles at six places, so that the order of a sum doesn't show."""
    return df.select([(F.round(c, 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(name: str, sql: str | None = None, doubles: str = ""):
    """Register a query; ``sql`` follows the views, ``doubles`` names its columns to round."""

    def add(f: Callable) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(lambda n: view(spark, sf_dir, n)))
        if sql:
            swap = ", ".join(f"round({d}, 6) + 0e0 AS {d}" for d in doubles.split())
            ORACLE[name] = HEAD + f"\nSELECT * {f'REPLACE ({swap})' if swap else ''} FROM ({sql})"
        return f

    return add


RANK = "row_number() OVER (PARTITION BY src ORDER BY score DESC, tgt)"


@query("A1_precision_recall", """
SELECT tp, n_pred, n_ref, tp / n_pred::DOUBLE AS precision, tp / n_ref::DOUBLE AS recall, 2e0 * tp / (n_pred + n_ref) AS f1 FROM (
  SELECT (SELECT count(*) FROM (SELECT src, tgt FROM preds INTERSECT SELECT src, tgt FROM gold EXCEPT SELECT src, tgt FROM train)) AS tp,
         (SELECT count(*) FROM (SELECT src, tgt FROM preds EXCEPT SELECT src, tgt FROM train)) AS n_pred,
         (SELECT count(*) FROM (SELECT src, tgt FROM gold EXCEPT SELECT src, tgt FROM train)) AS n_ref)""", "precision recall f1")
def _(v):
    return P.precision_recall(v("preds"), v("gold"), v("train"))


@query("A2_A3_ranking_metrics", f"""
SELECT count(*) AS n_refs, avg(CASE WHEN r <= 1 THEN 1e0 ELSE 0e0 END) AS hits_1, avg(CASE WHEN r <= 3 THEN 1e0 ELSE 0e0 END) AS hits_3, avg(coalesce(1e0 / r, 0e0)) AS mrr
FROM gold LEFT JOIN (SELECT src, tgt, {RANK} AS r FROM preds) USING (src, tgt)""", "hits_1 hits_3 mrr")
def _(v):
    return P.ranking_metrics(v("preds"), v("gold"), [1, 3])


@query("A5_A6_candidate_recall", f"""
WITH r AS (SELECT src, tgt FROM gold EXCEPT SELECT src, tgt FROM train), c AS (SELECT p.* FROM preds p ANTI JOIN train USING (src, tgt)),
k AS (SELECT src, tgt, {RANK} AS rk FROM c), j AS (SELECT r.src, r.tgt, rk, e.src IS NOT NULL AS e FROM r LEFT JOIN k USING (src, tgt) LEFT JOIN exact e ON e.src = r.src AND e.tgt = r.tgt)
SELECT count(*) AS n_refs, count(rk) AS hits, count(*) FILTER (rk IS NOT NULL OR e) AS oracle_hits, count(rk) / count(*)::DOUBLE AS recall,
       (count(*) FILTER (rk IS NOT NULL OR e)) / count(*)::DOUBLE AS oracle_recall, quantile_cont(rk::DOUBLE, 0.5) AS rank_median, quantile_cont(rk::DOUBLE, 0.9) AS rank_p90 FROM j""", "recall oracle_recall rank_median rank_p90")
def _(v):
    return P.candidate_recall(v("preds"), v("gold"), v("exact"), v("train"))


@query("A7_miss_buckets", """
WITH m AS (SELECT src, tgt FROM gold EXCEPT SELECT src, tgt FROM preds), c AS (SELECT src, tgt FROM pairs WHERE score >= 0.3e0)
SELECT CASE WHEN NOT EXISTS (FROM c WHERE c.src = m.src AND c.tgt = m.tgt) THEN 'absent' WHEN m.src % 5 = 0 AND EXISTS (FROM preds p WHERE p.src = m.src) THEN 'abstained'
            WHEN EXISTS (FROM preds p WHERE p.src = m.src) THEN 'wrong_selected' ELSE 'rejected' END AS bucket, count(*) AS n FROM m GROUP BY 1""")
def _(v):
    return P.miss_buckets(v("gold"), P.at_least(v("pairs"), 0.3), v("preds"), v("preds").where("src % 5 = 0"))


@query("A34_threshold_sweep", f"""
WITH k AS (SELECT *, {RANK} AS r FROM pairs), g AS (SELECT t::DOUBLE AS threshold, c AS card FROM (VALUES (0.3), (0.6), (0.9)) a(t), (VALUES (1), (2)) b(c))
SELECT threshold, card, sum(label)::BIGINT AS tp, count(*) AS n_pred, (SELECT count(*) FROM gold) AS n_ref, avg(label) AS precision, sum(label) / (SELECT count(*) FROM gold)::DOUBLE AS recall,
       2e0 * sum(label) / (count(*) + (SELECT count(*) FROM gold)) AS f1 FROM k, g WHERE score >= threshold AND r <= card GROUP BY ALL""", "precision recall f1")
def _(v):
    return P.threshold_sweep(v("pairs"), v("gold"), [0.3, 0.6, 0.9], [1, 2])


@query("A35_recall_at_k", f"""
SELECT k AS top_k, avg(CASE WHEN r <= k THEN 1e0 ELSE 0e0 END) AS recall FROM gold LEFT JOIN (SELECT src, tgt, {RANK} AS r FROM pairs) USING (src, tgt), (VALUES (1), (2), (5)) t(k) GROUP BY k""", "recall")
def _(v):
    return P.recall_at(v("pairs"), v("gold"), [1, 2, 5])


@query("T1_limit_by_source", f"SELECT src, tgt, score FROM (SELECT *, {RANK} AS r FROM pairs) WHERE r <= 2", "score")
def _(v):
    return R.limit_by_source(v("pairs"), 2).select("src", "tgt", "score")


@query("T2_T3_M18_final_alignment", """
WITH u AS (SELECT src, tgt, 1e0 AS score, src AS pos, 1 AS p FROM exact UNION ALL SELECT src, tgt, score, pos + 1099511627776, 0 FROM preds),
o AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY src, tgt ORDER BY pos) = 1),
s AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY src ORDER BY p DESC, score DESC, pos, tgt) <= 1)
SELECT src, tgt, score, p AS protected FROM s QUALIFY row_number() OVER (PARTITION BY tgt ORDER BY p DESC, score DESC, pos, src) <= 1""", "score")
def _(v):
    exact = v("exact").select("src", "tgt", F.lit(1.0).alias("score"), (F.col("src") * 1000000 + F.col("tgt")).alias("pos"))
    preds = v("preds").withColumn("pos", F.col("src") * 1000000 + F.col("pos") * 10000)
    return P.final_alignment(preds, exact, 1, 1).select("src", "tgt", "score", "protected")


ORACLE["T2_T3_M18_final_alignment"] = ORACLE["T2_T3_M18_final_alignment"].replace("src AS pos, 1 AS p", "src * 1000000 + tgt AS pos, 1 AS p").replace("pos + 1099511627776", "src * 1000000 + pos * 10000 + 1099511627776")


@query("J1_exact_matches", """
WITH s AS (SELECT iri, lower(label) AS l FROM ent WHERE iri % 2 = 0), t AS (SELECT iri, lower(label) AS l FROM ent WHERE iri % 2 = 1),
k AS (SELECT iri, 0 AS kind, regexp_replace(l, '[^a-z0-9]+', '', 'g') AS key, iri % 2 AS side FROM (FROM s UNION ALL FROM t)
      UNION ALL SELECT iri, 1, array_to_string(list_sort(list_distinct(string_split(trim(regexp_replace(l, '[^a-z0-9]+', ' ', 'g')), ' '))), ' '), iri % 2 FROM (FROM s UNION ALL FROM t))
SELECT a.iri AS src, b.iri AS tgt, 1e0 AS score, min(a.kind) = 1 AS near FROM k a JOIN k b ON a.kind = b.kind AND a.key = b.key AND a.side = 0 AND b.side = 1
WHERE a.kind = 0 OR contains(a.key, ' ') GROUP BY 1, 2""", "score")
def _(v):
    ent = v("ent").select("iri", "label")
    return R.exact_matches(ent.where("iri % 2 = 0"), ent.where("iri % 2 = 1"), ascii_only=True)


@query("J2_sparse_cosine", """
WITH s AS (SELECT iri AS rec, label AS norm FROM e2 WHERE iri % 2 = 0), t AS (SELECT iri AS rec, label AS norm FROM e2 WHERE iri % 2 = 1),
f AS (SELECT rec, 's' AS side, 'token' AS kind, unnest(list_distinct(string_split(norm, ' '))) AS feature FROM s UNION ALL SELECT rec, 't', 'token', unnest(list_distinct(string_split(norm, ' '))) FROM t
      UNION ALL SELECT rec, 's', 'gram', unnest(list_distinct(list_transform(range(1, length(norm) + 1), lambda i: substr(' ' || norm || ' ', i, 3)))) FROM s
      UNION ALL SELECT rec, 't', 'gram', unnest(list_distinct(list_transform(range(1, length(norm) + 1), lambda i: substr(' ' || norm || ' ', i, 3)))) FROM t),
n AS (SELECT count(*) AS n FROM t), d AS (SELECT kind, feature, count(*) AS df FROM f WHERE side = 't' GROUP BY ALL),
i AS (SELECT kind, feature, ln((1 + n) / (1 + df)::DOUBLE) + 1 AS idf FROM d, n WHERE df <= greatest(10, ceil(0.2 * n))),
w AS (SELECT f.*, idf FROM f JOIN i USING (kind, feature)), m AS (SELECT rec, side, kind, sqrt(sum(idf * idf)) AS norm FROM w GROUP BY ALL),
x AS (SELECT a.rec AS src, b.rec AS tgt, a.kind, sum(a.idf * b.idf) AS dot FROM w a JOIN w b ON a.kind = b.kind AND a.feature = b.feature AND a.side = 's' AND b.side = 't' GROUP BY ALL),
c AS (SELECT x.src, x.tgt, x.kind, least(1e0, dot / (p.norm * q.norm)) AS cos FROM x JOIN m p ON p.rec = x.src AND p.side = 's' AND p.kind = x.kind JOIN m q ON q.rec = x.tgt AND q.side = 't' AND q.kind = x.kind),
g AS (SELECT src, tgt, coalesce(max(cos) FILTER (kind = 'token'), 0) AS tok, coalesce(max(cos) FILTER (kind = 'gram'), 0) AS gram FROM c GROUP BY ALL)
SELECT src, tgt, score FROM (SELECT src, tgt, least(1e0, greatest(tok, 0.85e0 * gram, 0.65e0 * tok + 0.35e0 * gram)) AS score FROM g)
QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(score, 9) DESC, tgt) <= 5""".replace(" e2 ", " (SELECT iri, trim(regexp_replace(lower(long_label), '[^a-z0-9]+', ' ', 'g')) AS label FROM ent) "), "score")
def _(v):
    rec = v("ent").select(F.col("iri").alias("rec"), "iri", X.normalize(F.lower("long_label"), True).alias("normalized"))
    return R.sparse_topk(rec.where("iri % 2 = 0"), rec.where("iri % 2 = 1"), 5)


@query("J4_dense_topk", """
WITH a AS (SELECT iri, list_transform(vector, lambda x: x::DOUBLE) AS u FROM vec), p AS (SELECT s.iri AS src, t.iri AS tgt, list_inner_product(s.u, t.u) / sqrt(list_inner_product(s.u, s.u) * list_inner_product(t.u, t.u)) AS score
FROM a s JOIN a t ON s.iri % 2 = 0 AND t.iri % 2 = 1) SELECT src::VARCHAR AS src, tgt::VARCHAR AS tgt, score FROM p QUALIFY row_number() OVER (PARTITION BY src ORDER BY score DESC, tgt) <= 5""", "score")
def _(v):
    return R.dense_topk(v("vec").where("iri % 2 = 0"), v("vec").where("iri % 2 = 1"), 5)


@query("J5_union_channels", """
WITH a AS (SELECT src, tgt, s_sim AS sem FROM pairs WHERE s_sim > 0.5e0), b AS (SELECT src, tgt, s_lex AS lex FROM pairs WHERE s_lex > 0.5e0),
j AS (SELECT src, tgt, coalesce(sem, 0) AS sem, coalesce(lex, 0) AS lex FROM a FULL JOIN b USING (src, tgt))
SELECT src, tgt, sem, lex, greatest(sem, lex) AS score, concat_ws('|', CASE WHEN sem > 0 THEN 'semantic' END, CASE WHEN lex > 0 THEN 'lexical' END) AS channels,
       row_number() OVER (PARTITION BY src ORDER BY greatest(sem, lex) DESC, sem DESC, lex DESC, tgt)::INTEGER AS pos FROM j QUALIFY pos <= 3""", "sem lex score")
def _(v):
    p = v("pairs")
    return R.union_channels(p.where("s_sim > 0.5").select("src", "tgt", F.col("s_sim").alias("score")), p.where("s_lex > 0.5").select("src", "tgt", F.col("s_lex").alias("score")), 3)


@query("J6_label_join", "SELECT src, tgt, coalesce(g.l, 0) AS label FROM pairs LEFT JOIN (SELECT src, tgt, 1 AS l FROM gold) g USING (src, tgt)")
def _(v):
    return P.label(v("pairs").select("src", "tgt", F.lit(0).alias("label")), v("gold").withColumn("label", F.lit(1)))


@query("J7_J8_prefilter", "SELECT src, tgt, 'pair' AS by FROM pairs ANTI JOIN exact USING (src, tgt) UNION ALL SELECT src, tgt, 'source' FROM pairs ANTI JOIN exact USING (src)")
def _(v):
    p, e = v("pairs").select("src", "tgt"), v("exact")
    return P.prefilter(p, e, False).withColumn("by", F.lit("pair")).unionByName(P.prefilter(p, e, True).select("src", "tgt").withColumn("by", F.lit("source")))


@query("J10_fill_scores", "SELECT src, tgt, coalesce(p.score, 0) AS score FROM gold LEFT JOIN preds p USING (src, tgt)", "score")
def _(v):
    return P.fill_scores(v("gold"), v("preds"))


@query("U2_U3_coverage", "SELECT src, tgt FROM gold EXCEPT SELECT src, tgt FROM preds EXCEPT SELECT src, tgt FROM exact")
def _(v):
    return P.coverage(v("gold"), v("preds"), v("exact"))


@query("P2_ignored", "SELECT src, tgt FROM pairs WHERE src % 7 <> 0 AND tgt % 5 <> 0")
def _(v):
    p = v("pairs").select("src", "tgt")
    return P.without_ignored(p, p.where("src % 7 = 0").select(F.col("src").alias("iri")).distinct(), p.where("tgt % 5 = 0").select(F.col("tgt").alias("iri")).distinct()).select("src", "tgt")


@query("W1_share_stats", """
WITH c AS (SELECT src, tgt, score AS cand_sim, row_number() OVER (PARTITION BY src ORDER BY score DESC, tgt)::INTEGER AS pos FROM pairs),
p AS (SELECT *, avg(cand_sim) OVER w AS cand_sim_mean, cand_sim / sum(cand_sim) OVER w AS cand_sim_prob FROM c WINDOW w AS (PARTITION BY src)),
t AS (SELECT *, sum(CASE WHEN pos <= 2 THEN cand_sim_prob ELSE 0 END) OVER (PARTITION BY src) AS cand_share_top FROM p)
SELECT *, ln((cand_share_top + 1.1920928955078125e-07) / (least(1e0, greatest(0e0, 1 - cand_share_top)) + 1.1920928955078125e-07)) AS cand_share_log FROM t""", "cand_sim cand_sim_mean cand_sim_prob cand_share_top cand_share_log")
def _(v):
    c = P.ranks(v("pairs")).select("src", "tgt", F.col("score").alias("cand_sim"), F.col("rank").alias("pos"))
    return R.share_stats(c, 2)


_FUSED = """
f AS (SELECT *, q_hier * pow(abs(s_hier - 0.5e0), 2) AS g_hier, q_sim * pow(abs(s_sim - 0.5e0), 2) AS g_sim, q_diff * pow(abs(s_diff - 0.5e0), 2) AS g_diff FROM pairs),
h AS (SELECT *, g_hier + g_sim + g_diff AS total FROM f),
o AS (SELECT *, CASE WHEN total > 1e-8 THEN g_hier / total ELSE 0 END AS o_hier, CASE WHEN total > 1e-8 THEN g_sim / total ELSE 0 END AS o_sim, CASE WHEN total > 1e-8 THEN g_diff / total ELSE 0 END AS o_diff FROM h),
z AS (SELECT *, CASE WHEN total > 1e-8 THEN o_hier * s_hier + o_sim * s_sim + o_diff * s_diff ELSE 0.5e0 END AS S_struct, CASE WHEN total > 1e-8 THEN o_hier * q_hier + o_sim * q_sim + o_diff * q_diff ELSE 0 END AS Q_struct FROM o),
y AS (SELECT *, q_lex * pow(abs(s_lex - 0.5e0), 2) AS g_lex, Q_struct * pow(abs(S_struct - 0.5e0), 2) AS g_struct FROM z),
x AS (SELECT *, CASE WHEN g_lex > 1e-8 AND g_struct > 1e-8 THEN g_struct / (g_lex + g_struct) WHEN g_lex > 1e-8 THEN 0 WHEN g_struct > 1e-8 THEN 1 ELSE 0 END AS w_c FROM y),
w AS (SELECT *, CASE WHEN g_lex > 1e-8 OR g_struct > 1e-8 THEN (1 - w_c) * s_lex + w_c * S_struct ELSE 0.5e0 END AS S_base FROM x),
u AS (SELECT *, greatest(least(1e0, greatest(0e0, 2 * (0.5e0 - abs(S_base - 0.5e0)))), least(1e0, greatest(0e0, sqrt(greatest(0e0, q_lex * Q_struct)) * abs(s_lex - S_struct)))) AS U FROM w)"""


def fused(v) -> DataFrame:
    return C.fuse_outer(C.fuse_channels(v("pairs"), CHANNELS))


@query("C6_C9_C10_fusion", f"WITH {_FUSED} SELECT src, tgt, o_hier AS omega_hier, o_sim AS omega_sim, o_diff AS omega_diff, S_struct, Q_struct, w_c, S_base, U, least(1e0, 0.8e0 * U) AS w_i FROM u", "omega_hier omega_sim omega_diff S_struct Q_struct w_c S_base U w_i")
def _(v):
    return fused(v).select("src", "tgt", *[f"omega_{c}" for c in CHANNELS], "S_struct", "Q_struct", "w_c", "S_base", "U", "w_i")


@query("C11_C12_arbitration", f"""WITH {_FUSED}, d AS (SELECT src, tgt, score AS p FROM pairs WHERE tgt % 2 = 0), a AS (SELECT u.*, d.p, CASE WHEN U >= 0.5e0 AND d.p IS NOT NULL THEN least(1e0, 0.8e0 * U) ELSE 0 END AS I_llm FROM u LEFT JOIN d USING (src, tgt))
SELECT src, tgt, I_llm, (1 - I_llm) * (1 - w_c) AS I_label, (1 - I_llm) * w_c AS I_struct, (1 - I_llm) * S_base + I_llm * coalesce(p, 0) AS S_final, (1 - I_llm) * (1 - w_c) * (s_lex - 0.5e0) AS C_label, I_llm * (coalesce(p, 0) - S_base) AS C_llm FROM a""", "I_llm I_label I_struct S_final C_label C_llm")
def _(v):
    d = v("pairs").where("tgt % 2 = 0").select("src", "tgt", F.col("score").alias("p_yes"))
    return C.attribute(C.arbitrate(fused(v), d), CHANNELS).select("src", "tgt", "I_llm", "I_label", "I_struct", "S_final", "C_label", "C_llm")


@query("A27_identities", f"""WITH {_FUSED} SELECT max(abs(o_hier + o_sim + o_diff - CASE WHEN total > 1e-8 THEN 1 ELSE 0 END)) AS omega_error,
max(CASE WHEN g_lex > 1e-8 OR g_struct > 1e-8 THEN abs(S_base - (1 - w_c) * s_lex - w_c * S_struct) ELSE 0 END) AS mixture_error FROM u""", "omega_error mixture_error")
def _(v):
    return A.identities(fused(v), CHANNELS)


@query("A24_inertness", f"""WITH {_FUSED} SELECT channel, count(*) AS n, avg(CASE WHEN g < 1e-6 THEN 1e0 ELSE 0e0 END) AS inert, avg(CASE WHEN o < 0.01e0 THEN 1e0 ELSE 0e0 END) AS light
FROM (SELECT 'hier' AS channel, g_hier AS g, o_hier AS o FROM u UNION ALL SELECT 'sim', g_sim, o_sim FROM u UNION ALL SELECT 'diff', g_diff, o_diff FROM u) GROUP BY channel""", "inert light")
def _(v):
    return A.inertness(fused(v), CHANNELS)


@query("A25_activity", f"""WITH {_FUSED} SELECT channel, dump, count(*) AS n, count(*) FILTER (q > 0 AND g > 1e-8) AS active, avg(s) FILTER (q > 0 AND g > 1e-8) AS s_mean, min(s) FILTER (q > 0 AND g > 1e-8) AS s_min, max(s) FILTER (q > 0 AND g > 1e-8) AS s_max
FROM (SELECT 'hier' AS channel, CASE WHEN src % 2 = 0 THEN 'even' ELSE 'odd' END AS dump, q_hier AS q, s_hier AS s, g_hier AS g FROM u UNION ALL SELECT 'sim', CASE WHEN src % 2 = 0 THEN 'even' ELSE 'odd' END, q_sim, s_sim, g_sim FROM u
UNION ALL SELECT 'diff', CASE WHEN src % 2 = 0 THEN 'even' ELSE 'odd' END, q_diff, s_diff, g_diff FROM u) GROUP BY channel, dump""", "s_mean s_min s_max")
def _(v):
    f = fused(v)
    return A.activity({"even": f.where("src % 2 = 0"), "odd": f.where("src % 2 = 1")}, CHANNELS)


@query("W2_group_features", """
SELECT src, tgt, CASE WHEN stddev_pop(score) OVER w > 1e-12 THEN (score - avg(score) OVER w) / stddev_pop(score) OVER w ELSE 0 END AS z,
       coalesce(score - CASE WHEN r = 1 THEN (SELECT max(p2.score) FROM k p2 WHERE p2.src = k.src AND p2.r > 1) ELSE max(score) OVER w END, 0) AS gap, 1 - (r - 1) / greatest(1, count(*) OVER w - 1)::DOUBLE AS rank_score, r AS rank
FROM k WINDOW w AS (PARTITION BY src)""".replace("FROM k WINDOW", "FROM k WINDOW"), "z gap rank_score")
def _(v):
    return M.group_features(v("pairs").select("src", "tgt", "score"), "score").drop("score")


ORACLE["W2_group_features"] = ORACLE["W2_group_features"].replace(HEAD, HEAD + f",\nk AS MATERIALIZED (SELECT src, tgt, score, {RANK}::INTEGER AS r FROM pairs)")


@query("W4_W5_softmax_entropy", """
WITH e AS (SELECT src, exp((score - max(score) OVER (PARTITION BY src)) / 0.75e0) AS e FROM pairs), p AS (SELECT src, e / sum(e) OVER (PARTITION BY src) AS p FROM e)
SELECT src, CASE WHEN count(*) > 1 THEN least(1e0, greatest(0e0, -sum(p * ln(greatest(p, 1e-12))) / ln(greatest(count(*), 2)))) ELSE 0 END AS entropy, count(*) AS n FROM p GROUP BY src""", "entropy")
def _(v):
    return M.entropy(M.softmax(v("pairs"), "score", ["src"]))


@query("W6_reciprocity", """
WITH c AS (SELECT src, tgt, least(1 - 1e-6, greatest(1e-6, score)) AS p FROM pairs), o AS (SELECT src, tgt, ln(p / (1 - p)) AS o FROM c), e AS (SELECT src, tgt, exp((o - max(o) OVER (PARTITION BY tgt)) / 0.75e0) AS e FROM o)
SELECT src, tgt, 2 * e / sum(e) OVER (PARTITION BY tgt) - 1 AS reciprocity FROM e""", "reciprocity")
def _(v):
    return M.reciprocity(v("pairs"), "score").select("src", "tgt", "reciprocity")


@query("W7_M3_winners", f"""
SELECT src, tgt, margin, coalesce(margin < 0.08e0, false) OR abs(score - 0.7e0) < 0.08e0 AS ask FROM (SELECT *, {RANK} AS r, score - lead(score) OVER (PARTITION BY src ORDER BY score DESC, tgt) AS margin FROM pairs) WHERE r = 1""", "margin")
def _(v):
    return M.winners(v("pairs"), "score", 0.7).select("src", "tgt", "margin", "ask")


@query("W8_ranks", f"SELECT src, tgt, {RANK}::INTEGER AS rank FROM pairs")
def _(v):
    return P.ranks(v("pairs")).select("src", "tgt", "rank")


@query("A18_distinctive", """
WITH i AS (SELECT src, tgt, pos % 3 AS key, s_sim AS strength FROM pairs UNION ALL SELECT src, tgt, 10 + tgt % 5, s_lex FROM pairs), d AS (SELECT src, key, count(DISTINCT tgt) AS df FROM i GROUP BY ALL), n AS (SELECT src, count(DISTINCT tgt) AS n FROM i GROUP BY src),
r AS (SELECT src, tgt, sum(greatest(0e0, strength) * greatest(0e0, ln((n + 1) / (df + 1)::DOUBLE))) AS raw FROM i JOIN d USING (src, key) JOIN n USING (src) GROUP BY src, tgt)
SELECT src, tgt, CASE WHEN max(raw) OVER (PARTITION BY src) > 0 THEN raw / max(raw) OVER (PARTITION BY src) ELSE 0 END AS distinctive FROM r""", "distinctive")
def _(v):
    p = v("pairs")
    i = p.select("src", "tgt", (F.col("pos") % 3).cast("long").alias("key"), F.col("s_sim").alias("strength")).union(p.select("src", "tgt", 10 + F.col("tgt") % 5, "s_lex"))
    return M.distinctive(i)


@query("M7_threshold_tuning", """
WITH d AS (SELECT src, score AS p, label, src % 3 <> 0 OR label = 1 AS has_ref FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, tgt) AS r FROM pairs) WHERE r = 1), t AS (SELECT i / 20e0 AS threshold FROM range(1, 20) x(i)),
m AS (SELECT threshold, count(*) FILTER (p >= threshold AND label = 1) AS tp, count(*) FILTER (p >= threshold AND label = 0) AS fp, count(*) FILTER (has_ref AND NOT (p >= threshold AND label = 1)) AS fn FROM d, t GROUP BY threshold)
SELECT threshold, tp, fp, fn, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall FROM m""", "threshold precision recall")
def _(v):
    d = M.winners(v("pairs"), "score", 0.7).select(F.col("score").alias("p_match"), "label", ((F.col("src") % 3 != 0) | (F.col("label") == 1)).alias("has_ref"))
    return M.threshold_metrics(d, [i / 20 for i in range(1, 20)]).drop("f1")


@query("M8_target_conflicts", """
WITH w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, tgt) AS r FROM pairs) WHERE r = 1)
SELECT src, tgt, score AS p_match FROM w QUALIFY row_number() OVER (PARTITION BY tgt ORDER BY (status = 'F') DESC, score DESC, src) = 1""", "p_match")
def _(v):
    d = M.winners(v("pairs"), "score", 0.7).withColumn("p_match", F.col("score")).withColumn("protected", F.col("status") == "F")
    return M.resolve_targets(d).select("src", "tgt", "p_match")


@query("M13_evidence_support", f"""WITH {_FUSED}, k AS (SELECT u.*, 1 - (row_number() OVER (PARTITION BY src ORDER BY score DESC, tgt) - 1) / greatest(1, count(*) OVER (PARTITION BY src) - 1)::DOUBLE AS rs FROM u),
r AS (SELECT *, (S_base + s_lex + S_struct + rs) / 4 AS raw FROM k) SELECT src, tgt, least(1e0, greatest(0e0, CASE WHEN s_diff < 0.5e0 THEN raw * s_diff / 0.5e0 ELSE raw END)) AS support FROM r""", "support")
def _(v):
    f = M.group_features(fused(v), "score").withColumn("pair_score", F.col("S_base")).withColumn("s_label", F.col("s_lex"))
    return M.evidence_support(f).select("src", "tgt", "support")


@query("M17_effective_threshold", "SELECT median(score) AS threshold FROM pairs WHERE score > 0", "threshold")
def _(v):
    return M.effective_threshold(v("pairs"), "score")


@query("M19_annotation", "SELECT src, tgt, (src, tgt) IN (SELECT (src, tgt) FROM exact) AS saved_alignment_member, score >= 0.7e0 AS threshold_positive, CASE WHEN (src, tgt) IN (SELECT (src, tgt) FROM exact) THEN 'Match' ELSE 'No match' END AS decision_label FROM pairs")
def _(v):
    return M.annotate(v("pairs"), v("exact"), 0.7, False).select("src", "tgt", "saved_alignment_member", "threshold_positive", "decision_label")


@query("M5_rank_model")
def _(v):
    p = M.group_features(v("pairs"), "score")
    w, m, s = M.fit_rank_model(p.where("src % 2 = 0"), ["z", "gap", "s_lex"])
    return M.linear_score(p, ["z", "gap", "s_lex"], w, m, s).select("src", "tgt", "rank_utility")


@query("M6_accept_model")
def _(v):
    d = M.winners(v("pairs"), "score", 0.7).na.fill(0.0, ["margin"]).withColumn("sample_weight", F.lit(1.0))
    w, m, s, b = M.fit_accept_model(d.where("src % 2 = 0"), ["score", "margin"])
    return M.linear_score(d, ["score", "margin"], w, m, s, b, "logit").select("src", "tgt", S.sigmoid(F.col("logit")).alias("p_match"))


@query("A10_run_stats", "SELECT metric, count(v) AS n, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS min, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75, max(v) AS max FROM (SELECT 's_lex' AS metric, s_lex AS v FROM pairs UNION ALL SELECT 's_diff', s_diff FROM pairs) GROUP BY metric", "mean std min p25 p50 p75 max")
def _(v):
    return A.run_stats(v("pairs"), ["s_lex", "s_diff"])


@query("A19_reliability", """
WITH e AS (SELECT list_sort(list_distinct(quantile_cont(q_lex, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS edges FROM pairs),
b AS (SELECT greatest(1, len(list_filter(edges, lambda x: x < q_lex)))::INTEGER AS bin, q_lex AS q, CASE WHEN (s_lex > 0.5e0) = (label = 1) THEN 1e0 ELSE 0e0 END AS ok FROM pairs, e),
g AS (SELECT bin, count(*) AS n, avg(q) AS q_mean, avg(ok) AS acc FROM b GROUP BY bin), z AS (SELECT *, 1.959963984540054e0 AS z FROM g)
SELECT bin, n, q_mean, acc, (acc + z * z / (2 * n) - z * sqrt(acc * (1 - acc) / n + z * z / (4e0 * n * n))) / (1 + z * z / n) AS low, (acc + z * z / (2 * n) + z * sqrt(acc * (1 - acc) / n + z * z / (4e0 * n * n))) / (1 + z * z / n) AS high FROM z""", "q_mean acc low high")
def _(v):
    return A.reliability(v("pairs").select(F.col("s_lex").alias("s"), F.col("q_lex").alias("q"), "label"))


@query("A20_calibration", """
WITH e AS (SELECT list_sort(list_distinct(quantile_cont(q_lex, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS edges FROM pairs),
b AS (SELECT greatest(1, len(list_filter(edges, lambda x: x < q_lex)))::INTEGER AS bin, q_lex AS q, s_lex AS s, label FROM pairs, e)
SELECT bin, count(*) AS n, avg(q) AS q_mean, avg(label) AS positive, avg(s) AS s_mean, avg((s - label) * (s - label)) AS brier, avg(abs(s - label)) AS mae FROM b GROUP BY bin""", "q_mean positive s_mean brier mae")
def _(v):
    return A.calibration(v("pairs").select(F.col("s_lex").alias("s"), F.col("q_lex").alias("q"), "label"))


@query("A21_source_auc", """
WITH r AS (SELECT src, label, q_lex AS q, rank() OVER (PARTITION BY src ORDER BY s_lex) + (count(*) OVER (PARTITION BY src, s_lex) - 1) / 2e0 AS rk, rank() OVER (PARTITION BY src ORDER BY s_lex DESC) AS g FROM pairs),
a AS (SELECT src, sum(label)::BIGINT AS n_pos, sum(1 - label)::BIGINT AS n_neg, avg(q) AS q_mean, (min(g) FILTER (label = 1))::INTEGER AS gold_rank, sum(CASE WHEN label = 1 THEN rk ELSE 0 END) AS rs FROM r GROUP BY src)
SELECT src, n_pos, n_neg, q_mean, gold_rank, CASE WHEN n_pos = 0 THEN 'no_positive' WHEN n_neg = 0 THEN 'no_negative' ELSE 'ok' END AS status, CASE WHEN n_pos > 0 AND n_neg > 0 THEN (rs - n_pos * (n_pos + 1) / 2e0) / (n_pos * n_neg) END AS auc FROM a""", "q_mean auc")
def _(v):
    return A.source_auc(v("pairs").select("src", F.col("s_lex").alias("s"), F.col("q_lex").alias("q"), "label"))


@query("A22_pick_rate", """
WITH m AS (SELECT *, s_lex = max(s_lex) OVER (PARTITION BY src) AS top FROM pairs) SELECT src, count(*) FILTER (top) AS tie_size, avg(q_lex) AS q_mean, CASE WHEN count(*) FILTER (top) = 1 THEN max(label) FILTER (top) ELSE 0 END AS picked_correct FROM m GROUP BY src""", "q_mean")
def _(v):
    return A.pick_rate(v("pairs").select("src", F.col("s_lex").alias("s"), F.col("q_lex").alias("q"), "label"))


@query("A26_pivot_table", """
WITH c AS (SELECT floor(q_hier * 5)::INTEGER AS r, floor(s_diff * 4)::INTEGER AS c, count(*) AS n FROM pairs GROUP BY CUBE (1, 2)), rr AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6, NULL])::INTEGER AS r), cc AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6, NULL])::INTEGER AS c)
SELECT rr.r, cc.c, coalesce(c.n, 0) AS n FROM rr CROSS JOIN cc LEFT JOIN c ON c.r IS NOT DISTINCT FROM rr.r AND c.c IS NOT DISTINCT FROM cc.c""")
def _(v):
    p = v("pairs").select(F.floor(F.col("q_hier") * 5).cast("int").alias("a"), F.floor(F.col("s_diff") * 4).cast("int").alias("b"))
    return A.pivot_table(p, "a", "b", 7, 7)


@query("A28_histogram_overlap", """
WITH l AS (SELECT min(s_diff) AS lo, max(s_diff) AS hi FROM pairs), c AS (SELECT least(49, floor((s_diff - lo) * 50 / (hi - lo))) AS b, count(*) FILTER (label = 1) AS x, count(*) FILTER (label = 0) AS y FROM pairs, l GROUP BY 1)
SELECT sum(least(x / (SELECT sum(x) FROM c)::DOUBLE, y / (SELECT sum(y) FROM c)::DOUBLE)) AS overlap FROM c""", "overlap")
def _(v):
    return A.histogram_overlap(v("pairs"), "s_diff", "label")


@query("A29_spearman", """
WITH r AS (SELECT rank() OVER (ORDER BY s_sim) + (count(*) OVER (PARTITION BY s_sim) - 1) / 2e0 AS a, rank() OVER (ORDER BY s_diff) + (count(*) OVER (PARTITION BY s_diff) - 1) / 2e0 AS b FROM pairs) SELECT count(*) AS n, corr(a, b) AS rho FROM r""", "rho")
def _(v):
    return A.spearman(v("pairs"), "s_sim", "s_diff")


@query("A30_bootstrap")
def _(v):
    c = A.calibration(v("pairs").select(F.col("s_lex").alias("s"), F.col("q_lex").alias("q"), "label")).withColumn("channel", F.lit("lex"))
    return A.bootstrap_spearman(c, ["channel"], "bin", "brier")


@query("A31_ecdf", "SELECT DISTINCT s_sim, count(*) OVER (ORDER BY s_sim) / (SELECT count(*) FROM pairs)::DOUBLE AS ecdf FROM pairs", "s_sim ecdf")
def _(v):
    return A.ecdf(v("pairs"), "s_sim")


@query("A33_Q12_restricted_recall", """
WITH r AS (SELECT g.src, g.tgt, g.src % 4 = 0 AS a, p.src IS NOT NULL AS p FROM gold g LEFT JOIN preds p USING (src, tgt)) SELECT count(*) FILTER (NOT a AND p) / count(*) FILTER (NOT a)::DOUBLE AS recall_committed, count(DISTINCT CASE WHEN a THEN src END) / count(DISTINCT src)::DOUBLE AS abstention_rate FROM r""", "recall_committed abstention_rate")
def _(v):
    return A.restricted_recall(v("gold"), v("preds"), v("gold").where("src % 4 = 0"))


@query("A38_failure_taxonomy", """
WITH k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, tgt) AS r, lead(score) OVER (PARTITION BY src ORDER BY score DESC, tgt) AS nx FROM pairs),
s AS (SELECT src, coalesce(min(r) FILTER (label = 1), -1) AS gold_rank, max(score - nx) FILTER (r = 1) AS ld, count(*) AS evidence, max(label) FILTER (r = 1) = 1 AS ok FROM k GROUP BY src), m AS (SELECT median(evidence) AS m FROM s)
SELECT src, CASE WHEN ok THEN 'correct' WHEN gold_rank < 0 THEN 'gold_absent' WHEN gold_rank > 3 THEN 'gold_below_top_k' WHEN src % 10 = 0 THEN 'llm_overturned' WHEN ld < 0.02e0 THEN 'near_tie' WHEN evidence < m THEN 'thin_evidence' ELSE 'misranked' END AS category FROM s, m""")
def _(v):
    k = U.leads(P.ranks(v("pairs")))
    s = k.groupBy("src").agg(F.coalesce(F.min(F.when(F.col("label") == 1, F.col("rank"))), F.lit(-1)).alias("gold_rank"), F.max(F.when(F.col("rank") == 1, F.col("lead"))).alias("lead"), F.count(F.lit(1)).alias("evidence"), (F.max(F.when(F.col("rank") == 1, F.col("label"))) == 1).alias("top1_correct"))
    return A.failure_taxonomy(s.withColumn("llm_used", F.col("src") % 10 == 0), 3).select("src", "category")


@query("J17_range_bins", "SELECT src, tgt, CASE WHEN s_sim < 0.25e0 THEN 0 WHEN s_sim < 0.5e0 THEN 1 ELSE 2 END AS bin FROM pairs")
def _(v):
    return A.bin_codes(v("pairs"), "s_sim", [(0.0, 0.25), (0.25, 0.5), (0.5, 1.0)]).select("src", "tgt", "bin")


@query("J18_confounders", """
WITH t AS (SELECT p.src, p.tgt, p.label, list_distinct(list_filter(string_split(trim(regexp_replace(lower(e.long_label), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: length(w) > 1)) AS t FROM pairs p JOIN ent e ON e.iri = p.tgt),
g AS (SELECT src, flatten(list(t)) AS g FROM t WHERE label = 1 GROUP BY src) SELECT t.src, t.tgt FROM t JOIN g USING (src) WHERE label = 0 AND list_has_any(t, g)""")
def _(v):
    named = v("pairs").join(v("ent").select(F.col("iri").alias("tgt"), "long_label"), "tgt")
    return A.confounders(named, X.content_tokens(F.col("long_label"), ["the", "of"])).select("src", "tgt")


@query("Q_ledger", f"""WITH {_FUSED}, g AS (SELECT (SELECT count(*) FROM gold)::DOUBLE AS observed, (SELECT sum(label) FROM pairs)::DOUBLE AS expected), e AS (SELECT round(max(abs(o_hier + o_sim + o_diff - CASE WHEN total > 1e-8 THEN 1 ELSE 0 END)), 6) AS observed FROM u)
SELECT 'pairs' AS area, 'gold within pairs' AS "check", observed = expected AS passed, observed, expected FROM g
UNION ALL SELECT 'fusion', 'weights sum to one or zero', observed = 0, observed, 0e0 FROM e""", "observed expected")
def _(v):
    f = A.identities(fused(v), CHANNELS)
    return A.ledger(A.assertion(v("pairs").join(v("gold").withColumn("g", F.lit(1)), ["src", "tgt"], "left"), "pairs", "gold within pairs", F.count_if(F.col("g") == 1), F.sum("label")), A.assertion(f, "fusion", "weights sum to one or zero", F.max(F.round("omega_error", 6)), F.lit(0.0)))


@query("Q3_dump_profile", f"""WITH {_FUSED} SELECT count(*) AS rows, 0::BIGINT AS blank_ids, count(DISTINCT src) AS sources, count(DISTINCT CASE WHEN label = 1 THEN src END) AS sources_correct,
count(*) FILTER (g_hier > 1e-6) AS active_hier, count(*) FILTER (g_sim > 1e-6) AS active_sim, count(*) FILTER (g_diff > 1e-6) AS active_diff FROM u""")
def _(v):
    return A.dump_profile(fused(v), CHANNELS)


@query("Q10_constant_columns", "SELECT 'label' AS \"column\", count(DISTINCT label) <= 1 AS constant FROM pairs UNION ALL SELECT 's_lex', count(DISTINCT s_lex) <= 1 FROM pairs")
def _(v):
    return A.constant_columns(v("pairs").select(F.col("label").cast("double").alias("label"), "s_lex"), ["label", "s_lex"])


@query("A11_node_ic", """
WITH d AS (SELECT rel, node, count(*) AS deg FROM (SELECT rel, src AS node FROM edges UNION ALL SELECT rel, dst FROM edges) GROUP BY ALL), m AS (SELECT rel, count(*) AS m FROM edges GROUP BY rel) SELECT rel, node, -ln(deg / m::DOUBLE) AS ic FROM d JOIN m USING (rel)""", "ic")
def _(v):
    return G.node_ic(v("edges"))


@query("A12_edge_ic", """
WITH d AS (SELECT rel, node, count(*) AS deg FROM (SELECT rel, src AS node FROM edges UNION ALL SELECT rel, dst FROM edges) GROUP BY ALL), m AS (SELECT rel, count(*) AS m FROM edges GROUP BY rel), i AS (SELECT rel, node, -ln(deg / m::DOUBLE) AS ic FROM d JOIN m USING (rel)),
e AS (SELECT src, e.rel, dst, (a.ic + b.ic) / 2 AS ic FROM edges e JOIN i a ON a.rel = e.rel AND a.node = src JOIN i b ON b.rel = e.rel AND b.node = dst) SELECT *, least(1e0, greatest(0e0, ic / (SELECT max(ic) FROM e))) AS ic_norm FROM e""", "ic ic_norm")
def _(v):
    return G.edge_ic(v("edges"))


@query("G1_adjacency", "SELECT node, list_sort(list_distinct(list(o))) AS neighbours FROM (SELECT src AS node, dst AS o FROM edges UNION ALL SELECT dst, src FROM edges) GROUP BY node")
def _(v):
    return G.adjacency(v("edges"))


@query("G2_neighbourhood", """
WITH b AS (SELECT src AS x, dst AS y FROM edges UNION SELECT dst, src FROM edges), s AS (SELECT concat('o', o_orderkey) AS n FROM orders WHERE o_orderkey % 50 = 0), r1 AS (SELECT n AS start, n AS node FROM s UNION SELECT n, y FROM s JOIN b ON x = n),
r2 AS (SELECT * FROM r1 UNION SELECT start, y FROM r1 JOIN b ON x = node) SELECT DISTINCT p.start, e.src, e.rel, e.dst FROM edges e JOIN r2 p ON p.node = e.src JOIN r2 q ON q.node = e.dst AND q.start = p.start""")
def _(v):
    starts = v("orders").where("o_orderkey % 50 = 0").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node"))
    return G.neighbourhood(v("edges"), starts, 2)


@query("G2_neighbourhood_all", """
WITH b AS (SELECT src AS x, dst AS y FROM edges UNION SELECT dst, src FROM edges), s AS (SELECT concat('o', o_orderkey) AS n FROM orders), r1 AS (SELECT n AS start, n AS node FROM s UNION SELECT n, y FROM s JOIN b ON x = n),
r2 AS (SELECT * FROM r1 UNION SELECT start, y FROM r1 JOIN b ON x = node) SELECT DISTINCT p.start, e.src, e.rel, e.dst FROM edges e JOIN r2 p ON p.node = e.src JOIN r2 q ON q.node = e.dst AND q.start = p.start""")
def _(v):
    return G.neighbourhood(v("edges"), v("orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node")), 2)


@query("G12_closure", """
WITH RECURSIVE h AS (SELECT * FROM edges WHERE rel IN ('located_in', 'part_of')), c AS (SELECT src AS sub, dst AS sup, 1 AS depth FROM h UNION SELECT c.sub, h.dst, c.depth + 1 FROM c JOIN h ON h.src = c.sup WHERE c.depth < 5) SELECT sub, sup, min(depth)::INTEGER AS depth FROM c GROUP BY ALL""")
def _(v):
    return G.closure(v("edges").where("rel IN ('located_in', 'part_of')"))


@query("G14_hierarchy_bundle", """
WITH h AS (SELECT DISTINCT src, dst FROM edges WHERE rel IN ('located_in', 'part_of')), e AS (SELECT src AS iri, dst AS sup, 1 AS d FROM h UNION ALL SELECT DISTINCT a.src, b.dst, 2 FROM h a JOIN h b ON a.dst = b.src WHERE NOT EXISTS (FROM h x WHERE x.src = a.src AND x.dst = b.dst))
SELECT iri, sup, 1e0 / d AS specificity, row_number() OVER (PARTITION BY iri ORDER BY d, sup)::INTEGER AS rank FROM e QUALIFY rank <= 6""", "specificity")
def _(v):
    return G.hierarchy_bundle(v("edges").where("rel IN ('located_in', 'part_of')"))


@query("G16_annotation_bundle", """
SELECT iri, prop, value, least(1e0, greatest(0.1e0, len(string_split(value, ' ')) / 12e0)) AS weight, row_number() OVER (PARTITION BY iri ORDER BY least(1e0, greatest(0.1e0, len(string_split(value, ' ')) / 12e0)) DESC, prop, value)::INTEGER AS rank FROM (SELECT DISTINCT * FROM annot) QUALIFY rank <= 12""", "weight")
def _(v):
    return G.annotation_bundle(v("annot"))


@query("G10_examples", "SELECT *, row_number() OVER (PARTITION BY rel ORDER BY src, dst)::INTEGER AS rank FROM edges QUALIFY rank <= 3")
def _(v):
    return G.examples(v("edges"))


@query("G4_greedy_context")
def _(v):
    starts = v("customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))
    ic = G.edge_ic(v("edges"))
    return G.greedy_context(G.neighbourhood(v("edges"), starts, 1).join(ic, ["src", "rel", "dst"]).withColumn("cost", F.lit(3)), 12)


@query("S6_K2_ranking_round_trip", f"SELECT src, tgt::VARCHAR AS tgt, score, row_number() OVER (PARTITION BY src ORDER BY score DESC, tgt::VARCHAR)::INTEGER AS rank FROM pairs WHERE src % 10 = 0", "score")
def _(v):
    raw = K.local_ranking(v("pairs").where("src % 10 = 0").withColumn("gold", F.col("src").cast("string")))
    return T.ranking_rows(raw.withColumn("c", T.parse_candidates("cands"))).select("src", "tgt", "score", "rank")


@query("S6_K2_ranking_round_trip_all", "SELECT src, tgt::VARCHAR AS tgt, score, row_number() OVER (PARTITION BY src ORDER BY score DESC, tgt::VARCHAR)::INTEGER AS rank FROM pairs", "score")
def _(v):
    raw = K.local_ranking(v("pairs").withColumn("gold", F.col("src").cast("string")))
    return T.ranking_rows(raw.withColumn("c", T.parse_candidates("cands"))).select("src", "tgt", "score", "rank")


@query("S22_first_flags", "SELECT src, arg_min(status, pos * 1000000 + tgt) AS flag, count(DISTINCT status) > 1 AS conflict FROM pairs GROUP BY src")
def _(v):
    return P.first_flags(v("pairs").withColumn("pos", F.col("pos") * 1000000 + F.col("tgt")), F.col("status"))


@query("F20_json_fields", """SELECT event_id, json_extract_string(props, '$.k') IS NOT NULL AS has_k FROM events""")
def _(v):
    return v("events").select("event_id", F.get_json_object(X.first_json(F.col("props")), "$.k").isNotNull().alias("has_k"))


@query("F4_iri_names", "SELECT page_id, regexp_extract(regexp_extract(trim(url), '([^#]*)$', 1), '([^/]*)$', 1) AS name FROM pages")
def _(v):
    return v("pages").select("page_id", X.local_name(F.col("url")).alias("name"))


@query("F13_graph_ids", "SELECT p_partkey, concat('part:', substr(sha1(p_name), 1, 16)) AS id FROM part")
def _(v):
    return v("part").select("p_partkey", X.graph_id("part", F.col("p_name")).alias("id"))


@query("K16_histogram", "SELECT least(11, floor(s_lex / 0.1e0) + 1)::BIGINT AS bin, count(*) AS n FROM (SELECT (s_diff * 100)::INTEGER / 100e0 AS s_lex FROM pairs WHERE (s_diff * 100)::INTEGER % 10 = 5) GROUP BY 1")
def _(v):
    return K.histogram(v("pairs").where("cast(round(s_diff * 100) as int) % 10 = 5"), "s_diff", 0.0, 1.0, 10)


@query("K16_histogram_all", "SELECT least(10, (s_diff * 100)::INTEGER // 10 + 1)::BIGINT AS bin, count(*) AS n FROM pairs WHERE s_diff IS NOT NULL GROUP BY 1")
def _(v):
    return K.histogram(v("pairs"), "s_diff", 0.0, 1.0, 10)


@query("T6_W9_shortlist", """
WITH k AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, tgt) AS r FROM pairs), g AS (SELECT src, min(r)::INTEGER AS gold_rank, max(score) AS top FROM k GROUP BY src HAVING min(r) FILTER (label = 1) = min(r)),
p AS (SELECT src, (min(r) FILTER (label = 1))::INTEGER AS gold_rank, max(score) AS top FROM k GROUP BY src), o AS (SELECT *, row_number() OVER (PARTITION BY gold_rank ORDER BY top DESC, src)::INTEGER AS panel_rank FROM p WHERE gold_rank BETWEEN 1 AND 3)
SELECT src, gold_rank, panel_rank, panel_rank <= 4 AS recommended FROM o WHERE panel_rank <= 8""")
def _(v):
    p = P.ranks(v("pairs")).groupBy("src").agg(F.min(F.when(F.col("label") == 1, F.col("rank"))).alias("gold_rank"), F.max("score").alias("top")).withColumn("complete", F.lit(True))
    return U.shortlist(U.panel_order(U.eligible(p, 3), [F.desc("top")]), 4, 8).select("src", "gold_rank", "panel_rank", "recommended")


@query("W10_leads", "SELECT src, tgt, lead, CASE WHEN lead IS NULL THEN 'last' WHEN lead >= 0.1e0 THEN 'clear' WHEN lead >= 0.02e0 THEN 'slight' ELSE 'close' END AS lead_class FROM (SELECT src, tgt, score - lead(score) OVER (PARTITION BY src ORDER BY score DESC, tgt) AS lead FROM pairs)", "lead")
def _(v):
    return U.leads(P.ranks(v("pairs"))).select("src", "tgt", "lead", "lead_class")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical retrieval of benchmark items among documents, best five each."""
    items, docs = view(spark, sf_dir, "benchmark"), view(spark, sf_dir, "documents")
    cut = lambda df, key: df.select(F.col(key).alias("rec"), F.col(key).alias("iri"), X.normalize(F.col("text")).alias("normalized"))
    return R.sparse_cosine(cut(items, "item_id"), cut(docs, "doc_id"), 5)
