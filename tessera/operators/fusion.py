"""Confidence-weighted fusion of evidence channels, and the evidence channels themselves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.scalars import clip01

TAU, GAMMA, BETA, EPS = 0.5, 2.0, 0.8, 1e-8


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def fuse_channels(pairs: DataFrame, channels: list[str], tau: float = TAU, gamma: float = GAMMA, muted: list[str] | None = None, uniform: bool = False) -> DataFrame:
    """From s_* and q_* of each channel the weights sigma_* and omega_*, and S_struct and Q_struct.

    Missing evidence is score ``tau`` with quality 0. ``muted`` channels weigh nothing; ``uniform``
    weighs those that are left equally.
    """
    muted = muted or []
    out = pairs.na.fill(tau, [f"s_{c}" for c in channels]).na.fill(0.0, [f"q_{c}" for c in channels])
    for c in channels:
        raw = F.col(f"q_{c}") * F.pow(F.abs(F.col(f"s_{c}") - tau), F.lit(gamma))
        out = out.withColumn(f"sigma_{c}", F.lit(0.0) if c in muted else raw)
    total = _sum([F.col(f"sigma_{c}") for c in channels])
    out = out.withColumn("sigma_sum", total)
    live = max(1, len(channels) - len(muted))
    for c in channels:
        weight = F.lit(0.0 if c in muted else 1.0 / live) if uniform else F.when(F.col("sigma_sum") > EPS, F.col(f"sigma_{c}") / F.col("sigma_sum")).otherwise(0.0)
        out = out.withColumn(f"omega_{c}", weight)
    any_ = F.lit(live > 0) if uniform else F.col("sigma_sum") > EPS
    out = out.withColumn("S_struct", F.when(any_, _sum([F.col(f"omega_{c}") * F.col(f"s_{c}") for c in channels])).otherwise(tau))
    return out.withColumn("Q_struct", F.when(any_, _sum([F.col(f"omega_{c}") * F.col(f"q_{c}") for c in channels])).otherwise(0.0))


def family_summary(pairs: DataFrame, families: list[str], tau: float = TAU, gamma: float = GAMMA) -> DataFrame:
    """One hierarchy score of several families, by weights before any are muted, and the mean quality of those that have any."""
    sigma = [F.col(f"q_{c}") * F.pow(F.abs(F.col(f"s_{c}") - tau), F.lit(gamma)) for c in families]
    score = F.coalesce(F.try_divide(_sum([w * F.col(f"s_{c}") for w, c in zip(sigma, families, strict=True)]), _sum(sigma)), F.lit(tau))
    have = _sum([(F.col(f"q_{c}") > 0).cast("double") for c in families])
    quality = F.coalesce(F.try_divide(_sum([F.when(F.col(f"q_{c}") > 0, F.col(f"q_{c}")).otherwise(0.0) for c in families]), have), F.lit(0.0))
    return pairs.withColumn("s_hier", score).withColumn("q_hier", quality)


def fuse_outer(pairs: DataFrame, tau: float = TAU, gamma: float = GAMMA, beta: float = BETA, tau_llm: float = 0.5, uniform: bool = False) -> DataFrame:
    """Label evidence with structure: w_c, S_base, ambiguity U, weight w_i of arbitration and whether it is asked."""
    s, q, S, Q = (F.col(c) for c in ("s_lex", "q_lex", "S_struct", "Q_struct"))
    out = pairs.withColumn("sigma_lex", q * F.pow(F.abs(s - tau), F.lit(gamma))).withColumn("sigma_struct", Q * F.pow(F.abs(S - tau), F.lit(gamma)))
    lex, struct = F.col("sigma_lex") > EPS, F.col("sigma_struct") > EPS
    w = F.lit(0.5) if uniform else F.when(lex & struct, F.col("sigma_struct") / (F.col("sigma_lex") + F.col("sigma_struct"))).when(lex, 0.0).when(struct, 1.0).otherwise(0.0)
    out = out.withColumn("w_c", w)
    base = (1 - F.col("w_c")) * s + F.col("w_c") * S
    out = out.withColumn("S_base", base if uniform else F.when(lex | struct, base).otherwise(tau))
    U = F.greatest(clip01(2 * (tau - F.abs(F.col("S_base") - tau))), clip01(F.sqrt(F.greatest(F.lit(0.0), q * Q)) * F.abs(s - S)))
    return out.withColumn("U", U).withColumn("w_i", clip01(beta * F.col("U"))).withColumn("llm_gated", F.col("U") >= tau_llm)


def arbitrate(pairs: DataFrame, decisions: DataFrame) -> DataFrame:
    """C11: blend in the probability of yes for gated rows that ``decisions`` (src, tgt, p_yes) has."""
    out = pairs.join(decisions.select("src", "tgt", F.col("p_yes").alias("p_llm")), ["src", "tgt"], "left")
    used = F.col("llm_gated") & F.col("p_llm").isNotNull()
    return out.withColumn("llm_invoked", used).withColumn("I_llm", F.when(used, F.col("w_i")).otherwise(0.0)).withColumn("S_final", F.when(used, (1 - F.col("w_i")) * F.col("S_base") + F.col("w_i") * F.col("p_llm")).otherwise(F.col("S_base")))


def attribute(pairs: DataFrame, channels: list[str], tau: float = TAU) -> DataFrame:
    """Importances (they sum to 1) and contributions of label, structure, its channels and arbitration."""
    rest = 1 - F.col("I_llm")
    out = pairs.withColumn("I_label", rest * (1 - F.col("w_c"))).withColumn("I_struct", rest * F.col("w_c")).withColumn("C_label", F.col("I_label") * (F.col("s_lex") - tau))
    for c in channels:
        out = out.withColumn(f"I_{c}", F.col("I_struct") * F.col(f"omega_{c}")).withColumn(f"C_{c}", F.col(f"I_{c}") * (F.col(f"s_{c}") - tau))
    return out.withColumn("C_llm", F.col("I_llm") * (F.coalesce("p_llm", F.lit(0.0)) - F.col("S_base")))


def fuse_cosines(pairs: DataFrame, gamma: float = GAMMA, tau: float = TAU) -> DataFrame:
    """The plain scorer: raw label and context cosines, the context's weight where both contexts exist."""
    lab, ctx = F.pow(F.abs(F.col("cos_label") - tau), F.lit(gamma)), F.pow(F.abs(F.col("cos_context") - tau), F.lit(gamma))
    w = F.when(F.col("has_context"), F.coalesce(F.try_divide(ctx, ctx + lab), F.lit(0.0))).otherwise(0.0)
    out = pairs.withColumn("w_c", w).withColumn("S_lctx", (1 - F.col("w_c")) * F.col("cos_label") + F.col("w_c") * F.col("cos_context"))
    return out.withColumn("U", clip01(1 - 2 * F.abs(F.col("S_lctx") - tau)))


def label_channel(cells: DataFrame, tau: float = TAU) -> DataFrame:
    """From the cells (src, tgt, sim) of the label matrices the best score and its lead as quality; one cell has quality 1."""
    r = F.row_number().over(Window.partitionBy("src", "tgt").orderBy(F.desc("sim"), *[c for c in cells.columns if c not in ("src", "tgt", "sim")]))
    top = cells.withColumn("r", r).where("r <= 2").groupBy("src", "tgt").agg(F.max("sim").alias("s_lex"), F.min("sim").alias("z2"), F.count(F.lit(1)).alias("n"))
    return top.select("src", "tgt", "s_lex", F.when(F.col("n") < 2, 1.0).otherwise(clip01((F.col("s_lex") - F.col("z2")) / F.greatest(F.lit(1e-8), 1 - F.col("z2")))).alias("q_lex"))


def best_links(cells: DataFrame, i: str = "i", j: str = "j", score: str = "score") -> DataFrame:
    """Of each pair's matrix the best cell of every row and column, positive ones, once each."""
    row = F.row_number().over(Window.partitionBy("src", "tgt", i).orderBy(F.desc(score), j))
    col = F.row_number().over(Window.partitionBy("src", "tgt", j).orderBy(F.desc(score), i))
    return cells.where((F.col(score) > 0) & F.col(i).isNotNull() & F.col(j).isNotNull()).withColumn("r", row).withColumn("c", col).where("r = 1 OR c = 1").drop("r", "c")


def support(cells: DataFrame, score: str = "score") -> DataFrame:
    """Of each pair's matrix the mean best of rows and of columns, and half their sum."""
    rows = cells.groupBy("src", "tgt", "i").agg(F.max(score).alias("m")).groupBy("src", "tgt").agg(F.avg("m").alias("row_best"))
    cols = cells.groupBy("src", "tgt", "j").agg(F.max(score).alias("m")).groupBy("src", "tgt").agg(F.avg("m").alias("col_best"))
    return rows.join(cols, ["src", "tgt"]).withColumn("strength", (F.col("row_best") + F.col("col_best")) / 2)


def evidence_quality(coverage: Column, strength: Column, stability: Column) -> Column:
    """Mean of coverage, strength and stability (or informativeness), within 0 and 1."""
    return clip01((clip01(coverage) + strength + stability) / 3)


def hierarchy_channel(pairs: DataFrame) -> DataFrame:
    """From ``emb``, ``strength``, ``inf``, ``n_src``, ``n_tgt`` the score and quality of one family."""
    cov = (F.col("n_src") + F.col("n_tgt")) / 12.0
    none = (F.col("n_src") == 0) | (F.col("n_tgt") == 0)
    return pairs.withColumn("s", F.when(none, TAU).otherwise(clip01((F.col("emb") + F.col("strength")) / 2))).withColumn("q", F.when(none, 0.0).otherwise(evidence_quality(cov, F.col("strength"), F.col("inf"))))


def similarity_channel(pairs: DataFrame) -> DataFrame:
    """As C2 with the stability of the best matches (``std``) for the informativeness, over 48 items a side."""
    cov, stab = (F.col("n_src") + F.col("n_tgt")) / 96.0, clip01(1 - F.least(F.lit(1.0), 2 * F.col("std")))
    none = (F.col("n_src") == 0) | (F.col("n_tgt") == 0)
    return pairs.withColumn("s", F.when(none, TAU).otherwise(clip01((F.col("emb") + F.col("strength")) / 2))).withColumn("q", F.when(none, 0.0).otherwise(evidence_quality(cov, F.col("strength"), stab)))


def difference_channel(items: DataFrame) -> DataFrame:
    """C4: from items (src, tgt, side, ic, best) each side's share of unsupported information, and one minus their mean; one side alone still counts."""
    side = items.groupBy("src", "tgt", "side").agg((F.sum(F.col("ic") * (1 - F.col("best"))) / F.greatest(F.lit(1e-8), F.sum("ic"))).alias("conflict"), F.avg("ic").alias("mean_ic"))
    return side.groupBy("src", "tgt").agg(clip01(1 - clip01(F.sum("conflict") / 2)).alias("s_diff"), (F.sum("mean_ic") / 2).alias("strength"))


def attribute_channel(items: DataFrame) -> DataFrame:
    """From attributes (src, tgt, side, weight, best) the mean of the sides' weighted support, never under neutral."""
    side = items.groupBy("src", "tgt", "side").agg(F.coalesce(F.try_divide(F.sum(F.col("weight") * F.col("best")), F.sum("weight")), F.lit(0.0)).alias("r"))
    return side.groupBy("src", "tgt").agg(F.greatest(F.lit(TAU), F.avg("r")).alias("s_attr"))


def diverse_top(items: DataFrame, group: list[str], relation: str, score: str, tie: str, cap: int, limit: int) -> DataFrame:
    """T5: best items of a group, ``cap`` of each relation and ``limit`` in all; ties by position."""
    order = [F.desc(score), F.desc(tie), F.asc("pos")]
    out = items.withColumn("__a", F.row_number().over(Window.partitionBy(*group, relation).orderBy(*order))).where(F.col("__a") <= cap)
    return out.withColumn("__b", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("__b") <= limit).drop("__a", "__b")


def trim_to_budget(items: DataFrame, group: list[str], size: str, budget: int) -> DataFrame:
    """The first items of a group within a budget, stopping at the first that overflows; the first one always."""
    w = Window.partitionBy(*group).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("__s", F.sum(size).over(w)).withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy("pos"))).where((F.col("__s") <= budget) | (F.col("__n") == 1)).drop("__s", "__n")
