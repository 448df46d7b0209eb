"""The candidate-set selector end to end: its feature frame, heuristic and calibrated application, validation out of fold, arbitration.

A row is a candidate (src, tgt) with ``pair_score`` and evidence columns. Everything for each source or
target is a window or a grouped aggregation; models are fitted on all rows and applied as columns.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.durable import dropped, kept
from tessera.functions.scalars import clip01, logit, sigmoid
from tessera.operators import selection as M

#: Features of the rank model and of the accept model, in order.
RANK_FEATURES = ["logit_pair", "s_label", "S_struct", "s_hier", "s_sim", "s_diff", "s_attr", "cand_sim", "cand_sim_prob", "cand_share_log", "z", "gap", "channel_gap", "rank_score", "reciprocity01", "distinctive", "safety"]
ACCEPT_FEATURES = ["utility", "rank_prob", "pair_score", "utility_margin", "prob_margin", "entropy", "distinctive", "s_label", "S_struct", "s_diff"]
GAP_CHANNELS = ["s_label", "S_struct", "s_hier", "s_sim", "s_attr", "cand_sim"]


def by_source() -> Window:
    return Window.partitionBy("src")


def scaled_count(count: Column, cap: float) -> Column:
    """A count on a logarithmic scale, 1 at ``cap``."""
    return F.least(F.lit(1.0), F.log1p(F.greatest(F.lit(0.0), F.coalesce(count.cast("double"), F.lit(0.0)))) / float(np.log1p(cap)))


def specificity(side: str) -> Column:
    """How specific an entity is, from the information of its edges and the sizes of its evidence pools."""
    return 0.6 * clip01(F.coalesce(f"{side}_ic_mean", F.lit(0.0))) + 0.2 * scaled_count(F.col(f"{side}_n_hier"), 20) + 0.1 * scaled_count(F.col(f"{side}_n_object"), 50) + 0.1 * scaled_count(F.col(f"{side}_n_attr"), 20)


def with_pools(pairs: DataFrame, pools: DataFrame) -> DataFrame:
    """The pool metrics (``pool_metrics``) of both ends of a pair, as ``src_*`` and ``tgt_*``; absent ones are 0."""
    out = pairs
    for side in ("src", "tgt"):
        own = pools.select(F.col("iri").alias(side), *[F.col(c).cast("double").alias(f"{side}_{c}") for c in pools.columns if c != "iri"])
        out = out.join(own, side, "left").na.fill(0.0, [c for c in own.columns if c != side])
    return out


def frame(pairs: DataFrame, temperature: float = 0.75, granularity: Column | None = None) -> DataFrame:
    """The selector's features. Takes pair_score, s_label, S_struct, s_hier, s_sim, s_diff, s_attr, cand_sim, cand_sim_prob, cand_share_log, distinctive.

    Without ``granularity`` it is the difference of the ends' specificities, 0 where the pairs have no pools.
    """
    if granularity is None:
        granularity = F.abs(specificity("src") - specificity("tgt")) if "src_ic_mean" in pairs.columns else F.lit(0.0)
    out = pairs.withColumn("pair_score", clip01(F.coalesce("pair_score", F.lit(0.0))))
    out = M.channel_gap(M.group_features(out, "pair_score"), GAP_CHANNELS).withColumn("logit_pair", logit(F.col("pair_score")))
    out = M.reciprocity(out, "pair_score", temperature).withColumn("reciprocity01", (F.col("reciprocity") + 1) / 2)
    out = out.withColumn("granularity", granularity).withColumn("contradiction", 1 - clip01(F.coalesce("s_diff", F.lit(1.0))))
    return out.withColumn("safety", clip01(1 - (F.col("granularity") + F.col("contradiction")) / 2))


def heuristic(rows: DataFrame, weight: float = 0.6, temperature: float = 0.75, limit: float = 0.55) -> DataFrame:
    """M1/M2: select utilities of a ``frame``, each source's risk that no candidate is right, and the scores, 0 where it abstains."""
    z = F.when(F.stddev_pop("pair_score").over(by_source()) > 1e-12, sigmoid(F.col("z"))).otherwise(0.5)
    competition = clip01((z + sigmoid(F.col("gap") / temperature) + F.col("channel_gap") + clip01(F.col("cand_sim_prob")) + F.col("reciprocity01")) / 5)
    out = rows.withColumn("competition", competition)
    auxiliary = clip01((F.col("competition") + F.col("distinctive") + F.col("safety")) / 3)
    out = out.withColumn("utility", clip01(weight * F.col("pair_score") + (1 - weight) * auxiliary))
    return decided(M.softmax(out, "utility", ["src"], temperature, "rank_prob"), limit)


def group_entropy(prob: str) -> Column:
    """W5 over the rows of a source as a window: entropy of its shares over that of equal ones, 0 for one row."""
    n = F.count(F.lit(1)).over(by_source())
    raw = -F.sum(F.col(prob) * F.log(F.greatest(F.col(prob), F.lit(1e-12)))).over(by_source())
    return F.when(n > 1, clip01(raw / F.log(F.greatest(n, F.lit(2)).cast("double")))).otherwise(0.0)


def decided(rows: DataFrame, limit: float = 0.55) -> DataFrame:
    """M2: risk, abstention and final scores from utility, rank_prob, distinctive and competition (and ``risk_boost``, if there is one)."""
    top = lambda c: F.max(c).over(by_source())
    risk = clip01((group_entropy("rank_prob") + (1 - top("utility")) + (1 - top("distinctive")) + (1 - top("competition"))) / 4)
    boost = F.col("risk_boost") if "risk_boost" in rows.columns else F.lit(0.0)
    out = rows.withColumn("entropy", group_entropy("rank_prob")).withColumn("no_match", clip01(risk + boost)).withColumn("abstained", F.col("no_match") >= limit)
    best = F.row_number().over(by_source().orderBy(F.desc("utility"), "tgt")) == 1
    return out.withColumn("S_select", F.when(F.col("abstained"), 0.0).otherwise(F.col("utility"))).withColumn("winner", best & ~F.col("abstained")).withColumn("reason", F.when(F.col("abstained"), "no_match").otherwise("numeric"))


def ask(rows: DataFrame, limit: float = 0.55, close: float = 0.08) -> DataFrame:
    """M3: sources to arbitrate: the two best utilities are close, or the risk is close to the limit."""
    second = F.lead("utility").over(by_source().orderBy(F.desc("utility"), "tgt"))
    best = rows.withColumn("margin", F.col("utility") - F.coalesce(second, F.lit(0.0))).withColumn("__r", F.row_number().over(by_source().orderBy(F.desc("utility"), "tgt"))).where("__r = 1")
    return best.where((F.col("margin") < close) | (F.abs(F.col("no_match") - limit) < close)).select("src", "margin", "no_match")


def prompts(rows: DataFrame, briefs: DataFrame, top: int = 5, brief_chars: int = 1200) -> DataFrame:
    """M4: (src, prompt, ids): the candidates to choose from, the best by pair score as C1, C2 ..., with a cut brief of each pair's evidence; ``ids`` maps them to targets."""
    r = F.row_number().over(by_source().orderBy(F.desc("pair_score"), "tgt"))
    best = rows.withColumn("rank", r).where(F.col("rank") <= top).join(briefs.select("src", "tgt", "brief"), ["src", "tgt"], "left")
    evidence = F.when(F.coalesce(F.col("brief"), F.lit("")) == "", F.lit("none")).otherwise(F.substring("brief", 1, brief_chars))
    line = F.format_string("C%d. %s | score %.4f | evidence: %s", F.col("rank"), F.col("tgt").cast("string"), F.col("pair_score"), evidence)
    got = best.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("rank", "tgt", line.alias("line")))).alias("c"))
    return got.select("src", F.array_join(F.transform("c", lambda x: x["line"]), "\n").alias("prompt"), F.transform("c", lambda x: F.struct(F.concat(F.lit("C"), x["rank"].cast("string")).alias("id"), x["tgt"].alias("tgt"))).alias("ids"))


def arbitrated(rows: DataFrame, verdicts: DataFrame, boost: float = 0.15, limit: float = 0.55, temperature: float = 0.75) -> DataFrame:
    """M4: utilities after verdicts (src, winner, relation, confidence): an equivalent winner gains, the others share the loss; any other relation, or NO_MATCH, raises the risk.

    ``winner`` is a target. Verdicts without confidence, and ones that name no candidate, change nothing.
    """
    v = verdicts.where("confidence > 0").select("src", F.col("winner").cast("string").alias("__w"), F.lower("relation").alias("__rel"), (boost * clip01(F.col("confidence"))).alias("__b"))
    out = rows.drop("no_match", "abstained", "S_select", "winner", "reason", "entropy").join(v, "src", "left")
    none = F.coalesce((F.upper("__w") == "NO_MATCH") | F.col("__rel").isin("broader", "narrower", "sibling", "related", "none"), F.lit(False))
    chosen = F.coalesce(~none & (F.col("__rel") == "equivalent") & (F.col("tgt").cast("string") == F.col("__w")), F.lit(False))
    named = F.max(chosen.cast("int")).over(by_source()) == 1
    loss = F.col("__b") / F.greatest(F.lit(1), F.count(F.lit(1)).over(by_source()) - 1)
    moved = F.when(chosen, clip01(F.col("utility") + F.col("__b"))).when(named, clip01(F.col("utility") - loss)).otherwise(F.col("utility"))
    out = out.withColumn("llm_used", none | named).withColumn("risk_boost", F.when(none, F.col("__b")).otherwise(0.0)).withColumn("utility", moved).drop("__w", "__rel", "__b")
    out = decided(M.softmax(out, "utility", ["src"], temperature, "rank_prob"), limit)
    return out.withColumn("reason", F.when(F.col("llm_used") & F.col("abstained"), "llm_no_match").when(F.col("llm_used"), "llm").otherwise(F.col("reason"))).drop("risk_boost")


def veto(decisions: DataFrame, verdicts: DataFrame, switch: bool = False) -> DataFrame:
    """M4/M8: direct choices on accepted decisions (src, tgt, accepted): NO_MATCH takes acceptance back; another winner replaces the target only if ``switch``."""
    v = verdicts.where("confidence > 0").select("src", F.col("winner").alias("__w"), F.lower("relation").alias("__rel"))
    out = decisions.join(v, "src", "left")
    none = F.coalesce((F.upper(F.col("__w").cast("string")) == "NO_MATCH") | (F.col("__rel") != "equivalent"), F.lit(False))
    out = out.withColumn("llm_used", F.col("accepted") & F.col("__w").isNotNull())
    kind = decisions.schema["tgt"].dataType
    target = F.when(F.col("llm_used") & ~none, F.coalesce(F.expr(f"try_cast(__w AS {kind.simpleString()})"), F.col("tgt"))).otherwise(F.col("tgt")) if switch else F.col("tgt")
    return out.withColumn("tgt", target).withColumn("accepted", F.col("accepted") & ~(F.col("llm_used") & none)).drop("__w", "__rel")


def decisions(rows: DataFrame, refs: DataFrame, exact_sources: DataFrame | None = None, background: float = 0.25, exact_weight: float = 1.0, temperature: float = 0.75) -> DataFrame:
    """One row for each source: its best candidate by ``utility``, the accept model's features, whether it has a reference, label and sample weight.

    Sources without a reference weigh ``background``; those that exact matching took out are negatives of ``exact_weight`` (0 leaves them out).
    """
    shared = M.softmax(rows, "utility", ["src"], temperature, "rank_prob").withColumn("entropy", group_entropy("rank_prob"))
    order = by_source().orderBy(F.desc("utility"), "tgt")
    lead = lambda c: F.col(c) - F.coalesce(F.lead(c).over(order), F.lit(0.0))
    best = shared.withColumn("utility_margin", lead("utility")).withColumn("prob_margin", lead("rank_prob")).withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")
    out = best.select("src", "tgt", *ACCEPT_FEATURES).join(refs.select("src").distinct().withColumn("__has", F.lit(True)), "src", "left").join(refs.select("src", "tgt").distinct().withColumn("__hit", F.lit(1)), ["src", "tgt"], "left")
    exact = exact_sources.select("src").distinct().withColumn("__exact", F.lit(True)) if exact_sources is not None else None
    out = (out.join(exact, "src", "left") if exact is not None else out.withColumn("__exact", F.lit(None).cast("boolean")))
    label = F.when(F.col("__exact"), 0).otherwise(F.coalesce("__hit", F.lit(0)))
    weight = F.when(F.col("__exact"), float(exact_weight)).when(F.col("__has"), 1.0).otherwise(float(background))
    return out.withColumn("label", label).withColumn("sample_weight", weight).withColumn("has_ref", F.coalesce("__has", F.lit(False))).withColumn("support", support()).drop("__has", "__hit", "__exact")


def support() -> Column:
    """Evidence support of a decision, damped where the difference channel is under neutral."""
    confidence = F.greatest(clip01(F.col("rank_prob")), 1 - clip01(F.col("entropy")))
    raw = (clip01(F.col("pair_score")) + clip01(F.col("s_label")) + clip01(F.col("S_struct")) + confidence) / 4
    return clip01(F.when(F.col("s_diff") < 0.5, raw * clip01(F.col("s_diff")) / 0.5).otherwise(raw))


@dataclass
class Linear:
    """A standardised linear model over named features."""

    features: list[str]
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    bias: float = 0.0

    def column(self, df: DataFrame, name: str) -> DataFrame:
        return M.linear_score(df, self.features, self.weights, self.mean, self.scale, self.bias, name)


@dataclass
class Choice:
    """What validation chose: settings, threshold, metrics, and the models fitted on everything."""

    background: float
    resolve: bool
    use_veto: bool
    threshold: float
    metrics: dict[str, float]
    rank: Linear | None = None
    accept: Linear | None = None
    trials: list[dict] = field(default_factory=list)


def fit_rank(rows: DataFrame, refs: DataFrame, max_rows: int = 2_000_000) -> Linear:
    """M5 with all features: listwise over the sources that have a positive among their candidates."""
    return fit_labelled(labelled(rows, refs), max_rows)


def labelled(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """``label``: 1 for pairs of the reference, else 0. A source's references come as a list, so rows are dealt by source alone, as all else here is."""
    hits = refs.where("src IS NOT NULL").groupBy("src").agg(F.collect_set("tgt").alias("__hits"))
    hit = F.coalesce(F.array_contains("__hits", F.col("tgt")), F.lit(False))
    return rows.drop("label").join(hits, "src", "left").withColumn("label", hit.cast("int")).drop("__hits")


def fit_labelled(rows: DataFrame, max_rows: int = 2_000_000) -> Linear:
    """M5 over rows with a ``label``."""
    w, m, s = M.fit_rank_model(rows.select("src", "label", *RANK_FEATURES), RANK_FEATURES, max_rows=max_rows)
    return Linear(RANK_FEATURES, w, m, s)


def fit_accept(rows: DataFrame, max_rows: int = 2_000_000) -> Linear | None:
    """M6 with all features; None without a weighted row."""
    some = rows.where("sample_weight > 0")
    if not some.take(1):
        return None
    w, m, s, b = M.fit_accept_model(some.select("src", "label", "sample_weight", *ACCEPT_FEATURES), ACCEPT_FEATURES, max_rows=max_rows)
    return Linear(ACCEPT_FEATURES, w, m, s, b)


def with_match(decided_rows: DataFrame, accept: Linear) -> DataFrame:
    return accept.column(decided_rows, "__logit").withColumn("p_match", sigmoid(F.col("__logit"))).drop("__logit")


def tuned(rows: DataFrame, grid: list[float], resolve: bool, verdicts: DataFrame | None) -> dict[str, float]:
    """M7/M8: the best threshold of decisions with p_match, after targets' conflicts and a veto where asked."""
    kept = rows if verdicts is None else veto(rows.withColumn("accepted", F.lit(True)), verdicts).withColumn("p_match", F.when(F.col("accepted"), F.col("p_match")).otherwise(0.0))
    if not resolve:
        best = M.tune_threshold(kept, grid).first()
        return best.asDict()
    # of the sources over a threshold that chose one target the likeliest stays; that one is the same at every threshold it passes
    first = F.row_number().over(Window.partitionBy("tgt").orderBy(F.desc("p_match"), "src")) == 1
    return M.tune_threshold(kept.withColumn("p_match", F.when(first, F.col("p_match")).otherwise(-1.0)), grid).first().asDict()


#: Stands for the weight of sources without a reference until one is chosen; weights are never negative.
BACKGROUND = -1.0


def reweighed(made: DataFrame, background: float) -> DataFrame:
    """Decisions made with ``BACKGROUND``, now with a weight."""
    return made.withColumn("sample_weight", F.when(F.col("sample_weight") == BACKGROUND, float(background)).otherwise(F.col("sample_weight")))


def choose(rows: DataFrame, refs: DataFrame, folds: int = 5, backgrounds: tuple[float, ...] = (0.1, 0.25, 0.5), resolves: tuple[bool, ...] = (False, True), verdicts: DataFrame | None = None, exact_sources: DataFrame | None = None, grid: list[float] | None = None, seed: int = 42) -> Choice | None:
    """M10 (``folds`` of 2 and more): each source's utility and p_match come from models that did not see it; M11 (``folds`` 1): from models of the other half.

    The settings with the best F1, then precision, threshold, lower background weight, no veto and no
    resolving win; the models are then fitted on all and the threshold is tuned again on them. None
    where nothing can be fitted. Features and decisions are written once each, without columns that
    nothing reads, and deleted when read.
    """
    grid = grid or [i / 200 for i in range(1, 200)]
    k = max(2, folds)
    fold = F.pmod(F.xxhash64("src", F.lit(seed)), F.lit(k))
    # what follows reads the features often and wants no more than them, so they are written once
    wanted = dict.fromkeys([*RANK_FEATURES, *[c for c in ACCEPT_FEATURES if c in rows.columns]])
    rows = labelled(rows.select("src", "tgt", *wanted), refs)
    written = kept(rows.withColumn("__good", F.max("label").over(by_source()) == 1), "selector-rows")
    good, rows = written.where("__good"), written.drop("__good", "label")
    ranked = None
    for f in range(k if folds > 1 else 1):
        held = fit_labelled(good.where(fold != f)).column(rows.where(fold == f), "utility")
        ranked = held if ranked is None else ranked.unionByName(held)
    needed = ["src", "tgt", *ACCEPT_FEATURES, "label", "sample_weight", "has_ref"]
    trials = []
    # decisions differ between background weights in the sample weight alone
    made = kept(decisions(ranked, refs, exact_sources, BACKGROUND).select(*needed), "selector-decisions")
    for background in backgrounds:
        weighed = reweighed(made, background)
        scored = None
        for f in range(k if folds > 1 else 1):
            accept = fit_accept(weighed.where(fold != f) if folds > 1 else weighed)
            if accept is None:
                dropped(made, written)
                return None
            part = with_match(weighed.where(fold == f) if folds > 1 else weighed, accept)
            scored = part if scored is None else scored.unionByName(part)
        for use_veto in (False, True) if verdicts is not None else (False,):
            for resolve in resolves:
                got = tuned(scored, grid, resolve, verdicts if use_veto else None)
                trials.append({"background": background, "use_veto": use_veto, "resolve": resolve, **got})
    dropped(made)
    best = max(trials, key=lambda t: (t["f1"], t["precision"], t["threshold"], -t["background"], not t["use_veto"], not t["resolve"]))
    rank = fit_labelled(good)
    refit = kept(decisions(rank.column(rows, "utility"), refs, exact_sources, best["background"]).select(*needed), "selector-decisions")
    dropped(written)
    accept = fit_accept(refit)
    final = tuned(with_match(refit, accept), grid, best["resolve"], verdicts if best["use_veto"] else None)
    dropped(refit)
    return Choice(best["background"], best["resolve"], best["use_veto"], float(final["threshold"]), {m: float(final[m]) for m in ("precision", "recall", "f1")}, rank, accept, trials)


def calibrated(rows: DataFrame, refs: DataFrame, choice: Choice, threshold: float | None = None, compatible: bool = False, verdicts: DataFrame | None = None, exact_sources: DataFrame | None = None) -> DataFrame:
    """Scores after the chosen models: a source's winner keeps its p_match (or a threshold-compatible score) if that reaches the accept threshold, all else is 0, with reasons."""
    scored = choice.rank.column(rows, "utility")
    made = with_match(decisions(scored, refs, exact_sources, choice.background), choice.accept)
    made = made.withColumn("accepted", F.col("p_match") >= choice.threshold)
    made = veto(made, verdicts) if verdicts is not None and choice.use_veto else made.withColumn("llm_used", F.lit(False))
    final = M.compatible_score(F.col("p_match"), F.lit(choice.threshold), threshold) if compatible and threshold is not None else F.col("p_match")
    reason = F.when(F.col("accepted"), "calibrated").when(F.col("llm_used"), "llm_no_match").otherwise("calibrated_no_match")
    made = made.select("src", F.col("tgt").alias("__winner"), "p_match", "accepted", "llm_used", "utility_margin", F.col("entropy").alias("selection_entropy"), "support", final.alias("__final"), reason.alias("reason"))
    out = M.softmax(scored, "utility", ["src"], 0.75, "rank_prob").join(made, "src")
    won = (F.col("tgt") == F.col("__winner")) & F.col("accepted")
    return out.withColumn("winner", won).withColumn("S_select", F.when(won, F.col("__final")).otherwise(0.0)).withColumn("abstained", ~F.col("accepted")).withColumn("accept_threshold", F.lit(choice.threshold)).drop("__winner", "__final", "accepted")


def select(pairs: DataFrame, refs: DataFrame | None = None, mode: str = "global", least_positive: int = 50, enabled: bool = True, **options) -> DataFrame:
    """The selector's entry. Rows pass as they are (with ``pair_score`` kept) in local mode, if disabled, or without scores; calibrated with enough positive sources, else heuristic."""
    if not enabled or mode == "local" or "pair_score" not in pairs.columns:
        return pairs
    rows = frame(pairs)
    if refs is not None:
        positive = rows.select("src", "tgt").join(refs.select("src", "tgt"), ["src", "tgt"], "left_semi").select("src").distinct().count()
        choice = choose(rows, refs, **options) if positive >= least_positive else None
        if choice is not None:
            return calibrated(rows, refs, choice, verdicts=options.get("verdicts"), exact_sources=options.get("exact_sources"))
    return heuristic(rows)


def source_groups(rows: DataFrame, flag: str) -> DataFrame:
    """Sources, and those of which a row carries the flag."""
    return rows.groupBy("src").agg(F.max(F.col(flag).cast("int")).alias("f")).agg(F.count(F.lit(1)).alias("sources"), F.count_if(F.col("f") == 1).alias("flagged"))


def conflict_flag(rows: DataFrame) -> DataFrame:
    """Whether any row resolves target conflicts; null where none has an accept threshold."""
    return rows.agg(F.when(F.max("accept_threshold") > 0, F.max(F.col("resolve").cast("int")) == 1).alias("resolve"))


def training_groups(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """The rows of sources that have a positive among their candidates."""
    positive = rows.select("src", "tgt").join(refs.select("src", "tgt"), ["src", "tgt"], "left_semi").select("src").distinct()
    return rows.join(positive, "src", "left_semi")


def split_references(refs: DataFrame, exact: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References without the sources that exact matching took out, and those of such sources."""
    taken = exact.select("src").distinct()
    return refs.join(taken, "src", "left_anti"), refs.join(taken, "src", "left_semi")
