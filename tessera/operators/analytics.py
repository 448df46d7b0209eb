"""Analytics over scored pairs: run statistics, reliability, discrimination, pivots, resampling, assertions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.durable import checkpointed


def run_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """A10: for each column mean, population deviation, least, quartiles, greatest, over rows that have it."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "metric", "value").where("value IS NOT NULL")
    out = long.groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    quartiles = reduce(DataFrame.unionByName, [quantiles(df.select(F.col(c).cast("double").alias("v")), "v", [0.25, 0.5, 0.75]).select(F.lit(c).alias("metric"), "q") for c in columns])
    return out.join(F.broadcast(quartiles), "metric").select("metric", "n", "mean", "std", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max")


def llm_counts(df: DataFrame, low: float = 0.5, high: float = 0.8) -> DataFrame:
    """Rows, rows with arbitration, and the share in the review band (both ends count)."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("w_i") > 0).alias("n_llm"), F.avg(F.col("score").between(low, high).cast("double")).alias("review_share"))


def reasons(df: DataFrame) -> DataFrame:
    """Arbitrated rows by reason."""
    return df.where("llm_used").groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("tp"), F.count_if(F.col("label") == 0).alias("fp"))


def ranged_counts(df: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """The distinct values with their counts, dealt by ranges and kept, and the rows before each range: what ranks and quantiles come from without a task that holds all."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("__c"))
    ranged = checkpointed(counts.repartitionByRange(value).withColumn("__p", F.spark_partition_id()))
    sums = ranged.groupBy("__p").agg(F.sum("__c").alias("__s"))
    before = sums.alias("a").join(sums.alias("b"), F.col("b.__p") < F.col("a.__p"), "left").groupBy(F.col("a.__p").alias("__p")).agg(F.coalesce(F.sum("b.__s"), F.lit(0)).alias("__before"))
    return ranged, before


def quantiles(df: DataFrame, value: str, shares: list[float]) -> DataFrame:
    """One row with ``q``: the exact quantiles by linear interpolation; null for a table without values. Only the values next to a quantile leave their range."""
    ranged, before = ranged_counts(df, value)
    n = ranged.agg(F.coalesce(F.sum("__c"), F.lit(0)).alias("__n"))
    w = Window.partitionBy("__p").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    at = [F.lit(float(s)) * F.greatest(F.lit(0), F.col("__n") - 1) for s in shares]
    wanted = F.array(*[g(x).cast("long") for x in at for g in (F.floor, F.ceil)])
    placed = ranged.join(F.broadcast(before), "__p").withColumn("__end", F.col("__before") + F.sum("__c").over(w)).crossJoin(F.broadcast(n))
    hit = placed.select(F.col(value).cast("double").alias("v"), F.explode(F.array_distinct(F.filter(wanted, lambda i: (i >= F.col("__end") - F.col("__c")) & (i < F.col("__end"))))).alias("i"))
    found = hit.agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("m")).crossJoin(F.broadcast(n))
    low, high = (lambda x: F.element_at("m", F.floor(x).cast("long"))), (lambda x: F.element_at("m", F.ceil(x).cast("long")))
    each = [low(x) + (high(x) - low(x)) * (x - F.floor(x)) for x in at]
    return found.select(F.when(F.col("__n") > 0, F.array(*each)).alias("q"))


def quantile_edges(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """One row with the distinct edges of quantile bins."""
    return quantiles(df, value, [i / bins for i in range(bins + 1)]).select(F.array_distinct("q").alias("edges"))


def with_bin(df: DataFrame, edges: DataFrame, value: str) -> DataFrame:
    """Each value's bin, from 1; bins are closed on the right, the first on both sides; one bin where all are equal."""
    return df.crossJoin(F.broadcast(edges)).withColumn("bin", F.greatest(F.lit(1), F.size(F.filter("edges", lambda e: e < F.col(value))))).drop("edges")


def bin_codes(df: DataFrame, value: str, bins: list[tuple[float, float]]) -> DataFrame:
    """Number of the given half-open bin [low, high) of a value; the last is closed; null outside."""
    code = reduce(lambda c, b: c.when((F.col(value) >= b[1][0]) & ((F.col(value) < b[1][1]) | ((b[0] == len(bins) - 1) & (F.col(value) == b[1][1]))), b[0]), enumerate(bins), F.when(F.lit(False), -1))
    return df.withColumn("bin", code)


def reliability(df: DataFrame, tau: float = 0.5, bins: int = 10, z: float = 1.959963984540054) -> DataFrame:
    """By quantile bin of ``q``: rows, how often (s > tau) agrees with the label, and its Wilson interval."""
    binned = with_bin(df, quantile_edges(df, "q", bins), "q")
    out = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("q").alias("q_mean"), F.avg(((F.col("s") > tau).cast("int") == F.col("label")).cast("double")).alias("acc"))
    mid, d = (F.col("acc") + z * z / (2 * F.col("n"))), 1 + z * z / F.col("n")
    half = z * F.sqrt(F.col("acc") * (1 - F.col("acc")) / F.col("n") + z * z / (4 * F.col("n") * F.col("n")))
    return out.withColumn("low", (mid - half) / d).withColumn("high", (mid + half) / d)


def calibration(df: DataFrame, bins: int = 10) -> DataFrame:
    """By quantile bin of ``q``: mean quality, share of positives, mean score, Brier score and absolute error."""
    binned = with_bin(df, quantile_edges(df, "q", bins), "q")
    err = F.col("s") - F.col("label")
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("q").alias("q_mean"), F.avg("label").alias("positive"), F.avg("s").alias("s_mean"), F.avg(err * err).alias("brier"), F.avg(F.abs(err)).alias("mae"))


def average_rank(df: DataFrame, value: str, by: list[str], name: str = "rank") -> DataFrame:
    """Ranks within each group of ``by``, where ties share their mean."""
    w = Window.partitionBy(*by)
    ties = Window.partitionBy(*by, value)
    return df.withColumn(name, F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)


def average_rank_all(df: DataFrame, value: str, name: str = "rank") -> DataFrame:
    """W12 over a whole table: ranks come from the counts of distinct values, dealt by ranges, so no task gets all rows.

    Values are counted first; each range of values is ranked in its own task after the sums of the
    ranges before it.
    """
    ranged, before = ranged_counts(df, value)
    w = Window.partitionBy("__p").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranks = ranged.join(F.broadcast(before), "__p").select(value, (F.col("__before") + F.sum("__c").over(w) - (F.col("__c") - 1) / 2.0).alias(name))
    return df.join(ranks, value, "left")


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation with shared ranks; null where a column is constant."""
    ranked = average_rank_all(average_rank_all(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b), a, "ra"), b, "rb")
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.when((F.min("ra") < F.max("ra")) & (F.min("rb") < F.max("rb")), F.try_divide(F.covar_pop("ra", "rb"), F.stddev_pop("ra") * F.stddev_pop("rb"))).alias("rho"))


def source_auc(df: DataFrame) -> DataFrame:
    """Area under the curve of each source that has both classes (ties count half), and its best correct row's rank."""
    by = Window.partitionBy("src")
    ranked = average_rank(df, "s", ["src"]).withColumn("gold_rank", F.when(F.col("label") == 1, F.rank().over(by.orderBy(F.desc("s")))))
    n1, n0 = F.sum("label"), F.sum(1 - F.col("label"))
    out = ranked.groupBy("src").agg(n1.alias("n_pos"), n0.alias("n_neg"), F.sum(F.when(F.col("label") == 1, F.col("rank")).otherwise(0.0)).alias("r"), F.avg("q").alias("q_mean"), F.min("gold_rank").alias("gold_rank"))
    status = F.when(F.col("n_pos") == 0, "no_positive").when(F.col("n_neg") == 0, "no_negative").otherwise("ok")
    return out.select("src", "n_pos", "n_neg", "q_mean", "gold_rank", status.alias("status"), F.when(status == "ok", (F.col("r") - F.col("n_pos") * (F.col("n_pos") + 1) / 2) / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def pick_rate(df: DataFrame) -> DataFrame:
    """Whether each source's best score is its correct row; a tie counts as wrong."""
    best = F.max("s").over(Window.partitionBy("src"))
    out = df.withColumn("__top", F.col("s") == best).groupBy("src").agg(F.count_if("__top").alias("tie_size"), F.max(F.when(F.col("__top"), F.col("label"))).alias("hit"), F.avg("q").alias("q_mean"))
    return out.select("src", "tie_size", "q_mean", F.when(F.col("tie_size") == 1, F.col("hit")).otherwise(0).alias("picked_correct"))


def inertness(df: DataFrame, channels: list[str]) -> DataFrame:
    """For each channel the share of rows with next to no weight, and with next to no share."""
    rows = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"sigma_{c}").alias("sigma"), F.col(f"omega_{c}").alias("omega")) for c in channels])))
    return rows.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("sigma") < 1e-6).cast("double")).alias("inert"), F.avg((F.col("omega") < 0.01).cast("double")).alias("light"))


def activity(dumps: dict[str, DataFrame], channels: list[str]) -> DataFrame:
    """For each dump and channel rows, active rows, and the score's mean and range among those."""
    parts = []
    for name, df in dumps.items():
        rows = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(f"q_{c}").alias("q"), F.col(f"s_{c}").alias("s"), F.col(f"sigma_{c}").alias("sigma")) for c in channels])))
        on = (F.col("q") > 0) & (F.col("sigma") > 1e-8)
        parts.append(rows.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.count_if(on).alias("active"), F.avg(F.when(on, F.col("s"))).alias("s_mean"), F.min(F.when(on, F.col("s"))).alias("s_min"), F.max(F.when(on, F.col("s"))).alias("s_max")).withColumn("dump", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def pivot_table(df: DataFrame, rows: str, columns: str, n_rows: int, n_columns: int) -> DataFrame:
    """Counts of all cells of two binnings, empty ones too, with row, column and grand totals (null bins)."""
    spark = df.sparkSession
    cells = df.cube(F.col(rows).alias("r"), F.col(columns).alias("c")).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("g"))
    axis = lambda n, name: spark.range(n).select(F.col("id").cast("int").alias(name)).unionByName(spark.sql(f"SELECT CAST(NULL AS INT) AS {name}"))
    grid = axis(n_rows, "r").crossJoin(F.broadcast(axis(n_columns, "c"))).withColumn("g", F.when(F.col("r").isNull(), 2).otherwise(0) + F.when(F.col("c").isNull(), 1).otherwise(0))
    g, k = grid.alias("g"), cells.alias("k")
    same = F.col("g.r").eqNullSafe(F.col("k.r")) & F.col("g.c").eqNullSafe(F.col("k.c")) & (F.col("g.g") == F.col("k.g"))
    return g.join(k, same, "left").select("g.r", "g.c", F.coalesce("k.n", F.lit(0)).alias("n"))


def identities(df: DataFrame, channels: list[str]) -> DataFrame:
    """Greatest errors of the weights' sum and of the mixture, where each is defined."""
    omega = reduce(lambda a, b: a + b, [F.col(f"omega_{c}") for c in channels])
    want = (F.col("sigma_sum") > 1e-8).cast("double")
    mixed = F.when((F.col("sigma_lex") > 1e-8) | (F.col("sigma_struct") > 1e-8), F.abs(F.col("S_base") - (1 - F.col("w_c")) * F.col("s_lex") - F.col("w_c") * F.col("S_struct")))
    return df.agg(F.max(F.abs(omega - want)).alias("omega_error"), F.coalesce(F.max(mixed), F.lit(0.0)).alias("mixture_error"))


def confounders(df: DataFrame, tokens: Column) -> DataFrame:
    """Incorrect candidates that share a token with a correct target of their source."""
    rows = df.withColumn("__t", tokens)
    gold = rows.where("label = 1").groupBy("src").agg(F.array_distinct(F.flatten(F.collect_list("__t"))).alias("__g"))
    return rows.where("label = 0").join(gold, "src").where(F.arrays_overlap("__t", "__g")).drop("__t", "__g")


def rank_sum(df: DataFrame, value: str, group: str) -> DataFrame:
    """U of group 1 against group 0, its share of pairs, and the two-sided p-value by the normal approximation with ties."""
    ranked = average_rank_all(df.select(value, F.col(group).cast("int").alias("g")), value)
    ties = df.groupBy(value).agg(F.count(F.lit(1)).alias("t")).agg(F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    n = ranked.agg(F.sum("g").alias("n1"), F.sum(1 - F.col("g")).alias("n0"), F.sum(F.col("g") * F.col("rank")).alias("r")).crossJoin(F.broadcast(ties))
    u, both = F.col("r") - F.col("n1") * (F.col("n1") + 1) / 2, F.col("n1") * F.col("n0")
    total = F.col("n1") + F.col("n0")
    var = both / 12.0 * ((total + 1) - F.col("ties") / (total * (total - 1)))
    return n.select("n1", "n0", u.alias("u"), F.try_divide(u, both).alias("effect"), F.try_divide(u - both / 2.0, F.sqrt(var)).alias("z"))


def histogram_overlap(df: DataFrame, value: str, group: str, bins: int = 50) -> DataFrame:
    """Shared area of two groups' histograms over one range."""
    lim = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    b = F.least(F.lit(bins - 1), F.floor(F.coalesce(F.try_divide((F.col(value) - F.col("lo")) * bins, F.col("hi") - F.col("lo")), F.lit(0.0))))
    cell = df.crossJoin(F.broadcast(lim)).groupBy(b.alias("b")).agg(F.count_if(F.col(group) == 1).alias("x"), F.count_if(F.col(group) == 0).alias("y"))
    every = cell.agg(F.sum("x").alias("nx"), F.sum("y").alias("ny"))
    return cell.crossJoin(F.broadcast(every)).agg(F.sum(F.least(F.try_divide("x", "nx"), F.try_divide("y", "ny"))).alias("overlap"))


def bootstrap_spearman(df: DataFrame, keys: list[str], a: str, b: str, rounds: int = 200, seed: int = 42, max_rows: int = 100_000) -> DataFrame:
    """For each key (a channel, a bin table) the rank correlation with a percentile interval by resampling.

    A group is a bounded table of bins or sources; one over ``max_rows`` is an error.
    """

    def rho(x: np.ndarray, y: np.ndarray) -> float:
        p, q = pd.Series(x).rank().to_numpy(), pd.Series(y).rank().to_numpy()
        return float(np.corrcoef(p, q)[0, 1]) if p.std() > 0 and q.std() > 0 else float("nan")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > max_rows:
            raise ValueError("too many rows to resample")
        pdf = pdf.dropna(subset=[a, b]).sort_values([a, b])
        x, y, rng = pdf[a].to_numpy(), pdf[b].to_numpy(), np.random.default_rng(seed)
        got = [rho(x[i], y[i]) for i in (rng.integers(0, len(x), len(x)) for _ in range(rounds))] if len(x) else []
        got = [g for g in got if g == g]
        low, high = np.percentile(got, [2.5, 97.5]) if got else (float("nan"), float("nan"))
        return pd.DataFrame([(*key, len(x), rho(x, y) if len(x) else float("nan"), low, high)], columns=[*keys, "n", "rho", "low", "high"])

    types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.groupBy(*keys).applyInPandas(run, f"{types}, n long, rho double, low double, high double")


def ecdf(df: DataFrame, value: str) -> DataFrame:
    """Share of rows at or under each value."""
    counts = average_rank_all(df.select(value).where(F.col(value).isNotNull()), value)
    n = counts.agg(F.count(F.lit(1)).alias("n"))
    ties = counts.groupBy(value).agg(F.count(F.lit(1)).alias("t"), F.max("rank").alias("r"))
    return ties.crossJoin(F.broadcast(n)).select(value, ((F.col("r") + (F.col("t") - 1) / 2.0) / F.col("n")).alias("ecdf"))


def verdict(primary_high: Column, adverse: Column) -> Column:
    """Supported only if the primary interval lies under 0 and no secondary result is adverse."""
    return F.when(primary_high.isNull(), "undefined").when((primary_high < 0) & ~adverse, "supported").otherwise("not_supported")


def failure_taxonomy(sources: DataFrame, k: int = 5) -> DataFrame:
    """The first category that fits each source (gold_rank, lead, evidence, llm_used, top1_correct); absent gold is its own."""
    med = quantiles(sources, "evidence", [0.5]).select(F.col("q")[0].alias("__m"))
    g = F.col("gold_rank")
    c = F.when(F.col("top1_correct"), "correct").when(g < 0, "gold_absent").when(g > k, "gold_below_top_k").when(F.col("llm_used"), "llm_overturned").when(F.col("lead") < 0.02, "near_tie").when(F.col("evidence") < F.col("__m"), "thin_evidence").otherwise("misranked")
    return sources.crossJoin(F.broadcast(med)).withColumn("category", c).drop("__m")


def assertion(df: DataFrame, area: str, check: str, observed: Column, expected: Column) -> DataFrame:
    """Q*: one row (area, check, passed, observed, expected) of an aggregate over a table."""
    return df.agg(observed.cast("double").alias("observed"), expected.cast("double").alias("expected")).select(
        F.lit(area).alias("area"), F.lit(check).alias("check"), (F.abs(F.col("observed") - F.col("expected")) <= 1e-8).alias("passed"), "observed", "expected"
    )


def ledger(*rows: DataFrame) -> DataFrame:
    """All assertions in one table."""
    return reduce(DataFrame.unionByName, rows)


def constant_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Q10: which columns hold one value at most."""
    one = df.agg(*[F.coalesce(F.min(c).eqNullSafe(F.max(c)), F.lit(True)).alias(c) for c in columns])
    return one.unpivot([], columns, "column", "constant")


def dump_profile(df: DataFrame, channels: list[str]) -> DataFrame:
    """Q3: a dump in one pass: rows, blank ids, sources, sources with a correct row, active rows by channel."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("src").isNull() | F.col("tgt").isNull()).alias("blank_ids"),
        F.count_distinct("src").alias("sources"),
        F.count_distinct(F.when(F.col("label") == 1, F.col("src"))).alias("sources_correct"),
        *[F.count_if(F.col(f"sigma_{c}") > 1e-6).alias(f"active_{c}") for c in channels],
    )


def config_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """Q9: paths whose values differ between two flattened configurations (path, value), added and removed ones too."""
    return a.select("path", F.col("value").alias("old")).join(b.select("path", F.col("value").alias("new")), "path", "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))


def restricted_recall(refs: DataFrame, preds: DataFrame, abstained: DataFrame) -> DataFrame:
    """Recall over the references whose source is not abstained, and the share of sources that are."""
    r = refs.select("src", "tgt").distinct().join(abstained.select("src").distinct().withColumn("a", F.lit(1)), "src", "left").join(preds.select("src", "tgt").distinct().withColumn("p", F.lit(1)), ["src", "tgt"], "left")
    return r.agg(F.coalesce(F.try_divide(F.count_if(F.col("a").isNull() & F.col("p").isNotNull()), F.count_if(F.col("a").isNull())), F.lit(0.0)).alias("recall_committed"), F.coalesce(F.try_divide(F.count_distinct(F.when(F.col("a").isNotNull(), F.col("src"))), F.count_distinct("src")), F.lit(0.0)).alias("abstention_rate"))
