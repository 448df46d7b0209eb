"""Data-quality checks as tables of (area, check, passed, observed, expected): one aggregate a row, all in one union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.analytics import ledger


def holds(df: DataFrame, area: str, name: str, bad: Column) -> DataFrame:
    """One row: how many rows are bad, which should be none."""
    return df.agg(F.count_if(bad).cast("double").alias("observed")).select(F.lit(area).alias("area"), F.lit(name).alias("check"), (F.col("observed") == 0).alias("passed"), "observed", F.lit(0.0).alias("expected"))


def equal(a: DataFrame, b: DataFrame, area: str, name: str, tolerance: float = 1e-8) -> DataFrame:
    """One row: whether two one-row tables of one number agree."""
    x, y = a.select(F.col(a.columns[0]).cast("double").alias("observed")), b.select(F.col(b.columns[0]).cast("double").alias("expected"))
    return x.crossJoin(F.broadcast(y)).select(F.lit(area).alias("area"), F.lit(name).alias("check"), (F.abs(F.col("observed") - F.col("expected")) <= tolerance).alias("passed"), "observed", "expected")


def raw_pairs(scored: DataFrame, removed: DataFrame, raw: DataFrame) -> DataFrame:
    """Q1: scored rows and rows that exact matching removed make all raw pairs."""
    n = lambda d: d.agg(F.count(F.lit(1)).alias("n"))
    both = n(scored).crossJoin(F.broadcast(n(removed).withColumnRenamed("n", "m"))).select((F.col("n") + F.col("m")).alias("n"))
    return equal(both, n(raw), "pairs", "scored and removed make raw")


def logged_rows(lines: DataFrame, pattern: str, scored: DataFrame) -> DataFrame:
    """Q1: the number in the last log line that the pattern matches equals the scored rows."""
    hit = lines.where(F.col("value").rlike(pattern)).agg(F.max_by(F.regexp_extract("value", pattern, 1), "line_no").cast("double").alias("n"))
    return equal(hit, scored.agg(F.count(F.lit(1)).alias("n")), "pairs", "scored as logged")


def subset(cands: DataFrame, refs: DataFrame) -> DataFrame:
    """Q2: candidate lists and references have the same anchors as often, the same sources, and every reference stands in its list."""
    anchors = lambda d: d.groupBy("src").agg(F.count_distinct("gold").alias("n"))
    a, b = anchors(cands), anchors(refs.withColumnRenamed("tgt", "gold"))
    differ = a.exceptAll(b).unionByName(b.exceptAll(a))
    listed = refs.join(cands.select("src", "tgt").distinct(), ["src", "tgt"], "left_anti")
    return ledger(holds(differ, "subset", "anchors agree", F.lit(True)), holds(listed, "subset", "references are listed", F.lit(True)), holds(cands, "subset", "ids are filled", F.col("src").isNull() | F.col("tgt").isNull()))


def reliability(rows: DataFrame, channels: int) -> DataFrame:
    """Q4: a summary with one row a channel: counts add up, shares agree, intervals are in order and within -1 and 1, and are there exactly where a correlation is."""
    out = rows
    low, high, rho = F.col("low"), F.col("high"), F.col("rho")
    return ledger(
        equal(out.agg(F.count_distinct("channel").alias("n")), out.agg(F.count(F.lit(1)).alias("n")), "reliability", "a row for each channel"),
        holds(out, "reliability", "active and inactive make all", F.col("active") + F.col("inactive") != F.col("n")),
        holds(out, "reliability", "shares agree", F.abs(F.col("share") - F.col("active") / F.col("n")) > 1e-8),
        holds(out, "reliability", "intervals are in order", (low > high) | (low < -1) | (high > 1)),
        holds(out, "reliability", "an interval where a correlation is", rho.isNull() != (low.isNull() | high.isNull())),
        equal(out.agg(F.count(F.lit(1)).alias("n")), out.agg(F.max(F.lit(float(channels))).alias("n")), "reliability", "all channels"),
    )


def bins(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """Q5: bin tables (table, bin, n, rate, edges): 1 to 10 bins numbered from 1, edges one more and rising, no empty bin, counts that make the total, rates within 0 and 1."""
    by = rows.groupBy("table").agg(F.count(F.lit(1)).alias("k"), F.min("bin").alias("first"), F.max("bin").alias("last"), F.count_distinct("bin").alias("own"), F.sum("n").alias("total"), F.min(F.size("edges")).alias("e"), F.max(F.size("edges")).alias("f"))
    rising = F.forall(F.zip_with(F.slice("edges", 1, F.size("edges") - 1), F.slice("edges", 2, F.size("edges") - 1), lambda x, y: x < y), lambda x: x)
    return ledger(
        holds(by, "bins", "one to ten", (F.col("k") < 1) | (F.col("k") > 10)),
        holds(by, "bins", "numbered from one", (F.col("first") != 1) | (F.col("last") != F.col("k")) | (F.col("own") != F.col("k"))),
        holds(by, "bins", "one edge more", (F.col("e") != F.col("k") + 1) | (F.col("f") != F.col("k") + 1)),
        holds(rows, "bins", "edges rise", ~rising),
        holds(rows, "bins", "none is empty", F.col("n") <= 0),
        holds(rows, "bins", "rates within 0 and 1", (F.col("rate") < 0) | (F.col("rate") > 1)),
        holds(by.join(totals, "table"), "bins", "counts make the total", F.col("total") != F.col("rows")),
    )


def picks(sources: DataFrame, eligible: DataFrame, excluded: DataFrame, every: DataFrame) -> DataFrame:
    """Q6: source rows are the eligible ones, these and the excluded are all, and a tie at the top is no correct pick."""
    n = lambda d: d.agg(F.count_distinct("src").alias("n"))
    both = n(eligible).crossJoin(F.broadcast(n(excluded).withColumnRenamed("n", "m"))).select((F.col("n") + F.col("m")).alias("n"))
    return ledger(equal(n(sources), n(eligible), "picks", "rows are eligible sources"), equal(both, n(every), "picks", "eligible and excluded make all"), holds(sources, "picks", "ties are wrong", (F.col("tie_size") > 1) & (F.col("picked_correct") != 0)))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """Q7: two tables' (name, count, rows, share): counts within rows, shares as counts over rows, and the same in both."""
    both = a.join(b.select("name", F.col("count").alias("count_b"), F.col("share").alias("share_b")), "name", "full_outer")
    return ledger(
        holds(a, "pivot", "counts within rows", F.col("count") > F.col("rows")),
        holds(a, "pivot", "shares agree", F.abs(F.col("share") - F.col("count") / F.col("rows")) > 1e-8),
        holds(both, "pivot", "tables agree", ~F.col("count").eqNullSafe(F.col("count_b")) | (F.abs(F.col("share") - F.col("share_b")) > 1e-10)),
    )


def ablations(muted: DataFrame, uniform: DataFrame, lex_only: DataFrame, channels: list[str], channel: str) -> DataFrame:
    """Q8: a muted channel has no weight but keeps its score and quality; uniform weights are equal and sum to 1 with both sides at one half; labels alone leave the structure without weight."""
    total = reduce(lambda x, y: x + y, [F.col(f"omega_{c}") for c in channels])
    return ledger(
        holds(muted, "ablation", "muted has no weight", F.abs(F.col(f"omega_{channel}")) > 1e-12),
        holds(muted, "ablation", "muted keeps its evidence", F.col(f"s_{channel}").isNull() | F.col(f"q_{channel}").isNull()),
        holds(uniform, "ablation", "uniform is equal", reduce(lambda x, y: x | y, [F.abs(F.col(f"omega_{c}") - 1.0 / len(channels)) > 1e-9 for c in channels])),
        holds(uniform, "ablation", "uniform sums to one", F.abs(total - 1) > 1e-9),
        holds(uniform, "ablation", "uniform halves the sides", (F.abs(F.col("w_c") - 0.5) > 1e-12) | (F.abs(F.col("S_base") - (F.col("s_lex") + F.col("S_struct")) / 2) > 1e-9)),
        holds(lex_only, "ablation", "labels alone", (F.abs(F.col("sigma_struct")) > 1e-12) | ((F.col("sigma_lex") > 1e-8) & (F.abs(F.col("S_base") - F.col("s_lex")) > 1e-9))),
    )


def same_schema(a: DataFrame, b: DataFrame) -> DataFrame:
    """Q11: (column, in_a, in_b, agree): columns of two tables in either, and whether name, type and place are the same."""
    spark = a.sparkSession
    rows = {}
    for side, d in enumerate((a, b)):
        for i, (name, kind) in enumerate(d.dtypes):
            rows.setdefault(name, [None, None])[side] = f"{i}:{kind}"
    return spark.createDataFrame([(n, x is not None, y is not None, x == y) for n, (x, y) in rows.items()], "column string, in_a boolean, in_b boolean, agree boolean")


def finite(df: DataFrame, columns: list[str]) -> DataFrame:
    """Q11: for each column its rows, nulls and values that are no finite numbers."""
    parts = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns]
    rows = df.select(F.inline(F.array(*parts)))
    odd = F.isnan("v") | (F.abs(F.col("v")) == float("inf"))
    return rows.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v").isNull()).alias("nulls"), F.count_if(odd).alias("odd"))


def contract(df: DataFrame, area: str, rows: int | None = None, unique: list[str] | None = None, finite_columns: list[str] | None = None) -> DataFrame:
    """A table's contract: its number of rows, a unique key, and finite columns."""
    parts = []
    if rows is not None:
        parts.append(equal(df.agg(F.count(F.lit(1)).alias("n")), df.agg(F.max(F.lit(float(rows))).alias("n")), area, "number of rows"))
    if unique:
        parts.append(holds(df.groupBy(*unique).agg(F.count(F.lit(1)).alias("n")), area, "key is unique", F.col("n") > 1))
    for c in finite_columns or []:
        parts.append(holds(df, area, f"{c} is finite", F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))))
    return ledger(*parts)


def fingerprint(df: DataFrame, columns: list[str]) -> DataFrame:
    """A table's fingerprint that no order of its rows changes: the number of rows and the sums of two hashes of each."""
    h = lambda seed: F.sum(F.xxhash64(*columns, F.lit(seed)).cast("decimal(20,0)")).cast("string")
    return df.agg(F.count(F.lit(1)).alias("n"), F.sha1(F.concat_ws(":", F.count(F.lit(1)).cast("string"), h(1), h(2))).alias("fingerprint"))


def dense(df: DataFrame, by: str) -> DataFrame:
    """Rows numbered in each group from 1."""
    return df.withColumn("number", F.row_number().over(Window.partitionBy(by).orderBy("tgt")))
