"""Sinks: alignments, rankings, dumps, shards, metric tables, plot data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Columns of a channel dump, in order.
DUMP = [
    "src", "tgt", "is_correct",
    "s_lex", "s_hier", "s_sim", "s_diff", "s_attr",
    "q_lex", "q_hier", "q_sim", "q_diff", "q_attr",
    "sigma_lex", "sigma_hier", "sigma_sim", "sigma_diff", "sigma_attr", "sigma_struct",
    "omega_hier", "omega_sim", "omega_diff", "omega_attr",
    "w_c", "S_struct", "Q_struct", "S_lctx", "U", "p_llm", "llm_invoked", "llm_gated", "S_pair", "S_final", "src_label_text", "tgt_label_text",
]


def alignment(df: DataFrame) -> DataFrame:
    """K1: SrcEntity, TgtEntity, Score."""
    return df.select(F.col("src").alias("SrcEntity"), F.col("tgt").alias("TgtEntity"), F.col("score").alias("Score"))


def local_ranking(df: DataFrame) -> DataFrame:
    """K2: one row for each source with its candidates, best first, as a JSON list of [name, score]."""
    items = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("tgt").cast("string").alias("t"))))
    pairs = F.transform(items, lambda x: F.concat(F.lit("["), F.to_json(F.struct(x["t"].alias("t"))).substr(F.lit(6), F.length(F.to_json(F.struct(x["t"].alias("t")))) - 6), F.lit(", "), (-x["s"]).cast("string"), F.lit("]")))
    return df.groupBy("src", "gold").agg(F.concat(F.lit("["), F.array_join(pairs, ", "), F.lit("]")).alias("cands"))


def dump(df: DataFrame) -> DataFrame:
    """K5: the columns of a channel dump; a missing one is an error, is_correct is 0 or 1."""
    missing = [c for c in DUMP if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select([F.when(F.col(c).cast("double") > 0, 1).otherwise(0).alias(c) if c == "is_correct" else c for c in DUMP])


def summary(records: DataFrame, channels: list[str]) -> DataFrame:
    """K4: nested records as a flat table of numbers; no arbitration, no importance of it."""
    out = records.select("src", "tgt", *[F.col(f"confidences.{c}").alias(f"s_{c}") for c in channels], *[F.col(f"weights.{c}").alias(f"w_{c}") for c in channels], F.col("llm_used"), F.col("importances.llm").alias("I_llm"))
    return out.withColumn("I_llm", F.when(F.col("llm_used"), F.col("I_llm")).otherwise(0.0))


def overlay(records: DataFrame, late: DataFrame, values: list[str]) -> DataFrame:
    """K8: records with later values in place of their own where there are any."""
    o = late.select("src", "tgt", *[F.col(v).alias(f"__{v}") for v in values])
    out = records.join(o, ["src", "tgt"], "left")
    for v in values:
        out = out.withColumn(v, F.coalesce(f"__{v}", v)).drop(f"__{v}")
    return out


def write_table(df: DataFrame, path: str) -> None:
    """A delimited file set with a header, tabs for .tsv."""
    df.write.mode("overwrite").option("header", True).option("sep", "\t" if path.endswith(".tsv") else ",").csv(path)


def write_shards(df: DataFrame, path: str, rows: int = 50_000, mode: str = "append") -> None:
    """K6/K7: JSON lines in shards of bounded length; the writer's commit is the manifest."""
    df.write.mode(mode).option("maxRecordsPerFile", rows).json(path)


def metrics_long(df: DataFrame) -> DataFrame:
    """One row of metrics as (Metric, Value)."""
    return df.select([F.col(c).cast("double").alias(c) for c in df.columns]).unpivot([], df.columns, "Metric", "Value")


def absent_gold(refs: DataFrame, cands: DataFrame) -> DataFrame:
    """References that no candidate list holds."""
    return refs.select("src", "tgt").distinct().join(cands.select("src", "tgt").distinct(), ["src", "tgt"], "left_anti")


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Plot data: rows in each of ``bins`` equal bins of [low, high]; a value between two bins is in the upper one, ``high`` in the last; outside ones in bin 0 and bins + 1."""
    place = F.expr(f"CASE WHEN {value} = {high}D THEN {bins}L ELSE width_bucket({value}, {low}D, {high}D, {bins}) END")
    return df.where(F.col(value).isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def numbered(df: DataFrame, by: str) -> DataFrame:
    """Positions of rows within a group, for orders that a file had."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(by).orderBy("tgt")))


def write_stage(df: DataFrame, path: str, kind: str, fingerprint: str) -> None:
    """K9: a finished stage as a table, and beside it what it is; a stage without that table is none, so a write that broke off is not resumed."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}/rows")
    spark.createDataFrame([(kind, fingerprint)], "kind string, fingerprint string").write.mode("overwrite").parquet(f"{path}/meta")


def read_stage(spark: SparkSession, path: str, kind: str, fingerprint: str) -> DataFrame | None:
    """Q14: the rows of a stage of this kind and fingerprint; None if there is none."""
    meta = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/meta/_SUCCESS")
    if not meta.getFileSystem(spark._jsc.hadoopConfiguration()).exists(meta):
        return None
    same = spark.read.parquet(f"{path}/meta").where((F.col("kind") == kind) & (F.col("fingerprint") == fingerprint)).take(1)
    return spark.read.parquet(f"{path}/rows") if same else None
