"""Study tables: panels of ranked mappings, shortlists, explanation graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.scalars import bridge_strength, lead_class, strength_class


def attach_rows(ranking: DataFrame, rows: DataFrame, values: list[str]) -> DataFrame:
    """For each source its top row and its gold row from ``rows`` (src, tgt, values), and their differences; missing stays null."""
    out = ranking
    for role in ("top1", "gold"):
        out = out.join(rows.select("src", F.col("tgt").alias(f"{role}_tgt"), *[F.col(v).alias(f"{role}_{v}") for v in values]), ["src", f"{role}_tgt"], "left")
    for v in values:
        out = out.withColumn(f"delta_{v}", F.col(f"top1_{v}") - F.col(f"gold_{v}"))
    return out


def prefer(records: DataFrame, summary: DataFrame, values: list[str]) -> DataFrame:
    """records' values, the summary's where a record has none."""
    s = summary.select("src", "tgt", *[F.col(v).alias(f"__{v}") for v in values])
    out = records.join(s, ["src", "tgt"], "left")
    for v in values:
        out = out.withColumn(v, F.coalesce(v, f"__{v}")).drop(f"__{v}")
    return out


def merge_review(sheet: DataFrame, edits: DataFrame, columns: list[str]) -> DataFrame:
    """A sheet with earlier edits by (src, gold_rank); empty where there are none."""
    e = edits.select("src", "gold_rank", *[F.col(c).alias(f"__{c}") for c in columns]).dropDuplicates(["src", "gold_rank"])
    out = sheet.join(e, ["src", "gold_rank"], "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"__{c}", F.lit(""))).drop(f"__{c}")
    return out


def eligible(panels: DataFrame, k: int) -> DataFrame:
    """Complete panels whose gold stands among the first ``k``."""
    return panels.where(F.col("complete") & F.col("gold_rank").between(1, k))


def panel_order(panels: DataFrame, order: list[Column]) -> DataFrame:
    """Order of the panels within each gold rank."""
    return panels.withColumn("panel_rank", F.row_number().over(Window.partitionBy("gold_rank").orderBy(*order, "src")))


def shortlist(panels: DataFrame, per_rank: int, size: int) -> DataFrame:
    """The first ``size`` of each gold rank, the first ``per_rank`` of them recommended."""
    return panels.where(F.col("panel_rank") <= size).withColumn("recommended", F.col("panel_rank") <= per_rank)


def final_selection(short: DataFrame, per_rank: int, ranks: int) -> DataFrame:
    """The recommended; an error unless every gold rank has ``per_rank``."""
    chosen = short.where("recommended")
    n = F.count(F.lit(1)).over(Window.partitionBy("gold_rank"))
    return chosen.withColumn("__n", n).withColumn("gold_rank", F.when(F.col("__n") == per_rank, F.col("gold_rank")).otherwise(F.raise_error(F.lit("a gold rank has too few panels")).cast("int"))).drop("__n")


def leads(ranked: DataFrame) -> DataFrame:
    """Lead of each candidate over the next, and its class."""
    nxt = F.lead("score").over(Window.partitionBy("src").orderBy("rank"))
    return ranked.withColumn("lead", F.col("score") - nxt).withColumn("lead_class", lead_class(F.col("lead")))


def bridge_edges(items: DataFrame) -> DataFrame:
    """From evidence (a, b, kind, importance, mass) the strongest edge of each pair and kind, with its class."""
    s = items.withColumn("strength", bridge_strength(F.col("importance"), F.col("mass")))
    return s.groupBy("a", "b", "kind").agg(F.max("strength").alias("strength"), F.count(F.lit(1)).alias("n_items")).withColumn("strength_class", strength_class(F.col("strength")))


def study_graph(edges: DataFrame) -> DataFrame:
    """Nodes and edges of each source as nested arrays."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_set(F.struct("a", "b", "kind", "strength"))).alias("edges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("a", "b"))))).alias("nodes"))


def source_sample(rows: DataFrame, n: int) -> DataFrame:
    """All rows of the first ``n`` sources in order."""
    return rows.join(F.broadcast(rows.select("src").distinct().orderBy("src").limit(n)), "src", "left_semi") if n <= 100_000 else rows.join(rows.select("src").distinct().orderBy("src").limit(n), "src", "left_semi")


def seeded_sample(rows: DataFrame, key: list[str], ratio: float, seed: int = 42) -> DataFrame:
    """floor(n * ratio) rows, one at least, those whose keys hash lowest: the same rows in any order or partitioning.

    Counts by 4096 ranges of the hash tell which ranges go in whole; only the range that the sample ends in is ordered.
    """
    part = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(4096))
    sizes = sorted(tuple(r) for r in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    wanted, first = max(1, int(sum(n for _, n in sizes) * ratio)), 0
    while sizes and first < len(sizes) - 1 and wanted >= sizes[first][1]:
        wanted -= sizes[first][1]
        first += 1
    if not sizes:
        return rows
    order = F.row_number().over(Window.orderBy(F.xxhash64(*key, F.lit(seed + 1)), *key))
    last = rows.where(part == sizes[first][0]).withColumn("__r", order).where(F.col("__r") <= wanted).drop("__r")
    return rows.where(part < sizes[first][0]).unionByName(last)


def ranking_check(ranking: DataFrame, reference: DataFrame) -> DataFrame:
    """Anchors of a ranking that differ from the reference's, or rank a candidate that it lacks."""
    r = reference.select("src", F.col("cands").alias("allowed"))
    bad = ranking.join(r, "src", "left").where(F.col("allowed").isNull() | (F.size(F.array_except("cands", "allowed")) > 0)).select("src", F.lit("not_allowed").alias("fault"))
    return bad.unionByName(reference.join(ranking.select("src"), "src", "left_anti").select("src", F.lit("missing").alias("fault")))
