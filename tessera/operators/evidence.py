"""Evidence of pairs: item matrices, packets of text, attributions, metrics of contexts and trial tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.scalars import clip01

KEY = ["src", "tgt"]


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, 0 where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0))


def item_matrix(pairs: DataFrame, src_items: DataFrame, tgt_items: DataFrame) -> DataFrame:
    """For each pair the support of its source's items by its target's: half relation, half neighbour cosine.

    Items are (iri, item, rel_vec, nb_vec), bounded for each entity by the bundles' caps.
    """
    s = src_items.select(F.col("iri").alias("src"), F.col("item").alias("i"), F.col("rel_vec").alias("ra"), F.col("nb_vec").alias("na"))
    t = tgt_items.select(F.col("iri").alias("tgt"), F.col("item").alias("j"), F.col("rel_vec").alias("rb"), F.col("nb_vec").alias("nb"))
    return pairs.select(*KEY).join(s, "src").join(t, "tgt").select(*KEY, "i", "j", clip01((cosine(F.col("ra"), F.col("rb")) + cosine(F.col("na"), F.col("nb"))) / 2).alias("score"))


def best_support(cells: DataFrame) -> DataFrame:
    """Each item's best counterpart, the first of equal ones."""
    return cells.groupBy(*KEY, "i").agg(F.max_by(F.struct("j", "score"), F.struct("score", F.hash("j"))).alias("b")).select(*KEY, "i", "b.j", "b.score")


def join_context(items: DataFrame, by: list[str], text: str = "text", delimiter: str = " . ") -> DataFrame:
    """F16: the texts of a group in order as one."""
    return items.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(text).alias("t")))), lambda x: x["t"]), delimiter).alias("context"))


def evidence_packet(items: DataFrame, hierarchy: int = 3, other: int = 4) -> DataFrame:
    """A pair's evidence as text: of each side the first hierarchy sentences and the first others."""
    kind = F.when(F.col("channel") == "hierarchy", "hierarchy").otherwise("other")
    r = F.row_number().over(Window.partitionBy(*KEY, "side", kind).orderBy("pos"))
    kept = items.withColumn("__r", r).where(F.col("__r") <= F.when(kind == "hierarchy", hierarchy).otherwise(other))
    line = F.struct("side", "channel", "pos", F.concat(F.col("side"), F.lit(" "), F.col("channel"), F.lit(": "), F.col("text")).alias("t"))
    return kept.groupBy(*KEY).agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), "\n").alias("packet"))


def label_pair(cells: DataFrame, mode: str = "max") -> DataFrame:
    """the pair of labels that speaks: the best cell, or the one nearest the mean."""
    if mode == "max":
        order = [F.desc("score"), "i", "j"]
        return cells.withColumn("__r", F.row_number().over(Window.partitionBy(*KEY).orderBy(*order))).where("__r = 1").drop("__r")
    mean = F.avg("score").over(Window.partitionBy(*KEY))
    near = cells.withColumn("__d", F.abs(F.col("score") - mean))
    return near.withColumn("__r", F.row_number().over(Window.partitionBy(*KEY).orderBy("__d", "i", "j"))).where("__r = 1").drop("__r", "__d")


def leave_one_out(items: DataFrame) -> DataFrame:
    """C17: shares of what a pair's score loses without each item (``full`` and ``without``), losses only."""
    loss = F.greatest(F.lit(0.0), F.col("full") - F.col("without"))
    total = F.sum(loss).over(Window.partitionBy(*KEY))
    return items.withColumn("attribution", F.coalesce(F.try_divide(loss, total), F.lit(0.0)))


def context_metrics(contexts: DataFrame, column: str = "context") -> DataFrame:
    """For each entity's array of sentences their number, characters, words, and whether there are none."""
    text = F.array_join(F.coalesce(column, F.array().cast("array<string>")), " ")
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return contexts.withColumn("n_triples", F.greatest(F.lit(0), F.size(column))).withColumn("chars", F.length(text)).withColumn("words", words).withColumn("tokens", F.ceil(words * 1.3)).withColumn("empty", F.greatest(F.lit(0), F.size(column)) == 0)


def label_metrics(entities: DataFrame, column: str = "labels") -> DataFrame:
    """For each entity's labels their number, characters, words, most and mean words."""
    counts = F.transform(column, lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w != "")))
    total = F.aggregate(counts, F.lit(0), lambda a, x: a + x)
    return entities.withColumn("n_labels", F.size(column)).withColumn("chars", F.aggregate(F.transform(column, F.length), F.lit(0), lambda a, x: a + x)).withColumn("words", total).withColumn("max_words", F.coalesce(F.array_max(counts), F.lit(0))).withColumn("avg_words", F.coalesce(F.try_divide(total, F.size(column)), F.lit(0.0)))


def pool_metrics(items: DataFrame) -> DataFrame:
    """For each entity items by channel, distinct relations, mean and greatest information."""
    n = lambda c: F.count_if(F.col("channel") == c)
    return items.groupBy("iri").agg(n("hierarchy").alias("n_hier"), n("object").alias("n_object"), n("attribute").alias("n_attr"), F.count_distinct("rel").alias("n_rel"), F.avg("ic").alias("ic_mean"), F.max("ic").alias("ic_max"))


def family_of(relations: DataFrame, families: DataFrame) -> DataFrame:
    """The first family (by ordinal) whose alias is a relation's IRI, or whose seed its label; null for none.

    ``families``: (family, ordinal, alias, seed), a configuration table.
    """
    by_alias = relations.join(families.select("family", "ordinal", F.lower("alias").alias("__k")), F.lower("rel") == F.col("__k"))
    by_seed = relations.join(families.select("family", "ordinal", F.lower("seed").alias("__k")), F.lower("label") == F.col("__k"))
    hit = by_alias.select("rel", "family", "ordinal").unionByName(by_seed.select("rel", "family", "ordinal")).groupBy("rel").agg(F.min_by("family", "ordinal").alias("family"))
    return relations.select("rel").distinct().join(hit, "rel", "left")


def grid_trials(df_of_values: dict[str, DataFrame]) -> DataFrame:
    """Every combination of the parameters' values (configuration tables of one column each)."""
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), [d.select(F.col(d.columns[0]).alias(k)) for k, d in df_of_values.items()])


def widen_runs(metrics: DataFrame, names: list[str]) -> DataFrame:
    """One row for each run with a column for each of the named metrics."""
    return metrics.groupBy("path").pivot("metric", names).agg(F.first("value"))


def against_baseline(arms: DataFrame, baseline: str, metric: str = "mrr") -> DataFrame:
    """Each arm's metric less the baseline arm's."""
    base = arms.where(F.col("arm") == baseline).agg(F.max(metric).alias("__b"))
    return arms.crossJoin(F.broadcast(base)).withColumn("delta", F.col(metric) - F.col("__b")).drop("__b")
