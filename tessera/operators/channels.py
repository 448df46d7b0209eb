"""Evidence channels end to end: from pairs and their ends' items to each channel's score, quality and selected evidence.

Items are (iri, pos, rel, ic, spec, weight, vec, rel_vec), bounded for each entity by the bundles' caps, so a
pair's matrix is bounded too. Each channel is joins on the pair's ends and grouped aggregates; a pair
without the evidence that a channel needs has the neutral score with quality 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.scalars import clip01, sim01
from tessera.operators.evidence import KEY, cosine
from tessera.operators.fusion import TAU, diverse_top

#: Items of a side that a channel selects at most.
HIERARCHY, OBJECTS, DIFFERENCES, ATTRIBUTES = 6, 48, 24, 12


def _side(items: DataFrame, key: str, mark: str) -> DataFrame:
    return items.select(F.col("iri").alias(key), *[F.col(c).alias(f"{c}_{mark}") for c in items.columns if c != "iri"])


def matrix(pairs: DataFrame, src_items: DataFrame, tgt_items: DataFrame, relations: bool = False) -> DataFrame:
    """Cells (src, tgt, i, j, score) of every source item by every target item of a pair: the cosine of their vectors from 0 to 1, or half of it and half of their relations'."""
    cells = pairs.select(*KEY).distinct().join(_side(src_items, "src", "s"), "src").join(_side(tgt_items, "tgt", "t"), "tgt")
    score = sim01(cosine(F.col("vec_s"), F.col("vec_t")))
    if relations:
        score = clip01((sim01(cosine(F.col("rel_vec_s"), F.col("rel_vec_t"))) + score) / 2)
    return cells.select(*KEY, F.col("pos_s").alias("i"), F.col("pos_t").alias("j"), score.alias("score"))


def best_of(pairs: DataFrame, items: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """A side's items of each pair with their best cell, 0 where the other side has none."""
    at = "i" if key == "src" else "j"
    top = cells.groupBy(*KEY, F.col(at).alias("pos")).agg(F.max("score").alias("best"))
    return pairs.select(*KEY).distinct().join(items.withColumnRenamed("iri", key), key).join(top, [*KEY, "pos"], "left").na.fill(0.0, ["best"])


def _mean_vec(dims: int, name: str = "vec") -> Column:
    return F.array(*[F.avg(F.col(name)[d]) for d in range(dims)])


def _reduced(pairs: DataFrame, src_items: DataFrame, tgt_items: DataFrame, cells: DataFrame, tie: str, cap: int, limit: int, dims: int) -> DataFrame:
    """Both sides' selected items, the best cells among them, and the cosine of their mean vectors (an encoder of joined texts may replace ``emb``)."""
    sides = {}
    for key, items in (("src", src_items), ("tgt", tgt_items)):
        sides[key] = diverse_top(best_of(pairs, items, cells, key), KEY, "rel", "best", tie, cap, limit)
    kept = cells.join(sides["src"].select(*KEY, F.col("pos").alias("i")), [*KEY, "i"], "left_semi").join(sides["tgt"].select(*KEY, F.col("pos").alias("j")), [*KEY, "j"], "left_semi")
    rows = kept.groupBy(*KEY, "i").agg(F.max("score").alias("m")).groupBy(*KEY).agg(F.avg("m").alias("row_best"), F.sum("m").alias("row_sum"), F.sum(F.col("m") * F.col("m")).alias("row_sq"), F.count(F.lit(1)).alias("n_src"))
    cols = kept.groupBy(*KEY, "j").agg(F.max("score").alias("m")).groupBy(*KEY).agg(F.avg("m").alias("col_best"), F.sum("m").alias("col_sum"), F.sum(F.col("m") * F.col("m")).alias("col_sq"), F.count(F.lit(1)).alias("n_tgt"))
    texts = sides["src"].groupBy(*KEY).agg(_mean_vec(dims).alias("a"), F.sum("spec").alias("spec_s")).join(sides["tgt"].groupBy(*KEY).agg(_mean_vec(dims).alias("b"), F.sum("spec").alias("spec_t")), KEY)
    out = rows.join(cols, KEY).join(texts, KEY)
    n = F.col("n_src") + F.col("n_tgt")
    mean = (F.col("row_sum") + F.col("col_sum")) / n
    std = F.sqrt(F.greatest(F.lit(0.0), (F.col("row_sq") + F.col("col_sq")) / n - mean * mean))
    return out.select(*KEY, "n_src", "n_tgt", ((F.col("row_best") + F.col("col_best")) / 2).alias("strength"), sim01(cosine(F.col("a"), F.col("b"))).alias("emb"), ((F.col("spec_s") + F.col("spec_t")) / n).alias("inf"), F.when(n < 2, 0.0).otherwise(std).alias("std"))


def _with_neutral(pairs: DataFrame, found: DataFrame, name: str) -> DataFrame:
    out = pairs.select(*KEY).distinct().join(found, KEY, "left")
    return out.select(*KEY, F.coalesce(f"s_{name}", F.lit(TAU)).alias(f"s_{name}"), F.coalesce(f"q_{name}", F.lit(0.0)).alias(f"q_{name}"))


def label(pairs: DataFrame, src_labels: DataFrame, tgt_labels: DataFrame, mode: str = "max") -> DataFrame:
    """Label channel over (iri, pos, vec): the greatest or the mean cell, and the lead of the best cell over the second as quality; one cell has quality 1."""
    cells = matrix(pairs, src_labels, tgt_labels)
    r = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("score"), "i", "j"))
    z1, z2 = F.max(F.when(F.col("r") == 1, F.col("score"))), F.max(F.when(F.col("r") == 2, F.col("score")))
    score = z1 if mode == "max" else F.avg("score")
    quality = F.when(z2.isNull(), 1.0).otherwise(clip01((z1 - z2) / F.greatest(F.lit(1e-8), 1 - z2)))
    return _with_neutral(pairs, cells.withColumn("r", r).groupBy(*KEY).agg(score.alias("s_lex"), quality.alias("q_lex")), "lex")


def hierarchy(pairs: DataFrame, src_items: DataFrame, tgt_items: DataFrame, family: str, dims: int, limit: int = HIERARCHY) -> DataFrame:
    """One family's channel over items of that family: best supported tails of a side first, then the more specific."""
    one = F.lit(family)
    s, t = src_items.withColumn("rel", one), tgt_items.withColumn("rel", one)
    red = _reduced(pairs, s, t, matrix(pairs, s, t), "spec", limit, limit, dims)
    cov = clip01((F.col("n_src") + F.col("n_tgt")) / (2.0 * limit))
    found = red.select(*KEY, clip01((F.col("emb") + F.col("strength")) / 2).alias(f"s_{family}"), clip01((cov + F.col("strength") + F.col("inf")) / 3).alias(f"q_{family}"))
    return _with_neutral(pairs, found, family)


def similarity(pairs: DataFrame, src_items: DataFrame, tgt_items: DataFrame, dims: int, cap: int = 2, limit: int = OBJECTS) -> DataFrame:
    """Relation and neighbour support of object edges, ``cap`` of a relation."""
    red = _reduced(pairs, src_items, tgt_items, matrix(pairs, src_items, tgt_items, True), "ic", cap, limit, dims)
    cov, stab = clip01((F.col("n_src") + F.col("n_tgt")) / (2.0 * limit)), clip01(1 - F.least(F.lit(1.0), 2 * F.col("std")))
    found = red.select(*KEY, clip01((F.col("emb") + F.col("strength")) / 2).alias("s_sim"), clip01((cov + F.col("strength") + stab) / 3).alias("q_sim"))
    return _with_neutral(pairs, found, "sim")


def difference(pairs: DataFrame, src_items: DataFrame, tgt_items: DataFrame, cap: int = 3, limit: int = DIFFERENCES) -> DataFrame:
    """C4: information that the other side does not support, ``cap`` of a relation; one side's evidence alone counts too."""
    cells = matrix(pairs, src_items, tgt_items, True)
    parts = []
    for key, items in (("src", src_items), ("tgt", tgt_items)):
        rows = best_of(pairs, items, cells, key).withColumn("open", F.col("ic") * (1 - F.col("best")))
        parts.append(diverse_top(rows, KEY, "rel", "open", "ic", cap, limit).select(*KEY, F.lit(key).alias("side"), "open", "ic"))
    both = parts[0].unionByName(parts[1])
    side = both.groupBy(*KEY, "side").agg((F.sum("open") / F.greatest(F.lit(1e-8), F.sum("ic"))).alias("conflict"), F.avg("ic").alias("ic"), F.count(F.lit(1)).alias("n"), F.sum("open").alias("x"), F.sum(F.col("open") * F.col("open")).alias("xx"))
    n = F.sum("n")
    std = F.when(n < 2, 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), F.sum("xx") / n - F.pow(F.sum("x") / n, F.lit(2.0)))))
    cov, strength, stab = clip01(n / (2.0 * limit)), F.sum("ic") / 2, clip01(1 - F.least(F.lit(1.0), 2 * std))
    found = side.groupBy(*KEY).agg(clip01(1 - clip01(F.sum("conflict") / 2)).alias("s_diff"), clip01((cov + strength + stab) / 3).alias("q_diff"))
    return _with_neutral(pairs, found, "diff")


def bank(items: DataFrame, *others: DataFrame) -> DataFrame:
    """What an attribute is held against: attributes, labels and sentences of the other side, numbered."""
    every = items.select("iri", "vec")
    for o in others:
        every = every.unionByName(o.select("iri", "vec"))
    return every.withColumn("pos", F.row_number().over(Window.partitionBy("iri").orderBy("vec")))


def attributes(pairs: DataFrame, src_items: DataFrame, tgt_items: DataFrame, src_bank: DataFrame, tgt_bank: DataFrame, limit: int = ATTRIBUTES) -> DataFrame:
    """Each attribute's best counterpart in the other side's bank, weighted; the mean of the sides that have any, never under neutral."""
    parts = []
    for key, items, other in (("src", src_items, tgt_bank), ("tgt", tgt_items, src_bank)):
        cells = matrix(pairs, items, other) if key == "src" else matrix(pairs, other, items)
        parts.append(best_of(pairs, items, cells, key).select(*KEY, F.lit(key).alias("side"), "weight", "best"))
    side = parts[0].unionByName(parts[1]).groupBy(*KEY, "side").agg(
        F.coalesce(F.try_divide(F.sum(F.col("weight") * F.col("best")), F.sum("weight")), F.lit(0.0)).alias("r"), F.avg("weight").alias("w"), F.count(F.lit(1)).alias("n"), F.sum("best").alias("x"), F.sum(F.col("best") * F.col("best")).alias("xx")
    )
    n = F.sum("n")
    std = F.when(n < 2, 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), F.sum("xx") / n - F.pow(F.sum("x") / n, F.lit(2.0)))))
    cov, inf, stab = clip01(n / (2.0 * limit)), F.sum("w") / 2, clip01(1 - F.least(F.lit(1.0), 2 * std))
    found = side.groupBy(*KEY).agg(F.greatest(F.lit(TAU), clip01(F.avg("r"))).alias("s_attr"), clip01((cov + inf + stab) / 3).alias("q_attr"))
    return _with_neutral(pairs, found, "attr")


def provenance(cells: DataFrame) -> DataFrame:
    """For each pair the links that are best for a row or a column, strongest first, as one array."""
    from tessera.operators.fusion import best_links

    item = F.struct((-F.col("score")).alias("neg"), "i", "j", "score")
    links = best_links(cells).groupBy(*KEY).agg(F.array_sort(F.collect_list(item)).alias("l"))
    return links.select(*KEY, F.transform("l", lambda x: F.struct(x["i"].alias("i"), x["j"].alias("j"), x["score"].alias("score"))).alias("links"))
