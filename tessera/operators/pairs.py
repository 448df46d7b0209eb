"""Pair-set algebra, mapping limits, ranking metrics and alignment diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["src", "tgt"]


def without_ignored(pairs: DataFrame, src_ignored: DataFrame | None = None, tgt_ignored: DataFrame | None = None) -> DataFrame:
    """Pairs that touch no ignored class; the ignored are tables of one ``iri`` column."""
    out = pairs
    if src_ignored is not None:
        out = out.join(src_ignored.select(F.col("iri").alias("src")), "src", "left_anti")
    if tgt_ignored is not None:
        out = out.join(tgt_ignored.select(F.col("iri").alias("tgt")), "tgt", "left_anti")
    return out


def ignored_classes(annotations: DataFrame, prop: str) -> DataFrame:
    """Classes that an annotation takes out of alignment."""
    return annotations.where((F.col("prop") == prop) & (F.lower(F.trim("value")) == "false")).select("iri").distinct()


def at_least(pairs: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """P5: scores of the threshold and more."""
    return pairs.where(F.col(score) >= threshold)


def active(pairs: DataFrame, sigma: str, q: str | None = None) -> DataFrame:
    """Rows whose channel says something: by weight alone above 1e-6, or by quality above 0 and weight above 1e-8."""
    return pairs.where(F.col(sigma) > 1e-6) if q is None else pairs.where((F.col(q) > 0) & (F.col(sigma) > 1e-8))


def top_by(pairs: DataFrame, by: str, n: int, protected: str | None = None, score: str = "score", pos: str = "pos") -> DataFrame:
    """``n`` rows of each source or target: protected ones, then by score, ties by input position, then to the smaller other end."""
    order = ([F.desc(protected)] if protected else []) + [F.desc(score), F.asc(pos), *[F.asc(k) for k in KEY if k != by]]
    return pairs.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def best(pairs: DataFrame, k: int, score: str = "score", pos: str = "pos") -> DataFrame:
    """T4: the ``k`` best rows, ties by position."""
    return pairs.orderBy(F.desc(score), F.asc(pos)).limit(k)


def label(cands: DataFrame, reference: DataFrame) -> DataFrame:
    """Candidates with the reference's label where there is one (a repeated reference repeats rows)."""
    return cands.join(reference.withColumnRenamed("label", "__ref"), KEY, "left").withColumn("label", F.coalesce("__ref", "label")).drop("__ref")


def prefilter(cands: DataFrame, exact: DataFrame, by_source: bool) -> DataFrame:
    """Candidates without the exact pairs, or without all of their sources."""
    return cands.join(exact.select("src").distinct() if by_source else exact.select(*KEY).distinct(), "src" if by_source else KEY, "left_anti")


def add_columns(summary: DataFrame, cands: DataFrame, prefixes: list[str]) -> DataFrame:
    """Columns of the candidates with one of the prefixes that the summary lacks, by pair (one row each)."""
    new = [c for c in cands.columns if c not in summary.columns and any(c.startswith(p) for p in prefixes)]
    return summary.join(cands.select(*KEY, *new).dropDuplicates(KEY), KEY, "left")


def fill_scores(anchored: DataFrame, preds: DataFrame) -> DataFrame:
    """Anchored candidates with predicted scores, 0 where there is none; of repeated predictions the last counts."""
    last = preds.groupBy(*KEY).agg(F.max_by("score", "pos").alias("score"))
    return anchored.join(last, KEY, "left").na.fill(0.0, ["score"])


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct pairs of ``a`` that are not in ``b``."""
    return a.select(*KEY).distinct().join(b.select(*KEY).distinct(), KEY, "left_anti")


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*KEY).distinct().join(b.select(*KEY).distinct(), KEY, "left_semi")


def coverage(reference: DataFrame, cands: DataFrame, exact: DataFrame) -> DataFrame:
    """Reference pairs that neither candidates nor exact pairs hold."""
    return minus(minus(reference, cands), exact)


def null_safe(a: DataFrame) -> DataFrame:
    """Pairs with both ends; null ends are no entity."""
    return a.where("src IS NOT NULL AND tgt IS NOT NULL")


def precision_recall(preds: DataFrame, refs: DataFrame, null_refs: DataFrame | None = None) -> DataFrame:
    """A1: one row of counts, precision, recall and F1 over distinct pairs; null references leave both sides first."""
    p, r = preds.select(*KEY).distinct(), refs.select(*KEY).distinct()
    if null_refs is not None:
        p, r = minus(p, null_refs), minus(r, null_refs)
    # one pass: tag, union, group
    tagged = p.withColumn("s", F.lit(1)).unionByName(r.withColumn("s", F.lit(2))).groupBy(*KEY).agg(F.sum("s").alias("s"))
    n = tagged.agg(F.count_if(F.col("s") == 3).alias("tp"), F.count_if(F.col("s") != 2).alias("n_pred"), F.count_if(F.col("s") != 1).alias("n_ref"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = n.withColumn("precision", zero(F.try_divide("tp", "n_pred"))).withColumn("recall", zero(F.try_divide("tp", "n_ref")))
    return out.withColumn("f1", zero(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))


def ranks(cands: DataFrame, score: str = "score") -> DataFrame:
    """Rank in each source by score, ties to the smaller target."""
    return cands.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc(score), "tgt")))


def ranking_metrics(cands: DataFrame, refs: DataFrame, ks: list[int], score: str = "score") -> DataFrame:
    """A2/A3: hits at each K and mean reciprocal rank over all references; absent targets count 0."""
    placed = refs.select(*KEY).join(ranks(cands, score).select(*KEY, "rank"), KEY, "left")
    hits = [F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))).alias(f"hits_{k}") for k in ks]
    return placed.agg(F.count(F.lit(1)).alias("n_refs"), *hits, F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def candidate_recall(cands: DataFrame, refs: DataFrame, exact: DataFrame, train: DataFrame, score: str = "score") -> DataFrame:
    """Recall of the candidates, and with the exact pairs; median and 90th percentile of the found references' ranks."""
    r, c = minus(refs, train), cands.join(train.select(*KEY).distinct(), KEY, "left_anti")
    placed = r.join(ranks(c, score).groupBy(*KEY).agg(F.min("rank").alias("rank")), KEY, "left").join(exact.select(*KEY).distinct().withColumn("e", F.lit(True)), KEY, "left")
    found, oracle = F.col("rank").isNotNull(), F.col("rank").isNotNull() | F.coalesce("e", F.lit(False))
    return placed.agg(
        F.count(F.lit(1)).alias("n_refs"),
        F.count_if(found).alias("hits"),
        F.count_if(oracle).alias("oracle_hits"),
        F.coalesce(F.try_divide(F.count_if(found), F.count(F.lit(1))), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(F.count_if(oracle), F.count(F.lit(1))), F.lit(0.0)).alias("oracle_recall"),
        F.percentile("rank", 0.5).alias("rank_median"),
        F.percentile("rank", 0.9).alias("rank_p90"),
    )


def recall_at(cands: DataFrame, refs: DataFrame, ks: list[int], score: str = "score") -> DataFrame:
    """Recall for each limit of candidates, from ranks made once."""
    placed = refs.select(*KEY).distinct().join(ranks(cands, score).select(*KEY, "rank"), KEY, "left")
    return placed.select(F.explode(F.array(*map(F.lit, ks))).alias("top_k"), "rank").groupBy("top_k").agg(F.avg(F.coalesce((F.col("rank") <= F.col("top_k")).cast("double"), F.lit(0.0))).alias("recall"))


def miss_buckets(refs: DataFrame, cands: DataFrame, preds: DataFrame, abstained: DataFrame) -> DataFrame:
    """The references that were not predicted by why: absent, abstained, wrong selected, rejected. Buckets are disjoint."""
    missed = minus(refs, preds)
    have = cands.select(*KEY).distinct().withColumn("c", F.lit(True))
    none, some = abstained.select("src").distinct().withColumn("a", F.lit(True)), preds.select("src").distinct().withColumn("p", F.lit(True))
    joined = missed.join(have, KEY, "left").join(none, "src", "left").join(some, "src", "left")
    bucket = F.when(F.col("c").isNull(), "absent").when(F.col("a"), "abstained").when(F.col("p"), "wrong_selected").otherwise("rejected")
    return joined.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def threshold_sweep(scored: DataFrame, refs: DataFrame, thresholds: list[float], cards: list[int]) -> DataFrame:
    """Precision, recall and F1 for each threshold and cardinality, in one pass over ranked pairs."""
    n = refs.select(*KEY).distinct().agg(F.count(F.lit(1)).alias("n_ref"))
    hit = ranks(scored).join(refs.select(*KEY).distinct().withColumn("hit", F.lit(1)), KEY, "left").na.fill(0, ["hit"])
    grid = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.lit(c).alias("card")) for t in thresholds for c in cards])
    rows = hit.select("score", "rank", "hit", F.inline(grid)).where((F.col("score") >= F.col("threshold")) & (F.col("rank") <= F.col("card")))
    out = rows.groupBy("threshold", "card").agg(F.sum("hit").alias("tp"), F.count(F.lit(1)).alias("n_pred")).crossJoin(F.broadcast(n))
    p, r = F.col("tp") / F.col("n_pred"), F.coalesce(F.try_divide("tp", "n_ref"), F.lit(0.0))
    return out.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)))


def final_alignment(preds: DataFrame, exact: DataFrame, src_n: int, tgt_n: int | None) -> DataFrame:
    """Exact pairs first and protected, then predictions; ``src_n`` of each source, then ``tgt_n`` of each target."""
    offset = 1 << 40
    first = exact.select(*KEY, "score", "pos", F.lit(1).alias("protected"))
    rest = preds.select(*KEY, "score", (F.col("pos") + offset).alias("pos"), F.lit(0).alias("protected"))
    union = first.unionByName(rest)
    one = union.withColumn("__r", F.row_number().over(Window.partitionBy(*KEY).orderBy("pos"))).where("__r = 1").drop("__r")
    out = top_by(one, "src", src_n, "protected")
    return out if tgt_n is None else top_by(out, "tgt", tgt_n, "protected")


def split_rows(*frames: DataFrame) -> DataFrame:
    """Rows of several frames, columns merged by name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def conflicts(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Keys whose repeated rows differ in one of the values."""
    return rows.groupBy(*keys).agg(*[F.count_distinct(v).alias(v) for v in values]).where(" OR ".join(f"{v} > 1" for v in values)).select(*keys)


def first_flags(rows: DataFrame, flag: Column) -> DataFrame:
    """The first flag of each source and whether later ones differ."""
    return rows.groupBy("src").agg(F.min_by(flag, "pos").alias("flag"), (F.count_distinct(flag) > 1).alias("conflict"))
