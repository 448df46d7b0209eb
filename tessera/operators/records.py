"""Explanation records and what surrounds them: items, display texts, overlays, run summaries, study lookups."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["src", "tgt"]


def exact_scores(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Exact pairs' scores: the first of the columns that a row has as a number, else 1."""
    have = [F.col(c).try_cast("double") for c in columns if c in rows.columns]
    return rows.withColumn("score", F.coalesce(*have, F.lit(1.0)))


def first_labels(labels: DataFrame) -> DataFrame:
    """The first label of each entity (iri, label, pos) that is not blank."""
    return labels.where(F.trim(F.coalesce("label", F.lit(""))) != "").groupBy("iri").agg(F.min_by("label", F.struct("pos", "label")).alias("label"))


def items_or(record: DataFrame, first: str, second: str, name: str = "items") -> DataFrame:
    """The first array where it holds anything, else the second."""
    return record.withColumn(name, F.when(F.size(first) > 0, F.col(first)).otherwise(F.col(second)))


def selected_records(sources: DataFrame, ranking: DataFrame, records: DataFrame, k: int) -> DataFrame:
    """The records of the selected sources' first ``k`` candidates; a missing one is an error when read."""
    wanted = ranking.where(F.col("rank") <= k).join(sources.select("src").distinct(), "src", "left_semi").select(*KEY, "rank")
    got = wanted.join(records.withColumn("__have", F.lit(True)), KEY, "left")
    fault = F.raise_error(F.concat(F.lit("no record for "), F.col("src").cast("string"), F.lit(" "), F.col("tgt").cast("string")))
    return got.withColumn("rank", F.when(F.col("__have"), F.col("rank")).otherwise(fault.cast("int"))).drop("__have")


def synced(records: DataFrame, selector: DataFrame, columns: list[str]) -> DataFrame:
    """Records with the selector's columns; of repeated pairs of the selector the last (``pos``) counts."""
    last = selector.groupBy(*KEY).agg(F.max_by(F.struct(*columns), "pos").alias("__s"))
    return records.join(last, KEY, "left").select("*", *[F.col(f"__s.{c}").alias(f"selector_{c}") for c in columns]).drop("__s")


def compact_evidence(records: DataFrame) -> DataFrame:
    """(src, tgt, key, strength) of records' evidence arrays of (channel, text, importance, side, linked): target evidence counts in full, source evidence three quarters if it is linked and not else; the strongest of equal keys."""
    rows = records.select(*KEY, F.inline("evidence"))
    weight = F.when(F.col("side") == "target", 1.0).when((F.col("side") == "source") & F.col("linked"), 0.75).otherwise(0.0)
    keyed = rows.select(*KEY, F.concat_ws(":", "channel", F.lower(F.trim("text"))).alias("key"), (weight * F.greatest(F.lit(0.0), F.col("importance"))).alias("strength"))
    return keyed.where("strength > 0").groupBy(*KEY, "key").agg(F.max("strength").alias("strength"))


def hydrated(records: DataFrame, items: DataFrame) -> DataFrame:
    """records' arrays of item ids (``item_ids``) with the items' texts in place, in order; ids without an item stay as they are."""
    each = records.select(*KEY, F.posexplode("item_ids").alias("pos", "item_id")).join(items.select("item_id", "text"), "item_id", "left")
    made = each.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("pos", "item_id", F.coalesce("text", "item_id").alias("text")))).alias("items"))
    return records.drop("item_ids").join(made, KEY, "left")


def repaired(records: DataFrame, rebuilt: DataFrame, columns: list[str], schema_version: int = 3) -> DataFrame:
    """Older or incomplete records with their missing columns from rebuilt ones; what a record has stays."""
    r = rebuilt.select(*KEY, *[F.col(c).alias(f"__{c}") for c in columns])
    needs = F.coalesce(F.col("schema_version"), F.lit(0)) < schema_version
    for c in columns:
        needs = needs | F.col(c).isNull()
    out = records.join(r, KEY, "left").withColumn("repaired", needs)
    for c in columns:
        out = out.withColumn(c, F.coalesce(c, f"__{c}")).drop(f"__{c}")
    return out


def llm_changes(records: DataFrame) -> DataFrame:
    """Sources whose first candidate by ``before`` is another than by ``after``: both with their scores, and whether the change was to or from a correct one."""
    first = lambda c: F.row_number().over(Window.partitionBy("src").orderBy(F.desc(c), "tgt"))
    ranked = records.withColumn("rb", first("before")).withColumn("ra", first("after"))
    pick = lambda r, mark: ranked.where(F.col(r) == 1).select("src", F.col("tgt").alias(f"tgt_{mark}"), F.col("label").alias(f"label_{mark}"), F.col(mark).alias(f"score_{mark}"))
    both = pick("rb", "before").join(pick("ra", "after"), "src").where("tgt_before <> tgt_after")
    return both.withColumn("effect", F.when(F.col("label_after") > F.col("label_before"), "mended").when(F.col("label_after") < F.col("label_before"), "broken").otherwise("same"))


def evidence_counts(records: DataFrame, channels: list[str]) -> DataFrame:
    """Items in each of the records' evidence arrays, their sum, and the channels that have any."""
    n = [F.greatest(F.lit(0), F.size(c)) for c in channels]
    return records.select(*KEY, *[x.alias(f"n_{c}") for x, c in zip(n, channels, strict=True)], reduce(lambda a, b: a + b, n).alias("n_items"), reduce(lambda a, b: a + b, [(x > 0).cast("int") for x in n]).alias("n_channels"))


def flattened(metrics: DataFrame, prefix: str) -> DataFrame:
    """A row of metrics as (name, value) with a prefix."""
    return metrics.select([F.col(c).cast("double").alias(f"{prefix}{c}") for c in metrics.columns]).unpivot([], [f"{prefix}{c}" for c in metrics.columns], "name", "value")


def active_rows(pairs: DataFrame, exact: DataFrame, by_source: bool, kind: str = "inference") -> DataFrame:
    """The rows of a kind: those that exact matching left to inference, or those that it took."""
    keys = ["src"] if by_source else KEY
    return pairs.join(exact.select(*keys).distinct(), keys, "left_anti" if kind == "inference" else "left_semi")


def evaluated_global(preds: DataFrame, refs: DataFrame, null_refs: DataFrame, ignored: DataFrame) -> DataFrame:
    """A4: global evaluation: predictions that touch no ignored class, against all references, without the null ones."""
    from tessera.operators.pairs import precision_recall, without_ignored

    return precision_recall(without_ignored(preds, ignored, ignored), refs, null_refs)


def evaluated_local(ranking: DataFrame, refs: DataFrame, ks: list[int]) -> DataFrame:
    """A4: local evaluation: hits at each K and mean reciprocal rank of a scored ranking."""
    from tessera.operators.pairs import ranking_metrics

    return ranking_metrics(ranking, refs, ks)


def split_misses(refs: DataFrame, cands: DataFrame, preds: DataFrame) -> DataFrame:
    """U4: references by whether candidates or predictions hold them: (oracle, predicted, n)."""
    mark = lambda d, c: d.select(*KEY).distinct().withColumn(c, F.lit(True))
    out = refs.select(*KEY).distinct().join(mark(cands, "c"), KEY, "left").join(mark(preds, "p"), KEY, "left")
    hit = lambda c: F.coalesce(F.col(c), F.lit(False))
    return out.groupBy((hit("c") | hit("p")).alias("oracle"), hit("p").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


def abstained_misses(refs: DataFrame, preds: DataFrame, cands: DataFrame, abstained: DataFrame) -> DataFrame:
    """Missed references that stand among the candidates of an abstained source."""
    missed = refs.select(*KEY).distinct().join(preds.select(*KEY).distinct(), KEY, "left_anti")
    return missed.join(cands.select(*KEY).distinct(), KEY, "left_semi").join(abstained.select("src").distinct(), "src", "left_semi")


def kendall(df: DataFrame, keys: list[str], a: str, b: str, max_rows: int = 20_000) -> DataFrame:
    """Kendall's tau-b of two columns for each key; null where one is constant.

    A group is a bounded table of bins or sources; one over ``max_rows`` is an error.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > max_rows:
            raise ValueError("too many rows for a rank correlation of pairs")
        pdf = pdf.dropna(subset=[a, b])
        x, y, agree, tx, ty = pdf[a].to_numpy(), pdf[b].to_numpy(), 0, 0, 0
        for i in range(len(x)):
            dx, dy = np.sign(x[i + 1 :] - x[i]), np.sign(y[i + 1 :] - y[i])
            agree, tx, ty = agree + float((dx * dy).sum()), tx + int((dx != 0).sum()), ty + int((dy != 0).sum())
        tau = agree / np.sqrt(float(tx) * ty) if tx and ty else None
        return pd.DataFrame([(*key, len(x), tau)], columns=[*keys, "n", "tau"])

    types = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.groupBy(*keys).applyInPandas(run, f"{types}, n long, tau double")


def one_hop_payload(annotations: DataFrame, definitions: Column, synonyms: Column, most: tuple[int, int, int] = (5, 10, 12)) -> DataFrame:
    """An entity's annotations for display: the first definitions, synonyms and others, by property and value."""
    kind = F.when(definitions, "definition").when(synonyms, "synonym").otherwise("annotation")
    rows = annotations.select("iri", "prop", "value", kind.alias("kind")).distinct()
    r = F.row_number().over(Window.partitionBy("iri", "kind").orderBy("prop", "value"))
    cap = F.when(F.col("kind") == "definition", most[0]).when(F.col("kind") == "synonym", most[1]).otherwise(most[2])
    return rows.withColumn("rank", r).where(F.col("rank") <= cap)


def expansion(edges: DataFrame, shown: DataFrame, hierarchy: str, limits: tuple[int, int, int] = (3, 3, 4)) -> DataFrame:
    """What a node opens into: parents and children over the hierarchy's relation and neighbours over others, without entities that are shown, the first by name."""
    up = edges.where(F.col("rel") == hierarchy).select(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit("parent").alias("kind"))
    down = edges.where(F.col("rel") == hierarchy).select(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit("child").alias("kind"))
    side = edges.where(F.col("rel") != hierarchy).select(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit("neighbour").alias("kind"))
    rows = up.unionByName(down).unionByName(side).where("node <> other").distinct().join(shown.select(F.col("node").alias("other")).distinct(), "other", "left_anti")
    r = F.row_number().over(Window.partitionBy("node", "kind").orderBy("other"))
    cap = F.when(F.col("kind") == "parent", limits[0]).when(F.col("kind") == "child", limits[1]).otherwise(limits[2])
    return rows.withColumn("rank", r).where(F.col("rank") <= cap).select("node", "kind", "other", "rank")
