"""Scans: delimited tables, candidate and mapping files, XML alignments, triples, JSON shards, logs."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that stand for no value in delimited files (NULL, null and n/a do not).
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NaN", "None", "nan"]


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """A table with a header, tabs for .tsv and commas otherwise, all columns as text; with ``columns`` renamed by position."""
    df = spark.read.option("header", True).option("sep", "\t" if path.endswith(".tsv") else ",").option("quote", '"').option("escape", '"').csv(path)
    df = df.select([F.when(F.trim(F.col(f"`{c}`")).isin(MISSING), None).otherwise(F.regexp_replace(F.col(f"`{c}`"), "\r$", "")).alias(c.rstrip("\r")) for c in df.columns])
    return df.select([F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, columns, strict=False)]) if columns else df


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("tgt", T.StringType()), T.StructField("score", T.DoubleType())])))
def parse_candidates(values: pd.Series) -> pd.Series:
    """A Python list of names or of (name, score), without evaluating code; anything else is an error."""

    def one(text: str | None):
        out = []
        for x in ast.literal_eval(text) if text else []:
            if isinstance(x, str):
                out.append({"tgt": x, "score": None})
            else:
                out.append({"tgt": str(x[0]), "score": float(x[1])})
        return out

    return values.map(one)


def read_candidates(spark: SparkSession, path: str, top_k: int | None = None) -> DataFrame:
    """(src, tgt, label, pos): candidates of each source in file order."""
    raw = read_table(spark, path, ["src", "gold", "cands"])
    out = raw.select("src", F.posexplode(parse_candidates("cands")).alias("pos", "c")).select("src", "c.tgt", F.lit(0).alias("label"), "pos")
    return out if top_k is None else out.where(F.col("pos") < top_k)


def read_ranking(spark: SparkSession, path: str) -> DataFrame:
    """(src, gold, tgt, score, rank); unscored lists score (n - position) / n; by score, ties in file order."""
    raw = read_table(spark, path, ["src", "gold", "cands"]).withColumn("c", parse_candidates("cands"))
    return ranking_rows(raw)


def ranking_rows(raw: DataFrame) -> DataFrame:
    """Rows of (src, gold, c: array of (tgt, score)) with scores and ranks."""
    n = F.size("c")
    unscored = F.forall("c", lambda x: x["score"].isNull())
    scored = F.when(unscored, F.transform("c", lambda x, i: F.struct(x["tgt"].alias("tgt"), ((n - i) / n).alias("score"), i.alias("i")))).otherwise(F.transform("c", lambda x, i: F.struct(x["tgt"].alias("tgt"), x["score"].alias("score"), i.alias("i"))))
    ordered = F.array_sort(scored, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise(a["i"] - b["i"]))
    return raw.select("src", "gold", F.posexplode(ordered).alias("r", "x")).select("src", "gold", "x.tgt", "x.score", (F.col("r") + 1).alias("rank"))


def read_mappings(spark: SparkSession, path: str, threshold: float = 0.0) -> DataFrame:
    """(src, tgt, score) of the threshold and more; a missing score is 0."""
    return read_table(spark, path, ["src", "tgt", "score"]).select("src", "tgt", F.coalesce(F.try_cast(F.col("score"), "double") if hasattr(F, "try_cast") else F.col("score").try_cast("double"), F.lit(0.0)).alias("score")).where(F.col("score") >= threshold)


def read_reference(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of the first two columns; scores are not read."""
    return read_table(spark, path, ["src", "tgt"]).select("src", "tgt").where("src IS NOT NULL AND tgt IS NOT NULL")


def read_pairs(spark: SparkSession, path: str, src_names: list[str], tgt_names: list[str]) -> DataFrame:
    """Pairs from whichever of the column names a file has; rows without both ends are marked malformed."""
    df = read_table(spark, path)
    pick = lambda names: F.coalesce(*[F.col(f"`{c}`") for c in df.columns if c in names], F.lit(None))
    return df.select(pick(src_names).alias("src"), pick(tgt_names).alias("tgt")).withColumn("malformed", F.col("src").isNull() | F.col("tgt").isNull())


def read_alignment_xml(spark: SparkSession, path: str) -> DataFrame:
    """Cells of an alignment in RDF/XML; incomplete ones are skipped."""
    schema = "entity1 STRUCT<`_rdf:resource`: STRING>, entity2 STRUCT<`_rdf:resource`: STRING>, measure STRING"
    df = spark.read.format("xml").option("rowTag", "Cell").schema(schema).load(path)
    out = df.select(F.col("entity1.`_rdf:resource`").alias("src"), F.col("entity2.`_rdf:resource`").alias("tgt"), F.col("measure").try_cast("double").alias("score"))
    return out.where("src IS NOT NULL AND tgt IS NOT NULL")


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """(src, rel, dst, literal) of N-Triples lines."""
    line = F.col("value")
    pattern = r"^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(.+?)\s*\.\s*$"
    parts = spark.read.text(path).where(line.rlike(pattern)).select(*[F.regexp_extract(line, pattern, i).alias(f"g{i}") for i in (1, 2, 3)])
    dst = F.when(F.col("g3").startswith("<"), F.regexp_replace("g3", "^<|>$", "")).when(F.col("g3").startswith('"'), F.regexp_extract("g3", r'^"((?:[^"\\]|\\.)*)"', 1)).otherwise(F.col("g3"))
    return parts.select(F.regexp_replace("g1", "^<|>$", "").alias("src"), F.col("g2").alias("rel"), dst.alias("dst"), F.col("g3").startswith('"').alias("literal"))


# Class and annotation terms of the OWL and RDFS vocabularies.
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDFS_LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
RDFS_SUBCLASS = "http://www.w3.org/2000/01/rdf-schema#subClassOf"
CLASS_TYPES = ["http://www.w3.org/2002/07/owl#Class", "http://www.w3.org/2000/01/rdf-schema#Class", "http://www.w3.org/2002/07/owl#DeprecatedClass"]


def classes(triples: DataFrame) -> DataFrame:
    """Named classes."""
    return triples.where((F.col("rel") == RDF_TYPE) & F.col("dst").isin(CLASS_TYPES) & ~F.col("src").startswith("_:")).select(F.col("src").alias("iri")).distinct()


def annotations(triples: DataFrame) -> DataFrame:
    return triples.where("literal").select(F.col("src").alias("iri"), F.col("rel").alias("prop"), F.col("dst").alias("value"))


def project(triples: DataFrame, taxonomy_only: bool = False, literals: bool = False) -> DataFrame:
    """S3: edges (src, rel, dst): subclass axioms between names; else also other object triples, and literal ones if asked."""
    named = ~F.col("src").startswith("_:") & ~F.col("dst").startswith("_:")
    taxonomy = triples.where((F.col("rel") == RDFS_SUBCLASS) & named & ~F.col("literal"))
    if taxonomy_only:
        return taxonomy.select("src", "rel", "dst").distinct()
    out = triples.where(named & (F.col("rel") != RDF_TYPE) & (~F.col("literal") | F.lit(literals)))
    return out.select("src", "rel", "dst").distinct()


def read_shards(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of a folder of shards; compressed ones by their suffix."""
    return spark.read.schema(schema).json(path)


def checked_dump(df: DataFrame, columns: list[str], numeric: list[str], binary: list[str]) -> DataFrame:
    """A dump whose columns are these in this order; numbers finite and binaries 0 or 1, else an error when read."""
    if df.columns != columns:
        raise ValueError(f"columns differ: {[c for c in df.columns if c not in columns]}, {[c for c in columns if c not in df.columns]}")
    bad = lambda c: F.raise_error(F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("null"))))
    for c in numeric:
        v = F.col(c).try_cast("double")
        df = df.withColumn(c, F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), v).otherwise(bad(c).cast("double")))
    for c in binary:
        v = F.lower(F.trim(F.col(c).cast("string")))
        df = df.withColumn(c, F.when(v.isin("1", "1.0", "true"), 1).when(v.isin("0", "0.0", "false"), 0).otherwise(bad(c).cast("int")))
    return df


def last_match(lines: DataFrame, pattern: str, groups: int) -> DataFrame:
    """The groups of a pattern in the last line that it matches; lines are (path, line_no, value)."""
    hit = lines.where(F.col("value").rlike(pattern))
    parts = F.struct(*[F.regexp_extract("value", pattern, i + 1).alias(f"g{i + 1}") for i in range(groups)])
    return hit.groupBy("path").agg(F.max_by(parts, "line_no").alias("g")).select("path", "g.*")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of whole log files with their path and number."""
    whole = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("line_no", "value"))
    return whole


def run_metrics(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, metric, value) of result files, one metric a row or one a column."""
    raw = spark.read.option("header", True).csv(pattern).withColumn("path", F.col("_metadata.file_path"))
    if {"Metric", "Value"} <= set(raw.columns):
        return raw.select("path", F.col("Metric").alias("metric"), F.col("Value").try_cast("double").alias("value"))
    names = [c for c in raw.columns if c != "path"]
    return raw.unpivot(["path"], names, "metric", "value").select("path", "metric", F.col("value").try_cast("double").alias("value"))


def merged_config(defaults: dict, own: dict) -> dict:
    """A configuration over its defaults, dictionary by dictionary."""
    return {**defaults, **{k: merged_config(defaults[k], x) if isinstance(x, dict) and isinstance(defaults.get(k), dict) else x for k, x in own.items()}}


def read_config(path: str, defaults: dict) -> dict:
    """A JSON configuration, or a YAML one where a parser is installed, merged into the defaults."""
    with open(path) as f:
        if path.endswith((".yaml", ".yml")):
            import yaml

            return merged_config(defaults, yaml.safe_load(f) or {})
        return merged_config(defaults, json.load(f))


def flatten_config(spark: SparkSession, config: dict) -> DataFrame:
    """Q9: a configuration as (path, value) rows."""
    rows: list[tuple[str, str]] = []

    def walk(node, at: str) -> None:
        for k, v in node.items():
            walk(v, f"{at}{k}.") if isinstance(v, dict) else rows.append((f"{at}{k}", json.dumps(v)))

    walk(config, "")
    return spark.createDataFrame(rows, T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType())]))


def fingerprint_ok(meta: DataFrame, kind: str, signature: str, fingerprint: str, tolerated: Column | None = None) -> DataFrame:
    """Q14: stages that may be resumed: of this kind and signature, with this fingerprint or a tolerated difference."""
    same = F.col("fingerprint") == fingerprint
    return meta.where((F.col("kind") == kind) & (F.col("signature") == signature) & F.col("fingerprint").isNotNull() & (same if tolerated is None else same | tolerated))
