"""Label text as column expressions: normalisation, keys, tokens, grams, admissibility of aliases."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Annotation properties by what they are worth as sources of aliases.
REJECTED_TERMS = "alternativeid comment created creator curator date definition deprecated description editor format id identifier namespace note provenance review reviewer semantic slim source status subset type version xref".split()
REJECTED_CODES = "nhc0 p97 p106 p207 p322 p325 p363 iao0000115 iao0000231".split()
ALIAS_TERMS = "alt label name pref synonym term title".split()
EXACT_KEY, SECOND_KEYS, LOOSE_KEYS = "has exact synonym", ["p107", "p108"], ["has related synonym", "has narrow synonym", "has broad synonym"]


@F.pandas_udf(T.StringType())
def _ascii(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def fold_ascii(text: Column) -> Column:
    """Compatibility decomposition, then ASCII only. Texts that are ASCII already stay in the JVM's result; the Arrow function sees the others' values."""
    return F.when(text.rlike("^[\\x00-\\x7f]*$"), text).otherwise(_ascii(F.when(~text.rlike("^[\\x00-\\x7f]*$"), text)))


def normalize(text: Column, ascii_only: bool = False) -> Column:
    """possessives dropped, camel case split, ASCII, lower case, runs of other characters to one blank. ``ascii_only`` says the input needs no folding."""
    t = F.translate(F.coalesce(text.cast("string"), F.lit("")), "’‘ʼ", "'''")
    t = F.regexp_replace(t, r"\b([A-Za-z0-9]+)'s\b", "$1")
    t = F.regexp_replace(t, r"\b([A-Za-z0-9]+)s'(?=\b)", "$1s")
    t = F.regexp_replace(t, r"([a-z])([A-Z])", "$1 $2")
    t = t if ascii_only else fold_ascii(t)
    return F.trim(F.regexp_replace(F.lower(t), "[^a-z0-9]+", " "))


def tokens(normalized: Column) -> Column:
    """sorted distinct tokens."""
    return F.array_sort(F.array_distinct(F.filter(F.split(normalized, " "), lambda x: x != "")))


def token_key(normalized: Column) -> Column:
    return F.array_join(tokens(normalized), " ")


def compact_key(text: Column) -> Column:
    """lower case without anything but letters and digits (of any script)."""
    return F.regexp_replace(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"(?U)[\W_]+", "")


def local_name(iri: Column) -> Column:
    """what follows the last # and then the last /."""
    return F.substring_index(F.substring_index(F.trim(F.coalesce(iri, F.lit(""))), "#", -1), "/", -1)


def iri_fragment(iri: Column) -> Column:
    """Label of last resort: after the last /, then the last #."""
    return F.substring_index(F.substring_index(iri, "/", -1), "#", -1)


def char_grams(normalized: Column, n: int = 3) -> Column:
    """sorted distinct n-grams of the text between blanks; a shorter text whole."""
    padded = F.concat(F.lit(" "), normalized, F.lit(" "))
    grams = F.transform(F.sequence(F.lit(1), F.length(padded) - (n - 1)), lambda i: F.substr(padded, i, F.lit(n)))
    return F.when(normalized == "", F.array().cast("array<string>")).when(F.length(padded) <= n, F.array(padded)).otherwise(F.array_sort(F.array_distinct(grams)))


def annotation_priority(literal: Column, prop: Column) -> Column:
    """How good an alias a literal is (smaller is better), null for one that is not admitted."""
    text, norm = F.trim(F.coalesce(literal, F.lit(""))), normalize(literal)
    count = F.size(F.filter(F.split(norm, " "), lambda x: x != ""))
    key, code = normalize(local_name(prop)), compact_key(local_name(prop))
    terms = F.split(key, " ")
    any_of = lambda words: F.arrays_overlap(terms, F.array(*map(F.lit, words)))
    base = (
        F.when(code == "p90", 0.0)
        .when(code.isin(SECOND_KEYS), 0.05)
        .when(key == EXACT_KEY, 0.0)
        .when(key.isin(LOOSE_KEYS), 0.15)
        .when(code.isin(REJECTED_CODES) | any_of(REJECTED_TERMS) | ~any_of(ALIAS_TERMS), None)
        .otherwise(0.30)
    )
    bad = (norm == "") | (count > 12) | text.rlike(r"(?i)https?://|www\.") | text.rlike(r"^[A-Za-z_]+:[A-Za-z0-9_.:-]+$") | ((count <= 2) & norm.endswith("ontology"))
    return F.when(~bad, base + F.abs(F.least(count, F.lit(6)) - 3) / 30.0)


def annotation_cap(prop: Column) -> Column:
    """How many aliases a property may give."""
    key, code = normalize(local_name(prop)), compact_key(local_name(prop))
    return F.when((code == "p90") | (key == EXACT_KEY), 8).when(code.isin(SECOND_KEYS), 2).otherwise(4)


def truthy(value: Column) -> Column:
    """whether a text says yes."""
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("true", "1", "yes", "y"), F.lit(False))


def strict_binary(value: Column) -> Column:
    """0 or 1 from a text that says either; anything else is an error."""
    v = F.lower(F.trim(value.cast("string")))
    return F.when(v.isin("1", "1.0", "true"), 1).when(v.isin("0", "0.0", "false"), 0).otherwise(F.raise_error(F.concat(F.lit("not binary: "), F.coalesce(v, F.lit("null")))).cast("int"))


def content_tokens(text: Column, stop: list[str]) -> Column:
    """distinct lower-case tokens of more than one character that are no stop words."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(stop)))


def strip_literal(value: Column) -> Column:
    """P10: a literal without its marker, type or language suffix, and quotes."""
    v = F.regexp_replace(F.regexp_replace(F.trim(value), "^literal:", ""), r"(\^\^.*|@[A-Za-z-]+)$", "")
    return F.trim(F.regexp_replace(v, '^"+|"+$', ""))


def looks_like_literal(value: Column) -> Column:
    """P10: blank nodes, quoted texts and marked literals."""
    return value.startswith("_:") | value.startswith('"') | value.startswith("literal:") | ~value.contains(":")


def evidence_id(channel: str, side: str, *parts: Column) -> Column:
    """a stable identifier of an evidence item."""
    return F.concat(F.lit(f"{channel}-{side}-"), F.substring(F.sha1(F.concat_ws("\x1f", *parts)), 1, 16))


def graph_id(prefix: str, value: Column) -> Column:
    """prefix and the head of a SHA-1."""
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha1(value.cast("string")), 1, 16))


def property_weight(prop: Column, weights: list[tuple[str, float]], default: float = 0.5) -> Column:
    """weight of the first pattern that the property holds."""
    lower = F.lower(prop)
    return reduce(lambda w, pw: w.when(lower.contains(pw[0]), pw[1]), weights[1:], F.when(lower.contains(weights[0][0]), weights[0][1])).otherwise(default)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def info_weight(weight: Column, text: Column) -> Column:
    """weight by length of the text, to 20 words."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), weight * F.log1p(word_count(text)) / F.log1p(F.lit(20.0))))


def raw_weight(text: Column) -> Column:
    """a twelfth for each word, within .1 and 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.1), word_count(text) / 12.0))


def verbalize(template: Column, source: Column, target: Column, relation: Column) -> Column:
    """a template with ``$SRC`` and ``$TGT`` filled in; without one, source, relation, target."""
    return F.coalesce(F.replace(F.replace(template, F.lit("$SRC"), source), F.lit("$TGT"), target), F.concat_ws(" ", source, relation, target))


def valid_template(template: Column) -> Column:
    """Exactly one ``$SRC`` and one ``$TGT``."""
    return (F.size(F.split(template, r"\$SRC")) == 2) & (F.size(F.split(template, r"\$TGT")) == 2)


def first_json(text: Column) -> Column:
    """the JSON object of an answer: the whole text without fences if it parses, else from its first brace to its last if that parses; null otherwise."""
    plain = strip_fences(text)
    braced = F.regexp_extract(plain, r"(?s)(\{.*\})", 1)
    is_object = lambda x: F.try_parse_json(x).isNotNull() & x.startswith("{")
    return F.when(is_object(plain), plain).when(is_object(braced), braced)


def strip_fences(text: Column) -> Column:
    """a text without a code fence around it."""
    opened = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"(?i)^\s*```(?:json)?\s*", "")
    return F.trim(F.regexp_replace(opened, r"\s*```\s*$", ""))


def json_value(text: Column, key: str) -> Column:
    """a string value of an answer's object, or (where it does not parse) the first quoted value after the quoted key."""
    raw = F.regexp_extract(strip_fences(text), rf'(?s)"{key}"\s*:\s*"((?:\\.|[^"\\])*)"', 1)
    recovered = F.coalesce(F.get_json_object(F.concat(F.lit('{"v":"'), raw, F.lit('"}')), "$.v"), raw)
    return F.coalesce(F.get_json_object(first_json(text), f"$.{key}"), F.nullif(F.trim(recovered), F.lit("")))


def yes_probability(answer: Column) -> Column:
    """From an answer with the first token's alternatives, ``{"top": [{"token": .., "logprob": ..}]}``, the share of yes among yes and no; null without either."""
    top = F.from_json(F.get_json_object(answer, "$.top"), "array<struct<token: string, logprob: double>>")
    mass = lambda word: F.aggregate(F.filter(top, lambda x: F.lower(F.trim(x["token"])) == word), F.lit(0.0), lambda a, x: a + F.exp(x["logprob"]))
    return F.try_divide(mass("yes"), mass("yes") + mass("no"))


def definition_like(prop: Column) -> Column:
    """Properties that hold definitions rather than names."""
    key = compact_key(local_name(prop))
    return key.isin("definition", "comment", "description", "iao0000115", "p97", "p325") | key.startswith("def")


def display_text(value: Column, text: Column, prop: Column) -> Column:
    """What an attribute node shows: its value, else what follows the colon of its text, else the text, else the property."""
    filled = lambda c: F.nullif(F.trim(F.coalesce(c.cast("string"), F.lit(""))), F.lit(""))
    suffix = F.when(text.contains(":"), F.regexp_replace(text, r"(?s)^[^:]*:", ""))
    return F.coalesce(filled(value), filled(suffix), filled(text), filled(prop))


def safe_double(value: Column, default: float = 0.0) -> Column:
    """A finite number from a text, or the default."""
    v = value.try_cast("double")
    return F.when(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), v).otherwise(F.lit(default))


def sanitized_json(text: Column) -> Column:
    """A text without control characters and lone surrogates, as JSON strings may not hold them."""
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{d800}-\x{dfff}]", "")


def clean_summary(text: Column) -> Column:
    """a text without code fences."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)```[a-z]*", ""), r"^\s+|\s+$", "")


def complete_sentences(text: Column, most: int = 4) -> Column:
    """whole sentences only, ``most`` at most."""
    return F.array_join(F.slice(F.regexp_extract_all(clean_summary(text), F.lit(r"(?s)([^.!?]+[.!?])"), 1), 1, most), "")


def duration(seconds: Column) -> Column:
    """days:hours:minutes:seconds."""
    s = seconds.cast("long")
    return F.format_string("%d:%02d:%02d:%02d", F.expr("0L") + F.floor(s / 86400), F.floor(s / 3600) % 24, F.floor(s / 60) % 60, s % 60)
