"""License notices by an exact set-similarity join of text blocks and templates.

A block is a window of words that begins at any word; a block holds a template if it has at least
``percent`` of the template's distinct words. Words are ordered by their frequency in the whole
corpus, rarest first. A block that holds a template shares one of the template's first (rarest)
words, so only the surroundings of those join; the numbers of words and the places of the shared
word in both ordered lists then bound the overlap, and what is left is verified on every block
around the shared word.

One scan splits the texts and keeps the places of words that occur in any template; the rest works
on these places. Built-in expressions only.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memlake.llm.tiling import text_key
from memlake.session import durable

# The phrases of the base rule with their labels.
BASE = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

# Notices as the licenses' own texts recommend them, besides the base phrases.
TEMPLATES = [
    *BASE,
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under the creative commons attribution noncommercial license"),
    ("gpl", "licensed under the gnu general public license version"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("mpl", "subject to the terms of the mozilla public license"),
]

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# A hit is place * CODES + number of the word.
CODES = 1 << 20


@dataclass(frozen=True)
class LicenseParams:
    """A block spans ``window`` words, or twice a template's distinct words if these are more."""

    percent: int = 80
    window: int = 32


def vocabulary(templates: list[tuple[str, str]]) -> list[str]:
    return sorted({word for _, text in templates for word in text.split()})


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased. The general function does that too, except where a sign becomes a letter of ASCII."""
    exact = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(text.rlike(r"[\u0130\u212A]"), exact).otherwise(F.lower(text))


def template_hits(docs: DataFrame, words: list[str]) -> DataFrame:
    """doc_id, text_key, n_words and hits: the places of ``words`` in order, as place * CODES + number."""
    if len(words) > CODES:
        raise ValueError(f"templates of at most {CODES} different words")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def code(word: Column, place: Column) -> Column:
        known = F.array_position(F.array(*[F.lit(w) for w in words]), word) - 1
        return F.when(word == "", F.lit(-1)).when(word.isin(words), place.cast("long") * CODES + known)

    split = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text_key().alias("text_key"),
        F.transform(F.split(lower_ascii(text), SEPARATORS, -1), code).alias("codes"),
    )
    # Only the first and the last part can be empty: separators at the ends, or an empty text.
    empty = F.size(F.filter("codes", lambda c: c < 0))
    before = F.coalesce(F.get("codes", F.lit(0)) < 0, F.lit(False)).cast("long") * CODES
    shifted = split.select("doc_id", "text_key", "codes", empty.alias("empty"), before.alias("before"))
    return shifted.select(
        "doc_id",
        "text_key",
        (F.size("codes") - F.col("empty")).cast("long").alias("n_words"),
        F.transform(F.filter("codes", lambda c: c >= 0), lambda c: c - F.col("before")).alias("hits"),
    )


def phrase_places(phrase: list[int]) -> Column:
    """Places at which the numbered words stand one after the other."""
    first = phrase[0]

    def starts(hit: Column, i: Column) -> Column:
        found = hit % CODES == first
        for step, number in enumerate(phrase[1:], 1):
            found = found & F.coalesce(F.get("hits", i + step) == hit + step * CODES + (number - first), F.lit(False))
        return found

    return F.transform(F.filter("hits", starts), lambda hit: F.floor(hit / CODES))


def _surroundings(texts: DataFrame, leading: list[int], reach: int, order: Column) -> DataFrame:
    """(text_key, hit, near): occurrences of ``leading`` words with the hits less than ``reach`` words away, numbered by the order."""

    def around(hit: Column, i: Column) -> Column:
        near = F.slice("hits", F.greatest(i - (reach - 1), F.lit(0)) + 1, F.lit(2 * reach - 1))
        return F.when((hit % CODES).isin(leading), F.struct(hit.alias("hit"), near.alias("near")))

    ranked = lambda hit: hit - hit % CODES + F.get(order, (hit % CODES).cast("int"))
    found = texts.select("text_key", F.explode(F.filter(F.transform("hits", around), lambda x: x.isNotNull())).alias("found"))
    return found.select("text_key", ranked(F.col("found.hit")).alias("hit"), F.transform("found.near", ranked).alias("near"))


def _words(hits: Column) -> Column:
    return F.array_distinct(F.transform(hits, lambda hit: (hit % CODES).cast("int")))


def _largest_overlap(hit: Column, near: Column, span: Column) -> Column:
    """The most different words of ``near`` in a block of ``span`` words that holds ``hit``."""
    inside = lambda start: F.filter(near, lambda h: (h >= start) & (F.floor(h / CODES) < F.floor(start / CODES) + span))
    return F.array_max(F.transform(F.filter(near, lambda h: h <= hit), lambda start: F.size(_words(inside(start)))))


def held_templates(hits: DataFrame, templates: list[tuple[str, str]], params: LicenseParams) -> DataFrame:
    """(text_key, labels, score) of the texts with a block that holds a template."""
    spark = hits.sparkSession
    words = vocabulary(templates)
    counts = hits.select(F.explode("hits").alias("hit")).groupBy((F.col("hit") % CODES).alias("word")).count()
    # One number per template word.
    count = {r["word"]: r["count"] for r in counts.collect()}
    ranked = sorted(range(len(words)), key=lambda w: (count.get(w, 0), words[w]))
    rank = {word: i for i, word in enumerate(ranked)}
    order = F.array(*[F.lit(rank[w]) for w in range(len(words))])

    sets = [sorted({rank[words.index(w)] for w in text.split()}) for _, text in templates]
    needs = [-(-len(s) * params.percent // 100) for s in sets]
    spans = [max(params.window, 2 * len(s)) for s in sets]
    index = [
        (word, number, templates[number][0], place, len(own), needs[number], spans[number], own)
        for number, own in enumerate(sets)
        for place, word in enumerate(own[: len(own) - needs[number] + 1])
    ]
    schema = "word int, template int, label string, place int, size int, need int, span int, whole array<int>"
    prefixes = F.broadcast(spark.createDataFrame(index, schema))

    leading = [ranked[word] for word in sorted({row[0] for row in index})]
    with_prefix = hits.where(F.exists("hits", lambda hit: (hit % CODES).isin(leading)))
    # Equal texts are compared once.
    texts = with_prefix.groupBy("text_key").agg(F.first("hits").alias("hits"))
    shared = _surroundings(texts, leading, max(spans), order).withColumn("word", (F.col("hit") % CODES).cast("int")).join(prefixes, "word")
    distance = lambda h: F.abs(F.floor(h / CODES) - F.floor(F.col("hit") / CODES))
    near = F.filter("near", lambda h: (distance(h) < F.col("span")) & F.array_contains("whole", (h % CODES).cast("int")))
    shared = shared.withColumn("near", near).withColumn("words", F.sort_array(_words(F.col("near"))))
    own_place = F.array_position("words", F.col("word")).cast("int") - 1
    before = F.least(F.col("place"), own_place)
    after = F.least(F.col("size") - F.col("place"), F.size("words") - own_place)
    shared = shared.where((F.size("words") >= F.col("need")) & (before + after >= F.col("need")))
    overlap = _largest_overlap(F.col("hit"), F.col("near"), F.col("span"))
    found = shared.select("text_key", "label", overlap.alias("overlap"), "size", "need").where("overlap >= need")
    return found.groupBy("text_key").agg(
        F.collect_set("label").alias("labels"), F.max(F.col("overlap") / F.col("size")).alias("score")
    )


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, params: LicenseParams = LicenseParams()) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row.

    ``score`` is the largest share of a template's words in a block that holds it, else 0. A null or
    empty text has no words and no labels. Rows stand for themselves, repeated ones too; other
    columns are ignored.
    """
    words = vocabulary(templates)
    hits = durable(template_hits(docs, words), "template-hits")
    found = held_templates(hits, templates, params)

    places = {label: phrase_places([words.index(w) for w in text.split()]) for label, text in BASE}
    rows = hits.select("doc_id", "text_key", "n_words", *[places[label].alias(f"at_{i}") for i, (label, _) in enumerate(BASE)])
    every = F.concat(*[F.col(f"at_{i}") for i in range(len(BASE))])
    labels = F.filter(
        F.array(*[F.when(F.size(f"at_{i}") > 0, F.lit(label)) for i, (label, _) in enumerate(BASE)]), lambda x: x.isNotNull()
    )
    rows = rows.select("doc_id", "text_key", "n_words", every.alias("places"), F.array_sort(labels).alias("base"))
    joined = rows.join(found, "text_key", "left")
    all_labels = F.array_sort(F.array_union("base", F.coalesce("labels", F.array().cast("array<string>"))))
    return joined.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places").alias("first_word"),
        F.array_max("places").alias("last_word"),
        F.concat_ws(",", "base").alias("base_labels"),
        F.concat_ws(",", all_labels).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
