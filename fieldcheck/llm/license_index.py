"""License scans by a positional rare-token index, in DataFrame expressions only.

A template is a sequence of words with a mandatory key phrase inside. The corpus tells how rare each
template word is; the rarest word of a key phrase is what a file's words are looked up for. A hit, less
the word's place in the template, gives the template's start in the file. There the key phrase has to
stand word for word, and the other words are intersected by their places relative to the start: the
share of the template's IDF that is found is its score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcheck.llm.common import query, table

_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Share of a template's IDF that must stand in its place.
ENOUGH = 0.6


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    key: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_at(self) -> int:
        """Place of the key phrase in the template."""
        k, w = self.key.split(), self.words
        return next(i for i in range(len(w)) if w[i : i + len(k)] == k)


#: Fixed wording of well-known licences; the base phrases come first.
TEMPLATES = (
    Template("cc-by", "cc by", "cc by", True),
    Template("gpl", "general public license", "general public license", True),
    Template("reserved", "all rights reserved", "all rights reserved", True),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
             "source and binary forms"),
    Template("cc-attribution", "creative commons attribution", "commons attribution"),
    Template("cc-by-nc", "licensed under cc by nc", "cc by nc"),
    Template("cc-by-sa", "licensed under cc by sa", "cc by sa"),
    Template("gpl-2", "gnu general public license version 2", "general public license version 2"),
    Template("gpl-3", "gnu general public license version 3", "general public license version 3"),
    Template("lgpl", "gnu lesser general public license", "lesser general public license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
             "permission is hereby granted free of charge"),
    Template("mpl", "mozilla public license", "mozilla public license"),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             "free and unencumbered software"),
)


def words(text: str | Column = "text") -> Column:
    """Runs of digits, letters (A-Z in lower case) and characters beyond ASCII; null is empty."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    # translate() keeps to A-Z, where lower() would also fold other letters into ASCII
    low = F.when(text.rlike("[A-Z]"), _ascii_lower(text)).otherwise(text)
    return F.array_remove(F.split(low, _BREAK), "")


def _ascii_lower(text: Column) -> Column:
    """lower(), but where a character beyond ASCII would become an ASCII letter: those are kept apart."""
    special = text.rlike("[İK]")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(special, F.translate(text, upper, lower)).otherwise(F.lower(text))


def rarity(docs: DataFrame, templates: tuple[Template, ...]) -> dict[str, float]:
    """IDF of every template word over all documents: ln((rows + 1) / (rows with the word + 1)) + 1.

    As many rows as the templates have words reach the driver.
    """
    vocabulary = sorted({w for t in templates for w in t.words})
    known = F.array(*(F.lit(w) for w in vocabulary))
    rows = docs.select(F.explode_outer(F.concat(F.array_intersect(words(), known), F.array(F.lit("")))).alias("word"))
    counts = {r["word"]: r["count"] for r in rows.groupBy("word").count().collect()}
    total = counts.get("", 0)
    return {w: math.log((total + 1) / (counts.get(w, 0) + 1)) + 1 for w in vocabulary}


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` with n_words and hits: an array of (label, base, start, score), by label and start.

    start counts words from 0. A null text has no words. Every row stays, repeated ones too; an empty table
    gives no rows. Columns other than text and `keep` are not looked at.
    """
    idf = rarity(docs, templates)
    rarest = {t: min(((-idf[w], i, w) for i, w in enumerate(t.key.split()))) for t in templates}
    anchors = sorted({w for _, _, w in rarest.values()})
    split = docs.select(*keep, words().alias("_words"))
    lookup = F.filter(
        F.transform("_words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: h["w"].isin(anchors)
    )
    none = F.array().cast("array<struct<w:string,i:int>>")
    found = F.arrays_overlap("_words", F.array(*(F.lit(w) for w in anchors)))
    looked = split.withColumn("_hits", F.when(found, lookup).otherwise(none))
    hits = reduce(lambda a, b: F.concat(a, b), (_places(t, rarest[t], idf) for t in sorted(templates, key=lambda t: t.label)))
    kind = "array<struct<label:string,base:boolean,start:bigint,score:double>>"
    return looked.select(
        *keep,
        F.size("_words").cast("bigint").alias("n_words"),
        F.when(F.size("_hits") > 0, hits).otherwise(F.array()).cast(kind).alias("hits"),
    )


def _places(t: Template, rare: tuple[float, int, str], idf: dict[str, float]) -> Column:
    """Where the template stands: its starts by the rare word, verified, with their scores."""
    _, at, anchor = rare
    key, first = t.key.split(), t.key_at
    phrase = F.array(*(F.lit(w) for w in key))
    own = F.filter("_hits", lambda h: (h["w"] == anchor) & (h["i"] >= at))
    sure = F.filter(own, lambda h: F.slice(F.col("_words"), h["i"] - at + 1, len(key)) == phrase)
    total = sum(idf[w] for w in t.words)
    inside = sum(idf[w] for w in key)

    def scored(h: Column) -> Column:
        score = F.lit(inside)
        for i, w in enumerate(t.words):
            if not first <= i < first + len(key):
                place = h["i"] - at - first + i
                there = (place >= 0) & F.coalesce(F.get("_words", F.greatest(place, F.lit(0))) == w, F.lit(False))
                score = score + F.when(there, idf[w]).otherwise(0.0)
        # A template may begin before the file does; its key phrase does not.
        start = h["i"] - at if t.base else F.greatest(h["i"] - at - first, F.lit(0))
        return F.struct(
            F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), start.cast("bigint").alias("start"),
            (score / total).alias("score"),
        )

    return F.filter(F.transform(sure, scored), lambda m: m["score"] >= ENOUGH)


def _oracle() -> str:
    values = ", ".join(
        f"({no}, '{t.label}', {str(t.base).lower()}, {t.key_at}, {t.words}, {t.key.split()})"
        for no, t in enumerate(TEMPLATES)
    )
    return f"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents
), t(no, label, base, key_at, words, phrase) AS (VALUES {values}),
v AS (SELECT DISTINCT unnest(words) AS word FROM t),
df AS (SELECT v.word, count(d.word) AS df FROM v LEFT JOIN (SELECT unnest(list_distinct(w)) AS word FROM w) d
  ON v.word = d.word GROUP BY v.word),
idf AS (SELECT word, ln(((SELECT count(*) FROM w) + 1) / (df + 1)) + 1 AS idf FROM df),
places AS (SELECT doc_id, w, no, label, base, words, phrase, i - key_at AS s, i FROM (
  SELECT doc_id, w, t.*, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i:i + len(phrase) - 1] = phrase)) AS i
  FROM w JOIN t ON list_contains(w, phrase[1]))),
each_word AS (SELECT *, unnest(range(1, len(words) + 1)) AS k FROM places),
scored AS (SELECT e.doc_id, no, label, base, i, sum(CASE WHEN s + k - 1 >= 1 AND w[CASE WHEN s + k - 1 >= 1 THEN s + k - 1 ELSE 1 END] = words[k]
    THEN idf ELSE 0 END) / sum(idf) AS score
  FROM each_word e JOIN idf ON idf.word = words[k] GROUP BY ALL),
good AS (SELECT * FROM scored WHERE score >= {ENOUGH})
SELECT w.doc_id, CAST(len(any_value(w.w)) AS BIGINT) AS n_words, count(*) FILTER (base) AS n_base,
  min(i - 1) FILTER (base) AS first_word, max(i - 1) FILTER (base) AS last_word,
  coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (base)), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list(DISTINCT label) FILTER (label IS NOT NULL)), ','), '') AS labels,
  round(coalesce(max(score), 0), 6) AS score
FROM w LEFT JOIN good ON w.doc_id = good.doc_id GROUP BY w.doc_id
"""


@query("op5_license_scan", _oracle())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("hits", lambda h: h["base"])
    starts = F.transform(base, lambda h: h["start"])
    labels = lambda hits: F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("hits")).alias("labels"),
        F.round(F.coalesce(F.array_max(F.transform("hits", lambda h: h["score"])), F.lit(0.0)), 6).alias("score"),
    )
