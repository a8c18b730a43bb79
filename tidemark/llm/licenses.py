"""License scans by a positional rare-token index, in DataFrame functions only.

Each template is a notice and a mandatory key phrase inside it. A file is a candidate for a template if it
has all words of the key phrase. The template's word of the highest IDF over the corpus is looked up in
the file; each place gives a relative position of the template, at which the key phrase must stand
consecutively. The share of the notice's words that stand in their places is the score.

Null and empty texts have no words and no labels. A phrase that occurs often counts at every place.
Rows with the same doc_id are scanned apart. IDF ties go to the word that stands first in the template.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged

#: Only these are folded.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The least share of a notice's words in place for a label of the method's own.
IN_PLACE = 0.5


@dataclass(frozen=True)
class Template:
    label: str
    notice: str
    key: str


#: Phrases whose every place counts. Fixed values.
BASE = (
    Template("mit", "under the mit license", "under the mit license"),
    Template("apache-2", "apache license version 2", "apache license version 2"),
    Template("cc-by-nc", "cc by nc", "cc by nc"),
)
#: Notices as licences ask for them, lower-cased and without punctuation. Fixed values.
NOTICES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    Template("mit", "licensed under the mit license", "the mit license"),
    Template("apache-2", "licensed under the apache license version 2 0", "the apache license version 2"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("gpl", "licensed under the gnu general public license version", "gnu general public license"),
    Template("lgpl", "licensed under the gnu lesser general public license version", "gnu lesser general public license"),
    Template("agpl", "licensed under the gnu affero general public license version", "gnu affero general public license"),
    Template("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    Template("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("all-rights-reserved", "copyright all rights reserved", "all rights reserved"),
)


def _strings(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def _has_all(present: Column, t: Template) -> Column:
    return F.size(F.array_except(_strings(t.key.split()), present)) == 0


def corpus_idf(present: DataFrame, column: str, total: int) -> dict[str, float]:
    """IDF of the template words; as many rows as there are template words reach the driver."""
    rows = present.select(F.explode(column).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    return {r.word: math.log((1 + total) / (1 + r.n)) for r in rows}


def _starts(words: Column, t: Template, idf: dict[str, float]) -> Column:
    """Relative positions of the template at which its key phrase stands, by its rarest word."""
    notice, key = t.notice.split(), t.key.split()
    shift = next(i for i in range(len(notice)) if notice[i : i + len(key)] == key)
    rare = max(range(len(key)), key=lambda i: (idf.get(key[i], math.inf), -i))
    places = F.filter(F.transform(words, lambda w, i: F.when(w == key[rare], i - rare)), lambda i: i.isNotNull() & (i >= 0))
    return F.transform(F.filter(places, lambda i: F.slice(words, i + 1, len(key)) == _strings(key)), lambda i: i - shift)


def _in_place(words: Column, start: Column, t: Template) -> Column:
    notice = t.notice.split()
    hits = [F.coalesce((F.get(words, start + i) == w).cast("int"), F.lit(0)) for i, w in enumerate(notice)]
    return sum(hits[1:], hits[0]) / F.lit(float(len(notice)))


def _shares(starts: Column, words: Column, t: Template) -> Column:
    return F.transform(starts, lambda s: _in_place(words, s, t))


def scan(docs: DataFrame, base: tuple[Template, ...] = BASE, notices: tuple[Template, ...] = NOTICES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row."""
    every = (*base, *notices)
    vocabulary = list(dict.fromkeys(w for t in every for w in t.key.split()))
    words = docs.select("doc_id", F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), UPPER, UPPER.lower()), F.lit(WORD), F.lit(0)).alias("words"))
    present = words.select("doc_id", "words", F.array_intersect("words", _strings(vocabulary)).alias("present"))
    candidate = F.lit(False)
    for t in every:
        candidate = candidate | _has_all(F.col("present"), t)
    index = staged(present.select("doc_id", F.size("words").cast("long").alias("n_words"), "present", F.when(candidate, F.col("words")).alias("words")), "licenses")
    idf = corpus_idf(index, "present", index.count())

    none = F.array().cast("array<int>")

    def starts(t: Template) -> Column:
        return F.when(F.col("words").isNotNull() & _has_all(F.col("present"), t), _starts(F.col("words"), t, idf)).otherwise(none)

    found = index.select("doc_id", "n_words", "words", *(starts(t).alias(f"t{i}") for i, t in enumerate(every)))
    places = F.concat(*(F.col(f"t{i}") for i in range(len(base))))
    base_labels = F.array_compact(F.array(*(F.when(F.size(f"t{i}") > 0, F.lit(t.label)) for i, t in enumerate(base))))
    best = [F.coalesce(F.array_max(_shares(F.col(f"t{i}"), F.col("words"), t)), F.lit(0.0)).alias(f"s{i}") for i, t in enumerate(every)]
    scored = found.select("doc_id", "n_words", places.alias("places"), base_labels.alias("base_labels"), *best)
    own = F.array_compact(F.array(*(F.when(F.col(f"s{i}") >= IN_PLACE, F.lit(t.label)) for i, t in enumerate(every) if i >= len(base))))
    score = F.greatest(*(F.col(f"s{i}") for i in range(len(every))))

    def text(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    return scored.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        text(F.col("base_labels")).alias("base_labels"), text(F.concat("base_labels", own)).alias("labels"), score.alias("score"),
    )
