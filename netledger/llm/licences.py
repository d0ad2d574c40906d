"""Licence scans by a positional index of rare words, DataFrame functions only.

Templates are licence notices as word sequences. One pass over all documents counts in how many of them each template word stands
(inverse document frequency). A file is then held against the index: of each template of which it has enough words, its LOOKUPS
words with the highest IDF are looked up; where the word stands in the file minus where the template has it is the place at
which the template would begin. Postings whose places agree (up to `gap` words for edits) intersect to a candidate; its stretch of
text must then hold the template's mandatory key phrases and enough of its words. The base phrases are templates without any
leeway: all words, at one and the same place.

A row is handled where it is read: nothing is exploded or shuffled but the word counts (at most one row per template word and
task), so neither copies nor long texts meet anywhere.

Defined cases: a null text is an empty one; a text without licence words has no labels and score 0; copies and rows that share an id
give one row each; the index is built from the documents given, an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, functions as F

#: Words of a file that are looked up per template.
LOOKUPS = 4
#: Share of a notice's different words that a file, and then the stretch, must have.
SHARE = 0.6
#: Words that may come in or go between two looked-up words of a notice.
GAP = 6
_CAPITALS, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Base labels and their phrases.
BASE = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
#: Label, words of the notice as published, mandatory key phrases.
NOTICES = (
    ("apache-2.0", "licensed under the apache license version 2.0", ("apache license",)),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at "
                   "http www apache org licenses license-2.0", ("in compliance with the license", "apache org licenses")),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
                   "license as published by the free software foundation", ("gnu general public license", "free software foundation")),
    ("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    ("agpl", "licensed under the gnu affero general public license", ("affero general public license",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "licensed under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation "
            "files the software to deal in the software without restriction", ("permission is hereby granted", "without restriction")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     ("permission to use copy modify", "with or without fee")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
            "conditions are met", ("redistribution and use in source", "conditions are met")),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0", ("mozilla public license",)),
    ("cc-by-4.0", "licensed under cc by 4.0", ("cc by 4",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4.0", ("cc by sa",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4.0", ("cc by nc",)),
    ("cc-by-nd-4.0", "licensed under cc by nd 4.0", ("cc by nd",)),
    ("cc-by-4.0", "licensed under the creative commons attribution 4.0 international license", ("creative commons attribution 4",)),
    ("cc0-1.0", "released under the creative commons zero cc0 1.0 universal public domain dedication", ("cc0 1 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
)


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    keys: tuple[str, ...]
    share: float = SHARE
    gap: int = GAP
    base: bool = False


def words_of(text: str) -> tuple[str, ...]:
    return tuple(w for w in re.split(_NO_WORD, text.translate(str.maketrans(_CAPITALS, _SMALL))) if w)


def default_templates() -> list[Template]:
    base = [Template(label, words_of(phrase), (phrase,), share=1.0, gap=0, base=True) for label, phrase in BASE.items()]
    return base + [Template(label, words_of(text), keys) for label, text, keys in NOTICES]


def split_words(text: Column) -> Column:
    """The words, with an empty one in front where the text begins with another character, and one at the end likewise."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), _CAPITALS, _SMALL), _NO_WORD)


def _present(words: Column, vocabulary: list[str]) -> Column:
    return F.array_distinct(F.filter(words, lambda w: w.isin(vocabulary)))


def document_counts(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Number of documents that hold each word (words in none are left out): one row per word."""
    words = docs.select(F.explode(_present(split_words(F.col("text")), vocabulary)).alias("word"))
    return {r["word"]: r["n"] for r in words.groupBy("word").agg(F.count("*").alias("n")).collect()}


def _index(templates: list[Template], counts: dict[str, int]) -> Column:
    """The templates as an array: words by falling IDF (fewest documents first), postings (word, position), what is asked for."""
    rows = []
    for t in templates:
        ranked = sorted(set(t.words), key=lambda w: (counts.get(w, 0), w))
        rows.append(F.struct(
            F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.lit(t.share).alias("share"), F.lit(t.gap).alias("gap"),
            F.lit(len(t.words)).alias("length"), F.lit(ceil(t.share * len(ranked))).alias("need"),
            F.array(*map(F.lit, ranked)).alias("ranked"),
            F.array(*[F.struct(F.lit(w).alias("word"), F.lit(k).alias("at")) for k, w in enumerate(t.words)]).alias("postings"),
            F.array(*[F.lit(f" {' '.join(words_of(k))} ") for k in t.keys]).alias("keys"),
        ))
    return F.array(*rows)


def _clusters(places: Column, gap: Column) -> Column:
    """(first, last, votes): runs of places, in order, no more than gap apart; votes has a bit for each word looked up."""
    empty = F.array().cast("array<struct<first:int,last:int,votes:int>>")
    start = F.struct(F.lit(0).alias("first"), F.lit(0).alias("last"), F.lit(0).alias("votes"), empty.alias("out"))
    ended = lambda acc: F.concat(acc["out"], F.array(F.struct(acc["first"].alias("first"), acc["last"].alias("last"), acc["votes"].alias("votes"))))

    def step(acc: Column, p: Column) -> Column:
        near = (acc["votes"] > 0) & (p["at"] - acc["last"] <= gap)
        return F.struct(
            F.when(near, acc["first"]).otherwise(p["at"]).alias("first"), p["at"].alias("last"),
            F.when(near, acc["votes"].bitwiseOR(p["bit"])).otherwise(p["bit"]).alias("votes"),
            F.when(near | (acc["votes"] == 0), acc["out"]).otherwise(ended(acc)).alias("out"),
        )

    return F.aggregate(places, start, step, ended)


def _placed(words: Column, lead: Column, n_words: Column, present: Column, t: Column) -> Column:
    """Verified placements of template t: array of (label, base, start, end, share); lead: empty words in front."""
    chosen = F.slice(F.filter(t["ranked"], lambda w: F.array_contains(present, w)), 1, LOOKUPS)
    hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda h: F.array_contains(chosen, h["word"]))
    places = F.array_sort(F.flatten(F.transform(hits, lambda h: F.transform(
        F.filter(t["postings"], lambda p: p["word"] == h["word"]),
        lambda p: F.struct((h["at"] - p["at"]).alias("at"),
                           F.call_function("shiftleft", F.lit(1), F.array_position(chosen, h["word"]).cast("int")).alias("bit")),
    ))))
    agreed = F.filter(_clusters(places, t["gap"]), lambda c: F.bit_count(c["votes"]) >= F.ceil(t["share"] * F.size(chosen)))
    begin = lambda c: F.greatest(c["first"] - t["gap"], F.lit(0))
    stretch = lambda c: F.slice(words, begin(c) + 1, F.greatest(c["last"] + t["length"] + t["gap"] - begin(c), F.lit(0)))
    spelled = F.transform(agreed, lambda c: F.struct(c["first"].alias("first"), c["last"].alias("last"), stretch(c).alias("words")))
    share = lambda c: F.size(F.array_intersect(c["words"], t["ranked"])) / F.size(t["ranked"])
    text = lambda c: F.concat(F.lit(" "), F.array_join(c["words"], " "), F.lit(" "))
    sure = F.filter(spelled, lambda c: (share(c) >= t["share"]) & F.forall(t["keys"], lambda k: F.contains(text(c), k)))
    return F.transform(sure, lambda c: F.struct(
        t["label"].alias("label"), t["base"].alias("base"), F.greatest(c["first"] - lead, F.lit(0)).cast("bigint").alias("start"),
        F.least(c["last"] + t["length"] - lead, n_words).cast("bigint").alias("end"), share(c).alias("share"),
    ))


def find(docs: DataFrame, templates: list[Template] | None = None) -> DataFrame:
    """The rows of docs (column row: a struct of their columns), n_words, places: array of (label, base, start, end, share)."""
    templates = default_templates() if templates is None else templates
    vocabulary = sorted({w for t in templates for w in t.words})
    index = _index(templates, document_counts(docs.select(docs["text"]), vocabulary))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), split_words(docs["text"]).alias("words"))
    ends = [(F.element_at("words", k) == "").cast("int") for k in (1, -1)]
    rows = rows.withColumns({"lead": ends[0], "present": _present(F.col("words"), vocabulary),
                             "n_words": F.when(F.size("words") > 1, F.size("words") - ends[0] - ends[1]).otherwise(1 - ends[0])})
    enough = F.filter(index, lambda t: F.size(F.array_intersect("present", t["ranked"])) >= t["need"])
    rows = rows.withColumn("likely", enough)
    none = F.array().cast("array<struct<label:string,base:boolean,start:bigint,end:bigint,share:double>>")
    found = F.flatten(F.transform("likely", lambda t: _placed(F.col("words"), F.col("lead"), F.col("n_words"), F.col("present"), t)))
    return rows.select("row", F.col("n_words").cast("bigint").alias("n_words"), F.when(F.size("likely") > 0, found).otherwise(none).alias("places"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_places per document row."""
    found = find(docs.select("doc_id", "text")).withColumn("at", F.expr("transform(filter(places, p -> p.base), p -> p.start)"))
    names = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    return found.select(
        "row.doc_id", "n_words", F.size("at").cast("bigint").alias("n_base"), F.array_min("at").alias("first_word"),
        F.array_max("at").alias("last_word"), names(F.filter("places", lambda p: p["base"])).alias("base_labels"),
        names(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"),
        F.size("places").cast("bigint").alias("n_places"),
    )
