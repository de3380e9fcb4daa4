"""Licence scan by a positional index of rare words, in DataFrame operations only.

Templates of licence notices are indexed by word: (template, place). Document frequencies over all texts say which template words are rare. In each
text the rare words are looked up; each gives, for every posting, the place at which the template would begin. There the template's words are compared
place by place, and where enough agree, its mandatory phrase must stand in the matched stretch too.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pollwarden.llm.common import documents, folded

#: Notices in words, with the phrase that must be there, by label.
TEMPLATES = [
    ("mit", "released under the mit license", "mit license"),
    ("mit", "licensed under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
     "permission is hereby granted free of charge"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("apache-2", "you may not use this file except in compliance with the license", "in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
     "in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     "with or without fee"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
     "gnu general public license"),
    ("gpl", "licensed under the gnu general public license", "gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("mpl", "subject to the terms of the mozilla public license", "mozilla public license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "attribution sharealike"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "attribution noncommercial"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "released into the public domain"),
    ("proprietary", "all rights reserved", "all rights reserved"),
]
#: Phrases of the plain scan and their labels.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: Share of a template's words that must agree place by place, and share of texts up to which a word is rare.
AGREE, RARE = 0.8, 0.1
#: A place and a template share one long: place x WIDTH + template, or template x WIDTH + place.
SHIFT = 20
WIDTH = 1 << SHIFT
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a folded text."""
    return F.filter(F.split(text, GAP), lambda w: w != "")


def array_of(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def word_idf(docs: DataFrame, templates=TEMPLATES) -> dict[str, float]:
    """Inverse document frequency over all texts for every template word; at most one row for each of them comes back."""
    vocabulary = sorted({w for _, t, _ in templates for w in t.split()})
    seen = docs.select(F.array_intersect(F.split(folded(), GAP), array_of(vocabulary)).alias("ws"))
    counts = dict(seen.select(F.explode(F.concat("ws", F.array(F.lit("")))).alias("w")).groupBy("w").count().collect())
    n = counts.get("", 0)  # the empty word is added to every text: counts["" ] is the number of texts
    return {w: math.log((n + 1) / (counts.get(w, 0) + 1)) for w in vocabulary}


def lookup_words(idf: dict[str, float], templates=TEMPLATES) -> list[str]:
    """Rare words, and of each template the rarest, highest IDF first."""
    limit = math.log(1 / RARE)
    rare = {w for w, v in idf.items() if v >= limit}
    rare |= {max(t.split(), key=lambda w: (idf[w], w)) for _, t, _ in templates}
    return sorted(rare, key=lambda w: (-idf[w], w))


def scan(docs: DataFrame, columns: list[str], templates=TEMPLATES) -> DataFrame:
    """columns of docs, n_words, matches (array of label, start, score) and base (array of place, label).

    Null counts as empty, which has no word and no match. Texts are scanned row by row: repeated rows match alike, an empty table gives no
    rows, and other columns are not read. The only exchange is that of the word counts.
    """
    if len(templates) > WIDTH or any(not 0 < len(t.split()) <= WIDTH for _, t, _ in templates):
        raise ValueError(f"a template has 1 to {WIDTH} words, and there are at most {WIDTH} of them")
    idf = word_idf(docs, templates)
    looked = lookup_words(idf, templates)
    postings: dict[str, list[int]] = {}
    for k, (_, t, _) in enumerate(templates):
        for p, w in enumerate(t.split()):
            if w in looked:
                postings.setdefault(w, []).append(k * WIDTH + p)
    # a rare word's postings, as numbers template x WIDTH + place
    posting = F.create_map(*[x for w in looked for x in (F.lit(w), F.array(*[F.lit(c).cast("long") for c in postings[w]]))])
    texts = F.array(*[array_of(t.split()) for _, t, _ in templates])
    labels, keys = array_of([t[0] for t in templates]), array_of([f" {t[2]} " for t in templates])
    rows = docs.select(*columns, words_of(folded()).alias("ws")).select(
        *columns, "ws", F.size("ws").cast("long").alias("n_words"), F.concat(F.lit(" "), F.array_join("ws", " "), F.lit(" ")).alias("line"))
    places = F.sequence(F.lit(0), F.size("ws") - 1)
    found = F.arrays_overlap("ws", array_of(looked))
    hits = F.filter(places, lambda i: F.array_contains(array_of(looked), F.get("ws", i)))
    # where a template would begin, given a rare word's place: candidate = begin x WIDTH + template (begin may not be negative)
    begins = F.flatten(F.transform(hits, lambda i: F.transform(
        F.element_at(posting, F.get("ws", i)), lambda c: (i - c % WIDTH) * WIDTH + F.shiftright(c, SHIFT))))
    some = F.array_distinct(F.filter(begins, lambda b: b >= 0))

    def agreement(b: Column) -> Column:
        words = F.get(texts, (b % WIDTH).cast("int"))
        begin = F.shiftright(b, SHIFT).cast("int")
        same = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda j: F.get("ws", begin + j) == F.get(words, j))
        return F.size(same) / F.size(words)

    scored = F.filter(F.transform(some, lambda b: F.struct(b.alias("b"), agreement(b).alias("s"))), lambda m: m["s"] >= AGREE)

    def verified(m: Column) -> Column:
        k, begin = (m["b"] % WIDTH).cast("int"), F.shiftright(m["b"], SHIFT).cast("int")
        stretch = F.concat(F.lit(" "), F.array_join(F.slice("ws", begin + 1, F.size(F.get(texts, k))), " "), F.lit(" "))
        return F.contains(stretch, F.get(keys, k))

    matches = F.transform(F.filter(scored, verified), lambda m: F.struct(
        F.get(labels, (m["b"] % WIDTH).cast("int")).alias("label"), F.shiftright(m["b"], SHIFT).cast("int").alias("start"), m["s"].alias("score")))
    none = F.lit(None).cast("array<struct<label:string,start:int,score:double>>")
    no_place = F.from_json(F.lit("[]"), "array<struct<place:int,label:string>>")

    def places_of(phrase: str, label: str) -> Column:
        words = phrase.split()
        here = F.filter(places, lambda i: reduce(lambda a, b: a & b, [F.get("ws", i + j) == w for j, w in enumerate(words)]))
        marked = F.transform(here, lambda i: F.struct(i.cast("int").alias("place"), F.lit(label).alias("label")))
        return F.when(F.contains("line", F.lit(f" {phrase} ")), marked).otherwise(no_place)

    base = F.flatten(F.array(*[places_of(phrase, label) for phrase, label in BASE]))
    return rows.select(*columns, "n_words", F.when(found, matches).otherwise(none).alias("matches"), base.alias("base"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of every document, and where the plain phrases stand."""
    rows = scan(documents(spark, sf_dir), ["doc_id"])
    place = F.transform("base", lambda b: b["place"].cast("long"))
    plain = F.transform("base", lambda b: b["label"])
    more = F.coalesce(F.transform("matches", lambda m: m["label"]), F.array().cast("array<string>"))
    best = F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0))
    return rows.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(place).alias("first_word"), F.array_max(place).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(plain)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(plain, more))), ",").alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(best).alias("score"))
