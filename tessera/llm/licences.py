"""Licence notices found through the rare words of templates, without a shuffle of texts.

Templates are word sequences with a label and mandatory key phrases. How rare a word of theirs is, is counted over all
documents. Each template is posted under its rarest words with their positions; a file's words that have postings are
looked up, rarest first, and each posting names the place where its template would start. At such a place the template's
posted words are intersected with the file's by relative position; where their weighted share reaches ``least_share`` and every
key phrase of the template stands word by word at its own place, the notice counts as found.

A base phrase is a template that is its own key phrase. A phrase holds all its words wherever it stands, its rarest among
them, so no place of a base phrase is missed. Work in a row grows with its hits; nothing gathers rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: upper case letters, and what parts words once they are lower case
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: fixed values: base phrases and their labels
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: fixed values: sentences of public licences and notices, as words; what stands in brackets is mandatory
NOTICES = (
    ("mit", "[permission is hereby granted free of charge] to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "[to deal in the software without restriction] including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "[spdx license identifier mit]"),
    ("apache", "[licensed under the apache license version 2 0]"),
    ("apache", "[you may not use this file except in compliance with the license] you may obtain a copy of the license at"),
    ("apache", "[spdx license identifier apache 2 0]"),
    ("gpl", "[you can redistribute it and or modify it under the terms of the gnu general public license] as published by the free software foundation"),
    ("gpl", "[spdx license identifier gpl]"),
    ("lgpl", "[gnu lesser general public license]"),
    ("lgpl", "[spdx license identifier lgpl]"),
    ("agpl", "[gnu affero general public license]"),
    ("agpl", "[spdx license identifier agpl]"),
    ("bsd", "[redistribution and use in source and binary forms with or without modification] are permitted provided that the following conditions are met"),
    ("bsd", "[neither the name of] the copyright holder nor the names of its contributors may be used to [endorse or promote products derived from this software]"),
    ("bsd", "[spdx license identifier bsd]"),
    ("isc", "[permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted]"),
    ("mpl", "[subject to the terms of the mozilla public license]"),
    ("mpl", "[spdx license identifier mpl]"),
    ("epl", "[eclipse public license]"),
    ("unlicense", "[this is free and unencumbered software released into the public domain]"),
    ("zlib", "this software is [provided as is without any express or implied warranty in no event will the authors be held liable]"),
    ("cc0", "[cc0 1 0 universal]"),
    ("cc-by", "[creative commons attribution] 4 0 international"),
    ("cc-by", "[licensed under cc by 4 0]"),
    ("cc-by-sa", "[creative commons attribution sharealike]"),
    ("cc-by-sa", "[licensed under cc by sa]"),
    ("cc-by-nc", "[creative commons attribution noncommercial]"),
    ("cc-by-nc", "[licensed under cc by nc]"),
    ("cc-by-nd", "[licensed under cc by nd]"),
)


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    #: (first, last + 1) of each mandatory phrase
    keys: tuple[tuple[int, int], ...]
    base: bool = False


def template(label: str, marked: str, base: bool = False) -> Template:
    """A template from words with brackets around the mandatory phrases."""
    words, keys = [], []
    for part in marked.replace("[", "\n[").replace("]", "]\n").split("\n"):
        own = part.strip("[]").split()
        if part.startswith("[") and own:
            keys.append((len(words), len(words) + len(own)))
        words += own
    return Template(label, tuple(words), tuple(keys), base)


def templates() -> list[Template]:
    return [template(label, f"[{phrase}]", True) for phrase, label in BASE.items()] + [template(label, text) for label, text in NOTICES]


def words_of(text: Column) -> Column:
    """A text's words in order, A-Z in lower case; none for null."""
    parts = F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), _APART)
    return F.filter(parts, lambda w: w != "")


def _literal(words) -> Column:
    return F.array(*(F.lit(w) for w in words))


def document_frequencies(docs: DataFrame, known: list[Template], text_col: str = "text") -> tuple[int, dict[str, int]]:
    """How many documents there are, and how many hold each word of the templates: one value for each word of a fixed list."""
    vocabulary = sorted({w for t in known for w in t.words})
    held = F.explode_outer(F.array_intersect(words_of(F.col(text_col)), _literal(vocabulary)))
    n = docs.count()
    return n, {r[0]: r[1] for r in docs.select(held.alias("w")).where("w is not null").groupBy("w").count().collect()}


def _postings(known: list[Template], n: int, df: dict[str, int], rare: int) -> list[list[int]]:
    """For each template the positions of its ``rare`` rarest words, rarest first; of equally rare ones the smallest word, then the first place."""
    return [sorted(range(len(t.words)), key=lambda p: (df.get(t.words[p], 0), t.words[p], p))[:rare] for t in known]


_SHIFT = 40


def found_places(words: Column, known: list[Template], posted: list[list[int]], weight: dict[str, float], least_share: float) -> Column:
    """``array<struct<t, start, share>>`` of verified places in a row's words; t numbers the templates."""
    listed: dict[str, list[int]] = {}
    for t, places in enumerate(posted):
        for p in places:
            listed.setdefault(known[t].words[p], []).append((t << _SHIFT) - p)
    rarest_first = sorted(listed, key=lambda w: (-weight[w], w))
    index = F.create_map(*(x for w in rarest_first for x in (F.lit(w), F.array(*(F.lit(v).cast("long") for v in listed[w])))))
    anchors = _literal(rarest_first)
    hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.cast("long").alias("i"))), lambda h: F.array_contains(anchors, h.w))
    # template and start in one number, so that equal ones fall together by hash
    named = F.array_distinct(F.flatten(F.transform(hits, lambda h: F.transform(index[h.w], lambda v: v + h.i))))
    offset = 1 << (_SHIFT - 1)
    places = F.transform(named, lambda v: F.struct(F.shiftright(v + offset, _SHIFT).cast("int").alias("t"), (v - F.shiftleft(F.shiftright(v + offset, _SHIFT), _SHIFT)).alias("start")))
    table = F.array(
        *(
            F.struct(
                F.array(*(F.struct(F.lit(p).alias("p"), F.lit(t.words[p]).alias("w"), F.lit(weight[t.words[p]]).alias("g")) for p in mine)).alias("rare"),
                F.lit(reduce(add, (weight[t.words[p]] for p in mine), 0.0)).alias("all"), F.lit(len(t.words)).alias("long"),
                F.array(*(F.struct(F.lit(a).alias("a"), _literal(t.words[a:b]).alias("words")) for a, b in t.keys)).alias("keys"),
            )
            for t, mine in zip(known, posted, strict=True)
        )
    )

    def verified(x: Column) -> Column:
        own = F.get(table, x.t)
        shared = F.aggregate(own["rare"], F.lit(0.0), lambda s, r: s + F.when(F.get(words, (x.start + r.p).cast("int")) == r.w, r.g).otherwise(0.0))
        keyed = F.forall(own["keys"], lambda k: F.slice(words, (x.start + k.a + 1).cast("int"), F.size(k.words)) == k.words)
        return F.when((x.start >= 0) & keyed, F.least(F.lit(1.0), shared / own["all"]))

    scored = F.transform(F.filter(places, lambda x: x.start >= 0), lambda x: F.struct(x.t.alias("t"), x.start.alias("start"), verified(x).alias("share")))
    # texts without any posted word make no structs at all
    none = F.array().cast("array<struct<t:int,start:bigint,share:double>>")
    return F.when(F.arrays_overlap(words, anchors), F.filter(scored, lambda x: x.share >= least_share)).otherwise(none)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: list[Template] | None = None, rare: int = 6, least_share: float = 0.8) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places)`` for each row.

    places lists (label, start, share) of every notice found; n_base counts the places of base phrases, first_word and last_word are their smallest and largest
    start (null without one). Labels are distinct, sorted and joined by commas, empty if none; score is the largest share of a notice's weight that was met, 0 without one.
    Null and empty texts have no words. Repeated ids and rows give a row each; an empty table gives none.
    """
    known = sorted(templates() if known is None else known, key=lambda t: not t.base)
    n, df = document_frequencies(docs, known, text_col)
    weight = {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1e-9 for t in known for w in t.words}
    posted = _postings(known, n, df, rare)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    rows = rows.withColumn("found", found_places(F.col("words"), known, posted, weight, least_share))
    labels = _literal(t.label for t in known)
    n_base = sum(t.base for t in known)
    base = F.filter("found", lambda x: x.t < n_base)

    def joined(places: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda x: F.get(labels, x.t)))), ",")

    return rows.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda x: x.start)).alias("first_word"), F.array_max(F.transform(base, lambda x: x.start)).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("found")).alias("labels"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x.share)), F.lit(0.0)).alias("score"),
        F.array_sort(F.transform("found", lambda x: F.struct(x.start.alias("start"), F.get(labels, x.t).alias("label"), x.share.alias("share")))).alias("places"),
    )
