"""License scans by a positional index of rare tokens.

Licence words are counted over all texts; the rarer a word, the more it tells. Of a text's licence words the rare ones are looked up in
the postings (word, template, position); in a text that has none of the rare words, the others are. Each hit says where its template
would start. A start stands if the rare words that are in place around it carry AGREE of the weight of all the template's rare words;
words may have been put in or left out, so a place may be off by SLACK. A start that stands is a label if the template's mandatory key
phrase is there too, word for word, and a licence word of the template outside the phrase. Everything is array expressions of the row itself, and the work grows with the hits.

So a key phrase alone is no notice. A notice of which some words were changed is one.

Cases: a null or empty text has no words and no label; repeated rows repeat; other columns are not read;
no rows in, none out (the word counts are then empty and every word weighs the same).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, text_of

#: Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Label, words of a notice, mandatory key phrase in it.
TEMPLATES = [
    ("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", "affero general public license"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache org licenses"),
    ("apache", "software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "as is basis without warranties or conditions"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation", "reproduce the above copyright notice"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("gpl", "licensed under the gnu general public license version 3", "gnu general public license"),
    ("gpl", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", "gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license", "lesser general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this permission notice shall be included"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("proprietary", "copyright all rights reserved", "all rights reserved"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
]

#: Words of notices that also fill ordinary prose; they have no postings.
COMMON = set("a above all an and any are as at be by either following for http in into is it kind list may must not of on or org shall the this to under use with without www you 0 2 3 4 v".split())

#: Share of the weight of a template's rare words that must be in place, and words by which a place may be off.
AGREE, SLACK = 0.6, 2
#: Rare are the licence words that at most this share of them outweighs.
RARE_SHARE = 0.75
#: A start is a number: the template times BASE_AT, and its first word; REACH, as a notice may be cut off at the text's beginning.
BASE_AT, REACH = 1 << 40, 64

NOT_WORDS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _postings() -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {}
    for t, (_, words, _) in enumerate(TEMPLATES):
        for at, word in enumerate(words.split()):
            if word not in COMMON:
                out.setdefault(word, []).append((t, at))
    return out


VOCABULARY = sorted(_postings())
#: Words of a template before its key phrase.
LEADS = [words.split().index(key.split()[0]) if words.startswith(key) else len(words[: words.index(f" {key}")].split()) for _, words, key in TEMPLATES]


def words_of(text: Column) -> Column:
    """Only A-Z among the characters that lower() changes bears on ASCII words, but for the Kelvin sign and the dotted I, which are put out of its way."""
    plain = F.regexp_replace(text, "[\\u212A\\u0130]", "\u00E5")
    return F.array_remove(F.split(F.lower(F.when(text.rlike("[\\u212A\\u0130]"), plain).otherwise(text)), NOT_WORDS), "")


def word_weights(df: DataFrame, text_col: str = "text") -> dict[str, float]:
    """Inverse document frequency of each licence word, counted over all texts."""
    vocabulary = F.array(*[F.lit(w) for w in VOCABULARY])
    seen = df.select(F.explode(F.array_append(F.array_intersect(words_of(text_of(text_col)), vocabulary), "")).alias("word"))
    counts = {r["word"]: r["count"] for r in seen.groupBy("word").count().collect()}  # a row a licence word
    total = counts.get("", 0)
    return {w: math.log((total + 1) / (counts.get(w, 0) + 0.5)) + 0.01 for w in VOCABULARY}


def _places(words: Column, phrase: list[str]) -> Column:
    """Starts of the phrase among the words."""

    def here(i: Column) -> Column:
        out = F.get(words, i) == phrase[-1]
        for back, word in enumerate(reversed(phrase[:-1]), 1):
            out = out & (F.get(words, i - back) == word)
        return out

    ends = F.filter(F.transform(words, lambda w, i: F.when(w == phrase[-1], i)), lambda i: i.isNotNull())
    return F.transform(F.filter(ends, here), lambda i: i - (len(phrase) - 1))


def rare_words(weights: dict[str, float]) -> list[str]:
    """The licence words of the highest weights; words that weigh as much as the last of them belong to them."""
    ranked = sorted((weights.get(w, 0.0) for w in VOCABULARY), reverse=True)
    least = ranked[min(len(ranked) - 1, int(RARE_SHARE * len(ranked)))]
    return [w for w in VOCABULARY if weights.get(w, 0.0) >= least]


def _starts(words: Column, weights: dict[str, float]) -> Column:
    """Where the postings of the text's rare licence words say that a template starts, as (template * BASE_AT + start + REACH), each once."""
    index = _postings()
    by_word = F.create_map(*[x for w in VOCABULARY for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).alias("p")) for t, p in index[w]]))])
    vocabulary, rare = (F.array(*[F.lit(w) for w in x]) for x in (VOCABULARY, rare_words(weights)))

    def look_up(hits: Column) -> Column:
        posted = lambda x: F.transform(F.element_at(by_word, x["w"]), lambda e: e["t"] * F.lit(BASE_AT) + (x["i"] - e["p"] + REACH))
        return F.array_distinct(F.flatten(F.transform(hits, posted)))

    def chosen(hits: Column) -> Column:
        return let(F.filter(hits, lambda x: F.array_contains(rare, x["w"])), lambda best: F.when(F.size(best) > 0, best).otherwise(hits))

    hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains(vocabulary, x["w"]))
    return let(let(hits, chosen), look_up)


def _template(code: Column) -> Column:
    return F.floor(code / F.lit(BASE_AT)).cast("int")


def _start(code: Column) -> Column:
    return (code % F.lit(BASE_AT) - REACH).cast("int")


def _placed(entry: list[tuple[int, str]]) -> Column:
    return F.array(*[F.struct(F.lit(j).alias("j"), F.lit(w).alias("w")) for j, w in entry])


def _confirmed(words: Column, starts: Column, weights: dict[str, float]) -> Column:
    """(label, share of the weight in place) of the starts that stand and have their key phrase."""
    rare = set(rare_words(weights))
    split = [text.split() for _, text, _ in TEMPLATES]
    # A template without a rare word is judged by all its licence words, as a text without one is.
    judged_by = [[(j, w) for j, w in enumerate(text) if w in rare] or [(j, w) for j, w in enumerate(text) if w not in COMMON] for text in split]
    labels = F.array(*[F.lit(label) for label, _, _ in TEMPLATES])
    texts = F.array(*[F.array(*[F.struct(F.lit(j).alias("j"), F.lit(w).alias("w"), F.lit(float(weights.get(w, 0.0))).alias("weight")) for j, w in entry]) for entry in judged_by])
    wholes = F.array(*[F.lit(float(sum(weights.get(w, 0.0) for _, w in entry))) for entry in judged_by])
    keys, lead = F.array(*[F.array(*[F.lit(w) for w in key.split()]) for _, _, key in TEMPLATES]), F.array(*[F.lit(n) for n in LEADS])
    others = F.array(*[_placed([(j, w) for j, w in enumerate(text) if w not in COMMON and not lead <= j < lead + len(key.split())]) for text, lead, (_, _, key) in zip(split, LEADS, TEMPLATES, strict=True)])
    offs = F.array(*[F.lit(d) for d in sorted(range(-SLACK, SLACK + 1), key=abs)])

    def judged(code: Column) -> Column:
        t, at = _template(code), _start(code)
        word = lambda i: F.when(i >= 0, F.get(words, F.greatest(i, F.lit(0))))
        near = lambda x: F.exists(offs, lambda d: F.coalesce(word(at + x["j"] + d) == x["w"], F.lit(False)))
        votes = F.aggregate(F.filter(F.get(texts, t), near), F.lit(0.0), lambda a, x: a + x["weight"])

        def with_key(share: Column) -> Column:
            key, first = F.get(keys, t), at + F.get(lead, t)
            stands = F.exists(offs, lambda d: (first + d >= 0) & (F.slice(words, F.greatest(first + d, F.lit(0)) + 1, F.size(key)) == key))
            more = F.exists(F.get(others, t), near)
            return F.struct(F.get(labels, t).alias("label"), share.alias("share"), ((share >= AGREE) & more & stands).alias("enough"))

        return let(F.least(F.coalesce(F.try_divide(votes, F.get(wholes, t)), F.lit(0.0)), F.lit(1.0)), with_key)

    return F.filter(F.transform(starts, judged), lambda x: x["enough"])


def scan_licenses(df: DataFrame, weights: dict[str, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each row."""
    rows = df.select(F.col(id_col).alias("doc_id"), words_of(text_of(text_col)).alias("words"))
    vocabulary = F.array(*[F.lit(w) for w in VOCABULARY])
    some = F.size(F.array_intersect(F.col("words"), vocabulary)) > 0
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), F.when(some, F.col("words")).alias("words"))
    found = F.array(*[F.struct(F.lit(label).alias("label"), _places(F.col("words"), phrase.split()).alias("at")) for phrase, label in BASE.items()])
    wide = let(_starts(F.col("words"), weights), lambda s: _confirmed(F.col("words"), s, weights))
    rows = rows.select("doc_id", "n_words", F.when(F.col("words").isNotNull(), F.struct(found.alias("base"), wide.alias("wide"))).alias("hit"))
    starts = F.flatten(F.col("hit.base.at"))
    base = F.transform(F.filter(F.col("hit.base"), lambda x: F.size(x["at"]) > 0), lambda x: x["label"])
    none = F.array().cast("array<string>")
    rows = rows.select(
        "doc_id",
        "n_words",
        F.coalesce(F.size(starts), F.lit(0)).alias("n"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.coalesce(base, none))).alias("base"),
        F.coalesce(F.col("hit.wide"), F.array().cast("array<struct<label:string,share:double,enough:boolean>>")).alias("wide"),
    )
    every = F.array_sort(F.array_union(F.col("base"), F.transform("wide", lambda x: x["label"])))
    best = F.coalesce(F.array_max(F.transform("wide", lambda x: x["share"])), F.lit(0.0))
    return rows.select(
        "doc_id",
        "n_words",
        F.greatest(F.col("n"), F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(best).alias("score"),
    )
