"""Licence passages in texts by a positional index of rare words (native).

A template is a short passage with a label and the key phrases that must stand in it. The index holds the places of each
template's words; how rare a word is comes from counts over all texts. In a file, the occurrences of the highest-IDF
licence words are looked up (for each template, the rarest word that it cannot do without), each posting gives a place
where its template would begin, and a place counts when enough of the template's rare words stand at their relative
positions and every key phrase stands in full. The index is as large as the templates, so it travels inside the plan; a
text is scanned inside its row and is never shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from depvital.llm.common import named

#: What stands between words: a word is a longest run of characters that are not among these.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rare words of a template that are compared by position, and the share of them that must agree.
RARE_WORDS = 6
AGREE = 0.5
#: A place is one number: the template times this, plus where it begins (which may lie before the text).
_TEMPLATE, _START = 1 << 40, 1 << 20


@dataclass(frozen=True)
class Template:
    """Words of a passage, single blanks between them; `phrases` are parts of the passage that must stand in full."""

    label: str
    passage: str
    phrases: tuple[str, ...]
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.passage.split(" ")

    @property
    def key_places(self) -> list[int]:
        """Positions of the words of all key phrases (their first occurrences in the passage)."""
        found: set[int] = set()
        for phrase in self.phrases:
            part = phrase.split(" ")
            start = next(i for i in range(len(self.words)) if self.words[i : i + len(part)] == part)
            found |= set(range(start, start + len(part)))
        return sorted(found)


def exact(label: str, phrase: str) -> Template:
    """A phrase that only counts as a whole."""
    return Template(label, phrase, (phrase,), True)


# --- fixed values: phrases of the base labels, then the wording of well-known licence notices ---
BASE = (
    exact("cc-by", "cc by"),
    exact("gpl", "general public license"),
    exact("reserved", "all rights reserved"),
)
NOTICES = (
    Template("agpl", "under the terms of the gnu affero general public license", ("affero general public license",)),
    Template("apache", "licensed under the apache license version 2 0", ("apache license",)),
    Template(
        "apache",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
        ("required by applicable law", "distributed on an as is basis"),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("epl", "under the terms of the eclipse public license", ("eclipse public license",)),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template(
        "gpl-notice",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        ("gnu general public license", "free software foundation"),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ("with or without fee is hereby granted",),
    ),
    Template("lgpl", "under the terms of the gnu lesser general public license", ("lesser general public license",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template(
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        ("permission is hereby granted free of charge", "this software and associated documentation files"),
    ),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license", ("mozilla public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("released into the public domain",)),
)


def words_of(text: Column) -> Column:
    """Words of a text in order, in their own case; none for a null text."""
    # regexp_extract_all copies the whole text at each match, and translate is slow on whole texts
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def folded(word: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.translate(word, UPPER, LOWER)


def among(word: Column, words: Sequence[str]) -> Column:
    """Whether the folded word is one of the words; most words fail the fast test by lower case, which folds more letters."""
    return F.when(F.lower(word).isin(words), folded(word).isin(words)).otherwise(False)


def word_counts(texts: DataFrame, templates: Sequence[Template]) -> dict[str, int]:
    """In how many texts each word of the templates occurs; texts: column words. As many values as the templates have words."""
    vocabulary = sorted({w for t in templates for w in t.words})
    held = F.array_distinct(F.transform(F.filter("words", lambda w: among(w, vocabulary)), folded))
    counted = texts.select(F.explode(held).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return {r["word"]: r["n"] for r in counted.collect()}


def rare_places(template: Template, counts: dict[str, int]) -> list[int]:
    """Positions of the template's rarest words, rarest first; a word that no text holds is not among them."""
    held = [p for p, w in enumerate(template.words) if counts.get(w)]
    return sorted(held, key=lambda p: (counts[template.words[p]], template.words[p], p))[:RARE_WORDS]


def agreeing(template: Template, rare: int) -> int:
    """How many of its rare words must stand in place."""
    return rare if template.base else max(1, int(rare * AGREE + 0.5))


def _index(templates: Sequence[Template], counts: dict[str, int]) -> tuple[Column, Column, list[str]]:
    """Postings of the words that are looked up, the templates, and those words.

    Every place holds all words of the key phrases, so the rarest of them leads to all places of its template; a template
    with a key word that no text holds is nowhere.
    """
    postings, passages, looked_up = [], [], set()
    for number, t in enumerate(templates):
        rare = rare_places(t, counts)
        lead = min(t.key_places, key=lambda p: (counts.get(t.words[p], 0), t.words[p], p))
        if counts.get(t.words[lead]):
            looked_up.add(t.words[lead])
            postings.append(F.struct(F.lit(t.words[lead]).alias("word"), F.lit(number).cast("long").alias("template"), F.lit(lead).alias("pos")))
        passages.append(
            F.struct(
                F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.lit(agreeing(t, len(rare))).alias("need"),
                F.array(*map(F.lit, t.words)).alias("words"), F.array(*map(F.lit, rare)).cast("array<int>").alias("rare"),
                F.array(*map(F.lit, t.key_places)).cast("array<int>").alias("keys"),
            )
        )
    return F.array(*postings), F.array(*passages), sorted(looked_up)


def scan_licenses(
    docs: DataFrame, templates: Sequence[Template] = BASE + NOTICES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_words, places) for each row; places: array of (label, base, start, share) sorted by start.

    start counts words from 0 and may lie before the text where the text begins inside a passage. share is how much of the
    passage stands in place, 1 for phrases that only count as a whole. Null and empty texts have no words and no places.
    Rows with null or repeated identifiers are scanned like others; other columns are not read. An empty table gives an
    empty result. One text with its words has to fit in a task's memory.
    """
    rows = docs.select(named(id_col).cast("long").alias("doc_id"), words_of(named(text_col).cast("string")).alias("words"))
    postings, passages, looked_up = _index(templates, word_counts(rows, templates))
    counted = rows.select("doc_id", "words", F.size("words").cast("long").alias("n_words"))
    words = F.col("words")
    if not looked_up:
        nothing = F.array().cast("array<struct<label:string,base:boolean,start:bigint,share:double>>")
        return counted.select("doc_id", "n_words", nothing.alias("places"))

    # where licence words stand, then where their templates would begin
    hits = F.filter(F.transform(words, lambda w, i: F.when(among(w, looked_up), i)), lambda i: i.isNotNull())
    of_word = lambda i: F.filter(postings, lambda p: p["word"] == folded(F.get(words, i)))
    begins = F.flatten(F.transform(hits, lambda i: F.transform(of_word(i), lambda p: p["template"] * _TEMPLATE + (i - p["pos"] + _START))))
    found = counted.withColumn("begins", F.array_sort(F.array_distinct(begins)))

    passage = lambda c: F.get(passages, F.floor(c / _TEMPLATE).cast("int"))
    start = lambda c: (F.pmod(c, F.lit(_TEMPLATE)) - _START).cast("int")
    stands = lambda c, p: folded(F.get(words, start(c) + p)).eqNullSafe(F.get(passage(c)["words"], p))

    def holds(c: Column) -> Column:
        agree = F.size(F.filter(passage(c)["rare"], lambda p: stands(c, p))) >= passage(c)["need"]
        return agree & F.forall(passage(c)["keys"], lambda p: stands(c, p))

    def place(c: Column) -> Column:
        in_place = F.size(F.filter(F.transform(passage(c)["words"], lambda w, p: folded(F.get(words, start(c) + p)).eqNullSafe(w)), lambda x: x))
        share = in_place / F.size(passage(c)["words"])
        return F.struct(
            passage(c)["label"].alias("label"), passage(c)["base"].alias("base"), start(c).cast("long").alias("start"), share.alias("share")
        )

    places = F.transform(F.filter("begins", holds), place)
    return found.select("doc_id", "n_words", places.alias("places"))


def license_labels(scanned: DataFrame) -> DataFrame:
    """Rows of `scan_licenses` as doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of base phrases, first_word and last_word are their smallest and largest start (null without
    any); labels are distinct, sorted and joined by commas (empty without any); score is the largest share, 0 without any.
    """
    of_base = F.filter("places", lambda p: p["base"])
    joined = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    starts = scanned.select("doc_id", "n_words", "places", F.transform(of_base, lambda p: p["start"]).alias("starts"))
    return starts.select(
        "doc_id",
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").alias("first_word"),
        F.array_max("starts").alias("last_word"),
        joined(of_base).alias("base_labels"),
        joined(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"),
    )
