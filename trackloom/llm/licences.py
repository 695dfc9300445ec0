"""Licence scans with a positional index of rare words, in DataFrame functions only.

The words of the licence templates get inverse document frequencies from the whole corpus. Each
template is posted under the word of highest IDF among those of its mandatory key phrases. A file
looks up those of its licence words under which something is posted: each place where one stands
gives, by its position in the template, a place where the template would start. At these places all
other words of the template are intersected by relative position, and the key phrases must stand
where the template has them. A place that holds has all mandatory words, the posted one among them,
so none is lost, whatever other words of the template the file has replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import parts_counted

#: What parts the words of a lower-cased text.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ONE_NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    mandatory: tuple[str, ...]
    base: bool = False


# The base phrases and sentences of public licences.
BASE = (
    Template("mit", "under the mit license", ("under the mit license",), True),
    Template("apache-2", "apache license version 2", ("apache license version 2",), True),
    Template("cc-by-nc", "cc by nc", ("cc by nc",), True),
)
TEMPLATES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge",)),
    Template("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("www apache org licenses license 2 0",)),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license",)),
    Template("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-2", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee")),
    Template("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
)
#: The share of a template's words that must match, if it is not a base phrase.
SHARE = 0.75
RESULTS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places")


def lowered(text: Column) -> Column:
    """The text in lower case, with the same words of ASCII as in ASCII lower case: the two letters that would become ASCII don't."""
    return F.lower(F.replace(F.replace(text, F.lit("\u212a"), F.lit("\u00ff")), F.lit("\u0130"), F.lit("\u00ff")))


def document_frequencies(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> dict[str, int]:
    """Rows of docs in which each licence word stands; only these few sums leave Spark."""
    words = F.array_intersect(F.split(lowered(F.col(text_col)), NOT_WORD), F.array(*map(F.lit, vocabulary)))
    found = docs.select(F.explode(words).alias("word")).groupBy("word").count().collect()
    return dict.fromkeys(vocabulary, 0) | {r["word"]: r["count"] for r in found}


def key_positions(t: Template) -> list[int]:
    """Positions of the words of t's mandatory phrases."""
    return sorted({_position(t.text, m) + i for m in t.mandatory for i in range(len(m.split()))})


def postings(templates: tuple[Template, ...], frequency: dict[str, int]) -> list[tuple[str, int, int]]:
    """(word, template's number, position): the mandatory word of highest IDF of each template, ties by position."""
    out = []
    for number, t in enumerate(templates):
        words = t.text.split()
        at = min(key_positions(t), key=lambda i: (frequency[words[i]], i))
        out.append((words[at], number, at))
    return out


def scan(docs: DataFrame, templates: tuple[Template, ...] = BASE + TEMPLATES, text_col: str = "text", frequency: dict[str, int] | None = None) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score and places; columns of these names are replaced.

    places: array of (label, base, start, share) of the verified places. score is the largest share
    of a template's words found at one looked-up place (0 without any; 1 for a base phrase). A null
    or empty text has no words. Rows are kept as they are, repeated ones too; nothing is shuffled but
    the frequencies of the licence words. The templates' size is fixed, so their index is a literal.
    """
    vocabulary = sorted({w for t in templates for w in t.text.split()})
    frequency = frequency or document_frequencies(docs, vocabulary, text_col)
    index = postings(templates, frequency)
    lookups = sorted({w for w, _, _ in index}, key=lambda w: (frequency[w], w))
    posting = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(n).alias("t"), F.lit(i).alias("at")) for w, n, i in index])
    table = F.array(
        *[
            F.struct(
                F.lit(t.label).alias("label"),
                F.lit(t.base).alias("base"),
                F.array(*[F.lit(w) for w in t.text.split()]).alias("words"),
                F.array(*[F.struct(F.lit(_position(t.text, m)).alias("at"), F.lit(len(m.split())).alias("n")) for m in t.mandatory]).alias("mandatory"),
            )
            for t in templates
        ]
    )
    words_at, judged_at = "__trackloom_words", "__trackloom_judged"
    docs = docs.drop(*(x for x in RESULTS if x != text_col))
    text = F.col(text_col)
    lower_at, any_lookup = "__trackloom_lower", F.lit(False)
    for w in lookups:
        holds = F.col(lower_at).contains(w)
        any_lookup = any_lookup | (holds & F.col(lower_at).rlike(f"(?:^|{ONE_NOT_WORD}){w}(?:$|{ONE_NOT_WORD})") if len(w) < 3 else holds)
    words = F.filter(F.split(lower_at, NOT_WORD), lambda w: w != "")
    hits = F.filter(F.transform(words_at, lambda w, i: F.struct(i.alias("i"), w.alias("word"))), lambda x: F.array_contains(F.array(*map(F.lit, lookups)), x["word"]))
    starts = F.array_distinct(
        F.flatten(F.transform(hits, lambda h: F.transform(F.filter(posting, lambda p: p["word"] == h["word"]), lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["at"]).alias("start")))))
    )

    def judged(place: Column) -> Column:
        t = F.element_at(table, place["t"] + 1)
        at = lambda i: F.when(i >= 0, F.get(words_at, i))
        equal = F.transform(t["words"], lambda w, i: F.coalesce(at(place["start"] + i.cast("int")) == w, F.lit(False)))
        share = F.size(F.filter(equal, lambda e: e)) / F.size(equal)
        phrases = F.forall(t["mandatory"], lambda m: F.forall(F.slice(equal, m["at"] + 1, m["n"]), lambda e: e))
        return F.struct(t["label"].alias("label"), t["base"].alias("base"), place["start"].alias("start"), share.alias("share"), (phrases & (share >= F.when(t["base"], 1.0).otherwise(SHARE))).alias("holds"))

    def labels(places: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")

    none = F.array().cast("array<struct<label:string,base:boolean,start:int,share:double,holds:boolean>>")
    out = docs.withColumn("n_words", parts_counted(lowered(text), NOT_WORD))
    out = out.withColumn(lower_at, lowered(text)).withColumn(words_at, F.when(any_lookup, words)).drop(lower_at)
    out = out.withColumn(judged_at, F.when(F.col(words_at).isNotNull(), F.transform(starts, judged)).otherwise(none)).drop(words_at)
    places = F.filter(judged_at, lambda p: p["holds"])
    base = F.filter(places, lambda p: p["base"])
    at = F.transform(base, lambda p: p["start"].cast("long"))
    columns = {
        "n_base": F.size(base).cast("long"), "first_word": F.array_min(at), "last_word": F.array_max(at), "base_labels": labels(base), "labels": labels(places),
        "score": F.coalesce(F.array_max(F.transform(judged_at, lambda p: p["share"])), F.lit(0.0)), "places": places,
    }
    return out.withColumns(columns).drop(judged_at)


def _position(text: str, phrase: str) -> int:
    words, part = text.split(), phrase.split()
    return next(i for i in range(len(words)) if words[i : i + len(part)] == part)
