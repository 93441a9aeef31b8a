"""License scan: phrases, and an exact set-similarity join with notice templates.

A document is cut into overlapping blocks of words per template, 2.5 template lengths
long, one every 1.25: only runs of up to 1.25 template lengths are sure to lie in one
block, a longer one matches or not depending on where it starts. A block matches a
template if it holds at least ``CONTAINMENT`` of the template's distinct words.
Template words are ordered by their frequency in the whole corpus, rarest first. A
matching block must hold one of the first ``n - need + 1`` of them (prefix filter),
have at least ``need`` words (length filter), and its rarest template word must
leave enough words after it in the template and in the block (positional filter).
Only documents with a prefix word are looked at block by block; the filters lose no
match. The templates are fixed and small, hence constants of the plan: the join
shuffles no text. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlens.llm.common import text_or_empty

PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)
# Usual notices of common licenses.
TEMPLATES = (
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of"
               " the license at http www apache org licenses license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are"
            " permitted provided that the following conditions are met"),
    ("cc", "licensed under cc by nc 4 0"),
    ("cc", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of"
            " the gnu general public license as published by the free software foundation"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this"
            " software and associated documentation files to deal in the software without restriction"),
)
CONTAINMENT = 0.85
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, UPPER, UPPER.lower()), SEPARATORS), "")


def distinct_words(template: str) -> list[str]:
    return sorted(set(template.split()))


def needed(n: int, containment: float = CONTAINMENT) -> int:
    return max(1, math.ceil(containment * n - 1e-9))


def block_words(template: str) -> tuple[int, int]:
    """Length and step of the blocks: any run of 1.25 times the template's words lies
    in some block."""
    step = math.ceil(1.25 * len(template.split()))
    return 2 * step, step


def template_frequencies(words: DataFrame, templates=TEMPLATES) -> dict[str, int]:
    """Occurrences in the whole corpus of the templates' words (a fixed number)."""
    names = sorted({w for _, t in templates for w in t.split()})
    rows = words.select(F.explode("words").alias("w")).where(F.col("w").isin(names)).groupBy("w").count()
    return {r["w"]: r["count"] for r in rows.collect()}


def _constants(names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def best_containment(words: Column, template: str, counts: dict[str, int], containment: float) -> Column:
    """Largest containment among the matching blocks, null if no block matches."""
    names = sorted(distinct_words(template), key=lambda w: (counts.get(w, 0), w))
    need = needed(len(names), containment)
    prefix = names[: len(names) - need + 1]
    size, step = block_words(template)

    def held(start: Column) -> Column:
        block = F.slice(words, start, size)
        # Rank of the rarest template word in the block; the words after it bound
        # what the block can still hold.
        rank = F.array_min(F.transform(F.array_intersect(_constants(prefix), block), lambda w: F.array_position(_constants(names), w)))
        bound = F.least(F.lit(len(names)) - rank + 1, F.size(block))
        return F.when(
            bound >= need, F.size(F.array_intersect(_constants(names), block)) / F.lit(len(names))
        )

    starts = F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)), F.lit(step))
    best = F.array_max(F.transform(starts, held))
    return F.when(
        (F.size(words) >= need) & F.arrays_overlap(words, _constants(prefix)),
        F.when(best >= F.lit(need / len(names)) - 1e-9, best),
    )


def phrase_starts(words: Column, phrase: str) -> Column:
    parts = phrase.split()

    def here(i: Column) -> Column:
        test = F.lit(True)
        for k, part in enumerate(parts):
            test = test & (F.get(words, i + k) == part)
        return test

    places = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), here)
    may = (F.size(words) >= len(parts)) & F.array_contains(words, parts[-1]) & F.array_contains(words, parts[0])
    return F.when(may, places).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, containment: float = CONTAINMENT) -> DataFrame:
    """One row per input row, with phrase places, labels and the best containment.

    Null texts count as empty (no words, no labels, score 0). Only doc_id and text are
    read. score is the largest containment of a matching block, 1 with a phrase.
    """
    words = docs.select("doc_id", words_of(text_or_empty()).alias("words"))
    counts = template_frequencies(words, templates)
    w = F.col("words")
    out = words.withColumn("n_words", F.size(w).cast("bigint"))
    for i, (phrase, _) in enumerate(phrases):
        out = out.withColumn(f"p{i}", phrase_starts(w, phrase))
    for i, (_, template) in enumerate(templates):
        out = out.withColumn(f"t{i}", best_containment(w, template, counts, containment))
    starts = F.concat(*[F.col(f"p{i}") for i in range(len(phrases))])

    def joined(labels: list[Column]) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))), ",")

    base = [F.when(F.size(f"p{i}") > 0, label) for i, (_, label) in enumerate(phrases)]
    found = [F.when(F.col(f"t{i}").isNotNull(), label) for i, (label, _) in enumerate(templates)]
    return out.select(
        "doc_id", "n_words", starts.alias("starts"), joined(base).alias("base_labels"),
        joined([*base, *found]).alias("labels"),
        F.when(F.size(starts) > 0, 1.0).otherwise(
            F.greatest(F.lit(0.0), *[F.coalesce(f"t{i}", F.lit(0.0)) for i in range(len(templates))])
        ).alias("score"),
    ).select(
        "doc_id", "n_words", F.size("starts").cast("bigint").alias("n_base"),
        F.array_min("starts").cast("bigint").alias("first_word"),
        F.array_max("starts").cast("bigint").alias("last_word"), "base_labels", "labels", "score",
    )
