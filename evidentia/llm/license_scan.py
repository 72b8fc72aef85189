"""License scans: exact phrases, and an exact set-similarity join against notice templates.

Words are runs of letters and digits, A-Z lower-cased, and all beyond ASCII. A text block is a line. The
join finds every block that contains at least `threshold` of a template's distinct words:

- words are ordered by how many candidate blocks hold them, rarest first, over all documents;
- prefix filter: a block and a template that share o words share one among the first |T| - o + 1 of the
  template and the first |B| - o + 1 of the block in that order, where o is what the threshold asks;
- length filter: a block with fewer than o template words is out;
- positional filter: from the places of the shared word, what can still be shared has to reach o.

A notice may also wrap. The lines up to an empty one are read as one run of words, and a template matches where
a span of at most its own number of words over `threshold` holds at least `threshold` of its distinct words in
their order, so that words merely scattered over lines do not. Spans are looked for in overlapping windows of
twice the longest of them that pass by the set of their words. `matched_lines` counts single lines alone.

What passes is verified by the size of the intersection. Only words of some template count for a block, as
no other can be shared. Templates are a parameter, so their words, counts and prefixes are small; blocks
are never gathered.

Defined results: a null text has no words, labels are an empty string and places null; templates without
words match nothing; repeated rows stay repeated; extra columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import materialise

GAPS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EMPTY_LINE = r"\n[ \t\r]*\n"
THRESHOLD = 0.8

# Phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

# Published notice lines and the labels of the method.
TEMPLATES = (
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0"),
    ("bsd-notice", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc-4.0-notice", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa-4.0-notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("gpl-3-notice", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-or-later-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit-notice", "Released under the MIT License"),
    ("mpl-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, GAPS), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: str) -> list[str]:
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if c in UPPER else c for c in text))


def _phrase_columns(df: DataFrame, phrases) -> DataFrame:
    """n_base, first_word, last_word and base_labels from `said`: every word between spaces of its own."""
    total, firsts, lasts, labels = F.lit(0), [], [], []
    for phrase, label in phrases:
        own = phrase.split()
        wrapped = "".join(f" {w} " for w in own)
        places = ((F.length("said") - F.length(F.replace(F.col("said"), F.lit(wrapped), F.lit("")))) / len(wrapped)).cast("long")
        before = lambda part: ((F.length(part) - F.length(F.translate(part, " ", ""))) / 2).cast("long")
        total = total + places
        firsts.append(F.when(places > 0, before(F.substring_index("said", wrapped, 1))))
        lasts.append(F.when(places > 0, F.col("n_words") - len(own) - before(F.substring_index("said", wrapped, -1))))
        labels.append(F.when(places > 0, F.lit(label)))
    has = F.col("said").isNotNull()
    return df.withColumns(
        {
            "n_base": F.when(has, total).otherwise(F.lit(0)).cast("long"),
            "first_word": F.when(has, F.array_min(F.array(*firsts))),
            "last_word": F.when(has, F.array_max(F.array(*lasts))),
            "base_labels": F.when(has, F.array_sort(F.array_compact(F.array(*labels)))).otherwise(F.array().cast("array<string>")),
        }
    )


def wrapped(text: Column, templates=TEMPLATES, threshold: float = THRESHOLD) -> Column:
    """Array of (label, containment) of the templates that stand in order in a paragraph of several lines."""
    none = F.array().cast("array<struct<label:string,containment:double>>")
    sets = [(label, list(dict.fromkeys(words_of(t))), len(words_of(t))) for label, t in templates if words_of(t)]
    if not sets:
        return none
    needs = [math.ceil(threshold * len(own) - 1e-9) for _, own, _ in sets]
    spans = [math.floor(size / threshold + 1e-9) for _, _, size in sets]
    literal = lambda own: F.array(*map(F.lit, own))
    known = literal(sorted({w for _, own, _ in sets for w in own}))
    step = max(spans)
    paragraphs = F.filter(F.split(text, EMPTY_LINE), lambda p: p.contains("\n") & (F.length(p) >= 2 * min(needs) - 1))
    starts = lambda w: F.sequence(F.lit(1), F.greatest(F.size(w) - step, F.lit(1)), F.lit(step))
    cut = lambda w: F.transform(starts(w), lambda i: F.slice(w, i, 2 * step))
    windows = F.filter(F.flatten(F.transform(F.transform(paragraphs, lambda p: words(ascii_lower(p))), cut)), lambda w: F.size(F.array_intersect(w, known)) >= min(needs))

    def in_order(window: Column, own: list[str], span: int) -> Column:
        """The most words of `own` that stand in its order in one span: a longest increasing run of their places."""
        placed = F.transform(window, lambda w, i: F.struct(i.alias("i"), F.array_position(literal(own), w).cast("int").alias("v")))
        kept = F.filter(placed, lambda x: x["v"] > 0)
        zeros = F.array_repeat(F.lit(0), len(own))
        longer = lambda ends, x: F.transform(ends, lambda n, k: F.when(k + 1 == x["v"], F.greatest(n, 1 + F.coalesce(F.array_max(F.slice(ends, F.lit(1), x["v"] - 1)), F.lit(0)))).otherwise(n))
        longest = lambda s: F.array_max(F.aggregate(F.filter(kept, lambda x: (x["i"] >= s["i"]) & (x["i"] < s["i"] + span)), zeros, longer))
        return F.array_max(F.transform(kept, longest))

    def judged(window: Column, label: str, own: list[str], span: int, need: int) -> Column:
        likely = F.size(F.array_intersect(window, literal(own))) >= need
        return F.when(likely, F.struct(F.lit(label).alias("label"), (in_order(window, own, span) / len(own)).alias("containment")))

    each = lambda w: F.array(*[judged(w, label, own, span, need) for (label, own, _), span, need in zip(sets, spans, needs, strict=True)])
    least = F.create_map(*[F.lit(x) for (label, own, _), need in zip(sets, needs, strict=True) for x in (label, need / len(own))])
    found = F.filter(F.flatten(F.transform(windows, each)), lambda m: m.isNotNull() & (m["containment"] >= least[m["label"]]))
    return F.coalesce(F.array_distinct(found), none)


def matches(blocks: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """From (doc_id or row, line, tokens) to (row, line, label, overlap) of every pair that meets the threshold."""
    spark = blocks.sparkSession
    sets = [(label, sorted(set(words_of(text)))) for label, text in templates]
    sets = [(label, tokens, math.ceil(threshold * len(tokens) - 1e-9)) for label, tokens in sets if tokens]
    vocabulary = sorted({t for _, tokens, _ in sets for t in tokens})
    least = min((o for _, _, o in sets), default=1)
    counts = {r.token: r.n for r in blocks.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()}  # no more rows than template words
    rank = {t: i for i, t in enumerate(sorted(vocabulary, key=lambda t: (counts.get(t, 0), t)))}
    prefixes = []
    for label, tokens, o in sets:
        ordered = sorted(tokens, key=rank.__getitem__)
        prefixes += [(label, o, len(ordered), i, t, ordered) for i, t in enumerate(ordered[: len(ordered) - o + 1])]
    names = ("label", "need", "size", "t_place", "token", "template")
    entry = lambda x: F.struct(*[(F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)).alias(n) for n, v in zip(names, x, strict=True)])
    typed = "array<struct<label:string,need:int,size:int,t_place:int,token:string,template:array<string>>>"
    small = spark.range(1).select(F.inline(F.array(*map(entry, prefixes)).cast(typed)))
    ranks = F.create_map(*[F.lit(x) for pair in rank.items() for x in pair]) if rank else F.create_map().cast("map<string,int>")
    ordered = F.transform(F.array_sort(F.transform("tokens", lambda t: F.struct(ranks[t].alias("r"), t.alias("t")))), lambda x: x["t"])
    sorted_blocks = blocks.select("row", "line", ordered.alias("tokens"))
    tokens = sorted_blocks.select("row", "line", "tokens", F.posexplode(F.slice("tokens", 1, F.size("tokens") - least + 1)).alias("b_place", "token"))
    left = F.least(F.col("size") - F.col("t_place"), F.size("tokens") - F.col("b_place"))
    met = tokens.join(F.broadcast(small), "token").where((F.size("tokens") >= F.col("need")) & (left >= F.col("need")))  # prefixes: bounded by the templates
    overlap = F.size(F.array_intersect("tokens", "template"))
    return met.withColumn("overlap", overlap).where("overlap >= need").select("row", "line", "label", (F.col("overlap") / F.col("size")).alias("containment")).distinct()


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks; one row per row."""
    vocabulary = sorted({w for _, text in templates for w in words_of(text)})
    least = min((math.ceil(threshold * len(set(words_of(t))) - 1e-9) for _, t in templates if words_of(t)), default=1)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    likely = F.lit(False)
    for phrase, _ in phrases:
        likely = likely | F.col("t").rlike(f"(?i){max(phrase.split(), key=len)}")
    rows = rows.withColumn("n_words", F.size(words(F.col("t"))).cast("long"))
    spaced = F.array_join(F.transform(words(ascii_lower(F.col("t"))), lambda w: F.concat(F.lit(" "), w, F.lit(" "))), "")
    rows = _phrase_columns(rows.withColumn("said", F.when(likely, spaced)), phrases)
    known = F.array(*[F.lit(w) for w in vocabulary])
    tokens = lambda line: F.array_intersect(words(ascii_lower(line)), known)
    # a line shorter than its least words and the gaps between them can't match
    lines = F.filter(F.split("t", "\n"), lambda line: F.length(line) >= 2 * least - 1)
    cut = F.filter(F.transform(lines, tokens), lambda b: F.size(b) >= least)
    rows = materialise(rows.select("row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", cut.alias("blocks"), wrapped(F.col("t"), templates, threshold).alias("wrapped")))
    blocks = rows.where(F.size("blocks") > 0).select("row", F.posexplode("blocks").alias("line", "tokens"))
    found = matches(blocks, templates, threshold).groupBy("row").agg(F.collect_set("label").alias("own"), F.max("containment").alias("best"), F.count_distinct("line").alias("matched"))
    out = rows.join(found, "row", "left")
    return out.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base_labels", F.coalesce("own", F.array().cast("array<string>")), F.col("wrapped.label")))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.greatest("best", F.array_max("wrapped.containment")), F.lit(0.0))).alias("score"),
        F.coalesce("matched", F.lit(0)).cast("long").alias("matched_lines"),
    )
