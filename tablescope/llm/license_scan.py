"""License scan: an exact set-similarity join of text blocks with license templates.

Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. A
block is a window of ``BLOCK`` words, doubled until twice a template's distinct words fit in; blocks begin
every half block, so any statement of up to half a block lies within one. A block matches a template if it
holds at least ``CONTAINMENT`` of the template's distinct words. The join is exact:
words are ordered by their frequency over all documents, rarest first, and a
pair is looked at only where a word of the template's prefix occurs in the block
(prefix filter), the block has enough template words at all (length filter) and
enough of them can still follow at the word's place in both orders (positional
filter); what is left is verified by the overlap itself.

Beside this join every place of the fixed base phrases is counted in the row.

The templates are a parameter; the rows of their prefixes are broadcast up to ``BROADCAST_PREFIXES`` and
joined by a shuffle beyond.

Edge cases: null counts as the empty text (no words, no labels, score 0); very long texts are scanned whole;
templates without words match nothing; a containment right at the threshold counts; repeated rows are scanned alike, each on
its own; an empty table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, functions as F

from .common import prepare, written

BLOCK = 64
CONTAINMENT = 0.8
BROADCAST_PREFIXES = 50_000

#: The base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Statements of public licenses by label.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("reserved", "No part of this publication may be reproduced without the prior written permission of the publisher"),
]

_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def scan_words(text: Column) -> Column:
    """The words of a text. ``lower`` also lowers other letters; none of them becomes a letter of the base phrases,
    and none becomes a separator, so counts and places are those of lowering A-Z alone."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _NO_WORD), "")


def _template_words(text: str) -> list[str]:
    return sorted({w for w in re.split(_NO_WORD, text.lower()) if w})


def _places(w: Column) -> Column:
    """(start, label) of every place of a base phrase; the words are gone through only where one can occur."""
    def here(i: Column) -> Column:
        label = F
        for phrase, name in PHRASES.items():
            words = phrase.split()
            hit = F.get(w, i) == words[0]
            for k, x in enumerate(words[1:], 1):
                hit = hit & (F.get(w, i + k) == x)
            label = label.when(hit, F.lit(name))
        return F.struct(i.alias("start"), label.alias("label"))

    possible = F.lit(False)
    for phrase in PHRASES:
        possible = possible | F.array_contains(w, phrase.split()[0])
    none = F.array().cast("array<struct<start:int,label:string>>")
    return F.when(possible, F.filter(F.transform(F.sequence(F.lit(0), F.size(w) - 1), here),
                                     lambda x: x["label"].isNotNull())).otherwise(none)


def _ordered_templates(texts: DataFrame, templates) -> tuple[list[str], list[tuple]]:
    """All template words, rarest in the documents first, and (id, label, words in that order) of each template."""
    sets = [(k, label, _template_words(text)) for k, (label, text) in enumerate(templates)]
    vocabulary = sorted({w for _, _, ws in sets for w in ws})
    spark = texts.sparkSession
    wanted = spark.createDataFrame([(w,) for w in vocabulary], "word string")
    counts = texts.select(F.explode("w").alias("word")).join(F.broadcast(wanted), "word").groupBy("word").agg(F.count("*").alias("n"))
    seen = {r.word: r.n for r in counts.collect()}  # the templates' words at most
    vocabulary.sort(key=lambda w: (seen.get(w, 0), w))
    rank = {w: i for i, w in enumerate(vocabulary)}
    return vocabulary, [(k, label, sorted(ws, key=rank.get)) for k, label, ws in sets if ws]


def matches(texts: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT, block: int = BLOCK) -> DataFrame:
    """(key, block, label, overlap, size): the blocks of ``texts`` (key, w) that meet the containment of a template."""
    sizes: dict[int, list] = {}
    for label, text in templates:
        size = block
        while len(_template_words(text)) > size // 2:
            size *= 2
        sizes.setdefault(size, []).append((label, text))
    found = [_block_matches(texts, own, containment, size) for size, own in sorted(sizes.items())]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _block_matches(texts: DataFrame, templates, containment: float, block: int) -> DataFrame:
    """The matches of templates of up to half a block in blocks of one size."""
    spark = texts.sparkSession
    vocabulary, ordered = _ordered_templates(texts, templates)
    prefixes = []
    for k, label, ws in ordered:
        need = math.ceil(containment * len(ws) - 1e-9)
        prefixes += [(ws[i], k, label, i, len(ws), need, ws) for i in range(len(ws) - need + 1)]
    prefix = spark.createDataFrame(
        prefixes, "word string, template int, label string, place int, size int, need int, template_words array<string>")
    step = block // 2
    at = texts.select("key", "w", F.posexplode("w").alias("pos", "word")).join(
        F.broadcast(prefix) if len(prefixes) <= BROADCAST_PREFIXES else prefix, "word")
    at = at.select("*", F.floor(F.col("pos") / step).cast("int").alias("_last"))
    at = at.select("*", F.explode(F.when(F.col("_last") > 0, F.array(F.col("_last") - 1, "_last")).otherwise(F.array("_last"))).alias("block"))
    at = at.select("*", F.array_intersect(F.array(*[F.lit(x) for x in vocabulary]),
                                          F.slice("w", F.col("block") * step + 1, block)).alias("known"))
    follow = F.least(F.col("size") - F.col("place"), F.size("known") - F.array_position("known", F.col("word")) + 1)
    near = at.where((F.size("known") >= F.col("need")) & (follow >= F.col("need")))
    found = near.select("key", "block", "label", "size", "need", F.size(F.array_intersect("known", "template_words")).alias("overlap"))
    return found.where(F.col("overlap") >= F.col("need")).select("key", "block", "label", "overlap", "size")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES,
         containment: float = CONTAINMENT) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels, labels, score (best containment)."""
    prepare(docs.sparkSession)
    text = F.col(f"`{text_col}`")
    key = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    texts = docs.select(key.alias("key"), scan_words(text).alias("w"))
    found = matches(texts, templates, containment)
    by_text = written(found.groupBy("key").agg(F.collect_set("label").alias("found"),
                                               F.max(F.col("overlap") / F.col("size")).alias("best")), "license-matches")
    base = docs.select(F.col(f"`{id_col}`").alias(id_col), key.alias("key"), scan_words(text).alias("w"))
    base = base.select(id_col, "key", F.size("w").cast("long").alias("n_words"), _places(F.col("w")).alias("places"))
    base = base.select(
        id_col, "key", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["start"])).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.transform("places", lambda p: p["label"]))).alias("own"))
    none = F.array().cast("array<string>")
    joined = base.join(by_text, "key", "left")
    return joined.select(
        id_col, "n_words", "n_base", "first_word", "last_word", F.array_join("own", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("own", F.coalesce("found", none))), ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"))
