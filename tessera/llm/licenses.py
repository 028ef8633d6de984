"""License scans: fixed phrases, and an exact set-similarity join of text
blocks with license templates. Expressions only.

Blocks are windows of BLOCK_WORDS words that start every BLOCK_STEP words, so
any passage of up to BLOCK_STEP words lies whole in one block. A block matches
a template when it holds at least THRESHOLD of the template's distinct words
(containment). The join:

* tokens are ordered by how many blocks of the whole corpus hold them, rarest
  first (global order; one row per template token, a bounded table);
* prefix filter: a match must hold one of the template's first
  size - need + 1 tokens, so blocks and templates meet by an equi-join on those;
* length filter: the block must hold `need` template tokens at all;
* positional filter: in the global order, what is left of the block and of the
  template from the first common token on must still reach `need`;
* what passes is verified by the exact overlap.

A match also needs the template's required words, which tell it from notices
that share the others; among the matches of one family (GNU, Creative Commons)
in a block the one with the largest overlap names it, then the larger share.

Edge cases: a null text is empty (no words, no labels, score 0); an empty text
likewise; a very long text is cut into blocks, none is left out; repeated rows
are answered each, also with a null or repeated id; ties of a family go to the
label last in order; an empty table gives an empty result; other columns are
not carried, so their names can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import text_or_empty, write_table

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD_CHARS = r"0-9A-Za-z\x{80}-\x{10FFFF}"
BLOCK_WORDS, BLOCK_STEP, THRESHOLD = 256, 128, 0.8

# Phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


class Template(NamedTuple):
    """A notice; the words a block must hold whatever else it holds; the family
    of notices that share most of their words (its best one names a block)."""
    label: str
    text: str
    required: tuple[str, ...] = ()
    family: str | None = None


def _gnu(name: str) -> str:
    return (f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} "
            "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
            "option) any later version")


def _creative(name: str) -> str:
    return f"This work is licensed under a Creative Commons {name} 4.0 International License"


_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list "
        "of conditions and the following disclaimer")
_CC = ("creative", "commons", "attribution")

# Public license notices.
TEMPLATES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
             "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
             "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
             "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
             "following conditions"),
    Template("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
             "except in compliance with the License. You may obtain a copy of the License at", ("apache",)),
    Template("bsd", _BSD),
    Template("gpl", _gnu("General"), ("gnu", "general"), "gnu"),
    Template("gpl", "This work is licensed under the GNU General Public License, version 3", ("gnu", "general", "public"), "gnu"),
    Template("lgpl", _gnu("Lesser General"), ("gnu", "lesser"), "gnu"),
    Template("agpl", _gnu("Affero General"), ("gnu", "affero"), "gnu"),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of "
             "the MPL was not distributed with this file, You can obtain one at", ("mozilla",)),
    Template("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse "
             "Public License 2.0 which is available at", ("eclipse",)),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
             "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    Template("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the "
             "software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, "
             "display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software"),
    Template("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the "
             "authors be held liable for any damages arising from the use of this software. Permission is granted to "
             "anyone to use this software for any purpose, including commercial applications, and to alter it and "
             "redistribute it freely"),
    Template("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, "
             "modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
             "compiled binary, for any purpose, commercial or non-commercial, and by any means", ("unencumbered",)),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring "
             "rights to this work", ("waived",)),
    Template("cc-by", _creative("Attribution"), _CC, "cc"),
    Template("cc-by-sa", _creative("Attribution-ShareAlike"), (*_CC, "sharealike"), "cc"),
    Template("cc-by-nd", _creative("Attribution-NoDerivatives"), (*_CC, "noderivatives"), "cc"),
    Template("cc-by-nc", _creative("Attribution-NonCommercial"), (*_CC, "noncommercial"), "cc"),
    Template("cc-by-nc-sa", _creative("Attribution-NonCommercial-ShareAlike"), (*_CC, "noncommercial", "sharealike"), "cc"),
    Template("cc-by-nc-nd", _creative("Attribution-NonCommercial-NoDerivatives"),
             (*_CC, "noncommercial", "noderivatives"), "cc"),
)


def tokens_of(text: str) -> list[str]:
    """Distinct lower-case words, in order of first use (templates, tests)."""
    import re
    return list(dict.fromkeys(re.findall(r"[0-9a-z\x80-\U0010FFFF]+", text.lower())))


def _phrase_pattern(phrase: str) -> str:
    return rf"(?i)(?<![{WORD_CHARS}])" + SEPARATORS.join(phrase.split()) + rf"(?![{WORD_CHARS}])"


def _phrase_places(body: Column) -> list[Column]:
    """Per phrase a struct (n, first, tail): places, words before the first,
    words after the last. Texts without the phrase cost one search."""
    words = lambda c: F.regexp_count(c, F.lit(f"[{WORD_CHARS}]+"))
    out = []
    for phrase in PHRASES:
        pattern = _phrase_pattern(phrase)
        gaps = F.split(body, pattern, -1)
        out.append(F.when(F.rlike(body, F.lit(pattern)), F.struct(
            (F.size(gaps) - 1).alias("n"), words(F.element_at(gaps, 1)).alias("first"),
            words(F.element_at(gaps, -1)).alias("tail"))))
    return out


def _blocks(vocabulary: list[str]) -> Column:
    """array<array<string>>: each window's template tokens (empty windows go)."""
    vocab = F.lit(vocabulary)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words_") - 1, F.lit(0)), F.lit(BLOCK_STEP))
    sets = F.transform(starts, lambda s: F.array_intersect(F.slice("words_", s + 1, BLOCK_WORDS), vocab))
    return F.filter(sets, lambda s: F.size(s) > 0)


def scan_words(docs: DataFrame, templates: Sequence[Template], id_col: str, text: str) -> DataFrame:
    """One read of the texts: rid, doc_id, n_words, phrase places, blocks."""
    vocabulary = sorted({t for x in templates for t in tokens_of(x.text)})
    body = text_or_empty(text)
    words = F.filter(F.split(F.lower(F.regexp_replace(F.col("body_"), SEPARATORS, " ")), " "), lambda w: w != "")
    d = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), body.alias("body_"))
    d = d.select("rid", "doc_id", F.array(*_phrase_places(F.col("body_"))).alias("places"), words.alias("words_"))
    return d.select("rid", "doc_id", "places", F.size("words_").cast("long").alias("n_words"),
                    _blocks(vocabulary).alias("blocks"))


def matching_templates(scanned: DataFrame, templates: Sequence[Template], threshold: float) -> DataFrame:
    """(rid, labels, score): per row with a block that may match, the labels of
    the templates contained and the best containment found among candidates."""
    spark = scanned.sparkSession
    vocabulary = {t for x in templates for t in tokens_of(x.text)}
    blocks = scanned.select("rid", F.posexplode("blocks").alias("block", "tokens"))
    # one row per template token: bounded by the templates given
    seen = dict(blocks.select(F.explode("tokens").alias("t")).groupBy("t").count().collect())
    order = {t: i for i, t in enumerate(sorted(vocabulary, key=lambda t: (seen.get(t, 0), t)))}
    rows, ranked = [], []
    for k, x in enumerate(templates):
        ranked.append(sorted(tokens_of(x.text), key=order.__getitem__))
        size = len(ranked[k])
        need = math.ceil(threshold * size - 1e-9)
        rows += [(k, t, i, size, need) for i, t in enumerate(ranked[k][:size - need + 1])]
    prefix = F.broadcast(spark.createDataFrame(rows, "k int, t string, at int, size int, need int"))
    ranks = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    met = blocks.select("rid", "block", "tokens", F.explode("tokens").alias("t")).join(prefix, "t") \
        .where(F.size("tokens") >= F.col("need"))                                              # length
    left = F.size(F.filter("tokens", lambda x: ranks[x] >= ranks[F.col("t")]))
    met = met.groupBy("rid", "block", "k").agg(
        F.min_by(F.struct("tokens", "t", "at", "size", "need"), "at").alias("c")).select("rid", "block", "k", "c.*")
    met = met.where((left >= F.col("need")) & (F.col("size") - F.col("at") >= F.col("need")))  # position

    def of(values) -> Column:
        return F.array(*[F.lit(v) for v in values])[F.col("k")]
    overlap = F.size(F.array_intersect("tokens", of(ranked)))
    met = met.withColumn("overlap", overlap).where(F.col("overlap") >= F.col("need"))
    must = of([sorted(x.required) for x in templates])
    met = met.where(F.size(F.array_except(must, "tokens")) == 0)
    best = met.select("rid", "block", of([x.family or f"template {k}" for k, x in enumerate(templates)]).alias("family"),
                      F.struct("overlap", (F.col("overlap") / F.col("size")).alias("share"),
                               of([x.label for x in templates]).alias("label")).alias("m")) \
        .groupBy("rid", "block", "family").agg(F.max("m").alias("m"))
    return best.groupBy("rid").agg(F.collect_set("m.label").alias("found"), F.max("m.share").alias("score"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                  templates: Sequence[Template] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word,
    base_labels and labels (arrays), score (the best containment of a matching
    template; 1 where a phrase stands; else 0)."""
    templates = templates or TEMPLATES
    s = write_table(scan_words(docs, templates, id_col, text), "license-words")
    found = matching_templates(s, templates, threshold)
    places = [F.col("places")[i] for i in range(len(PHRASES))]
    lengths = [len(p.split()) for p in PHRASES]
    labels = [F.when(p.isNotNull(), F.lit(v)) for p, v in zip(places, PHRASES.values())]
    base = F.array_sort(F.array_distinct(F.array_compact(F.array(*labels))))
    out = s.join(found, "rid", "left").select(
        "doc_id", "n_words", sum((F.coalesce(p["n"], F.lit(0)) for p in places), F.lit(0)).cast("long").alias("n_base"),
        F.least(*[p["first"] for p in places]).cast("long").alias("first_word"),
        F.greatest(*[F.col("n_words") - p["tail"] - n for p, n in zip(places, lengths)]).cast("long").alias("last_word"),
        base.alias("base_labels"), F.coalesce("found", F.slice(base, 1, 0)).alias("found"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
                      F.array_sort(F.array_union("base_labels", "found")).alias("labels"),
                      F.when(F.col("n_base") > 0, 1.0).otherwise(F.col("score")).alias("score"))
