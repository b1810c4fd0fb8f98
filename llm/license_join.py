"""License scans by an exact set-similarity join of text blocks with templates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import ref, saved, text_bytes, unused

#: The phrases of the contract and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
#: Well-known notices and their labels. The notices of the Lesser and Affero variants differ from the general one by a
#: word, so they count as gpl; all Creative Commons licenses are cc.
NOTICES = [
    (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
        ' (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,'
        " publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,"
        " subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or"
        " substantial portions of the Software.",
        "mit",
    ),
    (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that"
        " the above copyright notice and this permission notice appear in all copies.",
        "isc",
    ),
    (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions"
        " are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
        " Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the"
        " documentation and/or other materials provided with the distribution.",
        "bsd",
    ),
    (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may'
        " obtain a copy of the License at",
        "apache",
    ),
    (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an"
        ' "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "apache",
    ),
    (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published"
        " by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "gpl",
    ),
    (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this"
        " file, You can obtain one at",
        "mpl",
    ),
    ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "cc0"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc"),
    ("Licensed under CC BY 4.0", "cc"),
]

#: A-Z become a-z, and every byte that is no digit, letter or part of a longer code point a blank: words are what is left between blanks.
_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: Templates of fewer distinct words must be found whole.
SHORT = 10


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


@dataclass(frozen=True)
class Template:
    """Words of a notice, or of a ``phrase`` that must stand as it is. Blocks to compare with are ``2 * step`` words long; ``need`` of the
    distinct words must be in a block."""

    words: tuple[str, ...]
    label: str
    phrase: bool
    step: int
    need: int


def templates(phrases: list[tuple[str, str]], notices: list[tuple[str, str]], threshold: float) -> list[Template]:
    """``step`` is the power of two that holds all words, at least four: any run of so many words lies in one block. ``need`` is
    ``threshold`` of the distinct words, rounded up, and all of them for phrases and for templates of fewer than SHORT."""
    out = []
    for text, label, phrase in [*[(*p, True) for p in phrases], *[(*n, False) for n in notices]]:
        words = tuple(w.decode() for w in words_of(text.encode()))
        distinct = len(set(words))
        whole = phrase or distinct < SHORT
        need = distinct if whole else int(np.ceil(threshold * distinct - 1e-9))
        out.append(Template(words, label, phrase, max(4, 1 << (len(words) - 1).bit_length()), need))
    return out


def _marked(docs: DataFrame, index: dict[bytes, int], text_col: str, uid: str) -> DataFrame:
    """Saved rows ``uid``, all of the document's words counted (``n_words``), and where words of the templates stand: ``ids`` and ``places``."""

    def mark(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            counts, ids, places = [], [], []
            for text in batch:
                words = words_of(text.as_py())
                found = np.fromiter(map(index.get, words, repeat(-1)), np.int32, len(words))
                at = np.flatnonzero(found >= 0)
                counts.append(len(words))
                ids.append(found[at])
                places.append(at)
            yield pa.StructArray.from_arrays(
                [pa.array(counts, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(places, pa.list_(pa.int64()))],
                ["n_words", "ids", "places"],
            )

    mark.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    words = F.arrow_udf(mark, "n_words bigint, ids array<int>, places array<bigint>")(text_bytes(ref(text_col).cast("string")))
    return docs.withColumn(uid, F.monotonically_increasing_id()).withColumn(uid + "w", words)


def word_ranks(marked: DataFrame, size: int) -> np.ndarray:
    """Global frequency order of the ``size`` words of the templates over all documents, rarest first; ties by word. Counted per task
    and added up; one number a word comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch["ids"].flatten().to_numpy(zero_copy_only=False), minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], ["id", "n"])

    counts = np.zeros(size, np.int64)
    for r in marked.select("ids").mapInArrow(count, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    ranks = np.empty(size, np.int32)
    ranks[np.lexsort((np.arange(size), counts))] = np.arange(size, dtype=np.int32)
    return ranks


def _blocks(ranks: np.ndarray, prefixes: dict[int, np.ndarray], least: dict[int, int]):
    """mapInArrow: the blocks of each text that hold a prefix word of a template of their step and enough words of templates (the
    length filter). A block starts at a multiple of its step and is two steps long; ``words`` are ranks in text order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, steps, starts, words, spots = [], [], [], [], []
            for row, (ids, places) in enumerate(zip(batch["ids"], batch["places"], strict=True)):
                rank = ranks[ids.values.to_numpy(zero_copy_only=False)]
                at = places.values.to_numpy(zero_copy_only=False)
                for step, is_prefix in prefixes.items():
                    hits = np.unique(at[is_prefix[rank]] // step)
                    for block in np.unique(np.concatenate([hits, hits - 1])):
                        if block < 0:
                            continue
                        low, high = np.searchsorted(at, (block * step, (block + 2) * step))
                        if len(np.unique(rank[low:high])) >= least[step]:
                            rows.append(row)
                            steps.append(step)
                            starts.append(block * step)
                            words.append(rank[low:high])
                            spots.append(at[low:high])
            if rows:
                columns = [batch["uid"].take(pa.array(rows)), pa.array(steps, pa.int32()), pa.array(starts, pa.int64())]
                columns += [pa.array(words, pa.list_(pa.int32())), pa.array(spots, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["uid", "step", "start", "words", "places"])

    return cut


def _matches(marked: DataFrame, known: list[Template]) -> DataFrame:
    """Every block that holds enough words of a template: ``uid``, ``step``, ``start``, ``template``, ``overlap`` and, for phrases, ``found``, the places
    in the first half of the block (so each is in one block only)."""
    spark = marked.sparkSession
    vocabulary = sorted({w for t in known for w in t.words})
    ranks = word_ranks(marked, len(vocabulary))
    rank = {w: int(r) for w, r in zip(vocabulary, ranks, strict=True)}
    ordered = [sorted({rank[w] for w in t.words}) for t in known]
    steps = sorted({t.step for t in known})
    prefixes, least, index = {}, {}, []
    for step in steps:
        prefixes[step] = np.zeros(len(vocabulary), bool)
        least[step] = min(t.need for t in known if t.step == step)
    for number, (t, tokens) in enumerate(zip(known, ordered, strict=True)):
        for place, token in enumerate(tokens[: len(tokens) - t.need + 1]):
            prefixes[t.step][token] = True
            index.append((t.step, token, number, place, len(tokens), t.need))
    shape = "step int, token int, template int, place int, size int, need int"
    entries = F.broadcast(spark.createDataFrame(index, shape))  # at most the words of all templates
    whole = [(n, tokens, [rank[w] for w in t.words] if t.phrase else None) for n, (t, tokens) in enumerate(zip(known, ordered, strict=True))]
    about = F.broadcast(spark.createDataFrame(whole, "template int, tokens array<int>, phrase array<int>"))

    cut = _blocks(ranks, prefixes, least)
    blocks = marked.select("uid", "ids", "places").mapInArrow(cut, "uid bigint, step int, start bigint, words array<int>, places array<bigint>")
    blocks = blocks.withColumn("held", F.array_sort(F.array_distinct("words")))
    probes = blocks.select("*", F.posexplode("held").alias("at", "token")).join(entries, ["step", "token"])
    within = F.least(F.col("size") - F.col("place"), F.size("held") - F.col("at")) >= F.col("need")
    key = ["uid", "step", "start", "template"]
    candidates = probes.where((F.size("held") >= F.col("need")) & within).groupBy(*key).agg(
        *[F.first(c).alias(c) for c in ("words", "places", "held", "need")]
    )
    m = F.size("phrase")
    starts = F.filter(
        F.sequence(F.lit(0), F.size("words") - m),
        lambda x: (F.slice("words", x + 1, m) == F.col("phrase"))
        & (F.element_at("places", x + m) - F.element_at("places", x + 1) == m - 1)
        & (F.element_at("places", x + 1) < F.col("start") + F.col("step")),
    )
    found = F.when(F.col("phrase").isNotNull() & (F.size("words") >= m), F.transform(starts, lambda x: F.element_at("places", x + 1)))
    overlap = F.size(F.array_intersect("held", "tokens"))
    verified = candidates.join(about, "template").select(*key, "need", overlap.alias("overlap"), F.size("tokens").alias("size"), found.alias("found"), "phrase")
    return verified.where((F.col("overlap") >= F.col("need")) & (F.col("phrase").isNull() | (F.size("found") > 0))).drop("need", "phrase")


def license_matches(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: list[tuple[str, str]] = PHRASES,
    notices: list[tuple[str, str]] = NOTICES,
    threshold: float = 0.8,
) -> DataFrame:
    """The blocks of all texts that contain a template: the id, ``label``, ``template`` (its number, phrases first), ``start`` (first word of the
    block, from 0), ``words`` (length of a whole block), ``containment`` and ``places`` (of a phrase, else null). Rules as in ``license_scan``."""
    known = templates(phrases, notices, threshold)
    marked = saved(_narrow(docs, known, id_col, text_col))
    labels = F.broadcast(docs.sparkSession.createDataFrame([(n, t.label) for n, t in enumerate(known)], "template int, label string"))
    out = _matches(marked, known).join(labels, "template").join(marked.select("uid", "id"), "uid")
    share = (F.col("overlap") / F.col("size")).alias("containment")
    return out.select(F.col("id").alias(id_col), "label", "template", "start", (2 * F.col("step")).alias("words"), share, F.col("found").alias("places"))


def _narrow(docs: DataFrame, known: list[Template], id_col: str, text_col: str) -> DataFrame:
    index = {w.encode(): n for n, w in enumerate(sorted({w for t in known for w in t.words}))}
    uid = unused(docs, "uid")
    rows = _marked(docs, index, text_col, uid)
    return rows.select(F.col(uid).alias("uid"), ref(id_col).alias("id"), F.col(uid + "w.n_words"), F.col(uid + "w.ids"), F.col(uid + "w.places"))


def license_scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: list[tuple[str, str]] = PHRASES,
    notices: list[tuple[str, str]] = NOTICES,
    threshold: float = 0.8,
) -> DataFrame:
    """A row per row of ``docs``: the id, ``n_words``, ``n_base`` (places where a phrase stands), ``first_word`` and ``last_word`` (the smallest and largest
    of them, from 0; else null), ``base_labels`` (of phrases), ``labels`` (of phrases and notices) and ``score``, the largest containment
    of a template that was found, else 0.

    Words are runs of digits, letters (A-Z lower-cased) and characters beyond ASCII. A text block is ``2 * step`` words at a multiple of
    ``step``, a power of two that holds the template; it contains a template if it has at least ``threshold`` of the template's distinct words,
    all of them for phrases and templates of fewer than ten. A phrase must then stand word by word.

    The join is exact. Words are ordered by their frequency in all documents, rarest first. Of a template of size s that
    needs o words, one of its first s - o + 1 must be in a block that contains it (prefix filter); the block needs o words
    of templates (length filter); and what follows a first common word on either side must suffice (positional filter). What is left
    is counted. Templates are a bounded parameter and are broadcast; blocks are joined by equal words, never with all templates.

    Null texts are empty and have no words. Null and repeated ids keep their rows. A text of any length is one row of word numbers;
    only blocks with a prefix word travel. Repeated templates are found twice and give one label. An empty table gives an empty table.
    Other columns are not looked at.
    """
    known = templates(phrases, notices, threshold)
    marked = saved(_narrow(docs, known, id_col, text_col))
    labels = F.broadcast(docs.sparkSession.createDataFrame([(n, t.label, t.phrase) for n, t in enumerate(known)], "template int, label string, phrase boolean"))
    found = _matches(marked, known).join(labels, "template")
    base = F.col("phrase")
    per_doc = found.groupBy("uid").agg(
        F.sum(F.when(base, F.size("found")).otherwise(0)).alias("n_base"),
        F.min(F.array_min("found")).alias("first_word"),
        F.max(F.array_max("found")).alias("last_word"),
        F.collect_set(F.when(base, F.col("label"))).alias("base_labels"),
        F.collect_set("label").alias("labels"),
        F.max(F.col("overlap") / F.col("size")).alias("score"),
    )

    def joined(name: str) -> Column:
        return F.coalesce(F.array_join(F.array_sort(name), ","), F.lit("")).alias(name)

    return marked.select("uid", "id", "n_words").join(per_doc, "uid", "left").select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word",
        "last_word",
        joined("base_labels"),
        joined("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
