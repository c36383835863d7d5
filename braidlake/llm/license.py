"""License scans by diagonal voting: word n-grams of texts are joined with places in license templates.

Every run of three words of every text is hashed and joined with the templates' runs (a fixed table, broadcast); the join
compares the words themselves too, so a vote is three equal words. A match at word p of the text and q of the template votes
for the diagonal p - q. Votes are added up by diagonal, as bits of the places q; for long templates diagonals a few words
apart are one span, for words put in or left out. A span is verified by the words of the template that it holds, each counted
once however often it occurs, as a part of the template or of the words between the span's ends, whichever are more: all of
them for phrases, most of them for paragraphs.

Words are in lower case (A-Z) and consist of ASCII letters and digits and of all characters beyond ASCII.

Defined results: a null or empty text has no words and no labels (an empty string); rows that repeat, and rows of a null
doc_id, are scanned each; very long texts are hashed one at a time; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from braidlake.llm.words import ALNUM, LOWER, byte_chunks, shingles, text_bytes, word_hashes

RUN = 3
#: Places of a template that one column of votes holds as bits.
BITS = 62
#: Runs of one batch.
ROWS = 50_000
#: Diagonals of a long template that are this near each other are one span, and the part of it that must match.
NEAR, COVERED, LONG = 4, 0.6, 16

#: The phrases that are always found, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further phrases and paragraphs of public licenses, those that no other license shares.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache-2", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software"),
    ("bsl-1", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("epl-2", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    ("cc0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    ("bsd-2", "bsd 2 clause license"),
    ("bsd-3", "bsd 3 clause license"),
    ("agpl", "gnu affero general public license"),
    ("epl-2", "eclipse public license 2"),
    ("artistic-2", "artistic license 2"),
    ("cc0", "cc0 1 0 universal"),
    ("cc-by", "creative commons attribution 4"),
    ("cc-by", "cc by 4"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc-by-nd", "creative commons attribution noderivatives"),
    ("cc-by-nd", "cc by nd"),
    ("cc-by-nc-sa", "cc by nc sa"),
    ("gpl", "gnu general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("mpl-2", "mozilla public license"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
]


def template_words(text: str) -> list[str]:
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def _templates() -> tuple[list[tuple[str, str, bool]], list[tuple[int, str, int, int]]]:
    """Templates as (label, words, base) and their runs as (hash, words, template, place)."""
    all_ = [(label, text, True) for text, label in PHRASES.items()] + [(label, text, False) for label, text in TEMPLATES]
    runs = []
    for n, (_, text, _) in enumerate(all_):
        words = template_words(text)
        hashes, _ = word_hashes(pa.array([" ".join(words)]), ALNUM)
        runs += [(int(h), " ".join(words[q : q + RUN]), n, q) for q, h in enumerate(shingles(hashes, RUN).view(np.int64))]
    return all_, runs


def normal_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts in lower case with one space between those of a text, and where each begins and ends."""
    data, at = text_bytes(column)
    n = len(data)
    if not n:
        return data, np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = LOWER[data]
    word = ALNUM[data]
    first = np.zeros(n + 1, bool)
    first[at] = True
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1] | first[1:n]
    ends[:-1] &= ~word[1:] | first[1:n]
    kept = word.copy()
    kept[1:] |= word[:-1] & ~word[1:]  # what follows a word becomes its space
    place = np.cumsum(kept) - 1
    return np.where(word, data, np.uint8(0x20))[kept], place[begins], place[ends] + 1


def slices(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Stretches of bytes, which may overlap, as texts."""
    sizes = ends - begins
    at = np.concatenate([[0], np.cumsum(sizes)])
    picked = data[np.arange(at[-1]) - np.repeat(at[:-1] - begins, sizes)]
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(picked)).cast(pa.string())


def grams(docs: DataFrame) -> DataFrame:
    """(uid, pos, h, words) for every run of words, and for each document one row with pos -1, doc_id and n_words."""
    schema = pa.schema([("uid", pa.int64()), ("pos", pa.int64()), ("h", pa.int64()), ("words", pa.string()), ("doc_id", pa.int64()), ("n_words", pa.int64())])

    def rows(batches):
        for whole in batches:
            for b in byte_chunks(whole, 2, 1 << 20):
                hashes, at = word_hashes(b.column(2), ALNUM)
                n, uid, sizes = b.num_rows, b.column(0), np.diff(at)
                none = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays([uid, pa.array(np.full(n, -1)), none, pa.nulls(n, pa.string()), b.column(1), pa.array(sizes)], schema=schema)
                row = np.repeat(np.arange(n), sizes)
                pos = np.arange(len(hashes)) - at[row]
                runs = np.flatnonzero(pos + RUN <= sizes[row])
                if len(runs):
                    data, begins, ends = normal_words(b.column(2))
                    h = shingles(hashes, RUN).view(np.int64)
                for i in range(0, len(runs), ROWS):
                    some = runs[i : i + ROWS]
                    none = pa.nulls(len(some), pa.int64())
                    words = slices(data, begins[some], ends[some + RUN - 1])
                    yield pa.RecordBatch.from_arrays([uid.take(pa.array(row[some])), pa.array(pos[some]), pa.array(h[some]), words, none, none], schema=schema)

    return docs.mapInArrow(rows, "uid long, pos long, h long, words string, doc_id long, n_words long")


def words_held(masks: list[Column]) -> Column:
    """How many words the runs at some places hold together; masks have BITS places each."""
    held, over = F.lit(0), F.lit(0).cast("long")
    for m in [*masks, F.lit(0).cast("long")]:
        wide = m.bitwiseOR(F.shiftleft(m, 1)).bitwiseOR(F.shiftleft(m, 2))
        held = held + F.bit_count(wide.bitwiseAND(F.lit((1 << BITS) - 1)).bitwiseOR(over))
        over = F.shiftrightunsigned(wide, BITS)
    return held


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and spans (label, start, words, covered, from, to): the
    template's start, its size, the part that is held, and the words of the text that it is held in (to not included)."""
    spark = docs.sparkSession
    all_, runs = _templates()
    sizes = [len(template_words(text)) for _, text, _ in all_]
    table = spark.createDataFrame(runs, "h long, words string, template int, place long")
    facts = [(n, label, base, size, NEAR if size >= LONG else 0, COVERED if size >= LONG else 1.0) for n, ((label, _, base), size) in enumerate(zip(all_, sizes, strict=True))]
    facts = spark.createDataFrame(facts, "template int, label string, base boolean, size long, near long, least double")
    rows = grams(docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text"))
    votes = rows.join(F.broadcast(table), ["h", "words"], "left").where("template is not null or pos < 0")
    masks = [f"places{k}" for k in range(-(-max(sizes) // BITS))]
    bit = lambda k: F.when(F.floor(F.col("place") / BITS) == k, F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % BITS).cast("int"))).otherwise(F.lit(0))
    votes = votes.groupBy("uid", "template", (F.col("pos") - F.col("place")).alias("diagonal")).agg(
        *[F.bit_or(bit(k)).alias(m) for k, m in enumerate(masks)], F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    votes = votes.join(F.broadcast(facts), "template", "left")
    of = Window.partitionBy("uid", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(of) > F.col("near"), F.lit(True))
    spans = votes.withColumn("span", F.sum(apart.cast("int")).over(of))
    spans = spans.groupBy("uid", "template", "span").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), *[F.bit_or(m).alias(m) for m in masks], F.min("diagonal").alias("start"),
        *[F.first(c).alias(c) for c in ("label", "base", "size", "least")], F.min("first").alias("from"), (F.max("last") + RUN).alias("to"))
    spans = spans.withColumn("covered", F.when(F.col("template").isNotNull(), words_held([F.col(m) for m in masks]) / F.greatest("size", F.col("to") - F.col("from"))))
    found = F.coalesce(F.col("covered") >= F.col("least"), F.lit(False))
    base = found & F.col("base")
    start = F.greatest("start", F.lit(0))
    joined = lambda cond: F.array_join(F.sort_array(F.collect_set(F.when(cond, F.col("label")))), ",")
    span = F.struct("label", start.alias("start"), F.col("size").alias("words"), "covered", "from", "to")
    out = spans.groupBy("uid").agg(
        F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, start)).alias("first_word"), F.max(F.when(base, start)).alias("last_word"), joined(base).alias("base_labels"),
        joined(found).alias("labels"), F.coalesce(F.max(F.when(found, F.col("covered"))), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_list(F.when(found, span))).alias("spans"))
    return out.drop("uid")
