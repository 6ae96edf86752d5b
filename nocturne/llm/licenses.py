"""License scan by diagonal voting.

The hashes of all rolling word k-grams of the documents are joined with the positions of the
templates' k-grams. Hits of one document and template vote for a diagonal, the word at which the
template would begin; neighbouring diagonals are merged, so a word put in or left out
does not split a span. Merged diagonals with too few votes for a span cannot hold one; the others are
aligned with the template word by word.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import Rolling
from .substring import _Hashes, word_hashes
from .work import arrow_schema, batch, identity, ints, table, texts

GRAM = 3
LEAST = 0.9
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_SEGMENT = 1 << 17

# Phrases whose places are counted, with their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# The wording of public license notices, with their labels.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the "
            "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http www apache org licenses LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
            "Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
            "copyright notice and this permission notice appear in all copies."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


def _gram_hashes(words: list[bytes], gram: int, known: _Hashes) -> np.ndarray:
    tokens = word_hashes(words, known)
    parts = [Rolling(tokens[a : a + _SEGMENT + gram - 1]).grams(gram) for a in range(0, max(len(tokens) - gram + 1, 0), _SEGMENT)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def rolling_grams(docs: DataFrame, gram: int = GRAM) -> DataFrame:
    """``(doc, tie, at, hash)``: every rolling k-gram of ``docs(doc, tie, text)``."""
    schema = arrow_schema(doc=pa.int64(), tie=pa.int64(), at=pa.int32(), hash=pa.int64())

    def run(batches):
        known, held, size = _Hashes(), [], 0
        for b in batches:
            for doc, tie, text in zip(ints(b.column(0)).tolist(), ints(b.column(1)).tolist(), texts(b.column(2))):
                hashes = _gram_hashes(words_of(text), gram, known)
                if len(hashes):
                    held.append((doc, tie, hashes))
                    size += len(hashes)
                if size >= _SEGMENT:
                    yield flush(held)
                    held, size = [], 0
        if held:
            yield flush(held)

    def flush(held):
        counts = [len(h) for _, _, h in held]
        docs_, ties = (np.repeat(np.array([x[i] for x in held], np.int64), counts) for i in (0, 1))
        return batch(schema, docs_, ties, np.concatenate([np.arange(c, dtype=np.int32) for c in counts]), np.concatenate([h for _, _, h in held]).view(np.int64))

    return docs.mapInArrow(run, "doc long, tie long, at int, hash long")


def drift(n: int, least: float = LEAST) -> int:
    """By how many diagonals a span of ``n`` template words may wander: words left out and put in at a share of ``least``."""
    return max(1, math.floor(n * (1 - least)) + math.floor(n * (1 / least - 1)))


def least_votes(n: int, gram: int = GRAM, least: float = LEAST) -> int:
    """Fewest k-grams of ``n`` template words in a span: a word left out ends ``gram`` of them, one put in ``gram`` - 1."""
    lost = gram * math.floor(n * (1 - least)) + (gram - 1) * math.floor(n * (1 / least - 1))
    return max(1, n - gram + 1 - lost)


def template_positions(spark, templates=TEMPLATES, gram: int = GRAM, least: float = LEAST) -> DataFrame:
    """``(template, position, hash, drift, need)``, a table as large as the templates."""
    known, rows = _Hashes(), []
    for t, (label, text) in enumerate(templates):
        words = words_of(text.encode())
        if len(words) < gram:
            raise ValueError(f"a template of {label} has fewer than {gram} words")
        limits = drift(len(words), least), least_votes(len(words), gram, least)
        rows += [(t, p, int(h), *limits) for p, h in enumerate(_gram_hashes(words, gram, known).view(np.int64))]
    return spark.createDataFrame(rows, "template int, position int, hash long, drift int, need int")


def voted_spans(docs: DataFrame, templates=TEMPLATES, gram: int = GRAM, least: float = LEAST) -> DataFrame:
    """``(doc, tie, template, low, high, votes)``: merged diagonals from ``low`` to ``high`` with enough votes.

    Diagonals are merged in overlapping bands twice as wide as a span may wander, so each span lies
    within a band, and no band grows with its text.
    """
    hits = rolling_grams(docs, gram).join(F.broadcast(template_positions(docs.sparkSession, templates, gram, least)), "hash")
    limits = ["doc", "tie", "template", "drift", "need"]
    diagonals = hits.groupBy(*limits, (F.col("at") - F.col("position")).alias("diagonal")).agg(F.count_distinct("position").alias("votes"))
    band = F.floor(F.col("diagonal") / F.col("drift"))
    banded = diagonals.withColumn("band", F.explode(F.array(band, band - 1)))
    merged = banded.groupBy(*limits, "band").agg(F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.sum("votes").alias("votes"))
    return merged.where("votes >= need").select("doc", "tie", "template", "low", "high", "votes").distinct()


def aligned(words: list[bytes], template: list[bytes]) -> tuple[float, int, int]:
    """``(share, first, end)`` of the stretch of ``words`` most like the template.

    That is the one with the fewest words left out and put in; of several the longest, then the
    earliest. ``share`` is the number of common words over the longer of stretch and template.
    """
    n, wide = len(template), len(words) + 1
    row, best = [j * wide for j in range(n + 1)], (n, 0, 0)  # cost * wide + first word
    for i, word in enumerate(words, 1):
        before, row[0] = row[0], i
        for j, other in enumerate(template, 1):
            at = before if word == other else min(row[j], row[j - 1]) + wide
            before, row[j] = row[j], at
        cost, first = divmod(row[n], wide)
        best = min(best, (cost, first - i, i))
    cost, minus, end = best
    return (n - minus - cost) // 2 / max(n, -minus), end + minus, end


def _places(words: list[bytes], phrases: list[tuple[bytes, str]]):
    line = b" " + b" ".join(words) + b" "
    for phrase, label in phrases:
        at = line.find(phrase)
        while at >= 0:
            yield line.count(b" ", 0, at), label
            at = line.find(phrase, at + 1)


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES, gram: int = GRAM, least: float = LEAST) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans)``.

    One row per row of ``df``. A span holds its label, first word, end and share: words in common with the
    template, in order, over the longer of the two (``aligned``). Spans of ``least`` or more add their labels;
    a span is listed once, spans by first word, label and end. ``score`` is the
    best share; a base phrase counts as 1, no span as 0. Null and empty texts have no words.
    Rows with one id and text are scanned as one and listed each. A template of fewer than ``gram`` words is an error.
    """
    wording = [(label, words_of(t.encode())) for label, t in templates]
    phrases = [(b" " + p.encode() + b" ", label) for p, label in BASE.items()]
    span_type = pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("share", pa.float64())])
    schema = arrow_schema(
        doc_id=pa.int64(), n_words=pa.int64(), n_base=pa.int64(), first_word=pa.int64(), last_word=pa.int64(), base_labels=pa.string(), labels=pa.string(),
        score=pa.float64(), spans=pa.list_(span_type),
    )

    def run(batches):
        for b in batches:
            rows = []
            for i, t, found in zip(b.column(0).to_pylist(), texts(b.column(1)), b.column(2).to_pylist()):
                words = words_of(t)
                places = list(_places(words, phrases))
                shares = {}
                for s in found or ():
                    label, template = wording[s["template"]]
                    margin = drift(len(template), least)
                    low = max(0, s["low"] - margin)
                    share, first, end = aligned(words[low : max(0, s["high"] + len(template) + margin)], template)
                    if share >= least:
                        place = label, low + first, low + end
                        shares[place] = max(share, shares.get(place, 0.0))
                spans = [{"label": label, "first": first, "end": end, "share": share} for (label, first, end), share in shares.items()]
                base = {label for _, label in places}
                score = max([1.0 if places else 0.0, *(s["share"] for s in spans)])
                spans.sort(key=lambda s: (s["first"], s["label"], s["end"]))
                starts = [p for p, _ in places]
                rows.append((
                    i, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
                    ",".join(sorted(base | {s["label"] for s in spans})), score, spans,
                ))
            yield batch(schema, *zip(*rows)) if rows else batch(schema, *[[]] * 9)

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    keyed = rows.select("doc_id", "text", *identity("doc_id", "text"))
    voted = voted_spans(keyed.select("doc", "tie", "text"), templates, gram, least)
    by_doc = table(voted.groupBy("doc", "tie").agg(F.sort_array(F.collect_set(F.struct("template", "low", "high"))).alias("found")), "spans")
    return keyed.join(by_doc, ["doc", "tie"], "left").select("doc_id", "text", "found").mapInArrow(
        run,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
        "spans array<struct<label: string, first: long, end: long, share: double>>",
    )
