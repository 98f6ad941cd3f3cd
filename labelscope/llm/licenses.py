"""License scan by a positional index of rare licence words.

The notices of ``TEMPLATES`` are posted by word and position. Document frequencies of
their words over all files give an IDF. A notice is posted under its words of highest
IDF, as many as leave less than ``COVERAGE`` of its weight, so that no match can do
without all of them. In a file, these words are looked up; each posting proposes where
in the file the notice would start. At every proposed start the notice's words are
intersected with the file's by relative position, and the IDF-weighted share found
is the coverage. A label needs enough coverage and its mandatory key phrases in the file.
The phrases of ``BASE`` are found wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelscope.llm import textkernel as tk
from labelscope.llm.common import bound_batches, released, table

#: Phrase and label.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Label, notice (words as the tokenisation gives them), mandatory key phrases.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted", "free of charge")),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license",)),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("in compliance with the license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms",)),
    ("bsd", "released under the bsd license", ("bsd license",)),
    ("gpl", "this work is licensed under the gnu general public license version", ("general public license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ("general public license",)),
    ("lgpl", "under the terms of the gnu lesser general public license", ("lesser general public license",)),
    ("agpl", "under the terms of the gnu affero general public license", ("affero general public license",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("public domain",)),
    ("cc-by-nc", "licensed under cc by nc", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa", ("cc by sa",)),
    ("cc-by-nd", "licensed under cc by nd", ("cc by nd",)),
    ("cc0", "licensed under cc0 1 0 universal", ("cc0",)),
    ("cc", "this work is licensed under a creative commons attribution license", ("creative commons",)),
    ("spdx", "spdx license identifier", ("spdx license identifier",)),
)
#: Share of a notice's weight that a match has.
COVERAGE = 0.6

REPORT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,start:long,coverage:double>>"


class TemplateIndex:
    """Notices as word ids, with the postings of their rarest words."""

    def __init__(self, frequency: dict[str, int], n_docs: int):
        phrases = [p for p, _ in BASE] + [p for _, _, keys in TEMPLATES for p in keys]
        self.vocabulary = template_vocabulary()
        number = {w: i for i, w in enumerate(self.vocabulary.words)}
        self.idf = np.log((1.0 + n_docs) / (1.0 + np.array([frequency.get(w, 0) for w in self.vocabulary.words]))) + 1e-6
        self.phrases = {p: np.array([number[w] for w in p.split()]) for p in phrases}
        self.notices = [np.array([number[w] for w in text.split()]) for _, text, _ in TEMPLATES]
        self.weights = [self.idf[n] / self.idf[n].sum() for n in self.notices]
        postings: dict[int, list[tuple[int, int]]] = {}  # by notice: words and their places in it
        for t, notice in enumerate(self.notices):
            rarest = sorted(range(len(notice)), key=lambda q: (-self.idf[notice[q]], q))
            left = 1 - np.cumsum(self.weights[t][rarest])  # what a match without the words up to here can still have
            for q in rarest[: int(np.argmax(left < COVERAGE - 1e-9)) + 1]:
                postings.setdefault(t, []).append((int(notice[q]), q))
        self.postings = {t: np.array(p) for t, p in postings.items()}
        self.posted = np.zeros(len(self.vocabulary.words) + 1, bool)
        self.posted[[w for p in postings.values() for w, _ in p]] = True


def template_vocabulary() -> tk.Vocabulary:
    return tk.Vocabulary(sorted({w for _, text, keys in TEMPLATES for w in " ".join((text, *keys)).split()} | {w for p, _ in BASE for w in p.split()}))


def _files(column: pa.Array, vocabulary: tk.Vocabulary):
    """(first, end, licence word ids, words per file as offsets) for slices of a column."""
    raw, offs = tk.buffers(column)
    for lo, hi, part, at in tk.slices(raw, offs):
        part = tk.LOWER[part]
        starts, ends, woffs = tk.word_spans(part, at, tk.ALNUM)
        yield lo, hi, vocabulary.ids(tk.word_hashes(part, starts, ends)), woffs


def _places(ids: np.ndarray, owner: np.ndarray, at: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Which of the positions ``at`` start ``phrase`` within one file."""
    last = at + len(phrase) - 1
    at = at[last < len(ids)]
    ok = owner[at] == owner[at + len(phrase) - 1]
    for j, word in enumerate(phrase):
        ok &= ids[at + j] == word
    return at[ok]


def word_frequencies(docs: DataFrame) -> tuple[dict[str, int], int]:
    """In how many files each licence word occurs, and how many files there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = template_vocabulary()
        n = len(vocabulary.words)
        total, files = np.zeros(n, np.int64), 0
        for batch in batches:
            files += batch.num_rows
            for lo, hi, ids, woffs in _files(batch.column("text"), vocabulary):
                owner = np.repeat(np.arange(hi - lo), np.diff(woffs))
                total += np.bincount(np.unique(owner[ids >= 0] * n + ids[ids >= 0]) % n, minlength=n)
        yield pa.RecordBatch.from_arrays([pa.array([*vocabulary.words, ""]), pa.array([*total.tolist(), files])], names=["word", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(released(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"]: r["n"] for r in rows}
    return found, found.pop("", 0)


def scan_slice(index: TemplateIndex, ids: np.ndarray, woffs: np.ndarray) -> list[tuple]:
    """A report for each file of a slice."""
    n = len(woffs) - 1
    owner = np.repeat(np.arange(n), np.diff(woffs))
    base: list[list[tuple[int, str]]] = [[] for _ in range(n)]
    for phrase, label in BASE:
        words = index.phrases[phrase]
        for p in _places(ids, owner, np.flatnonzero(ids == words[0]), words).tolist():
            base[owner[p]].append((p - int(woffs[owner[p]]), label))
    matches: list[dict[tuple[str, int], float]] = [{} for _ in range(n)]
    rare = np.flatnonzero(index.posted[ids])
    rare_words = ids[rare]
    with_phrase: dict[str, set[int]] = {}
    for t, postings in index.postings.items():
        label, _, keys = TEMPLATES[t]
        hits = [(rare[rare_words == word], q) for word, q in postings.tolist()]
        # a start before the file's first word is allowed for: only words within the file count
        proposed = np.unique(np.concatenate([np.stack([at - q, owner[at]], 1) for at, q in hits]), axis=0)
        notice, weights = index.notices[t], index.weights[t]
        for some in np.array_split(proposed, len(proposed) // 4096 + 1):
            place = some[:, :1] + np.arange(len(notice))
            inside = (place >= 0) & (place < len(ids))
            place = np.where(inside, place, 0)
            coverage = (inside & (ids[place] == notice) & (owner[place] == some[:, 1:])) @ weights
            for at in np.flatnonzero(coverage >= COVERAGE).tolist():
                start, d = some[at].tolist()
                for key in keys:
                    if key not in with_phrase:
                        words = index.phrases[key]
                        with_phrase[key] = set(owner[_places(ids, owner, np.flatnonzero(ids == words[0]), words)].tolist())
                if all(d in with_phrase[key] for key in keys):
                    found = (label, start - int(woffs[d]))
                    matches[d][found] = max(matches[d].get(found, 0.0), float(coverage[at]))
    out = []
    for d in range(n):
        starts = [p for p, _ in base[d]]
        own = sorted({label for _, label in base[d]})
        every = sorted({*own, *(label for label, _ in matches[d])})
        score = 1.0 if starts else max(matches[d].values(), default=0.0)
        found = [{"label": label, "start": s, "coverage": c} for (label, s), c in sorted(matches[d].items())]
        out.append((int(woffs[d + 1] - woffs[d]), len(starts), min(starts, default=None), max(starts, default=None), ",".join(own), ",".join(every), min(score, 1.0), found))
    return out


def scan_licenses(docs: DataFrame) -> DataFrame:
    """A report (see ``REPORT``) for every row of ``docs`` (doc_id, text).

    ``matches`` are the notices found with their start word (negative where a notice's
    first words are missing) and coverage; ``score`` is 1 with a base phrase, else the
    best coverage, else 0. A null or empty text has no words, null first and last words
    and empty labels. Repeated rows and null ids come out as they came in; other columns
    are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(TemplateIndex(*word_frequencies(docs)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            rows: list[tuple] = []
            for _, _, ids, woffs in _files(batch.column("text"), index.vocabulary):
                rows += scan_slice(index, ids, woffs)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("coverage", pa.float64())]))]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(released(scan), REPORT)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query over all of ``documents``."""
    return scan_licenses(table(spark, sf_dir, "documents", "doc_id", "text")).drop("matches")
