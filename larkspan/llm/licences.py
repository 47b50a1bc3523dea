"""Licence scan by a positional index of rare words.

Each template lists its postings (word, position). The words of a template that
are rarest in the corpus are indexed; a file is looked up by its own indexed
words, the postings are intersected by relative position (file position less
template position), and an alignment counts only if the mandatory key phrases
of the template stand where it expects them.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.textkernel import text_buffer

#: Every byte of a word as itself, A-Z lower-cased, all else a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
PIECE = 4 << 20


def tokens(raw: bytes) -> list[bytes]:
    """Words of a text given in UTF-8."""
    return raw.translate(_FOLD).split()


@dataclass(frozen=True)
class Template:
    """A notice, the label it stands for, the phrases it can't lack, and the least share of its words in place."""

    label: str
    text: str
    phrases: tuple[str, ...]
    least: float = 0.7
    base: bool = False


# Base phrases with their labels, and wordings of public licence notices.
BASE = (
    Template("mit", "mit license", ("mit license",), 1.0, True),
    Template("apache", "apache license", ("apache license",), 1.0, True),
    Template("gpl", "general public license", ("general public license",), 1.0, True),
)
NOTICES = (
    Template("mit-notice", "released under the mit license", ("mit license",), 0.8),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted", "free of charge")),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2"), 0.8),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("except in compliance with the license", "apache org licenses")),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("general public license", "version 3"), 0.8),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("general public license", "free software foundation")),
    Template("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", ("lesser general public license",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc",), 0.8),
    Template("cc-by-sa", "licensed under the creative commons attribution sharealike license", ("creative commons attribution sharealike",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "with or without modification")),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)


class Index:
    """Postings of the `rare` rarest words of each template under the given document frequencies."""

    def __init__(self, templates, frequency: dict[bytes, int], n_docs: int, rare: int = 6):
        self.templates = []
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.idf = {w: math.log((1 + n_docs) / (1 + frequency.get(w, 0))) for t in templates for w in tokens(t.text.encode())}
        for k, t in enumerate(templates):
            ws = tokens(t.text.encode())
            top = set(sorted(set(ws), key=lambda w: (-self.idf[w], w))[:rare])
            places = [(w, i) for i, w in enumerate(ws) if w in top]
            for w, i in places:
                self.postings[w].append((k, i))
            phrases = []
            for p in (tokens(p.encode()) for p in t.phrases):
                phrases.append((next(i for i in range(len(ws)) if ws[i : i + len(p)] == p), p))
            self.templates.append((t, ws, phrases, max(1, math.ceil(t.least * len(places) - 1e-9))))
        self.postings = dict(self.postings)
        self.longest = max(len(ws) for _, ws, _, _ in self.templates)

    def scan(self, words: list[bytes], lo: int, hi: int):
        """(template number, offset, share in place) of each verified alignment with lo <= offset < hi."""
        get, votes = self.postings.get, Counter()
        for p in [i for i, w in enumerate(words) if w in self.postings]:
            for k, i in get(words[p]):
                if lo <= p - i < hi:
                    votes[k, p - i] += 1
        for (k, at), n in votes.items():
            t, ws, phrases, least = self.templates[k]
            if n < least:
                continue
            if any(at + i < 0 or words[at + i : at + i + len(p)] != p for i, p in phrases):
                continue
            here = words[max(at, 0) : at + len(ws)]
            share = sum(a == b for a, b in zip(here, ws[max(0, -at) :])) / len(ws)
            if share >= t.least - 1e-9:
                yield k, at, share


def _pieces(raw: bytes, longest: int):
    """(words, number of the first one, owned offsets lo and hi): whole short texts, long ones a piece at a time."""
    if len(raw) <= PIECE:
        ws = tokens(raw)
        yield ws, 0, -longest, len(ws)
        return
    at, kept, first, lo = 0, [], 0, -longest
    while at < len(raw):
        stop = min(len(raw), at + PIECE)
        folded = raw[at:stop].translate(_FOLD)
        while stop < len(raw) and (cut := folded.rfind(b" ")) < 0:
            folded += raw[stop : stop + PIECE].translate(_FOLD)
            stop = min(len(raw), stop + PIECE)
        if stop < len(raw):
            stop = at + cut + 1
            folded = folded[: cut + 1]
        ws = kept + folded.split()
        last = stop >= len(raw)
        hi = len(ws) if last else max(lo, len(ws) - longest)
        yield ws, first, lo, hi
        drop = max(0, hi - longest)
        kept, first, lo, at = ws[drop:], first + drop, hi - drop, stop


def scan_text(raw: bytes, index: Index) -> tuple:
    """n_words, n_base, first_word, last_word, base labels, labels, score of one text."""
    n_base, first, last, base, labels, score, n = 0, None, None, set(), set(), 0.0, 0
    for ws, start, lo, hi in _pieces(raw, index.longest):
        n = start + len(ws)
        for k, at, share in index.scan(ws, lo, hi):
            t = index.templates[k][0]
            labels.add(t.label)
            if t.base:
                p = start + at
                n_base, base = n_base + 1, base | {t.label}
                first, last = p if first is None else min(first, p), p if last is None else max(last, p)
            score = max(score, 0.5 if t.base else share)
    return n, n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), score


def word_frequencies(df: DataFrame, text: str, vocabulary: set[bytes]) -> tuple[dict[bytes, int], int]:
    """Documents that hold each word of the vocabulary, over all documents; the result is as large as the vocabulary."""
    marker = ""

    def work(batches):
        seen, n = Counter(), 0
        for b in batches:
            data, bounds = text_buffer(b.column(0))
            for i in range(b.num_rows):
                n += 1
                found = set()
                for ws, *_ in _pieces(data[bounds[i] : bounds[i + 1]].tobytes(), 1):
                    found |= vocabulary.intersection(ws)
                seen.update(found)
        words = [marker, *(w.decode() for w in seen)]
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array([n, *seen.values()], pa.int64())], names=["word", "n"])

    rows = df.select(F.col(text).cast("string").alias("text")).mapInArrow(work, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in rows}
    return {w.encode(): c for w, c in counts.items() if w != marker}, counts.get(marker, 0)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licences(df: DataFrame, doc: str = "doc_id", text: str = "text", notices=NOTICES, rare: int = 6) -> DataFrame:
    """One row per document: places of the base phrases, labels, and the best share of a notice's words in place.

    The document frequencies behind "rare" cover all documents. A null text
    counts as empty: no words, no labels, score 0. A document with a base
    phrase and no whole notice scores 0.5. Repeated rows give equal rows, a null
    id stays null, other columns are ignored, an empty table gives no rows.
    """
    templates = (*BASE, *notices)
    vocabulary = {w for t in templates for w in tokens(t.text.encode())}
    frequency, n_docs = word_frequencies(df, text, vocabulary)
    index = Index(templates, frequency, n_docs, rare)

    def work(batches):
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for b in batches:
            data, bounds = text_buffer(b.column(1))
            rows = [scan_text(data[bounds[i] : bounds[i + 1]].tobytes(), index) for i in range(b.num_rows)]
            cols = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return df.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(work, SCHEMA)
