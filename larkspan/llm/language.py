"""Language identification by prediction by partial matching (PPM).

For each language a variable-order tree of byte contexts is counted; a text's
score is its exact code length in bits under those frozen counts, with escape
probabilities of method C (distinct symbols / (total + distinct)) from each
context down to the uniform one. The trees are flattened into hash tables: one
from context+symbol to the code lengths of all languages, one from context to
their escape costs. A text is then a few table lookups per byte, in numpy.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.shared import remainder
from larkspan.llm.textkernel import _LOWER, text_buffer

ORDER = 3
#: Documents per language that the classifier is fitted on, at most about so many, taken by a hash of the id.
SAMPLE_DOCS = 600
#: Languages in one block of a model; blocks are counted and scored one after another.
MOST_LANGUAGES = 64
WINDOW = 1 << 20
_FOLD = _LOWER.astype(np.uint8)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LETTER = regex.compile(r"\p{L}")


def _grams(data: np.ndarray, n: int) -> np.ndarray:
    """Keys of the n-byte runs that end at bytes n-1, n, ...; the length is the key's lowest byte."""
    key = np.zeros(max(0, len(data) - n + 1), np.uint64)
    for j in range(n):
        key = (key << np.uint64(8)) | data[j : len(data) - n + 1 + j]
    return (key << np.uint64(8)) | np.uint64(n)


class Table:
    """Open-addressing hash table from nonzero 64-bit keys to row numbers; absent keys give -1."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(8, int(len(keys) * 4).bit_length())
        self.slots = np.zeros(1 << self.bits, np.uint64)
        self.rows = np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(left):
            free = np.flatnonzero(self.slots[at] == 0)
            _, one = np.unique(at[free], return_index=True)
            put = free[one]
            self.slots[at[put]], self.rows[at[put]] = keys[left[put]], left[put]
            stay = np.ones(len(left), bool)
            stay[put] = False
            left, at = left[stay], (at[stay] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * _MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        got = self.slots[at]
        out = np.where(got == keys, self.rows[at], np.int32(-1))
        todo = np.flatnonzero((got != keys) & (got != 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            got = self.slots[at[todo]]
            out[todo] = np.where(got == keys[todo], self.rows[at[todo]], np.int32(-1))
            todo = todo[(got != keys[todo]) & (got != 0)]
        return out


def count_contexts(texts, order: int = ORDER, held: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of all runs of 1 to order+1 bytes in the texts of one language; about `held` keys are in memory besides the result."""
    keys, counts, new, n = np.empty(0, np.uint64), np.empty(0, np.int64), [], 0

    def merge():
        found, c = np.unique(np.concatenate(new), return_counts=True)
        every, at = np.unique(np.concatenate([keys, found]), return_inverse=True)
        return every, np.bincount(at, np.concatenate([counts, c]), len(every)).astype(np.int64)

    for t in texts:
        data = _FOLD[np.frombuffer(t.encode(), np.uint8)]
        for lo in range(0, len(data), held):
            for size in range(1, order + 2):
                new.append(_grams(data[lo : lo + held + size - 1], size))
                n += len(new[-1])
            if n > held:
                keys, counts = merge()
                new, n = [], 0
    if new:
        keys, counts = merge()
    return keys, counts


class Model:
    """Frozen code lengths of the languages of one block."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER):
        self.languages, self.order = sorted(counts), order
        n = len(self.languages)
        every = np.unique(np.concatenate([k for k, _ in counts.values()] or [np.empty(0, np.uint64)]))
        length = (every & np.uint64(255)).astype(np.int64)
        context = ((every >> np.uint64(16)) << np.uint64(8)) | (length - 1).astype(np.uint64)
        shorter = lambda keys, size: (((keys >> np.uint64(8)) & np.uint64((1 << (8 * size)) - 1)) << np.uint64(8)) | np.uint64(size)
        contexts = np.unique(context)
        self.bits = np.zeros((len(every), n), np.float32)
        self.escape = np.zeros((len(contexts), n), np.float32)
        at = np.searchsorted(contexts, context)
        for j, lang in enumerate(self.languages):
            keys, c = counts[lang]
            count = np.zeros(len(every))
            count[np.searchsorted(every, keys)] = c
            total = np.bincount(at, count, len(contexts))
            distinct = np.bincount(at, count > 0, len(contexts))
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
                own = -np.log2(count / (total[at] + distinct[at]))
            self.escape[:, j] = escape
            bits = np.where(count > 0, own, 0.0)
            for size in range(1, order + 2):  # a symbol not seen in this context costs an escape and the shorter context's code
                i = np.flatnonzero((length == size) & (count == 0))
                if size == 1:
                    below = np.full(len(i), 8.0)
                else:
                    below = bits[np.searchsorted(every, shorter(every[i], size - 1))]
                bits[i] = escape[at[i]] + below
            self.bits[:, j] = bits
        self.symbols, self.contexts = Table(every), Table(contexts)
        #: Code lengths in the empty context of bytes that no language has seen.
        root = self.escape[np.flatnonzero(contexts == 0)[0]] if len(contexts) and contexts[0] == 0 else np.zeros(n, np.float32)
        self.unseen = (root + 8.0).astype(np.float32)

    def lengths(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Bits of each text under each language; contexts don't reach over a text's beginning."""
        out = np.zeros((len(bounds) - 1, len(self.languages)))
        for lo in range(0, len(data), WINDOW):
            hi = min(len(data), lo + WINDOW)
            head = max(0, lo - self.order)
            cost = self._costs(_FOLD[data[head:hi]], lo - head, bounds - head)
            i = np.searchsorted(bounds, lo, "right") - 1
            j = np.searchsorted(bounds, hi, "left")
            own = np.arange(i, j)
            own = own[bounds[own] < bounds[own + 1]]
            at = np.maximum(bounds[own], lo) - lo
            out[own] += np.add.reduceat(cost, at, axis=0)
        return out

    def _costs(self, data: np.ndarray, skip: int, bounds: np.ndarray) -> np.ndarray:
        n = len(data)
        room = np.full(n, self.order, np.int64)  # bytes of the same text before this one
        inside = bounds[(bounds >= 0) & (bounds < n)]
        for d in range(self.order):
            at = inside + d
            at = at[at < n]
            room[at] = np.minimum(room[at], d)
        if not len(inside) or inside[0] > 0 or skip == 0:
            room[: self.order] = np.minimum(room[: self.order], np.arange(min(n, self.order)))
        cost = np.zeros((n, len(self.languages)), np.float32)
        wide = data.astype(np.uint64)
        todo = np.arange(skip, n)
        for size in range(self.order, -1, -1):
            now = todo[room[todo] >= size] if size else todo
            rest = todo[room[todo] < size] if size else todo[:0]
            key = np.zeros(len(now), np.uint64)
            for d in range(size, -1, -1):
                key = (key << np.uint64(8)) | wide[now - d]
            row = self.symbols.find((key << np.uint64(8)) | np.uint64(size + 1))
            hit = row >= 0
            cost[now[hit]] += self.bits[row[hit]]
            miss = now[~hit]
            if size == 0:
                cost[miss] += self.unseen
                break
            above = self.contexts.find(((key[~hit] >> np.uint64(8)) << np.uint64(8)) | np.uint64(size))
            known = above >= 0
            cost[miss[known]] += self.escape[above[known]]
            todo = np.concatenate([miss, rest])
        return cost[skip:]


class Blocks:
    """Models of any number of languages, in blocks of at most MOST_LANGUAGES by code point."""

    def __init__(self, models: list[Model], order: int = ORDER):
        self.models, self.order = models, order
        self.languages = [k for m in models for k in m.languages]

    def shortest(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text the first language with the least bits, those bits, and the sum over all languages of 2 ** (least - bits)."""
        n, before = len(bounds) - 1, 0
        best, least, total = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros(n)
        for m in self.models:
            bits = m.lengths(data, bounds)
            own = bits.min(axis=1)
            best = np.where(own < least, before + bits.argmin(axis=1), best)
            low = np.minimum(least, own)
            total = total * np.exp2(np.maximum(low - least, -1000)) + np.exp2(np.maximum(low[:, None] - bits, -1000)).sum(axis=1)
            least, before = low, before + len(m.languages)
        return best, least, total


def _blocks(model: Model | Blocks) -> Blocks:
    return model if isinstance(model, Blocks) else Blocks([model] if model.languages else [], model.order)


def train(df: DataFrame, doc: str = "doc_id", text: str = "text", lang: str = "lang", order: int = ORDER, sample_docs: int = SAMPLE_DOCS) -> Blocks:
    """Fit on whole texts of about `sample_docs` labelled rows a language (a documented bound), chosen by a hash of the id.

    Rows held out (crc32 of the id modulo 4 is 2) and rows without text or
    language are never read. Counting is done for each language in a task of
    its own, MOST_LANGUAGES of them at once; what comes back of each is bounded
    by the sample, so the model grows with the number of languages only.
    """
    known = df.select(F.col(doc).alias("doc_id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).filter((remainder("doc_id", 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    spread = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("ppm")), F.lit(1 << 40))

    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        keys, c = count_contexts(rows["text"], order)
        return pd.DataFrame({"lang": [key[0]], "keys": [keys.tobytes()], "counts": [c.astype("<i8").tobytes()]})

    models, names = [], sorted(sizes)
    for lo in range(0, len(names), MOST_LANGUAGES):
        block = names[lo : lo + MOST_LANGUAGES]
        share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(math.ceil((1 << 40) * min(1.0, sample_docs / sizes[k])))) for k in block])
        found = known.filter(spread < share).groupBy("lang").applyInPandas(count, "lang string, keys binary, counts binary").collect()
        if found:
            models.append(Model({r["lang"]: (np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["counts"], "<i8")) for r in found}, order))
    return Blocks(models, order)


def _lettered(texts: pa.Array) -> np.ndarray:
    """Which texts have a letter; one text at a time is a Python string."""
    return np.fromiter((t.is_valid and _LETTER.search(t.as_py()) is not None for t in texts), bool, len(texts))


SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, bits_per_byte double"


def identify(df: DataFrame, model: Model | Blocks, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the language with the shortest code, its posterior under equal priors, bits per byte.

    `und` with score 0 where the text is null or has no letter, or no language
    was learned. Ties go to the first language by code point. Repeated rows give
    equal rows, other columns are ignored, an empty table gives no rows. Every
    byte of every text is scored.
    """
    shared = df.sparkSession.sparkContext.broadcast(_blocks(model))

    def work(batches):
        m = shared.value
        for b in batches:
            data, bounds = text_buffer(b.column(2))
            best, least, total = m.shortest(data, bounds)
            ok = _lettered(b.column(2)) & bool(m.languages)
            score = np.where(ok, 1 / np.where(ok, total, 1.0), 0.0)
            rate = least / np.maximum(np.diff(bounds), 1)
            names = [m.languages[k] if o else "und" for k, o in zip(best, ok)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array(names, pa.string()), pa.array(score), pa.array(np.where(ok, rate, 0.0))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return df.select(F.col(doc).cast("long").alias("doc_id"), (remainder(doc, 4) == 2).alias("held_out"), F.col(text).cast("string").alias("text")).mapInArrow(work, SCHEMA)


#: Bits per byte of the uniform code; a text that no learned language codes in fewer is in none of them.
UNIFORM = 8.0


def keep_identified(df: DataFrame, model: Model | Blocks, text: str = "text", most_bits: float = UNIFORM) -> DataFrame:
    """df without the rows that are `und` or cost more than `most_bits` per byte in every language; no shuffle, all columns kept."""
    shared = df.sparkSession.sparkContext.broadcast(_blocks(model))

    def known(texts: pa.Array) -> pa.Array:
        m = shared.value
        data, bounds = text_buffer(texts)
        if not m.languages:
            return pa.array(np.zeros(len(texts), bool))
        rate = m.shortest(data, bounds)[1] / np.maximum(np.diff(bounds), 1)
        return pa.array(_lettered(texts) & (rate <= most_bits))

    return df.filter(F.arrow_udf(known, "boolean")(F.col(text).cast("string")))
