"""Substring dedup by sliding sentence spans.

Every run of consecutive sentences that is just long enough is hashed, runs are
met globally by their hash, and the sentences of every run but the first
occurrence are cut out of the text.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.shared import fresh, materialize
from larkspan.llm.textkernel import Words, mix, words

_U = np.uint64
_Q = 0xD1342543DE82EF95
_Q_INV = pow(_Q, -1, 1 << 64)
#: A run has at least so many sentences and words.
SENTENCES, WORDS = 2, 36
#: A sentence of more words is cut before capitals and after one word in ONE_IN, as its hash says, wherever it begins.
LONG, ONE_IN = 12, 3
_STOPS = np.isin(np.arange(256), list(b".!?"))
_CAPITAL = np.array([chr(c).isupper() for c in range(0x800)])


class Sentences(NamedTuple):
    """First word and end of each sentence of a group of texts, and the texts' offsets in them."""

    first: np.ndarray
    end: np.ndarray
    offsets: np.ndarray


def sentences(w: Words, long: int = LONG) -> Sentences:
    """Sentences end at . ! ? before white space, at a line break, and at the end of the text.

    In sentences of more than `long` words, a word that begins with a capital
    letter (of scripts below U+0800) begins another one, and every word whose
    hash is a multiple of ONE_IN ends one: a passage in the middle of other words
    is so cut in the same places wherever it stands.
    """
    n = len(w.hashes)
    if not n:
        return Sentences(np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(w.offsets), np.int64))
    end = _STOPS[w.data[w.ends - 1]]
    lines = np.flatnonzero(w.data == 10)
    end[:-1] |= np.searchsorted(lines, w.starts[1:]) > np.searchsorted(lines, w.ends[:-1])
    end[w.offsets[1:][np.diff(w.offsets) > 0] - 1] = True
    sid = np.cumsum(end) - end
    run_on = np.bincount(sid)[sid] > long
    end |= run_on & (w.hashes % _U(ONE_IN) == 0)
    end[:-1] |= run_on[:-1] & _capitals(w)[1:]
    stop = np.flatnonzero(end) + 1
    first = np.concatenate([[0], stop[:-1]])
    return Sentences(first, stop, np.searchsorted(first, w.offsets, "left"))


def _capitals(w: Words) -> np.ndarray:
    """Whether each word begins with a capital letter of one or two bytes."""
    lead = w.data[w.starts].astype(np.int64)
    after = w.data[np.minimum(w.starts + 1, len(w.data) - 1)]
    two = (lead >= 0xC2) & (lead < 0xE0) & (after >= 0x80) & (after < 0xC0)
    return _CAPITAL[np.where(two, ((lead & 31) << 6) | (after & 63), np.where(lead < 0x80, lead, 0))]


def _row_of(s: Sentences) -> np.ndarray:
    return np.repeat(np.arange(len(s.offsets) - 1), np.diff(s.offsets))


def runs(s: Sentences, least_sentences: int = SENTENCES, least_words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) in the order of i: from each sentence on, and up to each sentence, the shortest run i..j that is long enough."""
    if not len(s.first):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    row, at = _row_of(s), np.arange(len(s.first))
    j = np.maximum(at + least_sentences - 1, np.searchsorted(s.end, s.first + least_words, "left"))
    ahead = j < s.offsets[1:][row]
    i = np.minimum(at - least_sentences + 1, np.searchsorted(s.first, s.end - least_words, "right") - 1)
    back = i >= s.offsets[:-1][row]
    back &= j[i] != at  # the run from i on is the same
    i, j = np.concatenate([at[ahead], i[back]]), np.concatenate([j[ahead], at[back]])
    order = np.argsort(i, kind="stable")
    return i[order], j[order]


def run_hashes(w: Words, s: Sentences, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Hashes of the word sequences of the runs."""
    n = len(w.hashes)
    with np.errstate(over="ignore"):
        up, down = np.full(n + 1, _Q, _U), np.full(n + 1, _Q_INV, _U)
        up[0] = down[0] = 1
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        sums = np.zeros(n + 1, _U)
        np.cumsum(w.hashes * up[:-1], out=sums[1:])
        a, b = s.first[i], s.end[j]
        return mix((sums[b] - sums[a]) * down[a] + (b - a).astype(_U) * _U(0x9E3779B97F4A7C15)).view(np.int64)


def spans(df: DataFrame, doc: str, text: str, least_sentences: int, least_words: int) -> DataFrame:
    """(h, doc_id, i, j, again) of every run of every text that has an id; sentences are counted from 0.

    `again` tells the runs that an earlier run of the same text equals.
    """

    def work(batches):
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for w in words(b.column(1)):
                s = sentences(w)
                i, j = runs(s, least_sentences, least_words)
                row = _row_of(s)[i] if len(i) else i
                h = run_hashes(w, s, i, j)
                local = s.offsets[:-1][row] if len(i) else i
                again = np.ones(len(i), bool)
                with np.errstate(over="ignore"):
                    again[np.unique(h.view(_U) + mix(row.astype(_U)), return_index=True)[1]] = False
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(ids[w.first : w.last][row].astype(np.int64)), pa.array((i - local).astype(np.int32)), pa.array((j - local).astype(np.int32)), pa.array(again)], names=["h", "doc_id", "i", "j", "again"])

    rows = df.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(work, "h long, doc_id long, i int, j int, again boolean")


CUT = "struct<text string, sentences_removed int, words_removed int>"


def _cut_column():
    """UDF(text, found spans) that removes the covered sentences."""

    def cut(texts: pa.Array, found: pa.Array) -> pa.Array:
        n = pc.fill_null(pc.list_value_length(found), 0).to_numpy().astype(np.int64)
        at, flat = np.concatenate([[0], np.cumsum(n)]), found.flatten()
        span_i, span_j, span_h = (pc.struct_field(flat, c).to_numpy() for c in ("i", "j", "h"))
        removed, lost, changed, new = np.zeros(len(texts), np.int32), np.zeros(len(texts), np.int32), np.zeros(len(texts), bool), []
        hit = np.flatnonzero(n)
        for w in words(texts.take(pa.array(hit)).cast(pa.large_string())) if len(hit) else ():
            s, rows = sentences(w), hit[w.first : w.last]
            own = slice(at[rows[0]], at[rows[-1] + 1])  # rows between them have no spans
            doc = np.repeat(np.arange(len(rows)), n[rows])
            i, j = span_i[own] + s.offsets[:-1][doc], span_j[own] + s.offsets[:-1][doc]
            fits = j < s.offsets[1:][doc]
            i, j, h = i[fits], j[fits], span_h[own][fits]
            true = run_hashes(w, s, i, j) == h  # an id may stand on several texts
            depth = np.zeros(len(s.first) + 1, np.int64)
            np.add.at(depth, i[true], 1)
            np.add.at(depth, j[true] + 1, -1)
            gone = np.cumsum(depth)[:-1] > 0
            size = s.end - s.first
            for k in np.flatnonzero(np.add.reduceat(np.append(gone, False), np.minimum(s.offsets[:-1], len(gone))) * (np.diff(s.offsets) > 0)):
                lo, hi = s.offsets[k], s.offsets[k + 1]
                here = gone[lo:hi]
                edges = np.append(w.starts[s.first[lo:hi]], w.bounds[k + 1])
                kept = [w.data[w.bounds[k] : edges[0]].tobytes()] + [w.data[edges[x] : edges[x + 1]].tobytes() for x in np.flatnonzero(~here)]
                new.append(b"".join(kept).decode() if not here.all() else "")
                changed[rows[k]], removed[rows[k]], lost[rows[k]] = True, here.sum(), size[lo:hi][here].sum()
        out = pc.replace_with_mask(texts, pa.array(changed), pa.array(new, texts.type))
        return pa.StructArray.from_arrays([out, pa.array(removed), pa.array(lost)], names=["text", "sentences_removed", "words_removed"])

    return F.arrow_udf(cut, CUT)


def dedup_substrings(df: DataFrame, doc: str = "doc_id", text: str = "text", least_sentences: int = SENTENCES, least_words: int = WORDS) -> DataFrame:
    """df with `text` less its repeated spans, and as last column _cut (text, sentences_removed, words_removed).

    A span is a run of at least `least_sentences` sentences and `least_words`
    words that begins or ends at any sentence and is no longer than it must be. Words are compared
    with A-Z lower-cased and white space aside. Of all occurrences the first one in the document
    with the smallest doc_id stays; sentences
    covered by any other occurrence go, with the white space behind them. Rows
    without text or id pass unchanged and count for nothing; rows that share an
    id count as one document and keep the spans that they share. Every row and column
    of df is kept; an emptied text becomes ''; an empty table gives no rows. If df has a column
    _cut, it stays and the last column has the first free name of _cut_, _cut__, ... Hashes have 64 bits.
    """
    found = spans(df, doc, text, least_sentences, least_words)  # hashed twice: that costs less than to keep all spans
    again = found.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("origin")).filter("n > 1").select("h", "origin")
    again = materialize(again, "substring-repeats")  # written, so that a very frequent span can be split in the join
    later = found.join(again, "h").filter((F.col("doc_id") != F.col("origin")) | F.col("again"))
    key, held, cut = fresh(df, "_cut_id"), fresh(df, "_cut_spans"), fresh(df, "_cut")
    lists = later.groupBy(F.col("doc_id").alias(key)).agg(F.collect_list(F.struct("i", "j", "h")).alias(held))
    lists = materialize(lists, "substring-cuts")
    joined = df.join(lists, F.col(f"`{doc}`").cast("long") == F.col(key), "left")
    out = joined.withColumn(cut, _cut_column()(F.col(f"`{text}`").cast("string"), F.col(held)))
    return out.select(*[F.col(f"{cut}.text").alias(c) if c == text else F.col(f"`{c}`") for c in df.columns], cut)
