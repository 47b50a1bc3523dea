"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so resemblance says nothing and
containment is what counts. Each item keeps the smallest MinHash values of its
shingles; an item of s shingles can miss at most floor((1 - t) * s) of them at
containment t, so one value more than the most that its size class can miss
leaves no item unfound. A document is held against the classes that it is large
enough for; a shared value makes a candidate, and exact containment of the full
shingle sets decides.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.textkernel import mix, shingles, words

_U = np.uint64
_SEED = _U(0xA24BAED4963EE407)
#: Items in one broadcast index, and characters of them; more are searched block by block.
BLOCK_ITEMS, BLOCK_CHARS = 50_000, 64 << 20
_FILTER_BITS = 22


class Index:
    """MinHash values of the items, by shingle length and size class."""

    def __init__(self, items: list[tuple[int | None, str | None]], threshold: float = 0.8, k: int = 5):
        self.threshold, self.items = threshold, []
        tables: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for item_id, text in items:
            w = next(words(pa.array([text], pa.large_string())))
            n = len(w.hashes)
            if not n:
                continue
            width = min(k, n)
            s = np.unique(shingles(w.hashes, w.offsets, width)[0])
            number = len(self.items)
            self.items.append((item_id, s))
            part = max(0, int(len(s) - 1).bit_length())
            most = 1 << part  # the class holds sizes over most / 2, up to most
            sketch = np.sort(mix(s ^ _SEED))[: math.floor((1 - threshold) * most + 1e-9) + 1]
            tables.setdefault((width, part), []).extend((int(v), number) for v in sketch)
        self.tables: dict[int, list] = {}
        for (width, part), rows in sorted(tables.items()):
            rows.sort()
            values = np.array([v for v, _ in rows], _U)
            bits = np.zeros(1 << _FILTER_BITS, bool)
            bits[(values >> _U(64 - _FILTER_BITS)).astype(np.int64)] = True
            least = math.ceil(threshold * ((1 << part) // 2 + 1) - 1e-9) if part else 1
            self.tables.setdefault(width, []).append((least, values, np.array([i for _, i in rows]), bits))

    def search(self, texts: pa.Array):
        """(row, item number, shared shingles) of every item that a text contains."""
        for w in words(texts):
            found: set[tuple[int, int, int]] = set()
            kept = {}
            for width, tables in self.tables.items():
                h, o = shingles(w.hashes, w.offsets, width)
                n = np.diff(o)
                if width > 1:  # a shorter text's whole sequence is no run of this length
                    n = np.where(np.diff(w.offsets) >= width, n, 0)
                row = np.repeat(np.arange(len(n)), np.diff(o))
                v = mix(h ^ _SEED)
                kept[width] = h, o
                top = (v >> _U(64 - _FILTER_BITS)).astype(np.int64)
                for least, values, owner, bits in tables:
                    at = np.flatnonzero(bits[top])
                    at = at[n[row[at]] >= least]
                    lo, hi = np.searchsorted(values, v[at], "left"), np.searchsorted(values, v[at], "right")
                    for a, b, r in zip(lo[hi > lo], hi[hi > lo], row[at[hi > lo]]):
                        found.update((int(r), width, int(i)) for i in owner[a:b])
            sets: dict[tuple[int, int], np.ndarray] = {}
            for r, width, i in sorted(found):
                if (r, width) not in sets:
                    h, o = kept[width]
                    sets = {(r, width): np.unique(h[o[r] : o[r + 1]])}
                s, own = self.items[i][1], sets[r, width]
                at = np.minimum(np.searchsorted(own, s), len(own) - 1)
                both = int((own[at] == s).sum())
                if both >= self.threshold * len(s) - 1e-9:
                    yield w.first + r, i, both


def _blocks(items: DataFrame, item: str, text: str, threshold: float, k: int):
    """Indexes over the items, none larger than a block; how many blocks follows from their number and length."""
    rows = items.select(F.col(item).cast("long").alias("item_id"), F.col(text).cast("string").alias("text"))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-size // BLOCK_CHARS))
    for b in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else rows
        yield Index([(r["item_id"], r["text"]) for r in part.collect()], threshold, k)


MATCHES = "doc_id long, item_id long, n_shingles long, n_shared long, containment double"


def find_items(df: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = 0.8, k: int = 5) -> DataFrame:
    """One row per document and item with containment of at least `threshold`.

    containment is the share of the item's distinct k-word shingles (all its
    words where it has fewer) that the document has. Words are compared with
    A-Z lower-cased. Null or empty texts match nothing. Repeated rows give
    equal rows, null ids stay null, other columns are ignored, either table may
    be empty. Items are the stated query set: they are broadcast in blocks of
    bounded size, and every block is searched over all documents.
    """
    rows = df.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = None
    for index in _blocks(items, item, item_text, threshold, k):
        shared = df.sparkSession.sparkContext.broadcast(index)

        def work(batches, shared=shared):
            m = shared.value
            for b in batches:
                hits = [(b.column(0)[r].as_py(), m.items[i][0], len(m.items[i][1]), both, both / len(m.items[i][1])) for r, i, both in m.search(b.column(1))]
                cols = list(zip(*hits)) or [()] * 5
                kinds = [pa.int64()] * 4 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in MATCHES.split(", ")])

        part = rows.mapInArrow(work, MATCHES)
        out = part if out is None else out.unionByName(part)
    return out


def _hit(shared):
    """UDF(text): does it contain an item of the broadcast index?"""

    def hit(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts), bool)
        for r, _, _ in shared.value.search(texts):
            out[r] = True
        return pa.array(out)

    return F.arrow_udf(hit, "boolean")


def drop_contaminated(df: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = 0.8, k: int = 5) -> DataFrame:
    """df without the rows whose text contains an item; no shuffle, all columns kept."""
    for index in _blocks(items, item, item_text, threshold, k):
        hit = _hit(df.sparkSession.sparkContext.broadcast(index))
        df = df.filter(~hit(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    return df
