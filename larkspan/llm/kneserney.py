"""Interpolated modified Kneser-Ney n-gram model, counted in Spark, kept as sorted hash arrays, read through memory maps.

Words are 64-bit hashes. N-grams are counted in packed blocks: a task sorts and
counts what it has read, deals the n-grams to shards, and hands each shard one
compressed block; a shard merges its blocks and writes its n-grams and counts,
sorted by hash, to the shared folder. A context's n-grams are spread over
SPREAD shards, so that a very frequent context is no task of its own; the sums
that a context needs are additive and meet in a second, smaller exchange. Lower
orders follow from the shards' distinct n-grams, as continuation counts.
Workers map the arrays and look up sorted batches.

p(w | c) = max(n(cw) - D(n(cw)), 0) / n(c) + g(c) p(w | c'), with
g(c) = (D1 N1(c) + D2 N2(c) + D3 N3+(c)) / n(c), down to the uniform
distribution over the vocabulary and one unknown word.
"""

from __future__ import annotations

import functools
import io
import os
import shutil
import tempfile
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.shared import materialize, open_fs, remainder, workdir
from larkspan.llm.textkernel import combine, words
from larkspan.llm.warc import _Replace

_U = np.uint64
#: Hashes of the token that ends every text and of the one before its beginning.
END, BEGIN = (_U(0x0E0D0E0D0E0D0E0D), _U(0x0B0E0B0E0B0E0B0E))
#: N-grams that a task holds before it sorts and hands on.
HELD = 1 << 21
#: Shards that the n-grams of one context are spread over.
SPREAD = 16
#: Bytes of the input's files for each shard; shards are never fewer than shuffle partitions.
SHARD_BYTES = 10 << 20
#: Bytes of fetched arrays that a worker keeps mapped, where the model is on no local file system.
FETCHED = 4 << 30
PART = "kind int, shard int, data binary"


def _planes(values: np.ndarray) -> bytes:
    """Fixed-width values as byte planes, which compress well where high bytes are alike."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes() if len(values) else b""


def _joined(raw: bytes, at: int, n: int, kind: str) -> tuple[np.ndarray, int]:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, size * n, at).reshape(size, n).T).view(kind).ravel(), at + size * n


def pack(columns: list[np.ndarray], counts: np.ndarray) -> bytes:
    """Rows sorted by the first column as bytes: it goes by differences, the others by a table of their values."""
    n = len(counts)
    with np.errstate(over="ignore"):
        parts = [_planes(np.diff(columns[0], prepend=_U(0)).astype("<u8"))]
        tables = []
        for c in columns[1:]:
            u, inv = np.unique(c, return_inverse=True)
            tables.append(len(u))
            parts += [_planes(np.diff(u, prepend=_U(0)).astype("<u8")), _planes(inv.astype("<u4"))]
    parts.append(_planes(counts.astype("<i8")))
    head = np.array([n, len(columns), *tables], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))


def unpack(data: bytes) -> tuple[list[np.ndarray], np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, k = (int(x) for x in np.frombuffer(raw, "<i8", 2))
    tables = [int(x) for x in np.frombuffer(raw, "<i8", k - 1, 16)]
    first, at = _joined(raw, 8 * (k + 1), n, "<u8")
    cols = [np.cumsum(first, dtype=_U)]
    for size in tables:
        u, at = _joined(raw, at, size, "<u8")
        inv, at = _joined(raw, at, n, "<u4")
        cols.append(np.cumsum(u, dtype=_U)[inv])
    return cols, _joined(raw, at, n, "<i8")[0]


def tally(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows in order, with summed counts."""
    if not len(counts):
        return columns, counts
    order = np.lexsort(columns[::-1])
    cols = [c[order] for c in columns]
    new = np.concatenate([[True], functools.reduce(np.logical_or, [c[1:] != c[:-1] for c in cols])])
    at = np.flatnonzero(new)
    return [c[at] for c in cols], np.add.reduceat(counts[order], at)


def shard_of(columns: list[np.ndarray], shards: int) -> np.ndarray:
    """Shard of n-grams by their context, spread by their last word; of single words by themselves."""
    last = columns[-1] >> _U(20)
    if len(columns) == 1:
        return (last % _U(shards)).astype(np.int32)
    step = max(1, shards // SPREAD)
    key = (combine(columns[:-1], 11) >> _U(40)) + (last % _U(SPREAD)) * _U(step)
    return (key % _U(shards)).astype(np.int32)


def context_shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> _U(20)) % _U(shards)).astype(np.int32)


def _deal(kind: int, columns: list[np.ndarray], counts: np.ndarray, shard: np.ndarray):
    """A record batch of (kind, shard, packed rows); rows are sorted."""
    if not len(counts):
        return
    order = np.argsort(shard, kind="stable")
    edges = np.flatnonzero(np.diff(shard[order], prepend=-1))
    ids, blobs = [], []
    for a, b in zip(edges, np.append(edges[1:], len(order))):
        at = order[a:b]
        ids.append(int(shard[at[0]]))
        blobs.append(pack([c[at] for c in columns], counts[at]))
    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), kind, np.int32)), pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], names=["kind", "shard", "data"])


def token_stream(column: pa.Array):
    """(hashes with END after each text, offsets, first row, last row) of a few texts at a time."""
    for w in words(column):
        n = np.diff(w.offsets)
        off = np.concatenate([[0], np.cumsum(n + 1)])
        out = np.full(int(off[-1]), END, _U)
        keep = np.ones(len(out), bool)
        keep[off[1:] - 1] = False
        out[keep] = w.hashes
        yield out, off, w.first, w.last


def grams(tokens: np.ndarray, offsets: np.ndarray, order: int) -> list[np.ndarray]:
    """Columns of the n-gram that ends at each token, with BEGIN before a text's first token."""
    cols = [tokens]
    place = np.arange(len(tokens)) - np.repeat(offsets[:-1], np.diff(offsets))
    for d in range(1, order):
        cols.insert(0, np.where(place >= d, np.concatenate([np.full(min(d, len(tokens)), BEGIN), tokens[:-d] if d < len(tokens) else tokens[:0]])[: len(tokens)], BEGIN))
    return cols


class Model(NamedTuple):
    """Where a trained model lies, and its totals; discounts[k] are those of order k."""

    uri: str
    order: int
    shards: int
    tokens: int
    vocabulary: int
    unknown: float
    total: int
    discounts: dict[int, tuple[float, float, float]]


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of n-grams seen 1, 2, 3 and 4 times.

    Where counts are too few for the estimate a discount falls back to
    1/2, and each is kept between 0 and its count.
    """
    n1, n2, n3, n4 = n
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    est = [k - (k + 1) * y * b / a if a and b else 0.5 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(d, 0.0), float(k)) for k, d in enumerate(est, 1))


def _save(uri: str, name: str, array: np.ndarray) -> None:
    """An NPY file in the shared folder, whole or not at all."""
    fs, top = open_fs(uri)
    fs.create_dir(top, recursive=True)
    head = io.BytesIO()
    array = np.ascontiguousarray(array)
    np.lib.format.write_array_header_1_0(head, np.lib.format.header_data_from_array_1_0(array))
    with _Replace(fs, f"{top}/{name}.npy") as out:
        out.write(head.getvalue())
        out.write(memoryview(array).cast("B"))


def _small(counts: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as they need."""
    return counts.astype(np.min_scalar_type(int(counts.max()) if len(counts) else 0))


def _sum_columns(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows of one key column, the other columns summed."""
    order = np.argsort(columns[0], kind="stable")
    cols = [c[order] for c in columns]
    at = np.flatnonzero(np.concatenate([[True], cols[0][1:] != cols[0][:-1]]))
    return [cols[0][at], *(np.add.reduceat(c, at) for c in cols[1:])], np.ones(len(at), np.int64)


def _merged(parts: DataFrame, fn, schema: str, shards: int, reduce=tally) -> DataFrame:
    """fn(kind, shard, columns, counts) -> record batches, over the merged blocks of each shard."""

    def work(batches):
        now, cols, counts, size, least = None, [], [], 0, 0

        def merge():
            return reduce([np.concatenate([c[k] for c in cols]) for k in range(len(cols[0]))], np.concatenate(counts))

        for b in batches:
            for kind, shard, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if (kind, shard) != now:
                    if now is not None:
                        yield from fn(*now, *merge())
                    now, cols, counts, size, least = (kind, shard), [], [], 0, HELD
                c, n = unpack(data.as_py())
                cols.append(c)
                counts.append(n)
                size += len(n)
                if size > least:  # what is held stays near the number of distinct rows
                    c, n = merge()
                    cols, counts, size, least = [c], [n], len(n), max(HELD, 2 * len(n))
        if now is not None:
            yield from fn(*now, *merge())

    return parts.repartitionById(shards, F.col("shard")).sortWithinPartitions("kind", "shard").mapInArrow(work, schema)


def shards_for(df: DataFrame) -> int:
    """Shards so that each takes about SHARD_BYTES of the files that df reads, whatever their total."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    few = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return few if size > 1 << 60 else max(few, -(-size // SHARD_BYTES))  # Spark calls unknown sizes that large


#: Kinds of blocks: an n-gram order from 1 on, raw word counts, sums of contexts, and one row of totals of a merged shard.
RAW, CONTEXT, TOTALS = 0, -1, -2
LEVEL = PART + ", n1 long, n2 long, n3 long, n4 long, n3p long, total long, rows long"


def train(df: DataFrame, text: str = "text", order: int = 2, shards: int | None = None, uri: str | None = None) -> Model:
    """Count all texts of df (null: empty) and write the model; see the module for its form.

    `shards` sets how finely counts are dealt: as shards_for() has it if not
    given. A task holds the different n-grams of one shard only.
    """
    spark = df.sparkSession
    uri, shards = uri or workdir(spark, "lm"), shards or shards_for(df)

    def count(batches):
        held, n = [], 0

        def out():
            cols = [np.concatenate([h[k] for h in held]) for k in range(order)]
            for kind, c in ((order, cols), (RAW, cols[-1:])) if order > 1 else ((1, cols), (RAW, cols)):
                c, counts = tally(c, np.ones(len(c[0]), np.int64))
                yield from _deal(kind, c, counts, shard_of(c, shards))

        for b in batches:
            for tokens, off, _, _ in token_stream(b.column(0)):
                held.append(grams(tokens, off, order))
                n += len(tokens)
                if n >= HELD:
                    yield from out()
                    held, n = [], 0
        if held:
            yield from out()

    def merge(kind, shard, cols, counts):
        """Write a shard's arrays; hand on totals, sums of contexts and continuation counts."""

        def widened(batch):
            return pa.RecordBatch.from_arrays([*batch.columns, *[pa.nulls(batch.num_rows, pa.int64())] * 7], names=[x.split()[0] for x in LEVEL.split(", ")])

        h = cols[0] if len(cols) == 1 else combine(cols, 5)
        by = np.argsort(h)
        _save(uri, f"{kind}-{shard:05d}-h", h[by])
        _save(uri, f"{kind}-{shard:05d}-c", _small(counts[by]))
        seen = [int((counts == c).sum()) for c in (1, 2, 3, 4)] + [int((counts > 2).sum()), int(counts.sum()), len(counts)]
        yield pa.RecordBatch.from_arrays([pa.array([TOTALS], pa.int32()), pa.array([kind], pa.int32()), pa.array([b""], pa.binary()), *(pa.array([x], pa.int64()) for x in seen)], names=[x.split()[0] for x in LEVEL.split(", ")])
        if kind > 1:
            keys, at = np.unique(combine(cols[:-1], 3), return_inverse=True)
            sums = [np.bincount(at, w, len(keys)).astype(_U) for w in (counts, counts == 1, counts == 2, counts > 2)]
            for b in _deal(CONTEXT, [keys, *sums], np.ones(len(keys), np.int64), context_shard(keys, shards)):
                yield widened(b)
            lower, n = tally(cols[1:], np.ones(len(counts), np.int64))
            for b in _deal(kind - 1, lower, n, shard_of(lower, shards)):
                yield widened(b)

    parts, d, tokens, vocabulary, total, written = df.select(F.col(text).cast("string").alias("text")).mapInArrow(count, PART), {}, 0, 0, 0, []
    for k in range(order, 0, -1):
        path = workdir(spark, f"lm-merged-{k}")
        level = materialize(_merged(parts, merge, LEVEL, shards), "lm", path)
        written.append(path)
        sums = {r["kind"]: r for r in level.filter(F.col("kind") == TOTALS).groupBy(F.col("shard").alias("kind")).agg(*(F.sum(c).alias(c) for c in ("n1", "n2", "n3", "n4", "n3p", "total", "rows"))).collect()}
        if RAW in sums:
            tokens, vocabulary = sums[RAW]["total"], sums[RAW]["rows"]
        s = sums.get(k)
        d[k] = discounts([s[c] for c in ("n1", "n2", "n3", "n4")]) if s else (0.5, 1.0, 1.5)
        if k == 1:
            total = s["total"] if s else 0
            rest = (d[1][0] * s["n1"] + d[1][1] * s["n2"] + d[1][2] * s["n3p"]) / total if total else 1.0
        else:

            def contexts(kind, shard, cols, counts, k=k, d=d[k]):
                """Write the sums of a shard's contexts: occurrences, and the weight of the lower order."""
                n = cols[1].astype(np.float64)
                back = (d[0] * cols[2].astype(np.float64) + d[1] * cols[3].astype(np.float64) + d[2] * cols[4].astype(np.float64)) / n
                _save(uri, f"{k}-context-{shard:05d}-h", cols[0])
                _save(uri, f"{k}-context-{shard:05d}-n", _small(cols[1]))
                _save(uri, f"{k}-context-{shard:05d}-g", back.astype(np.float32))
                yield pa.RecordBatch.from_arrays([pa.array([len(n)], pa.int64())], names=["n"])

            _merged(level.filter(F.col("kind") == CONTEXT).select("kind", "shard", "data"), contexts, "n long", shards, _sum_columns).agg(F.sum("n")).collect()
            parts = level.filter(F.col("kind") == k - 1).select("kind", "shard", "data")
    for path in written:
        fs, top = open_fs(path)
        fs.delete_dir(top)
    return Model(uri, order, shards, tokens, vocabulary, rest / (vocabulary + 1), total, d)


class Reader:
    """Maps a model's arrays and looks up sorted batches.

    Arrays of a local or mounted file system are mapped where they are; others
    are fetched to a nameless file of the worker and mapped there, and the ones
    not used for longest go when they pass `most` bytes.
    """

    def __init__(self, model: Model, most: int = FETCHED):
        self.model, self.fs_path, self.most = model, open_fs(model.uri), most
        self.maps: dict[str, np.ndarray | None] = {}
        self.fetched = 0

    def array(self, name: str) -> np.ndarray | None:
        if name in self.maps:
            found = self.maps.pop(name)
        else:
            fs, top = self.fs_path
            path = f"{top}/{name}.npy"
            if not fs.get_file_info(path).is_file:
                found = None
            elif fs.type_name == "local":
                found = np.load(path, mmap_mode="r")
            else:
                found = self._fetch(fs, path)
        self.maps[name] = found  # the last one used stands last
        return found

    def _fetch(self, fs, path: str) -> np.ndarray:
        with tempfile.NamedTemporaryFile(suffix=".npy", delete=False) as out, fs.open_input_stream(path) as f:
            shutil.copyfileobj(f, out, 1 << 20)
        try:
            found = np.load(out.name, mmap_mode="r")
        finally:
            os.unlink(out.name)  # the map holds on to it
        self.fetched += found.nbytes
        while self.fetched > self.most and self.maps:
            gone = self.maps.pop(next(iter(self.maps)))
            self.fetched -= gone.nbytes if gone is not None else 0
        return found

    def find(self, kind: str, shard: np.ndarray, h: np.ndarray, values: tuple[str, ...]) -> list[np.ndarray]:
        """Values at the hashes, 0 where absent; queries go by shard and hash, so that the maps are read in order."""
        out = [np.zeros(len(h)) for _ in values]
        order = np.lexsort((h, shard))
        edges = np.flatnonzero(np.diff(shard[order], prepend=-1))
        for a, b in zip(edges, np.append(edges[1:], len(order))):
            at, name = order[a:b], f"{kind}-{int(shard[order[a]]):05d}"
            own = self.array(f"{name}-h")
            if own is None or not len(own):
                continue
            want = h[at]
            i = np.minimum(np.searchsorted(own, want), len(own) - 1)
            hit = own[i] == want
            for o, v in zip(out, values):
                o[at[hit]] = self.array(f"{name}-{v}")[i[hit]]
        return out

    def raw_counts(self, tokens: np.ndarray) -> np.ndarray:
        return self.find(str(RAW), shard_of([tokens], self.model.shards), tokens, ("c",))[0]

    def _cut(self, counts: np.ndarray, k: int) -> np.ndarray:
        return counts - np.take((0.0, *self.model.discounts[k]), np.minimum(counts, 3).astype(np.int64))

    def probabilities(self, cols: list[np.ndarray]) -> np.ndarray:
        """p of the last word of each n-gram after the others."""
        m = self.model
        (c,) = self.find("1", shard_of(cols[-1:], m.shards), cols[-1], ("c",))
        p = self._cut(c, 1) / max(1, m.total) + m.unknown
        for k in range(2, m.order + 1):
            part = cols[-k:]
            context = combine(part[:-1], 3)
            n, back = self.find(f"{k}-context", context_shard(context, m.shards), context, ("n", "g"))
            (c,) = self.find(str(k), shard_of(part, m.shards), combine(part, 5), ("c",))
            p = np.where(n > 0, self._cut(c, k) / np.maximum(n, 1) + back * p, p)
        return p


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def score(df: DataFrame, model: Model, held_out=None, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text: tokens (words and one end), known tokens, add-one score, log10 probability, perplexity.

    A null or empty text is one end token. Repeated rows give equal rows, a
    null id stays null, other columns are ignored, an empty table gives no
    rows. A model of no texts gives every token the probability 1.
    """

    def work(batches):
        r = Reader(model)
        v = model.vocabulary
        for b in batches:
            for tokens, off, lo, hi in token_stream(b.column(2)):
                uniq, inv = np.unique(tokens, return_inverse=True)
                c = r.raw_counts(uniq)
                plain = np.log10((c + 1) / (model.tokens + v + 1))[inv]
                known = (c > 0)[inv]
                p = np.log10(r.probabilities(grams(tokens, off, model.order)))
                n, s = np.diff(off), np.add.reduceat(p, off[:-1])
                cols = [pa.array(n), pa.array(np.add.reduceat(known.astype(np.int64), off[:-1])), pa.array(np.full(hi - lo, model.tokens)), pa.array(np.add.reduceat(plain, off[:-1])), pa.array(s), pa.array(np.power(10.0, np.minimum(-s / n, 300)))]
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], b.column(1)[lo:hi], *cols], names=[x.split()[0] for x in SCORES.split(", ")])

    held = F.lit(False) if held_out is None else held_out
    return df.select(F.col(doc).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text).cast("string").alias("text")).mapInArrow(work, SCORES)


def held_out_column(doc: str = "doc_id"):
    """Rows that no model is trained on."""
    return remainder(doc, 7) == 2
