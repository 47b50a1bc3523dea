"""Near-duplicates by SuperMinHash signatures, banding, exact verification and union-find.

1. Each text's set of word shingles is hashed and signed (SuperMinHash: one
   pseudo-random permutation per element whose ranks are correlated, level by
   level, stopping once every slot is filled).
2. Equal sets fall together at once; only distinct sets go on.
3. Sets that share a band form candidate families (components over ids only).
4. Inside a family all pairs of distinct sets are compared exactly, in blocks
   of bounded size; only a spanning forest of the true links leaves a task.
5. Components of those links give the groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspan.llm.components import components
from larkspan.llm.shared import fresh, materialize
from larkspan.llm.textkernel import combine, mix, shingles, text_buffer, words

_U = np.uint64
_EMPTY = _U(0xFFFFFFFFFFFFFFFF)
#: Bands and rows: a pair at 0.85 shares no band with probability (1 - 0.85**5)**24 < 1e-6.
BANDS, ROWS = 24, 5
#: Sets, and shingles, that one block of a family may hold.
BLOCK_SETS, BLOCK_SHINGLES = 320, 1_000_000


def superminhash(h: np.ndarray, offsets: np.ndarray, m: int) -> np.ndarray:
    """Signatures (rows, m) of the sets h[offsets[i]:offsets[i+1]]; m is at most 128.

    At level j an element draws a rank in [j, j+1) for the slot that its own
    partial shuffle puts at place j. Levels are run for all elements at once;
    a set leaves when all its slots are filled, since later levels only hold
    larger ranks.
    """
    if m > 128:
        raise ValueError("a signature has at most 128 values")
    n = len(offsets) - 1
    sig = np.full(n * m, _EMPTY, _U)
    row = np.repeat(np.arange(n), np.diff(offsets))
    left, perm = np.arange(len(h)), None
    for level in range(m):
        x = h[left]
        with np.errstate(over="ignore"):
            draw = mix(x + _U(2 * level + 1) * _U(0x9E3779B97F4A7C15))
            rank = mix(x ^ (_U(2 * level + 2) * _U(0xC2B2AE3D27D4EB4F)))
        place = level + (draw % _U(m - level)).astype(np.int64)
        if perm is None:
            slot = place
        else:
            at = np.arange(len(left))
            slot = perm[at, place].astype(np.int64)
            perm[at, place] = perm[at, level]
            perm[at, level] = slot
        np.minimum.at(sig, row[left] * m + slot, (_U(level) << _U(57)) | (rank >> _U(7)))
        open_rows = (sig.reshape(n, m) == _EMPTY).any(axis=1)
        stay = open_rows[row[left]]
        if not stay.any():
            break
        if perm is None:
            left = left[stay]
            perm = np.tile(np.arange(m, dtype=np.uint8), (len(left), 1))
            at, first = np.arange(len(left)), place[stay]
            perm[at, first] = 0
            perm[at, 0] = first
        else:
            left, perm = left[stay], perm[stay]
    return sig.reshape(n, m)


def distinct_sets(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row, and new offsets."""
    parts = [np.unique(h[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
    out = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=out[1:])
    return (np.concatenate(parts) if parts else np.empty(0, _U)), out


def set_keys(h: np.ndarray, offsets: np.ndarray, salt: int = 0) -> np.ndarray:
    """One 64-bit key for each distinct set, whatever the order of its members; salts give independent keys."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(h) + 1, _U)
        np.cumsum(mix(h ^ _U(0x8B8B8B8B8B8B8B8B + salt * 0x1234567)), out=sums[1:])
        return combine([sums[offsets[1:]] - sums[offsets[:-1]], np.diff(offsets).astype(_U)], 7 + salt)


SIGNED = "doc_id long, text_hash long, n_shingles long, set_key long, set_check long, bands array<long>"


def sign(df: DataFrame, doc: str, text: str, k: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, set size, the two halves of the set's 128-bit key and band hashes of every text; without shingles the last three are null."""

    def work(batches):
        for b in batches:
            n, key, check, band = [], [], [], []
            for w in words(b.column(2)):
                s, o = distinct_sets(*shingles(w.hashes, w.offsets, k))
                sig = superminhash(s, o, bands * rows)
                size = np.diff(o)
                n.append(size)
                key.append(set_keys(s, o))
                check.append(set_keys(s, o, 1))
                band.append(np.stack([combine([sig[:, i * rows + j] for j in range(rows)], i + 1) for i in range(bands)], axis=1))
            if not n:
                continue
            size, key, check, band = np.concatenate(n), np.concatenate(key).view(np.int64), np.concatenate(check).view(np.int64), np.concatenate(band).view(np.int64)
            off = pa.array(np.arange(0, len(size) * bands + 1, bands, dtype=np.int32), mask=np.append(size == 0, False))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(size.astype(np.int64)), pa.array(key, mask=size == 0), pa.array(check, mask=size == 0), pa.ListArray.from_arrays(off, pa.array(band.ravel()))], names=["doc_id", "text_hash", "n_shingles", "set_key", "set_check", "bands"])

    content = F.col(text).cast("string")
    return df.select(F.col(doc).cast("long").alias("doc_id"), F.xxhash64(content).alias("text_hash"), content.alias("text")).mapInArrow(work, SIGNED)


def _links(h: np.ndarray, offsets: np.ndarray, percent: int) -> np.ndarray:
    """Boolean matrix of the pairs with 100 * intersection >= percent * union."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    values, col, count = np.unique(h, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), size)
    shared = count[col] > 1
    number = np.cumsum(count > 1) - 1
    row, col = row[shared], number[col[shared]]
    both = np.zeros((n, n), np.float64)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for lo in range(0, int(number[-1]) + 1 if len(number) else 0, 4096):
        a, b = np.searchsorted(col, [lo, lo + 4096])
        if a < b:
            dense = np.zeros((n, 4096), np.float32)
            dense[row[a:b], col[a:b] - lo] = 1
            both += dense @ dense.T
    either = size[:, None] + size[None, :] - both
    return (100 * both >= percent * either) & (size[:, None] > 0) & (size[None, :] > 0)


def _trees(linked: np.ndarray) -> np.ndarray:
    """For each node the first node of its component."""
    root = np.full(len(linked), -1)
    for i in range(len(linked)):
        if root[i] < 0:
            root[i], front = i, np.array([i])
            while len(front):
                front = np.flatnonzero(linked[front].any(axis=0) & (root < 0))
                root[front] = i
    return root


def _verify(members: DataFrame, k: int, percent: int) -> DataFrame:
    """True links inside each (family, i, j) as a forest of edges (u, v)."""

    def group(nodes: list[int], texts: pa.Array):
        parts = []
        for w in words(texts):
            s, o = distinct_sets(*shingles(w.hashes, w.offsets, k))
            parts += [(nodes[w.first + i], s[o[i] : o[i + 1]]) for i in range(len(o) - 1)]
        if len(parts) < 2:
            return [], []
        off = np.concatenate([[0], np.cumsum([len(p[1]) for p in parts])])
        root = _trees(_links(np.concatenate([p[1] for p in parts]), off, percent))
        return zip(*((int(parts[i][0]), int(parts[r][0])) for i, r in enumerate(root) if i != r)) if (root != np.arange(len(root))).any() else ([], [])

    def work(batches):
        now, keys, texts = None, [], []
        u, v = [], []

        def close():
            if len(keys) > 1:
                a, b = group(keys, pa.array(texts, pa.large_string()))
                u.extend(a)
                v.extend(b)

        for b in batches:
            for f, i, j, key, text in zip(*(c.to_pylist() for c in b.columns)):
                if (f, i, j) != now:
                    close()
                    now, keys, texts = (f, i, j), [], []
                keys.append(key)
                texts.append(text)
            if len(u) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])
                u, v = [], []
        close()
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    keyed = members.select("family", "i", "j", "node", "text").repartition("family", "i", "j").sortWithinPartitions("family", "i", "j")
    return keyed.mapInArrow(work, "u long, v long")


def near_duplicates(df: DataFrame, doc: str = "doc_id", text: str = "text", k: int = 5, percent: int = 85, bands: int = BANDS, rows: int = ROWS, block_sets: int = BLOCK_SETS) -> DataFrame:
    """One row per row of df: doc_id, text_hash, n_shingles, component_id, kept.

    Texts are linked if 100 * |intersection| >= percent * |union| of their sets
    of k-word shingles. A text without words (or null) is linked with nothing;
    one with fewer than k words has its whole sequence as its only shingle.
    component_id is the smallest doc_id reachable; null ids are passed over,
    and a component without any other has null. kept tells the row with that
    id. Rows that share an id keep their own sets. Other columns are ignored,
    an empty table gives no rows. Pairs are found up to the banding's miss
    probability (see BANDS) and confirmed on the full sets; work is quadratic
    only in the number of different, similar texts of one family.
    """
    docs = df.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed = materialize(sign(docs, "doc_id", "text", k, bands, rows), "neardup-signed")
    least_text = F.coalesce(F.min_by("text_hash", "doc_id"), F.min("text_hash"))  # a text that stands on rep; any text of the set where no row has an id
    sets = signed.filter("n_shingles > 0").groupBy("set_key", "set_check").agg(F.min("doc_id").alias("rep"), least_text.alias("rep_hash"), F.max("n_shingles").alias("size"), F.first("bands").alias("bands"))
    # sets are told apart by 128 bits; a node is the first half, and of two sets with the same first half one takes its second
    place = F.row_number().over(Window.partitionBy("set_key").orderBy("set_check"))
    sets = materialize(sets.withColumn("node", F.when(place == 1, F.col("set_key")).otherwise(F.col("set_check"))), "neardup-sets")
    spread = sets.select("node", F.explode("bands").alias("band"))
    met = spread.groupBy("band").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo <> hi").select("band", "lo")
    pairs = spread.join(met, "band").filter("node <> lo").select(F.col("node").alias("u"), F.col("lo").alias("v")).distinct()
    family = components(pairs, "neardup-family").select("node", F.col("root").alias("family"))
    family = materialize(family.join(sets.select("node", "rep", "rep_hash", "size"), "node"), "neardup-members")
    sizes = family.groupBy("family").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    blocks = sizes.select("family", F.greatest(F.ceil(F.col("n") / block_sets), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    dealt = family.join(blocks, "family").withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int"))
    # always by a shuffle of the texts: the members grow with the corpus, and so the plan is the same at every size;
    # a null id counts as 0 here, which does no harm, since the text has to be the same as well
    texts = docs.select(F.coalesce("doc_id", F.lit(0)).alias("at"), F.xxhash64("text").alias("at_hash"), "text")
    dealt = dealt.join(texts.hint("merge"), (F.coalesce("rep", F.lit(0)) == F.col("at")) & (F.col("rep_hash") == F.col("at_hash")))
    dealt = dealt.groupBy("node").agg(*[F.first(c).alias(c) for c in ("family", "blocks", "block", "text")])  # rows that repeat id and text
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("block")))
    dealt = dealt.select("family", "node", "text", "block", F.explode_outer(others).alias("other"))
    dealt = dealt.select("family", "node", "text", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    links = materialize(_verify(dealt, k, percent), "neardup-links")
    trees = materialize(components(links, "neardup-groups").select("node", "root"), "neardup-trees")
    named = sets.select("set_key", "set_check", "node", "rep").join(trees, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("rep").alias("component"))
    named = named.join(least, "root").select("set_key", "set_check", "component")
    out = signed.select("doc_id", "text_hash", "n_shingles", "set_key", "set_check").join(named, ["set_key", "set_check"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_representatives(df: DataFrame, doc: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """df with one document of each group; all columns kept.

    Rows that repeat both id and text count as one, the one whose columns have
    the least hash, so that reruns agree; rows without an id stay unless a row
    with an id is linked to them. Null and empty texts stay, an empty table
    stays empty, columns may have any names.
    """
    verdict = near_duplicates(df, doc, text, **options).filter("kept").select(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), "text_hash").distinct()
    key, none, content, place = (fresh(df, c) for c in ("_kept_id", "_kept_none", "_kept_hash", "_kept_place"))
    v = materialize(verdict.toDF(key, none, content), "neardup-kept")
    own = F.col(f"`{doc}`").cast("long")
    keyed = df.withColumns({key: F.coalesce(own, F.lit(0)), none: own.isNull(), content: F.xxhash64(F.col(f"`{text}`").cast("string"))})
    plain = [F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    first = F.row_number().over(Window.partitionBy(key, none, content).orderBy(F.xxhash64(*plain)))
    return keyed.join(v, [key, none, content], "left_semi").withColumn(place, first).filter(F.col(place) == 1).select(*[F.col(f"`{c}`") for c in df.columns])
