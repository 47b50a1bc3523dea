"""Netpbm and BMP: decoded to numpy arrays, area-resized by integral images, kept as NPY tiles with difference hashes."""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.shared import open_fs
from larkspan.llm.textkernel import text_buffer
from larkspan.llm.warc import _Replace

UNIT = 576
WIDTH = 24
BAND_ROWS = 1 << 16
FORMATS = ("pgm", "ppm", "bmp8", "bmp24")


def encode(samples: np.ndarray, form: str) -> bytes:
    """File bytes of an (h, w) or (h, w, 3) uint8 array; pgm and bmp8 take grey, ppm and bmp24 colour."""
    h, w = samples.shape[:2]
    if form == "pgm":
        return b"P5\n%d %d\n255\n" % (w, h) + samples.tobytes()
    if form == "ppm":
        return b"P6\n%d %d\n255\n" % (w, h) + samples.tobytes()
    depth = {"bmp8": 8, "bmp24": 24}[form]
    row = w * depth // 8
    pad = -row % 4
    body = samples[::-1] if depth == 8 else samples[::-1, :, ::-1]
    body = np.ascontiguousarray(body).reshape(h, row)
    if pad:
        body = np.pad(body, ((0, 0), (0, pad)))
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4) * np.array([1, 1, 1, 0], np.uint8) if depth == 8 else np.empty(0, np.uint8)
    at = 54 + palette.size
    head = struct.pack("<2sIHHI", b"BM", at + body.size, 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, depth, 0, body.size, 2835, 2835, 256 if depth == 8 else 0, 0)
    return head + palette.tobytes() + body.tobytes()


def _netpbm_fields(data: bytes, count: int) -> tuple[list[int], int]:
    """The header's numbers after the magic, and where the raster begins."""
    at, out = 2, []
    while len(out) < count:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("a number is missing in the Netpbm header")
        out.append(int(data[at:end]))
        at = end
    return out, at + 1


def decode(data: bytes) -> np.ndarray:
    """(h, w) or (h, w, 3) uint8 array of a Netpbm (P1-P6) or uncompressed BMP (8 or 24 bits) file.

    16-bit Netpbm samples keep their high byte; smaller maximal values are kept as they are. Anything else raises ValueError.
    """
    magic = data[:2]
    if magic in (b"P1", b"P4"):
        (w, h), at = _netpbm_fields(data, 2)
        if magic == b"P1":
            bits = np.frombuffer(bytes(c for c in data[at - 1 :] if c in b"01"), np.uint8)[: w * h] - 48
        else:
            bits = np.unpackbits(np.frombuffer(data, np.uint8, h * (-(-w // 8)), at).reshape(h, -1), axis=1)[:, :w]
        return (1 - bits.reshape(h, w)).astype(np.uint8) * 255
    if magic in (b"P2", b"P3", b"P5", b"P6"):
        (w, h, most), at = _netpbm_fields(data, 3)
        shape = (h, w) if magic in (b"P2", b"P5") else (h, w, 3)
        n = int(np.prod(shape))
        if magic in (b"P2", b"P3"):
            flat = np.array(data[at - 1 :].split()[:n], dtype=np.int64)
            return (flat >> (8 if most > 255 else 0)).astype(np.uint8).reshape(shape)
        return np.frombuffer(data, np.uint8, n, at).reshape(shape) if most < 256 else (np.frombuffer(data, ">u2", n, at) >> 8).astype(np.uint8).reshape(shape)
    if magic == b"BM":
        start, (size, w, h, _, depth, packed) = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<IiiHHI", data, 14)
        if packed or depth not in (8, 24):
            raise ValueError("only uncompressed BMP files of 8 or 24 bits are read")
        row = w * depth // 8
        body = np.frombuffer(data, np.uint8, abs(h) * (row + -row % 4), start).reshape(abs(h), -1)[:, :row]
        body = body[::-1] if h > 0 else body
        if depth == 24:
            return np.ascontiguousarray(body.reshape(abs(h), w, 3)[:, :, ::-1])
        used = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, np.uint8, used * 4, 14 + size).reshape(-1, 4)
        grey = palette[:, 0]
        if (palette[:, 1] == grey).all() and (palette[:, 2] == grey).all():
            return np.ascontiguousarray(grey[body])
        return np.ascontiguousarray(palette[:, 2::-1][body])
    raise ValueError("neither Netpbm nor BMP")


def area_resize(img: np.ndarray, h: int, w: int) -> np.ndarray:
    """Means over the h x w equal boxes of an (H, W) image, as float64.

    The integral image is exact at whole coordinates and linear between them.
    Only the rows that the box edges touch are kept, and it is summed in bands,
    so memory does not grow with the image.
    """
    rows, cols = img.shape
    ys, xs = np.arange(h + 1) * rows / h, np.arange(w + 1) * cols / w
    lo = np.minimum(np.floor(ys).astype(np.int64), rows - 1)
    need = np.unique(np.concatenate([lo, lo + 1]))
    kept = np.zeros((len(need), cols), np.float64)
    carry = np.zeros(cols, np.int64)
    for at in range(0, rows, BAND_ROWS):
        sums = np.cumsum(img[at : at + BAND_ROWS], axis=0, dtype=np.int64) + carry
        i = (need > at) & (need <= at + len(sums))
        kept[i] = sums[need[i] - at - 1]
        carry = sums[-1]
    integral = np.zeros((len(need), cols + 1))
    np.cumsum(kept, axis=1, out=integral[:, 1:])
    i, t = np.searchsorted(need, lo), (ys - lo)[:, None]
    at_y = integral[i] * (1 - t) + integral[i + 1] * t
    left = np.minimum(np.floor(xs).astype(np.int64), cols - 1)
    s = xs - left
    grid = at_y[:, left] * (1 - s) + at_y[:, left + 1] * s
    return np.diff(np.diff(grid, axis=0), axis=1) / (rows / h * cols / w)


def grey(img: np.ndarray) -> np.ndarray:
    """Luma of a colour image by integer weights 77, 150, 29 of 256."""
    if img.ndim == 2:
        return img
    out = np.empty(img.shape[:2], np.uint8)
    for at in range(0, len(img), BAND_ROWS):
        out[at : at + BAND_ROWS] = (img[at : at + BAND_ROWS].astype(np.uint16) * np.array([77, 150, 29], np.uint16)).sum(axis=2, dtype=np.uint32) >> 8
    return out


def difference_hash(luma: np.ndarray) -> str:
    """64 bits, one for each horizontal step of the 8 x 9 area means that rises, as 16 hex digits."""
    small = area_resize(luma, 8, 9)
    return np.packbits(small[:, 1:] > small[:, :-1] + 1e-9).tobytes().hex()


def tile(luma: np.ndarray, edge: int) -> bytes:
    """An NPY file of the edge x edge area means as uint8."""
    out = io.BytesIO()
    np.save(out, np.rint(area_resize(luma, edge, edge)).astype(np.uint8))
    return out.getvalue()


def store(payload: bytes, form: str | None = None, width: int = WIDTH) -> bytes:
    """The payload as samples of an image file; the form follows from its checksum if not given."""
    form = form or FORMATS[zlib.crc32(payload) % len(FORMATS)]
    flat = np.frombuffer(payload, np.uint8)
    return encode(flat.reshape(-1, width) if form in ("pgm", "bmp8") else flat.reshape(-1, width, 3), form)


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, media_format string, feature string, tile_npy binary, media binary, tile_file string, tile_at long"


def save_stack(fs, top: str, name: str, tiles: list[bytes]) -> np.ndarray:
    """Write the tiles as one NPY file of shape (n, edge, edge) and read it back; the file gets its name when it is whole."""
    path, out = f"{top}/{name}", io.BytesIO()
    np.save(out, np.stack([np.load(io.BytesIO(x)) for x in tiles]))
    with _Replace(fs, path) as f:
        f.write(out.getvalue())
    with fs.open_input_stream(path) as f:
        return np.load(io.BytesIO(f.read()))


def text_images(df: DataFrame, doc: str = "doc_id", text: str = "text", edge: int = 16, keep_media: bool = False, uri: str | None = None) -> DataFrame:
    """Every text as an image file, read back, with an NPY tile and a difference hash.

    With `uri` the tiles of each batch are stacked into an NPY file in that
    shared folder and tile_npy is what is read back from it; tile_file and
    tile_at say where a row's tile lies. Repeated tasks replace whole files.

    A null or empty text is one unit of 576 bytes of 255. Rows are independent:
    repeats give equal values, a null id stays null, an empty table gives no
    rows, other columns are ignored. `media` holds the file if keep_media is
    set, else null. Values depend on the text only.
    """

    def work(batches):
        from pyspark import TaskContext

        fs, top = open_fs(uri) if uri else (None, None)
        if uri:
            fs.create_dir(top, recursive=True)
        for number, b in enumerate(batches):
            data, bounds = text_buffer(b.column(1))
            rows = []
            for i in range(b.num_rows):
                raw = data[bounds[i] : bounds[i + 1]].tobytes()
                payload = raw + b"\xff" * (UNIT - len(raw) if not raw else -len(raw) % UNIT)
                media = store(payload)
                img = decode(media)
                back, luma = img.tobytes(), grey(img)
                form = "bmp" if media[:2] == b"BM" else "netpbm"
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), form, difference_hash(luma), tile(luma, edge), media if keep_media else None))
            cols = [list(c) for c in zip(*rows)] or [[] for _ in range(10)]
            name = None
            if uri and rows:
                name = f"tiles-{TaskContext.get().partitionId():05d}-{number:05d}.npy"
                for k, x in enumerate(save_stack(fs, top, name, cols[8])):
                    one = io.BytesIO()
                    np.save(one, x)
                    cols[8][k] = one.getvalue()
            cols += [[name] * len(rows), list(range(len(rows))) if name else [None] * len(rows)]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return df.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(work, SCHEMA)
