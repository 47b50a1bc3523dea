"""COPY in text, CSV and binary form."""

from __future__ import annotations

import datetime
import struct
import uuid
from decimal import Decimal

import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Encoding names and Java charsets.
ENCODINGS = {
    "UTF8": "UTF-8", "SQL_ASCII": "ISO-8859-1", "LATIN1": "ISO-8859-1", "LATIN2": "ISO-8859-2", "LATIN5": "ISO-8859-9", "LATIN9": "ISO-8859-15", "WIN1250": "windows-1250", "WIN1251": "windows-1251", "WIN1252": "windows-1252",
    "EUC_JP": "EUC-JP", "SJIS": "Shift_JIS", "EUC_KR": "EUC-KR", "GBK": "GBK",
}


def _charset(name: str) -> str:
    return ENCODINGS.get(name.upper().replace("-", ""), name)


def unescape_text(s: Column) -> Column:
    r"""Backslash sequences of the text form: \b \f \n \r \t \v \\ and any other character as itself."""
    out = F.replace(s, F.lit("\\\\"), F.lit("\x00"))
    for c, v in (("b", "\b"), ("f", "\f"), ("n", "\n"), ("r", "\r"), ("t", "\t"), ("v", "\v")):
        out = F.replace(out, F.lit("\\" + c), F.lit(v))
    return F.replace(F.regexp_replace(out, r"(?s)\\(.)", "$1"), F.lit("\x00"), F.lit("\\"))


def escape_text(s: Column, delimiter: str = "\t") -> Column:
    """Inverse of unescape_text()."""
    out = F.replace(s, F.lit("\\"), F.lit("\\\\"))
    for c, v in (("n", "\n"), ("r", "\r"), ("t", "\t")):
        out = F.replace(out, F.lit(v), F.lit("\\" + c))
    return out if delimiter == "\t" else F.replace(out, F.lit(delimiter), F.lit("\\" + delimiter))


def _without_headers(lines: DataFrame) -> DataFrame:
    """Lines less the first one of each file; a file's first line leads the split that begins at its first byte."""

    def work(batches):
        before = None
        for b in batches:
            line, file, start = b.columns
            places = list(zip(file.to_pylist(), start.to_pylist()))
            first = [p != q and p[1] == 0 for p, q in zip(places, [before, *places])]
            before = places[-1] if places else before
            yield pa.RecordBatch.from_arrays([line.filter(pa.array([not x for x in first]))], names=["line"])

    return lines.select("line", F.col("_metadata.file_path"), F.col("_metadata.file_block_start")).mapInArrow(work, "line string")


def copy_from(spark: SparkSession, path: str, schema: T.StructType, form: str = "text", columns: list[str] | None = None, delimiter: str | None = None, quote: str = '"', escape: str | None = None, null: str | None = None, header: bool = False, encoding: str = "UTF8") -> DataFrame:
    """COPY table FROM path: rows of the schema; columns that are not listed are NULL. Malformed fields raise."""
    kinds = {f.name: f.dataType for f in schema}
    columns = columns or list(kinds)
    if form == "csv":
        flat = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        df = spark.read.schema(flat).csv(path, sep=delimiter or ",", quote=quote, escape=escape or quote, nullValue=null if null is not None else "", emptyValue="" if null else None, header=header, encoding=_charset(encoding), multiLine=True, mode="FAILFAST", enforceSchema=True)
        value = lambda c: F.col(f"`{c}`")
    elif form == "text":
        reader = spark.read.option("encoding", _charset(encoding))
        lines = reader.csv(path, sep="\x01", quote="", escape="\x00", schema="line string", header=header) if encoding.upper() not in ("UTF8", "UTF-8") else spark.read.text(path).withColumnRenamed("value", "line")
        if header and encoding.upper() in ("UTF8", "UTF-8"):
            lines = _without_headers(lines)
        lines = lines.filter(F.col("line") != "\\.")
        # a delimiter behind an odd number of backslashes is data
        d = "\\t" if (delimiter or "\t") == "\t" else r"\Q" + delimiter + r"\E"
        parts = F.split(F.col("line"), rf"(?<=(?<!\\)(?:\\\\){{0,50}}){d}", -1)
        bad = F.raise_error(F.lit("missing or extra data in a COPY line")).cast("array<string>")
        df = lines.select(F.when(F.size(parts) == len(columns), parts).otherwise(bad).alias("p"))
        marks = {c: i for i, c in enumerate(columns)}
        value = lambda c: F.when(F.get("p", F.lit(marks[c])) != (null if null is not None else "\\N"), unescape_text(F.get("p", F.lit(marks[c]))))
    elif form == "binary":
        return copy_from_binary(spark, path, T.StructType([schema[c] for c in columns])).select(*[(F.col(c) if c in columns else F.lit(None).cast(kinds[c])).alias(c) for c in kinds])
    else:
        raise ValueError(f'COPY format "{form}" not recognized')

    def typed(c):
        if c not in columns:
            return F.lit(None).cast(kinds[c])
        if isinstance(kinds[c], T.BooleanType):
            from larkspan.functions.maths import parse_bool

            return parse_bool(value(c))
        return value(c).cast(kinds[c])

    return df.select(*[typed(c).alias(c) for c in kinds])


def copy_to(df: DataFrame, path: str, form: str = "text", delimiter: str | None = None, quote: str = '"', escape: str | None = None, null: str | None = None, header: bool = False, encoding: str = "UTF8") -> None:
    """COPY (query) TO path: a folder with a file for each partition."""
    plain = df.select(*[(F.when(F.col(f"`{f.name}`"), "t").when(~F.col(f"`{f.name}`"), "f") if isinstance(f.dataType, T.BooleanType) else F.col(f"`{f.name}`").cast("string")).alias(f.name) for f in df.schema])
    if form == "csv":
        plain.write.mode("errorifexists").csv(path, sep=delimiter or ",", quote=quote, escape=escape or quote, nullValue=null if null is not None else "", emptyValue='""', header=header, encoding=_charset(encoding))
    elif form == "text":
        d = delimiter or "\t"
        fields = [F.coalesce(escape_text(F.col(f"`{c}`"), d), F.lit(null if null is not None else "\\N")) for c in plain.columns]
        plain.select(F.concat_ws(d, *fields)).write.mode("errorifexists").text(path)
    elif form == "binary":
        copy_to_binary(df, path)
    else:
        raise ValueError(f'COPY format "{form}" not recognized')


_SIGNATURE = b"PGCOPY\n\xff\r\n\x00" + b"\x00" * 8
_EPOCH = datetime.date(2000, 1, 1).toordinal()
#: Rows that leave a binary file at a time.
_PIECE = 50_000


def _numeric(raw: bytes) -> Decimal:
    """Base-10000 digits, weight, sign and scale."""
    n, weight, sign, scale = struct.unpack_from(">hhHh", raw)
    if sign not in (0, 0x4000):  # NaN and the infinities
        raise ValueError("a numeric that is no number has no decimal value")
    value = sum(Decimal(d) * Decimal(10_000) ** (weight - i) for i, d in enumerate(struct.unpack_from(f">{n}h", raw, 8)))
    return (-value if sign == 0x4000 else Decimal(value)).quantize(Decimal(1).scaleb(-scale))


def _numeric_bytes(v: Decimal) -> bytes:
    sign, digits, exp = v.as_tuple()
    scale = max(0, -exp)
    text = f"{abs(v):.{scale}f}"
    whole, _, part = text.partition(".")
    whole = whole.zfill(-(-len(whole) // 4) * 4)
    part = part.ljust(-(-len(part) // 4) * 4, "0")
    groups = [int((whole + part)[i : i + 4]) for i in range(0, len(whole + part), 4)]
    weight = len(whole) // 4 - 1
    while groups and not groups[0]:
        groups, weight = groups[1:], weight - 1
    while groups and not groups[-1]:
        groups.pop()
    return struct.pack(f">hhHh{len(groups)}h", len(groups), weight if groups else 0, 0x4000 if sign else 0, scale, *groups)


def _is_uuid(f: T.StructField) -> bool:
    """Text columns whose declared type is uuid say so in their metadata."""
    return f.metadata.get("type") == "uuid"


def _decode(raw: bytes, kind: T.DataType, is_uuid: bool = False):
    if is_uuid:
        return str(uuid.UUID(bytes=raw))
    if isinstance(kind, T.BooleanType):
        return raw != b"\0"
    for t, f in ((T.ShortType, ">h"), (T.IntegerType, ">i"), (T.LongType, ">q"), (T.FloatType, ">f"), (T.DoubleType, ">d")):
        if isinstance(kind, t):
            return struct.unpack(f, raw)[0]
    if isinstance(kind, T.DateType):
        return datetime.date.fromordinal(_EPOCH + struct.unpack(">i", raw)[0])
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return datetime.datetime(2000, 1, 1) + datetime.timedelta(microseconds=struct.unpack(">q", raw)[0])
    if isinstance(kind, T.DecimalType):
        return _numeric(raw)
    if isinstance(kind, T.BinaryType):
        return raw
    return raw.decode()


def _encode(v, kind: T.DataType, is_uuid: bool = False) -> bytes:
    if is_uuid:
        return uuid.UUID(v).bytes
    if isinstance(kind, T.BooleanType):
        return b"\1" if v else b"\0"
    for t, f in ((T.ShortType, ">h"), (T.IntegerType, ">i"), (T.LongType, ">q"), (T.FloatType, ">f"), (T.DoubleType, ">d")):
        if isinstance(kind, t):
            return struct.pack(f, v)
    if isinstance(kind, T.DateType):
        return struct.pack(">i", v.toordinal() - _EPOCH)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        d = pd.Timestamp(v).to_pydatetime().replace(tzinfo=None) - datetime.datetime(2000, 1, 1)
        return struct.pack(">q", (d.days * 86400 + d.seconds) * 1_000_000 + d.microseconds)
    if isinstance(kind, T.DecimalType):
        return _numeric_bytes(v)
    return bytes(v) if isinstance(v, (bytes, bytearray)) else str(v).encode()


def copy_from_binary(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of binary COPY files; a file is one unit of work, its rows leave in pieces. Text columns with the metadata {"type": "uuid"} are UUIDs."""
    kinds = [(f.dataType, _is_uuid(f)) for f in schema]

    def work(batches):
        for b in batches:
            for raw in b["content"]:
                raw, rows = bytes(raw), []
                if not raw.startswith(_SIGNATURE[:11]):
                    raise ValueError("COPY file signature not recognized")
                at = 19 + struct.unpack_from(">i", raw, 15)[0]
                while (n := struct.unpack_from(">h", raw, at)[0]) != -1:
                    at += 2
                    row = []
                    for k in range(n):
                        size = struct.unpack_from(">i", raw, at)[0]
                        at += 4
                        row.append(None if size < 0 else _decode(raw[at : at + size], *kinds[k]))
                        at += max(size, 0)
                    rows.append(row)
                    if len(rows) == _PIECE:
                        yield pd.DataFrame(rows, columns=schema.names, dtype=object)
                        rows = []
                yield pd.DataFrame(rows, columns=schema.names, dtype=object)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(work, schema)


def copy_to_binary(df: DataFrame, path: str) -> None:
    """A folder with one binary COPY file for each partition; must not exist yet.

    Rows are streamed to a file beside its place, which gets its name when it is
    whole, so repeated tasks leave whole files only. The path has to be one that
    pyarrow's file systems reach from the executors.
    """
    kinds, names, uri = [(f.dataType, _is_uuid(f)) for f in df.schema], df.columns, path if "://" in path else f"file://{path}"
    fs, top = pafs.FileSystem.from_uri(uri)
    if fs.get_file_info(top).type != pafs.FileType.NotFound:
        raise ValueError(f"{path} already exists")
    fs.create_dir(top, recursive=True)

    def field(v, kind: T.DataType, is_uuid: bool) -> bytes:
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v and not isinstance(kind, (T.FloatType, T.DoubleType))):
            return b"\xff\xff\xff\xff"
        body = _encode(v, kind, is_uuid)
        return struct.pack(">i", len(body)) + body

    def work(batches):
        from pyspark import TaskContext

        fs, top = pafs.FileSystem.from_uri(uri)
        part, n = TaskContext.get(), 0
        spare, name = f"{top}/.part-{part.partitionId():05d}.{part.taskAttemptId()}", f"{top}/part-{part.partitionId():05d}.bin"
        with fs.open_output_stream(spare) as out:
            out.write(_SIGNATURE)
            for b in batches:
                for row in zip(*(b.column(c).to_pylist() for c in names)):
                    out.write(struct.pack(">h", len(row)) + b"".join(field(v, *k) for v, k in zip(row, kinds)))
                    n += 1
            out.write(b"\xff\xff")
        fs.move(spare, name)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    df.mapInArrow(work, "n long").agg(F.sum("n")).collect()
