"""PostgreSQL string semantics as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    """A Column as it is, a str as a column name."""
    return x if isinstance(x, Column) else F.col(x)


def bind(x, fn) -> Column:
    """fn(x) with x computed once, also where fn uses it inside lambdas."""
    return F.get(F.transform(F.array(x), fn), F.lit(0))


def concat(*parts) -> Column:
    """concat(): NULL arguments are skipped."""
    return F.concat_ws("", *[col(p).cast("string") for p in parts])


def concat_op(a, b) -> Column:
    """a || b: NULL if either is."""
    return F.concat(col(a).cast("string"), col(b).cast("string"))


def left(s, n: int) -> Column:
    """left(): a negative n leaves out the last -n characters."""
    s = col(s)
    return F.substring(s, F.lit(1), F.lit(n)) if n >= 0 else F.substring(s, F.lit(1), F.greatest(F.length(s) + n, F.lit(0)))


def right(s, n: int) -> Column:
    """right(): a negative n leaves out the first -n characters."""
    s = col(s)
    if n >= 0:
        return F.substring(s, F.greatest(F.length(s) - n, F.lit(0)) + 1, F.lit(n))
    return F.substring(s, F.lit(1 - n), F.length(s))


def pad_left(s, n: int, fill: str = " ") -> Column:
    """lpad(): cuts a longer text; an empty fill pads nothing."""
    return F.lpad(col(s), n, fill) if fill else left(s, n)


def pad_right(s, n: int, fill: str = " ") -> Column:
    """rpad(): as lpad() on the other side."""
    return F.rpad(col(s), n, fill) if fill else left(s, n)


def chr_(n) -> Column:
    """chr(): the character of a Unicode code point."""
    n = col(n).cast("int")
    unit = lambda v: F.lpad(F.hex(v), 4, "0")
    high = F.lit(0xD800) + F.shiftright(n - 0x10000, 10)
    low = F.lit(0xDC00) + ((n - 0x10000).bitwiseAND(F.lit(0x3FF)))
    wide = F.when(n < 0x10000, unit(n)).otherwise(F.concat(unit(high), unit(low)))
    return F.decode(F.unhex(wide), "UTF-16BE")


def split_part(s, delimiter: str, n: int) -> Column:
    """split_part(): the n-th field, counted from the end if n is negative, '' beyond; n = 0 is an error."""
    if n == 0:
        raise ValueError("field position must not be zero")
    return F.split_part(col(s), F.lit(delimiter), F.lit(n))


def strpos(s, sub: str) -> Column:
    """strpos(s, sub): position from 1, 0 if absent."""
    return F.instr(col(s), sub)


def overlay(s, new: str, start: int, count: int | None = None) -> Column:
    """overlay(s placing new from start for count)."""
    return F.overlay(col(s), F.lit(new), F.lit(start), F.lit(len(new) if count is None else count))


def format_(template: str, *args) -> Column:
    """format() with %s, %I, %L and %%; a NULL shows as '' for %s and as NULL for %L."""
    out, rest = [], list(args)
    for piece in re.split(r"(%[sIL%])", template):
        if piece == "%%":
            out.append(F.lit("%"))
        elif piece in ("%s", "%I", "%L"):
            if not rest:
                raise ValueError("too few arguments for format()")
            v = col(rest.pop(0)).cast("string")
            if piece == "%s":
                out.append(F.coalesce(v, F.lit("")))
            elif piece == "%L":
                out.append(F.coalesce(F.concat(F.lit("'"), F.replace(v, F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL")))
            else:
                out.append(F.when(v.rlike(r"^[a-z_][a-z0-9_$]*$"), v).otherwise(F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))))
        elif "%" in piece:
            raise ValueError(f"unrecognized format() specifier in {piece!r}")
        elif piece:
            out.append(F.lit(piece))
    return F.concat(*out) if out else F.lit("")


def encode(data, form: str) -> Column:
    """encode(bytea, 'hex' | 'base64' | 'escape')."""
    data = col(data).cast("binary")
    if form == "hex":
        return F.lower(F.hex(data))
    if form == "base64":
        return F.regexp_replace(F.regexp_replace(F.base64(data), r"[\r\n]", ""), "(.{76})(?=.)", "$1\n")  # lines of 76, whatever the session's setting
    if form == "escape":
        return F.replace(F.decode(data, "ISO-8859-1"), F.lit("\\"), F.lit("\\\\"))
    raise ValueError(f'unrecognized encoding: "{form}"')


def decode(s, form: str) -> Column:
    """decode(text, 'hex' | 'base64' | 'escape')."""
    s = col(s)
    if form == "hex":
        return F.unhex(s)
    if form == "base64":
        return F.unbase64(s)
    if form == "escape":
        return F.encode(F.replace(s, F.lit("\\\\"), F.lit("\\")), "ISO-8859-1")
    raise ValueError(f'unrecognized encoding: "{form}"')


def _flags(flags: str) -> str:
    inline = "".join(sorted({"i": "i", "n": "m", "m": "m", "s": "s", "x": "x"}[f] for f in set(flags) - set("gc")))
    return f"(?{inline})" if inline else ""


def regexp_replace(s, pattern: str, new: str, flags: str = "") -> Column:
    """regexp_replace(): the first match only unless the flags hold g; \\1 names a group and \\& the match."""

    def java(shift: int) -> str:
        out = new.replace("$", "\\$")
        return re.sub(r"\\(\d|&)", lambda m: f"${0 + shift if m[1] == '&' else int(m[1]) + shift}", out)

    if "g" in flags:
        return F.regexp_replace(col(s), _flags(flags) + pattern, java(0))
    # all before the first match is matched too, as little as can be, and put back
    return F.regexp_replace(col(s), f"{_flags(flags)}\\A((?s:.*?))({pattern})", "$1" + java(2))


def regexp_like(s, pattern: str, flags: str = "") -> Column:
    return col(s).rlike(_flags(flags) + pattern)


def regexp_count(s, pattern: str, start: int = 1, flags: str = "") -> Column:
    """regexp_count() from a start position."""
    body = col(s) if start == 1 else F.substring(col(s), F.lit(start), F.length(col(s)))
    return F.regexp_count(body, F.lit(_flags(flags) + pattern))


def regexp_substr(s, pattern: str, start: int = 1, occurrence: int = 1, flags: str = "") -> Column:
    """regexp_substr(): the n-th match from a start position, NULL if there is none."""
    body = col(s) if start == 1 else F.substring(col(s), F.lit(start), F.length(col(s)))
    return F.get(F.regexp_extract_all(body, F.lit(_flags(flags) + pattern), F.lit(0)), F.lit(occurrence - 1))


def regexp_instr(s, pattern: str, start: int = 1, occurrence: int = 1, flags: str = "") -> Column:
    """regexp_instr(): where the n-th match begins, 0 if there is none."""
    p = _flags(flags) + pattern
    body = col(s) if start == 1 else F.substring(col(s), F.lit(start), F.length(col(s)))
    if occurrence == 1:
        at = F.regexp_instr(body, F.lit(p))
        return F.when(at > 0, at + start - 1).otherwise(at)
    # what stands before the n-th match: cut the text at all matches and add up the pieces
    hits = F.regexp_extract_all(body, F.lit(p), F.lit(0))
    pieces = F.split(body, p, -1)
    before = F.aggregate(F.slice(F.zip_with(pieces, hits, lambda a, b: F.length(a) + F.length(F.coalesce(b, F.lit("")))), 1, occurrence - 1), F.lit(0), lambda a, x: a + x)
    return F.when(F.size(hits) >= occurrence, before + F.length(F.element_at(pieces, occurrence)) + start).when(body.isNotNull(), F.lit(0))


def regexp_match(s, pattern: str, flags: str = "") -> Column:
    """regexp_match(): the groups of the first match (the match if there are none), NULL without one."""
    p = _flags(flags) + pattern
    groups = re.compile(pattern).groups
    s = col(s)
    found = F.array(*[F.regexp_extract(s, p, i) for i in (range(1, groups + 1) if groups else (0,))])
    return F.when(s.rlike(p), found)


def regexp_matches(s, pattern: str, flags: str = "") -> Column:
    """regexp_matches(..., 'g') as an array of all matches, each an array of its groups; explode it for rows."""
    p = _flags(flags) + pattern
    groups = re.compile(pattern).groups
    s = col(s)
    cols = [F.regexp_extract_all(s, F.lit(p), F.lit(i)) for i in (range(1, groups + 1) if groups else (0,))]
    return F.transform(F.arrays_zip(*[c.alias(f"g{i}") for i, c in enumerate(cols)]), lambda z: F.array(*[z[f"g{i}"] for i in range(len(cols))]))


def regexp_split_to_array(s, pattern: str, flags: str = "") -> Column:
    return F.split(col(s), _flags(flags) + pattern, -1)


def similar_to(s, pattern: str, escape: str = "\\") -> Column:
    """s SIMILAR TO pattern: SQL wildcards and regular operators over the whole text."""
    out, i, inside = "", 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == escape and escape:
            i += 1
            out += re.escape(pattern[i]) if i < len(pattern) else ""
        elif inside:
            inside = c != "]"
            out += c
        elif c == "%":
            out += "(?s:.*)"
        elif c == "_":
            out += "(?s:.)"
        elif c == "[":
            inside, out = True, out + c
        elif c in ".^$\\":
            out += "\\" + c
        else:
            out += c
        i += 1
    return col(s).rlike(f"\\A(?:{out})\\z")


def like_escape(pattern: str, escape: str) -> str:
    """A LIKE pattern with its own escape character, rewritten to the backslash."""
    return re.sub(re.escape(escape) + "(.)", r"\\\1", pattern.replace("\\", "\\\\")) if escape else pattern.replace("\\", "\\\\")


def to_number(s, fmt: str = "") -> Column:
    """to_number(): digits, sign (leading or trailing, S, MI, PR) and decimal point of the text."""
    s = col(s)
    digits = F.regexp_replace(s, r"[^0-9.]", "")
    negative = s.rlike(r"^\s*-|-\s*$|^\s*<.*>\s*$")
    value = F.expr("1").cast("double") * digits.try_cast("double")
    return F.when(negative, -value).otherwise(value)


def grouped(x, places: int) -> Column:
    """A double as text with commas and so many places, as printf shows it: its binary value rounded half to even, and a sign on -0.0 and on what rounds to it.

    Behind 15 digits in all, zeros may follow the shortest digits that tell the number.
    """
    x = col(x).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), x.cast("string")).otherwise(F.format_number(x, places))


def fixed(x, places: int) -> Column:
    """grouped() without the commas."""
    return F.replace(grouped(x, places), F.lit(","), F.lit(""))


def to_char_number(x, fmt: str) -> Column:
    """to_char(number, fmt) for formats of 9, 0, G, D, comma and point, with FM.

    Doubles are rounded as binary numbers and keep their sign when they round to zero; other numbers are rounded half away from zero, and zero has no sign.
    """
    trim = fmt.startswith("FM")
    body = fmt.removeprefix("FM").replace("G", ",").replace("D", ".")
    whole, _, fraction = body.partition(".")
    places = len(fraction)
    width = len(whole) + 1 + (1 + places if places else 0)
    number = F.round(col(x).cast("decimal(38,10)"), places)
    signed = F.when(F.typeof(col(x)).isin("double", "float"), grouped(x, places)).otherwise(F.format_number(number, places))
    digits = F.ltrim(signed, F.lit("-"))
    if "," not in whole:
        digits = F.replace(digits, F.lit(","), F.lit(""))
    least = len(whole.replace(",", "")) - (whole.replace(",", "").find("0") if "0" in whole else len(whole.replace(",", "")))
    head = F.substring_index(digits, ".", 1)
    tail = F.concat(F.lit("."), F.substring_index(digits, ".", -1)) if places else F.lit("")
    if least:
        head = F.when(F.length(head) < least, F.lpad(head, least, "0")).otherwise(head)
    elif places:
        head = F.when(head == "0", F.lit("")).otherwise(head)
    shown = F.concat(F.when(signed.startswith("-"), F.lit("-")).otherwise(F.lit("")), head, tail)
    shown = F.when(signed.rlike("[a-z]"), signed).otherwise(shown)  # NaN and the infinities
    if trim:
        nines = len(fraction) - len(fraction.rstrip("9"))
        return F.regexp_replace(shown, "0{0,%d}$" % nines, "") if places and nines else shown
    return F.lpad(shown, width, " ")


def uuid_version(u) -> Column:
    """uuid_extract_version()."""
    return F.conv(F.substring(col(u), 15, 1), 16, 10).cast("int")


def uuid_timestamp(u) -> Column:
    """uuid_extract_timestamp() of versions 1 and 7, else NULL."""
    u = F.replace(col(u), F.lit("-"), F.lit(""))
    millis = F.conv(F.substring(u, 1, 12), 16, 10).cast("long")
    ticks = F.conv(F.concat(F.substring(u, 14, 3), F.substring(u, 9, 4), F.substring(u, 1, 8)), 16, 10).cast("decimal(20,0)")
    v = F.substring(u, 13, 1)
    return F.when(v == "7", F.timestamp_millis(millis)).when(v == "1", F.timestamp_micros(((ticks - F.lit(122192928000000000)) / 10).cast("long")))


def uuid_v7() -> Column:
    """uuidv7(): milliseconds of the clock and random bits."""
    r = F.replace(F.uuid(), F.lit("-"), F.lit(""))
    t = F.lpad(F.lower(F.hex(F.unix_millis(F.current_timestamp()))), 12, "0")
    return F.concat_ws("-", F.substring(t, 1, 8), F.substring(t, 9, 4), F.concat(F.lit("7"), F.substring(r, 14, 3)), F.substring(r, 17, 4), F.substring(r, 21, 12))
