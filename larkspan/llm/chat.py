"""Chat formatting: a finite-state machine over roles and a declarative template, in SQL expressions only.

Each conversation becomes a list of segments (text, loss flag) whose
concatenation is the formatted string. Texts are escaped with a backslash so
that no control string of the template can occur inside them, and the escape is
reversible.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Transitions (state, role) -> state; a pair that is not listed leads to BROKEN.
TURN_ORDER = {
    ("start", "system"): "primed",
    ("start", "user"): "asked",
    ("primed", "user"): "asked",
    ("asked", "assistant"): "answered",
    ("answered", "user"): "asked",
}
BROKEN = "broken"


@dataclass(frozen=True)
class Template:
    """What stands before and after each turn, and which roles bear loss.

    `opening` holds the role name in place of {role}; roles in `loss_roles` have
    the loss flag on their text, and with `loss_on_close` on the closing mark.
    `special` are the characters that texts may not show bare; the escape
    character is one of them.
    """

    opening: tuple[str, str] = ("### ", ": ")
    closing: str = " </turn>\n"
    special: str = "#<"
    escape: str = "\\"
    loss_roles: tuple[str, ...] = ("assistant",)
    loss_on_close: bool = False
    role_titles: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})


def escape(text: Column, template: Template, also: str = "") -> Column:
    """Put the escape character before itself and before every special character."""
    out = F.replace(text, F.lit(template.escape), F.lit(template.escape * 2))
    for c in template.special + also:
        out = F.replace(out, F.lit(c), F.lit(template.escape + c))
    return out


def unescape(text: Column) -> Column:
    """Inverse of escape()."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def format_chats(df: DataFrame, template: Template = Template(), conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv, segments, formatted, valid, end_state.

    Rows go by turn, null turns first; ties go by role, then text, so that repeats and reruns
    agree. A null role or text counts as empty, a null conv_id is a conversation
    of its own. Turn order is checked by TURN_ORDER and reported in `valid` (a
    conversation has to end answered); turns out of order are formatted all the
    same. Other columns are ignored. An empty table gives an empty result. A
    conversation is one value, so its turns meet in one task; conversations are
    spread by their id.
    """
    rows = df.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"),
    )
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    steps = _map({f"{s}>{r}": t for (s, r), t in TURN_ORDER.items()})
    step = lambda state, t: F.coalesce(F.try_element_at(steps, F.concat(state, F.lit(">"), t["role"])), F.lit(BROKEN))
    titles = _map(template.role_titles)
    plain = lambda t: escape(t["role"], template, ": ")
    # a role that is spelled like a title is told from it by one escape more
    other = lambda t: F.when(t["role"].isin(*template.role_titles.values()), F.concat(F.lit(template.escape), plain(t))).otherwise(plain(t))
    title = lambda t: F.coalesce(F.try_element_at(titles, t["role"]), other(t))
    segment = lambda s, loss: F.struct(s.alias("text"), loss.alias("loss"))
    bears = lambda t: t["role"].isin(*template.loss_roles)
    no = F.lit(False)

    def segments(t: Column) -> Column:
        head = F.concat(F.lit(template.opening[0]), title(t), F.lit(template.opening[1]))
        close = bears(t) if template.loss_on_close else no
        return F.array(segment(head, no), segment(escape(t["text"], template), bears(t)), segment(F.lit(template.closing), close))

    return turns.select(
        "conv_id",
        F.flatten(F.transform("turns", segments)).alias("segments"),
        F.aggregate("turns", F.lit("start"), step).alias("end_state"),
    ).select(
        "conv_id",
        "segments",
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        (F.col("end_state") == "answered").alias("valid"),
        "end_state",
    )


def parse_chats(formatted: Column, template: Template = Template()) -> Column:
    """Turns (role, text) read back from a formatted string."""
    names = _map({v: k for k, v in template.role_titles.items()})
    pieces = F.split(formatted, r"\Q" + template.closing + r"\E", -1)
    head, sep = template.opening

    def turn(p: Column) -> Column:
        at = F.locate(sep, p)
        title = F.substring(p, F.lit(len(head) + 1), at - 1 - len(head))
        return F.struct(
            F.coalesce(F.try_element_at(names, title), unescape(title)).alias("role"),
            unescape(F.substring(p, at + len(sep), F.length(p))).alias("text"),
        )

    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)
