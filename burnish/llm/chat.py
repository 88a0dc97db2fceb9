"""Chat formatting: turns to one text with the segments that a model learns from.

A template says how turns are marked, what is escaped inside them, which roles are
learned from and which role may follow which. A finite-state machine over the roles
checks the order. All of it is DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burnish.llm.common import column

REFUSED = "refused"


@dataclass(frozen=True)
class ChatTemplate:
    """How conversations are written and which ones are in order.

    A turn is ``head``, its role's label, ``colon``, the escaped text and ``tail``. Inside
    texts, ``escape`` and the ``control`` strings are replaced by ``escape`` and a letter
    each, so that no text holds a control string, and can be put back. ``head`` must begin
    and ``tail`` must contain a control string. Roles without a label are written behind
    ``other``, which no label may begin with. ``moves`` has the states and the state that
    each role leads to; a role that is not there is refused, and so is all that follows.
    """

    labels: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant"})
    learned: tuple[str, ...] = ("assistant",)
    head: str = "### "
    colon: str = ": "
    tail: str = "</turn>\n"
    escape: str = "\\"
    control: dict[str, str] = field(default_factory=lambda: {"###": "h", "</turn>": "t", ": ": "c"})
    in_roles_only: tuple[str, ...] = (": ",)
    other: str = "="
    start: str = "start"
    moves: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "briefed", "user": "asked"},
            "briefed": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )

    def controls(self, in_role: bool) -> dict[str, str]:
        return {s: c for s, c in self.control.items() if in_role or s not in self.in_roles_only}


def escaped(text: Column, t: ChatTemplate, in_role: bool = False) -> Column:
    """A text without any control string."""
    out = F.replace(text, F.lit(t.escape), F.lit(t.escape * 2))
    for string, letter in t.controls(in_role).items():
        out = F.replace(out, F.lit(string), F.lit(t.escape + letter))
    return out


def unescaped(text: Column, t: ChatTemplate, in_role: bool = False) -> Column:
    """The text that was escaped. Doubled escapes are taken apart first, so none can be read across two."""

    def back(part: Column) -> Column:
        for string, letter in t.controls(in_role).items():
            part = F.replace(part, F.lit(t.escape + letter), F.lit(string))
        return part

    doubled = "".join(f"\\{c}" for c in t.escape * 2)
    return F.array_join(F.transform(F.split(text, doubled, -1), back), t.escape)


def _label(role: Column, t: ChatTemplate) -> Column:
    known = F.create_map(*[F.lit(x) for x in chain(*t.labels.items())])
    return F.coalesce(F.element_at(known, role), F.concat(F.lit(t.other), escaped(role, t, True)), F.lit(""))


def _role(label: Column, t: ChatTemplate) -> Column:
    known = F.create_map(*[F.lit(x) for x in chain(*((v, k) for k, v in t.labels.items()))])
    other = F.when(label.startswith(t.other), unescaped(F.substr(label, F.lit(len(t.other) + 1)), t, True))
    return F.coalesce(F.element_at(known, label), other)


def _machine(roles: Column, t: ChatTemplate) -> Column:
    """The state after the last role and the number of the first role refused (null: none)."""
    moves = {f"{s}>{r}": to for s, by_role in t.moves.items() for r, to in by_role.items()}
    table = F.create_map(*[F.lit(x) for x in chain(*moves.items())])
    zero = F.struct(F.lit(t.start).alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))

    def step(acc: Column, role: Column) -> Column:
        to = F.coalesce(F.element_at(table, F.concat(acc.state, F.lit(">"), role)), F.lit(REFUSED))
        at = acc["at"] + F.lit(1)
        return F.struct(to.alias("state"), at.alias("at"), F.coalesce(acc.bad, F.when(to == REFUSED, at)).alias("bad"))

    return F.aggregate(roles, zero, step)


def format_conversations(
    turns: DataFrame,
    template: ChatTemplate | None = None,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """(conversation, formatted, segments, state, bad_turn), one row for each conversation.

    ``segments`` are (text, loss) and make up ``formatted`` when put together: a turn's
    mark, its escaped text and its end, of which only the text of learned roles has the
    loss flag. ``state`` is where the machine ends, ``bad_turn`` the number from 1 of the
    first turn out of order, null if there is none; such conversations are formatted too.

    Turns go by their number, null first; those of one number by role and text. Null
    texts are empty. A null role and roles without a label are written and read back, but
    the machine refuses them unless it knows them. Rows with a null conversation are one
    conversation. Repeated rows are turns of their own. Texts are whole, whatever their
    length; one conversation is one value, as one document is. Extra columns are ignored.
    An empty table gives an empty table.
    """
    t = template or ChatTemplate()
    turn = F.struct(column(turn_col).alias("turn"), column(role_col).alias("role"), F.coalesce(column(text_col), F.lit("")).alias("text"))
    grouped = turns.groupBy(column(conv_col).alias(conv_col)).agg(F.sort_array(F.collect_list(turn)).alias("_turns"))

    def written(x: Column) -> Column:
        learned = F.coalesce(x.role.isin(*t.learned), F.lit(False))
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        mark = F.concat(F.lit(t.head), _label(x.role, t), F.lit(t.colon))
        return F.array(piece(mark, F.lit(False)), piece(escaped(x.text, t), learned), piece(F.lit(t.tail), F.lit(False)))

    segments = F.flatten(F.transform("_turns", written))
    marched = grouped.select(conv_col, segments.alias("segments"), _machine(F.col("_turns.role"), t).alias("_end"))
    return marched.select(
        conv_col,
        F.array_join(F.col("segments.text"), "").alias("formatted"),
        "segments",
        F.col("_end.state").alias("state"),
        F.col("_end.bad").alias("bad_turn"),
    )


def turns_of(formatted: Column, template: ChatTemplate | None = None) -> Column:
    """The (role, text) of each turn of a formatted conversation."""
    t = template or ChatTemplate()
    tail = "".join(f"\\{c}" if not c.isalnum() and c != "\n" else c for c in t.tail)
    parts = F.split(formatted, tail, -1)  # no text holds the tail

    def read(part: Column) -> Column:
        body = F.substr(part, F.lit(len(t.head) + 1))
        label = F.substring_index(body, t.colon, 1)
        text = F.substr(body, F.length(label) + F.lit(len(t.colon) + 1))
        return F.struct(_role(label, t).alias("role"), unescaped(text, t).alias("text"))

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - F.lit(1)), read)


def learned_text(segments: Column, template: ChatTemplate | None = None) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    t = template or ChatTemplate()
    under = F.filter(segments, lambda s: s.loss)
    return F.array_join(F.transform(under, lambda s: unescaped(s.text, t)), "")
