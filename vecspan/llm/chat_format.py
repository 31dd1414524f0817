"""Chat formatting by a declarative template and a finite-state machine over roles."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick


@dataclass(frozen=True)
class ChatTemplate:
    """Markers around a turn, the roles whose text bears loss, and the turn-order machine.

    ``moves`` maps (state, role) to the next state; a missing entry rejects the conversation.
    Texts and roles are escaped, so that the characters with which markers begin occur in markers
    only, whatever the markers are; none may be empty.
    """

    open_role: str = "<turn:"
    open_text: str = ">\n"
    close: str = "</turn>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    start: str = "start"
    accept: tuple[str, ...] = ("answered",)
    moves: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "told",
            ("start", "user"): "asked",
            ("told", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )


def escapes(template: ChatTemplate) -> list[tuple[str, str]]:
    """(character, what stands for it): the escape character first, then each character that begins a marker.

    Each escape character of an escaped text begins exactly one pair, and no pair holds a
    character that is replaced later, so that undoing them one kind at a time, the escape
    character's own last, restores every text.
    """
    markers = (template.open_role, template.open_text, template.close)
    if not all(markers):
        raise ValueError("a marker is empty")
    first = list(dict.fromkeys(m[0] for m in markers))
    mark = next(c for c in "\\~^\x1a" if c not in first)
    names = {"<": "l", ">": "g"}
    own = next(c for c in "-_=" if c not in first)
    used, out = {own}, [(mark, mark + own)]
    for c in first:
        code = names.get(c)
        if code is None or code in first or code in used:
            code = next(x for x in "abcdefhijkmnlg" if x not in first and x not in used and x not in names.values())
        used.add(code)
        out.append((c, mark + code))
    return out


def escape(c: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    for raw, safe in escapes(template):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescape(c: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    for raw, safe in reversed(escapes(template)):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def format_chats(turns: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """One row per conversation: conv_id, valid, segments, formatted.

    ``turns`` has conv_id, turn, role, text, a row per turn. ``segments`` lists (text, loss)
    pieces whose texts joined give ``formatted``; ``valid`` tells whether the roles follow the
    template's machine and end in an accepting state. Invalid conversations are formatted too.
    Null role or text: empty. Turns are ordered by turn (null first), then role, then text, and
    repeated rows stay repeated turns. A null conv_id is a conversation of its own; texts of any
    length are formatted whole; an empty table gives an empty result; other columns, whatever
    their names, are ignored. A conversation is one value and so is gathered in one task, as any
    formatter must.
    """
    t = template
    rows = pick(turns, conv_id="conv_id", turn="turn", role="role", text="text").select("conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    moves = F.create_map(*[F.lit(x) for (state, role), to in t.moves.items() for x in (f"{state}\n{role}", to)])
    end = F.aggregate("turns", F.lit(t.start), lambda s, x: F.coalesce(F.try_element_at(moves, F.concat(s, F.lit("\n"), x["role"])), F.lit("rejected")))

    def pieces(x: Column) -> Column:
        def piece(text: Column, loss: Column) -> Column:
            return F.struct(text.alias("text"), loss.alias("loss"))

        head = F.concat(F.lit(t.open_role), escape(x["role"], t), F.lit(t.open_text))
        return F.array(piece(head, F.lit(False)), piece(escape(x["text"], t), x["role"].isin(*t.loss_roles)), piece(F.lit(t.close), F.lit(False)))

    out = chats.select("conv_id", end.isin(*t.accept).alias("valid"), F.flatten(F.transform("turns", pieces)).alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """The turns, as an array of (role, text), that a text formatted by the template holds."""

    def exactly(marker: str) -> str:
        return "".join(c if c.isalnum() or c.isspace() else "\\" + c for c in marker)

    inside = "[^" + "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c, _ in escapes(template)[1:]) + "]*+"
    pattern = F.lit(f"{exactly(template.open_role)}({inside}){exactly(template.open_text)}({inside}){exactly(template.close)}")
    roles, texts = F.regexp_extract_all(formatted, pattern, F.lit(1)), F.regexp_extract_all(formatted, pattern, F.lit(2))
    return F.zip_with(roles, texts, lambda r, x: F.struct(unescape(r, template).alias("role"), unescape(x, template).alias("text")))


def loss_text(segments: Column, template: ChatTemplate = ChatTemplate()) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template)), "")
