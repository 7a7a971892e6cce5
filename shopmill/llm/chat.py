"""Chat conversations as training text: a state machine over roles, a declarative template and loss flags."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How turns are written, which roles are learned, and which role may follow which.

    ``follows`` maps a role to the roles allowed behind it; the empty role stands for the beginning.
    """

    start: str = "<|im_start|>"
    after_role: str = "\n"
    end: str = "<|im_end|>"
    after_end: str = "\n"
    learned: tuple[str, ...] = ("assistant",)
    follows: Mapping[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )


#: What a text may not contain, and what stands for it. The back-slash goes first into a text and last out of it.
ESCAPES = (("\\", "\\b"), ("<|", "<\\p"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "\\n"))


def escape(text: Column, escapes: tuple = ESCAPES) -> Column:
    for plain, safe in escapes:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column, escapes: tuple = ESCAPES) -> Column:
    for plain, safe in reversed(escapes):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def _first_fault(turns: Column, template: Template) -> Column:
    """The number, from 1, of the first turn whose role may not stand there; null if there is none."""
    allowed = F.array(*(F.lit(f"{role}\0{then}") for role, after in template.follows.items() for then in after))
    machine = F.aggregate(
        turns,
        F.struct(F.lit("").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("fault")),
        lambda acc, turn: F.struct(
            turn["role"].alias("state"),
            (acc["at"] + 1).alias("at"),
            F.coalesce(
                acc["fault"],
                F.when(~F.array_contains(allowed, F.concat(acc["state"], F.lit("\0"), turn["role"])), acc["at"] + 1),
            ).alias("fault"),
        ),
    )
    return machine["fault"]


def format_conversations(
    turns: DataFrame,
    template: Template = Template(),
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """``conversation, formatted, segments, valid, first_fault``: a row per conversation.

    ``segments`` are ``(text, loss)`` in order; joined they are ``formatted``. ``loss`` is true for the texts of
    learned roles alone, not for their marks. ``valid`` says that the roles follow the template's state machine,
    ``first_fault`` is the number of the first turn that does not; such conversations are formatted all the same.

    Control strings in texts and roles are escaped; `parse` gives both back. Null texts and roles are empty ones.
    Turns are ordered by number, null first; turns with the same number by role and text, repeated ones stay. Rows
    with a null conversation form one. Other columns are ignored; an empty table gives an empty result. A
    conversation is one value of the result, so its turns meet in one task, like the text of a document does.
    """
    rows = turns.select(
        F.col(f"`{conversation}`").alias(conversation),
        F.struct(
            F.col(f"`{turn}`").alias("turn"),
            F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
        ).alias("item"),
    )
    grouped = rows.groupBy(conversation).agg(F.sort_array(F.collect_list("item")).alias("turns"))

    def segment(value: Column, loss: Column) -> Column:
        return F.struct(value.alias("text"), loss.alias("loss"))

    head = lambda t: F.concat(F.lit(template.start), escape(t["role"], ROLE_ESCAPES), F.lit(template.after_role))
    segments = F.flatten(
        F.transform(
            "turns",
            lambda t: F.array(
                segment(head(t), F.lit(False)),
                segment(escape(t["text"]), t["role"].isin(*template.learned)),
                segment(F.lit(template.end + template.after_end), F.lit(False)),
            ),
        )
    )
    fault = _first_fault(F.col("turns"), template)
    return grouped.select(conversation, segments.alias("segments"), fault.alias("first_fault")).select(
        conversation,
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
        F.col("first_fault").isNull().alias("valid"),
        "first_fault",
    )


def parse(formatted: Column, template: Template = Template()) -> Column:
    """The turns ``(role, text)`` of a formatted conversation, unescaped."""
    mark = "".join("\\" + c if not c.isalnum() and c != "_" else c for c in template.start)
    parts = F.split(formatted, mark)
    written = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))

    def turn(part: Column) -> Column:
        role = F.substring_index(part, template.after_role, 1)
        rest = F.substring(part, F.length(role) + 1 + len(template.after_role), F.length(part))
        text = F.substring_index(rest, template.end, 1)
        return F.struct(unescape(role, ROLE_ESCAPES).alias("role"), unescape(text).alias("text"))

    return F.transform(written, turn)


def learned_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
