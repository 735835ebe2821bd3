"""Chat formatting of typed content parts, with a loss mask and the way back.

A turn is ``<|turn|>role<|body|>body<|end|>``. Its body is its parts in order: text
parts escaped, each other part as a placeholder ``<|type|>``. The k-th placeholder of a
conversation belongs to the k-th of its attachments, which record the type, the
reference, the turn and the number of tokens that the part expands to:

- image: one per square of ``PATCH`` pixels, begun ones included,
- audio: ``AUDIO_RATE`` per second, rounded up,
- document: ``PAGE`` per page,
- a part without the sizes it needs, or of another type: one.

Escaping turns ``&`` into ``&amp;``, ``<`` into ``&lt;`` and ``[`` into ``&#91;``, in roles
and texts. No control string of this template, or of those that use ``</s>`` or
``[INST]``, can then come from a text, and ``unescaped`` gives each text back exactly.

Everything is a Spark SQL expression. ``formatted_turns`` works on single turns;
``conversations`` puts the turns of each conversation in order, as one value each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import running

# Control strings and escapes.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
#: Sizes from which expanded tokens are counted.
PATCH, AUDIO_RATE, PAGE = 28, 12.5, 1024
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
_LOSS = "array<struct<turn:int,start:int,end:int>>"


def escaped(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescaped(text: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def text_part(text: Column) -> Column:
    """A content of one text part."""
    names = [f.split(":") for f in PART.removeprefix("struct<").removesuffix(">").split(",")]
    given = {"type": F.lit("text"), "text": text}
    return F.array(F.struct(*[given.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in names]))


def _tokens(part: Column) -> Column:
    """Tokens that a part other than text expands to."""
    up = lambda x, by: F.ceil(x / by)
    counted = (
        F.when(part["type"] == "image", up(part["width"], PATCH) * up(part["height"], PATCH))
        .when(part["type"] == "audio", F.ceil(part["seconds"] * AUDIO_RATE))
        .when(part["type"] == "document", part["pages"].cast("bigint") * PAGE)
    )
    return F.greatest(F.coalesce(counted.cast("bigint"), F.lit(1)), F.lit(1).cast("bigint"))


def _is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def visited(content: Column) -> tuple[Column, Column]:
    """The body that ``content``, an array of parts, flattens to, and its attachments.

    Null parts are left out; a null type is text, a null text empty.
    """
    parts = F.filter(F.coalesce(content, F.expr(f"cast(array() as array<{PART}>)")), lambda p: p.isNotNull())
    flat = F.transform(
        parts,
        lambda p: F.when(_is_text(p), escaped(F.coalesce(p["text"], F.lit("")))).otherwise(
            F.concat(F.lit("<|"), escaped(p["type"]), F.lit("|>"))
        ),
    )
    attached = F.transform(
        F.filter(parts, lambda p: ~_is_text(p)),
        lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), _tokens(p).alias("tokens")),
    )
    return F.array_join(flat, ""), attached


def formatted_turns(turns: DataFrame, role: str = "role", content: str = "content") -> DataFrame:
    """``turns`` and ``piece``, its formatted text, ``loss_start`` and ``loss_end`` in it, ``attachments``.

    The body of an assistant's turn is under the loss mask; other turns have an empty
    span. A null role is the empty role.
    """
    body, attached = visited(F.col(content))
    name = escaped(F.coalesce(F.col(role), F.lit("")))
    before = F.concat(F.lit(TURN), name, F.lit(BODY))
    start = F.length(before)
    learn = F.coalesce(F.col(role) == "assistant", F.lit(False))
    return turns.select(
        *turns.columns,
        F.concat(before, body, F.lit(END)).alias("piece"),
        start.alias("loss_start"),
        F.when(learn, start + F.length(body)).otherwise(start).alias("loss_end"),
        attached.alias("attachments"),
    )


def conversations(
    turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "content"
) -> DataFrame:
    """``id``, ``formatted``, ``loss`` and ``attachments`` of every conversation.

    Turns go by ``turn``, then role, then body, nulls first; repeated turns all stay.
    ``loss`` has (turn, start, end) for each assistant turn, counted in code points of
    ``formatted``, ``turn`` being its place from 0. ``attachments`` are (turn, type,
    ref, tokens) in order. A conversation is one row by nature, so the turns of the
    longest must fit into memory; before that each turn is formatted where it lies. A null
    id is a conversation of its own. No turns: no conversations. Other columns are not looked at.
    """
    pieces = formatted_turns(
        turns.select(F.col(id).alias("id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(content).alias("content"))
    )
    whole = pieces.groupBy("id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "piece", "loss_start", "loss_end", "attachments"))).alias("t")
    )
    starts = running(F.transform("t", lambda t: F.length(t["piece"])))
    placed = F.transform(
        F.arrays_zip(F.col("t").alias("t"), starts.alias("at")), lambda x, n: x.withField("n", n)
    )
    learn = F.filter(placed, lambda x: F.coalesce(x["t"]["role"] == "assistant", F.lit(False)))
    loss = F.transform(
        learn,
        lambda x: F.struct(
            x["n"].alias("turn"),
            (x["at"] + x["t"]["loss_start"]).cast("int").alias("start"),
            (x["at"] + x["t"]["loss_end"]).cast("int").alias("end"),
        ),
    )
    attached = F.transform(
        F.col("t"),
        lambda t, n: F.transform(
            t["attachments"],
            lambda a: F.struct(n.alias("turn"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")),
        ),
    )
    return whole.select(
        F.col("id").alias(id),
        F.array_join(F.transform("t", lambda t: t["piece"]), "").alias("formatted"),
        loss.cast(_LOSS).alias("loss"),
        F.flatten(attached).alias("attachments"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: (role, body), unescaped; placeholders stay as they are."""
    chunks = _chunks(formatted)
    return F.transform(
        chunks,
        lambda c: F.struct(
            unescaped(F.substring_index(c, BODY, 1)).alias("role"),
            unescaped(F.substring_index(F.substring_index(c, BODY, -1), END, 1)).alias("body"),
        ),
    )


def _chunks(formatted: Column) -> Column:
    parts = F.split(formatted, r"<\|turn\|>", -1)
    return F.slice(parts, 2, F.size(parts))


def learned(formatted: Column, loss: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    chunks = _chunks(formatted)
    sizes = F.transform(chunks, lambda c: F.length(c) + len(TURN))
    starts = F.transform(running(sizes), lambda at: (at + len(TURN)).cast("int"))
    both = F.array(F.struct(chunks.alias("chunks"), starts.alias("starts"), loss.alias("loss")))
    texts = F.transform(
        both,
        lambda b: F.transform(
            b["loss"],
            lambda s: unescaped(
                F.substring(
                    F.get(b["chunks"], s["turn"]), s["start"] - F.get(b["starts"], s["turn"]) + 1, s["end"] - s["start"]
                )
            ),
        ),
    )
    return texts[0]
