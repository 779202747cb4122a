"""Chat formatting of typed content parts.

A conversation becomes one text of marked turns.  A visitor turns each part into
text: words are escaped, so that no control string can arise in them, images,
audio and documents become numbered placeholders whose references and token
counts are kept beside the text.  A mask marks what is trained on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Order matters: what is escaped first is restored last.  Every backslash that results starts one of these.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))
OPEN, CLOSE = "<turn ", "</turn>\n"
#: Tokens that a unit of an attachment expands to: an image's tile, a second of audio, a document's page.
TOKENS = {"image": 256, "audio": 25, "document": 512}
TRAINED = ("assistant",)
PARTS = "array<struct<type:string,text:string,ref:string,units:double>>"


def escape(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ESCAPES, text)


def unescape(text: Column) -> Column:
    return reduce(lambda c, e: F.replace(c, F.lit(e[1]), F.lit(e[0])), reversed(ESCAPES), text)


def text_part(text: Column) -> Column:
    """Content of a turn that is text only."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"),
                            F.lit(None).cast("double").alias("units"))).cast(PARTS)


def _is_text(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text")) == "text"


def _tokens(part: Column, rates: dict[str, int]) -> Column:
    rate = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in rates.items() for x in kv]), part["type"]), F.lit(1)) if rates else F.lit(1)
    words = F.regexp_count(F.coalesce(part["text"], F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return F.when(_is_text(part), words).otherwise(F.ceil(F.coalesce(part["units"], F.lit(1.0)) * rate)).cast("long")


def _visited(part: Column, turn: Column, nth: Column, rates: dict[str, int]) -> Column:
    """A part as text, with what it refers to."""
    name = F.concat_ws(".", (turn + 1).cast("string"), (nth + 1).cast("string"))
    mark = F.concat(F.lit("<"), escape(part["type"]), F.lit(" "), name, F.lit("/>"))
    text = F.when(_is_text(part), escape(F.coalesce(part["text"], F.lit("")))).otherwise(mark)
    return F.struct(text.alias("text"), _is_text(part).alias("is_text"), name.alias("name"), part["type"].alias("type"), part["ref"].alias("ref"),
                    _tokens(part, rates).alias("tokens"))


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts",
                         trained: tuple[str, ...] = TRAINED, rates: dict[str, int] = TOKENS) -> DataFrame:
    """(conv_id, formatted, mask, attachments, tokens), one row for each conversation.

    ``parts`` has the type ``PARTS``; a type that is NULL is text, one without a
    rate costs 1 token a unit, and units that are NULL count as 1.  Turns are
    ordered by ``turn``, NULL first, ties by role and content; repeated rows stay.
    A NULL role or text is empty and a turn without parts is an empty turn; rows
    with a NULL ``conv_id`` are one conversation.  ``mask`` has [start, end) in
    code points of the text parts of turns with a trained role.  ``attachments``
    has (name, type, ref, tokens) in the order of the placeholders.  A
    conversation is one value, so its turns meet in one task.
    """
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(parts), F.array().cast(PARTS)).alias("parts")).alias("row"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    visited = grouped.select("conv_id", F.transform("rows", lambda r, i: F.struct(
        r["role"].alias("role"), F.transform(r["parts"], lambda p, j: _visited(p, i, j, rates)).alias("parts"))).alias("turns"))

    def segment(text: Column, loss: Column, of: Column | None = None) -> Column:
        empty = F.lit(None).cast("string")
        fields = [of[k] if of is not None else empty for k in ("name", "type", "ref")]
        tokens = of["tokens"] if of is not None else F.lit(0).cast("long")
        return F.struct(text.alias("text"), loss.alias("loss"), *[f.alias(k) for f, k in zip(fields, ("name", "type", "ref"))], tokens.alias("tokens"),
                        (~of["is_text"] if of is not None else F.lit(False)).alias("attached"))

    def segments(t: Column) -> Column:
        head = segment(F.concat(F.lit(OPEN), escape(t["role"]), F.lit(">")), F.lit(False))
        body = F.transform(t["parts"], lambda p: segment(p["text"], p["is_text"] & t["role"].isin(*trained), p))
        return F.concat(F.array(head), body, F.array(segment(F.lit(CLOSE), F.lit(False))))

    flat = visited.select("conv_id", F.flatten(F.transform("turns", segments)).alias("s"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        end = acc["at"] + F.length(s["text"])
        span = F.struct(acc["at"].alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(s["loss"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    attached = F.transform(F.filter("s", lambda s: s["attached"]), lambda s: F.struct(*[s[k].alias(k) for k in ("name", "type", "ref", "tokens")]))
    return flat.select("conv_id", F.array_join(F.transform("s", lambda s: s["text"]), "").alias("formatted"), F.aggregate("s", start, step)["spans"].alias("mask"),
                       attached.alias("attachments"), F.aggregate("s", F.lit(0).cast("long"), lambda n, s: n + s["tokens"]).alias("tokens"))


def read_turns(formatted: Column) -> Column:
    """(role, text) of each turn of a formatted conversation; placeholders stay in the text as they stand."""
    whole = F.filter(F.split(formatted, CLOSE, -1), lambda t: t != "")
    return F.transform(whole, lambda t: F.struct(unescape(F.regexp_extract(t, r"(?s)^<turn ([^>]*)>", 1)).alias("role"),
                                                 unescape(F.regexp_replace(t, r"^<turn [^>]*>", "")).alias("text")))


def read_loss(formatted: Column, mask: Column) -> Column:
    """The text under the mask."""
    return unescape(F.array_join(F.transform(mask, lambda s: F.substring(formatted, s["start"] + 1, s["end"] - s["start"])), ""))


#: Added to the table by the query: control strings of this and other templates inside texts.
TRICKY = r"\### Assistant: </turn> ok"

ORACLE = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
    SELECT *, 16 + length(replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g'))
              + length(replace(replace(replace(text, '\', '\b'), '<', '\l'), '>', '\g')) - 1 AS chars FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
