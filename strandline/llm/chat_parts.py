"""Chat formatting of typed content parts, in DataFrame functions only.

A turn is a role and a list of parts: text, image, audio or document. A visitor goes over the parts in
order and leaves text, escaped, and one placeholder for each attachment; it records the attachment's
reference, its number in the conversation and the tokens that its placeholder expands to. Turns are then
set between the control strings of the template and joined to one string by conversation.

All control strings start with ``<|``. Inside texts and roles a backslash is put after every ``<``, ``[`` and
backslash, so that neither these control strings nor the ones of other templates (``</s>``, ``[INST]``) stand
in a text; taking it away again gives the text exactly. ``read_back`` does so from the formatted string alone.

Null texts, roles and part lists count as empty; a part of unknown kind is a document. Turns are ordered
by number, then role and content, so that ties and repeated rows have one order; null numbers come first.
Rows of a null conversation id are one conversation. The result is one row for each conversation: that
row is the unit asked for, so its turns do meet in one task, after all work on texts is done by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandline.llm.host_rules import let

TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
KINDS = ("image", "audio", "document")
PARTS = "array<struct<kind:string,text:string,ref:string,units:bigint>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[\\])\\", "$1")


def text_part(text: Column) -> Column:
    """The parts of a turn that is one text."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), null.cast("string").alias("ref"), null.cast("bigint").alias("units")))


def _kind(part: Column) -> Column:
    return F.when(part["kind"].isin("text", *KINDS), part["kind"]).otherwise(F.lit("document"))


def _visited(part: Column) -> Column:
    kind = _kind(part)
    return F.when(kind == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), kind, F.lit("|>")))


def _attachments(parts: Column, per_unit: dict[str, int]) -> Column:
    """Reference, kind and expanded tokens of each attachment; an image has units of tiles, audio of seconds, a document of pages."""
    rates = F.create_map(*[x for k, v in per_unit.items() for x in (F.lit(k), F.lit(v))])
    numbered = F.transform(parts, lambda p, i: F.struct(i.alias("part"), _kind(p).alias("kind"), p["ref"].alias("ref"), F.coalesce(p["units"], F.lit(1)).alias("units")))
    return F.transform(
        F.filter(numbered, lambda p: p["kind"] != "text"),
        lambda p: F.struct(p["part"], p["kind"], p["ref"], (2 + F.greatest(p["units"], F.lit(0)) * F.element_at(rates, p["kind"])).alias("n_tokens")),
    )


def format_chat(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    parts_col: str = "parts",
    learn_role: str = "assistant",
    tokens_per_unit: dict[str, int] | None = None,
) -> DataFrame:
    """One row for each conversation.

    ``formatted`` is the text, ``loss_mask`` the spans (turn, start, length in code points) of what is learned:
    the bodies of ``learn_role`` without control strings. ``attachments`` has their order in the
    conversation, turn, part, kind, reference and expanded tokens; ``n_expanded`` the sum of these.
    """
    per_unit = tokens_per_unit or {"image": 256, "audio": 25, "document": 512}
    parts = F.coalesce(F.col(f"`{parts_col}`"), F.array().cast(PARTS))
    rows = turns.select(
        F.col(f"`{conv_col}`").alias("conv_id"),
        F.col(f"`{turn_col}`").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"),
        F.array_join(F.transform(parts, _visited), "").alias("body"),
        _attachments(parts, per_unit).alias("found"),
    )
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY))
    pieces = rows.select(
        "*", F.concat(head, "body", F.lit(END)).alias("piece"), F.length(head).alias("head_chars"), F.length("body").alias("body_chars")
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "body", F.to_json(F.struct("found")))
    before = F.coalesce(F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = pieces.select(
        "conv_id",
        F.struct(
            F.row_number().over(order).alias("n"),
            "piece",
            (F.col("role") == learn_role).alias("learned"),
            (before + F.col("head_chars") + 1).alias("start"),
            F.col("body_chars").alias("chars"),
            "found",
        ).alias("t"),
    )
    together = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    learned = F.transform(F.filter("ts", lambda t: t["learned"]), lambda t: F.struct(t["n"].alias("turn"), t["start"], t["chars"].alias("length")))
    found = F.flatten(F.transform("ts", lambda t: F.transform(t["found"], lambda a: F.struct(t["n"].alias("turn"), a["part"], a["kind"], a["ref"], a["n_tokens"]))))
    return together.select(
        "conv_id",
        F.array_join(F.transform("ts", lambda t: t["piece"]), "").alias("formatted"),
        learned.alias("loss_mask"),
        F.transform(found, lambda a, i: F.struct((i + 1).alias("number"), a["turn"], a["part"], a["kind"], a["ref"], a["n_tokens"])).alias("attachments"),
    ).withColumn("n_expanded", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["n_tokens"]))


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` with its turns (role, text) and ``loss_texts``, the texts under the loss mask, in order.

    The string is cut once at the ends of turns, and each piece keeps its place in the string. What the mask covers is then
    cut out by its start and length, from the piece of the turn that it names, which is the same as cutting the whole
    string there, but does not walk through it from its start for each span. A span that does not lie within
    that piece has a null text. Placeholders stay in the texts as they stand.
    """
    cut = F.filter(F.split("formatted", r"<\|end\|>"), lambda x: x != "")

    def after(done: Column, piece: Column) -> Column:
        end = F.coalesce(F.get(done, F.size(done) - 1)["end"], F.lit(0).cast("long"))
        own = F.struct(piece.alias("piece"), end.alias("before"), (end + F.length(piece) + len(END)).alias("end"))
        return F.concat(done, F.array(own))

    def under(mask: Column, placed: Column) -> Column:
        def text(s: Column) -> Column:
            def of(p: Column) -> Column:
                at = s["start"] - p["before"]
                inside = (at >= 1) & (at + s["length"] - 1 <= F.length(p["piece"]))
                return F.when(inside, unescape(F.substr(p["piece"], at.cast("int"), s["length"].cast("int"))))

            return let(F.get(placed, s["turn"].cast("int") - 1), of)

        return F.transform(mask, text)

    turn = lambda x: F.struct(
        unescape(F.substring_index(F.substring(x, len(TURN) + 1, 1 << 30), BODY, 1)).alias("role"), unescape(F.substring_index(x, BODY, -1)).alias("text")
    )
    none = F.array().cast("array<struct<piece:string,before:bigint,end:bigint>>")
    both = let(
        cut,
        lambda pieces: F.struct(
            F.transform(pieces, turn).alias("turns"), let(F.aggregate(pieces, none, after), lambda placed: under(F.col("loss_mask"), placed)).alias("loss_texts")
        ),
    )
    return formatted.select("*", both.alias("read")).select(*[F.col(f"`{c}`") for c in formatted.columns], "read.turns", "read.loss_texts")
