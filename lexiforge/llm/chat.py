"""Chat formatting by a declared template and a finite-state machine over roles.

The template says how a turn opens and closes, which texts bear loss, and which role may follow which.
Marks begin with ``<``; inside texts and roles ``&`` and ``<`` are escaped, so no text can
hold a mark and unescaping gives back every text. All steps are DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.arrays import let, sums_ahead


@dataclass(frozen=True)
class Template:
    begin: str = "<chat>\n"
    open: tuple[str, str] = ("<turn ", ">\n")
    close: str = "\n</turn>\n"
    end: str = "</chat>\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: (state, role) -> state; a turn that no entry allows leads to "invalid", which has no way out.
    order: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )
    final: tuple[str, ...] = ("assistant",)


TEMPLATE = Template()


def escape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.replace(text, F.lit(">"), F.lit("&gt;"))


def unescape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("&gt;"), F.lit(">")), F.lit("&lt;"), F.lit("<"))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def format_chats(rows: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """rows(conv_id, turn, role, text, ...) -> a row per conversation: conv_id, formatted, segments, valid, state.

    segments is an array of (start, length, loss, first_byte, bytes) over formatted, without gaps: start and length in
    code points, first_byte and bytes in bytes of UTF-8, both from 0. Turns come by turn (null first), then role, then text; repeated rows are turns
    of their own. Null texts and roles count as empty; unknown roles are formatted like others,
    without loss, and make the conversation invalid, as any role out of order does. A row with a null
    conv_id belongs to no other, so each is a conversation of its own. Other columns aren't read. An empty table gives
    no rows. A conversation is one row of the result, and so is put together by one task.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    slim = rows.select("conv_id", "turn", "role", "text")
    of_id = slim.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    chats = of_id.unionByName(slim.filter("conv_id is null").select("conv_id", F.array(turn).alias("turns")))
    t = template
    segment = lambda s, loss: F.struct(s.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    of_turn = lambda x: F.array(
        segment(F.concat(F.lit(t.open[0]), escape(x["role"]), F.lit(t.open[1])), no),
        segment(escape(x["text"]), x["role"].isin(*t.loss_roles)),
        segment(F.lit(t.close), no),
    )
    parts = F.concat(F.array(segment(F.lit(t.begin), no)), F.flatten(F.transform("turns", of_turn)), F.array(segment(F.lit(t.end), no)))
    step = F.create_map(*[F.lit(x) for (s, r), to in t.order.items() for x in (f"{s}\n{r}", to)])
    move = lambda s, x: F.coalesce(F.try_element_at(step, F.concat(s, F.lit("\n"), x["role"])), F.lit("invalid"))
    chats = chats.select("conv_id", F.aggregate("turns", F.lit("start"), move).alias("state"), parts.alias("parts"))
    chats = chats.withColumn("formatted", F.array_join(F.col("parts.text"), ""))
    lengths = F.transform("parts", lambda p: F.length(p["text"]).cast("long"))
    sizes = F.transform("parts", lambda p: F.octet_length(p["text"]).cast("long"))
    chats = chats.withColumns({"lengths": lengths, "sizes": sizes})
    # zipped, not looked up: a lambda that uses a column only once has its expression put in, and works it out per element
    spans = F.arrays_zip(sums_ahead(F.col("lengths")).alias("start"), F.col("lengths").alias("length"), sums_ahead(F.col("sizes")).alias("first_byte"), F.col("sizes").alias("bytes"))
    made = lambda x, p: F.struct(x["start"], x["length"], p["loss"].alias("loss"), x["first_byte"], x["bytes"])
    return chats.select("conv_id", "formatted", F.zip_with(spans, F.col("parts"), made).alias("segments"), F.col("state").isin(*t.final).alias("valid"), "state")


def read_turns(formatted: Column, template: Template = TEMPLATE) -> Column:
    """The turns of a formatted chat, array<struct<role, text>>, unescaped."""
    t = template
    body = F.substring(formatted, F.lit(len(t.begin) + 1), F.length(formatted) - len(t.begin) - len(t.end))
    turns = F.split(body, "\\Q" + t.close + "\\E", -1)
    turns = F.slice(turns, 1, F.size(turns) - 1)

    def turn(x: Column) -> Column:
        cut = F.instr(x, t.open[1])
        role = F.substring(x, F.lit(len(t.open[0]) + 1), cut - len(t.open[0]) - 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substring(x, cut + len(t.open[1]), F.length(x))).alias("text"))

    return F.transform(turns, turn)


def read_loss(formatted: Column, segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    # Each segment is cut from the bytes: finding a code point's place means walking the text from its start.
    cut = lambda b: F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(F.substring(b, (s["first_byte"] + 1).cast("int"), s["bytes"].cast("int")).cast("string")))
    return F.array_join(let(formatted.cast("binary"), cut), "")
