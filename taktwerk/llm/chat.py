"""Chat formatting with typed content parts, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template: a turn is HEAD, the role, MARK, the content, TAIL. `\` makes the next letter an ordinary one.
HEAD, MARK, TAIL = "<turn ", ">\n", "</turn>\n"
KINDS = ("image", "audio", "document")
FIELDS = ("kind", "text", "uri", "width", "height", "seconds", "pages")
PARTS = "array<struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>>"


def escape(text: Column) -> Column:
    """Text whose `<`, `>` and `\\` can't be taken for the template's; unescape gives it back."""
    return F.regexp_replace(text, r"([\\<>])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\<>])", "$1")


def text_part(text: Column) -> Column:
    """One text part, as an array of parts."""
    kind = F.lit("text").alias("kind")
    rest = [F.lit(None).cast(t).alias(n) for n, t in (("uri", "string"), ("width", "int"), ("height", "int"))]
    rest += [F.lit(None).cast(t).alias(n) for n, t in (("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(kind, text.cast("string").alias("text"), *rest)).cast(PARTS)


def visit_text(part: Column) -> Column:
    return escape(F.coalesce(part["text"], F.lit("")))


def visit_attachment(part: Column) -> Column:
    """`<image>`, `<audio>`, `<document>`; `<part kind>` for any other kind, escaped, so that no kind looks like the template's."""
    kind = F.when(part["kind"].isin(*KINDS), part["kind"]).otherwise(F.concat(F.lit("part "), escape(part["kind"])))
    return F.concat(F.lit("<"), kind, F.lit(">"))


def expanded(part: Column, patch: int, per_second: float, per_page: int) -> Column:
    """How many tokens the placeholder of an attachment stands for; 0 for text and for unknown sizes."""
    by_kind = (
        F.when(part["kind"] == "image", F.ceil(part["width"] / F.lit(patch)) * F.ceil(part["height"] / F.lit(patch)))
        .when(part["kind"] == "audio", F.ceil(part["seconds"] * F.lit(per_second)))
        .when(part["kind"] == "document", part["pages"].cast("long") * per_page)
    )
    return F.coalesce(by_kind.cast("long"), F.lit(0).cast("long"))


def format_chat(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    parts_col: str = "parts",
    learn_role: str = "assistant",
    patch: int = 14,
    per_second: float = 12.5,
    per_page: int = 256,
) -> DataFrame:
    """One row for each conversation: conv, n_turns, formatted, loss (array of start and end, in code points of
    formatted, of what learn_role says), attachments (turn, place: the turn's number in the conversation, ordinal, n_tokens and
    the part as it came, in order) and expanded_tokens, the sum of what the placeholders stand for; 0 where a size is null.

    A visitor flattens the parts of a turn: text is escaped; image, audio and document parts become
    `<image>`, `<audio>`, `<document>`, whose order is that of the attachments. Parts of other kinds are
    placeholders `<part kind>` without tokens; null parts and parts without kind are left out. Other columns of turns are not
    carried. Turns rank by turn, then role, then content (nulls first), so ties and
    repeated rows have a defined order; null parts are an empty content, a null role is an empty one, and
    null conversation ids make one conversation. The rows move once, by conversation; a conversation's text is
    one value, so it must fit a row (2 GB), and its turns are summed by a window that streams.
    """
    parts = F.col("__parts")
    attached = F.filter(parts, lambda p: p["kind"] != "text")
    flat = F.transform(parts, lambda p: F.when(p["kind"] == "text", visit_text(p)).otherwise(visit_attachment(p)))
    notes = F.transform(
        attached,
        lambda p: F.struct(
            F.col("__turn").alias("turn"), *(p[f].alias(f) for f in FIELDS), expanded(p, patch, per_second, per_page).alias("n_tokens")
        ),
    )
    rows = turns.select(
        F.col(conv_col).alias("__conv"),
        F.col(turn_col).alias("__turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("__role"),
        F.filter(
            F.coalesce(F.col(parts_col).cast(PARTS), F.array().cast(PARTS)), lambda p: p.isNotNull() & p["kind"].isNotNull()
        ).alias("__parts"),
    )
    rows = rows.select("__conv", "__turn", "__role", F.array_join(flat, "").alias("__body"), notes.alias("__notes"))
    head = F.concat(F.lit(HEAD), escape(F.col("__role")), F.lit(MARK))
    rows = rows.withColumn("__head", head).repartition("__conv")
    size = F.length("__head") + F.length("__body") + len(TAIL)
    order = Window.partitionBy("__conv").orderBy("__turn", "__role", "__body")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__end", F.sum(size.cast("long")).over(running))
    start = F.col("__end") - len(TAIL) - F.length("__body")
    said = F.struct(
        F.col("__end").alias("end"),
        F.concat("__head", "__body", F.lit(TAIL)).alias("segment"),
        F.when(F.col("__role") == learn_role, F.struct(start.alias("start"), (F.col("__end") - len(TAIL)).alias("end"))).alias("loss"),
        F.col("__notes").alias("notes"),
    )
    convs = rows.groupBy("__conv").agg(F.sort_array(F.collect_list(said)).alias("__said"))
    placed = F.transform("__said", lambda s, i: F.transform(s["notes"], lambda x: x.withField("place", i)))
    numbered = F.transform(F.flatten(placed), lambda x, i: x.withField("ordinal", i))
    out = convs.select(
        F.col("__conv").alias(conv_col),
        F.size("__said").cast("long").alias("n_turns"),
        F.array_join(F.col("__said.segment"), "").alias("formatted"),
        F.filter(F.col("__said.loss"), lambda x: x.isNotNull()).alias("loss"),
        numbered.alias("attachments"),
    )
    return out.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda acc, x: acc + x["n_tokens"]))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of (role, text), parsed from the string alone.

    Placeholders of attachments come back as they stand, among the text; read_parts tells them apart.
    """
    return F.transform(turns_of(formatted), lambda t: F.struct(t["role"], unescape(t["body"]).alias("text")))


def turns_of(formatted: Column) -> Column:
    """An array of (role, body), the body still escaped."""
    chunks = F.filter(F.split(formatted, TAIL), lambda c: c != "")
    # an escaped letter is two, so the first bare `>` ends the role
    role = rf"^{HEAD}((?:[^\\<>]++|\\[\\<>])*+){MARK}"
    return F.transform(
        chunks,
        lambda c: F.struct(unescape(F.regexp_extract(c, role, 1)).alias("role"), F.regexp_replace(c, role, "").alias("body")),
    )


def read_parts(formatted: Column, attachments: Column) -> Column:
    """The turns with their typed parts, an array of (role, parts): texts from the string, each placeholder's part from attachments.

    Empty texts are gone and neighbouring text parts are one.
    """
    piece = r"<(?:[^\\<>]++|\\[\\<>])*+>|(?:[^\\<>]++|\\[\\<>])++"

    def parts(turn: Column, place: Column) -> Column:
        own = F.filter(attachments, lambda a: a["place"] == place)
        pieces = F.regexp_extract_all(turn["body"], F.lit(piece), F.lit(0))

        def part(p: Column, i: Column) -> Column:
            before = F.size(F.filter(F.slice(pieces, 1, i), lambda x: x.startswith("<")))
            found = F.get(own, before)
            said = text_part(unescape(p))[0]
            return F.when(p.startswith("<"), F.struct(*(found[f].alias(f) for f in FIELDS))).otherwise(said)

        return F.struct(turn["role"], F.transform(pieces, part).alias("parts"))

    return F.transform(turns_of(formatted), parts)


def learned(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped, one after the other."""
    spans = F.transform(
        loss, lambda s: F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
    )
    return F.array_join(F.transform(spans, unescape), "")
