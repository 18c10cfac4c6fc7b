"""Chat formatting with a grammar round trip.

Every turn is rendered as ``<s>[INST]role[/INST]text</s>``. The parser is deterministic: the control
strings cut the output into pieces, and it is read only if they follow each other as ``<s> [INST]
[/INST] </s>`` again and again with nothing between frames; so no control string may stand inside a
role or a text. What lies between is unescaped. A conversation is rendered as it is and reparsed;
while the turns that come back differ from the source, its roles and texts are escaped: a backslash
after the first character of every control string inside them (one more where backslashes stand
there already), which no reading can take for a mark and which unescaping reverses exactly. Hence
texts without control strings or their escaped forms stay as they are, every other is escaped, and
the output text alone says what the turns were.

The loss mask is the list of spans (start, length in code points) of assistant texts in the output;
``read_back`` takes the turns and the text under the mask from ``formatted`` and nothing else.

DataFrame functions only. A conversation's turns are brought together to be rendered, since the
output is one text for each conversation; their order is turn, role, text, nulls first. Defined
cases: null roles and texts are empty strings; rows without a conv_id form one conversation without
an id; repeated rows are repeated turns; an empty table gives no rows; very long texts are rendered
whole; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import let, running_starts

#: The control strings, which are the marks of the template, in the order of a frame.
CONTROLS = ("<s>", "[INST]", "[/INST]", "</s>")

_CONTROL = r"<s>|</s>|\[INST\]|\[/INST\]"
_INNER = r"(/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _INNER, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _INNER, r"$1$2$3")


def render(turns: Column) -> Column:
    frame = lambda t: F.concat(F.lit("<s>[INST]"), t["role"], F.lit("[/INST]"), t["text"], F.lit("</s>"))
    return F.array_join(F.transform(turns, frame), "")


def _frames(formatted: Column) -> Column:
    """(role, text) of every frame, still escaped; null where the grammar doesn't fit."""
    marks = F.regexp_extract_all(formatted, F.lit(_CONTROL), F.lit(0))

    def cut(pieces: Column) -> Column:
        n = (F.size(pieces) - 1) / 4
        places = F.filter(F.sequence(F.lit(0), n.cast("int")), lambda i: i < n)
        between = F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(places, lambda i: F.concat(F.get(pieces, 4 * i + 1), F.get(pieces, 4 * i + 4))), ""))
        fits = (F.array_join(marks, "") == F.repeat(F.lit("".join(CONTROLS)), n.cast("int"))) & (between == "")
        return F.when(fits, F.transform(places, lambda i: F.struct(F.get(pieces, 4 * i + 2).alias("role"), F.get(pieces, 4 * i + 3).alias("text"))))

    return let(F.split(formatted, _CONTROL, -1), cut)


def parse(formatted: Column) -> Column:
    """The turns that the grammar reads; null where frames do not make up the whole text."""
    return F.transform(_frames(formatted), lambda f: F.struct(unescape(f["role"]).alias("role"), unescape(f["text"]).alias("text")))


def loss_spans(formatted: Column, role: str = "assistant") -> Column:
    """(start, length) of the texts of one role in the output."""
    marks = sum(map(len, CONTROLS))
    head = sum(map(len, CONTROLS[:3]))

    def spans(frames: Column) -> Column:
        starts = running_starts(F.transform(frames, lambda f: F.length(f["role"]) + F.length(f["text"]) + marks))
        placed = F.zip_with(frames, starts, lambda f, at: F.struct(f["role"].alias("role"), (at + head + F.length(f["role"])).cast("int").alias("start"), F.length(f["text"]).alias("length")))
        return F.transform(F.filter(placed, lambda x: unescape(x["role"]) == role), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")))

    return let(_frames(formatted), spans)


def chat_format(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, escaped (were texts escaped), loss_spans, round_trip (the turns read back equal the source)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turn = F.struct("turn", text("role").alias("role"), text("text").alias("text"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("rows"))
    convs = convs.select("conv_id", F.transform("rows", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    safe = F.transform("turns", lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text")))
    same = lambda c: F.coalesce(parse(F.col(c)) == F.col("turns"), F.lit(False))
    plain = convs.withColumn("once", render(F.col("turns"))).withColumn("escaped", ~same("once"))
    made = plain.withColumn("formatted", F.when(F.col("escaped"), render(safe)).otherwise(F.col("once")))
    return made.select("conv_id", "formatted", "escaped", loss_spans(F.col("formatted")).alias("loss_spans"), (~F.col("escaped") | same("formatted")).alias("round_trip"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns and loss_text, all taken from the output text alone."""
    pieces = lambda spans: F.transform(spans, lambda s: unescape(F.substring(F.col("formatted"), s["start"] + F.lit(1), s["length"])))
    return formatted.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), F.array_join(let(loss_spans(F.col("formatted")), pieces), "").alias("loss_text"))
