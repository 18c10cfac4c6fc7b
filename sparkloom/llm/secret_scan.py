"""Secret scans: three fixed patterns, and the entropy of sliding windows over candidate strings.

Candidates are maximal runs of key-like characters of at least ``WINDOW`` (with up to two ``=`` at the
end). A candidate's class follows from the kinds of characters in it: digits, lower or upper case
alone, letters of both cases, hex (digits and letters up to f), base64 (letters, digits and one of
``+/=``), or letters and digits otherwise; names of letters with ``_`` and ``-`` have no class. A window of
``WINDOW`` characters slides over it: of the counts of its characters two change (the character that
enters and the one that leaves, both counted among those that stay), and with them the sum of
c * log2(c); the Shannon entropy is log2(W) - sum / W. A candidate is slid over in pieces of ``PIECE`` windows, so the
work is a few microseconds a character however long it is. Windows at or over the class's threshold that
overlap or touch form a stretch, which is a span of kind ``entropy`` unless the allow-list clears it or a
pattern span holds it already. Of the allow-list, whole patterns (identifiers, paths of words) are asked of
the candidate and partial ones (placeholders, runs of the alphabet) of the stretch alone, so that a
placeholder beside a secret doesn't hide it.

DataFrame functions only; positions are code points, end exclusive, in the whole text. Positions are
sums of lengths in blocks, so a very long text with n matches costs n * sqrt(n). No pattern repeats a group, since Java
matches those by recursion. Defined
cases: a null or empty text has no spans; repeated rows are scanned row by row; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import let, running_before, running_starts

WINDOW = 20
#: Windows that are slid over from one start.
PIECE = 256
#: Class, pattern of its strings, least entropy of a window (log2(20) = 4.32 is the most); the first that fits is taken.
CLASSES = (
    ("digits", r"^[0-9]+$", 3.0),
    ("lower", r"^[a-z]+$", 3.7),
    ("upper", r"^[A-Z]+$", 3.7),
    ("letters", r"^[A-Za-z]+$", 3.8),
    ("hex", r"^[0-9a-fA-F]+$", 3.0),
    ("base64", r"^(?=.*[0-9])(?=.*[A-Za-z])(?=.*[+/=])", 3.8),
    ("mixed", r"^(?=.*[0-9])(?=.*[A-Za-z])", 3.6),
)
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}={0,2}"
#: A candidate that fits this as a whole is not a secret.
ALLOW_UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
#: Nor is one of two words or more with single ``/``, ``_`` or ``-`` between them (and one ``/`` before them): it fits the first two and has none of the third.
ALLOW_PATH = (r"^/?[a-z][a-z/_-]*[a-z]$", r"[a-z][/_-]", r"[/_-]{2}")
#: A stretch in which any of these is found is not a secret.
ALLOW_PART = (
    r"(?i)example|sample|dummy|placeholder|changeme|your[_-]|redacted|lorem",
    r"(?i)abcdefghij|0123456789|qwertyuiop",
    r"(.)\1{7}",
)

_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _none() -> Column:
    return F.array().cast(_SPANS)


def _located(found: Column, pieces: Column) -> Column:
    """Start and text of each match, from the matches and the stretches between them."""
    gap = lambda i: F.length(F.get(pieces, i))
    starts = running_starts(F.transform(found, lambda m, i: gap(i) + F.length(m)))
    return let(starts, lambda s: F.transform(found, lambda m, i: F.struct((F.get(s, i) + gap(i)).cast("int").alias("start"), m.alias("text"))))


def _with_matches(df: DataFrame, name: str, pattern: str) -> DataFrame:
    """df with the located matches of a pattern; the text is split only where there are any."""
    df = df.withColumn("_found", F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    some = F.size("_found") > 0
    df = df.withColumn("_pieces", F.when(some, F.split("text", pattern, -1)))
    return df.withColumn(name, F.when(some, _located(F.col("_found"), F.col("_pieces")))).drop("_found", "_pieces")


def _spans(located: str, kind: int) -> Column:
    one = lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), (m["start"] + F.length(m["text"])).cast("int").alias("end"))
    return F.coalesce(F.transform(located, one), _none())


def hot_stretches(text: Column, threshold: Column, window: int = WINDOW) -> Column:
    """(first, last) of every stretch of touching windows whose entropy reaches the threshold, in order; text is ASCII."""
    size = lambda c: c * math.log2(c) if c else 0.0
    grown = F.array(*[F.lit(size(c + 1) - size(c)) for c in range(window)])  # by how much a sum grows with one more character of those that stand c times

    def changes(piece: Column) -> Column:
        """How each character that enters, and the one that leaves for it, changes the sum."""

        def change(i: Column) -> Column:
            stay = F.substring(piece, F.greatest(i - (window - 1), F.lit(1)), F.least(i - 1, F.lit(window - 1)))

            def of(kept: Column) -> Column:
                step = lambda at: F.get(grown, F.length(kept) - F.length(F.replace(kept, F.substring(piece, at, F.lit(1)))))
                return F.when(i > window, step(i) - step(i - window)).otherwise(step(i))

            return let(stay, of)

        return F.transform(F.sequence(F.lit(1), F.length(piece)), change)

    def hot(piece: Column, before: Column, least: Column) -> Column:
        """Starts of the piece's windows that reach the threshold."""
        zero = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("hot"))

        def step(acc: Column, change: Column) -> Column:
            total, i = acc["sum"] + change, acc["i"] + 1
            reached = (i >= window) & (F.lit(math.log2(window)) - total / window >= least - 1e-9)
            return F.struct(total.alias("sum"), i.alias("i"), F.when(reached, F.array_append(acc["hot"], before + i - window)).otherwise(acc["hot"]).alias("hot"))

        return F.aggregate(changes(piece), zero, step, lambda acc: acc["hot"])

    def pieces(raw: Column, least: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.length(raw) - window, F.lit(0)), F.lit(PIECE))
        cut = lambda k: F.substring(raw, k + 1, F.lit(PIECE + window - 1)).cast("string")
        return F.flatten(F.transform(starts, lambda k: let(cut(k), lambda piece: hot(piece, k, least))))

    def joined(at: Column) -> Column:
        """Stretches of the starts of hot windows: a new one begins where a window does not touch the one before."""
        heads = F.filter(F.sequence(F.lit(0), F.size(at) - 1), lambda i: (i == 0) | (F.get(at, i) > F.get(at, i - 1) + window))
        ends = lambda h: F.transform(h, lambda i, k: F.struct(F.get(at, i).alias("first"), (F.get(at, F.coalesce(F.get(h, k + 1), F.size(at)) - 1) + window).alias("last")))
        return F.when(F.size(at) > 0, let(heads, ends)).otherwise(F.array().cast("array<struct<first:int,last:int>>"))

    given = F.struct(text.cast("binary").alias("raw"), threshold.alias("least"))
    return let(let(given, lambda g: pieces(g["raw"], g["least"])), joined)


def threshold(text: Column) -> Column:
    """The least entropy of a candidate's class; null without a class."""
    out = F.lit(None).cast("double")
    for _, pattern, least in reversed(CLASSES):
        out = F.when(text.rlike(pattern), least).otherwise(out)
    return out


def _allowed(text: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for pattern in patterns:
        out = out | text.rlike(pattern)
    return out


def _uncovered(spans: Column) -> Column:
    """Spans in order without those of kind entropy that lie within one of another kind."""
    ends = running_before(F.transform(spans, lambda s: F.when(s["kind"] < 3, s["end"]).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
    return let(ends, lambda reach: F.filter(spans, lambda s, i: (s["kind"] < 3) | (F.get(reach, i) < s["end"])))


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id, base_spans and spans (arrays of start, kind as an index of KINDS, end, in that order) of every row."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for name, pattern in (("_assign", ASSIGN), ("_access", ACCESS), ("_hex", HEX), ("_cand", CANDIDATE % WINDOW)):
        df = _with_matches(df, name, pattern)
    df = df.drop("text")
    df = df.withColumn("_assign", F.filter("_assign", lambda m: F.length(F.regexp_extract(m["text"], ASSIGN, 2)) >= 6))
    df = df.withColumn("base_spans", F.array_sort(F.concat(_spans("_assign", 0), _spans("_access", 1), _spans("_hex", 2))))
    path = lambda t: t.rlike(ALLOW_PATH[0]) & t.rlike(ALLOW_PATH[1]) & ~t.rlike(ALLOW_PATH[2])
    df = df.withColumn("_cand", F.filter("_cand", lambda m: threshold(m["text"]).isNotNull() & ~m["text"].rlike(ALLOW_UUID) & ~path(m["text"])))

    def hot(m: Column) -> Column:
        piece = lambda s: F.substring(m["text"].cast("binary"), s["first"] + F.lit(1), s["last"] - s["first"]).cast("string")
        found = F.filter(hot_stretches(m["text"], threshold(m["text"])), lambda s: ~_allowed(piece(s), ALLOW_PART))
        return F.transform(found, lambda s: F.struct((m["start"] + s["first"]).cast("int").alias("start"), F.lit(3).alias("kind"), (m["start"] + s["last"]).cast("int").alias("end")))

    df = df.withColumn("_added", F.coalesce(F.flatten(F.transform("_cand", hot)), _none()))
    every = let(F.array_sort(F.concat("base_spans", "_added")), _uncovered)
    return df.select("doc_id", "base_spans", F.when(F.size("_added") > 0, every).otherwise(F.col("base_spans")).alias("spans"))


def written(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")
