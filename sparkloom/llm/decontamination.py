"""Benchmark decontamination by template canonicalisation.

Tokens are runs of letters or runs of digits (with inner points and commas). A number becomes a number
slot, a token that begins with a capital letter (of any alphabet up to U+07FF) a name slot, unit words after a
number (``km``, ``km/h``, ``km per hour``) unit slots; any other token stands for itself in lower case. Other forms of every
window keep names as words, for texts whose case was changed; fold a run of names, numbers or units into one slot whose
value is the whole run, as a name may have any number of words and a unit several parts; or keep every token, numbers
and units too, so that exact copies match whatever they are made of; or take the signs ``+ - * / = < > ^ %`` as tokens, too, with
numbers and units as slots, for items that are mostly numbers. Windows of ``WINDOW`` tokens are hashed with slots as
typed placeholders, so a question with other numbers, names or units has the windows of its original.

Benchmark windows set bits in a bitmap of fixed size (2 MB, whatever the benchmark), which is
the only thing sent to the tasks; document windows whose bit is set go into an equi-join on the
64-bit hash, which Spark plans by the real sizes. Matches of one document and item that lie on one
diagonal (place in the document minus place in the item) belong together; there the slots must be
consistent: one value in the item corresponds to one value in the document and the other way round.
A document is contaminated if some diagonal is consistent and covers ``COVER`` tokens of the item, or
the whole item if that is shorter. In the forms with slots, windows with fewer than
``LITERALS`` tokens that are no slots say nothing and are left out; the form that keeps every token has no such bound, and the
one with signs goes on until ``LITERALS`` such tokens are in the window (and leaves it out only if those are all the same,
as in a column of figures, or the text ends before). So an item is missed in other numbers only if it has under ``LITERALS`` words and signs. Items shorter than a window are one window of their own length.

The join has a row for each window of a document and each item that has it; what leaves it is one row for each
document, item, diagonal and form.

Defined cases: null and empty texts have no tokens and match nothing; very long texts are cut into windows whole; rows without an id are left
out of the matches and are clean; rows that share a doc_id share their matches; equal items all
match; an empty benchmark leaves every document clean; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import map_slices, materialise, ragged, small_side
from sparkloom.llm.textbatch import TextBatch, mix64, powers

WINDOW = 10
LITERALS = 5
COVER = 13
BITS = 1 << 24
UNITS = (
    "mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "l", "s", "sec", "min", "h", "hz", "mph", "kph", "percent", "inch", "inches", "foot", "feet",
    *(word + end for word in ("hour", "minute", "second", "day", "week", "month", "year", "mile", "pound", "dollar", "euro", "degree", "meter", "metre", "kilometer", "gram", "liter", "litre", "watt", "volt") for end in ("", "s")),
)

#: The form whose tokens hold signs and whose windows have any length.
SIGNED = 4
#: What stands for a number, a unit and a name in a template (by kind; kind 0 is a word).
_SLOT = np.array([0, 0x1111, 0x3333, 0x2222], np.uint64)
_M = np.uint64(0xD1342543DE82EF95)
_BYTES = np.arange(256)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_SIGN = np.isin(_BYTES, np.frombuffer(b"+-*/=<>^%", np.uint8))
_LETTER = ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 0x80)

MATCHES = "id long, window long, at long, size int, form int, tokens long, slots array<long>"


def _two_byte_case() -> tuple[np.ndarray, np.ndarray]:
    """Of letters of two bytes in UTF-8, by those bytes: is it a capital, and the bytes of its lower case."""
    capital, lower = np.zeros(1 << 16, bool), np.arange(1 << 16, dtype=np.uint16)
    for c in map(chr, range(0x80, 0x800)):
        code, small = int.from_bytes(c.encode(), "big"), c.lower()
        capital[code] = c.isupper()
        if len(small) == 1 and 0x80 <= ord(small) < 0x800:
            lower[code] = int.from_bytes(small.encode(), "big")
    return capital, lower


CAPITAL, SMALL = _two_byte_case()


def _pairs(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The two bytes at each place as one number."""
    return raw[at].astype(np.uint16) << np.uint16(8) | raw[np.minimum(at + 1, len(raw) - 1)]


def lowered(t: TextBatch) -> TextBatch:
    """A batch whose capitals of one byte are small already, with those of two bytes made small too."""
    at = np.flatnonzero((t.data >= 0xC2) & (t.data <= 0xDF))
    if len(at):
        small = SMALL[_pairs(t.data, at)]
        t.data[at], t.data[at + 1] = small >> np.uint16(8), small & np.uint16(255)
    return t


def _word_hashes(words: tuple[str, ...]) -> np.ndarray:
    t = TextBatch(pa.array(words), lower=True)
    return np.sort(t.hashes(t.docs[:-1], t.docs[1:]))


def tokens(t: TextBatch, raw: np.ndarray) -> tuple[np.ndarray, ...]:
    """Value hash, kind (0 word, 1 number, 2 unit), looks like a name, text and first byte of every token; raw: the bytes before lower-casing."""
    digit = _DIGIT[raw]
    joint = (raw == 46) | (raw == 44)
    if len(raw) > 2:
        joint[1:-1] &= digit[:-2] & digit[2:]
    if len(raw):
        joint[[0, -1]] = False
    border = t.docs[(t.docs > 0) & (t.docs < len(raw))]
    joint[border] = joint[border - 1] = False
    ls, le = t.runs(_LETTER[raw])
    ds, de = t.runs(digit | joint)
    starts, ends = np.concatenate([ls, ds]), np.concatenate([le, de])
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], ends[order]
    number = order >= len(ls)
    value = t.hashes(starts, ends)
    owner = t.owner(starts)
    capital = _UPPER[raw[starts]] | CAPITAL[_pairs(raw, starts)] if len(starts) else np.zeros(0, bool)
    same = owner[1:] == owner[:-1]

    def after(flag: np.ndarray) -> np.ndarray:
        out = np.zeros(len(flag), bool)
        out[1:] = flag[:-1] & same
        return out

    word = ~number & np.isin(value, _word_hashes(UNITS))
    unit = word & after(number)
    for _ in range(2):  # km/h, kg m s
        unit |= word & after(unit)
    per = ~number & (value == _word_hashes(("per",))[0]) & after(unit)
    per[:-1] &= word[1:] & same
    per[-1:] = False
    unit |= per | (word & after(per))
    return value, np.where(number, 1, np.where(unit, 2, 0)), capital & ~number & ~unit, owner, starts


def _with_signs(t: TextBatch, raw: np.ndarray, typed: np.ndarray, value: np.ndarray, slot: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Template, slot, value and text of every token and sign, in order."""
    signs = np.flatnonzero(_SIGN[raw])
    order = np.argsort(np.concatenate([starts, signs]), kind="stable")
    own = mix64(raw[signs].astype(np.uint64) + np.uint64(1))
    return np.concatenate([typed, own])[order], np.concatenate([slot, np.zeros(len(signs), bool)])[order], np.concatenate([value, own])[order], t.owner(np.concatenate([starts, signs])[order])


def _stretched(template: np.ndarray, slot: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and hash of the windows of at least WINDOW tokens that go on until LITERALS tokens in them are no slots, of which two differ."""
    words, n = np.flatnonzero(~slot), len(template)
    first = np.searchsorted(words, np.arange(n))
    at = np.flatnonzero(first + LITERALS <= len(words))
    first = first[at]
    end = np.maximum(words[first + LITERALS - 1] + 1, at + WINDOW)
    changes = np.concatenate([[0], np.cumsum(template[words[1:]] != template[words[:-1]])]) if len(words) else words
    good = (end <= n) & (owner[np.minimum(end, n) - 1] == owner[at]) & (changes[first + LITERALS - 1] > changes[first])
    at, end = at[good], end[good]
    up, down = powers(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(template * up[:n])])
    size = end - at
    return at, size, mix64(mix64((sums[end] - sums[at]) * down[at]) + (size * 8 + SIGNED).astype(np.uint64))


def _windows(batch: pa.RecordBatch, sizes: list[int] | None, bits: np.ndarray | None) -> pa.RecordBatch | None:
    """Windows of the given sizes, or (for items) of WINDOW and, in shorter texts, of the whole text; of the form with signs those of any size."""
    t = TextBatch(batch.column("text"))
    raw = t.data
    value, kind, name, owner, starts = tokens(lowered(TextBatch(batch.column("text"), lower=True)), raw)
    typed, plain = np.where(kind > 0, _SLOT[kind], value), value
    names = np.where(name, _SLOT[3], typed)
    number = kind > 0
    # a run of names, of numbers or of units as one token
    kinds = np.where(name, 3, kind)
    heads = np.ones(len(owner), bool)
    heads[1:] = (kinds[1:] == 0) | (kinds[1:] != kinds[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(heads)
    place = np.arange(len(owner)) - at[np.cumsum(heads) - 1] if len(at) else at
    run = np.add.reduceat(mix64(value + place.astype(np.uint64) * _M), at) if len(at) else value
    parts = []

    def note(form: int, slot: np.ndarray, value: np.ndarray, owner: np.ndarray, at: np.ndarray, size: np.ndarray, acc: np.ndarray) -> None:
        """Those of the windows whose bit is set."""
        if bits is not None:
            place = acc >> np.uint64(40)
            held = (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
            at, size, acc = at[held], size[held], acc[held]
        counts = np.bincount(owner, minlength=t.n)
        firsts = np.cumsum(counts) - counts
        slots, ends = np.flatnonzero(slot), np.concatenate([[0], np.cumsum(slot)])
        n_slots = ends[at + size] - ends[at]
        index = np.arange(int(n_slots.sum())) - np.repeat(np.cumsum(n_slots) - n_slots - ends[at], n_slots)
        doc = owner[at]
        parts.append((doc, at - firsts[doc], counts[doc], acc, size, np.full(len(at), form), n_slots, value[slots[index]]))

    # canonical forms: names as slots, names as words in lower case (a text that was put in another case), all as words, runs as slots
    forms = (
        (names, number | name, value, owner, LITERALS),
        (typed, number, value, owner, LITERALS),
        (value, np.zeros(len(value), bool), value, owner, 0),
        (names[at], (number | name)[at], np.where(kinds[at] > 0, run, value[at]), owner[at], LITERALS),
    )
    for form, (template, slot, value, owner, bound) in enumerate(forms):
        counts = np.bincount(owner, minlength=t.n)
        literal = np.concatenate([[0], np.cumsum(~slot)])
        for k in sizes if sizes is not None else range(1, WINDOW + 1):
            n = len(template) - k + 1
            if n <= 0:
                continue
            acc = template[:n].copy()
            for j in range(1, k):
                acc = acc * _M + template[j : j + n]
            acc = mix64(acc + np.uint64(4 * k + form))
            good = (owner[:n] == owner[k - 1 :]) & (literal[k:] - literal[:n] >= min(bound, k))
            if sizes is None and k < WINDOW:
                good &= counts[owner[:n]] == k
            at = np.flatnonzero(good)
            note(form, slot, value, owner, at, np.full(len(at), k), acc[at])
    template, slot, value, owner = _with_signs(t, raw, typed, plain, number, starts)
    note(SIGNED, slot, value, owner, *_stretched(template, slot, owner))
    if not parts:
        return None
    doc, at, counts, acc, size, form, n_slots, slots = (np.concatenate(x) for x in zip(*parts))
    if not len(at):
        return None
    cols = [batch.column("id").take(pa.array(doc)), pa.array(acc.view(np.int64)), pa.array(at), pa.array(size.astype(np.int32)), pa.array(form.astype(np.int32)), pa.array(counts), ragged(slots.view(np.int64), n_slots, pa.int64())]
    return pa.RecordBatch.from_arrays(cols, ["id", "window", "at", "size", "form", "tokens", "slots"])


def _bitmap(windows: DataFrame) -> np.ndarray:
    """The bits of all benchmark windows; at most BITS / 64 rows come to the driver, each a word of 64 bits."""
    words = windows.selectExpr("shiftrightunsigned(window, 46) as word", "shiftleft(1L, cast(shiftrightunsigned(window, 40) & 63 as int)) as bit")
    out = np.zeros(BITS // 64, np.int64)
    for word, bit in words.groupBy("word").agg(F.bit_or("bit").alias("bit")).collect():
        out[word] = bit
    return out.view(np.uint8)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, diagonal, form, covered (tokens of the item), tokens (of the item), consistent."""
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), "text").where("id is not null")
    known = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null")
    held = materialise(map_slices(items, "text", MATCHES, lambda b: _windows(b, None, None)), "windows")
    sizes = sorted(r.size for r in held.where(F.col("form") != SIGNED).select("size").distinct().collect())  # at most WINDOW values
    bits = docs.sparkSession.sparkContext.broadcast(_bitmap(held))
    seen = map_slices(known, "text", MATCHES, lambda b: _windows(b, sizes, bits.value))
    item = held.select("window", F.col("id").alias("item_id"), F.col("at").alias("item_at"), "tokens", F.col("slots").alias("item_slots"))
    met = seen.select("window", F.col("id").alias("doc_id"), "at", "size", "form", "slots").join(item, "window")
    met = met.withColumn("diagonal", F.col("at") - F.col("item_at"))
    by_line = ["doc_id", "item_id", "diagonal", "form"]
    # how many tokens the windows cover: each adds what lies beyond the one before
    pairs = met.withColumn("pair", F.arrays_zip("item_slots", "slots"))
    lines = pairs.groupBy(*by_line).agg(F.array_sort(F.collect_set(F.struct("item_at", "size"))).alias("spans"), F.array_distinct(F.flatten(F.collect_set("pair"))).alias("pairs"), F.max("tokens").alias("tokens"))
    step = lambda acc, s: F.struct((acc["sum"] + s["item_at"] + s["size"] - F.greatest(acc["end"], s["item_at"])).alias("sum"), (s["item_at"] + s["size"]).alias("end"))
    covered = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).cast("long").alias("end")), step, lambda acc: acc["sum"])
    sides = [F.size(F.array_distinct(F.col(f"pairs.{k}"))) for k in ("item_slots", "slots")]
    n_pairs = F.size("pairs")
    return lines.select(*by_line, covered.alias("covered"), "tokens", ((sides[0] == n_pairs) & (sides[1] == n_pairs)).alias("consistent"))


def contaminated(found: DataFrame) -> DataFrame:
    """doc_id, item_id and covered of every pair that counts as a leak."""
    leak = F.col("consistent") & (F.col("covered") >= F.least(F.lit(COVER), F.col("tokens")))
    return found.where(leak).groupBy("doc_id", "item_id").agg(F.max("covered").alias("covered"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item."""
    leaks = materialise(contaminated(matches(docs, benchmark)).select("doc_id").distinct(), "leaks")
    return docs.join(small_side(leaks, leaks.count()), "doc_id", "left_anti").select(docs.columns)
