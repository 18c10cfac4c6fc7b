"""Line dedup by a log-template tree.

A line's words are masked where they are variable by their look (they hold a digit). The tree starts
with the number of words, then the first ``DEPTH`` masked words; a leaf is what shares those. Each
remaining word of a line is a field. A field's value is constant if at least ``CONSTANT`` of the leaf's
documents (and ``MIN_DOCS``) have it, so the verdict is a share and the same at every size; any other
value is variable and becomes a wildcard. A line's template is its leaf with the constants that are left; it
stands only if at least ``SHARE`` of the fields are constant. Lines for which it does not stand are split
by the most frequent value that each has and not all share (lines of one template have the same one), and judged
again inside these smaller leaves, ``LEVELS`` times in all; then a line is its own template. A template found in
``MIN_DOCS`` documents or more recurs: its lines are dropped everywhere but in the least doc_id that has it,
and a repeated line inside that document stays.

Lines are equal if the 128-bit BLAKE2 digests of their masked words are; before a line is taken out, its
digest is made again from the text and compared. Fields are compared by 64-bit hashes of their words, templates
are told apart by their node and by their constants (64 bits each).

Everything is counted over all documents by grouped sums (node, field, value); no leaf is ever gathered
in one task: the few leaves, nodes, lines or templates with over 1 / ``HOT`` of all weight, at most
``HOT`` rows, are broadcast, the others joined by a shuffle. Before lines meet the leaves with several
kinds of lines, a bitmap of fixed size (2 MB) keeps those of most other leaves out of that shuffle. Lines under ``MIN_WORDS`` words have no wildcards: one of whose words some has no
digit is its masked words (``Page 3 of 9``), any other (``3 9``) its exact words. As short lines also meet
by chance, one recurs if at least ``SHORT_SHARE`` of all documents (and ``SHORT_DOCS``) have it. Blank lines always stay.

Defined cases: null and empty texts have one blank line, which stays; rows without a doc_id keep all
lines; rows that share a doc_id count as one document, of each row the lines that it has itself are taken out; ties go to the least doc_id; an empty
table gives no rows; extra columns stay, a column named as an output is replaced.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import map_slices, materialise
from sparkloom.operators.combine import weighed_join

MIN_WORDS = 5
DEPTH = 3
SHARE = 0.75
CONSTANT = 0.1
LEVELS = 4
MIN_DOCS = 2
SHORT_SHARE = 0.001
SHORT_DOCS = 3
_HOLDS_DIGIT = re.compile(rb"[0-9]").search

#: A line is named by its leaf and the two halves of its digest.
LINE = ["leaf", "line", "check"]
LINES = "doc_id long, line_no int, leaf long, line long, check long, short boolean, words string"


def masked_words(raw: bytes) -> list[bytes]:
    """A line's words, those with a digit masked (in short lines only if some word has none)."""
    words = raw.split()
    if _HOLDS_DIGIT(raw):
        masked = [b"\0" if _HOLDS_DIGIT(w) else w for w in words]
        if len(words) >= MIN_WORDS or any(w != b"\0" for w in masked):
            return masked
    return words


def line_digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _lines(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A row for every line with a word; words holds its fields, joined by one space, and is null in short lines."""
    row, number, leaf, digest, short, fields = [], [], [], [], [], []
    for i, text in enumerate(batch.column("text").to_pylist()):
        for k, raw in enumerate((text or "").encode().split(b"\n")):
            if words := masked_words(raw):
                few = len(words) < MIN_WORDS
                row.append(i)
                number.append(k)
                leaf.append(hashlib.blake2b(b"%d " % len(words) + b" ".join(words[: MIN_WORDS if few else DEPTH]), digest_size=8).digest())
                digest.append(line_digest(words))
                short.append(few)
                fields.append(None if few else b" ".join(words[DEPTH:]))
    long = lambda x: pa.Array.from_buffers(pa.int64(), len(row) * (len(x[0]) // 8 if x else 1), [None, pa.py_buffer(b"".join(x))])
    halves = long(digest)
    cols = [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), long(leaf), halves.take(pa.array(range(0, 2 * len(row), 2), pa.int64())), halves.take(pa.array(range(1, 2 * len(row), 2), pa.int64())), pa.array(short, pa.bool_()), pa.array(fields, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(cols, ["doc_id", "line_no", *LINE, "short", "words"])


def _maybe_in(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """rows whose leaf has its bit set in a bitmap of 2^24 bits over leaves; the broadcast side is at most 2^18 words of 64 bits."""
    word, bit = F.shiftrightunsigned("leaf", 46), F.expr("shiftleft(1L, cast(shiftrightunsigned(leaf, 40) & 63 as int))")
    bitmap = leaves.select(word.alias("__word"), bit.alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))
    held = rows.join(F.broadcast(bitmap), word == F.col("__word")).where(F.col("__bits").bitwiseAND(bit) != 0)
    return held.drop("__word", "__bits")


def templates(mixed: DataFrame, min_docs: int) -> DataFrame:
    """leaf, line, check and template (node, constant, n) of the lines of mixed (these, docs, fields) whose template stands."""
    left, done = mixed.withColumn("node", F.col("leaf")), []
    for _ in range(LEVELS):
        if done and left.isEmpty():
            break
        values = left.select("node", *LINE, "docs", F.posexplode("fields").alias("k", "value"))
        held = materialise(left.groupBy("node").agg(F.sum("docs").alias("all")), "nodes")
        common = values.groupBy("node", "k", "value").agg(F.sum("docs").alias("support")).where(F.col("support") >= min_docs)
        common = weighed_join(common, held, ["node"], "all")
        constant = F.col("support") >= F.col("all") * CONSTANT
        anchor = F.when(F.col("support") < F.col("all"), F.struct("support", (-F.col("k")).alias("k"), "value"))
        met = values.join(common, ["node", "k", "value"]).groupBy("node", *LINE).agg(F.bit_xor(F.when(constant, F.xxhash64("k", "value"))).alias("constant"), F.count_if(constant).alias("n"), F.max(anchor).alias("anchor"))
        stands = F.col("n") >= F.size("fields") * SHARE
        judged = materialise(left.join(met, ["node", *LINE]).withColumn("stands", stands), "judged", instead_of=(held,))
        done.append(judged)
        left = judged.where("not stands and anchor is not null").select(*LINE, "docs", "rows", "fields", F.xxhash64("node", "anchor.k", "anchor.value").alias("node"))
    stood = [judged.where("stands").select(*LINE, "rows", "node", F.coalesce("constant", F.lit(0)).alias("constant"), "n") for judged in done]
    return materialise(functools.reduce(DataFrame.union, stood), "shaped", instead_of=tuple(done))


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, line_no and digest (line, check) of every line to drop; a written table."""
    lines = materialise(map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null"), "text", LINES, _lines), "lines")
    # one row for each line, with the number of documents that have it and of its rows
    by_doc = lines.groupBy(*LINE, "short", "doc_id").agg(F.count(F.lit(1)).alias("rows"))
    held = by_doc.groupBy(*LINE, "short").agg(F.count(F.lit(1)).alias("docs"), F.sum("rows").alias("rows"), F.min("doc_id").alias("first"))
    held = materialise(held, "held")
    # leaves in which a template may recur beyond equal lines: several lines, enough documents
    leaves = held.where("not short").groupBy("leaf").agg(F.sum("docs").alias("docs"), F.sum("rows").alias("weight"), F.count(F.lit(1)).alias("kinds"))
    leaves = materialise(leaves.where((F.col("docs") >= min_docs) & (F.col("kinds") > 1)).select("leaf", "weight"), "leaves")
    of_leaves = weighed_join(_maybe_in(lines.where("not short").select(*LINE, "words"), leaves), leaves, ["leaf"], "weight")
    worded = of_leaves.groupBy(*LINE).agg(F.min("words").alias("words")).join(_maybe_in(held.where("not short"), leaves), LINE)
    fields = F.transform(F.split("words", " "), lambda w: F.xxhash64(w))
    mixed = materialise(worded.select(*LINE, "docs", "rows", fields.alias("fields")), "mixed", instead_of=(leaves,))
    # templates with wildcards: their documents are counted over distinct (template, document)
    shaped = templates(mixed, min_docs)
    template = ["node", "constant", "n"]
    named = weighed_join(lines.select(*LINE, "doc_id"), shaped, LINE, "rows").groupBy(*template, "doc_id").agg(F.count(F.lit(1)).alias("rows"))
    general = named.groupBy(*template).agg(F.count(F.lit(1)).alias("docs"), F.min("doc_id").alias("first"), F.sum("rows").alias("weight"))
    general = materialise(general.where(F.col("docs") >= min_docs).drop("docs"), "general")
    by_template = weighed_join(shaped, general, template, "weight").select(*LINE, "rows", "first")
    known = docs.select("doc_id").where("doc_id is not null").distinct().count()
    enough = F.when(F.col("short"), max(SHORT_DOCS, min_docs, SHORT_SHARE * known)).otherwise(min_docs)
    equal = held.where(F.col("docs") >= enough).select(*LINE, "rows", "first")
    drop = materialise(equal.union(by_template).groupBy(*LINE).agg(F.min("first").alias("first"), F.max("rows").alias("rows")), "recurring")
    out = weighed_join(lines.select(*LINE, "doc_id", "line_no"), drop, LINE, "rows").where("doc_id != first").select("doc_id", "line_no", "line", "check")
    return materialise(out, "drops", instead_of=(lines, held, mixed, shaped, general, drop))


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """docs with text rewritten, and how many lines it had and has lost, in columns named by counts."""
    base = docs.drop(*counts)
    found = recurring_lines(docs, min_docs)
    drops = found.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set(F.struct("line_no", "line", "check")).alias("__drop"))
    drops = materialise(drops, "drops", instead_of=(found,))
    # always one shuffle by document, so that the plan is the same at every size; the build side is line numbers, never text
    joined = base.join(drops.hint("shuffle_hash"), F.col("doc_id") == F.col("__id"), "left").drop("__id")

    def without(batch: pa.RecordBatch) -> pa.RecordBatch:
        """The text without the lines in column __drop whose digests are those named there; texts that lose none are handed on as they are."""
        names = [n for n in batch.schema.names if n != "__drop"]
        texts, drops = batch.column("text"), batch.column("__drop")
        n_lines = pc.add(pc.cast(pc.count_substring(texts.fill_null(""), "\n"), pa.int64()), 1)
        n_dropped, new = [0] * len(texts), {}
        for i in pc.indices_nonzero(drops.is_valid()).to_pylist():
            parts, gone = (texts[i].as_py() or "").split("\n"), set()
            for d in drops[i].as_py():
                if (k := d["line_no"]) < len(parts) and line_digest(masked_words(parts[k].encode())) == struct.pack("=qq", d["line"], d["check"]):
                    gone.add(k)
            if gone:
                new[i], n_dropped[i] = "\n".join(x for k, x in enumerate(parts) if k not in gone), len(gone)
        if new:
            changed = pa.array([i in new for i in range(len(texts))])
            texts = pc.replace_with_mask(texts, changed, pa.array([new[i] for i in sorted(new)], texts.type))
        cols = [texts if n == "text" else batch.column(n) for n in names]
        return pa.RecordBatch.from_arrays([*cols, n_lines, pa.array(n_dropped, pa.int64())], [*names, *counts])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), *(f"`{n}` long" for n in counts)])
    return map_slices(joined, "text", schema, without)
