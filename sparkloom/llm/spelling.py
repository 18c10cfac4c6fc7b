"""Spelling variants: words one edit apart, found by a positional q-gram index with a count filter.

Words are dealt to cells, each an index small enough for a task: one edit leaves the first or the last half of the shorter
word as it is, so a pair shares the cell of (length, first half) or of (length, last half). A cell of more than
``CELL`` words is dealt again by halves of what its words do not share yet, and so on; where one letter is left it is bounded
by the alphabet. Words of a cell share its halves, so only bigrams of the rest are indexed: postings of (bigram, place)
in word order, one index for each of the two lengths. A word's postings lists (same place for equal lengths; same place or
one on in the longer words) are merged, and partners on at least max(length) - 1 lists of the rest (one edit changes two
bigrams of max(length) + 1) are verified letter by letter. The merge of the sorted lists is one stable sort, which
merges presorted runs as a heap does, but for some million postings at once; that figure bounds the memory of a task.
Each pair comes out of one cell only, and words are summed up inside a task before they are shuffled.

Defined cases: a null text has no words, a missing doc_id is spelled as nothing; repeated rows count each time; ties between
forms go to the smallest word; any length of text or word; other columns are ignored; an empty table has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import materialise, release
from sparkloom.llm.textbatch import mix64

#: Words of fewer code points, or found less often, are not looked at.
MIN_LETTERS, MIN_COUNT = 5, 3
#: One run in so many, by its checksum, loses a letter.
NOISE = 97
#: A form is at least so many times as frequent as its word.
FORM_RATIO = 2
#: Words of a cell, at most, unless all but one letter is shared.
CELL = 4096
#: Rows that are indexed together, and postings that are merged together, in one task.
ROWS, POSTINGS = 1 << 15, 1 << 21
CELL_OF = ["klass", "head", "tail", "shared"]


def words(docs: DataFrame) -> DataFrame:
    """word, n: the words of all texts and how often they stand there."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    runs = F.regexp_extract_all(F.translate("text", upper, lower), F.lit(f"[a-zÀ-ÿ]{{{MIN_LETTERS},}}"), F.lit(0))
    each = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    mark, run = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")), F.col("run")
    at = (mark % F.length(run)).cast("int")
    cut = F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2))
    spelt = each.select(F.when(mark % NOISE == 0, cut).otherwise(run).alias("word")).where(F.length("word") >= MIN_LETTERS)
    return spelt.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= MIN_COUNT)


def _key(df: DataFrame) -> DataFrame:
    """df (klass, head, tail, w, n) with what the words of its cell share: the first ``head`` and the last ``tail`` letters."""
    shared = F.concat(F.substr("w", F.lit(1), F.col("head")), F.substr("w", F.length("w") - F.col("tail") + 1))
    return df.select("klass", "head", "tail", shared.alias("shared"), "w", "n")


def _halves(klass: str, head: str, tail: str):
    """The two cells inside a cell: with half of the letters that are not shared yet, from the left or from the right."""
    rest = F.col(klass) - F.col(head) - F.col(tail)
    half = F.floor(rest / 2).cast("int")
    left = F.struct((F.col(head) + half).alias("head"), F.col(tail).alias("tail"))
    right = F.struct(F.col(head).alias("head"), (F.col(tail) + rest - half).alias("tail"))
    return F.array(left, right)


def cells(vocabulary: DataFrame, limit: int = CELL) -> DataFrame:
    """klass (length of the shorter words), head, tail, shared, w (one byte a letter), n; up to four rows for each word, more where cells were dealt again."""
    w = F.encode("word", "ISO-8859-1")
    one = vocabulary.select(w.alias("w"), "n", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("klass")).where(F.col("klass") >= MIN_LETTERS)
    deal = lambda df: _key(df.select("w", "n", "klass", F.inline(_halves("klass", "head", "tail"))))
    now, out = deal(one.withColumns({"head": F.lit(0), "tail": F.lit(0)})), None
    while True:
        sizes = now.groupBy(*CELL_OF).agg(F.count(F.lit(1)).alias("size"))
        large = materialise(sizes.where((F.col("size") > limit) & (F.col("klass") - F.col("head") - F.col("tail") >= 2)).drop("size"), "cells")
        if large.isEmpty():
            return now if out is None else out.union(now)
        small = now.join(large, CELL_OF, "left_anti")
        out = small if out is None else out.union(small)
        now = materialise(deal(now.join(large, CELL_OF, "left_semi")), "dealt")


def _expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ..., one stretch of counts[i] numbers after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts - starts, counts)


class _Index:
    """The positional bigram index of some whole cells: rows in order of their cells."""

    def __init__(self, batch: pa.RecordBatch | pa.Table):
        column = lambda c: batch.column(c).combine_chunks() if isinstance(batch, pa.Table) else batch.column(c)
        number = lambda c: column(c).to_numpy(zero_copy_only=False)
        self.w = column("w").cast(pa.large_binary())
        self.cell, self.n = number("cell"), number("n")
        self.klass, self.head, self.tail = (number(c).astype(np.int64) for c in ("klass", "head", "tail"))
        at = np.frombuffer(self.w.buffers()[1], np.int64)[self.w.offset : self.w.offset + len(self.w) + 1]
        self.start, self.length = at[:-1].astype(np.int64), np.diff(at).astype(np.int64)
        self.data = np.frombuffer(self.w.buffers()[2] or b"\0", np.uint8)
        self.rest = self.length - self.head - self.tail
        self.longer = self.length > self.klass

    def postings(self, rows: np.ndarray, ahead: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The rows and the keys (cell, place + ahead, bigram) of all bigrams of the words' unshared letters; a cell with one such letter has one more list, of all its words."""
        counts = self.rest[rows] + 1
        owner, place = np.repeat(rows, counts), _expand(np.zeros(len(rows), np.int64), counts)
        last = len(self.data) - 1
        at = self.start[owner] + self.head[owner] + place
        left = np.where(place > 0, self.data[np.clip(at - 1, 0, last)], 0).astype(np.uint64)
        right = np.where(place < self.rest[owner], self.data[np.clip(at, 0, last)], 0).astype(np.uint64)
        key = ((place + ahead + 1).astype(np.uint64) << np.uint64(16)) | (left << np.uint64(8)) | right
        bare = rows[self.klass[rows] - self.head[rows] - self.tail[rows] <= 1] if ahead == 0 else rows[:0]
        owner, key = np.concatenate([owner, bare]), np.concatenate([key, np.zeros(len(bare), np.uint64)])
        return owner, mix64(self.cell[owner].astype(np.uint64) ^ mix64(key + np.uint64(1)))

    def candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (shorter or first word, partner) on as many common lists as words one edit apart have at least."""
        short, long = np.flatnonzero(~self.longer), np.flatnonzero(self.longer)
        own, own_key = self.postings(short)
        order = np.argsort(own_key, kind="stable")
        own, own_key = own[order], own_key[order]
        far, far_key = self.postings(long)
        order = np.argsort(far_key, kind="stable")
        far, far_key = far[order], far_key[order]
        # a word's lists: what follows it on its own lists, and the lists of the longer words at its places and one on
        lists = [(own, np.arange(len(own)) + 1, np.searchsorted(own_key, own_key, "right"))]
        for ahead in (0, 1):
            who, key = self.postings(short, ahead)
            lists.append((who, len(own) + np.searchsorted(far_key, key, "left"), len(own) + np.searchsorted(far_key, key, "right")))
        who, first, end = (np.concatenate(x) for x in zip(*lists))
        some = end > first
        who, first, size = who[some], first[some], (end - first)[some]
        order = np.argsort(who, kind="stable")
        who, first, size, entries = who[order], first[order], size[order], np.concatenate([own, far])
        edges = np.flatnonzero(np.diff(who, prepend=-1))  # a word's lists are merged together
        sums, lo = np.concatenate([[0], np.cumsum(size)]), 0
        borders = np.append(edges, len(who))
        while lo < len(edges):
            hi = max(lo + 1, int(np.searchsorted(sums[borders], sums[borders[lo]] + POSTINGS, "right")) - 1)
            part = slice(borders[lo], borders[hi])
            code = np.repeat(who[part], size[part]) * len(self.n) + entries[_expand(first[part], size[part])]
            code.sort(kind="stable")
            heads = np.flatnonzero(np.diff(code, prepend=-1))
            hits = np.diff(heads, append=len(code))
            x, y = np.divmod(code[heads], len(self.n))
            enough = hits >= np.maximum(self.rest[x], self.rest[y]) - 1
            yield x[enough], y[enough]
            lo = hi

    def near(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those pairs of which one replaced or inserted letter makes the partner, without pairs that the cell to the left has too."""
        bounds, keep = np.concatenate([[0], np.cumsum(self.length[x])]), np.zeros(len(x), bool)
        lo = 0
        while lo < len(x):
            hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + POSTINGS, "right")) - 1)
            a, b = x[lo:hi], y[lo:hi]
            n = self.length[a]
            place, begin = _expand(np.zeros(len(a), np.int64), n), np.cumsum(n) - n
            mine = self.data[np.repeat(self.start[a], n) + place]
            same = mine == self.data[np.repeat(self.start[b], n) + place]
            after = mine == self.data[np.minimum(np.repeat(self.start[b], n) + place + 1, len(self.data) - 1)]
            other = np.add.reduceat(~same, begin, dtype=np.int64)
            until = np.minimum.reduceat(np.where(same, np.repeat(n, n), place), begin)  # the first letter that differs
            since = np.maximum.reduceat(np.where(after, -1, place), begin)  # the last that differs from the partner's next one
            appended = (self.tail[a] > 0) & (until >= n - self.tail[a])
            keep[lo:hi] = np.where(self.length[b] == n, other == 1, (since < until) & ~appended)
            lo = hi
        return x[keep], y[keep]

    def variants(self) -> pa.RecordBatch | None:
        """w, n_near, and the most frequent (smallest of these) near word with its count, for the rows that have one."""
        pairs = [self.near(x, y) for x, y in self.candidates()]
        x = np.concatenate([a for p in pairs for a in p] or [np.zeros(0, np.int64)])
        y = np.concatenate([a for p in pairs for a in p[::-1]] or [np.zeros(0, np.int64)])
        if len(x) == 0:
            return None
        rank = np.empty(len(self.n), np.int64)
        rank[pc.array_sort_indices(self.w).to_numpy()] = np.arange(len(self.n))
        order = np.lexsort((rank[y], -self.n[y], x))
        x, y = x[order], y[order]
        heads = np.flatnonzero(np.diff(x, prepend=-1))
        take = lambda rows: self.w.take(pa.array(rows)).cast(pa.binary())
        return pa.RecordBatch.from_arrays([take(x[heads]), pa.array(np.diff(heads, append=len(x))), pa.array(self.n[y[heads]]), take(y[heads])], ["w", "n_near", "best_n", "best"])


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole cells are indexed together; the last of what was read waits for the rest of its rows."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= ROWS:
            table = pa.Table.from_batches(held)
            cell = table.column("cell").to_numpy()
            cut = int(np.flatnonzero(np.diff(cell, prepend=~cell[0]))[-1])
            if cut and (out := _Index(table.slice(0, cut)).variants()) is not None:
                yield out
            held = table.slice(cut).combine_chunks().to_batches()
            rows = table.num_rows - cut
    if rows and (out := _Index(pa.Table.from_batches(held)).variants()) is not None:
        yield out


def near_words(vocabulary: DataFrame, limit: int = CELL) -> DataFrame:
    """word, n, n_near (words one edit away), form (the most frequent of these, if frequent enough), form_n; one row for each of vocabulary (word, n)."""
    cell = F.xxhash64(*CELL_OF)
    dealt = cells(vocabulary, limit).select(cell.alias("cell"), *CELL_OF[:3], "w", "n").repartition("cell").sortWithinPartitions("cell")
    found = dealt.mapInArrow(_indexed, "w binary, n_near long, best_n long, best binary")
    spelt = lambda c: F.decode(c, "ISO-8859-1")
    told = found.select(spelt(F.col("w")).alias("word"), F.lit(0).cast("long").alias("n"), "n_near", (-F.col("best_n")).alias("less"), spelt(F.col("best")).alias("best"))
    bare = vocabulary.select("word", "n", F.lit(0).cast("long"), F.lit(None).cast("long"), F.lit(None).cast("string"))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct("less", "best"))).alias("s")
    summed = told.union(bare).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best)
    has = -F.col("s.less") >= FORM_RATIO * F.col("n")
    return summed.select("word", "n", "n_near", F.when(has, F.col("s.best")).alias("form"), F.when(has, -F.col("s.less")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root for each of forms (word, form) that has a form: its form's form and so on to the last.

    Every round a word takes what its goal has as goal, so a chain of length d takes log2(d) rounds; a form is twice as
    frequent as its word at least, so chains are short and never closed.
    """
    now = materialise(forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not now.where("moved").isEmpty():
        goals = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        met = now.select("word", "root").join(goals, "root", "left")
        now = materialise(met.select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots", instead_of=(now,))
    return now.select("word", "root")


def spelling_variants(docs: DataFrame, limit: int = CELL) -> DataFrame:
    """word, form, root, n, n_near, form_n; one row for each word of docs (doc_id, text)."""
    vocabulary = materialise(words(docs), "words")
    forms = materialise(near_words(vocabulary, limit), "forms")
    release(vocabulary)
    met = forms.join(roots(forms), "word", "left")
    return met.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
