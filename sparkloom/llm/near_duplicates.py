"""MinHash near-duplicates: fast similarity sketching, banding, exact verification, components.

Sketch. Coordinate bins are filled in rounds: in round i < T every shingle is thrown into one bin by
a fresh hash, in rounds T..2T-1 into bin i - T, and a bin keeps its least (round, hash). A text stops
after the first round that leaves no bin empty, so every coordinate is filled after 2T rounds at the
latest, usually two or three; the bins agree with probability equal to the Jaccard similarity and
their number of agreements is concentrated at least as well as for independent samples. Bands of
ROWS coordinates are the bucket keys: at similarity 0.75 a link misses all 32 bands with
probability (1 - 0.75^4)^32 = 5e-6.

Links. Texts with one shingle set (a 128-bit fingerprint) become one representative. In each bucket
every member is compared with the bucket's least id only, then components are formed. While the pairs
that are still open (in one bucket, but in different components) are more than ``OPEN_PAIRS`` for each
row, every bucket takes another member, drawn by hash, and compares it with those of other components:
a large group of near copies falls together in a few such rounds. Of what is then open, buckets of up to
``PAIR_BUCKET`` such members are paired directly; the members of larger ones are joined exactly on
the prefix of their rarest shingles, so large buckets lose no link and never emit all pairs.
Every link is confirmed on the full shingle sets with 100 * intersection >= 75 * union.
Shingles are told apart by 64-bit hashes of their words (words over 255 bytes by BLAKE2).

Hot keys. A pivot that very many pairs name, and a fingerprint that very many texts have, are dealt to
several tasks; the few buckets with over 1/500 of all rows, at most 500, are broadcast when they meet their members; components are formed over representatives only and handed on by fingerprint.
Tables of a round are deleted when those of the next stand.

Defined cases: null or empty texts have an empty set and link with nothing; texts under five words
are one shingle; very long texts are hashed whole; rows that share a doc_id are one node, and if their
sets differ, the one with the least fingerprint stands for it; rows without a doc_id link with nothing,
have no component and are kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkloom.llm.common import map_slices, materialise, ragged, release, small_side
from sparkloom.llm.textbatch import TextBatch, mix64, windows
from sparkloom.operators.combine import spread_join, weighed_join
from sparkloom.operators.components import connected_components

WIDTH = 5
PERCENT = 75
BANDS, ROWS = 32, 4
PAIR_BUCKET = 8
ROUNDS, OPEN_PAIRS = 12, 4
PARITY = 16
_M = np.uint64(0xD1342543DE82EF95)


def shingle_sets(t: TextBatch) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, text after text, and how many each has."""
    starts, ends = t.words()
    owner = t.owner(starts)
    h = t.hashes(starts, ends)
    n_words = np.bincount(owner, minlength=t.n)
    parts, at = [], []
    for k in range(1, WIDTH + 1):
        first, w = windows(h, owner, k)
        if k < WIDTH:
            short = n_words[owner[first]] == k
            first, w = first[short], w[short]
        parts.append(w)
        at.append(owner[first])
    hashes, doc = np.concatenate(parts), np.concatenate(at)
    order = np.argsort(doc, kind="stable")
    hashes, doc = hashes[order], doc[order]
    edges = np.searchsorted(doc, np.arange(t.n + 1))
    for a, b in zip(edges[:-1], edges[1:]):
        hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.bincount(doc[new], minlength=t.n)


def sketch(hashes: np.ndarray, counts: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """The filled bins of every set, one row each; rows of empty sets stay at the largest value."""
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(len(counts) * size, full)
    doc = np.repeat(np.arange(len(counts)), counts)
    for i in range(2 * size):
        mixed = mix64(hashes ^ mix64(np.array([i + 1], np.uint64)))
        bins = (mixed % np.uint64(size)).astype(np.int64) if i < size else np.full(len(hashes), i - size)
        np.minimum.at(out, doc * size + bins, np.uint64(i) << np.uint64(55) | mixed >> np.uint64(9))
        open_ = (out.reshape(-1, size) == full).any(axis=1)
        go_on = open_[doc]
        hashes, doc = hashes[go_on], doc[go_on]
        if not len(hashes):
            break
    return out.reshape(-1, size)


def fingerprints(hashes: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit words for every set: sums of mixed shingle hashes."""
    ends, prints = np.cumsum(counts), []
    for seed in (11, 12):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(hashes ^ mix64(np.array([seed], np.uint64))))])
        prints.append((sums[ends] - sums[ends - counts]).view(np.int64))
    return prints


def _sketches(batch: pa.RecordBatch) -> pa.RecordBatch:
    t = TextBatch(batch.column("text"), lower=True)
    hashes, counts = shingle_sets(t)
    bins = sketch(hashes, counts).reshape(t.n, BANDS, ROWS)
    keys = np.zeros((t.n, BANDS), np.uint64)
    for j in range(ROWS):
        keys = keys * _M + bins[:, :, j]
    keys = mix64(keys + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    prints = fingerprints(hashes, counts)
    lists = ragged(keys[counts > 0].reshape(-1).view(np.int64), np.where(counts > 0, BANDS, 0), pa.int64())
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts.astype(np.int64)), *map(pa.array, prints), lists], ["doc_id", "n_shingles", "fa", "fb", "bands"])


def parities(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """64 * PARITY bits of every set: each shingle flips one. Two sets differ in as many shingles as bits at least."""
    bits = 64 * PARITY
    doc = np.repeat(np.arange(len(counts)), counts)
    flips = np.bincount(doc * bits + (hashes % np.uint64(bits)).astype(np.int64), minlength=len(counts) * bits) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64).reshape(len(counts), PARITY)


def _set_rows(batch: pa.RecordBatch, marked: bool) -> pa.RecordBatch:
    hashes, counts = shingle_sets(TextBatch(batch.column("text"), lower=True))
    cols = [batch.column("doc_id"), *map(pa.array, fingerprints(hashes, counts)), ragged(hashes.view(np.int64), counts, pa.int64())]
    if marked:
        cols.append(ragged(parities(hashes, counts).ravel(), np.full(len(counts), PARITY), pa.int64()))
    return pa.RecordBatch.from_arrays(cols, ["id", "fa", "fb", "shingles", "parity"][: len(cols)])


def _sets(docs: DataFrame, ids: DataFrame, marked: bool = False) -> DataFrame:
    """id and shingles (and parity) of the documents in ids (doc_id), one row each; a written table."""
    texts = docs.join(small_side(ids, ids.count()), "doc_id", "left_semi")
    held = ["fa", "fb", "shingles", *(["parity"] if marked else [])]
    rows = map_slices(texts, "text", "id long, fa long, fb long, shingles array<long>" + (", parity array<long>" if marked else ""), lambda b: _set_rows(b, marked))
    least = rows.where(F.size("shingles") > 0).groupBy("id").agg(F.min(F.struct(*held)).alias("s"))
    return materialise(least.select("id", *[f"s.{c}" for c in held[2:]]), "sets")


def _confirm(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b), those that reach the similarity on full sets; a written table."""
    ids = materialise(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "candidates")
    sets = _sets(docs, ids)
    both = F.size(F.array_intersect("sa", "sb"))
    joined = spread_join(pairs.join(sets.toDF("a", "sa"), "a"), sets.toDF("b", "sb"), ["b"], by="a")
    return materialise(joined.where(100 * both >= PERCENT * (F.size("sa") + F.size("sb") - both)).select("a", "b"), "links", instead_of=(ids, sets))


def _similar_size(x: str, y: str):
    return (100 * F.least(x, y) >= PERCENT * F.greatest(x, y))


def _rare_prefix_pairs(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Candidate pairs among members (id, comp): equal shingles among the rarest n - ceil(0.75 n) + 1 of each.

    A pair whose first common shingle stands at places i and j (rarest first) has at most
    min(na - i, nb - j) + 1 shingles in common and needs 3/7 (na + nb), so a row can only meet
    sizes up to ``cap``; rows that can meet no size are dropped before the join. Linked sets differ
    in at most 1/7 (na + nb) shingles, and so in no more of their parity bits. No link is lost by these bounds.
    """
    whole = _sets(docs, members.select(F.col("id").alias("doc_id")), marked=True)
    each = whole.select("id", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    seen = each.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("df", F.lit(1)), "s"))
    least = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1
    ranked = each.join(seen, "s", "left").withColumn("place", place).where((F.col("place") <= least) & F.col("df").isNotNull())
    ranked = ranked.withColumn("cap", F.floor((F.col("n") - F.col("place") + 1) * ((100 + PERCENT) / PERCENT) - F.col("n") + 1e-6))
    ranked = ranked.where(100 * F.col("cap") >= PERCENT * F.col("n"))
    marks = [F.col("parity")[k].alias(f"m{k}") for k in range(PARITY)]
    ranked = ranked.join(members, "id").join(whole.select("id", "parity"), "id").select("id", "n", "s", "comp", "cap", *marks)
    prefix = materialise(ranked, "prefix", instead_of=(whole,))
    return materialise(_paired(prefix, "s", capped=True), "pairs", instead_of=(prefix,))


def _paired(rows: DataFrame, key: str, capped: bool = False) -> DataFrame:
    """Pairs of rows with one key that are in different components and of similar size (and within each other's cap and parity)."""
    side = lambda x: rows.select(*[F.col(c).alias(f"{x}_{c}") for c in rows.columns])
    fits = (F.col("x_id") > F.col("y_id")) & (F.col("x_comp") != F.col("y_comp")) & _similar_size("x_n", "y_n")
    if capped:
        differ = sum((F.bit_count(F.col(f"x_m{k}").bitwiseXOR(F.col(f"y_m{k}"))) for k in range(PARITY)), F.lit(0))
        fits = fits & (F.col("y_n") <= F.col("x_cap")) & (F.col("x_n") <= F.col("y_cap"))
        fits = fits & ((100 + PERCENT) * differ <= (100 - PERCENT) * (F.col("x_n") + F.col("y_n")))
    return side("x").join(side("y"), (F.col(f"x_{key}") == F.col(f"y_{key}")) & fits).select(F.col("x_id").alias("a"), F.col("y_id").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable) and kept for every row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    drawn = materialise(map_slices(docs, "text", "doc_id long, n_shingles long, fa long, fb long, bands array<long>", _sketches), "sketches")
    known = docs.where("doc_id is not null")
    full = drawn.where("n_shingles > 0 and doc_id is not null")
    nodes = full.groupBy("doc_id").agg(F.min(F.struct("fa", "fb", "n_shingles")).alias("p")).select("doc_id", "p.*")
    prints = ["fa", "fb", "n_shingles"]
    groups = materialise(nodes.groupBy(*prints).agg(F.min("doc_id").alias("rep")), "groups")
    firsts = full.join(groups.withColumnRenamed("rep", "doc_id"), ["doc_id", *prints])
    spread = firsts.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), F.explode("bands").alias("key")).distinct()
    shared = spread.groupBy("key").agg(F.min(F.struct("id", "n")).alias("pivot"), F.max("id").alias("last")).where("pivot.id < last")
    members = materialise(spread.join(shared.select("key", "pivot"), "key"), "buckets")

    stars = members.where("id > pivot.id").where(_similar_size("n", "pivot.n"))
    stars = materialise(stars.select(F.col("id").alias("a"), F.col("pivot.id").alias("b")).distinct(), "pairs")
    links = _confirm(known, stars)
    placed, tested, spent = members.drop("pivot"), stars, [groups, members, stars, links]
    for k in range(1, ROUNDS + 1):
        comp = connected_components(links.toDF("u", "v"))
        marked = placed.drop("comp").join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
        marked = materialise(marked, "placed", instead_of=(placed,))
        parts = marked.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n_part")).groupBy("key")
        parts = parts.agg(F.sum("n_part").alias("size"), F.count(F.lit(1)).alias("comps"), F.sum(F.col("n_part") * F.col("n_part")).alias("inner")).where("comps > 1")
        parts = materialise(parts, "parts")
        placed = materialise(weighed_join(marked.select("key", "id", "n", "comp"), parts.select("key", "size"), ["key"], "size"), "placed", instead_of=(marked,))
        open_pairs, rows = parts.agg(F.sum((F.col("size") * F.col("size") - F.col("inner")) / 2), F.sum("size")).first()
        release(parts)
        if k == ROUNDS or (open_pairs or 0) <= OPEN_PAIRS * (rows or 0):
            break
        turn = F.xxhash64("id", F.lit(k))
        pivots = materialise(placed.groupBy("key").agg(F.min_by(F.struct("id", "n", "comp"), turn).alias("p"), F.count(F.lit(1)).alias("rows")), "pivots")
        more = weighed_join(placed, pivots, ["key"], "rows").where((F.col("comp") != F.col("p.comp")) & _similar_size("n", "p.n"))
        more = more.select(F.greatest("id", "p.id").alias("a"), F.least("id", "p.id").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
        more = materialise(more, "pairs", instead_of=(pivots,))
        found = _confirm(known, more)
        links, tested = links.union(found), tested.union(more)
        spent += [more, found]
        if found.count() * 100 < rows:
            break
    more = _paired(placed.where(F.col("size") <= PAIR_BUCKET), "key")
    large = materialise(placed.where(F.col("size") > PAIR_BUCKET).select("id", "comp").distinct(), "large")
    if large.count():
        more = more.union(_rare_prefix_pairs(known, large)).distinct()
    more = materialise(more.join(tested, ["a", "b"], "left_anti"), "pairs", instead_of=(placed, large))
    links = links.union(_confirm(known, more))

    # components of representatives go to all texts by fingerprint
    comp = connected_components(links.toDF("u", "v"))
    by_print = groups.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select(*prints, F.coalesce("component", "rep").alias("component_id"))
    placed = materialise(spread_join(nodes, by_print, prints, by="doc_id").select("doc_id", "component_id"), "components", instead_of=(*spent, more))
    out = drawn.select("doc_id", "n_shingles").join(placed, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that are the least doc_id of their component."""
    gone = materialise(near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct(), "gone")
    return docs.join(small_side(gone, gone.count()), "doc_id", "left_anti").select(docs.columns)
