"""A trie of conversations by their first turns: one row for each distinct prefix, with counts over its subtree.

Every conversation is a path of nodes from the root. A node belongs to its smallest member; since a member of a node is a
member of all nodes above it, the nodes that a conversation owns are a suffix of its path, so one number, the depth where
it begins to own, says all. Windows over the prefixes mark the owned nodes. What a subtree sums up is then a sum over
the members of its top: the tokens of all turns from there on, less those of owned nodes, are the tokens saved, the next
owned node is a child, and a member whose last node has no child is a leaf. One group-by over prefixes adds it all up.

Prefixes are known by their depth and 128 bits: the bitwise sum of hashes of (depth, SHA-256 of role and text), so a
running window makes them and no text is shuffled. A prefix with a third of all rows is one row of each task: windows keep
their first row before the shuffle, sums are added up before it, joins back to a node broadcast the few nodes of much
weight, and ids that end at one node are put together in blocks of ``ID_BLOCK`` ids and hashed as a stream.

Defined cases: rows without a conv_id are left out; a null role or text is empty; turns go by turn (null first), equal
turns by the digest of role and text, so repeated rows are turns of their own; other columns are ignored; an empty table has
no nodes. The turns of one conversation are put in order by one task, on disk where they are many.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import materialise, release
from sparkloom.operators.combine import weighed_join

#: Ids of conversations that end at one node are joined to texts by blocks of so many neighbouring ids.
ID_BLOCK = 4096
WORD = r"[^\x20\x09-\x0D]+"
NODE = ["depth", "pa", "pb"]


def said(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, key (digest of role and text), words of the text; without the texts."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    words = F.regexp_count(text, F.lit(WORD)).cast("long")
    return conversations.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", key.alias("key"), words.alias("words"))


def rebuilt(turns: DataFrame, family: int = 20, openings: int = 4) -> DataFrame:
    """Rows (family, conv_id, depth, key, words) of conversations that begin with an opening of their family's first one.

    Conversation c, whose family's first is b = c - c % family (towards zero), has the first h = crc32(c) % openings turns of b (all if
    fewer, none if there is no b), then its own turns after its first h. Depth 0 is a row of every conversation.
    A family meets in one shuffle; only the few opening turns of its first conversation go to the others.
    """
    conv, block = F.col("conv_id"), F.col("conv_id") - F.col("conv_id") % family
    length = F.when(conv == F.col("family"), 0).otherwise(F.crc32(conv.cast("string").cast("binary")) % openings).cast("int")
    own = Window.partitionBy("family", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "key")
    first = F.when((conv == F.col("family")) & (F.col("i") < openings), F.struct("i", "key", "words"))
    ranked = turns.withColumn("family", block).repartition("family").withColumn("i", F.row_number().over(own)).withColumn("h", length)
    met = ranked.withColumn("opening", F.array_sort(F.collect_list(first).over(Window.partitionBy("family"))))
    row = lambda depth, key, words: F.struct(depth.cast("long").alias("depth"), key.alias("key"), words.alias("words"))
    given = F.transform(F.slice("opening", 1, F.col("h")), lambda t: row(t["i"], t["key"], t["words"]))
    top = F.array(row(F.lit(0), F.lit(None).cast("binary"), F.lit(0).cast("long")))
    taken = F.least(F.col("h"), F.size("opening"))
    rest = F.when(F.col("i") > F.col("h"), F.array(row(taken + F.col("i") - F.col("h"), F.col("key"), F.col("words"))))
    none = F.slice(top, 1, 0)
    return met.select("family", "conv_id", F.inline(F.concat(F.when(F.col("i") == 1, F.concat(top, given)).otherwise(none), F.coalesce(rest, none))))


def paths(turns: DataFrame, by: Sequence[str] = ("conv_id",)) -> DataFrame:
    """For each conversation and depth its node (depth, pa, pb), the node above (qa, qb), tokens before it and in all, and whether it is the last.

    turns has (conv_id, depth, key, words), with a row of depth 0 for each conversation; ``by`` are columns that tell conversations apart.
    """
    along = Window.partitionBy(*by).orderBy("depth")
    upto, whole = along.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)
    hashed = lambda seed: F.when(F.col("depth") > 0, F.xxhash64(F.lit(seed), "depth", "key")).otherwise(F.lit(0).cast("long"))
    marked = turns.withColumns({"a": hashed(1), "b": hashed(2)})
    summed = marked.withColumns({"pa": F.bit_xor("a").over(upto), "pb": F.bit_xor("b").over(upto), "upto": F.sum("words").over(upto), "total": F.sum("words").over(whole), "last": F.lead("depth").over(along).isNull()})
    return summed.select("conv_id", *NODE, F.col("pa").bitwiseXOR(F.col("a")).alias("qa"), F.col("pb").bitwiseXOR(F.col("b")).alias("qb"), (F.col("upto") - F.col("words")).alias("before"), "total", "last")


def _owned(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes with their owners, and for each owner where it begins to own, the owner of the node above, and whether it is a leaf."""
    first = F.row_number().over(Window.partitionBy(*NODE).orderBy("conv_id"))
    nodes = materialise(rows.withColumn("place", first).where("place = 1").select("conv_id", *NODE, "qa", "qb", "before", "last"), "nodes")
    begin = nodes.groupBy("conv_id").agg(F.min(F.struct("depth", "qa", "qb", "before")).alias("s"))
    chains = materialise(begin.select("conv_id", F.col("s.depth").alias("start"), (F.col("s.depth") - 1).alias("depth"), F.col("s.qa").alias("pa"), F.col("s.qb").alias("pb"), F.col("s.before").alias("stop")), "chains")
    stems = chains.where("start > 0").groupBy(*NODE).agg(F.count(F.lit(1)).alias("weight"))
    stems = materialise(stems.join(nodes.select(*NODE, F.col("conv_id").alias("parent"), "last"), NODE), "stems")
    inner = stems.where("last").select(F.col("parent").alias("conv_id"))  # their last node has a child
    hung = weighed_join(chains.where("start > 0"), stems, NODE, "weight").select("conv_id", "start", "stop", "parent")
    every = hung.union(chains.where("start = 0").select("conv_id", "start", "stop", F.lit(None).cast("long")))
    owners = every.join(inner.withColumn("inner", F.lit(True)), "conv_id", "left")
    return nodes, owners.select("conv_id", "start", "stop", "parent", F.col("inner").isNull().alias("leaf"))


def _ends(rows: DataFrame) -> DataFrame:
    """For each node where conversations end, the SHA-256 of their ids in order, joined by commas."""
    block = F.floor(F.col("conv_id") / F.lit(ID_BLOCK).cast("decimal(20,0)")).cast("long")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = rows.where("last").groupBy(*NODE, block.alias("block")).agg(ids.alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []
        for batch in batches:
            *node, ids = (batch.column(c).to_pylist() for c in (*NODE, "ids"))
            for key, more in zip(zip(*node), ids):
                if key == now:
                    state.update(b"," + more.encode())
                    continue
                if now is not None:
                    done.append((*now, state.hexdigest()))
                now, state = key, hashlib.sha256(more.encode())
            if done:
                yield _batch(done)
                done = []
        if now is not None:
            yield _batch([(*now, state.hexdigest())])

    return blocks.repartition(*NODE).sortWithinPartitions(*NODE, "block").select(*NODE, "ids").mapInArrow(hashed, "depth long, pa long, pb long, ends string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["depth", "pa", "pb", "ends"])


def prefix_trie(turns: DataFrame, by: Sequence[str] = ("conv_id",)) -> DataFrame:
    """conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256; one row for each node.

    saved_tokens: of every node in the subtree the members but one, times the words of its last turn. ends_sha256: of the
    ids of members that end there, numerically ascending, joined by commas (of the empty text where none does).
    """
    rows = materialise(paths(turns, by), "paths")
    nodes, owners = _owned(rows)
    met = rows.join(owners, "conv_id", "left")
    start, depth = F.col("start"), F.col("depth")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    above: Column = F.when(depth == start, F.col("parent")).when(depth > start, F.col("conv_id"))
    summed = met.groupBy(*NODE).agg(
        F.min(F.struct("conv_id", above.alias("parent"))).alias("owner"),
        F.count(F.lit(1)).alias("n_convs"),
        F.sum(flag(~F.col("last") & (depth + 1 >= start))).alias("n_children"),
        F.sum(flag(F.col("leaf"))).alias("n_leaves"),
        F.sum(F.greatest(F.coalesce("stop", "total") - F.col("before"), F.lit(0))).alias("saved_tokens"),
    )
    found = summed.join(_ends(rows), NODE, "left")
    nothing = hashlib.sha256(b"").hexdigest()
    out = materialise(found.select("owner.conv_id", "depth", F.col("owner.parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(nothing)).alias("ends_sha256")), "trie")
    release(rows, nodes)
    return out
