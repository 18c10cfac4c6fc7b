"""The prefix trie, the digest index and the spelling variants against brute-force versions, and their defined cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import exact_dedup, prefix_trie, queries, spelling
from sparkloom.plans.storage import shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- 11


def brute_trie(rows):
    """rows (conv_id, turn, role, text); a dict from prefix to the contract's columns."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()), (role, text)))
    own = {c: [said for _, said in sorted(x)] for c, x in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - int(math.fmod(c, 20))  # as SQL does, towards zero
        built[c] = turns[:] if c == first else own.get(first, [])[:h] + turns[h:]
    members = collections.defaultdict(set)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    children = collections.Counter(p[:-1] for p in members if p)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(c for c in m if len(built[c]) == len(p)))
        saved = sum((len(members[q]) - 1) * (len(WORD.findall(q[-1][1])) if q else 0) for q in below)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], sum(not children[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def trie_of(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"key": F.lit("x"), "depth": F.lit(9), "family": F.lit(1)})
    turns = prefix_trie.rebuilt(prefix_trie.said(df))
    return sorted(map(tuple, prefix_trie.prefix_trie(turns, by=("family", "conv_id")).collect()), key=str)


def test_trie_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a b", "c", "d e f"])) for c in range(0, 130) for t in range(rng.randrange(1, 7)) if c % 7 != 0]
    assert trie_of(spark, rows) == brute_trie(rows)


def test_trie_odd_rows(spark):
    rows = [
        (None, 0, "user", "lost"), (20, None, None, None), (20, 1, "user", "x"), (20, 1, "user", "x"), (20, 1, "assistant", "x"), (21, 5, "user", "only"), (22, 0, "", " \t\n"),
        (25, 0, "user", "w " * 20_000), (25, None, "user", "é 日本語"), (60, 0, "user", "t"), (61, 0, "user", "gone"), (82, 0, "user", "no first one"), (-7, 0, "user", "n"), (-20, 0, "user", "m"),
    ]
    rows += [(100, t, "user", f"long {t}") for t in range(300)] + [(101, t, "user", f"long {t}") for t in range(299)]
    assert trie_of(spark, rows) == brute_trie(rows)
    assert trie_of(spark, []) == []


def test_trie_hot_node_and_blocks_of_ids(spark):
    """A third of all conversations are equal, so their ids end at one node, in several blocks."""
    n = 3 * prefix_trie.ID_BLOCK
    turns = spark.range(n).selectExpr("id as conv_id", "explode(array(0L, 1L)) as depth").selectExpr("conv_id", "depth", "if(depth = 0, null, unhex(sha2(cast(cast(if(conv_id % 3 = 1, -1, conv_id) as string) as binary), 256))) as key", "depth * 2 as words")
    got = {r.n_convs: r for r in prefix_trie.prefix_trie(turns).where("n_convs > 1").collect()}
    assert set(got) == {n, n // 3}
    hot, root = got[n // 3], got[n]
    assert (hot.conv_id, hot.parent_conv_id, hot.saved_tokens, hot.n_leaves) == (1, 0, 2 * (n // 3 - 1), 1)
    assert hot.ends_sha256 == hashlib.sha256(",".join(map(str, range(1, n, 3))).encode()).hexdigest()
    assert (root.n_children, root.n_leaves, root.saved_tokens) == (n - n // 3 + 1, n - n // 3 + 1, hot.saved_tokens)


def test_trie_marks_nodes_before_the_shuffle(spark):
    """The window over a prefix keeps one row of each task, however many have the prefix."""
    rows = prefix_trie.paths(spark.range(9).selectExpr("id as conv_id", "0L as depth", "cast(null as binary) as key", "0L as words"))
    first = F.row_number().over(prefix_trie.Window.partitionBy(*prefix_trie.NODE).orderBy("conv_id"))
    plan = rows.withColumn("place", first).where("place = 1")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


# ---- 12


def index_of(spark, name):
    return exact_dedup.DigestIndex(spark, f"{shared_dir(spark)}/{name}", buckets=3)


ROWS = [(1, "a"), (5, "a"), (5, "a"), (3, None), (4, ""), (None, ""), (None, "n"), (None, "n"), (7, "A"), (8, "a "), (9, "é" * 50_000), (2, "é" * 50_000), (6, "w")]


def test_exact_duplicates(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({"digest": F.lit(1), "keep_id": F.lit("x"), "group_size": F.lit(0)})
    by = collections.defaultdict(list)
    for d, t in ROWS:
        by[t or ""].append(d)
    keep = {t: max((d for d in ids if d is not None), default=None) for t, ids in by.items()}
    want = sorted(((d, keep[t or ""], len(by[t or ""]), d == keep[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for d, t in ROWS), key=str)
    for batches in (1, 4, 9):
        got = exact_dedup.exact_duplicates(docs, index_of(spark, f"exact-{batches}"), batches).withColumn("digest", F.lower(F.hex("digest")))
        assert sorted(map(tuple, got.collect()), key=str) == want
    stay = exact_dedup.drop_known(docs, index_of(spark, "exact-stay"))
    assert stay.columns == docs.columns and sorted((str(r.doc_id), (r.text or "")[:2]) for r in stay.collect()) == sorted((str(d), (t or "")[:2]) for d, t in ROWS if d == keep[t or ""])
    assert exact_dedup.exact_duplicates(docs.limit(0), index_of(spark, "exact-none")).count() == 0


def test_index_persists_and_grows(spark):
    """A second batch meets the first in the folder, from a table that the catalog no longer knows; adding again adds nothing."""
    first = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id long, text string")
    then = spark.createDataFrame([(4, "b"), (5, "c"), (6, "c")], "doc_id long, text string")
    index = index_of(spark, "kept")
    assert sorted(r.doc_id for r in exact_dedup.drop_known(first, index).collect()) == [2, 3]
    index.forget()
    again = exact_dedup.DigestIndex(spark, f"{shared_dir(spark)}/kept", buckets=99)  # the folder's own number counts
    assert again.buckets == 3
    assert [r.doc_id for r in exact_dedup.drop_known(then, again).collect()] == [6]
    for batch in (first, then):
        exact_dedup.index_documents(batch, again)
    assert sorted(r.keep_id for r in again.entries().collect()) == [2, 3, 6]
    assert sorted(r.doc_id for r in exact_dedup.drop_known(first, again).collect()) == [2, 3]


def test_index_is_read_by_bucket(spark):
    index = index_of(spark, "buckets")
    exact_dedup.index_documents(spark.range(50).selectExpr("id as doc_id", "cast(id as string) as text"), index)
    rows = spark.range(9).select(exact_dedup.digest(F.col("id").cast("string")).alias("digest"))
    plan = rows.join(index.entries().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1


# ---- 13


def brute_words(docs):
    n = collections.Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(n):
    near = {w: [v for v in n if v != w and one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def vocabulary(rng, size, letters):
    found = set()
    while len(found) < size:
        found.add("".join(rng.choice(letters) for _ in range(rng.randrange(5, 10))))
    return {w: rng.choice([3, 4, 7, 9, 20, 50]) for w in found}


@pytest.mark.parametrize("limit", [2, 7, spelling.CELL])
def test_near_words_equal_brute_force(spark, limit):
    rng = random.Random(limit)
    n = vocabulary(rng, 400, "aaabé") | {"aaaaa": 5, "aaaaaa": 11, "aaaaaaa": 3, "ÿ÷×ßà": 4, "ÿ÷×ßàá": 9, "x" * 300: 3, "x" * 301: 8, "x" * 150 + "y" + "x" * 149: 4}
    df = spark.createDataFrame(sorted(n.items()), "word string, n long")
    forms = spelling.near_words(df, limit)
    got = forms.join(spelling.roots(forms), "word", "left").select("word", "form", F.coalesce("root", "word"), "n", "n_near", "form_n")
    assert sorted(map(tuple, got.collect())) == brute_variants(n)


def test_near_words_in_small_batches(spark, monkeypatch):
    rng = random.Random(5)
    n = vocabulary(rng, 300, "abc")
    words = sorted(n.items())
    rows = [(f"{side}{w[: len(w) // 2] if side == 'l' else ''}", w) for w, _ in words for side in "l"]
    assert len(rows) == len(words)
    monkeypatch.setattr(spelling, "ROWS", 50)
    monkeypatch.setattr(spelling, "POSTINGS", 40)
    import pyarrow as pa

    data = spelling.cells(spark.createDataFrame(words, "word string, n long")).selectExpr("xxhash64(klass, head, tail, shared) as cell", "klass", "head", "tail", "w", "n").orderBy("cell").toArrow()
    near = collections.Counter()
    for out in spelling._indexed(iter(data.to_batches(max_chunksize=17))):
        for w, k in zip(out.column("w").to_pylist(), out.column("n_near").to_pylist()):
            near[w.decode("latin-1")] += k
    assert isinstance(data, pa.Table) and {w: near[w] for w in n} == {w: k for w, _, _, _, k, _ in brute_variants(n)}


def test_spelling_variants_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = brute_words([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    by_length = collections.defaultdict(list)
    for w in n:
        by_length[len(w)].append(w)
    got = {r.word: r for r in spelling.spelling_variants(docs).collect()}
    assert {w: r.n for w, r in got.items()} == n
    rng = random.Random(3)
    for w in rng.sample(sorted(n), 150):
        near = [v for k in (-1, 0, 1) for v in by_length[len(w) + k] if v != w and one_edit(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form = best if best is not None and n[best] >= 2 * n[w] else None
        assert (got[w].n_near, got[w].form, got[w].form_n) == (len(near), form, n.get(form))
        assert got[w].root == (got[form].root if form else w)


def test_spelling_odd_rows(spark):
    rows = [(0, None), (1, ""), (2, "Words words WORDS"), (2, "Words words WORDS"), (None, "wordz " * 4), (3, "wörds-wörds'wörds"), (4, "q" * 200_000), (5, "ab cd efgh " * 50), (6, "WORDS×÷"), (7, "Ärger ärger ärger ärger")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"word": F.lit("w"), "n": F.lit(1), "cell": F.lit(2)})
    assert sorted(map(tuple, spelling.spelling_variants(df).collect())) == brute_variants(brute_words(rows))
    assert spelling.spelling_variants(df.limit(0)).count() == 0


def test_new_queries_have_sql():
    assert {"op11_prefix_trie", "op12_exact_dedup", "op13_spelling"} <= set(queries.oracle_sql())
