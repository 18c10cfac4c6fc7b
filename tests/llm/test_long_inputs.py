"""Very long and hostile inputs: bounded time, no crash, whole results."""

import random
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F
from test_llm import brute_spans

from sparkloom.llm import secret_scan, url_filters

B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
PATHS = ["a/" * 3000 + "a1", "a/" * 3000 + "a", "/ab-cd_ef/gh" * 5, "/" + "ab_" * 20 + "c", "ab/" * 9, "//" + "ab/cd" * 9, "ab/cd/-ef/ghijklmnopq", "abcdefghijkl_mnopqrstuv_", "-abc-defg-hijk-lmno-pqr"]


def spans(spark, held):
    df = spark.createDataFrame(list(enumerate(held)), "doc_id long, text string")
    return {r.doc_id: ([tuple(s) for s in r.base_spans], [tuple(s) for s in r.spans]) for r in secret_scan.secret_scan(df).collect()}


def test_candidates_longer_than_a_piece(spark):
    """Pieces meet without a seam: hot and cold stretches of all lengths around their borders."""
    rng = random.Random(2)
    pick = lambda n: "".join(rng.choice(B64) for _ in range(n))
    held = [pick(n) for n in (20, 21, secret_scan.PIECE, secret_scan.PIECE + 18, secret_scan.PIECE + 19, secret_scan.PIECE + 20, 3 * secret_scan.PIECE + 40, 5000)]
    held += ["".join(pick(rng.randrange(1, 60)) + "a" * rng.randrange(1, 40) for _ in range(40)) for _ in range(6)]
    held += [f"é {pick(300)}== x", *PATHS]
    got = spans(spark, held)
    for k, text in enumerate(held):
        assert got[k] == brute_spans(text), k


@pytest.mark.parametrize("kind", ["segments", "segments of a path", "base64", "hex", "letters", "digits"])
def test_a_million_characters(spark, kind):
    rng, n = random.Random(4), 1_000_000
    text = {"segments": "a/" * n + "a1", "segments of a path": "a/" * n + "a", "letters": "x" * n, "digits": "1234567" * (n // 7)}.get(kind) or "".join(rng.choices(B64 if kind == "base64" else B64[26:32] + "0123456789", k=n))
    began = time.time()
    base, every = spans(spark, [text])[0]
    assert time.time() - began < 90
    if kind == "base64":
        got = [s for s in every if s[1] == 3]
        covered = sum(e - s for s, _, e in got)
        assert covered > 0.9 * n and all(a[2] < b[0] for a, b in zip(got, got[1:]))
        assert [s for s in got if s[2] < 19_000] == [s for s in brute_spans(text[:20_000])[1] if s[1] == 3 and s[2] < 19_000]
    elif kind == "hex":
        assert base == [(0, 2, n)] == every
    else:
        assert [s for s in every if s[1] == 3] == []


# ---- links in pages


class Links(HTMLParser):
    """What an HTML parser sees of canonical links and refreshes."""

    def __init__(self, page):
        super().__init__(convert_charrefs=False)
        self.found = []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "link" and "canonical" in a.get("rel", "").lower().split():
            self.found.append(a.get("href", ""))
        if tag == "meta" and a.get("http-equiv", "").lower() == "refresh" and "url=" in a.get("content", "").lower():
            self.found.append(a["content"].split("=", 1)[1].strip("'\""))


def targets(spark, pages):
    df = spark.createDataFrame([(f"http://p.net/{k}", page) for k, page in enumerate(pages)], "url string, html string")
    out = [[] for _ in pages]
    for r in url_filters.alias_edges(df).collect():
        out[int(r.u.rsplit("/", 1)[1])].append(r.v)
    return out


def test_links_equal_an_html_parser(spark):
    link = '<link rel="canonical" href="http://t.net/{}">'.format
    pages = [
        link(1) + link(2), f"<!-- {link(1)} -->{link(2)}", f"<!-- {link(1)} <!-- x --> {link(2)} -->", f"<script>'{link(1)}'</script>{link(2)}", f"<script src=x></script>{link(1)}", f"<script><!--\nf()\n--></script>{link(2)}",
        f"<SCRIPT type='a'>\n{link(1)}</SCRIPT >\n{link(2)}", f"<!-- <script> -->{link(1)}", "<META HTTP-EQUIV='Refresh' content='3; url=http://t.net/5'>", '<link href=http://t.net/6 rel=canonical><link rel="nocanonical" href="http://t.net/7"><link rel="a canonical b" href=\'http://t.net/8\'/>', "<p>canonical</p>",
    ]
    assert [sorted(t) for t in targets(spark, pages)] == [sorted(Links(page).found) for page in pages]
    assert targets(spark, [f"{link(1)}<!-- {link(2)}", f"{link(1)}<script>{link(2)}"]) == [["http://t.net/1"], ["http://t.net/1"]]  # never closed


@pytest.mark.parametrize("noise", ["<link ", "<link rel='canonical ", '<link rel="canonical" ', "<!-- ", "<script ", "<script>", '<meta http-equiv=refresh content="', "<link rel=x>", "<link rel=canonical href="])
def test_hostile_pages_take_linear_time(spark, noise):
    began = time.time()
    page = noise * (3_000_000 // len(noise)) + '<link rel="canonical" href="http://t.net/1">'
    got = targets(spark, [page])[0]
    assert time.time() - began < 60
    if noise in ("<link ", "<link rel=x>"):
        assert got == ["http://t.net/1"]


def test_a_hot_target_of_many_pages(spark):
    """A third of all pages name one blocked page; their decisions follow it."""
    n = 3000
    pages = spark.range(n).selectExpr("id as page_id", "concat('http://p.net/', id) as url", "if(id % 3 = 0, '<link rel=canonical href=http://x.com/de/1>', '<p>') as html")
    got = url_filters.url_filters(pages).groupBy("verdict").agg(F.count("*").alias("n"), F.count_if(F.col("page_id") % 3 == 0).alias("k")).collect()
    assert sorted(map(tuple, got)) == [("allow", n - n // 3, 0), ("block", n // 3, n // 3)]
