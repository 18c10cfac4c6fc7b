"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line with a word is good or bad. Its features are binned shares and counts of its own
characters and words, and those of the lines before and after it. Training maximises the conditional
likelihood of label sequences, each labelled document giving its label to its lines. A document's
quality is the mean of its lines' forward-backward marginals, weighted by their length, put on a
probability scale by a logistic fit over the training documents.

The model is fitted on labelled rows: all of them up to about ``TRAIN_ROWS``, else those whose hashed
id falls under a share that keeps about so many; of these, texts of over ``TEXT_LINES`` lines are left
out, and if the lines of the rest are more than ``TRAIN_LINES``, a share of the texts by another hash is
taken again (the documented bounds on what reaches the driver). All documents are scored, whole, in one pass without a shuffle. Scores depend on the text alone.

Defined cases: null and empty texts and texts of white space have no lines and get one score, the
smoothed share of good labels among such training rows; a null doc_id counts as the empty text in the
choice of held-out rows; very long texts are scored whole; without labels of both kinds every score
is 0.5; repeated rows are scored row by row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import map_slices, materialise, ragged, release, small_side
from sparkloom.llm.textbatch import TextBatch, count_in, mix64

TRAIN_ROWS = 6_000
TRAIN_LINES = 200_000
TEXT_LINES = 20_000
STEPS = 120
L2 = 1e-3
CUTOFF = 0.3
SYMBOLS = np.zeros(256, bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
_BYTES = np.arange(256)
UPPER = (_BYTES >= 65) & (_BYTES <= 90)
LETTER = UPPER | ((_BYTES >= 97) & (_BYTES <= 122))
DIGIT = (_BYTES >= 48) & (_BYTES <= 57)

#: Upper edges of the bins of each feature; one bin more than edges.
BINS = {
    "words": [1, 3, 7, 15, 31, 63],
    "symbols": [0.0, 0.02, 0.08],
    "bangs": [0.0, 0.02],
    "upper": [0.0, 0.05, 0.2, 0.6],
    "digits": [0.0, 0.05],
    "word_length": [3.0, 4.5, 6.0, 9.0],
    "repeats": [0.0, 0.1, 0.3],
    "distinct": [0.5, 0.8],
    "seen": [0],
    "stop": [0],
    "capital": [0],
    "pipes": [0.0, 0.05],
}
_WIDTHS = [len(e) + 1 for e in BINS.values()]
_FIRST = np.concatenate([[0], np.cumsum(_WIDTHS)[:-1]])
OWN = int(sum(_WIDTHS))
#: Own features, those of the line before, those of the line after, no line before, no line after.
SIZE = 3 * OWN + 2


@dataclass
class Chain:
    """Weights for good against bad: of features, of moves between labels, and of the logistic scale."""

    weights: np.ndarray
    moves: np.ndarray
    slope: float
    shift: float
    empty: float


def line_features(t: TextBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lines with a word: bins (lines by features), length in code points, text, and line number in it."""
    ls, le, lo = t.lines()
    number = np.arange(len(ls)) - np.searchsorted(lo, lo)
    ws, we = t.words()
    a, b = np.searchsorted(ws, ls), np.searchsorted(ws, le)
    some = b > a
    ls, le, lo, number, a, b = ls[some], le[some], lo[some], number[some], a[some], b[some]
    points = t.code_points()
    length = points[le] - points[ls]
    size = np.maximum(length, 1)
    n = b - a
    d = t.data
    letters, upper = count_in(LETTER[d], ls, le), count_in(UPPER[d], ls, le)
    h = t.hashes(ws, we)
    line_of = np.repeat(np.arange(len(ls)), n)
    same = np.zeros(len(ws), bool)
    same[1:] = (h[1:] == h[:-1]) & (line_of[1:] == line_of[:-1])
    distinct = np.bincount((np.unique(np.stack([line_of.astype(np.uint64), h]), axis=1)[0]).astype(np.int64), minlength=len(ls)) if len(ws) else np.zeros(0)
    key = mix64(t.hashes(ls, le) + lo.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    seen = np.ones(len(ls))
    seen[np.unique(key, return_index=True)[1]] = 0
    last = d[we[b - 1] - 1] if len(ls) else d
    values = {
        "words": n,
        "symbols": count_in(SYMBOLS[d], ls, le) / size,
        "bangs": count_in(d == 33, ls, le) / size,
        "upper": upper / np.maximum(letters, 1),
        "digits": count_in(DIGIT[d], ls, le) / size,
        "word_length": (points[we[b - 1]] - points[ws[a]] - (n - 1)) / n if len(ls) else n,
        "repeats": count_in(same, a, b) / n,
        "distinct": distinct / n,
        "seen": seen,
        "stop": np.isin(last, np.frombuffer(b".!?:\"')", np.uint8)),
        "capital": UPPER[d[ws[a]]] | (d[ws[a]] == 0xC3) if len(ls) else n,
        "pipes": count_in(d == 124, ls, le) / size,
    }
    bins = [np.searchsorted(np.array(edges, float), np.asarray(values[k], float)) for k, edges in BINS.items()]
    return np.stack(bins, axis=1).astype(np.int8).reshape(len(ls), len(BINS)), length, lo, number


def feature_index(bins: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Active features of every line: its own, its neighbours', the borders; SIZE stands for none."""
    own = bins + _FIRST
    n = len(own)
    out = np.full((n, 3 * own.shape[1] + 2), SIZE, np.int64)
    k = own.shape[1]
    out[:, :k] = own
    first, last = np.ones(n, bool), np.ones(n, bool)
    first[1:] = doc[1:] != doc[:-1]
    last[:-1] = first[1:]
    out[1:, k : 2 * k] = np.where(first[1:, None], SIZE, own[:-1] + OWN)
    out[:-1, 2 * k : 3 * k] = np.where(last[:-1, None], SIZE, own[1:] + 2 * OWN)
    out[first, 3 * k] = 3 * OWN
    out[last, 3 * k + 1] = 3 * OWN + 1
    return out


def _steps(doc: np.ndarray) -> list[np.ndarray]:
    """Lines by place in their text: the first of each, the second of each, ..."""
    if not len(doc):
        return []
    starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    place = np.arange(len(doc)) - np.repeat(starts, np.diff(np.append(starts, len(doc))))
    order = np.argsort(place, kind="stable")
    return np.split(order, np.cumsum(np.bincount(place))[:-1])


def messages(scores: np.ndarray, doc: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log-odds of good against bad for all texts at once."""
    steps = _steps(doc)
    forward, backward = scores.copy(), np.zeros(len(scores))
    (bb, bg), (gb, gg) = moves
    for now in steps[1:]:
        r = forward[now - 1]
        forward[now] += np.logaddexp(bg, gg + r) - np.logaddexp(bb, gb + r)
    for now in steps[:0:-1]:
        r = scores[now] + backward[now]
        backward[now - 1] = np.logaddexp(gb, gg + r) - np.logaddexp(bb, bg + r)
    return forward, backward


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def marginals(bins: np.ndarray, doc: np.ndarray, model: Chain) -> np.ndarray:
    scores = np.append(model.weights, 0.0)[feature_index(bins, doc)].sum(axis=1)
    forward, backward = messages(scores, doc, model.moves)
    return sigmoid(forward + backward)


def _quality(p: np.ndarray, length: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Log-odds of the length-weighted mean marginal of each text; nan for texts without lines."""
    total = np.bincount(doc, length, minlength=n)
    with np.errstate(invalid="ignore", divide="ignore"):
        mean = np.bincount(doc, p * length, minlength=n) / total
    mean = np.clip(mean, 1e-6, 1 - 1e-6)
    return np.log(mean) - np.log1p(-mean)


def train(bins: np.ndarray, length: np.ndarray, doc: np.ndarray, label: np.ndarray) -> Chain:
    """Fit by gradient ascent with per-weight step sizes; label holds 0 or 1 for each text, doc the text of each line."""
    texts = np.bincount(doc, minlength=len(label)) > 0
    empty = (label[~texts].sum() + 1) / ((~texts).sum() + 2)
    if len(set(label[texts].tolist())) < 2:
        return Chain(np.zeros(SIZE), np.zeros((2, 2)), 0.0, 0.0, 0.5)
    index = feature_index(bins, doc)
    y = label[doc]
    inner = np.flatnonzero(doc[1:] == doc[:-1])
    real = np.bincount(index.ravel(), np.repeat(y, index.shape[1]), minlength=SIZE + 1)
    pairs = np.bincount(2 * y[inner] + y[inner + 1], minlength=4).reshape(2, 2)
    theta = np.zeros(SIZE + 1 + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, STEPS + 1):
        w, moves = theta[: SIZE + 1], theta[SIZE + 1 :].reshape(2, 2)
        scores = w[index].sum(axis=1)
        forward, backward = messages(scores, doc, moves)
        p = sigmoid(forward + backward)
        want = np.bincount(index.ravel(), np.repeat(p, index.shape[1]), minlength=SIZE + 1)
        r = scores[inner + 1] + backward[inner + 1]
        joint = np.stack([np.zeros(len(inner)) + moves[0, 0], moves[0, 1] + r, moves[1, 0] + forward[inner], moves[1, 1] + forward[inner] + r])
        joint = np.exp(joint - joint.max(axis=0)) if len(inner) else joint
        expected = (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)
        slope = np.concatenate([real - want, (pairs - expected).ravel()]) / len(doc) - L2 * theta
        slope[SIZE] = 0
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta += 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    model = Chain(theta[:SIZE], theta[SIZE + 1 :].reshape(2, 2), 1.0, 0.0, float(empty))
    x = _quality(marginals(bins, doc, model), length, doc, len(label))[texts]
    a, b, t = 1.0, 0.0, label[texts]
    for _ in range(100):  # Newton steps of the logistic scale, with a small ridge
        q = sigmoid(a * x + b)
        g = np.array([((t - q) * x).sum() - a, (t - q).sum() - b])
        s = q * (1 - q)
        hess = np.array([[(s * x * x).sum() + 1, (s * x).sum()], [(s * x).sum(), s.sum() + 1]])
        step = np.linalg.solve(hess, g)
        a, b = a + step[0], b + step[1]
        if abs(step).max() < 1e-9:
            break
    model.slope, model.shift = float(a), float(b)
    return model


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _share(column: str, seed: int, share: float) -> Column:
    """Is a row among the given share by the hash of its column?"""
    return F.pmod(F.xxhash64(column, F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, lines: int = TRAIN_LINES) -> Chain:
    """A model from documents with a quality label that aren't held out."""
    known = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = known.count()
    if n > rows:
        known = known.where(_share("doc_id", 1, rows / n))
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n")))
    chosen = docs.select("doc_id", "text").join(small_side(known, min(n, rows)), "doc_id").where(F.coalesce(breaks, F.lit(0)) < TEXT_LINES)

    def features(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = TextBatch(batch.column("text"))
        bins, length, doc, _ = line_features(t)
        counts = np.bincount(doc, minlength=t.n)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), ragged(bins.ravel(), counts * len(BINS), pa.int8()), ragged(length, counts, pa.int64())], ["doc_id", "quality", "bins", "length"])

    found = map_slices(chosen.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), "text"), "text", "doc_id long, quality int, bins array<tinyint>, length array<long>", features)
    held = materialise(found, "features")
    total = held.agg(F.sum(F.size("length"))).first()[0] or 0
    got = (held.where(_share("doc_id", 2, lines / total)) if total > lines else held).toArrow().sort_by("doc_id")
    release(held)
    got = got.combine_chunks()
    flat = lambda c: np.concatenate([np.asarray(x.flatten()) for x in got.column(c).chunks] or [np.zeros(0)])
    counts = np.concatenate([np.asarray(x.value_lengths()) for x in got.column("length").chunks] or [np.zeros(0, np.int64)]).astype(np.int64)
    label = np.asarray(got.column("quality")).astype(np.int64)
    doc = np.repeat(np.arange(len(label)), counts)
    return train(flat("bins").astype(np.int64).reshape(-1, len(BINS)), flat("length").astype(float), doc, label)


def label_lines(docs: DataFrame, model: Chain) -> DataFrame:
    """doc_id, line_no (from 0, of \\n-split lines) and good (marginal probability) of every line with a word."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        t = TextBatch(batch.column("text"))
        bins, _, doc, number = line_features(t)
        return pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), pa.array(number.astype(np.int64)), pa.array(marginals(bins, doc, model))], ["doc_id", "line_no", "good"])

    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", "doc_id long, line_no long, good double", run)


def _scores(texts: pa.Array, model: Chain) -> np.ndarray:
    t = TextBatch(texts)
    bins, length, doc, _ = line_features(t)
    x = _quality(marginals(bins, doc, model), length.astype(float), doc, t.n)
    return np.where(np.isnan(x), model.empty, sigmoid(model.slope * np.nan_to_num(x) + model.shift))


def score(docs: DataFrame, model: Chain) -> DataFrame:
    """doc_id and score of every row of docs."""
    run = lambda batch: pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores(batch.column("text"), model))], ["doc_id", "score"])
    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", "doc_id long, score double", run)


def keep_good(docs: DataFrame, model: Chain, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of docs whose score reaches the cutoff, unchanged; they don't move."""
    return map_slices(docs, "text", docs.schema, lambda batch: batch.filter(pa.array(_scores(batch.column("text"), model) >= cutoff)))
