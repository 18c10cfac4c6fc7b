"""Byte-pair encoding and decoding with a pair occurrence index.

Within a task, the distinct pieces not met before are merged together: an index maps every adjacent
symbol pair to all its positions in all those pieces, a heap holds the ranks of the pairs that occur,
and ranks are applied in ascending order; each applied position updates the lists of the pairs that
it breaks and makes. A piece's ids are then kept by piece (at most ``KEPT_PIECES``; beyond that the
table starts anew, which costs time, not results), and texts are gathered from them with numpy.

The vocabulary file is the one of the public tokenizers format: NFC, white space collapsed,
lower-cased, split by a pattern, bytes spelled as printable characters, and a suffix on each word's
last symbol. Strings of added tokens in a text become their single ids, as that format defines.
Letters and digits are those of the installed Unicode tables (code points that are unassigned in
Unicode 15 may be classed otherwise by another library).

Defined cases: a null or empty text, or one of white space only, has no ids and decodes to the empty
string; repeated rows are encoded row by row; extra columns stay, a column named as the output is
replaced.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sparkloom.llm.common import ragged
from sparkloom.llm.textbatch import slices

KEPT_PIECES = 600_000


def _spelling() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else 256 and up in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """A word-level BPE file: ids of symbols, ranks of merges, and what splits a text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            if (pair := (self.ids[a], self.ids[b])) not in self.merges:
                self.merges[pair] = (rank, self.ids[a + b])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.mark = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.spell = _spelling()
        self.spoken = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.added.items()}

    def symbols(self, word: str) -> list[int]:
        """The ids of a word's single bytes, the last with the word-end suffix."""
        shown = [self.spell[b] for b in word.encode()]
        shown[-1] += self.suffix
        return [self.ids[s] for s in shown]


class PairIndex:
    """All positions of every adjacent pair over many words at once, merged rank by rank."""

    def __init__(self, vocabulary: Vocabulary, words: list[list[int]]):
        self.merges = vocabulary.merges
        sizes = [len(w) for w in words]
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        self.symbol = [s for w in words for s in w]
        n = len(self.symbol)
        self.after = list(range(1, n + 1))
        self.before = list(range(-1, n - 1))
        for a, b in zip(self.starts[:-1], self.starts[1:]):
            self.before[a] = -1
            self.after[b - 1] = -1
        self.at: dict[tuple[int, int], list[int]] = {}
        self.heap: list[tuple[int, tuple[int, int]]] = []
        for i in range(n):
            if self.after[i] >= 0:
                self.note(i)

    def note(self, i: int) -> int:
        """Enter the pair that begins at position i; its rank, or -1 if it never merges."""
        pair = (self.symbol[i], self.symbol[self.after[i]])
        if pair not in self.merges:
            return -1
        if pair not in self.at:
            self.at[pair] = []
            heapq.heappush(self.heap, (self.merges[pair][0], pair))
        self.at[pair].append(i)
        return self.merges[pair][0]

    def run(self) -> list[list[int]]:
        symbol, before, after = self.symbol, self.before, self.after
        while self.heap:
            rank, pair = heapq.heappop(self.heap)
            made = self.merges[pair][1]
            places = self.at.pop(pair)
            places.sort()
            for k, i in enumerate(places):
                j = after[i]
                if j < 0 or symbol[i] != pair[0] or symbol[j] != pair[1]:
                    continue  # an earlier merge took one of the two
                symbol[i], symbol[j] = made, -1
                after[i] = after[j]
                after[j] = -1
                least = rank
                if after[i] >= 0:
                    before[after[i]] = i
                    if 0 <= (r := self.note(i)) < least:
                        least = r
                if before[i] >= 0 and 0 <= (r := self.note(before[i])) < least:
                    least = r
                if least < rank and k + 1 < len(places):  # a new pair goes first: take the others up again after it
                    for q in places[k + 1 :]:
                        if after[q] >= 0 and (symbol[q], symbol[after[q]]) == pair:
                            self.note(q)
                    break
        return [[s for s in symbol[a:b] if s >= 0] for a, b in zip(self.starts[:-1], self.starts[1:])]


class Encoder:
    """Encodes texts in one task; remembers the ids of words and of pieces (stretches without white space)."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.forget()

    def forget(self) -> None:
        self.place: dict[str | tuple[str], int] = {}
        self.flat = np.zeros(0, np.int32)
        self.edges = np.zeros(1, np.int64)

    def pieces(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return text.split() if not SEPARATORS.search(text) else SPACES.split(text)

    def enter(self, keys: list, ids: list[list[int]]) -> None:
        first = len(self.place)
        self.place.update(zip(keys, range(first, first + len(keys))))
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.int32)])
        self.edges = np.concatenate([self.edges, self.edges[-1] + np.cumsum(np.fromiter(map(len, ids), np.int64))])

    def of(self, key: str | tuple[str]) -> list[int]:
        k = self.place[key]
        return self.flat[self.edges[k] : self.edges[k + 1]].tolist()

    def learn(self, pieces: list[str | tuple[str]]) -> None:
        """Enter the ids of new pieces; all words in them that are new are merged in one index. A 1-tuple is an added token."""
        marks = [p for p in pieces if isinstance(p, tuple)]
        split = {p: [p] if p.isascii() and p.isalpha() else self.v.split.findall(p) for p in pieces if isinstance(p, str)}
        words = list({w: None for found in split.values() for w in found if w not in self.place})
        merged = PairIndex(self.v, [self.v.symbols(w) for w in words]).run()
        self.enter(words + marks, merged + [[self.v.added[m[0]]] for m in marks])
        fresh = dict(zip(words, merged))
        longer = [p for p in split if p not in self.place]
        self.enter(longer, [[i for w in split[p] for i in (fresh.get(w) or self.of(w))] for p in longer])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and how many each has."""
        if len(self.place) > KEPT_PIECES:
            self.forget()
        rows: list[list] = []
        for text in texts:
            text = text or ""
            if self.v.mark and any(x in text for x in self.v.added):
                parts = self.v.mark.split(text)  # every second part is an added token
                rows.append([p for k, x in enumerate(parts) for p in ([(x,)] if k % 2 else self.pieces(x))])
            else:
                rows.append(self.pieces(text))
        if new := list({p: None for row in rows for p in row if p not in self.place}):
            self.learn(new)
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(rows)), np.int64, int(sizes.sum()))
        counts = self.edges[at + 1] - self.edges[at]
        offsets = np.cumsum(counts) - counts
        index = np.arange(int(counts.sum())) - np.repeat(offsets - self.edges[at], counts)
        done = np.concatenate([[0], np.cumsum(counts)])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return self.flat[index], np.diff(done[ends])


#: White space of the pattern's \\s beyond or short of str.split's: the four separators 1C-1F are not white space there.
SEPARATORS = regex.compile("[\x1c-\x1f]")
SPACES = regex.compile("[\t-\r \x85\xa0  -     　]+")


def _swap(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    keep = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), column], [*keep, name])


def _with(df: DataFrame, name: str, kind: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != name), f"`{name}` {kind}"])


class Decoder:
    """Spells ids: symbols joined by one space, as the format without a decoder defines; ids out of the vocabulary are left out."""

    def __init__(self, vocabulary: Vocabulary):
        spoken = vocabulary.spoken
        self.words = np.array([spoken.get(i) for i in range(max(spoken) + 1)], object)
        self.known = np.array([w is not None for w in self.words])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        ends = np.cumsum(counts)
        out = []
        for a, b in zip(ends - counts, ends):
            at = ids[a:b]
            at = at[(at >= 0) & (at < len(self.words))]
            out.append(" ".join(self.words[at[self.known[at]]]))
        return pa.array(out, pa.string())


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with a column of token ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(path))
        for batch in batches:
            for lo, hi in slices(batch.column(text)):
                part = batch.slice(lo, hi - lo)
                yield _swap(part, ids, ragged(*encoder.encode(part.column(text).to_pylist()), pa.int32()))

    return df.mapInArrow(run, _with(df, ids, "array<int>"))


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the text that a column of ids spells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(Vocabulary(path))
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                lists = part.column(ids)
                counts = np.asarray(lists.value_lengths().fill_null(0)).astype(np.int64)
                yield _swap(part, decoded, decoder.decode(np.asarray(lists.flatten()).astype(np.int64), counts))

    return df.mapInArrow(run, _with(df, decoded, "string"))


def encode_decode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """encode and decode in one pass: df with ids, and with decoded, which is spelled from the ids, in place of the text."""
    keep = [f for f in df.schema if f.name not in (text, "ids", "decoded")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), "ids array<int>", "decoded string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(path)
        encoder, decoder = Encoder(vocabulary), Decoder(vocabulary)
        for batch in batches:
            for lo, hi in slices(batch.column(text)):
                part = batch.slice(lo, hi - lo)
                flat, counts = encoder.encode(part.column(text).to_pylist())
                cols = [*(part.column(f.name) for f in keep), ragged(flat, counts, pa.int32()), decoder.decode(flat, counts)]
                yield pa.RecordBatch.from_arrays(cols, [*(f.name for f in keep), "ids", "decoded"])

    return df.mapInArrow(run, schema)
