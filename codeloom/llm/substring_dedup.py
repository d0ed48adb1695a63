"""Substring dedup with repeated-phrase automata.

A window is `window` consecutive words of one document. A word is removed if a window that covers it also starts
in a document with a smaller id. The work is dealt over shards of whole documents, and every step grows with the
number of words, whatever the sizes of the groups of copies:

1. Each document gives its windows' minimizers (the least hash of the `anchor`-word runs in a window); equal windows
   have equal minimizers, so only windows whose minimizer recurs go on.
2. Those windows are grouped by a 128-bit hash, once for each shard however many copies it holds. This confirms
   recurring passages and finds the owner of each, the smallest document that has it.
3. Shards are told the owners of their own recurring windows, by place: a row for each, and no text, so that what very
   many documents share costs its owner nothing.
4. Each shard cuts its passages (runs of such windows) out of its own documents, compiles them into an Aho-Corasick
   automaton over word numbers and streams all its documents through it. The patterns are the passages' aligned blocks
   of window / 2 words, of which every window contains one, so an automaton is as large as its passages. Around each
   block found, windows are compared word by word with the passage.
"""

from __future__ import annotations

import itertools

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BASE, BASE2, WordHasher, found_in, gram_hashes, mixed, raw, shard_count, sliding_min, u64

SHARD_BYTES = 8 << 20
RESULT = "doc_id long, n_words long, n_removed long, spans array<array<int>>, kept_text string"


def _minimizers(words: np.ndarray, window: int, anchor: int) -> np.ndarray:
    return sliding_min(gram_hashes(words, anchor), window - anchor + 1)


def _documents(shard: pa.Table, hasher: WordHasher):
    """(id, words, their hashes) by rising id, rows of one id by text: the same order whenever a shard is read."""
    ids = shard["doc_id"].to_pylist()
    texts = shard["text"].cast(pa.binary())
    alike = len(set(ids)) < len(ids)
    for i in sorted(range(len(ids)), key=lambda i: (ids[i], alike and (texts[i].as_py() or b""))):
        words = (texts[i].as_py() or b"").split()
        yield ids[i], words, hasher.of(words)


def _fingerprints(window: int, anchor: int):
    def run(shard: pa.Table) -> pa.Table:
        hasher = WordHasher()
        each, last = [], []
        for doc, _, hashes in _documents(shard, hasher):
            if len(hashes) >= window:
                each.append(np.unique(_minimizers(hashes, window, anchor)))
                last.append(doc)
        found, counts = np.unique(np.concatenate(each), return_counts=True) if each else (np.empty(0, np.uint64), np.empty(0, int))
        return pa.table({"shard": pa.array(np.full(len(found), shard["shard"][0].as_py(), np.int64)), "fp": found.view(np.int64), "many": counts > 1})

    return run


def _windows(window: int, anchor: int):
    """A shard's recurring windows: hash, first document, place there (the document's number in the shard, then words),
    whether a document with a larger id has it too."""
    kinds = {"shard": pa.int64(), "h1": pa.int64(), "h2": pa.int64(), "doc": pa.int64(), "at": pa.int64(), "more": pa.bool_()}

    def run(shard: pa.Table, wanted: pa.Table) -> pa.Table:
        parts, hasher, recurring = [], WordHasher(), np.sort(u64(wanted["fp"]))
        for number, (doc, _, hashes) in enumerate(_documents(shard, hasher)) if len(recurring) else ():
            if len(hashes) < window:
                continue
            at = np.flatnonzero(found_in(_minimizers(hashes, window, anchor), recurring)[0])
            if len(at):
                one, two = gram_hashes(hashes, window)[at], gram_hashes(mixed(hashes), window, BASE2)[at]
                parts.append((one, two, np.full(len(at), doc, np.int64), at.astype(np.int64) | number << 32))
        if not parts:
            return pa.table({k: pa.array([], t) for k, t in kinds.items()})
        one, two, docs, places = map(np.concatenate, zip(*parts))
        order = np.lexsort((two, one))  # stable: documents and places keep rising
        one, two, docs, places = one[order], two[order], docs[order], places[order]
        new = np.flatnonzero(np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
        end = np.r_[new[1:], len(one)] - 1
        own = np.full(len(new), shard["shard"][0].as_py(), np.int64)
        return pa.table({"shard": own, "h1": one[new].view(np.int64), "h2": two[new].view(np.int64), "doc": docs[new], "at": places[new], "more": docs[end] > docs[new]})

    return run


def _split(documents: list, owned: pa.Table, window: int) -> tuple[list, list]:
    """The passages of a shard: word lists, and the owner of each window in them. documents: (id, words, hashes) in
    order; owned: place and owner of recurring windows."""
    at, owners = owned["at"].to_numpy(), owned["owner"].to_numpy()
    order = np.argsort(at)
    at, owners = at[order], owners[order]
    edges = np.flatnonzero(np.r_[True, np.diff(at) != 1, True]).tolist() if len(at) else []
    passages, owner_of = [], []
    for start, end in zip(edges, edges[1:]):
        place = int(at[start])
        _, words, _ = documents[place >> 32]
        place &= (1 << 32) - 1
        passages.append(words[place : place + end - start + window - 1])
        owner_of.append(owners[start:end])
    return passages, owner_of


def spelled(numbers: np.ndarray, symbols: int) -> str:
    """Word numbers as a string, `symbols` characters each: 6 bits a character, from another range of characters at
    each place, so that no match begins within a word and few characters can follow any other."""
    out = np.empty((len(numbers), symbols), np.uint8)
    for i in range(symbols):
        out[:, i] = 1 + 63 * i + (numbers // 63**i) % 63
    return out.tobytes().decode("latin-1")


class Passages:
    """A shard's passages: the automaton over their blocks, and their windows with the smallest owner of each."""

    def __init__(self, passages: list[list[bytes]], owners: list[np.ndarray], window: int, hasher: WordHasher):
        self.window, self.block, self.numbers = window, window // 2, {}
        numbers, each, at = self.numbers, [np.empty(0, np.int64)], 0
        hashes, of, places = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for words, owner in zip(passages, owners):
            each.append(np.array([numbers.setdefault(w, len(numbers) + 1) for w in words]))
            hashes.append(gram_hashes(hasher.of(words), window))
            of.append(owner)
            places.append(np.arange(at, at + len(owner)))
            at += len(words)
        self.symbols = 3 if len(numbers) < 63**3 else 4
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for key in each:
            key, wide = spelled(key, self.symbols), self.block * self.symbols
            for i in range(0, len(key) - wide + 1, wide):
                self.automaton.add_word(key[i : i + wide])
        if numbers:
            self.automaton.make_automaton()
        self.words, every, owner, place = (np.concatenate(x) for x in (each, hashes, of, places))
        order = np.lexsort((owner, every))
        every, owner, place = every[order], owner[order], place[order]
        first = np.r_[True, every[1:] != every[:-1]][: len(every)]
        self.hashes, self.owners, self.places = every[first], owner[first], place[first]

    def _blocks(self, numbers: np.ndarray) -> np.ndarray:
        """Where the automaton ends a block: places of last words. Stretches without an unknown word are streamed, as
        long as they can hold a block."""
        edges = np.flatnonzero(np.diff(np.r_[0, (numbers > 0).view(np.int8), 0]))
        ends = []
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - start >= self.block:
                ends += [start + at // self.symbols for at, _ in self.automaton.iter(spelled(numbers[start:end], self.symbols))]
        return np.array(ends, np.int64)

    def _same(self, numbers: np.ndarray, at: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Whether the windows at these places of a document have the words of those at these places of the passages.
        Windows that follow one another in both are compared as one stretch."""
        same = np.ones(len(at), bool)
        edges = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(place) != 1), True])
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist()):
            width = j - i + self.window - 1
            differ = numbers[at[i] : at[i] + width] != self.words[place[i] : place[i] + width]
            if differ.any():
                sums = np.cumsum(np.r_[0, differ])
                same[i:j] = sums[self.window :] == sums[: -self.window]
        return same

    def covered(self, doc: int, words: list[bytes], hashes: np.ndarray) -> np.ndarray:
        """Which words of a document lie in a window that a smaller document has."""
        n, out = len(words) - self.window + 1, np.zeros(len(words) + 1, np.int32)
        if n <= 0 or not self.numbers:
            return out[:-1] > 0
        numbers = np.fromiter(map(self.numbers.get, words, itertools.repeat(0)), np.int64, len(words))
        ends = self._blocks(numbers)
        if not len(ends):
            return out[:-1] > 0
        near = np.zeros(len(words) + 1, np.int32)
        np.add.at(near, np.maximum(ends - self.window + 1, 0), 1)
        np.add.at(near, ends - self.block + 2, -1)
        at = np.flatnonzero(np.cumsum(near)[:n] > 0)
        have, where = found_in(gram_hashes(hashes, self.window)[at], self.hashes)
        have &= self.owners[where] < doc
        at, where = at[have], where[have]
        if len(at):
            at = at[self._same(numbers, at, self.places[where])]
        out[at] += 1
        np.add.at(out, at + self.window, -1)
        return np.cumsum(out)[:-1] > 0


def _result(rows) -> dict[str, pa.Array]:
    """RESULT of (id, words, which of them go)."""
    ids, total, removed, spans, kept = [], [], [], [], []
    for doc, words, gone in rows:
        edges = np.flatnonzero(np.diff(np.r_[0, gone.view(np.int8), 0]))
        ids.append(doc)
        total.append(len(words))
        removed.append(int(gone.sum()))
        spans.append(edges.reshape(-1, 2).tolist())
        kept.append(b" ".join([w for w, x in zip(words, gone.tolist()) if not x] if len(edges) else words))
    return {"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, pa.list_(pa.list_(pa.int32()))), "kept_text": pa.array(kept, pa.binary()).cast(pa.string())}


def _locate(window: int):
    def run(shard: pa.Table, owned: pa.Table) -> pa.Table:
        hasher = WordHasher()
        documents = list(_documents(shard, hasher))
        passages = Passages(*_split(documents, owned, window), window, hasher)
        return pa.table(_result((doc, words, passages.covered(doc, words, hashes)) for doc, words, hashes in documents))

    return run


def _unchanged(batches):
    for batch in batches:
        found = _result((None, words, np.zeros(len(words), bool)) for text in raw(batch["text"]) for words in [(text or b"").split()])
        yield pa.RecordBatch.from_arrays(list(found.values()), list(found))


def substring_dedup(docs: DataFrame, window: int = 50, anchor: int = 20, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per row of docs (doc_id long, text string; other columns are ignored): doc_id, n_words, n_removed, spans
    ([from, to) of removed words, judged on the input) and kept_text (the other words, joined by one space).

    Words are runs of characters other than ASCII white space. Passages of different shards count as equal if 128 bits of
    hashes are; within a shard their words are compared. A null or empty text has none. A row whose doc_id is null is
    neither compared nor changed; rows that share a doc_id count as one document and never remove each other.
    A document shorter than a window keeps all. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    without = docs.where("doc_id is null").select("text").mapInArrow(_unchanged, RESULT)
    shards = shard_count(docs, "text", shard_bytes)
    docs = docs.where("doc_id is not null").withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)))
    prints = docs.groupBy("shard").applyInArrow(_fingerprints(window, anchor), "shard long, fp long, many boolean")
    recurring = prints.withColumn("n", F.count("*").over(Window.partitionBy("fp"))).where("n > 1 or many").select("shard", "fp")
    windows = docs.groupBy("shard").cogroup(recurring.groupBy("shard")).applyInArrow(_windows(window, anchor), "shard long, h1 long, h2 long, doc long, at long, more boolean")
    # a key has a row for each shard that has it at most, whatever the number of copies
    owner = F.min("doc").over(Window.partitionBy("h1", "h2"))
    owned = windows.withColumn("owner", owner).where("owner < doc or more").select("shard", "at", "owner")
    return docs.groupBy("shard").cogroup(owned.groupBy("shard")).applyInArrow(_locate(window), RESULT).unionByName(without)
