"""Token ids as Arrow files: equal-length sequences with masks, open to random access without copying.

Documents are range-sorted by doc_id, encoded, and packed one after the other into sequences of a fixed length. A file is
Arrow's file format (the stream format, with a footer that tells where each batch is). Its columns:

    ids   fixed_size_list<unsigned integer of the least width that holds the vocabulary>
    mask  fixed_size_list<bool>: false where the last sequence of a file is padded
    docs  list<struct<doc_id, at>>: the documents that begin in this sequence, and where

Batches are not compressed, so a mapped file hands out sequences as they are on disk (`Sequences`). Files are written by
Spark's text sink, one row each, to any store that Spark reaches: a row is a file without its last six bytes, the format's
closing magic, which is the line separator. A lost executor's files are written again under Spark's commit protocol.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import string
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import own_path, shard_count, written

#: Tokens of a sequence, sequences of a batch, tokens after which a file ends (at the end of a document).
LENGTH, BATCH, FILE_TOKENS = 1024, 256, 4 << 20
#: Bytes of text that a task encodes.
TASK_BYTES = 8 << 20
#: Fixed value of the format: the magic that closes a file.
MAGIC = b"ARROW1"


class Encoder:
    """Texts to ids as the tokenizer at `path` encodes them whole, without special tokens added.

    A byte-level tokenizer without a normalizer never merges across a blank or line end that has something other than
    white space on both sides, nor between a run of letters or digits and the signs after it; there texts are cut. The
    pieces of a batch of texts are made, numbered and put together by Arrow. The tokenizer gets each piece once, new ones
    together, line by line, and what it says is remembered, up to a bound. Other tokenizers get whole texts.
    """

    #: Pieces that are remembered, before those not met since are forgotten; pieces that are encoded, and bytes of texts
    #: that are cut, at once.
    BOUND, LINES = 220_000, 10_000
    BYTES = 3 << 20
    CUT = re.compile(r"(?<=[^\s᠎])(?= [^\s᠎])")
    #: No sign, or white space at an end (all of it that any version of Unicode knows).
    LOOSE = r"^$|^[\s\pZ\x00-\x1f\x{85}\x{180e}]|[\s\pZ\x00-\x1f\x{85}\x{180e}]$"
    #: A run of letters or digits and one of ASCII signs that doesn't begin with an apostrophe.
    SIGNED = r"^(?P<word>[\pL\pN]+)(?P<signs>[!-&(-/:-@\[-^`{-~][!-/:-@\[-^`{-~]*)$"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        before = spec["pre_tokenizer"] or {}
        plain = all(not (set(t["content"]) & set(string.whitespace) or t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec["added_tokens"])
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.line_end = self.encoded("\n")
        self.cuts = plain and not spec["normalizer"] and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and len(self.line_end) == 1
        self.type = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        # by what stands before a piece: nothing, a blank; those met lately and before
        self.known: tuple[dict, dict] = ({}, {})
        self.old: tuple[dict, dict] = ({}, {})

    def encoded(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def whole(self, text: str) -> bytes:
        return np.array(self.encoded(text), self.type).tobytes()

    @staticmethod
    def loose(piece: str) -> bool:
        return not piece or piece[0].isspace() or piece[-1].isspace() or "᠎" in (piece[0], piece[-1])

    def parts(self, text: str, after: int) -> list[tuple[int, str]]:
        """The lines of a piece and the ends between them, if these stand alone; which of them come after a blank."""
        first, *rest = text.split("\n")
        if rest and not any(map(self.loose, (first, *rest))):
            return [(after, first), *(x for p in rest for x in ((0, "\n"), (0, p)))]
        return [(after, text)]

    def learn(self, new: list[tuple[int, str]]) -> None:
        for at in range(0, len(new), self.LINES):
            some = [x for x in new[at : at + self.LINES] if "\n" not in x[1]]
            ids = np.array(self.encoded("\n".join([" " * a + t for a, t in some])), self.type)
            cuts = np.flatnonzero(ids == self.line_end[0]) * self.type.itemsize
            raw, begin = ids.tobytes(), 0
            for (a, text), end in zip(some, [*cuts.tolist(), len(raw)]):
                self.known[a][text] = raw[begin:end]
                begin = end + self.type.itemsize
        for a, text in new:
            if "\n" in text:
                self.known[a][text] = self.whole(" " * a + text)

    def of(self, pieces: list[str], after: int) -> list[bytes]:
        """The ids of each piece, which stands after a blank (1) or nothing (0)."""
        if sum(map(len, self.known)) > self.BOUND:
            self.old, self.known = self.known, ({}, {})
        (known, every), old = (self.known[after], self.known), self.old
        missing = [p for p in pieces if p not in known]
        known |= {p: ids for p in missing if (ids := old[after].get(p)) is not None}
        new = dict.fromkeys((after, p) for p in missing if "\n" not in p and p not in known)
        lines = {p: self.parts(p, after) for p in missing if "\n" in p and p not in known}
        for x in (x for parts in lines.values() for x in parts):
            a, text = x
            if text not in every[a]:
                if (ids := old[a].get(text)) is None:
                    new[x] = None
                else:
                    every[a][text] = ids
        self.learn([*new])
        for p, parts in lines.items():
            known[p] = b"".join([every[a][text] for a, text in parts])
        return [known[p] for p in pieces]

    def _known(self, pieces: pa.Array, after: int) -> pa.Array:
        """The ids of many pieces, none for "", which stand after a blank or nothing."""
        coded = pieces.dictionary_encode()
        every = coded.dictionary.to_pylist()
        ids = self.of([p for p in every if p], after)
        if len(ids) < len(every):
            ids.insert(every.index(""), b"")
        return pa.array(ids, pa.large_binary()).take(coded.indices)

    def slowly(self, text: str) -> bytes:
        """A text with white space of several signs, or at its ends, or with special tokens' names in it."""
        if any(t in text for t in self.added):
            return self.whole(text)
        first, *rest = self.CUT.split(text)
        return self.whole(first) + b"".join(self.of([p[1:] for p in rest], 1))

    def __call__(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of each text, as the bytes of numbers of self.type; none for null."""
        texts = texts.cast(pa.string())
        if not self.cuts:
            yield from (self.whole(t) if t else b"" for t in texts.to_pylist())
            return
        through = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) // self.BYTES
        cuts = [0, *(np.flatnonzero(np.diff(through)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts, cuts[1:]):
            yield from self.some(texts[a:b])

    def some(self, texts: pa.Array) -> list[bytes]:
        split = pc.split_pattern(pc.fill_null(texts, ""), " ")
        ends = split.offsets.to_numpy() - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        at, distinct, odd = coded.indices.to_numpy().copy(), coded.dictionary, pc.match_substring_regex(coded.dictionary, self.LOOSE)
        for name in self.added:
            odd = pc.or_(odd, pc.match_substring(distinct, name))
        starts, odd = ends[:-1], odd.to_numpy(zero_copy_only=False)
        slow = np.add.reduceat(odd[at], starts) > 0 if len(texts) else np.zeros(0, bool)
        firsts = self.of([p.as_py() for p in distinct.take(pa.array(at[starts[~slow]]))], 0)
        signed = pc.extract_regex(distinct, self.SIGNED)
        words = pc.if_else(pa.array(odd), "", pc.coalesce(pc.struct_field(signed, "word"), distinct))
        joined = [self._known(x, after) for x, after in ((words, 1), (pc.fill_null(pc.struct_field(signed, "signs"), ""), 0))]
        found = pc.binary_join_element_wise(*joined, pa.scalar(b"", pa.large_binary()))
        at[starts[~slow]] = len(distinct) + np.arange(len(firsts))
        joined = pa.concat_arrays([found, pa.array(firsts, pa.large_binary())]).take(pa.array(at))
        offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1][ends].tolist()
        data = memoryview(joined.buffers()[2] or b"")
        return [self.slowly(texts[n].as_py() or "") if slow[n] else bytes(data[a:b]) for n, (a, b) in enumerate(zip(offsets, offsets[1:]))]


@cache
def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    return Encoder(path)


class _Writer:
    """Packs documents into the bytes of one file."""

    def __init__(self, kind: np.dtype, length: int, end: int):
        self.kind, self.length, self.end = kind, length, np.array([end], kind).tobytes()
        self.parts: list[bytes] = []
        self.docs: list[tuple[int | None, int]] = []
        self.size = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id, self.size))
        self.parts += (ids, self.end)
        self.size += len(ids) // self.kind.itemsize + 1

    def content(self) -> bytes:
        rows = -(-self.size // self.length)
        ids = np.zeros(rows * self.length, self.kind)
        ids[: self.size] = np.frombuffer(b"".join(self.parts), self.kind)
        starts = np.array([at for _, at in self.docs], np.int64)
        offsets = np.searchsorted(starts, np.arange(rows + 1) * self.length).astype(np.int32)
        docs = pa.StructArray.from_arrays([pa.array([d for d, _ in self.docs], pa.int64()), pa.array((starts % self.length).astype(np.int32))], ["doc_id", "at"])
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(ids), self.length), pa.FixedSizeListArray.from_arrays(pa.array(np.arange(rows * self.length) < self.size), self.length), pa.ListArray.from_arrays(pa.array(offsets), docs)]
        table = pa.RecordBatch.from_arrays(columns, ["ids", "mask", "docs"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_file(sink, table.schema.with_metadata({"tokens": str(self.size)})) as file:
            for at in range(0, rows, BATCH):
                file.write_batch(table.slice(at, BATCH))
        return sink.getvalue().to_pybytes()


def _files(tokenizer: str, end: int, length: int, file_tokens: int):
    def run(batches):
        encode = encoder(tokenizer)
        file = _Writer(encode.type, length, end)
        done = lambda: pa.RecordBatch.from_arrays([pa.array([file.content()[: -len(MAGIC)]], pa.binary())], ["content"])
        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), encode(batch["text"])):
                file.add(doc_id, ids)
                if file.size >= file_tokens:
                    yield done()
                    file = _Writer(encode.type, length, end)
        if file.size:
            yield done()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int, length: int = LENGTH, file_tokens: int = FILE_TOKENS) -> None:
    """docs (doc_id, text; other columns are ignored) as token files under path, in ascending order of doc_id, null first.

    Each document is the ids of its whole text and then `end`; a null or empty text is `end` alone. Rows of one doc_id
    come in an order by hash of their texts; rows that are alike in both are spread over tasks like any others, as
    their order makes no difference. An empty table makes no files. A task holds one file's ids and a batch of texts.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text"), F.rand(11)]
    ranged = docs.repartitionByRange(shard_count(docs, "text", TASK_BYTES), *order).sortWithinPartitions("doc_id", F.xxhash64("text"))
    found = ranged.mapInArrow(_files(tokenizer, end, length, file_tokens), "content binary")
    found.select(F.col("content").cast("string")).write.option("lineSep", MAGIC.decode()).option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def opened(content) -> pa.RecordBatchFileReader:
    return pa.ipc.open_file(pa.py_buffer(content))


def documents_of(reader: pa.RecordBatchFileReader):
    """(doc_id, place of the first id in the file, ids) of each document of a file; ids are views of a batch where the
    document lies within one."""
    length, at = reader.schema.field("ids").type.list_size, 0
    left: list = []  # the document that has begun: its id, place and pieces
    for nth in range(reader.num_record_batches):
        batch = reader.get_batch(nth)
        ids, mask = batch["ids"].flatten().to_numpy(), batch["mask"].flatten()
        ids = ids[: mask.true_count]
        begun = batch["docs"].flatten()
        rows = np.repeat(np.arange(batch.num_rows), batch["docs"].value_lengths().to_numpy())
        starts = rows * length + begun.field("at").to_numpy()
        names = begun.field("doc_id").to_pylist()
        cuts = [*starts.tolist(), len(ids)]
        if left and cuts[0]:
            left[2].append(ids[: cuts[0]])
        for name, a, b in zip(names, cuts, cuts[1:]):
            if left:
                yield left[0], left[1], left[2]
            left = [name, at + a, [ids[a:b]]]
        at += len(ids)
    if left:
        yield tuple(left)


READ = "part int, piece int, doc_id long, at long, n_tokens long, ids_crc32 long"


def _read(batches):
    for batch in batches:
        for path, content in zip(batch["path"].to_pylist(), batch["content"]):
            part, piece = map(int, re.search(r"part-(\d+)-.*-c(\d+)", path).groups())
            out: list[tuple] = []
            for doc_id, at, pieces in documents_of(opened(content.as_buffer())):
                crc = 0
                for ids in pieces:
                    crc = zlib.crc32(ids.astype("<u4"), crc)
                out.append((doc_id, at, sum(map(len, pieces)), crc))
            doc_ids, *numbers = zip(*out) if out else ((), (), (), ())
            same = [pa.array([x] * len(out), pa.int32()) for x in (part, piece)]
            yield pa.RecordBatch.from_arrays([*same, pa.array(doc_ids, pa.int64()), *(pa.array(x, pa.int64()) for x in numbers)], [x.split()[0] for x in READ.split(", ")])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The documents of the token files under path: doc_id, start (ids of all documents before it), n_tokens (with the
    end id), ids_crc32, part and piece (which file). Only sums of files are ordered in one place."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    rows = written(files.mapInArrow(_read, READ), "token-documents")
    sums = rows.groupBy("part", "piece").agg(F.sum("n_tokens").alias("tokens"))
    before = F.sum("tokens").over(Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("part", "piece", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(sums, ["part", "piece"]).select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "part", "piece")


class Sequences:
    """Sequences of token files on a local disk, by number: (ids, mask). Files are mapped; ids are views of them."""

    def __init__(self, paths: list[str]):
        self.batches, self.ends, n = [], [], 0
        for path in paths:
            reader = pa.ipc.open_file(pa.memory_map(path))
            for nth in range(reader.num_record_batches):
                self.batches.append(reader.get_batch(nth))
                n += self.batches[-1].num_rows
                self.ends.append(n)

    def __len__(self) -> int:
        return self.ends[-1] if self.ends else 0

    def __getitem__(self, n: int) -> tuple[np.ndarray, pa.BooleanArray]:
        if not 0 <= n < len(self):
            raise IndexError(n)
        nth = bisect.bisect_right(self.ends, n)
        batch = self.batches[nth]
        row = n - (self.ends[nth] - batch.num_rows)
        return batch["ids"].slice(row, 1).flatten().to_numpy(zero_copy_only=True), batch["mask"].slice(row, 1).flatten()


def round_trip(docs: DataFrame, tokenizer: str, end: int = 2, length: int = LENGTH) -> DataFrame:
    """docs written as token files in the shared folder and read back (read_tokens)."""
    path = own_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end, length)
    return read_tokens(docs.sparkSession, path)
