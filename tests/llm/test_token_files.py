"""Token files against encoding each text whole, on texts with nulls, ties, repeated rows and signs of all kinds."""

import glob
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codeloom.llm import queries, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
SIGNS = ["a", "B", "é", "1", "²", "'", "s", "'ll", " ", "  ", "\n", "\n\n", "\t", ".", ",", "!?", "_", "-", "<|endoftext|>", " ", "᠎", " ", "\x1c", "ß", "字", "́", "😀", "\r\n", "''s", "#"]


def by_hand(rows):
    """What the operator returns of (doc_id, text) rows, without Spark."""
    whole, at, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in rows:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_encoder_cuts_change_nothing():
    rng, encode = random.Random(3), token_files.Encoder(PATH)
    assert encode.cuts
    texts = ["".join(rng.choices(SIGNS, k=rng.randrange(16))) for _ in range(6000)] + ["one two, three.\nfour's 'five' (six)", None, "a b"]
    for encode.BOUND, encode.BYTES in ((encode.BOUND, encode.BYTES), (50, 300)):
        for some in (texts[:3000], texts[3000:], texts[5990:], []):
            assert [*encode(pa.array(some, pa.string()))] == [encode.whole(t or "") for t in some]
    assert [*encode(pa.array(["x", "b c", "d e f"]).slice(1))] == [encode.whole("b c"), encode.whole("d e f")]
    whole = token_files.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert not whole.cuts and [*whole(pa.array([" One two ", None]))] == [whole.whole(" One two "), b""]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    texts = ["".join(rng.choices(SIGNS, k=rng.randrange(40))) for _ in range(60)] + [None, "", "#", "# # #", "word " * 30_000, "x" * 5000]
    return [(i * 7 % 1000, t) for i, t in enumerate(texts)]


def test_round_trip(spark, rows):
    """Sequences of 16 in files of 200 tokens: documents cross sequences, batches and parts; the long one is a file of its own."""
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("ids", "at", "part", "tokens")}).repartition(5)
    path = token_files.own_path(spark, "tokens")
    token_files.write_tokens(table, path, PATH, 2, length=16, file_tokens=200)
    found = token_files.read_tokens(spark, path)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found.collect())
    assert got == by_hand(sorted(rows, key=lambda r: r[0]))
    assert found.select("part", "piece").distinct().count() > 4
    files = sorted(glob.glob(path.removeprefix("file:") + "/part-*"))
    sequences = token_files.Sequences(files)
    ids, mask = sequences[len(sequences) - 1]
    assert len(ids) == len(mask) == 16 and not ids.flags.owndata
    assert sum(sequences[n][1].true_count for n in range(len(sequences))) == sum(r[2] for r in got)
    before = pa.total_allocated_bytes()
    views = [sequences[n] for n in range(len(sequences))]
    assert pa.total_allocated_bytes() - before < 64 * len(views)
    with pytest.raises(IndexError):
        sequences[len(sequences)]


def test_ties_nulls_and_none(spark):
    """Rows of one id in an order by their texts' hash, the same in every run; null ids first; no rows, no files."""
    rows = [(5, "b"), (5, "a a a"), (5, None), (None, "n"), (None, "n"), (1, "x"), (5, "b"), (-3, "y")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    runs = [sorted(token_files.round_trip(t, PATH, length=4).select("doc_id", "start", "n_tokens", "ids_crc32").collect(), key=lambda r: r.start) for t in (table, table.repartition(7))]
    assert runs[0] == runs[1] and [r.doc_id for r in runs[0]] == [None, None, -3, 1, 5, 5, 5, 5]
    assert [r.start for r in runs[0]] == np.cumsum([0, *(r.n_tokens for r in runs[0])])[:-1].tolist()
    assert sorted(r[2:] for r in runs[0]) == sorted(r[2:] for r in by_hand(rows))
    assert token_files.round_trip(table.limit(0), PATH).count() == 0


def test_equal_rows_spread_over_files(spark):
    """A third of all rows being one row: no task has them all."""
    table = spark.createDataFrame([(7, "the same words again")] * 3000 + [(i, "others") for i in range(6000)], "doc_id long, text string")
    token_files.TASK_BYTES, before = 4000, token_files.TASK_BYTES
    got = token_files.round_trip(table, PATH)
    per = [r["n"] for r in got.where("doc_id = 7").groupBy("part").agg(F.count("*").alias("n")).collect()]
    token_files.TASK_BYTES = before
    assert sum(per) == 3001 and max(per) < 1500


def test_registered_query(spark):
    at = "/root/testdata/sf0.001"
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(tuple(r) for r in queries.op11_token_files(spark, at).collect())
    assert got == by_hand(rows)
