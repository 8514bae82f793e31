import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import regista.llm.packing as packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.tokenizer_path())


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")


def held(rows, docs, tokenizer, capacity=4096):
    """All pieces lie gapless in sequences and hold the documents' ids."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= capacity
    for doc_id, text in docs:
        ids, at = ids_of(tokenizer, text), 0
        for r in sorted(by_doc[doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    return 1 - sum(r["length"] for r in rows) / (len(by_seq) * capacity)


def test_round_trip(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = [(-1, None), (-2, ""), (-3, "word " * 20_000), (-4, "İ ẞ don't 12 😀 <|endoftext|>")]
    docs = docs.union(spark.createDataFrame(odd, docs.schema))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = packing.pack(docs).collect()
    assert held(got, rows, tokenizer) < 0.05
    again = packing.pack(docs.repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert packing.pack(docs.limit(0)).count() == 0


def test_repeated_rows(spark, tokenizer):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string").selectExpr("*", "1 as block", "2 as length")
    got = packing.pack(df, capacity=4).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in got) == [(0, 2), (1, 3), (1, 3)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=30), max_size=8))
def test_ids_of_any_text(tokenizer, texts):
    ids = packing.Ids(packing.tokenizer_path())
    texts = [*texts, None, " ".join(texts), "\n".join(texts).upper()]
    for rows in (texts, texts[::-1], []):
        got, starts = ids(pa.array(rows, pa.string()))
        assert len(starts) == len(rows) + 1
        for t, low, high in zip(rows, starts[:-1], starts[1:], strict=True):
            assert got[low:high].tobytes() == ids_of(tokenizer, t)[:-1].tobytes()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=40))
def test_windows_fit(lengths):
    window = packing.fill(np.array(lengths), 100)
    sums = np.bincount(window, weights=lengths)
    assert (sums <= 100).all() and (sums > 0).all()


def test_differencing_is_near_equal():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 1000, 400)
    window, most = packing.differencing(lengths, 50)
    sums = np.bincount(window, weights=lengths, minlength=50)
    assert most == sums.max() and sums.sum() == lengths.sum()
    assert sums.max() - sums.min() < 0.03 * sums.mean()
    assert packing.differencing(np.array([8, 7, 6, 5, 4]), 2)[1] == 16  # the known example


def test_equal_rows_are_dealt_to_all_blocks(spark):
    df = spark.sql("SELECT cast(null AS long) AS doc_id, 'a b c' AS text FROM range(4000)")
    got = packing.pack(df, capacity=40, windows=10).collect()
    assert len(got) == 4000 and len({r["sequence_id"] for r in got}) == 400


def test_batches_are_bounded():
    texts = pa.array(["x" * 30, None, "y" * 500, "z" * 30, "z" * 30, ""])
    batch = pa.record_batch({"doc_id": pa.array(range(6)), "text": texts})
    got = list(packing.bounded([batch], 70))
    assert [b.num_rows for b in got] == [2, 1, 3] and pa.Table.from_batches(got).to_pylist() == batch.to_pylist()


def test_full_pieces_are_sequences_of_their_own(spark, tokenizer):
    df = spark.createDataFrame([(1, "a b c d " * 5000), (2, "a"), (3, "a b c d " * 5000)], "doc_id long, text string")
    got = packing.pack(df, capacity=16).collect()
    full = [r for r in got if r["length"] == 16]
    assert len(full) > 2000 and len({r["sequence_id"] for r in full}) == len(full) and all(r["offset"] == 0 for r in full)
    assert held(got, [(r["doc_id"], r["text"]) for r in df.collect()], tokenizer, 16) < 0.05
