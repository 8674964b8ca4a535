"""Packing: exact round trip, no padding, target proportions per window."""
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st

from cohortbeam.llm import packing, queries

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def check_pieces(pdf, texts, encode, seq_len=1024):
    """texts: {doc_id: text}. Every id in one piece, sequences gapless."""
    for doc_id, mine in pdf.sort_values("start").groupby("doc_id"):
        ids = encode(texts[doc_id] or "") + [0]
        assert mine.doc_tokens.eq(len(ids)).all()
        at = 0
        for r in mine.itertuples():
            assert r.start == at
            raw = np.array(ids[at:at + r.length], dtype="<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(raw)
            at += r.length
        assert at == len(ids)
    lengths = []
    for _, mine in pdf.sort_values("offset").groupby("sequence_id"):
        assert mine.offset.tolist() == [0, *mine.length.cumsum().tolist()[:-1]]
        lengths.append(int(mine.length.sum()))
    assert all(n == seq_len or n & (n - 1) == 0 and n < seq_len for n in lengths)
    assert sum(n != seq_len for n in lengths) <= seq_len.bit_length()
    assert sorted(pdf.sequence_id.unique()) == list(range(len(lengths)))


def test_query_round_trip(spark, sf, real_docs):
    got = queries.QUERIES["op4_packing"](spark, sf).toPandas()
    texts = dict(zip(real_docs.doc_id, real_docs.text))
    assert set(got.doc_id) == set(texts)
    check_pieces(got, texts, packing.load_encoder(JSON)[0])


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_both_vocabulary_files_give_the_same_ids(text):
    if not hasattr(test_both_vocabulary_files_give_the_same_ids, "enc"):
        test_both_vocabulary_files_give_the_same_ids.enc = packing.load_encoder(JSON)[0], packing.load_encoder(RANKS)[0]
    a, b = test_both_vocabulary_files_give_the_same_ids.enc
    assert a(text) == b(text)


def test_both_vocabulary_files_on_documents(real_docs):
    a, b = packing.load_encoder(JSON)[0], packing.load_encoder(RANKS)[0]
    assert all(a(t) == b(t) for t in real_docs.text)
    assert a("x <|endoftext|> y") == b("x <|endoftext|> y")


def test_windows_hold_the_target_proportions(spark):
    rows = [(i, "red blue green " * (5 + i % 40), "a" if i % 4 else "b") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    for weights, share in ((None, None), ({"a": 1, "b": 1}, 0.5)):
        pdf = packing.pack(docs, RANKS, window_tokens=2048, weights=weights).toPandas()
        totals = pdf.groupby("source").length.sum()
        share_a = totals["a"] / totals.sum() if share is None else share
        by = pdf.groupby(["window", "source"]).length.sum().unstack(fill_value=0)
        inner = by.iloc[:-1] if weights is None else by[(by > 0).all(axis=1)].iloc[:-1]
        assert len(inner) > 5
        assert ((inner["a"] / inner.sum(axis=1) - share_a).abs() < 0.002).all()


def test_small_sources_wait_for_a_slice(spark):
    rows = [(i, "red blue green " * 50, "big") for i in range(400)] + [(1000, "tiny text " * 30, "small")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    pdf = packing.pack(docs, RANKS, window_tokens=1024, min_slice=64).toPandas()
    slices = pdf[pdf.source == "small"].groupby("window").length.sum()
    assert len(slices) <= 2 and slices.sum() == pdf[pdf.source == "small"].doc_tokens.iloc[0]


def test_awkward_rows(spark, awkward, no_docs):
    pdf = packing.pack(awkward, RANKS).toPandas()
    assert pdf.groupby("doc_id", dropna=False).length.sum().loc[3] == 2 * pdf[pdf.doc_id == 3].doc_tokens.iloc[0]
    assert pdf[pdf.doc_id == 0].length.tolist() == [1] and pdf.doc_id.isna().sum() == 1
    total = pdf.length.sum()
    assert pdf.groupby("sequence_id").length.sum().sum() == total
    assert packing.pack(no_docs, RANKS).count() == 0
