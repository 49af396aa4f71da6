"""Addressable codes: round trips, random access, and encoding in pieces."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quantmere.llm import token_store as T
from quantmere.llm.queries import tokenizer_path


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 70000), max_size=1200))
def test_round_trip_and_random_access(ids):
    arr = np.array(ids, np.uint32)
    cut = sorted({0, len(ids) // 3, len(ids)})
    f = T.TokenFile(T.encode_file([5] * (len(cut) - 1), np.array(cut), arr))
    assert f.slice(0, len(ids)).tolist() == ids
    for i in range(0, len(ids), 97):
        assert f[i] == ids[i]
    if len(ids) > 10:
        assert f.slice(3, len(ids) - 2).tolist() == ids[3:-2]
    with pytest.raises(IndexError):
        f[len(ids)]


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 16), st.lists(st.integers(0, 65535), max_size=400), st.data())
def test_packing(width, values, data):
    arr = np.array(values, np.uint32) & np.uint32((1 << width) - 1)
    old, T.RUN = T.RUN, 128
    try:
        packed = np.frombuffer(T.pack(arr, width), np.uint8)
        start = data.draw(st.integers(0, len(arr)))
        stop = data.draw(st.integers(start, len(arr)))
        assert T.unpack(packed, width, start, stop).tolist() == arr[start:stop].tolist()
        assert [T.unpack_one(packed, width, i) for i in range(start, stop)] == arr[start:stop].tolist()
    finally:
        T.RUN = old


def test_widths_are_best_of_all():
    ids = np.array([1] * 90 + [40000] * 10, np.uint32)
    w = T.chunk_widths(ids)
    cost = lambda ws: sum((ids >> sum(ws[:k]) > 0).sum() * (x + (k < len(ws) - 1)) if k else len(ids) * (x + (len(ws) > 1)) for k, x in enumerate(ws))
    assert sum(w) == 16 and cost(w) <= min(cost([8, 8]), cost([16]), cost([4, 12]))


TEXTS = ["", " ", "a  b", "x\n y", "don't stop", "a\n\nb c", "tab\t x", "naïve café.", "  lead", "trail  ", "<|endoftext|> a", "日本 語", "1,234.5 ok!?", "a b  c", "x\x1c y", "end.\nNext word."]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from([*"ab Zé.,'!\n\t 1日 \x1c|<>", "endoftext", "<|endoftext|>", " the", "  "]), max_size=40).map("".join))
def test_pieces_encode_like_the_whole(text):
    _check([text])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"ab é.\n日 ", " word", " x,", "  "]), max_size=60).map("".join), max_size=6))
def test_long_texts_and_full_caches(texts):
    old = T.CALL_BYTES, T.KNOWN, T._parts.__defaults__
    T.CALL_BYTES, T.KNOWN, T._parts.__defaults__ = 20, 4, (8,)
    T._TOKENIZERS.clear()
    try:
        _check([*texts, "".join(texts)])
        _check(texts[::-1])
    finally:
        T.CALL_BYTES, T.KNOWN, T._parts.__defaults__ = old
        T._TOKENIZERS.clear()


def _check(texts):
    tok = T.load_tokenizer(tokenizer_path()).whole
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(b, "<u4").tolist() for b in T.encode_texts(texts, tokenizer_path())] == want


def test_known_texts():
    _check(TEXTS)


def test_table(spark):
    rows = [(7, "hello world"), (3, None), (None, "x"), (7, "hello world"), (5, "word " * 3000)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, path string")
    out = T.token_table(docs, tokenizer_path(), end_id=2, file_tokens=50).orderBy("start").collect()
    assert [r.doc_id for r in out] == [None, 3, 5, 7, 7]
    tok = T.load_tokenizer(tokenizer_path()).whole
    at = 0
    for r, text in zip(out, ["x", "", "word " * 3000, "hello world", "hello world"], strict=True):
        ids = tok.encode(text, add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert T.token_table(docs.limit(0), tokenizer_path()).count() == 0
