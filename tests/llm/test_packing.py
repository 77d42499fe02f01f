import re
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest
from brute import corpus
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import DATA
from tokenizers import Tokenizer

from fluxtrace.llm import packing
from fluxtrace.llm.packing import PackingParams, binary_lengths, pack, piece_digests, read_bucket, write_buckets
from fluxtrace.llm.queries import QUERIES

PLAIN = Tokenizer.from_file(packing.TOKENIZER)
ODD = ["", None, "It's  we'LL don't", "é ́x ΣΑΣ İ", "日本語テキスト 1²Ⅷ٣", "a<|endoftext|>b <|startoftext|>", "\x1c\x85  x\x0b", "😀" * 50, "x" * 5000, "=- " * 9000]


def plain(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, 2]


def checked(pieces, texts):
    """Pieces rebuild each document; lengths are binary; each sequence is one piece."""
    by_doc = {}
    for r in pieces:
        by_doc.setdefault(r.doc_id, []).append(r)
        assert r.length & (r.length - 1) == 0 and r.length <= 4096 and r.offset == 0 and r.sequence_id >> 58 == r.length.bit_length() - 1
    assert len({r.sequence_id for r in pieces}) == len(pieces)
    assert by_doc.keys() == texts.keys()
    for doc, text in texts.items():
        ids, own = plain(text), sorted(by_doc[doc], key=lambda r: r.start)
        assert [r.length for r in own] == binary_lengths(len(ids), 4096) and own[0].doc_tokens == len(ids)
        for r in own:
            raw = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(raw) if hasattr(r, "ids_crc32") else bytes(r.ids) == raw


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_match_the_library(text):
    with packing.encoder(packing.TOKENIZER) as coder:
        assert np.frombuffer(b"".join(coder._ids([c.decode() for c in text.encode().split()])), "<u4").tolist() == plain(text)[:-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("'sTtreLd aé1À×÷ÿß–“9!?<|\u0301\u00ad日")), max_size=12), max_size=8))
def test_chunks_of_plain_characters_match_the_library(texts):
    with packing.encoder(packing.TOKENIZER) as coder:
        ours = [np.frombuffer(x, "<u4").tolist() for _, rows in coder.rows(pa.array(texts, pa.string())) for x in rows]
    assert ours == [plain(t)[:-1] for t in texts]


def test_all_plain_characters_match_the_library():
    points = [chr(c) for c in range(0x2100) if packing.ChunkEncoder.PLAIN.fullmatch(chr(c))]
    texts = [f"{x}{a}{b}{y}" for a in points for b in ("a", "É", "7", "'", "s") for x, y in (("", ""), ("b", "'re"))]
    coder = packing.ChunkEncoder(packing.TOKENIZER)
    assert len(points) > 150
    assert [np.frombuffer(x, "<u4").tolist() for _, rows in coder.rows(pa.array(texts)) for x in rows] == [plain(t)[:-1] for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("'sTtreVvLlMmDd aÉ×÷ÿß–“90!?<|\t\x0b")), max_size=16))
def test_spaces_part_the_words_that_the_pattern_finds(text):
    letters = "a-zß-öø-ÿ"
    pattern = packing.WORDS.replace(r"[\p{L}]", f"[{letters}]").replace(r"[\p{N}]", "[0-9]").replace(r"[^\s\p{L}\p{N}]", rf"[^\s{letters}0-9]")
    with packing.encoder(packing.TOKENIZER) as coder:
        assert coder.words(text) == re.findall(pattern, text.lower())


def test_new_words_cost_no_python_calls_of_their_own():
    coder, calls = packing.ChunkEncoder(packing.TOKENIZER), []
    text = " ".join(f"ab{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}é{chr(97 + i // 676)}" for i in range(3000))
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event == "call" else None)
    try:
        found = list(coder.rows(pa.array([text, text])))
    finally:
        sys.setprofile(None)
    assert [np.frombuffer(x, "<u4").tolist() for _, rows in found for x in rows] == [plain(text)[:-1]] * 2
    assert len(coder) == 3000 and len(calls) < 300


def test_query_matches_the_library(spark):
    texts = dict(map(tuple, spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()))
    checked(QUERIES["op13_packing"](spark, DATA).collect(), texts)


def test_odd_texts_and_columns(spark):
    texts = dict(enumerate([*ODD, *corpus(20)]))
    frame = spark.createDataFrame([(i, t, 1, b"") for i, t in texts.items()], "doc_id long, text string, length int, ids binary")
    checked(pack(frame).collect(), texts)
    checked(piece_digests(pack(frame.repartition(3))).collect(), texts)


def test_buckets(spark, tmp_path):
    texts = dict(enumerate(corpus(40)))
    write_buckets(pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string")), str(tmp_path / "b"))
    whole = spark.read.parquet(str(tmp_path / "b")).collect()
    assert sum(read_bucket(spark, str(tmp_path / "b"), 1 << k).count() for k in range(13)) == len(whole)
    assert all(len(r.ids) == 4 * 64 for r in read_bucket(spark, str(tmp_path / "b"), 64).collect())


def test_null_and_repeated_ids_and_empty_tables(spark):
    rows = pack(spark.createDataFrame([(None, "a"), (1, None), (1, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows) == [(0, 2), (1, 1), (1, 1)]
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        pack(spark.range(1), PackingParams(most=1000))


def test_small_caches_change_nothing():
    coder = packing.ChunkEncoder(packing.TOKENIZER, most=2000)
    texts = corpus(30)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for _, rows in coder.rows(pa.array(texts)) for x in rows] == [plain(t)[:-1] for t in texts]


@settings(deadline=None)
@given(st.integers(1, 10**6), st.integers(0, 12))
def test_binary_lengths(n, k):
    found = binary_lengths(n, 1 << k)
    assert sum(found) == n and found == sorted(found, reverse=True) and max(found) <= 1 << k and len([x for x in found if x < 1 << k]) == len({x for x in found if x < 1 << k})
