import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from brute import corpus
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from fluxtrace.llm import bpe, pretokenize, token_counts, token_files
from fluxtrace.llm.cache import Generations

SPLIT = regex.compile(public_tokenizers.PATTERN)
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.RANKS, "rb"))}
PUBLIC = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ODD = ["", None, "'s't''re 've'll'd'm I'S", "a  b\n\n c \t", "   ", "1²Ⅷ٣", "日本語テキスト", "e\u0301 \u00a0\u3000x\x1cy", "😀" * 50, "=" * 4000, "x" * 3000, "<|endoftext|>", " \n x"]


def split(texts):
    raw = [t.encode() for t in texts]
    pieces, rows, _ = pretokenize.pieces_of(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    return [pieces[a:b] for a, b in zip(rows, rows[1:], strict=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("'stmdrevl aé1 \n\t!?\u00a0\u3000日😀")), max_size=30), max_size=8))
def test_boundaries_match_the_pattern(texts):
    assert split(texts) == [SPLIT.findall(t) for t in texts]


def test_long_scan_matches_the_pattern():
    rng = random.Random(1)
    text = "".join(rng.choice("'s re ll\n aé12!? ") for _ in range(40_000))
    assert split([text]) == [SPLIT.findall(text)]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_ids_match_the_library(text):
    with bpe.merger(bpe.RANKS) as merger:
        (_, ids, _, _), = bpe.encoded(pa.array([text]), merger)
    assert np.frombuffer(ids[0], "<u4").tolist() == PUBLIC.encode_ordinary(text)


@pytest.mark.parametrize("around", ["a{}a", "1{}1", "!{} "])
def test_every_code_point_is_split_as_in_the_libraries(around):
    """A code point's ids among letters, numbers and symbols are the one library's, its borders also the other's."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(around.format(c) for c in points[i : i + 4096]) for i in range(0, len(points), 4096)]
    theirs = PUBLIC.encode_ordinary_batch(texts)
    with bpe.merger(bpe.RANKS) as merger:
        ours = [np.frombuffer(x, "<u4").tolist() for _, ids, _, _ in bpe.encoded(pa.array(texts), merger) for x in ids]
    assert ours == theirs
    splitter = pre_tokenizers.ByteLevel(add_prefix_space=False)
    assert split(texts) == [[t[a:b] for _, (a, b) in splitter.pre_tokenize_str(t)] for t in texts]


def test_null_and_repeated_ids_and_very_long_texts(spark):
    long = "Ünd so weiter, " * 200_000
    docs = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (1, "c"), (2, long), (3, "x" * 300_000)], "doc_id long, text string")
    got = Counter((r.doc_id, r.n_tokens) for r in bpe.round_trip(docs).collect())
    assert got == Counter((i, len(PUBLIC.encode_ordinary(t))) for i, t in [(None, "a b"), (1, "a b"), (1, "a b"), (1, "c"), (2, long), (3, "x" * 300_000)])


def test_a_task_leaves_no_cache():
    with bpe.merger(bpe.RANKS) as merger:
        assert merger["some"] and merger.decode_pieces(merger["some"], [0]) == [b"some"] and len(merger) == 1
    assert not merger


def test_round_trip(spark):
    texts = corpus(20, 2) + ODD
    docs = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    rows = {r.doc_id: r for r in bpe.round_trip(docs).collect()}
    for i, t in enumerate(texts):
        ids = PUBLIC.encode_ordinary(t or "")
        assert (rows[i].n_tokens, rows[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    tokens = bpe.encode(docs)
    back = {r.doc_id: r.text for r in bpe.decode(tokens).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    spans = sorted((r.doc_id, r.piece, r.start, r.text) for r in bpe.decode_pieces(tokens).collect())
    assert spans == [(i, k, m.start(), m[0]) for i, t in enumerate(texts) for k, m in enumerate(SPLIT.finditer(t or ""))]
    first = {r.doc_id: r.piece_starts for r in tokens.collect()}
    assert all(first[i] == [m.start() for m in SPLIT.finditer(t or "")] for i, t in enumerate(texts))
    assert bpe.round_trip(docs.limit(0)).count() == 0


def test_token_files(spark, tmp_path):
    texts = corpus(40, 6) + ODD
    rng = random.Random(4)
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    p = token_files.TokenFileParams(sequence=16, batch=8)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    manifest = spark.createDataFrame(token_files.write_token_files(docs, str(tmp_path / "f"), p).collect(), "part int, uri string, n_docs long, n_tokens long")
    library, stream, want = Tokenizer.from_file(p.tokenizer), [], {}
    for i, t in sorted(rows):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, p.end_id]
        want[i] = (len(stream), len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        stream += ids
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(spark, manifest).collect()}
    assert got == want
    together = []
    for row in manifest.orderBy("part").collect():
        file = token_files.TokenFile(row.uri)
        last = -(-row.n_tokens // p.sequence) - 1
        for k in range(last + 1):
            ids, mask = file.sequence(k)
            assert len(ids) == p.sequence and (mask.all() or k == last)
            together += ids[mask].tolist()
        assert np.concatenate(list(file.slice(0, row.n_tokens))).tolist() == together[-row.n_tokens :]
    assert together == stream
    assert token_files.token_digests(docs.limit(0)).count() == 0


def unigram(pieces):
    low = min(s for _, s in pieces)
    return Tokenizer(models.Unigram([("<unk>", 0.0), *pieces, *((f"<0x{i:02X}>", low) for i in range(256))], 0, True))


def test_counts_match_the_library_on_ties():
    rng = random.Random(8)
    names = {"".join(rng.choice("ab▁") for _ in range(rng.randint(1, 4))) for _ in range(40)}
    pieces = sorted((n, float(-rng.randint(1, 3) * len(n))) for n in names if "▁" not in n.lstrip("▁")) + [("▁", -9.0)]
    pieces = list(dict(pieces).items())
    ours, theirs = token_counts.ViterbiCounter(pieces), unigram(pieces)
    for _ in range(400):
        text = "".join(rng.choice("ab c\n") for _ in range(rng.randint(0, 25)))
        assert ours.count(text) == (len(theirs.encode("▁" + text.replace(" ", "▁")).ids) if text else 0), text


def test_counts(spark):
    texts = corpus(20, 3) + [t for t in ODD if t != "<|endoftext|>"]
    theirs = unigram(token_counts.normal_pieces(token_counts.VOCABULARY))
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs).collect()}
    assert got == {i: len(theirs.encode("▁" + t.replace(" ", "▁")).ids) if t else 0 for i, t in enumerate(texts)}


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        token_files.PieceEncoder(public_tokenizers.path("word_bpe_49k.json"))


def test_added_tokens_in_texts_match_the_plain_library_call():
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endof", "text|>", "plain words", "<|endoftext|><|endoftext|>\nx", None, "", "é<|endoftext|>é"]
    library = Tokenizer.from_file(token_files.TOKENIZER)
    coder = token_files.PieceEncoder(token_files.TOKENIZER)
    got = [x for _, ids in coder.rows(pa.array(texts)) for x in ids]
    assert [np.frombuffer(x, coder.dtype).tolist() for x in got] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_token_files_take_null_and_repeated_ids_and_clashing_names(spark):
    long = "very Long text, 1 " * 100_000
    rows = [(2, "b", 1), (None, "a <|endoftext|>", 2), (2, "b", 3), (2, None, 4), (None, "a <|endoftext|>", 5), (9, long, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int").selectExpr("*", "1 as start", "2 as n_tokens", "3 as tie", "4 as uri")
    library = Tokenizer.from_file(token_files.TOKENIZER)
    got = token_files.token_digests(docs).collect()
    want = Counter((i, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, _ in rows)
    assert Counter((r.doc_id, r.n_tokens) for r in got) == want
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == [sum(r.n_tokens for r in ordered[:i]) for i in range(len(ordered))]
    assert [r.doc_id for r in ordered] == [None, None, 2, 2, 2, 9]


def test_caches_keep_what_is_in_use_within_their_bytes():
    cache = Generations(1000)
    cache.make = lambda key: key.upper().encode()
    for n in range(50):
        assert cache["often"] == b"OFTEN" and cache[f"k{n}"] == f"K{n}".encode()
    assert len(cache) + len(cache.older) <= 8 and "often" in {*cache, *cache.older}
    cache["x" * 5000]
    assert "x" * 5000 not in cache and cache.recall("nothing") is None
    cache.forget()
    assert not cache and not cache.older


def test_entries_kept_together_stay_within_the_bytes():
    """As if kept one by one: both generations bounded, the older one's entries come back."""
    together, single = Generations(20_000), Generations(20_000)
    for start in range(0, 600, 20):
        entries = {f"k{i}": bytes(8) for i in range(start, start + 20)}
        together.keep_all(entries)
        for key, value in entries.items():
            single.keep(key, value)
        assert together.held <= 10_000 and together.keys() == single.keys() and together.older.keys() == single.older.keys()
    old = list(together.older)[:5]
    assert together.recall_all([*old, "nothing"]) == dict.fromkeys(old, bytes(8)) and {*old} <= together.keys() | together.older.keys()
    together.keep_all({f"x{i}": bytes(8) for i in range(500)})  # more than a generation
    assert together.held <= 10_000 and "x499" in together
    assert len(together.keys() | together.older.keys()) < 160
