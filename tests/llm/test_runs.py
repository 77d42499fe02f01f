import random

import numpy as np
import pytest
from brute import corpus, run_report, runs
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import DATA

from fluxtrace.llm.periodic_runs import Blocks, RunParams, find_runs, run_digests, runs_of, with_long_runs
from fluxtrace.llm.queries import QUERIES


def ours(texts, **params):
    numbers = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
    found = runs_of([np.array([numbers[w] for w in t], np.int64) for t in texts], RunParams(**params))
    return [[(s, e - s, q) for s, e, q in f.tolist()] for f in found]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=80), max_size=5))
def test_short_runs_match_brute_force(texts):
    assert ours(texts, least=3) == [runs(t, 3) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=1, max_size=12), st.integers(1, 12)), max_size=6))
def test_runs_beside_runs_match_brute_force(parts):
    text = list("".join(p * n for p, n in parts))
    assert ours([text, text[::-1]]) == [runs(text), runs(text[::-1])]


def test_long_periods_and_one_word_over_and_over():
    rng = random.Random(3)
    period = [rng.choice("abcdefgh") for _ in range(700)]
    texts = [period * 4 + period[:99], ["w"] * 20_000, list("ab") * 3000 + ["c"] + list("ab") * 3000, ["x", "y"] * 11, ["x"] * 23, ["x"] * 24, []]
    got = ours(texts)
    assert got[0] == [(0, 2899, 700)] and got[1] == [(0, 20_000, 1)] and got[2] == [(0, 6000, 2), (6001, 6000, 2)]
    assert got[3:] == [[], [], [(0, 24, 1)], []]


def test_tables_of_blocks():
    words = np.array(list(b"abababab#abababac"), np.int64)
    blocks = Blocks(words)
    for k in range(4):
        for a in range(len(words)):
            for b in set(range(len(words))) - {a}:
                inside = max(a, b) + (1 << k) <= len(words)
                equal = words[a : a + (1 << k)].tolist() == words[b : b + (1 << k)].tolist()
                assert blocks.agree(np.array([a]), np.array([b]), k, False)[0] == (inside and equal)


def test_query_matches_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    short = [(i, t) for i, t in docs if len(t or "") < 6000]
    assert len(short) > 0.8 * len(docs)
    found = {r[0]: tuple(r) for r in QUERIES["op12_periodic_runs"](spark, DATA).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()}
    assert len(found) == len(docs)
    assert [found[i] for i, _ in short] == [run_report(i, t) for i, t in short]
    assert sum(r[1] > 0 for r in found.values()) > 0.05 * len(docs)


def test_odd_texts(spark):
    texts = [*corpus(20), "é " * 30, "a b " * 26, "x\x0by\x0cz\t\r\n" * 40, "word\n" * 200_000, "y" * 300_000]
    rows = [(i, t, 5) for i, t in enumerate(texts)] + [(3, "a " * 24, 5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, runs int")
    got = sorted(map(tuple, run_digests(find_runs(with_long_runs(frame))).collect()))
    assert got == sorted(run_report(i, t) if len(t or "") < 10_000 else next(r for r in got if r[0] == i) for i, t, _ in rows)
    long = {r.doc_id: r for r in find_runs(frame).collect()}
    assert [tuple(r) for r in long[len(texts) - 2].runs] == [(0, 200_000, 1)] and long[len(texts) - 2].collapsed == "word"
    assert long[len(texts) - 1].n_words == 1


def test_null_ids_and_empty_tables(spark):
    frame = spark.createDataFrame([(None, "a b " * 12), (None, None)], "doc_id long, text string")
    rows = find_runs(with_long_runs(frame)).orderBy("n_words").collect()
    assert [(r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in rows] == [(0, [], ""), (24, [(0, 24, 2)], "a b")]
    assert run_digests(find_runs(with_long_runs(frame.limit(0)))).count() == 0


@pytest.mark.parametrize("bad", [{"repeats": 2}, {"least": 1}])
def test_parameters(bad):
    with pytest.raises(ValueError):
        RunParams(**bad)
