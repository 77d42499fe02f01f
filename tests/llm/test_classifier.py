import random

import numpy as np
import pyarrow as pa
from oracle import DATA
from pyspark.sql import functions as F

from fluxtrace.llm.quality_classifier import CoTrainingParams, keep_good, score_quality, text_view, train
from fluxtrace.llm.sampled import least_by_hash


def made(n, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.randint(20, 60))]
        text = " ".join(words).capitalize() + "." if good else " ".join(w.upper() + "!!" for w in words)
        rows.append((i, text, rng.choice(["en", None]), "good" if good and rng.random() < 0.9 else "mixed", len(text)))
        labels.append((i, int(good), 0))
    return rows, labels


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_held_out_accuracy(spark):
    rows, labels = made(400)
    docs = spark.createDataFrame(rows, SCHEMA)
    out = {r.doc_id: r for r in score_quality(docs, spark.createDataFrame(labels[:200], "doc_id long, quality int, toxic int")).collect()}
    right = sum(out[i].kept == bool(q) for i, q, _ in labels[200:])
    assert right >= 195
    assert all(0 <= out[i].p_quality <= 1 for i in out)


def test_driver_documents(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r.doc_id for r in keep_good(docs, labels).collect()}
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    assert len(good & kept) >= 0.97 * len(good)


def test_edge_cases(spark):
    rows, labels = made(40)
    rows += [(None, None, None, None, None), (100, "", "en", "", 0), (0, rows[0][1], "en", "good", 3)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as kept", "2 as p_text", "3 as quality")
    marks = spark.createDataFrame([*labels, (None, 1, 0), (3, None, 1), (5, 7, 0), (0, 1, 0)], "doc_id long, quality int, toxic int")
    assert score_quality(docs, marks).count() == len(rows)
    out = keep_good(docs, marks, CoTrainingParams(pool=0))
    assert out.columns == docs.columns and 0 < out.count() <= len(rows)
    assert score_quality(docs.limit(0), marks).count() == 0 and keep_good(docs.limit(0), marks).count() == 0
    one_kind = marks.where("quality = 1")
    assert keep_good(docs, one_kind).count() == len(rows)
    for none in (marks.limit(0), marks.selectExpr("doc_id + 10000 as doc_id", "quality", "toxic")):
        assert {(r.p_text, r.p_meta, r.p_quality, r.kept) for r in score_quality(docs, none).collect()} == {(0.5, 0.5, 0.5, True)}
        assert keep_good(docs, none).count() == len(rows)


def test_all_unlabelled_documents_are_scored_each_round(spark):
    rows, labels = made(400)
    rows.append((None, rows[7][1], "en", "good", 5))
    docs = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame(labels[:100], "doc_id long, quality int, toxic int")
    first = [x for x in train(docs, marks, CoTrainingParams(pool=9)).exchange if x.round == 0]
    assert [x.unlabelled for x in first] == [301, 301]
    assert all(x.seen <= 3 for x in first) and max(x.good + x.bad for x in first) > 9


def test_both_views_hand_over_new_documents_each_round(spark):
    rows, labels = made(400)
    marks = spark.createDataFrame(labels[:100], "doc_id long, quality int, toxic int")
    exchange = train(spark.createDataFrame(rows, SCHEMA), marks, CoTrainingParams()).exchange
    for giver in ("text", "meta"):
        own = [x for x in exchange if x.giver == giver]
        assert [x.round for x in own] == [0, 1, 2] and all(x.good and x.bad and x.seen for x in own)
        assert all(b.unlabelled == a.unlabelled - a.good - a.bad for a, b in zip(own, own[1:], strict=False))


def brute_view(text, buckets):
    raw = (text or "").encode()
    n, words = max(1, len(raw)), max(1, len(raw.split()))
    per_byte = [sum(65 <= b <= 90 for b in raw), sum(48 <= b <= 57 for b in raw), sum(b >= 128 for b in raw), raw.count(b"\n")]
    per_word = [sum(b in group for b in raw) for group in (b"!", b"|", b"#*$%&<>", b".,;:?", b"@/_=")]
    grams = [0] * buckets
    for a, b in zip(raw, raw[1:], strict=False):
        grams[((a * 0x9E3779B1 + b * 0x85EBCA77) >> 7) % buckets] += 1
    return [x / n for x in per_byte] + [min(3, x / words) for x in per_word] + [min(3, n / words / 10), np.log1p(len(raw)) / 10], [(g / n) ** 0.5 for g in grams]


def test_features_match_plain_ones_whatever_stands_beside():
    texts = ["Ab c! d", "", None, "x", " lead", "ünï |#\n\tcode 12", "tail ", "word " * 40_000]
    whole = np.concatenate([rows for _, rows in text_view(pa.array(texts), 64)])
    for i, t in enumerate(texts):
        shapes, grams = brute_view(t, 64)
        assert np.allclose(whole[i, :11], shapes, atol=1e-6) and np.allclose(whole[i, 12:], grams, atol=1e-6)
        assert np.array_equal(whole[i], next(text_view(pa.array([t], pa.string()), 64))[1][0])
    assert whole[-1, 11] > 0.9


def test_samples_are_those_of_least_hash(spark):
    rows = spark.range(20_000).withColumn("h", F.xxhash64("id"))
    want = [r.id for r in rows.orderBy("h").limit(50).collect()]
    assert [r.id for r in least_by_hash(rows, "id", 50).collect()] == want == [r.id for r in least_by_hash(rows, "h", 50, hashed=True).collect()]


def test_repeated_labelled_rows_count_once(spark):
    rows, labels = made(60)
    docs = spark.createDataFrame(rows + [rows[0]] * 300 + [(1, "X" * 3_000_000, "en", "good", 3_000_000)], SCHEMA)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = score_quality(docs, marks).collect()
    assert len(out) == 361 and len({tuple(r) for r in out if r.doc_id == 0}) == 1
