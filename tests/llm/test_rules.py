import hashlib
import re
from collections import Counter

import pytest
from brute import corpus, lower

from fluxtrace.llm import quality_rules
from fluxtrace.llm.decontaminate import DecontaminationParams, decontaminate, judge_contamination
from fluxtrace.llm.quality_rules import clean_lines, judge_quality

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute_hits(text, items, width=10):
    words = re.findall(WORD, lower(text))
    hit, named = set(), set()
    for item, content in items:
        own = re.findall(WORD, lower(content))
        windows = {tuple(own[i : i + width]) for i in range(max(1, len(own) - width + 1))} if own else set()
        for w in windows:
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i : i + len(w)]) == w:
                    named.add(item)
                    hit.update(range(i, i + len(w)))
    return words, hit, named


@pytest.mark.parametrize("most", [500_000, 0])
def test_contamination_matches_brute_force(spark, most):
    texts = corpus(40, 9)
    items = [(10, " ".join(texts[1].split()[:25])), (9, "One, two!"), (8, "né"), (7, None), (6, "..."), (5, texts[2]), (4, " ".join(texts[6].split()[2:9])), (10, "ab le 5"), (None, "leo")]
    docs = spark.createDataFrame([*enumerate(texts), (3, "leo NÉ né É one-two"), (None, "one two")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in judge_contamination(docs, bench, DecontaminationParams(most_windows=most)).collect())
    want = Counter()
    for i, t in [*enumerate(texts), (3, "leo NÉ né É one-two"), (None, "one two")]:
        words, hit, named = brute_hits(t, [x for x in items if x[0] is not None])
        ids = ",".join(sorted(map(str, named)))
        want[(i, len(words), len(hit), len(named), hashlib.sha256(ids.encode()).hexdigest(), bool(hit))] += 1
    assert got == want


def test_decontamination_removes_documents_or_spans(spark):
    docs = spark.createDataFrame([(0, "(A) b-c d! tail", 5), (1, "clean text", 6), (2, None, 7)], "doc_id long, text string, spans int")
    bench = spark.createDataFrame([(1, "b c")], "item_id long, text string")
    out = decontaminate(docs, bench)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 2]
    cut = {r.doc_id: (r.text, r.spans) for r in decontaminate(docs, bench, "spans").collect()}
    assert cut == {0: ("(A) d! tail", 5), 1: ("clean text", 6), 2: (None, 7)}
    assert decontaminate(docs.limit(0), bench).count() == 0 and decontaminate(docs, bench.limit(0)).count() == 3
    with pytest.raises(ValueError):
        decontaminate(docs, bench, "words")


def brute_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    threes = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if threes[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)


def test_rules_match_brute_force(spark):
    texts = [*corpus(50, 11), "a b c " * 30, "x\u00a0y\x1cz\x85w 😀 " * 20, "a b a b a", "#$ % <b>\n#$ % <b>\n\n", "same line\nsame line\n\nsame line "]
    rows = judge_quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows}
    assert got == {i: brute_rules(t) for i, t in enumerate(texts)}
    assert not any(r.kept and r.base_failed for r in rows)


def test_lines_are_judged_first(spark):
    clean = " ".join(f"word{i}" for i in range(80)) + "."
    noisy = " ".join(f"w{i}***" for i in range(60))
    menu = " | ".join(f"m{i}" for i in range(60))
    texts = [clean, clean + "\n" + noisy, noisy + "\n" + menu, clean + "\nAll rights reserved.", "LOUD!! " * 0 + " ".join(f"LOUD{i}!!" for i in range(60))]
    frame = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, kept int")
    rows = {r.doc_id: r for r in judge_quality(frame).collect()}
    assert [rows[i].kept for i in range(5)] == [True, False, False, True, False]
    cleaned = {r.doc_id: r.text for r in clean_lines(frame).collect()}
    assert cleaned[1] == clean and cleaned[3] == clean and cleaned[2] == ""
    assert judge_quality(frame.limit(0)).count() == 0


def test_windows_of_equal_hash_bits_do_not_hide_repeats(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "WINDOW_HASH", f"pmod({quality_rules.WINDOW_HASH}, 2)")
    texts = ["a b c d e f a b c g h a b c", "x y z " * 20, "one two", "", *corpus(10, 5)]
    rows = judge_quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_repeat_words for r in rows} == {i: brute_rules(t)[4] for i, t in enumerate(texts)}
