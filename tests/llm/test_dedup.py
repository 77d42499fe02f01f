import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from brute import SPACES, components, corpus, shingles, similar

from fluxtrace.llm import components as link_components
from fluxtrace.llm import line_dedup, lsh, skew
from fluxtrace.llm.components import connected_components
from fluxtrace.llm.line_dedup import LineDedupParams, line_report, without_duplicate_lines
from fluxtrace.llm.near_dedup import drop_near_duplicates, near_duplicates
from fluxtrace.llm.superminhash import EMPTY, SuperMinHash
from fluxtrace.llm.textbuf import mix64
from fluxtrace.llm.workspace import Workspace


def docs_of(spark, texts, extra=()):
    return spark.createDataFrame([*enumerate(texts), *extra], "doc_id long, text string")


@pytest.mark.parametrize("block", [192, 3])
def test_near_duplicates_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lsh, "BLOCK", block)
    monkeypatch.setattr(lsh, "SKETCH_BLOCK", block)
    texts = corpus(90)
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    want = components(sets, similar({i: s for i, s in sets.items() if s}, 75))
    rows = {r.doc_id: r for r in near_duplicates(docs_of(spark, texts)).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in rows.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    assert len(set(want.values())) < len(texts)


def test_chain_of_near_copies_joins_whole(spark):
    rng = random.Random(3)
    text = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    chain = []
    for _ in range(12):
        chain.append(" ".join(text))
        for _ in range(3):
            text[rng.randrange(200)] = f"w{rng.randrange(10**6)}"
    sets = {i: shingles(t) for i, t in enumerate(chain)}
    want = components(sets, similar(sets, 75))
    assert {r.doc_id: r.component_id for r in near_duplicates(docs_of(spark, chain)).collect()} == want


def template_cluster(n, words, changed, seed):
    """Copies of one text, each with its own changes, in runs of words so that few shingles go."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        text, at = list(base), rng.randrange(words - changed)
        text[at : at + changed] = [f"x{rng.randrange(10**6)}" for _ in range(changed)]
        out.append(" ".join(text))
    return out


def test_doubling_a_cluster_doubles_its_member_pairs(spark, monkeypatch):
    """A cluster of near copies that ends as one component leaves nothing to the pairs of blocks."""
    met = []
    plain = lsh._meetings
    monkeypatch.setattr(lsh, "_meetings", lambda members, *rest: (met.append(members.count()), plain(members, *rest))[1])
    for n in (150, 300):
        rows = near_duplicates(docs_of(spark, template_cluster(n, 300, 5, n))).collect()
        assert {r.component_id for r in rows} == {0}
    assert not any(met)


@pytest.mark.parametrize("changed", [18, 24])
def test_loose_clusters_in_hot_buckets_match_brute_force(spark, monkeypatch, changed):
    """Centres miss part of such a cluster: further rounds, salted parts and blocks find the rest."""
    for name, value in {"LEAVES": 4, "SKETCH_BLOCK": 6, "BLOCK": 4}.items():
        monkeypatch.setattr(lsh, name, value)
    for name, value in {"LEAST": 10, "SHARE": 10**9, "SALTS": 3}.items():
        monkeypatch.setattr(skew, name, value)
    texts = template_cluster(60, 200, changed, changed) + template_cluster(20, 200, 3, 5) + corpus(20, 8)
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    want = components(sets, similar({i: s for i, s in sets.items() if s}, 75))
    got = {r.doc_id: r.component_id for r in near_duplicates(docs_of(spark, texts)).collect()}
    assert got == want and len(set(want.values())) < len(texts)


def test_near_duplicates_edge_cases(spark):
    rows = near_duplicates(docs_of(spark, ["a b c d e f", "A b\tc D e f", "", None], [(None, "a b c d e f"), (1, "A b\tc D e f")])).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in rows) == Counter([(0, 0, True), (1, 0, False), (1, 0, False), (2, 2, True), (3, 3, True), (None, None, True)])
    assert near_duplicates(docs_of(spark, [])).count() == 0
    clash = docs_of(spark, ["a b", "a b"]).selectExpr("*", "1 as component_id", "2 as kept", "3 as node", "'x' as elements")
    assert near_duplicates(clash).count() == 2
    kept = drop_near_duplicates(clash)
    assert kept.columns == clash.columns and [r.doc_id for r in kept.collect()] == [0]


@pytest.mark.parametrize("least", [20_000, 5])
def test_a_set_on_nine_rows_of_ten_is_split(spark, monkeypatch, least):
    monkeypatch.setattr(skew, "LEAST", least)
    copy = "one and the same text on nearly all rows"
    texts = [*[copy] * 90, *["", None, " \n"] * 2, *corpus(4)]
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    want = components(sets, similar({i: s for i, s in sets.items() if s}, 75))
    found = near_duplicates(docs_of(spark, texts, [(None, copy)] * 3))
    assert Counter((r.doc_id, r.component_id) for r in found.collect()) == Counter([*want.items(), *[(None, None)] * 3])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert ("salt" in plan) == (least == 5)
    kept = drop_near_duplicates(docs_of(spark, texts, [(None, copy)] * 3)).collect()
    assert Counter(r.doc_id for r in kept) == Counter([*(i for i in want if want[i] == i), *[None] * 3])


def similar_pairs(n, size, width, low, high, seed, word, glue):
    """2n texts of tokens, and for each i the texts 2i and 2i + 1 differ in one run of tokens, at similarities from low to high."""
    rng, out = random.Random(seed), []
    for i in range(n):
        share = low + (high - low) * i / n
        base = [word(rng) for _ in range(size)]
        # A changed run of k tokens costs k + width - 1 of each side's shingles.
        lost = int(size * (1 - share) / (1 + share))
        k = max(1, lost - width + 1)
        out += [base, [*base[:7], *(word(rng) for _ in range(k)), *base[7 + k :]]]
    return [glue.join(t) for t in out]


def test_recall_between_75_and_85_percent(spark):
    """The measured share of linked pairs just above the threshold: all of the documents, 99 % of the lines."""
    texts = similar_pairs(300, 150, 5, 0.74, 0.85, 11, lambda rng: f"w{rng.randrange(10**6)}", " ")
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    linked = [i for i in range(0, len(texts), 2) if 75 * len(sets[i] | sets[i + 1]) <= 100 * len(sets[i] & sets[i + 1])]
    assert len(linked) > 200 and any(100 * len(sets[i] & sets[i + 1]) < 78 * len(sets[i] | sets[i + 1]) for i in linked)
    got = {r.doc_id for r in near_duplicates(docs_of(spark, texts)).where("not kept").collect()}
    assert got == {i + 1 for i in linked}

    lines = similar_pairs(400, 150, 8, 0.74, 0.85, 12, lambda rng: rng.choice("abcdefghijklmnopqrstuvwxyz"), "")
    sets = {i: {t[k : k + 8] for k in range(len(t) - 7)} for i, t in enumerate(lines)}
    linked = {i + 1 for i in range(0, len(lines), 2) if 75 * len(sets[i] | sets[i + 1]) <= 100 * len(sets[i] & sets[i + 1])}
    got = {r.doc_id for r in line_report(docs_of(spark, lines)).where("n_dropped > 0").collect()}
    assert got <= linked and len(linked) > 200 and len(got) >= 0.99 * len(linked)


def test_signatures_estimate_similarity():
    hasher, rng = SuperMinHash(256), np.random.default_rng(5)
    for size, share in ((3, 0.5), (400, 0.75), (400, 0.3), (5000, 0.6)):
        found = []
        for _ in range(20):
            common = round(2 * size * share / (1 + share))
            x = mix64(rng.integers(0, 2**63, 2 * size - common, dtype=np.uint64))
            a, b = x[:size], x[size - common :]
            s = hasher.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            assert (s != EMPTY).all()
            found.append((s[0] == s[1]).mean())
        true = common / (2 * size - common)
        assert abs(np.mean(found) - true) < 0.05
    assert (hasher.signatures(np.zeros(0, np.uint64), np.array([0, 0])) == EMPTY).all()


@pytest.mark.parametrize("least", [20_000, 2])
def test_components_of_random_graphs(spark, monkeypatch, least):
    """Also where every node of over two links is hot, and each task holds few links."""
    monkeypatch.setattr(skew, "LEAST", least)
    monkeypatch.setattr(link_components, "LOCAL_LINKS", 20_000 if least > 2 else 40)
    rng = random.Random(2)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 260)] + [(300, i) for i in range(301, 400)] + [(5, 5)]
    frame = spark.createDataFrame([*links, (None, 3)], "a long, b long").repartition(7)
    got = {r.node: r.component for r in connected_components(frame, Workspace(spark, "t")).collect()}
    want = components({x for p in links for x in p}, links)
    loops = {x for x in want if not any(x in p and p[0] != p[1] for p in links)}
    assert got == {n: c for n, c in want.items() if n not in loops}
    assert connected_components(frame.limit(0), Workspace(spark, "t")).count() == 0


def brute_lines(texts, width, percent):
    lines = [(i, k, line) for i, t in enumerate(texts) if t for k, line in enumerate(t.split("\n")) if line.strip(SPACES)]
    keys = sorted({line for *_, line in lines})
    sets = {n: {k[i : i + width] for i in range(len(k) - width + 1)} or {k} for n, k in enumerate(keys)}
    comp = components(sets, similar(sets, percent))
    first, number = {}, {k: n for n, k in enumerate(keys)}
    for i, k, line in lines:
        first.setdefault(comp[number[line]], (i, k))
    gone = {i: [] for i in range(len(texts))}
    for i, k, line in lines:
        if first[comp[number[line]]] != (i, k):
            gone[i].append(k)
    return gone


@pytest.mark.parametrize("least", [20_000, 5])
def test_lines_match_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(skew, "LEAST", least)
    texts = corpus(70, 4)
    p = LineDedupParams()
    want = brute_lines(texts, p.width, p.percent)
    rows = {r.doc_id: r for r in line_report(docs_of(spark, texts)).collect()}
    assert {i: r.dropped for i, r in rows.items()} == want
    for i, t in enumerate(texts):
        assert rows[i].text == (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in want[i]))
    assert sum(map(len, want.values())) > 20


def test_lines_edge_cases(spark):
    texts = ["same line here\n\nsame line here", "same line here\n ", None, "", "añb\nañb"]
    rows = line_report(docs_of(spark, texts, [(None, "same line here"), (1, "other\nsame line here")])).collect()
    got = Counter((r.doc_id, r.n_lines, tuple(r.dropped), r.text) for r in rows)
    assert got == Counter([(0, 3, (2,), "same line here\n"), (1, 2, (0,), " "), (2, 0, (), None), (3, 1, (), ""), (4, 2, (1,), "añb"), (None, 1, (), "same line here"), (1, 2, (1,), "other")])
    assert line_report(docs_of(spark, [])).count() == 0
    clash = docs_of(spark, ["x y", "x y"]).selectExpr("*", "1 as doc", "2 as dropped", "3 as row_key", "4 as lines")
    out = without_duplicate_lines(clash)
    assert out.columns == clash.columns and sorted((r.doc_id, r.text, r.dropped) for r in out.collect()) == [(0, "x y", 2), (1, "", 2)]


def test_sketch_cut_of_lines_keeps_its_bound():
    beyond = sum(math.comb(64, k) * 7 ** (64 - k) for k in range(LineDedupParams().far_bits + 1, 65)) / 8**64
    assert beyond < 1e-7


def test_sets_and_their_overlaps_match_plain_ones():
    texts = ["", "a", "abc", "hello hello hello", "äöü ÄÖÜ äöü ÄÖÜ äöü", "x" * 500, "", "the cat sat on the mat", ""]
    unpack = line_dedup._line_sets(8)
    sets = unpack(pa.array(texts))
    for text, found in zip(texts, sets, strict=True):
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        assert np.array_equal(found, np.unique(line_dedup._shingles(codes, np.array([[0], [len(codes)]]), 8)[0]))
    rng = np.random.default_rng(0)
    drawn = [np.unique(rng.integers(0, 200, n).astype(np.uint64)) for n in (0, 1, 5, 40, 80, 200)]
    for x in [*sets, *drawn]:
        for y in [*sets, *drawn]:
            assert lsh._shared(x, y) == len(np.intersect1d(x, y))


def entries_in_batches(rows, words=1, size=7):
    names = ["node", "bands", "n", *(f"s{w}" for w in range(words))]
    types = [pa.int64(), pa.list_(pa.int64()), *[pa.int64()] * (1 + words)]
    for at in range(0, len(rows), size):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + size], strict=True), types, strict=True)], names)


@pytest.mark.parametrize("block", [1024, 5])
def test_partners_of_buckets_match_pairs_by_hand(monkeypatch, block):
    """One pass by ranges of buckets finds what comparing all members of each bucket finds; hot buckets are left out."""
    monkeypatch.setattr(lsh, "SKETCH_BLOCK", block)
    rng = random.Random(6)
    rows = [(rng.randrange(50), [rng.randrange(-15, 15) for _ in range(3)], 1, rng.choice([0, 1, -1])) for _ in range(80)]
    sketch = {node: s for node, _, _, s in rows}
    rows = [(node, bands, n, sketch[node]) for node, bands, n, _ in rows] + [(99, [1000], 1, 0), (99, [1000], 1, 0)]
    members = {}
    for node, bands, *_ in rows:
        for b in bands:
            members.setdefault(b, set()).add(node)
    want, hot = set(), 3
    for b, nodes in members.items():
        near = [(x, y) for x in nodes for y in nodes if x < y and bin((sketch.get(x, 0) ^ sketch.get(y, 0)) & (2**64 - 1)).count("1") <= 4]
        if b == hot or len(nodes) < 2:
            continue
        if len(nodes) > block:
            want |= {(b, x, None, len(nodes)) for x in nodes}
            continue
        low = min((x for x, _ in near), default=None)
        for x in {x for p in near for x in p}:
            want.add((b, x, low if x == low or (low, x) in near else None, len(nodes)))
    ranged = list(lsh._by_range(1, 4, np.array([hot]))(entries_in_batches(rows)))
    got = Counter()
    for r in range(4):  # all rows of a range reach one task
        mine = (b.filter(pa.array(b.column(0).to_numpy() == r)) for b in ranged)
        for out in lsh._bucket_partners(1, 75, 4)(mine):
            got.update(zip(*(c.to_pylist() for c in out.columns), strict=True))
    assert got == Counter(want) and len(want) > 40
