"""Plain versions of the operators' rules, for small inputs."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

SPACES = " \t\n\x0b\x0c\r"


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def components(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def similar(sets, percent):
    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a] | sets[b])):
                yield a, b


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def corpus(n=60, seed=1):
    """Random texts with exact and near copies, shared passages, and odd texts."""
    rng = random.Random(seed)
    words = [a + b for a in ("Ab", "le", "Tro", "né", "qu") for b in ("a", "ist", "Um", "o")]
    passage = " ".join(rng.choice(words) for _ in range(30))
    texts = []
    for i in range(n):
        body = [rng.choice(words) + rng.choice(["", "", ",", "."]) for _ in range(rng.choice([3, 20, 80, 200]))]
        text = " ".join(body)
        if i % 5 == 0:
            text += "\n" + passage
        if i % 3 == 1 and texts:
            old = rng.choice(texts).split(" ")
            for _ in range(rng.choice([0, 1, 2, 6])):
                old[rng.randrange(len(old))] = rng.choice(words)
            text = " ".join(old)
        texts.append(text.replace(" le", "\nle", 2))
    return texts + ["", None, "  \n\t ", "one two", "One  TWO", "word " * 3000]


def hard_negatives(rows, every, positives=5, negatives=5, low=80, high=100, scale=256):
    """Sorted rows of (anchor, positive, rank, negative, scores) for rows of (id, label, vector) without nulls."""
    whole = {i: (label, [math.floor(x * scale) for x in v]) for i, label, v in rows}
    out = []
    for a in (i for i in whole if i % every == 0):
        label, v = whole[a]
        scores = sorted((-sum(x * y for x, y in zip(v, w)), i) for i, (_, w) in whole.items() if i != a)
        for s, p in [x for x in scores if whole[x[1]][0] == label][:positives]:
            found = [(t, n) for t, n in scores if whole[n][0] != label and low * -s <= 100 * -t <= high * -s]
            out += [(a, p, k, n, -s, -t) for k, (t, n) in enumerate(found[:negatives], 1)]
    return sorted(out)


def runs(words, least=24, repeats=3):
    """(start, length, period) of all runs, by trying all periods."""
    found = {}
    for q in range(1, len(words) // repeats + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, repeats * q):
                found.setdefault((i, length), q)
            i = max(j, i) + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def planted(doc_id, words):
    """The words with the long run of one document in ten."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i if i < a else a + (i - a) % p] for i in range(n)]


def run_report(doc_id, text):
    """A row of the query on periodic runs."""
    words = planted(doc_id, re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    found = runs(words)
    dropped = {i for s, n, q in found for i in range(s + q, s + n)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if found else None
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest("".join(f"{s},{n},{q}\n" for s, n, q in found)), digest(" ".join(w for i, w in enumerate(words) if i not in dropped)))
