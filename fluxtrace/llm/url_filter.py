"""URL filter by a Bloom filter cascade: exact membership over a known key universe, without joins.

Level 1 encodes the listed keys.  Level 2 encodes those keys of the universe that
level 1 takes for listed though they aren't, level 3 the listed keys that level 2
takes for unlisted, and so on, until a level makes no error over the universe.
A key is listed if the first level that doesn't know it is an even one.

The universe is every key that any URL of the corpus can ask for, so answers about
the corpus are exact.  Bits are gathered by partition and joined by word, and only
the filters, whose size follows from the lists, come to the driver and go out again.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

# The rules, as host, path and verdict.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
# Names in a host that block a URL without a rule.
BLOCKED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


@dataclass(frozen=True)
class UrlRules:
    """rules: (host, path, verdict); a path starts with ``/``.  names: labels of a host that
    block it.  error: of each Bloom filter.  most_bytes: of all filters, for the broadcast."""

    rules: tuple[tuple[str, str, str], ...] = RULES
    names: tuple[str, ...] = BLOCKED_NAMES
    error: float = 0.01
    most_bytes: int = 64 << 20

    def keys(self, verdict: str) -> list[str]:
        """The listed keys of a verdict: host and path of a rule, or a name with a dot after it."""
        found = {host + path for host, path, kind in self.rules if kind == verdict}
        return sorted(found | ({f"{name}." for name in self.names} if verdict == "block" else set()))

    @property
    def depths(self) -> list[int]:
        return sorted({host.count(".") + 1 for host, _, _ in self.rules})

    @property
    def lengths(self) -> list[int]:
        return sorted({len(path) for _, path, _ in self.rules})

    def questions(self, host: str, path: str) -> tuple[list[str], list[str]]:
        """The rule keys that could fit a URL, longest first, and its name keys."""
        labels = host.split(".")
        ends = [".".join(labels[-n:]) for n in self.depths if n <= len(labels)] if host else []
        rules = {end + path[:n] for end in ends for n in self.lengths if len(path) >= n}
        return sorted(rules, key=lambda k: (-len(k), k)), [f"{x}." for x in dict.fromkeys(labels) if x]


@dataclass
class Bloom:
    """A filter for about n keys; level salts the hash."""

    level: int
    n: int
    error: float
    bits: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.size = max(64, -(-math.ceil(-self.n * math.log(self.error) / math.log(2) ** 2) // 64) * 64)
        self.hashes = max(1, round(self.size / max(self.n, 1) * math.log(2))) if self.n else 1
        self.hashes = min(self.hashes, 16)
        self.bits = np.zeros(self.size // 64, np.uint64)

    def places(self, key: str) -> list[int]:
        raw = key.encode("utf-8")
        a, b = xxhash.xxh64_intdigest(raw, seed=2 * self.level), xxhash.xxh64_intdigest(raw, seed=2 * self.level + 1) | 1
        return [((a + i * b) & 0xFFFFFFFFFFFFFFFF) % self.size for i in range(self.hashes)]

    def add(self, keys: Iterable[str]) -> None:
        for key in keys:
            for at in self.places(key):
                self.bits[at >> 6] |= np.uint64(1 << (at & 63))

    def knows(self, key: str) -> bool:
        return all(int(self.bits[at >> 6]) >> (at & 63) & 1 for at in self.places(key))


class Cascade:
    """Levels of Bloom filters; ``has`` is exact for all keys of the universe they were built on."""

    def __init__(self, levels: list[Bloom]) -> None:
        self.levels = levels

    def has(self, key: str) -> bool:
        return self.passed(key) % 2 == 1

    def passed(self, key: str) -> int:
        """How many levels in a row know the key."""
        for i, level in enumerate(self.levels):
            if not level.knows(key):
                return i
        return len(self.levels)


def _filled(keys: DataFrame, bloom: Bloom) -> Bloom:
    """The filter with all keys of a one-column table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bloom(bloom.level, bloom.n, bloom.error)
        for batch in batches:
            own.add(batch.column(0).to_pylist())
        at = np.flatnonzero(own.bits)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(own.bits[at].view(np.int64))], ["word", "bits"])

    for row in keys.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).collect():
        bloom.bits[row.word] = np.uint64(row.bits & 0xFFFFFFFFFFFFFFFF)
    return bloom


def build_cascade(listed: DataFrame, universe: DataFrame, rules: UrlRules, work: Workspace, name: str) -> Cascade:
    """The cascade for the keys of ``listed`` over those of ``universe``; tables of one column, key.

    It raises if the filters would outgrow ``rules.most_bytes``.
    """
    listed = listed.where("key is not null").distinct()
    others = universe.where("key is not null").distinct().join(listed, "key", "left_anti")
    sides = [work.save(listed, f"{name}-in"), work.save(others, f"{name}-out")]
    levels: list[Bloom] = []
    spent = 0
    while True:
        own = sides[len(levels) % 2]
        n = own.count()
        if not n and levels:
            return Cascade(levels)
        bloom = Bloom(len(levels) + 1, n, rules.error)
        spent += bloom.bits.nbytes
        if spent > rules.most_bytes:
            raise ValueError(f"the filters need over {rules.most_bytes} bytes; split the list by host")
        levels.append(_filled(own, bloom))

        def wrong(batches: Iterator[pa.RecordBatch], last: Bloom = levels[-1]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([k for k in batch.column(0).to_pylist() if last.knows(k)], pa.string())], ["key"])

        other = len(levels) % 2
        sides[other] = work.save(sides[other].mapInArrow(wrong, "key string"), f"{name}-{len(levels)}")


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge_urls(pages: DataFrame, rules: UrlRules | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for each row.

    A rule fits its host and all subdomains if the path starts with the rule's; the
    longest that fits decides, and rule names it.  Else rule is null and the verdict is
    block if a name in the host is listed, and allow if not.  A null URL, or one without
    ``://``, has an empty host and path, and is allowed.  Rows with null or repeated ids
    are judged as they are; other columns are neither read nor returned.
    """
    r = rules or UrlRules()
    spark = pages.sparkSession
    work = Workspace(spark, "url-filter")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: set[str] = set()
            for host, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for part in r.questions(host, path):
                    keys.update(part)
            yield pa.RecordBatch.from_arrays([pa.array(sorted(keys), pa.string())], ["key"])

    universe = work.save(rows.select("host", "path").mapInArrow(asked, "key string").distinct(), "universe")
    table = lambda keys: spark.createDataFrame([(k,) for k in keys], "key string")
    allow, block = (build_cascade(table(r.keys(kind)), universe, r, work, kind) for kind in ("allow", "block"))

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, verdicts = [], []
            for host, path in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                keys, names = r.questions(host, path)
                hit = next(((k, kind) for k in keys for kind, list_ in (("block", block), ("allow", allow)) if list_.has(k)), None)
                found.append(hit and hit[0])
                verdicts.append(hit[1] if hit else "block" if any(map(block.has, names)) else "allow")
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.string()), pa.array(verdicts, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return rows.mapInArrow(judged, "page_id long, host string, path string, rule string, verdict string")
