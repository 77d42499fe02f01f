"""Benchmark decontamination with DataFrame functions only.

The test items' windows are a broadcast table keyed by the hash of their first words.
A scan makes every document's rolling word hashes (pairs of pairs of pairs), looks
each up, and compares the words of what it finds, so hits are exact.  Windows shorter
than the full width, from short items, are looked up by the hashes of 1, 2, 4 or 8
words that they have.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# What separates words, once A-Z are lower-cased; and in raw text.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
WORDS = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
RAW_SEPARATORS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


@dataclass(frozen=True)
class DecontaminationParams:
    """width: words of a window.  most_windows: of the broadcast; beyond it the windows are shuffled."""

    width: int = 10
    most_windows: int = 500_000


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; none for null."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(lowered, SEPARATORS), "")


def _paired(hashes: str, step: int) -> Column:
    """Hashes of twice as many words: each joined with the one ``step`` further on."""
    n = F.greatest(F.size(hashes) - step, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))


def _rolling(rows: DataFrame, words: str, top: int) -> DataFrame:
    """Adds _h1, _h2, _h4, _h8, as far as ``top``: arrays of hashes of that many words from each word on."""
    rows = rows.withColumn("_h1", F.transform(words, lambda w: F.xxhash64(w)))
    for step in (1, 2, 4):
        if 2 * step <= top:
            rows = rows.withColumn(f"_h{2 * step}", _paired(f"_h{step}", step))
    return rows


def _key_width(n: int) -> int:
    return next(k for k in (8, 4, 2, 1) if k <= n)


def windows_of(benchmark: DataFrame, width: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, window, length) of every item, a window once; items without a word or an id have none."""
    words = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1)))
    found = words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, F.lit(width)))).alias("window"))
    return found.distinct().withColumn("length", F.size("window"))


def hits(docs: DataFrame, benchmark: DataFrame, params: DecontaminationParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, n_hit, items, spans) of the rows that hold a window.

    row_key is the 64-bit hash of the row's text; items are the ids of the items whose
    windows occur; spans are (position, length) of the windows' occurrences, in words.
    """
    p = params or DecontaminationParams()
    work = Workspace(docs.sparkSession, "decontamination")
    windows = windows_of(benchmark, p.width)
    windows = work.save(windows, "windows")
    sizes = {row.length: row["count"] for row in windows.groupBy("length").count().collect()}
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("row_key"), words_of(text).alias("words"))
    widths = sorted({_key_width(n) for n in sizes})
    rows = _rolling(rows, "words", max(widths, default=1))
    keyed = _rolling(windows, "window", max(widths, default=1))
    keyed = work.save(keyed.select("item_id", "window", "length", *(F.get(f"_h{k}", F.lit(0)).alias(f"key{k}") for k in widths or [1])), "keyed")
    found = None
    for k in widths or [1]:
        lengths = [n for n in sizes if _key_width(n) == k]
        items = keyed.where(F.col("length").isin(lengths)).select("item_id", "window", "length", F.col(f"key{k}").alias("hash"))
        if sum(sizes[n] for n in lengths) <= p.most_windows:
            items = F.broadcast(items)
            # Outer: from an inner one Spark would infer a filter that makes all hashes once more.
            placed = rows.select("doc_id", "row_key", "words", F.posexplode_outer(f"_h{k}").alias("at", "hash"))
        else:
            # Only hashes and their places are shuffled; texts come back for those that some window has.
            met = rows.select("doc_id", "row_key", F.posexplode(f"_h{k}").alias("at", "hash")).join(items.select("hash").distinct(), "hash", "left_semi")
            met = met.groupBy(F.col("doc_id").alias("met_id"), F.col("row_key").alias("met_row")).agg(F.collect_set(F.struct("at", "hash")).alias("met"))
            placed = rows.join(met, (F.col("row_key") == F.col("met_row")) & F.col("doc_id").eqNullSafe(F.col("met_id"))).select("doc_id", "row_key", "words", F.inline("met"))
        same = (placed.hash == items.hash) & (F.slice(placed.words, placed["at"] + 1, items.length) == items.window)
        part = placed.join(items, same).select("doc_id", "row_key", "at", "length", "item_id")
        found = part if found is None else found.unionByName(part)
    spans = F.collect_set(F.struct("at", "length"))
    covered = F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["length"] - 1)))
    out = found.groupBy("doc_id", "row_key").agg(spans.alias("spans"), F.collect_set("item_id").alias("items"))
    return out.select("doc_id", "row_key", F.size(F.array_distinct(covered)).cast("long").alias("n_hit"), "items", "spans")


def judge_contamination(docs: DataFrame, benchmark: DataFrame, params: DecontaminationParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), a row for each input row.

    A null, empty or wordless text has no words and no hits; null or wordless items hit
    nothing.  Rows with null or repeated ids are judged each by its own text.  Other
    columns are neither read nor returned; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("row_key"), F.size(words_of(text)).cast("long").alias("n_words"))
    hit = hits(docs, benchmark, params, id_col, text_col).select(F.col("doc_id").alias("hit_id"), F.col("row_key").alias("hit_row"), "n_hit", "items")
    rows = rows.join(hit, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("row_key") == F.col("hit_row")), "left")
    named = F.array_sort(F.coalesce(F.transform("items", lambda i: i.cast("string")), F.array().cast("array<string>")))
    return rows.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.size(named).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", named), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", params: DecontaminationParams | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns as they are, without contaminated documents; or, with
    ``remove="spans"``, all rows with the hit words and what follows each taken out."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove must be 'documents' or 'spans'")
    text = F.coalesce(F.col(text_col), F.lit(""))
    hit = hits(docs, benchmark, params, id_col, text_col).select(F.col("doc_id").alias("hit_id"), F.col("row_key").alias("hit_row"), "spans")
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("row_key"))
    same = F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("row_key") == F.col("hit_row"))
    if remove == "documents":
        return rows.join(hit, same, "left_anti").select("doc.*")
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["length"] - 1))))
    rows = rows.join(hit, same, "left").withColumn("hit", covered)
    rows = rows.withColumn("words", F.array_remove(F.split("text", RAW_SEPARATORS), "")).withColumn("gaps", F.split("text", WORDS))
    kept = F.transform("words", lambda w, i: F.when(F.array_contains("hit", i), F.lit("")).otherwise(F.concat(w, F.get("gaps", i + 1))))
    rebuilt = F.concat(F.get("gaps", F.lit(0)), F.array_join(kept, ""))
    rows = rows.withColumn("rebuilt", F.when(F.col("hit").isNull(), F.col("doc")[text_col]).otherwise(rebuilt))
    return rows.select(*(F.col("rebuilt").alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in docs.columns))
