"""Rounding, keys, names and interval texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Session names by code.
SESSION_CODES = {"0": ("Conditioning", "Habituation", "S1", "Training"), "1": ("S2", "Test", "Test 1h", "Test1"), "2": ("S3", "Test 24h", "Test2")}


def half_even(c: Column, decimals: int = 0) -> Column:
    """Rounds half to even at a number of decimals."""
    scale = 10**decimals
    return F.rint(c * scale) / scale


def truncate(c: Column, decimals: int = 0) -> Column:
    """Cuts toward zero at a number of decimals."""
    scale = F.lit(10**decimals)
    return (c * scale).cast("long") / scale.cast("double")


def clamp(c: Column, n: Column) -> Column:
    """Into 0 .. n - 1."""
    return F.greatest(F.lit(0), F.least(c, n - 1))


def session_code(name: Column, codes: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The code of a session's name; Unknown for others and null."""
    out = F.lit("Unknown")
    for code, names in (codes or SESSION_CODES).items():
        out = F.when(name.isin(*names), F.lit(code)).otherwise(out)
    return out


def filecode(exp: Column, session: Column, subject: Column) -> Column:
    """The composite key of a recording."""
    return F.concat_ws("_", exp, session, subject)


def parse_intervals(text: Column) -> Column:
    """A list of pairs written as ``[(a, b), ...]`` or ``[[a, b], ...]``; null if it is no such list."""
    return F.from_json(F.translate(text, "()", "[]"), "array<array<double>>")


def format_intervals(pairs: Column) -> Column:
    """The reverse of ``parse_intervals``."""
    return F.to_json(pairs)


def capitalised(c: Column) -> Column:
    """The first letter upper, the rest lower."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def without_suffix(c: Column, n: int = 2) -> Column:
    """The text without its last n characters."""
    return F.when(F.char_length(c) > n, F.substring(c, F.lit(1), F.char_length(c) - n)).otherwise(F.lit(""))


def renamed(name: Column) -> tuple[Column, Column]:
    """(new name, action) of a scored file's name.

    Names that start with ``behav_`` are kept.  Others end in the subject's name twice, with
    a code from 0 to 3 before (0 if it is missing), and get ``behav_<code>_<subject>.csv``;
    a file whose last two parts differ is to be deleted.  This is a plan: nothing is done.
    """
    parts = F.split(F.regexp_replace(name, r"\.[^.]*$", ""), "_")
    n = F.size(parts)
    last, second, third = F.get(parts, n - 1), F.get(parts, n - 2), F.get(parts, n - 3)
    code = F.when(third.isin("0", "1", "2", "3"), third).otherwise(F.lit("0"))
    action = F.when(name.startswith("behav_"), F.lit("keep")).when(last.eqNullSafe(second), F.lit("rename")).otherwise(F.lit("delete"))
    return F.when(action == "rename", F.concat(F.lit("behav_"), code, F.lit("_"), last, F.lit(".csv"))).when(action == "keep", name), action
