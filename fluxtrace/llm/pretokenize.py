"""Pre-token boundaries without regular expressions.

Every code point gets a class; a small automaton over the classes says where a
pre-token starts.  A code point acts on the automaton as a function from state
to state.  These functions compose associatively, and all compositions that can
arise form a small monoid, so a prefix scan over their numbers, with one table
look-up a step, gives the state everywhere at once.

The boundaries are those of the byte-level pattern with contractions: ``'s 't 're
've 'm 'll 'd``, runs of letters, of numbers and of other symbols, each with one
space before it, and white space.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import tiktoken

LETTER, NUMBER, OTHER, SHORT, LONG, PREFIX, ALONE, WHITE = range(8)
"""Symbols: letter, number, other; an apostrophe with one or two contraction letters
after it; the last white space of a run if it is a space, or if it isn't; the rest."""

FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_SPACE, IN_WHITE, ONE_LEFT, TWO_LEFT = range(8)
"""States: nothing open; inside a run; after a space that belongs to what follows;
one or two contraction letters still to come."""


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a pre-token starts at this symbol."""
    if state == TWO_LEFT:
        return ONE_LEFT, False
    if state == ONE_LEFT:
        return FRESH, False
    if symbol in (SHORT, LONG):
        if state in (IN_OTHER, AFTER_SPACE):
            return IN_OTHER, False
        return (ONE_LEFT if symbol == SHORT else TWO_LEFT), True
    if symbol == PREFIX:
        return AFTER_SPACE, True
    if symbol == ALONE:
        return FRESH, True
    if symbol == WHITE:
        return IN_WHITE, state != IN_WHITE
    run = (IN_LETTERS, IN_NUMBERS, IN_OTHER)[symbol]
    return run, state not in (run, AFTER_SPACE)


@cache
def _classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or WHITE for each code point, by the Unicode version of the tokenizer library.

    The library itself is asked, once for each Python worker, since Python's own tables are of
    another version: with a vocabulary of single bytes it returns what a class matches.
    """
    table = np.full(0x110000, OTHER, np.uint8)
    everything = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for name, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
        engine = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        table[np.frombuffer(bytes(engine.encode_ordinary(everything)).decode("utf-8").encode("utf-32-le"), np.uint32)] = name
    return table


@cache
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The functions' numbers by symbol (8 more begin a text), and as flat tables: the row offset of
    each product, the functions' values by row offset and state, and start flags by state and symbol."""
    states = range(8)
    plain = [tuple(_step(s, x)[0] for s in states) for x in range(8)]
    generators = plain + [(f[FRESH],) * 8 for f in plain]
    known = {f: i for i, f in enumerate(dict.fromkeys(generators))}
    waiting = list(known)
    while waiting:
        f = waiting.pop()
        for g in generators:
            h = tuple(g[s] for s in f)
            if h not in known:
                known[h] = len(known)
                waiting.append(h)
    functions, size = list(known), len(known)
    product = np.array([[known[tuple(g[s] for s in f)] * size for g in functions] for f in functions], np.int32)
    values = np.zeros((size, size), np.uint8)
    values[:, :8] = functions
    starts = np.array([[_step(s, x)[1] for x in range(8)] for s in states])
    return np.array([known[f] for f in generators], np.int32), product.ravel(), values.ravel(), starts.ravel()


def _prefix_states(numbers: np.ndarray, width: int = 256) -> np.ndarray:
    """The state after each position, by a blocked scan: within blocks, over blocks, then both joined.

    A running product is kept as its row's offset in the product table, so that a step is
    one addition and one look-up.
    """
    _, product, values, _ = _monoid()
    size = int(len(product) ** 0.5)
    rows = -(-len(numbers) // width)
    padded = np.zeros(rows * width, np.int32)
    padded[: len(numbers)] = numbers
    steps = np.ascontiguousarray(padded.reshape(rows, width).T)
    running = steps[0] * size
    steps[0] = running
    for j in range(1, width):
        running = product[running + steps[j]]
        steps[j] = running
    state, entry = FRESH, np.zeros(rows, np.int32)
    for i, total in enumerate(steps[-1].tolist()):
        entry[i] = state
        state = int(values[total + state])
    return np.ascontiguousarray(values[steps + entry].T).ravel()[: len(numbers)]


def boundaries(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where pre-tokens start in the code points of several texts, in order.

    bounds: where each text starts, and the end; texts may be empty.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    symbols = _classes()[codes]
    last = np.zeros(n + 2, bool)
    last[bounds[1:][bounds[1:] > 0] - 1] = True  # the last code point of a text
    white = symbols == WHITE
    after = np.ones(n, bool)
    after[:-1] = white[1:]
    closing = white & ~after & ~last[:n]
    symbols[closing] = np.where(codes[closing] == 0x20, PREFIX, ALONE)
    marks = np.flatnonzero(codes == 0x27)
    marks = marks[~last[marks]]
    if len(marks):
        one = codes[marks + 1]
        short = np.isin(one, [ord(c) for c in "stmd"])
        symbols[marks[short]] = SHORT
        rest = marks[~short & ~last[marks + 1]]
        one, two = codes[rest + 1], codes[np.minimum(rest + 2, n - 1)]
        long = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        symbols[rest[long]] = LONG
    numbers_of, _, _, starts = _monoid()
    begins = bounds[:-1][bounds[:-1] < bounds[1:]]
    coded = symbols.copy()
    coded[begins] += 8
    states = _prefix_states(numbers_of[coded])
    before = np.zeros(n, np.uint8)
    before[1:] = states[:-1]
    before[begins] = FRESH
    return np.flatnonzero(starts[(before << 3) | symbols])


def pieces_of(data: np.ndarray, bounds: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Pre-tokens of several UTF-8 texts in order, their bounds by text, and their starts in code points."""
    text = data.tobytes().decode("utf-8")
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if len(codes) == len(data):
        cuts = bounds
    else:
        cuts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds]
    starts = boundaries(codes, cuts)
    at = starts.tolist()
    pieces = [text[a:b] for a, b in zip(at, [*at[1:], len(text)], strict=True)] if at else []
    return pieces, np.searchsorted(starts, cuts), starts
