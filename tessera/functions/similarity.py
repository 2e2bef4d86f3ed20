"""How alike two titles are, from 0 to 100: by characters inserted and deleted, with words in order or as sets."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType

#: Columns of a matrix of members at most; beyond that, members share columns.
WIDTH = 2048


def common_length(a: str, b: str) -> int:
    """The length of the longest common subsequence, all of b's characters against one bit row of a."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    row, all_ = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        met = row & places.get(c, 0)
        row = (row + met | row - met) & all_
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """200 common characters in the length of both."""
    return 100.0 if not a and not b else 200.0 * common_length(a, b) / (len(a) + len(b))


def sorted_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def set_ratio(a: str, b: str) -> float:
    """The best of comparing the words that both have, and these with what either has besides."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, more, other = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and not (more and other):
        return 100.0
    head, left, right = " ".join(both), " ".join(both + more), " ".join(both + other)
    return max([ratio(left, right)] + ([ratio(head, left), ratio(head, right)] if both else []))


@F.pandas_udf(StringType())
def folded(titles: pd.Series) -> pd.Series:
    """Titles without accents and other characters than those of ASCII."""
    return titles.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def alike(short: int) -> object:
    """A function of two normal titles: as sets of words, or in order where the shorter has fewer than `short` words."""

    @F.pandas_udf(DoubleType())
    def compare(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([(set_ratio if min(len(x.split()), len(y.split())) >= short else sorted_ratio)(x, y) for x, y in zip(a, b)], dtype=float)

    return compare


def _shared(a: tuple, b: tuple, size: tuple[int, int], columns: int) -> np.ndarray:
    """What the members that a row of a and one of b have in common weigh, for each pair of rows (a, b: rows, members, weights); more where
    members share a column, never less."""
    used, places = np.unique(np.concatenate([a[1], b[1]]), return_inverse=True)
    width = min(len(used), columns)
    matrix = lambda rows, at, weights, n: np.bincount(rows * width + at % width, weights, n * width).reshape(n, width).astype(np.float32)
    return matrix(a[0], places[: len(a[1])], a[2], size[0]) @ matrix(b[0], places[len(a[1]) :], b[2], size[1]).T


def _bigrams(titles: list[list[str]]) -> tuple:
    """Rows, members and weights of the pairs of letters next to each other, blanks around each word included; a member knows which of its kind
    it is in its title."""
    padded = [f" {' '.join(t)} " for t in titles]
    letters = np.frombuffer("".join(padded).encode("utf-32-le"), np.uint32).astype(np.int64)
    rows = np.repeat(np.arange(len(padded)), [len(t) for t in padded])
    inside = rows[:-1] == rows[1:]
    rows, grams = rows[:-1][inside], (letters[:-1] << 21 | letters[1:])[inside]
    order = np.lexsort((grams, rows))
    rows, grams, places = rows[order], grams[order], np.arange(len(order))
    first = np.concatenate([[True], (rows[1:] != rows[:-1]) | (grams[1:] != grams[:-1])])
    nth = places - np.maximum.accumulate(np.where(first, places, 0))
    return rows, grams << 20 | np.minimum(nth, (1 << 20) - 1), np.ones(len(rows))


def _words(sets: list[list[str]], numbers: dict[str, int], weigh: object) -> tuple:
    """Rows, members and weights of the words of titles, numbered as they come."""
    each = [(i, numbers.setdefault(w, len(numbers)), weigh(w)) for i, words in enumerate(sets) for w in words]
    return tuple(np.array(each, np.int64).reshape(-1, 3).T)


def possible_pairs(a: list[str], b: list[str], similar: float, short: int, columns: int = WIDTH) -> np.ndarray:
    """i * len(b) + j for all pairs of titles a[i], b[j] that may be alike to `similar` per cent, and few others.

    - By letters: of a pair with l letters (blanks included) in common and s in all, s - 2 l are inserted or deleted. A deletion spoils two bigrams of
      a title and an insertion one, so that at least 1 - s + 3 l of them are in both, however words are arranged; l is similar / 200 of s at least.
    - By words, where words count as sets: the words in common are the beginning of either title, and make up similar / (200 - similar) of one at least."""
    x, y = [t.split() or [""] for t in a], [t.split() or [""] for t in b]
    letters = lambda titles: np.array([sum(map(len, t)) + len(t) - 1 for t in titles])
    sets = lambda titles: [list(dict.fromkeys(t)) for t in titles]
    long = np.array([len(t) >= short for t in x])[:, None] & np.array([len(t) >= short for t in y])
    xs, ys = sets(x), sets(y)
    n, m = np.where(long, letters(xs)[:, None], letters(x)[:, None]), np.where(long, letters(ys), letters(y))
    common = similar / 200 * (n + m) - 1e-6
    found = (common <= np.minimum(n, m)) & (_shared(_bigrams(x), _bigrams(y), long.shape, columns) >= 1 - n - m + 3 * common)
    numbers: dict[str, int] = {}
    found |= long & (_shared(_words(xs, numbers, lambda word: len(word) + 1), _words(ys, numbers, lambda word: 1), long.shape, columns) - 1 >= similar / (200 - similar) * np.minimum(n, m) - 1e-6)
    return np.flatnonzero(found)


def possible(similar: float, short: int) -> object:
    """A function of two arrays of normal titles: their possible_pairs."""

    @F.pandas_udf(ArrayType(LongType()))
    def find(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([possible_pairs(list(x), list(y), similar, short) for x, y in zip(a, b)], dtype=object)

    return find
