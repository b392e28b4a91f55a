"""Periodic runs of words, found with a dictionary of basic factors, and texts with the repeats taken out.

A run is a stretch of consecutive words that repeats itself with smallest period q, is at least max(SHORTEST, 2 q) words
long, and cannot be extended by a word on either side.

1. Dictionary: the factors (stretches) of 1, 2, 4, ... words of a text are named by doubling, equal ones alike.  A factor
   that occurs once has no name and takes no part in longer ones, so the levels thin out quickly in plain text.
2. Proposals: a run of period q, length <= q < 2 * length for one of those lengths, begins with a factor that occurs
   again q words on.  Occurrences of one factor that follow each other within half its length form an arithmetic
   progression, whose difference is the factor's own period; successive progressions within twice the length propose
   every difference between their members in that range, once for each stretch of positions.  Within one progression
   q would be a multiple of its difference, so nothing is lost.
3. Each proposal is extended to both sides through the dictionary, from long factors to short ones.  What is long
   enough is a run of period q; equal stretches are the same run, and the smallest q is its smallest period.

Everything about a text is found in its own task from whole texts; no rows are exchanged.  A piece of a task holds up to
PIECE_BYTES of text, or one longer text.

Cases: a NULL or empty text has no words and no runs, its collapsed text is empty; rows repeated under one doc_id, and
a NULL doc_id, each give a row; a table without rows gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_list, pieces, split_words, spread

#: Words that a run has at least.
SHORTEST = 12
PIECE_BYTES = 4 << 20


def repeated(key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions (ascending in ``at``) whose key occurs more than once, by key and position, and their key's number."""
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.ones(len(order), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    group = np.cumsum(new) - 1
    keep = np.bincount(group)[group] > 1 if len(group) else new
    return at[order[keep]], group[keep]


class Level:
    """Names of the factors of one length; -1 where a factor has none, or lies outside the texts."""

    def __init__(self, n: int, at: np.ndarray, name: np.ndarray):
        self.dense = 2 * len(at) > n
        if self.dense:
            self.name = np.full(n + 1, -1, np.int32)
            self.name[at] = name
        else:
            order = np.argsort(at)
            self.at, self.name = at[order].astype(np.int32), name[order].astype(np.int32)

    def positions(self) -> np.ndarray:
        return np.flatnonzero(self.name >= 0) if self.dense else self.at.astype(np.int64)

    def of(self, at: np.ndarray) -> np.ndarray:
        if self.dense:
            last = len(self.name) - 1
            return self.name[np.where((at < 0) | (at > last), last, at)]
        found = np.minimum(np.searchsorted(self.at, at), len(self.at) - 1)
        return np.where(self.at[found] == at, self.name[found], -1)


def proposals(at: np.ndarray, name: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, q): equal factors of ``length`` words that lie q words apart, length <= q < 2 * length."""
    cut = (name[1:] != name[:-1]) | (2 * (at[1:] - at[:-1]) > length)
    first = np.flatnonzero(np.concatenate([[True], cut]))
    last = np.append(first[1:], len(at)) - 1
    head, tail, own = at[first], at[last], name[first]
    step = np.where(last > first, at[np.minimum(first + 1, last)] - head, 0)
    place, period = [], []
    # progressions lie more than half a length apart: the fourth from one is beyond twice the length
    for k in (1, 2, 3):
        low = head[k:] - tail[: len(tail) - k]
        near = np.flatnonzero((own[k:] == own[: len(own) - k]) & (low < 2 * length))
        low, a, b = low[near], near, near + k
        by = np.maximum(step[a], step[b])
        high = np.minimum(tail[b] - head[a], 2 * length - 1)
        n = np.where(by > 0, (high - low) // np.maximum(by, 1) + 1, 1)
        more = spread(n) * np.repeat(by, n)
        q = np.repeat(low, n) + more
        keep = q >= length
        place.append(np.maximum(np.repeat(head[a], n), np.repeat(tail[a], n) - more)[keep])
        period.append(q[keep])
    place, period = np.concatenate(place), np.concatenate(period)
    # proposals of one period whose factors touch belong to one run
    order = np.lexsort((place, period))
    place, period = place[order], period[order]
    new = np.ones(len(place), bool)
    new[1:] = (period[1:] != period[:-1]) | (place[1:] - place[:-1] > length)
    return place[new], period[new]


def find_runs(word: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, ordered by text, start and period.

    ``word``: word codes of texts one after the other; ``counts``: the number of words of each text.
    """
    n, ends = len(word), np.cumsum(counts)
    text = np.repeat(np.arange(len(counts)), counts)
    levels: list[Level] = []
    places, periods = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at, name = repeated(text * (int(word.max(initial=0)) + 1) + word, np.arange(n))
    length = 1
    while len(at):
        level = Level(n, at, name)
        levels.append(level)
        place, period = proposals(at, name, length)
        places.append(place)
        periods.append(period)
        start = level.positions()
        start = start[start + 2 * length <= ends[text[start]]]
        second = level.of(start + length)
        start, second = start[second >= 0], second[second >= 0].astype(np.int64)
        at, name = repeated(level.of(start).astype(np.int64) * (int(name.max()) + 1) + second, start)
        length *= 2
    place, period = np.concatenate(places), np.concatenate(periods)
    left, right = place.copy(), place.copy()
    for k in reversed(range(len(levels))):
        size = 1 << k
        ahead, behind = levels[k].of(right), levels[k].of(left - size)
        right += size * ((ahead >= 0) & (ahead == levels[k].of(right + period)))
        left -= size * ((behind >= 0) & (behind == levels[k].of(left + period - size)))
    size = right - left + period
    long = size >= np.maximum(SHORTEST, 2 * period)
    left, size, period = left[long], size[long], period[long]
    order = np.lexsort((period, size, left))
    left, size, period = left[order], size[order], period[order]
    new = np.ones(len(left), bool)
    new[1:] = (left[1:] != left[:-1]) | (size[1:] != size[:-1])
    left, size, period = left[new], size[new], period[new]
    order = np.lexsort((period, left))
    left, size, period = left[order], size[order], period[order]
    of = text[left] if n else left
    return np.stack([of, left - (ends - counts)[of], size, period], axis=1)


def kept_words(runs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per word of all texts: whether it lies in the first period of every run that contains it."""
    base = (np.cumsum(counts) - counts)[runs[:, 0]]
    change = np.zeros(int(counts.sum()) + 1, np.int64)
    np.add.at(change, base + runs[:, 1] + runs[:, 3], 1)
    np.add.at(change, base + runs[:, 1] + runs[:, 2], -1)
    return np.cumsum(change[:-1]) == 0


RUNS = "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


def collapse(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, runs (by start, then period) and the text without their repeats."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", PIECE_BYTES):
                counts, flat = split_words(part.column("text"))
                coded = flat.dictionary_encode()
                names = as_list(coded.dictionary)
                word = coded.indices.to_numpy().astype(np.int64)
                runs = find_runs(word, counts)
                keep = kept_words(runs, counts)
                ends = np.concatenate([[0], np.cumsum(np.add.reduceat(keep, (np.cumsum(counts) - counts)[counts > 0]))]) if len(word) else np.zeros(1, int)
                kept = [names[w] for w in word[keep].tolist()]
                spans = iter(zip(ends[:-1].tolist(), ends[1:].tolist()))
                texts = [" ".join(kept[slice(*next(spans))]) if c else "" for c in counts.tolist()]
                offsets = np.concatenate([[0], np.cumsum(np.bincount(runs[:, 0], minlength=len(counts)))]).astype(np.int32)
                found = pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(offsets), found)
                columns = [part.column("doc_id"), pa.array(counts.astype(np.int64)), lists, pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, RUNS)


def longest(runs: Column) -> Column:
    """The run with the greatest length; of equal ones that with the smallest start, then the smallest period."""
    ranked = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(ranked.isNotNull(), F.struct((-ranked["start"]).alias("start"), ranked["length"].alias("length"), (-ranked["period"]).alias("period")))
