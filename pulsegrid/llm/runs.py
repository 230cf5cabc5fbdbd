"""Periodic runs of words: stretches that repeat with a small period, by a suffix automaton and ordered sets of ends."""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows, text_bytes
from .hashing import BASE, U, mix


def shortest_seed(least: int, exponent: int) -> int:
    """The fewest words that every run of length max(least, exponent * period) has besides one period."""
    return min(max(least - d, (exponent - 1) * d) for d in range(1, least + 1))


def repeated_stretches(ids: np.ndarray, width: int) -> list[tuple[int, int]]:
    """First and end of the stretches whose words all stand in a string of ``width`` words that is found twice or more.

    Every word of a run with a seed of ``width`` words is in one: of two such
    strings a period apart both are in the run, and together they cover it.
    """
    if len(ids) <= width:
        return []
    # strings of 2, 4, 8 .. words, then two that overlap; equal hashes only widen what is looked at
    hashes, have = mix(ids.astype(U)), 1
    while have < width:
        step = min(have, width - have)
        hashes = mix(hashes[: len(hashes) - step] * BASE + hashes[step:] + U(step))
        have += step
    ordered = np.sort(hashes)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return []
    twice = np.unique(twice)
    at = np.minimum(np.searchsorted(twice, hashes), len(twice) - 1)
    found = np.flatnonzero(twice[at] == hashes)
    # strings that touch or overlap are one stretch
    apart = np.flatnonzero(np.diff(found) > width)
    firsts, lasts = found[np.concatenate([[0], apart + 1])], found[np.concatenate([apart, [len(found) - 1]])]
    return list(zip(firsts.tolist(), (lasts + width).tolist()))


class SuffixAutomaton:
    """Of one sequence of numbers from 0: ``size`` (longest string) and ``link`` of each state, and ``own``, the state of each prefix.

    A state's first transition stands in two arrays, as most have no other.
    """

    def __init__(self, word: list[int]):
        self.size, self.link, self.symbol, self.to = (array("i", [v]) for v in (0, -1, -1, -1))
        self.more: dict[int, dict[int, int]] = {}
        self.own = array("i")
        last = 0
        for c in word:
            last = self._grow(last, c)
            self.own.append(last)

    def _state(self, size: int, link: int, symbol: int = -1, to: int = -1) -> int:
        self.size.append(size)
        self.link.append(link)
        self.symbol.append(symbol)
        self.to.append(to)
        return len(self.size) - 1

    def _grow(self, last: int, c: int) -> int:
        symbol, to, more, link, size = self.symbol, self.to, self.more, self.link, self.size
        new = self._state(size[last] + 1, 0)
        p, q = last, -1
        while p >= 0:
            if symbol[p] == c:
                q = to[p]
                break
            if symbol[p] < 0:
                symbol[p], to[p] = c, new
            else:
                others = more.setdefault(p, {})
                q = others.get(c, -1)
                if q >= 0:
                    break
                others[c] = new
            p = link[p]
        if q < 0:
            return new
        if size[q] == size[p] + 1:
            link[new] = q
            return new
        clone = self._state(size[p] + 1, link[q], symbol[q], to[q])
        if q in more:
            more[clone] = dict(more[q])
        while p >= 0:
            if symbol[p] == c:
                if to[p] != q:
                    break
                to[p] = clone
            elif p in more and more[p].get(c) == q:
                more[p][c] = clone
            else:
                break
            p = link[p]
        link[q] = link[new] = clone
        return new


def runs_in(word: list[int], least: int, exponent: int) -> list[tuple[int, int, int]]:
    """Start, length and smallest period of each maximal run of ``word`` that is as long as ``least`` and ``exponent`` periods.

    Sets of ends grow up the links, the smaller into the larger. Where an end gets
    a new neighbour d before or after it, the state's longest string stands at
    both, which is a square if it has d words. It is a run if it can't be
    extended: of a run with period q, the last end and the one q before it meet
    at the state whose longest string reaches from the run's start, with no end
    between them, so that each run is seeded once where it already has its full
    extent, and squares that can still be extended belong to one that is found so.
    """
    automaton, n = SuffixAutomaton(word), len(word)
    size, link = automaton.size, automaton.link
    shortest = shortest_seed(least, exponent)
    # ends stand negated, as a prefix' own end is the first of all: it goes to the end of the list
    ends: dict[int, list[int]] = {state: [-k] for k, state in enumerate(automaton.own) if size[state] >= shortest}
    found: dict[tuple[int, int], int] = {}
    sizes = np.frombuffer(size, np.int32)
    for state in np.argsort(-sizes, kind="stable")[: int((sizes >= shortest).sum())].tolist():
        few, parent = ends.pop(state), link[state]
        reach = size[parent]
        if reach < shortest:
            continue
        many = ends.get(parent)
        if many is None:
            ends[parent] = few
            continue
        if len(few) > len(many):
            few, many = many, few
            ends[parent] = many
        for end in few:
            at = bisect_left(many, end)
            for other in many[max(at - 1, 0) : at + 1]:
                # the two ends, the later one first
                late, early = (-other, -end) if other < end else (-end, -other)
                d = late - early
                if reach < (exponent - 1) * d or reach + d < least:
                    continue
                start = early - reach + 1
                if (late + 1 < n and word[late + 1] == word[early + 1]) or (start > 0 and word[start - 1] == word[start + d - 1]):
                    continue
                known = found.get((start, late))
                # multiples of the smallest period have the same extent
                if known is None or d < known:
                    found[start, late] = d
            many.insert(at, end)
    return sorted((start, late - start + 1, d) for (start, late), d in found.items())


def word_runs(words: list[bytes], least: int, exponent: int) -> list[tuple[int, int, int]]:
    """Start, length and period of each run of ``words``, by start, then period."""
    if len(words) < least:
        return []
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    width = shortest_seed(least, exponent)
    if len(words) - len(number) < width:
        return []
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    out = []
    for lo, hi in repeated_stretches(ids, width):
        if hi - lo >= least:
            # numbers of its own, so that they are small
            out += [(lo + start, length, period) for start, length, period in runs_in(ids[lo:hi].tolist(), least, exponent)]
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run repeats: all of it after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [w for w, k in zip(words, keep.tolist()) if k]


Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def _find(batches: Iterator[dict], least: int, exponent: int, rewrite: Rewrite | None) -> Iterator[dict]:
    for batch in batches:
        for lo in range(0, len(batch["text"]), 64):
            out = {"doc_id": batch["doc_id"][lo : lo + 64], "n_words": [], "runs": [], "collapsed": []}
            for doc_id, text in zip(out["doc_id"], batch["text"][lo : lo + 64]):
                # of bytes: at \x20 and \x09 to \x0D alone
                words = text.split()
                words = rewrite(doc_id, words) if rewrite else words
                runs = word_runs(words, least, exponent)
                out["n_words"].append(len(words))
                out["runs"].append([{"start": s, "length": n, "period": p} for s, n, p in runs])
                out["collapsed"].append(b" ".join(collapsed_words(words, runs)).decode())
            yield out


def find_runs(docs: DataFrame, least: int = 24, exponent: int = 3, rewrite: Rewrite | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed text of each row of ``docs`` (doc_id, text).

    A run is a stretch of words with smallest period q, as long as ``least``
    words and ``exponent`` periods, that no neighbour extends. The collapsed text
    has the words that no run repeats, joined by spaces. ``rewrite`` may replace
    a row's words beforehand.

    Null text counts as empty: no words, no runs, an empty text. Each row is
    judged by itself, repeated and null doc_ids too. The automaton is built of
    the stretches that repeat alone, and takes some 40 bytes a word.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    schema = "doc_id long, n_words long, runs array<struct<start long, length long, period long>>, collapsed string"
    return map_rows(rows, lambda b: _find(b, least, exponent, rewrite), schema)


def _first_by_exponent(a: Column, b: Column) -> Column:
    x, y = a["length"] * b["period"], b["length"] * a["period"]
    return F.when(x != y, F.when(x > y, -1).otherwise(1)).when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(F.signum(a["period"] - b["period"]).cast("int"))


def run_digests(found: DataFrame) -> DataFrame:
    """Of each row of ``find_runs`` how many runs there are, the one with most periods, and hashes of all and of the collapsed text."""
    best = F.get(F.array_sort("runs", _first_by_exponent), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
