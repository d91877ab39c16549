"""Evaluation passages in a corpus, by greedy string tiling."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwork.llm.notebooks import WORD, words

SEED_WORDS = 8
BASE = np.uint64(0x9E3779B97F4A7C15)
BLOCK_WORDS = 500_000
PAIRS_AT_ONCE = 250_000


def running_hashes(ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Karp-Rabin hashes of all windows of k known words (id above 0), and where they begin."""
    if len(ids) < k:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    unknown = np.concatenate([[0], np.cumsum(ids == 0)])
    at = np.flatnonzero(unknown[k:] == unknown[:-k])
    h = np.zeros(len(at), np.uint64)
    wide = ids.astype(np.uint64)
    for j in range(k):
        h = h * BASE + wide[at + j]
    return h ^ (h >> np.uint64(29)), at


def common_runs(item: np.ndarray, doc: np.ndarray, least: int, at_once: int = PAIRS_AT_ONCE) -> np.ndarray:
    """The maximal common runs of at least `least` words: rows of (length, start in item, start in doc).

    Windows of the document are taken in order, some at_once pairs of equal windows at a time; runs that reach the last
    window of one lot go on in the next. So memory is bounded by the runs, not by the pairs.
    """
    hi, pi = running_hashes(item, least)
    hd, pd_ = running_hashes(doc, least)
    order = np.argsort(hi, kind="stable")
    hi, pi = hi[order], pi[order]
    low, high = np.searchsorted(hi, hd, "left"), np.searchsorted(hi, hd, "right")
    there = high > low
    low, n, pd_ = low[there], (high - low)[there], pd_[there]
    upto = np.cumsum(n)
    done = [np.empty((0, 3), np.int64)]
    held = np.empty((0, 3), np.int64)  # runs that may go on: (windows, start in item, start in doc), by falling diagonal
    first = 0
    while first < len(n):
        stop = max(first + 1, int(np.searchsorted(upto, upto[first] - n[first] + at_once, "right")))
        lot = n[first:stop]
        j = np.repeat(pd_[first:stop], lot)
        i = pi[np.repeat(low[first:stop], lot) + np.arange(lot.sum()) - np.repeat(np.cumsum(lot) - lot, lot)]
        same = np.ones(len(i), bool)
        for k in range(least):
            same &= item[i + k] == doc[j + k]
        i, j = i[same], j[same]
        order = np.lexsort((i, j - i))
        i, j = i[order], j[order]
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(i) != 1) | (np.diff(j - i) != 0)])) if len(i) else np.empty(0, np.int64)
        runs = np.stack([np.diff(np.concatenate([starts, [len(i)]])), i[starts], j[starts]], axis=1) if len(i) else np.empty((0, 3), np.int64)
        if len(held):
            # a run that begins where a held one ends, on the same diagonal, is its continuation
            ends = {(int(b) + int(w), int(c) + int(w)): r for r, (w, b, c) in enumerate(held)}
            over = np.ones(len(held), bool)
            for r in np.flatnonzero(runs[:, 2] == held[0, 2] + held[0, 0]) if len(runs) else ():
                known = ends.get((int(runs[r, 1]), int(runs[r, 2])))
                if known is not None:
                    runs[r] = (runs[r, 0] + held[known, 0], held[known, 1], held[known, 2])
                    over[known] = False
            done.append(held[over])
        last = runs[:, 2] + runs[:, 0] - 1 == pd_[stop - 1] if stop < len(n) else np.zeros(len(runs), bool)
        held = runs[last]
        done.append(runs[~last])
        first = stop
    out = np.concatenate(done)
    out[:, 0] += least - 1
    return out


def _stretches(free: np.ndarray, least: int) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], free.astype(np.int8), [0]])))
    return [(int(s), int(e)) for s, e in zip(edge[::2], edge[1::2]) if e - s >= least]


def tiles(item: np.ndarray, doc: np.ndarray, least: int) -> tuple[int, list[tuple[int, int, int]]]:
    """(longest common run, tiles): the longest matches of at least `least` words are marked again and again, none overlapping
    a marked one in item or doc; a tile is (length, start in item, start in doc)."""
    runs = common_runs(item, doc, least)
    if not len(runs):
        return 0, []
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], -runs[:, 0]))]
    free_i, free_d = np.ones(len(item), bool), np.ones(len(doc), bool)
    rest: list[tuple[int, int, int]] = []  # what is left free of runs that a tile has cut
    out: list[tuple[int, int, int]] = []
    k = 0
    while k < len(runs) or rest:
        whole = (-int(runs[k, 0]), int(runs[k, 1]), int(runs[k, 2])) if k < len(runs) else None
        if whole is None or (rest and rest[0] < whole):
            n, a, b = heapq.heappop(rest)
        else:
            n, a, b = whole
            k += 1
        n = -n
        free = free_i[a : a + n] & free_d[b : b + n]
        if free.all():
            out.append((n, a, b))
            free_i[a : a + n] = False
            free_d[b : b + n] = False
            if not _stretches(free_i, least):
                break
            continue
        for s, e in _stretches(free, least):
            heapq.heappush(rest, (s - e, a + s, b + s))
    return int(runs[0, 0]), out


class ItemIndex:
    """The query set of one block: numbers of its words, its parts as numbers, and the parts of each seed."""

    def __init__(self, rows: list, seed_words: int) -> None:
        self.number: dict[str, int] = {}
        self.parts: list[tuple] = []
        seeds: dict[int, list[tuple[np.ndarray, int]]] = {}
        for key, part, body in rows:
            ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in WORD.findall(body.lower())], np.int64)
            if len(ids):
                k = min(seed_words, len(ids))
                seeds.setdefault(k, []).append((np.unique(running_hashes(ids, k)[0]), len(self.parts)))
                self.parts.append((key, part, k, ids))
        self.seeds = {}
        for k, found in seeds.items():
            h = np.concatenate([x for x, _ in found])
            owner = np.concatenate([np.full(len(x), p, np.int64) for x, p in found])
            order = np.argsort(h, kind="stable")
            known, starts, counts = np.unique(h[order], return_index=True, return_counts=True)
            self.seeds[k] = (known, starts, counts, owner[order])

    def parts_in(self, ids: np.ndarray) -> list[int]:
        """The parts that share a seed with the words of a document."""
        out: list[np.ndarray] = []
        for k, (known, starts, counts, owner) in self.seeds.items():
            h = np.unique(running_hashes(ids, k)[0])
            if len(h):
                spot = np.minimum(np.searchsorted(known, h), len(known) - 1)
                out += [owner[starts[s] : starts[s] + counts[s]] for s in spot[known[spot] == h]]
        return np.unique(np.concatenate(out)).tolist() if out else []


def leaked_passages(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, parts: list[str], seed_words: int = SEED_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, part, item_words, longest_run, covered_words, coverage, tiles) of every document and item part that
    share a run of at least seed_words words (or the whole part, if it is shorter).

    longest_run is the longest run of words common to both, in order; covered_words is what greedy string tiling marks of
    the part, so that passages in another order count in full, down to pieces of seed_words words. Words are compared without case; layout marks and
    invisible characters don't count. NULL and empty texts and parts have no words and no rows. Repeated documents or
    items give a row each; empty tables give an empty result; texts are read whole, whatever their length.

    Items are the stated query set: they are taken in blocks of at most block_words words, whose index goes to every
    task, and all documents are read once for each block. A document is joined with the block through its seeds (hashes of
    seed_words words) in the task that holds it, and tiled against each part that it shares one with: nothing is
    shuffled, so a seed that every document carries makes no hot key.
    """
    spark = docs.sparkSession
    long = reduce(DataFrame.unionByName, [items.select(F.col(item_id).alias("item_id"), F.lit(p).alias("part"), F.col(p).cast("string").alias("body")) for p in parts]).where("body is not null").distinct()
    total = long.agg(F.sum(F.length("body"))).first()[0] or 0
    blocks = max(1, -(-total // (2 * block_words)))
    columns = ["doc_id", "item_id", "part", "item_words", "longest_run", "covered_words", "coverage", "tiles"]
    kinds = [docs.schema[doc_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString(), "string", "int", "int", "int", "double", "int"]
    found = []
    for b in range(blocks):
        rows = long.where(F.pmod(F.xxhash64("item_id", "part"), F.lit(blocks)) == b).collect()  # bounded by block_words
        shared = spark.sparkContext.broadcast(ItemIndex(sorted(rows, key=str), seed_words))

        def tiled(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = shared.value
            get = index.number.get
            for f in frames:
                out = []
                for key, body in zip(f["doc_id"], f["body"]):
                    ids = np.fromiter((get(w, 0) for w in words(body)), np.int64)
                    for p in index.parts_in(ids):
                        item, part, k, own = index.parts[p]
                        longest, marked = tiles(own, ids, k)
                        if longest:
                            covered = sum(n for n, _, _ in marked)
                            out.append((key, item, part, len(own), longest, covered, covered / len(own), len(marked)))
                if out:
                    yield pd.DataFrame(out, columns=columns)

        whole = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("body")).where("body is not null and body <> ''")
        found.append(whole.mapInPandas(tiled, ", ".join(f"{c} {t}" for c, t in zip(columns, kinds))))
    return reduce(DataFrame.unionByName, found)
