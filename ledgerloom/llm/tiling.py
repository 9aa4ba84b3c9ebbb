"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import keep_rows, map_rows

#: Shortest tile, in words.
MIN_TILE = 5
#: Share of a test item's words under tiles from which a document is contaminated.
COVERAGE = 0.6
#: Bytes of benchmark text that go to the workers at once.
BLOCK_BYTES = 8_000_000

WORD = re.compile(r"\w+")
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
NOTHING = -1  # a word of no test item, or a gap


def windows(tokens: np.ndarray, width: int) -> np.ndarray:
    """Rolling Karp-Rabin hash (modulo 2**64) of every window of ``width`` tokens."""
    n = len(tokens) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width) if width <= 8 else ():
        out = out * BASE + (tokens[k : k + n] + 1).astype(np.uint64)
    if width > 8:  # the same polynomial from sums over all words before, which the inverse of the base allows
        up, down = (np.cumprod(np.append(np.uint64(1), np.full(len(tokens), x, np.uint64))) for x in (BASE, INVERSE))
        sums = np.append(np.uint64(0), np.cumsum((tokens + 1).astype(np.uint64) * down[:-1]))
        out = (sums[width:] - sums[:-width]) * up[width - 1 : width - 1 + n]
    return out


def _free(tokens: np.ndarray, width: int) -> np.ndarray:
    """Which windows hold neither a gap nor a marked token."""
    bad = np.concatenate([[0], np.cumsum(tokens < 0)])
    return bad[width:] == bad[:-width]


class Sites:
    """Unmarked windows of one width that stand in both: their places in the item, and in the document by hash."""

    def __init__(self, item: np.ndarray, doc: np.ndarray, width: int):
        self.item, self.doc, self.width = item, doc, width
        a, b = windows(item, width), windows(doc, width)
        ia, ib = np.flatnonzero(_free(item, width)), np.flatnonzero(_free(doc, width))
        ib = ib[np.isin(b[ib], a[ia])]
        ia = ia[np.isin(a[ia], b[ib])]
        ib = ib[np.argsort(b[ib], kind="stable")]
        self.ia, self.ib, self.hashes = ia, ib, b[ib]
        self.low, self.high = np.searchsorted(self.hashes, a[ia], "left"), np.searchsorted(self.hashes, a[ia], "right")
        self.open = np.ones(len(b), bool)  # windows of the document without a word marked since

    def _first(self, i: int, low: int, high: int) -> int | None:
        places = self.ib[low:high]
        for j in places[self.open[places]]:
            if np.array_equal(self.item[i : i + self.width], self.doc[j : j + self.width]):
                return int(j)
        return None

    def any(self) -> bool:
        return any(self._first(*x) is not None for x in zip(self.ia, self.low, self.high))

    def mark(self) -> Iterator[tuple[int, int, int]]:
        """Mark equal windows while any is free: in order of the item, each with the first free place in the document."""
        width = self.width
        for i, low, high in zip(self.ia.tolist(), self.low, self.high):
            if (self.item[i : i + width] >= 0).all() and (j := self._first(i, low, high)) is not None:
                self.item[i : i + width], self.doc[j : j + width] = -2, -3
                self.open[max(j - width + 1, 0) : j + width] = False
                yield i, j, width


def tile(item: np.ndarray, doc: np.ndarray, least: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in item, place in document, length): the longest common run of
    unmarked words again and again, ties to the earliest in the item, then in the document.

    The longest length that still matches is found by halving, one Karp-Rabin pass a
    probe; all matches of that length are then marked in order where still free.
    Equal windows are kept as runs of a sorted array, never as pairs, so a text that
    says the same words over and over needs no more memory than another.
    """
    item, doc, tiles, top = item.copy(), doc.copy(), [], min(len(item), len(doc))
    item[item < 0], doc[doc < 0] = -2, -3
    while top >= least:
        low, high, best = least, top, None
        while low <= high:
            mid = (low + high) // 2
            if (now := Sites(item, doc, mid)).any():
                low, best = mid + 1, now
            else:
                high = mid - 1
        if best is None:
            break
        tiles += best.mark()
        top = best.width
    return tiles


class Items:
    """A block of test items with the index of their word seeds."""

    #: Texts whose words are looked up in one go.
    AT_ONCE = 256

    def __init__(self, rows: list[tuple[int, str]], least: int, coverage: float):
        self.least, self.coverage, self.ids, self.items = least, coverage, [], []
        self.vocabulary: dict[str, int] = {}
        for key, text in rows:
            words = WORD.findall((text or "").lower())
            if len(words) >= least:
                self.ids.append(key)
                self.items.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.int64))
        seeds = [np.unique(windows(x, least)) for x in self.items]
        owner = np.repeat(np.arange(len(seeds)), [len(x) for x in seeds]) if seeds else np.empty(0, int)
        flat = np.concatenate(seeds) if seeds else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.seeds, self.owner = flat[order], owner[order]
        self.likely = np.zeros(1 << 20, bool)  # by the upper bits: most windows are ruled out without a search
        self.likely[self.seeds >> np.uint64(44)] = True

    def search_all(self, texts: list[str | None]) -> Iterator[tuple[int, int, float, int, int]]:
        """Contaminating items of many texts: (place of the text, item, coverage, tiles, longest tile)."""
        for first in range(0, len(texts), self.AT_ONCE):
            own, ends = [], []
            for text in texts[first : first + self.AT_ONCE]:
                own += WORD.findall(text.lower()) if text else ()
                own.append(None)  # a gap: no seed goes over it
                ends.append(len(own))
            words = np.fromiter(map(self.vocabulary.get, own, repeat(NOTHING)), np.int64, len(own))
            at, lo, hi = self._seeded(words)
            text_of = np.searchsorted(ends, at, "right")
            for k in np.unique(text_of):
                mine, begin = text_of == k, ends[k - 1] if k else 0
                for found in self._search(words[begin : ends[k] - 1], at[mine] - begin, lo[mine], hi[mine]):
                    yield first + int(k), *found

    def search(self, text: str | None) -> Iterator[tuple[int, float, int, int]]:
        return (x[1:] for x in self.search_all([text]))

    def _seeded(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places where a seed stands, and which of the sorted seeds it is."""
        if len(words) < self.least or not len(self.seeds):
            return (np.empty(0, np.int64),) * 3
        at = np.flatnonzero(_free(words, self.least))
        hashes = windows(words, self.least)[at]
        may = self.likely[hashes >> np.uint64(44)]
        at, hashes = at[may], hashes[may]
        lo, hi = np.searchsorted(self.seeds, hashes, "left"), np.searchsorted(self.seeds, hashes, "right")
        hit = hi > lo
        return at[hit], lo[hit], hi[hit]

    def _search(self, words: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[int, float, int, int]]:
        least = self.least
        n = hi - lo
        place = np.repeat(at, n)
        which = self.owner[np.repeat(hi - np.cumsum(n), n) + np.arange(n.sum())]
        order = np.argsort(which, kind="stable")
        which, place = which[order], place[order]
        cuts = np.flatnonzero(np.diff(which)) + 1
        for group, places in zip(which[np.concatenate([[0], cuts])], np.split(place, cuts)):
            item = self.items[group]
            # a tile of l words holds l - least + 1 seeds of the item, so 1 / least of the words must start one
            seen = np.isin(windows(item, least), windows(words, least)[places]).sum()
            if seen * least < self.coverage * len(item):
                continue
            tiles = tile(item, _near(words, np.unique(places), least), least)
            covered = sum(x[2] for x in tiles) / len(item)
            if covered >= self.coverage:
                yield self.ids[group], covered, len(tiles), max(x[2] for x in tiles)


def _near(words: np.ndarray, places: np.ndarray, least: int) -> np.ndarray:
    """The words under seeds, runs kept apart by a gap: every match lies wholly in one run."""
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, places, 1)
    np.add.at(cover, places + least, -1) if places[-1] + least <= len(words) else None
    under = np.cumsum(cover)[: len(words)] > 0
    keep = np.flatnonzero(under)
    gaps = np.flatnonzero(np.diff(keep) > 1) + 1
    return np.insert(words[keep], gaps, NOTHING)


def blocks(tests: DataFrame, key: str, text: str, least: int, coverage: float, block_bytes: int = BLOCK_BYTES) -> Iterator[Items]:
    """The test items in blocks of about ``block_bytes``, however many there are."""
    rows = tests.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull())
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // block_bytes)
    for b in range(n):
        part = rows.where(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == b) if n > 1 else rows
        found = Items([tuple(r) for r in part.distinct().orderBy("k", "t").collect()], least, coverage)
        if found.ids:
            yield found


def contaminated(docs: DataFrame, tests: DataFrame, key: str = "doc_id", text: str = "text", test_key: str = "item_id",
                 test_text: str = "text", least: int = MIN_TILE, coverage: float = COVERAGE) -> DataFrame:
    """Pairs of a document and a test item it holds, whole or with its passages in another order.

    The test items are the stated set: they are taken in blocks of a fixed size,
    and each block goes once over all documents. Words (letters, digits, _) are
    compared in lower case. Seeds are the item's runs of ``least`` words; where a
    document shares enough of them, greedy string tiling gives the share of the
    item's words that lie under tiles. No row is shuffled.

    Columns: doc_id, item_id, coverage, n_tiles, longest.
    Defined cases: null and empty texts match nothing; items of fewer than
    ``least`` words are no evidence and are left out; a repeated document or item
    gives its pair again only for the document; empty tables give no rows.
    """
    columns = {"doc_id": "bigint", "item_id": "bigint", "coverage": "double", "n_tiles": "int", "longest": "int"}
    out = docs.sparkSession.createDataFrame([], ", ".join(f"{k} {v}" for k, v in columns.items()))
    slim = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    for block in blocks(tests, test_key, test_text, least, coverage):
        def search(keys: list, texts: list, block: Items = block) -> Iterator[tuple]:
            return ((keys[k], *found) for k, *found in block.search_all(texts))

        out = out.unionAll(map_rows(slim, search, **columns))
    return out


def clean(docs: DataFrame, tests: DataFrame, text: str = "text", test_key: str = "item_id", test_text: str = "text",
          least: int = MIN_TILE, coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` that hold no test item; all columns as they were.

    Whole texts are searched, of any length; null and empty ones hold none; repeated
    rows go or stay together; without test items all rows stay.
    """
    for block in blocks(tests, test_key, test_text, least, coverage):
        docs = keep_rows(docs, text, _free_of(block))
    return docs


def _free_of(block: Items) -> Callable[[list], list[bool]]:
    def free(texts: list) -> list[bool]:
        bad = {k for k, *_ in block.search_all(texts)}
        return [k not in bad for k in range(len(texts))]

    return free
