"""Interpolated modified Kneser-Ney language model: counted in Spark, stored as sorted arrays, memory-mapped by workers.

The model is of order two or three. Files of a model, in a folder all machines see:

* ``word-P.u64``, ``word-P.count``: hashes of words in order, P by P, and how often each occurs; a word's id is its
  place in all of them;
* ``cont-P.u64``: for the same words, after how many different words each occurs;
* ``pair-B.u64``, ``pair-B.n8``, ``pair-B.big``: pairs of ids (first << 32 | second) in order, in bucket B, and their counts;
  in a model of order three these are numbers of different words in front of the pair;
* ``first-B.u64``, ``first-B.u64x4``: first words of the pairs of the bucket: total and pairs seen once, twice, more often;
* ``triple-B.u64``, ``triple-B.n8``, ``triple-B.big``: place of the first two words in ``pair-B`` << 32 | third id, and counts.

A count is a byte; those of 255 and more stand in ``big`` as (place, count), so no count is cut. Words are known by 63 bits
of a hash: two words that share one count as one word.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import checkpoint_dir
from .common import crc_class, parts_of

#: Bytes of text that are cut into words at a time; a longer text is taken alone.
AT_ONCE = 4_000_000
#: Occurrences per bucket of pairs that are aimed at.
BUCKET = 6_000_000
#: A word with this share of all words has its pairs spread over the buckets; there are 1 / HOT such words at most.
HOT = 1e-3

SPACES = np.zeros(256, bool)
SPACES[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
FACTOR = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
END = np.uint64(1)  # no word hashes to it: words have the lowest bit clear
UNKNOWN = -1
#: Place of the first of the hot contexts of triples; they go down from here and are no places of pairs.
TOP = 0x7FFFFFFF
LOW = np.uint64(0xFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits; one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the factor and of its inverse; as many as the longest text has bytes."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def reach(cls, n: int) -> None:
        if len(cls.up) < n:
            n = 1 << (n - 1).bit_length()
            for name, f in (("up", FACTOR), ("down", pow(FACTOR, -1, 1 << 64))):
                x = np.full(n, f, np.uint64)
                x[0] = 1
                setattr(cls, name, np.multiply.accumulate(x))


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some texts, an end after each text, and the number of tokens of each.

    A word's hash is a polynomial of its bytes, taken from running sums over the
    joined texts, with its length mixed in.
    """
    raw = [t.encode() if t else b"" for t in texts]
    joined = LOWER[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
    Powers.reach(len(joined) + 1)
    space = SPACES[joined]
    edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * Powers.up[: len(joined)])])
    words = mixed((sums[stop] - sums[start]) * Powers.down[start] + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    words &= ~np.uint64(1)
    ends = np.cumsum([len(r) + 1 for r in raw])
    upto = np.searchsorted(start, ends)
    out = np.empty(len(words) + len(texts), np.uint64)
    at = upto + np.arange(len(texts))
    out[at] = END
    inside = np.ones(len(out), bool)
    inside[at] = False
    out[inside] = words
    return out, np.diff(at, prepend=-1)


def groups(texts: list[str | None]) -> Iterator[list[str | None]]:
    group, size = [], 0
    for t in texts:
        n = 4 * len(t) if t and not t.isascii() else len(t or "")
        if group and size + n > AT_ONCE:
            yield group
            group, size = [], 0
        group.append(t)
        size += n
    if group:
        yield group


def _save(path: str, x: np.ndarray) -> None:
    """Written aside and renamed, so a repeated task puts the same whole file in its place."""
    aside = f"{path}.{uuid.uuid4().hex}"
    with open(aside, "wb") as f:
        x.tofile(f)
    os.replace(aside, path)


def _load(path: str, kind: str) -> np.ndarray:
    return np.memmap(path, kind, "r") if os.path.getsize(path) else np.empty(0, kind)


def _save_counts(path: str, n: np.ndarray) -> None:
    big = np.flatnonzero(n >= 255)
    _save(f"{path}.n8", np.minimum(n, 255).astype(np.uint8))
    _save(f"{path}.big", np.stack([big, n[big]], 1).astype("<u8"))


def model_folder(spark: SparkSession) -> str:
    """A new folder for a model under ``spark.checkpoint.dir``, which has to be mounted where tasks run."""
    url = urlparse(checkpoint_dir(spark))
    if url.scheme not in ("", "file"):
        raise RuntimeError(f"workers map the model into memory: {url.scheme}:// has to be mounted as a folder for that")
    folder = f"{url.path}/kneser-ney/{uuid.uuid4().hex}"
    os.makedirs(folder)
    return folder


@dataclass
class Model:
    """What a worker needs to score: the place of the files and a few numbers."""

    folder: str
    firsts: np.ndarray  # first hash of each word file
    offsets: np.ndarray  # words before each word file, and in all
    train_tokens: int
    buckets: int = 1
    hot: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    hot_stats: np.ndarray = field(default_factory=lambda: np.empty((0, 4), np.int64))
    pair_discounts: tuple = (0.0, 0.0, 0.0)
    word_discounts: tuple = (0.0, 0.0, 0.0)
    pair_types: int = 0
    spare: float = 1.0  # what the discounts of words leave, in types
    order: int = 2
    hot_pairs: np.ndarray = field(default_factory=lambda: np.empty((0, 2), np.int64))  # bucket and place; after (begin, begin)
    hot_pair_stats: np.ndarray = field(default_factory=lambda: np.zeros((1, 4), np.int64))
    triple_discounts: tuple = (0.0, 0.0, 0.0)

    @property
    def words(self) -> int:
        return int(self.offsets[-1])

    @property
    def begin(self) -> int:
        """The id in front of the first word."""
        return self.words

    def file(self, name: str, kind: str) -> np.ndarray:
        key = (self.folder, name)
        if key not in _MAPPED:
            if len(_MAPPED) > 4096 or (_MAPPED and next(iter(_MAPPED))[0] != self.folder):
                _MAPPED.clear()
            _MAPPED[key] = _load(f"{self.folder}/{name}", kind)
        return _MAPPED[key]

    def counts(self, name: str, at: np.ndarray | None = None) -> np.ndarray:
        """Counts of the places ``at`` of a file, or all."""
        n, big = self.file(f"{name}.n8", "u1"), self.file(f"{name}.big", "<u8").reshape(-1, 2)
        if at is None:
            out = n.astype(np.int64)
            out[big[:, 0].astype(np.int64)] = big[:, 1]
            return out
        out = n[at].astype(np.int64)
        more = np.flatnonzero(out == 255)
        out[more] = big[np.searchsorted(big[:, 0], at[more].astype(np.uint64)), 1]
        return out

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of words, -1 for those not in training. ``hashes`` are looked up once each."""
        each, back = np.unique(hashes, return_inverse=True)
        out = np.full(len(each), UNKNOWN, np.int64)
        cuts = np.searchsorted(each, self.firsts[1:]) if len(self.firsts) else []
        for p, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(each)]) if len(self.firsts) else ()):
            known = self.file(f"word-{p}.u64", "<u8")
            if b > a and len(known):
                at = np.minimum(np.searchsorted(known, each[a:b]), len(known) - 1)
                out[a:b] = np.where(known[at] == each[a:b], self.offsets[p] + at, UNKNOWN)
        return out[back]

    def of_words(self, name: str, kind: str, ids: np.ndarray) -> np.ndarray:
        """Values of a word table for ids 0 and up."""
        out = np.zeros(len(ids), np.int64)
        part = np.searchsorted(self.offsets, ids, "right") - 1
        for p in np.unique(part):
            here = part == p
            out[here] = self.file(name.format(p), kind)[ids[here] - self.offsets[p]]
        return out

    def bucket(self, pairs: np.ndarray) -> np.ndarray:
        """The bucket of a pair: by its first word, for hot first words by both."""
        first = pairs >> np.uint64(32)
        hot = np.isin(first.astype(np.int64), self.hot)
        return (mixed(np.where(hot, pairs, first)) % np.uint64(self.buckets)).astype(np.int64)

    def word_probability(self, ids: np.ndarray) -> np.ndarray:
        """By the number of different words before a word; unknown words share what is left with all."""
        if not self.pair_types:
            return np.full(len(ids), 1.0 / (self.words + 1))
        n = np.zeros(len(ids), np.int64)
        n[ids >= 0] = self.of_words("cont-{}.u64", "<u8", ids[ids >= 0])
        less = np.array([0.0, *self.word_discounts])[np.minimum(n, 3)]
        return (np.maximum(n - less, 0) + self.spare / (self.words + 1)) / self.pair_types

    def probability(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """P(second | first) of pairs of ids."""
        total, weight, count = np.zeros(len(first)), np.ones(len(first)), np.zeros(len(first), np.int64)
        known = first >= 0
        pairs = (first.astype(np.uint64) << np.uint64(32)) | np.maximum(second, 0).astype(np.uint64)
        d = np.array(self.pair_discounts)
        at = np.flatnonzero(known)
        bucket = self.bucket(pairs[at])
        for b in np.unique(bucket):
            here = at[bucket == b]
            stats = np.zeros((len(here), 4), np.int64)
            rows, keys = self.file(f"first-{b}.u64x4", "<u8").reshape(-1, 4), self.file(f"first-{b}.u64", "<u8")
            if len(keys):
                k = np.minimum(np.searchsorted(keys, first[here].astype(np.uint64)), len(keys) - 1)
                good = keys[k] == first[here].astype(np.uint64)
                stats[good] = rows[k[good]]
            if len(self.hot):
                k = np.minimum(np.searchsorted(self.hot, first[here]), len(self.hot) - 1)
                good = self.hot[k] == first[here]
                stats[good] = self.hot_stats[k[good]]
            seen = stats[:, 0] > 0
            total[here] = stats[:, 0]
            weight[here[seen]] = (stats[seen, 1:] @ d) / stats[seen, 0]
            keys = self.file(f"pair-{b}.u64", "<u8")
            if len(keys):
                k = np.minimum(np.searchsorted(keys, pairs[here]), len(keys) - 1)
                count[here] = np.where((keys[k] == pairs[here]) & (second[here] >= 0), self.counts(f"pair-{b}", k), 0)
        less = np.array([0.0, *self.pair_discounts])[np.minimum(count, 3)]
        higher = np.divide(np.maximum(count - less, 0), total, out=np.zeros(len(first)), where=total > 0)
        return higher + weight * self.word_probability(second)

    def contexts(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Bucket and place of pairs as contexts of a third word; place -1 if not in training."""
        out = np.full((len(first), 2), UNKNOWN, np.int64)
        at = np.flatnonzero((first >= 0) & (second >= 0))
        pairs = (first[at].astype(np.uint64) << np.uint64(32)) | second[at].astype(np.uint64)
        bucket = self.bucket(pairs)
        for b in np.unique(bucket):
            keys = self.file(f"pair-{b}.u64", "<u8")
            here = bucket == b
            if len(keys):
                k = np.minimum(np.searchsorted(keys, pairs[here]), len(keys) - 1)
                out[at[here]] = np.stack([np.full(len(k), b), np.where(keys[k] == pairs[here], k, UNKNOWN)], 1)
        if len(self.hot_pairs):
            hot, code = self.hot_pairs[:, 0] << 32 | self.hot_pairs[:, 1], out[:, 0] << 32 | out[:, 1]
            h = np.minimum(np.searchsorted(hot, code), len(hot) - 1)
            out[:, 1] = np.where(hot[h] == code, TOP - 1 - h, out[:, 1])
        out[(first == self.begin) & (second == self.begin)] = (0, TOP)
        return out

    def triples(self, context: np.ndarray, third: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bucket and key of triples: with their context, triples of hot contexts by all words."""
        key = (context[:, 1].astype(np.uint64) << np.uint64(32)) | third.astype(np.uint64)
        spread = (mixed(key) % np.uint64(self.buckets)).astype(np.int64)
        return np.where(context[:, 1] >= TOP - len(self.hot_pairs), spread, context[:, 0]), key

    def triple_probability(self, context: np.ndarray, third: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """P(third | two words), with ``lower`` = P(third | the second of them)."""
        known = np.flatnonzero(context[:, 1] >= 0)
        context, third, out = context[known], third[known], lower.copy()
        bucket, key = self.triples(context, np.maximum(third, 0))
        count, stats = np.zeros(len(known), np.int64), np.zeros((len(known), 4), np.int64)
        hot = context[:, 1] >= TOP - len(self.hot_pairs)
        stats[hot] = self.hot_pair_stats[TOP - context[hot, 1]]
        for b in np.unique(bucket):
            here, keys = np.flatnonzero(bucket == b), self.file(f"triple-{b}.u64", "<u8")
            if not len(keys):
                continue
            k = np.minimum(np.searchsorted(keys, key[here]), len(keys) - 1)
            count[here] = np.where((keys[k] == key[here]) & (third[here] >= 0), self.counts(f"triple-{b}", k), 0)
            plain = here[~hot[here]]
            each, back = np.unique(context[plain, 1], return_inverse=True)
            stats[plain] = self.of_ranges(b, each)[back]
        seen = stats[:, 0] > 0
        less = np.array([0.0, *self.triple_discounts])[np.minimum(count, 3)]
        at, total = known[seen], stats[seen, 0]
        out[at] = (np.maximum(count - less, 0)[seen] + stats[seen, 1:] @ np.array(self.triple_discounts) * lower[at]) / total
        return out

    def of_ranges(self, b: int, places: np.ndarray) -> np.ndarray:
        """Total and triples seen once, twice, more often, for places of pairs in order."""
        keys = self.file(f"triple-{b}.u64", "<u8")
        lo = np.searchsorted(keys, places.astype(np.uint64) << np.uint64(32))
        hi = np.searchsorted(keys, places.astype(np.uint64) << np.uint64(32) | LOW, "right")
        some, out = np.flatnonzero(hi > lo), np.zeros((len(places), 4), np.int64)
        if len(some):
            lo, hi = lo[some], hi[some]
            n = np.append(self.file(f"triple-{b}.n8", "u1")[lo[0] : hi[-1]], np.uint8(0))
            cuts = np.stack([lo, hi], 1).ravel() - lo[0]
            out[some] = np.stack([np.add.reduceat(x, cuts, dtype=np.int64)[::2] for x in (n, n == 1, n == 2, n >= 3)], 1)
            big = self.file(f"triple-{b}.big", "<u8").reshape(-1, 2).astype(np.int64)
            of = np.minimum(np.searchsorted(hi, big[:, 0], "right"), len(hi) - 1)
            inside = (lo[of] <= big[:, 0]) & (big[:, 0] < hi[of])
            np.add.at(out, (some[of[inside]], 0), big[inside, 1] - 255)
        return out

    def words_of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the tokens of texts, the ids in front of them, whether a token is the first, and tokens of each text."""
        hashes, n = tokens(texts)
        ids, starts = self.ids(hashes), np.cumsum(n) - n
        before = np.concatenate([[self.begin], ids[:-1]])
        before[starts] = self.begin
        first = np.zeros(len(ids), bool)
        first[starts] = True
        return ids, before, first, n

    def score(self, texts: list[str | None]) -> list[tuple[int, int, float, float]]:
        """Tokens, known tokens, base score and score of each text."""
        out = []
        for group in groups(texts):
            ids, before, first, n = self.words_of(group)
            last = np.cumsum(n)
            pair = ((before + 1).astype(np.uint64) << np.uint64(32)) | (ids + 1).astype(np.uint64)
            each, back = np.unique(pair, return_inverse=True)
            one, two = (each >> np.uint64(32)).astype(np.int64) - 1, (each & np.uint64(0xFFFFFFFF)).astype(np.int64) - 1
            p = self.probability(one, two)
            if self.order == 3:
                places = np.concatenate([self.contexts(one, two), [[0, TOP]]])
                front = np.where(first, len(each), np.roll(back, 1))
                triple, back = np.unique(front * len(each) + back, return_inverse=True)
                front, now = np.divmod(triple, len(each))
                p = self.triple_probability(places[front], two[now], p[now])
            count = np.zeros(len(ids), np.int64)
            count[ids >= 0] = self.of_words("word-{}.count", "<u8", ids[ids >= 0])
            base = np.log10((count + 0.5) / (self.train_tokens + 0.5 * (self.words + 1)))
            at = np.concatenate([[0], last[:-1]])
            out += zip(n.tolist(), np.add.reduceat((ids >= 0).astype(np.int64), at).tolist(),
                       np.add.reduceat(base, at).tolist(), np.add.reduceat(np.log10(p)[back], at).tolist())
        return out


_MAPPED: dict[tuple[str, str], np.ndarray] = {}


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of types seen once to four times.

    Where a number is missing, as in tiny inputs, its discount is half the count.
    """
    y = n[0] / (n[0] + 2 * n[1]) if n[0] + n[1] else 0.0
    out = [k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] else (k + 1) / 2 for k in range(3)]
    return tuple(min(max(d, 0.05), k + 0.95) for k, d in enumerate(out))


def _batches(of_texts, names: dict[str, pa.DataType]):
    """Text batches to batches of arrays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = of_texts(batch.column(0).to_pylist())
            for k in range(0, len(arrays[0]), 200_000):
                yield pa.RecordBatch.from_pydict({n: pa.array(a[k : k + 200_000], t) for (n, t), a in zip(names.items(), arrays)})

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (key, n) batches to distinct keys and their sums; only one batch beside the result."""
    keys, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for batch in batches:
        k, n = batch.column("key").to_numpy(), batch.column("n").to_numpy()
        if not len(k):
            continue
        at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        k, n = k[at], np.add.reduceat(n, at)
        if len(keys[-1]) and keys[-1][-1] == k[0]:
            counts[-1][-1] += n[0]
            k, n = k[1:], n[1:]
        keys.append(k)
        counts.append(n)
    return np.concatenate(keys), np.concatenate(counts)


def train(docs: DataFrame, text: str = "text", order: int = 2) -> Model:
    """Count ``docs`` and write the model. What comes to the driver is a row for each file and each hot word or pair."""
    if order not in (2, 3):
        raise ValueError(f"a model is of order 2 or 3, not {order}")
    spark = docs.sparkSession
    folder, parts = model_folder(spark), parts_of(docs)
    texts = docs.select(F.col(text).alias("text"))

    def count_words(batch: list) -> tuple[np.ndarray, np.ndarray]:
        found = [np.unique(tokens(g)[0], return_counts=True) for g in groups(batch)]
        each, back = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
        return each.view(np.int64), np.bincount(back, np.concatenate([f[1] for f in found])).astype(np.int64)

    span = (1 << 64) // parts + 1

    def part_of(h: np.ndarray) -> np.ndarray:
        return (h.view(np.uint64) // np.uint64(span)).astype(np.int32)

    def counted(batch: list):
        h, n = count_words(batch) if batch else (np.empty(0, np.int64),) * 2
        return part_of(h), h ^ np.int64(-(1 << 63)), n  # so that signed order is the order of hashes

    kinds = {"part": pa.int32(), "key": pa.int64(), "n": pa.int64()}
    words = texts.mapInArrow(_batches(counted, kinds), "part int, key bigint, n bigint")
    words = words.groupBy("part", "key").agg(F.sum("n").alias("n")).repartitionById(parts, "part").sortWithinPartitions("key")

    def save_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [b for b in batches if b.num_rows]
        if whole:
            p = int(whole[0].column("part")[0].as_py())
            key, n = _merged(whole)
            h = (key ^ np.int64(-(1 << 63))).view(np.uint64)
            _save(f"{folder}/word-{p}.u64", h)
            _save(f"{folder}/word-{p}.count", n.astype("<u8"))
            yield pa.RecordBatch.from_pydict({"part": pa.array([p], pa.int32()), "words": pa.array([len(h)], pa.int64()), "total": pa.array([int(n.sum())], pa.int64())})

    saved = {r["part"]: r for r in words.mapInArrow(save_words, "part int, words bigint, total bigint").collect()}
    for p in range(parts):
        if p not in saved:
            for kind in ("u64", "count"):
                _save(f"{folder}/word-{p}.{kind}", np.empty(0, np.uint64))
    sizes = [saved[p]["words"] if p in saved else 0 for p in range(parts)]
    total = sum(r["total"] for r in saved.values())
    model = Model(folder, np.array([p * span for p in range(parts)], np.uint64), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), total, order=order)
    model.buckets = max(1, -(-total // BUCKET))
    if not total:
        _save_missing(folder, model.buckets)
        return model

    # hot first words: a word occurs as often as it stands first, but the end; texts begin as often as they end
    def find_hot(parts_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_:
            for p in batch.column(0).to_pylist():
                n = _load(f"{folder}/word-{p}.count", "<u8")
                at = np.flatnonzero(n >= HOT * total)
                yield pa.RecordBatch.from_pydict({"id": pa.array(model.offsets[p] + at, pa.int64())})

    every = spark.range(0, parts, 1, parts)
    hot = [r["id"] for r in every.mapInArrow(find_hot, "id bigint").collect()]
    model.hot = np.array(sorted({*hot, model.begin}), np.int64)

    def summed_keys(found: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket, key) and counts of each group of texts to those of the batch."""
        if not found:
            return (np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64))
        part, key, n = (np.concatenate(x) for x in zip(*found))
        by = np.lexsort((key, part))
        part, key, n = part[by], key[by], n[by]
        at = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
        return part[at].astype(np.int32), key[at].view(np.int64), np.add.reduceat(n, at).astype(np.int64)

    def count_pairs(batch: list):
        found = []
        for g in groups(batch):
            ids, before, _, _ = model.words_of(g)
            each, n = np.unique((before.astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64), return_counts=True)
            found.append((model.bucket(each), each, n))
        return summed_keys(found)

    pairs = texts.mapInArrow(_batches(count_pairs, kinds), "part int, key bigint, n bigint")
    pairs = pairs.repartitionById(model.buckets, "part").sortWithinPartitions("key")

    offsets = model.offsets
    if order == 3:
        pairs = _train_triples(model, texts, pairs, kinds, summed_keys)

    def save_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_batch = next((b for b in batches if b.num_rows), None)
        if first_batch is None:
            return
        b = int(first_batch.column("part")[0].as_py())

        def rest() -> Iterator[pa.RecordBatch]:
            yield first_batch
            yield from batches

        key, n = _merged(rest())
        _save(f"{folder}/pair-{b}.u64", key.view(np.uint64))
        _save_counts(f"{folder}/pair-{b}", n)
        first = key >> 32
        at = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
        stats = np.stack([np.add.reduceat(x.astype(np.int64), at) for x in (n, n == 1, n == 2, n >= 3)], 1)
        hot_here = np.isin(first[at], model.hot)
        _save(f"{folder}/first-{b}.u64", first[at][~hot_here].astype("<u8"))
        _save(f"{folder}/first-{b}.u64x4", stats[~hot_here].astype("<u8"))
        # kind 0: stats of hot words; kind 1: numbers of pairs seen 1 to 4 times, pairs in all; kind 2: pairs of each
        # second word, with the word file it belongs to
        second, types = np.unique(key & 0xFFFFFFFF, return_counts=True)
        of_counts = [int((n == k).sum()) for k in (1, 2, 3, 4)]
        h = np.flatnonzero(hot_here)
        yield from _stat_rows(0, first[at][h], stats[h])
        yield from _stat_rows(1, np.array([len(key)]), np.array([of_counts]))
        part = np.searchsorted(offsets, second, "right") - 1
        yield from _stat_rows(2, second, np.stack([types, part, 0 * types, 0 * types], 1))

    schema = "kind int, id bigint, a bigint, b bigint, c bigint, d bigint"
    stats_path = f"{checkpoint_dir(spark)}/kneser-ney-stats/{uuid.uuid4().hex}"
    pairs.mapInArrow(save_pairs, schema).write.partitionBy("kind").parquet(stats_path)
    stats = spark.read.schema(schema).parquet(stats_path)
    if order == 3:
        _learn_triples(spark, model)
    _save_missing(folder, model.buckets)

    summed = stats.where("kind = 0").groupBy("id").agg(*[F.sum(c).alias(c) for c in "abcd"]).collect()
    by_id = {r["id"]: [r[c] for c in "abcd"] for r in summed}
    model.hot_stats = np.array([by_id.get(int(i), [0, 0, 0, 0]) for i in model.hot], np.int64).reshape(-1, 4)
    row = stats.where("kind = 1").agg(F.sum("id"), *[F.sum(c) for c in "abcd"]).first()
    model.pair_types, model.pair_discounts = row[0], discounts(list(row)[1:])

    after = (stats.where("kind = 2").groupBy("b", "id").agg(F.sum("a").alias("n"))
             .select(F.col("b").cast("int").alias("part"), F.col("id").alias("key"), "n").repartitionById(parts, "part"))

    def save_after(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in batches:
            if batch.num_rows:
                if table is None:
                    p = int(batch.column("part")[0].as_py())
                    table = np.zeros(sizes[p], np.uint64)
                table[batch.column("key").to_numpy() - offsets[p]] = batch.column("n").to_numpy()
        if table is not None:
            _save(f"{folder}/cont-{p}.u64", table)
            yield from _stat_rows(p, np.array([int((table > 0).sum())]), np.array([[int((table == k).sum()) for k in (1, 2, 3, 4)]]))

    done = after.mapInArrow(save_after, schema).collect()
    for p in {*range(parts)} - {r["kind"] for r in done}:
        _save(f"{folder}/cont-{p}.u64", np.zeros(sizes[p], np.uint64))
    n = [sum(r[c] for r in done) for c in "abcd"]
    model.word_discounts = discounts(n)
    types = sum(r["id"] for r in done)
    d1, d2, d3 = model.word_discounts
    model.spare = d1 * n[0] + d2 * n[1] + d3 * (types - n[0] - n[1])
    return model


def _bucket_rows(batches: Iterator[pa.RecordBatch]) -> tuple[int, Iterator[pa.RecordBatch]] | None:
    """The bucket of a task and its rows, the first batch included; None without rows."""
    first = next((b for b in batches if b.num_rows), None)
    return None if first is None else (int(first.column("part")[0].as_py()), chain([first], batches))


def _train_triples(model: Model, texts: DataFrame, pairs: DataFrame, kinds: dict, summed_keys) -> DataFrame:
    """Writes the pairs that occur, then the triples; returns for each pair the number of different words in front of it."""
    folder, least = model.folder, HOT * model.train_tokens

    def save_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if some := _bucket_rows(batches):
            b, rows = some
            key, n = _merged(rows)
            _save(f"{folder}/pair-{b}.u64", key.view(np.uint64))
            hot = np.flatnonzero(n >= least)
            yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(len(hot), b), pa.int64()), "place": pa.array(hot, pa.int64())})

    hot = pairs.mapInArrow(save_keys, "part bigint, place bigint").collect()  # 1 / HOT rows at most
    model.hot_pairs = np.array(sorted(tuple(r) for r in hot), np.int64).reshape(-1, 2)
    _save_missing(folder, model.buckets, ("pair-{}.u64",))

    def count_triples(batch: list):
        found = []
        for g in groups(batch):
            ids, before, first, _ = model.words_of(g)
            pair, back = np.unique((before.astype(np.uint64) << np.uint64(32)) | ids.astype(np.uint64), return_inverse=True)
            one, two = (pair >> np.uint64(32)).astype(np.int64), (pair & LOW).astype(np.int64)
            places = np.concatenate([model.contexts(one, two), [[0, TOP]]])
            triple, n = np.unique(np.where(first, len(pair), np.roll(back, 1)) * len(pair) + back, return_counts=True)
            front, now = np.divmod(triple, len(pair))
            found.append((*model.triples(places[front], two[now]), n))
        return summed_keys(found)

    def save_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if some := _bucket_rows(batches):
            b, rows = some
            key, n = _merged(rows)
            _save(f"{folder}/triple-{b}.u64", key.view(np.uint64))
            _save_counts(f"{folder}/triple-{b}", n)
            place, second = key >> 32, np.full(len(key), model.begin, np.uint64)
            plain, hot = place < TOP - len(model.hot_pairs), (place >= TOP - len(model.hot_pairs)) & (place < TOP)
            second[plain] = model.file(f"pair-{b}.u64", "<u8")[place[plain]] & LOW
            of_hot = np.array([model.file(f"pair-{of}.u64", "<u8")[at] & LOW for of, at in model.hot_pairs], np.uint64)
            second[hot] = of_hot[TOP - 1 - place[hot]]
            pair, n = np.unique((second << np.uint64(32)) | (key.view(np.uint64) & LOW), return_counts=True)
            part = model.bucket(pair).astype(np.int32)
            for k in range(0, len(pair), 200_000):
                at = slice(k, k + 200_000)
                yield pa.RecordBatch.from_pydict({"part": pa.array(part[at]), "key": pa.array(pair[at].view(np.int64)), "n": pa.array(n[at], pa.int64())})

    rows = "part int, key bigint, n bigint"
    triples = texts.mapInArrow(_batches(count_triples, kinds), rows).repartitionById(model.buckets, "part").sortWithinPartitions("key")
    return triples.mapInArrow(save_triples, rows).repartitionById(model.buckets, "part").sortWithinPartitions("key")


def _learn_triples(spark: SparkSession, model: Model) -> None:
    """Discounts of the triples and what follows the hot contexts, from the written files."""
    _save_missing(model.folder, model.buckets, ("triple-{}.u64", "triple-{}.n8", "triple-{}.big"))
    hot = TOP - np.arange(len(model.hot_pairs) + 1)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.column(0).to_pylist():
                n = model.counts(f"triple-{b}")
                yield from _stat_rows(-1, np.zeros(1, np.int64), np.array([[int((n == k).sum()) for k in (1, 2, 3, 4)]]))
                yield from _stat_rows(0, hot, model.of_ranges(b, hot[::-1])[::-1])

    schema = "kind int, id bigint, a bigint, b bigint, c bigint, d bigint"
    found = spark.range(0, model.buckets, 1, model.buckets).mapInArrow(read, schema)
    rows = {(r["kind"], r["id"]): [r[c] for c in "abcd"] for r in found.groupBy("kind", "id").agg(*[F.sum(c).alias(c) for c in "abcd"]).collect()}
    model.triple_discounts = discounts(rows[-1, 0])
    model.hot_pair_stats = np.array([rows[0, int(h)] for h in hot], np.int64)


def _stat_rows(kind: int, ids: np.ndarray, stats: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(ids), 200_000):
        part = stats[k : k + 200_000]
        yield pa.RecordBatch.from_pydict({
            "kind": pa.array(np.full(len(part), kind), pa.int32()), "id": pa.array(ids[k : k + 200_000], pa.int64()),
            **{c: pa.array(part[:, j], pa.int64()) for j, c in enumerate("abcd")}})


PAIR_FILES = ("pair-{}.u64", "pair-{}.n8", "pair-{}.big", "first-{}.u64", "first-{}.u64x4")


def _save_missing(folder: str, buckets: int, names: tuple[str, ...] = PAIR_FILES) -> None:
    for b in range(buckets):
        for name in names:
            path = f"{folder}/{name.format(b)}"
            if not os.path.exists(path):
                _save(path, np.empty(0, np.uint64))


def score_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", classes: int = 5, held: int = 1,
                    order: int = 2) -> DataFrame:
    """Score every whole text with a model of ``order`` 2 or 3 of those whose crc32(key) mod ``classes`` is not ``held``.

    Columns: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    perplexity (of a token). Scores are base-10 logarithms.
    Defined cases: a null or empty text is its end alone; rows with a null key are
    in training; repeated rows count as often as they stand; without training
    rows all words are unknown and equally likely; other columns are not read.
    """
    slim = docs.select(F.col(key).alias("doc_id"), (crc_class(key, classes) == held).alias("held_out"), F.col(text).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(train(slim.where(~F.col("held_out")), order=order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            rows = model.score(batch.column(2).to_pylist())
            n, known, base, score = zip(*rows) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(known, pa.int64()),
                pa.array([model.train_tokens] * len(n), pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()),
                pa.array([10 ** min(-s / k, 300.0) for s, k in zip(score, n)], pa.float64())],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return slim.mapInArrow(run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
                                "base_score double, score double, perplexity double")
