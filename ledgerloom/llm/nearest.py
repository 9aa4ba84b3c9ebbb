"""Approximate nearest neighbours by multi-index hashing of learned binary codes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import settle

#: Bits of a code, and the substrings it is indexed by.
BITS, SUBSTRINGS = 64, 4
#: Vectors that rotation and radius are learnt from, and those of them asked as queries.
SAMPLE, ASKED = 20_000, 500
#: Recall that the radius is chosen for, on the sample.
AIM = 0.97
#: Queries that go over all rows at once.
BLOCK = 8_192
#: Rounds in which the rotation is fitted.
ROUNDS = 40


class Coder:
    """Rotation of the leading directions so that signs lose least (iterative quantisation)."""

    def __init__(self, sample: np.ndarray, longest: float, seed: int = 7):
        self.longest = longest
        x = self.lifted(sample)
        directions = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :BITS]
        if directions.shape[1] < BITS:  # fewer components than bits: take them again, rotated otherwise
            directions = np.tile(directions, -(-BITS // directions.shape[1]))[:, :BITS]
        p = x @ directions
        turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(BITS, BITS)))[0]
        for _ in range(ROUNDS):
            u, _, vt = np.linalg.svd(np.where(p @ turn > 0, 1.0, -1.0).T @ p)
            turn = (u @ vt).T
        self.project = directions @ turn
        self.radius = BITS

    def lifted(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """One more component, with which the largest inner product is the smallest angle."""
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.longest**2 - (x * x).sum(1), 0))
        return np.concatenate([x, rest[:, None]], 1)

    def codes(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        bits = self.lifted(x, query) @ self.project > 0
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()

    def choose_radius(self, sample: np.ndarray, k: int) -> None:
        """The smallest radius that finds ``AIM`` of the ``k`` nearest among the sample.

        Among more rows the ``k`` nearest lie nearer, so the recall there is no lower.
        """
        asked = sample[:ASKED]
        score = asked @ sample.T
        score[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
        k = min(k, len(sample) - 1)
        if k < 1:
            return
        top = np.argpartition(-score, k - 1, axis=1)[:, :k]
        far = np.bitwise_count(self.codes(asked, True)[:, None] ^ self.codes(sample)[top])
        self.radius = int(np.quantile(far, AIM, method="inverted_cdf"))


def substring_radii(radius: int) -> list[int]:
    """By the pigeonhole rule: a code within ``radius`` is within one of these in its substring (-1: not probed)."""
    each, more = divmod(radius, SUBSTRINGS)
    return [each if j <= more else each - 1 for j in range(SUBSTRINGS)]


class Table:
    """One substring of many codes: its values, and the rows that hold each."""

    WIDTH = BITS // SUBSTRINGS

    def __init__(self, codes: np.ndarray, j: int):
        part = ((codes >> np.uint64(j * self.WIDTH)) & np.uint64((1 << self.WIDTH) - 1)).astype(np.int64)
        self.rows = np.argsort(part, kind="stable")
        self.values, self.first = np.unique(part[self.rows], return_index=True)
        self.until = np.append(self.first[1:], len(part))

    def probe(self, value: int, radius: int, masks: list[np.ndarray]) -> np.ndarray:
        """Rows whose substring is within ``radius``: looks each near value up or, if these are more, goes through those that occur."""
        if radius < 0 or not len(self.values):
            return np.empty(0, np.int64)
        if sum(len(m) for m in masks[: radius + 1]) < len(self.values):
            near = value ^ np.concatenate(masks[: radius + 1])
            at = np.minimum(np.searchsorted(self.values, near), len(self.values) - 1)
            at = at[self.values[at] == near]
        else:
            at = np.flatnonzero(np.bitwise_count(self.values ^ value) <= radius)
        n = self.until[at] - self.first[at]
        return self.rows[np.repeat(self.until[at] - np.cumsum(n), n) + np.arange(n.sum())]


def ball(width: int, radius: int) -> list[np.ndarray]:
    return [np.array([sum(1 << b for b in c) for c in combinations(range(width), k)], np.int64) for k in range(radius + 1)]


def matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimensions)


class Search:
    """A block of queries against the rows of a task; the ``k`` best of each query are kept."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, coder: Coder, radius: int, k: int):
        self.ids, self.vectors, self.coder, self.radius, self.k = ids, vectors, coder, radius, k
        self.codes = coder.codes(vectors, True)

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_id = [np.empty(0, np.int64)] * len(self.ids)
        best = [np.empty(0)] * len(self.ids)
        radii = substring_radii(self.radius)
        masks = ball(Table.WIDTH, min(max(radii), 4))  # larger balls are never enumerated
        masks += [np.empty(1 << Table.WIDTH, np.int64)] * (max(radii) + 1 - len(masks))
        for batch in batches:
            ids = batch.column(0).to_numpy()
            x = matrix(batch.column(1), self.vectors.shape[1])
            codes = self.coder.codes(x)
            tables = [Table(codes, j) for j in range(SUBSTRINGS)]
            for q in range(len(self.ids)):
                code = int(self.codes[q])
                found = np.zeros(len(ids), bool)
                for j, t in enumerate(tables):
                    found[t.probe(code >> (j * Table.WIDTH) & ((1 << Table.WIDTH) - 1), radii[j], masks)] = True
                c = np.flatnonzero(found)
                c = c[np.bitwise_count(codes[c] ^ self.codes[q]) <= self.radius]
                c = c[ids[c] != self.ids[q]]
                if not len(c):
                    continue
                score = x[c] @ self.vectors[q]
                all_ids, all_scores = np.append(best_id[q], ids[c]), np.append(best[q], score)
                order = np.lexsort((all_ids, -all_scores))[: self.k]
                best_id[q], best[q] = all_ids[order], all_scores[order]
        n = [len(b) for b in best]
        for k in range(0, len(n), 1024):
            yield pa.RecordBatch.from_pydict({
                "query_id": pa.array(np.repeat(self.ids[k : k + 1024], n[k : k + 1024]), pa.int64()),
                "vec_id": pa.array(np.concatenate(best_id[k : k + 1024]), pa.int64()),
                "score": pa.array(np.concatenate(best[k : k + 1024]), pa.float64())})


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows that take part: vec_id, x (array<double>), norm."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    square = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)  # null or NaN if a component is
    rows = rows.where(F.col("vec_id").isNotNull()).withColumn("norm", F.sqrt(square))
    return rows.where((F.col("norm") > 0) & (F.col("norm") < float("inf")))


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows, by inner product, of each row whose key is divisible by ``every``.

    Codes of 64 bits come from a rotation learnt on ``SAMPLE`` rows; all rows are
    indexed. Each task builds the substring tables of its rows, probes them for a
    block of queries, keeps the rows within the Hamming radius and scores those on
    their vectors; only the ``k`` best of a query and task are shuffled. Queries
    that found fewer than ``k`` go once more with the radius at its largest.

    Columns: query_id, rank, vec_id, score.
    Defined cases: vectors null, zero, with null or non-finite components, or of
    another length than the most common one take no part; rows repeated with one
    vec_id are candidates each, but not of their own query, which the least of
    their vectors asks (component by component); ties go to the smaller vec_id; an empty table gives no rows; other columns are not read.
    """
    rows = usable(vectors, key, vector)
    sizes = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"), F.max("norm").alias("longest"))
    most = sizes.orderBy(F.desc("n"), "d").first()
    schema = "query_id bigint, vec_id bigint, score double"
    found = vectors.sparkSession.createDataFrame([], schema)
    if most:
        d, n, longest = most
        rows = settle(rows.where(F.size("x") == d).select("vec_id", "x"))
        share = min(1.0, SAMPLE / n)
        picked = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(2**32)) < int(share * 2**32)).orderBy(F.xxhash64("vec_id"), "vec_id")
        sample = np.array([r["x"] for r in picked.select("x").limit(2 * SAMPLE).collect()]).reshape(-1, d)
        coder = Coder(sample, longest)
        coder.choose_radius(sample, k)
        queries = rows.where(F.col("vec_id") % every == 0)
        asked = queries.select("vec_id").distinct().count()
        found = settle(_ask(rows, queries, asked, coder, coder.radius, k, schema))
        enough = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
        again = settle(queries.join(enough, queries.vec_id == enough.query_id, "left_anti"))
        short = again.select("vec_id").distinct().count()
        if short:
            more = _ask(rows, again, short, coder, BITS, k, schema)
            found = found.join(again, found.query_id == again.vec_id, "left_anti").unionAll(more)
    nth = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(nth)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _ask(rows: DataFrame, queries: DataFrame, asked: int, coder: Coder, radius: int, k: int, schema: str) -> DataFrame:
    """All rows for each block of about ``BLOCK`` queries; a block's results are no one else's."""
    out, n = [], max(1, -(-asked // BLOCK))
    for b in range(n):
        block = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(n)) == b).groupBy("vec_id").agg(F.min("x").alias("x")).orderBy("vec_id").collect()
        if block:
            ids, x = np.array([r["vec_id"] for r in block]), np.array([r["x"] for r in block], np.float64)
            sent = rows.sparkSession.sparkContext.broadcast(Search(ids, x, coder, radius, k))
            out.append(rows.mapInArrow(lambda batches, sent=sent: sent.value.run(batches), schema))
    return reduce(DataFrame.unionAll, out) if out else rows.sparkSession.createDataFrame([], schema)
