"""k-means over whole numbers with bounds loosened by planar geometry."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import map_rows, settle

#: Components of a vector, what one of them is multiplied by, clusters and rounds; fixed by the contract.
DIMENSIONS, SCALE, CLUSTERS, ROUNDS = 64, 256, 40, 5
#: Largest components for which doubles, and 64-bit integers, hold squared distances exactly.
DOUBLES, INTEGERS = 1 << 22, 1 << 27
#: What a bound computed in doubles may be off by, as a share of it.
SLIP = 1e-10
#: Vectors scanned at a time.
AT_ONCE = 4096


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster, by how much another centroid can have come nearer to one of its vectors.

    The vectors of cluster i lie in a sphere about its old centroid. Those that
    gain more than ``2a cos(phi)`` when another centroid moves by ``2a`` lie within
    one branch of a hyperbola whose foci are its two places, hence in the cone
    between the asymptotes: apex midway, axis along the move, half-angle phi. The
    axis and the centre of the sphere span a plane, and there the widest cone that
    misses the sphere is found: the centre's angle less that of the tangent.
    A sphere that holds the apex or meets the axis gets the full move.
    """
    move = new - old
    length = np.sqrt((move * move).sum(1))
    middle = (old + new) / 2
    away = old[:, None, :] - middle[None, :, :]
    far = np.sqrt((away * away).sum(2))
    with np.errstate(divide="ignore", invalid="ignore"):
        angle = np.arccos(np.clip((away * move[None]).sum(2) / (far * length[None]), -1, 1))
        tangent = np.arcsin(np.clip(radius[:, None] / far, 0, 1))
    phi = np.clip(angle - tangent, 0, np.pi / 2)
    gain = length[None] * np.where(far > radius[:, None], np.cos(phi), 1.0)
    gain = np.where(length[None] > 0, gain + SLIP * (length[None] + far), 0.0)  # rounded up
    np.fill_diagonal(gain, 0.0)
    return gain.max(1) if len(old) > 1 else np.zeros(1)


class Centroids:
    """Centroids of a round, and what a vector's bound has lost since the round before."""

    def __init__(self, places: list[list[int]], loss: np.ndarray | None = None):
        self.places, self.loss = places, loss
        self.exact = np.array(places, object).reshape(-1, DIMENSIONS)
        self.real = self.exact.astype(float)
        self.largest = max((abs(v) for p in places for v in p), default=0)
        apart = np.sqrt(((self.real[:, None] - self.real[None]) ** 2).sum(2))
        np.fill_diagonal(apart, np.inf)
        self.apart = apart.min(1, initial=np.inf) * (1 - SLIP)  # from the nearest other centroid

    def squares(self, x: np.ndarray) -> np.ndarray:
        """Exact squared distances of vectors to all centroids."""
        largest = max(self.largest, int(np.abs(x).max(initial=0)))
        if largest <= DOUBLES:
            a = x.astype(float)
            return ((a * a).sum(1)[:, None] - 2 * a @ self.real.T + (self.real**2).sum(1)[None]).astype(np.int64)
        kind = np.int64 if largest <= INTEGERS else object
        a, c = x.astype(kind), self.exact.astype(kind)
        return np.stack([((a - p) ** 2).sum(1) for p in c], 1)

    def own(self, x: np.ndarray, cluster: np.ndarray) -> np.ndarray:
        kind = np.int64 if max(self.largest, int(np.abs(x).max(initial=0))) <= INTEGERS else object
        gap = x.astype(kind) - self.exact.astype(kind)[cluster]
        return (gap * gap).sum(1)

    def assign(self, x: np.ndarray, cluster: np.ndarray | None, lower: np.ndarray | None) -> tuple:
        """Cluster, exact squared distance, lower bound of the distance to any other centroid, and who was scanned."""
        n = len(x)
        if cluster is None:
            cluster, square, lower, scan = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.ones(n, bool)
        else:
            square = self.own(x, cluster)
            upper, loss = np.sqrt(square.astype(float)) * (1 + SLIP), self.loss[cluster]
            lower = lower - loss - SLIP * (lower + loss)
            lower = np.maximum(lower, self.apart[cluster] - upper)
            scan = ~(upper < lower)
        if scan.any():
            every = self.squares(x[scan])
            nearest = every.argmin(1)
            best = every[np.arange(len(every)), nearest]
            square = square.astype(np.result_type(square, best))
            cluster[scan], square[scan] = nearest, best
            real = every.astype(float)
            real[np.arange(len(every)), nearest] = np.inf
            lower[scan] = np.sqrt(real.min(1)) * (1 - SLIP)
        return cluster, square, lower, scan


def vectors_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMENSIONS)


STATE = "vec_id bigint, q array<bigint>, cluster int, square string, lower double, scanned boolean"


def _assigned(state: DataFrame, centroids: Centroids) -> DataFrame:
    """All vectors against the centroids; those whose bound decides are not scanned."""
    sent, fresh = state.sparkSession.sparkContext.broadcast(centroids), "cluster" not in state.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(k, AT_ONCE)
                x = vectors_of(batch.column(1))
                known = (None, None) if fresh else (batch.column(2).to_numpy().astype(np.int64), batch.column(4).to_numpy().copy())
                cluster, square, lower, scan = sent.value.assign(x, *known)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array([str(v) for v in square.tolist()], pa.string()),
                    pa.array(lower, pa.float64()), pa.array(scan, pa.bool_())], names=["vec_id", "q", "cluster", "square", "lower", "scanned"])

    return settle(state.mapInArrow(run, STATE))


def _moved(state: DataFrame, now: Centroids) -> Centroids:
    """Centroids moved to the floor of their vectors' mean; sums and radii are added up in Spark."""
    def run(clusters: list, squares: list, vectors: list) -> Iterator[tuple]:
        sums: dict[int, list] = {}
        x = np.array(vectors, object if any(abs(v) > 1 << 40 for q in vectors for v in (min(q), max(q))) else np.int64)
        c, s = np.array(clusters), [int(v) for v in squares]
        for k in np.unique(c).tolist():
            at = np.flatnonzero(c == k)
            sums[k] = [int(v) for v in x[at].sum(0)]
            yield k, len(at), str(max(s[i] for i in at)), [str(v) for v in sums[k]]

    parts = map_rows(state.select("cluster", "square", "q"), run, 10_000, cluster="int", n="bigint", far="string", sums="array<string>")
    whole = "decimal(38,0)"
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.max(F.col("far").cast(whole)).alias("far"),
                                         *(F.sum(F.col("sums")[i].cast(whole)).alias(f"s{i}") for i in range(DIMENSIONS))).collect()
    places, radius = [list(p) for p in now.places], np.zeros(len(now.places))
    for r in total:
        places[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(DIMENSIONS)]
        radius[r["cluster"]] = np.sqrt(float(r["far"])) * (1 + SLIP)
    new = Centroids(places)
    new.loss = loosening(now.real, new.real, radius)
    return new


def kept(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Vectors of 64 finite components as whole numbers: vec_id, q."""
    rows = vectors.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
    whole = F.forall("x", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    rows = rows.where((F.size("x") == DIMENSIONS) & whole)
    return rows.select("vec_id", F.transform("x", lambda v: F.floor(v * SCALE)).alias("q"))


def cluster(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, seed: str = "2:") -> DataFrame:
    """Cluster of each vector after so many rounds of exact k-means, and the inertia of clusters and all.

    A vector carries the exact distance to its centroid and a lower bound of the
    distance to any other. When centroids move, the bound is loosened by what
    ``loosening`` allows, which is less than the largest move; only vectors that
    it leaves open are compared with all centroids. One pass over the vectors a
    round, nothing shuffled but sums of clusters; the state of a round is written,
    so a lost executor costs one round at most.

    Columns: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256,
    scanned (compared with all centroids in the last round).
    Defined cases: vectors null, of another length, or with null or non-finite
    components are left out; vectors without an id have a cluster but start none;
    rows repeated are vectors each; centroids that start at one place leave all to
    the smaller number; with fewer vectors than centroids there are as many as
    vectors; components beyond a 64-bit integer are its bounds, and a distance or
    an inertia beyond one is null; an empty table, or one without a vector that
    can start a cluster, gives no rows; other columns are not read.
    """
    state = settle(kept(vectors, key, vector))
    first = state.where("vec_id is not null").orderBy(F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256), "q").limit(k).collect()
    out = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string, scanned boolean"
    if not first:
        return vectors.sparkSession.createDataFrame([], out)
    now = Centroids([list(r["q"]) for r in first])
    for _ in range(rounds):
        state = _assigned(state, now)
        now = _moved(state, now)
    state = _assigned(state, now)
    sums = {r["cluster"]: int(r["d"]) for r in state.groupBy("cluster").agg(F.sum(F.col("square").cast("decimal(38,0)")).alias("d")).collect()}
    law = [(c, _long(d), _long(sum(sums.values())), hashlib.sha256(",".join(map(str, now.places[c])).encode()).hexdigest()) for c, d in sums.items()]
    law = vectors.sparkSession.createDataFrame(law, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return state.join(F.broadcast(law), "cluster").select(  # a row for each centroid
        "vec_id", "cluster", F.expr("try_cast(square as bigint)").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256", "scanned")


def _long(value: int) -> int | None:
    return value if value < 1 << 63 else None
