"""SimHash fingerprints of documents and near-duplicate groups by the generalised pigeonhole rule."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import ARROW, map_rows, settle, told_apart

BITS = 64
#: Shingles hashed at a time.
AT_ONCE = 1 << 16
#: Least hashes of a band, and bands: two sets of Jaccard similarity s share a band with probability 1 - (1 - s**4)**24.
ROWS, BANDS = 4, 24
#: Least hashes, of all of them, that texts verified on their shingles have in common; at 0.8 fewer have a chance of 1e-7.
ALIKE = 56
#: Texts compared at a time with as many others.
PIECE = 256
#: Rows of a file of nodes, with their bands, and of shingle sets.
NODES, SETS = 50_000, 5_000
SALTS, FACTORS = np.random.default_rng(42).integers(0, 1 << 64, (2, ROWS * BANDS), np.uint64)


def fingerprint(text: str | None, words: int = 3, seed: int = 42, once: bool = False) -> int:
    """64-bit SimHash of the shingles of ``words`` words; ASCII letters in lower case.

    A bit is set if it is set in more than half of the shingle hashes, repeats
    counted, or with ``once`` each shingle counted once. Fewer words make one
    shingle; no words give zero.
    """
    tokens = (text or "").encode().lower().split()  # bytes: splits at ASCII white space, lowers A-Z
    if not tokens:
        return 0
    if once and words == 1:
        tokens = list(dict.fromkeys(tokens))
    joined = b" ".join(tokens)
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate([[0], spaces + 1])
    ends = np.concatenate([spaces, [len(joined)]])
    n = max(1, len(tokens) - words + 1)
    starts, ends = starts[:n].tolist(), ends[-n:].tolist()
    ones, hash_of = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for k in range(0, n, AT_ONCE):
        h = np.array([hash_of(joined[a:b], seed) for a, b in zip(starts[k : k + AT_ONCE], ends[k : k + AT_ONCE])], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and its fingerprint as a signed 64-bit integer."""
    def run(keys: list, texts: list) -> Iterator[tuple]:
        for k, t in zip(keys, texts):
            f = fingerprint(t)
            yield k, f - (1 << 64) if f >> 63 else f

    return map_rows(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), run, doc_id="bigint", fp="bigint")


def _tally(codes: DataFrame, count, size: int) -> np.ndarray:
    """``count`` of each batch of codes, added up: a vector of fixed length, whatever the input."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += count(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"k": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    out = np.zeros(size, np.int64)
    for k, n in codes.select("fp").mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n")).collect():
        out[k] = n
    return out


def bits_of(codes: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(codes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def co_occurrence(codes: np.ndarray) -> np.ndarray:
    total = np.zeros((BITS, BITS))
    for k in range(0, len(codes), AT_ONCE):
        b = bits_of(codes[k : k + AT_ONCE]).astype(np.float32)
        total += b.T @ b
    return np.rint(total).astype(np.int64).ravel()


def group_bits(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Partition the bits so that correlated ones share a part.

    What correlated bits say is said once then, and the other parts stay
    selective. Each part grows from the bit most correlated with the rest, by the
    bit most correlated with the part; ties go to the lower bit.
    """
    both = together.reshape(BITS, BITS) / max(n, 1)
    ones = np.diag(both)
    spread = np.sqrt(np.maximum(ones * (1 - ones), 1e-12))
    link = np.abs((both - np.outer(ones, ones)) / np.outer(spread, spread))
    np.fill_diagonal(link, 0)
    left, out = list(range(BITS)), []
    for p in range(parts):
        width = len(left) // (parts - p)
        part = [max(left, key=lambda b: (link[b, left].sum(), -b))]
        while len(part) < width:
            part.append(max((b for b in left if b not in part), key=lambda b: (link[b, part].sum(), -b)))
        out.append(sorted(part))
        left = [b for b in left if b not in part]
    return out


def _value(bits: np.ndarray, at: list[int]) -> np.ndarray:
    out = np.zeros(len(bits), np.int64)
    for k, b in enumerate(at):
        out |= bits[:, b].astype(np.int64) << k
    return out


class Index:
    """How fingerprints are probed: parts of correlated bits and, for each code, a threshold for each part."""

    BLOCK = 8  # bits of a block whose values are counted

    def __init__(self, parts: list[list[int]], radius: int):
        self.parts, self.radius = parts, radius
        self.blocks = [[p[k : k + self.BLOCK] for k in range(0, len(p), self.BLOCK)] for p in parts]
        self.flat = [b for p in self.blocks for b in p]
        self.near: list[np.ndarray] = []
        self.n = 0
        #: Masks of the bits to turn over, by part and number of bits.
        self.masks = [[np.array([sum(1 << b for b in c) for c in combinations(range(len(p)), k)], np.int64)
                       for k in range(radius + 1)] for p in parts]

    def histogram(self, codes: np.ndarray) -> np.ndarray:
        bits = bits_of(codes)
        return np.concatenate([np.bincount(_value(bits, b), minlength=256) for b in self.flat])

    def learn(self, histogram: np.ndarray, n: int) -> None:
        """Share of all codes at each distance from each value of a block."""
        gap = np.bitwise_count(np.arange(256)[:, None] ^ np.arange(256)[None, :])
        for k in range(len(self.flat)):
            h = histogram[256 * k : 256 * k + 256] / max(n, 1)
            self.near.append(np.stack([(h[None, :] * (gap == d)).sum(1) for d in range(self.radius + 1)], 1))
        self.n = n

    def thresholds(self, bits: np.ndarray) -> np.ndarray:
        """A threshold for each part, -1 for none, that add up to radius - parts + 1.

        Two codes within the radius are then within the threshold in one part at
        least. Dynamic programming takes the allocation with the lowest sum of
        probes and estimated candidates; blocks of a part count as independent.
        """
        r, m, n = self.radius, len(self.parts), len(bits)
        best = np.full((n, r + 2), np.inf)  # by what the thresholds so far, each plus one, add up to
        best[:, 0] = 0
        took, k = [], 0
        for p in range(m):
            far = np.zeros((n, r + 1))
            far[:, 0] = 1
            for block in self.blocks[p]:
                near = self.near[k][_value(bits, block)]
                k += 1
                far = np.stack([sum(far[:, i] * near[:, d - i] for i in range(d + 1)) for d in range(r + 1)], 1)
            probes = np.cumsum([len(x) for x in self.masks[p]])
            cost = np.concatenate([np.zeros((n, 1)), self.n * np.cumsum(far, 1) + probes], 1)
            options = np.full((n, r + 2, r + 2), np.inf)
            for s in range(r + 2):
                for t in range(s + 1):
                    options[:, s, t] = best[:, s - t] + cost[:, t]
            took.append(options.argmin(2))
            best = options.min(2)
        out, left = np.empty((n, m), np.int64), np.full(n, r + 1)
        for p in range(m - 1, -1, -1):
            t = took[p][np.arange(n), left]
            out[:, p], left = t - 1, left - t
        return out

    def entries(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The key of each part of each code, and the code."""
        bits, m = bits_of(codes), len(self.parts)
        return np.concatenate([_value(bits, p) * m + k for k, p in enumerate(self.parts)]), np.tile(codes, m)

    def probes(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All keys within the thresholds of each code, and the code."""
        bits, m = bits_of(codes), len(self.parts)
        limit, keys, own = self.thresholds(bits), [], []
        for p, at in enumerate(self.parts):
            value = _value(bits, at)
            for d, masks in enumerate(self.masks[p]):
                rows = np.flatnonzero(limit[:, p] >= d)
                keys.append(((value[rows][:, None] ^ masks[None, :]) * m + p).ravel())
                own.append(np.repeat(codes[rows], len(masks)))
        return np.concatenate(keys), np.concatenate(own)


def _keys(codes: DataFrame, of, name: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, code = of(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            for k in range(0, len(key), AT_ONCE):
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array(key[k : k + AT_ONCE], pa.int64()), name: pa.array(code[k : k + AT_ONCE].view(np.int64), pa.int64())})

    return codes.select("fp").mapInArrow(run, f"key bigint, {name} bigint")


def parts_for(n: int, radius: int) -> int:
    """The number of parts with the least work for each of ``n`` codes.

    With more parts a code needs fewer probes, but each finds ``n`` / 2**width
    others by chance; so the larger the input, the wider the parts. A probe, which
    is shuffled and sorted, counts as much as four candidates.
    """
    def work(parts: int) -> float:
        each, more = divmod(radius - parts + 1, parts)
        out = 0.0
        for p in range(parts):
            width = (BITS + p) // parts
            probes = sum(comb(width, k) for k in range(each + (p < more) + 1))
            out += probes * (4 + n / 2.0**width)
        return out

    return min(range(2, min(radius + 1, 8) + 1), key=work)


def links(codes: DataFrame, radius: int = 3) -> DataFrame:
    """Pairs a > b of different fingerprints (column ``fp``, distinct) at ``radius`` or fewer differing bits."""
    n = codes.count()
    parts = parts_for(n, radius)
    index = Index(group_bits(_tally(codes, co_occurrence, BITS * BITS), n, parts), radius)
    index.learn(_tally(codes, index.histogram, 256 * len(index.flat)), n)
    probes, entries = _keys(codes, index.probes, "a"), _keys(codes, index.entries, "b")
    near = (F.col("a") > F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    return probes.join(entries, "key").where(near).select("a", "b").distinct()


def components(edges: DataFrame, about: int | None = None) -> DataFrame:
    """Connected components of pairs a > b: ``node`` and ``root``, its smallest member, for all nodes but roots.

    Large-star and small-star rounds: each node's neighbours are hung on the
    smallest of them, until every component is a star. The rounds grow with the
    logarithm of the size; each is written to the shared folder (``about``: see ``settle``).
    """
    now, before = settle(edges, about), None
    while True:
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(
            F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a")
        small = hung.select("a", F.col("m").alias("b")).unionAll(
            hung.where(F.col("b") > F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        now = settle(small, about)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 3) -> DataFrame:
    """Each document's fingerprint and component: doc_id, fingerprint (16 hex digits), component_id.

    Documents with one fingerprint are one class, so copies are never paired.
    Classes are linked over ``links`` and joined to components; component_id is
    the smallest doc_id in reach.
    Defined cases: null, empty and blank texts have fingerprint zero and are
    linked like any other; repeated rows give repeated results; a row with a null
    key belongs to its component without naming it; an empty table gives no rows.
    """
    marked = settle(fingerprints(docs, key, text))
    classes = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(classes, radius))
    rooted = classes.join(found, classes.fp == found.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    member = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(member, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingles(text: str | None, words: int) -> list[int]:
    """Hashes of the different shingles of a text, in order; fewer words make one shingle."""
    tokens = (text or "").encode().lower().split()
    found = {xxhash.xxh64_intdigest(b" ".join(tokens[k : k + words])) for k in range(max(1, len(tokens) - words + 1))}
    return sorted(h - (1 << 64) if h >> 63 else h for h in found)


def least_hashes(found: list[int]) -> np.ndarray:
    """The least hash of different shingles under each of ``ROWS * BANDS`` orders."""
    h, least = np.array(found, np.int64).view(np.uint64), np.full(ROWS * BANDS, (1 << 64) - 1, np.uint64)
    for k in range(0, len(h), AT_ONCE):
        part = h[k : k + AT_ONCE]
        for i, (salt, factor) in enumerate(zip(SALTS, FACTORS | np.uint64(1))):
            least[i] = min(least[i], ((part ^ salt) * factor).min())
    return least


def bands(least: np.ndarray) -> list[int]:
    """A hash for each band of ``ROWS`` least hashes."""
    return [xxhash.xxh64_intdigest(band.tobytes(), k) - (1 << 63) for k, band in enumerate(least.reshape(BANDS, ROWS))]


def page_of(text: str) -> Column:
    """What a text is known by; null is the empty text."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


class Cell:
    """Texts of one key: those of side 0 are compared with those of side 1, or with each other where there are none."""

    def __init__(self, rows: dict[str, list]):
        self.node, self.root, self.n = (np.array(rows[name], np.int64) for name in ("node", "root", "n"))
        self.hashes = [np.frombuffer(b, np.int64) for b in rows.get("hashes", ())]
        self.least = np.frombuffer(b"".join(rows["least"]), np.uint16).reshape(len(self.node), -1)
        self.side = np.array(rows["side"])
        self.left, self.right = np.flatnonzero(self.side == 0), np.flatnonzero(self.side == 1)

    def tasks(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each text of side 0 and those it is to be compared with."""
        for k, i in enumerate(self.left):
            yield i, self.right if len(self.right) else self.left[k + 1 :]

    def alike(self, i: int, others: np.ndarray, similarity: float) -> np.ndarray:
        """Those of ``others`` with another root that sizes and least hashes do not rule out."""
        fits = np.minimum(self.n[others], self.n[i]) >= similarity * np.maximum(self.n[others], self.n[i])
        others = others[fits & (self.root[others] != self.root[i])]
        return others[(self.least[others] == self.least[i]).sum(1) >= ALIKE]

    def open(self, similarity: float) -> list[np.ndarray]:
        """Texts that are alike with another one, in sets with no alike pair between two of them; asks for no shingles."""
        least, found = np.arange(len(self.node)), np.zeros(len(self.node), bool)
        for i, others in self.tasks():
            others = self.alike(i, others, similarity)
            if len(others):
                found[i] = found[others] = True
                joined = np.append(least[others], least[i])
                least[np.isin(least, joined)] = joined.min()
        return [np.flatnonzero(found & (least == k)) for k in np.unique(least[found])]

    def links(self, similarity: float) -> list[tuple[int, int]]:
        """Links that join what is not joined yet; texts of one root are not compared."""
        found = []
        for i, others in self.tasks():
            for j in self.alike(i, others, similarity):
                if self.root[j] != self.root[i]:
                    common = len(np.intersect1d(self.hashes[i], self.hashes[j], assume_unique=True))
                    if common >= similarity * (self.n[i] + self.n[j] - common):
                        found.append((int(self.node[i]), int(self.node[j])))
                        self.root[self.root == self.root[j]] = self.root[i]
        return found


def _by_cell(rows: DataFrame, key: list[str], of: Callable[[Cell], dict[str, list]], **columns: str) -> DataFrame:
    """What ``of`` makes of the texts of each cell; a cell holds two pieces at most."""
    names, schema = rows.columns, pa.schema([(name, ARROW[kind]) for name, kind in columns.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cell = None, {n: [] for n in names}

        def done() -> Iterator[pa.RecordBatch]:
            if len(cell["node"]) > 1:
                yield pa.RecordBatch.from_pydict(of(Cell(cell)), schema)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[: len(key)] != now:
                    yield from done()
                    now, cell = row[: len(key)], {n: [] for n in names}
                for n, v in zip(names, row):
                    cell[n].append(v)
        yield from done()

    return rows.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, ", ".join(f"{n} {k}" for n, k in columns.items()))


def _gathered(sets: DataFrame, about: int | None = None) -> DataFrame:
    """Fewer cells in which all texts of each set meet: cell, side, node, root of sets with cell, low, side, node, root.

    Sets that share a text come under one name, by the least text two steps away.
    Of one name the texts make one cell, each text once, unless they are more
    than two pieces; those sets stay cells of their own.
    """
    near = sets.groupBy("node").agg(F.min("low").alias("near"))
    name = sets.join(near, "node").groupBy("cell").agg(F.min("near").alias("name"))
    named = settle(sets.join(name, "cell"), about)
    texts = named.select("name", "node", "root").distinct()
    small = settle(texts.groupBy("name").agg(F.count("*").alias("of")).where(F.col("of") <= 2 * PIECE).select("name"), about)
    one = texts.join(small, "name").select(F.col("name").cast("string").alias("cell"), F.lit(0).alias("side"), "node", "root")
    return one.unionAll(named.join(small, "name", "left_anti").select("cell", "side", "node", "root"))


def compared(rows: DataFrame, key: list[str], sets: DataFrame, similarity: float, about: int) -> DataFrame:
    """Links a > b found in the cells of ``key``: rows with side, node and root, of at most two pieces a cell.

    Sizes and least hashes are sent to the cells first. Only texts that these
    leave open are sent again, with the hashes of their shingles. Sets of open
    texts overlap, as one pair is in several cells; see ``_gathered``.
    """
    def left_open(cell: Cell) -> dict[str, list]:
        out = {"cell": [], "low": [], "side": [], "node": [], "root": []}
        for at in cell.open(similarity):
            at = at[np.lexsort((cell.node[at], cell.side[at]))]
            name = hashlib.md5(cell.side[at].astype(np.int64).tobytes() + cell.node[at].tobytes()).hexdigest()
            for n, v in (("cell", [name] * len(at)), ("low", [cell.node[at].min()] * len(at)), *((n, getattr(cell, n)[at]) for n in ("side", "node", "root"))):
                out[n].extend(v)
        return out

    def linked(cell: Cell) -> dict[str, list]:
        pairs = cell.links(similarity)
        return {"a": [max(p) for p in pairs], "b": [min(p) for p in pairs]}

    light = rows.select(*key, "side", "node", "root").join(sets.select("node", "n", "least"), "node")
    light = light.select(*key, "side", "node", "root", "n", "least")
    found = settle(_by_cell(light, key, left_open, cell="string", low="bigint", side="int", node="bigint", root="bigint").distinct(), about)
    left = settle(_gathered(found, about), about)
    some, _ = told_apart(sets, F.col("node"), left, "node")  # of the others no hashes are shuffled
    whole = left.join(some, "node").select("cell", "side", "node", "root", "n", "least", "hashes")
    return _by_cell(whole, ["cell"], linked, a="bigint", b="bigint").distinct()


def _dealt(bands: DataFrame, about: int) -> DataFrame:
    """Cells of bands whose texts have several roots: band, g, p, h, q, side, node, root.

    Texts of a root that holds more than a piece of the band are dealt apart from
    the others, so they are never compared among themselves.
    """
    size = bands.groupBy("band", "root").agg(F.count("*").alias("n"))
    size = size.withColumn("g", F.when(F.col("n") > PIECE, F.col("root")).otherwise(F.lit(-1)))
    group = settle(size.groupBy("band", "g").agg(F.ceil(F.sum("n") / PIECE).alias("pieces")), about)
    rows = bands.join(size.select("band", "root", "g"), ["band", "root"]).join(group, ["band", "g"])
    rows = rows.withColumn("p", F.pmod(F.xxhash64("node", F.lit(3)), F.col("pieces"))).drop("pieces")
    piece = group.select("band", "g", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("p"))
    other = piece.withColumnRenamed("g", "h").withColumnRenamed("p", "q")
    cells = piece.join(other, "band").where("g < h or (g = -1 and h = -1 and p <= q)")
    left = cells.join(rows, ["band", "g", "p"]).withColumn("side", F.lit(0))
    right = cells.where("g <> h or p <> q").join(rows.withColumnRenamed("g", "h").withColumnRenamed("p", "q"), ["band", "h", "q"]).withColumn("side", F.lit(1))
    names = ["band", "g", "p", "h", "q", "side", "node", "root"]
    return left.select(*names).unionAll(right.select(*names))


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = 3, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Groups of documents of which one is enough: page, doc_id, ``keep``, the document that stands for it, and ``kept``.

    Texts are linked if their different shingles of ``words`` words have a Jaccard
    similarity of ``similarity`` or more; every link is verified on the shingles.
    Candidates are the first texts of fingerprints of single words that differ in
    ``radius`` bits or fewer, the texts of one fingerprint, and all texts that
    share a band of least hashes of their shingles. Whether a band is shared
    depends on the similarity alone, not on the kind of edit.
    A text (``page``, a digest) is one node, whatever rows and ids hold it. First
    the texts of a band or a fingerprint are compared with its first text, so a
    group of many near copies costs in proportion to its size. What is left are
    bands whose texts are not all joined: there the texts of different roots are
    compared inside tasks, piece by piece of ``PIECE`` texts; what a link joins is
    not compared again, and tasks give links that join, never pairs.
    Defined cases: ``keep`` is the smallest doc_id of a group, and of texts under
    that id the one with the least digest; rows without an id belong to their
    group and stand for it only where no row has one; rows equal in id and text
    are kept or not together; null is the empty text, and texts without five words
    are one shingle; texts of any length are hashed whole, and a task holds the
    hashes of two pieces; an empty table gives no rows.
    """
    def run(keys: list, pages: list, texts: list) -> Iterator[tuple]:
        for k, p, t in zip(keys, pages, texts):
            f, found = fingerprint(t, 1, 42, True), shingles(t, words)
            yield k, p, f - (1 << 64) if f >> 63 else f, bands(least_hashes(found))

    slim = docs.select(F.col(key).alias("doc_id"), page_of(text).alias("page"), F.col(text).alias("text"))
    marked = settle(map_rows(slim, run, 100, doc_id="bigint", page="binary", fp="bigint", bands="array<bigint>"))
    first_id = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "page"))
    nodes = settle(marked.groupBy("page").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"), first_id.alias("first"))
                   .withColumn("node", F.monotonically_increasing_id()), marked.count(), NODES)
    n = nodes.count()
    about = BANDS * n  # rows of tables by band
    shared = nodes.select(F.explode("bands").alias("band"), "node")
    heads = settle(shared.groupBy("band").agg(F.min("node").alias("head"), F.count("*").alias("of")).where("of > 1").select("band", "head"), about)
    shared, _ = told_apart(shared, F.col("band"), heads, "band")  # most bands hold one text and are not shuffled again
    crowded = settle(shared.join(heads, "band"), about)

    equal = nodes.groupBy("fp").agg(F.min("node").alias("head"), F.count("*").alias("of"))
    heads = settle(equal, n)
    a, b = (heads.select(F.col("fp").alias(n), F.col("head").alias(h)) for n, h in (("a", "node"), ("b", "head")))
    across = links(heads.select("fp"), radius).join(a, "a").join(b, "b").select("node", "head")
    same = nodes.select("fp", "node").join(heads.where("of > 1"), "fp").select("node", "head")
    star = settle(crowded.select("node", "head").unionAll(same).unionAll(across).where("node <> head").distinct(), about)

    wanted = crowded.select("node").unionAll(star.select("node")).unionAll(star.select("head")).distinct()
    wanted = settle(nodes.select("page", "node").join(wanted, "node"), n)

    def hashed(seen: set, ids: list, texts: list) -> Iterator[tuple]:
        for i, t in zip(ids, texts):
            if i not in seen:  # of equal texts, one for each task
                found = shingles(t, words)
                yield i, len(found), least_hashes(found).astype(np.uint16).tobytes(), np.array(found, np.int64).tobytes()
                seen.clear() if len(seen) > 1_000_000 else seen.add(i)

    maybe, _ = told_apart(slim, F.col("page"), wanted, "page")  # of the others no text is shuffled
    sets = map_rows(maybe.join(wanted, "page").select("node", "text"), hashed, 100, set, node="bigint", n="bigint", least="binary", hashes="binary")
    sets = settle(sets.groupBy("node").agg(*(F.first(name).alias(name) for name in ("n", "least", "hashes"))), wanted.count(), SETS)

    rays = star.groupBy("head").agg(F.ceil(F.count("*") / PIECE).alias("chunks"))
    spread = star.join(rays, "head").withColumn("chunk", F.pmod(F.xxhash64("node", F.lit(2)), F.col("chunks")))
    centres = rays.select("head", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("side"), F.col("head").alias("node"))
    tips = spread.select("head", "chunk", F.lit(1).alias("side"), "node")
    rows = centres.unionAll(tips).withColumn("root", F.col("node"))
    alike = settle(compared(rows, ["head", "chunk"], sets, similarity, about), n)
    joined = components(alike, n)

    now = settle(crowded.select("band", "node").join(joined, "node", "left").withColumn("root", F.coalesce("root", "node")), about)
    mixed = now.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("band")
    rows = _dealt(settle(now.join(mixed, "band", "left_semi"), about), about)
    more = settle(compared(rows, ["band", "g", "p", "h", "q"], sets, similarity, about), n)
    found = joined if more.isEmpty() else components(alike.unionAll(more), n)
    member = nodes.select("page", "node", "first").join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = member.groupBy("root").agg(F.min("first").alias("first"))
    member = member.drop("first").join(first, "root").select("page", "first")
    return marked.join(member, "page").select(
        "page", "doc_id", F.col("first.doc_id").alias("keep"),
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("page") == F.col("first.page"))).alias("kept"))
