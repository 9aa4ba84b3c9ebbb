"""Exact dedup of repeated byte strings: shard Burrows-Wheeler transforms, merged by interleave refinement.

A string of ``LENGTH`` bytes can repeat only where a shorter piece of it does. So the texts are first thinned out:
each window of ``LENGTH`` bytes names its anchor, the piece of ``GRAM`` bytes in it with the least hash, which is the
same wherever the window's bytes stand. Anchors with their surroundings (all windows that name them) are grouped by
content; where one content stands in several places, all but the first are repeats as a whole. Only anchors that stand
in different surroundings are left open, mostly at the edges of what repeats. For their surroundings the question is
answered by suffixes: shards of them get their transforms, the transforms are merged, and the intervals of suffixes
with ``LENGTH`` bytes in common are the repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import parts_of, settle
from .kneser import Powers, mixed

LENGTH, GRAM = 100, 48
#: Bytes that are hashed at a time; a longer text is cut into such segments, which overlap by a window.
SEGMENT = 2_000_000
#: Bytes whose hashes are computed together, as far as texts are shorter; their arrays stay in a core's cache.
BLOCK = 250_000
#: Bytes of surroundings whose suffixes are sorted together, and of one shard of them.
MERGED, SHARD = 500_000, 100_000
#: Different surroundings from which an anchor is hot: its windows are compared by hash, spread over all tasks.
HOT = 20_000
PLACE = 26  # bits of a place inside a segment group


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM, bounds: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Anchors of all windows of joined texts, windows lying inside one text (``bounds``: where texts begin, and the end).

    Returns per run of windows with one anchor: hash of the anchor, hash of the
    run's bytes, place of the anchor, first window, last window.
    """
    n = len(data)
    bounds = np.array([0, n]) if bounds is None else bounds
    sizes = np.diff(bounds)
    long = sizes >= length
    empty = np.empty(0, np.int64)
    if not long.any():
        return empty.view(np.uint64), empty.view(np.uint64), empty, empty, empty
    Powers.reach(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * Powers.up[:n])])
    h = mixed((sums[gram:] - sums[:-gram]) * Powers.down[: n - gram + 1])
    low = np.uint64((1 << PLACE) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width, done = length - gram + 1, 1  # windows hold so many pieces
    while done < width:
        step = min(done, width - done)
        least = np.minimum(least[: len(least) - step], least[step:])
        done += step
    inside = np.zeros(n + 1, np.int64)
    np.add.at(inside, bounds[:-1][long], 1)
    np.add.at(inside, bounds[1:][long] - length + 1, -1)
    p = np.flatnonzero(np.cumsum(inside)[: len(least)] > 0)
    a = (least[p] & low).astype(np.int64)
    cut = np.flatnonzero((np.diff(a) != 0) | (np.diff(p) != 1)) + 1
    first, last = p[np.concatenate([[0], cut])], p[np.concatenate([cut - 1, [len(p) - 1]])]
    a = a[np.concatenate([[0], cut])]
    shape = ((a - first) << 8 | (last - first)).astype(np.uint64)
    whole = mixed((sums[last + length] - sums[first]) * Powers.down[first] + mixed(shape + np.uint64(1)))
    return h[a], whole, a, first, last


def _sliced(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Fewer rows at a time, where their Python objects are much larger than the rows."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def _segments(keys: list[int], texts: list[bytes], length: int) -> Iterator[tuple[list[tuple[int, int]], list[bytes]]]:
    """Groups of about ``SEGMENT`` bytes: (key, place in the text) and bytes of each segment."""
    heads, bodies, size = [], [], 0
    for k, t in zip(keys, texts):
        for at in range(0, max(len(t) - length + 1, 1), SEGMENT):
            body = t[at : at + SEGMENT + length - 1] if len(t) > SEGMENT else t
            if len(body) < length:
                continue
            if bodies and size + len(body) > SEGMENT:
                yield heads, bodies
                heads, bodies, size = [], [], 0
            heads.append((k, at))
            bodies.append(body)
            size += len(body)
    if bodies:
        yield heads, bodies


def _by_blocks(bodies: list[bytes], bounds: np.ndarray, length: int) -> list[np.ndarray]:
    """``anchors`` of joined texts, some whole texts at a time."""
    found, k = [], 0
    while k < len(bodies):
        stop = max(k + 1, int(np.searchsorted(bounds, bounds[k] + BLOCK, "right")) - 1)
        h, whole, *places = anchors(np.frombuffer(b"".join(bodies[k:stop]), np.uint8), length, min(GRAM, length), bounds[k : stop + 1] - bounds[k])
        found.append((h, whole, *(p + bounds[k] for p in places)))
        k = stop
    return [np.concatenate(x) for x in zip(*found)]


def anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """(key, body) to rows done, anchor, whole, key, at: ``at`` packs the first window and how far anchor and last window lie behind it.

    What a group of texts already holds at an earlier place is ``done``: it is a
    repeat whatever other tasks find. So content that is everywhere comes out of
    each group once, and no task gets all of its rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in _sliced(batches, 1000):
            texts = [expand(x) for x in batch.column(1).to_pylist()]
            for heads, bodies in _segments(batch.column(0).to_pylist(), texts, length):
                bounds = np.concatenate([[0], np.cumsum([len(b) for b in bodies])])
                h, whole, a, first, last = _by_blocks(bodies, bounds, length)
                which = np.searchsorted(bounds, first, "right") - 1
                keys, places = np.array([x[0] for x in heads]), np.array([x[1] for x in heads])
                at = (first - bounds[which] + places[which]) << 16 | (a - first) << 8 | (last - first)
                h, whole, keys = h.view(np.int64), whole.view(np.int64), keys[which]
                order = np.lexsort((at, keys, whole, h))
                h, whole, keys, at = h[order], whole[order], keys[order], at[order]
                head = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (whole[1:] != whole[:-1])])) if len(h) else order
                of = np.repeat(head, np.diff(np.append(head, len(h))))
                yield pa.RecordBatch.from_pydict({
                    "done": pa.array((keys != keys[of]) | (at != at[of]), pa.bool_()),
                    "anchor": pa.array(h, pa.int64()), "whole": pa.array(whole, pa.int64()),
                    "key": pa.array(keys, pa.int64()), "at": pa.array(at, pa.int64())})

    return docs.mapInArrow(run, "done boolean, anchor bigint, whole bigint, key bigint, at bigint")


def _sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of anchor, whole, key, at: those behind the first of their content (kind 0), and the
    firsts of anchors with several contents (kind 1). Of the rows before, only two are kept in mind.
    Rows that are done pass."""
    start = first = None  # first row of the content at hand; the last first that is not yet given out
    given = False
    for batch in batches:
        x = np.stack([batch.column(c).to_numpy() for c in ("anchor", "whole", "key", "at")], 1)
        done = batch.column("done").to_numpy(zero_copy_only=False)
        if done.any():
            yield _kind(0, x[done])
        x = x[~done]
        if not len(x):
            continue
        if start is not None:
            x = np.concatenate([start[None], x])
        new = np.concatenate([[True], (x[1:, :2] != x[:-1, :2]).any(1)])
        heads = np.flatnonzero(new)
        head = x[heads[np.cumsum(new) - 1]]
        repeat = x[(x[:, 2:] != head[:, 2:]).any(1)]
        firsts = x[heads]
        if start is not None:  # the first head is the one that was at hand
            firsts, rest = firsts[1:], firsts[:1]
        else:
            rest = firsts[:0]
        chain = np.concatenate([first[None], firsts]) if first is not None else firsts
        same = chain[1:, 0] == chain[:-1, 0]
        out = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        if first is not None and given:
            out[0] = False
        shared_last = bool(same[-1]) if len(same) else (given if first is not None and len(chain) == 1 else False)
        several = chain[out]
        if len(chain):
            given = shared_last if len(firsts) else given
            first = chain[-1]
        start = x[heads[-1]]
        for kind, rows in ((0, repeat), (1, several)):
            if len(rows):
                yield _kind(kind, rows)


def _kind(kind: int, rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "kind": pa.array(np.full(len(rows), kind), pa.int32()), "anchor": pa.array(rows[:, 0], pa.int64()),
        "key": pa.array(rows[:, 2], pa.int64()), "at": pa.array(rows[:, 3], pa.int64())})


STEP = 8  # bytes that stand for one symbol of a transform


def _order(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of keys of ``bits`` bits, and the keys in it; where key and place fit into 64 bits, they are sorted as one number."""
    place = max(1, len(key) - 1).bit_length()
    if bits + place > 64:
        order = np.argsort(key, kind="stable")
        return order, key[order]
    both = np.sort(key << np.uint64(place) | np.arange(len(key), dtype=np.uint64))
    return (both & np.uint64((1 << place) - 1)).astype(np.int64), both >> np.uint64(place)


def shard_transform(text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of all rotations of the pieces of a shard, and the ``STEP`` bytes before each: its transform.

    ``bounds`` says where the pieces begin, and the end; each ends with a zero.
    Ranks begin with four bytes and are doubled until they reach over the longest
    piece; equal rotations stay in order of their place.
    """
    n, size = len(text), np.diff(bounds)
    begin, long = np.repeat(bounds[:-1], size), np.repeat(size, size)
    at = np.arange(n) - begin

    def behind(k: int) -> np.ndarray:
        return begin + (at + k) % long

    key = text.astype(np.uint64)
    for k in (1, 2):
        key = key << np.uint64(8 * k) | key[behind(k)]
    step, bits, wide = 4, 32, n.bit_length()
    while True:
        order, sorted_key = _order(key, bits)
        ends = sorted_key[1:] != sorted_key[:-1]
        rank = np.empty(n, np.uint64)
        rank[order] = np.concatenate([[0], np.cumsum(ends)])
        if step >= size.max() or ends.all():
            break
        key, bits = rank << np.uint64(wide) | rank[behind(step)], 2 * wide
        step *= 2
    before = np.zeros(n, np.uint64)
    for k in range(STEP, 0, -1):
        before = before << np.uint64(8) | text[behind(-k)]
    return order, before[order]


def merge(transforms: list[np.ndarray], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave the transforms of shards so that all suffixes stand in order of their first ``length`` bytes.

    Begins with one shard behind the other. Each round deals the entries out by
    the symbol before them, in order; after k rounds the interleaving is right for
    k symbols. Where an entry's symbol or its old interval differs from its
    neighbour's, an interval of common prefixes ends. No suffix is compared. Bytes
    that ``length`` has over a multiple of ``STEP`` are a shorter symbol of the last round.

    Returns the shard of each entry, and the number of its interval.
    """
    joined = np.concatenate(transforms)
    rounds = [(_ranks(joined), length // STEP)]
    if more := length % STEP:
        rounds.append((_ranks(joined & np.uint64((1 << 8 * more) - 1)), 1))
    z = np.repeat(np.arange(len(transforms), dtype=np.uint8 if len(transforms) <= 256 else np.uint32), [len(t) for t in transforms])
    interval = np.zeros(len(z), np.int32)
    for (flat, bits), times in rounds:
        for _ in range(times):
            symbols = np.empty_like(flat)
            symbols[np.argsort(z, kind="stable")] = flat  # each shard's symbols, in its own order
            order, dealt = _order(symbols, bits)
            z, interval = z[order], interval[order]
            ends = (dealt[1:] != dealt[:-1]) | (interval[1:] != interval[:-1])
            interval[0] = 0
            np.cumsum(ends, dtype=np.int32, out=interval[1:])
    return z, interval


def _ranks(symbols: np.ndarray) -> tuple[np.ndarray, int]:
    """Symbols as numbers in their order without gaps, and the bits of the largest."""
    kinds, ranks = np.unique(symbols, return_inverse=True)
    return ranks.astype(np.uint64), len(kinds).bit_length()


def repeats(pieces: list[bytes], keys: np.ndarray, places: np.ndarray, windows: np.ndarray, length: int,
            shard: int = SHARD) -> tuple[np.ndarray, np.ndarray]:
    """Windows of the pieces that also start earlier, as (piece, offset); the first ``windows`` of a piece are asked.

    "Earlier" is by ``keys`` and then by ``places`` (of the piece) plus offset.
    """
    size = np.array([len(p) + 1 for p in pieces])
    bounds = np.concatenate([[0], np.cumsum(size)])
    # a zero ends each piece; the bytes of texts are moved up by one, and 255 stands in no UTF-8
    text = np.frombuffer(b"\xff".join([*pieces, b""]), np.uint8) + np.uint8(1)
    cuts = [0]
    for i in range(1, len(pieces) + 1):
        if i == len(pieces) or bounds[i + 1] - bounds[cuts[-1]] > shard:
            cuts.append(i)
    orders, transforms = [], []
    for a, b in zip(cuts[:-1], cuts[1:]):
        order, before = shard_transform(text[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a])
        orders.append(order + bounds[a])
        transforms.append(before)
    z, interval = merge(transforms, length)
    suffix = np.empty(len(z), np.int64)
    for s, order in enumerate(orders):
        suffix[z == s] = order
    piece = np.repeat(np.arange(len(pieces)), size)[suffix]
    offset = suffix - bounds[piece]
    asked = offset < windows[piece]
    asked &= np.bincount(interval[asked], minlength=interval[-1] + 1)[interval] > 1  # an interval of one is no repeat
    piece, offset, interval = piece[asked], offset[asked], interval[asked]
    place, key = places[piece] + offset, keys[piece]
    order = np.lexsort((place, key, interval))
    piece, offset, interval, place, key = piece[order], offset[order], interval[order], place[order], key[order]
    head = np.flatnonzero(np.concatenate([[True], interval[1:] != interval[:-1]])) if len(interval) else np.empty(0, np.int64)
    of = np.repeat(head, np.diff(np.append(head, len(interval))))
    late = (key != key[of]) | (place != place[of])
    return piece[late], offset[late]


def _runs(keys: np.ndarray, starts: np.ndarray, length: int) -> pa.RecordBatch:
    """Repeated windows to the spans they cover."""
    order = np.lexsort((starts, keys))
    keys, starts = keys[order], starts[order]
    new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (starts[1:] > starts[:-1] + length)]) if len(keys) else np.empty(0, bool)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(keys)) - 1 if len(at) else at
    return pa.RecordBatch.from_pydict({
        "key": pa.array(keys[at], pa.int64()), "start": pa.array(starts[at], pa.int64()), "stop": pa.array(starts[last] + length, pa.int64())})


SPANS = "key bigint, start bigint, stop bigint"


def _compared(length: int):
    """Pieces in order of their anchor to the spans of their repeated windows; whole anchors are taken together."""
    def resolve(rows: list[tuple]) -> pa.RecordBatch:
        keys, places, windows = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3))
        piece, offset = repeats([r[4] for r in rows], keys, places, windows, length)
        return _runs(keys[piece], places[piece] + offset, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in _sliced(batches, 2000):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size > MERGED and row[0] != rows[-1][0]:
                    yield resolve(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[4])
        if rows:
            yield resolve(rows)

    return run


def _hashed(length: int):
    """Pieces of hot anchors to two hashes of each window, and its place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches, 2000):
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            for k in range(0, len(rows), 2000):
                part = rows[k : k + 2000]
                w = [(r[1], r[2] + o, r[4][o : o + length]) for r in part for o in range(r[3])]
                digest = np.frombuffer(b"".join(hashlib.blake2b(x[2], digest_size=16).digest() for x in w), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_pydict({
                    "a": pa.array(digest[:, 0], pa.int64()), "b": pa.array(digest[:, 1], pa.int64()),
                    "key": pa.array([x[0] for x in w], pa.int64()), "start": pa.array([x[1] for x in w], pa.int64())})

    return run


def packed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, doc_id, body: each row with a number of its own, in order of doc_id (null last) and text; texts compressed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(3).compress
        for batch in batches:
            body = [squeeze(t.encode() if t else b"") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(body, pa.binary())], names=["doc_id", "body"])

    rows = docs.select(F.col(key).cast("long"), text).mapInArrow(run, "doc_id bigint, body binary")
    rows = rows.withColumn("content", F.xxhash64("body")).withColumn("row", F.monotonically_increasing_id())
    rows = rows.orderBy(F.col("doc_id").asc_nulls_last(), "content", "row")
    return settle(rows.select(F.monotonically_increasing_id().alias("key"), "doc_id", "body"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """Spans (key, start, stop) that cover every window of (key, body) rows that also starts earlier; spans may overlap."""
    n = parts_of(docs)
    dealt = F.when(F.col("done"), F.xxhash64("key", "at")).otherwise(F.col("anchor"))  # done rows can go anywhere
    rows = anchor_rows(docs.select("key", "body"), length).repartition(n, dealt).sortWithinPartitions("anchor", "whole", "key", "at")
    found = settle(rows.mapInArrow(_sorted_out, "kind int, anchor bigint, key bigint, at bigint"))
    first = F.shiftright("at", 16)
    whole = found.where("kind = 0").select("key", first.alias("start"), (first + F.col("at").bitwiseAND(255) + length).alias("stop"))

    open_rows = found.where("kind = 1")
    busy = open_rows.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("anchor", F.lit(True).alias("hot"))
    wanted = open_rows.join(busy, "anchor", "left").groupBy("key").agg(
        F.collect_list(F.struct("anchor", "at", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("places"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in _sliced(batches, 200):
            out: list[tuple] = []
            for k, body, places in zip(*(c.to_pylist() for c in batch.columns)):
                text = expand(body)
                for p in places:
                    start, more = p["at"] >> 16, p["at"] & 255
                    piece = text[start : start + more + length]
                    if len(piece) == more + length:
                        out.append((p["anchor"], k, start, more + 1, piece, p["hot"]))
            for i in range(0, len(out), 20_000):
                columns = zip(*out[i : i + 20_000])
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                                 names=["anchor", "key", "start", "windows", "piece", "hot"])

    joined = docs.join(wanted, "key").select("key", "body", "places")
    pieces = settle(joined.mapInArrow(cut, "anchor bigint, key bigint, start bigint, windows int, piece binary, hot boolean"))
    plain = pieces.where(~F.col("hot")).drop("hot").repartition(n, "anchor").sortWithinPartitions("anchor", "key", "start")
    spans = whole.unionAll(plain.mapInArrow(_compared(length), SPANS))
    if not busy.isEmpty():
        windows = settle(pieces.where("hot").drop("hot").mapInArrow(_hashed(length), "a bigint, b bigint, key bigint, start bigint"))
        earliest = windows.groupBy("a", "b").agg(F.min(F.struct("key", "start")).alias("e"))
        late = windows.join(earliest, ["a", "b"]).where(F.struct("key", "start") != F.col("e"))
        spans = spans.unionAll(late.select("key", "start", (F.col("start") + length).alias("stop")))
    return spans


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, texts: bool = False, hot: int = HOT) -> DataFrame:
    """Cut every byte out of the texts that lies in a ``length``-byte string which also starts earlier.

    Earlier is at a smaller key, or at an earlier byte of the same text; strings
    are judged on the texts as they come and never lie across texts.
    Columns: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``texts`` also
    the remaining bytes as ``kept``.
    Defined cases: a null text is empty; shorter texts stay whole; a null key is
    behind all others; each row is a document, and rows that share a key, or have
    none, are in order of a hash of their texts; an empty table gives no rows;
    other columns are not read.
    """
    slim = packed(docs, key, text)
    spans = settle(repeated_spans(slim, length, hot))
    spans = spans.groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in _sliced(batches, 200):
            rows = []
            bodies = [expand(x) for x in batch.column(1).to_pylist()]
            for k, whole, spans in zip(batch.column(0).to_pylist(), bodies, _united(batch.column(2), [len(x) for x in bodies])):
                kept, removed, at = [], 0, 0
                for start, stop in spans:
                    kept.append(whole[at:start])
                    removed, at = removed + stop - start, stop
                kept = b"".join([*kept, whole[at:]])
                rows.append((k, len(whole), removed, len(spans), hashlib.sha256(kept).hexdigest(), *([kept] if texts else [])))
            columns = zip(*rows) if rows else [[]] * (5 + texts)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 5 + texts]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

    joined = slim.join(spans, "key", "left").select("doc_id", "body", "spans")
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", kept binary" if texts else "")
    return joined.mapInArrow(cut, schema)


def _united(spans: pa.Array, sizes: list[int]) -> list[list[tuple[int, int]]]:
    """The maximal runs that the spans (lists of start and stop; null: none) of each text cover, in order, up to the text's end."""
    size = np.array(sizes, np.int64)
    row = np.repeat(np.arange(len(size)), pc.fill_null(pc.list_value_length(spans), 0).to_numpy(zero_copy_only=False))
    flat = spans.flatten()
    start, stop = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    inside = start < size[row]
    row, start, stop = row[inside], start[inside], np.minimum(stop, size[row])[inside]
    out: list[list[tuple[int, int]]] = [[] for _ in sizes]
    if len(row):
        base = np.concatenate([[0], np.cumsum(size + 2)])[row]  # texts lie behind each other, apart
        order = np.argsort(base + start, kind="stable")
        row, base, start, stop = row[order], base[order], start[order], stop[order]
        reach = np.maximum.accumulate(base + stop)
        head = np.flatnonzero(np.concatenate([[True], base[1:] + start[1:] > reach[:-1]]))
        last = np.append(head[1:], len(row)) - 1
        for r, a, b in zip(row[head].tolist(), start[head].tolist(), (reach[last] - base[last]).tolist()):
            out[r].append((a, b))
    return out
