"""Near-duplicate vectors by NN-descent: a neighbour graph refined through neighbours of neighbours."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, Window

from .common import settle
from .simhash import components

#: Cosine from which two vectors are linked; fixed by the contract.
LINK = 0.95
#: Neighbours are followed at twice the angle: two vectors linked to a third are no further apart.
REACH = 2.0
#: Entries of a list at first, and of the longest; links of vectors with more are counted over their component.
LIST, LONGEST = 16, 64
#: Places in the order of a table of sign codes within which vectors are compared, and the chance to miss a pair in all tables.
WINDOW, MISSED = 32, 1e-3
#: Members of a list and its reverse that meet at once; longer ones are dealt anew each round.
CHUNK = 64
#: Share of new entries at which the graph counts as settled.
SETTLED = 1e-3
#: Vectors asked by the audit, the recall it wants, and how often it sends the graph back with twice the tables.
AUDITED, AIM, AUDITS = 1024, 0.98, 3
#: Steps of the angle to a component's centre, and vectors compared at a time with as many others.
STEPS, PIECE = 1024, 512
EDGE = "u bigint, v bigint, s double"


def tables_for(n: int, link: float) -> int:
    """Tables of sign codes so that a pair at the threshold is missed in all with a chance of ``MISSED``.

    Two vectors share a bit with probability 1 - angle / pi, and lie within the
    window if they share the bits that single out one window of the ``n``.
    """
    shared = (1 - math.acos(link) / math.pi) ** math.log2(max(2, n / WINDOW))
    return math.ceil(math.log(MISSED) / math.log(1 - shared))


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(-1, width)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], width: int) -> Iterator[dict[str, np.ndarray]]:
    """Rows of a sorted partition, cut where a key changes; vectors (``x``) come as a matrix."""
    held = None
    for batch in batches:
        now = pa.Table.from_batches([batch])
        now = now if held is None else pa.concat_tables([held, now]).combine_chunks()
        columns = {n: matrix(now.column(n), width) if n == "x" else now.column(n).to_numpy() for n in now.column_names}
        change = np.zeros(max(0, now.num_rows - 1), bool)
        for k in keys:
            change |= columns[k][1:] != columns[k][:-1]
        start = 0
        for cut in np.flatnonzero(change) + 1:
            yield {n: c[start:cut] for n, c in columns.items()}
            start = cut
        held = now.slice(start)
    if held is not None and held.num_rows:
        yield {n: matrix(held.column(n), width) if n == "x" else held.column(n).to_numpy() for n in held.column_names}


def edges_of(a: list, b: list, s: list) -> pa.RecordBatch:
    """Both directions of the pairs found."""
    a, b, s = (np.concatenate(v) if v else np.empty(0, t) for v, t in ((a, np.int64), (b, np.int64), (s, float)))
    return pa.RecordBatch.from_pydict({"u": np.concatenate([a, b]), "v": np.concatenate([b, a]), "s": np.concatenate([s, s])},
                                      schema=pa.schema([("u", pa.int64()), ("v", pa.int64()), ("s", pa.float64())]))


def begin(nodes: DataFrame, width: int, tables: range, floor: float) -> DataFrame:
    """First neighbours: in each table, vectors sorted by their signs on random directions are compared with those next to them."""
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), width)
            for t in tables:
                ways = np.random.default_rng(t).normal(size=(width, 63))
                code = (x @ ways > 0) @ (1 << np.arange(62, -1, -1, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(code), *batch.columns], names=["t", "code", "node", "x"])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, table, before = np.empty(0, np.int64), np.empty(0, np.int32), np.empty((0, width))
        for whole in batches:
            for k in range(0, whole.num_rows, PIECE):
                batch = whole.slice(k, PIECE)
                old = len(node)
                node, table = np.append(node, batch.column(2).to_numpy()), np.append(table, batch.column(0).to_numpy())
                before = np.concatenate([before, matrix(batch.column(3), width)])
                s = before[old:] @ before.T
                place = np.arange(old, len(node))[:, None] - np.arange(len(node))[None, :]
                i, j = np.nonzero((place > 0) & (place <= WINDOW) & (s >= floor) & (table[old:, None] == table[None, :]))
                yield edges_of([node[i + old]], [node[j]], [s[i, j]])
                node, table, before = node[-WINDOW:], table[-WINDOW:], before[-WINDOW:]

    order = ["t", "code", F.xxhash64("node")]  # equal codes are spread
    rows = nodes.select("node", "x").mapInArrow(coded, "t int, code bigint, node bigint, x array<double>")
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return rows.mapInArrow(windows, EDGE).groupBy("u", "v").agg(F.max("s").alias("s"))


def lists(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """The nearest of each vector, as many as its list holds: u, v, s, fresh, k."""
    nth = Window.partitionBy("u").orderBy(F.desc("s"), "v")
    sized = pairs.join(sizes, "u", "left").withColumn("k", F.coalesce("k", F.lit(LIST)))
    return settle(sized.withColumn("nth", F.row_number().over(nth)).where("nth <= k").drop("nth"))


def joined(graph: DataFrame, full: DataFrame, nodes: DataFrame, width: int, floor: float, turn: int) -> DataFrame:
    """Pairs of neighbours of one vector that would enter a list of either, where one of them is new to it."""
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, sims, n = [], [], [], 0
        for run in runs(batches, ["w", "chunk"], width):
            s = run["x"] @ run["x"].T
            want = (s >= floor) & (run["fresh"][:, None] | run["fresh"][None, :]) & (s > np.minimum(run["low"][:, None], run["low"][None, :]))
            i, j = np.nonzero(np.triu(want, 1))
            a.append(run["m"][i]), b.append(run["m"][j]), sims.append(s[i, j])
            n += len(i)
            if n > 50_000:
                yield edges_of(a, b, sims)
                a, b, sims, n = [], [], [], 0
        yield edges_of(a, b, sims)

    both = graph.select(F.col("u").alias("w"), F.col("v").alias("m"), "fresh").unionAll(graph.select(F.col("v").alias("w"), F.col("u").alias("m"), "fresh"))
    members = both.groupBy("w", "m").agg(F.max("fresh").alias("fresh"))
    busy = members.groupBy("w").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"), F.max("fresh").alias("any")).where("any and chunks > 0").drop("any")
    members = members.join(busy, "w").withColumn("chunk", F.pmod(F.xxhash64("m", F.lit(turn)), F.col("chunks")))
    known = nodes.join(full.select(F.col("u").alias("node"), "low"), "node", "left").select(
        F.col("node").alias("m"), F.coalesce("low", F.lit(floor)).alias("low"), "x")
    rows = members.join(known, "m").select("w", "chunk", "m", "fresh", "low", "x")
    return rows.repartition("w", "chunk").sortWithinPartitions("w", "chunk").mapInArrow(meet, EDGE).groupBy("u", "v").agg(F.max("s").alias("s"))


def refine(pairs: DataFrame, nodes: DataFrame, width: int, link: float, floor: float) -> DataFrame:
    """Rounds of NN-descent until hardly an entry is new: u, v, s, fresh, k.

    A list all of whose entries are links is saturated: it is made twice as long,
    up to ``LONGEST``, and its entries count as new again.
    """
    sizes = pairs.sparkSession.createDataFrame([], "u bigint, k int")
    graph, turn = lists(pairs.withColumn("fresh", F.lit(True)), sizes), 0
    while True:
        full = settle(graph.groupBy("u", "k").agg(F.count("*").alias("n"), F.min("s").alias("low"), F.sum(F.col("fresh").cast("int")).alias("new"))
                      .where("n >= k or new > 0").withColumn("more", F.expr(f"n >= k and low >= {link} and k < {LONGEST}")))
        new, more = full.agg(F.sum("new"), F.count_if("more")).first()
        if not more and (new or 0) <= SETTLED * graph.count():
            return graph
        sizes = settle(graph.select("u", "k").distinct().join(full.select("u", "more"), "u", "left").select(
            "u", F.when(F.col("more"), F.col("k") * 2).otherwise(F.col("k")).alias("k")).where(F.col("k") > LIST))
        grown = full.where("more").select("u", "more")
        graph = graph.join(grown, "u", "left").withColumn("fresh", F.col("fresh") | F.coalesce("more", F.lit(False))).drop("more")
        low = full.where("n >= k and not more").select("u", "low")
        found = joined(graph, low, nodes, width, floor, turn).withColumn("fresh", F.lit(True))
        kept = graph.select("u", "v", "s", F.lit(False).alias("fresh"))
        graph = lists(kept.unionAll(found).groupBy("u", "v").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh")), sizes)
        turn += 1


def linked(graph: DataFrame, link: float) -> DataFrame:
    """Links in both directions: u, v."""
    near = graph.where(F.col("s") >= link)
    return near.select("u", "v").unionAll(near.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def audit(graph: DataFrame, nodes: DataFrame, width: int, link: float) -> float:
    """Share of the links of ``AUDITED`` vectors, taken by a hash, that the graph holds; all vectors are gone through.

    Vectors whose list is full at its longest are left out: their links are
    counted otherwise.
    """
    full = graph.groupBy("u").agg(F.count("*").alias("n"), F.min("s").alias("low")).where((F.col("n") >= LONGEST) & (F.col("low") >= link))
    sample = nodes.join(full.select(F.col("u").alias("node")), "node", "left_anti").orderBy(F.xxhash64("node"), "node").limit(AUDITED).select("node", "x").collect()
    if not sample:
        return 1.0
    asked = nodes.sparkSession.sparkContext.broadcast((np.array([r["node"] for r in sample]), np.array([r["x"] for r in sample], float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = asked.value
        n = np.zeros(len(ids), np.int64)
        for whole in batches:
            for k in range(0, whole.num_rows, PIECE):
                batch = whole.slice(k, PIECE)
                n += ((x @ matrix(batch.column(1), width).T >= link) & (ids[:, None] != batch.column(0).to_numpy()[None, :])).sum(1)
        yield pa.RecordBatch.from_pydict({"true": pa.array([int(n.sum())], pa.int64())})

    true = nodes.select("node", "x").mapInArrow(run, "true bigint").agg(F.sum("true")).first()[0]
    ids = nodes.sparkSession.createDataFrame([(int(r["node"]),) for r in sample], "u bigint")
    held = linked(graph, link).join(ids, "u", "left_semi").count()
    return held / true if true else 1.0


def _angle(x: Column, c: Column) -> Column:
    dot = F.aggregate(F.zip_with(x, c, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, v: s + v * v))
    return F.when(size > 0, F.acos(F.least(F.greatest(dot / size, F.lit(-1.0)), F.lit(1.0)))).otherwise(F.lit(math.pi / 2))


def counted(members: DataFrame, width: int, link: float) -> DataFrame:
    """Links of every member of a component, each other member standing for ``w`` vectors: node, n.

    Members are told apart by their angle to the component's centre, in steps.
    Two steps whose angles add up to less than the link's are linked throughout,
    two that differ by more nowhere; neither is looked into. Other pairs of steps
    are compared in pieces of ``PIECE`` by ``PIECE`` vectors, and give a count for
    each vector, never pairs.
    """
    limit, step = math.acos(link), math.pi / STEPS
    centre = members.groupBy("root").agg(F.array(*(F.sum(F.col("x")[i]) for i in range(width))).alias("c"))
    placed = members.join(centre, "root").withColumn("step", F.least((_angle(F.col("x"), F.col("c")) / step).cast("int"), F.lit(STEPS - 1))).drop("c")
    placed = settle(placed)
    tally = settle(placed.groupBy("root", "step").agg(F.sum("w").alias("total"), F.ceil(F.count("*") / PIECE).alias("pieces")))
    other = tally.select("root", F.col("step").alias("step2"), F.col("total").alias("total2"), F.col("pieces").alias("pieces2"))
    slip = 1e-9
    pairs = settle(tally.join(other, "root").where((F.abs(F.col("step") - F.col("step2")) - 1) * step <= limit + slip)
                   .withColumn("sure", (F.col("step") + F.col("step2") + 2) * step <= limit - slip))
    sure = pairs.where("sure").groupBy("root", "step").agg(F.sum("total2").alias("n"))
    out = placed.join(sure, ["root", "step"]).select("node", "n")
    open_pairs = pairs.where("not sure and step <= step2")
    cells = open_pairs.select("root", "step", "step2", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("p"), "pieces2").select(
        "root", "step", "step2", "p", F.explode(F.sequence(F.lit(0), F.col("pieces2") - 1)).alias("q")).where("step < step2 or p <= q")
    dealt = placed.join(tally.drop("total"), ["root", "step"]).withColumn("p", F.pmod(F.xxhash64("node", F.lit(5)), F.col("pieces")))
    left = cells.join(dealt.select("root", "step", "p", "node", "w", "x"), ["root", "step", "p"]).select("root", "step", "p", "step2", "q", F.lit(0).alias("side"), "node", "w", "x")
    right = cells.where("step < step2 or p < q").join(
        dealt.select("root", F.col("step").alias("step2"), F.col("p").alias("q"), "node", "w", "x"), ["root", "step2", "q"]).select(
        "root", "step", "p", "step2", "q", F.lit(1).alias("side"), "node", "w", "x")
    cell = ["root", "step", "p", "step2", "q"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, cell, width):
            a = run["side"] == 0
            alone = run["step"][0] == run["step2"][0] and run["p"][0] == run["q"][0]
            b = a if alone else ~a
            near = run["x"][a] @ run["x"][b].T >= link
            if alone:
                np.fill_diagonal(near, True)
            node, n = run["node"][a], near @ run["w"][b]
            if not alone:
                node, n = np.append(node, run["node"][b]), np.append(n, near.T @ run["w"][a])
            yield pa.RecordBatch.from_pydict({"node": pa.array(node, pa.int64()), "n": pa.array(n.astype(np.int64), pa.int64())})

    scanned = left.unionAll(right).repartition(*cell).sortWithinPartitions(*cell).mapInArrow(compare, "node bigint, n bigint")
    return out.unionAll(scanned).groupBy("node").agg(F.sum("n").alias("n"))


def near_duplicates(vectors: DataFrame, link: float = LINK, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Links and component of each vector under cosine ``link``: vec_id, n_links, component_id, kept.

    Equal vectors are one node. Sorted sign codes give each node its first
    neighbours; then neighbours of one node meet, lists take what is nearer, and
    saturated lists grow, until nothing changes; an audit on ``AUDITED`` nodes
    against all sends the graph back with more codes where its recall is too low.
    Neighbours further than twice the link's angle lead to no link and are not
    kept, so nodes without near ones cost nothing after the first step. Components
    come from the links of the graph; where a list is full of links at its
    longest, the links of its component are counted over all of its nodes.

    Defined cases: vectors null, zero, or with null or non-finite components have
    no link and are their own component; vectors of another length than the most
    common one are linked with their equals only; a vector without an id takes
    part, names no component and is not kept; repeated rows are vectors each,
    linked with each other; an empty table gives no rows; other columns are not read.
    """
    rows = vectors.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("raw"))
    largest = F.aggregate("raw", F.lit(0.0), lambda a, v: F.when(a.isNull() | v.isNull(), None).otherwise(F.greatest(a, F.abs(v))))
    rows = settle(rows.withColumn("m", largest).withColumn("good", F.coalesce((F.col("m") > 0) & (F.col("m") < float("inf")), F.lit(False))))
    classes = rows.where("good").groupBy("raw", "m").agg(F.min("vec_id").alias("least"), F.count("*").alias("w"))
    even = F.transform("raw", lambda v: v / F.col("m"))
    size = F.sqrt(F.aggregate("even", F.lit(0.0), lambda a, v: a + v * v))
    classes = settle(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("even", even)
                     .withColumn("x", F.transform("even", lambda v: v / size)).drop("even", "m"))
    most = classes.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if most is None:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    width, n = most
    nodes = classes.where(F.size("x") == width).select("node", "x", "w")
    floor = math.cos(min(math.pi, REACH * math.acos(link))) - 1e-9
    tables, pairs = 0, None
    for turn in range(AUDITS):
        more = range(tables, tables + tables_for(n, link) * (2**turn))
        tables = more.stop
        found = begin(nodes, width, more, floor)
        pairs = settle(found if pairs is None else pairs.unionAll(found).groupBy("u", "v").agg(F.max("s").alias("s")))
        graph = refine(pairs, nodes, width, link, floor)
        if audit(graph, nodes, width, link) >= AIM:
            break
        pairs = graph.select("u", "v", "s")
    ties = settle(linked(graph, link))
    star = components(ties.where("u > v").select(F.col("u").alias("a"), F.col("v").alias("b")))
    rooted = settle(classes.select("node", "least", "w").join(star, "node", "left").withColumn("root", F.coalesce("root", "node")))
    direct = ties.join(classes.select(F.col("node").alias("v"), "w"), "v").groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("n"))
    full = graph.where(F.col("s") >= link).groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") >= LONGEST)
    dense = settle(rooted.join(full.select(F.col("u").alias("node")), "node", "left_semi").select("root").distinct())
    members = rooted.join(dense, "root", "left_semi").join(nodes.select("node", "x"), "node").select("root", "node", "w", "x")
    whole = counted(members, width, link).withColumnRenamed("n", "all")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    result = (rooted.join(least, "root").join(direct, "node", "left").join(whole, "node", "left")
              .select("node", "component_id", F.coalesce(F.col("all") - 1, F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links")))
    result = classes.select(F.col("raw").alias("same"), "node").join(result, "node").drop("node")
    out = rows.where("good").join(result, F.col("raw") == F.col("same")).select("vec_id", "n_links", "component_id")
    rest = rows.where("not good").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionAll(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
