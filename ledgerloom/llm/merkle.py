"""A Merkle manifest of a dataset, kept as postorder append logs."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import map_rows, settle

#: Levels an aligned builder completes, so 64 leaves or nodes of the tier below.
HEIGHT = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    """H: sha256 of the joined inputs, lower-case hex."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(leaves: int) -> int:
    """Levels above ``leaves`` leaves until one node remains."""
    return max(0, leaves - 1).bit_length()


def size(leaves: int, height: int) -> int:
    """Nodes of a subtree of ``height`` levels above ``leaves`` leaves (2**height at most)."""
    return sum(-(-leaves >> k) for k in range(height + 1))


def position(level: int, i: int, leaves: int) -> int:
    """Postorder position of node ``i`` of a level in the log of a tree of so many leaves.

    Before it lie all nodes of the leaves to its left, which are 2m - popcount(m)
    for m leaves, as m is a multiple of 2**level; and the rest of its own subtree.
    """
    left = i << level
    return 2 * left - left.bit_count() + size(min(1 << level, leaves - left), level) - 1


def append_log(leaves: list[str], height: int) -> list[str]:
    """All nodes of a subtree in the order in which they are completed; a run of one at the end has a parent of its own."""
    log: list[str] = []
    waiting: list[str | None] = [None] * height
    for node in leaves:
        log.append(node)
        level = 0
        while level < height and waiting[level] is not None:
            node, waiting[level] = digest(waiting[level], node), None
            log.append(node)
            level += 1
        if level < height:
            waiting[level] = node
    last = None
    for held in waiting:
        if held or last:
            last = digest(held or "", last or "")
            log.append(last)
    return log


def siblings(log: list[str], i: int, leaves: int, height: int) -> list[str]:
    """For each level on the way of leaf ``i`` up: the sibling, marked < if it lies left and > if right, or nothing."""
    out = []
    for level in range(height):
        other = (i >> level) ^ 1
        there = other << level < leaves
        out.append(("<" if other < i >> level else ">") + log[position(level, other, leaves)] if there else "")
    return out


def fold(leaf: str, path: list[str]) -> str:
    """The root that a leaf and the siblings on its way give."""
    for step in path:  # an only child has an empty step
        leaf = digest(step[1:], leaf) if step[:1] == "<" else digest(leaf, step[1:])
    return leaf


def _indexed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows of a group ``g`` numbered from 0 (``idx``) in the given order, with their number ``leaves``.

    One range sort of all rows, whatever the sizes of the groups; the numbers come
    from the counts of each partition, of which there are as many as partitions
    and groups.
    """
    rows = rows.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    rows = settle(rows.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()))
    spans = rows.groupBy("part", "g").agg(F.min("row").alias("first"), F.count("*").alias("n"))
    so_far = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("before", F.coalesce(F.sum("n").over(so_far), F.lit(0)))
    spans = spans.withColumn("leaves", F.sum("n").over(Window.partitionBy("g"))).drop("n")
    return rows.join(spans, ["part", "g"]).withColumn("idx", F.col("row") - F.col("first") + F.col("before")).drop("part", "row", "first", "before")


def _logs(leaves: DataFrame) -> list[DataFrame]:
    """The logs of all aligned builders, tier by tier: g, block, leaves, log, and the ids and other leaves of the lowest.

    A builder takes 64 consecutive leaves of its group; what it completes last is
    a leaf of the tier above, until a group is within one builder.
    """
    def run(groups: list, blocks: list, totals: list, nodes: list, ids: list, others: list) -> Iterator[tuple]:
        for g, b, n, held, i, o in zip(groups, blocks, totals, nodes, ids, others):
            yield g, b, n, i, o, append_log(held, HEIGHT if n > 1 << HEIGHT else levels(n))

    tiers = []
    while True:
        cells = leaves.groupBy("g", F.shiftright("idx", HEIGHT).alias("block")).agg(
            F.first("leaves").alias("leaves"), F.sort_array(F.collect_list(F.struct("idx", "node", "doc_id", "other"))).alias("held"))
        cells = cells.select("g", "block", "leaves", "held.node", "held.doc_id", "held.other")
        tiers.append(settle(map_rows(cells, run, g="string", block="bigint", leaves="bigint", doc_id="array<bigint>",
                                     other="array<string>", log="array<string>")))
        leaves = tiers[-1].where(F.col("leaves") > 1 << HEIGHT).select(
            "g", F.col("block").alias("idx"), F.ceil(F.col("leaves") / (1 << HEIGHT)).alias("leaves"),
            F.element_at("log", -1).alias("node"), F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("other"))
        if leaves.isEmpty():
            return tiers


def _crowns(tiers: list[DataFrame]) -> DataFrame:
    """The subroot of each group: g, node."""
    done = [t.where(F.col("leaves") <= 1 << HEIGHT).select("g", F.element_at("log", -1).alias("node")) for t in tiers]
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    return out


def _proofs(tiers: list[DataFrame], above: DataFrame) -> DataFrame:
    """Each leaf with the siblings on its way up: g, doc_id, other, node, path, and the columns of ``above``.

    ``above`` has a row for each group: g, subroot, root and the path from the
    subroot. A builder's log holds the siblings of its levels at positions known
    from sizes alone; the rest of the way is that of its last node.
    """
    def run(groups: list, blocks: list, totals: list, ids: list, others: list, logs: list, subroots: list, roots: list, paths: list) -> Iterator[tuple]:
        for g, b, n, i, o, log, subroot, root, up in zip(groups, blocks, totals, ids, others, logs, subroots, roots, paths):
            height, here = (HEIGHT if n > 1 << HEIGHT else levels(n)), min(1 << HEIGHT, n - (b << HEIGHT))
            for k in range(here):
                yield g, (b << HEIGHT) + k, i[k], o[k], log[position(0, k, here)], subroot, root, siblings(log, k, here, height) + up

    held = ["g", "block", "leaves", "doc_id", "other", "log", "subroot", "root", "path"]
    found = None
    for tier in reversed(tiers):
        rows = tier.where(F.col("leaves") <= 1 << HEIGHT).join(above, "g").select(*held)
        if found is not None:
            up = found.select("g", F.col("idx").alias("block"), "subroot", "root", "path")
            rows = rows.unionAll(tier.where(F.col("leaves") > 1 << HEIGHT).join(up, ["g", "block"]).select(*held))
        found = map_rows(rows, run, 100, g="string", idx="bigint", doc_id="bigint", other="string", node="string", subroot="string",
                         root="string", path="array<string>")
        if tier is not tiers[0]:
            found = settle(found)
    return found


def leaf(**changed: Column) -> Column:
    """H of the fields, each as its number of UTF-8 bytes, a colon and its value; null is a single dash."""
    values = [changed.get(f, F.col(f)).cast("string") for f in FIELDS]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values)), 256)


def manifest(docs: DataFrame) -> DataFrame:
    """The proof of each row of a table of documents, and whether it holds for what may have been tampered with.

    Per ``lang``, leaves ascend by doc_id and runs of two become their parent until
    the subroot is left; the subroots in the order of the languages give the root
    likewise. Every builder takes 64 aligned leaves and appends nodes as they are
    completed, that is in postorder; builders of one tier work side by side, and
    siblings are read at positions that follow from the sizes of subtrees.
    Tampered with (``n_chars`` one more) is what has a crc32 of its id divisible
    by 7; the proof is then folded from the changed leaf.

    Columns: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.
    Defined cases: rows without a doc_id come first and are never tampered with;
    rows of one doc_id are in the order of their leaves, and rows equal in all
    fields are leaves each; a null language is a tree of its own, the first; a
    null ``n_chars`` and one that has no successor stay; a single leaf is the
    subroot, a single subroot the root; an empty table gives no rows; texts of any
    length are hashed whole; other columns are not read.
    """
    docs = docs.select(*(F.col(f).cast("bigint" if f in ("doc_id", "n_chars") else "string").alias(f) for f in FIELDS))
    hit = F.col("n_chars").isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 7 == 0)
    more = F.coalesce(F.try_add("n_chars", F.lit(1)), F.col("n_chars"))
    marked = settle(docs.select(
        F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("+"), F.col("lang"))).alias("g"), "doc_id",
        leaf().alias("node"), F.when(hit, leaf(n_chars=more)).alias("other"), F.monotonically_increasing_id().alias("no")))
    tiers = _logs(_indexed(marked, ["doc_id", "node", "no"]).drop("no"))
    crowns = settle(_crowns(tiers).withColumnRenamed("g", "lang").select(
        F.lit("").alias("g"), F.lit(None).cast("bigint").alias("doc_id"), F.col("lang").alias("other"), "node"))
    top = _logs(_indexed(crowns, ["other"]))
    root = _crowns(top).select("g", F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"), F.array().cast("array<string>").alias("path"))
    above = settle(_proofs(top, root).select(F.col("other").alias("g"), F.col("node").alias("subroot"), "root", "path"))

    def run(ids: list, nodes: list, others: list, subroots: list, roots: list, paths: list) -> Iterator[tuple]:
        for i, node, other, subroot, top, path in zip(ids, nodes, others, subroots, roots, paths):
            folded = fold(other or node, path)
            yield i, node, subroot, top, digest(*(s[1:] for s in path)), folded, folded == top

    found = _proofs(tiers, above).select("doc_id", "node", "other", "subroot", "root", "path")
    return map_rows(found, run, doc_id="bigint", leaf="string", subroot="string", root="string", proof_sha256="string",
                    folded_root="string", verified="boolean")
