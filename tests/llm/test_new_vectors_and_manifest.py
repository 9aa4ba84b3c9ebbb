"""NN-descent, drift bounds and the Merkle manifest against brute force, and their defined cases."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from ledgerloom.llm import descent, merkle, spheres

VECTORS = "vec_id bigint, embedding array<double>, label int, node bigint, x string, q int, w int, root string"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, g string, leaf int, idx int, path string"


def vectors(spark, rows):
    """Vectors with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0, 1, "x", 2, 3, "r") for i, v in rows], VECTORS)


def noisy(rng, centre, cosine, n):
    """Vectors whose cosine with the centre is about the given one."""
    noise = rng.normal(size=(n, len(centre)))
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    return centre / np.linalg.norm(centre) + noise * math.sqrt(1 / cosine**2 - 1)


# ---------------------------------------------------------------- 11 NN-descent


def brute_links(rows, width, link):
    at = [k for k, (_, v) in enumerate(rows) if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    x = np.array([rows[k][1] for k in at], float).reshape(-1, width)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= link
    parent, count = list(range(len(rows))), [0] * len(rows)

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, j in zip(*np.nonzero(near)):
        if i != j:
            count[at[i]] += 1
            parent[max(find(at[i]), find(at[j]))] = min(find(at[i]), find(at[j]))
    members = {}
    for k in range(len(rows)):
        members.setdefault(find(k), []).append(rows[k][0])
    least = [min((i for i in members[find(k)] if i is not None), default=None) for k in range(len(rows))]
    return sorted(((rows[k][0], count[k], least[k], rows[k][0] is not None and rows[k][0] == least[k]) for k in range(len(rows))), key=str)


def links_of(spark, rows, link=descent.LINK):
    found = descent.near_duplicates(vectors(spark, rows), link)
    assert found.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in found.collect()), key=str)


def test_links_of_groups_copies_and_strangers_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    parts = [rng.normal(size=(400, 64))]
    for n, cosine in ((2, 0.99), (3, 0.98), (30, 0.985), (150, 0.99), (120, 0.976)):  # the last is only partly linked
        parts.append(noisy(rng, rng.normal(size=64), cosine, n))
    x = rng.permutation(np.concatenate(parts))
    x = np.concatenate([x, x[:40], x[:40], 3 * x[40:60]])  # copies, and one direction at another length
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(x)), x)]
    got, want = links_of(spark, rows), brute_links(rows, 64, descent.LINK)
    held, all_of = sum(r[1] for r in got), sum(r[1] for r in want)
    assert 0.99 * all_of <= held <= all_of
    assert sum(a == b for a, b in zip(got, want)) >= 0.98 * len(want)


def test_a_chain_of_turning_vectors_is_one_component(spark):
    """No sphere holds them all: counts come from comparing steps of the angle."""
    rng = np.random.default_rng(5)
    angle = np.sort(rng.uniform(0, 1.5, 600))
    x = np.zeros((600, 64))
    x[:, 0], x[:, 1] = np.cos(angle), np.sin(angle)
    x[:, 2:] = rng.normal(size=(600, 62)) * 0.002
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got, want = links_of(spark, rows), brute_links(rows, 64, descent.LINK)
    assert got == want and max(r[1] for r in want) > 2 * descent.LONGEST


def test_count_of_a_component_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = noisy(rng, rng.normal(size=16), 0.975, 300)
    x /= np.linalg.norm(x, axis=1)[:, None]
    weight = rng.integers(1, 4, 300)
    rows = [("r", i, int(w), v.tolist()) for i, (w, v) in enumerate(zip(weight, x))]
    members = spark.createDataFrame(rows, "root string, node bigint, w bigint, x array<double>").withColumnRenamed("root", "name").selectExpr("1L AS root", "node", "w", "x")
    monkeypatch.setattr(descent, "PIECE", 20)
    got = {r.node: r.n for r in descent.counted(members, 16, 0.95).collect()}
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, True)
    assert [got[i] for i in range(300)] == (near @ weight).tolist() and not near.all()


def test_lists_grow_when_saturated_and_the_audit_sees_what_is_missing(spark):
    rng = np.random.default_rng(7)
    x = noisy(rng, rng.normal(size=64), 0.99, 80)
    x /= np.linalg.norm(x, axis=1)[:, None]
    nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node bigint, x array<double>")
    pairs = spark.createDataFrame([(a, b, float(x[i] @ x[j])) for i in range(80) for j in [(i + 1) % 80] for a, b in ((i, j), (j, i))], descent.EDGE)
    graph = descent.refine(pairs, nodes, 64, 0.95, 0.8)
    assert graph.groupBy("u").count().agg({"count": "min"}).first()[0] == descent.LONGEST
    few = spark.createDataFrame([(0, 1, 0.99, False, 16), (1, 0, 0.99, False, 16)], "u bigint, v bigint, s double, fresh boolean, k int")
    assert descent.audit(few, nodes, 64, 0.95) < 0.1


def test_links_of_odd_vectors(spark):
    v = [1.0] * 64
    rows = [(1, v), (2, v), (2, v), (None, v), (4, None), (5, [0.0] * 64), (6, [None] + v[1:]), (7, [math.nan] + v[1:]), (8, [math.inf] + v[1:]),
            (9, []), (10, [1.0, 2.0]), (11, [-c for c in v]), (12, [1e200] * 64), (13, [1.0] * 32 + [0.0] * 32)]
    want = brute_links([(i, None if x is not None and len(x) == 64 and 1e200 in x else x) for i, x in rows if i != 12], 64, 0.95)
    got = links_of(spark, rows)
    by_id = {r[0]: r for r in got}
    assert by_id[12][1:3] == (4, 1) and by_id[1][1] == 4  # as large as doubles go: the same direction
    assert [r for r in got if r[0] != 12] == [(i, n + 1, c, k) if n else (i, n, c, k) for i, n, c, k in want]
    assert links_of(spark, [(4, None), (5, [0.0])]) == [(4, 0, 4, True), (5, 0, 5, True)]
    assert links_of(spark, []) == []
    twins = links_of(spark, [(None, v), (None, v)])
    assert twins == [(None, 1, None, False)] * 2


# ---------------------------------------------------------------- 12 drift bounds


def brute_clusters(rows, k=spheres.CLUSTERS, rounds=spheres.ROUNDS):
    kept = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)]
    first = sorted((r for r in kept if r[0] is not None), key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    places = [q for _, q in first]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, p)), c) for c, p in enumerate(places))
    for _ in range(rounds):
        of = [near(q)[1] for _, q in kept]
        for c in range(len(places)):
            own = [q for (_, q), o in zip(kept, of) if o == c]
            if own:
                places[c] = [sum(col) // len(own) for col in zip(*own)]
    last = [near(q) for _, q in kept]
    inertia = {c: sum(d for d, o in last if o == c) for _, c in last}
    sha = [hashlib.sha256(",".join(map(str, p)).encode()).hexdigest() for p in places]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), sha[c]) for (i, _), (d, c) in zip(kept, last)), key=str)


def clusters_of(spark, rows, **more):
    return sorted((tuple(r)[:6] for r in spheres.cluster(vectors(spark, rows), **more).collect()), key=str)


def test_clusters_equal_brute_force_and_few_vectors_are_scanned(spark):
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(12, 64)) / 8
    rows = [(i, (centres[i % 12] + rng.normal(size=64) * 0.02).tolist()) for i in range(400)]
    assert clusters_of(spark, rows, k=8) == brute_clusters(rows, k=8)
    last = spheres.cluster(vectors(spark, rows), k=8).collect()
    assert sum(r.scanned for r in last) < 0.2 * len(last)


def test_clusters_of_odd_vectors_ties_and_copies(spark):
    one = [0.5] * 64
    rows = [(1, one), (1, one), (2, one), (None, [0.25] * 64), (3, None), (4, [0.5] * 63), (5, [None] * 64), (6, [math.nan] * 64), (7, [math.inf] * 64),
            (8, [0.0] * 64), (9, [-1.0] * 64), (10, [1.0] + [0.0] * 63), (11, [0.3] * 64), (12, [-0.3] * 64)]
    assert clusters_of(spark, rows) == brute_clusters(rows)
    assert clusters_of(spark, rows, k=3) == brute_clusters(rows, k=3)
    assert clusters_of(spark, []) == [] and clusters_of(spark, [(None, one), (3, None)]) == []


def test_clusters_of_large_components_are_exact(spark):
    rng = np.random.default_rng(12)
    for scale in (1e5, 1e7):  # beyond what doubles, and 64-bit products, hold
        rows = [(i, (rng.normal(size=64) * scale).tolist()) for i in range(60)]
        got, want = clusters_of(spark, rows, k=5), brute_clusters(rows, k=5)
        fits = lambda n: n if n < 1 << 63 else None
        assert got == sorted(((i, c, fits(d), fits(a), fits(b), s) for i, c, d, a, b, s in want), key=str)


def test_loosening_bounds_every_gain_and_is_less_than_the_move():
    rng = np.random.default_rng(13)
    tighter = 0
    for _ in range(200):
        old = rng.normal(size=(6, 5))
        new = old + rng.normal(size=(6, 5)) * rng.choice([0.01, 0.3, 2.0])
        radius = rng.uniform(0, 1.5, 6)
        loss = spheres.loosening(old, new, radius)
        move = np.sqrt(((new - old) ** 2).sum(1))
        for i in range(6):
            way = rng.normal(size=(300, 5))
            x = old[i] + way / np.linalg.norm(way, axis=1)[:, None] * radius[i]
            gain = np.linalg.norm(x[:, None] - old[None], axis=2) - np.linalg.norm(x[:, None] - new[None], axis=2)
            assert np.delete(gain, i, 1).max() <= loss[i] + 1e-12
            tighter += loss[i] < 0.9 * np.delete(move, i).max()
    assert tighter > 100


# ---------------------------------------------------------------- 13 Merkle manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def brute_manifest(rows):
    """Rows as (doc_id, source, lang, n_chars, text)."""
    leaf = lambda r: h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))
    groups, out = {}, []
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    groups = {g: sorted(v, key=lambda x: x[:3]) for g, v in groups.items()}
    trees = {g: tree([x[2] for x in v]) for g, v in groups.items()}
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    top = tree([trees[g][-1][0] for g in order])
    for j, g in enumerate(order):
        for i, (_, _, own, r) in enumerate(groups[g]):
            hit = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node, way = leaf((*r[:3], r[3] + 1, r[4])) if hit else own, []
            for levels, k in ((trees[g], i), (top, j)):
                for level in levels[:-1]:
                    other = level[k ^ 1 : (k ^ 1) + 1]
                    node = h(*(other + [node] if k % 2 else [node] + other))
                    way, k = way + other, k // 2
            out.append((r[0], own, trees[g][-1][0], top[-1][0], h(*way), node, node == top[-1][0]))
    return sorted(out, key=str)


def manifest_of(spark, rows):
    frame = spark.createDataFrame([(i, t, g, s, n, "g", 1, 2, "p") for i, s, g, n, t in rows], DOCS)
    return sorted((tuple(r) for r in merkle.manifest(frame).collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 64, 65, 127, 129])
def test_positions_in_a_log_follow_from_sizes(n):
    height = merkle.levels(n)
    log, levels = merkle.append_log([str(i) for i in range(n)], height), tree([str(i) for i in range(n)])
    assert len(log) == merkle.size(n, height)
    for level, nodes in enumerate(levels):
        for i, node in enumerate(nodes):
            assert log[merkle.position(level, i, n)] == node


def test_manifest_of_trees_of_many_sizes_equals_brute_force(spark):
    rnd = random.Random(9)
    rows = []
    for lang, n in (("en", 4200), ("de", 64), ("fr", 65), (None, 7), ("é", 1), ("", 2), ("zz", 130)):
        rows += [(rnd.randrange(10**9), rnd.choice([None, "a", "ü"]), lang, rnd.choice([None, 0, 5]), f"text {k}") for k in range(n)]
    rnd.shuffle(rows)
    assert manifest_of(spark, rows) == brute_manifest(rows)


def test_manifest_of_odd_rows(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, "s", "en", 3, ""), (1, "s", "en", 3, ""), (1, "s", "en", 4, "x"),
            (2, "", "en", 2**63 - 1, "word " * 200_000), (-7, "s", None, -1, "\n"), (10, "s", "en", 1, "same"), (11, "s", "en", 1, "same")]
    near = [r for r in rows if r[3] != 2**63 - 1]
    assert manifest_of(spark, near) == brute_manifest(near)
    assert len(manifest_of(spark, rows)) == len(rows)
    assert manifest_of(spark, []) == []
    assert all(r[-1] for r in manifest_of(spark, [(1, "s", "en", None, "x")]))
    one = manifest_of(spark, [(3, "s", "en", None, "x")])[0]
    assert one[1] == one[2] == one[3] and one[4] == h()
