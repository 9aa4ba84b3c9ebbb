"""Each text operator against a brute-force version, and its defined cases."""

import collections
import hashlib
import html
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import kneser, lines, markup, nearest, pieces, queries, sharding, simhash, suffixes, tiling, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "red green blue one two three four five six seven eight nine ten".split()


def table(spark, texts, first=0):
    """Documents with columns whose names the operators use themselves."""
    rows = [(None if t is NO_KEY else first + i, None if t is NO_KEY else t, "en", f"s{i % 2}", 0, "x", 7, -1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS + ", key string, size int, shard int")


NO_KEY = object()
ODD = ["", None, "a", "   \n\t ", NO_KEY, "same text here", "same text here", "ÀÉ \U0001f600 ▁ x", "word " * 30_000]


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "", ",", "er", "s"]) for _ in range(n))


# ---------------------------------------------------------------- 1 decontamination


def naive_tiles(a, b, least):
    a, b, out = list(a), list(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and a[i + k] >= 0:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < least:
            return out
        k, i, j = best
        out.append((i, j, k))
        a[i : i + k], b[j : j + k] = [-2] * k, [-3] * k


def test_tiles_equal_the_naive_greedy():
    rnd = random.Random(3)
    for _ in range(400):
        a = [rnd.randint(0, 3) for _ in range(rnd.randint(0, 25))]
        b = [rnd.choice([0, 1, 2, 3, -1]) for _ in range(rnd.randint(0, 40))]
        if rnd.random() < 0.5 and len(a) > 9:
            b = b[:8] + a[6:] + b[8:12] + a[:6] + b[12:]
        least = rnd.choice([2, 3, 5])
        b_gap = [-3 if x < 0 else x for x in b]
        assert sorted(tiling.tile(np.array(a, np.int64), np.array(b, np.int64), least)) == sorted(naive_tiles(a, b_gap, least))


def test_repetitive_texts_are_tiled_without_pairs():
    same = lambda n: np.zeros(n, np.int64)
    assert tiling.tile(same(400), same(200_000)) == [(0, 0, 400)]
    assert tiling.tile(same(4_000), same(1_001)) == [(0, 0, 1_001)]
    runs = np.concatenate([np.append(same(50), -1) for _ in range(3_000)])
    assert tiling.tile(same(400), runs) == [(50 * i, 51 * i, 50) for i in range(8)]
    item = "same " * 200
    block = tiling.Items([(7, item)], tiling.MIN_TILE, tiling.COVERAGE)
    assert list(block.search("same " * 200_000)) == [(7, 1.0, 1, 200)]
    assert list(block.search("same " * 100)) == []


def test_contamination(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    words = item.split()
    reordered = " ".join(words[6:] + ["filler"] + words[:6]).upper()
    part = " ".join(words[:6])
    docs = table(spark, ["before " + item + " after", reordered, part, "nothing at all", *ODD])
    tests = spark.createDataFrame([(1, item), (2, "too short"), (3, None), (1, item)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r for r in tiling.contaminated(docs, tests).collect()}
    assert set(got) == {(0, 1), (1, 1)}
    assert got[(1, 1)].n_tiles == 2 and got[(1, 1)].coverage == 1.0
    kept = tiling.clean(docs, tests)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 2
    assert tiling.contaminated(docs, tests.limit(0)).count() == 0
    assert tiling.contaminated(docs.limit(0), tests).count() == 0


def test_benchmark_goes_in_blocks(spark):
    tests = spark.createDataFrame([(i, f"item number {i} has its own words here w{i} v{i}") for i in range(40)], "item_id bigint, text string")
    docs = table(spark, [f"x y item number {i} has its own words here w{i} v{i} z" for i in range(40)])
    want = {(i, i) for i in range(40)}
    for size in (10**6, 300):
        found = []
        for block in tiling.blocks(tests, "item_id", "text", 5, 0.9, size):
            found += [(k, i) for k, i, *_ in block.search_all([r.text for r in docs.orderBy("doc_id").collect()])]
        assert set(found) == want and len(found) == 40


# ---------------------------------------------------------------- 2 language model


@pytest.mark.parametrize("order, hot, bucket", [(2, 1e-3, 6_000_000), (3, 1e-3, 6_000_000), (3, 0.02, 500)])
def test_kneser_ney_equals_a_dictionary_version(spark, monkeypatch, order, hot, bucket):
    monkeypatch.setattr(kneser, "HOT", hot)
    monkeypatch.setattr(kneser, "BUCKET", bucket)
    rnd = random.Random(1)
    texts = [prose(rnd, rnd.randint(0, 60)) for _ in range(120)] + ODD[:4] + ODD[5:] + ["red sea blue " * 400]
    docs = table(spark, texts)
    got = {r.doc_id: r for r in kneser.score_documents(docs, order=order).collect()}
    tokens = {k: [*(t or "").encode().lower().split(), None] for k, t in enumerate(texts)}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in tokens}
    uni, pairs, triples = collections.Counter(), collections.Counter(), collections.Counter()
    for k, w in tokens.items():
        if not held[k]:
            uni.update(w)
            pairs.update(zip([0, *w[:-1]], w))
            triples.update(zip([0, 0, *w][:len(w)], [0, *w[:-1]], w))
    if order == 3:
        pairs = collections.Counter((b, c) for _, b, c in triples)
    behind = collections.defaultdict(lambda: [0, 0, 0, 0])
    for (a, b, _), c in triples.items():
        behind[a, b][0] += c
        behind[a, b][min(c, 3)] += 1
    n, v = sum(uni.values()), len(uni)
    of = collections.defaultdict(lambda: [0, 0, 0, 0])
    after = collections.Counter(b for _, b in pairs)
    for (a, _), c in pairs.items():
        of[a][0] += c
        of[a][min(c, 3)] += 1
    d3, d2, d1 = (kneser.discounts([sum(x == k for x in y.values()) for k in (1, 2, 3, 4)]) for y in (triples, pairs, after))
    spare = sum(d1[min(c, 3) - 1] for c in after.values())

    def p1(b):
        c = after.get(b, 0)
        return ((c - d1[min(c, 3) - 1] if c else 0) + spare / (v + 1)) / len(pairs)

    def p2(a, b):
        if a not in of:
            return p1(b)
        t, c = of[a], pairs.get((a, b), 0)
        return (c - d2[min(c, 3) - 1] if c else 0) / t[0] + sum(x * y for x, y in zip(t[1:], d2)) / t[0] * p1(b)

    def p3(z, a, b):
        if order == 2 or (z, a) not in behind:
            return p2(a, b)
        t, c = behind[z, a], triples.get((z, a, b), 0)
        return (c - d3[min(c, 3) - 1] if c else 0) / t[0] + sum(x * y for x, y in zip(t[1:], d3)) / t[0] * p2(a, b)

    assert abs(sum(p3(0, 0, w) for w in [*uni, "unseen"]) - 1) < 1e-9
    assert abs(sum(p2(b"red", w) for w in [*uni, "unseen"]) - 1) < 1e-9
    for k, w in tokens.items():
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[k], len(w), sum(x in uni for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((uni.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert r.score == pytest.approx(sum(math.log10(p3(*x)) for x in zip([0, 0, *w][:len(w)], [0, *w[:-1]], w)))


def test_kneser_ney_without_training(spark):
    assert kneser.score_documents(table(spark, [])).count() == 0
    one = next(k for k in range(50) if zlib.crc32(str(k).encode()) % 5 == 1)
    r = kneser.score_documents(table(spark, ["a b"], one)).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.score) == (True, 3, 0, 0, 0.0)


# ---------------------------------------------------------------- 3 repeated strings


def brute_repeats(rows, length):
    first, out = {}, {}
    for k, t in rows:
        for p in range(len(t) - length + 1):
            first.setdefault(t[p : p + length], (k, p))
    for k, t in rows:
        cover = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < (k, p):
                cover[p : p + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~cover])
        out[k] = (len(t), int(cover.sum()), int((np.diff(cover.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("hot", [suffixes.HOT, 2])
def test_repeats_equal_brute_force(spark, hot):
    rnd = random.Random(4)
    texts = [prose(rnd, rnd.randint(5, 60)) for _ in range(30)]
    for _ in range(30):
        a, b = rnd.choice(texts), rnd.choice(texts)
        texts.append(prose(rnd, rnd.randint(0, 5)) + a[rnd.randint(0, len(a)) :] + "é" + b[: rnd.randint(0, 300)])
    texts += [texts[3], "ab" * 200, "", None, "z" * 500]
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.remove_repeats(table(spark, texts), hot=hot).collect()}
    assert got == brute_repeats([(k, (t or "").encode()) for k, t in enumerate(texts)], 100)


def test_repeats_defined_cases(spark):
    docs = table(spark, ODD)
    rows = suffixes.remove_repeats(docs.unionAll(docs), texts=True).collect()
    assert len(rows) == 2 * len(ODD) and {r.doc_id for r in rows} == {None, *range(len(ODD))} - {4}
    assert suffixes.remove_repeats(table(spark, [])).count() == 0


def test_rows_that_share_a_key_are_texts_of_their_own(spark):
    rnd = random.Random(18)
    a, b, c, d, e = (prose(rnd, 80) for _ in range(5))
    rows = [(1, a), (None, a + b), (None, c + d), (None, c + d), (None, e), (2, c), (2, d), (2, b)]
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), texts=True).collect()
    assert {(r.doc_id, bytes(r.kept).decode()) for r in got if r.doc_id} == {(1, a), (2, b), (2, c), (2, d)}
    left = sorted((r.n_bytes, bytes(r.kept).decode()) for r in got if r.doc_id is None)
    # the bytes of a + b and c + d all lie in windows that stand earlier; those of e in none
    assert left == sorted([(len(a + b), ""), (len(c + d), ""), (len(c + d), ""), (len(e), e)])


def test_blocks_of_texts_have_the_anchors_of_all(monkeypatch):
    rnd = random.Random(9)
    bodies = [prose(rnd, rnd.randint(0, 60)).encode() for _ in range(40)]
    bounds = np.concatenate([[0], np.cumsum([len(b) for b in bodies])])
    want = suffixes.anchors(np.frombuffer(b"".join(bodies), np.uint8), 30, 30, bounds)
    for block in (1, 100, 700, 10**6):
        monkeypatch.setattr(suffixes, "BLOCK", block)
        assert all(np.array_equal(a, b) for a, b in zip(want, suffixes._by_blocks(bodies, bounds, 30)))


def test_transform_orders_as_comparing_does_with_symbols_of_eight_bytes():
    rnd = random.Random(10)
    for n in (1, 3, 12):
        pieces = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 40))) + b"\0" for _ in range(n)]
        text, bounds = np.frombuffer(b"".join(pieces), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        order, before = suffixes.shard_transform(text, bounds)
        turned = [(p * (1 + 300 // len(p)))[i:] for p in pieces for i in range(len(p))]
        assert [turned[k][:200] for k in order] == sorted(x[:200] for x in turned)
        for k, b in zip(order, before):
            p = pieces[i := int(np.searchsorted(bounds, k, "right")) - 1]
            assert int(b).to_bytes(8, "big") == (p * 9 + p[: k - bounds[i]])[-8:]
    order, keys = suffixes._order(np.array([2**63, 5, 2**63, 0], np.uint64), 64)
    assert order.tolist() == [3, 1, 0, 2] and keys.tolist() == [0, 5, 2**63, 2**63]


def test_spans_of_a_text_are_united_up_to_its_end():
    spans = [[], None, [(50, 60), (3, 9), (9, 12), (55, 70)], [(0, 100), (20, 30)], [(200, 300)], [(13, 14)]]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    column = pa.array([x and [{"start": a, "stop": b} for a, b in x] for x in spans], kind)
    want = [[], [], [(3, 12), (50, 65)], [(0, 100)], [], [(13, 14)]]
    sizes = [10, 10, 65, 100, 200, 14]
    assert suffixes._united(column, sizes) == want
    assert suffixes._united(column.slice(2, 3), sizes[2:5]) == want[2:5]


def test_merge_orders_all_suffixes():
    rnd = random.Random(8)
    parts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(6, 30))) for _ in range(12)]
    for shard in (20, 10**6):
        piece, offset = suffixes.repeats(parts, np.arange(12), np.zeros(12, int), np.array([len(p) - 5 for p in parts]), 6, shard)
        first = {}
        for k, p in enumerate(parts):
            for o in range(len(p) - 5):
                first.setdefault(p[o : o + 6], (k, o))
        want = {(k, o) for k, p in enumerate(parts) for o in range(len(p) - 5) if first[p[o : o + 6]] < (k, o)}
        assert set(zip(piece.tolist(), offset.tolist())) == want


# ---------------------------------------------------------------- 4 toxicity


def brute_segments(scores):
    """Ruzzo and Tompa's recursive definition: the best segment, then both sides."""
    def inside(a, b):
        best = max(((sum(scores[i:j]), -i, -j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        i, j = -best[1], -best[2]
        return inside(a, i) + [(i, j, best[0])] + inside(j, b)

    return inside(0, len(scores))


def test_segments_equal_their_definition():
    rnd = random.Random(2)
    for _ in range(200):
        scores = [rnd.choice([-5, -3, -1, 2, 4, 7]) + rnd.random() for _ in range(rnd.randint(0, 14))]
        got, want = toxicity.segments(scores), brute_segments(scores)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert [x[2] for x in got] == pytest.approx([x[2] for x in want])


def test_toxicity_learns_and_holds_out(spark):
    rnd = random.Random(6)
    texts = [prose(rnd, 40) + (" you vile rotten vile fool " if i % 4 == 0 else " ") + prose(rnd, 40) for i in range(400)]
    docs = table(spark, texts)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_documents(docs, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r.score <= 1 for k, r in got.items())
    assert all(r.predicted == (r.score >= 0.3) == (k % 4 == 0) for k, r in got.items())
    passage = got[0].passages
    assert 35 <= passage[0] <= passage[1] <= 60
    # labels of the held-out class change nothing
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.score_documents(docs, turned).collect()}
    assert all(again[k] == pytest.approx(r.score) for k, r in got.items())


def test_toxicity_defined_cases(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    rows = toxicity.score_documents(table(spark, ODD), labels).collect()
    assert len(rows) == len(ODD) and all(r.predicted == 0 for r in rows)


# ---------------------------------------------------------------- 5 sharding


def test_shards(spark):
    rnd = random.Random(9)
    texts = [None, ""] + ["x" * rnd.randint(0, 300) for _ in range(300)]
    docs = table(spark, texts)
    rows = sharding.shard(docs.unionAll(docs.limit(5))).orderBy("doc_id", "shard", "slot").collect()
    assert len(rows) == 307
    total, before, seen = sum(r["size"] for r in rows), 0, collections.Counter()
    for r in rows:
        text = texts[r.doc_id] or ""
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(text) + 1, zlib.crc32(text.encode()), "bytes", None)
        assert r["shard"] == (2 * before + r["size"]) * 8 // (2 * total) and r.slot == seen[r["shard"]]
        seen[r["shard"]] += 1
        before += r["size"]
    assert sharding.shard(table(spark, [])).count() == 0
    assert sharding.shard(table(spark, ODD)).count() == len(ODD)


# ---------------------------------------------------------------- 6 nearest neighbours


def test_nearest_recall_and_order(spark):
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(600, 16)) * rnd.uniform(0.5, 2, (600, 1))
    rows = [(i, [float(v) for v in np.float32(r)], 0) for i, r in enumerate(x)]
    rows += [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, [None] * 16, 0), (1004, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = collections.defaultdict(list)
    for r in nearest.nearest(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    x = np.float32(x).astype(float)
    assert set(got) == set(range(0, 600, 20))
    hits = 0
    for q, found in got.items():
        score = x @ x[q]
        assert [f[0] for f in found] == list(range(1, 21)) and q not in [f[1] for f in found]
        assert [f[2] for f in found] == pytest.approx([score[f[1]] for f in found])
        assert sorted(found, key=lambda f: (-f[2], f[1])) == found
        score[q] = -np.inf
        hits += len({f[1] for f in found} & set(np.argsort(-score)[:20].tolist()))
    assert hits / (20 * len(got)) >= 0.9


def test_nearest_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 1.0]), (2, [0.5, 1.0])], "vec_id bigint, embedding array<float>")
    assert [(r.vec_id, r.score) for r in nearest.nearest(df).orderBy("rank").collect()] == [(1, 0.5), (2, 0.5)]
    assert nearest.nearest(df.limit(0)).count() == 0


def test_nearest_copies_of_a_query_that_differ(spark):
    rows = [(20, [0.0, 1.0]), (20, [-1.0, 3.0]), (20, [-1.0, 2.0]), (1, [1.0, 0.0]), (2, [-1.0, 0.5]), (2, [-1.0, 0.5])]
    for n in (1, 7):
        df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(n)
        got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in nearest.nearest(df).collect()]
        assert sorted(got) == [(20, 1, 2, 2.0), (20, 2, 2, 2.0), (20, 3, 1, -1.0)]


def test_probing_finds_every_code_in_the_radius():
    rnd = np.random.default_rng(3)
    codes = rnd.integers(0, 1 << 62, 3000, dtype=np.uint64)
    for k in range(0, 3000, 3):  # near codes of the first one
        codes[k] = codes[0] ^ np.uint64(sum(1 << int(b) for b in rnd.choice(64, rnd.integers(0, 14), replace=False)))
    for radius in (0, 3, 9, 12):
        radii = nearest.substring_radii(radius)
        found = set()
        for j in range(nearest.SUBSTRINGS):
            value = int(codes[0]) >> (16 * j) & 0xFFFF
            found |= set(nearest.Table(codes, j).probe(value, radii[j], nearest.ball(16, max(radii))).tolist())
        assert set(np.flatnonzero(np.bitwise_count(codes ^ codes[0]) <= radius).tolist()) <= found


# ---------------------------------------------------------------- 7 pieces


@pytest.fixture(scope="module")
def model():
    return pieces.Model(queries.PIECES)


def test_encoding_equals_the_library(model):
    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    rnd = random.Random(1)
    signs = list("  ab the▁éß<>0x1\n\t漢字😀\x00ﻁİﬁ１²àaeiourstń .,'-") + ["<s>", "</s>", "<unk>", "<0x41>", "▁▁", "  "]
    memory = pieces.Memory(model)
    for _ in range(4000):
        text = "".join(rnd.choice(signs) for _ in range(rnd.randint(0, 16)))
        ids = memoryview(pieces.encode_text(memory, text)).cast("I").tolist()
        assert ids == library.encode(text, add_bos=True, add_eos=True), repr(text)
        assert model.decode(ids).decode() == library.decode(ids)
    for _ in range(3000):
        ids = [rnd.choice([0, 1, 2, rnd.randint(3, 258), rnd.randint(259, 31999)]) for _ in range(rnd.randint(0, 6))]
        assert model.decode(ids).decode() == library.decode(ids)


def test_compatibility_equals_merging_again(model):
    rnd = random.Random(2)
    tokens = list(model.token)
    for _ in range(20_000):
        a, b = rnd.choice(tokens), rnd.choice(tokens)
        assert model.compatible(a, b) == (model.merge(a + b) == [a, b])


def test_encoding_documents(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    texts = [t for t in ODD if t is not NO_KEY] + ["a" * 5000, "漢" * 300]
    for r in pieces.encode_documents(table(spark, texts), queries.PIECES).collect():
        ids = library.encode(texts[r.doc_id] or "", add_bos=True, add_eos=True)
        packed = np.array(ids, "<u4").tobytes()
        back = library.decode(ids).encode()
        assert tuple(r)[1:] == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(back).hexdigest())
    assert pieces.encode_documents(table(spark, []), queries.PIECES).count() == 0


# ---------------------------------------------------------------- 8 SimHash


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    names = dict(rows)
    root = {k: k for k in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in names:
        for b in names:
            if a < b and (names[a] ^ names[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in names}


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(5)
    texts = [prose(rnd, rnd.randint(1, 150)) for _ in range(40)]
    for _ in range(80):
        words = rnd.choice(texts).split()
        for _ in range(rnd.randint(0, 2)):
            words[rnd.randrange(len(words))] = rnd.choice(WORDS)
        texts.append(" ".join(words))
    texts += [t for t in ODD if t is not NO_KEY]
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.near_duplicates(table(spark, texts)).collect()}
    prints = {k: brute_fingerprint(t) for k, t in enumerate(texts)}
    assert {k: f for k, (f, _) in got.items()} == prints
    assert {k: c for k, (_, c) in got.items()} == brute_components(list(prints.items()))


@pytest.mark.parametrize("parts", [2, 3, 4])
def test_thresholds_keep_the_pigeonhole_rule_and_links_are_whole(spark, parts, monkeypatch):
    monkeypatch.setattr(simhash, "parts_for", lambda n, radius: parts)
    rnd = np.random.default_rng(parts)
    codes = rnd.integers(-(1 << 62), 1 << 62, 400)
    codes = np.unique(np.concatenate([codes, *[codes[:150] ^ (1 << rnd.integers(0, 63, 150)) for _ in range(3)]]))
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(int(c),) for c in codes], "fp bigint")).collect()}
    u = codes.view(np.uint64)
    a, b = np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= 3)
    assert got == {(int(codes[i]), int(codes[j])) for i, j in zip(a, b) if codes[i] > codes[j]}
    index = simhash.Index(simhash.group_bits(simhash.co_occurrence(u), len(u), parts), 3)
    index.learn(index.histogram(u), len(u))
    assert (index.thresholds(simhash.bits_of(u)).sum(1) == 3 - parts + 1).all()


def brute_groups(texts):
    """Smallest key that each text reaches over pairs with a Jaccard similarity of 0.8 on five-word shingles."""
    sets = {}
    for k, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in root}


def test_near_copies_are_found_and_others_left(spark):
    rnd = random.Random(15)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7)))
    texts = [" ".join(word() for _ in range(rnd.randint(80, 300))) for _ in range(60)]
    for k in range(60):
        words = rnd.choice(texts[:60]).split()
        for _ in range(rnd.randint(0, 2)):
            words[rnd.randrange(len(words))] = word()
        texts.append(" ".join(words) + (" " + texts[k] if k % 10 == 0 else ""))
    texts += [texts[0], None, "", "one two", "two one", texts[1].upper()]
    want = brute_groups(dict(enumerate(texts)))
    got = {r.doc_id: r.keep for r in simhash.near_copies(table(spark, texts)).collect()}
    assert got == want and len(set(want.values())) < len(texts) - 40
    assert simhash.near_copies(table(spark, [])).count() == 0
    assert simhash.near_copies(table(spark, ODD)).count() == len(ODD)


def test_texts_under_one_id_are_judged_apart(spark):
    rnd = random.Random(4)
    a, b = prose(rnd, 100), prose(rnd, 120)
    rows = [(1, a), (5, a), (5, b), (None, b + " more"), (None, "else " * 9), (7, a), (7, a)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = sorted((tuple(r) for r in simhash.near_copies(docs).select("doc_id", "keep", "kept").collect()), key=str)
    assert got == sorted([(1, 1, True), (5, 1, False), (5, 5, True), (None, 5, False), (None, None, True), (7, 1, False), (7, 1, False)], key=str)


def test_shingles_are_sent_once_for_all_bands_that_texts_share(spark, monkeypatch):
    rnd = random.Random(33)
    texts = []
    for k in range(12):  # 0.6 to 0.8 alike
        base = [f"w{rnd.randrange(9999)}" for _ in range(200)]
        for _ in range(6):
            words = list(base)
            for at in rnd.sample(range(200), 3):
                words[at] = f"v{rnd.randrange(9999)}"
            texts.append(" ".join(words))
    frame, sent = type(spark.range(1)), []
    deal = frame.repartition

    def counted(df, *by):
        if "hashes" in df.columns:
            sent.append(df.count())
        return deal(df, *by)

    monkeypatch.setattr(frame, "repartition", counted)
    got = {r.doc_id: r.keep for r in simhash.near_copies(table(spark, texts)).collect()}
    assert got == brute_groups(dict(enumerate(texts))) and max(sent) <= len(texts)


def test_sets_of_open_texts_meet_in_few_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 3)
    sets = {"a": [1, 2], "b": [1, 2, 3], "c": [3, 4], "d": [8, 9], "e": list(range(20, 29)), "f": [20, 29]}
    rows = [(k, min(v), 0, n, n) for k, v in sets.items() for n in v]
    out = {}
    for r in simhash._gathered(spark.createDataFrame(rows, "cell string, low bigint, side int, node bigint, root bigint")).collect():
        out.setdefault(r.cell, []).append(r.node)
    assert sorted(map(sorted, out.values())) == [[1, 2, 3, 4], [8, 9], list(range(20, 29)), [20, 29]]


def test_bands_of_families_below_the_threshold_are_compared_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 7)
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7)))
    shared, texts = [word() for _ in range(200)], []
    for k in range(60):  # about 0.6 to 0.9 alike
        own = list(shared)
        at, n = rnd.randrange(180), rnd.choice([9, 14, 18])
        own[at : at + n] = [word() for _ in range(n)]
        texts.append(" ".join(own))
    want = brute_groups(dict(enumerate(texts)))
    assert {r.doc_id: r.keep for r in simhash.near_copies(table(spark, texts)).collect()} == want
    assert 1 < len(set(want.values())) < 60


def test_near_copies_behind_the_first_of_a_fingerprint(spark):
    rnd = random.Random(16)
    words = [f"w{i}" for i in range(120)]
    b = rnd.sample(words, 120)
    c = b[:60] + b[62:] + b[60:62]
    far = b + [f"new{i}" for i in range(12)]  # another fingerprint, near b alone
    texts = [" ".join(x) for x in (rnd.sample(words, 120), b, c, far)]
    assert len({simhash.fingerprint(t, 1, 42, True) for t in texts[:3]}) == 1
    got = {r.doc_id: r.keep for r in simhash.near_copies(table(spark, texts)).collect()}
    assert got == brute_groups(dict(enumerate(texts))) == {0: 0, 1: 1, 2: 1, 3: 1}


def test_near_copies_of_added_cut_and_replaced_text(spark):
    rnd = random.Random(17)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    texts = [[word() for _ in range(300)] for _ in range(20)]
    for t in texts[:20]:
        texts += [t + [word() for _ in range(60)], [word() for _ in range(50)] + t, t[:250], t[:100] + t[150:]]
        texts.append([word() if i % 50 == 9 else w for i, w in enumerate(t)])
    texts = [" ".join(t) for t in texts]
    want = brute_groups(dict(enumerate(texts)))
    assert len(set(want.values())) == 20
    assert {r.doc_id: r.keep for r in simhash.near_copies(table(spark, texts)).collect()} == want


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(500, 400)], "a bigint, b bigint")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 500: 400}
    assert simhash.components(edges.limit(0)).count() == 0


def test_near_duplicates_defined_cases(spark):
    docs = table(spark, ODD)
    rows = simhash.near_duplicates(docs.unionAll(docs)).collect()
    assert len(rows) == 2 * len(ODD)
    blank = {r.component_id for r in rows if r.fingerprint == "0" * 16}
    assert blank == {0}
    assert simhash.near_duplicates(table(spark, [])).count() == 0


# ---------------------------------------------------------------- 9 lines


def test_line_dedup_equals_brute_force(spark):
    rnd = random.Random(7)
    texts = ["\n".join([prose(rnd, 6), *(["terms of use "] if i % 3 == 0 else []), "", prose(rnd, 4)]) for i in range(120)]
    texts += [texts[0]] * 60 + [None, "", "terms of use"]
    rows = {r.doc_id: r for r in lines.drop_lines(table(spark, texts)).collect()}
    pages, held = collections.defaultdict(set), collections.defaultdict(set)
    for i, t in enumerate(texts):
        if t is not None:
            pages[i % 2].add(t)
            for x in t.split("\n"):
                if x.strip(" "):
                    held[i % 2, x.strip(" ")].add(t)
    for i, t in enumerate(texts):
        if t is None:
            assert rows[i].text is None and rows[i].n_lines == 0
            continue
        bad = [x for x in t.split("\n") if len(held[i % 2, x.strip(" ")]) >= 5 and len(held[i % 2, x.strip(" ")]) > 0.05 * len(pages[i % 2])]
        kept = [x for x in t.split("\n") if x not in bad]
        assert (rows[i].text, rows[i].n_lines, rows[i].n_dropped) == ("\n".join(kept), t.count("\n") + 1, len(bad))
    assert sum(r.n_dropped for r in rows.values()) >= 40
    assert lines.drop_lines(table(spark, [])).count() == 0
    assert lines.drop_lines(table(spark, ODD)).count() == len(ODD)


# ---------------------------------------------------------------- 10 main text


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{a:b}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<nav><ul><li><a href="/">Home</a></li><li>News</li></ul></nav><div class="cookie-notice">We use cookies on this site, as all sites do nowadays, it seems.</div>
<article><h1>Head &amp; line</h1><p>First  <b>bold</b>
 text&nbsp;here.<p>Short.</p><div class="ad">Buy now</div><table><tr><td>cell</td></tr></table><form><p>Your name</p></form>
<section id="comments"><p>a reader's long comment</p></section></article><aside><p>beside</p></aside><footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert markup.main_text(PAGE) == "Head & line\nFirst bold text here.\nShort.\ncell"
    body = "".join(f"<p>{'many words stand in this paragraph ' * 3}{i}</p>" for i in range(3))
    page = f"<div><a href=x>One</a></div><div><a href=y>Two</a></div><div class=menu><p>m</p></div>{body}<p>End.</p><div class=comments>c</div><div>Imprint</div>"
    want = "\n".join(f"{'many words stand in this paragraph ' * 3}{i}" for i in range(3)) + "\nEnd."
    assert markup.main_text(page) == want
    assert [markup.main_text(x) for x in (None, "", "<p>", "<<<>>>", "<script>x")] == [""] * 5


def test_attributes_are_told_by_their_whole_names():
    tags = ('div style="overflow:hidden"', 'p title="the hidden truth"', 'section data-hidden="false"', 'div data-id="comments"',
            'div data-x="?id=search"', "p title='class=ad'", "div data-class=ad", "p title = 'a' lang=hidden")
    for tag in tags:
        assert markup.main_text(f"<article><p>One.</p><{tag}>Two.</{tag.split()[0]}></article>") == "One.\nTwo.", tag
    assert markup.main_text('<article><p>See <a href="/hidden-gems">the gems</a> and <a href="?id=search">more</a>.</p></article>') == "See the gems and more."
    for tag in ("div hidden", 'div title="a b" HIDDEN=""', 'div class="x"id="comments"', "div role=search", "p aria-hidden='true'", "div class = ad"):
        assert markup.main_text(f"<article><p>One.</p><{tag}>Two.</{tag.split()[0]}></article>") == "One.", tag


WORDS = "many words stand in this paragraph " * 3


def test_names_leave_out_whole_words_only():
    body = f"<h1>Head</h1><p>{WORDS}</p><p>{WORDS}</p><p>End.</p>"
    want = "\n".join(["Head", WORDS.strip(), WORDS.strip(), "End."])
    rest = "<div class='site-footer'>Imprint of us.</div>"
    for tag in ('div id="legal-analysis"', 'div class="related-work"', 'div class="content-search-tips"', 'div class="subscription-economics"',
                'div id="share-price"', 'div class="banner"', "form id=f", 'section class="article-header"'):
        for inner in (body, f"<article>{body}</article>"):
            assert markup.main_text(f"<nav><a href=x>Home</a></nav><{tag}>{inner}</{tag.split()[0]}>{rest}") == want, tag
    for inner, left in (('<h1 class="article-header">A</h1><p>B.</p>', "A\nB."), ('<p class="navy">A.</p><p>B.</p>', "A.\nB."),
                        ('<p>A <span class="navy">b</span> c.</p>', "A b c."), ('<p>A <span class="ad">b</span> c.</p>', "A c."),
                        ("<p>A <button>b</button> c.</p>", "A c."), ("<b><div class=ad>x</b><p>A.</p>", "A.")):
        assert markup.main_text(f"<article>{inner}</article>") == left, inner
    for name in ("comments", "comment-list", "related-posts", "ad-300x250", "cookie-consent-banner", "site-nav", "sidebar__inner", "disqus_thread"):
        beside = f"<section class='{name}'><h2>x</h2><article class=comment><p>{WORDS}</p></article></section>"
        assert markup.main_text(f"<div class=header><h1>Site</h1>Tag</div><div>{body}</div>{beside}") == want, name


def by_hand(text, length, title, gaps, window, surge):
    """Surge and dive line by line, each sum taken anew, for stretches that end in a full stop."""
    total = lambda i, end: sum(length[j] for j in range(i, min(i + window, end)))
    keep, inside, ends = set(), False, [*sorted(gaps), len(text)]
    for i in range(len(text)):
        end = min(e for e in ends if e > i)
        if i in gaps:
            inside = inside and 2 * sum(length[i:end]) >= sum(len(x) for x in text[i:end])
        if inside and total(i, end) == 0:
            inside = False
        elif not inside and 2 * length[i] > len(text[i]) and total(i, end) >= surge:
            inside = True
            start = max([g for g in gaps if g <= i], default=0)
            heads = [j for j in range(max(start, i - window), i) if title[j] and not any(k in keep for k in range(j, i))]
            keep.update(range(min(heads, default=i), i))
        if inside:
            keep.add(i)
    return [text[i] for i in sorted(keep)]


def test_surge_and_dive_by_hand():
    rng = random.Random(5)
    seen = set()
    for _ in range(3000):
        n = rng.randint(1, 14)
        lines = markup.Lines()
        lines.text = [f"{i}" + "x" * rng.choice((1, 8, 30, 90)) + "." for i in range(n)]
        lines.length = [rng.choice((0, 0, len(t) // 3, len(t), len(t))) for t in lines.text]
        lines.title = [rng.random() < 0.2 for _ in range(n)]
        lines.main = [False] * n
        lines.gaps = {i for i in range(n) if rng.random() < 0.15}
        if all(sum(lines.length[i : i + 3]) < 80 for i in range(n)):
            continue
        got = markup.between(lines, lines.length)
        assert got == by_hand(lines.text, lines.length, lines.title, lines.gaps, 3, 80), (lines.text, lines.length, lines.title, lines.gaps)
        seen.add(len(got) - n)
    assert len(seen) > 8


def test_main_text_goes_on_behind_what_is_left_out():
    words = "many words stand in this paragraph " * 3
    ad = "<div><div class=ad>Buy now</div></div>"
    assert markup.main_text(f"<p>{words}</p>{ad}<p>The end.</p>{ad}<div>Imprint</div>") == f"{words.strip()}\nThe end."
    assert markup.main_text(f"<p>{words}</p>{ad}<ul><li>eggs<li>milk<li>salt</ul>") == f"{words.strip()}\neggs\nmilk\nsalt"
    assert markup.main_text(f"<p>{words}</p>{ad}<p>So</p>{ad}<p>{words}</p>") == f"{words.strip()}\nSo\n{words.strip()}"
    assert markup.main_text(f"<p>{words}</p>{ad}<p><a href=x>Other news of the day, read on.</a></p>") == words.strip()
    assert markup.main_text("<div><a href=x>One</a></div><p>A short note.</p>") == "A short note."
    teaser = "<article><a href=x>Teaser</a> of it</article>"
    assert markup.main_text(f"{teaser}<div class=ad>Buy</div><div>{words}</div><div>{words}</div>") == "\n".join([words.strip()] * 2)


def test_main_text_of_the_given_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in markup.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1|div|ul|li)\b[^>]*>", article)
        plain = (" ".join(html.unescape(re.sub(r"</?b>", "", b).replace("<br>", " ")).split()) for b in blocks)
        assert r.text == "\n".join(b for b in plain if b) and r.n_chars == len(r.text)
        lines = markup.lines_of(r.html)
        assert r.text == "\n".join(markup.between(lines, lines.length))  # surge and dive alone, article counting nothing


def test_main_text_defined_cases(spark):
    pages = spark.createDataFrame([(1, "u", None), (None, None, PAGE), (1, "u", "<p>" * 20_000)], "page_id bigint, url string, html string")
    assert [r.n_chars for r in markup.extract(pages).collect()] == [0, len(markup.main_text(PAGE)), 0]
    assert markup.main_text("<p>" * 30_000 + "</div>" * 30_000) == ""
    assert markup.extract(pages.limit(0)).count() == 0
    clash = pages.selectExpr("*", "'x' AS text", "7 AS n_chars", "'y' AS docs")
    assert sorted(map(str, markup.extract(clash).collect())) == sorted(map(str, markup.extract(pages).collect()))
