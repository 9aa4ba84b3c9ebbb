"""The queries of the text operators and, where SQL can say it, their oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from . import descent, kneser, lines, markup, merkle, nearest, pieces, sharding, simhash, spheres, suffixes, tiling, toxicity
from .common import read

#: The place of the tokenizer's file; a parameter of the operator.
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return tiling.contaminated(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op2_kneser_ney(spark: SparkSession, folder: str) -> DataFrame:
    return kneser.score_documents(read(spark, folder, "documents"))


def op3_repeated_bytes(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.remove_repeats(read(spark, folder, "documents"))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score_documents(read(spark, folder, "documents"), read(spark, folder, "labels"))


def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(read(spark, folder, "documents"))


def op6_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.nearest(read(spark, folder, "embeddings"))


def op7_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode_documents(read(spark, folder, "documents"), PIECES)


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, folder, "documents"))


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = lines.drop_lines(read(spark, folder, "documents"))
    return out.select("doc_id", "source", "n_lines", "n_dropped", "text")


def op10_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return markup.extract(read(spark, folder, "pages"))


def op11_nn_descent(spark: SparkSession, folder: str) -> DataFrame:
    return descent.near_duplicates(read(spark, folder, "embeddings"))


def op12_drift_bounds(spark: SparkSession, folder: str) -> DataFrame:
    out = spheres.cluster(read(spark, folder, "embeddings"))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_merkle(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.manifest(read(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_kneser_ney": op2_kneser_ney,
    "op3_repeated_bytes": op3_repeated_bytes,
    "op4_toxicity": op4_toxicity,
    "op5_sharding": op5_sharding,
    "op6_nearest": op6_nearest,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_simhash": op8_simhash,
    "op9_line_dedup": op9_line_dedup,
    "op10_main_text": op10_main_text,
    "op11_nn_descent": op11_nn_descent,
    "op12_drift_bounds": op12_drift_bounds,
    "op13_merkle": op13_merkle,
}

#: The table of CRC-32 by its rule.
CRC_TABLE = """
WITH RECURSIVE steps(i, k, v) AS (SELECT i, 0, i FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END FROM steps WHERE k < 8),
codes AS (SELECT list(v ORDER BY i) AS t FROM steps WHERE k = 8)"""


def crc(listed: str) -> str:
    """CRC-32 of a list of bytes, one step for each; ``t`` is the table."""
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {listed}), lambda r, b: xor(t[1 + (xor(r, b) & 255)], r >> 8)))"


def listed(hexed: str) -> str:
    return f"list_transform(range(0, len({hexed}), 2), lambda j: CAST('0x' || substr({hexed}, j + 1, 2) AS BIGINT))"


#: CRC-32 of the texts.
CRC = f"""{CRC_TABLE},
hexed AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
listed AS (SELECT doc_id, len(h) // 2 + 1 AS size, {listed("h")} AS bytes FROM hexed),
summed AS (SELECT doc_id, size, {crc("bytes")} AS text_crc32 FROM listed, codes)"""

#: All pairs; the components by their reach.
LINKS = f"""
WITH RECURSIVE given AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
unit AS (SELECT r, vec_id, x, sqrt(list_inner_product(x, x)) AS size FROM given
  WHERE len(x) = 64 AND len(list_filter(x, lambda v: isfinite(v))) = 64 AND list_max(list_transform(x, lambda v: abs(v))) > 0),
links AS MATERIALIZED (SELECT a.r AS u, b.r AS v FROM unit a JOIN unit b ON a.r <> b.r AND list_inner_product(a.x, b.x) / (a.size * b.size) >= {descent.LINK}),
reach(u, v) AS (SELECT r, r FROM given UNION SELECT reach.u, links.v FROM reach JOIN links ON links.u = reach.v),
least AS (SELECT reach.u AS r, min(g.vec_id) AS component_id FROM reach JOIN given g ON g.r = reach.v GROUP BY 1)
SELECT g.vec_id, (SELECT count(*) FROM links WHERE u = g.r) AS n_links, component_id, coalesce(g.vec_id = component_id, false) AS kept
FROM given g JOIN least USING (r)"""


def clusters_sql() -> str:
    """Plain k-means over whole numbers: a pair of tables for each round."""
    def assign(n: int) -> str:
        return f"""a{n} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(q) AS q, min(struct_pack(d, c)) AS best FROM (
  SELECT r, vec_id, q, c, CAST(list_sum(list_transform(list_zip(q, p), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM kept, c{n}) GROUP BY r)"""

    def move(n: int) -> str:
        return f"""c{n + 1} AS MATERIALIZED (SELECT c, coalesce(m.p, c{n}.p) AS p FROM c{n} LEFT JOIN (
  SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS p FROM (
    SELECT c, i, sum(v) AS s, count(*) AS n FROM (SELECT best.c AS c, unnest(q) AS v, generate_subscripts(q, 1) AS i FROM a{n}) GROUP BY c, i) GROUP BY c) m USING (c))"""

    rounds = ",\n".join(f"{assign(n)},\n{move(n)}" for n in range(spheres.ROUNDS))
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda v: CAST(floor({spheres.SCALE} * CAST(v AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE len(embedding) = {spheres.DIMENSIONS} AND len(list_filter(embedding, lambda v: isfinite(v))) = {spheres.DIMENSIONS}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), q) - 1 AS c, q AS p FROM kept WHERE vec_id IS NOT NULL QUALIFY c < {spheres.CLUSTERS}),
{rounds},
{assign(spheres.ROUNDS)}
SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(p, ',')) AS centroid_sha256
FROM a{spheres.ROUNDS} JOIN c{spheres.ROUNDS} ON c = best.c"""


def merkle_sql(deep: int = 24) -> str:
    """Trees of up to 2**deep leaves as lists, a column for each level."""
    def up(name: str) -> str:
        return f"CASE WHEN len({name}) > 1 THEN list_transform(range((len({name}) + 1) // 2), lambda k: sha256({name}[2 * k + 1] || coalesce({name}[2 * k + 2], ''))) ELSE {name} END"

    def climb(table: str, letter: str) -> str:
        return ",\n".join(f"{table}{n + 1} AS (SELECT *, {up(f'{letter}{n}')} AS {letter}{n + 1} FROM {table}{n})" for n in range(deep))

    def walk(first: str, letter: str, place: str, step: str) -> str:
        """Siblings and the folded node, level by level."""
        out = []
        for n in range(deep):
            other = f"CASE WHEN len({letter}{n}) > 1 THEN coalesce({letter}{n}[xor({place} >> {n}, 1) + 1], '') ELSE '' END"
            out.append(f"{step}{n + 1} AS (SELECT * REPLACE (way || s AS way, CASE WHEN len({letter}{n}) < 2 THEN node WHEN ({place} >> {n}) % 2 = 0 THEN sha256(node || s) "
                       f"ELSE sha256(s || node) END AS node) FROM (SELECT * EXCLUDE (s), {other} AS s FROM {first if n == 0 else f'{step}{n}'}))")
        return ",\n".join(out)

    field = "coalesce(octet_length(encode(CAST({0} AS VARCHAR))) || ':' || CAST({0} AS VARCHAR), '-')"
    whole = lambda n_chars: "sha256(" + " || ".join(field.format(f) for f in ("doc_id", "source", "lang", n_chars, "text")) + ")"
    return f"""{CRC_TABLE},
coded AS (SELECT *, {listed("hex(encode(CAST(doc_id AS VARCHAR)))")} AS bytes FROM documents),
hashed AS (SELECT doc_id, lang, {whole("n_chars")} AS leaf, CASE WHEN n_chars IS NOT NULL AND {crc("bytes")} % 7 = 0 THEN {whole("(n_chars + 1)")} ELSE {whole("n_chars")} END AS other FROM coded, codes),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM hashed),
l0 AS (SELECT lang, list(leaf ORDER BY i) AS t0 FROM placed GROUP BY lang),
{climb("l", "t")},
trees AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS j, t{deep}[1] AS subroot FROM l{deep}),
r0 AS (SELECT list(subroot ORDER BY j) AS b0 FROM trees),
{climb("r", "b")},
top AS MATERIALIZED (SELECT *, b{deep}[1] AS root FROM r{deep}),
w0 AS (SELECT placed.doc_id, placed.leaf, placed.i, placed.other AS node, '' AS way, '' AS s, trees.* EXCLUDE (lang) FROM placed JOIN trees ON placed.lang IS NOT DISTINCT FROM trees.lang),
{walk("w0", "t", "i", "w")},
v0 AS (SELECT w.doc_id, w.leaf, w.j, w.node, w.way, w.s, w.subroot, top.* FROM w{deep} w, top),
{walk("v0", "b", "j", "v")}
SELECT doc_id, leaf, subroot, root, sha256(way) AS proof_sha256, node AS folded_root, node = root AS verified FROM v{deep}"""


ORACLES: dict[str, str] = {
    "op5_sharding": f"""{CRC},
placed AS (SELECT *, sum(size) OVER o AS upto, row_number() OVER o AS place, sum(size) OVER () AS total FROM summed
  WINDOW o AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
cut AS (SELECT *, CAST((2 * upto - size) * 8 // (2 * total) AS INTEGER) AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM cut""",
    "op9_line_dedup": f"""
WITH pages AS (SELECT coalesce(source, '') AS site, md5(text) AS page, text FROM documents WHERE text IS NOT NULL),
totals AS (SELECT site, count(DISTINCT page) AS n FROM pages GROUP BY site),
held AS (SELECT DISTINCT site, page, trim(u.x, ' ') AS line FROM pages, unnest(string_split(text, chr(10))) AS u(x) WHERE trim(u.x, ' ') <> ''),
bad AS (SELECT site, list(line) AS drop FROM (
  SELECT site, line FROM held JOIN totals USING (site) GROUP BY site, line, n HAVING count(*) >= {lines.MIN_PAGES} AND count(*) > {lines.RATIO} * n) GROUP BY site),
cut AS (SELECT d.doc_id, d.source, string_split(d.text, chr(10)) AS s,
  list_filter(string_split(d.text, chr(10)), lambda x: NOT list_contains(coalesce(b.drop, []), trim(x, ' '))) AS kept
  FROM documents d LEFT JOIN bad b ON b.site = coalesce(d.source, ''))
SELECT doc_id, source, CAST(coalesce(len(s), 0) AS INTEGER) AS n_lines, CAST(coalesce(len(s) - len(kept), 0) AS INTEGER) AS n_dropped,
  array_to_string(kept, chr(10)) AS text FROM cut""",
    "op11_nn_descent": LINKS,
    "op12_drift_bounds": clusters_sql(),
    "op13_merkle": merkle_sql(),
}
