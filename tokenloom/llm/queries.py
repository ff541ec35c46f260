"""The registered queries of this subpackage: whole tables, production parameters, whole results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.cluster import ship
from tokenloom.llm import merkle, toxicity, transcripts, warc
from tokenloom.llm.decontaminate import contaminated
from tokenloom.llm.line_dedup import without_common_lines
from tokenloom.llm.media import media_column, probe_column
from tokenloom.llm.near_dedup import near_duplicates
from tokenloom.llm.packing import pack
from tokenloom.llm.passages import repeats
from tokenloom.llm.prefix_trie import prefix_nodes, sequences
from tokenloom.llm.scratch import Scratch
from tokenloom.llm.token_counts import token_counts
from tokenloom.llm.token_files import read_token_files, write_token_files


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document, by a model of the labels outside the held-out third."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), where=~held_out)
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 ids; columns as in ``packing.pack``."""
    return pack(table(spark, sf_dir, "documents"), capacity=4096, end=1)


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets have a similarity of 0.85 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, ratio=(85, 100))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as read back from archives: written as one gzip stream each, normalised, read by index."""
    uri, files = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_records(uri, warc.normalise(uri, files))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items whose words they hold at least half of."""
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", F.size("tiles").alias("n_tiles"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it has more than 2048."""
    return token_counts(table(spark, sf_dir, "documents"), limit=2048)


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as read back from the token files written of them."""
    return read_token_files(*write_token_files(table(spark, sf_dir, "documents"), end=2))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes in a media container, and what its tables say of it."""
    probed = probe_column(media_column(table(spark, sf_dir, "documents")))
    first, last = F.element_at("keyframes", 1), F.element_at("keyframes", -1)
    feature = F.format_string("%s %d ms, %d keyframes from %d to %d", F.trim("codec"), "duration_ms", F.size("keyframes"), first["offset"], last["offset"] + last["bytes"])
    return probed.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every paragraph and passage that occurs in several places, and whether it is removed there."""
    return repeats(table(spark, sf_dir, "documents"))


def op10_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns recovered from the conversations' raw transcripts, in which roles are told by markers at most."""
    raw = transcripts.raw_transcripts(table(spark, sf_dir, "conversations"))
    return transcripts.parse(raw.drop("role"), transcripts.fit(raw))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, and whether each row, some of them tampered with, still leads to the root."""
    docs = table(spark, sf_dir, "documents")
    c = {name: F.col(name) for name in ("doc_id", "source", "lang", "n_chars", "text")}
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    seen = merkle.leaf(*[F.replace(c[n], F.lit("\n"), F.lit("")) if n == "text" else c[n] for n in c])
    leaves = docs.select("doc_id", "source", merkle.leaf(*c.values()).alias("leaf"), F.when(tampered, seen).alias("seen"))
    rows = merkle.manifest(leaves, "source", ["doc_id"], arity=3)
    hexes = [merkle.hexed(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")]
    own = merkle.hexed(F.coalesce("seen", "leaf"))
    rows = rows.select("doc_id", *hexes, F.sha2(merkle.proof(F.col("path")), 256).alias("proof_sha256"), merkle.folded(own, F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def rebuilt(rows: DataFrame, family: int = 100, most: int = 5) -> DataFrame:
    """``sequences`` in which each conversation begins with the first h turns of the least conv_id of its hundred, h being crc32 of its id modulo ``most`` + 1."""
    own = Scratch(rows.sparkSession, "rebuilt").save(rows, "own")
    heads = own.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), *[F.slice(c, 1, most).alias(f"head_{c}") for c in ("keys", "chars")])
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    met = own.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % family}).join(heads, "base", "left")
    whole = [F.concat(F.coalesce(F.slice(f"head_{c}", F.lit(1), F.col("h")), F.slice(c, 1, 0)), F.slice(c, F.col("h") + 1, F.size(c))).alias(c) for c in ("keys", "chars")]
    return met.select("conv_id", *whole)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the conversations as rebuilt from shared beginnings."""
    return prefix_nodes(rebuilt(sequences(table(spark, sf_dir, "conversations"))))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the lines that ten documents or more hold."""
    left = without_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), at_least=10, least_chars=1)
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_packing": op2_packing,
    "op3_minhash": op3_minhash,
    "op4_warc": op4_warc,
    "op5_decontamination": op5_decontamination,
    "op6_token_counts": op6_token_counts,
    "op7_token_files": op7_token_files,
    "op8_media": op8_media,
    "op9_repeats": op9_repeats,
    "op10_transcripts": op10_transcripts,
    "op11_merkle": op11_merkle,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_line_dedup": op13_line_dedup,
}

#: DuckDB SQL, brute force; the others are tested against the tokenizer library and exact round trips.
SQL: dict[str, str] = {
    "op3_minhash": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM words
), sizes AS (SELECT doc_id, len(s) AS n FROM sets),
each AS (SELECT doc_id, unnest(s) AS shingle FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
  FROM each a JOIN each b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sizes
  UNION
  SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a
)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, r.component_id, s.doc_id = r.component_id AS kept
FROM sizes s JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) r USING (doc_id)
""",
    "op4_warc": """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (SELECT payload_digest, min(page_id) AS owner FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN owner <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN owner <> page_id THEN owner END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100
""",
    "op11_merkle": r"""
WITH RECURSIVE fields AS (
  SELECT doc_id, source,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT))),
             lambda a, y: list_reduce(list_prepend(xor(a, y), CAST(range(8) AS BIGINT[])), lambda b, z: xor(b >> 1, CASE WHEN b & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) AS crc,
         list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)], lambda x: CASE WHEN x IS NULL THEN '-' ELSE strlen(x) || ':' || x END) AS f,
         text, replace(text, chr(10), '') AS tampered
  FROM documents
), leaves AS (
  SELECT doc_id, source, crc, sha256(array_to_string(f, '') || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
         sha256(array_to_string(f, '') || CASE WHEN text IS NULL THEN '-' ELSE strlen(tampered) || ':' || tampered END) AS seen
  FROM fields
), placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM leaves
), tree AS (
  SELECT 0 AS t, g, i, n, leaf AS d FROM placed
  UNION ALL
  SELECT t + 1, g, i // 3, max((n + 2) // 3), sha256(string_agg(d, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY t, g, i // 3
), subroots AS (SELECT g, d FROM tree WHERE n = 1),
runs AS (SELECT t, g, i // 3 AS p, list(d ORDER BY i) AS ds FROM tree WHERE n > 1 GROUP BY ALL),
top AS (
  SELECT 0 AS t, g AS i, (SELECT count(*) FROM subroots) AS n, d FROM subroots
  UNION ALL
  SELECT t + 1, i // 3, max((n + 2) // 3), sha256(string_agg(d, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY t, i // 3
), upper_runs AS (SELECT t, i // 3 AS p, list(d ORDER BY i) AS ds FROM top WHERE n > 1 GROUP BY ALL),
low AS (
  SELECT doc_id, 0 AS t, g, i, CASE WHEN crc % 2 = 0 THEN seen ELSE leaf END AS d, '' AS proof, n = 1 AS ended, n FROM placed
  UNION ALL
  SELECT doc_id, t + 1, g, i // 3, sha256(array_to_string(ds[1:i % 3], '') || d || array_to_string(ds[i % 3 + 2:], '')),
         proof || array_to_string(ds[1:i % 3], '') || array_to_string(ds[i % 3 + 2:], ''), n <= 3, (n + 2) // 3
  FROM low JOIN runs r USING (t, g) WHERE NOT ended AND r.p = i // 3
), high AS (
  SELECT doc_id, 0 AS t, g AS i, d, proof, (SELECT count(*) FROM subroots) AS n FROM low WHERE ended
  UNION ALL
  SELECT doc_id, t + 1, i // 3, sha256(array_to_string(ds[1:i % 3], '') || d || array_to_string(ds[i % 3 + 2:], '')),
         proof || array_to_string(ds[1:i % 3], '') || array_to_string(ds[i % 3 + 2:], ''), (n + 2) // 3
  FROM high JOIN upper_runs r USING (t) WHERE n > 1 AND r.p = i // 3
), root AS (SELECT d AS root FROM top WHERE n = 1)
SELECT p.doc_id, p.leaf, s.d AS subroot, root, sha256(h.proof) AS proof_sha256, h.d AS folded_root, h.d = root AS verified
FROM placed p JOIN subroots s ON s.g = p.g JOIN high h ON h.doc_id = p.doc_id AND h.n = 1 CROSS JOIN root
""",
    "op12_prefix_trie": r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos FROM conversations
), c AS (
  SELECT conv_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(s) + 1), lambda i: CAST(ascii(s[i]) AS BIGINT))),
         lambda a, y: list_reduce(list_prepend(xor(a, y), CAST(range(8) AS BIGINT[])), lambda b, z: xor(b >> 1, CASE WHEN b & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM conversations)
), r AS (
  SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND pos <= h
  UNION ALL SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h
), s AS (
  SELECT conv_id, 0 AS depth, '' AS path, 0 AS chars FROM c
  UNION ALL
  SELECT conv_id, row_number() OVER w, string_agg(sha256(strlen(role) || ':' || role || text), '') OVER w, length(text) FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
), node AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n, any_value(chars) AS chars FROM s GROUP BY path, depth),
ends AS (SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM (SELECT conv_id, arg_max(path, depth) AS path FROM s GROUP BY 1) GROUP BY 1),
kids AS (SELECT substr(path, 1, 64 * (depth - 1)) AS path, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1),
below AS (
  SELECT substr(path, 1, 64 * k) AS path, sum(CASE WHEN leaf THEN 1 ELSE 0 END) AS leaves, sum(saved) AS saved
  FROM (SELECT node.path, (node.n - 1) * chars AS saved, kids.n IS NULL AS leaf, unnest(range(depth + 1)) AS k FROM node LEFT JOIN kids ON kids.path = node.path) GROUP BY 1
)
SELECT node.conv_id, CAST(node.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, node.n AS n_convs, coalesce(kids.n, 0) AS n_children,
       CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(ends, sha256('')) AS ends_sha256
FROM node JOIN below ON below.path = node.path LEFT JOIN kids ON kids.path = node.path LEFT JOIN ends ON ends.path = node.path
LEFT JOIN node p ON node.depth > 0 AND p.path = substr(node.path, 1, 64 * (node.depth - 1))
""",
    "op13_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS place, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), common AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY 1 HAVING count(DISTINCT doc_id) + count(*) FILTER (doc_id IS NULL) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (c.key IS NOT NULL) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (c.key IS NULL), '')) AS kept_sha256
FROM keyed k LEFT JOIN common c ON c.key = k.key GROUP BY doc_id
""",
}
