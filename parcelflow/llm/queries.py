"""One registered query for each operator, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.llm import bpe, exact_dedup, html_extract, lempel_ziv, merkle, mixing, phrases, quality, records, sharding, simhash, toxicity, urls
from parcelflow.llm.common import fold_of, table

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"
THRESHOLD = 0.3
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def _judged(scores: DataFrame, held_out) -> DataFrame:
    return scores.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold_of(F.col("doc_id"), 5) == 0
    return _judged(quality.scores(docs, quality.fit(docs, labels, ~held_out)), held_out)


def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = records.write(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))
    return records_digest(records.read(spark, out))


def records_digest(read: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            ids = b.column("ids").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return read.select("doc_id", "start", "ids").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def op3_lempel_ziv_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lempel_ziv.compare_with_next(table(spark, sf_dir, "documents"))
    text = {"edited_sha256": "edited_sha256", "fp": "fingerprint", "edited_fp": "edited_fingerprint"}
    return got.select("doc_id", "n_chars", *[F.lower(F.hex(k)).alias(v) for k, v in text.items()], "near_edited", "near_next")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = exact_dedup.assign(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP4_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS original, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), r AS (
  SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
    first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place
  FROM t WINDOW w AS (PARTITION BY text_sha256 ORDER BY length(original) DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r
"""


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.groups(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages"), rules)


OP6_SQL = r"""
WITH u AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*(/[^?#]*)', 1) AS path
  FROM pages
), j AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/'
  END AS rule FROM u
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.org/es/', 'example.org/en/1', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM j
"""


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = mixing.mix(table(spark, sf_dir, "documents"))
    return documents.select("doc_id", "size", "source_size", "target", "taken")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), ids=False)
    return got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = html_extract.main_text(table(spark, sf_dir, "pages"))
    return got.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op10_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = fold_of(F.col("doc_id"), 4) == 2
    return _judged(toxicity.scores(docs, toxicity.fit(docs, labels, ~held_out)), held_out)


def op11_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sharding.assign(table(spark, sf_dir, "documents"), 16)
    return got.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _op11_sql(shards: int = 16, rounds: int = 6) -> str:
    """The Feistel network as nested selects of 128-bit unsigned numbers; numbers that fall outside walk on in the recursion. CRC-32 by its table of 256 values."""
    two64 = "18446744073709551616::UHUGEINT"
    multiplied = [(30, int(sharding.M1)), (27, int(sharding.M2))]
    step = "SELECT id, n, bits, low, v // low AS a, v % low AS b FROM (SELECT *, CASE WHEN start THEN x - n ELSE x END AS v FROM walk WHERE x >= n)"
    for r in range(rounds):
        step = f"SELECT id, n, bits, low, a, b, ({'a' if r % 2 else 'b'} + {r}) % {two64} AS m FROM ({step})"
        for shift, by in multiplied:
            step = f"SELECT id, n, bits, low, a, b, xor(m, m // {1 << shift}::UHUGEINT) * {by}::UHUGEINT % {two64} AS m FROM ({step})"
        step = f"SELECT id, n, bits, low, {'a' if r % 2 else f'xor(a, xor(m, m // {1 << 31}::UHUGEINT) % (bits // low)) AS a'}, {f'xor(b, xor(m, m // {1 << 31}::UHUGEINT) % low) AS b' if r % 2 else 'b'} FROM ({step})"
    return rf"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t
), d AS (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS LAST) - 1 AS id, count(*) OVER () AS n, strlen(coalesce(text, '')) + 1 AS size,
    xor(4294967295, list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST(concat('0x', x) AS BIGINT))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS text_crc32
  FROM documents, crc
), walk AS (
  SELECT id, CAST(n AS UHUGEINT) AS n, CAST(pow(2, length(bin(n - 1))) AS UHUGEINT) AS bits, CAST(pow(2, length(bin(n - 1)) // 2) AS UHUGEINT) AS low, CAST(id + n AS UHUGEINT) AS x, true AS start FROM d
  UNION ALL
  SELECT id, n, bits, low, a * low + b, false FROM ({step})
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(x % {shards} AS INTEGER) AS shard, CAST(x // {shards} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM d JOIN walk USING (id) WHERE walk.x < walk.n
"""


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS piece FROM documents
), words AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda w: w <> '') AS w FROM pieces
), grams AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM words, (VALUES (1), (2), (3), (4)) v(k)
), f AS MATERIALIZED (
  SELECT lang, k, phrase, count(*) AS c FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, CAST(sum(c) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), candidates AS MATERIALIZED (
  SELECT lang, k, phrase, c AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND c >= 30
), cuts AS (
  SELECT d.lang, d.phrase, d.a, x.c AS l, y.c AS r, cut, CAST(2000000 * CAST(d.a AS HUGEINT) // (CAST(x.c AS HUGEINT) + y.c) AS BIGINT) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) d
  JOIN f x ON x.lang = d.lang AND x.phrase = array_to_string(w[1:cut], ' ') JOIN f y ON y.lang = d.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')
), low AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inside AS (
  SELECT DISTINCT lang, array_to_string(w[i:j], ' ') AS phrase, a FROM (SELECT *, unnest(range(1, k)) AS i FROM candidates), (SELECT unnest(range(2, 5)) AS j) WHERE j > i AND j <= k AND j - i + 1 < k
  UNION SELECT lang, array_to_string(w[k - j:], ' '), a FROM candidates, (SELECT unnest(range(1, 3)) AS j) WHERE j + 1 < k
), kept AS (
  SELECT * FROM low c WHERE NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * CAST(i.a AS HUGEINT) >= 80 * CAST(c.a AS HUGEINT))
)
SELECT * FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN totals USING (lang)
) WHERE rank <= 2000
"""


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(table(spark, sf_dir, "documents"), fold_of(F.col("doc_id"), 2) == 0)


#: CRC-32 by its table of 256 values; nodes level by level, the tree of subroots as tree -1; then every leaf is folded up to the root.
OP13_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t
), d AS (
  SELECT row_number() OVER () AS id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, doc_id,
    concat(CASE WHEN doc_id IS NULL THEN '-' ELSE concat(length(CAST(doc_id AS VARCHAR)), ':', doc_id) END, CASE WHEN source IS NULL THEN '-' ELSE concat(strlen(source), ':', source) END,
      CASE WHEN lang IS NULL THEN '-' ELSE concat(strlen(lang), ':', lang) END, CASE WHEN n_chars IS NULL THEN '-' ELSE concat(length(CAST(n_chars AS VARCHAR)), ':', n_chars) END) AS head, text,
    xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 2 = 0 AS changed
  FROM documents, crc
), l AS (
  SELECT id, tree, doc_id, sha256(concat(head, CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(text), ':', text) END)) AS leaf,
    CASE WHEN changed THEN sha256(concat(head, CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(replace(text, chr(10), '')), ':', replace(text, chr(10), '')) END)) END AS tampered FROM d
), p AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS LAST, leaf) - 1 AS pos FROM l
), below AS (
  SELECT tree, 0 AS level, pos, leaf AS digest, count(*) OVER (PARTITION BY tree) AS width FROM p
  UNION ALL
  SELECT tree, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(width) + 2) // 3 FROM below WHERE width > 1 GROUP BY tree, level, pos // 3
), above AS (
  SELECT -1 AS tree, 0 AS level, tree AS pos, digest, count(*) OVER () AS width FROM below WHERE width = 1
  UNION ALL
  SELECT tree, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(width) + 2) // 3 FROM above WHERE width > 1 GROUP BY tree, level, pos // 3
), around AS (
  SELECT tree, level, pos, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS behind
  FROM (SELECT * FROM below UNION ALL SELECT * FROM above) WHERE width > 1 WINDOW w AS (PARTITION BY tree, level, pos // 3 ORDER BY pos)
), lower AS (
  SELECT id, tree, 0 AS level, pos, coalesce(tampered, leaf) AS now, '' AS proof FROM p
  UNION ALL
  SELECT f.id, f.tree, f.level + 1, f.pos // 3, sha256(concat(before, now, behind)), concat(proof, before, behind) FROM lower f JOIN around a ON a.tree = f.tree AND a.level = f.level AND a.pos = f.pos
), upper AS (
  SELECT id, 0 AS level, tree AS pos, now, proof FROM (SELECT * FROM lower QUALIFY row_number() OVER (PARTITION BY id ORDER BY level DESC) = 1)
  UNION ALL
  SELECT f.id, f.level + 1, f.pos // 3, sha256(concat(before, now, behind)), concat(proof, before, behind) FROM upper f JOIN around a ON a.tree = -1 AND a.level = f.level AND a.pos = f.pos
), folded AS (
  SELECT id, now, proof FROM upper QUALIFY row_number() OVER (PARTITION BY id ORDER BY level DESC) = 1
)
SELECT doc_id, leaf, s.digest AS subroot, r.digest AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = r.digest AS verified
FROM p JOIN folded f ON f.id = p.id JOIN below s ON s.tree = p.tree AND s.width = 1, (SELECT digest FROM above WHERE width = 1) r
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = [op1_quality_rules, op2_token_records, op3_lempel_ziv_fingerprint, op4_exact_dedup, op5_simhash_near_dedup, op6_url_filter, op7_mix_sources, op8_byte_bpe, op9_html_main_text, op10_toxicity_lexicon, op11_feistel_shards, op12_phrase_mining, op13_merkle_manifest]
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": OP4_SQL, "op6_url_filter": OP6_SQL, "op11_feistel_shards": _op11_sql(), "op12_phrase_mining": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
