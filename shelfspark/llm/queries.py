"""The registered queries of this subpackage, one for each operator, and their SQL where there is any."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, html_text, mixing, packing, phrases, quality, rollup, runs, sharding, simhash, topk, toxicity, warc_zip
from .common import SMALL_IDS, WORD, broadcast_if_small, cut, shared_dir, table

SHARDS = 8


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on 8 shards of a ring whose loads are bounded at one row apart."""
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_print("print").alias("fingerprint"), "component_id")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def _rolled_up(spark: SparkSession, counts: DataFrame, labels: DataFrame) -> DataFrame:
    """Totals after the counts (doc_id, source, lang, tokenizer, old_tokens, tokens) of all documents were inserted, then
    revised, the revision twice, and those of documents labelled bad deleted. A null id is labelled nothing; labels of a
    document that isn't there, and repeated ones, delete nothing more."""
    bad = broadcast_if_small(labels.where("quality = 0").select("doc_id").distinct(), SMALL_IDS)
    totals = rollup.TokenRollup(spark, f"{shared_dir(spark).rstrip('/')}/rollup-{uuid.uuid4().hex}")
    change = lambda kind, tokens, old: (F.lit(kind).alias("kind"), *rollup.KEYS, tokens.alias("tokens"), old.alias("old_tokens"))
    new, old, nothing = F.col("tokens"), F.col("old_tokens"), F.lit(None).cast("long")
    totals.commit("insert-1", counts.select(*change("insert", old, nothing)))
    for _ in range(2):
        totals.commit("revise-1", counts.select(*change("revise", new, old)))
    totals.commit("delete-1", counts.join(bad, "doc_id", "left_semi").select(*change("delete", new, nothing)))
    return totals.totals()


def _tidy() -> Column:
    """The text with single spaces between its words."""
    return F.concat_ws(" ", F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)))


def op5_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, bytes and tokens of the vocabulary of all documents are inserted; texts are then revised to single spaces
    between words; documents labelled bad are deleted. Texts are read once, for all their counts."""
    counts = cut(rollup.counted_twice(table(spark, sf_dir, "documents"), _tidy()))
    return _rolled_up(spark, counts, table(spark, sf_dir, "labels"))


def op5b_rollup_without_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the versions that SQL can count."""
    docs = table(spark, sf_dir, "documents")
    pairs = F.array(*[F.struct(F.lit(name).alias("tokenizer"), count(F.col("text")).alias("old_tokens"), count(F.col("tidy")).alias("tokens")) for name, count in rollup.COUNTERS.items()])
    counts = docs.withColumn("tidy", _tidy()).select("doc_id", "source", "lang", F.explode(pairs).alias("t")).select("doc_id", "source", "lang", "t.*")
    return _rolled_up(spark, cut(counts), table(spark, sf_dir, "labels"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_documents(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "copies")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_exact_duplicates(table(spark, sf_dir, "documents"))


def op9_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc_zip.archive_round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases of each language whose words stand together most beyond chance."""
    return phrases.best_of_each(phrases.collocations(table(spark, sf_dir, "documents")))


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents. In those whose h = crc32(doc_id) is divisible by 10, the words from a on repeat the p words
    there (a and p are made of h), as the contract has it."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, words, n = F.floor(h / 10), F.col("words"), F.size("words")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))).alias("words"))
    docs = docs.withColumn("a", F.when(n > 0, (g % n).cast("int"))).withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int"))
    repeated = F.transform(words, lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get(words, F.col("a") + (i - F.col("a")) % F.col("p"))))
    planted = F.when(F.col("p").isNotNull(), F.concat_ws(" ", repeated)).otherwise(F.col("text"))
    return runs.digests(runs.find_runs(docs.select("doc_id", planted.alias("text"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sharding, op2_simhash, op3_packing, op4_topk, op5_token_rollup, op5b_rollup_without_vocabulary, op6_mixing, op7_quality, op8_exact_dedup, op9_warc_zip, op10_toxicity, op11_phrases, op12_html_text, op13_runs)
}

WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

ORACLE_SQL: dict[str, str] = {
    "op4_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
""",
    "op5b_rollup_without_vocabulary": r"""
WITH d AS (
  SELECT source, lang, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
  WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0 AND doc_id IS NOT NULL)),
t AS (
  SELECT source, lang, 'words-1' AS tokenizer, len(w) AS tokens FROM d
  UNION ALL SELECT source, lang, 'bytes-1', strlen(array_to_string(w, ' ')) FROM d)
SELECT source, lang, tokenizer, count(*) AS documents, CAST(sum(tokens) AS BIGINT) AS tokens FROM t GROUP BY ALL
""",
    "op6_mixing": f"""
WITH d AS (SELECT doc_id, source, CAST({WORDS} AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (
  SELECT *, row_number() OVER o AS nth,
    ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
      / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
v AS (SELECT level FROM l WHERE level * weight <= cap ORDER BY nth LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN v.level IS NULL THEN cap ELSE least(v.level * weight, cap) END AS target FROM l LEFT JOIN v ON true),
r AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CAST(floor(rate) AS BIGINT) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS copies FROM r)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM c
""",
    "op8_exact_dedup": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
""",
    "op11_phrases": r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_extract_all(t, '[^.,;:!?\x0A-\x0D]+')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, w, i, unnest(range(1, least(5, len(w) - i + 1) + 1)) AS m FROM i),
f AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS HUGEINT) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 100),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
s AS (
  SELECT k.lang, k.phrase, k.a, x.f AS l, y.f AS r, n.n, k.k, 1000 * k.a * n.n // (x.f * y.f) AS score
  FROM k JOIN f x ON x.lang = k.lang AND x.m = k.k AND x.phrase = array_to_string(k.w[1:k.k], ' ')
  JOIN f y ON y.lang = k.lang AND y.m = k.m - k.k AND y.phrase = array_to_string(k.w[k.k + 1:k.m], ' ')
  JOIN n ON n.lang = k.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
q AS (SELECT lang, w, a, m, unnest(range(2, m)) AS size FROM c),
z AS (SELECT lang, a, array_to_string(w[pos:pos + size - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, m - size + 2)) AS pos FROM q))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
  CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM b WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.lang = b.lang AND z.phrase = b.phrase AND 100 * z.a >= 100 * b.a)
QUALIFY rank <= 2000
""",
}
