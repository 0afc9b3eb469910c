import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfspark.llm import simhash
from shelfspark.llm.components import components
from shelfspark.llm.queries import op2_simhash
from tests.oracle import SMALL


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Smallest place of each place's component."""
    label = list(range(len(prints)))
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    changed = True
    while changed:
        changed = False
        for i in range(len(prints)):
            low = min(label[j] for j in np.flatnonzero(near[i]))
            if low < label[i]:
                label[i], changed = low, True
    return label


def joined(n, pairs):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def cloud(rng, n, clusters, flips):
    """Fingerprints around some middles, and loose ones."""
    middles = rng.integers(0, 1 << 63, clusters, dtype=np.uint64)
    out = []
    for i in range(n):
        p = int(middles[i % clusters])
        for b in rng.integers(0, 64, rng.integers(0, flips + 1)):
            p ^= 1 << int(b)
        out.append(p)
    return np.unique(np.array(out, np.uint64))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abAB \n\x0bé東", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_every_word_is_near_one_code_word():
    words = np.random.default_rng(1).integers(0, 1 << 23, 20_000)
    index = simhash.decode(words)
    _, errors = simhash.golay()
    assert index.min() >= 0 and index.max() < 4096 and (errors >= 0).all()
    own = {i: w for i, w in zip(simhash.decode(np.arange(1 << 23)[:: 1 << 11]), range(0, 1 << 23, 1 << 11))}
    assert len(own) <= 4096 and max(bin(int(e)).count("1") for e in errors) == 3


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4))
def test_four_bits_share_a_key(value, flips):
    other = value
    for b in flips:
        other ^= 1 << b
    rows, keys = simhash.fuzzy_keys(np.array([value, other], np.uint64))
    assert set(keys[rows == 0]) & set(keys[rows == 1])
    assert len(set(keys[rows == 0])) == (rows == 0).sum()


@pytest.mark.parametrize("n, clusters, flips", [(40, 5, 4), (400, 3, 3), (600, 200, 5), (500, 2, 8), (900, 30, 6), (3, 1, 2)])
def test_forest_joins_what_links_join(n, clusters, flips):
    prints = cloud(np.random.default_rng(n), n, clusters, flips)
    assert joined(len(prints), simhash.forest(prints)) == brute_components(prints)
    assert all(np.bitwise_count(prints[a] ^ prints[b]) <= 4 for a, b in simhash.forest(prints))


@pytest.mark.parametrize("piece", [20, simhash.PIECE])
def test_links_of_large_keys_are_whole(spark, piece):
    prints = cloud(np.random.default_rng(5), 800, 12, 5)
    df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "print long")
    place = {int(p): i for i, p in enumerate(prints.view(np.int64))}
    links = [(place[r["a"]], place[r["b"]]) for r in simhash.fingerprint_links(df, piece).collect()]
    assert joined(len(prints), links) == brute_components(prints)


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 60)] + [(100, x) for x in range(200, 260)] + [(7, 7), (300, 301), (300, 301)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {i: 1 for i in range(1, 61)} | {100: 100} | {x: 100 for x in range(200, 260)} | {300: 300, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").toPandas()
    prints = np.array([plain_fingerprint(t) for t in docs.text], np.uint64)
    want = {int(i): (f"{p:016x}", int(docs.doc_id[c])) for i, p, c in zip(docs.doc_id, prints, brute_components(prints))}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op2_simhash(spark, SMALL).collect()} == want


def test_edges(edge_docs, no_docs):
    rows = simhash.near_duplicates(edge_docs).select("doc_id", simhash.hex_print().alias("f"), "component_id", "keeps").collect()
    assert len(rows) == 12
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert {by[i]["f"] for i in (2, 3, 4)} == {"0" * 16} and {by[i]["component_id"] for i in (2, 3, 4)} == {2}
    assert by[6]["component_id"] == 1 and sum(r["keeps"] for r in rows if r["component_id"] == 1) == 1
    assert {r["component_id"] for r in rows if r["doc_id"] is None} == {2, None}
    kept = simhash.drop_near_duplicates(edge_docs)
    assert kept.columns == edge_docs.columns and kept.where("doc_id in (1, 6)").count() == 1 and kept.where("doc_id in (2, 3, 4)").count() == 1
    assert kept.count() == len({r["f"] for r in rows})
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.drop_near_duplicates(no_docs).count() == 0


def test_a_large_group_of_near_copies(spark, tmp_path):
    path = f"file://{tmp_path}/near"
    base = " ".join(f"word{i}" for i in range(400))
    spark.range(900).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.concat(F.lit(base), F.lit(" tail"), F.col("id"))).otherwise(F.concat_ws(" ", F.sequence(F.col("id") * 1000, F.col("id") * 1000 + 50).cast("array<string>"))).alias("text")).write.parquet(path)
    found = simhash.near_duplicates(spark.read.parquet(path))
    assert found.where("doc_id % 3 = 0").select("component_id").distinct().count() == 1
    assert found.where("doc_id % 3 <> 0 and component_id = doc_id").count() == 600


def test_components_of_few_edges_take_few_tasks(spark):
    """However many partitions shuffles have: each task leaves files, of which rounds over few edges left more than data."""
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        found = components(spark.createDataFrame([(i, i + 1) for i in range(20)] + [(40, 41)], "a long, b long"))
        assert {r["node"]: r["component"] for r in found.collect()} == {**dict.fromkeys(range(21), 0), 40: 40, 41: 40}
        assert found.rdd.getNumPartitions() <= 2
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
