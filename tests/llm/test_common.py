import pytest
import xxhash
from pyspark.sql import functions as F

from shelfspark.llm import common, exact_dedup, jaccard, simhash, warc_zip
from tests.oracle import SMALL

MEDIUM = "/root/testdata/sf0.01"
SPLITS = {"spark.sql.leafNodeDefaultParallelism": ("2", "16"), "spark.sql.files.openCostInBytes": ("4194304", "1024"), "spark.sql.files.maxPartitionBytes": ("128m", "200k")}


@pytest.fixture
def split(spark):
    """Sets how finely files are split; all as before afterwards."""
    before = {k: spark.conf.get(k, None) for k in SPLITS}

    def to(fine: bool) -> None:
        for key, values in SPLITS.items():
            spark.conf.set(key, values[fine])

    yield to
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_hash_of_paths_is_that_of_spark(spark):
    path = "file:/tmp/a%20b/é.parquet"
    assert spark.range(1).select(F.xxhash64(F.lit(f"3:{path}"))).first()[0] & (1 << 64) - 1 == xxhash.xxh64_intdigest(f"3:{path}", 42)
    salt = common.file_salt([f"p{i}" for i in range(300)], 16)
    assert len({xxhash.xxh64_intdigest(f"{salt}:p{i}", 42) >> 48 for i in range(300)}) == 300
    with pytest.raises(ValueError):
        common.file_salt([f"p{i}" for i in range(9)], 3)


def test_numbers_do_not_depend_on_splits(spark, split, tmp_path):
    path = f"file://{tmp_path}/a b%20c"
    spark.read.parquet(f"{MEDIUM}/documents.parquet").repartition(5).write.parquet(path)
    seen = []
    for fine in (False, True):
        split(fine)
        rows = common.with_row_id(spark.read.parquet(path).select("doc_id", "text").where("doc_id % 3 > 0"), "n")
        seen.append(({r["doc_id"]: r["n"] for r in rows.select("doc_id", "n").collect()}, rows.rdd.getNumPartitions()))
    assert seen[0][0] == seen[1][0] and len(set(seen[0][0].values())) == len(seen[0][0]) and seen[0][1] < seen[1][1]


def test_rows_from_elsewhere_are_numbered_once(spark):
    rows = common.with_row_id(spark.range(100).select((F.col("id") % 7).alias("doc_id")), "n")
    assert [r["n"] for r in rows.orderBy("n").collect()] == [r["n"] for r in rows.orderBy("n").collect()]
    assert rows.select("n").distinct().count() == 100


@pytest.mark.parametrize("drop", [exact_dedup.drop_exact_duplicates, simhash.drop_near_duplicates, jaccard.drop_similar_documents])
def test_splits_change_between_jobs(spark, split, monkeypatch, drop):
    """Each checkpoint of the operator is followed by another way of splitting the files that the next job reads."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    split(False)
    want = sorted(r["doc_id"] for r in drop(docs).collect())
    turns, plain = [], common.cut

    def cut(df):
        split(len(turns) % 2 == 0)
        turns.append(1)
        return plain(df)

    for module in (common, exact_dedup, simhash, jaccard):
        monkeypatch.setattr(module, "cut", cut)
    got = drop(docs)
    split(True)
    assert sorted(r["doc_id"] for r in got.collect()) == want and len(turns) > 2 and len(want) < docs.count()


def test_without_a_shared_folder_the_warehouse_is_used(spark):
    at = common.shared_dir(spark)
    assert at.startswith(spark.conf.get("spark.sql.warehouse.dir").rstrip("/")) or spark.conf.get("spark.checkpoint.dir", None)


def test_equal_payloads_are_found_by_digest(spark):
    rows = [(1, 5, "aa"), (2, 3, "aa"), (3, None, "aa"), (4, None, "bb"), (5, None, "bb"), (6, 1, None), (7, 2, None), (8, 9, "cc")]
    found = warc_zip.repeated_payloads(spark.createDataFrame(rows, "row_id long, page_id long, sha1 string")).collect()
    assert sorted(tuple(r) for r in found) == [(1, 3, 2), (3, 3, 2), (5, None, 4)]
