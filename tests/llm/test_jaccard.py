import numpy as np
import pytest

from shelfspark.llm import jaccard
from tests.llm.test_simhash import joined

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def plain_set(text, shingle=5):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))}


def similarity(x, y):
    return len(x & y) / len(x | y)


def brute_components(texts, least=0.8, shingle=5):
    """Smallest place of each place's component, by all pairs."""
    sets = [plain_set(t, shingle) for t in texts]
    return joined(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if similarity(sets[i], sets[j]) >= least])


def edited(rng, words, changes):
    words = list(words)
    for at in rng.choice(len(words), changes, replace=False):
        words[at] = f"new{rng.integers(1 << 40)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def texts():
    """Families of 100 to 400 words with some words changed (similarities on both sides of 0.8), short ones, loose ones."""
    rng = np.random.default_rng(3)
    out = []
    for family in range(40):
        words = [f"w{x}" for x in rng.integers(0, 4000, 100 + 100 * (family % 4))]
        out += [edited(rng, words, int(c)) for c in rng.integers(0, 1 + len(words) // 33, 6)]
    out += [" ".join(f"b{i}" for i in range(100)), " ".join("other" if i == 50 else f"b{i}" for i in range(100))]
    out += ["one two three", "One  TWO three", "one two four", None, "", " \n", "a b c d e", "a b c d e f"]
    return out + [" ".join(f"w{x}" for x in rng.integers(0, 4000, 60)) for _ in range(40)]


@pytest.fixture(scope="module")
def docs(spark, texts, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('jaccard')}/docs"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def test_stage_against_all_pairs(spark, docs, texts):
    want = brute_components(texts)
    assert 40 < len(set(want)) < len(want)
    stage = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]
    assert sorted(r["doc_id"] for r in stage(spark, docs, "").collect()) == sorted(set(want))


@pytest.mark.parametrize("least, shingle, piece", [(0.8, 5, 3), (0.6, 3, jaccard.PIECE)])
def test_components_against_all_pairs(docs, texts, least, shingle, piece):
    found = jaccard.similar_documents(docs, least, shingle, piece).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == dict(enumerate(brute_components(texts, least, shingle)))


def test_pairs_within_a_bucket_whose_smallest_row_is_apart():
    minima = np.zeros((3, jaccard.BANDS * jaccard.ROWS), np.uint32)
    minima[0, 5:] = 7
    batch = jaccard.pa.RecordBatch.from_arrays([jaccard.pa.array([1, 1, 1]), jaccard.pa.array([0, 0, 0]), jaccard.pa.array([4, 6, 5]), jaccard.pa.array([4, 6, 5]), jaccard.pa.array([m.tobytes() for m in minima])], names=list("abcde"))
    assert [(r["a"], r["b"]) for out in jaccard.pair_batches(0.8)(iter([batch])) for r in out.to_pylist()] == [(5, 6)]


def test_overlaps_and_links_of_sets():
    """Shared hashes by products of matrices and by pairs, and links against a walk over all pairs."""
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 200)).astype(np.uint64)) for _ in range(60)] + [np.unique(rng.integers(0, 10**6, 50).astype(np.uint64)) for _ in range(30)]
    sets += [np.unique(np.append(sets[i][: len(sets[i]) - i % 7], np.uint64(10**9 + i))) for i in range(60)]
    shared = jaccard.overlaps(sets)
    plain = np.array([[len(np.intersect1d(x, y)) for y in sets] for x in sets])
    assert all(shared[i, j] == plain[i, j] for i in range(len(sets)) for j in range(len(sets)) if i != j)
    links = jaccard.set_links(np.arange(len(sets)) + 1000, np.arange(len(sets)), sets, 0.8)
    want = joined(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if plain[i, j] >= 0.8 * (len(sets[i]) + len(sets[j]) - plain[i, j])])
    assert joined(len(sets), [(a - 1000, b - 1000) for a, b in links]) == want and len(links) == len(sets) - len(set(want)) > 20


def test_a_large_group_of_nearly_similar_texts(spark, tmp_path):
    """Copies of one text, each changed so far that hardly two of them reach the similarity: no pair of them is emitted."""
    rng = np.random.default_rng(11)
    base = [f"w{x}" for x in rng.integers(0, 4000, 150)]
    texts = [edited(rng, base, 4) for _ in range(300)] + [edited(rng, base, 1) for _ in range(20)]
    path = f"file://{tmp_path}/near"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3).write.parquet(path)
    found = jaccard.similar_documents(spark.read.parquet(path)).collect()
    want = brute_components(texts)
    assert {r["doc_id"]: r["component_id"] for r in found} == dict(enumerate(want)) and len(set(want)) > 1


def test_recall_of_bands_at_the_threshold():
    """Of pairs of sets at similarity 0.8, all but very few share a band."""
    rng = np.random.default_rng(9)
    missed = 0
    for _ in range(400):
        hashes = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
        x, y = np.sort(hashes[:90]), np.sort(hashes[10:])
        keys = jaccard.band_keys(np.stack([jaccard.signature(x), jaccard.signature(y)]))
        missed += not (keys[0] == keys[1]).any()
    assert missed <= 1


def test_edges(edge_docs, no_docs):
    found = jaccard.similar_documents(edge_docs).collect()
    assert len(found) == 12
    by = {r["doc_id"]: r for r in found if r["doc_id"] is not None}
    assert {by[i]["component_id"] for i in (2, 3, 4)} == {2} and by[6]["component_id"] == 1
    assert {r["component_id"] for r in found if r["doc_id"] is None} == {2, None}
    assert jaccard.drop_similar_documents(edge_docs).columns == edge_docs.columns
    assert jaccard.similar_documents(no_docs).count() == 0
