import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_mixing import reshared  # noqa: E402
from tests.llm.test_packing import slow_ids  # noqa: E402
from tests.llm.test_jaccard import brute_components  # noqa: E402
from tests.oracle import SMALL  # noqa: E402


def brute_before_packing(spark, docs):
    """Rows that go into the packing stage: (doc_id, text) and their copies; the classifier is held against its own scores."""
    from shelfspark.llm import quality

    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    good = {r["doc_id"] for r in quality.score_documents(spark.read.parquet(f"{SMALL}/documents.parquet"), labels).collect() if r["predicted"]}
    left = [d for d in docs if d["doc_id"] in good]
    last = {}
    for d in left:
        key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in d["text"])
        last[key] = max(last.get(key, d), d, key=lambda x: x["doc_id"])
    left = sorted(last.values(), key=lambda d: d["doc_id"])
    labels = brute_components([d["text"] for d in left])
    left = [d for i, d in enumerate(left) if labels[i] == i]
    size, sources = {d["doc_id"]: len(d["text"].split()) for d in left}, Counter()
    for d in left:
        sources[d["source"]] += size[d["doc_id"]]
    target = reshared(dict(sources))
    out = {}
    for d in left:
        rate = target[d["source"]] / sources[d["source"]] if sources[d["source"]] else 0.0
        u = int(hashlib.md5(f"mix-1:{d['doc_id']}".encode()).hexdigest()[:13], 16) / (1 << 52)
        out[d["doc_id"]] = (d["text"], int(rate) + (u < rate - int(rate)))
    return out


def test_run_against_brute_force(spark):
    docs = [r.asDict() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    want = Counter()
    for doc, (text, copies) in brute_before_packing(spark, docs).items():
        if copies:
            want[doc] = copies * (len(slow_ids(text)) + 1)
    rows = corpus_pipeline.run(spark, SMALL).collect()
    got = Counter()
    for r in rows:
        got[r["doc_id"]] += r["length"]
    assert got == want
    fills, texts = {}, {d["doc_id"]: d["text"] for d in docs}
    ids = {doc: np.array([*slow_ids(texts[doc]), 1], "<u4") for doc in got}
    for r in rows:
        fills.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert r["ids_crc32"] == zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes())
    for pieces in fills.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


def test_stages_keep_the_columns(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SMALL)
            assert out.columns == docs.columns, name
            assert out.count() <= 2 * max(1, docs.count())
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() >= 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "SimHash near-dedup", "mixing sources to target weights", "packing"]


def test_near_dedup_finds_candidates_by_fingerprints(spark, monkeypatch):
    """With bands that no two rows share, rows whose fingerprints are near are still found, and no others."""
    import pyarrow as pa

    from shelfspark.llm import jaccard, simhash

    words = [f"word{i}" for i in range(400)]
    base = " ".join(words)
    for i in range(400):
        text = " ".join([*words[:i], "other", *words[i + 1 :]])
        if 0 < (simhash.fingerprint(text.encode()) ^ simhash.fingerprint(base.encode())).bit_count() <= 4:
            near = text
            break

    def apart(shingle):
        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    keys = [[hash((r, k)) for k in range(jaccard.BANDS)] for r in batch.column(0).to_pylist()]
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([bytes(4 * jaccard.BANDS * jaccard.ROWS)] * batch.num_rows, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["row_id", "doc_id", "minima", "keys"])

        return run

    monkeypatch.setattr(jaccard, "signature_batches", apart)
    docs = spark.createDataFrame([(1, base), (2, near), (3, "quite another text of some more words")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near(spark, docs, SMALL).collect()) == [1, 3]
