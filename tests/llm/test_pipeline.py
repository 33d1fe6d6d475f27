"""The pipeline's stages, each against plain Python on what the stage before kept."""

from __future__ import annotations

import corpus_pipeline as C
from tests.conftest import SF


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    start = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    kept = {}
    for name, stage in C.STAGES:
        docs = C.common.stage(stage(spark, docs, SF), f"test-{name}")
        if name != "packing":
            assert set(docs.columns) == set(columns)
            kept[name] = {r["doc_id"] for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [d for d, q in labels.items() if q == 1 and d in start]
    assert sum(d in kept["quality"] for d in good) > 0.9 * len(good)
    assert len(kept["language"]) > 0.95 * len(kept["quality"])
    first = {}
    for d in sorted(kept["language"]):
        first.setdefault(start[d], d)
    assert kept["exact_dedup"] == set(first.values())

    shingles = {d: {tuple(start[d].lower().split()[i : i + 5]) for i in range(max(1, len(start[d].split()) - 4))} for d in kept["exact_dedup"]}
    left = sorted(kept["near_dedup"])
    near = sum(len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]) for i, a in enumerate(left) for b in left[:i])
    gone = kept["exact_dedup"] - kept["near_dedup"]
    assert near <= 1 + 0.1 * len(gone)
    for d in gone:  # what went is near to something, directly or through another copy
        assert any(len(shingles[d] & shingles[b]) >= 0.8 * len(shingles[d] | shingles[b]) for b in kept["exact_dedup"] if b != d)
    assert {r["doc_id"] for r in docs.collect()} == kept["near_dedup"]


def test_odd_documents(spark):
    rows = [(None, "no id here at all", "en", "s", 5), (1, None, "en", "s", None), (2, "", None, None, 0), (3, "The house is of the and.", "en", "s", 9), (3, "The house is of the and.", "en", "s", 9), (4, "The house is of the and.", "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and set(r["doc_id"] for r in docs.collect()) <= {1, 2, 3, 4}
    none = spark.createDataFrame([], docs.schema)
    for _, stage in C.STAGES:
        assert stage(spark, none, SF).count() == 0
