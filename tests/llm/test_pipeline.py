"""The pipeline: columns, effects of every stage, and recovery from stored results."""

import pytest

pytest.importorskip("barloom.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from barloom.llm import decontamination, language_id, line_dedup, near_dedup, packing  # noqa: E402
from barloom.llm.common import read, stored  # noqa: E402


def test_stages(spark, sf):
    docs = read(spark, sf, "documents").selectExpr("*", "doc_id % 7 AS pos", "'x' AS row")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, sf))
        assert out.columns == names, name
        before, after = docs.count(), out.count()
        if name == "language_id":
            gone = language_id.identify(docs, language_id.fit(docs)).filter("scan.rejected").count()
            assert before - after == gone
        if name == "line_dedup":
            assert before == after
            kept = {(r["row"]["doc_id"], r["kept"]) for r in line_dedup.line_dedup(docs).collect()}
            assert {(r["doc_id"], r["text"] or "") for r in out.collect()} == kept
            assert all(r["n_chars"] == len(r["text"]) for r in out.collect() if r["text"] is not None)
        if name == "near_dedup":
            assert after == near_dedup.digest(docs).filter("kept").count() < before
        if name == "decontamination":
            bad = {r["doc_id"] for r in decontamination.digest(docs, read(spark, sf, "benchmark")).filter("contaminated").collect()}
            assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()} - bad
        seen.append(after)
        docs = out
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    want = {r["doc_id"]: r["doc_tokens"] for r in packing.digest(docs).collect()}
    total = pieces.groupBy("doc_id").sum("length").collect()
    assert {r["doc_id"]: r[1] for r in total} == want
    assert corpus_pipeline.run(spark, sf).count() == pieces.count()
