"""The pipeline against the same stages by hand, on what each stage before really kept."""

import corpus_pipeline
from frames import empty, frame, odd_documents
from test_decontamination import table_distance
from test_lines import by_hand as lines_by_hand
from test_minhash import by_hand as groups_by_hand
from test_packing import check_pieces, reference_ids

from cohortdeck.llm import decontamination
from cohortdeck.llm.common import staged

SF = "/root/testdata/sf0.001"


def test_stages_in_order():
    names = ["quality", "line_dedup", "near_duplicates", "decontamination", "packing"]
    assert [name for name, _ in corpus_pipeline.STAGES] == names


def test_stage_by_stage(spark):
    import hashlib

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, staged(stage(spark, docs, SF), "test")
        kept[name] = (before.collect(), docs.collect())
        if name != "packing":
            assert docs.columns == before.columns
    before, after = kept["quality"]
    assert {r.doc_id for r in after} < {r.doc_id for r in before}
    before, after = kept["line_dedup"]
    want = {r[0]: r[3] for r in lines_by_hand([(r.doc_id, r.text) for r in before])}
    assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in after} == want
    assert all(r.n_chars == len(r.text) for r in after)
    before, after = kept["near_duplicates"]
    assert {r.doc_id for r in after} == {r[0] for r in groups_by_hand([(r.doc_id, r.text) for r in before]) if r[3]}
    before, after = kept["decontamination"]
    clean, budget = {r.doc_id for r in after}, decontamination.Benchmark([], 0.06, 14).budget
    for r in before:
        text = decontamination.normal(r.text)
        if r.doc_id in clean:
            assert not any(decontamination.normal(i.text) in text for i in items)
        else:
            patterns = [decontamination.normal(i.text) for i in items]
            assert any(min(table_distance(p, text)) <= budget(len(p)) for p in patterns if len(text) < 4000 or p in text)
    before, after = kept["packing"]
    by_doc, padding = check_pieces(after)
    assert {i: sum(n for _, n, _ in pieces) for i, pieces in by_doc.items()} == {r.doc_id: len(reference_ids(r.text)) + 1 for r in before}
    assert padding < 0.05 * sum(r.length for r in after)


def test_odd_documents(spark):
    docs = frame(spark, extra=True)
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF), "test")
    assert docs.count() >= 1
    nothing = empty(spark)
    for name, stage in corpus_pipeline.STAGES:
        nothing = staged(stage(spark, nothing, SF), "test")
    assert nothing.count() == 0 and len(odd_documents()) > 0
