"""The corpus pipeline, stage by stage, against what each stage promises."""

import hashlib

import corpus_pipeline as pipeline
from pyspark.sql import functions as F
from test_edges import jaccard_by_hand


def test_stages_hand_on_what_they_keep(spark, sf):
    from burnish.llm import line_dedup, mixing, quality
    from burnish.llm.queries import REMAINDER, piece_model

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in pipeline.STAGES[:-1]:
        before = docs
        docs = pipeline.checkpointed(stage(spark, docs, sf), "test")
        assert docs.columns == columns
        kept[name] = (before, docs)
    before, after = kept["quality classifier"]
    scored = quality.score_quality(before, spark.read.parquet(f"{sf}/labels.parquet"), train=F.expr(f"{REMAINDER} <> 0"))
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in scored.filter("predicted = 1").collect()}
    before, after = kept["line dedup"]
    cut = {r.doc_id: r.text for r in line_dedup.drop_repeated_lines(before).collect()}
    assert {r.doc_id: (r.text, r.n_chars) for r in after.collect()} == {i: (t, len(t)) for i, t in cut.items()}
    before, after = kept["n-gram Jaccard join"]
    groups = jaccard_by_hand([(r.doc_id, r.text) for r in before.collect()])
    assert sorted(r.doc_id for r in after.collect()) == [i for i, _, c in groups if i == c]
    before, after = kept["mixing sources to target weights"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in mixing.mix_sources(before).filter("mix_kept").collect()}
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=piece_model())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in pipeline.run(spark, sf).collect()}
    want = {}
    for r in after.collect():
        ids = sp.encode(r.text)
        want[r.doc_id] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    assert got == want and got


def test_odd_documents_pass_through(spark, sf, docs_of):
    text = "some words of a text that is long enough to be a line of its own"
    rows = [(1, text), (1, text), (2, text), (None, text), (3, None), (4, ""), (5, text * 400)]
    for _, stage in pipeline.STAGES:
        docs = docs_of(rows)
        out = stage(spark, docs, sf)
        assert out.count() <= len(rows)
        assert stage is pipeline.STAGES[-1][1] or out.columns == docs.columns
    stay = pipeline.near_copies(spark, docs_of(rows), sf)
    assert sorted((r.doc_id or 0) for r in stay.collect()) == [0, 1, 3, 4, 5]
    empty = docs_of(rows).filter("doc_id > 9")
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
