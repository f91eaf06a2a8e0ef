from __future__ import annotations

import corpus_pipeline
import public_tokenizers

from logloom.llm import mixing, quality_classifier, quality_rules

from test_duplicates import brute_components

FOLDER = "/root/testdata/sf0.01"


def test_stages_equal_brute_force(spark):
    """Every stage on what its predecessor kept, each against its own definition."""
    import sentencepiece

    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "quality rules", "near dedup", "mixing", "sentencepiece"]
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    outputs = [documents]
    for name, stage in corpus_pipeline.STAGES:
        outputs.append(corpus_pipeline.stored(spark, stage(spark, outputs[-1], FOLDER), "test_" + name.replace(" ", "_")))
    for a, b in zip(outputs[:4], outputs[1:5], strict=True):
        assert b.columns == a.columns == documents.columns
        assert b.exceptAll(a).count() == 0
    ids = [{r.doc_id for r in o.select("doc_id").collect()} for o in outputs]

    trees = quality_classifier.train(documents, labels)
    assert ids[1] == {r.doc_id for r in quality_classifier.score_documents(documents, trees).where("score >= 0.3").collect()}
    known = {r.doc_id: r.quality for r in labels.collect()}
    assert sum(known.get(i) == 1 for i in ids[1]) >= 0.99 * sum(q == 1 for q in known.values())
    assert sum(known.get(i) == 0 for i in ids[1]) <= 0.02 * sum(q == 0 for q in known.values()) + 1

    judged = quality_rules.verdicts(quality_rules.measure(outputs[1]), quality_rules.limits_of(spark, quality_rules.measure(outputs[1])))
    assert ids[2] == {r.doc_id for r in judged.where("kept").select("row.doc_id").collect()}

    rows = [tuple(r) for r in outputs[2].select("doc_id", "text").collect()]
    assert ids[3] == set(brute_components(rows, 5, 80))

    sizes = [o.count() for o in outputs]
    assert sizes[4] >= 0.7 * sizes[3] and 0 < mixing.BUDGET_SHARE <= 1
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text for r in outputs[4].collect()}
    encoded = {r.doc_id: r.ids for r in outputs[5].collect()}
    assert encoded == {i: library.encode(t or "") for i, t in texts.items()}


def test_stages_on_edges(spark, edges, nothing, tmp_path):
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (edges, nothing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, str(tmp_path))
            assert out.count() <= table.count()
            assert name == "sentencepiece" or out.schema == table.schema


def test_stored_tables_can_be_deleted(spark):
    from pathlib import Path

    from logloom.llm import shared

    shared.stored(spark, spark.range(3), "test_stored")
    folders = [Path(f.removeprefix("file:")) for f in shared._STORED]
    assert folders[-1].exists()
    shared.clean_up(spark)
    assert not any(f.exists() for f in folders) and not shared._STORED
