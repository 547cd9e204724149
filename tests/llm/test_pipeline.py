"""Each stage of the pipeline on what the one before it kept."""

import corpus_pipeline
from clauseloom.llm import quality

from .cases import FOLDER, empty, frame, rows
from .test_pairs import groups


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, held = docs.columns, [docs]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, held[-1], FOLDER).write.parquet(str(tmp_path / str(n)))
        held.append(spark.read.parquet(str(tmp_path / str(n))))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram Jaccard join", "secret scans", "packing"]
    assert all(h.columns == columns for h in held[:-1])
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    scored = quality.score_quality(docs, quality.train_quality(docs, labels)).where("predicted = 1")
    assert {r.doc_id for r in held[1].collect()} == {r.doc_id for r in scored.collect()}
    lined = {r.doc_id: r.text for r in held[2].collect()}
    before = {r.doc_id: r.text for r in held[1].collect()}
    assert all(set(t.split("\n")) <= set(before[d].split("\n")) for d, t in lined.items())
    long = [line for t in lined.values() for line in t.split("\n") if any(c.isalnum() for c in line)]
    assert len(long) == len(set(long))
    assert {r.doc_id for r in held[3].collect()} == {d for d, _, c in groups(lined.items()) if d == c}
    assert {r.doc_id for r in held[4].collect()} == {r.doc_id for r in held[3].collect()}
    assert held[4].where("n_chars <> length(text)").count() == 0
    assert {r.doc_id for r in held[5].collect()} == {r.doc_id for r in held[4].collect()}


def test_stages_take_odd_rows(spark):
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in stages.items():
        assert stage(spark, empty(spark), FOLDER).count() == 0
        odd = frame(spark).drop("score", "start")
        found = stage(spark, odd, FOLDER)
        if name == "packing":
            assert found.select("doc_id").distinct().count() == len({d for d, _ in rows()})
        else:
            assert found.columns[:2] == odd.columns[:2] and set(odd.columns) <= set(found.columns)
            assert {r.doc_id for r in found.collect()} <= {d for d, _ in rows()}
    assert stages["secret scans"](spark, frame(spark), FOLDER).count() == len(rows())


def test_run_gives_the_pieces_of_what_stays(spark):
    found = corpus_pipeline.run(spark, FOLDER)
    assert found.columns[:5] == ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] and found.count() > 0
