"""The pipeline's stages one after the other, against brute force on what each was given."""

import corpus_pipeline
from test_duplicates import brute_fingerprint, brute_lines, components
from test_rules_and_filters import brute_hits


def test_stages(spark, sf, documents):
    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        out = spark.createDataFrame(stage(spark, docs, sf).collect(), stage(spark, docs, sf).schema)
        seen[name] = (docs.collect(), out.collect())
        docs = out
        if name != "source mixing":
            assert out.columns == documents.columns

    before, after = seen["quality rules"]
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    assert all(len(r.text.split()) >= 20 for r in after) and gone
    assert sum(quality.get(r.doc_id) == 1 and len(r.text.split()) >= 50 for r in before if r.doc_id in gone) <= 1

    before, after = seen["line dedup"]
    lost = brute_lines([(r.doc_id, r.text) for r in before])
    want = {r.doc_id: "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in lost.get(r.doc_id, ())) for r in before}
    assert {r.doc_id: r.text for r in after} == want

    before, after = seen["near-duplicates"]
    ids, fps = [r.doc_id for r in before], [brute_fingerprint(r.text) for r in before]
    comp = components(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    low = {}
    for i, k in enumerate(comp):
        low[k] = min(low.get(k, 1 << 60), ids[i])
    assert sorted(r.doc_id for r in after) == sorted(low.values())

    before, after = seen["decontamination"]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = brute_hits([(r.doc_id, r.text) for r in before], bench)
    assert {r.doc_id for r in after} == {d for d, v in hit.items() if not v[1]}

    before, after = seen["source mixing"]
    assert {r.doc_id for r in after} <= {r.doc_id for r in before} and max(r.copy_no for r in after) <= 2


def test_run_is_the_stages(spark, sf):
    again = [sorted(map(str, corpus_pipeline.run(spark, sf).collect())) for _ in range(2)]
    assert again[0] == again[1] and again[0]
