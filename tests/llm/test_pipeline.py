from __future__ import annotations

import random

import corpus_pipeline


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(500)]
    clean = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows, labels = [], []
    for i in range(300):
        text = clean(80) + (" nasty vile nasty" if i % 5 == 0 else "")
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, 1, int(i % 5 == 0)))
    long = clean(200)
    rows += [(1000, long, "en", "s1", 1), (1001, long.replace(" ", "  "), "en", "s1", 1), (1002, long + " tail", "en", "s1", 1), (1003, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        docs = spark.read.parquet(f"{tmp_path}/{name.replace(' ', '_')}")
        if name != "packing":
            assert docs.columns == columns
            kept.append({r.doc_id for r in docs.collect()})
    toxic = {i for i in range(0, 300, 5)}
    assert not kept[0] & toxic and len(kept[0]) >= 300 + 4 - len(toxic) - 3
    assert kept[0] - kept[1] == {1001} and kept[1] - kept[2] == {1002}
    assert kept[3] <= kept[2]
    pieces = docs.collect()
    assert {r.doc_id for r in pieces} == kept[3]
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert run.count() == len(pieces)
