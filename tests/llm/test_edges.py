"""Clashing names, long texts, repeated rows, ties and empty tables."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factorloom.llm import line_dedup, neighbours, packing, sharding, token_counts, toxicity

CLASH = ["n_lines", "kept_text", "bitmap", "h", "rid", "pos", "Score", "key", "row_key", "its_copies", "keep_id", "n_shingles", "component_id", "gone_key", "sequence_id", "ticket", "c0", "raw"]


def clashing(docs):
    return docs.withColumns({c: F.lit(9) for c in CLASH})


def test_lines_long_texts_repeats_and_clashing_names(spark):
    long_text = "\n".join(["shared", *[f"line {i}" for i in range(30_000)], "shared"])
    rows = [(i, "shared\nown %d" % i) for i in range(10)] + [(20, long_text), (20, long_text), (None, "shared"), (21, None)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = line_dedup.without_repeated_lines(docs, min_docs=10).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    assert {(r.n_lines, r.n_dropped) for r in got if r.doc_id == 20} == {(30_002, 2)}
    want = hashlib.sha256("\n".join(f"line {i}" for i in range(30_000)).encode()).hexdigest()
    assert {r.kept_sha256 for r in got if r.doc_id == 20} == {want}
    assert {(r.n_lines, r.n_dropped) for r in got if r.doc_id is None} == {(1, 1)}


def test_toxicity_of_repeated_rows(spark):
    docs = clashing(spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None), (None, "a b")], "doc_id long, text string"))
    got = toxicity.score(docs, toxicity.Network.fresh(), extra=["doc_id"]).collect()
    assert Counter(r.doc_id for r in got) == Counter([1, 1, 2, None]) and len({r.score for r in got if r.doc_id != 2}) == 1


def test_neighbours_tie_over_blocks(spark):
    rng = np.random.default_rng(0)
    data = rng.normal(size=(400, 8))
    data[1:200:3] = data[0]  # equal vectors, dealt to many blocks
    frame = spark.createDataFrame([(i, data[i].tolist()) for i in range(400)], "vec_id long, embedding array<double>")
    got = neighbours.search(frame, block=50, least=50, n_pivots=32, prefix=16).where("query_id = 0").orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 4, 7, 10, 13]


def test_lookup_table_is_that_of_plain_turns():
    shards, slots = [f"n{i}" for i in range(5)], 97

    def order(name):
        h = int.from_bytes(hashlib.md5(name.encode()).digest(), "big")
        start, step = h % slots, (h >> 64) % (slots - 1) + 1
        return [(start + k * step) % slots for k in range(slots)]

    wishes, taken = [order(s) for s in shards], {}
    assert all(sorted(w) == list(range(slots)) for w in wishes)
    while len(taken) < slots:
        for i, wish in enumerate(wishes):
            free = [s for s in wish if s not in taken]
            if free:
                taken[free[0]] = i
    assert sharding.lookup_table(shards, slots) == [taken[s] for s in range(slots)]


@pytest.mark.parametrize("operator", [packing.pack, token_counts.section_tokens, line_dedup.without_repeated_lines])
def test_keys_are_integers(spark, operator):
    with pytest.raises(TypeError, match="integer keys"):
        operator(spark.createDataFrame([("a", "text")], "doc_id string, text string"))


def test_pipeline_of_empty_tables_and_clashing_names(spark, tmp_path):
    docs = clashing(spark.createDataFrame([(1, "a b c d e f", "en", "s", 1), (2, None, None, None, None), (1, "a b c d e f", "en", "s", 1), (None, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for name, rows in (("full", docs), ("empty", docs.limit(0))):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/full").collect()} == {1}
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


def test_word_store_is_small_by_default():
    import inspect

    from factorloom.llm import tokens

    assert inspect.signature(tokens.word_coder).parameters["most"].default <= 200_000
    assert inspect.signature(tokens.WordCoder.__init__).parameters["most"].default <= 200_000


def test_frequent_words_outlast_a_full_store():
    from factorloom.llm import tokens

    made = []
    store = tokens.Store(lambda k: made.append(k) or k, most=20)
    for k in range(200):
        assert store["often"] == "often" and store[k] == k and len(store) + len(store.aside) <= 20
    assert made.count("often") == 1 and made[-1] == 199
