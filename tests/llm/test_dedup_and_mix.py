from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from factorloom.llm import exact_dedup, jaccard_join, line_dedup, mixing, sharding

DOCS = "doc_id long, text string, source string, Size int, keep_id string"
SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "x") for i, t, s in rows], DOCS)


ODD = [
    (1, "a  b", "s1"),
    (2, "a b", "s1"),
    (3, "a\t\nb", None),
    (4, None, "s2"),
    (5, "", "s2"),
    (6, " ", "s2"),
    (None, "a b", "s1"),
    (None, "only here", "s3"),
    (7, "A b", "s3"),
    (8, "x " * 30_000, "s3"),
    (2, "a b", "s1"),
    (9, "a b", "s3"),
]


def test_exact_groups(spark):
    got = exact_dedup.duplicate_groups(frame(spark, ODD)).collect()
    assert len(got) == len(ODD)
    groups = defaultdict(list)
    for i, t, _ in ODD:
        groups[SPACE.sub(" ", t or "")].append(i)
    for text, ids in groups.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        rows = [r for r in got if r.text_sha256 == sha]
        known = [i for i in ids if i is not None]
        assert Counter(r.doc_id for r in rows) == Counter(ids)
        assert {(r.keep_id, r.group_size) for r in rows} == {(min(known, default=None), len(ids))}
        assert all(r.kept == (r.doc_id == r.keep_id) for r in rows)


def test_exact_drop(spark):
    docs = frame(spark, ODD)
    got = exact_dedup.drop_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or -1) for r in got.collect()) == [-1, 1, 4, 6, 7, 8, 9]
    assert exact_dedup.drop_duplicates(docs.limit(0)).collect() == []
    assert exact_dedup.duplicate_groups(docs.limit(0)).collect() == []


def test_lanes_share_digests_evenly(spark):
    rows = [(i, f"text {i % 900}", "s") for i in range(3000)]
    got = exact_dedup.duplicate_groups(frame(spark, rows).repartition(7))
    assert got.where("kept").count() == 900 and got.where("group_size in (3, 4)").count() == 3000


def test_exact_runs_over_batches(spark):
    """Equal texts that lie in different Arrow batches, with null keys and one text in a third of the rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(i if i % 5 else None, "hot" if i % 3 == 0 else f"text {i % 40}", "s") for i in range(900)]
        got = exact_dedup.duplicate_groups(frame(spark, rows).repartition(6)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[hashlib.sha256(t.encode()).hexdigest()].append(i)
    assert len(got) == 900
    for r in got:
        ids = groups[r.text_sha256]
        assert (r.keep_id, r.group_size) == (min((i for i in ids if i is not None), default=None), len(ids))


@pytest.mark.parametrize("keep_first", [False, True])
def test_lines(spark, keep_first):
    rng = random.Random(5)
    pool = ["  Common line ", "common LINE", "second", "", "   ", "\tthird\r", *[f"own {i}" for i in range(40)]]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 9))), "s") for i in range(60)] + [(100, None, "s"), (101, "", "s"), (None, "second\nx", "s")]
    docs = frame(spark, rows).repartition(3)
    got = {r.doc_id: r for r in line_dedup.without_repeated_lines(docs, min_docs=5, keep_first=keep_first).collect()}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    seen = defaultdict(set)
    first = {}
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for pos, line in enumerate((t or "").split("\n")):
            seen[key(line)].add(i)
            first.setdefault(key(line), (i, pos))
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        stay = [x for p, x in enumerate(lines) if not key(x) or len(seen[key(x)]) < 5 or (keep_first and first[key(x)] == (i, p))]
        assert got[i].kept_text == "\n".join(stay), i
        assert (got[i].n_lines, got[i].n_dropped) == (len(lines), len(lines) - len(stay))
        assert got[i].kept_sha256 == hashlib.sha256("\n".join(stay).encode()).hexdigest()
    assert line_dedup.without_repeated_lines(docs.limit(0)).collect() == []


def test_lines_of_one_hot_key_over_partitions(spark):
    rows = [(i, f"hot\nown {i}", "s") for i in range(500)]
    got = line_dedup.without_repeated_lines(frame(spark, rows).repartition(6), min_docs=10).collect()
    assert len(got) == 500 and {(r.n_lines, r.n_dropped) for r in got} == {(2, 1)}


def water(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        rest = sum(w[s] for s in names if s not in full)
        over = {s for s in names if s not in full and left * w[s] / rest >= most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else left * w[s] / rest for s in names}
        full |= over


def test_mix(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice(["a", "b", "b", "b", "c", "d", None])) for i in range(1500)] + [(5000, None, "a"), (5001, "", "z"), (5002, "q " * 3000, "b")]
    docs = frame(spark, rows)
    got = mixing.plan_mix(docs).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    by_id = {i: (len(WORD.findall(t or "")), s) for i, t, s in rows}
    for n, s in by_id.values():
        sizes[s] += n
    want = water(sizes)
    taken = defaultdict(int)
    for r in got:
        n, s = by_id[r.doc_id]
        assert r["size"] == n and r.source_size == sizes[s] and math.isclose(r.target, want[s], rel_tol=1e-12)
        assert r.taken <= 2 * n and r.taken == r.copies * n
        taken[s] += r.taken
    for s, t in taken.items():
        longest = max(n for n, x in by_id.values() if x == s)
        assert abs(t - want[s]) <= longest / 2 + 1
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.plan_mix(docs.repartition(5)).collect()))
    assert sum(len(WORD.findall(r.text or "")) for r in mixing.mix(docs).collect()) == sum(taken.values())
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.plan_mix(docs.limit(0)).collect() == []


def test_mix_clashing_names(spark):
    docs = frame(spark, [(i, "w " * (i % 9), "ab"[i % 2]) for i in range(60)] + [(3, "w w w", None), (None, "w", "a")])
    clash = docs.withColumns({c: F.lit(5) for c in ("its_copies", "Its_Key", "nth_copy", "copies", "of_source", "rank", "class", "taken", "target", "salt")})
    got = mixing.mix(clash)
    assert got.columns == clash.columns and got.where("its_copies <> 5").count() == 0
    assert sorted((r.doc_id or -1) for r in got.collect()) == sorted((r.doc_id or -1) for r in mixing.mix(docs).collect())


def test_mix_inclusion_weights(spark):
    docs = spark.createDataFrame([(i, "s", 10, 3.0 if i % 2 else 1.0) for i in range(4000)], "id long, source string, size long, quality double")
    goals = spark.createDataFrame([("s", 40000, 20000.0)], "source string, source_size long, target double")
    got = {r.odd: r.n for r in mixing.draw(docs, goals, inclusion="quality").groupBy((F.col("id") % 2).alias("odd")).agg(F.sum("copies").alias("n")).collect()}
    assert got[0] + got[1] in (1999, 2000, 2001) and 2.3 < got[1] / got[0] < 4


def test_salted_sources(spark, monkeypatch):
    docs = frame(spark, [(i, "w " * (i % 7), f"s{i % 5}") for i in range(200)])
    want = sorted(map(tuple, mixing.plan_mix(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.plan_mix(docs).collect())) == want


def test_lookup_table():
    table = sharding.lookup_table([f"s{i}" for i in range(7)], 251)
    counts = Counter(table)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.lookup_table([f"s{i}" for i in range(6)], 251)
    assert sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6) < 251 // 3
    with pytest.raises(ValueError):
        sharding.lookup_table(["a", "b"], 250)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a", "a"], 251)


def test_place(spark, tmp_path):
    shards = [f"s{i}" for i in range(5)]
    docs = frame(spark, [(i, "t", "s") for i in range(300)] + [(None, None, None)]).withColumn("Shard", F.lit("old"))
    got = sharding.place(docs, shards, slots=251).collect()
    table = sharding.lookup_table(shards, 251)
    for r in got:
        slot = int(hashlib.md5(("null" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % 251
        assert (r.slot, r.shard) == (slot, shards[table[slot]])
    sharding.write_shards(docs.drop("Shard"), str(tmp_path / "out"), shards, slots=251, files=2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 301
    assert sharding.place(docs.limit(0), shards, slots=251).collect() == []


def jaccard_truth(rows, words, percent):
    sets = []
    for _, t, _ in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else []))
    top = list(range(len(rows)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                top[find(i)] = find(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[find(i)].append(r[0])
    return [(r[0], len(s), min((x for x in groups[find(i)] if x is not None), default=None)) for i, (r, s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize("words,percent,often", [(3, 90, 64), (5, 80, 64), (3, 90, 3), (2, 80, 2)])
def test_jaccard_components(spark, monkeypatch, words, percent, often):
    monkeypatch.setattr(jaccard_join, "OFTEN", often)
    rng = random.Random(words * 100 + percent + often)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    passage = [rng.choice(vocabulary) for _ in range(60)]
    for family in range(14):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 11, 40, 150, 400]))] + (passage if family % 3 == 0 else [])
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 60))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((n, ("  " if n % 3 else "\n").join(w.upper() if n % 5 == 0 else w for w in copy), "s"))
            n += 1
    rows += [(n, None, "s"), (n + 1, "", "s"), (n + 2, " \t", "s"), (n + 3, "one", "s"), (n + 4, "ONE", "s"), (n + 5, "one two", "s"), (None, "one two", "s"), (None, "quite alone here", "s"), (0, rows[0][1], "s")]
    got = jaccard_join.components_of(frame(spark, rows).repartition(3), words=words, percent=percent)
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(jaccard_truth(rows, words, percent), key=key)
    assert jaccard_join.components_of(frame(spark, rows).limit(0)).collect() == []


@pytest.mark.parametrize("words,percent,length", [(3, 90, 11), (5, 80, 8)])
def test_jaccard_one_word_more(spark, words, percent, length):
    rows = []
    for family in range(6):
        base = [f"f{family}w{i}" for i in range(length + family % 3 - 1)]
        rows += [(3 * family, " ".join([*base, "after"]), "s"), (3 * family + 1, " ".join(base), "s"), (3 * family + 2, " ".join(["before", *base]), "s")]
    truth = jaccard_truth(rows, words, percent)
    assert any(k != c for k, _, c in truth)
    got = jaccard_join.components_of(frame(spark, rows).repartition(3), words=words, percent=percent)
    assert sorted(map(tuple, got.collect())) == sorted(truth)


@pytest.mark.parametrize("words,percent,often", [(3, 90, 64), (5, 80, 64), (3, 50, 64), (1, 50, 1), (2, 30, 1)])
def test_jaccard_nested_texts_of_every_length(spark, monkeypatch, words, percent, often):
    monkeypatch.setattr(jaccard_join, "OFTEN", often)
    rows = []
    for n in range(1, 61):
        base = [f"f{n}w{i}" for i in range(n)]
        more = max(1, n // 12)
        rows += [(3 * n, " ".join(base), "s"), (3 * n + 1, " ".join([*base, *[f"x{n}y{i}" for i in range(more)]]), "s"), (3 * n + 2, " ".join(["before", *base]), "s")]
    if words < 3:  # a few words in many texts, so that frequent tokens are all that small sets share
        rows += [(1000 + i, f"common other{i}" if i % 2 else "common", "s") for i in range(8)]
    got = jaccard_join.components_of(frame(spark, rows).repartition(3), words=words, percent=percent)
    assert sorted(map(tuple, got.collect())) == sorted(jaccard_truth(rows, words, percent))


def test_jaccard_long_text_and_clashing_names(spark):
    rng = random.Random(8)
    long_text = [f"w{rng.randrange(50_000)}" for _ in range(150_000)]
    near = list(long_text)
    for i in range(0, 150_000, 400):
        near[i] = "changed"
    docs = frame(spark, [(1, " ".join(long_text), "s"), (2, " ".join(near), "s"), (3, "another short text", "s"), (3, "another short text", "s")])
    docs = docs.withColumns({c: F.lit(7) for c in ("n_shingles", "Component_ID", "id", "mark", "class", "keys", "tokens", "out_key", "stays", "top", "many")})
    got = jaccard_join.components_of(docs, words=3, percent=90)
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [(1, 1), (2, 1), (3, 3), (3, 3)]
    kept = jaccard_join.keep_one_of_each(docs, words=3, percent=90)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert jaccard_join.keep_one_of_each(docs.limit(0)).collect() == []


def test_packed_codes():
    import numpy as np

    from factorloom.llm.chunks import encode, pack_codes, unpack_codes

    for texts in ([], [b""], [b"a b a", b"c a"], [" ".join(f"w{i}" for i in range(70_000)).encode()]):
        _, codes, words = encode(list(range(len(texts))), texts, end=False)
        codes2, words2 = unpack_codes(*pack_codes(codes, words))
        assert np.array_equal(codes, codes2) and np.array_equal(words, words2)


def test_jaccard_keep_one(spark):
    base = " ".join(f"w{i}" for i in range(100))
    docs = frame(spark, [(3, base, "s"), (2, base + " more", "s"), (5, "other text", "s"), (None, base, "s"), (8, None, "s")])
    got = jaccard_join.keep_one_of_each(docs)
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [2, 5, 8]


def test_jaccard_keep_one_of_rows_with_one_key(spark):
    a, b, c, d = (" ".join(f"{t}{i}" for i in range(100)) for t in "abcd")
    docs = frame(
        spark,
        [
            *[(1, a, "s"), (None, a + " more", "s"), (None, "unique text without any link", "s"), (5, a + " copy", "s"), (5, "another text without a link", "s")],
            *[(7, b, "s"), (7, b + " more", "s"), (8, b + " copy", "s"), (9, c, "s"), (9, c, "s"), (10, c, "s")],
            *[(None, d, "s"), (None, d + " more", "s"), (5, "", "s"), (None, None, "s"), (5, " ", "s")],
        ],
    )
    got = jaccard_join.keep_one_of_each(docs)
    assert got.columns == docs.columns
    sure, one_of = [], []
    for r in got.collect():
        (one_of if (r.text or "")[:2] in ("b0", "d0") else sure).append((r.doc_id, r.text))
    want = [(1, a), (None, "unique text without any link"), (5, "another text without a link"), (9, c), (5, ""), (None, None), (5, " ")]
    assert Counter(sure) == Counter(want)
    assert sorted((k or 0, t[0]) for k, t in one_of) == [(0, "d"), (7, "b")]
