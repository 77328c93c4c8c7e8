from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from factorloom.llm import byte_bpe, hard_negatives, variants
from factorloom.llm.tokens import tokenizer_path

DOCS = "doc_id long, text string, word string, key string"


def brute_variants(counts: dict[str, int], factor: int = 10) -> dict[str, tuple]:
    def near(a: str, b: str) -> bool:
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        if len(a) > len(b):
            a, b = b, a
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    form, n_near = {}, {}
    for w, n in counts.items():
        others = [x for x in counts if near(w, x)]
        n_near[w] = len(others)
        if others and counts[best := min(others, key=lambda x: (-counts[x], x))] >= factor * n:
            form[w] = best
    out = {}
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, n_near[w], counts.get(form.get(w)))
    return out


def found_variants(spark, counts: dict[str, int]) -> dict[str, tuple]:
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    rows = variants.group_variants(words).collect()
    assert len(rows) == len(counts)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def some_words(seed: int, alphabet: str, lengths: tuple[int, int], many: int) -> dict[str, int]:
    r = random.Random(seed)
    return {"".join(r.choice(alphabet) for _ in range(r.randint(*lengths))): r.choice([1, 1, 2, 5, 20, 100, 1000, 50_000]) for _ in range(many)}


@pytest.mark.parametrize("alphabet, lengths", [("ab", (1, 9)), ("abcdefghij", (2, 5)), ("aé日𝄞z", (1, 5))])
def test_variants_equal_brute_force(spark, alphabet, lengths):
    counts = some_words(3, alphabet, lengths, 400)
    assert found_variants(spark, counts) == brute_variants(counts)


def test_variants_of_anagrams_in_small_blocks(spark, monkeypatch):
    """One cell holds all words: it is cut into blocks and parts, and no pair is lost or counted twice."""
    monkeypatch.setattr(variants, "TRIE_CHARS", 500)
    monkeypatch.setattr(variants, "SEARCH_CHARS", 700)
    r = random.Random(5)
    counts = {"".join(r.sample("abcdefg", 7)): r.choice([2, 30, 400]) for _ in range(150)}
    counts |= {w[:-1]: 9 for w in list(counts)[:60]} | {w[:3] + "x" + w[4:]: 5000 for w in list(counts)[:60]}
    assert found_variants(spark, counts) == brute_variants(counts)


def test_search_in_halves(monkeypatch):
    monkeypatch.setattr(variants, "HELD", 7)
    words = sorted(w for w in some_words(8, "abc", (5, 5), 200))
    points = variants.code_points(words, 5)
    q, w = variants.near_pairs(points, points, {}, ordered=True)
    got = sorted((words[a], words[b]) for a, b in zip(q.tolist(), w.tolist(), strict=True))
    assert got == sorted((a, b) for a in words for b in words if a < b and sum(x != y for x, y in zip(a, b, strict=True)) == 1)


def test_moves_meet_each_pair_once():
    r = random.Random(2)
    for depth in variants.DEPTHS:
        for _ in range(200):
            a = np.array([[r.randint(0, 2) for _ in range(variants.GROUPS)]])
            b = a.copy()
            i, j = r.sample(range(variants.GROUPS), 2)
            longer = r.random() < 0.5
            b[0, i] += 1
            a[0, j] += not longer
            mine, other = variants.cell_code(a, depth), variants.cell_code(b, depth)
            ways = [c for x, c in variants.moves(depth) if x == longer and (variants.moved(mine, c) == other).all()]
            back = [] if longer else [c for x, c in variants.moves(depth) if not x and any(c) and (variants.moved(other, c) == mine).all()]
            assert len(ways) + len(back) == 1


def test_counted_words(spark):
    texts = [(1, "Letters letters LETTERS ÉcoleÉcole", "x", "y"), (2, None, None, None), (None, "letters\x00letterz lettérs short", None, None), (3, "", "", ""), (4, "lettérs " * 40 + "x" * 30_000, "", "")]
    want: Counter = Counter()
    for key, text, *_ in texts:
        import re

        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 3 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += 1
    rows = variants.count_words(spark.createDataFrame(texts, DOCS), least=6, least_count=1, damage=3).collect()
    assert {r.word: r.n for r in rows} == {w: n for w, n in want.items() if len(w) >= 6}


def test_variants_of_nothing_and_of_odd_rows(spark):
    none = spark.createDataFrame([], "word string, n long")
    assert variants.group_variants(none).count() == 0
    assert variants.count_words(spark.createDataFrame([], DOCS)).count() == 0
    rows = spark.createDataFrame([(None, 5, 1), ("a", None, 1), ("", 1, 1), ("b", 10, 1), ("y" * 5000, 1, 1), ("y" * 5001, 10, 1)], "word string, n long, root int")
    got = {r.word: (r.form, r.root, r.n_near) for r in variants.group_variants(rows).collect()}
    assert got == {"": ("b", "b", 1), "b": (None, "b", 1), "y" * 5000: ("y" * 5001, "y" * 5001, 1), "y" * 5001: (None, "y" * 5001, 1)}


VECTORS = "vec_id long, embedding array<double>, label int, uid int, x string"


def brute_negatives(rows: list[tuple], every: int = 10) -> list[tuple]:
    fine = [
        (i, k, [math.floor(256 * c) for c in v], y)
        for i, (k, v, y, *_) in enumerate(rows)
        if v is not None and y is not None and all(c is not None and math.isfinite(c) and math.isfinite(256 * c) for c in v)
    ]
    big = 2**63 - 1
    out = []
    for i, k, v, y in fine:
        if k is None or k % every:
            continue
        scored = [(max(-big, min(big, sum(a * b for a, b in zip(v, w, strict=True)))), big if o is None else o, j, o, z) for j, o, w, z in fine if j != i and len(w) == len(v)]
        scored.sort(key=lambda t: (-t[0], t[1], t[2]))
        for p in [t for t in scored if t[4] == y][:5]:
            inside = [t for t in scored if t[4] != y and 30 * p[0] <= 100 * t[0] <= 90 * p[0]][:10]
            out += [(k, p[3], r + 1, t[3], p[0], t[0]) for r, t in enumerate(inside)]
    return sorted(out, key=repr)


def mined(spark, rows: list[tuple]) -> list[tuple]:
    frame = spark.createDataFrame(rows, VECTORS)
    return sorted((tuple(r) for r in hard_negatives.mine(frame, every=10).collect()), key=repr)


@pytest.mark.parametrize("dims, near", [(64, 0.0), (64, 0.9), (100, 0.6), (3, 0.5)])
def test_negatives_equal_brute_force(spark, dims, near):
    rng = np.random.default_rng(dims)
    centre = rng.normal(size=dims)
    rows = [(i, [float(x) for x in near * centre + rng.normal(size=dims)], int(rng.integers(0, 4)), 0, "") for i in range(300)]
    got = mined(spark, rows)
    assert got == brute_negatives(rows) and got


def test_negatives_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ANCHORS", 7)
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 1)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in 1 + rng.normal(size=8)], int(rng.integers(0, 10) > 6), 0, "") for i in range(2500)]
    some = [r if r[0] % 250 == 0 else (r[0] * 10 + 1, *r[1:]) for r in rows]
    assert mined(spark, some) == brute_negatives(some)


def test_negatives_with_odd_rows(spark):
    rng = np.random.default_rng(9)
    one = lambda scale=1.0, dims=6: [float(x) for x in scale * (1 + rng.normal(size=dims))]
    same = one()
    rows = [(i % 40, same if i % 5 == 0 else one(), int(i % 3), 0, "") for i in range(120)]  # repeated keys and vectors
    rows += [(None, one(), 1, 0, ""), (None, same, 2, 0, ""), (10, None, 1, 0, ""), (20, one(), None, 0, ""), (30, [1.0, None, 2.0, 3.0, 4.0, 5.0], 1, 0, "")]
    rows += [(40, [float("nan")] * 6, 1, 0, ""), (50, [float("inf")] * 6, 1, 0, ""), (60, [1.7e308] * 6, 1, 0, ""), (70, [], 1, 0, ""), (71, [], 1, 0, ""), (72, [], 2, 0, ""), (80, [0.0] * 6, 1, 0, "")]
    rows += [(90, one(1e9), 1, 0, ""), (91, one(1e9), 1, 0, ""), (92, one(5e8), 2, 0, ""), (100, one(1e200), 1, 0, ""), (110, one(1e-200), 0, 0, ""), (120, one(1, 9), 1, 0, ""), (121, one(1, 9), 1, 0, "")]
    assert mined(spark, rows) == brute_negatives(rows)


def test_no_negatives(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(10, [1.0, 2.0], 1, 0, "")]) == []


def test_intervals_hold_the_products():
    rng = np.random.default_rng(1)
    x = np.floor(256 * rng.normal(size=(500, 64)))
    codes, along, rest = hard_negatives.code_rows(x)
    import pyarrow as pa

    pack = lambda a: [r.tobytes() for r in a]
    table = pa.table({"uid": range(500), "id": range(500), "label": [0] * 500, "dims": [64] * 500, "x": pack(x), "codes": pack(codes), "along": pack(along), "rest": pack(rest), "norm": np.sqrt((x * x).sum(axis=1))})
    block = hard_negatives.Block(table)
    rows = np.arange(500)
    for q, anchor in zip(x[:20], hard_negatives.anchors_of(x[:20]), strict=True):
        middle = slack = np.zeros(500)
        widths = []
        for stage in range(hard_negatives.STAGES):
            middle, slack, least, most = block.refine(anchor, rows, stage, middle, slack)
            true = x @ q
            assert (least <= true).all() and (true <= most).all()
            widths.append(float((most - least).mean()))
        assert widths == sorted(widths, reverse=True)


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    import public_tokenizers

    coder = byte_bpe.ByteBpe(tokenizer_path(byte_bpe.VOCABULARY))
    return coder, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def odd_texts() -> list[str]:
    r = random.Random(1)
    letters = "abcde aé日本𝄞\n\t0123!!--__..  　 \x1c\x00"
    texts = ["".join(r.choice(letters) for _ in range(r.choice([0, 1, 5, 50, 600, 3000]))) for _ in range(150)]
    texts += ["".join(r.choice("abcdefgh") for _ in range(n)) for n in (511, 512, 513, 700, 2000)]
    return texts + [c * n for c in "a =" for n in (1, 2, 511, 512, 513, 5000)] + ["ab" * 3000, "it's I'm we'll  <|endoftext|> 12345", "𝄞" * 200]


def test_ids_equal_the_library(tik):
    coder, library = tik
    texts = odd_texts()
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


def test_all_code_points(tik):
    coder, library = tik
    points = [chr(c) for c in [*range(0x3000), *range(0x3000, 0x110000, 61)] if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}1{c}!{c} " for c in points[i : i + 500]) for i in range(0, len(points), 500)]
    assert [x.tolist() for x in coder.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_long_pieces_and_slices(tik, monkeypatch):
    coder, library = tik
    r = random.Random(3)
    for n in (2, 9, 100, 400):
        piece = bytes(r.choice(b"abcde \xc3\xa9") for _ in range(n))
        assert coder.merge_long(piece) == coder.merge_rows([piece])[0]
    monkeypatch.setattr(byte_bpe, "GROUP_CHARS", 100)
    monkeypatch.setattr(byte_bpe, "SLICE", 7)
    small = byte_bpe.ByteBpe(tokenizer_path(byte_bpe.VOCABULARY), most=50)  # the store starts afresh again and again
    texts = odd_texts()
    assert [x.tolist() for x in small.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_pair_table_against_a_dictionary():
    rng = np.random.default_rng(0)
    pairs = {(int(a), int(b)): i for i, (a, b) in enumerate(rng.integers(0, 300, (5000, 2)).tolist())}
    left, right = np.array(list(pairs)).T
    table = byte_bpe.PairTable(left, right, np.array(list(pairs.values())))
    a, b = rng.integers(-1, 300, (2, 40, 500))
    want = [pairs.get((x, y), byte_bpe.NONE) for x, y in zip(a.ravel().tolist(), b.ravel().tolist(), strict=True)]
    assert table(a, b).ravel().tolist() == want


def test_encode_and_decode_frames(spark, tik):
    _, library = tik
    rows = [(1, "two words", "a", "k"), (1, "two words", "b", None), (None, None, None, "k"), (2, "", "", ""), (3, "ünï " * 20_000, "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded string")
    for key in ("doc_id", "ids"):
        both = byte_bpe.round_trip(docs, key=key)
        assert both.columns == [key, "ids", "decoded"] or key == "ids"
    got = sorted((tuple(r) for r in byte_bpe.round_trip(docs).collect()), key=repr)
    want = sorted([(i, library.encode_ordinary(t or ""), bytearray((t or "").encode())) for i, t, *_ in rows], key=repr)
    assert got == want
    coded = byte_bpe.encode(docs)
    back = sorted((tuple(r) for r in byte_bpe.decode(coded).collect()), key=repr)
    assert back == sorted([(i, d) for i, _, d in want], key=repr)
    assert byte_bpe.round_trip(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, None), (2, []), (3, [15496])], "doc_id int, ids array<int>")
    assert {r.doc_id: r.decoded for r in byte_bpe.decode(odd).collect()} == {1: None, 2: b"", 3: b"Hello"}
    for ids in ([60_000], [-1], [None]):
        with pytest.raises(Exception, match="an id is not in the vocabulary|a null among the ids"):
            byte_bpe.decode(spark.createDataFrame([(1, ids)], "doc_id int, ids array<int>")).collect()


def test_digest_query(spark, tik):
    from factorloom.llm.queries import op13_byte_bpe

    _, library = tik
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op13_byte_bpe(spark, sf).collect():
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def neighbours_of(spark, rows: list[tuple]) -> list[tuple]:
    from factorloom.llm import neighbours

    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, row int, id int")
    return sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in neighbours.search(frame).collect())


def test_neighbours_keep_rows_of_one_key(spark):
    assert neighbours_of(spark, [(50, [1.0, 0.0], 0, 0), (7, [0.0, 1.0], 0, 0), (7, [1.0, 0.01], 0, 0)]) == [(50, 1, 7, 0.999950004), (50, 2, 7, 0.0)]
    twice = neighbours_of(spark, [(50, [1.0, 0.0], 0, 0), (50, [1.0, 1.0], 0, 0)])
    assert twice == [(50, 1, 50, 0.707106781), (50, 1, 50, 0.707106781)]


def test_neighbours_of_every_number_of_components(spark):
    rows = [(i, [1.0, float(i)], 0, 0) for i in range(1, 9)] + [(100, [3.0, 1.0, 2.0], 0, 0), (101, [3.0, 1.0, 2.1], 0, 0)]
    got = neighbours_of(spark, rows)
    assert [r[:3] for r in got] == [(100, 1, 101)]


def test_neighbours_of_extreme_sizes(spark):
    rows = [(50, [1e200, 1e200], 0, 0), (7, [1e-200, 1e-200], 0, 0), (8, [1e-320, 0.0], 0, 0), (9, [-1e300, 1e300], 0, 0), (10, [0.0, 0.0], 0, 0), (11, [float("nan"), 1.0], 0, 0)]
    assert neighbours_of(spark, rows) == [(50, 1, 7, 1.0), (50, 2, 8, 0.707106781), (50, 3, 9, 0.0)]


def test_lines_of_rows_without_key(spark):
    from factorloom.llm import line_dedup

    rows = [(None, f"shared\nown {i}") for i in range(12)]
    out = line_dedup.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=10).collect()
    assert sorted(r.kept_text for r in out) == sorted(f"own {i}" for i in range(12)) and {r.n_dropped for r in out} == {1}
    few = line_dedup.without_repeated_lines(spark.createDataFrame(rows[:9], "doc_id long, text string"), min_docs=10).collect()
    assert {r.n_dropped for r in few} == {0}


def test_mix_of_repeated_and_missing_keys(spark):
    from pyspark.sql import functions as F

    from factorloom.llm import mixing

    r = random.Random(12)
    rows = [(None if i % 5 == 0 else i // 2, " ".join(["w"] * r.randint(1, 400) + [str(i)]), f"s{i % 3}", i) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    plan = {(x.source_size, x.target): x.taken for x in mixing.plan_mix(docs).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()}
    mixed = mixing.mix(docs).groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("words")).collect()
    assert sorted(x.words for x in mixed) == sorted(plan.values())
    for (_, target), taken in plan.items():
        assert abs(taken - target) <= 401
    # rows without a key draw numbers of their own: some are taken, some are not, whatever their size
    none = mixing.plan_mix(docs).where("doc_id is null and source_size > target / 1.9").groupBy("copies").count().collect()
    assert len(none) > 1
