from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash
import pytest

from factorloom.llm import chunks, gru, language_model, neighbours, packing, token_counts, tokens, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, key int, Score double"
STRANGE = [None, "", " \n\t", "One two. Three!", "don't DON'T 3.14 $5 it's", "naïve ÀÉß ÿ Ÿ İstanbul Σίσυφος", "x²y ½ 中文 é ﬁ a b", "ab<|endoftext|>c", "tab\x7fmark", "word " * 30_000, "z" * 5000]


def frame(spark, texts):
    return spark.createDataFrame([(i if i else None, t, 1, 0.5) for i, t in enumerate(texts)], DOCS)


def test_word_coder_is_the_tokenizer():
    coder = tokens.WordCoder(tokens.tokenizer_path("word_bpe_49k.json"), most=50)
    for text in STRANGE:
        want = coder.tokenizer.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(coder.encode((text or "").encode()), dtype="<u4").tolist() == want


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections(spark, rule):
    rng = random.Random(4)
    texts = STRANGE + ["\n".join("ab cd"[: rng.randint(0, 5)] * rng.randint(0, 3) + " " * rng.randint(0, 3) for _ in range(8)) for _ in range(15)] + ["\n\n\n\n  \n", "é\n\n中\n"]
    docs = frame(spark, texts)
    got = defaultdict(list)
    for r in token_counts.section_tokens(docs, rule=rule).collect():
        got[r.doc_id].append(r)
    coder = tokens.byte_coder(tokens.tokenizer_path("byte_bpe_50k.tiktoken"))
    for i, text in enumerate(texts):
        text = text or ""
        rows = sorted(got[i or None], key=lambda r: r.section)
        parts = text.split("\n")
        sections = [p + "\n" for p in parts[:-1]] + [parts[-1]]
        assert [text[r.start : r.start + r.length] for r in rows] == sections
        owner = [k for k, s in enumerate(sections) for _ in s.encode()]
        want, crossing, at = [0.0] * len(sections), [0] * len(sections), 0
        for end in coder.ends(text).tolist():
            held = Counter(owner[at:end])
            if rule == "share":
                for k, n in held.items():
                    want[k] += n / (end - at)
            else:
                want[{"first": owner[at], "last": owner[end - 1], "largest": min(held, key=lambda k: (-held[k], k))}[rule]] += 1
            if len(held) > 1:
                for k in held:
                    crossing[k] += 1
            at = end
        assert np.allclose([r.tokens for r in rows], want) and [r.crossing for r in rows] == crossing
    assert token_counts.section_tokens(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        token_counts.section_tokens(docs, rule="none")


def cost(places, price, cuts, width, costs):
    at = {p: c for p, c in zip(places.tolist(), price.tolist(), strict=True)}
    pad = lambda n: 0 if n & (n - 1) == 0 else width - n
    return sum(at[b] + costs.sequence + pad(b - a) for a, b in zip(cuts, cuts[1:], strict=False))


def test_cuts_are_optimal():
    rng = np.random.default_rng(2)
    costs = packing.Costs(sentence=2.5, inside=9.0, stride=6, sequence=3.0)
    for _ in range(60):
        width = 16
        doc_ends = np.cumsum(rng.integers(1, 30, size=rng.integers(1, 6)))
        sentence_ends = np.unique(rng.integers(1, doc_ends[-1] + 1, size=rng.integers(1, 12)))
        places, price = packing.cut_places(doc_ends, sentence_ends, costs)
        cuts = packing.best_cuts(places, price, width, costs)
        assert cuts[0] == 0 and cuts[-1] == doc_ends[-1] and max(np.diff(cuts)) <= width
        best = [0.0] + [math.inf] * (len(places) - 1)
        for j in range(1, len(places)):
            for i in range(j):
                n = int(places[j] - places[i])
                if n <= width:
                    best[j] = min(best[j], best[i] + price[j] + costs.sequence + (0 if n & (n - 1) == 0 else width - n))
        assert math.isclose(cost(places, price, cuts, width, costs), best[-1])


def test_pack_round_trip(spark):
    texts = STRANGE + [f"Sentence {i}. " * (i % 50) for i in range(120)]
    docs = frame(spark, texts).repartition(3)
    rows = packing.pack(docs, width=64, block=4).collect()
    coder = tokens.word_coder(tokens.tokenizer_path("word_bpe_49k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for i, text in enumerate(texts):
        pieces = sorted(by_doc[i or None], key=lambda r: r.start)
        assert b"".join(p.ids for p in pieces) == coder.encode((text or "").encode()) + b"\1\0\0\0"
        assert [p.start for p in pieces] == [0, *np.cumsum([p.length for p in pieces])[:-1].tolist()]
        assert {p.doc_tokens for p in pieces} == {sum(p.length for p in pieces)}
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == [0, *np.cumsum([p.length for p in pieces])[:-1].tolist()]
        assert {p.sequence_tokens for p in pieces} == {sum(p.length for p in pieces)} and pieces[0].sequence_tokens <= 64
    assert packing.pack(docs.limit(0)).collect() == []


def numeric(f, a, at, eps=1e-5):
    old = a[at]
    a[at] = old + eps
    up = f()
    a[at] = old - eps
    down = f()
    a[at] = old
    return (up - down) / (2 * eps)


def test_toxicity_gradients():
    rng = np.random.default_rng(0)
    net = toxicity.Network.fresh()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.normal(size=(9, toxicity.INPUT))
    places = rng.integers(0, 9, size=(6, 4))
    there = np.ones((6, 4), bool)
    there[4:, 1] = False
    y = np.array([1.0, 0, 1, 0])
    f = lambda: toxicity.loss_and_gradients(net, x, places, there, y)[0]
    _, g, d_x = toxicity.loss_and_gradients(net, x, places, there, y)
    # states are kept in the type of the zero state, so the comparison is loose
    for k, a in net.p.items():
        at = tuple(rng.integers(0, n) for n in a.shape)
        assert abs(numeric(f, a, at, 1e-3) - g[k][at]) < 2e-3, k
    assert abs(numeric(f, x, (2, 0), 1e-3) - d_x[2, 0]) < 2e-3


def test_toxicity_held_out(spark):
    rng = random.Random(1)
    plain, bad = [f"w{i}" for i in range(300)], ["awful", "nasty", "vile"]
    rows = []
    for i in range(400):
        words = [rng.choice(plain) for _ in range(rng.choice([5, 40, 200]))]
        if i % 4 == 0:
            for _ in range(2):
                words.insert(rng.randrange(len(words) + 1), rng.choice(bad) + rng.choice(["", ",", "."]))
        rows.append((i, " ".join(words), 1, 0.5))
    rows += [(9000, None, 1, 0.5), (9001, "", 1, 0.5), (None, "w1 vile nasty", 1, None), (9002, "w2 " * 20_000 + "awful vile", 1, 0.5)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    net = toxicity.train(docs, labels)
    scored = toxicity.score(docs, net, extra=["doc_id"]).collect()
    got = {r.doc_id: r.score for r in scored}
    assert len(scored) == len(rows) and all(0 <= s <= 1 for s in got.values())
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((got[i] >= 0.3) == (i % 4 == 0) for i in held)
    assert right / len(held) >= 0.95
    assert got[9002] >= 0.3 and got[None] >= 0.3 and got[9000] < 0.3 and got[9001] == got[9000]
    kept = toxicity.keep_clean(docs, labels)
    assert kept.columns == docs.columns and 9002 not in {r.doc_id for r in kept.collect()}
    assert toxicity.train(docs, labels.limit(0)) is None
    assert {r.score for r in toxicity.score(docs, None).select("doc_id", "text", "key", toxicity.F.lit(0.0).alias("score")).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), net, extra=["doc_id"]).collect() == []


def test_windows_cover_texts():
    for n in (0, 1, 63, 64, 65, 112, 113, 1000):
        spans = toxicity.windows(n)
        assert spans[0][0] == 0 and spans[-1][1] == n and all(b - a <= toxicity.WIDTH for a, b in spans)
        assert all(b <= p + toxicity.STRIDE and b < q for (p, q), (b, _) in zip(spans, spans[1:], strict=False))


def corpus_of(words, counts):
    c = language_model.Corpus.__new__(language_model.Corpus)
    c.n, c.v = sum(counts), len(counts)
    k = min(len(words), language_model.VOCABULARY)
    c.words, c.counts = np.array(words[:k], dtype=np.uint64), np.array(counts[:k])
    order = np.argsort(c.words)
    c.sorted_words, c.sorted_ids = c.words[order], order
    return c


def test_language_model_gradients():
    rng = np.random.default_rng(0)
    net = language_model.Network(corpus_of([5, 9, 7, 1, 3], [9, 7, 5, 3, 2]), hidden=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    T, S = 5, 3
    target, previous = rng.integers(0, 6, (T, S)), rng.integers(0, 7, (T, S))
    keep = (rng.random((T, S)) > 0.3).astype(float)
    weight, h = np.ones((T, S)), rng.normal(size=(4, S))
    weight[4, 1] = 0
    f = lambda: net.gradients(previous, target, keep, weight, h)[0]
    _, g, _ = net.gradients(previous, target, keep, weight, h)
    for k, a in net.p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in a.shape)
            if k in ("O", "o") and not net.real[at[0]]:
                continue
            assert abs(numeric(f, a, at) - g[k][at]) < 1e-4, k


def test_language_model_is_a_distribution():
    net = language_model.Network(corpus_of([5, 9, 7, 1, 3], [9, 7, 5, 3, 2]), hidden=4)
    h = np.random.default_rng(1).normal(size=(4, 1)).astype(np.float32)
    total = sum(math.exp(net.output(h, np.array([w]))[0][0]) for w in range(6))
    assert math.isclose(total, 1, rel_tol=1e-4)


def test_scorer_is_the_plain_forward_pass():
    """Every overlapping window, one step of one window at a time."""
    rng = np.random.default_rng(4)
    net = toxicity.Network.fresh()
    net.word_sign, net.gram_sign = rng.normal(size=len(net.word_sign)).astype(np.float32), rng.normal(size=len(net.gram_sign)).astype(np.float32)
    texts = ["", "one", "some, WORDS here!", " ".join(f"w{rng.integers(0, 99)}" for _ in range(200)), " ".join(f"v{i}" for i in range(64))]
    got = toxicity.Scorer(net, columns=3).score([t.encode() for t in texts])
    p = net.p
    for text, score in zip(texts, got, strict=True):
        words = [w.encode() for w in text.lower().split()]
        best = 0.0
        for a, b in toxicity.windows(len(words)):
            states = {}
            for d in "fb":
                h = np.zeros((toxicity.HIDDEN, 1), np.float32)
                places = range(a, b) if d == "f" else range(b - 1, a - 1, -1)
                for t in places:
                    x, _ = net.inputs([words[t]])
                    h = gru.step(p[f"U{d}"], (p[f"W{d}"] @ x.T + p[f"b{d}"]), h)
                    states[d, t] = h
            both = [np.concatenate((states["f", t], states["b", t])) for t in range(a, b)] or [np.zeros((2 * toxicity.HIDDEN, 1), np.float32)]
            e = np.array([float((p["v"] @ np.tanh(p["A"] @ x + p["a"]))[0, 0]) for x in both])
            w = np.exp(e - e.max()) / np.exp(e - e.max()).sum()
            logit = sum(k * float((p["o"] @ x)[0, 0]) for k, x in zip(w, both, strict=True)) + float(p["c"][0, 0])
            best = max(best, 1 / (1 + math.exp(-logit)))
        assert math.isclose(score, best, rel_tol=1e-4), text


def test_language_model_places_every_document_once():
    texts = [f"a{i} b{i % 7} c" for i in range(2000)]
    def placing(order, size):
        found = {}
        for a in range(0, len(order), size):
            ids = [i if i % 50 else None for i in order[a : a + size]]
            lengths, codes, words = chunks.encode(ids, [texts[i].encode() for i in order[a : a + size]], end=True)
            c = chunks.Chunk(a, ids, [None] * len(ids), lengths, codes, words)
            for i, *at in zip(order[a : a + size], *language_model.placed(c, np.arange(len(ids)), 5), strict=True):
                found[i] = tuple(int(x) for x in at)
        return found
    one, two = placing(list(range(2000)), 300), placing(list(range(1999, -1, -1)), 77)
    assert one == two and len(one) == 2000
    turns, shards = Counter(x[0] for x in one.values()), Counter(x[1] for x in one.values())
    assert set(turns) == set(range(language_model.ROUNDS)) and min(turns.values()) > 800 and min(shards.values()) > 300


def test_states_are_carried(spark):
    rng = np.random.default_rng(3)
    net = language_model.Network(corpus_of(list(range(1, 30)), list(range(60, 31, -1))), hidden=5)
    lengths = np.array([7, 1, 90, 40])
    words = rng.integers(0, 30, lengths.sum())
    got = net.score(words, lengths, block=50)
    for d, (a, b) in enumerate(zip(np.cumsum(lengths) - lengths, np.cumsum(lengths), strict=True)):
        h, previous, want = np.zeros((5, 1), np.float32), net.v + 1, 0.0
        for w in words[a:b]:
            h = gru.step(net.p["U"], net.p["X"][[previous]].T.copy(), h)
            want += net.output(h, np.array([w]))[0][0]
            previous = w
        assert math.isclose(got[d], want, rel_tol=1e-4)


def test_language_model_scores(spark, monkeypatch):
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 4000)
    rng = random.Random(2)
    tongues = [[f"{t}{i}" for i in range(60)] for t in "abc"]
    texts = [None, "", "  ", *[" ".join(rng.choice(tongues[i % 3]).title() for _ in range(rng.randint(1, 80))) for i in range(300)]]
    docs = frame(spark, texts).repartition(3)
    rows = {r.doc_id: r for r in language_model.score_documents(docs).collect()}
    token = {(i or None): [*WORD.findall((t or "").translate(LOWER)), None] for i, t in enumerate(texts)}
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    c = Counter(w for i, ws in token.items() if not out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in token.items():
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(i), len(ws), sum(w in c for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        assert r.score < 0
    # the same scores whatever the partitions and chunks
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 1500)
    monkeypatch.setattr(language_model, "SHARD_TOKENS", 1_000)
    want = {r.doc_id: r.score for r in language_model.score_documents(docs.repartition(2)).collect()}
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 9000)
    again = {r.doc_id: r.score for r in language_model.score_documents(docs.repartition(7)).collect()}
    assert all(math.isclose(want[i], again[i], rel_tol=1e-5) for i in want)
    # whole documents, a token at a time
    encoded = chunks.encode_chunks(docs, "text", "doc_id", end=True)
    corpus = language_model.Corpus(language_model.count_words(encoded, 7, 2, 4))
    net = language_model.train(encoded, corpus, 7, 2)
    other_n, other_v = corpus.other()
    for i in [*list(token)[:12], 100]:
        h, previous, total = np.zeros((language_model.HIDDEN, 1), np.float32), net.v + 1, 0.0
        for w in token[i]:
            word = chunks.END if w is None else w.encode()
            k = int(corpus.ids(np.array([xxhash.xxh3_64_intdigest(word)], dtype=np.uint64))[0])
            h = gru.step(net.p["U"], net.p["X"][[previous]].T.copy(), h)
            total += net.output(h, np.array([k]))[0][0] / math.log(10)
            if k == net.v:
                total += math.log10((c[w] + 1) / (other_n + other_v + 1))
            previous = k
        assert math.isclose(want[i], total, rel_tol=1e-4), i
    assert language_model.score_documents(docs.limit(0)).collect() == []


def test_language_model_repeats_and_long_texts(spark):
    long_text = " ".join(f"w{i % 900}" for i in range(60_000))
    rows = [(1, "a b c", 1), (1, "a b c", 1), (None, "a b c", 2), (None, None, 2), (3, long_text, 3), (4, "d e", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Score int").withColumns({c: toxicity.F.lit(1) for c in ("n_tokens", "key", "held_out", "chunk")})
    got = language_model.score_documents(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert {r.n_tokens for r in got if r.doc_id == 3} == {60_001} and len({r.score for r in got if r.doc_id == 1}) == 1


def test_neighbours(spark):
    rng = np.random.default_rng(6)
    data = rng.normal(size=(3000, 16))
    data[100:140] = data[50]
    rows = [(i, data[i].tolist(), 1) for i in range(3000)]
    rows += [(5000, None, 1), (5050, [0.0] * 16, 1), (5100, [float("nan")] * 16, 1), (5150, [None] * 16, 1), (5200, [1.0] * 3, 1), (None, [1.0] * 16, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = neighbours.search(frame, block=700, least=60, n_pivots=64, prefix=32, query_block=25).toPandas()
    want = neighbours.brute_force(np.arange(3000), data)
    assert len(got) == len(want) and sorted(got["rank"].unique()) == [1, 2, 3, 4, 5]
    both = got.merge(want, on=["query_id", "vec_id"])
    assert len(both) / len(want) >= 0.9 and np.abs(both.score_x - both.score_y).max() == 0
    hot = got[got.query_id == 50].sort_values("rank").vec_id.tolist()
    assert hot == [100, 101, 102, 103, 104]
    few = neighbours.search(frame.where("vec_id in (50, 7)")).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in few] == [(50, 1, 7)]
    assert neighbours.search(frame.limit(0)).collect() == []
