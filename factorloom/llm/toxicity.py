"""Toxicity by a bidirectional gated recurrent network with attention over character and word inputs."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gru

HIDDEN, ATTENTION, EMBED = 8, 8, 4
WORD_BUCKETS, GRAM_BUCKETS = 1 << 15, 1 << 17
WIDTH, STRIDE = 64, 48
INPUT = 3 + 2 * EMBED
EDGE = b".,;:!?\"'`()[]{}<>*&%$#@-_~/\\|+="
#: Bound of the sample of labelled rows that the network is fitted on: so many of each class.
MOST_TOXIC, MOST_CLEAN = 800, 1600
#: Words whose characters are worked on at once.
SLICE = 20_000
#: Parts of the sample for signs from other texts.
PARTS = 3
SHUT = 60.0  # an update gate that lets a state pass unchanged


def gram_buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 3- to 5-grams of bytes of each word with its ends marked, and where each word's begin."""
    if len(words) > SLICE:
        parts = [gram_buckets(words[a : a + SLICE]) for a in range(0, len(words), SLICE)]
        sizes = np.concatenate([np.diff(starts) for _, starts in parts])
        return np.concatenate([flat for flat, _ in parts]), np.concatenate(([0], np.cumsum(sizes)))
    marked = [b"^" + w + b"$" for w in words]
    raw = np.frombuffer(b"".join(marked), dtype=np.uint8).astype(np.uint64)
    of = np.repeat(np.arange(len(words)), [len(m) for m in marked])
    buckets, owner = [], []
    rolling = raw.copy()
    for n in range(2, 6):
        if len(raw) < n:
            break
        rolling = rolling[: len(raw) - n + 1] * np.uint64(1000003) + raw[n - 1 :]
        if n < 3:
            continue
        inside = of[: len(rolling)] == of[n - 1 :]
        mixed = (rolling[inside] ^ np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
        buckets.append((mixed >> np.uint64(47)).astype(np.int32))
        owner.append(of[: len(rolling)][inside])
    if not buckets:
        return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
    flat, who = np.concatenate(buckets), np.concatenate(owner)
    order = np.argsort(who, kind="stable")
    return flat[order], np.searchsorted(who[order], np.arange(len(words) + 1))


def word_buckets(words: list[bytes]) -> np.ndarray:
    return np.fromiter((zlib.crc32(w) & (WORD_BUCKETS - 1) for w in words), dtype=np.int32, count=len(words))


def core(word: bytes) -> bytes:
    return word.strip(EDGE)


def _mean(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Means of runs of rows; zero for empty runs."""
    sums = np.zeros((len(starts) - 1, *values.shape[1:]), dtype=np.float64)
    full = np.flatnonzero(np.diff(starts))
    if len(full):
        sums[full] = np.add.reduceat(values, starts[full], axis=0)
    return (sums.T / np.maximum(1, np.diff(starts))).T


@dataclass
class Network:
    """Weights. ``word_sign`` and ``gram_sign`` are the log odds of toxic documents for each bucket."""

    word_sign: np.ndarray
    gram_sign: np.ndarray
    word_vec: np.ndarray
    gram_vec: np.ndarray
    p: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fresh(seed: int = 1) -> Network:
        rng = np.random.default_rng(seed)
        net = Network(
            np.zeros(WORD_BUCKETS, np.float32),
            np.zeros(GRAM_BUCKETS, np.float32),
            rng.normal(0, 0.05, (WORD_BUCKETS, EMBED)).astype(np.float32),
            rng.normal(0, 0.05, (GRAM_BUCKETS, EMBED)).astype(np.float32),
        )
        for d in "fb":
            w = rng.normal(0, 0.2, (3 * HIDDEN, INPUT)).astype(np.float32)
            net.p |= {f"W{d}": w, f"b{d}": np.zeros((3 * HIDDEN, 1), np.float32), f"U{d}": gru.init_cell(rng, HIDDEN)["U"]}
        net.p |= {
            "A": rng.normal(0, 0.3, (ATTENTION, 2 * HIDDEN)).astype(np.float32),
            "a": np.zeros((ATTENTION, 1), np.float32),
            "v": rng.normal(0, 0.3, (1, ATTENTION)).astype(np.float32),
            "o": rng.normal(0, 0.3, (1, 2 * HIDDEN)).astype(np.float32),
            "c": np.full((1, 1), -1.0, np.float32),
        }
        return net

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, tuple]:
        """(words, INPUT), and the buckets behind it: from the word as a whole and from its characters."""
        if len(words) > SLICE:
            parts = [self.inputs(words[a : a + SLICE])[0] for a in range(0, len(words), SLICE)]
            return np.concatenate(parts), ()
        cores = [core(w) for w in words]
        wb = word_buckets(cores)
        flat, starts = gram_buckets(cores)
        x = np.empty((len(words), INPUT), dtype=np.float32)
        x[:, 0] = self.word_sign[wb]
        signs = self.gram_sign[flat]
        x[:, 1] = _mean(signs, starts)
        full = np.flatnonzero(np.diff(starts))
        x[:, 2] = 0
        if len(full):
            x[full, 2] = np.maximum.reduceat(signs, starts[full])
        x[:, 3 : 3 + EMBED] = self.word_vec[wb]
        x[:, 3 + EMBED :] = _mean(self.gram_vec[flat], starts)
        return x, (wb, flat, starts)

    def pool(self, states: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Logits (B,) of windows from states (T, 2H, B), by attention over the places that are there (T, B)."""
        p = self.p
        u = np.tanh(np.einsum("ah,thb->tab", p["A"], states) + p["a"])
        e = np.einsum("a,tab->tb", p["v"][0], u)
        e = np.where(there, e, -1e9)
        w = np.exp(e - e.max(axis=0))
        w /= w.sum(axis=0)
        pooled = np.einsum("tb,thb->hb", w, states)
        return (p["o"] @ pooled + p["c"])[0], (u, w, pooled)


def _both(net: Network, xf: np.ndarray, xb: np.ndarray) -> tuple[np.ndarray, list, list]:
    zero = np.zeros((HIDDEN, xf.shape[2]), dtype=np.float32)
    hf, cf = gru.forward(net.p["Uf"], xf, zero)
    hb, cb = gru.forward(net.p["Ub"], xb[::-1], zero)
    return np.concatenate((hf, hb[::-1]), axis=1), cf, cb


def loss_and_gradients(net: Network, x: np.ndarray, places: np.ndarray, there: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
    """Mean cross-entropy of windows, gradients by the weights, and by the inputs x (words, INPUT).

    places (T, B): the row of x at each place; there (T, B): whether a word stands there.
    """
    p = net.p
    T, B = places.shape
    seen = np.ascontiguousarray(x[places].transpose(0, 2, 1))
    xf = np.einsum("gd,tdb->tgb", p["Wf"], seen) + p["bf"]
    xb = np.einsum("gd,tdb->tgb", p["Wb"], seen) + p["bb"]
    for gates in (xf, xb):
        gates[:, :HIDDEN] += np.where(there, 0, SHUT)[:, None, :]
    states, cf, cb = _both(net, xf, xb)
    logit, (u, w, pooled) = net.pool(states, there)
    prob = 1 / (1 + np.exp(-logit))
    loss = float(-np.mean(y * np.log(prob + 1e-9) + (1 - y) * np.log(1 - prob + 1e-9)))
    d = ((prob - y) / B).astype(states.dtype)
    g: dict[str, np.ndarray] = {"o": (pooled @ d)[None], "c": np.array([[d.sum()]], dtype=states.dtype)}
    d_pooled = p["o"].T * d
    d_states = w[:, None, :] * d_pooled
    d_w = np.einsum("hb,thb->tb", d_pooled, states)
    d_e = w * (d_w - (w * d_w).sum(axis=0))
    g["v"] = np.einsum("tb,tab->a", d_e, u)[None]
    d_u = d_e[:, None, :] * p["v"][0][:, None] * (1 - u * u)
    g["A"] = np.einsum("tab,thb->ah", d_u, states)
    g["a"] = d_u.sum(axis=(0, 2))[:, None]
    d_states = d_states + np.einsum("ah,tab->thb", p["A"], d_u)
    d_xf, g["Uf"] = gru.backward(p["Uf"], cf, d_states[:, :HIDDEN])
    d_xb, g["Ub"] = gru.backward(p["Ub"], cb, d_states[::-1, HIDDEN:])
    d_xb = d_xb[::-1]
    d_seen = np.zeros_like(seen)
    for k, d_gate in (("f", d_xf), ("b", d_xb)):
        g[f"W{k}"] = np.einsum("tgb,tdb->gd", d_gate, seen)
        g[f"b{k}"] = d_gate.sum(axis=(0, 2))[:, None]
        d_seen += np.einsum("gd,tgb->tdb", p[f"W{k}"], d_gate)
    d_x = np.zeros_like(x)
    np.add.at(d_x, places.ravel(), d_seen.transpose(0, 2, 1).reshape(T * B, -1))
    return loss, g, d_x


def windows(n: int) -> list[tuple[int, int]]:
    """Spans of words of all windows of a text; each begins STRIDE after the one before, the last one ends at the end."""
    if n <= WIDTH:
        return [(0, n)]
    starts = list(range(0, n - WIDTH, STRIDE)) + [n - WIDTH]
    return [(s, s + WIDTH) for s in starts]


def _log_odds(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Shrunk to zero where little was seen."""
    odds = np.log((toxic + 0.5) / (toxic.sum() + 1)) - np.log((clean + 0.5) / (clean.sum() + 1))
    seen = np.where(odds > 0, toxic, clean)
    return (odds * seen / (seen + 4)).astype(np.float32)


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 1, steps: int = 180, batch: int = 96) -> Network | None:
    """A network for texts (lower case, UTF-8) and their labels; None if one class is missing.

    A label holds for the whole text, so each toxic text gives the window with the strongest signs,
    and each clean one its strongest and a random one. While the network learns, the signs of a text
    come from the texts of the other ``PARTS`` parts, as they will for texts it has not seen.
    """
    labels = np.asarray(labels, dtype=np.float32)
    if not len(labels) or labels.min() == labels.max():
        return None
    net = Network.fresh(seed)
    rng = np.random.default_rng(seed)
    index: dict[bytes, int] = {}
    docs = [np.array([index.setdefault(w, len(index)) for w in t.split()], dtype=np.int64) for t in texts]
    words = list(index) or [b""]
    cores = [core(w) for w in words]
    wb = word_buckets(cores)
    flat, starts = gram_buckets(cores)
    each = np.repeat(np.arange(len(words), dtype=np.int32), np.diff(starts))
    part = np.zeros(len(docs), dtype=np.int64)
    for y in (0, 1):
        own = np.flatnonzero(labels == y)
        part[own] = np.arange(len(own)) * PARTS // len(own)
    counts = np.zeros((PARTS, 2, len(words)), dtype=np.float32)
    for d, y, k in zip(docs, labels, part.tolist(), strict=True):
        counts[k, int(y)][np.unique(d)] += 1

    def signs(seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        by_word = [np.bincount(wb, weights=seen[y], minlength=WORD_BUCKETS) for y in (1, 0)]
        by_gram = [np.bincount(flat, weights=seen[y][each], minlength=GRAM_BUCKETS) for y in (1, 0)]
        return _log_odds(*by_word), _log_odds(*by_gram)

    total = counts.sum(axis=0)
    others = [signs(total - counts[k]) for k in range(PARTS)]
    pools: list[tuple[list, list]] = [([], []) for _ in range(PARTS)]
    for k in range(PARTS):
        net.word_sign, net.gram_sign = others[k]
        x, _ = net.inputs(words)
        strength = np.maximum(x[:, 0], x[:, 2])
        for i in np.flatnonzero(part == k).tolist():
            d, y = docs[i], int(labels[i])
            spans = windows(len(d))
            best = max(range(len(spans)), key=lambda j: float(strength[d[slice(*spans[j])]].max(initial=0)))
            pools[k][y].append(d[slice(*spans[best])])
            if not y:
                pools[k][0].append(d[slice(*spans[int(rng.integers(len(spans)))])])
    usable = [k for k in range(PARTS) if pools[k][0] and pools[k][1]]
    optimiser = gru.Adam(net.p, 0.02)
    for at in range(steps if usable else 0):
        optimiser.rate = 0.02 * (1 - at / steps) + 0.001
        k = usable[at % len(usable)]
        net.word_sign, net.gram_sign = others[k]
        third = batch // 3
        chosen = [pools[k][1][i] for i in rng.integers(len(pools[k][1]), size=third)] + [pools[k][0][i] for i in rng.integers(len(pools[k][0]), size=batch - third)]
        y = np.array([1.0] * third + [0.0] * (batch - third), dtype=np.float32)
        used, places = np.unique(np.concatenate([*chosen, np.zeros(1, np.int64)]), return_inverse=True)
        grid = np.zeros((WIDTH, batch), dtype=np.int64)
        there = np.zeros((WIDTH, batch), dtype=bool)
        n = 0
        for b, c in enumerate(chosen):
            grid[: len(c), b] = places[n : n + len(c)]
            there[: max(1, len(c)), b] = True
            n += len(c)
        x, (w_used, g_used, s_used) = net.inputs([words[i] for i in used])
        _, g, d_x = loss_and_gradients(net, x, grid, there, y)
        optimiser.update(g)
        step = 0.05
        np.add.at(net.word_vec, w_used, -step * d_x[:, 3 : 3 + EMBED])
        owner = np.repeat(np.arange(len(used)), np.diff(s_used))
        np.add.at(net.gram_vec, g_used, -step * (d_x[:, 3 + EMBED :] / np.maximum(1, np.diff(s_used))[:, None])[owner])
    net.word_sign, net.gram_sign = signs(total)
    return net


class Scorer:
    """Scores of texts, with the input part of the gates kept for each word seen (``most`` words at most)."""

    def __init__(self, net: Network, most: int = 150_000, columns: int = 2048) -> None:
        self.net, self.most, self.columns = net, most, columns
        self.reset()

    def reset(self) -> None:
        class Index(dict):
            def __missing__(inner, word: bytes) -> int:
                inner[word] = n = len(inner) + 1
                self.fresh.append(word)
                return n

        self.index, self.fresh = Index(), []
        shut = np.zeros((1, 3 * HIDDEN), dtype=np.float32)
        shut[:, :HIDDEN] = SHUT
        self.table = {d: np.repeat(shut, 1024, axis=0) for d in "fb"}  # row 0: no word

    def learn(self) -> None:
        n = len(self.index) + 1
        for d in "fb":
            if n > len(self.table[d]):
                more = np.zeros((max(n, 2 * len(self.table[d])), 3 * HIDDEN), dtype=np.float32)
                more[: len(self.table[d])] = self.table[d]
                self.table[d] = more
        for a in range(0, len(self.fresh), SLICE):
            part = self.fresh[a : a + SLICE]
            x, _ = self.net.inputs(part)
            first = n - len(self.fresh) + a
            for d in "fb":
                self.table[d][first : first + len(part)] = x @ self.net.p[f"W{d}"].T + self.net.p[f"b{d}"].T
        self.fresh.clear()

    def score(self, texts: list[bytes]) -> np.ndarray:
        """For each text the largest probability of its windows."""
        if len(self.index) > self.most:
            self.reset()
        look = self.index.__getitem__
        best = np.zeros(len(texts))
        spans: list[np.ndarray] = []
        owner: list[int] = []
        for i, t in enumerate(texts):
            words = t.lower().split()
            ids = np.fromiter(map(look, words), dtype=np.int32, count=len(words))
            for a, b in windows(len(ids)):
                spans.append(ids[a:b])
                owner.append(i)
        self.learn()
        # windows of one length go together, so few places are empty
        order = sorted(range(len(spans)), key=lambda j: len(spans[j]))
        for a in range(0, len(order), self.columns):
            part = order[a : a + self.columns]
            longest = max(1, len(spans[part[-1]]))
            places = np.zeros((longest, len(part)), dtype=np.int32)
            for b, j in enumerate(part):
                places[: len(spans[j]), b] = spans[j]
            np.maximum.at(best, [owner[j] for j in part], self.windows(places))
        return best

    def windows(self, places: np.ndarray) -> np.ndarray:
        T, B = places.shape
        there = places > 0
        there[0] = True
        states = np.empty((T, 2 * HIDDEN, B), dtype=np.float32)
        for d, half, times in (("f", slice(0, HIDDEN), range(T)), ("b", slice(HIDDEN, 2 * HIDDEN), range(T - 1, -1, -1))):
            h = np.zeros((HIDDEN, B), dtype=np.float32)
            U, table = self.net.p[f"U{d}"], self.table[d]
            for t in times:
                h = gru.step(U, np.ascontiguousarray(table[places[t]].T), h)
                states[t, half] = h
        p = self.net.p
        flat = states.transpose(1, 0, 2).reshape(2 * HIDDEN, T * B)
        u = p["A"] @ flat
        u += p["a"]
        np.tanh(u, out=u)
        e = (p["v"] @ u).reshape(T, B)
        e[~there] = -1e9
        e -= e.max(axis=0)
        np.exp(e, out=e)
        e /= e.sum(axis=0)
        voice = (p["o"] @ flat).reshape(T, B)
        return 1 / (1 + np.exp(-((e * voice).sum(axis=0) + p["c"][0, 0]).astype(np.float64)))


def fold(key: Column, folds: int) -> Column:
    """crc32 of the key's text (null: empty text) modulo ``folds``."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", folds: int = 4, held: int = 2, most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> Network | None:
    """Fit on a bounded sample of the labelled rows outside the held-out fold.

    The sample is the ``most_toxic`` and ``most_clean`` rows with the smallest md5 of their keys, so it
    does not depend on partitions. Only whether a row is toxic is learnt; of several labels for a key
    the larger counts, null labels and keys count for nothing.
    """
    ours = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & (fold(F.col(key), folds) != held))
    ours = ours.groupBy(F.col(key).alias("k")).agg(F.max(F.col(label).cast("int")).alias("y"))
    place = F.md5(F.concat(F.lit("fit:"), F.col("k").cast("string")).cast("binary"))
    chosen = ours.where("y = 1").orderBy(place, "k").limit(most_toxic).unionByName(ours.where("y = 0").orderBy(place, "k").limit(most_clean))
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k").groupBy("k", "y").agg(F.max("t").alias("t"))
    sample = sorted(rows.collect(), key=lambda r: r["k"])
    return fit([(r["t"] or "").encode().lower() for r in sample], np.array([r["y"] for r in sample]))


def score(docs: DataFrame, net: Network | None, text: str = "text", extra: list[str] | None = None) -> DataFrame:
    """``docs`` columns named in ``extra`` (default: all; one named score gives way) and ``score``: the largest probability of all windows of the text.

    Whole texts are read, in windows of 64 words, each 48 words after the one before. Null and empty
    texts are a window without words. Without a network (no labelled rows of both classes) every score
    is 0. Rows are scored one by one, so repeated rows, null keys and empty tables are no special case.
    """
    spark = docs.sparkSession
    names = [c for c in (docs.columns if extra is None else extra) if c.lower() != "score"]
    if net is None:
        return docs.select(*[docs[c] for c in names], F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(net)
    columns = [docs[c].alias(f"c{i}") for i, c in enumerate(names)]
    rows = docs.select(*columns, docs[text].cast("binary").alias("raw"))
    carried = [f for f in rows.schema.fields if f.name != "raw"]
    from pyspark.sql.types import DoubleType, StructField, StructType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                texts = [r or b"" for r in part.column("raw").to_pylist()]
                got = pa.array(scorer.score(texts), pa.float64())
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in carried], got], names=[*[f.name for f in carried], "score"])

    done = rows.mapInArrow(run, StructType([*carried, StructField("score", DoubleType())]))
    return done.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "score")


def keep_clean(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``threshold``."""
    net = train(docs, labels, text, key)
    names = docs.columns
    moved = docs.toDF(*[f"c{i}" for i in range(len(names))])
    kept = score(moved, net, f"c{names.index(text)}").where(F.col("score") < threshold).drop("score")
    return kept.toDF(*names)
