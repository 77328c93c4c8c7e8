"""Whole-document scores by word counts and by a gated recurrent language model."""

from __future__ import annotations

import copy
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru
from .chunks import Chunk, chunks_of, encode_chunks, pack_array, range_of, unpack_array
from .scratch import cut, lanes

HIDDEN = 16
#: Words that the network tells apart; the others are one class, inside which counts decide.
VOCABULARY = 1024
WINDOW, STREAMS = 32, 128
#: Each round of training reads its own part of the training documents; together they read all.
ROUNDS = 2
#: Tokens of a shard of a round, about; a copy of the network is trained on each shard.
SHARD_TOKENS = 1_000_000
RANGE_WORDS = 2_000_000


def held_out(ids: list, folds: int, held: int) -> np.ndarray:
    """Whether crc32 of the key's text (null: empty text) is ``held`` modulo ``folds``."""
    return np.fromiter((zlib.crc32(b"" if i is None else str(i).encode()) % folds == held for i in ids), dtype=bool, count=len(ids))


# -- counts ------------------------------------------------------------------------------------------


def count_words(chunks: DataFrame, folds: int, held: int, ranges: int) -> DataFrame:
    """Counts over the training documents of all chunks, returned to each chunk.

    A chunk sends its distinct words (hashes, sorted) and their counts, cut into ranges of the hash
    space; a range sums the counts and sends back to each chunk the totals of its words in their
    order. Rows of kind ``counts`` hold these; those of kind ``range`` its tokens, its distinct words
    and its most frequent words.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, c in chunks_of(batch):
                used = np.repeat(~held_out(c.ids, folds, held), c.lengths)
                counts = np.bincount(c.codes[used], minlength=len(c.words)).astype(np.uint32)
                at = range_of(c.words, ranges)
                full = np.flatnonzero(np.diff(at)).tolist()
                columns = [[c.number] * len(full), full, [pack_array(c.words[at[r] : at[r + 1]]) for r in full], [pack_array(counts[at[r] : at[r + 1]]) for r in full]]
                yield pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "part", "words", "counts"])

    def total(table: pa.Table) -> pa.Table:
        words = [unpack_array(b.as_py(), np.uint64) for b in table["words"]]
        counts = [unpack_array(b.as_py(), np.uint32) for b in table["counts"]]
        distinct, place = np.unique(np.concatenate(words), return_inverse=True)
        sums = np.bincount(place, weights=np.concatenate(counts).astype(np.float64), minlength=len(distinct)).astype(np.int64)
        part = table["part"][0].as_py()
        ends = np.cumsum([len(w) for w in words])
        back = [pack_array(sums[place[e - len(w) : e]]) for w, e in zip(words, ends.tolist(), strict=True)]
        top = np.lexsort((distinct, -sums))[:VOCABULARY]
        top = top[sums[top] > 0]
        n = len(back)
        empty: list = []
        return pa.table(
            {
                "kind": ["counts"] * n + ["range"],
                "chunk": pa.array([*table["chunk"].to_pylist(), None], pa.int64()),
                "part": pa.array([part] * (n + 1), pa.int32()),
                "totals": pa.array([*back, None], pa.binary()),
                "n": pa.array([None] * n + [int(sums.sum())], pa.int64()),
                "v": pa.array([None] * n + [int((sums > 0).sum())], pa.int64()),
                "top_words": pa.array([empty] * n + [distinct[top].view(np.int64).tolist()], pa.list_(pa.int64())),
                "top_counts": pa.array([empty] * n + [sums[top].tolist()], pa.list_(pa.int64())),
            }
        )

    sent = chunks.mapInArrow(send, "chunk long, part int, words binary, counts binary")
    schema = "kind string, chunk long, part int, totals binary, n long, v long, top_words array<long>, top_counts array<long>"
    return cut(sent.groupBy("part").applyInArrow(total, schema), "counts")


class Corpus:
    """Totals of the training documents, and the most frequent words: of bounded size."""

    def __init__(self, counted: DataFrame) -> None:
        parts = counted.where("kind = 'range'")
        self.n, self.v = (x or 0 for x in parts.agg(F.sum("n"), F.sum("v")).first())
        top = parts.select(F.explode(F.arrays_zip("top_words", "top_counts")).alias("x")).select("x.*").orderBy(F.col("top_counts").desc(), "top_words").limit(VOCABULARY).collect()
        self.words = np.array([r[0] for r in top], dtype=np.int64).view(np.uint64)
        self.counts = np.array([r[1] for r in top], dtype=np.int64)
        order = np.argsort(self.words)
        self.sorted_words, self.sorted_ids = self.words[order], order

    def ids(self, words: np.ndarray) -> np.ndarray:
        """The network's number for each word hash: its rank, or the number after the last for other words."""
        v = len(self.words)
        if not v:
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.sorted_words, words), v - 1)
        return np.where(self.sorted_words[at] == words, self.sorted_ids[at], v)

    def other(self) -> tuple[int, int]:
        """Tokens and distinct words outside the vocabulary."""
        return int(self.n - self.counts.sum()), int(self.v - len(self.words))


# -- network -----------------------------------------------------------------------------------------


class Network:
    """P(word) = P(class) P(word in class); words are classed by rank, and rare words are the last class."""

    def __init__(self, corpus: Corpus, hidden: int = HIDDEN, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        v = len(corpus.words)
        self.v, self.size = v, max(1, int(np.ceil(np.sqrt(v))))
        self.classes = -(-v // self.size)
        mass = np.log(corpus.counts + 1.0)
        self.real = np.arange(self.classes * self.size) < v
        inside = np.full(self.classes * self.size, -1e9)
        inside[:v] = mass
        sums = [*np.exp(inside.reshape(self.classes, self.size)).sum(axis=1), corpus.other()[0] + corpus.other()[1] + 1.0]
        f = np.float32
        self.p = {
            "X": rng.normal(0, 0.3, (v + 2, 3 * hidden)).astype(f),  # one row for each word, rare words, and the start
            "U": gru.init_cell(rng, hidden)["U"],
            "C": rng.normal(0, 0.05, (self.classes + 1, hidden)).astype(f),
            "c": np.log(np.array(sums) / np.sum(sums)).astype(f)[:, None],
            "O": rng.normal(0, 0.05, (self.classes * self.size, hidden)).astype(f),
            "o": inside.astype(f)[:, None],
        }

    def output(self, h: np.ndarray, target: np.ndarray, gradients: bool = False) -> tuple:
        """Log probability of each target (rare words: of their class) given states h (H, n)."""
        p = self.p
        which = np.where(target < self.v, target // self.size, self.classes)
        logits = p["C"] @ h
        logits += p["c"]
        logits -= logits.max(axis=0)
        e = np.exp(logits)
        z = e.sum(axis=0)
        got = logits[which, np.arange(len(target))] - np.log(z)
        order = np.argsort(which, kind="stable")
        ends = np.searchsorted(which[order], np.arange(self.classes + 1))
        if gradients:
            d_logits = e / z
            d_logits[which, np.arange(len(target))] -= 1
            d_h = p["C"].T @ d_logits
            g = {"C": d_logits @ h.T, "c": d_logits.sum(axis=1, keepdims=True), "O": np.zeros_like(p["O"]), "o": np.zeros_like(p["o"])}
        for k in range(self.classes):
            at = order[ends[k] : ends[k + 1]]
            if not len(at):
                continue
            rows = slice(k * self.size, (k + 1) * self.size)
            own = h[:, at]
            logits = p["O"][rows] @ own
            logits += p["o"][rows]
            logits -= logits.max(axis=0)
            e = np.exp(logits)
            z = e.sum(axis=0)
            place = target[at] - k * self.size
            got[at] += logits[place, np.arange(len(at))] - np.log(z)
            if gradients:
                d = e / z
                d[place, np.arange(len(at))] -= 1
                d *= self.real[rows, None]
                g["O"][rows], g["o"][rows] = d @ own.T, d.sum(axis=1, keepdims=True)
                d_h[:, at] += p["O"][rows].T @ d
        return (got, g, d_h) if gradients else (got,)

    def gradients(self, previous: np.ndarray, target: np.ndarray, keep: np.ndarray, weight: np.ndarray, h: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Of minus the mean log probability over a window (T, S) of parallel streams, from state h on."""
        T, S = target.shape
        xs = np.ascontiguousarray(self.p["X"][previous].transpose(0, 2, 1))
        states, cache = gru.forward(self.p["U"], xs, h, keep)
        flat = states.transpose(1, 0, 2).reshape(len(h), T * S)
        live = np.flatnonzero(weight.ravel())
        got, g, d_live = self.output(flat[:, live], target.ravel()[live], gradients=True)
        n = max(1, len(live))
        d_flat = np.zeros_like(flat)
        d_flat[:, live] = d_live / n
        d_states = np.ascontiguousarray(d_flat.reshape(len(h), T, S).transpose(1, 0, 2))
        d_xs, d_U = gru.backward(self.p["U"], cache, d_states, keep)
        d_X = np.zeros_like(self.p["X"])
        flat = previous.ravel()
        order = np.argsort(flat, kind="stable")
        at = np.flatnonzero(np.diff(flat[order], prepend=-1))
        d_X[flat[order][at]] = np.add.reduceat(d_xs.transpose(0, 2, 1).reshape(T * S, -1)[order], at, axis=0)
        grads = {k: (a / n).astype(np.float32) for k, a in g.items()} | {"U": d_U, "X": d_X}
        return -float(got.sum()) / n, grads, states[-1]

    def train(self, words: np.ndarray, starts: np.ndarray, optimiser: gru.Adam) -> float:
        """One pass over documents one after the other: truncated backpropagation over parallel streams, states carried on."""
        n = len(words)
        if not n:
            return 0.0
        previous = np.concatenate(([self.v + 1], words[:-1]))
        keep = np.ones(n, dtype=np.float32)
        previous[starts], keep[starts] = self.v + 1, 0
        length = -(-n // STREAMS)
        pad = length * STREAMS - n
        shape = lambda a, fill: np.concatenate((a, np.full(pad, fill, a.dtype))).reshape(STREAMS, length).T
        previous, target, keep, weight = shape(previous, self.v), shape(words, 0), shape(keep, 0), shape(np.ones(n, np.float32), 0)
        h, loss, turns = np.zeros((len(self.p["U"][0]), STREAMS), np.float32), 0.0, 0
        for a in range(0, length, WINDOW):
            cutting = slice(a, a + WINDOW)
            one, g, h = self.gradients(previous[cutting], target[cutting], keep[cutting], weight[cutting], h)
            optimiser.update(g, clip=1.0)
            loss, turns = loss + one, turns + 1
        return loss / turns

    def score(self, words: np.ndarray, lengths: np.ndarray, block: int = 1 << 16) -> np.ndarray:
        """Natural log probability of each document, states carried from its first word to its last."""
        bounds = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
        order = np.argsort(-lengths, kind="stable")
        start, left = bounds[:-1][order], lengths[order]
        total = np.zeros(len(lengths))
        H = self.p["U"].shape[1]
        X, U = self.p["X"], self.p["U"]
        h = np.zeros((H, len(lengths)), dtype=np.float32)
        previous = np.full(len(lengths), self.v + 1)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n_held = 0
        longest = int(left[0]) if len(left) else 0
        active = np.searchsorted(-left, -np.arange(longest), side="left")

        def flush() -> None:
            nonlocal held, n_held
            states = np.concatenate([s for s, _ in held], axis=1)
            target = np.concatenate([w for _, w in held])
            got = self.output(states, target)[0]
            who = np.concatenate([np.arange(len(w)) for _, w in held])
            total[:] += np.bincount(who, weights=got, minlength=len(total))
            held, n_held = [], 0

        for t, n in enumerate(active.tolist()):
            h = gru.step(U, np.ascontiguousarray(X[previous[:n]].T), h[:, :n])
            now = words[start[:n] + t]
            held.append((h, now))
            n_held += n
            previous = now
            if n_held >= block:
                flush()
        if held:
            flush()
        out = np.zeros(len(lengths))
        out[order] = total
        return out


def flatten(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def unflatten(p: dict[str, np.ndarray], flat: np.ndarray) -> None:
    at = 0
    for k in sorted(p):
        p[k] = flat[at : at + p[k].size].reshape(p[k].shape).astype(np.float32)
        at += p[k].size


FAN_IN = 16
COPIES = "shard long, weight double, params binary"


def average(table: pa.Table) -> pa.Table:
    """Weighted mean of copies of the network, summed in the order of their shards."""
    table = table.sort_by("shard")
    weights = table["weight"].to_numpy()
    sums = sum(w * np.frombuffer(b.as_py(), dtype=np.float32).astype(np.float64) for w, b in zip(weights, table["params"], strict=True))
    return pa.table({"shard": pa.array([table["shard"][0].as_py() // FAN_IN], pa.int64()), "weight": [float(weights.sum())], "params": pa.array([(sums / weights.sum()).astype(np.float32).tobytes()], pa.binary())})


def placed(c: Chunk, use: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Round, shard and place in it of the documents ``use`` of a chunk: by a hash of key and words, so the same however the table is cut into partitions and chunks."""
    bounds, raw = c.bounds(), c.words[c.codes].tobytes()
    h = np.array([xxhash.xxh3_64_intdigest(raw[8 * bounds[d] : 8 * bounds[d + 1]], seed=zlib.crc32(str(c.ids[d]).encode())) for d in use.tolist()], dtype=np.uint64)
    return (h % np.uint64(ROUNDS)).astype(np.int64), (h // np.uint64(ROUNDS) % np.uint64(shards)).astype(np.int64), h


def learner(sent, turn: int):
    """A function that trains a copy of the broadcast network ``sent`` on the documents of a shard, in the order of their places."""

    def learn(table: pa.Table) -> pa.Table:
        own = copy.deepcopy(sent.value)
        blobs = [[unpack_array(b.as_py(), t) for b in table[k]] for k, t in (("places", np.uint64), ("lengths", np.int32), ("words", np.uint16))]
        place, lengths, words = (np.concatenate(x) for x in blobs)
        bounds = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
        order = np.argsort(place, kind="stable")
        words = np.concatenate([words[bounds[d] : bounds[d + 1]] for d in order.tolist()]).astype(np.int64)
        lengths = lengths[order].astype(np.int64)
        own.train(words, np.cumsum(lengths) - lengths, gru.Adam(own.p, 0.01 if turn == 0 else 0.004))
        return pa.table({"shard": table["shard"][:1], "weight": [float(len(words))], "params": pa.array([flatten(own.p).tobytes()], pa.binary())})

    return learn


def train(chunks: DataFrame, corpus: Corpus, folds: int, held: int) -> Network:
    """A copy of the network is trained on each shard of documents; copies are averaged up a tree; then the next round.

    A round reads one document in ``ROUNDS`` of the training documents, other ones each time, so the
    network learns from each of them once. Shards are of bounded size, their number grows with the
    tokens, and documents come to them by hash and are read there in the order of their hashes: the
    network does not depend on partitions. Words travel as their numbers, two bytes before compression.
    """
    spark = chunks.sparkSession
    net = Network(corpus)
    if not net.v:
        return net
    shards = max(1, -(-corpus.n // (ROUNDS * SHARD_TOKENS)))
    numbers = spark.sparkContext.broadcast(corpus)
    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast(net)

        def deal(batches: Iterator[pa.RecordBatch], turn: int = turn) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, c in chunks_of(batch):
                    use = np.flatnonzero(~held_out(c.ids, folds, held) & (c.lengths > 0))
                    of_round, shard, place = placed(c, use, shards)
                    words, bounds = numbers.value.ids(c.words).astype(np.uint16)[c.codes], c.bounds()
                    mine = of_round == turn
                    use, shard, place = use[mine], shard[mine], place[mine]
                    order = np.lexsort((place, shard))
                    starts = np.flatnonzero(np.diff(shard[order], prepend=-1))
                    columns: list[list] = [[], [], [], []]
                    for part in np.split(order, starts[1:]) if len(order) else []:
                        docs = use[part]
                        columns[0].append(int(shard[part[0]]))
                        columns[1].append(pack_array(place[part]))
                        columns[2].append(pack_array(c.lengths[docs]))
                        columns[3].append(pack_array(np.concatenate([words[bounds[d] : bounds[d + 1]] for d in docs.tolist()])))
                    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(x, type=k) for x, k in zip(columns, kinds, strict=True)], names=["shard", "places", "lengths", "words"])

        dealt = chunks.mapInArrow(deal, "shard long, places binary, lengths binary, words binary")
        # a fixed number of partitions: shards are few bytes and much work, so they are not to be merged by size
        dealt = dealt.repartition(max(lanes(spark), 2 * shards), "shard")
        copies = cut(dealt.groupBy("shard").applyInArrow(learner(sent, turn), COPIES), "networks")
        many = shards
        while many > 1:
            copies = copies.groupBy(F.expr(f"shard div {FAN_IN}")).applyInArrow(average, COPIES)
            many = -(-many // FAN_IN)
        found = copies.select("params").first()
        if found is None:
            continue
        unflatten(net.p, np.frombuffer(found[0], dtype=np.float32))
        net.p["o"][~net.real] = -1e9
    return net


# -- scores ------------------------------------------------------------------------------------------

OUT = "key long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_chunk(c: Chunk, counts: np.ndarray, corpus: Corpus, net: Network, folds: int, held: int) -> list:
    """Columns of OUT for the documents of a chunk."""
    at = np.concatenate(([0], np.cumsum(c.lengths, dtype=np.int64)))[:-1]
    per_doc = lambda values: np.add.reduceat(values[c.codes], at)  # noqa: E731  every document has its end
    ids = corpus.ids(c.words)
    other_n, other_v = corpus.other()
    inside = np.where(ids == net.v, np.log10((counts + 1) / (other_n + other_v + 1)), 0.0) if net.v else np.log10((counts + 1) / (corpus.n + corpus.v + 1))
    known = per_doc((counts > 0).astype(np.int64))
    base = per_doc(np.log10((counts + 1) / (corpus.n + corpus.v + 1)))
    model = per_doc(inside)
    if net.v:
        model = model + net.score(ids[c.codes], c.lengths) / np.log(10)
    n = len(c.ids)
    return [c.ids, held_out(c.ids, folds, held).tolist(), c.lengths.tolist(), known.tolist(), [corpus.n] * n, base.tolist(), model.tolist()]


def score_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", folds: int = 7, held: int = 2) -> DataFrame:
    """Scores of whole documents: one row per row of ``docs``.

    Words are what stands between ASCII white space, A-Z as a-z, and each document ends with a token of
    its own. ``base_score`` sums log10 of add-one estimates from the counts of all training documents,
    those whose crc32 of the key's text is not ``held`` modulo ``folds``. ``score`` is the log10
    probability by the network: classes of frequent words from the state, carried over the whole
    document; words outside its vocabulary by their class, and in it by their counts. The counts come
    from all training documents and meet each chunk of documents as one small array; nothing but the
    totals, the frequent words and the network passes through the driver.

    Words are told apart by 64-bit hashes. Null and empty texts are the end alone. Null keys count as
    empty text for the fold; rows with null or repeated keys are scored like all others. An empty
    table gives an empty table. Other columns are not read.
    """
    spark = docs.sparkSession
    chunks = encode_chunks(docs, text, key, end=True)
    words = chunks.agg(F.sum("n_words")).first()[0] or 0
    ranges = max(lanes(spark), -(-words // RANGE_WORDS))
    counted = count_words(chunks, folds, held, ranges)
    corpus = Corpus(counted)
    net = train(chunks, corpus, folds, held)
    sent = spark.sparkContext.broadcast((net, corpus))
    totals = counted.where("kind = 'counts'").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("part", "totals"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, corpus = sent.value
        for batch in batches:
            for i, c in chunks_of(batch):
                counts = np.concatenate([unpack_array(x["totals"], np.int64) for x in batch.column("parts")[i].as_py()])
                columns = score_chunk(c, counts, corpus, net, folds, held)
                kinds = (pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2)
                yield pa.RecordBatch.from_arrays([pa.array(x, type=k) for x, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in OUT.split(", ")])

    return chunks.join(totals, "chunk").mapInArrow(run, OUT).withColumnRenamed("key", key)
