"""Links between documents whose word shingles overlap, by prefixes of tokens and of token pairs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Chunk, chunks_of, encode_chunks, pack_array, unpack_array
from .scratch import cut, discard, lanes

#: Shingles in more documents than this are indexed in pairs, others alone.
OFTEN = 64
CELL_PAIRS = 2000
RANGE_TOKENS = 2_000_000
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(c: Chunk, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (64-bit hashes) of the documents of a chunk, sorted within each, and their bounds."""
    hashes, bounds = c.words[c.codes], c.bounds()
    n = len(hashes)
    doc = np.repeat(np.arange(len(c.lengths)), c.lengths)
    rolled = np.zeros(max(0, n - words + 1), dtype=np.uint64)
    for i in range(words):
        rolled = mix(rolled * M2 + M1 + hashes[i : i + len(rolled)])
    whole = doc[: len(rolled)] == doc[words - 1 :] if len(rolled) else np.zeros(0, bool)
    shingles, owner = rolled[whole], doc[: len(rolled)][whole]
    short = np.flatnonzero((c.lengths > 0) & (c.lengths < words))
    if len(short):  # the whole sequence is the shingle
        own = []
        for d in short.tolist():
            x = np.full(1, np.uint64(c.lengths[d])) * M3
            for h in hashes[bounds[d] : bounds[d + 1]]:
                x = mix(x * M2 + M1 + h)
            own.append(x)
        shingles, owner = np.concatenate([shingles, *own]), np.concatenate([owner, short])
    order = np.lexsort((shingles, owner))
    shingles, owner = shingles[order], owner[order]
    fresh = np.ones(len(shingles), dtype=bool)
    fresh[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    shingles, owner = shingles[fresh], owner[fresh]
    return shingles, np.searchsorted(owner, np.arange(len(c.lengths) + 1))


def needed(n: int, percent: int) -> int:
    """The overlap that a set of size n has with any set linked to it, at least."""
    return -(-percent * n // 100)


def groups_of(n: int) -> int:
    """Into how many groups the frequent tokens of a prefix are dealt before they are paired: a power of two."""
    g = 1
    while g * 160 <= n:
        g *= 2
    return g


def depth(n):
    """How many common tokens the heads of two linked sets are asked for, by the size of the smaller one (a number or an array)."""
    return np.minimum(n, np.maximum(3, -(-n // 10)))


def share_counted(percent: int) -> float:
    """The share of the hash space whose tokens are counted in all sets."""
    return min(1.0, 6 * (100 - percent) / 100)


def index_keys(head: np.ndarray, seen: np.ndarray, copies: int, n: int, percent: int) -> np.ndarray:
    """Index keys of a set of ``n`` tokens; ``head``: the first of them in order (see ``signatures``); ``seen``: in how many heads each is; ``copies``: rows with this set.

    Two linked sets of n and m tokens have ``t`` tokens in common among their first
    ``n - needed(n) + t`` and ``m - needed(m) + t``, for every t up to their overlap. With t = g + 1
    either one of these is rare, and both sets have it as a key; or all are frequent, and of g + 1
    tokens dealt into g groups by their hashes two fall into one group: both sets have that pair as a
    key. Sizes of linked sets may lie on different steps of ``groups_of``, so a set uses the g of all
    sizes from that of the smallest set linked to it up to its own. A set so small that an overlap
    may be less than g + 1 has all its tokens as keys. Tokens that only equal sets have are no keys.
    """
    need = needed(n, percent)
    keys = []
    sizes = [groups_of(need)]
    while sizes[-1] < groups_of(n):
        sizes.append(2 * sizes[-1])
    longest = n - need + sizes[-1] + 1
    own = seen[:longest]
    keys.append(head[:longest][(own > copies) & (own <= OFTEN)])
    if need < sizes[-1] + 1:
        keys.append(head[: n - need + 1])
    for g in sizes:
        end = n - need + g + 1
        often = np.sort(head[:end][(seen[:end] > OFTEN) & (seen[:end] > copies)])
        group = mix(often + M3) & np.uint64(g - 1)
        for k in np.unique(group):
            part = often[group == k]
            a, b = np.triu_indices(len(part), 1)
            keys.append(mix(mix(part[a] * M2 + M1) + part[b] * M3 + np.uint64(g)))
    return np.unique(np.concatenate(keys))


@dataclass
class Heads:
    """What a chunk asks about: the short tokens of its heads and its classes, both distinct, sorted, and cut into parts.

    ``sizes`` of the sets, ``counted``: how many of their tokens are counted in all sets.
    """

    sizes: np.ndarray
    counted: np.ndarray
    at: np.ndarray
    place: np.ndarray
    short: np.ndarray
    counts: np.ndarray
    token_parts: np.ndarray
    classes: np.ndarray
    class_of: np.ndarray
    rows: np.ndarray
    class_parts: np.ndarray


def heads_of(shingles: np.ndarray, bounds: np.ndarray, percent: int, bits: int) -> Heads:
    """Heads of the sets of a chunk: their smallest tokens. Tokens are cut to their last ``bits`` + 32 bits; the first ``bits`` of these number the part."""
    sizes = np.diff(bounds)
    low = np.concatenate(([0], np.cumsum(shingles < np.uint64(min((1 << 64) - 1, int(share_counted(percent) * (1 << 64)))))))
    counted = low[bounds[1:]] - low[bounds[:-1]]
    lengths = np.maximum(counted, np.minimum(sizes, sizes - (-(-percent * sizes // 100)) + depth(sizes)))
    at = np.concatenate(([0], np.cumsum(lengths)))
    inside = np.arange(len(shingles)) - np.repeat(bounds[:-1], sizes) < np.repeat(lengths, sizes)
    short, place, counts = np.unique(shingles[inside] & np.uint64((1 << (32 + bits)) - 1), return_inverse=True, return_counts=True)
    raw = shingles.tobytes()
    found = np.fromiter((xxhash.xxh3_64_intdigest(raw[8 * a : 8 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)), dtype=np.uint64, count=len(sizes))
    classes, rows = np.unique(found[sizes > 0], return_counts=True)
    class_of = np.searchsorted(classes, found)
    parts = np.arange((1 << bits) + 1)
    token_parts = np.searchsorted(short >> np.uint64(32), parts)
    class_parts = np.searchsorted(classes >> np.uint64(64 - bits) if bits else np.zeros(len(classes), np.uint64), parts)
    return Heads(sizes, counted, at, place, (short & np.uint64(0xFFFFFFFF)).astype(np.uint32), counts.astype(np.uint32), token_parts, classes, class_of, rows.astype(np.uint32), class_parts)


ANSWERS = "chunk long, part int, seen binary, copies binary, first binary"


def rarities(chunks: DataFrame, words: int, percent: int, bits: int) -> DataFrame:
    """For each chunk and part of the hash space: in how many heads each token of its heads is, how many rows have each of its classes, and of which classes it is the first chunk.

    A chunk sends, for each part, 32 bits of the tokens beyond those that number the part, sorted, and
    how many of its heads hold each. Tokens that share these bits count as one, which can only make
    them look more frequent, and to all chunks alike.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, c in chunks_of(batch):
                h = heads_of(*shingle_sets(c, words), percent, bits)
                full = np.flatnonzero(np.diff(h.token_parts) + np.diff(h.class_parts)).tolist()
                of = lambda array, at: pa.array([pack_array(array[at[r] : at[r + 1]]) for r in full], pa.binary())  # noqa: B023, E731
                columns = [pa.array([c.number] * len(full), pa.int64()), pa.array(full, pa.int32()), of(h.short, h.token_parts), of(h.counts, h.token_parts), of(h.classes, h.class_parts), of(h.rows, h.class_parts)]
                yield pa.RecordBatch.from_arrays(columns, names=["chunk", "part", "tokens", "counts", "classes", "rows"])

    def total(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")

        def sums(values: str, dtype, numbers: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
            each = [unpack_array(b.as_py(), dtype) for b in table[values]]
            distinct, first, place = np.unique(np.concatenate(each), return_index=True, return_inverse=True)
            sums = np.bincount(place, weights=np.concatenate([unpack_array(b.as_py(), np.uint32) for b in table[numbers]]), minlength=len(distinct))
            is_first = np.zeros(len(place), dtype=np.uint8)
            is_first[first] = 1
            ends = np.cumsum([len(x) for x in each])[:-1]
            return np.split(np.minimum(sums, 0xFFFFFFFF).astype(np.uint32)[place], ends), np.split(is_first, ends)

        seen, _ = sums("tokens", np.uint32, "counts")
        copies, first = sums("classes", np.uint64, "rows")
        packed = [pa.array([pack_array(x) for x in arrays], pa.binary()) for arrays in (seen, copies, first)]
        return pa.table([table["chunk"], table["part"], *packed], names=[x.split()[0] for x in ANSWERS.split(", ")])

    sent = chunks.mapInArrow(send, "chunk long, part int, tokens binary, counts binary, classes binary, rows binary")
    return sent.groupBy("part").applyInArrow(total, ANSWERS)


SIGNED = "id long, mark long, n long, class long, keys array<long>, tokens binary"


def signatures(docs: DataFrame, text: str, key: str, words: int, percent: int, marked: bool = False) -> DataFrame:
    """Per row: id, mark of the text (see ``encode_chunks``), set size, the hash of the set (null if empty); and for the first row of every set that may have links to other sets its keys and tokens.

    The order of tokens: those in the first ``share_counted`` of the hash space come first, rarest
    first; the others follow by their hashes. So only heads are sent and counted: all tokens in that
    share of the hash space, and more where these are too few for a prefix. Of its first
    ``n - needed(n) + t`` tokens a set has t in common with a linked one. Sets with fewer that any
    other set has too are linked with nothing but their equals.
    """
    chunks = encode_chunks(docs, text, key, marked=marked)
    tokens = int((chunks.agg(F.sum("n_tokens")).first()[0] or 0) * share_counted(percent))
    parts = 1
    while parts < max(lanes(docs.sparkSession), tokens // RANGE_TOKENS):
        parts *= 2
    bits = parts.bit_length() - 1
    answers = rarities(chunks, words, percent, bits).groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("part", "seen", "copies", "first"))).alias("answers"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, c in chunks_of(batch):
                shingles, at = shingle_sets(c, words)
                h = heads_of(shingles, at, percent, bits)
                got = batch.column("answers")[i].as_py() or []
                seen, copies, first = (np.concatenate([np.zeros(0, t), *(unpack_array(x[k], t) for x in got)]) for k, t in (("seen", np.uint32), ("copies", np.uint32), ("first", np.uint8)))
                seen = seen[h.place].astype(np.int64)
                n, full = h.sizes, h.sizes > 0
                copies = np.where(full, np.append(copies, 0)[h.class_of], 0).astype(np.int64)
                leads = np.zeros(len(n), dtype=bool)
                leads[np.unique(np.where(full, h.class_of, len(h.classes)), return_index=True)[1]] = True
                leads &= full & (np.append(first, 0)[h.class_of] == 1)
                need = -(-percent * n // 100)
                alone = np.concatenate(([0], np.cumsum(seen == np.repeat(copies, np.diff(h.at)))))
                asked = np.maximum(h.counted, n - need + depth(need))
                enough = alone[h.at[:-1] + asked] - alone[h.at[:-1]] <= n - need
                # no other set if even one with all n tokens and one more overlaps too little
                keys: list = [None] * len(n)
                sets: list = [None] * len(n)
                for d in np.flatnonzero(leads & enough & (100 * n >= percent * (n + 1))).tolist():
                    own, levels = shingles[at[d] : at[d + 1]], seen[h.at[d] : h.at[d + 1]]
                    order = np.arange(len(levels))
                    order[: h.counted[d]] = np.argsort(levels[: h.counted[d]], kind="stable")
                    keys[d] = index_keys(own[order], levels[order], int(copies[d]), int(n[d]), percent).view(np.int64).tolist()
                    sets[d] = own.tobytes()
                classes = pa.array(np.append(h.classes, np.uint64(0)).view(np.int64)[h.class_of], pa.int64(), mask=~full)
                kinds = (pa.int64(), pa.int64(), pa.int64(), None, pa.list_(pa.int64()), pa.binary())
                columns = (c.ids, c.marks, n.tolist(), classes, keys, sets)
                yield pa.RecordBatch.from_arrays([x if k is None else pa.array(x, type=k) for x, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SIGNED.split(", ")])

    signed = cut(chunks.join(answers, "chunk", "left").mapInArrow(sign, SIGNED), "signatures")
    discard(chunks)
    return signed


#: Rows of (cell, class) up to this number are sent to all tasks (some MB); more are joined by a shuffle.
BROADCAST_WANTED = 200_000


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets overlap enough.

    Pairs are dealt to cells of a few hundred by a and, if a has many, by b too. Each set goes once
    to every cell that needs it.
    """
    counts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("many"))
    cells = max(lanes(pairs.sparkSession), pairs.count() // CELL_PAIRS)
    spread = F.ceil(F.col("many") / CELL_PAIRS)
    cell = F.pmod(F.xxhash64("a", F.when(spread > 1, F.pmod(F.xxhash64("b"), spread))), F.lit(cells)).cast("int")
    dealt = cut(pairs.join(counts, "a").select("a", "b", cell.alias("cell")), "pairs")
    wanted = dealt.select(F.col("cell").alias("at_cell"), F.explode(F.array("a", "b")).alias("class")).distinct()
    material = sets.join(F.broadcast(wanted) if 2 * dealt.count() <= BROADCAST_WANTED else wanted, "class")

    def check(left: pa.Table, right: pa.Table) -> pa.Table:
        held = {k: np.frombuffer(t, dtype=np.uint64) for k, t in zip(right["class"].to_pylist(), right["tokens"].to_pylist(), strict=True)}
        out_a, out_b = [], []
        for a, b in zip(left["a"].to_pylist(), left["b"].to_pylist(), strict=True):
            x, y = held[a], held[b]
            if len(x) > len(y):
                x, y = y, x
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            both = int((y[at] == x).sum())
            if 100 * both >= percent * (len(x) + len(y) - both):
                out_a.append(a)
                out_b.append(b)
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return dealt.groupBy("cell").cogroup(material.groupBy("at_cell")).applyInArrow(check, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, top) of every node of ``links(a, b)``: the smallest node it can reach.

    Every round a node takes the smallest top of its neighbours and then the top of that top, so
    paths shorten by half. Rounds end when nothing changes.
    """
    edges = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    tops = cut(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("top")), "tops")
    while True:
        by_node = tops.withColumnRenamed("node", "b").withColumnRenamed("top", "b_top")
        near = edges.join(by_node, "b").groupBy(F.col("a").alias("node")).agg(F.min("b_top").alias("near"))
        moved = tops.join(near, "node").select("node", F.least("top", "near").alias("via"), "top")
        above = tops.select(F.col("node").alias("via"), F.col("top").alias("above"))
        new = cut(moved.join(above, "via", "left").select("node", F.least("via", F.coalesce("above", "via")).alias("top"), (F.least("via", F.coalesce("above", "via")) != F.col("top")).alias("changed")), "tops")
        if new.where("changed").isEmpty():
            return new.select("node", "top")
        tops = new.select("node", "top")


#: Rounds in which members of a bucket meet one leader of it, before the rest meet each other.
LEADERS = 2
#: Sets in a block when the rest meet, and columns of a product of blocks.
BLOCK, COLUMNS = 256, 8192


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left set with every right one, as a product of 0/1 matrices."""
    tokens, place = np.unique(np.concatenate(left), return_inverse=True)
    l_row = np.repeat(np.arange(len(left)), [len(x) for x in left])
    other = np.concatenate(right)
    r_row = np.repeat(np.arange(len(right)), [len(x) for x in right])
    at = np.minimum(np.searchsorted(tokens, other), len(tokens) - 1)
    same = tokens[at] == other
    r_row, r_place = r_row[same], at[same]
    shared, r_place = np.unique(r_place, return_inverse=True)
    to_shared = np.full(len(tokens), -1)
    to_shared[shared] = np.arange(len(shared))
    l_place = to_shared[place]
    l_order, r_order = np.argsort(l_place, kind="stable"), np.argsort(r_place, kind="stable")
    l_row, l_place, r_row, r_place = l_row[l_order], l_place[l_order], r_row[r_order], r_place[r_order]
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    for first in range(0, len(shared), COLUMNS):
        width = min(COLUMNS, len(shared) - first)
        product = []
        for rows, row, col in ((len(left), l_row, l_place), (len(right), r_row, r_place)):
            span = slice(*np.searchsorted(col, (first, first + width)))
            m = np.zeros((rows, width), dtype=np.float32)
            m[row[span], col[span] - first] = 1
            product.append(m)
        out += product[0] @ product[1].T
    return out


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the same nodes as the links (a, b), at most one for each node."""
    top: dict[int, int] = {}
    kept = []

    def find(x: int) -> int:
        while top.setdefault(x, x) != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        u, v = find(x), find(y)
        if u != v:
            top[max(u, v)] = min(u, v)
            kept.append((x, y))
    return kept


def block_links(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components of classes in ``open_(key, class, n, top)``: all pairs with a common key are covered.

    Buckets that hang together are a cluster. In a cluster, the classes outside its largest component
    meet all its classes, a block of each at a time and only blocks of like sizes (a linked set lies
    in the same band of sizes or the next). A meeting counts all its overlaps in one product, so no
    pair becomes a row, and gives back a forest of links.
    """
    least = open_.groupBy("key").agg(F.min("class").alias("a"))
    edges = open_.join(least, "key").where(F.col("a") != F.col("class")).select("a", F.col("class").alias("b")).distinct()
    cluster = components(edges).withColumnRenamed("node", "class").withColumnRenamed("top", "cluster")
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(1.01 * float(np.log(100 / percent)) if percent < 100 else 0.01)).cast("int")
    members = open_.select("class", "n", "top").distinct().join(cluster, "class").withColumn("band", band)
    largest = members.groupBy("cluster", "top").count().groupBy("cluster").agg(F.max_by("top", F.struct("count", "top")).alias("main"))
    members = cut(members.join(largest, "cluster").withColumn("out", F.col("top") != F.col("main")), "cluster-members")
    blocks = members.groupBy("cluster", "band").agg(
        F.ceil(F.count_if("out") / BLOCK).cast("int").alias("l_blocks"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("r_blocks")
    )
    blocks = cut(blocks, "blocks")
    near = blocks.select("cluster", F.col("band").alias("l_band"), "l_blocks", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("r_band"))
    near = near.where("l_blocks > 0").join(blocks.select("cluster", F.col("band").alias("r_band"), "r_blocks"), ["cluster", "r_band"])
    at = F.xxhash64("class")
    l_side = members.where("out").withColumnRenamed("band", "l_band").join(near, ["cluster", "l_band"])
    l_side = l_side.withColumn("l", F.pmod(at, F.col("l_blocks"))).withColumn("r", F.explode(F.sequence(F.lit(0), F.col("r_blocks") - 1)))
    r_side = members.withColumnRenamed("band", "r_band").join(near, ["cluster", "r_band"])
    r_side = r_side.withColumn("r", F.pmod(at, F.col("r_blocks"))).withColumn("l", F.explode(F.sequence(F.lit(0), F.col("l_blocks") - 1)))
    meeting = F.xxhash64("cluster", "l_band", "r_band", F.col("l").cast("int"), F.col("r").cast("int")).alias("meeting")
    dealt = l_side.select(meeting, F.lit(0).alias("side"), "class", "top").unionByName(r_side.select(meeting, F.lit(1).alias("side"), "class", "top"))
    dealt = cut(dealt, "meetings")
    n_dealt = dealt.count()
    cells = max(lanes(open_.sparkSession), n_dealt // (2 * BLOCK))
    if n_dealt <= BROADCAST_WANTED:
        dealt = F.broadcast(dealt)
    rows = sets.join(dealt, "class").select(F.pmod(F.xxhash64("meeting"), F.lit(cells)).cast("int").alias("cell"), "meeting", "side", "top", "tokens")

    def meet(table: pa.Table) -> pa.Table:
        meetings, side, top = (table[c].to_numpy() for c in ("meeting", "side", "top"))
        tokens = table["tokens"]
        found: list[tuple[int, int]] = []
        order = np.argsort(meetings, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], np.diff(meetings[order]) != 0)))
        for own in np.split(order, starts[1:]):
            left, right = own[side[own] == 0], own[side[own] == 1]
            if not len(left) or not len(right):
                continue
            l_sets, r_sets = ([np.frombuffer(tokens[i].as_py(), dtype=np.uint64) for i in part.tolist()] for part in (left, right))
            both = overlaps(l_sets, r_sets).astype(np.float64)
            union = np.add.outer([len(x) for x in l_sets], [len(x) for x in r_sets]) - both
            i, j = np.nonzero((100 * both >= percent * union) & (top[left][:, None] != top[right][None, :]))
            found += forest(top[left][i], top[right][j])
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return rows.groupBy("cell").applyInArrow(meet, "a long, b long")


def class_links(signed: DataFrame, percent: int) -> DataFrame:
    """(class, top) for all classes (equal sets) that are linked to others: each class's component.

    In a bucket (the classes with one key) first every class meets one leader only, so a bucket costs
    as many checks as it has members; what these links join is one component. In the next rounds a
    member of the largest component leads. At last the classes of a bucket that are still in
    different components meet in blocks, so that no link is lost; links inside a component would
    change nothing.
    """
    mine = signed.where("keys is not null")
    sets = mine.select("class", "tokens")
    posted = mine.select(F.explode("keys").alias("key"), "class", "n")
    shared = posted.groupBy("key").count().where("count > 1").select("key")
    posted = cut(posted.join(shared, "key"), "postings")
    tops = cut(posted.select("class", F.col("class").alias("top")).distinct(), "components")

    for turn in range(LEADERS + 1):
        open_ = posted.join(tops, "class")
        mixed = open_.groupBy("key").agg(F.min("top").alias("low"), F.max("top").alias("high")).where("low <> high").select("key")
        open_ = cut(open_.join(mixed, "key"), "open")
        if open_.isEmpty():
            break
        if turn < LEADERS:
            sizes = open_.groupBy("key", "top").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct(F.xxhash64("class", F.lit(turn)).alias("h"), "class", "n")).alias("first"))
            lead = sizes.groupBy("key").agg(F.max_by(F.struct("top", "first"), F.struct("size", F.xxhash64("top"))).alias("x"))
            lead = lead.select("key", F.col("x.first.class").alias("a"), F.col("x.first.n").alias("an"), F.col("x.top").alias("a_top"))
            close = 100 * F.least("n", "an") >= percent * F.greatest("n", "an")
            met = open_.join(lead, "key").where((F.col("top") != F.col("a_top")) & close)
            pairs = cut(met.select(F.least("a", "class").alias("a"), F.greatest("a", "class").alias("b")).distinct(), "candidates")
            found = verified(pairs, sets, percent)
            named = found.join(tops.select(F.col("class").alias("a"), F.col("top").alias("ta")), "a").join(tops.select(F.col("class").alias("b"), F.col("top").alias("tb")), "b")
            links = named.select(F.col("ta").alias("a"), F.col("tb").alias("b"))
        else:
            links = block_links(open_, sets, percent)
        joined = cut(links.where("a <> b").distinct(), "links")
        if joined.isEmpty():
            continue
        raised = components(joined)
        tops = cut(tops.join(raised, tops["top"] == raised["node"], "left").select("class", F.coalesce(raised["top"], tops["top"]).alias("top")), "components")
    return tops


def members_of(docs: DataFrame, text: str, key: str, words: int, percent: int, marked: bool = False) -> DataFrame:
    """Per row of ``docs``: id, mark, set size and ``top``, which is the same for all rows of a component (null: the set is empty)."""
    signed = signatures(docs, text, key, words, percent, marked)
    tops = class_links(signed, percent)
    joined = signed.select("id", "mark", "n", "class").join(tops, "class", "left").withColumn("top", F.coalesce("top", "class"))
    return cut(joined.select("id", "mark", "n", "top"), "members")


def components_of(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: key, ``n_shingles``, ``component_id``.

    A document's set: its distinct shingles of ``words`` words (A-Z as a-z, ASCII white space between
    words); with fewer words the whole sequence is its one shingle. Two sets are linked when
    ``100 * intersection >= percent * union``; ``component_id`` is the smallest key that is reached
    by links. Equal sets are one class; only classes are compared. Shingles are told apart by 64-bit
    hashes.

    Null, empty and blank texts have an empty set and are linked with nothing: their component is
    their own key. Rows with null keys are linked like others, and a component without any key has a
    null one; repeated rows each come out. Sets of any size are compared whole. An empty table gives an
    empty table. Other columns are not read.
    """
    joined = members_of(docs, text, key, words, percent)
    least = joined.where("top is not null").groupBy("top").agg(F.min("id").alias("component_id"))
    out = joined.join(least, "top", "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("top").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, percent: int = 80) -> DataFrame:
    """One row of every component of ``docs``, all columns: one with its smallest key (null only if the component has no key).

    Rows are told apart by their key and the hash of their text, so of rows with one key (or none) only
    those go that are linked to a row that stays. Of rows of a component with equal keys, the one with
    the smallest hash stays; of rows equal in key and text, any one. Rows with empty sets are linked with
    nothing and all stay.
    """
    rows = members_of(docs, text, key, words, percent, marked=True).where("top is not null")
    rows = rows.groupBy("id", "mark").agg(F.min("top").alias("top"), F.count(F.lit(1)).alias("many"))
    first = rows.groupBy("top").agg(F.min(F.struct(F.col("id").isNull().alias("no_key"), "id", "mark")).alias("first"))
    stays = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("mark") == F.col("first.mark"))
    out = rows.join(first, "top").select(F.col("id").alias("out_key"), F.col("mark").alias("out_mark"), stays.alias("stays"), "many")
    out = cut(out.where("not stays or many > 1").select("out_key", "out_mark", "stays"), "out")
    same = docs[key].eqNullSafe(out["out_key"]) & (F.xxhash64(docs[text]) == out["out_mark"])
    kept = docs.join(out, same, "left_anti")
    if out.where("stays").isEmpty():
        return kept
    return kept.unionByName(docs.join(out.where("stays"), same, "left_semi").dropDuplicates([key, text]))
