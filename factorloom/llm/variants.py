"""Spelling variants: words one letter apart, found in tries of letter-group counts."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import LOWER, UPPER, cut, discard, lanes

#: Letters of a run: A-Z, a-z and the Latin letters up to U+00FF.
LETTERS = r"[A-Za-zÀ-ÿ]"
#: Levels of a trie: so many groups of letters.
GROUPS = 16
#: A word is dealt out by its length and the counts of so many coarse groups; the fewest for which no cell is over ``CELL`` words, or the most.
DEPTHS = (3, 4, 5, 6)
CELL = 20_000
#: Characters of words in one trie and of words that search it; larger cells are cut into blocks.
TRIE_CHARS, SEARCH_CHARS = 600_000, 2_000_000
#: Pairs of a word and a trie node, or pairs to verify, that are held at once.
HELD = 200_000
#: A field of a cell's code holds a count modulo this; another length or count of 2 ** 10 more lands in the same cell, which costs time only.
FIELD = 1 << 10


def count_words(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = 7, least_count: int = 2, damage: int | None = None) -> DataFrame:
    """(word, n): the distinct words of ``least`` code points or more that occur ``least_count`` times or more.

    Words are maximal runs of ``LETTERS``, A-Z in lower case. ``damage``: where it divides the crc32
    of ``<key>:<run>``, the run's code point at crc32 modulo length is left out first (a null key is
    empty there). Null and empty texts hold no words. Counts are summed before they move.
    """
    # one code point more can only be lost, so shorter runs give no word
    runs = F.regexp_extract_all(F.translate(F.col(text), UPPER, LOWER), F.lit(f"{LETTERS}{{{max(1, least)},}}"), F.lit(0))
    if damage:
        one = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.explode(runs).alias("run"))
        one = one.withColumn("h", F.crc32(F.concat("key", F.lit(":"), "run").cast("binary")))
        at = (F.col("h") % F.char_length("run")).cast("int")
        left_out = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
        words = one.select(F.when(F.col("h") % damage == 0, left_out).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= least)
    else:
        words = docs.select(F.explode(runs).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def letter_groups(words: DataFrame, word: str = "word") -> dict[int, int]:
    """Group of each of the 256 most frequent letters, dealt out to and fro by frequency so that groups weigh alike. A letter that is not here goes by its code point."""
    letters = words.select(F.explode(F.split(word, "")).alias("c")).where(F.col("c") != "").groupBy("c").count()
    most = letters.orderBy(F.col("count").desc(), "c").limit(256).collect()
    turns = [*range(GROUPS), *reversed(range(GROUPS))]
    return {ord(r["c"]): turns[i % len(turns)] for i, r in enumerate(most)}


def code_points(words: list[str], length: int) -> np.ndarray:
    """A row of code points for each word; all have ``length`` of them."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(words), length)


def group_counts(points: np.ndarray, groups: Mapping[int, int]) -> np.ndarray:
    """How many letters of each group each word has."""
    known = np.array(sorted(groups), dtype=np.uint32)
    flat = points.ravel()
    group = (flat % np.uint32(GROUPS)).astype(np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
        group = np.where(known[at] == flat, np.array([groups[k] for k in known.tolist()], dtype=np.int64)[at], group)
    line = np.repeat(np.arange(len(points)), points.shape[1])
    return np.bincount(line * GROUPS + group, minlength=len(points) * GROUPS).reshape(len(points), GROUPS)


def cell_code(counts: np.ndarray, depth: int) -> np.ndarray:
    """The counts of ``depth`` coarse groups in one number; group g of a trie is in coarse group g modulo depth + 1, and the last one follows from the length."""
    code = np.zeros(len(counts), dtype=np.int64)
    for c in range(depth):
        code = code * FIELD + counts[:, c :: depth + 1].sum(axis=1) % FIELD
    return code


def moves(depth: int) -> list[tuple[bool, tuple[int, ...]]]:
    """Cells in which a word looks for others, as (partner is longer by one, change of each coarse count).

    Every two words that are near are met once: a longer partner has one letter more in one group, and of
    two words of one length that which has fewer in the first group where they differ does the looking.
    """
    unit = lambda *at: tuple((at[:1] == (i,)) - (at[1:] == (i,)) for i in range(depth))
    still = (0,) * depth
    longer = [(True, still), *((True, unit(i)) for i in range(depth))]
    same = [(False, still), *((False, unit(i)) for i in range(depth)), *((False, unit(i, j)) for i, j in combinations(range(depth), 2))]
    return longer + same


def moved(code: np.ndarray, change: tuple[int, ...]) -> np.ndarray:
    out, scale = np.zeros_like(code), 1
    for step in reversed(change):
        out += (code // scale % FIELD + step) % FIELD * scale
        scale *= FIELD
    return out


class Trie:
    """Words of one length by their letter-group counts, level by level; the words of a leaf have all counts alike."""

    def __init__(self, counts: np.ndarray) -> None:
        self.order = np.lexsort(counts.T[::-1])
        ordered = counts[self.order]
        self.span = int(counts.max(initial=0)) + 3
        self.levels: list[np.ndarray] = []
        node = np.zeros(len(ordered), dtype=np.int64)
        for g in range(counts.shape[1]):
            # children of a level's nodes: (node, count) in order; a child's place is its number one level down
            keys, node = np.unique(node * self.span + ordered[:, g] + 1, return_inverse=True)
            self.levels.append(keys)
        self.bounds = np.searchsorted(node, np.arange((node[-1] + 1 if len(node) else 0) + 1))

    def search(self, counts: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, leaf) by the budgets: one letter more in one group costs the surplus, one fewer the deficit.

        Depth first, ``HELD`` visits at a time: of too many, one half waits until the other has come to its leaves.
        """
        stack = [(0, np.arange(len(counts)), np.zeros(len(counts), dtype=np.int64), surplus, deficit)]
        while stack:
            level, who, node, more, less = stack.pop()
            if not len(who):
                continue
            if len(who) > HELD:
                half = len(who) // 2
                stack += [(level, *(x[part] for x in (who, node, more, less))) for part in (slice(half, None), slice(0, half))]
                continue
            if level == len(self.levels):
                yield who, node
                continue
            keys, want = self.levels[level], counts[who, level]
            found = []
            for step, allowed in ((0, None), (1, more > 0), (-1, less > 0)):
                at = np.arange(len(who)) if allowed is None else np.flatnonzero(allowed)
                count = want[at] + step
                at, count = at[(count >= 0) & (count < self.span - 1)], count[(count >= 0) & (count < self.span - 1)]
                child = np.searchsorted(keys, key := node[at] * self.span + count + 1)
                hit = (child < len(keys)) & (keys[np.minimum(child, len(keys) - 1)] == key)
                at = at[hit]
                found.append((who[at], child[hit], more[at] - (step > 0), less[at] - (step < 0)))
            stack.append((level + 1, *(np.concatenate(x) for x in zip(*found, strict=True))))


def one_apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of code points, which pairs differ by exactly one: replaced if both are as long, else left out of ``b``, which is longer by one."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    front = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(axis=1)
    back = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return front + back >= a.shape[1]


def near_pairs(queries: np.ndarray, index: np.ndarray, groups: Mapping[int, int], ordered: bool) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) of words one apart. ``ordered``: both sides hold the same words of one cell, in code-point order; each pair comes once."""
    longer = index.shape[1] > queries.shape[1]
    trie = Trie(group_counts(index, groups))
    budget = np.ones(len(queries), dtype=np.int8)
    left, right = [], []
    for who, leaf in trie.search(group_counts(queries, groups), budget, budget * (not longer)):
        sizes = trie.bounds[leaf + 1] - trie.bounds[leaf]
        ends = np.cumsum(sizes)
        start = 0
        while start < len(who):  # words of the leaves, so many at once
            end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + HELD, side="right")))
            part = sizes[start:end]
            q = np.repeat(who[start:end], part)
            at = np.arange(len(q)) - np.repeat(np.cumsum(part) - part, part)
            w = trie.order[np.repeat(trie.bounds[leaf[start:end]], part) + at]
            if ordered:
                q, w = q[(keep := _less(queries, index, q, w))], w[keep]
            near = one_apart(queries[q], index[w])
            left.append(q[near])
            right.append(w[near])
            start = end
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate(left or [none]), np.concatenate(right or [none])


def _less(queries: np.ndarray, index: np.ndarray, q: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Whether the query comes before the word in code-point order."""
    a, b = queries[q], index[w]
    if not a.size:
        return np.zeros(len(a), dtype=bool)
    differs = a != b
    first = differs.argmax(axis=1)[:, None]
    return differs.any(axis=1) & (np.take_along_axis(a, first, 1) < np.take_along_axis(b, first, 1))[:, 0]


DEALT = "length int, code long, kind int, word string, n long"
FOUND = "word string, n_near long, best_n long, best string"
#: kind of a row: a word of the trie; a word that looks for longer ones; one that looks for its like here, or in another cell.
INDEX, LONGER, HERE, ELSEWHERE = 0, 1, 2, 3


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places in the batch, code points) of the words of each length."""
    words = batch.column("word")
    texts = words.to_pylist()
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    for length in np.unique(lengths).tolist():
        where = np.flatnonzero(lengths == length)
        step = max(1, SEARCH_CHARS // (length + 1))
        for i in range(0, len(where), step):
            part = where[i : i + step]
            yield length, part, code_points([texts[k] for k in part.tolist()], length)


def _measure(groups: Mapping[int, int]):
    """Cells of words at each depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, _, points in _by_length(batch):
                counts = group_counts(points, groups)
                for depth in DEPTHS:
                    codes, n = np.unique(cell_code(counts, depth), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), depth, np.int32)), pa.array(np.full(len(codes), length, np.int32)), pa.array(codes), pa.array(n)], names=["depth", "length", "code", "m"])

    return run


def _deal(groups: Mapping[int, int], depth: int):
    """Each word once for its own cell, and once for each cell in which it looks."""
    ways = moves(depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, where, points in _by_length(batch):
                code = cell_code(group_counts(points, groups), depth)
                take = pa.array(where)
                word, n = batch.column("word").take(take), batch.column("n").take(take)
                plan = [(length, INDEX, code)]
                for longer, change in ways:
                    kind = LONGER if longer else ELSEWHERE if any(change) else HERE
                    plan.append((length + longer, kind, moved(code, change)))
                for size, kind, cell in plan:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(cell), size, np.int32)), pa.array(cell), pa.array(np.full(len(cell), kind, np.int32)), word, n], names=["length", "code", "kind", "word", "n"]
                    )

    return run


def _groups_of(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Runs of rows that agree in ``by``; the rows come sorted."""
    held: list[pa.RecordBatch] = []
    mark = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in by]
        fresh = np.zeros(batch.num_rows, dtype=bool)
        fresh[0] = True
        for c in columns:
            fresh[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(fresh).tolist()
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            key = tuple(int(c[a]) for c in columns)
            if held and key != mark:
                yield pa.Table.from_batches(held)
                held = []
            mark = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _best(who: np.ndarray, other: np.ndarray, n: np.ndarray, texts: pa.Array, rank: np.ndarray) -> pa.RecordBatch:
    """For each word of ``who``: how many are near, and the one of largest n, of equals the first by code points."""
    order = np.lexsort((rank[other], -n[other], who))
    who, other = who[order], other[order]
    first = np.flatnonzero(np.concatenate(([True], who[1:] != who[:-1]))) if len(who) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(who)))
    return pa.RecordBatch.from_arrays(
        [texts.take(pa.array(who[first])), pa.array(sizes, pa.int64()), pa.array(n[other[first]], pa.int64()), texts.take(pa.array(other[first]))], names=["word", "n_near", "best_n", "best"]
    )


def _meet(groups: Mapping[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups_of(batches, ["length", "code", "block", "part"]):
            kind = table["kind"].to_numpy()
            n = table["n"].to_numpy()
            if not (kind == INDEX).any() or (kind == INDEX).all():
                continue
            length = int(table["length"][0].as_py())
            texts = table["word"].combine_chunks()
            words = texts.to_pylist()
            places = {k: np.flatnonzero(kind == k) for k in (INDEX, LONGER, HERE, ELSEWHERE)}
            index = code_points([words[i] for i in places[INDEX].tolist()], length)
            pairs = []
            for k in (LONGER, HERE, ELSEWHERE):
                if len(places[k]):
                    asks = code_points([words[i] for i in places[k].tolist()], length - (k == LONGER))
                    q, w = near_pairs(asks, index, groups, ordered=k == HERE)
                    pairs.append((places[k][q], places[INDEX][w]))
            a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
            if len(a):
                involved = np.unique(np.concatenate((a, b)))
                by_text = sorted(involved.tolist(), key=words.__getitem__)
                rank = np.zeros(len(words), dtype=np.int64)
                rank[by_text] = np.arange(len(by_text))
                # a word stands here once for each kind: count it under its first place
                first: dict[str, int] = {}
                same = np.arange(len(words))
                for i in by_text:
                    same[i] = first.setdefault(words[i], i)
                a, b = same[a], same[b]
                yield _best(np.concatenate((a, b)), np.concatenate((b, a)), n, texts, rank)

    return run


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words that have near ones; ``words`` is (word, n), each word once.

    Two words are near if they differ by exactly one inserted, deleted or replaced code point. Words
    are dealt out by length and by counts of a few coarse groups of letters, the first levels of a
    trie over all words; a word also goes to the cells that one letter more, or one for another, leads
    to. In a cell the trie goes on over the counts of all groups, a depth-first search spends a
    surplus of one and a deficit of one, and the words of the leaves are compared letter by letter.
    Cells with many words are cut into blocks of words and parts of searches that meet in pairs, so a
    task holds a bounded number of characters; what a block found is summed up before it moves.
    """
    groups = letter_groups(words)
    rows = words.select("word", F.col("n").cast("long").alias("n"))
    sizes = rows.mapInArrow(_measure(groups), "depth int, length int, code long, m long").groupBy("depth", "length", "code").agg(F.sum("m").alias("m"))
    largest = {r["depth"]: r["m"] for r in sizes.groupBy("depth").agg(F.max("m").alias("m")).collect()}
    depth = next((d for d in DEPTHS if largest.get(d, 0) <= CELL), DEPTHS[-1])
    dealt = cut(rows.mapInArrow(_deal(groups, depth), DEALT), "dealt")
    cells = dealt.groupBy("length", "code").agg(F.count(F.when(F.col("kind") == INDEX, 1)).alias("m"), F.count(F.when(F.col("kind") != INDEX, 1)).alias("asks"))
    wide = F.col("length") + 16
    # cells of more than TRIE_CHARS characters: no more of them than the table has such portions of text, so they fit a broadcast
    large = cells.where((F.col("m") > 0) & ((F.col("m") * wide > TRIE_CHARS) | (F.col("asks") * wide > SEARCH_CHARS))).select(
        "length", "code", F.ceil(F.col("m") * wide / TRIE_CHARS).cast("int").alias("blocks"), F.ceil(F.col("asks") * wide / SEARCH_CHARS).cast("int").alias("parts")
    )
    one = F.lit(1)
    met = dealt.join(F.broadcast(large), ["length", "code"], "left").withColumns({"blocks": F.coalesce("blocks", one), "parts": F.greatest(F.coalesce("parts", one), one)})
    home = F.xxhash64("word")
    span = lambda n: F.sequence(F.lit(0), n - 1)
    indexed = F.col("kind") == INDEX
    met = met.withColumn("block", F.explode(F.when(indexed, F.array(F.pmod(home, F.col("blocks")).cast("int"))).otherwise(span(F.col("blocks")))))
    met = met.withColumn("part", F.explode(F.when(indexed, span(F.col("parts"))).otherwise(F.array(F.pmod(home, F.col("parts")).cast("int")))))
    by = ["length", "code", "block", "part"]
    total = dealt.count()
    tasks = max(lanes(words.sparkSession), -(-total // 100_000))
    found = met.select(*by, "kind", "word", "n").repartition(tasks, *by).sortWithinPartitions(*by).mapInArrow(_meet(groups), FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))).alias("first")
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    near = cut(near.select("word", "n_near", (-F.col("first.less")).alias("best_n"), F.col("first.word").alias("best")), "near")
    discard(dealt)
    return near


def roots(links: DataFrame, longest: int) -> DataFrame:
    """(word, root) of links (word, form): the last word that following the forms leads to.

    Each round follows twice as many links, so ``longest`` links take its logarithm of rounds.
    """
    links = links.select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(1, longest))))):
        after = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        farther = cut(links.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        if hasattr(links, "cut_path"):
            discard(links)
        links = farther
    return links


def group_variants(words: DataFrame, factor: int = 10) -> DataFrame:
    """For each row of ``words`` (word, n; each word once): word, n, n_near, form, form_n, root.

    ``n_near`` counts the near words. ``form`` is the near word of largest n (of equals the smallest
    in code-point order), if that is ``factor`` times the word's n or more, else null; ``form_n`` is
    its n. ``root`` is where following forms from the word ends, itself without a form. ``factor`` is
    2 or more, so n grows along a chain and there are no rings.

    Null words and words without a count are left out; an empty word is near each word of one letter. Other
    columns are not read. An empty table gives an empty table. Memory of a task is bounded by blocks
    of words; very long words make smaller blocks.
    """
    if factor < 2:
        raise ValueError("factor is 2 or more")
    words = cut(words.where(F.col("word").isNotNull() & F.col("n").isNotNull()).select("word", F.col("n").cast("long").alias("n")), "words")
    near = near_words(words)
    is_form: Column = F.col("best_n") >= F.col("n") * factor
    formed = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")
    )
    formed = cut(formed, "formed")
    span = formed.where(F.col("form").isNotNull()).agg(F.min("n").alias("low"), F.max("form_n").alias("high")).first()
    longest = 0 if span["low"] is None else 1 + int(math.log(max(1, span["high"]) / max(1, span["low"]), factor))
    ends = roots(formed.where(F.col("form").isNotNull()).select("word", "form"), longest)
    return formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
