"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import WORD, cut, own_name

#: Ranks are cut into so many classes for each source; only the class at the edge is put in order.
CLASSES = 1 << 14


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """A row for each source of ``sizes(source, size)``: source_size and target.

    Sources in code-point order, null last, have the ``weights`` in turn and share ``share`` times
    all words by weight; a target stops at ``most`` times its source's words, and what it leaves goes
    to the others by weight. In order of words to weight the sources that stop come first, so running
    sums find them in one pass. The windows go over one row for each source.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    order = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.lit(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    found = by.withColumn("weight", weight).withColumn("level", level)
    full = F.col("level") * F.col("weight") >= F.lit(most) * F.col("source_size")
    found = found.withColumn("full", full)
    # ``level`` at the first source that does not stop holds for all that do not: it is the largest of theirs
    found = found.withColumn("shared", F.max(F.when(~F.col("full"), F.col("level"))).over(everything))
    target = F.when(F.col("full"), F.lit(float(most)) * F.col("source_size")).otherwise(F.col("shared") * F.col("weight"))
    return found.select("source", "source_size", target.cast("double").alias("target"))


def known_by(key: Column, text: Column) -> Column:
    """What a row draws its number by: its key, or without one its text, so that rows without key do not share a number."""
    return F.coalesce(key.cast("string"), F.concat(F.lit("null "), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))


def uniform(name: Column, seed: int) -> Column:
    """A number over 0 and under 1 from the md5 of the seed and the name: the same in every run."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(name.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def draw(docs: DataFrame, goals: DataFrame, most: int = 2, seed: int = 7, inclusion: str | None = None) -> DataFrame:
    """Copies of each row of ``docs(id, source, size)`` so that each source meets its target; a column ``name`` in place of id gives the random number.

    A document is expected ``c = target / source_size`` times (times its own weight over the mean one,
    up to ``most``, if a column ``inclusion`` is named). It is taken ``floor(c)`` whole times for
    certain. What remains of c is its inclusion probability p in a Pareto sample of fixed size, the
    words its source still lacks: documents are ranked by the odds of a random number over the odds
    of p, and taken by rank while their middle word is within that size.

    The ranks are cut into classes of equal width in rank / (1 + rank); sums of each class tell in
    which one the size is reached, and only its documents are put in order: no source, however
    large, meets in one task.
    """
    own = F.lit(1.0) if inclusion is None else F.greatest(F.coalesce(F.col(inclusion).cast("double"), F.lit(1.0)), F.lit(0.0))
    rows = docs.withColumn("own", own)
    if inclusion is not None:
        means = rows.groupBy(F.col("source").alias("its")).agg((F.sum(F.col("size") * F.col("own")) / F.sum("size")).alias("mean_own"))
        goals = goals.join(means, goals["source"].eqNullSafe(means["its"]), "left").drop("its")
    else:
        goals = goals.withColumn("mean_own", F.lit(1.0))
    goals = goals.select(F.col("source").alias("of_source"), "source_size", "target", "mean_own")
    rows = _with_source(rows, goals)
    c = F.least(F.lit(float(most)), F.coalesce(F.try_divide(F.col("target") * F.col("own"), F.col("source_size") * F.col("mean_own")), F.lit(0.0)))
    rows = rows.withColumn("expected", c).withColumn("sure", F.floor("expected").cast("long"))
    p = F.col("expected") - F.col("sure")
    u = uniform(F.col("name" if "name" in docs.columns else "id"), seed)
    odds = (u / (1 - u)) / (p / (1 - p))
    rows = rows.withColumn("rank", F.when((p > 0) & (F.col("size") > 0), odds))
    rows = rows.withColumn("class", F.floor(F.col("rank") / (1 + F.col("rank")) * F.lit(CLASSES)).cast("int"))
    rows = cut(rows, "ranked")

    sums = rows.groupBy("of_source", "source_size", "target", "class").agg(
        F.sum("size").alias("words"), F.sum(F.col("size") * F.col("sure")).alias("sure_words")
    )
    all_of = Window.partitionBy("of_source")
    upto = Window.partitionBy("of_source").orderBy("class").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("lack", F.col("target") - F.sum("sure_words").over(all_of)).where("class is not null")
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    edge = sums.where("before < lack and before + words >= lack").select(F.col("of_source").alias("s"), F.col("class").alias("edge"), "lack", "before")
    whole = sums.groupBy(F.col("of_source").alias("s")).agg(F.max("lack").alias("lack"))
    ends = whole.join(edge.drop("lack"), whole["s"].eqNullSafe(edge["s"]), "left").select(
        whole["s"].alias("end_source"), "lack", F.coalesce("edge", F.when(F.col("lack") > 0, F.lit(CLASSES + 1)).otherwise(F.lit(-1))).alias("edge"), F.coalesce("before", F.lit(0)).alias("before")
    )
    rows = _with_source(rows, ends.withColumnRenamed("end_source", "of_source"), "of_source", "left")
    at_edge = rows.where("class = edge")
    running = Window.partitionBy("of_source").orderBy("rank", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("before") + F.coalesce(F.sum("size").over(running), F.lit(0)) + F.col("size") / 2
    chosen = at_edge.withColumn("more", (middle <= F.col("lack")).cast("long"))
    rest = rows.where("class is null or class <> edge or edge is null").withColumn("more", F.when(F.col("class") < F.col("edge"), 1).otherwise(0).cast("long"))
    out = rest.unionByName(chosen)
    return out.withColumn("copies", F.col("sure") + F.col("more"))


#: Tables of sources up to so many rows are sent to all tasks (some MB); larger ones are joined with salt.
BROADCAST_SOURCES = 50_000
SALTS = 64


def _with_source(rows: DataFrame, sources: DataFrame, name: str = "source", how: str = "inner") -> DataFrame:
    """Join the table of sources to the rows: by broadcast after counting it, or with each source salted."""
    sources = cut(sources, "sources")
    other = sources.withColumnRenamed("of_source", "join_source")
    same = rows[name].eqNullSafe(other["join_source"])
    drop = ["join_source"]
    if sources.count() <= BROADCAST_SOURCES:
        out = rows.join(F.broadcast(other), same, how)
    else:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
        other = other.withColumn("its_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        out = rows.join(other, rows[name].eqNullSafe(other["join_source"]) & (rows["salt"] == other["its_salt"]), how)
        drop += ["salt", "its_salt"]
    if name == "source":
        return out.drop(*drop).withColumnRenamed("source", "of_source")
    return out.drop(*drop)


def plan_mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 7) -> DataFrame:
    """One row per document: key, ``size``, ``source_size``, ``target``, ``taken`` (words), ``copies``.

    Null text has size 0 and is never taken; null sources are one source; a row with a null key is ranked
    by its text; repeated rows share a rank and are taken in turn. An empty table gives an empty
    table. Other columns are not read.
    """
    return _planned(docs, text, key, source, weights, share, most, seed).select(F.col("id").alias(key), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def _planned(docs: DataFrame, text: str, key: str, source: str, weights: tuple[int, ...], share: float, most: int, seed: int) -> DataFrame:
    """``draw`` for all rows, which also have a mark of their text."""
    sizes = docs.select(F.col(key).alias("id"), known_by(F.col(key), F.col(text)).alias("name"), F.xxhash64(text).alias("mark"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    sizes = cut(sizes, "sizes")
    return draw(sizes, targets(sizes, weights, share, most), most, seed)


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 7) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken.

    Only keys, marks of texts and copies travel besides the rows. Rows are told apart by key, text and source; rows that
    repeat all three share the largest of their numbers of copies, which differ only where the sample ends among them.
    """
    mine, mark, of, often, nth = (own_name(docs, c) for c in ("its_key", "its_mark", "its_source", "its_copies", "nth_copy"))
    planned = _planned(docs, text, key, source, weights, share, most, seed).where("copies > 0")
    copies = planned.groupBy(F.col("id").alias(mine), F.col("mark").alias(mark), F.col("of_source").alias(of)).agg(F.max("copies").alias(often))
    same = docs[key].eqNullSafe(copies[mine]) & (F.xxhash64(docs[text]) == copies[mark]) & docs[source].eqNullSafe(copies[of])
    joined = docs.join(copies, same)
    return joined.withColumn(nth, F.explode(F.sequence(F.lit(1), copies[often].cast("int")))).select(*[docs[c] for c in docs.columns])
