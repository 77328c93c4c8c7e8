"""Names that texts mention, found by one automaton over all names."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A name stands as a word, or anywhere in the text.
WORD, ANYWHERE = "word", "anywhere"
#: Characters that make up words, as the bounds of words are told.
_IN_WORD = re.compile(r"[a-z0-9_]")
#: Characters of names in one automaton, which every worker holds; more names make more automata, and as many passes over the texts.
AUTOMATON_CHARS = 20_000_000


def first_word(company: Column, least: int = 4) -> Column:
    """A company's first word in lower case, if it has ``least`` letters or more."""
    word = F.split(F.lower(company), r"[\s,]+")[0]
    return F.when(F.char_length(word) >= least, word)


def company_names(companies: DataFrame, entity: str = "ticker", company: str = "company") -> DataFrame:
    """(entity, name, bound): the entities themselves as words, and the first words of their companies anywhere."""
    tickers = companies.select(F.col(entity).cast("string").alias("entity"), F.col(entity).cast("string").alias("name"), F.lit(WORD).alias("bound"))
    return tickers.unionByName(companies.select(F.col(entity).cast("string").alias("entity"), first_word(F.col(company)).alias("name"), F.lit(ANYWHERE).alias("bound")))


class Finder:
    """An automaton that walks each text once, whatever the number of names (Aho and Corasick's)."""

    def __init__(self, names: list[tuple[str, str, str]]) -> None:
        import ahocorasick

        self.found = ahocorasick.Automaton()
        known: dict[str, list[tuple[str, bool]]] = {}
        for entity, name, bound in names:
            known.setdefault(name, []).append((entity, bound == WORD))
        for name, entities in known.items():
            self.found.add_word(name, (len(name), entities))
        if known:
            self.found.make_automaton()

    def entities(self, text: str) -> set[str]:
        """Entities that a text in lower case names. Where a name begins or ends with a word character, a word bound is asked for there; else none is."""
        out: set[str] = set()
        if not len(self.found):
            return out
        for end, (size, entities) in self.found.iter(text):
            start, after = end - size + 1, end + 1
            bounded = None
            for entity, word in entities:
                if word and bounded is None:
                    before = text[start - 1] if start else ""
                    behind = text[after] if after < len(text) else ""
                    inside = lambda a, b: bool(a and b and _IN_WORD.match(a) and _IN_WORD.match(b))
                    bounded = not inside(before, text[start]) and not inside(text[end], behind)
                if not word or bounded:
                    out.add(entity)
        return out


def _scan(names, kind: T.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(names.value)
        for batch in batches:
            at, found = [], []
            for i, text in enumerate(batch.column("text")):
                mine = finder.entities(text.as_py() or "")
                at += [i] * len(mine)
                found += sorted(mine)
            yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at, pa.int64())), pa.array(found, pa.string())], names=["key", "entity"])

    return run


def entity_mentions(texts: DataFrame, names: DataFrame, text: str = "text", key: str = "doc_id", most: int = AUTOMATON_CHARS) -> DataFrame:
    """(key, entity) of each row of ``texts`` and each entity of ``names`` (entity, name, bound) that it mentions, once.

    Case does not count. With bound ``word`` a name is found where no letter a-z, digit or underscore goes
    on at its ends (so a ``$`` before it does not matter); with ``anywhere`` also inside words. Names may be of
    several words and hold any character; null and empty ones are left out, and null texts mention nothing.

    The names go to the workers as one automaton if they have at most ``most`` characters; more are dealt
    out by hash to as many automata as that takes, and the texts are read once for each. Texts
    are not shuffled.
    """
    spark = texts.sparkSession
    used = names.where(F.col("name").isNotNull() & (F.col("name") != "") & F.col("entity").isNotNull()).select(F.col("entity").cast("string").alias("entity"), F.lower("name").alias("name"), "bound").distinct()
    size = used.agg(F.coalesce(F.sum(F.char_length("name") + F.char_length("entity") + 16), F.lit(0))).first()[0]
    parts = max(1, -(-int(size) // most))
    kind = texts.select(key).schema[0].dataType
    schema = T.StructType([T.StructField("key", kind), T.StructField("entity", T.StringType())])
    rows = texts.select(F.col(key).alias("key"), F.lower(text).alias("text"))
    # names of one spelling stay together
    mine = used.withColumn("part", F.pmod(F.xxhash64("name"), F.lit(parts)))
    out = None
    for part in range(parts):
        held = spark.sparkContext.broadcast([(r["entity"], r["name"], r["bound"]) for r in mine.where(F.col("part") == part).collect()])
        found = rows.mapInArrow(_scan(held, kind), schema)
        out = found if out is None else out.unionByName(found)
    if parts > 1:  # an entity may be found by names of two parts
        out = out.withColumn("part", F.xxhash64("key", "entity")).dropDuplicates(["part", "key", "entity"]).drop("part")
    return out.withColumnRenamed("key", key)
