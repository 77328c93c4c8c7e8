"""Exact duplicates by a tree-merge of sorted digest runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import SPACE, cut, lanes


def normalised(text: Column) -> Column:
    """Null as empty; each run of ASCII white space as one space (a lone space is left as it is)."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}{SPACE}+|[\\x09-\\x0D]", " ")


RUN = "lane int, short long, digest binary, keep_id {key}, n long"


def run_of(records: DataFrame, n_lanes: int) -> DataFrame:
    """The sorted run of each lane of ``records(lane, short, digest, keep_id, n)``, one record for each text.

    Runs that arrive in a lane are put in order by (short digest, digest, key) and merged as a stream:
    records meet by the short digest and are verified by the whole one; of equal ones the first, which
    has the smallest key, and the number of rows stay. A task holds a batch of records at a time.
    """
    key = records.schema["keep_id"].dataType
    ordered = records.repartition(n_lanes, "lane").sortWithinPartitions("lane", "short", "digest", F.col("keep_id").asc_nulls_last())

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the last record so far, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.table(batch.columns, names=batch.schema.names)
            if held is not None:
                table = pa.concat_tables([held, table])
            lane, short = table["lane"].to_numpy(), table["short"].to_numpy()
            near = (lane[1:] == lane[:-1]) & (short[1:] == short[:-1])
            digests = table["digest"]
            same = near & pc.equal(digests[1:], digests[:-1]).to_numpy(zero_copy_only=False)
            first = np.flatnonzero(np.concatenate(([True], ~same)))
            out = table.take(first).set_column(4, "n", pa.array(np.add.reduceat(table["n"].to_numpy(), first)))
            held = out.slice(out.num_rows - 1)
            yield from out.slice(0, out.num_rows - 1).combine_chunks().to_batches()
        if held is not None:
            yield from held.combine_chunks().to_batches()

    return ordered.mapInArrow(merge, RUN.format(key=key.simpleString()))


def duplicate_groups(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Find the group of equal texts of every row.

    Every partition of the input is a lane; a lane sorts the digests of its rows into a run with one
    record for each text. Then come binomial rounds: in round r a lane and the lane whose number
    differs in bit r exchange halves of their runs, each keeps the digests whose bit r is its own, and
    the two sorted runs are merged (``run_of``). After the last round each lane holds the texts whose
    digest ends in its number, complete. No lane ever holds all digests, and the records of a text
    held by a third of all rows shrink to one for each lane before lanes exchange anything. Answers
    return by (lane of the row, digest), so that such a text is dealt out over all lanes there too.

    Returns one row per input row: the key, ``keep_id`` (smallest key of its group), ``group_size``,
    ``kept``, ``text_sha256``.

    Null text counts as empty text. Rows with a null key take part, wherever they lie; they are kept
    only if no row of their group has a key, and then ``keep_id`` is null. Rows repeated with one key
    and text are all kept if that key is the smallest: pass ``repeats`` away in the caller (see
    ``drop_duplicates``). An empty table gives an empty table. Columns other than the two named are
    not read.
    """
    n = lanes(docs.sparkSession)
    rounds = max(1, (n - 1).bit_length())
    digests = cut(
        docs.select(F.col(key).alias("id"), F.sha2(normalised(F.col(text)).cast("binary"), 256).alias("hex"))
        .select("id", F.unhex("hex").alias("digest"))
        .withColumn("home", F.pmod(F.spark_partition_id(), F.lit(1 << rounds)).cast("int"))
        .withColumn("short", F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("long")),
        "digests",
    )
    rows = digests.select(F.col("home").alias("lane"), "short", "digest", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
    local = cut(run_of(rows, n), "runs")
    runs = local
    for r in range(rounds):
        bit = F.lit(1 << r)
        partner = F.col("lane").bitwiseOR(bit) - bit + F.col("short").bitwiseAND(bit).cast("int")
        runs = run_of(runs.withColumn("lane", partner.cast("int")), n)
    answers = (
        local.select(F.col("lane").alias("home"), "short", "digest")
        .join(runs.select("short", "digest", "keep_id", "n"), ["short", "digest"])
        .withColumnRenamed("n", "group_size")
    )
    return digests.join(answers, ["home", "short", "digest"]).select(
        F.col("id").alias(key),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, all columns, that stay: one of each group of equal texts.

    Of rows that repeat a key with the same text one stays, the first by the other columns; the rest
    is as in ``duplicate_groups``. The texts move once, to the tickets (key and digest) of those that
    stay; repeats of a row meet in the same partition.
    """
    kept = duplicate_groups(docs, text, key).where("kept").select(_ticket(F.col(key), F.col("text_sha256")).alias("ticket")).distinct()
    names = docs.columns
    rows = docs.select(
        *[docs[c].alias(f"c{i}") for i, c in enumerate(names)],
        _ticket(docs[key], F.sha2(normalised(docs[text]).cast("binary"), 256)).alias("ticket"),
    )
    order = [F.col(f"c{i}") for i, f in enumerate(docs.schema) if f.name != text and f.dataType.typeName() not in ("map", "variant")]
    order.append(F.col(f"c{names.index(text)}"))
    first = rows.join(kept, "ticket", "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy("ticket").orderBy(*order)))
    return first.where("nth = 1").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def _ticket(key: Column, digest: Column) -> Column:
    return F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(":"), digest).cast("binary"))
