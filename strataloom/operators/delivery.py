"""Exactly-once view of at-least-once deliveries (problem 5).

Only the identifier, the delivery order and the position of a row in its file are shuffled. The rows that lose
become deletion vectors, one bitmap for each block of 32,768 rows of a file in which a row loses; the wide rows are then read once more and
filtered by the vectors of their own file, without being shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut

#: Names that no table's column should have; a table with one of them is refused.
FILE, ROW, BLOCK, GONE = "__sl_file", "__sl_row", "__sl_block", "__sl_gone"
#: Readers write the slashes after a scheme in different numbers.
SLASHES = r"^(\w+):/+"
BLANK = r"(?U)^\s+|\s+$"


def normal_id(c: str | Column) -> Column:
    """An identifier part without letter case and outer white space; null where nothing is left."""
    x = F.lower(F.regexp_replace(F.col(c) if isinstance(c, str) else c, BLANK, ""))
    return F.when(x != "", x)


def _same(file: str) -> str:
    return re.sub(SLASHES, r"\1:/", file)


def _positions(df: DataFrame) -> DataFrame:
    return df.withColumns({FILE: F.regexp_replace("_metadata.file_path", SLASHES, "$1:/"), ROW: F.col("_metadata.row_index") + 1})


def deletion_vectors(src: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(FILE, BLOCK, GONE): the rows that aren't kept, a bitmap for each block of a file that has a surplus row; a block without one has no vector.

    The earliest row of a key wins by `order` (nulls last), then by file and row, so that ties and repeated rows
    leave exactly one copy. The minimum is combined before the shuffle: a key that holds a third of all rows sends
    one row from each task. The messages of each block are counted where they are read.
    """
    ident = F.array(*[normal_id(k) for k in keys])
    narrow = _positions(src.select(*dict.fromkeys([*keys, *order]), "_metadata")).where(~F.exists(ident, lambda x: x.isNull()))
    rank = F.struct(*[x for o in order for x in (F.col(o).isNull().alias(f"n_{o}"), F.col(o).alias(f"o_{o}"))], FILE, ROW)
    winners = narrow.groupBy(ident.alias("k")).agg(F.min(rank).alias("w")).select(f"w.{FILE}", f"w.{ROW}")
    block = F.expr("bitmap_bucket_number(__sl_row)").alias(BLOCK)
    kept = winners.groupBy(FILE, block).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(__sl_row))").alias("kept"), F.count("*").alias("n_kept"))
    messages = _positions(src.select(*keys, "_metadata")).where(~F.exists(ident, lambda x: x.isNull())).groupBy(FILE, block).agg(F.count("*").alias("n"))
    # Every bit the other way round: each digit of the hexadecimal form becomes its complement.
    gone = F.unhex(F.translate(F.hex("kept"), "0123456789ABCDEF", "FEDCBA9876543210"))
    every = F.unhex(F.repeat(F.lit("F"), F.lit(8192)))
    lost = messages.join(kept, [FILE, BLOCK], "left").where(F.coalesce("n_kept", F.lit(0)) < F.col("n"))
    return lost.select(FILE, BLOCK, F.coalesce(gone, every).alias(GONE))


def _bit(row: Column) -> Column:
    """The bit of a row in column GONE; null: false."""
    at = F.expr("bitmap_bit_position(__sl_row)")
    byte = F.conv(F.hex(F.expr("substring(__sl_gone, cast(bitmap_bit_position(__sl_row) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))


def split_deliveries(
    spark: SparkSession,
    path: str,
    keys: Sequence[str] = ("job_id", "owner", "repo"),
    order: Sequence[str] = ("received_at", "delivery_id"),
    columns: Sequence[str] | None = None,
    broadcast_bytes: int = 64 << 20,
) -> DataFrame:
    """All rows of the Parquet table at `path` (its `columns`) with `delivery_state`: 'kept' (first delivery of its message),
    'surplus' (a later one), or 'no message' (a part of the key is null or blank).

    A vector is 4 KB for 32,768 rows. Where those of all files stay under `broadcast_bytes` the table is read in
    one scan; beyond that, files are read in lots whose vectors stay under it, one scan each. Nothing else is
    broadcast, and no wide row is shuffled. An empty table gives an empty result; extra columns pass through, but for one named delivery_state, which is replaced.
    """
    src = spark.read.parquet(path)
    cols = list(columns or [c for c in src.columns if c != "delivery_state"])
    if {FILE, ROW, BLOCK, GONE} & set(src.columns):
        raise ValueError("a column has one of the names that this operator needs")
    vectors = cut(deletion_vectors(src, keys, order))
    ids = F.array(*[normal_id(k) for k in keys])

    def apply(part: DataFrame, v: DataFrame) -> DataFrame:
        wide = _positions(part.select("*", "_metadata")).withColumn(BLOCK, F.expr("bitmap_bucket_number(__sl_row)"))
        state = F.when(F.exists(ids, lambda x: x.isNull()), "no message").when(_bit(F.col(ROW)), "surplus").otherwise("kept")
        return wide.join(F.broadcast(v), [FILE, BLOCK], "left").select(*cols, state.alias("delivery_state"))

    sizes = vectors.groupBy(FILE).agg((F.count("*") * 4200).alias("b"))
    total = sizes.agg(F.sum("b"), F.max("b")).first()
    if (total[0] or 0) <= broadcast_bytes:
        return apply(src, vectors)
    # Beyond the bound: files in lots. Only file names come to the driver, which lists them anyway.
    known, lots, room = {r[0]: r[1] for r in sizes.toLocalIterator()}, [[]], broadcast_bytes
    for f in src.inputFiles():
        need = known.get(_same(f), 0)
        if lots[-1] and need > room:
            lots.append([])
            room = broadcast_bytes
        lots[-1].append(f)
        room -= need
    out = None
    for lot in lots:
        one = apply(spark.read.schema(src.schema).parquet(*lot), vectors.where(F.col(FILE).isin([_same(f) for f in lot])))
        out = one if out is None else out.unionAll(one)
    return out
