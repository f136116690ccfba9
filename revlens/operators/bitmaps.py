"""Mergeable exact distinct counts (A13): bitmaps over numbered ids.

Every id gets a number once, in a dictionary that only grows; a batch's ids are a set of
bits, in bitmaps of 32768 bits each. Bitmaps of several batches merge by OR, and
the distinct count is the number of set bits, without the ids.

Numbers are given in lanes (a hash of the id): a lane numbers its own new ids from where
it stopped and owns whole bitmaps, so that no task numbers all new ids and bitmaps
stay dense.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LANES = 64
BITS = 32768
IDS = "id string, number long, lane int"
MAPS = "bucket long, bits binary"


def lane_of(column: str, lanes: int):
    return F.pmod(F.xxhash64(column), F.lit(lanes)).cast("int")


def new_numbers(ids: DataFrame, known: DataFrame, lanes: int = LANES) -> DataFrame:
    """(id, number, lane) of those ``ids`` (column ``id``; repeats and NULLs ignored) that ``known`` lacks.

    ``known`` has the same columns. The lane's k-th id (from 0) is bit k % BITS of the lane's (k // BITS)-th bitmap.
    """
    fresh = (ids.filter("id is not null").select("id").distinct().join(known.select("id"), "id", "left_anti")
             .withColumn("lane", lane_of("id", lanes)))
    used = known.groupBy("lane").agg(F.count(F.lit(1)).alias("used"))
    place = F.row_number().over(Window.partitionBy("lane").orderBy("id")) - 1
    ranked = fresh.withColumn("place", place).join(F.broadcast(used), "lane", "left")  # at most one row a lane
    k = F.col("place") + F.coalesce("used", F.lit(0))
    whole = F.call_function("div", k, F.lit(BITS))
    return ranked.select("id", ((whole * lanes + F.col("lane")) * BITS + k % BITS).alias("number"), "lane")


def bitmaps(ids: DataFrame, numbered: DataFrame) -> DataFrame:
    """(bucket, bits) of the ids (column ``id``), by their numbers."""
    numbers = ids.filter("id is not null").select("id").distinct().join(numbered.select("id", "number"), "id").select("number")
    # Bit numbers start at 1 in Spark's bucket functions.
    bit = F.col("number") + 1
    return (numbers.groupBy(F.bitmap_bucket_number(bit).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")))


def merged(maps: DataFrame) -> DataFrame:
    return maps.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def distinct_count(maps: DataFrame):
    """One row: the exact number of different ids behind any number of bitmap parts."""
    return merged(maps).agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).alias("n"))
