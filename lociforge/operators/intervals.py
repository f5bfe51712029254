"""Covered periods and gaps of overlapping, nested and gapped intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Width of the coordinate tiles that split a hot key.  After the map-side merge a tile holds at most half as many disjoint
#: sessions as it has coordinates, so this bounds what one task sees of one key, however many rows the key owns.
TILE = 1 << 22


def clean_regions(regions: DataFrame, contigs: DataFrame) -> DataFrame:
    """``list_id, ref_id, reg_start, reg_stop`` as valid half-open intervals inside their contig.

    A null or negative start becomes 0, a null stop or one beyond the contig the contig's length; rows of unknown (or null)
    contigs and rows that are empty after that are dropped.  A contig without a length cannot close an open interval: a null
    stop there is dropped, other stops stay.  Repeated deliveries need no care, coverage is idempotent.
    """
    known = contigs.where("ref_id is not null").groupBy("ref_id").agg(F.max("length").alias("__len"))
    start = F.greatest(F.coalesce(F.col("reg_start"), F.lit(0)), F.lit(0))
    stop = F.least(F.col("reg_stop").cast("bigint"), F.col("__len"))
    return (
        regions.select("list_id", "ref_id", "reg_start", "reg_stop")
        .join(known, "ref_id")
        .select("list_id", "ref_id", start.cast("bigint").alias("reg_start"), stop.alias("reg_stop"))
        .where("reg_stop > reg_start")
    )


def merging_locally(spark: SparkSession) -> None:
    """Lets the session merge interval sessions before the shuffle as well: for applications whose data are all merged this way."""
    spark.conf.set("spark.sql.sessionWindow.merge.sessions.in.local.partition", "true")


def periods_and_gaps(df: DataFrame, keys: list[str], start: str, stop: str, tile: int = TILE) -> DataFrame:
    """Maximal covered periods of each key, and the gaps between consecutive ones: ``keys..., kind, start, stop``.

    ``start`` and ``stop`` are whole numbers, half open.  Intervals that overlap or touch belong to one period; rows whose
    start or stop is null or whose stop isn't beyond their start are ignored; null keys form a group of their own; an empty
    input gives an empty result; columns other than keys, start and stop are ignored.

    Each interval is a session that starts at ``start`` and lasts ``stop - start``: ``session_window`` with this
    row-specific gap merges what overlaps.  Sessions are merged per (key, tile of the start), so a
    key that owns a third of all rows is spread over its tiles.  A summary of one row per tile carries the reach of
    earlier tiles and the next tile's first start; with it, touching or tile-crossing sessions are stitched, and ``lead``
    gives the gaps.  Sessions are merged before the shuffle, too, if the session's option for that is on (``merging_locally``).
    """
    s, e = F.col("__s"), F.col("__e")
    rows = df.select(*keys, F.col(start).cast("bigint").alias("__s"), F.col(stop).cast("bigint").alias("__e")).where("__e > __s")
    rows = rows.withColumn("__tile", F.floor(s / F.lit(tile)))
    lasts = F.make_interval(secs=((e - s).cast("decimal(18,0)") / 1_000_000).cast("decimal(18,6)"))
    by = [*keys, "__tile"]
    merged = (
        rows.withColumn("__t", F.timestamp_micros(s))
        .groupBy(*by, F.session_window("__t", lasts).alias("__w"))
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(*by, F.unix_micros("__w.start").alias("__s"), F.unix_micros("__w.end").alias("__e"))
    )
    in_tile = Window.partitionBy(*by).orderBy("__s")
    upto = in_tile.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = merged.withColumns({"__before": F.lag("__e").over(in_tile), "__next": F.lead("__s").over(in_tile)})
    opens = F.when(F.col("__before").isNull() | (s > F.col("__before")), s)
    tiles = local.groupBy(*by).agg(F.min("__s").alias("__first"), F.max("__e").alias("__reach"), F.max(opens).alias("__open"))
    over_tiles = Window.partitionBy(*keys).orderBy("__tile")
    earlier = over_tiles.rowsBetween(Window.unboundedPreceding, -1)
    tiles = tiles.withColumns({"__carry": F.max("__reach").over(earlier), "__next_first": F.lead("__first").over(over_tiles)})
    really = F.when(F.col("__carry").isNull() | (F.col("__open") > F.col("__carry")), F.col("__open"))
    tiles = tiles.withColumn("__begun", F.last(really, ignorenulls=True).over(earlier))
    there = [F.col(f"l.{k}").eqNullSafe(F.col(f"t.{k}")) for k in by]
    both = local.alias("l").join(tiles.alias("t"), there).select("l.*", "t.__carry", "t.__next_first", "t.__begun")
    so_far, reach = F.greatest("__before", "__carry"), F.greatest("__e", "__carry")
    opening = F.when(so_far.isNull() | (s > so_far), s)
    then = F.coalesce("__next", "__next_first")
    both = both.select(*keys, F.coalesce(F.max(opening).over(upto), "__begun").alias("__from"), reach.alias("__to"), then.alias("__then"))
    closed = both.where(F.col("__then").isNull() | (F.col("__then") > F.col("__to")))

    def piece(kind: str, a: Column, b: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), a.alias(start), b.alias(stop))

    pieces = F.array(piece("period", F.col("__from"), F.col("__to")), piece("gap", F.col("__to"), F.col("__then")))
    return closed.select(*keys, F.explode(pieces).alias("__p")).select(*keys, "__p.*").where(F.col(stop).isNotNull())
