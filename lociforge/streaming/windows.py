"""Streaming forms: position tiles as they arrive, and windows over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociforge.operators.counting import N4


def counts_stream(reads: DataFrame, block: int = 5_000_000) -> DataFrame:
    """Running allele counts of each contig and block of positions, for a stream of bases (update or complete mode)."""
    return reads.groupBy("chr", F.floor((F.col("pos") + 1) / block).alias("block")).agg(*(F.count_if(F.col("base") == b).alias(N4[b]) for b in range(4)))


def event_windows(events: DataFrame, late: str = "10 minutes", size: str = "5 minutes", slide: str | None = None, ts: str = "ts") -> DataFrame:
    """Counts of loads in windows of event time; rows later than ``late`` behind the newest are left out and the state is bounded."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, late).groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def deduplicated(rows: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """Rows delivered again within the watermark are dropped."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def theta_windows_stream(sites: DataFrame, size: int, ts: str | None = None, late: str = "1 day") -> DataFrame:
    """Tumbling window sums of theta for a stream of sites: ``chr, win, tw, tp, n_sites`` (and ``ts`` below).

    The state is keyed by contig and window, so a contig's windows are spread over the cluster, and sites may arrive in any order.  Without
    ``ts`` (update or complete mode) each trigger gives the running sums of the windows it changed, the newest row of a window counts and
    nothing is ever left out.  With the event-time column ``ts`` (append mode) a window's sums come out once when nothing of it has arrived for
    ``late``, with their last time; sites that come after that form a further row of the window, to be added up by the reader, and
    only those later than ``late`` behind the newest of all are dropped.
    """
    win = F.floor(F.col("pos") / size).alias("win")
    sums = [F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("tw", "tp")] + [F.count(F.lit(1)).alias("n_sites")]
    if ts is None:
        return sites.groupBy("chr", win).agg(*sums)
    g = sites.withWatermark(ts, late).groupBy("chr", win, F.session_window(ts, late).alias("__s")).agg(*sums)
    return g.select("chr", "win", F.col("__s.end").alias("ts"), "tw", "tp", "n_sites")
