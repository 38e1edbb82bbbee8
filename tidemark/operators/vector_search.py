"""Filtered vector search over segments, coarse then fine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import vectors
from tidemark.operators import search_blocks

OVERSAMPLE, NORM_TOLERANCE = 10, 1e-3
#: Share of a segment that the second stage scores at least.
COARSE_SHARE = 0.2


def row_filter(rooms: list | None = None, senders: list | None = None, time: tuple[int, int] | None = None) -> Column:
    """A conjunction; what isn't asked for doesn't filter. Plain comparisons, which reach the scan."""
    out = F.lit(True)
    if rooms is not None:
        out = out & F.col("room_id").isin(*rooms) if rooms else F.lit(False)
    if senders is not None:
        out = out & (F.col("sender").isin(*senders) if senders else F.lit(False))
    if time is not None:
        out = out & F.col("timestamp").between(*time)
    return out


def top_k(rows: DataFrame, score: Column, k: int, row: str = "row") -> DataFrame:
    """The k best rows by falling score, ties by the lower row; all rows if there are fewer."""
    return rows.withColumn("score", score).orderBy(F.col("score").desc(), row).limit(k)


def _asked(rows: DataFrame, where: Column | None, model: str | None) -> DataFrame:
    if model is not None:
        same = F.when(F.col("model") == model, True).otherwise(F.raise_error(F.lit("a segment has vectors of another model")).cast("boolean"))
        rows = rows.where(same)
    return rows if where is None else rows.where(where)


def search(rows: DataFrame, query: list[float], k: int, where: Column | None = None, model: str | None = None, metric: str = "cosine", oversample: int = OVERSAMPLE, coarse: str | None = None, share: float = COARSE_SHARE) -> DataFrame:
    """segment, row, event_id, score of the k best rows, by score, then segment, then row.

    With a ``coarse`` column (1-bit forms) each segment's best rows by shared bits are scored
    exactly: k * oversample of them, or ``share`` of the segment where that is more, so that recall
    doesn't fall as segments grow. Rows of another model are an error, not a miss.
    """
    rows = _asked(rows, where, model)
    q = vectors.literal(query)
    if coarse is not None:
        rows = rows.withColumn("_coarse", vectors.hamming(F.col(coarse), vectors.quantize_u1(q)))
        best = Window.partitionBy("segment").orderBy(F.col("_coarse").desc(), "row")
        size = F.count("*").over(Window.partitionBy("segment"))
        rows = rows.withColumn("_size", size).withColumn("_nth", F.row_number().over(best)).where(F.col("_nth") <= F.greatest(F.lit(k * max(oversample, 1)), F.ceil(F.col("_size") * share)))
    scored = rows.select("segment", "row", "event_id", vectors.SCORES[metric](F.col("embedding"), q).alias("score"))
    return scored.orderBy(F.col("score").desc(), "segment", "row").limit(k)


def search_all(rows: DataFrame, queries: DataFrame, k: int, where: Column | None = None, model: str | None = None, metric: str = "cosine", oversample: int = OVERSAMPLE, coarse: str | None = None, share: float = COARSE_SHARE) -> DataFrame:
    """q, segment, row, event_id, score: what ``search`` gives for each of the queries (q, embedding),
    whose q are distinct, in one job however many they are. Vectors are finite and all of one length;
    others raise an error."""
    return search_blocks.search(_asked(rows, where, model), queries, k, metric, k * max(oversample, 1), coarse, share)


def rescore(rows: DataFrame, wanted: DataFrame, query: list[float], metric: str = "cosine") -> DataFrame:
    """Exact scores of the given (segment, row) pairs."""
    return rows.join(wanted.select("segment", "row"), ["segment", "row"], "left_semi").select("segment", "row", vectors.SCORES[metric](F.col("embedding"), vectors.literal(query)).alias("score"))


def segment_stats(rows: DataFrame) -> DataFrame:
    return rows.groupBy("segment").agg(F.min("room_id").alias("min_room"), F.max("room_id").alias("max_room"), F.min("sender").alias("min_sender"), F.max("sender").alias("max_sender"), F.min("timestamp").alias("min_time"), F.max("timestamp").alias("max_time"))


def prune_segments(stats: DataFrame, rooms: list | None = None, senders: list | None = None, time: tuple[int, int] | None = None) -> DataFrame:
    """Segments that can hold a match; where a filter is set, missing statistics mean no match."""
    keep = F.lit(True)
    for values, low, high in ((rooms, "min_room", "max_room"), (senders, "min_sender", "max_sender")):
        if values is not None:
            any_ = F.lit(False)
            for v in values:
                any_ = any_ | ((F.col(low) <= F.lit(v)) & (F.col(high) >= F.lit(v)))
            keep = keep & any_
    if time is not None:
        keep = keep & (F.col("min_time") <= time[1]) & (F.col("max_time") >= time[0])
    return stats.where(F.coalesce(keep, F.lit(False)))


def centroids(rows: DataFrame, by: str = "segment", metric: str = "cosine") -> DataFrame:
    """The mean vector of each group, normalized for cosine; a zero mean is empty."""
    places = rows.select(by, F.posexplode("embedding").alias("_i", "_x")).groupBy(by, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"))
    mean = places.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("centroid"))
    if metric != "cosine":
        return mean
    zero = vectors.norm("centroid") == 0
    return mean.withColumn("centroid", F.when(zero, F.array().cast("array<double>")).otherwise(vectors.normalized("centroid")))


def nearest_segments(means: DataFrame, query: list[float], n: int, metric: str = "cosine", by: str = "segment") -> DataFrame:
    """The n segments whose centroids score best; one without a centroid comes first."""
    q = vectors.literal(query)
    score = F.when(F.size("centroid") > 0, vectors.SCORES[metric](F.col("centroid"), q)).otherwise(F.lit(float("inf")))
    return means.select(by, score.alias("score")).orderBy(F.col("score").desc(), by).limit(n)


def to_reembed(segments: DataFrame, current: str) -> DataFrame:
    return segments.where(~F.col("model").eqNullSafe(F.lit(current))).select("segment").distinct()


def merged(parts: list[DataFrame]) -> DataFrame:
    """Segments one after another, rows renumbered in order; other columns or models are refused."""
    if any(p.schema != parts[0].schema for p in parts[1:]):
        raise ValueError("segments have different columns")
    models = None
    for p in parts:
        m = p.select("model").distinct()
        models = m if models is None else models.unionByName(m).distinct()
    if models.limit(2).count() > 1:
        raise ValueError("segments have different models")
    sizes = [p.count() for p in parts]
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("row", F.col("row") + sum(sizes[:i]))
        out = p if out is None else out.unionByName(p)
    return out


def checked(rows: DataFrame, dimension: int, metric: str = "cosine") -> DataFrame:
    """Rows that may be written: finite values of the right width, of unit length for cosine. Any
    other row raises an error when it is read."""
    finite = F.forall("embedding", lambda x: ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ok = (F.size("embedding") == dimension) & finite
    if metric == "cosine":
        ok = ok & (F.abs(vectors.norm("embedding") - 1) <= NORM_TOLERANCE)
    return rows.where(F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(F.lit("a vector is not fit to be stored")).cast("boolean")))


def fetch(rows: DataFrame, segment, row: int, n: int | None = None, element: str = "f32") -> DataFrame:
    """One stored vector, or its first n elements."""
    v = F.col("embedding") if n is None else vectors.prefix("embedding", n, element)
    return rows.where((F.col("segment") == segment) & (F.col("row") == row)).select("event_id", v.alias("embedding"))
