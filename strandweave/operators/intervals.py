"""Interval algebra on 1-based closed coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import running

# Width of an order bucket for coordinate scans. A read or protein fits in one bucket, so nothing
# is carried; only contig-sized coordinates are split further.
COORDINATE_BUCKET = 4096


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def contains_point(start, end, point) -> Column:
    """``start <= point <= end``; false, never null, when a coordinate is missing."""
    return F.coalesce(_col(point).between(_col(start), _col(end)), F.lit(False))


def overlaps_window(start, end, low, high) -> Column:
    return F.coalesce((_col(start) <= high) & (_col(end) >= low), F.lit(False))


def any_overlap(segments, low, high) -> Column:
    """Whether any (start, end) of an array touches the window."""
    return F.exists(_col(segments), lambda s: (s["start"] <= high) & (s["end"] >= low))


def merge_intervals(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", touching: bool = True,
                    bucket_width: int = COORDINATE_BUCKET) -> DataFrame:
    """Union of intervals per key -> (keys, seg_start, seg_end, n_intervals).

    Equal starts are collapsed map-side first, so the scan sees at most one row per coordinate.
    ``touching`` merges ``[1,3]`` with ``[4,6]``. Rows of a missing key are one key; rows without a start
    are a row of their own and part of no segment.
    """
    gap = 1 if touching else 0
    # A struct of the keys is never null itself, so a missing key finds its carry in the join of ``running``.
    base = (
        df.groupBy(F.struct(*keys).alias("_k"), F.col(start).alias("_s"))
        .agg(F.max(end).alias("_e"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_b", F.floor(F.col("_s") / bucket_width))
    )
    placed = F.when(F.col("_s").isNotNull(), F.col("_e"))
    seen = running(base, ["_k"], "_b", ["_s"], "_reach", "max", placed, inclusive=False)
    opens = seen.withColumn(
        "_open", F.when(F.col("_reach").isNull() | (F.col("_s") > F.col("_reach") + gap), F.col("_s"))
    )
    seg = running(opens, ["_k"], "_b", ["_s"], "seg_start", "max", F.col("_open"))
    merged = seg.groupBy("_k", "seg_start").agg(F.max("_e").alias("seg_end"), F.sum("_n").alias("n_intervals"))
    return merged.select("_k.*", "seg_start", "seg_end", "n_intervals")


def merge_within(df: DataFrame, keys: list[str], start: str, end: str, name: str) -> DataFrame:
    """Merged segments as an array per key, for keys whose coordinates are short (a read, a protein).

    Equal starts collapse map-side, so an array has at most one entry per coordinate however many
    intervals share the key. Returns (keys, ``name``, n_intervals).
    """
    collapsed = df.groupBy(*keys, F.col(start).alias("_s")).agg(F.max(end).alias("_e"), F.count(F.lit(1)).alias("_n"))
    points = F.array_sort(F.collect_list(F.struct(F.col("_s").alias("start"), F.col("_e").alias("end"))))
    out = collapsed.groupBy(*keys).agg(points.alias("_p"), F.sum("_n").alias("n_intervals"))

    return out.select(*keys, merged_segments(F.col("_p")).alias(name), "n_intervals")


def merged_segments(points: Column) -> Column:
    """Array of (start, end) sorted by start -> array of disjoint, non-touching segments."""

    def step(acc, x):
        last = F.element_at(acc, -1)
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))
        return F.when(x["start"] <= last["end"] + 1, joined).otherwise(F.concat(acc, F.array(x)))

    merged = F.aggregate(F.slice(points, 2, F.size(points)), F.slice(points, 1, 1), step)
    return F.when(F.size(points) == 1, points).otherwise(merged)


def uncovered_intervals(df: DataFrame, keys: list[str], lengths: DataFrame, length: str, start: str = "start", end: str = "end",
                        bucket_width: int = COORDINATE_BUCKET) -> DataFrame:
    """Maximal uncovered runs of 1..length per key, straight from the intervals: no position is listed.

    A point before and one behind the range are added as intervals, so leading, trailing and
    wholly uncovered ranges come out of the same gap rule.
    """
    sized = lengths.select(*keys, F.col(length).cast("long").alias("_len"))
    combined = df.groupBy(*keys, start).agg(F.max(end).alias(end))  # a row for each start before the join
    inside = (
        combined.join(sized, keys)
        .select(*keys, F.greatest(F.lit(1), F.col(start)).cast("long").alias("_s"), F.least(F.col("_len"), F.col(end)).cast("long").alias("_e"))
        .filter(F.col("_s") <= F.col("_e"))
    )
    rim = lambda p: F.struct(p.cast("long").alias("_s"), p.cast("long").alias("_e"))
    rims = sized.select(*keys, F.inline(F.array(rim(F.lit(0)), rim(F.col("_len") + 1))))
    base = inside.unionByName(rims).groupBy(*keys, "_s").agg(F.max("_e").alias("_e")).withColumn("_b", F.floor(F.col("_s") / bucket_width))
    seen = running(base, keys, "_b", ["_s"], "_reach", "max", F.col("_e"), inclusive=False)
    gaps = seen.filter(F.col("_s") > F.col("_reach") + 1)
    return gaps.select(
        *keys, (F.col("_reach") + 1).alias("start"), (F.col("_s") - 1).alias("end"), (F.col("_s") - F.col("_reach") - 1).alias("length")
    )


def covered_length(segments: DataFrame, keys: list[str]) -> DataFrame:
    return segments.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_segments"), F.sum(F.col("seg_end") - F.col("seg_start") + 1).alias("covered_len")
    )


def islands(df: DataFrame, keys: list[str], position: str, bucket_width: int = COORDINATE_BUCKET) -> DataFrame:
    """Maximal runs of consecutive positions -> (keys, start, end, length)."""
    unit = df.select(*keys, F.col(position).alias("start"), F.col(position).alias("end"))
    return merge_intervals(unit, keys, bucket_width=bucket_width).select(
        *keys,
        F.col("seg_start").alias("start"),
        F.col("seg_end").alias("end"),
        (F.col("seg_end") - F.col("seg_start") + 1).alias("length"),
    )


def _edges(df: DataFrame, keys: list[str], lengths: DataFrame, length: str, start: str, end: str) -> DataFrame:
    """(keys, position, _len, _d): signed rows of interval starts and ends, combined by coordinate."""
    edges = df.filter(F.greatest(F.lit(1), F.col(start)) <= F.col(end)).select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.greatest(F.lit(1), F.col(start)).cast("long").alias("position"), F.lit(1).cast("long").alias("_d")),
                F.struct((F.col(end) + 1).cast("long").alias("position"), F.lit(-1).cast("long").alias("_d")),
            )
        ),
    )
    # Combined before the join: a key brings at most a row for each coordinate. Edges beyond the length change nothing inside.
    return (
        edges.groupBy(*keys, "position").agg(F.sum("_d").alias("_d"))
        .join(lengths.select(*keys, F.col(length).alias("_len")), keys)
        .filter(F.col("position") <= F.col("_len")).select(*keys, "position", "_len", "_d")
    )


def depth(df: DataFrame, keys: list[str], lengths: DataFrame, length: str, start: str = "start", end: str = "end",
          bucket_width: int = COORDINATE_BUCKET) -> DataFrame:
    """Support depth of every position 1..length per key -> (keys, position, depth).

    Two signed rows per interval are summed per position map-side, the spine of positions joins
    the same aggregation with weight 0, and one running sum gives the depth.
    """
    signed = _edges(df, keys, lengths, length, start, end).select(*keys, "position", "_d")
    spine = lengths.select(
        *keys, F.explode(F.sequence(F.lit(1).cast("long"), F.col(length).cast("long"))).alias("position"), F.lit(0).cast("long").alias("_d")
    )
    step = (
        signed.unionByName(spine)
        .groupBy(*keys, "position")
        .agg(F.sum("_d").alias("_d"))
        .withColumn("_b", F.floor(F.col("position") / bucket_width))
    )
    return running(step, keys, "_b", ["position"], "depth", "sum", F.col("_d")).select(*keys, "position", "depth")


def depth_runs(df: DataFrame, keys: list[str], lengths: DataFrame, length: str, start: str = "start", end: str = "end",
               bucket_width: int = COORDINATE_BUCKET) -> DataFrame:
    """Runs of equal depth over positions 1..length per key -> (keys, position, n, depth), ``n`` positions from ``position`` on.

    The same as ``depth`` without a row per position: a run goes from an edge to the next, and a row of weight 0 opens each
    bucket, so no run leaves its bucket."""
    signed = _edges(df, keys, lengths, length, start, end).withColumn("_len", F.col("_len").cast("long"))
    width = F.col("_len").cast("long")
    buckets = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(width / bucket_width))).alias("_b")
    rims = lengths.select(*keys, F.col(length).alias("_len")).filter(width >= 1).select(*keys, width.alias("_len"), buckets)
    rims = rims.select(*keys, F.greatest(F.lit(1).cast("long"), F.col("_b") * bucket_width).alias("position"), "_len", F.lit(0).cast("long").alias("_d"))
    step = (
        signed.unionByName(rims)
        .groupBy(*keys, "position")
        .agg(F.sum("_d").alias("_d"), F.max("_len").alias("_len"))
        .withColumn("_b", F.floor(F.col("position") / bucket_width))
    )
    behind = F.least((F.col("_b") + 1) * bucket_width, F.col("_len") + 1)
    following = F.lead("position").over(Window.partitionBy(*keys, "_b").orderBy("position"))
    step = step.withColumn("n", F.coalesce(following, behind) - F.col("position"))
    return running(step, keys, "_b", ["position"], "depth", "sum", F.col("_d")).select(*keys, "position", "n", "depth")


def uncovered(depths: DataFrame, keys: list[str], bucket_width: int = COORDINATE_BUCKET) -> DataFrame:
    """Maximal zero-depth runs."""
    return islands(depths.filter(F.col("depth") == 0), keys, "position", bucket_width)


def families(df: DataFrame, site: list[str], lane: list[str], start: str, max_step: int,
             bucket_width: int = COORDINATE_BUCKET, name: str = "family") -> DataFrame:
    """Gap-based families: per site sorted by (lane, start), a new family opens when the lane
    changes or the step from the previous member exceeds ``max_step`` (single linkage).

    Adds ``name`` = lane values and ``Fk`` joined by ``_``; k counts through all lanes of the site.
    Members with equal coordinates share a family, so only distinct coordinates are scanned.
    """
    points = df.select(*site, *lane, start).distinct()
    points = points.withColumn("_lb", F.floor(F.col(start) / bucket_width))
    points = running(points, [*site, *lane], "_lb", [start], "_prev", "max", F.col(start), inclusive=False)
    opens = F.when(F.col("_prev").isNull() | (F.col(start) - F.col("_prev") > max_step), 1).otherwise(0)
    points = points.withColumn("_sb", F.struct(*lane, "_lb"))
    points = running(points, site, "_sb", [*lane, start], "_k", "sum", opens)
    label = F.concat_ws("_", *[F.col(c).cast("string") for c in lane], F.concat(F.lit("F"), F.col("_k").cast("string")))
    return df.join(points.select(*site, *lane, start, label.alias(name)), [*site, *lane, start])


def points_in_intervals(points: DataFrame, intervals: DataFrame, point: str, start: str = "start", end: str = "end",
                        keys: list[str] | None = None, bin_width: int = 64) -> DataFrame:
    """Range join: every (point, interval) with ``start <= point <= end``.

    Intervals are listed under each bin they touch, so the join is an equi-join on the keys and the
    bin that shuffles and skew-splits like any other.
    """
    keys = keys or []
    left = points.withColumn("_bin", F.floor(F.col(point) / bin_width))
    right = intervals.withColumn(
        "_bin", F.explode(F.sequence(F.floor(F.col(start) / bin_width), F.floor(F.col(end) / bin_width)))
    )
    return left.join(right, [*keys, "_bin"]).filter(F.col(point).between(F.col(start), F.col(end))).drop("_bin")


def covering_counts(points: DataFrame, intervals: DataFrame, point: str, start: str = "start", end: str = "end",
                    keys: list[str] | None = None, bucket_width: int = COORDINATE_BUCKET) -> DataFrame:
    """How many intervals of its key each distinct point lies in, 0 included -> (keys, ``point``, n).

    No pair is listed: starts and ends are signed rows that are summed per coordinate in each map task, a point is a row of
    weight 0, and one running sum gives the count. Rows with a missing key or coordinate, and intervals that end before they
    start, take no part."""
    keys = keys or []

    def steps(df, at, weight, asked):
        return df.select(*keys, at.cast("long").alias("_x"), F.lit(weight).cast("long").alias("_w"), F.lit(asked).alias("_asked"))

    live = intervals.filter(F.col(start) <= F.col(end))
    rows = steps(live, F.col(start), 1, 0).unionByName(steps(live, F.col(end) + 1, -1, 0)).unionByName(steps(points, F.col(point), 0, 1)).dropna()
    at = rows.groupBy(*keys, "_x").agg(F.sum("_w").alias("_w"), F.max("_asked").alias("_asked")).withColumn("_b", F.floor(F.col("_x") / bucket_width))
    depths = running(at, keys, "_b", ["_x"], "n", "sum", F.col("_w"))
    return depths.filter(F.col("_asked") == 1).select(*keys, F.col("_x").alias(point), "n")


def normalise_hits(df: DataFrame) -> DataFrame:
    """Keep the raw hit coordinates as ``*_raw``; order start and end of query and subject."""
    out = df
    for a, b in (("qstart", "qend"), ("sstart", "send")):
        out = out.withColumns({f"{a}_raw": F.col(a), f"{b}_raw": F.col(b)})
        out = out.withColumns({a: F.least(f"{a}_raw", f"{b}_raw"), b: F.greatest(f"{a}_raw", f"{b}_raw")})
    return out


def filter_hits(df: DataFrame, min_length: int | None = None, min_pident: float | None = None) -> DataFrame:
    """Optional thresholds; a threshold left at None adds no filter."""
    if min_length is not None:
        df = df.filter(F.col("length") >= min_length)
    if min_pident is not None:
        df = df.filter(F.col("pident") >= min_pident)
    return df
