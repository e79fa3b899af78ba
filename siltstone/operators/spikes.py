"""Implausible values: impossible readings, spikes and stuck runs, per source.

A local-level Kalman filter runs over each source in event-time order, with the source's own noise and drift.
Standardised innovations above a threshold are flagged and their updates withheld; more than three in a row
are a change of level and restart the filter. Flagged points are then checked exactly against the level around
them and the source's usual scatter about it. Where what an innovation adds to the residual before it vanishes
(less than JITTER of the usual step) for a window of points, the source is stuck.

Scale: a long source is cut into chunks of CHUNK points with HALO points of both neighbours before and behind, in
which the filter has forgotten where it began; only a chunk's own points are reported. All that decides is the
source's: noise and drift come from sums over its points before it is cut (a histogram of steps in powers of two,
and how often steps turn), scatter and the share of changes from sums over its chunks after the filter. So the size
of chunks does not matter. Chunks are counted in points, by offsets from per-(source, time unit) counts, so no task
ever holds a whole long source; the filter steps through many chunks at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.event_time import with_registry
from siltstone.session import checked_broadcast, materialise

CHUNK = 4096
HALO = 96
#: Nominal points in a time unit, from which chunks are counted.
UNIT_POINTS = 4096
SCATTERS = 7.0
#: Innovations above so many standard deviations are flagged; lower than SCATTERS, as the check follows.
INNOVATION = 4.0
#: Steps below this share of the usual one are none.
JITTER = 1e-6
LONGEST_SPIKE = 3
SHORTEST_RUN = 12
SIDE = 12
#: Bins of the histograms of steps and of scatter in an octave.
STEP_BINS, SCATTER_BINS = 8, 64
#: Median of the absolute value of a normal variable, inverted.
_NORMAL = 1.4826
#: Points that are filtered at once.
_BATCH = 150_000


def _rows(readings: DataFrame, registry: DataFrame, limits: DataFrame) -> DataFrame:
    rows = with_registry(readings.select("reading_id", "source_id", "table_name", "field_name", "time", "__timestamp", "value"), registry, "left").where("value is not null")
    bounds = limits.groupBy("table_name", "field_name").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    outside = F.coalesce((F.col("value") < F.col("low")) | (F.col("value") > F.col("high")), F.lit(False))
    return rows.join(checked_broadcast(bounds), ["table_name", "field_name"], "left").withColumn("impossible", outside)


def median_of_bins(bins: DataFrame, width: int, *sums: str) -> DataFrame:
    """(source_id, median, sums) from (source_id, bin, n) and columns to be summed up over the source; bin b of a positive
    size x is floor(width * log2(x))."""
    whole = Window.partitionBy("source_id")
    placed = bins.withColumn("upto", F.sum("n").over(whole.orderBy("bin"))).withColumn("half", F.sum("n").over(whole) / 2)
    for c in sums:
        placed = placed.withColumn(c, F.sum(c).over(whole))
    here = placed.where((F.col("upto") >= F.col("half")) & (F.col("upto") - F.col("n") < F.col("half")))
    share = (F.col("half") - (F.col("upto") - F.col("n"))) / F.col("n")
    return here.select("source_id", F.pow(F.lit(2.0), (F.col("bin") + share) / width).alias("median"), *sums)


def _chunks(rows: DataFrame, counters: tuple[str, ...], chunk: int, halo: int) -> DataFrame:
    """Points in order of (source_id, chunk, at), each once per chunk it belongs to or lies beside, with the
    noise and drift of their source; `first` marks a chunk's first point, `core` its own ones."""
    unit = F.expr(f"event_ns div (coalesce(nullif(greatest(interval_s, 0), 0), 60) * {UNIT_POINTS}L * 1000000000L)").alias("unit")
    usable = rows.where(F.col("source_id").isNotNull() & F.col("event_ns").isNotNull() & ~F.isnan("value"))
    if counters:
        usable = usable.where(~F.coalesce(F.col("field_name").isin(*counters), F.lit(False)))
    # deliveries are counted before anything is gathered by source, so many copies of a point are one row;
    # then one exchange serves the ranks, the counts and the steps
    points = (
        usable.select("source_id", unit, "event_ns", "value", "reading_id", "impossible")
        .where("unit is not null")  # the join infers it for one branch only, which would tell them apart
        .groupBy("source_id", "unit", "event_ns", "value")
        .agg(F.min("reading_id").alias("reading_id"), F.count("*").alias("deliveries"), F.max("impossible").alias("impossible"))
        .repartition("source_id", "unit")
    )
    inside = Window.partitionBy("source_id", "unit").orderBy("event_ns", "value")
    # the witnesses are never null; they make all branches need the columns that the points need, so that all
    # read the same exchange and Spark runs it once
    witness = [F.max("reading_id").alias("w1"), F.max("deliveries").alias("w2"), F.max("impossible").alias("w3")]
    counts = points.groupBy("source_id", "unit").agg(F.count("*").alias("n"), *witness, F.max("event_ns").alias("w4"), F.max("value").alias("w5"))
    whole = Window.partitionBy("source_id")
    earlier = whole.orderBy("unit").rowsBetween(Window.unboundedPreceding, -1)
    seen = " and ".join(f"w{k} is not null" for k in (1, 2, 3, 4, 5))
    offsets = counts.where(seen).select("source_id", "unit", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"), F.sum("n").over(whole).alias("total"))

    step = F.col("value") - F.lag("value").over(inside)
    before = F.lag("value").over(inside) - F.lag("value", 2).over(inside)
    steps = points.select("source_id", step.alias("step"), before.alias("before"), "reading_id", "deliveries", "impossible").where("abs(step) < 1e300 and step <> 0")
    size = F.floor(F.lit(STEP_BINS) * F.log2(F.abs("step"))).cast("int").alias("bin")
    turn = F.when((F.abs("before") < 1e300) & (F.col("before") != 0), F.signum(F.col("step") * F.signum("before")))
    bins = steps.groupBy("source_id", size).agg(F.count("*").alias("n"), F.sum(turn).alias("turns"), F.count(turn).alias("pairs"), *witness).where("w1 is not null and w2 is not null and w3 is not null")
    # steps of a level that drifts and is read with noise are correlated by -noise / (2 noise + drift), and their
    # signs by the arc sine of it
    share = F.least(F.greatest(-F.sin(F.try_divide("turns", "pairs") * (math.pi / 2)), F.lit(0.15)), F.lit(0.48))
    usual = F.pow(_NORMAL * F.col("median"), 2)
    model = median_of_bins(bins.select("source_id", "bin", "n", "turns", "pairs"), STEP_BINS, "turns", "pairs")
    model = model.select("source_id", (F.coalesce(share, F.lit(0.4)) * usual).alias("noise"), ((1 - 2 * F.coalesce(share, F.lit(0.4))) * usual).alias("drift"))

    ranked = points.withColumn("rank", F.row_number().over(inside))
    placed = ranked.join(offsets.join(model, "source_id", "left"), ["source_id", "unit"])
    at = F.col("offset") + F.col("rank") - 1
    last = F.greatest(F.floor(F.col("total") / F.lit(chunk)).cast("bigint") - 1, F.lit(0))
    own = F.least(F.floor(F.col("at") / F.lit(chunk)).cast("bigint"), F.col("last"))
    placed = placed.withColumn("at", at).withColumn("last", last).withColumn("own", own)
    start, end = F.col("own") * chunk, (F.col("own") + 1) * chunk
    beside = F.array(
        F.col("own"),
        F.when((F.col("own") > 0) & (F.col("at") < start + halo), F.col("own") - 1),
        F.when((F.col("own") < F.col("last")) & (F.col("at") >= end - halo), F.col("own") + 1),
    )
    copies = placed.withColumn("chunk", F.explode(F.array_compact(beside)))
    first = F.col("at") == F.greatest(F.col("chunk") * chunk - halo, F.lit(0))
    named = copies.select("source_id", "chunk", "at", first.alias("first"), (F.col("chunk") == F.col("own")).alias("core"), "value", "impossible", "event_ns", "reading_id", "deliveries", "noise", "drift")
    return named.repartition("source_id", "chunk").sortWithinPartitions("source_id", "chunk", "at")


def kalman(x, missing, lengths, noise, drift, threshold: float = INNOVATION, longest: int = LONGEST_SPIKE):
    """(flagged, innovations, residuals) of many series at once, each a column of x of its own length, longest first.

    Flagged are the points whose standardised innovation exceeds the threshold; their updates are withheld. After more
    than `longest` in a row the level has changed: the filter starts again there and they are no longer flagged.
    Missing points are predicted only. An innovation is a point's distance from the level before it, a residual the
    one from the level after it.
    """
    import numpy as np

    steps, n = x.shape
    flagged, innovations, residuals = np.zeros((steps, n), bool), np.zeros((steps, n)), np.zeros((steps, n))
    level, p, streak, limit = np.zeros(n), noise.astype(float), np.zeros(n, int), threshold * threshold
    for j in range(n):
        begin = x[: lengths[j], j][~missing[: lengths[j], j]][:7]
        level[j] = np.sort(begin)[len(begin) // 2] if len(begin) else 0.0
    active = np.searchsorted(-np.asarray(lengths), -np.arange(steps), "left")  # how many are longer than the step's number
    with np.errstate(all="ignore"):
        for t in range(steps):
            k = active[t]
            there = ~missing[t, :k]
            ahead = p[:k] + drift[:k]
            s = ahead + noise[:k]
            e = x[t, :k] - level[:k]
            out = there & (e * e > limit * s)
            gain = np.where(there & ~out, ahead / s, 0.0)
            level[:k] += np.where(gain > 0, gain * e, 0.0)
            p[:k] = ahead - gain * ahead
            streak[:k] = np.where(out, streak[:k] + 1, np.where(there, 0, streak[:k]))
            flagged[t, :k] = out
            innovations[t, :k] = e
            for j in np.flatnonzero(streak[:k] > longest):
                last = np.flatnonzero(~missing[: t + 1, j])[-longest - 1 :] if missing[max(0, t - longest) : t + 1, j].any() else np.arange(t - longest, t + 1)
                level[j] = np.sort(x[last, j])[(longest + 1) // 2]
                p[j], streak[j] = noise[j], 0
                flagged[last, j] = False
            residuals[t, :k] = x[t, :k] - level[:k]
    return flagged, innovations, residuals


def spike_evidence(x, marked):
    """(away, levels) of a series whose flagged points are marked: away is each flagged point's distance from the level
    around it where it departs to one side of both neighbours' levels, else 0; levels is the local level at
    the other points, NaN at the flagged ones."""
    import numpy as np
    from numpy.lib.stride_tricks import sliding_window_view

    away, levels = np.zeros(len(x)), np.full(len(x), np.nan)
    clean = np.flatnonzero(~marked)
    y = x[clean]
    side = min(SIDE, (len(y) - 1) // 2)
    if side < 1:
        return away, levels
    levels[clean] = np.median(sliding_window_view(np.pad(y, side, mode="reflect"), 2 * side + 1), axis=1)
    flagged = np.flatnonzero(marked)
    for group in np.split(flagged, np.flatnonzero(np.diff(flagged) > 1) + 1) if len(flagged) else ():
        at = np.searchsorted(clean, group[0])
        before, after = y[max(0, at - SIDE) : at], y[at : at + SIDE]
        if not len(after):
            continue
        back = np.median(after)
        ahead = np.median(before) if len(before) else back
        off = x[group] - (ahead + back) / 2
        least = np.minimum(np.abs(x[group] - ahead), np.abs(x[group] - back))
        away[group] = np.where((least > np.abs(off) / 2) & ((x[group] > ahead) == (x[group] > back)), off, 0.0)
    return away, levels


def stuck_runs(innovations, residuals, usual: float):
    """Lengths of the runs in which the innovations bring nothing beyond the residual before: [1, 1, 14, 1, ...]."""
    import numpy as np

    news = np.abs(innovations[1:] - residuals[:-1])
    starts = np.flatnonzero(np.r_[True, ~(news <= JITTER * usual)])
    return np.diff(np.r_[starts, len(innovations)])


#: Rows of kind `spike` and `stuck` are points; rows of kind `sum` hold what a chunk adds to its source's sums.
_FLAGGED = (
    "source_id string, event_ns bigint, value double, reading_id bigint, deliveries bigint, kind string, away double, bins array<int>, counts array<bigint>, zeros bigint, "
    "points bigint, changes bigint, rest bigint, equal bigint, long bigint, runs bigint"
)


def _detect(batches: Iterator) -> Iterator:
    import pyarrow as pa

    waiting: list = []
    held = 0
    for batch in batches:
        waiting.append(batch)
        held += batch.num_rows
        if held >= _BATCH:
            table = pa.Table.from_batches(waiting).combine_chunks()
            cut = table.num_rows - 1
            first = table.column("first").to_numpy()
            while cut > 0 and not first[cut]:
                cut -= 1
            if cut:  # the last chunk may go on in the next batch
                yield from _detected(table.slice(0, cut))
                waiting = table.slice(cut).to_batches()
                held = table.num_rows - cut
    if held:
        yield from _detected(pa.Table.from_batches(waiting).combine_chunks())


def _detected(table) -> Iterator:
    import numpy as np
    import pyarrow as pa

    column = {n: table.column(n).to_numpy() for n in ("first", "core", "value", "impossible", "event_ns", "reading_id", "deliveries", "noise", "drift")}
    starts = np.flatnonzero(column["first"])
    lengths = np.diff(np.r_[starts, table.num_rows])
    order = np.argsort(-lengths, kind="stable")
    values, core = column["value"], column["core"].astype(bool)
    missing = column["impossible"].astype(bool) | ~np.isfinite(values)
    noise, drift = np.nan_to_num(column["noise"][starts]), np.nan_to_num(column["drift"][starts])
    out: dict[str, list] = {n: [] for n in ("row", "kind", "away")}
    sums: list[tuple] = []
    at = 0
    while at < len(order):  # series of like length together, so that the grid of one step by one series stays small
        longest = lengths[order[at]]
        some = order[at : at + max(1, 2 * _BATCH // longest)]
        at += len(some)
        x, gone = np.zeros((longest, len(some))), np.ones((longest, len(some)), bool)
        for j, c in enumerate(some):
            x[: lengths[c], j], gone[: lengths[c], j] = values[starts[c] : starts[c] + lengths[c]], missing[starts[c] : starts[c] + lengths[c]]
        flagged, innovations, residuals = kalman(x, gone, lengths[some], noise[some], drift[some])
        for j, c in enumerate(some):
            n, begin = lengths[c], starts[c]
            own, lost, v = core[begin : begin + n], gone[:n, j], x[:n, j]
            seen = np.flatnonzero(~lost)
            away, dev = np.zeros(n), np.zeros(0)
            if len(seen) >= 2 * LONGEST_SPIKE + 2 and noise[c] > 0:
                off, levels = spike_evidence(v[seen], flagged[:n, j][seen])
                away[seen] = off
                dev = np.abs(v[seen] - levels)[own[seen]]
                dev = dev[~np.isnan(dev)]
            with np.errstate(all="ignore"):
                runs = stuck_runs(innovations[:n, j], residuals[:n, j], math.sqrt(2 * noise[c] + drift[c]))
            long = np.repeat(runs >= SHORTEST_RUN, runs)
            for kind, rows in (("spike", np.flatnonzero(own & (away != 0))), ("stuck", np.flatnonzero(own & long & ~lost))):
                out["row"].append(rows + begin)
                out["kind"] += [kind] * len(rows)
                out["away"].append(away[rows])
            bins, counts = np.unique(np.floor(SCATTER_BINS * np.log2(dev[dev > 0])).astype(np.int32), return_counts=True)
            heads = np.r_[0, np.cumsum(runs)[:-1]]
            counted = own[heads]  # a run belongs to the chunk of its first point
            short = runs[counted & (runs < SHORTEST_RUN)]
            changes = int(np.count_nonzero((v[1:] != v[:-1]) & own[1:]))
            sums.append((int(begin), bins.tolist(), counts.tolist(), int(np.count_nonzero(dev == 0)), int(own.sum()), changes, int(short.sum()), int((short - 1).sum()), int(np.count_nonzero(counted & (runs >= SHORTEST_RUN))), int(np.count_nonzero(counted))))
    rows = np.concatenate(out["row"]) if out["row"] else np.zeros(0, int)
    where = np.r_[rows, [s[0] for s in sums]].astype(np.int64)
    k, m = len(rows), len(sums)
    schema = [pa.list_(pa.int32()), pa.list_(pa.int64()), *[pa.int64()] * 7]
    parts = [pa.array([None] * k + [s[i + 1] for s in sums], t) for i, t in enumerate(schema)]
    points = [table.column("source_id").take(pa.array(where)).combine_chunks(), *(pa.array(column[n][where]) for n in ("event_ns", "value", "reading_id", "deliveries"))]
    away = pa.array(np.r_[np.concatenate(out["away"]) if out["away"] else np.zeros(0), np.zeros(m)])
    names = ["source_id", "event_ns", "value", "reading_id", "deliveries", "kind", "away", "bins", "counts", "zeros", "points", "changes", "rest", "equal", "long", "runs"]
    yield pa.RecordBatch.from_arrays([*points, pa.array(out["kind"] + ["sum"] * m, pa.string()), away, *parts], names)


def _sources(sums: DataFrame) -> DataFrame:
    """(source_id, scatter, changing) from the sums of the chunks: the usual scatter about the local level, and whether
    the value normally changes from point to point. Where it seldom does, it must still change outside of
    stuck runs, and they must be rare."""
    pairs = sums.select("source_id", F.explode(F.arrays_zip("bins", "counts")).alias("b"))
    bins = pairs.groupBy("source_id", F.col("b.bins").alias("bin")).agg(F.sum("b.counts").alias("n"))
    moved = F.col("moved")
    total = sums.groupBy("source_id").agg(*(F.sum(c).alias(c) for c in ("zeros", "points", "changes", "rest", "equal", "long", "runs")), F.sum(F.coalesce(F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, b: a + b), F.lit(0))).alias("moved"))
    # the median over all points lies among those off the level, unless half of them are on it; then those off it count alone
    on_level = total.where((F.col("zeros") > 0) & (F.col("zeros") < moved)).select("source_id", F.lit(-(2**30)).alias("bin"), F.col("zeros").alias("n"))
    scatter = median_of_bins(bins.unionByName(on_level), SCATTER_BINS).select("source_id", (_NORMAL * F.col("median")).alias("scatter"))
    restless = F.col("changes") >= 0.5 * F.col("points")
    rare = (F.col("rest") > 0) & (F.col("long") <= 0.2 * F.col("runs")) & (F.col("equal") < 0.5 * F.greatest(F.col("rest") - 1, F.lit(1)))
    return total.select("source_id", (restless | rare).alias("changing")).join(scatter, "source_id", "left")


def implausible(readings: DataFrame, registry: DataFrame, limits: DataFrame, counters: tuple[str, ...] = (), chunk: int = CHUNK, halo: int = HALO) -> DataFrame:
    """(reading_id, reason) of the implausible readings: `impossible`, else `stuck` or `spike`.

    Fields named in `counters` can only be impossible. Null values are skipped. NaN is impossible where the
    field has limits and no point otherwise; infinite values without limits are points the filter passes over.
    Readings without a source or an event time can only be impossible; fields without limits never are. Deliveries
    of one point (source, event time, value) count once and are all reported; a row given twice is reported
    twice. Other values at the same time are separate points, lower first. Sources of fewer than 8 points
    have no spikes. An empty table gives no rows.
    """
    rows = _rows(readings, registry, limits)
    found = materialise(_chunks(rows, counters, chunk, halo).mapInArrow(_detect, _FLAGGED), "flagged")
    sources = _sources(found.where("kind = 'sum'"))
    judged = found.where("kind <> 'sum'").join(sources, "source_id")
    judged = judged.where(F.when(F.col("kind") == "stuck", F.col("changing")).otherwise(F.abs("away") > SCATTERS * F.col("scatter")))
    key = ["source_id", "event_ns", "value"]
    flagged = materialise(judged.groupBy(*key, "reading_id", "deliveries").agg(F.max("kind").alias("reason")), "judged")  # stuck before spike
    again = flagged.where("deliveries > 1").select(*key, "reason")
    # one more look at the readings, for what is impossible and for further deliveries
    rest = rows.select(*key, "reading_id", "impossible").join(checked_broadcast(again), key, "left").where("impossible or reason is not null")
    return flagged.where("deliveries = 1").select("reading_id", "reason").unionByName(rest.select("reading_id", F.when(F.col("impossible"), "impossible").otherwise(F.col("reason")).alias("reason")))
