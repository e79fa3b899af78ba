"""Irregular readings onto a regular grid.

Per source a trend with daily harmonics is fitted by normal equations; missing slots get the
model's value plus the residual bridged linearly between the observed slots around them.

Scale: readings are first reduced to slot means (partial aggregation), the normal equations are sums
per (source, day) added up per source, and the fill works on one (source, day) at a time, which holds
at most 86400 / interval slots. So a source with a third of all rows is spread over its days. Gaps between
days, however long, are cut at midnight and filled from the last reading before and the first one behind.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.event_time import with_registry

DAY_S = 86400
HARMONICS = 2
RIDGE = 1e-3


def _basis(day_part: Column, harmonics: int) -> list[Column]:
    """1, time within the day, sine and cosine of each harmonic of the day."""
    waves = [f(day_part * (2 * math.pi * k)) for k in range(1, harmonics + 1) for f in (F.sin, F.cos)]
    return [F.lit(1.0), day_part, *waves]


def slot_means(readings: DataFrame, registry: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """(source_id, interval_s, slot_start, value): the mean of each slot that holds a reading.

    Null values, null sources, null event times and tables without a positive interval count for
    nothing. With `limits` (table_name, field_name, low, high) impossible values and NaN leave the
    mean, but their slot stays observed, with a null value if it has no other.
    """
    rows = with_registry(readings.select("source_id", "table_name", "field_name", "time", "__timestamp", "value"), registry)
    rows = rows.where("value is not null and source_id is not null and event_ns is not null and interval_s > 0")
    value = F.when(~F.isnan("value"), F.col("value"))
    if limits is not None:
        from siltstone.session import checked_broadcast

        bounds = limits.groupBy("table_name", "field_name").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        rows = rows.join(checked_broadcast(bounds), ["table_name", "field_name"], "left")
        value = F.when(F.col("low").isNull() | (value >= F.col("low")), F.when(F.col("high").isNull() | (value <= F.col("high")), value))
    second = F.expr("event_ns div 1000000000 - if(event_ns % 1000000000 < 0, 1, 0)")
    slot = second - F.pmod(second, F.col("interval_s").cast("bigint"))
    rows = rows.select("source_id", F.col("interval_s").cast("bigint").alias("interval_s"), slot.alias("slot_start"), value.alias("value"))
    return rows.groupBy("source_id", "interval_s", "slot_start").agg(F.avg("value").alias("value"))


def _day() -> Column:
    return (F.col("slot_start") - F.pmod("slot_start", F.lit(DAY_S))).alias("day")


def seasonal_models(means: DataFrame, harmonics: int = HARMONICS, ridge: float = RIDGE) -> DataFrame:
    """(source_id, origin, coef): the ridge solution of each source's normal equations.

    `origin` is the day at which the trend is 0. Sums are taken per (source, day), with time counted
    from the day's start, and moved to the common origin when they are added up, which loses no
    digits to large epochs. Sources without a usable value have no model.
    """
    p = 2 + 2 * harmonics
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    day_part = F.pmod("slot_start", F.lit(DAY_S)) / F.lit(float(DAY_S))
    rows = means.where("value is not null").select("source_id", _day(), "value", *(b.alias(f"b{i}") for i, b in enumerate(_basis(day_part, harmonics))))
    sums = rows.groupBy("source_id", "day").agg(
        *(F.sum(F.col(f"b{i}") * F.col(f"b{j}")).alias(f"m{i}_{j}") for i, j in pairs),
        *(F.sum(F.col(f"b{i}") * F.col("value")).alias(f"y{i}") for i in range(p)),
    )
    packed = sums.select("source_id", F.struct("day", F.array(*(f"m{i}_{j}" for i, j in pairs), *(f"y{i}" for i in range(p))).alias("sums")).alias("d"))
    per_source = packed.groupBy("source_id").agg(F.collect_list("d").alias("days"))

    def solve(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        upper = ([i for i, _ in pairs], [j for _, j in pairs])
        for batch in batches:
            origins, coefs = [], []
            for days in batch.column("days").to_pylist():
                origin = min(d["day"] for d in days)
                m, y = np.zeros((p, p)), np.zeros(p)
                for d in days:
                    a = np.eye(p)
                    a[1, 0] = (d["day"] - origin) / DAY_S
                    own = np.zeros((p, p))
                    own[upper] = d["sums"][: len(pairs)]
                    own = own + np.triu(own, 1).T
                    m += a @ own @ a.T
                    y += a @ np.array(d["sums"][len(pairs) :])
                weight = np.full(p, ridge * max(m[0, 0], 1.0))
                weight[0] = 1e-9
                # centred, so that the ridge pulls towards the source's mean, not towards 0
                mean = y[0] / m[0, 0]
                coef = np.linalg.solve(m + np.diag(weight), y - m[:, 0] * mean)
                coef[0] += mean
                origins.append(origin)
                coefs.append(coef.tolist() if np.isfinite(coef).all() else [mean] + [0.0] * (p - 1))
            yield pa.RecordBatch.from_arrays([batch.column("source_id"), pa.array(origins, pa.int64()), pa.array(coefs, pa.list_(pa.float64()))], ["source_id", "origin", "coef"])

    return per_source.mapInArrow(solve, "source_id string, origin bigint, coef array<double>")


def _model(coef, origin: int, t):
    import numpy as np

    turn = 2 * np.pi * (t % DAY_S) / DAY_S
    out = coef[0] + coef[1] * (t - origin) / DAY_S
    for h in range((len(coef) - 2) // 2):
        out = out + coef[2 + 2 * h] * np.sin((h + 1) * turn) + coef[3 + 2 * h] * np.cos((h + 1) * turn)
    return out


def _bridge(batches: Iterator) -> Iterator:
    """mapInArrow body: (source_id, interval_s, start, stop, left, right, origin, coef) to (source_id, slot_start, value) of
    the slots from start to before stop; left and right are the usable readings around them, if there are any."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        at, fits, counts = [], [], []
        for start, stop, step, left, right, origin, coef in zip(*(batch.column(c).to_pylist() for c in ("start", "stop", "interval_s", "left", "right", "origin", "coef")), strict=True):
            slots = np.arange(start, stop, step)
            known = [x for x in (left, right) if x and x["value"] is not None and np.isfinite(x["value"])]
            fit = np.full(len(slots), np.nan)
            if coef and known:
                model = np.asarray(coef)
                t = np.array([x["slot_start"] for x in known])
                fit = _model(model, origin, slots) + np.interp(slots, t, np.array([x["value"] for x in known]) - _model(model, origin, t))
            at.append(slots)
            fits.append(fit)
            counts.append(len(slots))
        fit = np.concatenate(fits) if fits else np.zeros(0)
        source = batch.column("source_id").take(pa.array(np.repeat(np.arange(batch.num_rows), counts)))
        yield pa.RecordBatch.from_arrays([source, pa.array(np.concatenate(at) if at else np.zeros(0, np.int64), pa.int64()), pa.array(fit, pa.float64(), mask=np.isnan(fit))], ["source_id", "slot_start", "value"])


def _fill(batches: Iterator) -> Iterator:
    """mapInArrow body: (source_id, interval_s, points, origin, coef) per source and day to
    (source_id, slot_start, value) of the missing slots."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        if not batch.num_rows:
            continue
        points, coefs = batch.column("points"), batch.column("coef")
        starts = points.offsets.to_numpy()
        flat = points.values
        slots, values = flat.field("slot_start").to_numpy(zero_copy_only=False), flat.field("value").to_numpy(zero_copy_only=False).astype(float)
        intervals, origins = batch.column("interval_s").to_numpy(), batch.column("origin").to_numpy(zero_copy_only=False)
        counts, at, filled = [], [], []
        for k in range(batch.num_rows):
            own, y = slots[starts[k] : starts[k + 1]], values[starts[k] : starts[k + 1]]
            seen = np.zeros((own[-1] - own[0]) // intervals[k] + 1, bool)
            seen[(own - own[0]) // intervals[k]] = True
            missing = own[0] + np.flatnonzero(~seen) * intervals[k]
            good = np.isfinite(y)
            if coefs[k].is_valid and good.any():
                coef = np.asarray(coefs[k].as_py())
                fit = _model(coef, origins[k], missing) + np.interp(missing, own[good], y[good] - _model(coef, origins[k], own[good]))
            else:
                fit = np.full(len(missing), np.nan)
            counts.append(len(missing))
            at.append(missing)
            filled.append(fit)
        source = batch.column("source_id").take(pa.array(np.repeat(np.arange(batch.num_rows), counts)))
        fit = np.concatenate(filled)
        yield pa.RecordBatch.from_arrays([source, pa.array(np.concatenate(at), pa.int64()), pa.array(fit, pa.float64(), mask=np.isnan(fit))], ["source_id", "slot_start", "value"])


def between_days(days: DataFrame) -> DataFrame:
    """(source_id, interval_s, start, stop, left, right): the slots between the last reading of a day and the first of the
    source's next day that has any, cut at midnight; left and right are the usable readings next to them."""
    usable = F.filter("points", lambda p: p["value"].isNotNull())
    ends = days.select("source_id", "interval_s", "day", F.element_at("points", 1)["slot_start"].alias("first"), F.element_at("points", -1)["slot_start"].alias("last"), F.try_element_at(usable, F.lit(1)).alias("first_good"), F.try_element_at(usable, F.lit(-1)).alias("last_good"))
    by_day = Window.partitionBy("source_id", "interval_s").orderBy("day")
    # nulls are skipped, so readings of a day without usable ones come from beyond it
    ends = ends.select(
        "source_id", "interval_s", (F.col("last") + F.col("interval_s")).alias("open"), F.lead("first").over(by_day).alias("close"),
        F.last("last_good", ignorenulls=True).over(by_day.rowsBetween(Window.unboundedPreceding, 0)).alias("left"), F.first("first_good", ignorenulls=True).over(by_day.rowsBetween(1, Window.unboundedFollowing)).alias("right"),
    ).where("close > open")
    # a slot belongs to the day it starts in
    midnight = F.explode(F.expr(f"sequence(open - pmod(open, {DAY_S}), close - 1 - pmod(close - 1, {DAY_S}), {DAY_S}L)"))
    pieces = ends.withColumn("midnight", midnight)
    grid_up = lambda t: t + F.pmod(F.col("open") - t, F.col("interval_s"))
    start, stop = F.greatest("open", grid_up(F.col("midnight"))), F.least("close", F.col("midnight") + DAY_S)
    return pieces.select("source_id", "interval_s", start.alias("start"), stop.alias("stop"), "left", "right").where("start < stop")


def regular_series(readings: DataFrame, registry: DataFrame, limits: DataFrame | None = None, harmonics: int = HARMONICS, whole: bool = True) -> DataFrame:
    """(source_id, slot_start, value, status): every slot of each source from the first to the last that hold a
    reading. Status is `observed`, `filled` for the missing slots between two readings of a UTC day, and `between`
    for those between the readings of two days; with whole = false these stay out.

    slot_start is in epoch seconds, aligned to the epoch. Ties and repeated readings share a slot and
    its mean; an empty table gives an empty series; columns other than those named are ignored. A filled value is
    null only where the source has no usable value at all that day, one between days only where it has none.
    """
    means = slot_means(readings, registry, limits)
    days = means.groupBy("source_id", "interval_s", _day()).agg(F.sort_array(F.collect_list(F.struct("slot_start", "value"))).alias("points"))
    last, first = F.element_at("points", -1)["slot_start"], F.element_at("points", 1)["slot_start"]
    gaps = days.where((last - first) > (F.size("points") - 1) * F.col("interval_s"))
    models = seasonal_models(means, harmonics)
    filled = gaps.join(models, "source_id", "left").select("source_id", "interval_s", "points", F.coalesce("origin", F.lit(0)).alias("origin"), "coef")
    filled = filled.mapInArrow(_fill, "source_id string, slot_start bigint, value double")
    parts = [means.select("source_id", "slot_start", "value", F.lit("observed").alias("status")), filled.withColumn("status", F.lit("filled"))]
    if whole:
        between = between_days(days).join(models, "source_id", "left").withColumn("origin", F.coalesce("origin", F.lit(0)))
        parts.append(between.mapInArrow(_bridge, "source_id string, slot_start bigint, value double").withColumn("status", F.lit("between")))
    return reduce(DataFrame.unionByName, parts)
