"""Distances, radius counts and nearest places as equi-joins on grid cells.

Records are first reduced to their distinct points, and points to nested cells from 1 down
to 0.0004 degrees.  Pairs of cells are decided whole where the distance bounds allow it and
only the undecided ones are opened, level by level while they hold many point pairs, so the
number of pairs looked at depends on the shape of the map and not on how many records
share a cell.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from wardline.functions import columns as X
from wardline.sources.layers import cut

# (size in degrees, column prefix) of the cells inside a coarse one, from large to small.
LEVELS = [(0.05, "m"), (0.01, "f"), (0.002, "d"), (0.0004, "e")]
CELLS_PER_DEGREE = 2500
SLACK_KM = 0.002
# Coarse cells of the nearest-place search, degrees; the largest fold all angles into 12 x 12.
WIDE, MIDDLE, AROUND = 30, 5, 12
# Undecided cell pairs holding fewer point pairs than this per task slot are compared point
# by point at once; more are opened on the next level first.
POINT_PAIRS_PER_SLOT = 1_000_000


def distance_to_reference(df: DataFrame, lat: float, lng: float,
                          out: str = "distance_km") -> DataFrame:
    """Kilometres from a reference point, null without a point."""
    km = X.haversine_km(F.col("latitude"), F.col("longitude"), F.lit(lat), F.lit(lng))
    return df.withColumn(out, X.half_even(km, 3))


def _centre(cell: Column, size: float) -> Column:
    return (cell + F.lit(0.5)) * F.lit(size)


def _reach(size: float) -> float:
    """Upper bound of the distance from a cell's centre to any of its points, km."""
    return size * 111.3 * math.sqrt(2) / 2


def _lng_span(row: Column, radius_km: float) -> Column:
    """Columns to each side that a radius can reach, for a 1-degree row of cells."""
    band = math.ceil(radius_km / X.KM_PER_DEGREE)
    far = F.least(F.greatest(F.abs(row - band), F.abs(row + 1 + band)), F.lit(89))
    span = F.ceil(F.lit(radius_km) / (F.lit(X.KM_PER_DEGREE) * F.cos(F.radians(far))))
    return F.least(span, F.lit(180)).cast("bigint")


def _neighbour_cells(cells: DataFrame, radius_km: float) -> DataFrame:
    """(row, col) -> every coarse cell within the radius as (near_row, near_col), wrapping."""
    band = math.ceil(radius_km / X.KM_PER_DEGREE)
    span = _lng_span(F.col("row"), radius_km)
    rows = F.explode(F.sequence(F.col("row") - band, F.col("row") + band))
    cols = F.explode(F.array_distinct(F.transform(
        F.sequence(F.col("col") - span, F.col("col") + span),
        lambda c: F.pmod(c + 180, F.lit(360)) - 180)))
    return cells.select("row", "col", rows.alias("near_row")).select(
        "row", "col", "near_row", cols.alias("near_col"))


def _with_cells(points: DataFrame) -> DataFrame:
    """Whole-number cells of each point; the larger ones are derived from the smallest, so
    a cell lies in exactly one cell of the level above."""
    points = points.withColumns({
        "e_row": F.floor(F.col("latitude") * CELLS_PER_DEGREE),
        "e_col": F.floor(F.col("longitude") * CELLS_PER_DEGREE)})
    steps = [("d_", 5), ("f_", 25), ("m_", 125), ("", CELLS_PER_DEGREE)]
    return points.withColumns({
        f"{to}{axis}": F.floor(F.col(f"e_{axis}") / n)
        for to, n in steps for axis in ("row", "col")})


def _cell_km(a: list[str], b: list[str], size: float) -> Column:
    return X.haversine_km(_centre(F.col(a[0]), size), _centre(F.col(a[1]), size),
                          _centre(F.col(b[0]), size), _centre(F.col(b[1]), size))


def _fan(df: DataFrame, cells: list[str]) -> DataFrame:
    """Spread few rows that will meet many others over all tasks."""
    spark = df.sparkSession
    wanted = spark.conf.get("spark.sql.shuffle.partitions")  # Spark's own default where unset
    n = int(wanted) if wanted.isdigit() else spark.sparkContext.defaultParallelism
    return df.repartition(n, *cells)


def _few_point_pairs(pairs: DataFrame) -> bool:
    total = pairs.agg(F.sum("work").alias("n")).collect()[0]["n"] or 0
    return total <= POINT_PAIRS_PER_SLOT * pairs.sparkSession.sparkContext.defaultParallelism


def _target(names: list[str]) -> list[str]:
    return [f"t_{n}" for n in names]


def radius_counts(places: DataFrame, targets: DataFrame, radii: list[float],
                  measures: list[str], exclude_self: list[str] | None = None) -> DataFrame:
    """Sum of each target measure within each radius of every place.

    places: any columns with latitude, longitude.  targets: latitude, longitude and whole
    number measures (such as 1 per capable facility).  Returns the places with a column
    `<measure>_<radius>km` per pair, 0 when nothing is near.  `exclude_self` names place
    columns holding the place's own measures, which are taken off again.
    """
    located = places.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    asked = cut(_with_cells(located.select("latitude", "longitude").distinct()))
    wanted = targets.where(
        F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
        & F.exists(F.array(*measures), lambda m: m != 0))
    held = cut(_with_cells(wanted.groupBy("latitude", "longitude").agg(
        *[F.sum(m).alias(m) for m in measures])))
    names = {(m, r): f"{m}_{r:g}km" for r in radii for m in measures}
    open_ = {r: f"open_{r:g}" for r in radii}
    zero = F.lit(0).cast("bigint")

    parent = ["row", "col"]
    pairs = _neighbour_cells(asked.select(*parent).distinct(), max(radii)) \
        .withColumnsRenamed({"near_row": "t_row", "near_col": "t_col"}) \
        .withColumns({c: F.lit(True) for c in open_.values()})
    decided = []
    for size, prefix in LEVELS:
        own, reach = [f"{prefix}_row", f"{prefix}_col"], 2 * _reach(size) + SLACK_KM
        here = _fan(asked.groupBy(*parent, *own).agg(F.count(F.lit(1)).alias("asked")), own)
        there = held.groupBy(*parent, *own).agg(
            F.count(F.lit(1)).alias("held"), *[F.sum(m).alias(m) for m in measures]) \
            .withColumnsRenamed({c: f"t_{c}" for c in parent + own})
        km = F.col("km")
        met = here.join(pairs, parent).join(there, _target(parent)) \
            .withColumn("km", _cell_km(own, _target(own), size)) \
            .where(km <= max(radii) + reach)
        inside = {r: F.col(open_[r]) & (km <= r - reach) for r in radii}
        edge = {r: F.col(open_[r]) & (km > r - reach) & (km <= r + reach) for r in radii}
        decided.append((prefix, own, met.groupBy(*own).agg(*[
            F.sum(F.when(inside[r], F.col(m)).otherwise(zero)).alias(f"{prefix}_{n}")
            for (m, r), n in names.items()])))
        pairs = cut(met.where(reduce(lambda x, y: x | y, edge.values())).select(
            *own, *_target(own), (F.col("asked") * F.col("held")).alias("work"),
            *[edge[r].alias(open_[r]) for r in radii]))
        parent = own
        if _few_point_pairs(pairs):
            break
        pairs = pairs.drop("work")

    a = asked.select("latitude", "longitude", *parent)
    t = held.select(F.col("latitude").alias("t_lat"), F.col("longitude").alias("t_lng"),
                    *[F.col(c).alias(f"t_{c}") for c in parent], *measures)
    point_km = X.haversine_km(F.col("latitude"), F.col("longitude"),
                              F.col("t_lat"), F.col("t_lng"))
    exact = (
        _fan(a, ["latitude", "longitude"]).join(pairs, parent).join(t, _target(parent))
        .withColumn("km", point_km)
        .groupBy("latitude", "longitude").agg(*[
            F.sum(F.when(F.col(open_[r]) & (F.col("km") <= r), F.col(m)).otherwise(zero))
            .alias(f"x_{n}") for (m, r), n in names.items()])
    )
    per_point = asked
    for _, own, sums in decided:
        per_point = per_point.join(sums, own, "left")
    per_point = per_point.join(exact, ["latitude", "longitude"], "left").select(
        "latitude", "longitude", *[
            reduce(lambda x, y: x + y, [
                F.coalesce(f"{k}_{n}", zero) for k in [*[p for p, _, _ in decided], "x"]]).alias(n)
            for n in names.values()])
    own_share = {m: (F.coalesce(F.col(c), zero) if c else zero)
                 for m, c in zip(measures, exclude_self or [None] * len(measures))}
    return places.join(per_point, ["latitude", "longitude"], "left").withColumns({
        n: F.when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(),
                  F.coalesce(n, zero) - own_share[m]) for (m, _), n in names.items()})


def _fold(cell: Column) -> Column:
    return F.pmod(F.floor(cell / WIDE), F.lit(AROUND))


def _cut_pairs(pairs: DataFrame) -> tuple[DataFrame, int]:
    """The stored pairs of cells and the point pairs they hold, counted while writing."""
    seen = Observation()
    stored = cut(pairs.observe(seen, F.sum("work").alias("n")))
    return stored, seen.get["n"] or 0


def nearest(places: DataFrame, targets: DataFrame, key: str | None = None,
            label: str | None = None, other_points: bool = False) -> DataFrame:
    """Distance from each distinct place point to the nearest target point, per target key.

    targets: latitude, longitude, optional key (a place is matched with every key value) and
    optional label (the smallest label at equal distance wins, distance in whole metres).
    `other_points` leaves out a target at the very place.  Returns latitude, longitude,
    key, nearest_km, label; no row where a key has no target to offer.

    Branch and bound over nested cells: each of the 144 cells of 30 degrees that cover all
    angles is paired with each, a fixed list.  On every level a pair of cells stays if, by its
    distance bounds, the target cell may hold the nearest point of some place; what stays is
    opened on the next level while it holds many point pairs.  Every join is on a cell.
    """
    keys = [key] if key else []
    top = ["w_row", "w_col"]

    def placed(points: DataFrame) -> DataFrame:
        points = _with_cells(points)
        return cut(points.withColumns({
            "w_row": _fold(F.col("row")), "w_col": _fold(F.col("col")),
            "g_row": F.floor(F.col("row") / MIDDLE), "g_col": F.floor(F.col("col") / MIDDLE)}))

    points = placed(places.where(
        F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
        .select("latitude", "longitude").distinct())
    held = targets.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    held = placed(held.groupBy("latitude", "longitude", *keys).agg(
        F.min(label).alias("label") if label else F.lit(None).cast("string").alias("label")))

    def place_cells(cells: list[str]) -> DataFrame:
        return points.groupBy(*cells).agg(F.count(F.lit(1)).alias("asked"))

    def target_cells(cells: list[str]) -> DataFrame:
        return held.groupBy(*cells, *keys).agg(F.count(F.lit(1)).alias("held")) \
            .withColumnsRenamed({c: f"t_{c}" for c in cells})

    def kept(met: DataFrame, own: list[str], size: float) -> DataFrame:
        """Pairs whose target cell can hold the nearest point of a place in the other cell.
        A lone target in the place's own cell may be the place itself and bounds nothing."""
        km, reach = F.col("km"), 2 * _reach(size) + SLACK_KM
        bound = km
        if other_points:
            same = reduce(lambda x, y: x & y, [F.col(c) == F.col(f"t_{c}") for c in own])
            bound = F.when(~same | (F.col("held") > 1), km)
        met = met.withColumn("km", _cell_km(own, _target(own), size)) \
            .select(*own, *_target(own), "km", "asked", "held", *keys)
        # a cell meets few others, whatever the number of points in it
        best = F.min(bound).over(Window.partitionBy(*own, *keys))
        return met.withColumn("best", best) \
            .where(F.col("best").isNull() | (km - reach <= F.col("best") + reach)) \
            .select(*own, *_target(own), *keys, (F.col("asked") * F.col("held")).alias("work"))

    other = F.explode(F.sequence(F.lit(0), F.lit(AROUND * AROUND - 1)))
    all_ways = place_cells(top).withColumn("_at", other).withColumns({
        "t_w_row": F.floor(F.col("_at") / AROUND), "t_w_col": F.col("_at") % AROUND})
    met = all_ways.join(target_cells(top), _target(top))
    pairs, work = _cut_pairs(kept(met, top, float(WIDE)))
    parent = top
    slots = points.sparkSession.sparkContext.defaultParallelism
    for size, prefix in [(float(MIDDLE), "g_"), (1.0, ""), *[(s, f"{p}_") for s, p in LEVELS]]:
        if work <= POINT_PAIRS_PER_SLOT * slots:
            break
        own = [f"{prefix}row", f"{prefix}col"]
        met = _fan(place_cells([*parent, *own]), own).join(pairs.drop("work"), parent) \
            .join(target_cells([*parent, *own]), [*_target(parent), *keys])
        pairs, work = _cut_pairs(kept(met, own, size))
        parent = own

    there = held.select(*keys, "label", F.col("latitude").alias("t_lat"),
                        F.col("longitude").alias("t_lng"),
                        *[F.col(c).alias(f"t_{c}") for c in parent])
    met = _fan(points.select("latitude", "longitude", *parent), ["latitude", "longitude"]) \
        .join(pairs.drop("work"), parent) \
        .join(there, [*_target(parent), *keys])
    if other_points:
        met = met.where((F.col("latitude") != F.col("t_lat"))
                        | (F.col("longitude") != F.col("t_lng")))
    km3 = X.half_even(X.haversine_km(F.col("latitude"), F.col("longitude"),
                                     F.col("t_lat"), F.col("t_lng")), 3)
    best = met.groupBy("latitude", "longitude", *keys).agg(
        F.min(F.struct(km3.alias("km"), F.col("label"))).alias("best"))
    return best.select("latitude", "longitude", *keys,
                       F.col("best.km").alias("nearest_km"), F.col("best.label").alias("label"))


def nearest_capable(gold: DataFrame, specialties: list[str]) -> DataFrame:
    """Kilometres from every located facility to the nearest other one per specialty.

    A point with another capable facility answers at 0 km; the rest look among the
    other points.
    """
    located = gold.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    able = F.explode(F.array_compact(F.array(*[
        F.when(F.col(f"is_{s}"), F.lit(s)) for s in specialties]))).alias("specialty")
    targets = located.select("latitude", "longitude", able)
    crowd = targets.groupBy("latitude", "longitude", "specialty").agg(
        F.count(F.lit(1)).alias("here"))
    others = nearest(located, targets, "specialty", other_points=True).drop("label")
    every = located.select("facility_id", "latitude", "longitude",
                           F.explode(F.array(*[F.struct(
                               F.lit(s).alias("specialty"), F.col(f"is_{s}").alias("own"))
                               for s in specialties])).alias("s")) \
        .select("facility_id", "latitude", "longitude", "s.specialty", "s.own")
    point = ["latitude", "longitude", "specialty"]
    beside = F.coalesce("here", F.lit(0)) - F.col("own").cast("int") > 0
    return every.join(crowd, point, "left").join(others, point, "left").select(
        "facility_id", "specialty",
        F.when(beside, F.lit(0.0)).otherwise(F.col("nearest_km")).alias("nearest_km"))


def facility_radius_counts(gold: DataFrame, specialties: list[str],
                           radii: tuple[float, ...] = (50.0, 100.0)) -> DataFrame:
    """Capable facilities within each radius of every facility, itself not counted."""
    flags = gold.withColumns({f"n_{s}": F.col(f"is_{s}").cast("bigint") for s in specialties})
    names = [f"n_{s}" for s in specialties]
    counted = radius_counts(flags, flags.select("latitude", "longitude", *names),
                            list(radii), names, exclude_self=names)
    rows = F.inline(F.array(*[
        F.struct(F.lit(s).alias("specialty"),
                 *[F.col(f"n_{s}_{r:g}km").alias(f"within_{r:g}km") for r in radii])
        for s in specialties]))
    return counted.where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()) \
        .select("facility_id", rows)


def distance_severity(count: Column, mean_trust: Column) -> Column:
    """0 capable facilities near: 95; 1: 75 when little trusted, else 60; more: 20 or 45."""
    return (
        F.when(count == 0, 95)
        .when(count == 1, F.when(mean_trust < 40, 75).otherwise(60))
        .otherwise(F.when(mean_trust >= 70, 20).otherwise(45))
    )


def pin_severity(gold: DataFrame, specialties: list[str], radius_km: float = 50.0) -> DataFrame:
    """Distance severity per state, PIN code and specialty, seen from the PIN's mean point."""
    pins = gold.where(F.col("address_zip").isNotNull() & F.col("address_state").isNotNull()) \
        .groupBy("address_state", "address_zip").agg(
            F.bround(F.avg("latitude"), 4).alias("latitude"),
            F.bround(F.avg("longitude"), 4).alias("longitude"))
    able = {s: F.col(f"is_{s}") & (F.col("confidence") != "low") for s in specialties}
    tenths = F.round(F.coalesce("trust_score", F.lit(0.0)) * 10).cast("bigint")
    zero = F.lit(0).cast("bigint")
    targets = gold.select("latitude", "longitude", *[
        c for s in specialties for c in (
            able[s].cast("bigint").alias(f"n_{s}"),
            F.when(able[s], tenths).otherwise(zero).alias(f"t_{s}"))])
    names = [c for s in specialties for c in (f"n_{s}", f"t_{s}")]
    seen = radius_counts(pins, targets, [radius_km], names)
    r = f"{radius_km:g}km"
    rows = F.inline(F.array(*[
        F.struct(F.lit(s).alias("specialty"), F.col(f"n_{s}_{r}").alias("capable"),
                 F.try_divide(F.col(f"t_{s}_{r}") / 10, F.col(f"n_{s}_{r}")).alias("mean_trust"))
        for s in specialties]))
    return seen.where(F.col("latitude").isNotNull()) \
        .select("address_state", "address_zip", rows).withColumn(
            "severity", distance_severity(F.col("capable"), F.col("mean_trust")))


def rollup_severity(pins: DataFrame) -> DataFrame:
    """Worst and mean severity per PIN code, per state and overall."""
    return pins.rollup("address_state", "address_zip").agg(
        F.max("severity").alias("max_severity"),
        F.bround(F.avg("severity"), 4).alias("mean_severity"),
        F.grouping_id().cast("int").alias("level"))


def fill_region(silver: DataFrame) -> DataFrame:
    """Missing state from the nearest state centroid, missing PIN from the nearest known PIN."""
    lat, lng = F.col("latitude"), F.col("longitude")
    located = silver.where(lat.isNotNull() & lng.isNotNull())
    centroids = located.where(F.col("address_state").isNotNull()).groupBy("address_state").agg(
        F.bround(F.avg(lat), 4).alias("latitude"), F.bround(F.avg(lng), 4).alias("longitude"))
    states = nearest(located.where(F.col("address_state").isNull()), centroids,
                     label="address_state").select(
        "latitude", "longitude", F.col("label").alias("_state"))
    pins = nearest(located.where(F.col("address_zip").isNull()),
                   located.where(F.col("address_zip").isNotNull()), label="address_zip").select(
        "latitude", "longitude", F.col("label").alias("_zip"))
    point = ["latitude", "longitude"]
    return silver.join(states, point, "left").join(pins, point, "left").withColumns({
        "address_state": F.coalesce("address_state", "_state"),
        "address_zip": F.coalesce("address_zip", "_zip"),
    }).drop("_state", "_zip")
