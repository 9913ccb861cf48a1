"""Places as lon and lat columns: distances, cells, radius and nearest joins, point in polygon."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.tables import written

KM_PER_DEGREE = 111.32


def apart(lon_a: Column, lon_b: Column) -> Column:
    """Degrees of longitude from the first to the second, the short way round."""
    d = lon_b - lon_a
    return F.when(F.abs(d) <= 180, d).when(d > 0, d - 360).otherwise(d + 360)


def flat_km(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column) -> Column:
    """Distance on a plane that touches the earth between the two places."""
    x = apart(lon_a, lon_b) * F.cos(F.radians((lat_a + lat_b) / 2)) * KM_PER_DEGREE
    return F.hypot(x, (lat_b - lat_a) * KM_PER_DEGREE)


def haversine_km(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat_b - lat_a) / 2), 2) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(F.sin(F.radians(lon_b - lon_a) / 2), 2)
    return 2 * 6371.0088 * F.asin(F.sqrt(a))


def compass(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column) -> Column:
    """One of eight winds from the first place to the second."""
    angle = F.degrees(F.atan2((lon_b - lon_a) * F.cos(F.radians((lat_a + lat_b) / 2)), lat_b - lat_a))
    names = F.array(*[F.lit(x) for x in ("N", "NE", "E", "SE", "S", "SW", "W", "NW")])
    return F.get(names, F.pmod(F.round(angle / 45).cast("int"), F.lit(8)))


def hexagon(x: Column, y: Column, size: float) -> Column:
    """(q, r) of the pointy hexagon of a given edge that holds a point: nearest centre by cube rounding."""
    q, r = (x * (3**0.5 / 3) - y / 3) / size, y * (2 / 3) / size
    s = -q - r
    rq, rr, rs = F.round(q), F.round(r), F.round(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    fq = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    fr = F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr)
    return F.struct(fq.cast("int").alias("q"), fr.cast("int").alias("r"))


def _cell(c: str, degrees: float) -> Column:
    return F.floor(F.col(c) / degrees)


def within(left: DataFrame, right: DataFrame, km: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Pairs no further apart than km. Right columns get the suffix _r.

    Where rows share places, distances are taken between distinct places once, and rows join the pairs of their places.
    """
    if not (_share_places(left, lon, lat) or _share_places(right, lon, lat)):
        return _by_cells(left, right, km, lon, lat)
    here, there = [lon, lat], [f"{lon}_r", f"{lat}_r"]
    near = written(_by_cells(left.select(*here).distinct(), right.select(*here).distinct(), km, lon, lat), "places")
    other = right.select(*[F.col(c).alias(f"{c}_r") for c in right.columns])
    found = left.join(near, here).join(other, there)
    return found.select(*left.columns, *other.columns, "km")


def _share_places(rows: DataFrame, lon: str, lat: str) -> bool:
    n = rows.agg(F.count("*").alias("rows"), F.approx_count_distinct(F.struct(lon, lat)).alias("places")).first()
    return n.rows > 2 * n.places


def _by_cells(left: DataFrame, right: DataFrame, km: float, lon: str, lat: str) -> DataFrame:
    """Pairs by grid cells: rows as high as the radius, cells of a row as wide as it needs at its latitude.

    Each left row meets nine cells at most; a full cell spreads over join tasks by AQE.
    """
    high = km / KM_PER_DEGREE
    row_of = F.floor((F.col(lat) + 90) / high)

    def cells(row: Column) -> Column:
        """How many cells a row has: each at least as wide as the radius anywhere in the row and its neighbours."""
        widest = F.least(F.greatest(F.abs((row - 1) * high - 90), F.abs((row + 2) * high - 90)), F.lit(89.999))
        return F.greatest(F.floor(360 * F.cos(F.radians(widest)) / high), F.lit(1))

    def cell(row: Column, step: int) -> Column:
        many = cells(row)
        return F.pmod(F.floor(F.pmod(F.col(lon) + 180, F.lit(360.0)) / 360 * many) + step, many)

    rows = left.withColumn("_y", F.explode(F.array(*[row_of + i for i in (-1, 0, 1)])))
    a = rows.withColumn("_x", F.explode(F.array_distinct(F.array(*[cell(F.col("_y"), i) for i in (-1, 0, 1)]))))
    b = right.withColumn("_y", row_of).withColumn("_x", cell(F.col("_y"), 0)).select(*[F.col(c).alias(f"{c}_r") for c in right.columns], "_x", "_y")
    away = flat_km(F.col(lon), F.col(lat), F.col(f"{lon}_r"), F.col(f"{lat}_r"))
    return a.join(b, ["_x", "_y"]).where(away <= km).withColumn("km", away).drop("_x", "_y")


def nearest(left: DataFrame, right: DataFrame, key: str, right_key: str, k: int, km: float = 10.0, limit: float | None = None) -> DataFrame:
    """The k nearest right rows of each left row, ties by the right key, with ``rank``; with ``limit`` none further than so many km.

    Distinct places are what is searched for, and of right rows at one place the k first ones are all that can be found. Places first
    look within km or, where right places lie denser, within what holds some of them; those that find fewer than k look
    again within twice as far, and so on until the limit or the whole earth is searched.
    """
    here = ["lon", "lat"]
    at_place = Window.partitionBy(*here).orderBy(right_key)
    kept = written(right.withColumn("_k", F.row_number().over(at_place)).where(F.col("_k") <= k).drop("_k"), "kept")
    whole = kept.agg(F.count("*").alias("n"), F.count_distinct(*here).alias("places"), *[f(c).alias(f"{n}_{c}") for c in here for n, f in (("low", F.min), ("high", F.max))]).first()
    most = 20_100.0 if limit is None else limit
    if whole.n < k:
        km = 2 * most
    elif whole.places:
        high, wide = (whole.high_lat - whole.low_lat) * KM_PER_DEGREE, (whole.high_lon - whole.low_lon) * KM_PER_DEGREE
        dense = (2 * k * max(high, 0.01) * max(wide, 0.01) / whole.places) ** 0.5
        km = min(km, dense)
    w = Window.partitionBy(*here).orderBy("km", f"{right_key}_r")
    found, open_ = [], written(left.select(*here).distinct(), "open")
    while True:
        last = km >= most
        ranked = _by_cells(open_, kept, min(km, limit) if limit else km, *here).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        ranked = written(ranked, "nearest")
        full = ranked.where(F.col("rank") == k).select(*here)
        found.append(ranked if last else ranked.join(full, here, "left_semi"))
        if not last:
            open_ = written(open_.join(full, here, "left_anti"), "open")
        if last or open_.isEmpty():
            return left.join(reduce(DataFrame.unionByName, found), here).select(*left.columns, *[f"{c}_r" for c in right.columns], "km", "rank")
        km = 2 * km


def spaced(places: DataFrame, key: str, weight: str, km: float, area: str | None = None, quota: int = 0) -> DataFrame:
    """Places picked heaviest first (ties by key), none within km of one picked before and, with ``area``, at most ``quota`` an area.

    In rounds: a place without a heavier undecided one within km is picked and takes its neighbours out. With a quota it is held back
    while heavier undecided places of its area could still use the quota up, and goes out once heavier picks have. That gives
    the same picks as going through the places one by one.
    """
    order = lambda end: F.struct(F.col(f"{weight}{end}").alias("w"), (-F.col(f"{key}{end}")).alias("k"))
    near = written(within(places, places, km).where(f"{key} <> {key}_r").select(key, f"{key}_r", (order("_r") > order("")).alias("heavier")), "near")
    left, picked = places, None
    while not left.isEmpty():
        pairs = near.join(left.select(key), key, "left_semi").join(left.select(F.col(key).alias(f"{key}_r")), f"{key}_r", "left_semi")
        free = left.join(pairs.where("heavier").select(key), key, "left_anti")
        over = left.limit(0).select(key)
        if area is not None:
            before = Window.partitionBy(area).orderBy(F.desc(weight), key).rowsBetween(Window.unboundedPreceding, -1)
            marked = left.select(key, area, weight, F.lit(0).alias("_p"))
            marked = marked if picked is None else marked.unionByName(picked.select(key, area, weight, F.lit(1).alias("_p")))
            ahead = marked.select(key, "_p", F.coalesce(F.sum("_p").over(before), F.lit(0)).alias("_used"), F.count("*").over(before).alias("_ahead")).where("_p = 0")
            ahead = written(ahead, "ahead")  # of the heavier places of its area: how many are picked, and how many picked or undecided
            free = free.join(ahead.where(F.col("_ahead") < quota).select(key), key, "left_semi")
            over = ahead.where(F.col("_used") >= quota).select(key)
        top = written(free, "picked")
        picked = top if picked is None else picked.unionByName(top)
        gone = pairs.join(top.select(F.col(key).alias(f"{key}_r")), f"{key}_r", "left_semi").select(key).union(top.select(key)).union(over)
        left = written(left.join(gone, key, "left_anti"), "left")
    return places.limit(0) if picked is None else picked


def bilinear(points: DataFrame, cells: DataFrame) -> DataFrame:
    """Points (..., x, y) with ``value`` between the known ones of the four cells (row, col, value) around them; without any, no row."""
    low_x, low_y = F.floor("x"), F.floor("y")
    corners = F.array(*[F.struct((low_x + i).alias("col"), (low_y + j).alias("row")) for i in (0, 1) for j in (0, 1)])
    wide = points.withColumn("_c", F.explode(corners)).withColumn("col", F.col("_c.col")).withColumn("row", F.col("_c.row")).drop("_c")
    share = (1 - F.abs(F.col("x") - F.col("col"))) * (1 - F.abs(F.col("y") - F.col("row")))
    known = wide.join(cells.where("value IS NOT NULL"), ["row", "col"]).withColumn("_w", share)
    return known.groupBy(*points.columns).agg((F.sum(F.col("_w") * F.col("value")) / F.sum("_w")).alias("value"), F.sum("_w").alias("_w")).where("_w > 0").drop("_w")


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting: whether a point lies in a ring, an array of (x, y) structs without a repeated end."""
    n = F.size(ring)
    crossing = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.when(
            (F.get(ring, i)["y"] > y) != (F.get(ring, F.pmod(i + 1, n))["y"] > y),
            (
                x
                < (F.get(ring, F.pmod(i + 1, n))["x"] - F.get(ring, i)["x"]) * (y - F.get(ring, i)["y"])
                / (F.get(ring, F.pmod(i + 1, n))["y"] - F.get(ring, i)["y"]) + F.get(ring, i)["x"]
            ).cast("int"),
        ).otherwise(0),
    )
    return F.aggregate(crossing, F.lit(0), lambda a, c: a + c) % 2 == 1


def near_polygons(points: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """Points with the polygons (area, ring) whose box meets their cell: all that may hold them, edges included."""
    low = lambda axis: F.array_min(F.transform("ring", lambda p: p[axis]))
    high = lambda axis: F.array_max(F.transform("ring", lambda p: p[axis]))
    cells = lambda axis: F.sequence(F.floor(low(axis) / cell), F.floor(high(axis) / cell))
    boxes = polygons.withColumn("_x", F.explode(cells("x"))).withColumn("_y", F.explode(cells("y")))
    placed = points.withColumn("_x", _cell("lon", cell)).withColumn("_y", _cell("lat", cell))
    return placed.join(boxes, ["_x", "_y"]).drop("_x", "_y")


def in_polygons(points: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """Points joined to the polygons (area, ring) that hold them: cells of each polygon's box, then ray casting.

    Of a point on an edge rounding decides; where edges have to be in or out as a whole, ask ``near_polygons`` and compare.
    """
    return near_polygons(points, polygons, cell).where(inside(F.col("lon"), F.col("lat"), F.col("ring"))).drop("ring")
