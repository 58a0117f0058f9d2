"""Nearest weather stations without comparing every airport with every station.

Points are put on the unit sphere, where straight-line distance orders points like
great-circle distance and there is no date line. The sphere is seen from its centre as the
six faces of a cube, and a face is cut into squares of 24 nested sizes, down to less than one
metre of ground. A station's code is its face and the interleaved binary digits of its two
places on it (a Morton code): the codes of all stations in a square of any size are one range.
An index of the ranges of LEVELS sizes, with the number of stations in each, is written once.
Level by level an airport looks up the ranges inside those it kept, and keeps only squares
that may hold one of its k nearest stations: those whose nearest point is not farther than the
farthest point of the closest squares that together hold k stations. Only the stations
in the squares of the last level are measured. Of stations at the very same place only k
need to be looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylag.functions.geo import haversine_km, unit_vector
from skylag.session import materialized

BITS = 24  # binary digits of a place on a face
# Digits that tell the squares of a level apart: at most 96 at first, and at most 32^2 in one of the level above.
LEVELS = (2, 7, 12, 17, 21, 24)
AXES = "xyz"
SLACK = 1e-9  # for rounding; half a centimetre of ground

EVEN = 0x5555555555555555  # every second binary digit


def _spread(place: Column) -> Column:
    """The binary digits of a number two places apart: read as digits to the base of four."""
    return F.conv(F.bin(place), 4, 10).cast("bigint")


def _gathered(code: Column) -> Column:
    """Every second binary digit of a code, side by side."""
    return F.conv(F.conv(code.bitwiseAND(F.lit(EVEN)).cast("string"), 10, 4), 2, 10).cast("bigint")


def _code() -> Column:
    """The face (two for the axis of the largest place, by its sign) and the Morton code of the other two places on it."""
    x, y, z = (F.col(f"__{a}") for a in AXES)
    largest = F.greatest(F.abs(x), F.abs(y), F.abs(z))
    axis = F.when(F.abs(x) == largest, 0).when(F.abs(y) == largest, 1).otherwise(2)
    major, first, second = (F.when(axis == 0, a).when(axis == 1, b).otherwise(c) for a, b, c in ((x, y, z), (y, x, x), (z, z, y)))

    def place(of: Column) -> Column:
        cell = F.floor((of / largest + 1) * 2.0 ** (BITS - 1)).cast("bigint")
        return F.greatest(F.lit(0), F.least(cell, F.lit((1 << BITS) - 1)))

    face = (axis * 2 + F.when(major < 0, 1).otherwise(0)).cast("bigint")
    return F.shiftleft(face, 2 * BITS).bitwiseOR(_spread(place(first))).bitwiseOR(F.shiftleft(_spread(place(second)), 1))


def _on_sphere(points: DataFrame) -> DataFrame:
    x, y, z = unit_vector("latitude", "longitude")
    return points.withColumns({"__x": x, "__y": y, "__z": z})


def _centres() -> dict[str, Column]:
    """The point on the sphere behind the middle of the square `__code` of `level`."""
    face = F.expr("shiftright(__code, 2 * level)")
    inside = F.expr("__code - shiftleft(shiftright(__code, 2 * level), 2 * level)")
    side = F.pow(F.lit(2.0), 1 - F.col("level"))
    first, second = ((_gathered(F.shiftright(inside, i)) + 0.5) * side - 1 for i in (0, 1))
    major = F.when(face % 2 == 1, -1.0).otherwise(1.0)
    axis = F.floor(face / 2)
    norm = F.sqrt(first * first + second * second + 1)
    places = {"x": (major, first, first), "y": (first, major, second), "z": (second, second, major)}
    return {f"__mid_{a}": F.when(axis == 0, p[0]).when(axis == 1, p[1]).otherwise(p[2]) / norm for a, p in places.items()}


def _reach(level: int) -> float:
    """No point of a square is farther from its middle: going from a face to the sphere makes no distance longer."""
    return 2.0 ** (0.5 - level)


def _possible(reached: DataFrame, level: int, k: int) -> DataFrame:
    """Of the occupied squares reached by each airport, those that may hold one of its k nearest."""
    apart = [F.col(f"__mid_{a}") - F.col(f"__{a}") for a in AXES]
    middle = F.sqrt(reduce(lambda p, q: p + q, [d * d for d in apart]))
    measured = reached.withColumns({"__near": middle - _reach(level), "__far": middle + _reach(level)})
    by_far = Window.partitionBy("airport_code").orderBy("__far", "__code").rowsBetween(Window.unboundedPreceding, -1)
    # The first square with which k stations are together; fewer stations than k: no bound.
    together = measured.withColumn("__before", F.coalesce(F.sum("__n").over(by_far), F.lit(0)))
    enough = F.min(F.when(F.col("__before") + F.col("__n") >= k, F.col("__far"))).over(Window.partitionBy("airport_code"))
    return together.withColumn("__bound", enough).filter(F.col("__bound").isNull() | (F.col("__near") <= F.col("__bound") + SLACK))


def nearest_stations(airports: DataFrame, stations: DataFrame, k: int = 1) -> DataFrame:
    """The k nearest stations per airport: (airport_code, station_id, distance_km, rank).

    `airports` has (airport_code, latitude, longitude), `stations` (station_id,
    latitude, longitude). Equal distances are ordered by station_id. Two tables are written:
    the stations with their codes, and the index.
    """
    places = _on_sphere(airports.select("airport_code", "latitude", "longitude"))
    places = places.filter(reduce(lambda p, q: p & q, [F.col(f"__{a}").isNotNull() for a in AXES]))
    same_place = Window.partitionBy("latitude", "longitude").orderBy("station_id")
    sites = stations.select("station_id", "latitude", "longitude").withColumn("__copy", F.row_number().over(same_place))
    coded = _on_sphere(sites.filter(F.col("__copy") <= k)).withColumn("__code", _code())
    sites = materialized(coded.select("station_id", "latitude", "longitude", "__code").sort("__code"), "stations")

    each = sites.select(F.explode(F.array(*[F.struct(F.lit(level).alias("level"), F.shiftright("__code", 2 * (BITS - level)).alias("__code")) for level in LEVELS])).alias("square"))
    counted = each.groupBy("square.level", "square.__code").agg(F.count(F.lit(1)).alias("__n"))
    index = materialized(counted.withColumns(_centres()), "station-index")
    point = ["airport_code", "latitude", "longitude", *[f"__{a}" for a in AXES]]
    kept = places.withColumn("__parent", F.lit(0).cast("bigint"))
    for above, level in zip((0, *LEVELS), LEVELS):
        parent = F.shiftright("__code", 2 * (level - above)) if above else F.lit(0).cast("bigint")
        squares = index.filter(F.col("level") == level).select("__code", "__n", *[f"__mid_{a}" for a in AXES], parent.alias("__parent"))
        reached = kept.join(squares, "__parent").drop("__parent")
        kept = _possible(reached, level, k).select(*point, F.col("__code").alias("__parent"))

    near = kept.select("airport_code", F.col("latitude").alias("__lat"), F.col("longitude").alias("__lon"), F.col("__parent").alias("__code"))
    distance = haversine_km("__lat", "__lon", "latitude", "longitude")
    measured = near.join(sites, "__code").select("airport_code", "station_id", distance.alias("distance_km"))
    # Rank <= k is applied on each side of the shuffle, so an airport ships k rows per task.
    order = Window.partitionBy("airport_code").orderBy("distance_km", "station_id")
    return measured.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def assign_station(airports: DataFrame, stations: DataFrame) -> DataFrame:
    """Every airport with its nearest station, null if there is none at all."""
    nearest = nearest_stations(airports, stations, 1).select("airport_code", "station_id")
    return airports.join(nearest, "airport_code", "left")
