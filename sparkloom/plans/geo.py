"""Maps: which columns hold places, points and centroids, projection and bubble sizes."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.plans.charts import match_rate, region_name

#: Names of latitude and longitude columns, and the bounds (south, north, west, east) of base maps.
LATITUDE = ("lat", "latitude", "위도", "y")
LONGITUDE = ("lon", "lng", "longitude", "경도", "x")
BOUNDS = {"korea": (33.0, 39.0, 124.0, 132.0), "seoul": (37.4, 37.72, 126.7, 127.22)}


def coordinate_columns(names: Sequence[str]) -> tuple[str | None, str | None]:
    find = lambda words: next((n for n in names if re.fullmatch("|".join(words), n.strip(), re.IGNORECASE)), None)
    return find(LATITUDE), find(LONGITUDE)


def points(df: DataFrame, lat: str, lon: str, base: str = "world") -> DataFrame:
    """Numeric points, within the bounds of the base map if it has any."""
    held = df.withColumns({"lat": F.col(lat).cast("double"), "lon": F.col(lon).cast("double")}).where("lat is not null and lon is not null")
    if base in BOUNDS:
        south, north, west, east = BOUNDS[base]
        held = held.where(F.col("lat").between(south, north) & F.col("lon").between(west, east))
    return held


def best_region_column(df: DataFrame, columns: Sequence[str], regions: DataFrame, name: str) -> str | None:
    """The first column with the best share of labels that match a region, at least a half."""
    best, found = 0.0, None
    for c in columns:
        rate = match_rate(df, c, regions, name).first().rate or 0.0
        if rate >= 0.5 and rate > best:
            best, found = rate, c
    return found


def region_index(regions: DataFrame, name: str, place: str) -> DataFrame:
    """key and region: the first name (by place) of each normalised key."""
    return regions.groupBy(region_name(F.col(name)).alias("key")).agg(F.min_by(name, place).alias("region"))


def centroids(df: DataFrame, label: str, province: str, centres: DataFrame) -> DataFrame:
    """df with lat and lon of its municipality: by province and name, else by a name that only one province has.

    centres: name, province, lat, lon; a few hundred rows of the caller's.
    """
    both = centres.select(region_name(F.col("name")).alias("__n"), region_name(F.col("province")).alias("__p"), F.col("lat").alias("__lat"), F.col("lon").alias("__lon"))
    alone = both.groupBy("__n").agg(F.count(F.lit(1)).alias("__k"), F.min("__lat").alias("__alat"), F.min("__lon").alias("__alon")).where("__k = 1").drop("__k")
    keyed = df.withColumns({"__n": region_name(F.col(label)), "__p": region_name(F.col(province))})
    met = keyed.join(both, ["__n", "__p"], "left").join(alone, "__n", "left")
    return met.withColumns({"lat": F.coalesce("__lat", "__alat"), "lon": F.coalesce("__lon", "__alon")}).drop("__n", "__p", "__lat", "__lon", "__alat", "__alon")


def transverse_mercator(lat: Column, lon: Column, zone: int = 52) -> tuple[Column, Column]:
    """Easting and northing in metres of WGS84 degrees, by the series to the sixth power."""
    a, f, k0 = 6378137.0, 1 / 298.257223563, 0.9996
    e2 = f * (2 - f)
    ep = e2 / (1 - e2)
    phi = F.radians(lat)
    s, c, t = F.sin(phi), F.cos(phi), F.tan(phi)
    n = a / F.sqrt(1 - e2 * s * s)
    t2, c2 = t * t, ep * c * c
    A = F.radians(lon - (zone * 6 - 183)) * c
    m = a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi) - (35 * e2**3 / 3072) * F.sin(6 * phi))
    east = 500000 + k0 * n * (A + (1 - t2 + c2) * F.pow(A, 3) / 6 + (5 - 18 * t2 + t2 * t2 + 72 * c2 - 58 * ep) * F.pow(A, 5) / 120)
    north = k0 * (m + n * t * (A * A / 2 + (5 - t2 + 9 * c2 + 4 * c2 * c2) * F.pow(A, 4) / 24 + (61 - 58 * t2 + t2 * t2 + 600 * c2 - 330 * ep) * F.pow(A, 6) / 720))
    return east, north


def bubble_size(df: DataFrame, value: str, name: str = "size") -> DataFrame:
    """6 to 36 by the place of a value between the least and the largest."""
    ends = F.broadcast(df.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi")))
    width = F.when(F.col("__hi") == F.col("__lo"), 1.0).otherwise(F.col("__hi") - F.col("__lo"))
    return df.join(ends).withColumn(name, 6 + 30 * (F.col(value) - F.col("__lo")) / width).drop("__lo", "__hi")


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres between two points."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0088 * F.asin(F.sqrt(h))
