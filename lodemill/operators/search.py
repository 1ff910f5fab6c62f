"""Full-text search and geographic search."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodemill.errors import InvalidArgument
from lodemill.functions.literals import FLOAT, INT, type_of

#: Mean radius of the earth in km, longest term.
EARTH_KM = 6371.0088
TERM_CHARS = 63


def terms_of(text: str) -> list[str]:
    """Runs of ASCII letters and digits, lower-cased, at most 63 characters of each."""
    return [w.lower()[:TERM_CHARS] for w in re.findall(r"[A-Za-z0-9]+", text)]


def _held(terms: list[str]) -> str:
    """Pattern of a word that counts as one of the terms; for a term of the greatest length, any word that begins with it.

    The look behind comes after the first character, as most places of a text fail there already.
    """
    letters = lambda t: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in t)
    one = lambda t: f"{letters(t[0])}(?<![A-Za-z0-9].){letters(t[1:])}" + ("" if len(t) == TERM_CHARS else "(?![A-Za-z0-9])")
    return "|".join(map(one, terms))


def text_search(df: DataFrame, query: str, fields: list[str] | None = None, match_all: bool = False, limit: int = 0) -> DataFrame:
    """Rows that hold any (or all) of the query's terms, with ``_score``: how often they hold them.

    A term that the query repeats counts as often. Sorted by score, then id. 0: no limit.
    """
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    fields = texts if fields is None else [f for f in fields if f in texts]
    terms = terms_of(query)
    if not fields:
        raise InvalidArgument("no text column to search")
    if not terms:
        raise InvalidArgument("the query has no term")
    columns = [F.col(f"`{f}`") for f in fields]
    distinct = list(dict.fromkeys(terms))
    holds = lambda some: reduce(lambda a, b: a | b, [F.coalesce(c.rlike(_held(some)), F.lit(False)) for c in columns])
    # A row that holds a term scores; so what has none is never counted.
    found = df.filter(reduce(lambda a, b: a & b, [holds([t]) for t in distinct]) if match_all else holds(distinct))
    weights = sorted({terms.count(t) for t in distinct})
    counts = [F.coalesce(F.regexp_count(c, F.lit(_held([t for t in distinct if terms.count(t) == w]))), F.lit(0)) * w for w in weights for c in columns]
    found = found.withColumn("_score", reduce(lambda a, b: a + b, counts).cast("long"))
    found = found.orderBy(F.desc("_score"), *(["id"] if "id" in df.columns else []))
    return found.limit(limit) if limit else found


def haversine_km(lat1: Column | float, lon1: Column | float, lat2: Column | float, lon2: Column | float) -> Column:
    lat1, lon1, lat2, lon2 = (F.radians(x if isinstance(x, Column) else F.lit(float(x))) for x in (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin((lat2 - lat1) / 2), F.lit(2.0)) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(2 * EARTH_KM) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def _coordinates(df: DataFrame, lat: str, lon: str) -> DataFrame | None:
    numeric = all(c in df.columns and type_of(df.schema[c].dataType) in (INT, FLOAT) for c in (lat, lon))
    return df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()) if numeric else None


def _check(lat: float, lon: float) -> None:
    if not (-90 <= lat <= 90 and -180 <= lon <= 180):
        raise InvalidArgument("latitude is -90 to 90, longitude -180 to 180")


def geo_near(df: DataFrame, lat: str, lon: str, at: tuple[float, float], max_km: float = 0, limit: int = 0) -> DataFrame:
    """Rows by distance (``_distance_km``, then id). 0: no bound. A band of latitudes is filtered first, for pushdown."""
    _check(*at)
    if max_km < 0 or limit < 0:
        raise InvalidArgument("max_km and limit are not negative")
    rows = _coordinates(df, lat, lon)
    if rows is None:
        return df.filter(F.lit(False)).withColumn("_distance_km", F.lit(0.0))
    if max_km:
        band = max_km / EARTH_KM * 57.29577951308232 + 1e-6
        rows = rows.filter(F.col(lat).between(at[0] - band, at[0] + band))
    rows = rows.withColumn("_distance_km", haversine_km(F.lit(float(at[0])), F.lit(float(at[1])), F.col(lat).cast("double"), F.col(lon).cast("double")))
    rows = rows.filter(F.col("_distance_km") <= max_km) if max_km else rows
    rows = rows.orderBy("_distance_km", *(["id"] if "id" in df.columns else []))
    return rows.limit(limit) if limit else rows


def geo_within_box(df: DataFrame, lat: str, lon: str, low: tuple[float, float], high: tuple[float, float]) -> DataFrame:
    """Rows inside the box, its edges included."""
    _check(*low)
    _check(*high)
    if low[0] > high[0] or low[1] > high[1]:
        raise InvalidArgument("the box is turned around")
    rows = _coordinates(df, lat, lon)
    if rows is None:
        return df.filter(F.lit(False))
    return rows.filter(F.col(lat).between(low[0], high[0]) & F.col(lon).between(low[1], high[1]))
