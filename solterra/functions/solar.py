"""Solar position after the published NREL algorithm (Reda and Andreas 2004), as DataFrame functions.

The periodic series are tables: times are joined with the terms and summed once for each distinct time, and
the few geocentric numbers then go to the observers. The terms here are the leading ones of the published
series (azimuth and elevation within 0.001 degree of the full series in this century); `terms` takes others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Leading terms (A in 1e-8, B in radians, C in radians per Julian millennium) of the heliocentric series.
L0 = (
    (175347046, 0, 0), (3341656, 4.6692568, 6283.07585), (34894, 4.6261, 12566.1517), (3497, 2.7441, 5753.3849), (3418, 2.8289, 3.5231),
    (3136, 3.6277, 77713.7715), (2676, 4.4181, 7860.4194), (2343, 6.1352, 3930.2097), (1324, 0.7425, 11506.7698), (1273, 2.0371, 529.691),
    (1199, 1.1096, 1577.3435), (990, 5.233, 5884.927), (902, 2.045, 26.298), (857, 3.508, 398.149), (780, 1.179, 5223.694),
    (753, 2.533, 5507.553), (505, 4.583, 18849.228), (492, 4.205, 775.523), (357, 2.92, 0.067), (317, 5.849, 11790.629),
    (284, 1.899, 796.298), (271, 0.315, 10977.079), (243, 0.345, 5486.778), (206, 4.806, 2544.314), (205, 1.869, 5573.143),
    (202, 2.458, 6069.777), (156, 0.833, 213.299), (132, 3.411, 2942.463), (126, 1.083, 20.775), (115, 0.645, 0.98),
    (103, 0.636, 4694.003), (102, 0.976, 15720.839), (102, 4.267, 7.114), (99, 6.21, 2146.17), (98, 0.68, 155.42),
)
L1 = (
    (628331966747, 0, 0), (206059, 2.678235, 6283.07585), (4303, 2.6351, 12566.1517), (425, 1.59, 3.523), (119, 5.796, 26.298),
    (109, 2.966, 1577.344), (93, 2.59, 18849.23), (72, 1.14, 529.69), (68, 1.87, 398.15), (67, 4.41, 5507.55), (59, 2.89, 5223.69), (56, 2.17, 155.42),
)
L2 = ((52919, 0, 0), (8720, 1.0721, 6283.0758), (309, 0.867, 12566.152))
L3 = ((289, 5.844, 6283.076), (35, 0, 0), (17, 5.49, 12566.15))
B0 = ((280, 3.199, 84334.662), (102, 5.422, 5507.553), (80, 3.88, 5223.69), (44, 3.7, 2352.87), (32, 4, 1577.34))
R0 = ((100013989, 0, 0), (1670700, 3.0984635, 6283.07585), (13956, 3.05525, 12566.1517), (3084, 5.1985, 77713.7715), (1628, 1.1739, 5753.3849), (1576, 2.8469, 7860.4194), (925, 5.453, 11506.77), (542, 4.564, 3930.21))
R1 = ((103019, 1.10749, 6283.07585), (1721, 1.0644, 12566.1517))
SERIES = (("L", 0, L0), ("L", 1, L1), ("L", 2, L2), ("L", 3, L3), ("B", 0, B0), ("R", 0, R0), ("R", 1, R1))

# Leading nutation terms; multiples of D, M, M', F, Omega, then a, b (longitude) and c, d (obliquity).
NUTATION = (
    (0, 0, 0, 0, 1, -171996, -174.2, 92025, 8.9), (-2, 0, 0, 2, 2, -13187, -1.6, 5736, -3.1), (0, 0, 0, 2, 2, -2274, -0.2, 977, -0.5),
    (0, 0, 0, 0, 2, 2062, 0.2, -895, 0.5), (0, 1, 0, 0, 0, 1426, -3.4, 54, -0.1), (0, 0, 1, 0, 0, 712, 0.1, -7, 0),
    (-2, 1, 0, 2, 2, -517, 1.2, 224, -0.6), (0, 0, 0, 2, 1, -386, -0.4, 200, 0), (0, 0, 1, 2, 2, -301, 0, 129, -0.1),
    (-2, -1, 0, 2, 2, 217, -0.5, -95, 0.3), (-2, 0, 1, 0, 0, -158, 0, 0, 0), (-2, 0, 0, 2, 1, 129, 0.1, -70, 0), (0, 0, -1, 2, 2, 123, 0, -53, 0),
)
# Polynomials in Julian centuries, lowest power first.
ARGUMENTS = (
    (297.85036, 445267.111480, -0.0019142, 1 / 189474), (357.52772, 35999.050340, -0.0001603, -1 / 300000),
    (134.96298, 477198.867398, 0.0086972, 1 / 56250), (93.27191, 483202.017538, -0.0036825, 1 / 327270), (125.04452, -1934.136261, 0.0020708, 1 / 450000),
)
OBLIQUITY = (84381.448, -4680.93, -1.55, 1999.25, -51.38, -249.67, -39.05, 7.12, 27.87, 5.79, 2.45)
# TT - UT in seconds every five years from 1955 to 2005.
DELTA_T = (31.1, 33.2, 35.7, 40.2, 45.5, 50.5, 54.3, 56.9, 60.8, 63.8, 64.7)


def poly(x: Column, c: tuple[float, ...]) -> Column:
    out = F.lit(float(c[-1]))
    for k in reversed(c[:-1]):
        out = out * x + float(k)
    return out


def limit_degrees(x: Column) -> Column:
    return F.pmod(x, F.lit(360.0))


def julian_day(ts: Column) -> Column:
    """From a timestamp, whole seconds; one without zone is taken in the session's zone, which is to be UTC."""
    return F.unix_seconds(ts.cast("timestamp")) / 86400.0 + 2440587.5


def calendar_julian_day(year: Column, month: Column, day: Column) -> Column:
    """From year, month and fractional day; Julian calendar up to 2299160."""
    y, m = F.when(month < 3, year - 1).otherwise(year), F.when(month < 3, month + 12).otherwise(month)
    jd = F.floor(365.25 * (y + 4716)) + F.floor(30.6001 * (m + 1)) + day - 1524.5
    a = F.floor(y / 100)
    return F.when(jd > 2299160, jd + 2 - a + F.floor(a / 4)).otherwise(jd)


def delta_t(year: Column, mode: str = "reference") -> Column:
    """TT - UT in seconds: five-yearly values from 1955, elsewhere a parabola.

    mode: 'reference' divides the parabola's argument by 20, as results to be matched do; 'published' by 100.
    """
    u = (year - 1820) / {"reference": 20.0, "published": 100.0}[mode]
    table = F.get(F.array(*map(F.lit, DELTA_T)), F.floor((year - 1955) / 5).cast("int"))
    return F.when((year >= 1955) & (year < 2010), table).otherwise(-20 + 32 * u * u)


def terms_table(spark: SparkSession) -> DataFrame:
    """series, power, a, b, c."""
    return spark.createDataFrame([(s, p, float(a), float(b), float(c)) for s, p, t in SERIES for a, b, c in t], "series string, power int, a double, b double, c double")


def geocentric(times: DataFrame, mode: str = "reference", terms: DataFrame | None = None, dt: float | None = None) -> DataFrame:
    """ts, jd and the geocentric numbers of each distinct ts: nu, alpha, declination (degrees), parallax."""
    spark = times.sparkSession
    terms = terms if terms is not None else terms_table(spark)
    ts = F.col("ts")
    year = F.round(1970 + F.unix_seconds(ts.cast("timestamp")) / (365.25 * 86400.0)).cast("int")
    t = times.select("ts").where(ts.isNotNull()).distinct().withColumn("jd", julian_day(ts))
    t = t.withColumn("jde", F.col("jd") + (F.lit(float(dt)) if dt is not None else delta_t(year, mode)) / 86400.0)
    t = t.withColumn("jce", (F.col("jde") - 2451545.0) / 36525.0).withColumn("jme", F.col("jce") / 10)
    each = F.col("a") * F.cos(F.col("b") + F.col("c") * F.col("jme")) * F.pow("jme", "power") / 1e8
    sums = t.select("ts", "jme").join(F.broadcast(terms), how="cross").groupBy("ts").agg(*(F.sum(F.when(F.col("series") == s, each).otherwise(0.0)).alias(s) for s in "LBR"))
    t = t.join(sums, "ts")
    jce = F.col("jce")
    args = [poly(jce, c) for c in ARGUMENTS]
    psi = eps = F.lit(0.0)
    for *y, a, b, c, d in NUTATION:
        x = F.radians(sum((F.lit(float(k)) * v for k, v in zip(y, args) if k), F.lit(0.0)))
        psi, eps = psi + (a + b * jce) * F.sin(x), eps + (c + d * jce) * F.cos(x)
    t = t.withColumns({"psi": psi / 36e6, "deps": eps / 36e6, "theta": limit_degrees(F.degrees("L") + 180), "beta": -F.degrees("B")})
    t = t.withColumn("eps", poly(F.col("jme") / 10, OBLIQUITY) / 3600 + F.col("deps"))
    t = t.withColumn("lam", F.radians(F.col("theta") + F.col("psi") - 20.4898 / (3600 * F.col("R"))))
    jc = (F.col("jd") - 2451545.0) / 36525.0
    sidereal = limit_degrees(280.46061837 + 360.98564736629 * (F.col("jd") - 2451545.0) + 0.000387933 * jc * jc - jc * jc * jc / 38710000)
    e, b = F.radians("eps"), F.radians("beta")
    alpha = limit_degrees(F.degrees(F.atan2(F.sin("lam") * F.cos(e) - F.tan(b) * F.sin(e), F.cos("lam"))))
    declination = F.degrees(F.asin(F.sin(b) * F.cos(e) + F.cos(b) * F.sin(e) * F.sin("lam")))
    return t.select("ts", "jd", (sidereal + F.col("psi") * F.cos(e)).alias("nu"), alpha.alias("alpha"), declination.alias("declination"), (8.794 / (3600 * F.col("R"))).alias("parallax"))


def topocentric(rows: DataFrame) -> DataFrame:
    """Adds azimuth and elevation in degrees to rows with lat, lon, masl and geocentric's columns; azimuth clockwise from north, no refraction.

    Each step is a projection of its own, as every one is used more than once by the next.
    """
    c = F.col
    rows = rows.withColumns({"_phi": F.radians("lat"), "_h": F.radians(limit_degrees(c("nu") + c("lon") - c("alpha"))), "_d": F.radians("declination"), "_xi": F.sin(F.radians("parallax"))})
    rows = rows.withColumn("_u", F.atan(0.99664719 * F.tan("_phi")))
    rows = rows.withColumns({"_x": F.cos("_u") + c("masl") * F.cos("_phi") / 6378140.0, "_y": 0.99664719 * F.sin("_u") + c("masl") * F.sin("_phi") / 6378140.0})
    rows = rows.withColumn("_below", F.cos("_d") - c("_x") * c("_xi") * F.cos("_h"))
    rows = rows.withColumn("_da", F.atan2(-c("_x") * c("_xi") * F.sin("_h"), c("_below")))
    rows = rows.withColumns({"_d1": F.atan2((F.sin("_d") - c("_y") * c("_xi")) * F.cos("_da"), c("_below")), "_h1": c("_h") - c("_da")})
    elevation = F.degrees(F.asin(F.sin("_phi") * F.sin("_d1") + F.cos("_phi") * F.cos("_d1") * F.cos("_h1")))
    azimuth = limit_degrees(F.degrees(F.atan2(F.sin("_h1"), F.cos("_h1") * F.sin("_phi") - F.tan("_d1") * F.cos("_phi"))) + 180)
    return rows.withColumns({"azimuth": azimuth, "elevation": elevation})


def refraction(e0: Column, pressure: Column, temperature: Column) -> Column:
    """Elevation corrected for refraction; pressure in mbar, temperature in Celsius."""
    return e0 + (pressure / 1010) * (283 / (273 + temperature)) * 1.02 / (60 * F.tan(F.radians(e0 + 10.3 / (e0 + 5.11))))


def incidence(zenith: Column, azimuth: Column, tilt: Column, rotation: Column) -> Column:
    """Angle in degrees between sun and normal of a surface with that tilt, rotated from south."""
    z, w = F.radians(zenith), F.radians(tilt)
    return F.degrees(F.acos(F.cos(z) * F.cos(w) + F.sin(w) * F.sin(z) * F.cos(F.radians(azimuth - 180 - rotation))))


def positions(observers: DataFrame, times: DataFrame, **options) -> DataFrame:
    """observers' columns (lat, lon, masl among them), ts, azimuth, elevation: every observer at every distinct time."""
    geo = geocentric(times, **options)
    # the times are the small side; a broadcast only if their number is small
    few = times.select("ts").distinct().limit(20_001).count() <= 20_000
    rows = observers.join(F.broadcast(geo) if few else geo, how="cross")
    return topocentric(rows).select(*observers.columns, "ts", "azimuth", "elevation")


def sun_vector(azimuth: Column, elevation: Column) -> tuple[Column, Column, Column]:
    """Unit vector (sin az, cos az, tan el), normalised."""
    x, y, z = F.sin(F.radians(azimuth)), F.cos(F.radians(azimuth)), F.tan(F.radians(elevation))
    n = F.sqrt(x * x + y * y + z * z)
    return x / n, y / n, z / n


def vector_of(azimuth: float, elevation: float) -> tuple[float, float, float]:
    a, e = math.radians(azimuth), math.radians(elevation)
    v = (math.sin(a), math.cos(a), math.tan(e))
    n = math.sqrt(sum(c * c for c in v))
    return tuple(c / n for c in v)
