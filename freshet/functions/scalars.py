"""Column functions: cleaning, units, identifiers, calendar and geometry."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unit, dimension, scale and offset to the base unit of the dimension (base = value * scale + offset).
UNITS = (
    ("m3/s", "flow", 1.0, 0.0),
    ("ft3/s", "flow", 0.028316846592, 0.0),
    ("l/s", "flow", 0.001, 0.0),
    ("mm/d", "depth_rate", 1.0, 0.0),
    ("cm/d", "depth_rate", 10.0, 0.0),
    ("in/d", "depth_rate", 25.4, 0.0),
    ("mm", "length", 0.001, 0.0),
    ("cm", "length", 0.01, 0.0),
    ("m", "length", 1.0, 0.0),
    ("km", "length", 1000.0, 0.0),
    ("ft", "length", 0.3048, 0.0),
    ("in", "length", 0.0254, 0.0),
    ("km2", "area", 1.0, 0.0),
    ("mi2", "area", 2.589988110336, 0.0),
    ("ha", "area", 0.01, 0.0),
    ("k", "temperature", 1.0, 0.0),
    ("c", "temperature", 1.0, 273.15),
    ("f", "temperature", 5.0 / 9.0, 273.15 - 32.0 * 5.0 / 9.0),
)
#: Spellings that mean one of the units above, after unit_key's cleaning.
UNIT_SPELLINGS = {
    "m3/s": "cms cumecs m3s-1 m3/sec m3sec-1 cubicmeterspersecond cubicmetrespersecond cubicmeterpersecond cubicmetrepersecond",
    "ft3/s": "cfs ft3s-1 ft3/sec cubicfeetpersecond cubicfootpersecond cuft/s",
    "l/s": "ls-1 litrespersecond literspersecond",
    "mm/d": "mm/day mmd-1 mmday-1 millimetersperday millimetresperday",
    "cm/d": "cm/day cmd-1 cmday-1",
    "in/d": "in/day ind-1 inchesperday",
    "mm": "millimeters millimetres",
    "in": "inch inches",
    "ft": "feet foot",
    "mi2": "sqmi",
    "km2": "sqkm",
    "k": "kelvin degk",
    "c": "degc degreec degreesc degreecelsius degreescelsius celsius",
    "f": "degf degreef degreesf degreesfahrenheit fahrenheit",
}
UNIT_ALIASES = {spelling: unit for unit, spellings in UNIT_SPELLINGS.items() for spelling in spellings.split()}


def ieee_divide(a: Column, b: Column) -> Column:
    """a / b of doubles, with an infinity or NaN where b is 0, as SQL engines with IEEE division give."""
    zero = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).otherwise(float("nan"))
    return F.when(b == 0, F.when(a.isNotNull(), F.when(F.isnan(a), float("nan")).otherwise(zero))).otherwise(a / b)


def finite(value: Column) -> Column:
    """NULL in place of NaN and infinities."""
    v = value.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def day_of(text: Column) -> Column:
    """The calendar day in the first ten characters, NULL if they are none."""
    return F.try_to_date(F.substring(text.cast("string"), 1, 10), "yyyy-MM-dd")


def exclusive_end(end: Column) -> Column:
    """A day that stands for its whole self ends at the next midnight; other instants stay."""
    ts = end.cast("timestamp")
    return F.when(ts == F.date_trunc("day", ts), ts + F.expr("INTERVAL 1 DAY")).otherwise(ts)


def to_mm_per_day(discharge: Column, area_km2: Column) -> Column:
    """m3/s over a basin to mm a day; NULL without a positive area."""
    return F.when(area_km2 > 0, discharge * 86.4 / area_km2)


def unit_key(unit: Column) -> Column:
    """Spelling-free key of a unit: case, blanks, superscripts, degree signs and `_ ^ *` do not count."""
    key = F.translate(F.lower(F.translate(F.trim(unit), "²³¹⁻−µ", "231--u")), "°_^* ", "")
    table = F.create_map(*[F.lit(x) for pair in UNIT_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), key)


def _unit_part(key: Column, index: int) -> Column:
    table = F.create_map(*[F.lit(x) for u in UNITS for x in (u[0], u[index])])
    return F.try_element_at(table, key)


def convert(value: Column, from_unit: Column, to_unit: Column) -> Column:
    """Between units of one dimension; NULL for unknown units or different dimensions."""
    a, b = unit_key(from_unit), unit_key(to_unit)
    base = value * _unit_part(a, 2) + _unit_part(a, 3)
    return F.when(_unit_part(a, 1) == _unit_part(b, 1), (base - _unit_part(b, 3)) / _unit_part(b, 2))


def gauge_key(raw: Column) -> Column:
    """A station number of 8 to 15 digits from text with or without `USGS-`; NULL for anything else."""
    digits = F.regexp_extract(F.trim(raw.cast("string")), r"^(?:USGS-)?([0-9]{8,15})$", 1)
    return F.when(digits != "", digits)


def gauge_of_number(raw: Column) -> Column:
    """The same from an integer that lost its leading zeros: 7 to 15 digits; smaller numbers are counts, not stations."""
    text = raw.cast("bigint").cast("string")
    return F.when((raw >= 1_000_000) & (raw < 10**15), F.when(F.length(text) < 8, F.lpad(text, 8, "0")).otherwise(text))


def attribute_gauge(raw: Column) -> Column:
    """The 8 digits by which attribute tables go, of 7 or 8; NULL for anything else."""
    digits = F.regexp_extract(F.trim(raw.cast("string")), r"^([0-9]{7,8})$", 1)
    return F.when(digits != "", F.lpad(digits, 8, "0"))


def code_tokens(cell: Column) -> Column:
    """Codes in a cell that separates them by commas or blanks."""
    return F.filter(F.split(F.regexp_replace(F.coalesce(cell, F.lit("")), ",", " "), r"\s+"), lambda x: x != "")


def approval_tokens(cell: Column) -> Column:
    return F.filter(code_tokens(cell), lambda x: x.isin("A", "P"))


#: Products that are a station's measurements, and sources that are a model's output.
OBSERVATION_PRODUCTS = ("NWIS_STREAMFLOW",)
MODEL_SOURCES = ("cds_glofas", "geoglows_retro", "openmeteo_flood")


def information_class(product: Column, source: Column, site_resolution: Column | None = None) -> Column:
    """observation (of a known product, or resolved to a site), model_simulation (of a known source), else unclassified."""
    observed = product.isin(*OBSERVATION_PRODUCTS)
    if site_resolution is not None:
        observed = (F.coalesce(site_resolution.cast("string"), F.lit("")) != "") | observed
    return F.when(observed, "observation").when(source.isin(*MODEL_SOURCES), "model_simulation").otherwise("unclassified")


def water_year(day: Column) -> Column:
    """October to September, named by its last year."""
    return F.year(F.add_months(day, 3))


def custom_year(day: Column, first_month: int) -> Column:
    """A year from the first of first_month on, named by its first year."""
    return F.year(F.add_months(day, 1 - first_month))


def hargreaves_pet(tmin: Column, tmax: Column, srad: Column, day: Column) -> Column:
    """Daily potential evapotranspiration in mm: 0.0023 Ra (t + 17.8) sqrt(range), not below 0. Ra is 1.5 times the
    measured radiation (W/m2) in MJ, or a sine of the day of year where that is missing."""
    ra = F.coalesce(srad * 0.0864 * 1.5, 15 + 10 * F.sin(2 * F.pi() * (F.dayofyear(day) - 81) / 365))
    return F.greatest(F.lit(0.0023) * ra * ((tmin + tmax) / 2 + 17.8) * F.sqrt(F.greatest(tmax - tmin, F.lit(0.0))), F.lit(0.0))


def flood_depth(hand: Column, stage: Column) -> Column:
    """Water above the ground at a stage; NULL outside (no height above drainage)."""
    return F.when(hand.isNotNull(), F.greatest(stage - hand, F.lit(0.0)))


def normalised_difference(a: Column, b: Column) -> Column:
    return F.try_divide(a - b, a + b)


#: The two bands of each index (Rouse 1974, McFeeters 1996, Xu 2006, Key and Benson 2006, Zha 2003), and
#: the class that it has above its usual threshold.
INDICES = {
    "ndvi": ("nir", "red", 0.2, "vegetation"),
    "ndwi": ("green", "nir", 0.3, "open_water"),
    "mndwi": ("green", "swir1", 0.0, "open_water"),
    "nbr": ("nir", "swir2", 0.1, "unburned"),
    "ndbi": ("swir1", "nir", 0.0, "built_up"),
}


def spectral_index(name: str) -> Column:
    """The named index (in any case) of the band columns."""
    a, b, _, _ = INDICES[name.lower()]
    return normalised_difference(F.col(a).cast("double"), F.col(b).cast("double"))


def index_class(name: str, value: Column) -> Column:
    """The index's class above its threshold, else `other`; NULL without a value."""
    _, _, least, kind = INDICES[name.lower()]
    return F.when(value > least, kind).when(value.isNotNull(), "other")


#: Fixed values of the WGS84 ellipsoid: semi-axes in km.
WGS84_A, WGS84_B = 6378.137, 6356.752314245179


def _authalic() -> tuple[float, float, float]:
    """First eccentricity, q at the pole, and the radius in km of the sphere that has the ellipsoid's surface."""
    e = math.sqrt(1 - (WGS84_B / WGS84_A) ** 2)
    q = 1 + (1 - e * e) / (2 * e) * math.log((1 + e) / (1 - e))
    return e, q, WGS84_A * math.sqrt(q / 2)


ECCENTRICITY, POLE_Q, AUTHALIC_KM = _authalic()


def authalic_sine(lat: Column) -> Column:
    """Sine of the authalic latitude: bands between parallels have on the sphere of AUTHALIC_KM the ellipsoid's area (Snyder
    1987, 3-11 and 3-12)."""
    s = F.sin(F.radians(lat))
    e = ECCENTRICITY
    return ((1 - e * e) * (s / (1 - e * e * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))) / POLE_Q


def _steps(ring: Column, f) -> Column:
    """f(a, b) of each pair of consecutive points of a ring, summed up; a ring that does not end where it began is closed."""
    whole = F.when(F.get(ring, F.lit(0)) != F.element_at(ring, -1), F.concat(ring, F.slice(ring, 1, 1))).otherwise(ring)
    n = F.size(whole)
    parts = F.zip_with(F.slice(whole, 1, F.greatest(n - 1, F.lit(0))), F.slice(whole, 2, F.greatest(n - 1, F.lit(0))), f)
    return F.when(F.size(ring) >= 2, F.aggregate(parts, F.lit(0.0), lambda s, x: s + x))


def polygon_area_km2(ring: Column) -> Column:
    """Area of a ring of (lon, lat) structs on the WGS84 ellipsoid.

    Spherical excess of its edges (great circles) on the authalic sphere. Against geodesic edges of the ellipsoid the error
    is under 1e-5 of the area for basins (edges up to 100 km), and grows with the square of the edges' length. Edges may
    cross the date line; a ring around a pole is not told from its counterpart.
    """

    def excess(a: Column, b: Column) -> Column:
        d = F.radians(F.pmod(b["lon"] - a["lon"] + 180, F.lit(360.0)) - 180)
        ta, tb = (F.tan(F.asin(F.greatest(F.least(authalic_sine(p["lat"]), F.lit(1.0)), F.lit(-1.0))) / 2) for p in (a, b))
        return 2 * F.atan2(F.tan(d / 2) * (ta + tb), 1 + ta * tb)

    return F.abs(_steps(ring, excess)) * (AUTHALIC_KM * AUTHALIC_KM)


def ellipsoid_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Length of the geodesic between two points of the WGS84 ellipsoid, by Andoyer and Lambert's formula of first order in the
    flattening: within 1e-5 of the distance, points nearly opposite excepted."""
    flat = (WGS84_A - WGS84_B) / WGS84_A
    beta = lambda lat: F.atan((1 - flat) * F.tan(F.radians(lat)))
    b1, b2 = beta(lat1), beta(lat2)
    h = F.pow(F.sin((b2 - b1) / 2), 2) + F.cos(b1) * F.cos(b2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    sigma = 2 * F.asin(F.least(F.lit(1.0), F.sqrt(h)))
    p, q = F.pow(F.sin((b1 + b2) / 2) * F.cos((b2 - b1) / 2), 2), F.pow(F.cos((b1 + b2) / 2) * F.sin((b2 - b1) / 2), 2)
    x = (sigma - F.sin(sigma)) * F.coalesce(F.try_divide(p, F.pow(F.cos(sigma / 2), 2)), F.lit(0.0))
    y = (sigma + F.sin(sigma)) * F.coalesce(F.try_divide(q, F.pow(F.sin(sigma / 2), 2)), F.lit(0.0))
    return WGS84_A * (sigma - flat / 2 * (x + y))


def polygon_perimeter_km(ring: Column) -> Column:
    """Perimeter of a ring of (lon, lat) structs on the WGS84 ellipsoid, see `ellipsoid_km`."""
    return _steps(ring, lambda a, b: ellipsoid_km(a["lon"], a["lat"], b["lon"], b["lat"]))


def json_number(document: Column, path: str) -> Column:
    """A number at a path such as `a.b.c` of a JSON text; NULL if there is none."""
    return finite(F.get_json_object(document, "$." + path).try_cast("double"))


def wetness_index(upslope_area: Column, slope_degrees: Column) -> Column:
    """ln(a / tan b) after Beven and Kirkby (1979); NULL on flat cells and without area."""
    t = F.tan(F.radians(slope_degrees))
    return F.when((t > 0) & (upslope_area > 0), F.log(upslope_area / t))


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance on a sphere of 6371 km."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0 * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def line_length_km(coords: Column) -> Column:
    """Length of an array of (lon, lat) structs."""
    n = F.size(coords)
    pairs = F.zip_with(F.slice(coords, 1, F.greatest(n - 1, F.lit(0))), F.slice(coords, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: haversine_km(a["lon"], a["lat"], b["lon"], b["lat"]))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def scs_runoff(rain_mm: Column, curve_number: Column) -> Column:
    """Direct runoff in mm; NULL for a curve number outside (0, 100]."""
    s = 25400 / curve_number - 254
    q = F.when(rain_mm > 0.2 * s, F.pow(rain_mm - 0.2 * s, 2) / (rain_mm + 0.8 * s)).otherwise(0.0)
    return F.when((curve_number > 0) & (curve_number <= 100), q)


def kirpich_hours(length_m: Column, slope: Column) -> Column:
    """Time of concentration in hours for a channel of length_m metres."""
    return 0.0663 * F.pow(length_m / 1000, 0.77) * F.pow(slope, -0.385)


def triangular_hydrograph(area_km2: Column, tc_hours: Column, runoff_mm: Column) -> dict[str, Column]:
    """Duration, time to peak, peak (m3/s), base time (hours) and volume (m3) of the SCS triangular unit hydrograph."""
    duration = 0.133 * tc_hours
    peak_time = duration / 2 + 0.6 * tc_hours
    peak = F.when(runoff_mm > 0, 0.208 * area_km2 * runoff_mm / peak_time).otherwise(0.0)
    return {"duration_hr": duration, "time_to_peak_hr": peak_time, "peak_cms": peak, "base_time_hr": 2.67 * peak_time, "volume_m3": runoff_mm * area_km2 * 1000}


#: Typical cover factors by land cover, in the order in which parts of a name are looked for; other covers have 0.1.
COVER_FACTORS = {"water": 0.0, "wetland": 0.001, "forest": 0.003, "shrub": 0.03, "grass": 0.01, "pasture": 0.02, "cropland": 0.24, "crops": 0.24, "orchard": 0.1, "developed": 0.03, "urban": 0.03, "barren": 0.45, "bare": 0.45}


def cover_factor(name: Column, table: dict[str, float] = COVER_FACTORS, unknown: float = 0.1) -> Column:
    """A land cover's factor by its exact name, else by the first name of the table that it contains, else `unknown`."""
    text = F.lower(F.trim(name))
    part = F.lit(None).cast("double")
    for key, value in reversed(table.items()):
        part = F.when(F.contains(text, F.lit(key)), F.lit(float(value))).otherwise(part)
    for key, value in table.items():
        part = F.when(text == key, F.lit(float(value))).otherwise(part)
    return F.coalesce(part, F.lit(unknown))


def soil_erodibility(sand: Column, silt: Column, clay: Column, organic_carbon: Column) -> Column:
    """EPIC soil erodibility (Williams 1990) from percentages, in t ha h / (ha MJ mm)."""
    sn1 = 1 - sand / 100
    k = (0.2 + 0.3 * F.exp(-0.0256 * sand * (1 - silt / 100))) * F.pow(silt / (clay + silt), 0.3)
    k = k * (1 - 0.25 * organic_carbon / (organic_carbon + F.exp(3.72 - 2.95 * organic_carbon)))
    return 0.1317 * k * (1 - 0.7 * sn1 / (sn1 + F.exp(-5.51 + 22.9 * sn1)))


def slope_length_factor(length_m: Column, slope_percent: Column) -> Column:
    """Wischmeier and Smith (1978), with the exponent 0.5, 0.4, 0.3 or 0.2 by slope class."""
    m = F.when(slope_percent >= 5, 0.5).when(slope_percent >= 3.5, 0.4).when(slope_percent >= 1, 0.3).otherwise(0.2)
    angle = F.atan(slope_percent / 100)
    return F.pow(length_m / 22.13, m) * (65.41 * F.pow(F.sin(angle), 2) + 4.56 * F.sin(angle) + 0.065)


def erosion_severity(tonnes: Column) -> Column:
    return F.when(tonnes < 2, "low").when(tonnes < 10, "moderate").when(tonnes < 50, "high").when(tonnes >= 50, "severe")


def significant(value: Column, digits: int = 6) -> Column:
    """Rounded to significant digits."""
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(value))))
    return F.when(value == 0, 0.0).otherwise(F.round(value * scale) / scale)


def text_hash(text: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-256 of the lower-cased text with single blanks."""
    return F.substring(F.sha2(F.lower(F.btrim(F.regexp_replace(text, r"\s+", " "))), 256), 1, 16)
