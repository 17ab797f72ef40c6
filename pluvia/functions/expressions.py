"""Column expressions: tolerant parsing, units, categories, attenuation to rain, distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 1-minute precipitation codes and their categories.
PRECIP_CODES = {
    "NP": "dry",
    "R": "rain", "R+": "rain", "R-": "rain",
    "S": "snow", "S+": "snow", "S-": "snow",
    "P": "precip", "P?": "precip",
    "M": "missing", "?0": "missing", "?1": "missing", "?2": "missing", "?3": "missing",
}
#: Order in which categories are reported.
PRECIP_ORDER = ["dry", "rain", "snow", "precip", "missing"]
#: Strings that stand for no value.
NO_VALUE = ["", "nan", "None"]
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
EARTH_KM = 6371.0088


def parse_number(text: Column) -> Column:
    """Double of a plain decimal number, null of anything else ('M', 'T', 'NaN', '1.0d', '')."""
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def clean_number(x: Column, sentinel: float | None = None) -> Column:
    """NaN, and a sentinel for missing values, become null."""
    x = F.when(~F.isnan(x), x)
    return x if sentinel is None else F.nullif(x, F.lit(float(sentinel)))


def null_text(text: Column) -> Column:
    """Null where the text stands for no value."""
    return F.when(~text.isin(NO_VALUE), text)


def fahrenheit_to_celsius(f: Column) -> Column:
    return (f - 32) * 5 / 9


def knots_to_ms(kt: Column) -> Column:
    return kt * 0.51444


def inches_to_mm(inch: Column) -> Column:
    return inch * 25.4


def mhz_to_ghz(mhz: Column) -> Column:
    return mhz / 1000


def precip_category(code: Column) -> Column:
    """dry, rain, snow, precip or missing of a precipitation code; known codes first, then the first letter decides."""
    code = F.trim(code)
    known = F.create_map(*[F.lit(x) for kv in PRECIP_CODES.items() for x in kv])
    upper = F.upper(code)
    by_letter = F.when(upper == "NP", "dry")
    for letter, category in (("R", "rain"), ("S", "snow"), ("P", "precip")):
        by_letter = by_letter.when(upper.startswith(letter), category)
    return F.when(code.isNull() | code.isin(NO_VALUE), "missing").otherwise(F.coalesce(F.try_element_at(known, code), by_letter, F.lit("missing")))


def unpack_radar(v: Column) -> Column:
    """dBZ of a byte; 255 is missing."""
    return F.when(v != 255, v * 0.4 - 30)


def non_negative(x: Column) -> Column:
    """Negative values become 0; null stays null (greatest() would give 0)."""
    return F.when(x < 0, 0.0).otherwise(x)


def rain_from_attenuation(attenuation: Column, length_km: Column) -> Column:
    """The plain power law with exponent 1: mm/h; negative and missing become 0. Coefficient and guard are fixed values."""
    return F.coalesce(non_negative(attenuation / (0.091 * length_km + 1e-10)), F.lit(0.0))


def rain_power_law(attenuation: Column, length_km: Column, a: Column, b: Column, r_min: float = 0.3) -> Column:
    """R = (A / (a L)) ** (1 / b) for coefficients of frequency and polarization; below r_min and missing become 0."""
    r = F.pow(F.try_divide(F.greatest(attenuation, F.lit(0.0)), a * length_km), 1 / b)
    return F.when(attenuation.isNull() | (r < r_min), 0.0).otherwise(F.coalesce(r, F.lit(0.0)))


#: Fixed values of the public recommendation on specific attenuation of rain: (a, b, c) of each bell, then slope and offset in log10 of GHz.
ATTENUATION = {
    ("a", "h"): ([(-5.33980, -0.10008, 1.13098), (-0.35351, 1.26970, 0.45400), (-0.23789, 0.86036, 0.15354), (-0.94158, 0.64552, 0.16817)], -0.18961, 0.71147),
    ("a", "v"): ([(-3.80595, 0.56934, 0.81061), (-3.44965, -0.22911, 0.51059), (-0.39902, 0.73042, 0.11899), (0.50167, 1.07319, 0.27195)], -0.16398, 0.63297),
    ("b", "h"): ([(-0.14318, 1.82442, -0.55187), (0.29591, 0.77564, 0.19822), (0.32177, 0.63773, 0.13164), (-5.37610, -0.96230, 1.47828), (16.1721, -3.29980, 3.43990)], 0.67849, -1.95537),
    ("b", "v"): ([(-0.07771, 2.33840, -0.76284), (0.56727, 0.95545, 0.54039), (-0.20238, 1.14520, 0.26809), (-48.2991, 0.791669, 0.116226), (48.5833, 0.791459, 0.116479)], -0.053739, 0.83433),
}


def power_law_coefficients(frequency_ghz: Column, polarization: Column) -> tuple[Column, Column]:
    """a and b of the power law A = a R ** b L for a frequency of 1 to 1000 GHz and a polarization (h..., v...; else null)."""
    x = F.log10(frequency_ghz)

    def curve(which: str, side: str) -> Column:
        bells, slope, offset = ATTENUATION[which, side]
        return sum((a * F.exp(-F.pow((x - b) / c, F.lit(2.0))) for a, b, c in bells), slope * x + offset)

    side = F.lower(F.substring(polarization, 1, 1))
    known = frequency_ghz.between(1, 1000)
    a, b = (F.when(known & (side == "h"), curve(w, "h")).when(known & (side == "v"), curve(w, "v")) for w in ("a", "b"))
    return F.pow(F.lit(10.0), a), b


def idw_weight(distance: Column, power: float = 2.0) -> Column:
    return F.try_divide(F.lit(1.0), F.pow(distance, F.lit(power)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def midpoint(a: Column, b: Column) -> Column:
    return (a + b) / 2


def short_label(text: Column, size: int = 12) -> Column:
    return F.when(F.char_length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def title_label(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def unit_label(quantity: str, system: Column) -> Column:
    """Unit of 'rate', 'total', 'temp' or 'wind' in system 'm' (metric) or 'e' (imperial)."""
    metric, imperial = {"rate": ("mm/h", "in/h"), "total": ("mm", "in"), "temp": ("°C", "°F"), "wind": ("km/h", "mph")}[quantity]
    return F.when(system == "m", metric).otherwise(imperial)


def file_name(name: Column, station: Column, first: Column, last: Column, kind: str = "csv") -> Column:
    """<name>_<station>_<first>_<last>.<kind>, days as yyyyMMdd."""
    return F.concat(F.concat_ws("_", name, station, F.date_format(first, "yyyyMMdd"), F.date_format(last, "yyyyMMdd")), F.lit(f".{kind}"))


def parse_time(text: Column) -> Column:
    """Timestamp of ISO text (its first 19 characters, T or a blank between) or of whole seconds since the epoch; null of anything else."""
    iso = F.try_to_timestamp(F.replace(F.substring(text, 1, 19), F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm:ss"))
    return F.when(text.rlike(r"^[+-]?[0-9]{1,11}$"), F.timestamp_seconds(text.try_cast("long"))).otherwise(iso)


def nested(payload: Column, path: str, default=None) -> Column:
    """A value within JSON text as string, by its path of names with dots between; the default where a part of it is missing."""
    return F.coalesce(F.get_json_object(payload, f"$.{path}"), F.lit(default).cast("string"))


def first_n(x: Column, n: int) -> Column:
    return F.slice(x, 1, n)


def features(*arrays: Column) -> Column:
    """Arrays of numbers of one row as one array of features."""
    return F.flatten(F.array(*arrays))


def boundaries(peak: Column, n: int = 10) -> Column:
    """Bounds of colour classes: 0, peak / n, ... below the peak; none if the peak isn't positive."""
    return F.when(peak > 0, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i * peak / n)).otherwise(F.array().cast("array<double>"))


def boundary_class(x: Column, peak: Column, n: int = 10) -> Column:
    """The class (1 to n) of boundaries() that a value lies in, the last one open; null below 0."""
    return F.when((x >= 0) & (peak > 0), F.least(F.lit(n), F.floor(x * n / peak).cast("int") + 1))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def detected(probability: Column) -> Column:
    """0 or 1: rounded, a half to the even number."""
    return F.bround(probability).cast("int")


def whole_days(seconds: Column) -> Column:
    return F.floor(seconds / 86400)


def projectile(t: Column, h0: float, v0: float, g: float) -> Column:
    return h0 + v0 * t - 0.5 * g * t * t


def projectile_rate(t: Column, v0: float, g: float) -> Column:
    return v0 - g * t


def lorenz(x: Column, y: Column, z: Column, sigma: float = 10.0, rho: float = 28.0, beta: float = 8 / 3) -> tuple[Column, Column, Column]:
    return sigma * (y - x), x * (rho - z) - y, x * y - beta * z


#: Operators that a symbolic search may use, by name.
UNARY = {
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "exp": F.exp, "square": lambda x: x * x, "cube": lambda x: x * x * x, "abs": F.abs, "sign": F.signum,
    "log": lambda x: F.when(x > 0, F.log(x)), "sqrt": lambda x: F.when(x >= 0, F.sqrt(x)), "inv": lambda x: F.try_divide(F.lit(1.0), x),
    "floor": F.floor, "ceil": F.ceil, "round": F.rint, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh,
    "asin": lambda x: F.when(F.abs(x) <= 1, F.asin(x)), "acos": lambda x: F.when(F.abs(x) <= 1, F.acos(x)), "atan": F.atan,
}
BINARY = {
    "+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": F.try_divide,
    "^": lambda a, b: F.pow(a, b), "max": F.greatest, "min": F.least, "mod": lambda a, b: F.try_mod(a, b),
}
