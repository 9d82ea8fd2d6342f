"""Scalar functions as column expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .times import micros

UNIT = 10**12
#: Abramowitz and Stegun 7.1.26.
ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
ERF_P = 0.3275911
EULER = 0.5772156649


def ieee_ratio(part: Column, whole: Column) -> Column:
    """part / whole as floating-point division has it: nothing of nothing is NaN (above every number, as Spark and SQL compare), something of nothing infinite."""
    a, b = part.cast("double"), whole.cast("double")
    return F.when(b != 0, F.try_divide(a, b)).when(a == 0, F.lit(math.nan)).when(b.isNotNull(), F.signum(a) * math.inf)


def ieee_log10(x: Column) -> Column:
    """log10, minus infinity of 0; null below."""
    return F.when(x == 0, F.lit(-math.inf)).otherwise(F.log10(x))


def _by_row(f, x: Column) -> Column:
    """f of each value of a column; infinity where it is too large."""

    def value(v: float) -> float | None:
        try:
            return f(v)
        except OverflowError:
            return math.inf

    @F.pandas_udf("double")
    def each(values: pd.Series) -> pd.Series:
        return values.map(value, na_action="ignore").astype("float64")

    return each(x)


def c_exp(x: Column) -> Column:
    """exp to the last bit as the C library has it, which SQL engines call: the JVM's is another last bit in some rows, so that ranks and ties by it differ."""
    return _by_row(math.exp, x)


def c_log10(x: Column) -> Column:
    """log10 to the last bit as the C library has it; minus infinity of 0, null below."""
    return _by_row(lambda v: math.log10(v) if v > 0 else -math.inf if v == 0 else None, x)


def c_power(base: float, x: Column) -> Column:
    """A power of a positive number to the last bit as the C library has it."""
    return _by_row(lambda v: math.pow(base, v), x)


def erf(x: Column) -> Column:
    t = 1 / (1 + ERF_P * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF):
        poly = (poly + a) * t
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def normal_cdf(x: Column) -> Column:
    return 0.5 * (1 + erf(x / math.sqrt(2)))


def isolation_depth(n: Column) -> Column:
    """2 (ln(n - 1) + gamma) - 2 (n - 1) / n; 0 for one or none."""
    return F.when(n > 1, 2 * (F.log(n - 1) + EULER) - 2 * (n - 1) / n).otherwise(0.0)


def format_amount(value: Column, ticker: str = "UNIT", unit: int = UNIT) -> Column:
    """Whole units with thousands commas and a ticker; from a million M, from a thousand K with one decimal."""
    whole = F.floor(value / unit)
    short = F.when(whole >= 10**6, F.concat(F.format_number(F.floor(whole / 10**5) / 10, 1), F.lit("M"))).when(whole >= 1000, F.concat(F.format_number(F.floor(whole / 100) / 10, 1), F.lit("K")))
    return F.concat_ws(" ", F.coalesce(short, F.format_number(whole, 0)), F.lit(ticker))


def commas(n: Column) -> Column:
    return F.format_number(n, 0)


def transfer_label(count: Column, value: Column, unit: int = UNIT) -> Column:
    """How many transfers, and their volume in whole units."""
    return F.concat(count.cast("string"), F.lit(" ⇆ "), F.format_number(F.floor(value / unit), 0))


def log_scale(value: Column, low: float, high: float) -> Column:
    """Where a value lies between low and high on a log scale, in [0, 1]."""
    x = (F.log10(F.greatest(value, F.lit(low))) - math.log10(low)) / (math.log10(high) - math.log10(low))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def truncate_address(address: Column, front: int = 6, back: int = 4) -> Column:
    return F.when(F.length(address) <= front + back, address).otherwise(F.concat(F.substring(address, 1, front), F.lit("..."), F.right(address, F.lit(back))))


def relative_time(seconds: Column) -> Column:
    """just now, Nm ago, Nh ago or Nd ago."""
    n = lambda k, s: F.concat(F.floor(seconds / k).cast("string"), F.lit(f"{s} ago"))
    return F.when(seconds < 60, "just now").when(seconds < 3600, n(60, "m")).when(seconds < 86400, n(3600, "h")).otherwise(n(86400, "d"))


def undirected_key(a: Column, b: Column) -> Column:
    return F.concat_ws("-", F.least(a, b), F.greatest(a, b))


def edge_id(a: Column, b: Column) -> Column:
    return F.concat_ws("->", a, b)


#: Base-58 without 0, O, I and l, at least 46 characters.
ADDRESS = "^[1-9A-HJ-NP-Za-km-z]{46,}$"


def looks_like_address(text: Column) -> Column:
    return F.coalesce(text.rlike(ADDRESS), F.lit(False))


def repair_address(text: Column) -> Column:
    """Characters that base-58 leaves out, taken for those they are mistaken for."""
    return F.translate(text, "0OIl", "oo11")


def price(value: Column, rate: Column, unit: int = UNIT) -> Column:
    return value.cast("double") / unit * rate


def trailing_zeros(amount: Column) -> Column:
    """How many zeros an amount ends with: round amounts have many."""
    text = amount.cast("string")
    return F.length(text) - F.length(F.regexp_replace(text, "0*$", ""))


def time_bucket(timestamp: Column, seconds: int = 300) -> Column:
    """The epoch second at which a timestamp's bucket begins."""
    return F.floor(micros(timestamp) / (seconds * 1_000_000)) * seconds


def block_bucket(block: Column, blocks: int) -> Column:
    return F.floor(block / blocks) * blocks


def extend_path(path: Column, vertex: Column) -> Column:
    """The path with a vertex at its end; null if the vertex is on it already."""
    return F.when(~F.array_contains(path, vertex), F.array_append(path, vertex))


def path_edges(path: Column) -> Column:
    """The edges a->b of a path in order; none for a path of one vertex."""
    tails = F.slice(path, F.lit(1), F.size(path) - 1)
    return F.zip_with(tails, F.slice(path, F.lit(2), F.size(path) - 1), lambda a, b: F.concat_ws("->", a, b))


def index_quantile(values: Column, share: float) -> Column:
    """The element of the sorted array at place floor(n * share), without interpolation; null for an empty array."""
    at = F.least(F.floor(F.size(values) * share), F.size(values) - 1).cast("int")
    return F.when(F.size(values) > 0, F.element_at(F.array_sort(values), at + 1))


def top_values(values: Column, n: int) -> Column:
    """The n largest elements, largest first."""
    return F.slice(F.sort_array(values, asc=False), 1, n)
