"""Column expressions: arithmetic with defined edge cases, text buckets, calendars, indicator columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_divide(n: Column, d: Column, default: float = 0.0) -> Column:
    """n / d; default where d is 0; NULL stays NULL."""
    return F.when(d == 0, F.when(n.isNotNull(), F.lit(float(default)))).otherwise(n / d)


def slug(c: Column) -> Column:
    """Lower-case words joined by underscores; `unknown` if nothing is left."""
    joined = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit("unknown"))


def keyword_bucket(c: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """Name of the first rule of which a keyword is in the text, whatever its case."""
    text = F.lower(c)
    out = None
    for name, words in rules:
        hit = F.lit(False)
        for word in words:
            hit = hit | text.contains(word.lower())
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(default) if out is None else out.otherwise(default)


def name_family(c: Column, families: Sequence[tuple[str, Sequence[str]]], other: str = "Other") -> Column:
    """Family of a feature's name: the first family with a keyword in it."""
    return keyword_bucket(c, families, other)


def cyclical(c: Column, period: float, offset: float = 0.0) -> tuple[Column, Column]:
    """Sine and cosine of the place in a cycle."""
    angle = 2 * F.pi() * (c - offset) / period
    return F.sin(angle), F.cos(angle)


def calendar_features(df: DataFrame, date: str, holiday: str, hour_ending: str | None = None) -> DataFrame:
    """Calendar columns of date (Monday is 0, ISO weeks, days since the first row), with cycles.

    With hour_ending (1 to 24) also the hours of day and week, peaks 7-9 and 16-18, nights 0-5; date
    must then be the day that the hour's end falls on.
    """
    d = F.col(date)
    weekday = F.weekday(d)
    first = df.agg(F.min(d).alias("_first"))
    out = df.join(F.broadcast(first)).withColumns({  # one row
        "year": F.year(d), "quarter": F.quarter(d), "month": F.month(d), "week": F.weekofyear(d),
        "day_of_year": F.dayofyear(d), "day": F.dayofmonth(d), "weekday": weekday,
        "is_weekend": (weekday >= 5).cast("int"),
        "is_working_day": ((weekday < 5) & (F.coalesce(F.col(holiday), F.lit(0)) == 0)).cast("int"),
        "days_since_start": F.datediff(d, F.col("_first")),
    }).drop("_first")
    cycles = [("month", "month", 12, 1), ("weekday", "weekday", 7, 0), ("year_day", "day_of_year", 365.25, 1)]
    if hour_ending:
        hour = F.pmod(F.col(hour_ending), F.lit(24))
        out = out.withColumns({"hour_of_day": hour, "hour_of_week": weekday * 24 + hour})
        h = F.col("hour_of_day")
        out = out.withColumns({
            "is_am_peak": h.between(7, 9).cast("int"), "is_pm_peak": h.between(16, 18).cast("int"),
            "is_peak": (h.between(7, 9) | h.between(16, 18)).cast("int"), "is_overnight": h.between(0, 5).cast("int"),
        })
        cycles += [("hour", "hour_of_day", 24, 0), ("week_hour", "hour_of_week", 168, 0)]
    for name, source, period, offset in cycles:
        sin, cos = cyclical(F.col(source), period, offset)
        out = out.withColumns({f"{name}_sin": sin, f"{name}_cos": cos})
    return out


#: Seasons of the southern hemisphere by month.
SOUTHERN = {12: "summer", 1: "summer", 2: "summer", 3: "autumn", 4: "autumn", 5: "autumn", 6: "winter", 7: "winter", 8: "winter", 9: "spring", 10: "spring", 11: "spring"}


def season(month: Column, names: Mapping[int, str] = SOUTHERN) -> Column:
    return F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[month]


def one_hot(df: DataFrame, column: str, prefix: str, categories: Sequence[str], drop_first: bool = False, null_as: str | None = None) -> DataFrame:
    """A 0/1 column for each category, named by prefix and category. NULL is no category, or null_as."""
    value = F.coalesce(F.col(column), F.lit(null_as)) if null_as else F.col(column)
    chosen = list(categories)[1 if drop_first else 0 :]
    return df.withColumns({f"{prefix}_{c}": F.coalesce((value == c).cast("int"), F.lit(0)) for c in chosen})


def transforms(c: Column) -> dict[str, Column]:
    """log1p, root, square, and the logarithm of what is left of negative values."""
    return {"log1p": F.log1p(c), "sqrt": F.sqrt(c), "square": c * c, "clipped_log1p": F.log1p(F.greatest(c, F.lit(0.0)))}


def interactions(pairs: Sequence[tuple[str, str]]) -> dict[str, Column]:
    return {f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in pairs}


def wind_vector(speed: Column, degrees: Column, available: Column, calm: float = 0.5) -> dict[str, Column]:
    """Direction's sine and cosine, the components the wind blows to, calm flag; all 0 without a sensor."""
    angle = F.radians(F.pmod(degrees, F.lit(360.0)))
    there = available == 1
    value = lambda x: F.when(there, F.coalesce(x, F.lit(0.0))).otherwise(0.0)
    return {
        "wind_sin": value(F.sin(angle)), "wind_cos": value(F.cos(angle)),
        "wind_u": value(-speed * F.sin(angle)), "wind_v": value(-speed * F.cos(angle)),
        "wind_calm": F.when(there & (speed <= calm), 1).otherwise(0),
    }


def rain_flags(rain: Column) -> dict[str, Column]:
    """More than 1, more than 10, and the logarithm of what isn't negative; NULL raises no flag."""
    return {
        "rain_wet": F.coalesce((rain > 1).cast("int"), F.lit(0)),
        "rain_heavy": F.coalesce((rain > 10).cast("int"), F.lit(0)),
        "rain_log1p": F.log1p(F.greatest(rain, F.lit(0.0))),
    }


def null_out_of_range(c: Column, low: float, high: float) -> Column:
    """NULL outside [low, high]; NULL stays."""
    return F.when(c.between(low, high), c)


def filter_not_negative(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without a negative value in columns; NULL isn't negative."""
    for c in columns:
        df = df.filter(F.coalesce(F.col(c) >= 0, F.lit(True)))
    return df


def clip_lower(c: Column, low: float = 0.0, enabled: bool = True) -> Column:
    return F.when(c < low, F.lit(low)).otherwise(c) if enabled else c


def quality_weight(flag: Column, weights: Mapping[str, float], default: float = 1.0) -> Column:
    out = F.lit(default)
    for name, weight in weights.items():
        out = F.when(flag == name, float(weight)).otherwise(out)
    return out


def entity_label(df: DataFrame, dim: DataFrame, on: str, road: str, place: str, short: Mapping[str, str]) -> DataFrame:
    """`label`: id, road with its words shortened, place; an id that dim doesn't know stays as it is."""
    words = F.create_map(*[F.lit(x) for pair in short.items() for x in pair])
    brief = F.array_join(F.transform(F.split(F.col(road), " "), lambda w: F.coalesce(words[w], w)), " ")
    named = dim.select(on, F.concat_ws(", ", F.concat_ws(" ", F.col(on).cast("string"), brief), F.col(place)).alias("label"))
    return df.join(named, on, "left").withColumn("label", F.coalesce("label", F.col(on).cast("string")))
