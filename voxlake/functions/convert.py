"""Conversions: loose booleans, times, sizes, paths, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxlake import constants as K


def to_bool(value: Column, variant: str = "read", default: bool = False) -> Column:
    """Loose text to boolean.

    ``read``: known words, else a whole number is true when nonzero, else the default.
    ``write``: true only for a known true word.
    ``config``: also y and n; anything else is the default.
    """
    text = F.lower(F.trim(value.cast("string")))
    if variant == "write":
        return F.coalesce(F.lower(value.cast("string")).isin(*K.TRUE_WORDS), F.lit(False))
    if variant == "config":
        return (
            F.when(text.isin(*K.CONFIG_TRUE_WORDS), True)
            .when(text.isin(*K.CONFIG_FALSE_WORDS), False)
            .otherwise(F.lit(default))
        )
    if variant == "read":
        return (
            F.when(text.isin(*K.TRUE_WORDS), True)
            .when(text.isin(*K.FALSE_WORDS), False)
            .otherwise(F.coalesce(text.try_cast("bigint") != 0, F.lit(default)))
        )
    raise ValueError(f"unknown variant {variant!r}")


def text_or(value: Column, default: str) -> Column:
    """The value, or the default where it is NULL or blank."""
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit(default))


def format_time(seconds: Column) -> Column:
    """MM:SS; hours stay in the minutes."""
    whole = F.floor(seconds)
    missing = seconds.isNull() | F.isnan(seconds) | (seconds == 0)
    minutes, rest = F.floor(seconds / 60), F.pmod(whole, F.lit(60))
    return F.when(missing, "00:00").otherwise(F.format_string("%02d:%02d", minutes, rest))


def format_size(size: Column) -> Column:
    """Bytes with a unit and at most one decimal."""
    units = ["B", "KB", "MB", "GB"]
    out = F.when(F.coalesce(size, F.lit(0)) == 0, "0 B")
    for power, unit in enumerate(units):
        number = F.regexp_replace(F.format_string("%.1f", F.round(size / 1024**power, 1)), r"\.0$", "")
        shown = F.concat(number, F.lit(" " + unit))
        out = out.when(size < 1024 ** (power + 1), shown) if unit != units[-1] else out.otherwise(shown)
    return out


def web_path(path: Column) -> Column:
    slashed = F.translate(path, "\\", "/")
    return F.when(slashed.startswith("/"), slashed).otherwise(F.concat(F.lit("/"), slashed))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def file_suffix(path: Column) -> Column:
    """The extension with its dot, '' where there is none; a leading dot is part of the name."""
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1)


def file_stem(path: Column) -> Column:
    name = file_name(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(file_suffix(path)))


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def iso_time(text: Column) -> Column:
    """NULL where the text is not a time."""
    return F.try_to_timestamp(text)


def parse_json_columns(df: DataFrame, schemas: dict[str, str]) -> DataFrame:
    """Text columns to structs, maps or arrays; text that is not valid JSON gives NULL."""
    parsed = {}
    for name, schema in schemas.items():
        text = F.col(name)
        valid = F.expr(f"try_parse_json(`{name}`)").isNotNull()
        parsed[name] = F.when(valid, F.from_json(text, schema))
    return df.withColumns(parsed)


def backoff(kind: str, attempts: int) -> list[float]:
    """Seconds waited after each failed attempt but the last."""
    waits = {
        "linear": lambda n: (n + 1) * 2.0,
        "exponential": lambda n: float(2**n),
        "half": lambda n: 0.5 * (n + 1),
    }[kind]
    return [waits(n) for n in range(max(0, attempts - 1))]


def backoff_column(kind: str, attempts: Column) -> Column:
    """``backoff`` for an attempt count held in a column."""
    steps = F.when(attempts >= 2, F.sequence(F.lit(0), (attempts - 2).cast("int"))).otherwise(
        F.array().cast("array<int>")
    )
    waits = {
        "linear": lambda n: (n + 1) * 2.0,
        "exponential": lambda n: F.pow(F.lit(2.0), n),
        "half": lambda n: (n + 1) * 0.5,
    }[kind]
    return F.transform(steps, waits)
