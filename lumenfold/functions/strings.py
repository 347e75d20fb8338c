"""String functions on names, paths and numbers, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_index(name: Column) -> Column:
    """The number before the last @; 0 without one."""
    return F.coalesce(F.regexp_extract(name, r"^\s*(\d+)[^@]*@", 1).try_cast("long"), F.lit(0)).cast("long")


def name_stack(name: Column) -> Column:
    """What follows the last @."""
    return F.substring_index(name, "@", -1)


def padded(number: Column, length: int) -> Column:
    """The last `length` digits, padded with zeros."""
    return F.lpad(F.pmod(number, F.lit(10**length)).cast("string"), length, "0")


def without_suffix(path: Column) -> Column:
    """The path up to the first .star, or else .mrcs, .dat or .mrc."""
    out = path
    for suffix in (".mrc", ".dat", ".mrcs", ".star"):
        out = F.when(F.instr(path, suffix) > 0, F.substring_index(path, suffix, 1)).otherwise(out)
    return out


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"[^/]*$", "")


def suffix(path: Column) -> Column:
    return F.substring_index(path, ".", -1)


def number_text(value: Column) -> Column:
    """Scientific for 0 < |v| < 1e-3 and |v| > 1e5, fixed otherwise; width 12, 6 decimals."""
    wide = F.abs(value)
    scientific = ((wide > 0) & (wide < 1e-3)) | (wide > 1e5)
    return F.when(scientific, F.format_string("%12.6e", value)).otherwise(F.format_string("%12.6f", value))


def int_list(text: Column) -> Column:
    """Comma-separated integers; what is no number is 0."""
    return F.transform(F.split(text, ","), lambda s: F.coalesce(F.trim(s).try_cast("int"), F.lit(0)))


def option_key(text: Column) -> Column:
    """A trimmed option name with one leading dash."""
    return F.regexp_replace(F.trim(text), "^-+", "-")


def iteration_of(path: Column) -> Column:
    """The number between _it and the last underscore; null without one."""
    return F.regexp_extract(path, r"_it(\d+)_[^_]*$", 1).try_cast("int")
