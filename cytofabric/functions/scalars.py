"""Column functions on names, dates, codes and numbers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def marker_list(text: Column) -> Column:
    """Markers between semicolons: blanks dropped, each once."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ";"), lambda p: F.trim(p))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def component_name(study: Column, component: str) -> Column:
    """The study's name with the suffix of one of its component studies."""
    return F.concat(study, F.lit(" - "), F.lit(component))


def file_extension(name: Column) -> Column:
    """1 to 8 letters or digits behind the last dot, upper case; else empty."""
    return F.upper(F.regexp_extract(name, r"\.([A-Za-z0-9]{1,8})$", 1))


def normalise(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, "[ -]", "_"))


def publication_year(date: Column) -> Column:
    """Four digits at the start, else null."""
    year = F.regexp_extract(date, r"^([0-9]{4})", 1)
    return F.when(year != "", year)


def publication_text(publisher: Column, date: Column) -> Column:
    return F.concat_ws(" ", publisher, publication_year(date))


def looks_like_email(text: Column) -> Column:
    return text.rlike(r"^[A-Za-z0-9+_.-]+@[A-Za-z0-9.-]+$")


def iso_from_digits(text: Column, relative: bool = False, timepoint: Column | None = None) -> Column:
    """yyyymmdd as yyyy-mm-dd, with what the date is relative to and its timepoint behind."""
    out = F.regexp_replace(text, r"^([0-9]{4})([0-9]{2})([0-9]{2})$", "$1-$2-$3")
    out = F.concat(out, F.lit(" relative to birth date")) if relative else out
    return F.concat(out, F.lit(", timepoint "), timepoint.cast("string")) if timepoint is not None else out


def code(value: Column, meanings: Mapping[str, str], default: str = "") -> Column:
    """The meaning of a code, else default."""
    pairs = [F.lit(x) for pair in meanings.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), F.lit(default))


def metal_tag(tag: Column) -> Column:
    """169Tm as Tm169."""
    return F.regexp_replace(tag, r"^([0-9]+)([A-Za-z]+)$", "$2$1")


def feature_hash(method: Column, specifiers: Column, appendix: Column | None = None) -> Column:
    """SHA-256 that identifies a feature: its method, ordered specifiers and appendix."""
    return F.sha2(F.concat_ws("\u001f", method, specifiers, F.coalesce(appendix, F.lit("")) if appendix is not None else F.lit("")), 256)


def truncate(value: Column, decimals: int = 10) -> Column:
    scale = 10.0**decimals
    return (value * scale).cast("long") / scale


def json_number(value: Column) -> Column:
    """NaN and the infinities as null."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def log_ratio(a: Column, b: Column) -> Column:
    """log2(a / b); null where either is not positive."""
    return F.when((a > 0) & (b > 0), F.log2(a / b))


def clipped_strength(p: Column, most: float = 0.05) -> Column:
    """1 - p / most for p up to most, else 0."""
    return F.when(p.isNotNull(), 1 - F.least(p, F.lit(most)) / most)


def collection_tag(study: Column) -> Column:
    """The tag behind ' collection: ' at a study name's end, else empty."""
    return F.regexp_extract(study, r" collection: ([a-z0-9\-]{1,513})$", 1)


def without_tag(study: Column) -> Column:
    return F.regexp_replace(study, r" collection: [a-z0-9\-]{1,513}$", "")


def quantise(value: Column) -> Column:
    """A value in 0..1 as one byte with three exponent and five fraction bits; null stays null."""
    highest = (1 + 31 / 32) * 2**7 - 1
    v = 1 + value * highest
    e = F.floor(F.log2(F.greatest(v, F.lit(1e-12))))
    e = F.when(F.pow(F.lit(2.0), e + 1) <= v, e + 1).when(F.pow(F.lit(2.0), e) > v, e - 1).otherwise(e)
    byte = 32 * e + F.floor(32 * (v / F.pow(F.lit(2.0), e) - 1))
    return F.when(value.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(255), byte))).cast("smallint")


def dequantise(byte: Column) -> Column:
    highest = (1 + 31 / 32) * 2**7 - 1
    return ((1 + byte % 32 / 32.0) * F.pow(F.lit(2.0), F.floor(byte / 32.0)) - 1) / highest
