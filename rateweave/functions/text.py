"""String and date expressions; all of them stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Link format and id width of the external catalogue, and its genre conventions.
LINK_PREFIX = "https://www.imdb.com/title/tt"
LINK_SUFFIX = "/"
EXT_ID_WIDTH = 7
UNLISTED_GENRE = "(no genres listed)"


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def zero_pad(c: Column | str, width: int = EXT_ID_WIDTH) -> Column:
    """Left-pad with zeros; longer values are kept whole, which ``lpad`` would cut."""
    text = _column(c).cast("string")
    return F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(0), F.lit(width) - F.length(text))), text)


def link_url(ext_id: Column | str, prefix: str = LINK_PREFIX, suffix: str = LINK_SUFFIX) -> Column:
    return F.concat(F.lit(prefix), zero_pad(ext_id), F.lit(suffix))


def split_list(c: Column | str, separator: str) -> Column:
    """Split on a literal separator."""
    quoted = "".join("\\" + ch if not ch.isalnum() else ch for ch in separator)
    return F.split(_column(c), quoted)


def parse_ids(c: Column | str) -> Column:
    """``'1,2,3'`` as an array of ints. Blank text gives an empty array, malformed elements null."""
    text = F.trim(_column(c))
    ids = F.transform(split_list(text, ","), lambda x: F.trim(x).try_cast("int"))
    return F.when(text == "", F.array().cast("array<int>")).otherwise(ids)


def release_year(title: Column | str, strict: bool = False) -> Column:
    """Characters -5..-2 of the title, or with ``strict`` a trailing ``(YYYY)`` and null without one."""
    c = _column(title)
    if strict:
        year = F.regexp_extract(c, r"\((\d{4})\)\s*$", 1)
        return F.when(year != "", year)
    return F.substring(c, -5, 4)


def epoch_year(seconds: Column | str, zone: str = "UTC") -> Column:
    """Calendar year of an epoch second in ``zone``, whatever the session time zone is."""
    origin = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    instant = origin + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), _column(seconds).cast("decimal(18,6)"))
    return F.year(F.convert_timezone(F.lit("UTC"), F.lit(zone), instant))


def title_case(name: Column | str) -> Column:
    """First character upper, the rest lower, as one word."""
    c = _column(name)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2147483647)))


def has_prefix(title: Column | str, prefix: str) -> Column:
    """Case-insensitive literal prefix test; an empty prefix matches nothing."""
    if prefix == "":
        return F.lit(False)
    return F.upper(F.substring(_column(title), 1, len(prefix))) == F.upper(F.lit(prefix))
