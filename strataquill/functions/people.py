"""Identities, time entries and time zones as they stand in commits, tags and reflogs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ENTRY = r"^(?s)(.*?)> (-?\d+) ([+-]\d+)$"
_BROKEN = r"^(?s)(.*?)>?\s+(-?\d+)\s+([-+]*\d+)\s*$"


def parse_timezone(text: Column) -> Column:
    """Struct (offset in seconds, negative_utc) of ``+hhmm`` or ``-hhmm``; null for anything else."""
    digits = F.abs(text.try_cast("int"))
    sign = F.when(text.startswith("-"), -1).otherwise(1)
    offset = sign * (F.floor(digits / 100) * 3600 + digits % 100 * 60)
    return F.when(text.rlike(r"^[+-]\d+$"), F.struct(offset.cast("int").alias("offset"), ((offset == 0) & text.startswith("-")).alias("negative_utc")))


def parse_timezone_broken(text: Column) -> Column:
    """As parse_timezone, but with a missing sign (plus) or several (the last counts; a double minus is one)."""
    clean = F.when(text.rlike(r"^\d"), F.concat(F.lit("+"), text)).otherwise(F.regexp_replace(text, r"^[+-]*([+-])", "$1"))
    return parse_timezone(clean)


def format_timezone(offset: Column, negative_utc: Column | None = None) -> Column:
    """Inverse of parse_timezone; null if the offset is no whole number of minutes."""
    minus = (offset < 0) | ((offset == 0) & negative_utc if negative_utc is not None else F.lit(False))
    a = F.abs(offset)
    text = F.format_string("%s%02d%02d", F.when(minus, "-").otherwise("+"), F.floor(a / 3600).cast("int"), F.floor(a / 60).cast("int") % 60)
    return F.when(offset % 60 == 0, text)


def parse_time_entry(text: Column, broken: bool = False) -> Column:
    """Struct (person, time, offset, negative_utc) of ``Name <mail> seconds zone``; time is null if only a person stands there."""
    shape = _BROKEN if broken else _ENTRY
    full = text.rlike(shape)
    zone = (parse_timezone_broken if broken else parse_timezone)(F.regexp_extract(text, shape, 3))
    person = F.when(full, F.concat(F.regexp_extract(text, shape, 1), F.lit(">"))).otherwise(text)
    return F.struct(person.alias("person"), F.when(full, F.regexp_extract(text, shape, 2).try_cast("long")).alias("time"), F.when(full, zone["offset"]).alias("offset"), F.coalesce(F.when(full, zone["negative_utc"]), F.lit(False)).alias("negative_utc"))


def format_time_entry(person: Column, time: Column, offset: Column, negative_utc: Column | None = None) -> Column:
    return F.concat_ws(" ", person, time.cast("string"), format_timezone(offset, negative_utc))


def parse_identity(text: Column) -> Column:
    """Struct (name, email) of ``Name <mail>``; either part is null if it is empty."""
    shape = r"^(?s)\s*([^<]*?)\s*(?:<([^>]*)>?)?\s*$"
    name, mail = F.regexp_extract(text, shape, 1), F.regexp_extract(text, shape, 2)
    return F.struct(F.nullif(name, F.lit("")).alias("name"), F.nullif(mail, F.lit("")).alias("email"))


def split_email(text: Column) -> Column:
    """Struct (name, email): the part before `` <`` and the part inside the brackets."""
    return F.struct(F.regexp_extract(text, r"^(.*?) ?<", 1).alias("name"), F.regexp_extract(text, r"<([^>]*)>", 1).alias("email"))
