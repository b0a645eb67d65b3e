"""Scalar helpers: tags, texts, times, identities, as expressions inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = "[0-9]+(_[0-9]+)*"
_INT = rf"^\s*[+-]?{_DIGITS}\s*$"
_FLOAT = rf"^\s*[+-]?(({_DIGITS}\.({_DIGITS})?|\.{_DIGITS}|{_DIGITS})([eE][+-]?{_DIGITS})?|(?i:inf|infinity|nan))\s*$"


def tag_value_kind(text: Column) -> Column:
    """What a tag's text stands for: null, json, int, float, bool or string; text that opens like JSON but isn't fails later."""
    return (
        F.when(text == "", "null").when(text.rlike(r"^[\[{\"]"), "json").when(text.rlike(_INT), "int").when(text.rlike(_FLOAT), "float")
        .when(text == "null", "null").when(text.isin("true", "false"), "bool").otherwise("string")
    )


def parse_tag_value(text: Column, strict: bool = True) -> Column:
    """The value as normalized JSON text; text that opens like JSON but isn't fails, or is null if not strict."""
    kind = tag_value_kind(text)
    plain = F.regexp_replace(F.trim(text), "_", "")
    held = F.to_json(F.try_parse_json(text))
    bad = F.raise_error(F.concat(F.lit("not JSON: "), text)) if strict else F.lit(None).cast("string")
    return (
        F.when(kind == "null", "null").when(kind == "json", F.coalesce(held, bad)).when(kind == "int", plain.try_cast("decimal(38,0)").cast("string"))
        .when(kind == "float", plain.try_cast("double").cast("string")).when(kind == "bool", text).otherwise(quote_json(text))
    )


def quote_json(text: Column) -> Column:
    """A text as a JSON string."""
    whole = F.to_json(F.struct(text.alias("a")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def parse_tag(text: Column, strict: bool = True) -> Column:
    """struct<key, value, has_value>: split at the first ``=``; an empty key fails, or gives a null struct if not strict."""
    at = F.instr(text, "=")
    key = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)
    value = F.when(at > 0, F.substring(text, at + 1, F.length(text)))
    whole = F.when(key != "", F.struct(key.alias("key"), value.alias("value"), (at > 0).alias("has_value")))
    return whole.when(key == "", F.raise_error(F.concat(F.lit("no key in tag "), text)).cast("struct<key:string,value:string,has_value:boolean>")) if strict else whole


def format_tag_value(text: Column) -> Column:
    """A string value as tag text: quoted if it has a space or comma, or would be read as something else."""
    return F.when(text.rlike("[ ,]") | (tag_value_kind(text) != "string"), quote_json(text)).otherwise(text)


def trim_string(text: Column, n: int, ellipsis: str = "...") -> Column:
    """At most n characters, ending in the ellipsis if cut."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - len(ellipsis)), F.lit(ellipsis))).otherwise(text)


def format_tag(key: Column, text: Column, n: int | None = None) -> Column:
    value = format_tag_value(text)
    return F.concat(trim_string(key, n) if n else key, F.lit("="), trim_string(value, n) if n else value)


def to_bool(text: Column) -> Column:
    """true and false in any case, else null."""
    low = F.lower(text)
    return F.when(low == "true", True).when(low == "false", False)


def format_timestamp(t: Column) -> Column:
    return F.date_format(t.cast("timestamp"), "yyyy-MM-dd HH:mm:ss")


def format_duration(us: Column) -> Column:
    """Microseconds as h:mm:ss.cc, of the part below a whole day."""
    day = F.pmod(us, F.lit(86_400_000_000))
    s = F.floor(day / 1_000_000)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), two(F.floor(s / 60) % 60), F.lit(":"), two(s % 60), F.lit("."), two(F.floor(F.pmod(day, F.lit(1_000_000)) / 10_000)))


def split_fullname(name: Column) -> Column:
    """struct<namespace, name>: at the last dot; without one the namespace is ''."""
    return F.struct(F.regexp_extract(name, r"^(.*)\.[^.]*$", 1).alias("namespace"), F.regexp_extract(name, r"([^.]*)$", 1).alias("name"))


def fullname(namespace: Column, name: Column) -> Column:
    return F.when(namespace != "", F.concat(namespace, F.lit("."), name)).otherwise(name)


def midpoint(n: Column) -> Column:
    """The least power of 2 that is at least half of n, and at least 1."""
    return F.greatest(F.lit(1), F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double")) - 1)).cast("bigint"))


def short_id(x: Column, n: int = 8) -> Column:
    return F.substring(x, 1, n)


def normalized_json(text: Column) -> Column:
    """JSON text with object members in order and no spaces; null if it isn't JSON."""
    return F.to_json(F.try_parse_json(text))
