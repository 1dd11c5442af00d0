"""Date formats in Python's notation as Java patterns and as regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The directives that formats may hold, as Java patterns and as the text they must match.
JAVA = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%z": "XX", "%Z": "z", "%I": "hh", "%p": "a", "%f": "SSSSSS", "%b": "MMM", "%B": "MMMM", "%j": "DDD"}
REGEX = {
    "%Y": "[0-9]{4}", "%y": "[0-9]{2}", "%m": "[0-9]{2}", "%d": "[0-9]{2}", "%H": "[0-9]{2}", "%M": "[0-9]{2}", "%S": "[0-9]{2}",
    "%z": r"(?:Z|[+-][0-9]{2}:?[0-9]{2})", "%Z": "[A-Z]{0,3}", "%I": "[0-9]{2}", "%p": "(?i:AM|PM)", "%f": "[0-9]{1,6}",
    "%b": "[A-Za-z]{3}", "%B": "[A-Za-z]+", "%j": "[0-9]{3}",
}
ISO_DATE, ISO_DATETIME, ISO_TIME = "%Y-%m-%d", "%Y-%m-%dT%H:%M:%S", "%H:%M:%S"

_token = re.compile(r"%[A-Za-z]|.", re.DOTALL)


def to_java(python_format: str) -> str:
    """Letters that are no directive are quoted."""
    parts = []
    for token in _token.findall(python_format):
        if len(token) == 2:
            if token not in JAVA:
                raise ValueError(f"unsupported directive {token} in {python_format!r}")
            parts.append(JAVA[token])
        else:
            parts.append(f"'{token}'" if token.isalpha() else token)
    return "".join(parts)


def to_regex(python_format: str) -> str:
    """Matches the whole string; a trailing newline does not pass."""
    body = "".join(REGEX.get(token) or re.escape(token) for token in _token.findall(python_format))
    return rf"\A{body}\z"


def parse(text: Column, python_format: str) -> Column:
    """A timestamp where the text has exactly this format and is a real date, else null."""
    formats = [to_java(python_format)]
    if "%z" in python_format:  # +0000 and +00:00 are different Java patterns
        formats.append(formats[0].replace("XX", "XXX"))
    found = F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])
    return F.when(F.regexp_like(text, F.lit(to_regex(python_format))), found)


_ANY = r"\A([0-9]{4})-?([0-9]{2})-?([0-9]{2})[T ]?([0-9]{2}):?([0-9]{2}):?([0-9]{2})(\.[0-9]{1,6})?(Z|[+-][0-9]{2}:?[0-9]{2})?\z"
_SHAPE = r"\A(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{8})[T ]?(?:[0-9]{2}:[0-9]{2}:[0-9]{2}|[0-9]{6})(?:\.[0-9]{1,6})?(?:Z|[+-][0-9]{2}:?[0-9]{2})?\z"
_SIXTEEN = r"\A[0-9]{8}T?[0-9]{8}\z"


def parse_any_datetime(text: Column) -> Column:
    """Every usual spelling of a datetime: dates and times with or without separators, fractions and offsets, and
    sixteen digits whose last two are an offset in hours. One normalising replacement and one parse."""
    sixteen = F.regexp_replace(F.regexp_replace(text, "T", ""), r"\A([0-9]{14})([0-9]{2})\z", "$1+$2:00")
    spelled = F.when(F.regexp_like(text, F.lit(_SIXTEEN)), sixteen).when(F.regexp_like(text, F.lit(_SHAPE)), text)
    offset = F.regexp_replace(F.regexp_extract(spelled, _ANY, 8), r"\A([+-][0-9]{2}):?([0-9]{2})\z", "$1:$2")
    iso = F.concat(F.regexp_replace(spelled, _ANY, "$1-$2-$3T$4:$5:$6$7"), offset)
    return iso.try_cast("timestamp")


def has_offset(text: Column) -> Column:
    return F.regexp_like(text, F.lit(r"(?:Z|[+-][0-9]{2}:?[0-9]{2})\z")) & F.regexp_like(text, F.lit(":|[0-9]{6}")) | F.regexp_like(text, F.lit(_SIXTEEN))
