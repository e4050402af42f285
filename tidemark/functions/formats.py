"""JSON-Schema string formats as Column predicates."""

from __future__ import annotations

import ipaddress
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.coerce import DATE_TEXT, TIME_TEXT, TIMESTAMP_TEXT

#: Patterns of the formats (fixed values).
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
HOSTNAME = r"^([A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?)(\.[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*\.*$"
DURATION = r"^P(?=.)(\d+Y)?(\d+M)?(\d+D)?(T(?=.)(\d+H)?(\d+M)?(\d+(\.\d+)?S)?)?$"
IPV4 = r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"
#: A scheme, then an authority or a path.
URI = r"^[A-Za-z][A-Za-z0-9+.-]*:(//([^/?#]+|/)|(?!//)[^?#]+)"
#: What has no scheme, authority, path, query or fragment, and so refers to nothing.
NO_REFERENCE = r"^[\x00-\x20]*(//)?\??#?[\t\r\n]*$"
UUID_HEX = r"^[0-9A-Fa-f]{32}$"
ZONED = r"([zZ]|[+-]\d{2}(:?\d{2})?)$"


@F.pandas_udf(T.BooleanType())
def _is_ipv6(s: pd.Series) -> pd.Series:
    def ok(x: str | None) -> bool | None:
        if x is None:
            return None
        try:
            return ipaddress.ip_address(x).version == 6
        except ValueError:
            return False

    return s.map(ok)


@F.pandas_udf(T.BooleanType())
def _is_regex(s: pd.Series) -> pd.Series:
    def ok(x: str | None) -> bool | None:
        if x is None:
            return None
        try:
            re.compile(x)
        except re.error:
            return False
        return True

    return s.map(ok)


def matches_format(c: Column, name: str) -> Column:
    """Whether text satisfies a format; unknown formats always hold."""
    f = name.strip().lower()
    t = F.trim(c)
    return {
        "date-time": lambda: t.rlike(TIMESTAMP_TEXT) & t.rlike(r"[T ]") & t.rlike(ZONED) & F.regexp_replace(F.regexp_replace(t, ",", "."), r"([+-]\d{2})(\d{2})$", "$1:$2").try_cast("timestamp").isNotNull(),
        "date": lambda: c.rlike(DATE_TEXT) & c.try_cast("date").isNotNull(),
        "time": lambda: c.rlike(TIME_TEXT),
        "uuid": lambda: F.regexp_replace(F.regexp_replace(c, "urn:|uuid:", ""), r"^[{}]+|[{}]+$|-", "").rlike(UUID_HEX),
        "email": lambda: c.rlike(EMAIL),
        "hostname": lambda: (F.char_length(c) <= 253) & c.rlike(HOSTNAME),
        "ipv4": lambda: c.rlike(IPV4),
        "ipv6": lambda: _is_ipv6(c),
        "uri": lambda: c.rlike(URI),
        "uri-reference": lambda: ~c.rlike(NO_REFERENCE),
        "regex": lambda: _is_regex(c),
        "duration": lambda: c.rlike(DURATION),
    }.get(f, lambda: F.lit(True))()


def matches_pattern(c: Column, pattern: str) -> Column:
    """Whether a pattern is found anywhere in the text; ValueError for a broken pattern.

    Named groups are written Java's way; a pattern that Java can't take is left to an
    Arrow-batched function.
    """
    try:
        compiled = re.compile(pattern)
    except re.error as e:
        raise ValueError(f"the schema holds a broken pattern {pattern!r}: {e}") from e
    java = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern.replace("(?P<", "(?<"))
    if re.search(r"\(\?\(|\\Z|\\N\{|\(\?[aLu]", java):
        search = F.pandas_udf(lambda s: s.map(lambda x: None if x is None else compiled.search(x) is not None), T.BooleanType())
        return search(c)
    return c.rlike("(?U)" + java)
