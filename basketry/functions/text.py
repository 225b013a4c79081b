"""Line formatting and parsing expressions.

Basket text is ``key : i1 i2 ...`` (or ``key:i1 i2`` without the spaces).
Parsing keeps the reference's rules: the text between the first and second
colon holds the items, surrounding whitespace is stripped, items are split on
one space and must be integers, an empty item list is an empty basket.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FAILFAST = "failfast"
PERMISSIVE = "permissive"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(col) -> Column:
    """Python-style ``str.strip()``: remove leading and trailing whitespace."""
    return F.regexp_replace(_c(col), r"^\s+|\s+$", "")


def basket_line(key, items, sep: str = " : ") -> Column:
    """``key<sep>i1 i2 ...``; ``sep=':'`` gives the tight CSV form."""
    return F.concat(_c(key).cast("string"), F.lit(sep),
                    F.array_join(F.transform(_c(items), lambda x: x.cast("string")), " "))


def pair_text(a, b) -> Column:
    """K1 line: ``(a, b)`` as Python prints a tuple of two ints."""
    return F.format_string("(%d, %d)", _c(a).cast("bigint"), _c(b).cast("bigint"))


def parse_basket(value, mode: str = FAILFAST, item_type: str = "bigint") -> Column:
    """parse one basket line into ``struct<key string, items array<item_type>>``.

    ``failfast`` raises on a line without a colon or with a token that is not
    an integer (an empty token from a double space included). ``permissive``
    returns null for a line without a colon and drops bad tokens.
    """
    if mode not in (FAILFAST, PERMISSIVE):
        raise ValueError(f"mode must be {FAILFAST!r} or {PERMISSIVE!r}, got {mode!r}")
    value = _c(value)
    parts = F.split(value, ":")
    body = strip(F.get(parts, 1))
    tokens = F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, " "))
    cast = F.transform(tokens, lambda t: t.try_cast(item_type))
    key = strip(F.get(parts, 0))
    if mode == PERMISSIVE:
        items = F.filter(cast, lambda x: x.isNotNull())
        return F.when(body.isNotNull(), F.struct(key.alias("key"), items.alias("items")))
    bad = F.exists(cast, lambda x: x.isNull())
    items = (F.when(body.isNull(),
                    F.raise_error(F.concat(F.lit("basket line without ':': "), value)))
             .when(bad, F.raise_error(F.concat(F.lit("basket line with a non-integer item: "),
                                               value)))
             .otherwise(cast))
    return F.struct(key.alias("key"), items.cast(f"array<{item_type}>").alias("items"))


def split_tokens(value, sep: str = " ", distinct: bool = True) -> Column:
    """F4 for transactions: strip, split on ``sep``; duplicates removed by default."""
    tokens = F.split(strip(_c(value)), _regex_literal(sep))
    return F.array_distinct(tokens) if distinct else tokens


def _regex_literal(sep: str) -> str:
    special = set(r"\.^$|?*+()[]{}")
    return "".join("\\" + ch if ch in special else ch for ch in sep)
