"""Coercions of raw cells as column expressions: everything stays in the JVM and never raises."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom import vocabulary as V


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: Every character with Unicode's property White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_BARE, _SPACE = r"(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", f"[{WHITE}]*"
#: A signed number, or one without a sign in brackets.
NUMBER = rf"^{_SPACE}([+-]?{_BARE}|\({_BARE}\)){_SPACE}\z"


ENDS = r"^\s+|\s+\z"


def strip(c: Column | str) -> Column:
    """Without white space (of any script) at either end."""
    return F.regexp_replace(col(c), f"(?U){ENDS}", "")


def without(c: Column | str, words: list[str]) -> Column:
    """Stripped text; null and the given words (in any case) become ''."""
    own = "|".join(re.escape(w) for w in words if w)
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), rf"(?iU)^\s*(?:{own})\s*\z|{ENDS}", "")


def text(c: Column | str) -> Column:
    """Cell text: null and null words become ''."""
    return without(c, V.NULL_TEXTS)


def number(c: Column | str) -> Column:
    """Broker-formatted number: currency, thousands and percent signs go, (x) is -x, anything else is 0."""
    own = F.coalesce(col(c), F.lit(""))
    # the pattern guards the cast, which would take more than plain numbers (1d, NaN, ...)
    return F.when(F.translate(own, "$,%", "").rlike(NUMBER), F.translate(own, "($,%)" + WHITE, "-").try_cast("double")).otherwise(0.0)


def symbol(c: Column | str) -> Column:
    return F.upper(text(c))


def side(c: Column | str) -> Column:
    s = F.lower(text(c))
    return F.when(s.isin(V.SIDES), s).otherwise("long")


def date_text(c: Column | str) -> Column:
    """Dates stay text; '' is null."""
    return F.nullif(text(c), F.lit(""))


def lower_text(c: Column | str) -> Column:
    return F.lower(text(c))


def move(c: Column | str) -> Column:
    """Canonical transaction move, or the text itself in lower case."""
    s = F.lower(text(c))
    names = F.create_map(*(F.lit(x) for move, words in V.MOVES.items() for w in words for x in (w.lower(), move)))
    return F.coalesce(F.try_element_at(names, s), s)


def clean_cell(c: Column | str) -> Column:
    return without(c, V.NULL_CELLS)


def blank(c: Column | str) -> Column:
    return text(c) == ""


def round_half_even(c: Column, digits: int = 2) -> Column:
    """Elapsed milliseconds and the like."""
    return F.bround(c, digits)


# ------------------------------------------------------------------ files
def suffix(path: Column | str) -> Column:
    """The last extension of a path's last part, in lower case, '' without one."""
    name = F.regexp_extract(col(path), r"([^/\\]*)$", 1)
    return F.lower(F.regexp_extract(name, r"[^.](\.[^.]+)$", 1))


def category(suffix_: Column | str) -> Column:
    names = F.create_map(*(F.lit(x) for kind, own in V.CATEGORIES.items() for s in own for x in (s, kind)))
    return F.coalesce(F.try_element_at(names, F.lower(col(suffix_))), F.lit("unknown"))


def upload_type(filename: Column | str, mime: Column | str) -> Column:
    """struct(status, suffix): the file name decides, then the content type; 415 for other names, 400 for neither."""
    own = F.coalesce(suffix(filename), F.lit(""))
    supported = [s for kind, names in V.CATEGORIES.items() if kind != "unsupported" for s in names]
    kind = F.lower(strip(F.element_at(F.split(F.coalesce(col(mime), F.lit("")), ";"), 1)))
    mapped = F.try_element_at(F.create_map(*(F.lit(x) for pair in V.MIME_SUFFIX.items() for x in pair)), kind)
    return (
        F.when(own.isin(supported), F.struct(F.lit(200).alias("status"), own.alias("suffix")))
        .when(own != "", F.struct(F.lit(415).alias("status"), own.alias("suffix")))
        .when(mapped.isNotNull(), F.struct(F.lit(200).alias("status"), mapped.alias("suffix")))
        .otherwise(F.struct(F.lit(400).alias("status"), F.lit("").alias("suffix")))
    )


def upload_guard(content_length: Column | str, max_mb: int = V.MAX_FILE_MB) -> Column:
    """HTTP status for an upload of this many bytes."""
    n = col(content_length)
    return F.when(F.coalesce(n, F.lit(0)) == 0, 400).when(n > max_mb * 1024 * 1024, 413).otherwise(200)
