"""Text helpers as column expressions: whitespace, paragraphs, snippets, ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from policyspark.vocabulary import MAX_SNIPPET_CHARS

# One whitespace character as Python's str methods understand it: the Unicode
# White_Space property plus the four ASCII separators it leaves out.
SPACE = r"[\s\x1c-\x1f]"
_SPACE_CHARS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(_SPACE_CHARS))


def collapse_spaces(c: Column | str) -> Column:
    """Every run of whitespace becomes one space; the ends are trimmed."""
    return F.trim(F.regexp_replace(col(c), f"(?U){SPACE}+", " "))


def filled(c: Column | str) -> Column:
    """Null for an empty string, else the value."""
    return F.nullif(col(c), F.lit(""))


def filled_after_strip(c: Column | str) -> Column:
    return F.nullif(strip(c), F.lit(""))


def first_filled(*columns: Column | str, default: str | None = None) -> Column:
    """First value that is neither null nor the empty string."""
    picks = [filled(c) for c in columns]
    if default is not None:
        picks.append(F.lit(default))
    return F.coalesce(*picks)


def first_not_blank(*columns: Column | str) -> Column:
    """First value that is not null and not blank, stripped."""
    return F.coalesce(*[filled_after_strip(c) for c in columns])


def prefix(c: Column | str, chars: int) -> Column:
    return F.substring(col(c), 1, chars)


def ellipsis(c: Column | str, chars: int) -> Column:
    c = col(c)
    return F.when(F.length(c) > chars, F.concat(prefix(c, chars), F.lit("..."))).otherwise(c)


def cap(c: Column | str, chars: int | None) -> Column:
    """Strip, then keep at most ``chars`` characters (no limit for None)."""
    stripped = strip(c)
    return stripped if chars is None else prefix(stripped, chars)


def one_line(c: Column | str, mark: str = " ") -> Column:
    """Carriage returns and newlines become ``mark`` ('\\\\n' and '\\\\r' for mark='escape')."""
    c = col(c)
    if mark == "escape":
        return F.replace(F.replace(c, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    return F.translate(c, "\r\n", mark * 2)


def paragraphs(c: Column | str) -> Column:
    """Blank-line separated paragraphs, whitespace collapsed, empty ones dropped."""
    parts = F.split(col(c), f"(?U)\n{SPACE}*\n")
    return F.filter(F.transform(parts, collapse_spaces), lambda p: p != "")


def sentence_packs(paragraph: Column | str, max_chars: int = MAX_SNIPPET_CHARS) -> Column:
    """Greedy packing of sentences into pieces of at most ``max_chars``.

    One regular expression does the packing: the longest prefix of up to
    ``max_chars`` characters that ends behind a sentence mark or at the end of
    the text, else the single sentence that is too long. It runs in linear
    time, inside the JVM, however long the text is.
    """
    edge = r"(?:(?<=[.!?])(?= )|$)"
    pattern = rf"(?s)(.{{1,{max_chars}}}{edge}|.+?{edge}) ?"
    return F.regexp_extract_all(col(paragraph), F.lit(pattern), F.lit(1))


def snippets(c: Column | str, max_chars: int = MAX_SNIPPET_CHARS) -> Column:
    """All snippets of a text in reading order (array<string>, empty for null)."""
    packed = F.flatten(F.transform(paragraphs(c), lambda p: sentence_packs(p, max_chars)))
    return F.coalesce(packed, F.array().cast("array<string>"))


def to_number(c: Column | str) -> Column:
    """Double of a number, numeric string or boolean; null for anything else."""
    return F.expr("try_cast({} as double)".format(c)) if isinstance(c, str) else c.try_cast("double")


def clamp_unit(c: Column | str) -> Column:
    number = F.coalesce(to_number(col(c)), F.lit(0.0))
    return F.when(F.isnan(number), number).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))


def category(c: Column | str) -> Column:
    return F.coalesce(filled_after_strip(col(c).cast("string")), F.lit("null"))


def compose_id(*parts: Column | str) -> Column:
    return F.concat_ws("::", *[p if isinstance(p, Column) else F.col(p) for p in parts])


def candidate_id(municipality: Column, document: Column, index: Column) -> Column:
    return compose_id(
        first_filled(municipality.cast("string"), default="unknown"),
        document.cast("string"),
        F.concat(F.lit("p"), index.cast("string")),
    )


def digest(c: Column | str) -> Column:
    return F.sha2(col(c), 256)


def iso_utc(ts: Column | str, instant: bool = False) -> Column:
    """ISO-8601 text with microseconds and a trailing Z.

    A timestamp without time zone is taken as UTC; an ``instant`` is converted
    from the session's zone.
    """
    utc = F.convert_timezone(None, F.lit("UTC"), col(ts)) if instant else col(ts)
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def pick_column(columns: list[str], aliases: list[str]) -> str | None:
    """First alias that exists among the columns."""
    return next((a for a in aliases if a in columns), None)
