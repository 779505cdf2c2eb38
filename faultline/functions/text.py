"""Text cleaning as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Every character Python counts as white space.
WHITE_SPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())


def norm_text(c: Column) -> Column:
    """Upper case without surrounding spaces."""
    return F.upper(F.trim(c))


def norm_make(c: Column) -> Column:
    """``norm_text`` with hyphens read as spaces."""
    return F.replace(norm_text(c), F.lit("-"), F.lit(" "))


def path_head(c: Column) -> Column:
    """First part of an ``A:B:C`` path, as stored."""
    return F.split_part(c, F.lit(":"), F.lit(1))


def strip(c: Column) -> Column:
    """Drop white space of any kind at both ends (``trim`` alone drops spaces only)."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def lower_strip(c: Column) -> Column:
    return strip(F.lower(c))


def truncate(c: Column, length: int) -> Column:
    return F.substring(c, 1, length)


def title(c: Column) -> Column:
    """Capitalise every letter that does not follow a letter, lower the others.

    ``initcap`` only looks at white space, so the text is first cut wherever a letter
    follows a non-letter.
    """
    words = F.split(F.lower(c), r"(?<=\P{L})(?=\p{L})")
    return F.array_join(F.transform(words, F.initcap), "")


def vehicle_label(make: Column, model: Column, detail: Column) -> Column:
    """``MAKE MODEL (detail)``; NULL when any part is NULL."""
    return F.concat(make, F.lit(" "), model, F.lit(" ("), detail.cast("string"), F.lit(")"))


def shown(c: Column, missing: str = "<NA>") -> Column:
    """Text of a value with a visible marker for a missing one."""
    return F.coalesce(c.cast("string"), F.lit(missing))


def thousands(c: Column) -> Column:
    """``1234567`` as ``1,234,567``."""
    return F.format_number(F.bround(c.cast("double"), 0), 0)


def short_number(c: Column) -> Column:
    """Millions as ``18M``, anything smaller in thousands as ``150K``."""
    millions = F.format_string("%.0fM", F.bround(c / F.lit(1e6), 0))
    return F.when(c.isNull(), F.lit(None)).when(c >= 1e6, millions).otherwise(
        F.format_string("%.0fK", F.bround(c / F.lit(1e3), 0))
    )


def percent_text(c: Column, digits: int) -> Column:
    """A value that already is a percentage, ``digits`` decimals and a percent sign."""
    return F.when(c.isNotNull(), F.format_string(f"%.{digits}f%%", F.bround(c.cast("double"), digits)))


def share_text(c: Column, digits: int = 1) -> Column:
    """A share between 0 and 1 as a percentage."""
    return percent_text(c * 100, digits)
