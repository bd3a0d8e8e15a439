"""Text clean-up, tokens, previews and snippets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# The characters that count as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
TOKEN = r"([\p{L}\p{N}]+)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def or_null(value: Column) -> Column:
    """Empty text as NULL, so that ``coalesce`` and ``concat_ws`` skip it."""
    return F.nullif(value, F.lit(""))


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITESPACE))


def is_blank(value: Column) -> Column:
    return F.coalesce(F.length(strip(value)) == 0, F.lit(True))


def squash(value: Column) -> Column:
    """Lower case, whitespace runs to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(value), SPACE_RUN, " "))


def tokenize(value: Column, stop: list[str] | None = None) -> Column:
    """Lower-cased runs of letters and digits, without the words in ``stop``."""
    tokens = F.regexp_extract_all(F.lower(value), F.lit(TOKEN), 1)
    if stop:
        tokens = F.filter(tokens, lambda token: ~token.isin(list(stop)))
    return tokens


def one_line(value: Column) -> Column:
    return F.replace(value, F.lit("\n"), F.lit(" "))


def preview(text: Column, size: int = 200) -> Column:
    """The first ``size`` characters on one line, with an ellipsis if cut."""
    cut = F.when(F.length(text) > size, "…").otherwise("")
    return F.concat(one_line(F.substring(text, 1, size)), cut)


def snippet(text: Column, variants: Column, width: int = 220) -> Column:
    """Text around the earliest occurrence of a variant.

    Of variants at the same place the first in array order sets the right edge.
    Without an occurrence the head of the text is shown.
    """

    def around(hit: Column) -> Column:
        start = F.greatest(F.lit(0), hit["at"] - 1 - width)
        end = F.least(F.length(text), hit["at"] - 1 + F.length(hit["variant"]) + width)
        body = one_line(strip(F.substring(text, start + 1, end - start)))
        return F.concat(
            F.when(start > 0, "…").otherwise(""),
            body,
            F.when(end < F.length(text), "…").otherwise(""),
        )

    head = F.concat(
        F.substring(one_line(strip(text)), 1, 2 * width),
        F.when(F.length(text) > 2 * width, "…").otherwise(""),
    )
    found = let(
        F.lower(text),
        lambda low: F.array_min(
            F.filter(
                F.transform(
                    variants,
                    lambda v, i: F.struct(
                        F.instr(low, v).alias("at"), i.alias("i"), v.alias("variant")
                    ),
                ),
                lambda hit: hit["at"] > 0,
            )
        ),
    )
    return let(found, lambda hit: F.when(hit.isNull(), head).otherwise(around(hit)))
