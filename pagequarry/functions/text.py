"""Text functions on columns: whitespace, visibility, labels, page chrome, phrases.

All of them are expressions of built-in functions, so they stay in generated
code and below joins.  Whitespace is an explicit class, because the engines'
own classes differ in the Unicode spaces.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace, and characters that take no width.
SPACE = r"[ \t-\r\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
ZERO_WIDTH = r"[\x{AD}\x{34F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{206A}-\x{206F}\x{FE00}-\x{FE0F}\x{FEFF}]"


# Fixed value: an edge of a word of ASCII letters, digits and underscores.
EDGE = "(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"


def edges(pattern: str) -> str:
    r"""The pattern with \b as SQL has it; Java 17's \b takes all letters and their marks for parts of words."""
    return pattern.replace(r"\b", EDGE)


def collapse(x: Column) -> Column:
    """Runs of whitespace as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, SPACE + "+", " "))


def visible(x: Column) -> Column:
    """The text without characters that take no width."""
    return collapse(F.regexp_replace(x, ZERO_WIDTH, ""))


def once(x: Column, fn: Callable[[Column], Column]) -> Column:
    """fn of a value that is worked out once, however often fn names it."""
    return F.get(F.transform(F.array(x), fn), 0)


def has_visible(x: Column) -> Column:
    return F.coalesce(F.length(visible(x)) > 0, F.lit(False))


def has_letter_or_digit(x: Column) -> Column:
    return F.coalesce(x.rlike(r"[\p{L}\p{N}]"), F.lit(False))


def null_if_blank(x: Column) -> Column:
    """The trimmed text, or null where nothing visible is left."""
    return F.when(has_visible(x), collapse(x))


def match_form(x: Column) -> Column:
    """Link texts and URL paths in one form: lower-case words of a-z and 0-9 with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(x), "[-_/]+", " "), "[^a-z0-9 ]+", " "), " +", " "))


def label_form(x: Column) -> Column:
    """A control's label: lower case, no brackets, punctuation or final counter."""
    x = F.regexp_replace(F.lower(visible(x)), r"[（(\[][^）)\]]*[）)\]]", " ")
    x = F.regexp_replace(x, r"[^\p{L}\p{N}" + SPACE[1:-1] + "]+", " ")
    return collapse(F.regexp_replace(x, SPACE + "+[0-9]+$", ""))


def alternation(phrases: list[str]) -> str:
    """A pattern that finds any of the phrases as they stand."""
    return "|".join(re.sub(r"([^\w\s])", r"\\\1", p) for p in phrases) or r"(?!)"


def any_phrase(x: Column, phrases: list[str]) -> Column:
    """Whether the text has one of the phrases, in any case and anywhere, even inside a word."""
    return F.coalesce(F.lower(x).rlike(alternation([p.lower() for p in phrases])), F.lit(False))


def phrases_in(x: Column, phrases: list[str]) -> Column:
    """The phrases that the text has, in the dictionary's order."""
    return F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(F.lower(x), F.lower(p)))


def roll_up(x: Column, phrases: list[str], limit: int = 3) -> Column:
    """The first phrases found, joined; null if none is."""
    return F.nullif(F.array_join(F.slice(phrases_in(x, phrases), 1, limit), ", "), F.lit(""))


def first_label(x: Column, labelled: dict[str, list[str]]) -> Column:
    """The first label of which the text has a phrase."""
    return F.coalesce(*[F.when(any_phrase(x, p), F.lit(k)) for k, p in labelled.items()])


def noise_reason(x: Column, exact: list[str], contains: list[str]) -> Column:
    """Why a label is page chrome: empty, no-letters, exact-match or banner-phrase; null if it isn't."""
    of_form = lambda form: F.when(F.length(form) == 0, "empty").when(form.isin(exact), "exact-match").when(form.rlike(alternation(contains)), "banner-phrase")
    return F.when(~has_visible(x), "empty").when(~has_letter_or_digit(x), "no-letters").otherwise(once(label_form(x), of_form))


def substantive(x: Column) -> Column:
    """At least 12 visible characters and two words."""
    v = visible(x)
    return (F.length(v) >= 12) & (F.size(F.split(v, " ")) >= 2)


def truncated(x: Column) -> Column:
    """Ends in an ellipsis, or is 150 characters or more and stops after a letter or digit."""
    v = F.rtrim(x)
    return v.rlike(r"(\.\.\.|…)\z") | ((F.length(v) >= 150) & v.rlike(r"[\p{L}\p{N}]\z"))


def title_words(x: Column) -> Column:
    """First letters of words in upper case, after hyphens too."""
    return F.array_join(F.transform(F.split(x, "(?<=[^A-Za-z0-9_])"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), "")


def sentences(x: Column) -> Column:
    """The text cut after full stops, exclamation and question marks."""
    return F.split(x, r"(?<=[.!?])" + SPACE + "+")


def language_tag(x: Column) -> Column:
    """en_us as en-US: hyphens between the parts, a two-letter part after the first in upper case."""
    parts = F.split(F.regexp_replace(F.trim(x), "_", "-"), "-")
    tail = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.when(F.length(p) == 2, F.upper(p)).otherwise(p))
    return F.array_join(F.concat(F.array(F.lower(parts[0])), tail), "-")


def price_in(x: Column, models: list[str]) -> Column:
    """The price as the text states it: an amount with its currency, or else the first pricing model with up to 30 characters after it."""
    amount = r"((?:from|starting at|starting from|only|just)?\s*[$€£]\s?[0-9][0-9,]*(?:\.[0-9]{2})?(?:\s?(?:/|per)\s?[a-z]+)?\+?)"
    money = F.trim(F.regexp_extract(x, "(?i)" + amount, 1))
    found = F.array_compact(F.array(*[F.when(F.contains(F.lower(x), F.lit(m)), F.trim(F.regexp_extract(x, "(?i)" + alternation([m]) + r"([^.;|•]{0,30})", 0))) for m in models]))
    return F.when(money != "", money).otherwise(F.get(found, 0))
