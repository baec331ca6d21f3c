"""Links, e-mail addresses, phone numbers, hashtags and placeholders in a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings rewritten first, in this order.
_REWRITES = [(".комп", ". комп"), (".руб", ". руб"), (".ру", ".ru"), (".ком", ".com"), (".орг", ".org")]
_MAIL_REWRITES = [("маил", "mail"), ("майл", "mail"), ("яндекс", "yandex")]

#: Endings that hosts may have; pass others for other corpora.
TLDS = ("ru", "ua", "by", "kz", "de", "fr", "es", "uk", "eu", "com", "org", "net", "info")

# Patterns without lookaround, so that other SQL engines take them too.
EMAIL = r"[a-z0-9._%+-]+@(?:[a-z0-9-]+\.)+[a-z]{2,}"
LINK = r'(?:https?://)?(?:[\pL\pN-]+\.)+\pL{2,}(?::[0-9]+)?(?:[/?#][^ \t\n\r<>"]*)?'
PHONE = r"(?:\+?[78][ (-]*)?[0-9]{3}[ )-]*[0-9]{3}[ -]?[0-9]{2}[ -]?[0-9]{2}"
ADDRESS = r"[^ \t\n\r,;]*@[^ \t\n\r,;]*"  # no links are looked for in these
HASHTAG = r"#[\pL\pM\p{Nd}_]*[\pL\pM][\pL\pM\p{Nd}_]*"
PLACEHOLDER = r"@@.+?@@"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _unless(ruled_out: Column, found: Column) -> Column:
    """found, which is not looked for where a cheap test of the text rules it out. The tests of
    several kinds of contacts share one prepared text; what filter() and transform() take, Spark
    computes anew for each."""
    return F.when(ruled_out, F.array().cast("array<string>")).otherwise(found)


def prepared(*texts: Column) -> Column:
    """The texts in a row, lower-cased, with rewritten host endings; null is empty."""
    out = F.lower(F.concat_ws(" ", *texts))
    for old, new in _REWRITES:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def _labels(host: Column) -> Column:
    return F.split(host, r"\.")


def links(text: Column, tlds: tuple[str, ...] = TLDS) -> Column:
    """Links without scheme, www. and closing slashes: over 5 characters, hosts of at
    most 3 labels with an allowed ending, whose label before it has no digit first."""
    without_mail = F.regexp_replace(F.regexp_replace(text, ADDRESS, " "), r"\./|/\.", "/")
    bare = F.transform(_all(without_mail, LINK), lambda x: F.regexp_replace(F.regexp_replace(x, r"^(https?://)?(www\.)?", ""), "/+$", ""))

    def good(x: Column) -> Column:
        labels = _labels(F.regexp_extract(x, "^[^/:?#]+", 0))
        second = F.try_element_at(labels, F.lit(-2))
        return (F.char_length(x) > 5) & (F.size(labels) <= 3) & F.element_at(labels, -1).isin(*tlds) & ~second.rlike("^[0-9]")

    # what comes before the pattern neither brings a dot to two letters nor takes text from between them
    return _unless(~text.rlike(r"\.\pL{2}"), F.filter(bare, lambda x: F.coalesce(good(x), F.lit(False))))


def emails(text: Column, tlds: tuple[str, ...] = TLDS) -> Column:
    out = text
    for old, new in _MAIL_REWRITES:
        out = F.replace(out, F.lit(old), F.lit(new))
    return _unless(~text.contains("@"), F.filter(_all(out, EMAIL), lambda x: F.element_at(_labels(x), -1).isin(*tlds)))


def phones(text: Column, prefix: str = "+7") -> Column:
    """Runs of 10 digits, or 11 after a 7 or 8, in the usual grouping, with one prefix."""
    found = F.transform(_all(text, PHONE), lambda x: F.concat(F.lit(prefix), F.right(F.regexp_replace(x, "[^0-9]", ""), F.lit(10))))
    return _unless(~text.rlike("[0-9]{2}[ -]?[0-9]{2}"), found)


def hashtags(text: Column) -> Column:
    return _all(text, HASHTAG)


def placeholders(text: Column) -> Column:
    return _all(text, PLACEHOLDER)


def contacts(*texts: Column, tlds: tuple[str, ...] = TLDS) -> dict[str, Column]:
    """All five, by name, of the texts in a row."""
    t = prepared(*texts)
    return {"links": links(t, tlds), "emails": emails(t, tlds), "phones": phones(t), "hashtags": hashtags(t), "placeholders": placeholders(t)}


def with_any(items, names: list[str]):
    """The rows of items that have any of the listed arrays not empty."""
    return items.where(F.greatest(*[F.size(n) for n in names]) > 0)
