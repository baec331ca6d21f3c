"""Text normalisation and tokenisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cyrillic letters and what they are written as; None is dropped.
LATIN_OF = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "g", "з": "z", "и": "i", "й": "i",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f",
    "х": "h", "ц": "c", "ч": "ch", "ш": "sh", "щ": "sh", "ъ": None, "ы": "i", "ь": None, "э": "e", "ю": "y", "я": "ya",
}


def bind(value: Column, body) -> Column:
    """body(value) with value computed once a row: the optimiser would copy a column's
    expression into each of its uses."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: [^a-zа-я0-9]+ as the ranges between those: Java asks nested closures about each character of
#: a negated class that has letters beyond ASCII, which takes some ten times as long.
NOT_LETTERS = r"[\x00-/:-`{-\u042f\u0450-\x{10ffff}]+"


def clean_text(c: Column) -> Column:
    """Lower case, ё as е, anything but Latin, Cyrillic and digits as one space."""
    low = F.replace(F.lower(F.coalesce(c, F.lit(""))), F.lit("ё"), F.lit("е"))
    return F.trim(F.regexp_replace(low, NOT_LETTERS, " "))


def tokens(c: Column) -> Column:
    """Words of a cleaned text; none for an empty one."""
    return F.filter(F.split(clean_text(c), " "), lambda t: t != "")


def count_chars(c: Column, letters: str) -> Column:
    return F.char_length(F.regexp_replace(c, f"[^{letters}]", "")).cast("long")


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b; 0 where only b is 0, null where both are."""
    return F.when(b == 0, F.when(a == 0, F.lit(None).cast("double")).otherwise(F.lit(0.0))).otherwise(a / F.nullif(b, F.lit(0)))


def char_ngrams(c: Column, low: int = 3, high: int = 5) -> Column:
    """All character n-grams of a text without spaces, repeats kept."""
    s = F.replace(c, F.lit(" "), F.lit(""))
    none = F.array().cast("array<string>")

    def of(chars: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(chars) - n + 1, F.lit(1)))
        return F.when(F.size(chars) >= n, F.transform(starts, lambda i: F.array_join(F.slice(chars, i, F.lit(n)), ""))).otherwise(none)

    # from the characters: taking a substring walks through the text up to it each time
    return bind(F.split(s, ""), lambda chars: F.concat(*[of(chars, n) for n in range(low, high + 1)]))


def token_ngrams(words: Column, low: int, high: int) -> Column:
    """Runs of low to high words written together, repeats kept; from 1 on, single words
    count twice."""
    none = F.array().cast("array<string>")

    def of(n: int) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0)))
        return F.when(F.size(words) >= n, F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, F.lit(n)), ""))).otherwise(none)

    return F.concat(*([words] if low == 1 else []), *[of(n) for n in range(low, high + 1)])


def transliterate(c: Column) -> Column:
    """Cyrillic letters as Latin ones, lower case."""
    single = {k: v for k, v in LATIN_OF.items() if v and len(v) == 1}
    out = F.translate(c, "".join(single), "".join(single.values()))
    for letter, written in LATIN_OF.items():
        if letter not in single:
            out = F.replace(out, F.lit(letter), F.lit(written or ""))
    return out


def repaired(words: Column) -> Column:
    """Words of both alphabets in the one that most of their letters have. As many of
    both: to the one whose look-alikes alone occur; else unchanged."""
    cyrillic, latin = "".join(LOOK_ALIKES), "".join(LOOK_ALIKES.values())

    def one(w: Column) -> Column:
        en, ru = (F.char_length(F.regexp_replace(w, f"[^{x}]", "")) for x in ("a-z", "а-я"))
        to_en, to_ru = F.translate(w, cyrillic, latin), F.translate(w, latin, cyrillic)
        has_en, has_ru = w.rlike(f"[{latin}]"), w.rlike(f"[{cyrillic}]")
        tie = F.when(has_en & ~has_ru, to_ru).when(has_ru & ~has_en, to_en).otherwise(w)
        return F.when((en == 0) | (ru == 0), w).when(en > ru, to_en).when(ru > en, to_ru).otherwise(tie)

    return F.transform(words, one)


# Cyrillic letters that look like Latin ones.
LOOK_ALIKES = {"а": "a", "у": "y", "к": "k", "е": "e", "н": "h", "г": "r", "х": "x", "в": "b", "р": "p", "о": "o", "с": "c", "м": "m", "т": "t"}
