"""Text normalisation as Column functions; all of them stay in the JVM.

What a record needs of a text starts from its folded form. Functions that end in `_of` take that form, or its tokens, so
that a record's texts are folded and cut once (`records.normalise`); the others take the text itself.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.words import ADDRESS_STOP, GENERIC, LEGAL, SCRIPTS, STATES, STREET, TLD


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


@lru_cache(maxsize=1)
def unicode_tables() -> tuple[str, str, dict[str, str]]:
    """From the Unicode tables: characters whose compatibility form is one ASCII letter or digit plus marks, followed by
    the marks themselves; those letters and digits (marks have no counterpart, so they are deleted); and, for characters
    whose form has several, that form, with a space for all that is neither a-z nor 0-9."""
    plain: dict[str, str] = {}
    several: dict[str, str] = {}
    marks = []
    for cp in (*range(0x80, 0xD800), *range(0xE000, 0x110000)):
        c = chr(cp)
        if unicodedata.combining(c):
            marks.append(c)
        elif unicodedata.decomposition(c):
            form = "".join(x if x.isascii() and (x.isdigit() or x.islower()) else " " for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
            if len(form) == 1 and form != " ":
                plain[c] = form
            elif len(form) > 1 and form.strip():
                several[c] = form
    return "".join(plain) + "".join(marks), "".join(plain.values()), several


@lru_cache(maxsize=4)
def code_points(chars: str) -> str:
    """A character class of a regular expression."""
    points, spans = sorted(map(ord, chars)), []
    for p in points:
        if spans and spans[-1][1] == p - 1:
            spans[-1][1] = p
        else:
            spans.append([p, p])
    return "[" + "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in spans) + "]"


def fold(c: Column) -> Column:
    """Lower case, compatibility decomposition (NFKD), marks off, every run of anything but a-z and 0-9 one space,
    trimmed; null becomes ''. Only texts beyond ASCII, and only those with characters of several letters (ligatures,
    fractions, units), take the longer ways."""
    old, new, several = unicode_tables()
    table = F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in several.items())), F.lit("\x01"), F.lit("\x02"))
    spelled = lambda x: F.array_join(F.transform(F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0)), lambda ch: F.coalesce(F.try_element_at(table, ch), ch)), "")
    deep = lambda x: F.translate(F.when(x.rlike(code_points("".join(several))), spelled(x)).otherwise(x), old, new)
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.trim(F.regexp_replace(F.when(low.rlike(r"[^\x00-\x7F]"), deep(low)).otherwise(low), "[^0-9a-z]+", " "))


def tokens(folded: Column) -> Column:
    return F.filter(F.split(folded, " "), lambda t: t != "")


def squash(c: Column) -> Column:
    return F.replace(fold(c), F.lit(" "), F.lit(""))


def script_of(c: Column) -> Column:
    """Name of the first character's script that is one of SCRIPTS, else Latin."""
    span = "".join(f"\\x{{{lo:04X}}}-\\x{{{hi:04X}}}" for _, lo, hi in SCRIPTS)
    at = F.ascii(F.regexp_extract(F.coalesce(c, F.lit("")), f"[{span}]", 0))
    out = F.lit("Latin")
    for name, lo, hi in SCRIPTS:
        out = F.when(at.between(lo, hi), name).otherwise(out)
    return out


def is_latin(c: Column) -> Column:
    return script_of(c) == "Latin"


def _without(toks: Column, stop: list[str]) -> Column:
    return let(F.filter(toks, lambda t: ~t.isin(stop)), lambda rest: F.when(F.size(rest) > 0, rest).otherwise(toks))


def name_tokens(c: Column) -> Column:
    return tokens(fold(c))


def core_of(toks: Column) -> Column:
    """Name tokens without legal forms; all tokens if nothing would be left."""
    return _without(toks, LEGAL)


def distinctive_of(core: Column) -> Column:
    """Core tokens without business categories; the core if nothing would be left."""
    return _without(core, GENERIC)


def name_core(c: Column) -> Column:
    return let(name_tokens(c), core_of)


def name_distinctive(c: Column) -> Column:
    return let(name_core(c), distinctive_of)


def name_squash_of(folded: Column) -> Column:
    """Folded name without spaces and without one trailing web ending, if four characters or more remain."""

    def cut(x: Column) -> Column:
        return let(F.regexp_replace(x, f"({'|'.join(TLD)})$", ""), lambda short: F.when(F.length(short) >= 4, short).otherwise(x))

    return let(F.replace(folded, F.lit(" "), F.lit("")), cut)


def name_squash(c: Column) -> Column:
    return name_squash_of(fold(c))


def _lookup(table: dict[str, str], key: Column) -> Column:
    """The entry of a token; the map is searched for tokens that are in it only."""
    m = F.str_to_map(F.lit(",".join(f"{k}:{v}" for k, v in table.items())), F.lit(","), F.lit(":"))
    return F.when(key.isin(list(table)), F.try_element_at(m, key)).otherwise(key)


def address_tokens_of(folded: Column, country: Column) -> Column:
    """Tokens with street words, then states of the country, spelled out, and without stop words; in order, repeats kept."""

    def spelled(t: Column) -> Column:
        out = t
        for name, table in STATES.items():
            out = F.when(country == name, _lookup(table, t)).otherwise(out)
        return out

    street = F.transform(tokens(folded), lambda t: _lookup(STREET, t))
    stated = let(street, lambda s: F.when(country.isin(list(STATES)), F.transform(s, spelled)).otherwise(s))
    return F.filter(stated, lambda t: ~t.isin(ADDRESS_STOP))


def address_tokens(c: Column, country: Column) -> Column:
    return address_tokens_of(fold(c), country)


def numeric_tokens_of(folded: Column) -> Column:
    """Distinct tokens of up to eight characters that hold a digit."""
    return F.sort_array(F.array_distinct(F.filter(tokens(folded), lambda t: t.rlike("[0-9]") & (F.length(t) <= 8))))


def numeric_tokens(c: Column) -> Column:
    return numeric_tokens_of(fold(c))


def _grams(c: Column, n: int) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def ngrams(c: Column, n: int = 3) -> Column:
    """Distinct character n-grams in order; a shorter text is its own only one, an empty one has none."""
    size = F.length(c)
    return F.when(size >= n, _grams(c, n)).when(size > 0, F.array(c)).otherwise(F.array().cast("array<string>"))


def sorted_text(toks: Column) -> Column:
    """Sorted distinct tokens joined by spaces, so that the order of components is of no account."""
    return F.array_join(F.sort_array(F.array_distinct(toks)), " ")


def address_grams(toks: Column) -> Column:
    return ngrams(sorted_text(toks))


#: What folded texts are made of; a place in it is a digit of a trigram's number.
ALPHABET = " 0123456789abcdefghijklmnopqrstuvwxyz"


def gram_codes(c: Column) -> Column:
    """The trigrams of a folded text as distinct numbers of 16 bits: equal numbers are equal trigrams."""
    place = lambda g, k: F.instr(F.lit(ALPHABET), F.substring(g, k, 1))  # noqa: E731  # 0 for the filler of short texts
    code = lambda g: ((place(g, 1) * 38 + place(g, 2)) * 38 + place(g, 3) - 32768).cast("smallint")
    return F.when(F.length(c) > 0, F.transform(_grams(F.rpad(c, F.greatest(F.length(c), F.lit(3)), F.lit("_")), 3), code)).otherwise(F.array().cast("array<smallint>"))
