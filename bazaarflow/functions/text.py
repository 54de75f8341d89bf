"""Names, keys and slugs."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

# Fixed value: the characters that count as white space in Unicode text.
SPACES = (
    r"[\x09-\x0D\x1C-\x1F\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)
# Fixed value: the first of the 6,400 characters that Unicode leaves to private use, none of which has a decomposition.
_PRIVATE = 0xE000


@lru_cache(maxsize=1)
def decompositions() -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """Characters whose compatibility decomposition holds a Latin letter or digit, by Unicode's own tables.

    Three groups: those that become one letter, those that become a letter and separate (a mark follows), and the others.
    """
    plain, marked, longer = {}, {}, {}
    for code in (*range(0x80, 0xD800), *range(0xE000, 0x20000)):
        spread = re.sub("[^a-z0-9]+", "-", unicodedata.normalize("NFKD", chr(code)).lower())
        if spread != "-":
            group = plain if len(spread) == 1 else marked if len(spread) == 2 and spread[1] == "-" else longer
            group[chr(code)] = spread
    return plain, marked, longer


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))


def casefolded(text: Column) -> Column:
    """Lower case, with the sharp s and final sigma folded as well."""
    return F.translate(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), "ς", "σ")


def normalized_key(text: Column) -> Column:
    return casefolded(collapsed(text))


def display_name(text: Column) -> Column:
    """Collapse spaces, title-case names that are all capitals, keep APMC spelled in capitals."""
    name = collapsed(text)
    runs = F.regexp_extract_all(F.lower(name), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    titled = F.array_join(
        F.transform(runs, lambda run: F.concat(F.upper(F.substring(run, 1, 1)), run.substr(2, 1 << 30))),
        "",
    )
    shouted = (name == F.upper(name)) & (name != F.lower(name))
    styled = F.when(shouted, titled).otherwise(name)
    for spelling in ("Apmc", "Ap Mc"):
        styled = F.replace(styled, F.lit(spelling), F.lit("APMC"))
    return styled


def variety_name(text: Column) -> Column:
    """A missing or empty variety is named; white space alone collapses to an empty name."""
    return collapsed(F.coalesce(F.nullif(text, F.lit("")), F.lit("Unspecified")))


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(casefolded(text), "[^a-z0-9]+", "-"), F.lit("-"))


def ascii_slug(text: Column) -> Column:
    """Slug over compatibility decomposition: ligatures and wide letters are spelled out, an accent separates, as its mark is not a letter.

    Every character is looked up once, in `translate`. A regular expression over the thousands of characters would try
    them one after the other, so accented letters and those of several letters first become characters of one private
    range, which an expression finds by two comparisons. Private characters of the text itself only separate.
    """
    plain, marked, longer = decompositions()
    letters = sorted(set(marked.values()))
    accented = {x: chr(_PRIVATE + i) for i, x in enumerate(letters)}
    spelled = {chr(_PRIVATE + len(letters) + i): c for i, c in enumerate(longer)}
    first, second, last = (chr(_PRIVATE + n - 1) for n in (1, len(letters) + 1, len(letters) + len(longer)))
    own = {chr(code): "-" for code in range(_PRIVATE, _PRIVATE + len(letters) + len(longer))}
    one = {**own, **plain, **{c: accented[x] for c, x in marked.items()}, **{c: s for s, c in spelled.items()}}
    single = F.translate(text, "".join(one), "".join(one.values()))
    dashed = F.regexp_replace(single, f"([{first}-{accented[letters[-1]]}])", "$1-")
    dashed = F.translate(dashed, "".join(accented.values()), "".join(x[0] for x in letters))
    # only texts that hold a character of several letters are taken apart, into such characters and the runs between them
    long_one, names = f"[{second}-{last}]", F.create_map(*(F.lit(x) for s, c in spelled.items() for x in (s, longer[c])))
    runs = F.regexp_extract_all(dashed, F.lit(f"({long_one}|[^{second}-{last}]+)"), F.lit(1))
    by_run = F.array_join(F.transform(runs, lambda run: F.when(run.rlike(long_one), F.try_element_at(names, run)).otherwise(run)), "")
    whole = F.when(dashed.rlike(long_one), by_run).otherwise(dashed)
    return F.btrim(F.regexp_replace(F.lower(whole), "[^a-z0-9]+", "-"), F.lit("-"))


def derived_market_id(state_id: Column, market_name: Column) -> Column:
    """Stable id for a market that the reference dimension does not know."""
    digest = F.substring(F.sha1(normalized_key(market_name)), 1, 10)
    return F.concat_ws("-", F.lit("derived"), state_id.cast("string"), digest)


def series_key(state: Column, commodity: Column, market_id: Column) -> Column:
    return F.concat_ws("/", slug(state), slug(commodity), market_id)


def mentions(query: str, *columns: Column, within: Column | None = None) -> Column:
    """Case-insensitive containment in any of the columns or in an array of names."""
    needle = F.lit(query.strip().lower())
    found = F.lit(False)
    for column in columns:
        found = found | F.coalesce(F.contains(F.lower(column), needle), F.lit(False))
    if within is not None:
        found = found | F.coalesce(
            F.exists(within, lambda item: F.contains(F.lower(item), needle)), F.lit(False)
        )
    return found
