"""Column functions over post text. All run inside the JVM except Unicode normalisation."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Mapping
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from postsift import fixed_values as fv

# (?U) makes \w \d \s \b Unicode-aware, (?d) makes "." stop at \n only.
UNICODE = "(?Ud)"
UNICODE_ANY_CASE = "(?iUd)"
#: A letter, number or underscore. Java's Unicode \w takes combining marks too, which end a word here.
WORD_CHARACTER = r"[\p{L}\p{N}_]"
WORD_BORDER = rf"(?:(?<!{WORD_CHARACTER})(?={WORD_CHARACTER})|(?<={WORD_CHARACTER})(?!{WORD_CHARACTER}))"
#: What Java's Unicode \s matches.
WHITE_SPACE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: A word border and what must follow it: a letter, or one of several plain words.
_STARTS = re.compile(r"\\b(?:([A-Za-z])(?![?*{])|\(([A-Za-z][A-Za-z ]*(?:\|[A-Za-z][A-Za-z ]*)*)\)(?![?*{]))")
#: Characters beyond upper and lower case that Java takes as a letter in any case.
_MORE_CASES = {"i": "\u0130\u0131", "k": "\u212a", "s": "\u017f"}


def _first_letters(pattern: str) -> set[str]:
    """What a match begins with, if the pattern begins with a word border and plain words; else nothing."""
    found = _STARTS.match(pattern)
    words = (found[1] or found[2]).split("|") if found else []
    return {w[0].lower() for w in words}


def _ahead(letters: Iterable[str]) -> str:
    """Look-ahead for one of the ASCII characters in any case. It spares most positions the costlier border."""
    each = {x for c in letters for x in (c.lower(), c.upper(), *_MORE_CASES.get(c.lower(), ""))}
    return f"(?=(?-i:[{''.join(map(re.escape, sorted(each)))}]))"


def starting(pattern: str) -> str:
    """The same pattern behind a look-ahead for its first letters, where they are known."""
    letters = _first_letters(pattern)
    return _ahead(letters) + pattern if letters else pattern


def _joinable(pattern: str) -> bool:
    """Whether the pattern can stand behind a word border shared with others: no bar outside of groups."""
    bare = pattern
    while (less := re.sub(r"\([^()]*\)", "", bare)) != bare:
        bare = less
    return bool(_first_letters(pattern)) and not re.search(r"[|()\[]|\\[1-9kQ]", bare) and not re.search(r"\\[()1-9kQ]|\[", pattern)


def any_of(patterns: Iterable[str]) -> list[str]:
    """Patterns that match where one of the given ones does: those that begin with a word border and
    known letters are tried in one pass."""
    patterns = list(patterns)
    joined = [p for p in patterns if _joinable(p)]
    letters = set().union(*map(_first_letters, joined))
    one = [rf"{_ahead(letters)}\b(?:{'|'.join(p[2:] for p in joined)})"] if joined else []
    return one + [starting(p) for p in patterns if p not in joined]


def remap_label(col: Column, mapping: Mapping[str, str], other_to: str | None = None) -> Column:
    """Replace exact values; a value without an entry stays unless `other_to` is given."""
    pairs = [F.lit(x) for pair in mapping.items() for x in pair]
    fallback = col if other_to is None else F.when(col.isNotNull(), F.lit(other_to))
    return F.coalesce(F.create_map(*pairs)[col], fallback)


def blank_if_null(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def strip_text(col: Column) -> Column:
    """Trim every kind of white space; Spark's trim() removes blanks only."""
    return F.btrim(col, F.lit(WHITE_SPACE))


@lru_cache(maxsize=1)
def _unstable_characters() -> str:
    """Character class of everything NFC may change, derived from the Unicode tables."""
    points = [
        cp
        for cp in (*range(0x80, 0xD800), *range(0xE000, 0x110000))
        if unicodedata.normalize("NFC", chr(cp)) != chr(cp)
    ]
    runs: list[list[int]] = []
    for cp in points:
        if runs and cp == runs[-1][1] + 1:
            runs[-1][1] = cp
        else:
            runs.append([cp, cp])
    ranges = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in runs)
    # Marks and trailing Hangul jamo may combine with the character before them.
    return rf"[\p{{M}}\x{{1160}}-\x{{11FF}}{ranges}]"


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def normalize_nfc(col: Column) -> Column:
    """Unicode NFC. Only texts holding a character that NFC can change reach Python.

    Below U+0300 nothing changes, nor do typographic quotes and dashes: one quick test passes
    nearly every Latin text, the long character class sees the rest.
    """
    maybe = col.rlike(r"[^\x{0}-\x{2FF}\x{2010}-\x{2027}]")
    return F.coalesce(_nfc(F.when(maybe & col.rlike(_unstable_characters()), col)), col)


def strip_urls(col: Column) -> Column:
    return F.regexp_replace(col, "(?U)" + fv.URL, "")


def strip_handles(col: Column) -> Column:
    return F.regexp_replace(col, fv.HANDLE.replace(r"\w", WORD_CHARACTER), "")


def mask_numbers(col: Column) -> Column:
    return F.regexp_replace(col, "(?U)" + fv.NUMBER, fv.NUMBER_TOKEN)


def expand_contractions(
    col: Column,
    table: Iterable[tuple[str, str]] | None = fv.CONTRACTIONS,
    source: Column | None = None,
) -> Column:
    """Write out contractions; `table` holds (pattern, replacement) pairs, None leaves the text.

    `source` is a text that has every apostrophe `col` has: a cheap stand-in for the test below.
    """
    if table is None:
        return col
    expanded = reduce(
        lambda c, rule: F.regexp_replace(c, UNICODE_ANY_CASE + rule[0], rule[1]), table, col
    )
    # Most texts have no apostrophe; the others pay for the rules.
    seen = col if source is None else source
    apostrophe = F.contains(seen, F.lit("'")) | F.contains(seen, F.lit("’"))
    return F.when(apostrophe, expanded).otherwise(col)


def clean_text(
    col: Column, table: Iterable[tuple[str, str]] | None = fv.CONTRACTIONS, nfc: bool = True
) -> Column:
    """Null to blank, NFC, then URLs, handles, numbers, contractions, and the outer white space."""
    text = blank_if_null(col)
    text = normalize_nfc(text) if nfc else text
    plain = mask_numbers(strip_handles(strip_urls(text)))
    return strip_text(expand_contractions(plain, table, source=col))


def mask_terms(
    col: Column, terms: Iterable[str] = fv.MASKED_TERMS, token: str = fv.MASK_TOKEN
) -> Column:
    """Replace whole-word terms in any case; where two match, the earlier in the list wins.

    Terms are tried by first letter: only terms with the same one compete at a position, and they
    keep their order. The look-ahead for a first letter spares most positions the costlier borders.
    """
    by_letter: dict[str, list[str]] = {}
    for term in terms:
        by_letter.setdefault(term[0], []).append(re.escape(term[1:]))
    branches = "|".join(f"{re.escape(c)}(?:{'|'.join(r)})" for c, r in by_letter.items())
    first = _ahead(by_letter) if by_letter and "".join(by_letter).isascii() else ""
    return F.regexp_replace(col, rf"{UNICODE_ANY_CASE}{first}{WORD_BORDER}(?:{branches}){WORD_BORDER}", token)


def first_person_count(col: Column) -> Column:
    """Tokens between white space or sentence ends that are a first-person pronoun."""
    pronouns = "|".join(fv.FIRST_PERSON)
    initials = "".join(sorted({p[0] for p in fv.FIRST_PERSON}))
    # The look-ahead for a first letter spares most positions the costlier look-behind.
    pattern = rf"(?U)(?=[{initials}])(?<![^\s.!?])(?:{pronouns})(?![^\s.!?])"
    return F.regexp_count(F.lower(col), F.lit(pattern))


def sentence_count(col: Column) -> Column:
    """Runs between sentence ends that hold something other than white space."""
    return F.regexp_count(col, F.lit(r"(?U)[^\s.!?][^.!?\n]*"))


def first_person_rate(col: Column) -> Column:
    """First-person pronouns per sentence; 0.0 for a blank text."""
    return F.coalesce(
        first_person_count(col) / F.greatest(F.lit(1), sentence_count(col)), F.lit(0.0)
    )


def word_count(col: Column) -> Column:
    return F.coalesce(F.regexp_count(col, F.lit(r"(?U)\S+")), F.lit(0))


def lower_text(col: Column) -> Column:
    return F.lower(col)


def matches_any(col: Column, patterns: Iterable[str]) -> Column:
    """True at the first pattern found; later ones are then not tried."""
    return reduce(lambda a, b: a | b, [col.rlike(UNICODE_ANY_CASE + p) for p in any_of(patterns)])
