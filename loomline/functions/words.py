"""Unicode words of full-text search: runs of letters, digits and private characters, folded to lower case without accents.

A combining accent within a word belongs to it and is dropped; a letter made of a base letter A-Z and one accent is that
base letter; letters with two accents keep them. That is what the common full-text tokenizer of embedded databases does by
default, so scores and hits are comparable. Unassigned code points end words here.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Combining accents that belong to the word before them (fixed values).
ACCENTS = "\u0300\u0301\u0302\u0303\u0304\u0306\u0307\u0308\u0309\u030a\u030b\u030c\u030f\u0311\u031b\u0323\u0324\u0325\u0326\u0327\u0328\u032d\u032e\u0330\u0331"
#: Characters that make words, as a class of Java's expressions, and a whole word.
LETTER = r"\p{L}\p{N}\p{Co}"
WORD = f"[{LETTER}][{LETTER}{ACCENTS}]*+"
#: Accents are few in a row; a look behind needs a bound.
MOST_ACCENTS = 8


def fold_char(c: str) -> str:
    """Simple case folding, then the base letter of a letter with one accent."""
    f = c.casefold()
    if len(f) != 1:
        f = c.lower() if len(c.lower()) == 1 else c
    parts = unicodedata.decomposition(f).split()
    if len(parts) == 2 and not parts[0].startswith("<"):
        base = chr(int(parts[0], 16))
        if base.isascii() and base.isalpha():
            return base.lower()
    return f


def is_letter(c: str) -> bool:
    kind = unicodedata.category(c)
    return kind[0] in "LN" or kind == "Co"


def fold(word: str) -> str:
    """A word without its accents, in lower case."""
    return word.lower() if word.isascii() else "".join(map(fold_char, word.translate(_DROPPED)))


_DROPPED = dict.fromkeys(map(ord, ACCENTS))


def words_of(text: str) -> list[str]:
    """Folded words of a text: the rule in Python, for queries and tests."""
    out, word = [], ""
    for c in text:
        if is_letter(c) or (word and c in ACCENTS):
            word += c
        elif word:
            out.append(fold(word))
            word = ""
    return [*out, fold(word)] if word else out


@lru_cache(1)
def folding() -> tuple[str, str]:
    """Characters that folding changes and what they become, built by the rule over all letters of the basic plane; the
    accents, which become nothing, come last."""
    pairs = [(c, f) for c in map(chr, [*range(0xD800), *range(0xE000, 0x10000)]) if unicodedata.category(c)[0] in "LN" and (f := fold_char(c)) != c]
    return "".join(a for a, _ in pairs) + ACCENTS, "".join(b for _, b in pairs)


def folded(word: Column) -> Column:
    """A word column folded; only words with other than ASCII characters are looked up letter by letter."""
    a, b = folding()
    return F.when(word.rlike(r"^\p{ASCII}*$"), F.lower(word)).otherwise(F.translate(word, a, b))


def words(text: Column) -> Column:
    """The text's words as they are written, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def folded_text(text: Column, between: str = " ") -> Column:
    """A text's folded words in order, ``between`` (blanks) between two of them.

    Letters are looked up one by one, then all that is between words is replaced: accents within a word are gone by then, and
    others stand beside something else that ends a word. No word becomes a string of its own.
    """
    a, b = folding()
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), a, b), f"[^{LETTER}]++", between))


def count_folded(flat: Column, between: str = " ") -> Column:
    """How many words a folded text has."""
    blanks = F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit("")))
    return (blanks / len(between)).cast("int") + 1 - (flat == "").cast("int")  # without branches, so that the text is folded once


def count_words(text: Column) -> Column:
    """How many words a text has."""
    return count_folded(folded_text(text))


#: What is between the words of a text that phrases are counted in, so that neighbours share no blank.
APART = "  "


def count_phrase(flat: Column, phrase: list[str], prefix: bool = False) -> Column:
    """Occurrences of a phrase of folded words in a folded text with APART between its words; with ``prefix`` its last word may
    go on. Occurrences of several words may overlap, so those are counted by where they begin."""
    if not phrase:
        return F.lit(0)
    found, own = f" {APART.join(phrase)}{'' if prefix else ' '}", F.concat(F.lit(" "), flat, F.lit(" "))
    if len(phrase) == 1:
        return ((F.length(own) - F.length(F.replace(own, F.lit(found), F.lit("")))) / len(found)).cast("int")
    literal = "".join(c if c.isalnum() or c == " " else f"\\x{{{ord(c):x}}}" for c in found)
    return F.when(F.contains(own, F.lit(found)), F.regexp_count(own, F.lit(f"(?={literal})"))).otherwise(F.lit(0))


@lru_cache(1)
def _spellings() -> dict[str, str]:
    a, b = folding()
    out: dict[str, str] = {}
    for c, f in zip(a, b, strict=False):
        out[f] = out.get(f, "") + c
    return out


def _letter(c: str) -> str:
    every = c + _spellings().get(c, "")
    return (f"[{every}]" if len(every) > 1 else re.escape(c)) + (f"[{ACCENTS}]*+" if is_letter(c) else "")


def phrase_pattern(phrase: str, prefix: bool = False) -> str | None:
    """Java expression of a phrase of words in unfolded text, matched without case and accents; None without words.

    With ``prefix`` its last word may go on. A match of several words has no width, so phrases may overlap.
    """
    own = words_of(phrase)
    if not own:
        return None
    found = f"[^{LETTER}]++".join("".join(map(_letter, w)) for w in own) + ("" if prefix else f"(?![{LETTER}])")
    start = f"(?<![{LETTER}][{ACCENTS}]{{0,{MOST_ACCENTS}}})"
    return f"{start}(?={found})" if len(own) > 1 else start + found
