"""Column expressions on text. All of them stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquy.functions.lexicons import (ACCENTED, CAPITALS, CHARS_PER_TOKEN, CHARS_PER_TOKEN_UNKNOWN,
                                         ELIDED, PLAIN, WIDENED, literal_array)

#: Everything that is neither letter, digit, underscore nor space.
_NOT_WORD = r"[^\p{L}\p{N}_\s]"
_NOT_WORD_OR_SPACE = r"[^\p{L}\p{N}_]"
#: A content word: letters, one apostrophe allowed inside, or a run of digits.
TERM = r"(?:\p{L}+(?:'\p{L}+)?|\p{Nd}+)"
#: A word as compared with a reference text.
SPELLED = r"[\p{L}\p{N}]+(?:['’][\p{L}\p{N}]+)*"
#: Marks stripped from both ends of a word, hyphens included.
_EDGE = "\"'“”«».(),;:!?…"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^(?U)\s+|(?U)\s+$", "")


def collapse(c: Column) -> Column:
    """One space for every run of white space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def clean_text(c: Column) -> Column:
    """Collapsed white space, and none before punctuation."""
    return F.regexp_replace(collapse(c), r" ([,.;:!?…])", "$1")


def text_key(c: Column) -> Column:
    """Lower case, no punctuation: what two copies of a segment share."""
    return strip(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), _NOT_WORD, ""))


def words(c: Column) -> Column:
    """The words of a text; an empty array for an empty one."""
    flat = collapse(c)
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def word_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), _NOT_WORD_OR_SPACE, "")


def word_keys(ws: Column) -> Column:
    """The comparison form of each word; empty for a word of punctuation only."""
    return F.transform(ws, word_key)


def fold(c: Column) -> Column:
    """Lower case without accents, for Latin text."""
    return F.translate(F.lower(c), ACCENTED, PLAIN)


def capital(letter: Column) -> Column:
    """The capital of one letter as one letter: ẞ for ß, which is not SS; the letter itself where it has none."""
    return F.when(F.length(F.upper(letter)) > 1, F.translate(letter, WIDENED, CAPITALS)).otherwise(F.upper(letter))


def spelled_fold(c: Column) -> Column:
    """What two spellings of a word have in common: no case, accents or punctuation."""
    # Most words are plain letters, which only lose their case.
    return F.when(c.rlike("^[a-zA-Z]+$"), F.lower(c)).otherwise(F.array_join(F.regexp_extract_all(fold(c), F.lit(f"({SPELLED})"), F.lit(1)), ""))


def bare(c: Column, marks: str = _EDGE) -> Column:
    return F.btrim(c, F.lit(marks))


def terms(c: Column) -> Column:
    """Content-word candidates of a sentence, before stop words go."""
    found = F.regexp_extract_all(F.lower(c), F.lit(f"({TERM})"), F.lit(1))
    elided = literal_array(ELIDED)

    def whole(w):
        head = F.split_part(w, F.lit("'"), F.lit(1))
        cut = F.contains(w, F.lit("'")) & F.array_contains(elided, fold(head))
        return F.when(cut, F.split_part(w, F.lit("'"), F.lit(2))).otherwise(w)

    return F.filter(F.transform(found, whole), lambda w: F.length(w) >= 3)


def language_of(code: Column | str) -> Column:
    """The language whose lists apply: Italian when asked for, English otherwise.

    ``code`` is a column or the name of one.
    """
    code = F.col(code) if isinstance(code, str) else code
    short = F.regexp_extract(F.lower(F.trim(F.coalesce(code, F.lit("")))), r"^([^_-]*)", 1)
    return F.when(short == "it", F.lit("it")).otherwise(F.lit("en"))


def estimate_tokens(c: Column, language: Column | str | None = None) -> Column:
    """Model tokens a text is worth, from its length."""
    language = F.col(language) if isinstance(language, str) else language
    n = F.length(F.coalesce(c, F.lit("")))
    if language is None:
        return F.floor(n / F.lit(CHARS_PER_TOKEN_UNKNOWN)).cast("long")
    known = F.when(F.coalesce(language, F.lit("")) == "", F.lit(CHARS_PER_TOKEN_UNKNOWN)).when(
        language_of(language) == "en", F.lit(CHARS_PER_TOKEN["en"])).otherwise(F.lit(CHARS_PER_TOKEN["it"]))
    return F.floor(n / known).cast("long")


def slugify(c: Column) -> Column:
    """Lower-case words joined by hyphens."""
    return F.regexp_replace(F.regexp_replace(fold(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def heading_key(c: Column) -> Column:
    """A heading without punctuation, accents or case."""
    return strip(F.regexp_replace(fold(F.coalesce(c, F.lit(""))), _NOT_WORD, ""))
