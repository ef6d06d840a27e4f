"""Cleaning, paragraph and statistics functions: Column in, Column out, all built in."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyr.functions import charclass as cc


def _count(c: Column, pattern: str) -> Column:
    """Matches of a pattern; each is a string of its own, so for single characters see _chars."""
    return F.regexp_count(c, F.lit(pattern)).cast("long")


def _rare(one: str) -> str:
    """A class that holds neither printable ASCII nor Hangul syllables, which are ruled out first: Java asks the ranges of a class one after the other."""
    return rf"[[^\x20-\x7e{cc.HANGUL}]&&{one}]"


def _chars(c: Column, one: str) -> Column:
    """Characters of a class, as what is missing when its runs are deleted."""
    return (F.length(c) - F.length(F.regexp_replace(c, one + "++", ""))).cast("long")


def strip(c: Column) -> Column:
    """Without white space at both ends, as Python strips it; only the ends are looked at."""
    return F.btrim(c, F.lit(cc.SPACES))


def squeeze(c: Column) -> Column:
    """Words joined by one space."""
    # a single space between words is left as it is
    return strip(F.regexp_replace(c, rf"(?:{_rare(f'[{cc.WS}]')}|\x20(?=[{cc.WS}]))[{cc.WS}]*+", " "))


def strip_noise(c: Column) -> Column:
    """Without the characters that binary records leave in a text; line ends go with them."""
    return F.regexp_replace(c, _rare(f"[{cc.NOISE}]") + "++", "")


def strip_ascii_noise(c: Column, repeats: bool = True) -> Column:
    patterns = ((cc.REPEATED,) if repeats else ()) + cc.ASCII_NOISE
    return reduce(lambda x, p: F.regexp_replace(x, p, ""), patterns, c)


def drop_foreign_runs(c: Column, longest: int = 10) -> Column:
    """Without runs of more than `longest` characters that are not Korean."""
    return F.regexp_replace(c, f"[^{cc.KOREAN}]{{{longest + 1},}}", "")


def keep_allowed(c: Column) -> Column:
    """Allowed characters; other white space becomes a space, the rest goes."""
    spaced = F.regexp_replace(c, _rare(f"[{cc.WS}&&[^{cc.ALLOWED}{cc.ALLOWED_SPACES}]]"), " ")
    return F.regexp_replace(spaced, _rare(f"[^{cc.ALLOWED}{cc.ALLOWED_SPACES}]") + "++", "")


def korean_ratio(c: Column, wide: bool = False) -> Column:
    """Korean characters, with `wide` also single leading and trailing letters, of all that are not white space; 0 if there are none."""
    korean = cc.KOREAN + cc.LETTERS if wide else cc.KOREAN
    # blanks are counted by bytes; the rest of white space is looked for behind them
    blanks = F.octet_length(c) - F.octet_length(F.replace(c, F.lit(" "), F.lit("")))
    ink = (F.length(c) - blanks).cast("long") - _chars(c, _rare(f"[{cc.WS}]"))
    return F.coalesce(_chars(c, f"[{korean}]") / F.nullif(ink, F.lit(0)), F.lit(0.0))


def smart_filter(c: Column) -> Column:
    """Characters of the languages served; other white space becomes a space, the rest goes."""
    spaced = F.regexp_replace(c, _rare(f"[{cc.WS}&&[^{cc.SERVED}{cc.ALLOWED_SPACES}]]"), " ")
    return F.regexp_replace(spaced, _rare(f"[^{cc.SERVED}{cc.ALLOWED_SPACES}]") + "++", "")


def usable(c: Column) -> Column:
    """Whether a page's text is more than placeholder squares."""
    return ~F.trim(c).rlike("^[■□]*$")


def first_usable(*texts: Column) -> Column:
    """The first text that is more than placeholder squares, else the last one.

    A text that holds such squares has no form in a single-byte encoding, so
    decoding it anew can change nothing and is left out.
    """
    return F.coalesce(*(F.when(usable(c), c) for c in texts[:-1]), texts[-1])


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def meaningful(token: Column) -> Column:
    """Whether a token is kept by the pipeline for word processor texts; the cheap and common cases first."""
    n, korean = F.length(token), f"[{cc.KOREAN}]"
    kinds = F.size(F.array_distinct(F.split(token, "")))
    bare = F.regexp_replace(token, "[.,:/-]", "")
    return (
        F.when(token.rlike(f"^(?:[A-Za-z0-9]{{1,4}}|(?=[^{cc.KOREAN}]{{0,9}}{korean})(?s:.){{1,10}})$"), True)
        .when(n == 0, False)
        .when(token.rlike(korean), F.regexp_count(token, F.lit(korean)) / n >= 0.1)
        .when(n > 10, False)
        .when((n > 4) & (1 - kinds / n > 0.5), False)
        .when(bare.rlike(r"^[\p{L}\p{N}]+$"), True)
        .when(token.rlike(r"""^[#$%&*+=\-<>?!@'"()\[\]{}.,;:]+$"""), n <= 2)
        .otherwise(token.isin(*"※→←↔⇒"))
    )


def keep_tokens(c: Column) -> Column:
    return F.array_join(F.filter(F.split(c, f"[{cc.WS}]+"), meaningful), " ")


def gate(c: Column, least: float = 0.05) -> Column:
    """The text, or an empty one if it is short or hardly Korean."""
    return once(c, lambda x: F.when((F.length(x) >= 10) & (korean_ratio(x) >= least), x).otherwise(""))


def clean(c: Column) -> Column:
    """The whole pipeline for word processor texts."""
    steps = (strip_noise, strip_ascii_noise, drop_foreign_runs, keep_allowed, keep_tokens, gate, strip)
    return reduce(lambda x, f: f(x), steps, F.coalesce(c, F.lit("")))


def clean_zero_width(c: Column) -> Column:
    return squeeze(F.regexp_replace(c, f"[{cc.ZERO_WIDTH}]", ""))


def clean_line(c: Column) -> Column:
    """Full-width signs narrowed, noise deleted, white space squeezed; a line that is mostly noise is dropped."""
    narrow = F.translate(c, "　＃（）［］", " #()[]")
    bare = F.regexp_replace(narrow, rf"[ࡂृ{cc.CONTROLS}{cc.SPECIALS}]", "")
    bare = F.regexp_replace(F.regexp_replace(bare, "Bƀ+", ""), "䤀耈蠂", "")
    line = squeeze(bare)
    known = _chars(line, r"[\x{AC00}-\x{D7AF}A-Za-z\p{Nd}]")
    return F.when((F.length(line) >= 3) & (known < F.length(line) * 0.2), "").otherwise(line)


def composed(c: Column) -> Column:
    """Canonical composition (NFC), for which Spark has no function.

    A plain UDF, which holds some 100 rows at once: an Arrow batch of 10,000
    texts and its copies took hundreds of MB of each Python worker.
    """

    @F.udf("string", useArrow=False)
    def nfc(x: str | None) -> str | None:
        from unicodedata import normalize

        return None if x is None else normalize("NFC", x)

    return nfc(c)


def clean_controls(c: Column) -> Column:
    """Control characters mapped or deleted, zero width deleted, white space squeezed; put `composed` before it for NFC."""
    spaced = F.translate(c, "\x0b\x0c", " \n")
    return clean_zero_width(F.regexp_replace(spaced, rf"[ࡂृ࡚{cc.CONTROLS}{cc.SPECIALS}\x{{80}}-\x{{9f}}]", ""))


def clean_improved(c: Column) -> Column:
    """clean_controls with canonical composition in its place, behind control characters and before what has no width."""
    spaced = F.regexp_replace(F.translate(c, "\x0b\x0c", " \n"), rf"[ࡂृ࡚{cc.CONTROLS}{cc.SPECIALS}\x{{80}}-\x{{9f}}]", "")
    return clean_zero_width(composed(spaced))


#: A character that is no white space; visible ASCII is tested first, as most characters are of it.
_INK = rf"[\x21-\x7e{cc.HANGUL}[^{cc.WS}]]"


def words(c: Column) -> Column:
    return _count(c, _INK + "++")


#: White space beyond ASCII, and what is none in a text without it; classes of ASCII alone are several times as fast.
_WIDE_SPACE = r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_PLAIN_SPACE = r"\x09-\x0d\x1c-\x20"


def plain_spaces(c: Column) -> Column:
    """The text with white space beyond ASCII, where it has any, as spaces; lengths stay."""
    return F.when(c.rlike(_WIDE_SPACE), F.regexp_replace(c, _WIDE_SPACE, " ")).otherwise(c)


def marks(c: Column) -> Column:
    """A text that plain_spaces has passed, with each run that is neither white space nor a sentence end as one x.

    Words, sentences and their words are told by this text, a third as long,
    and no list of them is made.
    """
    return F.regexp_replace(c, f"[^{_PLAIN_SPACE}.!?]++", "x")


def words_of_lines(m: Column) -> Column:
    """Of marks: the number of words of each line."""
    own = F.translate(F.regexp_replace(m, "[x.!?]++", "x"), "\t\x0b\x0c\r\x1c\x1d\x1e\x1f ", "")
    return F.transform(F.split(own, "\n"), lambda x: F.length(x).cast("long"))


def sentence_marks(m: Column) -> Column:
    """Of marks: an x for each word of a sentence and a full stop for each sentence end."""
    return F.translate(m, "!?\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f ", "..")


def is_heading(c: Column, styled: Column | None = None) -> Column:
    by_text = strip(c).rlike("|".join(cc.HEADINGS))
    return by_text if styled is None else F.coalesce(styled, F.lit(False)) | by_text


def heading_level(c: Column, styled: Column | None = None) -> Column:
    level = reduce(lambda x, p: x.when(c.rlike(p[0]), p[1]), cc.LEVELS[1:], F.when(c.rlike(cc.LEVELS[0][0]), cc.LEVELS[0][1])).otherwise(cc.DEFAULT_LEVEL)
    return level if styled is None else F.coalesce(F.least(F.greatest(styled, F.lit(1)), F.lit(6)), level)


def heading_kind(c: Column) -> Column:
    return (
        F.when(c.rlike(rf"^제[{cc.WS}]*\p{{Nd}}+[{cc.WS}]*[장절조항]"), "legal")
        .when(c.rlike("(?i)^(chapter|section)"), "academic")
        .otherwise("general")
    )


def paragraph_type(c: Column, styled: Column | None = None) -> Column:
    upper = (F.upper(c) == c) & (F.lower(c) != c)
    return (
        F.when(is_heading(c, styled), "heading")
        .when(c.rlike(cc.BULLET_ITEM), "list_item")
        .when(c.rlike(cc.NUMBER_ITEM), "numbered_list")
        .when((F.length(c) < 50) & upper, "title")
        .otherwise("normal")
    )


def tags(c: Column) -> Column:
    n = words(c)
    found = [F.when(c.rlike(p), name) for name, p in cc.TAGS]
    return F.array_compact(F.array(*found, F.when(n < 10, "short").when(n > 100, "long")))


def list_type(c: Column) -> Column:
    return F.when(c.rlike(cc.NUMBER_ITEM), "ordered").when(c.rlike(cc.KOREAN_ITEM), "korean_ordered").otherwise("unordered")


def list_level(c: Column) -> Column:
    """Pairs of leading blanks, plus one."""
    return F.floor((F.length(c) - F.length(F.regexp_replace(c, f"^[{cc.WS}]+", ""))) / 2).cast("long") + 1


def sentence_count(c: Column) -> Column:
    """Runs between sentence ends that are not blank."""
    return F.size(F.filter(F.split(c, "[.!?]+"), lambda x: x.rlike(_INK))).cast("long")


def text_statistics(c: Column, sentences: Column | None = None) -> dict[str, Column]:
    """Counts and ratios of a text by name; ratios are rounded to 6 places.  sentences: its sentence_marks, where they are a column already."""
    n = F.length(c).cast("long")
    own = F.greatest(n, F.lit(1))
    if sentences is None:
        count = sentence_count(c)
        # a sentence end divides a word that holds it, as splitting at the ends does
        parts = _count(c, rf"[\x22-\x2d\x2f-\x3e\x40-\x7e[^{cc.WS}.!?]]++")
    else:
        count = F.length(F.translate(F.regexp_replace(sentences, "x++", "x"), ".", "")).cast("long")
        parts = F.length(F.translate(sentences, ".", "")).cast("long")
    # characters of one length in bytes are counted by bytes, which takes no look at each
    size = F.octet_length(c)
    without = lambda x: (size - F.octet_length(x)).cast("long")
    blanks, ends = without(F.replace(c, F.lit(" "), F.lit(""))), without(F.replace(c, F.lit("\n"), F.lit("")))
    return {
        "char_count": n,
        "char_count_no_spaces": n - blanks - ends,
        "word_count": words(c),
        "line_count": ends + 1,
        "korean_ratio": F.round(without(F.regexp_replace(c, f"[{cc.HANGUL}]+", "")) / 3 / own, 6),
        "english_ratio": F.round(without(F.regexp_replace(c, "[A-Za-z]+", "")) / own, 6),
        "sentence_count": count,
        "avg_sentence_length": F.round(parts / F.greatest(count, F.lit(1)), 6),
    }


def quality(c: Column) -> dict[str, Column]:
    """Shares of kinds of characters in percent, by name; nulls for an empty text but for quality_score 0."""
    n = F.nullif(F.length(c), F.lit(0))
    korean, english, digits = _chars(c, r"[\x{AC00}-\x{D7AF}]"), _chars(c, "[A-Za-z]"), _chars(c, r"\p{Nd}")
    noise = _chars(c, rf"[ࡂृ{cc.CONTROLS}]")
    readable = korean + english + digits + _chars(c, "[ \n]")
    return {
        "total_chars": n.cast("long"), "korean_chars": korean, "english_chars": english, "numbers": digits,
        "korean_pct": F.round(korean / n * 100, 6), "noise_pct": F.round(noise / n * 100, 6),
        "quality_score": F.coalesce(F.round(readable / n * 100, 6), F.lit(0.0)),
    }


def noise_counts(c: Column) -> dict[str, Column]:
    return {
        "control_chars": _chars(c, f"[{cc.CONTROLS}]"),
        "special_chars": _chars(c, "[ࡂृ]"),
        "unicode_specials": _chars(c, f"[{cc.SPECIALS}]"),
        "replacement_char": _chars(c, r"\x{FFFD}"),
        "zero_width": _chars(c, f"[{cc.ZERO_WIDTH}]"),
    }


def garbled_ok(c: Column) -> Column:
    """At least 10 characters, over half of them allowed, under a tenth garbled, and 11 Korean or 21 Latin letters."""
    n = F.length(c)
    allowed = _chars(c, f"[{cc.ALLOWED}{cc.ALLOWED_SPACES}]")
    garbled = _chars(c, f"[{cc.NOISE}&&[^{cc.ALLOWED_SPACES}]]")
    return (n >= 10) & (allowed / n > 0.5) & (garbled / n < 0.1) & ((_chars(c, f"[{cc.KOREAN}]") > 10) | (_chars(c, "[A-Za-z]") > 20))


def xml_escape(c: Column, quotes: bool = True) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")) + ((('"', "&quot;"),) if quotes else ()):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c
