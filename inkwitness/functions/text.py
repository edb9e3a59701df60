"""Column functions over text.

Words follow Unicode: a word character is a letter, a number or ``_``.  Java's ``\\w`` and ``\\b``
are narrower, so boundaries are always spelled out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from inkwitness import fixed_values as V

WORD_CHARS = r"\p{L}\p{N}_"
NOT_BEFORE = rf"(?<![{WORD_CHARS}])"
NOT_AFTER = rf"(?![{WORD_CHARS}])"
LETTERS = rf"{NOT_BEFORE}[a-zA-Z]++{NOT_AFTER}"
LETTERS2 = rf"{NOT_BEFORE}[a-zA-Z]{{2,}}+{NOT_AFTER}"
LOWER2 = rf"{NOT_BEFORE}[a-z]{{2,}}+{NOT_AFTER}"
ANY_WORD = rf"[{WORD_CHARS}]+"
BOUNDARY = rf"(?:(?<=[{WORD_CHARS}])(?![{WORD_CHARS}])|(?<![{WORD_CHARS}])(?=[{WORD_CHARS}]))"
SPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
_STOP = sorted({w for w in V.STOPWORDS if re.fullmatch("[a-z]{2,}", w)})

# Characters a quoted value shows as escapes (format characters and control white space).
_ESCAPES = [("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\xa0", "\\xa0"), ("\xad", "\\xad")] + [
    (c, f"\\u{ord(c):04x}") for c in V.ZERO_WIDTH if c not in "\u00AD\u034F"
]


def fill(template: str, **values: Column) -> Column:
    """Message format -> string column; ``{name}`` is replaced by the column of that name."""
    parts = []
    for text, name in re.findall(r"([^{]*)(?:\{(\w+)\})?", template):
        if text:
            parts.append(F.lit(text))
        if name:
            parts.append(values[name].cast("string"))
    return F.concat(*parts)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def is_blank(c: Column) -> Column:
    return F.length(strip(c)) == 0


def snippet(c: Column, limit: int = 200) -> Column:
    """One line, at most ``limit`` characters, with an ellipsis if cut."""
    line = F.replace(c, F.lit("\n"), F.lit(" "))
    return F.when(F.length(line) > limit, F.concat(F.substring(line, 1, limit), F.lit("…"))).otherwise(line)


def quoted(c: Column) -> Column:
    """Value in quotes, unprintable characters as escapes."""
    body = c
    for char, shown in _ESCAPES:
        body = F.replace(body, F.lit(char), F.lit(shown))
    double = F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"'))
    single = F.replace(body, F.lit("'"), F.lit("\\'"))
    return F.when(double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.when(F.contains(c, F.lit("'")), single).otherwise(body), F.lit("'"))
    )


def fixed1(c: Column) -> Column:
    """Number with one decimal place as text."""
    return F.format_string("%.1f", F.bround(c, 1))


def fixed0(c: Column) -> Column:
    return F.bround(c, 0).cast("long").cast("string")


def percent(c: Column) -> Column:
    return F.concat(fixed0(c * 100), F.lit("%"))


def letter_word_count(c: Column) -> Column:
    """Whole words made of ASCII letters only."""
    return F.regexp_count(c, F.lit(LETTERS))


def word_count2(c: Column) -> Column:
    """Whole words of two or more ASCII letters."""
    return F.regexp_count(c, F.lit(LETTERS2))


def words(c: Column) -> Column:
    """Lower-case words of two or more ASCII letters, in order, stop words kept."""
    return F.regexp_extract_all(F.lower(c), F.lit(LOWER2), F.lit(0))


def tokenise(c: Column) -> Column:
    """``words`` without stop words; repeats stay."""
    return F.filter(words(c), lambda w: ~w.isin(_STOP))


def sentences(c: Column) -> Column:
    """Sentences longer than ten characters."""
    parts = F.transform(F.split(strip(c), V.SENTENCE_BREAK), strip)
    return F.filter(parts, lambda s: F.length(s) > V.SENTENCE_MIN_CHARS)


def ngrams(tokens: Column, n: int) -> Column:
    """Distinct runs of ``n`` neighbouring tokens, each joined by a space."""
    count = F.size(tokens) - (n - 1)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.array_distinct(F.when(count > 0, runs).otherwise(F.array().cast("array<string>")))


def _ranges(script: str) -> str:
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in V.SCRIPT_RANGES[script])


SCRIPT_CLASS = {script: f"[{_ranges(script)}]" for script in V.SCRIPT_RANGES}


def char_script(c: Column) -> Column:
    """Script of one character."""
    out = F.when(F.lit(False), F.lit(""))
    for script, chars in SCRIPT_CLASS.items():
        out = out.when(c.rlike(f"^{chars}"), script)
    return out.when(c.rlike(r"^[\p{N}\p{P}\p{Z}\p{M}\p{C}]"), "Neutral").otherwise("Other")


def scripts_of(word: Column) -> Column:
    """Sorted names of the scripts a word uses, numbers and marks aside."""
    return F.array_compact(F.array(*[F.when(word.rlike(SCRIPT_CLASS[s]), F.lit(s)) for s in sorted(SCRIPT_CLASS)]))


def with_boundaries(pattern: str) -> str:
    """Rewrite ``\\b`` as a Unicode word boundary, in its one-sided form next to a plain word character."""
    pattern = re.sub(r"(?<=[A-Za-z0-9])\\b", lambda _: NOT_AFTER, pattern)
    pattern = re.sub(r"\\b(?=[A-Za-z0-9])", lambda _: NOT_BEFORE, pattern)
    return pattern.replace(r"\b", BOUNDARY)
