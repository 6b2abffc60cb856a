"""Shared string builders.

Positions are 1-based characters and 0 means "not found", as in Spark SQL.
Python's ``strip`` removes every Unicode blank while Spark's ``trim`` removes
only spaces, so the trimming helpers name the whole blank set.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 "
    + "".join(chr(code) for code in range(0x2000, 0x200B))
    + "    　"
)
#: The same set inside a regex character class.
BLANK_CLASS = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
WORD_CLASS = r"\p{L}\p{N}_"

Text = Column | str


def as_column(value: Text) -> Column:
    """A plain string is a literal here, never a column name."""
    return F.lit(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Work out ``value`` once and use it in ``body``.

    Builders that mention a column many times would otherwise repeat its whole
    expression at every mention, and once per element inside a lambda.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def chain(value: Column, *steps: Callable[[Column], Column]) -> Column:
    """Apply steps in order, each on a bound value."""
    return reduce(let, steps, value)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(BLANKS))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def is_blank(text: Column) -> Column:
    return F.length(strip(text)) == 0


def first_filled(first: Column, second: Column) -> Column:
    """First of two texts that is neither null nor empty."""
    return F.coalesce(F.nullif(first, F.lit("")), second)


def find(text: Column, word: Text, start: Column | None = None) -> Column:
    if start is None:
        return F.instr(text, as_column(word))
    return F.call_function("position", as_column(word), text, start)


def contains(text: Column, word: Text) -> Column:
    return F.contains(text, as_column(word))


def rfind(text: Column, word: Text) -> Column:
    word = as_column(word)
    tail = F.length(after_last(text, word))
    return F.when(
        contains(text, word), F.length(text) - tail - F.length(word) + 1
    ).otherwise(0)


def before(text: Column, word: Text) -> Column:
    """Text before the first occurrence; the whole text if there is none."""
    return F.call_function("substring_index", text, as_column(word), F.lit(1))


def after_last(text: Column, word: Text) -> Column:
    """Text after the last occurrence; the whole text if there is none."""
    return F.call_function("substring_index", text, as_column(word), F.lit(-1))


def after(text: Column, word: Text) -> Column:
    """Text after the first occurrence; the whole text if there is none."""
    word = as_column(word)
    at = find(text, word)
    return F.when(at > 0, F.substr(text, at + F.length(word))).otherwise(text)


def drop_left(text: Column, count: Column) -> Column:
    return F.substr(text, count + 1)


def quoted(word: str) -> str:
    """A literal inside a Java regex."""
    return "\\Q" + word + "\\E"


def after_splits(text: Column, word: str, splits: int) -> Column:
    """Last piece of at most ``splits`` cuts at a literal separator."""
    pieces = F.split(text, quoted(word), splits + 1)
    return F.element_at(pieces, -1)


def count_of(text: Column, word: Text) -> Column:
    """Occurrences that do not overlap."""
    word = as_column(word)
    gone = F.length(F.replace(text, word, F.lit("")))
    return F.floor((F.length(text) - gone) / F.length(word)).cast("long")


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_count(text: Column) -> Column:
    return F.size(lines(text)).cast("long")


def regex_any(words: Sequence[str], quote=quoted) -> str:
    return "|".join(quote(word) for word in words)


def matches_glob(name: Column, pattern: str) -> Column:
    """Shell wildcard match of a whole name: ``*``, ``?`` and ``[...]``."""
    out, at = [], 0
    while at < len(pattern):
        char = pattern[at]
        at += 1
        if char == "*":
            out.append(".*")
        elif char == "?":
            out.append(".")
        elif char == "[" and "]" in pattern[at + 1:]:
            end = pattern.index("]", at + 1)
            body = pattern[at:end].replace("\\", "\\\\").replace("[", "\\[")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            at = end + 1
        else:
            out.append(quoted(char))
    return name.rlike("(?s)\\A(?:" + "".join(out) + ")\\z")


def hash_bucket(key: Column, buckets: int = 10_000) -> Column:
    """Even, repeatable bucket of a key; equal in every engine that has md5."""
    head = F.substring(F.md5(key.cast("string").cast("binary")), 1, 8)
    return F.pmod(F.conv(head, 16, 10).cast("long"), F.lit(buckets)).cast("long")


def hash_share(key: Column) -> Column:
    """Even, repeatable number from 0 up to 1 of a key, from 52 bits of its md5."""
    head = F.substring(F.md5(key.cast("string").cast("binary")), 1, 13)
    return F.conv(head, 16, 10).cast("long") / F.lit(float(1 << 52))


def first_line(text: Column) -> Column:
    return before(text, "\n")


def unindented_head(text: Column, blanks_inside: bool) -> Column:
    """Text in front of the first unindented line, or null if there is none.

    With ``blanks_inside`` any line with a visible character that does not
    start with a space or tab counts, else the line must start with one.
    """
    if blanks_inside:
        start = (
            rf"(?:[^\n{BLANK_CLASS}]|[\r\f\x0b\x1c-\x1f\x{{85}}\p{{Z}}&&[^ ]]"
            rf"[^\n]*?[^\n{BLANK_CLASS}])"
        )
        rule = rf"(?s)\A((?:.*?\n)??){start}"
    else:
        rule = rf"(?s)\A(\n*[^\n]+\n(?:.*?\n)??)[^{BLANK_CLASS}]"
    return F.when(text.rlike(rule), F.regexp_extract(text, rule, 1))
