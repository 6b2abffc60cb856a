"""Tokenizers and the vocabulary rewrite, as array and string expressions.

The rewrite is lexical: a regex splits source text into comments, strings,
names, operators and fillers, and only vocabulary lexemes change. Strings and
comments are single lexemes, so they are left alone.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymill import fixed
from tallymill.functions.text import BLANK_CLASS, WORD_CLASS

WORDS = rf"[{WORD_CLASS}]+|[^{BLANK_CLASS}{WORD_CLASS}]"
SPECIALS = "<(?:" + "|".join(t[1:-1] for t in fixed.grammar_tokens()) + ")>"

# Words the grammar leaves alone: they are plain names in current sources.
_PLAIN_NAMES = {"print", "exec"}
# Soft keywords and words whose token depends on starting a line.
_LEADING_ONLY = {"match": "<match_stmt>", "case": "<case_stmt>"}
_LEADING = {
    "if": "<if_stmt>", "for": "<for_stmt>", "else": "<else_stmt>",
    "import": "<import_stmt>", "from": "<import_from_stmt>", **_LEADING_ONLY,
}
_INLINE = {"if": "<if>", "for": "<for>", "else": "<else>", "from": "<from>"}
_LITERALS = {"True": "<true>", "False": "<false>", "None": "<none>"}


def rewrite_table() -> dict[str, str]:
    """Token by lexeme; a line-starting lexeme is keyed with a line break."""
    table: dict[str, str] = {}
    for word in fixed.STATEMENT_WORDS:
        if word not in _LEADING_ONLY:
            table[word] = f"<{word}_stmt>"
    for word in fixed.EXPRESSION_WORDS:
        if word not in _PLAIN_NAMES and word not in ("true", "false", "none"):
            table[word] = f"<{word}>"
    table.update(_INLINE)
    table.update(_LITERALS)
    for word in ("yield", "lambda", "await"):
        table[word] = f"<{word}>"
    table["async"] = "<async_keyword>"
    leading = {"\n" + word: token for word, token in table.items()}
    leading.update({"\n" + word: token for word, token in _LEADING.items()})
    operators = {
        sign: token for sign, token in fixed.OPERATOR_TOKENS.items()
        if sign not in ("ellipsis", "not in", "is not")
    }
    operators["..."] = "<ellipsis>"
    for gap in (" ", "\t"):
        table.update({f"not{gap}in": "<notin>", f"is{gap}not": "<isnot>"})
    return {**table, **leading, **operators}


def _operator_rule() -> str:
    signs = [s for s in rewrite_table() if not any(c.isalpha() for c in s)]
    signs += ["**"]
    escaped = ["".join("\\" + c for c in s) for s in sorted(signs, key=len, reverse=True)]
    return "|".join(escaped)


def lexeme_rule(lookaround: bool = True) -> str:
    """The lexer; without lookaround it runs on automaton regex engines too."""
    name = r"[\p{L}_][\p{L}\p{N}_]*"
    stop = rf"(?![{WORD_CLASS}])" if lookaround else r"\b"
    if lookaround:
        # Lazy scan to the first quote behind an even run of backslashes; a
        # repeated group would recurse once per escape on long lines.
        text = [rf"{q}[^\n]*?(?<!\\)(?:\\\\)*{q}" for q in ('"', "'")]
    else:
        text = [rf"{q}(?:[^{q}\\\n]|\\[^\n])*{q}" for q in ('"', "'")]
    return "|".join([
        r"#[^\n]*",
        r'"""(?s:.*?)"""',
        r"'''(?s:.*?)'''",
        *text,
        rf"not[ \t]in{stop}",
        rf"is[ \t]not{stop}",
        rf"\n[ \t]*{name}",
        name,
        r"\p{N}[\p{L}\p{N}_]*",
        _operator_rule(),
        r"""[^\p{L}\p{N}_"'#\*/<>!=\-\+@%&\^\|\.\n]+""",
        r"(?s:.)",
    ])


def words(text: Column) -> Column:
    """Runs of word characters, or single visible marks."""
    return F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))


def words_or_specials(text: Column) -> Column:
    """Like ``words`` with every special token kept whole."""
    return F.regexp_extract_all(text, F.lit(f"{SPECIALS}|{WORDS}"), F.lit(0))


def pieces_or_specials(text: Column) -> Column:
    """Word runs of at most four characters, marks, and special tokens."""
    rule = rf"{SPECIALS}|[{WORD_CLASS}]{{1,4}}|[^{BLANK_CLASS}{WORD_CLASS}]"
    return F.regexp_extract_all(text, F.lit(rule), F.lit(0))


def lexemes(text: Column) -> Column:
    """Source lexemes; a line break in front lets the first line start one."""
    return F.regexp_extract_all(
        F.concat(F.lit("\n"), text), F.lit(lexeme_rule()), F.lit(0)
    )


#: Named tokenizers: each maps a text column to an array of tokens.
TOKENIZERS: dict[str, Callable[[Column], Column]] = {
    "words": words_or_specials,
    "pieces": pieces_or_specials,
}


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def _rewritten(lexeme: Column) -> Column:
    table = rewrite_table()
    inline = {key: token for key, token in table.items() if not key.startswith("\n")}
    leading = {key[1:]: token for key, token in table.items() if key.startswith("\n")}
    # Two set tests settle most lexemes before a map is searched.
    word = F.ltrim(lexeme, F.lit("\n \t"))
    head = F.left(lexeme, F.length(lexeme) - F.length(word))
    started = F.when(
        word.isin(list(leading)), F.concat(head, F.try_element_at(_lookup(leading), word))
    ).otherwise(lexeme)
    return (
        F.when(lexeme.isin(list(inline)), F.try_element_at(_lookup(inline), lexeme))
        .when(F.startswith(lexeme, F.lit("\n")), started)
        .otherwise(lexeme)
    )


def rewrite_vocabulary(text: Column) -> Column:
    """Replace keyword and operator lexemes by grammar tokens."""
    parts = F.transform(lexemes(text), _rewritten)
    return F.substr(F.array_join(parts, ""), F.lit(2))


def grammar_hits(text: Column) -> Column:
    """Grammar tokens that occur in a (rewritten) text, in order."""
    return F.regexp_extract_all(text, F.lit(SPECIALS), F.lit(0))


_SIGN = rf'[^a-zA-Z0-9_*"{BLANK_CLASS}]'
_BLOCK = r"(?<=>)(?<=<[a-z_]{1,40}_[a-z]{1,20}>)"
#: Compaction steps, in order. The run guard keeps long blank runs linear.
COMPACTION = [
    (r"\\", " "),
    (
        rf"(?<={_SIGN})[{BLANK_CLASS}]+"
        rf"|(?<![{BLANK_CLASS}])[{BLANK_CLASS}]++(?={_SIGN})",
        "",
    ),
    ("<SPACE>", " "),
    (rf"[{BLANK_CLASS}]+", " "),
    (
        rf"{_BLOCK}[{BLANK_CLASS}]*<line_sep>"
        rf"|<line_sep>[{BLANK_CLASS}]*(?=<[a-z_]+_(?:stmt|end|start|keyword)>)",
        "",
    ),
]


def compact(text: Column) -> Column:
    """Drop blanks and line separators that carry no meaning."""
    return reduce(
        lambda out, step: F.regexp_replace(out, step[0], step[1]), COMPACTION, text
    )


def _masked(lexeme: Column) -> Column:
    return lexeme.rlike(r"""\A(?:#|"[^"]|"".|'[^']|''.)(?s:.*)\z""")


def rewrite_compact(text: Column) -> Column:
    """Rewrite and compact, with strings and comments restored untouched."""
    parts = lexemes(text)
    kept = F.transform(
        F.filter(parts, _masked),
        lambda t: F.when(F.startswith(t, F.lit("#")), F.concat(t, F.lit("\n")))
        .otherwise(t),
    )
    masked = F.transform(
        parts,
        lambda t: F.when(
            _masked(t),
            F.when(F.startswith(t, F.lit("#")), F.lit("'MASK'"))
            .otherwise(F.lit('"MASK"')),
        ).otherwise(_rewritten(t)),
    )
    gaps = F.split(compact(F.substr(F.array_join(masked, ""), F.lit(2))), "[\"']MASK[\"']")
    return F.array_join(
        F.zip_with(gaps, kept, lambda gap, text_: F.concat(
            F.coalesce(gap, F.lit("")), F.coalesce(text_, F.lit(""))
        )),
        "",
    )
