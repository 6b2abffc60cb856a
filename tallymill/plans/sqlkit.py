"""Snippets for the checking SQL (DuckDB dialect)."""

from __future__ import annotations

from tallymill.functions.text import BLANKS, WORD_CLASS


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


BLANK = q(BLANKS)
SPACE_CLASS = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
WORDS = rf"[{WORD_CLASS}]+|[^{SPACE_CLASS}{WORD_CLASS}]"


def strip(x: str) -> str:
    return f"trim({x}, {BLANK})"


def rstrip(x: str) -> str:
    return f"rtrim({x}, {BLANK})"


def words(x: str) -> str:
    return f"regexp_extract_all({x}, {q(WORDS)})"


def before(x: str, word: str) -> str:
    return f"string_split({x}, {q(word)})[1]"


def after_last(x: str, word: str) -> str:
    return f"string_split({x}, {q(word)})[-1]"


def after(x: str, word: str) -> str:
    return (
        f"CASE WHEN instr({x}, {q(word)}) > 0 "
        f"THEN substr({x}, instr({x}, {q(word)}) + {len(word)}) ELSE {x} END"
    )


def count_of(x: str, word: str) -> str:
    return f"((length({x}) - length(replace({x}, {q(word)}, ''))) // {len(word)})"


def truncate(x: str, stops: list[str]) -> str:
    hits = ", ".join(f"nullif(instr({x}, {q(s)}), 0)" for s in stops)
    return f"coalesce(substr({x}, 1, least({hits}) - 1), {x})"


def in_order(x: str, stops: list[str]) -> str:
    for stop in stops:
        x = before(x, stop)
    return x


def bucket(key: str, buckets: int = 10_000) -> str:
    return f"(CAST('0x' || substr(md5(CAST({key} AS VARCHAR)), 1, 8) AS BIGINT) % {buckets})"


def share(key: str) -> str:
    return f"(CAST('0x' || substr(md5(CAST({key} AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE)"


#: Fixed values of the vocabulary, written out here a second time so that the checks do not share a
#: table with what they check: words, words that differ at the start of a line, and signs.
WORD_TOKENS = {
    "with": "<with_stmt>", "def": "<def_stmt>", "class": "<class_stmt>", "try": "<try_stmt>",
    "except": "<except_stmt>", "finally": "<finally_stmt>", "while": "<while_stmt>",
    "assert": "<assert_stmt>", "del": "<del_stmt>", "elif": "<elif_stmt>", "and": "<and>",
    "or": "<or>", "not": "<not>", "is": "<is>", "return": "<return>", "raise": "<raise>",
    "break": "<break>", "continue": "<continue>", "pass": "<pass>", "global": "<global>",
    "nonlocal": "<nonlocal>", "from": "<from>", "as": "<as>", "in": "<in>", "if": "<if>",
    "for": "<for>", "else": "<else>", "True": "<true>", "False": "<false>", "None": "<none>",
    "yield": "<yield>", "lambda": "<lambda>", "await": "<await>", "async": "<async_keyword>",
    "not in": "<notin>", "is not": "<isnot>",
}
LINE_TOKENS = {
    "from": "<import_from_stmt>", "if": "<if_stmt>", "for": "<for_stmt>", "else": "<else_stmt>",
    "import": "<import_stmt>", "match": "<match_stmt>", "case": "<case_stmt>",
}
SIGN_TOKENS = {
    "//": "<floordiv>", "<": "<l>", ">": "<g>", "<<": "<lshift>", ">>": "<rshift>", "==": "<eq>",
    "!=": "<ne>", "<=": "<le>", ">=": "<ge>", "<>": "<lgne>", "+=": "<augadd>", "-=": "<augsub>",
    "*=": "<augmul>", "/=": "<augdiv>", "@=": "<augmatmul>", "//=": "<augfloordiv>",
    "%=": "<augmod>", "**=": "<augpow>", ">>=": "<augrshift>", "<<=": "<auglshift>",
    "&=": "<augand>", "^=": "<augxor>", "|=": "<augor>", "->": "<arrow>", "...": "<ellipsis>",
}
#: Fixed pattern of one lexeme: comments, strings, word pairs, words, numbers, signs, the rest.
LEXEME = (
    '#[^\\n]*|"""(?s:.*?)"""|\'\'\'(?s:.*?)\'\'\'|"(?:[^"\\\\\\n]|\\\\[^\\n])*"|\'(?:[^\'\\\\\\n]|\\\\[^\\'
    "n])*'|not[ \\t]in\\b|is[ \\t]not\\b|\\n[ \\t]*[\\p{L}_][\\p{L}\\p{N}_]*|[\\p{L}_][\\p{L}\\p{"
    'N}_]*|\\p{N}[\\p{L}\\p{N}_]*|\\/\\/\\=|\\*\\*\\=|\\>\\>\\=|\\<\\<\\=|\\.\\.\\.|\\/\\/|\\<\\<|\\>\\>|\\=\\='
    '|\\!\\=|\\<\\=|\\>\\=|\\<\\>|\\+\\=|\\-\\=|\\*\\=|\\/\\=|\\@\\=|\\%\\=|\\&\\=|\\^\\=|\\|\\=|\\-\\>|\\*\\*|\\<|\\'
    '>|[^\\p{L}\\p{N}_"\'#\\*/<>!=\\-\\+@%&\\^\\|\\.\\n]+|(?s:.)'
)


def token_table() -> dict[str, str]:
    """Tokens by lexeme; pairs also with a tab, words also behind a line break."""
    pairs = {w.replace(" ", "\t"): t for w, t in WORD_TOKENS.items() if " " in w}
    single = {w: t for w, t in WORD_TOKENS.items() if " " not in w}
    lines = {"\n" + w: t for w, t in (single | LINE_TOKENS).items()}
    return WORD_TOKENS | pairs | lines | SIGN_TOKENS


def _lexeme(l: str = "l") -> str:
    """A lexeme with its vocabulary word replaced."""
    table = token_table()
    keys = ", ".join(q(k) for k in table)
    values = ", ".join(q(v) for v in table.values())
    mapping = f"MAP([{keys}], [{values}])"
    bare = f"ltrim({l}, chr(10) || ' ' || chr(9))"
    return (
        f"CASE WHEN starts_with({l}, chr(10)) THEN "
        f"coalesce(substr({l}, 1, length({l}) - length({bare})) || {mapping}[chr(10) || {bare}], {l}) "
        f"ELSE coalesce({mapping}[replace({l}, chr(9), ' ')], {l}) END"
    )


def lexemes(x: str) -> str:
    return f"regexp_extract_all(chr(10) || {x}, {q(LEXEME)})"


def rewritten(x: str) -> str:
    parts = f"list_transform({lexemes(x)}, lambda l: {_lexeme()})"
    return f"substr(array_to_string({parts}, ''), 2)"


_QUOTED = r"""(?s)^(#|"[^"]|"".|'[^']|''.)"""
_IS_MASKED = f"regexp_matches(l, {q(_QUOTED)})"


def masked(lexemes_column: str) -> str:
    """Rewritten text with comments and strings replaced by marks."""
    comment, text = q("'MASK'"), q('"MASK"')
    return (
        f"substr(array_to_string(list_transform({lexemes_column}, lambda l: CASE "
        f"WHEN starts_with(l, '#') THEN {comment} WHEN {_IS_MASKED} THEN {text} "
        f"ELSE {_lexeme()} END), ''), 2)"
    )


def kept_marks(lexemes_column: str) -> str:
    return (
        f"list_transform(list_filter({lexemes_column}, lambda l: {_IS_MASKED}), "
        "lambda l: CASE WHEN starts_with(l, '#') THEN l || chr(10) ELSE l END)"
    )


def compacted(x: str) -> str:
    """The compaction without lookaround: blanks behind a sign go, then those in front."""
    sign = rf'[^a-zA-Z0-9_*"{SPACE_CLASS}]'
    x = f"replace({x}, chr(92), ' ')"
    behind, front = q(f"({sign})[{SPACE_CLASS}]+"), q(f"[{SPACE_CLASS}]+({sign})")
    for rule in (behind, front):
        x = f"regexp_replace({x}, {rule}, {q(chr(92) + '1')}, 'g')"
    return f"regexp_replace(replace({x}, '<SPACE>', ' '), '[{SPACE_CLASS}]+', ' ', 'g')"


def meta_cut(x: str) -> str:
    return (
        f"CASE WHEN starts_with({x}, '<') AND instr({x}, chr(10)) > 0 "
        f"THEN substr({x}, instr({x}, chr(10)) + 1) ELSE {x} END"
    )


def reason(x: str) -> str:
    return (
        f"CASE WHEN instr({x}, chr(10)) = 0 THEN 'no_newline' "
        f"WHEN starts_with({meta_cut(x)}, '#!/') THEN 'shebang' ELSE 'kept' END"
    )
