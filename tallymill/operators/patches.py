"""Diff documents: fields, hunks, lenient application and validity states.

Every step works inside one document, so a table of diffs needs no shuffle.
A patch costs about what its file and its hunks hold together.
Hunks are parsed once into a column and then read by the later steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymill.functions import text as t

# Marks and validity states of the diff format.
NAME, FILE, MESSAGE, DIFF = "<NME> ", "\n<BEF> ", "\n<MSG> ", "\n<DFF> "
NEW_FILE = "ADDFILE"
NO_NEWLINE = r"(?md)^\\ No newline at end of file$\n?"
HUNK_HEADER = r"(?md)^(@@ [^\n]*? @@)[^\n]*\n"
LINE_NUMBERS = r"\A@@ -(\d+),*?(\d*?) \+(\d+),*?(\d*?) @@"
STATES = {
    0: "VALID", 1: "INVALID_TEXT", 2: "INVALID_LINE_NUM",
    3: "INVALID_TEXT_AND_LINE_NUM", 4: "BAD_FORMAT", 5: "BAD_DIFF_HUNK_FORMAT",
    6: "BAD_LINE_NUM_FORMAT", 7: "BAD_HUNK_AND_LINE_FORMAT",
}


def without_notes(text: Column) -> Column:
    """Drop the remark lines about a missing last line break."""
    return F.regexp_replace(text, NO_NEWLINE, "")


def fields(text: Column) -> Column:
    """Struct of name, file, message and diff; null when a mark is missing."""
    name_from = F.lit(len(NAME) + 1)
    file_mark = t.find(text, "\n", name_from)
    file_from = file_mark + len(FILE)
    message_mark = t.find(text, MESSAGE, file_from)
    message_from = message_mark + len(MESSAGE)
    diff_mark = t.find(text, DIFF, message_from)
    whole = (
        F.startswith(text, F.lit(NAME))
        & (file_mark > 0)
        & (F.substr(text, file_mark, F.lit(len(FILE))) == FILE)
        & (message_mark > 0)
        & (diff_mark > 0)
    )
    parts = F.struct(
        F.substr(text, name_from, file_mark - name_from).alias("name"),
        F.substr(text, file_from, message_mark - file_from).alias("file"),
        F.substr(text, message_from, diff_mark - message_from).alias("message"),
        F.substr(text, diff_mark + len(DIFF)).alias("diff"),
    )
    return F.when(whole, parts)


def line_info(info: Column) -> Column:
    """Old start and size, new start and size; null without both starts."""

    def number(group: int, default: str = "") -> Column:
        digits = F.regexp_extract(info, LINE_NUMBERS, group)
        filled = F.coalesce(F.nullif(digits, F.lit("")), F.lit(default)) if default else digits
        return filled.try_cast("long")

    return F.when(info.rlike(LINE_NUMBERS), F.struct(
        number(1).alias("x"), number(2, "1").alias("y"),
        number(3).alias("a"), number(4, "1").alias("b"),
    ))


def _side(body: Column, sign: str) -> Column:
    kept = F.filter(
        t.lines(body),
        lambda line: F.startswith(line, F.lit(sign)) | F.startswith(line, F.lit(" ")),
    )
    return F.transform(kept, lambda line: F.substr(line, F.lit(2)))


def before_lines(body: Column) -> Column:
    return _side(body, "-")


def after_lines(body: Column) -> Column:
    return _side(body, "+")


def has_bad_line(body: Column) -> Column:
    """A line that is not empty and starts with none of blank, plus, minus."""
    return F.exists(
        t.lines(body), lambda line: ~F.left(line, F.lit(1)).isin("", " ", "+", "-")
    )


def hunks(diff: Column) -> Column:
    """Array of ``(info, body)``.

    Text in front of the first header takes the first information place, so
    headers and bodies swap roles from there on, as in the published parser.
    """
    bodies = F.split(diff, HUNK_HEADER, -1)
    headers = F.regexp_extract_all(diff, F.lit(HUNK_HEADER), F.lit(1))
    front = F.get(bodies, F.lit(0))

    def pair(info: Column, body: Column) -> Column:
        return F.struct(info.alias("info"), body.alias("body"))

    count = F.size(headers)
    plain = F.zip_with(headers, F.slice(bodies, F.lit(2), count), pair)
    shifted = F.zip_with(F.slice(bodies, F.lit(1), count), headers, pair)
    return F.when(front == "", plain).otherwise(shifted)


def parsed(diff: Column) -> Column:
    """Hunks as ``(info, before, after, bad)`` with line arrays."""
    return F.transform(hunks(diff), lambda h: F.struct(
        line_info(h["info"]).alias("info"),
        before_lines(h["body"]).alias("before"),
        after_lines(h["body"]).alias("after"),
        has_bad_line(h["body"]).alias("bad"),
    ))


#: Characters in a chunk of a file that is being patched.
CHUNK = 4_096


def _chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def _behind(chunks: Column, place: Column, count: Column) -> Column:
    """Text from ``place`` on, to the end of ``count`` chunks."""
    first = F.floor(place / CHUNK).cast("int") + 1
    return F.substr(F.array_join(F.slice(chunks, first, count), ""), F.pmod(place, F.lit(CHUNK)) + 1)


def _ends_line(text: Column, end: Column) -> Column:
    return (end > F.length(text)) | (F.substr(text, end, F.lit(1)) == "\n")


def _forward(file: Column, found: Column) -> Column:
    """Fold the hunks over the file, always moving forward.

    The file is cut into chunks once. A hunk is looked for in the chunks at the
    cursor, and in everything behind it only if it isn't there; what lies in front
    of the cursor is kept as pieces and joined at the end, so a hunk costs what
    it skips, not the file.
    """
    texts = F.transform(found, lambda h: F.struct(
        F.array_join(h["before"], "\n").alias("before"),
        F.array_join(h["after"], "\n").alias("after"),
    ))
    start = F.struct(
        _chunks(file).alias("chunks"), F.lit(0).alias("place"),
        F.array().cast("array<string>").alias("pieces"), F.lit(True).alias("empty"),
    )

    def rest(state: Column) -> Column:
        return _behind(state["chunks"], state["place"], F.size(state["chunks"]))

    def window(state: Column, before: Column) -> Column:
        """Text behind the cursor that holds the next match and the sign after it, if there is one."""
        near = (F.length(before) / CHUNK).cast("int") + 2
        return t.let(
            _behind(state["chunks"], state["place"], near),
            lambda w: t.let(t.find(w, before), lambda at: F.when(
                (at > 0) & (at + F.length(before) <= F.length(w)), w
            ).otherwise(rest(state))),
        )

    def replaced(state: Column, hunk: Column, w: Column, at: Column) -> Column:
        end = at + F.length(hunk["before"])
        moved = F.struct(
            state["chunks"].alias("chunks"), (state["place"] + end - 1).cast("int").alias("place"),
            F.concat(state["pieces"], F.array(F.left(w, at - 1), hunk["after"])).alias("pieces"),
            (state["empty"] & (at == 1) & (hunk["after"] == "")).alias("empty"),
        )
        return F.when((at > 0) & _ends_line(w, end), moved).otherwise(state)

    def on_top(state: Column, hunk: Column) -> Column:
        # The cursor stops behind the first sign, so later hunks may match the new lines.
        return t.let(F.concat(hunk["after"], F.lit("\n"), rest(state)), lambda text: F.struct(
            _chunks(text).alias("chunks"), F.lit(1).alias("place"),
            F.array(F.left(text, F.lit(1))).alias("pieces"), F.lit(False).alias("empty"),
        ))

    def step(state: Column, hunk: Column) -> Column:
        return (
            F.when((hunk["before"] == "") & ~state["empty"], state)
            .when(hunk["before"] == "", on_top(state, hunk))
            .otherwise(t.let(window(state, hunk["before"]), lambda w: t.let(
                t.find(w, hunk["before"]), lambda at: replaced(state, hunk, w, at))))
        )

    return F.aggregate(texts, start, step, lambda state: F.concat(
        F.array_join(state["pieces"], ""), rest(state)))


def _by_line(file: Column, found: Column) -> Column:
    """Put the hunks at their line numbers.

    Hunks that start behind the one in front and don't overlap it meet lines that
    no hunk has changed, so each is compared by itself with the lines of the old
    file. Other diffs are folded hunk by hunk.
    """
    counted = F.filter(found, lambda h: F.coalesce(F.size(h["before"]) == h["info"]["y"], F.lit(False)))
    starts = F.transform(counted, lambda h: F.struct(
        h["info"]["x"].alias("x"), (h["info"]["x"] + h["info"]["y"]).alias("end"),
        h["before"].alias("before"), h["after"].alias("after"),
    ))
    def in_order(hunks_: Column) -> Column:
        behind = F.slice(hunks_, F.lit(2), F.size(hunks_))
        apart = F.zip_with(hunks_, behind, lambda a, b: F.coalesce(a["end"] <= b["x"], F.lit(True)))
        return F.forall(apart, lambda x: x) & F.forall(hunks_, lambda h: h["x"] > 0)

    return t.let(starts, lambda hunks_: F.when(
        in_order(hunks_), t.let(t.lines(file), lambda lines: _side_by_side(lines, hunks_))
    ).otherwise(_line_fold(file, found)))


def _side_by_side(lines: Column, ordered: Column) -> Column:
    """Old lines between hunks, and each hunk's new lines where its old ones are met."""

    def part(first: Column, end: Column) -> Column:
        # Numbers behind the file mean its end.
        low, high = (F.least(x, F.size(lines) + 1).cast("int") for x in (first, end))
        return F.slice(lines, low, high - low)

    def piece(hunk: Column, index: Column) -> Column:
        front = F.coalesce(F.get(ordered, index - 1)["end"], F.lit(1).cast("long"))
        return t.let(part(hunk["x"], hunk["end"]), lambda seen: F.concat(
            part(front, hunk["x"]),
            F.when(F.forall(
                F.zip_with(hunk["before"], seen, lambda a, b: F.coalesce(a == b, F.lit(True))), lambda x: x
            ), hunk["after"]).otherwise(seen),
        ))

    last = F.coalesce(F.get(ordered, F.size(ordered) - 1)["end"], F.lit(1).cast("long"))
    tail = part(last, F.size(lines) + 1)
    return F.array_join(F.concat(F.flatten(F.transform(ordered, piece)), tail), "\n")


def _line_fold(file: Column, found: Column) -> Column:
    """Fold the hunks over the lines of the file at their line numbers, in any order."""
    start = F.struct(t.lines(file).alias("lines"), F.lit(0).cast("long").alias("offset"))

    def step(state: Column, hunk: Column) -> Column:
        info, before, after = hunk["info"], hunk["before"], hunk["after"]
        lines, at = state["lines"], info["x"] + state["offset"]
        seen = F.slice(lines, F.greatest(at, F.lit(1)).cast("int"), info["y"].cast("int"))
        same = F.forall(
            F.zip_with(before, seen, lambda a, b: F.coalesce(a == b, F.lit(True))),
            lambda x: x,
        )
        fits = F.coalesce(
            (at >= 0) & (F.size(before) == info["y"]) & ((at == 0) | same), F.lit(False)
        )
        spliced = F.concat(
            F.slice(lines, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int")),
            after,
            F.slice(
                lines,
                F.when(at == 0, F.lit(1)).otherwise(at + info["y"]).cast("int"),
                F.size(lines),
            ),
        )
        moved = F.struct(
            spliced.alias("lines"),
            (state["offset"] + F.size(after) - info["y"]).cast("long").alias("offset"),
        )
        return F.when(fits, moved).otherwise(state)

    return F.array_join(F.aggregate(found, start, step, lambda s: s["lines"]), "\n")


def apply_diffs(
    df: DataFrame, file: str, diff: str, into: str, use_line_number: bool = False
) -> DataFrame:
    """Patch ``file`` with ``diff`` as far as its hunks fit.

    A new-file mark is replaced by the first hunk, or by nothing when line
    numbers are asked for.
    """
    found = F.col("__hunks")
    staged = df.withColumn("__hunks", parsed(without_notes(F.col(diff))))
    created = (F.col(file) == NEW_FILE) & (F.size(found) > 0)
    if use_line_number:
        made, patched = F.lit(""), _by_line(F.col(file), found)
    else:
        made = F.array_join(F.get(found, F.lit(0))["after"], "\n")
        patched = _forward(F.col(file), found)
    return staged.withColumn(into, F.when(created, made).otherwise(patched)).drop("__hunks")


def _misplaced(file: Column, before: Column) -> Column:
    """The text is absent, or its first place does not end a line."""
    at = t.find(file, before)
    end = at + F.length(before)
    ends_line = (end > F.length(file)) | (F.substr(file, end, F.lit(1)) == "\n")
    return (at == 0) | ~ends_line


def _line_total(lines: Column) -> Column:
    """Lines of the joined text; no lines still read as one empty line."""
    return F.greatest(F.size(lines), F.lit(1))


def validity(df: DataFrame, text: str, into: str) -> DataFrame:
    """Add the state bits of whole diff documents."""
    parts, found = F.col("__parts"), F.col("__hunks")
    staged = df.withColumn("__parts", fields(without_notes(F.col(text)))).withColumn(
        "__hunks", parsed(parts["diff"])
    )

    def miscounted(h: Column) -> Column:
        info = h["info"]
        sizes = (_line_total(h["before"]) == info["y"]) & (_line_total(h["after"]) == info["b"])
        return (info["x"] <= 0) | ~sizes

    def bit(flag: Column, value: int) -> Column:
        return F.when(flag, F.lit(value)).otherwise(F.lit(0))

    first = F.get(found, F.lit(0))
    info = first["info"]
    created = F.coalesce(
        (F.size(found) == 1)
        & F.startswith(parts["diff"], F.lit("@@ "))
        & ~first["bad"]
        & (info["x"] == 0) & (info["y"] == 0) & (info["a"] == 1)
        & (info["b"] == _line_total(first["after"]))
        & (F.array_join(first["before"], "\n") == ""),
        F.lit(False),
    )
    checked = staged.withColumn(
        "__numbers", F.exists(found, lambda h: h["info"].isNull())
    ).withColumn("__bad", F.exists(found, lambda h: h["bad"]))
    unplaced = F.exists(
        found, lambda h: _misplaced(parts["file"], F.array_join(h["before"], "\n"))
    )
    state = (
        F.when(parts.isNull(), F.lit(4))
        .when(
            (parts["file"] == NEW_FILE) & (F.size(found) > 0),
            F.when(created, F.lit(0)).otherwise(F.lit(6)),
        )
        .when(
            F.col("__numbers") | F.col("__bad"),
            4 + bit(F.col("__bad"), 1) + bit(F.col("__numbers"), 2),
        )
        .otherwise(bit(unplaced, 1) + bit(F.exists(found, miscounted), 2))
    )
    return checked.withColumn(into, state).drop("__parts", "__hunks", "__numbers", "__bad")


def state_name(bits: Column) -> Column:
    table = F.create_map(*[x for n, s in STATES.items() for x in (F.lit(n), F.lit(s))])
    return F.try_element_at(table, bits)


def clip(diff: Column) -> Column:
    """Hunk text up to the first foreign line and the next document mark.

    The set excludes the whole range from plus to at-sign, which is wider than
    the four signs a hunk line may start with.
    """
    kept = F.get(F.split(diff, "\n[^ +-@]+", 2), F.lit(0))
    return t.before(kept, "<NME>")


def carried_diff(generation: Column) -> Column:
    """Clipped diff of a generated document; null when a mark is missing."""
    return clip(fields(generation)["diff"])
