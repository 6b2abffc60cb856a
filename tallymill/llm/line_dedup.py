"""Line dedup by an exact set-similarity join; column functions and joins alone.

A line is its set of words. Sets are ordered rarest word first, so two sets of Jaccard similarity
of at least t share a word within their prefixes of n - ceil(t n) + 1 words. Lines with equal sets
are one class, named by its first line. Prefix words are joined, but for those that all texts use only once; length, position and a parity sketch
of 128 bits, 64 for short lines (its differing bits cannot exceed the words that differ) prune; what is
left is verified on the words themselves. A line goes if an earlier line matches it.

Near copies of one line would match each other in numbers that grow with the square of the group.
So within a prefix word a semi join, which lists no pairs, keeps the lines that may match any other. Each of
them is held against the first of them and the one in front of it. Those that match neither are held against all
lines in front, by a sketch of 1,024 bits before the words.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill.llm.shared import fresh, let, placed, written

#: Word counts are kept in this many buckets of a byte, whatever the corpus; a power of two. Words that
#: share a bucket all look as common as the bucket, so there should be more buckets than words.
BUCKETS = 1 << 23
#: Lines of at most this many words get along with a sketch of 64 bits: at most 17 may differ in two lines
#: of 80 words that match, 32 do in lines that have nothing in common.
SHORT = 80
#: 64-bit words of the filters for lines and prefix words to look at again.
FILTER_WORDS = 1 << 19
PLACE = ["d", "r", "ln"]


def _words(text: str) -> Column:
    """What stands between blanks; two blanks in a row leave an empty word.

    Where space is the only blank, no regular expression is needed.
    """
    others = reduce(lambda a, b: a | b, (F.contains(F.col(text), F.lit(x)) for x in "\t\n\x0b\f\r"))
    return F.when(others, F.split(text, "[ \\t\\n\\x0B\\f\\r]", -1)).otherwise(F.split(text, " ", -1))


def _hashes(line: str) -> Column:
    """A line's distinct words as 64-bit hashes."""
    empty = F.xxhash64(F.lit(""))
    return F.array_remove(F.array_distinct(F.transform(_words(line), lambda w: F.xxhash64(w))), empty)


def lines_of(df: DataFrame, row: str, doc: str, text: str) -> DataFrame:
    """(d, r, ln, line) of all lines. d is the document id, r the row's number."""
    rows = df.select(F.coalesce(F.col(doc).cast("long"), F.lit(-(1 << 63))).alias("d"),
                     F.col(row).alias("r"), F.col(text).cast("string").alias("whole"))
    return rows.select("d", "r", F.posexplode(F.split("whole", "\n", -1)).alias("ln", "line"))


def _dense(values: DataFrame, size: int, default: Column) -> Column:
    """Values (b, v) as an array by b, worked out once and shared by all tasks: `size` entries,
    put together from 1,024 strips, whose gaps between the values that exist are filled."""
    strip = size // 1024
    known = values.groupBy(F.floor(F.col("b") / strip).alias("s")).agg(
        F.sort_array(F.collect_list(F.struct("b", "v"))).alias("x"))
    start = F.col("s") * strip

    def gap(since: Column, until: Column) -> Column:
        return F.array_repeat(default, (until - since).cast("int"))

    def filled(x: Column, i: Column) -> Column:
        since = F.coalesce(F.get("x", i - 1)["b"] + 1, start)
        return F.concat(gap(since, x["b"]), F.array(F.coalesce(x["v"], default)))

    rest = gap(F.coalesce(F.get("x", F.size("x") - 1)["b"] + 1, start), start + strip)
    strips = values.sparkSession.range(1024).withColumnRenamed("id", "s").join(known, "s", "left").select(
        "s", F.concat(F.coalesce(F.flatten(F.transform("x", filled)), F.array_repeat(default, 0)), rest).alias("a"))
    return strips.agg(F.flatten(F.transform(
        F.sort_array(F.collect_list(F.struct("s", "a"))), lambda x: x["a"])).alias("a")).scalar()


def _mark(values: DataFrame, column: str) -> Column:
    """A bit for each 64-bit value of a column, hashed into a filter of fixed size."""
    h = F.xxhash64(column)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    words = values.groupBy(_word(h).alias("b")).agg(F.bit_or(bit).alias("v"))
    return _dense(words, FILTER_WORDS, F.lit(0).cast("long"))


def _word(h: Column) -> Column:
    return F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(FILTER_WORDS - 1))


def _may_hold(filter_: Column, column: str) -> Column:
    h = F.xxhash64(column)
    word = F.get(filter_, _word(h).cast("int"))
    return F.call_function("shiftright", word, h.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1


def _classes(texts: DataFrame, lines: DataFrame, threshold: float) -> DataFrame:
    """One row per set of words: its first place, n, two parity sketches and its prefix."""
    bucket = F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1))
    spaced = texts.select(F.replace("whole", F.lit("\n"), F.lit(" ")).alias("whole"))
    counts = spaced.select(F.explode(_words("whole")).alias("w")).groupBy(bucket.alias("b")).agg(F.count("*").alias("n"))
    # Quarter octaves of a bucket's count: 64 steps from rare to common.
    steps = counts.select("b", F.least(F.lit(63), F.floor(4 * F.log2("n"))).cast("tinyint").alias("v"))
    common = _dense(steps, BUCKETS, F.lit(0).cast("tinyint"))

    def key(h: Column) -> Column:
        step = F.get(F.col("common"), h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")).cast("long")
        step = F.coalesce(step, F.lit(0).cast("long"))  # never null: such arrays are sorted as numbers
        return F.shiftleft(step, 57).bitwiseOR(F.shiftrightunsigned(h, 7))

    def parity(bit) -> Column:
        """Exclusive or of one bit for each word, at one of 64 places."""
        return F.aggregate("k", F.lit(0).cast("long"), lambda a, k: a.bitwiseXOR(F.call_function(
            "shiftleft", bit(k), k.bitwiseAND(F.lit(63)).cast("int"))))

    # One lambda for each word, which is what costs time; keys are made distinct and sorted as plain numbers.
    worded = lines.select(*PLACE, F.array_remove(_words("line"), "").alias("w"), common.alias("common"))
    keys = F.sort_array(F.array_distinct(F.transform("w", lambda w: key(F.xxhash64(w)))))
    keyed = worded.select(*PLACE, keys.alias("k"))
    # One half of the words' bits, and all of them; their difference is the other half. The half of a short
    # line is empty, so both together are the whole for any line.
    n = F.size("k")
    half = F.when(n > SHORT, parity(lambda k: F.shiftrightunsigned(k, 6).bitwiseAND(F.lit(1)))).otherwise(
        F.lit(0).cast("long"))
    whole = parity(lambda k: F.lit(1).cast("long"))
    prefix = F.slice("k", F.lit(1), (n - F.ceil(n * threshold - 1e-9) + 1).cast("int"))
    sized = keyed.select(F.xxhash64("k").alias("id"), F.struct(
        *PLACE, n.alias("n"), whole.alias("b1"), half.alias("b2"), prefix.alias("prefix")).alias("c"))
    # Lines without words are one set; asked before the sets are grouped, their words would be worked out twice.
    return sized.groupBy("id").agg(F.min("c").alias("c")).select("c.*").filter("n > 0").withColumn(
        "b1", F.col("b1").bitwiseXOR(F.col("b2")))


def _entries(classes: DataFrame) -> DataFrame:
    """One row per class and prefix word: t at place i of the class's n words.

    A word whose bucket counts one use in all texts, its step being 0, is in no other line.
    """
    entries = classes.select(*PLACE, "n", "b1", "b2", F.posexplode("prefix").alias("i", "t")).filter(
        F.shiftrightunsigned("t", 57) > 0)
    # Both counts in one number: these rows are most of what is moved. None of the values is null;
    # said so, all uses of these rows have one plan and share one exchange.
    counts = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("i").cast("long"))
    values = {"t": F.col("t"), **{c: F.col(c) for c in PLACE}, "ni": counts, "b1": F.col("b1"), "b2": F.col("b2")}
    return entries.select(*(F.coalesce(v, F.lit(0).cast("int" if c == "ln" else "long")).alias(c) for c, v in values.items()))


def _sized(entries: DataFrame) -> DataFrame:
    """Entries with both counts apart again: n words, and this one's place i."""
    return entries.withColumn("n", F.shiftright("ni", 32)).withColumn("i", F.col("ni").bitwiseAND(F.lit(0xFFFFFFFF)))


def _overlap(x, y, threshold: float) -> Column:
    """Words that two lines must share to match."""
    return F.ceil((x("n") + y("n")) * (threshold / (1 + threshold)) - 1e-9)


def _spare(x, y, threshold: float) -> Column:
    """Words that may be in only one of two lines that match."""
    return x("n") + y("n") - 2 * _overlap(x, y, threshold)


def _near(x, y, threshold: float) -> Column:
    """Length, position and sketch allow that two entries' lines match."""
    rest = F.least(x("i"), y("i")) + F.least(x("n") - x("i"), y("n") - y("i"))
    b1, b2 = x("b1").bitwiseXOR(y("b1")), x("b2").bitwiseXOR(y("b2"))
    differ = F.when(F.least(x("n"), y("n")) > SHORT, F.bit_count(b1) + F.bit_count(b2)).otherwise(
        F.bit_count(b1.bitwiseXOR(b2)))
    return ((F.least(x("n"), y("n")) >= F.greatest(x("n"), y("n")) * threshold - 1e-9)
            & (rest >= _overlap(x, y, threshold)) & (differ <= _spare(x, y, threshold)))


def _earlier(x, y) -> Column:
    return reduce(lambda after, c: (x(c) < y(c)) | ((x(c) == y(c)) & after), reversed(PLACE), F.lit(False))


def _paired(entries: DataFrame, threshold: float) -> DataFrame:
    """The entries that may match any other of their group, each with its rank among them and the places
    of the first (x1) and the one in front of it (x2), where it may match these.

    Words are dealt out once. A semi join, which stops at the first hit, finds these entries; the few that
    are left pass by in order of place, never held as a whole.
    """
    order = Window.partitionBy("t").orderBy(*PLACE)
    fields = [*PLACE, "n", "i", "b1", "b2"]
    own, side = (lambda c: F.col(c)), (lambda s: lambda c: F.col(s)[c])
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    place_of = lambda side: F.struct(*(side(c).alias(c) for c in PLACE))
    dealt = _sized(entries.repartition("t"))
    other = reduce(lambda p, q: p | q, (a(c) != b(c) for c in PLACE))
    paired = dealt.alias("a").join(dealt.alias("b"), (a("t") == b("t")) & other & _near(b, a, threshold), "left_semi")
    ranked = paired.withColumn("rank", F.row_number().over(order)).withColumn("first", F.first(F.struct(*fields)).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn(
        "last", F.lag(F.struct(*fields)).over(order))
    x1 = F.when((F.col("rank") > 1) & _near(side("first"), own, threshold), place_of(side("first")))
    x2 = F.when((F.col("rank") > 2) & _near(side("last"), own, threshold), place_of(side("last")))
    return ranked.select("t", *PLACE, "ni", "b1", "b2", "rank", x1.alias("x1"), x2.alias("x2"))


def _candidates(paired: DataFrame) -> DataFrame:
    """Pairs (y, x) of places that may match, at most two for a line and word, and as (y, null) lines that
    may match one further in front: those behind the third of a word that may match neither of both."""
    return paired.filter("x1 IS NOT NULL OR x2 IS NOT NULL OR rank > 3").select(
        F.struct(*PLACE).alias("y"), F.explode(F.array("x1", "x2")).alias("x")).distinct()


def _texts_at(places: DataFrame, lines: DataFrame) -> DataFrame:
    """(place, line) of the lines at some places."""
    texts = lines.select(F.struct(*PLACE).alias("place"), "line").filter(_may_hold(_mark(places, "place"), "place"))
    return written(texts.join(places.distinct(), "place", "left_semi"), "line-texts")


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The lines (y) of pairs of places whose words are as similar as asked."""
    y, x = (texts.select(F.col("place").alias(s), F.col("line").alias(f"{s}_line")) for s in ("y", "x"))
    words = F.struct(*(F.array_remove(F.array_distinct(_words(f"{s}_line")), "").alias(s) for s in ("y", "x")))

    def similar(words: Column) -> Column:
        return let(F.size(F.array_intersect(words["y"], words["x"])), lambda common: common >= threshold * (
            F.size(words["y"]) + F.size(words["x"]) - common) - 1e-9)

    # Bound by `let`, both lines are split once, however often the condition names their words.
    return pairs.join(y, "y").join(x, "x").filter(let(words, similar)).select("y").distinct()


def _sketches(texts: DataFrame) -> DataFrame:
    """(place, s) of the lines with words: a parity sketch of the words, by their hashes, in 1,024 bits."""
    none, h = F.lit(0).cast("long"), F.col("h")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    part = F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(15))
    own = texts.select("place", F.explode(_hashes("line")).alias("h")).groupBy("place").agg(
        *(F.bit_xor(F.when(part == j, bit).otherwise(none)).alias(f"s{j}") for j in range(16)))
    return own.select("place", F.array(*(f"s{j}" for j in range(16))).alias("s"))


def _further(again: DataFrame, paired: DataFrame, lines: DataFrame, threshold: float) -> DataFrame:
    """Those of some lines (y) that match any earlier line.

    The earlier lines that any of them may match come from a semi join, without pairs. Both sides then
    get a sketch of 1,024 bits, which leaves hardly more pairs than matches to be verified.
    """
    place, a, b = F.struct(*PLACE), (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    entries = paired.select("t", *PLACE, "ni", "b1", "b2", "rank")
    own = entries.filter("rank > 1").withColumn("y", place).filter(_may_hold(_mark(again, "y"), "y"))
    asked = written(own.join(again, "y", "left_semi").drop("y", "rank"), "line-asked")
    known = entries.drop("rank").filter(_may_hold(_mark(asked, "t"), "t"))
    meet = (a("t") == b("t")) & _earlier(b, a) & _near(b, a, threshold)
    met = written(_sized(known).alias("b").join(_sized(asked).alias("a"), meet, "left_semi").select("b.*"), "line-known")
    texts = _texts_at(again.select(F.col("y").alias("place")).unionByName(met.select(place.alias("place"))), lines)
    sketches = written(_sketches(texts), "line-sketches")
    sketched = lambda entries: entries.withColumn("place", place).join(sketches, "place")
    differ = F.aggregate(F.zip_with(a("s"), b("s"), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda x, v: x + v)
    pairs = sketched(_sized(asked)).alias("a").join(
        sketched(met).alias("b"), meet & (differ <= _spare(a, b, threshold))).select(
        a("place").alias("y"), b("place").alias("x")).distinct()
    return _verified(pairs, texts, threshold)


def kept_lines(df: DataFrame, row: str, doc: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """(d, r, ln) of the lines with words that stay: no earlier line matches them.

    Earlier is by document id (null first), then the row's number, then the line's place. Every
    earlier line counts, whether it stays or goes. `row` holds the numbers, which must be the same
    in every job (`shared.placed`).
    """
    lines = lines_of(df, row, doc, text)
    texts = df.select(F.col(text).cast("string").alias("whole"))
    # In order of place, neighbours' places are alike, which makes the rows that are dealt out compress better.
    classes = written(_classes(texts, lines, threshold).sortWithinPartitions(*PLACE), "line-classes")
    paired = written(_paired(_entries(classes), threshold), "line-paired")
    candidates = written(_candidates(paired), "line-candidates")
    pairs = candidates.filter("x IS NOT NULL")
    texts = _texts_at(pairs.select(F.explode(F.array("y", "x")).alias("place")), lines)
    met = written(_verified(pairs, texts, threshold), "line-matched")
    # Lines that match neither a word's first line nor the one in front: now against all in front.
    again = written(candidates.select("y").distinct().join(met, "y", "left_anti"), "line-again")
    matched = met.unionByName(_further(again, paired, lines, threshold))
    place = F.struct(*PLACE)
    return classes.select(*PLACE, place.alias("y")).join(matched, "y", "left_anti").select(*PLACE)


def line_report(df: DataFrame, doc: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row per row of `df`: doc_id, n_lines (with a word), n_kept, kept_lines.

    kept_lines are the places of the lines that stay, from 0, joined by commas. Texts that are null
    or without words have no lines; a null id sorts first; repeated rows are documents of their own,
    of which the later loses its lines; an empty table gives no rows; other columns play no part.
    """
    (row,) = fresh(df, "row")
    named = placed(df, row)
    kept = kept_lines(named, row, doc, text, threshold).groupBy("r").agg(
        F.sort_array(F.collect_list("ln")).alias("kept"))
    worded = F.filter(F.split(F.col(text).cast("string"), "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    rows = named.select(F.col(doc).alias("doc_id"), F.col(row).alias("r"),
                     F.coalesce(F.size(worded), F.lit(0)).cast("long").alias("n_lines"))
    return rows.join(kept, "r", "left").select(
        "doc_id", "n_lines", F.coalesce(F.size("kept"), F.lit(0)).cast("long").alias("n_kept"),
        F.coalesce(F.array_join("kept", ","), F.lit("")).alias("kept_lines"))


def without_later_matches(df: DataFrame, doc: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """`df` with only the lines that stay, and those without words, in each text.

    Null texts stay null. All other columns are left as they are, whatever their names.
    """
    row, places = fresh(df, "row", "kept")
    named = placed(df, row)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("ln") % 64).cast("int"))
    words = kept_lines(named, row, doc, text, threshold).groupBy("r", F.floor(F.col("ln") / 64).cast("int").alias("w")).agg(
        F.bit_or(bit).alias("bits"))
    kept = words.groupBy("r").agg(F.sort_array(F.collect_list(F.struct("w", "bits"))).alias("kept"))
    rows = named.join(
        kept.select(F.col("r").alias(row), F.col("kept").alias(places)), row, "left")

    def dense(known: Column) -> Column:
        """The bits of 64 lines at a time, without gaps."""
        return F.transform(F.sequence(F.lit(0), F.element_at(known, -1)["w"]), lambda w: F.coalesce(
            F.get(F.filter(known, lambda x: x["w"] == w), F.lit(0))["bits"], F.lit(0).cast("long")))

    def staying(bits: Column) -> Column:
        def stays(line: Column, i: Column) -> Column:
            own = F.call_function("shiftright", F.get(bits, F.floor(i / 64).cast("int")), i % 64)
            return ~line.rlike("[^\\x20\\x09-\\x0D]") | F.coalesce(own.bitwiseAND(F.lit(1)) == 1, F.lit(False))

        return F.filter(F.split(text, "\n", -1), stays)

    stays = let(dense(F.col(places)), staying)
    return rows.withColumn(text, F.array_join(stays, "\n")).select(*df.columns)
