"""Fixed-length blocks, token budgets, training pairs and label arrays."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymill import fixed
from tallymill.functions import prompts
from tallymill.functions import text as t
from tallymill.functions import tokens as tok
from tallymill.operators.numbering import number_rows, number_sorted
from tallymill.operators.staging import staged


def pack_blocks(
    df: DataFrame,
    key: str,
    ids: Column,
    *,
    seq_length: int,
    end_id: int,
    batch_rows: int = 1000,
    ranges: int | None = None,
) -> DataFrame:
    """Cut batches of consecutive rows into blocks of token ids.

    A batch joins the ids of its rows, each followed by the end id. A block is
    kept only if it ends before the batch does, so the tail and an exactly full
    last block are dropped.

    Only keys and ids travel, to their place in the order and then to their
    batch: it has at most ``batch_rows`` rows, offsets and blocks are worked out
    where it lies, and whole slices of ids are moved instead of single tokens.
    """
    ended = F.concat(ids, F.array(F.lit(end_id).cast("int"))).alias("ids")
    numbered = number_rows(df.select(key, ended), key, into="__row", ranges=ranges)
    rows = numbered.select(
        F.floor((F.col("__row") - 1) / batch_rows).cast("long").alias("batch"), "__row", "ids"
    )
    front = (
        Window.partitionBy("batch").orderBy("__row")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    size = F.size("ids").cast("long")
    placed = rows.withColumn(
        "begin", F.coalesce(F.sum(size).over(front), F.lit(0))
    ).withColumn(
        "total", F.sum(size).over(Window.partitionBy("batch"))
    )
    last = F.col("begin") + size - 1
    first_block = F.floor(F.col("begin") / seq_length).cast("long")
    pieces = placed.select(
        "batch", "begin", "total", "ids",
        F.explode(F.sequence(first_block, F.floor(last / seq_length).cast("long")))
        .alias("block"),
    ).where((F.col("block") + 1) * seq_length < F.col("total"))
    # 1-based start of the slice inside this row's ids.
    start = F.greatest(F.col("block") * seq_length - F.col("begin"), F.lit(0)) + 1
    stop = F.least((F.col("block") + 1) * seq_length - F.col("begin"), size)
    sliced = pieces.select(
        "batch", "block",
        F.struct(
            F.col("begin"),
            F.slice("ids", start.cast("int"), (stop - start + 1).cast("int")).alias("ids"),
        ).alias("piece"),
    )
    blocks = sliced.groupBy("batch", "block").agg(
        F.array_sort(F.collect_list("piece")).alias("pieces")
    )
    return blocks.select(
        "batch", "block", F.flatten("pieces.ids").alias("input_ids")
    ).withColumn("labels", F.col("input_ids"))


def solution_pairs(df: DataFrame, key: str) -> DataFrame:
    """One row per solution: question, starter, solution and answer type.

    Rows whose ``solutions`` is not a JSON array of texts are skipped.
    """
    listed = F.from_json("solutions", "array<string>")
    answer_type = F.concat(prompts.call_format(F.col("input_output")), F.lit("\n"))
    return df.where(listed.isNotNull()).select(
        key, "question", F.coalesce("starter_code", F.lit("")).alias("starter_code"),
        answer_type.alias("answer_type"), F.posexplode(listed).alias("pos", "solution"),
    )


def pair_prompt(pairs: DataFrame) -> Column:
    return F.concat(
        F.lit(fixed.QUESTION_MARK), F.col("question"), F.lit("\n"), F.col("starter_code"),
        F.lit("\n"), F.col("answer_type"), F.lit(fixed.ANSWER_MARK),
    )


def short_pairs(pairs: DataFrame, max_tokens: int) -> DataFrame:
    """Pairs whose prompt has fewer than ``max_tokens`` tokens."""
    return pairs.where(F.size(tok.words(pair_prompt(pairs))) < max_tokens)


def pairs_per_question(pairs: DataFrame, key: str) -> DataFrame:
    """Pairs grouped by question text, as sizes; the rows stay in ``pairs``.

    The question is hashed for the shuffle, and its groups are pre-aggregated,
    so a question with a third of all pairs costs one partial row per task.
    """
    return pairs.groupBy(F.md5(F.col("question").cast("binary")).alias("question_md5")).agg(
        F.count(F.lit(1)).alias("pairs"), F.min(key).alias("first_problem"),
        F.sum(F.length("solution")).alias("solution_chars"),
    )


#: Leading hex digits of the order: 4,096 ranges in each shard.
ORDER_DIGITS = 3


def pack_budget(
    df: DataFrame, key: str, text: Column, *, budget: int, shards: int
) -> DataFrame:
    """Fill packs up to a token budget from a repeatable shuffle of the rows.

    Rows are put in md5 order inside md5 shards; a row opens the pack that its
    tokens in front have reached. The order's first digits cut each shard into
    even ranges, which are summed by themselves and shifted by the ranges in
    front, so no task holds a shard.
    """
    order = F.md5(F.col(key).cast("string").cast("binary"))
    mixed = df.select(
        key, order.alias("__order"), F.left(order, F.lit(ORDER_DIGITS)).alias("__range"),
        t.hash_bucket(F.col(key), shards).alias("shard"),
        F.size(tok.words(text)).cast("long").alias("n_tokens"),
    )
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    totals = mixed.groupBy("shard", "__range").agg(F.sum("n_tokens").alias("__total"))
    ranges = totals.select("shard", "__range", F.coalesce(F.sum("__total").over(
        before.partitionBy("shard").orderBy("__range")), F.lit(0)).alias("__ahead"))
    inside = F.coalesce(F.sum("n_tokens").over(
        before.partitionBy("shard", "__range").orderBy("__order")), F.lit(0))
    placed = mixed.withColumn("__inside", inside).join(ranges, ["shard", "__range"])
    ahead = F.col("__inside") + F.col("__ahead")
    return placed.select(
        key, "shard", "n_tokens", F.floor(ahead / budget).cast("long").alias("pack_id")
    )


#: Hex digits of a draw's hash: 60 bits, so ranks are even for any number of rows.
DRAW_DIGITS = 15


def pack_draws(
    df: DataFrame, key: str, tokens: Column, *, budget: int, seed: int = 0
) -> DataFrame:
    """One pack per row: the row itself, then rows drawn with replacement until the budget is met.

    Gives ``(pack, place, key, n_tokens)``; the row that reaches the budget is the
    last of its pack. ``pack`` is the key of the row that opens it, at place 0. Draw
    d of a pack is the row at rank md5(seed:pack:d) modulo the rows, in key order, so
    any cluster draws the same. Rows without tokens (or a null text) open packs but are not
    drawn, since they fill none; without any row to draw, packs hold their own rows.
    Keys must be unique.

    Draws meet the numbered rows in a join on the rank. A round draws for the packs
    still open as many rows as the mean row asks for, and each round twice as many
    as the one in front, so rounds are few whatever the sizes.
    """
    sized = staged(df.select(
        F.col(key).alias("key"), F.coalesce(tokens, F.lit(0)).cast("long").alias("n_tokens")), "sized")
    drawable = sized.where("n_tokens > 0")
    rows, total = drawable.agg(F.count(F.lit(1)), F.sum("n_tokens")).first()
    made = sized.select(
        F.col("key").alias("pack"), F.lit(0).cast("long").alias("place"), "key", "n_tokens")
    rounds = [made]
    open_packs = made.where(F.col("n_tokens") < budget).select(
        "pack", F.lit(1).cast("long").alias("next"), F.col("n_tokens").alias("filled"))
    ranked = number_sorted(drawable, ["key"], into="rank") if rows else None
    draws = -(-budget * rows // total) if rows else 0
    while rows and not open_packs.isEmpty():
        drawn = _drawn(open_packs, ranked, rows, draws, seed)
        held = staged(drawn.where(F.col("ahead") < budget), "draws")
        rounds.append(held.select(*made.columns))
        open_packs = held.groupBy("pack").agg(
            (F.max("place") + 1).alias("next"), F.max(F.col("ahead") + F.col("n_tokens")).alias("filled")
        ).where(F.col("filled") < budget)
        draws *= 2
    packs = reduce(DataFrame.unionByName, rounds)
    return packs.select("pack", "place", F.col("key").alias(key), "n_tokens")


def _drawn(packs: DataFrame, ranked: DataFrame, rows: int, draws: int, seed: int) -> DataFrame:
    """The next ``draws`` rows of each pack, with the tokens in front of each."""
    places = F.sequence(F.col("next"), F.col("next") + draws - 1)
    asked = packs.select("pack", "filled", F.explode(places).alias("place"))
    mark = F.concat_ws(":", F.lit(str(seed)), F.col("pack").cast("string"), F.col("place").cast("string"))
    number = F.conv(F.left(F.md5(mark.cast("binary")), F.lit(DRAW_DIGITS)), 16, 10).cast("long")
    met = asked.withColumn("rank", F.pmod(number, F.lit(rows).cast("long"))).join(ranked, "rank")
    front = Window.partitionBy("pack").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return met.withColumn(
        "ahead", F.col("filled") + F.coalesce(F.sum("n_tokens").over(front), F.lit(0))
    ).select("pack", "place", "key", "n_tokens", "ahead")


def masked_labels(question: Column, answer: Column, end_id: int, max_tokens: int) -> Column:
    """Input ids and labels; question positions are ignored by the loss."""
    end = F.array(F.lit(end_id).cast("int"))
    ids = F.concat(question, answer, end)
    labels = F.concat(
        F.array_repeat(F.lit(fixed.IGNORED_LABEL), F.size(question)), answer, end
    )
    return F.struct(
        F.slice(ids, 1, max_tokens).alias("input_ids"),
        F.slice(labels, 1, max_tokens).alias("labels"),
    )


def truncated(ids: Column, max_length: int) -> Column:
    return F.slice(ids, 1, max_length)


def attention(ids: Column, max_length: int) -> Column:
    """Ones for real positions, zeros for padding."""
    size = F.least(F.size(ids), F.lit(max_length))
    return F.concat(F.array_repeat(F.lit(1), size), F.array_repeat(F.lit(0), max_length - size))


def padded(ids: Column, max_length: int, pad_id: int = 0) -> Column:
    kept = truncated(ids, max_length)
    return F.concat(
        kept, F.array_repeat(F.lit(pad_id).cast("int"), max_length - F.size(kept))
    )


def ignore_padding(labels: Column, real: Column) -> Column:
    """Positions from ``real`` on are padding, whatever id they hold."""
    return F.transform(
        labels, lambda x, i: F.when(i >= real, F.lit(fixed.IGNORED_LABEL)).otherwise(x)
    )


def pair_encoding(first: Column, second: Column, separator: Column, max_length: int) -> Column:
    """Two texts joined by separators, the longer one shortened first."""
    a, b = F.size(first), F.size(second)
    room = F.lit(max_length) - F.size(separator)
    half = F.floor(room / 2).cast("int")
    # Longest first: a short side keeps everything, long sides share the room.
    keep_a = (
        F.when(a + b <= room, a).when(b <= half, room - b)
        .when(a <= room - half, a).otherwise(room - half)
    )
    keep_b = F.least(b, room - keep_a)
    return F.concat(F.slice(first, 1, keep_a), separator, F.slice(second, 1, keep_b))


def without_docstring(code: Column, mark: str = '"""') -> Column:
    """Text in front of a docstring (stripped) joined with the text behind it."""
    chunks = F.split(code, t.quoted(mark), -1)
    return F.concat(t.strip(F.get(chunks, F.lit(0))), F.get(chunks, F.lit(2)))


def numbered_names(names: DataFrame, name: str, into: str, first: int = 0) -> DataFrame:
    """Number distinct names in sorted order, from ``first`` on."""
    return number_sorted(names, [name], into=into, first=first)


def encode_labels(df: DataFrame, label: str, into: str) -> DataFrame:
    """Number class names in sorted order.

    Only the distinct class names are ranked; the rows meet them in a join that
    Spark turns into a broadcast when the names are few.
    """
    names = df.select(label).where(F.col(label).isNotNull()).distinct()
    ranked = numbered_names(names, label, into)
    return df.join(ranked.withColumn(into, F.col(into).cast("int")), label, "left")


def replicate(df: DataFrame, copies: int) -> DataFrame:
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))


def copies_needed(n_samples: int, batch: int, problems: int, devices: int) -> int:
    """Copies of each problem so that every device has equal work."""
    copies = -(-n_samples // batch)
    return 2 if copies == 1 and problems % devices != 0 else copies
