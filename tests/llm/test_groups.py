"""SimHash groups, line dedup, quality rules, URL rules, top-k search and components against brute force."""

from __future__ import annotations

import itertools
import math
import random
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallymill.llm import components, knn, line_dedup, quality, shared, simhash, url_rules


def roots_of(nodes, links):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(200, 200), (7, 7), (300, 301), (301, 300)]
    df = spark.createDataFrame(links, "u long, v long")
    got = {r.node: r.root for r in components.components(df).collect()}
    nodes = {x for a, b in links for x in (a, b) if a != b}
    assert got == roots_of(nodes, [x for x in links if x[0] != x[1]])
    assert components.components(df.limit(0)).collect() == []


def test_every_near_pair_has_a_chain():
    """Any three flipped bits leave a key whole whose chain stays within its budgets."""
    draw = random.Random(3)
    for _ in range(4_000):
        x = 0
        for bit in draw.sample(range(64), draw.randint(1, 3)):
            x |= 1 << bit
        assert any(not x & mask and all((x & m).bit_count() <= n for m, n in simhash.runs(start, 3))
                   for start, mask in simhash.keys())


def test_links_are_all_found_once(spark):
    draw = random.Random(5)
    base = [draw.getrandbits(64) for _ in range(30)]
    fps = {x ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 4))) for x in base for _ in range(12)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = [(r.u, r.v) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()]
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}
    assert len(got) == len(set(got)) and set(got) == want


def test_spanning_links_have_the_components_of_all_links(spark):
    draw = random.Random(8)
    base = [draw.getrandbits(64) for _ in range(25)]
    fps = {x ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 5))) for x in base for _ in range(20)}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    for most in (3, 2, 0):
        want = [(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= most]
        got = [(r.u, r.v) for r in simhash.spanning_links(nodes, most).collect()]
        assert set(got) <= set(want) and roots_of(signed, got) == roots_of(signed, want)


def test_near_copies_of_one_text_are_not_paired_with_each_other(spark):
    """A fingerprint and all that differ from it in a bit (two bits): their pairs share bits, but go through few."""
    centre = 0x5A5A5A5A5A5A5A5A
    one = [centre] + [centre ^ 1 << i for i in range(63)]
    two = one + [centre ^ 1 << i ^ 1 << j for i in range(63) for j in range(i)]
    for signed, share in ((one, 0.4), (two, 0.2)):
        nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
        got = {(r.u, r.v) for r in simhash.spanning_links(nodes).collect()}
        assert set(roots_of(signed, got).values()) == {min(signed)}
        pairs = sum((a ^ b).bit_count() <= 3 for a, b in itertools.combinations(signed, 2))
        assert len(got) <= share * pairs, (len(got), pairs)


def test_groups_are_met_in_parts(spark):
    rows = spark.range(500).selectExpr("IF(id < 400, 0, id) AS g", "1000 - id AS x").unionByName(
        spark.createDataFrame([(7_000, None)], "g long, x long"))
    got = {(r.g, r.x): (r.least, r.members) for r in components.with_least(rows, ["g"], "x").collect()}
    assert len(got) == 501 and got[0, 1000] == (601, 400) and got[450, 550] == (550, 1) and got[7_000, None] == (None, 1)
    one = spark.createDataFrame([(0, "a"), (450, "b"), (9, "c")], "g long, name string")
    met = components.spread_join(rows, one, ["g"], "x").groupBy("name").count().collect()
    assert {r.name: r["count"] for r in met} == {"a": 400, "b": 1}


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates_of_awkward_rows(awkward, rows):
    got = simhash.near_duplicates(awkward).collect()
    fps = [(d, plain_fingerprint(t)) for d, t, _ in rows]
    groups = roots_of(range(len(fps)), [(i, j) for i in range(len(fps)) for j in range(i)
                                        if (fps[i][1] ^ fps[j][1]).bit_count() <= 3])
    least = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            least[groups[i]] = min(d, least.get(groups[i], d))
    want = Counter((d, f"{fp:016x}", least.get(groups[i])) for i, (d, fp) in enumerate(fps))
    assert Counter(tuple(r) for r in got) == want
    assert simhash.near_duplicates(awkward.limit(0)).collect() == []


def plain_kept(rows, threshold=0.8):
    """Line places that stay, per row in order of id (null first) and place."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, i))
    seen, kept = [], {}
    for i in order:
        kept[i] = []
        for at, line in enumerate((rows[i][1] or "").split("\n")):
            words = frozenset(line.encode().split())
            if words:
                if not any(len(words & x) >= threshold * len(words | x) - 1e-9 for x in seen):
                    kept[i].append(at)
                seen.append(words)
    return kept


def test_line_dedup_of_awkward_rows(awkward_written, rows):
    got = line_dedup.line_report(awkward_written).collect()
    kept = plain_kept(rows)
    want = Counter((d, sum(bool(x.encode().split()) for x in (t or "").split("\n")), len(kept[i]),
                    ",".join(map(str, kept[i]))) for i, (d, t, _) in enumerate(rows))
    assert Counter(tuple(r) for r in got) == want
    assert line_dedup.line_report(awkward_written.limit(0)).collect() == []


def test_line_dedup_of_a_large_group_of_near_copies(spark, tmp_path):
    """Variants of two lines, so that the first of a group doesn't match all of it."""
    draw = random.Random(11)
    base = [[f"w{draw.randint(0, 60)}" for _ in range(20)] for _ in range(6)]
    rows = []
    for i in range(150):
        lines = []
        for words in draw.sample(base, 3):
            own = list(words)
            for _ in range(draw.randint(0, 4)):
                own[draw.randrange(len(own))] = f"w{draw.randint(0, 400)}"
            lines.append(" ".join(own))
        rows.append((i, "\n".join([*lines, "", "short"]), None))
    path = str(tmp_path / "d")
    spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    got = {r.doc_id: r.kept_lines for r in line_dedup.line_report(df).collect()}
    kept = plain_kept(rows)
    assert got == {i: ",".join(map(str, kept[i])) for i in range(len(rows))}
    texts = {r.doc_id: r.text for r in line_dedup.without_later_matches(df).collect()}
    for i, (_, text, _) in enumerate(rows):
        assert texts[i] == "\n".join(x for at, x in enumerate(text.split("\n")) if at in kept[i] or not x)


def test_near_copies_behind_an_unlike_line_are_not_paired_with_each_other(spark, tmp_path, monkeypatch):
    """The first line of each word's group matches none of the copies of another line."""
    base, often = [f"w{i}" for i in range(20)], [f"c{i}" for i in range(10)]
    rows = [(0, " ".join(base[:10] + often), None), (1, " ".join(base[10:] + often), None)]
    for i in range(2, 300):
        words = list(base)
        words[i % 20] = f"u{i}"
        rows.append((i, " ".join(words), None))
    rows.append((300, " ".join(often * 2_000), None))
    path, made, write = str(tmp_path / "d"), [], line_dedup.written
    spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").coalesce(1).write.parquet(path)

    def counted(df, name, *more):
        out = write(df, name, *more)
        if name == "line-candidates":
            made.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "written", counted)
    got = {r.doc_id: r.kept_lines for r in line_dedup.line_report(spark.read.parquet(path)).collect()}
    kept = plain_kept(rows)
    assert got == {i: ",".join(map(str, kept[i])) for i in range(len(rows))}
    assert sum(made) < 10 * len(rows)


def test_words_that_are_used_once_are_not_dealt_out(spark, tmp_path):
    """Lines of own words and two common ones: only the common words may be met in another line."""
    rows = [(i, " ".join([*(f"own{i}x{k}" for k in range(30)), "a", "b"]), None) for i in range(200)]
    path = str(tmp_path / "d")
    spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").coalesce(1).write.parquet(path)
    named = shared.placed(spark.read.parquet(path), "row")
    classes = line_dedup._classes(named.select(F.col("text").alias("whole")),
                                  line_dedup.lines_of(named, "row", "doc_id", "text"), 0.8)
    assert classes.count() == 200
    assert line_dedup._entries(classes).count() < 20  # 1,400 prefix words, a few of which share a bucket


def test_words_of_a_line_are_worked_out_once(spark, tmp_path, capsys):
    """A filter on a line's keys would be pushed below them and split, hash and sort its words again."""
    path = str(tmp_path / "d")
    spark.createDataFrame([(1, "a b\n\nc d")], "doc_id long, text string").coalesce(1).write.parquet(path)
    named = shared.placed(spark.read.parquet(path), "row")
    classes = line_dedup._classes(named.select(F.col("text").alias("whole")),
                                  line_dedup.lines_of(named, "row", "doc_id", "text"), 0.8)
    assert classes.count() == 2
    capsys.readouterr()
    classes.explain("simple")
    filters = [x for x in capsys.readouterr().out.split("\n") if "Filter" in x]
    assert filters and not any("lambda" in x for x in filters)


def test_only_entries_that_may_match_another_are_put_in_order(spark, tmp_path):
    """Lines that share a rare word, but little else, and two that match."""
    rows = [(i, " ".join([f"g{i % 4}", *(f"u{i % 99}x{k}" for k in range(9))])) for i in range(100)]
    path = str(tmp_path / "d")
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(path)
    named = shared.placed(spark.read.parquet(path), "row")
    classes = line_dedup._classes(named.select(F.col("text").alias("whole")),
                                  line_dedup.lines_of(named, "row", "doc_id", "text"), 0.8)
    paired = line_dedup._paired(line_dedup._entries(classes), 0.8).collect()
    assert {r.d for r in paired} == {0, 99}
    assert all((r["rank"], r.x1 and r.x1.d) in ((1, None), (2, 0)) for r in paired)


def test_lines_with_any_blanks_have_the_same_words(spark, tmp_path):
    """Lines with spaces alone are split another way than lines with other blanks."""
    words = [f"w{i}" for i in range(9)]
    odd = ["\t", "\x0b", "\x0c", "\r", "  ", " \t ", "\u00a0", "\u2003", "\x85", "\x1c", "|"]
    rows = [(0, " ".join(words), None)] + [(i + 1, x + x.join([*words[:8], f"v{i}"]) + x, None) for i, x in enumerate(odd)]
    path = str(tmp_path / "d")
    spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").coalesce(1).write.parquet(path)
    got = {r.doc_id: r.kept_lines for r in line_dedup.line_report(spark.read.parquet(path)).collect()}
    kept = plain_kept(rows)
    assert got == {i: ",".join(map(str, kept[i])) for i in range(len(rows))}
    assert [i for i in got if not got[i]] == [1, 2, 3, 4, 5, 6]


def test_short_and_long_lines_are_compared_by_sketches_of_their_own(spark, tmp_path):
    """Pairs on both sides of the length from which sketches have 128 bits, in either order."""
    draw, rows = random.Random(17), []
    for i in range(160):
        words = [f"s{i % 40}w{k}" for k in range(line_dedup.SHORT + draw.randint(-6, 6))]
        for _ in range(draw.randint(0, 7)):
            words[draw.randrange(len(words))] = f"d{draw.randint(0, 99)}"
        rows.append((i, " ".join(words), None))
    path = str(tmp_path / "d")
    spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").coalesce(1).write.parquet(path)
    got = {r.doc_id: r.kept_lines for r in line_dedup.line_report(spark.read.parquet(path)).collect()}
    kept = plain_kept(rows)
    assert got == {i: ",".join(map(str, kept[i])) for i in range(len(rows))}
    assert 40 < sum(bool(x) for x in got.values()) < 160


def test_values_with_gaps_become_an_array_without(spark):
    at = {0: 5, 1: 6, 1_023: 7, 5_000: 8, 8_190: 9}
    values = spark.createDataFrame(list(at.items()), "b long, v long")
    array = spark.range(1).select(line_dedup._dense(values, 8_192, F.lit(0).cast("long")).alias("a")).first().a
    assert array == [at.get(i, 0) for i in range(8_192)]
    array = spark.range(1).select(line_dedup._dense(values.limit(0), 8_192, F.lit(3).cast("long")).alias("a")).first().a
    assert array == [3] * 8_192


@pytest.fixture()
def other_splits(spark, monkeypatch):
    """After each write, scans are split another way, as when executors come or go."""
    name, splits = "spark.sql.files.minPartitionNum", itertools.cycle(["64", "1"])
    spark.conf.set(name, "1")

    def then(write):
        def run(*args, **more):
            out = write(*args, **more)
            spark.conf.set(name, next(splits))
            return out

        return run

    for module in (line_dedup, simhash, shared):
        monkeypatch.setattr(module, "written", then(module.written))
    yield
    spark.conf.unset(name)


def test_rows_keep_their_names_when_scans_are_split_another_way(spark, tmp_path, other_splits):
    draw = random.Random(13)
    lines = [" ".join(f"w{draw.randint(0, 400)}" for _ in range(10)) for _ in range(60)]
    rows = [(i, "\n".join(draw.sample(lines, draw.randint(1, 4))), None) for i in range(80)]
    path = str(tmp_path / "d é%20")
    for part in range(8):  # files of unlike sizes; a later file may be read first
        some = [r[:2] for r in rows if r[0] % 36 >= part * part // 2 and r[0] % 36 < (part + 1) ** 2 // 2 or part == 7 and r[0] % 36 >= 32]
        spark.createDataFrame(some, "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
    df = spark.read.parquet(path)
    assert sorted(r.doc_id for r in df.collect()) == list(range(80))
    kept = plain_kept(rows)
    want = [(i, ",".join(map(str, kept[i]))) for i in range(80)]
    assert sorted((r.doc_id, r.kept_lines) for r in line_dedup.line_report(df).collect()) == want
    texts = {r.doc_id: r.text for r in line_dedup.without_later_matches(df).collect()}
    assert texts == {i: "\n".join(x for at, x in enumerate(t.split("\n")) if at in kept[i]) for i, t, _ in rows}

    fps = [plain_fingerprint(t) for _, t, _ in rows]
    groups = roots_of(range(80), [(i, j) for i in range(80) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    single = corpus_pipeline.near_dedup(spark, df, path).collect()
    assert sorted(r.doc_id for r in single) == sorted(set(groups.values()))


def test_rows_of_other_frames_are_written_with_their_names(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.range(5).write.parquet(path)
    for df in (spark.range(5).toDF("id"), spark.read.parquet(path).limit(5), spark.read.parquet(path, path)):
        named = shared.placed(df, "row")
        rows = sorted(tuple(r) for r in named.collect())
        assert len({r for _, r in rows}) == len(rows) == df.count()
        assert sorted(tuple(r) for r in named.collect()) == rows


def plain_counts(text):
    words = (text or "").encode().split()
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return (len(words), sum(len(w.decode()) for w in words), sum((text or "").count(c) for c in "#*$%&|<>"),
            len(lines) - len(set(lines)), len(covered))


def test_a_text_of_very_many_lines_is_rebuilt_in_time(spark):
    df = spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), F.concat(
        F.array_join(F.transform(F.sequence(F.lit(1), F.lit(200_000)), lambda i: F.concat(i.cast("string"), F.lit(" a"))), "\n"),
        F.lit("\n\n7 a\n8 a b")).alias("text"))
    got = line_dedup.without_later_matches(df).first().text.split("\n")
    assert got == [f"{i} a" for i in range(1, 200_001)] + ["", "8 a b"]


def test_quality_counts_of_awkward_rows(awkward, rows):
    got = quality.quality_rules(awkward, min_words=4).collect()
    want = Counter((d, *plain_counts(t)) for d, t, _ in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 4 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert quality.quality_rules(awkward.limit(0)).collect() == []


def test_lines_that_a_host_repeats_deplete_documents(spark):
    own = [(i, "h", f"menu home about\nunique text number {i} of this page") for i in range(10)]
    own += [(20, "h", "Menu  Home about\nmenu home about"), (21, "other", "menu home about"), (22, None, "menu home about")]
    df = spark.createDataFrame(own, "doc_id long, source string, text string")
    got = {r.doc_id: r for r in quality.quality_rules(df, min_words=1, min_documents=3, max_root=0.5).collect()}
    assert got[3].n_removed_words == 3 and got[3].kept
    assert got[20].n_removed_words == 6 and not got[20].kept and not got[20].base_failed
    assert got[21].kept and got[22].kept and got[21].n_removed_words == 0


@pytest.mark.parametrize("others", [15, 4_000])
def test_depletion_decides_in_small_and_hot_hosts(spark, others):
    """Documents made of a template go, wherever they come from; a share of a tenth would miss both."""
    def page(name, lines):
        return "\n".join(" ".join(f"{name}x{j}x{k}" for k in range(10)) for j in range(lines))

    template = page("t", 6)
    docs = [(i, "h", f"{template}\nown words {i}") for i in range(others // 20 + 8)]
    docs += [(10_000 + i, "h", page(f"p{i}", 6)) for i in range(others)]
    docs += [(90_000, "h", page("q", 9) + "\n" + template.split("\n")[0]), (90_001, "g", template + "\nown words")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    got = {r.doc_id: r for r in quality.quality_rules(df).collect()}
    assert not any(r.base_failed for r in got.values())
    assert {d for d, r in got.items() if not r.kept} == set(range(others // 20 + 8))
    assert got[90_000].n_removed_words > 0


def test_filters_above_the_rules_work_words_out_once(spark, awkward):
    """A pushed-down filter must not repeat the word split inside the windows' lambda."""
    long = spark.range(1).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"),
                                 F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40_000)), lambda i: i % 97), " ").alias("text"))
    assert quality.quality_rules(long).filter("not kept").count() == 1


RULES = [("a.org", "/", "block"), ("b.a.org", "/x", "allow"), ("a.org", "/x/yy", "allow"), ("org", "/x/yy/", "block"),
         ("A.ORG", "/", "block"), ("c.com", "", "block"), (None, "/", "block"), ("d.net", None, "block")]
URLS = ["http://a.org/", "https://b.a.org/xz?q", "http://b.a.org/x/yy/1#f", "http://xa.org/", "HTTP://B.A.ORG/", "a.org/",
        "http://c.com", "http://c.com?x=/", "http://e.c.com#x", "://", "http:///x", None, "", "http://a.org/\nx", "x://a.org/y://z"]


def plain_verdict(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, tail = rest[:end], rest[end:]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        path = tail[:min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [(len(h + p), len(h), v == "block", h.lower() + p, v) for h, p, v in RULES if h and p is not None
            and (host == h.lower() or host.endswith("." + h.lower())) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[3] if best else None, best[4] if best else "allow"


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate([*URLS, *URLS[:3]])],
                                  "page_id long, url string, rank string, n int")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = {r.page_id: tuple(r)[1:] for r in url_rules.judge_urls(pages, rules).collect()}
    assert got == {i: plain_verdict(u) for i, u in enumerate([*URLS, *URLS[:3]])}
    assert url_rules.judge_urls(pages.limit(0), rules).collect() == []
    assert {r.verdict for r in url_rules.judge_urls(pages, rules.limit(0), default="block").collect()} == {"block"}


def plain_top(vectors, asks, k):
    out = []
    for q, x in vectors.items():
        if asks(q):
            found = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in vectors.items() if i != q)
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(4096, 32_768), (3, 7)])
def test_top_k(spark, blocks):
    draw = random.Random(2)
    same = [draw.uniform(-1, 1) for _ in range(4)]
    rows = {i: same if i % 3 == 0 else [draw.uniform(-1, 1) for _ in range(4)] for i in range(60)}
    bad = [(100, None), (101, [1.0, None, 0.0, 0.0]), (102, [math.nan] * 4), (103, [math.inf, 0.0, 0.0, 0.0]), (None, same)]
    df = spark.createDataFrame([(i, x, "z", 0) for i, x in [*rows.items(), *bad, (6, same)]],
                               "vec_id long, embedding array<double>, cell string, q int")
    got = knn.top_k(df, F.col("vec_id") % 5 == 0, pivots=4, query_block=blocks[0], data_block=blocks[1]).collect()
    whole = {i: [math.floor(256 * e) for e in x] for i, x in rows.items()}
    assert sorted(tuple(r) for r in got) == plain_top(whole, lambda q: q % 5 == 0, 5)


def test_top_k_of_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [0.5, 0.5]), (1, [1.0]), (2, [])], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in knn.top_k(df, F.col("vec_id") == 0).collect())
    assert got == [(0, 1, 1, 128 * 256), (0, 2, 2, 0)]
    assert knn.top_k(df.limit(0), F.lit(True)).collect() == []
    assert knn.top_k(df, F.lit(False)).collect() == []


def plain_merged(rows, asks, k):
    """All (query, candidate, score) of unlike rows, merged by query id."""
    whole = {(i, tuple(math.floor(256 * e) for e in x)) for i, x in rows}
    out = []
    for q in {i for i, _ in whole if asks(i)}:
        found = sorted({(-sum(a * b for a, b in zip(x, y)), i) for j, x in whole if j == q for i, y in whole if i != q})
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return sorted(out)


def top_of(spark, rows, asks, k, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return sorted(tuple(r) for r in knn.top_k(df, asks(F.col("vec_id")), k=k, **more).collect())


def test_top_k_with_rows_repeated_more_than_k_times(spark):
    rows = [(1, [10.0, 0.0])] * 6 + [(2, [0.0, 10.0]), (50, [9.0, 0.0])]
    for pivots in (2, 8):  # which rows are pivots is up to their hashes
        got = top_of(spark, rows, lambda i: i == 50, 2, pivots=pivots)
        assert got == [(50, 1, 1, 2560 * 2304), (50, 2, 2, 0)], pivots


def test_top_k_of_ids_with_several_vectors(spark):
    own = [(50, [9.0 - n, 0.0]) for n in range(6)]  # more than k of them before any other id
    rows = [*own, (1, [1.0, 0.0]), (2, [0.5, 0.0]), (3, [0.0, 1.0])]
    assert top_of(spark, rows, lambda i: i == 50, 2) == plain_merged(rows, lambda i: i == 50, 2)
    draw = random.Random(8)
    rows = [(i, [draw.uniform(-1, 1) for _ in range(3)]) for i in range(30)]
    rows += [(0, [1.0 + n / 8, 1.0, 1.0]) for n in range(12)]  # its own vectors are its nearest
    rows += [(7, [2.0, 0.0, float(n)]) for n in range(9)] * 4  # score alike against (1, 0, 0)
    rows += [(10, [1.0, 0.0, 0.0]), (10, [1.0, 0.0, 0.0]), (10, [0.0, -1.0, 0.5])]
    want = plain_merged(rows, lambda i: i % 5 == 0, 4)
    assert top_of(spark, rows, lambda i: i % 5 == 0, 4, pivots=3, query_block=3, data_block=7) == want


def test_best_breaks_ties_by_the_earlier_column():
    score = np.array([[5, 7, 7, 1, 7], [0, 0, 0, 0, 0]])
    assert knn._best(score, 3).tolist() == [[1, 2, 4], [0, 1, 2]]
    assert knn._best(score * 2**60, 3).tolist()[1] == [0, 1, 2]
