"""Each stage of the pipeline against a brute-force version of what it has to do, then the whole."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from test_groups import plain_counts, plain_fingerprint, plain_kept, roots_of
from test_tokens import byte_ids, check_packing

from tallymill.llm import toxicity
from tallymill.llm.queries import QUERIES
from tallymill.llm.shared import written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, kept string"


def plain_removed(rows):
    """Words that common lines take from each (host, text), for texts of single blanks."""
    texts = defaultdict(set)
    for host, text in rows:
        texts[host or ""].add(text or "")
    out = {}
    for host, own in texts.items():
        held = Counter(x for text in own for x in {line.lower() for line in text.split("\n") if line.split()})
        for text in own:
            out[host, text] = sum(len(x.split()) for x in text.split("\n")
                                  if held[x.lower()] > 5 and held[x.lower()] ** 2 > len(own))
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    draw = random.Random(4)
    words = [f"w{i}" for i in range(300)]

    def line(n=14):
        return " ".join(draw.choice(words) for _ in range(n))

    base = ["\n".join(line() for _ in range(8)) for _ in range(12)]
    shared = line(60)
    rows = []
    for i in range(90):
        text = base[i % 12] if i < 40 else "\n".join(line() for _ in range(8))
        if i % 5 == 0:
            own = text.split(" ")
            own[draw.randrange(len(own))] = "changed"
            text = " ".join(own)
        if i % 7 == 0:
            text += "\n" + shared
        if i % 9 == 0:
            text = text.replace(" ", " idiot ", 1)
        rows.append((i, text, "en", f"s{i % 3}", len(text), 1, "x"))
    # A template that pages of one host repeat: lines unlike each other, so that no other stage takes them.
    template = "\n".join(line(12) for _ in range(5))
    rows += [(120 + i, f"{template}\n{line(9)}", "en", "s1", 1, 3, "t") for i in range(12)]
    rows += [(200, None, None, None, None, 2, "y"), (201, "", "en", "s0", 0, 2, "y"), rows[3], rows[3],
             (None, base[0] + "\n" + line(), "en", "s1", 9, 2, "y"), (202, "long " * 3_000, "en", "s2", 15_000, 3, "z")]
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i % 9 == 0)) for i in range(90) if i % 2 or i % 9 == 0]
    spark.createDataFrame(labels, "doc_id long, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    return path


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "quality_rules", "line_dedup", "near_dedup", "packing"]
    clean = written(stages["toxicity"](spark, docs, folder), "a")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    bad = {r.doc_id for r in toxicity.toxicity(docs, labels).collect() if r.predicted}
    assert bad and all(d % 9 == 0 for d in bad)
    assert rows_of(clean) == Counter(tuple(r) for r in docs.collect() if r.doc_id not in bad)

    good = written(stages["quality_rules"](spark, clean, folder), "b")
    want, depleted = Counter(), set()
    gone = plain_removed([(r.source, r.text) for r in clean.collect()])
    for r in clean.collect():
        n, _, _, _, repeated = plain_counts(r.text)
        if n >= 50 and 100 * repeated <= 50 * n:
            if 2 * gone[r.source or "", r.text or ""] > n:
                depleted.add(r.doc_id)
            else:
                want[tuple(r)] += 1
    assert rows_of(good) == want and depleted >= set(range(120, 132))

    lines = written(stages["line_dedup"](spark, good, folder), "c")
    before = sorted(good.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    kept = plain_kept([(r.doc_id, r.text, None) for r in before])
    want = Counter()
    for i, r in enumerate(before):
        text = "\n".join(x for at, x in enumerate(r.text.split("\n")) if at in kept[i] or not x.split())
        want[(r.doc_id, text, r.lang, r.source, len(text), r.row, r.kept)] += 1
    assert rows_of(lines) == want

    single = written(stages["near_dedup"](spark, lines, folder), "d")
    rows = sorted(lines.collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    fps = [plain_fingerprint(r.text) for r in rows]
    groups = roots_of(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i)
                                         if (fps[i] ^ fps[j]).bit_count() <= 3])
    assert rows_of(single) == Counter(tuple(rows[i]) for i in set(groups.values()))
    for df in (clean, good, lines, single):
        assert df.columns == columns and df.dtypes == docs.dtypes

    packed = stages["packing"](spark, single, folder).collect()
    ids = defaultdict(list)
    for r in single.collect():
        ids[r.doc_id].append([*byte_ids(r.text or ""), 2])
    check_packing(packed, ids, 1024)
    assert Counter(r.ids_crc32 for r in corpus_pipeline.run(spark, folder).collect()) == Counter(r.ids_crc32 for r in packed)


def test_stages_take_an_empty_table(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    docs.write.parquet(str(tmp_path / "e"))
    docs = spark.read.schema(docs.schema).parquet(str(tmp_path / "e"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).collect() == [], name


def test_every_operator_has_a_query():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
