from __future__ import annotations

from tallymill import fixed
from tallymill.operators import grids


def tables(spark, templates, axes, rules=()):
    return (
        spark.createDataFrame(templates, "grid string, template string"),
        spark.createDataFrame(axes, "grid string, axis string, value string"),
        spark.createDataFrame(list(rules), grids.RULES),
    )


def names(df):
    return sorted((r["grid"], r["name"]) for r in df.collect())


def test_the_grids_give_the_task_names(spark):
    made = [name for _, name in names(grids.expand(*grids.task_grids(spark)))]
    assert len(made) == 135 and made.sort() is None and made == fixed.task_names()


def test_products_and_rules(spark):
    templates = [("a", "x-{p}-{q}-{r}"), ("b", "plain"), ("c", "{p}/{p}"), ("d", "{none}"), ("a", "y{q}"), ("b", "plain")]
    axes = [("a", "p", "1"), ("a", "p", "2"), ("a", "q", "3"), ("a", "q", "4"), ("a", "r", "5"), ("a", "r", "5"),
            ("a", "r", None), ("c", "p", ""), ("c", "p", "z"), ("b", "p", "unused")]
    every = [("a", f"x-{p}-{q}-5") for p in "12" for q in "34"] + [
        ("a", "y3"), ("a", "y4"), ("b", "plain"), ("c", "/"), ("c", "z/z")]
    assert names(grids.expand(*tables(spark, templates, axes)[:2])) == sorted(every)
    rules = [("a", "p", "1", "q", "4"), ("c", "p", "z", None, None), ("b", "p", "unused", None, None),
             ("a", "q", "3", "none", "x"), ("c", "p", "", "q", "4"), ("a", "p", "z", None, None)]
    kept = [x for x in every if x not in [("a", "x-1-4-5"), ("c", "z/z")]]
    assert names(grids.expand(*tables(spark, templates, axes, rules))) == sorted(kept)


def test_choices_and_empty_tables(spark):
    one = grids.expand(*tables(spark, [("a", "{p}-{q}")], [("a", "p", "1"), ("a", "q", "2")])).first()
    assert one["choices"] == {"p": "1", "q": "2"}
    assert grids.expand(*tables(spark, [], [("a", "p", "1")])).count() == 0
    assert grids.expand(*tables(spark, [("a", "{p}"), (None, "n"), ("a", None)], [])).collect()[0]["name"] == "n"
