"""Parameter grids: names from templates, axes of values, and rules that leave combinations out.

All three are tables, so a grid is extended by adding rows:

* templates ``(grid, template)``: ``{axis}`` marks the place of an axis' value,
* axes ``(grid, axis, value)``,
* rules ``(grid, axis, value, other_axis, other_value)``: combinations with both
  values are left out; with a null other axis, all with the first value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymill import fixed

PLACE = r"\{(\w+)\}"
RULES = "grid string, axis string, value string, other_axis string, other_value string"


def expand(templates: DataFrame, axes: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """``(grid, name, choices)`` of every combination that no rule leaves out.

    Each round joins the first open axis of each name with its values, so there
    are as many joins as axes in the widest template and no cross join.
    ``choices`` maps axes to values. A template without axes is a name by itself;
    an axis without values leaves no names. An axis named twice has one value.
    Values are not templates: they hold no ``{axis}``. Repeated rows count once.
    """
    marks = F.array_distinct(F.regexp_extract_all("template", F.lit(PLACE), F.lit(1)))
    made = templates.where("template IS NOT NULL").distinct().select(
        "grid", F.col("template").alias("name"), marks.alias("open"),
        F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("choices"),
    )
    values = axes.select("grid", "axis", "value").where("value IS NOT NULL").distinct()
    rounds = made.agg(F.max(F.size("open"))).first()[0] or 0
    for at in range(rounds):
        here = made.withColumn("axis", F.get("open", F.lit(at)))
        met = here.join(values, ["grid", "axis"], "left").where("axis IS NULL OR value IS NOT NULL")
        chosen = F.map_concat("choices", F.map_from_arrays(F.array("axis"), F.array("value")))
        filled = F.replace("name", F.concat(F.lit("{"), F.col("axis"), F.lit("}")), F.col("value"))
        made = met.select(
            "grid", F.when(F.col("axis").isNull(), F.col("name")).otherwise(filled).alias("name"), "open",
            F.when(F.col("axis").isNull(), F.col("choices")).otherwise(chosen).alias("choices"),
        )
    names = made.select("grid", "name", "choices")
    if rules is None:
        return names
    n, r = names.alias("n"), rules.alias("r")

    def has(axis: str, value: str):
        return F.try_element_at("n.choices", F.col(axis)) == F.col(value)

    other = F.col("r.other_axis").isNull() | has("r.other_axis", "r.other_value")
    left_out = (F.col("n.grid") == F.col("r.grid")) & has("r.axis", "r.value") & other
    return n.join(r, left_out, "left_anti")


def task_grids(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Templates and axes of the task names; fixed, small tables."""
    templates = [(grid, template) for grid, template, _ in fixed.TASK_GRIDS]
    axes = [
        (grid, axis, value) for grid, _, held in fixed.TASK_GRIDS
        for axis, values in held.items() for value in values
    ]
    return (
        spark.createDataFrame(templates, "grid string, template string"),
        spark.createDataFrame(axes, "grid string, axis string, value string"),
    )
