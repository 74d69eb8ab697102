"""Cases of a knowledge base: validity, metadata filters, text to search, sources that stand in for one another."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..functions import text as T

#: Fields that must be filled, lists that must have an item, the form of an id, the neutral role.
FILLED = (
    "case_id", "review_module", "change_pattern", "before_example", "after_example", "diff_summary", "user_intent", "risk_name",
    "check_point", "trigger_condition", "suggestion_template", "example_clause",
)
LISTS = ("contract_type", "review_role", "tags")
ID_FORM = r"^[a-z0-9]+(_[a-z0-9]+)*$"
NEUTRAL_ZH = ("通用", "通用角色")


def checked(cases: DataFrame) -> DataFrame:
    """cases with stripped fields, lists without repetitions in their first order, and errors (an array, empty if all is well)."""
    have = set(cases.columns)
    out = cases.withColumns({c: T.strip(F.col(c)) for c in FILLED if c in have} | {c: F.array_distinct(F.transform(c, T.strip)) for c in LISTS if c in have})
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    errors = [F.when(blank(F.col(c)), f"{c} must not be empty") if c in have else F.lit(f"{c} must not be empty") for c in FILLED]
    for c in LISTS:
        if c in have:
            errors.append(F.when(F.coalesce(F.size(c), F.lit(0)) < 1, f"{c} must have an item").when(F.exists(c, blank), f"{c} has an empty item"))
        else:
            errors.append(F.lit(f"{c} must have an item"))
    if "case_id" in have:
        errors.append(F.when(~blank(F.col("case_id")) & ~F.col("case_id").rlike(ID_FORM), "case_id must be in lower snake case"))
    return out.withColumn("errors", F.array_compact(F.array(*errors)))


def matches(module: Column, types: Column, roles: Column, want_module: Column, want_type: Column, want_role: Column) -> Column:
    """Whether a case's metadata fit a query. What the query leaves open fits; a neutral role too; else the role or its side."""
    want_module, want_type, want_role = (c.cast("string") for c in (want_module, want_type, want_role))
    open_ = lambda c: F.coalesce(c, F.lit("")) == ""
    has = lambda many, one: F.coalesce(F.array_contains(many, one), F.lit(False))
    side = F.coalesce(F.exists(roles, lambda r: labels.perspective(r) == labels.perspective(want_role)), F.lit(False))
    role = open_(want_role) | T.strip(want_role).isin(*NEUTRAL_ZH) | has(roles, want_role) | side
    return (open_(want_module) | F.coalesce(module == want_module, F.lit(False))) & (open_(want_type) | has(types, want_type)) & role


def searchable(*fields: tuple[str, Column], facets: list[Column] = ()) -> Column:
    """Lines of label and value, then the facets' items; blank ones are left out."""
    filled = [F.when(F.coalesce(T.strip(c), F.lit("")) != "", F.concat(F.lit(f"{name}: "), c)) for name, c in fields]
    return F.concat_ws("\n", *filled, *[T.blank_to_null(F.concat_ws(" ", c)) for c in facets])


def standing_in(by: list[str], *sources: DataFrame) -> DataFrame:
    """For each key the rows of the first source that has any, with source (its place)."""
    parts = [df.withColumn("source", F.lit(i)) for i, df in enumerate(sources)]
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    return rows.withColumn("_least", F.min("source").over(Window.partitionBy(*by))).where("source = _least").drop("_least")
