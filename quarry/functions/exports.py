"""Rows of the bulk-upload templates, one function of columns for each entity type.

An item is a row with ``url`` (of its page), ``inclusion`` (a map from field to whether it is in the page; null: not
verified) and its entity's fields. Identifiers that would be drawn at random are digests here, so that a rerun agrees.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarry.functions import urls

#: Column names, constants and names of the templates, in their order.
NO_CREDIT_TYPE = "This has credit value, but the type cannot be determined"
CATEGORIES = {"outcomes": "Course Level Student Learning Outcome(s)", "course_objectives": "Course Objectives"}
FRAMEWORK, COMPETENCY = "ceasn:CompetencyFramework", "ceasn:Competency"


def average(inclusion: Column) -> Column:
    """The part of the fields that are in the page, in percent with two decimals; 0.00 without fields."""
    flags = F.coalesce(F.map_values(inclusion), F.array().cast("array<boolean>"))
    found = F.size(F.filter(flags, lambda f: F.coalesce(f, F.lit(False))))
    return F.format_string("%.2f", F.when(F.size(flags) > 0, found / F.size(flags) * 100).otherwise(F.lit(0.0)))


def details(inclusion: Column) -> Column:
    """A line for each field, in the map's order."""
    lines = F.transform(F.map_entries(inclusion), lambda e: F.concat(e["key"], F.when(F.coalesce(e["value"], F.lit(False)), ": Present").otherwise(": Not present")))
    return F.coalesce(F.array_join(lines, "\n"), F.lit(""))


def _verified(item: Column) -> dict[str, Column]:
    return {"Text Verification Average": average(item), "Text Verification Details": details(item)}


def course(item: dict[str, Column]) -> dict[str, Column]:
    """The greater number of credits only beside a smaller one that isn't 0; the type's description only without a type."""
    low, high, kind = item["course_credits_min"], item["course_credits_max"], item["course_credits_type"]
    ranged = F.coalesce((low != 0) & (high != 0) & (high > low), F.lit(False))
    return {
        "External Identifier": item["course_id"],
        "Coded Notation": item["course_id"],
        "Learning Type": F.lit("Course"),
        "Learning Opportunity Name": item["course_name"],
        "Description": item["course_description"],
        "Language": F.lit("English"),
        "Life Cycle Status Type": F.lit("Active"),
        "In Catalog": item["url"],
        "Is Non-Credit": F.when(item["course_non_credit"], "TRUE"),
        "Credit Unit Value": low,
        "Credit Unit Max Value": F.when(ranged, high),
        "Credit Unit Type": kind,
        "Credit Unit Type Description": F.when(F.coalesce(kind, F.lit("")) == "", NO_CREDIT_TYPE),
        **_verified(item["inclusion"]),
        "ConditionProfile: External Identifier": item["course_id"],
        "ConditionProfile: Type": F.lit("Requires"),
        "ConditionProfile: Name": F.lit("Prerequisites"),
        "ConditionProfile: Description": item["course_prerequisites"],
    }


def program(item: dict[str, Column]) -> dict[str, Column]:
    return {
        "External Identifier": item["learning_program_id"],
        "Learning Type": F.lit("Learning Program"),
        "Learning Opportunity Name": item["learning_program_name"],
        "Description": item["learning_program_description"],
        "Subject Webpage": item["url"],
        "Life Cycle Status Type": F.lit("Active"),
        "Language": F.lit("English"),
        "Available Online At": item["url"],
        **_verified(item["inclusion"]),
    }


def credential(item: dict[str, Column]) -> dict[str, Column]:
    def given(c: Column, default: str) -> Column:
        return F.when(F.coalesce(c, F.lit("")) == "", default).otherwise(c)

    return {
        "External Identifier": F.md5(F.concat_ws("/", F.lit("credential"), item["key"])),
        "Credential Name": item["credential_name"],
        "Description": item["credential_description"],
        "Language": given(item["language"], "English"),
        "Credential Type": given(item["credential_type"], "Unknown"),
        "In Catalog": item["url"],
        **_verified(item["inclusion"]),
    }


def competencies(items: DataFrame) -> DataFrame:
    """items: place, text, language, competency_framework, competency_category. A row for each competency, and before
    the first of each framework one of the framework. ``place`` orders the rows; competencies carry the id of their
    framework's row (an id of its own would lead nowhere). Null names are one framework, without a name."""
    name = F.coalesce("competency_framework", F.lit(""))
    ident = F.md5(F.concat(F.lit("framework/"), name))
    first = items.groupBy(name.alias("framework")).agg(F.min("place").alias("place"), F.min_by("language", "place").alias("language"))
    frameworks = first.select(
        (F.col("place") * 2).alias("place"), F.lit(FRAMEWORK).alias("@type"), F.md5(F.concat(F.lit("framework/"), F.col("framework"))).alias("@id"),
        F.col("framework").alias("ceasn:name"), F.lit("").alias("ceasn:competencyText"), F.concat(F.lit("These are the competencies associated with "), F.col("framework")).alias("ceasn:description"),
        F.col("language").alias("ceasn:inLanguage"), F.lit("").alias("ceasn:publisher"), F.lit("").alias("ceasn:isPartOf"), F.lit(None).cast("string").alias("Competency Category"),
    )
    category = F.lit("Unknown")
    for k, v in CATEGORIES.items():
        category = F.when(F.col("competency_category") == k, v).otherwise(category)
    rows = items.select(
        (F.col("place") * 2 + 1).alias("place"), F.lit(COMPETENCY).alias("@type"), F.md5(F.concat(F.lit("competency/"), F.col("place").cast("string"))).alias("@id"),
        F.lit("").alias("ceasn:name"), F.col("text").alias("ceasn:competencyText"), F.lit("").alias("ceasn:description"),
        F.col("language").alias("ceasn:inLanguage"), F.lit("").alias("ceasn:publisher"), ident.alias("ceasn:isPartOf"), category.alias("Competency Category"),
    )
    return frameworks.unionByName(rows)


def template_row(kind: Column, url: Column, base: Column, inclusion: Column, names: dict[str, Column]) -> dict[str, Column]:
    """What every type's row has, by type: names maps a type to its name column. An unknown type is an error of the row."""
    name = F.lit(None).cast("string")
    for k, c in names.items():
        name = F.when(kind == k, c).otherwise(name)
    known = kind.isin(*names)
    return {"name": name, "url": F.when(known, urls.resolve(base, url)), "average": F.when(known, average(inclusion)), "details": F.when(known, details(inclusion)), "error": F.when(~F.coalesce(known, F.lit(False)), F.concat(F.lit("Unknown catalogue type: "), F.coalesce(kind, F.lit(""))))}
