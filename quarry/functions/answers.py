"""Recorded answers of a model, as JSON: read by kind of value, checked, and made into entities; all column expressions.

An answer that can't be used is an error of its row. ``value``s keep the kinds that JSON gave them, as rules differ for
texts, numbers and truth values.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quarry.functions import extraction as ex, text

#: The kinds of pages and of entities, and each entity's fields; a star marks a required one.
PAGE_TYPES = ("DETAIL", "CATEGORY_LINKS", "DETAIL_LINKS", "API_REQUEST", "EXPLORATORY")
FIELDS = {
    "COURSES": ("course_id*", "course_name*", "course_description*", "course_prerequisites", "course_non_credit", "course_credits_min", "course_credits_max", "course_credits_type", "course_ceu_credits"),
    "LEARNING_PROGRAMS": ("learning_program_id*", "learning_program_name*", "learning_program_description*"),
    "COMPETENCIES": ("text*", "competency_framework", "competency_category", "language"),
    "CREDENTIALS": ("credential_name*", "credential_description*", "credential_type*", "language"),
}
CREDITS = ("course_credits_min", "course_credits_max", "course_ceu_credits", "program_credits")


def fields(kind: str) -> list[str]:
    return [f.rstrip("*") for f in FIELDS[kind]]


def required(kind: str) -> list[str]:
    return [f[:-1] for f in FIELDS[kind] if f.endswith("*")]


def parsed(answer: Column) -> Column:
    """A text as JSON; null where it is none."""
    return F.try_parse_json(answer)


def _kind(answer: Column, key: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(answer, f"$.{key}", "variant"))


def is_text(answer: Column, key: str) -> Column:
    return F.coalesce(_kind(answer, key) == "STRING", F.lit(False))


def _text(answer: Column, key: str) -> Column:
    return F.try_variant_get(answer, f"$.{key}", "string")


def _answer(value: Column, error: Column) -> Column:
    return F.struct(F.when(error.isNull(), value).alias("value"), error.alias("error"))


def _bad(key: str) -> Column:
    return F.lit(f"bad value for {key}")


def truth(answer: Column, key: str) -> Column:
    """Truth values, and texts that say one."""
    said, told = F.lower(_text(answer, key)), is_text(answer, key)
    value = F.when(told & said.isin("yes", "true"), True).when(told & said.isin("no", "false", "null"), False).when(F.coalesce(_kind(answer, key) == "BOOLEAN", F.lit(False)), said == "true")
    return _answer(value, F.when(value.isNull(), _bad(key)))


def one_of(answer: Column, key: str, allowed: tuple[str, ...]) -> Column:
    given = _text(answer, key)
    return _answer(given, F.when(~(is_text(answer, key) & F.coalesce(given.isin(*allowed), F.lit(False))), _bad(key)))


def number(answer: Column, key: str) -> Column:
    """Numbers, and texts of digits alone."""
    told, given = is_text(answer, key), _text(answer, key)
    numeric = F.coalesce(_kind(answer, key).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)"), F.lit(False))
    value = F.when(told & given.rlike("^[0-9]+$") | numeric, given.try_cast("double"))
    return _answer(value, F.when(value.isNull(), _bad(key)))


def page_type(answer: Column) -> Column:
    """The page's type; null where the answer has none that is known."""
    found = one_of(answer, "page_type", PAGE_TYPES)
    return found["value"]


def catalogue_type(answer: Column) -> Column:
    """No type is no answer; one that isn't known is an error."""
    given = _text(answer, "catalogue_type")
    found = one_of(answer, "catalogue_type", tuple(FIELDS))
    return F.when(F.coalesce(given, F.lit("")) == "", F.struct(F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("error"))).otherwise(found)


def several_courses(answer: Column) -> Column:
    """No answer counts as yes."""
    return F.when(answer.isNull(), _answer(F.lit(True), F.lit(None).cast("string"))).otherwise(truth(answer, "multiple_courses"))


def is_present(answer: Column) -> Column:
    """Whether what is looked for is there; anything but a truth value counts as no."""
    return F.coalesce(_kind(answer, "present") == "BOOLEAN", F.lit(False)) & (F.coalesce(_text(answer, "present"), F.lit("")) == "true")


def split_expression(answer: Column) -> Column:
    """A struct of regexp, expected, title; or what is wrong with the first bad one of them."""
    expected = number(answer, "expected_course_count")
    error = F.when(answer.isNull(), "no expression").when(~is_text(answer, "regexp"), _bad("regexp")).otherwise(F.coalesce(expected["error"], F.when(~is_text(answer, "first_course_title"), _bad("first_course_title"))))
    return F.struct(*(F.when(error.isNull(), c).alias(k) for k, c in (("regexp", _text(answer, "regexp")), ("expected", expected["value"]), ("title", _text(answer, "first_course_title")))), error.alias("error"))


def entity(answer: Column, kind: str) -> dict[str, Column]:
    """An entity's fields as texts, its credits as numbers.

    Texts of competencies and credentials are trimmed, those of courses and programs stay as they are. An empty text is
    none unless the field is required. Credits are read from texts only; a type that isn't listed, or of a course
    without credit, is none."""
    raw, must = kind in ("COURSES", "LEARNING_PROGRAMS"), required(kind)
    out = {}
    for f in fields(kind):
        given = _text(answer, f)
        if f in CREDITS:
            out[f] = F.when(is_text(answer, f), text.parse_number(given))
            continue
        if f == "course_credits_type":
            given = F.when(F.trim(given).isin(*ex.CREDIT_TYPES), F.trim(given))
        elif not raw:
            given = F.when(is_text(answer, f), F.trim(given)).otherwise(given)
        out[f] = given if f in must else F.when(given != "", given)
    if "course_non_credit" in out:
        free = out["course_non_credit"]
        worthless = (free != "") & (is_text(answer, "course_non_credit") | ~free.isin("false", "0"))
        out["course_credits_type"] = F.when(~F.coalesce(worthless, F.lit(False)), out["course_credits_type"])
    return out


def inclusion(page: Column, values: dict[str, Column]) -> Column:
    """A map from each field that is given to whether the page has it."""
    every = [F.struct(F.lit(k).alias("key"), text.included(page, v.cast("string")).alias("value")) for k, v in values.items()]
    return F.map_from_entries(F.filter(F.array(*every), lambda e: e["value"].isNotNull()))


def passes(found: Column, kind: str) -> Column:
    """Every required field is absent, or in the page."""
    out = F.lit(True)
    for f in required(kind):
        out = out & F.coalesce(F.try_element_at(found, F.lit(f)), F.lit(True))
    return out
