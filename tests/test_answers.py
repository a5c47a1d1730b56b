"""Recorded answers, kind by kind."""

from pyspark.sql import functions as F

from quarry.functions import answers


def rows(spark, texts, column):
    return [r["x"] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(column(answers.parsed(F.col("t"))).alias("x")).collect()]


def test_checks(spark):
    t = ['{"a": true}', '{"a": "No"}', '{"a": "TRUE"}', '{"a": 1}', '{"a": "x"}', "{}", "nonsense", None, '{"a": null}', '{"a": "null"}', '{"a": [1]}']
    assert [(x.value, x.error is None) for x in rows(spark, t, lambda c: answers.truth(c, "a"))] == [(True, True), (False, True), (True, True), (None, False), (None, False), (None, False), (None, False), (None, False), (None, False), (False, True), (None, False)]
    t = ['{"a": 3}', '{"a": "12"}', '{"a": 2.5}', '{"a": "2.5"}', '{"a": true}', '{"a": "-1"}', '{"a": -1}', "{}", None, '{"a": 12345678901234567890}']
    assert [x.value for x in rows(spark, t, lambda c: answers.number(c, "a"))] == [3, 12, 2.5, None, None, None, -1, None, None, 1.2345678901234567e19]
    t = ['{"page_type": "DETAIL"}', '{"page_type": "detail"}', '{"page_type": 1}', "{}", None]
    assert rows(spark, t, answers.page_type) == ["DETAIL", None, None, None, None]
    t = ['{"catalogue_type": "COURSES"}', '{"catalogue_type": ""}', '{"catalogue_type": "X"}', None]
    assert [(x.value, x.error) for x in rows(spark, t, answers.catalogue_type)] == [("COURSES", None), (None, None), (None, "bad value for catalogue_type"), (None, None)]
    assert [x.value for x in rows(spark, [None, '{"multiple_courses": "no"}'], answers.several_courses)] == [True, False]
    assert rows(spark, ['{"present": true}', '{"present": "true"}', '{"present": false}', None], answers.is_present) == [True, False, False, False]
    good = rows(spark, ['{"regexp": "a", "expected_course_count": "3", "first_course_title": "t"}'], answers.split_expression)[0]
    assert tuple(good) == ("a", 3.0, "t", None)


def test_entities(spark):
    def made(kind, text):
        df = spark.createDataFrame([(text,)], "t string").select(*(c.alias(k) for k, c in answers.entity(answers.parsed(F.col("t")), kind).items()))
        return df.first().asDict()

    course = made("COURSES", '{"course_id": " A 1 ", "course_name": "", "course_description": null, "course_prerequisites": "", "course_non_credit": false, "course_credits_min": "3.5 units", "course_credits_max": 4, "course_credits_type": " SemesterHour ", "course_ceu_credits": " x", "other": 1}')
    assert course == {"course_id": " A 1 ", "course_name": "", "course_description": None, "course_prerequisites": None, "course_non_credit": "false", "course_credits_min": 3.5, "course_credits_max": None, "course_credits_type": "SemesterHour", "course_ceu_credits": None}
    for free, kind in (("true", None), ('"yes"', None), ("1", None), ("0", "ClockHour"), ('""', "ClockHour"), ("null", "ClockHour"), ("false", "ClockHour"), ('"false"', None)):
        assert made("COURSES", f'{{"course_non_credit": {free}, "course_credits_type": "ClockHour"}}')["course_credits_type"] == kind, free
    for kind in ("UNKNOWN", "semesterhour", "", "Pints"):
        assert made("COURSES", f'{{"course_credits_type": "{kind}"}}')["course_credits_type"] is None
    assert made("CREDENTIALS", '{"credential_name": " N ", "credential_description": "  ", "language": " "}') == {"credential_name": "N", "credential_description": "", "credential_type": None, "language": None}
    assert made("COMPETENCIES", '{"text": "", "competency_framework": " f", "language": 5}') == {"text": "", "competency_framework": "f", "competency_category": None, "language": "5"}
    assert made("LEARNING_PROGRAMS", "broken") == dict.fromkeys(answers.fields("LEARNING_PROGRAMS"))


def test_verdicts(spark):
    page = F.lit("Intro to Ore, three units of [Geology](/g).")
    values = {"course_id": F.lit(None).cast("string"), "course_name": F.lit("intro TO ore"), "course_description": F.lit("geology"), "course_prerequisites": F.lit("Maths"), "course_credits_min": F.lit(3.0)}
    found = spark.range(1).select(answers.inclusion(page, values).alias("f")).select("f", answers.passes(F.col("f"), "COURSES").alias("p")).first()
    assert found.f == {"course_name": True, "course_description": True, "course_prerequisites": False, "course_credits_min": False} and found.p
    failing = spark.range(1).select(answers.inclusion(page, {**values, "course_id": F.lit("X9")}).alias("f")).select(answers.passes(F.col("f"), "COURSES").alias("p")).first()
    assert failing.p is False
