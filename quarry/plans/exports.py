"""Bulk-upload rows, whole. ``part`` stands for extracted items: what its columns hold is said in ``_items``, and in SQL anew."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quarry.functions import exports, text
from quarry.plans.catalogue import query
from quarry.session import scratch
from quarry.sources import csv_sink


def _items(t):
    size, key = F.col("p_size"), F.col("p_partkey").cast("string")
    flags = F.create_map(F.lit("course_id"), size % 2 == 0, F.lit("course_name"), size % 3 == 0, F.lit("course_description"), F.when(size % 5 != 0, size % 7 == 0))
    return t.part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size", F.concat(F.lit("https://x.edu/c/"), key).alias("url"), F.when(size % 11 != 0, F.when(size % 13 == 0, F.expr("map_filter(map('a', true), (k, v) -> k = 'b')")).otherwise(flags)).alias("inclusion"))


_FOUND = "((p_size % 2 = 0)::INT + (p_size % 3 = 0)::INT + (p_size % 5 != 0 AND p_size % 7 = 0)::INT)"
_NONE = "p_size % 11 = 0 OR p_size % 13 = 0"
_AVERAGE = f"CASE WHEN {_NONE} THEN '0.00' ELSE printf('%.2f', {_FOUND} / 3.0::DOUBLE * 100) END"


def _said(name: str, test: str) -> str:
    return f"'{name}: ' || CASE WHEN {test} THEN 'Present' ELSE 'Not present' END"


_DETAILS = f"CASE WHEN {_NONE} THEN '' ELSE {_said('course_id', 'p_size % 2 = 0')} || chr(10) || {_said('course_name', 'p_size % 3 = 0')} || chr(10) || {_said('course_description', 'p_size % 5 != 0 AND p_size % 7 = 0')} END"
_URL = "'https://x.edu/c/' || p_partkey"


@query(f"""SELECT 'C' || p_partkey AS "External Identifier", 'C' || p_partkey AS "Coded Notation", 'Course' AS "Learning Type", p_name AS "Learning Opportunity Name", p_type AS "Description", 'English' AS "Language",
    'Active' AS "Life Cycle Status Type", {_URL} AS "In Catalog", CASE WHEN p_size % 7 = 0 THEN 'TRUE' END AS "Is Non-Credit", lo AS "Credit Unit Value",
    CASE WHEN lo <> 0 AND hi <> 0 AND hi > lo THEN hi END AS "Credit Unit Max Value", kind AS "Credit Unit Type", CASE WHEN kind IS NULL THEN 'This has credit value, but the type cannot be determined' END AS "Credit Unit Type Description",
    {_AVERAGE} AS "Text Verification Average", {_DETAILS} AS "Text Verification Details", 'C' || p_partkey AS "ConditionProfile: External Identifier", 'Requires' AS "ConditionProfile: Type",
    'Prerequisites' AS "ConditionProfile: Name", CASE WHEN p_size % 6 <> 0 THEN p_brand END AS "ConditionProfile: Description"
    FROM (SELECT *, (p_size % 4)::DOUBLE AS lo, CASE WHEN p_size % 3 <> 0 THEN (p_size % 5)::DOUBLE END AS hi, CASE WHEN p_size % 2 = 1 THEN 'SemesterHour' END AS kind FROM part)""")
def b40_course_rows(t):
    i, size = _items(t), F.col("p_size")
    ident = F.concat(F.lit("C"), F.col("p_partkey").cast("string"))
    item = {
        "course_id": ident, "course_name": F.col("p_name"), "course_description": F.col("p_type"), "url": F.col("url"), "course_non_credit": size % 7 == 0,
        "course_credits_min": (size % 4).cast("double"), "course_credits_max": F.when(size % 3 != 0, (size % 5).cast("double")), "course_credits_type": F.when(size % 2 == 1, "SemesterHour"),
        "course_prerequisites": F.when(size % 6 != 0, F.col("p_brand")), "inclusion": F.col("inclusion"),
    }
    return i.select(*(c.alias(k) for k, c in exports.course(item).items()))


@query(f"""SELECT 'L' || p_partkey AS "External Identifier", 'Learning Program' AS "Learning Type", p_name AS "Learning Opportunity Name", p_type AS "Description", {_URL} AS "Subject Webpage",
    'Active' AS "Life Cycle Status Type", 'English' AS "Language", {_URL} AS "Available Online At", {_AVERAGE} AS "Text Verification Average", {_DETAILS} AS "Text Verification Details" FROM part""")
def b41_program_rows(t):
    item = {"learning_program_id": F.concat(F.lit("L"), F.col("p_partkey").cast("string")), "learning_program_name": F.col("p_name"), "learning_program_description": F.col("p_type"), "url": F.col("url"), "inclusion": F.col("inclusion")}
    return _items(t).select(*(c.alias(k) for k, c in exports.program(item).items()))


@query("""WITH i AS (SELECT p_partkey AS place, p_name AS text, CASE WHEN p_size % 4 = 0 THEN 'Spanish' ELSE 'English' END AS language, CASE WHEN p_size % 10 <> 0 THEN p_brand END AS fw,
        CASE p_size % 3 WHEN 0 THEN 'outcomes' WHEN 1 THEN 'course_objectives' END AS cat FROM part)
    SELECT place * 2 AS place, 'ceasn:CompetencyFramework' AS "@type", md5('framework/' || coalesce(fw, '')) AS "@id", coalesce(fw, '') AS "ceasn:name", '' AS "ceasn:competencyText",
        'These are the competencies associated with ' || coalesce(fw, '') AS "ceasn:description", language AS "ceasn:inLanguage", '' AS "ceasn:publisher", '' AS "ceasn:isPartOf", NULL AS "Competency Category"
    FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(fw, '') ORDER BY place) AS k FROM i) WHERE k = 1
    UNION ALL SELECT place * 2 + 1, 'ceasn:Competency', md5('competency/' || place), '', text, '', language, '', md5('framework/' || coalesce(fw, '')),
        CASE cat WHEN 'outcomes' THEN 'Course Level Student Learning Outcome(s)' WHEN 'course_objectives' THEN 'Course Objectives' ELSE 'Unknown' END FROM i""")
def b42_competency_rows(t):
    size = F.col("p_size")
    items = t.part.select(F.col("p_partkey").alias("place"), F.col("p_name").alias("text"), F.when(size % 4 == 0, "Spanish").otherwise("English").alias("language"), F.when(size % 10 != 0, F.col("p_brand")).alias("competency_framework"), F.when(size % 3 == 0, "outcomes").when(size % 3 == 1, "course_objectives").alias("competency_category"))
    return exports.competencies(items)


@query(f"""SELECT md5('credential/' || p_partkey) AS "External Identifier", p_name AS "Credential Name", p_type AS "Description", CASE p_size % 3 WHEN 0 THEN 'Spanish' ELSE 'English' END AS "Language",
    CASE p_size % 2 WHEN 0 THEN 'Certificate' ELSE 'Unknown' END AS "Credential Type", {_URL} AS "In Catalog", {_AVERAGE} AS "Text Verification Average", {_DETAILS} AS "Text Verification Details" FROM part""")
def b43_credential_rows(t):
    size = F.col("p_size")
    item = {"key": F.col("p_partkey").cast("string"), "credential_name": F.col("p_name"), "credential_description": F.col("p_type"), "language": F.when(size % 3 == 0, "Spanish").when(size % 3 == 1, ""), "credential_type": F.when(size % 2 == 0, "Certificate"), "url": F.col("url"), "inclusion": F.col("inclusion")}
    return _items(t).select(*(c.alias(k) for k, c in exports.credential(item).items()))


@query(f"SELECT p_partkey, {_AVERAGE} AS average, {_DETAILS} AS details FROM part")
def b44_verification_rows(t):
    return _items(t).select("p_partkey", exports.average(F.col("inclusion")).alias("average"), exports.details(F.col("inclusion")).alias("details"))


_KINDS = ("COURSES", "LEARNING_PROGRAMS", "COMPETENCIES", "CREDENTIALS", "OTHER")


@query(f"""SELECT p_partkey, CASE WHEN k < 5 THEN CASE k WHEN 1 THEN 'C' WHEN 2 THEN 'L' WHEN 3 THEN 'T' ELSE 'D' END || p_name END AS name, CASE WHEN k < 5 THEN 'https://x.edu/c/' || p_partkey END AS url,
    CASE WHEN k < 5 THEN {_AVERAGE} END AS average, CASE WHEN k < 5 THEN {_DETAILS} END AS details, CASE WHEN k = 5 THEN 'Unknown catalogue type: OTHER' END AS error FROM (SELECT *, p_size % 5 + 1 AS k FROM part)""")
def b46_template_rows(t):
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("p_size") % 5 + 1).cast("int"))
    names = {k: F.concat(F.lit(a), F.col("p_name")) for k, a in zip(_KINDS, "CLTD", strict=False)}
    row = exports.template_row(kind, F.concat(F.lit("../c/"), F.col("p_partkey").cast("string")), F.lit("https://x.edu/list/all"), F.col("inclusion"), names)
    return _items(t).select("p_partkey", *(c.alias(k) for k, c in row.items()))


@query(f"""SELECT p_partkey, 'a "quoted", name' || chr(10) || p_name AS name, {_DETAILS} AS details FROM part""")
def s10_csv_round_trip(t):
    """Rows written as a CSV export and read again: quotes, commas and line ends come through."""
    path = f"{scratch(t.spark)}/csv-{uuid.uuid4().hex}"
    rows = _items(t).select("p_partkey", F.concat(F.lit('a "quoted", name\n'), F.col("p_name")).alias("name"), exports.details(F.col("inclusion")).alias("details"))
    csv_sink.write(rows, path)
    return csv_sink.read(t.spark, path, "p_partkey long, name string, details string").select("p_partkey", "name", F.coalesce("details", F.lit("")).alias("details"))


@query("""SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS step, count(*) AS total, floor(count(*) FILTER (o_orderstatus = 'F') / count(*) * 100)::BIGINT AS done_pct FROM orders
    WHERE o_orderdate BETWEEN TIMESTAMP '1994-01-01 00:00:00' AND TIMESTAMP '1995-12-31 23:59:59.999' GROUP BY 1, 2""")
def s11_extractions_csv(t):
    """The extractions of a span of days, with how far they are, as an export writes and reads them."""
    path = f"{scratch(t.spark)}/csv-{uuid.uuid4().hex}"
    inside = F.col("o_orderdate").between(*text.day_bounds(F.lit("1994-01-01"), F.lit("1995-12-31")))
    rows = t.orders.where(inside).groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderpriority").alias("step")).agg(F.count(F.lit(1)).alias("total"), text.percent(F.count_if(F.col("o_orderstatus") == "F"), F.count(F.lit(1))).alias("done_pct"))
    csv_sink.write(rows, path)
    return csv_sink.read(t.spark, path, rows.schema)


@query(r"""SELECT doc_id, substr(regexp_replace(regexp_replace(text, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 50) AS name FROM documents""")
def s12_file_names(t):
    return t.documents.select("doc_id", text.file_name(F.col("text")).alias("name"))
