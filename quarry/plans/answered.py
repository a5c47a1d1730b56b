"""The part of the catalogue from a model's recorded answers to the rows of an export."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from quarry.functions import answers, exports
from quarry.plans import exports as _templates  # noqa: F401  (its queries come first)
from quarry.plans.catalogue import ORACLE_SQL, QUERIES, query

_KINDS = tuple(answers.FIELDS)


def _quoted(c):
    """A text as JSON has it."""
    return F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)


def _answers(t):
    """A recorded answer about each document: an entity of one of the four types, made of its lines, and one of none."""
    k, lines = F.col("doc_id"), F.split("text", "\n")
    first, last = F.element_at(lines, 1), F.element_at(lines, -1)
    kind = F.when(k % 13 == 0, "OTHER").otherwise(F.element_at(F.array(*map(F.lit, _KINDS)), (k % 4 + 1).cast("int")))
    names = {"COURSES": ("course_id", "course_name", "course_description"), "LEARNING_PROGRAMS": ("learning_program_id", "learning_program_name", "learning_program_description"), "COMPETENCIES": ("competency_category", "competency_framework", "text"), "CREDENTIALS": ("credential_type", "credential_name", "credential_description")}
    given = {"{0}": F.when(k % 5 == 0, F.lit("")).otherwise(F.col("lang")), "{1}": F.concat(F.lit("  "), first, F.lit(" ")), "{2}": F.when(k % 3 == 0, F.translate(last, "abcde", "ABCDE")).when(k % 3 == 1, F.concat(last, F.lit(" zzz"))).otherwise(last)}
    out = F.lit(None).cast("string")
    for name, keys in names.items():
        parts = [F.concat(F.lit(f'"{key}": '), _quoted(c)) for key, c in zip(keys, given.values(), strict=True)]
        if name == "COURSES":
            parts += [F.concat(F.lit('"course_credits_min": '), F.when(k % 8 == 0, "3").otherwise('" 3.5 units"')), F.concat(F.lit('"course_credits_type": '), F.when(k % 16 == 0, '"Pints"').otherwise('" SemesterHour "')), F.concat(F.lit('"course_non_credit": '), F.when(k % 24 == 4, "true").otherwise("false"))]
        out = F.when(kind == name, F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))).otherwise(out)
    return t.documents.where("text is not null and lang is not null").select("doc_id", "text", kind.alias("kind"), answers.parsed(out).alias("answer"))


_LINE = "string_split(text, chr(10))"
_PRE = r"regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"
_MADE = rf"""SELECT doc_id, text, CASE WHEN doc_id % 13 = 0 THEN 'OTHER' ELSE {list(_KINDS)}[doc_id % 4 + 1] END AS kind, CASE WHEN doc_id % 5 = 0 THEN '' ELSE lang END AS small,
    '  ' || {_LINE}[1] || ' ' AS name, CASE doc_id % 3 WHEN 0 THEN translate({_LINE}[-1], 'abcde', 'ABCDE') WHEN 1 THEN {_LINE}[-1] || ' zzz' ELSE {_LINE}[-1] END AS long FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL"""
_ENTITY = rf"""SELECT *, kind IN ('COMPETENCIES', 'CREDENTIALS') AS neat, CASE WHEN neat THEN trim(small) ELSE small END AS s0, CASE WHEN neat THEN trim(name) ELSE name END AS n0, CASE WHEN neat THEN trim(long) ELSE long END AS l0,
    CASE WHEN kind = 'COMPETENCIES' AND s0 = '' THEN NULL ELSE s0 END AS s, CASE WHEN kind = 'COMPETENCIES' AND n0 = '' THEN NULL ELSE n0 END AS n, l0 AS l FROM ({_MADE})"""


@query(rf"""SELECT doc_id, kind, CASE WHEN kind <> 'OTHER' THEN md5(coalesce(s, '~') || '|' || coalesce(n, '~') || '|' || coalesce(l, '~')) END AS fields, CASE WHEN kind = 'COURSES' AND doc_id % 8 <> 0 THEN 3.5 END AS credits,
    CASE WHEN kind = 'COURSES' AND doc_id % 16 <> 0 AND doc_id % 24 <> 4 THEN 'SemesterHour' END AS credits_type FROM ({_ENTITY})""")
def b25_entities_by_type(t):
    """Answers made into entities, by the rules of their type; an unknown type has none."""
    given = _answers(t)
    by = {k: answers.entity(F.col("answer"), k) for k in _KINDS}
    shown = {"COURSES": ("course_id", "course_name", "course_description"), "LEARNING_PROGRAMS": ("learning_program_id", "learning_program_name", "learning_program_description"), "COMPETENCIES": ("competency_category", "competency_framework", "text"), "CREDENTIALS": ("credential_type", "credential_name", "credential_description")}
    digest = F.lit(None).cast("string")
    for k, names in shown.items():
        digest = F.when(F.col("kind") == k, F.md5(F.array_join(F.array(*(by[k][n] for n in names)), "|", "~"))).otherwise(digest)
    course = F.col("kind") == "COURSES"
    return given.select("doc_id", "kind", digest.alias("fields"), F.when(course, by["COURSES"]["course_credits_min"]).alias("credits"), F.when(course, by["COURSES"]["course_credits_type"]).alias("credits_type"))


@query(rf"""WITH e AS (SELECT *, {_PRE.format("text")} AS p FROM ({_ENTITY}) WHERE kind <> 'OTHER'), i AS (SELECT *, contains(p, {_PRE.format("s")}) AS si, contains(p, {_PRE.format("n")}) AS ni, contains(p, {_PRE.format("l")}) AS li,
      CASE WHEN kind = 'COURSES' THEN contains(p, 'false') END AS fi, CASE WHEN kind = 'COURSES' AND doc_id % 24 = 4 THEN contains(p, 'true') END AS gi, CASE WHEN kind = 'COURSES' AND doc_id % 8 <> 0 THEN contains(p, '35') END AS ci,
      CASE WHEN kind = 'COURSES' AND doc_id % 16 <> 0 AND doc_id % 24 <> 4 THEN contains(p, 'semesterhour') END AS ti FROM e),
    f AS (SELECT *, [si, ni, li, CASE WHEN doc_id % 24 = 4 THEN gi ELSE fi END, ci, ti] AS flags FROM i)
    SELECT doc_id, kind, printf('%.2f', len(list_filter(flags, lambda x: x)) / len(list_filter(flags, lambda x: x IS NOT NULL)) * 100) AS average, coalesce(ni, true) AND li AND (kind = 'COMPETENCIES' OR coalesce(si, true)) OR kind = 'COMPETENCIES' AND li AS passed FROM f""")
def b27_verified_entities(t):
    """From answer to entity to verdict in one plan: which fields the document bears out, the average that an export
    shows, and whether the required ones are all there."""
    given, out = _answers(t), []
    for k in _KINDS:
        found = answers.inclusion(F.col("text"), answers.entity(F.col("answer"), k))
        rows = given.where(F.col("kind") == k).select("doc_id", "kind", found.alias("found"))
        out.append(rows.select("doc_id", "kind", exports.average(F.col("found")).alias("average"), answers.passes(F.col("found"), k).alias("passed")))
    return reduce(lambda a, b: a.unionByName(b), out)


def _of(name: str, k: int) -> str:
    return ORACLE_SQL[name].replace("FROM part", f"FROM (SELECT * FROM part WHERE p_size % 5 = {k})")


@query(f"""SELECT 'COURSES' AS kind, * FROM ({_of("b40_course_rows", 0)}) UNION ALL BY NAME SELECT 'LEARNING_PROGRAMS' AS kind, * FROM ({_of("b41_program_rows", 1)})
    UNION ALL BY NAME SELECT 'CREDENTIALS' AS kind, * FROM ({_of("b43_credential_rows", 2)}) UNION ALL BY NAME SELECT 'COMPETENCIES' AS kind, * FROM ({_of("b42_competency_rows", 3)})
    UNION ALL BY NAME SELECT 'OTHER' AS kind, 'Unknown catalogue type: OTHER' AS error FROM part WHERE p_size % 5 = 4""")
def b46_whole_rows(t):
    """A whole row by each item's type, with all types' columns side by side; an unknown type gives its error alone."""

    class Some:
        """The tables, with the items of one type."""

        def __init__(self, k: int):
            self.part = t.part.where(F.col("p_size") % 5 == k)

    by = {"COURSES": ("b40_course_rows", 0), "LEARNING_PROGRAMS": ("b41_program_rows", 1), "CREDENTIALS": ("b43_credential_rows", 2), "COMPETENCIES": ("b42_competency_rows", 3)}
    rows = [QUERIES[name].plain(Some(k)).withColumn("kind", F.lit(kind)) for kind, (name, k) in by.items()]
    rows.append(t.part.where("p_size % 5 = 4").select(F.lit("OTHER").alias("kind"), F.lit("Unknown catalogue type: OTHER").alias("error")))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)


@query(f"""WITH e AS (SELECT *, event_id % 7 AS k FROM events) SELECT event_id, CASE WHEN k = 0 OR event_type IN ('error', 'signup') THEN NULL WHEN event_type = 'view' THEN 'DETAIL' WHEN event_type = 'click' THEN 'DETAIL_LINKS' ELSE 'CATEGORY_LINKS' END AS page_type,
    CASE WHEN k <> 0 AND event_type = 'view' THEN 'CREDENTIALS' END AS catalogue_type, CASE WHEN k <> 0 AND event_type NOT IN ('view', 'error') THEN 'bad value for catalogue_type' END AS catalogue_error,
    CASE k WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN true WHEN 4 THEN false END AS several, CASE WHEN k > 4 THEN 'bad value for multiple_courses' END AS several_error,
    k = 3 AS present, CASE WHEN k IN (1, 2, 3) THEN CASE k WHEN 1 THEN 12.0 WHEN 2 THEN 3.0 ELSE 2.5 END END AS expected,
    CASE k WHEN 0 THEN 'no expression' WHEN 4 THEN 'bad value for regexp' WHEN 5 THEN 'bad value for expected_course_count' WHEN 6 THEN 'bad value for first_course_title' END AS split_error FROM e""")
def b29_answers(t):
    """Answers of five classifiers, good and bad in each of the ways that the checks tell apart."""
    k, kind = F.col("event_id") % 7, F.col("event_type")

    def by(*said):
        return F.element_at(F.array(*map(F.lit, said)), (k + 1).cast("int"))

    pages = F.when(kind == "view", "DETAIL").when(kind == "click", "DETAIL_LINKS").when(kind == "purchase", "CATEGORY_LINKS").otherwise(kind)
    types = F.when(kind == "view", '"CREDENTIALS"').when(kind == "error", "null").otherwise('"PETS"')
    several, present = by("", '"Yes"', '"null"', "true", "false", '"maybe"', "1"), by("", "null", '"true"', "true", "false", "1", "0")
    regexp, count = by("", '"a+"', '""', '"(?=x)"', "5", '"x"', '"x"'), by("", '"12"', "3", "2.5", "1", '"3 or 4"', "4")
    title = by("", '"T"', '""', '"x y"', '"z"', '"z"', "null")
    parts = {"page_type": F.concat(F.lit('"'), pages, F.lit('"')), "catalogue_type": types, "multiple_courses": several, "present": present, "regexp": regexp, "expected_course_count": count, "first_course_title": title}
    body = F.concat(F.lit("{"), F.concat_ws(", ", *(F.concat(F.lit(f'"{n}": '), c) for n, c in parts.items())), F.lit("}"))
    x = answers.parsed(F.when(k > 0, body).otherwise("not JSON {"))
    split, catalogue, courses = answers.split_expression(F.col("x")), answers.catalogue_type(F.col("x")), answers.several_courses(F.col("x"))
    return t.events.select("event_id", x.alias("x")).select("event_id", answers.page_type(F.col("x")).alias("page_type"), catalogue["value"].alias("catalogue_type"), catalogue["error"].alias("catalogue_error"), courses["value"].alias("several"), courses["error"].alias("several_error"), answers.is_present(F.col("x")).alias("present"), split["expected"].alias("expected"), split["error"].alias("split_error"))


@query(r"""WITH c AS (SELECT user_id AS site, value, event_type, (k - 1) // 24 + 1 AS depth, (k - 1) % 24 AS j FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) WHERE k <= 72),
    r AS (SELECT site, depth, CASE WHEN j <= 13 THEN 0 WHEN j <= 19 THEN 1 ELSE 2 END AS level, CASE WHEN j <= 13 THEN 0 WHEN j < 19 THEN j - 13 WHEN j = 19 THEN 1 ELSE j - 19 END AS page,
        CASE WHEN j <= 6 THEN 'type' WHEN j <= 10 THEN 'pagination' WHEN j <= 13 THEN 'regexp' WHEN j = 19 THEN 'regexp' ELSE 'type' END AS task, CASE WHEN j <= 6 THEN j + 1 WHEN j <= 10 THEN j - 6 WHEN j <= 13 THEN j - 10 ELSE 1 END AS try,
        CASE WHEN j <= 6 THEN CASE WHEN value < 40 AND site % 7 <> 0 THEN 'CATEGORY_LINKS' WHEN value < 60 THEN 'DETAIL_LINKS' ELSE 'DETAIL' END WHEN j BETWEEN 7 AND 13 OR j = 19 THEN event_type
          WHEN j <= 18 THEN CASE WHEN value > 150 THEN 'DETAIL_LINKS' ELSE ['CATEGORY_LINKS', 'CATEGORY_LINKS', 'DETAIL', 'DETAIL_LINKS'][(site + depth) % 4 + 1] END ELSE CASE WHEN site % 5 = 0 THEN 'DETAIL_LINKS' ELSE 'DETAIL' END END AS answer FROM c),
    n AS (SELECT site, depth, level, page, task, answer, count(*) AS n, max(try) AS reached FROM r GROUP BY ALL), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site, depth, level, page, task ORDER BY n DESC, reached) AS place FROM n) WHERE place = 1),
    t AS (SELECT site, depth, level, min(answer) FILTER (task = 'type') AS lo, max(answer) FILTER (task = 'type') AS hi, any_value(answer) FILTER (task = 'regexp') AS re, any_value(answer) FILTER (task = 'pagination') AS pg FROM b GROUP BY ALL),
    s AS (SELECT z.site, z.depth, z.lo AS t0, coalesce(z.re, '') AS r0, coalesce(z.pg, '') AS p, o.lo AS t1, o.hi AS h1, coalesce(o.re, '') AS r1, w.lo AS t2, w.hi AS h2 FROM t z LEFT JOIN t o ON o.site = z.site AND o.depth = z.depth AND o.level = 1 LEFT JOIN t w ON w.site = z.site AND w.depth = z.depth AND w.level = 2 WHERE z.level = 0),
    e AS (SELECT *, CASE WHEN t0 = 'DETAIL' THEN NULL WHEN t1 IS NULL THEN 'links: no results' WHEN t1 <> h1 THEN 'links: mixed results' WHEN t0 = 'DETAIL_LINKS' AND t1 <> 'DETAIL' THEN 'links: expected details, found ' || t1 WHEN t1 = 'DETAIL' THEN NULL
        WHEN t2 IS NULL THEN 'links of links: no results' WHEN t2 <> h2 THEN 'links of links: mixed results' WHEN t1 = 'DETAIL_LINKS' AND t2 <> 'DETAIL' THEN 'links of links: expected details, found ' || t2 WHEN t1 = 'CATEGORY_LINKS' AND depth = 3 THEN 'categories too deep' END AS error,
        CASE WHEN t0 = 'DETAIL' THEN 'DETAIL||' || p ELSE t0 || '|' || r0 || '|' || p || ' > ' || t1 || '|' || CASE WHEN t1 = 'DETAIL' THEN '' ELSE r1 END || '|' || p || CASE WHEN t1 = 'DETAIL' THEN '' ELSE ' > ' || t2 || '||' || p END END AS levels FROM s),
    f AS (SELECT *, error IS NULL AND t0 <> 'DETAIL' AND t1 = 'CATEGORY_LINKS' AS again FROM e),
    g AS (SELECT a.site, CASE WHEN a.error IS NOT NULL THEN a.error WHEN NOT a.again THEN NULL WHEN b.site IS NULL THEN 'no page type' WHEN b.error IS NOT NULL THEN b.error WHEN NOT b.again THEN NULL WHEN c.site IS NULL THEN 'no page type' ELSE c.error END AS error,
        a.levels || CASE WHEN a.again THEN ' >> ' || b.levels || CASE WHEN b.again THEN ' >> ' || c.levels ELSE '' END ELSE '' END AS configuration
        FROM f a LEFT JOIN f b ON b.site = a.site AND b.depth = 2 LEFT JOIN f c ON c.site = a.site AND c.depth = 3 WHERE a.depth = 1)
    SELECT site, CASE WHEN site % 11 = 0 THEN 'vendor' END AS provider, CASE WHEN site % 11 <> 0 AND error IS NULL THEN configuration END AS configuration, CASE WHEN site % 11 <> 0 THEN error END AS error FROM g""")
def b_det_recursive(t):
    """Recorded answers about each site's pages, up to three steps of categories deep, made into a configuration or the
    reason why there is none."""
    from quarry.operators import detection, retries

    j, value, site, depth = F.col("j"), F.col("value"), F.col("site"), F.col("depth")
    calls = retries.first_calls(t.events.select(F.col("user_id").alias("site"), "event_id", "event_type", "value"), "site", "event_id", 72, "k")
    calls = calls.select("site", "event_type", "value", F.expr("(k - 1) div 24 + 1").cast("int").alias("depth"), F.expr("(k - 1) % 24").alias("j"))
    below = F.element_at(F.array(*map(F.lit, ("CATEGORY_LINKS", "CATEGORY_LINKS", "DETAIL", "DETAIL_LINKS"))), ((site + depth) % 4 + 1).cast("int"))
    told = j.between(7, 13) | (j == 19)
    answer = (
        F.when(told, F.col("event_type"))
        .when(j <= 6, F.when((value < 40) & (site % 7 != 0), "CATEGORY_LINKS").when(value < 60, "DETAIL_LINKS").otherwise("DETAIL"))
        .when(j <= 18, F.when(value > 150, "DETAIL_LINKS").otherwise(below))
        .otherwise(F.when(site % 5 == 0, "DETAIL_LINKS").otherwise("DETAIL"))
    )
    level = F.when(j <= 13, 0).when(j <= 19, 1).otherwise(2)
    page = F.when(j <= 13, 0).when(j < 19, j - 13).when(j == 19, 1).otherwise(j - 19)
    task = F.when(j.between(7, 10), "pagination").when(told, "regexp").otherwise("type")
    tried = F.when(j <= 6, j + 1).when(j <= 10, j - 6).when(j <= 13, j - 10).otherwise(1)
    providers = t.events.where("user_id % 11 = 0").select(F.col("user_id").alias("site"), F.lit("vendor").alias("provider")).distinct()
    return detection.configured(calls.select("site", "depth", level.alias("level"), page.alias("page"), task.alias("task"), tried.alias("try"), answer.alias("answer")), providers)
