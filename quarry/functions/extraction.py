"""Links, entities and checks of an extraction, as column expressions over pages and recorded answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarry.functions import text, urls

#: Kinds of credit that a course may be given with, by name.
CREDIT_TYPES = ("AcademicYear", "CarnegieUnit", "CertificateCredit", "ClockHour", "CompetencyCredit", "ContactHour", "DegreeCredit", "DualCredit", "QuarterHour", "RequirementCredit", "SecondaryDiplomaCredit", "SemesterHour", "TimeBasedCredit", "TypeBasedCredit")
#: The least wait between two fetches of a host in milliseconds, and more than so many tokens may be cut.
INTERVAL_MS, CHUNK_TOKENS = 3000, 1000


def kept_first(c: Column, key=lambda x: x) -> Column:
    """An array without those whose key came before, in its order."""
    keys = F.transform(c, key)
    return F.filter(c, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def page_links(markdown: Column, regexp: Column, base: Column, exact: Column) -> Column:
    """URLs that a recipe's expression finds: an absolute match as it is; else the first Markdown link's URL that holds
    it (exact: a dot and the match); else resolved. Each once, in the order found."""
    linked = F.regexp_extract_all(markdown, F.lit(text.LINK), F.lit(2))

    def taken(m: Column) -> Column:
        inside = F.try_element_at(F.filter(linked, lambda u: u.contains(m)), F.lit(1))
        return F.when(m.rlike("^https?://"), m).when(inside.isNotNull(), F.when(exact, F.concat(F.lit("."), m)).otherwise(inside)).otherwise(urls.resolve(base, m))

    return F.array_distinct(F.transform(F.regexp_extract_all(markdown, regexp, F.lit(0)), taken))


def normal_url(url: Column) -> Column:
    """Scheme and host in lower case, a path at least of a slash; null where there is no host."""
    start = F.lower(urls.origin(url))
    rest = F.substring(url, F.length(start) + 1, F.length(url))
    return F.when(start.rlike("://.+"), F.concat(start, F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))))


def explored(found: Column, page: Column, base: Column, same_host: Column) -> Column:
    """Of the URLs that an answer names those that the page's text holds, resolved, on its host if asked for, each once."""
    there = F.filter(found, lambda u: (u != "") & page.contains(u))
    full = F.transform(there, lambda u: urls.resolve(base, u))
    return F.array_distinct(F.filter(full, lambda u: u.isNotNull() & (~same_host | (urls.host(u) == urls.host(base)))))


def page_count(answer: Column, total: Column) -> Column:
    """A struct: the pages that the answer counts, else those of the recipe; and an error where neither is a number from 1 on."""
    n = F.coalesce(answer.try_cast("double"), total.cast("double"))
    bad = n.isNull() | F.isnan(n) | (F.abs(n) == float("inf")) | (n < 1)
    return F.struct(F.when(~bad, F.floor(n)).cast("long").alias("pages"), F.when(bad, "bad page count").alias("error"))


def base_url(parent: Column, recipe: Column) -> Column:
    """The first page of the parent step, else the recipe's URL; a relative one is resolved against the recipe's."""
    return F.coalesce(urls.resolve(recipe, F.when(parent != "", parent)), recipe)


def interval_ms(has_rule: Column, allowed: Column, delay: Column) -> Column:
    return F.when(F.coalesce(has_rule & allowed & (delay > 0), F.lit(False)), (delay * 1000).cast("long")).otherwise(F.lit(INTERVAL_MS).cast("long"))


def should_chunk(kind: Column, tokens: Column, several: Column) -> Column:
    """Courses only, beyond the limit of tokens, if the answer says that there are several; no answer counts as yes."""
    return (kind == "COURSES") & (tokens > CHUNK_TOKENS) & F.coalesce(several, F.lit(True))


def chunks(content: Column, separator: str, first_title: Column, expected: Column) -> Column:
    """A struct: the parts of a page from the one on that holds the first title, without blank ones; whether their
    number is within a tenth of the expected one."""
    parts = F.filter(F.split(content, separator), lambda c: F.trim(c) != "")
    title = text.preprocess(first_title)
    holds = F.transform(parts, lambda c: text.preprocess(c).contains(title))
    at = F.array_position(holds, True)
    kept = F.when(at > 0, F.slice(parts, at, F.greatest(F.size(parts), F.lit(1)))).otherwise(F.slice(parts, 1, 0))
    return F.struct(kept.alias("chunks"), (F.abs(F.size(kept) - expected) <= expected * 0.1).alias("accepted"))


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def course_entity(e: dict[str, Column]) -> dict[str, Column]:
    """Required fields stay as they are, others are null when blank; credits are read from texts; a type that isn't
    listed, or of a course without credit, is none."""
    given = F.trim(e["course_credits_type"])
    kind = F.when(given.isin(*CREDIT_TYPES), given)
    return {
        **{k: e[k] for k in ("course_id", "course_name", "course_description")},
        "course_prerequisites": blank_to_null(e["course_prerequisites"]),
        "course_credits_type": F.when(~F.coalesce(e["course_non_credit"], F.lit(False)), kind),
        "course_credits_min": text.parse_number(e["course_credits_min"]),
        "course_credits_max": text.parse_number(e["course_credits_max"]),
    }


def complete(required: list[Column]) -> Column:
    """Whether all required values are given: not null, not empty."""
    out = F.lit(True)
    for c in required:
        out = out & (F.coalesce(c, F.lit("")) != "")
    return out


def fetch_outcome(cancelled: Column, http: Column, message: Column) -> dict[str, Column]:
    """What a fetch makes of a page: its status, the reason, and whether the queue tries again. Client errors that are
    not the proxy's are for good."""
    good = (http >= 200) & (http < 400) & message.isNull()
    lasting = (http >= 400) & (http < 500) & ~urls.is_proxy_error(http, message)
    return {
        "status": F.when(cancelled, "WAITING").when(good, "DOWNLOADED").otherwise("ERROR"),
        "reason": F.when(~cancelled & ~good, F.coalesce(message, urls.http_message(http))),
        "again": ~cancelled & ~good & ~F.coalesce(lasting, F.lit(False)),
    }


def proxied(attempts: Column) -> Column:
    """attempts: structs of proxy, http, message in the order tried (direct first). The first that is not the proxy's
    fault decides; the last where all are."""
    settled = F.filter(attempts, lambda a: ~urls.is_proxy_error(a["http"], a["message"]))
    return F.coalesce(F.try_element_at(settled, F.lit(1)), F.try_element_at(attempts, F.lit(-1)))


def school_ids(html: Column, patterns: list[str]) -> Column:
    """The first captures of the patterns, without those that found none."""
    return F.filter(F.array(*(blank_to_null(F.regexp_extract(html, p, 1)) for p in patterns)), lambda x: x.isNotNull())


def same_multiset(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same values as often, in whatever order."""
    return F.sort_array(a) == F.sort_array(b)


def thousands(n: Column) -> Column:
    """1.5K from a thousand on, one decimal unless it is 0; smaller numbers as they are."""
    tenths = F.floor(n / 100)
    return F.when(n < 1000, n.cast("string")).otherwise(F.concat(F.floor(tenths / 10).cast("string"), F.when(tenths % 10 != 0, F.concat(F.lit("."), (tenths % 10).cast("string"))).otherwise(""), F.lit("K")))


def label(c: Column) -> Column:
    """LEARNING_PROGRAMS as Learning Programs."""
    return F.initcap(F.replace(F.lower(c), F.lit("_"), F.lit(" ")))


def joined_url(base: Column, path: Column) -> Column:
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"), F.regexp_replace(path, "^/+", ""))


def agreed(votes: DataFrame, key: str, answer: str) -> DataFrame:
    """key, answer where all answers of the key are one and the same; null, and an error, where they are not."""
    by = votes.groupBy(key).agg(F.min(answer).alias("low"), F.max(answer).alias("high"), F.count(F.lit(1)).alias("n"), F.count(answer).alias("given"))
    same = (F.col("low") == F.col("high")) & (F.col("n") == F.col("given"))
    return by.select(key, F.when(same, F.col("low")).alias(answer), F.when(~F.coalesce(same, F.lit(False)), "answers differ").alias("error"))
