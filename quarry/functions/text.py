"""Text, domain and number expressions; all column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

LINK = r"\[([^\]]*)\]\(([^)]+)\)"


def preprocess(c: Column) -> Column:
    """Lower case, links replaced by their text (not images), then letters a-z and digits only."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"(?<!!)\[([^\]]+)\]\([^)]*\)", "$1"), "[^a-z0-9]", "")


def included(page: Column, value: Column) -> Column:
    """Whether a value occurs in the page once both are preprocessed; a blank value always does."""
    return preprocess(page).contains(preprocess(value))


#: What a point may follow without ending a sentence.
ABBREVIATIONS = ("Mr", "Mrs", "Ms", "Dr", "Prof", "St", "vs", "etc", "No", "Inc", "Ltd", "Co", "e.g", "i.e")
#: The end of a sentence: its marks with closing quotes or brackets, then white space.
SENTENCE_END = r"([.!?]+[\"')\]]*)[ \t\n\r]+"


def sentences(c: Column) -> Column:
    """The sentences of a text, in order, trimmed. Lines end sentences; the point of an abbreviation doesn't."""
    point, cut = "\x01", "\x02"
    names = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    marked = F.regexp_replace(c, rf"(^|[^A-Za-z])({names})\.", f"$1$2{point}")
    parts = F.split(F.regexp_replace(marked, SENTENCE_END, f"$1{cut}"), f"[{cut}\n\r]")
    return F.filter(F.transform(parts, lambda s: F.btrim(F.translate(s, point, "."))), lambda s: s != "")


def sentences_held(page: Column, value: Column) -> Column:
    """Whether each sentence of a value is one of the page's; a value without sentences has none that isn't."""
    return F.size(F.array_except(sentences(value), sentences(page))) == 0


def passes(flags: dict[str, tuple[Column, Column]], required: list[str], phrases: dict[str, Column] | None = None) -> Column:
    """flags: field to (value, included). Every required field is absent or included, and every field that must be held
    in whole phrases has its flag: an absent one has none."""
    out = F.lit(True)
    for f in required:
        value, full = flags[f]
        out = out & (value.isNull() | full)
    for held in (phrases or {}).values():
        out = out & F.coalesce(held, F.lit(False))
    return out


def strip_non_alphanumeric(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-z0-9.\-\s;\\,]", "")


#: Fixed value: what a domain is given with, case as written, and what may follow it; other spellings stay as they are.
DOMAIN_PARTS = r"^(?:https?://)?([^/]*).*$"


def normalize_domain(c: Column) -> Column:
    """The host part of what is given, lower case, less one leading ``www.`` that is written so."""
    found = F.regexp_extract(F.trim(c), "(?s)" + DOMAIN_PARTS, 1)
    return F.lower(F.when(found.startswith("www."), F.substring(found, F.lit(5), F.length(found))).otherwise(found))


def valid_domain(c: Column) -> Column:
    """Two labels at least, each of letters, digits and hyphens only; the first doesn't begin with a hyphen."""
    labels = F.split(c, r"\.")
    return (F.size(labels) > 1) & F.forall(labels, lambda x: x.rlike("^[A-Za-z0-9-]+$")) & ~c.startswith("-")


def parse_domains(c: Column) -> Column:
    """Split at commas and line ends; normalised, distinct, not empty."""
    return F.array_distinct(F.filter(F.transform(F.split(c, "[,\n]"), normalize_domain), lambda d: d != ""))


def parse_number(c: Column) -> Column:
    """The number that a text begins with, or null."""
    return F.regexp_extract(c, r"^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)", 1).try_cast("double")


def domain_match(domain: Column, host: Column) -> Column:
    """3 the same, 2 one is a subdomain of the other, 1 the host contains the domain, else 0."""
    return F.when(domain == host, 3).when(host.endswith(F.concat(F.lit("."), domain)) | domain.endswith(F.concat(F.lit("."), host)), 2).when(host.contains(domain), 1).otherwise(0)


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / greater length; null for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, (longest - F.levenshtein(a, b)) / longest)


def cosine(a: Column, b: Column) -> Column:
    """In doubles; 0 if either norm is 0."""
    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def page_urls(pattern: Column, total: Column, start: Column | None = None, kind: Column | None = None) -> Column:
    """A struct: urls of numbered pages, the first {page_num} replaced, none when total is below 1; or an error (and
    null urls) for a blank pattern or one without the placeholder. kind: offset has no pages; null is page_num."""
    first = F.lit(1) if start is None else F.coalesce(start, F.lit(1))
    pattern = F.trim(pattern)
    offset = F.lit(False) if kind is None else F.coalesce(kind == "offset", F.lit(False))
    at = F.instr(pattern, "{page_num}")
    error = F.when(pattern.isNull() | (pattern == ""), "blank pattern").when(~offset & (at == 0), "pattern has no {page_num}")
    head, tail = F.substring(pattern, F.lit(1), at - 1), F.substring(pattern, at + len("{page_num}"), F.length(pattern))
    none = F.array().cast("array<string>")
    numbered = F.transform(F.sequence(first, first + total - 1), lambda n: F.concat(head, n.cast("string"), tail))
    return F.struct(F.when(error.isNull(), F.when(~offset & (total >= 1), numbered).otherwise(none)).alias("urls"), error.alias("error"))


def should_notify(preference: Column, is_own: Column) -> Column:
    p = F.coalesce(preference, F.lit("ALWAYS"))
    return (p == "ALWAYS") | ((p == "MINE") & F.coalesce(is_own, F.lit(False)))


def percent(part: Column, whole: Column) -> Column:
    """Floor of the ratio in percent; 0 for a whole of 0."""
    return F.when(whole > 0, F.floor(part / whole * 100)).otherwise(F.lit(0)).cast("long")


def mask_proxy(c: Column) -> Column:
    return F.regexp_replace(c, r"^(?:[a-z]+://)?([^:@/]+):[^@]*@", "$1:******@")


def file_name(c: Column) -> Column:
    """Other characters become one underscore, none at the ends, 50 characters."""
    return F.substring(F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""), 1, 50)


def day_bounds(first: Column, last: Column) -> tuple[Column, Column]:
    """The first and the last millisecond of a span of days given as dates."""
    return F.to_timestamp(F.concat(first, F.lit(" 00:00:00"))), F.to_timestamp(F.concat(last, F.lit(" 23:59:59.999")))


def robots_allows(path: Column, allow: Column, disallow: Column) -> Column:
    """No disallow: allowed. Any allow pattern that fits wins; else none of the disallow patterns may fit."""
    def fits(p):
        body = F.regexp_replace(F.regexp_replace(p, r"\.", "\\\\."), r"\*", ".*")
        return F.regexp_like(path, F.when(p.startswith("*"), body).otherwise(F.concat(F.lit("^"), body)))

    return (F.size(disallow) == 0) | F.exists(allow, fits) | ~F.exists(disallow, fits)
