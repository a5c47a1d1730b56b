"""What a recipe is checked by, and what is shown of it: column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quarry.functions import urls

#: Fixed value: the longest wait of a setup step, in seconds.
LONGEST_WAIT = 600


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def meta(html: Column, name: str) -> Column:
    return blank_to_null(F.regexp_extract(html, rf'(?i)<meta[^>]*name="{name}"[^>]*content="([^"]*)"', 1))


def preview(url: Column, html: Column) -> dict[str, Column]:
    """title, description and thumbnail of a page; null where it has none."""
    title = blank_to_null(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1))
    image = F.coalesce(meta(html, "og:image"), blank_to_null(F.regexp_extract(html, r'(?i)<img[^>]*\ssrc="([^"]*)"', 1)))
    return {"title": F.coalesce(title, meta(html, "og:title")), "description": meta(html, "og:description"), "thumbnail": urls.resolve(url, image)}


def pagination_error(paginated: Column, kind: Column, pattern: Column, content: Column, start: Column) -> Column:
    """Why an answer about pagination can't be used; null for a good one and for none. start: null is page 1."""
    bare = F.regexp_replace(pattern, r"\{(page_num|offset)\}", "")
    path = F.regexp_extract(bare, "^https?://[^/?#]*([^?#]*)", 1)
    path = F.when(~bare.rlike("^https?://"), F.concat(F.lit("/"), bare)).when(path == "", "/").otherwise(path)
    first = F.coalesce(start, F.lit(1))
    return (
        F.when(~F.coalesce(paginated, F.lit(False)), F.lit(None).cast("string"))
        .when(kind == "other", "unknown pagination type")
        .when(~pattern.startswith("http"), "pattern is not a URL")
        .when(~pattern.contains(F.concat(F.lit("{"), kind, F.lit("}"))), "pattern has no placeholder")
        .when(~content.contains(path), "path not found in the page")
        .when((first < 0) | (first != F.floor(first)), "bad start page")
    )


def setup_error(kind: Column, selector: Column, seconds: Column) -> Column:
    """Why a step before reading a page can't be run; null for a good one."""
    no_wait = seconds.isNull() | F.isnan(seconds) | (seconds <= 0) | (seconds > LONGEST_WAIT)
    return (
        F.when((kind == "click") & (F.trim(F.coalesce(selector, F.lit(""))) == ""), "empty selector")
        .when((kind == "wait") & no_wait, "bad seconds")
        .when(~F.coalesce(kind.isin("click", "wait"), F.lit(False)), "unknown step")
    )


def finds_all(examples: Column, regexp: str) -> Column:
    """Whether the expression finds every example."""
    return F.forall(examples, lambda x: x.rlike(regexp))


def prompt(kind: str, fields: list[str], url: Column, content: Column) -> Column:
    """What a model is asked about a page, from the definition of what is looked for."""
    return F.concat(F.lit(f"Find every {kind} on the page "), url, F.lit(f"\nFields: {', '.join(fields)}\nPage:\n"), content)


def title_case(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), " ")


def concise_date(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm")
