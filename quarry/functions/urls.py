"""URL algebra and answers of servers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: What a status code is called.
HTTP_MESSAGES = {400: "Bad Request", 401: "Unauthorized", 403: "Forbidden", 404: "Not Found", 407: "Proxy related error", 500: "Webpage server error", 502: "Bad Gateway", 503: "Service Unavailable", 504: "Gateway Timeout"}
#: What says that a proxy, not the page, failed.
PROXY_STATUS = (402, 403, 407)
PROXY_ERRORS = ("net::ERR_TUNNEL_CONNECTION_FAILED", "net::ERR_CONNECTION_REFUSED")


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def host(url: Column) -> Column:
    """Lower case, without user and port."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def without_dots(path: Column) -> Column:
    """``.`` and ``..`` segments resolved; a path that ends in one of these ends in a slash."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    none = F.array().cast("array<string>")
    kept = F.aggregate(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), none, lambda done, p: F.when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(p == ".", done).otherwise(F.array_append(done, p)))
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise(""))


def resolve(base: Column, link: Column) -> Column:
    """``link`` as a browser at ``base`` would take it; null where neither is absolute."""
    link, root = F.trim(link), origin(base)
    rest, path = F.regexp_extract(link, r"^[^?#]*(.*)$", 1), F.regexp_extract(link, r"^([^?#]*)", 1)
    base_path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    base_path = F.when(base_path == "", "/").otherwise(base_path)
    folder = F.regexp_extract(base_path, r"^(.*/)", 1)
    query = F.regexp_extract(base, r"(\?[^#]*)", 1)
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(root == "", F.lit(None).cast("string"))
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, "^([^:]*:)", 1), link))
        .when(link.startswith("/"), F.concat(root, without_dots(path), rest))
        .when(link.startswith("?"), F.concat(root, base_path, link))
        .when((link == "") | link.startswith("#"), F.concat(root, base_path, query, link))
        .otherwise(F.concat(root, without_dots(F.concat(folder, path)), rest))
    )


def http_message(status: Column) -> Column:
    out = F.when(F.lit(False), "")
    for code, said in HTTP_MESSAGES.items():
        out = out.when(status == code, said)
    return out.otherwise(F.concat(F.lit("HTTP "), status.cast("string")))


def is_proxy_error(status: Column, message: Column) -> Column:
    said = F.lit(False)
    for m in PROXY_ERRORS:
        said = said | F.coalesce(message.contains(m), F.lit(False))
    return F.coalesce(status.isin(*PROXY_STATUS), F.lit(False)) | said


def matches_pattern(url: Column, pattern: Column, params: list[str]) -> Column:
    """Same origin and path, and each of ``params`` that the pattern has is the same, or a ``{placeholder}`` there."""
    def bare(u):
        return F.regexp_extract(u, "^([^?#]*)", 1)

    out = bare(url) == bare(pattern)
    for p in params:
        want, got = (F.regexp_extract(u, rf"[?&]{p}=([^&#]*)", 1) for u in (pattern, url))
        out = out & ((want == "") | (got == want) | (want.rlike(r"^\{.*\}$") & (got != "")))
    return out


def as_bool(c: Column) -> Column:
    """yes or true; no, false or null (the word): anything else is null."""
    c = F.lower(c)
    return F.when(c.isin("yes", "true"), True).when(c.isin("no", "false", "null"), False)


def as_count(c: Column) -> Column:
    """Digits only; decimals and signs are null."""
    return F.when(c.rlike("^[0-9]+$"), c.try_cast("long"))


def sealed(c: Column, key: Column) -> Column:
    """AES-CBC with a fresh vector, in hexadecimal."""
    return F.hex(F.aes_encrypt(c, key, F.lit("CBC"), F.lit("PKCS")))


def opened(c: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unhex(c), key, F.lit("CBC"), F.lit("PKCS")).cast("string")


def setting(value: Column, is_sealed: Column, open_it: Column, path: str) -> Column:
    """What is shown of a setting: ``[redacted]`` of a sealed one that is not to be opened, else its JSON value."""
    return F.when(is_sealed & ~open_it, "[redacted]").otherwise(F.get_json_object(value, path))
