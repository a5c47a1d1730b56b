"""robots.txt: parsed by lines into rules and sitemaps; a rule's patterns as one expression for each kind."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F

SCHEMA = "rules array<struct<agent:string,allow:array<string>,disallow:array<string>,sitemaps:array<string>,delay:double>>, sitemaps array<string>"
#: The number that a delay begins with; an infinite one is none, as nobody can wait for it.
NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")
RULE = "agent string, allow string, disallow string, delay double, error string"


def parse(text: str) -> dict:
    """Of grouped agents only the last keeps the rules that follow; fields without a value, and agents without rules,
    are ignored."""
    rules, sitemaps, now = [], [], None

    def close() -> None:
        if now and (now["allow"] or now["disallow"] or now["delay"] is not None):
            rules.append(now)

    for line in (text or "").split("\n"):
        field, colon, value = line.partition("#")[0].strip().partition(":")
        field, value = field.strip().lower(), value.strip()
        if not colon or not value:
            continue
        if field == "user-agent":
            close()
            now = {"agent": value, "allow": [], "disallow": [], "sitemaps": [], "delay": None}
        elif field == "sitemap":
            sitemaps.append(value)
            if now:
                now["sitemaps"].append(value)
        elif now and field in ("allow", "disallow"):
            now[field].append(value)
        elif now and field == "crawl-delay" and (number := NUMBER.match(value)) and abs(float(number[0])) < float("inf"):
            now["delay"] = float(number[0])
    close()
    return {"rules": rules, "sitemaps": sitemaps}


def rule_for(robots: dict, agent: str = "*") -> dict | None:
    """The first rule of the agent; else the last one for all agents."""
    own = next((r for r in robots["rules"] if r["agent"] == agent), None)
    return own or next((r for r in reversed(robots["rules"]) if r["agent"] == "*"), None)


def expression(pattern: str) -> str:
    """A pattern as a regular expression: points are letters, stars stand for anything, ``$`` is the end, and what else
    means something in an expression does so here. It begins at the path's start unless it begins with a star."""
    body = re.sub(r"[.*$]", lambda m: {".": r"\.", "*": ".*", "$": r"\Z"}[m[0]], pattern)
    if re.search(r"(?<!\\)[+?}]\+", body):
        raise re.error("nothing to repeat")
    re.compile(body)
    return f"(?:{body})" if pattern.startswith("*") else f"\\A(?:{body})" if "|" not in body else f"(?:\\A{body})"


def combined(robots: dict, agent: str = "*") -> dict:
    """The agent's rule with its patterns as one expression for each kind, so a path is read once for each kind however
    many patterns there are; or what is wrong with the first bad one."""
    rule = rule_for(robots, agent)
    out = {"agent": rule and rule["agent"], "allow": None, "disallow": None, "delay": rule and rule["delay"], "error": None}
    try:
        for kind in ("allow", "disallow"):
            if rule and rule[kind]:
                out[kind] = "|".join(map(expression, rule[kind]))
    except re.error as e:
        out |= {"allow": None, "disallow": None, "error": f"bad pattern: {e}"}
    return out


_compiled = lru_cache(1 << 12)(re.compile)


def permits(path: str, allow: str | None, disallow: str | None) -> bool:
    """No disallow: allowed. What an allow pattern fits is allowed; else no disallow pattern may fit."""
    if disallow is None or (allow and _compiled(allow).search(path)):
        return True
    return not _compiled(disallow).search(path)


def combined_for(agent: str = "*"):
    """A column function: the text of a robots.txt to RULE."""

    def batch(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([combined(parse(t), agent) for t in text], columns=["agent", "allow", "disallow", "delay", "error"])

    batch.__annotations__ = {"text": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(batch, RULE)


def permitted():
    """A column function: path and the two expressions to whether a page may be fetched."""

    def batch(path: pd.Series, allow: pd.Series, disallow: pd.Series) -> pd.Series:
        return pd.Series([permits(*x) for x in zip(path, allow, disallow, strict=True)], dtype="bool")

    batch.__annotations__ = {"path": pd.Series, "allow": pd.Series, "disallow": pd.Series, "return": pd.Series}
    return F.pandas_udf(batch, "boolean")


def parsed():
    """A column function: the text of a robots.txt to its rules and sitemaps."""

    def batch(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(t) for t in text], columns=["rules", "sitemaps"])

    batch.__annotations__ = {"text": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(batch, SCHEMA)
