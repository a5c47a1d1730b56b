"""Splitting a page by expressions that are tried one after the other, until one gives about as many parts as expected."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

#: Expressions that are tried for a page.
ATTEMPTS = 10
SPLIT = "attempt int, chunks array<string>, errors array<string>"


def plain(text: str) -> str:
    """As ``text.preprocess`` makes it."""
    return re.sub("[^a-z0-9]", "", re.sub(r"(?<!!)\[([^\]]+)\]\([^)]*\)", r"\1", text.lower()))


def tolerance(expected: int) -> int:
    """Few parts must be exactly as many; of more, a tenth may be missing or too many."""
    return expected // 10 if expected > 5 else 0


def parts_of(content: str, expression: str, first_title: str | None) -> list[str]:
    """The parts that aren't blank, from the first one on that has the first title; none where no part has it."""
    parts = [p for p in re.split(expression, content) if p and p.strip()]
    title = plain(first_title or "")
    at = next((i for i, p in enumerate(parts) if title in plain(p)), len(parts))
    return parts[at:]


def attempted(content: str | None, expressions: list[str] | None, first_title: str | None, expected: int | None) -> dict:
    """The first attempt (from 1) whose parts are about as many as expected, and these; null if none of the first ATTEMPTS
    is. errors: why each attempt before failed, as the next one is told. Later expressions are not tried."""
    errors: list[str] = []
    for k, expression in enumerate((expressions if expressions is not None else [])[:ATTEMPTS], 1):
        try:
            parts = parts_of(content or "", expression or "", first_title)
        except re.error as e:
            errors.append(f"bad expression: {e}")
            continue
        if expected is not None and abs(len(parts) - expected) > tolerance(expected):
            errors.append(f"{len(parts)} parts, {expected} expected")
        else:
            return {"attempt": k, "chunks": parts, "errors": errors}
    return {"attempt": None, "chunks": None, "errors": errors}


def split_by_attempts():
    """A column function: content, expressions, first title (or null) and expected number (or null) to SPLIT."""

    def batch(content: pd.Series, expressions: pd.Series, title: pd.Series, expected: pd.Series) -> pd.DataFrame:
        rows = [attempted(c, e, t, None if pd.isna(n) else int(n)) for c, e, t, n in zip(content, expressions, title, expected, strict=True)]
        out = pd.DataFrame(rows, columns=["attempt", "chunks", "errors"])
        return out.assign(attempt=out["attempt"].astype("Int32"))

    batch.__annotations__ = {"content": pd.Series, "expressions": pd.Series, "title": pd.Series, "expected": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(batch, SPLIT)
