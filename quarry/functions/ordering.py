"""Sort keys that say where nulls go, and enum values in their declared order."""

from pyspark.sql import Column, functions as F

#: Enum members in declaration order.
EXTRACTION_STATUS = ("WAITING", "IN_PROGRESS", "COMPLETE", "STALE", "CANCELLED")
CATALOGUE_TYPE = ("COURSES", "LEARNING_PROGRAMS", "COMPETENCIES", "CREDENTIALS")
PAGE_STATUS = ("WAITING", "IN_PROGRESS", "SUCCESS", "ERROR", "DOWNLOADED", "EXTRACTED_NO_DATA")


def key(c: Column, order: str = "asc") -> Column:
    """Nulls last when ascending, first when descending."""
    return c.asc_nulls_last() if order == "asc" else c.desc_nulls_first()


def ordinal(c: Column, members: tuple[str, ...]) -> Column:
    """The place of an enum value in its declaration; null for null or unknown."""
    at = F.array_position(F.array(*map(F.lit, members)), c)
    return F.when(at > 0, at)
