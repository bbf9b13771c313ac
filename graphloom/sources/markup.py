"""Facts from page markup by regular expressions over whole columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAG = r"<([A-Za-z][A-Za-z0-9-]*)"
LINK = r'<a [^>]*href="([^"]*)"'


def page_tags(pages: DataFrame, html: str = "html") -> DataFrame:
    return pages.withColumn("tag", F.explode(F.regexp_extract_all(html, F.lit(TAG), 1)))


def page_links(pages: DataFrame, html: str = "html") -> DataFrame:
    return pages.withColumn("href", F.explode(F.regexp_extract_all(html, F.lit(LINK), 1)))


def components(pages: DataFrame, html: str = "html") -> DataFrame:
    """Tags that begin with a capital or hold a hyphen: uses of components."""
    return page_tags(pages, html).where(F.col("tag").rlike("^[A-Z]|-"))
