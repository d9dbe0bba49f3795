"""Notice pages: ids, page numbers and details out of HTML, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reefglass.functions import lang


def links(html: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?i)href\s*=\s*["']([^"']+)["']"""), 1))


def notice_ids(html: Column) -> Column:
    """Last path segments of the links with class iulaan-title."""
    tag = r"""(?is)<a(?=[^>]*class\s*=\s*["'][^"']*iulaan-title)[^>]*href\s*=\s*["'][^"']*/([^"'/?#]+)/?["']"""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(tag), 1)


def last_page(html: Column) -> Column:
    """Largest page number among the pagination links, null if none."""
    nums = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?is)<li[^>]*page-item[^>]*>\s*<a[^>]*>\s*(\d+)\s*</a>"""), 1)
    return F.array_max(F.transform(nums, lambda n: n.cast("int")))


def file_links(html: Column) -> Column:
    return F.filter(links(html), lambda u: F.lower(u).rlike(r"\.(pdf|docx|xlsx)"))


def info_map(text: Column) -> Column:
    """'key: value' lines as a map, split at the first colon, first of equal keys wins."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\r\n]+"), lambda x: x.contains(":"))
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k, F.element_at(F.filter(pairs, lambda p: p["k"] == k), 1)["v"])))


def body_text(html: Column) -> Column:
    return lang.strip_html(html)
