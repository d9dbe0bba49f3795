"""The filter grammar ('key:value', 'key:min..max', repeated keys) and its conditions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reefglass import config


class FilterError(ValueError):
    """A filter that the registry or the grammar does not allow."""


@dataclass(frozen=True)
class Facet:
    """One filterable and countable attribute. store: column, json, json_array or spec.

    split_by: columns without which the values of a range cannot be compared (a price needs its currency).
    """

    key: str
    widget: str  # checkbox, range or toggle
    store: str
    path: str
    top: int = 12
    split_by: tuple[str, ...] = ()


def _box(key: str, store: str = "json", path: str | None = None, top: int = 12) -> Facet:
    return Facet(key, "checkbox", store, path or key, top)


_PLACE = _box("location", "column", "island")
#: Facets of the tabs, in the order shown.
TABS: dict[str, tuple[Facet, ...]] = {
    "job": (
        _box("job_category"), _box("position_type"), Facet("net_estimate", "range", "json", "estimated_net_min"), _box("salary_state", path="compensation.salary_state"), _box("employer", top=20), _box("grade"),
        _box("category_leaf", "column"), _box("deadline", "column", "expires_at"), _box("island", "column", top=20), _PLACE, Facet("views", "range", "json", "views"), _box("job_title", "spec", top=20),
    ),
    "property": (
        _box("listing_kind"), Facet("price", "range", "column", "price", split_by=("currency", "price_period")), _box("unit_kind", path="occupancy.unit_kind"), Facet("is_shared", "toggle", "json", "occupancy.is_shared"),
        Facet("bedrooms", "range", "spec", "bedrooms"), _box("bathrooms"), _box("furnishing"), _box("neighborhood", top=20), _box("island", "column", top=20), _box("atoll", "column"), Facet("has_lift", "toggle", "spec", "has_lift"),
        Facet("square_feet", "range", "json", "square_feet"), _box("tenant_preference", "json_array"), Facet("has_images", "toggle", "column", "thumbnails"),
    ),
    "shopping": (
        Facet("price", "range", "column", "price", split_by=("currency",)), _box("category_leaf", "column", top=20), _box("condition"), _box("brand", "spec", top=20), _box("seller_type"), Facet("has_images", "toggle", "column", "thumbnails"),
        _PLACE, _box("category_path", "json_array"),
    ),
    "news": (
        _box("office", top=20), _box("announcement_type"), Facet("has_attachments", "toggle", "json", "documents"), Facet("is_tender", "toggle", "json", "is_tender"), _box("source", "column", top=20), Facet("views", "range", "json", "views"),
    ),
    "all": (_PLACE, _box("doc_type", "column"), _box("island", "column")),
    "images": (_box("doc_type", "column"),),
}
YES, NO = ("true", "1", "yes"), ("false", "0", "no")


def facet_for(tab: str, key: str, promoted: dict[str, str] | None = None) -> Facet:
    """The facet of a key: the tab's own, else a promoted attribute (key -> datatype), else an error."""
    for f in TABS.get(tab, ()):
        if f.key == key:
            return f
    kind = (promoted or {}).get(key)
    if kind is None:
        raise FilterError(f"unknown filter: {key}")
    return Facet(key, {"numeric": "range", "bool": "toggle"}.get(kind, "checkbox"), "spec", key)


def parse_range(value: str) -> tuple[float | None, float | None]:
    """'a..b' with open ends; swapped ends are put right."""
    if ".." not in value:
        raise FilterError(f"not a range: {value}")
    lo, hi = value.split("..", 1)
    try:
        a, b = (float(x) if x.strip() else None for x in (lo, hi))
    except ValueError as e:
        raise FilterError(f"not a number in {value}") from e
    return (b, a) if a is not None and b is not None and a > b else (a, b)


def parse(tab: str, filters: list[str], promoted: dict[str, str] | None = None) -> dict[str, tuple[Facet, object]]:
    """key -> (facet, values): lists for checkboxes (repeated keys are alternatives), the last range or toggle otherwise."""
    out: dict[str, tuple[Facet, object]] = {}
    for f in filters:
        key, sep, value = f.partition(":")
        if not sep:
            raise FilterError(f"no value in {f}")
        facet = facet_for(tab, key.strip(), promoted)
        if facet.widget == "range":
            out[facet.key] = (facet, parse_range(value))
        elif facet.widget == "toggle":
            v = value.strip().lower()
            if v not in YES + NO:
                raise FilterError(f"not a yes or no: {value}")
            out[facet.key] = (facet, v in YES)
        else:
            out.setdefault(facet.key, (facet, []))[1].append(value)  # type: ignore[union-attr]
    return out


def json_scalar(path: str, column: str = "attrs") -> Column:
    return F.get_json_object(F.col(column), f"$.{path}")


def json_array(path: str, column: str = "attrs") -> Column:
    """Array of strings at a path, empty if missing."""
    return F.coalesce(F.from_json(F.get_json_object(F.col(column), f"$.{path}"), "array<string>"), F.array().cast("array<string>"))


def deadline(values: list[str], as_of: Column, column: str = "expires_at") -> Column:
    """open (none or not past; closing soon too), closing_soon (within seven days), closed; no known value filters nothing."""
    c, soon = F.col(column), as_of + F.expr(f"INTERVAL {config.CLOSING_SOON_DAYS} DAYS")
    known = {"open": c.isNull() | (c >= as_of), "closing_soon": (c >= as_of) & (c < soon), "closed": c < as_of}
    chosen = [F.coalesce(known[v], F.lit(False)) for v in values if v in known]
    return reduce(lambda a, b: a | b, chosen) if chosen else F.lit(True)


def condition(facet: Facet, value: object, as_of: Column) -> Column:
    """The condition of a filter on a column or JSON attribute."""
    if facet.key == "deadline":
        return deadline(list(value), as_of)  # type: ignore[arg-type]
    if facet.path == "thumbnails":
        n = F.coalesce(F.size("thumbnails"), F.lit(0))
        return (n > 0) if value else (n <= 0)
    if facet.key == "has_attachments":
        n = F.size(json_array(facet.path))
        return (n > 0) if value else (n <= 0)
    if facet.store == "json_array":
        return F.arrays_overlap(json_array(facet.path), F.array(*[F.lit(v) for v in value]))  # type: ignore[union-attr]
    expr = F.col(facet.path) if facet.store == "column" else json_scalar(facet.path)
    if facet.widget == "range":
        lo, hi = value  # type: ignore[misc]
        number = expr.cast("double") if facet.store == "column" else expr.try_cast("double")
        parts = [number >= lo] if lo is not None else []
        parts += [number <= hi] if hi is not None else []
        return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)
    if facet.widget == "toggle":
        return expr == F.lit("true" if value else "false")
    return expr.isin(*value)  # type: ignore[misc]


def with_spec(docs: DataFrame, cells: DataFrame, key: str, widget: str, value: object) -> DataFrame:
    """Documents with an attribute row that meets the filter: cells (document_id, spec_key, num, text)."""
    rows = cells.where(F.col("spec_key") == key)
    if widget == "range":
        lo, hi = value  # type: ignore[misc]
        rows = rows.where((F.col("num") >= (lo if lo is not None else float("-inf"))) & (F.col("num") <= (hi if hi is not None else float("inf"))))
    elif widget == "toggle":
        rows = rows.where(F.col("num") == (1.0 if value else 0.0))
    else:
        rows = rows.where(F.col("text").isin(*value))  # type: ignore[misc]
    return docs.join(rows.select(F.col("document_id").alias("id")), "id", "left_semi")


def apply(docs: DataFrame, parsed: dict[str, tuple[Facet, object]], as_of: Column, cells: DataFrame | None = None) -> DataFrame:
    """All filters together."""
    for facet, value in parsed.values():
        if facet.store == "spec":
            if cells is None:
                raise FilterError(f"{facet.key} needs the attribute table")
            docs = with_spec(docs, cells, facet.path, facet.widget, value)
        else:
            docs = docs.where(condition(facet, value, as_of))
    return docs


def default_filters(tab: str, filters: list[str]) -> tuple[list[str], list[str]]:
    """The filters with the tab's defaults, and the defaults that were added: open deadlines on the job tab."""
    added = ["deadline:open"] if tab == "job" and not any(f.startswith("deadline:") for f in filters) else []
    return filters + added, added
