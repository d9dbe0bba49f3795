"""The engine's calls: search pages, suggestions, details, reports and clicks as lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reefglass import config
from reefglass.checkpoints import cut
from reefglass.operators import facets as fc
from reefglass.operators import filters as flt
from reefglass.operators import search as s
from reefglass.sources.tables import fixed_rows, read_table


@dataclass
class Page:
    """One page of results with its facets; every member is lazy."""

    results: DataFrame
    facets: DataFrame
    applied_defaults: list[str] = field(default_factory=list)
    suggestions: list[str] = field(default_factory=list)


class Engine:
    """Search over the tables of one data folder, as of a given time.

    With ``index_dir`` searches read the index stored there by ``build_index``; without, the table itself.
    aliases (term, expands_to) and translations (source_hash, translation) widen the queries.
    """

    def __init__(self, spark: SparkSession, data_dir: str, as_of: str, vector_mode: str = "dual", index_dir: str | None = None, aliases: DataFrame | None = None, translations: DataFrame | None = None):
        self.spark, self.data_dir, self.as_of, self.vector_mode, self.index_dir = spark, data_dir, as_of, vector_mode, index_dir
        self.aliases, self.translations = aliases, translations
        self.overlays: list = []
        self._opened: s.Index | None = None

    def add_overlay(self, overlay) -> None:
        """Registers a DataFrame -> DataFrame function applied to the documents, in order."""
        self.overlays.append(overlay)

    def documents(self) -> DataFrame:
        docs = s.documents(self.spark, self.data_dir)
        for o in self.overlays:
            docs = o(docs)
        return docs

    def build_index(self) -> None:
        """Stores postings, dictionary, documents and the suggestion terms; a rebuild replaces them."""
        self._opened = None
        docs = self.documents()
        s.Index.write(docs, self.index_dir, self.vector_mode)
        s.suggest_terms(docs).write.mode("overwrite").parquet(f"{self.index_dir}/terms")

    def index(self) -> s.Index:
        """The stored index, opened once, or a lazy one."""
        if not self.index_dir:
            return s.Index.of(self.documents(), self.vector_mode)
        if self._opened is None:
            self._opened = s.Index.read(self.spark, self.index_dir)
        return self._opened

    def search_page(
        self, q: str, tab: str = "all", number: int = 1, per_page: int = 20, sort: str | None = None, filters: list[str] | None = None, cells: DataFrame | None = None,
        promoted: dict[str, str] | None = None, lang: str | None = None, kinds: dict[str, str] | None = None,
    ) -> Page:
        """A ranked page; a query without words gives an empty one. On the tabs all and shopping a relevance page is interleaved.

        Facets count the candidates, up to the cap, whatever the page; on the shopping tab attributes found worth it
        are added, where cells and their kinds (attribute -> datatype) are given.
        """
        asked, defaults = flt.default_filters(tab, list(filters or []))
        parsed = flt.parse(tab, asked, promoted)
        as_of = F.lit(self.as_of).cast("timestamp")
        where = F.lit(True) if tab in ("all", "images") else F.col("doc_type") == tab
        for facet, value in parsed.values():  # conditions on columns go before the match
            if facet.store != "spec":
                where = where & flt.condition(facet, value, as_of)
        if tab == "images":
            where = where & (F.size("thumbnails") > 0)
        cand = s.candidates(self.spark, self.index(), [(1, q or "")], self.as_of, where, True, self.aliases, self.translations)
        if lang is not None:
            cand = cand.withColumn("resp", F.lit(lang))
        cand = flt.apply(cand, {k: v for k, v in parsed.items() if v[0].store == "spec"}, as_of, cells)
        cand = cand.withColumn("estimated_net_min", flt.json_scalar("estimated_net_min").try_cast("double")).withColumn("views", flt.json_scalar("views").try_cast("double"))
        top = cut(s.top_candidates(cand, sort))  # at most the cap: facets and page read it
        counts = fc.page_facets(top, flt.TABS.get(tab, flt.TABS["all"]), as_of, cells if tab == "shopping" else None, kinds)
        if tab in ("all", "shopping") and (sort or "relevance") == "relevance":
            group = "doc_type" if tab == "all" else "category_leaf"
            top = s.interleave(top, group, config.RUN_CAP).withColumn("pos", F.col("slot")).drop("slot")
        return Page(s.page(top, number, per_page).orderBy("pos"), counts, defaults)

    def suggest(self, q: str, limit: int = 10) -> DataFrame:
        terms = self.spark.read.parquet(f"{self.index_dir}/terms") if self.index_dir else s.suggest_terms(self.documents())
        return s.suggest(terms, q, limit)

    def meta(self) -> dict:
        """Tabs, sorts and active sources (a table of fixed size)."""
        src = read_table(self.spark, self.data_dir, "doc_source").where("is_active").orderBy("source")
        return {"tabs": list(flt.TABS), "sorts": list(s.SORTS), "sources": [(r.source, r.label_en or r.source) for r in fixed_rows(src)]}

    def detail(self, doc_id: int) -> DataFrame:
        """One document; news has no detail page."""
        return self.documents().where((F.col("id") == doc_id) & (F.col("doc_type") != "news"))

    def report(self, reports: DataFrame, new: DataFrame) -> DataFrame:
        """reports plus the new ones whose (document_id, reason, reporter) is not there yet."""
        return reports.unionByName(new.select(*reports.columns).dropDuplicates(["document_id", "reason", "reporter"]).join(reports, ["document_id", "reason", "reporter"], "left_anti").select(*reports.columns))

    def click(self, queries: DataFrame, clicks: DataFrame) -> DataFrame:
        """Clicks at positions from 0 whose query exists."""
        return clicks.where("position >= 0").join(queries.select("query_id"), "query_id", "left_semi")
