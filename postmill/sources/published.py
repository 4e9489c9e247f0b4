"""Readers behind the published pointer: one run is resolved once, and every answer comes from its tables and its index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import browse as B
from ..operators import search as S
from ..operators.filters import apply_filters
from .catalog import NAMESPACE, Catalog, stored_descriptions

SHOWN = ["run_id", "company", "external_job_id", "title", "posted_ts"]


class PublishedRun:
    """The published run of a catalog. Runs are immutable, so a reader keeps its run while another one is published."""

    def __init__(self, catalog: Catalog, namespace: str = NAMESPACE):
        self.catalog = catalog
        self.run_id = catalog.published_run(namespace)

    def jobs(self) -> DataFrame:
        return self.catalog.scan_run("jobs", self.run_id)

    def details(self) -> DataFrame:
        return self.catalog.scan_run("job_details", self.run_id)

    def companies(self) -> DataFrame:
        """The run's companies; a request that names another one is refused."""
        return B.list_companies(self.catalog.scan_run("companies", self.run_id), self.run_id)

    def index(self) -> S.SearchIndex:
        return S.SearchIndex.read(self.catalog.spark, self.catalog.index_path(self.run_id))

    def _checked(self, filters: dict) -> dict:
        company = filters.get("company")
        if company is not None:
            asked = self.catalog.spark.createDataFrame([(company,)], "company string")
            if B.unknown_companies(asked, self.companies()).limit(1).count():
                raise ValueError(f"unsupported company {company}")
        return filters

    def browse(self, page: int = 1, size: int = B.PAGE_SIZE, **filters) -> DataFrame:
        """One page of postings, newest first."""
        return B.browse(self.jobs(), page, size, **self._checked(filters))

    def page_info(self, page: int = 1, size: int = B.PAGE_SIZE, **filters) -> DataFrame:
        return B.page_info(apply_filters(self.jobs(), **self._checked(filters)), page, size)

    def location_facets(self, country: str | None = None, region: str | None = None, **filters) -> DataFrame:
        return B.location_facets(self.jobs(), country, region, **self._checked(filters))

    def job_details(self, requests: DataFrame, runs: list[str] | None = None) -> DataFrame:
        """Details of (company, external_job_id) rows. ``runs`` hold the texts that paths carried forward point into."""
        asked = requests.select(F.lit(self.run_id).alias("run_id"), "company", "external_job_id")
        # Only the details that are asked for meet the texts.
        wanted = self.details().join(asked, ["run_id", "company", "external_job_id"], "left_semi")
        texts = stored_descriptions(self.catalog, runs or [self.run_id])
        # All by path: the texts are moved once, for this, for the distinct ones and for the lookup.
        paths = wanted.select(F.trim("job_description_path").alias("job_description_path")).where("job_description_path <> ''").distinct()
        near = texts.join(paths, "job_description_path", "left_semi").distinct()
        return B.job_details_lookup(asked, self.jobs(), wanted, near)

    def search(self, query: str, vector: list[float], page: int = 1, size: int = B.PAGE_SIZE, **filters) -> DataFrame:
        """One page of the fused text and vector candidates."""
        return S.search_relevance(self.index(), query, vector, page, size, **self._checked(filters))

    def search_recency(self, query: str, page: int = 1, size: int = B.PAGE_SIZE, **filters) -> DataFrame:
        return S.search_recency(self.index(), query, page, size, **self._checked(filters))
