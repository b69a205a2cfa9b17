"""Listing, facets and drill-down of a stored index."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from ..operators import listing, lookups, nested
from ..operators.filters import Filter, by_key
from ..session import materialize
from ..sinks.store import Store


class Browser:
    """What a user asks of an index, answered from one publication of its store.

    The publication is pinned at the start, so a listing, its facets and the classes of
    its rows agree with one another while batches are published. Class rows are read
    only where a class filter asks for them, and a drill-down reads those of its own
    artifacts: the rows of other artifacts are dropped where they are scanned.
    """

    def __init__(self, store: Store):
        self.store = store if store.order is not None else store.snapshot()

    def artifacts(self) -> DataFrame:
        return self.store.read("artifacts")

    def list(self, filters: Iterable[Filter] = (), packs: DataFrame | None = None) -> DataFrame:
        """The listing of all artifacts that the filters keep; ``packs(pack_id, int_project_id)``."""
        filters = list(filters)
        return listing.list_artifacts(self.artifacts(), filters, **self._tables(filters, packs))

    def count(self, filters: Iterable[Filter] = (), packs: DataFrame | None = None) -> DataFrame:
        filters = list(filters)
        return listing.count_listing(self.artifacts(), filters, **self._tables(filters, packs))

    def _tables(self, filters: list[Filter], packs: DataFrame | None) -> dict[str, DataFrame | None]:
        asked = listing.CLASS_NAME in by_key(filters)
        return {"class_defs": self.store.read("class_defs") if asked else None, "packs": packs}

    def facets(self) -> DataFrame:
        """The values that each filter can be given."""
        return listing.facets(self.artifacts())

    def classes(self, requests: DataFrame) -> DataFrame:
        """Class names of every requested project (``requests(pid)``), by name."""
        wanted = requests.select(listing.request_key(F.col("pid")).alias("project_key")).distinct()
        owners = materialize(
            listing.typed_project_ids(self.artifacts()).join(wanted, "project_key", "left_semi")
            .select("id", "int_project_id", "text_project_id").distinct(), "owners",
        )
        return listing.classes_of(requests, owners, self.read("class_defs", owners))

    def read(self, table: str, owners: DataFrame) -> DataFrame:
        """The rows of a fact table that belong to ``owners(id)``."""
        return self.store.read_keys(table, owners.select(F.col("id").alias("artifact_id")))

    def lookup(self, requests: DataFrame) -> DataFrame:
        """Artifacts for ``requests(kind, key)``."""
        return lookups.lookup(requests, self.artifacts())

    def containing(self, filters: Iterable[Filter]) -> DataFrame:
        """Artifacts that contain one of the asked ids at any depth."""
        return nested.containing(self.artifacts(), filters)
