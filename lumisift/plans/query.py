"""A whole library query: pool, side inputs, criteria, order, sections and badges, from one set of parameters."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumisift.operators import criteria, duplicates, orders, sections
from lumisift.params import QueryParams


class LibraryQuery:
    """items: catalogue rows; groups: (group_id, size, name) or None. Side inputs are only planned where something reads them.

    Duplicates are grouped over the whole catalogue, the pool is what the lens and decisions leave.
    """

    def __init__(self, items: DataFrame, params: QueryParams, groups: DataFrame | None = None):
        self.items, self.groups = items, groups
        self.params, self.reasons = params.blocked(groups is not None)

    @cached_property
    def duplicate_sets(self) -> DataFrame:
        return duplicates.groups(self.items, self.params.dup_distance, self.params.dup_window)

    @cached_property
    def selectable(self) -> DataFrame:
        return duplicates.selectable(self.duplicate_sets, duplicates.keepers(self.duplicate_sets, self.items, self.params.dup_keep))

    def pool(self, with_duplicates: bool) -> DataFrame:
        out = criteria.undecided(self.items) if self.params.hide_kept else self.items
        out = criteria.apply_lens(out, self.params.lens)
        if not with_duplicates:
            return out.withColumn("dup_selectable", F.lit(False))
        marked = self.selectable.select("id", F.lit(True).alias("dup_selectable"))
        return out.join(marked, "id", "left").withColumn("dup_selectable", F.coalesce("dup_selectable", F.lit(False)))

    def badges(self) -> DataFrame:
        return criteria.count_per_criterion(self.pool(True), self.params)

    def matches(self) -> DataFrame:
        """Filtered rows with what the order reads."""
        out = criteria.filtered(self.pool("duplicates" in self.params.enabled), self.params)
        if self.params.sort == "rarePeople":
            sizes = self.groups if self.groups is not None else out.sparkSession.createDataFrame([], "group_id int, size long")
            out = orders.with_attachment(out, sizes)
        elif self.params.sort == "similar":
            out = out.join(duplicates.set_sizes(self.duplicate_sets), "id", "left")
        return out

    def ranked(self) -> DataFrame:
        return orders.with_rank(self.matches(), orders.order_by(self.params.sort))

    def top(self, n: int = 300) -> DataFrame:
        return orders.top(self.matches(), self.params.sort, n)

    def sectioned(self) -> DataFrame | None:
        sets = self.duplicate_sets if self.params.sort == "similar" else None
        return sections.for_order(self.ranked(), self.params.sort, self.groups, sets)
