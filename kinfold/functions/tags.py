"""Source tags as data: which sources there are, in which order they load, which of them is believed."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame

from kinfold.functions import fixed_values as fixed

#: A node number has this many codes for sources.
MAX_TAGS = 2047


@dataclass(frozen=True)
class SourceTags:
    """``tags`` in load order, with their authority (1 = wins ties)."""

    tags: tuple[str, ...]
    priority: Mapping[str, int]

    def __post_init__(self):
        if not 1 <= len(self.tags) <= MAX_TAGS:
            raise ValueError(f"1 to {MAX_TAGS} source tags, not {len(self.tags)}")
        if len(set(self.tags)) < len(self.tags):
            raise ValueError("a source tag is given twice")
        if set(self.priority) != set(self.tags):
            raise ValueError("every source tag needs a priority, and nothing else")
        # record ids are a tag and a number: no two of them may read alike
        known = set(self.tags)
        for tag in self.tags:
            stem = tag.rstrip("0123456789")
            if not tag or any(tag[:i] in known for i in range(len(stem), len(tag))):
                raise ValueError(f"record ids of source {tag!r} could be those of another source")

    @classmethod
    def from_table(cls, table: DataFrame) -> SourceTags:
        """From rows ``(tag, load_order, priority)``, at most ``MAX_TAGS`` of them."""
        rows = table.select("tag", "load_order", "priority").limit(MAX_TAGS + 1).collect()
        rows = sorted(rows, key=lambda r: (r.load_order, r.tag))
        return cls(tuple(r.tag for r in rows), {r.tag: r.priority for r in rows})

    def __contains__(self, tag: str) -> bool:
        return tag in self.tags


DEFAULT_TAGS = SourceTags(fixed.SOURCES, fixed.SOURCE_PRIORITY)
