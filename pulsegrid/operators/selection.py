"""Labels and groups as users give them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def label_list(text: Column) -> Column:
    """Labels parted by line ends and commas, stripped, blanks dropped; null if none is left."""
    strip = lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")
    found = F.filter(F.transform(F.split(text, r"[\n,]+"), strip), lambda s: s != "")
    return F.when(F.size(found) > 0, found)


def parse_labels(text: str | None, files: int) -> list[str] | None:
    """The labels of as many files; another number of them is an error."""
    found = [s.strip() for s in (text or "").replace("\n", ",").split(",") if s.strip()]
    if found and len(found) != files:
        raise ValueError(f"{len(found)} labels for {files} files")
    return found or None


def parse_groups(groups: Mapping[int, tuple[str | None, Sequence[str]]]) -> list[tuple[int, str, str]]:
    """(group_idx, label, recording_id) rows of groups by index; empty ones are skipped, fewer than two are an error."""
    named = [(i, label or f"Group {i + 1}", list(items)) for i, (label, items) in sorted(groups.items()) if items]
    if len(named) < 2:
        raise ValueError("a comparison needs two groups or more")
    return [(k, label, item) for k, (_, label, items) in enumerate(named) for item in items]
