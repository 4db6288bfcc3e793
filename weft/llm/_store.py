"""Tables between stages: ``weft.store``, and what only these operators need."""

from __future__ import annotations

from pyspark.sql import DataFrame

from weft.store import _made, cleared, mark, on_disk, shared_folder, temporary, written

__all__ = ["_made", "cleared", "documents", "mark", "on_disk", "shared_folder", "temporary", "written"]


def documents(frame: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns: other columns of the input, whatever their names, take no part."""
    return frame.select(*columns)
