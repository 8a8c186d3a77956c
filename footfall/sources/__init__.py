"""Reading, writing and naming tables."""

from footfall.sources.readers import (
    MissingArtifact,
    parse_timestamps,
    prepare_events,
    read_artifact,
    read_events,
    read_products,
    read_raw_events,
    read_split_events,
    read_users,
)
from footfall.sources.tables import register_views, work_folder, written_table
from footfall.sources.writers import write_artifact, write_events

__all__ = [
    "MissingArtifact",
    "parse_timestamps",
    "prepare_events",
    "read_artifact",
    "read_events",
    "read_products",
    "read_raw_events",
    "read_split_events",
    "read_users",
    "register_views",
    "work_folder",
    "write_artifact",
    "write_events",
    "written_table",
]
