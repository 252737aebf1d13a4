from drillbook.sources.drops import load_drop, loaded_files, loaded_rejects, loaded_rows
from drillbook.sources.streams import parse_choice_id, read_submissions
from drillbook.sources.tables import (
    active_questions,
    evolve_schema,
    ingest_content,
    read_content_drop,
    read_table,
)
from drillbook.sources.versions import (
    current_version,
    drop_versions,
    publish_tables,
    read_version,
    replace_table,
    shared_folder,
    write_once,
)

__all__ = [
    "active_questions",
    "current_version",
    "drop_versions",
    "evolve_schema",
    "ingest_content",
    "load_drop",
    "loaded_files",
    "loaded_rejects",
    "loaded_rows",
    "parse_choice_id",
    "publish_tables",
    "read_content_drop",
    "read_submissions",
    "read_table",
    "read_version",
    "replace_table",
    "shared_folder",
    "write_once",
]
