"""Readers, writers and stored intermediate tables."""

from clustrial.sources.reports import flatten_report, open_report, sampling_notice, unread_pages
from clustrial.sources.schemas import SCHEMAS
from clustrial.sources.tables import (
    TableStore,
    append_all,
    read_csv,
    read_table,
    save_bucketed,
    shared_folder,
    sized,
    store,
    store_counted,
    store_in_slices,
    write_csv,
    write_table,
)

__all__ = [
    "SCHEMAS",
    "TableStore",
    "append_all",
    "flatten_report",
    "open_report",
    "read_csv",
    "read_table",
    "sampling_notice",
    "save_bucketed",
    "shared_folder",
    "sized",
    "store",
    "store_counted",
    "store_in_slices",
    "unread_pages",
    "write_csv",
    "write_table",
]
