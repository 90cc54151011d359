"""Reading tables and streams, and the shared folder for written intermediates."""

from quern.sources.shared import kept_in, remove, shared_folder, write_through
from quern.sources.tables import stream_table, table

__all__ = ["kept_in", "remove", "shared_folder", "stream_table", "table", "write_through"]
