"""Readers and writers."""

from loomgate.sources.files import (
    file_digests, latest_versions, python_classes, read_archive, read_archive_rows, read_json_document, read_jsonl, read_jsonl_by_key, read_ledger,
    read_strata, read_text, write_json_document, write_jsonl, write_ledger,
)
from loomgate.sources.tables import table

__all__ = [
    "file_digests", "latest_versions", "python_classes", "read_archive", "read_archive_rows", "read_json_document", "read_jsonl",
    "read_jsonl_by_key", "read_ledger", "read_strata", "read_text", "table", "write_json_document", "write_jsonl", "write_ledger",
]
