"""Fixed schemas of the core relations, as DDL."""

from __future__ import annotations

#: One typed block of a document, in its reading order (pos).
BLOCK = "pos INT, type STRING, page_idx INT, text STRING, text_level INT, img_path STRING, captions ARRAY<STRING>, footnotes ARRAY<STRING>, table_body STRING, latex STRING, text_format STRING, extra STRING"
#: A document: key and blocks. Operators that stay within a document work on the array and need no shuffle.
DOCUMENT = f"doc_key STRING, blocks ARRAY<STRUCT<{BLOCK}>>"
#: A content list's items as parsers write them, with legacy aliases.
CONTENT_ITEM = (
    "type STRING, page_idx INT, text STRING, text_level INT, img_path STRING, image_caption ARRAY<STRING>, img_caption ARRAY<STRING>, image_footnote ARRAY<STRING>, img_footnote ARRAY<STRING>, "
    "table_caption ARRAY<STRING>, table_footnote ARRAY<STRING>, table_body STRING, latex STRING, text_format STRING, content STRING"
)
EVENT = "event_type STRING, timestamp TIMESTAMP, file_path STRING, doc_id STRING, stage STRING, details MAP<STRING,STRING>, duration_seconds DOUBLE, error STRING"
STATUSES = ("ready", "handling", "pending", "processing", "processed", "failed")
