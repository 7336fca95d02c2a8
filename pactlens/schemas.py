"""Schemas of the tables that cross an operator boundary."""

from __future__ import annotations

URLS = "pos BIGINT, url STRING"
FETCHES = "url STRING, file_name STRING, local_path STRING, ok BOOLEAN, size BIGINT, error STRING"
PAGES = "file STRING, page_no INT, text STRING, error STRING"
LINES = "file STRING, pos BIGINT, line STRING"
SAMPLES = "text STRING, label STRING, confidence DOUBLE, source STRING"
DATASET = "id BIGINT, text STRING, label STRING, source STRING, confidence DOUBLE"
TEXT_PARTS = "file STRING, pos INT, kind STRING, text STRING, error STRING"
DECODED = "text STRING, encoding STRING, error STRING"
CSV_RECORDS = "line STRING, header BOOLEAN"
CSV_EDGES = f"{CSV_RECORDS}, file STRING, block BIGINT, nth BIGINT, opens BOOLEAN"
