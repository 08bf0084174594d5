"""Column types of the stored tables, and deterministic ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NODES = "id string, type string, name string, qualified_name string, file_path string, start_line int, end_line int, signature string, docstring string, source_snippet string, language string, created_at timestamp_ntz, updated_at timestamp_ntz"
EDGES = "id string, source_id string, target_id string, type string, metadata string, file_path string, created_at timestamp_ntz"
FILE_HASHES = "path string, sha256 string, file_size long, language string, analyzed_at timestamp_ntz"
FILE_DEPS = "importer string, importee string"
INDEX_RUNS = "id int, run_type string, repo_path string, files_scanned int, files_indexed int, files_skipped int, nodes_created int, edges_created int, duration_ms int, status string, error_message string, started_at timestamp_ntz, completed_at timestamp_ntz"
PARSED_NODE = "type string, name string, qualified_name string, file_path string, start_line int, end_line int, language string, signature string, docstring string, source_snippet string"
PARSED_EDGE = "source_qualified string, target_qualified string, type string, file_path string, metadata string"
PARSE_RESULT = f"file_path string, language string, nodes array<struct<{PARSED_NODE.replace(' string', ': string').replace(' int', ': int')}>>, edges array<struct<{PARSED_EDGE.replace(' string', ': string')}>>, import_paths array<string>, error string"


def _short_hash(*parts: Column | str) -> Column:
    return F.substring(F.sha2(F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]), 256), 1, 32)


def node_id(file_path: Column, qualified_name: Column, kind: Column) -> Column:
    """The first 32 hex digits of sha256 over path, qualified name and type; null if one of them is."""
    return _short_hash(file_path, "::", qualified_name, "::", kind)


def edge_id(source: Column, target: Column, kind: Column) -> Column:
    return _short_hash(source, "->", target, "::", kind)
