"""Row schemas shared by sources, the scan and the report."""

from __future__ import annotations

SOURCE, SKIP, ERROR = "source", "skip", "error"

FILE_METADATA = "struct<extension:string,provider:string,location:string,file_size_bytes:bigint>"

COLUMN_METADATA = (
    "struct<connection:string,connection_type:string,connection_endpoint:string,database:string,schema:string,"
    "table:string,column:string,pii_types:array<string>,detector:string,"
    "run:struct<source_name:string,source_type:string,table_count:bigint,pii_column_count:bigint>,"
    "sample_values:array<string>,sample_values_count:int,sample_values_limit:int,sample_value_preview:string,"
    "sample_values_error:string>"
)

# source_id tells records apart even when the same path is read through two inputs.
RECORD_SCHEMA = (
    "source_id string, record_type string, plugin_name string, source_type string, source_path string, "
    f"text string, content_hash string, metadata {FILE_METADATA}, reason string"
)

FINDING_COLUMNS = [
    "source_id",
    "entity_type",
    "category",
    "score",
    "text",
    "start",
    "end",
    "file_path",
    "file_hash",
    "source_type",
    "source_plugin",
    "source_metadata",
    "recognizer_name",
    "snippet",
]
