"""The relations of the library, as Spark schemas."""

from __future__ import annotations

from pyspark.sql.types import StructType

FILES = StructType.fromDDL("file_id long, path string, filename string, modified_time long, created_time long")
CHUNKS = StructType.fromDDL("chunk_id long, file_id long, chunk_index int, text string")
VECTORS = StructType.fromDDL("vec_id long, embedding array<float>")
SETTINGS = StructType.fromDDL("key string, value string")
SORT_LOG = StructType.fromDDL("sort_id long, original_path string, new_path string, category string, tags string, sorted_at double, undone int")
EVENTS = StructType.fromDDL("event_id long, event_type string, event_data string, ts double")
TURNS = StructType.fromDDL("conv_id long, turn long, role string, text string")
SEMANTIC = (
    "change_score double, risk_score double, intent string, severity string, similarity_score double, "
    "modify_score double, block_score double, add_score double, delete_score double, size_score double"
)
VERSIONS = StructType.fromDDL(
    "version int, version_id string, parent string, storage_type string, file_hash string, timestamp string, snapshot_path string, "
    f"diff_path string, summary string, intent string, semantic struct<{SEMANTIC.replace(' double', ':double').replace(' string', ':string')}>, "
    "risk_level string, stability_score double, reused_snapshot string"
)
WORD = StructType.fromDDL("paragraphs array<string>, headings array<string>, tables array<array<array<string>>>, has_macros boolean")
EXCEL = StructType.fromDDL("sheets map<string,map<string,struct<value:string,formula:string,cached_value:string,display_value:string>>>, has_macros boolean")
TREE = StructType.fromDDL("device string, filepath string, checksum string")
BLOCKS = StructType.fromDDL("filepath string, block int, checksum string")
CLOCKS = StructType.fromDDL("filepath string, clock map<string,bigint>")
LOGS = StructType.fromDDL("ts timestamp, category string, message string, is_error boolean, level string")
