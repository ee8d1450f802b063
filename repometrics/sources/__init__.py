from repometrics.sources.manifest import list_source_files, read_listed
from repometrics.sources.readers import (
    read_id_list,
    read_intermediate,
    read_metric_csv,
    read_repo_json,
    read_repo_meta,
    read_result_chunks,
    scan_source_files,
    scan_warehouse,
)
from repometrics.sources.writers import (
    append_rows,
    append_run,
    bucket_count,
    write_bucketed,
    write_by_outcome,
    write_chunks,
    write_table,
    write_with_probes,
)

__all__ = [
    "append_rows", "append_run", "bucket_count", "list_source_files", "read_id_list", "read_intermediate", "read_listed",
    "read_metric_csv", "read_repo_json", "read_repo_meta", "read_result_chunks", "scan_source_files", "scan_warehouse",
    "write_bucketed", "write_by_outcome", "write_chunks", "write_table", "write_with_probes",
]
