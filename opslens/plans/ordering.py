"""Reading order of the reports.

Reports come back unordered: a global sort is one more shuffle and only the
reader at the end needs it. ``in_order`` adds it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Columns per report; a leading minus means descending.
ORDER = {
    "jobs_running_at": ["job_name", "run_end"],
    "jobs_in_hours": ["-run_start"],
    "last_backups": ["database_name", "type", "backup_finish_date"],
    "stale_backups": ["database_name"],
    "latest_by_type": ["database_name", "type"],
    "missing_backup_days": ["day", "database_name"],
    "agent_backups": ["server_name", "database_name", "user_name", "backup_type"],
    "backup_html_rows": ["server_name", "section", "database_name", "backup_finish_date", "backup_set_id"],
    "backup_state": ["-hr_since_full"],
    "restore_history": ["-restore_history_id"],
    "restore_durations": ["-start_time"],
    "disk_space": ["drive_free_gb"],
    "growth_settings": ["database_name"],
    "size_share": ["-percent_size"],
    "orphaned_files": ["-size_mb"],
    "blocking_tree": ["server_name", "path"],
    "open_transactions": ["begin_time"],
    "connections_by_host": ["database_name"],
    "connection_counts": ["database_name", "login_name", "program_name", "client_net_address", "local_net_address",
                          "dns_name"],
    "running_by_cpu": ["-cpu_time"],
    "redundant_queries": ["-sort_order", "query_hash", "statement_start_offset", "statement_end_offset"],
    "errorlog_since": ["-log_date"],
    "errorlog_summary": ["-error_count"],
    "health_error_detail": ["logged_date"],
    "trace_occurrences": ["event_name", "database_name", "application_name", "login_name"],
    "trace_report": ["-start_time"],
    "reboots": ["-time_generated"],
    "ha_ddl_events": ["timestamp"],
    "ha_failovers": ["timestamp"],
    "ha_manager_states": ["timestamp"],
    "ha_replica_states": ["timestamp"],
    "ha_lease_expirations": ["timestamp"],
    "ha_events_named": ["timestamp"],
    "xe_error_summary": ["-error_count"],
    "counter_rate": ["-rate_per_second"],
    "replica_status": ["last_commit_time"],
    "encryption_chain": ["encryptor_thumbprint"],
    "stale_crawls": ["crawl_start_date", "table_name", "index_name"],
    "fragmentation": ["-fragmentation_percent"],
    "index_ddl": ["schema_name", "table_name", "index_name"],
    "bad_login_jobs": ["owner"],
    "bad_login_packages": ["owner"],
    "server_registry": ["file", "line_no"],
}


def in_order(df: DataFrame, report: str) -> DataFrame:
    """The report sorted as it is read."""
    columns = [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in ORDER[report]]
    return df.orderBy(*columns)
