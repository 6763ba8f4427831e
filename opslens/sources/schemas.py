"""Declared schemas of captured tables; reading one never scans data to learn it.

Every table also carries ``server_name`` and, as a snapshot, ``captured_at``
with the partition column ``captured_date``.
"""

from __future__ import annotations

SCHEMAS = {
    "databases": "database_id long, name string, state_desc string, recovery_model_desc string, is_read_only boolean, "
                 "is_in_standby boolean, log_reuse_wait_desc string, compatibility_level long, user_access_desc string, "
                 "is_encrypted boolean, owner_sid binary, create_date timestamp_ntz",
    "backupset": "backup_set_id long, media_set_id long, database_id long, database_name string, name string, type string, "
                 "backup_start_date timestamp_ntz, backup_finish_date timestamp_ntz, backup_size double, "
                 "compressed_backup_size double, user_name string, is_copy_only boolean, is_snapshot boolean, "
                 "recovery_model string",
    "backupmediafamily": "media_set_id long, device_type int, physical_device_name string",
    "jobs": "job_id long, name string, owner_sid binary, job_guid string",
    "job_history": "instance_id long, job_id long, step_id long, run_status int, run_date long, run_time long, "
                   "run_duration long",
    "master_files": "database_id long, database_name string, file_id long, type long, type_desc string, name string, "
                    "physical_name string, size long, used_pages long, growth long, is_percent_growth boolean, "
                    "max_size long, volume_id long",
    "volumes": "volume_id long, mount_point string, logical_volume_name string, total_bytes long, available_bytes long",
    "file_inventory": "path string, length long, modified timestamp_ntz",
    "sessions": "session_id long, login_name string, host_name string, program_name string, database_id long, "
                "database_name string, status string, is_user_process boolean, last_batch timestamp_ntz, "
        "login_time timestamp_ntz, last_request_start_time timestamp_ntz, last_request_end_time timestamp_ntz, "
        "open_tran long, cpu long, memusage long, physical_io long, lastwaittype string, sql_handle long, input_buffer "
        "string",
    "processes": "spid long, blocked long, batch string",
    "requests": "request_id long, session_id long, percent_complete double, estimated_completion_time long, cpu_time long, "
                "statement_start_offset long, statement_end_offset long, sql_handle long, database_id long, "
                "database_name string, start_time timestamp_ntz, command string, "
        "wait_time long, wait_resource string, blocking_session_id long",
    "query_stats": "query_hash long, statement_start_offset long, statement_end_offset long, plan_handle long, "
                   "sql_handle long, creation_time timestamp_ntz, last_execution_time timestamp_ntz, execution_count long, "
                   "total_worker_time long, total_elapsed_time long, total_logical_reads long, total_logical_writes long",
    "query_texts": "sql_handle long, text string",
    "trace": "event_id long, event_class long, event_subclass long, database_name string, text_data string, "
             "file_name string, start_time timestamp_ntz, end_time timestamp_ntz, duration long, spid long, "
             "login_name string, application_name string, "
        "object_id long, object_name string, object_type int, index_id long, host_name string, nt_user_name string, "
        "nt_domain_name string",
    "errorlog": "log_id long, line_no long, log_date timestamp_ntz, spid string, log_msg string",
    "xe_events": "event_id long, event_xml string",
    "counters": "sample_id long, captured_at timestamp_ntz, counter_name string, instance_name string, value long",
    "lines": "file string, line_no long, line string",
    "server_services": "servicename string, service_account string",
    "restorehistory":
        "restore_history_id long, backup_set_id long, destination_database_name string, restore_type string, restore_date "
        "timestamp_ntz, user_name string",
    "restorefile": "restore_history_id long, file_number long, destination_phys_name string",
    "jobservers":
        "job_id long, last_run_outcome int, last_run_date long, last_run_time long, last_run_duration long, "
        "last_outcome_message string",
    "ag_jobs": "group_name string, job_id long, name string",
    "ag_members": "group_name string, replica_name string, role string",
    "volume_xml_lines": "line long, output string",
    "directories": "directory string",
    "index_columns":
        "schema_name string, table_name string, index_name string, column_name string, ordinal long, is_descending boolean, "
        "is_included boolean",
    "indexes":
        "schema_name string, table_name string, index_name string, is_unique boolean, type_desc string, is_padded boolean, "
        "allow_page_locks boolean, allow_row_locks boolean, no_recompute boolean, ignore_dup_key boolean, fill_factor long, "
        "is_disabled boolean, is_primary_key boolean, is_unique_constraint boolean, filegroup_name string, type int",
    "active_requests":
        "request_id long, session_id long, percent_complete double, estimated_completion_time long, cpu_time long, "
        "statement_start_offset long, statement_end_offset long, sql_handle long, database_id long, database_name string, "
        "start_time timestamp_ntz, command string, wait_time long, wait_resource string, blocking_session_id long",
    "session_transactions": "session_id long, transaction_id long",
    "database_transactions":
        "transaction_id long, database_id long, database_name string, begin_time timestamp_ntz, state int, log_bytes_used long, "
        "log_bytes_reserved long",
    "ring_buffer": "ticks long, record string",
    "sys_info": "ms_ticks long",
    "schedulers":
        "scheduler_id long, parent_node_id long, is_online boolean, status string, active_workers_count long, "
        "runnable_tasks_count long, work_queue_count long",
    "hosts":
        "machine_name string, max_workers_count long, total_physical_memory_kb long, edition_id int, engine_edition int, "
        "major_version int, version_banner string, product_version string, max_server_memory_mb long, running_memory_mb long, "
        "min_server_memory_mb long, system_manufacturer string, is_clustered boolean, cpu_mhz long, power_scheme string",
    "regions": "allocation_base long, region_size long",
    "locks": "request_session_id long, request_owner_guid string",
    "index_stats":
        "database_name string, object_id long, index_id long, table_name string, index_type_desc string, page_count long, "
        "avg_fragmentation_in_percent double, forwarded_record_count long",
    "object_indexes": "database_name string, object_id long, index_id long, index_name string",
    "messages": "message_id long, language_id int, text string",
    "xe_targets": "target_id long, target_data string",
    "progress": "job_id long, sample_id long, sampled_at timestamp_ntz, percent_complete double",
    "os_events":
        "machine_name string, record_number long, log_name string, event_code long, source string, entry_type string, message "
        "string, user_name string, time_generated timestamp_ntz",
    "account_spn_lines": "line long, output string",
    "duplicate_spn_lines": "line long, output string",
    "connections":
        "session_id long, net_transport string, client_net_address string, local_net_address string, client_tcp_port long, "
        "local_tcp_port long, encrypt_option string, auth_scheme string, most_recent_sql_handle long",
    "listener_ips": "listener_id long, ip_address string",
    "listeners": "listener_id long, dns_name string, port long",
    "server_registry": "value_name string, value_data string",
    "availability_groups": "group_id long, name string",
    "availability_replicas": "replica_id long, group_id long, replica_server_name string, endpoint_url string, owner_sid binary",
    "replica_states":
        "replica_id long, is_local boolean, connected_state_desc string, last_connect_error_description string, "
        "last_connect_error_number int, last_connect_error_timestamp timestamp_ntz",
    "cluster_databases": "group_id long, group_database_id long, database_name string",
    "database_replica_states":
        "group_id long, group_database_id long, replica_id long, is_suspended boolean, is_local boolean, is_primary_replica "
        "boolean, synchronization_state_desc string, synchronization_health_desc string, last_commit_lsn long, "
        "log_send_queue_size long, redo_queue_size long, last_commit_time timestamp_ntz",
    "automatic_seeding":
        "ag_id long, ag_db_id long, start_time timestamp_ntz, completion_time timestamp_ntz, current_state string, "
        "performed_seeding boolean, failure_state long, failure_state_desc string",
    "physical_seeding":
        "local_database_name string, remote_machine_name string, role_desc string, internal_state_desc string, "
        "transfer_rate_bytes_per_second long, transferred_size_bytes long, database_size_bytes long, is_compression_enabled "
        "boolean",
    "endpoints": "endpoint_id long, name string, principal_id long, type_desc string, state_desc string",
    "server_permissions": "class_desc string, major_id long, grantee_principal_id long, permission_name string, state_desc string",
    "server_principals":
        "principal_id long, name string, sid binary, type string, type_desc string, is_disabled boolean, default_database_name "
        "string",
    "logins": "name string, sid binary, has_access boolean, deny_login boolean",
    "sql_logins": "name string, is_policy_checked boolean, is_expiration_checked boolean",
    "listed_bad_logins": "login_name string",
    "invalid_logins": "login_name string",
    "database_principals": "database_name string, principal_id long, name string, sid binary, is_login boolean, has_db_access boolean",
    "schemas": "database_name string, schema_id long, name string, principal_id long",
    "objects": "database_name string, object_id long, schema_id long, name string, type string",
    "role_members": "database_name string, role_name string, member_name string",
    "database_permissions": "database_name string, class int, major_id long, grantee_name string, state_desc string, permission_name string",
    "packages": "name string, owner_sid binary, package_id string",
    "encryption_keys":
        "database_id long, database_name string, encryption_state long, percent_complete double, encryptor_thumbprint string, "
        "encryptor_type string, key_algorithm string, key_length long",
    "certificates": "name string, thumbprint string",
    "asymmetric_keys": "name string, thumbprint string, sid binary, provider_type string",
    "principal_credentials": "principal_id long, credential_id long",
    "credentials": "credential_id long, name string, credential_identity string, target_type string",
    "sku_features": "database_name string, feature_name string, feature_id int",
    "settings": "name string, value long, value_in_use long",
    "dbinfo": "database_name string, parent_object string, object string, field string, value string",
    "fulltext_catalogs":
        "catalog_id long, name string, item_count long, merge_status long, populate_completion_age long, populate_status long, "
        "import_status long",
    "fulltext_indexes":
        "catalog_id long, object_id long, unique_index_id int, is_enabled boolean, crawl_start_date timestamp_ntz, "
        "crawl_end_date timestamp_ntz",
    "tables": "object_id long, schema_name string, name string, index_name string, index_id int",
    "fulltext_fragments": "table_id long, data_size long",
    "publications": "publisher_db string, publication string, immediate_sync boolean",
    "services": "name string, display_name string, state string, path_name string",
}

# Driver-style event stream, as files arrive in a folder.
EVENT_STREAM = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def schema_of(name: str) -> str:
    return f"server_name string, {SCHEMAS[name]}"

# Tables the registered queries start from.
DRIVER_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
              "o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "events": EVENT_STREAM,
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
}
