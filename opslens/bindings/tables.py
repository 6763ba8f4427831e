"""Operations tables derived from the driver's tables.

Each function gives one SELECT over driver tables (or other tables here),
written once and spelled for Spark SQL or DuckDB. All rows of a driver table
are used; where a table must lack rows, an attribute of the data decides.
``server_name`` is a function of the database, job or session number, so that
tables which are joined agree on it.
"""

from __future__ import annotations

BS = "chr(92)"  # backslash
LB, RB = "chr(123)", "chr(125)"  # braces

ERROR_CODES = [823, 824, 825, 833, 9002, 1205, 701, 17883]
HA_CODES = [35202, 1480, 35206, 35201, 41051, 823]


def text(x: str) -> str:
    return f"CAST({x} AS STRING)"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def whole(x: str) -> str:
    return f"CAST(FLOOR({x}) AS BIGINT)"


def srv(k: str) -> str:
    return f"('srv_' || {text(f'({k}) % 4')})"


def pick(k: str, values: list) -> str:
    """k-th of a short list, by remainder."""
    def lit(v):
        return str(v) if isinstance(v, int) else f"'{v}'"
    whens = " ".join(f"WHEN {i} THEN {lit(v)}" for i, v in enumerate(values[:-1]))
    return f"CASE ({k}) % {len(values)} {whens} ELSE {lit(values[-1])} END"


def db_name(k: str) -> str:
    return (f"CASE {k} WHEN 1 THEN 'master' WHEN 2 THEN 'tempdb' WHEN 3 THEN 'model' "
            f"WHEN 4 THEN 'msdb' ELSE 'db_' || {text(k)} END")


def sid_hex(k: str) -> str:
    h = f"lpad(hex({big(k)}), 8, '0')"
    return ("('010500000000000515000000A065CF7E784B9B5FE77C8770' || "
            f"substr({h}, 7, 2) || substr({h}, 5, 2) || substr({h}, 3, 2) || substr({h}, 1, 2))")


# Databases that take backups: every twelfth has none, its orders go to its neighbour.
DID = "CASE WHEN o_custkey % 12 = 11 THEN o_custkey - 1 ELSE o_custkey END"


def databases(q):
    return f"""SELECT {srv('c_custkey')} AS server_name, c_custkey AS database_id,
      {db_name('c_custkey')} AS name,
      CASE WHEN c_custkey % 13 = 12 THEN 'OFFLINE' ELSE 'ONLINE' END AS state_desc,
      {pick('c_custkey', ['SIMPLE', 'FULL', 'BULK_LOGGED'])} AS recovery_model_desc,
      c_custkey % 11 = 10 AS is_read_only, c_custkey % 17 = 16 AS is_in_standby,
      CASE c_mktsegment WHEN 'BUILDING' THEN 'LOG_BACKUP' WHEN 'HOUSEHOLD' THEN 'ACTIVE_TRANSACTION'
        ELSE 'NOTHING' END AS log_reuse_wait_desc,
      100 + 10 * (c_custkey % 6) AS compatibility_level, 'MULTI_USER' AS user_access_desc,
      c_custkey % 4 = 1 AS is_encrypted, {q.binary(sid_hex('c_custkey'))} AS owner_sid,
      {q.add_seconds(q.stamp('2020-01-01 00:00:00'), 'c_custkey * 86400')} AS create_date
    FROM {{customer}}"""


def backupset(q):
    did = f"({DID})"
    size = whole('o_totalprice * 1e6')
    start = q.add_seconds('o_orderdate', 'o_orderkey % 86400')
    return f"""SELECT {srv(did)} AS server_name, o_orderkey AS backup_set_id, o_orderkey AS media_set_id,
      {did} AS database_id, {db_name(did)} AS database_name,
      CASE WHEN o_orderkey % 29 = 0 THEN 'Veeam job' ELSE 'bak_' || {text('o_orderkey')} END AS name,
      CASE o_orderstatus WHEN 'F' THEN 'D' WHEN 'P' THEN 'I' ELSE 'L' END AS type,
      {start} AS backup_start_date,
      {q.add_seconds(start, whole('o_totalprice') + ' % 7200')} AS backup_finish_date,
      CAST({size} AS DOUBLE) AS backup_size,
      CAST({q.idiv(size, '(1 + o_orderkey % 4)')} AS DOUBLE) AS compressed_backup_size,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'NT AUTHORITY' || {BS} || 'SYSTEM'
        WHEN '2-HIGH' THEN 'agent' ELSE 'dba' END AS user_name,
      o_orderkey % 10 = 0 AS is_copy_only, o_orderkey % 17 = 0 AS is_snapshot,
      {pick('o_custkey', ['SIMPLE', 'FULL', 'BULK_LOGGED'])} AS recovery_model
    FROM {{orders}}"""


def backupmediafamily(q):
    return f"""SELECT {srv('(' + DID + ')')} AS server_name, o_orderkey AS media_set_id,
      CASE WHEN a % 2 = 0 THEN 2 ELSE 7 END AS device_type,
      CASE WHEN f = 'A' THEN 'C:' || {BS} || 'bak' || {BS} || {text('a')} || '.bak'
        WHEN f = 'N' THEN {BS} || {BS} || 'share' || {BS} || {text('a')} || '.bak'
        WHEN t = 'F' THEN {LB} || {text('a')} || {RB} || '1'
        ELSE 'VNBU0-' || {text('a')} END AS physical_device_name
    FROM (SELECT l_orderkey, min(l_partkey) AS a, chr(min(ascii(l_returnflag))) AS f, chr(min(ascii(l_linestatus))) AS t
          FROM {{lineitem}} GROUP BY l_orderkey) m
    JOIN {{orders}} o ON o.o_orderkey = m.l_orderkey"""


def server_services(q):
    """Agent account per server, one row for each of the servers seen in the data."""
    return f"""SELECT {srv('c_custkey')} AS server_name, 'Agent service' AS servicename,
      'agent' AS service_account FROM {{customer}} GROUP BY 1"""


def restorehistory(q):
    did = f"({DID})"
    return f"""SELECT {srv(did)} AS server_name, o_orderkey AS restore_history_id,
      o_orderkey AS backup_set_id, 'db_r' || {text('o_custkey')} AS destination_database_name,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'D' WHEN '2-HIGH' THEN 'I' WHEN '3-MEDIUM' THEN 'L'
        WHEN '5-LOW' THEN 'F' ELSE 'V' END AS restore_type,
      {q.add_seconds('o_orderdate', '86400')} AS restore_date, 'dba' AS user_name
    FROM {{orders}}"""


def restorefile(q):
    return f"""SELECT {srv('(' + DID + ')')} AS server_name, l_orderkey AS restore_history_id,
      {big('l_linenumber')} AS file_number,
      'R:' || {BS} || 'f_' || {text('l_partkey')} || '.mdf' AS destination_phys_name
    FROM {{lineitem}} l JOIN {{orders}} o ON o.o_orderkey = l.l_orderkey"""


# -- jobs ---------------------------------------------------------------------------------------

def jobs(q):
    return f"""SELECT {srv('user_id')} AS server_name, user_id AS job_id,
      'job_' || {text('user_id')} AS name, {q.binary(sid_hex('user_id'))} AS owner_sid,
      lpad(hex(user_id), 8, '0') || '-0000-4000-8000-000000000000' AS job_guid
    FROM {{events}} GROUP BY user_id"""


def job_history(q):
    d = whole('value * 60')
    packed = (f"({q.idiv(d, 3600)} * 10000 + {q.idiv(f'({d}) % 3600', 60)} * 100 + ({d}) % 60)")
    return f"""SELECT {srv('user_id')} AS server_name, event_id AS instance_id, user_id AS job_id,
      event_id % 3 AS step_id, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS run_status,
      {big('year(ts)')} * 10000 + {big('month(ts)')} * 100 + {big('day(ts)')} AS run_date,
      {big('hour(ts)')} * 10000 + {big('minute(ts)')} * 100 + {big('second(ts)')} AS run_time,
      {packed} AS run_duration
    FROM {{events}}"""


def jobservers(q):
    return """SELECT h.server_name, h.job_id, h.run_status AS last_run_outcome,
      h.run_date AS last_run_date, h.run_time AS last_run_time, h.run_duration AS last_run_duration,
      'step 0 of ' || CAST(h.instance_id AS STRING) AS last_outcome_message
    FROM {job_history} h
    JOIN (SELECT job_id AS j, max(instance_id) AS i FROM {job_history} WHERE step_id = 0
          GROUP BY job_id) m ON h.job_id = m.j AND h.instance_id = m.i"""


def ag_jobs(q):
    return f"""SELECT 'ag_' || {text(q.idiv('user_id', 15))} AS group_name, user_id AS job_id,
      'job_' || {text('user_id')} AS name FROM {{events}} GROUP BY user_id"""


def ag_members(q):
    return f"""SELECT 'ag_' || {text(q.idiv('s_suppkey', 10))} AS group_name,
      'rep_' || {text('s_suppkey')} AS replica_name,
      CASE WHEN s_suppkey % 10 = 0 THEN 'Primary' ELSE 'Secondary' END AS role
    FROM {{supplier}}"""


# -- storage ------------------------------------------------------------------------------------

def _file_db(q):
    return q.idiv('p_partkey', 20)


def _data_path(q):
    return (f"('D:' || {BS} || 'data' || {BS} || 'v' || {text(_file_db(q))} || {BS} || 'f_' || "
            f"{text('p_partkey')} || CASE WHEN p_partkey % 2 = 1 THEN '.ldf' "
            f"WHEN p_partkey % 4 = 2 THEN '.ndf' ELSE '.mdf' END)")


def master_files(q):
    d = _file_db(q)
    return f"""SELECT {srv(d)} AS server_name, {d} AS database_id, {db_name(d)} AS database_name,
      p_partkey AS file_id, p_partkey % 2 AS type,
      CASE WHEN p_partkey % 2 = 1 THEN 'LOG' ELSE 'ROWS' END AS type_desc,
      'f_' || {text('p_partkey')} AS name, {_data_path(q)} AS physical_name,
      {whole('p_retailprice * 100')} AS size,
      {q.idiv(whole('p_retailprice * 100') + ' * ' + big('p_size'), 60)} AS used_pages,
      CASE WHEN p_partkey % 4 = 0 THEN 10 ELSE 128 * (p_partkey % 200) END AS growth,
      p_partkey % 4 = 0 AS is_percent_growth,
      CASE WHEN p_partkey % 5 = 0 THEN -1 ELSE {whole('p_retailprice * 100')} * 2 END AS max_size,
      {d} AS volume_id
    FROM {{part}}"""


def volumes(q):
    total = "((200 + 50 * (s_suppkey % 1000)) * 1073741824)"
    return f"""SELECT {srv('s_suppkey')} AS server_name, s_suppkey AS volume_id,
      'V' || {text('s_suppkey')} || ':' || {BS} AS mount_point, s_name AS logical_volume_name,
      {total} AS total_bytes, {q.idiv(total + ' * ((s_suppkey * 13) % 100)', 100)} AS available_bytes
    FROM {{supplier}}"""


def volume_xml_lines(q):
    """Printed XML of each server's volumes: ten volumes a server, one line each."""
    server = f"'srv_' || {text(q.idiv('s_suppkey', 10))} AS server_name"
    return f"""SELECT {server}, -1 AS line, '<Objects>' AS output FROM {{supplier}} GROUP BY {q.idiv('s_suppkey', 10)}
    UNION ALL SELECT {server}, s_suppkey, '<Object Type="CimInstance"><Property Name="Name" Type="String">V' || {text('s_suppkey')}
      || ':' || {BS} || ' - ' || s_name || '</Property>'
      || CASE WHEN s_acctbal < 0 THEN '' ELSE '<Property Name="freeSpaceMB" Type="Double">' || {text('s_suppkey * 1000 + 0.125')} || '</Property>' END
      || '<Property Name="capacityMB" Type="Double">' || {text('s_suppkey * 2000')} || '</Property></Object>' FROM {{supplier}}
    UNION ALL SELECT {server}, 1000000000000, '</Objects>' FROM {{supplier}} GROUP BY {q.idiv('s_suppkey', 10)}"""


def file_inventory(q):
    name = f"'f_' || {text('p_partkey')}"
    return f"""SELECT {srv(_file_db(q))} AS server_name,
      CASE WHEN p_size <= 40 THEN {_data_path(q)}
        WHEN p_size <= 43 THEN 'D:' || {BS} || 'bak' || {BS} || {name} || '.bak'
        WHEN p_size <= 46 THEN 'D:' || {BS} || 'bak' || {BS} || {name} || '.trn'
        WHEN p_size = 47 THEN 'D:' || {BS} || '$RECYCLE_BIN' || {BS} || {name} || '.mdf'
        WHEN p_size = 48 THEN 'D:' || {BS} || 'app' || {BS} || {name} || '.exe'
        ELSE 'D:' || {BS} || 'old' || {BS} || {name} || '.mdf' END AS path,
      {whole('p_retailprice * 1e6')} AS length,
      {q.add_seconds(q.stamp('2024-01-01 00:00:00'), '-86400 * (p_partkey % 400)')} AS modified
    FROM {{part}}"""


def directories(q):
    return f"""SELECT {srv('c_custkey')} AS server_name,
      'D:' || {BS} || 'data' || {BS} || 'v' || {text('c_custkey')} AS directory FROM {{customer}}"""


def index_columns(q):
    return f"""SELECT {srv(q.idiv('p_partkey', 32))} AS server_name, 'dbo' AS schema_name,
      't_' || {text(q.idiv('p_partkey', 32))} AS table_name,
      'ix_' || {text(q.idiv('p_partkey', 16))} AS index_name,
      'c_' || {text('p_partkey')} AS column_name, p_partkey % 16 + 1 AS ordinal,
      p_size % 2 = 1 AS is_descending, p_size % 5 = 0 AND p_partkey % 16 <> 0 AS is_included
    FROM {{part}}"""


def indexes(q):
    g = q.idiv('p_partkey', 16)
    return f"""SELECT {srv(q.idiv('p_partkey', 32))} AS server_name, 'dbo' AS schema_name,
      't_' || {text(q.idiv('p_partkey', 32))} AS table_name, 'ix_' || {text(g)} AS index_name,
      {g} % 3 = 0 AS is_unique, CASE WHEN {g} % 2 = 0 THEN 'CLUSTERED' ELSE 'NONCLUSTERED' END AS type_desc,
      {g} % 4 = 1 AS is_padded, {g} % 5 <> 0 AS allow_page_locks, true AS allow_row_locks,
      false AS no_recompute, {g} % 7 = 0 AS ignore_dup_key, 80 + {g} % 20 AS fill_factor,
      {g} % 6 = 5 AS is_disabled, {g} % 10 = 9 AS is_primary_key, {g} % 10 = 8 AS is_unique_constraint,
      'PRI]MARY' AS filegroup_name, 1 AS type
    FROM {{part}} WHERE p_size >= 1 GROUP BY {g}, {q.idiv('p_partkey', 32)}"""


# -- sessions and workload ----------------------------------------------------------------------

def sessions(q):
    at = q.stamp('2024-01-01 00:00:00')
    return f"""SELECT {srv('c_custkey')} AS server_name, c_custkey + 1 AS session_id,
      'login_' || {text('c_nationkey')} AS login_name,
      CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE 'host_' || {text('c_custkey % 20')} END AS host_name,
      CASE WHEN c_custkey % 9 = 1 THEN 'SQLAgent - TSQL JobStep (Job 0x'
          || substr(lpad(hex(c_custkey), 8, '0'), 7, 2) || substr(lpad(hex(c_custkey), 8, '0'), 5, 2)
          || substr(lpad(hex(c_custkey), 8, '0'), 3, 2) || substr(lpad(hex(c_custkey), 8, '0'), 1, 2)
          || '000000408000000000000000 : Step 1)' ELSE c_mktsegment END AS program_name,
      c_custkey AS database_id, {db_name('c_custkey')} AS database_name,
      CASE WHEN c_acctbal < 0 THEN 'sleeping' ELSE 'running' END AS status,
      c_custkey % 9 <> 0 AS is_user_process,
      {q.add_seconds(at, '(c_custkey * 3607) % 2592000')} AS last_batch,
      {q.add_seconds(at, '(c_custkey * 1009) % 2592000')} AS login_time,
      {q.add_seconds(at, '(c_custkey * 2003) % 2592000')} AS last_request_start_time,
      {q.add_seconds(at, '(c_custkey * 2003) % 2592000 + 30')} AS last_request_end_time,
      c_custkey % 3 AS open_tran, {whole('abs(c_acctbal)')} AS cpu, c_custkey % 50 AS memusage,
      c_custkey % 70 AS physical_io, 'CXPACKET' AS lastwaittype,
      {q.idiv('c_custkey', 8)} * 4 + c_custkey % 4 AS sql_handle, 'EXEC proc_' || {text('c_custkey')} AS input_buffer
    FROM {{customer}}"""


def processes(q):
    return f"""SELECT 'srv_0' AS server_name, c_custkey + 1 AS spid,
      CASE WHEN c_custkey < 2 OR (c_custkey + 1) % 5 = 0 THEN 0 ELSE {q.idiv('c_custkey + 1', 3)} END AS blocked,
      'select' || chr(10) || c_mktsegment || chr(13) || c_name AS batch
    FROM {{customer}}"""


def requests(q):
    handle = f"({q.idiv(q.idiv('event_id', 10), 4)} * 4 + user_id % 4)"
    return f"""SELECT {srv('user_id')} AS server_name, event_id AS request_id, user_id + 1 AS session_id,
      CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 100 END AS DOUBLE) AS percent_complete,
      {whole('value * 60000')} AS estimated_completion_time, {whole('value * 1000')} AS cpu_time,
      2 * (event_id % 50) AS statement_start_offset,
      CASE WHEN event_id % 5 = 0 THEN -1 ELSE 2 * (event_id % 50) + 2 * (event_id % 80) END AS statement_end_offset,
      {handle} AS sql_handle, user_id AS database_id, {db_name('user_id')} AS database_name,
      ts AS start_time, upper(event_type) AS command, {whole('value')} AS wait_time,
      'PAGE: ' || {text('event_id % 100')} AS wait_resource, user_id % 7 AS blocking_session_id
    FROM {{events}}"""


def active_requests(q):
    """The newest request of each session."""
    return """SELECT r.* FROM {requests} r
    JOIN (SELECT session_id AS s, max(request_id) AS newest FROM {requests} GROUP BY session_id) m
      ON r.session_id = m.s AND r.request_id = m.newest"""


def query_stats(q):
    h = q.idiv('event_id', 10)
    k = q.json_int('props', 'k')
    return f"""SELECT {srv(h)} AS server_name, {k} AS query_hash,
      2 * ({k} % 50) AS statement_start_offset,
      CASE WHEN {k} % 5 = 0 THEN -1 ELSE 2 * ({k} % 50) + 2 * ({k} % 80) END AS statement_end_offset,
      event_id AS plan_handle, {h} AS sql_handle, ts AS creation_time,
      {q.add_seconds('ts', whole('value'))} AS last_execution_time, 1 + event_id % 7 AS execution_count,
      {whole('value * 1000')} AS total_worker_time, {whole('value * 1500')} AS total_elapsed_time,
      {whole('value * 10')} AS total_logical_reads, {whole('value')} AS total_logical_writes
    FROM {{events}}"""


def query_texts(q):
    return f"SELECT {srv('doc_id')} AS server_name, doc_id AS sql_handle, text FROM {{documents}}"


def session_transactions(q):
    return f"""SELECT {srv('o_custkey')} AS server_name, o_custkey + 1 AS session_id,
      o_orderkey AS transaction_id FROM {{orders}}"""


def database_transactions(q):
    return f"""SELECT {srv('o_custkey')} AS server_name, o_orderkey AS transaction_id,
      o_custkey AS database_id, CASE WHEN o_custkey % 10 = 7 THEN NULL ELSE {db_name('o_custkey')} END AS database_name,
      CASE WHEN o_orderstatus = 'P' THEN NULL
        ELSE {q.add_seconds(q.stamp('2024-01-01 00:00:00'), '(o_orderkey * 7919) % 2592000')} END AS begin_time,
      {pick('o_orderkey', [1, 3, 4, 5, 10, 11, 12, 99])} AS state,
      {whole('o_totalprice')} AS log_bytes_used, {whole('o_totalprice * 2')} AS log_bytes_reserved
    FROM {{orders}}"""


def ring_buffer_values(q):
    return f"""SELECT 'srv_' || {text(q.idiv('event_id', 256))} AS server_name, event_id AS record_id,
      event_id * 1000 AS ticks, event_id % 60 AS sql_cpu, 100 - event_id % 60 - event_id % 30 AS idle
    FROM {{events}}"""


def ring_buffer(q):
    """Scheduler records as the XML a server keeps (256 records a server)."""
    return """SELECT server_name, ticks, '<Record id="' || CAST(record_id AS STRING)
      || '" type="RING_BUFFER_SCHEDULER_MONITOR"><SchedulerMonitorEvent><SystemHealth><ProcessUtilization>'
      || CAST(sql_cpu AS STRING) || '</ProcessUtilization><SystemIdle>' || CAST(idle AS STRING)
      || '</SystemIdle></SystemHealth></SchedulerMonitorEvent></Record>' AS record FROM {ring_buffer_values}"""


def sys_info(q):
    return f"""SELECT 'srv_' || {text(q.idiv('event_id', 256))} AS server_name,
      max(event_id) * 1000 + 5000 AS ms_ticks FROM {{events}} GROUP BY {q.idiv('event_id', 256)}"""


def schedulers(q):
    return f"""SELECT 'srv_' || {text(q.idiv('c_custkey', 16))} AS server_name, c_custkey % 16 AS scheduler_id,
      {q.idiv('c_custkey % 16', 4)} AS parent_node_id, c_acctbal >= 0 AS is_online,
      CASE WHEN c_mktsegment = 'MACHINERY' THEN 'HIDDEN ONLINE' ELSE 'VISIBLE ONLINE' END AS status,
      c_custkey % 11 AS active_workers_count, c_custkey % 5 AS runnable_tasks_count,
      c_custkey % 3 AS work_queue_count FROM {{customer}}"""


def hosts(q):
    major = pick('s_suppkey', [9, 10, 11, 13, 15, 16])
    return f"""SELECT 'srv_' || {text('s_suppkey')} AS server_name, 'HOST' || {text('s_suppkey')} AS machine_name,
      512 + 64 * (s_suppkey % 8) AS max_workers_count,
      (1048576 * (1 + (s_suppkey * 37) % 300) + (s_suppkey % 1000) * 1024) AS total_physical_memory_kb,
      {pick('s_suppkey', [1804890536, -2117995310, -1534726760, 284895786])} AS edition_id,
      {pick('s_suppkey', [2, 3, 4])} AS engine_edition, {major} AS major_version,
      'Product ' || {text(f'({major})')} || '.0.' || {text('1000 + s_suppkey')} || CASE s_suppkey % 3
        WHEN 0 THEN ' <X64>' WHEN 1 THEN ' <IA64>' ELSE ' <X86>' END || ' build' AS version_banner,
      {text(f'({major})')} || '.0.' || {text('1000 + s_suppkey')} AS product_version,
      CASE s_suppkey % 5 WHEN 0 THEN 2147483647 ELSE 4096 * (1 + (s_suppkey * 31) % 90) END AS max_server_memory_mb,
      CASE s_suppkey % 5 WHEN 0 THEN 2147483647 ELSE 2048 * (1 + (s_suppkey * 31) % 90) END AS running_memory_mb,
      CASE s_suppkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 4096 * (1 + (s_suppkey * 31) % 90) ELSE 1024 END AS min_server_memory_mb,
      {pick('s_suppkey', ['VMware', 'Dell', 'Microsoft'])} AS system_manufacturer,
      s_suppkey % 6 = 0 AS is_clustered, 1800 + 7 * (s_suppkey % 400) AS cpu_mhz,
      {pick('s_suppkey', ['a1841308-3541-4fab-bc81-f71556f20b4a', '381b4222-f694-41f0-9685-ff5bb260df2e',
                          '8c5e7fda-e8bf-4a96-9a85-a6e23a8c635c', 'e9a42b02-d5df-448d-aa00-03f14749eb61', 'custom'])} AS power_scheme
    FROM {{supplier}}"""


def regions(q):
    return f"""SELECT 'srv_' || {text('l_suppkey')} AS server_name,
      CASE WHEN l_returnflag = 'N' THEN 0 ELSE l_partkey + 1 END AS allocation_base,
      {whole('l_quantity')} * 4096 AS region_size FROM {{lineitem}}"""


def locks(q):
    return f"""SELECT {srv('o_custkey')} AS server_name, o_custkey + 1 AS request_session_id,
      CASE WHEN o_orderstatus = 'F' THEN '00000000-0000-0000-0000-000000000000'
        ELSE lpad(hex(o_orderkey % 1000), 8, '0') || '-0000-4000-8000-000000000000' END AS request_owner_guid
    FROM {{orders}}"""


def index_stats(q):
    return f"""SELECT {srv(q.idiv('p_partkey', 20))} AS server_name, {db_name(q.idiv('p_partkey', 20))} AS database_name,
      p_partkey AS object_id, p_partkey % 3 AS index_id, 't_' || {text('p_partkey')} AS table_name,
      CASE p_partkey % 3 WHEN 0 THEN 'HEAP' ELSE 'NONCLUSTERED INDEX' END AS index_type_desc,
      {whole('p_retailprice')} AS page_count, {big('p_size')} / 50.0e0 * 100 AS avg_fragmentation_in_percent,
      CASE WHEN p_type = 'PROMO' THEN {big('p_size')} ELSE 0 END AS forwarded_record_count FROM {{part}}"""


def object_indexes(q):
    return f"""SELECT {srv(q.idiv('p_partkey', 20))} AS server_name, {db_name(q.idiv('p_partkey', 20))} AS database_name,
      p_partkey AS object_id, p_partkey % 3 AS index_id, 'ix_' || {text('p_partkey')} AS index_name
    FROM {{part}}"""


# -- logs and events ----------------------------------------------------------------------------

def trace(q):
    signup = pick('event_id', [55, 58, 69, 79, 80, 164])
    cls = (f"CASE event_type WHEN 'view' THEN 92 + event_id % 2 WHEN 'click' THEN 116 "
           f"WHEN 'purchase' THEN 115 WHEN 'error' THEN 22 ELSE {signup} END")
    dbcc = pick('event_id', ['DBCC SHRINKFILE (f)', 'DBCC CHECKDB (d)', 'DBCC INPUTBUFFER (1)'])
    return f"""SELECT {srv('user_id')} AS server_name, event_id, {big(cls)} AS event_class,
      1 + event_id % 2 AS event_subclass, {db_name('user_id')} AS database_name,
      CASE WHEN event_type = 'click' THEN {dbcc} ELSE event_type END AS text_data,
      'f_' || {text('user_id * 20 + event_id % 20')} AS file_name, ts AS start_time,
      {q.add_seconds('ts', whole('value'))} AS end_time, {whole('value * 1e6')} AS duration,
      user_id AS spid, 'login_' || {text('user_id % 25')} AS login_name,
      'app_' || {text('user_id % 6')} AS application_name, event_id % 500 AS object_id,
      'obj_' || {text('event_id % 500')} AS object_name, CASE WHEN user_id % 2 = 0 THEN 16964 ELSE 8277 END AS object_type,
      event_id % 4 AS index_id, 'host_' || {text('user_id % 20')} AS host_name,
      'ntuser_' || {text('user_id % 25')} AS nt_user_name, 'DOM' AS nt_domain_name
    FROM {{events}}"""


def error_code():
    return pick('event_id', ERROR_CODES)


def errorlog(q):
    return f"""SELECT {srv('user_id')} AS server_name, event_id % 6 AS log_id, event_id AS line_no, ts AS log_date,
      'spid' || {text('user_id')} AS spid,
      CASE event_type
        WHEN 'error' THEN 'Error: ' || {text('(' + error_code() + ')')} || ', Severity: 16, State: 1.'
        WHEN 'click' THEN 'SQL Server has encountered ' || {text('event_id % 9')}
          || ' occurrence(s) of I/O requests taking longer than 15 seconds to complete on file [f_' || {text('user_id')} || ']'
        WHEN 'view' THEN 'SQL Server has encountered ' || {text('event_id % 5')}
          || ' occurrence(s) of cachestore flush for the Bound Trees cachestore'
        WHEN 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'deadlock-list: Error: in stack dump ' || {text('event_id % 40')}
          ELSE 'Error: no comma here ' || {text('event_id % 7')} END
        ELSE CASE WHEN event_id % 3 = 0
          THEN 'A significart login succeeded for user login_' || {text('user_id')}
          ELSE 'A significant part of sql server process memory has been paged out. Duration: ' || {text('event_id % 90')} END
      END AS log_msg
    FROM {{events}}"""


def messages(q):
    """Message templates by number; one row for each number the data can carry."""
    n = f"CASE p_partkey % 2 WHEN 0 THEN ({pick(q.idiv('p_partkey', 2), ERROR_CODES)}) ELSE 50000 + p_partkey END"
    return f"""SELECT {n} AS message_id, 1033 AS language_id,
      'Message ' || {text('(' + n + ')')} || ': object %.*ls in page %S_PGID of %d%ls took %I64d' AS text
    FROM {{part}} GROUP BY {n}"""


def xe_values(q):
    """The values behind the XML event documents."""
    return f"""SELECT {srv('user_id')} AS server_name, event_id, ts, user_id, event_type,
      CASE event_type WHEN 'error' THEN 'error_reported' WHEN 'view' THEN 'availability_replica_state_change'
        WHEN 'click' THEN 'alwayson_ddl_executed' WHEN 'purchase' THEN 'availability_group_lease_expired'
        ELSE 'availability_replica_manager_state_change' END AS event_name,
      {big(pick('event_id', HA_CODES))} AS error_number, 10 + event_id % 12 AS severity, event_id % 3 AS error_state,
      'ag_' || {text('user_id % 10')} AS ag_name, 'rep_' || {text('user_id % 30')} AS replica_name,
      {pick('event_id', ['PRIMARY_NORMAL', 'RESOLVING_NORMAL', 'SECONDARY_NORMAL'])} AS previous_state,
      {pick('event_id + 1', ['PRIMARY_NORMAL', 'RESOLVING_NORMAL', 'SECONDARY_NORMAL'])} AS current_state,
      CASE WHEN event_id % 4 = 0 THEN 'ALTER AVAILABILITY GROUP [ag] ' || chr(10) || 'failover'
        ELSE 'ALTER AVAILABILITY GROUP [ag] ' || chr(10) || 'ADD DATABASE [db_' || {text('user_id')} || ']' END AS statement,
      'message for ' || {text('event_id % 100')} AS message
    FROM {{events}}"""


def _node(name: str, value: str, shown: str | None = None) -> str:
    """Data node with its value and, as the server writes it, a text that may be empty."""
    return (f"'<data name=\"{name}\"><value>' || {value} || '</value><text>' || "
            f"{shown or repr('')} || '</text></data>'")


def xe_events(q):
    """One XML event per row."""
    n = "'1'"
    error = " || ".join([
        _node("error_number", text("error_number")), _node("severity", text("severity")),
        _node("state", text("error_state")), _node("user_defined", "'false'"),
        _node("category", "'2'", "'SERVER'"), _node("destination", "'0x2'", "'ERRORLOG'"),
        _node("is_intercepted", "'false'"), _node("message", "message"),
        "'<action name=\"session_id\"><value>' || " + text("user_id") + " || '</value></action>'"])
    ddl = " || ".join([
        _node("ddl_action", n, "'ALTER'"), _node("ddl_phase", "'2'", "'COMMITTED WITH CARE'"),
        _node("statement", "statement"), _node("availability_group_id", text("user_id % 10")),
        _node("availability_group_name", "ag_name")])
    state = " || ".join([
        _node("previous_state", n, "previous_state"), _node("current_state", "'2'", "current_state"),
        _node("availability_group_id", text("user_id % 10")), _node("availability_group_name", "ag_name"),
        _node("availability_replica_name", "replica_name")])
    lease = " || ".join([_node("availability_group_id", text("user_id % 10")),
                         _node("availability_group_name", "ag_name")])
    manager = _node("current_state", "'2'", "current_state")
    return f"""SELECT server_name, event_id, '<event name="' || event_name || '" timestamp="'
      || replace({q.millis_text('ts')}, ' ', 'T') || 'Z">' || CASE event_type WHEN 'error' THEN {error}
        WHEN 'click' THEN {ddl} WHEN 'view' THEN {state} WHEN 'purchase' THEN {lease} ELSE {manager} END
      || '</event>' AS event_xml FROM {{xe_values}}"""


def xe_targets(q):
    """Ring buffer targets: documents of at most 64 events."""
    return f"""SELECT server_name, {q.idiv('event_id', 64)} AS target_id,
      '<RingBufferTarget truncated="0">' || string_agg(event_xml, '') || '</RingBufferTarget>' AS target_data
    FROM {{xe_events}} GROUP BY server_name, {q.idiv('event_id', 64)}"""


def alert_events(q):
    return f"""SELECT {srv('user_id')} AS server_name, event_id, ts AS event_time,
      CASE WHEN event_type = 'error' THEN {big(error_code())} ELSE 0 END AS error_number,
      CASE WHEN event_type = 'error' THEN 14 + event_id % 12 ELSE event_id % 10 END AS severity
    FROM {{events}}"""


def progress(q):
    span = q.seconds_between('a', 'b')
    done = q.seconds_between('a', 'ts')
    return f"""SELECT {srv('e.user_id')} AS server_name, e.user_id AS job_id, event_id AS sample_id,
      ts AS sampled_at, CAST({q.idiv(f'1000 * {done}', f'({span} + 1)')} AS DOUBLE) / 10 AS percent_complete
    FROM {{events}} e
    JOIN (SELECT user_id AS u, min(ts) AS a, max(ts) AS b FROM {{events}} GROUP BY user_id) s
      ON e.user_id = s.u"""


def counters(q):
    return f"""SELECT {srv('user_id')} AS server_name, event_id AS sample_id, ts AS captured_at,
      event_type AS counter_name, 'i_' || {text('user_id % 10')} AS instance_name,
      event_id * 1000 + {whole('value')} AS value FROM {{events}}"""


def os_events(q):
    return f"""SELECT 'HOST' || {text('user_id')} AS machine_name, event_id AS record_number,
      CASE event_type WHEN 'view' THEN 'Application' WHEN 'signup' THEN 'Setup' WHEN 'error' THEN 'Security'
        ELSE 'System' END AS log_name,
      CASE WHEN event_type = 'click' THEN 1074 ELSE 7000 + event_id % 40 END AS event_code,
      CASE WHEN event_type = 'purchase' THEN 'Service Control Manager' ELSE 'Other' END AS source,
      CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'FailureAudit' ELSE 'SuccessAudit' END
        ELSE 'Information' END AS entry_type,
      'The service_' || {text('user_id % 8')} || ' service entered the running state' AS message,
      'user_' || {text('user_id')} AS user_name, ts AS time_generated
    FROM {{events}}"""


def ini_lines(q):
    return f"""SELECT 'servers_' || {text('c_nationkey')} || '.txt' AS file, c_custkey AS line_no,
      CASE WHEN c_acctbal < 0 THEN '[' || c_mktsegment || ']'
        WHEN c_acctbal < 800 THEN '[' || c_mktsegment || {BS} || 'sub' || {text('c_custkey % 10')} || ']'
        WHEN c_acctbal < 1500 THEN '; comment' WHEN c_acctbal < 2200 THEN '# note'
        WHEN c_acctbal < 3000 THEN '   ' ELSE '  ' || c_name || ' ' END AS line
    FROM {{customer}}"""


def _host(q):
    return f"'HOST' || {text(q.idiv('c_custkey', 15))}"


def account_spn_lines(q):
    return f"""SELECT 'srv_' || {text(q.idiv('c_custkey', 15))} AS server_name, c_custkey AS line,
      CASE WHEN c_mktsegment = 'FURNITURE' THEN 'Registered ServicePrincipalNames for CN=x:'
        WHEN c_mktsegment = 'MACHINERY' THEN chr(9) || 'MSSQLSvc/OTHER' || {text('c_custkey % 5')} || '.corp:1433'
        ELSE chr(9) || 'MSSQLSvc/' || {_host(q)} || '.corp:' || {text('1433 + c_custkey % 15')} END AS output
    FROM {{customer}}"""


def duplicate_spn_lines(q):
    server = f"'srv_' || {text(q.idiv('c_custkey', 15))} AS server_name"
    dup = "c_mktsegment IN ('MACHINERY', 'HOUSEHOLD')"
    head = (f"CASE WHEN c_mktsegment = 'MACHINERY' THEN 'MSSQLSvc/OTHER' || {text('c_custkey % 5')} || '.corp:1433'"
            f" ELSE 'MSSQLSvc/' || {_host(q)} || '.corp:' || {text('1433 + c_custkey % 15')} END"
            " || ' is registered on these accounts:'")
    return f"""SELECT {server}, c_custkey * 4 AS line, {head} AS output FROM {{customer}} WHERE {dup}
    UNION ALL SELECT {server}, c_custkey * 4 + 1, chr(9) || 'CN=acct_' || {text('c_custkey')} FROM {{customer}} WHERE {dup}
    UNION ALL SELECT {server}, c_custkey * 4 + 2, chr(9) || 'CN=acct_' || c_mktsegment FROM {{customer}} WHERE {dup}
    UNION ALL SELECT {server}, c_custkey * 4 + 3, NULL FROM {{customer}} WHERE {dup}"""


# -- availability -------------------------------------------------------------------------------

def connections(q):
    return f"""SELECT {srv('c_custkey')} AS server_name, c_custkey + 1 AS session_id,
      CASE WHEN c_nationkey % 5 = 0 THEN 'Shared Memory' ELSE 'TCP' END AS net_transport,
      '10.0.' || {text('c_nationkey')} || '.' || {text('c_custkey % 250')} AS client_net_address,
      '10.1.' || {text(q.idiv('c_custkey', 15) + ' * 4 + c_custkey % 4')} AS local_net_address,
      40000 + c_custkey % 20000 AS client_tcp_port,
      CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE 1433 + c_custkey % 4 END AS local_tcp_port,
      CASE WHEN c_custkey % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END AS encrypt_option, 'NTLM' AS auth_scheme,
      {q.idiv('c_custkey', 8)} * 4 + c_custkey % 4 AS most_recent_sql_handle
    FROM {{customer}}"""


def listener_ips(q):
    return f"""SELECT {srv('s_suppkey')} AS server_name, s_suppkey AS listener_id,
      '10.1.' || {text('s_suppkey')} AS ip_address FROM {{supplier}}"""


def listeners(q):
    return f"""SELECT {srv('s_suppkey')} AS server_name, s_suppkey AS listener_id,
      'lsn_' || {text('s_suppkey')} AS dns_name, 5000 + s_suppkey AS port FROM {{supplier}}"""


def server_registry(q):
    return f"""SELECT {srv('s_suppkey')} AS server_name,
      CASE WHEN s_acctbal > 2000 THEN 'IpAddress' ELSE 'TcpPort' END AS value_name,
      '10.1.' || {text('s_suppkey')} AS value_data FROM {{supplier}}"""


def availability_groups(q):
    return f"""SELECT {srv('s_suppkey')} AS server_name, s_suppkey AS group_id,
      'ag_' || {text('s_suppkey')} AS name FROM {{supplier}}"""


def availability_replicas(q):
    g = q.idiv('c_custkey', 15)
    return f"""SELECT {srv(g)} AS server_name, c_custkey AS replica_id, {g} AS group_id,
      'rep_' || {text('c_custkey')} AS replica_server_name,
      'TCP://rep_' || {text('c_custkey')} || ':5022' AS endpoint_url, {q.binary(sid_hex('c_custkey'))} AS owner_sid
    FROM {{customer}}"""


def replica_states(q):
    return f"""SELECT {srv(q.idiv('c_custkey', 15))} AS server_name, c_custkey AS replica_id,
      c_mktsegment = 'BUILDING' AS is_local,
      CASE WHEN c_acctbal < 0 THEN 'DISCONNECTED' ELSE 'CONNECTED' END AS connected_state_desc,
      CASE WHEN c_acctbal < 0 THEN 'timeout' ELSE NULL END AS last_connect_error_description,
      CASE WHEN c_acctbal < 0 THEN 10060 ELSE NULL END AS last_connect_error_number,
      CASE WHEN c_acctbal < 0 THEN {q.add_seconds(q.stamp('2024-01-01 00:00:00'), 'c_custkey')} ELSE NULL END
        AS last_connect_error_timestamp
    FROM {{customer}}"""


def cluster_databases(q):
    g = q.idiv('p_partkey', 20)
    return f"""SELECT {srv(g)} AS server_name, {g} AS group_id, p_partkey AS group_database_id,
      'agdb_' || {text('p_partkey')} AS database_name FROM {{part}}"""


def database_replica_states(q):
    g = q.idiv('l_partkey', 20)
    return f"""SELECT {srv(g)} AS server_name, {g} AS group_id, l_partkey AS group_database_id,
      {g} * 15 + {big('l_linenumber')} AS replica_id, l_returnflag = 'R' AS is_suspended,
      l_linenumber = 1 AS is_local, l_linenumber = 1 AS is_primary_replica,
      CASE l_linestatus WHEN 'O' THEN 'SYNCHRONIZED' ELSE 'SYNCHRONIZING' END AS synchronization_state_desc,
      CASE l_returnflag WHEN 'A' THEN 'HEALTHY' ELSE 'NOT_HEALTHY' END AS synchronization_health_desc,
      l_orderkey AS last_commit_lsn, {whole('l_extendedprice')} AS log_send_queue_size,
      {whole('l_quantity')} AS redo_queue_size,
      {q.add_seconds('l_shipdate', 'l_orderkey % 86400')} AS last_commit_time
    FROM {{lineitem}}"""


def automatic_seeding(q):
    g = q.idiv('o_custkey', 15)
    return f"""SELECT {srv(g)} AS server_name, {g} AS ag_id, {g} * 20 + o_orderkey % 20 AS ag_db_id,
      o_orderdate AS start_time, {q.add_seconds('o_orderdate', 'o_orderkey % 9000')} AS completion_time,
      CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' ELSE 'FAILED' END AS current_state,
      o_orderstatus = 'F' AS performed_seeding, o_orderkey % 5 AS failure_state,
      'state ' || {text('o_orderkey % 5')} AS failure_state_desc FROM {{orders}}"""


def physical_seeding(q):
    return f"""SELECT {srv('o_custkey')} AS server_name, {db_name('o_custkey')} AS local_database_name,
      'rep_' || {text('o_orderkey % 30')} AS remote_machine_name,
      CASE WHEN o_orderkey % 2 = 0 THEN 'Source' ELSE 'Destination' END AS role_desc,
      'Success' AS internal_state_desc, {whole('o_totalprice * 1000')} AS transfer_rate_bytes_per_second,
      {whole('o_totalprice * 1e6')} AS transferred_size_bytes,
      {whole('o_totalprice * 1e8')} AS database_size_bytes, o_orderkey % 3 = 0 AS is_compression_enabled
    FROM {{orders}}"""


def endpoints(q):
    return f"""SELECT {srv('s_suppkey')} AS server_name, s_suppkey + 65536 AS endpoint_id,
      'ep_' || {text('s_suppkey')} AS name, s_suppkey AS principal_id,
      CASE WHEN s_acctbal > 1000 THEN 'DATABASE_MIRRORING' ELSE 'TSQL' END AS type_desc,
      CASE WHEN s_acctbal > 3000 THEN 'STARTED' ELSE 'STOPPED' END AS state_desc FROM {{supplier}}"""


def server_permissions(q):
    return f"""SELECT {srv('c_custkey')} AS server_name,
      CASE WHEN c_mktsegment = 'MACHINERY' THEN 'SERVER' ELSE 'ENDPOINT' END AS class_desc,
      {q.idiv('c_custkey', 60)} * 4 + c_custkey % 4 + 65536 AS major_id, c_custkey AS grantee_principal_id,
      'CONNECT' AS permission_name, CASE WHEN c_acctbal < 0 THEN 'DENY' ELSE 'GRANT' END AS state_desc
    FROM {{customer}}"""


# -- principals and permissions -----------------------------------------------------------------

def server_principals(q):
    return f"""SELECT {srv('c_custkey')} AS server_name, c_custkey AS principal_id,
      CASE c_custkey WHEN 8 THEN 'sa' ELSE 'login_' || {text('c_custkey')} END AS name,
      {q.binary(sid_hex('c_custkey'))} AS sid,
      CASE c_mktsegment WHEN 'BUILDING' THEN 'U' WHEN 'HOUSEHOLD' THEN 'G' WHEN 'FURNITURE' THEN 'R' ELSE 'S' END AS type,
      CASE c_mktsegment WHEN 'BUILDING' THEN 'WINDOWS_LOGIN' WHEN 'HOUSEHOLD' THEN 'WINDOWS_GROUP'
        WHEN 'FURNITURE' THEN 'SERVER_ROLE' ELSE 'SQL_LOGIN' END AS type_desc,
      c_custkey % 13 = 0 AS is_disabled, {db_name('c_custkey')} AS default_database_name
    FROM {{customer}}"""


def logins(q):
    return f"""SELECT {srv('c_custkey')} AS server_name,
      CASE c_custkey WHEN 8 THEN 'sa' ELSE 'login_' || {text('c_custkey')} END AS name,
      {q.binary(sid_hex('c_custkey'))} AS sid, c_custkey % 7 <> 0 AS has_access, c_custkey % 19 = 0 AS deny_login
    FROM {{customer}} WHERE c_mktsegment <> 'AUTOMOBILE'"""


def sql_logins(q):
    return f"""SELECT {srv('c_custkey')} AS server_name,
      CASE c_custkey WHEN 8 THEN 'sa' ELSE 'login_' || {text('c_custkey')} END AS name,
      CASE WHEN c_acctbal < 0 THEN NULL ELSE c_custkey % 2 = 0 END AS is_policy_checked,
      c_custkey % 3 = 0 AS is_expiration_checked
    FROM {{customer}} WHERE c_mktsegment = 'MACHINERY'"""


def listed_bad_logins(q):
    return f"""SELECT {srv('c_custkey')} AS server_name, 'login_' || {text('c_custkey')} AS login_name
    FROM {{customer}} WHERE c_acctbal < 0"""


def invalid_logins(q):
    return f"""SELECT {srv('c_custkey')} AS server_name, 'login_' || {text('c_custkey')} AS login_name
    FROM {{customer}} WHERE c_acctbal < 500 AND c_mktsegment = 'HOUSEHOLD'"""


def _user_server(q):
    return srv('(' + DID + ')')


def database_principals(q):
    did = f"({DID})"
    return f"""SELECT {srv(did)} AS server_name, {db_name(did)} AS database_name, o_orderkey + 5 AS principal_id,
      CASE WHEN o_orderkey % 97 = 0 THEN 'dbo' ELSE 'user_' || {text('o_orderkey')} END AS name,
      {q.binary(sid_hex('o_custkey'))} AS sid, o_orderstatus <> 'P' AS is_login,
      o_orderpriority <> '5-LOW' AS has_db_access FROM {{orders}}"""


def schemas(q):
    did = f"({DID})"
    return f"""SELECT {srv(did)} AS server_name, {db_name(did)} AS database_name, o_orderkey AS schema_id,
      CASE WHEN o_orderkey % 50 = 0 THEN 'OLD' ELSE 'sch_' || {text('o_orderkey')} END AS name,
      o_orderkey + 5 AS principal_id FROM {{orders}} WHERE o_orderstatus <> 'O'"""


def objects(q):
    did = f"({DID})"
    return f"""SELECT {srv(did)} AS server_name, {db_name(did)} AS database_name,
      l_orderkey * 8 + {big('l_linenumber')} AS object_id, l_orderkey AS schema_id,
      'obj_' || {text('l_partkey')} AS name,
      CASE l_linenumber WHEN 1 THEN 'U' WHEN 2 THEN 'P' WHEN 3 THEN 'V' ELSE 'TR' END AS type
    FROM {{lineitem}} l JOIN {{orders}} o ON o.o_orderkey = l.l_orderkey"""


def role_members(q):
    did = f"({DID})"
    return f"""SELECT {srv(did)} AS server_name, {db_name(did)} AS database_name,
      {pick('o_orderkey', ['db_owner', 'db_datareader', 'db_datawriter'])} AS role_name,
      CASE WHEN o_orderkey % 97 = 0 THEN 'dbo' ELSE 'user_' || {text('o_orderkey')} END AS member_name
    FROM {{orders}}"""


def database_permissions(q):
    did = f"({DID})"
    return f"""SELECT {srv(did)} AS server_name, {db_name(did)} AS database_name,
      CASE WHEN l_linenumber = 7 THEN 0 ELSE 1 END AS class,
      CASE WHEN l_linenumber = 7 THEN 0 ELSE l_orderkey * 8 + {big('l_linenumber')} END AS major_id,
      'user_' || {text('l_orderkey')} AS grantee_name,
      CASE l_linestatus WHEN 'O' THEN 'GRANT' ELSE CASE WHEN l_quantity > 25 THEN 'GRANT_WITH_GRANT_OPTION'
        ELSE 'DENY' END END AS state_desc,
      CASE l_linenumber WHEN 1 THEN 'SELECT' WHEN 2 THEN 'EXECUTE' ELSE 'UPDATE' END AS permission_name
    FROM {{lineitem}} l JOIN {{orders}} o ON o.o_orderkey = l.l_orderkey"""


def packages(q):
    return f"""SELECT {srv('c_custkey')} AS server_name, 'pkg_' || {text('c_custkey')} AS name,
      {q.binary(sid_hex('c_custkey'))} AS owner_sid,
      lpad(hex(c_custkey), 8, '0') || '-0000-4000-8000-000000000000' AS package_id FROM {{customer}}"""


# -- inventory ----------------------------------------------------------------------------------

def encryption_keys(q):
    return f"""SELECT {srv('c_custkey')} AS server_name, c_custkey AS database_id, {db_name('c_custkey')} AS database_name,
      c_custkey % 8 AS encryption_state, CAST(c_custkey % 101 AS DOUBLE) AS percent_complete,
      'TP' || {text(q.idiv('c_custkey', 60) + ' * 4 + c_custkey % 4')} AS encryptor_thumbprint,
      CASE WHEN c_acctbal < 0 THEN 'CERTIFICATE' ELSE 'ASYMMETRIC KEY' END AS encryptor_type,
      'AES' AS key_algorithm, 128 + 64 * (c_custkey % 3) AS key_length
    FROM {{customer}}"""


def certificates(q):
    return f"""SELECT {srv('s_suppkey')} AS server_name, 'cert_' || {text('s_suppkey')} AS name,
      'TP' || {text('s_suppkey')} AS thumbprint FROM {{supplier}} WHERE s_acctbal > 4000"""


def asymmetric_keys(q):
    return f"""SELECT {srv('s_suppkey')} AS server_name, 'akey_' || {text('s_suppkey')} AS name,
      'TP' || {text('s_suppkey')} AS thumbprint, {q.binary(sid_hex('s_suppkey'))} AS sid,
      CASE WHEN s_acctbal > 2000 THEN 'CRYPTOGRAPHIC PROVIDER' ELSE 'LOCAL' END AS provider_type FROM {{supplier}}"""


def principal_credentials(q):
    return f"""SELECT {srv('s_suppkey')} AS server_name, s_suppkey AS principal_id,
      s_suppkey + 1000 AS credential_id FROM {{supplier}}"""


def credentials(q):
    return f"""SELECT {srv('s_suppkey')} AS server_name, s_suppkey + 1000 AS credential_id,
      'cred_' || {text('s_suppkey')} AS name, 'vault_' || {text('s_suppkey')} AS credential_identity,
      CASE WHEN s_acctbal > 1000 THEN 'CRYPTOGRAPHIC PROVIDER' ELSE 'OTHER' END AS target_type
    FROM {{supplier}}"""


def sku_features(q):
    return f"""SELECT {srv(q.idiv('p_partkey', 20))} AS server_name, {db_name(q.idiv('p_partkey', 20))} AS database_name,
      CASE p_type WHEN 'PROMO' THEN 'Compression' WHEN 'ECONOMY' THEN 'Partitioning' ELSE 'TransparentDataEncryption' END
        AS feature_name, CASE p_type WHEN 'PROMO' THEN 100 WHEN 'ECONOMY' THEN 200 ELSE 300 END AS feature_id
    FROM {{part}}"""


def settings(q):
    return f"""SELECT 'srv_' || {text(q.idiv('p_partkey', 20))} AS server_name,
      CASE p_type WHEN 'PROMO' THEN 'EKM provider enabled' WHEN 'ECONOMY' THEN 'filestream access level'
        ELSE 'max server memory (MB)' END AS name, {big('p_size')} AS value, {big('p_size')} AS value_in_use
    FROM {{part}}"""


def dbinfo(q):
    return f"""SELECT {srv('o_custkey')} AS server_name, {db_name('o_custkey')} AS database_name,
      'DBINFO' AS parent_object, 'page' AS object,
      CASE WHEN o_orderstatus = 'F' THEN 'dbi_dbccLastKnownGood' ELSE 'dbi_modDate' END AS field,
      {q.millis_text('o_orderdate')} AS value FROM {{orders}}"""


def fulltext_catalogs(q):
    return f"""SELECT {srv('s_suppkey')} AS server_name, s_suppkey AS catalog_id, 'cat_' || {text('s_suppkey')} AS name,
      s_suppkey * 10 AS item_count, s_suppkey % 2 AS merge_status, s_suppkey * 60 AS populate_completion_age,
      s_suppkey % 9 AS populate_status, s_suppkey % 2 AS import_status FROM {{supplier}}"""


def fulltext_indexes(q):
    c = q.idiv('p_partkey', 20)
    return f"""SELECT {srv(c)} AS server_name, c_.catalog_id AS catalog_id, p_partkey AS object_id, 1 AS unique_index_id,
      p_size > 10 AS is_enabled, {q.add_seconds(q.stamp('2024-01-01 00:00:00'), '-3600 * (p_partkey % 700)')} AS crawl_start_date,
      {q.add_seconds(q.stamp('2024-01-01 00:30:00'), '-3600 * (p_partkey % 700)')} AS crawl_end_date
    FROM {{part}} p JOIN {{fulltext_catalogs}} c_ ON c_.catalog_id = {c}"""


def tables(q):
    return f"""SELECT {srv(q.idiv('p_partkey', 20))} AS server_name, p_partkey AS object_id, 'dbo' AS schema_name,
      't_' || {text('p_partkey')} AS name, 'pk_' || {text('p_partkey')} AS index_name, 1 AS index_id FROM {{part}}"""


def fulltext_fragments(q):
    return f"""SELECT {srv(q.idiv('l_partkey', 20))} AS server_name, l_partkey AS table_id,
      {whole('l_extendedprice')} * 100 AS data_size FROM {{lineitem}}"""


def publications(q):
    return f"""SELECT {srv('c_custkey')} AS server_name, {db_name('c_custkey')} AS publisher_db,
      'pub_' || {text('c_custkey')} AS publication, c_mktsegment = 'BUILDING' AS immediate_sync FROM {{customer}}"""


def services(q):
    return f"""SELECT 'srv_' || {text(q.idiv('c_custkey', 15))} AS server_name, 'svc_' || {text('c_custkey')} AS name,
      'Service ' || c_mktsegment AS display_name, CASE WHEN c_acctbal < 0 THEN 'Stopped' ELSE 'Running' END AS state,
      'C:' || {BS} || 'bin' || {BS} || 'svc_' || {text('c_custkey')} || '.exe' AS path_name FROM {{customer}}"""


DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                 "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

TABLES = {name: fn for name, fn in list(globals().items())
          if callable(fn) and getattr(fn, "__code__", None) is not None
          and fn.__code__.co_varnames[:1] == ("q",) and not name.startswith("_")}
