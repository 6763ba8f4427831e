"""Registered storage reports."""

from opslens.bindings.tables import BS
from opslens.plans import storage
from opslens.registry.common import AS_OF, Query

NOW = f"TIMESTAMP '{AS_OF}'"
SYSTEM = "('master', 'model', 'msdb', 'tempdb')"


def hundredths(pages: str) -> str:
    """Pages to hundredths of a MB, rounded half up."""
    return f"(({pages}) * 200 + 128) // 256"


def percent(free: str, size: str) -> str:
    """Share in percent with two decimals, from hundredths."""
    return f"((({free}) * 20000 + ({size})) // (2 * ({size}))) / 100.0"


VOLUME = f"""v AS (SELECT server_name AS vs, volume_id AS vid, logical_volume_name, mount_point AS drive,
      total_bytes // 1048576 // 1024 AS drive_size_gb, available_bytes // 1048576 // 1024 AS drive_free_gb,
      CAST(CAST((CAST(available_bytes AS DOUBLE) / CAST(total_bytes AS DOUBLE)) * 100 AS DECIMAL(10, 2)) AS DOUBLE) AS disk_free_percent,
      CAST(CAST((total_bytes // 1048576 // 1024 * 0.15::DOUBLE - available_bytes // 1048576 // 1024) / (1 - 0.15::DOUBLE) AS DECIMAL(10, 2)) AS DOUBLE)
        AS target_add_gb
    FROM {{volumes}})"""


def shrink(database: str, file: str, free: str, pct: int = 50) -> str:
    return (f"'USE [' || {database} || ']' || chr(13) || chr(10) || 'DBCC SHRINKFILE (N''' || {file} || ''' , ' || "
            f"(({free}) * {pct} // 10000) || ');' || chr(13) || chr(10) || chr(13) || chr(10)")


def growth_text(alias: str = "mf") -> str:
    return (f"CASE WHEN {alias}.is_percent_growth THEN {alias}.growth || '%' ELSE ({alias}.growth // 128) || ' MB' END")


def next_growth(alias: str = "mf") -> str:
    a = alias
    return (f"(CASE WHEN {a}.is_percent_growth THEN ({a}.size * {a}.growth * 200 + 12800) // 25600 "
            f"ELSE ({a}.growth * 200 + 128) // 256 END) / 100.0")


def fix(prefix: str, size: str, tail: str) -> str:
    return (f"'{prefix}ALTER DATABASE [' || mf.database_name || '] MODIFY FILE (NAME = [' || mf.name || '], FILEGROWTH = {size}{tail}'")


EXT = "lower(regexp_extract(path, '[.]([^.]+)$', 1))"
GROWTHS = f"""g AS (SELECT server_name, database_name, file_name,
      CASE event_class WHEN 92 THEN 'ROWS' WHEN 93 THEN 'LOG' END AS kind, max(start_time) AS last_start, max(end_time) AS last_end
    FROM {{trace}} WHERE event_class IN (92, 93) AND start_time > {NOW} - INTERVAL 20 DAY GROUP BY 1, 2, 3, 4)"""

QUERIES = {
    "disk_space": Query(
        lambda t: storage.disk_space(t.master_files, t.volumes),
        f"""WITH {VOLUME} SELECT DISTINCT server_name, database_name, physical_name, size * 8 / 1048576.0::DOUBLE AS size_gb, type_desc,
          logical_volume_name, drive, drive_size_gb, drive_free_gb, disk_free_percent, target_add_gb,
          round(drive_free_gb + target_add_gb, 6) AS total_target_gb
        FROM {{master_files}} mf JOIN v ON vs = server_name AND vid = volume_id WHERE database_name NOT IN {SYSTEM}"""),
    "log_space": Query(
        lambda t: storage.log_space(t.master_files, t.databases),
        f"""WITH l AS (SELECT server_name, database_name, {hundredths('sum(size)')} AS s, {hundredths('sum(used_pages)')} AS u,
          {hundredths('sum(size) - sum(used_pages)')} AS f FROM {{master_files}} WHERE type = 1 GROUP BY 1, 2)
        SELECT l.server_name, l.database_name, mf.name AS file_name, s / 100.0 AS log_file_size_mb, u / 100.0 AS log_space_used_mb,
          f / 100.0 AS log_free_space_mb, {percent('f', 's')} AS free_percent, log_reuse_wait_desc,
          CASE WHEN log_reuse_wait_desc = 'NOTHING' THEN {shrink('d.name', 'mf.name', 'f')} END AS shrink_text
        FROM l LEFT JOIN {{databases}} d ON l.database_name = d.name AND l.server_name = d.server_name
        LEFT JOIN {{master_files}} mf ON mf.database_id = d.database_id AND mf.server_name = d.server_name AND mf.type = 1
        WHERE d.database_id > 4"""),
    "growth_events": Query(
        lambda t: storage.growth_events(t.trace, AS_OF, 20), f"WITH {GROWTHS} SELECT * FROM g"),
    "file_report": Query(
        lambda t: storage.file_report(t.master_files, t.volumes, t.databases, storage.growth_events(t.trace, AS_OF, 20)),
        f"""WITH {VOLUME}, {GROWTHS},
        mf AS (SELECT *, {hundredths('size')} AS s, {hundredths('used_pages')} AS u, {hundredths('size - used_pages')} AS f FROM {{master_files}})
        SELECT mf.server_name, mf.database_name, mf.name AS file_name, physical_name, CAST(size * 8 // 1024 AS DOUBLE) AS size_mb, type_desc,
          logical_volume_name, drive, drive_size_gb, drive_free_gb, disk_free_percent, target_add_gb,
          round(drive_free_gb + target_add_gb, 6) AS drive_target_gb,
          CASE WHEN type = 0 THEN s / 100.0 END AS rows_file_size_mb, CASE WHEN type = 0 THEN u / 100.0 END AS rows_space_used_mb,
          CASE WHEN type = 0 THEN f / 100.0 END AS rows_free_space_mb, CASE WHEN type = 0 THEN {percent('f', 's')} END AS rows_free_percent,
          g1.last_start AS rows_growth_start, g1.last_end AS rows_growth_end,
          CASE WHEN type = 1 THEN s / 100.0 END AS log_file_size_mb, CASE WHEN type = 1 THEN u / 100.0 END AS log_space_used_mb,
          CASE WHEN type = 1 THEN f / 100.0 END AS log_free_space_mb, CASE WHEN type = 1 THEN {percent('f', 's')} END AS log_free_percent,
          g2.last_start AS log_growth_start, g2.last_end AS log_growth_end, log_reuse_wait_desc,
          CASE WHEN mf.is_percent_growth THEN 'Yes' ELSE 'No' END AS is_percent_growth, {growth_text()} AS growth_in_increment_of,
          {next_growth()} AS next_auto_growth_size_mb,
          CASE WHEN max_size = -1 THEN 'UNLIMITED' ELSE (max_size * 8 // 1024) || ' MB' END AS max_size,
          CASE WHEN lower(log_reuse_wait_desc) = 'nothing' AND type = 1 THEN {shrink('mf.database_name', 'mf.name', 'f')} END AS shrink_text,
          CASE WHEN lower(physical_name) LIKE '%.ldf' THEN {fix('USE [master]; ', '256MB', ', MAXSIZE = UNLIMITED);')}
            ELSE {fix('USE [master]; ', '512MB', ', MAXSIZE = UNLIMITED);')} END AS change_autogrow
        FROM mf JOIN v ON vs = mf.server_name AND vid = mf.volume_id
        JOIN {{databases}} d ON d.database_id = mf.database_id AND d.server_name = mf.server_name
        LEFT JOIN g g1 ON g1.server_name = mf.server_name AND g1.database_name = mf.database_name AND g1.file_name = mf.name AND g1.kind = 'ROWS'
        LEFT JOIN g g2 ON g2.server_name = mf.server_name AND g2.database_name = mf.database_name AND g2.file_name = mf.name AND g2.kind = 'LOG'
        WHERE mf.database_name NOT IN {SYSTEM}"""),
    "growth_policy": Query(
        lambda t: storage.growth_policy(t.master_files),
        f"""SELECT server_name, CASE WHEN lower(physical_name) LIKE '%.ldf' AND database_name <> 'tempdb' THEN {fix('', '256MB', ');')}
            WHEN lower(physical_name) LIKE '%.mdf' AND database_name <> 'tempdb' THEN {fix('', '512GB', ');')}
            WHEN lower(physical_name) LIKE '%.ldf' THEN {fix('', '512MB', ');')}
            WHEN lower(physical_name) LIKE '%.mdf' THEN {fix('', '1024GB', ');')} ELSE 'Error - Invalid Option' END AS change_autogrow,
          database_name, name AS logical_name, ({hundredths('size')}) / 100.0 AS file_size_mb,
          CASE WHEN is_percent_growth THEN 'Yes' ELSE 'No' END AS is_percent_growth, {growth_text()} AS growth_in_increment_of,
          {next_growth()} AS next_auto_growth_size_mb,
          CASE max_size WHEN 0 THEN 'No growth is allowed' WHEN -1 THEN 'File will grow until the disk is full' ELSE CAST(max_size AS VARCHAR) END AS max_size,
          physical_name
        FROM {{master_files}} mf WHERE {growth_text()} IN ('10%', '1 MB') OR (NOT is_percent_growth AND growth // 128 > 64)"""),
    "growth_settings": Query(
        lambda t: storage.growth_settings(t.master_files),
        """SELECT server_name, database_name, name AS file_name, file_id, (size * 8) || ' KB' AS size,
          CASE max_size WHEN -1 THEN 'Unlimited' ELSE (max_size * 8) || ' KB' END AS max_size,
          CASE WHEN is_percent_growth THEN growth || '%' ELSE (growth * 8) || ' KB' END AS growth, type_desc FROM {master_files}"""),
    "size_share": Query(
        lambda t: storage.size_share(t.master_files),
        """WITH d AS (SELECT m.server_name, m.database_name, CAST(sum(size) AS BIGINT) AS p,
            (SELECT CAST(sum(size) AS BIGINT) FROM {master_files} x WHERE x.server_name = m.server_name) AS t
          FROM {master_files} m GROUP BY 1, 2)
        SELECT server_name, database_name, ((p * 8 * 200 + 1048576) // 2097152) / 100.0 AS total_size_gb,
          ((p * 100 * 20000 + t) // (2 * t)) / 10000.0 AS percent_size,
          repeat('|', CAST((p * 200 + t) // (2 * t) AS INTEGER)) AS graph FROM d"""),
    "orphaned_files": Query(
        lambda t: storage.orphaned_files(t.file_inventory, t.master_files, AS_OF),
        f"""SELECT os.server_name, 'Del ' || path AS delete_text, path, modified, length // 1048576 AS size_mb,
          date_diff('day', modified, {NOW}) AS days_old
        FROM {{master_files}} mf RIGHT JOIN (SELECT * FROM {{file_inventory}} WHERE {EXT} IN ('mdf', 'ndf', 'ldf')
          AND path NOT LIKE 'C%' AND path NOT LIKE '%:' || {BS} || '$RECYCLE_BIN' || {BS} || '%') os
          ON lower(mf.physical_name) = lower(os.path) AND mf.server_name = os.server_name
        WHERE mf.physical_name IS NULL"""),
    "log_reuse_waits": Query(
        lambda t: storage.log_reuse_waits(t.databases),
        "SELECT server_name, name, log_reuse_wait_desc FROM {databases} WHERE log_reuse_wait_desc <> 'NOTHING'"),
    "shrink_candidates": Query(
        lambda t: storage.shrink_candidates(t.databases, t.master_files),
        """SELECT d.server_name, d.name AS database_name, 'USE [' || d.name || ']' || chr(13) || chr(10) || 'DBCC SHRINKFILE (N''' || mf.name
          || ''' , 0, TRUNCATEONLY)' || chr(13) || chr(10) || chr(13) || chr(10) AS shrink_text
        FROM {master_files} mf JOIN {databases} d ON mf.database_id = d.database_id AND mf.server_name = d.server_name
        WHERE d.database_id > 4 AND mf.type_desc = 'LOG' AND log_reuse_wait_desc = 'NOTHING'"""),
    "growth_ladder": Query(
        lambda t: storage.growth_ladder(t.master_files),
        """SELECT server_name, database_name, name AS file_name, step, 'ALTER DATABASE [' || database_name || '] MODIFY FILE ( NAME = N''' || name
          || ''', SIZE = ' || (size * 8 + step * 2 * 1024 * 1024) || 'KB )' AS grow_text
        FROM {master_files}, range(1, 16) r(step) WHERE type_desc = 'ROWS'"""),
    "old_files": Query(
        lambda t: storage.old_files(t.file_inventory, AS_OF),
        f"""SELECT server_name, path, modified, round(length / 1073741824, 2) AS size_gb FROM {{file_inventory}}
        WHERE modified < {NOW} - INTERVAL 180 DAY"""),
    "old_backup_files": Query(
        lambda t: storage.old_files(t.file_inventory, AS_OF, 20, "bak"),
        f"""SELECT server_name, path, modified, round(length / 1073741824, 2) AS size_gb FROM {{file_inventory}}
        WHERE modified < {NOW} - INTERVAL 20 DAY AND {EXT} = 'bak'"""),
    "largest_files": Query(
        lambda t: storage.largest_files(t.file_inventory, AS_OF),
        f"""SELECT server_name, path, modified, round(length / 1073741824, 6) AS size_gb,
          regexp_extract(path, '^(.*)[^.a-zA-Z0-9_]', 1) AS directory
        FROM {{file_inventory}} WHERE length > 1048576 AND modified < {NOW} - INTERVAL 7 DAY AND {EXT} = 'bak'
        ORDER BY length DESC, server_name, path LIMIT 500"""),
    "retention_candidates": Query(
        lambda t: storage.retention_candidates(t.file_inventory, AS_OF),
        f"""SELECT server_name, path, modified, length, strftime({NOW} - INTERVAL 4 DAY, '%Y-%m-%dT%H:%M:%S') AS cutoff
        FROM {{file_inventory}} WHERE {EXT} = 'trn' AND modified < {NOW} - INTERVAL 4 DAY"""),
    "empty_directories": Query(
        lambda t: storage.empty_directories(t.directories, t.file_inventory),
        f"""SELECT server_name, directory FROM {{directories}} d WHERE NOT EXISTS (SELECT 1 FROM {{file_inventory}} f
          WHERE f.server_name = d.server_name AND starts_with(f.path, d.directory || {BS}))"""),
    "volume_sizes": Query(
        lambda t: storage.volume_sizes(t.volumes),
        """SELECT server_name, mount_point, round(total_bytes / 1073741824, 2) AS size_gb,
          round(available_bytes / 1073741824, 2) AS free_gb FROM {volumes}"""),
    "file_locations": Query(
        lambda t: storage.file_locations(t.file_inventory, ["exe"]),
        "SELECT server_name, path FROM {file_inventory} WHERE path LIKE '%.exe'"),
    "database_file_locations": Query(
        lambda t: storage.database_file_locations(t.master_files),
        "SELECT server_name, name, physical_name AS current_file_location FROM {master_files} WHERE database_id <> 2"),
    "volumes_from_xml": Query(
        lambda t: storage.volumes_from_xml(t.volume_xml_lines),
        f"""SELECT 'srv_' || (s_suppkey // 10) AS server_name, s_suppkey % 10 AS object_no,
          'V' || s_suppkey || ':' || {BS} || ' - ' || s_name AS volume,
          CASE WHEN s_acctbal < 0 THEN NULL ELSE CAST(s_suppkey * 1000 + 0.125 AS DOUBLE) END AS free_space_mb,
          CAST(s_suppkey * 2000 AS DOUBLE) AS capacity_mb FROM {{supplier}}"""),
}
