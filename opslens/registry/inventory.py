"""Registered inventory reports."""

from opslens.bindings.tables import BS
from opslens.functions import codes
from opslens.plans import inventory
from opslens.registry.common import AS_OF, Query

NOW = f"TIMESTAMP '{AS_OF}'"


def on_off(name: str, c: str) -> str:
    return f"'{name} = ' || CASE WHEN {c} THEN 'ON' ELSE 'OFF' END || ', '"


def sql_case(c: str, table: dict, default: str) -> str:
    def lit(v):
        return str(v) if isinstance(v, int) else f"'{v}'"
    return f"CASE {c} " + " ".join(f"WHEN {lit(k)} THEN '{v}'" for k, v in table.items()) + f" ELSE '{default}' END"


BS_RE = "\\\\"  # a backslash inside a pattern
REGISTRY = f"""WITH l AS (SELECT file, line_no, trim(line) AS line, regexp_extract(trim(line), '^\\[([a-zA-Z0-9_]+[^{BS_RE}])\\]$', 1) AS folder,
    regexp_extract(trim(line), '^\\[([a-zA-Z0-9_]+{BS_RE}.+)\\]$', 1) AS sub FROM {{ini_lines}})
SELECT file, line_no, CASE WHEN folder <> '' THEN '.' WHEN sub <> '' THEN split_part(sub, {BS}, 1)
    ELSE coalesce((SELECT max_by(p.folder || p.sub, p.line_no) FROM l p WHERE p.file = l.file AND p.line_no < l.line_no AND p.folder || p.sub <> ''), '.')
    END AS parent_folder,
  CASE WHEN folder || sub <> '' THEN 'Directory' ELSE 'Registration' END AS type,
  CASE WHEN folder <> '' THEN folder WHEN sub <> '' THEN split_part(sub, {BS}, 2) ELSE line END AS value
FROM l WHERE folder || sub <> '' OR (line <> '' AND left(line, 1) NOT IN (';', '#', '['))"""

QUERIES = {
    "encryption_state": Query(
        lambda t: inventory.encryption_state(t.encryption_keys, t.databases),
        """SELECT d.server_name, d.name, k.encryption_state FROM {encryption_keys} k JOIN {databases} d
          ON k.database_id = d.database_id AND k.server_name = d.server_name"""),
    "encryption_chain": Query(
        lambda t: inventory.encryption_chain(t.principal_credentials, t.credentials, t.server_principals, t.asymmetric_keys,
                                             t.encryption_keys, t.databases),
        """WITH holders AS (  -- logins with what they may open: their credentials and their keys
          SELECT server_name, sid, principal_id, name AS tde_login, '0x' || sid AS tde_login_sid, type_desc AS tde_login_type FROM {server_principals}),
        opened AS (
          SELECT server_name, thumbprint AS encryptor_thumbprint, name AS asymmetric_key_name, holders.* EXCLUDE (server_name, sid)
          FROM {asymmetric_keys} INNER JOIN holders USING (server_name, sid)),
        granted AS (
          SELECT server_name, principal_id, credential_id, name AS tde_credential_name, credential_identity AS tde_credential_identity,
            target_type AS tde_credential_target_type
          FROM {credentials} INNER JOIN (SELECT server_name, principal_id, credential_id FROM {principal_credentials}) USING (server_name, credential_id))
        SELECT server_name, database_name, is_encrypted, encryptor_thumbprint, principal_id, credential_id, tde_login, tde_login_sid,
          tde_login_type, tde_credential_name, tde_credential_identity, tde_credential_target_type, asymmetric_key_name
        FROM (SELECT server_name, database_id, encryptor_thumbprint FROM {encryption_keys})
        INNER JOIN (SELECT server_name, database_id, name AS database_name, is_encrypted FROM {databases}) USING (server_name, database_id)
        INNER JOIN opened USING (server_name, encryptor_thumbprint)
        INNER JOIN granted USING (server_name, principal_id)"""),
    "encryption_progress": Query(
        lambda t: inventory.encryption_progress(t.encryption_keys),
        f"""SELECT server_name, database_name, encryption_state, {sql_case('encryption_state', codes.ENCRYPTION_STATES, 'No Status')}
          AS encryption_state_desc, percent_complete, encryptor_thumbprint, encryptor_type FROM {{encryption_keys}}"""),
    "database_certificates": Query(
        lambda t: inventory.database_certificates(t.encryption_keys, t.databases, t.certificates),
        """SELECT d.server_name, d.name AS database_name, c.name AS certificate_name, encryptor_type,
          CASE WHEN encryption_state = 3 THEN 'Encrypted' WHEN encryption_state = 2 THEN 'In Progress' ELSE 'Not Encrypted' END AS state,
          encryption_state, percent_complete, key_algorithm, key_length
        FROM {encryption_keys} e RIGHT JOIN {databases} d ON d.database_id = e.database_id AND d.server_name = e.server_name
        LEFT JOIN {certificates} c ON e.encryptor_thumbprint = c.thumbprint AND c.server_name = e.server_name"""),
    "sku_features": Query(lambda t: inventory.sku_features(t.sku_features),
                          "SELECT server_name, database_name, feature_name, feature_id FROM {sku_features}"),
    "settings_like": Query(lambda t: inventory.settings_like(t.settings, "%EKM%"),
                           "SELECT * FROM {settings} WHERE name LIKE '%EKM%'"),
    "credentials_of_type": Query(lambda t: inventory.credentials_of_type(t.credentials),
                                 "SELECT * FROM {credentials} WHERE target_type = 'CRYPTOGRAPHIC PROVIDER'"),
    "provider_keys": Query(
        lambda t: inventory.provider_keys(t.asymmetric_keys).select("server_name", "name", "thumbprint", "provider_type"),
        "SELECT server_name, name, thumbprint, provider_type FROM {asymmetric_keys} WHERE provider_type = 'CRYPTOGRAPHIC PROVIDER'"),
    "listening_ports": Query(lambda t: inventory.listening_ports(t.connections),
                             "SELECT DISTINCT server_name, local_tcp_port FROM {connections} WHERE local_tcp_port IS NOT NULL"),
    "stale_checks": Query(
        lambda t: inventory.stale_checks(t.dbinfo, t.databases, AS_OF),
        f"""SELECT DISTINCT i.* FROM {{dbinfo}} i JOIN {{databases}} d ON d.name = i.database_name AND d.server_name = i.server_name
        WHERE field = 'dbi_dbccLastKnownGood' AND database_id > 4 AND state_desc = 'ONLINE' AND NOT is_read_only
          AND create_date < {NOW} - INTERVAL 7 DAY AND date_diff('day', CAST(value AS TIMESTAMP), {NOW}) > 7"""),
    "fulltext_state": Query(
        lambda t: inventory.fulltext_state(t.fulltext_catalogs),
        """SELECT server_name, name, item_count, merge_status, populate_completion_age, populate_status, import_status FROM {fulltext_catalogs}"""),
    "stale_crawls": Query(
        lambda t: inventory.stale_crawls(t.fulltext_indexes, t.tables, t.fulltext_catalogs, AS_OF),
        f"""SELECT fi.server_name, c.name AS catalog_name, t.name AS table_name, t.index_name, crawl_start_date, crawl_end_date
        FROM {{fulltext_indexes}} fi JOIN {{tables}} t ON t.object_id = fi.object_id AND t.server_name = fi.server_name
        JOIN {{fulltext_catalogs}} c ON fi.catalog_id = c.catalog_id WHERE fi.is_enabled AND crawl_end_date < {NOW} - INTERVAL 14 DAY"""),
    "fragmentation": Query(
        lambda t: inventory.fragmentation(t.fulltext_fragments, t.fulltext_indexes, t.tables, t.fulltext_catalogs),
        """WITH f AS (SELECT table_id, count(*) AS n, CAST((sum(data_size) * 200 + 1048576) // 2097152 AS BIGINT) AS s,
            CAST((max(data_size) * 200 + 1048576) // 2097152 AS BIGINT) AS l FROM {fulltext_fragments} GROUP BY 1)
        SELECT i.server_name, c.catalog_id, c.name AS catalog_name, i.object_id, '[dbo].[' || t.name || ']' AS base_object_name, s / 100.0 AS index_size_mb,
          n AS fragments_count, l / 100.0 AS largest_fragment_mb, (s - l) / 100.0 AS fragmentation_space_mb,
          CASE WHEN s = 0 THEN 0 ELSE round(100.0::DOUBLE * (s - l) / s, 6) END AS fragmentation_percent
        FROM {fulltext_catalogs} c JOIN {fulltext_indexes} i ON i.catalog_id = c.catalog_id JOIN f ON f.table_id = i.object_id
        JOIN {tables} t ON t.object_id = i.object_id"""),
    "index_ddl": Query(
        lambda t: inventory.index_ddl(t.indexes, t.index_columns),
        f"""WITH k AS (SELECT server_name, table_name, index_name, string_agg(CASE WHEN NOT is_included THEN column_name ||
            CASE WHEN is_descending THEN ' DESC' ELSE ' ASC' END END, ', ' ORDER BY ordinal) AS keys,
            string_agg(CASE WHEN is_included THEN column_name END, ', ' ORDER BY ordinal) AS incl FROM {{index_columns}} GROUP BY 1, 2, 3)
        SELECT ix.server_name, schema_name, ix.table_name, ix.index_name,
          'CREATE ' || CASE WHEN is_unique THEN 'UNIQUE ' ELSE '' END || type_desc || ' INDEX [' || ix.index_name || '] ON [dbo].[' || ix.table_name
          || '](' || keys || ') ' || CASE WHEN incl IS NOT NULL THEN chr(13) || 'INCLUDE (' || incl || ')' ELSE '' END || chr(13) || 'WITH ('
          || {on_off('PAD_INDEX', 'is_padded')} || {on_off('ALLOW_PAGE_LOCKS', 'allow_page_locks')} || {on_off('ALLOW_ROW_LOCKS', 'allow_row_locks')}
          || {on_off('STATISTICS_NORECOMPUTE', 'no_recompute')} || {on_off('IGNORE_DUP_KEY', 'ignore_dup_key')}
          || 'SORT_IN_TEMPDB = OFF, FILLFACTOR =' || fill_factor || ') ON [PRI]]MARY];' AS create_text,
          CASE WHEN is_disabled THEN chr(13) || 'ALTER INDEX [' || ix.index_name || '] ON [dbo].[' || ix.table_name || '] DISABLE;' || chr(13)
            ELSE '' END AS disable_text
        FROM {{indexes}} ix JOIN k ON k.server_name = ix.server_name AND k.table_name = ix.table_name AND k.index_name = ix.index_name
        WHERE type > 0 AND NOT is_primary_key AND NOT is_unique_constraint"""),
    "routine_search": Query(
        lambda t: inventory.routine_search(t.documents.select("doc_id", "text"), "the ", "text"),
        "SELECT doc_id, text FROM documents WHERE text LIKE '%the %'"),
    "immediate_sync": Query(
        lambda t: inventory.immediate_sync(t.publications),
        """SELECT server_name, publisher_db, publication, immediate_sync, 'USE ' || publisher_db || '; EXEC sp_changepublication @publication='''
          || publication || ''',@property = N''allow_anonymous'',@value=''FALSE'' ; USE ' || publisher_db
          || '; EXEC sp_changepublication @publication=''' || publication || ''',@property = N''immediate_sync'',@value=''FALSE'' ;' AS fix_text
        FROM {publications} WHERE immediate_sync"""),
    "schema_transfer": Query(
        lambda t: inventory.schema_transfer(t.objects, t.schemas),
        """SELECT o.server_name, o.database_name, o.object_id, 'ALTER SCHEMA dbo TRANSFER ' || s.name || '.' || o.name AS transfer_text
        FROM {objects} o JOIN {schemas} s ON o.schema_id = s.schema_id AND s.server_name = o.server_name AND s.database_name = o.database_name
        WHERE s.name = 'OLD' AND o.type IN ('U', 'P', 'V')"""),
    "server_registry": Query(lambda t: inventory.server_registry(t.ini_lines), REGISTRY),
    "server_versions": Query(
        lambda t: inventory.server_versions(t.hosts),
        """SELECT server_name, machine_name, product_version, substr(version_banner, 1, strpos(version_banner, product_version)
          + length(product_version)) AS version FROM {hosts}"""),
    "power_plan_finding": Query(
        lambda t: inventory.power_plan_finding(t.hosts),
        f"""SELECT server_name, 'Server Info' AS findings_group, 'Power Plan' AS finding,
          ((cpu_mhz + 5) // 10 // 100) || '.' || lpad(CAST((cpu_mhz + 5) // 10 % 100 AS VARCHAR), 2, '0') || 'GHz CPUs' AS cpu_speed,
          {sql_case('power_scheme', codes.POWER_PLANS, 'an unknown power mode')} AS power_plan FROM {{hosts}}"""),
}
