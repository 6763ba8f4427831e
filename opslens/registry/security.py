"""Registered security reports."""

from opslens.plans import security
from opslens.registry.common import Query

BAD = """bad AS (SELECT server_name, login_name FROM {listed_bad_logins} UNION SELECT server_name, login_name FROM {invalid_logins})"""
OWNERS = BAD + """, l AS (SELECT l.*, CAST('S-1-5-21-2127521184-1604012920-1887927527-' AS VARCHAR) AS domain FROM {logins} l
    JOIN bad ON bad.login_name = l.name AND bad.server_name = l.server_name)"""
SID_NUMBER = "CAST('0x' || substr(sid, 55, 2) || substr(sid, 53, 2) || substr(sid, 51, 2) || substr(sid, 49, 2) AS BIGINT)"


def bad(t):
    return security.bad_logins(t.listed_bad_logins, t.invalid_logins)


def script(section: int, body: str, source: str, prefix: str = "EXEC( ''USE ", end: str = "''); ") -> str:
    return f"SELECT server_name, database_name, {section} AS section, '{prefix}' || database_name || '; ' || {body} || '{end}' AS extract FROM {source}"


UNLESS = "'IF NOT EXISTS (SELECT * FROM sys.database_principals WHERE name = N''''' || name || ''''') '"
SCRIPT = "\nUNION ALL ".join([
    script(1, "'IF NOT EXISTS (SELECT * FROM sys.schemas WHERE name = N''''' || name || ''''')IF  EXISTS (SELECT * FROM sys.database_principals "
              "WHERE name = N''''' || name || ''''') DROP USER [' || name || ']'",
           "{database_principals} WHERE is_login AND has_db_access AND name NOT IN ('dbo')"),
    script(2, "' EXEC dbo.sp_changedbowner @loginame =N''''' || login || ''''''",
           "(SELECT db.server_name, db.name AS database_name, sp.name AS login FROM {databases} db LEFT JOIN {server_principals} sp "
           "ON db.owner_sid = sp.sid AND sp.server_name = db.server_name) x", prefix="EXEC (''USE ", end="'');"),
    script(3, f"{UNLESS} || 'CREATE USER [' || name || '] FOR LOGIN [' || login || ']'",
           "(SELECT dp.server_name, dp.database_name, dp.name, sp.name AS login FROM {server_principals} sp JOIN {database_principals} dp "
           "ON sp.sid = dp.sid AND sp.server_name = dp.server_name AND dp.name NOT IN ('dbo')) x"),
    script(4, f"{UNLESS} || 'CREATE USER [' || name || '] WITHOUT LOGIN '",
           "{database_principals} WHERE principal_id BETWEEN 5 AND 16383", end="'');  "),
    script(5, "'EXEC sp_addrolemember ''''' || role_name || ''''', ''''' || member_name || ''''''",
           "{role_members} WHERE member_name NOT IN ('dbo')"),
    script(6, "CASE state_desc WHEN 'GRANT_WITH_GRANT_OPTION' THEN 'GRANT ' ELSE state_desc END || ' ' || permission_name "
              "|| CASE class WHEN 1 THEN ' ON [' || sname || '].[' || oname || '] ' ELSE '' END || ' TO [' || grantee_name || '] ' "
              "|| CASE state_desc WHEN 'GRANT_WITH_GRANT_OPTION' THEN ' WITH GRANT OPTION' ELSE '' END",
           "(SELECT a.*, b.name AS oname, c.name AS sname FROM {database_permissions} a JOIN {objects} b ON a.major_id = b.object_id "
           "AND a.server_name = b.server_name AND a.database_name = b.database_name JOIN {schemas} c ON b.schema_id = c.schema_id "
           "AND c.server_name = b.server_name AND c.database_name = b.database_name) x"),
])

QUERIES = {
    "bad_logins": Query(bad, f"WITH {BAD} SELECT * FROM bad"),
    "sid_text": Query(
        lambda t: security.sid_text(t.logins, bad(t)),
        f"""WITH {OWNERS} SELECT server_name, name AS login_name, '0x' || sid AS binary_sid, domain || {SID_NUMBER} AS string_sid FROM l"""),
    "bad_login_sessions": Query(
        lambda t: security.bad_login_sessions(t.sessions, bad(t)),
        f"""WITH {BAD} SELECT 'B' AS "check", server_name, session_id, login_name, host_name, program_name, status FROM {{sessions}} s
        WHERE login_name IN (SELECT login_name FROM bad WHERE bad.server_name = s.server_name)"""),
    "bad_login_ownership": Query(
        lambda t: security.bad_login_ownership(t.availability_groups, t.availability_replicas, t.databases, t.endpoints,
                                               t.server_permissions, t.server_principals, t.logins, bad(t)),
        f"""WITH {OWNERS}
        SELECT 'C' AS "check", d.server_name, 'alter authorization on database::[' || d.name || '] to [sa];' AS change_owner_text
        FROM {{databases}} d JOIN l ON l.sid = d.owner_sid AND l.server_name = d.server_name
        UNION
        SELECT 'C', ag.server_name, 'alter authorization on availability group::[' || ag.name || '] to [sa];'
        FROM {{availability_replicas}} r JOIN {{availability_groups}} ag ON ag.group_id = r.group_id
        JOIN l ON l.sid = r.owner_sid AND l.server_name = r.server_name
        UNION
        SELECT 'C', ep.server_name, 'alter authorization on endpoint::[' || ep.name || '] to [sa]; grant connect on endpoint::[' || ep.name || '] to ['
          || gr.name || '];'
        FROM {{endpoints}} ep JOIN {{server_principals}} p ON p.principal_id = ep.principal_id AND p.server_name = ep.server_name
        LEFT JOIN {{server_permissions}} pm ON ep.endpoint_id = pm.major_id AND pm.server_name = ep.server_name
        JOIN {{server_principals}} gr ON gr.principal_id = pm.grantee_principal_id AND gr.server_name = pm.server_name
        JOIN bad b ON b.login_name = p.name AND b.server_name = p.server_name"""),
    "bad_login_jobs": Query(
        lambda t: security.bad_login_jobs(t.jobs, t.logins, bad(t)),
        f"""WITH {OWNERS} SELECT 'D' AS "check", j.server_name, '0x' || j.owner_sid AS sid, l.name AS owner, j.name,
          'EXEC msdb.dbo.sp_update_job @job_id=N''' || j.job_guid || ''',@owner_login_name=N''sa''' AS change_owner_text
        FROM {{jobs}} j JOIN l ON l.sid = j.owner_sid AND l.server_name = j.server_name"""),
    "bad_login_packages": Query(
        lambda t: security.bad_login_packages(t.packages, t.logins, bad(t)),
        f"""WITH {OWNERS} SELECT 'E' AS "check", p.server_name, '0x' || p.owner_sid AS sid, l.name AS owner, p.name,
          'update msdb..sysssispackages set ownersid=0x01 where id=''' || p.package_id || '''' AS change_owner_text
        FROM {{packages}} p JOIN l ON l.sid = p.owner_sid AND l.server_name = p.server_name"""),
    "bad_login_objects": Query(
        lambda t: security.bad_login_objects(t.logins, t.database_principals, t.schemas, t.objects, bad(t)),
        f"""WITH {OWNERS} SELECT 'F' AS "check", l.server_name, l.name AS login_name, u.database_name, u.name AS user_name, s.name AS schema_name,
          o.name AS object_name, CASE WHEN s.name IS NULL THEN 'use [' || u.database_name || ']; drop user [' || u.name || '];'
            WHEN o.name IS NULL THEN CASE WHEN s.schema_id < 16384
                THEN 'use [' || u.database_name || ']; drop schema [' || s.name || ']; drop user [' || u.name || '];'
                ELSE 'use [' || u.database_name || ']; alter authorization on schema::[' || s.name || '] to [' || s.name || ']; drop user [' || u.name || '];' END
            ELSE '-- the user owns objects!!' END AS drop_user_text
        FROM l LEFT JOIN {{database_principals}} u ON u.sid = l.sid AND u.server_name = l.server_name
        LEFT JOIN {{schemas}} s ON u.principal_id = s.principal_id AND s.server_name = u.server_name AND s.database_name = u.database_name
        LEFT JOIN {{objects}} o ON o.schema_id = s.schema_id AND o.server_name = s.server_name AND o.database_name = s.database_name
        WHERE u.name IS NOT NULL"""),
    "orphaned_users": Query(
        lambda t: security.orphaned_users(t.database_principals, t.logins),
        """SELECT u.server_name, u.database_name, u.name AS user_name, '0x' || u.sid AS user_sid FROM {database_principals} u
        LEFT JOIN {logins} l ON l.sid = u.sid AND l.server_name = u.server_name WHERE u.is_login AND l.sid IS NULL"""),
    "permission_script": Query(
        lambda t: security.permission_script(t.databases, t.database_principals, t.server_principals, t.role_members,
                                             t.database_permissions, t.objects, t.schemas), SCRIPT),
    "database_owners": Query(
        lambda t: security.database_owners(t.databases, t.server_principals),
        """SELECT d.server_name, p.name AS owner, d.name, 'ALTER AUTHORIZATION ON DATABASE::[' || d.name || '] TO [sa];' AS authorization_text
        FROM {databases} d LEFT JOIN {server_principals} p ON p.sid = d.owner_sid AND p.server_name = d.server_name"""),
    "login_script": Query(
        lambda t: security.login_script(t.server_principals, t.logins, t.sql_logins),
        """SELECT p.server_name, p.name AS login_name, p.type, CASE WHEN p.type IN ('G', 'U')
            THEN 'CREATE LOGIN [' || p.name || '] FROM WINDOWS WITH DEFAULT_DATABASE = [' || default_database_name || ']'
            ELSE 'CREATE LOGIN [' || p.name || '] WITH SID = 0x' || p.sid || ', DEFAULT_DATABASE = [' || default_database_name || ']'
              || coalesce(', CHECK_POLICY = ' || CASE WHEN is_policy_checked THEN 'ON' WHEN NOT is_policy_checked THEN 'OFF' END, '')
              || coalesce(', CHECK_EXPIRATION = ' || CASE WHEN is_expiration_checked THEN 'ON' WHEN NOT is_expiration_checked THEN 'OFF' END, '') END
          || CASE WHEN deny_login THEN '; DENY CONNECT SQL TO [' || p.name || ']' WHEN NOT has_access THEN '; REVOKE CONNECT SQL TO [' || p.name || ']'
            ELSE '' END || CASE WHEN is_disabled THEN '; ALTER LOGIN [' || p.name || '] DISABLE' ELSE '' END AS login_text
        FROM {server_principals} p LEFT JOIN {logins} l ON l.name = p.name AND l.server_name = p.server_name
        LEFT JOIN {sql_logins} q ON q.name = p.name AND q.server_name = p.server_name
        WHERE p.type IN ('S', 'G', 'U') AND p.name <> 'sa'"""),
    "hash_text": Query(
        lambda t: security.hash_text(t.customer.select("c_custkey", "c_name"), "c_name"),
        "SELECT c_custkey, c_name, '0x' || upper(sha1(lower(c_name))) AS hash_text FROM customer"),
}
