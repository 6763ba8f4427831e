"""Login, ownership and permission reports. They give text; nothing is executed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from opslens.functions import binary, text
from opslens.operators import changes

DB = ["server_name", "database_name"]


# -- bad logins ---------------------------------------------------------------------------------

def bad_logins(listed: DataFrame, validated: DataFrame) -> DataFrame:
    """Logins named by hand and logins the domain no longer knows."""
    return listed.select("server_name", "login_name").unionByName(
        validated.select("server_name", "login_name")).distinct()


def _of_bad(logins: DataFrame, bad: DataFrame) -> DataFrame:
    return logins.withColumnRenamed("name", "login_name").join(bad, ["server_name", "login_name"], "left_semi")


def sid_text(logins: DataFrame, bad: DataFrame) -> DataFrame:
    """Security identifier text of the bad logins."""
    return _of_bad(logins, bad).select("server_name", "login_name", binary.hex_text(F.col("sid")).alias("binary_sid"),
                                       binary.sid_text(F.col("sid")).alias("string_sid"))


def bad_login_sessions(sessions: DataFrame, bad: DataFrame) -> DataFrame:
    return sessions.join(bad, ["server_name", "login_name"], "left_semi").select(
        F.lit("B").alias("check"), "server_name", "session_id", "login_name", "host_name", "program_name", "status")


def bad_login_ownership(groups: DataFrame | None, replicas: DataFrame | None, databases: DataFrame,
                        endpoints: DataFrame, permissions: DataFrame, principals: DataFrame, logins: DataFrame,
                        bad: DataFrame, new_owner: str = "sa") -> DataFrame:
    """Groups, databases and endpoints of bad logins, with the text that changes the owner.

    Servers without availability groups have no group tables; that branch is
    then left out.
    """
    owners = _of_bad(logins, bad).select("server_name", F.col("sid").alias("owner_sid"))

    def change(kind: str, name: str, tail: Column | None = None) -> Column:
        parts = [F.lit(f"alter authorization on {kind}::["), F.col(name), F.lit(f"] to [{new_owner}];")]
        return F.concat(*parts, *([tail] if tail is not None else [])).alias("change_owner_text")

    of_databases = databases.join(owners, ["server_name", "owner_sid"], "left_semi").select(
        "server_name", change("database", "name"))
    of_groups = None
    if groups is not None and replicas is not None:
        owned = replicas.join(owners, ["server_name", "owner_sid"], "left_semi").select("server_name", "group_id")
        of_groups = owned.join(groups, ["server_name", "group_id"]).select(
            "server_name", change("availability group", "name"))
    point_owners = principals.select("server_name", "principal_id", F.col("name").alias("login_name")).join(
        bad, ["server_name", "login_name"], "left_semi")
    grantees = principals.select("server_name", F.col("principal_id").alias("grantee_principal_id"),
                                 F.col("name").alias("_grantee"))
    grants = permissions.select("server_name", F.col("major_id").alias("endpoint_id"), "grantee_principal_id").join(
        grantees, ["server_name", "grantee_principal_id"])
    grant_text = F.concat(F.lit(" grant connect on endpoint::["), F.col("name"), F.lit("] to ["), F.col("_grantee"),
                          F.lit("];"))
    of_endpoints = (endpoints.join(point_owners, ["server_name", "principal_id"], "left_semi")
                    .join(grants, ["server_name", "endpoint_id"])
                    .select("server_name", change("endpoint", "name", grant_text)))
    parts = changes.union_present({"database": of_databases, "group": of_groups, "endpoint": of_endpoints})
    return parts.distinct().select(F.lit("C").alias("check"), "server_name", "change_owner_text")


def bad_login_jobs(jobs: DataFrame, logins: DataFrame, bad: DataFrame, new_owner: str = "sa") -> DataFrame:
    owners = _of_bad(logins, bad).select("server_name", F.col("sid").alias("owner_sid"), F.col("login_name").alias("owner"))
    command = F.concat(F.lit("EXEC msdb.dbo.sp_update_job @job_id=N'"), F.col("job_guid"),
                       F.lit(f"',@owner_login_name=N'{new_owner}'"))
    return jobs.join(owners, ["server_name", "owner_sid"]).select(
        F.lit("D").alias("check"), "server_name", binary.hex_text(F.col("owner_sid")).alias("sid"), "owner", "name",
        command.alias("change_owner_text"))


def bad_login_packages(packages: DataFrame, logins: DataFrame, bad: DataFrame) -> DataFrame:
    owners = _of_bad(logins, bad).select("server_name", F.col("sid").alias("owner_sid"), F.col("login_name").alias("owner"))
    command = F.concat(F.lit("update msdb..sysssispackages set ownersid=0x01 where id='"), F.col("package_id"), F.lit("'"))
    return packages.join(owners, ["server_name", "owner_sid"]).select(
        F.lit("E").alias("check"), "server_name", binary.hex_text(F.col("owner_sid")).alias("sid"), "owner", "name",
        command.alias("change_owner_text"))


FIRST_FIXED_SCHEMA = 16384


def bad_login_objects(logins: DataFrame, users: DataFrame, schemas: DataFrame, objects: DataFrame,
                      bad: DataFrame) -> DataFrame:
    """Users of bad logins in every database with what they own and whether they can be dropped."""
    owners = _of_bad(logins, bad).select("server_name", "login_name", "sid")
    people = users.select(*DB, "sid", "principal_id", F.col("name").alias("user_name")).join(owners, ["server_name", "sid"])
    owned = schemas.select(*DB, "principal_id", "schema_id", F.col("name").alias("schema_name"))
    held = objects.select(*DB, "schema_id", F.col("name").alias("object_name"))
    use = F.concat(F.lit("use ["), F.col("database_name"), F.lit("]; "))
    drop_user = F.concat(F.lit("drop user ["), F.col("user_name"), F.lit("];"))
    schema = F.col("schema_name")
    decision = (
        F.when(schema.isNull(), F.concat(use, drop_user))
        .when(F.col("object_name").isNotNull(), "-- the user owns objects!!")
        .when(F.col("schema_id") < FIRST_FIXED_SCHEMA,
              F.concat(use, F.lit("drop schema ["), schema, F.lit("]; "), drop_user))
        .otherwise(F.concat(use, F.lit("alter authorization on schema::["), schema, F.lit("] to ["), schema,
                            F.lit("]; "), drop_user)))
    return (people.join(owned, [*DB, "principal_id"], "left").join(held, [*DB, "schema_id"], "left")
            .select(F.lit("F").alias("check"), "server_name", "login_name", "database_name", "user_name",
                    "schema_name", "object_name", decision.alias("drop_user_text")))


# -- users, owners, permissions -----------------------------------------------------------------

def orphaned_users(users: DataFrame, logins: DataFrame) -> DataFrame:
    """Database users whose identifier belongs to no login of the server."""
    return (users.filter("is_login and sid is not null").join(logins.select("server_name", "sid"), ["server_name", "sid"], "left_anti")
            .select(*DB, F.col("name").alias("user_name"), binary.hex_text(F.col("sid")).alias("user_sid")))


def database_owners(databases: DataFrame, principals: DataFrame, new_owner: str = "sa") -> DataFrame:
    owners = principals.select("server_name", F.col("sid").alias("owner_sid"), F.col("name").alias("owner"))
    command = F.concat(F.lit("ALTER AUTHORIZATION ON DATABASE::["), F.col("name"), F.lit(f"] TO [{new_owner}];"))
    return databases.join(owners, ["server_name", "owner_sid"], "left").select(
        "server_name", "owner", "name", command.alias("authorization_text"))


def permission_script(databases: DataFrame, users: DataFrame, server_principals: DataFrame, role_members: DataFrame,
                      permissions: DataFrame, objects: DataFrame, schemas: DataFrame, database: str | None = None,
                      include_database_level: bool = False) -> DataFrame:
    """Text that rebuilds users, owner, role members and grants of one or all databases.

    Sections: drop user, owner, user with login, user without login, role
    member, grant. Grants on a whole database are left out unless asked for.
    """
    if database is not None:
        users, role_members, permissions, objects, schemas = (
            t.filter(F.col("database_name") == database)
            for t in (users, role_members, permissions, objects, schemas))
        databases = databases.filter(F.col("name") == database)

    def line(body: list[Column], prefix: str = "EXEC( 'USE ", end: str = "'); ") -> Column:
        return F.concat(F.lit(prefix), F.col("database_name"), F.lit("; "), *body, F.lit(end))

    def part(df: DataFrame, section: int, extract: Column) -> DataFrame:
        return df.select(*DB, F.lit(section).alias("section"), extract.alias("extract"))

    def lit(s: str) -> Column:
        return F.lit(s)

    name = F.col("name")
    not_dbo = name != "dbo"
    unless_user = [lit("IF NOT EXISTS (SELECT * FROM sys.database_principals WHERE name = N''"), name, lit("'') ")]
    drop = line([
        lit("IF NOT EXISTS (SELECT * FROM sys.schemas WHERE name = N''"), name,
        lit("'')IF  EXISTS (SELECT * FROM sys.database_principals WHERE name = N''"), name, lit("'') DROP USER ["),
        name, lit("]")])
    with_login = line([*unless_user, lit("CREATE USER ["), name, lit("] FOR LOGIN ["), F.col("_login"), lit("]")])
    without_login = line([*unless_user, lit("CREATE USER ["), name, lit("] WITHOUT LOGIN ")], end="');  ")
    by_sid = server_principals.select("server_name", F.col("sid").alias("owner_sid"), F.col("name").alias("_login"))

    # A user gives up to three lines, found in one pass over the users.
    def user_line(when: Column, section: int, extract: Column) -> Column:
        return F.when(when, F.struct(F.lit(section).alias("section"), extract.alias("extract")))

    people = users.withColumnRenamed("sid", "owner_sid").join(by_sid, ["server_name", "owner_sid"], "left")
    of_users = people.select(*DB, F.explode(F.array_compact(F.array(
        user_line(F.col("is_login") & F.col("has_db_access") & not_dbo, 1, drop),
        user_line(not_dbo & F.col("_login").isNotNull(), 3, with_login),
        user_line(F.col("principal_id").between(5, FIRST_FIXED_SCHEMA - 1), 4, without_login)))).alias("l")).select(
        *DB, "l.section", "l.extract")
    owned = databases.select("server_name", F.col("name").alias("database_name"), "owner_sid").join(
        by_sid, ["server_name", "owner_sid"], "left")
    owners = part(owned, 2, line([lit(" EXEC dbo.sp_changedbowner @loginame =N''"), F.col("_login"), lit("''")],
                                 prefix="EXEC ('USE ", end="');"))
    members = part(role_members.filter("member_name <> 'dbo'"), 5, line([
        lit("EXEC sp_addrolemember ''"), F.col("role_name"), lit("'', ''"), F.col("member_name"), lit("''")]))
    named_objects = objects.select(*DB, "object_id", "schema_id", F.col("name").alias("_object")).join(
        schemas.select(*DB, "schema_id", F.col("name").alias("_schema")), [*DB, "schema_id"]).select(
        *DB, F.col("object_id").alias("major_id"), "_object", "_schema")
    grants = permissions.join(named_objects, [*DB, "major_id"], "left" if include_database_level else "inner")
    if include_database_level:
        grants = grants.filter(F.col("_object").isNotNull() | (F.col("class") == 0))
    with_option = F.col("state_desc") == "GRANT_WITH_GRANT_OPTION"
    granted = part(grants, 6, line([
        F.when(with_option, "GRANT ").otherwise(F.col("state_desc")), lit(" "), F.col("permission_name"),
        F.when(F.col("class") == 1, F.concat(lit(" ON ["), F.col("_schema"), lit("].["), F.col("_object"), lit("] ")))
        .otherwise(""), lit(" TO ["), F.col("grantee_name"), lit("] "),
        F.when(with_option, " WITH GRANT OPTION").otherwise("")]))
    return changes.union_all([of_users, owners, members, granted])


def login_script(principals: DataFrame, logins: DataFrame, sql_logins: DataFrame, login: str | None = None) -> DataFrame:
    """Logins as creation text with identifier and policy flags; passwords are never captured."""
    chosen = (F.col("name") == login) if login is not None else (F.col("name") != "sa")
    rows = (principals.filter(F.col("type").isin("S", "G", "U") & chosen)
            .join(logins.select("server_name", "name", "has_access", "deny_login"), ["server_name", "name"], "left")
            .join(sql_logins.select("server_name", "name", "is_policy_checked", "is_expiration_checked"),
                  ["server_name", "name"], "left"))
    name = text.quote_name(F.col("name"))
    default = F.concat(F.lit("DEFAULT_DATABASE = ["), F.col("default_database_name"), F.lit("]"))

    def flag(option: str, c: str) -> Column:
        return F.coalesce(F.concat(F.lit(f", {option} = "), F.when(F.col(c), "ON").when(~F.col(c), "OFF")), F.lit(""))

    create = F.concat(F.lit("CREATE LOGIN "), name, F.when(
        F.col("type").isin("G", "U"), F.concat(F.lit(" FROM WINDOWS WITH "), default)).otherwise(F.concat(
            F.lit(" WITH SID = "), binary.hex_text(F.col("sid")), F.lit(", "), default,
            flag("CHECK_POLICY", "is_policy_checked"), flag("CHECK_EXPIRATION", "is_expiration_checked"))))
    access = (F.when(F.col("deny_login"), F.concat(F.lit("; DENY CONNECT SQL TO "), name))
              .when(~F.col("has_access"), F.concat(F.lit("; REVOKE CONNECT SQL TO "), name)).otherwise(""))
    disabled = F.when(F.col("is_disabled"), F.concat(F.lit("; ALTER LOGIN "), name, F.lit(" DISABLE"))).otherwise("")
    return rows.select("server_name", F.col("name").alias("login_name"), "type",
                       F.concat(create, access, disabled).alias("login_text"))


def hash_text(df: DataFrame, column: str) -> DataFrame:
    """Hash of a lower-cased name, as used to compare servers without naming them."""
    return df.withColumn("hash_text", binary.hash_text(F.col(column)))
