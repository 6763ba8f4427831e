"""Encryption, features, full text, index definitions and server inventory."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from opslens.functions import binary, codes, dates, numbers, text
from opslens.operators import adjacent, textagg

DATABASE = ["server_name", "database_id"]


# -- encryption ---------------------------------------------------------------------------------

def encryption_state(keys: DataFrame, databases: DataFrame) -> DataFrame:
    return keys.select(*DATABASE, "encryption_state").join(databases.select(*DATABASE, "name"), DATABASE).select(
        "server_name", "name", "encryption_state")


def encryption_chain(principal_credentials: DataFrame, credentials: DataFrame, principals: DataFrame,
                     asymmetric_keys: DataFrame, keys: DataFrame, databases: DataFrame) -> DataFrame:
    """From a database's key to the asymmetric key, its login and the login's credential."""
    logins = principals.select("server_name", "principal_id", F.col("name").alias("tde_login"),
                               F.col("sid").alias("tde_login_sid"), F.col("type_desc").alias("tde_login_type"))
    vaults = credentials.select(
        "server_name", "credential_id", F.col("name").alias("tde_credential_name"),
        F.col("credential_identity").alias("tde_credential_identity"),
        F.col("target_type").alias("tde_credential_target_type"))
    providers = asymmetric_keys.select(
        "server_name", F.col("name").alias("asymmetric_key_name"), F.col("thumbprint").alias("encryptor_thumbprint"),
        F.col("sid").alias("tde_login_sid"))
    chain = (principal_credentials.join(vaults, ["server_name", "credential_id"])
             .join(logins, ["server_name", "principal_id"]).join(providers, ["server_name", "tde_login_sid"]))
    owned = keys.select(*DATABASE, "encryptor_thumbprint").join(
        databases.select(*DATABASE, F.col("name").alias("database_name"), "is_encrypted"), DATABASE)
    return owned.join(chain, ["server_name", "encryptor_thumbprint"]).select(
        "server_name", "database_name", "is_encrypted", "encryptor_thumbprint", "principal_id", "credential_id",
        "tde_login", binary.hex_text(F.col("tde_login_sid")).alias("tde_login_sid"), "tde_login_type",
        "tde_credential_name", "tde_credential_identity", "tde_credential_target_type", "asymmetric_key_name")


def encryption_progress(keys: DataFrame) -> DataFrame:
    return keys.select(
        "server_name", "database_name", "encryption_state",
        codes.decode(F.col("encryption_state"), codes.ENCRYPTION_STATES, "No Status").alias("encryption_state_desc"),
        "percent_complete", "encryptor_thumbprint", "encryptor_type")


def database_certificates(keys: DataFrame, databases: DataFrame, certificates: DataFrame) -> DataFrame:
    """Every database with its key and certificate, where it has them."""
    certs = certificates.select("server_name", F.col("name").alias("certificate_name"),
                                F.col("thumbprint").alias("encryptor_thumbprint"))
    all_databases = databases.select(*DATABASE, F.col("name").alias("_name"))
    state = (F.when(F.col("encryption_state") == 3, "Encrypted").when(F.col("encryption_state") == 2, "In Progress")
             .otherwise("Not Encrypted"))
    return (keys.drop("database_name").join(all_databases, DATABASE, "right")
            .join(certs, ["server_name", "encryptor_thumbprint"], "left")
            .select("server_name", F.col("_name").alias("database_name"), "certificate_name", "encryptor_type",
                    state.alias("state"), "encryption_state", "percent_complete", "key_algorithm", "key_length"))


# -- settings and features ----------------------------------------------------------------------

def sku_features(features: DataFrame) -> DataFrame:
    """Edition-bound features in use, over all databases."""
    return features.select("server_name", "database_name", "feature_name", "feature_id")


def settings_like(settings: DataFrame, pattern: str) -> DataFrame:
    return settings.filter(F.col("name").like(pattern))


def credentials_of_type(credentials: DataFrame, target_type: str = "CRYPTOGRAPHIC PROVIDER") -> DataFrame:
    return credentials.filter(F.col("target_type") == target_type)


def provider_keys(asymmetric_keys: DataFrame, provider_type: str = "CRYPTOGRAPHIC PROVIDER") -> DataFrame:
    return asymmetric_keys.filter(F.col("provider_type") == provider_type)


def listening_ports(connections: DataFrame) -> DataFrame:
    return connections.filter("local_tcp_port is not null").select("server_name", "local_tcp_port").distinct()


def stale_checks(dbinfo: DataFrame, databases: DataFrame, as_of: str | datetime, days: int = 7) -> DataFrame:
    """Databases whose last good consistency check is older than some days."""
    eligible = databases.filter(
        "database_id > 4 and state_desc = 'ONLINE' and not is_read_only").filter(
        F.col("create_date") < dates.ago(as_of, days, "day")).select("server_name", F.col("name").alias("database_name"))
    checked = F.col("value").try_cast("timestamp_ntz")
    return (dbinfo.filter("field = 'dbi_dbccLastKnownGood'")
            .filter(dates.boundary_diff("day", checked, dates.instant(as_of)) > days)
            .join(eligible, ["server_name", "database_name"], "left_semi")
            .select("server_name", "database_name", "parent_object", "object", "field", "value").distinct())


# -- full text ----------------------------------------------------------------------------------

def fulltext_state(catalogs: DataFrame) -> DataFrame:
    return catalogs.select("server_name", "name", "item_count", "merge_status", "populate_completion_age",
                           "populate_status", "import_status")


def stale_crawls(indexes: DataFrame, tables: DataFrame, catalogs: DataFrame, as_of: str | datetime,
                 days: int = 14) -> DataFrame:
    """Enabled full-text indexes whose last crawl ended long ago."""
    old = indexes.filter(F.col("is_enabled") & (F.col("crawl_end_date") < dates.ago(as_of, days, "day")))
    named = tables.select("server_name", "object_id", F.col("index_id").alias("unique_index_id"),
                          F.col("name").alias("table_name"), "index_name")
    kept = catalogs.select("server_name", "catalog_id", F.col("name").alias("catalog_name"))
    return (old.join(named, ["server_name", "object_id", "unique_index_id"]).join(kept, ["server_name", "catalog_id"])
            .select("server_name", "catalog_name", "table_name", "index_name", "crawl_start_date", "crawl_end_date"))


def fragmentation(fragments: DataFrame, indexes: DataFrame, tables: DataFrame, catalogs: DataFrame) -> DataFrame:
    """Full-text index size and the share outside its largest fragment."""
    def mb(c: Column) -> Column:
        return numbers.exact_div(c, numbers.MB, 2)

    size = fragments.groupBy("server_name", F.col("table_id").alias("object_id")).agg(
        F.count("*").alias("fragments_count"), mb(F.sum("data_size")).alias("index_size_mb"),
        mb(F.max("data_size")).alias("largest_fragment_mb"))
    named = tables.select("server_name", "object_id", F.concat(
        text.quote_name(F.col("schema_name")), F.lit("."), text.quote_name(F.col("name"))).alias("base_object_name"))
    kept = catalogs.select("server_name", "catalog_id", F.col("name").alias("catalog_name"))
    spare = F.col("index_size_mb") - F.col("largest_fragment_mb")
    share = F.when(F.col("index_size_mb") == 0, F.lit(0)).otherwise(
        numbers.exact_div(spare * 10000, F.col("index_size_mb") * 100, 6))
    return (indexes.select("server_name", "catalog_id", "object_id").join(size, ["server_name", "object_id"])
            .join(named, ["server_name", "object_id"]).join(kept, ["server_name", "catalog_id"])
            .select("server_name", "catalog_id", "catalog_name", "object_id", "base_object_name", "index_size_mb",
                    "fragments_count", "largest_fragment_mb", spare.alias("fragmentation_space_mb"),
                    share.alias("fragmentation_percent")))


# -- definitions --------------------------------------------------------------------------------

def index_ddl(indexes: DataFrame, index_columns: DataFrame) -> DataFrame:
    """Index definitions as text, with the text that disables a disabled one.

    Key and included columns of one index are joined in order; an index has at
    most a few dozen columns.
    """
    key = ["server_name", "schema_name", "table_name", "index_name"]
    is_key = ~F.col("is_included")
    direction = F.when(F.col("is_descending"), " DESC").otherwise(" ASC")
    columns = index_columns.groupBy(*key).agg(
        textagg.ordered_text(F.when(is_key, F.concat(F.col("column_name"), direction)), F.col("ordinal"), ", ")
        .alias("key_columns"),
        textagg.ordered_text(F.when(~is_key, F.col("column_name")), F.col("ordinal"), ", ").alias("included_columns"))

    def switch(name: str, c: str) -> Column:
        return F.concat(F.lit(name + " = "), F.when(F.col(c), "ON").otherwise("OFF"), F.lit(", "))

    options = F.concat(
        switch("PAD_INDEX", "is_padded"), switch("ALLOW_PAGE_LOCKS", "allow_page_locks"),
        switch("ALLOW_ROW_LOCKS", "allow_row_locks"), switch("STATISTICS_NORECOMPUTE", "no_recompute"),
        switch("IGNORE_DUP_KEY", "ignore_dup_key"), F.lit("SORT_IN_TEMPDB = OFF, FILLFACTOR ="),
        F.col("fill_factor").cast("string"))
    index = text.quote_name(F.col("index_name"))
    target = F.concat(text.quote_name(F.col("schema_name")), F.lit("."), text.quote_name(F.col("table_name")))
    create = F.concat(
        F.lit("CREATE "), F.when(F.col("is_unique"), "UNIQUE ").otherwise(""), F.col("type_desc"), F.lit(" INDEX "),
        index, F.lit(" ON "), target, F.lit("("), F.col("key_columns"), F.lit(") "),
        F.when(F.col("included_columns") != "",
               F.concat(F.lit("\rINCLUDE ("), F.col("included_columns"), F.lit(")"))).otherwise(""),
        F.lit("\rWITH ("), options, F.lit(") ON "), text.quote_name(F.col("filegroup_name")), F.lit(";"))
    disable = F.when(F.col("is_disabled"), F.concat(F.lit("\rALTER INDEX "), index, F.lit(" ON "), target,
                                                    F.lit(" DISABLE;\r"))).otherwise("")
    wanted = indexes.filter("type > 0 and not is_primary_key and not is_unique_constraint and table_name <> 'sysdiagrams'")
    return wanted.join(columns, key).select(*key, create.alias("create_text"), disable.alias("disable_text"))


def routine_search(routines: DataFrame, wanted: str, column: str = "definition") -> DataFrame:
    """Routines whose whole text holds some words."""
    return routines.filter(F.col(column).contains(wanted))


def immediate_sync(publications: DataFrame) -> DataFrame:
    """Publications that synchronise at once and the text that stops it."""
    def change(prop: str) -> Column:
        return F.concat(F.lit("USE "), F.col("publisher_db"), F.lit("; EXEC sp_changepublication @publication='"),
                        F.col("publication"), F.lit(f"',@property = N'{prop}',@value='FALSE' ;"))

    fix = F.concat(change("allow_anonymous"), F.lit(" "), change("immediate_sync"))
    return publications.filter("immediate_sync").select("server_name", "publisher_db", "publication",
                                                        "immediate_sync", fix.alias("fix_text"))


def schema_transfer(objects: DataFrame, schemas: DataFrame, old: str = "OLD") -> DataFrame:
    """Text that moves tables, procedures and views out of an old schema."""
    key = ["server_name", "database_name", "schema_id"]
    source = schemas.filter(F.col("name") == old).select(*key, F.col("name").alias("schema_name"))
    move = F.concat(F.lit("ALTER SCHEMA dbo TRANSFER "), F.col("schema_name"), F.lit("."), F.col("name"))
    return objects.filter(F.col("type").isin("U", "P", "V")).join(source, key).select(
        "server_name", "database_name", "object_id", move.alias("transfer_text"))


# -- servers ------------------------------------------------------------------------------------

# Line patterns of the registration file.
FOLDER_LINE = r"^\[(\w+[^\\])\]$"
SUBFOLDER_LINE = r"^\[(\w+\\.+)\]$"
ENTRY_LINE = r"^[^;#\[]"


def server_registry(lines: DataFrame) -> DataFrame:
    """Folders and servers of registration files, each with the folder it is in.

    The folder of a line is the latest folder line before it, carried through
    runs of lines, so a long file is not one task's work.
    """
    trimmed = lines.select("file", "line_no", F.trim("line").alias("line"))
    line = F.col("line")
    folder = F.nullif(F.regexp_extract(line, FOLDER_LINE, 1), F.lit(""))
    subfolder = F.nullif(F.regexp_extract(line, SUBFOLDER_LINE, 1), F.lit(""))
    rows = adjacent.carry_forward(trimmed, ["file"], "line_no", F.coalesce(folder, subfolder),
                                  adjacent.line_bucket("line_no"), "current")
    parent = (F.when(folder.isNotNull(), ".").when(subfolder.isNotNull(), text.directory_of(subfolder))
              .otherwise(F.coalesce("current", F.lit("."))))
    leaf = F.regexp_extract(subfolder, r"([^\\]+)$", 1)
    return rows.filter(folder.isNotNull() | subfolder.isNotNull() | line.rlike(ENTRY_LINE)).select(
        "file", "line_no", parent.alias("parent_folder"),
        F.when(folder.isNotNull() | subfolder.isNotNull(), "Directory").otherwise("Registration").alias("type"),
        F.coalesce(folder, F.when(subfolder.isNotNull(), leaf), line).alias("value"))


def server_versions(hosts: DataFrame, machine: str | None = None) -> DataFrame:
    rows = hosts if machine is None else hosts.filter(F.col("machine_name") == machine)
    return rows.select("server_name", "machine_name", "product_version",
                       text.version_token(F.col("version_banner"), F.col("product_version")).alias("version"))


def power_plan_finding(hosts: DataFrame) -> DataFrame:
    speed = numbers.exact_div(F.col("cpu_mhz"), 1000, 2).cast("decimal(18,2)")
    return hosts.select(
        "server_name", F.lit("Server Info").alias("findings_group"), F.lit("Power Plan").alias("finding"),
        F.concat(speed.cast("string"), F.lit("GHz CPUs")).alias("cpu_speed"),
        codes.decode(F.col("power_scheme"), codes.POWER_PLANS, "an unknown power mode").alias("power_plan"))
