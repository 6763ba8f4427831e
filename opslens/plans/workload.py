"""Sessions, blocking, statements, memory and processor reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from opslens.functions import binary, codes, dates, numbers, text, xmls
from opslens.operators import forest, ranking, textagg

SESSION = ["server_name", "session_id"]
TEXT = ["server_name", "sql_handle"]


# -- processor ----------------------------------------------------------------------------------

def cpu_history(ring: DataFrame, ticks: DataFrame, as_of: str | datetime) -> DataFrame:
    """Processor share of the server, of others and idle, per ring buffer record.

    A server's ring holds a fixed number of records, so numbering them per
    server is a small window.
    """
    health = F.col("record")["SchedulerMonitorEvent"]["SystemHealth"]
    records = (
        ring.filter(F.col("record").contains("<SystemHealth>"))
        .select("server_name", "ticks", xmls.parse(F.col("record"), xmls.SCHEDULER_RECORD).alias("record"))
        .select("server_name", "ticks", F.col("record")["_id"].alias("record_id"),
                health["ProcessUtilization"].alias("sql_cpu"), health["SystemIdle"].alias("system_idle")))
    order = Window.partitionBy("server_name").orderBy("record_id")
    return records.join(ticks, "server_name").select(
        "server_name", "record_id", F.row_number().over(order).alias("rn"),
        dates.tick_time(as_of, F.col("ms_ticks"), F.col("ticks")).alias("event_time"),
        "sql_cpu", "system_idle", (100 - F.col("system_idle") - F.col("sql_cpu")).alias("other_cpu"))


def cpu_linestrings(history: DataFrame) -> DataFrame:
    """The two curves of each server's ring as line strings, with a scale line between them."""
    def line(measure: str) -> Column:
        point = F.concat(F.col("rn").cast("string"), F.lit(" "), F.col(measure).cast("string"))
        return F.concat(F.lit("LINESTRING("), textagg.ordered_text(point, F.col("rn"), ","), F.lit(")"))

    curves = history.groupBy("server_name").agg(line("sql_cpu").alias("own"), line("other_cpu").alias("other"))
    return curves.select("server_name", F.explode(F.array(
        F.struct(F.col("own").alias("line"), F.lit("SQL CPU %").alias("measure")),
        F.struct(F.lit("LINESTRING(1 100,2 100)").alias("line"), F.lit("").alias("measure")),
        F.struct(F.col("other").alias("line"), F.lit("Other CPU %").alias("measure")),
    )).alias("p")).select("server_name", "p.line", "p.measure")


# -- blocking -----------------------------------------------------------------------------------

def _blocking_walk(processes: DataFrame) -> DataFrame:
    """Blocked sessions and the heads that block someone, with path, depth and head."""
    waits = (F.col("blocked") > 0) & (F.col("blocked") != F.col("spid"))
    blocked = processes.filter(waits).select("server_name", "spid", F.col("blocked").alias("_up"))
    blockers = blocked.select("server_name", F.col("_up").alias("spid")).distinct()
    is_free = (F.col("blocked") == 0) | (F.col("blocked") == F.col("spid"))
    heads = (processes.filter(is_free).join(blockers, ["server_name", "spid"], "left_semi")
             .select("server_name", "spid", F.lit(None).cast("long").alias("_up")))
    return forest.walk(heads.unionByName(blocked), ["server_name"], "spid", "_up")


def blocking_tree(processes: DataFrame) -> DataFrame:
    """Blocking chains as an indented tree; sort by server and path to read it."""
    batch = processes.select("server_name", "spid", text.one_line(F.col("batch")).alias("batch"))
    depth = F.col("depth")
    line = F.concat(F.lit("    "), F.repeat(F.lit("|         "), depth),
                    F.when(depth == 0, "HEAD -  ").otherwise("|------  "),
                    F.col("spid").cast("string"), F.lit(" "), F.col("batch"))
    return (_blocking_walk(processes).join(batch, ["server_name", "spid"])
            .select("server_name", "path", "depth", line.alias("blocking_tree")))


def block_leaders(processes: DataFrame) -> DataFrame:
    """Number of sessions behind each head blocker and the depth of its tree."""
    return (_blocking_walk(processes).groupBy("server_name", F.col("root").alias("session_id"))
            .agg((F.count("*") - 1).alias("blocked_session_count"), F.max("depth").alias("max_depth")))


# -- transactions -------------------------------------------------------------------------------

def open_transactions(database_transactions: DataFrame, session_transactions: DataFrame,
                      sessions: DataFrame, connections: DataFrame, requests: DataFrame, texts: DataFrame,
                      as_of: str | datetime) -> DataFrame:
    """Open transactions with the log they hold and the last text of their session."""
    last_text = connections.select(*SESSION, F.col("most_recent_sql_handle").alias("sql_handle")).join(
        texts, TEXT).select(*SESSION, F.col("text").alias("last_text"))
    return (database_transactions.join(session_transactions, ["server_name", "transaction_id"])
            .join(sessions.select(*SESSION, "login_name"), SESSION)
            .join(requests.select(*SESSION), SESSION, "left")
            .join(last_text, SESSION)
            .select("server_name", "session_id", "transaction_id", "login_name", "database_name", "begin_time",
                    dates.boundary_diff("minute", F.col("begin_time"), dates.instant(as_of)).alias("elapsed_minutes"),
                    "log_bytes_used", "log_bytes_reserved", "last_text"))


JOB_STEP_PREFIX = "SQLAgent - TSQL JobStep (Job 0x"


def _with_job_names(rows: DataFrame, jobs: DataFrame) -> DataFrame:
    """Hex job ids inside program names replaced by the job's name."""
    program = F.col("program_name")
    is_step = program.startswith(JOB_STEP_PREFIX)
    named = jobs.select("server_name", binary.guid_hex(F.col("job_guid")).alias("_job_hex"),
                        F.col("name").alias("_job_name"))
    found = rows.withColumn("_job_hex", F.when(is_step, F.substring(program, 30, 34)))
    shown = F.replace(program, F.col("_job_hex"), F.coalesce("_job_name", F.lit("")))
    # only job steps have a key to look up; the others would all meet in the partition of the null key
    steps = found.filter("_job_hex is not null").join(named, ["server_name", "_job_hex"], "left")
    others = found.filter("_job_hex is null").drop("_job_hex")
    return steps.withColumn("program_name", shown).select(*others.columns).unionByName(others)


def long_transactions(sessions: DataFrame, session_transactions: DataFrame, database_transactions: DataFrame,
                      requests: DataFrame, texts: DataFrame, jobs: DataFrame, as_of: str | datetime,
                      minutes: int = 1, only_sleeping: bool = False) -> DataFrame:
    """Transactions open for longer than some minutes, with statement, job name and details as XML."""
    people = sessions.filter("status = 'sleeping'") if only_sleeping else sessions
    people = people.select(
        *SESSION, "host_name", "program_name", "login_name", "login_time", "input_buffer",
        F.col("last_request_start_time").alias("last_request_start"),
        F.col("last_request_end_time").alias("last_request_end"), F.col("open_tran").alias("transaction_count"))
    open_ = (database_transactions.filter(~F.col("state").isin(3))
             .join(session_transactions, ["server_name", "transaction_id"])
             .join(people, SESSION)
             .withColumn("transaction_start", F.coalesce("begin_time", "last_request_start"))
             .filter(F.col("transaction_start") < dates.ago(as_of, minutes, "minute")))
    running = requests.select(*SESSION, "blocking_session_id", "command", "wait_time", "wait_resource",
                              "sql_handle", "statement_start_offset", "statement_end_offset")
    rows = _with_job_names(open_, jobs).join(running, SESSION, "left").join(texts, TEXT, "left")
    statement = text.statement_slice(F.col("text"), F.col("statement_start_offset"), F.col("statement_end_offset"))
    rows = rows.select(
        *SESSION, "transaction_id", "blocking_session_id",
        dates.boundary_diff("minute", F.col("transaction_start"), dates.instant(as_of)).alias("transaction_minutes"),
        F.coalesce("database_name", F.col("database_id").cast("string")).alias("database_name"),
        "host_name", "program_name", "login_name", "login_time", "last_request_start", "last_request_end",
        "transaction_count", "transaction_start", F.col("state").alias("transaction_state"), "command",
        "wait_time", "wait_resource", F.coalesce("text", F.lit("")).alias("sql_text"),
        F.coalesce(statement, F.lit("")).alias("sql_statement"),
        F.coalesce("input_buffer", F.lit("")).alias("input_buffer"))
    details = text.xml_element("Transaction", {
        "TransactionState": codes.decode(F.col("transaction_state"), codes.TRANSACTION_STATES,
                                         F.col("transaction_state").cast("string")),
        "TransactionLengthMinutes": F.col("transaction_minutes"), "SessionID": F.col("session_id"),
        "DbName": F.col("database_name"), "LoginName": F.col("login_name"), "HostName": F.col("host_name"),
        "WaitResource": F.col("wait_resource"), "LoginTime": dates.style_text(F.col("login_time"), 120),
        "LastRequest": dates.style_text(F.col("last_request_start"), 120), "ProgramName": F.col("program_name")})
    return rows.withColumn("session_info", details)


def progress_milestones(samples: DataFrame) -> DataFrame:
    """First sample in each milestone band and whether it is announced.

    A band counts only before any higher band was reached. An announcement
    needs more than the least gap since the last one. Per job only four times
    leave the aggregation, so a job may have any number of samples.
    """
    percent = F.col("percent_complete")
    position = F.struct("sampled_at", "sample_id", "percent_complete")
    bands = codes.MILESTONES
    firsts = samples.groupBy("server_name", "job_id").agg(*[
        F.min(F.when((percent >= low) & (percent < high), position)).alias(f"_m{low}") for low, high in bands])
    crossings = []
    for i, (low, _) in enumerate(bands):
        me, later = F.col(f"_m{low}"), [F.col(f"_m{b}") for b, _ in bands[i + 1:]]
        valid = me.isNotNull()
        for other in later:
            valid = valid & F.coalesce(me < other, F.lit(True))
        crossings.append(F.when(valid, F.struct(
            me["sampled_at"].alias("sampled_at"), me["percent_complete"].alias("percent_complete"),
            F.lit(low).alias("milestone"))))
    in_order = F.sort_array(F.array_compact(F.array(*crossings)))
    gap = codes.MILESTONE_GAP_SECONDS
    start = F.struct(F.lit(None).cast("timestamp_ntz").alias("last"),
                     F.filter(F.transform(in_order, lambda c: F.struct(
                         c["milestone"].alias("milestone"), c["sampled_at"].alias("sampled_at"),
                         c["percent_complete"].alias("percent_complete"), F.lit(False).alias("announced"))),
                         lambda _: F.lit(False)).alias("done"))

    def step(state: Column, c: Column) -> Column:
        announced = state["last"].isNull() | (
            dates.boundary_diff("second", state["last"], c["sampled_at"]) > gap)
        done = F.array_append(state["done"], F.struct(
            c["milestone"].alias("milestone"), c["sampled_at"].alias("sampled_at"),
            c["percent_complete"].alias("percent_complete"), announced.alias("announced")))
        return F.struct(F.when(announced, c["sampled_at"]).otherwise(state["last"]).alias("last"),
                        done.alias("done"))

    told = firsts.select("server_name", "job_id",
                         F.explode(F.aggregate(in_order, start, step, lambda s: s["done"])).alias("m"))
    return told.select("server_name", "job_id", "m.milestone", "m.sampled_at", "m.percent_complete", "m.announced")


# -- sessions -----------------------------------------------------------------------------------

def connections_by_host(sessions: DataFrame) -> DataFrame:
    keys = ["server_name", "database_name", "host_name", "login_name", "program_name"]
    return sessions.groupBy(*keys).agg(F.count("database_id").alias("number_of_connections"))


def user_sessions(sessions: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests of user sessions per login, host, program and database; blanks for unknown.

    Requests are counted per session and database before they meet the sessions.
    """
    running = requests.groupBy(*SESSION, "database_name").agg(F.count("*").alias("_n"))
    people = sessions.filter("is_user_process").select(*SESSION, "login_name", "host_name", "program_name")

    def blank(c: str, name: str) -> Column:
        return F.coalesce(c, F.lit("")).alias(name)

    return (people.join(running, SESSION, "left")
            .groupBy("server_name", "login_name", blank("host_name", "host"), blank("program_name", "program"),
                     blank("database_name", "database_name"))
            .agg(F.sum(F.coalesce("_n", F.lit(1))).alias("sessions")))


def idle_sessions(sessions: DataFrame, as_of: str | datetime, hours: int = 24,
                  login: str | None = None) -> DataFrame:
    """Oldest and newest last batch of sleeping sessions idle for longer than some hours."""
    idle = sessions.filter((F.col("status") == "sleeping") & (F.col("last_batch") < dates.ago(as_of, hours, "hour")))
    if login is not None:
        idle = idle.filter(F.col("login_name") == login)
    return idle.groupBy("server_name", "login_name").agg(
        F.max("last_batch").alias("newest_batch"), F.min("last_batch").alias("oldest_batch")).select(
        "*", dates.ago(as_of, 5, "hour").alias("five_hours_before"),
        dates.ago(as_of, -5, "hour").alias("five_hours_after"))


def kill_text(sessions: DataFrame, databases: DataFrame, name: str | None = None) -> DataFrame:
    """Text that would end the sessions of a database (of every one by default); never run."""
    wanted = databases.filter(F.col("name") == name) if name is not None else databases
    return (sessions.join(wanted.select("server_name", "database_id"), ["server_name", "database_id"], "left_semi")
            .select("server_name", "session_id", "database_name", "login_name", "status",
                    F.concat(F.lit("KILL "), F.col("session_id").cast("string"), F.lit(";")).alias("kill_text")))


def session_group(login: Column, login_map: dict[str, str], default: str = "default") -> Column:
    """Workload group of a login."""
    return codes.decode(login, login_map, default)


def session_classes(sessions: DataFrame, login_map: dict[str, str]) -> DataFrame:
    return (sessions.groupBy("server_name", session_group(F.col("login_name"), login_map).alias("group_name"))
            .agg(F.count("*").alias("sessions")))


# -- statements ---------------------------------------------------------------------------------

def running_by_cpu(requests: DataFrame, texts: DataFrame) -> DataFrame:
    """Running requests with their statement; most processor time first when sorted."""
    statement = text.statement_slice(F.col("text"), F.col("statement_start_offset"), F.col("statement_end_offset"))
    return requests.join(texts, TEXT).select(
        *SESSION, "request_id", F.col("text").alias("batch_text"), statement.alias("statement_text"),
        "cpu_time", "command", "start_time")


MEASURES = {"cpu": "total_worker_time", "reads": "total_logical_reads", "writes": "total_logical_writes",
            "elapsed": "total_elapsed_time"}


# Shown where they were captured.
LAST_RUN_COLUMNS = ["last_logical_reads", "last_logical_writes", "last_worker_time", "last_elapsed_time", "query_plan"]


def expensive_queries(stats: DataFrame, texts: DataFrame, by: str = "cpu", n: int = 50) -> DataFrame:
    """Top statements by a measure.

    Only the handles of the texts take part in choosing the top rows; the texts
    themselves are joined to those few rows.
    """
    known = stats.join(texts.select(*TEXT), TEXT, "left_semi")
    top = ranking.top_rows(known, MEASURES[by], ["server_name", "plan_handle"], n)
    statement = text.statement_slice(F.col("text"), F.col("statement_start_offset"), F.col("statement_end_offset"))
    return top.join(texts, TEXT).select(
        "server_name", "plan_handle", statement.alias("statement_text"), "execution_count",
        "total_logical_reads", "total_logical_writes", "total_worker_time",
        numbers.int_div(F.col("total_elapsed_time"), 1000000).alias("total_elapsed_seconds"), "last_execution_time",
        *[c for c in LAST_RUN_COLUMNS if c in stats.columns])


def redundant_queries(stats: DataFrame, texts: DataFrame, by: str = "plans", n: int = 10,
                      samples: int = 10) -> DataFrame:
    """Per server the statements with most plans (or reads, cpu, elapsed), with sample plans.

    Samples are cut to the top per statement before the texts are joined.
    """
    key = ["server_name", "query_hash", "statement_start_offset", "statement_end_offset"]
    measure = F.count("query_hash") if by == "plans" else F.sum(MEASURES[by])
    groups = stats.groupBy(*key).agg(
        measure.alias("sort_order"), F.count("query_hash").alias("plans_cached"),
        # Constant: the hash is part of the grouping key.
        F.lit(1).alias("distinct_plans_cached"),
        F.sum("execution_count").alias("total_executions"), F.sum("total_worker_time").alias("total_cpu"),
        F.sum("total_elapsed_time").alias("total_duration"), F.sum("total_logical_reads").alias("total_reads"),
        F.sum("total_logical_writes").alias("total_writes"),
        F.min("creation_time").alias("first_plan_creation_time"),
        F.max("creation_time").alias("last_plan_creation_time"),
        F.max("last_execution_time").alias("last_execution_time"))
    top = ranking.top_per_group(groups, ["server_name"], [F.desc("sort_order"), *[F.asc(k) for k in key[1:]]], n)
    plans = (stats.select(*key, "plan_handle", "sql_handle", "total_elapsed_time")
             .join(top.select(*key), key, "left_semi")
             .join(texts.select(*TEXT), TEXT, "left_semi"))
    sample = ranking.top_per_group(plans, key, [F.desc("total_elapsed_time"), F.asc("plan_handle")], samples)
    command = F.concat(F.lit("DBCC FREEPROCCACHE ("), F.col("plan_handle").cast("string"), F.lit(");"))
    return (sample.join(top, key).join(texts, TEXT)
            .select(*top.columns, "plan_handle", F.col("text").alias("sample_query_text"),
                    command.alias("free_plan_text")))


def distributed_transactions(locks: DataFrame, sessions: DataFrame, texts: DataFrame) -> DataFrame:
    """Sessions inside distributed transactions, with their text.

    Locks are reduced to distinct units of work before anything is joined.
    """
    units = (locks.filter("request_owner_guid <> '00000000-0000-0000-0000-000000000000'")
             .select("server_name", F.col("request_owner_guid").alias("uow_guid"),
                     F.col("request_session_id").alias("session_id")).distinct())
    people = sessions.select(*SESSION, "database_name", "login_name", "host_name", "status", "program_name",
                             "lastwaittype", "cpu", "memusage", "physical_io", "sql_handle")
    return units.join(people, SESSION).join(texts, TEXT, "left").select(
        "server_name", "uow_guid", "session_id", "database_name", "login_name", "host_name", "status",
        "program_name", F.col("text").alias("query_text"), "lastwaittype", "cpu", "memusage", "physical_io")


def forwarded_records(index_stats: DataFrame, indexes: DataFrame) -> DataFrame:
    """Tables with forwarded rows and the text that rebuilds them, over all databases."""
    key = ["server_name", "database_name", "object_id", "index_id"]
    script = F.concat(F.lit("USE "), F.col("database_name"), F.lit("; ALTER TABLE "), F.col("table_name"),
                      F.lit(" REBUILD;"))
    return index_stats.filter("forwarded_record_count > 0").join(indexes, key).select(
        "server_name", "database_name", "table_name", "index_name", "index_type_desc", "page_count",
        "avg_fragmentation_in_percent", "forwarded_record_count", script.alias("script"))


# -- memory -------------------------------------------------------------------------------------

def worker_threads(schedulers: DataFrame, hosts: DataFrame, as_of: str | datetime) -> DataFrame:
    """Worker threads in all, in use, available and waited for."""
    used = schedulers.filter("status = 'VISIBLE ONLINE'").groupBy("server_name").agg(
        F.sum("active_workers_count").alias("current_threads"),
        F.sum("runnable_tasks_count").alias("workers_waiting_for_cpu"),
        F.sum("work_queue_count").alias("requests_waiting_for_threads"))
    total = F.col("max_workers_count")
    return used.join(hosts.select("server_name", "max_workers_count"), "server_name").select(
        "server_name", dates.instant(as_of).alias("time_stamp"), total.alias("total_threads"), "current_threads",
        (total - F.col("current_threads")).alias("available_threads"), "workers_waiting_for_cpu",
        "requests_waiting_for_threads")


def region_summary(regions: DataFrame, dedupe: bool = True) -> DataFrame:
    """Reserved and free address regions per size.

    Allocated regions are summed per allocation; free ones (base 0) stay apart,
    and equal sizes count once unless ``dedupe`` is off.
    """
    allocated = (regions.filter("allocation_base <> 0").groupBy("server_name", "allocation_base")
                 .agg(F.sum("region_size").alias("size")))
    free = regions.filter("allocation_base = 0").select(
        "server_name", "allocation_base", F.col("region_size").alias("size"))
    dump = allocated.unionByName(free)
    dump = dump.distinct() if dedupe else dump
    is_free = F.col("allocation_base") == 0
    return dump.groupBy("server_name", "size").agg(
        F.sum(F.when(is_free, 0).otherwise(1)).alias("reserved"), F.sum(F.when(is_free, 1).otherwise(0)).alias("free"))


def address_space(regions: DataFrame, dedupe: bool = True) -> DataFrame:
    """Free address space and the largest free region, in KB."""
    return region_summary(regions, dedupe).filter("free <> 0").groupBy("server_name").agg(
        numbers.int_div(F.sum(F.col("size") * F.col("free")), 1024).alias("total_available_kb"),
        numbers.int_div(F.max("size"), 1024).alias("max_free_kb"))


def numa_nodes(schedulers: DataFrame) -> DataFrame:
    """Processor nodes per server, all and with a scheduler online."""
    visible = schedulers.filter("scheduler_id < 255 and parent_node_id < 64")
    return visible.groupBy("server_name").agg(
        F.countDistinct("parent_node_id").alias("numa_nodes"),
        F.countDistinct(F.when(F.col("is_online"), F.col("parent_node_id"))).alias("numa_nodes_affined"))


def memory_recommendation(hosts: DataFrame, schedulers: DataFrame | None = None,
                          numa_affinity: bool = False) -> DataFrame:
    """Recommended memory limit per server after the reserve for system and worker stacks."""
    def d(c: Column) -> Column:
        return c.cast("decimal(20,4)")

    banner = F.col("version_banner")
    stack_mb = F.when(banner.contains("<X64>"), 2.0).when(banner.contains("<IA64>"), 4.0).otherwise(0.5)
    enterprise = F.col("edition_id").isin(*codes.ENTERPRISE_EDITIONS)
    developer = F.col("edition_id") == codes.DEVELOPER_EDITION
    limited = ~enterprise & ~developer
    limit = F.when(F.col("major_version") >= 11, 128.0).otherwise(64.0)
    capped = limited & (F.col("physical_gb") > limit)
    reserve = d(F.when(capped, 5.0 + (limit - 16.0) / 8.0)
                .otherwise(numbers.system_reserve_gb(F.col("physical_gb")) + F.col("thread_stack_gb").cast("double")))
    left = d(F.col("physical_gb")) - F.col("reserve_gb")
    at_limit = capped & (left >= limit)
    rows = (hosts.withColumn("physical_mb", d(F.col("total_physical_memory_kb") / 1024.0))
            .withColumn("physical_gb", F.ceil(F.col("total_physical_memory_kb") / 1048576.0).cast("double"))
            .withColumn("thread_stack_gb", d(F.col("max_workers_count") * stack_mb / 1024.0))
            .withColumn("reserve_gb", reserve)
            .withColumn("recommended_gb", d(F.when(at_limit, d(limit)).otherwise(left))))
    if numa_affinity:
        rows = rows.join(numa_nodes(schedulers), "server_name").withColumn(
            "recommended_gb", F.col("recommended_gb") / F.col("numa_nodes") * F.col("numa_nodes_affined"))
    recommended = F.floor(F.col("recommended_gb") * 1024).cast("long")
    script = F.concat(
        F.lit("EXEC sp_configure 'show advanced options', 1; RECONFIGURE WITH OVERRIDE; "
              "EXEC sp_configure 'max server memory (MB)', "), recommended.cast("string"),
        F.lit("; EXEC sp_configure 'show advanced options', 0; RECONFIGURE WITH OVERRIDE;"))
    return rows.select(
        "server_name", banner.alias("version"),
        F.when(enterprise, "Enterprise Edition").when(developer, "Developer Edition")
        .otherwise("Non-Enterprise Edition").alias("edition"),
        F.floor("physical_mb").cast("long").alias("physical_mb"),
        F.col("max_server_memory_mb").alias("configured_mb"), F.col("running_memory_mb").alias("running_mb"),
        recommended.alias("recommended_mb"), script.alias("script"))


def memory_findings(hosts: DataFrame, schedulers: DataFrame) -> DataFrame:
    """Findings on the upper and lower memory limit; first rule that fits."""
    rows = hosts.join(numa_nodes(schedulers), "server_name", "left").withColumn(
        "system_mb", numbers.int_div(F.col("total_physical_memory_kb"), 1024))
    upper, lower, system = F.col("max_server_memory_mb"), F.col("min_server_memory_mb"), F.col("system_mb")
    nodes, affined = F.col("numa_nodes"), F.col("numa_nodes_affined")

    def share(c: Column) -> Column:
        return numbers.int_div(c, nodes) * affined

    maker = F.lower("system_manufacturer")
    max_rule = (
        F.when(upper == codes.UNSET_MAX_MEMORY, "[WARNING: MaxMem setting is default. Please revise memory settings]")
        .when(upper > system, "[WARNING: MaxMem setting exceeds available system memory]")
        .when(F.col("edition_id").isin(*codes.WEB_BI_EDITIONS) & (upper > 67108864),
              "[WARNING: MaxMem setting exceeds Web and Business Intelligence Edition limits]")
        .when((F.col("edition_id") == codes.STANDARD_EDITION) & (upper > 134217728),
              "[WARNING: MaxMem setting exceeds Standard Edition limits]")
        .when((F.col("engine_edition") == codes.EXPRESS_ENGINE) & (upper > 1443840),
              "[WARNING: MaxMem setting exceeds Express Edition limits]")
        .when((nodes > 1) & (share(upper) > share(system)), F.concat(
            F.lit("[WARNING: Current MaxMem setting will leverage node foreign memory. \n"
                  "Maximum value for MaxMem setting on this configuration is "),
            share(system).cast("string"), F.lit(" for a single instance]")))
        .otherwise("[OK]"))
    min_rule = (
        F.when((lower == 0) & maker.isin("microsoft", "vmware"),
               "[WARNING: Min Server Mem setting is not set in a VM, allowing memory pressure on the Host to "
               "attempt to deallocate memory on a guest SQL Server]")
        .when((lower == 0) & F.col("is_clustered"),
              "[INFORMATION: Min Server Mem setting is default in a clustered instance. Leverage Min Server Mem "
              "for the purpose of limiting memory concurrency between instances]")
        .when(lower == upper, "[WARNING: Min Server Mem setting is equal to Max Server Mem. This will not allow "
                              "dynamic memory. Please revise memory settings]")
        .when((nodes > 1) & (share(lower) > share(system)),
              "[WARNING: Current MinMem setting will leverage node foreign memory]")
        .otherwise("[OK]"))
    checks = F.array(
        F.struct(F.lit("Memory_issues_MaxServerMem").alias("check"), max_rule.alias("deviation"), upper.alias("setting_mb")),
        F.struct(F.lit("Memory_issues_MinServerMem").alias("check"), min_rule.alias("deviation"), lower.alias("setting_mb")))
    return rows.select("server_name", F.lit("Memory_checks").alias("category"), F.explode(checks).alias("c")).select(
        "server_name", "category", "c.check", "c.deviation", "c.setting_mb")
