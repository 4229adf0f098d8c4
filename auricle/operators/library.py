"""The library of clients, projects, checks and to-dos: statistics, order, history, edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auricle.functions import shared
from auricle.functions.measures import finite


def client_stats(clients: DataFrame, projects: DataFrame, entries: DataFrame) -> DataFrame:
    """Projects, checks, last activity and last check (the last appended, not the latest) of each client; clients without any have 0 and NULL.

    Entries are summed by project before they meet the clients, so a large client shuffles one row per project."""
    per = entries.groupBy("project_id").agg(F.count("*").alias("checks"), F.max("timestamp").alias("last_activity"), F.max_by("timestamp", "ord").alias("last_checked"), F.max("ord").alias("ord"))
    own = projects.select("client_id", "project_id").join(per, "project_id", "left")
    sums = own.groupBy("client_id").agg(F.count("*").alias("projects"), F.coalesce(F.sum("checks"), F.lit(0)).alias("checks"), F.max("last_activity").alias("last_activity"), F.max_by("last_checked", "ord").alias("last_checked"))
    out = clients.join(sums, "client_id", "left")
    return out.withColumns({"projects": F.coalesce("projects", F.lit(0).cast("long")), "checks": F.coalesce("checks", F.lit(0).cast("long"))})


def history(clients: DataFrame, projects: DataFrame, entries: DataFrame) -> DataFrame:
    """Every check with its client and project."""
    return entries.join(projects, "project_id").join(clients, "client_id")


def sort_key(value: Column) -> Column:
    """What a batch is sorted by: numbers that are not finite count as unknown."""
    return finite(value)


def positions(df: DataFrame, value: str, check_ord: str, descending: bool, group: list[str] | None = None) -> DataFrame:
    """Adds pos (from 1): sorted by the value, unknown last in both directions, ties in the order of checking."""
    key = sort_key(F.col(value))
    if not group:
        return ranked(df, [key.desc_nulls_last() if descending else key.asc_nulls_last(), F.col(check_ord).asc()])
    w = Window.partitionBy(*group).orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), F.col(check_ord))
    return df.withColumn("pos", F.row_number().over(w).cast("long"))


def ranked(df: DataFrame, order: list[Column], name: str = "pos") -> DataFrame:
    """Adds a place (from 1) in one order of all rows: sorted by ranges, each task numbers its own, and the few tasks' counts are added up."""
    placed = shared.stored(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    task, own = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    before = placed.groupBy(task.alias("__task")).agg(F.count("*").alias("__n"))
    # a row for each task of the sort
    before = before.select("__task", (F.sum("__n").over(Window.orderBy("__task")) - F.col("__n")).alias("__before"))
    out = placed.withColumn("__task", task).join(F.broadcast(before), "__task")
    return out.select(*df.columns, (own + F.col("__before") + 1).cast("long").alias(name))


def name_key(name: Column) -> Column:
    return F.lower(F.trim(name))


def duplicates(df: DataFrame, name: str) -> DataFrame:
    """Rows whose name another row has too, apart from case and outer blanks."""
    repeated = df.groupBy(name_key(F.col(name)).alias("__name")).agg(F.count("*").alias("n")).where("n > 1")
    return df.join(repeated, name_key(F.col(name)) == F.col("__name"), "left_semi")


def valid_name(name: Column) -> Column:
    return F.coalesce((F.char_length(F.trim(name)) > 0) & (F.char_length(F.trim(name)) <= 200), F.lit(False))


def append(entries: DataFrame, new: DataFrame) -> DataFrame:
    """The log with new entries behind the old ones of their project."""
    last = entries.groupBy("project_id").agg(F.max("ord").alias("last"))
    nth = F.row_number().over(Window.partitionBy("project_id").orderBy("timestamp", "entry_id"))
    placed = new.join(last, "project_id", "left").withColumn("ord", F.coalesce("last", F.lit(0)) + nth).drop("last")
    return entries.unionByName(placed.select(entries.columns))


def latest(entries: DataFrame, n: int) -> DataFrame:
    """The n entries of each project that were appended last, newest first."""
    w = Window.partitionBy("project_id").orderBy(F.desc("ord"))
    return entries.withColumn("nth", F.row_number().over(w).cast("long")).where(F.col("nth") <= n)


def rename(clients: DataFrame, id_: str, name: str, at: str) -> DataFrame:
    """A client's new name; unknown ids and names that are taken or not valid change nothing."""
    taken = clients.where((name_key(F.col("name")) == name_key(F.lit(name))) & (F.col("client_id") != id_)).agg(F.count("*").alias("taken"))
    change = (F.col("client_id") == id_) & (F.col("taken") == 0) & valid_name(F.lit(name))
    out = clients.crossJoin(F.broadcast(taken))  # one row
    return out.withColumns({"name": F.when(change, F.trim(F.lit(name))).otherwise(F.col("name")), "updated_at": F.when(change, F.lit(at)).otherwise(F.col("updated_at"))}).drop("taken")


def delete_client(clients: DataFrame, projects: DataFrame, entries: DataFrame, id_: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without a client, its projects and their entries."""
    gone = projects.where(F.col("client_id") == id_).select("project_id")
    return clients.where(F.col("client_id") != id_), projects.where(F.col("client_id") != id_), entries.join(gone, "project_id", "left_anti")


def add_client(clients: DataFrame, id_: str, name: str, at: str) -> DataFrame:
    """The clients with one more; a name that is taken (apart from case and outer blanks) or not valid adds nothing."""
    spark = clients.sparkSession
    new = spark.range(1).select(F.lit(id_).alias("client_id"), F.trim(F.lit(name)).alias("name"), F.lit(at).alias("updated_at"), valid_name(F.lit(name)).alias("ok")).where("ok").drop("ok")
    taken = clients.select(name_key(F.col("name")).alias("key"))
    new = new.join(taken, name_key(new["name"]) == taken["key"], "left_anti")
    return clients.unionByName(new, allowMissingColumns=True)


def move_project(clients: DataFrame, projects: DataFrame, project_id: str, client_id: str, at: str) -> tuple[DataFrame, DataFrame]:
    """Clients and projects with a project under another client, if that client exists; both clients are touched."""
    exists = F.broadcast(clients.where(F.col("client_id") == client_id).select(F.lit(project_id).alias("project_id"), F.col("client_id").alias("__to")).limit(1))
    moved = projects.join(exists, "project_id", "left")
    touched = F.broadcast(moved.where("__to IS NOT NULL AND __to <> client_id").select(F.explode(F.array("client_id", "__to")).alias("client_id"), F.lit(at).alias("__at")).distinct())
    out = moved.withColumn("client_id", F.coalesce("__to", "client_id")).select(projects.columns)
    return clients.join(touched, "client_id", "left").withColumn("updated_at", F.coalesce("__at", "updated_at")).select(clients.columns), out


def delete_entries(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """The log without some entries."""
    return entries.join(ids.select("entry_id"), "entry_id", "left_anti")


def toggled(todos: DataFrame, ids: DataFrame, at: str) -> DataFrame:
    """To-dos with those of the ids turned over: an open one is completed at a time, a completed one is open again."""
    hit = ids.select("todo_id", F.lit(True).alias("__hit")).distinct()
    out = todos.join(hit, "todo_id", "left")
    return out.withColumn("completed_at", F.when(F.col("__hit") & F.col("completed_at").isNull(), F.lit(at)).when(F.col("__hit").isNull(), F.col("completed_at"))).select(todos.columns)


def merge_measurements(entries: DataFrame, measured: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Newer measurements in place of the old ones where there are any."""
    new = measured.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    out = entries.join(new, key, "left")
    return out.withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*(f"__{c}" for c in columns))
