"""Changes to tables as DataFrames in, DataFrames out: upsert, partial update, cascade, paging, decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(table: DataFrame, changes: DataFrame, key: str, seq: str) -> DataFrame:
    """table with changes put in; of several rows of a key the one of the largest seq stays."""
    both = table.unionByName(changes, allowMissingColumns=True)
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq)))
    return both.withColumn("_n", last).where("_n = 1").drop("_n")


def update_filled(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Fields that a change leaves null keep their value."""
    news = changes.select(key, *[F.col(c).alias(f"_{c}") for c in changes.columns if c != key])
    out = table.join(news, key, "left")
    return out.select(*[F.coalesce(f"_{c}", c).alias(c) if c != key and c in changes.columns else F.col(c) for c in table.columns])


def delete_cascade(parent: DataFrame, gone: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """parent and each child (with its foreign key) without the rows of gone."""
    ids = gone.select(F.col(key).alias("_gone")).distinct()
    return parent.join(ids, F.col(key) == F.col("_gone"), "left_anti"), {n: df.join(ids, F.col(fk) == F.col("_gone"), "left_anti") for n, (df, fk) in children.items()}


def replace_children(table: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Rows of the keys that fresh has are replaced as a whole."""
    return table.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def page(df: DataFrame, order: list, skip: int, limit: int) -> DataFrame:
    """Rows skip to skip + limit in an order that must end in a unique key."""
    return df.orderBy(*order).offset(skip).limit(limit)


def owned(df: DataFrame, user, user_col: str = "user_id") -> DataFrame:
    """Rows of one user; every read for a user goes through here. A null user owns nothing."""
    return df.where(F.col(user_col) == F.lit(user))


#: States of a task.
STATES = ("pending", "parsing", "processing", "completed", "failed")


def listing(df: DataFrame, user, status: str | None, order: list, skip: int, limit: int, since: str | None = None, until: str | None = None, user_col: str = "user_id", status_col: str = "status", at_col: str = "created_at", states=STATES) -> DataFrame:
    """A page of a user's rows with total, the number of rows there are. An unknown status, and no date, filter nothing; dates are inclusive."""
    rows = owned(df, user, user_col)
    if status in states:
        rows = rows.where(F.col(status_col) == status)
    if since is not None:
        rows = rows.where(F.col(at_col) >= F.lit(since).cast(df.schema[at_col].dataType))
    if until is not None:
        rows = rows.where(F.col(at_col) <= F.lit(until).cast(df.schema[at_col].dataType))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return page(rows, order, skip, limit).crossJoin(total)  # one row of one number


def newest_first(versions: DataFrame, by: str, version: str = "version_no") -> DataFrame:
    """Versions of each key with place 1 for the newest."""
    return versions.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(version))))


def inserted(rows: DataFrame, key: list[str], id_col: str = "id") -> DataFrame:
    """Rows with an id made from their key, so that a row that is inserted again has the same one."""
    parts = F.to_json(F.struct(*key))
    return rows.select(F.sha2(parts, 256).alias(id_col), "*")


def retried(tasks: DataFrame, asked: DataFrame, key: str = "task_id") -> DataFrame:
    """Tasks after retries: only failed ones start again; accepted tells whether one that was asked for did."""
    wanted = asked.select(key).distinct().withColumn("_asked", F.lit(True))
    out = tasks.join(wanted, key, "left")
    go = F.coalesce(F.col("_asked"), F.lit(False)) & (F.col("status") == "failed")
    changed = {"status": F.when(go, "parsing").otherwise(F.col("status")), "progress": F.when(go, 0).otherwise(F.col("progress")), "error_message": F.when(~go, F.col("error_message"))}
    return out.withColumns({"accepted": F.when(F.col("_asked"), go)} | changed).drop("_asked")


def switched(rules: DataFrame, changes: DataFrame, key: str = "rule_code") -> DataFrame:
    """Rules with enabled as the changes (key, enabled) say."""
    return update_filled(rules, changes.select(key, "enabled"), key)


def owners(risks: DataFrame, sources: dict[str, DataFrame], kind: str = "kind", task: str = "task_id") -> DataFrame:
    """risks with the user of the task that they belong to, looked up in the table of their kind."""
    tasks = None
    for name, df in sources.items():
        one = df.select(F.lit(name).alias(kind), F.col(task), F.col("user_id").alias("owner"))
        tasks = one if tasks is None else tasks.unionByName(one)
    return risks.join(tasks, [kind, task], "left")


def all_owned(asked: DataFrame, owned_ids: DataFrame, by: str, id_col: str) -> DataFrame:
    """For each `by`: how many different ids are asked for, how many of them are there, and whether all are."""
    a = asked.select(by, id_col).distinct()
    have = a.join(owned_ids.select(by, id_col).distinct().withColumn("_h", F.lit(1)), [by, id_col], "left")
    out = have.groupBy(by).agg(F.count(F.lit(1)).alias("n_asked"), F.count("_h").alias("n_owned"))
    return out.withColumn("all_owned", F.col("n_asked") == F.col("n_owned"))


def decide(risks: DataFrame, decisions: DataFrame, key: str = "risk_id") -> DataFrame:
    """Latest decision of each risk: confirmed stamps time and user, ignored its reason; others leave it."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("decided_at"), F.desc("decision_id")))
    d = decisions.where(F.col("status").isin("pending", "confirmed", "ignored")).withColumn("_n", last).where("_n = 1").select(key, F.col("status").alias("_s"), "decided_at", "decided_by", "reason")
    out = risks.join(d, key, "left")
    return out.select(
        *risks.columns, F.coalesce("_s", F.lit("pending")).alias("new_status"),
        F.when(F.col("_s") == "confirmed", F.col("decided_at")).alias("confirmed_at"), F.when(F.col("_s") == "confirmed", F.col("decided_by")).alias("confirmed_by"),
        F.when(F.col("_s") == "ignored", F.col("reason")).alias("ignore_reason"),
    )


def next_version(versions: DataFrame, by: str) -> DataFrame:
    return versions.groupBy(by).agg((F.coalesce(F.max("version_no"), F.lit(0)) + 1).alias("next_version"))


#: Decisions on a candidate.
DECISIONS = ("included", "ignored", "pending")


def decide_ids(candidates: DataFrame, requests: DataFrame, task: str = "task_id", id_col: str = "candidate_id") -> DataFrame:
    """candidates with the decision of the last request that names them. requests: (task, ids, decision, request_id).

    A request of another decision than DECISIONS is refused whole; ids of other tasks change nothing.
    """
    asked = requests.where(F.col("decision").isin(*DECISIONS)).select(task, F.explode("ids").alias(id_col), F.struct("request_id", "decision").alias("r"))
    last = asked.groupBy(task, id_col).agg(F.max("r").alias("r"))
    out = candidates.join(last, [task, id_col], "left")
    return out.withColumn("decision", F.coalesce("r.decision", "decision")).drop("r")
