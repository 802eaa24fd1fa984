"""The life of jobs: latest state, counts, claims, leases, transitions, admission, retention, first completions.

Jobs are few facts each; a job's or a client's own history is folded in its order, which bounds what meets in one task
by that history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkveil.schemas import ACTIVE, EXTENSIONS, IN_FLIGHT, QUEUED, SIGNATURES, TERMINAL, TRANSITIONS


def latest(events: DataFrame, key: str, version: str, *ties: str) -> DataFrame:
    """Each job's event of the highest version (then of the greatest `ties`)."""
    rest = [c for c in events.columns if c not in (key, version, *ties)]
    top = events.groupBy(key).agg(F.max(F.struct(version, *ties, *rest)).alias("r"))
    return top.select(key, "r.*")


def client_counts(jobs: DataFrame, since: Column) -> DataFrame:
    """(client, recent, active, queued): jobs created since, active ones, queued ones."""
    return jobs.groupBy("client").agg(
        F.count_if(F.col("created_at") >= since).alias("recent"),
        F.count_if(F.col("status").isin(*ACTIVE)).alias("active"),
        F.count_if(F.col("status").isin(*QUEUED)).alias("queued"),
    )


def next_job(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status").isin(*QUEUED)).orderBy("created_at", "job_id").limit(1)


def expired(jobs: DataFrame, now: Column, most: int = 100) -> DataFrame:
    """The first `most` jobs past their time, earliest first."""
    return jobs.where((F.col("expires_at") <= now) & (F.col("status") != "expired")).orderBy("expires_at", "job_id").limit(most)


def stale(jobs: DataFrame, now: Column, timeout: int = 1800) -> DataFrame:
    """Jobs in flight whose owner has been silent so long that another may take them: the timeout less a heartbeat."""
    silent = F.unix_timestamp(now) - F.unix_timestamp("updated_at")
    return jobs.where(F.col("status").isin(*IN_FLIGHT) & (silent >= timeout - max(10, timeout // 3)))


def visible(jobs: DataFrame, now: Column) -> DataFrame:
    return jobs.where(~F.col("status").isin(*TERMINAL) & (F.col("expires_at") > now))


def retention(jobs: DataFrame, now: Column, blob_left: Column) -> DataFrame:
    """`action`: keep; delete (past its time); retry (deleted, but a blob is left); expire (deleted and clean); gone."""
    action = (
        F.when(F.col("status") == "expired", "gone")
        .when((F.col("status") == "deleted") & blob_left, "retry")
        .when(F.col("status") == "deleted", "expire")
        .when(F.col("expires_at") <= now, "delete")
        .otherwise("keep")
    )
    return jobs.withColumn("action", action)


def next_status(status: Column, trigger: Column) -> Column:
    """Where a trigger leads; null where the state does not allow it. Deletion is allowed from any but the last."""
    out = F.when((trigger == "delete") & ~status.isin(*TERMINAL), "deleted").when((trigger == "expire") & (status == "deleted"), "expired")
    for name, source, to in TRANSITIONS:
        out = out.when((trigger == name) & (status == source), to)
    return out


def run_machine(triggers: DataFrame, key: str, order: str, start: str = "awaiting_upload") -> DataFrame:
    """(key, status, version, applied, refused) after a job's triggers in order. A refused one changes nothing."""
    steps = triggers.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), "trigger"))).alias("ts"))

    def step(acc: Column, t: Column) -> Column:
        to = next_status(acc["status"], t["trigger"])
        ok = to.isNotNull()
        return F.struct(
            F.coalesce(to, acc["status"]).alias("status"),
            (acc["version"] + F.when(ok, 1).otherwise(0)).alias("version"),
            (acc["refused"] + F.when(ok, 0).otherwise(1)).alias("refused"),
        )

    init = F.struct(F.lit(start).alias("status"), F.lit(1).alias("version"), F.lit(0).alias("refused"))
    end = steps.select(key, F.aggregate("ts", init, step).alias("e"))
    return end.select(key, "e.status", "e.version", (F.col("e.version") - 1).alias("applied"), "e.refused")


def admit(requests: DataFrame, hourly: int = 100, at_once: int = 5, active_seconds: int = 3300, queue: int | None = None) -> DataFrame:
    """(client, request, decision) of requests (client, request, epoch, queued). A refused request is not kept and so
    does not count. `queue` bounds the depth that a request found (its column `queued`)."""
    item = F.struct("epoch", "request", "queued")
    groups = requests.groupBy("client").agg(F.sort_array(F.collect_list(item)).alias("rs"))
    longest = max(3600, active_seconds)

    def step(acc: Column, r: Column) -> Column:
        held = F.filter(acc["held"], lambda t: t >= r["epoch"] - longest)
        recent = F.size(F.filter(held, lambda t: t >= r["epoch"] - 3600))
        active = F.size(F.filter(held, lambda t: t > r["epoch"] - active_seconds))
        said = F.when(recent >= hourly, "hourly_abuse_limit").when(active >= at_once, "active_job_abuse_limit")
        said = (said.when(r["queued"] >= queue, "service_busy") if queue is not None else said).otherwise("admitted")
        kept = F.when(said == "admitted", F.concat(held, F.array(r["epoch"]))).otherwise(held)
        return F.struct(kept.alias("held"), F.concat(acc["out"], F.array(F.struct(r["request"].alias("request"), said.alias("decision")))).alias("out"))

    kinds = dict(requests.dtypes)
    init = F.struct(
        F.array().cast(f"array<{kinds['epoch']}>").alias("held"), F.array().cast(f"array<struct<request:{kinds['request']},decision:string>>").alias("out")
    )
    return groups.select("client", F.explode(F.aggregate("rs", init, step)["out"]).alias("x")).select("client", "x.request", "x.decision")


def first_completions(events: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each job: its first completion."""
    return events.groupBy(key).agg(F.min(order).alias(order), F.count("*").alias("completions"))


def upload_errors(df: DataFrame, most_bytes: int) -> DataFrame:
    """(.., leaf, suffix, error_code) of uploads (filename, content_type, size_bytes)."""
    leaf = F.regexp_extract(F.replace(F.col("filename"), F.lit("\\"), F.lit("/")), "[^/]*$", 0)
    suffix = F.lower(F.regexp_extract(leaf, "(?<=.)\\.[^.]+$", 0))
    expected = F.try_element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), suffix)
    kind = F.lower(F.btrim(F.substring_index("content_type", ";", 1)))
    fits = (kind == expected) | (kind == "application/octet-stream") | (suffix.isin(".jpg", ".jpeg") & (kind == "image/jpg"))
    error = F.when(expected.isNull(), "unsupported_file_type").when(~fits, "content_type_mismatch").when(F.col("size_bytes") > most_bytes, "upload_too_large")
    return df.withColumn("leaf", leaf).withColumn("suffix", suffix).withColumn("error_code", error)


def signature_matches(prefix: Column, suffix: Column) -> Column:
    out = F.lit(False)
    for ext, heads in SIGNATURES.items():
        one = F.lit(False)
        for h in heads:
            one = one | (F.substring(prefix, 1, len(h)) == F.lit(h))
        out = F.when(suffix == ext, one).otherwise(out)
    return out
