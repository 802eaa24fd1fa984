"""Records around a job: gates by status, updates that compare before they set, messages and their jobs, projections that
leave out what must not leave, the guards of samples and checkpoints, run figures, and batch indexes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.scalars import keyed_hash
from inkveil.schemas import FINDING_FIELDS, FORBIDDEN_MARKERS, PRIVATE_COLUMNS, RESPONSE_FIELDS, SIGNATURES, TERMINAL


# ------------------------------------------------------------------ statuses
def task_statuses(task: Column) -> Column:
    """(queued, in_flight) of a task."""
    detect = task == "detect"
    return F.struct(
        F.when(detect, "queued_detection").otherwise("queued_redaction").alias("queued"), F.when(detect, "detecting").otherwise("redacting").alias("in_flight")
    )


def gate(action: Column, status: Column) -> Column:
    """What becomes of an action in a status: `do`, `same` (already under way: the state is handed back), or an error."""
    after_submit = status.isin("queued_detection", "detecting", "review_required", "queued_redaction", "redacting", "complete")
    shown = status.isin("review_required", "queued_redaction", "redacting", "complete")
    submit = F.when(status == "awaiting_upload", "do").when(after_submit, "same").otherwise("job_not_submittable")
    finalize = F.when(status.isin("review_required", "complete"), "do").when(status.isin("queued_redaction", "redacting"), "same").otherwise("job_not_reviewable")
    return (
        F.when(action == "submit", submit)
        .when(action == "finalize", finalize)
        .when(action == "manifest", F.when(shown, "do").otherwise("manifest_not_ready"))
        .when(action == "result", F.when(status == "complete", "do").otherwise("result_not_ready"))
    )


def active_error(status: Column, expected: Column, expires_at: Column, now: Column) -> Column:
    """`job_inactive` unless the job is there, in the expected status, and not past its time."""
    fine = (status == expected) & (expires_at > now)
    return F.when(~F.coalesce(fine, F.lit(False)), F.lit("job_inactive"))


def token_error(token: Column, token_hash: Column, key: bytes) -> Column:
    """An unknown job (no hash) and a wrong token are told apart by nobody."""
    return F.when(~F.coalesce(keyed_hash(token, key) == token_hash, F.lit(False)), F.lit("job_not_found"))


def completion(status: Column) -> Column:
    """How a finished redaction ends by the job's status by then: (outcome, remove_output). A deletion wins, and its raced
    output goes; where another worker has the job, its output stays."""
    gone = status.isNull() | status.isin(*TERMINAL)
    outcome = F.when(status == "redacting", "complete").when(gone, "job_deleted").otherwise("job_state_changed")
    return F.struct(outcome.alias("outcome"), gone.alias("remove_output"))


def compare_and_set(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """(job_id, outcome, status, version) of updates (job_id, allowed, seen, to), one to a job: applied where the job's
    status is among `allowed` (null: any) and its version is still the one `seen`."""
    rows = updates.join(jobs.select("job_id", "status", "version"), "job_id", "left")
    allowed = F.coalesce(F.array_contains("allowed", F.col("status")), F.lit(True))
    outcome = F.when(F.col("status").isNull(), "job_not_found").when(~allowed, "invalid_state").when(F.col("seen") != F.col("version"), "concurrent_update").otherwise("updated")
    done = outcome == "updated"
    return rows.select("job_id", outcome.alias("outcome"), F.when(done, F.col("to")).otherwise(F.col("status")).alias("status"), (F.col("version") + F.when(done, 1).otherwise(0)).alias("version"))


def insert_jobs(jobs: DataFrame, fresh: DataFrame) -> DataFrame:
    """The rows of `fresh` with `conflict`: an id that is there already, or comes more than once."""
    known = jobs.select("job_id").withColumn("__known", F.lit(True))
    times = fresh.groupBy("job_id").agg(F.count("*").alias("__times"))
    rows = fresh.join(known, "job_id", "left").join(times, "job_id")
    return rows.withColumn("conflict", F.col("__known").isNotNull() | (F.col("__times") > 1)).drop("__known", "__times")


def received(messages: DataFrame, jobs: DataFrame, now: Column, timeout: int = 1800) -> DataFrame:
    """What a worker does with each message (job_id, task, attempts): `claim` its job; `release` it while another worker
    holds the job; `acknowledge` it where there is nothing to do; `dead_letter` after three receipts. A job in flight may be
    taken once its owner has been silent for the timeout less a heartbeat (a third of the timeout, ten seconds at least)."""
    s = task_statuses(F.col("task"))
    silent = F.unix_timestamp(now) - F.unix_timestamp("updated_at")
    held = (F.col("status") == s["in_flight"]) & (silent < timeout - max(10, timeout // 3))
    ready = F.col("status").isin(s["queued"], s["in_flight"])
    action = F.when(F.col("attempts") > 3, "dead_letter").when(F.coalesce(held, F.lit(False)), "release").when(F.coalesce(ready, F.lit(False)), "claim").otherwise("acknowledge")
    rows = messages.join(jobs.select("job_id", "status", "updated_at"), "job_id", "left")
    return rows.select(*messages.columns, action.alias("action"), F.when(action == "claim", s["in_flight"]).alias("next_status"))


def restarted(jobs: DataFrame) -> DataFrame:
    """After a single worker's restart every job in flight is queued again."""
    status = F.col("status")
    again = F.when(status == "detecting", "queued_detection").when(status == "redacting", "queued_redaction")
    return jobs.withColumns({"status": F.coalesce(again, status), "version": F.col("version") + F.when(again.isNotNull(), 1).otherwise(0)})


def cleanup(jobs: DataFrame, now: Column, blobs_deleted: Column, most: int = 100) -> DataFrame:
    """(job_id, prefix, status, cleaned) of up to `most` jobs past their time: each becomes deleted, its blobs go, and where
    that went well it becomes expired."""
    due = jobs.where((F.col("expires_at") <= now) & (F.col("status") != "expired")).orderBy("expires_at", "job_id").limit(most)
    return due.select(
        "job_id", F.concat(F.lit("jobs/"), F.col("job_id").cast("string")).alias("prefix"), F.when(blobs_deleted, "expired").otherwise("deleted").alias("status"), blobs_deleted.alias("cleaned")
    )


# ------------------------------------------------------------------ projections
def job_response(jobs: DataFrame) -> DataFrame:
    """What a client sees of a job."""
    return jobs.select(*RESPONSE_FIELDS)


def evaluation_findings(found: DataFrame, *key: str) -> DataFrame:
    """Detections without their ids and values."""
    return found.select(*key, *FINDING_FIELDS)


def without_private(df: DataFrame) -> DataFrame:
    """Without the columns that no log may hold."""
    return df.drop(*PRIVATE_COLUMNS)


# ------------------------------------------------------------------ small values
def group_claims(text: Column) -> Column:
    """The groups of a claim like `[a, "b"]`."""
    bare = F.replace(F.regexp_replace(text, "^[\\[\\]]+|[\\[\\]]+$", ""), F.lit('"'), F.lit(""))
    return F.transform(F.split(bare, ","), lambda g: F.btrim(g))


def owner(claims: Column, issuer: str, client: str, scope: str, group: str) -> Column:
    """Whether claims (iss, client_id, token_use, scope, sub, groups) are an owner's."""
    held = F.array_contains(F.split(claims["scope"], "\\s+"), scope) & F.array_contains(group_claims(claims["groups"]), group)
    fine = (claims["iss"] == issuer) & (claims["client_id"] == client) & (claims["token_use"] == "access") & (F.length(claims["sub"]) > 0)
    return F.coalesce(fine & held, F.lit(False))


def error_code(own: Column) -> Column:
    """A typed error's own code; any other error's is `processing_failed`."""
    return F.coalesce(own, F.lit("processing_failed"))


def next_rotation(rotation: Column) -> Column:
    return (rotation + 90) % 360


def unrotated_point(u: Column, v: Column, rotation: Column) -> Column:
    """Where a point of a page as shown, in shares of its sides, lies on the page before its clockwise turn."""
    x = F.when(rotation == 90, v).when(rotation == 180, 1 - u).when(rotation == 270, 1 - v).otherwise(u)
    y = F.when(rotation == 90, 1 - u).when(rotation == 180, 1 - v).when(rotation == 270, u).otherwise(v)
    return F.struct(x.alias("x"), y.alias("y"))


def progress_percent(done: Column, pages: Column) -> Column:
    """Rounded half up, 100 at most; null without a page count."""
    return F.when(pages > 0, F.least(F.lit(100), F.floor(done / pages * 100 + 0.5).cast("int")))


def pages_per_hour(pages: Column, wall_seconds: Column) -> Column:
    return F.when(wall_seconds == 0, F.lit(0.0)).otherwise(pages / wall_seconds * 3600)


def round_seconds(x: Column) -> Column:
    """To three decimals, half to even."""
    return F.bround(x, 3)


def same_ids(a: Column, b: Column) -> Column:
    """Two arrays of equal length, all ids of the second in the first."""
    return (F.size(a) == F.size(b)) & (F.size(F.array_except(b, a)) == 0)


def page_key(job: Column, page: Column) -> Column:
    return F.format_string("jobs/%s/previews/%04d.jpg", job.cast("string"), page)


def batch_name(position: Column, total: Column) -> Column:
    """`redacted.pdf`, or in a batch `redacted-02-of-10.pdf`."""
    width = F.greatest(F.lit(2), F.length(total.cast("string")))
    pad = lambda n: F.lpad(n.cast("string"), width, F.lit("0"))
    return F.when(total <= 1, F.lit("redacted.pdf")).otherwise(F.concat(F.lit("redacted-"), pad(position), F.lit("-of-"), pad(total), F.lit(".pdf")))


def csv_cell(text: Column) -> Column:
    """Quoted only where it holds a quote, a comma or a line end; a null is an empty cell."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(text.rlike('[",\\n]'), quoted).otherwise(text), F.lit(""))


def csv_line(*cells: Column) -> Column:
    return F.concat_ws(",", *[csv_cell(c.cast("string")) for c in cells])


def valid_prefix(prefix: Column) -> Column:
    """A private folder of an evaluation, without the slashes around it; null if it is none."""
    bare = F.regexp_replace(prefix, "^/+|/+$", "")
    return F.when(bare.rlike("^private-evaluation/[0-9a-f]{32}\\z"), bare)


def safe_path(path: Column) -> Column:
    """A relative path that does not climb."""
    return ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..")


# ------------------------------------------------------------------ evaluation
def sample_error(count: Column, tuning: Column, candidates: Column, readable: Column) -> Column:
    """Why a sample cannot be drawn."""
    few = (candidates < count) | (readable < count)
    return F.when((tuning < 1) | (tuning >= count), "invalid_split").when(few, "not_enough_readable_pdfs")


def allocation_error(total: Column, population: Column) -> Column:
    return F.when(total > population, "sample_larger_than_corpus")


def shard_error(shards: Column, entries: Column) -> Column:
    return F.when((shards < 1) | (shards > entries), "invalid_shard_count")


def checkpoint_error(results: DataFrame, entries: DataFrame, split: str) -> DataFrame:
    """One row (results, error_code): a result of another split, of no entry, or a second one of an entry spoils it."""
    known = entries.select("evaluation_id").withColumn("__known", F.lit(True))
    per = results.groupBy("evaluation_id").agg(F.count("*").alias("n"), F.bool_or(F.col("split") != split).alias("other")).join(known, "evaluation_id", "left")
    bad = F.col("other") | F.col("__known").isNull() | (F.col("n") > 1)
    out = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("results"), F.coalesce(F.bool_or(bad), F.lit(False)).alias("bad"))
    return out.select("results", F.when(F.col("bad"), F.lit("evaluation_checkpoint_invalid")).alias("error_code"))


def run_summary(results: DataFrame, *by: str) -> DataFrame:
    """Documents, pages, passes, failures, residuals and seconds of evaluation results."""
    return results.groupBy(*by).agg(
        F.count("*").alias("documents"), F.sum("page_count").alias("pages"), F.count_if("passed").alias("automatic_passes"), F.count_if(F.col("error_code").isNotNull()).alias("failures"),
        F.sum("residual_deterministic").alias("residual_deterministic"), F.sum("residual_model").alias("residual_model"), round_seconds(F.sum("elapsed_seconds")).alias("elapsed_seconds"),
    )


def paired_pages(original: DataFrame, redacted: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pages, error_code): pages of both readings matched one to one by their index."""
    a, b = (df.select(key, "page_index").withColumn(n, F.lit(1)) for df, n in ((original, "a"), (redacted, "b")))
    both = a.join(b, [key, "page_index"], "full")
    out = both.groupBy(key).agg(F.count("a").alias("pages"), F.bool_or(F.col("a").isNull() | F.col("b").isNull()).alias("odd"))
    return out.select(key, "pages", F.when(F.col("odd"), F.lit("page_count_mismatch")).alias("error_code"))


def manifest_mismatch(manifest: Column, job_id: Column, pages: Column) -> Column:
    same = (manifest["job_id"] == job_id) & (manifest["page_count"] == pages)
    return F.when(~F.coalesce(same, F.lit(False)), F.lit("manifest_document_mismatch"))


def job_figures(pages: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, page_count, pages_completed, finding_count); pages: (key, page_index, done)."""
    p = pages.groupBy(key).agg(F.count("*").alias("page_count"), F.count_if("done").alias("pages_completed"))
    n = found.groupBy(key).agg(F.count("*").alias("finding_count"))
    return p.join(n, key, "left").withColumn("finding_count", F.coalesce("finding_count", F.lit(0)))


# ------------------------------------------------------------------ output and intake
def output_error(content: Column, pages: Column, expected: Column, has_text: Column) -> Column:
    """Why a written file may not be released: no PDF, active content, a wrong number of pages, a text layer."""
    text = F.decode(content, "ISO-8859-1")
    active = F.lit(False)
    for marker in FORBIDDEN_MARKERS:
        active = active | text.contains(marker)
    head = F.substring(content, 1, len(SIGNATURES[".pdf"][0])) == F.lit(SIGNATURES[".pdf"][0])
    wrong = F.when(pages != expected, "output_page_count_mismatch").when(has_text, "output_contains_text_layer")
    return F.when(~F.coalesce(head, F.lit(False)), "output_not_pdf").when(active, "output_contains_active_content").otherwise(wrong)


def intake_error(body: Column, origin: Column, origins: tuple[str, ...], most: int = 128) -> Column:
    """Why a usage event is not taken: its origin, its size, or what it holds beyond its schema."""
    view = F.from_json(body, "page string, new_visit boolean")
    act = F.from_json(body, "action string, documents int")
    keys = F.json_object_keys(body)
    only = lambda *names: F.size(F.array_except(keys, F.array(*map(F.lit, names)))) == 0
    fine_view = only("page", "new_visit") & view["page"].isin("landing", "app", "self_hosting")
    fine_act = only("action", "documents") & act["action"].isin("download", "batch") & (act["documents"] >= 1)
    fine = F.coalesce(fine_view, F.lit(False)) | F.coalesce(fine_act, F.lit(False))
    return (
        F.when(~F.coalesce(origin.isin(*origins), F.lit(False)), "origin_not_allowed").when(F.octet_length(body) > most, "request_too_large").when(~fine, "invalid_usage_event")
    )


def alarms(points: DataFrame, name: str = "name", ts: str = "ts", value: str = "value") -> DataFrame:
    """(alarm, at) of metric points: the oldest message over 1,800 s in two periods of 300 s in a row, any dead letter
    within 300 s, any cleanup error within an hour."""
    from pyspark.sql.window import Window

    period = lambda n, seconds, f: points.where(F.col(name) == n).groupBy((F.floor(F.unix_timestamp(ts) / seconds) * seconds).alias("at")).agg(f(value).alias("v"))
    age = period("OldestMessageAge", 300, F.max).where("v > 1800")
    before = F.lag("at").over(Window.partitionBy(F.floor(F.col("at") / 86400)).orderBy("at"))
    first_of_day = age.select((F.col("at") + 300).alias("at")).withColumn("__before", F.lit(True))
    queue = age.withColumn("b", before).join(first_of_day, "at", "left").where("b = at - 300 or __before").select(F.lit("queue_age").alias("alarm"), "at")
    dead = period("DeadLetters", 300, F.max).where("v > 0").select(F.lit("dead_letters").alias("alarm"), "at")
    errors = period("CleanupErrors", 3600, F.sum).where("v > 0").select(F.lit("cleanup_errors").alias("alarm"), "at")
    return queue.union(dead).union(errors)
