"""Usage: valid metric points, daily series, dashboard figures, visits, upload selections, client addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkveil.schemas import COUNTERS

SECONDS = "ProcessingSeconds"


def valid_point(name: Column, value: Column) -> Column:
    """A known name and a finite value that is not negative."""
    finite = ~F.isnan(value) & (value < float("inf"))
    return F.coalesce(name.isin(*COUNTERS, SECONDS) & finite & (value >= 0), F.lit(False))


def whole_emissions(points: DataFrame, key: str) -> DataFrame:
    """The points of emissions all of whose points are valid; one bad point rejects its emission."""
    ok = points.groupBy(key).agg(F.bool_and(valid_point(F.col("name"), F.col("value"))).alias("ok")).where("ok").select(key)
    return points.join(ok, key, "left_semi")


def snake(name: str) -> str:
    return "".join("_" + c.lower() if c.isupper() and k else c.lower() for k, c in enumerate(name))


def daily(points: DataFrame, first: str, last: str) -> DataFrame:
    """A row for each day from `first` to `last`: a sum for each counter, seconds and the number of tasks; zero where there
    is nothing. Negative values count as zero and values that are not finite not at all."""
    value = F.greatest(F.lit(0.0), F.col("value"))
    finite = points.where(~F.isnan("value") & (F.abs("value") < float("inf"))).select(F.to_date("ts").alias("date"), "name", value.alias("value"))
    sums = finite.groupBy("date").pivot("name", [*COUNTERS, SECONDS]).agg(F.sum("value").alias("s"), F.count("value").alias("c"))
    days = points.sparkSession.sql(f"SELECT explode(sequence(date'{first}', date'{last}', interval 1 day)) AS date")
    names = [F.coalesce(F.col(f"{n}_s"), F.lit(0.0)).alias(snake(n)) for n in (*COUNTERS, SECONDS)]
    tasks = F.coalesce(F.col(f"{SECONDS}_c"), F.lit(0)).cast("double").alias("tasks_measured")
    return days.join(sums, "date", "left").select(F.date_format("date", "yyyy-MM-dd").alias("date"), *names, tasks)


def totals(days: DataFrame) -> DataFrame:
    """The dashboard's figures over daily rows: sums, page views, and averages that are null where nothing was counted."""
    names = [c for c in days.columns if c != "date"]
    s = days.agg(*[F.sum(c).alias(c) for c in names])
    views = F.col("landing_views") + F.col("app_views") + F.col("self_hosting_views")
    none_if_zero = lambda a, b: F.when(F.col(b) == 0, F.lit(None)).otherwise(F.col(a) / F.col(b))
    return s.select(
        *names,
        views.alias("page_views"),
        none_if_zero("processing_seconds", "tasks_measured").alias("average_seconds"),
        none_if_zero("batch_documents_selected", "batches_selected").alias("average_batch"),
        F.when(views == 0, F.lit(None)).otherwise(F.col("app_views") / views).alias("app_share"),
    )


def visits(views: DataFrame, user: str, ts: str, gap_seconds: int = 1800) -> DataFrame:
    """Views with `new_visit`: none before, or the last one more than the gap ago."""
    mine = Window.partitionBy(user).orderBy(ts, *[c for c in views.columns if c not in (user, ts)])
    before = F.lag(ts).over(mine)
    far = F.unix_micros(F.col(ts)) - F.unix_micros(before) > gap_seconds * 1_000_000
    return views.withColumn("new_visit", before.isNull() | far)


def routed_metrics(actions: DataFrame) -> DataFrame:
    """(name, value) of usage (kind, page, new_visit, documents): a view counts its page and, if new, a visit; a download
    its documents and itself; a batch of more than one itself and its documents."""
    point = lambda n, v: F.struct(F.lit(n).alias("name"), v.cast("double").alias("value"))
    one, docs = F.lit(1), F.col("documents")
    pages = {"landing": "LandingViews", "app": "AppViews", "self_hosting": "SelfHostingViews"}
    none = F.array().cast("array<struct<name:string,value:double>>")
    view = none
    for page, metric in pages.items():
        view = F.when(F.col("page") == page, F.array(point(metric, one))).otherwise(view)
    visit = F.when(F.col("new_visit") & F.col("page").isin(*pages), F.array(point("Visits", one))).otherwise(none)
    out = (
        F.when(F.col("kind") == "view", F.concat(view, visit))
        .when(F.col("kind") == "download", F.array(point("DocumentsDownloaded", docs), point("DownloadsStarted", one)))
        .when((F.col("kind") == "batch") & (docs > 1), F.array(point("BatchesSelected", one), point("BatchDocumentsSelected", docs)))
        .otherwise(none)
    )
    return actions.select(F.explode(out).alias("p")).select("p.name", "p.value")


def batch_rollup(items: DataFrame, key: str) -> DataFrame:
    """Counts of a batch's rows by status and what follows from them."""
    s = F.col("status")
    out = items.groupBy(key).agg(
        F.count("*").alias("total"), F.count_if(s == "ready").alias("ready"), F.count_if(s == "failed").alias("failed"),
        F.count_if(s == "waiting").alias("waiting"), F.bool_or("cleanup_error").alias("cleanup_needed"),
        F.count_if((s == "ready") & (F.col("findings") == 0)).alias("no_redactions"),
    )
    out = out.withColumn("active", F.col("total") - F.col("ready") - F.col("failed") - F.col("waiting")).withColumn("handled", F.col("ready") + F.col("failed"))
    percent = F.floor(F.col("handled") / F.col("total") * 100 + 0.5).cast("int")
    return out.withColumn("percent", percent).withColumn("settled", (F.col("active") == 0) & (F.col("waiting") == 0))


def unique_names(df: DataFrame, batch: str, name: Column, position: str) -> DataFrame:
    """`unique_name`: names of a batch in order; the second of a name ends in -2, and so on."""
    rows = df.withColumn("name", name)
    nth = F.row_number().over(Window.partitionBy(batch, "name").orderBy(position))
    again = F.concat(F.regexp_replace("name", "\\.pdf$", ""), F.lit("-"), nth.cast("string"), F.lit(".pdf"))
    return rows.withColumn("unique_name", F.when(nth == 1, F.col("name")).otherwise(again))


def client_ip(viewer: Column, forwarded: Column, gateway: Column, real: Column, peer: Column) -> Column:
    """The caller's address: a viewer header without its port, the second last forwarded hop, or what else is known."""
    hops = F.transform(F.split(forwarded, ","), lambda h: F.btrim(h))
    hop = F.when(F.size(hops) >= 2, F.get(hops, F.size(hops) - 2))
    return F.coalesce(F.nullif(F.regexp_replace(viewer, ":[^:]*$", ""), F.lit("")), hop, gateway, real, peer)


def minutes_left(seconds: Column) -> Column:
    """Text for the time that is left, in minutes begun."""
    m = F.ceil(F.greatest(F.lit(0), seconds) / 60)
    return F.when(m < 60, F.format_string("%d min", m)).otherwise(F.format_string("%d hr %d min", F.floor(m / 60), m % 60))


def drag_box(x1: Column, y1: Column, x2: Column, y2: Column, least: int = 3) -> Column:
    """The box of a drag from one corner to another, rounded half up; null if under `least` wide or high."""
    half_up = lambda c: F.floor(c + 0.5).cast("int")
    a, b, c, d = half_up(F.least(x1, x2)), half_up(F.least(y1, y2)), half_up(F.greatest(x1, x2)), half_up(F.greatest(y1, y2))
    return F.when((c - a >= least) & (d - b >= least), F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), d.alias("y2")))
