"""What is let in and out: sizes of uploads, closed schemas of detections and answers, rows of a batch, prompts, emitted
metrics, and inputs that are held against their manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.scalars import valid_box
from inkveil.operators.usage import SECONDS, whole_emissions
from inkveil.schemas import CATEGORY_OF_ANSWER

MOST_ITEMS, MOST_TEXT, MOST_CODE, MOST_FINGERPRINT = 100, 200, 80, 32
#: Where a detection may come from.
SOURCES = ("model", "regex", "ocr", "user")


def arrived_error(expected: Column, actual: Column, most: int) -> Column:
    """Of an upload that should be there: it is not, or not of the size that was announced, or too large after all."""
    return F.when(actual.isNull(), "upload_missing").when((actual != expected) | (actual > most), "upload_size_mismatch")


def detection_error(d: Column, categories: tuple[str, ...], page_count: Column | None = None) -> Column:
    """`detection_invalid` for a detection that its closed schema does not allow: id, page, category, box, confidence,
    source and fingerprint. A null field, but for the fingerprint, is not allowed."""
    fine = d["id"].isNotNull() & (d["page_index"] >= 0) & d["category"].isin(*categories) & valid_box(d["box"])
    fine = fine & d["confidence"].between(0, 1) & d["source"].isin(*SOURCES) & (F.coalesce(F.length(d["fingerprint"]), F.lit(0)) <= MOST_FINGERPRINT)
    if page_count is not None:
        fine = fine & (d["page_index"] < page_count)
    return F.when(~F.coalesce(fine, F.lit(False)), F.lit("detection_invalid"))


def answer_within_bounds(items: Column) -> Column:
    """Whether a provider's items (array of text, category) keep to the schema that it was given."""
    each = lambda x: (F.length(x["text"]) <= MOST_TEXT) & x["category"].isin(*CATEGORY_OF_ANSWER)
    return F.coalesce((F.size(items) <= MOST_ITEMS) & F.forall(items, lambda x: F.coalesce(each(x), F.lit(False))), F.lit(False))


def stored_code(code: Column) -> Column:
    """An error's code as a job keeps it."""
    return F.left(code, F.lit(MOST_CODE))


def shown(items: DataFrame, choice: str) -> DataFrame:
    """A batch's rows (status, findings): all, those of a status, or the ready ones in which nothing was found."""
    if choice == "all":
        return items
    if choice == "no_redactions":
        return items.where((F.col("status") == "ready") & (F.col("findings") == 0))
    return items.where(F.col("status") == choice)


def prompts(grids: DataFrame, model: str, system: str, user: str, most_tokens: int = 4096) -> DataFrame:
    """(doc_id, page_index, request) of grids (doc_id, page_index, grid): the JSON body that a provider's endpoint is asked
    with. `user` holds one `{page_grid}`. Pages without words are not asked about. The answer's schema goes along."""
    before, _, after = user.partition("{page_grid}")
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    names = F.array(*map(F.lit, sorted(CATEGORY_OF_ANSWER)))
    text = F.struct(F.lit("string").alias("type"), F.lit(MOST_TEXT).alias("maxLength"))
    fields = F.struct(text.alias("text"), F.struct(F.lit("string").alias("type"), names.alias("enum")).alias("category"))
    each = F.struct(F.lit("object").alias("type"), fields.alias("properties"), F.array(F.lit("text"), F.lit("category")).alias("required"), F.lit(False).alias("additionalProperties"))
    items = F.struct(F.lit("array").alias("type"), F.lit(MOST_ITEMS).alias("maxItems"), each.alias("items"))
    schema = F.struct(F.lit("object").alias("type"), F.struct(items.alias("items")).alias("properties"), F.array(F.lit("items")).alias("required"), F.lit(False).alias("additionalProperties"))
    form = F.struct(F.lit("json_schema").alias("type"), F.struct(F.lit("pii_items").alias("name"), schema.alias("schema")).alias("json_schema"))
    asked = F.array(message("system", F.lit(system)), message("user", F.concat(F.lit(before), F.col("grid"), F.lit(after))))
    body = F.struct(F.lit(model).alias("model"), asked.alias("messages"), F.lit(0).alias("temperature"), F.lit(most_tokens).alias("max_tokens"), form.alias("response_format"))
    return grids.where("grid <> ''").select("doc_id", "page_index", F.to_json(body).alias("request"))


def emitted(points: DataFrame, key: str, namespace: str, deployment: str, at: Column, enabled: bool = True) -> DataFrame:
    """(key, line): a log line for each emission of points (key, name, value) all of which are valid, from which a metric
    service reads their values. Nothing is emitted where metrics are not enabled."""
    if not enabled:
        points = points.where(F.lit(False))
    good = whole_emissions(points, key).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("name", "value"))).alias("ps"))
    unit = lambda p: F.when(p["name"] == SECONDS, "Seconds").otherwise("Count")
    metrics = F.transform("ps", lambda p: F.struct(p["name"].alias("Name"), unit(p).alias("Unit")))
    group = F.struct(F.lit(namespace).alias("Namespace"), F.array(F.array(F.lit("Deployment"))).alias("Dimensions"), metrics.alias("Metrics"))
    head = F.to_json(F.struct(at.cast("long").alias("Timestamp"), F.array(group).alias("CloudWatchMetrics")))
    values = F.to_json(F.map_from_entries(F.transform("ps", lambda p: F.struct(p["name"], p["value"]))))
    line = F.concat(F.lit('{"_aws":'), head, F.lit(',"Deployment":"'), F.lit(deployment), F.lit('",'), F.substring(values, 2, 2**31 - 1))
    return good.select(key, line.alias("line"))


def staged_errors(manifest: DataFrame, found: DataFrame, prefix: str) -> DataFrame:
    """(evaluation_id, error_code) of entries (evaluation_id, source_path, size_bytes, content_sha256) held against the files
    that were staged (path, length, content): another key, no file, or another content."""
    have = found.select("path", F.col("length").alias("__length"), F.sha2("content", 256).alias("__sha"))
    key = F.concat(F.lit(f"{prefix}/input/"), F.col("evaluation_id"), F.lit(".pdf"))
    same = (F.col("__length") == F.col("size_bytes")) & (F.col("__sha") == F.col("content_sha256"))
    error = F.when(F.col("source_path") != key, "private_manifest_key_mismatch").when(~F.coalesce(same, F.lit(False)), "private_source_integrity_failed")
    return manifest.join(have, F.col("source_path") == F.col("path"), "left").select("evaluation_id", error.alias("error_code"))
