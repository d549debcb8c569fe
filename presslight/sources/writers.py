"""Writers of results, rejects, posts and clips (SK)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import merge_by_key
from ..operators.state import split_oem_document
from .versions import VersionedTables

# The columns of the result and reject files, in order.
RESULT_COLUMNS = ["wo_number", "make", "model", "clip_url", "relevance", "sentiment", "published_date", "status"]
REJECT_COLUMNS = ["wo_number", "make", "model", "reason", "url_details"]
POST_COLUMNS = ["post_id", "post_url", "platform", "creator_name", "date", "caption", "impressions"]
# Names of the fields in the clip export.
EXPORT_NAMES = {"wo_number": "work_order", "contact": "byline", "clip_url": "link", "outlet_id": "publication", "relevance": "relevance_score", "sentiment": "sentiment"}


def _csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    df.select(*columns).write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def write_results_csv(df: DataFrame, path: str) -> None:
    """Results under a fixed header; an empty table gives files with the header only."""
    _csv(df, path, RESULT_COLUMNS)


def write_rejects_csv(rejects: DataFrame, path: str) -> None:
    _csv(rejects, path, REJECT_COLUMNS)


def write_posts_csv(posts: DataFrame, path: str) -> None:
    """Posts with dates as yyyy-MM-dd and captions on one line."""
    day = F.coalesce(F.date_format(F.try_to_timestamp("date"), "yyyy-MM-dd"), F.col("date"))
    _csv(posts.withColumns({"date": day, "caption": F.trim(F.regexp_replace("caption", r"\s+", " "))}), path, POST_COLUMNS)


def export_clips_json(clips: DataFrame, path: str) -> None:
    clips.select(*(F.col(a).alias(b) for a, b in EXPORT_NAMES.items())).write.json(path)


def export_filtered(df: DataFrame, path: str, fmt: str) -> None:
    """csv or json."""
    if fmt == "csv":
        _csv(df, path, df.columns)
    elif fmt == "json":
        df.write.json(path)
    else:
        raise ValueError(f"no format {fmt!r}")


def upsert_table(base: DataFrame, updates: DataFrame, k: Sequence[str], path: str) -> DataFrame:
    """Updates merged into a table and written to a new path; readers move to it when it is complete."""
    merge_by_key(base, updates, k).write.parquet(path)
    return base.sparkSession.read.parquet(path)


def upsert_version(tables: VersionedTables, name: str, updates: DataFrame, k: Sequence[str], counters: Sequence[str] = (), epoch: int | None = None) -> int:
    """Updates merged into the newest version of a table, published as the next; an epoch that was delivered before changes nothing."""
    empty = updates.sparkSession.createDataFrame([], updates.schema)
    return tables.publish(lambda old: {name: merge_by_key(old(name) or empty, updates, k, counters)}, epoch)


def save_oem_documents(tables: VersionedTables, documents: DataFrame) -> int:
    """Documents(model_id, make, model, year, positioning_statement, target_audience, key_features_intended, brand_attributes_intended, purchase_drivers_intended) saved as one version.

    The parent row of a model is updated or inserted, its child rows (features, attributes, drivers) are replaced by the document's; other
    models' rows stay. All four tables appear with one manifest, or none does.
    """
    def made(old) -> dict[str, DataFrame]:
        parents = documents.select("model_id", "make", "model", "year", "positioning_statement", "target_audience")
        saved = documents.select("model_id")
        before = old("models")
        out = {"models": parents if before is None else merge_by_key(before, parents, ["model_id"])}
        for name, rows in split_oem_document(documents).items():
            kept = old(name)
            out[name] = rows if kept is None else kept.join(saved, "model_id", "left_anti").unionByName(rows)
        return out

    return tables.publish(made)
