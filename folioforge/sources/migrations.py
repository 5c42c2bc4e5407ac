"""Tables of older versions as the newest expects them: columns that came later get what they stand for, nothing is rewritten."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import layout
from ..operators.transitions import AID, BODY

VERSION = 9
#: For each version the columns that came with it, by table: type and what rows from before get.
ADDED = {
    1: {
        "pages": {"crop_left": ("double", 0.0), "crop_top": ("double", 0.0), "crop_right": ("double", 1.0), "crop_bottom": ("double", 1.0), "display_profile": ("string", "ReflowVertical"), "page_role": ("string", "Body"), "printed_page_number": ("string", None), "proofreading_status": ("string", "NotOcrProcessed"), "review_item_count": ("int", 0)},
        "ocr_words": {"coordinate_status": ("string", "Known")},
    },
    2: {
        "pages": {"ocr_status": ("string", "NotProcessed"), "last_ocr_run_id": ("string", None)}, "page_text_versions": {"baseline_ocr_run_id": ("string", None)},
        "proofreading_export_pages": {"source_hash": ("string", ""), "baseline_text_hash": ("string", ""), "text_source": ("string", "RawPaddle"), "crop_left": ("double", 0.0), "crop_top": ("double", 0.0), "crop_right": ("double", 1.0), "crop_bottom": ("double", 1.0), "rotation_degrees": ("int", 0), "page_role": ("string", "Body"), "display_profile": ("string", "ReflowVertical"), "sort_order": ("int", 0), "ocr_run_id": ("string", None)},
    },
    5: {"ocr_run_words": {"manual_override": ("boolean", False)}},
    6: {"pages": {"boundary_join_type": ("string", "DirectJoin")}},
}


def filled(df: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """df with the columns it lacks; those it has are left alone."""
    return df.withColumns({c: F.lit(value).cast(kind) for c, (kind, value) in columns.items() if c not in df.columns})


def migrated(tables: dict[str, DataFrame], version: int) -> dict[str, DataFrame]:
    """tables of a version as of VERSION; run again on what it gave, it changes nothing.

    From version 4 on review items are rows of their own: pages that only have a count of them get one that says so.  The roles
    that recognition gave words are found anew for runs that lack them.
    """
    if version > VERSION:
        raise ValueError(f"version {version} is newer than {VERSION}")
    out = dict(tables)
    for step in range(version + 1, VERSION + 1):
        for name, columns in ADDED.get(step, {}).items():
            if name in out:
                out[name] = filled(out[name], columns)
        if step == 4 and {"pages", "review_items"} <= out.keys():
            counted = out["pages"].where("review_item_count > 0").select(F.col("id").alias("page_id")).join(out["review_items"].select("page_id"), "page_id", "left_anti")
            out["review_items"] = out["review_items"].unionByName(counted.select("page_id", F.lit("LegacyReviewCount").alias("code"), F.lit("Migration").alias("source"), F.lit(None).cast("string").alias("text")), allowMissingColumns=True)
    if "ocr_run_words" in out and "automatic_role" not in out["ocr_run_words"].columns:
        out["ocr_run_words"] = with_roles(out["ocr_run_words"])
    return out


def with_roles(words: DataFrame, run: str = "run_id", ordinal: str = "ordinal") -> DataFrame:
    """words of runs with automatic_role: thin boxes beside wider ones are aids, unless a word of the same value is none."""
    boxes = words.withColumn("id", F.col(ordinal).cast("long"))
    kept = layout.thin_boxes(boxes, run)
    value = [run, "text", "confidence", "left", "top", "right", "bottom"]
    body = kept.select(*(F.col(c).alias(f"_{c}") for c in value)).distinct()
    same = F.lit(True)
    for c in value:
        same = same & (F.col(c) == F.col(f"_{c}") if c == run else F.col(c).eqNullSafe(F.col(f"_{c}")))
    both = words.drop("automatic_role").join(body, same, "left")
    return both.withColumn("automatic_role", F.when(F.col(f"_{run}").isNull(), AID).otherwise(BODY)).drop(*(f"_{c}" for c in value))
