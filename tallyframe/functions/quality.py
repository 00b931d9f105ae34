"""Quality rules of images and their annotations, judged from measured columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.paths import LABELS, flags

#: Below or above these, a row is reviewed.
VIEW_SHORT_PX, BOX_SHORT_PX = 128, 32
INSIDE_SHARE, CLIPPED_SHARE = 0.5, 0.15
MEAN_QUANTIZER, BYTES_PER_PIXEL = 35, 0.25
#: Labels of the data that no model is asked for.
NOT_ASKED = ("mixed", "empty", "green")

#: The measured columns, by type. One that a table lacks counts as null, and a rule on null does not hold.
MEASURED = {
    "md5": "string", "md5_actual": "string", "decoded": "boolean", "roi_fits": "boolean", "orientation": "int", "view_short": "double", "box_short_median": "double", "annotation_faults": "array<string>",
    "annotation_class_known": "boolean", "annotation_label": "string", "label": "string", "label_orig": "string", "mean_quantizer": "double", "bytes_per_pixel": "double", "blurred": "boolean", "textureless": "boolean",
    "white_balanced": "boolean", "mode": "string", "selected_inside_boxes": "double", "boxes_white_balanced": "boolean", "black_clipped": "double", "white_clipped": "double", "pipeline_error": "string",
}


def judged(df: DataFrame) -> DataFrame:
    """df with flags array<string> and hard_exclude: the names of the rules that hold, in order.

    An image that does not decode, or whose region of interest does not fit, is excluded and only judged by what is known
    before that; all other flags ask for a review. decoded and roi_fits of null count as true.
    """
    m = {c: F.col(c).cast(t) if c in df.columns else F.lit(None).cast(t) for c, t in MEASURED.items()}
    found = df.withColumn("_m", F.struct(*[c.alias(n) for n, c in m.items()]))
    of = lambda n: F.col(f"_m.{n}")
    unread, misfit = ~F.coalesce(of("decoded"), F.lit(True)), ~F.coalesce(of("roi_fits"), F.lit(True))
    told = {
        "low_resolution": of("view_short") < VIEW_SHORT_PX,
        "small_bean_bbox": of("box_short_median") < BOX_SHORT_PX,
        "annotation_class_invalid": ~of("annotation_class_known"),
        "label_annotation_mismatch": F.coalesce(of("annotation_class_known"), F.lit(True)) & (of("annotation_label") != of("label")),
        **{f"non_target_{x}": of("label") == x for x in NOT_ASKED},
        "unknown_label": ~of("label").isin(*LABELS, *NOT_ASKED),
        "ambiguous_maw": F.contains(of("label_orig"), F.lit("Maw")),
        "low_multiscale_detail": of("blurred"),
        "low_texture": of("textureless"),
        "compression_review": (of("mean_quantizer") >= MEAN_QUANTIZER) & (of("bytes_per_pixel") < BYTES_PER_PIXEL),
        "wb_not_applied": ~of("white_balanced"),
        "pipeline_full_fallback": of("mode") == "full",
        "pipeline_background_selection": of("selected_inside_boxes") < INSIDE_SHARE,
        "wb_train_pipeline_mismatch": of("boxes_white_balanced") != of("white_balanced"),
        "black_clipping_review": of("black_clipped") > CLIPPED_SHARE,
        "white_clipping_review": of("white_clipped") > CLIPPED_SHARE,
        "pipeline_diagnostic_error": of("pipeline_error") != "",
    }
    seen = flags(manifest_hash_mismatch=of("md5") != of("md5_actual"), exif_orientation_invalid=~of("orientation").between(1, 8))
    later = F.concat(F.coalesce(of("annotation_faults"), F.array().cast("array<string>")), flags(**told))
    stopped: Column = F.when(unread, F.array(F.lit("decode_failed"))).when(misfit, F.array(F.lit("roi_invalid")))
    return found.withColumns({"flags": F.array_distinct(F.concat(seen, F.coalesce(stopped, later))), "hard_exclude": unread | misfit}).drop("_m")
