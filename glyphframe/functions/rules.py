"""Ordered rules over records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import MOST_WIDTH, natural_width

# Limits and formats of uploads.
MOST_BYTES, MOST_PIXELS, MOST_SIDE, LEAST_SIDE = 20 * 1024 * 1024, 40_000_000, 12_000, 2
FORMAT_OF_EXTENSION = {"png": "PNG", "jpg": "JPEG", "jpeg": "JPEG", "tif": "TIFF", "tiff": "TIFF", "webp": "WEBP"}
FORMAT_OF_CONTENT = {"PNG": "PNG", "JPEG": "JPEG", "MPO": "JPEG", "TIFF": "TIFF", "WEBP": "WEBP"}
SHAREABLE = ("public_domain", "open_license")
DISPOSITIONS = (
    "scored", "ineligible_not_usable", "ineligible_non_tamil", "ineligible_unreadable", "ineligible_ambiguous",
    "ineligible_unit_dispute", "excluded_invalid_geometry", "excluded_crop_refused", "excluded_too_small",
    "scored_empty_prediction", "scored_non_encodable",
)
SCORED = ("scored", "scored_empty_prediction", "scored_non_encodable")
TOO_SMALL = "crop too small"


def first_of(rules: list[tuple[Column, str]], otherwise: str) -> Column:
    """The name of the first rule that holds; a null condition does not."""
    return reduce(lambda c, r: c.when(r[0], r[1]), rules[1:], F.when(*rules[0])).otherwise(otherwise)


def sniff_ext(content: Column, hint: Column) -> Column:
    """The hint's extension if it is an image's; else by the first bytes; else png."""
    named = F.lower(F.when(hint.contains("."), F.substring_index(hint, ".", -1)))
    start = lambda n: F.hex(F.substring(content, 1, n))
    return (
        F.when(named.isin("png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp"), named)
        .when(start(8) == "89504E470D0A1A0A", "png").when(start(3) == "FFD8FF", "jpg")
        .when(start(4).isin("49492A00", "4D4D002A"), "tif").otherwise("png")
    )


def upload_verdict() -> Column:
    """The first broken rule of an upload, in a fixed order, or "ok" (P17).

    Over metadata columns: name, size_bytes, head (first bytes), content_format, width, height, frames, mode.
    """
    ext = F.lower(F.when(F.col("name").rlike(r"[^./\\]\.[^./\\]*$"), F.substring_index("name", ".", -1)).otherwise(""))
    mapped = lambda m, c: F.element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), c)
    found = mapped(FORMAT_OF_CONTENT, F.upper("content_format"))
    side = F.greatest("width", "height")
    return first_of(
        [
            (F.coalesce(F.col("size_bytes"), F.lit(0)) == 0, "empty file"),
            (F.col("size_bytes") > MOST_BYTES, "file too large"),
            ((F.hex(F.substring("head", 1, 5)) == "255044462D") | (ext == "pdf"), "pdf"),
            (~ext.isin(*FORMAT_OF_EXTENSION), "unsupported extension"),
            (F.col("content_format").isNull(), "unreadable"),
            (found.isNull(), "unsupported content"),
            (found != mapped(FORMAT_OF_EXTENSION, ext), "extension does not match"),
            ((F.col("width") * F.col("height") > MOST_PIXELS) | (side > MOST_SIDE), "image too large"),
            (F.least("width", "height") < LEAST_SIDE, "image too small"),
            (F.col("frames") > 1, "several images"),
            (F.col("mode") == "1", "one bit"),
            (F.col("mode").rlike("^[IF]"), "more than 8 bits"),
        ],
        "ok",
    )


def wide_tall_notes() -> Column:
    """Notes on a usable upload: squeezed, taller than wide."""
    return F.array_compact(
        F.array(F.when(natural_width(F.col("height"), F.col("width")) > MOST_WIDTH, "wide"), F.when(F.col("height") > F.col("width"), "tall"))
    )


def status_of(ok: Column, text: Column) -> Column:
    """failed, empty or ok."""
    return F.when(~F.coalesce(ok, F.lit(False)), "failed").when(F.coalesce(text, F.lit("")) == "", "empty").otherwise("ok")


def shareable(status: Column, allowed: tuple[str, ...] = SHAREABLE) -> Column:
    """True for a listed status only; unknown and missing ones are not."""
    return F.coalesce(status.isin(*allowed), F.lit(False))


def eligibility() -> Column:
    """Why a verified record is outside the primary set, or null.

    Over usable, final_state, script and not_usable_because.
    """
    usable = F.coalesce(F.col("usable"), F.lit(False))
    return (
        F.when(~usable & (F.col("final_state") == "UNREADABLE"), "ineligible_unreadable")
        .when(~usable & (F.col("final_state") == "AMBIGUOUS"), "ineligible_ambiguous")
        .when(~usable & F.coalesce(F.col("not_usable_because"), F.lit("")).startswith("unit correction"), "ineligible_unit_dispute")
        .when(~usable, "ineligible_not_usable")
        .when(F.coalesce(F.col("script"), F.lit("")) != "tamil", "ineligible_non_tamil")
    )


def disposition(width: str = "width", height: str = "height") -> Column:
    """One of the closed list for each verified record and its result row (scored, reason, hyp).

    A primary record without a result row (``scored`` null) has a null disposition, which ``ledger`` refuses.
    """
    x1, y1, x2, y2 = (F.col(c) for c in ("x1", "y1", "x2", "y2"))
    off = F.coalesce((x2 <= 0) | (y2 <= 0) | (x1 >= F.col(width)) | (y1 >= F.col(height)), F.lit(False))
    unscored = F.when((x2 <= x1) | (y2 <= y1) | off, "excluded_invalid_geometry").when(F.col("reason") == TOO_SMALL, "excluded_too_small").otherwise("excluded_crop_refused")
    return F.coalesce(
        eligibility(),
        F.when(~F.col("scored"), unscored).when(
            F.col("scored"),
            F.when(F.col("encoding_status") == "non_encodable", "scored_non_encodable")
            .when(F.col("hyp") == "", "scored_empty_prediction").otherwise("scored"),
        ),
    )


#: Label of a primary group -> its value's column.
PRIMARY_GROUPS = {
    "primary|part": "queue_part", "page": "page_id", "region_type": "region_type", "final_state": "final_state", "legibility": "legibility",
    "unit": "word_unit_type", "source": "source_id",
}


def groups_of(columns: list[str]) -> Column:
    """The groups that a record's score counts in (P20): none unless usable; primary ones for Tamil script only.

    ``columns``: those that the table has; a group whose column is missing or null is left out.
    """
    usable = F.coalesce(F.col("usable"), F.lit(False))
    primary = usable & (F.coalesce(F.col("script"), F.lit("")) == "tamil")
    own = [F.when(usable, "all_usable"), F.when(usable, F.concat(F.lit("script:"), F.coalesce("script", F.lit("None")))), F.when(primary, "primary")]
    own += [F.when(primary & F.col(c).isNotNull(), F.concat(F.lit(f"{k}:"), F.col(c).cast("string"))) for k, c in PRIMARY_GROUPS.items() if c in columns]
    if "encoding_status" in columns:
        own.append(F.when(primary, F.concat(F.lit("encodable:"), F.coalesce(F.col("encoding_status") == "encodable", F.lit(False)).cast("string"))))
    found = F.array_compact(F.array(*own))
    if "page_condition_tags" not in columns:
        return found
    tags = F.filter(F.split(F.coalesce("page_condition_tags", F.lit("")), r"\s+"), lambda t: t != "")
    return F.concat(found, F.when(primary, F.transform(tags, lambda t: F.concat(F.lit("condition:"), t))).otherwise(F.array().cast("array<string>")))
