"""Names, folder keys, paths, label lists and display text."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (BAND_HIGH, BAND_MEDIUM, FOLDER_PATTERN, HEATMAP_PREFIX, IMAGE_SUFFIX, NO_LABEL,
                         ORIGINAL_IMAGE, UNKNOWN_DATE, UNKNOWN_DATE_RAW, UNKNOWN_NAME)

__all__ = [
    "sanitize_name", "folder_key", "parse_folder", "basename", "stem",
    "allowed_file", "iso_date_part", "label_list", "percent_text", "risk_band",
    "gender_display", "heatmap_filename", "label_from_filename", "image_role", "bar_line",
]


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def sanitize_name(name: Column | str) -> Column:
    """Letters only, first upper and the rest lower; empty or NULL -> 'Unknown'."""
    letters = F.regexp_replace(_c(name), "[^a-zA-Z]", "")
    return F.coalesce(F.nullif(F.initcap(letters), F.lit("")), F.lit(UNKNOWN_NAME))


def folder_key(name: Column | str, day: Column | str) -> Column:
    """Folder key = sanitized name followed by the day as yyyyMMdd."""
    return F.concat(sanitize_name(name), F.date_format(_c(day), "yyyyMMdd"))


def parse_folder(folder: Column | str) -> dict[str, Column]:
    """Split a folder key into patient_name, date (yyyy-mm-dd text) and date_raw.

    Keys that are not letters + 8 digits keep the whole key as the name,
    'Unknown' as date and '00000000' as raw date.
    """
    f = _c(folder)
    ok = f.rlike(FOLDER_PATTERN)
    raw = F.regexp_extract(f, FOLDER_PATTERN, 2)
    return {
        "patient_name": F.when(ok, F.regexp_extract(f, FOLDER_PATTERN, 1)).otherwise(f),
        "date": F.when(ok, F.concat_ws("-", F.substring(raw, 1, 4), F.substring(raw, 5, 2),
                                       F.substring(raw, 7, 2))).otherwise(F.lit(UNKNOWN_DATE)),
        "date_raw": F.when(ok, raw).otherwise(F.lit(UNKNOWN_DATE_RAW)),
    }


def basename(path: Column | str) -> Column:
    return F.regexp_extract(_c(path), r"([^/]*)$", 1)


def stem(path: Column | str) -> Column:
    """File name before the first dot."""
    return F.substring_index(basename(path), ".", 1)


def allowed_file(name: Column | str, allowed: list[str] | None = None) -> Column:
    from ..constants import ALLOWED_EXTENSIONS
    n = _c(name)
    return n.contains(".") & F.lower(F.substring_index(n, ".", -1)).isin(allowed or ALLOWED_EXTENSIONS)


def iso_date_part(ts_text: Column | str) -> Column:
    """Date part of an ISO timestamp text; missing or empty -> 'N/A'."""
    return F.coalesce(F.nullif(F.split_part(_c(ts_text), F.lit("T"), F.lit(1)), F.lit("")), F.lit("N/A"))


def label_list(flags: dict[str, Column | str], sep: str = "|") -> Column:
    """Names of the set flags joined by ``sep``; none set -> 'No Label'."""
    arr = F.array(*[F.when(_c(c) == 1, F.lit(n)) for n, c in flags.items()])
    joined = F.array_join(F.filter(arr, lambda x: x.isNotNull()), sep)
    return F.when(joined == "", F.lit(NO_LABEL)).otherwise(joined)


def percent_text(prob: Column | str, decimals: int = 1) -> Column:
    """Percent rounded first, then printed with fixed decimals."""
    return F.format_string(f"%.{decimals}f", F.round(_c(prob) * 100.0, decimals))


def risk_band(prob: Column | str) -> Column:
    """Band of the percent after rounding to one decimal."""
    pct = F.round(_c(prob) * 100.0, 1)
    return F.when(pct >= BAND_HIGH, "high").when(pct >= BAND_MEDIUM, "medium").otherwise("low")


def gender_display(g: Column | str) -> Column:
    return F.when(_c(g) == "M", "Male").otherwise("Female")


def heatmap_filename(label: Column | str) -> Column:
    """Label -> heatmap file name (blanks and slashes become underscores)."""
    return F.concat(F.lit(HEATMAP_PREFIX), F.translate(_c(label), " /", "__"), F.lit(IMAGE_SUFFIX))


def label_from_filename(fname: Column | str) -> Column:
    """First heatmap prefix and first image suffix removed."""
    x = F.regexp_replace(_c(fname), r"^(.*?)" + HEATMAP_PREFIX, "$1")
    return F.regexp_replace(x, r"^(.*?)\." + IMAGE_SUFFIX.lstrip("."), "$1")


def image_role(fname: Column | str) -> Column:
    f = _c(fname)
    return (F.when(f == ORIGINAL_IMAGE, "original")
             .when(f.endswith(IMAGE_SUFFIX), "gradcam"))


def bar_line(label: Column | str, prob: Column | str) -> Column:
    """'<label padded to 25> <pct %6.2f>% <bar of int(p*20) blocks>'."""
    p = _c(prob)
    return F.format_string("%-25s %6.2f%% %s", _c(label), F.round(p * 100.0, 2),
                           F.repeat(F.lit("█"), F.floor(p * 20).cast("int")))
