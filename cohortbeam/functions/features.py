"""Feature encoders: ages, sex, view position, group keys, feature vectors."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import AGE_CLIP_MAX, AGE_CLIP_MIN, META_COLS, UPLOAD_DEFAULTS

__all__ = [
    "parse_age", "train_age_norm", "serve_age_norm", "train_sex_bin", "serve_sex_bin",
    "parse_view", "serve_view_onehot", "group_key", "feature_vector", "default_features",
    "upload_defaults", "INT_TEXT",
]

# Optional sign and digits, blanks allowed around: what an integer parse accepts.
INT_TEXT = r"^\s*[+-]?[0-9]+\s*$"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_age(c: Column | str) -> Column:
    """Age text such as '058Y' -> 58; every 'Y' removed; non-integers -> NULL."""
    s = F.regexp_replace(_c(c).cast("string"), "Y", "")
    return F.when(s.rlike(INT_TEXT), F.trim(s).try_cast("int"))


def train_age_norm(age: Column | str) -> Column:
    """Training normalisation: age / 100, no clipping."""
    return _c(age).cast("double") / 100.0


def serve_age_norm(age: Column | str) -> Column:
    """Serving normalisation: clip to [0, 100] then / 100."""
    return F.least(F.greatest(_c(age).cast("double"), F.lit(float(AGE_CLIP_MIN))),
                   F.lit(float(AGE_CLIP_MAX))) / 100.0


def train_sex_bin(gender: Column | str) -> Column:
    """Exactly 'M' -> 1, anything else (NULL included) -> 0."""
    return F.when(_c(gender) == "M", 1).otherwise(0)


def serve_sex_bin(gender: Column | str) -> Column:
    """Case-insensitive 'M' -> 1.0 else 0.0."""
    return F.when(F.upper(_c(gender)) == "M", 1.0).otherwise(0.0)


def parse_view(view: Column | str) -> Column:
    """NULL -> UNK; containing AP -> AP; else containing PA -> PA; else UNK."""
    v = _c(view)
    return (F.when(v.isNull(), "UNK").when(v.contains("AP"), "AP")
             .when(v.contains("PA"), "PA").otherwise("UNK"))


def serve_view_onehot(view: Column | str) -> tuple[Column, Column]:
    """Fixed categories: (view_AP, view_PA) from the upper-cased view."""
    v = F.upper(_c(view))
    return (F.when(v == "AP", 1.0).otherwise(0.0), F.when(v == "PA", 1.0).otherwise(0.0))


def group_key(patient_id: Column | str, idx: Column | str) -> Column:
    """Patient id as text, else the image index."""
    return F.coalesce(_c(patient_id).cast("string"), _c(idx).cast("string"))


def feature_vector(cols: list[str] | None = None) -> Column:
    """Feature columns in schema order as array<float> (model input)."""
    return F.array(*[F.col(c) for c in (cols or META_COLS)]).cast("array<float>")


def default_features(df: DataFrame, defaults: dict[str, float] | None = None) -> DataFrame:
    """Fill the serving features: missing columns get the default, NULLs are coalesced."""
    from ..constants import DEFAULT_FEATURES
    defaults = defaults or DEFAULT_FEATURES
    present = {c.lower() for c in df.columns}
    cols = {}
    for name, val in defaults.items():
        lit = F.lit(float(val))
        cols[name] = F.coalesce(F.col(name).cast("double"), lit) if name.lower() in present else lit
    return df.withColumns(cols)


def upload_defaults(df: DataFrame, age: str = "age", gender: str = "gender", view: str = "view") -> DataFrame:
    """Absent (NULL) form fields get defaults; gender/view upper-cased; age text parsed.

    A blank field is not absent: a blank gender or view stays blank and a blank
    or non-integer age gives ``age_ok = false``, so validation rejects the row
    instead of scoring invented values.
    """
    age_txt = F.col(age).cast("string")
    parsed = F.when(age_txt.rlike(INT_TEXT), F.trim(age_txt).try_cast("int"))
    return df.withColumns({
        "age_ok": age_txt.isNull() | parsed.isNotNull(),
        age: F.when(age_txt.isNull(), F.lit(UPLOAD_DEFAULTS["age"])).otherwise(parsed),
        gender: F.upper(F.coalesce(F.col(gender), F.lit(UPLOAD_DEFAULTS["gender"]))),
        view: F.upper(F.coalesce(F.col(view), F.lit(UPLOAD_DEFAULTS["view"]))),
    })
