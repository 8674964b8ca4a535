"""Row validation: every message for a row is collected, nothing is raised."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (AGE_VALID_MAX, AGE_VALID_MIN, JPEG_MAGIC_HEX, MSG_AGE, MSG_AGE_VALUE, MSG_FILE_TYPE,
                         MSG_FORMAT, MSG_GENDER, MSG_NAME_REQUIRED, MSG_UNREADABLE, MSG_VIEW, PNG_MAGIC_HEX)
from ..functions.features import INT_TEXT
from ..functions.text import allowed_file


def _lit(text: str) -> str:
    """A Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _msg(template: str, value_sql: str) -> str:
    before, after = template.split("{}")
    return f"concat({_lit(before)}, coalesce(CAST({value_sql} AS STRING), 'None'), {_lit(after)})"


def image_format_sql(content: str) -> str:
    """PNG / JPEG by file signature; a few other known formats by name; NULL
    when the bytes are not a recognisable image."""
    return (f"CASE WHEN substring({content}, 1, 8) = unhex('{PNG_MAGIC_HEX}') THEN 'PNG' "
            f"WHEN substring({content}, 1, 3) = unhex('{JPEG_MAGIC_HEX}') THEN 'JPEG' "
            f"WHEN substring({content}, 1, 4) = unhex('47494638') THEN 'GIF' "
            f"WHEN substring({content}, 1, 2) = unhex('424D') THEN 'BMP' END")


def validation_errors_sql(age: str, gender: str, view: str, content: str | None = None) -> str:
    """SQL for array<string> of all problems of a row (empty when valid)."""
    age_i = f"try_cast(CAST({age} AS STRING) AS INT)"
    checks = [
        f"CASE WHEN {age_i} IS NULL OR {age_i} < {AGE_VALID_MIN} OR {age_i} > {AGE_VALID_MAX} "
        f"THEN {_msg(MSG_AGE, age)} END",
        f"CASE WHEN NOT coalesce(upper({gender}) IN ('M', 'F'), false) THEN {_msg(MSG_GENDER, gender)} END",
        f"CASE WHEN NOT coalesce(upper({view}) IN ('AP', 'PA'), false) THEN {_msg(MSG_VIEW, view)} END",
    ]
    if content is not None:
        fmt = image_format_sql(content)
        checks.append(f"CASE WHEN ({fmt}) IS NULL THEN {_msg(MSG_UNREADABLE, _lit('cannot identify image file'))} "
                      f"WHEN ({fmt}) NOT IN ('PNG', 'JPEG') THEN {_msg(MSG_FORMAT, fmt)} END")
    return f"filter(array({', '.join(checks)}), x -> x IS NOT NULL)"


def validate(df: DataFrame, age: str = "age", gender: str = "gender", view: str = "view",
             content: str | None = "content") -> DataFrame:
    """Adds ``errors`` (array<string>, every message of the row) and ``valid``."""
    q = lambda c: f"`{c}`"
    errs = validation_errors_sql(q(age), q(gender), q(view), q(content) if content else None)
    return df.selectExpr("*", f"{errs} AS errors").withColumn("valid", F.expr("size(errors) = 0"))


def form_error(file_name: Column, name: Column, age_text: Column) -> Column:
    """First failing upload-form check: file type, then a non-blank patient
    name, then an integer age (an absent age defaults; a blank one is an error)."""
    bad_age = age_text.isNotNull() & ~age_text.rlike(INT_TEXT)
    return (F.when(~F.coalesce(allowed_file(file_name), F.lit(False)), F.lit(MSG_FILE_TYPE))
             .when(F.coalesce(F.trim(name), F.lit("")) == "", F.lit(MSG_NAME_REQUIRED))
             .when(bad_age, F.lit(MSG_AGE_VALUE)))


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows) of a validated frame."""
    return df.where(F.col("valid")), df.where(~F.col("valid"))


def contract_problems(df: DataFrame, required: dict[str, str]) -> dict[str, str]:
    """Columns that are missing, or of another type than the one named."""
    types = {f.name.lower(): f.dataType.simpleString() for f in df.schema.fields}
    found = {c: types.get(c.lower()) for c in required}
    return {c: "missing" if found[c] is None else f"{found[c]} instead of {t}" for c, t in required.items()
            if found[c] is None or t and found[c] != t}


def require_columns(df: DataFrame, required: dict[str, str]) -> None:
    """Plan-time input contract: columns exist with the given type names."""
    problems = contract_problems(df, required)
    if problems:
        raise ValueError(f"input contract: {problems} (expected {required})")
