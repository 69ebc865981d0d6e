"""Request validation as column expressions.

A whole table of requests is validated at once.  Each row gets the first
failing rule (reference order) as ``error_field`` / ``error_message``; valid
rows have both NULL.  Domain membership is a left join against the distinct
domain values; AQE broadcasts them when their measured size is small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binsight.functions import exprs as X

MIN_DATE = "2000-01-01"
MAX_DAYS_AHEAD = 3650  # ten years of 365 days

# Field labels and message texts shown to users.
FIELD_AREA = "Area"
FIELD_TYPE = "Waste Type"
FIELD_DATE = "Date"
FIELD_FORECAST = "Forecast Date"
MSG_REQUIRED = "{field} is required"
MSG_INVALID_OPTION = "Invalid {field}. Please select a valid option."
MSG_BAD_FORMAT = "Invalid {field} format. Use YYYY-MM-DD."
MSG_BEFORE = "{field} cannot be before "
MSG_AFTER = "{field} cannot be after "


def _msg_required(field: str):
    return F.lit(MSG_REQUIRED.format(field=field))


def validate_requests(requests: DataFrame, valid_areas: DataFrame, valid_types: DataFrame, as_of,
                      area: str = "area", waste_type: str = "waste_type", date: str = "date",
                      min_date: str = MIN_DATE, max_days_ahead: int = MAX_DAYS_AHEAD) -> DataFrame:
    """Required -> sanitize -> membership -> date format -> date bounds.

    ``valid_areas`` / ``valid_types`` are frames with columns ``area`` /
    ``waste_type``; pass ``valid_types=None`` when ``valid_areas`` holds both.  Output: input columns plus ``clean_area``,
    ``clean_waste_type``, ``forecast_date``, ``error_field``, ``error_message``.
    """
    a = F.col(area).cast("string")
    t = F.col(waste_type).cast("string")
    d = F.col(date).cast("string")
    blank = lambda c: c.isNull() | (X.strip(c) == "")
    from binsight.operators.joins import bounded_broadcast, materialize_small
    if valid_types is None:  # one frame holding both domains: one pass over it
        from binsight.operators.joins import domain_tables
        va, na, vt, nt = domain_tables(valid_areas)
    else:
        va, na = materialize_small(valid_areas.select("area").distinct())
        vt, nt = materialize_small(valid_types.select("waste_type").distinct())
    # (area and type lists are re-derived from checkpointed tables: cheap)
    va = bounded_broadcast(va.select(F.col("area").alias("_va")), na)
    vt = bounded_broadcast(vt.select(F.col("waste_type").alias("_vt")), nt)
    df = requests.withColumn("clean_area", X.sanitize(a)).withColumn("clean_waste_type", X.sanitize(t))
    df = (df.join(va, df["clean_area"] == va["_va"], "left")
          .join(vt, df["clean_waste_type"] == vt["_vt"], "left"))
    parsed = X.parse_date_strict(d)
    lo = F.lit(min_date).cast("date")
    hi = F.date_add(F.lit(as_of).cast("date"), max_days_ahead)
    field = (F.when(blank(a), F.lit(FIELD_AREA)).when(blank(t), F.lit(FIELD_TYPE)).when(blank(d), F.lit(FIELD_DATE))
             .when(F.col("_va").isNull(), F.lit(FIELD_AREA)).when(F.col("_vt").isNull(), F.lit(FIELD_TYPE))
             .when(parsed.isNull() | (parsed < lo) | (parsed > hi), F.lit(FIELD_FORECAST)))
    msg = (F.when(blank(a), _msg_required(FIELD_AREA)).when(blank(t), _msg_required(FIELD_TYPE))
           .when(blank(d), _msg_required(FIELD_DATE))
           .when(F.col("_va").isNull(), F.lit(MSG_INVALID_OPTION.format(field=FIELD_AREA.lower())))
           .when(F.col("_vt").isNull(), F.lit(MSG_INVALID_OPTION.format(field=FIELD_TYPE.lower())))
           .when(parsed.isNull(), F.lit(MSG_BAD_FORMAT.format(field=FIELD_FORECAST.lower())))
           .when(parsed < lo, F.concat(F.lit(MSG_BEFORE.format(field=FIELD_FORECAST)), F.date_format(lo, "yyyy-MM-dd")))
           .when(parsed > hi, F.concat(F.lit(MSG_AFTER.format(field=FIELD_FORECAST)), F.date_format(hi, "yyyy-MM-dd"))))
    return (df.withColumn("forecast_date", parsed)
            .withColumn("error_field", field).withColumn("error_message", msg)
            .drop("_va", "_vt"))


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows); valid + rejected = input."""
    ok = F.col("error_field").isNull()
    return validated.filter(ok), validated.filter(~ok)
