"""Air-quality column functions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazegrid import constants as K


def to_ppb(c: Column, gas: str) -> Column:
    return c / F.lit(K.MOLAR_MASS[gas] / K.MOLAR_VOLUME)


def to_kmh(c: Column) -> Column:
    return c * F.lit(K.MS_TO_KMH)


def truncate_to_table(c: Column, pollutant: str) -> Column:
    """Cut a concentration to the precision of the breakpoint table, which closes its gaps."""
    scale = 10 ** K.TABLE_DECIMALS[pollutant]
    return F.floor(F.round(c * scale, 6)) / F.lit(float(scale))


def epa_aqi(c: Column, pollutant: str, unit: str, truncate: bool = False) -> Column:
    """Piecewise-linear index; null outside every closed band and for a wrong unit."""
    if pollutant not in K.BREAKPOINTS or unit.lower() != K.TABLE_UNIT[pollutant]:
        return F.lit(None).cast("double")
    x = truncate_to_table(c, pollutant) if truncate else c
    out = None
    for c_low, c_high, i_low, i_high in K.BREAKPOINTS[pollutant]:
        value = F.lit((i_high - i_low) / (c_high - c_low)) * (x - F.lit(float(c_low))) + F.lit(float(i_low))
        hit = x.between(F.lit(float(c_low)), F.lit(float(c_high)))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def overall_aqi(sub_indices: Sequence[Column]) -> Column:
    return F.greatest(*sub_indices)


def dominant_pollutant(sub_indices: Mapping[str, Column]) -> Column:
    """Name of the largest sub-index, the first listed on ties."""
    top = overall_aqi(list(sub_indices.values()))
    return F.coalesce(*[F.when(c == top, F.lit(name)) for name, c in sub_indices.items()])


def breakpoint_rows() -> list[tuple]:
    return [
        (p, i, float(lo), float(hi), float(i_lo), float(i_hi))
        for p, bands in K.BREAKPOINTS.items()
        for i, (lo, hi, i_lo, i_hi) in enumerate(bands)
    ]


def breakpoint_table(spark: SparkSession) -> DataFrame:
    """The breakpoints as a table (41 rows, fixed)."""
    return spark.createDataFrame(
        breakpoint_rows(), "pollutant string, band int, c_low double, c_high double, i_low double, i_high double"
    )


def join_breakpoints(df: DataFrame, value: str, pollutant: str) -> DataFrame:
    """Same index by a range join to the fixed 41-row table; every row is kept.

    An equi-join on the pollutant plus the range condition keeps it a hash join.
    """
    bp = breakpoint_table(df.sparkSession)
    keyed = df.withColumn("pollutant", F.lit(pollutant)) if "pollutant" not in df.columns else df
    hit = (keyed["pollutant"] == bp["pollutant"]) & keyed[value].between(bp["c_low"], bp["c_high"])
    aqi = (F.col("i_high") - F.col("i_low")) / (F.col("c_high") - F.col("c_low")) * (
        F.col(value) - F.col("c_low")
    ) + F.col("i_low")
    joined = keyed.join(F.broadcast(bp), hit, "left").withColumn("aqi", aqi)
    return joined.drop(bp["pollutant"], "c_low", "c_high", "i_low", "i_high")


def risk_level_strict(aqi: Column) -> Column:
    """Closed integer bands; values in the gaps, negatives and null are "Hazardous"."""
    out = None
    for lo, hi, label, _ in K.STRICT_BANDS:
        hit = aqi.between(lo, hi)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(K.STRICT_ELSE[0])


def risk_class_strict(aqi: Column) -> Column:
    out = None
    for lo, hi, _, token in K.STRICT_BANDS:
        hit = aqi.between(lo, hi)
        out = F.when(hit, token) if out is None else out.when(hit, token)
    return out.otherwise(K.STRICT_ELSE[1])


def by_upper_bound(x: Column, rows: Sequence[tuple], field: int) -> Column:
    """Label of the first row whose upper bound is not exceeded; null stays null."""
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for row in rows:
        out = out.when(x <= row[0], row[field]) if row[0] is not None else out.otherwise(row[field])
    return out


def risk_band(aqi: Column) -> Column:
    return by_upper_bound(aqi, K.RISK_BANDS, 1)


def risk_advice(aqi: Column) -> Column:
    return by_upper_bound(aqi, K.RISK_BANDS, 2)


def status_band(aqi: Column) -> Column:
    return by_upper_bound(aqi, K.STATUS_BANDS, 1)


def status_text(aqi: Column) -> Column:
    return by_upper_bound(aqi, K.STATUS_BANDS, 2)


def risk_score_level(score: Column) -> Column:
    return by_upper_bound(score, K.RISK_SCORES, 1)


def risk_score_severity(score: Column) -> Column:
    return by_upper_bound(score, K.RISK_SCORES, 3)


def trend_direction(recent: Column, older: Column) -> Column:
    return (
        F.when(recent < older * 0.9, "improving").when(recent > older * 1.1, "worsening").otherwise("stable")
    )


def recommendations_table(spark: SparkSession) -> DataFrame:
    rows, lower = [], None
    for upper, recs in K.RECOMMENDATIONS:
        for i, (title, text) in enumerate(recs, 1):
            rows.append((lower, None if upper is None else float(upper), i, title, text))
        lower = float(upper) if upper is not None else None
    return spark.createDataFrame(rows, "above double, upper double, rec_no int, title string, advice string")


def join_recommendations(df: DataFrame, aqi: str) -> DataFrame:
    """Four recommendations per row, from a fixed 16-row table keyed by the status band."""
    recs = recommendations_table(df.sparkSession).withColumn(
        "_band", F.coalesce(F.col("upper").cast("int"), F.lit(-1))
    )
    band = F.col(aqi)
    code = F.when(band.isNull(), None)
    for upper, _ in K.RECOMMENDATIONS:
        code = code.when(band <= upper, upper) if upper is not None else code.otherwise(-1)
    return df.withColumn("_band", code).join(F.broadcast(recs.drop("above", "upper")), "_band", "inner").drop("_band")
