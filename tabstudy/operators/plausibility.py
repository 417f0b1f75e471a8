"""Clinical units and plausible value ranges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .columns import numeric_names

# Fixed values, to equal known results: variable, canonical unit, unit hypothesis, factor to the
# canonical unit, range tested after conversion.  Order matters for names and for equal scores.
UNIT_HYPOTHESES = [
    ("weight", "kg", "kg", 1.0, 30.0, 200.0),
    ("weight", "kg", "lb", 0.453592, 66.0, 440.0),
    ("height", "cm", "cm", 1.0, 100.0, 220.0),
    ("height", "cm", "inches", 2.54, 39.0, 87.0),
    ("height", "cm", "meters", 100.0, 1.0, 2.2),
    ("waist", "cm", "cm", 1.0, 50.0, 150.0),
    ("waist", "cm", "inches", 2.54, 20.0, 59.0),
    ("glucose", "mg/dL", "mg/dL", 1.0, 70.0, 125.0),
    ("glucose", "mg/dL", "mmol/L", 18.0, 3.9, 6.9),
    ("cholesterol", "mmol/L", "mmol/L", 1.0, 2.0, 10.0),
    ("cholesterol", "mmol/L", "mg/dL", 0.0259, 80.0, 400.0),
    ("triglyceride", "mg/dL", "mg/dL", 1.0, 50.0, 499.0),
    ("triglyceride", "mg/dL", "mmol/L", 88.57, 0.57, 5.64),
    ("bp_sys", "mmHg", "mmHg", 1.0, 80.0, 200.0),
    ("bp_di", "mmHg", "mmHg", 1.0, 40.0, 120.0),
    ("bmi", "kg/m²", "kg/m²", 1.0, 15.0, 50.0),
    ("hba1c", "%", "%", 1.0, 4.0, 15.0),
    ("kcal", "kcal", "kcal", 1.0, 500.0, 5000.0),
    ("kcal", "kcal", "kJ", 0.239, 2100.0, 21000.0),
]

# Reference intervals (first and 99th percentile of a population) in canonical units.
REFERENCE_INTERVALS = [
    ("glucose", "mg/dL", 70.0, 200.0),
    ("bmi", "kg/m²", 15.0, 50.0),
    ("hba1c", "%", 4.0, 15.0),
    ("cholesterol", "mmol/L", 2.0, 10.0),
    ("triglyceride", "mg/dL", 50.0, 500.0),
    ("weight", "kg", 35.0, 200.0),
    ("height", "cm", 140.0, 210.0),
    ("waist", "cm", 55.0, 150.0),
    ("bp_sys", "mmHg", 90.0, 200.0),
    ("bp_di", "mmHg", 50.0, 120.0),
    ("kcal", "kcal", 800.0, 4500.0),
]

# Guideline bands by variable and unit; a band holds values in [low, high), or >= low.
THRESHOLD_BANDS = [
    ("glucose", "mg/dL", "normal", 70.0, 99.0),
    ("glucose", "mg/dL", "prediabetes", 100.0, 125.0),
    ("glucose", "mg/dL", "diabetes", 126.0, None),
    ("glucose", "mmol/L", "normal", 3.9, 5.5),
    ("glucose", "mmol/L", "prediabetes", 5.6, 6.9),
    ("glucose", "mmol/L", "diabetes", 7.0, None),
    ("triglyceride", "mg/dL", "normal", 0.0, 149.0),
    ("triglyceride", "mg/dL", "borderline_high", 150.0, 199.0),
    ("triglyceride", "mg/dL", "high", 200.0, 499.0),
    ("triglyceride", "mg/dL", "very_high", 500.0, None),
    ("triglyceride", "mmol/L", "normal", 0.0, 1.68),
    ("triglyceride", "mmol/L", "borderline_high", 1.69, 2.25),
    ("triglyceride", "mmol/L", "high", 2.26, 5.64),
    ("triglyceride", "mmol/L", "very_high", 5.65, None),
]

EXTREME_WIDTHS = 2.0
EXTREME_PENALTY = 0.5
FLAG_RATE = 0.05


def hypotheses_table(spark: SparkSession, rows: Sequence[tuple] = tuple(UNIT_HYPOTHESES)) -> DataFrame:
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)],
        "position int, variable string, canonical_unit string, unit string, factor double, low double, high double")


def intervals_table(spark: SparkSession, rows: Sequence[tuple] = tuple(REFERENCE_INTERVALS)) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                                 "position int, variable string, unit string, p01 double, p99 double")


def match_variables(columns: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(column, variable): the first catalogue entry whose key is part of the column name.

    Both sides are schema-sized: column names against a fixed list of variables.
    """
    keys = catalogue.groupBy("variable").agg(F.min("position").alias("position"))
    hits = columns.select("column").join(F.broadcast(keys), F.lower(F.col("column")).contains(F.col("variable")))
    return hits.groupBy("column").agg(F.min_by("variable", "position").alias("variable"))


def column_list(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.sparkSession.createDataFrame([(c,) for c in (cols or df.columns)], "column string")


def first_match(name: str, variables: Sequence[str]) -> str | None:
    return next((v for v in variables if v in name.lower()), None)


def _rules(cols: Sequence[str], rows: Sequence[tuple]) -> dict[str, list[tuple]]:
    order = list(dict.fromkeys(r[0] for r in rows))
    matched = {c: first_match(c, order) for c in cols}
    return {c: [r for r in rows if r[0] == v] for c, v in matched.items() if v}


def infer_units(df: DataFrame, cols: Sequence[str] | None = None, rows: Sequence[tuple] = tuple(UNIT_HYPOTHESES)) -> DataFrame:
    """(column, variable, unit, canonical_unit, factor, fit, score, confidence): best unit per column.

    Every (column, hypothesis) pair is scored in the same scan by conditional averages.
    """
    rules = _rules(list(cols or numeric_names(df)), rows)
    cells = []
    for c, options in rules.items():
        for i, (variable, canonical, unit, factor, low, high) in enumerate(options):
            v = F.col(c) * F.lit(factor)
            reach = EXTREME_WIDTHS * (high - low)
            fit = F.avg(((v >= low) & (v <= high)).cast("double"))
            extreme = F.avg(((v < low - reach) | (v > high + reach)).cast("double"))
            cells.append(F.struct(
                F.lit(c).alias("column"), F.lit(variable).alias("variable"), F.lit(unit).alias("unit"), F.lit(canonical).alias("canonical_unit"),
                F.lit(factor).alias("factor"), F.lit(i).alias("position"), fit.alias("fit"), (fit - extreme * EXTREME_PENALTY).alias("score")))
    if not cells:
        return df.sparkSession.createDataFrame(
            [], "column string, variable string, unit string, canonical_unit string, factor double, fit double, score double, confidence string")
    scored = df.agg(F.array(*cells).alias("_s")).select(F.inline("_s")).where("score is not null")
    best = scored.withColumn("_r", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("score"), "position"))).where("_r = 1")
    confidence = F.when(F.col("fit") >= 0.9, "high").when(F.col("fit") >= 0.7, "med").otherwise("low")
    return best.select("column", "variable", "unit", "canonical_unit", "factor", "fit", "score", confidence.alias("confidence"))


def conversion_factors(df: DataFrame, cols: Sequence[str] | None = None, overrides: Mapping[str, str] | None = None,
                       rows: Sequence[tuple] = tuple(UNIT_HYPOTHESES)) -> dict[str, float]:
    """{column: factor}; an override names the unit a column is really in."""
    cols = list(cols or numeric_names(df))
    out = {}
    rules = _rules(cols, rows)
    for c, unit in (overrides or {}).items():
        out[c] = next((r[3] for r in rules.get(c, []) if r[2] == unit), 1.0)
    open_ = [c for c in rules if c not in out]
    if open_:
        out.update({r["column"]: r["factor"] for r in infer_units(df, open_, rows).collect()})
    return out


def harmonise(df: DataFrame, factors: Mapping[str, float]) -> DataFrame:
    return df.withColumns({c: F.col(c) * F.lit(float(f)) for c, f in factors.items()})


def plausible_bounds(cols: Sequence[str], intervals: Sequence[tuple] = tuple(REFERENCE_INTERVALS)) -> dict[str, tuple[float, float]]:
    """{column: (low, high)} from the reference catalogue, matched by name."""
    return {c: (rs[0][2], rs[0][3]) for c, rs in _rules(cols, intervals).items()}


def gate(df: DataFrame, limits: Mapping[str, tuple]) -> DataFrame:
    """Values outside their interval become null."""
    def inside(c: str, low, high) -> Column:
        ok = F.lit(True)
        if low is not None:
            ok = ok & (F.col(c) >= F.lit(float(low)))
        if high is not None:
            ok = ok & (F.col(c) <= F.lit(float(high)))
        return F.when(ok, F.col(c))

    return df.withColumns({c: inside(c, *lim) for c, lim in limits.items()})


def plausibility_report(df: DataFrame, cols: Sequence[str] | None = None, overrides: Mapping[str, str] | None = None,
                        intervals: Sequence[tuple] = tuple(REFERENCE_INTERVALS),
                        hypotheses: Sequence[tuple] = tuple(UNIT_HYPOTHESES)) -> DataFrame:
    """(column, variable, low, high, n, min, max, out_of_range, out_rate, flagged) after conversion."""
    cols = list(cols or numeric_names(df))
    factors = conversion_factors(df, cols, overrides, hypotheses)
    rules = {c: r for c, r in _rules(cols, intervals).items() if c in factors}
    if not rules:
        return df.sparkSession.createDataFrame(
            [], "column string, variable string, low double, high double, n bigint, min double, max double, out_of_range bigint, out_rate double, flagged boolean")
    cells = []
    for c, ((variable, _, low, high),) in rules.items():
        v = F.col(c) * F.lit(factors[c])
        cells.append(F.struct(
            F.lit(c).alias("column"), F.lit(variable).alias("variable"), F.lit(low).alias("low"), F.lit(high).alias("high"),
            F.count(c).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"), F.count_if((v < low) | (v > high)).alias("out_of_range")))
    table = df.agg(F.array(*cells).alias("_s")).select(F.inline("_s"))
    rate = F.try_divide(F.col("out_of_range").cast("double"), F.col("n"))
    return table.withColumn("out_rate", rate).withColumn("flagged", F.coalesce(rate > FLAG_RATE, F.lit(False)))


def threshold_bands(df: DataFrame, units: Mapping[str, str], bands: Sequence[tuple] = tuple(THRESHOLD_BANDS)) -> DataFrame:
    """(column, band, n, share) of raw values in the guideline bands of the given unit of each column."""
    rules = _rules(list(units), bands)
    cells = []
    for c, options in rules.items():
        for _, unit, band, low, high in options:
            if unit == units[c]:
                hit = (F.col(c) >= low) if high is None else (F.col(c) >= low) & (F.col(c) < high)
                cells.append(F.struct(F.lit(c).alias("column"), F.lit(band).alias("band"), F.count_if(hit).alias("n"),
                                      F.avg(hit.cast("double")).alias("share")))
    return df.agg(F.array(*cells).alias("_s")).select(F.inline("_s"))
