"""Verdicts on sites and results as one long table: key, validator, status, severity, quality_flag, metric.

A validator is a plain function that gives a verdict column (see `verdict` and `first_of`) from columns of the facts table,
a row a site or result. `validator_table` judges each row by all of them in one pass without a shuffle; own validators are
passed by name beside the built-in ones of `VALIDATORS`. A validator never stops the job: if a column that it needs is not
there its verdict is insufficient_data, and if it cannot be built at all its verdict is error.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .series import K

VERDICT = "struct<status: string, severity: string, quality_flag: string, metric: double>"


def verdict(status: str, severity: str | None = None, flag: str | None = None, metric: Column | None = None) -> Column:
    """One verdict: pass, warning, fail, insufficient_data or error; how severe; a short flag; the number that it rests on."""
    number = F.lit(None) if metric is None else S.finite(metric)
    return F.struct(F.lit(status).alias("status"), F.lit(severity).alias("severity"), F.lit(flag).alias("quality_flag"), number.alias("metric")).cast(VERDICT)


def first_of(*cases: tuple, metric: Column | None = None) -> Column:
    """(condition, status, severity, flag) in order: the first that holds decides, and if none does the verdict is pass."""
    out = None
    for condition, *what in cases:
        case = verdict(*what, metric=metric)
        out = F.when(condition, case) if out is None else out.when(condition, case)
    passed = verdict("pass", metric=metric)
    return passed if out is None else out.otherwise(passed)


def record_length(days: Column) -> Column:
    """Of valued days: under 10 years fails, under 20 warns."""
    unknown = days.isNull() | F.isnan(days.cast("double")) | (days < 0) | (days.cast("double") == F.lit(float("inf")))
    return first_of((unknown, "insufficient_data"), (days < 3650, "fail", "high", "record_too_short"), (days < 7300, "warning", "medium", "record_length_low"), metric=days)


def qualification(n: Column, provisional: Column, other: Column, estimated: Column, coded: Column | None = None) -> Column:
    """Of counts of codes: n, codes that could be read (NULL: unreadable); then provisional, other and estimated ones.

    coded: valued days with an approval code; the metric is the provisional share of them.
    """
    some = F.coalesce(provisional, F.lit(0)) + F.coalesce(other, F.lit(0)) + F.coalesce(estimated, F.lit(0)) > 0
    return first_of(
        (n.isNull() & ~some, "insufficient_data", None, "qualification_codes_unreadable"),
        ((n == 0) & ~some, "insufficient_data", None, "qualification_codes_absent"),
        (provisional > 0, "warning", "medium", "provisional_data"),
        (other > 0, "warning", "medium", "other_qualifiers"),
        (estimated > 0, "warning", "low", "estimated_data"),
        metric=F.try_divide(provisional, coded) if coded is not None else None,
    )


def stationarity(years: Column, p: Column) -> Column:
    """Of a trend test over annual totals: under 5 years none, p under 0.05 warns."""
    return first_of((years.isNull() | (years < 5) | S.finite(p).isNull(), "insufficient_data"), (p < 0.05, "warning", "high", "non_stationary"), metric=p)


def regulated_basin(regulated: Column) -> Column:
    return first_of((regulated.isNull(), "insufficient_data", None, "regulation_unknown"), (regulated, "warning", "high", "regulated_basin"))


def water_balance(ratio: Column, precipitation_usable: Column | None = None) -> Column:
    """Of a runoff ratio: above 1 is suspicious, outside [0.001, 3] or from unusable precipitation no evidence at all."""
    none = S.finite(ratio).isNull() | (ratio < 1e-3) | (ratio > 3)
    if precipitation_usable is not None:
        none = none | ~F.coalesce(precipitation_usable, F.lit(True))
    return first_of((none, "insufficient_data"), ((ratio > 1) & (ratio < 1.1), "warning", "medium"), (ratio > 1, "warning", "high"), metric=ratio)


def alignment(a_start: Column, a_end: Column, b_start: Column, b_end: Column, there: Column | None = None) -> Column:
    """Of two slots' first and last day as text: equal passes, else fails; missing ones warn, invalid or inverted ones are
    insufficient, as is a slot that is not there."""
    texts = (a_start, a_end, b_start, b_end)
    days = [F.try_to_date(c, "yyyy-MM-dd") for c in texts]
    missing, bad = F.lit(False), F.lit(False)
    for text, day in zip(texts, days):
        missing, bad = missing | (F.coalesce(text, F.lit("")) == ""), bad | day.isNull()
    bad = bad | (days[1] < days[0]) | (days[3] < days[2])
    absent = F.lit(False) if there is None else ~F.coalesce(there, F.lit(False))
    return first_of((absent, "insufficient_data"), (missing, "warning", "low"), (bad, "insufficient_data"), ((a_start != b_start) | (a_end != b_end), "fail", "medium"))


def unit_consistency(unit: Column, wanted: Column, there: Column | None = None) -> Column:
    """A slot that is not there is insufficient, an undeclared unit warns, another than the wanted one fails."""
    absent = F.lit(False) if there is None else ~F.coalesce(there, F.lit(False))
    return first_of((absent, "insufficient_data"), (F.coalesce(unit, F.lit("")) == "", "warning", "low"), (~unit.eqNullSafe(wanted), "fail", "high"))


def uncertainty(has: Column, there: Column | None = None) -> Column:
    absent = F.lit(False) if there is None else ~F.coalesce(there, F.lit(False))
    return first_of((absent, "insufficient_data"), (~F.coalesce(has, F.lit(False)), "warning", "medium", "uncertainty_missing"))


def temporal_alignment(a: DataFrame, b: DataFrame, key: str = K) -> DataFrame:
    """(start, end as text) of two slots to their verdict's columns."""
    met = a.select(key, *[F.col(c).alias(f"a_{c}") for c in ("start", "end")]).join(b.select(key, *[F.col(c).alias(f"b_{c}") for c in ("start", "end")]), key)
    return met.withColumn("v", alignment(*map(F.col, ("a_start", "a_end", "b_start", "b_end")))).select("*", "v.status", "v.severity").drop("v")


def uncertainty_present(results: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Warns of each result that no interval belongs to."""
    met = results.join(intervals.select(*keys).distinct().withColumn("_has", F.lit(True)), keys, "left")
    return met.withColumn("status", uncertainty(F.col("_has"))["status"]).drop("_has")


@dataclass(frozen=True)
class Validator:
    """judge: from the facts' columns to a verdict. needs: columns without which there is none. of_series: it judges the
    series that the facts are bound to, so it has no verdict where the row's series_problem is not NULL."""

    judge: Callable[[], Column]
    needs: tuple[str, ...] = ()
    of_series: bool = False


c = F.col
#: Built-in validators by name, over facts of these columns.
VALIDATORS: dict[str, Validator] = {
    "record_length": Validator(lambda: record_length(c("n_days")), ("n_days",), True),
    "usgs_qualification_codes": Validator(lambda: qualification(c("n_codes"), c("n_provisional"), c("n_other"), c("n_estimated"), c("n_coded")), ("n_codes", "n_provisional", "n_other", "n_estimated", "n_coded"), True),
    "stationarity": Validator(lambda: stationarity(c("n_years"), c("p_value")), ("n_years", "p_value"), True),
    "regulated_basin": Validator(lambda: regulated_basin(c("regulated")), ("regulated",), True),
    "water_balance_consistency": Validator(lambda: water_balance(c("runoff_ratio"), c("precipitation_usable")), ("runoff_ratio", "precipitation_usable")),
    "temporal_alignment": Validator(lambda: alignment(c("a_start"), c("a_end"), c("b_start"), c("b_end")), ("a_start", "a_end", "b_start", "b_end")),
    "unit_consistency": Validator(lambda: unit_consistency(c("unit"), c("expected_unit")), ("unit", "expected_unit")),
    "uncertainty_present": Validator(lambda: uncertainty(c("has_interval")), ("has_interval",)),
}


def validator_table(facts: DataFrame, key: str = K, only: list[str] | None = None, own: dict[str, Validator | Callable[[], Column]] | None = None) -> DataFrame:
    """Each row of facts by each validator: key, validator, status, severity, quality_flag, metric.

    only: names of built-in validators, all by default. own: further ones by name, functions or `Validator`s; one that
    bears a built-in name takes its place. Rows with a series_problem get insufficient_data and that problem as their flag
    from validators of the series.
    """
    chosen: dict[str, Validator] = {n: VALIDATORS[n] for n in (VALIDATORS if only is None else only)}
    chosen |= {n: v if isinstance(v, Validator) else Validator(v) for n, v in (own or {}).items()}
    verdicts = []
    for name, validator in chosen.items():
        if set(validator.needs) - set(facts.columns):
            told = verdict("insufficient_data", None, "input_absent")
        else:
            try:
                told = validator.judge().cast(VERDICT)
                facts.select(told)  # analysed here, so that a column that cannot be resolved is found here
            except (PySparkException, ArithmeticError, TypeError, ValueError, LookupError, AttributeError):
                told = verdict("error", None, "validator_error")
            if validator.of_series and "series_problem" in facts.columns:
                problem = F.struct(F.lit("insufficient_data"), F.lit(None), F.col("series_problem"), F.lit(None)).cast(VERDICT)
                told = F.when(F.col("series_problem").isNotNull(), problem).otherwise(told)
        verdicts.append(F.struct(F.lit(name).alias("validator"), F.coalesce(told, verdict("error", None, "validator_null")).alias("v")))
    each = facts.select(key, F.explode(F.array(*verdicts)).alias("x"))
    return each.select(key, "x.validator", "x.v.status", "x.v.severity", "x.v.quality_flag", "x.v.metric")
