"""Scalar functions whose meaning differs from Spark's builtin of the same name."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim_space(x) -> Column:
    """Trim all white space at both ends (Spark's trim takes blanks only)."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def round_half_away(x) -> Column:
    return F.round(_c(x), 0)


def cast_boolean(x) -> Column:
    """true/t/1/yes and false/f/0/no/'' in any case; anything else raises."""
    s = F.lower(_c(x).cast("string"))
    return F.when(s.isNull(), F.lit(None)).when(s.isin("true", "t", "1", "yes"), True).when(s.isin("false", "f", "0", "no", ""), False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), s)).cast("boolean"))


def cast_date(x) -> Column:
    """Text of the form YYYY-MM-DD to a date; other text raises."""
    s = _c(x).cast("string")
    return F.when(s.isNull() | s.rlike(r"^\d{4}-\d{2}-\d{2}$"), s.cast("date")).otherwise(F.raise_error(F.concat(F.lit("not a date: "), s)).cast("date"))


def epoch_to_date(x) -> Column:
    """Epoch seconds to a date; negative seconds clamp to 1970-01-01."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.greatest(F.floor(_c(x) / F.lit(86400)), F.lit(0)).cast("int"))


def cast_vector(x, size: int) -> Column:
    """Text '[a,b,c]' to array<float> of exactly `size` numbers; another count raises."""
    v = F.transform(F.split(F.regexp_replace(_c(x), r"[\[\]\s]", ""), ","), lambda e: e.cast("float"))
    return F.when(_c(x).isNull() | (F.size(v) == size), v).otherwise(F.raise_error(F.lit(f"a vector of {size} numbers is needed")).cast("array<float>"))


def l2_distance(a, b) -> Column:
    """Euclidean distance in double precision, inside the JVM; vectors of different length raise."""
    a, b = _c(a), _c(b)
    gap = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y))
    total = F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(F.size(a) == F.size(b), total).otherwise(F.raise_error(F.lit("vectors of different length")).cast("double"))


def l2_to(column, query: list[float]) -> Column:
    """Distance to a fixed vector, unrolled: no array is built per row. Null gives null, another length raises."""
    v = _c(column)
    terms = [(v[k].cast("double") - F.lit(float(q))) * (v[k].cast("double") - F.lit(float(q))) for k, q in enumerate(query)]
    total = F.sqrt(reduce(lambda s, t: s + t, terms)) if terms else F.lit(0.0)
    return F.when(F.size(v) == len(query), total).when(v.isNotNull(), F.raise_error(F.lit("vectors of different length")).cast("double"))
