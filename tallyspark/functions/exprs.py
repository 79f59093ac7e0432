"""Column expressions used across the operators.

All of these are built-in Catalyst expressions, so they stay inside
whole-stage codegen; none of them is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark import config

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def extract_project_code(text: ColumnOrName) -> Column:
    """First ``GS\\d+[-\\w]*`` / ``ISS\\d+[-\\w]*`` match, else NULL.

    ``(?U)`` makes ``\\w`` Unicode-aware (letters such as Chinese characters
    are word characters in the source system's regex dialect).
    """
    return F.nullif(F.regexp_extract(_c(text), "(?U)" + config.PROJECT_CODE_PATTERN, 1), F.lit(""))


# A string that parses as a plain decimal number (what a lenient numeric
# coercion accepts); '1.5d', 'NaN', 'abc' and '' do not.
_NUMERIC_RE = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def coerce_numeric(x: ColumnOrName, fill: float | None = 0.0) -> Column:
    """string/number -> double; anything unparsable -> NULL -> ``fill``."""
    s = F.trim(_c(x).cast("string"))
    parsed = F.when(s.rlike(_NUMERIC_RE), s.try_cast("double"))
    return parsed if fill is None else F.coalesce(parsed, F.lit(float(fill)))


def guarded_ratio(x: ColumnOrName, y: ColumnOrName, otherwise: float = 0.0) -> Column:
    """X / y when y > 0 else ``otherwise`` (NULL y also -> otherwise)."""
    y = _c(y)
    return F.when(y > 0, _c(x) / y).otherwise(F.lit(otherwise))


def ratio_zero_as_one(x: ColumnOrName, y: ColumnOrName) -> Column:
    """X / (y with 0 replaced by 1); a NULL operand stays NULL."""
    y = _c(y)
    return _c(x) / F.when(y == 0, F.lit(1.0)).otherwise(y)


def clip(x: ColumnOrName, lo: float, hi: float) -> Column:
    """Clip to [lo, hi]; NULL stays NULL."""
    x = _c(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def indicator(cond: Column) -> Column:
    """0/1 integer flag; NULL condition -> 0."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def parse_month_day(text: ColumnOrName) -> Column:
    """Parse the start of 'm/d-m/d' (or 'm/d') as a date in year 1900.

    Bad text, 2/29 (1900 is not a leap year) and trailing blanks give NULL.
    """
    start = F.split(_c(text), "-").getItem(0)
    ts = F.try_to_timestamp(F.concat(F.lit("1900/"), start), F.lit("yyyy/M/d"))
    return F.to_date(ts)


def risk_level(total: ColumnOrName) -> Column:
    """P20: right-closed bins; 0 (and anything outside (0, 100]) -> NULL."""
    total = _c(total)
    expr = None
    for name, lo, hi in config.RISK_LEVELS:
        cond = (total > lo) & (total <= hi)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr


def first_argmax(cols: list[str], labels: list[str] | None = None) -> Column:
    """Label of the largest of ``cols``; the first one wins ties."""
    labels = labels or cols
    top = F.greatest(*[F.col(c) for c in cols])
    expr = None
    for c, lab in zip(cols, labels):
        cond = F.col(c) == top
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr


def success_label(status: ColumnOrName) -> Column:
    """Status -> 1 / 0 / -1 (NULL for a status outside the map)."""
    pairs = []
    for k, v in config.SUCCESS_LABELS:
        pairs += [F.lit(k), F.lit(v)]
    return F.create_map(*pairs)[_c(status)]


def salary_of(dept: ColumnOrName, departments: list[str] | None = None) -> Column:
    """Annual salary of a department; unknown/NULL -> mean of the table."""
    names = departments or [d for d, _ in config.DEPARTMENT_SALARIES]
    salaries = [s for _, s in config.DEPARTMENT_SALARIES]
    pairs = []
    for n, s in zip(names, salaries):
        pairs += [F.lit(n), F.lit(float(s))]
    avg = sum(salaries) / len(salaries)
    return F.coalesce(F.create_map(*pairs)[_c(dept)], F.lit(avg))


def round_half_up(x: ColumnOrName, decimals: int = config.OUTPUT_DECIMALS) -> Column:
    """Scale, round half away from zero, unscale (the common engine rounding)."""
    m = float(10 ** decimals)
    return F.round(_c(x).cast("double") * m) / m + F.lit(0.0)   # + 0.0 folds -0.0 into 0.0


def round_half_even(x: ColumnOrName, decimals: int = 2) -> Column:
    """numpy ``round``: scale, round half to even, unscale."""
    m = float(10 ** decimals)
    return F.bround(_c(x).cast("double") * m) / m


def round_doubles(df, decimals: int = config.OUTPUT_DECIMALS):
    """Round every double/float column (outputs compared across engines)."""
    out = []
    for f in df.schema.fields:
        t = f.dataType.simpleString()
        if t in ("double", "float"):
            out.append(round_half_up(f.name, decimals).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)
