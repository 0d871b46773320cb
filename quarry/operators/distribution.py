"""Distribution steps.

Power-transform parameters are fitted by maximum likelihood with Newton steps:
every round takes four moments a column in one scan, for all columns.
``quantile_transform`` fits its knots with the exact distributed
quantile engine and applies a binary search in literal arrays; the normal
output uses the AS241 probit as a Column expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import free_names, numeric_columns, q
from ..functions.exprs import double_array
from ..plans.fitted import Fitted, Request, planned, step
from ..plans.guards import fused_agg
from ..plans.quantiles import column_quantiles, place_in

MAX_ROUNDS = 30  # scans of a power fit; about six as a rule


def _d(c):
    return q(c).cast("double")


# ---------------------------------------------------------------- simple shapes

def _shifted(name: str, df: DataFrame, cols, transformed) -> Request:
    """A step that maps each numeric column by ``transformed(x, its minimum)``."""
    num = numeric_columns(df, cols)

    def build(values, _):
        mins = {c: values[f"m{i}"] for i, c in enumerate(num)}
        return Fitted(name, num, lambda d: d.withColumns({c: transformed(_d(c), m) for c, m in mins.items()}) if mins else d,
                      [c for c in cols if c not in num], values=mins)

    return Request(num, build, {f"m{i}": F.min(_d(c)) for i, c in enumerate(num)})


@planned("log_transform")
def fit_log_transform(df: DataFrame, cols, **_):
    """Any x <= 0: log1p(x - min + 1), else log1p(x)."""
    return _shifted("log_transform", df, cols, lambda x, m: F.log1p(x - F.lit(m) + 1) if m is not None and m <= 0 else F.log1p(x))


@planned("sqrt_transform")
def fit_sqrt_transform(df: DataFrame, cols, **_):
    """Any x < 0: sqrt(x - min), else sqrt(x)."""
    return _shifted("sqrt_transform", df, cols, lambda x, m: F.sqrt(x - F.lit(m)) if m is not None and m < 0 else F.sqrt(x))


@planned("reciprocal_transform")
def fit_reciprocal_transform(df: DataFrame, cols, **_):
    """1 / (x + 1e-6) (stateless; x = -1e-6 gives NULL instead of infinity under ANSI)."""
    num = numeric_columns(df, cols)

    def apply(d):
        return d.withColumns({c: F.try_divide(F.lit(1.0), _d(c) + F.lit(1e-6)) for c in num}) if num else d

    return Request(num, lambda *_: Fitted("reciprocal_transform", num, apply, [c for c in cols if c not in num]))


# ---------------------------------------------------------------- power transforms

def _boxcox_expr(x: Column, lam: float) -> Column:
    return F.log(x) if lam == 0 else (F.pow(x, F.lit(lam)) - 1) / F.lit(lam)


def _yj_expr(x: Column, lam: float) -> Column:
    pos = F.log1p(x) if lam == 0 else (F.pow(x + 1, F.lit(lam)) - 1) / F.lit(lam)
    neg = -F.log1p(-x) if lam == 2 else -(F.pow(-x + 1, F.lit(2 - lam)) - 1) / F.lit(2 - lam)
    return F.when(x >= 0, pos).otherwise(neg)


def _derivatives(kind: str, x: Column, lam: float) -> list[Column]:
    """The transform of x and its first and second derivative by lambda."""

    def power(z: Column, m: float) -> list[Column]:
        u = F.log(z)
        if abs(m) < 1e-4:  # the closed forms below cancel there
            return [u + m * u * u / 2 + m * m * F.pow(u, 3) / 6, u * u / 2 + m * F.pow(u, 3) / 3 + m * m * F.pow(u, 4) / 8,
                    F.pow(u, 3) / 3 + m * F.pow(u, 4) / 4 + m * m * F.pow(u, 5) / 10]
        e = F.pow(z, F.lit(m))
        g0 = (e - 1) / m
        g1 = (e * u - g0) / m
        return [g0, g1, (e * u * u - 2 * g1) / m]

    if kind == "boxcox":
        return power(x, lam)
    up, down = power(F.greatest(x, F.lit(0.0)) + 1, lam), power(1 - F.least(x, F.lit(0.0)), 2 - lam)
    return [F.when(x >= 0, a).otherwise(sign * b) for a, b, sign in zip(up, down, (-1, 1, -1))]


def _newton_fit(df: DataFrame, exprs: dict, kind: str) -> dict:
    """Maximise the profile log-likelihood per column; returns {col: lambda}.

    ``exprs``: {col: Column of the (shifted) input x}.  Each round is one scan of four moments per column:
    Newton steps on the likelihood's slope, kept within the bracket that the slopes' signs give."""
    if not exprs:
        return {}
    names = list(exprs)
    base = fused_agg(df, [x for i, c in enumerate(names) for x in (
        F.count(exprs[c]).alias(f"n{i}"), F.sum(F.log(exprs[c]) if kind == "boxcox" else F.signum(exprs[c]) * F.log1p(F.abs(exprs[c]))).alias(f"s{i}"))])
    lam = {c: 1.0 for c in names if base[f"n{names.index(c)}"]}
    low, high = {c: -math.inf for c in lam}, {c: math.inf for c in lam}
    open_ = list(lam)
    for _ in range(MAX_ROUNDS):
        aggs = []
        for c in open_:
            i, (y, y1, y2) = names.index(c), _derivatives(kind, exprs[c], lam[c])
            aggs += [F.var_pop(y).alias(f"v{i}"), F.covar_pop(y, y1).alias(f"c{i}"), F.var_pop(y1).alias(f"w{i}"), F.covar_pop(y, y2).alias(f"d{i}")]
        r = fused_agg(df, aggs)
        for c in list(open_):
            i = names.index(c)
            n, v = base[f"n{i}"], r[f"v{i}"]
            if not v:  # constant: any lambda is as good
                open_.remove(c)
                continue
            slope = base[f"s{i}"] - n * r[f"c{i}"] / v
            bend = -n * ((r[f"w{i}"] + r[f"d{i}"]) / v - 2 * (r[f"c{i}"] / v) ** 2)
            low[c], high[c] = (lam[c], high[c]) if slope > 0 else (low[c], lam[c])
            move = -slope / bend if bend < 0 else math.copysign(1.0, slope)
            new = lam[c] + max(-1.0, min(1.0, move))
            if not low[c] < new < high[c]:
                new = (low[c] + high[c]) / 2 if math.isfinite(low[c] + high[c]) else lam[c] + math.copysign(1.0, slope)
            done = abs(new - lam[c]) < 1e-10 * max(1.0, abs(new)) or slope == 0
            lam[c] = new
            if done:
                open_.remove(c)
        if not open_:
            return {c: lam.get(c, 1.0) for c in names}
    raise ValueError(f"no lambda found within {MAX_ROUNDS} rounds for {open_}")


def log_likelihood(df: DataFrame, col: str, lam: float, kind: str = "boxcox", shift: float = 0.0) -> DataFrame:
    """One row (lam, llf): the profile log-likelihood of a power transform, up to a constant."""
    x = _d(col) + F.lit(shift)
    y = _boxcox_expr(x, lam) if kind == "boxcox" else _yj_expr(x, lam)
    jacobian = F.sum(F.log(x) if kind == "boxcox" else F.signum(x) * F.log1p(F.abs(x)))
    return df.agg(F.lit(lam).alias("lam"), ((lam - 1) * jacobian - F.count(x) / 2 * F.log(F.var_pop(y))).alias("llf"))


@step("boxcox_transform")
def fit_boxcox_transform(df: DataFrame, cols, lambdas: dict | None = None, **_):
    """Box-Cox with lambda by maximum likelihood (or the given one); x <= 0 present: shift by -min + 1."""
    num = numeric_columns(df, cols)
    shift = {}
    if num:
        r = df.agg(*[F.min(_d(c)).alias(f"m{i}") for i, c in enumerate(num)],
                   *[F.max(_d(c)).alias(f"x{i}") for i, c in enumerate(num)]).first()
        for i, c in enumerate(num):
            m, mx = r[f"m{i}"], r[f"x{i}"]
            if m is None:
                continue
            if m == mx:
                raise ValueError(f"boxcox_transform: column {c} is constant")
            shift[c] = (-m + 1) if m <= 0 else 0.0
    xs = {c: _d(c) + F.lit(s) for c, s in shift.items()}
    lams = {**_newton_fit(df, {c: x for c, x in xs.items() if c not in (lambdas or {})}, "boxcox"), **{c: v for c, v in (lambdas or {}).items() if c in xs}}

    def apply(d):
        return d.withColumns({c: _boxcox_expr(_d(c) + F.lit(shift[c]), lams[c]) for c in lams}) if lams else d

    return Fitted("boxcox_transform", num, apply, [c for c in cols if c not in num],
                  values={c: {"lambda": lams[c], "shift": shift[c]} for c in lams})


@step("yeojohnson_transform")
def fit_yeojohnson_transform(df: DataFrame, cols, standardize: bool = True, lambdas: dict | None = None, **_):
    """Yeo-Johnson with lambda by maximum likelihood (or the given one), then standardised (mean 0, population std 1)."""
    num = numeric_columns(df, cols)
    lams = {**_newton_fit(df, {c: _d(c) for c in num if c not in (lambdas or {})}, "yeojohnson"), **{c: v for c, v in (lambdas or {}).items() if c in num}}
    moments = {}
    if lams and standardize:
        r = df.agg(*[F.avg(_yj_expr(_d(c), lams[c])).alias(f"m{i}") for i, c in enumerate(lams)],
                   *[F.stddev_pop(_yj_expr(_d(c), lams[c])).alias(f"s{i}") for i, c in enumerate(lams)]).first()
        moments = {c: (r[f"m{i}"], r[f"s{i}"]) for i, c in enumerate(lams)}

    def apply(d):
        out = {}
        for c, lam in lams.items():
            y = _yj_expr(_d(c), lam)
            if standardize:
                m, s = moments[c]
                y = (y - F.lit(m)) / F.lit(s or 1.0)
            out[c] = y
        return d.withColumns(out) if out else d

    return Fitted("yeojohnson_transform", num, apply, [c for c in cols if c not in num],
                  values={c: {"lambda": lams[c], "moments": moments.get(c)} for c in lams})


# ---------------------------------------------------------------- quantile transform

# Coefficients of Wichura's AS241 (PPND16) rational approximation of the
# standard normal quantile function (Applied Statistics, 1988), lowest order first.
AS241_A = [3.3871328727963666080e0, 1.3314166789178437745e+2, 1.9715909503065514427e+3, 1.3731693765509461125e+4,
           4.5921953931549871457e+4, 6.7265770927008700853e+4, 3.3430575583588128105e+4, 2.5090809287301226727e+3]
AS241_B = [1.0, 4.2313330701600911252e+1, 6.8718700749205790830e+2, 5.3941960214247511077e+3,
           2.1213794301586595867e+4, 3.9307895800092710610e+4, 2.8729085735721942674e+4, 5.2264952788528545610e+3]
AS241_C = [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
           1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4]
AS241_D = [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
           1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9]
AS241_E = [6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
           2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7]
AS241_F = [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
           7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15]
BOUNDS_THRESHOLD = 1e-7


def _horner(coef, x: Column) -> Column:
    acc = F.lit(coef[-1])
    for a in reversed(coef[:-1]):
        acc = acc * x + F.lit(a)
    return acc


def probit(p: Column) -> Column:
    """Standard normal quantile of p in (0, 1) (AS241), JVM-side."""
    qq = p - 0.5
    r_c = F.lit(0.180625) - qq * qq
    central = qq * _horner(AS241_A, r_c) / _horner(AS241_B, r_c)
    r = F.sqrt(-F.log(F.when(qq < 0, p).otherwise(1 - p)))
    near = _horner(AS241_C, r - 1.6) / _horner(AS241_D, r - 1.6)
    far = _horner(AS241_E, r - 5.0) / _horner(AS241_F, r - 5.0)
    tail = F.when(r <= 5.0, near).otherwise(far)
    return F.when(F.abs(qq) <= 0.425, central).otherwise(F.when(qq < 0, -tail).otherwise(tail))


def probit_sql(p: str) -> str:
    """Same AS241 formula as SQL text (oracle side)."""
    def horner(coef, x):
        s = f"{coef[-1]!r}"
        for a in reversed(coef[:-1]):
            s = f"({s} * ({x}) + {a!r})"
        return s
    qq = f"(({p}) - 0.5)"
    rc = f"(0.180625 - {qq} * {qq})"
    r = f"sqrt(-ln(CASE WHEN {qq} < 0 THEN ({p}) ELSE 1 - ({p}) END))"
    central = f"({qq} * {horner(AS241_A, rc)} / {horner(AS241_B, rc)})"
    near = f"({horner(AS241_C, f'{r} - 1.6')} / {horner(AS241_D, f'{r} - 1.6')})"
    far = f"({horner(AS241_E, f'{r} - 5.0')} / {horner(AS241_F, f'{r} - 5.0')})"
    tail = f"(CASE WHEN {r} <= 5.0 THEN {near} ELSE {far} END)"
    return f"(CASE WHEN abs({qq}) <= 0.425 THEN {central} WHEN {qq} < 0 THEN -{tail} ELSE {tail} END)"


def _knot_tables(knots: list[float], refs: list[float]):
    """Distinct knot values with the first and last reference of each tie run."""
    u, r_lo, r_hi = [], [], []
    for k, r in zip(knots, refs):
        if u and k == u[-1]:
            r_hi[-1] = r
        else:
            u.append(k)
            r_lo.append(r)
            r_hi.append(r)
    return u, r_lo, r_hi


@step("quantile_transform")
def fit_quantile_transform(df: DataFrame, cols, output_distribution: str = "normal", n_quantiles: int = 1000, **_):
    """Map through the empirical CDF (min(n_quantiles, n) exact knots, averaged forward/backward
    interpolation, ties to the mid-point) to a uniform or a normal distribution.

    Columns with the same number of knots (all but short ones) are fitted in one pass."""
    num = numeric_columns(df, cols)
    fits = {}
    if num:
        counts = df.agg(*[F.count(q(c)).alias(f"n{i}") for i, c in enumerate(num)]).first()
        knots_of = {c: max(1, min(int(n_quantiles), counts[f"n{i}"])) for i, c in enumerate(num) if counts[f"n{i}"]}
        for m in sorted(set(knots_of.values())):
            refs = [j / (m - 1) for j in range(m)] if m > 1 else [0.0]
            for c, knots in column_quantiles(df, [c for c in num if knots_of.get(c) == m], refs).items():
                fits[c] = _knot_tables(knots, refs)

    def apply(d):
        if not fits:
            return d
        at, share = (dict(zip(fits, free_names(d.columns, *[f"{kind}{i}" for i in range(len(fits))]))) for kind in ("at", "share"))
        out = d.withColumns({at[c]: place_in(_d(c), double_array(u), len(u)) for c, (u, _, _) in fits.items()})
        res = {}
        for c, (u, r_lo, r_hi) in fits.items():
            # segments between knots: at[c] is the last knot at or below x
            def table(values, offset, c=c):
                return F.get(double_array(values), q(at[c]) + offset)

            x, lu, lhi = _d(c), table(u, 0), table(r_hi, 0)
            lin = lhi + (x - lu) * (table(r_lo, 1) - lhi) / (table(u, 1) - lu)
            y = F.when(x == lu, (table(r_lo, 0) + lhi) / 2).otherwise(lin)
            y = F.when(x - BOUNDS_THRESHOLD < F.lit(float(u[0])), F.lit(0.0)).when(
                x + BOUNDS_THRESHOLD > F.lit(float(u[-1])), F.lit(1.0)).otherwise(y)
            res[c] = F.when(x.isNotNull(), y)
        # probit reads its input several times: keep it a column so the interpolation is computed once
        out = out.withColumns({share[c]: y for c, y in res.items()})
        eps = BOUNDS_THRESHOLD - 2.220446049250313e-16
        done = {c: probit(F.greatest(F.least(q(share[c]), F.lit(1 - eps)), F.lit(eps))) if output_distribution == "normal" else q(share[c]) for c in fits}
        return out.select(*[(done[c].alias(c) if c in done else q(c)) for c in d.columns])

    return Fitted("quantile_transform", num, apply, [c for c in cols if c not in num], values={c: len(f[0]) for c, f in fits.items()})


def log_transform(df, cols):
    return fit_log_transform(df, cols).apply(df)


def sqrt_transform(df, cols):
    return fit_sqrt_transform(df, cols).apply(df)


def reciprocal_transform(df, cols):
    return fit_reciprocal_transform(df, cols).apply(df)


def boxcox_transform(df, cols):
    return fit_boxcox_transform(df, cols).apply(df)


def yeojohnson_transform(df, cols):
    return fit_yeojohnson_transform(df, cols).apply(df)


def quantile_transform(df, cols, output_distribution="normal", n_quantiles=1000):
    return fit_quantile_transform(df, cols, output_distribution, n_quantiles).apply(df)
