"""Total numeric coercion, bounded scaling and small arithmetic helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelscope import fixed_values as fv


def col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def num(value) -> Column:
    """A Column from a Column or a Python number (numbers become doubles)."""
    return value if isinstance(value, Column) else F.lit(float(value))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    Inside a lambda (and in CASE branches) an expression is evaluated again at
    every use; binding it to a lambda variable avoids that.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def safe_float(value, default=0.0) -> Column:
    """Any input to a finite double; everything else becomes ``default``."""
    if isinstance(value, str):
        # Written as one SQL expression: a plan with hundreds of these builds much faster.
        name = ".".join(f"`{part}`" for part in value.split("."))
        x = f"try_cast({name} AS double)"
        finite = (
            f"CASE WHEN NOT isnan({x}) AND abs({x}) != double('infinity') "
            f"AND NOT (cast({name} AS string) rlike '[dDfF][ ]*$') THEN {x} END"
        )
        if isinstance(default, Column):
            return F.coalesce(F.expr(finite), default)
        return F.expr(f"coalesce({finite}, {float(default)!r}D)")
    c = value
    x = F.when(~c.cast("string").rlike("[dDfF][ ]*$"), c.try_cast("double"))
    finite = F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)
    return F.coalesce(finite, num(default))


def safe_int(value, default=0) -> Column:
    return F.bround(safe_float(value, default)).cast("bigint")


def clip(value, low, high) -> Column:
    """Bounded value; null stays null (greatest and least alone would skip it)."""
    x = num(value)
    return F.when(x.isNotNull(), F.greatest(num(low), F.least(num(high), x)))


def minmax_clip(value, low, high) -> Column:
    """(value - low) / (high - low) bounded to [0, 1]; 0 when the range is empty."""
    lo, hi = num(low), num(high)
    return F.when(hi <= lo, F.lit(0.0)).otherwise(clip((num(value) - lo) / (hi - lo), 0.0, 1.0))


def clip_rate(value) -> Column:
    return clip(safe_float(value), 0.0, 0.35)


def clip_probability(value) -> Column:
    p = num(value)
    return F.when(F.isnan(p), F.lit(0.5)).otherwise(clip(p, fv.PROBABILITY_FLOOR, fv.PROBABILITY_CEILING))


def safe_sigmoid(value) -> Column:
    x = num(value)
    return F.when(x >= 0, F.lit(1.0) / (F.lit(1.0) + F.exp(-x))).otherwise(F.exp(x) / (F.lit(1.0) + F.exp(x)))


def avg_positive(*values) -> Column:
    """Mean of the inputs that are strictly positive, 0 when there is none."""
    xs = [F.when(safe_float(v) > 0, safe_float(v)) for v in values]
    total = sum((F.coalesce(x, F.lit(0.0)) for x in xs[1:]), F.coalesce(xs[0], F.lit(0.0)))
    n = sum((x.isNotNull().cast("int") for x in xs[1:]), xs[0].isNotNull().cast("int"))
    return F.when(n > 0, total / n).otherwise(F.lit(0.0))


def ratio(numerator, denominator) -> Column:
    """Guarded division, 0/0 and x/0 give 0."""
    return F.when(num(denominator) != 0, num(numerator) / num(denominator)).otherwise(F.lit(0.0))


def steps(value, cuts, rest) -> Column:
    """Right-closed step function: the first cut with ``value <= cut`` wins."""
    chain = None
    for cut, result in cuts:
        chain = F.when(value <= cut, F.lit(result)) if chain is None else chain.when(value <= cut, F.lit(result))
    return chain.otherwise(F.lit(rest))


def lookup(key: Column, table: dict, default) -> Column:
    """Small constant table as one map literal; missing and null keys give the default."""
    def sql(v):
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return f"{float(v)!r}D"

    entries = ", ".join(f"{sql(k)}, {sql(v)}" for k, v in table.items())
    rest = default if isinstance(default, Column) else F.lit(default if isinstance(default, str) else float(default))
    return F.coalesce(F.expr(f"map({entries})")[key], rest)


def engagement(views, likes, comments, published_at, as_of, *, corpus: bool = False) -> dict[str, Column]:
    """Clipped counts, three rates, three logs and views per day.

    ``corpus=True`` divides by the views themselves (0 counts as 1), otherwise
    by ``max(views, 1)``.
    """
    from reelscope.functions.temporal import days_since

    v, l, c = (F.greatest(safe_float(x), F.lit(0.0)) for x in (views, likes, comments))
    denom = F.when(v == 0, F.lit(1.0)).otherwise(v) if corpus else F.greatest(v, F.lit(1.0))
    return {
        "views": v,
        "likes": l,
        "comments": c,
        "engagement_rate": F.round((l + c) / denom, 6),
        "like_rate": F.round(l / denom, 6),
        "comment_rate": F.round(c / denom, 6),
        "views_per_day": F.round(v / days_since(published_at, as_of), 6),
        "log_views": F.round(F.log1p(v), 6),
        "log_likes": F.round(F.log1p(l), 6),
        "log_comments": F.round(F.log1p(c), 6),
    }


def retention(watch_seconds, duration_seconds, fallback=0.0) -> Column:
    """Watch time over duration when both are known, else the fallback (above 1 = percent)."""
    watch = F.greatest(safe_float(watch_seconds), F.lit(0.0))
    duration = F.greatest(safe_float(duration_seconds), F.lit(0.0))
    fb = safe_float(fallback) if isinstance(fallback, (str, Column)) else F.lit(float(fallback))
    fb = F.when(fb > 1, fb / 100).otherwise(fb)
    known = (watch > 0) & (duration > 0)
    return F.round(F.when(known, F.least(watch / duration, F.lit(1.0))).otherwise(clip(fb, 0.0, 1.0)), 4)


def operational_metrics(views, shares, retention_rate, hours) -> dict[str, Column]:
    v = F.greatest(safe_float(views), F.lit(0.0))
    s = F.greatest(safe_float(shares), F.lit(0.0))
    h = F.greatest(safe_float(hours), F.lit(1.0))
    return {
        "shares": s,
        "share_rate": F.when(v != 0, F.round(s / v, 6)).otherwise(F.lit(0.0)),
        "retention_rate": F.round(F.greatest(safe_float(retention_rate), F.lit(0.0)), 4),
        "hours_since_publication": h,
        "views_per_hour": F.round(v / h, 4),
    }


def duration_fit(seconds) -> Column:
    d = safe_float(seconds)
    return F.when(d <= 0, F.lit(fv.DURATION_FIT_UNKNOWN)).otherwise(
        steps(d, fv.DURATION_FIT_STEPS, fv.DURATION_FIT_REST)
    )


def duration_bucket(seconds) -> Column:
    d = safe_float(seconds)
    return steps(d, ((15, "short"), (60, "medium")), "long")


def audit_duration_bucket(seconds) -> Column:
    """Right-closed audit bins; values at or below -0.01 fall outside every bin."""
    d = safe_float(seconds)
    bins = ((0, "desconocida"), (15, "muy_corto_1_15s"), (60, "corto_16_60s"), (180, "medio_61_180s"))
    return F.when(d <= -0.01, F.lit("nan")).otherwise(steps(d, bins, "largo_180s_plus"))


def notebook_duration_bucket(seconds) -> Column:
    d = col(seconds).cast("double")
    bins = ((15, 0.0), (30, 1.0), (60, 2.0), (90, 3.0), (120, 4.0))
    return F.when(d > -1, steps(d, bins, 5.0))


def notebook_duration_group(seconds) -> Column:
    d = F.coalesce(col(seconds).cast("double"), F.lit(60.0))
    bins = ((30, "corto (<=30s)"), (60, "medio (31-60s)"), (120, "largo (61-120s)"))
    return F.when(d > -1, steps(d, bins, "muy largo (>120s)"))


def sampling_timestamps(duration, n: int, *, margin: float = 0.5, share: float = 0.05) -> Column:
    """``n`` evenly spaced points that keep away from both ends."""
    d = col(duration).cast("double")
    start = F.least(F.lit(margin), d * share)
    end = F.greatest(d - margin, d * (1 - share))
    if n <= 1:
        return F.when(d > 0, F.array(d / 2)).otherwise(F.array().cast("array<double>"))
    step = (end - start) / (n - 1)
    points = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.round(start + i * step, 2))
    middle = F.array_repeat(d / 2, n)
    return F.when(d <= 0, F.array().cast("array<double>")).when(end <= start, middle).otherwise(points)


def frame_timestamps(duration, video_type, *, max_frames: int = 20) -> Column:
    """Stepwise frame times plus start, quartiles and end; de-duplicated, sorted, thinned evenly."""
    d = col(duration).cast("double")
    kind = F.lower(F.coalesce(col(video_type), F.lit("auto")))
    step = F.when((kind == "sin narrador") | (d <= 8), F.lit(0.75)).otherwise(F.lit(4.0))
    limit = F.greatest(d - 0.2, F.lit(0.6))
    # Points 0.5, 0.5 + step, ... strictly below the limit.
    count = F.ceil((limit - 0.5) / step).cast("int")
    grid = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: F.round(F.lit(0.5) + i * step, 2))
    marks = F.filter(
        F.array(F.lit(1.0), d * 0.25, d * 0.5, d * 0.75, F.greatest(d - 0.5, F.lit(0.0))),
        lambda t: (t >= 0) & (t <= d),
    )
    every = F.array_sort(F.array_distinct(F.concat(grid, F.transform(marks, lambda t: F.round(t, 2)))))

    def thinned(times):
        n = F.size(times)
        picked = F.transform(
            F.sequence(F.lit(0), F.lit(max_frames - 1)),
            lambda i: F.get(times, F.bround(i * (n - 1) / (max_frames - 1)).cast("int")),
        )
        return F.when(n > max_frames, picked).otherwise(times)

    return F.when(F.coalesce(d, F.lit(0.0)) <= 0, F.array().cast("array<double>")).otherwise(let(every, thinned))
