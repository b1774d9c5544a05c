"""Linear recurrences over many steps, without one task that walks a series.

A recurrence whose next state is affine in the state (exponential smoothing,
Holt-Winters, filters, AR) composes: the steps of a range act on the state as one
affine map.  The range's map is found by folding its steps over the zero state
and, with the inputs set to zero, over the unit vectors.  A series of ``n`` steps
is cut into ranges of ``sqrt(n)`` steps: the ranges' maps (one small row each) give
the state at which every range begins, and the ranges are then walked side by
side.  So no task holds more than ``sqrt(n)`` steps or maps of a series.  The plan
is the same for every length, and all of it is built-in functions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tally.functions.stats import join_on_keys

#: The shortest range: below it the bookkeeping costs more than the steps.
SHORTEST = 16
_VECTOR = "array<double>"


def _join(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    return join_on_keys(a, b, keys, how) if keys else a.crossJoin(b)  # without keys: one row a side


def _units(width: int) -> Column:
    return F.array(*[F.array(*[F.lit(1.0 if i == j else 0.0) for j in range(width)]) for i in range(width)])


def _zero(width: int) -> Column:
    return F.array(*[F.lit(0.0)] * width).cast(_VECTOR)


def _pairs(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), y.alias("b")))


def _moved(m: Column, state: Column, zero: Column | None = None) -> Column:
    """The state after the map ``m`` (``c``: where zero goes, ``m``: where the unit vectors go)."""
    begin = m.c if zero is None else zero
    return F.aggregate(_pairs(m.m, state), begin, lambda acc, z: F.zip_with(acc, z.a, lambda v, x: v + x * z.b))


def _states(items: Column, state: Column, after: Callable) -> Column:
    """``(before, last)``: the state before every item, and after all of them."""
    return F.aggregate(
        items, F.struct(F.array().cast(f"array<{_VECTOR}>").alias("before"), state.cast(_VECTOR).alias("last")),
        lambda acc, x: F.struct(F.concat(acc.before, F.array(acc.last)).alias("before"), after(acc.last, x).alias("last")))


def ranges(cells: DataFrame, lengths: DataFrame, key: Sequence[str]) -> DataFrame:
    """``key, _range, _steps``: the steps (``idx, cell``) in ranges of about the square root of the
    series' length.  ``cells``: ``key, idx, cell`` (a struct); ``lengths``: ``key, n``."""
    size = lengths.select(*key, F.greatest(F.ceil(F.sqrt(F.col("n").cast("double"))).cast("long"),
                                           F.lit(SHORTEST).cast("long")).alias("_b"))
    return _join(cells, size, key).groupBy(*key, F.expr("idx div _b").alias("_range")).agg(
        F.sort_array(F.collect_list(F.struct("idx", "cell"))).alias("_steps"))


class Scan:
    """The recurrence ``step`` over every series.

    steps: what :func:`ranges` gives; a step without a row leaves the state as it is.
    start: ``key, variant, state, p``: one row per series and variant of its parameters; the
    state before the first step (``width`` doubles), and a struct of whatever ``step`` needs.
    step(state, x, p, inputs): the next state; ``x`` has ``idx`` and ``cell``.  It must be affine in
    the state, and with ``inputs`` false it must be its linear part (inputs count as 0).
    """

    def __init__(self, steps: DataFrame, start: DataFrame, key: Sequence[str], width: int, step: Callable,
                 many: bool = False) -> None:
        self.key, self.step, own = list(key), step, [*key, "variant"]
        units, zero, p = _units(width), _zero(width), F.col("p")
        tried = _join(steps, start.select(*own, "p"), key)
        if many:  # many variants of few rows: spread the work, not the bytes
            tried = tried.repartition(int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions")), *own, "_range")
        maps = tried.select(*own, "_range", F.struct(
            F.aggregate("_steps", zero, lambda s, x: step(s, x, p, True)).alias("c"),
            F.transform(units, lambda u: F.aggregate("_steps", u, lambda s, x: step(s, x, p, False))).alias("m")).alias("map"))
        listed = maps.groupBy(*own).agg(F.sort_array(F.collect_list(F.struct("_range", "map"))).alias("_maps"))
        states = _states(F.coalesce("_maps", F.array().cast(listed.schema["_maps"].dataType)), F.col("state"),
                         lambda s, x: _moved(x.map, s))
        whole = join_on_keys(start, listed, own, "left").select(*own, "p", F.col("_maps._range").alias("_at"), states.alias("_s"))
        #: ``key, variant, p, state``: the state after the last step.
        self.final = whole.select(*own, "p", F.col("_s.last").alias("state"))
        begun = whole.select(*own, "p", F.explode(_pairs(F.col("_at"), F.col("_s.before"))).alias("_z")).select(
            *own, "p", F.col("_z.a").alias("_range"), F.col("_z.b").alias("state"))
        if many:
            begun = begun.repartition(int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions")), *own, "_range")
        self._begun = join_on_keys(begun, steps, [*key, "_range"])

    def steps(self, emit: Callable) -> DataFrame:
        """``key, variant, out``: ``emit(before, x, after, p)`` of every step."""
        p = F.col("p")
        rows = self._begun.withColumn("_s", _states(F.col("_steps"), F.col("state"), lambda s, x: self.step(s, x, p, True)))
        after = F.concat(F.slice("_s.before", F.lit(2), F.greatest(F.size("_s.before") - 1, F.lit(0))), F.array(F.col("_s.last")))
        out = F.zip_with(_pairs(F.col("_s.before"), after), F.col("_steps"), lambda s, x: emit(s.a, x, s.b, p))
        return rows.select(*self.key, "variant", F.explode(out).alias("out"))
