"""Mixing sources to target weights by entropy balancing.

Each document gets a rate, the expected number of its copies in the mix. Among all rates
that meet the token targets of the sources, entropy balancing takes those nearest to the
base rate in relative entropy; they are exponential tilts of it, one dual variable per
source, which Newton's method finds. Each Newton step is one distributed aggregation over
the histogram of document sizes, and the rates are then rounded into whole copies.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash, unit_hash, word_count


def source_targets(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Sources take ``weights`` in turn, by code point and null last, and share ``share`` times
    the total by weight. A target stops at ``cap`` times its source; what it cannot take goes
    to the others by weight until none is above. That fixed point is min(cap, weight * mu):
    in order of cap / weight the capped sources come first, so prefix sums give mu.
    """
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    ranked = sources.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    capped = ranked.withColumn("_mu", level).withColumn("_capped", F.col("_cap") <= F.col("_w") * F.col("_mu"))
    mu = F.max(F.when(~F.col("_capped"), F.col("_mu"))).over(everything)
    return capped.withColumn("_mu", mu).select(
        "source",
        "source_size",
        F.when(F.col("_capped") | F.col("_mu").isNull(), F.col("_cap")).otherwise(F.least("_cap", F.col("_w") * F.col("_mu"))).alias("target"),
    )


def _rate(size: Column, lam: Column, scale: Column, base: float, cap: float) -> Column:
    """min(cap, base * exp(lam * size / scale)); a null ``lam`` stands for infinity."""
    # exp of more than 700 overflows; the cap is far below
    return F.when(lam.isNull(), F.lit(cap)).otherwise(F.least(F.lit(cap), F.lit(base) * F.exp(F.least(lam * size / scale, F.lit(700.0)))))


def solve_dual(sizes: DataFrame, targets: DataFrame, base: float, cap: float, tolerance: float, steps: int) -> DataFrame:
    """``source, lam, scale``: the dual variables, from ``source, size, n`` and the targets.

    Newton's step, or bisection where it leaves the bracket: the constraint grows with
    ``lam``, so either is safe, and steps stop when every source is within ``tolerance``.
    A source whose target is all it can give has ``lam`` null, for infinity.
    """
    double = lambda c: F.col(c).cast("double")
    scale = F.sum(double("n") * double("size") * double("size")) / F.sum(double("n") * double("size"))
    start = sizes.groupBy("source").agg(scale.alias("scale"))
    state = (
        targets.withColumnRenamed("source", "_s")
        .join(start, F.col("_s").eqNullSafe(F.col("source")))
        .select("source", "scale", "target", "source_size")
        .withColumn("full", F.col("target") >= F.col("source_size") * cap * (1 - 1e-12))
        .withColumn("lam", F.when(F.col("full"), None).otherwise(F.lit(0.0)))
        .withColumn("lo", F.lit(-1e9))
        .withColumn("hi", F.lit(1e9))
        .withColumn("gap", F.lit(float("inf")))
    )
    state = stash(state, "mix-dual")
    names = state.columns
    for _ in range(steps):
        at = sizes.withColumnRenamed("source", "_s").join(state.filter("not full and gap > 0"), F.col("_s").eqNullSafe(F.col("source")))
        rate = _rate(double("size"), F.col("lam"), F.col("scale"), base, cap)
        words = double("n") * double("size") * rate
        slope = F.when(rate < cap, words * double("size") / F.col("scale")).otherwise(0.0)
        sums = at.groupBy(F.col("source").alias("_g")).agg(F.sum(words).alias("_f"), F.sum(slope).alias("_d"))
        miss = F.col("_f") - F.col("target")
        done = F.abs(miss) <= F.col("target") * tolerance
        lo, hi = F.when(miss < 0, F.col("lam")).otherwise(F.col("lo")), F.when(miss > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - miss / F.col("_d")
        # a bracket that is still open on the side of the step grows by a factor
        middle = (
            F.when((hi >= 1e9), F.greatest(F.col("lam") * 2, F.lit(1.0))).when(lo <= -1e9, F.least(F.col("lam") * 2, F.lit(-1.0))).otherwise((lo + hi) / 2)
        )
        inside = (F.col("_d") > 0) & (newton > lo) & (newton < hi) & (F.abs(newton - F.col("lam")) <= 4 * (1 + F.abs(F.col("lam"))))
        moved = F.when(F.col("_f").isNull() | done, F.col("lam")).when(inside, newton).otherwise(middle)
        state = stash(
            state.join(sums, F.col("source").eqNullSafe(F.col("_g")), "left")
            .withColumns({"lam": moved, "lo": F.coalesce(lo, "lo"), "hi": F.coalesce(hi, "hi"), "gap": F.when(F.col("_f").isNull() | done, 0.0).otherwise(F.abs(miss))})
            .select(names),
            "mix-dual",
        )
        if not state.filter("not full and gap > 0").limit(1).count():
            break
    return state.select("source", "lam", "scale")


def _copies(rate: Column, u: Column, shift: Column, cap: float) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(int(cap)), F.floor(rate + u + shift)))


def _row_columns(id_col: str, text_col: str) -> tuple[Column, Column]:
    """A document's size, and the number in [0, 1) that decides how its rate is rounded."""
    return word_count(F.col(text_col)), unit_hash(F.col(id_col), F.col(text_col))


def plan_sources(sized: DataFrame, weights: tuple[float, ...], share: float, cap: float, tolerance: float, steps: int, passes: int) -> DataFrame:
    """What each source's documents need to know: one row per source of ``source, size, u``.

    ``source, source_size, target, lam, scale, shift``.
    """
    hist = stash(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-histogram")
    by_source = hist.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    targets = stash(source_targets(by_source, weights, share, cap), "mix-targets")
    dual = solve_dual(hist.filter("size > 0"), targets, float(share), float(cap), tolerance, steps)
    known = stash(
        targets.join(dual.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"), "mix-known"
    )
    rate = _rate(F.col("size").cast("double"), F.col("lam"), F.col("scale"), float(share), float(cap))
    rated = stash(
        sized.select(F.col("source").alias("_s"), "size", "u")
        .join(known, F.col("_s").eqNullSafe(F.col("source")))
        .select("source", "size", "u", rate.alias("rate")),
        "mix-rates",
    )
    # The words taken grow with the shift, so a few passes of 15 trial shifts corner it.
    parts = 16
    shift = targets.select("source", "target", F.lit(-1.0).alias("lo"), F.lit(1.0).alias("hi"))
    at = lambda j: F.col("lo") + (F.col("hi") - F.col("lo")) * (j / parts)
    taken = lambda s: F.sum(F.col("size") * _copies(F.col("rate"), F.col("u"), s, cap))

    def summed(shift: DataFrame, **sums: Column) -> DataFrame:
        rows = rated.withColumnRenamed("source", "_s").join(shift, F.col("_s").eqNullSafe(F.col("source")))
        return rows.groupBy("source", "target", "lo", "hi").agg(*[c.alias(k) for k, c in sums.items()])

    for _ in range(passes):
        sums = summed(shift, **{f"_{j}": taken(at(j)) for j in range(1, parts)})
        # how many trial shifts stay at or below the target
        below = reduce(lambda a, j: a + F.when(F.col(f"_{j}") <= F.col("target"), 1).otherwise(0), range(1, parts), F.lit(0))
        shift = stash(sums.select("source", "target", at(below).alias("lo"), at(below + 1).alias("hi")), "mix-shift")
    ends = summed(shift, _lo=taken(F.col("lo")), _hi=taken(F.col("hi")))
    over, under = F.abs(F.col("_hi") - F.col("target")), F.abs(F.col("_lo") - F.col("target"))
    nearest = ends.select(F.col("source").alias("_s"), F.when(over < under, F.col("hi")).otherwise(F.col("lo")).alias("shift"))
    return stash(known.join(nearest, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"), "mix-plan")


def _decided(rows: DataFrame, plan: DataFrame, share: float, cap: float) -> DataFrame:
    """``rows``, with ``_source, _size, _u``, joined to their source's plan: adds ``_rate`` and ``_copies``."""
    rate = _rate(F.col("_size").cast("double"), F.col("lam"), F.col("scale"), float(share), float(cap))
    return (
        rows.join(plan.withColumnRenamed("source", "_planned"), F.col("_source").eqNullSafe(F.col("_planned")))
        .withColumn("_rate", rate)
        .withColumn("_copies", _copies(F.col("_rate"), F.col("_u"), F.col("shift"), cap).cast("int"))
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    tolerance: float = 1e-9,
    steps: int = 60,
    passes: int = 6,
) -> DataFrame:
    """One row per document: ``id_col, source, size, source_size, target, rate, copies, taken``.

    ``taken`` is ``copies * size`` words; copies run from 0 to ``floor(cap)``. A rate is
    rounded up or down by a hash of the row, so that reruns agree, plus a shift per source
    that is searched so that the source's words come as near to its target as whole
    documents allow. Null and empty texts have size 0 and never count towards a target;
    null sources form one source, the last. Repeated rows get equal copies. Other columns
    are ignored; an empty table gives no rows.
    """
    size, u = _row_columns(id_col, text_col)
    sized = stash(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), u.alias("u")), "mix-sizes")
    plan = plan_sources(sized, weights, share, cap, tolerance, steps, passes)
    rows = sized.select("id", F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("u").alias("_u"))
    return _decided(rows, plan, share, cap).select(
        F.col("id").alias(id_col),
        F.col("_source").alias("source"),
        F.col("_size").alias("size"),
        "source_size",
        "target",
        F.col("_rate").alias("rate"),
        F.col("_copies").alias("copies"),
        (F.col("_copies") * F.col("_size")).alias("taken"),
    )


def resample(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    cap: float = 2.0,
    tolerance: float = 1e-9,
    steps: int = 60,
    passes: int = 6,
) -> DataFrame:
    """``docs`` with each row as often as :func:`mix` has copies of it, and the columns of ``docs``.

    Texts stay where they are read unless the plan's table is too large to broadcast.
    """
    names = docs.columns
    size, u = _row_columns(id_col, text_col)
    sized = stash(docs.select(F.col(source_col).alias("source"), size.alias("size"), u.alias("u")), "mix-sizes")
    plan = plan_sources(sized, weights, share, cap, tolerance, steps, passes)
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)])
    rows = docs.select(row.alias("_row"), F.col(source_col).alias("_source"), size.alias("_size"), u.alias("_u"))
    repeated = _decided(rows, plan, share, cap).select("_row", F.explode(F.array_repeat(F.lit(0), F.col("_copies"))).alias("_copy"))
    return repeated.select(*[F.col(f"_row.c{i}").alias(c) for i, c in enumerate(names)])
