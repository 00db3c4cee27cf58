"""Ordered series: gaps, regularity, trailing ranges, spectral peaks, legal transitions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.scalar import finite
from millrace.operators.cut import checkpointed
from millrace.operators.quantiles import matched
from millrace.operators.spectra import spectrum


def sequence_gaps(df: DataFrame, key: Sequence[str], step: str, first: int = 0) -> DataFrame:
    """Rows whose step does not follow the one before by one (or does not begin at `first`): key, step, expected, problem."""
    before = F.lag(step).over(Window.partitionBy(*key).orderBy(step))
    expected = F.coalesce(before + 1, F.lit(first))
    rows = df.select(*key, step, expected.alias("expected"))
    problem = F.when(F.col(step) < F.col("expected"), "repeated").otherwise("gap")
    return rows.filter(F.col(step) != F.col("expected")).withColumn("problem", problem)


def regularity(df: DataFrame, key: Sequence[str], at: str, width: int = 86_400) -> DataFrame:
    """key, n, n_steps (different distances), least and greatest distance, regular: equal distances between neighbours.

    Neighbours meet inside stretches of `width`; a stretch's first row meets the last of the one before.
    """
    key = list(key)
    rows = df.select(*key, at).withColumn("__part", F.floor(F.col(at) / width))
    inner = F.col(at) - F.lag(at).over(Window.partitionBy(*key, "__part").orderBy(at))
    inside = rows.withColumn("__d", inner).groupBy(*key, "__d").agg(F.count(F.lit(1)).alias("__c"))
    ends = rows.groupBy(*key, "__part").agg(F.min(at).alias("__first"), F.max(at).alias("__last"))
    outer = F.col("__first") - F.lag("__last").over(Window.partitionBy(*key).orderBy("__part"))
    between = ends.select(*key, outer.alias("__d"), F.lit(0).cast("long").alias("__c"))
    said = inside.unionByName(between).groupBy(*key).agg(F.sum("__c").alias("n"), F.count_distinct("__d").alias("n_steps"), F.min("__d").alias("least"), F.max("__d").alias("greatest"))
    return said.withColumn("regular", (F.col("n_steps") == 1) & (F.col("least") > 0))


def trailing_mean(df: DataFrame, key: Sequence[str], at: str, value: str, width: int) -> DataFrame:
    """df with n_trailing and trailing_mean over the rows with at in (at - width, at]; at is a whole number.

    A frame reaches into two stretches of `width` at most: each row goes to its own and, as context, to the
    next, so a task holds two stretches and not a whole key.
    """
    home = F.floor(F.col(at) / width)
    dealt = df.withColumn("__part", F.explode(F.array(home, home + 1)))
    frame = Window.partitionBy(*key, "__part").orderBy(at).rangeBetween(-(width - 1), 0)
    said = dealt.withColumn("n_trailing", F.count(F.lit(1)).over(frame)).withColumn("trailing_mean", F.avg(value).over(frame))
    return said.filter(F.col("__part") == home).drop("__part")


def running(df: DataFrame, key: Sequence[str], at: str, width: int | Column, order: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """df with running sums of each key's rows up to each one, in order; at is the first column of the order.

    Rows are summed inside stretches of `width` and the stretches among each other, so a task holds one
    stretch and not a whole key.
    """
    key, names = list(key), list(sums)
    rows = df.withColumns({f"__{n}": v.cast("long") for n, v in sums.items()}).withColumn("__part", F.floor(F.col(at) / width))
    parts = rows.groupBy(*key, "__part").agg(*[F.sum(f"__{n}").alias(f"__{n}") for n in names])
    earlier = Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*key, "__part", *[F.coalesce(F.sum(f"__{n}").over(earlier), F.lit(0)).alias(f"__before_{n}") for n in names])
    inside = Window.partitionBy(*key, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumns({n: F.sum(f"__{n}").over(inside) for n in names})
    placed = matched(placed, offsets, [*key, "__part"])
    return placed.withColumns({n: F.col(n) + F.col(f"__before_{n}") for n in names}).drop("__part", *[f"__{n}" for n in names], *[f"__before_{n}" for n in names])


def drift(df: DataFrame, key: Sequence[str], at: str, value: str) -> DataFrame:
    """df with drift: how far the value lies from the key's first one, as a share of it.

    The planner's size of the first ones is that of the table that df was made from, so the join names its kind.
    """
    first = df.groupBy(*key).agg(F.min_by(value, at).alias("__first"))
    return matched(df, first.hint("shuffle_hash"), list(key)).withColumn("drift", F.abs(F.col(value) - F.col("__first")) / F.abs("__first")).drop("__first")


def last_range_mean(df: DataFrame, key: Sequence[str], at: str, value: str, width: int) -> DataFrame:
    """key, n, mean over the last `width` of at: two aggregates, no sort."""
    last = df.groupBy(*key).agg(F.max(at).alias("__last"))
    return matched(df, last, list(key)).filter(F.col(at) > F.col("__last") - width).groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def spectral_peak(df: DataFrame, key: Sequence[str], at: str, value: str, low: float, high: float, *, direct: int = 20_000, least_cycles: int = 8) -> DataFrame:
    """key, n, frequency, power, failure: the greatest bin of the Hann-windowed, demeaned spectrum within [low, high].

    Frequencies are cycles a sample. In series of up to `direct` samples each sample meets each bin of the band once;
    longer ones are numbered stretch by stretch and transformed in parts (spectra.py). A peak inside the band is
    refined by a parabola through the logarithms. Failures: too_short, not_finite, no_bin_in_band, flat, too_few_cycles
    (the peak goes round less than least_cycles times in the series).
    """
    key = list(key)
    number = F.col(value).cast("double")
    sizes = checkpointed(
        df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.bool_or(~finite(number)).alias("__odd"), F.avg(number).alias("__mean"), F.min(F.col(at).cast("double")).alias("__from"), F.max(F.col(at).cast("double")).alias("__to"))
    )
    sound = sizes.filter((F.col("n") >= 8) & ~F.col("__odd")).select(*key, F.col("n").alias("__n"), "__mean", "__from", "__to")
    rows = matched(df.select(*key, at, number.alias("__v")), sound, key)
    hann = 0.5 * (1 - F.cos(2 * math.pi * F.col("__k") / (F.col("__n") - 1)))
    short = rows.filter(F.col("__n") <= direct).withColumn("__k", F.row_number().over(Window.partitionBy(*key).orderBy(at)) - 1)
    short = short.withColumn("__w", hann * (F.col("__v") - F.col("__mean")))
    bins = F.sequence(F.greatest(F.ceil(F.lit(low) * F.col("__n")), F.lit(1)).cast("int"), F.floor(F.lit(high) * F.col("__n")).cast("int"))
    some = F.floor(F.lit(high) * F.col("__n")) >= F.greatest(F.ceil(F.lit(low) * F.col("__n")), F.lit(1))
    met = short.filter(some).withColumn("__b", F.explode(bins))
    angle = 2 * math.pi * F.pmod(F.col("__b").cast("long") * F.col("__k"), F.col("__n")) / F.col("__n")
    power = met.groupBy(*key, "__b").agg(F.max("__n").alias("__n"), F.sum(F.col("__w") * F.cos(angle)).alias("__re"), F.sum(F.col("__w") * F.sin(angle)).alias("__im"))
    power = power.select(*key, F.col("__b").cast("long").alias("__b"), "__n", F.sqrt(F.col("__re") ** 2 + F.col("__im") ** 2).alias("__p"))
    if not sound.filter(F.col("__n") > direct).isEmpty():
        # About 4,096 samples a stretch of the series' own axis.
        width = F.greatest((F.col("__to") - F.col("__from")) / (F.col("__n") / 4096), F.lit(1e-300))
        long = rows.filter(F.col("__n") > direct).withColumn("__at", F.col(at).cast("double") - F.col("__from")).withColumn("__width", width)
        placed = running(long, key, "__at", F.col("__width"), ["__at"], {"__k": F.lit(1)}).withColumn("__k", F.col("__k") - 1)
        samples = placed.select(*key, F.col("__k").alias("__j"), "__n", (hann * (F.col("__v") - F.col("__mean"))).alias("__v"))
        far = spectrum(checkpointed(samples), key, low, high).filter("__b >= 1")
        power = checkpointed(power.unionByName(far.select(*key, "__b", "__n", "__p")))
    beside = Window.partitionBy(*key).orderBy("__b")
    power = power.withColumn("__left", F.lag("__p").over(beside)).withColumn("__right", F.lead("__p").over(beside))
    peak = power.groupBy(*key).agg(F.max_by(F.struct("__b", "__n", "__p", "__left", "__right"), F.struct("__p", -F.col("__b"))).alias("t")).select(*key, "t.*")
    inside = (F.col("__left") > 0) & (F.col("__right") > 0) & (F.col("__p") > 0)
    a, b, c = F.log("__left"), F.log("__p"), F.log("__right")
    bend = a - 2 * b + c
    shift = F.when(inside & (bend != 0), 0.5 * (a - c) / bend).otherwise(0.0)
    found = matched(sizes, peak, key, "left")
    failure = F.when(F.col("n") < 8, "too_short").when(F.col("__odd"), "not_finite")
    failure = failure.when(F.col("__b").isNull(), "no_bin_in_band").when(F.col("__p") == 0, "flat").when(F.col("__b") < least_cycles, "too_few_cycles")
    ok = failure.isNull()
    return found.select(*key, "n", F.when(ok, (F.col("__b") + shift) / F.col("__n")).alias("frequency"), F.when(ok, F.col("__p")).alias("power"), failure.alias("failure"))


def illegal_transitions(df: DataFrame, key: Sequence[str], order: Sequence[str], state: str, legal: DataFrame) -> DataFrame:
    """key, previous, state, n of transitions that `legal` (previous, state) does not list."""
    before = F.lag(state).over(Window.partitionBy(*key).orderBy(*order))
    moves = df.select(*key, before.alias("previous"), F.col(state).alias("state")).filter("previous is not null")
    return moves.join(legal, ["previous", "state"], "left_anti").groupBy(*key, "previous", "state").agg(F.count(F.lit(1)).alias("n"))


def monotone_progress(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str, width: int = 86_400) -> DataFrame:
    """df with accepted: values in [0, 1) above all before them; equal or lesser ones are not.

    The greatest value so far is found inside stretches of `width` of the first order column, then among them.
    """
    key = list(key)
    fits = F.when((F.col(value) >= 0) & (F.col(value) < 1), F.col(value))
    rows = df.withColumn("__fits", fits).withColumn("__part", F.floor(F.col(order[0]) / width))
    tops = rows.groupBy(*key, "__part").agg(F.max("__fits").alias("__top"))
    earlier = F.max("__top").over(Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    inside = F.max("__fits").over(Window.partitionBy(*key, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    placed = matched(rows.withColumn("__inside", inside), tops.select(*key, "__part", earlier.alias("__earlier")), [*key, "__part"])
    before = F.coalesce(F.greatest("__inside", "__earlier"), F.lit(-1.0))
    return placed.withColumn("accepted", F.coalesce(F.col("__fits") > before, F.lit(False))).drop("__fits", "__part", "__inside", "__earlier")


def debounced(df: DataFrame, key: Sequence[str], at: str, order: Sequence[str], quiet: float) -> DataFrame:
    """Rows after which nothing of the same key came for `quiet`: the last of each burst.

    What comes within `quiet` lies in the row's own stretch of that length or in the next.
    """
    home = F.floor(F.col(at) / quiet)
    dealt = df.withColumn("__part", F.explode(F.array(home, home - 1)))
    following = F.lead(at).over(Window.partitionBy(*key, "__part").orderBy(at, *order))
    last = dealt.withColumn("__next", following).filter(F.col("__part") == home)
    return last.filter(F.col("__next").isNull() | (F.col("__next") - F.col(at) > quiet)).drop("__next", "__part")


def grid_deltas(df: DataFrame, order: str, values: Sequence[str], partition: Sequence[str]) -> DataFrame:
    """df with the absolute change of each value from the row before, and whether that is less than the change before it."""
    w = Window.partitionBy(*partition).orderBy(order)
    out = df.withColumns({f"{v}_delta": F.abs(F.col(v) - F.lag(v).over(w)) for v in values})
    return out.withColumns({f"{v}_contracts": F.col(f"{v}_delta") < F.lag(f"{v}_delta").over(w) for v in values})


def replay(df: DataFrame, key: Sequence[str], sequence: str, cursor: Column) -> DataFrame:
    """The events after each key's cursor; reading them fails at a cursor that lies ahead of its key's events."""
    last = df.groupBy(*key).agg(F.max(sequence).alias("__last"))
    rows = matched(df.withColumn("__cursor", cursor), last, list(key))
    ahead = F.raise_error(F.concat_ws(" ", F.lit("the cursor lies ahead of the events of"), *[F.col(k).cast("string") for k in key])).cast("boolean")
    return rows.filter(F.when(F.col("__cursor") > F.col("__last"), ahead).otherwise(F.col(sequence) > F.col("__cursor"))).drop("__cursor", "__last")


def future_cursors(df: DataFrame, key: Sequence[str], sequence: str, cursor: Column) -> DataFrame:
    """key, cursor, last: the keys whose cursor lies ahead of their events."""
    said = df.groupBy(*key).agg(F.max(cursor).alias("cursor"), F.max(sequence).alias("last"))
    return said.filter(F.col("cursor") > F.col("last"))


def spans(df: DataFrame, key: Sequence[str], order: Sequence[str], state: str, starts: Sequence[str], terminals: Sequence[str]) -> DataFrame:
    """The start rows of df with terminal, the terminal state that follows before the next start ('open' if none does), and took."""
    w = Window.partitionBy(*key).orderBy(*order)
    rows = df.filter(F.col(state).isin(*starts, *terminals))
    rows = rows.withColumn("__next", F.lead(state).over(w)).withColumn("__at", F.lead(order[0]).over(w)).filter(F.col(state).isin(*starts))
    ended = F.coalesce(F.col("__next").isin(*terminals), F.lit(False))
    said = rows.withColumn("terminal", F.when(ended, F.col("__next")).otherwise("open")).withColumn("took", F.when(ended, F.col("__at") - F.col(order[0])))
    return said.drop("__next", "__at")


def log_steps(df: DataFrame, key: Sequence[str], epoch: str, batches: str, jump: int) -> DataFrame:
    """key, epochs, global_step (the batches summed) and how often the epoch goes on by more than `jump`."""
    before = F.lag(epoch).over(Window.partitionBy(*key).orderBy(epoch))
    rows = df.withColumn("__jumps", F.coalesce(F.col(epoch) - before > jump, F.lit(False)))
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("epochs"), F.sum(batches).alias("global_step"), F.count_if("__jumps").alias("jumps"))
