"""A state recurrence as window expressions: a body that falls, jumps, moves on and meets obstacles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed values of the simulated world.
GRAVITY, JUMP, SPEED, TOLERANCE, TICKS = -0.8, 6.0, 1.0, 0.6, 50
OBSTACLES = ((10.0, -1.0, 2.0), (22.0, 1.0, 5.0), (35.0, -2.0, 1.5))


def simulate(runs: DataFrame, ticks: int = TICKS) -> DataFrame:
    """``runs``: (run, jumps array<int>) -> (run, tick, x, y, vy, score, collided), one row per tick.

    The speed follows from the last jump, the height is its running sum, a collision its running maximum:
    no step looks back further than a window does.
    """
    t = runs.select("run", "jumps", F.explode(F.sequence(F.lit(0), F.lit(ticks - 1))).alias("tick"))
    so_far = Window.partitionBy("run").orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    jumped = F.last(F.when(F.array_contains("jumps", F.col("tick")), F.col("tick")), ignorenulls=True).over(so_far)
    since = F.coalesce(F.col("tick") - F.col("jumped") + 1, F.col("tick") + 1)
    t = t.withColumn("jumped", jumped).withColumn("vy", F.when(F.col("jumped").isNotNull(), JUMP).otherwise(0.0) + since * GRAVITY)
    t = t.withColumns({"x": (F.col("tick") + 1) * SPEED, "y": F.sum("vy").over(so_far)})
    hit = F.lit(False)
    for x, low, high in OBSTACLES:
        hit = hit | ((F.abs(F.col("x") - x) <= TOLERANCE) & F.col("y").between(low - 1e-9, high + 1e-9))
    t = t.withColumn("collided", F.max(hit).over(so_far))
    score = F.sum((~F.col("collided")).cast("int")).over(so_far).cast("int")
    return t.select("run", "tick", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round("vy", 4).alias("vy"), score.alias("score"), "collided")
