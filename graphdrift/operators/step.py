"""Step operators: cooling plan, displacement length, step scaling, move + clamp."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vec
from ..model import LayoutParams


def cooling_schedule(spark: SparkSession, params: LayoutParams) -> DataFrame:
    """(iteration, temperature): temperature after ``iteration`` steps of the plan."""
    t0 = params.cf * (params.area ** 0.5)
    return spark.range(0, params.iterations + 1).select(
        F.col("id").alias("iteration"),
        ((F.lit(1.0) - F.col("id") / F.lit(float(params.iterations))) * F.lit(t0)).alias("temperature"))


def displacement_length(forces: DataFrame) -> DataFrame:
    return forces.select("id", "dx", "dy", vec.length(F.col("dx"), F.col("dy")).alias("length"))


def step_factor(params: LayoutParams, iteration: int, temperature: float):
    """Scale applied to the total force of a vertex in ``iteration`` (1-based)."""
    if params.step == "temperature_cap":
        return vec.cap_factor(F.col("dx"), F.col("dy"), temperature)
    if params.step == "inverse_iteration":
        return F.lit(10.0 / iteration)
    return F.lit(1.0)


def scaled_step(forces: DataFrame, params: LayoutParams, iteration: int, temperature: float) -> DataFrame:
    """(id, sx, sy): the displacement actually applied."""
    f = step_factor(params, iteration, temperature)
    return forces.select("id", (F.col("dx") * f).alias("sx"), (F.col("dy") * f).alias("sy"))


def bounds_of(params: LayoutParams) -> tuple[float, float, float, float] | None:
    if params.bounds == "center":
        return -params.width / 2, params.width / 2, -params.height / 2, params.height / 2
    if params.bounds == "corner":
        return 0.0, params.width, 0.0, params.height
    return None


def new_position(sx, sy, params: LayoutParams):
    """(x, y) after a step: on the grid of step ``eps``, inside the bounds."""
    nx, ny = vec.on_grid(F.col("x") + sx, params.eps), vec.on_grid(F.col("y") + sy, params.eps)
    b = bounds_of(params)
    return (nx, ny) if b is None else (vec.clamp(nx, b[0], b[1]), vec.clamp(ny, b[2], b[3]))


def move(vertices: DataFrame, steps: DataFrame, params: LayoutParams) -> DataFrame:
    """New position = clamp(p + step); the vertex keeps (-step) in dx, dy so the trail
    can be drawn.  Vertices without a step keep their position and get (0, 0)."""
    j = vertices.select("id", "label", "x", "y").join(steps, "id", "left")
    sx = F.coalesce(F.col("sx"), F.lit(0.0))
    sy = F.coalesce(F.col("sy"), F.lit(0.0))
    nx, ny = new_position(sx, sy, params)
    return j.select("id", "label", nx.alias("x"), ny.alias("y"), (-sx).alias("dx"), (-sy).alias("dy"))
