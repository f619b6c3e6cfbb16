"""Data model: a property graph held as two DataFrames, plus layout parameters."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

VERTEX_SCHEMA = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("label", T.StringType(), True),
    T.StructField("x", T.DoubleType(), True),
    T.StructField("y", T.DoubleType(), True),
    T.StructField("dx", T.DoubleType(), True),
    T.StructField("dy", T.DoubleType(), True),
])

EDGE_SCHEMA = T.StructType([
    T.StructField("src", T.LongType(), False),
    T.StructField("dst", T.LongType(), False),
    T.StructField("weight", T.DoubleType(), True),
])

VERTEX_COLUMNS = [f.name for f in VERTEX_SCHEMA.fields]
EDGE_COLUMNS = [f.name for f in EDGE_SCHEMA.fields]

# Label given to ids that occur only in edges.
DEFAULT_LABEL = "NONODE"


def check_columns(df: DataFrame, required: list[str], what: str) -> None:
    """Schema check at operator entry (analysis only, no job)."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns {missing}; has {df.columns}")


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame

    def __post_init__(self):
        check_columns(self.vertices, ["id", "x", "y"], "vertices")
        check_columns(self.edges, ["src", "dst"], "edges")

    def with_vertices(self, vertices: DataFrame) -> "Graph":
        return Graph(vertices, self.edges)


@dataclass(frozen=True)
class LayoutParams:
    """Every constant of the layout.  Defaults follow the newest distributed variant."""

    width: float = 10000.0
    height: float = 10000.0
    kf: float = 0.8                 # k = kf * sqrt(area / n)
    eps: float = 1e-4               # minimal distance
    cf: float = 0.1                 # initial temperature = cf * sqrt(area)
    rep_scale: float = 0.01
    attr_scale: float = 1.0
    gravity: float = 0.0
    iterations: int = 20            # length of the cooling plan
    max_iterations: int | None = None   # stop early on the same plan
    step: str = "temperature_cap"   # temperature_cap | inverse_iteration | unit
    bounds: str = "center"          # center | corner | none
    repulsion: str = "all"          # all | radius | neighbors | none
    radius: float | None = None     # for repulsion="radius"
    attraction: str = "both"        # both | target
    weighted: bool = False          # multiply attraction by the edge weight
    links: str = "join"             # join: links meet positions by id | blocks: dealt once (operators/blocks.py)
    block_links: int = 1 << 17      # for links="blocks"
    seed: int = 0

    def __post_init__(self):
        if self.step not in ("temperature_cap", "inverse_iteration", "unit"):
            raise ValueError(f"unknown step {self.step}")
        if self.bounds not in ("center", "corner", "none"):
            raise ValueError(f"unknown bounds {self.bounds}")
        if self.repulsion not in ("all", "radius", "neighbors", "none"):
            raise ValueError(f"unknown repulsion {self.repulsion}")
        if self.repulsion == "radius" and not (self.radius and self.radius > 0):
            raise ValueError("repulsion='radius' needs a positive radius")
        if self.attraction not in ("both", "target"):
            raise ValueError(f"unknown attraction {self.attraction}")
        if self.links not in ("join", "blocks"):
            raise ValueError(f"unknown links {self.links}")
        if self.block_links < 1:
            raise ValueError("block_links must be positive")

    @property
    def area(self) -> float:
        return self.width * self.height

    @property
    def rounds(self) -> int:
        m = self.iterations if self.max_iterations is None else self.max_iterations
        return min(m, self.iterations)

    def ideal_length(self, n: int) -> float:
        return self.kf * math.sqrt(self.area / max(n, 1))

    def temperature(self, done: int) -> float:
        """Temperature after ``done`` iterations of the cooling plan (0 = initial)."""
        return (1.0 - done / self.iterations) * self.cf * math.sqrt(self.area)

    def but(self, **kw) -> "LayoutParams":
        return replace(self, **kw)
