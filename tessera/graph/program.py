"""Vertex programs as DataFrame supersteps.

A program says how vertices start, what active ones send along edges, how messages to one vertex combine, and what a
vertex does with the result; run() repeats that until no vertex is active or an iteration limit is reached. State is a
table per superstep; messages are pre-aggregated before their shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.lineage import forget, table, written


class VertexProgram:
    """Subclass and override; columns of the state are free, `id` and `active` are the engine's."""

    def initialize(self, vertices: DataFrame) -> DataFrame:
        """State with a boolean column `active`."""
        raise NotImplementedError

    def before_iteration(self, state: DataFrame, iteration: int) -> DataFrame:
        return state

    def send(self) -> Column:
        """The message that an active vertex sends along an edge, from its state columns and the edge's."""
        raise NotImplementedError

    def combine(self, message: Column) -> Column:
        """A commutative aggregate of the messages to one vertex."""
        return F.min(message)

    def apply(self, message: Column) -> dict[str, Column]:
        """New state columns of a vertex, `active` included; message is null where none came."""
        raise NotImplementedError

    def after_iteration(self, state: DataFrame, iteration: int) -> None:
        return None

    def finalize(self, state: DataFrame) -> DataFrame:
        return state.drop("active")


@dataclass
class Run:
    """What a run gives: the final state, and per iteration how many vertices were active after it."""

    state: DataFrame
    log: list[int] = field(default_factory=list)


def run(program: VertexProgram, vertices: DataFrame, edges: DataFrame, iterations: int | None = None) -> Run:
    edges = written(edges, "edges")
    state = table(program.initialize(vertices), "state")
    out = Run(state)
    step = 0
    active = state.where("active").count()
    while (iterations is None or step < iterations) and active:
        state_ = program.before_iteration(state, step)
        sent = edges.join(state_.where("active").drop("active").withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), program.send().alias("message"))
        came = sent.groupBy("id").agg(program.combine(F.col("message")).alias("message"))
        joined = state_.drop("active").join(came, "id", "left")
        new = program.apply(F.col("message"))
        kept = [new[c].alias(c) if c in new else F.col(c) for c in state_.columns if c not in ("id", "active")]
        last, state = state, table(joined.select("id", *kept, F.coalesce(new["active"], F.lit(False)).alias("active")), "state")
        forget(last)
        active = state.where("active").count()
        out.log.append(active)
        program.after_iteration(state, step)
        step += 1
    out.state = program.finalize(state)
    return out


class MinLabel(VertexProgram):
    """Components of symmetric edges by spreading the smallest id."""

    def initialize(self, vertices: DataFrame) -> DataFrame:
        return vertices.select("id", F.col("id").alias("label"), F.lit(True).alias("active"))

    def send(self) -> Column:
        return F.col("label")

    def apply(self, message: Column) -> dict[str, Column]:
        return {"label": F.least("label", message), "active": message < F.col("label")}
