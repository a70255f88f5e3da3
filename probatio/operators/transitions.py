"""Replay of a state-change log against an allowed-transition table.

A refused step leaves the state alone, so a log must be replayed in order.  One step is a
function on a small set of states, and such functions compose.  The log is cut into ranges
of (key, ts, step_id).  Each range is read once as a stream: keys that begin in it are
replayed from the initial state; for its first key, which may have begun in an earlier
range, every possible state is followed at once.  A prefix scan over the ranges, one row
each, then says in which state the first key of each range really was.

A key that holds most of the log, be it within one second, is spread over as many ranges as
its size asks for.  A task holds the states of one key and one batch of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from probatio import fixed_values as fv
from probatio.profiles import dimension
from probatio.session import cut_lineage

_WALKED = ("key string, ts timestamp, step_id bigint, requested string, part int, place bigint, "
           "inherited boolean, before array<int>, after array<int>")
_FIELDS = [field.split()[0] for field in _WALKED.split(", ")]


def transition_rows(table: dict[str, tuple[str, ...]]) -> list[tuple[str, str]]:
    return [(state, target) for state, targets in table.items() for target in targets]


def _walker(table: dict[str, tuple[str, ...]], initial: str):
    """Follow the rows of one range in order; only the states of one key are held."""
    states = list(table)
    number = {state: i for i, state in enumerate(states)}
    moves = {target: [number[target] if target in table[state] else number[state]
                      for state in states] for target in states}
    every, start = list(range(len(states))), [number[initial]]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, first, key, now = 0, None, None, start
        for batch in batches:
            inherited, before, after = [], [], []
            for at, requested in zip(batch.column("key").to_pylist(),
                                     batch.column("requested").to_pylist()):
                if place == len(inherited) == 0:
                    first, key, now = at, at, every
                elif at != key:
                    key, now = at, start
                step = moves.get(requested)
                then = now if step is None else [step[s] for s in now]
                inherited.append(at == first)
                before.append(now)
                after.append(then)
                now = then
            places = pa.array(range(place, place + len(inherited)), pa.int64())
            place += len(inherited)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("key", "ts", "step_id", "requested", "part")),
                 places, pa.array(inherited, pa.bool_()), pa.array(before, pa.list_(pa.int32())),
                 pa.array(after, pa.list_(pa.int32()))], names=_FIELDS)

    return walk


def _starts(edges: list, initial: int) -> list[tuple[int, int]]:
    """(range, state of its first key) for ranges given in order as (part, first key, last
    key, whether the last key is the first one, states after the last row)."""
    found, state, last = [], initial, object()
    for part, first, final, same, after in edges:
        begun = state if first == last else initial
        found.append((part, begun))
        state, last = after[begun if same else 0], final
    return found


def walked_ranges(log: DataFrame, table: dict[str, tuple[str, ...]],
                  initial: str) -> DataFrame:
    """Every step with the states before and after it, as far as its own range can tell:
    one state, or for the range's first key (``inherited``) one per state it may be in."""
    order = ("key", "ts", "step_id", "requested")
    ranged = log.select(
        F.col("key").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("step_id").cast("bigint").alias("step_id"), "requested",
    ).repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "part", F.spark_partition_id())
    return cut_lineage(ranged.mapInArrow(_walker(table, initial), _WALKED))


def replay(log: DataFrame, table: dict[str, tuple[str, ...]], initial: str) -> DataFrame:
    """Label every step: state before, whether it was allowed, state after.

    ``log``: key, ts, step_id, requested.  An unknown or NULL requested state is refused.
    Steps of one key, time and id follow in the order of what they request.
    """
    states = list(table)
    walked = walked_ranges(log, table, initial)
    # One row per range, as many as there are partitions: small whatever the log.
    edges = walked.groupBy("part").agg(
        F.min_by("key", "place").alias("first"),
        F.max_by(F.struct("key", "inherited", "after"), "place").alias("last"),
    ).select("part", "first", "last.*").orderBy("part").collect()
    starts = dimension(log.sparkSession, _starts(
        [tuple(row) for row in edges], states.index(initial)), "part int, begun int")
    names = F.array(*[F.lit(s) for s in states])
    allowed = [f"{a}>{b}" for a, b in transition_rows(table)]
    at = F.when(F.col("inherited"), F.col("begun")).otherwise(0)
    return walked.join(starts, "part").select(
        "key", "ts", "step_id", "requested",
        F.get(names, F.get("before", at)).alias("state_before"),
        F.get(names, F.get("after", at)).alias("state_after"),
    ).withColumn("allowed", F.coalesce(
        F.concat(F.col("state_before"), F.lit(">"), F.col("requested")).isin(*allowed),
        F.lit(False)))


def audit(steps: DataFrame) -> DataFrame:
    """Final state and refused attempts per key."""
    return steps.groupBy("key").agg(
        F.max_by("state_after", F.struct("ts", "step_id", "requested")).alias("final_state"),
        F.count("*").alias("attempts"),
        F.count_if(~F.col("allowed")).alias("refused"))


def approval_audit(log: DataFrame) -> DataFrame:
    return audit(replay(log, fv.APPROVAL_TRANSITIONS, "PENDING"))


def publication_audit(log: DataFrame) -> DataFrame:
    return audit(replay(log, fv.PUBLICATION_TRANSITIONS, "DRAFT"))
