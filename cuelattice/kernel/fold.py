"""Order-dependent folds, for steps that need the last *accepted* state.

Rows are hash-partitioned by key, sorted inside the partition and streamed
through a small Python step with constant memory. A key with more rows than
``chunk_rows`` is cut into row chunks: every chunk is folded in parallel from
the best known incoming state, and folding repeats for chunks whose incoming
state changed until nothing changes. The result equals the sequential fold.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuelattice.kernel.scan import Running, gathered, is_hot, running
from cuelattice.session import cut_lineage

# step(state, row) -> (state, outputs); state is JSON-safe or None, row is a dict-free tuple
Step = Callable[[Any, tuple], tuple[Any, list]]
Finish = Callable[[Any], list]

CHUNK_ROWS = 1_000_000


class Effect(NamedTuple):
    """What a run of rows does to the state it meets. Effects are JSON-safe and of bounded size.

    ``absorb(effect, row)`` adds one row behind a run; ``apply(effect, state)`` is the state behind the run.
    """

    identity: Any
    absorb: Callable[[Any, tuple], Any]
    apply: Callable[[Any, Any], Any]


def _runner(keys: int, step: Step, finish: Finish | None, columns: list[str]):
    """Iterate sorted batches; a new key resets the state."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            out: list = []
            for row in batch.itertuples(index=False, name=None):
                key = row[:keys]
                if key != current:
                    if current is not None and finish is not None:
                        out.extend(current + tuple(o) for o in finish(state))
                    current, state = key, None
                state, emitted = step(state, row[keys:])
                out.extend(key + tuple(o) for o in emitted)
            yield pd.DataFrame(out, columns=columns)
        if current is not None and finish is not None:
            yield pd.DataFrame([current + tuple(o) for o in finish(state)], columns=columns)

    return run


def _chunk_runner(keys: int, step: Step, finish: Finish | None, columns: list[str], emit: bool):
    """Like ``_runner`` with (chunk, is_last, state_in) after the keys; emits rows or the outgoing state."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, last = None, None, False

        def close() -> list:
            if current is None:
                return []
            if not emit:
                return [current + (json.dumps(state),)]
            return [current[:-1] + tuple(o) for o in finish(state)] if last and finish is not None else []

        for batch in batches:
            out: list = []
            for row in batch.itertuples(index=False, name=None):
                key = row[: keys + 1]
                if key != current:
                    out.extend(close())
                    last, seed = bool(row[keys + 1]), row[keys + 2]
                    current, state = key, json.loads(seed) if isinstance(seed, str) else None
                state, emitted = step(state, row[keys + 3 :])
                if emit:
                    out.extend(key[:-1] + tuple(o) for o in emitted)
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame(close(), columns=columns)

    return run


def _carrier(keys: int, effect: Effect, columns: list[str]):
    """Rows (keys, chunk, effect of the chunk) in order become (keys, chunk, state that the chunk meets)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name=None):
                if row[:keys] != current:
                    current, state = row[:keys], None
                out.append((*row[: keys + 1], json.dumps(state)))
                state = effect.apply(json.loads(row[keys + 1]), state)
            yield pd.DataFrame(out, columns=columns)

    return run


def ordered_fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    inputs: Sequence[str],
    step: Step,
    output: Sequence[T.StructField],
    finish: Finish | None = None,
    chunk: Column | None = None,
    chunk_rows: int = CHUNK_ROWS,
    effect: Effect | None = None,
    in_place: bool = False,
) -> DataFrame:
    """Fold each key's rows in ``order``. ``step`` sees the ``inputs`` columns as a tuple.

    ``chunk`` (monotone along ``order``) is used to number the rows of huge keys
    without one task seeing them all; without it the first order column is used.
    With an ``effect`` the chunks of a huge key take two passes, however many they are. ``in_place`` says that the rows come
    from a scan over some of the keys; where it was a plain window, small keys are folded where they lie.
    """
    keys, order, inputs = list(keys), list(order), list(inputs)
    key_fields = [df.schema[k] for k in keys]
    schema = T.StructType([*key_fields, *output])
    columns = [f.name for f in schema.fields]
    needed = df.select(*dict.fromkeys([*keys, *order, *inputs]))

    if not is_hot(df, keys, chunk_rows):
        together = needed if in_place and gathered() else needed.repartition(*keys)
        ready = together.sortWithinPartitions(*keys, *order).select(*keys, *inputs)
        return ready.mapInPandas(_runner(len(keys), step, finish, columns), schema)

    needed = cut_lineage(needed)
    huge = needed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > chunk_rows)
    small = needed.join(huge, keys, "left_anti")
    ready = small.repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, *inputs)
    cold = ready.mapInPandas(_runner(len(keys), step, finish, columns), schema)

    spread = F.floor(F.col(order[0]) / F.lit(60_000)) if chunk is None else chunk
    numbered = running(
        needed.join(huge.select(*keys), keys), keys, order, [Running("__rn", "count", F.lit(1))], spread
    ).withColumn("__c", F.floor((F.col("__rn") - 1) / chunk_rows))
    rows = cut_lineage(numbered.drop("__rn"))
    bounds = rows.groupBy(*keys).agg(F.max("__c").alias("__top"))
    chunks = rows.select(*keys, "__c").distinct().join(bounds, keys)
    states = cut_lineage(
        chunks.select(*keys, "__c", (F.col("__c") == F.col("__top")).alias("__last"), F.lit(None).cast("string").alias("__in"))
    )
    state_schema = T.StructType([*key_fields, T.StructField("__c", T.LongType()), T.StructField("__out", T.StringType())])
    state_columns = [f.name for f in state_schema.fields]

    def fold(active: DataFrame, emit: bool, step: Step = step) -> DataFrame:
        joined = rows.join(active, [*keys, "__c"]).repartition(*keys, "__c")
        fed = joined.sortWithinPartitions(*keys, "__c", *order).select(*keys, "__c", "__last", "__in", *inputs)
        runner = _chunk_runner(len(keys), step, finish, columns if emit else state_columns, emit)
        return fed.mapInPandas(runner, schema if emit else state_schema)

    if effect is not None:
        whole = fold(states, False, lambda total, row: (effect.absorb(effect.identity if total is None else total, row), []))
        along = whole.repartition(*keys).sortWithinPartitions(*keys, "__c").mapInPandas(
            _carrier(len(keys), effect, [*state_columns[:-1], "__in"]), T.StructType([*state_schema.fields[:-1], T.StructField("__in", T.StringType())]))
        met = cut_lineage(states.drop("__in").join(along, [*keys, "__c"]).select(*keys, "__c", "__last", "__in"))
        return cold.unionByName(fold(met, emit=True))

    changed = states
    outcome = None
    while changed.take(1):
        fresh = fold(changed, emit=False)
        if outcome is not None:
            fresh = fresh.unionByName(outcome.join(fresh.select(*keys, "__c"), [*keys, "__c"], "left_anti"))
        outcome = cut_lineage(fresh)
        incoming = outcome.select(*keys, (F.col("__c") + 1).alias("__c"), F.col("__out").alias("__new"))
        compared = states.join(incoming, [*keys, "__c"], "left")
        compared = cut_lineage(
            compared.select(
                *keys, "__c", "__last", F.col("__new").alias("__in"), (~F.col("__new").eqNullSafe(F.col("__in"))).alias("__diff")
            )
        )
        states = compared.drop("__diff")
        changed = compared.where("__diff").drop("__diff")
    return cold.unionByName(fold(states, emit=True))
