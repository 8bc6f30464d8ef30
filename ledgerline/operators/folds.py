"""Folds over ordered logs that tell something about each row, in time linear in the log, of tables and of streams."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string


def fold_log(log: DataFrame, keys: list[str], order: list[str], inputs: list[str], start: Callable[[], object], step: Callable, outputs: str) -> DataFrame:
    """The rows of ``log`` with the columns ``outputs`` (a DDL schema) that ``step(state, *inputs) -> tuple`` tells of each.

    One shuffle on the keys, then one pass over each partition in the order of
    keys and ``order``. ``start()`` makes the state of a key, which ``step`` may
    change in place; it goes from batch to batch, so a log of any length needs
    memory for its state alone. A task that is run again folds its keys from
    their start. Of a streaming ``log``, each micro-batch's rows are folded in
    that order, and the states of the keys are kept between the batches, so
    every operator made of this fold takes streams as well.
    """
    made = _parse_datatype_string(outputs)
    schema = StructType([*log.schema.fields, *made.fields])
    if log.isStreaming:
        return _fold_stream(log, keys, order, inputs, start, step, schema, made.names)
    kinds = to_arrow_schema(StructType(made.fields))
    ready = log.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches):
        now, state = None, None
        for batch in batches:
            lists = [batch.column(c).to_pylist() for c in (*keys, *inputs)]
            out = []
            for row in zip(*lists, strict=True):
                key = row[: len(keys)]
                if state is None or key != now:
                    now, state = key, start()
                out.append(step(state, *row[len(keys) :]))
            told = zip(*out, strict=True) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(list(x), f.type) for x, f in zip(told, kinds, strict=True)]], names=[*batch.schema.names, *kinds.names])

    return ready.mapInArrow(run, schema)


def _fold_stream(log: DataFrame, keys: list[str], order: list[str], inputs: list[str], start, step, schema: StructType, made: list[str]) -> DataFrame:
    def run(_, frames: Iterator[pd.DataFrame], kept):
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        state = pickle.loads(kept.get[0]) if kept.exists else start()
        none = lambda x: None if x is None or x is pd.NaT or x != x else x
        told = [step(state, *map(none, row)) for row in zip(*[rows[c].tolist() for c in inputs], strict=True)]
        kept.update((pickle.dumps(state),))
        yield rows.assign(**{name: pd.Series(list(x), index=rows.index, dtype=object) for name, x in zip(made, zip(*told, strict=True), strict=True)})

    return log.groupBy(*keys).applyInPandasWithState(run, schema, "state binary", "append", "NoTimeout")


def replay_states(log: DataFrame, keys: list[str], order: list[str], inputs: list[str], start: Callable[[], object], step: Callable, result: Callable, outputs: str, validate: Callable[[object], str | None] | None = None) -> DataFrame:
    """(keys, outputs, code) of each key after its whole log, by a computation of the caller's own.

    ``step(state, *inputs) -> state`` is deterministic; ``result(state)`` gives
    the ``outputs`` (a DDL schema) as a tuple; ``validate(state)`` may refuse a
    final state with a code, and then the outputs are null. One shuffle; memory
    for one state a task.
    """
    made = _parse_datatype_string(outputs)
    schema = StructType([*[log.schema[k] for k in keys], *made.fields, *_parse_datatype_string("code string").fields])
    kinds = to_arrow_schema(schema)
    ready = log.select(*dict.fromkeys([*keys, *order, *inputs])).repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches):
        now, state, out = None, None, []

        def close():
            code = validate(state) if validate else None
            out.append((*now, *(result(state) if code is None else [None] * len(made)), code))

        def told():
            return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*out, strict=True), kinds, strict=True)], names=kinds.names)

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in (*keys, *inputs)], strict=True):
                key = row[: len(keys)]
                if now is None or key != now:
                    if now is not None:
                        close()
                    now, state = key, start()
                state = step(state, *row[len(keys) :])
            if out:
                yield told()
                out = []
        if now is not None:
            close()
            yield told()

    return ready.mapInArrow(run, schema)
