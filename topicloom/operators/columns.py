"""Operators on whole tables: scaling but some columns, observing, outcome columns, chaining."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import partial, reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.functions.binding import computed


@dataclass(frozen=True)
class Scaler:
    """Standardises all columns but the ignored ones, which pass through."""

    ignore: tuple[str, ...]
    mean: dict[str, float]
    scale: dict[str, float]

    def _columns(self, df: DataFrame) -> list[str]:
        # In name order, as the fitted stage sees them.
        return sorted(set(df.columns) - set(self.ignore))

    def _mapped(self, df: DataFrame, change: Callable[[str], Column]) -> DataFrame:
        touched = set(self._columns(df))
        return df.select(*[change(c).alias(c) if c in touched else F.col(c) for c in df.columns])

    def transform(self, df: DataFrame) -> DataFrame:
        return self._mapped(df, lambda c: (F.col(c) - self.mean[c]) / self.scale[c])

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        return self._mapped(df, lambda c: F.col(c) * self.scale[c] + self.mean[c])


def fit_scaler(df: DataFrame, ignore: Sequence[str] = ()) -> Scaler:
    """One aggregation; the driver receives two numbers per column.

    A constant column is only centred.
    """
    names = sorted(set(df.columns) - set(ignore))
    row = df.agg(
        *[F.avg(c).alias(f"m_{c}") for c in names],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in names],
    ).first()
    return Scaler(
        tuple(ignore), {c: row[f"m_{c}"] for c in names}, {c: row[f"s_{c}"] or 1.0 for c in names}
    )


def project_except(
    df: DataFrame, stage: Callable[[DataFrame], DataFrame], ignore: Sequence[str], row_id: str
) -> DataFrame:
    """Run any table-to-table stage on all columns but the ignored ones.

    The stage gets ``row_id`` first and then its columns in name order, and must keep ``row_id``.
    """
    names = sorted(set(df.columns) - set(ignore) - {row_id})
    changed = stage(df.select(row_id, *names))
    kept = df.select(row_id, *[c for c in df.columns if c in set(ignore) - {row_id}])
    return kept.join(changed, row_id)


def drop_columns(df: DataFrame, *columns: str) -> DataFrame:
    """Undo an operator that added columns."""
    return df.drop(*columns)


def observe(df: DataFrame, name: str, *exprs: Column) -> tuple[DataFrame, Observation]:
    """Record aggregates of the rows that flow past; read them after the first action."""
    observation = Observation(name)
    return df.observe(observation, *exprs), observation


def process_json(df: DataFrame, column: str, schema: T.StructType | str) -> DataFrame:
    """Parse JSON text into ``value`` with the outcome in ``successful`` and ``error``.

    No row fails the job: broken text gives a null value and a message.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    corrupt = "_corrupt"
    full = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    parsed = F.from_json(
        F.col(column), full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}
    )
    marked = df.withColumn("__parsed", parsed)
    good = F.col("__parsed").isNotNull() & F.col(f"__parsed.{corrupt}").isNull()
    value = F.struct(*[F.col(f"__parsed.{f.name}").alias(f.name) for f in schema.fields])
    return (
        marked.withColumn("successful", good)
        .withColumn("value", F.when(good, value))
        .withColumn("error", F.when(~good, F.lit("malformed JSON")))
        .drop("__parsed")
    )


#: A value, whether it was made, and what went wrong otherwise.
Outcome = tuple[Any, bool, str | None]


def _failed(problem: BaseException) -> Outcome:
    return None, False, f"{type(problem).__name__}: {problem}"


def ask_one_by_one(function: Callable[[Any], Any], items: Sequence[Any]) -> list[Outcome]:
    """Outcome of each item; an exception ends only its own item."""
    results = []
    for item in items:
        try:
            results.append((function(item), True, None))
        except Exception as problem:  # the outcome is the report
            results.append(_failed(problem))
    return results


def ask_together(function: Callable[[list[Any]], Sequence[Any]], items: Sequence[Any]) -> list[Outcome]:
    """Outcome of each item when the function takes all of them in one call.

    A call that fails, or gives another number of answers than it got items, is made again for
    either half, down to single items: one bad item among ``n`` costs about ``2 log n`` calls and no other
    item's answer. An answer that is an exception fails its own item without another call.
    """
    if not items:
        return []
    try:
        answers = list(function(list(items)))
        if len(answers) != len(items):
            raise ValueError(f"{len(answers)} answers to {len(items)} items")
    except Exception as problem:  # the outcome is the report
        if len(items) == 1:
            return [_failed(problem)]
        half = len(items) // 2
        return ask_together(function, items[:half]) + ask_together(function, items[half:])
    return [_failed(a) if isinstance(a, BaseException) else (a, True, None) for a in answers]


def batches_of_like_length(lengths: Sequence[int], size: int, padded: int | None = None) -> list[list[int]]:
    """Places of items, in batches of at most ``size`` by rising length.

    A batch is as long as its longest item for each of its items; ``padded`` limits that product. An
    item longer than that is alone.
    """
    if size < 1:
        raise ValueError("a batch has at least one item")
    found: list[list[int]] = []
    for place in sorted(range(len(lengths)), key=lambda i: (lengths[i], i)):
        last = found[-1] if found else []
        fits = padded is None or lengths[place] * (len(last) + 1) <= padded
        if last and len(last) < size and fits:
            last.append(place)
        else:
            found.append([place])
    return found


def _with_outcomes(
    df: DataFrame, column: str, run: Callable[[], Callable[[list[Any]], list[Outcome]]], out: str, value_type: str
) -> DataFrame:
    """Add what ``run``'s function makes of each item. Only this column goes to Python, and no row is
    asked twice by the plan."""

    def outcomes(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        function = run()
        for batch in batches:
            results = function(list(batch))
            values, good, errors = zip(*results, strict=True) if results else ((), (), ())
            yield pd.DataFrame(
                {
                    "value": pd.Series(values, dtype=object),
                    "successful": pd.Series(good, dtype=bool),
                    "error": pd.Series(errors, dtype=object),
                }
            )

    outcomes.__annotations__ = {
        "batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]
    }
    kind = f"value {value_type}, successful boolean, error string"
    ask = F.pandas_udf(outcomes, kind).asNondeterministic()
    kept = [c for c in df.columns if c not in (out, "successful", "error")]
    asked = computed(df, "__item", F.col(column)).withColumn("__outcome", ask("__item"))
    return asked.select(
        *kept,
        F.col("__outcome.value").alias(out),
        F.col("__outcome.successful").alias("successful"),
        F.col("__outcome.error").alias("error"),
    )


def per_row(
    df: DataFrame,
    column: str,
    make: Callable[[], Callable[[Any], Any]],
    out: str = "value",
    value_type: str = "string",
) -> DataFrame:
    """Apply a Python function to a column; adds ``out``, ``successful`` and ``error``.

    ``make`` builds the function, once per task. An exception ends only its own row.
    """

    def run() -> Callable[[list[Any]], list[Outcome]]:
        return partial(ask_one_by_one, make())

    return _with_outcomes(df, column, run, out, value_type)


def per_batch(
    df: DataFrame,
    column: str,
    make: Callable[[], Callable[[list[Any]], Sequence[Any]]],
    size: int,
    length: Callable[[Any], int] = len,
    padded: int | None = None,
    out: str = "value",
    value_type: str = "string",
) -> DataFrame:
    """As :func:`per_row` with a function that takes a list of items and gives a list of answers.

    Items of like ``length`` go together, ``size`` at most and no more than ``padded`` in all when padded to
    the longest. A bad item fails alone, see :func:`ask_together`. Missing items have no length and
    go first.
    """

    def run() -> Callable[[list[Any]], list[Outcome]]:
        function = make()

        def ask(items: list[Any]) -> list[Outcome]:
            results: list[Any] = [None] * len(items)
            lengths = [0 if item is None else length(item) for item in items]
            for places in batches_of_like_length(lengths, size, padded):
                for place, outcome in zip(places, ask_together(function, [items[i] for i in places]), strict=True):
                    results[place] = outcome
            return results

        return ask

    return _with_outcomes(df, column, run, out, value_type)


def process_all(
    df: DataFrame,
    column: str,
    process: Callable[[Any], Any],
    post: Sequence[Callable[[Any], Any]] = (),
    value_type: str = "string",
) -> DataFrame:
    """A Python function and its post-steps on a column, one outcome per row."""

    def whole(item: Any) -> Any:
        return reduce(lambda value, step: step(value), post, process(item))

    return per_row(df, column, lambda: whole, value_type=value_type)


@dataclass(frozen=True)
class Step:
    """A post-processing step with the columns it needs and the ones it adds."""

    apply: Callable[[DataFrame], DataFrame]
    requires: frozenset[str] = frozenset()
    sets: frozenset[str] = frozenset()


def chain(df: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """Run steps in order; missing columns are reported before any job starts."""
    known = set(df.columns)
    for number, step in enumerate(steps):
        missing = step.requires - known
        if missing:
            raise ValueError(f"step {number} needs {sorted(missing)}")
        known |= step.sets
    return reduce(lambda d, step: d.transform(step.apply), steps, df)
