"""The same filters on a stream. Without positions they keep no state; a position counts the rows of a group as they come."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treesift.operators.select import Selector, condition, is_position
from treesift.plans.ast import UnsupportedFeature
from treesift.shipping import ship


def filter_stream(stream: DataFrame, filters: str | Sequence[str], table: str, **options) -> DataFrame:
    """What the filters let through of a streaming DataFrame; positions need an order and are refused."""
    if options.get("order_by"):
        raise ValueError("a stream has no positions")
    return Selector(filters, table, **options).apply(stream)


def nth_of_stream(stream: DataFrame, text: str, table: str, within: Sequence[str], order_by: Sequence[str] = ()) -> DataFrame:
    """The n-th row of each group of `within` that comes, for a filter such as `a[p][3]`; rows of one micro-batch count in the order of order_by.

    Predicates before the position pick the rows that count; those behind it test the n-th one. A group's state is one number, kept for as long as the query runs.
    """
    selector = Selector(text, table)
    steps = selector.paths[0].steps
    places = [k for k, p in enumerate(steps[0].predicates) if is_position(p)]
    if len(selector.paths) > 1 or len(steps) > 1 or len(places) != 1 or selector.paths[0].negated or not within:
        raise UnsupportedFeature("on a stream: one path of one step with one position, within groups")
    before, n, after = steps[0].predicates[: places[0]], steps[0].predicates[places[0]].value, steps[0].predicates[places[0] + 1 :]
    for p in before:
        stream = stream.where(condition(p, selector._row_frame(stream)))
    names, order = stream.columns, list(order_by)

    def pick(key: tuple, parts: Iterable, state) -> Iterator:
        import pandas as pd

        seen = state.get[0] if state.exists else 0
        rows = pd.concat(list(parts))
        rows = rows.sort_values(order, kind="stable") if order else rows
        if seen < n <= seen + len(rows):
            yield rows.iloc[int(n) - seen - 1 : int(n) - seen][names]
        state.update((seen + len(rows),))

    ship(stream.sparkSession)
    done = stream.groupBy(*[F.col(f"`{c}`") for c in within]).applyInPandasWithState(pick, stream.schema, "seen bigint", "append", "NoTimeout")
    for p in after:
        done = done.where(condition(p, selector._row_frame(done)))
    return done


def run_available(spark: SparkSession, sf_dir: str, table: str, filters: str, out: str, checkpoint: str) -> DataFrame:
    """Stream a table's files through a filter, all that is there now, into Parquet at `out`; the result read back."""
    path = f"{sf_dir}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{table}.parque[t]")
    kept = filter_stream(stream, filters, table)
    kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(kept.schema).parquet(out)
