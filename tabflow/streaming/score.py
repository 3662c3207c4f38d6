"""Apply fitted preparation and models to data as it arrives.

A ``TableCleanerModel`` transform is a projection plus, for high-cardinality label codes,
a stream-static broadcast join, and a fitted ``PipelineModel`` is a chain of projections, so both run unchanged on a
streaming DataFrame. Forward filling along time keeps each entity's last known values as keyed state
(``fill_forward_stream``); a cleaner that also fills backward needs rows that have not come yet and is refused.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tabflow.functions.exprs import col_
from tabflow.operators.clean import TableCleanerModel
from tabflow.sources.tables import nan_to_null


def read_parquet_stream(spark: SparkSession, folder: str, schema: T.StructType, file_glob: str | None = None,
                        max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format("parquet").schema(schema)
    if file_glob:
        reader = reader.option("pathGlobFilter", file_glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return nan_to_null(reader.load(folder))


def fill_forward_stream(stream: DataFrame, cols, entity_cols, order_cols) -> DataFrame:
    """``stream`` with the NULLs of ``cols`` filled by the entity's last known value.

    State per entity: the last known value of every column. Rows of a micro-batch are taken in ``order_cols`` order after all
    rows of earlier micro-batches, so if files come in that order the result is the batch forward fill; rows before an
    entity's first value stay NULL. NULL is an entity of its own. A task holds the rows of one entity in one
    micro-batch, which ``max_files_per_trigger`` bounds."""
    names, cols, entity_cols, order_cols = list(stream.columns), list(cols), list(entity_cols), list(order_cols)
    inner = [f"c{i}" for i in range(len(names))]  # plain names on the way through Python
    fill, keys, order = ([inner[names.index(c)] for c in x] for x in (cols, entity_cols, order_cols))
    schema = T.StructType([T.StructField(i, f.dataType, True) for i, f in zip(inner, stream.schema.fields)])
    state_schema = T.StructType([T.StructField(c, schema[c].dataType, True) for c in fill])

    def run(key, frames, state):
        import pandas as pd
        got = [f for f in frames if len(f)]
        if not got:
            return
        rows = pd.concat(got, ignore_index=True).sort_values(order, kind="stable", na_position="first")
        last = list(state.get) if state.exists else [None] * len(fill)
        for i, c in enumerate(fill):
            filled = rows[c].ffill()
            if last[i] is not None:
                filled = filled.where(filled.notna(), last[i])
            rows[c] = filled
            end = filled.iloc[-1]
            last[i] = None if pd.isna(end) else end.item() if hasattr(end, "item") else end
        state.update(tuple(last))
        yield rows[inner]

    plain = stream.toDF(*inner)
    return plain.groupBy(*keys).applyInPandasWithState(run, schema, state_schema, "append", "NoTimeout").toDF(*names)


def score_stream(model: TableCleanerModel, stream: DataFrame, fitted: PipelineModel | None = None, keep=None) -> DataFrame:
    """The cleaned stream and, with a ``fitted`` model, its output columns (``keep``: the columns to return)."""
    if model.needs_history:
        raise ValueError("this cleaner fills gaps along time in both directions; fill forward with fill_forward_stream and refit without time filling")
    out = model.transform(stream)
    out = fitted.transform(out) if fitted is not None else out
    return out.select(*[col_(c) for c in keep]) if keep else out


def run_available_now(stream: DataFrame, out_path: str, checkpoint: str) -> None:
    """Process everything available, exactly once, into a Parquet sink; restarts resume from
    the checkpoint (executor or driver loss does not duplicate output)."""
    q = (stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
         .outputMode("append").trigger(availableNow=True).start(out_path))
    q.awaitTermination()
