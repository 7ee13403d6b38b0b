"""Structured Streaming: capture gaps and greedy thinning as stateful operators."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema, files_a_trigger: int = 1) -> DataFrame:
    """A stream of Parquet files, a bounded number a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def thin_stream(rows: DataFrame, group: str, order: str, position: str, threshold: float) -> DataFrame:
    """The rows that greedy thinning keeps, with the anchor as state; rows of a group must
    come in order, within a trigger they are sorted."""
    import pandas as pd

    kinds = dict(rows.dtypes)

    def step(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        anchor = state.get[0] if state.exists else None
        part = pd.concat(list(parts)).sort_values(order, kind="stable")
        keep = []
        for i, p in zip(part[order], part[position], strict=True):
            if anchor is None or abs(p - anchor) >= threshold:
                keep.append(i)
                anchor = float(p)
        state.update((anchor,))
        yield pd.DataFrame({group: key[0], order: keep}) if keep else pd.DataFrame({group: pd.Series(dtype=part[group].dtype), order: pd.Series(dtype=part[order].dtype)})

    out = f"{group} {kinds[group]}, {order} {kinds[order]}"
    return rows.select(group, order, position).groupBy(group).applyInPandasWithState(step, out, "anchor double", "append", "NoTimeout")


def gap_stream(rows: DataFrame, group: str, index: str) -> DataFrame:
    """Jumps of the capture index, with the largest index so far as state: group, after,
    index, n_dropped. A row at or below it comes late and changes nothing: the jump over it
    was told when the rows after it came, and stays told."""
    import pandas as pd

    kinds = dict(rows.dtypes)

    def step(key, parts, state):
        last = state.get[0] if state.exists else None
        found = []
        for i in sorted(int(x) for part in parts for x in part[index]):
            if last is not None and i - last > 1:
                found.append((key[0], last, i, i - last - 1))
            last = i if last is None else max(last, i)
        state.update((last,))
        yield pd.DataFrame(found, columns=[group, "after", index, "n_dropped"])

    return rows.select(group, index).groupBy(group).applyInPandasWithState(step, f"{group} {kinds[group]}, after long, {index} long, n_dropped long", "last long", "append", "NoTimeout")


def windowed_counts(rows: DataFrame, time: str, label: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per tumbling window and label under a watermark."""
    kind = dict(rows.dtypes)[time]
    w = rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width).alias("w"), label)
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").cast(kind).alias("start"), label, "n", "total")


def run_to_table(stream: DataFrame, folder: str) -> DataFrame:
    """All that is there now, appended to a table in ``folder`` beside its checkpoint;
    started again with the same folder, it goes on where it ended."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
