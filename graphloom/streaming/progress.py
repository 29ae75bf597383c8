"""Job progress: percentages that never fall, and logs without repeats; as a batch, and on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEEP = 240
STATE = "percent double, last string, lines long"
OUT = "job string, percent double, line string, number long"


def log_dedup(logs: DataFrame, job: str = "job", order: str = "seq", line: str = "line") -> DataFrame:
    """Rows whose line differs from the job's line before, with the running maximum of ``percent``."""
    w = Window.partitionBy(job).orderBy(order)
    highest = F.max("percent").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = logs.withColumns({"before": F.lag(line).over(w), "percent": highest})
    return marked.where(~F.col(line).eqNullSafe(F.col("before")) | F.col("before").isNull()).drop("before")


def newest(logs: DataFrame, job: str = "job", order: str = "seq", keep: int = KEEP) -> DataFrame:
    """A job's last ``keep`` lines."""
    return logs.withColumn("r", F.row_number().over(Window.partitionBy(job).orderBy(F.desc(order)))).where(F.col("r") <= keep).drop("r")


def _step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    percent, last, number = state.get if state.exists else (0.0, None, 0)
    out = []
    for frame in frames:
        for row in frame.sort_values("seq").itertuples():
            percent = max(percent, row.percent)
            if row.line != last:
                number, last = number + 1, row.line
                out.append((key[0], percent, row.line, number))
    state.update((percent, last, number))
    yield pd.DataFrame(out, columns=["job", "percent", "line", "number"])


def stream_log_dedup(logs: DataFrame) -> DataFrame:
    """The same on a stream (job, seq, percent, line), with the state of each job kept between batches."""
    return logs.groupBy("job").applyInPandasWithState(_step, OUT, STATE, "append", "NoTimeout")


def keyed_updates(stream: DataFrame, path: str, checkpoint: str):
    """Appends each batch of a facts stream to a table; a batch that is run again replaces its own part."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
