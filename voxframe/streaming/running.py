"""Running Dice sums and run monitors on streams.

The sums are Spark's own streaming aggregation, written batch by batch into a folder
named after the batch, so that a repeated batch replaces itself. The monitors depend
on the order of epochs: a run's rows wait in its state until the epochs before them
have come, so rows may arrive late and in any order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..operators.overlap import fast_dice_sums, finish_fast_dice

# states that runs are dealt to
BUCKETS = 4096
SUMS = ("inter_hard", "pred_hard", "inter_soft", "pred_soft", "gt_sum")


def running_sums(stream: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per case the sums so far; rows of a busy case are added up in every task first."""
    return stream.groupBy("case_id").agg(*fast_dice_sums(threshold))


def latest_dice(rows: DataFrame) -> DataFrame:
    """Hard and soft Dice per case from the last written sums."""
    newest = rows.groupBy("case_id").agg(F.max_by(F.struct(*SUMS), "version").alias("s")).select("case_id", "s.*")
    return finish_fast_dice(newest)


def run_events(stream: DataFrame, patience: int = 10, min_delta: float = 1e-4, min_epochs: int = 15,
               min_peak: float = 0.10, collapse_patience: int = 3, tolerance: float = 1e-6, first_epoch: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """One ``(run_id, reason, epoch)`` row when a run first stops early or collapses.

    Rows carry ``run_id, epoch, score``; epochs count on from ``first_epoch``. The state
    of a run holds the rows that are ahead of a gap, a row that came before is ignored,
    and an epoch that never comes holds the run's events back. Runs are dealt to
    ``buckets`` states by a hash, since a state costs far more than a run in it; the
    number must stay the same while a checkpoint lives.
    """
    def follow(run: list, rows: dict) -> list[tuple[str, int]]:
        due, best, counter, armed, zeros, stopped, collapsed = run
        found = []
        while due in rows:
            score = rows.pop(due)
            if score > best + min_delta:
                best, counter = score, 0
            else:
                counter += 1
                if not stopped and counter >= patience and due >= min_epochs:
                    stopped = True
                    found.append(("early_stop", due))
            armed = armed or score > min_peak
            if armed:
                zeros = zeros + 1 if score <= tolerance else 0
                if not collapsed and zeros >= collapse_patience:
                    collapsed = True
                    found.append(("collapsed", due))
            due += 1
        run[:] = due, best, counter, armed, zeros, stopped, collapsed
        return found

    def update(key, frames, state):
        runs, waiting, changed = {}, {}, {}
        if state.exists:
            names, *known, epochs, scores = state.get
            for name, e, s, *run in zip(names, epochs, scores, *known):
                runs[name], waiting[name] = run, dict(zip(e, s))
        for pdf in frames:
            for name, epoch, score in zip(pdf["run"].tolist(), pdf["epoch"].tolist(), pdf["score"].tolist()):
                if name not in runs:
                    runs[name], waiting[name] = [first_epoch, -np.inf, 0, False, 0, False, False], {}
                changed[name] = True
                if epoch >= runs[name][0]:
                    waiting[name].setdefault(epoch, score)
        found = [(name, reason, epoch) for name in changed for reason, epoch in follow(runs[name], waiting[name])]
        held = [sorted(waiting[name]) for name in runs]
        columns = [list(c) for c in zip(*runs.values())]
        columns[1] = [float(best) for best in columns[1]]
        state.update((list(runs), *columns, held, [[float(waiting[name][e]) for e in own] for name, own in zip(runs, held)]))
        if found:
            yield pd.DataFrame(found, columns=["run", "reason", "epoch"])

    kind = stream.schema["run_id"].dataType.simpleString()
    # as text, a missing run does not turn the others into doubles
    rows = stream.select(F.pmod(F.xxhash64("run_id"), F.lit(buckets)).alias("bucket"), F.col("run_id").cast("string").alias("run"), F.col("epoch").cast("int").alias("epoch"), F.col("score").cast("double").alias("score"))
    events = rows.groupBy("bucket").applyInPandasWithState(
        update, "run string, reason string, epoch int",
        "runs array<string>, due array<int>, best array<double>, counter array<int>, armed array<boolean>, zeros array<int>, stopped array<boolean>, collapsed array<boolean>, "
        "epochs array<array<int>>, scores array<array<double>>",
        "append", GroupStateTimeout.NoTimeout,
    )
    return events.select(F.col("run").cast(kind).alias("run_id"), "reason", "epoch")


def _finish(query, timeout: int | None) -> None:
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError("stream did not finish")


def run_updates(result: DataFrame, path: str, timeout: int | None = None) -> DataFrame:
    """Process what is available of an aggregation, each batch's changed rows into a folder ``version=<batch>`` of their own.

    A batch that is repeated after a failure overwrites its folder. Reads the folders back.
    """
    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/version={batch}")

    query = result.writeStream.outputMode("update").option("checkpointLocation", f"{path}/_state").trigger(availableNow=True).foreachBatch(write).start()
    _finish(query, timeout)
    schema = result.schema.add("version", "long")
    return result.sparkSession.read.schema(schema).parquet(f"{path}/rows")


def run_to_files(result: DataFrame, path: str, timeout: int | None = None) -> DataFrame:
    """Process what is available, then read the sink back; ``timeout`` in seconds, none by default."""
    query = result.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/_state").trigger(availableNow=True).start(f"{path}/rows")
    _finish(query, timeout)
    return result.sparkSession.read.schema(result.schema).parquet(f"{path}/rows")
