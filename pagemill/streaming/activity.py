"""Reading activity and provider calls as streams."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagemill.operators.library import FIRST_PAGES, PAGES_AT_ONCE


def reading_sessions(events: DataFrame, idle: str = "2 minutes", late: str = "1 hour") -> DataFrame:
    """user_id, start, end, seconds, events: sessions that a pause of ``idle`` ends.

    ``events`` has user_id and ts (timestamp); rows later than ``late`` are out.
    """
    by = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", idle).alias("s"))
    out = by.agg(F.count("*").alias("events"), F.min("ts").alias("start"), F.max("ts").alias("end"))
    return out.select("user_id", "start", "end", (F.unix_timestamp("end") - F.unix_timestamp("start")).alias("seconds"), "events")


def daily_characters(events: DataFrame, late: str = "1 day") -> DataFrame:
    """user_id, day, chars of forward moves; ``events`` has user_id, ts and moved."""
    by = events.withWatermark("ts", late).groupBy("user_id", F.window("ts", "1 day").alias("d"))
    return by.agg(F.sum(F.when(F.col("moved").between(1, 19_999), F.col("moved")).otherwise(0)).alias("chars")).select("user_id", F.to_date("d.start").alias("day"), "chars")


def breaker(calls: DataFrame, limit: int = 4) -> DataFrame:
    """key, seq, streak, open: a breaker per key, open for good after ``limit`` failures in a row.

    ``calls`` has key, seq and ok.
    """

    def run(key, batches, state: GroupState):
        streak, latched = state.get if state.exists else (0, False)
        for pdf in batches:
            pdf = pdf.sort_values("seq")
            rows = []
            for seq, ok in zip(pdf["seq"], pdf["ok"]):
                streak = 0 if ok else streak + 1
                latched = latched or streak >= limit
                rows.append((key[0], int(seq), streak, latched))
            yield pd.DataFrame(rows, columns=["key", "seq", "streak", "open"])
        state.update((streak, latched))

    return calls.groupBy("key").applyInPandasWithState(run, "key long, seq long, streak long, open boolean", "streak long, latched boolean", "append", GroupStateTimeout.NoTimeout)


def rebuilds(steps: DataFrame) -> DataFrame:
    """key, seq, done, rebuild: ``library.rebuild_triggers`` as steps arrive, with two counters a book.

    Steps of a book must come in their order; those of one batch are put in order.
    """

    def run(key, batches, state: GroupState):
        done, since = state.get if state.exists else (0, 0)
        rows = []
        for seq, kind in pd.concat(list(batches)).sort_values("seq")[["seq", "kind"]].itertuples(index=False):
            page = kind == "page"
            done, since = done + page, since + 1 if page else 0
            rebuild = not page or done <= FIRST_PAGES or since >= PAGES_AT_ONCE
            since = 0 if rebuild else since
            rows.append((key[0], int(seq), done, rebuild))
        state.update((done, since))
        yield pd.DataFrame(rows, columns=["key", "seq", "done", "rebuild"])

    return steps.groupBy("key").applyInPandasWithState(run, "key long, seq long, done long, rebuild boolean", "done long, since long", "append", GroupStateTimeout.NoTimeout)


def rebuild_on_arrival(pages: DataFrame, pages_path: str, rebuild: Callable[[DataFrame], None], checkpoint: str):
    """Starts the job that stores arriving pages and rebuilds the content of the books they touch.

    The pages of a batch replace earlier ones of the same (book, page) when
    read; ``rebuild`` gets all pages of the touched books.
    """

    def on_batch(df: DataFrame, epoch: int) -> None:
        df.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(pages_path)
        touched = df.select("book").distinct()
        stored = df.sparkSession.read.parquet(pages_path).join(touched, "book", "left_semi")
        fields = [c for c in stored.columns if c not in ("book", "page")]
        latest = stored.groupBy("book", "page").agg(F.max_by(F.struct(*fields), "epoch").alias("v")).select("book", "page", "v.*").drop("epoch")
        rebuild(latest)

    return pages.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
