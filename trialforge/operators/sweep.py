"""Sweep line over calls: starts and ends as +1 and -1 in the order of time, running sums, no pairs.

swept() gives each start and end of a call the number of starts and of ends before it, in its run; calls that end at a
moment end before those that start then, so touching calls do not overlap. Everything else is read from it: how many
calls a call overlaps, how busy a run is, the largest groups that run at once, and connected stretches. Running sums and
neighbours go over ranges of time, so a run of any size is many tasks.

Calls without a start or an end, and those that do not last, are left out; null run ids are one run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trialforge.operators.prefix import along, followed
from trialforge.sources.scratch import stored

#: Order of events: by time, ends first, then by call.
ORDER = ["at_us", "begins", "trace_id"]


def events(traces: DataFrame) -> DataFrame:
    """run_id, trace_id, at_us, begins: two events for each call."""
    lasting = traces.where("started_us is not null and ended_us is not null and ended_us > started_us")
    both = F.explode(F.array(F.struct(F.col("started_us").alias("at_us"), F.lit(1).alias("begins")), F.struct(F.col("ended_us").alias("at_us"), F.lit(0).alias("begins")))).alias("e")
    return lasting.select("run_id", "trace_id", both).select("run_id", "trace_id", "e.at_us", "e.begins")


def swept(traces: DataFrame, following: list[str] | None = None) -> DataFrame:
    """Events with `starts` and `ends` before them in their run, and next_<column> of the event after them."""
    return along(events(traces), ORDER, {"starts": F.col("begins"), "ends": 1 - F.col("begins")}, following or [], ["run_id"])


def degrees(traces: DataFrame) -> DataFrame:
    """run_id, trace_id, degree: the calls of the run that strictly overlap a call: those that start before it ends, less those that end before it starts, and itself."""
    rows = swept(traces).groupBy("run_id", "trace_id").agg(F.max(F.when(F.col("begins") == 0, F.col("starts"))).alias("before_end"), F.max(F.when(F.col("begins") == 1, F.col("ends"))).alias("before_start"))
    return rows.select("run_id", "trace_id", (F.col("before_end") - F.col("before_start") - 1).alias("degree"))


def profile(traces: DataFrame) -> DataFrame:
    """Per run: the most calls at once, the time with one call at least and with two at least, and the mean number of calls in busy time."""
    rows = swept(traces, ["at_us"])
    rows = rows.withColumn("active", F.col("starts") - F.col("ends") + F.when(F.col("begins") == 1, 1).otherwise(-1)).withColumn("lasts", F.coalesce(F.col("next_at_us") - F.col("at_us"), F.lit(0)))
    time = lambda least: F.sum(F.when(F.col("active") >= least, F.col("lasts")).otherwise(0))
    return rows.groupBy("run_id").agg(F.max("active").alias("peak"), time(1).alias("busy_us"), time(2).alias("parallel_us"), (F.sum(F.col("active") * F.col("lasts")) / time(1)).alias("mean_active"))


def largest_groups(traces: DataFrame, least: int = 2) -> DataFrame:
    """run_id, from_us, until_us, n: the sets of calls that all run at once and that no other call of the run could join. They are where a start is followed by an end: from the last start of the set to its first end."""
    rows = swept(traces, ["at_us", "begins"]).where("begins = 1 and next_begins = 0")
    return rows.select("run_id", F.col("at_us").alias("from_us"), F.col("next_at_us").alias("until_us"), (F.col("starts") - F.col("ends") + 1).alias("n")).where(F.col("n") >= least)


def stretches(traces: DataFrame) -> DataFrame:
    """run_id, started_us, ended_us, n_events: connected stretches of time in which some call runs."""
    borders = stored(swept(traces).where("(begins = 1 and starts = ends) or (begins = 0 and starts = ends + 1)"), "borders")
    rows = followed(borders, ORDER, ["at_us", "starts"], ["run_id"]).where("begins = 1")
    return rows.select("run_id", F.col("at_us").alias("started_us"), F.col("next_at_us").alias("ended_us"), (F.col("next_starts") - F.col("starts")).alias("n_events"))
