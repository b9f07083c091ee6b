"""Metrics as tables: histograms, gauges with closed label sets, exposition text, alarms, error classes, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RETRY_HTTP, RETRY_RPC = (408, 429, 502, 503, 504, 529), (-32005, 429)
RETRY_TEXT = "rate limit|too many requests|execution timeout|request timed out"
INTERNAL_TEXT = "internal error|internal server error"
TOO_LARGE = "response too large"
INTERNAL_RPC = (-32000, -32603)
VIOLATIONS = ("equivocation", "descending", "parent mismatch", "below finality", "parent not buffered", "finality not buffered", "finality mismatch")


#: The series of a service, as (name, kind, help, label, its closed set of values).
SERIES = (
    ("last_block", "gauge", "newest block held", None, ()), ("last_block_lag_ms", "gauge", "age of the newest block", None, ()), ("first_block", "gauge", "oldest block held", None, ()),
    ("finalized_block", "gauge", "finalized block", None, ()), ("stored_blocks", "gauge", "blocks held", None, ()), ("block_lag_ms", "histogram", "age of blocks when committed", None, ()),
    ("head_detection_gap_ms", "histogram", "time between polls that saw new heads", None, ()), ("head_interval_ms", "histogram", "time between heads", None, ()),
    ("processing_time_ms", "histogram", "time from sight to commit", None, ()), ("queries_total", "counter", "queries served", "type", ("cache", "backfill", "error")),
    ("window_excess", "gauge", "blocks above the window's size", None, ()), ("commits_total", "counter", "commits", None, ()), ("last_commit_timestamp_ms", "gauge", "last commit", None, ()),
    ("query_outcomes_total", "counter", "queries by outcome", "class", ("window", "wait_empty", "backfill", "conflict", "error")),
    ("query_duration_ms", "histogram", "time of queries", "class", ("window", "wait_empty", "backfill", "conflict", "error")),
    ("response_truncations_total", "counter", "answers cut short", "cause", ("budget", "error", "disconnect")), ("upstream_head", "gauge", "newest block upstream", None, ()),
    ("upstream_head_timestamp_ms", "gauge", "when it was seen", None, ()), ("upstream_finalized_head", "gauge", "finalized block upstream", None, ()), ("upstream_finalized_head_timestamp_ms", "gauge", "when it was seen", None, ()),
    ("upstream_requests_total", "counter", "requests", "kind", ("single", "batch")), ("upstream_calls_total", "counter", "calls in requests", None, ()),
    ("upstream_errors_total", "counter", "failed calls", "class", ("rpc", "http", "connection", "disconnected", "timeout", "protocol", "retry_requested")),
    ("upstream_retries_total", "counter", "calls asked again", "class", ("rpc", "http", "connection", "disconnected", "timeout", "protocol", "retry_requested")),
    ("over_window", "gauge", "whether the window is over its size", None, ()), ("force_advances_total", "counter", "evictions past finality", None, ()), ("force_advanced_past", "gauge", "last block evicted past finality", None, ()),
    ("integrity_violations_total", "counter", "violations of the window's rules", None, ()), ("session_restarts_total", "counter", "sessions begun anew", "cause", ("error", "fork", "reset")),
    ("enrichment_retries_total", "counter", "blocks asked for again", "reason", ("data_lagging", "header_contested", "incoherent")), ("acquisition_retry_exhaustions_total", "counter", "blocks given up", None, ()),
    ("fork_rebases_total", "counter", "windows moved to another base", None, ()), ("watermark_regressions_total", "counter", "finality reports that went back", None, ()), ("terminal_state", "gauge", "whether the service has given up", None, ()),
    ("stall_alarm", "gauge", "whether nothing comes in although upstream goes on", None, ()), ("process_start_timestamp_ms", "gauge", "start of the process", None, ()),
    ("first_acceptance_timestamp_ms", "gauge", "first query taken", None, ()), ("first_commit_timestamp_ms", "gauge", "first commit", None, ()), ("shutdown_start_timestamp_ms", "gauge", "begin of the end", None, ()),
)


def registered(spark: SparkSession, observed: DataFrame) -> DataFrame:
    """(name, kind, help, labels, label, value): all series with what ``observed`` (name, label, value) has, zero for the rest.

    Of a histogram this is the count. Raises nothing for what isn't registered: such rows leave, as the sets are closed.
    """
    known = spark.createDataFrame([(n, k, h, lab, v) for n, k, h, lab, values in SERIES for v in values or [""]], "name string, kind string, help string, key string, label string")
    rows = known.join(observed.groupBy("name", "label").agg(F.sum("value").cast("double").alias("value")), ["name", "label"], "left")  # some sixty rows
    labels = F.when(F.col("key").isNotNull(), F.create_map("key", "label")).otherwise(F.expr("cast(map() AS map<string, string>)"))
    return rows.select("name", "kind", "help", labels.alias("labels"), "label", F.coalesce("value", F.lit(0.0)).alias("value"))


def upstream(rows: DataFrame, column: str = "figures") -> DataFrame:
    """(name, label, value) for ``registered``: what the tasks that read blocks counted, of a table or, in complete or update mode, a stream.

    Calls of the driver itself (heads, probes, the look ahead) aren't in it.
    """
    counts = rows.select(F.explode(column).alias("key", "n"))
    return counts.groupBy(F.split_part("key", F.lit("/"), F.lit(1)).alias("name"), F.split_part("key", F.lit("/"), F.lit(2)).alias("label")).agg(F.sum("n").cast("double").alias("value"))


def histogram(values: DataFrame, value: str, bounds: list[float], keys: list[str] | None = None) -> DataFrame:
    """(keys, le, count): how many values are at or below each bound; the last bound is null, for all."""
    sums = values.groupBy(*(keys or [])).agg(*[F.count(F.when(F.col(value) <= b, 1)).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(value).alias("all"))
    rows = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("count")) for i, b in enumerate(bounds)] + [F.struct(F.lit(None).cast("double").alias("le"), F.col("all").alias("count"))]
    return sums.select(*(keys or []), F.explode(F.array(*rows)).alias("r")).select(*(keys or []), "r.*")


def summary(values: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Least, median, 90th percentile and most."""
    return values.groupBy(*(keys or [])).agg(F.min(value).alias("least"), F.percentile(value, 0.5).alias("median"), F.percentile(value, 0.9).alias("p90"), F.max(value).alias("most"))


#: Size of a quantile sketch, and the rank error that it keeps within, as a part of the values (that of its published bound, doubled and more).
SKETCH, RANK_ERROR = 800, 0.01


def sketched(values: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """(keys, sketch, n, least, most): mergeable quantile sketches, to be stored, for a day or a source say. Some KB for any number of values,
    combined on the map side; nulls don't count."""
    x = F.col(value).cast("double")
    return values.groupBy(*keys).agg(F.kll_sketch_agg_double(x, SKETCH).alias("sketch"), F.count(x).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"))


def sketch_summary(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Count, least, median, 90th percentile and most of what stored sketches hold, merged by ``keys``; the quantiles' ranks are off by
    ``RANK_ERROR`` at most. ``summary`` is exact, but has all values of a group in one task."""
    per = sketches.filter("n > 0").groupBy(*keys).agg(F.kll_merge_agg_double("sketch", SKETCH).alias("_s"), F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
    return per.select(*keys, "n", "least", F.kll_sketch_get_quantile_double("_s", F.lit(0.5)).alias("median"), F.kll_sketch_get_quantile_double("_s", F.lit(0.9)).alias("p90"), "most")


def zero_filled(counts: DataFrame, labels: DataFrame, value: str = "value") -> DataFrame:
    """Counts with a zero for each combination of a closed label set that has none; ``labels``: the combinations."""
    return labels.join(counts, labels.columns, "left").withColumn(value, F.coalesce(value, F.lit(0)))


def exposition(metrics: DataFrame) -> DataFrame:
    """(name, text) in the Prometheus text format from (name, help, type, labels map, value)."""
    label = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), F.replace(F.replace(e["value"], F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))), ",")
    line = F.concat("name", F.when(F.size("labels") > 0, F.concat(F.lit("{"), label, F.lit("}"))).otherwise(""), F.lit(" "), F.col("value").cast("string"))
    per = metrics.groupBy("name", "help", "type").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))
    return per.select("name", F.concat(F.lit("# HELP "), "name", F.lit(" "), "help", F.lit("\n# TYPE "), "name", F.lit(" "), "type", F.lit("\n"), "lines", F.lit("\n")).alias("text"))


def families_json(metrics: DataFrame, name: str | None = None) -> DataFrame:
    """(name, json): each family as JSON, or the one asked for."""
    rows = metrics if name is None else metrics.filter(F.col("name") == name)
    per = rows.groupBy("name", "help", "type").agg(F.array_sort(F.collect_list(F.to_json(F.struct("labels", "value")))).alias("m"))
    return per.select("name", F.concat(F.lit('{"name":"'), "name", F.lit('","help":"'), "help", F.lit('","type":"'), "type", F.lit('","metrics":['), F.array_join("m", ","), F.lit("]}")).alias("json"))


def stalled(upstream: Column, committed: Column, last_commit: Column, behind_since: Column, now: Column, seconds: int = 60) -> Column:
    """Whether upstream has been ahead, and nothing came in, for so long, counted from whichever is later."""
    return F.coalesce((upstream > committed) & (now - F.greatest(last_commit, behind_since) >= seconds * 1000), F.lit(False))


def is_retryable(http: Column, rpc: Column, message: Column, internal: bool = False) -> Column:
    """Whether a plain call may be asked again; ``internal``: also where the other side reports an error of its own."""
    codes = RETRY_RPC + (INTERNAL_RPC if internal else ())
    own = F.coalesce(F.lower(message).rlike(INTERNAL_TEXT), F.lit(False)) if internal else F.lit(False)
    return own | F.coalesce(http.isin(*RETRY_HTTP), F.lit(False)) | F.coalesce(rpc.isin(*codes), F.lit(False)) | F.coalesce(F.lower(message).rlike(RETRY_TEXT), F.lit(False))


def shortest_gap(arrivals: DataFrame, at: str = "at_ms", keys: list[str] | None = None, last: int = 8) -> DataFrame:
    """Arrivals with the shortest of their last gaps, and the delay until the next poll is due."""
    w = Window.partitionBy(*(keys or [])).orderBy(at)
    gap = arrivals.withColumn("gap", F.col(at) - F.lag(at).over(w))
    return gap.withColumn("floor", F.min("gap").over(w.rowsBetween(1 - last, 0)))


def poll_delay(floor: Column, elapsed: Column) -> Column:
    """Milliseconds to wait: 100 without data, else what is left of the shortest gap less 600, between 25 and 1000."""
    return F.when(floor.isNull(), 100).otherwise(F.least(F.lit(1000), F.greatest(F.lit(25), floor - elapsed - 600)))


def rate(counts: DataFrame, slot: str, value: str, slot_ms: int, keys: list[str] | None = None, slots: int = 10) -> DataFrame:
    """Sliding rate per second over the last slots (and the open one) of a meter; slots without a row count as zero."""
    w = Window.partitionBy(*(keys or [])).orderBy(slot).rangeBetween(-slots, 0)
    return counts.withColumn("rate", F.sum(value).over(w) * 1000 / (slots * slot_ms))
