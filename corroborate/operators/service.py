"""What surrounds the tools: settings, error rows, progress rows, texts to and from language models, small text formats."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import routing


class InvalidInputError(ValueError):
    """Input that a tool can't work on."""


class ToolTimeoutError(RuntimeError):
    """A tool took too long."""


class OutOfMemoryToolError(RuntimeError):
    """A tool ran out of memory."""


@dataclass
class Options:
    """Settings of a run; every one has a default."""

    total_attempts: int = 3
    context_window: int = 8192
    max_tokens: int = 2048
    seed: int = 42
    recovery_seconds: float = 60.0
    failures: int = 3


def error_row(tool: Column, message: Column) -> Column:
    """The evidence of a tool that failed: no opinion, and the kind of error in words."""
    kind = routing.failure(message)
    return F.struct(
        tool.alias("tool"), F.lit(False).alias("success"), F.lit(0.5).alias("real_prob"), kind["confidence"].alias("confidence"), F.lit(True).alias("error"), message.alias("error_msg"), F.lit(0.0).alias("execution_time"),
        F.concat(F.lit("Tool "), tool, F.lit(" failed: ["), kind["kind"], F.lit("] "), message).alias("evidence_summary"),
    )


def normalised_weights(weights: DataFrame) -> DataFrame:
    """(tool, weight) that sum to 1; sums within a millionth of it stay as they are. A row for each tool: a few in all."""
    total = weights.agg(F.sum("weight").alias("total"))
    share = F.when(F.abs(F.col("total") - 1) > 1e-6, F.col("weight") / F.col("total")).otherwise(F.col("weight"))
    return weights.crossJoin(F.broadcast(total)).select("tool", F.round(share, 9).alias("weight"))


def progress(media: DataFrame, decisions: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(case_id, stage, seq, event, detail): what a run tells of each case, in order: the pipeline chosen, the cheap tools, the
    gate, the expensive tools, the verdict."""
    stage = lambda df, n, event, detail, seq=F.lit(0): df.select("case_id", F.lit(n).alias("stage"), seq.cast("int").alias("seq"), F.lit(event).alias("event"), detail.alias("detail"))
    rows = stage(media, 1, "PIPELINE_SELECTED", F.when(routing.face_gate(), "face").otherwise("no_face"))
    rows = rows.union(stage(routing.cheap_plan(media), 2, "TOOL_STARTED", F.col("tool"), F.col("seq")))
    rows = rows.union(stage(decisions, 3, "GATE", F.col("decision")))
    rows = rows.union(stage(routing.expensive_plan(media, decisions), 4, "TOOL_STARTED", F.col("tool"), F.col("seq")))
    return rows.union(stage(verdicts, 5, "VERDICT", F.col("verdict")))


def token_budget(prompt: Column, attempt: Column, options: Options = Options()) -> Column:
    """struct(prompt_tokens, num_predict, num_ctx, seed): tokens are estimated at 2.5 characters each."""
    tokens = F.floor(F.length(prompt) / 2.5)
    room = F.lit(options.context_window) - tokens - F.when(attempt > 1, 30).otherwise(0)
    predict = F.least(F.lit(options.max_tokens), F.greatest(room, F.lit(256)))
    return F.struct(tokens.alias("prompt_tokens"), predict.alias("num_predict"), F.greatest(F.lit(options.context_window), tokens + predict).alias("num_ctx"), (F.lit(options.seed) + (attempt - 1) * 1000).alias("seed"))


def retry_tokens(used: Column, allowed: Column) -> Column:
    """Tokens that the next attempt may use: half as many more after an answer that was cut."""
    return F.when(used >= allowed, F.floor(allowed * 1.5)).otherwise(allowed)


def fallback_document(reason: Column, attempts: Column) -> Column:
    """JSON that takes the place of an answer that couldn't be had."""
    text = F.concat(F.lit("LLM synthesis failed after "), attempts.cast("string"), F.lit(" attempts. "), reason, F.lit(". Relying on raw ensemble score."))
    return F.to_json(F.struct(F.lit("INCONCLUSIVE").alias("verdict"), F.lit(0.0).alias("confidence"), text.alias("reasoning"), F.lit("llm_synthesis_failed").alias("_error"), F.lit(True).alias("_fallback"), F.lit(True).alias("_exclude_from_ensemble")))


def client_metrics(calls: DataFrame) -> DataFrame:
    """One row of totals from calls (json, success, attempt, truncated, seconds): rates are 0 without calls."""
    ok, json = F.col("success"), F.col("json")
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    g = calls.agg(
        F.count_if(json & ok).alias("json_success_count"), F.count_if(json & ~ok).alias("json_failure_count"), F.count_if(~json & ok).alias("text_success_count"), F.count_if(F.col("attempt") > 1).alias("retry_count"),
        F.count_if("truncated").alias("truncation_count"), F.count_if(ok).alias("total_generation_calls"), F.sum(F.when(ok, F.col("seconds"))).alias("s"),
    )
    total = F.col("json_success_count") + F.col("json_failure_count")
    return g.withColumns({"json_success_rate": F.round(rate(F.col("json_success_count").cast("double"), total) * 100, 2), "avg_generation_time_sec": F.round(rate(F.col("s"), F.col("total_generation_calls")), 2)}).drop("s")


def frames(stream: Column) -> Column:
    """The events of a stream's text: parts between blank lines, without the word before the data; empty parts are none."""
    parts = F.filter(F.split(stream, r"\r?\n\r?\n"), lambda p: F.trim(p) != "")
    return F.transform(parts, lambda p: F.regexp_replace(p, r"^data:\x20?", ""))


def iso_time(text: Column) -> Column:
    """A time in ISO form, Z or an offset or none (then UTC); null if it isn't one."""
    return F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))


def stamped(name: str, time_: Column, suffix: str) -> Column:
    """A file name with a time in it."""
    return F.concat(F.lit(name + "_"), F.date_format(time_, "yyyyMMdd_HHmmss"), F.lit("." + suffix))


def scores_json(scores: Column) -> Column:
    return F.to_json(scores)


def scores_map(text: Column) -> Column:
    """A map of scores from JSON; null if it isn't one."""
    return F.from_json(text, "map<string,double>")


def valid_scores(scores: Column) -> Column:
    """Every value of a map is a finite number."""
    return F.forall(F.map_values(scores), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
