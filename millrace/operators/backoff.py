"""The latency rule while a run goes on: after which chunks it pauses, and what breaches do to the run's confidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.execution import rule_confidence


@dataclass(frozen=True)
class Rule:
    threshold_ms: float
    floor_ms: float = 50.0
    most: int = 10
    cooldown: int = 3
    longest_pause: float = 30.0

    def breached(self, query_ms: float) -> bool:
        return query_ms > self.threshold_ms and query_ms > self.floor_ms


class Pacer:
    """One worker's state under the rule. It fires when more than cooldown chunks have passed since the start or since
    the last time; pauses begin at a second and double up to the longest."""

    def __init__(self, rule: Rule):
        self.rule, self.fired, self.passed = rule, 0, 0

    def pause(self, query_ms: float, succeeded: bool = True) -> float:
        """Seconds to wait after a chunk; 0 where the rule doesn't fire."""
        self.passed += 1
        if not succeeded or self.fired >= self.rule.most or self.passed <= self.rule.cooldown or not self.rule.breached(query_ms):
            return 0.0
        seconds = min(2.0**self.fired, self.rule.longest_pause)
        self.fired, self.passed = self.fired + 1, 0
        return seconds


def fold(query_ms: list[float], rule: Rule) -> list[float]:
    """The pause after each of one worker's chunks."""
    pacer = Pacer(rule)
    return [pacer.pause(ms) for ms in query_ms]


def _walk(latencies: Column, rule: Rule) -> Column:
    """The same fold over an array: struct of activations, paused_s and breaches."""
    start = F.struct(F.lit(0).alias("passed"), F.lit(0).cast("long").alias("activations"), F.lit(0.0).alias("paused_s"), F.lit(0).cast("long").alias("breaches"))

    def step(s: Column, ms: Column) -> Column:
        high = (ms > rule.threshold_ms) & (ms > rule.floor_ms)
        fires = high & (s["activations"] < rule.most) & (s["passed"] + 1 > rule.cooldown)
        wait = F.least(F.pow(F.lit(2.0), s["activations"]), F.lit(rule.longest_pause))
        return F.struct(
            F.when(fires, 0).otherwise(s["passed"] + 1).alias("passed"),
            (s["activations"] + fires.cast("long")).alias("activations"),
            (s["paused_s"] + F.when(fires, wait).otherwise(0.0)).alias("paused_s"),
            (s["breaches"] + high.cast("long")).alias("breaches"),
        )

    return F.aggregate(latencies, start, step)


def replay(chunks: DataFrame, rule: Rule) -> DataFrame:
    """chunks (run_id, seq, query_ms) of one worker a run -> run_id, chunks, activations, paused_s, breaches, impact.

    A worker's chunks are one array; a plan bounds how many there are. Impact goes by
    breaches, whether the rule fired or rested.
    """
    ordered = chunks.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("seq", "query_ms"))).alias("c"))
    walked = ordered.select("run_id", F.size("c").cast("long").alias("chunks"), _walk(F.col("c.query_ms"), rule).alias("s"))
    told = rule_confidence(walked.select("run_id", "chunks", F.col("s.breaches").alias("activations"), "s"))
    return told.select("run_id", "chunks", "s.activations", "s.paused_s", "s.breaches", "impact")
