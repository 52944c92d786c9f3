"""Benchmarks of readers: scores of fixtures, aggregates over corpora, decisions and the choice among candidates, as aggregates over long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.graph import small

# What a document reader must reach, and an optical one in millionths.
FLOORS = {"text_fidelity": 0.5, "structural_fidelity": 0.5, "location_fidelity": 0.5, "outcome_accuracy": 1.0}
GATES = {"char_accuracy": 980_000, "word_accuracy": 950_000, "precision": 980_000, "recall": 950_000, "order_accuracy": 1_000_000, "overlap": 800_000, "pages": 1_000_000, "outcome": 1_000_000}


def nearest_rank(samples: DataFrame, group: str, value: str, points: dict[str, int]) -> DataFrame:
    """Nearest-rank percentiles (points in percent) of each group: values are counted first, so a value that most rows share is one row."""
    counts = samples.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(group).orderBy(value))
    ranked = counts.withColumn("upto", upto).withColumn("all", F.sum("n").over(Window.partitionBy(group)))
    rank = lambda p: F.greatest(F.lit(1), F.ceil(F.col("all") * p / 100))
    return ranked.groupBy(group).agg(*[F.min(F.when(F.col("upto") >= rank(p), F.col(value))).alias(name) for name, p in points.items()])


def corpus_metrics(results: DataFrame, corpus: str, latency: str = "latency_ms") -> DataFrame:
    """(corpus, metric, value): numbers of fixtures and of those that succeeded, the rate of failures, the mean of every metric, and the 50th and 95th percentile of the latency.

    results: corpus, fixture, failure (null: none), metric, value; a failed fixture has one row without a metric.
    """
    fixtures = results.groupBy(corpus).agg(F.count_distinct("fixture").alias("all"), F.count_distinct(F.when(F.col("failure").isNotNull(), F.col("fixture"))).alias("failed"))
    told = lambda name, value: F.struct(F.lit(name).alias("metric"), value.cast("double").alias("value"))
    counted = fixtures.select(corpus, F.explode(F.array(told("fixture_count", F.col("all")), told("successful_fixture_count", F.col("all") - F.col("failed")), told("failure_rate", F.col("failed") / F.col("all")))).alias("x"))
    good = results.filter("failure is null and metric is not null")
    means = good.filter(F.col("metric") != latency).groupBy(corpus, "metric").agg(F.avg("value").alias("value"))
    ranks = nearest_rank(good.filter(F.col("metric") == latency), corpus, "value", {"p50": 50, "p95": 95})
    slow = ranks.select(corpus, F.explode(F.array(told(f"p50_{latency}", F.col("p50")), told(f"p95_{latency}", F.col("p95")))).alias("x"))
    return counted.select(corpus, "x.*").unionByName(means).unionByName(slow.select(corpus, "x.*"))


def applicable_scores(manifests: DataFrame, weights: DataFrame, attempt: str) -> DataFrame:
    """(attempt, score, metrics): the weighted mean of the metrics that have a score and a weight and are not excluded; null without any.

    manifests: attempt, metric, score, excluded; weights: metric, weight. One aggregate: what does not count is null in it, so no attempt is looked for again.
    """
    kept = F.col("weight").isNotNull() & F.col("score").isNotNull() & ~F.col("excluded")
    rows = manifests.join(small(weights.filter("weight > 0")), "metric", "left").select(attempt, *[F.when(kept, c).alias(n) for n, c in (("metric", F.col("metric")), ("part", F.col("score") * F.col("weight")), ("weight", F.col("weight")))])
    return rows.groupBy(attempt).agg(F.round(F.sum("part") / F.sum("weight"), 12).alias("score"), F.array_join(F.array_sort(F.collect_set("metric")), ",").alias("metrics"))


def winner(left: Column, right: Column, left_name: Column, right_name: Column) -> Column:
    return F.when(right > left, right_name).when(left > right, left_name).otherwise("tie")


def fixture_scores(blocks: DataFrame, fixtures: DataFrame) -> DataFrame:
    """(fixture, structure, text, location) of a reader's blocks (fixture, ordinal, type, text, located) against what is expected of them.

    fixtures: fixture, expected_text, required_types, applicable (arrays). Text: the share of expected texts that occur in the blocks' texts, joined by line
    ends; structure: of the required types that there are; location: of the blocks that have a place. A score that does not apply is null; without blocks it is 0.
    """
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\n")
    own = blocks.groupBy("fixture").agg(said.alias("said"), F.collect_set("type").alias("types"), F.count_if("located").alias("placed"), F.count("*").alias("n"))
    rows = fixtures.join(own, "fixture", "left")
    share = lambda of, has: F.size(F.filter(of, has)) / F.size(of)
    applies = lambda name, score: F.when(F.array_contains("applicable", name), F.coalesce(score, F.lit(0.0)))
    return rows.select(
        "fixture",
        applies("structure", share("required_types", lambda t: F.array_contains("types", t))).alias("structure"),
        applies("text", share("expected_text", lambda t: F.contains(F.coalesce("said", F.lit("")), t))).alias("text"),
        applies("location", F.col("placed") / F.greatest(F.lit(1), F.col("n"))).alias("location"),
    )


def calibration(results: DataFrame, group: str, metrics: list[str]) -> DataFrame:
    """group, total, successful, rejected, a mean of each metric over the accepted, exclusions (metrics that none has), failures (code:count)."""
    accepted = F.col("status") == "accepted"
    means = [F.avg(F.when(accepted, F.col(m))).alias(m) for m in metrics]
    rows = results.groupBy(group).agg(F.count("*").alias("total"), F.count_if(accepted).alias("successful"), *means)
    codes = results.filter(~accepted).groupBy(group, "error_code").agg(F.count("*").alias("n")).groupBy(group).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "error_code", F.col("n").cast("string")))), ",").alias("failures"))
    missing = F.array_join(F.array_compact(F.array(*[F.when(F.col(m).isNull(), F.lit(m)) for m in sorted(metrics)])), ",")
    return rows.join(codes, group, "left").select(group, "total", "successful", (F.col("total") - F.col("successful")).alias("rejected"), *metrics, missing.alias("exclusions"), F.coalesce("failures", F.lit("")).alias("failures"))


def reader_benchmark(expected: DataFrame, attempts: DataFrame, corpus: str) -> DataFrame:
    """corpus, documents, the four fidelities, identical, failures, decision of a reader that read every document twice.

    expected: corpus, document, outcome (accept, reject), rejection, text_digest, event_digest, counts (map of kinds); attempts: corpus, document, attempt,
    rejection (null: read), text_digest, event_digest, counts, location. A rejected document is right if both attempts give its code; an accepted one
    if both read the same. Text is right or wrong; structure the share of equal counts and of the event digest; a document that was expected but not read scores 0.
    Other failures than floors, or attempts that differ, are to be investigated; a floor that is missed makes a change a candidate; else all holds.
    """
    place = lambda k, c: F.max(F.when(F.col("attempt") == k, F.col(c))).alias(f"{c}_{k}")
    told = F.to_json(F.array_sort(F.map_entries("counts")))
    tries = attempts.withColumn("told", told).withColumn("read", F.col("rejection").isNull())
    both = tries.groupBy(corpus, "document").agg(F.count("*").alias("tries"), F.bool_and("read").alias("read"), *[place(k, c) for k in (1, 2) for c in ("rejection", "text_digest", "event_digest", "told", "location")], F.max_by("counts", -F.col("attempt")).alias("found"))
    rows = expected.join(both, [corpus, "document"], "left")
    accept = F.col("outcome") == "accept"
    same = F.coalesce(F.col("read") & (F.col("tries") == 2) & F.col("text_digest_1").eqNullSafe(F.col("text_digest_2")) & F.col("event_digest_1").eqNullSafe(F.col("event_digest_2")) & F.col("told_1").eqNullSafe(F.col("told_2")), F.lit(False))
    refused = F.coalesce((F.col("tries") == 2) & (F.col("rejection_1") == F.col("rejection")) & (F.col("rejection_2") == F.col("rejection")), F.lit(False))
    read = F.coalesce(F.col("read") & (F.col("tries") == 2), F.lit(False))
    kinds = F.map_keys("counts")
    equal = F.size(F.filter(kinds, lambda k: F.try_element_at("found", k).eqNullSafe(F.try_element_at("counts", k)))) + (F.col("event_digest_1") == F.col("event_digest")).cast("int")
    score = lambda value: F.when(accept, F.when(read, value).otherwise(0.0))
    failure = F.when(accept & ~read, "unexpected_rejection").when(accept & ~same, "nonrepeatable").when(~accept & ~refused, "unexpected_rejection_outcome")
    rows = rows.select(corpus, score((F.col("text_digest_1") == F.col("text_digest")).cast("double")).alias("text"), score(equal / (F.size(kinds) + 1)).alias("structure"), score(F.col("location_1")).alias("location"), F.when(accept, same).otherwise(refused).alias("right"), failure.alias("failure"))
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    out = rows.groupBy(corpus).agg(F.count("*").alias("documents"), mean("text").alias("text_fidelity"), mean("structure").alias("structural_fidelity"), mean("location").alias("location_fidelity"), F.avg(F.col("right").cast("double")).alias("outcome_accuracy"), F.count("failure").alias("failed"), F.array_join(F.array_sort(F.collect_set("failure")), ",").alias("failures"))
    weak = F.array_join(F.array_compact(F.array(*[F.when(F.col(n) < floor, F.lit(n)) for n, floor in FLOORS.items()])), ",")
    decision = F.when(F.col("failed") > 0, "investigate").when(weak != "", "candidate_change").otherwise("hold")
    return out.select(corpus, "documents", *[F.round(n, 9).alias(n) for n in FLOORS], (F.col("failed") == 0).alias("identical"), "failures", decision.alias("decision"))


def candidate_scores(attempts: DataFrame, candidate: str) -> DataFrame:
    """candidate, the mean of each score in millionths (rounded down), invented, latency, memory, identical, passes of optical readers.

    attempts: candidate, fixture, attempt, accepted (the fixture is to be read), the scores of GATES in millionths (outcome of all fixtures), invented, semantic, latency, memory, unexpected.
    """
    fixtures = attempts.groupBy(candidate, "fixture").agg((F.count_distinct("semantic") == 1).alias("same"))
    same = fixtures.groupBy(candidate).agg(F.bool_and("same").alias("identical"))
    mean = lambda c, of: F.floor(F.coalesce(F.sum(F.when(of, F.col(c))) / F.greatest(F.lit(1), F.count_if(of)), F.lit(0))).cast("long").alias(c)
    read, any_ = F.col("accepted"), F.lit(True)
    scores = [mean(c, any_ if c == "outcome" else read) for c in GATES]
    rows = attempts.groupBy(candidate).agg(*scores, F.coalesce(F.sum(F.when(read, F.col("invented"))), F.lit(0)).cast("long").alias("invented"), F.floor(F.avg("latency")).cast("long").alias("latency"), F.max("memory").alias("memory"), F.bool_or("unexpected").alias("unexpected")).join(same, candidate)
    gates = F.forall(F.array(*[F.col(c) >= floor for c, floor in GATES.items()]), lambda ok: ok)
    return rows.withColumn("passes", F.col("identical") & ~F.col("unexpected") & (F.col("invented") == 0) & gates).drop("unexpected")


def choose_candidate(scores: DataFrame, group: str, candidate: str) -> DataFrame:
    """(group, decision, chosen): the best passing candidate by accuracy of signs, inventions, recall, order, memory, latency and name; to be investigated if
    none passes or one is not repeatable; a change if not all pass."""
    key = F.struct(-F.col("char_accuracy"), F.col("invented"), -F.col("recall"), -F.col("order_accuracy"), F.col("memory"), F.col("latency"), F.col(candidate))
    best = scores.groupBy(group).agg(F.min(F.when(F.col("passes"), key)).alias("best"), F.bool_and("identical").alias("identical"), F.bool_and("passes").alias("all_pass"))
    investigate = F.col("best").isNull() | ~F.col("identical")
    return best.select(group, F.when(investigate, "investigate").when(F.col("all_pass"), "hold").otherwise("candidate_change").alias("decision"), F.when(~investigate, F.col("best")[candidate]).alias("chosen"))
