"""Scores and comparisons of result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import norm_words, or_empty, token_count
from corpusloom.packs import SCORE_STOPWORDS

#: Thresholds, the preview's length, refusal phrases and prices per million tokens.
PASS_F1, JUDGE_GOAL, RESCALED_GOAL, RAW_GOAL, PREVIEW = 0.22, 0.90, 0.55, 0.88, 180
REFUSALS = (
    "does not contain", "not contain information", "not available in the retrieved context", "cannot be answered", "cannot answer", "too vague",
    "please specify", "needs a specific", "insufficient information", "not enough information",
)
PRICES = {
    "gemini-2.5-flash-lite": (0.10, 0.40), "gemini-3.1-flash-lite": (0.10, 0.40), "gemini-3-flash-preview": (0.15, 0.60),
    "gemini-flash-lite-latest": (0.10, 0.40), "gemini-flash-latest": (0.15, 0.60), "gemini-3.1-flash-lite-preview": (0.10, 0.40),
    "gemini-1.5-flash": (0.075, 0.30), "gemini-2.0-flash": (0.10, 0.40),
}
DEFAULT_PRICE = (0.10, 0.40)
MEASURES = ("total_tokens", "prompt_tokens", "completion_tokens", "latency_ms")


def lexical_f1(reference: Column, answer: Column) -> Column:
    """F1 of the distinct words of two texts; 0 if either has none or they share none."""
    a, b = norm_words(reference, SCORE_STOPWORDS), norm_words(answer, SCORE_STOPWORDS)
    both = F.size(F.array_intersect(a, b))
    return F.when(both > 0, 2.0 * both / (F.size(a) + F.size(b))).otherwise(F.lit(0.0))


def heuristic_pass(reference: Column, answer: Column) -> Column:
    low = F.lower(or_empty(answer))
    return (F.trim(low) != "") & ~low.contains("not available") & ~low.contains("insufficient") & (lexical_f1(reference, answer) >= PASS_F1)


def scored(results: DataFrame, questions: DataFrame) -> DataFrame:
    """Results with lexical_f1 and heuristic_pass against their question's reference answer ('' if unknown)."""
    refs = questions.select(F.col("id").alias("question_id"), F.col("reference_answer").alias("loom_ref"))
    rows = results.join(refs, "question_id", "left")
    return rows.withColumn("lexical_f1", lexical_f1(F.col("loom_ref"), F.col("answer"))).withColumn("heuristic_pass", heuristic_pass(F.col("loom_ref"), F.col("answer"))).drop("loom_ref")


def summarize(results: DataFrame, questions: DataFrame) -> DataFrame:
    """A row a pipeline: questions, means (null counts as 0), pass rate."""
    rows = scored(results, questions)
    means = [F.avg(F.coalesce(F.col(m).cast("double"), F.lit(0.0))).alias(f"avg_{m}") for m in MEASURES]
    return rows.groupBy("pipeline").agg(F.count(F.lit(1)).alias("questions"), *means, F.avg(F.col("heuristic_pass").cast("double")).alias("heuristic_pass_rate"))


def compare_to(summary: DataFrame, base: str, other: str) -> DataFrame:
    """One row: by how many per cent the other pipeline needs fewer tokens and less time than the base; 0 if the base has none."""
    of = lambda p, m: F.max(F.when(F.col("pipeline") == p, F.col(m)))
    gain = lambda m: F.coalesce((of(base, m) - of(other, m)) / F.nullif(of(base, m), F.lit(0.0)) * 100, F.lit(0.0))
    return summary.agg(gain("avg_total_tokens").alias("token_reduction_pct"), gain("avg_latency_ms").alias("latency_reduction_pct"))


def per_question(results: DataFrame, questions: DataFrame, pipelines: list[str]) -> DataFrame:
    """A row a question; for each pipeline tokens, latency, score, verdict and a preview of the answer."""
    rows = scored(results, questions)
    preview = F.replace(F.substring(or_empty(F.col("answer")), 1, PREVIEW), F.lit("\n"), F.lit(" "))
    return rows.withColumn("preview", preview).groupBy("question_id").pivot("pipeline", pipelines).agg(
        F.max("total_tokens").alias("total_tokens"), F.max("latency_ms").alias("latency_ms"), F.max("lexical_f1").alias("lexical_f1"),
        F.max("heuristic_pass").alias("heuristic_pass"), F.max("preview").alias("answer_preview"),
    )


def merge_accuracy(summary: DataFrame, accuracy: DataFrame) -> DataFrame:
    return summary.join(accuracy, "pipeline", "left")


def parse_verdict(raw: Column, answer: Column) -> Column:
    """PASS if the judge's text has it and the answer isn't blank; else FAIL."""
    return F.when((F.trim(or_empty(answer)) != "") & F.upper(or_empty(raw)).contains("PASS"), "PASS").otherwise("FAIL")


def judge_summary(judgements: DataFrame) -> DataFrame:
    passed = F.count_if(F.col("verdict") == "PASS")
    rows = judgements.groupBy("pipeline").agg(passed.alias("pass_count"), F.count(F.lit(1)).alias("n"))
    rate = F.col("pass_count") / F.col("n")
    return rows.select("pipeline", "pass_count", rate.alias("pass_rate"), (rate >= JUDGE_GOAL).alias("judge_goal_met"))


def score_summary(scores: DataFrame) -> DataFrame:
    rows = scores.groupBy("pipeline").agg(F.avg("f1_raw").alias("f1_raw"), F.avg("f1_rescaled").alias("f1_rescaled"))
    return rows.select("*", (F.col("f1_rescaled") >= RESCALED_GOAL).alias("rescaled_goal_met"), (F.col("f1_raw") >= RAW_GOAL).alias("raw_goal_met"))


def accuracy_table(judged: DataFrame, scores: DataFrame) -> DataFrame:
    return judged.join(scores, "pipeline", "full")


def breakdown(judgements: DataFrame, questions: DataFrame) -> DataFrame:
    """Passes and questions by pipeline and question type, with totals (type 'all', pipeline 'all')."""
    types = questions.select(F.col("id").alias("question_id"), F.col("type").alias("question_type"))
    rows = judgements.select("pipeline", "question_id", "verdict").join(types, "question_id", "left").withColumn("question_type", F.coalesce("question_type", F.lit("unknown")))
    got = rows.rollup("pipeline", "question_type").agg(F.count_if(F.col("verdict") == "PASS").alias("passed"), F.count(F.lit(1)).alias("n"), F.grouping("pipeline").alias("gp"), F.grouping("question_type").alias("gt"))
    label = lambda flag, c: F.when(F.col(flag) == 1, "all").otherwise(F.col(c)).alias(c)
    return got.select(label("gp", "pipeline"), label("gt", "question_type"), "passed", "n", (F.col("passed") / F.col("n")).alias("pass_rate"))


def compute_cost(results: DataFrame, prices: dict[str, tuple[float, float]] | None = None, default: tuple[float, float] = DEFAULT_PRICE) -> DataFrame:
    """Results with cost_usd, rounded to 8 places; unknown models cost the default."""
    table = results.sparkSession.createDataFrame([(m, *p) for m, p in (PRICES if prices is None else prices).items()], "model string, price_in double, price_out double")
    rows = results.drop("cost_usd").join(F.broadcast(table), "model", "left")
    price = lambda c, d: F.coalesce(c, F.lit(d))
    cost = F.coalesce("prompt_tokens", F.lit(0)) / 1_000_000 * price("price_in", default[0]) + F.coalesce("completion_tokens", F.lit(0)) / 1_000_000 * price("price_out", default[1])
    return rows.withColumn("cost_usd", F.round(cost, 8)).drop("price_in", "price_out")


def refusal_verdict(answer: Column) -> Column:
    low = F.lower(or_empty(answer))
    refused = F.lit(False)
    for phrase in REFUSALS:
        refused = refused | low.contains(phrase)
    return F.when((F.trim(low) == "") | refused, "FAIL").otherwise("PASS")


def match_questions(live: DataFrame, questions: DataFrame, judgements: DataFrame, defaults: DataFrame) -> DataFrame:
    """Live rows (pipeline, question) with the id of the question asked before, if any, and its stored verdict.

    Texts are compared trimmed and in lower case; the first id wins.  Without a stored verdict the pipeline's default
    (PASS or null) counts, then N/A.
    """
    plain = lambda c: F.lower(F.trim(or_empty(F.col(c))))
    known = questions.groupBy(plain("question").alias("loom_text")).agg(F.min("id").alias("question_id"))
    rows = live.withColumn("loom_text", plain("question")).join(known, "loom_text", "left").drop("loom_text")
    stored = judgements.select("pipeline", "question_id", F.col("verdict").alias("stored"))
    rows = rows.join(stored, ["pipeline", "question_id"], "left").join(defaults.select("pipeline", "default_verdict"), "pipeline", "left")
    verdict = F.when(F.col("question_id").isNotNull(), F.coalesce("stored", "default_verdict", F.lit("N/A")))
    return rows.withColumn("verdict", verdict).drop("stored", "default_verdict")


def coverage(results: DataFrame, field: str, order: str = "question_id") -> DataFrame:
    """One row: rows that have a field, whether all do, and its first value by ``order``."""
    has = F.col(field).isNotNull()
    return results.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(has).alias("n_with"), (F.count(F.lit(1)) == F.count_if(has)).alias("all_rows"),
        F.min_by(F.when(has, F.col(field).cast("string")), F.when(has, F.col(order))).alias("first_value"),
    )


def missing(questions: DataFrame, results: DataFrame) -> DataFrame:
    return questions.join(results.select(F.col("question_id").alias("id")).distinct(), "id", "left_anti")


def replace_rows(results: DataFrame, new: DataFrame, ids: DataFrame) -> DataFrame:
    """Results with the rows of the given question ids taken from ``new``."""
    gone = ids.select("question_id").distinct()
    return results.join(gone, "question_id", "left_anti").select(*results.columns).unionByName(new.join(gone, "question_id", "left_semi").select(*results.columns))


def fill_usage(results: DataFrame, prompt: str = "question", answer: str = "answer") -> DataFrame:
    """Token counts as reported, or counted where they are missing or 0; the total likewise."""
    told = lambda c: F.nullif(F.col(c), F.lit(0))
    rows = results.withColumn("prompt_tokens", F.coalesce(told("prompt_tokens"), token_count(or_empty(F.col(prompt)))))
    rows = rows.withColumn("completion_tokens", F.coalesce(told("completion_tokens"), token_count(or_empty(F.col(answer)))))
    return rows.withColumn("total_tokens", F.coalesce(told("total_tokens"), F.col("prompt_tokens") + F.col("completion_tokens")))
