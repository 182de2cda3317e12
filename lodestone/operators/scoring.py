"""Run totals, checks of answers against the golden set, summaries, failures and comparison of runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.sources.tables import checksum, numbered

MARKER = r"\[(\d+)\]"
#: A change of a mean below this is noise, overall and for one type.
NOISE, NOISE_BY_TYPE = 0.03, 0.10
JUDGED = ("faithfulness", "answer_recall", "context_recall")


def select_questions(questions: DataFrame, ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the questions of the ids, the ids without a question)."""
    wanted = questions.sparkSession.createDataFrame([(i,) for i in ids], "id string").distinct()
    return questions.join(F.broadcast(wanted), "id", "left_semi"), wanted.join(questions.select("id"), "id", "left_anti")


def quantiles(rows: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """by, n and a column for each share: exact quantiles, interpolated between neighbours; nulls are skipped.

    A value's place comes from ranges of all values, so no task holds those of a whole group.
    """
    placed = numbered(rows.select(by, F.col(value).alias("v")).filter("v is not null"), by, "v")
    at = {name: (F.col("n") - 1) * share for name, share in shares.items()}
    wanted = [F.col("place") == f(x) for x in at.values() for f in (F.floor, F.ceil)]
    few = placed.filter(reduce(Column.__or__, wanted))
    held = lambda x: F.max(F.when(F.col("place") == x, F.col("v")))
    between = lambda x: held(F.floor(x)) + (held(F.ceil(x)) - held(F.floor(x))) * (F.max(x) - F.floor(F.max(x)))
    return few.groupBy(by).agg(F.max("n").alias("n"), *(between(x).alias(name) for name, x in at.items()))


def run_totals(answers: DataFrame, by: str = "run_name") -> DataFrame:
    """One row a run: questions, answered, errors, tokens, cost in total and per answer, latency.

    The 95th percentile needs two latencies.  Only answered questions count for cost and latency.
    """
    ok = F.col("error").isNull()
    of = lambda c: F.when(ok, F.col(c))
    tokens = [F.coalesce(F.sum(of(f"llm_token_usage.{c}")), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens", "cached_input_tokens")]
    sums = answers.groupBy(by).agg(
        F.count(F.lit(1)).alias("questions"),
        F.sum(ok.cast("long")).alias("answered"),
        F.sum((~ok).cast("long")).alias("errors"),
        *tokens,
        F.bround(F.sum(of("llm_cost_usd")), 6).alias("cost_usd"),
        F.bround(F.avg(of("llm_cost_usd")), 6).alias("cost_per_answer_usd"),
        F.bround(F.avg(of("latency_seconds")), 3).alias("latency_mean"),
    )
    run = F.coalesce(F.col(by).cast("string"), F.lit(""))
    places = quantiles(answers.filter(ok).withColumn("_run", F.struct(F.col(by).isNull().alias("none"), run.alias("name"))), "_run", "latency_seconds", {"p50": 0.5, "p95": 0.95})
    rows = sums.withColumn("_run", F.struct(F.col(by).isNull().alias("none"), run.alias("name"))).join(places, "_run", "left").drop("_run")
    last = F.when(F.col("n") >= 2, F.bround("p95", 3))
    return rows.withColumns({"latency_p50": F.bround("p50", 3), "latency_p95": last}).drop("n", "p50", "p95")


def corpus_matches(rows: DataFrame, recorded: DataFrame, columns: list[str]) -> DataFrame:
    """matches: whether the rows are those of which ``checksum`` recorded this, as one row."""
    now = checksum(rows, columns).select(F.col("n_rows").alias("n"), F.col("checksum").alias("c"))
    return now.join(F.broadcast(recorded)).select(((F.col("n") == F.col("n_rows")) & (F.col("c") == F.col("checksum"))).alias("matches"))


def changed_questions(answers: DataFrame, golden: DataFrame) -> DataFrame:
    """Answers whose question isn't in the golden set as it is now."""
    now = golden.select("id", F.col("question").alias("now"))
    return answers.join(now, "id", "left").filter(~F.col("question").eqNullSafe(F.col("now"))).select("id", "question", "now")


def retrieval_checks(retrieved: DataFrame, evidence: DataFrame) -> DataFrame:
    """first_evidence_rank, hits at 1, 3, 5, reciprocal rank, items found and their share, for each question with evidence.

    retrieved: question_id, rank, chunk_id; evidence: question_id, item, chunk_id (an item may name several chunks).
    """
    hits = evidence.join(retrieved, ["question_id", "chunk_id"], "left")
    items = hits.groupBy("question_id", "item").agg(F.min("rank").alias("rank"))
    first = F.min("rank")
    checks = items.groupBy("question_id").agg(first.alias("first_evidence_rank"), F.count("rank").alias("evidence_items_found"), F.count(F.lit(1)).alias("evidence_items_total"))
    rank = F.col("first_evidence_rank")
    at = {f"hit_at_{n}": F.coalesce(rank <= n, F.lit(False)) for n in (1, 3, 5)}
    return checks.withColumns({**at, "reciprocal_rank": F.coalesce(1 / rank, F.lit(0.0)), "evidence_recall": F.col("evidence_items_found") / F.col("evidence_items_total")})


def cites_evidence(cited: Column, evidence: Column) -> Column:
    """Any cited chunk is evidence (array columns of chunk ids)."""
    return F.coalesce(F.arrays_overlap(cited, evidence), F.lit(False))


def required_terms_missing(answer: Column, terms: Column) -> Column:
    """Terms that the answer, in lower case and without backticks and asterisks, doesn't hold."""
    plain = F.lower(F.translate(F.coalesce(answer, F.lit("")), "`*", ""))
    return F.filter(F.coalesce(terms, F.array().cast("array<string>")), lambda t: ~F.contains(plain, F.lower(t)))


def required_terms_ok(answer: Column, terms: Column) -> Column:
    """No term is missing; null where none is required."""
    return F.when(F.size(F.coalesce(terms, F.array().cast("array<string>"))) > 0, F.size(required_terms_missing(answer, terms)) == 0)


def marker_numbers(answer: Column) -> Column:
    """All [n] of an answer, in order; numbers too large for a bigint are null."""
    return F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(MARKER), F.lit(1)), lambda n: n.try_cast("bigint"))


def invalid_citations(answer: Column, n_retrieved: Column) -> Column:
    """The sorted distinct [n] outside 1..n_retrieved; a number too large counts as the largest bigint."""
    found = F.transform(marker_numbers(answer), lambda n: F.coalesce(n, F.lit(2**63 - 1)))
    return F.array_sort(F.array_distinct(F.filter(found, lambda n: ~n.between(1, n_retrieved))))


def claim_recall(verdicts: DataFrame) -> DataFrame:
    """question_id, recall (two places), missing claims in order; verdicts: question_id, claim_no, claim, found.

    A claim without a verdict is an error, and so is a number of claims other than ``n_claims``, if that is a column.
    """
    count = F.col("n_claims") if "n_claims" in verdicts.columns else F.count(F.lit(1)).over(Window.partitionBy("question_id"))
    given = F.count("found").over(Window.partitionBy("question_id"))
    verdicts = verdicts.withColumn("found", F.when(given == count, F.col("found")).otherwise(F.raise_error(F.concat(F.lit("verdicts don't match the claims of question "), F.col("question_id").cast("string")))))
    missing = F.array_sort(F.collect_list(F.when(~F.col("found"), F.struct("claim_no", "claim"))))
    return verdicts.groupBy("question_id").agg(F.bround(F.avg(F.col("found").cast("double")), 2).alias("recall"), F.transform(missing, lambda m: m["claim"]).alias("missing"))


def clean_judge_scores(results: DataFrame) -> DataFrame:
    """One row a question: the judged metrics as columns, and declines; failed and NaN values are null."""
    ok = F.col("error").isNull()
    value = F.when(ok & ~F.isnan("value"), F.col("value"))
    of = lambda m, c: F.max(F.when(F.col("metric") == m, c))
    failed = F.array_sort(F.collect_list(F.when(~ok, F.col("metric")))).alias("judge_errors")
    return results.groupBy("question_id").agg(*(of(m, value).alias(m) for m in JUDGED), of("declines", F.when(ok, F.col("label"))).alias("declines"), failed)


def judge_usage(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls, tokens and cost of each model and in all; one call without a price leaves the sum null."""
    from lodestone.operators.answers import cost_usd

    priced = calls.join(F.broadcast(prices), "model", "left").withColumn("cost", cost_usd(F.col("usage")))
    total = F.when(F.count("cost") == F.count(F.lit(1)), F.bround(F.sum("cost"), 6)).alias("cost_usd")
    return priced.rollup("model").agg(F.count(F.lit(1)).alias("calls"), F.sum("usage.input_tokens").alias("input_tokens"), F.sum("usage.output_tokens").alias("output_tokens"), total)


def score_records(answers: DataFrame, golden: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """One flat row a question of a run; run errors stay, unscored.

    answers: id, answer, citations, retrieved, error; golden: id, type, answerable, evidence, required_terms.
    """
    known = answers.select("id", "answer", "citations", "retrieved", "error").join(golden.select("id", "type", "answerable", "evidence", "required_terms"), "id")
    retrieved = answers.select(F.col("id").alias("question_id"), F.explode("retrieved").alias("r")).select("question_id", F.col("r.rank").alias("rank"), F.col("r.chunk_id").alias("chunk_id"))
    items = golden.filter("answerable").select(F.col("id").alias("question_id"), F.posexplode("evidence").alias("item", "e"))
    evidence = items.select("question_id", "item", F.explode("e.chunk_ids").alias("chunk_id")).distinct()
    checks = retrieval_checks(retrieved, evidence).withColumnRenamed("question_id", "id")
    missing = required_terms_missing(F.col("answer"), F.col("required_terms"))
    rows = known.join(checks, "id", "left").withColumns(
        {
            "cites_evidence_chunk": F.when(F.col("answerable"), cites_evidence(F.col("citations.chunk_id"), F.flatten("evidence.chunk_ids"))),
            "required_terms_missing": missing,
            "required_terms_ok": required_terms_ok(F.col("answer"), F.col("required_terms")),
            "has_citations": F.size("citations") > 0,
            "invalid_citation_numbers": invalid_citations(F.col("answer"), F.size("retrieved")),
        }
    )
    if judged is not None:
        rows = rows.join(judged.withColumnRenamed("question_id", "id"), "id", "left")
    else:
        rows = rows.withColumns({**{m: F.lit(None).cast("double") for m in JUDGED}, "declines": F.lit(None).cast("string"), "judge_errors": F.array().cast("array<string>")})
    return rows.drop("citations", "retrieved", "evidence", "required_terms", "answer")


def summary(scores: DataFrame) -> DataFrame:
    """Overall (type null) and by type: each mean and rate over its own questions, nulls skipped, three places."""
    graded = F.col("error").isNull()
    answerable, unanswerable = graded & F.col("answerable"), graded & ~F.col("answerable")
    declined = F.col("declines") == "yes"

    def mean(group: Column, value: Column) -> Column:
        return F.bround(F.avg(F.when(group, value.cast("double"))), 3)

    def n(group: Column) -> Column:
        return F.count(F.when(group, 1))

    return scores.groupingSets([[], ["type"]], "type").agg(
        F.count(F.lit(1)).alias("questions"),
        n(graded).alias("graded"),
        n(answerable).alias("answerable"),
        n(unanswerable).alias("unanswerable"),
        *(mean(answerable, F.col(c)).alias(c) for c in ("hit_at_1", "hit_at_3", "hit_at_5")),
        mean(answerable, F.col("reciprocal_rank")).alias("mrr"),
        mean(answerable, F.col("evidence_recall")).alias("evidence_recall"),
        mean(answerable & (F.col("evidence_items_total") > 1), F.col("evidence_recall") == 1).alias("all_evidence_found_multi"),
        mean(graded, F.col("required_terms_ok")).alias("required_terms_ok"),
        mean(answerable, F.col("cites_evidence_chunk")).alias("cites_evidence_chunk"),
        n(graded & (F.size("invalid_citation_numbers") > 0)).alias("invalid_citation_answers"),
        *(mean(answerable, F.col(c)).alias(c) for c in JUDGED),
        mean(unanswerable, declined).alias("refusal_accuracy"),
        mean(answerable, declined).alias("false_refusal_rate"),
    )


def failures(scores: DataFrame) -> DataFrame:
    """id, type, reasons (in order, joined) of the questions that lost marks."""
    found = lambda when, text: F.when(when, text)
    yes = F.col("answerable")
    part = lambda c: F.concat(F.lit(c.replace("_", " ") + " "), F.format_number(F.col(c), 2))
    reasons = F.array(
        found(yes & ~F.col("hit_at_5"), F.lit("evidence not retrieved in top 5")),
        found(yes & F.col("hit_at_5") & ~F.col("hit_at_1"), F.concat(F.lit("evidence at rank "), F.col("first_evidence_rank").cast("string"))),
        found(yes & (F.col("evidence_recall") < 1), F.concat(F.lit("evidence "), F.col("evidence_items_found"), F.lit("/"), F.col("evidence_items_total"))),
        found(yes & (F.col("declines") == "yes"), F.lit("false refusal")),
        found(yes & (F.col("answer_recall") < 1), part("answer_recall")),
        found(~yes & (F.col("declines") == "no"), F.lit("answered instead of declining")),
        found(F.col("faithfulness") < 1, part("faithfulness")),
        found(F.size("required_terms_missing") > 0, F.concat(F.lit("missing terms "), F.array_join("required_terms_missing", ", "))),
        found(F.size("invalid_citation_numbers") > 0, F.concat(F.lit("invalid citations "), F.array_join(F.col("invalid_citation_numbers").cast("array<string>"), ", "))),
        found(F.size("judge_errors") > 0, F.concat(F.lit("judge errors: "), F.array_join("judge_errors", ", "))),
    )
    lost = F.when(F.col("error").isNotNull(), F.concat(F.lit("run error: "), F.col("error"))).otherwise(F.array_join(F.array_compact(reasons), "; "))
    return scores.select("id", "type", lost.alias("reasons")).filter("reasons <> ''")


def report_rows(summaries: DataFrame, rates: list[str], means: list[str]) -> DataFrame:
    """type, metric, score as text: rates in whole percent, means with three decimals, a dash for null."""
    long = summaries.unpivot("type", [F.col(c).cast("double").alias(c) for c in (*rates, *means)], "metric", "value")
    percent = F.concat(F.bround(F.col("value") * 100, 0).cast("bigint").cast("string"), F.lit("%"))
    text = F.when(F.col("value").isNull(), "–").when(F.col("metric").isin(*rates), percent).otherwise(F.format_number("value", 3))
    return long.select("type", "metric", text.alias("score"))


def compare_runs(metrics: DataFrame, before: str, after: str) -> DataFrame:
    """type, metric, before, after, change, is_noise; metrics: run_name, type (null: overall), metric, value.

    Several rows of a run name (repeats) are averaged first.
    """
    means = metrics.filter(F.col("run_name").isin(before, after)).groupBy("type", "metric").agg(*(F.avg(F.when(F.col("run_name") == r, F.col("value"))).alias(a) for r, a in ((before, "before"), (after, "after"))))
    change = F.bround(F.col("after") - F.col("before"), 3)
    limit = F.when(F.col("type").isNull(), NOISE).otherwise(NOISE_BY_TYPE)
    return means.select("type", "metric", F.bround("before", 3).alias("before"), F.bround("after", 3).alias("after"), change.alias("change"), (F.abs(change) < limit).alias("is_noise"))
