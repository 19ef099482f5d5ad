"""Retrieval and answer quality over cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import abstention_correct, citation_valid, citations, is_abstention, trim

EXCERPT = 160
#: Fixed value: what counts as a number.
NUMBER = r"^[ \t\n\r\x0B\f]*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?[ \t\n\r\x0B\f]*$"

METRICS = ("recall_at_k", "mrr", "mode_accuracy", "answer_coverage", "source_coverage", "citation_validity", "abstention_accuracy", "answer_term_coverage")


def _matches(expected: Column, source: Column) -> Column:
    """A number, also with a fraction or an exponent, names a document by its whole part; other text a title or source."""
    number = F.when(F.regexp_like(expected, F.lit(NUMBER)), expected.try_cast("double").cast("bigint"))
    by_text = F.coalesce(expected == source["title"], F.lit(False)) | F.coalesce(expected == source["source"], F.lit(False))
    return F.when(number.isNotNull(), number == source["document_id"]).otherwise(by_text)


def relevant_ranks(expected: Column, sources: Column) -> Column:
    """Ranks of sources that match an expected source; each expected one is used once, in source order.

    `sources` is an array of structs (document_id, title, source). A fold keeps the indexes used so far.
    """
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<int>").alias("ranks"))

    def step(state: Column, at: Column) -> Column:
        free = F.filter(F.sequence(F.lit(0), F.size(expected) - 1), lambda i: ~F.array_contains(state["used"], i) & _matches(F.get(expected, i), F.get(sources, at - 1)))
        hit = F.size(free) > 0
        return F.when(hit, F.struct(F.array_append(state["used"], F.get(free, F.lit(0))).alias("used"), F.array_append(state["ranks"], at).alias("ranks"))).otherwise(state)

    usable = (F.size(expected) > 0) & (F.size(sources) > 0)
    folded = F.aggregate(F.sequence(F.lit(1), F.size(sources)), start, step, lambda s: s["ranks"])
    return F.when(usable, folded).otherwise(F.array().cast("array<int>"))


def judge(cases: DataFrame) -> DataFrame:
    """Per-case metrics of (id, expected_mode, mode, answer, answerable, expected_sources, expected_terms, sources), and
    its latency_ms where that is known."""
    answer = trim(F.coalesce("answer", F.lit("")))
    wanted = F.filter(F.transform(F.coalesce("expected_terms", F.array().cast("array<string>")), trim), lambda t: t != "")
    expected = F.coalesce("expected_sources", F.array().cast("array<string>"))
    rows = cases.withColumns(
        {"_answer": answer, "_terms": wanted, "_expected": expected, "ranks": relevant_ranks(expected, F.col("sources")), "citations": citations(answer), "is_abstention": is_abstention(answer)}
    )
    none = F.size("_expected") == 0
    found = F.size(F.filter("_terms", lambda t: F.lower("_answer").contains(F.lower(t))))
    return rows.select(
        "id",
        *(["latency_ms"] if "latency_ms" in cases.columns else []),
        F.when(F.col("expected_mode").isNotNull(), F.col("mode") == F.col("expected_mode")).alias("mode_correct"),
        F.when(~none, F.size("ranks") / F.size("_expected")).alias("recall_at_k"),
        F.when(~none, F.when(F.size("ranks") > 0, 1 / F.array_min("ranks")).otherwise(0.0)).alias("reciprocal_rank"),
        (F.col("_answer") != "").alias("answer_present"),
        F.substring("_answer", 1, EXCERPT).alias("answer_excerpt"),
        (F.size("sources") > 0).alias("source_present"),
        "citations",
        citation_valid(F.col("citations"), F.size("sources"), F.col("answerable")).alias("citation_valid"),
        "is_abstention",
        abstention_correct(F.col("is_abstention"), F.col("answerable")).alias("abstention_correct"),
        F.when(F.size("_terms") > 0, found / F.size("_terms")).alias("answer_term_coverage"),
    )


def summarize(judged: DataFrame) -> DataFrame:
    """One row: the number of cases, and each metric over the cases where it is defined (null if there are none).

    Where cases have a `latency_ms`, its mean is told too.
    """
    mean = lambda name: F.round(F.avg(F.col(name).cast("double")), 5)
    return judged.agg(
        F.count("*").alias("cases"), mean("recall_at_k").alias("recall_at_k"), mean("reciprocal_rank").alias("mrr"), mean("mode_correct").alias("mode_accuracy"),
        mean("answer_present").alias("answer_coverage"), mean("source_present").alias("source_coverage"), mean("citation_valid").alias("citation_validity"),
        mean("abstention_correct").alias("abstention_accuracy"), mean("answer_term_coverage").alias("answer_term_coverage"),
        *([F.round(F.avg("latency_ms"), 2).alias("average_latency_ms")] if "latency_ms" in judged.columns else []),
    )


def report(judged: DataFrame, dataset: str, kb_id: int, now: str) -> dict:
    """The report of an evaluation: its dataset, knowledge base and time, the summary, and every case.

    Cases come from a dataset file, so they fit the driver.
    """
    summary = summarize(judged).first().asDict()
    return {"dataset": dataset or "unnamed", "knowledge_base_id": kb_id, "generated_at": now, "summary": summary, "cases": [r.asDict(recursive=True) for r in judged.orderBy("id").collect()]}


def gate(summary: dict[str, float | None], minimum: dict[str, float]) -> list[str]:
    """Metrics below their minimum; a minimum of 0 or less asks for nothing, a metric without a value fails."""
    return [name for name, low in minimum.items() if low > 0 and (summary.get(name) is None or summary[name] < low)]


def first_cases(cases: list[dict], limit: int | None = None) -> list[dict]:
    """The cases of a dataset, checked: at least one, and each with a question."""
    if not cases:
        raise ValueError("an evaluation dataset needs cases")
    kept = cases if limit is None else cases[: max(1, limit)]
    if any(not isinstance(c.get("question"), str) or not c["question"].strip() for c in kept):
        raise ValueError("every case needs a question")
    return kept
