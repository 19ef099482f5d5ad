"""Text, vector and answer functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the characters that the data model's trim takes off.
TRIMMED = " \t\n\r\0\x0b"
#: Fixed value: words that a question's terms leave out.
STOP_WORDS = "what where when which who does the and for with from that this".split()
#: Phrases that tell an abstention.
ABSTENTIONS = (
    "insufficient context", "not enough information", "cannot answer", "unable to answer", "does not mention",
    "no information", "not mentioned", "does not contain", "not contain", "资料不足", "信息不足", "无法回答", "不能回答",
    "没有足够", "未找到相关", "没有提到", "未提及", "没有相关", "未提供", "不包含", "未包含", "不含", "没有相关的", "没有提及",
)
#: The types of entities.
ENTITY_TYPES = ("Person", "Organization", "Product", "Location", "Event", "Concept", "Other")


def trim(x: Column) -> Column:
    return F.btrim(x, F.lit(TRIMMED))


def normalize_name(x: Column) -> Column:
    """Trimmed and lower-cased, without white space, punctuation and symbols."""
    return F.regexp_replace(F.lower(trim(x)), r"(?U)[\s\p{P}\p{S}]+", "")


def normalize_newlines(x: Column) -> Column:
    return trim(F.regexp_replace(x, "\r\n?", "\n"))


def terms(question: Column) -> Column:
    """Distinct search terms of a question, in order."""
    found = F.regexp_extract_all(F.lower(question), F.lit(r"[\p{IsHan}]{2,}|[\p{L}\p{N}][\p{L}\p{N}_-]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: ~t.isin(STOP_WORDS)))


def substring_count(text: Column, part: Column) -> Column:
    """Occurrences that do not overlap; 0 for an empty part."""
    n = (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)
    return F.when(F.length(part) > 0, n).otherwise(0).cast("bigint")


def keyword_score(text: Column, wanted: Column) -> Column:
    """Sum over the terms that occur of (1 + ln(occurrences)) * min(length, 20)."""

    # Most terms do not occur, and a search is cheaper than a replacement, so only terms that occur are counted.
    found = F.filter(wanted, lambda term: F.contains(text, term))
    worth = F.transform(found, lambda term: F.struct(substring_count(text, term).alias("n"), F.least(F.length(term), F.lit(20)).alias("l")))
    return F.aggregate(worth, F.lit(0.0), lambda total, w: total + (1 + F.ln(w["n"])) * w["l"])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays; -1 for empty arrays, unequal lengths or a zero vector."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    fits = (F.size(a) == F.size(b)) & (F.size(a) > 0)
    return F.when(fits & (norms > 0), dot(a, b) / norms).otherwise(-1.0)


def citations(answer: Column) -> Column:
    """Distinct numbers in [n], in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[([0-9]+)\]"), F.lit(1)), lambda x: x.cast("bigint")))


def has_citations(answer: Column) -> Column:
    return F.size(citations(answer)) > 0


def is_abstention(answer: Column) -> Column:
    """Empty, or with one of the known phrases."""
    text = F.lower(answer)
    told = F.lit(False)
    for phrase in ABSTENTIONS:
        told = told | text.contains(phrase)
    return (answer == "") | told


def citation_valid(cited: Column, n_sources: Column, answerable: Column) -> Column:
    """Null if the case expects no answer; without sources nothing may be cited; else all of 1..n, at least one."""
    inside = (F.size(cited) > 0) & F.forall(cited, lambda c: (c >= 1) & (c <= n_sources))
    judged = F.when(n_sources == 0, F.size(cited) == 0).otherwise(inside)
    return F.when(answerable.isNull() | answerable, judged)


def abstention_correct(abstained: Column, answerable: Column) -> Column:
    return F.when(answerable, ~abstained).when(~answerable, abstained)


def relation_type(x: Column) -> Column:
    """Upper case, with runs of other signs as one underscore, at most 100 characters."""
    name = F.regexp_replace(F.upper(trim(x)), "[^A-Z0-9_]+", "_")
    return F.substring(F.when(name == "", "RELATED_TO").otherwise(name), 1, 100)


def empty_to_null(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def embedding_text(name: Column, kind: Column, description: Column) -> Column:
    return F.concat_ws("\n", empty_to_null(name), empty_to_null(kind), empty_to_null(description))


def strip_code_fence(x: Column) -> Column:
    """The inside of a fenced answer, or the answer itself."""
    plain = trim(x)
    pattern = r"(?is)^```(?:json)?\s*(.*?)\s*```$"
    return F.when(F.regexp_like(plain, F.lit(pattern)), F.regexp_extract(plain, pattern, 1)).otherwise(plain)


def lenient_json(x: Column, schema: str) -> Column:
    """JSON of a model answer; raw control characters inside strings are accepted."""
    return F.from_json(strip_code_fence(x), schema, {"allowUnquotedControlChars": "true"})


def token_estimate(bytes_total: Column) -> Column:
    """Bytes over four, rounded up."""
    return F.ceil(bytes_total / 4).cast("bigint")


def messages_tokens(messages: Column) -> Column:
    """The estimate for a list of messages (structs with content): the bytes of all of them over four, rounded up."""
    sizes = F.transform(messages, lambda m: F.octet_length(F.coalesce(m["content"], F.lit(""))))
    return token_estimate(F.aggregate(sizes, F.lit(0), lambda total, n: total + n))


def split_model(x: Column) -> Column:
    """provider@model, split at the first sign."""
    parts = F.split(x, "@", 2)
    return F.struct(F.get(parts, F.lit(0)).alias("provider"), F.get(parts, F.lit(1)).alias("model"))


def weight_text(x: Column) -> Column:
    """A weight as text: whole numbers without a fraction."""
    return F.when(x == F.floor(x), F.floor(x).cast("bigint").cast("string")).otherwise(x.cast("string"))


def resolved_mode(mode: Column, n_communities: Column, n_graph_chunks: Column) -> Column:
    return F.when((mode == "global") & (n_communities > 0), "global").when(n_graph_chunks > 0, "local").otherwise("vector")


def metadata_field(metadata: Column, path: str, kind: str = "string") -> Column:
    """A value inside open metadata (a variant), by its path (`$.author.name`, `$.tags[0]`); null where it is not there or
    is of another kind."""
    return F.try_variant_get(metadata, path, kind)


def parsed_metadata(text: Column) -> Column:
    """JSON text as open metadata; null for what is no JSON."""
    return F.try_parse_json(text)
