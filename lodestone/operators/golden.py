"""Validation of a golden set against the chunk table; every problem is a row (id, check, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.tables import GOLDEN, cut_lineage

#: The question types.
TYPES = ("api_fact", "exact_identifier", "how_to", "faq", "paraphrased", "multi_chunk", "definition", "unanswerable")
FIELDS = ("id", "type", "question", "expected_answer", "evidence", "source_urls", "required_terms", "answerable", "notes")
#: The fields that aren't texts.
LISTS, FLAGS = ("evidence", "source_urls", "required_terms"), ("answerable",)
#: Bytes of evidence that go to the chunks at most; beyond that both are dealt by chunk.
BROADCAST = 32 << 20


def _blank(text: Column) -> Column:
    return F.trim(F.translate(text, "\t\r\n", "   ")) == ""


def _problem(when: Column, check: str, detail: Column) -> Column:
    return F.when(when, F.struct(F.lit(check).alias("check"), detail.cast("string").alias("detail")))


def missing_required_terms(answer: Column, terms: Column) -> Column:
    return F.filter(terms, lambda t: ~F.contains(F.lower(answer), F.lower(t)))


def type_problems(lines: DataFrame, *own: str) -> DataFrame:
    """id, check, detail for each field of a JSON record that is missing, null or of another type than it should be, and
    for lines that are no JSON object.  lines: value string; blank lines are skipped.

    The types are read from the record itself: a declared schema would turn a wrong one into a null.
    """
    rows = lines.filter(F.trim("value") != "").select(*own, F.try_parse_json("value").alias("v"), "value")
    kind = lambda c: F.schema_of_variant(F.try_variant_get("v", f"$.{c}", "variant"))
    wanted = lambda c: F.lit("list" if c in LISTS else "boolean" if c in FLAGS else "text")
    right = lambda c: kind(c).startswith("ARRAY") if c in LISTS else kind(c) == ("BOOLEAN" if c in FLAGS else "STRING")
    wrong = F.array_compact(F.array(*(F.when(~F.coalesce(right(c), F.lit(False)), F.concat(F.lit(f"{c}: not a "), wanted(c))) for c in FIELDS)))
    whole = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    name = F.coalesce(F.when(right("id"), F.try_variant_get("v", "$.id", "string")), F.lit("<no id>"))
    found = F.when(whole, F.transform(wrong, lambda w: F.struct(F.lit("missing or wrong type").alias("check"), w.alias("detail")))).otherwise(
        F.array(F.struct(F.lit("not a record").alias("check"), F.substring("value", 1, 80).alias("detail")))
    )
    return rows.select(*own, name.alias("id"), F.inline(found))


def golden_problems_of_lines(lines: DataFrame, chunks: DataFrame) -> DataFrame:
    """All problems of a golden set as it is stored; a record with wrong types is not looked at further."""
    own = lines.filter(F.trim("value") != "").withColumn("line", F.sha2("value", 256)).select("line", "value")
    wrong = type_problems(own, "line")
    rows = own.join(wrong.select("line").distinct(), "line", "left_anti").select(F.inline(F.array(F.from_json("value", GOLDEN))))
    return wrong.drop("line").unionByName(golden_problems(rows, chunks))


def record_checks(golden: DataFrame) -> DataFrame:
    """Checks within a record; a missing field stops the others."""
    missing = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(c)) for c in FIELDS)))
    terms = missing_required_terms(F.col("expected_answer"), F.col("required_terms"))
    no_quote = F.exists("evidence", lambda e: F.coalesce(_blank(e["quote"]), F.lit(True)) | (F.coalesce(F.size(e["chunk_ids"]), F.lit(0)) <= 0))
    own = F.array_compact(
        F.array(
            _problem(~F.col("type").isin(*TYPES), "unknown type", F.col("type")),
            _problem(_blank(F.col("question")) | _blank(F.col("expected_answer")), "empty question or answer", F.lit(None)),
            _problem(F.col("answerable") != (F.size("evidence") > 0), "answerable without evidence, or the reverse", F.lit(None)),
            _problem((F.col("type") == "unanswerable") == F.col("answerable"), "type and answerable disagree", F.col("type")),
            _problem(F.size(terms) > 0, "required terms not in the expected answer", F.array_join(terms, ", ")),
            _problem(no_quote, "evidence without quote or chunks", F.lit(None)),
        )
    )
    stop = F.array(_problem(F.lit(True), "missing fields", F.array_join(missing, ", ")))
    return golden.select("id", F.inline(F.when(F.size(missing) > 0, stop).otherwise(own)))


def _evidence(golden: DataFrame) -> DataFrame:
    items = golden.select("id", F.explode("evidence").alias("e"))
    return items.select("id", F.col("e.quote").alias("quote"), F.explode("e.chunk_ids").alias("chunk_id"))


def unknown_chunks(golden: DataFrame, chunks: DataFrame) -> DataFrame:
    gone = _evidence(golden).join(chunks.select("chunk_id"), "chunk_id", "left_anti").distinct()
    return gone.select("id", F.lit("unknown chunk").alias("check"), F.col("chunk_id").cast("string").alias("detail"))


def quote_not_in_chunk(golden: DataFrame, chunks: DataFrame) -> DataFrame:
    """Quotes must occur in each chunk they name, case aside."""
    evidence = _evidence(golden)
    size = evidence.agg(F.sum(F.coalesce(F.octet_length("quote"), F.lit(0)) + 64)).first()[0] or 0
    pairs = (F.broadcast(evidence) if size <= BROADCAST else evidence).join(chunks.select("chunk_id", "text"), "chunk_id")
    lost = pairs.filter(~F.contains(F.lower("text"), F.lower("quote")))
    return lost.select("id", F.lit("quote not in chunk").alias("check"), F.col("chunk_id").cast("string").alias("detail"))


def source_url_mismatch(golden: DataFrame, chunks: DataFrame) -> DataFrame:
    """The record's URLs must be those of its evidence chunks, as sets."""
    found = _evidence(golden).join(chunks.select("chunk_id", "source_url"), "chunk_id").groupBy("id").agg(F.array_sort(F.collect_set("source_url")).alias("found"))
    none = F.array().cast("array<string>")
    both = golden.select("id", F.array_sort(F.array_distinct("source_urls")).alias("named")).join(found, "id", "left")
    wrong = both.filter(F.coalesce("named", none) != F.coalesce("found", none))
    return wrong.select("id", F.lit("source urls differ from the evidence").alias("check"), F.array_join(F.coalesce("found", none), ", ").alias("detail"))


def duplicate_questions(golden: DataFrame) -> DataFrame:
    twice = golden.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return twice.select("id", F.lit("duplicate id").alias("check"), F.col("n").cast("string").alias("detail"))


def golden_problems(golden: DataFrame, chunks: DataFrame) -> DataFrame:
    """All checks as one table; the golden set, which may be made of the chunks, is worked out once."""
    golden = cut_lineage(golden)
    parts = [record_checks(golden), unknown_chunks(golden, chunks), quote_not_in_chunk(golden, chunks), source_url_mismatch(golden, chunks), duplicate_questions(golden)]
    return reduce(DataFrame.unionByName, parts)


def golden_counts(golden: DataFrame, types: tuple[str, ...] = TYPES) -> DataFrame:
    """Questions of each type, types without any included; with several evidence items; with required terms."""
    known = golden.sparkSession.createDataFrame([(t,) for t in types], "type string")
    per = golden.groupBy("type").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum((F.size("evidence") > 1).cast("long")).alias("several"),
        F.sum((F.size("required_terms") > 0).cast("long")).alias("terms"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return F.broadcast(known).join(per, "type", "left").select("type", zero("n").alias("questions"), zero("several").alias("several_evidence"), zero("terms").alias("with_required_terms"))
