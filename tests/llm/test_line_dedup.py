"""What line dedup puts into plans."""

from pyspark.sql import functions as F

from lodestone.llm import line_dedup


def test_levels_are_small_numbers_in_plans(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i))) for i in range(60)], "doc_id long, text string")
    levels = spark.range(1).select(line_dedup.rarity_levels(docs, 32).alias("levels")).first().levels
    assert len(levels) == 32 and all(-128 <= x < 128 for x in levels) and len(set(levels)) > 1


def test_copies_behind_an_unlike_first_line_meet_their_own_leader(spark):
    """The earliest line of all runs is unlike the 60 near copies that share them; the copies must not meet each other."""
    head, tail = " ".join(f"h{i}" for i in range(8)), " ".join(f"t{i}" for i in range(4))
    body = [f"b{i}" for i in range(28)]
    copies = [" ".join([head, *(f"own{i}" if i % 28 == j else w for j, w in enumerate(body)), tail]) for i in range(60)]
    texts = [" ".join([head, *(f"x{i}" for i in range(28)), tail]), *copies]
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    lines = line_dedup.lines_of(docs)
    sets = line_dedup.word_sets(lines, line_dedup.repeated_texts(lines), line_dedup.rarity_levels(docs, 32), 32)
    found = line_dedup.verified_pairs(docs, line_dedup.leader_pairs(sets))
    settled = found.groupBy("b_doc_id", "b_line_no", "b_key", "b_key2").agg(F.min("a_doc_id").alias("a_doc_id"), F.min("a_line_no").alias("a_line_no"))
    assert line_dedup.candidate_pairs(sets, settled).count() < 2 * len(copies)
    assert {(r.doc_id, r.first_doc) for r in line_dedup.repeated_lines(docs).collect()} == {(i, 2) for i in range(3, 62)}


def test_blanks_at_the_ends_of_a_line_are_no_words(spark):
    docs = spark.createDataFrame([(1, " \ta b\x0bc  d "), (2, "a b c d"), (3, "\x0c d c b a\r"), (4, " \t "), (5, " ")], "doc_id long, text string")
    assert {(r.doc_id, r.first_doc, r.similarity) for r in line_dedup.repeated_lines(docs).collect()} == {(2, 1, 1.0), (3, 1, 1.0)}
