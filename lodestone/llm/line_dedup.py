"""Line deduplication by an exact set similarity join, in DataFrame functions only.

A line is the set of its words in lower case.  A line goes if an earlier one (by doc_id, then place) has a Jaccard
similarity of 4/5 or more; of equal lines the first stays.  Lines without words always stay.

1. Lines with equal text are one class (by two hashes of the text); its first line stands for it.
2. Words are ordered by rarity: counts of all words of the corpus, in a fixed number of hash buckets, give
   each word a level; words of a level are ordered by hash.  Any common order makes the join exact, rarity
   makes it fast.
3. Near copies first meet early lines of their group: lines that share a run of words at the start or the
   end are grouped and held against the group's ``LEADERS`` earliest lines by length and sketch; the earliest
   that passes and the closest one are verified.  What that settles need only be held against still earlier
   lines, so a group of near copies costs its size.
4. Two sets can only be similar if they share a word of their prefixes (the first n - ceil(4n/5) + 1
   words), so prefixes are joined by word.  In the join a pair must also pass the length filter, the
   positional filter (what can still be common after the shared word), a parity sketch (the bits in
   which the sketches of two sets differ are no more than the words in which the sets differ), and the
   one line must be earlier than what the other is settled by.
5. What is left is verified on the whole word sets, by 64-bit hashes of the words.

Null and empty texts have no lines.  Rows may share a doc_id: their lines at one place count as equally
early and never remove each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut_lineage, table

#: Hash buckets of the word counts, a power of two; a level is 8 * log2 of a bucket's count, below 256.
BUCKETS = 1 << 17
#: Rows of lines that are broadcast; more are joined.
MAX_BROADCAST = 2_000_000
#: Words of a run at the start or the end of a line by which near copies meet their earliest line.
RUN = 4
BLANKS = r"[\x20\x09-\x0D]+"
#: Earliest lines of a run that all others of the run are held against.
LEADERS = 16
SPOT = ("doc_id", "line_no", "key", "key2")
PLACE = ("doc_id", "line_no")
TEXT = ("key", "key2")
#: Lines of more words have a second sketch, of those words that have a certain bit set.
WIDE = 96


def rarity_levels(docs: DataFrame, buckets: int = BUCKETS) -> Column:
    """The level of each bucket less 128, as one constant array: its size is fixed, and small numbers keep plans short."""
    words = docs.select(F.explode(F.split(F.lower("text"), BLANKS)).alias("word"))
    counts = words.groupBy(F.xxhash64("word").bitwiseAND(buckets - 1).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    levels = ["0"] * buckets
    found = counts.select("bucket", F.least(F.lit(255), F.round(8 * F.log2(F.col("n") + 1))).cast("int").alias("level")).toArrow()
    for bucket, level in zip(found.column("bucket").to_pylist(), found.column("level").to_pylist()):
        levels[bucket] = str(level - 128)
    return F.split(F.lit(",".join(levels)), ",").cast("array<bigint>")


def word_hashes(line: str) -> Column:
    """64-bit hashes of the words of a line, in order; what a split leaves empty at either end is taken out as a number."""
    return F.array_remove(F.transform(F.split(F.lower(line), BLANKS), lambda w: F.xxhash64(w)), F.xxhash64(F.lit("")))


def text_keys() -> tuple[Column, Column]:
    """key, key2: two hashes of a line, by which lines are equal."""
    return F.xxhash64("line").alias("key"), F.xxhash64(F.lit(7), "line", F.length("line")).alias("key2")


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, line, key, key2 (hashes of the text) of every line with a word."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    worded = lines.filter(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    return worded.select("doc_id", "line_no", "line", *text_keys())


def _place() -> Column:
    """doc_id and line_no as one number, so that Spark can aggregate by hashing."""
    return (F.col("doc_id").cast("decimal(19,0)") * F.lit(10**10).cast("decimal(11,0)") + F.col("line_no")).cast("decimal(38,0)")


def repeated_texts(lines: DataFrame) -> DataFrame:
    """key, key2, first_doc, first_line (its first line) of each text that more lines than one have."""
    classes = lines.groupBy(*TEXT).agg(F.min(_place()).alias("place"), F.count(F.lit(1)).alias("n_lines")).filter("n_lines > 1")
    line_no = F.pmod("place", F.lit(10**10).cast("decimal(11,0)"))
    doc_id = ((F.col("place") - line_no) / F.lit(10**10).cast("decimal(11,0)")).cast("bigint")
    return classes.select(*TEXT, doc_id.alias("first_doc"), line_no.cast("int").alias("first_line"))


def word_sets(lines: DataFrame, repeated: DataFrame, levels: Column, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, line_no, key, key2, n, low, high (sketch), runs, prefix, many (the text repeats) of the first line of
    each text.

    Words of a prefix are 31 bits of their hashes; words that share them by chance only cost a look.
    """
    firsts = lines.join(_sized(repeated), list(TEXT), "left").withColumn("many", F.col("first_doc").isNotNull())
    firsts = firsts.filter(~F.col("many") | ((F.col("doc_id") == F.col("first_doc")) & (F.col("line_no") == F.col("first_line"))))
    hashed = firsts.select(*SPOT, "many", word_hashes("line").alias("hashes"))
    # without nulls, Spark sorts plain numbers
    level = lambda h: F.shiftleft(F.coalesce(F.get(levels, h.bitwiseAND(buckets - 1).cast("int")), F.lit(0)), 56)
    order = F.sort_array(F.transform(F.array_distinct("hashes"), lambda h: level(h).bitwiseOR(F.shiftrightunsigned(h, 8))))
    size = F.size("hashes")
    starts = (F.lit(1), F.lit(RUN + 1), F.greatest(F.lit(1), size - RUN + 1))
    runs = [F.xxhash64(F.lit(i), F.slice("hashes", s, F.lit(RUN))) for i, s in enumerate(starts) if i != 1]
    runs.append(F.when(size > 2 * RUN, F.xxhash64(F.lit(1), F.slice("hashes", starts[1], F.lit(RUN)))))
    made = hashed.select(*SPOT, "many", F.filter(F.array(*runs), lambda r: r.isNotNull()).alias("runs"), order.alias("ordered"))
    parity = "aggregate({}, 0L, (a, h) -> a ^ shiftleft(1L, cast(h & 63 as int)))"
    low = F.expr(parity.format("ordered"))
    high = F.expr(f"if(size(ordered) > {WIDE}, {parity.format('filter(ordered, h -> (h & 64) = 64)')}, null)")
    first = F.slice("ordered", 1, F.size("ordered") - F.expr("(4 * size(ordered) + 4) div 5").cast("int") + 1)
    prefix = F.transform(first, lambda w: F.pmod(w, F.lit(2**31 - 1)).cast("int"))
    sets = cut_lineage(made.select(*SPOT, "many", F.size("ordered").alias("n"), low.alias("low"), high.alias("high"), "runs", prefix.alias("prefix")))
    if sets.filter("many").count() > repeated.count():  # whole rows are repeated
        sets = cut_lineage(sets.dropDuplicates(list(SPOT)))
    return sets


def _earlier(x: str, y: str) -> Column:
    """Whether place x is before place y; x and y are prefixes of column names."""
    return (F.col(f"{x}doc_id") < F.col(f"{y}doc_id")) | ((F.col(f"{x}doc_id") == F.col(f"{y}doc_id")) & (F.col(f"{x}line_no") < F.col(f"{y}line_no")))


def _apart(x: str, y: str) -> Column:
    """In how many words two sets differ at least, by their sketches; x and y are prefixes of column names."""
    of_all, of_some = (F.col(f"{x}{c}").bitwiseXOR(F.col(f"{y}{c}")) for c in ("low", "high"))
    return F.coalesce(F.bit_count(of_some) + F.bit_count(of_all.bitwiseXOR(of_some)), F.bit_count(of_all))


def _alike(x: str, y: str) -> Column:
    """The length filter and the sketch."""
    return (5 * F.least(f"{x}n", f"{y}n") >= 4 * F.greatest(f"{x}n", f"{y}n")) & (9 * _apart(x, y) <= F.col(f"{x}n") + F.col(f"{y}n"))


def _sized(rows: DataFrame, most: int = MAX_BROADCAST) -> DataFrame:
    """``rows``, which are written already, to be broadcast if they are few enough."""
    return F.broadcast(rows) if rows.count() <= most else rows


def _named(side: str, columns: tuple[str, ...] = SPOT, of: str = "") -> list[Column]:
    return [F.col(f"{of}{c}").alias(f"{side}_{c}") for c in columns]


def leader_pairs(sets: DataFrame, hops: int = 2, most: int = LEADERS) -> DataFrame:
    """(a, b): each line with two of the ``most`` earliest lines of its runs: of those that are earlier and pass the
    filters, the earliest one and the one that the sketches say is closest.

    Where the earliest one has such a leader itself and the two pass the filters, too, the leader's leader is taken.
    """
    own = ("n", "low", "high")
    of = lambda s: [f"{s}_{c}" for c in (*SPOT, *own)]
    runs = sets.select(*SPOT, *own, F.explode("runs").alias("run"))
    shared = cut_lineage(runs.groupBy("run").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"))
    grouped = cut_lineage(runs.join(_sized(shared), "run").withColumnsRenamed({c: f"b_{c}" for c in (*SPOT, *own)}))
    rank = F.row_number().over(Window.partitionBy("run").orderBy(*(f"b_{c}" for c in PLACE)))
    leaders = cut_lineage(grouped.withColumn("rank", rank).filter((F.col("rank") <= most) & (F.col("rank") < F.col("members"))).select(F.col("run").alias("a_run"), *(F.col(y).alias(x) for x, y in zip(of("a"), of("b")))))
    met = grouped.join(_sized(leaders), (F.col("run") == F.col("a_run")) & _earlier("a_", "b_") & _alike("a_", "b_"))
    share = (_apart("a_", "b_") / (F.col("a_n") + F.col("b_n"))).alias("share")
    led = cut_lineage(met.groupBy(*of("b")).agg(F.min(F.struct(*of("a"))).alias("a"), F.min(F.struct(share, *of("a"))).alias("closest")))
    now = led.select("a.*", *of("b"))
    for _ in range(hops):
        above = now.select(*(F.col(f"b_{c}").alias(f"a_{c}") for c in SPOT), F.struct(*(F.col(c).alias(f"up_{c[2:]}") for c in of("a"))).alias("up"))
        hop = now.join(above, [f"a_{c}" for c in SPOT], "left").select(*of("a"), *of("b"), "up.*")
        now = hop.select(*(F.when(_alike("up_", "b_"), F.col(f"up_{c}")).otherwise(F.col(f"a_{c}")).alias(f"a_{c}") for c in (*SPOT, *own)), *of("b"))
    ends = [f"{s}_{c}" for s in "ab" for c in PLACE]
    return now.select(*ends).union(led.select("closest.*", *of("b")).select(*ends)).distinct()


def candidate_pairs(sets: DataFrame, settled: DataFrame) -> DataFrame:
    """(a, b): places of sets that pass all filters, a earlier than what b is settled by, else than b.

    settled: a, b.  Both sides of the join use the same columns, so that the entries are shuffled once.
    """
    bound = settled.select(*(F.col(f"b_{c}").alias(c) for c in SPOT), *_named("until", PLACE, "a_"))
    entries = sets.join(_sized(bound), list(SPOT), "left").select(*PLACE, "n", "low", "high", "until_doc_id", "until_line_no", F.posexplode("prefix").alias("place", "word"))
    x, y = entries.alias("x"), entries.alias("y")
    until_doc, until_line = F.coalesce("y.until_doc_id", "y.doc_id"), F.coalesce("y.until_line_no", "y.line_no")
    before = (F.col("x.doc_id") < until_doc) | ((F.col("x.doc_id") == until_doc) & (F.col("x.line_no") < until_line))
    most = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    on = (F.col("x.word") == F.col("y.word")) & (F.col("x.doc_id") <= F.col("y.doc_id")) & before & (9 * most >= 4 * (F.col("x.n") + F.col("y.n"))) & _alike("x.", "y.")
    met = x.join(y, on).select(*_named("a", (*PLACE, "until_doc_id", "until_line_no"), "x."), *_named("b", PLACE, "y.")).distinct()
    return met.select(*(f"{s}_{c}" for s in "ab" for c in PLACE))


def verified_pairs(docs: DataFrame, pairs: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """The pairs whose word sets are similar, with the hashes of both texts and similarity."""
    ends = pairs.select(F.col("a_doc_id").alias("doc_id"), F.col("a_line_no").alias("line_no")).union(pairs.select("b_doc_id", "b_line_no")).distinct()
    wanted = cut_lineage(ends.groupBy("doc_id").agg(F.collect_list("line_no").alias("wanted")))
    n = wanted.agg(F.sum(F.size("wanted")).alias("n")).first().n or 0
    rows = docs.select("doc_id", "text").join(F.broadcast(wanted) if n <= max_broadcast else wanted, "doc_id")
    rows = rows.select("doc_id", F.split("text", "\n").alias("lines"), F.explode("wanted").alias("line_no"))
    rows = rows.select(*PLACE, F.get("lines", "line_no").alias("line")).filter("line is not null")
    words = rows.select(*PLACE, *text_keys(), F.array_distinct(word_hashes("line")).alias("words")).filter(F.size("words") > 0).dropDuplicates(list(SPOT))
    side = lambda s: words.select(*_named(s, (*SPOT, "words")))
    on = lambda s: [f"{s}_{c}" for c in PLACE]
    made = pairs.join(side("a"), on("a")).join(side("b"), on("b"))
    made = made.withColumn("common", F.size(F.array_intersect("a_words", "b_words"))).withColumn("both", F.size("a_words") + F.size("b_words"))
    similar = made.filter(9 * F.col("common") >= 4 * F.col("both"))
    return similar.select(*(f"{s}_{c}" for s in "ab" for c in SPOT), (F.col("common") / (F.col("both") - F.col("common"))).alias("similarity"))


def earliest(similar: DataFrame) -> DataFrame:
    """Of each line's similar pairs the one with the earliest line."""
    b = [f"b_{c}" for c in SPOT]
    return cut_lineage(similar.groupBy(*b).agg(F.min(F.struct(*(f"a_{c}" for c in SPOT), "similarity")).alias("a")).select("a.*", *b))


def repeated_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, key, first_doc, first_line, similarity of every line that goes.

    first_doc and first_line are the earliest similar line; similarity is 1.0 for an equal set of words;
    key is a hash of the line.  Rows without a doc_id have no lines here: none of theirs goes.
    """
    docs = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull())
    lines = lines_of(docs)
    repeated = cut_lineage(repeated_texts(lines))
    sets = word_sets(lines, repeated, rarity_levels(docs))
    settled = earliest(verified_pairs(docs, cut_lineage(leader_pairs(sets))))
    pairs = cut_lineage(candidate_pairs(sets, settled))
    similar = settled.unionByName(verified_pairs(docs, pairs))
    found = similar.select(*(F.col(f"b_{c}").alias(c) for c in TEXT), F.struct(F.col("a_doc_id").alias("first_doc"), F.col("a_line_no").alias("first_line"), "similarity").alias("e"))
    own = repeated.select(*TEXT, F.struct("first_doc", "first_line", F.lit(1.0).alias("similarity")).alias("e"))
    named = cut_lineage(found.unionByName(own).groupBy(*TEXT).agg(F.min("e").alias("e")).select(*TEXT, "e.*"))
    at_first = (F.col("doc_id") == F.col("first_doc")) & (F.col("line_no") == F.col("first_line"))
    return lines.drop("line").join(_sized(named), list(TEXT)).filter(~at_first).select("doc_id", "line_no", "key", "first_doc", "first_line", "similarity")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of ``documents`` that goes, with the earliest line that it repeats."""
    return repeated_lines(table(spark, sf_dir, "documents")).drop("key")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the texts without the lines that go; n_chars follows, other columns stay.

    A document that loses all its lines stays with an empty text.
    """
    gone = repeated_lines(docs).groupBy("doc_id").agg(F.collect_set(F.struct("line_no", "key")).alias("gone_lines"))
    row = docs.select("doc_id", F.struct(*docs.columns).alias("row")).join(gone, "doc_id", "left")
    lines = F.transform(F.split(F.col("row.text"), "\n"), lambda line, i: F.struct(line.alias("line"), F.struct(i.alias("line_no"), F.xxhash64(line).alias("key")).alias("spot")))
    kept = F.transform(F.filter(lines, lambda x: ~F.array_contains("gone_lines", x["spot"])), lambda x: x["line"])
    text = F.when(F.col("gone_lines").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    changed = {"text": text, "n_chars": F.length(text).cast("long")}
    return row.select(*(changed[c].alias(c) if c in changed else F.col("row").getField(c).alias(c) for c in docs.columns))
