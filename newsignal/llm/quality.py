"""Quality rules: hashed n-gram log-likelihood ratio between a trusted and the raw corpus.

Every text is cut into words ``[^\\x20\\x09-\\x0D]+``. Its word unigrams and bigrams are hashed into
``buckets`` cells. Two multinomials over the cells are counted, one over the trusted documents and one
over all documents; the weight of a cell is the logarithm of their ratio, and the score of a document is
the mean weight of its n-grams. A document is kept if it passes the base rules and its score reaches
``least_score``. Nothing is drawn at random, so equal texts get equal verdicts.

Only DataFrame functions run. N-grams are exploded and summed up within each input task, so what is
shuffled is one row per cell and task, or one row per document. The weights are a column of ``buckets``
numbers, a size that does not depend on the corpus. They are whole millionths: sums are exact in any order. The raw corpus is counted without
a join; of the texts only those whose id passes a bit test for the trusted ones are shuffled.

Defined cases: a null or blank text has no words, fails the base rules and has score 0; rows are scored
one by one, so repeated rows and repeated or null ids each give their own row; without trusted documents
all weights are 0 and the base rules alone decide; an empty table gives an empty result. Columns of the
input other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsignal.functions.bits import bit_table, may_hold

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5

#: The method's parameters.
BUCKETS = 1 << 16
LEAST_SCORE = -0.12
#: Added to both counts of a cell, at the scale of the trusted corpus.
PSEUDO_COUNT = 2.0
UNIT = 1_000_000
#: Bits that tell ids apart before the join with the trusted ones, and shares of an id in that join.
BITS = 1 << 24
SALTS = 8


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def _repeated_words(tokens: Column) -> Column:
    """Words that lie in a window of five words found at least twice in the text."""
    def windows(w):
        shifted = [F.slice(w, k + 1, F.size(w) - (WINDOW - 1)).alias(f"w{k}") for k in range(WINDOW)]
        return F.transform(F.arrays_zip(*shifted), lambda window: F.xxhash64(window))

    def covered(starts):
        return F.aggregate(
            F.transform(starts, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, j + 1) - x, F.lit(WINDOW)))),
            F.lit(0), lambda total, x: total + x,
        )

    def count(keys):
        def starts(order):
            def twin(x, j):
                same = lambda k: F.coalesce(F.get(order, k)["key"] == x["key"], F.lit(False))
                return same(j + 1) | same(j - 1)

            return F.sort_array(F.transform(F.filter(order, twin), lambda x: x["at"]))

        in_order = F.sort_array(F.transform(keys, lambda key, at: F.struct(key.alias("key"), at.alias("at"))))
        repeats = F.size(F.array_distinct(keys)) < F.size(keys)
        return F.when(repeats, let(let(in_order, starts), covered)).otherwise(F.lit(0))

    return F.when(F.size(tokens) > WINDOW, let(windows(tokens), count)).otherwise(F.lit(0))


def base_columns(docs: DataFrame) -> DataFrame:
    """doc_id, tokens, the counts of the base rules and base_failed."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = docs.select(
        "doc_id", words(F.col("text")).alias("tokens"),
        F.regexp_count("text", F.lit(SYMBOLS)).alias("symbols"), lines.alias("lines"),
    ).select(
        "doc_id", "tokens",
        F.size("tokens").cast("bigint").alias("n_words"),
        F.length(F.array_join("tokens", "")).cast("bigint").alias("word_chars"),
        F.coalesce("symbols", F.lit(0)).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        _repeated_words(F.col("tokens")).cast("bigint").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.withColumn("base_failed", failed)


def _positions(tokens: Column) -> Column:
    """One number for each n-gram: unigrams at even, bigrams at odd places."""
    return F.when(F.size(tokens) > 0, F.sequence(F.lit(0), 2 * F.size(tokens) - 2))


def _cell(tokens: str, position: str, buckets: int) -> Column:
    here = F.shiftright(position, 1)
    word, following = F.get(tokens, here), F.get(tokens, here + 1)
    key = F.when(F.col(position) % 2 == 0, F.xxhash64(word)).otherwise(F.xxhash64(word, following))
    return F.pmod(key, F.lit(buckets)).cast("int")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of all documents labelled as good, once each."""
    return labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def trusted_texts(docs: DataFrame, trusted: DataFrame, bits: int = BITS) -> DataFrame:
    """text of every row whose id is in ``trusted`` (an id once).

    A fixed number of bits tells most other rows apart where they are read; only what is left is shuffled, in ``SALTS`` shares of each id.
    """
    table = bit_table(trusted, "doc_id", bits).scalar()
    maybe = docs.filter(F.col("doc_id").isNotNull() & may_hold(table, F.col("doc_id"), bits))
    salted = maybe.withColumn("salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)))
    shares = trusted.select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
    return salted.join(shares.hint("merge"), ["doc_id", "salt"], "left_semi").select("text")


def cell_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """cell and n, the n-grams of all texts that fall into it."""
    tokens = docs.select(words(F.col("text")).alias("tokens"))
    placed = tokens.select("tokens", F.explode(_positions(F.col("tokens"))).alias("p"))
    return placed.select(_cell("tokens", "p", buckets).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


def cell_weights(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row with one array: the log-ratio of every cell in millionths, counted over all documents; ``trusted`` has an id once."""
    spark = docs.sparkSession
    raw = cell_counts(docs, buckets).withColumnRenamed("n", "raw")
    good = cell_counts(trusted_texts(docs, trusted), buckets).withColumnRenamed("n", "good")
    counts = raw.join(good, "cell", "left")  # ``buckets`` rows at most
    full = spark.range(buckets).select(F.col("id").cast("int").alias("cell")).join(F.broadcast(counts), "cell", "left")
    rows = full.agg(
        F.sort_array(F.collect_list(F.struct(
            "cell", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("good", F.lit(0)).alias("good"),
        ))).alias("rows"),
        F.coalesce(F.sum("good") / F.sum("raw"), F.lit(0.0)).alias("share"),
    )
    ratio = lambda x, share: F.log((x["good"] + PSEUDO_COUNT) / (x["raw"] * share + PSEUDO_COUNT))
    return rows.select(F.transform(
        "rows", lambda x: F.round(ratio(x, F.col("share")) * UNIT).cast("bigint"),
    ).alias("weights"))


def quality_rules(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, least_score: float = LEAST_SCORE) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score."""
    docs = docs.select("doc_id", "text")
    weights = cell_weights(docs, trusted_ids(labels), buckets).scalar()
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    numbered = base_columns(docs).withColumn("row", F.monotonically_increasing_id())
    placed = numbered.select("row", *names, "tokens", F.explode_outer(_positions(F.col("tokens"))).alias("p"))
    weight = F.when(F.col("p").isNotNull(), F.get(weights, _cell("tokens", "p", buckets)))
    summed = placed.groupBy("row").agg(
        *(F.first(n).alias(n) for n in names), F.coalesce(F.sum(weight), F.lit(0)).alias("total"))
    n_grams = F.greatest(2 * F.col("n_words") - 1, F.lit(1))
    return summed.withColumn("score", F.col("total") / (n_grams * UNIT)).select(
        *names, (~F.col("base_failed") & (F.col("score") >= least_score)).alias("kept"), "score")
