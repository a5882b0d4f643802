"""Quality rules for edit texts: a hashed n-gram log-likelihood ratio beside plain counts.

Two multinomials over hash buckets of token n-grams are counted over the distinct texts of
all edits: one from the texts a reader trusts (the label of an edit with it says so), one from every
text. Copies of a text under other ids so move neither, and no text fails for being frequent. An
edit's score is the mean of ``ln p_trusted(bucket) - ln p_raw(bucket)`` over its n-grams,
so long and short edits compare. Every edit is judged by the same threshold; nothing is
drawn at random, so a re-run keeps the same edits.

Only column expressions are used. The corpus counts are as many rows as there are buckets,
which is also the size of what each task receives to score with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import edit_columns
from tidemark.session import stored

BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BUCKETS = 8_192
#: Occurrences added to every bucket: in a small corpus a few copies of a text must not outweigh its labels.
SMOOTHING = 10.0
#: Occurrences that the trusted side starts with, spread like the raw corpus: without labels no bucket speaks for or against a text.
PRIOR = SMOOTHING * BUCKETS
#: The prior is no more than this share of the raw corpus, so that in a small one labels still weigh.
PRIOR_SHARE = 0.1
#: Nats for each n-gram; an edit below it reads unlike the trusted ones.
THRESHOLD = -0.30
#: Labelled edits that the trusted multinomial is fitted on; more are thinned by a hash of their id.
TRUSTED_LIMIT = 200_000
#: Bits of the filter by which rows of texts with copies are found without moving the others; a full one only lets more rows through.
FILTER_BITS = 1 << 22
MIN_WORDS = 20
REPEAT_WINDOW = 8
REPEAT_PERCENT = 30


def words(text: Column) -> Column:
    """Runs of characters other than blanks, in order."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK))


def tokens(text: Column) -> Column:
    """Words with their punctuation runs set apart, so that marks are tokens of their own."""
    return words(F.regexp_replace(text, r"(\p{Punct}+)", " $1 "))


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def ngram_buckets(text: Column, buckets: int = BUCKETS) -> Column:
    """Bucket of every unigram and every bigram of the text's tokens."""

    def both(found: Column) -> Column:
        one = F.transform(found, lambda t: F.pmod(F.xxhash64(t), F.lit(buckets)).cast("int"))
        two = F.transform(
            F.slice(found, 2, F.size(found)),
            lambda t, i: F.pmod(F.xxhash64(F.get(found, i), t), F.lit(buckets)).cast("int"),
        )
        return F.when(F.size(found) > 1, F.concat(one, two)).otherwise(one)

    return _let(tokens(text), both)


def _repeated_words(found: Column) -> Column:
    """Words inside windows of 8 words that occur twice or more in the same text."""
    n = F.size(found) - REPEAT_WINDOW

    def doubled(width: int):
        """Hashes of runs of ``2 * width`` words from those of ``width`` words."""
        return lambda h: F.transform(F.slice(h, width + 1, F.size(h) - width), lambda x, i: F.xxhash64(F.get(h, i), x))

    def windows() -> Column:
        single = F.transform(found, lambda w: F.xxhash64(w))
        return _let(_let(_let(single, doubled(1)), doubled(2)), doubled(4))

    def covered(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            twin = F.filter(
                s,
                lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)),
            )
            return F.sort_array(F.transform(twin, lambda x: x["i"]))

        def width(at: Column) -> Column:
            step = F.transform(at, lambda x, i: F.least(F.lit(REPEAT_WINDOW), F.coalesce(F.get(at, i + 1) - x, F.lit(REPEAT_WINDOW))))
            return F.aggregate(step, F.lit(0), lambda a, b: a + b)

        repeats = _let(_let(ordered, places), width)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(repeats)

    return F.when(n < 1, F.lit(0)).otherwise(_let(windows(), covered)).cast("bigint")


def base_counts(text: Column) -> Column:
    """Struct n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    by_words = _let(words(text), lambda w: F.struct(F.size(w).cast("bigint").alias("n"), _repeated_words(w).alias("r")))
    return _let(
        by_words,
        lambda c: F.struct(
            c["n"].alias("n_words"),
            F.char_length(F.translate(text, BLANKS, "")).cast("bigint").alias("word_chars"),
            (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
            _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint")).alias("n_dup_lines"),
            c["r"].alias("n_repeat_words"),
        ),
    )


def trusted_sample(trusted: DataFrame, limit: int = TRUSTED_LIMIT) -> DataFrame:
    """Distinct trusted ids, at most about ``limit`` of them, chosen by a hash of the id."""
    ids = trusted.select(F.col("rev_id").cast("bigint").alias("rev_id")).where(F.col("rev_id").isNotNull()).distinct()
    ids = stored(ids, "trusted-ids")
    share = min(1.0, limit / max(1, ids.count()))
    return ids.where(F.pmod(F.xxhash64("rev_id"), F.lit(1 << 31)) < int(share * (1 << 31)))


def _filter_of(copied: DataFrame) -> Column:
    """Bits of the rows that stand for texts with copies, as an array of ``FILTER_BITS / 64`` numbers, whatever the corpus."""
    at = F.pmod(F.xxhash64("h1", "h2", "one"), F.lit(FILTER_BITS))
    words = copied.select(F.shiftright(at, 6).alias("id"), F.call_function("shiftleft", F.lit(1).cast("bigint"), (at % 64).cast("int")).alias("bit"))
    words = words.groupBy("id").agg(F.bit_or("bit").alias("word"))
    dense = copied.sparkSession.range(FILTER_BITS // 64).join(words, "id", "left")
    ordered = F.array_sort(F.collect_list(F.struct("id", F.coalesce("word", F.lit(0).cast("bigint")).alias("word"))))
    return dense.agg(F.transform(ordered, lambda w: w["word"]).alias("bits")).scalar()


def _in_filter(key: Column, bits: Column) -> Column:
    at = F.pmod(key, F.lit(FILTER_BITS))
    return F.call_function("shiftright", F.get(bits, F.shiftright(at, 6).cast("int")), (at % 64).cast("int")).bitwiseAND(F.lit(1)) == 1


def ratio_table(
    edits: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING, limit: int = TRUSTED_LIMIT, prior: float = 0.0
) -> DataFrame:
    """(bucket, ratio) for every bucket that occurs; the raw corpus is counted over all distinct texts.

    ``trusted`` lists the ``rev_id`` of trusted edits; repeats and NULLs do no harm. The
    trusted multinomial is fitted on at most about ``limit`` of them, so their ids can be sent to
    every task. A text is trusted if any of its edits is, and counts once on both sides; only where
    rows repeat its first trusted id, it counts on both sides as often as they do. A bucket that
    occurs nowhere has no row, and no edit can ask for it. With a ``prior`` the trusted multinomial
    starts with so many occurrences (at most ``PRIOR_SHARE`` of the raw ones) in proportion to the raw one, and labels pull it away from
    there; without any, all ratios are 0. With no prior it is smoothed uniformly, as the raw one is.
    """
    mark = F.broadcast(trusted_sample(trusted, limit).withColumn("good", F.lit(1)))
    v = edit_columns(edits)
    # 128 bits, from two seeds.
    digest = {"h1": F.xxhash64("diff"), "h2": F.xxhash64(F.lit(1), "diff")}
    by_id = v.select("rev_id", *[h.alias(n) for n, h in digest.items()]).groupBy("h1", "h2", "rev_id").agg(F.count(F.lit(1)).alias("k"))
    by_id = by_id.join(mark, "rev_id", "left")
    first = F.min(F.struct(F.col("good").isNull().alias("other"), "rev_id", "k")).alias("first")
    good_rows = F.coalesce(F.sum(F.when(F.col("good").isNotNull(), F.col("k"))), F.lit(0))
    copied = by_id.groupBy("h1", "h2").agg(first, F.sum("k").alias("n"), good_rows.alias("good")).where("n > 1")
    # How often a text with copies shall count, less how often its rows do.
    weight = F.when(F.col("first.other"), F.lit(1).cast("bigint")).otherwise(F.col("first.k"))
    trusted_weight = F.when(F.col("first.other"), F.lit(0).cast("bigint")).otherwise(F.col("first.k"))
    copied = copied.select("h1", "h2", F.col("first.rev_id").alias("one"), (weight - F.col("n")).alias("raw"), (trusted_weight - F.col("good")).alias("target"))
    copied = stored(copied, "copied-texts")
    # Every row counts once where its text lies; then one row of each text with copies is looked up and puts that right.
    rows = v.join(mark, "rev_id", "left").select("diff", F.lit(1).cast("bigint").alias("raw"), F.when(F.col("good").isNotNull(), 1).otherwise(0).cast("bigint").alias("target"))
    likely = v.withColumns(digest).where(_in_filter(F.xxhash64("h1", "h2", "rev_id"), _filter_of(copied)))
    ones = likely.join(copied, ["h1", "h2"]).where("rev_id <=> one").dropDuplicates(["h1", "h2"]).select("diff", "raw", "target")
    grams = rows.unionByName(ones).select("raw", "target", F.explode(ngram_buckets(F.col("diff"), buckets)).alias("bucket"))
    counts = stored(grams.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")), "gram-counts")
    total = counts.agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).select(F.struct("raw", "target")).scalar()

    p_raw = (F.col("raw") + smoothing) / (total["raw"] + smoothing * buckets)
    if prior:
        mass = F.least(F.lit(float(prior)), PRIOR_SHARE * total["raw"])
        p_target = (F.col("target") + mass * p_raw) / (total["target"] + mass)
    else:
        p_target = (F.col("target") + smoothing) / (total["target"] + smoothing * buckets)
    return counts.select("bucket", (F.log(p_target) - F.log(p_raw)).alias("ratio"))


def judged(
    edits: DataFrame, trusted: DataFrame, *, into: str = "quality", buckets: int = BUCKETS, threshold: float = THRESHOLD, prior: float = 0.0
) -> DataFrame:
    """``edits`` with a struct column of counts, score and verdict; no edit is dropped here.

    ``edits`` needs ``rev_id`` and ``diff``; all its columns stay, but one called ``into``
    is replaced. The struct holds n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, score and kept. A NULL or empty text has no words and
    fails the base rules; its score is 0. Without any trusted edit a ``prior`` keeps every text that passes
    the base rules; without a prior the target is uniform then, and frequent words weigh against a text. Repeated rows are judged alike. No rows in, none out.
    """
    table = ratio_table(edits, trusted, buckets, prior=prior)
    ratios = table.agg(F.map_from_entries(F.collect_list(F.struct("bucket", "ratio"))).alias("m"))
    # One array of ``buckets`` doubles, whatever the corpus.
    dense = ratios.select(
        F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0.0))).alias("a")
    ).scalar()
    scored = edits.withColumn("__ratios", dense)
    text = F.coalesce(F.col("diff").cast("string"), F.lit(""))
    grams = ngram_buckets(text, buckets)
    mean = _let(
        grams,
        lambda g: F.when(F.size(g) == 0, F.lit(0.0)).otherwise(
            F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get("__ratios", b)) / F.size(g)
        ),
    )
    verdict = _let(
        F.struct(base_counts(text).alias("b"), mean.alias("score")),
        lambda q: _let(
            (q["b"]["n_words"] < MIN_WORDS) | (100 * q["b"]["n_repeat_words"] > REPEAT_PERCENT * q["b"]["n_words"]),
            lambda failed: F.struct(
                *[q["b"][n].alias(n) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
                failed.alias("base_failed"),
                q["score"].alias("score"),
                (~failed & (q["score"] >= threshold)).alias("kept"),
            ),
        ),
    )
    kept = [c for c in edits.columns if c.lower() != into.lower()]
    # A generator: a later filter on the verdict must not evaluate it a second time.
    once = scored.select(*[F.col(f"`{c}`") for c in kept], verdict.alias("__verdict"))
    return once.select(*[F.col(f"`{c}`") for c in kept], F.explode(F.array("__verdict")).alias(into))
