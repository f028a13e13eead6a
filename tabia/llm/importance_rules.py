"""Quality rules: plain counts of a text and a hashed n-gram importance ratio.

Two multinomials over hashed word uni- and bigrams are estimated: one from
trusted documents, one from the whole raw corpus. A document's verdict is the
mean log ratio of its n-grams against a fixed threshold; every document gets
one. Only DataFrame functions are used.
"""

import math

from pyspark.sql import Column, DataFrame, functions as F

from tabia.llm.common import SPACE, boxed, table, unboxed, whole, words

BINS = 1 << 13
SMOOTHING = 1.0
#: Trusted rows at most, taken in the order of a hash of doc_id; the raw side counts every document.
TRUSTED_ROWS = 20_000
#: Mean log ratio (nats an n-gram) below which a document goes: its n-grams are e**0.25 times likelier in the raw corpus.
THRESHOLD = -0.25
MIN_WORDS = 50
REPEATED_PERCENT = 50
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"
SYMBOLS = "#*$%&|<>"


def n_grams(text: Column) -> Column:
    """Tokens are runs of letters and digits or runs of other signs; case is kept."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def followers(tokens: str) -> Column:
    """The tokens from the second on."""
    return F.slice(F.col(tokens), 2, F.greatest(F.size(tokens) - 1, F.lit(0)))


def in_bin(bins: int, *tokens) -> Column:
    return F.pmod(F.xxhash64(*tokens), F.lit(bins)).cast("int")


def binned(tokens: str, bins: int = BINS) -> Column:
    """Bins of all unigrams, then of all bigrams, of the token column."""
    pairs = F.slice(
        F.zip_with(F.col(tokens), followers(tokens), lambda a, b: in_bin(bins, a, b)),
        1,
        F.greatest(F.size(tokens) - 1, F.lit(0)),
    )
    return F.concat(F.transform(F.col(tokens), lambda t: in_bin(bins, t)), pairs)


def trusted_ids(labels: DataFrame, rows: int = TRUSTED_ROWS) -> DataFrame:
    return (
        labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").alias("trusted_id"))
        .distinct()
        .orderBy(F.xxhash64("trusted_id"), "trusted_id")
        .limit(rows)
    )


def fit_ratio(docs: DataFrame, labels: DataFrame, bins: int = BINS) -> list[float]:
    """log p_trusted - log p_raw of every bin; all zero where no trusted row exists.

    Counts are combined before the shuffle and there are ``bins`` of them, which
    is all that reaches the driver. The trusted ids are broadcast; their number
    is bounded by TRUSTED_ROWS. Tokens become rows before they are hashed, which
    keeps the hashing in generated code; the bins are those of ``binned``.
    """
    known = F.broadcast(trusted_ids(labels))
    grams = (
        docs.select(F.col("doc_id"), n_grams(whole("text")).alias("tokens"))
        .join(known, F.col("doc_id") == F.col("trusted_id"), "left")
        .select(
            F.col("trusted_id").isNotNull().cast("long").alias("trusted"),
            F.explode(F.arrays_zip(F.col("tokens").alias("token"), followers("tokens").alias("after"))).alias("g"),
        )
        .select("trusted", in_bin(bins, "g.token").alias("one"), F.when(F.col("g.after").isNotNull(), in_bin(bins, "g.token", "g.after")).alias("two"))
        .select("trusted", F.explode(F.array("one", "two")).alias("bin"))
        .where(F.col("bin").isNotNull())
    )
    counts = grams.groupBy("bin").agg(F.count(F.lit(1)).alias("raw"), F.sum("trusted").alias("good"))
    raw, good = [0] * bins, [0] * bins
    for row in counts.collect():
        raw[row["bin"]], good[row["bin"]] = row["raw"], row["good"]
    if not sum(good):
        return [0.0] * bins

    def logs(counts):
        total = math.log(sum(counts) + SMOOTHING * bins)
        return [math.log(c + SMOOTHING) - total for c in counts]

    return [g - r for g, r in zip(logs(good), logs(raw))]


def mean_ratio(grams: str, ratio: list[float]) -> Column:
    """The mean of the ratios of a text's n-grams, 0 for a text without any."""
    values = F.split(F.lit(",".join(map(repr, ratio))), ",").cast("array<double>")
    total = F.aggregate(F.col(grams), F.lit(0.0), lambda s, b: s + F.get(values, b))
    n = F.size(grams)
    return F.when(n > 0, total / n).otherwise(F.lit(0.0))


def repeated_words(ordered: str) -> Column:
    """Words inside windows that occur twice or more, from sorted (hash, position)."""
    col = F.col(ordered)
    hits = F.filter(
        col,
        lambda x, k: F.coalesce(F.get(col, k - 1)["h"] == x["h"], F.lit(False))
        | F.coalesce(F.get(col, k + 1)["h"] == x["h"], F.lit(False)),
    )
    covered = F.flatten(F.transform(hits, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    return F.when(F.size(col) > 0, F.size(F.array_distinct(covered))).otherwise(0).cast("long")


def ordered_windows(windows: str) -> Column:
    """Sorted (hash, position), or nothing where all windows differ, as in most texts."""
    h = F.col(windows)
    pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(pairs)).otherwise(
        F.expr("cast(array() as array<struct<h: bigint, i: int>>)")
    )


def judged(docs: DataFrame, ratio: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """Columns ``row`` (the input), the counts, ``mean_ratio``, ``base_failed`` and ``kept``.

    A null text counts as empty and fails by its number of words. Repeated rows
    and equal scores get equal verdicts. Input columns stay inside ``row``.
    """
    text = whole("row.text")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, SPACE, "") != "")
    step = boxed(docs).select(
        "row",
        words(text).alias("w"),
        n_grams(text).alias("tokens"),
        F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    w = F.col("w")
    windows = F.when(
        F.size(w) >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
        ),
    ).otherwise(F.expr("cast(array() as array<bigint>)"))
    step = step.select(
        "row",
        F.size(w).cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"),
        binned("tokens", len(ratio)).alias("grams"),
    )
    step = step.withColumn("ordered", ordered_windows("windows"))
    step = step.select(
        "row",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        repeated_words("ordered").alias("n_repeat_words"),
        mean_ratio("grams", ratio).alias("mean_ratio"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words")
    )
    kept = ~F.col("base_failed") & (F.col("mean_ratio") >= threshold)
    # the id keeps a later filter above the counts: pushed below, it would evaluate their arrays for every element
    return step.withColumn("base_failed", failed).withColumn(
        "kept", F.when(F.monotonically_increasing_id() >= 0, kept)
    )


def quality_filtered(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that pass, with their own columns."""
    rows = judged(docs, fit_ratio(docs, labels), threshold)
    return unboxed(rows.where("kept"), docs.columns)


def op9_importance_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = judged(docs, fit_ratio(docs, table(spark, sf_dir, "labels")))
    return rows.select("row.doc_id", *(c for c in rows.columns if c not in ("row", "mean_ratio")), "mean_ratio")
