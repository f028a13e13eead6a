"""Mixing sources to target weights by repetition rates.

The sizes of a source are summed, its target over its size is its rate, and a
document comes floor(rate) times plus once more with a probability of the
fraction, drawn by a hash of the document and a seed.

One draw leaves a source beside its target by the chance of its larger
documents. Each source therefore takes, of ``SEEDS`` candidate seeds, the one
whose draw ends nearest to its target; the draws of all candidates are summed
in one pass. The seed is fixed by the data, so reruns agree.
"""

from pyspark.sql import Column, DataFrame, functions as F

from tabia.llm.common import GAP, table, unboxed, whole, written
from tabia.llm.ordinals import numbered, salted

# fixed values of the contract
WEIGHTS = (1, 2, 3)
MOST = 3

SEEDS = 64
#: Draws are (key * a + b) mod PRIME, with a and b of a seed from powers of PRIME's generator.
PRIME = (1 << 31) - 1
GENERATOR = 48_271


def word_count(text) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``: gaps of the trimmed text plus one."""
    inner = F.btrim(whole(text), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, GAP, -1))).cast("long")


def source_key(name: str = "source") -> Column:
    """Texts by code point, null after all of them: a longer first byte than any UTF-8 text has."""
    return F.coalesce(
        F.concat(F.lit("="), F.col(name).cast("string")).cast("binary"), F.lit(b"\xff")
    )


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """``sizes`` (key, source_size) with ``target``.

    The sources in the order of their keys weigh ``weights``, repeating, and
    share the sum of all sizes; a target stops at ``most`` times its source's
    size and what is left is shared anew by weight, until none is above. Each
    round is one sum over the sources, and at least one more source stops in it.
    """
    ranked = written(
        numbered(salted(sizes.withColumn("grp", F.lit(0))), "grp", ["key", "salt"]).select(
            "key",
            "source_size",
            F.element_at(
                F.array(*[F.lit(w) for w in weights]), (F.col("idx") % len(weights) + 1).cast("int")
            ).alias("weight"),
        )
    )
    full = F.col("source_size") * most
    level, stopped = None, 0
    while True:
        free = F.lit(True) if level is None else F.col("weight") * F.lit(level) <= full
        open_weight, held, total, n = ranked.agg(
            F.coalesce(F.sum(F.when(free, F.col("weight"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~free, full)), F.lit(0)),
            F.coalesce(F.sum("source_size"), F.lit(0)),
            F.count(F.when(~free, 1)),
        ).first()
        if level is not None and n == stopped:
            break
        stopped = n
        level = (total - held) / open_weight if open_weight else 0.0
    share = F.col("weight") * F.lit(float(level))
    return ranked.withColumn("target", F.when(share <= full, share).otherwise(full.cast("double")))


def seed_numbers(seeds: int) -> list[tuple[int, int]]:
    return [(pow(GENERATOR, 2 * s + 101, PRIME), pow(GENERATOR, 2 * s + 102, PRIME)) for s in range(seeds)]


def row_key(*columns: str) -> Column:
    """A number below PRIME from the MD5 of the columns."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]
    digest = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % PRIME


def draw(key: Column, a: Column, b: Column) -> Column:
    """A number of [0, 1) from a row's key and the two numbers of a seed."""
    return ((key * a + b) % PRIME) / F.lit(float(PRIME))


def mixing_plan(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seeds: int = SEEDS) -> DataFrame:
    """One row for each document: its columns ``row``, ``size``, ``source_size``, ``target``, ``rate``, ``copies``.

    A null or empty text has size 0; its copies follow the same rule. Rows
    without source are a source of their own, the last. A document's draw hangs
    on doc_id and text, so repeated rows share it. A source of size 0 has target
    and rate 0. An empty table gives an empty result. The columns of documents
    stay inside ``row``. A text is read twice, for its size and when its row is
    put out; the sums need a narrow table only.
    """
    measured = docs.select(
        F.struct("*").alias("row"),
        source_key().alias("key"),
        word_count("text").alias("size"),
        row_key("doc_id", "text").alias("row_key"),
    )
    narrow = written(measured.select("key", "size", "row_key"))
    sizes = narrow.groupBy("key").agg(F.sum("size").alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    aimed = written(
        targets(written(sizes), weights, most).select(
            "key",
            "source_size",
            "target",
            F.floor(rate).alias("least"),
            (rate - F.floor(rate)).alias("chance"),
        )
    )
    numbers = seed_numbers(seeds)

    def copied(a, b):
        return draw(F.col("row_key"), a, b) < F.col("chance")

    extra = [
        F.sum(F.when(copied(F.lit(a), F.lit(b)), F.col("size")).otherwise(0)).alias(f"extra{s}")
        for s, (a, b) in enumerate(numbers)
    ]
    drawn = narrow.join(aimed.select("key", "chance"), "key").groupBy("key").agg(*extra)
    short = F.col("target") - F.col("least") * F.col("source_size")
    offers = [
        F.struct(F.abs(F.col(f"extra{s}") - short).alias("off"), F.lit(s).alias("seed"),
                 F.lit(a).alias("a"), F.lit(b).alias("b"))
        for s, (a, b) in enumerate(numbers)
    ]
    best = F.array_min(F.array(*offers))
    plan = written(aimed.join(drawn, "key").select(*aimed.columns, best["a"].alias("a"), best["b"].alias("b")))
    more = F.when(copied(F.col("a"), F.col("b")), 1).otherwise(0)
    return measured.join(plan, "key").select(
        "row",
        "size",
        "source_size",
        "target",
        (F.col("least") + F.col("chance")).alias("rate"),
        (F.col("least") + more).cast("long").alias("copies"),
    )


def mixed(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seeds: int = SEEDS) -> DataFrame:
    """The mix itself: every document with its columns, as many times as it is taken."""
    plan = mixing_plan(docs, weights, most, seeds).where("copies > 0")
    rows = plan.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return unboxed(rows, docs.columns)


def op12_source_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing_plan(docs).select(
        "row.doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
    )


_SPLIT = r"regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+')"
ORACLE_OP12 = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, len(list_filter({_SPLIT}, lambda w: w <> '')) AS size,
         ('0x' || substr(md5(concat(coalesce(doc_id::VARCHAR, '-'), '|', coalesce(text, '-'))), 1, 15))::BIGINT
           % {PRIME} AS row_key
  FROM documents
), ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size, {MOST} * sum(size)::BIGINT AS full_size,
         {list(WEIGHTS)}[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT] AS weight
  FROM docs GROUP BY source
), levels(i, level, n) AS (
  SELECT 0, sum(source_size)::DOUBLE / sum(weight)::DOUBLE, 0::BIGINT FROM ranked
  UNION ALL
  SELECT i + 1, CASE WHEN open_weight > 0 THEN (total - held)::DOUBLE / open_weight::DOUBLE ELSE 0 END, n2 FROM (
    SELECT l.i, l.n, sum(r.source_size) AS total,
           coalesce(sum(r.weight) FILTER (WHERE r.weight * l.level <= r.full_size), 0) AS open_weight,
           coalesce(sum(r.full_size) FILTER (WHERE r.weight * l.level > r.full_size), 0) AS held,
           count(*) FILTER (WHERE r.weight * l.level > r.full_size) AS n2
    FROM levels l CROSS JOIN ranked r GROUP BY l.i, l.n, l.level) WHERE n2 > n
), aimed AS (
  SELECT source, source_size, CASE WHEN weight * level <= full_size THEN weight * level ELSE full_size::DOUBLE END AS target
  FROM ranked CROSS JOIN (SELECT level FROM levels ORDER BY i DESC LIMIT 1)
), rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM aimed
), seeds(seed, a, b) AS (
  VALUES {", ".join(f"({s}, {a}::BIGINT, {b}::BIGINT)" for s, (a, b) in enumerate(seed_numbers(SEEDS)))}
), drawn AS (
  SELECT r.source, s.seed, s.a, s.b,
         abs(sum(CASE WHEN ((d.row_key * s.a + s.b) % {PRIME})::DOUBLE / {PRIME} < r.rate - floor(r.rate) THEN d.size ELSE 0 END)
             - (any_value(r.target) - floor(any_value(r.rate)) * any_value(r.source_size))) AS off
  FROM docs d JOIN rated r ON r.source IS NOT DISTINCT FROM d.source CROSS JOIN seeds s GROUP BY ALL
), best AS (
  SELECT * FROM drawn QUALIFY row_number() OVER (PARTITION BY source ORDER BY off, seed) = 1
)
SELECT d.doc_id, d.size::BIGINT AS size, r.source_size, r.target,
       (d.size * (floor(r.rate)::BIGINT + CASE WHEN ((d.row_key * b.a + b.b) % {PRIME})::DOUBLE / {PRIME}
                                               < r.rate - floor(r.rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM docs d JOIN rated r ON r.source IS NOT DISTINCT FROM d.source JOIN best b ON b.source IS NOT DISTINCT FROM d.source
"""
