"""Phrase collocations by Rabin-Karp fingerprints.

A task turns its texts into byte buffers and hashes every n-gram from prefix
polynomials: a word's fingerprint is a difference of prefix sums over bytes, an
n-gram's one over word fingerprints. What is shuffled is a fingerprint, a count
and a pointer to a text that holds the n-gram. The texts of the phrases that are
frequent are then read at their pointers, checked there and cut out.

A phrase can only be frequent if all its shorter parts are. So words are counted
first, then the pairs of frequent words, then the triples of frequent pairs; a
bitmap of ``FILTER_BITS`` tells a task which fingerprints may be frequent. A bit
that is set by another fingerprint lets an n-gram through to the exact count, so
the bitmap never loses one, however full it is.

An n-gram is known by two fingerprints, one modulo 2**64 and one modulo a prime:
phrases that collide in one of them stay apart by the other.
"""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from tabia.llm.common import table, whole, written

# fixed values of the contract
MOST_WORDS = 3
LEAST = 10
SCALE = 1_000_000
INSIDE_PERCENT = 50
TOP = 2000
UNKNOWN = "und"

#: Bytes of text that are hashed at once; n-grams that a task reduces at once.
BLOCK = 1 << 19
FLUSH = 2 << 20
#: Size of the bitmap of what may be frequent: 8 MB.
FILTER_BITS = 26
#: Ranked rows are first cut to TOP in so many parts of a language.
PARTS = 64

PRIME = (1 << 31) - 1
# bases of the polynomials over bytes and over words, modulo 2**64 and modulo PRIME
BYTE_BASES = (0x9E3779B97F4A7C15, 1_103_515_245)
WORD_BASES = (0xC2B2AE3D27D4EB4F, 742_938_285)

_BREAK = np.zeros(256, bool)
_BREAK[list(b".,;:!?\x0a\x0b\x0c\x0d")] = True
_WORD = ~_BREAK
_WORD[list(b"\x20\x09")] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD_RUN = re.compile(rb"[^\x20\x09.,;:!?\x0a-\x0d]+")
_NO_WORD = re.compile(rb"[\x20\x09.,;:!?\x0a-\x0d]")


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: What a byte stands for in a polynomial.
_VALUE = mixed_bits(np.arange(1, 257, dtype=np.uint64))


class Polynomial:
    """Hashes of runs: the difference of two prefix sums of value * base**position, moved to position 0."""

    def __init__(self, base: int, prime: int | None):
        self.prime = None if prime is None else np.uint64(prime)
        self.modulus = prime or 1 << 64
        self.bases = base, pow(base, -1, self.modulus)
        self.powers = np.ones((2, 1), np.uint64)

    def _reduced(self, x):
        return x if self.prime is None else x % self.prime

    def prefixes(self, values: np.ndarray) -> np.ndarray:
        while self.powers.shape[1] <= len(values):
            step = np.array([[pow(b, self.powers.shape[1], self.modulus)] for b in self.bases], np.uint64)
            self.powers = np.concatenate([self.powers, self._reduced(self.powers * step)], axis=1)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(self._reduced(self._reduced(values) * self.powers[0, : len(values)]), out=sums[1:])
        return sums

    def runs(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return self._reduced(self._reduced(sums[end] - sums[start]) * self.powers[1, start])


class Hasher:
    """Both fingerprints of words and n-grams. ``bits`` narrows the first one, for tests of collisions."""

    def __init__(self, bits: int = 64):
        self.shift = np.uint64(64 - bits)
        self.over_bytes = [Polynomial(b, p) for b, p in zip(BYTE_BASES, (None, PRIME))]
        self.over_words = [Polynomial(b, p) for b, p in zip(WORD_BASES, (None, PRIME))]

    def words(self, buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """Prefix sums over the fingerprints of the words, one array for each polynomial."""
        length = (end - start).astype(np.uint64)
        values = _VALUE[buffer]
        return [
            g.prefixes(mixed_bits(b.runs(b.prefixes(values), start, end) + (length << np.uint64(32))))
            for b, g in zip(self.over_bytes, self.over_words)
        ]

    def grams(self, sums, at: np.ndarray, n: int, lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint, check) of the n words from ``at`` on; ``lang`` is a number for each."""
        salt = lang + np.uint64(n)
        h, p = (g.runs(s, at, at + n) for g, s in zip(self.over_words, sums))
        h = mixed_bits(h ^ mixed_bits(salt)) >> self.shift
        p = mixed_bits(p ^ mixed_bits(salt + np.uint64(77))) % np.uint64(PRIME)
        return h.view(np.int64), p.astype(np.int32)


def lang_number(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def signed(number: int) -> int:
    return number - (1 << 64) if number >> 63 else number


class Block:
    """Words of a run of a buffer: their places, their text's number, and how many words their piece has left."""

    def __init__(self, buffer: np.ndarray, starts: np.ndarray, low: int, cut: int, end: int):
        self.bytes = buffer[low:end]
        word = np.zeros(len(self.bytes) + 2, np.int8)
        word[1:-1] = _WORD[self.bytes]
        turn = np.diff(word)
        self.start, self.end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        self.own = int(np.searchsorted(self.start, cut - low))  # later words are there as followers only
        self.doc = np.searchsorted(starts, self.start + low, side="right") - 1
        piece = np.searchsorted(np.flatnonzero(_BREAK[self.bytes]), self.start)
        n = len(self.start)
        last = np.flatnonzero(np.diff(piece, append=-1))
        place = np.arange(n)
        self.left = last[np.searchsorted(last, place)] - place + 1 if n else place

    def at(self, n: int) -> np.ndarray:
        """Words that start an n-gram."""
        return np.flatnonzero(self.left[: self.own] >= n)

    def phrase(self, at: int, n: int) -> str:
        return b" ".join(self.bytes[s:e].tobytes() for s, e in zip(self.start[at : at + n], self.end[at : at + n])).decode()


def buffer_of(texts) -> tuple[np.ndarray, np.ndarray]:
    """(lower-case bytes of the texts, each followed by a line feed; where each text starts)."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]] if raw is not None else np.zeros(0, np.uint8)
    place = ends - ends[0]
    out = np.insert(_LOWER[data], place[1:], 10)
    return out, place[:-1] + np.arange(len(texts))


def blocks(buffer: np.ndarray, starts: np.ndarray, limit: int = BLOCK, most: int = MOST_WORDS):
    """The buffer cut between words into runs of about ``limit`` bytes, each with the words that follow."""
    low = 0
    while low < len(buffer):
        found = _NO_WORD.search(buffer, low + limit)
        cut = end = found.start() if found else len(buffer)
        for _ in range(most - 1):
            word = _WORD_RUN.search(buffer, end)
            end = word.end() if word else end
        yield Block(buffer, starts, low, cut, min(end + 1, len(buffer)))
        low = cut


def byte_slices(batch, column: str = "text", limit: int = BLOCK):
    """An Arrow batch in runs of rows of about ``limit`` bytes, one row at least."""
    sizes = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    low, total = 0, 0
    for k, size in enumerate(sizes):
        total += int(size)
        if total >= limit or k == len(sizes) - 1:
            yield batch.slice(low, k + 1 - low)
            low, total = k + 1, 0


GRAMS = "fp long, check int, a long, pointer int"
WORDS_OF_LANG = -1  # in ``check``: the row counts the words of a language, whose number is ``fp``


def passing(bitmap: np.ndarray, fp: np.ndarray) -> np.ndarray:
    place = fp.view(np.uint64) & np.uint64((len(bitmap) << 6) - 1)
    return (bitmap[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def reduced(pending):
    """Arrow rows, one for each distinct (fp, check) of the collected n-grams, in batches."""
    fp, check, pointer = (np.concatenate(x) for x in zip(*pending))
    order = np.argsort(fp)
    fp, check, pointer = fp[order], check[order], pointer[order]
    new = np.ones(len(fp), bool)
    new[1:] = (fp[1:] != fp[:-1]) | (check[1:] != check[:-1])
    first = np.flatnonzero(new)
    a, to = np.diff(first, append=len(fp)), np.minimum.reduceat(pointer, first)
    for low in range(0, len(first), 1 << 17):
        cut = slice(low, low + (1 << 17))
        yield pa.RecordBatch.from_arrays(
            [pa.array(fp[first[cut]]), pa.array(check[first[cut]]), pa.array(a[cut].astype(np.int64)), pa.array(to[cut])],
            names=["fp", "check", "a", "pointer"],
        )


def counter(n: int, bits: int, bitmap=None, block: int = BLOCK):
    """Counts the n-grams of a task's texts; of two words or more only those whose parts pass ``bitmap``."""

    def run(batches):
        hasher, pending, held, totals = Hasher(bits), [], 0, {}
        known = bitmap.value if bitmap is not None else None
        for batch in batches:
            for part in byte_slices(batch):
                names = part.column("lang").to_pylist()
                numbers = np.array([lang_number(x) for x in names], np.uint64)
                pointers = part.column("pointer").to_numpy(zero_copy_only=False)
                buffer, starts = buffer_of(part.column("text"))
                for words in blocks(buffer, starts, block):
                    at = words.at(n)
                    if not len(at):
                        continue
                    sums = hasher.words(words.bytes, words.start, words.end)
                    lang = numbers[words.doc]
                    if known is not None:
                        begin = np.flatnonzero(words.left >= n - 1)
                        may = np.zeros(len(words.left) + 1, bool)
                        may[begin] = passing(known, hasher.grams(sums, begin, n - 1, lang[begin])[0])
                        at = at[may[at] & may[at + 1]]
                    if n == 1:
                        for number, count in zip(*np.unique(lang[at], return_counts=True)):
                            totals[int(number)] = totals.get(int(number), 0) + int(count)
                    pending.append((*hasher.grams(sums, at, n, lang[at]), pointers[words.doc[at]]))
                    held += len(at)
                    if held >= FLUSH:
                        yield from reduced(pending)
                        pending, held = [], 0
        if held:
            yield from reduced(pending)
        if totals:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([signed(x) for x in totals], pa.int64()),
                    pa.array([WORDS_OF_LANG] * len(totals), pa.int32()),
                    pa.array(list(totals.values()), pa.int64()),
                    pa.array([0] * len(totals), pa.int32()),
                ],
                names=["fp", "check", "a", "pointer"],
            )

    return run


def frequent(texts: DataFrame, n: int, least: int, bits: int, bitmap=None) -> DataFrame:
    """Stored rows (fp, check, a, pointer) of the n-grams found ``least`` times; for words the languages' sums too.

    The tasks have reduced their n-grams already, so they are dealt as they come
    and summed after the shuffle only.
    """
    rows = texts.mapInArrow(counter(n, bits, bitmap), GRAMS).repartition("fp", "check")
    counts = rows.groupBy("fp", "check").agg(F.sum("a").alias("a"), F.min("pointer").alias("pointer"))
    return written(counts.where((F.col("a") >= least) | (F.col("check") == WORDS_OF_LANG)))


def bitmap_of(counts: DataFrame, bits: int = FILTER_BITS):
    """A broadcast bitmap of the fingerprints' low bits: 2**bits bits, whatever the corpus."""
    place = counts.where(F.col("check") != WORDS_OF_LANG).select(
        F.col("fp").bitwiseAND((1 << bits) - 1).alias("place")
    )
    cells = place.groupBy(F.shiftright("place", 6).alias("cell")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("mask")
    )
    found = cells.toArrow()
    bitmap = np.zeros(1 << (bits - 6), np.uint64)
    bitmap[found.column("cell").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return counts.sparkSession.sparkContext.broadcast(bitmap)


PHRASES = (
    "lang string, lang_fp long, n int, phrase string, a long, fp long, check int,"
    " cuts array<struct<k:int,lfp:long,lcheck:int,rfp:long,rcheck:int>>"
)
_CUT = pa.struct([("k", pa.int32()), ("lfp", pa.int64()), ("lcheck", pa.int32()), ("rfp", pa.int64()), ("rcheck", pa.int32())])
_CUT_NAMES = [f.name for f in _CUT]
_FOUND = pa.schema(
    [("lang", pa.string()), ("lang_fp", pa.int64()), ("n", pa.int32()), ("phrase", pa.string()), ("a", pa.int64()),
     ("fp", pa.int64()), ("check", pa.int32()), ("cuts", pa.list_(_CUT))]
)


class Wanted:
    """The wanted fingerprints of a batch of rows, found by search in sorted arrays."""

    def __init__(self, column, n: int):
        flat = column.flatten()
        pick = pc.equal(flat.field("n"), n)
        rows = pa.table(
            [*(flat.field(c).filter(pick) for c in ("fp", "check", "a")), pc.list_parent_indices(column).filter(pick)],
            names=["fp", "check", "a", "row"],
        ).sort_by("fp")
        self.fp, self.check, self.a, self.row = (rows.column(c).to_numpy() for c in rows.column_names)
        alike = np.unique(self.fp, return_counts=True)[1]
        self.most = int(alike.max()) if len(alike) else 0

    def hits(self, fp, check, row):
        """(position among the given n-grams, index of the wanted one) wherever all three agree."""
        low = np.searchsorted(self.fp, fp)
        for step in range(self.most):
            k = np.minimum(low + step, len(self.fp) - 1)
            same = (low + step < len(self.fp)) & (self.fp[k] == fp) & (self.check[k] == check) & (self.row[k] == row)
            yield from zip(np.flatnonzero(same).tolist(), k[same].tolist())


def reader(bits: int):
    """Rows (texts: [(lang, text)], wanted: [(n, fp, check, a)]) to the wanted phrases, read from the texts.

    Every occurrence of a wanted fingerprint in its texts is compared with the
    first; unlike ones would be two phrases with both fingerprints equal, which
    ends the job instead of giving a wrong count.
    """

    def found_in(hasher, texts, rows, wanted, known):
        langs = texts.column("lang").to_pylist()
        numbers = np.array([lang_number(x) for x in langs], np.uint64)
        buffer, starts = buffer_of(texts.column("text"))
        for words in blocks(buffer, starts):
            sums = hasher.words(words.bytes, words.start, words.end)
            for n, asked in wanted.items():
                at = words.at(n)
                if not len(at) or not asked.most:
                    continue
                h, p = hasher.grams(sums, at, n, numbers[words.doc[at]])
                fresh = []
                for k, i in asked.hits(h, p, rows[words.doc[at]]):
                    phrase = words.phrase(at[k], n)
                    first = known.setdefault((n, i), phrase)
                    if first is phrase:
                        fresh.append((at[k], i, phrase))
                    elif first != phrase:
                        raise ValueError(f"both fingerprints of {phrase!r} and {first!r} are equal")
                places = np.array([x[0] for x in fresh], np.int64)
                lang = numbers[words.doc[places]]
                parts = [
                    [x.tolist() for x in (*hasher.grams(sums, places, k, lang), *hasher.grams(sums, places + k, n - k, lang))]
                    for k in range(1, n)
                ]
                for j, (at_word, i, phrase) in enumerate(fresh):
                    cuts = [dict(zip(_CUT_NAMES, (k, *(x[j] for x in part)))) for k, part in enumerate(parts, 1)]
                    doc = words.doc[at_word]
                    yield (
                        langs[doc], signed(int(numbers[doc])), n, phrase,
                        int(asked.a[i]), int(asked.fp[i]), int(asked.check[i]), cuts,
                    )

    def run(batches):
        hasher = Hasher(bits)
        for batch in batches:
            wanted = {n: Wanted(batch.column("wanted"), n) for n in range(2, MOST_WORDS + 1)}
            texts = batch.column("texts")
            flat = pa.RecordBatch.from_struct_array(texts.flatten())
            rows, known, done = pc.list_parent_indices(texts).to_numpy(zero_copy_only=False), {}, 0
            for part in byte_slices(flat):
                found = list(found_in(hasher, part, rows[done : done + part.num_rows], wanted, known))
                done += part.num_rows
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(col, f.type) for col, f in zip(zip(*found), _FOUND)], schema=_FOUND
                    )

    return run


def phrases(texts: DataFrame, counts: list[DataFrame], bits: int) -> DataFrame:
    """The counted n-grams with their words, each read from the text that its pointer names.

    A pointer is 32 bits of a text's hash, so it may name several texts; those
    that lack a wanted fingerprint give nothing. Copies of a text are one text
    here, and a phrase found in two texts of one pointer is one row. A text's
    list of wanted phrases is never longer than the text.
    """
    wanted = None
    for n, frame in enumerate(counts, 2):
        rows = frame.select(F.lit(n).alias("n"), "fp", "check", "a", "pointer")
        wanted = rows if wanted is None else wanted.unionByName(rows)
    lists = written(
        wanted.groupBy("pointer").agg(F.collect_list(F.struct("n", "fp", "check", "a")).alias("wanted"))
    )
    named = texts.join(lists.select("pointer"), "pointer", "left_semi")
    held = named.groupBy("pointer").agg(F.collect_set(F.struct("lang", "text")).alias("texts"))
    return held.join(lists, "pointer").select("texts", "wanted").mapInArrow(reader(bits), PHRASES).dropDuplicates(
        ["n", "fp", "check", "phrase"]
    )


def scored(found: DataFrame, words: DataFrame, pairs: DataFrame) -> DataFrame:
    """(lang, lang_fp, n, phrase, a, l, r, score) of the phrases that no longer one takes up."""
    parts = words.where(F.col("check") != WORDS_OF_LANG).select("fp", "check", "a").unionByName(
        pairs.select("fp", "check", "a")
    )
    cut = found.select("n", "fp", "check", "a", F.explode("cuts").alias("cut")).select("n", "fp", "check", "a", "cut.*")
    left = parts.select(F.col("fp").alias("lfp"), F.col("check").alias("lcheck"), F.col("a").alias("l"))
    right = parts.select(F.col("fp").alias("rfp"), F.col("check").alias("rcheck"), F.col("a").alias("r"))
    whole_number = "cast({} as decimal(15,0))".format
    score = F.expr(
        f"({whole_number('a')} * {whole_number('a')} * cast({SCALE} as decimal(7,0))) div ({whole_number('l')} * {whole_number('r')})"
    )
    best = (
        cut.join(left, ["lfp", "lcheck"])
        .join(right, ["rfp", "rcheck"])
        .groupBy("n", "fp", "check")
        .agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("best"))
    )
    inside = (
        found.where(f"n = {MOST_WORDS}")
        .select("a", F.explode("cuts").alias("cut"))
        .select(
            "a",
            F.when(F.col("cut.k") == 2, F.struct(F.col("cut.lfp").alias("fp"), F.col("cut.lcheck").alias("check")))
            .otherwise(F.struct(F.col("cut.rfp").alias("fp"), F.col("cut.rcheck").alias("check")))
            .alias("pair"),
        )
        .groupBy(F.lit(2).alias("n"), F.col("pair.fp").alias("fp"), F.col("pair.check").alias("check"))
        .agg(F.max("a").alias("longer"))
    )
    keys = ["n", "fp", "check"]
    return (
        found.drop("cuts")
        .join(best, keys)
        .join(inside, keys, "left")
        .where(F.col("longer").isNull() | (100 * F.col("longer") < INSIDE_PERCENT * F.col("a")))
        .select("lang", "lang_fp", "n", "phrase", "a", "best.l", "best.r", "best.score")
    )


def ranked(rows: DataFrame, top: int = TOP, parts: int = PARTS) -> DataFrame:
    """The first ``top`` of each language with their ``rank``; a language is cut down in ``parts`` parts first."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
    first = (
        rows.withColumn("part", part)
        .withColumn("place", F.row_number().over(Window.partitionBy("lang_fp", "part").orderBy(*order)))
        .where(F.col("place") <= top)
        .drop("part", "place")
    )
    rank = F.row_number().over(Window.partitionBy("lang_fp").orderBy(*order))
    return first.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, bits: int = 64) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of two or three words.

    A null or empty text has no words; rows without lang belong to ``und``.
    Repeated rows count as often as they come. Languages without a frequent
    phrase have no row, an empty table gives an empty result. A text of any
    length is hashed in blocks that overlap by two words. Other columns are
    ignored. Counts are exact to 15 digits.
    """
    text, lang = whole("text"), F.coalesce(F.col("lang"), F.lit(UNKNOWN))
    pointer = F.xxhash64(lang, text).bitwiseAND(0xFFFFFFFF) - (1 << 31)
    texts = docs.select(lang.alias("lang"), pointer.cast("int").alias("pointer"), text.alias("text"))
    counts = [frequent(texts, 1, least, bits)]
    for n in range(2, MOST_WORDS + 1):
        counts.append(frequent(texts, n, least, bits, bitmap_of(counts[-1])))
    found = written(phrases(texts, counts[1:], bits))
    totals = counts[0].where(F.col("check") == WORDS_OF_LANG).select(
        F.col("fp").alias("lang_fp"), F.col("a").alias("total")
    )
    rows = ranked(scored(found, counts[0], counts[1]), top)
    return rows.join(totals, "lang_fp").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op13_phrase_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


ORACLE_OP13 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), split AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), grams AS (
  SELECT lang, 1 AS len, unnest(w) AS phrase FROM split
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM split
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM split
), f AS (
  SELECT lang, len, phrase, count(*) AS a FROM grams GROUP BY ALL
), candidates AS (
  SELECT lang, len, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE len >= 2 AND a >= 10
), cuts AS (
  SELECT *, unnest(range(1, len)) AS k FROM candidates
), scores AS (
  SELECT c.lang, c.len, c.phrase, c.a, c.k, x.a AS l, y.a AS r,
         (1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a) AS score
  FROM cuts c
  JOIN f x ON x.lang = c.lang AND x.len = c.k AND x.phrase = array_to_string(c.w[:c.k], ' ')
  JOIN f y ON y.lang = c.lang AND y.len = c.len - c.k AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')
), best AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, len, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, w[1] || ' ' || w[2] AS phrase, a FROM candidates WHERE len = 3
    UNION ALL SELECT lang, w[2] || ' ' || w[3], a FROM candidates WHERE len = 3) GROUP BY ALL
), kept AS (
  SELECT b.* FROM best b LEFT JOIN longer g ON b.len = 2 AND g.lang = b.lang AND g.phrase = b.phrase
  WHERE g.a IS NULL OR 100 * g.a < 50 * b.a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
), totals AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE len = 1 GROUP BY lang)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score::BIGINT AS score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""
