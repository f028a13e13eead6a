"""Benchmark decontamination by latent semantic retrieval.

The TF-IDF space has the benchmark's words as terms, weighted by their document
frequency in the whole corpus. A randomised SVD of all passages of the corpus and the
benchmark gives the latent space: one Spark job sums their products term by term, others
multiply these sums with a thin matrix. The cosine between an item and the windows of a
document, sized by the item, proposes candidates; these are verified by the longest
common subsequence of words and by a check of the item's answer part.
"""

import math
import re
from bisect import bisect_right
from collections import Counter
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabia.llm.common import stored, table, whole

WORD = re.compile(r"\w+")
WINDOW, STRIDE = 64, 16
#: Rank of the latent space at least; a block of more items gets a direction for each.
RANK, OVERSAMPLING, POWER = 96, 16, 2
#: The SVD is fitted on every passage of the corpus and of the benchmark. Those of the corpus count with equal weights
#: that add up to this many at most, as its common topics would otherwise take every direction from the items.
CORPUS_WEIGHT = 2000
#: Benchmark items that one search holds; a larger benchmark is searched in blocks.
ITEM_BLOCK = 500
#: Share of an item's words in common order that settles it, and that needs its answer part as well.
SURE, LIKELY, ANSWER = 0.7, 0.55, 0.8
ANSWER_SHARE = 0.25
#: Words of the smallest window's half, and words that are projected together at least (a power of two).
CHUNK, SEGMENT = 16, 1 << 14
#: Latent cosine from which a window is a candidate for an item; less where the window holds more than the item: as much
#: as a window with this share of the item's weight has. It is below LIKELY, as rare words weigh more than others and
#: the space may hold an item only in part.
COSINE, SHARE = 0.3, 0.2
#: Words that are searched together, one document at least.
RUN = 1 << 16
#: Products of two terms: that a task sums at once, that a row holds unless one term has more, made at once.
BAND, PART, PAIRS = 1 << 23, 1 << 15, 1 << 17
SEED = 11


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, with the rows of the table as bits of an integer."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | (1 << i)
    row = full = (1 << len(a)) - 1
    for y in b:
        hit = at.get(y)
        if hit:
            u = row & hit
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def answer_of(words: list[str]) -> list[str]:
    """The item's answer part: its last quarter, three words at least."""
    return words[-max(3, math.ceil(ANSWER_SHARE * len(words))) :]


def code_type(n_terms: int) -> np.dtype:
    """The integers that the codes of a block's terms are stored as; -1 is a word outside the benchmark."""
    return np.min_scalar_type(-n_terms)


def code_rows(batches, terms: dict):
    """The documents as the codes of their words."""
    kind, find = code_type(len(terms)), terms.get
    for batch in batches:
        codes = []
        for text in batch.column("text").to_pylist():
            found = tokens(text)
            codes.append(np.fromiter(map(find, found, repeat(-1)), kind, len(found)).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("key"), pa.array(codes, pa.binary())],
            names=["doc_id", "key", "codes"],
        )


def runs(batch, kind):
    """An Arrow batch in runs of about ``RUN`` words, one row at least: its rows, and the codes of each."""
    texts = [np.frombuffer(x, kind) for x in batch.column("codes").to_pylist()]
    low, size = 0, 0
    for k, words in enumerate(texts, 1):
        size += len(words)
        if size >= RUN or k == len(texts):
            yield batch.slice(low, k - low), texts[low:k]
            low, size = k, 0


def document_counts(batches, n_terms: int):
    """How many documents hold each term; one row for the number of documents (term -1), one for their passages (-2)."""
    counts, documents, passages = np.zeros(n_terms, np.int64), 0, 0
    for batch in batches:
        for rows, texts in runs(batch, code_type(n_terms)):
            sizes = np.array([len(x) for x in texts])
            documents += len(texts)
            passages += int((-(-sizes // WINDOW)).sum())
            words = np.concatenate(texts)
            held = np.sort((np.repeat(np.arange(len(texts)), sizes) * n_terms + words)[words >= 0])
            first = np.diff(held, prepend=-1) > 0
            counts += np.bincount(held[first] % n_terms, minlength=n_terms)
    terms = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.r_[terms, -1, -2], pa.int32()),
            pa.array(np.r_[counts[terms], documents, passages], pa.int64()),
        ],
        names=["term", "n"],
    )


def passages_of(words: list) -> list[list]:
    """Overlapping windows that cover all words of an item."""
    return [words[low : low + WINDOW] for low in range(0, max(1, len(words) - WINDOW + STRIDE), STRIDE)]


def windows_of(texts, kind) -> tuple[np.ndarray, np.ndarray]:
    """All words of the texts in rows of ``WINDOW``, a text's last row filled up with -1, and how many each row holds."""
    count = [-(-len(x) // WINDOW) for x in texts]
    words, held = np.full((sum(count), WINDOW), -1, kind), np.full(sum(count), WINDOW, np.int64)
    flat, low = words.reshape(-1), 0
    for text, n in zip(texts, count):
        flat[low * WINDOW : low * WINDOW + len(text)] = text
        low += n
        if n:
            held[low - 1] = len(text) - (n - 1) * WINDOW
    return words, held


def passage_rows(batches, weights: np.ndarray, scale: float):
    """One normalised TF-IDF row, times ``scale``, for every passage of the documents; its terms ascend."""
    kind, rarest = code_type(len(weights)), weights.max() ** 2
    for batch in batches:
        for _, texts in runs(batch, kind):
            words, held = windows_of(texts, kind)
            words.sort(axis=1)
            known = words >= 0
            first = known.copy()
            first[:, 1:] &= words[:, 1:] != words[:, :-1]
            at = np.flatnonzero(first)
            row, term = at // WINDOW, words.reshape(-1)[at]
            n = np.minimum(np.r_[at[1:], words.size], (row + 1) * WINDOW) - at
            own = n * weights[term]
            # words outside the benchmark count as the rarest
            norm = np.bincount(row, own**2, len(words)) + rarest * (held - known.sum(1))
            value = scale * own / np.sqrt(norm[row])
            ends = np.r_[0, np.cumsum(np.bincount(row, minlength=len(words)))].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(ends, pa.array(term, pa.int32())),
                    pa.ListArray.from_arrays(ends, pa.array(value, pa.float32())),
                ],
                names=["at", "value"],
            )


def cell(term):
    """Where a term's row begins in the lower triangle of A'A."""
    return term * (term + 1) // 2


def cuts(n_terms: int, size: int) -> list[tuple[int, int]]:
    """The terms in runs whose rows of the triangle have ``size`` cells at most, one term at least."""
    out, low = [], 0
    while low < n_terms:
        high = low + 1
        while high < n_terms and cell(high + 1) - cell(low) <= size:
            high += 1
        out.append((low, high))
        low = high
    return out


def gram_part(batches, low: int, high: int):
    """This task's part of the triangle of A'A, for the terms from ``low`` to before ``high``."""
    out = np.zeros(cell(high) - cell(low))
    for batch in batches:
        terms, values = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("at", "value"))
        lengths = batch.column("at").value_lengths().to_numpy(zero_copy_only=False)
        begins, terms = np.cumsum(lengths) - lengths, terms.astype(np.int64)
        for n in np.unique(lengths[lengths > 0]).tolist():
            r, c = np.tril_indices(n)
            of, step = begins[lengths == n], max(1, PAIRS // len(r))
            for k in range(0, len(of), step):
                place = of[k : k + step, None] + np.arange(n)
                t, v = terms[place], values[place].astype(np.float64)
                cells, products = (cell(t) - cell(low))[:, r] + t[:, c], v[:, r] * v[:, c]
                if 0 < low or t.max() >= high:
                    inside = ((t >= low) & (t < high))[:, r]
                    cells, products = cells[inside], products[inside]
                np.add.at(out, cells.ravel(), products.ravel())
    for first, last in cuts(high, PART):
        first = max(first, low)
        if first < last:
            part = out[cell(first) - cell(low) : cell(last) - cell(low)].astype("<f4")
            yield pa.RecordBatch.from_arrays(
                [pa.array([first], pa.int32()), pa.array([last], pa.int32()), pa.array([part.tobytes()], pa.binary())],
                names=["low", "high", "part"],
            )


def gram(passages: DataFrame, n_terms: int) -> DataFrame:
    """The lower triangle of A'A over all passages, in runs of terms.

    Tasks are as many as cores, as each sends what it summed; a task holds a band of terms at a time.
    """
    few = passages.coalesce(passages.sparkSession.sparkContext.defaultParallelism)
    schema = "low int, high int, part binary"
    bands = [
        few.mapInArrow(lambda batches, low=low, high=high: gram_part(batches, low, high), schema)
        for low, high in cuts(n_terms, BAND)
    ]
    parts = reduce(DataFrame.unionByName, bands).groupBy("low", "high")
    return stored(parts.applyInPandas(lambda frame: summed(frame, "<f4"), schema).coalesce(8))


def gram_products(batches, q: np.ndarray, chunk: int = 1024):
    """This task's part of A'A q, in chunks of terms, from rows of the lower triangle."""
    out = np.zeros_like(q)
    for batch in batches:
        for low, high, part in zip(*(batch.column(c).to_pylist() for c in ("low", "high", "part"))):
            rows = np.zeros((high - low, high))
            rows[np.tri(high - low, high, low, dtype=bool)] = np.frombuffer(part, "<f8")
            out[low:high] += rows @ q[:high]
            rows[np.arange(high - low), np.arange(low, high)] = 0  # the diagonal counts once
            out[:high] += rows.T @ q[low:high]
    for low in range(0, len(q), chunk):
        yield pa.RecordBatch.from_arrays(
            [pa.array([low], pa.int32()), pa.array([out[low : low + chunk].astype("<f8").tobytes()], pa.binary())],
            names=["low", "part"],
        )


def summed(frame, kind: str = "<f8"):
    parts = sum(np.frombuffer(x, kind).astype("<f8") for x in frame["part"])
    return frame.iloc[:1].assign(part=[parts.tobytes()])


def latent_space(passages: DataFrame, n_terms: int, rank: int = RANK) -> np.ndarray:
    """Right singular vectors (terms by rank): randomised range finder with power iterations.

    The passes are Spark jobs on A'A, which is summed once over all passages; what
    returns is the product with a thin matrix, whose size is terms of one benchmark
    block times rank.
    """
    width = min(rank + OVERSAMPLING, n_terms)
    matrix = gram(passages, n_terms)
    q, _ = np.linalg.qr(np.random.default_rng(SEED).standard_normal((n_terms, width)))
    for _ in range(POWER + 1):
        basis = q
        parts = (
            matrix.mapInArrow(lambda batches, b=basis: gram_products(batches, b), "low int, part binary")
            .groupBy("low")
            .applyInPandas(lambda frame: summed(frame), "low int, part binary")
            .collect()
        )
        z = np.concatenate(
            [np.frombuffer(r["part"], "<f8").reshape(-1, width) for r in sorted(parts, key=lambda r: r["low"])]
        )
        q, _ = np.linalg.qr(z)
    values, vectors = np.linalg.eigh(basis.T @ z)
    order = np.argsort(values)[::-1][: min(rank, width)]
    return basis @ vectors[:, order]


def sizes_of(items) -> dict[int, np.ndarray]:
    """The items by window size: the power of two, ``CHUNK`` at least, that holds all words of the item."""
    size = np.array([max(CHUNK, 1 << (len(x) - 1).bit_length()) for x in items], np.int64)
    return {int(c): np.flatnonzero(size == c) for c in np.unique(size)}


def side_by_side(texts, largest: int) -> tuple[list[int], np.ndarray]:
    """Where each text starts, and the codes of all; no window of a text reaches into the next."""
    starts, at = [], 0
    for words in texts:
        starts.append(at)
        at += (-(-len(words) // largest) + 1) * largest
    codes = np.full(at, -1, np.int64)
    for low, words in zip(starts, texts):
        codes[low : low + len(words)] = words
    return starts, codes


def chunk_sums(part: np.ndarray, products: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Latent products with all items and squared norm of every ``CHUNK`` words, and of an empty chunk after the last.

    The last row of both tables is zero: it is that of words outside the benchmark (-1).
    """
    n = -(-len(part) // CHUNK) + 1
    words = np.full(n * CHUNK, -1, np.int64)
    words[: len(part)] = part
    words = words.reshape(n, CHUNK)
    sums = np.zeros((n, products.shape[1]), np.float32)
    for k in range(CHUNK):
        sums += products[words[:, k]]
    return sums, squares[words].sum(1)


def least_product(window, item):
    """The least product of a window's vector with an item's direction, from the norms of both."""
    return np.minimum(COSINE * window, SHARE * item)


def candidates(codes: np.ndarray, model):
    """(item, window, first word, last word, cosine) of the windows that are near an item in the latent space.

    Windows are twice as long as the item's size and begin at every multiple of
    it, so that each occurrence of the item lies whole in one of them. ``products``
    are those of the terms' latent vectors with the items': the product of a window's
    vector with an item's is their sum over its words.
    """
    products, squares, weight, sizes = model
    largest = max(sizes)
    step = max(SEGMENT, largest)
    for low in range(0, len(codes), step):
        sums, norms = chunk_sums(codes[low : low + step + 2 * largest], products, squares)
        own = CHUNK
        for size, of in sizes.items():
            while own < size:  # chunks of the next size from pairs
                if len(sums) % 2:
                    sums, norms = np.vstack([sums, sums[-1:] * 0]), np.r_[norms, np.float32(0)]
                sums, norms = sums[::2] + sums[1::2], norms[::2] + norms[1::2]
                own *= 2
            count = -(-min(step, len(codes) - low) // size)
            after = np.vstack([sums[1:], sums[-1:] * 0])[:count], np.r_[norms[1:], np.float32(0)][:count]
            norm = np.sqrt(np.maximum(norms[:count] + after[1], 1e-9))
            product = sums[:count, of] + after[0][:, of]
            for w, i in zip(*(x.tolist() for x in np.nonzero(product >= least_product(norm[:, None], weight[of])))):
                yield int(of[i]), low + w * size, low + (w + 2) * size, float(product[w, i] / norm[w])


def region(words: list, first: int, last: int, size: int) -> list:
    """What the windows that begin from ``first`` to ``last`` and their surroundings hold, for an item of ``size`` words."""
    return words[max(0, first - size // 2) : last + max(WINDOW, size) + size // 2]


def verified(words: list, item: list, low: int) -> tuple[float, float]:
    """Shares of the item and of its answer that the region around a window holds in order."""
    around = region(words, low, low, len(item))
    answer = answer_of(item)
    return lcs(item, around) / len(item), lcs(answer, around) / len(answer)


def search(batches, model):
    """Rows (doc_id, item_id, cosine, item_share, answer_share) of one task's documents.

    The latent cosine proposes pairs of a window and an item. A pair whose
    surroundings lack so many of the item's words, or hold so few of them in
    order, that no place in it could be verified is left out, which rules out
    nothing that would be reported. Every place of the others is verified.
    """
    products, squares, weight, ids, items, sizes = model
    kind = code_type(len(squares) - 1)
    least = [LIKELY * len(x) - 1e-9 for x in items]
    held = [Counter(x).items() for x in items]
    for batch in batches:
        out = []
        for run, texts in runs(batch, kind):
            starts, codes = side_by_side(texts, max(sizes))
            lists: dict = {}
            best: dict = {}
            done: set = set()
            for i, first, last, cosine in candidates(codes, (products, squares, weight, sizes)):
                doc = bisect_right(starts, first) - 1
                first, last = first - starts[doc], min(last - starts[doc], len(texts[doc]))
                if first >= len(texts[doc]):  # between two documents
                    continue
                if doc not in lists:
                    lists[doc] = texts[doc].tolist()
                words, item = lists[doc], items[i]
                # places begin at multiples of STRIDE; those that reach into the window
                low = max(0, first - max(WINDOW, len(item)) - len(item) // 2) // STRIDE * STRIDE
                around = region(words, low, last, len(item))
                present = set(around)
                if sum(n for w, n in held[i] if w in present) < least[i] or lcs(item, around) < least[i]:
                    continue
                for low in range(low, last, STRIDE):
                    if (doc, i, low) in done:
                        continue
                    done.add((doc, i, low))
                    share, answer = verified(words, item, low)
                    if share >= SURE or (share >= LIKELY and answer >= ANSWER):
                        best[doc, i] = max(best.get((doc, i), (0, 0, 0)), (share, answer, cosine))
            own = [run.column(c).to_pylist() for c in ("doc_id", "key")]
            for (doc, i), (share, answer, cosine) in best.items():
                out.append((own[0][doc], own[1][doc], ids[i], min(cosine, 1.0), share, answer))
        columns = list(zip(*out)) if out else [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)],
            names=["doc_id", "key", "item_id", "cosine", "item_share", "answer_share"],
        )


FOUND = "doc_id long, key long, item_id long, cosine double, item_share double, answer_share double"


def item_blocks(benchmark: DataFrame, size: int):
    """Items in blocks of ``size``; of rows with equal id and text one counts."""
    rows, last = [], None
    for row in benchmark.select("item_id", whole("text").alias("text")).orderBy("item_id", "text").toLocalIterator():
        words = tokens(row["text"])
        if words and last != (row["item_id"], row["text"]):
            rows.append((row["item_id"], words))
        last = (row["item_id"], row["text"])
        if len(rows) == size:
            yield rows
            rows = []
    if rows:
        yield rows


def contaminated(docs: DataFrame, benchmark: DataFrame, item_block: int = ITEM_BLOCK) -> DataFrame:
    """One row for each (document, benchmark item) found, with cosine and shares.

    An item that is listed twice counts once.

    Words are runs of letters and digits in lower case. A null or empty text
    holds nothing; an item without words is found nowhere; an empty benchmark
    gives an empty result. Repeated rows give repeated rows, rows without doc_id
    are searched as well. Of several places in a document the best counts.
    Extra columns are not read. Items are taken in blocks of ``item_block``, which
    bounds the terms, the latent space and what is sent to the executors. The cosine
    is that of the best place's window, which is as long as a longer item.
    """
    return places(docs, benchmark, item_block).drop("key")


def row_key(text) -> Column:
    return F.xxhash64(whole(text))


def places(docs: DataFrame, benchmark: DataFrame, item_block: int) -> DataFrame:
    """``contaminated`` with ``key``, a hash of the document's text."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), row_key("text").alias("key"), whole("text").alias("text")
    )
    found = spark.createDataFrame([], FOUND)
    for block in item_blocks(benchmark, item_block):
        terms = {w: k for k, w in enumerate(sorted({w for _, words in block for w in words}))}
        ids, items = [i for i, _ in block], [[terms[w] for w in words] for _, words in block]
        # the texts are cut into words once; all that follows reads the codes
        coded = stored(
            rows.mapInArrow(lambda batches, t=terms: code_rows(batches, t), "doc_id long, key long, codes binary")
        )
        counted = (
            coded.select("codes")
            .mapInArrow(lambda batches, n=len(terms): document_counts(batches, n), "term int, n long")
            .groupBy("term")
            .agg(F.sum("n").alias("n"))
            .collect()
        )
        number = {row["term"]: row["n"] for row in counted}
        frequency = np.zeros(len(terms) + 1)
        for term, n in number.items():
            if term >= -1:
                frequency[term] = n
        weights = np.log((frequency[-1] + 1) / (frequency[:-1] + 1)) + 0.05
        kind = code_type(len(terms))
        own = spark.createDataFrame(
            [(np.array(x, kind).tobytes(),) for words in items for x in passages_of(words)], "codes binary"
        )
        scale = math.sqrt(min(1, CORPUS_WEIGHT / max(1, number.get(-2, 0))))
        passages = reduce(
            DataFrame.unionByName,
            (
                frame.mapInArrow(
                    lambda batches, w=weights, by=by: passage_rows(batches, w, by), "at array<int>, value array<float>"
                )
                for frame, by in ((own, 1.0), (coded.select("codes"), scale))
            ),
        )
        space = latent_space(passages, len(terms), max(RANK, len(block)))
        projected = weights[:, None] * space
        latent = np.stack([sum(projected[w] for w in words) for words in items], 1)
        latent /= np.maximum(np.linalg.norm(latent, axis=0), 1e-9)
        # a last row of zeros is what words outside the benchmark add
        products = np.vstack([projected @ latent, np.zeros((1, len(block)))]).astype(np.float32)
        squares = np.r_[weights**2, 0].astype(np.float32)
        weight = np.array([math.sqrt(squares[x].sum()) for x in items], np.float32)
        model = spark.sparkContext.broadcast((products, squares, weight, ids, items, sizes_of(items)))
        # stored, so that the block's codes need not stay
        hits = stored(coded.mapInArrow(lambda batches, m=model: search(batches, m.value), FOUND))
        found = found.unionByName(hits)
    return found


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark item is found; a row is known by its text, with an id or without."""
    leaked = places(docs, benchmark, ITEM_BLOCK).select(F.col("key").alias("leaked_key")).distinct()
    return docs.join(leaked, row_key(docs["text"]) == F.col("leaked_key"), "left_anti")


def op6_latent_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
