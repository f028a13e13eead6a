"""N-gram Jaccard join by chosen paths.

Every distinct set of word shingles is a class; equal sets join without any
comparison. A class is embedded as T minhash tokens. Each run splits the classes
on chosen positions of the embedding: classes with equal tokens there share a
path, and only paths with more classes than a small bucket are split again. The
number of runs follows from the recall wanted at the deepest split.

Buckets link classes whose embeddings agree enough to a few of their own, so a
bucket of n classes gives fewer than n links. The components of these links hold
every pair that the runs can find; within a component all pairs are compared
exactly on the whole shingle sets, block against block, and only counts and a
spanning set of the true links leave a task.
"""

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabia.llm.common import SPACE, stored, table, whole
from tabia.llm.components import components

WIDTH = 5
SIMILARITY = 0.8
TOKENS = 64
RECALL = 0.999
FIRST_DEPTH, DEEPEST = 2, 4
BUCKET = 64
#: Agreement of embeddings from which a pair is a candidate: four standard deviations below the similarity.
AGREEMENT = SIMILARITY - 4 * math.sqrt(SIMILARITY * (1 - SIMILARITY) / TOKENS)
BLOCK = 512
#: Bytes of shingle sets in a block, about: a task holds two blocks.
BLOCK_BYTES = 4 << 20
_P = np.uint64(0x9E3779B97F4A7C15)


def runs_for(recall: float, similarity: float = SIMILARITY, depth: int = DEEPEST) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**depth))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_codes(found: list[bytes], memo: dict) -> np.ndarray:
    """A 64-bit hash of each word, by blake2b of its bytes; memo keeps those of frequent words."""
    out = []
    for w in found:
        code = memo.get(w)
        if code is None:
            code = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
            if len(memo) < 100_000:
                memo[w] = code
        out.append(code)
    return np.array(out, np.uint64)


def shingles(text: str, memo: dict, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words; a shorter text is one shingle, an empty one none."""
    codes = word_codes(text.encode("utf-8", "surrogatepass").split(), memo)
    if not len(codes):
        return codes
    take = min(width, len(codes))
    out = np.full(len(codes) - take + 1, np.uint64(take))
    with np.errstate(over="ignore"):
        for k in range(take):
            out = mixed(out * _P + codes[k : len(codes) - take + 1 + k])
    return np.unique(out)


def embedded(own: np.ndarray, tokens: int = TOKENS) -> np.ndarray:
    """The set's minhash tokens of 32 bits, each under a multiply-add order of its own."""
    order = mixed(np.arange(1, 2 * tokens + 1, dtype=np.uint64) * _P)
    scale, shift = order[:tokens, None] | np.uint64(1), order[tokens:, None]
    best = np.full(tokens, np.iinfo(np.uint64).max)
    with np.errstate(over="ignore"):
        for at in range(0, len(own), 2048):
            best = np.minimum(best, (own[None, at : at + 2048] * scale + shift).min(axis=1))
        return (mixed(best) >> np.uint64(32)).astype(np.uint32)


def signatures(batches):
    """doc_id, key, set_id (MD5 of the sorted shingles, null without words) and the embedding."""
    memo: dict = {}
    for batch in batches:
        sets = (shingles(x, memo) for x in batch.column("text").to_pylist())
        names, tokens = [], []
        for own in sets:
            names.append(hashlib.md5(own.tobytes()).digest() if len(own) else None)
            tokens.append(embedded(own).astype("<u4").tobytes() if len(own) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("key"), pa.array(names, pa.binary()), pa.array(tokens, pa.binary())],
            names=["doc_id", "key", "set_id", "tokens"],
        )


def paths(batches, runs: int):
    """For each class and run the path at the depths from FIRST_DEPTH to DEEPEST.

    The position that splits a path is chosen by the path itself.
    """
    for batch in batches:
        raw = batch.column("tokens").to_pylist()
        tokens = np.frombuffer(b"".join(raw), "<u4").reshape(len(raw), TOKENS).astype(np.uint64)
        row = np.arange(len(raw))
        for run in range(runs):
            with np.errstate(over="ignore"):
                path = np.full(len(raw), mixed(np.array([run + 1], np.uint64) * _P)[0])
                out = []
                for depth in range(1, DEEPEST + 1):
                    at = (path % np.uint64(TOKENS)).astype(np.int64)
                    path = mixed(path * _P + tokens[row, at])
                    if depth >= FIRST_DEPTH:
                        out.append(pa.array(path.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("set_id"), *out],
                names=["c", *(f"p{d}" for d in range(FIRST_DEPTH, DEEPEST + 1))],
            )


def linked_in_bucket(names: list[bytes], tokens: np.ndarray) -> list[tuple[bytes, bytes]]:
    """Spanning links of the classes whose embeddings agree enough."""
    near = (tokens[:, None, :] == tokens[None, :, :]).mean(-1) >= AGREEMENT
    return spanning(near, names)


def spanning(near: np.ndarray, names) -> list[tuple]:
    """One link for each class but the first of every component of a symmetric relation."""
    left, out = set(range(len(names))), []
    while left:
        start = left.pop()
        queue = [start]
        while queue:
            i = queue.pop()
            for j in np.flatnonzero(near[i]).tolist():
                if j in left:
                    left.remove(j)
                    queue.append(j)
                    out.append((names[i], names[j]))
    return out


def bucket_links(batches):
    """Rows come sorted by bucket; a bucket is compared as soon as its last row is there."""
    bucket, names, tokens = None, [], []

    def links():
        if len(names) < 2:
            return []
        return linked_in_bucket(names, np.frombuffer(b"".join(tokens), "<u4").reshape(-1, TOKENS))

    for batch in batches:
        found = []
        for b, c, t in zip(*(batch.column(k).to_pylist() for k in ("bucket", "c", "tokens"))):
            if b != bucket:
                found += links()
                bucket, names, tokens = b, [], []
            names.append(c)
            tokens.append(t)
        yield edge_batch(found)
    yield edge_batch(links())


def edge_batch(found):
    a, b = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def candidate_links(classes: DataFrame, recall: float, bucket: int) -> DataFrame:
    """Edges (a, b) whose components hold every pair that meets in a bucket of some run and may be similar.

    A path with many classes at the deepest split (a big group of near copies, or
    shared boilerplate) becomes one component by links to its first class and is
    left to the exact comparison: no class is dropped and no pair is listed.
    """
    runs = runs_for(recall)
    names = [f"p{d}" for d in range(FIRST_DEPTH, DEEPEST + 1)]
    schema = "c binary, " + ", ".join(f"{n} long" for n in names)
    rows = classes.select(F.col("set_id"), "tokens").mapInArrow(lambda batches: paths(batches, runs), schema)
    done = None
    for name in names:
        sizes = rows.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("first")).where("n > 1")
        met = stored(rows.join(sizes, name))
        small = met.where(F.col("n") <= bucket).select(F.col(name).alias("bucket"), "c")
        done = small if done is None else done.unionByName(small)
        rows = met.where(F.col("n") > bucket).drop("n", "first")
    big = met.where(F.col("n") > bucket).select(F.col("c").alias("a"), F.col("first").alias("b"))
    compared = (
        done.join(classes.select(F.col("set_id").alias("c"), "tokens"), "c")
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .select("bucket", "c", "tokens")
        .mapInArrow(lambda batches: bucket_links(batches), "a binary, b binary")
    )
    return compared.unionByName(big).where("a <> b").distinct()


def class_sets(batches):
    """The shingle sets of the documents that stand for a class; other rows of the same doc_id are left out."""
    memo: dict = {}
    for batch in batches:
        rows = zip(*(batch.column(k).to_pylist() for k in ("c", "label", "text")))
        kept = []
        for c, label, text in rows:
            raw = shingles(text, memo).tobytes()
            if hashlib.md5(raw).digest() == c:
                kept.append((c, label, raw))
        c, label, raw = zip(*kept) if kept else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.binary()), pa.array(label, pa.binary()), pa.array(raw, pa.binary())],
            names=["c", "label", "own"],
        )


def common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets."""
    both = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    _, column, n = np.unique(both, return_inverse=True, return_counts=True)
    shared = n[column] > 1
    order = np.argsort(column[shared], kind="stable")
    column, owner = column[shared][order], owner[shared][order]
    out = np.zeros((len(left), len(right)), np.float32)
    if not len(column):
        return out
    column = np.cumsum(np.r_[0, column[1:] != column[:-1]])
    width = 1024
    cuts = np.searchsorted(column, np.arange(0, column[-1] + 1, width))
    for low, high in zip(cuts, [*cuts[1:], len(column)]):
        part = np.zeros((len(left) + len(right), width), np.float32)
        part[owner[low:high], column[low:high] % width] = 1
        out += part[: len(left)] @ part[len(left) :].T
    return out


def compared_blocks(frame: pd.DataFrame) -> pd.DataFrame:
    """All pairs of two blocks of a component (or of one): the number of links of each class, and spanning links."""
    first, second = int(frame["i"].iloc[0]), int(frame["j"].iloc[0])
    frame = frame.sort_values("c")
    names = frame["c"].tolist()
    sets = [np.frombuffer(x, np.uint64) for x in frame["own"]]
    block = frame["block"].to_numpy()
    at = np.flatnonzero(block == first)
    to = np.flatnonzero(block == second)
    size = np.array([len(s) for s in sets], np.float64)
    inter = common([sets[k] for k in at], [sets[k] for k in to]).astype(np.float64)
    union = size[at][:, None] + size[to][None, :] - inter
    near = 10 * inter >= round(10 * SIMILARITY) * union
    if first == second:
        np.fill_diagonal(near, False)
        links = near.sum(1)
        edges = spanning(near, names)
        counted = list(zip(names, links))
    else:
        whole_relation = np.zeros((len(names), len(names)), bool)
        whole_relation[np.ix_(at, to)] = near
        whole_relation[np.ix_(to, at)] = near.T
        edges = spanning(whole_relation, names)
        counted = list(zip(names, whole_relation.sum(1)))
    a = [c for c, n in counted if n] + [e[0] for e in edges]
    b = [None] * (len(a) - len(edges)) + [e[1] for e in edges]
    n = [int(n) for _, n in counted if n] + [0] * len(edges)
    return pd.DataFrame({"a": a, "b": b, "n": n})


def near_duplicates(
    docs: DataFrame, recall: float = RECALL, bucket: int = BUCKET, block: int = BLOCK
) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, class_id, n_links, n_copies.

    Documents are linked when the Jaccard similarity of their sets of five-word
    shingles is 0.8 or more; a text of one to four words is a single shingle.
    ``class_id`` is the smallest doc_id of all documents connected by links (null
    where none has one), ``n_links`` the number of different shingle sets that the
    document's own set is linked to, ``n_copies`` the number of rows with the same
    set. Texts without a word (null, empty) are linked to nothing and are their
    own class. Rows are told apart by doc_id and text, so rows without doc_id or
    with a repeated one are compared by their own texts. Extra columns are not read.
    """
    return classified(docs, recall, bucket, block).select("doc_id", "class_id", "n_links", "n_copies")


def row_key(text) -> Column:
    return F.xxhash64(whole(text))


def classified(docs: DataFrame, recall: float, bucket: int, block: int) -> DataFrame:
    """``near_duplicates`` with each row's ``key`` (a hash of its text) and ``first``: (id, key) of its class's first row.

    Rows without doc_id come after all others; a class's text is that of its first row.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text"), row_key("text").alias("key"))
    signed = stored(
        rows.mapInArrow(lambda batches: signatures(batches), "doc_id long, key long, set_id binary, tokens binary")
    )
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("key"))
    classes = stored(
        signed.where("set_id is not null")
        .groupBy("set_id")
        .agg(
            F.min(place).alias("first"),
            F.any_value("tokens").alias("tokens"),
            F.count(F.lit(1)).alias("n_copies"),
        )
    )
    labels = components(stored(candidate_links(classes, recall, bucket)))
    members = labels.join(classes.select(F.col("set_id").alias("node"), "first"), "node")
    own = (
        members.join(rows, (F.col("first.key") == F.col("key")) & F.col("first.id").eqNullSafe(F.col("doc_id")))
        .select(F.col("node").alias("c"), "label", "text")
        .mapInArrow(lambda batches: class_sets(batches), "c binary, label binary, own binary")
        .dropDuplicates(["c"])
    )
    own = stored(own)
    sizes = own.groupBy("label").agg(F.count(F.lit(1)).alias("m"), F.sum(F.length("own")).alias("bytes"))
    blocks = F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    dealt = (
        own.join(sizes, "label")
        .withColumn("block", F.pmod(F.xxhash64("c"), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select(
            "label",
            F.least("block", "other").alias("i"),
            F.greatest("block", "other").alias("j"),
            "c",
            "block",
            "own",
        )
    )
    found = stored(
        dealt.groupBy("label", "i", "j").applyInPandas(
            lambda frame: compared_blocks(frame), "a binary, b binary, n long"
        )
    )
    links = found.where("b is null").groupBy(F.col("a").alias("set_id")).agg(F.sum("n").alias("n_links"))
    final = components(found.where("b is not null"))
    reps = (
        final.join(classes.select(F.col("set_id").alias("node"), "first"), "node")
        .groupBy("label")
        .agg(F.min("first").alias("group_first"))
    )
    grouped = final.join(reps, "label").select(F.col("node").alias("set_id"), "group_first")
    facts = (
        classes.select("set_id", "first", "n_copies")
        .join(grouped, "set_id", "left")
        .join(links, "set_id", "left")
        .withColumn("first", F.coalesce("group_first", "first"))
    )
    return signed.select("doc_id", "key", "set_id").join(facts, "set_id", "left").select(
        "doc_id",
        "key",
        F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(F.col("first.id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        "first",
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The first document of each class: the one with the smallest doc_id, or of rows without id that of the smallest hash.

    Rows of one doc_id with different texts are different documents here; of
    equal ids and texts one row stays, the smallest. Texts without a word are
    their own class: one row of each doc_id stays, and all rows without an id.
    """
    found = classified(docs, RECALL, BUCKET, BLOCK)
    same = (F.col("doc_id").eqNullSafe(F.col("first.id"))) & (F.col("key") == F.col("first.key"))
    kept = found.where(same).select(F.col("doc_id").alias("kept_id"), F.col("key").alias("kept_key")).distinct()
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    wordless = F.btrim(whole("text"), F.lit(SPACE)) == ""
    boxes = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("id"), row_key("text").alias("key"), wordless.alias("wordless"))
    loose = F.col("wordless") & F.col("id").isNull()
    firsts = boxes.where(~loose).groupBy("id", "key", "wordless").agg(F.min("row").alias("row"))
    stay = firsts.where(~F.col("wordless")).join(
        kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("key") == F.col("kept_key")), "left_semi"
    )
    return (
        stay.select("row")
        .unionByName(firsts.where("wordless").groupBy("id").agg(F.min("row").alias("row")).select("row"))
        .unionByName(boxes.where(loose).select("row"))
        .select("row.*")
    )


def op8_chosen_path_join(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
