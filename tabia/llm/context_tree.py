"""Language-model scores by context-tree weighting over bytes.

A text is read as its lower-case words, joined by one blank, and an end byte. A
byte is coded as a binary decomposition in two parts, its low five bits in the
context of the bytes before it and its high three bits in the context of the
low ones. Every node of the tree holds Krichevsky-Trofimov counts; a context
predicts by the weighted mixture over all depths. Weights and counts come from
the training documents, after which the tree is fixed, so every document is
scored by the same model.

A context byte stands for its low five bits. Counts are gathered from every
training document; the tree is built in Spark, one task for each class of the
last byte, and is a table with a row for each context that occurs. A small table
(counted first) is broadcast. A larger one is joined block by block to the
contexts that a block of documents holds, as the word counts of the base score
are, and answers with the logs of the symbols that the block asks for; both ways
give the same scores.
"""

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tabia.llm.common import table, whole, written

DEPTH = 5
LOW_BITS, HIGH_BITS = 5, 3
#: Contexts of the high bits: own low bits, high and low bits of the byte before.
HIGH_CONTEXT = (5, 3, 5)
#: The tree is broadcast up to so many contexts (128 bytes each).
BROADCAST_CONTEXTS = 600_000
FOLDS = 10
BLOCK_BYTES = 16 << 20
CHUNK_BYTES = 4 << 20
SCORE_BYTES = 1 << 20
FLUSH_WORDS = 400_000
FLUSH_KEYS = 2_000_000
#: Rows whose texts are Python strings at once.
TEXT_ROWS = 256
PAD = b" " * DEPTH


def stream(text: str) -> tuple[list[bytes], bytes]:
    """The words of a text and the bytes that are coded. bytes.split cuts at [\\x20\\x09-\\x0D]."""
    found = text.encode("utf-8", "surrogatepass").lower().split()
    return found, b" ".join(found) + b"\n"


def keys(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte: (contexts, low bits), the last byte on top, and (contexts, high bits)."""
    low, high = data & 31, data >> 5
    n = len(data)
    out = np.zeros(n, np.int32)
    for back in range(1, DEPTH + 1):
        out <<= LOW_BITS
        out[back:] |= low[: n - back]
    out = (out << LOW_BITS) | low
    side = low.astype(np.int32) << 8
    side[1:] |= (high[:-1].astype(np.int32) << 5) | low[:-1]
    return out, (side << HIGH_BITS) | high


def chunks(streams, limit=CHUNK_BYTES):
    """Padded streams joined to arrays of about ``limit`` bytes, with the start of each stream."""
    parts, starts, size = [], [], 0
    for s in streams:
        parts += (PAD, s)
        starts.append(size)
        size += len(PAD) + len(s)
        if size >= limit:
            yield np.frombuffer(b"".join(parts), np.uint8), np.array(starts)
            parts, starts, size = [], [], 0
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), np.array(starts)


def distinct(numbers: np.ndarray) -> np.ndarray:
    """The sorted numbers once each. ``np.unique`` hashes integers, which takes ten times as long as sorting them."""
    numbers = np.sort(numbers)
    return numbers[np.r_[True, numbers[1:] != numbers[:-1]]] if len(numbers) else numbers


def coded(size: int, starts: np.ndarray) -> np.ndarray:
    """False at the padding."""
    mask = np.ones(size, bool)
    for k in range(len(PAD)):
        mask[starts + k] = False
    return mask


def texts(batches):
    for batch in batches:
        column = batch.column("text")
        for at in range(0, len(column), TEXT_ROWS):
            yield from column.slice(at, TEXT_ROWS).to_pylist()


def packed(numbers: np.ndarray) -> list[bytes]:
    raw = numbers.astype(">u4").tobytes()
    return [raw[i : i + 4] for i in range(0, len(raw), 4)]


def packed_array(numbers: np.ndarray) -> pa.Array:
    """``packed`` as an Arrow array, without an object for each number."""
    raw = pa.py_buffer(numbers.astype(">u4").tobytes())
    ends = pa.py_buffer(np.arange(0, 4 * len(numbers) + 1, 4, dtype=np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(numbers), [None, ends, raw])


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    at = np.concatenate([p[0] for p in parts])
    order = np.argsort(at)
    at, n = at[order], np.concatenate([p[1] for p in parts])[order]
    if not len(at):
        return at, n
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    return at[starts], np.add.reduceat(n, starts)


def count(batches):
    """Counts of words (w), ends (e), low keys (l) and high keys (h), flushed at a fixed size."""
    low: list = []
    held = 0
    high = np.zeros(1 << (sum(HIGH_CONTEXT) + HIGH_BITS), np.int64)
    found: Counter = Counter()
    ends = 0

    def rows(kind, names, numbers):
        for at in range(0, len(names), 50_000):
            part = names[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.repeat(kind, len(part)),
                    packed_array(part) if isinstance(part, np.ndarray) else pa.array(part, pa.binary()),
                    pa.array(numbers[at : at + 50_000], pa.int64()),
                ],
                names=["kind", "key", "n"],
            )

    def streams():
        nonlocal ends
        for text in texts(batches):
            own, data = stream(text)
            found.update(own)
            ends += 1
            yield data

    for data, starts in chunks(streams()):
        mask = coded(len(data), starts)
        a, b = keys(data)
        low.append(np.unique(a[mask], return_counts=True))
        held += len(low[-1][0])
        high += np.bincount(b[mask], minlength=len(high))
        if held >= FLUSH_KEYS:
            low = [merged(low)]
            held = len(low[0][0])
            if held >= FLUSH_KEYS // 2:
                yield from rows("l", low[0][0], low[0][1])
                low, held = [], 0
        if len(found) >= FLUSH_WORDS:
            yield from rows("w", list(found), list(found.values()))
            found.clear()
    yield from rows("w", list(found), list(found.values()))
    yield from rows("e", [b""], [ends])
    if low:
        at, n = merged(low)
        yield from rows("l", at, n)
    at = np.flatnonzero(high)
    yield from rows("h", at, high[at])


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by eight."""
    shift = np.ones_like(x)
    for k in range(8):
        shift *= x + k
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) - np.log(shift)


def bit_counts(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at each of the 2**S - 1 nodes of the binary decomposition, in heap order."""
    shape, size = symbols.shape[:-1], symbols.shape[-1]
    zeros, ones = [], []
    width = size
    while width > 1:
        half = symbols.reshape(*shape, size // width, 2, width // 2).sum(-1)
        zeros.append(half[..., 0])
        ones.append(half[..., 1])
        width //= 2
    return np.concatenate(zeros, -1).astype(float), np.concatenate(ones, -1).astype(float)


def estimated(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Krichevsky-Trofimov log probability of the data at each bit node, and the next P(bit = 1)."""
    zeros, ones = bit_counts(symbols)
    own = log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - math.log(math.pi)
    return own, (ones + 0.5) / (zeros + ones + 1)


def tree(contexts: np.ndarray, symbols: np.ndarray, bits) -> tuple[np.ndarray, list]:
    """The weighted tree over sorted contexts; ``bits`` are the widths of its levels, the root's children first.

    Returns the weighted log probability at the root and, for each level from
    the root on, (contexts, P(bit = 1) when nothing deeper is known). Each node
    gives half its weight to its own estimate and half to its children.
    """
    levels = [(contexts, symbols, None)]
    for width in reversed(bits):
        at = levels[-1][0] >> width
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        levels.append((at[starts], np.add.reduceat(levels[-1][1], starts, axis=0), starts))
    weights, estimates, below = [], [], None
    for _, counts, starts in levels:
        own, p = estimated(counts)
        if below is None:
            weight, below = np.ones_like(own), own
        else:
            mixed = np.logaddexp(own, np.add.reduceat(below, starts, axis=0)) - math.log(2)
            weight, below = np.exp(own - math.log(2) - mixed), mixed
        weights.append(weight)
        estimates.append(p)
    out = []
    above, rest = 0.0, 1.0
    for k in range(len(levels) - 1, -1, -1):
        above = above + rest * weights[k] * estimates[k]
        rest = rest * (1 - weights[k])
        out.append((levels[k][0], above + rest / 2))
        if k:
            sizes = np.diff(np.r_[levels[k][2], len(levels[k - 1][0])])
            above, rest = np.repeat(above, sizes, axis=0), np.repeat(rest, sizes, axis=0)
    return below[0], out


def symbol_logs(ones: np.ndarray) -> np.ndarray:
    """log10 of each symbol's probability from the probabilities of its bits."""
    with np.errstate(divide="ignore"):
        yes, no = np.log10(ones), np.log10(1 - ones)
    nodes = ones.shape[-1]
    out = np.zeros((*ones.shape[:-1], 1))
    at = 0
    while at < nodes:
        n = out.shape[-1]
        out = np.stack([out + no[..., at : at + n], out + yes[..., at : at + n]], -1).reshape(*ones.shape[:-1], 2 * n)
        at += n
    return out


def subtree(frame: pd.DataFrame) -> pd.DataFrame:
    """The tree below one class of the last byte: a row for each context, and one (level 0) for the root."""
    key = frame["key"].to_numpy()
    order = np.argsort(key)
    key, n = key[order], frame["n"].to_numpy()[order]
    context, at = np.unique(key >> LOW_BITS, return_inverse=True)
    symbols = np.zeros((len(context), 1 << LOW_BITS))
    symbols[at, key & 31] = n
    weighted, levels = tree(context, symbols, [LOW_BITS] * (DEPTH - 1))
    root = np.concatenate([weighted, symbols.sum(0)]).astype("<f8").tobytes()
    kinds, names, ones = ["0"], [b""], [root]
    for depth, (contexts, p) in enumerate(levels, 1):
        raw, width = p.astype("<f4").tobytes(), 4 * p.shape[1]
        kinds += [str(depth)] * len(contexts)
        names += packed(contexts)
        ones += [raw[i : i + width] for i in range(0, len(raw), width)]
    return pd.DataFrame({"kind": kinds, "key": names, "ones": ones})


def context_table(counts: DataFrame) -> DataFrame:
    rows = counts.where("kind = 'l'").select(F.conv(F.hex("key"), 16, 10).cast("long").alias("key"), "n")
    return written(
        rows.groupBy(F.shiftright("key", DEPTH * LOW_BITS).alias("top"))
        .applyInPandas(lambda frame: subtree(frame), "kind string, key binary, ones binary")
    )


def root_of(contexts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The root's weight and estimate at each bit node, and P(bit = 1) without any context."""
    nodes, symbols = (1 << LOW_BITS) - 1, np.zeros(1 << LOW_BITS)
    weighted = np.zeros(nodes)
    for row in contexts.where("kind = '0'").collect():  # one for each class of a byte
        numbers = np.frombuffer(row["ones"], "<f8")
        weighted += numbers[:nodes]
        symbols += numbers[nodes:]
    own, p = estimated(symbols)
    weight = np.exp(own - np.logaddexp(own, weighted))
    return weight, p, weight * p + (1 - weight) / 2


def flat(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """The numbers in a column of byte strings of ``width`` bytes."""
    c = column.cast(pa.binary(width))
    return np.frombuffer(c.buffers()[1], np.uint8, width * len(c), width * c.offset).view(kind)


def logs_of(batches, root):
    """Rows (kind, key, ones) of the tree with the logs of all symbols in place of ``ones``."""
    weight, p, _ = root
    width = (1 << LOW_BITS) - 1
    for batch in batches:
        deep = flat(batch.column("ones"), "<f4", 4 * width).reshape(-1, width)
        logs = symbol_logs(weight * p + (1 - weight) * deep.astype(np.float64)).astype("<f4")
        yield pa.RecordBatch.from_arrays(
            [batch.column("kind"), batch.column("key"), binary_array(logs, np.full(len(logs), logs.shape[1]))],
            names=["kind", "key", "logs"],
        )


def binary_array(numbers: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Byte strings of ``sizes`` four-byte numbers each."""
    ends = np.r_[0, 4 * np.cumsum(sizes)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(numbers))])


def symbols_of(context: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted contexts once each, with the symbols of equal ones as a bit mask."""
    if not len(context):
        return context, masks
    starts = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
    return context[starts], np.bitwise_or.reduceat(masks, starts)


def chosen(batches):
    """Of each context that is in the tree the logs of the symbols in its mask ``n``; rows of words stay as they are."""
    width = 1 << LOW_BITS
    for batch in batches:
        words = batch.filter(pc.equal(batch.column("kind"), "w"))
        if len(words):
            yield words
        deep = batch.filter(batch.column("logs").is_valid())
        if len(deep):
            masks = deep.column("n").to_numpy().astype(np.uint32)
            asked = (masks[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1) == 1
            logs = flat(deep.column("logs"), "<f4", 4 * width).reshape(-1, width)[asked]
            yield pa.RecordBatch.from_arrays(
                [*(deep.column(c) for c in ("block", "kind", "key", "n")), binary_array(logs, np.bitwise_count(masks))],
                names=["block", "kind", "key", "n", "logs"],
            )


def answered(found: pa.Table, depth: int):
    """The contexts of one depth that are in the tree, in batches."""
    for batch in found.to_batches():
        own = batch.filter(pc.equal(batch.column("kind"), str(depth)))
        if len(own):
            yield own


def numbers_in(column: pa.Array) -> np.ndarray:
    """All numbers in a column of byte strings, one after the other."""
    _, ends, raw = column.buffers()
    ends = np.frombuffer(ends, np.int32, len(column) + 1, 4 * column.offset)
    return np.frombuffer(raw, np.uint8)[ends[0] : ends[-1]].view("<f4") if raw is not None else np.zeros(0, "<f4")


def asked_level(names: np.ndarray, masks: np.ndarray, logs: np.ndarray) -> tuple:
    """Sorted contexts with the logs of their asked symbols, one after the other, the masks and where each starts."""
    at = names.astype(np.int32)
    order = np.argsort(at)
    sizes = np.bitwise_count(masks).astype(np.int64)
    first = np.cumsum(sizes) - sizes
    sizes = sizes[order]
    starts = np.cumsum(sizes) - sizes
    moved = logs[np.repeat(first[order] - starts, sizes) + np.arange(len(logs))]
    # one more, for a symbol that was not asked and so counts for nothing
    return at[order], np.r_[moved, np.float32(0)], masks[order], starts.astype(np.int32)


def picked(found: tuple, row: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The logs of symbols in rows of a level, which holds those of all symbols or of the asked ones."""
    if len(found) == 2:
        return found[1][row, symbol]
    _, logs, masks, starts = found
    before = masks[row] & ((np.uint32(1) << symbol.astype(np.uint32)) - np.uint32(1))
    return logs[starts[row] + np.bitwise_count(before)]


def level(names: np.ndarray, parts, root) -> tuple[np.ndarray, np.ndarray]:
    """Sorted contexts and the logs of their symbols; ``parts`` hold P(bit = 1) in the order of ``names``."""
    weight, p, _ = root
    at = names.astype(np.int32)
    order = np.argsort(at)
    place = np.empty(len(at), np.int64)
    place[order] = np.arange(len(at))
    logs = np.empty((len(at), 1 << LOW_BITS), np.float32)
    done = 0
    for deep in parts:
        logs[place[done : done + len(deep)]] = symbol_logs(weight * p + (1 - weight) * deep.astype(np.float64))
        done += len(deep)
    return at[order], logs


class Contexts:
    """log10 P(low bits | contexts) of the contexts that occur, by depth."""

    def __init__(self, alone, levels):
        self.alone, self.levels = alone, levels
        self.bits = self.base = None

    @classmethod
    def read(cls, rows, root):
        """From rows (kind, key, ones)."""
        parts: dict = {}
        for kind, key, ones in rows:
            depth = int(kind)
            if depth:
                parts.setdefault(depth, ([], []))
                parts[depth][0].append(key)
                parts[depth][1].append(ones)
        levels = {}
        for depth, (names, ones) in parts.items():
            at = np.frombuffer(b"".join(names), ">u4")
            deep = np.frombuffer(b"".join(ones), "<f4").reshape(len(at), -1)
            levels[depth] = level(at, (deep[i : i + 20_000] for i in range(0, len(at), 20_000)), root)
        return cls(symbol_logs(root[2]).astype(np.float32), levels)

    @classmethod
    def read_arrow(cls, found: pa.Table, root):
        """From an Arrow table with kind, key, n and logs, the answers to what a block asked."""
        levels = {}
        for depth in range(1, DEPTH + 1):
            own = list(answered(found, depth))
            if own:
                names = np.concatenate([flat(x.column("key"), ">u4", 4) for x in own])
                masks = np.concatenate([x.column("n").to_numpy().astype(np.uint32) for x in own])
                levels[depth] = asked_level(names, masks, np.concatenate([numbers_in(x.column("logs")) for x in own]))
        return cls(symbol_logs(root[2]).astype(np.float32), levels)

    def index(self) -> None:
        """A bit for each deepest context that occurs, and the rows before each word of bits."""
        at = self.levels[DEPTH][0] if DEPTH in self.levels else np.zeros(0, np.int32)
        self.bits = np.zeros(1 << (LOW_BITS * (DEPTH - 1)), np.uint32)
        np.bitwise_or.at(self.bits, at >> LOW_BITS, np.uint32(1) << (at & 31).astype(np.uint32))
        counts = np.bitwise_count(self.bits)
        self.base = (np.cumsum(counts) - counts).astype(np.int32)

    def logs(self, key: np.ndarray) -> np.ndarray:
        if self.bits is None:
            self.index()
        symbol, context = key & 31, key >> LOW_BITS
        word, bit = self.bits[context >> LOW_BITS], (context & 31).astype(np.uint32)
        found = (word >> bit) & 1 == 1
        out = np.empty(len(key), np.float32)
        before = np.bitwise_count(word & ((np.uint32(1) << bit) - np.uint32(1)))
        if found.any():
            row = self.base[context >> LOW_BITS] + before
            out[found] = picked(self.levels[DEPTH], row[found], symbol[found])
        left = np.flatnonzero(~found)
        for depth in range(DEPTH - 1, 0, -1):
            if not len(left) or depth not in self.levels:
                continue
            names = self.levels[depth][0]
            own = context[left] >> (LOW_BITS * (DEPTH - depth))
            row = np.minimum(np.searchsorted(names, own), len(names) - 1)
            hit = names[row] == own
            out[left[hit]] = picked(self.levels[depth], row[hit], symbol[left[hit]])
            left = left[~hit]
        out[left] = self.alone[symbol[left]]
        return out


def high_table(counts: DataFrame) -> np.ndarray:
    """log10 P(high bits | contexts) by key; at most 2**16 counts reach the driver."""
    flat = np.zeros(1 << (sum(HIGH_CONTEXT) + HIGH_BITS))
    for row in counts.where("kind = 'h'").collect():
        flat[int.from_bytes(row["key"], "big")] = row["n"]
    symbols = flat.reshape(-1, 1 << HIGH_BITS)
    _, levels = tree(np.arange(len(symbols)), symbols, HIGH_CONTEXT)
    return symbol_logs(levels[-1][1]).astype(np.float32).reshape(-1)


def code_logs(streams, contexts: Contexts, high: np.ndarray) -> np.ndarray:
    """log10 probability of each stream."""
    out = [np.zeros(0)]
    for data, starts in chunks(streams, SCORE_BYTES):
        a, b = keys(data)
        logs = contexts.logs(a).astype(np.float64)
        logs += high[b]
        logs[~coded(len(data), starts)] = 0
        out.append(np.add.reduceat(logs, starts))
    return np.concatenate(out)


def in_blocks(batches, limit=BLOCK_BYTES):
    """Runs of rows of about ``limit`` bytes, cut by the rows alone and not by the batches."""
    rows, size, number = [], 0, 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "held_out", "text"))):
            rows.append(row)
            size += len(row[3]) + 16
            if size >= limit:
                yield (row[0] << 32) + number, rows
                rows, size, number = [], 0, number + 1
    if rows:
        yield (rows[0][0] << 32) + number, rows


def block_asks(batches, with_contexts: bool, trained_known: bool = False):
    """The distinct words of every block and, where the tree is not broadcast, its contexts of every depth.

    ``mask`` has a bit for each symbol that follows a context in the block. With
    ``trained_known`` only rows that are not trained on ask for the shorter
    contexts: the longest ones of a training row are all in the tree.
    """
    for block, rows in in_blocks(batches):
        own = set()

        def streams(rows, own=own):
            for row in rows:
                found, data = stream(row[3])
                own.update(found)
                yield data

        def found_keys(rows):
            parts = [distinct(keys(data)[0]) for data, _ in chunks(streams(rows))]
            return distinct(np.concatenate([np.zeros(0, np.int32), *parts]))

        deep = short = np.zeros(0, np.int32)
        if with_contexts:
            known = [trained_known and row[2] is False for row in rows]
            short = found_keys(row for row, k in zip(rows, known) if not k)
            trained = found_keys(row for row, k in zip(rows, known) if k)
            deep = distinct(np.concatenate([short, trained])) if any(known) else short
        else:
            for row in rows:
                own.update(stream(row[3])[0])
        kinds, names = [pa.repeat("w", len(own))], [pa.array(list(own), pa.binary())]
        asked = [pa.nulls(len(own), pa.int64())]
        for depth in range(DEPTH, 0, -1):
            at = deep if depth == DEPTH else short
            context, masks = symbols_of(
                at >> LOW_BITS * (DEPTH - depth + 1), np.uint32(1) << (at & 31).astype(np.uint32)
            )
            kinds.append(pa.repeat(str(depth), len(context)))
            names.append(packed_array(context))
            asked.append(pa.array(masks.astype(np.int64)))
        kinds, names = pa.concat_arrays(kinds), pa.concat_arrays(names)
        yield pa.RecordBatch.from_arrays(
            [pa.repeat(pa.scalar(block, pa.int64()), len(kinds)), kinds, names, pa.concat_arrays(asked)],
            names=["block", "kind", "key", "mask"],
        )


def block_docs(batches):
    for block, rows in in_blocks(batches):
        _, ids, held, text = zip(*rows)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([block] * len(rows), pa.int64()),
                pa.array(ids, pa.int64()),
                pa.array(held, pa.bool_()),
                pa.array(text, pa.string()),
            ],
            names=["block", "doc_id", "held_out", "text"],
        )


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"


def context_tree_scores(docs: DataFrame, broadcast_contexts: int = BROADCAST_CONTEXTS) -> DataFrame:
    """One row for each document with a text score of the base and of the model.

    Rows need ``doc_id``, ``held_out`` and ``text``. A null or empty text is its
    end alone. Repeated rows are scored each, and each trains. Without a
    training row every token is unknown (V = N = 0) and the tree predicts 1/2
    everywhere. Extra columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.spark_partition_id().cast("long").alias("part"),
        F.col("doc_id").cast("long").alias("doc_id"),
        "held_out",
        whole("text").alias("text"),
    )
    counts = written(
        rows.where(~F.col("held_out"))
        .select("text")
        .mapInArrow(lambda batches: count(batches), "kind string, key binary, n long")
        .groupBy("kind", "key")
        .agg(F.sum("n").alias("n"))
    )
    totals = (
        counts.where("kind in ('w', 'e') and n > 0")
        .agg(
            F.sum("n").alias("tokens"),
            F.count(F.lit(1)).alias("distinct"),
            F.sum(F.when(F.col("kind") == "e", F.col("n"))).alias("ends"),
        )
        .first()
    )
    n, v, ends = totals["tokens"] or 0, totals["distinct"], totals["ends"] or 0
    floor = math.log10(n + 0.1 * (v + 1))
    end = math.log10(ends + 0.1) - floor
    contexts = context_table(counts)
    root, high = root_of(contexts), high_table(counts)
    small = contexts.count() <= broadcast_contexts
    shared = Contexts.read(contexts.toLocalIterator(), root) if small else None
    # arrays only: executors unpickle a broadcast without this package
    model = spark.sparkContext.broadcast((shared and (shared.alone, shared.levels), root, high))
    del shared

    answers = counts.where("kind = 'w'").select("kind", "key", "n", F.lit(None).cast("binary").alias("logs"))
    if not small:
        deep = contexts.where("kind <> '0'").select("kind", "key", "ones").mapInArrow(
            lambda batches: logs_of(batches, model.value[1]), "kind string, key binary, logs binary"
        )
        answers = answers.unionByName(deep.withColumn("n", F.lit(None).cast("long")))
    known = (
        rows.mapInArrow(lambda batches: block_asks(batches, not small, True), "block long, kind string, key binary, mask long")
        # a hashed side saves sorting the asks, which are many times the answers; a key has one answer
        .join(answers.hint("shuffle_hash"), ["kind", "key"], "left")
        .select("block", "kind", "key", F.coalesce("n", "mask").alias("n"), "logs")
    )
    if not small:
        known = known.mapInArrow(
            lambda batches: chosen(batches), "block long, kind string, key binary, n long, logs binary"
        )

    def scored(docs_table: pa.Table, known_table: pa.Table) -> pa.Table:
        shared, root, high = model.value
        asked = known_table.filter(pc.field("kind") == "w").select(["key", "n"])
        logs = {}
        for batch in asked.to_batches():
            for w, c in zip(*(column.to_pylist() for column in batch.columns)):
                logs[w] = math.log10((c or 0) + 0.1) - floor
        del asked
        unknown = math.log10(0.1) - floor
        base, tokens, seen, sizes, streams = [], [], [], [], []
        for text in docs_table.column("text").to_pylist():
            found, data = stream(text)
            own = list(map(logs.__getitem__, found))
            base.append(math.fsum(own) + end)
            tokens.append(len(found) + 1)
            seen.append(len(found) - own.count(unknown) + (ends > 0))
            sizes.append(len(data))
            streams.append(data)
        del logs
        tree_of = Contexts(*shared) if shared else Contexts.read_arrow(known_table, root)
        score = code_logs(streams, tree_of, high)
        del tree_of, streams
        pa.default_memory_pool().release_unused()  # what earlier blocks freed
        return pa.table(
            {
                "doc_id": docs_table.column("doc_id"),
                "held_out": docs_table.column("held_out"),
                "n_tokens": pa.array(tokens, pa.int64()),
                "n_known": pa.array(seen, pa.int64()),
                "train_tokens": pa.array([n] * len(tokens), pa.int64()),
                "base_score": pa.array(base, pa.float64()),
                "score": pa.array(score, pa.float64()),
                "bits_per_byte": pa.array(-score / math.log10(2) / np.array(sizes), pa.float64()),
            }
        )

    left = rows.mapInArrow(lambda batches: block_docs(batches), "block long, doc_id long, held_out boolean, text string")
    return left.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(scored, SCORES)


def op5_context_tree(spark, sf_dir):
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS == 0
    docs = table(spark, sf_dir, "documents")
    return context_tree_scores(docs.select("doc_id", "text", held.alias("held_out")))
