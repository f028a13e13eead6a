"""Encoding into vocabulary pieces by N-best segmentation, and decoding.

A text is a lattice whose edges are the vocabulary's pieces (and byte pieces for
characters without one), weighted by the scores of the model file. A forward
Viterbi pass gives the best score up to each position; these scores are exact
heuristics for an A* search that runs backward from the end, which yields
segmentations in falling order of score.

No piece crosses from a non-blank to a blank, so the lattice of a text is a chain
of chunk lattices. The forward pass runs over all distinct chunks of a batch at
once; the best path needs no queue, and the N best of a text deviate in its N-1
chunks with the smallest loss, which are the only ones searched with a queue.
"""

import heapq
import math
import re
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabia.llm.common import slices, table, whole

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BEST = 3
BLANK = "▁"
#: Chunks up to this length go through the vectorised pass.
SHORT = 32
LAST_RESORT = -1e8
SLICE = 8 << 20
#: Characters of the texts whose ids leave in one batch; a text has about ten times as many bytes of ids.
OUT = 1 << 20
#: Chunks of one length that are cut at once, which bounds the arrays of the vectorised pass.
GROUP = 1 << 13
#: Bits of a hash by which most runs of characters that are no piece are told without a search.
MARK_BITS = 17
_BASE = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Pieces with scores, as plain tables; ``load`` reads a model file, once and on the driver."""

    def __init__(self, pieces: list, byte_ids: list):
        #: pieces: (id, text, score) of the ordinary ones; byte_ids: the id of each byte
        self.byte_ids = byte_ids
        ordinary = min(score for *_, score in pieces if score > LAST_RESORT)
        # runs of blanks carry a score that stands for "last"; so do bytes, which have none
        self.byte_score = ordinary - 10.0
        self.score = {text: max(score, self.byte_score) for _, text, score in pieces}
        self.ids = {text: i for i, text, _ in pieces}
        self.longest = max(map(len, self.score))
        self.raw = {i: text.replace(BLANK, " ").encode() for i, text, _ in pieces}
        self.raw.update((i, bytes([b])) for b, i in enumerate(byte_ids))
        if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.score):
            raise ValueError("a piece crosses a word's start")
        line = "" if any("\n" in p for p in self.score) else "\n"
        self.chunk = re.compile(f"{BLANK}+[^{BLANK}{line}]*|[^{BLANK}{line}]+" + ("|\n" if line else ""))
        self.by_length, self.marks = {}, {}
        for length in range(1, self.longest + 1):
            own = [(t, s) for t, s in self.score.items() if len(t) == length]
            if own:
                codes = np.array([[ord(c) for c in t] for t, _ in own], np.uint64)
                h = hashes(codes)[:, -1]
                order = np.argsort(h)
                self.by_length[length] = (
                    h[order],
                    np.array([s for _, s in own])[order],
                    np.array([self.ids[t] for t, _ in own])[order],
                )
                self.marks[length] = np.zeros(1 << MARK_BITS, bool)
                self.marks[length][marked(h)] = True

    def edge(self, text: str) -> float | None:
        """Score of a piece, or of a single character spelled in bytes."""
        found = self.score.get(text)
        if found is None and len(text) == 1:
            return self.byte_score * len(plain(text).encode())
        return found

    def spelled(self, text: str) -> list[int]:
        found = self.ids.get(text)
        return [found] if found is not None else [self.byte_ids[b] for b in plain(text).encode()]


#: A blank sign of the text itself is a lone surrogate inside the lattice, which no text holds: it is spelled in bytes.
MARK = "\ud800"


def plain(text: str) -> str:
    return text.replace(MARK, BLANK)


def load(path: str = MODEL) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = range(model.get_piece_size())
    special = {i for i in size if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)}
    byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    if not all(model.is_byte(i) for i in byte_ids):
        raise ValueError("the model has no byte pieces, so not every text can be decoded")
    return Vocabulary([(i, model.id_to_piece(i), model.get_score(i)) for i in size if i not in special], byte_ids)


def hashes(codes: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes of rows of code points; column 0 is the empty prefix."""
    out = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(codes.shape[1]):
            c = codes[:, k] + np.uint64(1)
            c = (c ^ (c << np.uint64(13))) * np.uint64(0xBF58476D1CE4E5B9)
            out[:, k + 1] = out[:, k] * _BASE + (c ^ (c >> np.uint64(29)))
    return out


def marked(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - MARK_BITS)).astype(np.int64)


def chunks_of(text: str, vocabulary: Vocabulary) -> list[str]:
    """The chunks of a text with its leading blank. An empty text has none."""
    if not text:
        return []
    return vocabulary.chunk.findall(BLANK + text.replace(BLANK, MARK).replace(" ", BLANK))


def forward(chunk: str, vocabulary: Vocabulary) -> list[float]:
    """Best score of the chunk's text up to each position."""
    best = [0.0] + [-math.inf] * len(chunk)
    for end in range(1, len(chunk) + 1):
        for start in range(max(0, end - vocabulary.longest), end):
            score = vocabulary.edge(chunk[start:end])
            if score is not None and best[start] + score > best[end]:
                best[end] = best[start] + score
    return best


def n_best(chunk: str, vocabulary: Vocabulary, n: int = BEST) -> list[tuple[float, list[str]]]:
    """The n best segmentations of a chunk, in falling order: backward A* on exact forward scores.

    Of equal paths the one whose last piece starts first is walked to its end
    first, as the back pointers of ``short_segments`` do. A position is left n
    times at most: its first n paths to the end are its best ones, and each of
    them makes a segmentation with the same best start, so no later one is among
    the n best. The search ends after n * length steps on any text.
    """
    best = forward(chunk, vocabulary)
    queue = [(-best[-1], len(chunk), 0, 0.0, None)]
    left = [0] * (len(chunk) + 1)
    out, turn = [], 0
    while queue and len(out) < n:
        _, end, _, after, path = heapq.heappop(queue)
        if left[end] == n:
            continue
        left[end] += 1
        if end == 0:
            pieces = []
            while path is not None:
                pieces.append(path[0])
                path = path[1]
            out.append((after, pieces))
            continue
        for start in range(max(0, end - vocabulary.longest), end):
            piece = chunk[start:end]
            score = vocabulary.edge(piece) if left[start] < n else None
            if score is not None:
                turn -= 1
                total = after + score
                heapq.heappush(queue, (-(best[start] + total), start, turn, total, (piece, path)))
    return out


def short_segments(chunks: list[str], vocabulary: Vocabulary):
    """Best score, loss of the second best, and the pieces (chunk, end, start) of chunks of one length."""
    size = len(chunks[0])
    codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, size).astype(np.uint64)
    prefix = hashes(codes).T.copy()
    n = len(chunks)
    # a row for each position, so that a step reads whole rows
    best = np.full((size + 1, n), -np.inf)
    best[0] = 0
    gap = np.full((size + 1, n), np.inf)
    back = np.zeros((size + 1, n), np.int64)
    ids = np.full((size + 1, n), -1, np.int64)
    power = np.uint64(1)
    powers = []
    with np.errstate(over="ignore"):
        for _ in range(size + 1):
            powers.append(power)
            power = power * _BASE
    rows = np.arange(n)
    for end in range(1, size + 1):
        top = np.full(n, -np.inf)
        second = np.full(n, -np.inf)
        for start in range(max(0, end - vocabulary.longest), end):
            length = end - start
            # the chunks with an edge here, its score and its piece
            at, score, own = rows[:0], np.zeros(0), rows[:0]
            if length in vocabulary.by_length:
                names, scores, piece_ids = vocabulary.by_length[length]
                with np.errstate(over="ignore"):
                    h = prefix[end] - prefix[start] * powers[length]
                at = np.flatnonzero(vocabulary.marks[length][marked(h)])
                place = np.minimum(np.searchsorted(names, h[at]), len(names) - 1)
                hit = names[place] == h[at]
                at, place = at[hit], place[hit]
                score, own = scores[place], piece_ids[place]
            if length == 1 and len(at) < n:
                spelled = np.ones(n, bool)
                spelled[at] = False
                c = codes[spelled, start]
                width = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
                at = np.r_[at, rows[spelled]]
                score = np.r_[score, vocabulary.byte_score * width]
                own = np.r_[own, np.full(len(c), -1)]
            total = best[start][at] + score
            held = top[at]
            better = total > held
            second[at] = np.where(better, held, np.maximum(second[at], total))
            top[at] = np.where(better, total, held)
            back[end][at[better]] = start
            ids[end][at[better]] = own[better]
        best[end] = top
        gap[end] = top - second
    loss = np.full(n, np.inf)
    ends = np.full(n, size)
    found = []
    live = rows
    while len(live):
        end = ends[live]
        loss[live] = np.minimum(loss[live], gap[end, live])
        start = back[end, live]
        found.append((live, end, start, ids[end, live]))
        ends[live] = start
        live = live[start > 0]
    return best[size], loss, tuple(np.concatenate(x) for x in zip(*found))


def segmented(chunks: list[str], vocabulary: Vocabulary):
    """For distinct chunks: score, loss of the second best, and the ids of the best pieces as (flat, offsets)."""
    score, loss = np.zeros(len(chunks)), np.zeros(len(chunks))
    by_size: dict = {}
    for k, chunk in enumerate(chunks):
        by_size.setdefault(len(chunk) if len(chunk) <= SHORT else 0, []).append(k)
    parts = []
    runs = ((size, own[low : low + GROUP]) for size, own in by_size.items() for low in range(0, len(own), GROUP))
    for size, members in runs:
        at = np.array(members)
        if size:
            score[at], loss[at], (row, end, start, ids) = short_segments([chunks[k] for k in members], vocabulary)
            owner = at[row]
            spelled = np.flatnonzero(ids < 0)
            plain_rows = ids >= 0
            parts.append((owner[plain_rows], start[plain_rows] * 4, ids[plain_rows]))
            for k in spelled.tolist():
                raw = vocabulary.spelled(chunks[owner[k]][start[k] : end[k]])
                parts.append((np.full(len(raw), owner[k]), start[k] * 4 + np.arange(len(raw)), np.array(raw)))
        else:
            for k in members:
                found = n_best(chunks[k], vocabulary, 2)
                score[k] = found[0][0]
                loss[k] = found[0][0] - found[1][0] if len(found) > 1 else math.inf
                raw = [i for piece in found[0][1] for i in vocabulary.spelled(piece)]
                parts.append((np.full(len(raw), k), np.arange(len(raw)), np.array(raw)))
    owner, place, ids = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((place, owner))
    counts = np.bincount(owner, minlength=len(chunks))
    return score, loss, ids[order], np.r_[0, np.cumsum(counts)]


def best_paths(codes: np.ndarray, chunks, score, loss, flat, offsets, vocabulary, n: int, memo: dict) -> list:
    """The n best segmentations of a text from those of its chunks: score, and (place, ids) of chunks not cut the best way."""
    total = float(score[codes].sum())
    if n == 1 or not len(codes):
        return [(total, ())]
    found = [(0.0, ())]
    for place in np.argsort(loss[codes], kind="stable")[: n - 1].tolist():
        k = int(codes[place])
        if k not in memo:
            first = flat[offsets[k] : offsets[k + 1]].tolist()
            paths = [
                (s, [i for piece in pieces for i in vocabulary.spelled(piece)])
                for s, pieces in n_best(chunks[k], vocabulary, n)
            ]
            others = [(s - paths[0][0], ids) for s, ids in paths if ids != first]  # of equal scores, any can be first
            memo[k] = [(0.0, None), *others[: n - 1]]
        sums = [(a + s, e if ids is None else (*e, (place, ids))) for a, e in found for s, ids in memo[k]]
        found = sorted(sums, key=lambda x: -x[0])[:n]
    return [(total + s, e) for s, e in found]


def replaced(own: np.ndarray, ends: np.ndarray, edits) -> np.ndarray:
    """The ids of a text with those of some chunks replaced; ``ends`` are the chunks' ends in ``own``."""
    parts, low = [], 0
    for place, ids in sorted(edits):
        parts += [own[low : ends[place - 1] if place else 0], np.array(ids, np.int32)]
        low = ends[place]
    return np.concatenate([*parts, own[low:]])


def listed(parts: list, kind) -> pa.ListArray:
    """Arrays as an Arrow list array."""
    ends = np.cumsum([0, *map(len, parts)])
    flat = np.concatenate([np.empty(0, np.int32), *parts])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, kind))


def cut(texts: list[str], vocabulary: Vocabulary) -> tuple[list, tuple]:
    """The numbers of each text's chunks, and the distinct chunks with what ``segmented`` tells of them."""
    names: dict = defaultdict(count().__next__)
    lines = [np.array(list(map(names.__getitem__, chunks_of(x, vocabulary))), np.int32) for x in texts]
    chunks = list(names)
    del names
    if not chunks:
        return lines, (chunks, np.zeros(0), np.zeros(0), np.zeros(0, np.int32), np.zeros(1, np.int64))
    return lines, (chunks, *segmented(chunks, vocabulary))


def spelled_out(lines: list, found: tuple, vocabulary: Vocabulary, n: int, memo: dict):
    """Best ids as an Arrow list array, for each text its n best scores, and the ids of these n as nested lists."""
    chunks, score, loss, flat, offsets = found
    best, scores, every = [], [], []
    pieces = np.diff(offsets)
    for codes in lines:
        sizes = pieces[codes]
        ends = np.cumsum(sizes)
        at = np.repeat(offsets[codes] - (ends - sizes), sizes) + np.arange(sizes.sum())
        own = flat[at].astype(np.int32)
        paths = best_paths(codes, chunks, score, loss, flat, offsets, vocabulary, n, memo)
        best.append(own)
        scores.append([s for s, _ in paths])
        every += [replaced(own, ends, edits) for _, edits in paths]
    cuts = np.cumsum([0, *map(len, scores)])
    nested = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), listed(every, pa.int32()))
    return listed(best, pa.int32()), scores, nested


def encoded(texts: list[str], vocabulary: Vocabulary, n: int = BEST):
    """``spelled_out`` for texts."""
    lines, found = cut(texts, vocabulary)
    return spelled_out(lines, found, vocabulary, n, {})


def id_lists(ids: pa.ListArray):
    """The lists of an Arrow array, by way of numpy; a null list counts as empty."""
    flat, ends = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
    for low, high in zip(ends[:-1].tolist(), ends[1:].tolist()):
        yield flat[low:high].tolist()


def decoded(ids: list[int], raw: dict) -> str:
    """The text of a list of ids; the leading blank that encoding adds is dropped."""
    return b"".join(map(raw.__getitem__, ids))[1:].decode()


ENCODED = "doc_id long, ids array<int>, scores array<double>, exact boolean, segmentations array<array<int>>"


def encode_batches(batches, vocabulary: Vocabulary, n: int, slice_chars: int = SLICE):
    """The chunks of a slice are cut together; its rows leave in smaller batches, as their ids are many times the text."""
    for batch in batches:
        for part in slices(batch, "text", slice_chars):
            lines, found = cut(part.column("text").to_pylist(), vocabulary)
            memo: dict = {}
            done = 0
            for rows in slices(part, "text", OUT):
                ids, scores, every = spelled_out(lines[done : done + len(rows)], found, vocabulary, n, memo)
                done += len(rows)
                texts = rows.column("text").to_pylist()
                exact = [decoded(own, vocabulary.raw) == x for own, x in zip(id_lists(ids), texts)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), ids, pa.array(scores, pa.list_(pa.float64())), pa.array(exact), every],
                    names=["doc_id", "ids", "scores", "exact", "segmentations"],
                )


def encode(docs: DataFrame, path: str = MODEL, n: int = BEST, slice_chars: int = SLICE) -> DataFrame:
    """doc_id, ids of the best segmentation, the n best scores in falling order, whether decoding gives the text,
    and the ids of all n segmentations.

    A null text counts as empty and has no ids and the score 0. Fewer than n
    scores mean that the lattice has no more paths. Repeated rows are encoded
    each. Extra columns are not read. The vocabulary (its size is that of the
    model file) is read on the driver and sent to the executors. Texts of about
    ``slice_chars`` characters are cut together: fewer need less memory and more time.
    """
    vocabulary = load(path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text"))
    return rows.mapInArrow(lambda batches: encode_batches(batches, vocabulary, n, slice_chars), ENCODED)


def decode(pieces: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and text of rows with ``ids``; null ids give a null text."""
    raw = load(path).raw

    def texts(batches):
        for batch in batches:
            ids = batch.column("ids")
            found = [decoded(own, raw) if there else None for own, there in zip(id_lists(ids), ids.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.string())], names=["doc_id", "text"]
            )

    return pieces.select("doc_id", "ids").mapInArrow(texts, "doc_id long, text string")


def op3_nbest_pieces(spark, sf_dir):
    found = encode(table(spark, sf_dir, "documents"))

    def digest(ids):
        return F.sha2(F.concat_ws(" ", ids.cast("array<string>")).cast("binary"), 256)

    # one expression a segmentation, not a function over the list: the cast is then compiled
    every = [F.when(F.size("segmentations") > k, digest(F.get("segmentations", F.lit(k)))) for k in range(BEST)]
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.get("scores", F.lit(0)).alias("score"),
        "scores",
        # the first segmentation is the best, whose ids are ``ids``
        every[0].alias("ids_sha256"),
        "exact",
        F.array_compact(F.array(*every)).alias("segmentations_sha256"),
    )
