"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as a hashed word vector and the mean of its hashed character
n-gram vectors. A window of words runs through a GRU in both directions, its
states are pooled by attention, and the pooled state gives the window's logit. A
document is scored by all its overlapping windows: the largest logit and the
number of windows go through a calibration. Training is plain numpy on a bounded
sample of labelled rows; their strongest windows, largest logits and window
counts come from Spark passes over all their windows, and scoring is a Spark pass
over every document.
"""

import zlib
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabia.llm.common import stored, table, whole

WINDOW, STRIDE = 32, 16
WORD_BINS, CHAR_BINS = 1 << 12, 1 << 13
WORD_DIM, CHAR_DIM, HIDDEN = 8, 12, 8
GRAMS = (3, 4, 5)
#: Labelled documents of each class, and evenly spread windows of each that training starts with; later
#: steps take the strongest of all windows.
TRAIN_DOCUMENTS, TRAIN_WINDOWS = 1500, 64
FOLDS = 5
BATCH = 192
#: Passes with every window carrying its document's label, then passes over each document's strongest windows.
NOISY_STEPS, STRONG_ROUNDS, STRONG_STEPS = 150, 4, 60
#: Strongest windows taken of a toxic and of a clean document; files the sample is dealt into.
STRONGEST = {1: 1, 0: 4}
SAMPLE_FILES = 24
RATE = 0.01
#: Decay of the word and character vectors, and the share of word vectors that a training step hides.
DECAY, HIDDEN_WORDS = 0.05, 0.5
SEED = 5
CHUNK_WORDS = 400_000
LANES = 2048
#: Longer words are cut into runs of so many characters, which overlap by the longest n-gram less one.
RUN, OVERLAP = 32, GRAMS[-1] - 1
EDGE = ".,;:!?\"'()[]{}|*#$%&<>-_"


def words_of(text: str) -> list[str]:
    """Words without white space of any script, in lower case, edges cleared of punctuation; pure punctuation stays.

    A long word becomes overlapping runs, so that every character n-gram of it is
    in one of them: a text may have no blanks at all.
    """
    out = []
    for w in text.lower().split():
        w = w.strip(EDGE) or w
        if len(w) <= RUN:
            out.append(w)
        else:
            out += [w[at : at + RUN] for at in range(0, len(w) - OVERLAP, RUN - OVERLAP)]
    return out


def features(vocabulary: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bins, and character n-gram bins with the start of each word's run."""
    bins = np.empty(len(vocabulary), np.int64)
    grams, starts = [], np.empty(len(vocabulary), np.int64)
    for k, w in enumerate(vocabulary):
        w = w.encode("utf-8", "surrogatepass")
        bins[k] = zlib.crc32(w) % WORD_BINS
        starts[k] = len(grams)
        edged = b"^" + w + b"$"
        for n in GRAMS:
            grams += [edged[i : i + n] for i in range(max(1, len(edged) - n + 1))]
    codes = np.fromiter((zlib.crc32(g) % CHAR_BINS for g in grams), np.int64, len(grams))
    return bins, codes, starts


def window_starts(n: int) -> list[int]:
    """Overlapping windows that cover all words, the last one ending with the text."""
    if n <= WINDOW:
        return [0]
    return [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def initial(rng) -> dict:
    width = WORD_DIM + CHAR_DIM

    def small(*shape, scale=0.1):
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    net = {
        "word": small(WORD_BINS, WORD_DIM),
        "char": small(CHAR_BINS, CHAR_DIM),
        "pool": small(2 * HIDDEN),
        "out": small(2 * HIDDEN, scale=0.5),
        "bias": np.zeros(1, np.float32),
    }
    for way in "fb":
        net["in" + way] = small(width, 3 * HIDDEN, scale=0.4)
        net["re" + way] = small(HIDDEN, 3 * HIDDEN, scale=0.3)
        net["at" + way] = np.zeros(3 * HIDDEN, np.float32)
    return net


def inputs(net, bins, grams, starts) -> np.ndarray:
    sizes = np.diff(np.r_[starts, len(grams)])
    chars = np.add.reduceat(net["char"][grams], starts, axis=0) / sizes[:, None]
    return np.concatenate([net["word"][bins], chars], 1).astype(np.float32)


def run(net, way, fed, mask):
    """States (time, lane, hidden) of one direction; fed is (time, lane, 3 hidden), mask (time, lane) or None."""
    h = np.zeros((fed.shape[1], HIDDEN), np.float32)
    states, gates = np.empty((*fed.shape[:2], HIDDEN), np.float32), []
    order = range(len(fed)) if way == "f" else range(len(fed) - 1, -1, -1)
    weights = net["re" + way]
    for t in order:
        again = h @ weights
        zr = sigmoid(fed[t, :, : 2 * HIDDEN] + again[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        new = np.tanh(fed[t, :, 2 * HIDDEN :] + r * again[:, 2 * HIDDEN :])
        after = new + z * (h - new)
        if mask is not None:
            after = np.where(mask[t][:, None], after, h)
        gates.append((t, h, z, r, new, again[:, 2 * HIDDEN :]))
        h = after
        states[t] = h
    return states, gates


def forward(net, fed, mask):
    """Logits of the windows, with what the backward pass needs."""
    parts = {way: run(net, way, fed[way], mask) for way in "fb"}
    both = np.concatenate([parts["f"][0], parts["b"][0]], -1)
    energy = both @ net["pool"]
    if mask is not None:
        energy = np.where(mask, energy, -1e9)
    share = np.exp(energy - energy.max(0))
    share /= share.sum(0)
    pooled = np.einsum("tl,tlh->lh", share, both)
    return pooled @ net["out"] + net["bias"][0], (parts, both, share, pooled)


def logits(net, projected, codes, lengths) -> np.ndarray:
    """Logits of windows given as word codes (lane, WINDOW)."""
    out = np.empty(len(codes), np.float32)
    for low in range(0, len(codes), LANES):
        part = codes[low : low + LANES].T
        size = lengths[low : low + LANES]
        mask = None if size.min() == WINDOW else np.arange(WINDOW)[:, None] < size[None, :]
        fed = {way: projected[way][part] for way in "fb"}
        out[low : low + LANES] = forward(net, fed, mask)[0]
    return out


def project(net, x) -> dict:
    return {way: x @ net["in" + way] + net["at" + way] for way in "fb"}


def gradients(net, vocabulary, codes, lengths, labels, shown=None) -> dict:
    """Gradient of the mean log loss over a batch of windows; ``shown`` scales the word vectors of each bin."""
    bins, grams, starts = vocabulary
    used, inner = np.unique(codes, return_inverse=True)
    inner = inner.reshape(codes.shape).T
    ends = np.r_[starts, len(grams)]
    sizes = ends[used + 1] - ends[used]
    own = np.concatenate([grams[ends[u] : ends[u + 1]] for u in used])
    at = np.cumsum(sizes) - sizes
    x = inputs(net, bins[used], own, at)
    visible = np.ones(len(used), np.float32) if shown is None else shown[bins[used]]
    x[:, :WORD_DIM] *= visible[:, None]
    projected = project(net, x)
    mask = np.arange(WINDOW)[:, None] < lengths[None, :]
    logit, (parts, both, share, pooled) = forward(net, {w: projected[w][inner] for w in "fb"}, mask)
    d_logit = ((sigmoid(logit) - labels) / len(labels)).astype(np.float32)
    grad = {"bias": np.array([d_logit.sum()], np.float32), "out": pooled.T @ d_logit}
    d_pooled = d_logit[:, None] * net["out"]
    d_share = np.einsum("lh,tlh->tl", d_pooled, both)
    d_energy = share * (d_share - (share * d_share).sum(0))
    grad["pool"] = np.einsum("tl,tlh->h", d_energy, both)
    d_both = share[:, :, None] * d_pooled + d_energy[:, :, None] * net["pool"]
    d_x = np.zeros_like(x)
    for k, way in enumerate("fb"):
        d_states = d_both[:, :, k * HIDDEN : (k + 1) * HIDDEN]
        weights = net["re" + way]
        d_weights = np.zeros_like(weights)
        d_fed = np.zeros((*inner.shape, 3 * HIDDEN), np.float32)
        carry = np.zeros((codes.shape[0], HIDDEN), np.float32)
        for t, h, z, r, new, again in reversed(parts[way][1]):
            total = carry + d_states[t]
            live = mask[t][:, None]
            d_after = np.where(live, total, 0)
            d_new = d_after * (1 - z) * (1 - new**2)
            d_z = d_after * (h - new) * z * (1 - z)
            d_r = d_new * again * r * (1 - r)
            d_fed[t] = np.concatenate([d_z, d_r, d_new], 1)
            d_again = np.concatenate([d_z, d_r, d_new * r], 1)
            d_weights += h.T @ d_again
            carry = d_after * z + d_again @ weights.T + np.where(live, 0, total)
        d_projected = np.zeros_like(projected[way])
        add_rows(d_projected, inner.ravel(), d_fed.reshape(-1, 3 * HIDDEN))
        grad["re" + way] = d_weights
        grad["at" + way] = d_projected.sum(0)
        grad["in" + way] = x.T @ d_projected
        d_x += d_projected @ net["in" + way].T
    grad["word"] = np.zeros_like(net["word"])
    add_rows(grad["word"], bins[used], d_x[:, :WORD_DIM] * visible[:, None])
    grad["char"] = np.zeros_like(net["char"])
    add_rows(grad["char"], own, np.repeat(d_x[:, WORD_DIM:] / sizes[:, None], sizes, axis=0))
    return grad


def add_rows(out: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    for k in range(rows.shape[1]):
        out[:, k] += np.bincount(at, rows[:, k], len(out))


class Adam:
    def __init__(self, net):
        self.net, self.step = net, 0
        self.mean = {k: np.zeros_like(v) for k, v in net.items()}
        self.square = {k: np.zeros_like(v) for k, v in net.items()}

    def update(self, grad):
        self.step += 1
        rate = RATE * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for k, g in grad.items():
            self.mean[k] += 0.1 * (g - self.mean[k])
            self.square[k] += 0.001 * (g * g - self.square[k])
            if k in ("word", "char"):
                self.net[k] *= 1 - RATE * DECAY
            self.net[k] -= (rate * self.mean[k] / (np.sqrt(self.square[k]) + 1e-8)).astype(np.float32)


def calibrated(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    x = np.c_[x, np.ones(len(x))]
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hess = x.T @ (x * (p * (1 - p))[:, None]) + 1e-2 * np.eye(x.shape[1])
        step = np.linalg.solve(hess, x.T @ (p - y) + 1e-2 * beta)
        beta -= np.clip(step, -2, 2)
    return beta


def train(rows: Iterable[tuple[int, list[list[str]]]], strongest: Callable, seed: int = SEED):
    """The network and its calibration from (label, windows) of documents.

    The rows are read once and kept as word codes. ``strongest`` gives for a
    network (label, number of windows, largest logit, strongest windows) of each
    document, from all its windows. Without both classes there is nothing to
    learn: every score is then 0.
    """
    names: dict = {}
    vocabulary = features([])
    rng = np.random.default_rng(seed)

    def coded(found):
        """Labels, word codes and lengths of windows; the vocabulary grows by their words."""
        nonlocal vocabulary
        labels, codes, lengths, known = [], [], [], len(names)
        for label, windows in found:
            for w in windows:
                line = np.zeros(WINDOW, np.int32)
                line[: len(w)] = [names.setdefault(x, len(names)) for x in w]
                labels.append(label)
                codes.append(line)
                lengths.append(len(w))
        bins, grams, starts = features(list(names)[known:])
        old = vocabulary
        vocabulary = tuple(np.concatenate(x) for x in zip(old, (bins, grams, starts + len(old[1]))))
        return np.array(labels, np.float32), np.array(codes), np.array(lengths)

    pool = coded(rows)
    if len(set(pool[0].tolist())) < 2:
        return None
    net = initial(rng)
    adam = Adam(net)

    def steps(pool, n):
        labels, codes, lengths = pool
        sides = [np.flatnonzero(labels == y) for y in (0, 1)]
        for _ in range(n):
            pick = np.concatenate([rng.choice(s, BATCH // 2) for s in sides])
            shown = (rng.random(WORD_BINS) >= HIDDEN_WORDS).astype(np.float32) / (1 - HIDDEN_WORDS)
            adam.update(gradients(net, vocabulary, codes[pick], lengths[pick], labels[pick], shown))

    steps(pool, NOISY_STEPS)
    for _ in range(STRONG_ROUNDS):
        pool = coded((label, windows) for label, _, _, windows in strongest(net))
        steps(pool, STRONG_STEPS)
    facts = np.array([x[:3] for x in strongest(net)])
    return net, calibrated(np.c_[facts[:, 2], np.log(facts[:, 1])], facts[:, 0])


def training_windows(batches):
    """The windows of each text, a bounded number; a window's words are joined by blanks, which no word holds."""
    for batch in batches:
        out = []
        for text in batch.column("text").to_pylist():
            found = words_of(text)
            starts = window_starts(len(found)) if found else []
            if len(starts) > TRAIN_WINDOWS:
                starts = [starts[i] for i in np.linspace(0, len(starts) - 1, TRAIN_WINDOWS).astype(int)]
            out.append([" ".join(found[s : s + WINDOW]) for s in starts])
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("toxic", "turn", "doc_id", "row")), pa.array(out, pa.list_(pa.string()))],
            names=["toxic", "turn", "doc_id", "row", "windows"],
        )


STRONG = "toxic int, turn long, doc_id long, row long, n int, logit double, windows array<string>"


def strongest_windows(batches, net):
    """Number of windows, largest logit and strongest windows of each text with words, from all its windows."""
    for batch in batches:
        at, out = [], []
        toxic = batch.column("toxic").to_pylist()
        for k, text in enumerate(batch.column("text").to_pylist()):
            found = words_of(text)
            if not found:
                continue
            own = window_logits([found], net)[0]
            top = np.argsort(-own, kind="stable")[: STRONGEST[toxic[k]]]
            starts = window_starts(len(found))
            windows = [" ".join(found[starts[i] : starts[i] + WINDOW]) for i in top]
            at.append(k)
            out.append((len(own), float(own[top[0]]), windows))
        part = batch.take(pa.array(at, pa.int64()))
        n, logit, windows = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [
                *(part.column(c) for c in ("toxic", "turn", "doc_id", "row")),
                pa.array(n, pa.int32()),
                pa.array(logit, pa.float64()),
                pa.array(windows, pa.list_(pa.string())),
            ],
            names=["toxic", "turn", "doc_id", "row", "n", "logit", "windows"],
        )


def held_out(doc_id="doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % FOLDS == 0


def fit(docs: DataFrame, labels: DataFrame, documents: int = TRAIN_DOCUMENTS):
    """Trains on at most ``documents`` labelled rows of each class, the first by a hash of doc_id."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    usable = usable.groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    picked = None
    for y in (0, 1):
        part = usable.where(F.col("toxic") == y).orderBy(F.xxhash64("label_id"), "label_id").limit(documents)
        picked = part if picked is None else picked.unionByName(part)
    sample = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text"))
        .join(F.broadcast(picked), F.col("doc_id") == F.col("label_id"))
        .select("toxic", F.xxhash64("doc_id").alias("turn"), "doc_id", "text", F.xxhash64("text").alias("row"))
    )
    # repeated rows can make the sample larger than the number of labels
    first = sample.select("turn", "doc_id", "row").distinct().orderBy("turn", "doc_id", "row").limit(2 * documents)
    sample = stored(
        sample.join(F.broadcast(first), ["turn", "doc_id", "row"], "left_semi")
        .dropDuplicates(["turn", "doc_id", "row"])
        .repartition(SAMPLE_FILES)
    )
    spark = docs.sparkSession

    # windows are bounded, whole texts are not: only windows are sorted and sent to the driver
    def in_order(frame):
        return frame.orderBy("turn", "doc_id", "row").toLocalIterator()

    def strongest(net):
        shared = spark.sparkContext.broadcast({k: v.copy() for k, v in net.items()})
        for r in in_order(sample.mapInArrow(lambda batches: strongest_windows(batches, shared.value), STRONG)):
            yield r["toxic"], r["n"], r["logit"], [w.split(" ") for w in r["windows"]]

    rows = sample.mapInArrow(
        lambda batches: training_windows(batches),
        "toxic int, turn long, doc_id long, row long, windows array<string>",
    )
    return train(((r["toxic"], [w.split(" ") for w in r["windows"]]) for r in in_order(rows)), strongest)


def window_logits(found: list[list[str]], net) -> list[np.ndarray]:
    """The logits of all windows of lists of words, in order; an empty list has none."""
    names: dict = {}
    codes = [np.array([names.setdefault(w, len(names)) for w in f], np.int64) for f in found]
    lines, lengths, counts = [], [], []
    steps = np.arange(WINDOW)
    for own in codes:
        starts = np.array(window_starts(len(own)) if len(own) else [], np.int64)
        counts.append(len(starts))
        if len(own):
            at = starts[:, None] + steps
            lines.append(own[np.minimum(at, len(own) - 1)])
            lengths.append(np.minimum(len(own) - starts, WINDOW))
    if not lines:
        return [np.empty(0, np.float32) for _ in found]
    lines, lengths = np.concatenate(lines), np.concatenate(lengths)
    order = np.argsort(lengths, kind="stable")  # short windows together: only they need a mask
    projected = project(net, inputs(net, *features(list(names))))
    out = np.empty(len(lines), np.float32)
    out[order] = logits(net, projected, lines[order], lengths[order])
    return np.split(out, np.cumsum(counts)[:-1])


def scores(texts: list[str], model) -> np.ndarray:
    net, beta = model
    found = window_logits([words_of(x) for x in texts], net)
    out = np.array([x.max() if len(x) else -np.inf for x in found], np.float64)
    count = np.array([max(len(x), 1) for x in found])
    z = np.where(np.isfinite(out), beta[0] * np.where(np.isfinite(out), out, 0) + beta[1] * np.log(count) + beta[2], -30)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score_batches(batches, model):
    for batch in batches:
        text = batch.column("text").to_pylist()
        out, low, size = [], 0, 0
        for k, x in enumerate(text):
            size += len(x) // 6 + 1
            if size >= CHUNK_WORDS or k == len(text) - 1:
                out.append(scores(text[low : k + 1], model) if model else np.zeros(k + 1 - low))
                low, size = k + 1, 0
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(np.concatenate([np.zeros(0), *out]))], names=["doc_id", "score"]
        )


def toxicity(docs: DataFrame, model) -> DataFrame:
    """doc_id and score for each row, from its text alone.

    A null or empty text has no window and gets the smallest score. Equal texts
    get equal scores up to float rounding; every window of a long text counts.
    Extra columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole("text").alias("text"))
    return rows.mapInArrow(lambda batches: score_batches(batches, shared.value), "doc_id long, score double")


def op7_gru_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
