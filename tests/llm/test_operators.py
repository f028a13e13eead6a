"""The operators against brute force on small tables, and on odd rows: nulls, empty and long texts, repeats, clashes."""

import collections
import hashlib
import itertools
import math
import time
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabia.llm import (
    chosen_path,
    components,
    context_tree,
    feistel_shards,
    gru_toxicity,
    html_extract,
    importance_rules,
    latent_retrieval,
    line_runs,
    nbest_pieces,
    token_counts,
)

SCHEMA = "doc_id long, text string, label string, `row` string, h string, n_words long, shard int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(WORDS, n) + np.array([str(k % 7) for k in range(n)]))


def odd_rows():
    base = prose(1, 80)
    texts = [
        (1, base),
        (2, base),
        (2, base),
        (3, None),
        (4, ""),
        (5, " \t\n\n  "),
        (6, base + " one more\nSame long line here\nSame long line here"),
        (7, "same LONG line here \nother\x0b words"),
        (8, prose(2, 6000)),
        (None, prose(3, 60)),
        (None, None),
        (9, "one"),
        (10, "naïve 日本語 ▁ \U0001f600 ퟿ x" + "y" * 300),
    ]
    return [(i, t, "x", "y", "z", 7, 9) for i, t in texts]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_shards_are_a_permutation(odd, empty):
    got = feistel_shards.shard_rows(odd, 4).collect()
    assert len(got) == len(odd_rows())
    assert sorted(r["number"] for r in got) == list(range(len(got)))
    by = collections.defaultdict(list)
    for r in got:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = {(r["row"], r["number"], r["shard"]) for r in feistel_shards.shard_rows(odd.repartition(5), 4).collect()}
    assert again == {(r["row"], r["number"], r["shard"]) for r in got}
    assert feistel_shards.shard_rows(empty).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 40, 997])
def test_feistel_is_a_bijection(spark, n):
    rows = spark.range(n).select(feistel_shards.permuted(F.col("id"), F.lit(n).cast("long")).alias("p"))
    assert sorted(r["p"] for r in rows.collect()) == list(range(n))


def quality_counts(text):
    words = (text or "").encode().split()
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, c in collections.Counter(windows).items() if c > 1}
    covered = {k for i, w in enumerate(windows) if w in often for k in (i, i + 1, i + 2)}
    return (
        len(words),
        sum(len(w.decode()) for w in words),
        sum((text or "").count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_quality_counts_and_verdicts(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (8, 1, 0)], "doc_id long, quality int, toxic int")
    ratio = importance_rules.fit_ratio(odd, labels, 64)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rows = importance_rules.judged(odd, ratio).collect()
    assert len(rows) == len(odd_rows())
    for r in rows:
        want = quality_counts(r["row"]["text"])
        assert tuple(r[n] for n in names) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["kept"] and r["base_failed"])
    assert importance_rules.quality_filtered(odd, labels).columns == odd.columns
    assert importance_rules.quality_filtered(empty, labels).count() == 0
    assert importance_rules.fit_ratio(empty, labels, 8) == [0.0] * 8


def test_quality_ratio_is_the_counted_one(spark):
    rows = [(1, "a b a"), (2, "c %% c"), (3, "a c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    bins = 16
    grams = docs.select("doc_id", importance_rules.n_grams(F.col("text")).alias("t")).select(
        "doc_id", importance_rules.binned("t", bins).alias("g")
    )
    by = {r["doc_id"]: r["g"] for r in grams.collect()}
    raw = collections.Counter(itertools.chain(*by.values()))
    good = collections.Counter(by[1])
    ratio = importance_rules.fit_ratio(docs, labels, bins)
    for b in range(bins):
        want = math.log((good[b] + 1) / (sum(good.values()) + bins)) - math.log((raw[b] + 1) / (sum(raw.values()) + bins))
        assert ratio[b] == pytest.approx(want)
    for r in importance_rules.judged(docs, ratio).collect():
        own = by[r["row"]["doc_id"]]
        assert r["mean_ratio"] == pytest.approx(sum(ratio[b] for b in own) / len(own))


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (6, 3)])
def test_line_runs_equal_sql(spark, odd, batches, fanout):
    rows = line_runs.line_deduplicated(odd.where("doc_id is not null").distinct(), batches, fanout)
    got = {r["row"]["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_text"]) for r in rows.collect()}
    documents = pd.DataFrame([r[:2] for r in dict.fromkeys(odd_rows()) if r[0] is not None], columns=["doc_id", "text"])
    con = duckdb.connect()
    con.register("documents", documents)
    for doc_id, lines, dropped, sha in con.execute(line_runs.ORACLE_OP10).df().values.tolist():
        assert got[doc_id][:2] == (lines, dropped)
        assert hashlib.sha256(got[doc_id][2].encode()).hexdigest() == sha


def test_line_runs_keep_columns_and_odd_rows(odd, empty):
    out = line_runs.with_lines_removed(odd)
    assert out.columns == odd.columns
    got = collections.Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert got[(3, None)] == 1 and got[(2, "")] == 2 and got[(4, "")] == 1
    assert got[(None, odd_rows()[9][1])] == 1
    assert line_runs.with_lines_removed(empty).count() == 0


def test_runs_are_compacted(spark):
    runs = line_runs.LineRuns(2)
    for k in range(7):
        runs.add(spark.createDataFrame([(k, bytes([k])), (k, b"common")], "doc_id long, h binary"))
    assert len(runs.runs()) == 3
    index = {bytes(r["h"]): r["first"] for r in runs.index().collect()}
    assert index == {b"common": 0, **{bytes([k]): k for k in range(7)}}


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 200), (300, 200), (7, 7)]
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {**{k: 0 for k in range(41)}, 100: 100, 200: 100, 300: 100}
    assert {r["node"]: r["label"] for r in got} == want


@pytest.mark.parametrize("bucket,block", [(64, 1024), (2, 3)])
def test_chosen_paths_find_every_link(spark, bucket, block):
    rng = np.random.default_rng(4)
    texts = []
    for group in range(6):
        base = prose(10 + group, 120).split()
        for _ in range(5):
            own = list(base)
            for at in rng.integers(0, len(own), rng.integers(0, 4)):
                own[at] = f"changed{rng.integers(1000)}"
            texts.append(" ".join(own))
    texts += [texts[0], texts[0], None, "", "one two", "one two", prose(99, 50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None)
    label = list(range(len(texts)))
    links = [set() for _ in texts]
    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
            if sets[i] != sets[j]:
                links[i].add(sets[j])
                links[j].add(sets[i])
            low, high = sorted((label[i], label[j]))
            label = [low if x == high else x for x in label]
    got = chosen_path.near_duplicates(docs, bucket=bucket, block=block).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r["class_id"] == label[r["doc_id"]]
        assert r["n_links"] == len(links[r["doc_id"]])


def test_chosen_paths_on_odd_rows(odd, empty):
    got = {r["doc_id"]: r for r in chosen_path.near_duplicates(odd).collect() if r["doc_id"]}
    assert got[2]["class_id"] == 1 and got[2]["n_copies"] == 3
    assert got[3]["class_id"] == 3 and got[4]["class_id"] == 4
    assert chosen_path.near_duplicates(empty).count() == 0
    kept = chosen_path.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = collections.Counter(r["doc_id"] for r in kept.collect())
    assert ids[1] == 1 and ids[2] == 0 and ids[None] == 2 and ids[3] == 1


def test_rows_without_or_with_a_repeated_id_keep_their_texts(spark):
    near = [prose(k, 60) for k in range(3)]
    rows = [(1, prose(50, 40)), (1, prose(51, 40)), (2, prose(52, 40)), (None, prose(53, 40)), (None, prose(53, 40)),
            (None, None), (None, ""), (7, None), (7, "")] + [(None, t + end) for t in near for end in ("", " x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [(r.doc_id, r.text) for r in chosen_path.one_of_each(docs).collect()]
    texts = [t for _, t in kept if t]
    assert {t for t in texts if t in (prose(k, 40) for k in (50, 51, 52, 53))} == {prose(k, 40) for k in (50, 51, 52, 53)}
    assert len(texts) == 4 + len(near)  # one of each near pair, one of the two copies
    assert sum(i is None and not t for i, t in kept) == 2 and sum(i == 7 for i, _ in kept) == 1
    many = spark.createDataFrame([(None, prose(k // 2, 60) + " x" * (k % 2)) for k in range(100)], "doc_id long, text string")
    got = chosen_path.near_duplicates(many).collect()
    assert len(got) == 100 and all(r.class_id is None and r.n_links == 1 and r.n_copies == 1 for r in got)


@pytest.mark.parametrize("text", ["a" + " " * 160 + "b", "-" * 1007, " " * 10000, "=" * 10000, "a" * 10000, "ab" * 3000])
def test_tied_paths_end(text):
    vocabulary = nbest_pieces.load()
    ids, scores, every = nbest_pieces.encoded([text], vocabulary)
    assert nbest_pieces.decoded(ids[0].as_py(), vocabulary.raw) == text
    assert len(scores[0]) == 3 and sorted(scores[0], reverse=True) == scores[0]
    assert len({tuple(x) for x in every[0].as_py()}) == 3


def test_n_best_with_ties_equals_enumeration():
    """Both ways to segment a chunk, whatever its length, break ties alike."""
    vocabulary = nbest_pieces.load()
    rng = np.random.default_rng(4)
    for k in range(200):
        chunk = "".join(rng.choice(list("a-=t"[: 1 + k % 4]), int(rng.integers(1, 40))))
        lists = [[(0.0, ())]]
        for end in range(1, len(chunk) + 1):
            found = []
            for start in range(max(0, end - vocabulary.longest), end):
                score = vocabulary.edge(chunk[start:end])
                if score is not None:
                    found += [(a + score, p + (chunk[start:end],)) for a, p in lists[start]]
            lists.append(sorted(found, key=lambda x: -x[0])[:3])
        got = nbest_pieces.n_best(chunk, vocabulary, 3)
        assert [s for s, _ in got] == [s for s, _ in lists[-1]]
        assert len({tuple(p) for _, p in got}) == len(got)
        if len(chunk) <= nbest_pieces.SHORT:
            own = nbest_pieces.segmented([chunk], vocabulary)[2].tolist()
            assert own == [i for p in got[0][1] for i in vocabulary.spelled(p)]


def full_tree_bit(counts, context, node):
    """P(bit = 1) by the definition of the weighted mixture, without sharing of any work."""

    def block(zeros, ones):
        return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1) - math.log(math.pi)

    def seen(prefix):
        zeros = ones = 0
        depth, offset = (node + 1).bit_length() - 1, node + 1
        for (c, symbol), n in counts.items():
            if c[: len(prefix)] == prefix and (symbol | 32) >> (5 - depth) == offset:
                if symbol >> (4 - depth) & 1:
                    ones += n
                else:
                    zeros += n
        return zeros, ones

    def weighted(prefix):
        own = block(*seen(prefix))
        if len(prefix) == context_tree.DEPTH:
            return own
        below = {c[len(prefix)] for c, _ in counts if c[: len(prefix)] == prefix}
        return np.logaddexp(own, sum(weighted(prefix + (x,)) for x in below)) - math.log(2)

    def bit(prefix):
        zeros, ones = seen(prefix)
        own = (ones + 0.5) / (zeros + ones + 1)
        if len(prefix) == context_tree.DEPTH:
            return own
        if not any(c[: len(prefix)] == prefix for c, _ in counts):
            return 0.5
        share = math.exp(block(zeros, ones) - math.log(2) - weighted(prefix))
        return share * own + (1 - share) * bit(prefix + (context[len(prefix)],))

    return bit(())


def test_context_tree_scores(spark):
    texts = ["Ab ab  aba", "ab\tab", "abba ab", None, "", "zzz ab", "ab ab"]
    rows = [(k, k in (5, 6), t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, held_out boolean, text string")
    train = [t or "" for k, t in enumerate(texts) if k < 5]
    tokens = collections.Counter(w for t in train for w in [*t.lower().split(), "END"])
    n, v = sum(tokens.values()), len(tokens)
    counts, high = collections.Counter(), collections.Counter()

    def steps(text):
        data = b" " * context_tree.DEPTH + " ".join((text or "").lower().split()).encode() + b"\n"
        for k in range(context_tree.DEPTH, len(data)):
            yield tuple(data[k - d] & 31 for d in range(1, context_tree.DEPTH + 1)), data[k] & 31

    for t in train:
        counts.update(steps(t))
    wide = {r["doc_id"]: r for r in context_tree.context_tree_scores(docs).collect()}
    joined = {r["doc_id"]: r for r in context_tree.context_tree_scores(docs, broadcast_contexts=0).collect()}
    for k, t in enumerate(texts):
        own = [*(t or "").lower().split(), "END"]
        r = wide[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(w in tokens for w in own), n)
        base = sum(math.log10((tokens[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        assert r["base_score"] == pytest.approx(base)
        assert joined[k]["score"] == pytest.approx(r["score"], abs=1e-4)
        low = 0.0
        for context, symbol in steps(t):
            node = 0
            for shift in range(4, -1, -1):
                p = full_tree_bit(counts, context, node)
                one = symbol >> shift & 1
                low += math.log10(p if one else 1 - p)
                node = 2 * node + 1 + one
        # what is left are the high bits, which are almost certain in such texts
        assert low - 1.2 * len(list(steps(t))) < r["score"] <= low + 1e-3


def test_context_tree_without_training_rows(spark):
    docs = spark.createDataFrame([(1, True, "ab")], "doc_id long, held_out boolean, text string")
    r = context_tree.context_tree_scores(docs).first()
    assert r["n_known"] == 0 and r["train_tokens"] == 0
    assert r["base_score"] == pytest.approx(0.0)
    assert r["score"] == pytest.approx(3 * 8 * math.log10(0.5), rel=1e-5)
    assert context_tree.context_tree_scores(docs.where("doc_id = 0")).count() == 0


def test_context_tree_on_odd_rows(odd):
    rows = odd.withColumn("held_out", F.coalesce(F.col("doc_id"), F.lit(0)) % 5 == 0)
    assert context_tree.context_tree_scores(rows).count() == len(odd_rows())


def test_latent_retrieval_finds_leaks(spark, odd, empty):
    items = [(k, prose(200 + k, 30) + ". " + prose(300 + k, 8)) for k in range(12)] + [(50, None), (51, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rng = np.random.default_rng(0)
    docs = []
    for k in range(60):
        filler = prose(1000 + k, 200)
        if k % 5 == 0:
            words = items[k // 5][1].split()
            if k % 10 == 0:  # a paraphrase: some words changed, order kept
                words = [w if rng.random() > 0.12 else "other" for w in words]
            filler = filler + "\n" + " ".join(words).upper() + " " + prose(2000 + k, 100)
        docs.append((k, filler))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in latent_retrieval.contaminated(frame, benchmark).collect()}
    want = {(k, k // 5) for k in range(0, 60, 5)}
    assert got == want
    blocks = {(r["doc_id"], r["item_id"]) for r in latent_retrieval.contaminated(frame, benchmark, item_block=5).collect()}
    assert blocks == want
    assert latent_retrieval.decontaminated(frame, benchmark).count() == 48
    assert latent_retrieval.decontaminated(odd, benchmark).columns == odd.columns
    loose = frame.withColumn("doc_id", F.lit(None).cast("long"))
    assert latent_retrieval.decontaminated(loose, benchmark).count() == 48
    twice = benchmark.unionByName(benchmark)
    assert latent_retrieval.contaminated(frame, twice).count() == len(want)
    assert latent_retrieval.decontaminated(odd, benchmark).count() == len(odd_rows())
    assert latent_retrieval.contaminated(empty, benchmark).count() == 0
    assert latent_retrieval.contaminated(frame, benchmark.where("item_id = 99")).count() == 0


def test_latent_retrieval_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    items = [[f"w{x}" for x in rng.integers(0, 9000, (24, 60, 400)[k % 3])] for k in range(400)]
    texts = []
    for k, item in enumerate(items):
        own = list(item)
        if k % 2:  # a paraphrase that keeps the order and the answer
            for at in rng.choice(len(own) * 3 // 4, int(0.4 * len(own)), replace=False):
                own[at] = f"w{rng.integers(0, 9000)}"
        texts.append([f"w{x}" for x in rng.integers(0, 9000, 70)] + own + [f"w{x}" for x in rng.integers(0, 9000, 90)])
    want = set()
    for k, words in enumerate(texts):
        for i, item in enumerate(items):
            if len(set(item) & set(words)) < 0.3 * len(item):
                continue
            for low in range(0, len(words), latent_retrieval.STRIDE):
                share, answer = latent_retrieval.verified(words, item, low)
                if share >= latent_retrieval.SURE or share >= latent_retrieval.LIKELY and answer >= latent_retrieval.ANSWER:
                    want.add((k, i))
    assert {(k, k) for k in range(400)} <= want
    docs = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(texts)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in latent_retrieval.contaminated(docs, benchmark).collect()}
    assert got == want


def test_latent_cosine_decides(spark, monkeypatch):
    """A space without the directions of the items proposes nothing; the true one proposes every planted place."""
    items = [(k, prose(500 + k, (16, 17, 33, 90)[k % 4])) for k in range(20)]
    docs = [(k, prose(700 + k, 5 * k + 3) + " " + items[k][1] + " " + prose(800 + k, 40)) for k in range(20)]
    docs += [(100, ""), (101, items[0][1] + " " + items[0][1]), (102, items[3][1]), (103, None), (104, "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    want = {(k, k) for k in range(20)} | {(101, 0), (102, 3)}
    rows = latent_retrieval.contaminated(frame, benchmark).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want
    assert all(0.2 <= r["cosine"] <= 1 for r in rows)
    exact = latent_retrieval.latent_space

    def other(passages, n_terms, rank):
        space = exact(passages, n_terms, rank)
        noise = np.random.default_rng(0).standard_normal((n_terms, 8))
        noise -= space @ (space.T @ noise)
        return np.linalg.qr(noise)[0]

    monkeypatch.setattr(latent_retrieval, "latent_space", other)
    found = {(r["doc_id"], r["item_id"]) for r in latent_retrieval.contaminated(frame, benchmark).collect()}
    assert len(found & want) < len(want) / 2


def test_windows_of_the_latent_search_hold_every_place():
    rng = np.random.default_rng(4)
    products = np.vstack([np.eye(40), np.zeros((1, 40))]).astype(np.float32)
    squares = np.r_[np.ones(40), 0].astype(np.float32)
    items = [[i] * n for i, n in enumerate([1, 15, 16, 17, 31, 32, 33, 64, 65, 200])]
    weight = np.sqrt([len(x) for x in items]).astype(np.float32)
    sizes = latent_retrieval.sizes_of(items)
    assert sorted(i for of in sizes.values() for i in of.tolist()) == list(range(10))
    for texts in ([], [[]], [rng.integers(-1, 40, n).tolist() for n in (0, 1, 15, 16, 17, 300, 16500, 3, 40000)]):
        starts, codes = latent_retrieval.side_by_side(texts, max(sizes))
        model = (products, squares, weight, sizes)
        seen = {(i, first): (last, near) for i, first, last, near in latent_retrieval.candidates(codes, model)}
        for size, of in sizes.items():
            for first in range(0, len(codes), size):
                part = codes[first : first + 2 * size]
                norm = np.sqrt((part >= 0).sum())
                for i in of.tolist():
                    spare = (part == i).sum() - latent_retrieval.least_product(max(norm, 1e-4), weight[i])
                    assert abs(spare) < 1e-4 or ((i, first) in seen) == (spare > 0)
                    if (i, first) in seen:
                        last, near = seen[i, first]
                        assert last == first + 2 * size and near == pytest.approx((part == i).sum() / norm, rel=1e-4)


def test_lcs_equals_the_table():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(0, 4, 9).tolist(), rng.integers(0, 4, 12).tolist()
        row = [[0] * 13 for _ in range(10)]
        for i, j in itertools.product(range(9), range(12)):
            row[i + 1][j + 1] = row[i][j] + 1 if a[i] == b[j] else max(row[i][j + 1], row[i + 1][j])
        assert latent_retrieval.lcs(a, b) == row[9][12]


def test_latent_space_is_the_svd(spark):
    dense = np.random.default_rng(2).random((30, 12)) * (np.random.default_rng(3).random((30, 12)) > 0.5)
    rows = [(np.flatnonzero(x).tolist(), [float(v) for v in x[x > 0]]) for x in dense]
    passages = spark.createDataFrame(rows, "at array<int>, value array<float>")
    space = latent_retrieval.latent_space(passages, 12, rank=3)
    _, _, vt = np.linalg.svd(dense)
    assert np.allclose(np.abs(np.sum(space * vt[:3].T, axis=0)), 1, atol=1e-3)


def test_latent_space_is_fitted_on_every_passage(spark, monkeypatch):
    """All words of all documents, also of more than 2000, of long ones and of those without an id."""
    items = [(1, prose(40, 30)), (2, prose(41, 90))]
    texts = [prose(100 + k, 3 + k % 70) for k in range(2100)] + [prose(98, 64), prose(99, 900), "x y", "", None]
    docs = [(k if k % 3 else None, t) for k, t in enumerate(texts)]
    seen, fit = [], latent_retrieval.latent_space

    def spy(passages, n_terms, rank):
        seen.extend(passages.collect())
        return fit(passages, n_terms, rank)

    monkeypatch.setattr(latent_retrieval, "latent_space", spy)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    latent_retrieval.contaminated(frame, spark.createDataFrame(items, "item_id long, text string")).count()
    words = [(t or "").lower().split() for t in texts]
    terms = {w: k for k, w in enumerate(sorted({w for _, t in items for w in t.split()}))}
    held = collections.Counter(w for t in words for w in set(t))
    weights = np.array([math.log((len(docs) + 1) / (held[w] + 1)) + 0.05 for w in terms])

    def rows(windows):
        out = np.zeros((len(windows), len(terms)))
        for row, window in zip(out, windows):
            for w in window:
                if w in terms:
                    row[terms[w]] += weights[terms[w]]
            strange = sum(w not in terms for w in window)
            row /= math.sqrt((row**2).sum() + strange * weights.max() ** 2)
        return out

    own = rows([t.split()[low : low + 64] for _, t in items for low in range(0, max(1, len(t.split()) - 48), 16)])
    corpus = rows([t[low : low + 64] for t in words for low in range(0, len(t), 64)])
    assert len(corpus) > 2000 and len(seen) == len(own) + len(corpus)
    want = own.T @ own + corpus.T @ corpus * (2000 / len(corpus))
    got = np.zeros_like(want)
    for r in seen:
        got[np.ix_(r["at"], r["at"])] += np.outer(r["value"], r["value"])
    assert np.allclose(got, want, rtol=1e-4)


def test_products_of_terms_in_bands(spark, monkeypatch):
    rng = np.random.default_rng(6)
    dense = rng.random((50, 20)) * (rng.random((50, 20)) > 0.4)
    dense[7] = 0
    rows = [(np.flatnonzero(x).tolist(), [float(v) for v in x[x > 0]]) for x in dense]
    passages = spark.createDataFrame(rows, "at array<int>, value array<float>")
    q = rng.standard_normal((20, 3))
    for band, part, pairs in ((1 << 23, 1 << 15, 1 << 17), (30, 10, 5), (1, 1, 1)):
        for name, value in (("BAND", band), ("PART", part), ("PAIRS", pairs)):
            monkeypatch.setattr(latent_retrieval, name, value)
        matrix = latent_retrieval.gram(passages, 20)
        out = latent_retrieval.gram_products(matrix.toArrow().to_batches(), q)
        assert np.allclose(sum(np.frombuffer(b["part"][0].as_py()).reshape(20, 3) for b in out), dense.T @ dense @ q, atol=1e-3)
        batches = [x for x in passages.toArrow().to_batches()]
        parts = list(latent_retrieval.gram_part(batches, 4, 20))
        cells = np.concatenate([np.frombuffer(b["part"][0].as_py(), "<f4") for b in parts])
        assert np.allclose(cells, (dense.T @ dense)[np.tri(20, dtype=bool)][10:], atol=1e-3)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = {k: v.astype(np.float64) for k, v in gru_toxicity.initial(rng).items()}
    vocabulary = gru_toxicity.features(["good", "bad", "ugly", "fine"])
    codes = rng.integers(0, 4, (3, gru_toxicity.WINDOW))
    lengths, labels = np.array([32, 5, 1]), np.array([1.0, 0.0, 1.0])

    def loss():
        projected = gru_toxicity.project(net, gru_toxicity.inputs(net, *vocabulary))
        z = gru_toxicity.logits(net, projected, codes, lengths).astype(np.float64)
        return float(np.mean(np.logaddexp(0, z) - labels * z))

    grad = gru_toxicity.gradients(net, vocabulary, codes, lengths, labels)
    for name in ("inf", "reb", "pool", "out", "atf", "bias"):
        flat = net[name].reshape(-1)
        for k in range(0, flat.size, max(1, flat.size // 3)):
            old = flat[k]
            flat[k] = old + 1e-2
            up = loss()
            flat[k] = old - 1e-2
            down = loss()
            flat[k] = old
            assert grad[name].reshape(-1)[k] == pytest.approx((up - down) / 2e-2, abs=2e-3)


@pytest.mark.parametrize("joint", ["_", ",", "\u00a0", "\u3000", "語"])
def test_every_character_reaches_a_window(joint):
    text = joint.join(prose(77, 400).split()) + joint + "nastyword" + joint + joint.join(prose(78, 300).split())
    found = gru_toxicity.words_of(text)
    assert max(map(len, found)) <= gru_toxicity.RUN
    data = [w.encode() for w in found]
    for part in text.replace("\u00a0", " ").replace("\u3000", " ").split():
        raw = part.encode()
        for n in gru_toxicity.GRAMS:
            grams = {x[i : i + n] for x in data for i in range(len(x) - n + 1)}
            assert {raw[i : i + n] for i in range(len(raw) - n + 1)} <= grams
    _, codes, _ = gru_toxicity.features(found)
    wanted = {zlib.crc32(b"nastyword"[i : i + n]) % gru_toxicity.CHAR_BINS for n in gru_toxicity.GRAMS for i in range(10 - n)}
    assert wanted <= set(codes.tolist())


def test_toxicity_on_held_out_documents(spark, odd):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for k in range(240):
        words = prose(5000 + k, int(rng.integers(20, 150))).split()
        if k % 3 == 0:
            for _ in range(3):
                words.insert(int(rng.integers(len(words))), "nasty" + WORDS[int(rng.integers(len(WORDS)))])
        rows.append((k, " ".join(words)))
        labels.append((k, 1, int(k % 3 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = gru_toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r["score"] for r in gru_toxicity.toxicity(docs, model).collect()}
    held = [k for k in got if zlib.crc32(str(k).encode()) % 5 == 0]
    right = sum((got[k] >= 0.5) == (k % 3 == 0) for k in held)
    assert right >= 0.9 * len(held)
    out = gru_toxicity.toxicity(odd, model).collect()
    assert len(out) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in out)
    assert {r["score"] for r in out if r["doc_id"] in (3, 4)} == {min(r["score"] for r in out)}
    assert gru_toxicity.fit(docs.where("doc_id < 0"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")) is None


def test_toxicity_is_fitted_on_all_windows(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for k in range(200):
        words = prose(8000 + k, 2500 if k % 4 < 2 else 60).split()
        if k % 2:  # between the evenly spread windows of a long text
            at = 16 * 5 + int(rng.integers(8)) if len(words) > 1000 else int(rng.integers(40))
            words[at : at + 3] = ["nasty" + w for w in words[at : at + 3]]
        rows.append((k, " ".join(words)))
        labels.append((k, k % 2))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    fitted = {}

    def kept(x, y, own=gru_toxicity.calibrated):
        fitted.update(x=x, y=y)
        return own(x, y)

    monkeypatch.setattr(gru_toxicity, "calibrated", kept)
    model = gru_toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    sizes = {len(gru_toxicity.window_starts(len(t.split()))) for _, t in rows}
    assert {round(math.exp(x)) for x in fitted["x"][:, 1]} == sizes and max(sizes) > gru_toxicity.TRAIN_WINDOWS
    got = {r["doc_id"]: r["score"] for r in gru_toxicity.toxicity(docs, model).collect()}
    for long in (True, False):
        own = [k for k, t in rows if (len(t.split()) > 1000) == long and zlib.crc32(str(k).encode()) % 5 == 0]
        assert sum((got[k] >= 0.5) == k % 2 for k in own) >= 0.8 * len(own)


def all_segmentations(chunk, vocabulary):
    out = []

    def go(at, score):
        if at == len(chunk):
            out.append(score)
        for end in range(at + 1, min(len(chunk), at + vocabulary.longest) + 1):
            own = vocabulary.edge(chunk[at:end])
            if own is not None:
                go(end, score + own)

    go(0, 0.0)
    return sorted(out, reverse=True)


def test_n_best_equals_all_segmentations():
    vocabulary = nbest_pieces.load()
    for chunk in ("▁hello", "▁▁the", "ñandú", "▁a\ud800b"):
        want = all_segmentations(chunk, vocabulary)
        got = nbest_pieces.n_best(chunk, vocabulary, 6)
        assert [s for s, _ in got] == pytest.approx(want[:6])
        assert all("".join(p) == chunk for _, p in got)
    text = "the cat on it"
    parts = [all_segmentations(c, vocabulary) for c in nbest_pieces.chunks_of(text, vocabulary)]
    want = sorted((sum(x) for x in itertools.product(*parts)), reverse=True)
    assert nbest_pieces.encoded([text], vocabulary, 5)[1][0] == pytest.approx(want[:5])


def test_ids_of_all_n_segmentations():
    vocabulary = nbest_pieces.load()
    score = {i: vocabulary.score[t] for t, i in vocabulary.ids.items()}
    texts = ["the cat on it", "", "naïve 日本語 ▁ \U0001f600 x", "hello hello hello", "y" * 50 + " ends"]
    ids, scores, every = nbest_pieces.encoded(texts, vocabulary, 5)
    for text, own, best, found in zip(texts, scores, ids.to_pylist(), every.to_pylist()):
        assert found[0] == best and len(found) == len(own) == len({tuple(x) for x in found})
        for total, x in zip(own, found):
            assert nbest_pieces.decoded(x, vocabulary.raw) == text if text else x == []
            assert sum(score.get(i, vocabulary.byte_score) for i in x) == pytest.approx(total)


def test_pieces_round_trip(odd, empty):
    rows = nbest_pieces.encode(odd).collect()
    assert len(rows) == len(odd_rows()) and all(r["exact"] for r in rows)
    back = collections.Counter((r["doc_id"], r["text"]) for r in nbest_pieces.decode(nbest_pieces.encode(odd)).collect())
    assert back == collections.Counter((r[0], r[1] or "") for r in odd_rows())
    assert nbest_pieces.encode(empty).count() == 0


def test_token_counts(odd, empty):
    rows = token_counts.token_counts(odd.where("doc_id in (6, 7, 10)")).collect()
    encoder = token_counts.Encoder(token_counts.read_ranks(token_counts.RANKS))
    texts = {r[0]: r[1] for r in odd_rows()}
    for doc_id in (6, 7, 10):
        own = sorted((r for r in rows if r["doc_id"] == doc_id), key=lambda r: r["section"])
        text = texts[doc_id]
        assert "".join(text[r["start"] : r["end"]] for r in own) == text
        ids = encoder.coder.encode_ordinary(text)
        assert sum(r["n_tokens"] for r in own) == len(ids)
        want = [0] * len(own)
        at = 0
        for i in ids:  # the section of a token's first byte
            want[text.encode()[:at].count(b"\n")] += 1
            at += len(encoder.coder.decode_single_token_bytes(i))
        assert [r["n_tokens"] for r in own] == want
    every = token_counts.token_counts(odd, rule="last").collect()
    assert sum(r["doc_id"] in (3, 4) for r in every) == 2
    assert token_counts.token_counts(empty).count() == 0


def test_marginals_equal_enumeration():
    nodes, _ = html_extract.parse("<div><p>a<b>c</b></p><ul><li>x</li></ul></div>")
    rng = np.random.default_rng(0)
    unary = rng.normal(size=len(nodes)).tolist()
    edges = [rng.normal(size=(2, 2)).tolist() for _ in nodes]
    total, ones = 0.0, np.zeros(len(nodes))
    for labels in itertools.product((0, 1), repeat=len(nodes)):
        score = sum(u * y for u, y in zip(unary, labels))
        score += sum(edges[k][labels[nodes[k].parent]][labels[k]] for k in range(1, len(nodes)))
        total += math.exp(score)
        ones += math.exp(score) * np.array(labels)
    assert html_extract.marginals(nodes, unary, edges)[0] == pytest.approx((ones / total).tolist())


def test_extraction(spark):
    page = (
        '<html><body><nav><a href="/">Home</a></nav><div class="cookie-banner">We use cookies, always.</div>'
        "<article><h1>A &amp; B</h1><p>First  part,\n of it.<br>Second &lt;part&gt; here.<p>Last &eacute;t&eacute;.</article>"
        '<div class="comments"><p>Nice article, thank you.</p></div><footer>&copy; 2020</footer><script>x="<p>no</p>"</script>'
    )
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (3, "v", "<p"), (4, "w", "<a " + "x" * 5000)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert by[1]["text"] == "A & B\nFirst part, of it. Second <part> here.\nLast été."
    assert by[1]["n_chars"] == len(by[1]["text"])
    assert by[2]["text"] == "" and by[2]["n_chars"] == 0
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.extract(empty).count() == 0
    wide = spark.createDataFrame([(1, "u", page, "x", 5)], "page_id int, url string, html string, text string, n_chars int")
    assert [tuple(r) for r in html_extract.extract(wide).collect()] == [tuple(by[1])]


def wrong_nodes(pages, model):
    """(nodes with own text that are judged wrongly, all nodes with own text)."""
    wrong = total = 0
    for text in pages:
        nodes, runs = html_extract.parse(text)
        labels = []
        for node in nodes:
            labels.append(node.label if node.label is not None else labels[node.parent] if node.parent >= 0 else 0)
        p, _ = html_extract.scored(nodes, html_extract.features(nodes, runs), model)
        told = {k for k, raw in runs if raw and raw.strip()}
        wrong += sum((p[k] > 0.5) != labels[k] for k in told)
        total += len(told)
    return wrong, total


def test_extraction_of_held_out_builds():
    pages = html_extract.labelled_pages
    found = [wrong_nodes(pages.held_out_pages(k), html_extract.train(pages.pages(k))) for k in range(4)]
    assert sum(w for w, _ in found) < 0.02 * sum(n for _, n in found)


def test_articles_without_a_named_holder():
    model = html_extract.train()
    said = "The old town hall was opened again after two years. Many people came, and the mayor spoke for an hour."
    linked = "<ul><li><a href='a'>One thing here</a></li><li><a href='b'>Two</a></li></ul>"
    cases = {
        f"<body><div><p>{said}</p><p>{said}</p></div></body>": [said, said],
        f"<body><p>{said}</p><p>{said}</p>": [said, said],
        said: [said],
        f"<article><div>{said}<hr>{said}</div></article>": [said, said],
        f"<article><p>{said}</p>{linked}<p>{said}</p></article>": [said, "One thing here", "Two", said],
        f"<body><nav><a href='/'>Home</a></nav><div>{said}<br>{said}</div><footer>All rights reserved, by us.</footer>": [f"{said} {said}"],
        f"<main><p>{said}</p><aside><p>{said}</p></aside></main>": [said],
        f"<form><p>{said}</p></form><p>{said}</p><p hidden>{said}</p>": [said],
    }
    for page, want in cases.items():
        assert html_extract.main_text(page, model) == "\n".join(want), page


def test_broken_markup_takes_linear_time():
    n = 40_000
    pages = [
        "<i>" * n + "</u>" * n,
        "<u><div>" + "<i>" * n + "</u>" * n,
        "<b " * n,
        '<b =">"' * n,
        "<!x " * n,
        "</script " * n + "<script>",
        "<table>" * n + "<tr>" * n,
    ]
    started = time.monotonic()
    for page in pages:
        html_extract.parse(page)
    assert time.monotonic() - started < 30
    assert html_extract.parse("a<!-- b > c")[1] == [(0, "a")]
    assert html_extract.parse("a<!-- b")[1] == [(0, "a")]
    assert html_extract.parse("x > y <![CDATA[a > b")[1] == [(0, "x > y "), (0, "a &gt; b")]
    assert html_extract.parse("2 < 3 > 1 <b")[1] == [(0, "2 < 3 > 1 <b")]
