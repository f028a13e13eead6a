"""Manifest, mixing and phrases against brute force, and on odd rows."""

import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabia.llm import collocations, merkle_manifest, ordinals, source_mixing
from tests.llm.test_operators import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, h string, idx int, key string"


def odd_rows():
    texts = [
        (1, prose(1, 40)), (2, prose(1, 40)), (2, prose(1, 40)), (2, "other\ntext\n"), (3, None), (4, ""),
        (5, " \t\n\n "), (6, "\x0b a\n\n"), (7, prose(2, 20000)), (None, "no id\n"), (None, None), (8, "naïve 日本語\n\U0001f600"),
    ]
    rows = [(i, t, "en" if k % 3 else None, [None, "a", "", "b"][k % 4], k if k % 2 else None, 1, "h", 2, "k")
            for k, (i, t) in enumerate(texts)]
    return rows + [(100 + k, prose(k, 5 + k % 30) + "\n", "de", "hot", k, 1, "h", 2, "k") for k in range(60)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _tree(level, width):
    """(top, steps of each leaf as (digests before, digests after))."""
    steps, at, nodes = [[] for _ in level], list(range(len(level))), level
    while len(nodes) > 1:
        for own, k in zip(steps, at):
            base = k // width * width
            own.append((nodes[base:k], nodes[k + 1 : base + width]))
        at = [k // width for k in at]
        nodes = [H(*nodes[k : k + width]) for k in range(0, len(nodes), width)]
    return nodes[0], steps


def _manifest(rows, width):
    def leaf(row, text):
        values = [None if v is None else str(v) for v in (row[0], row[3], row[2], row[4], text)]
        return H(*("-" if v is None else f"{len(v.encode())}:{v}" for v in values))

    groups = collections.defaultdict(list)
    for row in rows:
        groups[row[3]].append((row[0], leaf(row, row[1]), row))
    names = sorted(groups, key=lambda n: (n is not None, (n or "").encode()))
    tops, out = [], []
    for name in names:
        groups[name].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        tops.append(_tree([x[1] for x in groups[name]], width))
    root, upper = _tree([t[0] for t in tops], width)
    for name, (top, steps), above in zip(names, tops, upper):
        for (doc_id, h, row), own in zip(groups[name], steps):
            text = row[1]
            if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
                text = text.replace("\n", "")
            found = leaf(row, text)
            for before, after in own + above:
                found = H(*before, found, *after)
            proof = H(*(d for before, after in own + above for d in before + after))
            out.append((doc_id, h, top, root, proof, found, found == root))
    return sorted(out, key=str)


def _digested(rows):
    found = rows.withColumn("found", merkle_manifest.folded(F.col("changed"), F.col("steps")))
    text = merkle_manifest.text_of
    return sorted(
        (
            tuple(r)
            for r in found.select(
                "doc_id", text(F.col("h")), text(F.col("subroot")), text(F.col("root")),
                F.sha2(merkle_manifest.proof_text(F.col("steps")).cast("binary"), 256),
                text(F.col("found")), F.col("found") == F.col("root"),
            ).collect()
        ),
        key=str,
    )


@pytest.mark.parametrize("width", [2, 3, 4])
def test_manifest_equals_plain_trees(odd, width):
    got = _digested(merkle_manifest.document_manifest(odd, width))
    assert got == _manifest(odd_rows(), width)
    assert {r[6] for r in got} == {True, False}


def test_manifest_of_few_rows(odd, none):
    assert merkle_manifest.document_manifest(none).count() == 0
    for doc_ids in ((8,), (1, 4), (100,)):
        rows = [r for r in odd_rows() if r[0] in doc_ids]
        assert _digested(merkle_manifest.document_manifest(odd.where(F.col("doc_id").isin(*doc_ids)))) == _manifest(rows, 3)


def test_manifest_changes_with_any_value(odd):
    def root(frame):
        return bytes(merkle_manifest.document_manifest(frame).select("root").first()[0])

    rows = odd.where("doc_id >= 100")
    first = root(rows)
    assert root(rows.repartition(7)) == first
    assert root(rows.withColumn("n_chars", F.when(F.col("doc_id") == 130, None).otherwise(F.col("n_chars")))) != first
    assert root(rows.where("doc_id <> 159")) != first


def test_numbers_have_no_gap(spark):
    rows = [("a" if k % 3 else "b", k // 4, k % 2) for k in range(500)] + [("c", 1, 1)] * 300
    frame = ordinals.salted(spark.createDataFrame(rows, "g string, x int, y int").repartition(5))
    got = ordinals.numbered(frame, "g", ["x", "y", "salt"]).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.g].append((r.idx, r.x, r.y, r.size))
    for name, found in by.items():
        want = sorted((x, y) for g, x, y in rows if g == name)
        assert [(x, y) for _, x, y, _ in sorted(found)] == want
        assert sorted(i for i, *_ in found) == list(range(len(want))) and {s for *_, s in found} == {len(want)}


def _targets(sizes):
    """sizes: {source: words}; the rule as it is told, share by share."""
    names = sorted(sizes, key=lambda n: (n is None, (n or "").encode()))
    weight = {n: (1, 2, 3)[k % 3] for k, n in enumerate(names)}
    target, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        level = left / sum(weight[n] for n in open_)
        above = {n for n in open_ if weight[n] * level > 3 * sizes[n]}
        if not above:
            target.update({n: weight[n] * level for n in open_})
            break
        for n in above:
            target[n] = 3.0 * sizes[n]
            left -= target[n]
        open_ -= above
    return target


def test_targets_stop_at_three_times(spark):
    sizes = {"a": 1000, "b": 3, "c": 10, "": 50, None: 4, "é": 0, "z": 700}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long").select(
        source_mixing.source_key().alias("key"), "source_size", "source"
    )
    got = source_mixing.targets(frame.select("key", "source_size")).join(frame.select("key", "source"), "key")
    want = _targets(sizes)
    assert {r.source: r.target for r in got.collect()} == pytest.approx(want)
    assert want["b"] == 9.0 and sum(want.values()) == pytest.approx(sum(sizes.values()))


def test_mix(odd, none):
    plan = source_mixing.mixing_plan(odd).select("row.*", F.struct("size", "source_size", "target", "copies").alias("mix")).collect()
    words = collections.Counter()
    for row in odd_rows():
        words[row[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", row[1] or ""))
    target = _targets(words)
    taken, largest = collections.Counter(), collections.Counter()
    assert len(plan) == len(odd_rows())
    for r in plan:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
        assert r.mix["size"] == size and r.mix["source_size"] == words[r.source]
        assert r.mix["target"] == pytest.approx(target[r.source])
        rate = target[r.source] / words[r.source] if words[r.source] else 0
        assert int(rate) <= r.mix["copies"] <= min(3, int(rate) + 1)
        taken[r.source] += size * r.mix["copies"]
        largest[r.source] = max(largest[r.source], size)
    assert abs(taken["hot"] - target["hot"]) < 0.02 * target["hot"]
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in target)
    mix = source_mixing.mixed(odd)
    assert mix.columns == odd.columns
    assert mix.count() == sum(r.mix["copies"] for r in plan)
    again = source_mixing.mixing_plan(odd.repartition(3)).select("row.*", "copies").collect()
    assert sorted((str(r[:-1]), r.copies) for r in again) == sorted((str(r[:-1]), r.mix["copies"]) for r in plan)
    assert source_mixing.mixing_plan(none).count() == 0


def test_chance_of_a_copy(spark):
    """A document of a source with rate 1.3 comes twice with a chance of 0.3, once otherwise."""
    keys = spark.range(20000).select((F.col("id") * 7919 % source_mixing.PRIME).alias("k"))
    for a, b in source_mixing.seed_numbers(3):
        share = keys.agg(F.avg((source_mixing.draw(F.col("k"), F.lit(a), F.lit(b)) < 0.3).cast("int"))).first()[0]
        assert abs(share - 0.3) < 0.02


def _phrases(rows, least, top):
    counts, totals = collections.defaultdict(collections.Counter), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in (1, 2, 3):
                for k in range(len(words) - n + 1):
                    counts[lang][tuple(words[k : k + n])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and p in (q[:-1], q[1:]) for q, b in found.items()):
                continue
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


TEXTS = [
    ("New York City. new york\tcity, NEW YORK", "en"), ("new york, new  york city", "en"), ("a a a a a a a", "en"), (None, "en"),
    ("", None), ("x" * 5000 + " y " + "x" * 5000 + " y", None), ("é è é è. É è", "fr"), ("é è é\x0cè é", "und"), (" \t", "fr"),
    ("q.w,e;r:t!y?u\ni\x0bo\x0dp", "en"), ("a b" * 50, "en"), ("日本 語 日本 語", ""),
]


@pytest.mark.parametrize("bits", [64, 4])
def test_phrases_equal_brute_force(spark, bits):
    """Four bits make nearly all first fingerprints collide."""
    rows = TEXTS + [(prose(k, 400), "de") for k in range(6)] + [("copied text of five words", "en")] * 20
    docs = spark.createDataFrame(rows, "text string, lang string").withColumns({c: F.lit(1) for c in ("fp", "n", "pointer", "rank")})
    for least, top in ((2, 2000), (3, 5)):
        got = collocations.collocations(docs, least=least, top=top, bits=bits)
        assert sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == _phrases(rows, least, top)
    assert collocations.collocations(docs.where("false")).count() == 0


def test_blocks_cut_between_words():
    texts = pa.array([prose(3, 300) + ". " + prose(4, 50), "", "one", "two words"])
    buffer, starts = collocations.buffer_of(texts)

    def found(limit):
        hasher, out = collocations.Hasher(), collections.Counter()
        for words in collocations.blocks(buffer, starts, limit):
            sums = hasher.words(words.bytes, words.start, words.end)
            for n in (1, 2, 3):
                at = words.at(n)
                h, p = hasher.grams(sums, at, n, np.zeros(len(at), np.uint64))
                out.update((n, words.phrase(k, n), int(words.doc[k]), x, y) for k, x, y in zip(at.tolist(), h.tolist(), p.tolist()))
        return out

    whole = found(1 << 20)
    assert whole == found(1) == found(100)
    assert len({(n, t): (x, y) for n, t, _, x, y in whole}) == len({(x, y) for _, _, _, x, y in whole})


def test_bitmap_only_lets_more_through(spark):
    rows = [(prose(k, 300), "de") for k in range(4)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    full, collocations.FILTER_BITS = collocations.FILTER_BITS, 6
    try:
        got = collocations.collocations(docs, least=2)
        assert sorted(tuple(r) for r in got.collect()) == _phrases(rows, 2, 2000)
    finally:
        collocations.FILTER_BITS = full


def test_sql_of_the_three(spark, tmp_path, odd):
    """The SQL on odd rows, nulls and repeated rows included."""
    from tabia.llm.queries import ORACLES, QUERIES

    docs = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    docs.select("doc_id", "text", "lang", "source", "n_chars").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("op11_merkle_manifest", "op12_source_mixing", "op13_phrase_collocations"):
        frame = QUERIES[name](spark, str(tmp_path))
        want = con.execute(ORACLES[name]).df()[frame.columns]
        got = sorted(str(tuple(r)) for r in frame.collect())
        assert got == sorted(str(tuple(x.item() if hasattr(x, "item") else x for x in r)) for r in want.itertuples(index=False)), name
