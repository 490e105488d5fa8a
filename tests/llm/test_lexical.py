"""Ranked search, importance resampling and token counts against plain second implementations."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece

from celstack.llm import importance, lexical, token_counts, words

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_rank(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    lengths = [sum(b.values()) for _, b in bags]
    n_docs, total = sum(1 for n in lengths if n), sum(lengths)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item_id, text in items:
        scores = []
        for (doc_id, bag), n in zip(bags, lengths, strict=True):
            if doc_id is None or not n:
                continue
            m = 75 + 25 * n * n_docs // total
            score = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 12 * m))
                        for t, times in Counter(terms(text)).items() if t in bag)
            if score > 0:
                scores.append((-score, doc_id))
        out += [(item_id, r, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus(odd_rows):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)] + ["théta", "ÉÉ", "日本"]
    made = [(100 + i, " ".join(rng.choice(vocabulary[: rng.randint(3, 63)]) for _ in range(rng.randint(0, 90)))) for i in range(150)]
    return odd_rows + made + [(900 + i, "w1 w2 w3 tie") for i in range(30)] + [(2000, "w1 w2 w3 tie")] * 3


ITEMS = [(1, "w1 W2 w2, tie"), (2, None), (3, ""), (4, "alpha BETA gamma one two same line"), (5, "absent"), (5, "w5 w5 w5 théta 日本"), (None, "tie"), (7, "x" * 50_000)]


def test_rank(spark, documents, corpus):
    items = spark.createDataFrame([(i, t, 1.0) for i, t in ITEMS], "item_id long, text string, score double").coalesce(1)
    got = rows_of(lexical.rank(documents(corpus), items, k=7))
    assert got == brute_rank(corpus, ITEMS, 7) and len(got) > 20


def test_rank_in_blocks_and_small_tiles(spark, documents, corpus, monkeypatch):
    monkeypatch.setattr(lexical, "item_blocks", lambda items, f=lexical.item_blocks: f(items, 2, 5))
    monkeypatch.setattr(lexical, "weight_tiles", lambda *a, f=lexical.weight_tiles: f(*a, width=3, exact=9000 * lexical.IMPACT_BOUND))
    items = spark.createDataFrame(ITEMS, "item_id long, text string").coalesce(1)
    assert rows_of(lexical.rank(documents(corpus), items, k=7)) == brute_rank(corpus, ITEMS, 7)


def test_rank_of_empty_tables(spark, documents):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    empty = documents([(1, "x")]).where("false")
    assert lexical.rank(empty, items).collect() == [] == lexical.rank(documents([(1, "w1")]), items.where("false")).collect()
    assert lexical.rank(documents([(1, None), (None, "w1")]), items).collect() == []


def test_weight_tiles_are_exact():
    """Partial sums stay below the bound with any impacts, and the tiles add up to the weights."""
    rng = random.Random(5)
    vocabulary = {b"%d" % i: i for i in range(40)}
    block = [Counter({t: rng.choice([1, 2, 50, 10**7]) for t in rng.sample(sorted(vocabulary), 15)}) for _ in range(6)]
    weights = np.array([rng.choice([0, 3, 20_000]) for _ in vocabulary])
    made = lexical.weight_tiles(block, vocabulary, weights, width=8)
    total = np.zeros((6, 40))
    for columns, tile in made.dense():
        assert len(columns) <= 8 and tile.sum(axis=1).max() * lexical.IMPACT_BOUND < 1 << 53
        np.add.at(total.T, columns, tile.T)
    assert all(total[i, k] == block[i][t] * weights[k] for i in range(6) for t, k in vocabulary.items())


def test_best_is_tie_safe():
    rng = np.random.default_rng(1)
    for _ in range(20):
        best, seen = lexical.Best(3, 4), [[] for _ in range(3)]
        for _ in range(5):
            scores, ids = rng.integers(0, 4, (3, 9)), rng.integers(0, 50, 9)
            best.add(scores, ids)
            for item in range(3):
                seen[item] += [(-s, i) for s, i in zip(scores[item], ids, strict=True) if s > 0]
        item, ids, scores = best.rows()
        assert [(i, -s, d) for i, s, d in zip(item, scores, ids, strict=True)] == [(i, *x) for i in range(3) for x in sorted(seen[i])[:4]]


def test_word_slices(odd_rows):
    for _, text in odd_rows:
        for step in (3, 50, 1 << 20):
            assert [w.decode() for part in words.word_slices((text or "").encode(), step) for w in part] == terms(text)


def brute_resample(docs, target, percent, least, seed, longest, buckets):
    def features(text):
        w = terms(text)
        return len(w), [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own, wanted = Counter(), Counter()
    for _, t in docs:
        own.update(map(bucket, features(t)[1]))
    for _, t in target:
        wanted.update(map(bucket, features(t)[1]))
    s, t = sum(own.values()), sum(wanted.values())
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * (s + buckets) / ((own[b] + 1) * (t + buckets)))) for b in range(buckets)}
    scored = []
    for i, text in docs:
        n, found = features(text)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in found)
        scored.append((i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in scored if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = percent * len(fit) // 100
    ranked = [(r, k) for k, r in enumerate(fit[:drawn], 1)] + [(r, None) for r in fit[drawn:] + [r for r in scored if r[1] < least]]
    return sorted(((r[0], r[2], r[3], r[4], k) for r, k in ranked), key=repr)


@pytest.mark.parametrize("percent,longest,buckets", [(10, 1, 10_000), (50, 3, 97)])
def test_resample(spark, documents, corpus, percent, longest, buckets, monkeypatch):
    monkeypatch.setattr(words.word_slices, "__defaults__", (500,))
    target = spark.createDataFrame([(1, "w1 w2 tie alpha", 2), (2, None, 1), (3, "w1 W1", 0)], "item_id long, text string, weight int")
    got = rows_of(importance.resample(documents(corpus), target, percent=percent, longest=longest, buckets=buckets))
    assert got == brute_resample(corpus, [(1, "w1 w2 tie alpha"), (2, None), (3, "w1 W1")], percent, 20, 2024, longest, buckets)
    assert sum(r[4] is not None for r in got) > 10


def test_resample_of_empty_tables(spark, documents):
    target = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert importance.resample(documents([(1, "x")]).where("false"), target).collect() == []
    rows = [(1, "one two"), (2, "two " * 30)]
    assert rows_of(importance.resample(documents(rows), target.where("false"), percent=100)) == brute_resample(rows, [], 100, 20, 2024, 1, 10_000)


def test_gain_planes():
    rng = np.random.default_rng(2)
    for top in (0, 1, 77, 30_000):
        gain = rng.integers(-top, top + 1, 130)
        times = rng.integers(0, 2000, (9, 130)) * (rng.random((9, 130)) < 0.3)
        row, ids = np.nonzero(times)
        assert (importance.GainPlanes(gain).weights(row, ids, times[row, ids], 9) == times @ gain).all()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=token_counts.MODEL)


def test_token_counts(documents, odd_rows, library):
    rows = odd_rows + [(50, "<s> </s> <unk> <0x41>"), (51, "日本 𐍈 ▁▁ x"), (52, " " * 20_000), (53, "ab" * 9_000)]
    got = sorted((tuple(r) for r in token_counts.count_tokens(documents(rows), limit=100).collect()), key=repr)
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "")), n > 100) for i, t in rows]
    assert got == sorted(want, key=repr) and any(w[3] for w in want)
    assert token_counts.count_tokens(documents(rows).where("false")).collect() == []


def test_transducer_with_small_chunks_and_few_states(library):
    """Random texts, cut into chunks inside words, with states forgotten all the time."""
    rng = random.Random(3)
    parts = ["the", " ", "  ", "▁", "a", "ing", "tion", "x" * 9, "é", "\n", "日本", "𐍈", "<s>", "<0x41>", "0", "12345", "ñ", "...", "====", "\t", "aaaaaaa", "_", "    "]
    wide, narrow = token_counts.Counter(), token_counts.Counter(chunk=7, many_states=40)
    for k in range(4000):
        text = "".join(rng.choice(parts) if k % 2 else rng.choice("abcdeot ") for _ in range(rng.randint(0, 30)))
        assert wide(text) == narrow(text) == len(library.encode(text)), text


def test_chunk_scan_gives_every_boundary(library):
    """Tokens before each chunk boundary are those of encoding the text up to it."""
    count = token_counts.Counter(chunk=10)
    text = "the quick brown fox" + "x" * 55 + " jumps over it"
    marked = "▁" + text.replace(" ", "▁")
    assert count.before_chunks(text) == [len(library.encode(marked[1 : min(e, len(marked))])) for e in range(10, len(marked) + 10, 10)]


def test_tokens_stay_apart():
    """The backward rule against encoding the joined characters."""
    machine, rng = token_counts.Counter().machine, random.Random(7)
    tokens = [t for t in machine.token_at if t]
    for _ in range(30_000):
        whole, left, right = rng.choice(tokens), rng.choice(tokens), rng.choice(tokens)
        at = rng.randint(0, len(whole))
        left = whole[:at] if whole[:at] in machine.parts else left
        right = whole[at:] if whole[at:] in machine.parts else right
        assert machine.stay_apart(left, right) == (machine.joined(left + right) == [left, right])
