"""Line deduplication, n-gram join, packing and byte-level BPE against brute force."""

import random
import zlib
from collections import defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from celstack.llm import bpe, line_dedup, ngram_join, packing

RNG = random.Random(11)


def corpus(groups=12, seed=5):
    """Texts with copies, near copies with one or more changed words, and shared lines."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    rows, lines = [], [" ".join(word() for _ in range(12)) for _ in range(4)]
    for g in range(groups):
        base = [word() for _ in range(rng.choice([3, 9, 10, 19, 40, 130, 400]))]
        for _ in range(rng.randint(1, 9)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, len(base) // 40])):
                own[rng.randrange(len(own))] = word()
            text = " ".join(own)
            if rng.random() < 0.4:
                text = rng.choice(["", " "]) + rng.choice(lines).upper() + "\n" + text
            rows.append((len(rows) * 3 + 1, text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("bits", [8, 1 << 16])
def test_lines(documents, odd_rows, keep_first, bits):
    rows = corpus() + odd_rows
    done = line_dedup.dedupe_lines(documents(rows), min_docs=2, keep_first=keep_first, bits=bits)
    assert {"score", "node", "key"} <= set(done.columns)
    got = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in done.collect()), key=repr)
    wanted = brute.deduped(rows, 2, keep_first)
    if keep_first:  # a repeated row keeps its own first line too
        got, wanted = [x for x in got if x[0] != 10], [x for x in wanted if x[0] != 10]
    assert got == sorted(wanted, key=repr)


def test_lines_of_an_empty_table_and_bad_bits(documents):
    assert line_dedup.dedupe_lines(documents([])).count() == 0
    with pytest.raises(ValueError):
        line_dedup.dedupe_lines(documents([]), bits=100)


def test_short_keys_stay(documents):
    rows = [(i, "é\nlong line") for i in range(3)]
    texts = {r["text"] for r in line_dedup.dedupe_lines(documents(rows), min_docs=3, min_points=2).collect()}
    assert texts == {"é"}


@pytest.mark.parametrize(("size", "num", "den"), [(3, 90, 100), (5, 80, 100)])
@pytest.mark.parametrize("block", [4, 512])
def test_components(documents, odd_rows, size, num, den, block):
    rows = corpus() + [(i and i + 1000, t) for i, t in odd_rows if i != 10] + [(1010, "same line\nother")] * 2
    got = ngram_join.components(documents(rows), size, num, den, block).collect()
    assert len(got) == len(rows)
    wanted = brute.components(dict((i, t) for i, t in rows if i is not None).items(), size, num, den)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == wanted
    assert [(r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is None] == [(None, None)]


def test_large_near_copy_group(documents):
    """One text with a different word in each copy, in chunks of 16, and copies at a distance that only chains reach."""
    base = [f"w{k}" for k in range(120)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i, k in enumerate(RNG.choices(range(120), k=150))]
    chain = [(1000 + i, " ".join([f"y{k}" for k in range(i, 60 + i)])) for i in range(40)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.components(documents(rows + chain), 3, 90, 100, block=16).collect()}
    assert got == {i: c for i, (_, c) in brute.components(rows + chain, 3, 90, 100).items()}


def test_one_of_each(documents):
    rows = [(5, "a b c d e f g"), (2, "A b c d e f g"), (9, "other words in here now"), (None, "a b c d e f g"), (11, None), (12, None)]
    kept = ngram_join.one_of_each(documents(rows)).collect()
    assert sorted((r["doc_id"] for r in kept), key=repr) == sorted([2, 9, None, 11, 12], key=repr)
    assert ngram_join.one_of_each(documents([])).count() == 0 and ngram_join.components(documents([])).count() == 0


def test_divide_skip_counts_every_threshold():
    rng = random.Random(2)
    for _ in range(200):
        lists = [sorted(rng.sample(range(30), rng.randint(1, 20))) for _ in range(rng.randint(1, 25))]
        least = rng.randint(1, 12)
        counts = defaultdict(int)
        for own in lists:
            for doc in own:
                counts[doc] += 1
        found = list(ngram_join.divide_skip(lists, least, lambda doc, n=least: n, lambda doc: True))
        assert found == sorted(d for d, n in counts.items() if n >= least)


def test_signatures_meet_for_every_linked_pair():
    rng = np.random.default_rng(4)
    for num, den in ((90, 100), (80, 100)):
        signatures = ngram_join.Signatures(num, den)
        for n in (9, 10, 11, 15, 20, 60, 300):
            for _ in range(40):
                a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
                b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.06], rng.integers(0, 2**63, int(rng.integers(0, n // 8 + 1)), dtype=np.uint64)]))
                both = len(np.intersect1d(a, b))
                if den * both >= num * (len(a) + len(b) - both) and len(a) + len(b) > 2 * both:
                    assert set(signatures(a).tolist()) & set(signatures(b).tolist())


def check_packing(pieces, rows, capacity):
    encode = Tokenizer.from_file(packing.VOCABULARY)
    ids = {i: [*encode.encode(t or "", add_special_tokens=False).ids, 0] for i, t in rows}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
        own = np.array(ids[p["doc_id"]][p["start"] : p["start"] + p["length"]], "<u4")
        assert len(own) == p["length"] > 0 and zlib.crc32(own.tobytes()) == p["ids_crc32"] and p["doc_tokens"] == len(ids[p["doc_id"]])
    for i, own in by_doc.items():
        own.sort(key=lambda p: p["start"])
        assert [p["start"] for p in own] == [sum(q["length"] for q in own[:k]) for k in range(len(own))] and sum(p["length"] for p in own) == len(ids[i])
    assert set(by_doc) == set(ids)
    for own in by_sequence.values():
        own.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == [sum(q["length"] for q in own[:k]) for k in range(len(own))]
        total = sum(p["length"] for p in own)
        assert total == capacity or (total < capacity and total & (total - 1) == 0)


@pytest.mark.parametrize("open_tokens", [200, 1 << 22])
def test_packing(documents, odd_rows, open_tokens):
    rows = [(i, t) for i, t in corpus() if i] + [(i + 5000, t) for i, t in odd_rows if i not in (None, 10)] + [(9000, "a <|endoftext|> b")]
    check_packing(packing.pack(documents(rows), 64, open_tokens=open_tokens).collect(), rows, 64)
    assert packing.pack(documents([])).count() == 0
    repeated = packing.pack(documents([(1, "a b"), (1, "a b"), (None, None)])).collect()
    assert sum(p["length"] for p in repeated) == 7


def test_level_choice_minimises_squares():
    rng = random.Random(9)
    levels = packing.LevelArray(20)
    for _ in range(300):
        size = rng.randint(1, 19)

        def squares(level, size=size):
            counts = levels.counts.copy()
            counts[level] -= level > 0
            counts[level + size] += level + size < 20
            return int(np.square(counts[1:20]).sum())

        allowed = [k for k in range(0, 21 - size) if k == 0 or levels.counts[k]]
        level = levels.best_level(size)
        assert level in allowed and squares(level) == min(map(squares, allowed))
        levels.place((0, size), size)


@pytest.fixture(scope="module")
def reference_bpe():
    return tiktoken.Encoding("check", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.VOCABULARY), special_tokens={})


def test_bpe_equals_rank_merging(documents, odd_rows, reference_bpe):
    rng = random.Random(8)
    alphabet = "ab'sSté 文ß１½\t\n\r \x0b\x85\xa0​🙂éthe ing tion"
    rows = corpus() + [(i and i + 50_000, t) for i, t in odd_rows] + [(7000 + k, "".join(rng.choices(alphabet, k=40))) for k in range(300)] + [(8000, " " * 5000 + "a" * 5000)]
    rows = list({(i, t): None for i, t in rows if i is not None})
    got = {r["doc_id"]: r for r in bpe.encode_documents(documents(rows)).collect()}
    for i, t in rows:
        assert got[i]["ids"] == reference_bpe.encode_ordinary(t or "")
    sums = {r["doc_id"]: r for r in bpe.round_trip(documents(rows)).collect()}
    for i, t in rows:
        ids = np.array(got[i]["ids"], "<u4")
        assert sums[i]["n_tokens"] == len(ids) and sums[i]["decoded_sha256"] == brute.sha256(t or "")
        assert sums[i]["ids_sha256"] == __import__("hashlib").sha256(ids.tobytes()).hexdigest()
    assert bpe.round_trip(documents([])).count() == 0


def test_transducer_forgets_and_goes_on(reference_bpe):
    rng = random.Random(1)
    small = bpe.Transducer(bpe.read_ranks(bpe.VOCABULARY), many_states=50)
    for _ in range(50):
        piece = "".join(rng.choices("abcdefghij", k=rng.randint(1, 200)))
        assert list(small(piece.encode())) == reference_bpe._encode_single_piece(piece)


def test_decoding_in_steps():
    bytes_of = {k: bytes([k]) for k in range(256)}
    for text in ("aé文🙂b", "🙂" * 5, ""):
        ids = np.frombuffer(text.encode(), np.uint8).astype(np.uint32)
        for step in (1, 2, 3, 7):
            assert bpe.decode(ids, bytes_of, step) == text
    decoder = bpe.StreamDecoder(bytes_of)
    assert decoder.feed([0xF0, 0x9F]) == "" and decoder.close() == "�"
    assert bpe.StreamDecoder(bytes_of).feed([0xC0, 0x41]) == "�A"


def shared_sets(shared, own, count, seed=8):
    """Sets of hashes that have ``shared`` elements in common and ``own`` elements each that no other set has."""
    rng = np.random.default_rng(seed)
    common = rng.integers(0, 2**64 - 1, shared, dtype=np.uint64)
    return [np.unique(np.concatenate([common, rng.integers(0, 2**64 - 1, own, dtype=np.uint64)])) for _ in range(count)]


def test_possible_links_leave_out_no_link():
    rng = np.random.default_rng(6)
    base, sets = rng.integers(0, 2**64 - 1, 600, dtype=np.uint64), []
    for n in (1, 3, 10, 60, 127, 128, 130, 255, 258, 500, 515, 600):
        sets += [np.unique(np.concatenate([base[:n][rng.random(n) > 0.05], base[:1], rng.integers(0, 2**64 - 1, int(rng.integers(0, 2 + n // 12)), dtype=np.uint64)])) for _ in range(9)]
    for num, den in ((80, 100), (90, 100)):
        got = {tuple(sorted(pair)) for pair in ngram_join.possible_links([len(s) for s in sets], [ngram_join.spread_of(s) for s in sets], num, den)}
        both = {(i, j): len(np.intersect1d(sets[i], sets[j])) for j in range(len(sets)) for i in range(j)}
        linked = {(i, j) for (i, j), n in both.items() if den * n >= num * (len(sets[i]) + len(sets[j]) - n)}
        assert len(linked) > 40 and linked <= got and len(got) < len(both) / 2


def test_documents_that_share_a_passage_form_no_block(spark):
    """Two thirds in common, so a similarity below 0.7: through such pairs unrelated documents became one block of many chunks."""
    sets = shared_sets(240, 60, 60) + shared_sets(285, 15, 3, seed=9)
    rows = spark.createDataFrame([(k, len(s), bytearray(ngram_join.spread_of(s))) for k, s in enumerate(sets)], "ref long, n long, spread binary")
    edges = spark.createDataFrame([(0, 0, k) for k in range(1, 60)] + [(60, 0, 61), (60, 0, 62)], "a long, star long, b long")
    found = {tuple(r) for r in ngram_join.candidate_edges(edges, rows, 80, 100, 512).collect()}
    assert found == {(60, 61), (60, 62)}
