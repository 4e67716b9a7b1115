"""Prefix trie, packing and vector codes against brute force, on small fixtures with nulls, long inputs, ties and repeats."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from parlance.llm import packing, prefix_trie, vector_codes

TURN = "conv_id long, turn long, role string, text string, depth int, NAME string, part int"


def conversations():
    draw = random.Random(3)
    rows = []
    shared = [("user", f"turn {i}") for i in range(70)]
    for c in [*range(12), 100, 103, 205, 207, 301]:
        length = draw.choice([0, 1, 2, 3, 7, 8, 9, 16, 17, 33, 70])
        same = draw.randint(0, length)
        for i in range(length):
            role, text = shared[i] if i < same else ("assistant", draw.choice(["a", "bb", "😀", ""]))
            rows.append((c, i, role, text))
    rows += [(7, None, None, None), (7, None, None, None), (8, 2, None, "tie"), (8, 2, "user", None), (None, 1, "user", "of no conversation")]
    rows += [(c, i, *shared[i]) for c in (400, 401, 402) for i in range(64)]
    return rows


def brute_trie(rows, rebuilt):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    if rebuilt:
        h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
        own = {c: own.get(c - c % 100, [])[: h[c]] + turns[h[c] :] for c, turns in own.items()}
    members = defaultdict(list)
    for c in sorted(own):
        for d in range(len(own[c]) + 1):
            members[tuple(own[c][:d])].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, who in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(who) - 1) * (len(p[-1][1]) if p else 0)
    out = set()
    for p, who in members.items():
        ends = ",".join(str(c) for c in who if len(own[c]) == len(p))
        out.add((who[0], len(p), members[p[:-1]][0] if p else None, len(who), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def test_trie_equals_brute_force(spark):
    rows = conversations()
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], TURN).repartition(5)
    assert {tuple(r) for r in prefix_trie.prefix_trie(df).collect()} == brute_trie(rows, False)
    turns, runs = prefix_trie.number_turns(df)
    found = prefix_trie.build(*prefix_trie.rebuild(turns, runs)).collect()
    assert {tuple(r) for r in found} == brute_trie(rows, True) and len(found) == len(set(found))


def test_trie_of_one_long_conversation_and_of_none(spark):
    rows = [(5, i % 3 or None, "user", str(i % 7)) for i in range(500)] + [(6, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {tuple(r) for r in prefix_trie.prefix_trie(df).collect()} == brute_trie(rows, False)
    assert prefix_trie.prefix_trie(df.where("false")).count() == 0
    only = df.where("conv_id = 6")
    # crc32("6") % 6 is at least 1 and conversation 0 is absent, so no turn is left.
    assert zlib.crc32(b"6") % 6 >= 1
    root = prefix_trie.build(*prefix_trie.rebuild(*prefix_trie.number_turns(only))).collect()
    assert [tuple(r) for r in root] == [(6, 0, None, 1, 0, 1, 0, hashlib.sha256(b"6").hexdigest())]


def test_last_turns_of_nodes(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    turns, runs = prefix_trie.number_turns(df, texts=True)
    numbered = turns.join(runs, ["part", "conv_id"]).withColumn("pos", prefix_trie.number())
    nodes = prefix_trie.with_last_turns(prefix_trie.build(numbered, df.select("conv_id").distinct()), numbered)
    assert {(r["depth"], r["role"], r["text"], r["n_convs"]) for r in nodes.collect()} == {(0, None, None, 2), (1, "user", "a", 2), (2, "assistant", "b", 1)}


def tokenizer():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return file.read()


@pytest.mark.parametrize("size", [8, 64, 1024])
def test_plans_use_every_piece_once_and_leave_no_gap(size):
    for seed in range(40):
        draw = random.Random(seed)
        counts = Counter()
        for _ in range(draw.randint(1, 60)):
            counts[draw.randint(1, size)] += draw.choice([1, 2, 50, 10**6])
        patterns = packing.plan(dict(counts), size)
        used = Counter()
        for lengths, times in patterns:
            assert sum(lengths) <= size and times > 0
            for length in lengths:
                used[length] += times
        assert used == counts
        sequences = sum(times for _, times in patterns)
        needed = max(-(-sum(k * n for k, n in counts.items()) // size), sum(n for k, n in counts.items() if 2 * k > size))
        assert needed <= sequences and (sequences <= 1.7 * needed + 1)
    with pytest.raises(ValueError):
        packing.plan({size + 1: 1}, size)


def test_plans_fill_exactly_by_one_two_and_three():
    assert packing.plan({600: 5, 424: 5}) == [((600, 424), 5)]
    assert packing.plan({600: 3, 300: 3, 124: 3}) == [((600, 300, 124), 3)]
    assert packing.plan({600: 2, 200: 2, 150: 2, 74: 2}) == [((600, 200, 150, 74), 2)]
    assert packing.plan({512: 4}) == [((512, 512), 2)]
    assert packing.plan({256: 9}) == [((256, 256, 256, 256), 2), ((256,), 1)]
    assert packing.plan({1024: 7, 1: 1}) == [((1024,), 7), ((1,), 1)]


def test_packing_against_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(tokenizer())
    draw = random.Random(1)
    texts = [None, "", " ", "a<|endoftext|>b", "naïve  日本語 😀\n\n x", "word " * 5000, "x" * 30_000, "same", "same"]
    texts += [" ".join(draw.choice(["alpha", "beta", "Γδ", "42"]) for _ in range(draw.randint(1, 900))) for _ in range(150)]
    rows = [(i if i != 5 else None, t, i, "clash", -1) for i, t in enumerate(texts)] + [(7, "same", 7, "clash", -1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece int, LENGTH string, rank long").repartition(4)
    found = packing.pack(df, tokenizer(), ids=True)
    got = found.collect()
    want = Counter()
    for doc, text, *_ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        cuts = [0, len(ids)] if len(ids) <= 1024 else sorted({0, *range(len(ids), -1, -1024)})
        for which, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc, which, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r["sequence_id"]].append((r["offset"], r["length"], r["ids"]))
    for own in held.values():
        own.sort()
        assert [o for o, _, _ in own] == [sum(n for _, n, _ in own[:i]) for i in range(len(own))] and sum(n for _, n, _ in own) <= 1024
    assert len(held) <= -(-sum(r["length"] for r in got) // 1024) + 2
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(found).collect()}
    # The plan is made anew for each reading of the result, from the same written pieces.
    assert whole == {k: [i for _, _, ids in v for i in ids] for k, v in held.items()}
    assert packing.pack(df.where("false"), tokenizer()).count() == 0


def test_encoder_uses_the_files_own_library_where_it_must():
    from tokenizers import Tokenizer

    text = "It's  a test\u0085 of᠎ ids ½ <|endoftext|> end  "
    encoder = packing.Encoder(tokenizer())
    assert encoder.fast is not None and encoder.ids(text) == Tokenizer.from_str(tokenizer()).encode(text, add_special_tokens=False).ids
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        other = file.read()
    assert packing.Encoder(other).fast is None


def brute_codes(rows, entries, rounds=2, parts=16):
    good = [r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1])]
    dims = Counter(len(r[1]) for r in good).most_common(1)[0][0]
    good = sorted((r for r in good if len(r[1]) == dims), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    matrix = np.array([[int(np.floor(256 * x)) for x in r[1]] for r in good]).reshape(len(good), parts, -1)
    books = matrix[:entries].transpose(1, 0, 2).copy()

    def nearest():
        d = ((matrix[:, :, None, :] - books[None]) ** 2).sum(axis=3)
        return d.argmin(axis=2), d.min(axis=2)

    for _ in range(rounds):
        code, _ = nearest()
        for p in range(parts):
            for e in range(books.shape[1]):
                own = matrix[code[:, p] == e, p]
                if len(own):
                    books[p, e] = own.sum(axis=0) // len(own)
    code, error = nearest()
    label = Counter()
    for r, e in zip(good, error.sum(axis=1)):
        label[r[2]] += int(e)
    return Counter((r[0], bytes(c.astype(np.uint8)), int(e), label[r[2]]) for r, c, e in zip(good, code, error.sum(axis=1))), books


@pytest.mark.parametrize("count", [400, 20, 1])
def test_codes_equal_brute_force(spark, count):
    draw = np.random.default_rng(count)
    vectors = np.round(draw.normal(0, 0.1, (count, 64)), 2).astype(np.float32)
    rows = [(int(i * 7 % 1000), [float(x) for x in v], int(i % 3) if i % 4 else None) for i, v in enumerate(vectors)]
    rows += [rows[0]] * 60  # copies
    if count > 20:
        rows[5] = (None, *rows[5][1:])
        rows += [(1, None, 1), (2, [], 1), (3, [0.5] * 63 + [None], 1), (4, [float("nan")] * 64, 1), (5, [float("inf")] + [0.0] * 63, 2), (6, [0.1] * 32, 2)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, CODE string").repartition(3)
    want, books = brute_codes(rows, 64)
    found, own = vector_codes.compress(df)
    assert all((a == b).all() for a, b in zip(own, books))
    assert Counter((r["vec_id"], bytes(r["code"]), r["error"], r["label_error"]) for r in found.collect()) == want
    assert vector_codes.digest(own) == hashlib.sha256(",".join(str(x) for x in books.reshape(-1).tolist()).encode()).hexdigest()
    near = vector_codes.decode(found, own).first()
    assert near["approximate"] == [float(x) / 256 for p, e in enumerate(near["code"]) for x in books[p, e]]


def test_codes_of_nothing_and_of_odd_sizes(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vector_codes.compress(spark.createDataFrame([], schema))[0].count() == 0
    assert vector_codes.compress(spark.createDataFrame([(1, None, 1)], schema))[0].count() == 0
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame([(1, [0.5] * 17, 1)], schema))


def test_search_is_exact_on_ties_and_copies_of_entries():
    draw = np.random.default_rng(0)
    for width in (1, 2, 4):
        entries = draw.integers(-3, 4, (64, width))
        queries = draw.integers(-5, 6, (3000, width))
        best, least = vector_codes.Codebook(entries).nearest(queries)
        d = ((queries[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (best == d.argmin(axis=1)).all() and (least == d.min(axis=1)).all()
