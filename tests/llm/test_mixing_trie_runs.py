"""Mixing, the conversation trie and periodic runs against brute force, with awkward rows."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import mixing, periodic_runs, prefix_trie

WORD = "[^\\x20\\x09-\\x0D]+"


def brute_runs(words):
    found = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            size = j + q - i
            own = words[i : i + size]
            if size >= max(6, 4 * q) and not any(own[p:] == own[:-p] for p in range(1, q)):
                found.append((i, size, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_runs_of_random_sequences():
    rng = np.random.default_rng(4)
    for n, letters in [(0, 1), (1, 1), (5, 1), (6, 1), (7, 1), *[(int(rng.integers(1, 90)), int(rng.integers(1, 4))) for _ in range(300)]]:
        words = rng.integers(0, letters, n).tolist()
        if n > 20 and rng.random() < 0.5:
            a, p = int(rng.integers(0, n // 2)), int(rng.integers(1, 9))
            words[a:] = [words[a + (i - a) % p] for i in range(a, n)]
        assert periodic_runs.runs_of(words) == brute_runs(words), words


def test_blocks_of_end_positions():
    rng = np.random.default_rng(8)
    ends, seen = periodic_runs._Ends(500), [500]
    ends.MOST  # noqa: B018
    for x in rng.permutation(np.setdiff1d(np.arange(20000), [500])).tolist():
        ends.add(x)
        seen.append(x)
    assert list(ends) == sorted(seen) and len(ends.blocks) > 1
    assert ends.beside(0) == (None, 1) and ends.beside(19999) == (19998, None) and ends.beside(7777) == (7776, 7778)


def run_texts():
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 50, 400)]
    line = "the same line again\n" * 9
    apart = " ".join(base[:30]) + "\nfooter of page here now\n" + " ".join(base[30:80]) + "\nfooter of page here now\n" + " ".join(base[80:90])
    return [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "b a\ta  a a a a a c", line, "x " + line + line.upper(), " ".join(base), " ".join(base + base[:25] * 5 + base), "ab " * 5000, apart, "é é é é é é é", "a b " * 6 + "a c a c a c a c a c", "z" * 100000, " ".join(["u v"] * 4 + ["u"])]


def test_collapsed_texts_are_brute_force(spark):
    texts = run_texts()
    rows = [(i, t, 1, "x", "y") for i, t in enumerate(texts)] + [(None, texts[6], 1, "x", "y"), (6, texts[6], 1, "x", "y"), (6, texts[6], 1, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, runs string, id string").repartition(3)
    got = defaultdict(list)
    for r in periodic_runs.collapse_runs(docs).collect():
        got[r.doc_id].append(r)
    assert sorted((-1 if k is None else k, len(v)) for k, v in got.items()) == [(-1, 1), *[(i, 3 if i == 6 else 1) for i in range(len(texts))]]
    for i, t in enumerate([*texts]):
        words = (t or "").split()
        runs = brute_runs(words) if len(words) < 3000 else [(0, len(words), 1)]
        gone = {p for s, n, q in runs for p in range(s + q, s + n)}
        for r in got[i]:
            assert [(x.start, x.length, x.period) for x in r.runs] == runs
            assert r.collapsed_text == " ".join(w for p, w in enumerate(words) if p not in gone) and r.n_words == len(words)
    assert periodic_runs.collapse_runs(docs.filter("false")).count() == 0


def test_planted_runs_query(spark):
    """The query's rows at the smallest scale: planting, runs and digests."""
    d = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in periodic_runs.op13_periodic_runs(spark, d).collect()}
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        words, h = (r.text or "").split(), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and words:
            g = h // 10
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            words[a:] = [words[a + (i - a) % p] for i in range(a, len(words))]
        # Brute force over all periods is slow on long texts: distances of equal neighbours of four words bound it.
        runs = brute_runs(words) if len(words) < 1500 else periodic_runs.runs_of(np.unique(words, return_inverse=True)[1].tolist())
        gone = {x for s, n, q in runs for x in range(s + q, s + n)}
        top = max(runs, key=lambda x: (x[1], -x[0], -x[2])) if runs else None
        x = got[r.doc_id]
        assert x.n_runs == len(runs) and (x.start, x.length, x.period, x.exponent_milli) == ((top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4)
        assert x.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        assert x.collapsed_sha256 == hashlib.sha256(" ".join(w for p, w in enumerate(words) if p not in gone).encode()).hexdigest()


def brute_trie(sequences):
    """sequences: {conv_id: tuple of (name, bytes)}."""
    members = defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    out = {}
    for prefix, own in members.items():
        below = [p for p in members if p[: len(prefix)] == prefix]
        children = [p for p in below if len(p) == len(prefix) + 1]
        leaves = [p for p in below if not any(len(x) == len(p) + 1 and x[: len(p)] == p for x in below)]
        saved = sum((len(members[p]) - 1) * p[-1][1] for p in below if p)
        ends = sorted(c for c in own if sequences[c] == prefix)
        out[prefix] = (min(own), len(prefix), min(members[prefix[:-1]]) if prefix else None, len(own), len(children), len(leaves), saved, ends)
    return sorted(out.values(), key=str)


@pytest.mark.parametrize("local", [2, 256])
def test_trie_is_brute_force(spark, monkeypatch, local):
    monkeypatch.setattr(prefix_trie, "LOCAL", local)
    rng = np.random.default_rng(local)
    sequences = {}
    for c in range(120):
        n = int(rng.integers(0, 7))
        own = [(int(x), int(x) * 3) for x in rng.integers(0, 3, n)]
        if c % 3 == 0:  # a long shared beginning, and one sequence that holds a third of the rows
            own = [(7, 5)] * 30 + (own if c % 9 else [])
        sequences[c - 20] = tuple(own)
    rows = [(c, [{"id": i, "bytes": b} for i, b in own]) for c, own in sequences.items()]
    frame = spark.createDataFrame(rows, "conv_id long, turns array<struct<id:bigint,bytes:bigint>>").repartition(5)
    nodes, ends = prefix_trie.prefix_trie(frame)
    names = {r.seq: r.members for r in ends.collect()}
    got = [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved, [] if r.seq is None else list(names[r.seq])) for r in nodes.collect()]
    assert sorted(got, key=str) == brute_trie(sequences)
    assert prefix_trie.prefix_trie(frame.filter("false"))[0].count() == 0


def test_trie_of_one_sequence_and_of_none_but_empty_ones(spark):
    kind = "conv_id long, turns array<struct<id:bigint,bytes:bigint>>"
    for own in ([], [(1, 2), (2, 9)]):
        frame = spark.createDataFrame([(c, [{"id": i, "bytes": b} for i, b in own]) for c in (5, 4)], kind)
        got = prefix_trie.prefix_trie(frame)[0].select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved").collect()
        assert sorted(map(tuple, got), key=str) == sorted((x[:7] for x in brute_trie({c: tuple(own) for c in (5, 4)})), key=str)


def test_turns_in_order_with_ties_nulls_and_repeats(spark):
    long = "x" * 70
    rows = [(1, 2, "user", "b"), (1, None, "user", long + "b"), (1, None, "user", long + "a"), (1, 2, "user", "a"), (1, 2, None, None), (1, 2, "user", "a"), (1, 1, long + "r", "q"), (1, 1, long + "q", "z"), (1, 1, "x" * 64, "t"), (1, 1, "x" * 63, "u"), (None, 0, "user", "gone"), (2, 0, "assistant", "a")]
    frame = spark.createDataFrame([(*r, 9, "n") for r in rows], "conv_id long, turn long, role string, text string, id long, name string").repartition(4)
    own, texts = prefix_trie.coded_turns(frame)
    said = {r.id: (r.role, r.text) for r in texts.collect()}
    got = {r.conv_id: [(*said[t.id], t.bytes) for t in r.turns] for r in own.collect()}
    want = sorted((-1 if r[1] is None else r[1], r[2] or "", r[3] or "") for r in rows if r[0] == 1)
    assert got == {1: [(r, t, len(t)) for _, r, t in want], 2: [("assistant", "a", 1)]}
    assert prefix_trie.coded_turns(frame.filter("false"))[0].count() == 0


def test_rebuilt_conversations(spark):
    turns = lambda *ids: [{"id": i, "bytes": i} for i in ids]
    rows = [(c, turns(*range(100 * c, 100 * c + n))) for c, n in ((5, 3), (6, 12), (7, 1), (9, 20), (11, 12), (-3, 4), (0, 9))]
    frame = spark.createDataFrame(rows, "conv_id long, turns array<struct<id:bigint,bytes:bigint>>")
    own = {c: [t["id"] for t in ts] for c, ts in rows}
    for r in prefix_trie.rebuilt(frame).collect():
        c = r.conv_id
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        assert [t.id for t in r.turns] == own.get(base, [])[:h] + own[c][h:]


def mix_brute(sizes, weights=(3, 1, 2), share=1.5, epochs=2):
    """Targets by clamping one source after another."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    clamped = set()
    while True:
        left = share * sum(sizes.values()) - sum(epochs * sizes[s] for s in clamped)
        free = sum(weight[s] for s in order if s not in clamped)
        above = [s for s in order if s not in clamped and weight[s] * left / free > epochs * sizes[s]]
        if not above:
            return {s: float(epochs * sizes[s]) if s in clamped else weight[s] * left / free for s in order}
        clamped.add(above[0])


def test_mix_meets_its_targets(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(3000):
        source = ["a", "B", "é", None, "日", "tiny", ""][min(6, int(rng.exponential(1.2)))]
        rows.append((i, " ".join(["w"] * int(rng.integers(0, 40))), source))
    rows += [(None, "same words here", "hot")] * 1500 + [(7, None, "nothing"), (8, "", "nothing"), (9, " ", None)]
    docs = spark.createDataFrame([(*r, 1, "n") for r in rows], "doc_id long, text string, source string, size int, name string").repartition(6)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.part <= r.size and r.taken == r.whole * r.size + r.part <= 2 * r.size
    want = mix_brute(dict(sizes))
    for s in sizes:
        assert target[s] == pytest.approx(want[s], rel=1e-12)
        # Equal rows share evenly: what cannot be shared is less than a word each.
        assert target[s] - (1500 if s == "hot" else 1) <= taken[s] <= target[s]
    again = mixing.mix(docs.repartition(2)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix(docs.filter("false")).count() == 0 and mixing.mix(docs.filter("source = 'nothing'")).agg(F.sum("taken")).first()[0] == 0


def test_crossing_goes_down_digit_by_digit(spark, monkeypatch):
    rows = [(i, " ".join(["w"] * (i % 30)), "ab"[i % 2]) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(map(str, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "SMALL", 1)
    monkeypatch.setattr(mixing, "STEP", 1)
    assert sorted(map(str, mixing.mix(docs).collect())) == want


def test_repetitions_are_what_is_taken(spark):
    docs = spark.createDataFrame([(i, f" one\ttwo  three {i} " * (i % 4), "s" if i % 3 else "t") for i in range(60)], "doc_id long, text string, source string")
    mixed = mixing.mix(docs)
    got = defaultdict(int)
    for r in mixing.repetitions(docs, mixed).collect():
        got[r.doc_id] += len(r.text.split())
    assert {r.doc_id: r.taken for r in mixed.collect() if r.taken} == {k: n for k, n in got.items() if n}
