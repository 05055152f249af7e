"""Every operator on a small table of awkward rows (null, empty, repeated, long, clashing columns), against brute force."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from orrery.llm import chat, decontamination, exact_dedup, language_id, near_dedup, packing, phrase_dedup, suffix_dedup, token_counts, toxicity

RNG = np.random.default_rng(3)
WORDS = [f"w{i}" for i in range(400)]


def text(n, rng=RNG):
    return " ".join(rng.choice(WORDS, n))


PASSAGE = text(60)
BASE = text(300)
TEXTS = [None, "", " ", "one", "One\ttwo", PASSAGE, text(40) + " " + PASSAGE + " " + text(30), text(25) + "\n" + PASSAGE, BASE, BASE, BASE.replace(" ", "\n", 3), BASE + " tail words here", "a " * 70, text(20000), "x" * 3000, "日本 語 ▁ é <|endoftext|> </s>"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "src", 0, "kept", 1.0) for i, t in enumerate(TEXTS)] + [(None, "lost id", None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, recipe string, score double").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.filter("false")


def test_packing_places_each_id_once(docs, empty):
    from tokenizers import Tokenizer

    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {i: library.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(TEXTS)}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for i, ids in want.items():
        assert sum(r.length for r in by_doc[i]) == len(ids)
        for r in by_doc[i]:
            assert r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert packing.pack(empty, public_tokenizers.path("byte_bpe_50k.tiktoken")).count() == 0


def test_column_generation_meets_demand_with_little_waste():
    sizes, counts = np.unique(np.minimum(RNG.geometric(1 / 40, 3000), 128), return_counts=True)
    demand = dict(zip(sizes.tolist(), counts.tolist(), strict=True))
    made = defaultdict(int)
    plan = packing.pack_histogram(demand, 256)
    for pattern, times in plan:
        assert sum(k * v for k, v in pattern.items()) <= 256
        for k, v in pattern.items():
            made[k] += v * times
    assert made == demand
    assert sum(t for _, t in plan) <= 1.02 * (sizes * counts).sum() / 256 + 1


def test_token_counts_are_the_librarys(docs, empty):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = {r.doc_id: r for r in token_counts.token_counts(docs, path).collect()}
    for i, t in enumerate(TEXTS):
        n = len(library.encode(t or ""))
        assert (rows[i].n_tokens, rows[i].n_bytes, rows[i].over_limit) == (n, len((t or "").encode()), n > 4096)
    assert token_counts.token_counts(empty, path).count() == 0


def test_chat_round_trip_and_best_branch(spark):
    hard = "a \\ < [ [/TURN][ROLE] </s>[INST] \\[ <\\"
    rows = [(1, 1, None, "user", hard, 0.0), (1, 2, 1, "assistant", hard, 1.0), (1, 3, 1, "assistant", "worse", 0.5), (1, 4, 2, "user", None, 0.0), (2, 1, 9, "assistant", "", 0.0), (3, 1, 2, "user", "cycle", 0.0), (3, 2, 1, "user", "cycle", 0.0)]
    messages = spark.createDataFrame(rows, "tree long, id long, parent long, role string, text string, score double")
    paths = chat.enumerate_paths(messages)
    got = {r.tree: r for r in chat.format_paths(messages, paths).select("*", chat.read_turns(chat.F.col("formatted")).alias("turns"), chat.read_loss(chat.F.col("formatted"), chat.F.col("loss_spans")).alias("loss")).collect()}
    assert [tuple(t) for t in got[1].turns] == [("user", hard), ("assistant", hard), ("user", "")]
    assert got[1].loss == hard and got[1].leaf == 4
    assert [tuple(t) for t in got[2].turns] == [("assistant", "")] and 3 not in got
    every = chat.enumerate_paths(messages, best=None).filter("tree = 1").collect()
    assert sorted((r.leaf, r.id) for r in every) == [(3, 1), (3, 3), (4, 1), (4, 2), (4, 4)]


def test_suffix_array_finds_shared_passages(docs, empty):
    got = defaultdict(set)
    for r in suffix_dedup.repeated_passages(docs).collect():
        got[r.doc_id].update(range(r.start, r.stop))
    seen, want = defaultdict(list), defaultdict(set)
    for i, t in enumerate(TEXTS):
        words = (t or "").split()
        for p in range(len(words) - 49):
            seen[tuple(words[p : p + 50])].append((i, p))
    for places in seen.values():
        if len(places) > 1:
            for i, p in places:
                want[i].update(range(p, p + 50))
    assert got == want
    assert suffix_dedup.repeated_passages(empty).count() == 0


def test_toxicity_learns_words_and_handles_one_label(spark, docs):
    rng = np.random.default_rng(1)
    rows = [(i, text(60, rng) + (" vilest" if i % 3 == 0 else ""), "en", int(i % 3 == 0)) for i in range(300)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = toxicity.train(labelled.filter("doc_id < 240"), visits=3000)
    scored = toxicity.score_texts(labelled.filter("doc_id >= 240"), model, lang="lang").collect()
    assert sum((r.score >= 0.5) == (r.toxic == 1) for r in scored) >= 57
    assert all(0 <= r.score <= 1 for r in toxicity.score_texts(docs, model).collect())
    lone = toxicity.train(labelled.filter("toxic = 0"))
    assert max(r.score for r in toxicity.score_texts(docs, lone).collect()) < 0.5


def test_decontamination_exact_and_near(spark, docs, empty):
    words = TEXTS[6].split()
    items = spark.createDataFrame([(5, " ".join(words[45:57])), (12, "ONE"), (7, None), (8, "..."), (12, "ONE")], "item_id long, text string")
    rows = {r.doc_id: r for r in decontamination.contamination(docs, items).collect()}
    assert rows[6].n_hit == 12 and rows[6].items == ["5"] and rows[5].n_hit == 12
    assert rows[3].items == ["12"] and rows[4].n_hit == 1 and rows[0].n_words == 0 and rows[8].n_hit == 0
    index = decontamination.build_index(docs)
    shuffled = spark.createDataFrame([(1, " ".join(reversed(words[45:55])))], "item_id long, text string")
    assert decontamination.matches(index, shuffled).count() == 0
    assert decontamination.matches(index, shuffled, slop=10).count() > 0
    assert decontamination.contamination(empty, items).count() == 0


def test_phrase_dedup_is_brute_force(docs, empty):
    rows = {r.doc_id: r for r in phrase_dedup.remove_repeats(docs).collect()}
    seen = set()
    for i, t in enumerate(TEXTS):
        words = (t or "").encode().split()
        gone = set()
        for p in range(len(words) - 19):
            window = tuple(words[p : p + 20])
            if window in seen:
                gone.update(range(p, p + 20))
            seen.add(window)
        kept = [w for p, w in enumerate(words) if p not in gone]
        assert (rows[i].n_words, rows[i].n_removed) == (len(words), len(gone))
        assert hashlib.sha256(rows[i].kept_text.encode()).digest() == hashlib.sha256(b" ".join(kept)).digest()
    assert phrase_dedup.remove_repeats(empty).count() == 0


def test_near_dedup_is_brute_force(spark, docs, empty):
    rng = np.random.default_rng(9)
    base = text(120, rng).split()
    many = [" ".join(w if rng.random() > 0.02 else "z" + str(rng.integers(1000)) for w in base) for _ in range(60)]
    rows = list(enumerate([*TEXTS, *many]))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in near_dedup.near_duplicates(frame, k=3, similarity=85).collect()}
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                both = len(sets[i] & sets[j])
                if sets[i] and sets[j] and label[i] != label[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    assert [(got[i].n_shingles, got[i].component_id) for i, _ in rows] == [(len(sets[i]), label[i]) for i in range(len(rows))]
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.near_duplicates(docs).count() == len(TEXTS) + 1


def test_odd_sketch_tells_similar_from_not():
    a = np.unique(RNG.integers(0, 2**63, 800, dtype=np.uint64))
    for share, near in ((0.96, True), (0.4, False)):
        k = int(len(a) * share)
        b = np.unique(np.concatenate([a[:k], RNG.integers(0, 2**63, len(a) - k, dtype=np.uint64)]))
        x, y = (near_dedup.odd_sketch(near_dedup.samples(s)).view(np.uint64) for s in (a, b))
        assert (int(np.bitwise_count(x ^ y).sum()) <= near_dedup.most_bits(0.85)) == near


@pytest.mark.parametrize("clash", [False, True])
def test_exact_dedup_also_when_identifiers_clash(docs, empty, clash):
    from pyspark.sql import functions as F

    name = (lambda c: F.unhex(F.substring(F.md5(c), 1, 1))) if clash else exact_dedup.identifier
    out = exact_dedup.exact_groups(docs, name=name)
    assert out.columns == [*docs.columns, "keep_id", "group_size", "kept"]
    rows = {r.doc_id: r for r in out.collect()}
    for i, t in enumerate(TEXTS):
        same = [j for j, u in enumerate(TEXTS) if (u or "") == (t or "")]
        assert (rows[i].keep_id, rows[i].group_size, rows[i].kept) == (max(same), len(same), i == max(same))
    assert rows[None].kept and exact_dedup.exact_groups(empty).count() == 0


def test_chunks_join_to_the_text(docs):
    rows = docs.select("text", exact_dedup.F.array_join(exact_dedup.chunks(exact_dedup.F.col("text")), "").alias("joined")).collect()
    assert all(r.text == r.joined for r in rows)


def test_language_falls_back_to_ngrams(spark, docs):
    rng = np.random.default_rng(2)
    word = {"aa": lambda: "ba" + "".join(rng.choice(["na", "ma", "la"], 4)), "zz": lambda: "ki" + "".join(rng.choice(["ti", "si", "ri"], 4))}
    rows = [(lang, " ".join(make() for _ in range(30))) for lang, make in word.items() for _ in range(40)]
    model = language_id.train(spark.createDataFrame([*rows, (None, "x"), ("aa", None)], "lang string, text string"))
    tests = spark.createDataFrame([("aa", "banamalamala unmalana"), ("zz", "Kitisiriri untisi"), ("und", None), ("und", "123 ?!")], "want string, text string")
    assert all(r.want == r.lang_pred and 0 <= r.score <= 1 for r in language_id.identify(tests, model).collect())
    assert {r.lang_pred for r in language_id.identify(docs, None).collect()} == {"und"}


def test_kernels_agree_with_split():
    from orrery.llm import kernels as K

    column = pa.array(["a  b\tc", None, "", " lead", "trail \n", "é ü"])
    words = K.words_of(column, K.NOT_SPACE)
    assert np.diff(words.first).tolist() == [len((t or "").encode().split()) for t in column.to_pylist()]
