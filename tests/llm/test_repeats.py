"""Rows that are listed twice, rows that share an id, and long or clashing input, for each operator against brute force."""

import math
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from orrery.llm import chat, decontamination, exact_dedup, language_id, near_dedup, packing, token_counts

RNG = np.random.default_rng(31)
WORDS = [f"w{i}" for i in range(300)]


def prose(n):
    return " ".join(RNG.choice(WORDS, n))


LEAK = prose(12)
TEXTS = [(1, prose(50)), (2, prose(50)), (2, prose(60)), (None, prose(30)), (None, None), (3, ""), (4, prose(40) + " " + LEAK), (None, LEAK), (5, prose(3000))]
ROWS = [*TEXTS, *TEXTS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 7, "x") for r in ROWS], "doc_id long, text string, keep_id long, row_key string").repartition(4)


def test_each_row_is_counted(docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs, path).collect())
    assert got == Counter((i, len((t or "").encode()), len(library.encode(t or ""))) for i, t in ROWS)


def test_each_row_is_packed(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    got, want, used = Counter(), Counter(), defaultdict(int)
    for r in rows:
        got[r.doc_id] += r.length
        used[r.sequence_id] += r.length
    for i, t in ROWS:
        want[i] += len(library.encode(t or "", add_special_tokens=False).ids) + 1
    assert got == want and max(used.values()) <= 1024


def test_each_row_is_looked_up(spark, docs):
    items = spark.createDataFrame([(1, LEAK), (1, LEAK)], "item_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit) for r in decontamination.contamination(docs.select("doc_id", "text"), items).collect())
    assert got == Counter((i, len((t or "").split()), 12 if LEAK in (t or "") else 0) for i, t in ROWS)


@pytest.mark.parametrize("carry", [True, False])
def test_each_row_has_its_group(docs, carry):
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs, carry=carry).collect())
    groups = defaultdict(list)
    for i, t in ROWS:
        groups[t or ""].append(i)
    want = Counter()
    for i, t in ROWS:
        own = groups[t or ""]
        top = max((x for x in own if x is not None), default=None)
        want[i, top, len(own), i == top] += 1
    assert got == want


def test_a_hot_group_stays_where_it_is(spark):
    rows = [(i, "" if i % 3 else f"text number {i}") for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    groups = exact_dedup.exact_groups(frame)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in groups.collect()}
    assert got == {i: (2999 if i % 3 else i, 2000 if i % 3 else 1) for i, _ in rows}
    assert "BroadcastHashJoin" in groups._jdf.queryExecution().toString()


def test_pipeline_stages_tell_rows_of_one_id_apart(spark, docs, tmp_path):
    spark.createDataFrame([(1, LEAK)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.drop_benchmark_leaks(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(r for r in ROWS if LEAK not in (r[1] or ""))
    one = spark.createDataFrame([(4, TEXTS[0][1]), (4, TEXTS[1][1]), (9, TEXTS[0][1] + " more"), (None, TEXTS[1][1]), (None, ""), (1 << 62, "")], "doc_id long, text string")
    # Of 4 and 9 the rows with an id of their own come first: 9 stays, and one of the two equal texts.
    left = corpus_pipeline.drop_near_copies(spark, one, str(tmp_path)).collect()
    assert Counter(r.text for r in left) == Counter([TEXTS[0][1] + " more", TEXTS[1][1], "", ""]) or Counter(r.text for r in left) == Counter([TEXTS[0][1], TEXTS[1][1], "", ""])


def test_near_duplicates_of_rows_listed_twice(docs):
    got = Counter((r.doc_id, r.component_id) for r in near_dedup.near_duplicates(docs).collect())
    assert got[1, 1] == 2 and got[2, 2] == 4 and got[5, 5] == 2 and got[None, None] == 6


def test_chat_of_long_texts_extra_columns_and_no_rows(spark):
    long = "<[\\ " * 50_000
    rows = [(1, 1, None, "user", long, 0.5, 9, "x"), (1, 2, 1, "assistant", long, 0.5, 9, "x")]
    messages = spark.createDataFrame(rows, "tree long, id long, parent long, role string, text string, score double, depth int, leaf string")
    done = chat.format_paths(messages, chat.enumerate_paths(messages)).select("tree", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    (r,) = done.collect()
    assert [tuple(t) for t in r.turns] == [("user", long), ("assistant", long)] and r.loss == long
    none = messages.filter("false")
    assert chat.format_paths(none, chat.enumerate_paths(none)).count() == 0
    talks = spark.createDataFrame([(None, None, None, None, 1), (3, 1, "user", "a", 1), (3, 1, "user", "a", 1)], "conv_id long, turn long, role string, text string, tree int")
    own = chat.chain_messages(talks)
    got = chat.format_paths(own, chat.enumerate_paths(own)).select("tree", F.size(chat.read_turns(F.col("formatted"))).alias("n")).collect()
    assert {r.tree: r.n for r in got} == {-(1 << 63): 1, 3: 2}


def letters(text):
    """Lower-cased runs of ASCII letters and of whatever is not ASCII."""
    out, word = [], b""
    for b in text.lower().encode() + b" ":
        if 97 <= b <= 122 or b >= 0x80:
            word += bytes([b])
        elif word:
            out.append(word.decode())
            word = b""
    return out


def grams(word, n):
    chars = f" {word} "
    found = [chars[i : i + n] for i in range(len(chars) - n + 1)]
    return [g for g in found if g != " "] if n == 1 else found


def test_language_scores_are_brute_force(spark):
    rng = np.random.default_rng(2)
    ends = {"aa": ["na", "ma", "la"], "zz": ["ti", "si", "ri"], "ää": ["ño", "öß", "日本"]}
    rows = [(lang, " ".join(rng.choice(["ba", "ki"]) + "".join(rng.choice(own, rng.integers(1, 4))) for _ in range(12))) for lang, own in ends.items() for _ in range(20)]
    rows += [rows[0], (None, "none"), ("aa", None)]
    model = language_id.train(spark.createDataFrame(rows, "lang string, text string"))
    counts = [defaultdict(Counter) for _ in range(language_id.LONGEST + 1)]
    for lang, text in {(a, b) for a, b in rows if a and b}:
        for word in letters(text):
            counts[0][word][lang] += 1
            for n in range(1, language_id.LONGEST + 1):
                for g in grams(word, n):
                    counts[n][g][lang] += 1
    logs = []
    for level in counts:
        known = {k: c for k, c in level.items() if sum(c.values()) >= language_id.KNOWN}
        total = Counter()
        for c in known.values():
            total.update(c)
        logs.append({k: [math.log((c[x] + 0.1) / (total[x] + 0.1 * max(1, len(known)))) for x in sorted(ends)] for k, c in known.items()})

    def score(word):
        if word in logs[0]:
            return logs[0][word]
        for n in range(language_id.LONGEST, 0, -1):
            found = [logs[n][g] for g in grams(word, n) if g in logs[n]]
            if found:
                return np.mean(found, 0)
        return [0.0] * len(ends)

    texts = ["BAna kititi", "xx bamama! kiñoño", "日本", "q", "", None, "123 ...", "nananana tisi xyz é", "ba " * 40_000, "unseenwordla"]
    got = language_id.identify(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string"), model).collect()
    for r in got:
        words = letters(r.text or "")
        if not words:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        unique = Counter(words)
        means = np.sum([np.array(score(w)) * n for w, n in unique.items()], 0) / len(words)
        assert r.score == pytest.approx(1 / np.exp(means - means.max()).sum(), rel=1e-4)
        assert r.lang_pred == sorted(ends)[int(means.argmax())] or np.isclose(np.sort(means)[-1], np.sort(means)[-2])


def test_windows_of_very_frequent_words_go_in_blocks(spark, monkeypatch):
    """Candidate places beyond a block: the same matches as in one block, which a task would hold at once."""
    text = "a b " * 300 + "c " + "b a " * 200
    frame = spark.createDataFrame([(1, text), (2, "a " * 50)], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, "a b a b a b a b a b"), (2, "b c b"), (3, "a " * 12), (4, "b b")], "item_id long, text string")
    index = decontamination.build_index(frame)
    seen = [Counter(map(str, decontamination.matches(index, items, slop=slop).collect())) for slop in (None, 3)]
    query = decontamination.Phrases([(r.item_id, r.text) for r in items.collect()])
    segment = decontamination.Segment(index.collect()[0].asDict(), query)
    whole = [np.concatenate(x) for x in zip(*segment.exact(query), strict=True)]
    monkeypatch.setattr(decontamination, "CANDIDATES", 7)
    blocks = list(segment.exact(query))
    assert len(blocks) > 50 and max(len(b[0]) for b in blocks) <= 7
    assert all((a == b).all() for a, b in zip(whole, (np.concatenate(x) for x in zip(*blocks, strict=True)), strict=True))
    words = text.split()
    assert sum(seen[0].values()) == 4 and len(whole[0]) == sum(words[i : i + 10] == ["a", "b"] * 5 for i in range(len(words))) + 1 + 41 * 3
    assert sum(seen[1].values()) >= 4
