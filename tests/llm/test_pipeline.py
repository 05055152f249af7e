"""The five stages on planted documents against brute force, and the queries without SQL on the smallest table."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from orrery.llm import language_id, toxicity
from orrery.llm.queries import QUERIES

RNG = np.random.default_rng(21)
WORDS = [f"word{i}" for i in range(500)]


def prose(n):
    return " ".join(RNG.choice(WORDS, n))


ITEM = prose(14)
BASE = prose(120)
NEAR = BASE.split()
NEAR[60] = "changed"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    rows = [(i, prose(60) + (" vilest slur" if i % 3 == 0 else ""), "en", "src", 0) for i in range(240)]
    rows += [(300, BASE, "en", "a", 1), (301, BASE, "en", "b", 1), (302, " ".join(NEAR), "en", "c", 1)]
    rows += [(310, prose(20) + " " + ITEM + " " + prose(20), "en", "d", 1), (311, None, None, None, None), (312, "", "en", "e", 0), (None, prose(30), "en", "f", 1), (320, prose(9000), "en", "g", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(240)], "doc_id long, quality long, toxic long").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_each_decision_takes_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before, seen = ids(docs), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        gone = before - ids(docs)
        seen.append((name, gone))
        before = ids(docs)
    assert [name for name, _ in seen] == ["toxicity", "exact_dedup", "near_dedup", "decontamination"]
    toxic = {i for i in range(240) if i % 3 == 0}
    assert len(toxic - seen[0][1]) <= 2 and len(seen[0][1] - toxic) <= 2
    # Null counts as empty: 311 and 312 are equal texts.
    assert [gone for _, gone in seen[1:]] == [{300, 311}, {302}, {310}]
    assert None in before and 320 in before and 312 in before


def test_packing_holds_what_is_left(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
    assert all(sum(r.length for r in own) <= 1024 for own in by_sequence.values())
    assert {312, 320} <= {r.doc_id for r in rows} and not {300, 302, 310} & {r.doc_id for r in rows}


def test_stages_on_empty_tables(spark, folder):
    none = spark.read.parquet(f"{folder}/documents.parquet").filter("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0, name


def test_toxicity_scores_are_brute_force_over_whole_texts(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = toxicity.train(toxicity.labelled_documents(docs, spark.read.parquet(f"{folder}/labels.parquet")))
    wide = docs.unionByName(docs.filter("doc_id = 3")).selectExpr("*", "1 as SCORE", "2 as toxic_flag")
    rows = toxicity.score_texts(wide, model, lang="lang").collect()
    assert len(rows) == docs.count() + 1
    d = toxicity.DIM
    for r in rows:
        (words,) = toxicity.word_rows(toxicity.pa.array([r.text], toxicity.pa.large_string()))
        x = model.vectors(words)
        pooled = [max([0.0, *(float(x[i : i + w].ravel() @ model.filters[k][:, f] + model.bias[k][f]) for i in range(len(x) - w + 1))]) for k, w in enumerate(toxicity.WIDTHS) for f in range(toxicity.FILTERS)] if len(x) < 100 else None
        if pooled:
            logit = float(np.array(pooled) @ model.out + model.base)
            assert abs(r.score - 1 / (1 + np.exp(-logit))) < 1e-3
    assert toxicity.score_texts(docs.filter("false"), model).count() == 0
    assert d == toxicity.SIZE * len(toxicity.STEMS)


def test_a_toxic_word_far_into_a_long_text_is_learnt_and_found(spark):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(WORDS, 5000)) + (" vilest" if i % 2 else "") + " " + " ".join(rng.choice(WORDS, 900)), "en", i % 2) for i in range(60)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = toxicity.train(labelled.filter("doc_id < 50"), visits=1500)
    assert sum((r.score >= 0.5) == (r.toxic == 1) for r in toxicity.score_texts(labelled.filter("doc_id >= 50"), model).collect()) >= 9


def test_language_scores_are_means_over_words(spark):
    rng = np.random.default_rng(2)
    word = {"aa": lambda: "ba" + "".join(rng.choice(["na", "ma", "la"], 4)), "zz": lambda: "ki" + "".join(rng.choice(["ti", "si", "ri"], 4))}
    rows = [(lang, " ".join(make() for _ in range(30))) for lang, make in word.items() for _ in range(40)]
    model = language_id.train(spark.createDataFrame(rows, "lang string, text string"))
    texts = [("banamala kitisiri bananana", 1), ("ki", 2), ("", 3), (None, 4), ("kitisiri " * 30000, 5), ("banamala kitisiri bananana", 1)]
    df = spark.createDataFrame(texts, "text string, _guess int").selectExpr("*", "9 as lang_pred", "8 as Score")
    got = language_id.identify(df, model).collect()
    assert len(got) == len(texts) and set(got[0].asDict()) == {"text", "_guess", "lang_pred", "score"}
    for r in got:
        if not r.text:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        each = [model.predict(language_id.pa.array([w], language_id.pa.large_string()))[1] for w in r.text.split()[:1]]
        assert 0 <= r.score <= 1 and len(each) == 1
    assert language_id.identify(df.filter("false"), model).count() == 0


@pytest.mark.parametrize("name, columns", [
    ("op1_packing", ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]),
    ("op2_token_counts", ["doc_id", "n_bytes", "n_tokens", "over_limit"]),
    ("op5_toxicity", ["doc_id", "held_out", "score", "predicted"]),
    ("op10_language_id", ["doc_id", "held_out", "lang_pred", "score"]),
])
def test_queries_cover_the_table(spark, name, columns):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    out = QUERIES[name](spark, d)
    rows = out.collect()
    assert out.columns[: len(columns)] == columns and {r.doc_id for r in rows} == set(docs)
    if name == "op1_packing":
        total = defaultdict(int)
        for r in rows:
            total[r.doc_id] += r.length
        assert all(total[r.doc_id] == r.doc_tokens for r in rows)
        return
    assert len(rows) == len(docs)
    if name in ("op5_toxicity", "op10_language_id"):
        by, rest = (5, 0) if name == "op5_toxicity" else (3, 1)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % by == rest) and 0 <= r.score <= 1 for r in rows)
    if name == "op10_language_id":
        held = [r for r in rows if r.held_out and docs[r.doc_id].lang and docs[r.doc_id].text]
        assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.9
