"""Words on which a polynomial hash modulo 2^64 clashes, whatever its odd base, are told apart by every operator."""

import numpy as np
import public_tokenizers
import pyarrow as pa

from orrery.llm import decontamination, kernels, near_dedup, packing, phrase_dedup, suffix_dedup, token_counts

ONE, TWO = ("".join(pair[bin(i).count("1") % 2] for i in range(1024)) for pair in ("ab", "ba"))
TAIL = " ".join(f"t{i}" for i in range(60))


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_hashes_differ():
    words = kernels.words_of(pa.array([ONE, TWO, ONE * 2, TWO * 2]), kernels.NOT_SPACE)
    assert len(np.unique(words.hashes)) == 4


def test_token_ids_and_counts():
    import sentencepiece
    from tokenizers import Tokenizer

    texts = [f"{ONE} {TWO}", ONE, TWO, f"x {TWO} {ONE}"]
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    assert token_counts.count_texts(pa.array(texts), token_counts.pieces(path)).tolist() == [len(library.encode(t)) for t in texts]
    named = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken")).batch(pa.array(texts))
    assert [g.tolist() for g in got] == [named.encode(t, add_special_tokens=False).ids for t in texts]


def test_windows_shingles_and_phrases(spark):
    # 19 and 49 shared words are no window of 20 and 50; with the clashing word they would be.
    a, b = (f"{w} " + " ".join(TAIL.split()[:19]) for w in (ONE, TWO))
    rows = {r.doc_id: r.n_removed for r in phrase_dedup.remove_repeats(frame(spark, [a, b])).collect()}
    assert rows == {0: 0, 1: 0}
    a, b = (f"{w} " + " ".join(TAIL.split()[:49]) for w in (ONE, TWO))
    assert suffix_dedup.repeated_passages(frame(spark, [a, b])).count() == 0
    linked = near_dedup.near_duplicates(frame(spark, [f"{ONE} x y", f"{TWO} x y", f"{ONE}  x y"]), k=3, similarity=85).collect()
    assert sorted((r.doc_id, r.component_id) for r in linked) == [(0, 0), (1, 1), (2, 0)]
    items = frame(spark, [f"{TWO} x y"]).withColumnRenamed("doc_id", "item_id")
    hits = {r.doc_id: r.n_hit for r in decontamination.contamination(frame(spark, [f"{ONE} x y", f"{TWO} x y"]), items).collect()}
    assert hits == {0: 0, 1: 3}


def test_long_texts_without_blanks_are_counted_in_rounds():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list(letters), 200_000)) for letters in ("abcdefghinorst", "的一是不了人我在有他这日本語のは", "ABCDEFabcdef0123456789+/")]
    assert token_counts.count_texts(pa.array(texts), token_counts.pieces(path)).tolist() == [len(library.encode(t)) for t in texts]


def test_ids_are_the_librarys_on_the_table():
    import pyarrow.dataset as ds
    from tokenizers import Tokenizer

    texts = ds.dataset("/root/testdata/sf0.01/documents.parquet").to_table(columns=["text"]).column("text").to_pylist()
    rng = np.random.default_rng(7)
    parts = ["a", "b", "the", " ", "  ", "\n", "\t", "é", "日本", "　", "\u0085", "<|endoftext|>", "'s", "9", "!", "▁"]
    texts += ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(3000)]
    named = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken")).batch(pa.array(texts, pa.string()))
    want = named.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert all(g.tolist() == w.ids for g, w in zip(got, want, strict=True))


def test_near_copies_in_a_dense_group_stay_linear():
    """Twice the group: no more than about twice the links that a task gives back."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(150)]

    def links(n):
        texts = [" ".join(w if rng.random() > 0.02 else f"z{rng.integers(1 << 30)}" for w in base) for _ in range(n)]
        words = kernels.words_of(pa.array(texts), kernels.NOT_SPACE)
        sets = [near_dedup.shingles(own, 3) for _, own in kernels.per_doc(words)]
        table = pa.table({"v": list(range(n)), "component": list(range(n)), "minor": [True] * n, "band": [0] * n, "bands": [[0] * near_dedup.BANDS] * n, "shingles": [kernels.signed(s) for s in sets]})
        found = near_dedup.task_links(table, table, 85)
        group = list(range(n))

        def top(x):
            while group[x] != x:
                x = group[x]
            return x

        for a, b in found:
            assert top(a) != top(b)
            group[top(a)] = top(b)
        for i in range(n):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                    assert top(i) == top(j)
        return len(found)

    assert links(60) < 60 and links(120) < 120
