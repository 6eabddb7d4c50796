import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from cohortline.llm import bpe
from cohortline.llm.bpe import Vocabulary, encode, merge_long, read_ranks
from tests.llm.fixtures import documents, none

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary(spark):
    return Vocabulary(spark, read_ranks(PATH), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def test_ids_and_bytes_equal_the_library(spark, vocabulary, library):
    docs, rows = documents(spark, 25)
    coded = encode(docs, vocabulary, frequent_words=50)
    assert coded.columns == ["row", "ids"] and coded.select("row.*").columns == docs.columns
    got = coded.select("row.text", "ids", F.sha2(vocabulary.decoded(F.col("ids")), 256).alias("sha")).collect()
    assert len(got) == len(rows)
    for r in got:
        text = r.text or ""
        assert r.ids == library.encode_ordinary(text), text[:50]
        assert r.sha == hashlib.sha256(text.encode()).hexdigest()


def test_marks_of_the_literal_maps_in_texts(spark, vocabulary, library):
    words = ["ereinauie", "Thenndes"]
    texts = [*words * 2, "ereinauie\x01Thenndes\x02 \x03", "\x01ereinauie\x02", "Thenndes\x011,2\x01ereinauie", "\x03"]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.ids for r in encode(docs, vocabulary).select("row.doc_id", "ids").collect()}
    assert got == {i: library.encode_ordinary(x) for i, x in enumerate(texts)}


def test_empty_table(spark, vocabulary):
    assert encode(none(spark), vocabulary).count() == 0


def test_long_words_by_heap(library):
    ranks = read_ranks(PATH)
    for word in ("a" * 3000, "thention" * 200, "é" * 77, "x"):
        assert merge_long(word.encode(), ranks) == library.encode_ordinary(word)


def test_single_bytes_are_needed(spark):
    with pytest.raises(ValueError):
        Vocabulary(spark, {b"a": 0}, ".")


def test_words_are_merged_once_a_batch(library, monkeypatch):
    """Repeated words of a batch cost one merge, and a slice of a larger array gives its own lists only."""
    ranks, merged = read_ranks(PATH), []
    plain = bpe.merge
    monkeypatch.setattr(bpe, "WORDS_AT_ONCE", 2)
    monkeypatch.setattr(bpe, "merge", lambda word, r: merged.append(word) or plain(word, r))
    texts = [["dropped"], [], ["ereinauie", " é", "ereinauie"], ["x" * 300, "", " é"], ["known", "ereinauie"]]
    got = bpe.merge_texts(pa.array(texts).slice(1), ranks, {"known": np.array([1, 2], np.int32).tobytes()}).to_pylist()
    assert got == [[i for w in t for i in ([1, 2] if w == "known" else library.encode_ordinary(w))] for t in texts[1:]]
    assert sorted(merged) == sorted(w.encode() for w in {"ereinauie", " é", "x" * 300, ""})
    assert bpe.merge_texts(pa.array([], pa.list_(pa.string())), ranks, {}).to_pylist() == []


def test_merge_equals_the_library(library):
    ranks = read_ranks(PATH)
    for word in ("ereinauie", " Thenndes", "aaaaaaaaaaaaaaaa", "éàü\U0001f600", "x", "thention" * 15, "\x00\x01"):
        assert bpe.merge(word.encode(), ranks) == merge_long(word.encode(), ranks)


def test_no_fold_is_left_in_the_plan(spark, vocabulary):
    """A fold copies its state at every lambda, some hundred microseconds a word."""
    docs, _ = documents(spark, 5)
    plan = encode(docs, vocabulary)._jdf.queryExecution().analyzed().toString().lower()
    assert "aggregate(" not in plan and "substring_index" not in plan
