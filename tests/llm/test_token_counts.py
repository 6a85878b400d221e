"""Token counts of every prefix against the library that owns the vocabulary."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from labelspark.llm import token_counts
from labelspark.llm.common import REGISTRY

PATH = public_tokenizers.path(token_counts.DEFAULT_VOCABULARY)
#: Letters, digits, signs, marks that compose or reorder, syllable parts, special strings.
SIGNS = [*"aaaabbbeeethinrsoul'''!!..  \n09ABÉéßªİ²½\x1c\xa0", "́", "̣", "̈", "̈́", "é", "가", "ᄀ",
         "ᅡ", "ᆨ", "“", "”", "—", "\U0001f600", "中", "Σ", "ς", "　", "क़", "ﬁ",
         "Ⅷ", "ெ", "ா", "'s", "'re", "'ll", "<|endoftext|>", "<|startoftext|>", "<|end"]


@pytest.fixture(scope="module")
def counter():
    with open(PATH, "rb") as f:
        return token_counts.PrefixTokens(f.read())


@pytest.fixture(scope="module")
def library():
    own = Tokenizer.from_file(PATH)
    return lambda text: len(own.encode(text, add_special_tokens=False).ids)


def test_every_prefix_is_counted_as_by_the_library(counter, library):
    rng = random.Random(7)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 25))) for _ in range(1_500)]
    texts += ["".join(rng.choice("abcdefghilnorstuy") for _ in range(rng.randint(1, 40))) for _ in range(800)]
    texts += ["ab" * 30, "a" * 301, "!" * 50, "ha" * 40, "é" * 40, "'" * 9 + "s"]
    for text in texts:
        want = [library(text[:i]) for i in range(len(text) + 1)]
        assert counter.prefixes(text).tolist() == want, text
        assert counter.count(text) == want[-1], text


def test_documents_are_counted_as_by_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    rows = {r.doc_id: r for r in REGISTRY["op11_token_counts"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        n = library(d.text or "")
        assert rows[d.doc_id][1:] == (len((d.text or "").encode()), n, n > 2048)


def test_questions_are_answered_from_the_tables(spark, library):
    rng = random.Random(2)
    texts = {i: " ".join("".join(rng.choice("abcdehilnorst") for _ in range(rng.randint(1, 9))) for _ in range(60))
             for i in range(8)} | {8: None, 9: ""}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    tables = token_counts.prefix_tables(docs, block=64).persist()
    keyed = docs.withColumn("text_key", F.xxhash64("text"))
    asked = keyed.select("doc_id", "text_key", F.explode(F.array(*map(F.lit, [0, 1, 63, 64, 65, 130, 10_000, None]))).alias(
        "position"))
    for r in token_counts.tokens_at(tables, asked, block=64).collect():
        text = texts[r.doc_id] or ""
        inside = r.position is not None and r.position <= len(text)
        assert r.n_tokens == (library(text[: r.position]) if inside else None)
    for budget in (0, 1, 20, 10_000):
        best = {i: max(j for j in range(len(t or "") + 1) if library((t or "")[:j]) <= budget) for i, t in texts.items()}
        assert {r.doc_id: r.n_chars for r in token_counts.longest_prefixes(tables, budget).collect()} == best
        cut = {r.doc_id: (r.text, r.n_tokens) for r in token_counts.truncate(docs, budget).collect()}
        assert cut == {i: (None if t is None else t[: best[i]], library((t or "")[: best[i]])) for i, t in texts.items()}


def test_odd_rows(spark, odd_docs, no_docs, library):
    rows = odd_docs.select("doc_id", "text").collect()
    found = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(odd_docs).collect())
    assert found == sorted((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()), library(r.text or "")) for r in rows)
    assert token_counts.count_tokens(no_docs).count() == token_counts.prefix_tables(no_docs).count() == 0
    ends = token_counts.prefix_tables(odd_docs).groupBy("doc_id", "text_key").agg(
        F.max(F.col("first") + F.size("counts") - 1).alias("n")).collect()
    assert {(r.doc_id, r.n) for r in ends} == {(r.doc_id, len(r.text or "")) for r in rows}


def test_very_long_texts(spark, library):
    long = ["word " * 1_000_000, "ab" * 300_000, "Ά" * 20_000]
    docs = spark.createDataFrame([*enumerate(long)], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs).collect()} == dict(enumerate(map(library, long)))


def test_other_vocabularies_are_refused(spark, no_docs):
    with pytest.raises(ValueError):
        with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
            token_counts.PrefixTokens(f.read())
