"""Spelling variants against all pairs, plain Python counts, and odd rows."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from labelspark.llm import spelling
from labelspark.llm.common import REGISTRY


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, c in enumerate(a) if c != b[i]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def counted(rows):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def by_pairs(words, ratio=5):
    near = {w: sorted((x for x in words if one_edit(w, x)), key=lambda x: (-words[x], x)) for w in words}
    form = {w: x[0] for w, x in near.items() if x and words[x[0]] >= ratio * words[w]}
    rows = set()
    for w in words:
        root = w
        while root in form:
            root = form[root]
        rows.add((w, form.get(w), root, words[w], len(near[w]), words.get(form.get(w))))
    return rows


def family(seed, n):
    """Words around few stems, many with one common beginning or end."""
    rng, letters = random.Random(seed), "abcé÷ÿ"
    stems = ["common" + "".join(rng.choice(letters) for _ in range(k)) for k in (1, 2, 3, 9)]
    stems += ["".join(rng.choice(letters) for _ in range(k)) + "ending" for k in (1, 2, 5)] + ["a", "ab", "aaaaaa", "x" * 300]
    words = set(stems)
    while len(words) < n:
        w = rng.choice(sorted(words))
        i = rng.randrange(len(w) + 1)
        words.add(rng.choice([w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :], w[:i] + w[i + 1 :]]) or "b")
    return {w: rng.choice([5, 6, 30, 31, 900, 20_000]) for w in words}


def test_near_words_are_those_of_all_pairs(spark):
    for seed, bound in [(1, 1024), (2, 3), (3, 0)]:
        words = family(seed, 500)
        frame = spark.createDataFrame([*words.items()], "word string, n long")
        links = [(r.a, r.b) for r in spelling.near_words(frame, pairs=bound).collect()]
        assert len(links) == len(set(links)) == len({frozenset(x) for x in links})
        assert {frozenset(x) for x in links} == {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}


def test_forms_and_roots_are_those_of_all_pairs(spark):
    words = family(5, 400) | {"chainaaa": 5, "chainaab": 25, "chainabb": 125, "chainbbb": 625, "chainbbbb": 3125}
    frame = spark.createDataFrame([*words.items()], "word string, n long").withColumn("near", F.lit("own"))
    assert {tuple(r) for r in spelling.variants(frame).collect()} == by_pairs(words)


def test_a_common_chunk_is_lengthened_until_few_share_it(spark):
    rng = random.Random(8)
    words = {"".join(["shared", *(rng.choice("abcdefghijklmnop") for _ in range(6))]): 5 for _ in range(3_000)}
    frame = spark.createDataFrame([*words.items()], "word string, n long")
    slots = {}
    for w in words:  # one length: near words differ at one place
        for i in range(len(w)):
            slots.setdefault(w[:i] + "*" + w[i + 1 :], []).append(w)
    want = {frozenset((a, b)) for s in slots.values() for a in s for b in s if a < b}
    assert {frozenset((r.a, r.b)) for r in spelling.near_words(frame).collect()} == want


def test_documents_are_counted_as_in_plain_python(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {tuple(r) for r in REGISTRY["op12_spelling_variants"](spark, sf).collect()} == by_pairs(counted(docs))


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    made = {r.word: r.n for r in spelling.word_counts(odd_docs).collect()}
    assert made == counted(rows)
    assert {r.word for r in spelling.spelling_variants(odd_docs).collect()} == set(made)
    assert spelling.spelling_variants(no_docs).count() == 0
    few = spark.createDataFrame([(1, "ab Cd é"), (None, None)], "doc_id long, text string")
    assert spelling.spelling_variants(few).count() == 0


def test_very_long_texts(spark):
    rows = [(1, "Wordes words " * 500_000), (2, "b" * 1_000_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.word: r.n for r in spelling.word_counts(frame, least_count=1).collect()} == {
        w: n for w, n in Counter(re.findall("[a-z]+", " ".join(t for _, t in rows).lower())).items() if len(w) >= 6}
