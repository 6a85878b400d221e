"""Block-max retrieval, fusion and the clustered backend against plain Python over all passages."""

import math
import random
import re
from pathlib import Path

import numpy as np
import pytest

from labelspark import fixed_values as V
from labelspark.operators import clusters, dense, evaluation, postings, retrieval
from labelspark.session import scratch_path

CORPUS = ("doc_id long, ordinal long, text string, heading string, section string, "
          "paragraph string, beverage_type string, source_url string")


def corpus_frame(spark, texts):
    return spark.createDataFrame([(1000 - i, i, t, "", f"s{i}", "", "all", "u") for i, t in enumerate(texts)], CORPUS)


def folded(w):
    return w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w


def ranked_by_hand(texts, questions):
    """{question: [(matched, bm25, ordinal), ...]} over all passages, best first."""
    raw = [re.findall("[a-z0-9.]+", (t or "").lower()) for t in texts]
    docs = [[folded(w) for w in r] for r in raw]
    content = [{folded(w) for w in r if len(w) > 1 and w not in V.STOPWORDS} for r in raw]
    n, avgdl = len(docs), sum(map(len, docs)) / len(docs)
    df = {}
    for d in docs:
        for t in set(d):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(n - c + 0.5) - math.log(c + 0.5) for t, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: 0.25 * mean if x < 0 else x for t, x in idf.items()}
    out = {}
    for q, text in questions.items():
        words = re.findall("[a-z0-9.]+", text.lower())
        asked = {folded(w) for w in words if len(w) > 1 and w not in V.STOPWORDS}
        rows = []
        for i, d in enumerate(docs):
            score = sum(idf.get(folded(w), 0) * d.count(folded(w)) * 2.5 / (
                d.count(folded(w)) + 1.5 * (0.25 + 0.75 * len(d) / avgdl)) for w in words)
            rows.append((len(asked & content[i]), round(score, 9), i))
        out[q] = sorted(rows, key=lambda r: (-r[0], -r[1], r[2]))
    return out, mean


def wordy(seed, n, words=40):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(words)] + ["the", "of", "and", "a"]
    weights = [1 / (1 + i) for i in range(words)] + [1, 1, 1, 1]
    texts = [" ".join(rng.choices(pool, weights, k=rng.randint(0, 25))) for _ in range(n)] + [None, ""]
    return texts, {i: " ".join(rng.choices(pool, k=rng.randint(0, 7))) for i in range(25)} | {98: "", 99: "nothing known"}


@pytest.fixture(scope="module")
def searched(spark):
    texts, questions = wordy(4, 300)
    index = retrieval.build_index(corpus_frame(spark, texts))
    asked = spark.createDataFrame([*questions.items()], "query_id long, question string")
    return texts, questions, index, asked


def test_top_k_is_that_of_all_passages(searched, monkeypatch):
    texts, questions, index, asked = searched
    want, _ = ranked_by_hand(texts, questions)
    for k, first in ((1, 1_000), (7, 5), (400, 50)):  # the last is more than the corpus holds
        monkeypatch.setattr(postings, "FIRST_POSTINGS", first)
        made = {q: [] for q in questions}
        for r in retrieval.retrieve(index, asked, k).orderBy("query_id", "rank").collect():
            assert r.doc_id == 1000 - r.ordinal
            made[r.query_id].append((r.matched, round(r.bm25, 6), r.ordinal))
        assert made == {q: [(m, round(s, 6), o) for m, s, o in rows[:k]] for q, rows in want.items()}


def test_many_passages_are_looked_up_in_the_term_table(searched, monkeypatch):
    texts, questions, index, asked = searched
    want, _ = ranked_by_hand(texts, questions)
    monkeypatch.setattr(postings, "FEW", 0)
    made = {q: [] for q in questions}
    for r in retrieval.retrieve(index, asked, 7).orderBy("query_id", "rank").collect():
        made[r.query_id].append((r.matched, round(r.bm25, 6), r.ordinal))
    assert made == {q: [(m, round(s, 6), o) for m, s, o in rows[:7]] for q, rows in want.items()}


def test_unwanted_pairs_are_dropped_before_an_exchange(searched, spark, monkeypatch):
    """What a task sends is what is wanted, also of passages in several parts of the corpus."""
    _, questions, index, asked = searched
    monkeypatch.setattr(postings, "FEW", 0)
    monkeypatch.setattr(postings, "PART", 16)
    terms = postings.asked_terms(index, retrieval.query_terms(asked))
    wanted = spark.createDataFrame([(q, o) for q in questions for o in (q, 100 + q, 301)], "query_id long, ordinal long")
    every = {(r.query_id, r.ordinal): (r.bm25, r.matched) for r in postings.score_all(index, terms).collect()}
    places = {(r.query_id, r.ordinal) for r in wanted.collect()}
    pairs = postings._pairs(index, terms, wanted)
    assert {(r.query_id, r.ordinal) for r in pairs.collect()} == places & set(every)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.index("hashpartitioning(query_id") < plan.index("array_contains(places")  # from the end to the start
    for parts in (0, 1_000):
        monkeypatch.setattr(postings, "FEW_PARTS", parts)
        made = postings.score_places(index, terms, wanted)
        assert {(r.query_id, r.ordinal): (r.bm25, r.matched) for r in made.collect()} == {
            p: every.get(p, (0.0, 0)) for p in places}


def test_pairs_of_other_blocks_are_dropped_before_an_exchange(searched, spark, monkeypatch):
    """What a search sends of many kept blocks are their passages only; the rest of the corpus stays where it is."""
    _, questions, index, asked = searched
    monkeypatch.setattr(postings, "PART", 16)
    terms = postings.asked_terms(index, retrieval.query_terms(asked))
    every = {(r.query_id, r.ordinal): (round(r.score, 9), r.matched) for r in postings._pairs(index, terms).collect()}
    kept = spark.createDataFrame([(q, b) for q in questions for b in (q % 3, 4)], "query_id long, block long")
    blocks = {tuple(r) for r in kept.collect()}
    pairs = postings._pairs(index, terms, kept)
    assert {(r.query_id, r.ordinal): (round(r.score, 9), r.matched) for r in pairs.collect()} == {
        (q, o): x for (q, o), x in every.items() if (q, o // postings.BLOCK) in blocks}
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert plan.index("hashpartitioning(query_id") < plan.index("array_contains(places")  # from the end to the start


def test_postings_hold_no_numbers_they_share_with_their_block(spark):
    """The postings are most of the index: a posting is its place in the block, its counts and what it is."""
    index = retrieval.build_index(corpus_frame(spark, ["red wine", *["dry"] * 130, "red red"]))
    fields = index.postings.schema["list"].dataType.elementType.fieldNames()
    assert fields == ["place", "dl", "tf", "content"]
    assert sorted(tuple(r) for r in index.entries().where("term = 'red'").select("ordinal", "dl", "tf").collect()) == [
        (0, 2, 1), (131, 2, 2)]


def test_rare_terms_are_looked_for_in_the_top_passage(spark):
    index = retrieval.build_index(corpus_frame(spark, ["red wine", *["dry"] * 70, "dry gin"]))
    asked = spark.createDataFrame([(1, "gin"), (2, "gin"), (3, "dry")], "query_id long, question string")
    tops = spark.createDataFrame([(1, 929), (2, 1000), (3, 1000)], "query_id long, doc_id long")  # ordinals 71, 0, 0
    assert [r.query_id for r in retrieval.unfaithful_queries(index, asked, tops, 1).collect()] == [2]


def test_hits_are_sent_to_the_corpus(searched, spark):
    """No exchange carries the texts of the corpus to the few passages that are cited."""
    _, _, index, asked = searched
    done = retrieval.answer(index, asked.selectExpr("query_id", "question", "'' beverage_type"))
    golden = asked.selectExpr("query_id", "concat('s', query_id) section")
    plan = evaluation.retrieval_cases(golden, done, index.corpus)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"BroadcastHashJoin \[doc_id#\d+L\], \[doc_id#\d+L\], LeftSemi", plan)
    assert plan.count("BroadcastHashJoin [doc_id") >= 2


def test_many_looked_up_rules_are_not_broadcast(spark, own_index, monkeypatch):
    rows = spark.createDataFrame(
        [(f, "government_warning", f == "b", f"wording of the warning differs {f}") for f in "abc"]
        + [("d", "alcohol_content", False, None)], "filename string, field string, passed boolean, detail string")
    made = {}
    for limit, join in ((1_000, "BroadcastHashJoin [query_id"), (0, "SortMergeJoin [query_id")):
        monkeypatch.setattr(retrieval, "RULES", limit)
        frame = retrieval.attach_regulations(own_index, rows)
        assert join in frame._jdf.queryExecution().executedPlan().toString()
        made[limit] = sorted(map(tuple, frame.select("filename", "field", "passed", "rule").collect()))
    assert made[0] == made[1_000] and len(made[0]) == 4 and {r[0] for r in made[0] if r[3]} >= {"a", "c"}


def test_term_counts_need_no_postings(spark):
    index = retrieval.build_index(corpus_frame(spark, ["red wine wine", "red", None]))
    assert {r.term: (r.df, r.content_df) for r in index.vocab.collect()} == {"red": (2, 2), "wine": (1, 1)}
    asked = spark.createDataFrame([(1, "red gin")], "query_id long, question string")
    assert [r.term for r in retrieval.distinguishing_terms(index, asked).collect()] == ["gin"]
    assert [r.doc_id for r in retrieval.score_pairs(index, asked).orderBy("ordinal").collect()] == [1000, 999]
    folders = {p.name for p in Path(index.path.removeprefix("file:")).iterdir()}
    assert "terms" in folders and "postings" not in folders
    assert index.postings.count() == 2 and retrieval.retrieve(index, asked, 4).count() == 3


def test_passages_that_score_below_zero_follow_untouched_ones(spark, monkeypatch):
    """Terms in nearly every passage: the mean idf is below zero, and so are scores."""
    rng = random.Random(5)
    common = [f"c{i}" for i in range(8)]
    texts = [" ".join(w for w in common if rng.random() < 0.85) for _ in range(160)] + ["of the rare"]
    questions = {0: "the", 1: "c1 the", 2: "of c3", 3: "c1 c2 c3 c4", 4: "rare c5", 5: "unknown"}
    texts[3] = texts[90] = "of of"
    want, mean = ranked_by_hand(texts, questions)
    assert mean < 0
    index = retrieval.build_index(corpus_frame(spark, texts))
    asked = spark.createDataFrame([*questions.items()], "query_id long, question string")
    for k in (2, 90):
        made = {q: [] for q in questions}
        for r in retrieval.retrieve(index, asked, k).orderBy("query_id", "rank").collect():
            made[r.query_id].append((r.matched, round(r.bm25, 6), r.ordinal))
        assert made == {q: [(m, round(s, 6) + 0.0, o) for m, s, o in rows[:k]] for q, rows in want.items()}


def test_common_words_make_no_pairs_and_folders_are_pruned(spark):
    """A stop word of every passage, and a common content word beside rare ones, aren't laid out."""
    texts = [f"the of common word{i} rare{i % 200} thing{i % 100}" for i in range(2_000)]
    index = retrieval.build_index(corpus_frame(spark, texts))
    asked = spark.createDataFrame([(1, "the of common rare7 thing7 thing7")], "query_id long, question string")
    terms = postings.asked_terms(index, retrieval.query_terms(asked))
    written = {}
    real = postings.materialize

    def counted(frame, name):
        made = real(frame, name)
        written[name] = made.count()
        return made

    postings.materialize = counted
    try:
        top = postings.top_k(index, asked, terms, 4).collect()
    finally:
        postings.materialize = real
    assert [r.ordinal for r in sorted(top, key=lambda r: r["rank"])] == [7, 207, 407, 607]
    assert written["able"] <= 40
    plan = postings._lists(index, terms)._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower()


def test_gaps_in_ordinals_are_refused(spark):
    with pytest.raises(ValueError):
        retrieval.build_index(corpus_frame(spark, ["a", "b", "c"]).where("ordinal <> 1"))


# --- vectors -----------------------------------------------------------------------------

def points(spark, seed, n, dim=6):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(7, dim)) * 4
    rows = [(i, (middle[i % 7] + rng.normal(size=dim)).round(2).tolist()) for i in range(n)]
    rows += [(n, [0.0] * dim), (n + 1, rows[3][1]), (n + 2, [-x for x in rows[3][1]]), (n + 3, [0.0] * dim)]
    return spark.createDataFrame(rows, "doc_id long, embedding array<double>")


def rows_of(frame):
    return {tuple(r) for r in frame.collect()}


def test_clusters_give_what_all_tiles_give(spark, monkeypatch):
    monkeypatch.setattr(clusters, "SLICE", 60)
    vectors = points(spark, 1, 500)
    asked = points(spark, 2, 30).withColumnRenamed("doc_id", "query_id")
    made = clusters.build_clusters(vectors, scratch_path(spark, "clusters"), 9, 300)
    again = clusters.open_clusters(spark, made.rows.inputFiles()[0].replace("file://", "").rsplit("/rows", 1)[0])
    full = dense.Tiles(vectors)
    for k in (1, 6, 600):
        assert rows_of(again.nearest(asked, k)) == rows_of(full.nearest(asked, k))
    wanted = spark.createDataFrame([(q, d) for q in range(34) for d in (0, 3, 77, 500, 501, 502)], "query_id long, doc_id long")
    assert rows_of(made.ranks(asked, wanted)) == rows_of(full.ranks(asked, wanted))


def test_far_clusters_are_not_read(spark):
    """Tight groups far apart: only the query's own is read, and a rank counts the others whole."""
    rows = [(i, np.eye(8)[i % 8].tolist()[:7] + [0.01 * (i % 5) + (i % 8 == 7)]) for i in range(400)]
    vectors = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    made = clusters.build_clusters(vectors, scratch_path(spark, "clusters"), 8)
    asked = vectors.where("doc_id = 0").withColumnRenamed("doc_id", "query_id")
    visits = made._visits(asked, True).count()
    barred = asked.selectExpr("query_id", "embedding", "0.99D as bar")
    assert visits == clusters.FIRST and made._visits(barred, False).count() < 7


def test_fused_hits_are_those_of_both_full_rankings(spark, searched, monkeypatch):
    texts, questions, index, asked = searched
    monkeypatch.setattr(V, "RRF_C", 3)
    monkeypatch.setattr(dense, "DEEPER", 2)
    rng = np.random.default_rng(3)
    # Vectors that know nothing of the words: the two lists disagree, so many ranks must be counted.
    vectors = spark.createDataFrame([(i, rng.normal(size=4).round(1).tolist()) for i in range(len(texts))], "doc_id long, embedding array<double>")
    theirs = spark.createDataFrame([(q, rng.normal(size=4).round(1).tolist()) for q in questions], "query_id long, embedding array<double>")
    lex = {q: {o: r for r, (_, _, o) in enumerate(rows)} for q, rows in ranked_by_hand(texts, questions)[0].items()}
    near = {q: {} for q in questions}
    for r in dense.Tiles(vectors).nearest(theirs, len(texts)).collect():
        near[r.query_id][r.doc_id] = r["rank"] - 1
    backends = [dense.Tiles(vectors), clusters.build_clusters(vectors, scratch_path(spark, "clusters"), 5)]
    for backend in backends:
        made = {q: [] for q in questions}
        for r in dense.fuse(index, asked, backend, theirs, 3).orderBy("query_id", "rank").collect():
            made[r.query_id].append((r.ordinal, r.lex_rank, r.dense_rank))
        for q in questions:
            best = sorted(range(len(texts)), key=lambda o: (-(1.0 / (3.0 + lex[q][o]) + 1.0 / (3.0 + near[q][o])), o))[:3]
            assert made[q] == [(o, lex[q][o], near[q][o]) for o in best], q


def test_answers_over_fused_hits(spark, own_index):
    """A close vector supports an answer that words alone don't; a far one doesn't."""
    n = own_index.n_docs
    vectors = spark.createDataFrame([(i, np.eye(n)[i].tolist()) for i in range(n)], "doc_id long, embedding array<double>")
    asked = spark.createDataFrame([(1, "the", ""), (2, "the", "")], "query_id long, question string, beverage_type string")
    theirs = spark.createDataFrame([(1, np.eye(n)[2].tolist()), (2, np.ones(n).tolist())], "query_id long, embedding array<double>")
    hits = dense.fuse(own_index, asked, dense.Tiles(vectors), theirs, 4)
    tops = {r.query_id: r for r in hits.where("rank = 1").collect()}
    done = {r.query_id: r.status for r in retrieval.answer(own_index, asked, hits=hits).collect()}
    assert {q: t.dense_sim >= 0.8 for q, t in tops.items()} == {q: s == "answered" for q, s in done.items()}
    assert done[2] == "refused"


def test_only_changed_passages_are_encoded_again(spark, tmp_path):
    encoded = spark.sparkContext.accumulator(0)
    plain = dense.word_slots(8)

    def encode(texts):
        encoded.add(len(texts))
        return plain(texts)

    def run(texts):
        before = encoded.value
        rows = dense.persist_vectors(corpus_frame(spark, texts), str(tmp_path), "slots", encode).collect()
        assert {r.ordinal: list(r.embedding) for r in rows} == {
            i: [float(x) for x in plain([f". {t or ''}"])[0]] for i, t in enumerate(texts)} and len(rows) == len(texts)
        return encoded.value - before

    texts = ["one two", "three", "three", None, "four five six"]
    assert run(texts) == 4 and run(texts) == 0
    assert run(["one two", "three", "changed", None, "four five six", "three"]) == 1
    assert run(texts) == 0
    other = dense.persist_vectors(corpus_frame(spark, texts), str(tmp_path), "other", encode)
    assert other.count() == 5 and encoded.value == 9
