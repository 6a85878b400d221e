"""URL rules and nearest neighbours against brute force, the pipeline, and the registered SQL."""

import random
import re

import pytest
from pyspark.sql import functions as F

from labelspark.llm import neighbours, url_rules
from labelspark.llm.queries import REGISTRY, SQL

SF = "/root/testdata/sf0.001"


def test_url_rules_match_every_rule_on_every_url(spark):
    rng = random.Random(1)
    hosts = ["example.com", "www.example.com", "a.net", "net", "x.example.com.evil", "Casino.Example.org", "shop.bets.io", "com"]
    paths = ["", "/", "/en/", "/en", "/es/1", "/fr/casino?x=1", "/a_casino-b/", "/alphabet", "/EN/x", "/q#poker", "/z?u=http://com/"]
    urls = [f"{rng.choice(['http', 'https'])}://{h}{p}" for h in hosts for p in paths] + ["no scheme casino", "com/", "", None, "://", "a://b://net/es/"]
    rules = url_rules.HOST_RULES + url_rules.PATTERN_RULES + (
        url_rules.UrlRule("*phab*", "block"), url_rules.UrlRule("^casino^b/", "allow"), url_rules.UrlRule("es/", "allow", True))
    pages = spark.createDataFrame([(i, u, "own") for i, u in enumerate(urls + urls[:3])], "page_id long, url string, rule string")
    made = {r.page_id: r for r in url_rules.judge(pages, rules).collect()}
    assert len(made) == len(urls) + 3
    for i, u in enumerate(urls + urls[:3]):
        found = re.search("://([^/?#]*)([^?#]*)", u or "")
        host = re.sub("[A-Z]", lambda m: m[0].lower(), found[1]) if found else ""
        path = found[2] if found else ""
        fits = [r for r in rules if r.host and found and (
            host == r.text.partition("/")[0] or host.endswith("." + r.text.partition("/")[0])) and path.startswith("/" + r.text.partition("/")[2])]
        best = max(fits, key=lambda r: (len(r.text), r.text), default=None)
        target = host + (u or "")[found.end(1):] if found else (u or "")
        kinds = {r.verdict for r in rules if not r.host and re.search(r.regex(), target)}
        want = best.verdict if best else "block" if kinds == {"block"} else "allow"
        assert (made[i].host, made[i].path, made[i].rule, made[i].verdict) == (host, path, best and best.text, want), u
    assert url_rules.judge(pages.where("false")).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")


def brute(rows, asks, k):
    out = {}
    sound = {i: [float(x) for x in v] for i, v in rows}
    for q in asks:
        scores = []
        for i, v in sound.items():
            if i != q:
                total = 0.0
                for a, b in zip(sound[q], v):
                    total += a * b
                scores.append((-total, i))
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


@pytest.mark.parametrize("scale", [False, True])
def test_neighbours_recall(spark, scale):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 20)) + 2 * rng.normal(size=(12, 20))[rng.integers(0, 12, 1500)]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if scale:
        x *= rng.uniform(0.3, 3, (1500, 1))
    x = x.astype(np.float32)
    rows = [(i, x[i].tolist()) for i in range(1500)]
    made = neighbours.nearest(vectors(spark, [(*r, "own") for r in rows]), F.col("vec_id") % 20 == 0, k=10).collect()
    want, got = brute(rows, range(0, 1500, 20), 10), {}
    for r in sorted(made, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 10 * len(want)  # scores equal to the bit


def test_neighbours_of_odd_rows(spark):
    rows = [(0, [1.0, 0.0], "x"), (1, [0.0, 0.0], "x"), (2, None, "x"), (3, [1.0, None], "x"), (4, [float("nan"), 1.0], "x"),
            (5, [float("inf"), 1.0], "x"), (6, [1.0, 2.0, 3.0], "x"), (None, [1.0, 1.0], "x"), (7, [-1.0, 0.5], "x"),
            (8, [2.0, 0.0], "x"), (8, [2.0, 0.0], "x"), (9, [2.0, 0.0], "x"), (20, [0.0, 0.0], "x")]
    made = neighbours.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in made] == [(0, 1, 8, 2.0), (0, 2, 9, 2.0), (0, 3, 7, -1.0)]
    assert neighbours.nearest(vectors(spark, []), F.lit(True)).count() == 0
    assert neighbours.nearest(vectors(spark, [(0, [1.0], "x")]), F.lit(True)).count() == 0


def test_one_vector_many_times(spark):
    rows = [(i, [1.0, 2.0, 2.0] if i % 2 else [float(i % 7), 1.0, -1.0], "x") for i in range(400)]
    made = neighbours.nearest(vectors(spark, rows), F.col("vec_id") == 1, k=5).orderBy("rank").collect()
    assert [r.vec_id for r in made] == [3, 5, 7, 9, 11] and {r.score for r in made} == {9.0}


def test_pipeline_stages(spark):
    import corpus_pipeline as P
    from labelspark.llm import decontaminate
    from test_documents import near_by_pairs

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, frames = docs.columns, [docs]
    for name, stage in P.STAGES:
        frames.append(P.materialize(stage(spark, frames[-1], SF), name))
    assert all(f.columns == columns for f in frames[:-1]) and len(P.STAGES) == 5
    before, kept = ({r.doc_id: r.text for r in f.collect()} for f in frames[2:4])
    group, sets = near_by_pairs(before.items(), 5, 80)
    assert set(kept) == {i for i in before if not sets[i] or group[i] == i}
    left = {r.doc_id for r in frames[4].collect()}
    hits = decontaminate.find_items(frames[3], spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert left == set(kept) - {r.doc_id for r in hits.collect()}
    assert {r.doc_id for r in frames[5].collect()} == left


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_match_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in "documents pages benchmark labels embeddings conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cursor = con.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    want = sorted(map(repr, cursor.fetchall()))
    made = REGISTRY[name](spark, SF).select(*columns)
    assert sorted(repr(tuple(r)) for r in made.collect()) == want
