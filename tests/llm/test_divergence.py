"""The divergence audit against plain Python, its transducer against sorted lists, and odd rows."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from labelspark.llm import divergence
from labelspark.llm.divergence import Transducer

SCHEMA = "doc_id long, text string, lang string, source string"


def audited(rows, least=30, shown=50):
    found, occurring, docs = defaultdict(Counter), set(), defaultdict(Counter)
    for _, text, lang, source in rows:
        text, lang, source = text or "", lang or "", source or ""
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(divergence.TERM, text)]
        occurring.add((lang, source))
        found[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()

    def shares(counts, kept):
        total = sum(counts[t] for t in kept)
        return {t: 1 + 1_000_000_000 * (counts[t] + 5) // (total + 5 * len(kept)) for t in kept}

    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = sorted(s for g, s in occurring if g == lang)
        p = {s: shares(found[lang, s], kept) for s in sources}
        q = shares(sum((found[lang, s] for s in sources), Counter()), kept)
        for s in sources:
            apart = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            used = [(q[t] - p[s][t], t.encode(), t) for t in kept if found[lang, s][t] and p[s][t] > q[t]]
            for part, ranked in (("pair", sorted(apart)), ("term", sorted(used)[:shown])):
                out |= {(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(ranked)}
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß中\U0001f600") for _ in range(rng.randint(1, 4))) for _ in range(150)]
    pools = {s: rng.sample(words, 60) for s in ["a", "b", "C", "é", None, ""]}
    rows = []
    for i in range(n):
        source = rng.choice([*pools, "a", "a"])
        text = "".join(rng.choice(pools[source]).title() + rng.choice([" ", "1", "\t", "-", "\x7f"]) for _ in range(rng.randint(0, 60)))
        rows.append((i, text, rng.choice(["x", "xy", "x", None, ""]), source))
    return rows + [(n, "", "z", "only"), (n + 1, None, "z", "other"), (n + 2, "?", "y", "one")]


def test_the_transducer_gives_ordinals_and_is_minimal():
    rng = random.Random(3)
    for size in (0, 1, 5, 400):
        entries = sorted({bytes(rng.choice(b"abc\xc3\xa9") for _ in range(rng.randint(0, 7))) for _ in range(size)})
        machine = Transducer.from_bytes(Transducer.build(entries).to_bytes())
        words = entries + [e + b"a" for e in entries] + [e[:-1] for e in entries] + [b"", b"\xff"]
        data = np.frombuffer(b"".join(words) + b" ", dtype=np.uint8)
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        starts = np.cumsum(lengths) - lengths
        place = {e: i for i, e in enumerate(entries)}
        made = machine.ordinals(data, starts, lengths, machine.enter(b""))
        assert made.tolist() == [place.get(w, -1) for w in words]
        rests = {frozenset(e[len(p):] for e in entries if e.startswith(p))
                 for e in entries for p in (e[:i] for i in range(len(e) + 1))}
        assert len(machine.final) == max(1, len(rests))


def test_the_audit_is_that_of_plain_python(spark, monkeypatch):
    rows = corpus(1, 260)
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("term", F.lit("own")).repartition(3)
    assert {tuple(r) for r in divergence.audit(frame).collect()} == audited(rows)
    assert {tuple(r) for r in divergence.audit(frame, 5, 3).collect()} == audited(rows, 5, 3)
    # Several transducers, several passes over the texts, several blocks of terms and early sends.
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 7)
    made = divergence.audit(frame, 2, 50, shard_terms=40, pass_bytes=3_000)
    assert {tuple(r) for r in made.collect()} == audited(rows, 2, 50)


def test_counts_sent_early_add_up(spark, monkeypatch):
    rows = corpus(2, 200)
    frame = spark.createDataFrame(rows, SCHEMA)
    terms = divergence.kept_terms(frame, 3).persist()
    shards = divergence.transducers(terms)
    names = {r.ordinal: (r.lang, r.term) for r in terms.collect()}
    assert sorted(names) == list(range(len(names)))
    assert [names[i] for i in range(len(names))] == sorted(names.values(), key=lambda x: (x[0].encode(), x[1].encode()))
    want = Counter()
    for _, text, lang, source in rows:
        for t in re.findall(divergence.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            if (lang or "", t) in set(names.values()):
                want[lang or "", source or "", t] += 1
    made = {(r.lang, r.source, names[r.ordinal][1]): r.n for r in divergence.recount(frame, shards).collect()}
    assert made == want


def test_large_counts_divide_exactly(spark):
    cases = [(0, 0, 1), (7, 10**15, 10**6), (10**15, 10**15, 3), (123_456_789_012, 10**14 + 7, 999_983)]
    frame = spark.createDataFrame(cases, "c long, n long, v long")
    made = [r[0] for r in frame.select(divergence.share(F.col("c"), F.col("n"), F.col("v"))).collect()]
    assert made == [1 + 10**9 * (c + 5) // (n + 5 * v) for c, n, v in cases]


def test_odd_rows(spark, odd_docs, no_docs):
    lang = F.when(F.col("doc_id") == 7, F.lit(None)).otherwise(F.lit("en"))
    frame = odd_docs.withColumn("lang", lang)
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in frame.collect()]
    assert {tuple(r) for r in divergence.audit(frame, 3).collect()} == audited(rows, 3)
    assert divergence.audit(no_docs.withColumn("lang", F.lit("en"))).count() == 0


def test_very_long_texts(spark):
    rows = [(i, t, "x", f"s{i % 2}") for i, t in enumerate(["Wörd other " * 500_000, "q" * 1_000_000, "wörd"])]
    made = divergence.audit(spark.createDataFrame(rows, SCHEMA), 1)
    assert {tuple(r) for r in made.collect()} == audited(rows, 1)
