"""Operators on documents against brute force, and their results for odd rows."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from labelspark.llm import (
    decontaminate, line_dedup, mixing, ngram_join, passages, quality, severity, surrogates,
)

BIG = 9007199254740993


def words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def groups(links, nodes):
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


# --- components ---------------------------------------------------------------------------

def test_components_are_those_of_union_find(spark):
    from labelspark.llm.common import components

    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(i, i + 1) for i in range(400, 460)]
    links += [(500, i) for i in range(501, 560)] + [(7, 7), (None, 3)]
    made = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    nodes = {x for link in real for x in link}
    assert made == groups(real, nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- n-gram join --------------------------------------------------------------------------

def grams(text, k):
    ws = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not ws:
        return frozenset()
    return frozenset([tuple(ws)] if len(ws) < k else [tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)])


def near_by_pairs(rows, k=4, percent=85):
    sets = {i: grams(t, k) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2)
             if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return groups(links, list(sets)), sets


def test_groups_of_near_copies_match_all_pairs(spark):
    rng = random.Random(1)
    base, shared, rows = words(90, 0), words(40, 9), []
    for i in range(70):  # copies of one text, each with words changed
        own = list(base)
        for _ in range(i % 6):
            own[rng.randrange(len(own))] = f"changed{i}{rng.random()}"
        rows.append((i, " ".join(own)))
    for i in range(70, 100):  # one common passage among words of their own
        rows.append((i, " ".join(words(60, i) + shared + words(50, 1000 + i))))
    rows += [(100, "Two Words"), (101, "two words"), (102, "two"), (103, ""), (104, None), (105, "A b c d"), (106, "a b c D e")]
    made = {r.doc_id: r for r in ngram_join.near_groups(frame(spark, rows)).collect()}
    want, sets = near_by_pairs(rows)
    assert {i: r.component_id for i, r in made.items()} == want
    assert {i: r.n_shingles for i, r in made.items()} == {i: len(s) for i, s in sets.items()}


def test_near_groups_of_odd_rows(odd_docs, no_docs):
    made = sorted((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_groups(odd_docs).collect())
    by = {(r[1], r[2] > 0): r for r in made}
    assert len(made) == odd_docs.count() and (False, BIG, 4, BIG) in made
    assert by[2, True][3] == by[3, True][3] == by[None, True][3] == 1 and by[5, False][3] == 5
    assert ngram_join.near_groups(no_docs).count() == 0
    kept = ngram_join.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4, 5, 6, 7, 8, 9, BIG]
    assert ngram_join.keep_one(no_docs).count() == 0


# --- lines --------------------------------------------------------------------------------

def test_near_lines_stay_once(spark):
    rng = random.Random(3)
    rows, lines = [], [" ".join(words(rng.choice([4, 12, 40, 200]), i)) for i in range(40)]
    for d in range(30):
        own = []
        for _ in range(8):
            line = rng.choice(lines)
            if rng.random() < 0.4:
                at = rng.randrange(len(line))
                line = line[:at] + "z" + line[at + 1 :]
            own.append(line)
        rows.append((d, "\n".join(own + ["", "short"])))
    made = {r.doc_id: r for r in line_dedup.dedupe_lines(frame(spark, rows)).collect()}

    def shingles(line):
        return frozenset(line[i : i + 8] for i in range(len(line) - 7))

    distinct = list(dict.fromkeys(x for _, t in rows for x in t.split("\n") if len(x) >= 8))
    sets = [shingles(x) for x in distinct]
    links = [(i, j) for i, j in itertools.combinations(range(len(distinct)), 2)
             if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    group = groups(links, range(len(distinct)))
    at, seen, missed = {x: i for i, x in enumerate(distinct)}, set(), 0
    for d, text in rows:
        kept = made[d].text.split("\n")
        assert kept[-1] == "short" and len(kept) == made[d].n_lines - made[d].n_removed
        want = []
        for line in text.split("\n"):
            if len(line) < 8 or group[at[line]] not in seen:
                want.append(line)
                seen.add(group[at[line]] if len(line) >= 8 else None)
        missed += kept != want
    assert missed <= 1  # recall of the bands


def linked(spark, lines):
    """The components that the rounds make of lines which all share each bucket."""
    known = line_dedup.signatures(lines)
    bands = [f"band{b}" for b in range(line_dedup.BANDS)]
    listed = known.select("id", "grade", F.posexplode(F.array(*bands)).alias("b", "value")).select(
        "id", "grade", F.xxhash64("b", "grade", "value").alias("bucket"))
    made = line_dedup._linked(listed, known.select("id", "grade", *bands), lines.select("id", "line"), 0.8)
    return {r.node: r.component for r in made.collect()}, listed


def test_lines_that_are_near_only_to_a_hubs_copies_are_linked(spark):
    # Three lines h, p, q each: the end h, which has the smallest id, is near p, and p is near q, h not.
    rows, chains, rng = [], 60, random.Random(700)
    for n in range(chains):
        base = "".join(rng.choice("abcdefghijklmnop") for _ in range(95))
        rows += [(3 * n, base), (3 * n + 1, base[:-6] + "012345"), (3 * n + 2, "6789AB" + base[6:-6] + "012345")]
    lines = spark.createDataFrame(rows, "id long, line string").withColumns({"row_key": F.lit(1), "line_no": F.col("id")})
    made, listed = linked(spark, lines)
    by = {}
    for r in listed.collect():
        by.setdefault(r.bucket, set()).add(r.id)
    for n in range(chains):  # the links that the bands find
        links = [(a, b) for a, b in ((3 * n, 3 * n + 1), (3 * n + 1, 3 * n + 2)) if any({a, b} <= s for s in by.values())]
        want = groups(links, range(3 * n, 3 * n + 3))
        assert {i: made.get(i, i) for i in want} == want


def test_small_families_beside_a_large_group_are_linked(spark):
    # One group of many copies, and lines of shared wording in few pairs, all of which share buckets.
    rng, rows = random.Random(31), []
    big = "".join(rng.choice("abcdefghij ") for _ in range(90))
    rows += [(10_000 + i, big[: i % 80] + f"{i:04d}" + big[i % 80 + 4 :]) for i in range(400)]
    wording = "".join(rng.choice("klmnopqrst ") for _ in range(60))
    for n in range(40):
        own = "".join(rng.choice("ABCDEFGHIJ") for _ in range(34))
        rows += [(2 * n, wording + own), (2 * n + 1, wording + own[:-1] + "z")]
    lines = spark.createDataFrame(rows, "id long, line string").withColumns({"row_key": F.lit(1), "line_no": F.col("id")})
    made, _ = linked(spark, lines)
    assert [made.get(2 * n + 1) for n in range(40)] == [2 * n for n in range(40)]
    assert len({made.get(2 * n, 2 * n) for n in range(40)}) == 40


def test_pairs_of_a_bucket_are_compared_once_however_it_is_parted(spark, monkeypatch):
    # Shared wording with own endings: many lines of one bucket, alike and not, in several bands at once.
    rng = random.Random(12)
    wording = "".join(rng.choice("klmnopqrst ") for _ in range(60))
    rows = [(i, wording + "".join(rng.choice("ABCDEFGHIJ") for _ in range(rng.choice([3, 10, 25])))) for i in range(120)]
    lines = spark.createDataFrame(rows, "id long, line string").withColumns({"row_key": F.lit(1), "line_no": F.col("id")})
    known = line_dedup.signatures(lines).persist()
    bands = [f"band{b}" for b in range(line_dedup.BANDS)]
    listed = known.select("id", "grade", F.posexplode(F.array(*bands)).alias("b", "value")).select(
        "id", "grade", F.xxhash64("b", "grade", "value").alias("bucket")).persist()
    joined = spark.createDataFrame([(1, 0), (0, 0), (5, 2), (2, 2)], "node long, component long")
    component, by, want = {1: 0, 5: 2}, {}, set()
    for r in known.collect():
        by.setdefault(r.grade, []).append((r.id, [(r[b] >> 16 * i) & 65535 for b in bands for i in range(4)], [r[b] for b in bands]))
    for own in by.values():
        for (a, x, p), (b, y, q) in itertools.combinations(sorted(own), 2):
            if component.get(a, a) != component.get(b, b) and any(u == v for u, v in zip(p, q)):
                if sum(u == v for u, v in zip(x, y)) >= line_dedup.ALIKE:
                    want.add((a, b))
    assert len(want) > 300
    for parted in (0, 40, 1_000):
        monkeypatch.setattr(line_dedup, "PARTED", parted)
        assert {tuple(r) for r in line_dedup._apart(listed, known, joined).collect()} == want


def edited_family(rng, base, n):
    """Lines that lose, gain or change a few stretches of the base, and edited ones of these."""
    made = [base]
    while len(made) < n:
        line = base if rng.random() < 0.7 else rng.choice(made)
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(line) - 8)
            line = line[:at] + "".join(rng.choice("0123456789") for _ in range(rng.choice([0, 0, 1, 4, 9]))) + line[at + rng.choice([0, 1, 4, 9]):]
        made.append(line[: rng.choice([len(line)] * 4 + [len(line) * 9 // 10])])
    return made


def test_links_beside_a_hub_are_those_of_all_pairs(spark, monkeypatch):
    rng, rows = random.Random(45), []
    for n, long in enumerate((70, 95, 400)):
        base = "".join(rng.choice("abcdefghijklmnop ") for _ in range(long))
        rows += [(1_000 * n + i, line) for i, line in enumerate(dict.fromkeys(edited_family(rng, base, 70)))]
    lines = spark.createDataFrame(rows, "id long, line string").withColumns({"row_key": F.lit(1), "line_no": F.col("id")})
    monkeypatch.setattr(line_dedup, "PARTED", 2)
    monkeypatch.setattr(line_dedup, "ROUNDS", 1)
    made, listed = linked(spark, lines)
    sets = {i: {x[j : j + 8] for j in range(len(x) - 7)} for i, x in rows}
    by, links = {}, set()
    for r in listed.collect():
        by.setdefault(r.bucket, []).append(r.id)
    for own in by.values():
        links |= {(a, b) for a, b in itertools.combinations(sorted(own), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    want = groups(links, sets)
    assert len(set(want.values())) > 40 and {i: made.get(i, i) for i in sets} == want


def test_a_family_of_unlike_edits_is_not_compared_in_all_pairs(spark, monkeypatch):
    # 500 lines, each with a stretch of its own, so that hardly two are near; 50 have a near copy.
    rng = random.Random(46)
    base = "".join(rng.choice("abcdefghijklmnop ") for _ in range(90))
    rows = [(0, base)]
    for i in range(1, 501):
        x = rng.randrange(8, 78)
        line = base[:x] + f"{i:04d}" + base[x + 4 :]
        rows += [(i, line)] + ([(1_000 + i, line + "0")] if i % 10 == 0 else [])
    lines = spark.createDataFrame(rows, "id long, line string").withColumns({"row_key": F.lit(1), "line_no": F.col("id")})
    counts, written = [], line_dedup.materialize

    def counted(frame, name):
        made = written(frame, name)
        counts.append(made.count() if name in ("apart", "beside") else 0)
        return made

    monkeypatch.setattr(line_dedup, "materialize", counted)
    made, _ = linked(spark, lines)
    assert all(made.get(1_000 + i, 1_000 + i) == made.get(i, i) for i in range(10, 501, 10))
    assert sum(counts) < 5_000  # of 150,000 pairs


def test_lines_of_odd_rows(odd_docs, no_docs):
    made = line_dedup.dedupe_lines(odd_docs.drop("n_lines"))
    assert made.count() == odd_docs.count()
    by = {}
    for r in made.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert sorted(r.n_removed for r in by[1]) == [0, 1] and by[2][0].text == "" and by[2][0].key == "own key"
    assert by[4][0].text is None and by[4][0].n_removed == 0 and by[5][0].text == ""
    assert by[9][0].text == "line one is here\n"
    assert line_dedup.dedupe_lines(no_docs).count() == 0


# --- decontamination ----------------------------------------------------------------------

def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, left = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(left[j - 1] + (x != y), left[j] + 1, row[-1] + 1))
    return row[-1]


def test_best_match_is_the_least_edit_distance():
    import numpy as np

    rng = random.Random(8)
    for _ in range(40):
        item = np.array([rng.randrange(1, 5) for _ in range(rng.randrange(1, 8))])
        region = np.array([[rng.randrange(5) for _ in range(12)]])
        got, start, end = (int(x[0]) for x in decontaminate.best_match(item, region))
        spans = [(edits(item, region[0][i:j]), i, j) for i in range(13) for j in range(i, 13)]
        assert got == min(spans)[0] == edits(item, region[0][start:end])


def test_edited_items_are_found_and_clean_texts_are_not(spark):
    rng, items, rows = random.Random(5), [], []
    for i in range(60):
        items.append((i, " ".join(words(rng.randrange(14, 60), i)).capitalize() + "."))
    for i, text in items:
        own = text.split()
        for _ in range(int(0.15 * len(own))):
            own[rng.randrange(len(own))] = "other"
        rows.append((i, " ".join(words(80, 100 + i) + own + words(80, 200 + i))))
        rows.append((1000 + i, " ".join(words(150, 300 + i) + own[: len(own) // 2])))
    bench = spark.createDataFrame(items + [(90, None), (91, ""), (92, "too short")], "item_id long, text string")
    hits = decontaminate.find_items(frame(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in hits} >= {(i, i) for i, _ in items[:58]} and len({r.doc_id for r in hits}) >= 58
    text = dict(rows)
    for r in hits:
        assert r.doc_id == r.item_id
        own = decontaminate.tokens(text[r.doc_id][r.first_char : r.end_char])
        item = decontaminate.tokens(items[r.item_id][1])
        assert edits(own, item) == r.edits <= 0.2 * len(item) and len(own) == r.words


def test_long_items_at_the_limit_of_edits_are_found():
    import numpy as np

    rng = np.random.default_rng(3)
    items = [(str(i), words(200, 900 + i)) for i in range(60)]
    searcher = decontaminate.build(items, 0.2, 0.98)
    found = 0
    for i, (_, item) in enumerate(items):
        numbers = np.array([searcher.vocabulary[w] for w in item])
        made = decontaminate._edited(numbers, 40, rng, len(searcher.vocabulary))[:-200]
        names = {n: w for w, n in searcher.vocabulary.items()}
        text = words(90, 5000 + i) + [names.get(int(n), f"new{n}") for n in made] + words(90, 7000 + i)
        hits = decontaminate.search(searcher, [" ".join(text)], 0.2)
        found += any(h[1] == str(i) for h in hits)
    print("items of 200 words with 40 edits found:", found, "of 60")
    assert found >= 58


def test_decontamination_of_odd_rows(spark, odd_docs, no_docs):
    from conftest import PROSE  # noqa: F401  (the fixture's text)

    bench = odd_docs.where("doc_id = 8 or doc_id = 4").select(F.lit(1).alias("item_id"), "text").union(
        spark.createDataFrame([(5, " ".join(f"alpha{i * i % 1009} beta{i * 7 % 613}" for i in range(60)))], "item_id int, text string"))
    kept = decontaminate.clean(odd_docs, bench)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 4, 5, 6, 7, 8, 9, BIG]
    assert decontaminate.clean(no_docs, bench).count() == 0
    assert decontaminate.find_items(odd_docs, bench.where("false")).count() == 0


# --- passages -----------------------------------------------------------------------------

def test_fuzzy_passages_are_found(spark):
    rng, rows = random.Random(6), []
    passage = words(70, 1)
    for i in range(24):
        own = list(passage)
        for _ in range(i % 7):
            at = rng.randrange(len(own))
            own[at : at + 1] = [] if i % 2 else [f"new{i}"]
        rows.append((i, " ".join(words(40 + i, 50 + i) + own + words(40, 90 + i))))
    rows += [(100 + i, " ".join(words(200, 500 + i) + passage[:30])) for i in range(5)]
    rows += [(200, rows[0][1]), (201, "short"), (202, "short")]
    made = passages.find_passages(frame(spark, rows)).collect()
    found = {r.doc_id for r in made} | {r.first_doc_id for r in made}
    assert found <= {*range(24), 200} and found >= {200, *(i for i in range(24) if i % 7 < 4)} and len(found) >= 20
    text = {i: t.lower().split() for i, t in rows}
    for r in made:
        a, b = text[r.doc_id][r.start_word : r.end_word], text[r.first_doc_id][r.first_start : r.first_end]
        assert edits(a, b) <= r.edits <= 0.2 * max(len(a), len(b)) and min(len(a), len(b)) >= 50
    assert [(r.first_doc_id, r.start_word) for r in made if r.doc_id == 200] == [(0, 0)]


def test_passages_behind_decoy_first_holders_are_found(spark):
    rows, rng = [], random.Random(11)
    for n in range(12):  # two documents share a passage; others hold single runs of it, or a poor copy
        passage = words(60, 3000 + n)
        for i in range(2):
            rows.append((1000 * n + i, " ".join(words(70, 4000 + 10 * n + i) + passage + words(70, 5000 + 10 * n + i))))
        if n % 2:
            for i in range(0, 54, 3):
                rows += [(1000 * n + 100 + i, " ".join(words(70, 6000 + 100 * n + i) + passage[i : i + 9] + words(70, 8000 + 100 * n + i)))]
        else:
            for c in range(6):  # 0.7 near: every tenth run of three is foreign
                own = [f"poor{n}x{i}" if (i + c) % 10 in (0, 1, 2) else w for i, w in enumerate(passage)]
                rows.append((1000 * n + 100 + c, " ".join(words(70, 6000 + 100 * n + c) + own + words(70, 8000 + 100 * n + c))))
    rng.shuffle(rows)
    made = passages.find_passages(frame(spark, rows)).collect()
    text = {i: t.split() for i, t in rows}
    pairs = set()
    for r in made:
        a, b = text[r.doc_id][r.start_word : r.end_word], text[r.first_doc_id][r.first_start : r.first_end]
        assert edits(a, b) <= r.edits <= 0.2 * max(len(a), len(b)) and min(len(a), len(b)) >= 50
        pairs.add((min(r.doc_id, r.first_doc_id), max(r.doc_id, r.first_doc_id)))
    assert pairs >= {(1000 * n, 1000 * n + 1) for n in range(12)}


def test_passages_at_the_limits_are_found(spark):
    rows, rng = [], random.Random(12)
    for n in range(150):  # 50 words, 10 of them changed
        passage = words(50, 20_000 + n)
        own = list(passage)
        for at in rng.sample(range(50), 10):
            own[at] = f"changed{n}x{at}"
        rows.append((2 * n, " ".join(words(70, 30_000 + n) + passage + words(70, 40_000 + n))))
        rows.append((2 * n + 1, " ".join(words(70, 50_000 + n) + own + words(70, 60_000 + n))))
    made = passages.find_passages(frame(spark, rows)).collect()
    found = {r.doc_id // 2 for r in made if r.doc_id // 2 == r.first_doc_id // 2}
    print("passages of 50 words at 0.8 found:", len(found), "of 150")
    assert len(found) >= 147


def test_chains_keep_order_and_best_score():
    parts = [(0, 0, 10), (12, 13, 10), (24, 26, 8), (5, 100, 9), (14, 2, 6)]
    assert passages.chains(parts)[0] == [(0, 0, 10), (12, 13, 10), (24, 26, 8)]
    assert sorted(sum(passages.chains(parts), [])) == sorted(parts)


def test_texts_of_the_same_words_in_another_order_are_not_aligned(spark, monkeypatch):
    rng, rows = random.Random(8), []
    for i in range(40):
        own = [f"w{rng.randrange(80)}" for _ in range(160)]
        own[80:80] = "one run of words that all of them hold".split()
        rows.append((i, " ".join(own)))
    copied = rows[3][1].split()[50:130]
    rows.append((40, " ".join([f"x{i}" for i in range(30)] + copied + [f"y{i}" for i in range(30)])))
    aligned, written = [], passages.materialize

    def counted(df, name):
        made = written(df, name)
        if name == "chains":
            aligned.append(made.count())
        return made

    monkeypatch.setattr(passages, "materialize", counted)
    made = passages.find_passages(frame(spark, rows)).collect()
    assert {(r.doc_id, r.first_doc_id) for r in made} in ({(40, 3)}, {(3, 40)})
    assert aligned[-1] < 40  # of 820 pairs that share the run and most of the words


def test_seeds_are_dealt_once(spark, monkeypatch):
    # The first holder of a seed and all others come from one exchange of the seeds.
    frames, written = {}, passages.materialize

    def noted(made, name):
        frames[name] = made
        return written(made, name)

    monkeypatch.setattr(passages, "materialize", noted)
    own = " ".join(words(80, 5))
    made = passages.find_passages(frame(spark, [(i, own + f" {i} " + " ".join(words(30, i))) for i in range(6)]))
    assert made.count() == 5 and "hubs" not in frames
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = frames["shared"].select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert plan.count("- Exchange hashpartitioning(seed") == 1 and plan.count("- ReusedExchange") == 1


def test_passages_of_odd_rows(odd_docs, no_docs):
    made = passages.find_passages(odd_docs).collect()
    assert {(r.doc_id, r.first_doc_id) for r in made if r.end_word == r.first_end == 120} >= {(2, 1), (None, 1)}
    assert passages.find_passages(no_docs).count() == 0


# --- surrogates ---------------------------------------------------------------------------

def test_surrogates_keep_type_form_and_identity(spark):
    rows = [
        (1, "Mr. John Smith met Mrs. Smith, Herr Karl Maria Weber, госпожа Анна Иванова and κύριος Νίκος Παπας"),
        (2, "Mr. Smith paid 4111 1111 1111 1111, then 4111-1111-1111-1111; DE89 3704 0044 0532 0130 00, 123-45-6789"),
        (3, "+1 (017) 555-7713 or +1 017 555 7713 from 10.20.30.40, A.B@Mail.org, a.b@mail.org, c.d@mail.org"),
    ] + [(10 + i, f"card 4{i:015d} from 10.0.{i}.1, Ms. Ana Maria{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(300)]
    made = {r.doc_id: r.text for r in surrogates.pseudonymize(frame(spark, rows), "key").collect()}
    again = {r.doc_id: r.text for r in surrogates.pseudonymize(frame(spark, rows), "key").collect()}
    other = {r.doc_id: r.text for r in surrogates.pseudonymize(frame(spark, rows), "another").collect()}
    assert made == again and made[1] != other[1]
    one = re.fullmatch(r"Mr\. (\S+) (\S+) met Mrs\. (\S+), Herr (\S+) (\S+) (\S+), госпожа ([А-я]+) ([А-я]+) and κύριος (\S+) (\S+)", made[1])
    assert one and one[2] == one[3] and f"Mr. {one[2]} paid" in made[2] and one[7][-1] == "а"
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}", made[2].split(";")[0])
    digits = [re.sub(r"\D", "", c) for c in cards]
    assert len(cards) == 2 and digits[0] == digits[1] != "4111111111111111"
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits[0])))
    assert total % 10 == 0
    assert re.search(r"DE89 \d{4} \d{4} \d{4} \d{4} \d\d", made[2]) and "0532" not in made[2] and "123-45-6789" not in made[2]
    three = re.fullmatch(r"(\+1 \(\d{3}\) \d{3}-\d{4}) or (\+1 \d{3} \d{3} \d{4}) from (\S+), (\S+@\S+), (\S+@\S+), (\S+@\S+)", made[3])
    assert re.sub(r"\D", "", three[1]) == re.sub(r"\D", "", three[2]) and three[4] == three[5] != three[6]
    for pattern in (r"card (\d{16})", r"from (\S+),", r"Ana? ?(\S+)$|Ms\. \S+ (\S+)$"):
        found = [re.search(pattern, made[10 + i]) for i in range(300)]
        assert len({m[0] for m in found if m}) == 300 or pattern.startswith("Ana")
    assert len({re.search(r"Ms\. (\S+)", made[10 + i])[1] for i in range(300)}) == 1


def test_surrogates_of_odd_rows(odd_docs, no_docs):
    made = surrogates.pseudonymize(odd_docs, "key")
    assert made.columns == [*odd_docs.columns, "n_replaced"] and made.where("n_replaced > 0").count() == 0
    assert sorted(map(str, made.select("doc_id", "text").collect())) == sorted(map(str, odd_docs.select("doc_id", "text").collect()))
    assert surrogates.pseudonymize(no_docs, "key").count() == 0


# --- classifiers --------------------------------------------------------------------------

@pytest.fixture(scope="module")
def labelled(spark):
    rows, marks, rng = [], [], random.Random(2)
    for i in range(600):
        own = words(rng.randrange(20, 120), i)
        bad, vile = i % 3 == 0, i % 5 == 0
        if bad:
            own = [w + "###" if rng.random() < 0.8 else w for w in own]
        for _ in range(1 + i % 4 if vile else 0):
            own.insert(rng.randrange(len(own)), rng.choice(["vileone", "viletwo", "vilethree"]))
        rows.append((i, " ".join(own) + "."))
        marks.append((i, 0 if bad else 1, int(vile)))
    marks += [(None, 1, 0), (3, None, None), (99999, 1, 1)]
    return frame(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(labelled):
    from labelspark.llm.common import held_out

    docs, labels = labelled
    made = quality.scored(docs, quality.train(docs, labels, rows=500)).select("doc_id", "score")
    rows = made.join(labels.where("quality is not null"), "doc_id").where(held_out(F.col("doc_id"))).collect()
    right = sum((r.score >= 0.3) == (r.quality == 1) for r in rows)
    assert len(rows) > 80 and right >= 0.97 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_quality_of_odd_rows(odd_docs, no_docs, labelled):
    docs, labels = labelled
    model = quality.train(docs, labels)
    made = quality.scored(odd_docs, model)
    assert made.count() == odd_docs.count() and made.where("score is null or isnan(score)").count() == 0
    assert quality.keep_good(odd_docs, labels.where("false")).columns == odd_docs.columns
    assert quality.scored(no_docs, model).count() == 0 and quality.train(no_docs, labels)[1] == []
    own = odd_docs.withColumn("at", F.monotonically_increasing_id())  # its rows, told apart
    theirs = quality.train(own.select("doc_id", "text"), labels)
    scores = {r["at"]: r.score for r in quality.measured(own.select("doc_id", "text")).withColumn(
        "score", quality.probability(theirs)).withColumn("at", F.monotonically_increasing_id()).collect()}
    kept = sorted(r["at"] for r in quality.keep_good(own, labels, 0.5).collect())
    assert kept == sorted(at for at, x in scores.items() if x >= 0.5)


def test_quality_learns_the_same_from_files_in_any_order(odd_docs, labelled, monkeypatch):
    own, labels, written = odd_docs.select("doc_id", "text"), labelled[1], quality.materialize
    models = []
    for seed in range(4):
        monkeypatch.setattr(quality, "materialize", lambda df, name: written(df, name).repartition(6).orderBy(F.rand(seed)))
        intercept, weights = quality.train(own, labels)
        models.append((round(intercept, 6), [(round(w, 6), r) for w, r in weights]))
    assert all(m == models[0] for m in models)


def test_the_quality_filter_works_out_each_statistic_once(labelled):
    docs, labels = labelled
    plan = quality.keep_good(docs, labels)._jdf.queryExecution().optimizedPlan().toString()
    alone = quality.measured(docs.select("doc_id", "text"))._jdf.queryExecution().optimizedPlan().toString()
    calls = "regexp_count", "regexp_replace", "regexp_extract_all"
    assert all(plan.count(c) <= alone.count(c) for c in calls) and any(plan.count(c) for c in calls)


def test_severity_on_held_out_rows(labelled):
    from labelspark.llm.common import held_out

    docs, labels = labelled
    model = severity.train(docs, labels)
    assert list(model.thresholds) == sorted(model.thresholds)
    made = severity.score(docs, model).join(
        labels.where("toxic is not null").withColumnRenamed("toxic", "truth"), "doc_id").where(held_out(F.col("doc_id"))).collect()
    assert sum(r.toxic == r.truth for r in made) >= 0.97 * len(made)
    by = {n: [r.severity for r in made if r.doc_id % 5 == 0 and r.doc_id % 4 == n] for n in (0, 3)}
    assert sum(by[3]) / len(by[3]) > sum(by[0]) / len(by[0])  # more of it is worse


def test_severity_of_odd_rows(odd_docs, no_docs, labelled):
    docs, labels = labelled
    model = severity.train(docs, labels)
    made = severity.score(odd_docs, model)
    assert made.count() == odd_docs.count() and made.where(F.col("doc_id") == BIG).count() == 1
    assert made.where("severity is null or severity < 0 or severity > 3").count() == 0
    assert severity.score(no_docs, model).count() == 0
    assert severity.score(docs, severity.train(docs, labels.where("false"))).where("toxic = 1").count() == 0


# --- mixing -------------------------------------------------------------------------------

def test_permutation_and_shards_are_whole():
    import numpy as np

    for n in (1, 2, 7, 100, 1023):
        out = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 5, dtype=np.uint64))
        assert sorted(out) == list(range(n))
    quotas = np.array([0, 5, 300, 77, 1000])
    parts = [mixing.shard_counts(quotas, j, 6, 250, 3) for j in range(6)]
    assert sum(c for c, _ in parts).tolist() == quotas.tolist() and [int(c.sum()) for c, _ in parts] == [250] * 5 + [132]
    for j in range(5):
        assert (parts[j][0] + parts[j][1]).tolist() == parts[j + 1][1].tolist()


def test_water_fill():
    sizes, weights = [100, 10, 50, 0], [3, 1, 2, 3]
    made = mixing.water_fill(sizes, weights, 1.5, 2.0)
    assert abs(sum(made) - 240) < 1e-9 and all(t <= 2 * s + 1e-9 for t, s in zip(made, sizes)) and made[3] == 0
    assert made[1] == 20 and abs(made[2] - 2 / 3 * made[0]) < 1e-9


def test_mix_meets_targets_and_reruns_agree(spark):
    rows = [(i, " ".join(words(30 + i % 50, i)), f"s{i % 4}" if i % 9 else None) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(docs, block_words=8, shard_slots=500)
    made = out["documents"].collect()
    again = mixing.mix(docs.repartition(7), block_words=8, shard_slots=500)["documents"].collect()
    assert sorted(map(str, made)) == sorted(map(str, again)) and len(made) == 400
    for s in {r.source for r in made}:
        own = [r for r in made if r.source == s]
        assert own[0].source_size == sum(r.size for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.02 * own[0].target + 8
    assert all(r.taken <= 2 * r.size for r in made)
    spans = out["spans"].groupBy("doc_id").agg(F.sum("words").alias("n")).collect()
    assert {r.doc_id: r.n for r in spans} == {i: len(t.split()) for i, t, _ in rows}
    slots = out["slots"].groupBy("shard").count().orderBy("shard").collect()
    assert all(r["count"] == 500 for r in slots[:-1])


def test_mix_of_odd_rows(odd_docs, no_docs):
    made = mixing.mix(odd_docs)["documents"]
    assert made.count() == odd_docs.count()
    assert made.where("size = 0 and taken <> 0 or taken > 2 * size").count() == 0
    out = mixing.mix(no_docs)
    assert all(f.count() == 0 for f in out.values())
