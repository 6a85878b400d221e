"""Benchmark decontamination: edit-tolerant search of benchmark items by random-walk embeddings.

The words of a window are embedded by a CGK walk: at each step the word under the cursor is put
out, and a random bit of (step, word) says whether the cursor moves on. Texts a few edits apart give
outputs a few positions apart, so sampled positions of the output hash near windows together.
Items are cut into parts: one of them has no more edits a word than the whole. Windows as long as a part
(of its length class) look up the parts in many such tables, and the item is verified around what is
found by its exact edit distance.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelspark.llm.common import broadcast_up_to, mixed, query, table, text_blocks

TOKEN = re.compile(r"[^\W_]+")
#: Characters of benchmark text that one block of items holds at most, about.
BLOCK_CHARS = 16_000_000
#: Lengths within this ratio share a window size.
CLASS_RATIO = 1.2
#: Hashes of contaminated documents that may be broadcast (8 bytes a row).
BROADCAST_KEYS = 1_000_000
#: Sampled steps in a key, tables added at a time, and tables after which the build fails.
BITS, STEP_TABLES, FAIL_TABLES = 4, 8, 16_384
#: Words that a part of an item has at least, if the item has twice as many.
PART = 12

#: Cells that mark neighbouring words of items; a shared cell only lets a window through.
PAIR_CELLS_LOG2 = 22

HITS = "doc_id string, item_id string, first_char long, end_char long, words long, edits long"


def tokens(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits."""
    return TOKEN.findall(text.lower()) if text else []


def walk(words: np.ndarray, starts: np.ndarray, size: int, seed: int, steps: np.ndarray) -> np.ndarray:
    """Outputs at ``steps`` (ascending) of the CGK walk over ``size`` words from every start.

    Beyond the window or the array the output is 0 and the cursor stays.
    """
    out = np.zeros((len(steps), len(starts)), dtype=np.int64)
    at = np.zeros(len(starts), dtype=np.int64)
    held, limit = 0, len(words)
    base = mixed(np.array([seed], dtype=np.uint64))[0]
    with np.errstate(over="ignore"):
        for step in range(int(steps[-1]) + 1):
            where = starts + at
            inside = (at < size) & (where < limit)
            word = np.where(inside, words[np.minimum(where, limit - 1)], 0)
            if step == steps[held]:
                out[held] = word
                held += 1
                if held == len(steps):
                    break
            move = mixed(word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + base + np.uint64(step)) & np.uint64(1)
            at += (move == 1) & inside
    return out


def keys(outputs: np.ndarray, table_no: int) -> np.ndarray:
    made = np.full(outputs.shape[1], 0x51ED270B + table_no, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for row in outputs:
            made = mixed(made * np.uint64(0x100000001B3) + row.astype(np.uint64))
    return made


def best_match(item: np.ndarray, regions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edit distance of the item to the nearest part of each region, and where that part lies.

    Ties go to the earliest end, then the latest start.
    """
    rows, width = regions.shape
    big = np.int64(1 << 20)
    slots = np.arange(width + 1)
    # A cell holds distance * big - start, so that one minimum keeps both.
    cost = np.broadcast_to(-slots, (rows, width + 1)).astype(np.int64)
    for i, word in enumerate(item):
        change = cost[:, :-1] + np.where(regions == word, 0, big)
        drop = cost[:, 1:] + big
        inner = np.minimum(change, drop)
        first = cost[:, :1] + big
        row = np.concatenate([first, inner], axis=1)
        cost = np.minimum.accumulate(row - slots * big, axis=1) + slots * big
    edits = -((-cost) // big)
    start = edits * big - cost
    end = edits.argmin(axis=1)
    at = np.arange(rows)
    return edits[at, end], start[at, end], end


@dataclass
class Searcher:
    """The tables of one block of items."""

    items: list[tuple[str, np.ndarray]]
    vocabulary: dict[str, int]
    neighbours: np.ndarray  # cells of pairs of words that follow each other in an item
    classes: list[dict] = field(default_factory=list)


def build(items: list[tuple[str, list[str]]], share: float, recall: float, seed: int = 5) -> Searcher:
    """Tables until probes, parts of items edited as far as allowed, are found at the rate ``recall``."""
    vocabulary: dict[str, int] = {}
    held = [(i, np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in ws], dtype=np.int64)) for i, ws in items]
    neighbours = np.zeros(1 << PAIR_CELLS_LOG2, dtype=bool)
    for _, own in held:
        neighbours[_pair_cells(own)] = True
    made = Searcher(held, vocabulary, neighbours)
    rng = np.random.default_rng(seed)
    parts = []  # item, first word, words
    for i, (_, own) in enumerate(held):
        count = max(1, len(own) // PART)
        cuts = [n * len(own) // count for n in range(count + 1)]
        parts += [(i, lo, own[lo:hi]) for lo, hi in zip(cuts, cuts[1:])]
    parts.sort(key=lambda p: len(p[2]))
    while parts:
        size = len(parts[0][2])
        members = [p for p in parts if len(p[2]) <= size * CLASS_RATIO]
        parts = parts[len(members):]
        most = max(int(share * len(w)) for *_, w in members)
        probed = rng.integers(0, len(members), 256)
        probes = [_edited(members[j][2], int(share * len(members[j][2])), rng, len(vocabulary)) for j in probed]
        text, starts = _laid(probes)
        own, own_starts = _laid([w for *_, w in members])
        found = np.zeros(len(probes), dtype=bool)
        tables: list[tuple] = []
        while found.mean() < recall:
            if len(tables) * STEP_TABLES >= FAIL_TABLES:
                raise RuntimeError(f"parts of {size} words are found at {found.mean():.3f} after {FAIL_TABLES} tables, not {recall}")
            walk_seed = int(rng.integers(1 << 40))
            picks = [np.sort(rng.choice(2 * size, min(BITS, 2 * size), replace=False)) for _ in range(STEP_TABLES)]
            steps = np.unique(np.concatenate(picks))
            mine, theirs = walk(own, own_starts, size, walk_seed, steps), walk(text, starts, size, walk_seed, steps)
            maps = []
            for n, pick in enumerate(picks):
                at = np.searchsorted(steps, pick)
                item_keys, probe_keys = keys(mine[at], n), keys(theirs[at], n)
                found |= item_keys[probed] == probe_keys
                bucket: dict[int, list[tuple[int, int]]] = defaultdict(list)
                for (i, lo, _), key in zip(members, item_keys.tolist()):
                    bucket[key].append((i, lo))
                ordered = np.array(sorted(bucket), dtype=np.uint64)
                maps.append((ordered, [bucket[k] for k in ordered.tolist()]))
            tables.append((walk_seed, steps, picks, maps))
        made.classes.append({"size": size, "most": most, "tables": tables})
    return made


def _pair_cells(words: np.ndarray) -> np.ndarray:
    """The cell of each word and the next."""
    with np.errstate(over="ignore"):
        made = words[:-1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + words[1:].astype(np.uint64)
        return (made * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - PAIR_CELLS_LOG2)


def _laid(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    lengths = [len(t) for t in texts]
    return np.concatenate(texts), np.concatenate([[0], np.cumsum(lengths)[:-1]])


def _edited(item: np.ndarray, edits: int, rng: np.random.Generator, words: int) -> np.ndarray:
    """The item after random changes, losses and gains of words, with foreign words behind it."""
    made = list(item)
    for _ in range(edits):
        kind, at = rng.integers(3), int(rng.integers(max(1, len(made))))
        if kind == 0 and made:
            made[at] = words + 1 + int(rng.integers(1 << 30))
        elif kind == 1 and len(made) > 1:
            del made[at]
        else:
            made.insert(at, words + 1 + int(rng.integers(1 << 30)))
    return np.array(made + [words + 2] * len(item), dtype=np.int64)


def search(searcher: Searcher, texts: list[str | None], share: float) -> list[tuple[int, str, int, int, int]]:
    """(text number, item, first word, end word, edits) of the items that each text holds."""
    known = searcher.vocabulary.get
    rows = [[known(w, 0) for w in tokens(t)] for t in texts]
    lengths = np.array([len(r) for r in rows], dtype=np.int64)
    # A gap of foreign words as wide as any reach keeps texts apart.
    gap = max((2 * len(w) for _, w in searcher.items), default=0)
    begins = np.concatenate([[0], np.cumsum(lengths + gap)])
    words = np.zeros(int(begins[-1]) + gap, dtype=np.int64)
    for r, b in zip(rows, begins):
        words[b : b + len(r)] = r
    familiar = np.concatenate([[0], np.cumsum(words > 0)])
    adjoining = np.concatenate([[0], np.cumsum(
        searcher.neighbours[_pair_cells(words)] & (words[:-1] > 0) & (words[1:] > 0))])
    pairs: set[tuple[int, int]] = set()
    for group in searcher.classes:
        size = group["size"]
        n = len(words) - size
        if n <= 0:
            continue
        # In a window that matches, an edit can bring one word that is foreign to the items, and part two
        # neighbours of an item; other parts of the item may have more edits.
        starts = np.flatnonzero(
            (familiar[size : size + n] - familiar[:n] >= max(1, size - group["most"]))
            & (adjoining[size - 1 : size - 1 + n] - adjoining[:n] >= size - 1 - 2 * group["most"])
        )
        for walk_seed, steps, picks, maps in group["tables"]:
            if not len(starts):
                break
            out = walk(words, starts, size, walk_seed, steps)
            for no, (pick, (ordered, buckets)) in enumerate(zip(picks, maps)):
                window_keys = keys(out[np.searchsorted(steps, pick)], no)
                at = np.minimum(np.searchsorted(ordered, window_keys), len(ordered) - 1)
                for w in np.flatnonzero(ordered[at] == window_keys):
                    pairs.update((item, int(starts[w]) - lo) for item, lo in buckets[at[w]])
    by_item: dict[int, list[int]] = defaultdict(list)
    for item, start in sorted(pairs):
        by_item[item].append(start)
    hits: dict[tuple[int, str, int], tuple] = {}
    for item, found in by_item.items():
        name, own = searcher.items[item]
        allowed = int(share * len(own))
        reach = len(own) + 2 * allowed
        for lo in range(0, len(found), 4096):
            at = np.maximum(np.array(found[lo : lo + 4096]) - allowed, 0)
            regions = words[np.minimum(at[:, None] + np.arange(reach), len(words) - 1)]
            member = np.zeros(len(searcher.vocabulary) + 1, dtype=bool)
            member[own] = True
            enough = member[regions].sum(axis=1) >= len(own) - allowed
            at, regions = at[enough], regions[enough]
            if not len(at):
                continue
            edits, first, end = best_match(own, regions)
            for i in np.flatnonzero(edits <= allowed):
                start, stop = int(at[i] + first[i]), int(at[i] + end[i])
                text = int(np.searchsorted(begins, start, side="right")) - 1
                key = (text, name, start - int(begins[text]))
                hits[key] = (text, name, start - int(begins[text]), stop - int(begins[text]), int(edits[i]))
    # Of the overlapping finds of an item, the one of fewest edits stays, then the earliest.
    kept: list[tuple] = []
    for hit in sorted(hits.values(), key=lambda h: (h[0], h[1], h[4], h[2], h[3])):
        if not any(k[0] == hit[0] and k[1] == hit[1] and k[2] < hit[3] and hit[2] < k[3] for k in kept[-64:]):
            kept.append(hit)
    return kept


def find_items(docs: DataFrame, benchmark: DataFrame, share: float = 0.2, min_words: int = 5,
               recall: float = 0.98) -> DataFrame:
    """Passages of ``docs`` (doc_id, text) within edit distance of an item of ``benchmark`` (item_id, text).

    A row (doc_id, item_id, first_char, end_char, words, edits) for each passage whose word edit
    distance to a whole item is at most ``share`` of the item's words; words are lower-case runs of
    letters and digits. Items of fewer than ``min_words`` words are no passages and aren't searched.
    Null and empty texts on either side hold nothing. Items with equal words are each reported.
    Benchmarks of any size are searched in blocks of items; only a block is sent to the tasks.
    ``recall`` is the rate at which items edited up to the limit are found; unchanged ones always are.
    """
    kinds = {"doc_id": docs.schema["doc_id"].dataType, "item_id": benchmark.schema["item_id"].dataType}
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    source = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").where("text is not null")
    made = None
    for block in range(blocks):
        own = items.where(F.col("block") == block).distinct().orderBy("item_id", "text").collect()
        listed = [(r.item_id, ws) for r in own if len(ws := tokens(r.text)) >= min_words]
        if not listed:
            continue
        found = source.mapInPandas(_task(docs.sparkSession, build(listed, share, recall), share), HITS)
        made = found if made is None else made.unionByName(found)
    if made is None:
        made = docs.sparkSession.createDataFrame([], HITS)
    return made.withColumns({c: F.col(c).cast(kind) for c, kind in kinds.items()})


def _task(spark, searcher: Searcher, share: float):
    shared = spark.sparkContext.broadcast(searcher)

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, ids = frame["text"].tolist(), frame["doc_id"].tolist()
            rows = []
            for lo, hi in text_blocks(texts, 4_000_000):
                for text, item, first, end, edits in search(shared.value, texts[lo:hi], share):
                    lowered = texts[lo + text].lower()
                    at = [m.span() for m in TOKEN.finditer(lowered)][first:end]
                    rows.append((ids[lo + text], item, at[0][0], at[-1][1], end - first, edits) if at else None)
            rows = [r for r in rows if r]
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "first_char", "end_char", "words", "edits"])

    return task


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage, all columns as they are.

    Rows are told apart by doc_id and text, so of two texts under one doc_id only the one that holds
    a passage goes.
    """
    mine = "_decontaminate_key"
    keyed = docs.withColumn(mine, F.xxhash64("doc_id", "text"))
    bad = find_items(keyed.select(F.col(mine).alias("doc_id"), "text"), benchmark, **options)
    bad = broadcast_up_to(BROADCAST_KEYS, bad.select(F.col("doc_id").alias(mine)).distinct())
    return keyed.join(bad, mine, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


@query("op5_decontamination")
def op5(spark, sf):
    """Documents that hold passages of the benchmark: one row a document with its items."""
    hits = find_items(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return hits.groupBy("doc_id").agg(
        F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.count("*").alias("n_passages"),
        F.min("edits").alias("least_edits"), F.min("first_char").alias("first_char"),
    )
