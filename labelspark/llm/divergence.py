"""Source divergence audit: term shares of sources, recounted by a minimal acyclic transducer."""

from __future__ import annotations

import io
import os.path
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelspark.llm.common import query, table, text_blocks
from labelspark.session import materialize

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCUMENTS, ADDED, SHOWN = 30, 5, 50
#: Terms of a transducer, bytes of transducers sent to the tasks at once, and terms of a block of pair sums.
SHARD_TERMS, PASS_BYTES, BLOCK_TERMS = 131_072, 32_000_000, 4096
#: Cells of a block's matrix of terms and sources.
BLOCK_CELLS = 4_000_000
#: Counts a task holds before it sends them on.
HELD_COUNTS = 1_000_000

_TERM_BYTES = re.compile(rb"[a-z\x80-\xff]+")
#: What a byte of a text is in a term: itself, lower-cased, or 0 outside terms.
_FOLD = np.zeros(256, dtype=np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
for _c in string.ascii_lowercase.encode():
    _FOLD[_c] = _FOLD[_c - 32] = _c


class Transducer:
    """A minimal acyclic automaton over the bytes of sorted entries that adds up to their ordinals.

    States with the same endings are one. The step of state s with byte b stands in a hash table under
    ``s * 256 + b``: its target, and the number of entries that come before all entries through it.
    """

    PARTS = ("final", "keys", "target", "add")

    def __init__(self, final, keys, target, add):
        self.final, self.keys, self.target, self.add = final, keys, target, add

    @property
    def root(self) -> int:
        return len(self.final) - 1

    @classmethod
    def build(cls, entries: list[bytes]) -> Transducer:
        """From distinct entries in byte order. Only the states of the last entry are still open."""
        known: dict[tuple, int] = {}
        final: list[bool] = []
        held: list[int] = []  # entries that end from a state on
        steps: list[tuple[int, int, int]] = []
        path: list[list] = [[False, []]]
        last = b""

        def close(down_to: int) -> None:
            while len(path) > down_to:
                ends, edges = path.pop()
                state = (ends, tuple(edges))
                if state not in known:
                    known[state] = len(final)
                    before = int(ends)
                    for b, t in edges:
                        steps.append((len(final) * 256 + b, t, before))
                        before += held[t]
                    final.append(ends)
                    held.append(before)
                if path:
                    path[-1][1].append((last[len(path) - 1], known[state]))

        for entry in entries:
            shared = len(os.path.commonprefix([last, entry]))
            close(shared + 1)
            path.extend([False, []] for _ in entry[shared:])
            path[-1][0] = True
            last = entry
        close(0)
        own = np.array(steps, dtype=np.int64).reshape(-1, 3)
        keys = np.full(2 ** (2 * len(own) + 16).bit_length(), -1, dtype=np.int64)
        slot, left = _slots(own[:, 0], len(keys)), np.arange(len(own))
        while len(left):  # all take their slot if it is free, of several one; the others go on to the next
            free = left[keys[slot[left]] < 0]
            keys[slot[free]] = own[free, 0]
            left = left[keys[slot[left]] != own[left, 0]]
            slot[left] = (slot[left] + 1) % len(keys)
        target, add = np.zeros(len(keys), dtype=np.int32), np.zeros(len(keys), dtype=np.int32)
        target[slot], add[slot] = own[:, 1], own[:, 2]
        return cls(np.array(final, dtype=bool), keys, target, add)

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{p: getattr(self, p) for p in self.PARTS})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Transducer:
        with np.load(io.BytesIO(data)) as parts:
            return cls(*(parts[p] for p in cls.PARTS))

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Slots of the steps, -1 where there is none."""
        key = state * np.int64(256) + byte
        slot = _slots(key, len(self.keys))
        held = self.keys[slot]
        left = np.flatnonzero((held != key) & (held >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) % len(self.keys)
            held[left] = self.keys[slot[left]]
            left = left[(held[left] != key[left]) & (held[left] >= 0)]
        slot[held != key] = -1
        return slot

    def enter(self, prefix: bytes) -> tuple[int, int] | None:
        """(state, sum) after a prefix; None if no entry begins so."""
        state, total = self.root, 0
        for b in prefix:
            slot = int(self.step(np.array([state]), np.array([b]))[0])
            if slot < 0:
                return None
            state, total = int(self.target[slot]), total + int(self.add[slot])
        return state, total

    def ordinals(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, entered: tuple[int, int]) -> np.ndarray:
        """Ordinal of each run of ``data``, -1 for those that aren't entries; all runs step together."""
        found = np.full(len(starts), -1, dtype=np.int64)
        alive = np.arange(len(starts))
        state = np.full(len(starts), entered[0], dtype=np.int32)
        total = np.full(len(starts), entered[1], dtype=np.int32)
        at = 0
        while len(alive):
            ended = lengths[alive] == at
            good = ended & self.final[state]
            found[alive[good]] = total[good]
            alive, state, total = alive[~ended], state[~ended], total[~ended]
            slot = self.step(state, data[starts[alive] + at])
            on = slot >= 0
            alive, slot, total = alive[on], slot[on], total[on]
            state, total = self.target[slot], total + self.add[slot]
            at += 1
        return found


def _slots(keys: np.ndarray, size: int) -> np.ndarray:
    """First slot of each key in a table of a power of two slots."""
    with np.errstate(over="ignore"):
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(65 - size.bit_length())).astype(np.int64)


def _filled(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def _documents_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, n): documents of the task that hold a term, sent on when enough are held."""
    held: dict[str, Counter] = {}

    def rows() -> pa.RecordBatch:
        langs = pa.array([lang for lang, c in held.items() for _ in c], pa.string())
        terms = pa.array([t for c in held.values() for t in c], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays(
            [langs, terms, pa.array([n for c in held.values() for n in c.values()], pa.int64())], ["lang", "term", "n"])

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            # Bytes outside ASCII are parts of letters here, and lower() leaves them alone.
            held.setdefault(lang, Counter()).update(set(_TERM_BYTES.findall(text.encode("utf-8").lower())))
        if sum(map(len, held.values())) > HELD_COUNTS:
            yield rows()
            held.clear()
    yield rows()


def kept_terms(docs: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, term, ordinal): terms in at least ``least`` documents of a language, numbered in byte order.

    Ordinals run through all languages, language by language. Counts combine in the task; the terms
    are sorted by ranges, and a range's place follows from the sizes of those before it.
    """
    counted = _filled(docs).select("lang", "text").mapInArrow(_documents_with, "lang string, term string, n long")
    often = counted.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("lang", "term")
    entry = F.concat("lang", F.lit("\u0000"), "term")
    # The id counts the rows of a task from its number times 2 ** 33.
    ranged = materialize(
        often.withColumn("entry", entry).repartitionByRange("entry").sortWithinPartitions("entry")
        .withColumn("id", F.monotonically_increasing_id()), "ranges")
    part = F.shiftright("id", 33)
    sizes = ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a task of the sort
    firsts = sizes.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("first"))
    return ranged.withColumn("part", part).join(F.broadcast(firsts), "part").select(
        "lang", "term", (F.col("first") + F.col("id").bitwiseAND((1 << 33) - 1)).alias("ordinal"))


def transducers(terms: DataFrame, shard_terms: int = SHARD_TERMS) -> DataFrame:
    """(shard, size, data): transducers over the terms of :func:`kept_terms`, ``shard_terms`` in each."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        entries = [f"{r.lang}\0{r.term}".encode("utf-8", "surrogatepass") for r in frame.sort_values("ordinal").itertuples()]
        data = Transducer.build(entries).to_bytes()
        return pd.DataFrame({"shard": [frame["shard"].iloc[0]], "size": [len(data)], "data": [data]})

    # A number given keeps the shards, whose rows are few but take long, in tasks of their own.
    shards = max(1, -(-terms.count() // shard_terms))
    keyed = terms.withColumn("shard", F.expr(f"ordinal div {shard_terms}")).repartition(shards, "shard")
    return keyed.groupBy("shard").applyInPandas(
        build, "shard long, size long, data binary")


def recount(docs: DataFrame, shards: DataFrame, shard_terms: int = SHARD_TERMS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(lang, source, ordinal, n): occurrences of the terms in ``shards``, streamed through the transducers.

    Transducers are sent to the tasks up to ``pass_bytes`` at a time; a larger vocabulary takes more
    passes over the texts, each with its part of the terms.
    """
    context = docs.sparkSession.sparkContext
    passes, room = [[]], pass_bytes
    for r in shards.select("shard", "size").orderBy("shard").collect():  # a row for 131,072 terms
        if passes[-1] and r["size"] > room:
            passes.append([])
            room = pass_bytes
        passes[-1].append(r["shard"])
        room -= r["size"]
    made = None
    for chosen in passes:
        sent = {r["shard"]: bytes(r["data"]) for r in shards.where(F.col("shard").isin(chosen)).collect()}
        counts = _filled(docs).mapInArrow(
            _counting(context.broadcast(sent), shard_terms), "lang string, source string, ordinal long, n long")
        made = counts if made is None else made.unionByName(counts)
    return made.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))


def _counting(sent, shard_terms: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = [(shard * shard_terms, Transducer.from_bytes(data)) for shard, data in sorted(sent.value.items())]
        places: dict[tuple[str, str], int] = {}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def summed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            group, ordinal, n = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((ordinal, group))
            group, ordinal, n = group[order], ordinal[order], n[order]
            new = np.flatnonzero(np.append(True, (np.diff(group) != 0) | (np.diff(ordinal) != 0))[: len(n)])
            return group[new], ordinal[new], np.add.reduceat(n, new) if len(new) else n

        def rows(group, ordinal, n):
            names = list(places)
            for column, kind in ((0, "lang"), (1, "source")):
                yield pa.array([p[column] for p in names], pa.string()).take(pa.array(group))
            yield pa.array(ordinal, pa.int64())
            yield pa.array(n, pa.int64())

        names = ["lang", "source", "ordinal", "n"]
        for batch in batches:
            langs, sources, texts = (batch.column(c).to_pylist() for c in ("lang", "source", "text"))
            for start, stop in text_blocks(texts):
                here = range(start, stop)
                for lang in {langs[i] for i in here}:
                    mine = [i for i in here if langs[i] == lang]
                    groups = np.array([places.setdefault((lang, sources[i]), len(places)) for i in mine])
                    held.extend(_block(machines, lang, [texts[i] for i in mine], groups))
            if sum(len(h[0]) for h in held) > HELD_COUNTS:
                held = [summed()]
                if len(held[0][0]) > HELD_COUNTS // 2:
                    yield pa.RecordBatch.from_arrays([*rows(*held[0])], names)
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([*rows(*summed())], names)

    return run


def _block(machines, lang: str, texts: list[str], groups: np.ndarray):
    """(group, ordinal, n) arrays of the kept terms in some texts of a language."""
    parts = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = _FOLD[np.frombuffer(b" " + b" ".join(parts) + b" ", dtype=np.uint8)]
    inside = data > 0
    starts = np.flatnonzero(~inside[:-1] & inside[1:]) + 1
    lengths = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1 - starts
    begins = np.cumsum([1] + [len(p) + 1 for p in parts])
    group = np.repeat(groups, np.diff(np.searchsorted(starts, begins)))
    prefix = lang.encode("utf-8", "surrogatepass") + b"\0"
    for first, machine in machines:
        entered = machine.enter(prefix)
        if entered is None:
            continue
        found = machine.ordinals(data, starts, lengths, entered)
        hit = found >= 0
        key = group[hit] * np.int64(1 << 40) + found[hit] + first
        key, n = np.unique(key, return_counts=True)
        yield key >> 40, key & np.int64((1 << 40) - 1), n


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(1e9 * (count + 5) / (total + 5 * kept)) in whole numbers, three digits at a time."""
    size = total + ADDED * kept
    rest, made = count + F.lit(ADDED).cast("long"), F.lit(0).cast("long")
    for _ in range(3):
        rest = rest * 1000
        made, rest = made * 1000 + F.call_function("div", rest, size), rest % size
    return made + 1


def _pair_sums(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, value): sums of absolute share differences over all kept terms, a < b in byte order.

    Terms are cut into blocks. A task has the counted shares of a block's terms as a matrix, where a
    source without the term has its share of a count of 0, and sends one sum a pair of sources.
    """
    width = F.greatest(F.lit(1), F.least(F.lit(BLOCK_TERMS), F.expr(f"{BLOCK_CELLS} div sources"))).cast("long")
    sized = groups.withColumn("width", width)
    blocks = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.expr("(kept - 1) div width")))
    left = sized.withColumn("block", F.explode(blocks)).select(
        "lang", "block", "source", "zero", F.least("width", F.col("kept") - F.col("block") * F.col("width")).alias("terms"))
    right = counts.join(sized.select("lang", "source", "first", "width"), ["lang", "source"]).select(
        "lang", F.expr("(ordinal - first) div width").alias("block"), "source", "ordinal", "p")

    def add(mine: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        mine = mine.sort_values("source", key=lambda c: c.str.encode("utf-8", "surrogatepass")).reset_index(drop=True)
        zero, terms = mine["zero"].to_numpy(np.int64), int(mine["terms"].iloc[0])
        rows, at = np.unique(found["ordinal"].to_numpy(np.int64), return_inverse=True)
        cells = np.tile(zero, (len(rows), 1))
        column = dict(zip(mine["source"], mine.index))
        cells[at, found["source"].map(column).to_numpy(np.int64)] = found["p"].to_numpy(np.int64)
        names = mine["source"].tolist()
        first, second = np.triu_indices(len(names), 1)
        apart = [np.abs(cells[:, a + 1 :] - cells[:, [a]]).sum(axis=0) + (terms - len(rows)) * np.abs(zero[a + 1 :] - zero[a])
                 for a in range(len(names))]
        columns = [[mine["lang"].iloc[0]] * len(first), [names[i] for i in first], [names[i] for i in second]]
        made = pd.DataFrame({k: pd.Series(c, dtype=object) for k, c in zip(("lang", "a", "b"), columns)})
        return made.assign(value=np.concatenate(apart))

    keys = ["lang", "block"]
    sums = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        add, "lang string, a string, b string, value long")
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, least: int = LEAST_DOCUMENTS, shown: int = SHOWN, shard_terms: int = SHARD_TERMS,
          pass_bytes: int = PASS_BYTES) -> DataFrame:
    """How far the sources of each language of ``docs`` (lang, source, text) are apart in kept terms.

    Rows (lang, source, part, item, value, rank). Part ``pair``: every other source of the language
    and the sum of share differences to it. Part ``term``: the first ``shown`` terms that the source
    uses more than its language does. Ties go by byte order, of terms by their ordinals.

    Null lang, source and text stand as empty strings; an empty string is a language or a source like
    any other. Repeated rows count each. A language without kept terms has pairs of value 0, a source
    without any the shares of no occurrence; a single source has no pairs. An empty table gives an
    empty frame; other columns are ignored. Texts are counted whole.
    """
    terms = materialize(kept_terms(docs, least), "terms")
    shards = materialize(transducers(terms, shard_terms), "transducers")
    counts = materialize(recount(docs, shards, shard_terms, pass_bytes), "term_counts")

    langs = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.min("ordinal").alias("first"))
    occurring = _filled(docs).select("lang", "source").distinct()
    own = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    whole = own.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    zero = F.lit(0).cast("long")
    groups = occurring.join(own, ["lang", "source"], "left").join(langs, "lang", "left").join(whole, "lang", "left").join(
        occurring.groupBy("lang").agg(F.count("*").alias("sources")), "lang"
    ).select("lang", "source", "sources", *[F.coalesce(c, zero).alias(c) for c in ("total", "kept", "first", "lang_total")])
    groups = materialize(groups.withColumn(
        "zero", F.when(F.col("kept") > 0, share(zero, F.col("total"), F.col("kept"))).otherwise(zero)), "groups")

    known = counts.join(groups.select("lang", "source", "total", "kept", "lang_total"), ["lang", "source"])
    shares = known.withColumn("p", share(F.col("n"), F.col("total"), F.col("kept")))
    pairs = _pair_sums(shares.select("lang", "source", "ordinal", "p"), groups)
    both = pairs.select("lang", F.explode(F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
        F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value").select("lang", "x.*", "value")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair_rows = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))

    everywhere = counts.groupBy("ordinal").agg(F.sum("n").alias("lang_n"))
    more = shares.join(everywhere, "ordinal").withColumn(
        "value", F.col("p") - share(F.col("lang_n"), F.col("lang_total"), F.col("kept"))).where("value > 0")
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "ordinal")
    top = more.select("lang", "source", "ordinal", "value", F.row_number().over(first).alias("rank")).where(F.col("rank") <= shown)
    term_rows = top.join(terms.select("ordinal", "term"), "ordinal").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    return pair_rows.unionByName(term_rows)


SQL_OP13 = rf"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS r, regexp_extract_all(
    translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{TERM}') AS terms FROM documents
), occurrences AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
counted AS (SELECT r, lang, source, term, count(*) AS c FROM occurrences GROUP BY ALL),
kept AS (SELECT lang, term FROM counted GROUP BY lang, term HAVING count(*) >= {LEAST_DOCUMENTS}),
vocabulary AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
grouped AS (SELECT DISTINCT lang, source FROM d),
counts AS (
  SELECT lang, source, term, sum(c) AS c FROM counted JOIN kept USING (lang, term) GROUP BY lang, source, term
), sizes AS (
  SELECT lang, source, coalesce(sum(c), 0) AS n FROM grouped LEFT JOIN counts USING (lang, source) GROUP BY lang, source
), shares AS (
  SELECT s.lang, s.source, k.term, coalesce(c.c, 0) AS c,
    1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.c, 0) + {ADDED})) // (s.n + {ADDED} * v.v) AS p
  FROM sizes s JOIN kept k ON k.lang = s.lang JOIN vocabulary v ON v.lang = s.lang
  LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
), lang_counts AS (SELECT lang, term, sum(c) AS c FROM counts GROUP BY lang, term),
lang_sizes AS (SELECT lang, sum(c) AS n FROM counts GROUP BY lang),
lang_shares AS (
  SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (c + {ADDED})) // (n + {ADDED} * v) AS q
  FROM lang_counts JOIN lang_sizes USING (lang) JOIN vocabulary USING (lang)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), all_pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(p.value, 0) AS value
  FROM grouped a JOIN grouped b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
), used AS (
  SELECT lang, source, term AS item, p - q AS value FROM shares JOIN lang_shares USING (lang, term) WHERE c > 0 AND p > q
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value,
    row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM all_pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) FROM used
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= {SHOWN}
"""


@query("op13_divergence", SQL_OP13)
def op13(spark, sf):
    """Divergence of the sources of all documents."""
    return audit(table(spark, sf, "documents"))
