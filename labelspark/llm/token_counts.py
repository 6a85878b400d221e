"""Token counts: the exact count of every prefix of a text, by dynamic programming over merges."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from labelspark.llm.common import query, table

DEFAULT_VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Prefixes in a row of a stored table.
BLOCK = 4096
#: Below this code point nothing composes, and all but ``WIDENS`` keep their place when lower-cased.
COMPOSING, WIDENS = 0x300, "İ"
#: Words whose tables are kept by a task, and the length up to which they are.
KEPT_WORDS, KEPT_LENGTH = 500_000, 64
#: Ends of the patterns that split text as this operator expects it: after fixed strings come these.
CLASSES = [r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+"]
#: A code point of each kind that stands for all others of it while a text is split.
STAND_INS = {"letter": "ª", "number": "²", "space": " ", "other": "¬"}


class PrefixTokens:
    """Counts the tokens of prefixes for a BPE vocabulary file with word ends (tokenizers' JSON).

    Merging by rank gives each word prefix one encoding, and a row of tokens is that encoding if each
    neighbouring pair is. So the encoding of a prefix ends in the one token that fits both the text
    and the last token of the shorter prefix before it, and its count is that prefix's count plus
    one: no prefix is ever encoded again. A prefix that ends inside a word ends in the word-end form
    of its last symbol, which is looked up against the same shorter prefixes.
    """

    def __init__(self, data: bytes):
        spec = json.loads(data)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix")
        parts = [p.get("pattern", {}).get("Regex") for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        alternatives = (parts[0] or "").split("|") if parts else []
        if model.get("type") != "BPE" or not self.end or alternatives[-3:] != CLASSES:
            raise ValueError("the vocabulary must be BPE with word ends over runs of letters, digits and other signs")
        self.library = Tokenizer.from_buffer(data)
        self.fixed = alternatives[:-3]
        self.widest = max(map(len, self.fixed), default=0)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self._index_merges(model)
        self.kinds: dict[int, str] = {}
        own = {"letter": "", "number": "", "space": "", "other": ""}
        for c in [*range(COMPOSING)]:
            own[self._kind(chr(c))] += re.escape(chr(c))
        self.pieces = re.compile("|".join(
            [*map(re.escape, self.fixed), f"[{own['letter']}]+", f"[{own['number']}]",
             f"[^{own['space']}{own['letter']}{own['number']}]+"]))
        self.parted = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.plain = re.compile(f"[\x00-{chr(COMPOSING - 1)}]*")
        self.totals = _Totals(self)
        self.held: dict[str, list[int]] = {}
        self.fits: dict[tuple[int, int], bool] = {}

    # --- vocabulary -----------------------------------------------------------------------

    def _index_merges(self, model: dict) -> None:
        vocab = model["vocab"]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair, whole = (vocab[left], vocab[right]), vocab[left + right]
            earlier = max((self.made[t][0] for t in pair if t in self.made), default=-1)
            if whole in self.made or earlier >= rank:
                raise ValueError("every token must come from one merge, after the merges of its parts")
            self.rank[pair] = rank
            self.made[whole] = (rank, *pair)
        self.never = len(model["merges"])
        # A token takes part if merging its own symbols ends in it.
        self.whole: set[int] = set()
        for i in sorted(vocab.values(), key=lambda i: self.made.get(i, (-1,))[0]):
            if i not in self.made or (
                self.made[i][1] in self.whole and self.made[i][2] in self.whole
                and self._meets(*self.made[i][1:]) == self.made[i][0]
            ):
                self.whole.add(i)
        # Every ending of a token that takes part, and the token if it is all of one.
        self.open: dict[str, int] = {}
        self.closed: dict[str, int] = {}
        for t, i in vocab.items():
            if i in self.whole:
                shut = t.endswith(self.end)
                t, known = (t[: -len(self.end)], self.closed) if shut else (t, self.open)
                for start in range(1, len(t)):
                    known.setdefault(t[start:], -1)
                known[t] = i
        self.longest = max(map(len, [*self.open, *self.closed]))

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """(token, rank at which it is merged on) along the edge, from the single symbol outwards."""
        spine = [(token, self.never)]
        while token in self.made:
            rank, *parts = self.made[token]
            token = parts[side]
            spine.append((token, rank))
        return spine[::-1]

    def _meets(self, left: int, right: int) -> int:
        """Rank of the first merge across the border of two tokens' symbols, ``never`` without one.

        Merges come in order of rank, so both edges grow on their own until a pair of what stands at
        the border is next. Of equal merges the leftmost comes first.
        """
        a, b = self._edge(left, 1), self._edge(right, 0)
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = a[i], b[j]
            rank = self.rank.get((x, y), self.never)
            if rank < x_until and rank <= y_until and rank < self.never:
                return rank
            if x_until == y_until == self.never:
                return self.never
            if x_until <= y_until:
                i += 1
            if y_until <= x_until:
                j += 1

    def _fit(self, left: int, right: int) -> bool:
        key = (left, right)
        found = self.fits.get(key)
        if found is None:
            found = self.fits[key] = self._meets(left, right) == self.never
        return found

    # --- words ----------------------------------------------------------------------------

    def _last(self, text: str, i: int, tokens: dict[str, int], last: list[int]) -> tuple[int, int]:
        """(token, its start): the one token that ends the encoding of ``text[:i]``."""
        found = []
        for start in range(i - 1, -1, -1):
            token = tokens.get(text[start:i])
            if token is None:
                break
            if token >= 0:
                found.append((token, start))
        for token, start in reversed(found):
            if start == 0 or self._fit(last[start], token):
                return token, start
        raise ValueError("a symbol isn't in the vocabulary")

    def _walk(self, symbols: str, last: list[int], count: list[int], ends: list[int]) -> list[int]:
        """Counts of ``symbols[:end]`` as a word for each end; ``last`` and ``count`` grow along."""
        out, at = [], set(ends)
        for i in range(len(last), len(symbols) + 1):
            if i in at:
                _, start = self._last(symbols, i, self.closed, last)
                out.append(count[start] + 1)
            if i < len(symbols):
                token, start = self._last(symbols, i, self.open, last)
                last.append(token)
                count.append(count[start] + 1)
        return out

    def word(self, piece: str) -> list[int]:
        """Counts of the prefixes of one piece, a number for each of its code points."""
        found = self.held.get(piece)
        if found is None:
            if piece in self.fixed:
                found = [sum(map(self.totals.__getitem__, self.split(piece[:j]))) if j < len(piece)
                         else self._walk(_symbols(piece), [-1], [0], [len(_symbols(piece))])[0]
                         for j in range(1, len(piece) + 1)]
            else:
                found = self._walk(_symbols(piece), [-1], [0], _ends(piece))
            if len(piece) <= KEPT_LENGTH:
                if len(self.held) >= KEPT_WORDS:
                    self.held.clear()
                self.held[piece] = found
        return found

    # --- texts ----------------------------------------------------------------------------

    def _kind(self, c: str) -> str:
        """How the library splits at a code point (asked once for each)."""
        split = self.library.pre_tokenizer.pre_tokenize_str
        if not split(c):
            return "space"
        if len(split(c + c)) == 2:
            return "number"
        return "letter" if len(split("a" + c)) == 1 else "other"

    def _shape(self, text: str) -> str:
        """The text with a stand-in of its kind for every code point outside the pattern's range."""
        if self.plain.fullmatch(text):
            return text
        for c in {ord(c) for c in text if ord(c) >= COMPOSING} - self.kinds.keys():
            self.kinds[c] = STAND_INS[self._kind(chr(c))]
        return text.translate(self.kinds)

    def split(self, text: str) -> list[str]:
        """Pieces of a text in normal form."""
        return [text[m.start() : m.end()] for m in self.pieces.finditer(self._shape(text))]

    def _simple(self, text: str) -> bool:
        return WIDENS not in text and bool(self.plain.fullmatch(text))

    def count(self, text: str | None) -> int:
        """Tokens of a whole text: the sum of its words' counts at their last prefix."""
        if not text:
            return 0
        if self.parted and any(s in text for s in self.special):
            return sum(1 if s in self.special else self.count(s) for s in self.parted.split(text))
        if self._simple(text):
            return sum(map(self.totals.__getitem__, self.pieces.findall(text.lower())))
        return sum(map(self.totals.__getitem__, self.split(self.library.normalizer.normalize_str(text))))

    def prefixes(self, text: str | None) -> np.ndarray:
        """Tokens of ``text[:i]`` for every i from 0 to the number of its code points."""
        text = text or ""
        out = np.zeros(len(text) + 1, dtype=np.int32)
        at = base = 0
        parts = self.parted.split(text) if self.parted else [text]
        for part in parts:
            if part in self.special:
                before = text[max(0, text.rfind(" ", 0, at) + 1) : at]
                out[at + 1 : at + len(part)] = self._inside(out, text, at, len(part), parts, before)
                base += 1
                out[at + len(part)] = base
            else:
                self._fill(out, part, at, base)
                base = int(out[at + len(part)])
            at += len(part)
        return out

    def _inside(self, out: np.ndarray, text: str, at: int, length: int, parts: list[str], before: str) -> list[int]:
        """Counts of prefixes that end inside a special string, which is ordinary text until it is whole.

        ``before`` is the text since the last space; only what follows the last special string in it,
        and from there the last piece, can grow together with the string's beginning.
        """
        for s in self.special:
            cut = before.rfind(s)
            before = before[cut + len(s) :] if cut >= 0 else before
        base = int(out[at - len(before)])
        return [base + self.count(before + text[at : at + j]) for j in range(1, length)]

    def _fill(self, out: np.ndarray, text: str, at: int, base: int) -> None:
        """Counts of the prefixes of a part without special strings, into ``out`` from ``at`` on."""
        if self._simple(text):
            made, places, shape = text.lower(), None, text.lower()
        else:
            clusters = _clusters(text)
            normal = [self.library.normalizer.normalize_str(text[a:b]) for a, b in clusters]
            made = "".join(normal)
            shape = self._shape(made)
            places = np.concatenate([[0], np.cumsum([len(n) for n in normal])]) if normal else np.zeros(1, np.int64)
        counts = np.empty(len(made) + 1, dtype=np.int32)
        counts[0] = base
        done, begins = 0, np.zeros(len(made) + 1, dtype=np.int64)
        for m in self.pieces.finditer(shape):
            counts[done + 1 : m.start() + 1] = base
            begins[done + 1 : m.start() + 1] = np.arange(done + 1, m.start() + 1)
            counts[m.start() + 1 : m.end() + 1] = self.word(made[m.start() : m.end()])
            begins[m.start() + 1 : m.end() + 1] = m.start()
            counts[m.start() + 1 : m.end() + 1] += base
            done, base = m.end(), int(counts[m.end()])
        counts[done + 1 :] = base
        begins[done + 1 :] = np.arange(done + 1, len(made) + 1)
        if places is None:
            out[at : at + len(text) + 1] = counts
            return
        out[at], grown = counts[0], None
        for k, (a, b) in enumerate(clusters):
            out[at + b] = counts[places[k + 1]]
            if b - a > 1:  # prefixes that end among the marks: the open piece goes on in another form
                head = int(places[k])
                start = int(begins[head])
                before = int(begins[start])
                if before < start and head - before < self.widest:
                    start = before  # the end of this piece may make a fixed string of both
                if grown is None or grown.start != start:
                    stop = next((e for e in range(head, len(made)) if begins[e + 1] != start), len(made))
                    grown = _Grown(self, made[start:stop], start)
                for j in range(a + 1, b):
                    tail = self.library.normalizer.normalize_str(text[a:j])
                    out[at + j] = int(counts[start]) + grown.count(made[start:head], tail)


class _Totals(dict):
    """Counts of whole words, made when first asked for."""

    def __init__(self, owner: PrefixTokens):
        super().__init__()
        self.owner = owner

    def __missing__(self, piece: str) -> int:
        owner = self.owner
        symbols = _symbols(piece)
        found = owner._walk(symbols, [-1], [0], [len(symbols)])[0]
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[piece] = found
        return found


class _Grown:
    """A piece of a text, walked once, and counts of its prefixes with other endings."""

    def __init__(self, owner: PrefixTokens, piece: str, start: int):
        self.owner, self.start = owner, start
        self.symbols, self.offsets = _symbols(piece), [0, *_ends(piece)]
        self.last, self.count_ = [-1], [0]
        owner._walk(self.symbols + self.symbols[:1], self.last, self.count_, [])

    def count(self, head: str, tail: str) -> int:
        """Tokens of ``head``, a prefix of the piece, with ``tail`` after it."""
        owner = self.owner
        if len(head) <= owner.widest:
            return sum(map(owner.totals.__getitem__, owner.split(head + tail)))
        # Longer than any fixed string: a run of one kind, which goes on as far as its last sign's would.
        first, *rest = owner.split(STAND_INS[owner._kind(head[-1])] + tail)
        at = self.offsets[len(head)]
        cut = max(0, at - owner.longest - 1)
        symbols = self.symbols[cut:at] + _symbols(first[1:])
        last, count = self.last[cut : at + 1], self.count_[cut : at + 1]
        # The last symbol is looked up again as one that ends a word.
        whole = owner._walk(symbols, last, count, [len(symbols)]) if len(first) > 1 else [
            count[owner._last(symbols, len(symbols), owner.closed, last)[1]] + 1]
        return whole[0] + sum(map(owner.totals.__getitem__, rest))


def _byte_signs() -> list[str]:
    """The printable sign of each byte in byte-level vocabularies: itself, or the next free above 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs, free = [""] * 256, 256
    for b in range(256):
        if b in shown:
            signs[b] = chr(b)
        else:
            signs[b], free = chr(free), free + 1
    return signs


SIGNS = dict(enumerate(_byte_signs()))


def _symbols(piece: str) -> str:
    return piece.encode("utf-8").decode("latin-1").translate(SIGNS)


def _ends(piece: str) -> list[int]:
    """Symbols up to the end of each code point."""
    if piece.isascii():
        return [*range(1, len(piece) + 1)]
    return np.cumsum([len(c.encode("utf-8")) for c in piece]).tolist()


_JOINING: set[str] = set()


def _joining() -> set[str]:
    """Code points that can change or reorder what stands before them when a text is composed."""
    if not _JOINING:
        for c in map(chr, range(COMPOSING, 0x110000)):
            parts = unicodedata.decomposition(c).split()
            if len(parts) > 1 and not parts[0].startswith("<"):
                _JOINING.update(chr(int(p, 16)) for p in parts[1:])
            if unicodedata.combining(c):
                _JOINING.add(c)
        _JOINING.update(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]))
    return _JOINING


def _clusters(text: str) -> list[tuple[int, int]]:
    """Spans that compose on their own: a code point and those after it that join."""
    joining = _joining()
    starts = [i for i, c in enumerate(text) if i == 0 or c not in joining]
    return list(zip(starts, [*starts[1:], len(text)]))


# --- jobs ---------------------------------------------------------------------------------

_COUNTERS: dict[int, PrefixTokens] = {}


def _counter(data: bytes) -> PrefixTokens:
    """The task's counter of a vocabulary; words met in earlier batches stay known."""
    key = hash(data)
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = PrefixTokens(data)
    return _COUNTERS[key]


def _shared(docs: DataFrame, vocabulary: str | None):
    """The vocabulary file, a few MB whatever the documents, read by the driver and sent once."""
    with open(vocabulary or public_tokenizers.path(DEFAULT_VOCABULARY), "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def count_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row of ``docs`` (doc_id, text), as the library counts.

    ``vocabulary`` is the path of a JSON file on the driver. Special strings inside a text are one
    token each, as is the library's default; no begin or end tokens are added. A null text counts as
    empty: 0 bytes, 0 tokens. Null ids and repeated rows come back each; other columns go; an empty
    table gives an empty frame. Texts of any length are counted whole, in one narrow pass.
    """
    data = _shared(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(data.value)
        for batch in batches:
            found = [counter.count(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(found, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"])

    sized = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return sized.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")


def prefix_tables(docs: DataFrame, vocabulary: str | None = None, block: int = BLOCK) -> DataFrame:
    """The stored tables: rows (doc_id, text_key, first, least, counts) of up to ``block`` prefixes.

    ``counts[j]`` is the token count of the prefix of ``first + j`` code points (0 to the whole text),
    ``least`` the smallest of the row, ``text_key`` xxhash64 of the text (rows equal in both have the
    same table). A null or empty text has the one prefix 0. Long texts are several rows, so what a
    question reads stays small.
    """
    data = _shared(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(data.value)
        for batch in batches:
            for row, text in enumerate(batch.column("text").to_pylist()):
                counts = counter.prefixes(text)
                firsts = np.arange(0, len(counts), block)
                offsets = np.append(firsts, len(counts))
                same = pa.array(np.full(len(firsts), row))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(same), batch.column("text_key").take(same),
                    pa.array(firsts, pa.int64()), pa.array(np.minimum.reduceat(counts, firsts), pa.int32()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(counts, pa.int32())),
                ], ["doc_id", "text_key", "first", "least", "counts"])

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return keyed.mapInArrow(run, f"doc_id {kind}, text_key long, first long, least int, counts array<int>")


def tokens_at(tables: DataFrame, asked: DataFrame, block: int = BLOCK) -> DataFrame:
    """``asked`` (doc_id, text_key, position) with the tokens before each code point position.

    One row of a table is read for a question. Positions outside the text, null ones and unknown
    texts give null. ``block`` is the tables' own.
    """
    own = tables.select("doc_id", "text_key", "first", "counts").dropDuplicates(["doc_id", "text_key", "first"])
    keyed = asked.select("doc_id", "text_key", "position").withColumn("first", F.expr(f"position div {block} * {block}"))
    same = keyed["doc_id"].eqNullSafe(own["doc_id"]) & (keyed["text_key"] == own["text_key"]) & (
        keyed["first"] == own["first"])
    return keyed.join(own, same, "left").select(
        keyed["doc_id"], keyed["text_key"], "position",
        F.get("counts", (F.col("position") - keyed["first"]).cast("int")).alias("n_tokens"))


def longest_prefixes(tables: DataFrame, budget: int) -> DataFrame:
    """(doc_id, text_key, n_chars): code points of the longest prefix with at most ``budget`` tokens.

    A longer prefix can have fewer tokens, so every row whose smallest count is within the budget is
    looked at; the others aren't.
    """
    inside = F.reverse(F.transform("counts", lambda n: n <= budget))
    last = F.col("first") + F.size("counts") - F.array_position(inside, True)
    return tables.where(F.col("least") <= budget).groupBy("doc_id", "text_key").agg(F.max(last).alias("n_chars"))


def truncate(docs: DataFrame, budget: int, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text, n_tokens): each text cut to its longest prefix of at most ``budget`` tokens."""
    data = _shared(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(data.value)
        for batch in batches:
            texts, counts = [], []
            for text in batch.column("text").to_pylist():
                made = counter.prefixes(text)
                cut = int(np.flatnonzero(made <= budget)[-1])
                texts.append(None if text is None else text[:cut])
                counts.append(int(made[cut]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(counts, pa.int64())],
                ["doc_id", "text", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, text string, n_tokens long")


@query("op11_token_counts")
def op11(spark, sf):
    """Tokens of every whole document, and whether they exceed 2,048."""
    counted = count_tokens(table(spark, sf, "documents"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
