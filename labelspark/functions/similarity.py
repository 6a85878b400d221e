"""Indel similarity: ``ratio = 200 * LCS / (|a| + |b|)`` and its best-window variant.

Spark has no LCS function (``levenshtein`` counts substitutions), so scoring runs in Arrow UDFs.
The kernel is bit-parallel and works on whole Arrow batches: every pair of the batch advances
one character per numpy step, with needles longer than 64 characters spread over several words.

The UDFs are marked non-deterministic although they are not: it keeps the optimizer from
copying a scored column into pushed-down filters and scoring rows twice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAD = np.uint32(0x110000)  # one past the last code point
WORD = 64
BLOCK = 1 << 19  # windows or characters handled per numpy block
STRIDE = 4  # every fourth window is scored before the rest are bounded
BEST_LINE = T.StructType(
    [T.StructField("score", T.DoubleType()), T.StructField("pos", T.IntegerType())]
)


def _codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter((len(s) for s in strings), np.int64, len(strings))
    raw = "".join(strings).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(raw, np.uint32), lengths


def _ragged(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each length, concatenated."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def _match_bits(needles: list[str], text: np.ndarray, owner: np.ndarray) -> list[np.ndarray]:
    """Per text position, the bit set of needle positions holding the same character.

    ``owner`` is the pair index of each position. Characters are renumbered to the small
    alphabet of the batch's needles, so the lookup is one dense table.
    """
    unique: dict[str, int] = {}
    which = np.fromiter((unique.setdefault(x, len(unique)) for x in needles), np.int64,
                        len(needles))
    needle_codes, sizes = _codes(list(unique))
    words = int((sizes.max() + WORD - 1) // WORD)
    alphabet = np.unique(needle_codes)
    width = len(alphabet) + 1
    renumber = np.zeros(int(PAD) + 1, np.int32)
    renumber[alphabet] = np.arange(1, width)
    needle_pos = _ragged(sizes)
    cell = np.repeat(np.arange(len(unique)), sizes) * width + renumber[needle_codes]
    at = which[owner] * width + renumber[text]
    blank = renumber[text] == 0
    out = []
    for word in range(words):
        table = np.zeros(len(unique) * width, np.uint64)
        inside = (needle_pos // WORD) == word
        np.bitwise_or.at(
            table, cell[inside], np.uint64(1) << (needle_pos[inside] % WORD).astype(np.uint64)
        )
        bits = table[at]
        bits[blank] = 0
        out.append(bits)
    return out


def _advance(state: list[np.ndarray], bits: list[np.ndarray], at: np.ndarray, upto: int) -> None:
    """One text character for the first ``upto`` rows of the LCS state."""
    carry = None
    last = len(state) - 1
    for word, column in enumerate(state):
        s = column[:upto]
        u = s & bits[word][at]
        total = s + u
        over = None
        if word < last:
            over = total < s
        if carry is not None:
            total = total + carry.astype(np.uint64)
            if over is not None:
                over |= (total == 0) & carry
        column[:upto] = total | (s - u)
        carry = over


def _lcs(state: list[np.ndarray], needle_sizes: np.ndarray) -> np.ndarray:
    """Needle bits that turned to zero."""
    total = np.zeros(len(needle_sizes), np.int64)
    for word, column in enumerate(state):
        width = np.clip(needle_sizes - word * WORD, 0, WORD)
        mask = np.where(
            width == WORD, np.uint64(0xFFFFFFFFFFFFFFFF),
            (np.uint64(1) << np.minimum(width, WORD - 1).astype(np.uint64)) - np.uint64(1),
        )
        total += np.bitwise_count(~column & mask).astype(np.int64)
    return total


def _blocks(sizes: np.ndarray):
    """Split pair indices so each block holds about BLOCK characters."""
    start, used = 0, 0
    for i, size in enumerate(sizes):
        if i > start and used + size > BLOCK:
            yield start, i
            start, used = i, 0
        used += size
    if start < len(sizes):
        yield start, len(sizes)


def ratios(left: list[str], right: list[str]) -> np.ndarray:
    """Full-string similarity of each pair, 0..100."""
    out = np.zeros(len(left))
    live = []
    for i, (a, b) in enumerate(zip(left, right)):
        if a == b:
            out[i] = 100.0
        elif a and b:
            live.append((i, a, b) if len(a) <= len(b) else (i, b, a))
    live.sort(key=lambda pair: -len(pair[2]))
    sizes = np.array([len(pair[2]) for pair in live], np.int64)
    for lo, hi in _blocks(sizes):
        part = live[lo:hi]
        text, n = _codes([pair[2] for pair in part])
        owner = np.repeat(np.arange(len(part)), n)
        bits = _match_bits([pair[1] for pair in part], text, owner)
        m = np.array([len(pair[1]) for pair in part], np.int64)
        begin = np.cumsum(n) - n
        state = [np.full(len(part), 0xFFFFFFFFFFFFFFFF, np.uint64) for _ in bits]
        for step in range(int(n[0])):
            upto = int(np.searchsorted(-n, -step, side="left"))
            _advance(state, bits, begin[:upto] + step, upto)
        out[[pair[0] for pair in part]] = 200.0 * _lcs(state, m) / (m + n)
    return out


def _score_windows(bits, begin, m, n, pair, off) -> tuple[np.ndarray, np.ndarray]:
    """LCS and score of the windows (pair, off); pairs come sorted by needle length, longest
    first."""
    lcs = np.empty(len(pair), np.int64)
    for a in range(0, len(pair), BLOCK):
        owner = pair[a: a + BLOCK]
        size = m[owner]
        first = begin[owner] + off[a: a + BLOCK]
        state = [np.full(len(owner), 0xFFFFFFFFFFFFFFFF, np.uint64) for _ in bits]
        ends = np.searchsorted(-size, -np.arange(int(size[0])), side="left")
        for step, upto in enumerate(ends):
            _advance(state, bits, first[:upto] + step, int(upto))
        lcs[a: a + BLOCK] = _lcs(state, size)
    return lcs, 200.0 * lcs / (m[pair] + _window_size(off, m[pair], n[pair]))


def _window_size(off: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.minimum(np.minimum(off + 1, m), n + m - 1 - off)


def window_ratios(
    left: list[str], right: list[str], group: np.ndarray | None = None
) -> np.ndarray:
    """Best similarity of the shorter string against windows of the longer, 0..100.

    Windows are every full-length slice plus the shorter prefixes and suffixes; padding the
    longer string on both sides turns those into ordinary windows. Strings of equal length are
    scored in both directions.

    The LCS of neighbouring windows differs by at most one, so every fourth window is scored
    first and the others only where that bound still reaches the best score. With ``group``
    (a group number per pair) the best is shared: pairs below their group's best may then
    report less than their own maximum, never more.
    """
    out = np.zeros(len(left))
    live = []
    for i, (a, b) in enumerate(zip(left, right)):
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        if not short:
            out[i] = 100.0 if not long else 0.0
        elif short in long:
            out[i] = 100.0
        else:
            live.append((i, short, long))
            if len(short) == len(long):
                live.append((i, long, short))
    group = np.arange(len(left)) if group is None else group
    best = np.zeros(int(group.max()) + 1 if len(group) else 0)
    np.maximum.at(best, group, out)
    live.sort(key=lambda item: -len(item[1]))
    sizes = np.array([len(item[1]) * 2 + len(item[2]) for item in live], np.int64)
    for lo, hi in _blocks(sizes):
        part = live[lo:hi]
        index = np.array([item[0] for item in part])
        m = np.array([len(item[1]) for item in part], np.int64)
        text, n = _codes([item[2] for item in part])
        padded = n + 2 * (m - 1)
        begin = np.cumsum(padded) - padded
        codes = np.full(int(padded.sum()), PAD, np.uint32)
        codes[np.repeat(begin + m - 1, n) + _ragged(n)] = text
        bits = _match_bits(
            [item[1] for item in part], codes, np.repeat(np.arange(len(part)), padded)
        )
        count = n + m - 1
        coarse = (count + STRIDE - 1) // STRIDE
        pair = np.repeat(np.arange(len(part)), coarse)
        off = _ragged(coarse) * STRIDE
        lcs, score = _score_windows(bits, begin, m, n, pair, off)
        np.maximum.at(out, index[pair], score)
        np.maximum.at(best, group[index[pair]], score)
        # Bound the windows between two scored ones; one past the end has an LCS of zero.
        after = np.append(lcs[1:], 0)
        last = np.append(pair[1:] != pair[:-1], True)
        after[last] = 0
        gap = np.where(last, count[pair] - off, STRIDE)
        fine_pair, fine_off = [], []
        for d in range(1, STRIDE):
            spot = off + d
            inside = spot < count[pair]
            reach = np.minimum(lcs + d, after + gap - d)
            size = np.maximum(_window_size(spot, m[pair], n[pair]), 1)
            bound = 200.0 * np.minimum(reach, size) / (m[pair] + size)
            keep = inside & (bound >= best[group[index[pair]]])
            fine_pair.append(pair[keep])
            fine_off.append(spot[keep])
        pair, off = np.concatenate(fine_pair), np.concatenate(fine_off)
        if len(pair):
            order = np.argsort(pair, kind="stable")
            pair, off = pair[order], off[order]
            _, score = _score_windows(bits, begin, m, n, pair, off)
            np.maximum.at(out, index[pair], score)
            np.maximum.at(best, group[index[pair]], score)
    return out


def _dedupe(left: list, right: list) -> tuple[list[str], list[str], np.ndarray]:
    seen: dict = {}
    where = np.fromiter(
        (seen.setdefault(pair, len(seen)) for pair in zip(left, right)), np.int64, len(left)
    )
    pairs = list(seen)
    return [p[0] for p in pairs], [p[1] for p in pairs], where


def _score_batch(kernel, a: pa.Array, b: pa.Array) -> pa.Array:
    left, right = a.to_pylist(), b.to_pylist()
    null = np.array([x is None or y is None for x, y in zip(left, right)], bool)
    left, right, where = _dedupe(
        ["" if gone else x for x, gone in zip(left, null)],
        ["" if gone else y for y, gone in zip(right, null)],
    )
    return pa.array(kernel(left, right)[where], pa.float64(), mask=null)


@F.arrow_udf(T.DoubleType())
def _ratio_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    return _score_batch(ratios, a, b)


@F.arrow_udf(T.DoubleType())
def _window_ratio_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    return _score_batch(window_ratios, a, b)


def ratio(a: Column, b: Column) -> Column:
    """Similarity of two strings; a null on either side gives null without scoring."""
    return _ratio_udf.asNondeterministic()(a, b)


def partial_ratio(a: Column, b: Column) -> Column:
    return _window_ratio_udf.asNondeterministic()(a, b)


def best_lines(claims: list[str], texts: list[list[str]], least: int) -> tuple[list, list]:
    """First best candidate of each claim among its lines and the whole text.

    Returns scores and 1-based positions (0 when nothing scored). Ratios are computed only
    where their length bound can still beat the row's best window score.
    """
    rows, pos, needle, line = [], [], [], []
    for row, (claim, lines) in enumerate(zip(claims, texts)):
        shown = [(p, x) for p, x in enumerate(lines, 1) if x]
        if len(shown) > 1:
            shown.append((len(lines) + 1, " ".join(x for _, x in shown)))
        for p, x in shown:
            rows.append(row)
            pos.append(p)
            needle.append(claim)
            line.append(x)
    score = np.zeros(len(rows))
    owner = np.array(rows, np.int64)
    place = np.array(pos, np.int64)
    best = np.zeros(len(claims))
    if rows:
        solid = [len(c) - c.count(" ") for c in claims]
        wide = np.array([
            solid[r] >= least and len(x) - x.count(" ") >= solid[r] for r, x in zip(rows, line)
        ], bool)
        at = np.flatnonzero(wide)
        score[at] = window_ratios([needle[i] for i in at], [line[i] for i in at], owner[at])
        np.maximum.at(best, owner, score)
        a = np.fromiter(map(len, needle), np.int64, len(needle))
        b = np.fromiter(map(len, line), np.int64, len(line))
        bound = 200.0 * np.minimum(a, b) / (a + b)
        last = place > np.array([len(texts[r]) for r in rows])
        for group in (~last, last):
            at = np.flatnonzero(group & (bound > score) & (bound >= best[owner]))
            full = ratios([needle[i] for i in at], [line[i] for i in at])
            score[at] = np.maximum(score[at], full)
            np.maximum.at(best, owner[at], full)
    first = np.full(len(claims), np.iinfo(np.int64).max)
    if rows:
        top = (score > 0) & (score == best[owner])
        np.minimum.at(first, owner[top], place[top])
    first[best <= 0] = 0
    return best, first


def best_line_udf(least: int):
    """Arrow UDF (claim, lines) -> struct<score, pos>; null lines are skipped."""

    @F.arrow_udf(BEST_LINE)
    def score(claim: pa.Array, lines: pa.Array) -> pa.Array:
        claims, texts = claim.to_pylist(), lines.to_pylist()
        at = [i for i, (c, t) in enumerate(zip(claims, texts)) if c and t is not None]
        best, first = best_lines([claims[i] for i in at], [texts[i] for i in at], least)
        scores, places = np.zeros(len(claims)), np.zeros(len(claims), np.int32)
        scores[at], places[at] = best, first
        return pa.StructArray.from_arrays(
            [pa.array(scores, pa.float64()), pa.array(places, pa.int32())], ["score", "pos"]
        )

    return score.asNondeterministic()
