import random

from labelspark.functions import similarity as S


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def ratio(a, b):
    return 200 * lcs(a, b) / (len(a) + len(b))


def window(a, b):
    if len(a) > len(b):
        a, b = b, a
    best = 0
    for s, t in [(a, b)] + ([(b, a)] if len(a) == len(b) else []):
        for i in range(1 - len(s), len(t)):
            part = t[max(i, 0): i + len(s)]
            if part:
                best = max(best, ratio(s, part))
    return best


def _words(rng, longest):
    return "".join(rng.choice("abcdé ") for _ in range(rng.randint(1, longest)))


def test_ratios_match_plain_dynamic_programming():
    rng = random.Random(5)
    pairs = [(_words(rng, n), _words(rng, n)) for n in (3, 20, 70, 150) for _ in range(25)]
    got = S.ratios([p[0] for p in pairs], [p[1] for p in pairs])
    assert all(abs(g - ratio(*p)) < 1e-9 for g, p in zip(got, pairs))


def test_window_ratios_match_every_window():
    rng = random.Random(6)
    pairs = [(_words(rng, n), _words(rng, 2 * n)) for n in (4, 12, 70) for _ in range(20)]
    got = S.window_ratios([p[0] for p in pairs], [p[1] for p in pairs])
    assert all(abs(g - window(*p)) < 1e-9 for g, p in zip(got, pairs))


def test_best_lines_match_brute_force():
    rng = random.Random(7)
    for _ in range(150):
        claim = " ".join(_words(rng, 5).strip() or "a" for _ in range(rng.randint(1, 3)))
        claim = " ".join(claim.split())
        text = [" ".join(_words(rng, 14).split()) for _ in range(rng.randint(0, 5))]
        solid = len(claim.replace(" ", ""))
        best, place = 0.0, 0
        whole = " ".join(t for t in text if t)
        for p, line in [*enumerate(text, 1), (len(text) + 1, whole)]:
            if not line:
                continue
            score = ratio(claim, line)
            if solid >= 5 and len(line.replace(" ", "")) >= solid:
                score = max(score, window(claim, line))
            if score > best:
                best, place = score, p
        got, at = S.best_lines([claim], [text], 5)
        assert abs(got[0] - best) < 1e-9 and at[0] == place, (claim, text)
