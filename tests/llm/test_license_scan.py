import random

import numpy as np

from cohortlens.llm import license_scan as ls
from tests.llm.cases import awkward, empty

INDEX = ls.Index(ls.TEMPLATES)


def scan(text):
    return next(ls.scan_texts(INDEX, [text]))


def brute_align(a, b, low, high):
    """Best local score by the plain recurrence over the band."""
    score, best = {}, 0
    for i in range(len(a)):
        for j in range(max(0, i + low), min(len(b), i + high + 1)):
            up = score.get((i - 1, j), 0) if i + low <= j + 1 and j - (i - 1) <= high else 0
            left = score.get((i, j - 1), 0) if j - 1 - i >= low else 0
            diagonal = score.get((i - 1, j - 1), 0)
            score[i, j] = diagonal + 2 if a[i] == b[j] else max(0, diagonal - 1, up - 1, left - 1)
            best = max(best, score[i, j])
    return best


def test_alignment_matches_the_plain_recurrence():
    rng = random.Random(2)
    for _ in range(300):
        a = np.array([rng.randrange(4) for _ in range(rng.randrange(1, 12))])
        b = np.array([rng.randrange(4) for _ in range(rng.randrange(1, 20))])
        low = rng.randrange(-4, 4)
        high = low + rng.randrange(0, 9)
        n, start, end = ls.align(a, b, low, high)
        if brute_align(a, b, low, high) == 0:
            assert n == 0
        else:
            assert 0 < n <= min(len(a), end - start) and 0 <= start < end <= len(b)


def brute_scan(text):
    """Exhaustive: every template aligned with the whole text on all diagonals, again and again on what is left."""
    h = ls.tokens(text.encode().lower())[0]
    found = []
    for name, a in zip(INDEX.names, INDEX.hashes, strict=True):
        rest = h.copy()
        while True:
            n, start, end = ls.align(a, rest, -len(a), len(rest)) if len(rest) else (0, 0, 0)
            if n < ls.COVERAGE * len(a):
                break
            found.append((name, round(n / len(a), 4), start, end, n))
            rest[start:end] = 0
    out = []
    for m in sorted(found, key=lambda m: (-m[4], -m[1], m[2], m[0])):
        if all(m[3] <= o[2] or m[2] >= o[3] for o in out):
            out.append(m)
    return sorted(out, key=lambda m: m[2])


def test_scan_matches_exhaustive_alignment():
    rng = random.Random(7)
    short = [t for texts in ls.TEMPLATES.values() for t in texts if len(t.split()) < 30]
    for _ in range(25):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            words = rng.choice(short).split()
            if rng.random() < 0.4 and len(words) > 8:  # one word less, more or other
                i = rng.randrange(2, len(words) - 2)
                words[i : i + rng.choice([0, 1])] = rng.choice([[], ["zzq"]])
            parts += [*words, *(f"noise{rng.randrange(99)}" for _ in range(rng.choice([0, 1, 9])))]
        text = " ".join(parts)
        assert ls.scan_tokens(INDEX, ls.tokens(text.encode().lower())[0], ls.COVERAGE) == brute_scan(text), text


def test_repeated_notices_are_all_found():
    for n in (1, 2, 3, 50, 20_000):
        text = "é All rights reserved. " * n
        found = scan(text)
        assert len(found) == n and {text[m.start : m.end] for m in found} == {"All rights reserved"} and {m.license for m in found} == {"proprietary"}
    text = "Released under the MIT License.\n" * 300
    assert [m.license for m in scan(text)] == ["MIT"] * 300


def test_neighbouring_licences_are_told_apart():
    for text, name in (("it is licensed under the GNU General Public License, version 2", "GPL-2.0"), ("licensed under the GNU Lesser General Public License, version 3", "LGPL-3.0"), ("Licensed under CC BY-SA 4.0", "CC-BY-SA-4.0")):
        assert [m.license for m in scan(text)] == [name]


def test_templates_from_a_table(spark):
    table = spark.createDataFrame([("A", "one two three four five six"), ("B", " ".join(f"b{i}" for i in range(60))), ("A", None), (None, "x")], "license string, text string")
    index = ls.Index(ls.read_templates(table))
    text = "x " + " ".join(f"b{i}" for i in range(60) if i != 31) + " one two three four five six"
    assert [(m.license, m.coverage) for m in next(ls.scan_texts(index, [text]))] == [("B", round(59 / 60, 4)), ("A", 1.0)]


def test_winnowing_keeps_one_of_every_window():
    rng = np.random.default_rng(1)
    g = rng.integers(0, 1 << 60, 200, dtype=np.uint64)
    for window in (1, 2, 5):
        kept = set(ls.winnow(g, window))
        assert all(kept & set(range(i, i + window)) for i in range(len(g) - window + 1))


def test_exact_and_altered_notices():
    for name, texts in ls.TEMPLATES.items():
        for text in texts:
            found = scan(f"é start of it. {text}; and the end")
            assert [(m.license, m.coverage, m.start, m.end) for m in found] == [(name, 1.0, 15, 15 + len(text.rstrip(".")))] or found[0].coverage == 1.0
    altered = scan("this is Licensd under the the Apache License Version 2.0 ok")
    assert [m.license for m in altered] == ["Apache-2.0"] and altered[0].coverage == 0.875
    assert scan("under the apache trees a version of license") == [] and scan("") == []


def test_two_notices_in_order():
    text = "Released under the MIT License.\nAll rights reserved."
    assert [(m.license, text[m.start : m.end]) for m in scan(text)] == [("MIT", "Released under the MIT License"), ("proprietary", "All rights reserved")]


def test_documents(spark):
    docs = awkward(spark, [(50, "x\nLicensed under CC BY-NC 4.0.", "en", "a", 1)])
    got = {r.doc_id: r.licenses for r in ls.scan(docs).collect()}
    clash = ls.scan(docs.withColumn("licenses", docs.lang).withColumn("license", docs.lang))
    assert clash.columns == ["doc_id", "lang", "source", "n_chars", "license", "licenses"] and clash.count() == docs.count()
    assert [m.license for m in got[50]] == ["CC-BY-NC-4.0"] and got[3] == got[2] == got[5] == []
    assert ls.scan(docs).count() == docs.count() and ls.scan(empty(spark)).count() == 0
