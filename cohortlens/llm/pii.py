"""Personal data: fixed patterns, and a semi-Markov conditional random field on top.

Base spans come from four patterns with checks (e-mail address, IP address, payment card, phone number).  The
field adds spans they miss: the same kinds written with other separators or with signs in words, such as `name (at) site [dot] org`,
`10[.]1[.]2[.]3`, cards cut by points or slashes, phone numbers without a plus.  It looks at regions, which are runs of characters that
could hold such data (around an @ or a written one, or digits with few signs between), and in them at what lies between base spans.  A region's tokens are digit
runs, letter runs and single characters; a segmentation cuts it into entities of at most MOST
tokens and single tokens outside.  The score is a sum of weights of features of each entity's
whole span (shape, digit groups, check digit, octets, separators, neighbouring characters) and of each change from one segment's kind to the
next one's; dynamic programming over (end, length, kind) finds the best segmentation, boundaries and kinds together.  Decoding slides over the
tokens: it scores candidates as they come, remembers the last MOST tokens and, of each token, one number for each kind of the segment that ends there.

Training: log-likelihood of segmentations by AdaGrad, with expected counts of features and changes from forward and
backward sums.  The sample has planted entities (`planted`: made-up ones, written in ways that the patterns miss, and look-alikes such
as dates, versions, tables and numbers that fail their check) and regions of a bounded sample of the documents, whose base spans
are entities and whose other tokens aren't.  The tests report recall of held-out planted spans.

Edge cases: null text is empty text and has no spans; empty documents or a sample without regions leave the planted sample; repeated rows are
scanned one by one; scans and decoding take time linear in the text, and memory for a few numbers a token; empty tables give empty results;
`find_spans` looks at doc_id and text only and `redact` at text only, so other columns' names can't clash.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, by_bytes, frugal

KINDS = ("email", "ip", "card", "phone")
#: Entity length in tokens and characters, at most (a card written digit by digit has 37), and its digits, at least and at most.
MOST, SPAN_CHARS, LEAST_DIGITS, MOST_DIGITS = 40, 120, 4, 19
#: The training sample: documents looked at, regions used, characters of such a region, planted texts.
SAMPLE_DOCS, SAMPLE_REGIONS, REGION_CHARS, PLANTED = 8000, 300, 120, 900
#: Spans whose scores a field remembers.
KNOWN = 1 << 14
EPOCHS, RATE, DECAY = 5, 0.5, 1e-4

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]| at |[(\[{]at[)\]}]")
_NUMBERS = re.compile(r"[+(]?[0-9](?:[\x20()\[\].,+/_-]{0,5}[0-9])*+")
#: How addresses write @ and the point in words.
_AT, _DOT = r"(?: at | ?[(\[{] ?(?:at|@) ?[)\]}] ?| @ ?|@ )", r"(?: dot | ?[(\[{] ?(?:dot|\.) ?[)\]}] ?|\.)"
_WRITTEN = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)+|@[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)+)")
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|.", re.S)
_DIGITS = re.compile("[^0-9]+")
_NINES, _DOUBLED = str.maketrans("012345678", "999999999"), str.maketrans("0123456789", "0246813579")
_LETTERS = re.compile(r"[^\W\d_]+")
_RUN = re.compile(r"(.)\1*", re.S)


def luhn(digits: str) -> bool:
    back = digits[::-1]
    return (sum(map(int, back[::2])) + sum(map(int, back[1::2].translate(_DOUBLED)))) % 10 == 0


def only_digits(s: str) -> str:
    return _DIGITS.sub("", s)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's index, end) of the fixed patterns, sorted; leftmost and non-overlapping for each kind."""
    if not _ANY.search(text):
        return []
    found, pos, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > pos and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, 0, m.end()))
            pos = m.end()
        else:
            pos = at + 1
        at = text.find("@", pos)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := only_digits(m.group())) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(only_digits(m.group())) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def regions(text: str) -> list[tuple[int, int]]:
    """Where the field looks: sorted spans that don't overlap."""
    if not _ANY.search(text):
        return []
    found, at, last = [], text.find("@"), 0
    while at >= 0:
        start = end = at
        while start > last and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        found.append((start, end))
        last, at = end, text.find("@", end)
    if " at " in text or "@" in text or re.search(r"[(\[{] ?at", text):
        found += [m.span() for m in _WRITTEN.finditer(text)]
    for m in _NUMBERS.finditer(text):
        if m.end() - m.start() >= LEAST_DIGITS and len(only_digits(m.group())) >= LEAST_DIGITS:
            found.append(m.span())
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a < merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def between(spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    """What base spans (sorted) leave of the spans (sorted, apart)."""
    k = 0
    for start, end in spans:
        while k < len(base) and base[k][0] < end:
            a, _, b = base[k]
            if a > start:
                yield start, a
            start = max(start, b)
            if b > end:
                break
            k += 1
        if start < end:
            yield start, end


def _side(c: str) -> str:
    return "edge" if not c else "space" if c.isspace() else "digit" if c.isdigit() else "letter" if c.isalpha() else c


def shape_of(span: str) -> str:
    """The span with 9 for each digit, a for each run of letters, and words that stand for signs as they are."""
    return _LETTERS.sub(lambda m: m.group() if m.group() in ("at", "dot") else "a", span.translate(_NINES))


def checks(span: str, n: int) -> tuple[str, str]:
    """What a span's n digits say of a card's check digit and of an address's octets."""
    card = str(luhn(only_digits(span))) if 12 <= n <= 19 else ""
    groups = re.findall("[0-9]+", span) if n <= 12 else []
    return card, str(all(len(g) <= 3 and int(g) <= 255 for g in groups)) if len(groups) == 4 else ""


#: What a span is scored by: its shape, what its check digit and its octets say, and its neighbouring characters.
Span = tuple[str, str, str, str, str]


def features(span: Span) -> tuple[str, ...]:
    """Names of the features of a whole span."""
    shape, card, octets, left, right = span
    n = shape.count("9")
    signs = [m.group() for m in re.finditer(r"[^9a]+", shape.replace("at", "@").replace("dot", "."))]
    groups = ".".join(str(len(g)) for g in re.findall("9+", shape)) if "a" not in shape else "letters"
    out = ["any", f"left={left}", f"right={right}", f"n={n}", f"groups={groups}", f"signs={sorted(set(signs))}", f"first={shape[0]}", f"last={shape[-1]}", f"inner={len(set(signs)) <= 1}{len(signs)}"]
    out.append("shape=" + "".join(m.group() if m.group()[0] != "9" else "9" for m in _RUN.finditer(shape)))
    if card:
        out += [f"card={card}{n}", f"card={card}{groups}", f"card={card}{sorted(set(signs))}"]
    if octets:
        out += [f"octets={octets}", f"octets={octets}{sorted(set(signs))}"]
    if _is_address(shape):
        out += ["address", f"address={bool(re.fullmatch(r'[a9._%+-]+', re.split(_AT + '|@', shape)[0]))}{bool(_WRITTEN.fullmatch(shape) or re.fullmatch(r'[a9._%+-]+@[a9-]+([.][a9-]+)+', shape))}"]
    return tuple(out)


def _is_address(span: str) -> bool:
    return "@" in span or "at" in span


def described(text: str, a: int, b: int) -> Span:
    span = text[a:b]
    shape = span.translate(_NINES) if span.isascii() and not _LETTERS.search(span) else shape_of(span)
    return shape, *checks(span, shape.count("9")), _side(text[a - 1 : a] if a else ""), _side(text[b : b + 1])


def candidates(text: str, start: int, end: int) -> Iterator[tuple[int, tuple[int, int], list[tuple[int, int, int]]]]:
    """For each token of a region, in order: its number, its span and the candidate entities (first token, start, end) that end with it.

    No candidate is over MOST tokens or SPAN_CHARS characters; one without an @ has no letters."""
    window: deque[tuple[int, int, int, int, bool]] = deque(maxlen=MOST)  # token, start, digits and digit runs before it, may begin an entity
    digits = runs = 0
    barrier = -1  # the last token with letters
    for j, m in enumerate(_TOKEN.finditer(text, start, end)):
        a, b, c = m.start(), m.end(), m.group()[0]
        window.append((j, a, digits, runs, c.isalnum() or c in "+("))
        if "0" <= c <= "9":
            digits, runs = digits + b - a, runs + 1
        elif c.isalpha():
            barrier = j
        found = []
        if c.isalnum() or c == ")":
            for i, first, d, r, begins in reversed(window):
                if b - first > SPAN_CHARS:
                    break
                n, letters = digits - d, barrier >= i
                if n > MOST_DIGITS and not letters:
                    break
                if not begins:
                    continue
                if letters:
                    span = text[first:b]
                    if "@" not in span and not re.search(r"\bat\b", span):
                        continue
                    if span.count("@") > 1:
                        break
                    found.append((i, first, b))
                elif n >= 7 or n >= LEAST_DIGITS and runs - r >= 4:
                    found.append((i, first, b))
        yield j, (a, b), found


class Lattice:
    """A region's candidate entities: (first token, past last token, start, end, what it is scored by)."""

    def __init__(self, text: str, start: int, end: int):
        self.n, self.segments = 0, []
        for j, _, found in candidates(text, start, end):
            self.n = j + 1
            self.segments += [(i, j + 1, a, b, described(text, a, b)) for i, a, b in found]


OUT = len(KINDS)


class Field:
    """Weights by feature name and kind, and by the kinds of neighbouring segments (the last is a token outside)."""

    def __init__(self, weights: dict[str, list[float]] | None = None, moves: list[list[float]] | None = None):
        self.weights, self.moves = weights or {}, [[0.0] * (OUT + 1) for _ in range(OUT + 1)] if moves is None else moves
        self._known: dict[Span, list[float]] = {}

    def score(self, span: Span) -> list[float]:
        """A span's score for each kind."""
        if (found := self._known.get(span)) is None:
            rows = [w for f in features(span) if (w := self.weights.get(f)) is not None]
            found = [sum(r[k] for r in rows) for k in range(OUT)]
            if len(self._known) < KNOWN:
                self._known[span] = found
        return found

    def scores(self, lattice: Lattice) -> np.ndarray:
        return np.array([self.score(span) for *_, span in lattice.segments]).reshape(-1, OUT)

    def decode(self, text: str, start: int, end: int) -> list[tuple[int, int, int]]:
        """The entities of the best segmentation of a region, as (start, kind's index, end)."""
        moves, kinds = self.moves, range(OUT + 1)
        first = [-math.inf] * OUT + [0.0]  # as if a token outside came before

        def onward(best: list[float]) -> list[tuple[float, int]]:
            """The best way into each kind, and the kind that it comes from."""
            return [max((best[k] + moves[k][to], k) for k in kinds) for to in kinds]

        # of the last MOST tokens, the ways on from before them; of every token its place and, for each kind, where the segment that ends there begins and the kind before it
        ways: deque[list[tuple[float, int]]] = deque([onward(first)], maxlen=MOST + 1)
        starts, stops, froms, before, best = array("i"), array("i"), array("i"), bytearray(), first
        for j, (token_start, token_stop), found in candidates(text, start, end):
            best, begins, comes = [-math.inf] * OUT + [ways[-1][OUT][0]], [j] * (OUT + 1), [OUT] * OUT + [ways[-1][OUT][1]]
            for i, a, b in found:
                way = ways[i - j - 1]
                for kind, s in enumerate(self.score(described(text, a, b))):
                    if (v := way[kind][0] + s) > best[kind]:
                        best[kind], begins[kind], comes[kind] = v, i, way[kind][1]
            ways.append(onward(best))
            starts.append(token_start)
            stops.append(token_stop)
            froms.extend(begins)
            before.extend(comes)
        out, kind, n = [], max(kinds, key=lambda k: best[k]), len(starts)
        while n:
            at = (n - 1) * (OUT + 1) + kind
            if kind != OUT:
                out.append((starts[froms[at]], kind, stops[n - 1]))
            n, kind = froms[at], before[at]
        return out[::-1]

    def marginals(self, lattice: Lattice) -> tuple[np.ndarray, np.ndarray]:
        """Probability of each (candidate, kind), and expected number of each change of kind."""
        s, n, moves = self.scores(lattice), lattice.n, np.array(self.moves)
        fore, aft = np.full((n + 1, OUT + 1), -math.inf), np.full((n + 1, OUT + 1), -math.inf)
        fore[0, OUT], aft[n] = 0.0, 0.0
        into: dict[int, list[int]] = {}
        outof: dict[int, list[int]] = {}
        for k, seg in enumerate(lattice.segments):
            into.setdefault(seg[1], []).append(k)
            outof.setdefault(seg[0], []).append(k)
        way = np.empty((n, OUT + 1))  # sums of all that comes before a segment of a kind that begins here
        for j in range(1, n + 1):
            way[j - 1] = np.logaddexp.reduce(fore[j - 1][:, None] + moves, axis=0)
            fore[j, OUT] = way[j - 1, OUT]
            for k in into.get(j, ()):
                i = lattice.segments[k][0]
                fore[j, :OUT] = np.logaddexp(fore[j, :OUT], way[i, :OUT] + s[k])
        total = np.logaddexp.reduce(fore[n])
        ahead = np.empty((n, OUT + 1))  # sums of all that follows from here if a segment of a kind begins
        for i in range(n - 1, -1, -1):
            ahead[i] = -math.inf
            ahead[i, OUT] = aft[i + 1, OUT]
            for k in outof.get(i, ()):
                j = lattice.segments[k][1]
                ahead[i, :OUT] = np.logaddexp(ahead[i, :OUT], s[k] + aft[j, :OUT])
            aft[i] = np.logaddexp.reduce(moves + ahead[i][None, :], axis=1)
        each = np.array([np.exp(way[i, :OUT] + s[k] + aft[j, :OUT] - total) for k, (i, j, *_) in enumerate(lattice.segments)]).reshape(-1, OUT)
        changes = np.exp(fore[:n, :, None] + moves[None] + ahead[:, None, :] - total).sum(axis=0)
        return each, changes


def fit(samples: list[tuple[str, int, int, list[tuple[int, int, int]]]]) -> Field:
    """A field from (text, region start, end, gold entities); the order of samples matters, so callers sort them."""
    data = []
    for text, start, end, gold in samples:
        lattice = Lattice(text, start, end)
        at = {(a, b): (i, j, k) for k, (i, j, a, b, _) in enumerate(lattice.segments)}
        known = sorted((at[a, b][0], at[a, b][1], kind, at[a, b][2]) for a, kind, b in gold if (a, b) in at)
        truth, changes, now, before = np.zeros((len(lattice.segments), OUT)), np.zeros((OUT + 1, OUT + 1)), 0, OUT
        for i, j, kind, k in known:
            for to, times in ((OUT, i - now), (kind, 1)):
                if times:
                    changes[before, to] += 1
                    changes[to, to] += times - 1
                    before = to
            truth[k, kind], now = 1, j
        if lattice.n > now:
            changes[before, OUT] += 1
            changes[OUT, OUT] += lattice.n - now - 1
        if lattice.segments:
            data.append((lattice, truth, changes))
    named = {span: features(span) for lattice, *_ in data for *_, span in lattice.segments}
    names = sorted({f for fs in named.values() for f in fs})
    weights, squares = {f: np.zeros(OUT) for f in names}, {f: np.full(OUT, 1e-6) for f in names}
    moves, moved = np.zeros((OUT + 1, OUT + 1)), np.full((OUT + 1, OUT + 1), 1e-6)
    for _ in range(EPOCHS):
        for lattice, truth, changes in data:
            field = Field(weights, moves)
            each, expected = field.marginals(lattice)
            gap = truth - each
            step: dict[str, np.ndarray] = {}
            for row, (*_, span) in zip(gap, lattice.segments, strict=True):
                if np.abs(row).max() > 1e-4:
                    for f in named[span]:
                        step[f] = step.get(f, 0) + row
            for f, g in step.items():
                g = g - DECAY * weights[f]
                squares[f] += g * g
                weights[f] = weights[f] + RATE * g / np.sqrt(squares[f])
            g = changes - expected - DECAY * moves
            moved += g * g
            moves = moves + RATE * g / np.sqrt(moved)
    return Field({f: w.tolist() for f, w in weights.items()}, moves.tolist())


def planted(seed: int, count: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Made-up texts and their entities (start, kind's index, end): each kind written in ways that the patterns miss, and look-alikes."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9)))
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    octet = lambda: str(rng.randrange(256))

    def email() -> str:
        at, dot = rng.choice([" at ", "(at)", "[at]", " (at) ", " [at] ", " @ ", "@", "{at}"]), rng.choice([" dot ", "(dot)", "[dot]", " (dot) ", " [dot] ", "[.]", "."])
        if at == "@" and dot == ".":
            dot = "[dot]"
        if at == " at " and dot == ".":
            at = " (at) "
        return word() + rng.choice(["", ".", "_"]) + word() + rng.choice(["", digits(2)]) + at + word() + dot + rng.choice(["org", "com", "net", "example"])

    def ip() -> str:
        return rng.choice(["[.]", "(.)", " . ", "[.] ", " [.] "]).join(octet() for _ in range(4))

    def card(good: bool = True) -> str:
        while luhn(d := rng.choice("3456") + digits(15)) != good:
            pass
        return rng.choice([".", "/", "_", " - ", "  ", ". "]).join(d[k : k + 4] for k in range(0, 16, 4)) if good or rng.random() < 0.5 else d

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice([f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a}/{b}-{c}", f"00{rng.choice('1234')} {a} {b} {c}", f"+1/{a}/{b}/{c}", f"1-{a}-{b}-{c}"])

    def other() -> str:
        year = f"{rng.randrange(1900, 2100)}"
        return rng.choice([
            f"{year}-{rng.randrange(10, 13)}-{rng.randrange(10, 30)}", f"{rng.randrange(1, 13)}/{rng.randrange(1, 30)}/{year}", f"{year}-{rng.randrange(10, 13)}-{rng.randrange(10, 30)} {rng.randrange(10, 24)}:{rng.randrange(10, 60)}", f"{year} {rng.randrange(1900, 2100)} {rng.randrange(1900, 2100)}", f"{year}-{rng.randrange(1900, 2100)}",
            f"{rng.randrange(9)}.{rng.randrange(20)}.{rng.randrange(20)}", f"{rng.randrange(9)}.{rng.randrange(20)}.{rng.randrange(20)}.{rng.randrange(20)}.{rng.randrange(9)}", digits(rng.randrange(7, 12)), digits(20), digits(25), card(False), card(False),
            f"{octet()}[.]{rng.randrange(256, 999)}[.]{octet()}[.]{octet()}", " ".join(digits(rng.randrange(1, 4)) for _ in range(rng.randrange(4, 14))), ", ".join(digits(2) for _ in range(rng.randrange(3, 9))), f"{rng.randrange(1, 999)},{digits(3)},{digits(3)}.{digits(2)}",
            f"{digits(4)}-{digits(6)}-{digits(2)}", f"{word()} at {word()}", f"{word()} at {octet()} {word()}", f"@{word()}", f"{word()} @ {octet()}", f'"{digits(2)}{word()}{digits(4)}{word()}{digits(9)}"', f"{digits(3)}.{digits(4)}", f"{digits(2)} + {digits(2)} = {digits(3)}",
        ])

    makers = (email, ip, card, phone)
    out = []
    for _ in range(count):
        kind = rng.randrange(7)
        entity = makers[kind]() if kind < OUT else other()
        before, after = rng.choice([f"{word()} {word()} ", f"{word()}: ", f"{word()}, ", "", "- ", f"{word()} ("]), rng.choice([f" {word()} {word()}", ".", ", ", "", ")", f"; {word()}"])
        text, gold = before + entity + after, [(len(before), kind, len(before) + len(entity))] if kind < OUT else []
        if rng.random() < 0.2:  # a neighbour
            more = phone() if rng.random() < 0.5 else digits(rng.randrange(2, 7))
            text += f" {word()} " + more
            if "(" in more or "-" in more or "." in more or "/" in more or " " in more:
                gold.append((len(text) - len(more), 3, len(text)))
        out.append((text, gold))
    return out


def planted_samples(seed: int, count: int) -> list[tuple[str, int, int, list[tuple[int, int, int]]]]:
    made = []
    for text, gold in planted(seed, count):
        base = base_spans(text)
        gold = sorted(base + [g for g in gold if all(b <= g[0] or a >= g[2] for a, _, b in base)])
        made += [(text, a, b, [g for g in gold if g[0] >= a and g[2] <= b]) for a, b in regions(text)]
    return made


def gold_of(text: str, start: int, end: int) -> list[tuple[int, int, int]]:
    """Base spans in a region, without those that overlap an earlier one."""
    out, last = [], start
    for a, kind, b in base_spans(text):
        if a >= last and b <= end:
            out.append((a, kind, b))
            last = b
    return out


def train(docs: DataFrame, text: str = "text") -> Field:
    """A field fitted on planted texts and on regions of documents whose hash is low (about SAMPLE_DOCS of them)."""
    share = min(1.0, SAMPLE_DOCS / max(docs.count(), 1))
    picked = docs.where((F.pmod(F.xxhash64("doc_id", text), F.lit(1 << 30)) + 0.5) / float(1 << 30) < share).select("doc_id", text)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for a, b in regions(t or ""):
                    if b - a <= REGION_CHARS:
                        rows.append((doc_id, a, t[max(0, a - 1) : b + 1], a - max(0, a - 1), b - max(0, a - 1)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "at", "piece", "a", "b"])

    found = picked.mapInArrow(frugal(find), "doc_id bigint, at bigint, piece string, a bigint, b bigint")
    rows = found.orderBy(F.xxhash64("piece"), "doc_id", "at").limit(SAMPLE_REGIONS).collect()
    return fit([*planted_samples(1, PLANTED), *((r.piece, r.a, r.b, gold_of(r.piece, r.a, r.b)) for r in rows)])


def added_spans(text: str, base: list[tuple[int, int, int]], field: Field) -> list[tuple[int, int, int]]:
    """The field's entities between base spans."""
    if not field.weights:
        return []
    return [found for start, end in between(regions(text), base) if end - start >= LEAST_DIGITS for found in field.decode(text, start, end)]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[kind]}:{a}:{b}" for a, kind, b in spans])


def find_spans(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and added), n_spans (all)."""
    arrow_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    model = field or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.moves))
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, none = Field(*shared.value), (*[0] * len(KINDS), hashlib.sha256(b"").hexdigest(), "", 0)
        for batch in (part for whole in batches for part in by_bytes(whole)):
            rows = []
            for t in batch.column(1).to_pylist():
                if not t or not _ANY.search(t):
                    rows.append(none)
                    continue
                base = base_spans(t)
                every = sorted(base + added_spans(t, base, model))
                rows.append((*[sum(k == i for _, k, _ in base) for i in range(len(KINDS))], hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every)))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return docs.mapInArrow(frugal(run), "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_spans bigint")


def redact_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each span replaced by its kind in brackets; overlapping spans become one, named after the first."""
    parts, last = [], 0
    for a, kind, b in spans:
        if a >= last:
            parts += [text[last:a], f"[{KINDS[kind].upper()}]"]
        last = max(last, b)
    return "".join([*parts, text[last:]])


def redact(docs: DataFrame, field: Field | None = None, text: str = "text") -> DataFrame:
    """docs with personal data in the text replaced; null text stays null."""
    arrow_batches(docs.sparkSession)
    model = field or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.moves))
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Field(*shared.value)
        for batch in (part for whole in batches for part in by_bytes(whole)):
            out = []
            for t in batch.column(place).to_pylist():
                if t and _ANY.search(t):
                    base = base_spans(t)
                    t = redact_text(t, sorted(base + added_spans(t, base, model)))
                out.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if i == place else c for i, c in enumerate(batch.columns)], batch.schema.names)

    return docs.mapInArrow(frugal(run), docs.schema)
