"""Secret scans: fixed shapes, then a randomness test battery over unknown tokens.

Three shapes (assignments, access keys, hex runs) are always reported.  Any other
run of 20 or more token characters is a candidate, cut at each "=" but those at its
end, and, where no alphabet holds a piece, at "/" and "+" and again at "-" and "_".
Its encoding is inferred (the smallest alphabet holding all its characters), and
three tests are made of it: a chi-squared test of a uniform alphabet, a runs test of
capitals, small letters, digits and signs, and a test of the serial correlation of
vowels, which words alternate with other letters and drawn letters do not.

Each test is read two ways.  Against "drawn at random from the alphabet" it must not
reject.  Against "ordinary word, name or path of this length" its value has a mean
and a spread; the three deviations are added with weights that are what a random
token of that encoding and length is expected to deviate (Stouffer), which gives one
p-value of "ordinary".

These p-values are one family over the whole corpus: a first pass counts them by
length and size, a Benjamini-Hochberg procedure with weights by length (long tokens
carry more power) sets the limit at a share ``FALSE_DISCOVERY`` of false secrets, and
a second pass reports what is under it.  ``spans_of`` alone, without a limit, uses
``LONE``, the limit for a single text.

No shuffle but of the counts.  Null or empty text: no spans.  Very long texts are
scanned whole, in one walk.  Equal p-values share their fate.  Repeated rows: each is
scanned, and its tokens count each time.  Empty table: no rows.  Extra columns pass
through ``redact``, whatever their names, and are not read by ``scan``.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from statistics import NormalDist

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import batches, plain_names

# The three shapes, in the order their kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PIECE, CUTS = re.compile(r"[^=]{20,}"), (re.compile(r"[^+/]{20,}"), re.compile(r"[^_-]{20,}"))
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    ("hex", DIGITS + "abcdef"), ("hex_upper", DIGITS + "ABCDEF"), ("lower", LOWER), ("upper", UPPER),
    ("base32", UPPER + "234567"), ("base36", LOWER + DIGITS), ("base36_upper", UPPER + DIGITS),
    ("base62", UPPER + LOWER + DIGITS), ("base64", UPPER + LOWER + DIGITS + "+/"), ("base64url", UPPER + LOWER + DIGITS + "-_"),
)
# Rounded shares (per thousand) of the letters a to z in ordinary European text.
LETTERS = (80, 15, 30, 38, 130, 17, 17, 40, 72, 3, 7, 42, 26, 75, 68, 22, 6, 68, 70, 78, 34, 11, 12, 3, 14, 5)
# Fixed values, measured on identifiers, paths and joined words: shares of digits and of capitals among letters; changes of
# character kind per neighbour with mixed case or signs and without, and of vowel and other letter per two letters, each with the
# variance between tokens; what the spread of the chi-squared value is multiplied by.
ORDINARY_DIGITS, ORDINARY_CAPITALS = 0.08, 0.12
ORDINARY_KINDS, ORDINARY_KINDS_PLAIN, KINDS_SPREAD = 0.27, 0.12, 0.007
ORDINARY_TURNS, TURNS_SPREAD = 0.60, 0.004
CHI_SPREAD = 1.2
VOWELS = frozenset("aeiouyAEIOUY")
FALSE_DISCOVERY, LONE, REJECT_RANDOM = 0.05, 1e-3, 1e-4
#: Bins of -log10(p) by which the first pass counts, and the length from which tokens count alike.
BINS_PER_DECADE, MOST_BIN, LONGEST = 100, 3000, 256
_NORMAL = NormalDist()


def _ordinary(alphabet: str) -> list[float]:
    share = [1e-3] * len(alphabet)
    for i, c in enumerate(alphabet):
        if c in DIGITS:
            share[i] = ORDINARY_DIGITS / 10
        elif c.isalpha():
            both = c.lower() in alphabet and c.upper() in alphabet
            case = (ORDINARY_CAPITALS if c.isupper() else 1 - ORDINARY_CAPITALS) if both else 1
            share[i] = LETTERS[LOWER.index(c.lower())] / 1000 * case
    total = sum(share)
    return [x / total for x in share]


def _moments(alphabet: str) -> tuple[float, float, float]:
    """Per character growth, offset and per character variance of the chi-squared statistic for ordinary text."""
    u, q = 1 / len(alphabet), _ordinary(alphabet)
    drift = sum((x - u) ** 2 / u for x in q)
    offset = sum(x * (1 - x) / u for x in q)
    spread = 4 * (sum(x**3 / u**2 for x in q) - sum(x * x / u for x in q) ** 2)
    return drift, offset, spread


_TABLE = [(name, frozenset(chars), {c: i for i, c in enumerate(chars)}, _moments(chars)) for name, chars in ENCODINGS]


def encoding_of(token: str):
    """The smallest alphabet that holds every character; None for digits alone or a mix of all."""
    seen = set(token)
    if seen <= set(DIGITS):
        return None
    return min((e for e in _TABLE if seen <= e[1]), key=lambda e: len(e[1]), default=None)


def _upper_chi(x: float, k: int) -> float:
    """Upper tail of chi-squared by the cube-root normal approximation."""
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 1 - _NORMAL.cdf(z)


def battery(token: str) -> tuple[float, float] | None:
    """(p of random: the least of three tests times three, p of ordinary: the weighted sum of three), None if there is no encoding."""
    token = token.rstrip("=")
    found = encoding_of(token)
    n = len(token)
    if found is None or n < 2:
        return None
    _, chars, _, (drift, offset, spread) = found
    k = len(chars)
    tests = []  # deviation from ordinary, towards random; what random is expected to deviate
    chi = sum(v * v for v in Counter(token).values()) * k / n - n
    p_random = [_upper_chi(max(chi, 1e-9), k - 1)]
    usual, sd = n * drift + offset, CHI_SPREAD * math.sqrt(n * spread + 2 * (k - 1))
    tests.append(((usual - chi) / sd, (usual - (k - 1)) / sd))
    kinds = [0 if c in DIGITS else 1 if c.islower() else 2 if c.isupper() else 3 for c in token]
    lower, upper, digits = (sum(f(c) for c in chars) for f in (str.islower, str.isupper, str.isdigit))
    share = [x / k for x in (lower, upper, digits, k - lower - upper - digits)]
    change = 1 - sum(x * x for x in share)
    if change > 0 and len(set(kinds)) > 1:  # runs of character kinds
        rate = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / (n - 1)
        sd = math.sqrt(max(change * (1 - change), 0.05) / (n - 1))
        p_random.append(_NORMAL.cdf((rate - change) / sd))  # too few changes only: many are no sign of words
        usual = ORDINARY_KINDS if share[0] and share[1] or share[3] else ORDINARY_KINDS_PLAIN
        sd = math.sqrt(KINDS_SPREAD + usual * (1 - usual) / (4 * (n - 1)))
        tests.append(((rate - usual) / sd, (change - usual) / sd))
    turns = [(a in VOWELS) != (b in VOWELS) for a, b in zip(token, token[1:], strict=False) if a.isalpha() and b.isalpha()]
    letters = [c for c in chars if c.isalpha()]
    if len(turns) > 2:  # serial correlation of vowels
        rate, vowels = sum(turns) / len(turns), sum(c in VOWELS for c in letters) / len(letters)
        turn = 2 * vowels * (1 - vowels)
        p_random.append(2 * (1 - _NORMAL.cdf(abs(rate - turn) / math.sqrt(max(turn * (1 - turn), 0.05) * 1.5 / len(turns)))))
        sd = math.sqrt(TURNS_SPREAD + ORDINARY_TURNS * (1 - ORDINARY_TURNS) / len(turns))
        tests.append(((ORDINARY_TURNS - rate) / sd, (ORDINARY_TURNS - turn) / sd))
    weights = [max(w, 0.1) for _, w in tests]
    z = sum(w * x for w, (x, _) in zip(weights, tests, strict=True)) / math.sqrt(sum(w * w for w in weights))
    return min(1.0, min(p_random) * len(p_random)), _NORMAL.cdf(-z)


def pieces(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Spans to test of the candidate at a to b, sorted; two may overlap where no alphabet holds the whole."""
    end = a + len(text[a:b].rstrip("="))
    out = []
    for m in PIECE.finditer(text, a, end):
        if encoding_of(m[0]) or m[0].isdigit():
            out.append(m.span())
        else:
            out += sorted({x.span() for cut in CUTS for x in cut.finditer(text, *m.span()) if encoding_of(x[0])})
    if not out and end - a < 20:  # short but for what ends it
        out = [(a, end)]
    return [(x, b if y == end else y) for x, y in out]


def weight(n: int) -> float:
    """What a token of n characters counts in the false-discovery procedure, before all are scaled to a mean of one."""
    return math.log2(min(n, LONGEST))


@dataclass(frozen=True)
class Limit:
    """A token is a secret where its p-value, divided by its weight over the mean weight, is in this bin or beyond."""

    bin: int
    mean: float

    def holds(self, p: float, n: int) -> bool:
        return bin_of(p * self.mean / weight(n)) >= self.bin


def bin_of(p: float) -> int:
    return MOST_BIN if p <= 0 else min(MOST_BIN, max(0, math.floor(-math.log10(p) * BINS_PER_DECADE)))


def discoveries(found: list[tuple[int, float, int]], level: float = FALSE_DISCOVERY) -> Limit:
    """The limit of a weighted Benjamini-Hochberg procedure over (length, p, how many)."""
    total = sum(n for _, _, n in found)
    mean = sum(weight(size) * n for size, _, n in found) / total if total else 1.0
    counts: Counter = Counter()
    for size, p, n in found:
        counts[bin_of(p * mean / weight(size))] += n
    limit, seen = MOST_BIN + 1, 0
    for x in sorted(counts, reverse=True):
        seen += counts[x]
        if 10 ** (-x / BINS_PER_DECADE) <= level * seen / total:  # the largest p-value of the bin
            limit = x
    return Limit(limit, mean)


def tested(text: str, out: list[tuple[int, int, int, int]]) -> list[tuple[int, int, float]]:
    """(start, end, p of ordinary) of every candidate outside the spans of out that could be random."""
    tokens = [m.span() for m in CANDIDATE.finditer(text)]
    if not tokens:
        return []
    base = sorted((x[0], x[2]) for x in out)
    starts, reach = [s for s, _ in base], list(accumulate((e for _, e in base), max, initial=-1))
    tests = ((a, b, battery(text[a:b])) for c, d in tokens for a, b in pieces(text, c, d) if reach[bisect_left(starts, b)] <= a)
    return [(a, b, t[1] if t[0] > REJECT_RANDOM else 1.0) for a, b, t in tests if t]


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, place in KINDS, end, start of what to blank out) of the fixed shapes."""
    out = []
    lowered = text.lower()
    if any(k in lowered for k in KEYWORDS):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    return out + [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]


def spans_of(text: str, limit: Limit = Limit(bin_of(LONE), weight(32))) -> list[tuple[int, int, int, int]]:
    """(start, place in KINDS, end, start of what to blank out), sorted."""
    out = base_spans(text)
    last = -1
    for a, b, p in sorted(tested(text, out), key=lambda x: (x[0], -x[1])):
        if b > last and limit.holds(p, b - a):  # not inside one already listed
            out.append((a, 3, b, a))
            last = b
    return sorted(out)


def discovery_limit(docs: DataFrame, level: float = FALSE_DISCOVERY) -> Limit:
    """The limit for all candidates of docs; the driver gets their numbers by length and bin."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches(frames):
            for text in batch.column(0).to_pylist():
                if text:
                    found.update((min(b - a, LONGEST), bin_of(p)) for a, b, p in tested(text, base_spans(text)))
        yield pa.record_batch([*(pa.array([x[i] for x in found], pa.int32()) for i in (0, 1)), pa.array(list(found.values()), pa.int64())], names=["size", "bin", "n"])

    counts = docs.select("text").mapInArrow(run, "size int, bin int, n long").groupBy("size", "bin").agg(F.sum("n").alias("n")).collect()
    return discoveries([(r["size"], 10 ** (-r["bin"] / BINS_PER_DECADE) * (1 - 1e-9), r["n"]) for r in counts], level)


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in spans)


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"


def scan(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, spans by kind, a digest of the base spans, all spans as text."""
    limit = discovery_limit(docs)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            ids, rows = batch.column(0).to_pylist(), []
            for doc_id, text in zip(ids, batch.column(1).to_pylist(), strict=True):
                spans = spans_of(text or "", limit)
                n = Counter(k for _, k, _, _ in spans)
                digest = hashlib.sha256(_joined([x for x in spans if x[1] < 3]).encode()).hexdigest()
                rows.append((doc_id, n[0], n[1], n[2], n[3], digest, _joined(spans)))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def blanked(text: str, limit: Limit | None = None, mark: str = "[SECRET]") -> str:
    """The text with each secret replaced; of an assignment only the value, overlapping ones once."""
    out, at = [], 0
    for _, _, end, start in sorted(spans_of(text, limit) if limit else spans_of(text), key=lambda x: (x[3], -x[2])):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mark]
        at = end
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """docs with the secrets in ``text`` blanked out and ``n_chars`` following; rows and other columns stay."""
    names = docs.columns
    limit = discovery_limit(docs)
    at, count = names.index("text"), names.index("n_chars") if "n_chars" in names else None
    plain = plain_names(docs)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            texts = batch.column(at).to_pylist()
            clean = [t if t is None else blanked(t, limit) for t in texts]
            columns = list(batch.columns)
            columns[at] = pa.array(clean, batch.schema.field(at).type)
            if count is not None:
                old = columns[count].to_pylist()
                columns[count] = pa.array([o if a == b else len(b) for o, a, b in zip(old, texts, clean, strict=True)], batch.schema.field(count).type)
            yield pa.record_batch(columns, schema=batch.schema)

    return plain.mapInArrow(run, plain.schema).toDF(*names)
