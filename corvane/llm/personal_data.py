"""Personal data: fixed shapes, and a span classifier trained without labelled rows.

Four shapes (email, ip, card, phone) are always reported.  Other spans are
candidates of seven more kinds (``ADDED``), each judged by seven labelers: regular
expressions (strict shape), validity (check digits, calendars), a gazetteer, words
before it, words after it, personal data nearby, and the texture around it.  A
labeler votes for, against, or not at all; a candidate without a vote is none.

1. A first pass over all texts counts candidates by kind, votes and three further
   features; what comes to the driver has at most ``PATTERNS`` rows, however large
   the corpus is.
2. Expectation-maximisation over these counts estimates, per kind, how common true
   spans are and how reliable each labeler is among the votes it casts (no labels;
   ``PSEUDO`` imagined votes stand for what is believed beforehand).
3. A logistic classifier per kind over votes and features is fitted to the posteriors
   (Newton steps, a ridge of ``RIDGE`` towards the estimated reliabilities).
4. A second pass reports candidates of ``THRESHOLD`` or more that meet no fixed span;
   of those that meet each other the likelier stays (ties: first, then longer, then
   in the order of kinds).

No shuffle but of the counts.  Null or empty text: no spans.  Very long texts are
scanned whole; every scan is linear in the text.  Repeated rows: each is scanned and
counts each time.  Empty table: no rows.  Extra columns pass through ``redact``,
whatever their names, and are not read by ``scan``.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import batches, plain_names

# The four shapes (written so that each scan is linear; what they match is as listed), in the order of their kinds.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
DIGIT = re.compile("[0-9]")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
BASE = ("email", "ip", "card", "phone")
ADDED = ("name", "address", "spelt_email", "local_phone", "iban", "national_id", "birth_date")
KINDS = BASE + ADDED
LABELERS = ("shape", "valid", "gazetteer", "before", "after", "nearby", "texture")
FEATURES = ("line_start", "field", "second_word")
PATTERNS = len(ADDED) * 3 ** len(LABELERS) * 2 ** len(FEATURES)
#: Votes imagined for each labeler, and spans for each kind; what a vote is believed to be right by beforehand, and how common true spans are.
PSEUDO, BELIEF, COMMON = 20.0, (0.70, 0.85, 0.80, 0.80, 0.75, 0.65, 0.65), 0.3
RIDGE, THRESHOLD, STEPS = 4.0, 0.7, 200
#: Characters looked at before and after a candidate, and how near other personal data has to be.
AROUND, NEAR = 40, 120

# Gazetteers (common given names and surnames of four languages, words of streets, dates that are no births).
GIVEN = frozenset(
    "Adam Alice Ana Andrea Andreas Anna Anne Antoine Antonio Camille Carlos Carmen Charles Charlotte Christian Christine Claire Daniel David Diego "
    "Elena Elisabeth Emily Emma Eva Fernando Francisco François Friedrich George Hans Helen Henry Isabel Jack Jacques James Jan Jane Javier Jean Jennifer "
    "John José Juan Julia Julie Karl Katharina Klaus Laura Linda Lisa Louis Lucas Lucía Luis Manuel Margaret María Marie Martin Mary Michael Michel Miguel "
    "Nicolas Olivia Pablo Patricia Paul Pedro Peter Philippe Pierre Rachel Richard Robert Rosa Sarah Sebastian Sofía Sophie Stefan Stephen Susan Teresa "
    "Thomas Ursula Victoria William Wolfgang".split()
)
SURNAMES = frozenset(
    "Anderson Becker Bernard Brown Clark Davis Dubois Dupont Durand Evans Fernández Fischer García Gómez González Hernández Hoffmann Jackson Johnson Jones "
    "Klein Koch Lambert Laurent Lefebvre Leroy Lewis López Martínez Meyer Miller Moore Moreau Müller Pérez Petit Ramírez Richter Robinson Rodríguez Romero "
    "Ruiz Sánchez Schäfer Schmidt Schneider Schulz Simon Smith Taylor Thompson Torres Wagner Walker Weber White Williams Wilson Wolf Wright".split()
)
NO_NAMES = frozenset(
    "Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October November December "
    "Street Road Avenue City River Lake Mount Saint North South East West New University College Church Award Prize Day Island Company Inc Ltd".split()
)
TITLE = re.compile(r"(?:\b(?:Mr|Mrs|Ms|Dr|Prof|Herrn?|Frau|Monsieur|Madame|Mme|Señora?|Don|Doña)\.? )$")
WORDS_BEFORE = {
    "name": "name named dear from signed contact patient client customer sincerely regards nom nombre vorname nachname llamado llamada",
    "address": "address lives live living street resides adresse wohnt wohnhaft habite demeurant domicilio dirección vive",
    "spelt_email": "email e-mail mail contact write reach correo courriel",
    "local_phone": "phone telephone tel call mobile cell fax telefon handy téléphone portable teléfono móvil llame",
    "iban": "iban account konto compte cuenta bank transfer",
    "national_id": "ssn social security dni nie nif passport id sécurité",
    "birth_date": "born birth birthday dob geboren geburtsdatum geb né née naissance nacido nacida nacimiento",
}
WORDS_AFTER = {
    "name": "said wrote lives works born asked replied sagte wohnt dit habite dijo vive",
    "address": "apartment apt suite floor city town",
    "local_phone": "ext extension mobile home work",
    "iban": "bic swift",
    "birth_date": "in at à in en",
}
AGAINST_BEFORE = frozenset("order invoice version isbn issn part page figure section item serial ref reference number no doi code sku room chapter total price volume".split())
UNITS = frozenset("kg g km m cm mm mb gb kb ms s min hours days percent eur usd euro euros dollars times pages rows items".split())

_CAP = r"[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ'’]{1,24}+"
NAME = re.compile(rf"(?<![\w'’-]){_CAP}(?:[ -]{_CAP}){{0,2}}+(?![\w'’])")
STREETS = (
    re.compile(r"(?<![\w.])[0-9]{1,5}+[A-Za-z]?,? (?:[A-Z][\w'-]{0,24} ){1,3}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Boulevard|Blvd|Court|Square|Terrace)\b"),
    re.compile(r"(?<![\w.])[0-9]{1,4}+,? (?:bis |ter )?(?:rue|avenue|boulevard|place|chemin|impasse|allée|quai) (?:(?:de la|de|du|des|la|le) |de l'|l'|d')?[A-ZÀ-Þ][\w'-]{1,24}(?: [A-ZÀ-Þ][\w'-]{1,24}){0,2}"),
    re.compile(r"(?<!\w)(?:[Cc]alle|[Aa]venida|[Pp]laza|[Pp]aseo) (?:(?:de la|de los|de|del) )?[A-ZÀ-Þ][\w'-]{1,24}(?: [A-ZÀ-Þ][\w'-]{1,24}){0,2},? [0-9]{1,4}(?!\w)"),
    re.compile(r"(?<!\w)[A-ZÄÖÜ][a-zäöüß]{1,24}(?:straße|strasse|weg|platz|allee|gasse) [0-9]{1,4}[a-z]?(?!\w)"),
)
SPELT = re.compile(r"(?:[(\[{] ?(?:at|AT) ?[)\]}] ?|(?<= )at )[A-Za-z0-9-]{1,63}+(?:(?: ?[(\[{] ?(?:dot|DOT) ?[)\]}] ?| dot |\.)[A-Za-z0-9-]{2,24}+){1,4}+")
SPELT_LEFT = re.compile(r"[A-Za-z0-9][\w.%+-]{0,63} ?\Z")
LOCAL_PHONE = re.compile(r"(?<![\w+.,/-])(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[ .-])[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,4}+(?![\w/-]|[.,][0-9])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])")
NATIONAL = re.compile(r"(?<![\w-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{8}-?[A-Z])(?![\w-])")
DATE = re.compile(r"(?<![\w./-])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![\w/-]|\.[0-9])")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)?")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in LOCAL:
            begin -= 1
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            out.append((begin, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) < 256


def _count(s: str) -> int:
    return sum(c.isdigit() for c in s)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(place in KINDS, start, end) of the fixed shapes, sorted."""
    out = [(0, *x) for x in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    if "." in text:
        out += [(1, *m.span()) for m in IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= _count(m[0]) <= 15]
    return sorted(out)


def found(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of all that could be one of the added kinds."""
    for m in NAME.finditer(text):
        words = re.split("[ -]", m[0])
        if words[0] in GIVEN or words[-1] in SURNAMES or TITLE.search(text, max(0, m.start() - 12), m.start()) or len(words) > 1 and _near_word(text, m.start(), "name"):
            yield "name", m.start(), m.end()
    for m in SPELT.finditer(text):
        if left := SPELT_LEFT.search(text, max(0, m.start() - 66), m.start()):
            yield "spelt_email", left.start(), m.end()
    if not DIGIT.search(text):  # all others hold digits
        return
    for pattern in STREETS:
        for m in pattern.finditer(text):
            yield "address", m.start(), m.end()
    for kind, pattern in (("local_phone", LOCAL_PHONE), ("iban", IBAN), ("national_id", NATIONAL), ("birth_date", DATE)):
        for m in pattern.finditer(text):
            yield kind, m.start(), m.end()


_BEFORE = {k: frozenset(v.split()) for k, v in WORDS_BEFORE.items()}
_AFTER = {k: frozenset(v.split()) for k, v in WORDS_AFTER.items()}


def _words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def _near_word(text: str, start: int, kind: str) -> bool:
    return not _BEFORE[kind].isdisjoint(_words(text[max(0, start - AROUND) : start])[-3:])


def _shape(kind: str, s: str) -> int:
    if kind == "name":
        return 1 if len(re.split("[ -]", s)) == 2 else 0
    if kind == "spelt_email":
        return 1 if re.search(r"[(\[{]|\bdot\b", s, re.I) else -1
    if kind == "local_phone":
        return (1 if s[0] == "(" or s[0] == "0" or len(set(re.sub("[0-9]", "", s))) == 1 else 0) if 8 <= _count(s) <= 12 else -1
    if kind == "birth_date":
        return 0
    return 1


def _valid(kind: str, s: str) -> int:
    if kind == "iban":
        plain = s.replace(" ", "")
        moved = "".join(str(int(c, 36)) for c in plain[4:] + plain[:4])
        return 1 if int(moved) % 97 == 1 else -1
    if kind == "national_id":
        if "-" in s and s[-1].isdigit():
            return 1 if s[:3] not in ("000", "666") and s[0] != "9" and s[4:6] != "00" and s[7:] != "0000" else -1
        return 1 if "TRWAGMYFPDXBNJZSQVHLCKE"[int(s[:8]) % 23] == s[-1] else -1
    if kind == "birth_date":
        a, b, c = map(int, re.split("[./-]", s))
        year, x, y = (a, b, c) if a > 31 else (c, a, b)
        return 1 if 1900 <= year <= 2025 and min(x, y) >= 1 and min(x, y) <= 12 and max(x, y) <= 31 else -1
    if kind == "local_phone":
        return -1 if len(set(re.sub("[^0-9]", "", s))) < 3 else 0
    return 0


def _listed(kind: str, s: str) -> int:
    if kind != "name":
        return 1 if kind == "address" else 0
    words = re.split("[ -]", s)
    if any(w in NO_NAMES for w in words):
        return -1
    return 1 if words[0] in GIVEN or words[-1] in SURNAMES else 0


def judged(text: str, kind: str, a: int, b: int, base: list[tuple[int, int]]) -> int:
    """Votes and features of one candidate as one number (-1: no labeler votes); base: sorted (start, end) of fixed spans."""
    s, before, after = text[a:b], text[max(0, a - AROUND) : a], text[b : b + AROUND]
    left, right = _words(before)[-3:], _words(after)[:2]
    votes = [_shape(kind, s), _valid(kind, s), _listed(kind, s)]
    votes.append(1 if not _BEFORE[kind].isdisjoint(left) or kind == "name" and TITLE.search(before) else -1 if not AGAINST_BEFORE.isdisjoint(left[-2:]) else 0)
    votes.append(1 if not _AFTER.get(kind, frozenset()).isdisjoint(right[:1]) else -1 if right and right[0] in UNITS or after[:2].strip()[:1] in ("%", "€", "$") else 0)
    i = bisect_left(base, (a, a))
    votes.append(1 if i < len(base) and base[i][0] - b <= NEAR or i and a - base[i - 1][1] <= NEAR else 0)
    around = before + after
    if kind == "name":
        caps = [w for w in _WORD.findall(around) if len(w) > 3]
        votes.append(-1 if len(caps) > 3 and sum(w[0].isupper() for w in caps) > 0.7 * len(caps) else 0)
    else:
        votes.append(-1 if _count(around) > 0.35 * max(1, len(around)) else 0)
    if not any(votes):
        return -1
    code = 0
    for v in votes:
        code = code * 3 + v + 1
    extra = ((a == 0 or text[a - 1] == "\n"), before.rstrip()[-1:] in (":", "="), kind == "name" and s.split(" ")[-1] in SURNAMES)
    for x in extra:
        code = code * 2 + x
    return code


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(kind among ADDED, code, start, end) of every candidate that meets no fixed span and has a vote."""
    spans = sorted((s, e) for _, s, e in base)
    reach = []
    for _, e in spans:
        reach.append(max(e, reach[-1] if reach else 0))
    out = []
    for kind, a, b in found(text):
        i = bisect_left(spans, (b, 0))
        if i and reach[i - 1] > a:
            continue
        code = judged(text, kind, a, b, spans)
        if code >= 0:
            out.append((ADDED.index(kind), code, a, b))
    return out


def decoded(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Votes (row x labeler, -1 to 1) and features (row x feature) of codes."""
    codes = codes.copy()
    extra = np.empty((len(codes), len(FEATURES)), np.int64)
    for i in range(len(FEATURES) - 1, -1, -1):
        codes, extra[:, i] = codes // 2, codes % 2
    votes = np.empty((len(codes), len(LABELERS)), np.int64)
    for i in range(len(LABELERS) - 1, -1, -1):
        codes, votes[:, i] = codes // 3, codes % 3 - 1
    return votes, extra


def reliabilities(votes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """By expectation-maximisation: (labeler x truth) share of votes for among the votes cast, share of true spans, and posterior of each row."""
    yes, no = (votes == 1).astype(float), (votes == -1).astype(float)
    belief = np.array(BELIEF)
    share, common = np.stack([1 - belief, belief], 1), COMMON
    for _ in range(STEPS):
        odds = np.log(common) - np.log(1 - common) + yes @ np.log(share[:, 1] / share[:, 0]) + no @ np.log((1 - share[:, 1]) / (1 - share[:, 0]))
        posterior = 1 / (1 + np.exp(-odds))
        new = np.empty_like(share)
        for truth, mass in enumerate((counts * (1 - posterior), counts * posterior)):
            held = belief if truth else 1 - belief
            new[:, truth] = (mass @ yes + PSEUDO * held) / (mass @ (yes + no) + PSEUDO)
        common_new = (counts @ posterior + PSEUDO * COMMON) / (counts.sum() + PSEUDO)
        moved = max(np.abs(new - share).max(), abs(common_new - common))
        share, common = new, float(common_new)
        if moved < 1e-9:
            break
    return share, common, posterior


def design(votes: np.ndarray, extra: np.ndarray) -> np.ndarray:
    """What the classifier sees: one, votes for, votes against, features."""
    return np.concatenate([np.ones((len(votes), 1)), votes == 1, votes == -1, extra], 1).astype(float)


def fit(votes: np.ndarray, extra: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Weights of the classifier of one kind, fitted to the posteriors with a ridge towards what the reliabilities say."""
    share, common, posterior = reliabilities(votes, counts)
    start = np.concatenate([[np.log(common / (1 - common))], np.log(share[:, 1] / share[:, 0]), np.log((1 - share[:, 1]) / (1 - share[:, 0])), np.zeros(extra.shape[1])])
    x, w = design(votes, extra), start.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (counts * (p - posterior)) + RIDGE * (w - start)
        curve = (x * (counts * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(rows: list[tuple[int, int, int]]) -> np.ndarray:
    """Weights (kind x term) from (kind, code, count)."""
    data = np.array(sorted(rows), np.int64).reshape(-1, 3)
    out = []
    for kind in range(len(ADDED)):
        own = data[data[:, 0] == kind]
        votes, extra = decoded(own[:, 1])
        out.append(fit(votes, extra, own[:, 2].astype(float)))
    return np.array(out)


def train(docs: DataFrame) -> np.ndarray:
    """The classifier for the candidates of all docs."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches(frames):
            for text in batch.column(0).to_pylist():
                if text:
                    counts.update((k, code) for k, code, _, _ in candidates(text, base_spans(text)))
        yield pa.record_batch([*(pa.array([x[i] for x in counts], pa.int32()) for i in (0, 1)), pa.array(list(counts.values()), pa.int64())], names=["kind", "code", "n"])

    rows = docs.select("text").mapInArrow(run, "kind int, code int, n long").groupBy("kind", "code").agg(F.sum("n").alias("n"))
    return learn([tuple(r) for r in rows.collect()])  # at most PATTERNS rows


def probability(weights: np.ndarray, kind: int, code: int) -> float:
    x = design(*decoded(np.array([code])))[0]
    return float(1 / (1 + np.exp(-np.clip(x @ weights[kind], -30, 30))))


def spans_of(text: str, weights: np.ndarray, known: dict | None = None) -> list[tuple[int, int, int]]:
    """(place in KINDS, start, end) of all spans, sorted; known keeps probabilities of codes already seen."""
    base = base_spans(text)
    known = {} if known is None else known
    likely = []
    for kind, code, a, b in candidates(text, base):
        if (kind, code) not in known:
            known[kind, code] = probability(weights, kind, code)
        if (p := known[kind, code]) >= THRESHOLD:
            likely.append((-p, a, -b, kind))
    taken: list[tuple[int, int]] = []
    out = list(base)
    for _, a, b, kind in sorted(likely):
        i = bisect_left(taken, (a, 0))
        if (i == len(taken) or taken[i][0] >= -b) and (i == 0 or taken[i - 1][1] <= a):
            taken.insert(i, (a, -b))
            out.append((len(BASE) + kind, a, -b))
    return sorted(out)


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def scan(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, fixed spans by kind, their digest, all spans as text, number of added spans."""
    weights = train(docs)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches(frames):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                spans = spans_of(text or "", weights, known)
                n = Counter(k for k, _, _ in spans)
                fixed = [x for x in spans if x[0] < len(BASE)]
                rows.append((doc_id, n[0], n[1], n[2], n[3], hashlib.sha256(_joined(fixed).encode()).hexdigest(), _joined(spans), len(spans) - len(fixed)))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def masked(text: str, weights: np.ndarray, known: dict | None = None) -> str:
    """The text with every span replaced by its kind in brackets; spans that meet become one, named by the first."""
    out, at = [], 0
    for k, a, b in sorted(spans_of(text, weights, known), key=lambda x: (x[1], -x[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """docs with personal data in ``text`` masked; rows and other columns stay."""
    names, at = docs.columns, docs.columns.index("text")
    weights = train(docs)
    plain = plain_names(docs)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches(frames):
            columns = list(batch.columns)
            columns[at] = pa.array([t if t is None else masked(t, weights, known) for t in columns[at].to_pylist()], batch.schema.field(at).type)
            yield pa.record_batch(columns, schema=batch.schema)

    return plain.mapInArrow(run, plain.schema).toDF(*names)
