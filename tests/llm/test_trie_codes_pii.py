"""Prefix trie, vector codes and personal data against plain versions, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import personal_data, prefix_trie, vector_codes
from corvane.llm.common import table

CONVERSATION = "conv_id long, turn long, role string, text string"


def plain_trie(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns.setdefault(c, []).append((turn is not None, turn or 0, mark, role, text))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(turns.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:])
    members = {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
    below = {k: [p for p in members if p[: len(k)] == k] for k in members}
    kids = {k: [p for p in below[k] if len(p) == len(k) + 1] for k in members}
    own = {k: (len(m) - 1) * len(k[-1][1].encode()) if k else 0 for k, m in members.items()}
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if built[c] == k))
        parent = min(members[k[:-1]]) if k else None
        out.append((min(m), len(k), parent, len(m), len(kids[k]), sum(not kids[p] for p in below[k]), sum(own[p] for p in below[k]), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def trie_rows(df):
    return sorted((tuple(r) for r in prefix_trie.trie(df).collect()), key=lambda r: (r[1], r[0]))


def talk(seed=5):
    draw, rows = random.Random(seed), []
    for c in range(-12, 60):
        if c % 5 == 0 and draw.random() < 0.3:
            continue  # a family without its first conversation
        for t in range(draw.choice([1, 1, 2, 3, 5, 11])):
            rows.append((c, t, draw.choice(["user", "assistant"]), draw.choice(["a", "bé", "", "cc"])))
    for c in range(100, 160):  # copies of one conversation, all alike from the first turn
        rows += [(c, t, "user", f"same {t}") for t in range(12)]
    rows += [(60, None, "user", "before all"), (60, None, None, "before all"), (60, 0, None, None), (60, 0, None, None), (None, 0, "user", "nobody's")]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("hot", [1000, 3])
def test_trie(spark, monkeypatch, hot):
    monkeypatch.setattr(prefix_trie, "HOT", hot)
    monkeypatch.setattr(prefix_trie, "PIECE", 64)
    rows = talk()
    df = spark.createDataFrame(rows, CONVERSATION).withColumn("node", F.lit(1)).withColumn("a.b", F.lit(1)).repartition(7)
    assert trie_rows(df) == plain_trie(rows)


def test_long_conversation_over_ranges(spark):
    """A conversation with nearly all rows is numbered over several ranges."""
    rows = [(7, t, "user", f"t{t}") for t in range(4000)] + [(5, 0, "user", "x"), (5, 1, "user", "y"), (6, 0, "user", "z")]
    df = spark.createDataFrame(rows, CONVERSATION)
    turns = prefix_trie.numbered(df).where("conv_id = 7").orderBy("idx").collect()
    assert [r.idx for r in turns] == list(range(4000))
    assert [r["sum"] for r in turns] == np.cumsum([len(f"t{t}") for t in range(4000)]).tolist()
    nodes = trie_rows(df)
    assert len(nodes) == len({(r[0], r[1]) for r in nodes}) and max(r[1] for r in nodes) >= 3990


def test_trie_edges(spark):
    empty = spark.createDataFrame([], CONVERSATION)
    assert prefix_trie.trie(empty).collect() == [] and prefix_trie.trie(empty).columns[0] == "conv_id"
    assert trie_rows(spark.createDataFrame([(None, 1, "user", "x")], CONVERSATION)) == []
    one = [(3, 0, "user", "x" * 300_000)]  # its first conversation is absent
    assert trie_rows(spark.createDataFrame(one, CONVERSATION)) == plain_trie(one)
    twins = [(c, t, "user", "same") for c in (10, 15, 20) for t in range(3)]
    assert trie_rows(spark.createDataFrame(twins, CONVERSATION)) == plain_trie(twins)


VECTOR = "vec_id long, embedding array<float>, label int"


def plain_codes(rows, rounds=6):
    kept = [(i, [math.floor(float(np.float32(x)) * 4096) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) and abs(x) <= vector_codes.MOST for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = next((len(v) for _, v, _ in kept if len(v) % 8 == 0), 0)
    kept = [r for r in kept if len(r[1]) == dim]
    w = dim // 8
    cut = lambda v: [v[p * w : (p + 1) * w] for p in range(8)]
    books = [[cut(v)[p] for _, v, _ in kept[:16]] for p in range(8)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, x: min((gap(x, c), k) for k, c in enumerate(books[p]))
    for _ in range(rounds):
        groups = {}
        for _, v, _ in kept:
            for p, x in enumerate(cut(v)):
                groups.setdefault((p, near(p, x)[1]), []).append(x)
        for (p, k), xs in groups.items():
            books[p][k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    out, sums = [], {}
    for i, v, lab in kept:
        found = [near(p, x) for p, x in enumerate(cut(v))]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), lab))
        sums[lab] = sums.get(lab, 0) + out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for p in books for c in p for x in c).encode()).hexdigest()
    return sorted(((i, code, e, sums[lab], sha) for i, code, e, lab in out), key=str)


@pytest.mark.parametrize("most", [100_000, 0])
def test_codes(spark, monkeypatch, most):
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", most)
    monkeypatch.setattr(vector_codes, "BLOCK", 40)
    draw = np.random.default_rng(3)
    rows = [(int(i), draw.normal(0, 3, 16).astype(np.float32).tolist(), None if i % 7 == 0 else int(i) % 3) for i in draw.permutation(400)]
    rows += [(900 + i, [0.5] * 16, 1) for i in range(200)]  # a group of copies
    rows += [(1000, None, 1), (1001, [None] + [0.0] * 15, 1), (1002, [float("nan")] * 16, 1), (1003, [float("inf")] + [0.0] * 15, None), (1004, [1e9] * 16, 0)]
    rows += [(-5, [], 1), (-4, [1.0] * 5, 1), (None, [0.25] * 16, None), (3, [-0.1] * 16, 2), (3, [-0.1] * 16, 2), (1005, [2.0] * 24, 1)]
    df = spark.createDataFrame(rows, VECTOR).withColumn("values", F.lit("x")).repartition(5)
    got = sorted((tuple(r) for r in vector_codes.compress(df).collect()), key=str)
    assert got == plain_codes(rows)


def test_codes_edges(spark):
    empty = spark.createDataFrame([], VECTOR)
    assert vector_codes.compress(empty).collect() == []
    few = [(2, [1.0] * 8, 1), (1, [0.5] * 8, 1), (1, [0.25] * 8, None)]
    got = sorted((tuple(r) for r in vector_codes.compress(spark.createDataFrame(few, VECTOR)).collect()), key=str)
    assert got == plain_codes(few)
    assert vector_codes.compress(spark.createDataFrame([(1, [1.0] * 5, 1)], VECTOR)).collect() == []


SHAPES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(d := re.sub("[ -]", "", s)) <= 19 and (sum(map(int, d[-1::-2])) + sum(sum(divmod(2 * int(x), 10)) for x in d[-2::-2])) % 10 == 0),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
]


def plain_spans(text):
    return [(i, m.start(), m.end()) for i, (_, p, holds) in enumerate(SHAPES) for m in re.finditer(p, text) if holds(m[0])]


def test_fixed_shapes():
    draw = random.Random(1)
    pieces = ["a@b.c", "@", ".", "x.y@d-e.f.g", "1.2.3.4", "300.1.1.1", "+1 (555) 010-2030", "+", " ", "-", "4539 1488 0343 6467", "4539148803436467", "0", "12", "é", "a", "٣", "\n", "%", "001.002.003.004.005"]
    for _ in range(4000):
        text = "".join(draw.choice(pieces) for _ in range(draw.randint(1, 9)))
        assert personal_data.base_spans(text) == plain_spans(text), text


def test_personal_data_of_documents(spark, sf):
    texts = {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}
    for r in personal_data.scan(table(spark, sf, "documents")).collect():
        fixed = [(i, a, b) for i, a, b in plain_spans(texts[r.doc_id])]
        joined = ",".join(f"{SHAPES[i][0]}:{a}:{b}" for i, a, b in fixed)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[0] == i for x in fixed) for i in range(4))
        assert r.spans.startswith(joined) and r.spans.count(":") == 2 * (len(fixed) + r.n_added)


TRUE = [
    ("name", "Please ask for {} when you arrive; contact {} today", ["Maria Schmidt", "John Miller", "Pierre Dubois", "Carmen Torres", "Anna Becker"]),
    ("name", "It was Dr. {} who wrote the letter", ["Thomas Weber", "Laura Petit"]),
    ("address", "She lives at {} near the park", ["12 Green Hill Road", "7 rue de la Paix", "Bergstraße 14", "221 Baker Street"]),
    ("spelt_email", "write to {} for more", ["jane.doe (at) example (dot) com", "info [at] mail.example"]),
    ("local_phone", "call us, phone {} before noon", ["(555) 123-4567", "030 123 45 678", "01 23 45 67 89"]),
    ("iban", "transfer to account {} please", ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]),
    ("national_id", "her social security ssn {} was lost", ["123-45-6789", "12345678Z"]),
    ("birth_date", "he was born {} and grew up", ["03/04/1985", "1990-12-24"]),
]
FALSE = ["The Big Green House stood there", "order no 123-45 and 10 20 30 40 kg", "version 12.03.1999 of the part", "New York City and Lake Superior", "isbn DE00 0000 0000 0000 0000 00", "we met at noon.today or so", "Invoice 2020-01-02 was paid", "item 000-00-0000 of the list", "Chapter Seven Begins Here"]


def _corpus():
    draw, rows = random.Random(2), []
    for _ in range(400):
        kind, frame, values = draw.choice(TRUE)
        value = draw.choice(values)
        rows.append((kind, value, frame.replace("{}", value)))
        rows.append((None, None, draw.choice(FALSE)))
    return rows


def test_added_spans(spark):
    rows = _corpus()
    df = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(rows)], "doc_id long, text string")
    out = {r.doc_id: r.spans for r in personal_data.scan(df).collect()}
    held = missed = false = 0
    for i, (kind, value, text) in enumerate(rows):
        spans = {(k, text[int(a) : int(b)]) for k, a, b in (x.split(":") for x in out[i].split(",") if x)}
        if kind:
            held += (kind, value) in spans
            missed += (kind, value) not in spans
        else:
            false += len(spans)
    assert missed <= 0.05 * held and false <= 0.02 * held, (held, missed, false)


def test_reliabilities_are_recovered():
    """Votes drawn from known reliabilities: the estimates come near them, also for a labeler worse than believed."""
    draw = np.random.default_rng(0)
    n, right, cast = 60_000, np.array([0.9, 0.95, 0.6, 0.8, 0.75, 0.55, 0.7]), np.array([0.9, 0.5, 0.8, 0.6, 0.4, 0.5, 0.5])
    truth = draw.random(n) < 0.4
    votes = np.where(draw.random((n, 7)) < right, 1, -1) * np.where(truth, 1, -1)[:, None] * (draw.random((n, 7)) < cast)
    patterns, where, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    share, common, posterior = personal_data.reliabilities(patterns, counts.astype(float))
    assert np.abs(share[:, 1] - right).max() < 0.03 and np.abs(1 - share[:, 0] - right).max() < 0.03 and abs(common - 0.4) < 0.03
    best = 1 / (1 + np.exp(-(np.log(0.4 / 0.6) + patterns @ np.log(right / (1 - right)))))
    assert np.abs(posterior - best).max() < 0.1
    weights = personal_data.fit(patterns, np.zeros((len(patterns), 3), int), counts.astype(float))
    p = 1 / (1 + np.exp(-personal_data.design(patterns, np.zeros((len(patterns), 3), int)) @ weights))
    assert ((p[where.ravel()] > 0.5) == truth).mean() > 0.9 and np.abs(p - posterior).max() < 0.1


def test_likelihood_never_falls():
    """Expectation-maximisation: more steps never lower the posterior density (here: of the votes and the imagined ones)."""
    draw = np.random.default_rng(1)
    votes, counts = draw.integers(-1, 2, (50, 7)), draw.integers(1, 50, 50).astype(float)

    def density(share, common):
        yes, no = votes == 1, votes == -1
        parts = [w * np.exp(yes @ np.log(share[:, t]) + no @ np.log(1 - share[:, t])) for t, w in ((0, 1 - common), (1, common))]
        belief = np.array(personal_data.BELIEF)
        prior = sum(personal_data.PSEUDO * (h * np.log(share[:, t]) + (1 - h) * np.log(1 - share[:, t])).sum() for t, h in ((0, 1 - belief), (1, belief)))
        return (counts * np.log(sum(parts))).sum() + prior + personal_data.PSEUDO * (personal_data.COMMON * np.log(common) + (1 - personal_data.COMMON) * np.log(1 - common))

    seen = []
    for steps in (1, 2, 5, 20, 200):
        personal_data.STEPS, old = steps, personal_data.STEPS
        share, common, _ = personal_data.reliabilities(votes, counts)
        personal_data.STEPS = old
        seen.append(density(share, common))
    assert all(b >= a - 1e-6 for a, b in zip(seen, seen[1:], strict=False)), seen


def test_redact_and_edges(spark):
    rows = [(1, "mail a@b.example or +1 (555) 010-2030", 1), (1, None, 2), (None, "", 3), (4, "x" * 500_000 + "@" + "1" * 500_000, 4), (5, "1." * 200_000, 5), (6, "Aa " * 100_000, 6), (7, "+(" * 100_000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long").select("*", F.lit("x").alias("a.b"), F.lit("y").alias("spans"), F.lit("z").alias("`q`"))
    out = personal_data.redact(df)
    assert out.columns == df.columns
    assert [r.text for r in out.collect() if r.n == 1] == ["mail [EMAIL] or [PHONE]"] and out.count() == len(rows)
    assert len(personal_data.scan(df).collect()) == len(rows)
    assert personal_data.scan(df.limit(0)).collect() == []
