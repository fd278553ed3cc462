"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are lower-cased and every run of other characters than
letters and digits becomes one space.  An item of m characters may be found with
up to ``k = floor(m * max_error)`` edits.  It is cut into k + 1 pieces; k edits
leave one of them whole, so every match holds an exact piece.  One automaton over
all pieces finds the piece hits; the window around each hit is verified with
Myers' bit-parallel distance, which gives the least number of edits that turn the
item into some part of the text.  The space before and after an item belongs to it,
so an item is found as whole words; what stands in place of such a space is an edit.

Null or empty texts match nothing; items without a letter or digit are left out;
equal items are each reported; repeated rows of documents each report; of several
places with equally few edits one number is given.  Very long texts are read whole,
in one walk of the automaton.  No items: no rows, and every document stays; no
documents: no rows.  Extra columns are not read by ``leaks`` and pass through
``decontaminate``, whatever their names.

The items come in blocks of about ``BLOCK_CHARS`` characters; a test set larger than
that takes several passes over the texts, each with one block in the driver and the
tasks, which build the automaton once a worker.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import batches, materialise, plain_names

MAX_ERROR = 0.05
#: Characters of test items held by a task at once.
BLOCK_CHARS = 8_000_000
_OTHER = re.compile(r"[\W_]+")


def normalised(text: str | None) -> str:
    return _OTHER.sub(" ", (text or "").lower()).strip()


def budget(length: int, max_error: float = MAX_ERROR) -> int:
    return int(length * max_error + 1e-9)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of about equal length that make up the item: (offset, piece)."""
    n = min(k + 1, len(item))
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers(item: str, text: str, most: int) -> tuple[int, int] | None:
    """(least edits, end in text) of the item in any part of text, None if over ``most``."""
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        peq[c] |= 1 << i
    pv, mv, score, best = full, 0, m, (most + 1, -1)
    get = peq.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
        if score < best[0]:
            best = (score, j + 1)
            if not score:
                break
    return best if best[0] <= most else None


class Matcher:
    """Piece automaton over (item_id, normalised text) pairs."""

    def __init__(self, items: list[tuple[int, str]], max_error: float = MAX_ERROR):
        import ahocorasick

        self.items = [(i, f" {t} ", budget(len(t), max_error)) for i, t in items if t]
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for x, (_, text, k) in enumerate(self.items):
            for offset, piece in pieces(text, k):
                places[piece].append((x, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, at in places.items():
            self.automaton.add_word(piece, (len(piece), at))
        if places:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int]]:
        """(item_id, least edits) of every item within its budget."""
        if not self.items or not text:
            return []
        text = f" {text} "
        windows: dict[int, list[list[int]]] = defaultdict(list)
        for end, (size, at) in self.automaton.iter(text):
            for x, offset in at:
                _, item, k = self.items[x]
                start = end + 1 - size - offset
                a, b = max(0, start - k), start + len(item) + k
                if windows[x] and a <= windows[x][-1][1]:
                    windows[x][-1][1] = max(b, windows[x][-1][1])
                    windows[x][-1][0] = min(a, windows[x][-1][0])
                else:
                    windows[x].append([a, b])
        out = []
        for x, spans in windows.items():
            item_id, item, k = self.items[x]
            least = None
            for a, b in spans:
                hit = (0, 0) if item in text[a:b] else myers(item, text[a:b], k)
                if hit and (least is None or hit[0] < least):
                    least = hit[0]
            if least is not None:
                out.append((item_id, least))
        return out


#: The automaton of the block a worker is at; tasks of one pass share it.
_LAST: dict[str, Matcher] = {}


class Block:
    """One block of items, sent to the tasks."""

    def __init__(self, benchmark: DataFrame, part: int, parts: int, max_error: float):
        rows = benchmark.select("item_id", "text").where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        self.held = benchmark.sparkSession.sparkContext.broadcast([(r.item_id, normalised(r.text)) for r in rows.collect()])
        self.name, self.max_error = uuid.uuid4().hex, max_error

    def matcher(self) -> Matcher:
        if self.name not in _LAST:
            _LAST.clear()
            _LAST[self.name] = Matcher(self.held.value, self.max_error)
        return _LAST[self.name]


def n_blocks(benchmark: DataFrame) -> int:
    return (benchmark.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS + 1


def leaks(docs: DataFrame, benchmark: DataFrame, max_error: float = MAX_ERROR) -> DataFrame:
    """doc_id, item_id, edits: every item found in a text within its budget, the least edits of each."""
    kinds = (pa.int64(), pa.int64(), pa.int32())

    def find(part: int) -> DataFrame:
        block = Block(benchmark, part, n, max_error)

        def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = block.matcher()
            for batch in batches(frames):
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                rows = [(d, i, e) for d, t in zip(ids, texts, strict=True) for i, e in matcher.find(normalised(t))]
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "edits"])

        found = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, edits int")
        return found if n == 1 else _done(found, block)

    n = n_blocks(benchmark)
    return reduce(DataFrame.unionByName, map(find, range(n)))


def _done(rows: DataFrame, block: Block) -> DataFrame:
    """rows, written, so that the block is needed no more."""
    out = materialise(rows, "leaks")
    block.held.destroy()
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_error: float = MAX_ERROR) -> DataFrame:
    """The rows of docs whose text holds no test item within its budget; columns stay."""
    names, at, n = docs.columns, docs.columns.index("text"), n_blocks(benchmark)
    docs = plain_names(docs)
    for part in range(n):
        block = Block(benchmark, part, n, max_error)

        def run(frames: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = block.matcher()
            for batch in batches(frames):
                keep = [not matcher.find(normalised(t)) for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        docs = docs if n == 1 else _done(docs, block)
    return docs.toDF(*names)
