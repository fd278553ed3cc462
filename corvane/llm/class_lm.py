"""LM scoring with Brown class-based bigrams.

Tokens are the words of a text with A-Z lowered, then one end token.  Counts are
gathered over all training texts.  Words are assigned to ``CLASSES`` classes:

1. Words with at least ``CLUSTER_SHARE`` of all tokens (at most 1 / CLUSTER_SHARE)
   by exchange: from the bigram counts each round gives every word the class that
   gains most mutual information, until few move; a round that loses is undone.
2. Every other word with at least ``LEAST`` tokens, however many there are, by the
   class that makes what stands before and after it likeliest.  Words looked up in
   the task choose first, from neighbours of step 1, and once more from neighbours
   of either step; then all others choose, from the classes of all these, by counts
   gathered by shuffle, and their classes stay in a table joined by shuffle.
3. Words seen less often, and unseen ones, share one more class; the end of a text
   has its own.

A word has one class, as predicted word and as history.  The score of a text is

    sum of log10 P(class | class before) + log10 P(word | class)

where an end token stands before a text.  P(class | class before) is interpolated
with P(class); word emissions come from counts (in the class of rare words with
added mass for unseen words).

Words with at least ``LOCAL_SHARE`` of all tokens (at most 1 / LOCAL_SHARE) are
looked up in the task; all others are sent to their counts by a shuffle on the
word, which also holds for a vocabulary of any size.

Null or empty text: the end token alone.  A very long text is scored whole.  No
training text: all counts are 0, one rare class.  Equal counts: words by their
bytes.  Equal gains: the first class.  Repeated rows: each is scored and each
counts in training.  Empty table: no rows.  Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import batches, id_bucket, materialise

CLASSES, ROUNDS = 32, 4
CLUSTER_SHARE, LOCAL_SHARE = 2e-5, 2e-6
#: Tokens a word must have for a class of its own choice, and how often the words looked up in the task choose.
LEAST, CHOICES = 3, 2
ADD, WEIGHT = 0.1, 50.0
#: Bytes of text that a task looks at together.
SLICE = 8 << 20


def tokens(text: str | None) -> list[bytes]:
    """Words of a text; bytes, so that only A-Z are lowered and only ASCII white space splits."""
    return (text or "").encode().lower().split()


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The tokens of many texts at once: all words (binary), and how many each text has."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = parts.flatten().cast(pa.binary())
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
    ends = np.concatenate(([0], np.cumsum(full)))[parts.offsets.to_numpy()]
    return words.filter(pa.array(full)), np.diff(ends)


def in_order(number: dict[bytes, int]) -> pa.Array:
    """Words by their numbers, which follow one another."""
    return pa.array(sorted(number, key=number.get), pa.binary())


def numbered(texts: pa.Array, known: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All words of some texts, their places in ``known`` from 1 on (0: not there), and how many words each text has."""
    words, sizes = words_in(texts)
    return words, pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1, sizes


def in_line(x: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all texts with ``end`` before and after each text, and the places of the numbers among them."""
    line = np.full(len(x) + len(sizes) + 1, end, np.int64)
    place = np.arange(len(x)) + np.repeat(np.arange(1, len(sizes) + 1), sizes)
    line[place] = x
    return line, place


def summed(parts: Iterator[tuple[np.ndarray, np.ndarray]], most: int = 3_000_000) -> Iterator[pa.RecordBatch]:
    """Keys and their counts added up, in one piece unless there are many keys."""

    def total() -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)

    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size > most:
            held = [total()]
            size = len(held[0][0])
            if size > most // 2:
                yield pa.record_batch([pa.array(x) for x in held.pop()], names=["key", "n"])
                size = 0
    if size:
        yield pa.record_batch([pa.array(x) for x in total()], names=["key", "n"])


def word_counts(train: DataFrame) -> DataFrame:
    """word (binary), n over all texts."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held):
            return pa.RecordBatch.from_arrays(pc.value_counts(pa.chunked_array(held)).flatten(), names=["word", "n"])

        held, size = [], 0
        for batch in batches(frames, SLICE):
            held.append(words_in(batch.column(0))[0])
            size += held[-1].nbytes
            if size > 8 * SLICE:
                yield out(held)
                held, size = [], 0
        if held:
            yield out(held)

    return train.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def pair_counts(train: DataFrame, ids: dict[bytes, int], rare: int, end: int) -> DataFrame:
    """a, b, n: neighbouring tokens by number; a text begins after an end token."""
    held = train.sparkSession.sparkContext.broadcast(in_order(ids))
    width = end + 1

    def parts(frames: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for batch in batches(frames, SLICE):
            _, x, sizes = numbered(batch.column(0), held.value)
            line, _ = in_line(np.where(x == 0, rare, x - 1), sizes, end)
            yield np.unique(line[:-1] * width + line[1:], return_counts=True)

    rows = train.select("text").mapInArrow(lambda frames: summed(parts(frames)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return rows.select(F.expr(f"CAST(key DIV {width} AS INT)").alias("a"), (F.col("key") % width).cast("int").alias("b"), "n")


def gains(table: np.ndarray, classes: int) -> np.ndarray:
    """What one neighbour adds to the log likelihood of a word's class: rows are classes before, then classes after."""
    smooth = table + ADD
    gain = np.log(smooth / smooth.sum(axis=1, keepdims=True) / smooth.sum(axis=0, keepdims=True))
    return np.concatenate((gain[:, :classes], gain[:classes].T))


def lengths(lists: pa.ListArray) -> np.ndarray:
    return np.diff(lists.offsets.to_numpy())


def laid_out(rows: np.ndarray, h: np.ndarray, n: np.ndarray | None, shape: tuple[int, int]) -> np.ndarray:
    """Counts by row and neighbour."""
    return np.bincount(rows * shape[1] + h, n, shape[0] * shape[1]).reshape(shape)


def likeliest(counts: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """The first best class for counts by neighbour, each a row of ``gain``."""
    return (counts @ gain).argmax(axis=1).astype(np.int32)


def local_choices(train: DataFrame, number: dict[bytes, int], kind: np.ndarray, first: int, classes: int) -> dict[int, int]:
    """Number to class of the words numbered ``first`` and beyond, from neighbours whose class ``kind`` has by number (0: of other words)."""
    width = classes + 2
    held = train.sparkSession.sparkContext.broadcast((in_order(number), np.append(kind, classes + 1)))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Keys from 0 on: word and neighbour; below: cells of the classes' table."""
        known, kind = held.value
        end = len(kind) - 1
        table = np.zeros(width * width, np.int64)

        def parts() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches(frames, SLICE):
                _, x, sizes = numbered(batch.column(0), known)
                x, _ = in_line(x, sizes, end)
                c = kind[x]
                table[:] += np.bincount(c[:-1] * width + c[1:], minlength=width * width)
                open_ = (x >= first) & (x < end)
                left, right = open_[1:], open_[:-1]
                yield np.unique(np.concatenate((x[1:][left] * (2 * width) + c[:-1][left], x[:-1][right] * (2 * width) + width + c[1:][right])), return_counts=True)

        yield from summed(parts())
        cells = np.flatnonzero(table)
        yield pa.record_batch([pa.array(-1 - cells), pa.array(table[cells])], names=["key", "n"])

    found = materialise(train.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "lm-near")
    table = np.zeros(width * width)
    for r in found.where("key < 0").collect():  # a table of classes
        table[-1 - r["key"]] = r["n"]
    gain = gains(table.reshape(width, width), classes)
    words = found.where("key >= 0").groupBy(F.expr(f"key DIV {2 * width}").alias("id")).agg(F.collect_list(F.struct((F.col("key") % (2 * width)).cast("int").alias("h"), "n")).alias("near"))  # 2 * (classes + 2) entries a word

    def pick(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            near = batch.column(1)
            h, n = (x.to_numpy() for x in near.flatten().flatten())
            counts = laid_out(np.repeat(np.arange(len(near)), lengths(near)), h, n, (len(near), len(gain)))
            yield pa.record_batch([batch.column(0), pa.array(likeliest(counts, gain))], names=["id", "c"])

    chosen = words.mapInArrow(pick, "id long, c int").toArrow()  # at most 1 / LOCAL_SHARE words
    return dict(zip(chosen["id"].to_pylist(), chosen["c"].to_pylist(), strict=True))


def with_others(kind: np.ndarray, classes: int) -> np.ndarray:
    """Class by number with that of an end added; words without a number have ``classes + 2``."""
    return np.concatenate(([classes + 2], kind[1:], [classes + 1]))


def class_table(train: DataFrame, number: dict[bytes, int], kind: np.ndarray, classes: int) -> np.ndarray:
    """How often one class stands before another; the last is that of words without a number."""
    width = classes + 3
    held = train.sparkSession.sparkContext.broadcast((in_order(number), with_others(kind, classes)))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kind = held.value
        table = np.zeros(width * width, np.int64)
        for batch in batches(frames, SLICE):
            _, x, sizes = numbered(batch.column(0), known)
            c = kind[in_line(x, sizes, len(kind) - 1)[0]]
            table += np.bincount(c[:-1] * width + c[1:], minlength=width * width)
        cells = np.flatnonzero(table)
        yield pa.record_batch([pa.array(cells), pa.array(table[cells])], names=["key", "n"])

    table = np.zeros(width * width)
    for r in train.select("text").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect():  # a table of classes
        table[r["key"]] = r["n"]
    return table.reshape(width, width)


def contexts(train: DataFrame, number: dict[bytes, int], kind: np.ndarray, classes: int) -> DataFrame:
    """word, near, next of words that have no number: a row for a word and slice of the texts.

    near: for each time the word is there, its neighbour's class before it, and that after it (``classes + 3`` more); next: the
    words without a number that follow it.
    """
    size = classes + 3
    held = train.sparkSession.sparkContext.broadcast((in_order(number), with_others(kind, classes)))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kind = held.value
        for batch in batches(frames, SLICE):
            words, x, sizes = numbered(batch.column(0), known)
            line, _ = in_line(x, sizes, len(kind) - 1)
            c, at = kind[line], np.flatnonzero(line == 0)
            coded = words.filter(pa.array(x == 0)).dictionary_encode()
            code = coded.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            near = np.stack((c[at - 1], c[at + 1] + size), axis=1)[order].ravel().astype(np.int32)
            followed = order[line[at + 1][order] == 0]
            lists = [np.concatenate(([0], np.cumsum(np.bincount(code[i], minlength=len(coded.dictionary))))).astype(np.int32) for i in (order, followed)]
            after = coded.dictionary.take(pa.array(code[followed + 1]))
            yield pa.record_batch([coded.dictionary, pa.ListArray.from_arrays(2 * lists[0], near), pa.ListArray.from_arrays(lists[1], after)], names=["word", "near", "next"])

    return train.select("text").mapInArrow(run, "word binary, near array<int>, next array<binary>")


def neighbours(train: DataFrame, number: dict[bytes, int], kind: np.ndarray, classes: int) -> DataFrame:
    """word, next, h, n: the contexts counted.

    Of a word: its neighbour's class h before it, or after it (then h is ``classes + 3`` more); ``classes + 2`` stands for a
    neighbour without a number, and such a pair is a row (word, next) besides.  Rows without a word are cells of the table of
    the numbered words' classes, h = before * (classes + 2) + after.
    """
    around, width = contexts(train, number, kind, classes), classes + 2
    table = class_table(train, number, kind, classes)[:width, :width].ravel()
    cells = train.sparkSession.createDataFrame([(None, None, i, int(table[i])) for i in np.flatnonzero(table).tolist()], "word binary, next binary, h int, n long")
    near = around.select("word", F.lit(None).cast("binary").alias("next"), F.explode("near").alias("h"))
    pairs = around.select("word", F.explode("next").alias("next"), F.lit(None).cast("int").alias("h"))
    return near.unionByName(pairs).groupBy("word", "next", "h").agg(F.count("*").alias("n")).unionByName(cells)


def chosen(around: DataFrame, table: np.ndarray, classes: int, least: int = LEAST) -> DataFrame:
    """word, next, h, c, n from contexts: a row (word, c, n) for each word, which is there n times and takes class c.

    That is the class under which its neighbours are likeliest, given the classes' table N: the sum over its neighbours h of
    log(N(h, c) / (N(h) N(c))), before and after it; a word seen less than ``least`` times has the rare class.  Besides, rows
    (next, c, n) for a word after one of class c, and rows (h, c, n) for neighbours h of all words of class c.
    """
    size, gain = len(table), gains(table, classes)
    schema = "word binary, next binary, h int, c int, n long"
    kinds = [pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64()]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((classes + 1, len(gain)))

        def out(rows: int, **columns) -> pa.RecordBatch:
            names = [x.split()[0] for x in schema.split(", ")]
            return pa.record_batch([pa.array(columns[x], t) if x in columns else pa.nulls(rows, t) for x, t in zip(names, kinds, strict=True)], names=names)

        def settled(words: pa.Array, counts: np.ndarray, owner: np.ndarray, follow: pa.Array) -> Iterator[pa.RecordBatch]:
            n = counts[:, :size].sum(axis=1).astype(np.int64)
            c = np.where(n >= least, likeliest(counts, gain), classes)
            np.add.at(sums, c, counts)
            yield out(len(words), word=words, c=c, n=n)
            if len(follow):
                yield out(len(follow), next=follow, c=c[owner], n=np.ones(len(follow), np.int64))

        last = None  # of a word that may go on: the word, its counts by neighbour, and what follows it
        for batch in frames:
            if not batch.num_rows:
                continue
            words, near, follow = batch.columns
            new = np.concatenate(([True], pc.not_equal(words.slice(1), words.slice(0, len(words) - 1)).to_numpy(zero_copy_only=False)))
            group, words = np.cumsum(new) - 1, words.filter(pa.array(new))
            counts = laid_out(np.repeat(group, lengths(near)), near.flatten().to_numpy(), None, (len(words), len(gain)))
            owner, follow = np.repeat(group, lengths(follow)), follow.flatten()
            if last is not None and last[0].equals(words.slice(0, 1)):
                counts[0] += last[1]
                owner, follow = np.concatenate((np.zeros(len(last[2]), np.int64), owner)), pa.concat_arrays([last[2], follow])
            elif last is not None:
                yield from settled(last[0], last[1][None], np.zeros(len(last[2]), np.int64), last[2])
            end = len(words) - 1
            rest = np.searchsorted(owner, end)
            last = words.slice(end), counts[end], follow.slice(rest)
            yield from settled(words.slice(0, end), counts[:end], owner[:rest], follow.slice(0, rest))
        if last is not None:
            yield from settled(last[0], last[1][None], np.zeros(len(last[2]), np.int64), last[2])
        c, h = np.nonzero(sums)
        yield out(len(c), h=h, c=c, n=sums[c, h].astype(np.int64))

    return around.repartition("word").sortWithinPartitions("word").mapInArrow(run, schema)


def assigned(counted: DataFrame, table: np.ndarray, classes: int, least: int = LEAST) -> DataFrame:
    """word, n, c: the choice from counted neighbours (word, h, n)."""
    around = counted.select("word", F.expr("array_repeat(h, CAST(n AS INT))").alias("near"), F.expr("CAST(array() AS array<binary>)").alias("next"))
    return chosen(around, table, classes, least).where("word IS NOT NULL").select("word", "n", "c")


def information(table: np.ndarray) -> float:
    """Mutual information of neighbouring classes, up to what no exchange changes."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(axis=1)).sum() - _xlogx(table.sum(axis=0)).sum())


def _xlogx(x):
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def exchange(pairs: DataFrame, start: np.ndarray, classes: int, movable: int, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each token number after rounds of exchange; numbers from ``movable`` on keep theirs.

    A round sums the pairs by (word, class of its neighbour) on the executors and lets tasks pick each word's best class
    against the class table of the round.  Half the words (by turns) may move, so that neighbours do not swap in step; a
    turn after which the mutual information is less is undone and ends the rounds.
    """
    spark = pairs.sparkSession
    now, best_so_far, most = start.copy(), start.copy(), -math.inf
    for turn in range(2 * rounds + 1):
        held = spark.createDataFrame(list(enumerate(now.tolist())), "id int, c int")  # at most 1 / CLUSTER_SHARE + 2 rows
        at = lambda side: F.broadcast(held.select(F.col("id").alias(side), F.col("c").alias(f"c{side}")))
        rows = pairs.join(at("a"), "a").join(at("b"), "b")
        both = rows.groupBy("ca", "cb").agg(F.sum("n").alias("n")).collect()  # a table of classes
        table = np.zeros((classes, classes))
        for r in both:
            table[r["ca"], r["cb"]] = r["n"]
        gained = information(table)
        if gained < most:
            return best_so_far
        most, best_so_far = gained, now.copy()
        if turn == 2 * rounds:
            break
        sides = rows.where(F.col("a") < movable).select(F.col("a").alias("w"), F.lit(0).alias("side"), F.col("cb").alias("c"), F.when(F.col("a") == F.col("b"), 0).otherwise(F.col("n")).alias("n"), F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0).alias("own"))
        other = rows.where((F.col("b") < movable) & (F.col("a") != F.col("b"))).select(F.col("b").alias("w"), F.lit(1).alias("side"), F.col("ca").alias("c"), "n", F.lit(0).alias("own"))
        sums = sides.unionByName(other).where(F.col("w") % 2 == turn % 2).groupBy("w", "side", "c").agg(F.sum("n").alias("n"), F.sum("own").alias("own"))
        words = sums.groupBy("w").agg(F.collect_list(F.struct("side", "c", "n", "own")).alias("near"))  # 2 * CLASSES entries a word
        given = spark.sparkContext.broadcast((table, now))

        def best(frames: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            table, now = given.value
            for batch in frames:
                out = []
                for w, near in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    right, left, own = np.zeros(classes), np.zeros(classes), 0
                    for x in near:
                        (left if x["side"] else right)[x["c"]] += x["n"]
                        own += x["own"]
                    out.append(choose(table, right, left, own, int(now[w]), classes - 2))
                yield pa.record_batch([batch.column(0), pa.array(out, pa.int32())], names=["w", "c"])

        moved = 0
        for r in words.mapInArrow(best, "w int, c int").where(F.col("c") >= 0).collect():  # at most 1 / CLUSTER_SHARE rows
            now[r["w"]] = r["c"]
            moved += 1
        if moved * 200 < movable and turn % 2:
            break
    return now


def choose(table: np.ndarray, right: np.ndarray, left: np.ndarray, own: int, home: int, open_: int) -> int:
    """The class among the first ``open_`` that gives most mutual information to a word of class ``home``; -1 to stay."""
    base = table.copy()  # without the word
    base[home, :] -= right
    base[:, home] -= left
    base[home, home] -= own
    rows, columns = base.sum(axis=1), base.sum(axis=0)
    n_right, n_left = right.sum() + own, left.sum() + own
    gain = np.empty(open_)
    terms_row, terms_column = _xlogx(base[:open_] + right), _xlogx(base[:, :open_] + left[:, None])
    old_row, old_column = _xlogx(base[:open_]), _xlogx(base[:, :open_])
    gain = (terms_row - old_row).sum(axis=1) + (terms_column - old_column).sum(axis=0)
    d = np.arange(open_)
    gain -= (terms_row - old_row)[d, d] + (terms_column - old_column)[d, d]  # the diagonal cell takes both
    gain += _xlogx(base[d, d] + right[d] + left[d] + own) - _xlogx(base[d, d])
    gain -= _xlogx(rows[:open_] + n_right) - _xlogx(rows[:open_]) + _xlogx(columns[:open_] + n_left) - _xlogx(columns[:open_])
    best = int(gain.argmax())
    return best if best != home and (home >= open_ or gain[best] > gain[home] + 1e-9) else -1


def fit(train: DataFrame, classes: int = CLASSES, rounds: int = ROUNDS) -> dict:
    """Counts table, classes and class bigrams of the training texts (doc_id, text)."""
    counts = materialise(word_counts(train), "lm-words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = train.count()
    n, distinct = int(total[0]) + ends, int(total[1]) + bool(ends)
    local = counts.where(F.col("n") >= n * LOCAL_SHARE).toArrow()  # at most 1 / LOCAL_SHARE words
    known = sorted(zip(local["word"].to_pylist(), local["n"].to_pylist(), strict=True), key=lambda x: (-x[1], x[0]))
    top = [w for w, c in known if c >= n * CLUSTER_SHARE]
    ids = {w: i for i, w in enumerate(top)}
    rare, end = len(top), len(top) + 1
    start = np.array([i % classes for i in range(len(top))] + [classes, classes + 1])
    pairs = materialise(pair_counts(train, ids, rare, end), "lm-pairs")
    place = exchange(pairs, start, classes + 2, len(top), rounds) if top else start
    # one class a word: place[...] for the clustered, then a choice for the others in the task, then one for those beyond it
    number = {w: i + 1 for i, (w, _) in enumerate(known)}  # 0: not looked up in the task
    count = np.array([0, *[c for _, c in known]], float)
    kind = np.full(len(known) + 1, classes)
    kind[1 : len(top) + 1] = place[: len(top)]
    for _ in range(CHOICES if len(known) > len(top) else 0):
        for i, c in local_choices(train, number, kind, len(top) + 1, classes).items():
            kind[i] = c if count[i] >= LEAST else classes
    width = classes + 2
    wide = class_table(train, number, kind, classes)
    table = wide[:width, :width].copy()  # class before by class
    found = materialise(chosen(contexts(train, number, kind, classes), wide, classes), "lm-classes")
    others = found.where("word IS NOT NULL").select("word", "n", "c")
    for r in found.where("h IS NOT NULL").groupBy("h", "c").agg(F.sum("n").alias("n")).collect():  # a table of classes
        side, h = divmod(r["h"], width + 1)
        if h < width:
            table[(r["c"], h) if side else (h, r["c"])] += r["n"]
    pairs = found.where("next IS NOT NULL").groupBy("next", F.col("c").alias("a")).agg(F.sum("n").alias("n"))
    both = pairs.join(others.select(F.col("word").alias("next"), F.col("c").alias("b")), "next")
    for r in both.groupBy("a", "b").agg(F.sum("n").alias("n")).collect():  # a table of classes
        table[r["a"], r["b"]] += r["n"]
    in_class = table.sum(axis=0)
    prior = (in_class + ADD) / (in_class.sum() + ADD * len(in_class))
    after = (table + WEIGHT * prior) / (table.sum(axis=1, keepdims=True) + WEIGHT)
    n_rare = others.where(F.col("c") == classes).count() + int((kind[1:] == classes).sum())
    rare_total = in_class[classes] + ADD * (n_rare + 1)
    emit = np.log10(np.where(kind == classes, (count + ADD) / rare_total, count / np.maximum(in_class[kind], 1)))
    emit[0] = 0.0
    return {
        "counts": others, "n": n, "distinct": distinct, "ends": ends, "number": number, "rare": classes, "end": classes + 1,
        "count": count, "kind": kind, "emit": emit, "after": np.log10(after), "rare_total": float(rare_total), "in_class": in_class,
    }


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, one row per row of docs."""
    n, base_total, rare = model["n"], model["n"] + ADD * (model["distinct"] + 1), model["rare"]
    held = docs.sparkSession.sparkContext.broadcast({k: v for k, v in model.items() if k not in ("counts", "number")} | {"known": in_order(model["number"])})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (id_bucket(F.col("doc_id"), 10) == 0).alias("held_out"), "text")
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    fields = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
    result = "doc_id: bigint, held_out: boolean, n_tokens: bigint, n_known: bigint, base_score: double, score: double"
    names = ["row", "word", "h", "g", "k", "doc"]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Two kinds of rows: what a text has in the task (k is -1; its word is no word: it starts with a space), and words to look up elsewhere.

        The latter have the classes before and after, and how often (k); -1 for a neighbour that is looked up elsewhere too, then k is their place.
        """
        m = held.value
        kind = np.append(m["kind"], m["end"])
        kind[0] = -1
        last = len(kind) - 1
        log_base = np.log10((m["count"] + ADD) / base_total)
        log_base[0] = 0.0
        log_end = math.log10((m["ends"] + ADD) / base_total)
        for batch in batches(frames, SLICE):
            doc_id, out, text, row = batch.columns
            words, x, sizes = numbered(text, m["known"])
            line, place = in_line(x, sizes, last)
            c, texts = kind[line], np.arange(len(sizes))
            here = (c[:-1] >= 0) & (c[1:] >= 0)
            doc, step = np.repeat(texts, sizes), np.repeat(texts, sizes + 1)
            total = np.bincount(step[here], m["after"][c[:-1][here], c[1:][here]], len(sizes)) + np.bincount(doc, m["emit"][x], len(sizes))
            k = np.bincount(doc[x == 0], minlength=len(sizes))
            base = np.bincount(doc, log_base[x], len(sizes)) + log_end - k * math.log10(base_total)
            mine = pa.StructArray.from_arrays([pa.array(v, t) for v, (_, t) in zip((doc_id, out, sizes + 1, sizes - k + (m["ends"] > 0), base, total), fields, strict=True)], fields=[pa.field(*f) for f in fields])
            no_word = pc.binary_join_element_wise("", row.cast(pa.string()), " ").cast(pa.binary())
            none = np.zeros(len(sizes), np.int32)
            yield pa.record_batch([row, no_word, pa.array(none), pa.array(none), pa.array(none - 1, pa.int64()), mine], names=names)
            away = np.flatnonzero(x == 0)
            coded, d = words.take(pa.array(away)).dictionary_encode(), doc[away]
            word, h, g = coded.indices.to_numpy().astype(np.int64), c[place[away] - 1], c[place[away] + 1]
            alone = (h >= 0) & (g >= 0)
            key = ((d * len(coded.dictionary) + word) * (rare + 2) + h) * (rare + 2) + g
            _, first, often = np.unique(key[alone], return_index=True, return_counts=True)
            at = np.concatenate((np.flatnonzero(alone)[first], np.flatnonzero(~alone)))
            times = np.concatenate((often, (away - np.concatenate(([0], np.cumsum(sizes)))[d])[~alone]))
            if len(at):
                yield pa.record_batch([row.take(pa.array(d[at])), coded.dictionary.take(pa.array(word[at])), pa.array(h[at], pa.int32()), pa.array(g[at], pa.int32()), pa.array(times), pa.nulls(len(at), mine.type)], names=names)

    counts = model["counts"].withColumnRenamed("n", "count")
    found = rows.mapInArrow(run, f"row long, word binary, h int, g int, k long, doc struct<{result}>").join(counts, "word", "left")
    found = found.select("row", "doc", "h", "g", "k", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("c", F.lit(rare)).alias("c"))
    # per class: what a word adds besides its own count
    emission = np.where(np.arange(rare + 2) == rare, math.log10(model["rare_total"]), np.log10(np.maximum(model["in_class"], 1)))

    def add(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words looked up are added to the rows of their texts, each of which comes before its words."""
        after = held.value["after"]
        open_, side = None, (np.zeros(0, np.int64),) * 3  # of the last text; of its last word with a neighbour looked up elsewhere
        for batch in frames:
            if not batch.num_rows:
                continue
            row, doc, *rest = batch.columns
            row, (h, g, k, count, c) = row.to_numpy(), (x.to_numpy() for x in rest)
            alone, own = (h >= 0) & (g >= 0), k < 0
            group = np.cumsum(own)  # 0: of the text before
            times = np.where(own, 0, np.where(alone, k, 1))
            step = np.where(h >= 0, after[h, c], 0.0) + np.where(g >= 0, after[c, g], 0.0) - emission[c] + np.log10(count + np.where(c == rare, ADD, 0.0))
            known, base, total = (np.bincount(group, times * x, group[-1] + 1) for x in (count > 0, np.log10(count + ADD), step))
            away = np.flatnonzero(~alone)
            r, at, kinds = (np.concatenate((a, b[away])) for a, b in zip(side, (row, k, c), strict=True))
            met = np.flatnonzero((r[1:] == r[:-1]) & (at[1:] == at[:-1] + 1))
            total += np.bincount(group[away[met + 1 - len(side[0])]], after[kinds[met], kinds[met + 1]], len(total))
            side = r[-1:], at[-1:], kinds[-1:]
            texts = [open_] * (open_ is not None) + [pa.RecordBatch.from_struct_array(doc.filter(pa.array(own)))]
            texts, skip = pa.concat_batches(texts), int(open_ is None)  # a first batch begins with a text
            sums = {"n_known": known[skip:].astype(np.int64), "base_score": base[skip:], "score": total[skip:]}
            texts = pa.record_batch([pa.array(texts[f].to_numpy() + sums[f]) if f in sums else texts[f] for f, _ in fields], names=[f for f, _ in fields])
            open_ = texts.slice(len(texts) - 1)
            yield texts.slice(0, len(texts) - 1)
        if open_ is not None:
            yield open_

    texts = found.repartition("row").sortWithinPartitions("row", "k").mapInArrow(add, result)
    return texts.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def class_scores(docs: DataFrame, classes: int = CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """Learn from the rows whose id remainder is not 0, score all rows."""
    train = docs.where(id_bucket(F.col("doc_id"), 10) != 0).select("doc_id", "text")
    return score(docs, fit(train, classes, rounds))
