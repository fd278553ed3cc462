"""Trie of conversation prefixes, built level by level.

A conversation's turns are put in order and numbered, conversations are rebuilt (a
family of five shares the first turns of its first), and each distinct sequence of
the first d rebuilt turns becomes a node of depth d.  A node's id is its depth and
its smallest member, since a conversation passes one node a depth.

* Numbering needs no group in one task: rows are dealt by ranges of (conversation,
  turn), numbered inside a range, and a conversation that goes on in the next range
  gets the number of turns before it added.
* Conversations with equal sequences become one sequence with a number of members
  first (four 64-bit sums over position and turn digest tell them apart).
* Per depth, live sequences take their next turn and are grouped by (parent node,
  turn digest), with the minimum id, members and sequences of each group.  A group of
  one sequence is closed: all that hangs below is its own remaining turns, which are
  written at the end from their own rows.  A group of several stays live.  So there
  are as many levels as two different conversations share turns, plus one.
* Then, from the deepest level up, children are counted and leaves and savings added
  to their parents by one join a level.
* The ids of equal conversations are hashed as a stream: ranges of (sequence, id)
  are joined into pieces of ``PIECE`` characters, and one task reads the pieces of a
  sequence, a few thousandths of its rows, in order.

Groupings combine in the tasks before they shuffle.  Joins against groups that may
hold much of the table split them: keys with over a thousandth of the rows (at most a
thousand keys) go by broadcast, the others by shuffle.  Each level is written to the
shared folder; only counts of rows come to the driver.

Turns are ordered by turn (null first), then by digest of role and text; repeated
rows stay.  Null role or text: empty.  Rows without conv_id belong to no conversation
and go.  Very long texts count with all their bytes; only their digest is shuffled.
Ids below zero: the remainder has the sign of the id, as in SQL.  Empty table: no
rows, not even a root.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import materialise

FAMILY, MOST_SHARED = 5, 9
#: A key with a thousandth of the rows is hot; so there are a thousand of them at most.
HOT = 1000
#: Characters of ids that one row of the second pass holds.
PIECE = 1 << 16
NOTHING = hashlib.sha256(b"").hexdigest()


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes over: crc32 of its decimal id, modulo 9."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % MOST_SHARED).cast("int")


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, idx (from 0), digest, bytes and sum (bytes up to and with this turn) of every turn."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text")]
    digest = F.unhex(F.sha2(F.concat(F.length(said[0]).cast("string"), F.lit(":"), *said), 256))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(said[1]).cast("long").alias("bytes"))
    rows = rows.repartitionByRange("conv_id", "turn", "digest").sortWithinPartitions("conv_id", "turn", "digest").drop("turn")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, total, part = None, 0, 0, TaskContext.get().partitionId()
        for batch in frames:
            ids, size = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            if not len(ids):
                continue
            begins = np.concatenate(([True], ids[1:] != ids[:-1]))
            place, run_of = np.arange(len(ids)), np.cumsum(begins) - 1
            starts, ends = np.flatnonzero(begins), np.cumsum(size)
            idx, done = place - starts[run_of], ends - (ends - size)[starts][run_of]
            if ids[0] == last:
                idx[run_of == 0] += n
                done[run_of == 0] += total
            last, n, total = ids[-1], int(idx[-1]) + 1, int(done[-1])
            yield pa.record_batch([*batch.columns, pa.array(idx.astype(np.int64)), pa.array(done.astype(np.int64)), pa.array(np.full(len(ids), part, np.int32))], names=["conv_id", "digest", "bytes", "idx", "sum", "part"])

    rows = materialise(rows.mapInArrow(run, "conv_id long, digest binary, bytes long, idx long, sum long, part int"), "trie-ranges")
    pieces = rows.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.sum("bytes").alias("size"))
    earlier = "OVER (PARTITION BY conv_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    moved = pieces.select("conv_id", "part", F.expr(f"sum(n) {earlier}").alias("more"), F.expr(f"sum(size) {earlier}").alias("larger")).where("more > 0")
    # a range goes on with one conversation at most, so this table has at most a row a range
    rows = rows.join(F.broadcast(moved), ["conv_id", "part"], "left")
    plus = lambda c, d: (F.col(c) + F.coalesce(d, F.lit(0))).alias(c)
    return rows.select("conv_id", plus("idx", "more"), "digest", "bytes", plus("sum", "larger"))


def join_hot(rows: DataFrame, groups: DataFrame, keys: list[str], hot: Column) -> DataFrame:
    """Inner join with a table of groups that is unique by keys: the hot ones (a thousand at most) by broadcast, the others by shuffle."""
    large = F.broadcast(groups.where(hot))
    return rows.join(large, keys).unionByName(rows.join(F.broadcast(groups.where(hot).select(*keys)), keys, "left_anti").join(groups.where(~hot), keys))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, digest, bytes, rest_bytes, rest_turns) of every rebuilt turn, and (conv_id) of every conversation."""
    count = turns.count()
    own = (F.col("conv_id") % FAMILY == 0) | (F.col("idx") >= shared_turns(F.col("conv_id")))
    heads = materialise(
        turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum("bytes").alias("size"), F.sum(F.when(own, 1).otherwise(0)).alias("own_n"), F.sum(F.when(own, F.col("bytes")).otherwise(0)).alias("own_bytes")),
        "trie-heads",
    )
    first = heads.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    heads = heads.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(first, "base", "left")
    takes = F.when(F.col("conv_id") == F.col("base"), 0).otherwise(F.least(shared_turns(F.col("conv_id")).cast("long"), F.coalesce("base_n", F.lit(0))))
    heads = materialise(heads.withColumn("takes", takes), "trie-families")
    # own turns move up where the first conversation is shorter than what is taken from it
    shift = F.when(F.col("conv_id") == F.col("base"), 0).otherwise(F.col("takes") - shared_turns(F.col("conv_id")))
    shifts = heads.select("conv_id", shift.alias("shift"), "n", "size")
    kept = join_hot(turns.where(own), shifts, ["conv_id"], F.col("n") * HOT > count)
    kept = kept.select("conv_id", (F.col("idx") + F.col("shift")).alias("pos"), "digest", "bytes", (F.col("size") - F.col("sum")).alias("rest_bytes"), (F.col("n") - F.col("idx") - 1).alias("rest_turns"))
    lent = turns.where(F.col("idx") < MOST_SHARED - 1).select(F.col("conv_id").alias("base"), F.col("idx").alias("pos"), "digest", "bytes", "sum")
    taken = heads.where("takes > 0").select("conv_id", "base", "takes", "own_n", "own_bytes").join(lent, "base").where("pos < takes")  # at most 4 x 8 rows for each first conversation
    ends = taken.where("pos = takes - 1").select("conv_id", F.col("sum").alias("end"))
    taken = taken.join(ends, "conv_id").select("conv_id", "pos", "digest", "bytes", (F.col("end") - F.col("sum") + F.col("own_bytes")).alias("rest_bytes"), (F.col("takes") - F.col("pos") - 1 + F.col("own_n")).alias("rest_turns"))
    return kept.unionByName(taken), heads.select("conv_id")


def members_hash(members: DataFrame) -> DataFrame:
    """(seq, ends) of (seq, conv_id): the digest of each sequence's ids, ascending and joined by commas."""
    ranged = members.select("seq", "conv_id").repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")

    def pieces(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, ids, size, names = None, [], 0, ["seq", "first", "ids"]
        row = lambda: pa.record_batch([pa.array([seq], pa.int64()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))], pa.string())], names=names)
        for batch in frames:
            for s, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (s != seq or size > PIECE):
                    yield row()
                    ids, size = [], 0
                seq = s
                ids.append(c)
                size += 8
        if ids:
            yield row()

    def hashes(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq, state, done = None, None, []
        for batch in frames:
            for s, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if state is not None and s == seq:
                    state.update(b",")
                else:
                    if state is not None:
                        done.append((seq, state.hexdigest()))
                    seq, state = s, hashlib.sha256()
                state.update(text.encode())
            yield pa.record_batch([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.string())], names=["seq", "ends"])
            done = []
        if state is not None:
            yield pa.record_batch([pa.array([seq], pa.int64()), pa.array([state.hexdigest()], pa.string())], names=["seq", "ends"])

    cut = ranged.mapInArrow(pieces, "seq long, first long, ids string")
    return cut.repartition("seq").sortWithinPartitions("seq", "first").mapInArrow(hashes, "seq long, ends string")


def trie(conversations: DataFrame) -> DataFrame:
    """Per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows, convs = rebuilt(materialise(numbered(conversations), "trie-turns"))
    rows = materialise(rows, "trie-rebuilt")
    # equal sequences become one, named by its smallest member
    lanes = [f"lane{i}" for i in range(4)]
    marks = rows.groupBy("conv_id").agg(*[F.expr(f"bit_xor(xxhash64({i}, pos, digest))").alias(x) for i, x in enumerate(lanes)], F.count("*").alias("len"), F.sum("bytes").alias("size"))
    marks = materialise(convs.join(marks, "conv_id", "left").fillna(0), "trie-marks")
    seqs = materialise(marks.groupBy(*lanes, "len").agg(F.min("conv_id").alias("seq"), F.count("*").alias("m"), F.max("size").alias("size")), "trie-sequences")
    n_convs = marks.count()
    if not n_convs:
        return conversations.sparkSession.createDataFrame([], NODE)
    several = seqs.where("m > 1")
    hashed = materialise(members_hash(join_hot(marks, several.drop("size"), [*lanes, "len"], F.col("m") * HOT > n_convs)), "trie-ends")
    turns = rows.join(seqs.select(F.col("seq").alias("conv_id"), "m"), "conv_id").withColumnRenamed("conv_id", "seq")
    turns = materialise(turns.sortWithinPartitions("pos"), "trie-distinct")  # so that a level reads few row groups
    levels, ends, closed = _levels(seqs, turns)
    nodes = _rolled_up(levels)
    # below a closed node: one node for each turn left, all with its members
    tail = turns.join(closed, "seq").where(F.col("pos") >= F.col("depth")).select(
        F.col("seq").alias("conv_id"), (F.col("pos") + 1).alias("depth"), F.col("seq").alias("parent_conv_id"), F.col("m").alias("n_convs"),
        (F.col("rest_turns") > 0).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("m") - 1) * (F.col("bytes") + F.col("rest_bytes"))).alias("saved_tokens"), F.lit(True).alias("alone"),
    )
    nodes = nodes.unionByName(tail)
    # where a sequence ends: digest of one id here, of several from the stream
    plain = F.col("alone") & ((F.col("n_children") > 0) | (F.col("n_convs") == 1))
    none, one = F.lit(NOTHING), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)
    settled = nodes.where(plain).withColumn("ends_sha256", F.when(F.col("n_children") > 0, none).otherwise(one))
    single = F.sha2(F.col("seq").cast("string").cast("binary"), 256)
    alone = several.select("seq", F.col("len").alias("depth"), F.col("seq").alias("conv_id"), "m").join(closed.select("seq"), "seq")
    asked = ends.unionByName(alone).join(hashed, "seq", "left").select("conv_id", "depth", F.coalesce("ends", single).alias("ends_sha256"))
    open_ = nodes.where(~plain).join(asked, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", none))
    return settled.unionByName(open_).selectExpr(*[f"cast({c.split()[0]} as {c.split()[1]}) {c.split()[0]}" for c in NODE.split(", ")])


NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def _levels(seqs: DataFrame, turns: DataFrame) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """Nodes a level from the root, where sequences end in nodes that others pass (seq, depth, conv_id, m), and where a sequence is alone (seq, depth)."""
    root = seqs.agg(F.min("seq").alias("conv_id"), F.sum("m").alias("n_convs"), F.count("*").alias("n_seqs"), F.max("size").alias("rest_bytes"), F.max("len").alias("rest_turns"))
    root = root.select("conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_seqs", F.lit(0).cast("long").alias("bytes"), "rest_bytes", "rest_turns")
    levels, ends, closed = [materialise(root, "trie-level")], [], []
    top = levels[0].first()
    live = seqs.select("seq", "m", "len", F.lit(top["conv_id"]).alias("node"))
    if top["n_seqs"] == 1:
        closed.append(live.select("seq", F.lit(0).alias("depth")))
        live = live.limit(0)
    else:
        ends.append(live.where("len = 0").select("seq", F.lit(0).alias("depth"), F.col("node").alias("conv_id"), "m"))
        live = live.where("len > 0")
    depth = 0
    while not live.isEmpty():
        depth += 1
        step = materialise(live.select("seq", "m", "len", "node").join(turns.where(F.col("pos") == depth - 1).drop("m", "pos"), "seq"), "trie-step")
        count = step.count()
        groups = step.groupBy("node", "digest").agg(F.min("seq").alias("conv_id"), F.sum("m").alias("n_convs"), F.count("*").alias("n_seqs"), F.max("bytes").alias("bytes"), F.max("rest_bytes").alias("rest_bytes"), F.max("rest_turns").alias("rest_turns"))
        groups = materialise(groups, "trie-level")
        levels.append(groups.select("conv_id", F.col("node").alias("parent_conv_id"), "n_convs", "n_seqs", "bytes", "rest_bytes", "rest_turns"))
        closed.append(groups.where("n_seqs = 1").select(F.col("conv_id").alias("seq"), F.lit(depth).alias("depth")))
        shared = groups.where("n_seqs > 1").select("node", "digest", F.col("conv_id").alias("next"), "n_seqs")
        passed = join_hot(step.select("seq", "m", "len", "node", "digest"), shared, ["node", "digest"], F.col("n_seqs") * HOT > count)
        passed = materialise(passed.select("seq", "m", "len", F.col("next").alias("node")), "trie-live")
        ends.append(passed.where(F.col("len") == depth).select("seq", F.lit(depth).alias("depth"), F.col("node").alias("conv_id"), "m"))
        live = passed.where(F.col("len") > depth)
    empty = seqs.sparkSession.createDataFrame([], "seq long, depth int, conv_id long, m long")
    for part in ends:
        empty = empty.unionByName(part)
    alone = closed[0] if closed else empty.select("seq", "depth").limit(0)
    for part in closed[1:]:
        alone = alone.unionByName(part)
    return levels, empty, materialise(alone, "trie-closed")


def _rolled_up(levels: list[DataFrame]) -> DataFrame:
    """The nodes of all levels with children, leaves and savings of their subtrees, from the deepest level up."""
    below, out = None, None
    for depth in range(len(levels) - 1, -1, -1):
        rows = levels[depth]
        alone = F.col("n_seqs") == 1
        if below is None:
            kids = rows.select(F.col("conv_id").alias("of"), *[F.lit(0).cast("long").alias(c) for c in ("kids", "leaves", "saved")]).limit(0)
        else:
            kids = below.groupBy(F.col("parent_conv_id").alias("of")).agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        rows = rows.join(kids, F.col("conv_id") == F.col("of"), "left")
        saved = (F.col("n_convs") - 1) * F.col("bytes")
        below = materialise(
            rows.select(
                "conv_id", F.lit(depth).cast("long").alias("depth"), "parent_conv_id", "n_convs",
                F.when(alone, (F.col("rest_turns") > 0).cast("long")).otherwise(F.col("kids")).alias("n_children"),
                F.when(alone, 1).otherwise(F.col("leaves")).cast("long").alias("n_leaves"),
                F.when(alone, (F.col("n_convs") - 1) * (F.col("bytes") + F.col("rest_bytes"))).otherwise(saved + F.col("saved")).alias("saved_tokens"),
                alone.alias("alone"),
            ),
            "trie-nodes",
        )
        out = below if out is None else out.unionByName(below)
    return out


_CRC = "list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(8 * length({0})), lambda i: CASE WHEN i % 8 = 0 THEN ord(substr({0}, 1 + i // 8, 1)) ELSE 0 END)), lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1)))"

ORACLE = f"""
WITH own AS (
    SELECT CAST(conv_id AS BIGINT) AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
    FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, c - c % {FAMILY} AS base, xor(4294967295, {_CRC.format("CAST(c AS VARCHAR)")}) % {MOST_SHARED} AS h FROM (SELECT DISTINCT c FROM own)),
said AS (
    SELECT c.c, 0 AS late, o.i, o.role, o.text FROM convs c JOIN own o ON o.c = c.base WHERE o.i <= c.h
    UNION ALL SELECT c.c, 1, o.i, o.role, o.text FROM convs c JOIN own o ON o.c = c.c WHERE o.i > c.h),
turns AS (SELECT c, text, role, row_number() OVER (PARTITION BY c ORDER BY late, i) AS d FROM said),
prefixes AS MATERIALIZED (
    SELECT c, d, octet_length(encode(text)) AS bytes, sha256(string_agg(length(role) || ':' || length(text) || ':' || role || text, ';') OVER (PARTITION BY c ORDER BY d)) AS k FROM turns
    UNION ALL SELECT c, 0, 0, '' FROM convs),
last AS (SELECT c, max(d) AS d, arg_max(k, d) AS k FROM prefixes GROUP BY c),
nodes AS MATERIALIZED (SELECT d, k, min(c) AS id, count(*) AS n, max(bytes) AS bytes FROM prefixes GROUP BY d, k),
parents AS (SELECT DISTINCT n.d, n.k, n.id, p.k AS pk, q.id AS pid FROM nodes n JOIN prefixes p ON p.c = n.id AND p.d = n.d - 1 JOIN nodes q ON q.d = p.d AND q.k = p.k),
kids AS (SELECT d - 1 AS d, pk AS k, count(*) AS n FROM parents GROUP BY 1, 2),
leaves AS (SELECT p.d, p.k, count(DISTINCT l.k || '/' || l.d) AS n FROM prefixes p JOIN last l ON l.c = p.c LEFT JOIN kids ON kids.d = l.d AND kids.k = l.k WHERE kids.n IS NULL GROUP BY 1, 2),
saved AS (SELECT p.d, p.k, sum((n.n - 1) * n.bytes) AS s FROM nodes n JOIN prefixes p ON p.c = n.id AND p.d <= n.d GROUP BY 1, 2),
ends AS (SELECT d, k, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS e FROM last GROUP BY d, k)
SELECT n.id AS conv_id, CAST(n.d AS BIGINT) AS depth, p.pid AS parent_conv_id, CAST(n.n AS BIGINT) AS n_convs, CAST(coalesce(kids.n, 0) AS BIGINT) AS n_children,
       CAST(leaves.n AS BIGINT) AS n_leaves, CAST(saved.s AS BIGINT) AS saved_tokens, sha256(coalesce(ends.e, '')) AS ends_sha256
FROM nodes n LEFT JOIN parents p ON p.d = n.d AND p.k = n.k LEFT JOIN kids ON kids.d = n.d AND kids.k = n.k
     LEFT JOIN leaves ON leaves.d = n.d AND leaves.k = n.k LEFT JOIN saved ON saved.d = n.d AND saved.k = n.k LEFT JOIN ends ON ends.d = n.d AND ends.k = n.k
"""
