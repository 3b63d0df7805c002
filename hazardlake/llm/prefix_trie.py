"""Prefix trie of conversations, rolled up by centroid decomposition of its parent edges.

A node is a distinct sequence of first turns. Its key sums the turns' hashes times powers of an odd
base, so prefixes come from running sums and a borrowed head is one shift. Subtree sums never walk
up the trie: in a component the nodes that hold more than half of its weight are the path from its
centroid to its top, so a filter finds both. Removing the centroid splits the component; the total
below it is added to that path, and the parts go on alone. Components too large for a task are
split by joins, the rest by the same steps on arrays.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, table

#: Turns that a conversation may borrow, and conversations that share one lender.
MOST_BORROWED, FAMILY = 5, 100
#: Weight (members over all nodes) up to which a component is split inside a task.
PIECE = 1 << 15
#: Ids of one node that are joined to one string before they meet in a task.
IDS_EACH = 4096
ROOT = bytes(16)
_BASES = tuple(np.uint64(b) for b in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
_INVERSES = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in _BASES)


def _power(base: np.uint64, exponents: np.ndarray) -> np.ndarray:
    """base to each exponent (none negative), modulo 2^64."""
    out, e, square = np.ones(len(exponents), np.uint64), exponents.astype(np.uint64), base
    while e.any():
        out = np.where(e & np.uint64(1), out * square, out)
        with np.errstate(over="ignore"):
            square = square * square
        e = e >> np.uint64(1)
    return out


def _shift(base, inverse, by: np.ndarray) -> np.ndarray:
    return np.where(by >= 0, _power(base, np.maximum(by, 0)), _power(inverse, np.maximum(-by, 0)))


def _u64(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _keys(pairs: list[np.ndarray]) -> pa.Array:
    """16 bytes of each pair of sums."""
    both = np.ascontiguousarray(np.stack(pairs, 1))
    n = len(both)
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * 16)
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets.buffers()[1], pa.py_buffer(both.tobytes())])


_PLACED = "part int, conv_id long, at long, chars long, term_a long, term_b long, sum_a long, sum_b long"


def _place(batches):
    """Number the turns of a sorted partition within their conversation, and sum up their terms."""
    part = TaskContext.get().partitionId()
    last, at0, sums0 = None, 0, [np.uint64(0)] * 2
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        conv = b.column(0).to_numpy()
        new = np.flatnonzero(np.concatenate([[conv[0] != last], conv[1:] != conv[:-1]]))
        own = np.searchsorted(new, np.arange(n), "right")  # 0: goes on from the batch before
        begin = np.concatenate([[0], new])[own]
        at = np.arange(n) - begin + 1 + np.where(own == 0, at0, 0)
        halves = np.frombuffer(b"".join(b.column(1).to_pylist()), ">u8").astype(np.uint64).reshape(-1, 2)
        terms, sums = [], []
        for k in range(2):
            term = halves[:, k] * _power(_BASES[k], at)
            total = np.cumsum(term)
            before = np.concatenate([np.zeros(1, np.uint64), total])[begin]
            terms.append(term)
            sums.append(total - before + np.where(own == 0, sums0[k], np.uint64(0)))
        last, at0, sums0 = conv[-1], int(at[-1]), [s[-1] for s in sums]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, part, np.int32)), b.column(0), pa.array(at), b.column(2),
             *map(_signed, terms), *map(_signed, sums)], names=[f.split()[0] for f in _PLACED.split(", ")])


def _ordered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, chars, term_*, sum_*) of all turns, sums running within the conversation.

    Turns are dealt out by ranges of (conv_id, turn), so a conversation of any length is shared by
    many tasks. What a task must add to its first conversation, from the tasks before it, is worked
    out from one row a task.
    """
    spark = conversations.sparkSession
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    content = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    order = ["conv_id", F.col("turn").asc_nulls_first(), "content"]
    turns = (conversations.where(F.col("conv_id").isNotNull())
             .select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.unhex(F.substring(content, 1, 32)).alias("content"),
                     F.length(text).cast("long").alias("chars"))
             .repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "content", "chars"))
    placed = stored(turns.mapInArrow(_place, _PLACED))
    edges = placed.groupBy("part").agg(F.min("conv_id").alias("low"), F.max(F.struct("conv_id", "at", "sum_a", "sum_b")).alias("top"))
    carried, open_ = [], (None, 0, 0, 0)
    for r in sorted(edges.collect(), key=lambda r: r["part"]):
        conv, at, a, b = r["top"]
        if r["low"] == open_[0]:
            carried.append((r["part"], *open_))
            if conv == r["low"]:
                sums = [(s + v * pow(int(base), open_[1], 1 << 64)) % (1 << 64)
                        for s, v, base in zip(open_[2:], (a, b), _BASES)]
                open_ = (conv, at + open_[1], *sums)
                continue
        open_ = (conv, at, a % (1 << 64), b % (1 << 64))
    signed = [(p, c, n, *(s - (1 << 64) if s >= 1 << 63 else s for s in (a % (1 << 64), b % (1 << 64)))) for p, c, n, a, b in carried]
    carry = spark.createDataFrame(signed, "part int, conv_id long, before long, plus_a long, plus_b long")
    joined = placed.join(F.broadcast(carry), ["part", "conv_id"], "left").select(
        "conv_id", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"), "chars",
        F.coalesce("before", F.lit(0)).alias("before"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("plus_a", "plus_b")),
        "term_a", "term_b", "sum_a", "sum_b")

    def add(batches):
        for b in batches:
            before = b.column(3).to_numpy()
            out = []
            for k in range(2):
                by = _power(_BASES[k], before)
                out += [_signed(_u64(b.column(6 + k)) * by), _signed(_u64(b.column(8 + k)) * by + _u64(b.column(4 + k)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), out[0], out[2], out[1], out[3]],
                                             names=["conv_id", "pos", "chars", "term_a", "term_b", "sum_a", "sum_b"])

    return joined.mapInArrow(add, "conv_id long, pos long, chars long, term_a long, term_b long, sum_a long, sum_b long")


def rebuilt_prefixes(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, length, node, parent, chars) of every prefix of every rebuilt conversation.

    A conversation c is the first h turns of conversation c - c % 100 (all if it has fewer, none if
    there is none), then its own turns after its first h; h is crc32 of c in decimal, modulo 6.
    Turns are in order of turn, NULL first, ties by SHA-256 of role and text; NULL roles and texts
    are empty. Rows without conv_id take no part; a negative c lends from c - pmod(c, 100). Repeated
    rows are turns of their own. ``node`` and ``parent`` are 128-bit keys of the first depth and
    depth - 1 turns; depth 0, the root, is a row of each conversation with NULL parent.
    """
    turns = stored(_ordered(conversations))
    head = F.struct("pos", "chars", "term_a", "term_b", "sum_a", "sum_b")
    heads = stored(turns.groupBy("conv_id").agg(
        F.max("pos").alias("n"), F.sort_array(F.collect_list(F.when(F.col("pos") <= MOST_BORROWED, head))).alias("head"))
        .withColumn("h", F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(MOST_BORROWED + 1))))
    lenders = heads.where(F.pmod("conv_id", F.lit(FAMILY)) == 0).select(F.col("conv_id").alias("lender"), F.col("head").alias("lent"))
    known = heads.withColumn("lender", F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY))).join(lenders, "lender", "left")
    known = known.withColumn("lent", F.slice(F.coalesce("lent", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h").cast("int")))
    lent, own = F.try_element_at("lent", F.lit(-1)), F.get("head", F.col("h").cast("int") - 1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    known = stored(known.select(
        "conv_id", "n", "h", "lent", F.size("lent").cast("long").alias("m"),
        (F.size("lent") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("length"),
        *(zero(lent[f"sum_{k}"]).alias(f"lent_{k}") for k in "ab"), *(zero(own[f"sum_{k}"]).alias(f"own_{k}") for k in "ab")))
    columns = ["conv_id", "depth", "length", "chars", "term_a", "term_b", "sum_a", "sum_b", "by", "lent_a", "lent_b", "own_a", "own_b"]
    z = F.lit(0).cast("long")
    borrowed = known.select("conv_id", "length", F.explode("lent").alias("t")).select(
        "conv_id", F.col("t.pos").alias("depth"), "length", "t.chars", "t.term_a", "t.term_b", "t.sum_a", "t.sum_b", z.alias("by"),
        *(z.alias(c) for c in columns[9:]))
    after = turns.join(known.drop("lent", "n"), "conv_id").where(F.col("pos") > F.col("h")).select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("depth"), "length", "chars", "term_a", "term_b", "sum_a", "sum_b",
        (F.col("m") - F.col("h")).alias("by"), "lent_a", "lent_b", "own_a", "own_b")
    root = known.select("conv_id", z.alias("depth"), "length", *(z.alias(c) for c in columns[3:]))

    def key(batches):
        for b in batches:
            col = dict(zip(columns, b.columns))
            by, depth = col["by"].to_numpy(), col["depth"].to_numpy()
            node, parent = [], []
            for k, s in enumerate("ab"):
                shift = _shift(_BASES[k], _INVERSES[k], by)
                total = _u64(col[f"lent_{s}"]) + (_u64(col[f"sum_{s}"]) - _u64(col[f"own_{s}"])) * shift
                node.append(total)
                parent.append(total - _u64(col[f"term_{s}"]) * shift)
            top = pa.array(depth == 0)
            parents = pa.compute.if_else(top, pa.scalar(None, pa.binary()), _keys(parent))
            yield pa.RecordBatch.from_arrays([col["conv_id"], col["depth"], col["length"], _keys(node), parents, col["chars"]],
                                             names=["conv_id", "depth", "length", "node", "parent", "chars"])

    every = borrowed.unionByName(after).unionByName(root).select(*columns)
    return every.mapInArrow(key, "conv_id long, depth long, length long, node binary, parent binary, chars long")


def _joined_ids(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): SHA-256 of the conv_ids that end at a node, ascending, comma-joined.

    Ids of a node are first joined by ranges, IDS_EACH at a time, and the hash then takes one
    string after the other, so no task holds the ids of a node.
    """
    def strings(batches):
        node, ids = None, []

        def out():
            return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([ids[0]], pa.int64()),
                                               pa.array([",".join(map(str, ids))])], names=["node", "first", "ids"])
        for b in batches:
            for k, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if ids and (k != node or len(ids) == IDS_EACH):
                    yield out()
                    ids = []
                node = k
                ids.append(i)
        if ids:
            yield out()

    def digest(batches):
        node, h, found = None, None, []
        for b in batches:
            for k, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if k != node:
                    if h:
                        found.append((node, h.hexdigest()))
                    node, h = k, hashlib.sha256(s.encode())
                else:
                    h.update(b"," + s.encode())
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.string())],
                                             names=["node", "ends_sha256"])
            found = []
        if h:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([h.hexdigest()])], names=["node", "ends_sha256"])

    pieces = (ends.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
              .mapInArrow(strings, "node binary, first long, ids string"))
    return (pieces.repartition("node").sortWithinPartitions("node", "first").select("node", "ids")
            .mapInArrow(digest, "node binary, ends_sha256 string"))


def decompose(parent: np.ndarray, weight: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Subtree sums of the rows of ``values`` in a forest, by centroid decomposition.

    ``parent`` has -1 at tops; ``weight`` is each node's weight summed over its subtree, own
    weights being at least 1. Every round removes the centroid of every component at once, so
    there are at most as many rounds as the largest weight has bits.
    """
    up, weight = parent.copy(), weight.copy()
    done = np.zeros(values.shape, values.dtype)
    left = np.arange(len(up))
    while len(left):
        top = np.where(up[left] < 0, left, up[left])
        at = np.empty(len(up), np.int64)
        while True:  # every node's pointer leaps until it is at the top of its component
            at[left] = top
            leap = at[top]
            if (leap == top).all():
                break
            top = leap
        heavy = 2 * weight[left] > weight[top]
        path, path_top = left[heavy], top[heavy]
        inner = up[path]
        above = np.zeros(len(up), bool)
        above[inner[inner >= 0]] = True
        last = ~above[path]
        centre = np.full(len(up), -1)
        centre[path_top[last]] = path[last]
        found = path[last]
        # Cut the centroids out; their children become tops, whose components' totals lie below them.
        is_centre = np.zeros(len(up), bool)
        is_centre[found] = True
        old = up[left]
        child = (old >= 0) & is_centre[old]
        below = np.zeros(len(up), bool)
        below[left[child]] = True
        ends = np.where(below[left] | is_centre[left] | (old < 0), left, old)
        while True:
            at[left] = ends
            leap = at[ends]
            if (leap == ends).all():
                break
            ends = leap
        owner = np.where(below[ends], up[ends], np.where(is_centre[ends], ends, -1))
        mine = owner >= 0
        total = np.zeros(values.shape, values.dtype)
        np.add.at(total, owner[mine], values[left[mine]])
        c = centre[path_top]
        done[path] += total[c]
        on = path[~last]
        weight[on] -= weight[c[~last]]
        up[left[child]] = -1
        left = left[~is_centre[left]]
    return done


_SUMS = "node binary, n_leaves long, saved_tokens long"


def _in_tasks(batches):
    """Subtree sums of whole components, which come sorted by component."""
    def some(held):
        t = pa.Table.from_batches(held).combine_chunks()
        node, comp, parent = (t.column(k).to_pylist() for k in range(3))
        weight, leaf, saved, plus_leaf, plus_saved = (t.column(k).to_numpy() for k in range(3, 8))
        index = {k: i for i, k in enumerate(node)}
        up = np.array([-1 if p is None else index.get(p, -1) for p in parent], np.int64)
        up = np.array([-1 if p >= 0 and comp[p] != c else p for p, c in zip(up.tolist(), comp)], np.int64)
        sums = decompose(up, weight, np.stack([leaf, saved], 1)) + np.stack([plus_leaf, plus_saved], 1)
        return pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(sums[:, 0]), pa.array(sums[:, 1])],
                                          names=["node", "n_leaves", "saved_tokens"])

    held, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        if size >= PIECE:
            last = held[-1].column(1)[-1]
            cut = next((i for i in range(b.num_rows) if b.column(1)[i] != last), b.num_rows)
            if cut:
                held.append(b.slice(0, cut))
            if cut < b.num_rows:
                yield some(held)
                held, size, b = [], 0, b.slice(cut)
            else:
                continue
        held.append(b)
        size += b.num_rows
    if held:
        yield some(held)


_STATE = ["node", "comp", "parent", "depth", "conv_id", "weight", "leaf", "saved", "plus_leaf", "plus_saved"]


def subtree_sums(nodes: DataFrame, prefixes: DataFrame, piece: int = PIECE) -> DataFrame:
    """(node, n_leaves, saved_tokens): ``leaf`` and ``saved`` of nodes summed over their subtrees.

    Components above ``piece`` are split by joins, all of a round at once; each round halves their
    weight at least. Which nodes lie below a centroid, and under which of its children, is read
    from the prefixes of each node's smallest member.
    """
    state = nodes.select("node", F.lit(ROOT).alias("comp"), "parent", "depth", "conv_id", "weight", "leaf", "saved",
                         F.lit(0).cast("long").alias("plus_leaf"), F.lit(0).cast("long").alias("plus_saved"))
    done, light = None, None
    while True:
        heavy = state.groupBy("comp").agg(F.max("weight").alias("whole")).where(F.col("whole") > piece)
        rest = state.join(heavy, "comp", "left_anti").select(*_STATE)
        light = rest if light is None else light.unionByName(rest)
        centre = (state.join(heavy, "comp").where(2 * F.col("weight") > F.col("whole")).groupBy("comp")
                  .agg(F.max(F.struct("depth", "node", "weight")).alias("c"))
                  .select("comp", F.col("c.node").alias("centre"), F.col("c.depth").alias("level"), F.col("c.weight").alias("cut")))
        centre = stored(centre.join(heavy, "comp"))
        if centre.isEmpty():
            break
        tops = (prefixes.where(F.col("parent").isNotNull()).join(centre.select("comp", F.col("centre").alias("parent")), "parent")
                .select("conv_id", "comp", F.col("node").alias("top")))
        split = stored(state.join(centre, "comp").join(tops, ["conv_id", "comp"], "left")
                       .withColumn("below", F.col("top").isNotNull() & (F.col("depth") > F.col("level"))))
        inside = F.col("below") | (F.col("node") == F.col("centre"))
        total = split.where(inside).groupBy("comp").agg(F.sum("leaf").alias("sum_leaf"), F.sum("saved").alias("sum_saved"))
        on_path = ~F.col("below") & (2 * F.col("weight") > F.col("whole"))
        add = lambda to, what: (F.col(to) + F.when(on_path, F.col(what)).otherwise(0)).alias(to)
        moved = stored(split.join(total, "comp").select(
            "node", F.when(F.col("below"), F.col("top")).otherwise(F.col("comp")).alias("comp"), "parent", "depth", "conv_id",
            (F.col("weight") - F.when(on_path & (F.col("node") != F.col("centre")), F.col("cut")).otherwise(0)).alias("weight"),
            "leaf", "saved", add("plus_leaf", "sum_leaf"), add("plus_saved", "sum_saved"), (F.col("node") == F.col("centre")).alias("out")))
        out = moved.where("out").select("node", F.col("plus_leaf").alias("n_leaves"), F.col("plus_saved").alias("saved_tokens"))
        done = out if done is None else done.unionByName(out)
        state = moved.where(~F.col("out")).select(*_STATE)
    local = (light.repartition("comp").sortWithinPartitions("comp")
             .select("node", "comp", "parent", "weight", "leaf", "saved", "plus_leaf", "plus_saved").mapInArrow(_in_tasks, _SUMS))
    return local if done is None else local.unionByName(done)


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the prefix trie of rebuilt conversations, keyed by (node), with their rollups.

    Columns: node and parent (16 bytes), conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256. The empty table has no nodes, not even a root.
    Other columns than conv_id, turn, role and text are not read.
    """
    prefixes = stored(rebuilt_prefixes(conversations))
    found = prefixes.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.max("chars").alias("chars"),
        F.count("*").alias("n_convs"), F.sum(F.col("length") - F.col("depth") + 1).alias("weight"))
    found = stored(found)
    children = found.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = stored(found.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
                   .withColumn("leaf", (F.col("n_children") == 0).cast("long"))
                   .withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")))
    sums = subtree_sums(nodes, prefixes)
    ends = _joined_ids(prefixes.where(F.col("depth") == F.col("length")))
    above = found.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (nodes.join(sums, "node").join(ends, "node", "left").join(above, "parent", "left")
            .select("node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))


def op11_prefix_trie(spark, sf_dir) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations")).drop("node", "parent")


#: Prefixes as hashes of joined turns; every node meets its ancestors through its smallest member.
ORACLE = """
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn,
           sha256(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS content
    FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, content) AS pos FROM turns),
heads AS (
    SELECT conv_id, conv_id - ((conv_id % 100) + 100) % 100 AS lender,
           xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
               lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)),
                   lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 6 AS h
    FROM (SELECT DISTINCT conv_id FROM own)),
rebuilt AS (
    SELECT h.conv_id, 0 AS half, o.pos, o.content, length(o.text) AS chars
    FROM heads h JOIN own o ON o.conv_id = h.lender AND o.pos <= h.h
    UNION ALL
    SELECT h.conv_id, 1, o.pos, o.content, length(o.text) FROM heads h JOIN own o ON o.conv_id = h.conv_id AND o.pos > h.h),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY half, pos) AS depth FROM rebuilt),
rows AS (
    SELECT conv_id, depth, chars, sha256(string_agg(content, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM placed
    UNION ALL SELECT conv_id, 0, 0, 'root' FROM heads),
ended AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM rows),
nodes AS (
    SELECT node, min(conv_id) AS conv_id, min(depth) AS depth, min(chars) AS chars, count(*) AS n_convs,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
    FROM ended GROUP BY node),
linked AS (
    SELECT n.*, p.conv_id AS parent_conv_id, p.node AS parent
    FROM nodes n LEFT JOIN rows r ON r.conv_id = n.conv_id AND r.depth = n.depth - 1 LEFT JOIN nodes p ON p.node = r.node),
counted AS (
    SELECT l.*, coalesce(c.n, 0) AS n_children FROM linked l
    LEFT JOIN (SELECT parent, count(*) AS n FROM linked GROUP BY parent) c ON c.parent = l.node),
sums AS (
    SELECT r.node, sum((c.n_children = 0)::BIGINT) AS n_leaves, sum((c.n_convs - 1) * c.chars) AS saved_tokens
    FROM counted c JOIN rows r ON r.conv_id = c.conv_id AND r.depth <= c.depth GROUP BY r.node)
SELECT c.conv_id, c.depth::BIGINT AS depth, c.parent_conv_id, c.n_convs, c.n_children::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, c.ends_sha256
FROM counted c JOIN sums s USING (node)
"""
