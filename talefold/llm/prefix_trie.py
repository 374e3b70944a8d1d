"""Prefix trie of conversations: what their common beginnings save.

A turn's id has a fixed width: 128 bits of the SHA-256 of its role and text, then the number of
its text's bytes, big-endian. A conversation is the string of its turns' ids, so texts
stay where they are read. Equal conversations become one row first, with their number,
least id and the digest of their ids, which are joined in blocks and hashed as a stream.

The distinct strings are dealt in ranges of bounded size, and an adaptive radix tree is
built in each. A tree branches at any byte, but only depths at whole turns are
nodes of the trie, also those inside a compressed path. All figures of a node are sums
over the strings below it once two things are known of each range's border: how
many turns its first string shares with the last one before it (nodes up there are
new in an earlier range), and whether its last string goes on in the next. Only nodes
that cross a border are added up over ranges; the others are whole in one.

Defined cases: null roles and texts are empty; turns that tie in order are taken by
their ids; repeated rows are turns of their own; rows of a null conversation id belong
to no conversation and are left out; conversations without turns end at the root; an
empty table gives an empty result; other columns are ignored. A conversation's string has
to fit a row (100 million turns).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .radix_tree import Node, agree, build
from .scratch import cut, small

#: Bytes of a turn's id, and of the number at its end.
WIDTH, COUNT = 20, 4
#: Bytes of strings in one range: at most, and where more tasks are free.
RANGE_MOST, RANGE_LEAST = 16 << 20, 256 << 10
BLOCK = 1 << 16
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, node string, parent string"
FIGURES = ["n_convs", "n_children", "n_leaves", "saved_tokens"]


def turn_id(role: Column, text: Column) -> Column:
    """The id of a turn in hexadecimal digits."""
    told = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    return F.concat(F.substring(told, 1, 2 * (WIDTH - COUNT)), F.lpad(F.hex(F.octet_length(text).cast("long")), 2 * COUNT, "0"))


def sequences(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, ids: the ids of each conversation's turns in order, nulls first."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text)]
    rows = turns.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.struct(F.col(turn).alias("turn"), turn_id(*said).alias("id")).alias("t"))
    return rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: t["id"]).alias("ids"))


def regrouped(convs: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """conv_id, ids: the beginning of another conversation in front of each, for a table whose conversations share none.

    A conversation c gets the first h turns of c - c % every, h = CRC-32 of c modulo `most`, in place of its own first h.
    """
    base = F.col("conv_id") - F.col("conv_id") % every
    heads = convs.where(base == F.col("conv_id")).select(F.col("conv_id").alias("base"), F.slice("ids", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    both = convs.withColumn("base", base).join(heads, "base", "left")
    own = F.slice("ids", h + 1, F.greatest(F.size("ids") - h, F.lit(0)))
    return both.select("conv_id", F.concat(F.coalesce(F.slice("head", F.lit(1), h), F.array().cast("array<string>")), own).alias("ids"))


def _join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per string from its sorted blocks, which follow one another."""
    schema = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("conv_id", pa.int64()), ("ends", pa.string())])
    now, told = None, None
    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if now is not None and row["told"] == now["told"]:
                told.update(b"," + row["ids"].encode())
                now["n"] += row["n"]
                continue
            if now is not None:
                done.append(now | {"ends": told.hexdigest()})
            now, told = row, hashlib.sha256(row["ids"].encode())
        yield pa.RecordBatch.from_pylist(done, schema)
    if now is not None:
        yield pa.RecordBatch.from_pylist([now | {"ends": told.hexdigest()}], schema)


def strings(convs: DataFrame) -> DataFrame:
    """key, n, conv_id, ends: the distinct strings of convs(conv_id, ids), with the SHA-256 of their conversations' ids."""
    rows = convs.select("conv_id", F.unhex(F.array_join("ids", "")).alias("key"))
    rows = rows.withColumn("told", F.sha2("key", 256)).withColumn("block", F.floor(F.col("conv_id") / BLOCK))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    blocks = rows.groupBy("told", "block").agg(F.first("key").alias("key"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), ids.alias("ids"))
    return blocks.repartition("told").sortWithinPartitions("told", "block").mapInArrow(_join_ids, "key binary, n long, conv_id long, ends string")


def ranges(keys: DataFrame, most: int = RANGE_MOST, least: int = RANGE_LEAST) -> DataFrame:
    """The keys dealt in order to ranges `part` of bounded size, with the turns that each range shares with the
    one before (`before`) and behind it (`behind`); -1 where there is none."""
    total = keys.agg(F.sum(F.octet_length("key") + F.lit(WIDTH))).first()[0] or 0
    tasks = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, -(-total // most), min(-(-total // least), tasks))
    dealt = cut(keys.repartitionByRange(n, "key").withColumn("part", F.spark_partition_id()))
    borders = dealt.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    in_order = Window.orderBy("part")  # a row per range

    def share(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"part": rows["part"], "before": [-1 if a is None else agree(a, b) // WIDTH for a, b in zip(rows["up"], rows["first"], strict=True)]})

    met = borders.select("part", "first", F.lag("last").over(in_order).alias("up")).mapInPandas(share, "part int, before long")
    met = cut(met.select("part", "before", F.coalesce(F.lead("before").over(in_order), F.lit(-1)).alias("behind")))
    return dealt.join(small(met), "part")


def _walk(root: Node) -> list[tuple[Node, int, int]]:
    """The tree's nodes, children before parents, with the bytes that their keys share above and with their own."""
    order, open_ = [], [(root, -1)]
    while open_:
        node, above = open_.pop()
        to = above + 1 + len(node.shared)
        order.append((node, above, to))
        open_ += [(kid, to) for kid in node]
    return order[::-1]


def _edge(root: Node, first: bool) -> set[int]:
    """The nodes on the way to the first or the last key."""
    out, node = set(), root
    while node is not None:
        out.add(id(node))
        kids = [] if first and node.value is not None else list(node)
        node = kids[0 if first else -1] if kids else None
    return out


def _digests(key: bytes, depth: int, width: int) -> list[str]:
    """Digests of the key's first 0 to `depth` turns."""
    told = hashlib.sha256()
    out = [told.hexdigest()]
    for d in range(depth):
        told.update(key[d * width : (d + 1) * width])
        out.append(told.hexdigest())
    return out


def trie_rows(keys: list[bytes], n: list[int], conv: list[int], ends: list[str], before: int, behind: int, width: int = WIDTH, count: int = COUNT) -> dict[str, list]:
    """The trie's nodes over one range's keys, as columns of NODES.

    A node that crosses a border has the digest of its keys' common beginning as `node`, and
    this range's share of the sums; `parent` is that of a parent which crosses one.
    """
    root = build(keys)
    left, right = _edge(root, True), _edge(root, False)
    left_told, right_told = _digests(min(keys), before, width), _digests(max(keys), behind, width)
    out: dict[str, list] = {c: [] for c in ("conv_id", "depth", *FIGURES, "ends", "node", "up")}
    # Of a node of the tree: conversations, least id, leaves, savings, new children, one of its keys, rows that lack their parent.
    got: dict[int, tuple] = {}
    for node, above, to in _walk(root):
        on_left, on_right = id(node) in left, id(node) in right
        total, least, leaves, saved, tops, key, orphans = 0, None, 0, 0, 0, node.value, []
        if node.value is not None:
            total, least = n[node.value], conv[node.value]
            leaves = int(node.below is None and not (on_right and to // width <= behind))
        for kid in node:
            more, low, more_leaves, more_saved, more_tops, key, more_orphans = got.pop(id(kid))
            total, leaves, saved, tops = total + more, leaves + more_leaves, saved + more_saved, tops + more_tops
            least = low if least is None else min(least, low)
            orphans += more_orphans
        for depth in range(to // width, above // width, -1):
            known = on_left and depth <= before  # an earlier range has counted the node
            size = int.from_bytes(keys[key][depth * width - count : depth * width], "big") if depth else 0
            saved += (total - (not known)) * size
            told = left_told[depth] if known else right_told[depth] if on_right and depth <= behind else None
            for row in orphans:
                out["up"][row] = len(out["up"])
            orphans = [len(out["up"])]
            own_ends = ends[node.value] if node.value is not None and depth * width == to else None
            for column, value in zip(out.values(), (least, depth, total, tops, leaves, saved, own_ends, told, -1), strict=True):
                column.append(value)
            tops = int(not known)
        got[id(node)] = total, least, leaves, saved, tops, key, orphans
    up = out.pop("up")
    out["parent"] = [out["node"][i] if i >= 0 else None for i in up]
    out["parent_conv_id"] = [out["conv_id"][i] if i >= 0 and out["node"][i] is None else None for i in up]
    return out


def _range(rows: pa.Table) -> pa.Table:
    columns = [rows.column(c).to_pylist() for c in ("key", "n", "conv_id", "ends")]
    out = trie_rows(*columns, rows.column("before")[0].as_py(), rows.column("behind")[0].as_py())
    text = ("ends", "node", "parent")
    names = [field.split()[0] for field in NODES.split(", ")]
    return pa.table([pa.array(out[c], pa.string() if c in text else pa.int64()) for c in names], names)


def trie(convs: DataFrame, **sizes: int) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node over convs(conv_id, ids)."""
    dealt = ranges(cut(strings(convs)), **sizes)
    nodes = cut(dealt.groupBy("part").applyInArrow(_range, NODES))
    sums = [F.sum(c).alias(c) for c in FIGURES]
    across = cut(nodes.where("node IS NOT NULL").groupBy("node", "depth").agg(F.min("conv_id").alias("conv_id"), *sums, F.max("ends").alias("ends"), F.max("parent").alias("parent")))
    above = small(across.select(F.col("node").alias("parent"), F.col("conv_id").alias("known")))
    told = ["conv_id", "depth", "parent_conv_id", *FIGURES, "ends", "parent"]
    whole = nodes.where("node IS NULL").select(told).unionByName(across.withColumn("parent_conv_id", F.lit(None).cast("long")).select(told))
    ends = F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")
    return whole.join(above, "parent", "left").select("conv_id", "depth", F.coalesce("known", "parent_conv_id").alias("parent_conv_id"), *FIGURES, ends)
