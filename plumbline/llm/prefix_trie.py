"""The trie of all conversations' turns: who shares which beginning, and what sharing it saves."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.frames import sized_join, written

from .mixing import n_words

#: Conversations in blocks of this many share the beginning of the first of the block.
BLOCK = 20
#: Turns that one shard's tree holds, some 500 bytes each, the turns from which on more shards than one are worth while,
#: and the decimal ids that one piece of an end list holds.
SHARD_TURNS, LEAST_TURNS, PIECE_IDS = 200_000, 2_000, 20_000

NODE = "shard long, depth long, conv_id long, parent_shard long, parent_conv long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"
ENDS = "shard long, depth long, from_shard long, piece long, ids string"


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 of a turn's role and text; the role's length in front keeps pairs apart."""
    return F.unhex(F.sha2(F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text)), 256))


def dictionary(turns: DataFrame) -> DataFrame:
    """(digest, code): a 64-bit code for each distinct turn. The table is written, so that codes stay as they are."""
    return written(turns.select("digest").distinct().select("digest", F.monotonically_increasing_id().alias("code")))


def encode(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, codes, words): each conversation's turns in order as dictionary codes, and their numbers of words.

    Turns are ordered by ``turn_col``, null first; equal turn numbers by the digest of the turn. A null role or text
    is the empty one. Rows without an id belong to no conversation. Texts are read once and only digests shuffled; a
    turn that many rows repeat makes its digest's join key hot, which the sized join broadcasts or AQE splits. All
    codes of one conversation meet in one row (12 bytes a turn), its texts never do.
    """
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    turns = written(conversations.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), turn_digest(role, text).alias("digest"), n_words(text).cast("int").alias("words")))
    coded = sized_join(turns, dictionary(turns), "digest", "inner")
    whole = coded.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "code", "words"))).alias("t"))
    return whole.select("conv_id", F.col("t.code").alias("codes"), F.col("t.words").alias("words"))


def rebuild(encoded: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each conversation c with its first h turns taken from the first conversation of its block, h = crc32(c) % 4."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    encoded = written(encoded)
    heads = encoded.where(F.col("conv_id") % block == 0).select(F.col("conv_id").alias("head"), F.slice("codes", 1, 3).alias("head_codes"), F.slice("words", 1, 3).alias("head_words"))
    joined = encoded.join(heads, F.col("conv_id") - F.col("conv_id") % block == F.col("head"), "left")

    def both(own: str, head: str) -> Column:
        none = F.array().cast("array<bigint>" if own == "codes" else "array<int>")
        return F.concat(F.slice(F.coalesce(head, none), F.lit(1), h), F.slice(own, h + 1, F.size(own)))

    return joined.select("conv_id", both("codes", "head_codes").alias("codes"), both("words", "head_words").alias("words"))


def ternary_tree(seqs: list[list[int]]) -> tuple[list, list, list, list, list]:
    """A ternary search tree over sequences sorted and distinct: (symbol, low, equal, high, path), node 0 a header.

    The middle sequence of a range goes in first, then those of both halves, so that every level of the tree is near
    balance; ``equal`` leads to the next turn's tree. ``path[k]`` are the nodes that sequence k passes.
    """
    symbol, low, equal, high = [0], [0], [0], [0]
    path: list[list[int]] = [[]] * len(seqs)
    ranges = [(0, len(seqs))]
    while ranges:
        a, b = ranges.pop()
        if a >= b:
            continue
        mid = (a + b) // 2
        at, links, passed = 0, equal, []
        for s in seqs[mid]:
            node = links[at]
            while node and symbol[node] != s:
                at, links = node, low if s < symbol[node] else high
                node = links[at]
            if not node:
                node = len(symbol)
                links[at] = node
                symbol.append(s)
                low.append(0)
                equal.append(0)
                high.append(0)
            passed.append(node)
            at, links = node, equal
        path[mid] = passed
        ranges += [(a, mid), (mid + 1, b)]
    return symbol, low, equal, high, path


def shard_nodes(convs: list[int], codes: list[list[int]], words: list[list[int]], shard: int, owners: list[int], onward: int) -> tuple[list[tuple], list[tuple]]:
    """One shard's part of every node: (rows as NODE, pieces as ENDS).

    ``owners[d]`` is the shard in which the first sequence's node of depth d begins, for the depths that earlier
    shards share; nodes of the last sequence down to depth ``onward`` go on in the next shard (-1: none). Shards are
    runs of the sequences' order, so only these nodes lie in several. For them members, children, leaves and savings
    are counted such that the shards' parts add up: a child counts where it begins, a leaf where it ends, and a
    node's own words are taken off once, where it begins.
    """
    order = sorted(range(len(convs)), key=lambda i: (codes[i], convs[i]))
    distinct: list[list[int]] = []
    groups: list[list[int]] = []
    weight: list[list[int]] = []
    for i in order:
        if not distinct or codes[i] != distinct[-1]:
            distinct.append(codes[i])
            groups.append([])
            weight.append(words[i])
        groups[-1].append(convs[i])
    symbol, low, equal, high, path = ternary_tree(distinct)
    n = len(symbol)
    first, last = path[0], path[-1]
    begins = [shard] * n
    for d, owner in enumerate(owners):
        begins[first[d - 1] if d else 0] = owner
    goes_on = [False] * n
    for d in range(onward + 1):
        goes_on[last[d - 1] if d else 0] = True
    parent, depth, cost = [0] * n, [0] * n, [0] * n
    members, smallest, ended = [0] * n, [None] * n, [None] * n
    for k, nodes in enumerate(path):
        at, least, count = 0, min(groups[k]), len(groups[k])
        ended[nodes[-1] if nodes else 0] = groups[k]
        for d in range(len(nodes) + 1):
            if d:
                parent[nodes[d - 1]], depth[nodes[d - 1]], cost[nodes[d - 1]] = at, d, weight[k][d - 1]
                at = nodes[d - 1]
            members[at] += count
            smallest[at] = least if smallest[at] is None else min(smallest[at], least)
    children, inside = [0] * n, [0] * n
    walk, stack = [0], [equal[0]]
    while stack:  # every node before the nodes below it
        node = stack.pop()
        if node:
            walk.append(node)
            stack += [low[node], high[node], equal[node]]
            children[parent[node]] += begins[node] == shard
            inside[parent[node]] += 1
    leaves, saved = [0] * n, [0] * n
    for node in reversed(walk):
        leaves[node] += not inside[node] and not goes_on[node]
        saved[node] += (members[node] - (begins[node] == shard)) * cost[node]
        if node:
            leaves[parent[node]] += leaves[node]
            saved[parent[node]] += saved[node]
    rows, pieces = [], []
    for node in walk:
        shared = goes_on[node] or begins[node] != shard
        up = parent[node]
        up_shared = node and (goes_on[up] or begins[up] != shard)
        ends = ",".join(map(str, ended[node] or ()))
        if shared:
            found = ended[node] or ()
            pieces += [(begins[node], depth[node], shard, p, ",".join(map(str, found[p : p + PIECE_IDS]))) for p in range(0, len(found), PIECE_IDS)]
        rows.append((begins[node] if shared else None, depth[node], smallest[node], begins[up] if up_shared else None, smallest[up] if node and not up_shared else None, members[node], children[node], leaves[node], saved[node], None if shared else hashlib.sha256(ends.encode()).hexdigest()))
    return rows, pieces


def run_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, depth, ends): SHA-256 of the joined pieces of each node, rows of a node being consecutive and in order."""
    key, sha = None, None
    done: list[tuple] = []
    for batch in batches:
        for shard, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("shard", "depth", "ids"))):
            if (shard, depth) != key:
                if sha:
                    done.append((*key, sha.hexdigest()))
                key, sha = (shard, depth), hashlib.sha256(ids.encode())
            else:
                sha.update(b"," + ids.encode())
    if sha:
        done.append((*key, sha.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["shard", "depth", "ends"])


def shard_bounds(sharded: DataFrame) -> dict[int, tuple[list[int], int]]:
    """For each shard the owners of what its first sequence shares with earlier shards, and the depth its last one shares onward.

    The first and last sequence of each shard meet in one window; only two numbers a shard come to the driver: how
    many turns its first sequence has in common with the last one of the shard before, and with its own last one.
    """

    def common(a: str, b: str) -> Column:
        same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
        first_other = F.array_position(same, False).cast("int")
        return F.when(first_other > 0, first_other - 1).otherwise(F.size(same))

    ends = sharded.groupBy("shard").agg(F.min("codes").alias("lo"), F.max("codes").alias("hi"))
    ends = ends.withColumn("before", F.lag("hi").over(Window.orderBy("shard")))
    rows = ends.select("shard", F.when(F.col("before").isNotNull(), common("lo", "before")).alias("back"), common("lo", "hi").alias("across")).orderBy("shard").collect()
    out: dict[int, tuple[list[int], int]] = {}
    owners: list[int] = []
    for k, r in enumerate(rows):
        if k:
            passed = min(len(owners), rows[k - 1].across + 1)
            owners = [owners[d] if d < passed else rows[k - 1].shard for d in range(r.back + 1)]
        out[r.shard] = (owners, rows[k + 1].back if k + 1 < len(rows) else -1)
    return out


def trie(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row for each distinct prefix of (conv_id, codes, words): see conversation_trie()."""
    spark = sequences.sparkSession
    size = sequences.agg(F.sum(F.size("codes") + 1)).first()[0] or 0
    n = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), size // LEAST_TURNS), -(-size // shard_turns))
    sharded = written(sequences.repartitionByRange(n, "codes", "conv_id").withColumn("shard", F.spark_partition_id().cast("long")))
    bounds = shard_bounds(sharded)

    def rows_of(table: pa.Table) -> tuple[list[tuple], list[tuple]]:
        shard = table.column("shard")[0].as_py()
        owners, onward = bounds[shard]
        return shard_nodes(*(table.column(c).to_pylist() for c in ("conv_id", "codes", "words")), shard, owners, onward)

    def grow(table: pa.Table) -> pa.Table:
        rows, pieces = rows_of(table)
        kinds = (pa.int64(),) * 9 + (pa.string(), pa.int64(), pa.int64(), pa.string())
        rows = [(*r, None, None, None) for r in rows] + [(p[0], p[1], *(None,) * 8, p[2], p[3], p[4]) for p in pieces]
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    schema = f"{NODE}, from_shard long, piece long, ids string"
    names = [c.split()[0] for c in schema.split(", ")]
    parts = written(sharded.groupBy("shard").applyInArrow(grow, schema))
    nodes, pieces = parts.where("ids is null"), parts.where("ids is not null")
    # The nodes on the shards' borders: at most a path for each border.
    lists = pieces.repartition("shard", "depth").sortWithinPartitions("shard", "depth", "from_shard", "piece").select("shard", "depth", "ids").mapInArrow(run_digest, "shard long, depth long, ends string")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    border = nodes.where("shard is not null").groupBy("shard", "depth").agg(F.min("conv_id").alias("conv_id"), F.max("parent_shard").alias("parent_shard"), F.max("parent_conv").alias("parent_conv"), *sums)
    border = written(border.join(lists, ["shard", "depth"], "left").withColumn("ends", F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest()))))
    # An inner parent never has a border node below it; a node whose parent lies on a border looks it up.
    cols = ["conv_id", "depth", "parent_shard", "parent_conv", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    every = nodes.where("shard is null").select(cols).unionByName(border.select(cols))
    ups = border.select(F.col("shard").alias("up_shard"), F.col("depth").alias("up_depth"), F.col("conv_id").alias("up_conv"))
    found = sized_join(every, ups, (F.col("parent_shard") == F.col("up_shard")) & (F.col("depth") - 1 == F.col("up_depth")), "left")
    return found.select("conv_id", "depth", F.coalesce("parent_conv", "up_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.col("ends").alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, block: int = BLOCK, shard_turns: int = SHARD_TURNS, **columns: str) -> DataFrame:
    """The prefix trie of the rebuilt conversations, one row for each node.

    A node is a distinct sequence of the first d turns; it is named by its smallest member and d. Columns: conv_id,
    depth, parent_conv_id (null for the root), n_convs (members), n_children, n_leaves (childless nodes of the
    subtree), saved_tokens (summed over the subtree: members less one, times the words of the node's last text) and
    ends_sha256 (digest of the ids of the members that end there, in order, comma-joined).

    Sequences are dealt by range into shards of about ``shard_turns`` turns, equal ones by conv_id, so that any number
    of equal conversations spreads over shards. A shard's tree is a ternary search tree over turn codes, filled middle first
    and walked without recursion. Only nodes on a border of two shards have parts in several; their parts are summed
    by (shard where the node begins, depth). Ids that end at a border node travel in pieces and are digested in a
    stream. An empty table has no node at all; repeated rows are repeated turns; other columns are ignored.
    """
    return trie(written(rebuild(encode(conversations, **columns), block)), shard_turns)
