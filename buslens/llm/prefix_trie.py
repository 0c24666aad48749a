"""Prefix trie of conversations: nodes by running sequence hashes, subtree totals by parallel tree contraction."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, functions as F

from buslens.llm.common import partitions, pick, running_sums, same_keys_join, sorted_blocks, staged
from buslens.llm.words import mix

#: Conversations that share a first one, and one more than the most turns taken from it.
FAMILY, HEADS = 5, 9
#: Characters of a list of ids that are hashed at once.
PIECE = 1 << 16
_NODE = "struct<conv:bigint,depth:bigint>"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two 64-bit hashes of a turn's role and text, and the bytes of its text."""
    for batch in batches:
        keys, sizes = bytearray(), []
        for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist()):
            role, text = (role or "").encode(), (text or "").encode()
            h = hashlib.blake2b(len(role).to_bytes(8, "little"), digest_size=16)
            h.update(role)
            h.update(text)
            keys += h.digest()
            sizes.append(len(text))
        a, b = np.frombuffer(bytes(keys), "<i8").reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), pa.array(a), pa.array(b), pa.array(sizes, pa.int64()), pa.array(np.ones(len(a), "int64"))],
                                         names=["conv_id", "turn", "a", "b", "bytes", "one"])


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth from 1, a, b, bytes) of the rebuilt conversations, and all of them as (conv_id, n_turns).

    The head of conversation c is the first h turns of conversation c - c % 5, h being crc32(c) % 9; behind it come c's own turns after its first h.
    (a, b) is a 128-bit hash of role and text. Places come from sums over a range-sorted table, so no conversation is gathered in one task.
    """
    turns = pick(conversations, "conv_id", "turn", "role", "text").where("conv_id is not null").withColumns({"conv_id": F.col("conv_id").cast("long"), "turn": F.col("turn").cast("long")})
    hashed = staged(turns.mapInArrow(_digest, "conv_id long, turn long, a long, b long, bytes long, one long"), "turns")
    # NULL turns sort first; equal turns by their hash.
    placed = staged(running_sums(hashed, ["conv_id", "turn", "a", "b", "bytes"], "one", "conv_id").select("conv_id", F.col("before").alias("at"), "a", "b", "bytes"), "placed")
    convs = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    convs = staged(convs.select("conv_id", "n", (F.crc32(F.col("conv_id").cast("string")) % HEADS).alias("h"), F.expr(f"conv_id - conv_id % {FAMILY}L").alias("base")), "convs")
    firsts = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(firsts, "base", "left").withColumn("head", F.least("h", F.coalesce("n_base", F.lit(0).cast("long"))))
    convs = staged(convs.withColumn("n_turns", F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0).cast("long"))), "convs")
    own = placed.join(convs.select("conv_id", "h", "head"), "conv_id").where("at >= h")
    own = own.select("conv_id", (F.col("head") + F.col("at") - F.col("h") + 1).alias("depth"), "a", "b", "bytes")
    # A family has nine members at most, and of its first conversation only the first eight turns are wanted.
    taken = placed.where(F.col("at") < HEADS - 1).withColumnRenamed("conv_id", "base").join(convs.select("conv_id", "base", "h"), "base").where("at < h")
    return own.unionByName(taken.select("conv_id", (F.col("at") + 1).alias("depth"), "a", "b", "bytes")), convs.select("conv_id", "n_turns")


def prefixes(turns: DataFrame) -> DataFrame:
    """Adds (ka, kb), a 128-bit hash of all turns of the conversation up to this one, and (pa, pb), that of those before it.

    Each turn is hashed with its depth; a prefix is the sum of its turns' hashes modulo 2**64. Sums run within blocks of the range-sorted table; the
    blocks' totals are added up per conversation, in halves that cannot overflow.
    """
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, last, carry = TaskContext.get().partitionId(), None, np.zeros(2, "uint64")
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            conv = batch.column("conv_id").to_numpy()
            depth = mix(batch.column("depth").to_numpy().astype("uint64") + np.uint64(0x9E3779B97F4A7C15))
            starts = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
            out = []
            for i, name in enumerate("ab"):
                own = mix(batch.column(name).to_numpy().view("uint64") ^ (depth + np.uint64(i)))
                sums = np.cumsum(own)
                sums -= np.repeat(sums[starts] - own[starts], np.diff(starts, append=n))
                if last == conv[0]:
                    sums[: starts[1] if len(starts) > 1 else n] += carry[i]
                carry[i] = sums[-1]
                out += [sums.view("int64"), own.view("int64")]
            last = conv[-1]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("conv_id", "depth", "bytes")], pa.array(np.full(n, block)), *map(pa.array, out)],
                                             names=["conv_id", "depth", "bytes", "block", "sa", "oa", "sb", "ob"])

    rows = staged(sorted_blocks(staged(turns, "rebuilt"), ["conv_id", "depth"]).mapInArrow(add, "conv_id long, depth long, bytes long, block long, sa long, oa long, sb long, ob long"), "prefixes")
    ends = rows.groupBy("conv_id", "block").agg(F.max_by("sa", "depth").alias("sa"), F.max_by("sb", "depth").alias("sb"))
    low, top = "{0} & 4294967295", "shiftrightunsigned({0}, 32)"
    over = "sum({0}) over (partition by conv_id order by block rows between unbounded preceding and 1 preceding)"
    halves = ends.select("conv_id", "block", *[F.expr(f"coalesce({over.format(part.format(c))}, 0L)").alias(f"{c}_{i}") for c in ("sa", "sb") for i, part in enumerate((low, top))])
    offsets = staged(halves.where("sa_0 <> 0 or sa_1 <> 0 or sb_0 <> 0 or sb_1 <> 0"), "offsets")

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for c in "ab":
                low, top = (batch.column(f"s{c}_{i}").fill_null(0).to_numpy().astype("uint64") for i in (0, 1))
                key = batch.column(f"s{c}").to_numpy().view("uint64") + low + (top << np.uint64(32))
                out += [key, key - batch.column(f"o{c}").to_numpy().view("uint64")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("conv_id", "depth", "bytes")], *[pa.array(x.view("int64")) for x in out]],
                                             names=["conv_id", "depth", "bytes", "ka", "pa", "kb", "pb"])

    joined = rows.join(offsets, ["conv_id", "block"], "left")
    return joined.mapInArrow(shift, "conv_id long, depth long, bytes long, ka long, pa long, kb long, pb long")


def id_digests(members: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ends_sha256) for `members` (keys, conv_id): SHA-256 of each key's ids, ascending, decimal, comma-joined.

    Ids are range-sorted by key and id. A key that lies in one block is hashed there. One that reaches over blocks leaves its text in pieces, and as
    SHA-256 reads its input in order, one task streams through a key's pieces, holding one at a time.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, key, held, size, part, inner, out = TaskContext.get().partitionId(), None, [], 0, 0, False, []
        for batch in batches:
            for *now, conv in zip(*[batch.column(c).to_pylist() for c in (*keys, "conv_id")]):
                now = tuple(now)
                if now != key and key is not None:
                    text = ",".join(held)
                    # The first key may go on from the block before, the last one in the next.
                    out.append((*key, block, part, None, hashlib.sha256(text.encode()).hexdigest()) if inner and not part else (*key, block, part, text, None))
                    held, size, part, inner = [], 0, 0, True
                elif size >= PIECE:
                    out.append((*key, block, part, ",".join(held), None))
                    held, size, part = [], 0, part + 1
                key = now
                held.append(str(conv))
                size += len(held[-1]) + 1
                if len(out) >= 1000 or part and out:
                    yield table(out)
                    out = []
        if key is not None:
            out.append((*key, block, part, ",".join(held), None))
        yield table(out)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[]] * (len(keys) + 4)
        kinds = [*[pa.int64()] * len(keys), pa.int32(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=[*keys, "block", "part", "piece", "sha"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []

        def flush():
            columns = list(zip(*done)) or [[]] * (len(keys) + 1)
            kinds = [*[pa.int64()] * len(keys), pa.string()]
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=[*keys, "ends_sha256"])
            done.clear()
            return batch

        for batch in batches:
            for *now, text in zip(*[batch.column(c).to_pylist() for c in (*keys, "piece")]):
                now = tuple(now)
                if now != key:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = now, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            if len(done) > 1000:
                yield flush()
        if key is not None:
            done.append((*key, state.hexdigest()))
        yield flush()

    names = ", ".join(f"{k} long" for k in keys)
    found = staged(sorted_blocks(members.select(*keys, "conv_id"), [*keys, "conv_id"]).mapInArrow(cut, f"{names}, block int, part long, piece string, sha string"), "digests")
    whole = found.where("sha is not null").select(*keys, F.col("sha").alias("ends_sha256"))
    pieces = found.where("sha is null").repartition(partitions(members.sparkSession), *keys).sortWithinPartitions(*keys, "block", "part")
    return whole.unionByName(pieces.mapInArrow(join, f"{names}, ends_sha256 string"))


def _counted(df: DataFrame, name: str, **counts) -> tuple[DataFrame, dict[str, int]]:
    """A written table, and counts of its rows taken while it is written."""
    seen = Observation()
    out = staged(df.observe(seen, *[c.alias(k) for k, c in counts.items()]), name)
    return out, seen.get


def subtree_totals(nodes: DataFrame, values: list[str]) -> DataFrame:
    """(id, values): for each node of a forest, the sums of `values` over its subtree. nodes: (id, parent, values as long); id and parent may be of any type
    that can be joined on and ordered; a root's parent is NULL.

    Tree contraction. A phase first compresses: a node with one child hands its place to that child, and pointer doubling over such nodes finds, for
    each, the first node below that has no or several children, with the sum of the values on the way. A chain is so contracted into the node at its end, in as many join
    rounds as the logarithm of its length. Then it rakes: nodes without children are final and add their sums to their parents, aggregated before the shuffle. After a
    compression every inner node has two children or more, so a rake removes over half of the nodes: phases grow with the logarithm of the nodes, whatever the depth.
    Contracted nodes are then expanded from the last phase to the first: a node's total is its sum plus that of the node that its chain ended in.
    """
    own, up = [f"own_{v}" for v in values], [f"up_{v}" for v in values]
    # own_*: sums collected in a node. up_*: what chains between a node and its parent add to the parent.
    zero = F.lit(0).cast("long")
    tree, seen = _counted(nodes.select("id", "parent", *[F.col(v).cast("long").alias(o) for v, o in zip(values, own)], *[zero.alias(u) for u in up]), "tree", n=F.count(F.lit(1)))
    chains, finals = [], []
    while seen["n"]:
        kids = tree.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("kids"), F.min("id").alias("kid"), *[F.sum(u).alias(f"kid_{u}") for u in up])
        tree, seen = _counted(tree.join(kids, "id", "left").withColumn("kids", F.coalesce("kids", zero)), "kids", single=F.count_if(F.col("kids") == 1))
        rest = tree.where("kids <> 1")
        if seen["single"]:
            single = tree.where("kids = 1")
            # The way from a node down to, but without, the node `below`, in steps and with the sums on it.
            way = single.select("id", F.col("kid").alias("below"), F.lit(1).cast("long").alias("steps"), *[(F.col(o) + F.col(f"kid_{u}")).alias(v) for v, o, u in zip(values, own, up)])
            while seen.get("moved", 1):
                further = way.select(F.col("id").alias("below"), F.col("below").alias("next"), F.col("steps").alias("next_steps"), *[F.col(v).alias(f"next_{v}") for v in values])
                longer = way.join(further, "below", "left").select("id", F.coalesce("next", "below").alias("below"), (F.col("steps") + F.coalesce("next_steps", zero)).alias("steps"),
                                                                   *[(F.col(v) + F.coalesce(f"next_{v}", zero)).alias(v) for v in values], F.col("next").isNotNull().alias("moved"))
                way, seen = _counted(longer, "chain", moved=F.count_if("moved"))
                way = way.drop("moved")
            chains.append((len(finals), way))
            # The top of a chain is the node with the longest way; its place goes to the node at the end, with all that lies between.
            tops = way.groupBy("below").agg(F.max_by(F.struct("id", *values), "steps").alias("top")).select(F.col("below"), "top.*")
            tops = tops.join(single.select("id", F.col("parent").alias("top_parent"), *[F.col(u).alias(f"top_{u}") for u in up]), "id")
            tops = tops.select(F.col("below").alias("id"), F.lit(True).alias("moved"), "top_parent", *[(F.col(v) + F.col(f"top_{u}")).alias(f"way_{u}") for v, u in zip(values, up)])
            rest = rest.join(tops, "id", "left")
            rest = rest.select("id", F.when(F.col("moved"), F.col("top_parent")).otherwise(F.col("parent")).alias("parent"), "kids", *own, *[F.coalesce(f"way_{u}", u).alias(u) for u in up])
        rest = staged(rest.select("id", "parent", "kids", *own, *up), "rest")
        leaves = rest.where("kids = 0")
        finals.append(leaves.select("id", *[F.col(o).alias(v) for v, o in zip(values, own)]))
        given = leaves.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(*[F.sum(F.col(o) + F.col(u)).alias(f"add_{o}") for o, u in zip(own, up)])
        left = rest.where("kids > 1").join(given, "id", "left")
        tree, seen = _counted(left.select("id", "parent", *[(F.col(o) + F.coalesce(f"add_{o}", zero)).alias(o) for o in own], *up), "tree", n=F.count(F.lit(1)))
    totals = None
    for phase in reversed(range(len(finals))):
        totals = finals[phase] if totals is None else totals.unionByName(finals[phase])
        for at, way in chains:
            if at == phase:
                ends = totals.select(F.col("id").alias("below"), *[F.col(v).alias(f"end_{v}") for v in values])
                opened = way.join(ends, "below").select("id", *[(F.col(v) + F.col(f"end_{v}")).alias(v) for v in values])
                totals = staged(totals.unionByName(opened), "totals")
    return nodes.select("id", *values).limit(0) if totals is None else totals


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of rebuilt conversations (see `rebuilt`), a row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.

    A node is a distinct sequence of first turns (role, text); its members start with it. n_leaves counts childless nodes of its subtree, itself included; saved_tokens sums there, for
    each node, (n_convs - 1) times the UTF-8 bytes of its last text. The root has no text and no parent.

    Turns are sorted, NULL first; turns with equal numbers by a hash of role and text, the same in every run. NULL role or text counts as empty; rows repeated in full are turns of their own.
    Rows without conv_id belong to no conversation. Other columns are ignored, whatever their names. An empty table has no root and gives no rows. Sequences are told apart by 128-bit
    hashes; two nodes of one hash with different parents or bytes stop the job.
    """
    turns, convs = rebuilt(conversations)
    rows = staged(prefixes(turns), "rows")
    nodes = rows.groupBy("ka", "kb", "depth").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *[F.min(c).alias(c) for c in ("bytes", "pa", "pb")],
                                                  F.expr("max(pa) = min(pa) and max(pb) = min(pb) and max(bytes) = min(bytes)").alias("same"))
    nodes = nodes.withColumn("bytes", F.when(F.col("same"), F.col("bytes")).otherwise(F.raise_error(F.lit("two sequences share a hash"))))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.selectExpr("0L as ka", "0L as kb", "0L as depth", "conv_id", "n_convs", "0L as bytes", "cast(null as long) as pa", "cast(null as long) as pb")
    nodes = staged(nodes.select(*root.columns).unionByName(root), "nodes")
    above = nodes.select(F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("depth") + 1, F.col("conv_id").alias("parent_conv_id")).toDF("pa", "pb", "depth", "parent_conv_id")
    kids = nodes.where("depth > 0").groupBy(F.col("pa").alias("ka"), F.col("pb").alias("kb"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    full = nodes.join(above, ["pa", "pb", "depth"], "left").join(kids, ["ka", "kb", "depth"], "left")
    full = full.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "bytes", "ka", "kb")
    full = staged(full, "trie")
    weighed = full.select(F.struct(F.col("conv_id").alias("conv"), "depth").cast(_NODE).alias("id"),
                          F.when(F.col("depth") > 0, F.struct(F.col("parent_conv_id").alias("conv"), (F.col("depth") - 1).alias("depth")).cast(_NODE)).alias("parent"),
                          F.expr("if(n_children = 0, 1L, 0L)").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"))
    totals = subtree_totals(weighed, ["n_leaves", "saved_tokens"]).select(F.col("id.conv").alias("conv_id"), F.col("id.depth").alias("depth"), "n_leaves", "saved_tokens")
    last = rows.join(convs, "conv_id").where("depth = n_turns").select("ka", "kb", "depth", "conv_id")
    turnless = convs.where("n_turns = 0").select(F.lit(0).cast("long").alias("ka"), F.lit(0).cast("long").alias("kb"), F.lit(0).cast("long").alias("depth"), "conv_id")
    ends = id_digests(last.unionByName(turnless), ["ka", "kb", "depth"])
    done = same_keys_join(full, ends, ["ka", "kb", "depth"], "left").join(totals, ["conv_id", "depth"])
    return done.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                       F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
