"""The prefix trie of all conversations, from vertical bitmaps.

Conversations are dealt in ranges of ids to shards of bounded size.  A shard
numbers its conversations by id and indexes (position, turn) to the bitset of the
conversations that hold this turn there.  Depth first, a node's bitset is
intersected with the postings of the next position: what is left is a child, its
popcount the members, its lowest bit the smallest member, and the intersection
with the conversations of exactly this length the end list.

Nodes of different shards that stand for the same turns meet by a 128-bit digest
of these turns.  Counts add up.  What must count a shared node once (texts,
leaves) is first summed per shard as if all its nodes were its own; then every
shared node's surplus is taken off again along the path to the root, in the shard
that holds its smallest member.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairband.llm.common import python_workers, written

SHARD_TURNS = 1 << 13  # turns in a shard, and so bits in a bitset; one family of conversations may be longer
ROOT = b"\0" * 16

LOCAL = ("shard long, node binary, parent binary, depth long, conv_id long, n_convs long, text_bytes long, "
         "total_bytes long, once_bytes long, leaves long, childless int, ends string")


class Shard:
    """Vertical bitmaps over some conversations in ascending order of their ids."""

    def __init__(self, conversations: list[tuple[int, list[bytes], list[int]]]):
        self.conversations = conversations
        self.everyone = (1 << len(conversations)) - 1
        self.postings: list[dict[bytes, int]] = []  # position -> turn -> bitset
        self.ending: dict[int, int] = {}  # length -> bitset
        for i, (_, turns, _) in enumerate(conversations):
            bit = 1 << i
            self.ending[len(turns)] = self.ending.get(len(turns), 0) | bit
            while len(self.postings) < len(turns):
                self.postings.append({})
            for posting, turn in zip(self.postings, turns):
                posting[turn] = posting.get(turn, 0) | bit

    def members(self, bits: int) -> list[int]:
        """The conversation ids of a bitset, ascending."""
        raw = np.frombuffer(bits.to_bytes(bits.bit_length() // 8 + 1, "little"), np.uint8)
        return [self.conversations[i][0] for i in np.flatnonzero(np.unpackbits(raw, bitorder="little")).tolist()]

    def walk(self) -> list[list]:
        """Nodes depth first, parents before children: fields of ``LOCAL`` without the shard."""
        nodes, stack = [], [(self.everyone, ROOT, b"", -1, 0, 0)]
        above = []  # row of the parent
        while stack:
            bits, node, parent, up, depth, size = stack.pop()
            ends = bits & self.ending.get(depth, 0)
            first = (bits & -bits).bit_length() - 1
            count = bits.bit_count()
            rest = bits ^ ends
            here = len(nodes)
            nodes.append([node, parent, depth, self.conversations[first][0], count, size, count * size, size, int(not rest), int(not rest),
                          ",".join(map(str, self.members(ends))) if ends else None])
            above.append(up)
            while rest:
                i = (rest & -rest).bit_length() - 1
                _, turns, sizes = self.conversations[i]
                child = rest & self.postings[depth][turns[depth]]
                rest ^= child
                stack.append((child, hashlib.md5(node + turns[depth], usedforsecurity=False).digest(), node, here, depth + 1, sizes[depth]))
        for here in range(len(nodes) - 1, 0, -1):
            mine, up = nodes[here], nodes[above[here]]
            up[6] += mine[6]
            up[7] += mine[7]
            up[8] += mine[8]
        return nodes


def rebuilt(family: dict[int, tuple[list, list]], base: int, heads: dict[int, int]) -> Iterator[tuple[int, list, list]]:
    """Each conversation of a family with the first ``head`` turns of the base in place of its own first ``head``."""
    turns, sizes = family.get(base, ([], []))
    for conv_id in sorted(family):
        own, lengths = family[conv_id]
        h = heads[conv_id]
        yield conv_id, turns[:h] + own[h:], sizes[:h] + lengths[h:]


def turn_table(conversations: DataFrame, family: Column, head: Column, conv_col: str = "conv_id", turn_col: str = "turn",
               role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A slim row per turn: texts and roles become a digest and a size, and go no further."""
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    return conversations.filter(F.col(conv_col).isNotNull()).select(
        family.cast("long").alias("family"), F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"),
        F.unhex(digest).alias("digest"), F.octet_length(text).cast("long").alias("bytes"), head.cast("int").alias("head"))


def local_tries(turns: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of every shard's own trie (``LOCAL``); a shard is named by its first family."""

    def families(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[int, dict, dict]]:
        at, family, heads = None, {}, {}
        for batch in batches:
            columns = [batch[c].tolist() for c in ("family", "conv", "digest", "bytes", "head")]
            for base, conv, digest, size, head in zip(*columns):
                if base != at:
                    if family:
                        yield at, family, heads
                    at, family, heads = base, {}, {}
                if conv not in family:
                    family[conv], heads[conv] = ([], []), head
                family[conv][0].append(bytes(digest))
                family[conv][1].append(size)
        if family:
            yield at, family, heads

    def tries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [field.split()[0] for field in LOCAL.split(", ")]
        held, size, shard = [], 0, 0
        for base, family, heads in families(batches):
            if not held:
                shard = base
            held += rebuilt(family, base, heads)
            size += sum(len(own) for own, _ in family.values()) + len(family)
            if size >= shard_turns:
                yield pd.DataFrame([[shard, *n] for n in Shard(held).walk()], columns=names)
                held, size = [], 0
        if held:
            yield pd.DataFrame([[shard, *n] for n in Shard(held).walk()], columns=names)

    order = ["family", "conv", F.col("turn").asc_nulls_first(), "digest", "bytes"]
    return turns.repartitionByRange("family").sortWithinPartitions(*order).mapInPandas(tries, LOCAL)


def surplus(shared: DataFrame) -> DataFrame:
    """Per node what its shards counted too often below it: ``node``, ``more_bytes``, ``more_leaves``.

    ``shared`` holds the local copies of nodes that several shards have, with the
    surplus of the node itself (``own_bytes``, ``own_leaves``) in the shard of its smallest
    member and zero elsewhere.  A node's ancestors are in the same shard, so each
    shard adds up along its own paths.
    """

    def along_paths(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("depth", ascending=False, kind="stable")
        sums = {n: [b, l] for n, b, l in zip(group["node"], group["own_bytes"].tolist(), group["own_leaves"].tolist())}
        for node, parent in zip(group["node"], group["parent"]):
            if parent in sums:
                sums[parent][0] += sums[node][0]
                sums[parent][1] += sums[node][1]
        return pd.DataFrame([(n, b, l) for n, (b, l) in sums.items() if b or l], columns=["node", "more_bytes", "more_leaves"])

    each = shared.select("shard", "node", "parent", "depth", "own_bytes", "own_leaves").groupBy("shard").applyInPandas(
        along_paths, "node binary, more_bytes long, more_leaves long")
    return each.groupBy("node").agg(F.sum("more_bytes").alias("more_bytes"), F.sum("more_leaves").alias("more_leaves"))


def joined_digests(ends: DataFrame) -> DataFrame:
    """``node``, ``ends_sha256`` of lists that several shards hold a part of, hashed as they stream by in id order."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, None
        for batch in batches:
            done = []
            for node, part in zip(batch["node"], batch["ends"]):
                if node != at:
                    if at is not None:
                        done.append((at, state.hexdigest()))
                    at, state = node, hashlib.sha256(part.encode())
                else:
                    state.update(b"," + part.encode())
            if done:
                yield pd.DataFrame(done, columns=["node", "ends_sha256"])
        if at is not None:
            yield pd.DataFrame([(at, state.hexdigest())], columns=["node", "ends_sha256"])

    return (ends.select("node", "conv_id", "ends").repartition("node").sortWithinPartitions("node", "conv_id")
            .mapInPandas(hashed, "node binary, ends_sha256 string"))


def prefix_trie(turns: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """A row per node of the trie of all conversations in ``turns`` (see ``turn_table``).

    A conversation of a family starts with the first ``head`` turns of the
    conversation that has the family's number (all if it has fewer, none if it is absent), then come its own turns
    after its first ``head``.  ``family`` must not fall as ``conv`` grows.  Each
    distinct sequence of first ``depth`` turns is a node, from the root (depth 0, which stands
    for no turn); members are the conversations that start with it, also those without turns.

    Returns ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``,
    ``n_children``, ``n_leaves`` (childless nodes in the subtree, itself included), ``saved_tokens`` (over the subtree,
    bytes of a node's last text times members but one), ``ends_sha256`` (decimal ids of the members of
    exactly this length, ascending, joined by commas) and ``subtree_bytes`` (distinct texts of the subtree).

    Null roles and texts are empty; a null turn comes first; turns of one number
    are ordered by the digest of role and text, so repeated rows are repeated turns and reruns agree; rows
    without conversation id take no part.  Without conversations there are no rows.  Texts of
    any length are digested where they are read.  A conversation is one path and is walked in one task
    (some 60 bytes a turn); a turn or a conversation that very many share
    costs each shard one node.  Other columns are not read.
    """
    python_workers(turns.sparkSession)
    local = written(local_tries(turns, shard_turns), "trie-nodes")
    merged = local.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.first("parent").alias("parent"), F.first("depth").alias("depth"),
        F.sum("n_convs").alias("n_convs"), F.first("text_bytes").alias("text_bytes"), F.sum("total_bytes").alias("total_bytes"),
        F.sum("once_bytes").alias("once_bytes"), F.sum("leaves").alias("leaves"), F.min("childless").alias("childless"),
        F.sum("childless").alias("claimed"), F.count("*").alias("shards"),
        F.count("ends").alias("end_lists"), F.max("ends").alias("ends"))
    merged = written(merged, "trie-merged")
    several = merged.filter("shards > 1").select(
        "node", F.col("conv_id").alias("smallest"), ((F.col("shards") - 1) * F.col("text_bytes")).alias("extra_bytes"),
        (F.col("claimed") - F.col("childless")).alias("extra_leaves"), "end_lists")
    copies = local.join(several, "node")
    own = F.col("conv_id") == F.col("smallest")
    more = surplus(copies.withColumns({"own_bytes": F.when(own, F.col("extra_bytes")).otherwise(0).cast("long"),
                                       "own_leaves": F.when(own, F.col("extra_leaves")).otherwise(0).cast("long")}))
    lists = joined_digests(copies.filter("end_lists > 1 and ends is not null"))
    children = merged.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    parents = merged.filter("childless = 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    zero = F.lit(0).cast("long")
    return (merged.join(more, "node", "left").join(lists, "node", "left").join(children, "node", "left").join(parents, "parent", "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
                    (F.col("leaves") - F.coalesce("more_leaves", zero)).alias("n_leaves"),
                    (F.col("total_bytes") - F.col("once_bytes") + F.coalesce("more_bytes", zero)).alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.sha2(F.coalesce("ends", F.lit("")), 256)).alias("ends_sha256"),
                    (F.col("once_bytes") - F.coalesce("more_bytes", zero)).alias("subtree_bytes")))


# crc32 of the decimal id, a bit at a time; the rest follows the definition
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, i: xor(r >> 1, 3988292384::BIGINT * (r & 1)))), 4294967295::BIGINT)"""
QUERY_SQL = f"""
WITH own AS (
  SELECT conv_id, coalesce(text, '') AS text, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
      md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
heads AS (SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC.format("conv_id")} % 9 AS head FROM (SELECT DISTINCT conv_id FROM own)),
turns AS (
  SELECT h.conv_id, 0 AS part, o.place, o.digest, strlen(o.text) AS size FROM heads h JOIN own o ON o.conv_id = h.base AND o.place <= h.head
  UNION ALL
  SELECT h.conv_id, 1, o.place, o.digest, strlen(o.text) FROM heads h JOIN own o ON o.conv_id = h.conv_id AND o.place > h.head),
paths AS (
  SELECT conv_id, size, row_number() OVER w AS depth, count(*) OVER (PARTITION BY conv_id) AS turns, md5(string_agg(digest, ',') OVER w) AS node
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY part, place)
  UNION ALL
  SELECT h.conv_id, 0, 0, (SELECT count(*) FROM turns t WHERE t.conv_id = h.conv_id), '' FROM heads h),
nodes AS (
  SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size, max(turns) > depth AS inner_node,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE turns = depth), '')) AS ends_sha256
  FROM paths GROUP BY depth, node),
subtrees AS (
  SELECT p.depth, p.node, sum((u.n_convs - 1) * u.size) AS saved_tokens, count(*) FILTER (WHERE NOT u.inner_node) AS n_leaves, sum(u.size) AS subtree_bytes
  FROM nodes u JOIN paths p ON p.conv_id = u.conv_id AND p.depth <= u.depth GROUP BY p.depth, p.node),
links AS (
  SELECT c.depth, c.node, u.conv_id AS parent_conv_id, u.node AS parent FROM nodes c
  JOIN paths p ON p.conv_id = c.conv_id AND p.depth = c.depth - 1 JOIN nodes u ON u.depth = p.depth AND u.node = p.node)
SELECT n.conv_id, n.depth, l.parent_conv_id, n.n_convs,
  (SELECT count(*) FROM links k WHERE k.depth = n.depth + 1 AND k.parent = n.node) AS n_children,
  s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256, s.subtree_bytes::BIGINT AS subtree_bytes
FROM nodes n JOIN subtrees s USING (depth, node) LEFT JOIN links l USING (depth, node)
"""
