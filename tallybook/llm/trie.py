"""Prefix trie of conversations by fixed-length block hashing (operator 13).

Turns are hashed in blocks of BLOCK; a block's digest is chained to all turns before it, so conversations with the same
prefix have the same digests up to there. Conversations are grouped by the digests of whole blocks first. Where one block
alone follows a prefix, its turns have the members of the block. Only where several follow is each turn of these
blocks, once for every distinct block, told apart by its own digest.

Each node belongs to its smallest member. The nodes that a conversation owns are the end of its path, so sums over a
subtree are sums over the node's members: of all they own, except that the node's own member owns some of its path above
the node. Both need no walk along the tree; they are grouped sums with as many rows as there are blocks.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import met, small_batches, text_of, written

BLOCK = 4
#: A conversation takes its first turns from the first of FAMILY ids, up to MOST - 1 of them.
FAMILY, MOST = 5, 9
#: Rows of an Arrow batch that the tasks give back, and bytes of a piece of a list of ids.
ROWS, PIECE = 8192, 1 << 16
ROOT = bytes(16)
NONE = hashlib.sha256(b"").hexdigest()


def borrowed(conv_id: int) -> int:
    """Turns that a conversation takes from the first one of its family."""
    return zlib.crc32(str(conv_id).encode()) % MOST


def chained(before: bytes, turn: bytes) -> bytes:
    return hashlib.blake2b(before + turn, digest_size=16).digest()


def halves(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


BLOCKS = {
    "conv_id": pa.int64(), "depth": pa.int64(), "start": pa.list_(pa.int64()), "e1": pa.int64(), "e2": pa.int64(), "before": pa.int64(),
    "turns": pa.list_(pa.struct([("d1", pa.int64()), ("d2", pa.int64()), ("bytes", pa.int64())])), "last": pa.bool_(), "total": pa.int64(),
}
SCHEMA = "conv_id long, depth long, start array<long>, e1 long, e2 long, before long, turns array<struct<d1: long, d2: long, bytes: long>>, last boolean, total long"


class Path:
    """A rebuilt conversation, turn by turn; what it holds is one block."""

    def __init__(self, conv_id: int):
        self.conv_id, self.digest, self.start, self.turns, self.depth, self.before, self.total = conv_id, ROOT, ROOT, [], 0, 0, 0

    def row(self, last: bool) -> tuple:
        return self.conv_id, self.depth, halves(self.start), *halves(self.digest), self.before, self.turns, last, self.total

    def add(self, turn: bytes, size: int) -> tuple | None:
        """The block before, if this turn begins another one."""
        full = self.row(False) if len(self.turns) == BLOCK else None
        if full:
            self.depth, self.start, self.before, self.turns = self.depth + BLOCK, self.digest, self.total, []
        self.digest = chained(self.digest, turn)
        d1, d2 = halves(self.digest)
        self.turns.append({"d1": d1, "d2": d2, "bytes": size})
        self.total += size
        return full


def rebuilt(rows: Iterator[tuple[int, bytes, int]]) -> Iterator[tuple]:
    """Blocks of the rebuilt conversations, from (conv_id, turn digest, bytes) in the order of conversations and turns."""
    path, first, of, n, skip = None, [], None, 0, 0
    for conv_id, turn, size in rows:
        if path is None or conv_id != path.conv_id:
            if path:
                yield path.row(True)
            path, n, base = Path(conv_id), 0, conv_id - conv_id % FAMILY
            if base != of:
                of, first = base, []
            skip = 0 if conv_id == base else borrowed(conv_id)
            for t in first[:skip]:
                if full := path.add(*t):
                    yield full
        if conv_id == of and n < MOST - 1:
            first.append((turn, size))
        n += 1
        if n > skip and (full := path.add(turn, size)):
            yield full
    if path:
        yield path.row(True)


def blocks_of(turns: DataFrame) -> DataFrame:
    """A written table of the blocks of all rebuilt conversations; the last one of each has its length in bytes.

    Turns go to the tasks as digests, each family of conversations to one task, and are read there in order; a task holds the
    first turns of a family and a block.
    """
    role, text = text_of(turns, "role"), text_of(turns, "text")
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    family = F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(FAMILY))
    ordered = rows.withColumn("family", family).repartition("family").sortWithinPartitions("family", "conv_id", F.asc_nulls_first("turn"), "role", "digest")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3))))
        held = []
        for row in rebuilt(read):
            held.append(row)
            if len(held) >= ROWS:
                yield batched(held)
                held = []
        if held:
            yield batched(held)

    def batched(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), BLOCKS.values())], list(BLOCKS))

    return written(ordered.select("conv_id", "digest", "bytes").mapInArrow(work, SCHEMA))


def ends_of(convs: DataFrame) -> DataFrame:
    """(e1, e2, ends_sha256): digest of the ids of the conversations that end at a node, in order and joined by commas.

    Ids are sorted over all tasks, so that those of one node may lie in many; each task makes one text of its share, in
    pieces, and one task reads the pieces of a node in order.
    """
    ordered = convs.select("e1", "e2", "conv_id").repartitionByRange("e1", "e2", "conv_id").sortWithinPartitions("e1", "e2", "conv_id")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, node, ids, size, out = TaskContext.get().partitionId(), 0, None, [], 0, []
        for b in batches:
            for e1, e2, i in zip(*(c.to_pylist() for c in b.columns)):
                if ids and ((e1, e2) != node or size >= PIECE):
                    out.append((*node, part, seq, ",".join(ids)))
                    seq, ids, size = seq + 1, [], 0
                node = (e1, e2)
                ids.append(str(i))
                size += len(ids[-1]) + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["e1", "e2", "part", "seq", "ids"])
                out = []
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, part, seq, ",".join(ids))], ["e1", "e2", "part", "seq", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest, out = None, None, []
        for b in batches:
            for e1, e2, ids in zip(*(b.column(c).to_pylist() for c in ("e1", "e2", "ids"))):
                if (e1, e2) != node:
                    if node:
                        out.append((*node, digest.hexdigest()))
                    node, digest = (e1, e2), hashlib.sha256(ids.encode())
                else:
                    digest.update(f",{ids}".encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["e1", "e2", "ends_sha256"])
                out = []
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, digest.hexdigest())], ["e1", "e2", "ends_sha256"])

    pieces = ordered.mapInArrow(joined, "e1 long, e2 long, part long, seq long, ids string")
    return pieces.repartition("e1", "e2").sortWithinPartitions("e1", "e2", "part", "seq").mapInArrow(hashed, "e1 long, e2 long, ends_sha256 string")


def parts_of(blocks: DataFrame) -> DataFrame:
    """A written row per turn of each distinct block: the block (e1, e2), whether it is alone, its members and smallest one,
    the turn's node (d1, d2) and that of the turn before (p1, p2), its depth, bytes, and the bytes before it (above)."""
    groups = blocks.where(F.size("turns") > 0).groupBy("e1", "e2").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min(F.col("start")[0]).alias("s1"), F.min(F.col("start")[1]).alias("s2"))
    groups = written(groups, narrow=True)
    # of a prefix that one block follows, the least of each of its columns are that block's
    alone = groups.groupBy("s1", "s2").agg(F.count("*").alias("k"), F.min("e1").alias("e1"), F.min("e2").alias("e2")).where("k = 1").select("e1", "e2", F.lit(True).alias("alone"))
    told = groups.join(alone, ["e1", "e2"], "left").withColumn("alone", F.coalesce("alone", F.lit(False)))
    rows = told.join(blocks.select("conv_id", "depth", "turns", "before"), ["conv_id", "depth"])
    turn = F.posexplode(F.arrays_zip("turns", F.concat(F.array(F.struct(F.col("s1").alias("d1"), F.col("s2").alias("d2"), F.lit(0).cast("long").alias("bytes"))), F.slice("turns", 1, F.size("turns") - 1)).alias("up")))
    flat = rows.withColumn("above", F.transform("turns", lambda t, i: F.col("before") + F.aggregate(F.slice("turns", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x["bytes"])))
    flat = flat.select("e1", "e2", "alone", "n", "conv_id", "depth", "above", turn.alias("i", "t"))
    return written(
        flat.select(
            "e1", "e2", "alone", "n", "conv_id", F.col("t.turns.d1").alias("d1"), F.col("t.turns.d2").alias("d2"), F.col("t.up.d1").alias("p1"), F.col("t.up.d2").alias("p2"), (F.col("depth") + F.col("i") + 1).alias("depth"), F.col("t.turns.bytes").alias("bytes"), F.col("above")[F.col("i")].alias("above")
        ),
        narrow=True,
    )


def prefix_trie(turns: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations (conv_id, turn, role, text): conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation c takes the first h turns of the first id of its family of five (c less its remainder, which is not
    negative), h being the CRC-32 of its decimal id modulo 9, and goes on with its own turns after its first h. Turns come in
    ascending order, null first; turns that share a number by role, then by a digest of role and text, and repeated rows
    stay. Null roles and texts are empty ones. Rows without a conv_id take no part; no conversations, no nodes. Other
    columns are not read. Prefixes are told apart by 128 bits. A conversation's turns are chained in one task, as rows of
    a few numbers that are read as a stream; everything else is split, however many share a prefix.
    """
    small_batches(turns.sparkSession)
    blocks = blocks_of(turns)
    convs = blocks.where("last").select("conv_id", "e1", "e2", "total")
    parts = parts_of(blocks)
    least = [F.min(c).alias(c) for c in ("conv_id", "depth", "p1", "p2", "bytes", "above")]
    node = ["d1", "d2", "n", "conv_id", "depth", "p1", "p2", "bytes", "above"]
    open_turns = parts.where("not alone").groupBy("d1", "d2").agg(F.sum("n").alias("n"), *least)
    nodes = written(parts.where("alone").select(node).unionByName(open_turns.select(node)), narrow=True)
    children = nodes.groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(children, ["d1", "d2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), narrow=True)

    owned = nodes.groupBy("conv_id").agg(F.sum("bytes").alias("owned"), F.count_if(F.col("n_children") == 0).alias("leaves"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    convs = written(convs.join(owned, "conv_id", "left").select("conv_id", "e1", "e2", "total", zero("owned"), zero("leaves")), narrow=True)
    values = [F.sum(c).alias(c) for c in ("total", "owned", "leaves")]
    members = blocks.where(F.size("turns") > 0).select("conv_id", "e1", "e2").join(convs.select("conv_id", "total", "owned", "leaves"), "conv_id").groupBy("e1", "e2").agg(*values)
    summed = parts.select("e1", "e2", "alone", "d1", "d2").join(members, ["e1", "e2"])
    keys = ["d1", "d2", "total", "owned", "leaves"]
    summed = summed.where("alone").select(keys).unionByName(summed.where("not alone").groupBy("d1", "d2").agg(*values).select(keys))

    ends = ends_of(convs)
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.sum("total").alias("total"), F.sum("owned").alias("owned"), F.sum("leaves").alias("leaves")).first()
    if not top.n:
        none = F.lit(None).cast("long")
        return convs.limit(0).select("conv_id", *(none.alias(c) for c in ("depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), F.lit(NONE).alias("ends_sha256"))
    spark = turns.sparkSession
    of_root = nodes.where("depth = 1").count()
    root = [(0, 0, top.n, top.conv_id, 0, None, None, 0, 0, of_root, top.total, top.owned, max(1, top.leaves))]
    kinds = ", ".join(f"{c} long" for c in (*node, "n_children", "total", "owned", "leaves"))
    full = spark.createDataFrame(root, kinds).unionByName(nodes.join(summed, ["d1", "d2"]))

    own = convs.select("conv_id", F.col("total").alias("own_total"), F.col("owned").alias("own_owned"))
    full = full.join(own, "conv_id").join(ends.select(F.col("e1").alias("d1"), F.col("e2").alias("d2"), "ends_sha256"), ["d1", "d2"], "left")
    saved = (F.col("total") - F.col("n") * F.col("above")) - (F.col("owned") - F.col("own_owned") + F.col("own_total") - F.col("above"))
    out = full.select(
        "d1", "d2", "p1", "p2", "conv_id", "depth", F.col("n").alias("n_convs"), "n_children", F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256")
    )
    out = written(out)
    # a node's parent may have very many children
    name = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b")).alias("up")
    parents = out.where("n_children > 0").select(name("d1", "d2"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("rows"))
    below = met(out.where("depth > 0").select("*", name("p1", "p2")), parents, "up", "rows")
    rows = below.unionByName(out.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")), allowMissingColumns=True)
    return rows.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP13_SQL = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, CASE WHEN base = conv_id THEN 0 ELSE h END AS h, base FROM (
    SELECT conv_id, conv_id - ((conv_id % 5) + 5) % 5 AS base,
           xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda crc, b:
               list_reduce(range(8), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(crc, b)), 4294967295), 4294967295) % 9 AS h
    FROM (SELECT DISTINCT conv_id FROM turns))
), rebuilt AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY own, k) AS d FROM (
    SELECT c.conv_id, role, text, 0 AS own, k FROM convs c JOIN turns t ON t.conv_id = c.base AND k <= h
    UNION ALL SELECT c.conv_id, role, text, 1, k FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND k > h)
), paths AS (
  SELECT conv_id, d, strlen(text) AS size, list({'role': role, 'text': text}) OVER (PARTITION BY conv_id ORDER BY d) AS path FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, [] FROM convs
), nodes AS (
  SELECT md5(CAST(path AS VARCHAR)) AS node, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
         CASE WHEN d > 0 THEN md5(CAST(any_value(path[:-2]) AS VARCHAR)) END AS parent FROM paths GROUP BY path, d
), kids AS (SELECT parent, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
named AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN kids k ON k.parent = n.node),
under AS (
  SELECT md5(CAST(p.path AS VARCHAR)) AS node, sum(CAST(n_children = 0 AS BIGINT)) AS n_leaves, sum((n_convs - 1) * n.size) AS saved
  FROM named n JOIN paths p ON p.conv_id = n.conv_id AND p.d <= n.depth GROUP BY p.path
), ends AS (
  SELECT md5(CAST(path AS VARCHAR)) AS node, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends
  FROM (SELECT conv_id, path, d = max(d) OVER (PARTITION BY conv_id) AS final FROM paths) WHERE final GROUP BY path
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(u.n_leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM named n LEFT JOIN nodes p ON p.node = n.parent JOIN under u ON u.node = n.node LEFT JOIN ends e ON e.node = n.node
"""
