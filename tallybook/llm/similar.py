"""Texts with similar sets of five-word shingles: the links that the pipeline's near-duplicate stage adds to operator 4's.

Two sets with a Jaccard similarity of 4/5 or more share, in one order of all shingles, one of the first
n - ceil(4n/5) + 1 of each (n: its size). So only texts that share one of these keys are compared, and no pair is lost.
What meets is told apart by size, by the key's place and by sketches, none of which can lose a pair, and verified on the sets.

A key that many texts have is not paired out at once. Its texts are compared with one of them, and those of keys that very
many have with a few more. Only where a key's texts are in several groups after this are all pairs of texts in different
groups compared, in tiles that are spread over the tasks.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import PLACE, let_go, located, small, small_batches, text_of, whole, written
from .graph import components
from .simhash import SEED, fingerprints, links

WORDS = 5
#: Longs of a sketch: each shingle turns one of its bits over, so two sets differ in as many shingles as sketches in bits, or more.
SKETCH = 16
#: Shingles that so many of about so many sampled texts have come last in the order, by their number of texts. The order is
#: free; it only says how many texts meet by chance.
OFTEN, SAMPLED = 4, 4000
#: Texts of a key that more than HOT have are compared with about HUBS of them.
HOT, HUBS = 256, 16
#: Bytes of a batch of texts, whose shingles take many times as many.
PRINTED = 1 << 20
#: Texts of a key meet in tiles of about so many; each tile meets each.
TILE = 128


def shingle_set(text: str) -> np.ndarray:
    """The sorted hashes of a text's five-word shingles; fewer words are one shingle, and so are none."""
    found = text.encode().lower().split()
    shingles = [b" ".join(found)] if len(found) < WORDS else map(b" ".join, zip(*(found[i:] for i in range(WORDS))))
    return np.unique(np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], np.uint64))


def set_name(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.astype("<u8").tobytes(), SEED)).astype(np.int64))


def sketch(hashes: np.ndarray) -> np.ndarray:
    odd = np.bincount((hashes % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def wide_sketch(hashes: np.ndarray) -> bytes:
    """A sketch with about as many bits as the set has shingles, a power of two, as bytes; halves of a larger one fold to a smaller."""
    bits = 1 << min(16, max(10, (len(hashes) - 1).bit_length()))
    odd = np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def bits_apart(a: bytes, b: bytes) -> int:
    """Bits in which two wide sketches differ; sets differ in as many shingles, or more."""
    a, b = sorted((np.frombuffer(x, np.uint8) for x in (a, b)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def prefix(hashes: np.ndarray, often: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the order of rank (that of often, sorted; 0 for all others), then of the hash."""
    at = np.minimum(np.searchsorted(often, hashes), max(0, len(often) - 1))
    of = np.where(often[at] == hashes, rank[at], 0) if len(often) else np.zeros(len(hashes), np.int64)
    return hashes[np.argsort(of, kind="stable")][: len(hashes) - (4 * len(hashes) + 4) // 5 + 1]


def often_shared(docs: DataFrame, by: list[str], text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many of a bounded sample of texts have, sorted, and the number of these texts."""

    def shingles(batches):
        let_go()
        for batch in batches:
            for text in batch["text"]:
                yield pd.DataFrame({"h": shingle_set(text).view(np.int64)})

    part = max(1, docs.count() // SAMPLED)
    some = docs.where(F.pmod(F.xxhash64(*by), F.lit(part)) == 0).select(text_of(docs, text_col).alias("text"))
    found = some.mapInPandas(shingles, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN).toPandas()
    h, n = found["h"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def prints(text: Column, often: np.ndarray, rank: np.ndarray) -> Column:
    """Of a text's shingle set: node (its name), n (size), sketch, wide (sketch), keys (its first shingles)."""

    @F.pandas_udf("struct<node long, n int, sketch array<long>, wide binary, keys array<long>>")
    def of(texts: pd.Series) -> pd.DataFrame:
        let_go()
        out = []
        for t in texts:
            found = shingle_set(t)
            out.append((set_name(found), len(found), sketch(found), wide_sketch(found), prefix(found, often, rank).view(np.int64)))
        return pd.DataFrame(out, columns=["node", "n", "sketch", "wide", "keys"])

    return of(text)


def _sets(rows: DataFrame) -> DataFrame:
    """node and hashes of the sets of rows (text, asked) that have the name that is asked for.

    A function over rows, as a filter on what a function of columns gives would have each text tokenised once more, in
    a second Python worker for each task.
    """

    def run(batches):
        let_go()
        for batch in batches:
            found = [(asked, f) for asked, f in zip(batch["asked"], map(shingle_set, batch["text"])) if set_name(f) == asked]
            yield pd.DataFrame({"node": [asked for asked, _ in found], "hashes": [f.astype("<u8").tobytes() for _, f in found]})

    return rows.mapInPandas(run, "node long, hashes binary")


def _common(a: Column, b: Column) -> Column:
    @F.pandas_udf("int")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True)) for x, y in zip(a, b)], dtype="int32")

    return of(a, b)


def _apart(a: Column, b: Column) -> Column:
    @F.pandas_udf("int")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([bits_apart(x, y) for x, y in zip(a, b)], dtype="int32")

    return of(a, b)


def _needed(a: Column, b: Column) -> Column:
    """Shingles that sets of sizes a and b must share."""
    return F.floor((4 * (a + b) + 8) / 9)


def _may(u: str, v: str) -> Column:
    """Whether what stands from the shared key on can be enough; it is if that is the first one that they share."""
    n, pos = (lambda x: F.col(f"{x}.n")), (lambda x: F.col(f"{x}.pos"))
    return F.least(n(u) - pos(u), n(v) - pos(v)) >= _needed(n(u), n(v))


def _alike(u: str, v: str) -> Column:
    """Whether the sketches differ in few enough bits."""
    differ = reduce(Column.__add__, (F.bit_count(F.col(f"{u}.s{i}").bitwiseXOR(F.col(f"{v}.s{i}"))) for i in range(SKETCH)))
    return differ <= F.col(f"{u}.n") + F.col(f"{v}.n") - 2 * _needed(F.col(f"{u}.n"), F.col(f"{v}.n"))


def similar_sets(table: DataFrame, texts: DataFrame, at: list[str]) -> DataFrame:
    """(node, root) of the nodes that are linked with others.

    table (written): node, n, sketch, wide, keys and the columns at of each text; texts: at, text, of which only those are
    tokenised again that may have a partner.
    """
    bits = [f"s{i}" for i in range(SKETCH)]
    row = F.struct("n", "keys", "wide", *at, *(F.col("sketch")[i].alias(b) for i, b in enumerate(bits)))
    nodes = written(table.groupBy("node").agg(F.min_by(row, F.struct(*at)).alias("x")).select("node", "x.*"))
    keys = nodes.select(F.posexplode("keys").alias("pos", "key"), "node", "n")
    # counted with partial sums: a key that very many texts have is one row for each task; numbers alone are summed by hashing, without a sort
    shared = keys.groupBy("key").agg(F.count("*").alias("many"), F.min("node").alias("hub")).where("many > 1")
    met = written(keys.join(shared, "key"))

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of pairs (u, v: nodes) that are similar enough."""
        a, b = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("wide").alias(f"w{x}")) for x in "uv")
        near = pairs.distinct().join(a, "u").join(b, "v").select("u", "v", "nu", "nv", _apart(F.col("wu"), F.col("wv")).alias("apart"))
        pairs = written(near.where(F.col("apart") <= F.col("nu") + F.col("nv") - 2 * _needed(F.col("nu"), F.col("nv"))).select("u", "v"), narrow=True)
        used = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        places = nodes.join(used, "node").select(*at, F.col("node").alias("asked"))
        # what a place stands for may be several texts: only the sets that are asked for, once each
        held = written(_sets(texts.join(small(places), at).select("text", "asked")).dropDuplicates(["node"]))
        a, b = (held.select(F.col("node").alias(x), F.col("hashes").alias(f"h{x}")) for x in "uv")
        both = pairs.join(a, "u").join(b, "v").select("u", "v", (F.octet_length("hu") / 8 + F.octet_length("hv") / 8).alias("n"), _common(F.col("hu"), F.col("hv")).alias("same"))
        return both.where(9 * F.col("same") >= 4 * F.col("n")).select("u", "v")

    def near(met: DataFrame) -> DataFrame:
        """Links among the pairs a, b (node, n, pos) that share a key."""
        pairs = met.where("a.node != b.node").where(_may("a", "b"))
        pairs = pairs.select(F.greatest("a.node", "b.node").alias("u"), F.least("a.node", "b.node").alias("v")).distinct()
        a, b = (nodes.select(F.col("node").alias(x), F.struct("n", *bits).alias(f"x{x}")) for x in "uv")
        return verified(pairs.join(a, "u").join(b, "v").where(_alike("xu", "xv")).select("u", "v"))

    def still_open(links: DataFrame, rows: DataFrame) -> DataFrame:
        """rows with the node's root, of keys whose nodes are in several groups."""
        found = written(components(links), narrow=True).withColumnRenamed("root", "found")
        rows = written(rows.drop("root").join(found, "node", "left").withColumn("root", F.coalesce("found", "node")).drop("found"), narrow=True)
        keys = rows.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("key")
        return rows.join(keys, "key")

    hub = met.where("node = hub").select("key", F.struct("node", "n", "pos").alias("b"))
    links = written(near(met.select("key", F.struct("node", "n", "pos").alias("a")).join(hub, "key")), narrow=True)
    rest = still_open(links, met)
    hot = rest.where(F.col("many") > HOT)
    if hot.take(1):
        rest = written(rest, narrow=True)
        # each node under its hottest key, with some of that key's nodes; the key need not be the first that they share
        one = rest.where(F.col("many") > HOT).groupBy("node").agg(F.max(F.struct("many", "key", "n")).alias("k")).select("k.key", F.struct("node", "k.n", F.lit(0).alias("pos")).alias("a"))
        one = written(one, narrow=True)
        size = one.groupBy("key").agg(F.count("*").alias("size"))
        hubs = one.join(size, "key").where(F.pmod(F.xxhash64("a.node", F.lit(2)), "size") < HUBS).select("key", F.col("a").alias("b"))
        links = written(links.unionByName(near(one.join(hubs, "key"))), narrow=True)
        rest = still_open(links, rest)

    tiles = F.ceil(F.col("many") / TILE).cast("int")
    rest = rest.withColumns({"tiles": tiles, "tile": F.pmod(F.xxhash64("node", F.lit(1)), tiles).cast("int")}).join(nodes.select("node", *bits), "node")
    rest = written(rest.select("key", "tiles", "tile", F.struct("node", "root", "n", "pos", *bits).alias("x")))
    a = rest.select("key", F.col("tile").alias("i"), F.explode(F.sequence("tile", F.col("tiles") - 1)).alias("j"), F.col("x").alias("a"))
    b = rest.select("key", F.explode(F.sequence(F.lit(0), "tile")).alias("i"), F.col("tile").alias("j"), F.col("x").alias("b"))
    meet = ((F.col("i") < F.col("j")) | (F.col("a.node") > F.col("b.node"))) & (F.col("a.root") != F.col("b.root")) & _may("a", "b") & _alike("a", "b")
    pairs = a.join(b, ["key", "i", "j"]).where(meet).select(F.greatest("a.node", "b.node").alias("u"), F.least("a.node", "b.node").alias("v"))
    return components(links.unionByName(verified(pairs)))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, component_id (smallest doc_id reachable by links of similar texts, itself included).

    Links are all pairs of texts whose five-word shingles, A-Z in lower case, have a Jaccard similarity of 0.8 or more.
    Texts without words, nulls among them, are similar to each other. Documents without an id are left out. Documents
    with one set of shingles take part once, as do repeated rows. An empty table gives an empty result. Shingles and sets
    are told apart by 64-bit hashes.
    """
    small_batches(docs.sparkSession)
    given = docs.where(F.col(id_col).isNotNull())
    rows = given.select(F.col(id_col).alias("id"), prints(text_of(given, text_col), *often_shared(given, [id_col], text_col)).alias("p"))
    table = written(rows.select("id", "p.*"))
    roots = similar_sets(table, given.select(F.col(id_col).alias("id"), text_of(given, text_col).alias("text")), ["id"])
    named = written(table.select("id", "node").join(roots, "node", "left").select("id", F.coalesce("root", "node").alias("root")))
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    return named.join(least, "root").select(F.col("id").alias("doc_id"), "component_id")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The whole rows of docs with PLACE, and (PLACE, doc_id, root) of those that are in a group with others.

    Rows joined by links of close fingerprints (operator 4) or of similar texts, or both in turn, have the same root.
    Every row takes part, with an id or without. All prints are made in one pass over the texts.
    """
    small_batches(docs.sparkSession, PRINTED)
    docs = located(docs, whole(docs), F.col(f"`{id_col}`").alias("doc_id"), text_of(docs, text_col).alias("text"))
    text = F.col("text")
    found = prints(text, *often_shared(docs, PLACE, "text"))
    rows = docs.select(*PLACE, "doc_id", F.monotonically_increasing_id().alias("id"), fingerprints(text, 3).alias("fp"), found.alias("p"))
    table = written(rows.select(*PLACE, "doc_id", "id", "fp", "p.*"))
    texts = docs.select(*PLACE, "text")
    edges = []
    for name, linked in (("fp", components(links(table.select("fp").distinct()))), ("node", similar_sets(table, texts, PLACE))):
        first = table.groupBy(name).agg(F.min("id").alias("v"))
        copies = table.select("id", name).join(first, name).select(F.col("id").alias("u"), "v")
        linked = linked.select(F.col("node").alias(name), F.col("root").alias("to")).join(first.select(name, F.col("v").alias("u")), name)
        edges += [copies, linked.join(first.withColumnRenamed(name, "to"), "to").select("u", "v")]
    roots = written(components(reduce(DataFrame.unionByName, edges).where("u != v")), narrow=True)
    return docs.drop("doc_id", "text"), table.select(*PLACE, "doc_id", F.col("id").alias("node")).join(roots, "node").drop("node")
