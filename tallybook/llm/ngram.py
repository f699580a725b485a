"""Interpolated modified Kneser-Ney bigram model (operator 5): counted in Spark, kept as sorted hash arrays in files that
the scoring workers map into memory.

Counting: tasks hash the words of their documents and count pairs (word before, word) in chunks. Each chunk's pairs go,
packed, to a shard by the word before; the pairs of words that would make up much of a shard are dealt by both words, so
that no shard holds one word's whole company. There are shards in proportion to the tokens, so more words count as
frequent as the corpus grows; if they become too many to be known to every task, all pairs are dealt by both words. A
shard adds up its pairs, writes them as one file of sorted pair hashes and
counts, and passes on for each word how often it occurs, after how many different words, and how many different words
follow it once, twice or more often. A second grouping by word adds these up into the vocabulary files.

Scoring: p(w | h) = max(c(hw) - D(c(hw)), 0) / c(h) + back(h) * q(w), and q(w) likewise from the numbers of different
words before w, with the rest spread evenly over the vocabulary and one unknown word. D takes the usual three values,
from the numbers of pairs that occur one to four times. After a word that was never learned, p(w | h) = q(w).

The order is two: pairs alone already come to two fifths of the tokens, and triples to most of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import mapped, put, shared_dir, small_batches, text_of, uri, written

#: Tokens that a task counts at once.
CHUNK = 3_000_000
#: Tokens that fall to a shard, about.
SHARD = 1_000_000
#: One document in so many tells which words are frequent; that only deals out the work, no count depends on it.
LOOK = 64
#: A word's pairs are dealt by both words if it makes up more than this part of a shard.
HEAVY = 0.25
#: If more words than this do, all pairs are dealt by both words.
MOST_HEAVY = 20_000
#: Files that a worker has open at most. The one that was opened first is let go, with the copy that it may have needed.
OPEN = 256
#: No word holds white space.
START, END = xxh64_intdigest(b" start"), xxh64_intdigest(b" end")
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def hashes(text: str) -> np.ndarray:
    """64-bit hashes of a text's words, A-Z in lower case, and of the end."""
    words = text.encode().lower().split()
    words.append(b" end")
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def pair_hash(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = (before * M1) ^ (word * M2 + M1)
    x ^= x >> np.uint64(29)
    return x * M2


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """A shard from the upper half of each hash; in the order of the hashes."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def pair_shard(before: np.ndarray, word: np.ndarray, heavy: np.ndarray | None, shards: int) -> np.ndarray:
    """heavy: the words whose pairs are dealt by both words; None: all."""
    if heavy is None:
        return shard_of(pair_hash(before, word), shards)
    return shard_of(np.where(np.isin(before, heavy), pair_hash(before, word), before) if len(heavy) else before, shards)


def narrow(x: np.ndarray) -> bytes:
    """Counts in 1, 2, 4 or 8 bytes each, as the largest needs."""
    top = int(x.max()) if len(x) else 0
    return x.astype("<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8").tobytes()


def wide(data, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // n}" if n else "<u1")


def sums(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Sorted distinct keys, a place of each, and the sums of values by key."""
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    return key[first], order[first], [np.add.reduceat(v[order].astype(np.int64), first) if len(first) else np.zeros(0, np.int64) for v in values]


PAIRS = "shard int, before binary, runs binary, word binary, n binary"


def _count(heavy: np.ndarray | None, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def packed():
            word = np.concatenate(held)
            before = np.concatenate([[np.uint64(START)], word[:-1]])
            before[np.cumsum([0, *map(len, held[:-1])])] = START
            _, at, (n,) = sums(pair_hash(before, word), np.ones(len(word), np.uint8))
            before, word = before[at], word[at]
            shard = pair_shard(before, word, heavy, shards)
            order = np.argsort(before)
            order = order[np.argsort(shard[order], kind="stable")]
            before, word, n, shard = before[order], word[order], n[order], shard[order]
            for s in np.split(np.arange(len(shard)), np.flatnonzero(np.diff(shard)) + 1):
                b = before[s]
                first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
                runs = np.diff(np.append(first, len(b)))
                yield pa.RecordBatch.from_pydict({"shard": pa.array([int(shard[s[0]])], pa.int32()), "before": [b[first].tobytes()], "runs": [narrow(runs)], "word": [word[s].tobytes()], "n": [narrow(n[s])]})

        for batch in batches:
            for text in batch.column(0):
                held.append(hashes(text.as_py()))
                size += len(held[-1])
                if size >= CHUNK:
                    yield from packed()
                    held, size = [], 0
        if held:
            yield from packed()

    return run


SHARED = "shard int, kind string, h binary, a binary, b binary, c binary, totals array<long>"


def _add_up(folder: str, shards: int):
    """Of one shard's rows: the pair file, and for each word what this shard knows of it, by the word's own shard."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        cols = rows.to_pydict()
        first = [np.frombuffer(x, "<u8") for x in cols["before"]]
        before = np.concatenate([np.repeat(f, wide(r, len(f))) for f, r in zip(first, cols["runs"])])
        words = [np.frombuffer(x, "<u8") for x in cols["word"]]
        n = np.concatenate([wide(c, len(w)).astype(np.int64) for c, w in zip(cols["n"], words)])
        word = np.concatenate(words)
        key_, at, (n,) = sums(pair_hash(before, word), n)
        before, word = before[at], word[at]
        name = f"{folder}/pairs-{key[0].as_py():06d}"
        put(name, np.array([len(key_)], "<u8").tobytes() + key_.tobytes() + narrow(n))
        out = [(key[0].as_py(), "pairs", None, None, None, None, [int((n == i).sum()) for i in (1, 2, 3, 4)])]
        ones = np.ones(len(n), np.uint8)
        for kind, h, values in (("before", before, (n == 1, n == 2, n > 2)), ("word", word, (n, ones, ones))):
            h, _, got = sums(h, *values)
            shard = shard_of(h, shards)
            for s in np.split(np.arange(len(h)), np.flatnonzero(np.diff(shard)) + 1):
                out.append((int(shard[s[0]]), kind, h[s].tobytes(), *(narrow(x[s]) for x in got), None))
        names = [x.split()[0] for x in SHARED.split(", ")]
        return pa.table({c: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate(zip(names, [pa.int32(), pa.string(), *[pa.binary()] * 4, pa.list_(pa.int64())]))})

    return run


TOTALS = "kind string, totals array<long>"


def _vocabulary(folder: str):
    """Of one shard of words: the file of hashes, counts and numbers of neighbours. The totals of pairs are passed through."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        shard, cols = key[0].as_py(), rows.to_pydict()
        out = [("pairs", t) for k, t in zip(cols["kind"], cols["totals"]) if k == "pairs"]
        found = [(k, np.frombuffer(h, "<u8"), a, b, c) for k, h, a, b, c in zip(cols["kind"], cols["h"], cols["a"], cols["b"], cols["c"]) if k != "pairs"]
        if found:
            every = np.concatenate([f[1] for f in found])
            none = [np.zeros(len(f[1]), np.int64) for f in found]
            columns = []
            for kind, i in (("word", 2), ("word", 3), ("before", 2), ("before", 3), ("before", 4)):
                columns.append(np.concatenate([wide(f[i], len(f[1])).astype(np.int64) if f[0] == kind else z for f, z in zip(found, none)]))
            h, _, (n, types, n1, n2, n3) = sums(every, *columns)
            name = f"{folder}/words-{shard:06d}"
            parts = [narrow(x) for x in (n, types, n1, n2, n3)]
            put(name, np.array([len(h), *map(len, parts)], "<u8").tobytes() + h.tobytes() + b"".join(parts))
            out.append(("words", [int(n.sum()), int((n > 0).sum()), int(types.sum()), *(int((types == i).sum()) for i in (1, 2, 3, 4))]))
        return pa.table({"kind": [r[0] for r in out], "totals": pa.array([r[1] for r in out], pa.list_(pa.int64()))})

    return run


def discounts(n: list[int]) -> np.ndarray:
    """D for counts of 0, 1, 2 and more, from the numbers of types that occur one to four times."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3):
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *(min(max(x, 0.05), i) for i, x in enumerate(d, 1))])


@dataclass(frozen=True)
class Model:
    """Where the files are (a shard's are named by its number), and the totals over all of them."""

    folder: str
    shards: int
    heavy: tuple[int, ...] | None
    tokens: int
    words: int
    pair_types: int
    pair_counts: tuple[int, ...]
    type_counts: tuple[int, ...]


def train(docs: DataFrame, text_col: str = "text", size: int = SHARD, most_heavy: int = MOST_HEAVY) -> Model:
    """The model of the texts of docs; null and empty texts hold the end alone. Other columns are not read."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = uri(shared_dir(spark))
    texts = docs.select(text_of(docs, text_col).alias("text"))
    shards = max(1, round((texts.agg(F.sum(F.length("text") + 1)).first()[0] or 0) / 6 / size))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                h, n = np.unique(np.concatenate([hashes(t) for t in batch.text]), return_counts=True)
                keep = 2 * n * shards > HEAVY * n.sum()
                yield pd.DataFrame({"h": h[keep].view(np.int64), "n": n[keep], "of": np.where(np.arange(keep.sum()) == 0, n.sum(), 0)})

    seen = texts.where(F.pmod(F.xxhash64("text"), F.lit(LOOK)) == 0).mapInPandas(look, "h long, n long, of long")
    seen = written(seen.groupBy("h").agg(F.sum("n").alias("n"), F.sum("of").alias("of")))
    total = seen.agg(F.sum("of")).first()[0] or 0
    often = [r.h for r in seen.where(F.col("n") * shards > HEAVY * total).limit(most_heavy + 1).collect()]
    # every document has a first word, so the start is before as many pairs as there are documents
    often = sorted({*often, int(np.uint64(START).astype(np.int64))})
    heavy = np.array(often, np.int64).view(np.uint64) if len(often) <= most_heavy else None
    pairs = texts.mapInArrow(_count(heavy, shards), PAIRS)
    known = pairs.groupBy("shard").applyInArrow(_add_up(folder, shards), SHARED)
    files = written(known.groupBy("shard").applyInArrow(_vocabulary(folder), TOTALS))
    sums_of = {(r.kind, r.pos): r.n for r in files.select("kind", F.posexplode("totals").alias("pos", "n")).groupBy("kind", "pos").agg(F.sum("n").alias("n")).collect()}
    w, p = ([sums_of.get((kind, i), 0) for i in range(7)] for kind in ("words", "pairs"))
    return Model(folder, shards, None if heavy is None else tuple(heavy.tolist()), w[0], w[1], w[2], tuple(p[:4]), tuple(w[3:7]))


class Tables:
    """The mapped files of a model, in one worker."""

    def __init__(self, model: Model):
        self.model, self.heavy = model, None if model.heavy is None else np.array(model.heavy, np.uint64)
        self.open: dict[tuple[str, int], tuple] = {}
        self.d, self.d_types = discounts(model.pair_counts), discounts(model.type_counts)
        m = model.type_counts
        self.more = model.words - m[0] - m[1]
        rest = self.d_types[1] * m[0] + self.d_types[2] * m[1] + self.d_types[3] * self.more
        self.even = (rest / model.pair_types if model.pair_types else 1.0) / (model.words + 1)
        self.docs = int(self.words(np.array([END], np.uint64))[0][0]) if model.words else 0

    def file(self, kind: str, shard: int) -> tuple | None:
        if (kind, shard) not in self.open:
            data = mapped(f"{self.model.folder}/{kind}-{shard:06d}")
            if data is None:
                found = None
            elif kind == "pairs":
                n = int(data[:8].view("<u8")[0])
                found = (data[8 : 8 + 8 * n].view("<u8"), [wide(data[8 + 8 * n :], n)])
            else:
                n, *sizes = map(int, data[:48].view("<u8"))
                edges = 48 + 8 * n + np.cumsum([0, *sizes])
                found = (data[48 : 48 + 8 * n].view("<u8"), [wide(data[a:b], n) for a, b in zip(edges, edges[1:])])
            if len(self.open) >= OPEN:
                self.open.pop(next(iter(self.open)))
            self.open[kind, shard] = found
        return self.open[kind, shard]

    def look_up(self, kind: str, key: np.ndarray, shard: np.ndarray, width: int) -> list[np.ndarray]:
        """The values of each key, zero for keys that are not there; shard by shard, in the order of the keys."""
        out = [np.zeros(len(key), np.int64) for _ in range(width)]
        order = np.lexsort((key, shard))
        for s in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(order) else []:
            if (found := self.file(kind, int(shard[s[0]]))) is not None:
                keys, values = found
                i = np.minimum(np.searchsorted(keys, key[s]), len(keys) - 1)
                hit = keys[i] == key[s]
                for o, v in zip(out, values):
                    o[s[hit]] = v[i[hit]]
        return out

    def words(self, h: np.ndarray) -> list[np.ndarray]:
        """count, different words before; different words after that follow once, twice, more often."""
        return self.look_up("words", h, shard_of(h, self.model.shards), 5)

    def score(self, texts: list[str]) -> pd.DataFrame:
        """n_tokens, n_known, base_score, score of each text."""
        found = [hashes(t) for t in texts]
        first = np.cumsum([0, *map(len, found[:-1])])
        word = np.concatenate(found)
        before = np.concatenate([[np.uint64(START)], word[:-1]])
        before[first] = START
        h, at = np.unique(np.append(word, np.uint64(START)), return_inverse=True)
        count, types, n1, n2, n3 = self.words(h)
        at_word, at_before = at[:-1], np.concatenate([[at[-1]], at[:-2]])
        at_before[first] = at[-1]
        model, d = self.model, self.d
        q = np.maximum(types - self.d_types[np.minimum(types, 3)], 0) / max(1, model.pair_types) + self.even
        of = count.astype(float)
        of[at[-1]] = self.docs
        back = np.where(of > 0, (d[1] * n1 + d[2] * n2 + d[3] * n3) / np.maximum(of, 1), 1.0)
        key, pair_at, inverse = np.unique(pair_hash(before, word), return_index=True, return_inverse=True)
        (c,) = self.look_up("pairs", key, pair_shard(before[pair_at], word[pair_at], self.heavy, model.shards), 1)
        c = c[inverse]
        p = np.maximum(c - d[np.minimum(c, 3)], 0) / np.maximum(of[at_before], 1) + back[at_before] * q[at_word]
        base = np.log10((count + 1) / (model.tokens + (model.words + 1)))
        add = lambda x: np.add.reduceat(x, first)
        return pd.DataFrame({"n_tokens": [len(x) for x in found], "n_known": add((count[at_word] > 0).astype(np.int64)), "base_score": add(base[at_word]), "score": add(np.log10(p))})


@lru_cache(maxsize=1)
def tables(model: Model) -> Tables:
    return Tables(model)


def scored(docs: DataFrame, model: Model, keep: list[Column]) -> DataFrame:
    """keep, n_tokens, n_known, base_score, score of each text of docs, read whole. The columns kept can't be called text."""
    rows = docs.select(*keep, text_of(docs).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.iloc[i : i + 500].reset_index(drop=True)
                yield pd.concat([part.drop(columns="text"), tables(model).score(list(part.text))], axis=1)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInPandas(run, f"{kept}, n_tokens long, n_known long, base_score double, score double")


def held_out(doc_id: Column) -> Column:
    """The CRC-32 of the id as text leaves 2 by 7; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(True))


def language_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs (doc_id, text).

    The model learns from the rows that are not held out, repeats included. Null and empty texts hold the end alone.
    Without any row to learn from, every token has the probability of one unknown word, 1. An empty table gives an
    empty result. Other columns are not read.
    """
    model = train(docs.where(~held_out(F.col("doc_id"))))
    found = scored(docs, model, [F.col("doc_id"), held_out(F.col("doc_id")).alias("held_out")])
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op5_ngram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
