"""Alignment of two tokenizers over the same texts (operator 12).

Both tokenizers end tokens at byte offsets of the same text; where both end one, a group of tokens ends, and the tokens of
a group are linked with each other. A task works on Arrow tables of many documents at a time: lists of ids are
flattened, with the index of their parent; ends are cumulative sums of token lengths within each parent; a hash join on
parent and end finds the shared ends; a group_by gives the links of each id pair. The number of documents that
hold an id pair is counted in each task and summed up by Spark.

Both tokenizers are certain to cut between a character that is no white space and ASCII white space, so a text
falls into units (white space and the word after it) whose alignments stand on their own. A task aligns each unit once
and puts documents together from their units, in Arrow again. Texts in which that is not certain are aligned whole.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import met, small_batches, text_of, written

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of units that are encoded in one call at most, and characters of documents that are put together at a time.
ENCODED, SLICE = 1 << 18, 1 << 20
#: Units in a generation of a worker's recent units; two are kept.
UNITS = 120_000
#: Id pairs whose document counts a task holds before it passes them on.
COUNTED = 500_000
#: Blanks and line ends and the word after them; alone at the end of a text. In front of them cuts are certain.
UNIT = re.compile(r"[ \t-\f]+[^ \t-\f]*")
#: What some tables take for white space and others do not, or a tokenizer for a blank, or that stands behind others in a
#: piece: texts with it stay whole.
ODD = re.compile("[" + r"\r\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u2581\u3000\ufeff" + "]")


def byte_level() -> dict[str, int]:
    """The byte that each printable character of a byte-level vocabulary stands for."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Side:
    """A tokenizer as tables: the bytes, their number and the decimal id of each token."""

    def __init__(self, tokens: list[bytes]):
        self.bytes, self.lengths = pa.array(tokens, pa.binary()), pa.array(list(map(len, tokens)), pa.int64())
        self.decimal = pa.array(map(str, range(len(tokens))), pa.string())

    def joined(self, ids: np.ndarray) -> bytes:
        taken = self.bytes.take(pa.array(ids))
        return taken.buffers()[2].to_pybytes()[: np.frombuffer(taken.buffers()[1], "i4")[len(ids)]] if len(ids) else b""


class ByteSide(Side):
    """A byte-level BPE file of the tokenizers library. Special tokens' strings in a text are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, of = Tokenizer.from_file(path), byte_level()
        self.library.encode_special_tokens = True
        self.library.no_truncation()
        self.library.no_padding()
        vocabulary = self.library.get_vocab()
        tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            tokens[i] = bytes(map(of.__getitem__, token)) if all(c in of for c in token) else token.encode()
        super().__init__(tokens)

    def encode(self, text: str) -> list[int]:
        """Ids of a text that begins with its own blank."""
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids


class PieceSide(Side):
    """A sentencepiece model that puts a blank before a text, with single bytes for what it has no piece for."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        super().__init__([bytes([int(p[3:5], 16)]) if self.library.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        #: Whether white space stands behind another character in no piece, so that a cut before it is certain.
        self.certain = not any(re.search(r"[^ \t-\f][ \t-\f]", t.decode()) for i, t in enumerate(self.bytes.to_pylist()) if not self.library.is_byte(i))

    def encode(self, text: str) -> list[int]:
        """Ids of a text that begins with the blank that the model puts there."""
        return self.library.encode(text[1:], num_threads=1)


def flat(lists: pa.ListArray, side: Side) -> pa.Table:
    """of (parent), end (byte offset within the parent), id, at (position) of each token."""
    ids, of = pc.list_flatten(lists), pc.list_parent_indices(lists).cast(pa.int64())
    ends = pc.cumulative_sum(side.lengths.take(ids))
    before = np.concatenate([[0], np.asarray(ends)])[np.asarray(lists.offsets)[:-1]]
    return pa.table({"of": of, "end": pc.subtract(ends, pa.array(before, pa.int64()).take(of)), "id": ids, "at": pa.array(np.arange(len(ids)))})


def aligned(a: pa.ListArray, b: pa.ListArray, left: Side, right: Side) -> tuple[pa.Table, np.ndarray, pa.Array]:
    """(of, a, b, n): links of id pairs of each parent; groups of each parent; its groups as a string.

    a and b are the ids of the same texts, none of which is empty, so every parent's last ends are shared.
    """
    sides = [flat(a, left), flat(b, right)]
    ends = sides[0].select(["of", "end", "at"]).join(sides[1].select(["of", "end", "at"]), ["of", "end"], join_type="inner", right_suffix="_b", use_threads=False)
    groups, texts = len(ends), []
    for i, (table, name, side) in enumerate(zip(sides, ("at", "at_b"), (left, right))):
        last = np.zeros(len(table), np.int64)
        last[np.asarray(ends[name])] = 1
        bounds = pa.array(np.concatenate([[0], np.flatnonzero(last) + 1]), pa.int32())
        texts.append(pc.binary_join(pa.ListArray.from_arrays(bounds, side.decimal.take(table["id"].combine_chunks())), ","))
        of = pa.array(np.cumsum(last) - last)
        sides[i] = pa.table({"of": table["of"], "group": of, "id": table["id"]}).group_by(["of", "group", "id"], use_threads=False).aggregate([([], "count_all")])
    linked = sides[0].join(sides[1].drop_columns("of"), "group", join_type="inner", right_suffix="_b", use_threads=False)
    linked = linked.append_column("n", pc.multiply(linked["count_all"], linked["count_all_b"]))
    linked = linked.group_by(["of", "id", "id_b"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["of", "a", "b", "n"])
    each = np.bincount(np.asarray(ends["of"]), minlength=len(a))
    bounds = pa.array(np.concatenate([[0], np.cumsum(each)]), pa.int32())
    return linked, each, pc.binary_join(pa.ListArray.from_arrays(bounds, pc.binary_join_element_wise(*texts, "|")), ";") if groups else pa.array([""] * len(a))


class Units:
    """What became of recent units: (tokens of A, of B, groups, text of the groups, id pairs and links), or None for one whose bytes differ."""

    def __init__(self, a: str, b: str):
        self.a, self.b, self.young, self.old = ByteSide(a), PieceSide(b), {}, {}

    def ids(self, side: Side, text: str, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of text and how many each unit has, by the byte offsets where units end; None if the tokens' bytes are not the text's."""
        ids = np.array(side.encode(text), np.int32)
        if side.joined(ids) != text.encode():
            return None
        at = np.searchsorted(np.cumsum(np.asarray(side.lengths)[ids]), ends) + 1
        return ids, np.diff(at, prepend=0)

    def encoded(self, units: list[str]) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray]], list[tuple[np.ndarray, np.ndarray]]]:
        """units whose bytes both sides keep, and their ids; units are joined where cuts between them are certain."""
        kept, a, b = [], [], []
        parts, size = [[]], 0
        for u in units:
            if parts[-1] and size + len(u) > ENCODED:
                parts, size = [*parts, []], 0
            parts[-1].append(u)
            size += len(u)
        for part in filter(None, parts):
            self._encoded(part, kept, a, b)
        return kept, a, b

    def _encoded(self, part: list[str], kept: list, a: list, b: list) -> None:
        # B's own blank has to be the text's first character, so a word goes before what begins otherwise
        lead = [] if part[0][0] == " " else [" ."]
        text, ends = "".join([*lead, *part]), np.cumsum([len(u.encode()) for u in [*lead, *part]])
        found = [self.ids(side, text, ends) for side in (self.a, self.b)]
        if lead:
            found = [x and (x[0][x[1][0] :], x[1][1:]) for x in found]
        if all(x is not None for x in found):
            kept += part
            a.append(found[0])
            b.append(found[1])
        elif len(part) > 1:
            for half in (part[: len(part) // 2], part[len(part) // 2 :]):
                self._encoded(half, kept, a, b)

    def make(self, units: list[str], alone: list[str]) -> dict[str, tuple | None]:
        """units may be joined to be encoded, what is alone may not."""
        made: dict[str, tuple | None] = dict.fromkeys([*units, *alone])
        kept, a, b = self.encoded(units)
        for u in alone:
            self._encoded([u], kept, a, b)
        if kept:
            each = [np.concatenate([x[1] for x in side]) for side in (a, b)]
            lists = [pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype("i4"), np.concatenate([x[0] for x in side])) for n, side in zip(each, (a, b))]
            links, groups, texts = aligned(*lists, self.a, self.b)
            links = links.sort_by([("of", "ascending")])
            bounds = (24 * np.searchsorted(np.asarray(links["of"]), np.arange(len(kept) + 1))).tolist()
            pairs = np.stack([np.asarray(links[c]).astype(np.int64) for c in ("a", "b", "n")], axis=1).tobytes()
            made.update(zip(kept, zip(each[0].tolist(), each[1].tolist(), groups.tolist(), texts.to_pylist(), (pairs[i:j] for i, j in zip(bounds, bounds[1:])))))
        return made

    def split(self, text: str) -> list[str] | None:
        """The units of a text that begins with a blank; None if it has to stay whole."""
        return None if not self.b.certain or ODD.search(text) else UNIT.findall(text)

    def documents(self, texts: list[str]) -> list[tuple[list[str], dict]]:
        """The units of each text, none for one without tokens, and a table of all units."""
        docs = [self.split(f" {t}") if t else [] for t in texts]
        young, old = self.young, self.old
        wanted = set().union(*(d for d in docs if d))
        table = {u: young[u] if u in young else old[u] for u in wanted if u in young or u in old}
        new = [u for u in wanted if u not in table]
        fresh = self.make([u for u in new if not u.isspace()], [u for u in new if u.isspace()])
        table |= fresh
        young |= {u: table[u] for u in wanted if u in fresh or u not in young}
        # a unit whose bytes are not kept: the bytes of the whole text decide
        lost = {u for u in wanted if table[u] is None}
        whole = [i for i, d in enumerate(docs) if d is None or lost and not lost.isdisjoint(d)]
        for i in whole:
            docs[i] = [f" {texts[i]}"]
        table |= self.make([], list({docs[i][0] for i in whole}))
        for i in whole:
            if table[docs[i][0]] is None:
                docs[i] = []
        if len(young) > UNITS:
            self.old, self.young = young, {}
        return docs, table


@lru_cache(maxsize=1)
def _units(a: str, b: str) -> Units:
    return Units(a, b)


def put_together(docs: list[list[str]], table: dict) -> tuple[list[np.ndarray], list[str], pa.Table]:
    """Per document: tokens of A and of B, groups; digest of its groups; (doc, a, b, n) of all documents in order."""
    number = {u: i for i, u in enumerate(set().union(*docs))}
    units = [table[u] for u in number]
    n = [len(d) for d in docs]
    lists = pa.ListArray.from_arrays(np.cumsum([0, *n], dtype="i4"), np.fromiter(map(number.__getitem__, chain.from_iterable(docs)), np.int64, sum(n)))
    doc, unit = np.asarray(pc.list_parent_indices(lists)).astype(np.int64), np.asarray(pc.list_flatten(lists))
    sums = [np.bincount(doc, np.array([u[k] for u in units], np.float64)[unit] if units else None, len(docs)).astype(np.int64) for k in range(3)]
    shown = {u: table[u][3] for u in number}.__getitem__
    digests = [hashlib.sha256(";".join(map(shown, d)).encode()).hexdigest() if d else "" for d in docs]
    pairs = np.frombuffer(b"".join([u[4] for u in units]), np.int64).reshape(-1, 3)
    held = pa.table({"unit": np.repeat(np.arange(len(units)), [len(u[4]) // 24 for u in units]), "a": pairs[:, 0], "b": pairs[:, 1], "n": pairs[:, 2]})
    used = pa.table({"doc": doc, "unit": unit}).group_by(["doc", "unit"], use_threads=False).aggregate([([], "count_all")])
    both = used.join(held, "unit", join_type="inner", use_threads=False)
    both = pa.table({"doc": both["doc"], "a": both["a"], "b": both["b"], "n": pc.multiply(both["n"], both["count_all"])})
    links = both.group_by(["doc", "a", "b"], use_threads=False).aggregate([("n", "sum")]).sort_by([("doc", "ascending")])
    return sums, digests, links.rename_columns(["doc", "a", "b", "n"])


ROWS = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<struct<a: int, b: int, n: long>>, counts array<struct<a: int, b: int, n: long>>"
PAIR = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())])


def _listed(table: pa.Table, bounds: np.ndarray) -> pa.ListArray:
    columns = [table[c].combine_chunks().cast(t) for c, t in zip("abn", (pa.int32(), pa.int32(), pa.int64()))]
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(PAIR)))


def tokens_linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str | None = None, b: str | None = None) -> DataFrame:
    """A written table: per document its row, counts, digest and linked id pairs; besides, rows that hold counts only (row null)."""
    a, b = a or public_tokenizers.path(A), b or public_tokenizers.path(B)
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, first, n, counts = _units(a, b), TaskContext.get().partitionId() << 40, 0, None
        names, kinds = zip(*((f.name, f.type) for f in SCHEMA))
        nothing = lambda k: [pa.nulls(k, t) for t in kinds]

        def passed_on() -> pa.RecordBatch:
            out = nothing(1)
            out[-1] = _listed(counts, np.array([0, len(counts)]))
            return pa.RecordBatch.from_arrays(out, list(names))

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            bounds = [0]
            size = 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= SLICE or i + 1 == len(texts):
                    bounds, size = [*bounds, i + 1], 0
            for i, j in zip(bounds, bounds[1:]):
                found, table = units.documents(texts[i:j])
                sums, digests, links = put_together(found, table)
                at = np.searchsorted(np.asarray(links["doc"]), np.arange(j - i + 1))
                each = np.concatenate([[0], np.cumsum(np.asarray(links["n"]))])[at]
                out = [pa.array(first + n + np.arange(j - i)), ids.slice(i, j - i), *map(pa.array, sums), pa.array(np.diff(each)), pa.array(digests), _listed(links, at), pa.nulls(j - i, kinds[-1])]
                yield pa.RecordBatch.from_arrays(out, list(names))
                n += j - i
                own = links.group_by(["a", "b"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["a", "b", "n"])
                counts = own if counts is None else pa.concat_tables([counts, own])
                if len(counts) > COUNTED:
                    counts = counts.group_by(["a", "b"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["a", "b", "n"])
                    if len(counts) > COUNTED // 2:
                        yield passed_on()
                        counts = None
        if counts is not None:
            counts = counts.group_by(["a", "b"], use_threads=False).aggregate([("n", "sum")]).rename_columns(["a", "b", "n"])
            yield passed_on()

    pairs = pa.list_(PAIR)
    SCHEMA = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("pairs", pairs), ("counts", pairs)])
    return written(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(docs, text_col).alias("text")).mapInArrow(work, ROWS))


def pair_counts(found: DataFrame) -> DataFrame:
    """(a, b, docs, best): documents that hold an id pair linked, and whether no pair of its A id has more; from tokens_linked."""
    counts = found.where("row is null").select(F.explode("counts").alias("c")).groupBy("c.a", "c.b").agg(F.sum("c.n").alias("docs"))
    return counts.withColumn("best", F.col("docs") == F.max("docs").over(Window.partitionBy("a")))


def alignment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a: str | None = None, b: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    a: a file of a byte-level BPE of the tokenizers library, b: a sentencepiece model; both encode a blank and the text.
    Null and empty texts have no tokens, nor have texts that either tokenizer does not give back byte by byte: zeros and
    an empty groups_sha256. Special tokens' strings are plain text. Repeated rows count once each; null ids take part;
    an empty table gives an empty result; texts are aligned whole; other columns are not read. The table of id pairs is
    broadcast if few; else those pairs that hold many rows are, so that none of them fills a task.
    """
    found = tokens_linked(docs, id_col, text_col, a, b)
    key = F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long"))
    counts = written(pair_counts(found).select(key.alias("pair"), "docs", "best", F.col("docs").alias("rows")), narrow=True)
    links = found.where("row is not null").select("row", F.explode("pairs").alias("x")).select("row", "x.*").select("row", key.alias("pair"), "n")
    sums = met(links, counts, "pair", "rows").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("docs")).alias("count_sum"))
    rows = found.where("row is not null").drop("pairs", "counts").join(sums, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def op12_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(spark.read.parquet(f"{sf_dir}/documents.parquet"))
