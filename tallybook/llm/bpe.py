"""Byte-pair encoding and decoding by forced-boundary splitting (operator 1).

Two neighbouring symbols of a word that stand side by side inside no token of the vocabulary can never be merged over,
so the place between them is a certain cut. Each word is cut there, the fragments are encoded on their own with the
merge ranks, and their ids are put one after the other. The fragments of many new words lie side by side in numpy arrays,
and each step merges one pair of every fragment. Long words, and those beyond Latin letters, go one by one; fragments recur
far more often than words do, so a bounded cache per Python worker holds those of these words.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept, small_batches, text_of
from .words import WESTERN, RecentWords

#: Fragments that a worker's cache holds at most; it is emptied when full, which changes no result.
FRAGMENTS = 60_000
#: Words in a generation of a worker's recent words.
WORDS = 30_000
#: Characters from this one on are told apart by the library's own tables, whose age decides what they are.
LATIN_END = "\u0250"
#: Rows that a task encodes at a time.
SLICE = 500
#: New words that are merged side by side at most, and the bytes that each of them has at most.
TOGETHER, SHORT = 8192, 64
#: More than the rank of any merge.
NO_RANK = 1 << 30
VOCABULARY = "word_bpe_49k.json"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and certain cuts of a byte-level BPE file with word ends. Symbols are handled by their ids.

    The library is asked for the file's normal form of a word and, beyond Latin letters, for its pieces.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        library = Tokenizer.from_str(json.dumps({**spec, "added_tokens": [], "model": {**model, "vocab": {}, "merges": []}}))
        self.normal, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        end, ids = model["end_of_word_suffix"] or "", model["vocab"]
        self.special = {x["content"].encode(): x["id"] for x in spec["added_tokens"]}
        self.tokens = {i: t for t, i in [*ids.items(), *((k.decode(), i) for k, i in self.special.items())]}
        self.size = max(self.tokens) + 1
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.marks = regex.compile(b"(" + b"|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + b")")
        table = byte_symbols()
        self.byte_of = {c: b for b, c in enumerate(table)}
        self.plain, self.last = [ids[c] for c in table], [ids[c + end] for c in table]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        #: Rank of a pair of symbols, and the symbol that the merge of each rank makes.
        self.ranks = {ids[a] << 20 | ids[b]: i for i, (a, b) in enumerate(pairs)}
        self.made = [ids[a + b] for a, b in pairs]
        #: Pairs of single-byte symbols that stand side by side inside some token.
        self.inside = set()
        for token in ids:
            body = token.removesuffix(end) if end and token != end else token
            if len(body) > 1 and all(c in ids for c in body):
                symbols = [ids[c] for c in body]
                if body != token:
                    symbols[-1] = ids[body[-1] + end]
                self.inside.update(a << 20 | b for a, b in zip(symbols, symbols[1:]))
        self.fragments: dict[tuple[int, ...], list[int]] = {}
        self.recent = RecentWords(self.words, WORDS)
        # the same for arrays; a byte that ends its piece counts 256 more
        self.lines = regex.compile(rf"\n|{self.pieces.pattern}")
        self.symbols = np.array([*self.plain, *self.last])
        self.joined = np.array([[a << 20 | b in self.inside for b in (*self.plain, *self.last)] for a in self.plain])
        ranked = sorted(self.ranks)
        self.codes, self.rank = np.array([*ranked, 1 << 60]), np.array([*map(self.ranks.get, ranked), NO_RANK])
        self.merged = np.array(self.made)

    def cut(self, symbols: list[int]) -> Iterator[list[int]]:
        """The fragments between the certain cuts."""
        begin = 0
        for i, (a, b) in enumerate(zip(symbols, symbols[1:]), 1):
            if a << 20 | b not in self.inside:
                yield symbols[begin:i]
                begin = i
        yield symbols[begin:]

    def fragment(self, parts: list[int]) -> list[int]:
        """Ids of one fragment: the pair of lowest rank, the leftmost of several, is merged until none has a rank."""
        none, rank_of, made = 1 << 60, self.ranks.get, self.made
        ranks = [rank_of(a << 20 | b, none) for a, b in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) != none:
            i = ranks.index(least)
            parts[i : i + 2] = [made[least]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank_of(parts[i - 1] << 20 | parts[i], none)
            if i < len(ranks):
                ranks[i] = rank_of(parts[i] << 20 | parts[i + 1], none)
        return parts

    def piece(self, piece: bytes) -> list[int]:
        symbols = [self.plain[b] for b in piece]
        symbols[-1] = self.last[piece[-1]]
        out: list[int] = []
        for part in self.cut(symbols):
            known = self.fragments.get(key := tuple(part))
            if known is None:
                if len(self.fragments) >= FRAGMENTS:
                    self.fragments.clear()
                known = self.fragments[key] = self.fragment(part)
            out += known
        return out

    def parts(self, text: str) -> list[bytes]:
        """The pieces of a text without special tokens, in its normal form."""
        plain = text.lower() if text.isascii() else self.normal(text)
        if plain.isascii() or plain and max(plain) < LATIN_END:
            return [piece.encode() for piece in self.pieces.findall(plain)]
        return [bytes(map(self.byte_of.__getitem__, piece)) for piece, _ in self.split(plain)]

    def word(self, word: bytes) -> bytes:
        """Ids of a text without ASCII white space, as 32-bit integers."""
        out: list[int] = []
        for i, part in enumerate(self.marks.split(word) if b"<" in word else [word]):
            if i % 2:
                out.append(self.special[part])
            elif part:
                for piece in self.parts(part.decode()):
                    out += self.piece(piece)
        return array("i", out).tobytes()

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs of symbols, NO_RANK where they are never merged."""
        pairs = a << 20 | b
        at = np.searchsorted(self.codes, pairs)
        return np.where(self.codes[at] == pairs, self.rank[at], NO_RANK)

    def merge(self, symbols: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """fragment() of all fragments, which begin at begins: merges within symbols and says which of them are left."""
        left = np.ones(len(symbols), bool)
        place, first, lengths = np.arange(len(symbols)), begins, np.diff(begins, append=len(symbols))
        ranks = np.full(len(symbols), NO_RANK)
        ranks[:-1] = self.rank_of(symbols[:-1], symbols[1:])
        ranks[begins[1:] - 1] = NO_RANK
        while len(first):
            least = np.minimum.reduceat(ranks << 32 | np.arange(len(ranks)), first)
            go_on = least < NO_RANK << 32
            at, rank = least[go_on] & 0xFFFFFFFF, least[go_on] >> 32
            symbols[place[at]], left[place[at + 1]] = self.merged[rank], False
            stay = np.repeat(go_on, lengths)
            stay[at + 1] = False
            at = at - np.cumsum(~stay)[at]
            place, ranks, lengths = place[stay], ranks[stay], lengths[go_on] - 1
            first = np.cumsum(lengths) - lengths
            ranks[at] = NO_RANK
            after, before = at[at < first + lengths - 1], at[at > first]
            ranks[after] = self.rank_of(symbols[place[after]], symbols[place[after + 1]])
            ranks[before - 1] = self.rank_of(symbols[place[before - 1]], symbols[place[before]])
        return left

    def words(self, words: list[bytes]) -> list[bytes]:
        """word() of each."""
        out: list[bytes] = []
        for i in range(0, len(words), TOGETHER):
            found, plain = {}, {}
            for word in words[i : i + TOGETHER]:
                text = "" if len(word) > SHORT or b"<" in word else word.decode()
                text = text.lower() if WESTERN.fullmatch(text) else self.normal(text)
                if text and (text.isascii() or max(text) < LATIN_END):
                    plain[word] = text
                else:
                    found[word] = self.word(word)
            found.update(zip(plain, self.side_by_side(list(plain.values()))))
            out += map(found.__getitem__, words[i : i + TOGETHER])
        return out

    def side_by_side(self, texts: list[str]) -> list[bytes]:
        """Ids of texts in normal form, Latin letters at most, without line feeds and special tokens."""
        pieces = [piece.encode() for piece in self.lines.findall("".join(f"{t}\n" for t in texts))]
        if not pieces:
            return []
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([*map(len, pieces)]) - 1
        kinds = data.astype(np.int64)
        kinds[ends] += 256
        cut = np.ones(len(data), bool)
        cut[1:] = ~self.joined[data[:-1], kinds[1:]]
        cut[ends[:-1] + 1] = True
        symbols = self.symbols[kinds]
        left = self.merge(symbols, np.flatnonzero(cut))
        ids, over = symbols[left].astype("<i4").tobytes(), 4 * (np.cumsum(left) - 1)[data == 10]
        return [ids[i:j] for i, j in zip([0, *(over + 4).tolist()], over.tolist())]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self.recent.encode(texts)

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


@kept
@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """Read once in each Python worker."""
    return Vocabulary(path)


def _mapped(rows: DataFrame, name: str, kind: str, make: Callable[[pa.Array], pa.Array], of: str) -> DataFrame:
    """rows with a column made from the column of; the tasks work on slices, so a batch of long texts stays small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                yield pa.RecordBatch.from_arrays([*part.columns, make(part.column(of))], [*part.schema.names, name])

    return rows.mapInArrow(run, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, `{name}` {kind}")


def _ids(path: str) -> Callable[[pa.Array], pa.Array]:
    def make(texts: pa.Array) -> pa.Array:
        found = vocabulary(path).encode(texts.to_pylist())
        return pa.ListArray.from_arrays(np.cumsum([0, *map(len, found)], dtype="i4"), np.concatenate(found))

    return make


def _texts(path: str) -> Callable[[pa.Array], pa.Array]:
    return lambda ids: pa.array([vocabulary(path).decode(np.asarray(x.values)) for x in ids], pa.string())


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with ids array<int> of a text column that has no nulls."""
    return _mapped(docs, ids_col, "array<int>", _ids(path), text_col)


def decode(docs: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """docs with a string: the tokens of ids, joined by one space, as a vocabulary without decoder gives them."""
    return _mapped(docs, text_col, "string", _texts(path), ids_col)


def encode_decode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of keep, ids array<int>, decoded string for each row of docs, whatever other columns it has.

    Null and empty texts have no ids and decode to the empty string; repeated rows give repeated results; an empty
    table gives an empty result; texts of any length are encoded whole. Kept columns can't have the names of the result's. Special tokens' strings inside a text become
    those tokens. Every document is worked on alone, so no row meets another and nothing is shuffled. Encoding and
    decoding run in one pass over a task's rows.
    """
    small_batches(docs.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)
    if clash := {"doc_id", "ids", "decoded", "__text"} & set(keep):
        raise ValueError(f"columns of these names can't be kept: {sorted(clash)}")
    rows = docs.select(F.col(id_col).alias("doc_id"), *keep, text_of(docs, text_col).alias("__text"))
    to_ids, to_text = _ids(path), _texts(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE):
                part = batch.slice(i, SLICE)
                ids = to_ids(part.column("__text"))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids, to_text(ids)], [*part.schema.names[:-1], "ids", "decoded"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text")
    return rows.mapInArrow(run, f"{kept}, ids array<int>, decoded string")


def digests(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
