"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

A rank file becomes a vocabulary of characters (every byte stands for one printable character) and merges: all ways to make a token of two
others, in order of the token's rank. Texts are cut before spaces that follow a word and precede one, where no token can cross, and each
distinct piece is encoded once per worker, when it is first looked up; a text with other runs of white space around spaces is encoded whole. The ids of a
text are then joined from its pieces. Decoding joins the tokens' bytes by the reversed byte table, so characters that are split between
tokens come back whole; ids outside the vocabulary have no bytes.

Null texts count as empty: no ids. Texts are never cut or normalised.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from churnlake.llm.tables import read_table
from churnlake.llm.text_arrays import slices

RANKS = "byte_bpe_multi_50k.tiktoken"
CACHED = 1_200_000      # pieces a worker remembers, some 250 MB
#: Pieces whose characters every Unicode version and regex library put in the same classes.
plain = re.compile(r"[\t\n\r \x21-\x7e\xa1-\u017f]+").fullmatch


@lru_cache(maxsize=1)
def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where printable, else one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256))
    return [chr(b) if b in shown else chr(256 + next(hidden)) for b in range(256)]


def _characters(token: bytes) -> str:
    table = byte_characters()
    return "".join(table[b] for b in token)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Found(dict):
    """What ``find`` says of each key, asked once."""

    def __init__(self, find):
        super().__init__()
        self.find = find

    def __missing__(self, key):
        value = self[key] = self.find(key)
        return value


class Codec:
    """Encoder and decoder of one vocabulary. ``ids`` are little-endian unsigned 32-bit integers."""

    def __init__(self, tokenizer, token_bytes: list[bytes]):
        self.tokenizer, self.token_bytes = tokenizer, token_bytes
        #: Strings that the library takes for one token wherever they stand: a text that holds one is encoded whole.
        self.added = [x.content for x in tokenizer.get_added_tokens_decoder().values()]
        #: Ids of pieces without the space before them, None for those that have white space at an end, beside a space.
        self.known = Found(lambda piece: None if not piece or piece[0].isspace() or piece[-1].isspace() else self._piece(piece))
        self.words = Found(self._word)          # ids of the words that the pattern cuts
        self.shown = {b: c for b, c in enumerate(byte_characters())}
        self.merge = tokenizer.model.tokenize
        self.cut = regex.compile(public_tokenizers.PATTERN).findall

    def _library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of one match of the pattern: its bytes as characters, merged by the model."""
        return array("I", [t.id for t in self.merge(word.encode().decode("latin-1").translate(self.shown))]).tobytes()

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece behind a space. A plain one is cut here and merged word by word; the library cuts others too."""
        if piece.isascii() and piece.isalpha():                     # a word: one match of the pattern
            return array("I", [t.id for t in self.merge(self.shown[32] + piece)]).tobytes()
        if plain(piece):
            body = piece[:-1]
            if body.isalpha() and piece[-1] in ",.":
                return self.words[" " + body] + self.words[piece[-1]]
            if piece.isalpha():
                return self.words[" " + piece]
            return b"".join(map(self.words.__getitem__, self.cut(" " + piece)))
        return self._library(" " + piece)

    def _ids(self, text: str) -> bytes:
        """Ids of a text that has no space, or only ones that no token can hold together with what stands before them."""
        return b"".join(map(self.words.__getitem__, self.cut(text))) if plain(text) else self._library(text)

    def _text(self, text: str) -> bytes:
        if any(x in text for x in self.added):
            return self._library(text)
        first, *rest = text.split(" ")
        if not rest:
            return self._ids(first)
        last = rest.pop()
        if first[-1:].isspace() or last[:1].isspace():
            return self._library(text)
        try:
            middle = b"".join(map(self.known.__getitem__, rest))
        except TypeError:               # None: more white space beside a space
            return self._library(text)
        return self._ids(first) + middle + (self.known[last] if last and not last[-1].isspace() else self._ids(" " + last))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of every text."""
        out = []
        for text in texts:
            if len(self.known) > CACHED:
                self.known.clear()
            if len(self.words) > CACHED // 4:
                self.words.clear()
            out.append(self._text(text) if text else b"")
        return out

    def decode(self, ids: bytes) -> bytes:
        """The bytes of the ids; a valid UTF-8 text if they are those of one."""
        table, n = self.token_bytes, len(self.token_bytes)
        return b"".join([table[i] if i < n else b"" for i in np.frombuffer(ids, "<u4").tolist()])

    def starts(self, ids: bytes) -> np.ndarray:
        """First byte of every token in the encoded text."""
        sizes = np.array([len(x) for x in self.token_bytes])[np.frombuffer(ids, "<u4")]
        return np.cumsum(sizes) - sizes


@lru_cache(maxsize=2)
def from_ranks(path: str) -> Codec:
    """The codec of a rank file, pieces cut by public_tokenizers.PATTERN."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"      # Spark has a task for every core
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    ranks = read_ranks(path)
    order = sorted(ranks, key=ranks.get)
    merges = [(_characters(token[:i]), _characters(token[i:])) for token in order
              for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks]
    tokenizer = Tokenizer(models.BPE({_characters(t): r for t, r in ranks.items()}, merges, ignore_merges=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(public_tokenizers.PATTERN), "isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    table = [b""] * (1 + max(ranks.values()))
    for token, rank in ranks.items():
        table[rank] = token
    return Codec(tokenizer, table)


@lru_cache(maxsize=2)
def from_json(path: str) -> Codec:
    """The codec of a tokenizer file, with the file's added tokens as the library finds them in a text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    back = {c: b for b, c in enumerate(byte_characters())}
    table = [b""] * tokenizer.get_vocab_size()
    for token, i in tokenizer.get_vocab().items():
        table[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return Codec(tokenizer, table)


def encode(docs: DataFrame, text: str, path: str) -> DataFrame:
    """The rows with ids (array of int) and starts (array of int: first byte of each token)."""
    columns = docs.columns
    at = columns.index(text)

    def lists(values: list[np.ndarray]) -> pa.Array:
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in values])]).astype(np.int32)
        flat = np.concatenate([np.zeros(0, np.int32), *values]).astype(np.int32)
        return pa.ListArray.from_arrays(bounds, pa.array(flat))

    def run(batches):
        codec = from_ranks(path)
        for whole in batches:
            for batch in slices(whole, text):
                ids = codec.encode(batch.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, lists([np.frombuffer(x, "<u4") for x in ids]), lists([codec.starts(x) for x in ids])],
                    [*columns, "ids", "starts"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, ids array<int>, starts array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of ``encode`` with decoded (binary) in place of ids and starts."""
    kept = [c for c in encoded.columns if c not in ("ids", "starts")]

    def run(batches):
        codec = from_ranks(path)
        for batch in batches:
            values = [codec.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(values, pa.binary())], [*kept, "decoded"])

    fields = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in kept)
    return encoded.mapInArrow(run, f"{fields}, decoded binary")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: encoded and decoded in one pass, nothing but digests leaves a task."""
    def run(batches):
        codec = from_ranks(path)
        for whole in batches:
            for batch in slices(whole, "text"):
                ids = codec.encode(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()),
                     pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                     pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in ids], pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path(RANKS))
