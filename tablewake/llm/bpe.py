"""Byte-level BPE: encoding with the tokenizers library, and decoding.

The vocabulary is a rank file (base64 token and rank per line). Its merges are those pairs into which
the merges of lower rank leave each token; with the usual table from bytes to characters they make
a tokenizers model, whose pre-tokenizer is the given pattern. Special strings are ordinary text.
The model is built once on the driver (its size is the vocabulary's, whatever the data) and
travels with the task function, so executors read no file.

Decoding maps the characters of each token back to bytes. A character whose bytes fall into several
tokens has no text of its own there; the token offsets count bytes, and text is made from the joined
bytes only.

Nulls: a null text is empty: no tokens. An unknown id or a null id in a list to be decoded is an
error of the caller (ValueError); a null list decodes to no bytes. Rows and their columns stay as they are,
repeated ones included; a column of a result's name is replaced. Texts are processed whole, whatever their length:
they are cut at single blanks, where the pattern always separates, and a worker keeps the ids of short
chunks, so that the library encodes each only once in a while.
"""

from __future__ import annotations

import base64
import json
import os

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewake.llm.common import Kept, chunks, table, text_of, with_columns, worker_cache

VOCABULARY = "byte_bpe_50k.tiktoken"
ROW = 1 << 14  # characters of unknown chunks in a row
BATCH = 1 << 18  # characters that the library gets at a time, or one chunk
KEPT = 64  # characters of a chunk whose ids are kept
CHUNKS = 500_000  # chunks kept by a worker
IDS = 1 << 20  # ids decoded together


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself if it is printable, else one from 256 up."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that merges of a lower rank leave of a token; None if they leave more."""
    parts, limit = [token[i : i + 1] for i in range(len(token))], ranks[token]
    while len(parts) > 2:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], limit), i) for i in range(len(parts) - 1))
        if rank >= limit:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


def model_json(path: str, pattern: str = public_tokenizers.PATTERN) -> str:
    """A tokenizers model, as JSON, of a rank file."""
    ranks, characters = read_ranks(path), byte_characters()
    shown = {token: "".join(characters[b] for b in token) for token in ranks}
    by_rank = sorted(ranks, key=ranks.get)
    merges = [pair for token in by_rank if len(token) > 1 and (pair := last_merge(token, ranks))]
    split = {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False}
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}
    return json.dumps(
        {
            "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None,
            "pre_tokenizer": {"type": "Sequence", "pretokenizers": [split, level]},
            "post_processor": None, "decoder": None,
            "model": {
                "type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None,
                "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": True,
                "vocab": {shown[token]: rank for token, rank in ranks.items()},
                "merges": [[shown[a], shown[b]] for a, b in merges],
            },
        }
    )


class Encoder:
    """Ids of texts by chunks; those of chunks met before are kept."""

    def __init__(self, model: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.blank_first = np.zeros(self.tokenizer.get_vocab_size(), bool)
        blank = byte_characters()[0x20]
        for token, i in self.tokenizer.get_vocab().items():
            self.blank_first[i] = token.startswith(blank)
        self.known = Kept(CHUNKS)  # by chunk, with a blank before it

    def _learn(self, wanted: list[str]) -> list[bytes]:
        """The ids, as bytes, of strings; the library gets a bounded number of characters at a time."""
        out, held, chars = [], [], 0
        for i, text in enumerate(wanted):
            held.append(text)
            chars += len(text)
            if chars > BATCH or i == len(wanted) - 1:
                encoded = self.tokenizer.encode_batch_fast(held, add_special_tokens=False)
                out += [np.array(e.ids, np.int32).tobytes() for e in encoded]
                held, chars = [], 0
        return out

    def _learn_chunks(self, wanted: list[str]) -> list[bytes]:
        """The ids of chunks with a blank before each. Those without blanks inside are encoded many in a row:
        then just the first token of each begins with a blank.
        """
        if any(" " in chunk for chunk in wanted):
            return self._learn([f" {chunk}" for chunk in wanted])
        out, at = [], 0
        while at < len(wanted):
            end, chars = at, 0
            while end < len(wanted) and (end == at or chars < ROW):
                chars += len(wanted[end]) + 1
                end += 1
            ids = np.frombuffer(self._learn([" " + " ".join(wanted[at:end])])[0], np.int32)
            starts = np.flatnonzero(self.blank_first[ids])
            cuts = [*(starts * 4).tolist(), 4 * len(ids)]
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            at = end
        return out

    def ids(self, text: str) -> bytes:
        """The ids of a text as 4 bytes each."""
        if not text:
            return b""
        parts = chunks(text)
        first = self._learn([parts[0]])[0] if parts[0] else b""
        rest = [*map(self.known.young.get, parts[1:])]
        if None in rest:
            rest = [self.known.get(p) if ids is None else ids for p, ids in zip(parts[1:], rest, strict=True)]
        if None in rest:
            missing = {p for p, ids in zip(parts[1:], rest, strict=True) if ids is None}
            learnt = dict(zip(missing, self._learn_chunks([*missing]), strict=True))
            rest = [learnt[p] if ids is None else ids for p, ids in zip(parts[1:], rest, strict=True)]
            for p, ids in learnt.items():
                if len(p) <= KEPT:
                    self.known.put(p, ids)
        return b"".join([first, *rest])


def _encoder(model: str) -> Encoder:
    cache = worker_cache("encoders")
    if model not in cache:
        cache.clear()
        cache[model] = Encoder(model)
    return cache[model]


class Decoder:
    """Bytes of ids: the tokens' bytes lie one after another, and a list of ids is a gather from them."""

    def __init__(self, vocab: dict[str, int]) -> None:
        table_of = {c: b for b, c in enumerate(byte_characters())}
        size = max(vocab.values(), default=-1) + 1
        self.lengths = np.full(size, -1, np.int64)  # -1: no such id
        self.starts = np.zeros(size, np.int64)
        flat = bytearray()
        for token, i in vocab.items():
            self.lengths[i], self.starts[i] = len(token), len(flat)
            flat += bytes(table_of[c] for c in token)
        self.flat = np.frombuffer(bytes(flat), np.uint8)

    def _part(self, ids: np.ndarray) -> bytes:
        if ids.min() < 0 or ids.max() >= len(self.lengths) or (lengths := self.lengths[ids]).min() < 0:
            raise ValueError("a token id that the vocabulary doesn't have")
        ends = np.cumsum(lengths)
        # A byte's place in the table is its place in the text, moved by as much as its token is.
        moved = np.repeat(self.starts[ids] - (ends - lengths), lengths)
        return self.flat[moved + np.arange(len(moved))].tobytes()

    def bytes_of(self, ids: np.ndarray) -> bytes:
        return b"".join(self._part(ids[i : i + IDS]) for i in range(0, len(ids), IDS))


def encode(docs: DataFrame, path: str, offsets: bool = False, decoded: bool = False) -> DataFrame:
    """``docs`` with ``token_ids``; with ``offsets`` also ``token_begins``, each token's first byte in the text, and with
    ``decoded`` the bytes that the ids give, without another way through the workers.
    """
    model = model_json(path)
    decoder = Decoder(json.loads(model)["model"]["vocab"])

    def run(batches):
        encoder = _encoder(model)
        for batch in batches:
            raw = [encoder.ids(t.as_py() or "") for t in batch.column(column)]
            ids = np.frombuffer(b"".join(raw), np.int32)
            counts = np.fromiter(map(len, raw), np.int64, len(raw)) // 4
            ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            added = [pa.ListArray.from_arrays(ends, ids)]
            if offsets:
                bytes_before = np.concatenate(([0], np.cumsum(decoder.lengths[ids])))[:-1]
                of_doc = np.repeat(np.append(bytes_before, 0)[np.minimum(ends[:-1], len(ids))], counts)
                added.append(pa.ListArray.from_arrays(ends, bytes_before - of_doc))
            if decoded:
                added.append(pa.array([decoder.bytes_of(np.frombuffer(r, np.int32)) for r in raw], pa.binary()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*kept, *names])

    names = {"token_ids": "array<int>"}
    if offsets:
        names["token_begins"] = "array<bigint>"
    if decoded:
        names["decoded"] = "binary"
    docs = docs.drop(*names)
    kept, column = docs.columns, docs.columns.index("text")
    return docs.mapInArrow(run, with_columns(docs, **names))


def decode(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` (with ``token_ids``) with ``decoded``, the bytes of the tokens."""
    decoder = Decoder(json.loads(model_json(path))["model"]["vocab"])
    rows = rows.drop("decoded")
    kept, column = rows.columns, rows.columns.index("token_ids")

    def run(batches):
        for batch in batches:
            out = []
            for ids in batch.column(column):
                values = ids.values if ids.is_valid else pa.array([], pa.int32())
                if values.null_count:
                    raise ValueError("a null in a list of token ids")
                out.append(decoder.bytes_of(values.to_numpy()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*kept, "decoded"])

    return rows.mapInArrow(run, with_columns(rows, decoded="binary"))


def ids_sha256(ids: Column) -> Column:
    return F.sha2(F.array_join(ids.cast("array<string>"), " "), 256)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row."""
    return encode(docs.select("doc_id", text_of().alias("text")), path, decoded=True).select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        ids_sha256(F.col("token_ids")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
