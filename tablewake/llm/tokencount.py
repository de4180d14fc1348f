"""Token counts of every prefix of a text by dynamic programming.

Byte-level BPE encodes each match of the pre-tokenizer's pattern by itself, and inside a match a
sequence of tokens is the encoding of its bytes if and only if each pair of neighbours is the
encoding of the pair. So the last token of each prefix of a match is the one token that ends there
and goes with the last token of the prefix before it, and the count of a prefix is one more than
that prefix's count. The tables of matches and of chunks (texts between single blanks) are kept for later
documents; a document's table is put together from those of its chunks, and holds the exact count of each prefix, in
characters. It answers ``how many tokens`` (last entry), ``does it fit`` and ``where to cut for a budget`` without encoding
again. Where only these are asked, sums of the chunks' last entries say how many tokens there are and in which chunk a
budget ends, and the table is made for that chunk alone. Three places need care because the pattern looks ahead: a prefix that ends in white space
has that run as one match; a prefix that cuts 're, 've or 'll after the r, v or l has two matches;
a prefix that ends inside a special string has it as ordinary text.

Counts are those of the tokenizers library for a model file, special strings of the file
recognised as the library does by default, without begin or end tokens.

Nulls: a null text is empty, 0 tokens. Rows are kept as they are, repeated ones included; columns named like a
result are replaced. Texts of any length are processed whole.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from itertools import accumulate
from operator import itemgetter

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewake.llm.bpe import byte_characters
from tablewake.llm.common import Kept, chunks, table, text_of, with_columns, worker_cache

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
KEPT = 64  # a shorter match or chunk is kept, as no count in it is above 255, its most bytes
MATCHES = 400_000  # matches kept by a worker
CHUNKS = 1_200_000  # chunks kept by a worker
HEADS = (9, 6)  # bytes of a match after which its state is kept for others that begin so, the longer first
STATES = 300_000  # such states kept by a worker
TOKEN_BITS = 24
TAIL = 3  # bytes at a token's end by which its length is bounded
RUN = regex.compile(r"\s{2,}")
LAST = itemgetter(-1)
CONTRACTION = ("'re", "'ve", "'ll")


class Counter:
    """Prefix counts under one model file."""

    def __init__(self, model: str, pattern: str) -> None:
        spec = json.loads(model)
        back = {c: b for b, c in enumerate(byte_characters())}
        self.specials = [t["content"] for t in spec["added_tokens"]]
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.specials}
        unshown = lambda t: bytes(back[c] for c in t)
        self.tokens = {unshown(t) for t in vocab}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merges = {(unshown(a), unshown(b)): i for i, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, self.tokens))
        self.pattern = regex.compile(pattern)
        self.special = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self.ids = {t: i for i, t in enumerate(sorted(self.tokens))}
        self.rank = {(self.ids[a], self.ids[b]): i for (a, b), i in self.merges.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        for a, b in self.merges:
            self.parts.setdefault(self.ids[a + b], (self.ids[a], self.ids[b]))
        self.spines: dict[tuple[int, int], list[tuple[int, int]]] = {}
        self.pair_ok: dict[int, bool] = {}
        self.alone = {t: i for t, i in self.ids.items() if self._encode(t) == [t]}  # tokens that encode as themselves
        self.reach: dict[bytes, int] = {}  # by the last bytes of tokens: the longest of them
        for token in self.alone:
            end = token[-TAIL:]
            if len(end) == TAIL:
                self.reach[end] = max(len(token), self.reach.get(end, 0))
        self.heads: dict[bytes, tuple] = {}  # by the first bytes of matches: last tokens and counts at each position in them
        self.matches = Kept(MATCHES)
        self.known = Kept(CHUNKS)  # by chunk, with the blank before it

    def _encode(self, raw: bytes) -> list[bytes]:
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            rank, at = min((self.merges.get((parts[i], parts[i + 1]), len(self.merges)), i) for i in range(len(parts) - 1))
            if rank == len(self.merges):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The parts along a token's left (0) or right (1) edge, each with the rank of the merge that takes it in."""
        if (token, side) not in self.spines:
            out, inner = [(token, len(self.merges))], token
            while inner in self.parts:
                a, b = self.parts[inner]
                inner = b if side else a
                out.append((inner, self.rank[a, b]))
            self.spines[token, side] = out
        return self.spines[token, side]

    def _goes(self, a: int, b: int) -> bool:
        """Is (a, b) the encoding of its bytes? It is unless a merge across the border comes before one that it disturbs."""
        known = self.pair_ok.get(a << TOKEN_BITS | b)
        if known is None:
            rank, most = self.rank, len(self.merges)
            known = not any(
                (r := rank.get((x, y), most)) < taken_x and r <= taken_y and r < most
                for x, taken_x in self._spine(a, 1)
                for y, taken_y in self._spine(b, 0)
            )
            if len(self.pair_ok) > 2 * MATCHES:
                self.pair_ok.clear()
            self.pair_ok[a << TOKEN_BITS | b] = known
        return known

    def byte_counts(self, raw: bytes) -> list[int]:
        """The count of each prefix of a match but the empty one: for each position the last token before it and the count."""
        tokens, reach, pair_ok, heads = self.alone.get, self.reach.get, self.pair_ok.get, self.heads
        known = next((k for k in (heads.get(raw[:n]) for n in HEADS if n <= len(raw)) if k), None)
        last, counts = map(list, known) if known else ([-1], [0])
        for end in range(len(last), len(raw) + 1):
            begin = end - reach(raw[end - TAIL : end], TAIL - 1) if end > TAIL else 0
            if begin < 0:
                begin = 0
            while True:
                token = tokens(raw[begin:end])
                if token is not None:
                    if not begin:
                        break
                    good = pair_ok(last[begin] << TOKEN_BITS | token)
                    if good or good is None and self._goes(last[begin], token):
                        break
                begin += 1
                if begin == end:
                    raise ValueError("the vocabulary lacks a byte")
            last.append(token)
            counts.append(counts[begin] + 1)
            if end in HEADS:
                if len(heads) >= STATES:
                    heads.clear()
                heads[raw[:end]] = tuple(last), tuple(counts)
        return counts[1:]

    def match_counts(self, match: str) -> list[int]:
        """The count of each prefix of a match but the empty one, by characters."""
        raw = match.encode("utf-8", "replace")
        counts = self.byte_counts(raw)
        if len(raw) > len(match):
            counts = [c for c, after in zip(counts, [*raw[1:], 0], strict=True) if after & 0xC0 != 0x80]
        if match in CONTRACTION:  # ' and a letter are two matches
            counts[1] = self.byte_counts(b"'")[-1] + self.byte_counts(match[1].encode())[-1]
        return counts

    def _inside(self, text: str) -> list[int] | bytes:
        """The counts within a chunk, match by match."""
        out: list[int] = []
        for match in self.pattern.findall(text):
            counts = self.matches.get(match)
            if counts is None:
                counts = self.match_counts(match)
                if len(match) < KEPT:
                    counts = bytes(counts)
                    self.matches.put(match, counts)
            if len(counts) == len(text):
                return counts
            base = out[-1] if out else 0
            out += [base + c for c in counts]
        return out

    def _table(self, chunk: str) -> bytes | list[int]:
        """The counts within a chunk after its blank, kept as bytes if it is short enough."""
        counts = self.known.get(chunk)
        if counts is None:
            counts = self._inside(f" {chunk}")
            if len(chunk) < KEPT:
                counts = bytes(counts)
                self.known.put(chunk, counts)
        return counts

    def _tables(self, parts: list[str]) -> list[bytes | list[int]]:
        """The counts within each chunk."""
        tables = [*map(self.known.young.get, parts)]
        tables[0] = self._inside(parts[0])
        if None in tables:
            tables = [self._table(p) if t is None else t for p, t in zip(parts, tables, strict=True)]
        return tables

    def part_counts(self, text: str) -> np.ndarray:
        """The count of each prefix, the empty one first, of a text without special strings."""
        if not text:
            return np.zeros(1, np.int64)
        parts = chunks(text)
        tables = self._tables(parts)
        if all(type(t) is bytes for t in tables):
            inside = np.frombuffer(b"".join(tables), np.uint8)
        else:
            inside = np.concatenate([np.frombuffer(t, np.uint8) if type(t) is bytes else np.array(t, np.int64) for t in tables])
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        lengths[1:] += 1
        ends = np.cumsum(lengths)
        sums = np.where(lengths > 0, inside[np.maximum(ends, 1) - 1], 0)
        counts = np.concatenate(([0], inside + np.repeat(np.cumsum(sums) - sums, lengths)))
        # A prefix that ends in white space has the whole run as its last match.
        for run in RUN.finditer(text):
            counts[run.start() + 1 : run.end() + 1] = counts[run.start()] + np.array(self.match_counts(run[0]))
        return counts

    def prefix_counts(self, text: str) -> np.ndarray:
        """The count of each prefix of a text, by characters, the empty one first."""
        if not self.special or not self.special.search(text):
            return self.part_counts(text)
        out, base, begin = [np.zeros(1, np.int64)], 0, 0
        for s in self.special.finditer(text):
            part = text[begin : s.start()]
            # Inside the special string it is text; after its last character it is one token.
            counts = self.part_counts(part + s[0])[1:]
            whole = self.part_counts(part)[-1]
            counts[-1] = whole + 1
            out.append(base + counts)
            base, begin = base + whole + 1, s.end()
        out.append(base + self.part_counts(text[begin:])[1:])
        return np.concatenate(out)

    def total_and_fit(self, text: str, budget: int) -> tuple[int, int]:
        """(count of the text, characters of its longest prefix of at most ``budget`` tokens)."""
        if not text or self.special and self.special.search(text) or len(text) > 1 and text[-2:].isspace():
            counts = self.prefix_counts(text)
            return int(counts[-1]), int(np.flatnonzero(counts <= budget)[-1])
        parts = chunks(text)
        tables = self._tables(parts)
        tables[0] = tables[0] or b"\0"  # a blank at the start
        ends = [*accumulate(map(LAST, tables))]
        if ends[-1] <= budget:
            return ends[-1], len(text)
        # A prefix that ends in a chunk has no fewer tokens than the chunks before it, so the longest that fits ends in the last
        # chunk with as many before it. White space is one match wherever chunks part it: begin where none comes before.
        of = bisect_right(ends, budget)
        begin = of
        while begin and (not parts[begin - 1] or parts[begin - 1][-1].isspace()):
            begin -= 1
        before = sum(map(len, parts[:begin])) + max(begin - 1, 0)
        counts = self.part_counts(" " * (begin > 0) + " ".join(parts[begin : of + 1])) + (ends[begin - 1] if begin else 0)
        return ends[-1], before + int(np.flatnonzero(counts <= budget)[-1])


def _counter(model: str, pattern: str) -> Counter:
    cache = worker_cache("counters")
    if model not in cache:
        cache.clear()
        cache[model] = Counter(model, pattern)
    return cache[model]


def count_tokens(docs: DataFrame, path: str, budget: int = LIMIT, prefixes: bool = False) -> DataFrame:
    """``docs`` with ``n_tokens``, ``fits_chars`` (characters of the longest prefix of at most ``budget`` tokens) and,
    if asked for, ``prefix_tokens``: the count of each prefix by characters, from the empty one on.
    """
    with open(path, encoding="utf-8") as file:
        model = file.read()
    pattern = public_tokenizers.PATTERN
    names = ["n_tokens", "fits_chars", *["prefix_tokens"] * prefixes]
    docs = docs.drop(*names)
    kept, column = docs.columns, docs.columns.index("text")

    def run(batches):
        counter = _counter(model, pattern)
        for batch in batches:
            n, fits, tables = [], [], []
            for text in batch.column(column):
                if prefixes:
                    counts = counter.prefix_counts(text.as_py() or "")
                    n.append(int(counts[-1]))
                    fits.append(int(np.flatnonzero(counts <= budget)[-1]))
                    tables.append(counts.astype(np.int32))
                else:
                    total, fit = counter.total_and_fit(text.as_py() or "", budget)
                    n.append(total)
                    fits.append(fit)
            added = [pa.array(n, pa.int64()), pa.array(fits, pa.int64())]
            if prefixes:
                added.append(pa.array(tables, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*kept, *names])

    more = {"prefix_tokens": "array<int>"} if prefixes else {}
    return docs.mapInArrow(run, with_columns(docs, n_tokens="bigint", fits_chars="bigint", **more))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select("doc_id", text_of().alias("text"))
    counted = count_tokens(texts.select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes")), public_tokenizers.path(VOCABULARY))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "fits_chars")
