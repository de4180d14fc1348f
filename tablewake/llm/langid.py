"""Language of a text by a bidirectional gated recurrent network over its bytes.

The network reads bytes forwards and backwards. In each direction a state h of ``HIDDEN`` numbers goes through

    z, r = half(1 + s(E b + h U))      n = s(E b + r (h U))      h = n + z (h - n)        with s(x) = x / (1 + |x|)

(a gated recurrent unit whose sigmoid and tanh are the rational s, which numpy computes some ten times as fast). Both states
of a position give the probabilities of all languages there, so each byte has a label of its own; a document's
probabilities are the means over its bytes. A text is read as segments of ``SEGMENT`` bytes, each from a zero state: segments
of many texts advance together, and a text of any length needs the memory of ``ROWS`` segments.

Training is backpropagation through time and Adam, in numpy on the driver, on a bounded sample: about ``PER_LANGUAGE``
different texts of each language, picked by the hash of the text, and ``SEGMENTS`` segments of each, anywhere in it. At most
``LANGUAGES`` languages are learned, those with most texts (some 80 MB at the very most; 2 MB for four languages). Texts are found with
one count and one filter; the weights, some 100 kB, travel with the task function. Everything is seeded.

Training documents are those with a text and a lang whose crc32 of the doc_id, as decimal text, is not 2 modulo 4. A document
without a doc_id has no such remainder: it is not learned from and not held out. Predictions read the text only.

A null text, and one without a letter, is ``und`` with score 0, and so is every text if there is nothing to learn from. Repeated
rows give a row each; of languages with equal probabilities the first in code point order wins; an empty table gives no rows;
columns of a result's name are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewake.llm.common import table, with_columns

HIDDEN = 8
SEGMENT = 64  # bytes read from a zero state
ROWS = 2048  # segments that advance together
PER_LANGUAGE = 400  # texts sampled of each language
SEGMENTS = 24  # segments sampled of each of these texts
LANGUAGES = 64  # languages learned
STEPS = 200
BATCH = 256  # segments in a training step
RATE = 0.015
UND = "und"

Weights = dict[str, np.ndarray]


@dataclass
class Model:
    languages: list[str]
    weights: Weights


def new_weights(n_languages: int, hidden: int, seed: int, dtype: type = np.float32) -> Weights:
    """E: of bytes, U: of states, for z, r and n in each direction; V, c: of the labels."""
    random = np.random.default_rng(seed)
    draw = lambda *shape: (random.standard_normal(shape) / np.sqrt(hidden)).astype(dtype)
    return {
        "E": draw(2, 3, 256, hidden), "U": draw(2, 3, hidden, hidden),
        "V": draw(2, hidden, n_languages), "c": np.zeros(n_languages, dtype),
    }


def soft(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def direction(w: Weights, d: int, segments: np.ndarray, mask: np.ndarray | None, kept: list | None = None) -> np.ndarray:
    """States (position, segment, hidden) of one direction (0 forwards, 1 backwards) over segments (position, segment).

    ``mask`` (position, segment) is 0 behind the end of a text, where states stay zero. ``kept`` gets what the way back needs.
    """
    embed, update = w["E"][d], w["U"][d]
    steps, n = segments.shape
    states = np.empty((steps, n, embed.shape[2]), embed.dtype)
    h = np.zeros_like(states[0])
    gates = np.empty((2, *h.shape), h.dtype)
    size = np.empty_like(gates)
    inner = np.empty_like(h)
    for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
        for gate in (0, 1):
            np.matmul(h, update[gate], out=gates[gate])
            gates[gate] += embed[gate].take(segments[t], axis=0, mode="clip")
        np.abs(gates, out=size)
        size += 1
        gates /= size
        gates += 1
        gates *= 0.5
        np.matmul(h, update[2], out=inner)
        reached = inner.copy() if kept is not None else None
        inner *= gates[1]
        inner += embed[2].take(segments[t], axis=0, mode="clip")
        np.abs(inner, out=size[0])
        size[0] += 1
        inner /= size[0]
        if kept is not None:
            kept.append((t, h, gates.copy(), inner.copy(), reached))
        new = states[t]
        np.subtract(h, inner, out=new)
        new *= gates[0]
        new += inner
        if mask is not None:
            new *= mask[t][:, None]
        h = new
    return states


def probabilities(w: Weights, ahead: np.ndarray, back: np.ndarray) -> np.ndarray:
    """The probability of each language (first axis) at each position."""
    hidden = ahead.shape[-1]
    x = w["V"][0].T @ ahead.reshape(-1, hidden).T
    x += w["V"][1].T @ back.reshape(-1, hidden).T
    x += w["c"][:, None]
    x -= x.max(axis=0)
    np.exp(x, out=x)
    x /= x.sum(axis=0)
    return x.reshape(len(x), *ahead.shape[:-1])


def gradients(w: Weights, segments: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> tuple[float, Weights]:
    """The mean cross entropy of all positions, and its gradient by backpropagation through time."""
    kept: list[list] = [[], []]
    states = [direction(w, d, segments, mask, kept[d]) for d in (0, 1)]
    p = probabilities(w, *states)
    share = mask / mask.sum()
    truth = np.arange(len(p))[:, None, None] == labels
    loss = float(-(np.log((p * truth).sum(axis=0) + 1e-12) * share).sum())
    p -= truth
    p *= share
    p = np.ascontiguousarray(np.moveaxis(p, 0, 2))
    g = {name: np.zeros_like(x) for name, x in w.items()}
    g["c"] = p.sum(axis=(0, 1))
    hidden = w["V"].shape[1]
    for d in (0, 1):
        g["V"][d] = states[d].reshape(-1, hidden).T @ p.reshape(-1, p.shape[2])
        from_labels = p @ w["V"][d].T
        flow = np.zeros_like(from_labels[0])
        one_hot = np.arange(256)[:, None]
        for t, before, gates, inner, reached in reversed(kept[d]):
            flow = (flow + from_labels[t]) * mask[t][:, None]
            z, r = gates
            d_inner = flow * (1 - z) * (1 - np.abs(inner)) ** 2
            d_reached = d_inner * r
            # half(1 + s): s = 2 z - 1
            d_z = flow * (before - inner) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
            d_r = d_inner * reached * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
            seen = (one_hot == segments[t]).astype(flow.dtype)
            for gate, at_sum, at_state in ((0, d_z, d_z), (1, d_r, d_r), (2, d_inner, d_reached)):
                g["E"][d, gate] += seen @ at_sum
                g["U"][d, gate] += before.T @ at_state
            flow = flow * z + d_z @ w["U"][d, 0].T + d_r @ w["U"][d, 1].T + d_reached @ w["U"][d, 2].T
    return loss, g


def train(segments: np.ndarray, lengths: np.ndarray, labels: np.ndarray, n_languages: int, steps: int = STEPS, seed: int = 11) -> Weights:
    """Weights learned from segments (segment, position), their lengths and the numbers of their languages."""
    random = np.random.default_rng(seed)
    w = new_weights(n_languages, HIDDEN, seed)
    by_language = [np.flatnonzero(labels == k) for k in range(n_languages)]
    first = {name: np.zeros_like(x) for name, x in w.items()}
    second = {name: np.zeros_like(x) for name, x in w.items()}
    for step in range(1, steps + 1):
        languages = random.integers(0, n_languages, BATCH)  # each as often, whatever its number of texts
        at = np.array([by_language[k][random.integers(len(by_language[k]))] for k in languages])
        mask = (np.arange(segments.shape[1])[:, None] < lengths[at]).astype(np.float32)
        _, g = gradients(w, np.ascontiguousarray(segments[at].T), mask, labels[at])
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        rate = RATE * min(1, 2 * (1 - (step - 1) / steps))
        for name, x in g.items():
            x *= min(1.0, 1 / (norm + 1e-12))
            first[name] += 0.1 * (x - first[name])
            second[name] += 0.01 * (x * x - second[name])
            w[name] -= rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)
    return w


def remainder() -> Column:
    """crc32 of the doc_id, as decimal text, modulo 4; null without a doc_id."""
    return F.when(F.col("doc_id").isNotNull(), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4)


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> list[tuple[str, bytes]]:
    """(lang, segment) of a bounded number of texts of each language, in a fixed order."""
    known = docs.where(remainder() != 2).where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''")
    known = known.select("lang", "text", F.xxhash64("text").alias("key"))
    counts = known.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    limits = {r.lang: min(1.0, per_language / max(r.n, 1)) for r in counts.collect()}
    if not limits:
        return []
    share = F.create_map(*(F.lit(x) for pair in limits.items() for x in pair))[F.col("lang")]
    place = F.pmod(F.shiftright("key", 16), F.lit(1 << 30)) / F.lit(float(1 << 30))
    texts = known.where(place < share).groupBy("lang", "key").agg(F.first("text").alias("text"))

    def run(batches):
        for batch in batches:
            out = []
            for lang, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                n = -(-len(raw) // SEGMENT)
                picks = np.random.default_rng(key & 0xFFFFFFFF).permutation(n)[:SEGMENTS] if n > SEGMENTS else np.arange(n)
                out += [(lang, key, int(k), raw[k * SEGMENT : (k + 1) * SEGMENT]) for k in picks]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names)

    kinds, names = [pa.string(), pa.int64(), pa.int64(), pa.binary()], ["lang", "key", "k", "segment"]
    rows = texts.select("lang", "key", "text").mapInArrow(run, "lang string, key bigint, k bigint, segment binary").collect()
    return [(lang, bytes(segment)) for lang, _, _, segment in sorted(map(tuple, rows), key=lambda r: r[:3])]


def packed(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Segments as rows of bytes, zero behind their ends, and their lengths."""
    out = np.frombuffer(b"".join(s.ljust(SEGMENT, b"\0") for s in segments), np.uint8).reshape(-1, SEGMENT)
    return out, np.fromiter(map(len, segments), np.int64, len(segments))


def fit(docs: DataFrame, steps: int = STEPS) -> Model:
    """A model of the languages of the training documents; one without languages if there are none."""
    rows = sample(docs)
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return Model([], {})
    numbers = {lang: k for k, lang in enumerate(languages)}
    labels = np.array([numbers[lang] for lang, _ in rows])
    return Model(languages, train(*packed([s for _, s in rows]), labels, len(languages), steps))


class Reader:
    """Sums of the positions' probabilities by text, over segments that are read together."""

    def __init__(self, model: Model, n_texts: int, labels: bool = False) -> None:
        self.model = model
        self.sums = np.zeros((n_texts, len(model.languages)))
        self.labels: list[list[np.ndarray]] | None = [[] for _ in range(n_texts)] if labels else None
        self.held: list[np.ndarray] = []
        self.owners: list[int] = []
        self.n_held = 0

    def add(self, owner: int, raw: bytes) -> None:
        for at in range(0, len(raw), ROWS * SEGMENT):
            part = np.frombuffer(raw, np.uint8, min(ROWS * SEGMENT, len(raw) - at), at)
            self.held.append(part)
            self.owners.append(owner)
            self.n_held += -(-len(part) // SEGMENT)
            if self.n_held >= ROWS:
                self.flush()

    def flush(self) -> None:
        if not self.held:
            return
        counts = [-(-len(p) // SEGMENT) for p in self.held]
        segments = np.zeros((self.n_held, SEGMENT), np.uint8)
        lengths = np.full(self.n_held, SEGMENT, np.int64)
        row = 0
        for part, n in zip(self.held, counts, strict=True):
            segments[row : row + n].reshape(-1)[: len(part)] = part
            lengths[row + n - 1] = len(part) - (n - 1) * SEGMENT
            row += n
        mask = (np.arange(SEGMENT)[:, None] < lengths).astype(np.float32)
        turned = np.ascontiguousarray(segments.T).astype(np.intp)
        w = self.model.weights
        p = probabilities(w, direction(w, 0, turned, mask), direction(w, 1, turned, mask))
        row = 0
        totals = (p * mask).sum(axis=1).T
        for owner, n, part in zip(self.owners, counts, self.held, strict=True):
            self.sums[owner] += totals[row : row + n].sum(axis=0)
            if self.labels is not None:
                best = p[:, :, row : row + n].argmax(axis=0).T.reshape(-1)
                self.labels[owner].append(best[: len(part)].astype(np.int16))
            row += n
        self.held, self.owners, self.n_held = [], [], 0


def spans_of(labels: np.ndarray, languages: list[str]) -> list[dict]:
    """Maximal stretches of bytes with one label."""
    if not len(labels):
        return []
    begins = np.concatenate(([0], np.flatnonzero(np.diff(labels)) + 1))
    ends = np.append(begins[1:], len(labels))
    return [{"begin": int(b), "end": int(e), "lang": languages[labels[b]]} for b, e in zip(begins, ends, strict=True)]


def predict(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; with ``spans`` also ``lang_spans``, the stretches of equal labels in bytes."""
    names = ["lang_pred", "score", *["lang_spans"] * spans]
    docs = docs.drop(*names)
    kept, column = docs.columns, docs.columns.index("text")
    lettered = docs.withColumn("#lettered", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    span_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches):
        for batch in batches:
            reader = Reader(model, batch.num_rows, spans)
            read = batch.column(len(kept)).to_pylist()
            for i, text in enumerate(batch.column(column)):
                if read[i] and model.languages:
                    reader.add(i, text.as_py().encode("utf-8", "surrogatepass"))
            reader.flush()
            langs, scores = [UND] * batch.num_rows, [0.0] * batch.num_rows
            for i, sums in enumerate(reader.sums):
                if read[i] and model.languages:
                    best = int(sums.argmax())
                    langs[i], scores[i] = model.languages[best], min(1.0, float(sums[best] / sums.sum()))
            added = [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            if spans:
                labels = [np.concatenate(x) if x else np.zeros(0, np.int16) for x in reader.labels]
                added.append(pa.array([spans_of(x, model.languages) for x in labels], span_type))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *added], [*kept, *names])

    more = {"lang_spans": "array<struct<begin:bigint,end:bigint,lang:string>>"} if spans else {}
    return lettered.mapInArrow(run, with_columns(docs, lang_pred="string", score="double", **more))


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "text", "lang"))
    held_out = F.coalesce(remainder() == 2, F.lit(False)).alias("held_out")
    rows = predict(docs.select("doc_id", "text", held_out), model)
    return rows.select("doc_id", "held_out", "lang_pred", "score")
