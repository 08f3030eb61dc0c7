"""Language of whole texts by a bidirectional gated recurrent network over bytes.

The network reads windows of UTF-8 bytes in both directions, gives each byte a
probability for each language, and a document gets the mean over all its bytes.
It is trained here, in numpy, by backpropagation through time.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollcall.llm.common import extended, others, quoted

#: Fitting: documents per language and windows per document at most, all from rows that are not held out.
DOCS_PER_LANGUAGE, WINDOWS_PER_DOC, TRAIN_WINDOW = 160, 6, 64
HIDDEN, STEPS, BATCH, RATE, SEED = 8, 300, 128, 0.02, 7
#: Prediction: bytes of a window, and windows that are read at once.
WINDOW, BLOCK = 128, 1024
UNDETERMINED = "und"
_MAYBE_LETTER = re.compile(r"[^\W\d_]")  # letters, and numbers that are no digits, such as fractions
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_PAD = 0x20


@dataclass
class Network:
    """Weights by direction d (0 forward, 1 backward). Gates stand in the order update, reset, new."""

    languages: list[str]
    embed: np.ndarray  # [d, 256, 3H]
    recur: np.ndarray  # [d, H, 3H]
    out: np.ndarray  # [d, H, C]
    bias: np.ndarray  # [C]

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.recur, self.out, self.bias]


def new_network(languages: list[str], hidden: int = HIDDEN, seed: int = SEED) -> Network:
    rng = np.random.default_rng(seed)
    scale = 1 / np.sqrt(hidden)
    shapes = [(2, 256, 3 * hidden), (2, hidden, 3 * hidden), (2, hidden, len(languages))]
    embed, recur, out = (rng.normal(0, scale, s).astype(np.float32) for s in shapes)
    return Network(languages, embed, recur, out, np.zeros(len(languages), np.float32))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _both_ways(windows: np.ndarray) -> np.ndarray:
    """[T, d, B]: the byte that each direction reads at each step."""
    return np.stack([windows.T, windows[:, ::-1].T], axis=1)


def loss_and_gradients(net: Network, windows: np.ndarray, valid: np.ndarray, labels: np.ndarray):
    """Mean cross-entropy over all valid positions of ``windows`` [B, T], and its gradients."""
    (b, t_max), h_size = windows.shape, net.recur.shape[1]
    seen, d_index = _both_ways(windows), np.arange(2)[:, None]
    state = np.zeros((2, b, h_size), np.float32)
    states, tape = [state], []
    for t in range(t_max):
        x = net.embed[d_index, seen[t]]
        u = state @ net.recur
        gates = _sigmoid(x[..., : 2 * h_size] + u[..., : 2 * h_size])
        z, r = gates[..., :h_size], gates[..., h_size:]
        un = u[..., 2 * h_size :]
        new = np.tanh(x[..., 2 * h_size :] + r * un)
        tape.append((z, r, un, new))
        state = z * state + (1 - z) * new
        states.append(state)
    hidden = np.stack(states[1:])  # [T, d, B, H]
    forward, backward = hidden[:, 0], hidden[::-1, 1]
    p = _softmax(forward @ net.out[0] + backward @ net.out[1] + net.bias)  # [T, B, C]
    weight = valid.T[..., None] / max(1, valid.sum())
    target = np.eye(len(net.bias), dtype=np.float32)[labels]
    loss = -(np.log(np.maximum(p[..., labels][:, np.arange(b), np.arange(b)], 1e-9)) * weight[..., 0]).sum()
    slope = ((p - target) * weight).astype(np.float32)
    d_out = np.stack([np.einsum("tbh,tbc->hc", forward, slope), np.einsum("tbh,tbc->hc", backward, slope)])
    d_bias = slope.sum(axis=(0, 1))
    d_hidden = np.stack([slope @ net.out[0].T, (slope @ net.out[1].T)[::-1]], axis=1)
    d_embed, d_recur = np.zeros_like(net.embed), np.zeros_like(net.recur)
    d_state = np.zeros_like(state)
    for t in range(t_max - 1, -1, -1):
        z, r, un, new = tape[t]
        before = states[t]
        d_state = d_state + d_hidden[t]
        d_new = d_state * (1 - z) * (1 - new * new)
        d_z = d_state * (before - new) * z * (1 - z)
        d_r = d_new * un * r * (1 - r)
        d_x = np.concatenate([d_z, d_r, d_new], axis=-1)
        d_u = np.concatenate([d_z, d_r, d_new * r], axis=-1)
        for d in (0, 1):
            np.add.at(d_embed[d], seen[t, d], d_x[d])
        d_recur += before.transpose(0, 2, 1) @ d_u
        d_state = d_state * z + d_u @ net.recur.transpose(0, 2, 1)
    return loss, [d_embed, d_recur, d_out, d_bias]


def train(samples: list[tuple[str, bytes]], hidden: int = HIDDEN, steps: int = STEPS, seed: int = SEED) -> Network:
    """Fit a network to (language, window) samples with Adam; the same samples give the same network.

    Takes ``steps`` steps in whatever number of passes, so that few samples are
    not learned less.
    """
    languages = sorted({language for language, _ in samples})
    net = new_network(languages, hidden, seed)
    if len(languages) < 2:
        return net
    rng = np.random.default_rng(seed)
    labels = np.array([languages.index(language) for language, _ in samples])
    windows = np.full((len(samples), TRAIN_WINDOW), _PAD, np.uint8)
    valid = np.zeros(windows.shape, np.float32)
    for k, (_, data) in enumerate(samples):
        data = data[:TRAIN_WINDOW]
        windows[k, : len(data)] = np.frombuffer(data, np.uint8)
        valid[k, : len(data)] = 1
    parts = net.parameters()
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    queue = np.empty(0, np.int64)
    for step in range(1, steps + 1):
        if len(queue) < min(BATCH, len(samples)):
            queue = np.append(queue, rng.permutation(len(samples)))
        pick, queue = queue[:BATCH], queue[BATCH:]
        _, slopes = loss_and_gradients(net, windows[pick], valid[pick], labels[pick])
        rate = RATE * (1 - 0.9 * step / steps)
        for p, g, m, v in zip(parts, slopes, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def has_letter(text: str) -> bool:
    return any(found[0].isalpha() for found in _MAYBE_LETTER.finditer(text))


class Reader:
    """Reads windows with a trained network, with the gates' halves folded into the weights."""

    def __init__(self, net: Network):
        self.net, self.h = net, net.recur.shape[1]
        half = np.ones(3 * self.h, np.float32)
        half[: 2 * self.h] = 0.5  # sigmoid(x) = tanh(x / 2) / 2 + 1 / 2
        gate, new = slice(0, 2 * self.h), slice(2 * self.h, None)
        embed, self.recur = net.embed * half, net.recur * half
        self.embed_gate = np.ascontiguousarray(embed[..., gate]).reshape(512, -1)
        self.embed_new = np.ascontiguousarray(embed[..., new]).reshape(512, -1)
        self.recur_gate, self.recur_new = np.ascontiguousarray(self.recur[..., gate]), np.ascontiguousarray(self.recur[..., new])

    def positions(self, windows: np.ndarray) -> np.ndarray:
        """Probabilities [T, B, C] of each language at each position of ``windows`` [B, T]."""
        b, t_max = windows.shape
        h = self.h
        seen = _both_ways(windows).astype(np.intp)
        seen[:, 1] += 256
        hidden = np.zeros((t_max + 1, 2, b, h), np.float32)
        gate, new = np.empty((2, b, 2 * h), np.float32), np.empty((2, b, h), np.float32)
        for t in range(t_max):
            state, after = hidden[t], hidden[t + 1]
            np.take(self.embed_gate, seen[t], axis=0, out=gate, mode="clip")
            gate += state @ self.recur_gate
            np.tanh(gate, out=gate)
            gate *= 0.5
            gate += 0.5
            z, r = gate[..., :h], gate[..., h:]
            np.take(self.embed_new, seen[t], axis=0, out=new, mode="clip")
            u = state @ self.recur_new
            u *= r
            new += u
            np.tanh(new, out=new)
            np.subtract(state, new, out=after)
            after *= z
            after += new
        scores = hidden[1:, 0] @ self.net.out[0]
        scores += hidden[:0:-1, 1] @ self.net.out[1]
        scores += self.net.bias
        return _softmax(scores)

    def documents(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text."""
        datas = [(t or "").encode("utf-8", "replace").translate(_LOWER) if t and self.net.languages and has_letter(t) else b"" for t in texts]
        counts = np.array([-(-len(d) // WINDOW) for d in datas])
        if not counts.sum():
            return [(UNDETERMINED, 0.0)] * len(texts)
        rows = np.frombuffer(b"".join(d.ljust(c * WINDOW, b" ") for d, c in zip(datas, counts.tolist(), strict=True)), np.uint8).reshape(-1, WINDOW)
        ends = np.cumsum(counts)
        sizes = np.full(len(rows), WINDOW)
        some = counts > 0
        sizes[ends[some] - 1] = [len(d) - (c - 1) * WINDOW for d, c in zip(datas, counts.tolist(), strict=True) if c]
        sums = np.empty((len(rows), len(self.net.languages)))
        for start in range(0, len(rows), BLOCK):
            p = self.positions(rows[start : start + BLOCK])
            p *= (np.arange(WINDOW)[:, None] < sizes[None, start : start + BLOCK])[..., None]
            sums[start : start + BLOCK] = p.sum(axis=0)
        totals = np.add.reduceat(sums, (ends - counts)[some]) / np.array([len(d) for d in datas if d])[:, None]
        best = iter(zip(totals.argmax(axis=1).tolist(), totals.max(axis=1).tolist(), strict=True))
        out = []
        for has in some.tolist():
            if has:
                k, score = next(best)
                out.append((self.net.languages[k], min(1.0, max(0.0, score))))
            else:
                out.append((UNDETERMINED, 0.0))
        return out


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from; rows without doc_id are not either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def training_samples(docs: DataFrame) -> list[tuple[str, bytes]]:
    """A bounded sample of windows of labelled documents that are not held out, the same for the same table."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return []
    rank = F.xxhash64(F.lit(SEED), "doc_id")
    chance = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 3 * DOCS_PER_LANGUAGE / n))]), F.col("lang"))
    picked = labelled.withColumn("rank", rank).where(F.pmod("rank", F.lit(1 << 20)) < chance * (1 << 20))
    room = F.greatest(F.lit(1), F.length("text") - TRAIN_WINDOW)
    cuts = [F.substring(F.col("text"), (1 + F.pmod(F.xxhash64(F.lit(k), "doc_id"), room)).cast("int"), F.lit(TRAIN_WINDOW)) for k in range(WINDOWS_PER_DOC)]
    rows = sorted(picked.select("lang", "rank", F.array_distinct(F.array(*cuts)).alias("cuts")).collect(), key=lambda r: (r["lang"], r["rank"], r["cuts"]))
    used: dict[str, int] = {}
    out = []
    for r in rows:
        used[r["lang"]] = used.get(r["lang"], 0) + 1
        if used[r["lang"]] <= DOCS_PER_LANGUAGE:
            out += [(r["lang"], data) for c in r["cuts"] if (data := c.encode("utf-8", "replace").translate(_LOWER))]
    return out


def identify_languages(docs: DataFrame, net: Network) -> DataFrame:
    """``docs`` plus ``lang_pred`` and ``score`` (0 to 1), one row per row.

    Only ``text`` is read. ``lang_pred`` is a language that ``net`` has learned,
    or ``und`` with score 0 if the text is null, empty or without a letter, or
    if nothing was learned. Every byte of a text counts, however long it is.
    Equal texts get equal results; columns named like the new ones, in whatever
    case, are replaced. An empty table gives an empty result.
    """
    kept = docs.select(*[F.col(quoted(c)) for c in others(docs.columns, ("lang_pred", "score"))])
    schema = extended(kept.schema, "lang_pred string, score double")
    place = kept.columns.index("text")

    def run(batches):
        reader = Reader(net)
        for batch in batches:
            texts = batch.column(place).to_pylist()
            lo = size = 0
            found: list[tuple[str, float]] = []
            for k, text in enumerate(texts):
                size += len(text or "")
                if size > 500_000 or k == len(texts) - 1:
                    found += reader.documents(texts[lo : k + 1])
                    lo, size = k + 1, 0
            columns = [*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(run, schema)


def fit_languages(docs: DataFrame) -> Network:
    """Train on the driver on a bounded sample of ``docs`` (doc_id, text, lang)."""
    return train(training_samples(docs))


def accepted(score: Column, lang_pred: Column, least: float = 0.3) -> Column:
    """Documents of a determined language whose mean probability is not below ``least``."""
    return (lang_pred != UNDETERMINED) & (score >= least)
