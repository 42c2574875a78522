"""Language identification with a bidirectional gated recurrent network over bytes.

A text's UTF-8 bytes are cut into windows. Inside a window one gated recurrent layer reads the bytes
forwards and one backwards, with softsign as squashing function; at every position both states give a probability per language. The
probabilities of all positions of all windows of a document are averaged: the largest average names
the language and is the score. The network is small, so that a corpus is read at disk speed, and is
trained on the driver in numpy by backpropagation through time.

Training reads a *bounded sample*: about ``PER_LANGUAGE`` distinct texts of each language, chosen by
text hash, with ``PIECES`` windows from anywhere in each. Prediction reads every byte of every text,
in blocks of windows, so memory does not grow with a text.

Defined results: a null text, or one without any letter, is ``und`` with score 0; with no training
documents every text is. Rows with a null doc_id are not held out. Repeated rows are predicted alike.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import row_hash, table

#: Bytes of a window; units of each direction.
WINDOW, HIDDEN = 128, 8
#: Size of the training sample: texts of a language, windows of a text.
PER_LANGUAGE, PIECES = 300, 4
EPOCHS, BATCH, RATE, SEED = 5, 128, 0.02, 7
#: Windows read at a time by prediction, and rows whose texts are held at once.
BLOCK, ROWS = 2048, 512
#: Fills windows; the byte never occurs in UTF-8.
PAD = 255


@dataclass
class Network:
    """Both directions of the layer, stacked on the first axis; gates are reset, update, candidate.

    ``x`` (2, 3H, 256) are input weights of each byte with the bias, ``u`` (2, 3H, H) recurrent weights,
    ``c`` (2, H) the recurrent bias of the candidate, ``v`` (2, L, H) and ``b`` (L) give the languages.
    """

    languages: list[str]
    x: np.ndarray
    u: np.ndarray
    c: np.ndarray
    v: np.ndarray
    b: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.x, self.u, self.c, self.v, self.b]


def fresh(languages: list[str], hidden: int = HIDDEN, seed: int = SEED) -> Network:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
    return Network(
        languages,
        draw(2, 3 * hidden, 256, s=0.3),
        draw(2, 3 * hidden, hidden, s=hidden**-0.5),
        np.zeros((2, hidden), np.float32),
        draw(2, len(languages), hidden, s=hidden**-0.5),
        np.zeros(len(languages), np.float32),
    )


def windows(text: bytes, size: int = WINDOW) -> np.ndarray:
    """The bytes as rows of a (windows, size) array, filled up with PAD."""
    padded = text + bytes([PAD]) * (-len(text) % size)
    return np.frombuffer(padded, np.uint8).reshape(-1, size)


def _softsign(a: np.ndarray) -> np.ndarray:
    """a / (1 + |a|): a squashing function like tanh, with slope (1 - |s|)², at a fifth of its cost."""
    return a / (1 + np.abs(a))


def _softmax(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def position_probabilities(net: Network, block: np.ndarray) -> np.ndarray:
    """(size, L, windows): the languages' probabilities at every position of a block of windows."""
    hidden, count, size = net.u.shape[2], len(block), block.shape[1]
    x, u, c = net.x, net.u.copy(), (net.c * 0.5)[:, :, None]
    u[:, 2 * hidden :] *= 0.5  # the half of the reset gate's (1 + s) / 2
    steps = np.ascontiguousarray(block.T)
    h = np.zeros((2, hidden, count), np.float32)
    own, out = np.empty((2, 3 * hidden, count), np.float32), np.empty((2, len(net.languages), count), np.float32)
    fed = np.empty_like(own)
    logits = np.zeros((size, len(net.languages), count), np.float32)
    for t in range(size):
        np.take(x[0], steps[t], axis=1, out=fed[0], mode="clip")
        np.take(x[1], steps[size - 1 - t], axis=1, out=fed[1], mode="clip")
        np.matmul(u, h, out=own)
        gates, size_of = fed[:, : 2 * hidden], own[:, : 2 * hidden]
        gates += size_of
        np.abs(gates, out=size_of)
        size_of += 1
        gates /= size_of
        turn, keep = gates[:, :hidden], gates[:, hidden:]
        memory, new = own[:, 2 * hidden :], fed[:, 2 * hidden :]
        memory += c
        new += memory
        memory *= turn
        new += memory
        np.abs(new, out=memory)
        memory += 1
        new /= memory
        h -= new
        keep += 1
        h *= keep
        h *= 0.5
        h += new
        np.matmul(net.v, h, out=out)
        logits[t] += out[0]
        logits[size - 1 - t] += out[1]
    logits += net.b[None, :, None]
    return _softmax(logits)


def _gradients(net: Network, block: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean loss over all positions that hold a byte, and its gradients by backpropagation through time."""
    hidden, count, size = net.u.shape[2], len(block), block.shape[1]
    steps = np.stack([block.T, block.T[::-1]], axis=1)  # (size, 2, windows)
    real = (steps[:, 0] != PAD).astype(np.float32)
    h = np.zeros((2, hidden, count), np.float32)
    kept = []
    logits = np.zeros((size, len(net.languages), count), np.float32)
    for t in range(size):
        fed = np.stack([net.x[k][:, steps[t, k]] for k in (0, 1)])
        own = net.u @ h
        gates = (1 + _softsign(fed[:, : 2 * hidden] + own[:, : 2 * hidden])) / 2
        memory = own[:, 2 * hidden :] + net.c[:, :, None]
        new = _softsign(fed[:, 2 * hidden :] + gates[:, :hidden] * memory)
        after = new + gates[:, hidden:] * (h - new)
        kept.append((h, gates, memory, new, after))
        h = after
        out = net.v @ h
        logits[t] += out[0]
        logits[size - 1 - t] += out[1]
    probs = _softmax(logits + net.b[None, :, None])
    rows = np.arange(count)
    loss = float(-(np.log(probs[:, target, rows] + 1e-9) * real).sum() / real.sum())
    error = probs
    error[:, target, rows] -= 1
    error *= (real / real.sum())[:, None, :]
    g = [np.zeros_like(p) for p in net.parts()]
    g[4] = error.sum(axis=(0, 2))
    back = np.zeros_like(h)
    for t in range(size - 1, -1, -1):
        before, gates, memory, new, after = kept[t]
        e = np.stack([error[t], error[size - 1 - t]])
        g[3] += e @ after.transpose(0, 2, 1)
        back = back + net.v.transpose(0, 2, 1) @ e
        turn, keep = gates[:, :hidden], gates[:, hidden:]
        slope = (1 - np.abs(2 * gates - 1)) ** 2 / 2
        into_new = back * (1 - keep) * (1 - np.abs(new)) ** 2
        into_keep = back * (before - new) * slope[:, hidden:]
        into_turn = into_new * memory * slope[:, :hidden]
        into_memory = into_new * turn
        fed = np.concatenate([into_turn, into_keep, into_new], axis=1)
        own = np.concatenate([into_turn, into_keep, into_memory], axis=1)
        g[2] += into_memory.sum(axis=2)
        g[1] += own @ before.transpose(0, 2, 1)
        for k in (0, 1):
            order = np.argsort(steps[t, k], kind="stable")
            byte, at = np.unique(steps[t, k][order], return_index=True)
            g[0][k][:, byte] += np.add.reduceat(fed[k][:, order], at, axis=1)
        back = back * keep + net.u.transpose(0, 2, 1) @ own
    return loss, g


def train(samples: list[tuple[str, bytes]], epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE, hidden: int = HIDDEN, seed: int = SEED) -> Network | None:
    """A network fitted to (language, bytes of one window) pairs, with Adam; None without samples."""
    samples = [(lang, raw) for lang, raw in samples if raw]
    if not samples:
        return None
    languages = sorted({lang for lang, _ in samples})
    net = fresh(languages, hidden, seed)
    block = np.concatenate([windows(raw[:WINDOW]) for _, raw in samples])
    target = np.array([languages.index(lang) for lang, _ in samples])
    rng, step = np.random.default_rng(seed), 0
    first, second = ([np.zeros_like(p) for p in net.parts()] for _ in range(2))
    total = epochs * -(-len(block) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(block))
        for at in range(0, len(order), batch):
            step += 1
            pick = order[at : at + batch]
            _, grads = _gradients(net, block[pick], target[pick])
            norm = float(np.sqrt(sum((g * g).sum() for g in grads)))
            now = rate * (1 - step / (total + 1))
            for p, g, m, s in zip(net.parts(), grads, first, second, strict=True):
                g = g * min(1.0, 1 / (norm + 1e-9))
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= (now * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, pieces: int = PIECES) -> list[tuple[str, bytes]]:
    """(language, bytes) windows of about ``per_language`` distinct texts of each language, none held out.

    The number of rows that reach the driver depends on the parameters and the number of languages
    only: texts are drawn by a hash rate and repeated texts are folded before.
    """
    known = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out(F.col("doc_id")))
    known = known.select("lang", "text", row_hash(F.col("text")).alias("h"))
    rates = {r["lang"]: 1.5 * per_language / max(r["n"], 1) for r in known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not rates:
        return []
    rate = F.element_at(F.create_map(*[F.lit(x) for pair in rates.items() for x in pair]), F.col("lang"))
    size = F.length("text")
    cut = [F.substring("text", F.pmod(F.xxhash64("text", F.lit(k)), F.greatest(size - WINDOW, F.lit(1))).cast("int") + 1, F.lit(WINDOW)) for k in range(pieces)]
    drawn = known.where(F.shiftrightunsigned("h", 32) < rate * float(1 << 32))
    rows = drawn.select("lang", "h", F.array(*cut).alias("cut")).dropDuplicates(["lang", "h"]).collect()
    taken: dict[str, int] = {}
    out = []
    for r in sorted(rows, key=lambda r: (r["lang"], r["h"])):
        taken[r["lang"]] = taken.get(r["lang"], 0) + 1
        if taken[r["lang"]] <= per_language:
            out += [(r["lang"], piece.encode()[:WINDOW]) for piece in r["cut"]]
    return out


def _pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """(texts, L): the average over all positions of each text of the languages' probabilities."""
    total, positions = np.zeros((len(texts), len(net.languages))), np.array([max(len(t), 1) for t in texts])

    def add(rows: list[np.ndarray], owner: list[int]) -> None:
        block = np.concatenate(rows)
        probs = position_probabilities(net, block)
        probs *= (block.T != PAD)[:, None, :]
        np.add.at(total, np.repeat(owner, [len(r) for r in rows]), probs.sum(axis=0).T)

    rows, owner, held = [], [], 0
    for k, text in enumerate(texts):
        for at in range(0, len(text), BLOCK * WINDOW):
            rows.append(windows(text[at : at + BLOCK * WINDOW]))
            owner.append(k)
            held += len(rows[-1])
            if held >= BLOCK:
                add(rows, owner)
                rows, owner, held = [], [], 0
    if rows:
        add(rows, owner)
    return total / positions[:, None]


def predict(docs: DataFrame, net: Network | None, keep: tuple[str, ...] = ("doc_id",), pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """The columns ``keep`` of ``docs``, and language and score of every row under the names ``pred`` and ``score``."""

    def of(texts: list[str | None]) -> tuple[list[str], list[float]]:
        lettered = [k for k, t in enumerate(texts) if net and t and any(map(str.isalpha, t))]
        langs, scores = ["und"] * len(texts), [0.0] * len(texts)
        if lettered:
            probs = _pooled(net, [texts[k].encode() for k in lettered])
            for k, best, top in zip(lettered, probs.argmax(axis=1).tolist(), probs.max(axis=1).tolist(), strict=True):
                langs[k], scores[k] = net.languages[best], min(1.0, top)
        return langs, scores

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                cut = batch.slice(at, ROWS)
                langs, scores = of(cut.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([*cut.columns[1:], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, pred, score])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    given = docs.select(F.col("text").alias(f"{pred}_text"), *[F.col(f"`{c}`") for c in keep])
    return given.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, train(sample(docs)))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
