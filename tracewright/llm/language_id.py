"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths run over each window, every filter's
highest response in the window goes to a softmax over the labels.  The network is
trained in numpy, by Adam, on a bounded sample of labelled texts (``max_documents``
texts, ``windows_each`` windows of each) and applied to all consecutive windows
of fixed length of each whole text, in batches; the windows' probabilities are
averaged by their lengths.

A text that is null or has no letter is ``und`` with score 0, as is every text when
there was no labelled text to learn from.  Repeated rows get equal answers, an empty
table an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import give_back, modest_batches

UNKNOWN = "und"
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8
BLOCK = 128
TEXTS_AT_ONCE = 512
LEAST_STEPS = 300
HASH_STEPS = 1 << 30


@dataclass
class ByteConvNet:
    labels: list[str] = field(default_factory=list)
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, labels: Sequence[str], seed: int) -> ByteConvNet:
        rng = np.random.default_rng(seed)
        span, n = max(WIDTHS), len(WIDTHS) * FILTERS
        mask = np.zeros((span, EMBEDDING, n), dtype=np.float32)
        for i, width in enumerate(WIDTHS):  # narrower filters see the first bytes only
            mask[:width, :, i * FILTERS : (i + 1) * FILTERS] = 1
        w = {
            "embedding": rng.normal(0, 0.5, (257, EMBEDDING)),
            "mask": mask.reshape(span * EMBEDDING, n),
            "filters": rng.normal(0, (2 / (span * EMBEDDING)) ** 0.5, (span * EMBEDDING, n)) * mask.reshape(span * EMBEDDING, n),
            "bias": np.zeros(n),
            "out": rng.normal(0, 0.1, (n, len(labels))),
            "out_bias": np.zeros(len(labels)),
        }
        return cls(list(labels), {k: v.astype(np.float32) for k, v in w.items()})

    def pooled(self, codes: np.ndarray, places: bool = False):
        """Highest responses (at least 0) of a batch of windows, and where they are; codes: 1 to 256, 0 beyond the end."""
        w = self.weights
        n, length = codes.shape
        span = max(WIDTHS)
        embedded = w["embedding"][codes].reshape(n, length * EMBEDDING)
        steps = length - span + 1
        view = np.lib.stride_tricks.as_strided(embedded, (n, steps, span * EMBEDDING), (embedded.strides[0], EMBEDDING * embedded.itemsize, embedded.itemsize))
        columns = np.ascontiguousarray(view).reshape(n * steps, span * EMBEDDING)
        responses = (columns @ w["filters"]).reshape(n, steps, -1)
        if places:
            at = responses.argmax(1)
            best = np.take_along_axis(responses, at[:, None], 1)[:, 0] + w["bias"]
            return np.maximum(best, 0), at, columns.reshape(n, steps, -1)
        return np.maximum(responses.max(1) + w["bias"], 0)

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        logits = self.pooled(codes) @ self.weights["out"] + self.weights["out_bias"]
        e = np.exp(logits - logits.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def gradients(self, codes: np.ndarray, gold: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        hidden, at, columns = self.pooled(codes, places=True)
        logits = hidden @ w["out"] + w["out_bias"]
        e = np.exp(logits - logits.max(1, keepdims=True))
        d = e / e.sum(1, keepdims=True)
        d[np.arange(len(gold)), gold] -= 1
        d /= len(gold)
        g = {"out": hidden.T @ d, "out_bias": d.sum(0)}
        dh = (d @ w["out"].T) * (hidden > 0)
        g["bias"] = dh.sum(0)
        seen = np.take_along_axis(columns, at[:, :, None], 1)  # only the best place of each filter gets a gradient
        g["filters"] = np.einsum("nfk,nf->kf", seen, dh) * w["mask"]
        dcol = (dh[:, :, None] * w["filters"].T[None]).reshape(*at.shape, max(WIDTHS), EMBEDDING)
        g["embedding"] = np.zeros_like(w["embedding"])
        for j in range(max(WIDTHS)):
            np.add.at(g["embedding"], np.take_along_axis(codes, at + j, 1), dcol[:, :, j])
        g["embedding"][0] = 0
        return g

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Label and score of each whole text."""
        owners, rows, sizes = [], [], []
        held = 0
        total = np.zeros((len(texts), len(self.labels)))
        weight = np.zeros(len(texts))

        def flush() -> None:
            for i in range(0, len(rows), BLOCK):
                p = self.probabilities(np.stack(rows[i : i + BLOCK]))
                own, size = np.array(owners[i : i + BLOCK]), np.array(sizes[i : i + BLOCK])
                np.add.at(total, own, p * size[:, None])
                np.add.at(weight, own, size)
            owners.clear(), rows.clear(), sizes.clear()

        for i, t in enumerate(texts):
            if not self.labels or t is None or not has_letter(t):
                continue
            codes, lengths = windows(t)
            owners += [i] * len(codes)
            rows.extend(codes)
            sizes += lengths
            held += len(codes)
            if held >= 16 * BLOCK:
                flush()
                held = 0
        flush()
        names, scores = [], []
        for i in range(len(texts)):
            best = int(total[i].argmax()) if weight[i] else -1
            names.append(self.labels[best] if weight[i] else UNKNOWN)
            scores.append(float(min(1.0, total[i][best] / weight[i])) if weight[i] else 0.0)
        return names, scores


def has_letter(text: str) -> bool:
    """Whether a text has a letter; digits, fractions and number signs are none."""
    return any(map(str.isalpha, text))


def windows(text: str) -> tuple[np.ndarray, list[int]]:
    """All consecutive windows of a text's bytes as codes, the last filled up with 0, and their lengths."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    n = max(1, -(-len(data) // WINDOW))
    codes = np.zeros(n * WINDOW, dtype=np.int16)
    codes[: len(data)] = data
    codes[: len(data)] += 1
    return codes.reshape(n, WINDOW), [WINDOW] * (n - 1) + [len(data) - (n - 1) * WINDOW]


def pieces_of(text: str, windows_each: int, seed: int) -> list[bytes]:
    """Windows at random places of a text, some of them short."""
    rng = np.random.default_rng(seed)
    data, out = text.encode(), []
    for _ in range(min(windows_each, 1 + len(data) // WINDOW)):
        size = WINDOW if rng.random() < 0.6 else int(rng.integers(8, WINDOW))
        at = int(rng.integers(0, max(1, len(data) - size + 1)))
        out.append(data[at : at + size])
    return out


def fit(pieces: Sequence[Sequence[bytes]], labels: Sequence[str], epochs: int = 5, seed: int = 7) -> ByteConvNet:
    """Trains on windows of labelled texts."""
    if not pieces:
        return ByteConvNet()
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    net = ByteConvNet.fresh(names, seed)
    codes, gold = [], []
    for own, label in zip(pieces, labels, strict=True):
        for piece in own:
            row = np.zeros(WINDOW, dtype=np.int16)
            row[: len(piece)] = np.frombuffer(piece, dtype=np.uint8)
            row[: len(piece)] += 1
            codes.append(row)
            gold.append(names.index(label))
    x, y = np.stack(codes), np.array(gold)
    slow = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.weights.items() if k != "mask"}
    step = 0
    epochs = max(epochs, -(-LEAST_STEPS * BLOCK // len(x)))
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(order), BLOCK):
            step += 1
            pick = order[i : i + BLOCK]
            rate = 0.01 * 0.5 ** (5 * epoch / epochs)
            for k, g in net.gradients(x[pick], y[pick]).items():
                m, v = slow[k]
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                net.weights[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    net.weights["embedding"][0] = 0
    return net


def sample(df: DataFrame, key: str, text: str, label: str, max_documents: int, windows_each: int) -> tuple[list[list[bytes]], list[str]]:
    """Windows and labels of at most max_documents texts with a letter, chosen by a hash of the key.

    Windows are cut where the texts are; at most windows_each of WINDOW bytes of a text come to the driver.
    """
    labelled = df.where(F.col(label).isNotNull())
    share = min(1.0, 1.5 * max_documents / max(1, labelled.count()))
    place = F.pmod(F.xxhash64(F.col(key), F.lit(11)), F.lit(HASH_STEPS))

    @F.arrow_udf("array<binary>")
    def cut(texts: pa.Array, places: pa.Array) -> pa.Array:
        found = [pieces_of(t, windows_each, i) if t is not None and has_letter(t) else None for t, i in zip(texts.to_pylist(), places.to_pylist(), strict=True)]
        return pa.array(found, pa.list_(pa.binary()))

    chosen = labelled.where(place < int(share * HASH_STEPS)).select(place.alias("place"), key, text, label)
    cuts = chosen.select("place", key, cut(F.col(text), F.col("place")).alias("pieces"), F.col(label).alias("label")).where("pieces IS NOT NULL")
    rows = cuts.orderBy("place", key, "label", "pieces").limit(max_documents).collect()
    return [[bytes(p) for p in r["pieces"]] for r in rows], [r["label"] for r in rows]


def predict(df: DataFrame, net: ByteConvNet, text: str = "text") -> DataFrame:
    """Adds lang_pred and score; columns of these names are replaced."""
    modest_batches(df.sparkSession)
    kind = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.arrow_udf(kind)
    def judge(texts: pa.Array) -> pa.Array:
        labels, scores = [], []
        for i in range(0, len(texts), TEXTS_AT_ONCE):
            found = net.predict(texts[i : i + TEXTS_AT_ONCE].to_pylist())
            labels += found[0]
            scores += found[1]
        give_back()
        return pa.StructArray.from_arrays([pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    # the texts alone go to Python, and nothing but answers comes back
    own = [c for c in df.columns if c not in ("lang_pred", "score")]
    mark = "judged_" + "_" * max(map(len, own))  # longer than any name there
    judged = df.select(*own, judge(F.col(text)).alias(mark))
    return judged.select(*own, f"{mark}.lang_pred", f"{mark}.score")


def held_out(key: str = "doc_id"):
    """Rows that nothing is learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def trained(docs: DataFrame, max_documents: int = 3000, windows_each: int = 6) -> ByteConvNet:
    """The network that learns from the rows of documents that aren't held out."""
    learned = docs.where(~held_out() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")
    return fit(*sample(learned, "doc_id", "text", "lang", max_documents, windows_each))
