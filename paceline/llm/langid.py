"""Language identification by a byte convolutional network.

Filters of several widths run over the bytes of fixed-length windows, the
largest response of each filter in a window is kept, and a softmax over those
gives the window's language.  A text is judged by all its windows together.
The network is trained in numpy on a bounded sample of labelled texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paceline.llm.common import text_blocks, widened

#: Bytes in a window, filter widths, filters of each width, numbers that stand for a byte.
LENGTH, WIDTHS, FILTERS, EMBEDDING = 256, (2, 3, 4), 16, 8

#: Labelled texts of each language the network is fitted on at most, and windows of each of them.
TRAIN_TEXTS, TRAIN_WINDOWS = 500, 4

#: Steps of the optimiser, whatever the sample; after each EASE of them the rate falls.
STEPS, EASE, BATCH, RATE, SEED = 500, 63, 128, 0.01, 7

#: Bytes of one text that are cut into windows at a time, a multiple of LENGTH.
PART = 1024 * LENGTH

#: Shares of a language whose least hashes are found apart before they meet.
SPREAD = 64

UNDETERMINED = "und"

_LETTER = regex.compile(r"\p{L}")


def windows_of(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(length x windows) bytes, texts cut end to end and filled up with 0, and each window's text."""
    sizes = np.diff(offsets)
    each = -(-sizes // length)
    text = np.repeat(np.arange(len(sizes)), each)
    first = np.repeat(np.cumsum(each) - each, each)
    start = offsets[:-1][text] + (np.arange(len(text)) - first) * length
    at = start[None, :] + np.arange(length)[:, None]
    padded = np.append(data, np.uint8(0))
    return padded[np.where(at < offsets[1:][text][None, :], at, len(data))], text


@dataclass
class Network:
    """Weights: a vector per byte, filters per width, and the softmax over their maxima."""

    languages: list[str]
    bytes_: np.ndarray
    filters: list[np.ndarray]  # (width * EMBEDDING, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    @classmethod
    def random(cls, languages: list[str]) -> Network:
        r = np.random.default_rng(SEED)
        f = lambda *shape: r.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        return cls(
            languages,
            r.normal(0, 0.5, (256, EMBEDDING)).astype(np.float32),
            [f(w * EMBEDDING, FILTERS) for w in WIDTHS],
            [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
            f(FILTERS * len(WIDTHS), len(languages)),
            np.zeros(len(languages), np.float32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [self.bytes_, *self.filters, *self.bias, self.out, self.out_bias]

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss and gradients on windows ``x`` (n x LENGTH) of languages ``y``.

        Only the place of a filter's largest response gets a gradient.
        """
        n = len(x)
        e = self.bytes_[x]
        hidden, places = [], []
        for w, f, b in zip(WIDTHS, self.filters, self.bias, strict=True):
            spans = np.concatenate([e[:, j : x.shape[1] - w + 1 + j] for j in range(w)], axis=2)
            z = spans @ f + b
            place = z.argmax(axis=1)
            hidden.append(np.take_along_axis(z, place[:, None], axis=1)[:, 0])
            places.append(place)
        h = np.concatenate(hidden, axis=1)
        a = np.maximum(h, 0)
        p = _softmax(a @ self.out + self.out_bias)
        loss = -np.log(p[np.arange(n), y] + 1e-9).mean()
        dz = p.copy()
        dz[np.arange(n), y] -= 1
        dz /= n
        dh = (dz @ self.out.T) * (h > 0)
        d_bytes = np.zeros_like(self.bytes_)
        d_filters, d_bias = [], []
        rows = np.arange(n)[:, None]
        for k, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            d = dh[:, k * FILTERS : (k + 1) * FILTERS]
            parts = []
            for j in range(w):
                symbol = x[rows, places[k] + j]  # n x FILTERS
                parts.append(np.einsum("nf,nfe->ef", d, self.bytes_[symbol]))
                push = d[:, :, None] * f[j * EMBEDDING : (j + 1) * EMBEDDING].T[None]
                np.add.at(d_bytes, symbol.ravel(), push.reshape(-1, EMBEDDING))
            d_filters.append(np.concatenate(parts))
            d_bias.append(d.sum(axis=0))
        return float(loss), [d_bytes, *d_filters, *d_bias, a.T @ dz, dz.sum(axis=0)]

    def tables(self) -> list[np.ndarray]:
        """The filters' responses to pairs of bytes, and to single ones, in place of sums over vectors.

        The same function as ``step`` computes; two bytes cost one look-up.
        """
        single = [
            [self.bytes_ @ f[j * EMBEDDING : (j + 1) * EMBEDDING] for j in range(w)]
            for w, f in zip(WIDTHS, self.filters, strict=True)
        ]
        out = []
        for w, s, b in zip(WIDTHS, single, self.bias, strict=True):
            row = []
            for j in range(0, w - 1, 2):
                row.append((s[j][:, None] + s[j + 1][None, :] + (b if j == 0 else 0)).reshape(65536, FILTERS))
            if w % 2:
                row.append(s[-1])
            out.append(row)
        return out

    def log_odds(self, windows: np.ndarray, tables: list, block: int = 64) -> np.ndarray:
        """Log-probability of each language for each window (a column of ``windows``)."""
        done = []
        for at in range(0, windows.shape[1], block):
            x = windows[:, at : at + block].astype(np.int32)
            pairs = x[:-1] * 256 + x[1:]
            hidden = []
            for w, row in zip(WIDTHS, tables, strict=True):
                n = x.shape[0] - w + 1
                z = row[0].take(pairs[:n], axis=0)
                for j in range(1, len(row)):
                    z += row[j].take((pairs if len(row[j]) == 65536 else x)[2 * j : 2 * j + n], axis=0)
                hidden.append(z.max(axis=0))
            a = np.maximum(np.concatenate(hidden, axis=1), 0)
            done.append(np.log(_softmax(a @ self.out + self.out_bias) + 1e-6))
        return np.concatenate(done) if done else np.zeros((0, len(self.languages)))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], languages: list[str]) -> Network:
    """STEPS steps of Adam on the first LENGTH bytes of each text, round after round in a new order."""
    names = sorted(set(languages))
    net = Network.random(names)
    r = np.random.default_rng(SEED)
    xs, ys = [], []
    for text, language in zip(texts, languages, strict=True):
        raw = np.frombuffer(text.encode(), np.uint8)[:LENGTH]
        xs.append(np.pad(raw, (0, LENGTH - len(raw))))
        ys.append(names.index(language))
    x, y = np.array(xs), np.array(ys)
    first = [np.zeros_like(p) for p in net.parameters()]
    second = [np.zeros_like(p) for p in net.parameters()]
    order = np.zeros(0, np.int64)
    for t in range(1, STEPS + 1):
        while len(order) < min(BATCH, len(x)):
            order = np.concatenate([order, r.permutation(len(x))])
        pick, order = order[:BATCH], order[BATCH:]
        _, gradients = net.step(x[pick], y[pick])
        for p, g, m, v in zip(net.parameters(), gradients, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= RATE / (1 + (t - 1) // EASE) ** 0.5 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-7)
    return net


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", most: int = TRAIN_TEXTS) -> Network | None:
    """A network from at most ``most`` rows of each language, with a letter; None if there are none.

    The sample is a language's rows of least hash, the same whatever the partitions, so a
    rare language is learnt from all its rows.  Of each row, TRAIN_WINDOWS windows at places
    its hash gives are sent to the driver.
    """
    rows = (
        labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang"))
        .filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
        .withColumn("h", F.xxhash64("text", "lang"))
    )
    # Copies count once, so a text that fills the table does not fill the sample.
    hashes = rows.select("lang", "h").distinct().withColumn("share", F.pmod("h", F.lit(SPREAD)))
    some = hashes.withColumn("n", F.row_number().over(Window.partitionBy("lang", "share").orderBy("h"))).filter(F.col("n") <= most)
    least = some.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("n") <= most).select("h")
    start = lambda k: F.pmod(F.xxhash64("h", F.lit(k)), F.greatest(F.lit(1), F.length("text") - LENGTH)) + 1
    pieces = F.array_distinct(F.array(*[F.substring("text", start(k), F.lit(LENGTH)) for k in range(TRAIN_WINDOWS)]))
    sample = (
        rows.join(F.broadcast(least), "h", "left_semi")  # no more than ``most`` rows a language
        .select("h", "lang", pieces.alias("pieces"))
        .dropDuplicates(["h"])
        .select("h", "lang", F.posexplode("pieces"))
        .orderBy("h", "pos")
        .select("col", "lang")
        .collect()
    )
    return train([r[0] for r in sample], [r[1] for r in sample]) if sample else None


def identify(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """``docs`` plus lang_pred and score, off the text alone.

    Null texts and texts without a letter are ``und`` with score 0, and so is
    everything when no network could be trained.  The windows' mean
    log-probability decides; score is its share among the languages.  Columns of
    these names are replaced.
    """
    own = [c for c in docs.columns if c not in ("lang_pred", "score")]
    source = docs.select(*[docs[c] for c in own], F.col(text).cast("string").alias("__text"))

    def rows(batches):
        tables = net.tables() if net else None
        names = np.array([*net.languages, UNDETERMINED] if net else [UNDETERMINED], dtype=object)
        for batch in batches:
            best = np.full(batch.num_rows, len(names) - 1)
            score = np.zeros(batch.num_rows)
            if net:
                column = batch.column("__text")
                for first, end, data, offsets in text_blocks(column):
                    n = end - first
                    total, seen = np.zeros((n, len(net.languages))), np.zeros(n)
                    # A long text is a block by itself and is read some windows at a time.
                    step = PART if n == 1 else max(PART, len(data))
                    for at in range(0, max(1, len(data)), step):
                        windows, owner = windows_of(data[at : at + step], np.clip(offsets - at, 0, min(step, len(data) - at)))
                        logs = net.log_odds(windows, tables)
                        total += np.stack([np.bincount(owner, logs[:, k], n) for k in range(logs.shape[1])], axis=1)
                        seen += np.bincount(owner, minlength=n)
                    p = _softmax(total / np.maximum(1, seen)[:, None])
                    best[first:end], score[first:end] = p.argmax(axis=1), p.max(axis=1)
                no = [i for i, t in enumerate(column.to_pylist()) if not t or not _LETTER.search(t)]
                best[no], score[no] = len(names) - 1, 0
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in own], pa.array(names[best].tolist(), pa.string()), pa.array(score)],
                [*own, "lang_pred", "score"],
            )

    schema = docs.select(*own).schema.add("lang_pred", "string").add("score", "double")
    return widened(docs.sparkSession, source).mapInArrow(rows, schema)


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept out of training: crc32 of its id as text, modulo 5, is 0 (no id: no)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))
