"""Toxicity: a logistic classifier over words and word beginnings, regularised
with counterfactuals.

Counterfactuals are made from sentences of the labelled rows.  In one that names a
group of people the term gives way to every other of its kind; in any other, terms
of a kind are put in, so there are counterfactuals whatever the sentences name.  The
label stays, so the score should: squared changes of the score between two terms of a
kind are added to the loss.  What is said about a group can then count, the mention
of one cannot.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paceline.llm.common import ALNUM, text_blocks, widened, word_parts
from paceline.session import materialize

#: Labelled rows of each label the classifier is fitted on at most.
TRAIN_ROWS = 3000

#: Features kept at most, those whose shares among the two labels are farthest apart, and how
#: far apart they must be, in standard deviations, so that chance alone brings in next to none.
FEATURES, DEVIATIONS = 4000, 4.5

#: Lengths in bytes of word beginnings that count beside whole words.
BEGINNINGS = (4, 5, 6)

#: Labelled sentences that counterfactuals are made from at most, those of least hash.
SENTENCES = 400

#: Weights of the two penalties: size of the weights, and change under a swap.
L2, COUNTERFACTUAL = 1e-2, 100.0

STEPS, RATE = 400, 0.05

#: Terms for groups of people, by kind and language.  A term is swapped within its row.
GROUPS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys", "mothers", "fathers"),
    ("woman", "man", "girl", "boy", "mother", "father"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics"),
    ("black", "white", "asian", "african", "latino", "european", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender", "heterosexual"),
    ("immigrant", "citizen", "refugee", "foreigner", "local"),
    ("immigrants", "citizens", "refugees", "foreigners", "locals"),
    ("disabled", "blind", "deaf", "autistic", "elderly", "young", "old"),
    ("frauen", "männer", "mädchen", "jungen", "mütter", "väter"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten", "katholiken"),
    ("schwarze", "weiße", "asiatische", "afrikanische", "europäische", "arabische"),
    ("schwule", "lesbische", "bisexuelle", "heterosexuelle"),
    ("einwanderer", "bürger", "flüchtlinge", "ausländer", "einheimische"),
    ("behinderte", "blinde", "taube", "autistische", "alte", "junge"),
    ("femmes", "hommes", "filles", "garçons", "mères", "pères"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées", "catholiques"),
    ("noirs", "blancs", "asiatiques", "africains", "européens", "arabes"),
    ("gays", "lesbiennes", "bisexuels", "hétérosexuels"),
    ("immigrés", "citoyens", "réfugiés", "étrangers", "habitants"),
    ("handicapés", "aveugles", "sourds", "autistes", "vieux", "jeunes"),
    ("mujeres", "hombres", "niñas", "niños", "madres", "padres"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos", "católicos"),
    ("negros", "blancos", "asiáticos", "africanos", "europeos", "árabes"),
    ("gais", "lesbianas", "bisexuales", "heterosexuales"),
    ("inmigrantes", "ciudadanos", "refugiados", "extranjeros", "vecinos"),
    ("discapacitados", "ciegos", "sordos", "autistas", "viejos", "jóvenes"),
)
TERMS = tuple(t for g in GROUPS for t in g)


def features_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and word beginnings of each row (repeated ones too), and each one's row."""
    whole, beginnings, rows = word_parts(data, offsets, ALNUM, BEGINNINGS)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(rows))
    parts, owners = [whole], [owner]
    for hashes, there in beginnings:
        parts.append(hashes)
        owners.append(owner[there])
    return np.concatenate(parts), np.concatenate(owners)


def term_features(term: str) -> np.ndarray:
    raw = np.frombuffer(term.encode(), np.uint8)
    return np.unique(features_of(raw, np.array([0, len(raw)]))[0])


@dataclass
class Classifier:
    """Weights of sorted feature hashes; a row's score is the logistic of their sum."""

    features: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    #: Counterfactual pairs (of one sentence, with two terms of a kind) that the fit compared.
    swaps: int = 0

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        total = np.full(n, self.bias)
        if len(self.features):
            hashes, owner = features_of(data, offsets)
            # A small filter first: nearly all features of a text have no weight.
            maybe = np.zeros(1 << 20, bool)
            maybe[(self.features >> np.uint64(44)).astype(np.int64)] = True
            hit = np.flatnonzero(maybe[(hashes >> np.uint64(44)).astype(np.int64)])
            hashes, owner = hashes[hit], owner[hit]
            k = np.minimum(np.searchsorted(self.features, hashes), len(self.features) - 1)
            known = self.features[k] == hashes
            pair = np.unique(owner[known] * len(self.features) + k[known])
            total += np.bincount(pair // len(self.features), self.weights[pair % len(self.features)], n)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


@dataclass
class Counterfactuals:
    """Labelled sentences, and terms to put into them, by their features' columns.

    ``owner``, ``column``: which features the sentences have; ``kinds``: of each kind its
    terms' columns.
    """

    sentences: int
    owner: np.ndarray
    column: np.ndarray
    kinds: list[list[np.ndarray]]

    def pairs(self) -> int:
        return self.sentences * sum(len(k) * (len(k) - 1) // 2 for k in self.kinds)

    def penalty(self, w: np.ndarray, b: float) -> tuple[float, np.ndarray, float]:
        """Mean squared change of the score between two terms of a kind in one sentence, and its gradients."""
        n_features, total, gw, gb = len(w), 0.0, np.zeros(len(w)), 0.0
        pairs = self.pairs()
        plain = b + np.bincount(self.owner, w[self.column], self.sentences)
        for kind in self.kinds:
            held = np.zeros((len(kind), n_features), bool)
            for i, columns in enumerate(kind):
                held[i, columns] = True
            used = np.flatnonzero(held.any(axis=0))
            # A sentence's own terms of the kind give way to the one put in.
            own = np.isin(self.column, used)
            rest = plain - np.bincount(self.owner[own], w[self.column[own]], self.sentences)
            p = 1 / (1 + np.exp(-np.clip(rest[:, None] + (held[:, used] @ w[used])[None, :], -30, 30)))
            total += (len(kind) * (p**2).sum(axis=1) - p.sum(axis=1) ** 2).sum()
            d = 2 * (len(kind) * p - p.sum(axis=1, keepdims=True)) * p * (1 - p)
            gw[used] += held[:, used].T @ d.sum(axis=0)
            back = d.sum(axis=1)
            gw += np.bincount(self.column[~own], back[self.owner[~own]], n_features)
            gb += back.sum()
        return total / pairs, gw / pairs, gb / pairs


def fit_weights(
    owner: np.ndarray,
    column: np.ndarray,
    labels: np.ndarray,
    row_weights: np.ndarray,
    n_features: int,
    swaps: Counterfactuals | None,
    counterfactual: float = COUNTERFACTUAL,
) -> tuple[np.ndarray, float]:
    """Logistic loss on rows (``owner``, ``column``: which features they have) plus both penalties."""
    n = len(labels)
    w, b = np.zeros(n_features), float(np.log((row_weights[labels == 1].sum() + 0.5) / (row_weights[labels == 0].sum() + 0.5)))
    share = row_weights / row_weights.sum()
    m, v, mb, vb = np.zeros(n_features), np.zeros(n_features), 0.0, 0.0
    for t in range(1, STEPS + 1):
        z = b + np.bincount(owner, w[column], n)
        d = share * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels)
        g, gb = np.bincount(column, d[owner], n_features) + L2 * w / np.sqrt(n), d.sum()
        if swaps is not None and counterfactual and swaps.pairs():
            _, more, more_b = swaps.penalty(w, b)
            g, gb = g + counterfactual * more, gb + counterfactual * more_b
        m, v = m + 0.1 * (g - m), v + 0.001 * (g * g - v)
        mb, vb = mb + 0.1 * (gb - mb), vb + 0.001 * (gb * gb - vb)
        rate = RATE * (1 - t / (STEPS + 1))
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return w, b


def _row_features(sample: DataFrame) -> DataFrame:
    """(row, toxic, feature) of each distinct feature of a row."""

    def rows(batches):
        for batch in batches:
            key = np.asarray(batch.column("row"))
            toxic = np.asarray(batch.column("toxic"))
            for first, end, data, offsets in text_blocks(batch.column("text")):
                hashes, owner = features_of(data, offsets)
                order = np.lexsort((hashes, owner))
                hashes, owner = hashes[order], owner[order]
                new = np.ones(len(hashes), bool)
                new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
                hashes, owner = hashes[new], owner[new]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[first:end][owner]), pa.array(toxic[first:end][owner]), pa.array(hashes.view(np.int64))],
                    ["row", "toxic", "feature"],
                )

    return sample.mapInArrow(rows, "row bigint, toxic int, feature bigint")


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Classifier:
    """A classifier from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic 0 or 1).

    At most ``most`` rows of each label are learnt from, those of least text
    hash; how frequent the labels are is counted over all labelled rows.  Null
    texts and other labels are left out.  Without rows of both labels the
    classifier scores every text by the share of ones.
    """
    marked = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1))
    # Texts stay where they are: their hashes meet the labels.
    hashed = (
        docs.filter(F.col("text").isNotNull())
        .select("doc_id", F.xxhash64("text").alias("h"))
        .join(marked, "doc_id")
        .select("doc_id", "toxic", F.xxhash64("h", "toxic").alias("row"))
    )
    hashed = materialize(hashed, "labelled")
    totals = {r[0]: r[1] for r in hashed.groupBy("toxic").count().collect()}
    ones, zeros = totals.get(1, 0), totals.get(0, 0)
    if not ones or not zeros:
        return Classifier(bias=float(np.log((ones + 0.5) / (zeros + 0.5))))
    # Rows of equal text and label count once, so copies do not fill the sample.
    once = hashed.groupBy("toxic", "row").agg(F.min("doc_id").alias("doc_id"))
    picked = [once.filter(F.col("toxic") == k).orderBy("row").limit(most) for k in (0, 1)]
    # No more than 2 * most rows, so they can be sent to every task.
    chosen_rows = F.broadcast(picked[0].unionByName(picked[1]))
    sample = docs.select("doc_id", "text").join(chosen_rows, "doc_id").dropDuplicates(["row"])
    sample = materialize(sample.select("row", "toxic", "text").repartition(16, "row"), "toxic_sample")
    facts = materialize(_row_features(sample), "toxic_features")
    n = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    # How far a feature's share among ones is from that among zeros, in deviations.
    p1, p0 = (F.sum(F.when(F.col("toxic") == k, 1).otherwise(0)) for k in (1, 0))
    share = (F.col("p1") + F.col("p0")) / F.lit(n[0] + n[1])
    deviation = F.sqrt(share * (1 - share) * F.lit(1 / n[0] + 1 / n[1]))
    apart = F.try_divide(F.abs(F.col("p1") / F.lit(n[1]) - F.col("p0") / F.lit(n[0])), deviation)
    best = (
        facts.groupBy("feature")
        .agg(p1.alias("p1"), p0.alias("p0"))
        .withColumn("apart", apart)
        .filter(F.col("apart") >= DEVIATIONS)
        .orderBy(F.desc("apart"), "feature")
        .limit(FEATURES)
        .select("feature")
    )
    chosen = np.array([r[0] for r in best.collect()], np.int64).view(np.uint64)
    chosen = np.unique(np.concatenate([chosen, *[term_features(t) for t in TERMS]]))
    of_sample = facts.join(F.broadcast(docs.sparkSession.createDataFrame(pa.table({"feature": chosen.view(np.int64)}))), "feature")
    table = of_sample.select("row", "feature").toArrow()
    keys = sample.select("row", "toxic").toArrow()
    row_ids, labels = np.asarray(keys["row"]), np.asarray(keys["toxic"])
    order = np.argsort(row_ids)
    row_ids, labels = row_ids[order], labels[order]
    owner = np.searchsorted(row_ids, np.asarray(table["row"]))
    column = np.searchsorted(chosen, np.asarray(table["feature"]).view(np.uint64))
    # Sentences of the sample, those of least hash; each once, whatever it names.
    pieces = sample.select(F.explode(F.split("text", r"[.!?\n]+")).alias("s")).filter(F.length(F.trim("s")) > 0)
    sentences = [r[0] for r in pieces.select("s").distinct().orderBy(F.xxhash64("s"), "s").limit(SENTENCES).collect()]
    raw = [x.encode() for x in sentences]
    hashes, of = features_of(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    place = np.minimum(np.searchsorted(chosen, hashes), len(chosen) - 1)
    pair = np.unique(of[chosen[place] == hashes] * len(chosen) + place[chosen[place] == hashes])
    weights = np.where(labels == 1, ones / n[1], zeros / n[0])
    at = lambda t: np.searchsorted(chosen, term_features(t))
    # A mention also gives way to none.
    none = np.zeros(0, np.int64)
    swaps = Counterfactuals(len(raw), pair // len(chosen), pair % len(chosen), [[at(t) for t in kind] + [none] for kind in GROUPS])
    w, b = fit_weights(owner, column, labels, weights, len(chosen), swaps)
    return Classifier(chosen, w, b, swaps.pairs())


def score(docs: DataFrame, classifier: Classifier, text: str = "text") -> DataFrame:
    """``docs`` plus score (0 to 1) and predicted (1 from 0.5), off the text alone.

    Null and empty texts have no features and get the score of that.  Columns of
    these names are replaced; rows are independent.
    """
    own = [c for c in docs.columns if c not in ("score", "predicted")]
    source = docs.select(*[docs[c] for c in own], F.col(text).cast("string").alias("__text"))

    def rows(batches):
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for first, end, data, offsets in text_blocks(batch.column("__text")):
                scores[first:end] = classifier.scores(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in own], pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                [*own, "score", "predicted"],
            )

    schema = docs.select(*own).schema.add("score", "double").add("predicted", "integer")
    return widened(docs.sparkSession, source).mapInArrow(rows, schema)
