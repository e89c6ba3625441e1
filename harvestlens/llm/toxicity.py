"""Toxicity: a logistic classifier trained with a counterfactual penalty.

Features are words and their beginnings (presence, not counts), so the length of a text does not matter and one insult in a
long text weighs as much as in a short one. Words are screened first: those stay whose share of toxic
texts differs from the overall share by more than chance explains over all words tested. Training
sentences that name a group are paired with copies in which the name is swapped for another; besides the
usual loss, the squared change of the score between a sentence and its copies is penalised. A group
name then cannot carry the label, and neutral mentions are not taken for toxic ones.

The classifier is fitted in one task on a bounded sample of labelled rows. It keeps at most ``FEATURES``
words, is broadcast, and scores every text where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestlens.llm import common
from harvestlens.session import cut

TRAINING_ROWS = 20_000  # labelled rows that train the model, at most; drawn by a hash of their id
FEATURES = 1_000  # words that a model may hold; the most telling ones
PREFIXES = (4, 5, 6, 7)  # beginnings of words, in bytes, that are features beside the word
MIN_DOCUMENTS = 3  # a word is tested if at least so many training texts hold it
CHANCE = 0.05  # expected number of words that pass the screening without telling anything
SWAPS = 2  # swapped copies of a sentence that names a group
PENALTY = 10.0  # weight of the squared change of the logit under a swap
RIDGE = 1.0
STEPS = 25
# Names of groups in the languages of the corpus, lower case, one word each; names in one row replace each other.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "gay", "straight", "lesbian", "transgender", "black", "white", "asian",
     "latino", "african", "european", "american", "mexican", "jewish", "muslim", "christian", "hindu", "buddhist",
     "atheist", "immigrants", "refugees", "disabled", "blind", "deaf", "elderly", "young"),
    ("frauen", "männer", "mädchen", "jungen", "schwule", "lesben", "schwarze", "weiße", "juden", "muslime",
     "christen", "türken", "migranten", "flüchtlinge", "behinderte"),
    ("femmes", "hommes", "filles", "garçons", "gays", "lesbiennes", "noirs", "blancs", "juifs", "musulmans",
     "chrétiens", "arabes", "immigrés", "réfugiés", "handicapés"),
    ("mujeres", "hombres", "chicas", "chicos", "gais", "lesbianas", "negros", "blancos", "judíos", "musulmanes",
     "cristianos", "gitanos", "inmigrantes", "refugiados", "discapacitados"),
)
_MARKS = b".,;:!?\"'()[]{}*#$%&|-_/"
_PLAIN = bytes.maketrans(bytes(range(65, 91)) + _MARKS, bytes(range(97, 123)) + b" " * len(_MARKS))


def plain(text: bytes) -> bytes:
    """A-Z in lower case, ASCII punctuation as spaces."""
    return text.translate(_PLAIN)


def _hash(words: list[str]) -> np.ndarray:
    return common.Words([" ".join(words).encode()]).hashes()


_GROUPS = [_hash(list(row)) for row in IDENTITY_TERMS]


def features(words: common.Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and of their beginnings, and the text that each stands in."""
    found = words.prefix_hashes([None, *PREFIXES])
    return np.concatenate([h for h, _ in found]), words.text[np.concatenate([at for _, at in found])]


def word_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The distinct feature hashes of each text."""
    plains = [plain(t) for t in texts]
    for part in common.batches(plains):
        words = common.Words(plains[part])
        hashes, text = features(words)
        order = np.argsort(text, kind="stable")
        cuts = np.searchsorted(text[order], np.arange(len(words.count) + 1))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield np.unique(hashes[order[a:b]])


def swapped_sets(own: np.ndarray, seed: int) -> list[np.ndarray]:
    """The set with its group names swapped for others of the same row, ``SWAPS`` times."""
    out = []
    for k in range(1, SWAPS + 1):
        gone, new = [], []
        for row in _GROUPS:
            for place in np.flatnonzero(np.isin(row, own)):
                gone.append(row[place])
                new.append(row[(place + 1 + (seed * SWAPS + k) % (len(row) - 1)) % len(row)])
        if gone:
            kept = own[~np.isin(own, np.array(gone, np.uint64))]
            out.append(np.unique(np.concatenate([kept, np.array(new, np.uint64)])))
    return out


def tail(hits: np.ndarray, trials: np.ndarray, share: float) -> np.ndarray:
    """Chernoff's bound of the probability of a share as far from ``share`` as hits / trials."""
    q = hits / trials
    with np.errstate(divide="ignore", invalid="ignore"):
        far = np.where(q > 0, q * np.log(q / share), 0) + np.where(q < 1, (1 - q) * np.log((1 - q) / (1 - share)), 0)
    return np.exp(-trials * far)


def fit(table: pa.Table) -> pa.Table:
    """The model of rows of doc_id, text and toxic: weights by word hash; the first row is the intercept."""
    order = np.argsort(table["doc_id"].to_numpy(), kind="stable")  # the same sums whatever the order of arrival
    texts = common.text_bytes(table["text"])
    y = table["toxic"].to_numpy()[order].astype(np.float64)
    sets = list(word_sets([texts[i] for i in order]))
    share = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
    joined = np.concatenate([np.zeros(0, np.uint64), *sets])
    words, place, count = np.unique(joined, return_inverse=True, return_counts=True)
    toxic = np.bincount(place, np.repeat(y, [len(s) for s in sets]), minlength=len(words))
    tested = count >= MIN_DOCUMENTS
    chance = np.ones(len(words))
    chance[tested] = tail(toxic[tested], count[tested], share)
    good = np.flatnonzero(chance * max(1, tested.sum()) <= CHANCE)
    good = good[np.argsort(chance[good], kind="stable")][:FEATURES]
    feature = np.unique(np.concatenate([words[good], *_GROUPS]))

    def matrix(rows: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(rows), len(feature) + 1), np.float32)
        out[:, 0] = 1
        for i, own in enumerate(rows):
            at = np.minimum(np.searchsorted(feature, own), len(feature) - 1)
            out[i, 1 + at[feature[at] == own]] = 1
        return out

    pairs = [(i, s) for i, own in enumerate(sets) for s in swapped_sets(own, i)]
    x = matrix(sets)
    change = x[[i for i, _ in pairs]] - matrix([s for _, s in pairs])  # all zero but for group names
    held = np.full(x.shape[1], RIDGE)
    held[0] = 1e-6
    quadratic = np.diag(held) + 2 * PENALTY * (change.T @ change).astype(np.float64)
    weight = np.zeros(x.shape[1])
    weight[0] = np.log(share / (1 - share))
    for _ in range(STEPS):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ weight, -30, 30)))
        slope = x.T @ (p - y) + quadratic @ weight
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + quadratic, slope)
        weight -= step
        if np.abs(step).max() < 1e-9:
            break
    return pa.table({"word": pa.array(np.concatenate([np.zeros(1, np.uint64), feature]).view(np.int64)),
                     "place": pa.array(np.arange(len(weight)), pa.int64()), "weight": pa.array(weight)})


def scorer(words: np.ndarray, weights: np.ndarray, intercept: float):
    def score(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [plain(t) for t in common.text_bytes(part.column(1))]
            total = [np.zeros(0)]
            for one in common.batches(texts):
                made = common.Words(texts[one])
                hashes, text = features(made)
                at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
                hit = np.flatnonzero(words[at] == hashes)
                seen = np.unique(text[hit].astype(np.int64) * len(words) + at[hit])  # presence
                total.append(np.bincount(seen // len(words), weights[seen % len(words)], minlength=len(made.count)))
            z = np.concatenate(total) + intercept
            yield pa.record_batch([part.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], ["doc_id", "score"])

    return score


def train(docs: DataFrame, labels: DataFrame, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """word, place, weight of the model; ``labels`` has doc_id and toxic (0 or 1, others are ignored)."""
    able = labels.filter("toxic in (0, 1) and doc_id is not null")
    chosen = (able.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(training_rows))
    texts = common.own_columns(docs, "doc_id", "text").withColumn("text", common.whole_text())
    rows = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic"))
    return rows.groupBy().applyInArrow(fit, "word long, place long, weight double")


def score(docs: DataFrame, model: DataFrame) -> DataFrame:
    """doc_id, score (0 to 1) and predicted for every row of ``docs`` (doc_id, text; others are ignored).

    A null text counts as empty and gets the score of the intercept; without a model (no labelled rows)
    every score is 0.5. Null and repeated doc_ids are scored one by one; an empty table gives no rows.
    """
    held = cut(model).orderBy("place").limit(FEATURES + 1000).collect()  # bounded by FEATURES and the group names
    word = np.array([r.word for r in held[1:]] or [0], np.int64).view(np.uint64)
    weight = np.array([r.weight for r in held[1:]] or [0.0])
    texts = common.own_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), common.whole_text().alias("text"))
    return (texts.mapInArrow(scorer(word, weight, held[0].weight if held else 0.0), "doc_id long, score double")
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
