"""Scores of texts under an interpolated modified Kneser-Ney bigram model of the corpus.

Counting runs in Spark; the result is a set of sorted arrays in the shared folder, one group of files
per range of keys, which workers map into memory and search.

1. Words: every task counts the word hashes of its texts; counts are merged by range of hash. A word's
   place in the sorted arrays is its number from then on.
2. Pairs: tasks look their words up in the arrays of step 1 and count pairs of numbers, packed into
   one 64-bit key. Pairs are dealt by range of key in shares of equal numbers of tokens, so that
   the pairs of a very frequent word are spread over many tasks.
3. What a pair adds to its first word (how many followers were seen once, twice, more often) and to its
   second word (how many words it follows) is summed per range of words.

Scoring reads each text where it lies. Its words and pairs are looked up in ascending order, so every
array is passed over once per batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestlens.llm import arrays, common
from harvestlens.session import cut, scratch_path

BATCH = 12 << 20  # bytes of text that a task counts or scores at a time
END = np.uint64(0xE0D0F7EC7E57A11D)  # the token behind every text, in place of a word hash
MOST_WORDS = 1 << 32

_COUNTS = pa.schema([("shard", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def _grouped(parts: Iterator[pa.RecordBatch], place: int) -> Iterator[tuple[list[pa.RecordBatch], list[bytes]]]:
    """Arrow batches in groups of about ``BATCH`` bytes of text, and their texts."""
    held, texts, size = [], [], 0
    for part in parts:
        for start in range(0, part.num_rows, 256):
            few = part.slice(start, 256)
            own = common.text_bytes(few.column(place))
            held.append(few)
            texts += own
            size += sum(map(len, own))
            if size >= BATCH:
                yield held, texts
                held, texts, size = [], [], 0
    if held:
        yield held, texts


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, END behind each, and the number of tokens of each text."""
    found, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for part in common.batches(texts):
        words = common.Words(texts[part], lower=True)
        found.append(np.insert(words.hashes(), words.first[1:], END))
        counts.append(words.count + 1)
    return np.concatenate(found), np.concatenate(counts)


def _merge(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order and the sums of their counts."""
    keys = np.concatenate([common.undeltas(x.as_py()) for x in table["keys"]])
    counts = np.concatenate([common.unpack(x.as_py()) for x in table["counts"]]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _blocks(shard: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Rows of (shard, keys, counts); shards ascend with the keys."""
    cuts = np.flatnonzero(np.diff(shard, prepend=-1))
    rows = [{"shard": int(shard[a]), "keys": common.deltas(keys[a:b]), "counts": common.pack(counts[a:b])}
            for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True)]
    return pa.RecordBatch.from_pylist(rows, _COUNTS)


def _narrow(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint32) if values.max(initial=0) < 1 << 32 else values


class Model:
    """Where the arrays lie, and the few numbers that describe them.

    ``words[s]`` is the number of the first word of range s; ``pairs`` the first pair key of each pair range.
    """

    def __init__(self, folder: str, shards: int):
        self.folder, self.shards = folder, shards
        self.words = np.zeros(shards + 1, np.int64)
        self.before = np.zeros(shards + 1, np.int64)  # tokens in earlier ranges
        self.documents = 0
        self.pairs = np.zeros(0, np.uint64)
        self.pair_shards = np.zeros(0, np.int64)
        self.pair_discounts = self.word_discounts = np.zeros(4)
        self.distinct_pairs = 0
        self.spread = 0.0

    @property
    def vocabulary(self) -> int:
        return int(self.words[-1])

    @property
    def train_tokens(self) -> int:
        return int(self.before[-1])

    def shard_of_hash(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(32)) * np.uint64(self.shards) >> np.uint64(32)).astype(np.int64)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of distinct ascending word hashes; -1 for words not in the model."""
        out = np.full(len(hashes), -1, np.int64)
        shard = self.shard_of_hash(hashes)
        for s in np.unique(shard):
            if self.words[s + 1] == self.words[s]:
                continue
            own = np.flatnonzero(shard == s)
            keys = arrays.read(self.folder, f"word-{s}")
            at = np.minimum(np.searchsorted(keys, hashes[own]), len(keys) - 1)
            out[own] = np.where(keys[at] == hashes[own], at + self.words[s], -1)
        return out

    def of_words(self, name: str, numbers: np.ndarray, *width: int) -> np.ndarray:
        """Rows of an array of the words for ascending numbers; zeros for -1."""
        out = np.zeros((len(numbers), *width), np.int64)
        shard = np.searchsorted(self.words, numbers, side="right") - 1
        for s in np.unique(shard[numbers >= 0]):
            own = np.flatnonzero((shard == s) & (numbers >= 0))
            out[own] = arrays.read(self.folder, f"{name}-{s}")[numbers[own] - self.words[s]]
        return out

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of ascending pair keys; 0 for pairs never seen."""
        out = np.zeros(len(keys), np.int64)
        if not len(self.pairs):
            return out
        shard = np.maximum(np.searchsorted(self.pairs, keys, side="right") - 1, 0)
        for s in np.unique(shard):
            own = np.flatnonzero(shard == s)
            held = arrays.read(self.folder, f"pair-{self.pair_shards[s]}")
            at = np.minimum(np.searchsorted(held, keys[own]), len(held) - 1)
            out[own] = np.where(held[at] == keys[own], arrays.read(self.folder, f"times-{self.pair_shards[s]}")[at], 0)
        return out


def _count_words(shards: int):
    model = Model("", shards)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _grouped(parts, 0):
            keys, counts = np.unique(tokens(texts)[0], return_counts=True)
            yield _blocks(model.shard_of_hash(keys), keys, counts)

    return run


def _store_words(folder: str):
    def run(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        keys, counts = _merge(table)
        arrays.write(folder, f"word-{shard}", keys)
        arrays.write(folder, f"count-{shard}", _narrow(counts))
        arrays.write(folder, f"before-{shard}", np.cumsum(counts) - counts)
        return pa.table({"shard": pa.array([shard], pa.int32()), "words": pa.array([len(keys)], pa.int64()),
                         "tokens": pa.array([int(counts.sum())], pa.int64())})

    return run


def _pair_keys(model: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token numbers, numbers of the token before each (START = vocabulary), tokens per text, distinct numbers."""
    hashes, counts = tokens(texts)
    known, inverse = np.unique(hashes, return_inverse=True)
    number = model.numbers(known)
    own = number[inverse]
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)] = model.vocabulary
    return own, before, counts, np.unique(number)


def _count_pairs(model: Model):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.uint64(model.vocabulary)
        for _, texts in _grouped(parts, 0):
            own, before, _, numbers = _pair_keys(model, texts)
            keys, counts = np.unique(before.astype(np.uint64) << np.uint64(32) | own.astype(np.uint64), return_counts=True)
            first, second = keys >> np.uint64(32), keys & np.uint64(MOST_WORDS - 1)
            earlier = np.concatenate([model.of_words("before", numbers), [model.train_tokens]])
            earlier[:-1] += model.before[np.searchsorted(model.words, numbers, side="right") - 1]
            weight = np.concatenate([model.of_words("count", numbers), [model.documents]])
            at = np.searchsorted(np.append(numbers, model.vocabulary), first.astype(np.int64))
            total = model.train_tokens + model.documents
            share = (earlier[at] + weight[at] * (second / size)) / total  # where the key lies among all tokens
            shard = np.minimum((share * model.shards).astype(np.int64), model.shards - 1)
            yield _blocks(shard, keys, counts)

    return run


_SUMS = pa.schema([("owner", pa.int32()), ("shard", pa.int32()), ("first", pa.int64()), ("side", pa.int32()),
                   ("numbers", pa.binary()), ("values", pa.binary()), ("kinds", pa.list_(pa.int64()))])
SUMS = "owner int, shard int, first long, side int, numbers binary, values binary, kinds array<long>"


def _store_pairs(model: Model):
    """Write the pairs of a range; give its sums per first and second word, dealt by range of words."""

    def sums(shard: int, side: int, numbers: np.ndarray, values: np.ndarray) -> list[dict]:
        owner = np.searchsorted(model.words, numbers, side="right") - 1
        owner = np.minimum(owner, model.shards)  # the start of texts has an owner of its own
        cuts = np.flatnonzero(np.diff(owner, prepend=-1))
        return [{"owner": int(owner[a]), "shard": shard, "side": side, "numbers": common.deltas(numbers[a:b]),
                 "values": common.pack(values[a:b].reshape(-1))} for a, b in zip(cuts, [*cuts[1:], len(owner)], strict=True)]

    def run(table: pa.Table) -> pa.Table:
        shard = table["shard"][0].as_py()
        keys, counts = _merge(table)
        arrays.write(model.folder, f"pair-{shard}", keys)
        arrays.write(model.folder, f"times-{shard}", _narrow(counts))
        first = (keys >> np.uint64(32)).astype(np.int64)
        starts = np.flatnonzero(np.diff(first, prepend=-1))
        kinds = np.stack([np.add.reduceat((np.minimum(counts, 3) == k).astype(np.int64), starts) for k in (1, 2, 3)], axis=1)
        second, follows = np.unique(keys & np.uint64(MOST_WORDS - 1), return_counts=True)
        of = [int((counts == k).sum()) for k in (1, 2, 3, 4)] + [len(keys)]
        rows = [{"owner": -1, "shard": shard, "first": int(keys[0].view(np.int64)), "kinds": of}]
        rows += sums(shard, 1, first[starts], kinds) + sums(shard, 2, second.astype(np.int64), follows)
        return pa.Table.from_pylist(rows, _SUMS)

    return run


def _store_sums(model: Model):
    def run(table: pa.Table) -> pa.Table:
        owner = table["owner"][0].as_py()
        start = owner < model.shards
        base = model.words[owner] if start else model.vocabulary
        size = int(model.words[owner + 1] - base) if start else 1
        followers, follows = np.zeros((size, 3), np.int64), np.zeros(size, np.int64)
        for row in table.select(["side", "numbers", "values"]).to_pylist():
            at = common.undeltas(row["numbers"]).astype(np.int64) - base
            values = common.unpack(row["values"]).astype(np.int64)
            if row["side"] == 1:
                followers[at] += values.reshape(-1, 3)
            else:
                follows[at] += values
        arrays.write(model.folder, f"followers-{owner}", _narrow(followers))
        arrays.write(model.folder, f"follows-{owner}", _narrow(follows))
        of = [int((follows == k).sum()) for k in (1, 2, 3, 4)]
        return pa.table({"kinds": pa.array([of], pa.list_(pa.int64())), "start": pa.array([not start])})

    return run


def discounts(kinds: np.ndarray) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and 3+ from the numbers of things counted once to four times."""
    n1, n2, n3, n4 = (float(x) for x in kinds[:4])
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return np.array([0.0, *(min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw))])


def train(docs: DataFrame) -> Model:
    """Count the texts of ``docs`` (text; other columns are ignored) and store the model.

    Null texts count as empty (one END token). An empty table gives a model without words.
    """
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    model = Model(scratch_path(spark, "lm"), shards)
    texts = docs.select(common.whole_text().alias("text"))
    counted = texts.mapInArrow(_count_words(shards), "shard int, keys binary, counts binary")
    found = cut(counted.groupBy("shard").applyInArrow(_store_words(model.folder), "shard int, words long, tokens long"))
    for r in found.collect():  # one row per range
        model.words[r.shard + 1], model.before[r.shard + 1] = r.words, r.tokens
    model.words, model.before = np.cumsum(model.words), np.cumsum(model.before)
    if not model.train_tokens:
        return model
    if model.vocabulary >= MOST_WORDS:
        raise ValueError("more distinct words than a pair key can hold")
    own = model.shard_of_hash(np.array([END]))
    model.documents = int(_count_of(model, own))
    pairs = cut(texts.mapInArrow(_count_pairs(model), "shard int, keys binary, counts binary").groupBy("shard")
                .applyInArrow(_store_pairs(model), SUMS))
    held = pairs.filter("owner = -1").select("shard", "first", "kinds").orderBy("shard").collect()  # one row per range
    model.pairs = np.array([r.first for r in held], np.int64).view(np.uint64)
    model.pair_shards = np.array([r.shard for r in held])
    kinds = np.array([r.kinds for r in held]).sum(axis=0)
    model.pair_discounts, model.distinct_pairs = discounts(kinds), int(kinds[4])
    stored = cut(pairs.filter("owner >= 0").select("owner", "side", "numbers", "values").groupBy("owner")
                 .applyInArrow(_store_sums(model), "kinds array<long>, start boolean")).filter("not start").collect()
    of = np.array([r.kinds for r in stored]).sum(axis=0)
    model.word_discounts = discounts(of)
    d = model.word_discounts
    model.spread = float(d[1] * of[0] + d[2] * of[1] + d[3] * (model.vocabulary - of[0] - of[1])) / model.distinct_pairs
    return model


def _count_of(model: Model, shard: np.ndarray) -> int:
    """How often END was counted: the number of texts."""
    number = model.numbers(np.array([END]))
    return int(model.of_words("count", number)[0])


def _score(model: Model):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, total = model.vocabulary, model.train_tokens
        for held, texts in _grouped(parts, 1):
            own, before, counts, numbers = _pair_keys(model, texts)
            at = np.searchsorted(numbers, own)
            times = model.of_words("count", numbers)
            base = np.log10((times + 0.5) / (total + 0.5 * (size + 1)))[at]
            if total:
                follows = model.of_words("follows", numbers)
                lower = ((follows - model.word_discounts[np.minimum(follows, 3)]) / model.distinct_pairs
                         + model.spread / (size + 1))[at]
                first = np.append(numbers, size)
                context = np.append(times, model.documents).astype(np.float64)
                started = arrays.read(model.folder, f"followers-{model.shards}") if model.documents else np.zeros((1, 3))
                left = np.concatenate([model.of_words("followers", numbers, 3), started]) @ model.pair_discounts[1:]
                place = np.searchsorted(first, before)
                known = (before >= 0) & (context[place] > 0)
                pairs = np.flatnonzero(known & (own >= 0))
                keys, inverse = np.unique(before[pairs].astype(np.uint64) << np.uint64(32) | own[pairs].astype(np.uint64), return_inverse=True)
                seen = model.pair_counts(keys)[inverse]
                c = np.where(known, context[place], 1.0)
                p = np.where(known, left[place] / c, 1.0) * lower
                p[pairs] += (seen - model.pair_discounts[np.minimum(seen, 3)]) / c[pairs]
                logs = np.log10(p)
            else:
                logs = base
            start = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
            yield pa.record_batch(
                [pa.concat_arrays([h.column(0) for h in held]), pa.array(counts, pa.int64()),
                 pa.array(np.add.reduceat((own >= 0).astype(np.int64), start), pa.int64()),
                 pa.array(np.full(len(counts), total), pa.int64()),
                 pa.array(np.add.reduceat(base, start)), pa.array(np.add.reduceat(logs, start))],
                ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Log10 probabilities of every text of ``docs`` (doc_id, text; other columns are ignored).

    Returns one row per input row: doc_id, n_tokens (words and the end), n_known, train_tokens, base_score
    (add-half unigrams), score (the model), perplexity. A null text counts as empty: its end is scored.
    Null and repeated doc_ids are scored row by row. Under a model of no texts both scores are that
    of a single unknown token.
    """
    texts = docs.select(F.col("doc_id").cast("long"), common.whole_text().alias("text"))
    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return texts.mapInArrow(_score(model), schema).withColumn(
        "perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
