"""Language model, quality, toxicity and BPE against brute force and held-out rows."""

import hashlib
import math
import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from harvestlens.llm import arrays, byte_bpe, common, language_model, quality, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def coder():
    import tiktoken

    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(VOCABULARY), special_tokens={})


def test_words_hold_whole_matches(coder):
    r = random.Random(5)
    letters = [*" \n\t\r\x1c\x85\xa0 　'abÉß7½.!,😀é", "  ", "'s", " 's", "​"]
    for _ in range(4000):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 12)))
        first, *rest = byte_bpe.split_words(text)
        words = [first, *[" " + w for w in rest]]
        assert "".join(words) == text
        assert [i for w in words for i in coder.encode_ordinary(w)] == coder.encode_ordinary(text)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_bpe_round_trip(docs, clashing, corpus, coder, block_bytes):
    rows = [*corpus, (None, "no id <|endoftext|>"), (3, corpus[3][1]), (3, corpus[3][1])]
    columns = ("ids", "n_tokens", "ids_sha256", "decoded_sha256")
    out = byte_bpe.encode(clashing(docs(rows)), VOCABULARY, public_tokenizers.PATTERN, columns, block_bytes)
    expected = Counter((r[0], tuple(coder.encode_ordinary(r[1] or ""))) for r in rows)
    got = out.collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == expected
    texts = {tuple(coder.encode_ordinary(r[1] or "")): (r[1] or "").encode() for r in rows}
    for r in got:
        assert r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[tuple(r.ids)]).hexdigest()
    back = byte_bpe.decode(out, VOCABULARY).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((r[0], r[1] or "") for r in rows)
    assert byte_bpe.encode(docs([]), VOCABULARY, public_tokenizers.PATTERN).count() == 0


def brute_model(train):
    tokens = lambda t: (t or "").encode().lower().split() + [b"</s>"]
    words, pairs = Counter(), Counter()
    for text in train:
        t = tokens(text)
        words.update(t)
        pairs.update(zip([b"<s>", *t], t))
    of = lambda c: language_model.discounts(np.array([sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]))
    follows, total, left = Counter(b for _, b in pairs), Counter(), defaultdict(float)
    d2, d1 = of(pairs), of(follows)
    for (a, _), n in pairs.items():
        total[a] += n
        left[a] += d2[min(n, 3)]
    spread = sum(d1[min(n, 3)] for n in follows.values()) / len(pairs)
    size, n = len(words), sum(words.values())

    def score(text):
        t = tokens(text)
        base = sum(math.log10((words[w] + 0.5) / (n + 0.5 * (size + 1))) for w in t)
        logs = 0.0
        for v, w in zip([b"<s>", *t], t):
            p = (follows[w] - d1[min(follows[w], 3)]) / len(pairs) + spread / (size + 1)
            if v in total:
                seen = pairs.get((v, w), 0)
                p = (seen - d2[min(seen, 3)]) / total[v] + left[v] / total[v] * p
            logs += math.log10(p)
        return len(t), sum(words[w] > 0 for w in t), n, base, logs

    return score


def test_language_model(docs, clashing, corpus):
    table = clashing(docs([*corpus, (None, "b a"), (5, "b a")]))
    even = table.filter("doc_id % 2 = 0")
    got = language_model.score(table, language_model.train(even)).collect()
    score = brute_model([r.text for r in even.collect()])
    texts = {r.doc_id: r.text for r in table.filter("doc_id <> 5").collect()}
    assert len(got) == table.count()
    for r in got:
        if r.doc_id in texts and r.doc_id is not None:
            assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == pytest.approx(score(texts[r.doc_id]), rel=1e-9)
    assert language_model.score(docs([]), language_model.train(even)).count() == 0


def test_language_model_of_nothing(docs):
    rows = language_model.score(docs([(1, "a b"), (2, None)]), language_model.train(docs([]))).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in sorted(rows, key=lambda r: r.doc_id)] == [(3, 0, 0), (1, 0, 0)]
    assert all(r.score == r.base_score == pytest.approx(0.0) for r in rows)


def test_arrays_are_mapped(tmp_path):
    arrays.write(str(tmp_path), "x", np.arange(1000))
    assert isinstance(arrays.read(str(tmp_path), "x"), np.memmap)
    assert arrays.read(f"file://{tmp_path}", "x")[999] == 999


def windows(text, order):
    points = [quality.START] * (order - 1) + [ord(c) for c in text or ""] + [quality.END]
    return [tuple(points[i:i + order]) for i in range(len(points) - order + 1)]


def packed(gram):
    """hi and lo of an n-gram."""
    hi = lo = 0
    for w in gram[:-3]:
        hi = hi << 21 | w
    for w in gram[-3:]:
        lo = lo << 21 | w
    return hi, lo


class Plain:
    """Interpolated modified Kneser-Ney straight from its definition."""

    def __init__(self, texts, order):
        self.order, self.counts = order, {order: Counter(g for t in texts for g in windows(t, order))}
        for k in range(order - 1, 0, -1):  # below the highest order: how many different characters stand before
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.discounts, self.after = {}, {}
        for k, counts in self.counts.items():
            t = [0, *(sum(c == i for c in counts.values()) for i in (1, 2, 3, 4))]
            y = t[1] / (t[1] + 2 * t[2]) if t[1] else 0.5
            self.discounts[k] = [min(max(i - (i + 1) * y * t[i + 1] / t[i], 0.05), i - 0.05) if t[i] else 0.5 * i for i in (1, 2, 3)]
            self.after[k] = after = {}
            for g, c in counts.items():
                after.setdefault(g[:-1], []).append(c)

    def p(self, gram):
        k = len(gram)
        if not k:
            return 1 / (len(self.counts[1]) + 1)
        seen, d = self.after[k].get(gram[:-1]), self.discounts[k]
        if not seen:
            return self.p(gram[1:])
        own = self.counts[k].get(gram, 0)
        kept = own - d[min(own, 3) - 1] if own else 0.0
        return (kept + sum(d[min(c, 3) - 1] for c in seen) * self.p(gram[1:])) / sum(seen)

    def loss(self, text):
        return -sum(np.log(self.p(g)) for g in windows(text, self.order))


@pytest.mark.parametrize("order", [3, 5])
def test_quality_model_is_a_distribution(spark, docs, order):
    texts = ["abab ab", "abba b", "baab", "", None, "aab" * 9]
    model, plain = quality.train(docs(list(enumerate(texts))), order).cache(), Plain(texts, order)
    contexts = {g[:-1] for t in [*texts, "a \u4e00b"] for g in windows(t, order)}
    letters = [*map(ord, "ab \u4e00"), quality.END]  # the fourth was never seen
    grams = {packed((*c, w)): (c, w) for c in contexts for w in letters}
    found = quality.probabilities(spark.createDataFrame(list(grams), "hi long, lo long"), model, order).collect()
    assert len(found) == len(grams)
    total = Counter()
    for r in found:
        context, letter = grams[r.hi, r.lo]
        total[context] += r.p
        assert r.p == pytest.approx(plain.p((*context, letter)), rel=1e-9)
    assert all(x == pytest.approx(1.0) for x in total.values())


def test_quality_against_brute_force(spark, docs, corpus):
    """Perplexity, threshold and decision from the definition."""
    r = random.Random(8)
    rows = [*corpus, *[(5000 + i, "#" * r.randint(1, 90), r.choice(["en", "de"]), "a") for i in range(20)], (9000, None, "xx"), (None, "abc abc", "en")]
    rows += [(10_000 + i, "".join(r.choice("abc ") for _ in range(r.randint(5, 40))), "fr") for i in range(700)]
    labels = spark.createDataFrame([(k, int(k % 9 > 0)) for k, *_ in rows if k is not None and (0 <= k < 150 or k >= 10_000)], "doc_id long, quality int")
    table = docs(rows)
    trusted = {x.doc_id for x in labels.filter("quality = 1").collect()}
    held = {x.doc_id for x in labels.filter("quality = 1 and pmod(xxhash64('held out', doc_id), 5) = 0").select("doc_id").collect()}
    plain = Plain([t for k, t, *_ in rows if k in trusted - held], quality.ORDER)
    size, loss = [len(t or "") + 1 for _, t, *_ in rows], [plain.loss(t) for _, t, *_ in rows]

    def lower(values, share):  # an element of the values
        return sorted(values)[max(int(np.ceil(share * len(values))) - 1, 0)]

    middles, above = {}, {}
    own = {lang: [i for i, (k, _, x, *_) in enumerate(rows) if x == lang and k in held] for lang in {x for _, _, x, *_ in rows}}
    for lang, some in own.items():
        if some:
            middles[lang] = m = lower([loss[i] / size[i] for i in some], 0.5)
            above[lang] = [(loss[i] + quality.PRIOR * m) / (size[i] + quality.PRIOR) - m for i in some]
    spread = {}
    for lang, x in above.items():
        if quality.LEAST <= len(x) < quality.ENOUGH:
            n, a = len(x), 1 - quality.SURE**2 / (2 * (len(x) - 1))
            factor = (quality.UPPER + np.sqrt(quality.UPPER**2 - a * (quality.UPPER**2 - quality.SURE**2 / n))) / a
            spread[lang] = np.mean(x) + factor * np.std(x, ddof=1)
        elif len(x) >= quality.ENOUGH:
            spread[lang] = lower(x, quality.LEVEL)
    assert len(spread) == len(middles) == 4 and len(above["fr"]) >= quality.ENOUGH
    got = Counter((x.doc_id, x.n_tokens, round(x.perplexity, 6), round(x.threshold, 6), x.kept) for x in quality.classify(table, labels).collect())
    want = Counter()
    for (k, _, lang, *_), n, x in zip(rows, size, loss, strict=True):
        m = middles.get(lang, max(middles.values()))
        limit = m + spread.get(lang, max(spread.values())) + 1e-9
        rate = (x + quality.PRIOR * m) / (n + quality.PRIOR)
        want[k, n, round(float(np.exp(x / n)), 6), round(float(np.exp(limit)), 6), bool(rate <= limit)] += 1
    assert got == want and {k[-1] for k in got} == {True, False}


def test_quality_draws_rows_of_each_language(spark, docs):
    rows = [(i, f"text {i}", "en" if i % 20 else "de" if i % 40 else None) for i in range(4000)]
    ids = spark.createDataFrame([(i,) for i in range(4000)], "doc_id long")
    few = quality.drawn(docs(rows), ids, 300).collect()
    assert sorted(x.text for x in few) == sorted(x.text for x in quality.drawn(docs(rows), ids, 300, 0).collect())
    same = docs([(7, f"text {i}", "en") for i in range(3000)])
    assert 230 < quality.drawn(same, ids, 300).count() < 370
    langs = Counter(rows[int(x.text.split()[1])][2] for x in few)
    assert langs["de"] == langs[None] == 100 and 230 < langs["en"] < 370


def test_quality_keeps_good_and_drops_odd(spark, docs, clashing):
    r = random.Random(2)
    good = lambda: " ".join("".join(r.choice(["ba", "de", "mi", "so"]) for _ in range(r.randint(1, 3))) for _ in range(40))
    rows = [(i, good(), "en" if i % 2 else "de") for i in range(120)]
    junk = [(1000 + i, "#$%" * 60, "en") for i in range(4)] + [(1010, "MI SO!! " * 30, "de")]
    odd = [(2000, None, "en"), (2001, "", None), (2002, good(), "xx"), (None, good(), "en"), (2003, "mi", "en"), (3, good(), "en")]
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i in range(0, 120, 2)] + [(None, 1, 0), (7777, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    table = clashing(docs([*rows, *junk, *odd]))
    got = quality.classify(table, labels).collect()
    assert len(got) == table.count()
    assert {r.doc_id for r in got if not r.kept} == {r[0] for r in junk}
    small = {(r.doc_id, r.n_tokens): r.perplexity for r in got}
    finer = quality.losses(table, quality.train(table.join(labels.filter("quality = 1"), "doc_id", "left_semi")), 500).collect()
    for r in finer:
        assert r.n_tokens == 1 or (r.doc_id, r.n_tokens) in small
    kept = quality.keep_good(table, labels)
    assert kept.columns == table.columns and kept.count() == table.count() - len(junk)
    assert quality.classify(table, labels.limit(0)).filter("not kept").count() == 0
    assert quality.classify(docs([]), labels).count() == 0


def test_quality_chunks_do_not_matter(docs, corpus):
    table = docs(corpus)
    model = quality.train(table.filter("doc_id % 3 = 0"))
    one, many = ({r.doc_id: r.loss for r in quality.losses(table, model, size).collect()} for size in (1 << 22, 2000))
    assert one == pytest.approx(many, rel=1e-12)


def junk_kind(text):
    words = text.split()
    if text.count("|") >= 0.3 * len(words):
        return "pipe"
    if sum(c in "#&%*$@" for c in text) >= 0.5 * len(words):
        return "symbol"
    if text == text.upper():
        return "shout"
    return "repeat" if len(words) >= 8 and len({w.strip(".,|!") for w in words}) <= 0.1 * len(words) + 2 else "other"


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no tables")
def test_quality_rejects_each_kind_of_junk(spark):
    """Of every kind of labelled junk, repeats of a word included, and of trusted documents."""
    table, labels = (common.table(spark, "/root/testdata/sf0.01", name) for name in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in table.select("doc_id", "text").collect()}
    kept = {r.doc_id: r.kept for r in quality.classify(table, labels).collect()}
    share = {}
    for r in labels.select("doc_id", "quality").collect():
        share.setdefault("good" if r.quality == 1 else junk_kind(texts[r.doc_id]), []).append(kept[r.doc_id])
    share = {k: np.mean(v) for k, v in share.items()}
    assert share.pop("good") > 0.98
    assert set(share) == {"pipe", "symbol", "shout", "repeat", "other"} and max(share.values()) < 0.15


def toxic_rows(n, seed):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    rows = []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randint(3, 60))]
        label = int(r.random() < 0.2)
        if label:
            words[r.randrange(len(words))] = r.choice(["idiot", "Scum!", "moronic", "morons"])
        if r.random() < (0.6 if label else 0.1):  # group names go with the label in this corpus
            words[r.randrange(len(words))] = r.choice(["women", "muslim", "gay"])
        rows.append((i, " ".join(words), label))
    return rows


def test_toxicity(spark, docs, clashing):
    rows = toxic_rows(900, 1)
    table = clashing(docs([(i, t) for i, t, _ in rows] + [(5000, "all women and muslim people met"), (5001, None), (5002, ""), (None, "idiot scum"),
                                                          (5003, "word " * 30000 + "idiot")]))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3] + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(table, labels)
    got = {r.doc_id: r for r in toxicity.score(table, model).collect()}
    assert len(got) == table.count()
    held = [(y, got[i].predicted) for i, _, y in rows if i % 3 == 0 and not set(rows[i][1].split()) & {"x"}]
    wrong = sum(y != p for y, p in held) / len(held)
    assert wrong < 0.06
    assert got[5000].predicted == 0 and got[None].predicted == 1 and got[5003].predicted == 1
    assert got[5001].score == got[5002].score and 0 <= got[5001].score < 0.5
    assert toxicity.score(docs([]), model).count() == 0
    blank = toxicity.score(table, toxicity.train(table, labels.limit(0)))
    assert {r.score for r in blank.collect()} == {0.5}


def test_counterfactual_penalty_holds_names_at_one_level():
    rows = toxic_rows(900, 1)
    table = pa.table({"doc_id": [i for i, _, _ in rows], "text": [t for _, t, _ in rows], "toxic": [y for _, _, y in rows]})

    def spread():
        model = toxicity.fit(table)
        weight = dict(zip(model["word"].to_pylist(), model["weight"].to_pylist(), strict=True))
        names = toxicity._GROUPS[0].view(np.int64).tolist()
        return np.ptp([weight[n] for n in names])

    with_penalty = spread()
    toxicity.PENALTY, old = 0.0, toxicity.PENALTY
    try:
        assert with_penalty < 0.5 * spread()
    finally:
        toxicity.PENALTY = old


def test_word_hashes_do_not_depend_on_the_batch():
    words = common.Words([b"a bb  a", b"", b"\xc3\xa9 bb\na"])
    h = words.hashes()
    assert h[0] == h[2] == h[5] and h[1] == h[4] and len(set(h.tolist())) == 3
    assert words.count.tolist() == [3, 0, 3]
    runs, at = words.runs(h, 2)
    assert at.tolist() == [0, 1, 3, 4] and runs[0] != runs[1]
    short, where = words.prefix_hashes([1])[0]
    assert where.tolist() == [1, 3, 4] and short[0] == short[2]


def test_packed_numbers():
    for values in ([], [0], [5, 5, 9], [2**40, 2**63]):
        array = np.array(values, np.uint64)
        assert common.undeltas(common.deltas(array)).tolist() == values
        assert common.unpack(common.pack(array)).tolist() == values


def test_null_text_reads_as_empty(docs):
    assert docs([(1, None)]).select(common.whole_text().alias("t")).first().t == ""
    assert common.fresh(docs([]).withColumn("_ID", F.lit(1)), "id") == ["__id"]


def test_the_quality_model_is_trained_on_all_trusted_rows(spark, monkeypatch):
    """No bound on the rows of a language: all that are not held out train the model."""
    rows = spark.range(70_000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.concat(F.lit("word "), "id").alias("text"))
    labels = rows.select("doc_id", F.lit(1).alias("quality"))
    held = labels.filter(F.pmod(F.xxhash64(F.lit("held out"), "doc_id"), F.lit(quality.HELD_OUT)) == 0).count()
    seen = []

    class Enough(Exception):
        pass

    def train(trusted, order):
        seen.append((trusted.count(), trusted.distinct().count()))
        raise Enough

    monkeypatch.setattr(quality, "train", train)
    with pytest.raises(Enough):
        quality.judged(rows, labels)
    assert seen == [(70_000 - held, 70_000 - held)] and 70_000 - held > 50_000
    ids = labels.select("doc_id").limit(7)
    assert quality.drawn(rows.union(rows.limit(10)), spark.createDataFrame([(3,), (99_999_999,)], "doc_id long")).count() == 2
    assert sorted(map(tuple, quality.drawn(rows, ids).collect())) == sorted(map(tuple, quality.drawn(rows, ids, broadcast_ids=0).collect()))


def test_grams_need_less_than_their_positions_in_64_bits():
    """The n-grams of a chunk against the definition, and the most that is held at a time."""
    import tracemalloc

    def numbers(gram):
        points = [0] * (5 - len(gram)) + list(gram)
        return points[0] << 21 | points[1], points[2] << 42 | points[3] << 21 | points[4]

    texts = ["abcabc", "", None, "\U0001F600é", "a"]
    for more in ([], ["".join(map(chr, range(0x4E00, 0x4E00 + 9000)))]):  # few characters, and too many for one number
        grams = quality.Grams(texts + more)
        want = []
        for t in texts + more:
            points = [quality.START] * 4 + [ord(c) for c in t or ""] + [quality.END]
            want += [numbers(points[i : i + 5]) for i in range(len(points) - 4)]
        assert list(zip(grams.hi[grams.at].tolist(), grams.lo[grams.at].tolist())) == want
        assert len(set(want)) == len(grams.hi) and grams.count.tolist() == [len(t or "") + 1 for t in texts + more]
    size = 1 << 20
    text = "abcdefgh" * (size // 8)
    tracemalloc.start()
    quality.Grams([text])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 45 * size  # 62 bytes a character before
