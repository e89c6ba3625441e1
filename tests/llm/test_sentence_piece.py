"""SentencePiece ids against the library, and the pair test against merging by definition."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from harvestlens.llm import queries, sentence_piece

PATH = public_tokenizers.path(queries.PIECES)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def encoder():
    return sentence_piece.Encoder(sentence_piece.read_model(PATH))


ODD = ["", " ", "  ", "   a  b   ", "\n\n\t", "▁▁a▁", " " * 37 + "x" + " " * 100, "a" * 5000, "\x00a\x00", "<s> </s> <0x41> <unk>",
       "日本語のテキスト中文", "😀😀é́", "ａｂｃ", "\r\n", "aaaa" * 999 + "b", "the " * 3000]


def random_texts(encoder, n):
    rnd = random.Random(3)
    pieces = list(encoder.rank)
    signs = [*"abethniosr.01", " ", "  ", "é", "梦", "😀", "\n", "▁", "ing"]
    for _ in range(n):
        yield "".join(rnd.choice(signs) for _ in range(rnd.randint(0, 40)))
        yield "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 6))).replace("▁", " ")


def test_ids_and_decoding(encoder, library):
    texts = [*ODD, *random_texts(encoder, 3000)]
    ids = library.encode(texts, num_threads=1)
    assert [encoder.encode(t) for t in texts] == ids
    assert [encoder.decode(i) for i in ids] == library.decode(ids)


def test_decoding_of_any_ids(encoder, library):
    rnd = random.Random(4)
    for _ in range(2000):
        ids = [rnd.choice([rnd.randint(0, encoder.size - 1), rnd.randint(0, 260)]) for _ in range(rnd.randint(0, 8))]
        assert encoder.decode(ids) == library.decode(ids)


def test_pairs_fit_as_merging_says(encoder):
    rnd = random.Random(5)
    pieces = [p for p in encoder.rank if len(p) < 6]
    for _ in range(4000):
        a, b = rnd.choice(pieces), rnd.choice(pieces)
        merged, _ = sentence_piece.merge(list(a + b), encoder.rank)
        assert encoder.pair_fits(encoder.ids[a], encoder.ids[b]) == (merged == [a, b])


@pytest.mark.parametrize("fallback", [True, False])
def test_small_vocabularies(fallback):
    """Pieces in any order of score, with ties, parts that come after the whole, and characters that are no piece."""
    rnd = random.Random(6)
    for _ in range(150):
        made = {"".join(rnd.choice("abc▁") for _ in range(rnd.randint(2, 4))) for _ in range(rnd.randint(1, 9))}
        words = [*(set("ab▁") | {c for c in "c" if rnd.random() < 0.5}), *made]
        pieces = ["<unk>", *(f"<0x{i:02X}>" for i in range(256)), *words]
        scores = [0.0] * 257 + [-float(rnd.randint(1, 6)) for _ in words]
        kinds = [sentence_piece.UNKNOWN] + [sentence_piece.BYTE] * 256 + [sentence_piece.NORMAL] * len(words)
        encoder = sentence_piece.Encoder(sentence_piece.Model(pieces, scores, kinds, fallback))
        for _ in range(20):
            text = "".join(rnd.choice("aabbc") for _ in range(rnd.randint(1, 9)))
            merged, _ = sentence_piece.merge(list("▁" + text), encoder.rank)
            want = []
            for symbol in merged:
                if symbol in encoder.ids:
                    want.append(encoder.ids[symbol])
                elif fallback:
                    want.extend(encoder.byte_ids[b] for b in symbol.encode())
                elif not want or want[-1] != encoder.unknown:
                    want.append(encoder.unknown)
            assert encoder.encode(text) == want


def test_what_is_remembered_is_bounded(monkeypatch, encoder):
    monkeypatch.setattr(sentence_piece, "REMEMBERED", 100)
    for known, text in ((encoder.known, "word{0}  and{0}"), (encoder.known_words, "word{0} and{0}")):
        for i in range(200):
            encoder.digests(text.format(i))
            assert len(known) < 30


def test_table(docs, clashing, corpus, library):
    rows = [*corpus, *[(1000 + i, t, None, None) for i, t in enumerate(ODD)], (None, "null id", None, None), (3, "id again", None, None)]
    table = clashing(docs(rows)).repartition(3)
    out = sentence_piece.encode(table, PATH, ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"))
    got = sorted(tuple(r) for r in out.collect() if r.doc_id is not None)
    want = []
    for i, text, *_ in rows:
        ids = library.encode(text or "")
        decoded = library.decode(ids)
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(decoded.encode()).hexdigest(), ids, decoded))
    assert got == sorted(w for w in want if w[0] is not None) and out.count() == len(rows)
    assert sentence_piece.encode(table.limit(0), PATH).collect() == []


def test_query(spark, library):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in queries.QUERIES["op13_sentence_piece"](spark, folder).collect():
        ids = library.encode(texts.pop(r.doc_id))
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert not texts
