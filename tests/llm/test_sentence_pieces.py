import hashlib
import random

import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece

from conftest import SMALL
from ledgerloom.llm import sentence_pieces
from ledgerloom.llm.queries import op12_sentence_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def encoder():
    return sentence_pieces.PieceEncoder(PATH)


def same(encoder, library, texts):
    ids, ends = encoder.encode(pa.array(texts, pa.string()))
    got = [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    assert got == library.encode([t or "" for t in texts])


def test_blanks_marks_and_odd_characters(encoder, library):
    same(
        encoder,
        library,
        ["", None, " ", "  ", "   ", "a ", " a", "  a  b   ", "▁", "▁▁", "a▁b ▁", "<s>", "</s> <unk> <0x41>", "a\x00b", "\t\n x\r\n\r\n",
         "naïve Straße İstanbul", "日本語テキスト 한국어 नमस्ते", "😀👍🏽a😀", "x" * 3000, "=" * 77, " " * 1000, "é", "　 \xa0", "1234567 3.14"],
    )


def test_random_texts(encoder, library):
    rng = random.Random(4)
    parts = ["a", "e", "t", "h", "in", "ing", "the", " ", "  ", "\n", "▁", "é", "日", "😀", "1", "23", "....", "----", "==", "\t", "x", "Q", "ß", "er", "s"]
    for _ in range(20):
        same(encoder, library, ["".join(rng.choice(parts) for _ in range(rng.randrange(80))) for _ in range(200)])


def test_long_stretches_without_spaces(encoder, library):
    rng = random.Random(5)
    texts = ["".join(rng.choice(a) for _ in range(20_000)) for a in ("ab", "abcdefgh", "the in", "日本語a", "-=*", "abc \n")]
    same(encoder, library, texts)


def test_a_full_memory_starts_afresh(encoder, library, monkeypatch):
    monkeypatch.setattr(sentence_pieces, "STRETCHES", 5)
    monkeypatch.setattr(sentence_pieces, "PAIRS", 3)
    for _ in range(2):
        same(encoder, library, ["one two three four five six seven eight", "nine one two", "backtracking unrepresentative"])


def test_backtracking_is_exercised(encoder):
    """Some longest match must not fit, else the failed positions are never used."""
    greedy = 0
    for text in ("▁erblest", "▁thwhesou", "▁onsheronst", "▁unrepresentatively", "▁misunderstandings", "▁whlyst"):
        at, longest = 0, []
        while at < len(text):
            longest.append(next(text[at:end] for end in range(len(text), at, -1) if text[at:end] in encoder.whole))
            at += len(longest[-1])
        assert encoder.pieces(text) == encoder.merged(text)
        greedy += longest == encoder.merged(text)
    assert greedy < 6


def test_messy_rows(messy, messy_rows, library):
    rows = sentence_pieces.encode(messy().repartition(3), PATH, decoded=True).collect()
    got = sorted([(r["doc_id"], r["ids"], r["decoded"]) for r in rows], key=str)
    wanted = [(r[0], library.encode(r[1] or "")) for r in messy_rows]
    assert got == sorted([(i, ids, library.decode(ids) if ids else "") for i, ids in wanted], key=str)


def test_decoding_gives_the_texts_back(spark, messy, messy_rows):
    texts = sentence_pieces.decode(sentence_pieces.encode(messy(), PATH), PATH).collect()
    assert sorted([(r[0], r[1]) for r in texts], key=str) == sorted([(r[0], r[1] or "") for r in messy_rows], key=str)
    odd = spark.createDataFrame([(1, None), (2, []), (None, [263])], "doc_id long, ids array<int>")
    assert sorted([tuple(r) for r in sentence_pieces.decode(odd, PATH).collect()], key=str) == [(1, ""), (2, ""), (None, "er")]


def test_whole_table_equals_the_library(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    wanted = {}
    for r in docs:
        ids = library.encode(r["text"] or "")
        shas = [hashlib.sha256(t.encode()).hexdigest() for t in (",".join(map(str, ids)), library.decode(ids))]
        wanted[r["doc_id"]] = (len(ids), *shas)
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in op12_sentence_pieces(spark, SMALL).collect()}
    assert got == wanted


def test_empty_table(documents):
    assert sentence_pieces.encode(documents([]), PATH, decoded=True).collect() == []
