import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from conftest import SMALL
from ledgerloom.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def streams(tokenizer, texts):
    return [[*e.ids, packing.END_ID] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def laid_out(rows, window):
    """Pieces by sequence, checked to be gapless and full but for the last sequence."""
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append(r)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    out = []
    for s in sorted(by_sequence):
        at = 0
        for r in sorted(by_sequence[s], key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
            out.append(r)
        assert at == window or s == len(by_sequence) - 1 and 0 < at <= window
    return out


def restored(rows):
    """Every document's stream from its pieces, in order of the layout."""
    found, open_ = [], []
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"]
        assert r["start"] == len(open_)
        open_ += r["ids"]
        if len(open_) == r["doc_tokens"]:
            found.append((r["doc_id"], tuple(open_)))
            open_ = []
    assert not open_
    return Counter(found)


@pytest.mark.parametrize("window", [7, 64, 4096])
def test_messy_rows_come_back_whole(messy, messy_rows, tokenizer, window):
    rows = packing.pack(messy().repartition(5), PATH, window=window, with_ids=True).collect()
    expected = streams(tokenizer, [r[1] for r in messy_rows])
    assert restored(laid_out(rows, window)) == Counter((r[0], tuple(s)) for r, s in zip(messy_rows, expected, strict=True))


def test_whole_table_comes_back(spark, tokenizer):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = packing.pack(docs, PATH, with_ids=True).collect()
    listed = docs.collect()
    expected = streams(tokenizer, [r["text"] for r in listed])
    assert restored(laid_out(rows, 4096)) == Counter((r["doc_id"], tuple(s)) for r, s in zip(listed, expected, strict=True))


def test_word_by_word_ids_are_the_tokenizers_own(tokenizer):
    texts = [
        "It's we've I'M they'LL 'tis ''s don't", "naïve Straße ÉCOLE İstanbul ΣΊΣΥΦΟΣ ẞ ŒUVRE ÿ Ÿ µ ª º", "é É ạ̀ ́x",
        "<|endoftext|> x<|startoftext|>y <|EndOfText|> <| endoftext |>", "3.14 1,000 v2.0-rc1 a1b2 x² ½ ١٢", "«word» word» «word word… word—word",
        "tab\tnew\nline\r\nvt\x0bff\x0c nbsp\xa0thin ideo　sep\x1cx\x85y", "日本語 テキスト한국어 नमस्ते", "😀👍🏽 a😀b ﻿x ​x", "", "   ",
        "WORD!! word!! Word!!?? (word) [word] word_word @word #word word's. word'", "--- *** ||| a|b|c ~~~x", "ͅ ά ᾳ K Å ſ ﬁ", "x" * 5000,
    ]
    encoder = packing.WordEncoder(PATH)
    for _ in range(2):  # the second time from what is remembered
        ids, bounds = encoder.encode(pa.array([*texts, None]))
        got = [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        assert got == [s[:-1] for s in streams(tokenizer, [*texts, None])]


def test_a_full_memory_starts_afresh(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 3)
    encoder = packing.WordEncoder(PATH)
    for text in ("one two three four", "five six seven", "one two five"):
        assert encoder.encode(pa.array([text]))[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_empty_table(documents):
    assert packing.pack(documents([]), PATH).collect() == []


def test_a_task_leaves_no_words_and_takes_a_slice_at_a_time(tokenizer, monkeypatch):
    """The worker process goes on to other tasks, so what a task has encoded must not stay in it."""
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    monkeypatch.setattr(packing, "SLICE", 300)
    texts = [f"birch{i} Elm, oak {i}" * 10 for i in range(7)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(7)), "text": texts})
    out = list(packing._tokenized(iter([batch]), PATH, packing.END_ID))
    assert len(out) > 2 and len(packing._encoders[PATH].place) == 1
    held = [np.frombuffer(x, np.uint16).tolist() for b in out for x in b.column("ids").to_pylist()]
    assert held == streams(tokenizer, texts)
