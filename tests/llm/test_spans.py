import hashlib
import random
from collections import Counter

from conftest import SMALL
from ledgerloom.llm.spans import substring_dedup


def by_hand(rows, width=50):
    """Every window of every row in a table of first holders."""
    first, out = {}, []
    words = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in words:
        for j in range(len(w) - width + 1 if i is not None else 0):
            key = tuple(w[j : j + width])
            first[key] = min(first.get(key, i), i)
    for i, w in words:
        gone = set()
        for j in range(len(w) - width + 1 if i is not None else 0):
            if first[tuple(w[j : j + width])] < i:
                gone.update(range(j, j + width))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def found(df, **how):
    return Counter(tuple(r) for r in substring_dedup(df, **how).drop("kept_text").collect())


def test_messy_rows(messy, messy_rows):
    expected = by_hand([r[:2] for r in messy_rows])
    assert sum(n for (_, _, gone, _), n in expected.items() if gone) >= 3
    assert found(messy()) == expected


def test_branching_spans_settle_window_by_window(documents):
    """Copies that part ways at different words, repeats inside a document and few distinct words."""
    rng = random.Random(3)
    base = [rng.choice("abcdefg") + str(rng.randrange(30)) for _ in range(260)]
    rows = [(0, " ".join(base))]
    for i in range(1, 25):
        edited = list(base)
        for at in rng.sample(range(260), 3):
            edited[at] = f"new{i}"
        start = rng.randrange(80)
        rows.append((i, " ".join(edited[start : start + 120 + rng.randrange(100)])))
    rows += [(30, "x y " * 100), (31, "y x " * 100), (32, " ".join(base[50:110] * 3))]
    rng.shuffle(rows)
    assert found(documents(rows)) == by_hand(rows)


def test_other_widths_and_texts(documents):
    rows = [(1, "a b c d e f"), (2, "x b c d e y"), (3, "b c d")]
    out = {r["doc_id"]: r for r in substring_dedup(documents(rows), width=3, k=2).collect()}
    assert [out[i]["kept_text"] for i in (1, 2, 3)] == ["a b c d e f", "x y", ""]


def test_empty_table(documents):
    assert substring_dedup(documents([])).collect() == []


def test_one_hot_passage_over_many_documents(documents):
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"h{rng.random()} {passage} t{rng.random()}") for i in range(300)]
    out = substring_dedup(documents(rows)).groupBy("n_removed").count().collect()
    assert {tuple(r) for r in out} == {(0, 1), (60, 299)}


def test_whole_table_by_hand(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert found(docs) == by_hand([(r["doc_id"], r["text"]) for r in docs.collect()])
