import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from conftest import SMALL
from ledgerloom.llm import lines as L


def by_hand(rows, similar=0.8):
    """All pairs of distinct lines through an index of their shingles."""
    order = lambda i: (i is None, i or 0)
    listed, first = [], {}
    for r, (i, text) in sorted(enumerate(rows), key=lambda x: order(x[1][0])):
        for j, raw in enumerate((text or "").split("\n")):
            if line := " ".join(raw.lower().split()):
                listed.append((r, j, line))
                first.setdefault(line, (order(i), hashlib.md5((text or "").encode()).digest(), j))
    texts = list(first)
    sets = [{t[k : k + L.SHINGLE] for k in range(max(1, len(t) - L.SHINGLE + 1))} for t in texts]
    root, holders = list(range(len(texts))), defaultdict(list)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, s in enumerate(sets):
        shared = Counter(j for g in s for j in holders[g])
        for g in s:
            holders[g].append(k)
        for j, n in shared.items():
            if n >= similar * (len(s) + len(sets[j]) - n):
                root[find(k)] = find(j)
    keep, index = {}, {t: k for k, t in enumerate(texts)}
    for t, place in first.items():
        g = find(index[t])
        keep[g] = min(keep.get(g, place), place)
    gone = defaultdict(set)
    for r, j, line in listed:
        i, text = rows[r]
        if keep[find(index[line])] != (order(i), hashlib.md5((text or "").encode()).digest(), j):
            gone[r].add(j)
    out = Counter()
    for r, (i, text) in enumerate(rows):
        parts = (text or "").split("\n")
        left = "\n".join(x for j, x in enumerate(parts) if j not in gone[r])
        out[i, sum(bool(x.strip()) for x in parts), len(gone[r]), hashlib.sha256(left.encode()).hexdigest()] += 1
    return out


def found(df):
    rows = L.line_dedup(df).select("row.doc_id", "n_lines", "n_removed", "kept_sha256").collect()
    return Counter(tuple(r) for r in rows)


def test_messy_rows(messy, messy_rows):
    got, expected = found(messy()), by_hand([r[:2] for r in messy_rows])
    # Two texts under one id: which of them holds an equal line first is the operator's own order.
    assert got == expected


def test_whole_table_by_hand(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert found(docs) == by_hand([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_large_groups_repetitive_and_long_lines(documents):
    """Variants of a line in a crowd, lines of few distinct shingles, sizes around the scheme limits."""
    rng = random.Random(2)
    line = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    base = [line(n) for n in (12, 18, 22, 26, 29, 30, 40, 200)]
    rows = []
    for i in range(60):
        parts = []
        for b in base:
            words = b.split()
            words[rng.randrange(len(words))] = f"edit{i}"
            parts.append(" ".join(words))
        rows.append((i, "\n".join(parts)))
    rows += [(100, "spam ham! " * 7), (101, "SPAM  ham! " * 90), (102, "spam ham! eggs " * 50), (103, "x"), (104, " X ")]
    assert found(documents(rows)) == by_hand(rows)


def test_all_pairs_across_components_are_met_in_rounds(documents, monkeypatch):
    monkeypatch.setattr(L, "AT_ONCE", 1)
    rng = random.Random(4)
    words = [f"word{k}" for k in range(30)]
    rows = []
    for i in range(12):  # a chain: neighbours are similar, the ends are not
        rows.append((i, " ".join(words[:-i or None] + [f"other{k}" for k in range(i)])))
    rng.shuffle(rows)
    assert found(documents(rows)) == by_hand(rows)


def test_deduplicated_keeps_columns_and_untouched_texts(messy):
    docs = messy()
    out = L.deduplicated(docs)
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[3]["text"] is None and rows[3]["n_chars"] is None
    assert rows[5]["text"] == " \t\n \n" and rows[5]["size"] == "own size"
    assert rows[9]["text"] == "" and rows[9]["n_chars"] == 0
    assert rows[8]["text"] == "one"


def test_empty_table(documents):
    assert L.line_dedup(documents([])).collect() == []


def test_lines_of_one_shingle_have_bands():
    """Of one and of four equal shingles: the sets are the same."""
    a, b, other, short = L.signatures(["-------", "----------", "=======", "------"])
    assert len(a) and sorted(a.tolist()) == sorted(b.tolist())
    assert not set(a.tolist()) & set(other.tolist()) and not len(short)


def test_texts_without_an_id_are_told_apart_by_more_than_a_checksum(spark):
    """Two texts with one CRC-32 and no id lose what others have, and nothing of their own."""
    seen, pair, i = {}, None, 0
    while pair is None:
        text = f"shared line of some length\n{hashlib.sha256(str(i).encode()).hexdigest()}"
        crc = zlib.crc32(text.encode())
        pair = (seen[crc], text) if crc in seen else None
        seen[crc] = text
        i += 1
    rows = [(None, pair[0]), (None, pair[1]), (1, "shared line of some length"), (2**63 - 1, pair[1])]
    found = L.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").withColumn("a.b", F.lit(1)))
    own = [t.split("\n")[1] for t in pair]
    kept = sorted((str(r["row"]["doc_id"]), r["kept_text"]) for r in found.collect())
    assert kept == sorted([("1", "shared line of some length"), (str(2**63 - 1), own[1]), ("None", own[0]), ("None", "")])


def test_whole_texts_are_handled_a_slice_at_a_time(monkeypatch):
    """However many rows a batch has, no more than a slice of its texts is copied at once."""
    monkeypatch.setattr(L, "SLICE", 250)
    texts = [f"{i} {'x' * 90}\nlast" for i in range(9)]
    kept = pa.RecordBatch.from_pydict({"row": list(range(9)), "text": texts, "gone": [[1], None, []] * 3})
    out = list(L._kept(iter([kept])))
    assert len(out) > 3 and all(b.num_rows <= 2 for b in out)
    left = [t.removesuffix("\nlast") if i % 3 == 0 else t for i, t in enumerate(texts)]
    assert [t for b in out for t in b.column("kept_text").to_pylist()] == left
    pairs = pa.RecordBatch.from_pydict({"a": list(range(9)), "b": list(range(9, 18)), "a_text": texts, "b_text": texts[:5] + ["other line"] * 4})
    out = list(L._compared(iter([pairs]), 0.8))
    assert len(out) > 2 and [a for b in out for a in b.column("a").to_pylist()] == list(range(5))


def test_signatures_are_the_same_in_blocks_of_any_size(monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcd ") for _ in range(n)) for n in (0, 3, 7, 60, 130, 134, 190, 206, 207, 500, 5000)] * 2
    whole = [s.tolist() for s in L.signatures(texts)]
    monkeypatch.setattr(L, "BLOCK", 50)
    assert [s.tolist() for s in L.signatures(texts)] == whole and whole[:11] == whole[11:]
    assert [bool(w) for w in whole[:11]] == [False] * 2 + [True] * 9


def test_sketches_are_joined_to_pairs_and_mixed_buckets_only(documents, monkeypatch):
    """A node is in many buckets: what is written of all members holds their keys and numbers alone."""
    made, real = {}, L.written
    monkeypatch.setattr(L, "written", lambda df, name, **how: made.setdefault(name, []).append(df.columns) or real(df, name, **how))
    words = [f"word{k}" for k in range(30)]
    rows = [(i, " ".join(words[:-i or None] + [f"other{k}" for k in range(i)])) for i in range(8)]
    assert found(documents(rows)) == by_hand(rows)
    assert all(len(columns) <= 4 for name in ("line-members", "members", "rooted") for columns in made[name])


def test_lines_of_a_text_are_folded_as_each_by_itself():
    """Whole texts are lower-cased at once and seldom split into words; the lines are the same."""
    gaps = [c for c in map(chr, range(0x110000)) if c.isspace() and c != "\n"]
    texts = ["", "\n", " A b \n\n c  D ", "\u039f\u0394\u039f\u03a3\n\u03a3\u03a3 x\u03a3\n\u0130i", *[f"{c}a{c}B{c}\n{c}\nx c" for c in gaps]]
    for text in texts:
        assert L.normal_lines(text) == [L.normal(x) for x in text.split("\n")]


def test_similarity_of_pairs_whatever_alphabets_meet():
    """Numbers of nine bits a character mean the same on both sides, and more characters go by the shingles."""
    rng = random.Random(7)
    alphabets = ["abc ", "\u03b1\u03b2\u03b3 ", "".join(map(chr, range(0x4E00, 0x4E00 + 700))), "xyz\U0001f600\U0001f601"]
    ones, others = [], []
    for i in range(120):
        one = [rng.choice(alphabets[i % 4]) for _ in range(rng.randrange(5, 90))]
        other = [rng.choice("ab\u00df\u6f22\u03b1") if rng.random() < 0.015 else x for x in one]
        ones += ["".join(one)] * 2
        others += ["".join(other), "".join(other[: rng.randrange(4, 91)])]
    pairs = pa.RecordBatch.from_pydict({"a": list(range(240)), "b": list(range(240)), "a_text": ones, "b_text": others})
    expected = []
    for i, (a, b) in enumerate(zip(ones, others, strict=True)):
        a, b = L.shingles(a), L.shingles(b)
        if len(a & b) >= 0.8 * len(a | b):
            expected.append(i)
    assert 60 < len(expected) < 200
    assert [a for b in L._compared(iter([pairs]), 0.8) for a in b.column("a").to_pylist()] == expected


def test_shared_keys_batch_by_batch(monkeypatch):
    """Each key goes to one part; nodes of a key that several have are counted once, whatever batches they come in."""
    monkeypatch.setattr(L, "PART", 100)
    rng = random.Random(8)
    rows = [(rng.randrange(-300, 300) << 50, rng.randrange(5)) for _ in range(1500)] + [(7, 1)] * 9 + [(8, 1)] * 4 + [(8, 2)]
    rng.shuffle(rows)
    cut = [rows[i : i + 40] for i in range(0, len(rows), 40)]
    lines = [pa.RecordBatch.from_pydict({"node": [n for _, n in x], "bands": [[k] for k, _ in x]}) for x in cut]
    parts = defaultdict(list)
    for batch in L._dealt(iter(lines), 7):
        for row in batch.to_pylist():
            parts[row["part"]].append(row)
    got = Counter()
    for own in parts.values():
        for batch in L._shared(pa.RecordBatch.from_pylist(own[i : i + 3]) for i in range(0, len(own), 3)):
            for row in batch.to_pylist():
                got[row["key"], row["node"]] += row["n"]
    listed = Counter(rows)
    nodes = Counter(key for key, _ in listed)
    assert got == Counter({x: n for x, n in listed.items() if nodes[x[0]] > 1})


def test_band_keys_are_shuffled_in_rows_of_many(monkeypatch):
    """Keys that no other line has cost no row of their own on the way to their task."""
    dealt, real = [], L._by_part
    monkeypatch.setattr(L, "_by_part", lambda key, node, parts: dealt.append((len(key), real(key, node, parts))) or dealt[-1][1])
    texts = [f"line number {i} of several words and more" for i in range(500)]
    lines = next(iter(L._lines(iter([pa.RecordBatch.from_pydict({"id": list(range(500)), "tag": ["t"] * 500, "text": texts})]))))
    rows = [b.num_rows for b in L._dealt(iter([lines]), 3)]
    assert rows == [3] and [n for n, _ in dealt] == [500 * L.BANDS]
