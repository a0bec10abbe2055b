from collections import Counter

from ledgerloom.llm import licences as L

MIT = "Released under the MIT License."


def rows(df, **how):
    return {r["doc_id"]: (r["licence"], round(r["dice"], 6), r["n_matches"]) for r in L.licence_scan(df, **how).collect()}


def test_notices_lines_and_blocks(documents):
    long = next(t for n, t in L.TEMPLATES if n == "GPL-3.0" and len(t) > 100)
    wrapped = long.replace(" under the terms", "\n under  the TERMS").replace("either", "\neither")
    got = rows(
        documents(
            [
                (1, f"Some words first.\n{MIT}\nand after"),
                (2, "licensed under CC-BY NC 4.0!"),
                (3, f"intro\n\n{wrapped}\n\n outro"),
                (4, "released under the mit public licence and more words that do not belong to it at all"),
                (5, MIT + "\nLicensed under the Apache License, Version 2.0."),
                (6, "MIT"),
                (7, MIT + " " + MIT),
            ]
        )
    )
    assert got[1] == ("MIT", 1.0, 1)
    assert got[2] == ("CC-BY-NC-4.0", 1.0, 1)
    assert got[3] == ("GPL-3.0", 1.0, 1)
    assert got[4] == got[6] == (None, 0.0, 0)
    assert got[5] == ("Apache-2.0", 1.0, 2)
    assert got[7] == (None, 0.0, 0)  # repeats count: 4 of 4 + 9 pairs


def test_coefficient_by_hand(documents):
    """Every pair of line and template, without bounds."""
    texts = ["a b c d", "a b c d e", "a b a b a b", "b a", "a", "", "x y z", "a b c d e f g h i j k"]
    templates = (("p", "a b c d"), ("q", "a b a b"), ("r", "a"), ("s", "c d e"))

    def pairs(t):
        w = t.split()
        return Counter(zip(w, w[1:], strict=False)) if len(w) > 1 else Counter(w)

    for similar in (0.5, 0.8, 1.0):
        got = rows(documents(list(enumerate(texts))), templates=templates, similar=similar)
        for i, t in enumerate(texts):
            hits = []
            for name, x in templates:
                a, b = pairs(t), pairs(x)
                dice = 2 * (a & b).total() / (a.total() + b.total()) if a else 0
                if dice >= similar:
                    hits.append((-dice, name))
            best = min(hits, default=(0, None))
            assert got[i] == (best[1], round(-best[0], 6), bool(hits))


def test_messy_rows(messy, messy_rows):
    out = L.licence_scan(messy()).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in messy_rows)
    assert all(r["licence"] is None and r["dice"] == 0 and r["n_matches"] == 0 for r in out)


def test_empty_table(documents):
    assert L.licence_scan(documents([])).collect() == []
