"""The same rows in SQL, where SQL can express them."""

from __future__ import annotations

from ledgerloom.llm.licences import TEMPLATES

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (
    SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 50], ' ')) AS h
    FROM d, UNNEST(range(0, len(w) - 49)) AS t(i)
),
firsts AS (SELECT h, min(doc_id) AS first_doc FROM win GROUP BY h),
gone AS (
    SELECT DISTINCT doc_id, UNNEST(range(i, i + 50)) AS p
    FROM win JOIN firsts USING (h) WHERE first_doc < doc_id
),
word AS (SELECT doc_id, p, w[p + 1] AS x FROM d, UNNEST(range(0, len(w))) AS t(p)),
kept AS (
    SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS s
    FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id
),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def _seats(units: str, group: str, order: str, weight: str, seats: str) -> str:
    """Highest quotients weight / (2k + 1), by filling up from a safe number of seats."""
    part = f"PARTITION BY {group}" if group else ""
    return f"""
    SELECT * EXCLUDE (all_weight, n_units, base, top, k, place, left_over), base + more AS won FROM (
        SELECT *, sum(CASE WHEN k IS NOT NULL AND place <= left_over THEN 1 ELSE 0 END)
                  OVER (PARTITION BY unit) AS more, row_number() OVER (PARTITION BY unit) AS copy FROM (
            SELECT *, row_number() OVER ({part} ORDER BY {weight} / (2 * k + 1) DESC NULLS LAST, {order}, k) AS place
            FROM (
                SELECT *, {seats} - sum(base) OVER ({part}) AS left_over FROM (
                    SELECT *, CASE WHEN {weight} > 0 THEN floor((CASE WHEN 2 * {seats} > n_units
                        THEN {weight} * (2.0::DOUBLE * {seats} - n_units) / all_weight ELSE 0 END + 1) / 2) ELSE 0 END::BIGINT AS base,
                        CASE WHEN {weight} > 0 THEN floor(({weight} * (2.0::DOUBLE * {seats} + n_units) / all_weight + 1) / 2)
                        + 1 ELSE 0 END::BIGINT AS top
                    FROM (
                        SELECT *, row_number() OVER () AS unit, sum({weight}) OVER ({part})::DOUBLE AS all_weight,
                            sum(CASE WHEN {weight} > 0 THEN 1 ELSE 0 END) OVER ({part})::DOUBLE AS n_units
                        FROM {units}
                    )
                )
            ) LEFT JOIN LATERAL (SELECT UNNEST(range(base, top)) AS k) ON true
        )
    ) WHERE copy = 1"""


def _digits(*parts: str) -> str:
    listed = " || '|' || ".join(f"coalesce(({p})::VARCHAR, '')" for p in parts)
    return f"md5('mix-1|' || {listed})"


def _number(digits: str) -> str:
    return f"('0x' || substr({digits}, 1, 8))::BIGINT"


OP2 = f"""
WITH rows_ AS (SELECT doc_id, source, len({WORDS})::BIGINT AS size FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows_ GROUP BY source),
ranked AS (
    SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio FROM (
        SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[(place - 1) % 3 + 1] AS weight
        FROM (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM sums)
    )
),
levels AS (
    SELECT *, (goal - coalesce(filled, 0)) / open_weight AS level FROM (
        SELECT *, sum(source_size) OVER ()::DOUBLE * 1.5 AS goal,
            sum(cap) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS filled,
            sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
        FROM ranked
    )
),
aimed AS (
    SELECT source, source_size, place AS aimed_place, round(goal / 16)::BIGINT AS seats,
        least(cap, coalesce(max(CASE WHEN level < ratio THEN level END) OVER () * weight, cap)) AS target
    FROM levels
),
quotas AS (
    SELECT source, source_size, target, least(won, 2 * ceil(source_size / 16.0))::BIGINT AS quota,
        greatest(1, least(4096, source_size // 65536)) AS shards
    FROM ({_seats("aimed", "", "aimed_place", "target", "seats")})
),
placed AS (
    SELECT r.*, q.source_size, q.target, q.quota, {_number(_digits("'shard'", "doc_id"))} % shards AS shard
    FROM rows_ r JOIN quotas q ON r.source IS NOT DISTINCT FROM q.source
),
held AS (
    SELECT source, source_size, quota, shard, sum(size)::BIGINT AS shard_size FROM placed GROUP BY ALL
),
won AS ({_seats("held", "source", "shard", "shard_size", "quota")}),
draws AS (
    SELECT *, {_number(_digits("'run'", "source", "shard"))} % (n - rest + 1) AS first_block FROM (
        SELECT *, least(won, 2 * n) // n AS passes, least(won, 2 * n) % n AS rest
        FROM (SELECT *, ceil(shard_size / 16.0)::BIGINT AS n FROM won) WHERE n > 0
    )
),
laid AS (
    SELECT *, end_ - size AS begin_ FROM (
        SELECT *, sum(size) OVER (PARTITION BY source, shard ORDER BY {_digits("'place'", "doc_id")}, doc_id, size
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS end_
        FROM placed
    )
)
SELECT l.doc_id, l.size, l.source_size, l.target,
    (coalesce(passes, 0) * size
     + coalesce(greatest(0, least(end_, (first_block + rest) * 16) - greatest(begin_, first_block * 16)), 0))::BIGINT AS taken
FROM laid l LEFT JOIN draws d ON l.source IS NOT DISTINCT FROM d.source AND l.shard = d.shard
"""



def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_NORMAL = r"list_filter(string_split(regexp_replace(lower(x), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda s: s <> '')"

OP4 = f"""
WITH raw AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
),
units AS (
    SELECT row_number() OVER () AS u, r, {_NORMAL} AS w FROM (
        SELECT r, UNNEST(string_split(t, chr(10))) AS x FROM raw
        UNION ALL
        SELECT r, x FROM (SELECT r, UNNEST(string_split_regex(t, '\n[ \t\r]*\n')) AS x FROM raw) WHERE contains(x, chr(10))
    )
),
templates AS (
    SELECT row_number() OVER () AS k, licence, {_NORMAL} AS w
    FROM (VALUES {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in TEMPLATES)}) AS v(licence, x)
),
unit_pairs AS (SELECT u, p, count(*) AS n FROM (
    SELECT u, UNNEST(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS p
    FROM units) GROUP BY ALL),
template_pairs AS (SELECT k, licence, p, count(*) AS n FROM (
    SELECT k, licence, UNNEST(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS p
    FROM templates) GROUP BY ALL),
unit_size AS (SELECT u, sum(n) AS n FROM unit_pairs GROUP BY u),
template_size AS (SELECT k, sum(n) AS n FROM template_pairs GROUP BY k),
scored AS (
    SELECT u, licence, 2.0::DOUBLE * sum(least(a.n, b.n)) / (any_value(c.n) + any_value(d.n)) AS dice
    FROM unit_pairs a JOIN template_pairs b USING (p) JOIN unit_size c USING (u) JOIN template_size d USING (k)
    GROUP BY u, k, licence
),
hits AS (SELECT u, max(dice) AS dice, arg_min(licence, (-dice, licence)) AS licence FROM scored GROUP BY u HAVING max(dice) >= 0.8),
found AS (
    SELECT r, count(*) AS n_matches, max(dice) AS dice, arg_min(licence, (-dice, licence)) AS licence
    FROM hits JOIN units USING (u) GROUP BY r
)
SELECT doc_id, licence, coalesce(dice, 0)::DOUBLE AS dice, coalesce(n_matches, 0)::BIGINT AS n_matches
FROM raw LEFT JOIN found USING (r)
"""

# CRC-32, bit by bit over the ASCII bytes of the id.
_CRC32 = """xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda x, y: list_reduce(list_prepend(xor(x, y), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda u, v: xor(u >> 1, 3988292384 * (u & 1)))))"""

OP11 = f"""
WITH raw AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w, coalesce({_CRC32}, 1) AS h FROM documents),
places AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM raw),
cycles AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM places),
texts AS (
    SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE
        list_transform(range(0, n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) END AS w
    FROM cycles
),
word AS (SELECT r, n, i, w[i + 1] AS x FROM texts, UNNEST(range(0, n)) AS t(i)),
alike AS (
    SELECT a.r, b.i - a.i AS q, a.i
    FROM word a JOIN word b ON a.r = b.r AND a.x = b.x AND b.i > a.i AND 4 * (b.i - a.i) <= a.n
),
stretches AS (
    SELECT r, q, min(i) AS s, count(*) + q AS l
    FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM alike)
    GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)
),
runs AS (SELECT r, s, l, min(q) AS q FROM stretches GROUP BY r, s, l),
gone AS (SELECT DISTINCT r, UNNEST(range(s + q, s + l)) AS i FROM runs),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (r, i) GROUP BY r),
told AS (
    SELECT r, count(*) AS n_runs, arg_min((s, l, q), (-l, s, q)) AS best,
        string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS t
    FROM runs GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best[1]::BIGINT AS start, best[2]::BIGINT AS length, best[3]::BIGINT AS period,
    (1000 * best[2] // best[3])::BIGINT AS exponent_milli, sha256(coalesce(told.t, '')) AS runs_sha256,
    sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM texts LEFT JOIN told USING (r) LEFT JOIN kept USING (r)
"""

_TERMS = r"""list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'),
    lambda t: translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))"""

OP13 = f"""
WITH raw AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
total AS (SELECT count(*) FILTER (len(t) > 0) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM raw),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, UNNEST(t) AS term FROM raw) GROUP BY ALL),
weights AS (
    SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY term
),
damped AS (SELECT r, doc_id, 75 + (25 * len(t) * n_docs) // n_terms AS m FROM raw, total WHERE len(t) > 0),
asked AS (SELECT i, item_id, UNNEST(t) AS term FROM (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS t FROM benchmark)),
wanted AS (SELECT i, item_id, term, count(*) AS times FROM asked GROUP BY ALL),
scored AS (
    SELECT i, item_id, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
    FROM wanted JOIN weights USING (term) JOIN tf USING (term) JOIN damped USING (r) GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 20
"""

ORACLES: dict[str, str] = {
    "op1_substring_dedup": OP1,
    "op2_source_mixing": OP2,
    "op4_licence_scan": OP4,
    "op11_periodic_runs": OP11,
    "op13_lexical_search": OP13,
}
