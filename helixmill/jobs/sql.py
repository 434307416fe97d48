"""The catalogue's queries in DuckDB SQL, for checking results side by side."""

from __future__ import annotations

from ..functions.hashing import P1, P2, P3, P4, P5, SEED
from ..functions.params import SketchParams, ordered

SOURCE = "TRY_CAST(regexp_extract(source, '([0-9]+)', 1) AS BIGINT)"
MASK = "18446744073709551616::UHUGEINT"


def fold(d: str) -> str:
    """A digit string as a number."""
    return f"list_reduce(list_transform(string_split({d}, ''), lambda x: x::BIGINT), lambda a, b: a * 4 + b)"


def turned(d: str) -> str:
    return f"translate(reverse({d}), '0123', '2301')"


def records(sketch: str = "doc_id", other: str = "") -> str:
    """Cleaned records; those that belong to no sketch are left out.  Other letters are replaced."""
    rows = f"SELECT {sketch} AS sketch_id, doc_id AS rec_id, upper(regexp_replace(coalesce(text, ''), '[^ACGTacgt]', '{other}', 'g')) AS seq FROM documents"
    return f"recs AS (SELECT * FROM ({rows}) WHERE sketch_id IS NOT NULL)"


def decycling(d: str, m: int) -> str:
    """Class of a digit string of m bases under the decycling set."""
    sines = "list_sum(list_transform(generate_series(1, {m}), lambda i: CAST(substr({d}, CAST(i AS INT), 1) AS DOUBLE) * sin(2 * pi() * (i - 1) / {m})))"
    here, turned = sines.format(m=m, d=d), sines.format(m=m, d=f"(substr({d}, {m}, 1) || substr({d}, 1, {m - 1}))")
    return f"CASE WHEN {here} > 1e-6 AND {turned} < 1e-6 THEN 2 WHEN {here} < -1e-6 AND {turned} > -1e-6 THEN 1 ELSE 0 END"


def hashes(codes: str, decycling_m: int | None = None) -> str:
    """CTEs from a table ``codes`` (cd) to ``hashed`` (cd, cm, ho): number and hash order of each digit string (by class first, if a size is given)."""

    def mul(a: str, p: int) -> str:
        return f"(({a}) * {p}::UHUGEINT) % {MASK}"

    last = "x"
    if decycling_m:
        last = f"(x % {2**62}::UHUGEINT + CASE {decycling('cd', decycling_m)} WHEN 2 THEN 0::UHUGEINT WHEN 1 THEN {2**62}::UHUGEINT ELSE {2**63}::UHUGEINT END)"

    def rotl(a: str, b: int) -> str:
        return f"(({a}) % {2 ** (64 - b)}::UHUGEINT) * {2**b}::UHUGEINT + ({a}) // {2 ** (64 - b)}::UHUGEINT"

    return f"""
h0 AS (SELECT cd, {fold("cd")} AS cm FROM {codes}),
h1 AS (SELECT cd, cm, {mul("cm::UHUGEINT", P2)} AS x FROM h0),
h2 AS (SELECT cd, cm, {rotl("x", 31)} AS x FROM h1),
h3 AS (SELECT cd, cm, xor({SEED + 8}::UHUGEINT + {P5}::UHUGEINT, {mul("x", P1)}) AS x FROM h2),
h4 AS (SELECT cd, cm, {rotl("x", 27)} AS x FROM h3),
h5 AS (SELECT cd, cm, (({mul("x", P1)}) + {P4}::UHUGEINT) % {MASK} AS x FROM h4),
h6 AS (SELECT cd, cm, {mul("xor(x, x // 8589934592::UHUGEINT)", P2)} AS x FROM h5),
h7 AS (SELECT cd, cm, {mul("xor(x, x // 536870912::UHUGEINT)", P3)} AS x FROM h6),
h8 AS (SELECT cd, cm, xor(x, x // 4294967296::UHUGEINT) AS x FROM h7),
hashed AS (SELECT cd, cm, ({last}::HUGEINT - 9223372036854775808::HUGEINT)::BIGINT AS ho FROM h8)"""


def minimizers(p: SketchParams, sketch: str = "doc_id", gaps: bool = False) -> str:
    """CTEs up to ``mins`` (sketch_id, rec_id, pos, kd, minimizer, ho, mpos, is_rev)."""
    whole = lambda d: f" WHERE NOT contains({d}, 'N')" if gaps else ""
    return f"""{records(sketch, "N" if gaps else "")},
dig AS (SELECT sketch_id, rec_id, translate(seq, 'ACTG', '0123') AS d FROM recs WHERE length(seq) >= {p.k}),
spots AS (SELECT sketch_id, rec_id, d, unnest(generate_series(0, length(d) - {p.m})) AS pos FROM dig),
mm AS (SELECT sketch_id, rec_id, pos, substr(d, pos + 1, {p.m}) AS md, CASE WHEN pos <= length(d) - {p.k} THEN substr(d, pos + 1, {p.k}) END AS kd FROM spots),
mc AS (SELECT *, least(md, {turned("md")}) AS cd FROM mm{whole("md")}),
distinct_codes AS (SELECT DISTINCT cd FROM mc),{hashes("distinct_codes", p.m if p.order == "decycling" else None)},
keyed AS (SELECT sketch_id, rec_id, pos, kd, ((ho::HUGEINT + 9223372036854775808::HUGEINT) * 1048576 + pos) * 2 + (cd <> md)::INT AS key FROM mc JOIN hashed USING (cd)),
best AS (SELECT sketch_id, rec_id, pos, kd, min(key) OVER (PARTITION BY sketch_id, rec_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {p.k - p.m} FOLLOWING) AS key FROM keyed),
told AS (SELECT sketch_id, rec_id, pos, kd, (key // 2097152 - 9223372036854775808::HUGEINT)::BIGINT AS ho, CAST(key // 2 % 1048576 AS BIGINT) AS mpos, key % 2 = 1 AS is_rev FROM best WHERE kd IS NOT NULL{' AND NOT contains(kd, chr(78))' if gaps else ''}),
mins AS (SELECT sketch_id, rec_id, pos, kd, cm AS minimizer, told.ho, mpos, is_rev FROM told JOIN hashed ON told.ho = hashed.ho)"""


def kmer(p: SketchParams, d: str = "kd") -> str:
    least = f"least({d}, {turned(d)})"
    if p.k <= 31:
        return fold(least)
    low = f"list_reduce(list_transform(string_split(substr({least}, {p.k - 31}), ''), lambda x: x::HUGEINT), lambda a, b: a * 4 + b)"
    return f"struct_pack(hi := {fold(f'substr({least}, 1, {p.k - 32})')}, lo := ({low} - 9223372036854775808::HUGEINT)::BIGINT)"


def sketch(p: SketchParams, of: str = "doc_id", gaps: bool = False) -> str:
    """CTEs up to ``sk`` (sketch_id, minimizer, kmer, cnt, pos_min) and ``sizes`` (sketch_id, n)."""
    return f"""{minimizers(p, of, gaps)},
sel AS (SELECT sketch_id, minimizer, {kmer(p)} AS kmer, CAST(mpos - pos AS BIGINT) AS pos_min FROM mins WHERE ho <= {ordered(p.threshold())}),
sk AS (SELECT sketch_id, minimizer, kmer, CAST(count(*) AS BIGINT) AS cnt, min(pos_min) AS pos_min FROM sel GROUP BY sketch_id, minimizer, kmer HAVING count(*) >= {p.abundance}),
sizes AS (SELECT sketch_id, CAST(count(*) AS BIGINT) AS n FROM sk GROUP BY sketch_id)"""


def segments(p: SketchParams) -> str:
    """CTEs up to ``seg``, one row a super-k-mer."""
    return f"""{minimizers(p)},
seg AS (SELECT sketch_id, rec_id, CAST(min(pos) AS BIGINT) AS start, CAST(count(*) + {p.k - 1} AS BIGINT) AS len, CAST(count(*) AS BIGINT) AS n_kmers,
               any_value(minimizer) AS minimizer, any_value(ho) AS ho, any_value(is_rev) AS is_rev,
               count(*) = {p.window} AS is_maximal, any_value(ho) <= {ordered(p.threshold())} AS selected
        FROM mins GROUP BY sketch_id, rec_id, mpos)"""


def tracked(p: SketchParams) -> str:
    """CTEs (recursive ones among them) up to ``cut`` (sketch_id, rec_id, start, len, n_kmers, minimizer, ho, is_rev, is_maximal, selected): super-k-mers of a scan that remembers one position."""
    w = p.k - p.m
    return f"""{minimizers(p)},
spotted AS (SELECT sketch_id, rec_id, pos, ho, cd <> md AS turned FROM mc JOIN hashed USING (cd)),
met AS (SELECT t.sketch_id, t.rec_id, t.pos, t.ho, list([t.pos + {w} - s.pos, s.turned::INT] ORDER BY s.pos DESC) AS found
        FROM mins t JOIN spotted s ON t.sketch_id = s.sketch_id AND t.rec_id = s.rec_id AND t.ho = s.ho AND s.pos BETWEEN t.pos AND t.pos + {w} GROUP BY ALL),
alike AS (SELECT *, found[1][1] AS nearest, found[1][2] = 1 AS rev, list_transform(list_filter(found, lambda x: x[2] = found[1][2]), lambda x: x[1]) AS same FROM met),
placed AS (SELECT sketch_id, rec_id, pos, ho, rev, CASE WHEN rev THEN least(CASE WHEN nearest = 0 THEN 0 ELSE {w} - nearest END, coalesce(same[2], {w})) ELSE {w} - same[len(same)] END AS place FROM alike),
lagged AS (SELECT *, coalesce(lag(ho) OVER (PARTITION BY sketch_id, rec_id ORDER BY pos) > ho, false) AS smaller FROM placed),
ahead AS (SELECT l.sketch_id, l.rec_id, l.pos, l.ho, CASE WHEN smaller THEN s.turned ELSE rev END AS rev, l.pos + CASE WHEN smaller THEN {w + 1} ELSE place + 1 END AS reach,
          min(CASE WHEN smaller THEN l.pos END) OVER (PARTITION BY l.sketch_id, l.rec_id ORDER BY l.pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nearest
          FROM lagged l JOIN spotted s ON s.sketch_id = l.sketch_id AND s.rec_id = l.rec_id AND s.pos = l.pos + {w}),
steps AS (SELECT sketch_id, rec_id, pos, ho, rev, least(reach, coalesce(nearest, reach)) AS follow FROM ahead),
orbit AS (SELECT sketch_id, rec_id, pos, follow FROM steps WHERE pos = 0
          UNION ALL SELECT s.sketch_id, s.rec_id, s.pos, s.follow FROM orbit o JOIN steps s ON s.sketch_id = o.sketch_id AND s.rec_id = o.rec_id AND s.pos = o.follow),
ends AS (SELECT sketch_id, rec_id, max(pos) + 1 AS n FROM mins GROUP BY ALL),
cut AS (SELECT o.sketch_id, o.rec_id, CAST(o.pos AS BIGINT) AS start, CAST(least(o.follow, n) - o.pos + {p.k - 1} AS BIGINT) AS len, CAST(least(o.follow, n) - o.pos AS BIGINT) AS n_kmers, minimizer, m.ho, s.rev AS is_rev,
        least(o.follow, n) - o.pos = {p.window} AS is_maximal, m.ho <= {ordered(p.threshold())} AS selected
        FROM orbit o JOIN ends USING (sketch_id, rec_id) JOIN steps s ON s.sketch_id = o.sketch_id AND s.rec_id = o.rec_id AND s.pos = o.pos JOIN mins m ON m.sketch_id = o.sketch_id AND m.rec_id = o.rec_id AND m.pos = o.pos)"""


def letters(n: str, size: int) -> str:
    """Bases of a number."""
    return f"translate(array_to_string(list_transform(generate_series({size - 1}, 0, -1), lambda i: ({n} >> CAST(2 * i AS INT)) & 3), ''), '0123', 'ACTG')"


def rebuilt(p: SketchParams, of: str = "doc_id") -> str:
    """CTEs (recursive ones among them) up to ``chains`` (sketch_id, minimizer, seq, n_kmers): a sketch packed into super-k-mers."""
    return f"""{sketch(p, of)},
texts AS (SELECT sketch_id, minimizer, {letters("kmer", p.k)} AS x, {letters("minimizer", p.m)} AS own FROM sk),
turned AS (SELECT sketch_id, minimizer, own, CASE WHEN contains(x, own) THEN x ELSE translate(reverse(x), 'ACGT', 'TGCA') END AS x FROM texts),
nodes AS (SELECT sketch_id, minimizer, x, instr(x, own) - 1 AS spot FROM turned),
befores AS (SELECT *, substr(x, 2) AS overlap, row_number() OVER (PARTITION BY sketch_id, minimizer, spot, substr(x, 2) ORDER BY instr('ATCG', substr(x, 1, 1))) AS n FROM nodes WHERE spot > 0),
behinds AS (SELECT *, substr(x, 1, {p.k - 1}) AS overlap, row_number() OVER (PARTITION BY sketch_id, minimizer, spot, substr(x, 1, {p.k - 1}) ORDER BY instr('ATCG', substr(x, {p.k}, 1))) AS n FROM nodes),
linked AS (SELECT b.sketch_id, b.minimizer, b.x, a.x AS follower FROM befores b JOIN behinds a ON a.sketch_id = b.sketch_id AND a.minimizer = b.minimizer AND a.overlap = b.overlap AND a.spot = b.spot - 1 AND a.n = b.n),
grown AS (
  SELECT sketch_id, minimizer, x AS last, x AS seq, 1 AS n FROM nodes ANTI JOIN linked ON linked.sketch_id = nodes.sketch_id AND linked.minimizer = nodes.minimizer AND linked.follower = nodes.x
  UNION ALL
  SELECT g.sketch_id, g.minimizer, follower, seq || substr(follower, {p.k}), n + 1 FROM grown g JOIN linked l ON l.sketch_id = g.sketch_id AND l.minimizer = g.minimizer AND l.x = g.last
),
chains AS (SELECT sketch_id, minimizer, seq, CAST(n AS BIGINT) AS n_kmers FROM grown ANTI JOIN linked ON linked.sketch_id = grown.sketch_id AND linked.minimizer = grown.minimizer AND linked.x = grown.last)"""


PAIRS = """
pairs AS (SELECT a.sketch_id AS i, b.sketch_id AS j, CAST(count(*) AS BIGINT) AS n_shared
          FROM sk a JOIN sk b ON a.minimizer = b.minimizer AND a.kmer = b.kmer AND a.sketch_id < b.sketch_id GROUP BY ALL),
scores AS (SELECT i, j, n_shared, x.n AS n_i, y.n AS n_j, n_shared::DOUBLE / x.n AS containment_ij, n_shared::DOUBLE / y.n AS containment_ji,
                  n_shared::DOUBLE / (x.n + y.n - n_shared) AS jaccard
           FROM pairs JOIN sizes x ON i = x.sketch_id JOIN sizes y ON j = y.sketch_id)"""


def dense(column: str, scores: str = "scores", sizes: str = "sizes", to: str = "cells") -> str:
    """CTE of all cells (i, j, value) of a symmetric matrix."""
    return f"""
{to} AS (SELECT a.sketch_id AS i, b.sketch_id AS j, CASE WHEN a.sketch_id = b.sketch_id THEN 1.0::DOUBLE ELSE coalesce(s.{column}, t.{column}, 0.0)::DOUBLE END AS value
         FROM {sizes} a CROSS JOIN {sizes} b
         LEFT JOIN {scores} s ON s.i = a.sketch_id AND s.j = b.sketch_id LEFT JOIN {scores} t ON t.i = b.sketch_id AND t.j = a.sketch_id)"""


def both(p: SketchParams, of: str) -> str:
    """CTEs for a sketch (``cells``) and the exact comparison of the same k-mers (``exact``)."""
    return f"""{sketch(p, of)},{PAIRS},{dense("jaccard")},
all_k AS (SELECT sketch_id, minimizer, {kmer(p)} AS kmer FROM mins GROUP BY ALL),
all_n AS (SELECT sketch_id, CAST(count(*) AS BIGINT) AS n FROM all_k GROUP BY sketch_id),
all_pairs AS (SELECT a.sketch_id AS i, b.sketch_id AS j, count(*) AS n_shared FROM all_k a JOIN all_k b ON a.kmer = b.kmer AND a.sketch_id < b.sketch_id GROUP BY ALL),
all_scores AS (SELECT i, j, n_shared::DOUBLE / (x.n + y.n - n_shared) AS jaccard FROM all_pairs JOIN all_n x ON i = x.sketch_id JOIN all_n y ON j = y.sketch_id),
{dense("jaccard", "all_scores", "all_n", "exact").strip()},
tri AS (SELECT i, j, e.value AS truth, c.value AS estimate, e.value - c.value AS d FROM exact e JOIN cells c USING (i, j) WHERE i > j)"""
