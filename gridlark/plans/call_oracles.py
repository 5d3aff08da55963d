"""DuckDB SQL of the callers, record sinks, features and helpers, and of models that need log-gamma or recursion."""

from __future__ import annotations

import math

from gridlark.plans.oracles import _C, _FREQ, _LN, _MIX, BOTH, GT, OBS, REF, REG, SCORED, bias, called, lnp, merged, phred, tidy

LN10 = repr(math.log(10))


def chain(*steps: str) -> str:
    return "WITH " + ", ".join(steps) + " "


def lse(e: str) -> str:
    """ln of the sum of exp over a list column."""
    return f"(list_max({e}) + ln(list_sum(list_transform({e}, lambda x: exp(x - list_max({e}))))))"


def pl(e: str) -> str:
    """A list of ln likelihoods as text of PL."""
    return f"array_to_string(list_transform({e}, lambda x: CAST(CAST(floor(-10 * (x - list_max({e})) / {LN10} + 0.5) AS BIGINT) AS VARCHAR)), ',')"


def pmf(n: str, k: str, p: str) -> str:
    return f"exp(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1) + {k} * ln({p}) + ({n} - {k}) * ln(1 - {p}))"


def tail(n: str, lo: str, hi: str, p: str, v: str) -> str:
    return f"least(1.0, list_sum(list_transform(range(CAST({lo} AS BIGINT), CAST({hi} AS BIGINT) + 1), lambda {v}: {pmf(n, v, p)})))"


_ALT_F = [f"sum(ln(CASE WHEN alt THEN {f} * (1 - pow(10.0, -greatest(q, 1) / 10.0)) + (1 - {f}) * pow(10.0, -greatest(q, 1) / 10.0) ELSE (1 - {f}) * (1 - pow(10.0, -greatest(q, 1) / 10.0)) + {f} * pow(10.0, -greatest(q, 1) / 10.0) END))" for f in _FREQ]


def somatic(rows: str, tag: str = "") -> list[str]:
    """CTEs from rows (pos, sample, alt, q) to `som` with pos, gt, qss, qss_nt and callable."""
    n, theta, rate, shared = len(_FREQ), 0.001, 1e-6, 5e-6
    spread = math.log(1 / (n - 1))
    prior = [math.log(1 - 1.5 * theta), math.log(theta), math.log(theta / 2)]
    mixed = [i for i, f in enumerate(_FREQ) if 0.15 * f >= 0.05]
    steps = [f"fl{tag} AS (SELECT pos, sample, [{', '.join(_ALT_F)}] AS f FROM {rows} GROUP BY pos, sample)", f"nt{tag} AS (SELECT a.pos, a.f AS n, b.f AS t FROM fl{tag} a JOIN fl{tag} b ON a.pos = b.pos AND a.sample = 0 AND b.sample = 1)"]
    lists = []
    for g in range(3):
        same = ", ".join(f"n[{i + 1}] + t[{i + 1}] + {math.log1p(-shared) if i == g else math.log(shared) + spread!r}" for i in range(n))
        if g == 0:
            som = [f"t[{i + 1}] + n[1] + {spread + (math.log(0.5) if i in mixed else 0.0)!r}" for i in range(1, n)] + [f"t[{i + 1}] + n[4] + {spread + math.log(0.5)!r}" for i in mixed if i != 3]
        else:
            som = [f"t[{i + 1}] + n[{g + 1}] + {spread!r}" for i in range(n) if i != g]
        lists += [f"[{same}] AS a{g}", f"[{', '.join(som)}] AS b{g}"]
    steps.append(f"ls{tag} AS (SELECT pos, {', '.join(lists)} FROM nt{tag})")
    parts = ", ".join(f"{lse(f'a{g}')} + {prior[g] + math.log1p(-rate)!r} AS s{2 * g}, {lse(f'b{g}')} + {prior[g] + math.log(rate)!r} AS s{2 * g + 1}" for g in range(3))
    steps.append(f"sw{tag} AS (SELECT pos, {parts} FROM ls{tag})")
    top = f"greatest({', '.join(f's{i}' for i in range(6))})"
    steps.append(f"sx{tag} AS (SELECT pos, {', '.join(f'exp(s{i} - {top}) AS x{i}' for i in range(6))} FROM sw{tag})")
    steps.append(f"sp{tag} AS (SELECT pos, {', '.join(f'x{i} / (x0 + x1 + x2 + x3 + x4 + x5) AS p{i}' for i in range(6))} FROM sx{tag})")
    steps.append(f"sg{tag} AS (SELECT *, CASE WHEN p0 + p1 >= p2 + p3 AND p0 + p1 >= p4 + p5 THEN 0 WHEN p2 + p3 >= p4 + p5 THEN 1 ELSE 2 END AS gt FROM sp{tag})")
    rest = "(" + " + ".join(f"(CASE WHEN gt = {(i - 1) // 2 if i % 2 else -1} THEN 0 ELSE p{i} END)" for i in range(6)) + ")"
    steps.append(f"som{tag} AS (SELECT pos, gt, {phred('(p0 + p2 + p4)')} AS qss, {phred(rest)} AS qss_nt, {phred('(p1 + p3 + p5)')} AS qns FROM sg{tag})")
    return steps


def alt_rows(least: int) -> str:
    return f"(SELECT pos, sample, base <> ref AS alt, q FROM obs JOIN ref USING (pos) WHERE q >= {least})"


_TWO = "two AS (SELECT pos FROM (SELECT pos, base, n, row_number() OVER (PARTITION BY pos ORDER BY n DESC, base) AS r, sum(n) OVER (PARTITION BY pos) AS al FROM (SELECT pos, base, count(*) AS n FROM obs GROUP BY 1, 2)) GROUP BY pos HAVING bool_or(base = 'R' AND r <= 2) AND sum(CASE WHEN r <= 2 THEN n ELSE 0 END) >= 0.7 * any_value(al))"
_INDEL_ROWS = "(SELECT pos, sample, base = 'R' AS alt, q FROM obs WHERE pos IN (SELECT pos FROM two))"
_THETA = "th AS (SELECT p_partkey AS pos, 1e-4 * (1 + p_size % 20) AS theta FROM part)"


def germline_indels() -> list[str]:
    names = ", ".join(f"'{a}/{b}'" for a, b in GT)
    prior = ["ln(1 - 1.5 * theta)" if a == b == "N" else "ln(theta / 2)" if a == b else "ln(theta)" if "N" in (a, b) else "2 * ln(theta)" for a, b in GT]
    return [
        _THETA,
        f"gl AS (SELECT pos, [{', '.join(_MIX)}] AS l FROM obs GROUP BY pos)",
        f"gw AS (SELECT pos, l, [{', '.join(f'l[{i + 1}] + {p}' for i, p in enumerate(prior))}] AS w FROM gl JOIN th USING (pos))",
        "gx AS (SELECT pos, l, w, list_transform(w, lambda x: exp(x - list_max(w))) AS x FROM gw)",
        "gb AS (SELECT pos, l, x, list_sum(x) AS tot, list_position(x, list_max(x)) AS b FROM gx)",
        f"gi AS (SELECT pos, [{names}][b] AS gt, {phred('(list_sum(list_transform(x, lambda v, i: CASE WHEN i = b THEN 0.0 ELSE v END)) / tot)')} AS gq, {phred('(x[3] / tot)')} AS qual, {pl('l')} AS pl FROM gb)",
    ]


def tallies() -> str:
    kinds = {"ref": "base = 'N'", "indel": "base = 'R'", "other": "base = 'A'"}
    cols = ", ".join(f"{_C(f'{k} AND mapq >= {q} AND {s}')} AS {name}{i}_{strand}" for name, k in kinds.items() for i, q in ((1, 20), (2, 5)) for strand, s in (("fwd", "is_fwd"), ("rev", "NOT is_fwd")))
    return f"tal AS (SELECT pos, sample, {cols} FROM obs GROUP BY 1, 2)"


_STRANDS = f"st AS (SELECT pos, {_C('base <> ref AND is_fwd')} AS fa, {_C('base <> ref AND NOT is_fwd')} AS ra, {_C('base = ref AND is_fwd')} AS fo, {_C('base = ref AND NOT is_fwd')} AS ro FROM obs JOIN ref USING (pos) GROUP BY pos)"
_FISHER = "exp(lgamma(r + 1) - lgamma(i + 1) - lgamma(r - i + 1) + lgamma(n - r + 1) - lgamma(k - i + 1) - lgamma(n - r - k + i + 1) - lgamma(n + 1) + lgamma(k + 1) + lgamma(n - k + 1))"

ORACLES: dict[str, str] = {
    "exact_tests": f"""WITH {OBS}, {REF}, {_STRANDS}, m AS (SELECT *, fa + ra AS r, fa + ra + fo + ro AS n, fa + fo AS k FROM st), f AS (SELECT *, list_transform(range(greatest(0, k - (n - r)), least(r, k) + 1), lambda i: {_FISHER}) AS ps, list_transform([fa], lambda i: {_FISHER})[1] AS seen FROM m)
 SELECT pos, {tidy(f"least(1.0, 2 * least({tail('r', '0', 'fa', '0.5', 'i')}, CASE WHEN fa <= 0 THEN 1.0 ELSE {tail('r', 'fa', 'r', '0.5', 'i')} END))", 6)} AS strand_p, {tidy(f"CASE WHEN r <= 0 THEN 1.0 ELSE {tail('n', 'r', 'n', '0.05', 'i')} END", 6)} AS alt_p, {tidy('least(1.0, list_sum(list_filter(ps, lambda x: x <= seen * (1 + 1e-7))))', 6)} AS fisher_p, {tidy('least(1.0, list_sum(ps[fa - greatest(0, k - (n - r)) + 1 :]))', 6)} AS fisher_more, {tidy('least(1.0, list_sum(ps[: fa - greatest(0, k - (n - r)) + 1]))', 6)} AS fisher_less FROM f""",
    "indel_candidacy": f"""{BOTH}, t AS (SELECT pos, count(*) AS depth, {_C('base <> ref')} AS support FROM obs JOIN ref USING (pos) GROUP BY pos), d AS (SELECT DISTINCT depth FROM t),
 k AS (SELECT depth, unnest(range(0, depth + 2)) AS k FROM d), l AS (SELECT depth, min(k) AS least FROM k WHERE (CASE WHEN k <= 0 THEN 1.0 WHEN k > depth THEN 0.0 ELSE {tail('depth', 'k', 'depth', '0.3', 'i')} END) <= 1e-3 GROUP BY depth)
 SELECT pos, depth, support, least FROM t JOIN l USING (depth) WHERE support >= least AND depth >= 2""",
    "somatic_calls": chain(OBS, REF, *somatic(alt_rows(25), "1"), *somatic(alt_rows(5), "2")) + "SELECT pos, a.gt AS gt, CASE WHEN a.qss <= b.qss THEN 1 ELSE 2 END AS tier, least(a.qss, b.qss) AS qss, CASE WHEN a.gt <> b.gt THEN 0 ELSE least(a.qss_nt, b.qss_nt) END AS qss_nt FROM som1 a JOIN som2 b USING (pos)",
    "somatic_filters": chain(OBS, REF, *somatic(alt_rows(25)), f"o AS (SELECT pos, {_C('q >= 25')} AS used, {_C('q < 25')} AS unused, {_C('mapq = 0')} AS spanning FROM obs GROUP BY pos)")
    + "SELECT pos, gt, qss_nt, array_to_string(list_filter([CASE WHEN used + unused > 30 THEN 'HighDepth' END, CASE WHEN used + unused > 0 AND unused / CAST(used + unused AS DOUBLE) >= 0.4 THEN 'BCNoise' END, CASE WHEN used + spanning > 0 AND spanning / CAST(used + spanning AS DOUBLE) > 0.75 THEN 'SpanDel' END, CASE WHEN gt <> 0 OR qss_nt < 15 THEN 'QSS_ref' END], lambda x: x IS NOT NULL), ';') AS filters FROM som JOIN o USING (pos)",
    "callable_regions": chain(OBS, REF, *somatic(alt_rows(25)), "c AS (SELECT pos FROM som WHERE qss >= 15 OR qns >= 15)") + """SELECT 'all' AS contig, min(pos) AS "begin", max(pos) + 1 AS "end" FROM (SELECT pos, pos - row_number() OVER (ORDER BY pos) AS g FROM c) GROUP BY g""",
    "germline_indels": chain(OBS, *germline_indels()) + "SELECT * FROM gi",
    "continuous_indels": f"""WITH {OBS}, b AS (SELECT pos, base AS allele, count(*) AS n, {_C('is_fwd')} AS fwd FROM obs GROUP BY 1, 2), r AS (SELECT *, depth * pow(10.0, -1.7) AS lam FROM b JOIN (SELECT pos, CAST(sum(n) AS BIGINT) AS depth FROM b GROUP BY 1) USING (pos) WHERE allele <> 'N' AND n > 0.01 * depth),
 p AS (SELECT *, -lam + n * ln(lam) - lgamma(n + 1) + ln(list_sum(list_transform(range(0, 401), lambda i: exp(i * ln(lam) + lgamma(n + 1) - lgamma(n + i + 1))))) AS lp FROM r)
 SELECT pos, allele, n, fwd, depth, {tidy('n / CAST(depth AS DOUBLE)')} AS vf, CAST(least(100, floor(-10 * greatest(-307.0, lp / ln(10.0)) + 0.5)) AS INT) AS q FROM p""",
    "somatic_indels": chain(OBS, _TWO, *somatic(_INDEL_ROWS)) + "SELECT pos, gt, qss, qss_nt FROM som",
    "somatic_indel_tallies": f"WITH {OBS}, {tallies()} SELECT * FROM tal",
    "somatic_indel_filters": chain(OBS, _TWO, *somatic(_INDEL_ROWS), f"d AS (SELECT pos, {_C('sample = 0')} AS d0, {_C('sample = 1')} AS d1, avg(CASE WHEN sample = 0 THEN (CASE WHEN q < 10 THEN 1.0 ELSE 0.0 END) END) AS w0, avg(CASE WHEN sample = 1 THEN (CASE WHEN q < 10 THEN 1.0 ELSE 0.0 END) END) AS w1 FROM obs GROUP BY pos)")
    + "SELECT pos, array_to_string(list_filter([CASE WHEN least(d0, d1) > 12 THEN 'HighDepth' END, CASE WHEN greatest(w0, w1) >= 0.3 THEN 'IndelBCNoise' END, CASE WHEN gt <> 0 OR qss_nt < 30 THEN 'QSI_ref' END, CASE WHEN least(d0, d1) < 9 THEN 'LowDepth' END], lambda x: x IS NOT NULL), ';') AS filters FROM som JOIN d USING (pos)",
    "floating_reads": "SELECT l_linestatus, l_returnflag = 'A' AS floating, count(*) AS n FROM lineitem GROUP BY 1, 2",
    "synchronised_regions": f"""WITH {REG} SELECT contig, "begin", "end" - 9 AS "end", n AS regions FROM {merged('(SELECT contig, b, e + 9 AS e FROM reg)')}""",
    "forced_alleles": f"""WITH {REG}, m AS (SELECT * FROM {merged("(SELECT * FROM reg WHERE kind = 'PROMO')")}), rich AS (SELECT DISTINCT m.contig, m."begin", m."end" FROM m JOIN reg g ON g.contig = m.contig AND g.kind = 'LARGE' AND g.b >= m."begin" AND g.b < m."end")
 SELECT contig, b AS pos, kind, kind = 'LARGE' OR NOT EXISTS (SELECT 1 FROM rich r WHERE r.contig = f.contig AND f.b >= r."begin" AND f.b < r."end") AS genotyped FROM reg f WHERE kind IN ('SMALL', 'LARGE')""",
    "phasing_noise": f"{BOTH}, c AS (SELECT pos, read_id, {_C('base <> ref')} AS mm, bool_or(is_fwd) AS f, max(q) AS run FROM obs JOIN ref USING (pos) GROUP BY 1, 2), h AS (SELECT pos, max(mm) AS mismatches, {_C('f')} AS fwd, count(*) AS reads, max(run) AS run FROM c WHERE mm > 0 GROUP BY pos) SELECT pos, mismatches, fwd, reads, mismatches = 1 AND (fwd = 0 OR fwd = reads) AND run > 45 AS noise FROM h",
    "chromosome_depths": f"WITH {OBS}, d AS (SELECT pos, {_C('q >= 25')} AS depth FROM obs GROUP BY pos) SELECT p_brand AS contig, median(depth) AS median FROM d JOIN part ON pos = p_partkey WHERE depth > 0 GROUP BY 1",
    "spanned_depth": f"WITH {REG}, m AS (SELECT contig, sum(\"end\" - \"begin\") AS span FROM {merged('reg', 20)} GROUP BY 1), s AS (SELECT contig, sum(e - b) AS bases FROM reg GROUP BY 1) SELECT contig, CAST(bases AS BIGINT) AS bases, CAST(span AS BIGINT) AS span, {tidy('bases / CAST(span AS DOUBLE)')} AS depth FROM s JOIN m USING (contig)",
    "contig_sets": f"WITH {REG}, a AS (SELECT DISTINCT contig FROM reg WHERE kind = 'PROMO' AND e - b > 40), b AS (SELECT DISTINCT contig FROM reg WHERE kind = 'SMALL' AND e - b > 40), c AS (SELECT (SELECT count(*) FROM a WHERE contig NOT IN (SELECT contig FROM b)) AS only_first, (SELECT count(*) FROM b WHERE contig NOT IN (SELECT contig FROM a)) AS only_second) SELECT *, only_first = 0 AND only_second = 0 AS same FROM c",
    "shared_quality_levels": f"{BOTH}, c AS (SELECT ref, base <> ref AS alt, q, count(*) AS n FROM obs JOIN ref USING (pos) GROUP BY 1, 2, 3) SELECT ref, alt, string_agg(CAST(q AS VARCHAR), ',' ORDER BY q) AS levels, string_agg(CAST(n AS VARCHAR), ',' ORDER BY q) AS counts FROM c GROUP BY 1, 2",
    "soft_max_values": f"WITH t AS (SELECT p_partkey, (p_size - 25) / 10.0 AS x FROM part), s AS (SELECT *, 1 / (1 + exp(-x)) AS p, 1 + exp(x) + exp(-x) + exp(0.5) AS tot FROM t) SELECT p_partkey, {tidy('p', 6)} AS p, {tidy('2 + 3 * p', 6)} AS r, {tidy('ln(p / (1 - p))')} AS x, {tidy('exp(x) / tot', 6)} AS p0, {tidy('exp(0.5) / tot', 6)} AS p2, {tidy('ln((exp(0.5) / tot) / (1 / tot))')} AS x2 FROM s",
    "flank_repeat_counts": """WITH t AS (SELECT p_partkey, translate(lower(p_name || p_type || p_name), 'bcdfghjklmnpqrstvwxyzeiou ', 'aaaaaaaaaaaaaaaaaaaaabbbb') AS s, CAST(p_size % 6 + 3 AS BIGINT) AS a, CAST(p_size % 2 + 1 AS BIGINT) AS k FROM part), u AS (SELECT *, substr(s, a, k) AS u, left(s, a - 1) AS up, substr(s, a) AS down FROM t)
 SELECT p_partkey, s, CAST(list_max(list_filter(range(0, length(up) // k + 1), lambda i: right(up, CAST(i * k AS BIGINT)) = repeat(u, CAST(i AS BIGINT)))) AS INT) AS up, CAST(list_max(list_filter(range(0, length(down) // k + 1), lambda i: left(down, CAST(i * k AS BIGINT)) = repeat(u, CAST(i AS BIGINT)))) AS INT) AS down FROM u""",
    "ploidy_records": """SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN p_partkey END AS "begin", CASE WHEN p_size % 5 <> 0 THEN p_partkey + p_size END AS "end", CASE WHEN p_size % 5 <> 0 THEN CAST(p_size % 3 AS INT) END AS ploidy FROM part""",
    "pl_rectified": f"SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size || ',10000,0' ELSE '0,' || p_size || ',99' END AS pl, {tidy('CASE WHEN p_size % 2 = 0 THEN pow(10.0, -p_size / 10.0) + 1 ELSE 1 + pow(10.0, -p_size / 10.0) + pow(10.0, -9.9) END', 6)} AS total FROM part",
    "allele_bias": f"""{BOTH}, o AS (SELECT pos, {_C('base = ref')} AS r0, {_C('base <> ref')} AS r1 FROM obs JOIN ref USING (pos) GROUP BY pos), b AS (SELECT *, -ln({tail('(r0 + r1)', '0', 'r0', '0.5', 'i')} + 1e-30) AS lo, -ln({tail('(r0 + r1)', '0', 'r1', '0.5', 'i')} + 1e-30) AS up FROM o) SELECT pos, r0, r1, {tidy('lo')} AS lower, {tidy('greatest(lo, up)')} AS bias FROM b""",
    "score_overrides": f"WITH sc AS (SELECT d.doc_id AS id, CAST(n_chars % 100 AS BIGINT) AS score, toxic FROM documents d JOIN labels USING (doc_id)), o AS (SELECT id, CASE WHEN toxic <> 0 THEN 0.0 ELSE CAST(score AS DOUBLE) END AS own, score % 10 = 0 AS low FROM sc) SELECT id, own AS score, array_to_string(list_filter([CASE WHEN low THEN 'LowDepth' END, CASE WHEN own < 30 THEN 'LowEVS' END], lambda x: x IS NOT NULL), ';') AS filters FROM o",
    "feature_frames": "SELECT event_id, CAST(CAST(value AS DECIMAL(20,4)) AS DOUBLE) AS value, CASE WHEN user_id % 3 <> 0 THEN CAST(user_id AS DOUBLE) END AS user, CAST(length(event_type) AS DOUBLE) AS letters, CAST(NULL AS DOUBLE) AS absent FROM events",
    "integrated_curves": f"""WITH c AS (SELECT l_suppkey AS lib, CAST(floor(l_quantity) AS DOUBLE) AS x, count(*) / 10.0 AS y FROM lineitem GROUP BY 1, 2), s AS (SELECT *, lead(x) OVER w - x AS dx, lead(y) OVER w AS y2 FROM c WINDOW w AS (PARTITION BY lib ORDER BY x)), t AS (SELECT *, max(greatest(y, y2)) OVER (PARTITION BY lib) AS top FROM s WHERE dx IS NOT NULL)
 SELECT lib, {tidy('sum((y + y2) / 2 * dx)')} AS area, {tidy('max(top) + ln(sum((exp(y - top) + exp(y2 - top)) / 2 * dx))')} AS ln_area FROM t GROUP BY lib""",
    "likelihood_ratio_tests": f"{BOTH}, o AS (SELECT pos, count(*) AS n, {_C('base <> ref')} AS k FROM obs JOIN ref USING (pos) GROUP BY pos) SELECT pos, n, k, 2 * ({lnp('k', 'n', '(k / CAST(n AS DOUBLE))')} - {lnp('k', 'n', '0.6')}) > 3.841458820694124 AS rejected FROM o",
    "normalised_records": """WITH t AS (SELECT p_partkey, translate(lower(left(p_name, CAST(p_size % 4 + 1 AS INT))), 'bcdfghjklmnpqrstvwxyz', 'aaaaa') AS ref, translate(lower(left(p_type, CAST(p_size % 3 + 1 AS INT))), 'bcdfghjklmnpqrstvwxyz', 'aaaaa') AS alt FROM part)
 SELECT p_partkey, ref, alt, CASE WHEN length(ref) = length(alt) THEN right(ref, 1) <> right(alt, 1) AND left(ref, 1) <> left(alt, 1) ELSE least(length(ref), length(alt)) = 1 OR (right(ref, 1) <> right(alt, 1) AND left(ref, 2) <> left(alt, 2)) END AS normalised,
 CASE WHEN alt IN ('.', '') THEN 'ref' WHEN NOT (regexp_full_match(upper(ref), '[ACGTN]+') AND regexp_full_match(upper(alt), '[ACGTN]+')) THEN 'symbolic' WHEN length(ref) = 1 AND length(alt) = 1 THEN 'snv' WHEN length(ref) = length(alt) THEN 'mnv' ELSE 'indel' END AS kind FROM t""",
}


def _weighted() -> str:
    e = "least(0.75, pow(pow(10.0, -greatest(q, 1) / 10.0), w))"
    out = []
    for i, (a, b) in enumerate(GT):
        p = lambda x: f"(CASE WHEN base = '{x}' THEN 1 - {e} ELSE {e} / 2 END)"  # noqa: E731, B023
        out.append(f"sum(ln({p(a) if a == b else f'({p(a)} + {p(b)}) / 2'})) AS g{i}")
    return ", ".join(out)


_CALLED = called("pos")
ORACLES |= {
    "dependent_genotypes": f"{BOTH}, wt AS (SELECT *, greatest(0.25, pow(0.6, row_number() OVER (PARTITION BY pos, is_fwd, base ORDER BY q DESC, read_id, read_pos) - 1)) AS w FROM obs WHERE q >= 17), "
    + _CALLED.replace(_CALLED[: _CALLED.index("lr AS")], f"lh AS (SELECT pos, count(*) AS depth, {_weighted()} FROM wt GROUP BY pos), ")
    + f" SELECT pos, gt, gq, qual, {tidy('g0')} AS g0, {tidy('g3')} AS g3 FROM called",
}
_NUMBER = "CAST(least(list_position({al}, split_part(gt, '/', 1)), list_position({al}, split_part(gt, '/', 2))) - 1 AS VARCHAR) || '/' || CAST(greatest(list_position({al}, split_part(gt, '/', 1)), list_position({al}, split_part(gt, '/', 2))) - 1 AS VARCHAR)"
_COLS = ", ".join(f"{_C(f'''q >= 17 AND base = '{a}' AND {s}''')} AS {t}{a}" for a in "ANR" for t, s in (("f", "is_fwd"), ("r", "NOT is_fwd")))
_OF = "(CASE al[{i}] WHEN 'A' THEN {t}A WHEN 'N' THEN {t}N ELSE {t}R END)"


def _site_lines() -> str:
    at = {f"{t}{i}": _OF.format(i=i + 1, t=t) for t in "fr" for i in range(3)}
    cols = ", ".join(f"{x} AS {k}" for k, x in at.items())
    sb = bias("(f1 + f2)", "(r1 + r2)", "f0", "r0")
    ft = "CASE WHEN m = 0 THEN 'PASS' ELSE array_to_string(list_filter([CASE WHEN m & 1 <> 0 THEN 'LowGQX' END, CASE WHEN m & 2 <> 0 THEN 'HighDepth' END, CASE WHEN m & 4 <> 0 THEN 'HighDPFRatio' END, CASE WHEN m & 16 <> 0 THEN 'LowDepth' END], lambda x: x IS NOT NULL), ';') END"
    text = lambda *xs: "concat_ws(',', " + ", ".join(f"CAST({x} AS VARCHAR)" for x in xs) + ")"
    return f"""{BOTH}, {_CALLED}, c AS (SELECT pos, {_C('q >= 17')} AS dp, {_C('q < 17')} AS dpf, CAST(round(sqrt(avg(mapq * mapq))) AS INT) AS mq, {_COLS} FROM obs GROUP BY pos),
 a AS (SELECT *, list_concat([ref], list_filter(['A', 'N', 'R'], lambda x: x <> ref)) AS al, [g0, g1, g2, g3, g4, g5] AS l FROM called JOIN c USING (pos)), b AS (SELECT *, {cols} FROM a),
 f AS (SELECT *, (CASE WHEN gqx < 15 THEN 1 ELSE 0 END) + (CASE WHEN dp + dpf > 48 THEN 2 ELSE 0 END) + (CASE WHEN dpf > 0.4 * (dp + dpf) THEN 4 ELSE 0 END) + (CASE WHEN dp < 3 THEN 16 ELSE 0 END) AS m, {sb} AS sb FROM b), h AS (SELECT *, {ft} AS ft FROM f)
 SELECT concat_ws(chr(9), 'chr1', CAST(pos + 1 AS VARCHAR), '.', ref, array_to_string(al[2:3], ','), CAST(qual AS VARCHAR), ft, 'SNVHPOL=1;MQ=' || CAST(mq AS VARCHAR), 'GT:GQ:GQX:DP:DPF:AD:ADF:ADR:SB:FT:PL',
 concat_ws(':', {_NUMBER.format(al='al')}, CAST(gq AS VARCHAR), CAST(gqx AS VARCHAR), CAST(dp AS VARCHAR), CAST(dpf AS VARCHAR), {text('f0 + r0', 'f1 + r1', 'f2 + r2')}, {text('f0', 'f1', 'f2')}, {text('r0', 'r1', 'r2')}, printf('%.1f', sb + 0.0), ft, {pl('l')})) AS line FROM h"""


_TEXT = "CAST(ref{i}_fwd + ref{i}_rev + indel{i}_fwd + indel{i}_rev + other{i}_fwd + other{i}_rev AS VARCHAR)"
_TIERS = "concat_ws(':', " + ", ".join(_TEXT.format(i=i) for i in (1, 2)) + ", " + ", ".join(f"CAST({k}1_fwd + {k}1_rev AS VARCHAR) || ',' || CAST({k}2_fwd + {k}2_rev AS VARCHAR)" for k in ("ref", "indel", "other")) + ")"
_ICOLS = ", ".join(f"{_C(f'''base = '{a}' AND {s}''')} AS {t}{a}" for a in "NAR" for t, s in (("f", "is_fwd"), ("r", "NOT is_fwd")))
_OWN = ", ".join(
    [f"{_C(f'sample = {i}')} AS {t}dp, {_C(f'sample = {i} AND q < 25')} AS {t}fdp" for i, t in ((0, "n"), (1, "t"))]
    + [f"CAST({_C(f'''sample = {i} AND base = '{a}' AND q >= 25''')} AS VARCHAR) || ',' || CAST({_C(f'''sample = {i} AND base = '{a}' ''')} AS VARCHAR) AS {t}{a}" for i, t in ((0, "n"), (1, "t")) for a in "ANR"]
)
ORACLES |= {
    "germline_site_lines": _site_lines(),
    "germline_indel_lines": chain(OBS, *germline_indels(), f"c AS (SELECT pos, count(*) AS dpi, {_ICOLS} FROM obs GROUP BY pos)", "j AS (SELECT *, CASE WHEN gq < 15 THEN 'LowGQX' ELSE 'PASS' END AS ft FROM gi JOIN c USING (pos))")
    + f"""SELECT concat_ws(chr(9), 'chr1', CAST(pos + 1 AS VARCHAR), '.', 'NR', 'NRA,N', CAST(qual AS VARCHAR), ft, 'CIGAR=1M1I,1M1D;RU=A,.;REFREP=1,.;IDREP=2,.', 'GT:GQ:GQX:DPI:AD:ADF:ADR:FT:PL', concat_ws(':', {_NUMBER.format(al="['N','A','R']")}, CAST(gq AS VARCHAR), CAST(gq AS VARCHAR), CAST(dpi AS VARCHAR), concat_ws(',', CAST("fN" + "rN" AS VARCHAR), CAST("fA" + "rA" AS VARCHAR), CAST("fR" + "rR" AS VARCHAR)), concat_ws(',', CAST("fN" AS VARCHAR), CAST("fA" AS VARCHAR), CAST("fR" AS VARCHAR)), concat_ws(',', CAST("rN" AS VARCHAR), CAST("rA" AS VARCHAR), CAST("rR" AS VARCHAR)), ft, pl)) AS line FROM j""",
    "somatic_site_lines": chain(OBS, REF, *somatic(alt_rows(25)), f"c AS (SELECT pos, {_C('mapq = 0')} AS mq0, {_OWN} FROM obs GROUP BY pos)")
    + """SELECT concat_ws(chr(9), 'chr1', CAST(pos + 1 AS VARCHAR), '.', ref, '.', '.', CASE WHEN gt <> 0 OR qss_nt < 15 THEN 'QSS_ref' ELSE 'PASS' END, 'SOMATIC;QSS=' || qss || ';TQSS=1;NT=' || ['ref','het','hom'][gt + 1] || ';QSS_NT=' || qss_nt || ';TQSS_NT=1;MQ0=' || mq0, 'DP:FDP:SDP:SUBDP:AU:NU:RU', concat_ws(':', CAST(ndp AS VARCHAR), CAST(nfdp AS VARCHAR), '0', '0', "nA", "nN", "nR"), concat_ws(':', CAST(tdp AS VARCHAR), CAST(tfdp AS VARCHAR), '0', '0', "tA", "tN", "tR")) AS line FROM som JOIN c USING (pos) JOIN ref USING (pos)""",
    "somatic_indel_lines": chain(OBS, _TWO, *somatic(_INDEL_ROWS), tallies(), f"x AS (SELECT pos, max(CASE WHEN sample = 0 THEN {_TIERS} END) AS n, max(CASE WHEN sample = 1 THEN {_TIERS} END) AS t FROM tal GROUP BY pos)")
    + "SELECT concat_ws(chr(9), 'chr1', CAST(pos + 1 AS VARCHAR), '.', 'NR', 'N', '.', CASE WHEN gt <> 0 OR qss_nt < 30 THEN 'QSI_ref' ELSE 'PASS' END, 'SOMATIC;QSI=' || qss || ';NT=' || ['ref','het','hom'][gt + 1] || ';QSI_NT=' || qss_nt, 'DP:DP2:TAR:TIR:TOR', n, t) AS line FROM som JOIN x USING (pos)",
}


def _blocks(state: str, tol: int = 3) -> str:
    """Greedy blocks by recursion over sites in order: rows (pos, dp, dpf, b) with the begin of each site's block."""
    ok = lambda v: f"least(lo_{v}, s.{v}) + greatest({tol}, CAST(floor(least(lo_{v}, s.{v}) * 0.3) AS BIGINT)) >= greatest(hi_{v}, s.{v}) / 2.0"
    go = f"(s.pos = w.pos + 1 AND s.state = w.state AND {ok('dp')} AND {ok('dpf')})"
    take = lambda f, p, v: f"CASE WHEN {go} THEN {f}({p}_{v}, s.{v}) ELSE s.{v} END"
    return f"""WITH RECURSIVE {OBS}, s AS (SELECT *, row_number() OVER (ORDER BY pos) AS k FROM (SELECT pos, dp, dpf, {state} AS state FROM (SELECT pos, {_C('q >= 17')} AS dp, {_C('q < 17')} AS dpf FROM obs GROUP BY pos))),
 w AS (SELECT k, pos, state, dp, dpf, pos AS b, dp AS lo_dp, dp AS hi_dp, dpf AS lo_dpf, dpf AS hi_dpf FROM s WHERE k = 1 UNION ALL SELECT s.k, s.pos, s.state, s.dp, s.dpf, CASE WHEN {go} THEN b ELSE s.pos END, {take('least', 'lo', 'dp')}, {take('greatest', 'hi', 'dp')}, {take('least', 'lo', 'dpf')}, {take('greatest', 'hi', 'dpf')} FROM w JOIN s ON s.k = w.k + 1),
 k AS (SELECT any_value(state) AS state, b AS "begin", max(pos) + 1 AS "end", min(dp) AS min_dp, min(dpf) AS min_dpf, CAST(floor(avg(dp) + 0.5) AS BIGINT) AS mean_dp, CAST(floor(avg(dpf) + 0.5) AS BIGINT) AS mean_dpf FROM w GROUP BY b)"""


ORACLES |= {
    "site_blocks": f"{_blocks('dp >= 15')} SELECT 'all' AS contig, * FROM k",
    "block_lines": f"""{_blocks('dp < 3')}, r AS (SELECT k.*, ref FROM k JOIN (SELECT p_partkey AS pos, ['A','N','R'][CAST(p_size % 3 AS INT) + 1] AS ref FROM part) ON pos = "begin")
 SELECT concat_ws(chr(9), 'chr1', CAST("begin" + 1 AS VARCHAR), '.', ref, '.', '.', CASE WHEN state THEN 'LowDepth' ELSE 'PASS' END, (CASE WHEN "end" > "begin" + 1 THEN 'END=' || "end" || ';' ELSE '' END) || 'BLOCKAVG_min30p3a', 'GT:GQX:DP:DPF:MIN_DP', '0/0:.:' || mean_dp || ':' || mean_dpf || ':' || min_dp) AS line FROM r""",
}
_HAP = "(CASE WHEN base = 'R' THEN 'R' ELSE 'A' END)"
_E = "pow(10.0, -greatest(q, 1) / 10.0)"
_PLS = [f"sum(ln(CASE WHEN {_HAP} = 'A' THEN 1 - {_E} ELSE {_E} END))", f"sum(ln(((CASE WHEN {_HAP} = 'A' THEN 1 - {_E} ELSE {_E} END) + (CASE WHEN {_HAP} = 'R' THEN 1 - {_E} ELSE {_E} END)) / 2))", f"sum(ln(CASE WHEN {_HAP} = 'R' THEN 1 - {_E} ELSE {_E} END))"]


def _de_novo() -> str:
    theta, mutation = 0.001, 1e-8
    parent, send = [1 - 1.5 * theta, theta, theta / 2], [0.0, 0.5, 1.0]
    new, old = [], []
    for m in range(3):
        for d in range(3):
            pm, pd = send[m], send[d]
            made = [(1 - pm) * (1 - pd), pm * (1 - pd) + (1 - pm) * pd, pm * pd]
            for c in range(3):
                weight = parent[m] * parent[d] * (made[c] if made[c] > 0 else mutation)
                (old if made[c] > 0 else new).append(f"pow(10.0, -m[{m + 1}] / 10.0) * pow(10.0, -f[{d + 1}] / 10.0) * pow(10.0, -c[{c + 1}] / 10.0) * {weight!r}")
    return f"""WITH {OBS}, l AS (SELECT pos, lib, [{', '.join(_PLS)}] AS l FROM obs GROUP BY 1, 2), p AS (SELECT pos, lib, list_transform(l, lambda x: floor(-10 * (x - list_max(l)) / {LN10} + 0.5)) AS pl FROM l),
 ped AS (SELECT c.s_suppkey AS child, f.s_suppkey AS father, m.s_suppkey AS mother FROM supplier c JOIN supplier f ON f.s_suppkey = c.s_suppkey + 1 JOIN supplier m ON m.s_suppkey = c.s_suppkey + 2),
 t AS (SELECT a.pos, child AS child_lib, father AS father_lib, mother AS mother_lib, a.pl AS c, b.pl AS f, e.pl AS m FROM ped JOIN p a ON a.lib = child JOIN p b ON b.lib = father AND b.pos = a.pos JOIN p e ON e.lib = mother AND e.pos = a.pos),
 s AS (SELECT *, {' + '.join(new)} AS x, {' + '.join(old)} AS y FROM t) SELECT pos, child_lib, father_lib, mother_lib, floor(least(100.0, CASE WHEN y > 0 THEN -10 * log10(y / (x + y)) ELSE 100.0 END) * 10 + 0.5) / 10 AS dq FROM s"""


ORACLES["de_novo_scores"] = _de_novo()


def _callability() -> str:
    n = len(_FREQ)
    zeros = "[" + ", ".join(["0.0"] * n) + "]"
    valid = [i for i, x in enumerate(_FREQ) if x in (0.0, 1.0) or 0.0999 <= x <= 0.9001]
    same = "[" + ", ".join(f"n[{i + 1}] + t[{i + 1}]" for i in valid) + "]"
    other = "[" + ", ".join(f"n[{a + 1}] + t[{b + 1}] + {math.log(0.5)!r}" for a in (0, 2) for b in valid if b != a) + "]"
    low = [i for i, x in enumerate(_FREQ) if 0 < x < 0.5]
    states = ", ".join(f"greatest(tf[{i + 1}] + tr[1], tf[1] + tr[{i + 1}]) + ln(1 + exp(-abs(tf[{i + 1}] + tr[1] - tf[1] - tr[{i + 1}]))) + {math.log(0.5)!r}" for i in low)
    symmetric = ", ".join(f"tf[{i + 1}] + tr[{i + 1}]" for i in range(3, n))
    rows = "(SELECT pos, sample, is_fwd, base <> ref AS alt, q FROM obs JOIN ref USING (pos) WHERE q >= 25)"
    take = ", ".join(f"coalesce(any_value(CASE WHEN sample = {s} AND {'is_fwd' if f else 'NOT is_fwd'} THEN f END), {zeros}) AS {name}" for s, f, name in ((0, 1, "nf"), (0, 0, "nr"), (1, 1, "tf"), (1, 0, "tr")))
    return chain(OBS, REF, f"fl AS (SELECT pos, sample, is_fwd, [{', '.join(_ALT_F)}] AS f FROM {rows} GROUP BY 1, 2, 3)", f"p AS (SELECT pos, {take} FROM fl GROUP BY pos)", "b AS (SELECT *, list_transform(nf, lambda x, i: x + nr[i]) AS n, list_transform(tf, lambda x, i: x + tr[i]) AS t FROM p)", f"c AS (SELECT *, {same} AS s, {other} AS o FROM b)") + (
        f"SELECT pos, {phred(f'(1 / (1 + exp({lse(chr(115))} - {lse(chr(111))})))')} AS nqss, {tidy(f'greatest(0.0, greatest({states}) - greatest({symmetric}))')} AS snvsb FROM c"
    )


def _encoded(s: str, words: int) -> str:
    n = "1"
    for _ in range(words - 1):
        n = f"({n} + coalesce(list_min(list_filter(range(1, greatest(1, length({s}) - {n}) + 1), lambda k: NOT contains(left({s}, {n}), substr({s}, {n} + 1, k)))), 1))"
    return n


ORACLES |= {
    "somatic_callability": _callability(),
    "repeat_tracts": f"""WITH t AS (SELECT p_partkey, translate(lower(p_name || p_type || p_name), 'bcdfghjklmnpqrstvwxyzeiou ', 'aaaaaaaaaaaaaaaaaaaaabbbb') AS s, CAST(p_size % 9 AS BIGINT) AS a, CAST(p_size % 2 + 1 AS BIGINT) AS k FROM part), u AS (SELECT *, substr(s, a + 1, k) AS u, s || '#' AS w, reverse(left(s, a)) || '#' AS l, substr(s, a + 2) || '#' AS r FROM t)
 SELECT p_partkey, CAST(CASE WHEN a <= k - 1 OR substr(s, a, 1) <> substr(s, a + k, 1) THEN coalesce(list_max(list_filter(range(1, greatest(1, (length(s) - a) // k) + 1), lambda i: substr(s, a + 1, CAST(i * k AS BIGINT)) = repeat(u, CAST(i AS BIGINT)))), 1) ELSE 1 END AS INT) AS repeats, CAST({_encoded('w', 3)} AS INT) AS encoded, CAST(greatest({_encoded('l', 4)}, {_encoded('r', 4)}) AS INT) AS context FROM u""",
}
ORACLES["stream_coverage"] = """WITH e AS (SELECT user_id AS key, count(*) AS n, max(CAST(floor(epoch_us(ts) / 1000.0) AS BIGINT)) AS last FROM events GROUP BY 1) SELECT key, n, last FROM e WHERE last + 1 < (SELECT max(last) FROM e) - 3600000"""
ORACLES |= {
    "error_rate_lookup": f"""WITH m AS (SELECT p_size % 2 + 1 AS pattern, p_size % 7 + 1 AS count, min(p_size) * 1e-4 AS rate FROM part WHERE p_type <> 'PROMO' OR p_size < 20 GROUP BY 1, 2), r AS (SELECT p_partkey, p_size % 3 + 1 AS pattern, p_size % 9 + 1 AS count, p_type = 'SMALL' AS c FROM part)
 SELECT p_partkey, {tidy('coalesce(m.rate, (SELECT max(rate) FROM m WHERE pattern = 1 AND count = 1))', 6)} AS rate FROM r LEFT JOIN m ON m.pattern = (CASE WHEN c THEN 1 ELSE r.pattern END) AND m.count = (CASE WHEN c THEN 1 ELSE r.count END)""",
    "rethresholded": f"WITH {SCORED} SELECT id, array_to_string(list_filter([CASE WHEN score % 10 = 0 THEN 'LowDepth' END, CASE WHEN score < 40 THEN 'LowEVS' END], lambda x: x IS NOT NULL), ';') AS filters FROM sc",
    "sorted_variants": f"""WITH {OBS}, c AS (SELECT p_brand AS contig, CAST(row_number() OVER (ORDER BY max(p_partkey) DESC) AS INT) AS rank FROM part GROUP BY 1), v AS (SELECT p_brand AS chrom, pos, base, q, mapq, read_id * 10 + read_pos AS id FROM obs JOIN part ON pos = p_partkey),
 b AS (SELECT *, row_number() OVER (PARTITION BY chrom, pos, base ORDER BY mapq >= 20 DESC, q DESC, id) AS r FROM v) SELECT chrom, pos, base AS alt, CAST(q AS DOUBLE) AS qual, id, rank FROM b JOIN c ON chrom = contig WHERE r = 1""",
    "merged_streams": "SELECT c_mktsegment AS contig, c_custkey AS pos, 0 AS src_rank, c_acctbal AS a, CAST(NULL AS DOUBLE) AS b FROM customer UNION ALL SELECT p_brand, p_partkey, 1, NULL, p_retailprice FROM part",
    "genotype_indices": "SELECT p_partkey, least(p_size % 5, p_size % 7) + greatest(p_size % 5, p_size % 7) * (greatest(p_size % 5, p_size % 7) + 1) // 2 AS place FROM part",
    "matched_depth": """WITH t AS (SELECT l_linestatus AS contig, l_partkey AS p, CAST(floor(l_quantity) AS BIGINT) AS n, CAST(l_linenumber AS BIGINT) AS g FROM lineitem), m AS (SELECT contig, p AS b, p + n AS e FROM t UNION ALL SELECT contig, p + n + g, p + n + g + 7 FROM t), s AS (SELECT contig, pos, sum(d) AS d FROM (SELECT contig, b AS pos, 1 AS d FROM m UNION ALL SELECT contig, e, -1 FROM m) GROUP BY 1, 2 HAVING sum(d) <> 0)
 SELECT contig, pos AS "begin", nx AS "end", CAST(depth AS BIGINT) AS depth FROM (SELECT contig, pos, lead(pos) OVER w AS nx, sum(d) OVER w AS depth FROM s WINDOW w AS (PARTITION BY contig ORDER BY pos)) WHERE depth > 0""",
}
