"""DuckDB SQL that gives the rows of the registered queries."""

from __future__ import annotations

OBS = """obs AS (SELECT l_partkey AS pos, l_returnflag AS base, CAST(floor(l_quantity) AS INT) AS q, l_linestatus = 'F' AS is_fwd, CAST(l_linenumber % 2 AS INT) AS sample,
 l_suppkey AS lib, CAST(floor(l_discount * 100 + 0.5) AS INT) * 6 AS mapq, l_orderkey AS read_id, CAST(l_linenumber AS INT) AS read_pos FROM lineitem)"""
REF = "ref AS (SELECT p_partkey AS pos, ['A','N','R'][CAST(p_size % 3 AS INT) + 1] AS ref FROM part)"
REG = "reg AS (SELECT p_brand AS contig, p_type AS kind, p_partkey AS b, p_partkey + p_size AS e, p_partkey AS id FROM part)"
BOTH = f"WITH {OBS}, {REF}"
EVENTS = "ev AS (SELECT event_id, user_id AS contig, CAST(floor((epoch_us(ts) - 1704067200000000) / 1000000.0) AS BIGINT) AS pos, event_type AS class, value FROM events)"
SCORED = "sc AS (SELECT d.doc_id AS id, CAST(n_chars % 100 AS BIGINT) AS score, CASE WHEN quality = 1 THEN 'TP' ELSE 'FP' END AS tag, lang FROM documents d JOIN labels USING (doc_id))"
GT = [("A", "A"), ("A", "N"), ("N", "N"), ("A", "R"), ("N", "R"), ("R", "R")]


def tidy(x: str, places: int = 4) -> str:
    return f"floor(({x}) * {10**places} + 0.5) / {10**places}"


def phred(p: str) -> str:
    return f"CAST(floor((CASE WHEN {p} > 0 THEN -10 * greatest(-307.0, log10({p})) ELSE 3070.0 END) + 0.5) AS INT)"


def merged(rows: str, gap: int = 0) -> str:
    """rows: a relation (contig, b, e)."""
    return f"""(SELECT contig, min(b) AS "begin", max(e) AS "end", count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY contig ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS island
 FROM (SELECT *, CASE WHEN b > coalesce(max(e) OVER (PARTITION BY contig ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1000000000) + {gap} THEN 1 ELSE 0 END AS fresh FROM {rows} WHERE b < e)) GROUP BY contig, island)"""


def lhood_sums() -> str:
    e = "pow(10.0, -greatest(q, 1) / 10.0)"
    out = []
    for i, (a, b) in enumerate(GT):
        p = lambda x: f"(CASE WHEN base = '{x}' THEN 1 - {e} ELSE {e} / 2 END)"  # noqa: E731, B023
        out.append(f"sum(ln({p(a) if a == b else f'({p(a)} + {p(b)}) / 2'})) AS g{i}")
    return ", ".join(out)


def priors(poly: bool) -> list[str]:
    t = 0.001
    if poly:
        return [str(f"ln({(1 - t) / 6!r})" if a == b else f"ln({(1 + t) / 6!r})") for a, b in GT]
    rest = 1 - t - t / 2 - t * t / 2
    return [f"(CASE WHEN ref = '{a}' THEN ln({rest!r}) ELSE ln({t / 4!r}) END)" if a == b else f"(CASE WHEN ref IN ('{a}', '{b}') THEN ln({t / 2!r}) ELSE ln({t * t / 2!r}) END)" for a, b in GT]


def called(keys: str) -> str:
    """CTEs that end in `called` with keys, ref, depth, gt, gt_poly, gq, gq_poly, gqx, qual."""
    steps = [f"lh AS (SELECT {keys}, count(*) AS depth, {lhood_sums()} FROM obs WHERE q >= 17 GROUP BY {keys})", "lr AS (SELECT lh.*, ref FROM lh JOIN ref USING (pos))"]
    w = lambda poly: ", ".join(f"g{i} + {x} AS {'p' if poly else 'w'}{i}" for i, x in enumerate(priors(poly)))
    steps.append(f"lw AS (SELECT *, {w(False)}, {w(True)} FROM lr)")
    names = ", ".join(f"'{a}/{b}'" for a, b in GT)
    cols = lambda c: ", ".join(f"{c}{i}" for i in range(6))
    steps.append(f"lm AS (SELECT *, greatest({cols('w')}) AS mw, greatest({cols('p')}) AS mp FROM lw)")
    ex = lambda c: ", ".join(f"exp({c}{i} - m{c}) AS x{c}{i}" for i in range(6))
    steps.append(f"lx AS (SELECT *, {ex('w')}, {ex('p')} FROM lm)")
    total = lambda c: " + ".join(f"x{c}{i}" for i in range(6))
    steps.append(f"lt AS (SELECT *, {total('w')} AS tw, {total('p')} AS tp, list_position([{cols('w')}], mw) AS bw, list_position([{cols('p')}], mp) AS bp FROM lx)")
    rest = lambda c: "(" + " + ".join(f"(CASE WHEN b{c} = {i + 1} THEN 0 ELSE x{c}{i} END)" for i in range(6)) + f") / t{c}"
    steps.append(f"ls AS (SELECT *, [{names}][bw] AS gt, [{names}][bp] AS gt_poly, {rest('w')} AS rw, {rest('p')} AS rp, [{cols('xw')}][list_position([{names}], ref || '/' || ref)] / tw AS pref FROM lt)")
    steps.append(f"lq AS (SELECT *, {phred('rw')} AS gq, {phred('rp')} AS gq_poly, {phred('pref')} AS qual FROM ls)")
    steps.append("called AS (SELECT *, CASE WHEN bw <> bp THEN 0 ELSE least(gq, gq_poly) END AS gqx FROM lq)")
    return ", ".join(steps)


_C = "CAST(sum(CASE WHEN {} THEN 1 ELSE 0 END) AS BIGINT)".format
_STRAND = f"st AS (SELECT pos, {_C('base <> ref AND is_fwd')} AS fa, {_C('base <> ref AND NOT is_fwd')} AS ra, {_C('base = ref AND is_fwd')} AS fo, {_C('base = ref AND NOT is_fwd')} AS ro FROM obs JOIN ref USING (pos) GROUP BY pos)"


def lnp(k: str, n: str, p: str) -> str:
    return f"((CASE WHEN {k} > 0 THEN (CASE WHEN {p} > 0 THEN {k} * ln({p}) ELSE '-infinity'::DOUBLE END) ELSE 0 END) + (CASE WHEN {n} - {k} > 0 THEN (CASE WHEN {p} < 1 THEN ({n} - {k}) * ln(1 - {p}) ELSE '-infinity'::DOUBLE END) ELSE 0 END))"


def frac(a: str, b: str) -> str:
    return f"(CASE WHEN {b} <> 0 THEN ({a}) / CAST(({b}) AS DOUBLE) ELSE 0.0 END)"


def bias(fa: str, ra: str, fo: str, ro: str) -> str:
    f, r = f"({fa} + {fo})", f"({ra} + {ro})"
    both = frac(f"{fa} + {ra}", f"({f} + {r})")
    one = f"({lnp(fa, f, frac(fa, f))} + {lnp(ra, r, '0.005')})"
    two = f"({lnp(fa, f, '0.005')} + {lnp(ra, r, frac(ra, r))})"
    return f"(CASE WHEN {f} + {r} = 0 THEN 0.0 ELSE greatest({one}, {two}) - {lnp(fa, f, both)} - {lnp(ra, r, both)} END)"


_ODDS = "((fa + 0.5) * (ro + 0.5) / ((ra + 0.5) * (fo + 0.5)))"
_FREQ = [0.0, 0.5, 1.0, *[round(i * 0.05, 2) for i in range(1, 20) if i != 10]]
_E1 = "pow(10.0, -greatest(q, 1) / 10.0)"

ORACLES: dict[str, str] = {
    "pileup_counts": f"""{BOTH}, c AS (SELECT pos, {_C('q >= 17')} AS used, {_C('q < 17')} AS unused, {_C('q >= 17 AND is_fwd')} AS fwd, {_C("q >= 17 AND base = 'A'")} AS "n_A", {_C("q >= 17 AND base = 'N'")} AS "n_N", {_C("q >= 17 AND base = 'R'")} AS "n_R",
 sqrt(avg(mapq * mapq)) AS rms, avg(CASE WHEN mapq = 0 THEN 1.0 ELSE 0.0 END) AS z FROM obs GROUP BY pos)
 SELECT pos, ref, CASE WHEN ref <> 'A' AND "n_A" > 0 AND "n_A" >= (CASE WHEN ref = 'N' THEN -1 ELSE "n_N" END) AND "n_A" >= (CASE WHEN ref = 'R' THEN -1 ELSE "n_R" END) THEN 'A'
 WHEN ref <> 'N' AND "n_N" > 0 AND "n_N" >= (CASE WHEN ref = 'R' THEN -1 ELSE "n_R" END) THEN 'N' WHEN ref <> 'R' AND "n_R" > 0 THEN 'R' ELSE ref END AS alt,
 used, unused, fwd, "n_A", "n_N", "n_R", {tidy('rms')} AS mapq_rms, {tidy('z')} AS mapq0_frac, used < 3 AS low_depth FROM c JOIN ref USING (pos)""",
    "read_filter_tallies": f"WITH {OBS} SELECT CASE WHEN q < 5 THEN 'qc_fail' WHEN lib % 10 = 0 AND base = 'R' THEN 'duplicate' WHEN mapq = 0 THEN 'unmapped' WHEN read_pos > 6 THEN 'secondary' ELSE 'kept' END AS reason, count(*) AS n FROM obs GROUP BY 1",
    "mapping_levels": f"WITH {OBS} SELECT CASE WHEN q < 3 THEN 'UNMAPPED' WHEN mapq >= 20 AND read_pos <> 1 AND is_fwd THEN 'TIER1' WHEN read_pos = 1 OR NOT is_fwd OR mapq > 0 THEN 'TIER2' ELSE 'SUB' END AS level, sample, count(*) AS n FROM obs GROUP BY 1, 2",
    "adjusted_qualities": f"WITH {OBS}, m AS (SELECT q, mapq, pow(10.0, -q / 10.0) AS be, pow(10.0, -greatest(mapq, 5) / 10.0) AS me FROM obs) SELECT q, CASE WHEN mapq > 80 THEN q ELSE {phred('((1 - me) * be + 0.75 * me)')} END AS adjusted, count(*) AS n FROM m GROUP BY 1, 2",
    "region_merge": f"WITH {REG} SELECT * FROM {merged('reg')}",
    "call_region_groups": f"WITH {REG} SELECT * FROM {merged('reg', 20)}",
    "region_coverage": f"""WITH {REG}, s AS (SELECT contig, pos, sum(d) AS d FROM (SELECT contig, b AS pos, 1 AS d FROM reg UNION ALL SELECT contig, e, -1 FROM reg) GROUP BY 1, 2 HAVING sum(d) <> 0)
 SELECT contig, pos AS "begin", nx AS "end", CAST(depth AS BIGINT) AS depth FROM (SELECT contig, pos, lead(pos) OVER w AS nx, sum(d) OVER w AS depth FROM s WINDOW w AS (PARTITION BY contig ORDER BY pos)) WHERE depth > 0""",
    "positions_in_regions": f"WITH {REF}, {REG} SELECT pos, ref FROM ref WHERE EXISTS (SELECT 1 FROM reg WHERE kind = 'PROMO' AND pos >= b AND pos < e)",
    "positions_outside_regions": f"WITH {REF}, {REG} SELECT pos, ref FROM ref WHERE NOT EXISTS (SELECT 1 FROM reg WHERE kind = 'ECONOMY' AND e - b >= 30 AND pos >= b AND pos < e)",
    "region_overlap": f"WITH {REG} SELECT x.contig, x.id, y.id AS id_b, least(x.e, y.e) - greatest(x.b, y.b) AS shared FROM reg x JOIN reg y ON x.contig = y.contig AND x.id < y.id AND x.b < y.e AND y.b < x.e",
    "region_contained": f"WITH {REG}, m AS (SELECT * FROM {merged("(SELECT * FROM reg WHERE kind >= 'M')")}) SELECT contig, id FROM reg WHERE kind < 'M' AND EXISTS (SELECT 1 FROM m WHERE m.contig = reg.contig AND reg.b >= m.\"begin\" AND reg.e <= m.\"end\")",
    "region_payload": f"WITH {REG}, r AS (SELECT *, least(e, lead(b) OVER (PARTITION BY contig, kind ORDER BY b)) AS e2 FROM reg) SELECT p.contig, p.kind, p.b + 25 AS pos, CAST(coalesce((r.e - r.b) % 2, 2) AS INT) AS ploidy FROM reg p LEFT JOIN r ON p.contig = r.contig AND p.kind = r.kind AND p.b + 25 >= r.b AND p.b + 25 < r.e2",
    "region_conflicts": f"WITH {REG} SELECT x.contig, count(*) AS pairs FROM reg x JOIN reg y ON x.contig = y.contig AND x.id < y.id AND x.b < y.e AND y.b < x.e AND x.id % 3 <> y.id % 3 GROUP BY 1",
    "callable_blocks": f"""WITH {OBS}, c AS (SELECT pos FROM obs WHERE q >= 17 GROUP BY pos HAVING count(*) >= 18) SELECT 'all' AS contig, min(pos) AS "begin", max(pos) + 1 AS "end" FROM (SELECT pos, pos - row_number() OVER (ORDER BY pos) AS g FROM c) GROUP BY g""",
    "gap_positions": f"WITH {OBS}, c AS (SELECT pos FROM obs WHERE q >= 17 GROUP BY pos HAVING count(*) >= 18) SELECT 'all' AS contig, CAST(x AS BIGINT) AS pos FROM (SELECT unnest(range((SELECT min(pos) FROM c), (SELECT max(pos) FROM c))) AS x) WHERE x NOT IN (SELECT pos FROM c)",
    "genome_segments": """WITH c AS (SELECT p_brand AS contig, CAST(sum(p_size) AS BIGINT) AS length FROM part GROUP BY 1), n AS (SELECT *, CAST(ceil(length / 100.0) AS BIGINT) AS k FROM c), s AS (SELECT *, unnest(range(k)) AS number FROM n)
 SELECT contig, number, number * (length // k) + least(number, length % k) AS "begin", number * (length // k) + least(number, length % k) + length // k + (CASE WHEN number < length % k THEN 1 ELSE 0 END) AS "end" FROM s""",
    "median_depth": f"WITH {OBS} SELECT sample, median(depth) AS median FROM (SELECT sample, pos, {_C('q >= 40')} AS depth FROM obs GROUP BY 1, 2) WHERE depth > 0 GROUP BY 1",
    "region_depth": f"WITH {OBS}, {REG}, d AS (SELECT pos, count(*) AS depth FROM obs GROUP BY 1) SELECT id, median(depth) AS median, count(*) AS covered FROM reg JOIN d ON pos >= b AND pos < e GROUP BY id",
    "rank_sum": f"""{BOTH}, b AS (SELECT pos, q, {_C('base = ref')} AS c1, {_C('base <> ref')} AS c2 FROM obs JOIN ref USING (pos) GROUP BY 1, 2),
 r AS (SELECT *, coalesce(sum(c1 + c2) OVER (PARTITION BY pos ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (c1 + c2 + 1) / 2.0 AS rk FROM b),
 s AS (SELECT pos, CAST(sum(c1) AS BIGINT) AS n1, CAST(sum(c2) AS BIGINT) AS n2, CAST(sum(rk * c1) AS DOUBLE) AS w1, CAST(sum(rk * c2) AS DOUBLE) AS w2, CAST(sum(q * c2) AS DOUBLE) AS s2 FROM r GROUP BY pos),
 g AS (SELECT *, CASE WHEN w1 > w2 THEN n2 ELSE n1 END AS na, CASE WHEN w1 > w2 THEN n1 ELSE n2 END AS nb, least(w1, w2) AS w FROM s), h AS (SELECT *, na * (na + nb + 1) / 2.0 AS mean FROM g)
 SELECT pos, n1, n2, {tidy('CASE WHEN sqrt(nb * mean / 6.0) < 0.0001 THEN 0.0 ELSE (w - mean) / sqrt(nb * mean / 6.0) END')} AS z, {tidy('CASE WHEN n2 > 0 THEN s2 / n2 ELSE 0.0 END')} AS mean2 FROM h""",
    "value_statistics": f"WITH {OBS} SELECT sample, base, count(*) AS n, min(q) AS lo, max(q) AS hi, {tidy('avg(q)')} AS mean, {tidy('var_samp(q)')} AS variance FROM obs GROUP BY 1, 2",
    "read_position_deviation": f"WITH {OBS}, m AS (SELECT pos, median(q) AS med, count(*) AS n FROM obs GROUP BY 1 HAVING count(*) >= 3) SELECT pos, any_value(n) AS n, CAST(any_value(med) AS DOUBLE) AS median, CAST(median(abs(q - med)) AS DOUBLE) AS mad FROM obs JOIN m USING (pos) GROUP BY pos",
    "strand_tables": f"""{BOTH}, {_STRAND} SELECT pos, fa, ra, fo, ro, {tidy(f'ln({_ODDS})')} AS log_odds, {tidy(f'ln({_ODDS} + 1 / {_ODDS})')} AS strand_odds, {tidy(bias('fa', 'ra', 'fo', 'ro'))} AS bias,
 {tidy('CASE WHEN (fa+ra)*(fo+ro)*(fa+fo)*(ra+ro) > 0 THEN (fa+ra+fo+ro) * pow(CAST(fa*ro - ra*fo AS DOUBLE), 2) / ((fa+ra)*(fo+ro)*(fa+fo)*(ra+ro)) ELSE 0.0 END')} AS chi2 FROM st""",
    "diploid_genotypes": f"{BOTH}, {called('pos')} SELECT pos, ref, depth, gt, gt_poly, gq, gq_poly, gqx, qual FROM called",
    "genotype_likelihoods": f"WITH {OBS} SELECT pos, sample, depth, {', '.join(tidy(f'g{i}') + f' AS g{i}' for i in range(6))} FROM (SELECT pos, sample, count(*) AS depth, {lhood_sums()} FROM obs WHERE q >= 17 GROUP BY 1, 2)",
    "continuous_alleles": f"""{BOTH}, b AS (SELECT pos, base, count(*) AS n, {_C('is_fwd')} AS fwd FROM obs GROUP BY 1, 2), t AS (SELECT pos, CAST(sum(n) AS BIGINT) AS depth, CAST(sum(fwd) AS BIGINT) AS df FROM b GROUP BY 1),
 r AS (SELECT pos, base AS alt, n, depth, fwd AS fa, n - fwd AS ra, df - fwd AS fo, depth - df - (n - fwd) AS ro, depth * 0.01 AS lam FROM b JOIN t USING (pos) JOIN ref USING (pos) WHERE base <> ref AND n > 0.01 * depth),
 p AS (SELECT *, -lam + n * ln(lam) - lgamma(n + 1) + ln(list_sum(list_transform(range(0, 401), lambda i: exp(i * ln(lam) + lgamma(n + 1) - lgamma(n + i + 1))))) AS lp FROM r)
 SELECT pos, alt, n, depth, {tidy('n / CAST(depth AS DOUBLE)')} AS vf, CAST(least(100, floor(-10 * greatest(-307.0, lp / ln(10.0)) + 0.5)) AS INT) AS q, {tidy(bias('fa', 'ra', 'fo', 'ro'))} AS bias FROM p""",
    "case_control_counts": f"{BOTH} SELECT pos, {_C('sample = 0 AND base <> ref')} AS normal_alt, {_C('sample = 0 AND base = ref')} AS normal_ref, {_C('sample = 1 AND base <> ref')} AS tumor_alt, {_C('sample = 1 AND base = ref')} AS tumor_ref FROM obs JOIN ref USING (pos) GROUP BY pos",
    "frequency_grid": f"{BOTH} SELECT pos, sample, "
    + ", ".join(tidy(f"sum(ln(CASE WHEN base <> ref THEN {_FREQ[i]} * (1 - {_E1}) + (1 - {_FREQ[i]}) * {_E1} ELSE (1 - {_FREQ[i]}) * (1 - {_E1}) + {_FREQ[i]} * {_E1} END))") + f" AS f{i}" for i in (1, 3, 12, 20))
    + " FROM obs JOIN ref USING (pos) WHERE q >= 25 GROUP BY 1, 2",
    "sliding_region_stats": f"""WITH {OBS}, s AS (SELECT pos, {_C('q >= 17')} AS used, {_C('q < 17')} AS unused, {_C('mapq = 0')} AS spanning, {_C('mapq < 20')} AS submapped FROM obs GROUP BY 1)
 SELECT pos, {tidy('avg(used) OVER w')} AS used_avg, {tidy('avg(unused) OVER w')} AS unused_avg, {tidy('avg(spanning) OVER w')} AS spanning_avg, {tidy('avg(submapped) OVER w')} AS submapped_avg FROM s WINDOW w AS (ORDER BY pos RANGE BETWEEN 49 PRECEDING AND 50 FOLLOWING)""",
    "recent_flags": f"WITH {OBS} SELECT CAST(r AS BIGINT) AS recent, count(*) AS n FROM (SELECT sum(CASE WHEN q >= 30 THEN 1 ELSE 0 END) OVER (PARTITION BY read_id ORDER BY read_pos, pos, q ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS r FROM obs) GROUP BY 1",
    "mismatch_density": f"{BOTH} SELECT CAST(near AS BIGINT) AS near, near > 2 AS dense, count(*) AS n FROM (SELECT sum(CASE WHEN base <> ref THEN 1 ELSE 0 END) OVER (PARTITION BY read_id ORDER BY read_pos RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM obs JOIN ref USING (pos)) GROUP BY 1, 2",
    "active_regions": f"""WITH {EVENTS}, p AS (SELECT DISTINCT contig, pos FROM ev WHERE value > 50), f AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY contig ORDER BY pos) <= 3600 THEN 0 ELSE 1 END AS fresh FROM p),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY contig ORDER BY pos ROWS UNBOUNDED PRECEDING) AS k FROM f) SELECT contig, min(pos) AS "begin", max(pos) + 1 AS "end", count(*) AS n FROM s GROUP BY contig, k HAVING count(*) >= 2""",
    "overlap_clusters": f"""WITH {REG}, f AS (SELECT *, CASE WHEN b <= max(e) OVER (PARTITION BY contig ORDER BY b, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM reg),
 k AS (SELECT *, sum(fresh) OVER (PARTITION BY contig ORDER BY b, e, id ROWS UNBOUNDED PRECEDING) AS cluster FROM f),
 t AS (SELECT contig, id, CAST(cluster AS BIGINT) AS cluster, count(*) OVER w AS size, CAST(sum(CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS indels FROM k WINDOW w AS (PARTITION BY contig, cluster)) SELECT *, indels > 1 AS conflict FROM t""",
    "dependent_error": f"WITH {OBS}, w AS (SELECT pos, greatest(0.25, pow(0.6, row_number() OVER (PARTITION BY pos, is_fwd, base ORDER BY q DESC, read_id, read_pos) - 1)) AS weight FROM obs) SELECT pos, {tidy('sum(weight)')} AS weight, {_C('weight < 0.5')} AS discounted FROM w GROUP BY pos",
    "allele_ranks": f"WITH {OBS}, b AS (SELECT sample, pos, base, CAST(sum(q) AS BIGINT) AS support FROM obs GROUP BY 1, 2, 3) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY sample, pos ORDER BY support DESC, base) AS INT) AS rank FROM b) WHERE rank <= 2",
    "allele_votes": f"""WITH {OBS}, b AS (SELECT sample, pos, base, count(*) AS n FROM obs GROUP BY 1, 2, 3), t AS (SELECT *, sum(n) OVER (PARTITION BY sample, pos) AS t FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY sample, pos ORDER BY n DESC, base) AS k FROM t WHERE n >= greatest(1.0, 0.1 * t))
 SELECT pos, base, CAST(sum(3 - k) AS BIGINT) AS votes FROM r WHERE k <= 2 GROUP BY 1, 2""",
    "phase_sets": f"""WITH {OBS}, o AS (SELECT read_id, pos, max(q) AS q FROM obs GROUP BY 1, 2), v AS (SELECT read_id, pos, q % 2 = 0 AS is_het, q % 3 AS h0 FROM o),
 s AS (SELECT *, sum(CASE WHEN is_het THEN 1 ELSE 0 END) OVER w AS n, min(CASE WHEN is_het THEN pos END) OVER w AS f, arg_min(h0, CASE WHEN is_het THEN pos END) OVER w AS hf FROM v WINDOW w AS (PARTITION BY read_id))
 SELECT read_id, pos, is_het, CASE WHEN is_het AND n >= 2 THEN f + 1 END AS ps, CASE WHEN is_het AND n >= 2 THEN h0 <> hf END AS flip FROM s""",
    "germline_filters": f"""{BOTH}, {called('pos, sample')}, u AS (SELECT pos, sample, {_C('q < 17')} AS unused FROM obs GROUP BY 1, 2),
 f AS (SELECT pos, (CASE WHEN gqx < 15 THEN 1 ELSE 0 END) + (CASE WHEN depth + unused > 24 THEN 2 ELSE 0 END) + (CASE WHEN unused > 0.4 * (depth + unused) THEN 4 ELSE 0 END) + (CASE WHEN depth < 3 THEN 16 ELSE 0 END) AS bits, gt <> ref || '/' || ref AS var FROM called JOIN u USING (pos, sample)),
 l AS (SELECT pos, bit_and(bits) | (CASE WHEN bool_or(var AND bits = 0) THEN 0 ELSE 128 END) AS m FROM f GROUP BY pos)
 SELECT pos, CAST(m AS INT) AS locus_filters, CASE WHEN m = 0 THEN 'PASS' ELSE array_to_string(list_filter([CASE WHEN m & 1 <> 0 THEN 'LowGQX' END, CASE WHEN m & 2 <> 0 THEN 'HighDepth' END, CASE WHEN m & 4 <> 0 THEN 'HighDPFRatio' END, CASE WHEN m & 16 <> 0 THEN 'LowDepth' END, CASE WHEN m & 128 <> 0 THEN 'NoPassedVariantGTs' END], lambda x: x IS NOT NULL), ';') END AS filter FROM l""",
    "noise_panel": f"{BOTH}, t AS (SELECT pos, count(*) AS dp, {_C('base <> ref')} AS alt FROM obs JOIN ref USING (pos) WHERE q >= 45 GROUP BY pos) SELECT pos, dp, dp - alt AS ref_depth, alt AS alt_depth FROM t WHERE dp >= 3 AND alt > 0 AND alt <= 0.7 * dp",
    "basecall_patterns": f"""{BOTH}, s AS (SELECT pos, {_C('base = ref AND is_fwd')} AS r0, {_C('base <> ref AND is_fwd')} AS a0, {_C('base = ref AND NOT is_fwd')} AS r1, {_C('base <> ref AND NOT is_fwd')} AS a1 FROM obs JOIN ref USING (pos) WHERE q >= 25 GROUP BY pos),
 l AS (SELECT *, greatest(0, CAST(floor(log2(greatest(r0, 1))) AS INT) - 2) AS s0, greatest(0, CAST(floor(log2(greatest(r1, 1))) AS INT) - 2) AS s1 FROM s),
 c AS (SELECT CASE WHEN s0 = 0 THEN r0 ELSE (r0 // CAST(pow(2, s0) AS BIGINT)) * CAST(pow(2, s0) AS BIGINT) + CAST(floor(pow(2, s0) * 2 / 3) AS BIGINT) END AS c0, a0, CASE WHEN s1 = 0 THEN r1 ELSE (r1 // CAST(pow(2, s1) AS BIGINT)) * CAST(pow(2, s1) AS BIGINT) + CAST(floor(pow(2, s1) * 2 / 3) AS BIGINT) END AS c1, a1 FROM l)
 SELECT CASE WHEN c0 < c1 OR (c0 = c1 AND a0 <= a1) THEN c0 ELSE c1 END AS ref_a, CASE WHEN c0 < c1 OR (c0 = c1 AND a0 <= a1) THEN a0 ELSE a1 END AS alt_a, CASE WHEN c0 < c1 OR (c0 = c1 AND a0 <= a1) THEN c1 ELSE c0 END AS ref_b, CASE WHEN c0 < c1 OR (c0 = c1 AND a0 <= a1) THEN a1 ELSE a0 END AS alt_b, count(*) AS sites FROM c GROUP BY 1, 2, 3, 4""",
    "merged_tallies": f"WITH {OBS} SELECT base, q, count(*) AS n FROM obs GROUP BY 1, 2",
    "skip_tallies": f"WITH {OBS} SELECT CASE WHEN depth = 0 THEN 'empty' WHEN depth < 8 THEN 'low' WHEN depth > 18 THEN 'deep' ELSE 'counted' END AS reason, count(*) AS n FROM (SELECT pos, {_C('q >= 30')} AS depth FROM obs GROUP BY pos) GROUP BY 1",
    "precision_recall": f"""WITH {SCORED}, b AS (SELECT score, {_C("tag = 'TP'")} AS t, {_C("tag = 'FP'")} AS f FROM sc GROUP BY 1), c AS (SELECT score, CAST(sum(t) OVER w AS BIGINT) AS tp, CAST(sum(f) OVER w AS BIGINT) AS fp, CAST(sum(t) OVER () AS BIGINT) AS all_t, CAST(sum(f) OVER () AS BIGINT) AS all_f FROM b WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
 SELECT score, tp, fp, all_t - tp AS fn, all_t + all_f - tp - fp AS filtered, {tidy('tp / CAST(tp + fp AS DOUBLE)')} AS precision, {tidy('CASE WHEN all_t > 0 THEN tp / CAST(all_t AS DOUBLE) ELSE 0.0 END')} AS recall FROM c""",
    "calibration_bins": f"""WITH {SCORED} SELECT lang, CAST(bin AS INT) AS bin, CAST(median(score) AS DOUBLE) AS median_score, {tidy("avg(CASE WHEN tag = 'TP' THEN 1.0 ELSE 0.0 END)")} AS precision, count(*) AS n FROM (SELECT *, ntile(5) OVER (PARTITION BY lang ORDER BY score, id) AS bin FROM sc) GROUP BY 1, 2""",
    "confusion_table": f"""WITH {SCORED} SELECT tag, {_C('score >= 50')} AS "as_TP", {_C('score < 50')} AS "as_FP" FROM sc GROUP BY tag""",
    "truth_match": f"""{BOTH}, o AS (SELECT DISTINCT sample, pos, base FROM obs JOIN ref USING (pos) WHERE base <> ref AND q >= 40), m AS (SELECT pos, base, bool_or(sample = 1) AS q, bool_or(sample = 0) AS t FROM o GROUP BY 1, 2) SELECT CASE WHEN q AND t THEN 'TP' WHEN q THEN 'FP' ELSE 'FN' END AS tag, count(*) AS n FROM m GROUP BY 1""",
    "labelled_regions": f"""WITH {REF}, {REG} SELECT pos, CASE WHEN pos % 10 = 0 THEN 'TP' WHEN EXISTS (SELECT 1 FROM reg WHERE kind = 'PROMO' AND pos >= b AND pos < least(e, b + 9)) THEN 'FP' WHEN EXISTS (SELECT 1 FROM reg WHERE kind = 'ECONOMY' AND pos >= b AND pos < least(e, b + 9)) THEN 'AMBI' ELSE 'UNK' END AS tag FROM ref""",
    "balanced_sample": f"WITH {SCORED}, c AS (SELECT tag, count(*) AS n FROM sc GROUP BY 1) SELECT tag, (SELECT min(n) FROM c) AS n FROM c",
    "haplotype_counts": f"WITH {OBS}, h AS (SELECT read_id, string_agg(base, '' ORDER BY read_pos, base) AS hap FROM obs GROUP BY 1), b AS (SELECT hap, count(*) AS n FROM h GROUP BY 1) SELECT hap, n, CAST(dense_rank() OVER (ORDER BY n DESC) AS INT) AS rank FROM b",
    "kmer_counts": "WITH w AS (SELECT regexp_replace(upper(p_name), '[^A-Z]', '', 'g') AS s FROM part), k AS (SELECT s, unnest(range(1, CAST(length(s) AS BIGINT) - 2)) AS i FROM w WHERE length(s) >= 4) SELECT substr(s, i, 4) AS kmer, count(*) AS n FROM k GROUP BY 1",
    "run_lengths": f"""WITH {REF}, g AS (SELECT ref AS allele, pos, pos - row_number() OVER (PARTITION BY ref ORDER BY pos) AS k FROM ref) SELECT allele, min(pos) AS "begin", max(pos) + 1 AS "end", max(pos) + 1 - min(pos) AS length FROM g GROUP BY allele, k""",
    "cigar_lengths": """SELECT l_orderkey, l_linenumber, CAST(CAST(floor(l_quantity) AS INT) + 5 + (CASE WHEN l_returnflag <> 'R' THEN l_linenumber ELSE 0 END) AS INT) AS read_len, CAST(CAST(floor(l_quantity) AS INT) + 5 + (CASE WHEN l_returnflag = 'R' THEN l_linenumber ELSE 0 END) AS INT) AS ref_len,
 CAST(CASE WHEN l_returnflag IN ('A', 'R') THEN 1 ELSE 0 END AS INT) AS indels, true AS same FROM lineitem""",
    "sequence_functions": """WITH t AS (SELECT p_partkey, translate(regexp_replace(upper(p_type), '[^A-Z]', '', 'g'), 'BDEFHIJKLMNOPQRSUVWXYZ', 'ACGTACGTACGTACGTACGTAC') AS s FROM part), u AS (SELECT *, list_filter(range(1, CAST(length(s) AS BIGINT) + 1), lambda k: length(s) % k = 0 AND repeat(substr(s, 1, k), CAST(length(s) // k AS BIGINT)) = s)[1] AS k FROM t)
 SELECT p_partkey, s, translate(reverse(s), 'ACGT', 'TGCA') AS rc, CASE WHEN s <> '' THEN substr(s, 1, k) END AS unit, CASE WHEN s <> '' THEN CAST(2 * length(s) // k AS INT) END AS times FROM u""",
    "trimmed_alleles": """WITH t AS (SELECT p_partkey, p_name AS r, left(p_name, CAST(p_size % 5 + 1 AS INT)) || substr(p_name, 5) AS a FROM part), s AS (SELECT *, list_max(list_filter(range(0, CAST(least(length(r), length(a)) AS BIGINT) + 1), lambda k: right(r, CAST(k AS BIGINT)) = right(a, CAST(k AS BIGINT)))) AS sf FROM t),
 c AS (SELECT p_partkey, left(r, CAST(length(r) - sf AS BIGINT)) AS r, left(a, CAST(length(a) - sf AS BIGINT)) AS a FROM s), p AS (SELECT *, list_max(list_filter(range(0, CAST(least(length(r), length(a)) AS BIGINT) + 1), lambda k: left(r, CAST(k AS BIGINT)) = left(a, CAST(k AS BIGINT)))) AS pf FROM c)
 SELECT p_partkey, p_partkey + pf AS pos, CAST(length(r) - pf AS INT) AS del_len, substr(a, CAST(pf + 1 AS BIGINT)) AS ins_seq FROM p""",
    "record_fields": """SELECT event_id, CAST(user_id AS VARCHAR) AS u, CAST(NULL AS VARCHAR) AS x, CAST(event_id AS VARCHAR) AS dp, 'c' || CAST(user_id % 7 AS VARCHAR) AS contig, event_id AS "begin", event_id + 10 AS "end" FROM events""",
    "compressed_counts": "WITH n AS (SELECT CAST(floor(o_totalprice) AS BIGINT) % 5000 AS n FROM orders), s AS (SELECT n, greatest(0, CAST(floor(log2(greatest(n, 1))) AS INT) - 2) AS k FROM n) SELECT CASE WHEN k = 0 THEN n ELSE (n // CAST(pow(2, k) AS BIGINT)) * CAST(pow(2, k) AS BIGINT) + CAST(floor(pow(2, k) * 2 / 3) AS BIGINT) END AS value, count(*) AS rows FROM s GROUP BY 1",
    "contig_set_difference": f"WITH {REG}, u AS (SELECT DISTINCT contig FROM reg WHERE kind = 'PROMO' AND e - b = 50) SELECT DISTINCT contig, CASE WHEN contig IN (SELECT contig FROM u) THEN 'kept' ELSE 'skipped' END AS state FROM reg",
    "group_read_sets": f"WITH {OBS}, o AS (SELECT read_id, bool_or(base = 'A') AS a, bool_or(base = 'R') AS r FROM obs GROUP BY 1) SELECT CASE WHEN a AND r THEN 'both' WHEN a OR r THEN 'one' ELSE 'none' END AS kind, count(*) AS reads FROM o GROUP BY 1",
}
ORACLES["record_lines"] = f"""SELECT concat_ws(chr(9), 'chr1', CAST(pos + 1 AS VARCHAR), '.', ref, alt, '.', CASE WHEN low_depth THEN 'LowDepth' ELSE 'PASS' END, 'DP=' || CAST(used + unused AS VARCHAR), 'DP:DPF:AD', concat_ws(':', CAST(used AS VARCHAR), CAST(unused AS VARCHAR), concat_ws(',', CAST("n_A" AS VARCHAR), CAST("n_N" AS VARCHAR), CAST("n_R" AS VARCHAR)))) AS line FROM ({ORACLES['pileup_counts']})"""
_LN = "(CASE WHEN base = '{a}' THEN ln(1 - pow(10.0, -greatest(q, 1) / 10.0)) ELSE ln(pow(10.0, -greatest(q, 1) / 10.0) / 2) END)"
_MIX = [f"sum(ln((1 - 1e-4) * (exp({_LN.format(a=a)}) + exp({_LN.format(a=b)})) / 2 + exp(ln(1e-4) + 100 * ln(0.25))))" for a, b in GT]
ORACLES |= {
    "site_indel_constraints": f"""WITH {OBS}, s AS (SELECT pos, max(q) AS qual, min(q) AS gqx FROM obs GROUP BY 1), i AS (SELECT p_partkey AS b, p_partkey + p_size AS e, p_size % 40 AS iq, p_size % 7 AS ig, p_size % 2 = 0 AS f FROM part),
 m AS (SELECT pos, min(iq) AS iq, min(ig) AS ig, bool_or(f) AS f FROM s JOIN i ON pos >= b AND pos < e GROUP BY pos) SELECT pos, least(qual, coalesce(iq, qual)) AS qual, least(gqx, coalesce(ig, gqx)) AS gqx, coalesce(f, false) AS conflict FROM s LEFT JOIN m USING (pos)""",
    "indel_signals": f"{BOTH}, c AS (SELECT ref, q % 9 - 4 AS c FROM obs JOIN ref USING (pos)) SELECT ref, CASE WHEN c = 0 THEN 'REF' WHEN c > 0 THEN 'I' || least(c, 3) ELSE 'D' || least(-c, 3) END AS signal, count(*) AS n FROM c GROUP BY 1, 2",
    "confident_support": f"""WITH {OBS}, r AS (SELECT DISTINCT pos, read_id, read_pos, q FROM obs), b AS (SELECT pos, read_id, read_pos, q, base, is_fwd, count(*) OVER (PARTITION BY pos, read_id, read_pos, q) AS k FROM obs)
 SELECT pos, CASE WHEN q <= 3 AND (1 - pow(10.0, -greatest(q, 1) / 10.0)) < 0.51 THEN 'none' ELSE base END AS allele, count(*) AS reads, CAST(sum(CASE WHEN is_fwd THEN 1 ELSE 0 END) AS BIGINT) AS fwd FROM b GROUP BY 1, 2""",
    "allele_group_likelihoods": f"WITH {OBS} SELECT pos, {', '.join(tidy(x) + f' AS g{i}' for i, x in enumerate(_MIX))} FROM obs GROUP BY pos",
    "homopolymer_context": f"WITH {REF}, g AS (SELECT pos, ref, pos - row_number() OVER (PARTITION BY ref ORDER BY pos) AS k FROM ref) SELECT pos, ref, count(*) OVER (PARTITION BY ref, k) AS length FROM g",
    "left_shifts": """WITH s AS (SELECT p_partkey, translate(lower(p_name || p_type), 'bcdfghjklmnpqrstvwxyz ', 'aaa') AS s FROM part), e AS (SELECT *, substr(s, 4, 1) = substr(s, 6, 1) AS a, substr(s, 3, 1) = substr(s, 5, 1) AS b, substr(s, 2, 1) = substr(s, 4, 1) AS c, substr(s, 1, 1) = substr(s, 3, 1) AS d FROM s WHERE length(s) >= 6)
 SELECT p_partkey, CASE WHEN NOT a THEN 0 WHEN NOT b THEN 1 WHEN NOT c THEN 2 WHEN NOT d THEN 3 ELSE 4 END AS shift FROM e""",
    "depth_limited_reads": f"WITH {OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY mapq DESC, read_id, read_pos, q) AS k FROM obs) SELECT pos, count(*) AS n, min(mapq) AS lowest FROM r WHERE k <= 10 GROUP BY pos",
    "mean_depth": f"WITH {REG}, m AS (SELECT contig, sum(\"end\" - \"begin\") AS span FROM {merged('reg')} GROUP BY 1), s AS (SELECT contig, sum(e - b) AS bases FROM reg GROUP BY 1) SELECT contig, CAST(bases AS BIGINT) AS bases, CAST(span AS BIGINT) AS span, {tidy('bases / CAST(span AS DOUBLE)')} AS depth FROM s JOIN m USING (contig)",
    "compressible_sites": f"{BOTH}, c AS (SELECT pos, {_C('q >= 17')} AS used, {_C('q >= 17 AND base = ref')} AS r FROM obs JOIN ref USING (pos) GROUP BY pos) SELECT pos, used FROM c WHERE used > 0 AND r / CAST(used AS DOUBLE) + 0.6 > 1 AND NOT EXISTS (SELECT 1 FROM part WHERE p_type = 'ECONOMY' AND pos >= p_partkey AND pos < p_partkey + 3)",
    "allele_fractions": f"{BOTH} SELECT pos, sample, {tidy('avg(CASE WHEN base <> ref THEN 1.0 ELSE 0.0 END)')} AS vaf FROM obs JOIN ref USING (pos) WHERE q >= 20 GROUP BY 1, 2",
    "panel_noise": f"{BOTH}, t AS (SELECT pos, lib, {_C('base <> ref')} AS alt FROM obs JOIN ref USING (pos) GROUP BY 1, 2) SELECT pos, CAST(count(*) AS INT) AS total, CAST(sum(CASE WHEN alt > 0 THEN 1 ELSE 0 END) AS INT) AS noise, CAST(sum(CASE WHEN alt > 1 THEN 1 ELSE 0 END) AS INT) AS noise2 FROM t GROUP BY pos",
    "small_indels": "WITH t AS (SELECT p_partkey, left(p_name, CAST(p_size % 7 + 1 AS INT)) AS ref, CASE WHEN p_size % 11 = 0 THEN '<DEL>' ELSE left(p_type, CAST(p_size % 5 + 1 AS INT)) END AS alt FROM part) SELECT * FROM t WHERE alt <> '<DEL>' AND length(ref) <> length(alt) AND length(ref) <= 6 AND length(alt) <= 6",
    "training_labels": "SELECT d.doc_id AS id, CASE WHEN toxic = 1 THEN 'UNK' WHEN quality = 1 THEN 'TP' ELSE 'FP' END AS label FROM documents d JOIN labels USING (doc_id) WHERE (n_chars % 100) % 10 <> 0",
}
ORACLES |= {
    "stream_window_stats": f"""WITH e AS (SELECT CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) AS s, event_type, value FROM events), w AS (SELECT (s // 10800) * 10800 - k * 10800 AS start, event_type, value FROM e, (SELECT unnest([0, 1]) AS k))
 SELECT start, event_type, count(*) AS n, {tidy('avg(value)')} AS mean FROM w GROUP BY 1, 2""",
    "stream_clusters": """WITH f AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 7200000000 THEN 0 ELSE 1 END AS fresh FROM events),
 k AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM f) SELECT user_id, min(t) AS first, count(*) AS n FROM k GROUP BY user_id, k""",
    "rna_het_grid": f"{BOTH}, l AS (SELECT pos, "
    + ", ".join(f"sum(ln(CASE WHEN base <> ref THEN {x} * (1 - {_E1}) + (1 - {x}) * {_E1} ELSE (1 - {x}) * (1 - {_E1}) + {x} * {_E1} END)) AS x{i}" for i, x in enumerate((0.3, 0.4, 0.5, 0.6, 0.7)))
    + f" FROM obs JOIN ref USING (pos) WHERE q >= 20 GROUP BY pos), m AS (SELECT *, greatest(x0, x1, x2, x3, x4) AS m FROM l) SELECT pos, {tidy('m + ln(exp(x0 - m) + exp(x1 - m) + exp(x2 - m) + exp(x3 - m) + exp(x4 - m)) - ln(5.0)')} AS het FROM m",
    "sample_name_map": f"WITH {OBS}, l AS (SELECT lib, count(*) AS reads FROM obs GROUP BY 1), n AS (SELECT s_suppkey AS lib, count(*) AS k, min(s_name) AS name FROM supplier GROUP BY 1) SELECT lib, reads, CASE WHEN coalesce(k, 0) = 1 THEN name END AS name, CASE WHEN k IS NULL THEN 'missing' WHEN k > 1 THEN 'double' ELSE 'ok' END AS state FROM l LEFT JOIN n USING (lib)",
    "strand_support_features": f"""{BOTH}, f AS (SELECT pos, count(*) AS depth, {_C('base <> ref')} AS alt, {_C('base <> ref AND is_fwd')} AS alt_fwd, coalesce(avg(CASE WHEN base <> ref THEN q END), 0) - coalesce(avg(CASE WHEN base = ref THEN q END), 0) AS sh, coalesce(sqrt(avg(CASE WHEN base <> ref THEN mapq * mapq END)), 0) AS mq FROM obs JOIN ref USING (pos) GROUP BY pos)
 SELECT pos, depth, alt, alt_fwd, {tidy('sh')} AS q_shift, {tidy('mq')} AS alt_mapq, {tidy('greatest(0.0, least(1.0, (alt / CAST(depth AS DOUBLE) - 0.1) / 0.8))')} AS scaled FROM f""",
}
_HAP = [0, 2, 5]
_HP = ["(CASE WHEN ref = '{}' THEN ln({}) ELSE ln({}) END)".format(a, 1 - 0.001, 0.0005) for a in ("A", "N", "R")]
ORACLES |= {
    "haploid_genotypes": f"""{BOTH}, l AS (SELECT pos, {lhood_sums()} FROM obs WHERE q >= 17 GROUP BY pos), w AS (SELECT pos, ref, {', '.join(f'g{i} + {p} AS w{k}' for k, (i, p) in enumerate(zip(_HAP, _HP)))} FROM l JOIN ref USING (pos)), m AS (SELECT *, greatest(w0, w1, w2) AS m FROM w),
 x AS (SELECT *, list_position([w0, w1, w2], m) AS b, exp(w0 - m) AS x0, exp(w1 - m) AS x1, exp(w2 - m) AS x2 FROM m), r AS (SELECT *, ((CASE WHEN b = 1 THEN 0 ELSE x0 END) + (CASE WHEN b = 2 THEN 0 ELSE x1 END) + (CASE WHEN b = 3 THEN 0 ELSE x2 END)) / (x0 + x1 + x2) AS p FROM x)
 SELECT pos, ref, ['A','N','R'][b] AS allele, {phred('p')} AS gq FROM r""",
    "indel_rate_priors": f"SELECT p_partkey, {tidy('log10(pow(exp(p_size * -0.3 + -20.0) * 20, p_size % 2 + 1))')} AS log_prior FROM part",
    "allele_pair_conflicts": "WITH t AS (SELECT p_partkey AS id, p_partkey AS b, p_partkey + p_size % 4 + (CASE WHEN p_size % 3 = 0 THEN 1 ELSE 2 END) AS e FROM part) SELECT x.id, count(*) AS conflicts FROM t x JOIN t y ON x.id < y.id AND x.b < y.e AND y.b < x.e GROUP BY 1",
    "known_alleles": f"{BOTH}, s AS (SELECT pos, base, count(*) AS n FROM obs JOIN ref USING (pos) WHERE base <> ref GROUP BY 1, 2) SELECT pos, base, n, EXISTS (SELECT 1 FROM obs o WHERE o.pos = s.pos AND o.base = s.base AND mapq >= 54) AS known FROM s",
    "depth_totals": "SELECT p_brand AS contig, count(*) AS depth, count(DISTINCT l_linenumber % 2) AS samples FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1",
    "trailing_ambiguous": f"WITH {OBS}, r AS (SELECT string_agg(base, '' ORDER BY read_pos, base) AS s, bool_or(is_fwd) AS fwd FROM obs GROUP BY read_id) SELECT CAST(CASE WHEN fwd THEN length(regexp_extract(s, 'N*$')) ELSE length(regexp_extract(s, '^N*')) END AS INT) AS ambiguous, count(*) AS reads FROM r GROUP BY 1",
    "tied_dedup": f"WITH {OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY pos, base ORDER BY q DESC, mapq DESC, read_id, read_pos) AS r FROM obs) SELECT pos, base, q, mapq, read_id FROM r WHERE r = 1",
}
