"""The operators' meaning in plain SQL, as common table expressions that build on one another."""

from __future__ import annotations

from orfweave.functions.sequence import COMPLEMENTS, CODES, codon_table, rbs_score_sql
from orfweave.sources.readers import LETTERS, NUCLEOTIDES


def revcomp(x: str) -> str:
    return f"translate(reverse({x}), '{CODES}', '{COMPLEMENTS}')"


_FRAGMENT = "length - ((length - (frame - 1)) % 3) - 2"
_PAIR = "struct_pack(gene := {0}_gene, type := {0}_type, frame := {0}_frame, position := {0})"
_GAP = "CASE WHEN len > 300 THEN pow(1 - p, 100) + len ELSE 1 / pow(1 - p, len / 3.0) + CASE WHEN direction = 'diff' THEN 1 / 0.05 ELSE 0 END END"
_OVERLAP = "1 / pow(1 - p, len) + CASE WHEN direction = 'diff' THEN 1 / 0.05 ELSE 0 END"

def _key(position: str, frame: str, type_: str, gene: str = "'CDS'") -> str:
    """A node as text that sorts by position."""
    return f"printf('%010d %d %s %s', CAST({position} AS BIGINT), CAST({frame} AS BIGINT), {type_}, {gene})"


_SOURCE, _TARGET = _key("0", "0", "'source'", "'source'"), _key("contig_length + 1", "0", "'target'", "'target'")
_ORF = [_key("start", "frame", "'start'"), _key("stop", "frame", "'stop'")]

CTES = {
    "every": f"SELECT doc_id AS contig_id, seq, length(seq) AS length FROM (SELECT doc_id, translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{NUCLEOTIDES}') AS seq FROM documents)",
    "contigs": "SELECT * FROM every WHERE length >= 6",
    "freq": "SELECT contig_id, length, n_at AS n_a, n_at AS n_t, length - n_at AS n_c, length - n_at AS n_g, pa * pa * pa + 2 * pa * pg * pa AS pstop FROM (SELECT *, CASE WHEN length > 0 THEN n_at / (2.0 * length) END AS pa, CASE WHEN length > 0 THEN (length - n_at) / (2.0 * length) END AS pg FROM (SELECT contig_id, length, length - length(translate(seq, 'at', '')) AS n_at FROM every))",
    "bases": "SELECT contig_id, length, pos, (pos - 1) % 3 + 1 AS frame, substring(seq, pos, 1) AS base FROM (SELECT contig_id, length, seq, unnest(range(1, length + 1)) AS pos FROM every)",
    "codons": """SELECT *, CASE WHEN codon IN ('atg', 'gtg', 'ttg') THEN 'fs' WHEN codon IN ('cat', 'cac', 'caa') THEN 'rs' WHEN codon IN ('tag', 'tga', 'taa') THEN 'fe' WHEN codon IN ('cta', 'tca', 'tta') THEN 're' END AS class
      FROM (SELECT contig_id, length, seq, pos, (pos - 1) % 3 + 1 AS frame, substring(seq, pos, 3) AS codon FROM (SELECT contig_id, length, seq, unnest(range(1, length - 1)) AS pos FROM every))""",
    "paired": """SELECT *, min(pos) FILTER (class = 'fe') OVER (PARTITION BY contig_id, frame ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nxt,
      max(pos) FILTER (class = 're') OVER (PARTITION BY contig_id, frame ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prv FROM codons""",
    "orfs": f"""SELECT contig_id, strand, frame, start, stop, abs(stop - start) + 3 AS length, rbs,
        CASE WHEN strand > 0 THEN substring(seq, start, stop - start + 3) ELSE {revcomp("substring(seq, stop, start - stop + 3)")} END AS dna FROM (
      SELECT contig_id, seq, 1 AS strand, frame, pos AS start, coalesce(nxt, {_FRAGMENT}) AS stop, CASE WHEN pos >= 21 THEN substring(seq, pos - 20, 21) ELSE '' END AS rbs FROM paired WHERE class = 'fs' OR pos <= 3
      UNION ALL
      SELECT contig_id, seq, -1, -frame, pos, coalesce(prv, frame), {revcomp("substring(seq, pos + 3, 21)")} FROM paired WHERE class = 'rs' OR (pos = {_FRAGMENT} AND codon NOT IN ('cat', 'cac', 'caa'))
    ) WHERE abs(stop - start) + 3 >= 90""",
    "counted": f"SELECT *, substring(dna, 1, 3) AS start_codon, {rbs_score_sql('rbs')} AS rbs_score, (length(dna) - length(replace(dna, 'a', ''))) / length AS pa, (length(dna) - length(replace(dna, 't', ''))) / length AS pt, (length(dna) - length(replace(dna, 'g', ''))) / length AS pg FROM orfs",
    "orf": "SELECT * EXCLUDE (pa, pt, pg, rbs), pt * pa * pa + 2 * pt * pg * pa AS pstop FROM counted",
    "bins": "SELECT contig_id, unnest(range(28)) AS score FROM contigs",
    "windows": f"SELECT contig_id, pos, w, {rbs_score_sql('w')} AS score FROM (SELECT contig_id, pos, unnest([w, {revcomp('w')}]) AS w FROM (SELECT contig_id, pos, substring(seq, pos, 21) AS w FROM (SELECT contig_id, seq, unnest(range(1, length + 1)) AS pos FROM contigs)))",
    "background": "SELECT contig_id, score, (coalesce(n, 0) + 1) / (sum(coalesce(n, 0)) OVER (PARTITION BY contig_id) + 28.0) AS background FROM bins LEFT JOIN (SELECT contig_id, score, count(*) AS n FROM windows GROUP BY ALL) USING (contig_id, score)",
    "weights": "SELECT contig_id, score, background, training, training / background AS weight_rbs FROM (SELECT contig_id, score, (coalesce(n, 0) + 1) / (sum(coalesce(n, 0)) OVER (PARTITION BY contig_id) + 28.0) AS training FROM bins LEFT JOIN (SELECT contig_id, rbs_score AS score, count(*) AS n FROM orf GROUP BY ALL) USING (contig_id, score)) JOIN background USING (contig_id, score)",
    "phases": "SELECT contig_id, length, pos, frame, sum(CASE WHEN base IN ('g', 'c') THEN 1 ELSE 0 END) OVER (PARTITION BY contig_id, frame ORDER BY pos ROWS BETWEEN 19 PRECEDING AND 20 FOLLOWING) AS g1 FROM bases",
    "gc": "SELECT * EXCLUDE (length) FROM (SELECT *, lead(g1, 1) OVER w AS g2, lead(g1, 2) OVER w AS g3 FROM phases WINDOW w AS (PARTITION BY contig_id ORDER BY pos)) WHERE g3 IS NOT NULL",
    "gcidx": """SELECT contig_id, pos, frame,
      CASE WHEN g1 > g2 AND g1 > g3 THEN 1 WHEN g1 <= g2 AND g2 > g3 THEN 2 ELSE 3 END AS max_f, CASE WHEN g1 > g2 THEN CASE WHEN g2 > g3 THEN 3 ELSE 2 END WHEN g1 > g3 THEN 3 ELSE 1 END AS min_f,
      CASE WHEN g3 > g2 AND g3 > g1 THEN 1 WHEN g3 <= g2 AND g2 > g1 THEN 2 ELSE 3 END AS max_r, CASE WHEN g3 > g2 THEN CASE WHEN g2 > g1 THEN 3 ELSE 2 END WHEN g3 > g1 THEN 3 ELSE 1 END AS min_r FROM gc""",
    "atg": "SELECT *, 3 * (abs(stop - start) // 8) AS skip FROM orf WHERE start_codon = 'atg' QUALIFY row_number() OVER (PARTITION BY contig_id, strand, stop ORDER BY length DESC) = 1",
    "trained": """SELECT contig_id, CASE WHEN strand > 0 THEN max_f ELSE max_r END AS mx, CASE WHEN strand > 0 THEN min_f ELSE min_r END AS mn FROM atg JOIN gcidx USING (contig_id)
      WHERE (strand > 0 AND pos >= start + skip AND pos < stop - 36 AND (pos - start) % 3 = 0) OR (strand < 0 AND pos <= start - skip AND pos > stop + 36 AND (start - pos) % 3 = 0)""",
    "tcounts": "SELECT contig_id, 1 + count(*) FILTER (mx = 1) AS x1, 1 + count(*) FILTER (mx = 2) AS x2, 1 + count(*) FILTER (mx = 3) AS x3, 1 + count(*) FILTER (mn = 1) AS m1, 1 + count(*) FILTER (mn = 2) AS m2, 1 + count(*) FILTER (mn = 3) AS m3 FROM contigs LEFT JOIN trained USING (contig_id) GROUP BY contig_id",
    "training": "SELECT contig_id, [1.0 / x, x1 / x, x2 / x, x3 / x] AS pos_max, [1.0 / m, m1 / m, m2 / m, m3 / m] AS pos_min FROM (SELECT *, greatest(x1, x2, x3) AS x, greatest(m1, m2, m3) AS m FROM tcounts)",
    "held": """SELECT contig_id, strand, start, stop, sum(CASE WHEN strand > 0 THEN pos_max[max_f + 1] * pos_min[min_f + 1] ELSE pos_max[max_r + 1] * pos_min[min_r + 1] END) AS exponent
      FROM orf JOIN gcidx USING (contig_id) JOIN training USING (contig_id) WHERE (strand > 0 AND pos >= start AND pos < stop AND (pos - start) % 3 = 0) OR (strand < 0 AND pos <= start AND pos > stop AND (start - pos) % 3 = 0) GROUP BY ALL""",
    "scored": "SELECT contig_id, strand, frame, start, stop, length, pstop, rbs_score, ln(1 - pstop) * exponent AS ln_hold, ln(CASE start_codon WHEN 'atg' THEN 1 WHEN 'gtg' THEN 0.10 / 0.85 WHEN 'ttg' THEN 0.05 / 0.85 ELSE 1 END) + ln(weight_rbs) - ln(1 - pstop) * exponent AS ln_score FROM orf JOIN held USING (contig_id, strand, start, stop) JOIN weights ON weights.contig_id = orf.contig_id AND weights.score = orf.rbs_score",
    "longest": "SELECT * FROM orf QUALIFY row_number() OVER (PARTITION BY contig_id, strand, stop ORDER BY length DESC) = 1",
    "nodes": """SELECT n.*, f.length AS contig_length, f.pstop AS pgap, coalesce(n.own, f.pstop) AS p FROM (
        SELECT contig_id, 'CDS' AS gene, 'stop' AS type, frame, stop AS position, start AS other, pstop AS own FROM longest
        UNION ALL SELECT contig_id, 'CDS', 'start', frame, start, stop, NULL FROM orf) n JOIN freq f USING (contig_id)""",
    "pairs": """SELECT a.contig_id, a.pgap, a.position AS l, b.position AS r, a.gene AS l_gene, b.gene AS r_gene, a.type AS l_type, b.type AS r_type, a.frame AS l_frame, b.frame AS r_frame, a.other AS l_other, b.other AS r_other, a.p AS l_p, b.p AS r_p
      FROM nodes a JOIN nodes b ON a.contig_id = b.contig_id AND b.position > a.position AND b.position < a.position + 500""",
    "kinds": """SELECT *, CASE
      WHEN l_frame > 0 AND r_frame > 0 AND l_type = 'stop' AND r_type = 'start' THEN 'gap_same' WHEN l_frame < 0 AND r_frame < 0 AND l_type = 'start' AND r_type = 'stop' THEN 'gap_same'
      WHEN l_frame * r_frame > 0 AND l_type <> r_type AND l_frame <> r_frame AND r < l_other AND r_other < l AND ((l_frame > 0) = (l_type = 'start')) THEN 'overlap_same'
      WHEN l_frame > 0 AND r_frame < 0 AND l_type = 'stop' AND r_type = 'stop' THEN 'gap_diff' WHEN l_frame < 0 AND r_frame > 0 AND l_type = 'start' AND r_type = 'start' AND r - l > 2 THEN 'gap_diff'
      WHEN l_frame < 0 AND r_frame > 0 AND l_type = 'stop' AND r_type = 'stop' AND r_other + 3 < l AND r < l_other THEN 'overlap_diff'
      WHEN l_frame > 0 AND r_frame < 0 AND l_type = 'start' AND r_type = 'start' AND r_other < l AND r < l_other THEN 'overlap_diff' END AS kind FROM pairs""",
    "connections": f"""SELECT contig_id, kind, CASE WHEN kind LIKE 'gap%' THEN l_type ELSE r_type END AS source_type, CASE WHEN kind LIKE 'gap%' THEN r_type ELSE l_type END AS target_type, CASE WHEN kind LIKE 'gap%' THEN l ELSE r END AS source_position, CASE WHEN kind LIKE 'gap%' THEN l_frame ELSE r_frame END AS source_frame, CASE WHEN kind LIKE 'gap%' THEN r ELSE l END AS target_position, CASE WHEN kind LIKE 'gap%' THEN r_frame ELSE l_frame END AS target_frame, len AS length, CASE WHEN kind LIKE 'gap%' THEN {_GAP} ELSE {_OVERLAP} END AS cost
      FROM (SELECT *, split_part(kind, '_', 2) AS direction, r - l + CASE WHEN kind LIKE 'gap%' THEN -3 ELSE 3 END AS len, CASE WHEN kind LIKE 'gap%' THEN pgap ELSE (l_p + r_p) / 2 END AS p FROM kinds WHERE kind IS NOT NULL)""",
    "ends": f"""SELECT contig_id, kind, position, frame, type, contig_length, len AS length, {_GAP} AS cost FROM (
      SELECT contig_id, 'source' AS kind, position, frame, type, contig_length, position AS len, pgap AS p, 'same' AS direction FROM nodes WHERE position <= 2000 AND (frame > 0) = (type = 'start')
      UNION ALL SELECT contig_id, 'target', position, frame, type, contig_length, contig_length - position, pgap, 'same' FROM nodes WHERE contig_length - position <= 2000 AND (frame > 0) = (type = 'stop'))""",
    "covered": "SELECT DISTINCT contig_id, unnest(range(least(start, stop), least(greatest(start, stop), f.length - 1))) AS n FROM longest JOIN freq f USING (contig_id)",
    "gaps": "SELECT contig_id, last, n AS base FROM (SELECT contig_id, n, coalesce(lag(n) OVER (PARTITION BY contig_id ORDER BY n), 0) AS last FROM covered) WHERE n - last > 500",
    "long": f"""SELECT contig_id, 'long_gap_' || direction AS kind, l, l_frame, l_type, r, r_frame, r_type, len AS length, {_GAP} AS cost FROM (
      SELECT DISTINCT a.contig_id, a.position AS l, a.frame AS l_frame, a.type AS l_type, b.position AS r, b.frame AS r_frame, b.type AS r_type, b.position - a.position - 3 AS len, a.pgap AS p, CASE WHEN a.frame * b.frame > 0 THEN 'same' ELSE 'diff' END AS direction
      FROM gaps g JOIN nodes a ON a.contig_id = g.contig_id AND a.position <= last + 1 AND a.position > last - 500 JOIN nodes b ON b.contig_id = g.contig_id AND b.position >= base - 1 AND b.position < base + 500
      WHERE (a.frame > 0) = (a.type = 'stop') AND ((a.frame * b.frame > 0) = (a.type <> b.type)))""",
    "spans": "SELECT contig_id, strand, start, stop, least(start, stop) AS a, greatest(start, stop) AS b FROM longest",
    # the cheapest path: costs as whole numbers of any size; reached holds the least cost of each node so far
    "steps": f"""SELECT contig_id, s, t, CAST(trunc(cost * 1000) AS BIGNUM) AS w FROM (
      SELECT contig_id, CASE WHEN strand > 0 THEN {_ORF[0]} ELSE {_ORF[1]} END AS s, CASE WHEN strand > 0 THEN {_ORF[1]} ELSE {_ORF[0]} END AS t, -exp(ln_score) AS cost FROM scored
      UNION ALL SELECT contig_id, {_key("source_position", "source_frame", "source_type")}, {_key("target_position", "target_frame", "target_type")}, cost FROM connections
      UNION ALL SELECT contig_id, {_key("l", "l_frame", "l_type")}, {_key("r", "r_frame", "r_type")}, cost FROM long
      UNION ALL SELECT contig_id, CASE WHEN kind = 'source' THEN {_SOURCE} ELSE {_key("position", "frame", "type")} END, CASE WHEN kind = 'source' THEN {_key("position", "frame", "type")} ELSE {_TARGET} END, cost FROM ends)""",
    "settled": """WITH RECURSIVE reached(contig_id, node, cost) USING KEY (contig_id, node) AS (
      SELECT contig_id, '0000000000 0 source source', CAST(0 AS BIGNUM) FROM contigs
      UNION SELECT n.contig_id, n.t, n.cost FROM (SELECT e.contig_id, e.t, min(b.cost + e.w) AS cost FROM reached b JOIN steps e ON e.contig_id = b.contig_id AND e.s = b.node GROUP BY ALL) n
      LEFT JOIN recurring.reached r ON r.contig_id = n.contig_id AND r.node = n.t WHERE r.cost IS NULL OR n.cost < r.cost) SELECT * FROM reached""",
    "befores": "SELECT e.contig_id, e.t, min(e.s) AS s FROM steps e JOIN settled a ON a.contig_id = e.contig_id AND a.node = e.s JOIN settled b ON b.contig_id = e.contig_id AND b.node = e.t WHERE a.cost + e.w = b.cost GROUP BY ALL",
    "walked": """WITH RECURSIVE walk AS (SELECT contig_id, t AS node, s AS before, 0 AS k FROM befores WHERE t LIKE '% target target'
      UNION ALL SELECT w.contig_id, b.t, b.s, k + 1 FROM walk w JOIN befores b ON b.contig_id = w.contig_id AND b.t = w.before)
      SELECT contig_id, node, max(k) OVER (PARTITION BY contig_id) - k AS place FROM walk""",
    "called": """SELECT contig_id, CAST(number AS INTEGER) AS number, gene, CASE WHEN p.frame < 0 THEN -1 ELSE 1 END AS strand, low AS "left", high + 2 AS "right", ln_score, printf('%E', coalesce(-exp(ln_score), 0.0)) AS score_text,
        CAST(row_number() OVER (PARTITION BY contig_id ORDER BY low, high, p.frame < 0 DESC) AS INTEGER) AS place FROM (
      SELECT contig_id, place // 2 AS number, split_part(a, ' ', 4) AS gene, CAST(split_part(a, ' ', 2) AS INTEGER) AS frame, CAST(split_part(a, ' ', 1) AS INTEGER) AS low, CAST(split_part(b, ' ', 1) AS INTEGER) AS high
      FROM (SELECT contig_id, place, node AS a, lead(node) OVER (PARTITION BY contig_id ORDER BY place) AS b FROM walked) WHERE place % 2 = 0 AND b IS NOT NULL) p
      LEFT JOIN (SELECT contig_id, frame, least(start, stop) AS low, greatest(start, stop) AS high, ln_score FROM scored) o USING (contig_id, frame, low, high)""",
    "cut": f"""SELECT c.*, length, CASE WHEN strand < 0 THEN {revcomp('substring(seq, "left", "right" - "left" + 1)')} ELSE substring(seq, "left", "right" - "left" + 1) END AS dna,
      CASE WHEN strand < 0 THEN 'complement(' || "left" || '..' || "right" || ')' ELSE "left" || '..' || "right" END AS location FROM called c JOIN contigs USING (contig_id)""",
    "amino": "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{a}')" for c, a in codon_table().items()) + ") AS t(codon, amino)",
    "residues": "SELECT contig_id, strand, start, stop, k, amino FROM (SELECT contig_id, strand, start, stop, dna, unnest(range(length // 3)) AS k FROM longest) JOIN amino ON amino.codon = substring(dna, 3 * k + 1, 3)",
}


def with_ctes(query: str) -> str:
    """The query with the expressions that it and they name, in an order in which each comes after what it needs."""
    import re

    order: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\w+", text):
            if name in CTES and name not in order and re.search(rf"(?:FROM|JOIN)\s+{name}\b", text):
                visit(CTES[name])
                if name not in order:
                    order.append(name)

    visit(query)
    if not order:
        return query
    # a table that several others read is worked out once
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in order) + " " + query
