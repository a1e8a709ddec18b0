"""DuckDB SQL of the registered queries, written from the algebra of the operators."""

from __future__ import annotations

from ..sources.derived import BASES, QUALITY, SYMBOLS

_RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"


def rc(x: str) -> str:
    return _RC.format(x)


RAW = f"""
t0 AS (SELECT doc_id, lower(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) s FROM documents),
p0 AS (SELECT doc_id, j, substr(s, CAST(1 + 100 * j AS INT), 100) s FROM t0, unnest(range(0, (length(s) + 99) // 100)) u(j)),
raw AS (SELECT 'd' || doc_id || '.' || j id, CAST(doc_id % 2 AS INT) kind,
  CASE WHEN (doc_id // 2) % 2 = 1 THEN {rc(f"translate(s, '{SYMBOLS}', '{BASES}')")} ELSE translate(s, '{SYMBOLS}', '{BASES}') END seq,
  CASE WHEN (doc_id // 2) % 2 = 1 THEN reverse(translate(s, '{SYMBOLS}', '{QUALITY}')) ELSE translate(s, '{SYMBOLS}', '{QUALITY}') END qual FROM p0)"""
READS = RAW + ",\nreads AS (SELECT * FROM raw WHERE length(regexp_replace(qual, '[^!-4]', '', 'g')) <= length(qual) // 10)"


def km(k: int, source: str = "reads", name: str = "km") -> str:
    return f"""
{name} AS (SELECT id, kind, i, kmer, substr(kmer, 2, {k - 2}) stem, least(substr(kmer, 2, {k - 2}), {rc(f"substr(kmer, 2, {k - 2})")}) root, seq
  FROM (SELECT id, kind, seq, i, substr(seq, CAST(i + 1 AS INT), {k}) kmer FROM {source}, unnest(range(0, length(seq) - {k} + 1)) u(i)) WHERE NOT contains(kmer, 'N'))"""


def counts(k: int) -> str:
    return READS + "," + km(k) + """,
c_all AS MATERIALIZED (SELECT kmer, any_value(stem) stem, any_value(root) root, count(*) FILTER (WHERE kind = 0) n0, count(*) FILTER (WHERE kind = 1) t0 FROM km GROUP BY kmer),
c AS MATERIALIZED (SELECT kmer, stem, root, least(n0, 65535) n, least(t0, 65535) t FROM c_all WHERE root IN (SELECT root FROM c_all GROUP BY root HAVING sum(n0 + t0) >= 2))"""


_PAIRED = f"""
paired AS (SELECT a.kmer, a.stem, a.root, a.n, a.t, coalesce(b.n, 0) n_rc, coalesce(b.t, 0) t_rc
  FROM (SELECT *, CASE WHEN stem <> {rc("stem")} THEN {rc("kmer")} END other FROM c{{where}}) a LEFT JOIN c b ON b.kmer = a.other)"""
_EVERY, _ABLE = _PAIRED.format(where=""), _PAIRED.format(where=" WHERE t >= 4 AND n <= 1")
_CAND = "cand AS MATERIALIZED (SELECT * FROM paired WHERE t_rc >= 1 AND n_rc <= 1)"


def cand(k: int) -> str:
    return counts(k) + "," + _ABLE + ",\n" + _CAND


_SEGMENT = "i - length(regexp_extract(left(seq, CAST(i AS INT)), '^.*N'))"
INDEXES = cand(16) + f""",
k2i AS (SELECT DISTINCT CASE WHEN kind = 0 THEN 'nn' ELSE 'tn' END "set", cand.kmer, id FROM km JOIN cand ON cand.root = km.root),
i2p AS (
  SELECT DISTINCT id, 'a' dir, CAST({_SEGMENT} AS INT) pos FROM km WHERE kind = 1 AND kmer IN (SELECT kmer FROM cand)
  UNION
  SELECT DISTINCT id, 'b' dir, CAST(length(seq) - 16 - ({_SEGMENT}) AS INT) pos FROM km WHERE kind = 1 AND stem <> {rc("stem")} AND {rc("kmer")} IN (SELECT kmer FROM cand)),
seqs AS (
  SELECT s."set", r.id, r.seq FROM (SELECT DISTINCT "set", id FROM k2i) s JOIN reads r ON r.id = s.id AND r.kind = CASE WHEN s."set" = 'nn' THEN 0 ELSE 1 END
  UNION
  SELECT 'tm', r.id, r.seq FROM (SELECT DISTINCT id FROM i2p) p JOIN reads r ON r.id = p.id AND r.kind = 1)"""
LEADS = INDEXES + """,
able AS (SELECT p.id, p.dir, p.pos, s.seq FROM i2p p JOIN seqs s ON s.id = p.id AND s."set" = 'tm' WHERE length(s.seq) > 0 AND NOT contains(s.seq, 'N')),
led AS (SELECT DISTINCT id, dir FROM (SELECT id, dir, pos, lead(pos, 6) OVER (PARTITION BY id, dir ORDER BY pos) ahead FROM able) WHERE ahead - pos < 10)"""


def lead_kmers(last: int | None) -> str:
    where = "" if last is None else f"WHERE pos <= {last}"
    return LEADS + f""",
lk AS (SELECT id, dir, pos, substr(CASE WHEN dir = 'b' THEN {rc("seq")} ELSE seq END, CAST(pos + 1 AS INT), 16) kmer FROM able SEMI JOIN led USING (id, dir) {where}),
kr AS (SELECT "set", kmer, count(DISTINCT id) reads FROM k2i GROUP BY ALL HAVING count(DISTINCT id) <= 2000)"""


_GROUP_READS = """,
gr AS (SELECT DISTINCT lk.id lead, k2i."set", k2i.id FROM lk JOIN k2i ON k2i.kmer = lk.kmer JOIN kr ON kr."set" = k2i."set" AND kr.kmer = k2i.kmer WHERE kr.reads <= 500)"""


def _group_kmers(multiply: bool) -> str:
    times = "count(*) OVER (PARTITION BY lk.id, lk.kmer)" if multiply else "1"
    part = lambda name, s, op: f"CAST(coalesce(CASE WHEN {s}.reads {op} 500 THEN {s}.reads * {times} END, 0) AS BIGINT) {name}"
    return f"""SELECT lk.id, dir, pos, lk.kmer, {part("kept_n", "x", "<=")}, {part("kept_t", "y", "<=")}, {part("dropped_n", "x", ">")}, {part("dropped_t", "y", ">")}
FROM lk LEFT JOIN kr x ON x.kmer = lk.kmer AND x."set" = 'nn' LEFT JOIN kr y ON y.kmer = lk.kmer AND y."set" = 'tn'"""


def group_kmers(last: int | None, multiply: bool) -> str:
    return f"WITH {lead_kmers(last)} {_group_kmers(multiply)}"


_STATS = f"""WITH {counts(16)},{_EVERY},
h AS (SELECT root, CASE WHEN {rc("stem")} < stem THEN 1 ELSE 0 END o, n, t, CASE WHEN t >= 4 AND n <= 1 AND t_rc >= 1 AND n_rc <= 1 THEN 1 ELSE 0 END hit FROM paired),
r AS (SELECT root, count(*) kmers, coalesce(sum(hit) FILTER (WHERE o = 0), 0) h0, coalesce(sum(hit) FILTER (WHERE o = 1), 0) h1,
  coalesce(sum(n + t) FILTER (WHERE o = 0), 0) s0, coalesce(sum(n + t) FILTER (WHERE o = 1), 0) s1 FROM h GROUP BY root)
SELECT CAST(count(*) AS BIGINT) roots, CAST(sum((s0 >= 1)::INT + (s1 >= 1)::INT) AS BIGINT) stems, CAST(sum((s0 = 1)::INT + (s1 = 1)::INT) AS BIGINT) once,
  CAST(sum(kmers) AS BIGINT) kmers, CAST(sum(s0 + s1) AS BIGINT) sum, {{hits}} FROM r"""
_COMPAT = "CAST(sum((h0 > 0)::INT + (h0 > 0 OR h1 > 0)::INT) AS BIGINT) hits_roots, CAST(sum(2 * (h0 > 0)::INT + (h1 > 0)::INT) AS BIGINT) hits_stems, CAST(sum(2 * h0 + h1) AS BIGINT) hits_kmers"
_DISTINCT = "CAST(sum((h0 > 0 OR h1 > 0)::INT) AS BIGINT) hits_roots, CAST(sum((h0 > 0)::INT + (h1 > 0)::INT) AS BIGINT) hits_stems, CAST(sum(h0 + h1) AS BIGINT) hits_kmers"

ORACLE = {
    "read_quality_filter": f"WITH {READS} SELECT id, kind, seq FROM reads",
    "low_quality_histogram": f"WITH {RAW} SELECT kind, CAST(length(regexp_replace(qual, '[^!-4]', '', 'g')) AS INT) low, count(*) reads FROM raw GROUP BY ALL",
    "n_split_segments": f"""WITH {READS},
s AS (SELECT id, kind, string_split(seq, 'N') parts FROM reads),
e AS (SELECT id, kind, parts, unnest(range(1, len(parts) + 1)) i FROM s)
SELECT id, kind, CAST(coalesce(list_sum(list_transform(parts[1:i - 1], lambda x: length(x) + 1)), 0) AS INT) start, parts[i] segment FROM e WHERE length(parts[i]) >= 16""",
    "kmer_explode": f"WITH {READS},{km(16)} SELECT id, count(*) kmers, min(kmer) least, max(kmer) greatest, CAST(sum(i) AS BIGINT) places FROM km GROUP BY id",
    "revcomp_reads": f"WITH {READS} SELECT id, {rc('seq')} seq, reverse(qual) qual FROM reads",
    "encode_stems": f"""WITH {READS},{km(16)},
s AS (SELECT stem, count(*) n FROM km GROUP BY stem),
code AS (SELECT stem, n, list_sum(list_transform(range(1, 15), lambda i: (strpos('ACGT', stem[i]) - 1) * pow(4, 14 - i))) code,
  list_sum(list_transform(range(1, 15), lambda i: (4 - strpos('ACGT', stem[i])) * pow(4, i - 1))) rc_code FROM s)
SELECT stem, n, CAST(code AS BIGINT) code, stem decoded, CAST(rc_code AS BIGINT) rc_code FROM code""",
    "canonical_roots": f"""WITH {READS},{km(16)}
SELECT root, CASE WHEN {rc("stem")} < stem THEN 1 ELSE 0 END ord, kmer[1] "first", kmer[16] "last", count(*) n, any_value(kmer) kmer FROM km GROUP BY 1, 2, 3, 4""",
    "partition_code": f"""WITH {counts(16)}, m AS (SELECT DISTINCT root, substr(root, 5, 6) sixmer FROM c)
SELECT sixmer, count(*) roots, CAST(list_sum(list_transform(range(1, 7), lambda i: (strpos('ACTG', sixmer[i]) - 1) * pow(2, [0, 4, 8, 2, 6, 10][i]))) AS INT) code FROM m GROUP BY sixmer""",
    "kmer_counts": f"WITH {counts(16)} SELECT kmer, n, t FROM c",
    "kmer_counts_nocache": f"WITH {counts(16)} SELECT kmer, least(n0, 65535) n, least(t0, 65535) t FROM c_all",
    "kmer_counts_k30": f"WITH {counts(30)} SELECT kmer, n, t FROM c",
    "repeated_roots": f"WITH {READS},{km(16)} SELECT root, count(*) total FROM km GROUP BY root HAVING count(*) >= 2",
    "prune_semi_join": f"""WITH {READS},{km(16)}
SELECT id, kind, count(*) kmers, count(DISTINCT root) roots FROM km WHERE root IN (SELECT root FROM km GROUP BY root HAVING count(*) >= 2) GROUP BY id, kind""",
    "pruned_counts": f"WITH {counts(16)} SELECT kmer, n, t FROM c",
    "stem_counts": f"""WITH {counts(16)}
SELECT stem, any_value(root) root, count(*) kmers, CAST(sum(n) AS BIGINT) n, CAST(sum(t) AS BIGINT) t, bool_or((t >= 4 AND n <= 1) OR (t >= 1 AND n <= 1)) open,
  CASE WHEN {rc("stem")} < stem THEN 1 ELSE 0 END ord FROM c GROUP BY stem""",
    "prefiltered_roots": f"WITH {cand(16)} SELECT root, CAST(sum(n0 + t0) AS BIGINT) total, count(*) kmers FROM c_all WHERE root IN (SELECT root FROM cand) GROUP BY root",
    "candidate_kmers": f"WITH {cand(16)} SELECT kmer, n, t, n_rc, t_rc FROM cand",
    "candidate_kmers_k30": f"WITH {cand(30)} SELECT kmer, n, t, n_rc, t_rc FROM cand",
    "export_range": f"WITH {counts(16)} SELECT kmer, n, t FROM c WHERE (n > 2 AND n < 6) OR (t > 2 AND t < 6)",
    "annotate_kmers": f"""WITH {counts(16)},{km(16, "raw", "every")}
SELECT id, CAST(i AS INT) "at", e.kmer, coalesce(c.n, 0) n, coalesce(c.t, 0) t FROM every e LEFT JOIN c ON c.kmer = e.kmer WHERE e.root IN (SELECT root FROM c)""",
    "count_stats": _STATS.format(hits=_COMPAT),
    "count_stats_distinct": _STATS.format(hits=_DISTINCT),
    "count_histogram": f"""WITH {counts(16)}, s AS (SELECT stem, sum(n) n, sum(t) t FROM c GROUP BY stem),
v AS (SELECT 'N' kind, n x FROM s UNION ALL SELECT 'T', t FROM s)
SELECT kind, CAST(floor(log2(x)) AS INT) bin, CAST(pow(2, floor(log2(x))) AS BIGINT) low, count(*) stems FROM v WHERE x > 0 GROUP BY ALL""",
    "index_seq": f'WITH {INDEXES} SELECT "set", id, seq FROM seqs',
    "index_k2i": f'WITH {INDEXES} SELECT "set", kmer, id FROM k2i',
    "k2i_capped": f'WITH {INDEXES} SELECT "set", kmer, count(*) n FROM k2i GROUP BY ALL HAVING count(*) <= 10',
    "index_i2p": f"WITH {INDEXES} SELECT id, dir, pos FROM i2p",
    "i2p_bitmap": f"WITH {INDEXES} SELECT id, dir, CAST(pos // 64 AS INT) word, CAST(sum(CASE WHEN pos % 64 = 63 THEN -9223372036854775808 ELSE 1::BIGINT << (pos % 64) END) AS BIGINT) bits FROM i2p GROUP BY ALL",
    "i2p_positions": f"WITH {INDEXES} SELECT id, dir, string_agg(pos, ' ' ORDER BY pos) positions FROM i2p GROUP BY id, dir",
    "filter_sizes": f"""WITH {INDEXES} SELECT 'seq' "index", "set", count(DISTINCT id) n FROM seqs GROUP BY "set" UNION ALL
SELECT 'k2i', "set", count(DISTINCT kmer) FROM k2i GROUP BY "set" UNION ALL SELECT 'i2p', 'tm', count(DISTINCT id) FROM i2p""",
    "merge_partitions": f"""WITH {INDEXES} SELECT 'seq' "index", "set", id "key", seq "value" FROM seqs UNION ALL
SELECT 'k2i', "set", kmer, id FROM k2i WHERE ("set", kmer) IN (SELECT ("set", kmer) FROM k2i GROUP BY ALL HAVING count(*) <= 2000) UNION ALL SELECT 'i2p', 'tm', id, dir || pos FROM i2p""",
    "fastq_round_trip": f"WITH {RAW} SELECT id, kind, seq, qual FROM raw",
    "plain_round_trip": f"""WITH {INDEXES} SELECT 'seq' "index", "set", id "key", seq "value" FROM seqs UNION ALL
SELECT 'k2i', "set", kmer, id FROM k2i WHERE ("set", kmer) IN (SELECT ("set", kmer) FROM k2i GROUP BY ALL HAVING count(*) <= 2000) UNION ALL SELECT 'i2p', 'tm', id, dir || pos FROM i2p""",
    "annotation_lines": f"""WITH {counts(16)},{km(16, "raw", "every")},
a AS (SELECT id, string_agg(i || ':' || coalesce(c.n, 0) || ':' || coalesce(c.t, 0), ' ' ORDER BY i) kmers FROM every e LEFT JOIN c ON c.kmer = e.kmer WHERE e.root IN (SELECT root FROM c) GROUP BY id)
SELECT raw.id, raw.seq, coalesce(kmers, '') kmers FROM raw LEFT JOIN a ON a.id = raw.id""",
    "group_content": f"""WITH {lead_kmers(50)}{_GROUP_READS},
p AS (SELECT id, any_value(seq) seq, coalesce(string_agg(pos, ' ' ORDER BY pos) FILTER (WHERE dir = 'a'), '') pos_a, coalesce(string_agg(pos, ' ' ORDER BY pos) FILTER (WHERE dir = 'b'), '') pos_b
  FROM able SEMI JOIN led USING (id, dir) GROUP BY id),
e AS ({_group_kmers(True)}),
q AS (SELECT id, string_agg(kmer || ':' || kept_n || ':' || kept_t || ':' || dropped_n || ':' || dropped_t, ' ' ORDER BY pos) FILTER (WHERE dir = 'a') kmers_a,
  string_agg(kmer || ':' || kept_n || ':' || kept_t || ':' || dropped_n || ':' || dropped_t, ' ' ORDER BY pos) FILTER (WHERE dir = 'b') kmers_b FROM e GROUP BY id),
g AS (SELECT lead id, string_agg(gr.id || ':' || s.seq, ' ' ORDER BY gr.id) FILTER (WHERE gr."set" = 'nn') reads_n, string_agg(gr.id || ':' || s.seq, ' ' ORDER BY gr.id) FILTER (WHERE gr."set" = 'tn') reads_t
  FROM gr JOIN seqs s ON s."set" = gr."set" AND s.id = gr.id GROUP BY lead)
SELECT p.id, p.seq, pos_a, pos_b, coalesce(kmers_a, '') kmers_a, coalesce(kmers_b, '') kmers_b, coalesce(reads_n, '') reads_n, coalesce(reads_t, '') reads_t FROM p LEFT JOIN q USING (id) LEFT JOIN g USING (id)""",
    "to_fastq": f"""WITH {INDEXES} SELECT '@' || id || chr(10) || seq || chr(10) || '+' || chr(10) || repeat('!', length(seq)) record, "set" FROM seqs WHERE "set" <> 'tm'""",
    "group_leads": f"WITH {LEADS} SELECT id, dir, string_agg(pos, ' ' ORDER BY pos) positions, any_value(seq) seq FROM able SEMI JOIN led USING (id, dir) GROUP BY id, dir",
    "group_leads_window": f"WITH {LEADS} SELECT id, dir FROM led",
    "group_kmers": group_kmers(50, True),
    "group_kmers_rocks": group_kmers(None, False),
    "group_reads": f'WITH {lead_kmers(50)}{_GROUP_READS} SELECT lead, "set", id, seq FROM gr JOIN seqs USING ("set", id)',
    "group_documents": f"""WITH {lead_kmers(50)}{_GROUP_READS},
p AS (SELECT id, count(*) FILTER (WHERE dir = 'a') pos_a, count(*) FILTER (WHERE dir = 'b') pos_b FROM able SEMI JOIN led USING (id, dir) GROUP BY id),
q AS (SELECT id, count(*) FILTER (WHERE dir = 'a') kmers_a, count(*) FILTER (WHERE dir = 'b') kmers_b FROM lk GROUP BY id),
g AS (SELECT lead id, count(*) FILTER (WHERE "set" = 'nn') reads_n, count(*) FILTER (WHERE "set" = 'tn') reads_t FROM gr GROUP BY lead)
SELECT p.id, CAST(pos_a AS INT) pos_a, CAST(pos_b AS INT) pos_b, CAST(coalesce(kmers_a, 0) AS INT) kmers_a, CAST(coalesce(kmers_b, 0) AS INT) kmers_b,
  CAST(coalesce(reads_n, 0) AS INT) reads_n, CAST(coalesce(reads_t, 0) AS INT) reads_t FROM p LEFT JOIN q USING (id) LEFT JOIN g USING (id)""",
    "group_sets": f"""WITH {lead_kmers(None)}{_GROUP_READS}, d AS (SELECT DISTINCT lead, id FROM gr)
SELECT l.id lead, count(d.id) n, coalesce(string_agg(d.id, ' ' ORDER BY d.id), '') ids FROM (SELECT DISTINCT id FROM led) l LEFT JOIN d ON d.lead = l.id GROUP BY l.id""",
    "group_selection_stats": f"""WITH {LEADS}, one AS (SELECT DISTINCT p.id, s.seq FROM i2p p LEFT JOIN seqs s ON s.id = p.id AND s."set" = 'tm')
SELECT count(*) iterated, count(seq) existing, count(*) FILTER (WHERE length(seq) > 0 AND NOT contains(seq, 'N')) mapped,
  (SELECT count(*) FROM led WHERE dir = 'a') match_a, (SELECT count(*) FROM led WHERE dir = 'b') match_b FROM one""",
    "group_count": f"WITH {LEADS} SELECT count(DISTINCT id) \"groups\" FROM led",
}
