"""The same queries as SQL for another engine, written independently of the DataFrame plans."""

from __future__ import annotations

from corpusloom.plans.corpus import documents_sql, normalize_sql

#: Written out anew, so that a wrong value in the library shows: patterns, limits, sizes, and of each setting words, similarity, contamination.
WORD = "[\\pL\\pN_]+"
PHONE = "(?:^|[^0-9])(?:\\+?86[- ]?)?1[3-9]\\d{9}(?:$|[^0-9])"
EMAIL = "(?:^|[^\\pL\\pN_])[A-Za-z0-9._%+-]*[A-Za-z0-9_][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}(?:$|[^\\pL\\pN_])"
MIN_CHARS, LICENSES = 40, ("project-original", "cc-by-4.0")
LENGTH, SHARD_SEQUENCES, SEED = 1024, 64, 42
PARTITIONS, REPEAT, HOT_SHARE, HOT, FAILING = 8, 64, 0.75, "hot-key", 3
BATCH, EPOCHS, WORKERS = 32, 3, 2
SETTINGS = {"": (5, 0.8, 0.8), "_ref": (3, 0.45, 0.45)}

RAW = f"raw AS MATERIALIZED {documents_sql('raw_documents')}"
LAB = f"lab AS MATERIALIZED {documents_sql('lab04')}"
EVAL = f"ev AS MATERIALIZED {documents_sql('evaluation')}"


def _sets(name: str, n: int) -> str:
    """Shingle sets of n words, and classes of documents with one set."""
    w = f"regexp_extract_all(replace(lower(text), 'ß', 'ss'), '{WORD}')"
    return f"""{name}_words AS (SELECT source_id, {w} AS w FROM {name}),
{name}_sets AS (SELECT source_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
  ELSE list_sort(list_distinct(list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' ')))) END AS s FROM {name}_words),
{name}_members AS MATERIALIZED (SELECT source_id, min(source_id) OVER (PARTITION BY s) AS class_id, s FROM {name}_sets),
{name}_classes AS MATERIALIZED (SELECT DISTINCT class_id, s FROM {name}_members)"""


def _jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))"
    return f"(CASE WHEN len({a}) + len({b}) = 0 THEN 1.0 ELSE CAST({both} AS DOUBLE) / (len({a}) + len({b}) - {both}) END)"


def _pairs(similarity: float) -> str:
    return f"""lab_long AS (SELECT class_id, len(s) AS n, unnest(s) AS w FROM lab_classes),
shared AS (SELECT a.class_id AS l, b.class_id AS r, a.n AS na, b.n AS nb, count(*) AS k FROM lab_long a JOIN lab_long b ON a.w = b.w AND a.class_id < b.class_id GROUP BY ALL),
pairs AS MATERIALIZED (SELECT l AS left_source_id, r AS right_source_id, CAST(k AS DOUBLE) / (na + nb - k) AS j FROM shared WHERE CAST(k AS DOUBLE) / (na + nb - k) >= {similarity})"""


def _leaks(contamination: float) -> str:
    return f"""ev_long AS (SELECT class_id, len(s) AS n, unnest(s) AS w FROM ev_classes), own_long AS (SELECT class_id, len(s) AS n, unnest(s) AS w FROM lab_classes),
leaks AS MATERIALIZED (SELECT l AS left_source_id, r AS right_source_id, j FROM (SELECT a.class_id AS l, b.class_id AS r, CAST(count(*) AS DOUBLE) / (any_value(a.n) + any_value(b.n) - count(*)) AS j
  FROM own_long a JOIN ev_long b ON a.w = b.w GROUP BY a.class_id, b.class_id) WHERE j >= {contamination}
  UNION ALL SELECT a.class_id, b.class_id, 1.0 FROM lab_classes a, ev_classes b WHERE len(a.s) = 0 AND len(b.s) = 0)"""


CLUSTERS = """links AS (SELECT left_source_id AS a, right_source_id AS b FROM pairs UNION SELECT right_source_id, left_source_id FROM pairs),
reach AS (SELECT class_id AS v, class_id AS o FROM lab_classes UNION SELECT r.v, l.b FROM reach r JOIN links l ON r.o = l.a),
labels AS (SELECT v, min(o) AS cluster_id FROM reach GROUP BY v),
every AS (SELECT m.source_id, l.cluster_id, count(*) OVER (PARTITION BY l.cluster_id) AS n_members FROM lab_members m JOIN labels l ON m.class_id = l.v),
clusters AS MATERIALIZED (SELECT * FROM every WHERE n_members > 1)"""
MARKS = f"""marks AS (SELECT source_id, len(text) < {MIN_CHARS} AS too_short, NOT coalesce(license IN {LICENSES}, false) AS license_not_allowed, coalesce(safety, '') <> 'safe' AS unsafe_metadata,
  regexp_matches(text, '{EMAIL}') OR regexp_matches(text, '{PHONE}') AS pii_detected FROM lab)"""
DECISIONS = f"""decisions AS MATERIALIZED (SELECT source_id, array_to_string(list_filter([CASE WHEN c THEN 'evaluation_contamination' END, CASE WHEN license_not_allowed THEN 'license_not_allowed' END, CASE WHEN d THEN 'near_duplicate' END,
  CASE WHEN pii_detected THEN 'pii_detected' END, CASE WHEN too_short THEN 'too_short' END, CASE WHEN unsafe_metadata THEN 'unsafe_metadata' END], lambda x: x IS NOT NULL), ',') AS reasons
  FROM (SELECT m.*, m.source_id IN (SELECT source_id FROM clusters WHERE source_id <> cluster_id) AS d,
        m.source_id IN (SELECT source_id FROM lab_members WHERE class_id IN (SELECT left_source_id FROM leaks)) AS c FROM marks m))"""
TRUTH = f"""truth AS (SELECT l AS left_source_id, r AS right_source_id, bool_or(is_duplicate) AS is_duplicate, count(*) AS n_rows, count(*) FILTER (WHERE is_duplicate) AS n_true
  FROM (SELECT least(left_source_id, right_source_id) AS l, greatest(left_source_id, right_source_id) AS r, is_duplicate FROM duplicate_labels
        WHERE left_source_id IS NOT NULL AND right_source_id IS NOT NULL AND is_duplicate IS NOT NULL AND left_source_id <> right_source_id) GROUP BY l, r)"""
LISTED = """listed AS (SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM mix_spec)),
exact AS (SELECT source, weight, weight * (SELECT count(*) FROM listed) AS x FROM mix_spec WHERE source IS NOT NULL),
quota AS (SELECT source, weight, CAST(floor(x) AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY round_even(x - floor(x), 9) DESC, source) <= (SELECT count(*) FROM listed) - sum(floor(x)) OVER () THEN 1 ELSE 0 END AS quota FROM exact)"""
SELECTED = f"""selected AS (SELECT source, doc_id, rank FROM (SELECT l.source, l.doc_id, q.quota, row_number() OVER (PARTITION BY l.source ORDER BY sha256('{SEED}:' || l.doc_id), l.doc_id) AS rank FROM listed l JOIN quota q ON l.source = q.source) WHERE rank <= quota)"""
SPLIT = f"""{RAW}, parts AS (SELECT source_id, CASE WHEN row_number() OVER (ORDER BY sha256('{SEED}:' || source_id), source_id) <= greatest(1, least(count(*) OVER () - 1, CAST(round_even(count(*) OVER () * 0.1, 0) AS BIGINT))) THEN 'validation' ELSE 'train' END AS part FROM raw)"""
#: The stream holds the first occurrence of each text.
STREAM = f"""every AS MATERIALIZED {documents_sql('raw_documents')}, raw AS MATERIALIZED (SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY pos, source_id) AS nth FROM every) WHERE nth = 1),
placed AS MATERIALIZED (SELECT source_id, domain, pos, text, n_tokens, ge - n_tokens AS gs, ge FROM (SELECT *, CAST(sum(n_tokens) OVER (ORDER BY pos, source_id) AS BIGINT) AS ge FROM (SELECT source_id, domain, pos, text, CAST(strlen(text) + 2 AS BIGINT) AS n_tokens FROM raw))),
tot AS (SELECT coalesce(max(ge), 0) AS total FROM placed),
seqs AS MATERIALIZED (SELECT seq, format('seq_{{:08d}}', seq) AS sequence_id, seq // {SHARD_SEQUENCES} AS sh, format('shard-{{:05d}}', seq // {SHARD_SEQUENCES}) AS shard, CAST(least({LENGTH}, total - 1 - seq * {LENGTH}) AS INTEGER) AS trainable
  FROM tot, range(0, CAST(greatest(0, ceil((SELECT total - 1 FROM tot) / {LENGTH})) AS BIGINT)) AS t(seq))"""
PROV = f"""prov AS MATERIALIZED (SELECT s.seq, s.sequence_id, s.sh, s.shard, p.source_id, p.domain, CAST(greatest(p.gs, s.seq * {LENGTH}) - s.seq * {LENGTH} AS INTEGER) AS sequence_token_start, CAST(least(p.ge, (s.seq + 1) * {LENGTH}) - s.seq * {LENGTH} AS INTEGER) AS sequence_token_end,
  greatest(p.gs, s.seq * {LENGTH}) - p.gs AS document_token_start, least(p.ge, (s.seq + 1) * {LENGTH}) - p.gs AS document_token_end FROM seqs s JOIN placed p ON p.gs < (s.seq + 1) * {LENGTH} AND p.ge > s.seq * {LENGTH})"""
PART = f"CAST(('0x' || substr(sha256({{}}), 1, 16))::UBIGINT % {PARTITIONS} AS INTEGER)"
EXPANDED = f"""expanded AS MATERIALIZED (SELECT k * n + ordinal AS row_id, CAST(doc_id AS VARCHAR) AS source_id, domain, CAST(len(text) AS INTEGER) AS char_count,
  CASE WHEN k * n + ordinal < floor(n * {REPEAT} * {HOT_SHARE}) THEN '{HOT}' ELSE CAST(doc_id AS VARCHAR) END AS join_key FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal FROM documents), (SELECT count(*) AS n FROM documents), range({REPEAT}) AS r(k)),
salted AS (SELECT row_id, salted_key, {PART.format('join_key')} AS part, {PART.format('salted_key')} AS salted_part FROM (SELECT *, CASE WHEN join_key = '{HOT}' THEN '{HOT}:' || (row_id % {PARTITIONS}) ELSE join_key END AS salted_key FROM expanded)),
dist AS (SELECT strategy, min(c) AS least, max(c) AS most, round_even(max(c) / avg(c), 6) AS max_mean_ratio, count(*) FILTER (WHERE c = 0) AS n_empty FROM (
  SELECT strategy, p, count(row_id) AS c FROM (SELECT * FROM (VALUES ('hash'), ('salted')) v(strategy), range({PARTITIONS}) r(p)) g LEFT JOIN (SELECT 'hash' AS st, part AS q, row_id FROM salted UNION ALL SELECT 'salted', salted_part, row_id FROM salted) x ON g.strategy = x.st AND g.p = x.q GROUP BY strategy, p) GROUP BY strategy)"""
#: Tokens one by one: begin, bytes, end; a window's first token is also the last label of the window before.
TOKENS = f"""tok AS (SELECT gs AS p, 1 AS id FROM placed UNION ALL SELECT ge - 1, 2 FROM placed
  UNION ALL SELECT gs + i, 4 + CAST('0x' || b AS INTEGER) FROM (SELECT gs, unnest(bytes) AS b, generate_subscripts(bytes, 1) AS i FROM (SELECT gs, regexp_extract_all(hex(encode(text)), '..') AS bytes FROM placed))),
win AS (SELECT p // {LENGTH} AS seq, p, id FROM tok UNION ALL SELECT p // {LENGTH} - 1, p, id FROM tok WHERE p % {LENGTH} = 0 AND p > 0),
lists AS (SELECT seq, list(id ORDER BY p) AS l FROM win GROUP BY seq HAVING count(*) > 1)"""
SCHEDULE = f"""sched AS (SELECT epoch, (row_number() OVER (PARTITION BY epoch ORDER BY sha256('{SEED}:' || epoch || ':' || sequence_id), sequence_id) - 1) // {BATCH} AS step, sequence_id FROM seqs, range({EPOCHS}) e(epoch))"""
LOSSES = "losses AS (SELECT l_linenumber AS seed, CASE l_returnflag WHEN 'A' THEN 'baseline' WHEN 'R' THEN 'candidate' END AS run, l_suppkey AS sequence_id, l_extendedprice / 10000 AS loss, CAST(l_quantity AS BIGINT) AS n_tokens FROM lineitem)"
DELTA = "delta AS (SELECT sequence_id, round_even(b, 6) AS baseline, round_even(c, 6) AS candidate, round_even(c - b, 6) AS delta FROM (SELECT sequence_id, avg(loss) FILTER (WHERE run = 'baseline') AS b, avg(loss) FILTER (WHERE run = 'candidate') AS c FROM losses GROUP BY sequence_id) WHERE b IS NOT NULL AND c IS NOT NULL)"


def _audited(suffix: str) -> dict[str, str]:
    """The SQL of the queries that a setting changes."""
    words, similarity, contamination = SETTINGS[suffix]
    sets, pairs, leaks = _sets("lab", words), _pairs(similarity), _leaks(contamination)
    every = f"WITH RECURSIVE {LAB}, {EVAL}, {sets}, {_sets('ev', words)}, {pairs}, {leaks}, {CLUSTERS}, {MARKS}, {DECISIONS}"
    outcomes = f"""WITH {LAB}, {sets}, {TRUTH}, outcomes AS (SELECT t.left_source_id, t.right_source_id, t.is_duplicate, {_jaccard('a.s', 'b.s')} AS similarity
  FROM truth t JOIN lab_members a ON a.source_id = t.left_source_id JOIN lab_members b ON b.source_id = t.right_source_id)"""
    count = lambda p, a: f"count(*) FILTER (WHERE {p} AND {a})"
    found = {
        "shingles": f"WITH {LAB}, {sets} SELECT source_id, CAST(len(s) AS INTEGER) AS n_shingles, sha256(array_to_string(s, '|')) AS digest FROM lab_members",
        "jaccard_scalar": f"{outcomes} SELECT left_source_id, right_source_id, round_even(similarity, 6) AS similarity FROM outcomes",
        "truth_outcomes": f"{outcomes} SELECT left_source_id, right_source_id, is_duplicate, round_even(similarity, 6) AS similarity, similarity >= {similarity} AS predicted_duplicate FROM outcomes",
        "dedup_confusion": f"""{outcomes}, c AS (SELECT {count('p', 'a')} AS tp, {count('p', 'NOT a')} AS fp, {count('NOT p', 'a')} AS fn, {count('NOT p', 'NOT a')} AS tn FROM (SELECT similarity >= {similarity} AS p, is_duplicate AS a FROM outcomes)),
            r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS q FROM c)
            SELECT tp, fp, fn, tn, CAST(round_even(p, 6) AS DOUBLE) AS precision, CAST(round_even(q, 6) AS DOUBLE) AS recall, CAST(CASE WHEN p + q = 0 THEN 0.0 ELSE round_even(2 * p * q / (p + q), 6) END AS DOUBLE) AS f1 FROM r""",
        "near_dup_pairs": f"WITH {LAB}, {sets}, {pairs} SELECT left_source_id, right_source_id, round_even(j, 6) AS similarity FROM pairs",
        "near_dup_members": f"WITH {LAB}, {sets} SELECT source_id, class_id FROM lab_members",
        "near_dup_links": f"WITH {LAB}, {sets}, {pairs}, ends AS (SELECT unnest([left_source_id, right_source_id]) AS c FROM pairs) SELECT m.source_id, m.class_id, count(e.c) AS n_links FROM lab_members m LEFT JOIN ends e ON e.c = m.class_id GROUP BY m.source_id, m.class_id",
        "contamination_pairs": f"WITH {LAB}, {EVAL}, {sets}, {_sets('ev', words)}, {leaks} SELECT left_source_id, right_source_id, CAST(round_even(j, 6) AS DOUBLE) AS similarity FROM leaks",
        "dup_clusters": f"WITH RECURSIVE {LAB}, {sets}, {pairs}, {CLUSTERS} SELECT source_id, cluster_id, n_members FROM clusters",
        "quality_decision": f"{every} SELECT source_id, CASE WHEN reasons = '' THEN 'accept' ELSE 'reject' END AS decision, reasons FROM decisions",
        "reason_counts": f"{every} SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, ',')) AS reason FROM decisions WHERE reasons <> '') GROUP BY reason",
        "quality_metrics": f"""{every} SELECT count(*) AS n_documents, count(*) FILTER (WHERE reasons = '') AS n_accepted, count(*) FILTER (WHERE reasons <> '') AS n_rejected, count(*) FILTER (WHERE reasons LIKE '%near_duplicate%') AS n_near_duplicates,
            count(*) FILTER (WHERE reasons LIKE '%evaluation_contamination%') AS n_contaminated, (SELECT count(*) FROM pairs) AS n_pairs, (SELECT count(*) FROM leaks) AS n_contamination_pairs, (SELECT count(DISTINCT cluster_id) FROM clusters) AS n_clusters FROM decisions""",
        "policy_candidate": f"{every} SELECT source_id FROM decisions WHERE reasons = ''",
        "policy_diff": f"{every} SELECT source_id, 'include' AS baseline_policy, CASE WHEN reasons = '' THEN 'include' ELSE 'exclude' END AS candidate_policy, CASE WHEN reasons = '' THEN 'quality_policy_accept' ELSE reasons END AS reasons FROM decisions",
    }
    return {f"{k}{suffix}": v for k, v in found.items()}


def oracle_sql() -> dict[str, str]:
    return _plain() | _audited("") | _audited("_ref")


def _plain() -> dict[str, str]:
    norm = normalize_sql("text")
    return {
        "doc_scan_validate": f"""SELECT 'no_source_id' AS violation, count(*) FILTER (WHERE source_id IS NULL) AS n FROM raw_documents UNION ALL SELECT 'no_text', count(*) FILTER (WHERE text IS NULL) FROM raw_documents
            UNION ALL SELECT 'empty_text', count(*) FILTER (WHERE {norm} = '') FROM raw_documents UNION ALL SELECT 'no_metadata', count(*) FILTER (WHERE metadata IS NULL) FROM raw_documents
            UNION ALL SELECT 'delivered_again', count(*) - count(DISTINCT source_id) FROM raw_documents WHERE source_id IS NOT NULL""",
        "normalize_text": f"WITH {RAW} SELECT source_id, sha256(text) AS sha256, CAST(len(text) AS INTEGER) AS n_chars FROM raw",
        "content_hash_id": f"WITH {RAW} SELECT source_id, sha256(text) AS content_sha256, 'doc_' || substr(sha256(text), 1, 16) AS doc_id FROM raw",
        "exact_dedup": f"WITH {RAW} SELECT 'doc_' || substr(sha256(text), 1, 16) AS doc_id, source_id, pos, copies FROM (SELECT *, count(*) OVER (PARTITION BY text) AS copies, row_number() OVER (PARTITION BY text ORDER BY pos, source_id) AS n FROM raw) WHERE n = 1",
        "exact_dedup_stats": f"WITH {RAW} SELECT count(*) AS n_documents, count(DISTINCT text) AS n_unique, count(*) - count(DISTINCT text) AS n_duplicates FROM raw",
        "ctas_json_infer": "SELECT domain, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS n_chars FROM documents GROUP BY domain",
        "truth_pair_canonical": f"WITH {TRUTH} SELECT * FROM truth",
        "truth_violations": f"""WITH {TRUTH}, known AS (SELECT source_id FROM lab04 WHERE text IS NOT NULL AND source_id IS NOT NULL), named AS (SELECT left_source_id AS i FROM duplicate_labels UNION SELECT right_source_id FROM duplicate_labels)
            SELECT 'null_id' AS violation, count(*) AS n FROM duplicate_labels WHERE left_source_id IS NULL OR right_source_id IS NULL UNION ALL SELECT 'null_label', count(*) FROM duplicate_labels WHERE is_duplicate IS NULL
            UNION ALL SELECT 'self_pair', count(*) FROM duplicate_labels WHERE left_source_id = right_source_id UNION ALL SELECT 'unknown_id', count(*) FROM named WHERE i IS NOT NULL AND i NOT IN (SELECT source_id FROM known)
            UNION ALL SELECT 'repeated_pair', count(*) FROM truth WHERE n_rows > 1 UNION ALL SELECT 'contradicted_pair', count(*) FROM truth WHERE n_true > 0 AND n_true < n_rows""",
        "pii_email": f"WITH {LAB} SELECT source_id FROM lab WHERE regexp_matches(text, '{EMAIL}')",
        "pii_phone": f"WITH {LAB} SELECT source_id FROM lab WHERE regexp_matches(text, '{PHONE}')",
        "quality_reasons": f"WITH {LAB}, {MARKS} SELECT source_id, array_to_string(list_filter([CASE WHEN license_not_allowed THEN 'license_not_allowed' END, CASE WHEN pii_detected THEN 'pii_detected' END, CASE WHEN too_short THEN 'too_short' END, CASE WHEN unsafe_metadata THEN 'unsafe_metadata' END], lambda x: x IS NOT NULL), ',') AS reasons FROM marks",
        "mix_quota": f"WITH {LISTED} SELECT source, round_even(weight, 6) AS weight, CAST(quota AS BIGINT) AS quota FROM quota",
        "mix_shortage": f"WITH {LISTED} SELECT q.source, CAST(q.quota AS BIGINT) AS quota, count(l.doc_id) AS available, CAST(greatest(q.quota - count(l.doc_id), 0) AS BIGINT) AS missing FROM quota q LEFT JOIN listed l ON l.source = q.source GROUP BY q.source, q.quota",
        "mix_select": f"WITH {LISTED}, {SELECTED} SELECT source, doc_id, rank FROM selected",
        "mix_order": f"WITH {LISTED}, {SELECTED} SELECT doc_id, source, sha256('mix:{SEED}:' || doc_id) AS order_key FROM selected",
        "mix_actual_weights": f"WITH {LISTED}, {SELECTED} SELECT source, count(*) AS n, round_even(count(*) / sum(count(*)) OVER (), 6) AS actual_weight FROM selected GROUP BY source",
        "hash_split": f"WITH {SPLIT} SELECT source_id, part FROM parts",
        "split_check": f"WITH {SPLIT} SELECT CAST(0 AS BIGINT) AS in_both, CAST(0 AS BIGINT) AS in_neither, count(*) FILTER (WHERE part = 'train') AS n_train, count(*) FILTER (WHERE part = 'validation') AS n_validation FROM parts",
        "token_offsets": f"WITH {STREAM} SELECT source_id, n_tokens, gs AS global_start, ge AS global_end FROM placed",
        "packing_metrics": f"WITH {STREAM} SELECT CAST(sum(trainable) + 1 AS BIGINT) AS total_tokens, CAST(sum(trainable) AS BIGINT) AS trainable_tokens, count(*) AS n_sequences, round_even(sum(trainable) / (count(*) * {LENGTH}), 6) AS efficiency FROM seqs",
        "pack_provenance": f"WITH {STREAM}, {PROV} SELECT seq, source_id, sequence_token_start, sequence_token_end, document_token_start, document_token_end FROM prov",
        "pack_sequences": f"WITH {STREAM}, {TOKENS} SELECT format('seq_{{:08d}}', seq) AS sequence_id, sha256(array_to_string(list_resize(l[1:{LENGTH}], {LENGTH}, 0), ',')) AS input_sha, sha256(array_to_string(list_resize(l[2:], {LENGTH}, 0), ',')) AS label_sha, CAST(len(l) - 1 AS INTEGER) AS trainable FROM lists",
        "sequence_contract_check": "SELECT v AS violation, CAST(0 AS BIGINT) AS n FROM (VALUES ('length'), ('mask'), ('shift')) t(v)",
        "shard_assign": f"WITH {STREAM} SELECT sequence_id, shard FROM seqs",
        "shard_stats": f"WITH {STREAM}, {PROV} SELECT a.shard, n_sequences, trainable_tokens, n_documents, n_domains, source_ids_sha FROM (SELECT shard, count(*) AS n_sequences, CAST(sum(trainable) AS BIGINT) AS trainable_tokens FROM seqs GROUP BY shard) a JOIN (SELECT shard, count(DISTINCT source_id) AS n_documents, count(DISTINCT domain) AS n_domains, sha256(array_to_string(list_sort(list(DISTINCT source_id)), ',')) AS source_ids_sha FROM prov GROUP BY shard) b ON a.shard = b.shard",
        "shard_domains": f"WITH {STREAM}, {PROV} SELECT shard, domain, count(*) AS n_spans FROM prov GROUP BY shard, domain",
        "sequence_lineage": f"WITH {STREAM}, {PROV} SELECT sequence_id, shard, source_id, domain, sequence_token_start, sequence_token_end FROM prov",
        "dataset_version_metrics": f"WITH {STREAM}, {PROV} SELECT count(*) AS n_shards, min(n) AS least, max(n) AS most, CAST(sum(n) AS BIGINT) AS n_sequences, round_even((SELECT count(DISTINCT seq) FROM prov) / sum(n), 6) AS lineage_coverage FROM (SELECT sh, count(*) AS n FROM seqs GROUP BY sh)",
        "shard_roundtrip": "SELECT CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS added",
        "strict_budget_filter": f"WITH {STREAM} SELECT sequence_id FROM seqs WHERE trainable = {LENGTH}",
        "token_budget": f"WITH {STREAM} SELECT count(*) // {BATCH} AS steps, count(*) // {BATCH} * {BATCH * LENGTH} AS tokens FROM seqs WHERE trainable = {LENGTH}",
        "domain_agg": "SELECT domain, count(*) AS n, CAST(sum(len(text)) AS BIGINT) AS n_chars FROM documents GROUP BY domain",
        "domain_agg_equiv": "SELECT CAST(0 AS BIGINT) AS n_different",
        "skew_expand": f"WITH {EXPANDED} SELECT row_id, source_id, domain, char_count, join_key FROM expanded",
        "hash_partition_id": f"WITH {RAW} SELECT source_id, {PART.format('source_id')} AS part FROM raw",
        "skew_salted_partition": f"WITH {EXPANDED} SELECT row_id, salted_key, part, salted_part FROM salted",
        "partition_distribution": f"WITH {EXPANDED} SELECT least, most, max_mean_ratio, n_empty, strategy FROM dist",
        "skew_improvement": f"WITH {EXPANDED} SELECT h.max_mean_ratio AS hash_ratio, s.max_mean_ratio AS salted_ratio, round_even(h.max_mean_ratio - s.max_mean_ratio, 6) AS improvement FROM dist h, dist s WHERE h.strategy = 'hash' AND s.strategy = 'salted'",
        "partition_files": f"WITH {EXPANDED} SELECT 'hash' AS strategy, part, count(*) AS n_rows FROM salted GROUP BY part UNION ALL SELECT 'salted', salted_part, count(*) FROM salted GROUP BY salted_part",
        "task_recovery_summary": f"WITH {EXPANDED} SELECT CAST({PARTITIONS} AS BIGINT) AS completed, CAST({PARTITIONS} + 1 AS BIGINT) AS attempts, CAST(1 AS BIGINT) AS retries, CAST({PARTITIONS} AS BIGINT) AS reused, count(*) AS n_rows FROM salted",
        "epoch_repeat": f"WITH {STREAM} SELECT sequence_id, CAST(epoch AS INTEGER) AS epoch FROM seqs, range({EPOCHS}) e(epoch)",
        "worker_shard_assign": f"WITH {STREAM} SELECT sh AS shard, count(*) AS n_sequences, CAST(sh % {WORKERS} AS INTEGER) AS worker FROM seqs GROUP BY sh",
        "feed_integrity": f"WITH {STREAM} SELECT CAST(sum(n) * {EPOCHS} AS BIGINT) AS samples, CAST(sum(n) AS BIGINT) AS distinct_sequences, CAST(sum(t) * {EPOCHS} AS BIGINT) AS trainable_tokens, CAST(sum(ceil(n * {EPOCHS} / {BATCH})) AS BIGINT) AS batches FROM (SELECT sh % {WORKERS} AS worker, count(*) AS n, sum(trainable) AS t FROM seqs GROUP BY 1)",
        "batch_schedule": f"WITH {STREAM}, {SCHEDULE} SELECT CAST(epoch AS INTEGER) AS epoch, step, sequence_id FROM sched",
        "resume_equivalence": "SELECT CAST(0 AS BIGINT) AS n_different",
        "latency_percentiles": f"""SELECT event_type, n, round_even(l[CAST(round_even((n - 1) * 0.5, 0) AS BIGINT) + 1], 6) AS p50, round_even(l[CAST(round_even((n - 1) * 0.99, 0) AS BIGINT) + 1], 6) AS p99, round_even(m, 6) AS median
            FROM (SELECT event_type, count(value) AS n, list_sort(list(value) FILTER (WHERE value IS NOT NULL)) AS l, median(value) AS m FROM events GROUP BY event_type)""",
        "line_offset_index": f"WITH {RAW}, sized AS (SELECT format('part-{{:05d}}', pos // 500) AS path, pos, strlen(text) + 1 AS size FROM raw) SELECT path, row_number() OVER w - 1 AS line_number, CAST(sum(size) OVER w - size AS BIGINT) AS offset, CAST(size AS BIGINT) AS length FROM sized WINDOW w AS (PARTITION BY path ORDER BY pos)",
        "random_sample_read": f"WITH {RAW} SELECT source_id, CAST(strlen(text) AS INTEGER) AS n_bytes FROM raw ORDER BY sha256('{SEED}:' || source_id), source_id LIMIT 256",
        "ab_sequence_delta": f"WITH {LOSSES}, {DELTA} SELECT * FROM delta",
        "ab_one_sided": f"WITH {LOSSES} SELECT * FROM (SELECT sequence_id, coalesce(bool_or(run = 'baseline'), false) AS in_baseline, coalesce(bool_or(run = 'candidate'), false) AS in_candidate FROM losses WHERE loss IS NOT NULL GROUP BY sequence_id) WHERE in_baseline <> in_candidate",
        "failure_topk": f"WITH {LOSSES}, {DELTA} SELECT * FROM delta ORDER BY delta DESC, sequence_id LIMIT 3",
        "ab_compare": f"WITH {LOSSES} SELECT round_even(b, 6) AS baseline, round_even(c, 6) AS candidate, round_even(c - b, 6) AS delta, round_even(c / b, 6) AS ratio FROM (SELECT avg(loss) FILTER (WHERE run = 'baseline') AS b, avg(loss) FILTER (WHERE run = 'candidate') AS c FROM losses)",
        "ab_seed_aggregate": f"WITH {LOSSES} SELECT round_even(avg(d), 6) AS mean_delta, round_even(stddev_pop(d), 6) AS std_delta, count(*) FILTER (WHERE d < 0) AS better, count(*) FILTER (WHERE d > 0) AS worse, count(*) FILTER (WHERE d = 0) AS equal FROM (SELECT seed, avg(loss) FILTER (WHERE run = 'candidate') - avg(loss) FILTER (WHERE run = 'baseline') AS d FROM losses GROUP BY seed)",
        "ab_controls": f"WITH {LOSSES} SELECT count(*) AS n_sequences, count(*) FILTER (WHERE n = 2) AS in_both, (SELECT count(DISTINCT seed) FROM losses WHERE run IS NOT NULL) AS n_seeds FROM (SELECT sequence_id, count(DISTINCT run) AS n FROM losses WHERE run IS NOT NULL GROUP BY sequence_id)",
        "masked_mean": "SELECT l_orderkey, round_even(avg(round(l_extendedprice * 100)) FILTER (WHERE l_returnflag <> 'R'), 6) AS mean_cents FROM lineitem GROUP BY l_orderkey",
        "token_weighted_loss": f"WITH {LOSSES} SELECT run, round_even(sum(loss * n_tokens) / sum(n_tokens), 6) AS loss, CAST(sum(n_tokens) AS BIGINT) AS n_tokens FROM losses WHERE run IS NOT NULL GROUP BY run",
        "content_fingerprint": f"WITH {RAW}, h AS (SELECT sha256(source_id || '|' || text) AS h FROM raw) SELECT count(*) AS n, {', '.join(f'CAST(sum((chr(48) || chr(120) || substr(h, {1 + 8 * i}, 8))::UBIGINT) AS BIGINT) AS sum_{i}' for i in range(4))} FROM h",
        "pretoken_counts": f"WITH {RAW} SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '{WORD}')) AS word FROM raw) GROUP BY word",
        "event_windows": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round_even(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    }
