"""SQL of the corpus queries that SQL can express, over the given tables.

Fingerprints (op6), fitted models (op4, op10) and the encoding (op9) are beyond it;
tests hold these against brute force.
"""

from __future__ import annotations

from . import chat, decontam, forest, license_scan, pii, quality_rules

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _decontamination() -> str:
    """All windows that an item's shingle puts, against all items of the window's size, by weighted similarity."""
    width = decontam.SHINGLE
    words = r"[x for x in string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+') if x <> '']"
    return f"""WITH items AS (SELECT item_id, least(len(w), {width}) AS width, len(w) - least(len(w), {width}) + 1 AS n, w FROM (SELECT DISTINCT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0),
ni AS MATERIALIZED (SELECT row_number() OVER () AS item, * FROM items),
si AS MATERIALIZED (SELECT item, n, width, q, array_to_string(w[q + 1:q + width], ' ') AS s FROM ni, range(n) r(q)),
docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
sd AS MATERIALIZED (SELECT r, width, p, array_to_string(w[p + 1:p + width], ' ') AS s FROM docs, (SELECT DISTINCT width FROM ni), range(len(w) - width + 1) t(p)),
starts AS MATERIALIZED (SELECT DISTINCT sd.r, si.n, si.width, greatest(sd.p - si.q, 0) AS start FROM sd JOIN si ON si.width = sd.width AND si.s = sd.s),
win AS MATERIALIZED (SELECT t.r, t.n, t.width, t.start, sd.s, count(*) AS c FROM starts t JOIN sd ON sd.r = t.r AND sd.width = t.width AND sd.p >= t.start AND sd.p < t.start + t.n GROUP BY ALL),
totals AS (SELECT r, n, width, start, sum(c) AS total FROM win GROUP BY ALL),
ci AS MATERIALIZED (SELECT item, n, width, s, count(*) AS c FROM si GROUP BY ALL),
pairs AS (SELECT win.r, win.n, win.width, win.start, ci.item, sum(least(win.c, ci.c)) AS common FROM win JOIN ci ON ci.n = win.n AND ci.width = win.width AND ci.s = win.s GROUP BY ALL),
hits AS (SELECT docs.doc_id, ni.item_id, b.start, b.n, CAST(common AS DOUBLE) / CAST(total + b.n - common AS DOUBLE) AS similarity FROM pairs b JOIN totals t USING (r, n, width, start) JOIN docs USING (r) JOIN ni ON ni.item = b.item)
SELECT doc_id, item_id, similarity, CAST(start AS INTEGER) AS start_word, CAST(n AS INTEGER) AS n_shingles FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start, n DESC) AS k FROM hits WHERE similarity >= {decontam.THRESHOLD}) WHERE k = 1"""


def _license_scan() -> str:
    """Phrases word by word; templates held against the words from every template word on."""
    templates = {k: sorted(set(t.split())) for k, t in license_scan.TEMPLATES.items()}
    vocabulary = sorted({w for t in templates.values() for w in t} | {w for p in license_scan.PHRASES for w in p.split()})
    known = ", ".join(map(_quoted, vocabulary))
    rows = ", ".join(f"({_quoted(k)}, {_quoted(w)}, {len(t)}, {license_scan.needed(len(t))})" for k, t in templates.items() for w in t)
    phrases = " UNION ALL ".join(f"SELECT r, k, {_quoted(label)} AS label FROM p WHERE word = {_quoted(parts[0])} AND " + " AND ".join(f"w{i} = {_quoted(w)}" for i, w in enumerate(parts[1:], 1)) for phrase, label in license_scan.PHRASES.items() for parts in [phrase.split()])
    return f"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
each AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS k FROM docs),
p AS MATERIALIZED (SELECT *, lead(word, 1) OVER o AS w1, lead(word, 2) OVER o AS w2 FROM each WINDOW o AS (PARTITION BY r ORDER BY k)),
marks AS MATERIALIZED ({phrases}),
base AS (SELECT r, count(*) AS n_base, min(k) AS first_word, max(k) AS last_word, list_sort(list_distinct(list(label))) AS found FROM marks GROUP BY r),
known AS MATERIALIZED (SELECT r, k, word FROM p WHERE word IN ({known})),
blocks AS MATERIALIZED (SELECT a.r, a.k, b.word FROM known a JOIN known b ON b.r = a.r AND b.k >= a.k AND b.k < a.k + {license_scan.block_length(license_scan.TEMPLATES)} GROUP BY ALL),
held AS (SELECT r, k, label, size, count(*) AS common FROM blocks JOIN (VALUES {rows}) t(label, word, size, need) USING (word) GROUP BY r, k, label, size, need HAVING count(*) >= need),
sets AS (SELECT r, k, list_sort(list(word)) AS content FROM blocks SEMI JOIN held USING (r, k) GROUP BY ALL),
hits AS (SELECT r, list_sort(list_distinct(list(label))) AS more, max(common / size) AS share, count(DISTINCT content) AS n_blocks FROM held JOIN sets USING (r, k) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(array_to_string(found, ','), '') AS base_labels, coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(found, []), coalesce(more, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS score, coalesce(n_blocks, 0) AS n_blocks FROM docs LEFT JOIN base USING (r) LEFT JOIN hits USING (r)"""


def _quality_rules() -> str:
    q = quality_rules
    names = ("failed", *q.RULES)
    space = r"[^\x20\x09-\x0D]+"
    sums = ", ".join(f"count(*) FILTER (WHERE {r}) AS n_{r}" for r in names)
    low, high = q.PRIOR_WEIGHT
    prior = " UNION ALL ".join(f"SELECT '{r}' AS rule, count(*) AS k, sum(n_docs)::DOUBLE AS n, sum(n_docs * n_docs)::DOUBLE AS squares, sum(n_{r})::DOUBLE AS failed, sum(n_{r}::DOUBLE * n_{r} / n_docs) AS raw FROM hosts" for r in names)
    rate = lambda r: f"(n_{r} + (SELECT weight * mean FROM priors WHERE rule = '{r}')) / (n_docs + (SELECT weight FROM priors WHERE rule = '{r}'))"
    rejected = " OR ".join(f"{rate(r)} >= {q.HOST_LIMIT if r == 'failed' else q.RULE_LIMIT}" for r in names)
    return f"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{space}') AS w FROM documents),
windows AS (SELECT r, k, array_to_string(w[k + 1:k + {q.WINDOW}], ' ') AS s FROM docs, range(len(w) - {q.WINDOW - 1}) x(k)),
twice AS (SELECT r, k FROM (SELECT *, count(*) OVER (PARTITION BY r, s) AS c FROM windows) WHERE c > 1),
covered AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, k + i AS at FROM twice, range({q.WINDOW}) x(i)) GROUP BY r),
lines AS (SELECT r, count(*) AS n, count(DISTINCT line) AS d FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '{space}') GROUP BY r),
counted AS (SELECT doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(x) for x in w]), 0) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  coalesce(l.n, 0) AS n_lines, coalesce(l.n - l.d, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM docs LEFT JOIN lines l USING (r) LEFT JOIN covered c USING (r)),
rules AS (SELECT *, n_words < {q.LEAST_WORDS} AS too_short, 100 * n_repeat_words > {q.MOST_REPEATED} * n_words AS repetitive, 100 * n_symbols > {q.MOST_SYMBOLS} * n_words AS symbols, 100 * n_dup_lines > {q.MOST_DUP_LINES} * n_lines AS dup_lines,
  n_words > 0 AND NOT word_chars / n_words BETWEEN {q.WORD_LENGTHS[0]} AND {q.WORD_LENGTHS[1]} AS word_length FROM counted),
judged AS MATERIALIZED (SELECT *, too_short OR repetitive AS base_failed, {' OR '.join(q.RULES)} AS failed FROM rules),
hosts AS MATERIALIZED (SELECT host, count(*) AS n_docs, {sums} FROM judged WHERE host IS NOT NULL GROUP BY host),
moments AS (SELECT *, failed / n AS mean, raw - failed * failed / n AS spread, n - squares / n - (k - 1) AS room FROM ({prior})),
shares AS (SELECT *, CASE WHEN room > 0 AND mean > 0 AND mean < 1 THEN (spread / (mean * (1 - mean)) - (k - 1)) / room ELSE 0 END AS share FROM moments),
priors AS MATERIALIZED (SELECT rule, mean, CASE WHEN k < 2 OR share <= 0 THEN {high} ELSE least(greatest(1 / share - 1, {low}), {high}) END AS weight FROM shares),
verdicts AS (SELECT host, {rate('failed')} AS host_rate, {rejected} AS host_rejected FROM hosts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(host_rejected, false) AS kept, round(host_rate, 9) AS host_rate FROM judged LEFT JOIN verdicts USING (host)"""


def _chats() -> str:
    def escaped(column: str) -> str:
        out = f"replace({column}, '\\', '\\\\')"
        for mark in chat.CONTROLS:
            out = f"replace({out}, {_quoted(mark)}, {_quoted(mark[0] + chr(92) + mark[1:])})"
        return out

    order = "ORDER BY turn NULLS FIRST, role, text"
    learned = f"FILTER (WHERE role = {_quoted(chat.LEARNED)})"
    marks = len(chat.HEAD + chat.MIDDLE + chat.TAIL)
    said = _quoted("</s>[INST] ok [/INST]")
    return f"""WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', {said} UNION ALL SELECT -1, 1, 'assistant', {said})
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256, CAST(coalesce(sum(length(text)) {learned}, 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' {order}) {learned}, '')) AS loss_sha256,
  CAST(sum({marks} + length(replace({escaped('role')}, chr(10), '\\n')) + length({escaped('text')})) AS BIGINT) AS formatted_chars FROM turns GROUP BY conv_id"""


def _archives() -> str:
    five = "[substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((instr('0123456789abcdef', h[(5 * i) // 4 + 1]) - 1) * 16 + coalesce(nullif(instr('0123456789abcdef', h[(5 * i) // 4 + 2]), 0) - 1, 0)) // (8 >> ((5 * i) % 4)) % 32 + 1, 1) for i in range(32)]"
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS keeper FROM pages)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, array_to_string({five}, '') AS payload_digest, CASE WHEN keeper IS NULL OR page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN keeper IS NULL OR page_id = keeper THEN NULL ELSE keeper END AS refers_to FROM p"""


#: The base patterns as RE2 takes them; runs needn't be tried from their start alone there.
_PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _personal_data() -> str:
    """Spans of the patterns, then terms whose mutual information with a protected value reaches the threshold."""
    kinds = " UNION ALL ".join(f"SELECT r, t, {rank} AS rank, '{kind}' AS kind, regexp_extract_all(t, '{_PATTERNS[kind]}') AS found, string_split_regex(t, '{_PATTERNS[kind]}') AS between FROM docs" for rank, (kind, _, _) in enumerate(pii.KINDS))
    spaces = r"[^ \t\n\x0B\f\r]"
    terms = r"[x for x in string_split_regex(lower({0}), '[^\p{{L}}]+') if length(x) >= 3]"
    joined = lambda rows: f"string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) {rows}"
    count = lambda kind: f"count(*) FILTER (WHERE kind = '{kind}') AS n_{kind}"
    return f"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
matched AS (SELECT r, rank, kind, unnest(found) AS value, unnest(between[1:len(found)]) AS before, generate_subscripts(found, 1) AS i FROM ({kinds})),
placed AS (SELECT *, sum(length(before) + length(value)) OVER (PARTITION BY r, rank ORDER BY i) AS stop, regexp_replace(value, '[^0-9]', '', 'g') AS digits FROM matched),
valid AS (SELECT r, rank, kind, CAST(stop - length(value) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, value FROM placed WHERE CASE kind WHEN 'ip' THEN list_bool_and([coalesce(TRY_CAST(x AS INTEGER) <= 255, false) for x in string_split(value, '.')])
  WHEN 'card' THEN length(digits) BETWEEN 14 AND 19 AND list_sum([CASE WHEN j % 2 = 1 THEN CAST(substr(reverse(digits), CAST(j AS BIGINT), 1) AS INTEGER) ELSE 2 * CAST(substr(reverse(digits), CAST(j AS BIGINT), 1) AS INTEGER) - CASE WHEN substr(reverse(digits), CAST(j AS BIGINT), 1) > '4' THEN 9 ELSE 0 END END for j in range(1, length(digits) + 1)]) % 10 = 0
  WHEN 'phone' THEN length(digits) BETWEEN 10 AND 15 ELSE true END),
spans AS MATERIALIZED (SELECT * FROM valid),
holding AS MATERIALIZED (SELECT min(r) AS r, doc_id, t FROM docs SEMI JOIN spans USING (r) GROUP BY doc_id, t),
entities AS (SELECT DISTINCT r, kind || ' ' || value AS entity FROM spans SEMI JOIN holding USING (r)),
holders AS MATERIALIZED (SELECT entity, count(*) AS n_entity FROM entities GROUP BY 1 HAVING count(*) >= {pii.CONTEXTS}),
edges AS (SELECT r, start, stop, coalesce(max(stop) OVER (PARTITION BY r ORDER BY start, rank, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached FROM spans),
parts AS (SELECT r, start AS part, substr(t, reached + 1, greatest(start - reached, 0)) AS x FROM edges JOIN holding USING (r) UNION ALL SELECT r, length(t) + 1, substr(t, m + 1) FROM (SELECT r, CAST(max(stop) AS BIGINT) AS m FROM spans GROUP BY r) JOIN holding USING (r)),
worded AS (SELECT r, part, row_number() OVER () AS n, {terms.format(f"regexp_replace(x, '(^|[ ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || '])' || '{spaces}*[@0-9]{spaces}*', ' ', 'g')")} AS w FROM parts),
around AS MATERIALIZED (SELECT DISTINCT r, w[i] AS term, coalesce(w[i - 1], '') || ' ' || w[i] || ' ' || coalesce(w[i + 1], '') AS context FROM worded, range(1, len(w) + 1) x(i)),
joint AS (SELECT entity, term, count(DISTINCT context) AS n_contexts, count(DISTINCT r) AS n_joint FROM (SELECT * FROM entities SEMI JOIN holders USING (entity)) JOIN around USING (r) GROUP BY 1, 2 HAVING count(DISTINCT context) >= {pii.CONTEXTS}),
everywhere AS (SELECT term, count(*) AS n_docs FROM (SELECT unnest(list_distinct({terms.format('t')})) AS term FROM docs) GROUP BY 1),
revealing AS (SELECT entity, term FROM joint JOIN holders USING (entity) JOIN everywhere USING (term), (SELECT count(*)::DOUBLE AS total FROM docs) WHERE ln(total / n_entity) > 0 AND ln(total * n_joint / (n_entity * greatest(n_docs, n_joint))) >= {pii.SHARE} * ln(total / n_entity)),
told AS (SELECT DISTINCT r, term FROM entities JOIN revealing USING (entity)),
words AS (SELECT r, unnest(found) AS value, unnest(between[1:len(found)]) AS before, generate_subscripts(found, 1) AS i FROM (SELECT r, regexp_extract_all(t, '\\p{{L}}+') AS found, string_split_regex(t, '\\p{{L}}+') AS between FROM holding SEMI JOIN told USING (r))),
lettered AS (SELECT r, value, CAST(sum(length(before) + length(value)) OVER (PARTITION BY r ORDER BY i) AS BIGINT) AS stop FROM words),
added AS (SELECT r, {len(pii.KINDS)} AS rank, '{pii.TERM}' AS kind, stop - length(value) AS start, stop FROM lettered l WHERE EXISTS (SELECT 1 FROM told WHERE told.r = l.r AND told.term = lower(l.value)) AND NOT EXISTS (SELECT 1 FROM spans s WHERE s.r = l.r AND s.start < l.stop AND l.stop - length(l.value) < s.stop)),
base AS (SELECT r, {", ".join(count(k) for k, _, _ in pii.KINDS)}, {joined('AS base')} FROM spans GROUP BY r),
more AS (SELECT r, {joined('AS spans')} FROM (SELECT r, rank, kind, start, stop FROM spans UNION ALL SELECT d.r, a.rank, a.kind, a.start, a.stop FROM added a JOIN holding h USING (r) JOIN docs d ON d.t = h.t AND d.doc_id IS NOT DISTINCT FROM h.doc_id) GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k, _, _ in pii.KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN base USING (r) LEFT JOIN more USING (r)"""


def _hard_negatives() -> str:
    return """WITH e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS MATERIALIZED (SELECT a.r AS ar, a.vec_id AS anchor_id, a.label = b.label AS alike, b.r, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM e a JOIN e b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
p AS (SELECT ar, anchor_id, r AS pr, vec_id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id, r) <= 5),
n AS (SELECT p.anchor_id, positive_id, positive_score, row_number() OVER (PARTITION BY ar, pr ORDER BY score DESC, vec_id, r) AS rank, vec_id AS negative_id, score AS negative_score
  FROM p JOIN s USING (ar) WHERE NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""


def _forest() -> str:
    """Pairs by shared shingles, each set of a group reached from the group's first."""
    n, s = forest.WORDS, forest.SIMILARITY
    return f"""WITH RECURSIVE docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (SELECT r, doc_id, list_sort(list_distinct([array_to_string(w[k + 1:k + {n}], ' ') for k in range(greatest(len(w) - {n - 1}, 1))])) AS s FROM docs WHERE len(w) > 0),
reps AS MATERIALIZED (SELECT min(r) AS rep, min(doc_id) AS least, s, len(s) AS n FROM sets GROUP BY s),
each AS MATERIALIZED (SELECT rep, n, hash(unnest(s)) AS h FROM reps),
pairs AS MATERIALIZED (SELECT a.rep AS a, b.rep AS b FROM each a JOIN each b ON a.h = b.h AND a.rep < b.rep AND 100 * least(a.n, b.n) >= {s} * greatest(a.n, b.n) GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= {s} * (a.n + b.n - count(*))),
edges AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(node, root) AS (SELECT rep, rep FROM reps UNION SELECT edges.b, root FROM reach JOIN edges ON edges.a = reach.node AND edges.b > root),
roots AS MATERIALIZED (SELECT node, min(root) AS root FROM reach GROUP BY node),
named AS (SELECT node, min(least) OVER (PARTITION BY root) AS first FROM roots JOIN reps ON rep = node),
found AS (SELECT d.doc_id, CAST(coalesce(len(t.s), 0) AS BIGINT) AS n_shingles, CASE WHEN t.s IS NULL THEN d.doc_id ELSE first END AS component_id FROM docs d LEFT JOIN sets t USING (r) LEFT JOIN reps ON reps.s = t.s LEFT JOIN named ON node = rep)
SELECT *, doc_id IS NOT DISTINCT FROM component_id AS kept FROM found"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": _decontamination(), "op2_license_scan": _license_scan(), "op3_quality_rules": _quality_rules(), "op5_chat_format": _chats(), "op7_warc": _archives(), "op8_pii": _personal_data(), "op12_hard_negatives": _hard_negatives(), "op13_minhash_neardup": _forest()}
