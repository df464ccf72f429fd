"""DuckDB SQL for the rows of this subpackage's queries, where SQL can give them: written from the contracts, not from the plans."""

from __future__ import annotations

from vellum.llm import decontaminate, mixing, quality, secrets

WORD = r"'[^\x20\x09-\x0D]+'"
#: What separates tokens of a line: white space of any script.
TOKEN = r"'[^\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+'"
_LOWER = f"translate({{}}, '{decontaminate.UPPER}', '{decontaminate.LOWER}')"


def _crc_table() -> list[int]:
    """Of the CRC-32 of zip files, for four bits at a time."""
    out = []
    for k in range(16):
        for _ in range(4):
            k = k >> 1 ^ (0xEDB88320 if k & 1 else 0)
        out.append(k)
    return out


def _crc32(text: str) -> str:
    half = f"xor(c >> 4, {_crc_table()}[CAST(xor(c & 15, b) AS INTEGER) + 1])"
    # Hex digits of each byte, the lower one first.
    digits = f"list_transform(string_split(regexp_replace(hex(encode({text})), '(.)(.)', '\\2\\1', 'g'), ''), lambda x: strpos('0123456789ABCDEF', x) - 1)"
    digits = f"CASE WHEN {text} = '' THEN [] ELSE {digits} END"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {digits}), lambda c, b: {half}), 4294967295)"


def jaccard(docs: str) -> str:
    """WITH parts over docs (doc_id, text) that end in jaccard: r, doc_id, n_shingles, component_id."""
    return f"""
j_docs AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, {WORD}) AS w FROM {docs}),
j_sets AS MATERIALIZED (SELECT DISTINCT r, array_to_string(w[p : p + 4], ' ') AS s FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM j_docs WHERE len(w) > 0)),
j_sizes AS MATERIALIZED (SELECT r, count(*) AS n FROM j_sets GROUP BY r),
j_both AS (SELECT x.r AS a, y.r AS b, count(*) AS k FROM j_sets x JOIN j_sets y ON x.s = y.s AND x.r < y.r GROUP BY x.r, y.r),
j_pairs AS MATERIALIZED (SELECT a, b FROM j_both JOIN j_sizes x ON a = x.r JOIN j_sizes y ON b = y.r WHERE 100 * k >= 75 * (x.n + y.n - k)),
j_links AS MATERIALIZED (SELECT a, b FROM j_pairs UNION SELECT b, a FROM j_pairs),
j_reach(a, b) AS (SELECT a, b FROM j_links UNION SELECT j_reach.a, j_links.b FROM j_reach JOIN j_links ON j_reach.b = j_links.a),
j_least AS (SELECT a, min(doc_id) AS least FROM j_reach JOIN j_docs ON b = r GROUP BY a),
jaccard AS MATERIALIZED (SELECT j_docs.r, doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, least) AS component_id FROM j_docs LEFT JOIN j_sizes ON j_docs.r = j_sizes.r LEFT JOIN j_least ON j_docs.r = a)"""


def mix(docs: str, rounds: int = 8) -> str:
    """WITH parts over docs (doc_id, source, text) that end in mix: doc_id, size, source_size, target, e0 and e1 (words taken), s0 and s1 (first slots).

    The shares are settled in rounds, in whole numbers: what is left to share is kept as its double."""
    size = f"len(regexp_extract_all(coalesce(text, ''), {WORD}))"
    name = "'17:' || coalesce(CAST(doc_id AS VARCHAR), md5(text), '')"
    out = f"""
m_docs AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, source, {size} AS size, CAST('0x' || substr(md5({name}), 1, {mixing.HASH_BITS // 4}) AS BIGINT) AS h FROM {docs}),
m_sources AS MATERIALIZED (SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS weight, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM m_docs GROUP BY source),
m_round0 AS MATERIALIZED (SELECT src, source_size, weight, false AS full_, (SELECT 3 * sum(source_size) FROM m_sources)::HUGEINT AS twice_left FROM m_sources),"""
    for k in range(rounds):
        out += f"""
m_over{k} AS MATERIALIZED (SELECT *, NOT full_ AND twice_left * weight > 2 * sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER () * 2 * source_size AS over_ FROM m_round{k}),
m_round{k + 1} AS MATERIALIZED (SELECT src, source_size, weight, full_ OR over_ AS full_, twice_left - sum(CASE WHEN over_ THEN 4 * source_size ELSE 0 END) OVER () AS twice_left FROM m_over{k}),"""
    point = f"CAST((((k + 1) & 2147483647) * {mixing.GOLDEN}) & 4294967295 AS DOUBLE) / 4294967296.0"
    return (
        out
        + f"""
m_share AS (SELECT src, source_size, full_, twice_left * weight AS num, 2 * sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER () AS den FROM m_round{rounds}),
m_goal AS MATERIALIZED (SELECT src, source_size, CASE WHEN full_ THEN CAST(2 * source_size AS DOUBLE) ELSE CAST(num AS DOUBLE) / CAST(den AS DOUBLE) END AS target, CASE WHEN full_ THEN 2 * source_size ELSE num // den END::BIGINT AS quota FROM m_share),
m_all AS MATERIALIZED (SELECT sum(quota)::BIGINT AS total, least({mixing.BLOCK_WORDS}, greatest(1, min(CASE WHEN quota > 0 THEN quota END) // {mixing.LEAST_BLOCKS}, sum(quota) // {mixing.MANY_SLOTS}))::BIGINT AS block FROM m_goal),
m_edges AS MATERIALIZED (SELECT list(edge ORDER BY src) AS edges FROM (SELECT src, CAST(sum(quota) OVER (ORDER BY src) AS DOUBLE) / CAST(total AS DOUBLE) AS edge FROM m_goal, m_all) WHERE src < (SELECT max(src) FROM m_goal)),
m_slots AS MATERIALIZED (SELECT k AS slot, src, row_number() OVER (PARTITION BY src ORDER BY k) - 1 AS rank FROM (SELECT k, len(list_filter(edges, lambda e: e <= point)) AS src FROM (SELECT k, {point} AS point FROM (SELECT unnest(range(0, (total + block // 2) // block)) AS k FROM m_all)), m_edges)),
m_reach AS (SELECT src, count(*) * any_value(block) AS reach FROM m_slots, m_all GROUP BY src),
m_placed AS MATERIALIZED (SELECT r, doc_id, size, g.source_size, target, src, coalesce(reach, 0) AS reach, (sum(size) OVER (PARTITION BY src ORDER BY h, doc_id, size, r ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS at_ FROM m_docs d JOIN m_sources s ON d.source IS NOT DISTINCT FROM s.source JOIN m_goal g USING (src) LEFT JOIN m_reach USING (src)),
mix AS MATERIALIZED (SELECT r, doc_id, size, source_size, target, greatest(least(size, reach - at_), 0)::BIGINT AS e0, greatest(least(size, reach - at_ - source_size), 0)::BIGINT AS e1, x.slot AS s0, y.slot AS s1
  FROM m_placed p CROSS JOIN m_all LEFT JOIN m_slots x ON size > 0 AND x.src = p.src AND x.rank = at_ // block LEFT JOIN m_slots y ON size > 0 AND y.src = p.src AND y.rank = (at_ + source_size) // block)"""
    )


def decontamination(docs: str, n: int = 13) -> str:
    """WITH parts over docs (doc_id, text) and benchmark that end in dirt: r, doc_id, n_words, n_hit, items (sorted, joined), n_items."""
    words = lambda c: f"regexp_extract_all({_LOWER.format(f"coalesce({c}, '')")}, '{decontaminate.WORD}')"
    return f"""
c_items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {words("text")} AS w FROM benchmark),
c_wins AS MATERIALIZED (SELECT DISTINCT item, k, w[p : p + k - 1] AS win FROM (SELECT item, w, least(len(w), {n}) AS k, unnest(range(1, len(w) - least(len(w), {n}) + 2)) AS p FROM c_items WHERE len(w) > 0)),
c_docs AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, {words("text")} AS w FROM {docs}),
c_hits AS MATERIALIZED (SELECT r, p, k, win FROM (SELECT r, p, k, w[p : p + k - 1] AS win FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM c_docs, (SELECT DISTINCT k FROM c_wins))) SEMI JOIN c_wins USING (k, win)),
c_places AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + k)) AS q FROM c_hits) GROUP BY r),
c_found AS (SELECT r, string_agg(item, ',' ORDER BY item) AS items, count(*) AS n_items FROM (SELECT DISTINCT r, item FROM c_hits JOIN c_wins USING (k, win)) GROUP BY r),
dirt AS MATERIALIZED (SELECT r, doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(items, '') AS items, coalesce(n_items, 0) AS n_items FROM c_docs LEFT JOIN c_places USING (r) LEFT JOIN c_found USING (r))"""


CONTAMINATED = "n_hit > 0 AND 20 * n_hit >= n_words"


def rules(docs: str, columns: str = "doc_id") -> str:
    """WITH parts over docs that end in judged: the columns, the counts and verdict of the quality rules, and clean (the text without failed lines)."""
    own = quality.Rules()
    boiler, menu = (p.pattern.replace("'", "''") for p in (quality.BOILERPLATE, quality.MENU))
    bare = f"regexp_extract(q_line, {TOKEN[:-2]}(.*{TOKEN[1:-2]})?', 0, 's')"
    size = lambda c: f"list_sum(list_transform(regexp_extract_all({c}, {TOKEN}), lambda x: length(x)))"
    marks = f"[{', '.join(repr(s) for s in sorted(quality.SEPARATORS))}]"
    real = lambda x: f"CAST({x} AS DOUBLE)"
    return f"""
q_docs AS MATERIALIZED (SELECT row_number() OVER () AS q_r, *, regexp_extract_all(coalesce(text, ''), {WORD}) AS q_w FROM {docs}),
q_lines AS MATERIALIZED (SELECT q_r, q_k, q_line, regexp_extract_all(q_line, {TOKEN}) AS q_t FROM (SELECT q_r, unnest(string_split(text, chr(10))) AS q_line, generate_subscripts(string_split(text, chr(10)), 1) AS q_k FROM q_docs WHERE text <> '')),
q_good AS (SELECT q_r, q_k, q_line FROM q_lines WHERE NOT (
    regexp_matches({bare}, '{boiler}', 'i') OR (length({bare}) < 200 AND regexp_matches({bare}, '{menu}', 'i'))
    OR (regexp_matches(q_line, '[|»›•·]') AND len(list_filter(q_t[2:], lambda x: list_contains({marks}, x))) > {real(own.max_separators)} * len(q_t))
    OR length(regexp_replace(q_line, '[^#*$%&|<>]', '', 'g')) > greatest({own.few}, {real(own.max_symbols)} * len(q_t))
    OR length(regexp_replace(q_line, '[^!]', '', 'g')) > greatest({own.few}, {real(own.max_shouts)} * len(q_t))
    OR (len(q_t) >= {own.same_words} AND list_max(list_transform(list_distinct(q_t), lambda x: len(list_filter(q_t, lambda y: y = x)))) > {real(own.max_same)} * len(q_t)))),
q_clean AS (SELECT q_r, string_agg(q_line, chr(10) ORDER BY q_k) AS clean FROM q_good GROUP BY q_r),
q_dups AS (SELECT q_r, count(*) - count(DISTINCT q_line) AS n FROM q_lines WHERE regexp_matches(q_line, {WORD}) GROUP BY q_r),
q_three AS (SELECT q_r, q_p, count(*) OVER (PARTITION BY q_r, q_x) AS n FROM (SELECT q_r, q_p, array_to_string(q_w[q_p : q_p + 2], ' ') AS q_x FROM (SELECT q_r, q_w, unnest(range(1, len(q_w) - 1)) AS q_p FROM q_docs))),
q_repeat AS (SELECT q_r, count(DISTINCT q) AS n FROM (SELECT q_r, unnest(range(q_p, q_p + 3)) AS q FROM q_three WHERE n > 1) GROUP BY q_r),
q_base AS (SELECT q_docs.*, coalesce(clean, text) AS q_clean, len(q_w)::BIGINT AS n_words, coalesce(list_sum(list_transform(q_w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(q_dups.n, 0) AS n_dup_lines, coalesce(q_repeat.n, 0) AS n_repeat_words, CASE WHEN text <> '' THEN coalesce(clean, '') ELSE text END AS clean
    FROM q_docs LEFT JOIN q_clean USING (q_r) LEFT JOIN q_dups USING (q_r) LEFT JOIN q_repeat USING (q_r)),
judged AS MATERIALIZED (SELECT {columns}, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND coalesce({size("clean")}, 0) >= {real(own.min_left)} * coalesce({size("text")}, 0) AS kept, clean
    FROM (SELECT *, n_words < {own.min_words} OR 100 * n_repeat_words > {own.max_repeat_pct} * n_words AS base_failed FROM q_base))"""


def shards(docs: str, n: int = 8) -> str:
    """WITH parts over docs (doc_id, text) that end in sharded: doc_id, size, text_crc32, shard, slot.

    The least capacity first, then the least sum of squared sizes within it; of equal choices the earliest last cut, and so on."""
    out = f"""
s_docs AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 1 AS size FROM {docs}),
s_groups AS MATERIALIZED (SELECT text, min(doc_id) AS first_id, sum(size)::BIGINT AS size FROM s_docs GROUP BY text),
s_ends AS MATERIALIZED (SELECT row_number() OVER (ORDER BY first_id) AS j, sum(size) OVER (ORDER BY first_id)::BIGINT AS t FROM s_groups UNION ALL SELECT 0, 0),
s_top0 AS (SELECT j, t, CASE WHEN j = 0 THEN 0 END AS c FROM s_ends),"""
    for k in range(n):
        out += f"""
s_top{k + 1} AS MATERIALIZED (SELECT y.j, y.t, min(greatest(x.c, y.t - x.t)) AS c FROM s_top{k} x JOIN s_ends y ON x.j <= y.j AND x.c IS NOT NULL GROUP BY y.j, y.t),"""
    out += f"""
s_capacity AS MATERIALIZED (SELECT c FROM s_top{n} ORDER BY j DESC LIMIT 1),
s_cut0 AS (SELECT j, t, CAST(0 AS HUGEINT) AS c, CAST([] AS BIGINT[]) AS cuts FROM s_ends WHERE j = 0),"""
    for k in range(n):
        out += f"""
s_cut{k + 1} AS MATERIALIZED (SELECT j, t, best.c AS c, best.cuts AS cuts FROM (SELECT y.j, y.t, min({{'c': x.c + CAST(y.t - x.t AS HUGEINT) * (y.t - x.t), 'i': x.j, 'cuts': list_append(x.cuts, y.j)}}) AS best FROM s_cut{k} x JOIN s_ends y ON x.j <= y.j WHERE y.t - x.t <= (SELECT c FROM s_capacity) GROUP BY y.j, y.t)),"""
    return (
        out
        + f"""
s_best AS (SELECT cuts FROM s_cut{n} ORDER BY j DESC LIMIT 1),
s_numbered AS (SELECT text, row_number() OVER (ORDER BY first_id) AS j FROM s_groups),
s_of AS (SELECT text, len(list_filter(cuts[1 : {n - 1}], lambda c: c < j))::INTEGER AS shard, {_crc32("text")} AS text_crc32 FROM s_numbered, s_best),
sharded AS MATERIALIZED (SELECT doc_id, size, text_crc32, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot FROM s_docs JOIN s_of USING (text))"""
    )


def _span_rows(kind: int, pattern: str, group: int) -> str:
    """Rows r, kind, start, value, part and before (what lies between it and the match before) of a pattern's matches in x_docs."""
    quoted = pattern.replace("'", "''")
    return f"""SELECT r, {kind} AS kind, value, part, before, gap_sum + value_sum AS start FROM (
    SELECT r, unnest(m) AS value, unnest(g) AS part, unnest(s[1 : len(m)]) AS before, unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(s[1 : i], lambda x: length(x))))) AS gap_sum,
      unnest(list_transform(range(1, len(m) + 1), lambda i: coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0))) AS value_sum
    FROM (SELECT r, regexp_extract_all(text, '{quoted}') AS m, regexp_extract_all(text, '{quoted}', {group}) AS g, string_split_regex(text, '{quoted}') AS s FROM x_docs WHERE regexp_matches(text, '{quoted}')))"""


def secret_spans(docs: str) -> str:
    """WITH parts over docs (doc_id, text) that end in x_spans: r, kind (its number), start, end_."""
    w = secrets.WINDOW
    split = lambda v, p: f"list_zip(string_split_regex({v}, '{p}'), list_append(list_transform(regexp_extract_all({v}, '{p}'), lambda x: repeat('~', length(x))), ''))"
    masked_hex = f"array_to_string(list_transform({split('value', secrets.HEX)}, lambda x: x[1] || x[2]), '')"
    holder = secrets.PLACEHOLDER
    part = "[^=/_-]+"
    pieces = f"list_zip(string_split_regex(v, '{part}'), list_append(list_transform(regexp_extract_all(v, '{part}'), lambda x: CASE WHEN regexp_matches(x, '{holder}') THEN repeat('~', length(x)) ELSE x END), ''))"
    #: Places of one small letter between two capitals.
    odd = "len(list_filter(range(1, length(value) - 1), lambda i: regexp_matches(substr(value, i, 3), '^[A-Z][a-z][A-Z]$')))"
    word, number = "[A-Za-z]+", "[A-Za-z]{0,2}[0-9]{1,8}"
    words = "regexp_replace(value, '([a-z][a-z][a-z])[0-9][0-9]?[0-9]?([^0-9a-z]|$)', '\\1\\2', 'g')"
    bits = f"CASE WHEN NOT regexp_matches(x, '^([0-9a-f]+|[0-9A-F]+)$') THEN {secrets.BASE64_BITS} WHEN regexp_matches(x, '[0-9]') AND regexp_matches(x, '[a-fA-F]') THEN {secrets.HEX_BITS} ELSE 99 END"
    entropy = f"log2({float(w)}) - list_sum(list_transform(list_distinct(string_split(x, '')), lambda c: (length(x) - length(replace(x, c, ''))) * log2(length(x) - length(replace(x, c, ''))))) / {float(w)}"
    return f"""
x_docs AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, coalesce(text, '') AS text FROM {docs}),
x_base AS MATERIALIZED (SELECT r, kind, start, start + length(value) AS end_ FROM ({_span_rows(0, secrets.ASSIGN.replace('(?i:', '((?i)'), 2)} UNION ALL {_span_rows(1, secrets.ACCESS, 0)} UNION ALL {_span_rows(2, secrets.HEX, 0)}) WHERE length(part) >= CASE kind WHEN 0 THEN 6 WHEN 1 THEN 20 ELSE 24 END),
x_strings AS MATERIALIZED (SELECT r, start, whole AS value, row_number() OVER () AS id FROM (SELECT r, start, value AS whole, {words} AS value FROM ({_span_rows(3, secrets.CANDIDATE, 0)}) WHERE NOT ends_with(before, ';base64,')) WHERE NOT (
    regexp_matches(value, '^[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}$') OR regexp_matches(value, '^[^A-Za-z]*$')
    OR (({odd} < 2 OR NOT regexp_matches(value, '[A-Z][A-Z]')) AND (regexp_matches(value, '^[^0-9]*$') OR regexp_matches(value, '^({word}|{number})([-_/=+]({word}|{number}))+$'))))),
x_open AS MATERIALIZED (SELECT r, start, value, id, CASE WHEN regexp_matches(v, '{holder}') THEN array_to_string(list_transform({pieces}, lambda x: x[1] || x[2]), '') ELSE v END AS v FROM (SELECT *, {masked_hex} AS v FROM x_strings)),
x_windows AS (SELECT id, p FROM (SELECT id, p, substr(v, CAST(p AS BIGINT) + 1, {w}) AS x FROM (SELECT id, v, unnest(range(0, length(v) - {w} + 1)) AS p FROM x_open)) WHERE NOT contains(x, '~') AND {entropy} >= {bits}),
x_runs AS (SELECT id, p, sum(CASE WHEN p <= before + {w} THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY p) AS run FROM (SELECT id, p, lag(p) OVER (PARTITION BY id ORDER BY p) AS before FROM x_windows)),
x_added AS (SELECT r, CASE WHEN regexp_matches(substr(value, CAST(a AS BIGINT) + 1, CAST(b - a AS BIGINT)), '^([0-9a-f]+|[0-9A-F]+)$') THEN 3 ELSE 4 END AS kind, start + a AS start, start + b AS end_ FROM (SELECT id, min(p) AS a, max(p) + {w} AS b FROM x_runs GROUP BY id, run) JOIN x_open USING (id)),
x_all AS (SELECT *, max(end_) OVER (PARTITION BY r ORDER BY start, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, min(CASE WHEN kind < 3 THEN start END) OVER (PARTITION BY r ORDER BY start, kind ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM (SELECT * FROM x_base UNION ALL SELECT * FROM x_added)),
x_spans AS MATERIALIZED (SELECT r, kind, start, end_ FROM x_all WHERE kind < 3 OR NOT (coalesce(before, 0) > start OR coalesce(after, 2147483647) < end_))"""


_KIND = f"{secrets.KINDS!r}[kind + 1]"
_SHOWN = f"string_agg({_KIND} || ':' || CAST(start AS BIGINT) || ':' || CAST(end_ AS BIGINT), ',' ORDER BY start, kind)"

def prefix_trie(conversations: str) -> str:
    digest = "substr(sha256(length(role) || ':' || role || text), 1, 32)"
    return f"""WITH
t_own AS (SELECT conv_id, list({{'g': {digest}, 'w': len(regexp_extract_all(text, {WORD}))}} ORDER BY turn NULLS FIRST, {digest}) AS turns
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {conversations} WHERE conv_id IS NOT NULL) GROUP BY conv_id),
t_h AS (SELECT conv_id, turns, {_crc32("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM t_own),
t_new AS (SELECT c.conv_id, coalesce(b.turns, [])[1 : h] || c.turns[h + 1 :] AS turns FROM t_h c LEFT JOIN t_own b ON b.conv_id = c.conv_id - c.conv_id % 20),
t_at AS MATERIALIZED (SELECT conv_id, d, d = len(turns) AS ends, list_transform(turns[1 : d], lambda x: x.g) AS p, turns[d].w AS w FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM t_new)),
t_nodes AS MATERIALIZED (SELECT p, len(p) AS d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(any_value(w), 0) AS saved, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM t_at GROUP BY p),
t_children AS (SELECT p[1 : d - 1] AS p, count(*) AS n FROM t_nodes WHERE d > 0 GROUP BY 1),
t_sums AS (SELECT p[1 : a] AS p, sum(saved)::BIGINT AS saved, count(*) FILTER (leaf) AS leaves FROM (SELECT n.p, n.saved, c.n IS NULL AS leaf, unnest(range(0, n.d + 1)) AS a FROM t_nodes n LEFT JOIN t_children c ON n.p = c.p) GROUP BY 1)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, n.ends_sha256
FROM t_nodes n JOIN t_sums s ON n.p = s.p LEFT JOIN t_children c ON n.p = c.p LEFT JOIN t_nodes up ON n.d > 0 AND up.p = n.p[1 : n.d - 1]"""


ORACLES: dict[str, str] = {
    "op1_jaccard_join": f"WITH RECURSIVE {jaccard('documents')} SELECT doc_id, n_shingles, component_id FROM jaccard",
    "op2_mix_sources": f"WITH {mix('documents')} SELECT doc_id, size, source_size, target, e0 + e1 AS taken, CASE WHEN e0 > 0 THEN s0 END AS first_slot FROM mix",
    "op6_decontaminate": f"WITH {decontamination('documents')} SELECT doc_id, n_words, n_hit, n_items, sha256(items) AS items_sha256, {CONTAMINATED} AS contaminated FROM dirt",
    "op7_quality_rules": f"WITH {rules('documents')} SELECT * EXCLUDE (clean) FROM judged",
    "op8_sharding": f"WITH {shards('documents')} SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, slot, CAST(NULL AS INTEGER) AS grown_shard FROM sharded",
    "op10_secret_scan": f"""WITH {secret_spans('documents')} SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
        sha256(coalesce({_SHOWN.replace(')', ')', 1)} FILTER (kind < 3), '')) AS base_sha256, coalesce({_SHOWN}, '') AS spans FROM x_docs LEFT JOIN x_spans USING (r) GROUP BY r, doc_id""",
    "op13_prefix_trie": prefix_trie("conversations"),
}


def pipeline() -> str:
    """The rows of the corpus pipeline: each part reads what the part before it kept."""
    return f"""WITH RECURSIVE {rules("documents", "doc_id, source")},
p_good AS MATERIALIZED (SELECT doc_id, source, clean AS text FROM judged WHERE kept),{jaccard("p_good")},
p_first AS MATERIALIZED (SELECT p_good.* FROM p_good JOIN jaccard USING (doc_id) WHERE doc_id = component_id),{decontamination("p_first")},
p_clean AS MATERIALIZED (SELECT p_first.* FROM p_first JOIN dirt USING (doc_id) WHERE NOT ({CONTAMINATED})),{mix("p_clean")},
p_mixed AS MATERIALIZED (SELECT doc_id, text, unnest(range(0, (2 * e0 >= size)::BIGINT + (2 * e1 >= size)::BIGINT)) AS copy FROM p_clean JOIN mix USING (doc_id) WHERE size > 0),{shards("p_mixed")}
SELECT doc_id, size, text_crc32, shard, slot, 'bytes' AS law FROM sharded"""
