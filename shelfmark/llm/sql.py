"""The results of the operators that SQL can express, in DuckDB's SQL, written
the plain way from what the operators are to return."""

from __future__ import annotations

from pathlib import Path

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

QUALITY = r"""
    WITH d AS (
      SELECT row_number() OVER () AS uid, doc_id, source, coalesce(text, '') AS text FROM documents),
    parts AS (
      SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)),
                         lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
      FROM d),
    windows AS (
      SELECT uid, k, array_to_string(w[k:k + 4], ' ') AS win
      FROM (SELECT uid, w, unnest(range(1, len(w) - 3)) AS k FROM parts WHERE len(w) >= 5)),
    covered AS (
      SELECT uid, count(DISTINCT p) AS n_repeat_words
      FROM (SELECT uid, unnest(range(k, k + 5)) AS p
            FROM windows SEMI JOIN (SELECT uid, win FROM windows GROUP BY ALL HAVING count(*) > 1)
                 USING (uid, win))
      GROUP BY uid),
    q AS (
      SELECT uid, doc_id, source, len(w) AS n_words,
             coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines
      FROM parts LEFT JOIN covered USING (uid)),
    failed AS (
      SELECT *, n_words < 10 AS short, 100 * n_repeat_words > 20 * n_words AS repeats,
             2 * n_symbols > n_words AS symbols, 2 * n_dup_lines > n_lines AS dup_lines
      FROM q),
    hosts AS (
      SELECT source, rule, count(*)::double AS n, sum(fails::int)::double AS f
      FROM (UNPIVOT failed ON short, repeats, symbols, dup_lines INTO NAME rule VALUE fails)
      WHERE source IS NOT NULL GROUP BY source, rule),
    rates AS (
      SELECT rule, count(*) AS hosts, sum(n) AS n, sum(n * n) AS nn, sum(f) / sum(n) AS mean,
             sum(f * f / n) AS ff
      FROM hosts GROUP BY rule),
    spreads AS (
      SELECT *, (ff - n * mean * mean - (hosts - 1) * mean * (1 - mean)) / nullif(n - nn / n, 0) AS between_hosts
      FROM rates),
    priors AS (
      SELECT rule, mean,
             CASE WHEN hosts < 2 OR mean <= 0 OR mean >= 1 THEN n
                  WHEN between_hosts > 0
                  THEN greatest(1, least(n, mean * (1 - mean) / between_hosts - 1))
                  ELSE greatest(1, n) END AS strength
      FROM spreads),
    verdicts AS (
      SELECT source, bool_or((f + mean * strength) / (n + strength) > 0.5) AS rejected
      FROM hosts JOIN priors USING (rule) GROUP BY source)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           short OR repeats AS base_failed,
           NOT (short OR repeats) AND NOT coalesce(rejected, false) AS kept,
           coalesce(rejected, false) AS host_rejected
    FROM failed LEFT JOIN verdicts USING (source)"""

_WORDS = rf"""coalesce(regexp_extract_all({_FOLD.format("text")},
              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"""

CONTAMINATION = f"""
    WITH d AS (SELECT row_number() OVER () AS uid, doc_id, {_WORDS} AS w FROM documents),
    i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    item_windows AS (
      SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[k:k + 12], ' ') AS win
      FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS k FROM i WHERE len(w) > 0)),
    doc_windows AS (
      SELECT uid, k, size, array_to_string(w[k:k + size - 1], ' ') AS win
      FROM (SELECT uid, w, size, unnest(range(1, len(w) - size + 2)) AS k
            FROM d, (SELECT DISTINCT size FROM item_windows) WHERE len(w) >= size)),
    found AS (
      SELECT DISTINCT uid, k, size, win FROM doc_windows
      SEMI JOIN item_windows USING (size, win)),
    hit AS (
      SELECT uid, count(DISTINCT p) AS n_hit
      FROM (SELECT uid, unnest(range(k, k + size)) AS p FROM found) GROUP BY uid),
    held AS (
      SELECT uid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT uid, item_id::varchar AS item FROM found JOIN item_windows USING (size, win))
      GROUP BY uid)
    SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(items, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
    FROM d LEFT JOIN hit USING (uid) LEFT JOIN held USING (uid)"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_LICENCE_FILES = sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))
_KNOWN = ", ".join(f"({_quoted(f.stem)}, {_quoted(f.read_text(encoding='utf-8'))})" for f in _LICENCE_FILES)

# what an operator that knows licences by their whole texts is to find, written
# with words as lists and not as one string
LICENCES = (
    r"""
    WITH spelt AS (
      SELECT map {'licence': 'license', 'licences': 'licenses', 'licenced': 'licensed',
                  'licencee': 'licensee', 'licencees': 'licensees', 'licencing': 'licensing', 'sublicence': 'sublicense',
                  'acknowledgement': 'acknowledgment', 'acknowledgements': 'acknowledgments',
                  'authorisation': 'authorization', 'authorised': 'authorized',
                  'organisation': 'organization', 'organisations': 'organizations',
                  'favour': 'favor', 'favourable': 'favorable', 'honour': 'honor', 'honoured': 'honored',
                  'fulfilment': 'fulfillment', 'judgement': 'judgment', 'whilst': 'while',
                  'programme': 'program', 'programmes': 'programs', 'analogue': 'analog'} AS m),
    files(license, whole) AS (VALUES """
    + _KNOWN
    + r"""),
    cut AS (
      SELECT license, whole AS text FROM files
      UNION
      SELECT license, split_part(whole, 'END OF TERMS AND CONDITIONS', 1) || 'END OF TERMS AND CONDITIONS'
      FROM files WHERE contains(whole, 'END OF TERMS AND CONDITIONS')),
    headings(license, heading) AS (VALUES
      ('MIT', 'MIT License'), ('MIT', 'The MIT License (MIT)'), ('MIT', 'The MIT License'),
      ('ISC', 'ISC License'), ('0BSD', 'BSD Zero Clause License'), ('Zlib', 'zlib License'),
      ('BSD-2-Clause', 'BSD 2-Clause License'), ('BSD-3-Clause', 'BSD 3-Clause License')),
    known AS (
      SELECT license, text FROM cut
      UNION ALL SELECT license, heading || chr(10) || chr(10) || text FROM cut JOIN headings USING (license)),
    everything AS (
      SELECT row_number() OVER () AS uid, NULL AS license, doc_id, text FROM documents
      UNION ALL SELECT NULL, license, NULL, text FROM known),
    unnoticed AS (
      SELECT uid, license, doc_id,
             regexp_replace(
               regexp_replace(
                 regexp_replace(
                   lower(text),
                   'copyright[^\pL\pN]+(c[^\pL\pN]+)?(\d{4}[^\pL\pN]+)+free[^\pL\pN]+software[^\pL\pN]+foundation[^\pL\pN]+inc([^\pL\pN]+https[^\pL\pN]+fsf[^\pL\pN]+org)?', ' ', 'g'),
                 'all[^\pL\pN]+rights[^\pL\pN]+reserved', ' ', 'g'),
               '(?m)^[^\pL\n(]*(copyright[ \t]*(\(c\)|©)?|\(c\)|©)[ \t]*\d{4}[^\n]*$', ' ', 'g') AS text
      FROM everything),
    worded AS (
      SELECT uid, license, doc_id,
             ' ' || array_to_string(
               list_transform(regexp_extract_all(text, '[\pL\pN]+'), lambda w: coalesce(m[w], w)), '  ') || ' ' AS words,
             text IS NULL AS missing
      FROM unnoticed, spelt),
    plain AS (
      SELECT uid, license, doc_id, CASE WHEN NOT missing THEN
             trim(replace(replace(replace(replace(replace(replace(replace(words,
                  ' sub  license ', ' sublicense '),
                  ' merchantability  and  fitness ', ' merchantability  fitness '),
                  ' non  infringement ', ' noninfringement '), ' per  cent ', ' percent '),
                  ' copyright  owner ', ' copyright  holder '),
                  ' copyright  owners ', ' copyright  holders '), '  ', ' ')) END AS plain
      FROM worded),
    named AS (SELECT plain, min(license) AS license FROM plain WHERE uid IS NULL GROUP BY plain)
    SELECT doc_id, sha256(plain) AS canonical_sha256, length(plain) AS canonical_chars, named.license
    FROM plain LEFT JOIN named USING (plain) WHERE uid IS NOT NULL"""
)

LINES = rf"""
    WITH d AS (
      SELECT row_number() OVER () AS uid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines
      FROM documents),
    placed AS (SELECT uid, doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos FROM d),
    keyed AS (
      SELECT uid, doc_id, pos,
             {_FOLD.format(r"regexp_replace(lines[pos], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")}
             AS key, lines[pos] AS line FROM placed),
    shared AS (
      SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40
      GROUP BY key HAVING count(DISTINCT uid) >= 5),
    judged AS (
      SELECT uid, pos, line, shared.key IS NOT NULL AND doc_id IS DISTINCT FROM last AS dropped
      FROM keyed LEFT JOIN shared USING (key)),
    left_over AS (
      SELECT uid, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
             string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped) AS kept
      FROM judged GROUP BY uid)
    SELECT doc_id, n_lines, n_dropped, sha256(coalesce(kept, '')) AS kept_sha256
    FROM d JOIN left_over USING (uid)"""

INTERACTIONS = r"""
    WITH d AS (
      SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
             regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
      FROM documents),
    l AS (
      SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic
      FROM labels GROUP BY doc_id),
    m AS (
      SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             [len(w) < 200,
              100 * len(list_distinct(w)) < 50 * len(w),
              100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
              regexp_matches(text, '[#$%&*|]'),
              coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails
      FROM d LEFT JOIN l USING (doc_id)),
    n AS (
      SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good,
             count(*) FILTER (toxic) AS n_toxic
      FROM m GROUP BY ALL),
    f AS (SELECT unnest([1, 2, 3, 4, 5]) AS f),
    orders AS (
      SELECT [a.f, b.f, c.f, d.f, e.f] AS o
      FROM f a JOIN f b ON b.f <> a.f JOIN f c ON c.f NOT IN (a.f, b.f)
      JOIN f d ON d.f NOT IN (a.f, b.f, c.f) JOIN f e ON e.f NOT IN (a.f, b.f, c.f, d.f)),
    steps AS (SELECT o, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
    outcomes AS (
      SELECT part, o, step, n, n_good, n_toxic, fails[o[step]] AS fails_here,
             list_bool_or(list_transform(o[1:step - 1], lambda x: fails[x])) AS gone,
             len(list_filter(fails, lambda x: x)) AS n_fails
      FROM n, steps),
    counted AS (
      SELECT part, o, step,
             coalesce(sum(n) FILTER (NOT fails_here AND NOT coalesce(gone, false)), 0)::bigint AS kept,
             coalesce(sum(n) FILTER (fails_here AND NOT coalesce(gone, false)), 0)::bigint AS removed,
             coalesce(sum(n) FILTER (fails_here AND gone), 0)::bigint AS redundant,
             coalesce(sum(n) FILTER (fails_here AND n_fails = 1), 0)::bigint AS unique_fails,
             coalesce(sum(n_good) FILTER (fails_here AND NOT coalesce(gone, false)), 0)::bigint AS good_lost,
             coalesce(sum(n_toxic) FILTER (fails_here AND NOT coalesce(gone, false)), 0)::bigint AS toxic_lost
      FROM outcomes GROUP BY ALL)
    SELECT part, array_to_string(list_transform(o, lambda x: substr('ABCDE', x, 1)), '') AS filter_order,
           step::integer AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           (sum(removed) OVER (PARTITION BY part, o[step]))::bigint AS shapley
    FROM counted"""

TRIE = """
    WITH t AS (
      SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id
                                ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
      FROM conversations),
    -- a turn as text that tells it from any other, and the bytes of its own
    own AS (
      SELECT conv_id, list({'id': sha256(length(role) || ' ' || role || text), 'bytes': strlen(text)}
                           ORDER BY k) AS turns
      FROM t GROUP BY conv_id),
    h AS (
      SELECT *, xor(list_reduce(
                  list_prepend(4294967295::bigint,
                               list_transform(range(1, length(conv_id::varchar) + 1),
                                              lambda i: ascii((conv_id::varchar)[i])::bigint)),
                  lambda c, x: list_reduce(
                    list_prepend(xor(c, x), [0::bigint, 0, 0, 0, 0, 0, 0, 0]),
                    lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295) % 9 AS h
      FROM own),
    rebuilt AS (
      SELECT h.conv_id, list_concat(coalesce(base.turns, [])[1:h.h], h.turns[h.h + 1:]) AS turns
      FROM h LEFT JOIN own base ON base.conv_id = h.conv_id - h.conv_id % 5),
    steps AS (
      SELECT conv_id, len(turns) AS n, unnest(range(0, len(turns) + 1)) AS depth, turns FROM rebuilt),
    paths AS (
      SELECT conv_id, n, depth, turns[depth].bytes AS bytes,
             sha256(array_to_string(list_transform(turns[1:depth], lambda x: x.id), ' ')) AS node
      FROM steps),
    nodes AS (
      SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes,
             coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (n = depth), '') AS ends
      FROM paths GROUP BY node, depth),
    -- every node with each of those above it, which its smallest member passes
    pairs AS (
      SELECT up.node AS above, x.node, x.depth - up.depth AS distance, x.conv_id, x.n_convs, x.bytes
      FROM nodes x JOIN paths up ON up.conv_id = x.conv_id AND up.depth <= x.depth),
    children AS (SELECT above AS node, count(*) AS n FROM pairs WHERE distance = 1 GROUP BY above),
    below AS (
      SELECT above AS node, count(*) FILTER (children.n IS NULL) AS n_leaves,
             sum((n_convs - 1) * coalesce(bytes, 0)) AS saved
      FROM pairs LEFT JOIN children USING (node) GROUP BY above),
    parents AS (
      SELECT pairs.node, nodes.conv_id FROM pairs JOIN nodes ON nodes.node = above WHERE distance = 1)
    SELECT nodes.conv_id, nodes.depth, parents.conv_id AS parent_conv_id, n_convs,
           coalesce(children.n, 0) AS n_children, n_leaves, saved::bigint AS saved_tokens,
           sha256(ends) AS ends_sha256
    FROM nodes JOIN below USING (node) LEFT JOIN children USING (node) LEFT JOIN parents USING (node)"""

SQL: dict[str, str] = {
    "op1_host_quality": QUALITY,
    "op5_benchmark_decontamination": CONTAMINATION,
    "op9_licence_scan": LICENCES,
    "op11_conversation_trie": TRIE,
    "op12_line_dedup": LINES,
    "op13_filter_interactions": INTERACTIONS,
}
