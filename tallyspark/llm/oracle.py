"""DuckDB SQL of the operators that SQL can express.

Written apart from the operators: patterns and constants stand in the SQL.
"""

from __future__ import annotations

_HEAD = "[A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
_LINE = r"(?:\s|\\[nr])"
#: Up to the END line with no five dashes before it; else over header lines, base64 lines, a short one that ends its line, a checksum.
#: This kind of expression can't look ahead, so it takes in the break after a short line (cut off again below).
_PRIVATE_KEY = (
    f"-----BEGIN {_HEAD}(?:(?:[^-]|-[^-]|--[^-]|---[^-]|----[^-])*-----END {_HEAD}"
    rf"|(?:{_LINE}*[A-Za-z-]+:\x20[^\r\n\\]*)*(?:{_LINE}*[A-Za-z0-9+/=]{{20,}})*"
    rf"(?:{_LINE}+[A-Za-z0-9+/]+={{0,2}}[\x20\t]*(?:(?:[\r\n]|\\[nr])(?:{_LINE}*=[A-Za-z0-9+/]{{4}})?|\z)|{_LINE}+=[A-Za-z0-9+/]{{4}})?)")

_AFTER_LINE = r"[\x20\t]*(?:[\r\n]|\\[nr])$"

#: kind, pattern, group, least length of the group.
_SECRETS = [
    ("assign", """([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?[ ]*[:=][ ]*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", "AKIA[A-Z0-9]+", 0, 16),
    ("hex", "[0-9a-f]{32,}", 0, 32),
    ("private_key", _PRIVATE_KEY, 0, 0),
    ("code_host", "gh[opsur]_[A-Za-z0-9]{36,}", 0, 0),
    ("chat_app", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+", 0, 0),
    ("url_login", r"[a-z][a-z0-9+.-]{0,20}://[^\s/:@]+:[^\s/:@]+@", 0, 0),
]


def _secrets() -> str:
    one = " UNION ALL ".join(
        f"SELECT n, {k} AS rank, '{kind}' AS kind, regexp_extract_all(t, '{p}') AS found, "
        f"regexp_extract_all(t, '{p}', {g}) AS part, string_split_regex(t, '{p}') AS gap, {least} AS least FROM d"
        for k, (kind, p, g, least) in enumerate(_SECRETS))
    return f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
m AS ({one}),
i AS (SELECT *, unnest(range(1, len(found) + 1)) AS k FROM m),
s AS (SELECT n, rank, kind, length(part[k]) >= least AS kept,
             length(CASE WHEN kind = 'private_key' THEN regexp_replace(found[k], '{_AFTER_LINE}', '') ELSE found[k] END) AS size,
             list_sum(list_transform(gap[1:k], lambda x: length(x)))
             + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: length(x))), 0) AS start FROM i),
a AS (SELECT n,
        count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
        count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT, ',' ORDER BY start, rank)
          FILTER (rank < 3) AS base,
        string_agg(kind || ':' || start::BIGINT || ':' || (start + size)::BIGINT, ',' ORDER BY start, rank) AS spans
      FROM s WHERE kept GROUP BY n)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
       coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (n)"""


_UNITS = ("mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams ton tons ounce ounces pound pounds lb lbs "
          "ml l liter liters litre litres second seconds s minute minutes min hour hours h day days week weeks month months year "
          "years cent cents dollar dollars euro euros percent degree degrees mph kmh").split()
_MARKS = """'.,;:!?"'')]}'"""


def _leaks() -> str:
    units = ", ".join(f"'{u}'" for u in _UNITS)

    def tokens(source: str, key: str) -> str:
        return f"""
SELECT *, list_transform(range(1, len(raw) + 1), lambda i: CASE
    WHEN low[i] < ':' AND low[i] >= '0' THEN '<num>'
    WHEN i > 1 AND raw[i] < '[' AND raw[i] >= 'A' AND raw[i] <> upper(raw[i]) AND right(raw[i - 1], 1) NOT IN ('.', '!', '?') THEN '<name>'
    WHEN i > 1 AND raw[i - 1] < ':' AND raw[i - 1] >= '0' AND list_contains([{units}], rtrim(low[i], {_MARKS})) THEN '<unit>'
    ELSE rtrim(low[i], {_MARKS}) END) AS kinds
FROM (SELECT {key}, list_filter(string_split(t, ' '), lambda x: x <> '') AS raw,
             list_filter(string_split(lower(t), ' '), lambda x: x <> '') AS low
      FROM (SELECT DISTINCT {key}, translate(coalesce(text, ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '     ') AS t
            FROM {source}))"""
    return f"""
WITH b AS (SELECT item_id, row_number() OVER () AS b, raw, kinds, least(8, len(kinds)) AS size
           FROM ({tokens('benchmark', 'item_id')}) WHERE len(kinds) >= 4),
bp AS (SELECT *, unnest(range(1, len(kinds) - size + 2)) AS p FROM b),
bw AS (SELECT item_id, b, p, size, raw[p:p + size - 1] AS raw, kinds[p:p + size - 1] AS kinds FROM bp),
bk AS (SELECT *, count(*) OVER (PARTITION BY b) AS n FROM bw WHERE len(list_filter(kinds, lambda x: NOT starts_with(x, '<'))) >= 4),
d AS (SELECT doc_id, row_number() OVER () AS d, raw, kinds FROM ({tokens('documents', 'doc_id')})),
dp AS (SELECT d.*, s.size, unnest(range(1, len(kinds) - s.size + 2)) AS p FROM d, (SELECT DISTINCT size FROM bk) s),
dw AS (SELECT doc_id, d, p, raw[p:p + size - 1] AS raw, kinds[p:p + size - 1] AS kinds FROM dp),
m AS (SELECT doc_id, item_id, b, n, bk.p AS place, dw.p - bk.p AS diagonal, bk.kinds AS kinds, bk.raw AS iraw, dw.raw AS draw
      FROM dw JOIN bk ON dw.kinds = bk.kinds),
v AS (SELECT *, list_filter(list_transform(range(1, len(kinds) + 1), lambda i: {{'slot': starts_with(kinds[i], '<'),
        'item': rtrim(iraw[i], {_MARKS}), 'doc': rtrim(draw[i], {_MARKS})}}), lambda x: x.slot) AS slots FROM m),
l AS (SELECT doc_id, item_id, b, n, diagonal, list(DISTINCT place) AS places, list_distinct(flatten(list(slots))) AS pairs
      FROM v GROUP BY ALL),
c AS (SELECT *, len(list_filter(pairs, lambda x: x.item <> x.doc)) > 0 AS changed FROM l
      WHERE len(list_distinct(list_transform(pairs, lambda x: x.item))) = len(pairs)),
w AS (SELECT doc_id, item_id, b, n, count(DISTINCT place) AS k, NOT bool_or(changed) AS same_values
      FROM (SELECT doc_id, item_id, b, n, changed, unnest(places) AS place FROM c) GROUP BY ALL)
SELECT doc_id, item_id, arg_max(n, k / n)::BIGINT AS n_windows, arg_max(k, k / n)::BIGINT AS n_matched,
       round(max(k / n), 6) AS coverage, bool_or(same_values) AS same_values
FROM w WHERE k / n >= 0.5 GROUP BY doc_id, item_id"""


_CHAT = r"""
WITH c AS (SELECT conv_id, turn, role, text, coalesce(role, '') AS r, coalesce(text, '') AS t FROM (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')),
n AS (SELECT *, row_number() OVER w AS k, lag(r) OVER w AS before,
        length(t) + len(regexp_extract_all(t, '\\|###|:|</turn>')) + length(r) + len(regexp_extract_all(r, '\\|###|:|</turn>'))
        + length('### : </turn>') + 1 AS chars
      FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(t)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY k) FILTER (r = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars,
       bool_and(CASE r WHEN 'system' THEN k = 1 WHEN 'user' THEN k = 1 OR before IN ('system', 'assistant', 'tool')
                       WHEN 'assistant' THEN k > 1 AND before IN ('user', 'tool')
                       WHEN 'tool' THEN k > 1 AND before = 'assistant' ELSE false END) AS order_ok
FROM n GROUP BY conv_id"""


#: Unsigned crc32 of a decimal number, bit by bit (3988292384 is the reflected polynomial).
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)))"""

_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR END"


def _merkle() -> str:
    own = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    changed = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", low))
    return f"""
WITH RECURSIVE f AS (SELECT doc_id, lang, sha256({own}) AS leaf,
                            CASE WHEN {_CRC.format('doc_id')} % 3 = 0 THEN sha256({changed}) END AS changed FROM documents),
l AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
             row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM f),
t AS (SELECT 0 AS lev, tree, pos, n, leaf AS h FROM l
      UNION ALL
      SELECT lev + 1, tree, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY lev, tree, pos // 8, n),
s AS (SELECT 0 AS lev, tree AS pos, count(*) OVER () AS n, h FROM t WHERE n = 1
      UNION ALL
      SELECT lev + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM s WHERE n > 1 GROUP BY lev, pos // 8, n),
u AS (SELECT 0 AS up, lev, tree, pos, n, h FROM t UNION ALL SELECT 1, lev, 0, pos, n, h FROM s),
g AS (SELECT a.up, a.lev, a.tree, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS lft,
             coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS rgt
      FROM u a JOIN u b ON a.up = b.up AND a.lev = b.lev AND a.tree = b.tree AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY a.up, a.lev, a.tree, a.pos),
p AS (SELECT l.doc_id, l.leaf, l.tree, l.pos, coalesce(changed, leaf) AS start, list({{'a': g.lft, 'b': g.rgt}} ORDER BY g.up, g.lev) FILTER (g.lev IS NOT NULL) AS path
      FROM l LEFT JOIN g ON (g.up = 0 AND g.tree = l.tree AND g.pos = l.pos // (8 ** g.lev)::BIGINT) OR (g.up = 1 AND g.pos = l.tree // (8 ** g.lev)::BIGINT)
      GROUP BY l.doc_id, l.leaf, l.tree, l.pos, start),
o AS (SELECT doc_id, leaf, (SELECT h FROM t WHERE n = 1 AND t.tree = p.tree) AS subroot, (SELECT h FROM s WHERE n = 1) AS root,
             sha256(coalesce(list_aggregate(list_transform(path, lambda x: x.a || x.b), 'string_agg', ''), '')) AS proof_sha256,
             list_reduce(list_prepend({{'a': start, 'b': ''}}, coalesce(path, [])), lambda h, x: {{'a': sha256(x.a || h.a || x.b), 'b': ''}}).a AS folded_root FROM p)
SELECT *, folded_root = root AS verified FROM o"""


_REPEATS = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT r, unnest(range(1, len(w) - 33)) AS i, w FROM d WHERE len(w) >= 35),
h AS (SELECT r, i, sha256(array_to_string(w[i:i + 34], ' ')) AS h FROM p),
s AS (SELECT r, i FROM h WHERE h IN (SELECT h FROM h GROUP BY h HAVING count(*) > 1)),
v AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS k FROM s),
k AS (SELECT d.r, x.k, w[x.k] AS word FROM d, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS k) x),
a AS (SELECT k.r, count(v.k) AS n_removed, string_agg(word, ' ' ORDER BY k.k) FILTER (v.k IS NULL) AS kept
      FROM k LEFT JOIN v ON k.r = v.r AND k.k = v.k GROUP BY k.r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN a USING (r)"""


_TRIE = rf"""
WITH o AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS t, turn FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, r, t, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, sha256(strlen(r)::VARCHAR || ':' || r || t)) AS k FROM o),
h AS (SELECT c, c - c % 20 AS base, {_CRC.format('c')} % 4 AS h FROM (SELECT DISTINCT c FROM n)),
x AS (SELECT h.c, 0 AS part, k, r, t FROM h JOIN n ON n.c = h.base AND n.k <= h.h UNION ALL SELECT n.c, 1, k, r, t FROM n JOIN h USING (c) WHERE k > h.h),
s AS (SELECT c, r, t, row_number() OVER (PARTITION BY c ORDER BY part, k) AS d FROM x),
l AS (SELECT h.c, coalesce(max(d), 0) AS len FROM h LEFT JOIN s USING (c) GROUP BY h.c),
p AS (SELECT c, 0 AS d, sha256('') AS name, 0 AS w FROM h
      UNION ALL SELECT c, d, sha256(string_agg(strlen(r)::VARCHAR || ':' || r || strlen(t)::VARCHAR || ':' || t, '') OVER (PARTITION BY c ORDER BY d)),
                       len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) FROM s),
m AS (SELECT name, any_value(d) AS d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS own,
             sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = len), '')) AS ends_sha256 FROM p JOIN l USING (c) GROUP BY name),
u AS (SELECT m.name, a.name AS parent FROM m JOIN p a ON a.c = m.conv_id AND a.d = m.d - 1),
k AS (SELECT parent AS name, count(*) AS n_children FROM u GROUP BY parent),
b AS (SELECT a.name, sum(own) AS saved, count(*) FILTER (k.name IS NULL) AS n_leaves
      FROM m JOIN p a ON a.c = m.conv_id AND a.d <= m.d LEFT JOIN k ON k.name = m.name GROUP BY a.name)
SELECT m.conv_id, m.d::BIGINT AS depth, q.conv_id AS parent_conv_id, m.n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
       n_leaves, saved::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN b USING (name) LEFT JOIN k USING (name) LEFT JOIN u USING (name) LEFT JOIN m q ON q.name = u.parent"""


def oracle_sql() -> dict[str, str]:
    return {"op1_secrets": _secrets(), "op8_chat": _CHAT, "op10_decontamination": _leaks(), "op11_merkle": _merkle(),
            "op12_substring_dedup": _REPEATS, "op13_prefix_trie": _TRIE}
