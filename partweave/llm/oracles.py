"""DuckDB SQL of the operators that SQL can express."""

OP5 = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM d WHERE len(words) >= 3),
g AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS tri FROM w),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, tri) AS n FROM g),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
  SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep WHERE n >= 2) GROUP BY doc_id),
l AS (SELECT doc_id, host, unnest(lines) AS line FROM d),
n AS (SELECT doc_id, host,
         regexp_replace(lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'), ' ')), '[0-9]', '0', 'g') AS norm,
         len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS nw
      FROM l),
h AS (SELECT host, count(*) AS host_docs FROM d GROUP BY host),
f AS (SELECT host, norm FROM n JOIN h USING (host) GROUP BY host, norm, host_docs
      HAVING count(DISTINCT doc_id) > 20 AND count(DISTINCT doc_id) > host_docs * 0.1),
lost AS (SELECT doc_id, sum(nw) AS nw FROM n JOIN f USING (host, norm) GROUP BY doc_id),
b AS (SELECT doc_id, len(words)::BIGINT AS n_words,
         length(array_to_string(words, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
         coalesce(lost.nw, 0)::BIGINT AS n_removed_words
  FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_removed_words,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
         AND n_words - n_removed_words >= n_words * 0.5 AS kept
FROM b
"""

OP9 = r"""
WITH c AS (
  SELECT page_id, url, coalesce(lower(regexp_extract(coalesce(url, ''),
           '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+?)\.?(?::[0-9]*)?(?:[/?#]|$)', 1)), '') AS host,
         coalesce(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '') AS path,
         TIMESTAMP '2024-01-01' + to_days((page_id % 360)::INTEGER) AS fetched_at
  FROM pages),
s AS (SELECT *, string_split(host, '.') AS labels, list_filter(string_split(path, '/'), lambda x: x <> '') AS segs FROM c),
k AS (
  SELECT DISTINCT page_id, fetched_at, unnest(list_concat(
    list_transform(range(1, len(labels) + 1), lambda i: 'domain:' || array_to_string(labels[i:], '.')),
    list_transform(range(1, len(segs) + 1), lambda i: 'path:' || host || '/' || array_to_string(segs[1:i], '/')))) AS key
  FROM s WHERE host <> ''),
src AS (SELECT DISTINCT key, (strpos('0123456789abcdef', substr(md5(key), 1, 1)) - 1) AS a,
               (strpos('0123456789abcdef', substr(md5(key), 2, 1)) - 1) AS b
        FROM k WHERE key LIKE 'domain:%.%.%' OR key LIKE 'path:%'),
ev AS (
  SELECT CASE WHEN b % 4 = 0 THEN 'reviewed' ELSE 'abuse' END AS list_id, key, 'add' AS action,
         TIMESTAMP '2023-12-01' + to_days((b * 20)::INTEGER) AS t_at FROM src WHERE a % 4 = 0
  UNION ALL
  SELECT 'abuse', key, 'add', TIMESTAMP '2024-02-01' FROM src
   WHERE key LIKE 'domain:%' AND regexp_matches(key, 'cheap-pills|spam-farm|free-bets|ads-track')
  UNION ALL
  SELECT CASE WHEN b % 4 = 0 THEN 'reviewed' ELSE 'abuse' END, key, 'remove',
         TIMESTAMP '2023-12-01' + to_days((b * 20 + 60)::INTEGER) FROM src WHERE a % 4 = 0 AND a >= 8),
o AS (SELECT *, lag(action) OVER (PARTITION BY list_id, key ORDER BY t_at, action) AS prev FROM ev),
r AS (SELECT *, coalesce(lead(t_at) OVER (PARTITION BY list_id, key ORDER BY t_at, action), TIMESTAMP '9999-12-31') AS valid_to
      FROM o WHERE prev IS NULL OR prev <> action),
v AS (SELECT list_id, key, t_at AS valid_from, valid_to FROM r WHERE action = 'add' AND t_at < valid_to),
hit AS (SELECT page_id,
          list_sort(list(DISTINCT v.list_id || '|' || k.key) FILTER (v.list_id = 'abuse')) AS bl,
          list_sort(list(DISTINCT v.list_id || '|' || k.key) FILTER (v.list_id = 'reviewed')) AS al
        FROM k JOIN v ON k.key = v.key AND k.fetched_at >= valid_from AND k.fetched_at < valid_to GROUP BY page_id)
SELECT c.page_id, c.url, c.fetched_at, c.host,
       coalesce(array_to_string(bl, ','), '') AS blocked_by, coalesce(array_to_string(al, ','), '') AS allowed_by,
       coalesce(array_to_string(bl, ','), '') = '' OR coalesce(array_to_string(al, ','), '') <> '' AS allowed
FROM c LEFT JOIN hit USING (page_id)
"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP2 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws
               ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k, any_value(x.n) AS na, any_value(y.n) AS nb
      FROM u x JOIN u y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p WHERE 100 * k >= 80 * (na + nb - k)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reach = l.a)
SELECT s.doc_id, len(any_value(sh))::BIGINT AS n_shingles, min(reach) AS component_id, s.doc_id = min(reach) AS kept
FROM s JOIN r ON s.doc_id = r.doc_id GROUP BY s.doc_id
"""


OP13 = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{_UPPER}', '{_LOWER}') AS key FROM l),
r AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (first <> doc_id))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (first IS NULL OR first = doc_id), '')) AS kept_sha256
FROM k LEFT JOIN r USING (key) GROUP BY doc_id
"""


def _spans(name: str, pattern: str, group: int) -> str:
    """CTE (doc_id, s, e, v, g): matches with code-point positions, from the lengths of the pieces between them."""
    return rf"""{name} AS (
  SELECT doc_id, (s + before)::BIGINT AS s, (s + before + length(v))::BIGINT AS e, v, g FROM (
    SELECT doc_id, v, g, sum(length(gap)) OVER (PARTITION BY doc_id ORDER BY i) AS s,
           coalesce(sum(length(v)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM (SELECT doc_id, unnest(range(1, len(vs) + 1)) AS i, unnest(vs) AS v, unnest(gs) AS g, unnest(pieces[1:len(vs)]) AS gap
          FROM (SELECT doc_id, regexp_extract_all(text, {pattern}, 0) AS vs, regexp_extract_all(text, {pattern}, {group}) AS gs,
                       regexp_split_to_array(text, {pattern}) AS pieces FROM d))))"""


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEYS = "|".join(_either(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either("api") + "_?" + _either("key")
_ASSIGN = rf"""'({_KEYS})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'"""
_B64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_TAIL = ("((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t}")


def _upper_tail(z: str) -> str:
    t = f"(1.0 / (1.0 + 0.3275911 * abs({z}) / sqrt(2.0)))"
    half = f"(0.5 * {_TAIL.format(t=t)} * exp(-({z}) * ({z}) / 2.0))"
    return f"(CASE WHEN ({z}) >= 0 THEN {half} ELSE 1.0 - {half} END)"


OP6 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
{_spans("a0", _ASSIGN, 2)},
{_spans("a1", "'AKIA[A-Z0-9]{16,}'", 0)},
{_spans("a2", "'[0-9a-f]{24,}'", 0)},
{_spans("a3", "'[A-Za-z0-9+/_-]{20,}=*'", 0)},
base AS (SELECT doc_id, s, e, 0 AS rank, 'assign' AS kind FROM a0 WHERE length(g) >= 6
  UNION ALL SELECT doc_id, s, e, 1, 'access' FROM a1 UNION ALL SELECT doc_id, s, e, 2, 'hex' FROM a2),
enc AS (SELECT *, CASE
    WHEN regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-fA-F]') AND (regexp_full_match(v, '[0-9a-f]+') OR regexp_full_match(v, '[0-9A-F]+')) THEN 'hex'
    WHEN regexp_matches(v, '[2-7]') AND regexp_matches(v, '[A-Z]') AND regexp_full_match(v, '[A-Z2-7]+=*') THEN 'base32'
    WHEN regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[a-z]') AND regexp_full_match(v, '[A-Za-z0-9+/_-]+=*') THEN 'base64'
    END AS enc FROM a3),
tok AS (SELECT doc_id, s, e, CASE enc WHEN 'hex' THEN '0123456789abcdef' WHEN 'base32' THEN '{_UPPER}234567' ELSE '{_B64}' END AS alpha,
    CASE WHEN enc = 'hex' THEN lower(rtrim(v, '=')) ELSE translate(rtrim(v, '='), '-_', '+/') END AS plain FROM enc WHERE enc IS NOT NULL),
sym AS (SELECT *, length(plain)::DOUBLE AS n, length(alpha)::DOUBLE AS size,
    list_transform(string_split(plain, ''), lambda c: strpos(alpha, c)::DOUBLE - 1) AS x FROM tok WHERE length(plain) >= 20),
st AS (SELECT *, list_sum(x) / n AS mean, list_transform(x, lambda y: CASE WHEN y >= size / 2 THEN 1 ELSE 0 END) AS high FROM sym),
st2 AS (SELECT *, list_transform(x, lambda y: y - mean) AS dev, list_sum(high)::DOUBLE AS n1, n - list_sum(high) AS n0,
    list_sum(list_transform(list_distinct(string_split(plain, '')), lambda c: pow(n - length(replace(plain, c, '')), 2.0))) AS sq FROM st),
st3 AS (SELECT *, greatest(size / n * sq - n, 0.0) AS chi, size - 1 AS df,
    1.0 + list_sum(list_transform(range(1, len(high)), lambda i: CASE WHEN high[i] <> high[i + 1] THEN 1 ELSE 0 END)) AS runs,
    2.0 * n1 * n0 / n + 1.0 AS expected,
    list_sum(list_transform(range(1, len(dev)), lambda i: dev[i] * dev[i + 1])) / nullif(list_sum(list_transform(dev, lambda y: y * y)), 0) AS r FROM st2),
zs AS (SELECT *, (pow(chi / df, 1.0 / 3.0) - (1.0 - 2.0 / (9.0 * df))) / sqrt(2.0 / (9.0 * df)) AS z1,
    CASE WHEN n1 > 0 AND n0 > 0 THEN abs((runs - expected) / sqrt((expected - 1.0) * (expected - 2.0) / (n - 1.0))) END AS z2,
    abs((coalesce(r, 1.0) + 1.0 / n) * sqrt(n)) AS z3 FROM st3),
ps AS (SELECT *, {_upper_tail("z1")} AS p1, CASE WHEN z2 IS NULL THEN 0.0 ELSE least(1.0, 2.0 * {_upper_tail("z2")}) END AS p2,
    least(1.0, 2.0 * {_upper_tail("z3")}) AS p3 FROM zs),
f AS (SELECT doc_id, s, e, n, -(ln(greatest(p1, 1e-15)) + ln(greatest(p2, 1e-15)) + ln(greatest(p3, 1e-15))) AS f FROM ps),
b AS (SELECT doc_id, s, e, CASE WHEN n >= 96 THEN 96 WHEN n >= 48 THEN 48 WHEN n >= 32 THEN 32 ELSE 20 END AS cls,
    greatest(0, 399 - floor(-10.0 * ln(greatest(exp(-f) * (1.0 + f + f * f / 2.0), 1e-300))))::INTEGER AS bin FROM f),
h AS (SELECT cls, bin, count(*) AS n FROM b GROUP BY cls, bin),
cum AS (SELECT cls, bin, sum(n) OVER (PARTITION BY cls ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY cls) AS m FROM h),
lim AS (SELECT cls, coalesce(max(bin) FILTER (exp(-(399 - bin) / 10.0) * m <= 0.05 * upto), -1) AS lim FROM cum GROUP BY cls),
extra AS (SELECT b.doc_id, b.s, b.e, 3 AS rank, 'random' AS kind FROM b JOIN lim USING (cls) WHERE bin > lim
  AND NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = b.doc_id AND base.s < b.e AND b.s < base.e)),
bt AS (SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, e, rank) AS t, count(*) FILTER (kind = 'assign') AS n0,
    count(*) FILTER (kind = 'access') AS n1, count(*) FILTER (kind = 'hex') AS n2,
    sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank), '')) AS h FROM base GROUP BY doc_id),
et AS (SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, e, rank) AS t FROM (
    SELECT * FROM base UNION ALL SELECT * FROM extra) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex,
       coalesce(bt.h, sha256('')) AS base_sha256, coalesce(et.t, '') AS spans
FROM d LEFT JOIN bt USING (doc_id) LEFT JOIN et USING (doc_id)
"""
