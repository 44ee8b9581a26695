"""DuckDB SQL for the queries that SQL can express."""

_DOC_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = rf"""
WITH d AS (SELECT doc_id, {_DOC_WORDS} AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 19], ' ')) AS h FROM s),
late AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min((doc_id, i)) OVER (PARTITION BY h) AS f FROM g) WHERE (doc_id, i) > f
),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM late, range(0, 20) r(k)),
kept AS (
  SELECT d.doc_id, list(x.word ORDER BY x.p) AS k
  FROM d, LATERAL (SELECT unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p) x
  ANTI JOIN gone ON gone.doc_id = d.doc_id AND gone.p = x.p
  GROUP BY d.doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(len(k), 0))::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz"
_PLAIN_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP6 = rf"""
WITH d AS (SELECT doc_id, {_PLAIN_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_PLAIN_WORDS} AS w FROM benchmark),
q AS (
  SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT n FROM q),
s AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
),
h AS (SELECT s.doc_id, s.i, s.n, q.item FROM s JOIN q ON s.g = q.g AND s.n = q.n),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM h, range(0, 13) r(k) WHERE k < n GROUP BY doc_id),
t AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS x
  FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(x, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op1_substring_dedup": OP1, "op6_decontam": OP6}


# --- op3: budgets flow down the tree by water filling, then a prefix of each leaf's seeded order ----------------

_MIX_WEIGHTS = (
    ("domain", "CASE domain WHEN 'web' THEN 0.45 WHEN 'books' THEN 0.25 WHEN 'code' THEN 0.2 WHEN 'forum' THEN 0.1 ELSE 0.05 END"),
    ("lang", "CASE lang WHEN 'en' THEN 0.55 WHEN 'de' THEN 0.15 WHEN 'fr' THEN 0.15 WHEN 'es' THEN 0.15 ELSE 0.1 END"),
    ("source", "1.0"),
)


def _filled(depth: int) -> str:
    """Budgets of the nodes of a level: capacity if the water level reaches it, else weight times the level of the first that it does not."""
    names = [n for n, _ in _MIX_WEIGHTS[: depth + 1]]
    above, name = names[:-1], names[-1]
    of = f"PARTITION BY {', '.join(above)} " if above else ""
    order = f"{of}ORDER BY cap / w, {name}"
    join = f"JOIN level{depth - 1} p USING ({', '.join(above)})" if above else ", total p"
    return f"""
nodes{depth} AS (SELECT {', '.join(names)}, sum(2.0 * tokens) AS cap, CAST({_MIX_WEIGHTS[depth][1]} AS DOUBLE) AS w FROM leaves GROUP BY {', '.join(names)}),
water{depth} AS (
  SELECT n.*, (p.budget - coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM nodes{depth} n {join}
),
level{depth} AS (
  SELECT {', '.join(names)}, CASE WHEN lvl >= cap / w THEN cap ELSE w * first(CASE WHEN lvl < cap / w THEN lvl END IGNORE NULLS)
         OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS budget
  FROM water{depth}
)"""


OP3 = rf"""
WITH d AS (
  SELECT doc_id, lang, source, CAST(len({_DOC_WORDS}) AS BIGINT) AS n_tokens,
         CASE WHEN regexp_matches(source, '[0-9]{{1,9}}$') THEN (['web', 'books', 'code', 'forum'])[CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INT) % 4 + 1] ELSE 'other' END AS domain
  FROM documents
),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM d GROUP BY ALL),
total AS (SELECT floor(sum(tokens) * CAST(0.6 AS DOUBLE)) AS budget FROM leaves),
{_filled(0)}, {_filled(1)}, {_filled(2)},
plan AS (
  SELECT l.*, CAST(floor(b.budget) AS BIGINT) AS b, least(CASE WHEN tokens > 0 THEN CAST(floor(b.budget) AS BIGINT) // tokens ELSE 0 END, 2) AS whole
  FROM leaves l JOIN level2 b USING (domain, lang, source)
),
placed AS (
  SELECT d.*, whole, b - whole * tokens AS rest, md5(concat_ws('|', 'mix-1', whole, doc_id)) AS place
  FROM d JOIN plan USING (domain, lang, source)
),
run AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, n_tokens RANGE UNBOUNDED PRECEDING) AS run FROM placed),
cuts AS (SELECT domain, lang, source, min((place, n_tokens)) AS cut FROM run WHERE run > rest GROUP BY ALL)
SELECT doc_id, domain, lang, source, n_tokens,
       CAST(whole + CASE WHEN rest > 0 AND (cut IS NULL OR (place, n_tokens) < cut) THEN 1 ELSE 0 END AS BIGINT) AS n_copies
FROM run LEFT JOIN cuts USING (domain, lang, source)
"""

# --- op4 ---------------------------------------------------------------------------------------------------------

_PIECE = [f"CAST('0x' || substr(h, {5 * i + 1}, 5) AS INT)" for i in range(8)]
_LETTER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BASE32 = " || ".join(f"substr('{_LETTER}', (({p} >> {s}) & 31) + 1, 1)" for p in _PIECE for s in (15, 10, 5, 0))

OP4 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS f FROM pages)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id != f THEN f END AS refers_to
FROM p
"""

# --- op10 --------------------------------------------------------------------------------------------------------

_RULES = (("com", "/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"))
_LONG = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br")


def _rule(value: int) -> str:
    """CASE over the rules, longest first; value: 0 the rule's text, 1 its verdict."""
    arms = [
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{(h + p, v)[value]}'" for h, p, v in sorted(_RULES, key=lambda r: -len(r[0] + r[1]))
    ]
    return f"CASE {' '.join(arms)} END"


def _posterior(name: str, children: str, key: str, parents: str, parent: str) -> str:
    return f"""
{name}_m AS (SELECT c.*, p.mean AS m FROM {children} c JOIN {parents} p ON c.{parent} = p.{parent}),
{name}_s AS (
  SELECT 1 / least(greatest(coalesce(sum(n * (k / n - m) ** 2 - m * (1 - m)) FILTER (n > 0) / nullif(sum(m * (1 - m) * (n - 1)) FILTER (n > 0), 0), 0.5), 1 / 201.0), 0.5) - 1 AS s
  FROM {name}_m
),
{name}_ab AS (SELECT x.*, s * m + k AS a, s * (1 - m) + n - k AS b FROM {name}_m x, {name}_s),
{name} AS (SELECT {key}, a / (a + b) AS mean, sqrt(a * b / ((a + b) ** 2 * (a + b + 1))) AS sd FROM {name}_ab)"""


OP10 = rf"""
WITH u AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_LETTERS}') AS host, regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
votes AS (
  SELECT doc_id AS page_id, count(*) AS n, count(*) FILTER (quality = 0 OR toxic = 1) AS k
  FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id
),
hosts AS (
  SELECT host, CASE WHEN array_to_string(string_split(host, '.')[-2:], '.') IN {_LONG} THEN 2 ELSE 1 END AS labels,
         CAST(coalesce(sum(n), 0) AS DOUBLE) AS n, CAST(coalesce(sum(k), 0) AS DOUBLE) AS k
  FROM h LEFT JOIN votes USING (page_id) GROUP BY host
),
named AS (SELECT host, n, k, array_to_string(string_split(host, '.')[-labels:], '.') AS suffix, array_to_string(string_split(host, '.')[-(labels + 1):], '.') AS domain FROM hosts),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM named GROUP BY domain, suffix),
suffixes AS (SELECT suffix, '' AS root, sum(n) AS n, sum(k) AS k FROM domains GROUP BY suffix),
roots AS (SELECT '' AS root, (sum(k) + 1) / (sum(n) + 2) AS mean FROM suffixes),
{_posterior("ps", "suffixes", "suffix", "roots", "root")},
{_posterior("pd", "domains", "domain", "ps", "suffix")},
{_posterior("ph", "named", "host", "pd", "domain")}
SELECT page_id, host, path, {_rule(0)} AS rule,
       coalesce({_rule(1)}, CASE WHEN mean - 1.645 * sd > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM h JOIN ph USING (host)
"""

ORACLE_SQL |= {"op3_mixing": OP3, "op4_warc": OP4, "op10_url_filter": OP10}
