"""DuckDB SQL for the queries that SQL can express, each over its whole table."""

from __future__ import annotations

from docloom.llm.common import LOWER, UPPER
from docloom.llm.urls import CHI_SQUARE, CHILDREN, DEPTH, LIMIT, PER_CHILD, PRIOR, RULES, WEIGHT

_LOW = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

OP5 = f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {_LOW} AS t FROM documents) WINDOW w AS (PARTITION BY t)"""

OP6 = rf"""
WITH d AS (SELECT doc_id, source, t, {_WORDS.format("t")} AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
           FROM (SELECT doc_id, source, coalesce(text, '') AS t FROM documents)),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
r AS (SELECT doc_id, count(DISTINCT place) AS n_repeat_words FROM (SELECT doc_id, unnest(generate_series(i, i + 7)) AS place FROM twice) GROUP BY doc_id),
s AS (SELECT doc_id, source, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
             10 * n_symbols > n_words OR word_chars > 15 * n_words OR word_chars < 2 * n_words OR 10 * n_dup_lines > 3 * n_lines AS soft FROM s),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed OR soft) AS bad FROM f GROUP BY source),
p AS (SELECT m, CASE WHEN coalesce(m, 0) = 0 OR coalesce(v, 0) = 0 OR m >= 1 THEN 1.0 ELSE least(1000.0, greatest(1.0, m * (1 - m) / v - 1)) END AS k
      FROM (SELECT avg(bad / n) AS m, var_pop(bad / n) AS v FROM h))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (bad + k * m) / (n + k) <= CASE WHEN base_failed OR soft THEN 0.3 ELSE 0.8 END AS kept
FROM f JOIN h ON f.source IS NOT DISTINCT FROM h.source, p"""

OP7 = rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")}) AS size, md5(coalesce(text, '')) AS digest FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, sum(cap) OVER a AS caps, sum(weight) OVER a AS weights, row_number() OVER a AS k FROM w WINDOW a AS (ORDER BY cap / weight, encode(source) ROWS UNBOUNDED PRECEDING)),
t AS (SELECT 1.5::DOUBLE * sum(source_size) AS total, sum(weight) AS weights FROM w),
l AS (SELECT 0 AS k, 0.0::DOUBLE AS caps, 0.0::DOUBLE AS used UNION ALL SELECT k, caps, weights FROM o),
levels AS (SELECT l.k, CASE WHEN t.weights > l.used THEN (t.total - l.caps) / (t.weights - l.used) ELSE 0 END AS level,
                  (SELECT cap / weight FROM o WHERE o.k = l.k + 1) AS next FROM l, t),
level AS (SELECT level FROM levels WHERE next IS NULL OR next > level ORDER BY k LIMIT 1),
m AS (SELECT source, source_size, least(cap, level * weight) AS target FROM w, level),
r AS (SELECT d.doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
             ('0x' || substring(md5('17|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || digest), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS draw
      FROM d JOIN m ON d.source IS NOT DISTINCT FROM m.source)
SELECT doc_id, size, source_size, target, CAST(floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) * size AS taken FROM r"""

OP9 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOW)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 2], ' ') END AS g
      FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM reach r JOIN e ON e.a = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)"""


def _rule(value: str) -> str:
    """CASE over the rules, longest first."""
    whens = []
    for verdict, rule in sorted(RULES, key=lambda r: -len(r[1])):
        host, path = rule[: rule.index("/")], rule[rule.index("/") :]
        whens.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{rule if value == 'rule' else verdict}'")
    return f"CASE {' '.join(whens)} END"


def _op3() -> str:
    seg = ", ".join(f"CASE WHEN len(g) >= {DEPTH} THEN array_to_string(g[{DEPTH}:], '/') END AS s{k}" if k == DEPTH - 1 else f"g[{k + 1}] AS s{k}" for k in range(DEPTH))
    names = ", ".join(f"s{k}" for k in range(DEPTH))
    same = " AND ".join(f"r.s{k} IS NOT DISTINCT FROM x.s{k}" for k in range(DEPTH))
    parts = [
        f"""u AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
        FROM (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages))""",
        f"""r AS (SELECT *, {seg} FROM (SELECT page_id, host, path, {_rule("rule")} AS rule, {_rule("verdict")} AS v,
        list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN '/n'
            WHEN regexp_full_match(x, '[0-9]+[.][A-Za-z]+') THEN '/n.' || regexp_extract(x, '[.]([A-Za-z]+)$', 1) WHEN regexp_matches(x, '[0-9]') THEN '/x' ELSE x END) AS g FROM u))""",
        f"l0 AS (SELECT host, {names}, '' AS t, count(*) AS n, count(v) AS lab, count(*) FILTER (v = 'block') AS bad FROM r GROUP BY ALL)",
    ]
    for k in range(DEPTH):
        parts += [
            f"c{k} AS (SELECT host, t, s{k} AS s, sum(n) AS n, sum(lab) AS lab, sum(bad) AS bad FROM l{k} WHERE s{k} IS NOT NULL GROUP BY ALL)",
            f"p{k} AS (SELECT host, t, count(*) AS kids, sum(n) AS pn, sum(lab) AS plab, sum(bad) AS pbad FROM c{k} GROUP BY ALL)",
            f"""n{k} AS (SELECT host, t, s, CASE WHEN kids > {CHILDREN} AND pn < {PER_CHILD} * kids THEN '/*'
            WHEN lab > 0 AND plab - lab > 0 AND power(bad / lab - (pbad - bad) / (plab - lab), 2) <= {CHI_SQUARE} * (pbad / plab * (1 - pbad / plab) * (1 / lab + 1 / (plab - lab))) THEN '/~' ELSE s END AS name
            FROM (SELECT host, t, s, kids, CAST(c.n AS DOUBLE) AS n, CAST(lab AS DOUBLE) AS lab, CAST(bad AS DOUBLE) AS bad, CAST(pn AS DOUBLE) AS pn, CAST(plab AS DOUBLE) AS plab, CAST(pbad AS DOUBLE) AS pbad
                  FROM c{k} c JOIN p{k} USING (host, t)))""",
            f"l{k + 1} AS (SELECT l.* REPLACE (CASE WHEN name IS NULL THEN l.t ELSE l.t || '/' || name END AS t) FROM l{k} l LEFT JOIN n{k} x ON l.host = x.host AND l.t = x.t AND l.s{k} = x.s)",
        ]
    parts += [
        f"x AS (SELECT *, (sum(bad) OVER w + {WEIGHT * PRIOR}) / (sum(lab) OVER w + {WEIGHT}) AS purity FROM l{DEPTH} WINDOW w AS (PARTITION BY host, t))",
    ]
    return "WITH " + ",\n".join(parts) + f"\nSELECT page_id, r.host, path, rule, coalesce(v, CASE WHEN purity >= {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict FROM r JOIN x ON r.host = x.host AND {same}"


_TERMS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, t, len(t) AS n FROM (SELECT doc_id, {_TERMS} AS t FROM documents) WHERE len(t) > 0),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM d),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(t) AS term FROM d) SEMI JOIN q USING (term) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term, docs),
m AS (SELECT r, doc_id, 50 + (50 * n * docs) // total AS m FROM d, s),
x AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY item_id, r, doc_id),
y AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM y WHERE rank <= 50"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_filter": _op3(),
        "op5_exact_dedup": OP5,
        "op6_quality_rules": OP6,
        "op7_mixing": OP7,
        "op9_minhash_near_dedup": OP9,
        "op12_lexical_search": OP12,
    }
