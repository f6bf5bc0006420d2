"""DuckDB SQL for the queries that SQL can express over whole tables."""

from .collocations import LEAST, REPLACES, TOP
from .secret_scan import ACCESS, ASSIGN, HEX, LEAST_VALUE, MOST_OWNERS, MOST_REPOSITORIES, TOKEN
from .warc import LEAST_SHARED

WORDS = "list_filter(regexp_split_to_array({text}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""WITH w AS (SELECT doc_id, {WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
 p AS (SELECT doc_id, ws, unnest(range(greatest(len(ws) - 12, 0))) AS i FROM w), win AS (SELECT doc_id, i, array_to_string(ws[i + 1 : i + 13], ' ') AS k FROM p),
 m AS (SELECT k, min(doc_id) AS first FROM win GROUP BY 1),
 cov AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN m USING (k) WHERE first < doc_id)),
 wd AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS p FROM w),
 kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY wd.p) AS t FROM wd ANTI JOIN cov USING (doc_id, p) GROUP BY 1)
 SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

OP4 = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), g AS (SELECT h, max(page_id) AS original FROM p WHERE strlen(h) >= {LEAST_SHARED} GROUP BY 1)
 SELECT page_id, strlen(p.h) AS payload_bytes, sha1(p.h) AS payload_digest, CASE WHEN page_id < original THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < original THEN original END AS refers_to FROM p LEFT JOIN g USING (h)"""

OP6 = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(text=LOWER)} AS ws FROM documents),
 s AS (SELECT DISTINCT doc_id, array_to_string(ws[i + 1 : i + 5], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(CASE WHEN len(ws) = 0 THEN 0 ELSE greatest(len(ws) - 4, 1) END)) AS i FROM w)),
 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
 o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
 l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
 e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), c AS (SELECT a, min(b) AS c FROM r GROUP BY 1)
 SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(c, w.doc_id)) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = w.doc_id"""


def _spans(pattern: str, kind: int, value: int = 2) -> str:
    find = lambda g: f"regexp_extract_all(x, '(?s)(.*?)({pattern.replace(chr(39), chr(39) * 2)})', {g})"
    total = lambda l: f"CAST(coalesce(list_sum(list_transform({l}, lambda y: length(y))), 0) AS BIGINT)"
    span = f"{{'start': {total('g[1:i]')} + {total('m[1:i - 1]')}, 'kind_no': {kind}, 'end': {total('g[1:i]')} + {total('m[1:i]')}, 'value': v[i]}}"
    return f"SELECT r, {span} AS span FROM (SELECT r, g, m, v, unnest(range(1, len(m) + 1)) AS i FROM (SELECT r, {find(1)} AS g, {find(2)} AS m, {find(value)} AS v FROM t))"


SHOWN = "coalesce(string_agg((['assign', 'access', 'hex', 'token'])[span.kind_no + 1] || ':' || span.start || ':' || span.end, ',' ORDER BY span.start, span.kind_no), '')"
OP10 = f"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS x FROM documents),
 b AS (SELECT * FROM ({_spans(ASSIGN, 0, 3)}) WHERE length(span.value) >= {LEAST_VALUE} UNION ALL {_spans(ACCESS, 1)} UNION ALL {_spans(HEX, 2)}),
 k AS (SELECT * FROM ({_spans(TOKEN, 3)}) WHERE regexp_matches(span.value, '[0-9]') AND regexp_matches(span.value, '[A-Za-z]')),
 a AS (SELECT k.* FROM k ANTI JOIN b ON b.r = k.r AND b.span.start < k.span.end AND k.span.start < b.span.end),
 j AS (SELECT r, doc_id, source, span FROM (SELECT * FROM b UNION ALL SELECT * FROM a) JOIN t USING (r)),
 f AS (SELECT span.value AS value, count(DISTINCT coalesce(source, chr(0))) AS owners, sum(1) AS n FROM j GROUP BY 1),
 q AS (SELECT value, sum(repositories) AS repositories FROM (SELECT span.value AS value, source, count(DISTINCT doc_id) AS repositories FROM j GROUP BY 1, 2) GROUP BY 1),
 z AS (SELECT j.*, owners <= {MOST_OWNERS} AND repositories <= {MOST_REPOSITORIES} AS live FROM j JOIN f ON f.value = j.span.value JOIN q ON q.value = j.span.value),
 h AS (SELECT r, count(*) FILTER (span.kind_no = 0) AS n_assign, count(*) FILTER (span.kind_no = 1) AS n_access, count(*) FILTER (span.kind_no = 2) AS n_hex, {SHOWN.replace("), '')", ") FILTER (span.kind_no < 3), '')")} AS base,
 {SHOWN.replace("), '')", ") FILTER (span.kind_no < 3 OR live), '')")} AS spans, count(*) FILTER (span.kind_no < 3 AND live) AS n_live, count(*) FILTER (span.kind_no < 3 AND NOT live) AS n_copied FROM z GROUP BY 1)
 SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied FROM t LEFT JOIN h USING (r)"""

#: CRC-32 of ASCII digits s, a bit at a time, and modulo 9.
CRC = "xor(list_reduce(list_concat([4294967295], flatten(list_transform(range(1, length(s) + 1), lambda i: list_transform(range(8), lambda j: CAST(ascii(s[i]) AS BIGINT) >> j & 1)))), lambda a, b: xor(a >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295)"
OP11 = f"""WITH o AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place, role, text FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
 h AS (SELECT c, c - c % 5 AS base, CASE WHEN c % 5 = 0 THEN 0 ELSE {CRC} % 9 END AS h FROM (SELECT DISTINCT c, CAST(c AS VARCHAR) AS s FROM o)),
 r AS (SELECT h.c, place, role, text FROM h JOIN o ON o.c = base WHERE place < h UNION ALL SELECT h.c, place, role, text FROM h JOIN o ON o.c = h.c WHERE place >= h),
 s AS (SELECT h.c, coalesce(q, []) AS q FROM h LEFT JOIN (SELECT c, list({{'role': role, 'text': text}} ORDER BY place) AS q FROM r GROUP BY 1) USING (c)),
 p AS (SELECT c, q, unnest(range(len(q) + 1)) AS depth FROM s),
 n AS (SELECT depth, q[1:depth] AS path, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(q) = depth), '') AS ends FROM p GROUP BY 1, 2),
 k AS (SELECT a.*, b.conv_id AS parent_conv_id, (SELECT count(*) FROM n x WHERE x.depth = a.depth + 1 AND x.path[1:a.depth] = a.path) AS n_children, CASE WHEN a.depth = 0 THEN 0 ELSE (a.n_convs - 1) * strlen(a.path[a.depth].text) END AS saved FROM n a LEFT JOIN n b ON b.depth = a.depth - 1 AND b.path = a.path[1:a.depth - 1])
 SELECT a.conv_id, a.depth, a.parent_conv_id, a.n_convs, a.n_children, count(*) FILTER (y.n_children = 0) AS n_leaves, CAST(sum(y.saved) AS BIGINT) AS saved_tokens, sha256(a.ends) AS ends_sha256 FROM k a JOIN k y ON y.depth >= a.depth AND y.path[1:a.depth] = a.path GROUP BY a.conv_id, a.depth, a.parent_conv_id, a.n_convs, a.n_children, a.ends"""

CUTS = " UNION ALL ".join(f"SELECT lang, ws, a, {k} AS k, array_to_string(ws[1:{k}], ' ') AS left_part, array_to_string(ws[{k + 1}:], ' ') AS right_part FROM kept WHERE m > {k}" for k in range(1, 5))
OP12 = f"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
 w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS ws FROM p), t AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY 1),
 g AS (SELECT lang, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: ws[i : i + m - 1])) AS ws, m FROM w, range(1, 6) r(m) WHERE len(ws) >= m),
 c AS (SELECT lang, ws, array_to_string(ws, ' ') AS phrase, m, count(*) AS a FROM g GROUP BY 1, 2, 3, 4 HAVING count(*) >= {LEAST}),
 longer AS (SELECT lang, phrase, max(longer) AS longer FROM (SELECT lang, array_to_string(unnest([ws[1:m - 1], ws[2:]]), ' ') AS phrase, a AS longer FROM c WHERE m > 2) GROUP BY 1, 2),
 kept AS (SELECT c.* FROM c LEFT JOIN longer USING (lang, phrase) WHERE m > 1 AND (longer IS NULL OR 100 * longer < {REPLACES} * a)), cuts AS ({CUTS}),
 s AS (SELECT cuts.lang, array_to_string(cuts.ws, ' ') AS phrase, cuts.a, x.a AS l, y.a AS r, t.n, k, CAST(1000 AS HUGEINT) * cuts.a * t.n // (CAST(x.a AS HUGEINT) * y.a) AS score FROM cuts JOIN t USING (lang) JOIN c x ON x.lang = cuts.lang AND x.phrase = left_part JOIN c y ON y.lang = cuts.lang AND y.phrase = right_part),
 best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
 SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM best QUALIFY rank <= {TOP}"""

OP13 = """WITH t AS (SELECT row_number() OVER () AS r, doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS x FROM documents)
 SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY x) AS group_size, row_number() OVER w = 1 AS kept, sha256(x) AS text_sha256 FROM t WINDOW w AS (PARTITION BY x ORDER BY n DESC, doc_id NULLS LAST, r)"""

ORACLES: dict[str, str] = {
    "op1_substring_dedup": OP1,
    "op4_warc": OP4,
    "op6_jaccard_join": OP6,
    "op10_secret_scan": OP10,
    "op11_prefix_trie": OP11,
    "op12_collocations": OP12,
    "op13_exact_dedup": OP13,
}
