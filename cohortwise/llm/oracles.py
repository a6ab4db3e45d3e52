"""DuckDB SQL for the queries of this subpackage that SQL can express."""

OP2 = """
WITH RECURSIVE usable AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.98
), reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, least(e.vec_id, coalesce(l.b, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(l.b, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN counted c ON c.a = e.vec_id LEFT JOIN least l ON l.a = e.vec_id
"""

OP5 = """
WITH digests AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS t FROM documents)
SELECT doc_id, text_sha256,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept
FROM digests WINDOW same AS (PARTITION BY t)
"""

OP6 = r"""
WITH RECURSIVE rules(verdict, host, path) AS (
    VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), links AS (
    SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM pages
), raw_edges AS (
    SELECT url AS a, regexp_extract(tag, '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1) AS b FROM links WHERE regexp_matches(tag, '(?is)\brel\s*=\s*["'']?canonical')
    UNION ALL
    SELECT url, regexp_extract(tag, '(?is)\burl\s*=\s*["'']?\s*([^"''\s>;]+)', 1) FROM links
    WHERE regexp_matches(tag, '(?is)\bhttp-equiv\s*=\s*["'']?refresh') AND NOT regexp_matches(tag, '(?is)\brel\s*=\s*["'']?canonical')
), urls AS (
    SELECT DISTINCT url FROM (SELECT url FROM pages UNION ALL SELECT b FROM raw_edges) WHERE url IS NOT NULL
), split AS (
    SELECT url, strpos(url, '://') AS mark, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM urls
), parts AS (
    SELECT url, mark,
           translate(regexp_extract(rest, '\A([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '\A[^/?#]*([^?#]*)', 1) AS path,
           CASE WHEN mark > 0 THEN translate(substr(url, 1, mark - 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || '://' ||
               translate(regexp_extract(rest, '\A([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(rest, '\A[^/?#]*([^#]*)', 1) END AS node
    FROM split
), fitted AS (
    SELECT p.*, r.host || r.path AS rule, r.verdict,
           row_number() OVER (PARTITION BY p.url ORDER BY length(r.host || r.path) DESC NULLS LAST) AS place
    FROM parts p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
), own AS (SELECT * FROM fitted WHERE place = 1),
edges AS (
    SELECT x.node AS a, y.node AS b FROM raw_edges e JOIN own x ON e.a = x.url JOIN own y ON e.b = y.url WHERE x.node <> y.node
), both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
alias AS (SELECT r.a AS node, min(o.verdict) AS verdict, least(min(r.b), r.a) AS component FROM reach r JOIN own o ON o.node = r.b GROUP BY r.a)
SELECT p.page_id, coalesce(o.host, '') AS host, coalesce(o.path, '') AS path, o.rule, coalesce(o.verdict, a.verdict, 'allow') AS verdict, a.component
FROM pages p LEFT JOIN own o ON p.url = o.url LEFT JOIN alias a ON o.node = a.node
"""

OP8 = r"""
WITH kinds(k, kind, pattern, part, least) AS (
    VALUES (0, 'assign', '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2, 6),
           (1, 'access', 'AKIA[A-Z0-9]+', 0, 20),
           (2, 'hex', '[0-9a-f]+', 0, 24)
), texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
found AS (
    SELECT r, t, 'assign' AS kind, regexp_extract_all(t, (SELECT pattern FROM kinds WHERE k = 0)) AS hits, regexp_extract_all(t, (SELECT pattern FROM kinds WHERE k = 0), 2) AS parts,
           string_split_regex(t, (SELECT pattern FROM kinds WHERE k = 0)) AS gaps FROM texts
    UNION ALL
    SELECT r, t, 'access', regexp_extract_all(t, 'AKIA[A-Z0-9]+'), regexp_extract_all(t, 'AKIA[A-Z0-9]+'), string_split_regex(t, 'AKIA[A-Z0-9]+') FROM texts
    UNION ALL
    SELECT r, t, 'hex', regexp_extract_all(t, '[0-9a-f]+'), regexp_extract_all(t, '[0-9a-f]+'), string_split_regex(t, '[0-9a-f]+') FROM texts
), hits AS (
    SELECT r, kind, unnest(range(1, len(hits) + 1)) AS i, unnest(hits) AS hit, unnest(parts) AS part, unnest(gaps[:len(hits)]) AS gap FROM found
), placed AS (
    SELECT r, kind, hit, part, sum(length(hit) + length(gap)) OVER (PARTITION BY r, kind ORDER BY i) AS ends FROM hits
), spans AS (
    SELECT p.r, p.kind, k.k, ends - length(hit) AS s, ends AS e FROM placed p JOIN kinds k USING (kind) WHERE length(p.part) >= k.least
), joined AS (
    SELECT r, string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, k) AS spans,
           count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex FROM spans GROUP BY r
)
SELECT t.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       coalesce(spans, '') AS spans, sha256(coalesce(spans, '')) AS base_sha256
FROM texts t LEFT JOIN joined j USING (r)
"""

OP10 = r"""
WITH RECURSIVE tokens AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w
        ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM tokens
), sized AS (SELECT doc_id, s, len(s) AS n FROM sets),
items AS (SELECT doc_id, n, unnest(s) AS x FROM sized),
common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id
    WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY ALL
), half AS (SELECT a, b FROM common WHERE 100 * c >= 80 * (na + nb - c)),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT s.doc_id, s.n::BIGINT AS n_shingles, least(s.doc_id, coalesce(l.b, s.doc_id)) AS component_id, s.doc_id = least(s.doc_id, coalesce(l.b, s.doc_id)) AS kept
FROM sized s LEFT JOIN least l ON l.a = s.doc_id
"""



def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR END"


def _tree(name: str, leaves: str, levels: int = 6) -> str:
    """Nodes ``(tree, pos, digest)`` level by level, and the runs of their digests."""
    parts = [f"{name}_0 AS (SELECT * FROM {leaves})"]
    for k in range(levels):
        parts.append(f"{name}_runs_{k} AS (SELECT tree, pos // 16 AS run, list(digest ORDER BY pos) AS members, any_value(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {name}_{k}) GROUP BY ALL)")
        parts.append(f"{name}_{k + 1} AS (SELECT tree, run AS pos, CASE WHEN n > 1 THEN sha256(array_to_string(members, '')) ELSE members[1] END AS digest FROM {name}_runs_{k})")
    return ",\n".join(parts)


def _climb(rows: str, name: str, tree: str, position: str, out: str, levels: int = 6) -> str:
    """Follow each row's node to its root: ``cur`` is recomputed and ``sibs`` gathers the siblings."""
    parts = [f"{out}_0 AS (SELECT *, {tree} AS tree_key, {position} AS place FROM {rows})"]
    for k in range(levels):
        own = "(r.place % 16 + 1)"
        parts.append(f"""{out}_{k + 1} AS (
    SELECT r.* REPLACE (r.place // 16 AS place,
           CASE WHEN m.n > 1 THEN sha256(array_to_string(list_transform(m.members, lambda x, i: CASE WHEN i = {own} THEN r.cur ELSE x END), '')) ELSE r.cur END AS cur,
           CASE WHEN m.n > 1 THEN r.sibs || array_to_string(list_filter(m.members, lambda x, i: i <> {own}), '') ELSE r.sibs END AS sibs)
    FROM {out}_{k} r JOIN {name}_runs_{k} m ON m.tree = r.tree_key AND m.run = r.place // 16)""")
    return ",\n".join(parts)


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# crc32 bit by bit: DuckDB has no such function
_CRC32 = """(4294967295 - list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::UBIGINT)), lambda crc, byte:
    list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)))"""

OP11 = f"""
WITH docs AS (
    SELECT doc_id, coalesce('s' || source, '') AS tree, sha256({" || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", "text")))}) AS leaf,
           sha256({" || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", _LOWERED)))}) AS lowered, {_CRC32} % 5 = 0 AS tampered
    FROM documents
), placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM docs),
leaves AS (SELECT tree, pos, leaf AS digest FROM placed),
{_tree("node", "leaves")},
subroots AS (SELECT tree, digest, row_number() OVER (ORDER BY encode(tree)) - 1 AS place_of FROM node_6),
tops AS (SELECT '' AS tree, place_of AS pos, digest FROM subroots),
{_tree("top", "tops", 3)},
begun AS (SELECT p.*, CASE WHEN coalesce(tampered, FALSE) THEN lowered ELSE leaf END AS cur, '' AS sibs FROM placed p),
{_climb("begun", "node", "tree", "pos", "up")},
halfway AS (SELECT u.* EXCLUDE (tree_key, place), s.digest AS subroot, s.place_of FROM up_6 u JOIN subroots s ON s.tree = u.tree),
{_climb("halfway", "top", "''", "place_of", "over", 3)}
SELECT o.doc_id, o.leaf, o.subroot, t.digest AS root, sha256(o.sibs) AS proof_sha256, o.cur AS folded_root, o.cur = t.digest AS verified
FROM over_3 o CROSS JOIN top_3 t
"""

_COVERAGE = {5: 25, 6: 24, 7: 23, 8: 22, 9: 21, 10: 20}  # fixed values: the bounds of the query


def _covered(n: int) -> str:
    """Characters of the words inside windows of n words that stood before, and words inside windows found twice."""
    return f"""
covered_{n} AS (
    SELECT doc_id, sum(CASE WHEN max_before > 0 THEN length(word) ELSE 0 END)::BIGINT AS chars, sum(max_twice)::BIGINT AS words FROM (
        SELECT doc_id, word, max(before) OVER near AS max_before, max(twice) OVER near AS max_twice FROM (
            SELECT doc_id, pos, word,
                   CASE WHEN pos + {n - 1} <= n AND row_number() OVER (PARTITION BY doc_id, gram ORDER BY pos) > 1 THEN 1 ELSE 0 END AS before,
                   CASE WHEN pos + {n - 1} <= n AND count(*) OVER (PARTITION BY doc_id, gram) > 1 THEN 1 ELSE 0 END AS twice
            FROM (SELECT doc_id, pos, word, n, CASE WHEN pos + {n - 1} <= n THEN array_to_string(w[pos:pos + {n - 1}], ' ') ELSE 'rest ' || pos END AS gram FROM placed)
        ) WINDOW near AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)
    ) GROUP BY doc_id
)"""


OP13 = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
placed AS (SELECT doc_id, w, len(w) AS n, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM docs),
lines AS (
    SELECT doc_id, line, pos FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS pos FROM docs)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), repeated AS (
    SELECT doc_id, count(*) AS n, sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) AS chars
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS k FROM lines) WHERE k > 1 GROUP BY doc_id
),{",".join(_covered(n) for n in _COVERAGE)},
measured AS (
    SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
           (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
           coalesce(r.n, 0)::BIGINT AS n_dup_lines, coalesce(r.chars, 0)::BIGINT AS line_chars, coalesce(covered_8.words, 0)::BIGINT AS n_repeat_words,
           {", ".join(f"coalesce(covered_{n}.chars, 0)::BIGINT AS covered_{n}" for n in _COVERAGE)}
    FROM docs d LEFT JOIN repeated r ON r.doc_id = d.doc_id {" ".join(f"LEFT JOIN covered_{n} ON covered_{n}.doc_id = d.doc_id" for n in _COVERAGE)}
), failed AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured)
SELECT *, NOT base_failed AND 100 * line_chars <= 20 * word_chars AND 100 * n_symbols <= 10 * n_words
       AND {" AND ".join(f"100 * covered_{n} <= {percent} * word_chars" for n, percent in _COVERAGE.items())} AS kept
FROM failed
"""

ORACLES: dict[str, str] = {"op2_cover_tree": OP2, "op5_exact_dedup": OP5, "op6_url_filter": OP6, "op8_secret_scan": OP8, "op10_minhash": OP10, "op11_merkle": OP11, "op13_repetition": OP13}
