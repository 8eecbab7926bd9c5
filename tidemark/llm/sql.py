"""The same results as DuckDB SQL, for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from tidemark.llm.quality import CHAR_CLASSES

_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_NIBBLE = "(strpos('0123456789abcdef', substr(h, CAST({at} AS BIGINT) + 1, 1)) - 1)"


def warc() -> str:
    """A base32 digit is five bits: of the two hex digits it lies in, those after the first 5 * i % 4."""
    pair = f"({_NIBBLE.format(at='(5 * i) // 4')} * 16 + {_NIBBLE.format(at='(5 * i) // 4 + 1')})"
    digit = f"substr('{_BASE32}', CAST(({pair} // CAST(pow(2, 3 - (5 * i) % 4) AS BIGINT)) % 32 AS BIGINT) + 1, 1)"
    return (
        "WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages), m AS (SELECT h, min(page_id) AS first FROM p GROUP BY h) "
        f"SELECT page_id, strlen(t) AS payload_bytes, array_to_string(list_transform(range(32), lambda i: {digit}), '') AS payload_digest, "
        "CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM p JOIN m USING (h)"
    )


def chat() -> str:
    return """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, list(role || chr(31) || text ORDER BY turn, role, text) AS l, count(*) AS n FROM t GROUP BY conv_id),
r AS (SELECT l, n, min(conv_id) AS conv_id, count(*) AS copies FROM c GROUP BY l, n),
k AS (SELECT * FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.n > r.n AND c.l[1:r.n] = r.l))
SELECT t.conv_id, row_number() OVER (PARTITION BY t.conv_id ORDER BY turn, role, text) AS position, k.n AS n_turns, k.copies,
  '<|im_start|>' || replace(role, '<|im_', '<| im_') || chr(10) || replace(text, '<|im_', '<| im_') || '<|im_end|>' || chr(10) AS rendered FROM t JOIN k ON t.conv_id = k.conv_id"""


def url_filter(rules: list, listed: list[str]) -> str:
    fits = [(r, f"((host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}'))") for r in sorted(rules, key=lambda r: (-len(r.name), r.name))]
    block = " OR ".join(f"host = '{d}' OR ends_with(host, '.{d}')" for d in listed)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
s AS (SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), '{upper}', '{upper.lower()}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {w} THEN '{r.name}'" for r, w in fits)} END AS rule, CASE {" ".join(f"WHEN {w} THEN '{r.verdict}'" for r, w in fits)} WHEN {block} THEN 'block' ELSE 'allow' END AS verdict FROM s"""


def quality(min_words: int = 50, max_char: float = 0.2, min_common: int = 100, max_word: float = 0.05, z: float = 7.0, max_rows: int = 10_000, n_words: int = 50, min_docs: int = 20, max_languages: int = 16) -> str:
    space = r"[\x20\x09-\x0D]"
    steps = [("c0", "t", space), ("c1", "c0", "[#*$%&|<>]"), ("c2", "c1", "[a-z]"), ("c3", "c2", "[A-Z]"), ("c4", "c3", "[0-9]"), ("c5", "c4", r"\p{L}")]
    chain = ", ".join(f"regexp_replace({a}, '{p}', '', 'g') AS {n}" for n, a, p in steps)
    names = ["t", *[n for n, _, _ in steps]]
    classes = [f"length({a}) - length({b})" for a, b in zip(names, names[1:])] + ["length(c5)"]
    jsd = "sqrt(greatest(0.0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2))"
    leads = ", ".join(f"lead(word, {k}) OVER o AS w{k}" for k in range(1, 8))
    judged_by = "JOIN {refs} ON {refs}.ref = {of}.lang OR {also} AND NOT EXISTS (SELECT 1 FROM ll WHERE ll.lang = {of}.lang)"
    allowed = "sqrt({d} * {d} + ({k} + {z} * sqrt(2.0 * {k})) / (8 * ln(2)) / greatest(n_words, 1))"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '{space}+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
x AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM w),
g AS (SELECT r, pos, word, {leads} FROM x WINDOW o AS (PARTITION BY r ORDER BY pos)),
f AS (SELECT r, pos, count(*) OVER (PARTITION BY r, word, w1, w2, w3, w4, w5, w6, w7) AS c FROM g WHERE w7 IS NOT NULL),
n AS (SELECT r, least(8, coalesce(lead(pos) OVER (PARTITION BY r ORDER BY pos) - pos, 8)) AS part FROM f WHERE c >= 2),
rep AS (SELECT r, CAST(sum(part) AS BIGINT) AS n_repeat FROM n GROUP BY 1),
ch AS (SELECT r, t, {chain} FROM d),
b AS (SELECT w.r, w.doc_id, w.lang, len(w.w) AS n_words, length(c0) AS word_chars, length(c0) - length(c1) AS n_symbols, len(w.l) - len(list_distinct(w.l)) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words,
  len(w.w) < 20 OR 100 * coalesce(n_repeat, 0) > 30 * len(w.w) AS base_failed, [{", ".join(c.replace("(t)", "(ch.t)") for c in classes)}] AS cl FROM w JOIN ch USING (r) LEFT JOIN rep USING (r)),
good AS (SELECT doc_id FROM (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT {max_rows}),
s AS (SELECT * FROM b WHERE doc_id IN (SELECT doc_id FROM good) AND NOT base_failed AND lang IS NOT NULL),
ll AS (SELECT lang, count(*) AS docs, sum(n_words) AS n FROM s GROUP BY lang HAVING count(*) >= {min_docs} ORDER BY docs DESC, lang LIMIT {max_languages}),
cc AS (SELECT r, lang, unnest(range({len(CHAR_CLASSES)})) AS k, unnest(cl) AS c, greatest(list_sum(cl), 1) AS total FROM b),
cr AS (SELECT cc.lang AS ref, k, sum(c) / sum(sum(c)) OVER (PARTITION BY cc.lang) AS q FROM cc JOIN ll ON ll.lang = cc.lang WHERE r IN (SELECT r FROM s) GROUP BY cc.lang, k),
cd AS (SELECT r, min(dist) AS dist FROM (SELECT r, ref, {jsd} AS dist FROM (SELECT cc.r, cr.ref, c / CAST(total AS DOUBLE) AS p, q FROM cc {judged_by.format(refs="cr", of="cc", also="true")} WHERE cr.k = cc.k) GROUP BY 1, 2) GROUP BY 1),
voc AS (SELECT lang AS ref, word, c, n, row_number() OVER (PARTITION BY lang ORDER BY c DESC, word) AS k FROM (SELECT s.lang, ll.n, word, count(*) AS c FROM x JOIN s USING (r) JOIN ll ON ll.lang = s.lang GROUP BY 1, 2, 3) QUALIFY k <= {n_words}),
wr AS (SELECT ref, k, c / CAST(n AS DOUBLE) AS q FROM voc UNION ALL SELECT ref, 0, 1 - sum(c) / CAST(any_value(n) AS DOUBLE) FROM voc GROUP BY ref),
refs AS (SELECT DISTINCT ref FROM voc),
br AS (SELECT b.r, b.n_words, refs.ref FROM b {judged_by.format(refs="refs", of="b", also="b.lang IS NULL")}),
hit AS (SELECT r, word, count(*) AS c FROM x WHERE word IN (SELECT word FROM voc) GROUP BY 1, 2),
wl AS (SELECT br.r, br.ref, br.n_words, voc.k, coalesce(hit.c, 0) AS c FROM br JOIN voc USING (ref) LEFT JOIN hit ON hit.r = br.r AND hit.word = voc.word),
wa AS (SELECT r, ref, n_words, k, c FROM wl UNION ALL SELECT r, ref, n_words, 0, n_words - sum(c) FROM wl GROUP BY 1, 2, 3),
wd AS (SELECT r, min(dist) AS dist FROM (SELECT r, ref, {jsd} AS dist FROM (SELECT r, wa.ref, c / CAST(greatest(n_words, 1) AS DOUBLE) AS p, q FROM wa JOIN wr ON wa.ref = wr.ref AND wa.k = wr.k) GROUP BY 1, 2) GROUP BY 1),
v AS (SELECT b.*, coalesce(cd.dist, 0.0) AS char_distance, coalesce(wd.dist, 0.0) AS word_distance, (SELECT coalesce(max(k), 0) FROM voc) AS bins FROM b LEFT JOIN cd USING (r) LEFT JOIN wd USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(char_distance, 6) AS char_distance, round(word_distance, 6) AS word_distance,
  NOT base_failed AND (n_words < {min_words} OR char_distance <= {allowed.format(d=max_char, k=len(CHAR_CLASSES), z=z)}) AND (n_words < {min_common} OR word_distance <= {allowed.format(d=max_word, k="bins", z=z)}) AS kept FROM v"""


def vectors(cosine: float = 0.9) -> str:
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= {cosine}),
r AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.c = l.a),
m AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY 1)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = m.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM m"""
