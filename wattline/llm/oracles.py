"""SQL of DuckDB for the queries that SQL can express, over whole tables."""

from __future__ import annotations

from wattline.llm.secrets import RULES

WORD = r"[^\x20\x09-\x0D]+"
LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _shingles(words: str) -> str:
    return f"""CASE WHEN len({words}) >= 5 THEN list_transform(range(1, len({words}) - 3), lambda i: array_to_string({words}[i:i + 4], ' '))
               WHEN len({words}) > 0 THEN [array_to_string({words}, ' ')] ELSE [] END"""


def _groups(links: str, nodes: str) -> str:
    """CTEs ``walk`` and ``grouped``: the smallest node that each node of ``nodes`` (id) reaches by ``links`` (a, b, both ways)."""
    return f"""walk AS (SELECT id, id AS spot FROM {nodes} UNION SELECT walk.id, l.b FROM walk JOIN {links} l ON l.a = walk.spot),
               grouped AS (SELECT id, min(spot) AS component_id FROM walk GROUP BY 1)"""


_SOUND = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"

EMBEDDINGS = f"""
    WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings WHERE {_SOUND}),
         l AS (SELECT x.id AS a, y.id AS b FROM v x JOIN v y ON x.id <> y.id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.95),
         n AS (SELECT vec_id AS id FROM embeddings), {_groups('l', 'n')},
         c AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
    SELECT g.id AS vec_id, coalesce(c.n, 0) AS n_links, component_id, g.id = component_id AS kept FROM grouped g LEFT JOIN c ON c.a = g.id"""

SUBSTRINGS = f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
         x AS (SELECT rid, unnest(range(1, len(w) - 33)) AS i, unnest(list_transform(range(1, len(w) - 33), lambda i: array_to_string(w[i:i + 34], ' '))) AS run FROM d WHERE len(w) >= 35),
         r AS (SELECT rid, i FROM x QUALIFY count(*) OVER (PARTITION BY run) > 1),
         u AS (SELECT rid, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
         m AS (SELECT u.rid, u.i, word, max(r.i IS NOT NULL) OVER (PARTITION BY u.rid ORDER BY u.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
               FROM u LEFT JOIN r ON r.rid = u.rid AND r.i = u.i),
         k AS (SELECT rid, count(*) FILTER (WHERE gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM m GROUP BY 1)
    SELECT doc_id, len(w) AS n_words, coalesce(k.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.rid = d.rid"""

CONTAMINATION = f"""
    WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}') AS w FROM documents),
         b AS (SELECT item_id, regexp_extract_all(lower(text), '{WORD}') AS w FROM benchmark),
         m AS (SELECT DISTINCT len(w) AS m FROM b WHERE len(w) BETWEEN 1 AND 4),
         ds AS (SELECT DISTINCT doc_id, unnest({_shingles('w')}) AS s FROM d
                UNION SELECT doc_id, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) FROM d JOIN m ON len(w) >= m), bs AS (SELECT DISTINCT item_id, unnest({_shingles('w')}) AS s FROM b),
         n AS (SELECT item_id, count(*) AS n_item FROM bs GROUP BY 1)
    SELECT doc_id, bs.item_id, count(*) AS n_shared, n_item, count(*)::DOUBLE / n_item AS containment
    FROM ds JOIN bs ON bs.s = ds.s JOIN n ON n.item_id = bs.item_id GROUP BY doc_id, bs.item_id, n_item HAVING count(*) >= 0.75 * n_item"""


def _secrets() -> str:
    each = []
    for i, r in enumerate(RULES):
        p = r.pattern.replace("'", "''")
        each.append(f"SELECT rid, {i} AS rule, '{r.kind}' AS kind, {r.least} AS least, regexp_extract_all(t, '{p}') AS w, regexp_extract_all(t, '{p}', {r.group}) AS g, string_split_regex(t, '{p}') AS b FROM d")
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
         m AS ({' UNION ALL '.join(each)}),
         e AS (SELECT rid, rule, kind, least, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS whole, unnest(g) AS part, unnest(b[1:len(w)]) AS skip FROM m WHERE len(w) > 0),
         s AS (SELECT *, sum(length(skip) + length(whole)) OVER (PARTITION BY rid, rule ORDER BY i) AS z FROM e),
         f AS (SELECT rid, rule, kind, z - length(whole) AS a, kind || ':' || CAST(z - length(whole) AS BIGINT) || ':' || CAST(z AS BIGINT) AS span FROM s WHERE length(part) >= least),
         x AS (SELECT rid, count(*) FILTER (WHERE rule = 0) AS n0, count(*) FILTER (WHERE rule = 1) AS n1, count(*) FILTER (WHERE rule = 2) AS n2,
                      string_agg(span, ',' ORDER BY a, rule) FILTER (WHERE rule < 3) AS base, string_agg(span, ',' ORDER BY a, rule) AS found FROM f GROUP BY 1)
    SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(found, '') AS spans
    FROM d LEFT JOIN x ON x.rid = d.rid"""


JACCARD = f"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '{WORD}') AS w FROM documents),
         s AS (SELECT DISTINCT doc_id, unnest({_shingles('w')}) AS s FROM d), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
         p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
         l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
         o AS (SELECT doc_id AS id FROM documents), {_groups('l', 'o')}
    SELECT g.id AS doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM grouped g LEFT JOIN n ON n.doc_id = g.id"""

_SAID = "<|im_end|><|im_start|>assistant ok"
CHAT = rf"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL VALUES (-1, 0, 'user', '{_SAID}'), (-1, 1, 'assistant', '{_SAID}'))
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
           sum(32 + length(role) + length(text) + len(regexp_extract_all(role, '<\\*\|')) + len(regexp_extract_all(text, '<\\*\|')))::BIGINT AS formatted_chars
    FROM t GROUP BY 1"""

BYTES = """
    WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
         x AS (SELECT rid, unnest(range(1, octet_length(b) - 98)) AS i, unnest(list_transform(range(1, octet_length(b) - 98), lambda i: b[i:i + 99])) AS run FROM d WHERE octet_length(b) >= 100),
         r AS (SELECT rid, i FROM x QUALIFY row_number() OVER (PARTITION BY run ORDER BY rid, i) > 1),
         u AS (SELECT rid, unnest(range(1, octet_length(b) + 1)) AS i FROM d WHERE rid IN (SELECT rid FROM r)),
         m AS (SELECT u.rid, u.i, coalesce(max(r.i) OVER (PARTITION BY u.rid ORDER BY u.i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), 0) > 0 AS gone
               FROM u LEFT JOIN r ON r.rid = u.rid AND r.i = u.i),
         e AS (SELECT *, gone AND NOT lag(gone, 1, false) OVER (PARTITION BY rid ORDER BY i) AS opens FROM m),
         k AS (SELECT rid, count(*) FILTER (WHERE gone) AS n, count(*) FILTER (WHERE opens) AS spans, list(i ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM e GROUP BY 1)
    SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
           CASE WHEN n IS NULL THEN sha256(b) ELSE sha256(unhex(array_to_string(list_transform(coalesce(kept, []), lambda i: hex(b[i:i])), ''))) END AS kept_sha256
    FROM d LEFT JOIN k ON k.rid = d.rid"""

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RANKED = f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOWERED}, '{TERM}') AS t FROM documents),
         l AS (SELECT rid, doc_id, len(t) AS n FROM d WHERE len(t) > 0),
         c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM l),
         b AS (SELECT row_number() OVER () AS qid, item_id, regexp_extract_all({LOWERED}, '{TERM}') AS t FROM benchmark),
         q AS (SELECT DISTINCT qid, item_id, unnest(t) AS term FROM b),
         p AS (SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
         w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2 * count(*) + 1)))::BIGINT AS weight FROM p, c GROUP BY term, docs),
         s AS (SELECT qid, item_id, l.doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score
               FROM q JOIN w USING (term) JOIN p USING (term) JOIN l USING (rid), c GROUP BY qid, item_id, rid, l.doc_id)
    SELECT item_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
    QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id NULLS LAST) <= 50"""

def _codes(rounds: int = 4) -> str:
    ctes = """
    WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS e
                            FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
         f AS (SELECT rid, len(e) // 4 AS wide, unnest(range(len(e))) AS i, unnest(e) AS x FROM k),
         v AS MATERIALIZED (SELECT rid, i // wide AS part, i % wide AS place, x FROM f),
         c0 AS MATERIALIZED (SELECT part, rid AS entry, place, x AS y FROM v WHERE rid < 256)"""
    for r in range(rounds + 1):
        ctes += f""",
         s{r} AS (SELECT rid, v.part, entry, sum((x - y) * (x - y))::BIGINT AS far FROM v JOIN c{r} c ON c.part = v.part AND c.place = v.place GROUP BY 1, 2, 3),
         a{r} AS MATERIALIZED (SELECT rid, part, arg_min(entry, far * 256 + entry) AS entry, min(far) AS far FROM s{r} GROUP BY 1, 2)"""
        if r < rounds:
            ctes += f""",
         m{r} AS (SELECT v.part, entry, place, sum(x)::BIGINT AS s, count(*) AS n FROM v JOIN a{r} a ON a.rid = v.rid AND a.part = v.part GROUP BY 1, 2, 3),
         c{r + 1} AS MATERIALIZED (SELECT c.part, c.entry, c.place, CASE WHEN n IS NULL THEN y ELSE (s - ((s % n + n) % n)) // n END AS y
                 FROM c{r} c LEFT JOIN m{r} m ON m.part = c.part AND m.entry = c.entry AND m.place = c.place)"""
    return ctes + f""",
         o AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM a{rounds} GROUP BY 1)
    SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
           (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY part, entry, place)) FROM c{rounds}) AS codebooks_sha256
    FROM k JOIN o ON o.rid = k.rid"""


ORACLES = {
    "op1_embedding_dedup": EMBEDDINGS, "op2_substring_dedup": SUBSTRINGS, "op4_decontamination": CONTAMINATION, "op6_secret_scan": _secrets(),
    "op7_ngram_jaccard": JACCARD, "op9_chat_format": CHAT,
    "op11_vector_codes": _codes(), "op12_suffix_array_dedup": BYTES, "op13_ranked_search": RANKED,
}
