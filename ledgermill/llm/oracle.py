"""The queries of this subpackage that SQL can express, as SQL."""

from __future__ import annotations

from ledgermill.llm.licenses import PHRASES, TEMPLATES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"


# The least id that chains of links (a, b), a < b, lead to from each of the ids in `nodes`.
_COMPONENTS = """
    linked AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
    reach(id, other) AS (
        SELECT id, id FROM nodes
        UNION
        SELECT reach.id, linked.b FROM reach JOIN linked ON reach.other = linked.a
    ),
    components AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id)"""


def _near_duplicates(words: int, kept: str = "") -> str:
    return rf"""
WITH RECURSIVE words AS MATERIALIZED (
    SELECT doc_id AS id, regexp_extract_all({_lowered("text")}, '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
shingles AS MATERIALIZED (
    SELECT DISTINCT id, array_to_string(w[i : i + {words - 1}], ' ') AS shingle
    FROM (
        SELECT id, w, unnest(range(1, greatest(len(w) - {words - 1}, 1) + 1)) AS i
        FROM words WHERE len(w) > 0
    )
),
sizes AS MATERIALIZED (SELECT id, count(*) AS n FROM shingles GROUP BY id),
links AS MATERIALIZED (
    SELECT x.id AS a, y.id AS b
    FROM (
        SELECT s.id AS p, t.id AS q, count(*) AS shared
        FROM shingles s JOIN shingles t ON s.shingle = t.shingle AND s.id < t.id
        GROUP BY s.id, t.id
    ) JOIN sizes x ON x.id = p JOIN sizes y ON y.id = q
    WHERE 100 * shared >= 80 * (x.n + y.n - shared)
),
nodes AS (SELECT id FROM words),{_COMPONENTS}
SELECT words.id AS doc_id, coalesce(n, 0) AS n_shingles, component_id{kept}
FROM words LEFT JOIN sizes USING (id) JOIN components USING (id)"""


def _field(column: str) -> str:
    text = f"CAST({column} AS VARCHAR)"
    return f"coalesce(CAST(strlen({text}) AS VARCHAR) || ':' || {text}, '-')"


def _leaf(n_chars: str) -> str:
    fields = ("doc_id", "source", "lang", n_chars, "text")
    return f"sha256({' || '.join(map(_field, fields))})"


# CRC-32 of the digits of a number, bit by bit.
_CRC32 = """
    xor(4294967295, list_reduce(
        list_prepend(4294967295, list_transform(
            string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
        lambda crc, byte: list_reduce([xor(crc, byte), 1, 1, 1, 1, 1, 1, 1, 1],
            lambda bits, k: xor(bits >> 1, (bits & 1) * 3988292384))))"""


def _tree(name: str, leaves: str) -> str:
    """All nodes (grp, level, pos, n, digest) over ``leaves`` (grp, pos, n, digest)."""
    return f"""
    {name} AS (
        SELECT grp, 0 AS level, pos, n, digest FROM {leaves}
        UNION ALL
        SELECT grp, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY pos))
        FROM {name} WHERE n > 1 GROUP BY grp, level, pos // 2, n
    )"""


_MERKLE = f"""
WITH RECURSIVE leaves AS MATERIALIZED (
    SELECT lang AS of, coalesce('=' || lang, '') AS grp, doc_id, {_leaf("n_chars")} AS digest,
        CASE WHEN {_CRC32} % 7 = 0 THEN {_leaf("n_chars + 1")} ELSE {_leaf("n_chars")} END AS start
    FROM documents
),
placed AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id, digest) - 1 AS pos,
        count(*) OVER (PARTITION BY grp) AS n
    FROM leaves
),{_tree("nodes", "placed")},
subroots AS MATERIALIZED (
    SELECT 'all' AS grp, grp AS name, digest, row_number() OVER (ORDER BY grp) - 1 AS pos,
        count(*) OVER () AS n
    FROM nodes WHERE n = 1
),{_tree("upper", "subroots")},
steps AS MATERIALIZED (
    -- Every level on the way of every leaf: its place there and the digest beside it, if any.
    SELECT placed.grp, placed.pos, nodes.level, placed.pos >> nodes.level AS place, beside.digest AS beside
    FROM placed JOIN (SELECT DISTINCT grp, level, n FROM nodes) nodes
        ON nodes.grp = placed.grp AND nodes.n > 1
    LEFT JOIN nodes beside ON beside.grp = placed.grp AND beside.level = nodes.level
        AND beside.pos = xor(placed.pos >> nodes.level, 1)
    UNION ALL
    SELECT placed.grp, placed.pos, 100 + nodes.level, subroots.pos >> nodes.level, beside.digest
    FROM placed JOIN subroots ON subroots.name = placed.grp
    JOIN (SELECT DISTINCT level, n FROM upper) nodes ON nodes.n > 1
    LEFT JOIN upper beside ON beside.level = nodes.level
        AND beside.pos = xor(subroots.pos >> nodes.level, 1)
),
ordered AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY grp, pos ORDER BY level) AS step FROM steps
),
folded AS (
    SELECT grp, pos, 1 AS step, start AS digest FROM placed
    UNION ALL
    SELECT folded.grp, folded.pos, folded.step + 1, sha256(
        CASE WHEN ordered.place % 2 = 1 THEN ordered.beside || folded.digest
            ELSE folded.digest || coalesce(ordered.beside, '') END)
    FROM folded JOIN ordered USING (grp, pos, step)
),
ends AS (SELECT grp, pos, arg_max(digest, step) AS folded_root FROM folded GROUP BY grp, pos),
proofs AS (
    SELECT grp, pos, sha256(coalesce(string_agg(beside, '' ORDER BY step), '')) AS proof_sha256
    FROM placed LEFT JOIN ordered USING (grp, pos) GROUP BY grp, pos
),
root AS (SELECT digest AS root FROM upper WHERE n = 1)
SELECT placed.doc_id, placed.digest AS leaf, subroots.digest AS subroot, root, proof_sha256,
    folded_root, folded_root = root AS verified
FROM placed JOIN subroots ON subroots.name = placed.grp
JOIN ends ON ends.grp = placed.grp AND ends.pos = placed.pos
JOIN proofs ON proofs.grp = placed.grp AND proofs.pos = placed.pos
CROSS JOIN root"""


def _nearest(book: str) -> str:
    """The entry of ``book`` nearest to each part (r, p), and how far it is."""
    return f"""
        SELECT r, p, arg_min(e, far * 16 + e) AS e, min(far) AS far
        FROM (
            SELECT r, x.p, e, sum((x - c) * (x - c)) AS far
            FROM parts x JOIN {book} b ON b.p = x.p AND b.i = x.i GROUP BY r, x.p, e
        ) GROUP BY r, p"""


def _vector_codes(rounds: int = 6) -> str:
    books = []
    for k in range(rounds):
        books.append(
            f"""
near{k} AS MATERIALIZED ({_nearest(f"book{k}")}
),
book{k + 1} AS MATERIALIZED (
    SELECT b.p, b.e, b.i, coalesce(m.c, b.c) AS c
    FROM book{k} b LEFT JOIN (
        SELECT x.p, e, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS c
        FROM parts x JOIN near{k} n ON n.r = x.r AND n.p = x.p GROUP BY x.p, e, i
    ) m ON m.p = b.p AND m.e = b.e AND m.i = b.i
),"""
        )
    return f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r, vec_id, label,
        list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 4096) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
parts AS MATERIALIZED (
    SELECT r, k // (len(v) // 8) AS p, k % (len(v) // 8) AS i, v[k + 1] AS x
    FROM (SELECT r, v, unnest(range(len(v))) AS k FROM kept)
),
book0 AS MATERIALIZED (SELECT p, r AS e, i, x AS c FROM parts WHERE r < 16),{"".join(books)}
near AS MATERIALIZED ({_nearest(f"book{rounds}")}
),
coded AS (
    SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(far) AS BIGINT) AS error
    FROM near GROUP BY r
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY p, e, i)) FROM book{rounds})
        AS codebooks_sha256
FROM kept JOIN coded USING (r)"""



_SPACED, _LETTERS = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str, pattern: str) -> str:
    return f"regexp_extract_all({text}, '{pattern}')"


_DECONTAMINATION = f"""
WITH items AS MATERIALIZED (
    SELECT item_id, w, least(10, len(w)) AS n
    FROM (SELECT item_id, {_words(_lowered("text"), _LETTERS)} AS w FROM benchmark) WHERE len(w) > 0
),
windows AS MATERIALIZED (
    SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS words
    FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM items)
),
docs AS MATERIALIZED (
    SELECT doc_id, {_words(_lowered("text"), _LETTERS)} AS w FROM documents
),
met AS MATERIALIZED (
    SELECT DISTINCT doc_id, i, n, item_id
    FROM (
        SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS words
        FROM (
            SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
            FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n
        )
    ) JOIN windows USING (n, words)
),
hit AS (
    SELECT doc_id, count(DISTINCT place) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM met) GROUP BY doc_id
),
found AS (
    SELECT doc_id, count(*) AS n_items,
        string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
    FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)"""

# 160 bits as 32 letters: five hex digits are four letters.
_BASE32_SHA1 = """
    array_to_string(list_transform(range(32), lambda k:
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
            ((CAST('0x' || digest[(k // 4) * 5 + 1 : (k // 4) * 5 + 5] AS BIGINT)
                >> CAST(15 - 5 * (k % 4) AS INTEGER)) & 31) + 1]), '')"""

_WARC = f"""
WITH hashed AS MATERIALIZED (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS digest,
        min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
    FROM pages
)
SELECT page_id, payload_bytes, {_BASE32_SHA1} AS payload_digest,
    CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM hashed"""

_QUALITY = f"""
WITH docs AS MATERIALIZED (
    SELECT doc_id, coalesce(text, '') AS text, {_words("coalesce(text, '')", _SPACED)} AS w
    FROM documents
),
words AS MATERIALIZED (
    SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS place FROM docs
),
lines AS (
    SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) > 1 AS again
    FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
            unnest(range(len(string_split(text, chr(10))))) AS k
        FROM docs
    ) WHERE regexp_matches(line, '{_SPACED}')
),
line_counts AS (
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE again) AS n_dup_lines,
        coalesce(sum(list_sum(list_transform({_words("line", _SPACED)}, lambda x: length(x))))
            FILTER (WHERE again), 0) AS dup_chars
    FROM lines GROUP BY doc_id
),
windows AS MATERIALIZED (
    SELECT doc_id, n, i, row_number() OVER same AS nth, count(*) OVER (PARTITION BY doc_id, n, words) AS times
    FROM (
        SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS words
        FROM (
            SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i
            FROM docs, (SELECT unnest(range(5, 11)) AS n) WHERE len(w) >= n
        )
    )
    WINDOW same AS (PARTITION BY doc_id, n, words ORDER BY i)
),
inside AS (
    SELECT doc_id, n, sum(length(word)) AS chars
    FROM (
        SELECT DISTINCT doc_id, n, unnest(range(i, i + n)) AS place FROM windows WHERE nth > 1
    ) JOIN words USING (doc_id, place) GROUP BY doc_id, n
),
repeats AS (
    SELECT doc_id, count(DISTINCT place) AS n_repeat_words
    FROM (SELECT doc_id, unnest(range(i, i + 5)) AS place FROM windows WHERE n = 5 AND times > 1)
    GROUP BY doc_id
),
chars AS (SELECT doc_id, sum(length(word)) AS word_chars FROM words GROUP BY doc_id),
shares AS (
    SELECT doc_id, bool_and(inside.chars <= CAST(share AS DOUBLE) * word_chars) AS fine
    FROM inside JOIN chars USING (doc_id)
    JOIN (VALUES (5, 0.15), (6, 0.14), (7, 0.13), (8, 0.12), (9, 0.11), (10, 0.10)) limits(n, share)
        USING (n)
    GROUP BY doc_id
),
counted AS (
    SELECT doc_id, len(w) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
        CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
        len(w) < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * len(w) AS base_failed,
        coalesce(fine, true)
            AND coalesce(n_dup_lines, 0) <= CAST(0.30 AS DOUBLE) * coalesce(n_lines, 0)
            AND coalesce(dup_chars, 0) <= CAST(0.20 AS DOUBLE) * coalesce(word_chars, 0) AS fine
    FROM docs LEFT JOIN line_counts USING (doc_id) LEFT JOIN repeats USING (doc_id)
    LEFT JOIN chars USING (doc_id) LEFT JOIN shares USING (doc_id)
)
SELECT * EXCLUDE (fine), NOT base_failed AND fine AS kept FROM counted"""


def _licenses() -> str:
    phrases, templates = [], []
    for phrase, label in PHRASES.items():
        parts = phrase.split()
        here = " AND ".join(f"w[i + {k + 1}] = '{part}'" for k, part in enumerate(parts))
        phrases.append(f"SELECT doc_id, i, '{label}' AS label FROM places WHERE {here}")
    for text, label in TEMPLATES.items():
        templates.append(f"('{label}', list_distinct(string_split('{text}', ' ')))")
    return f"""
WITH docs AS MATERIALIZED (
    SELECT doc_id, {_lowered("text")} AS low, {_words(_lowered("text"), _LETTERS)} AS w FROM documents
),
places AS MATERIALIZED (SELECT doc_id, w, unnest(range(len(w))) AS i FROM docs),
base AS MATERIALIZED ({" UNION ALL ".join(phrases)}),
templates(label, own) AS (VALUES {", ".join(templates)}),
blocks AS MATERIALIZED (
    SELECT doc_id, {_words("block", _LETTERS)} AS held
    FROM (SELECT doc_id, unnest(string_split_regex(low, '[\\r\\n]+|[.!?;][\\x09-\\x0D ]+')) AS block FROM docs)
),
met AS (
    SELECT doc_id, label, max(shared / len(own)) AS share
    FROM (
        SELECT doc_id, label, own, len(list_intersect(own, held)) AS shared
        FROM blocks, templates WHERE len(held) > 0
    ) WHERE 100 * shared >= 80 * len(own) GROUP BY doc_id, label
),
labelled AS (
    SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
    FROM (SELECT doc_id, label FROM base UNION ALL SELECT doc_id, label FROM met) GROUP BY doc_id
),
based AS (
    SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
    FROM base GROUP BY doc_id
),
best AS (SELECT doc_id, max(share) AS share FROM met GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
    coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
    CAST(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(share, 0) END AS DOUBLE) AS score
FROM docs LEFT JOIN based USING (doc_id) LEFT JOIN labelled USING (doc_id) LEFT JOIN best USING (doc_id)"""


_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*://"

_URL_LISTS = rf"""
WITH captures AS MATERIALIZED (
    SELECT page_id, nullif(regexp_replace(lower(regexp_extract(
            url, '{_SCHEME}(?:[^/?#@]*@)?([^/?#:]*)', 1)), '^www\.', ''), '') AS host,
        regexp_extract(url, '{_SCHEME}[^/?#]*/([^/?#]+)', 1) AS path,
        CAST(DATE '2024-01-01' + CAST(page_id % 365 * 7919 % 365 AS INTEGER) AS DATE) AS fetched_on
    FROM pages
),
asked AS MATERIALIZED (
    SELECT page_id, 0 AS place, host || '/' || path AS pattern FROM captures WHERE path <> '' AND host IS NOT NULL
    UNION ALL
    SELECT page_id, k, array_to_string(string_split(host, '.')[k:], '.')
    FROM (
        SELECT page_id, host, unnest(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1)) AS k
        FROM captures WHERE host IS NOT NULL
    )
),
numbered AS (
    SELECT pattern, CAST('0x' || md5(pattern)[1:7] AS BIGINT) AS n
    FROM (SELECT DISTINCT pattern FROM asked)
),
spans AS (
    SELECT pattern, 'block' AS action, n % 100 AS since, 100 + n % 97 AS until FROM numbered WHERE n % 3 = 0
    UNION ALL SELECT pattern, 'block', 200 + n % 89, NULL FROM numbered WHERE n % 3 = 0
    UNION ALL SELECT pattern, 'allow', n % 300, NULL FROM numbered WHERE n % 6 = 1
),
decided AS (
    SELECT page_id, arg_min({{'pattern': pattern, 'since': since, 'action': action}}, place) AS found
    FROM (
        SELECT page_id, place, pattern, action, fetched_on,
            CAST(DATE '2024-01-01' + CAST(since AS INTEGER) AS DATE) AS since,
            CAST(DATE '2024-01-01' + CAST(until AS INTEGER) AS DATE) AS until
        FROM asked JOIN captures USING (page_id) JOIN spans USING (pattern)
    ) WHERE since <= fetched_on AND (until IS NULL OR fetched_on < until) GROUP BY page_id
)
SELECT page_id, host, fetched_on, coalesce(found.action, 'none') AS verdict, found.pattern AS pattern,
    found.since AS since
FROM captures LEFT JOIN decided USING (page_id)"""


_SUFFIX_DEDUP = """
WITH docs AS MATERIALIZED (
    SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n
    FROM documents
),
starts AS MATERIALIZED (
    SELECT doc_id, i, md5_number(b[i + 1 : i + 200]) AS string
    FROM (SELECT doc_id, b, unnest(range(n - 199)) AS i FROM docs WHERE n >= 200)
),
hits AS MATERIALIZED (
    SELECT doc_id, i, i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 AS apart
    FROM starts JOIN (SELECT string FROM starts GROUP BY string HAVING count(*) > 1) USING (string)
),
runs AS MATERIALIZED (
    SELECT doc_id, run, min(i) AS first, max(i) + 200 AS last
    FROM (
        SELECT doc_id, i, sum(CAST(coalesce(apart, true) AS INTEGER))
            OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run
        FROM hits
    ) GROUP BY doc_id, run
),
kept AS (
    -- What lies before each run, and after the last one.
    SELECT doc_id, run, lag(last, 1, 0) OVER (PARTITION BY doc_id ORDER BY run) AS first, first AS last FROM runs
    UNION ALL
    SELECT docs.doc_id, 1e9, coalesce(max(last), 0), any_value(n) FROM docs LEFT JOIN runs USING (doc_id) GROUP BY docs.doc_id
),
rests AS (
    SELECT doc_id, sha256(unhex(string_agg(hex(b[first + 1 : last]), '' ORDER BY run))) AS kept_sha256
    FROM kept JOIN docs USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
    coalesce(n_spans, 0) AS n_spans, kept_sha256
FROM docs JOIN rests USING (doc_id)
LEFT JOIN (SELECT doc_id, sum(last - first) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
    USING (doc_id)"""

ORACLE_SQL: dict[str, str] = {
    "op1_suffix_dedup": _SUFFIX_DEDUP,
    "op2_ngram_jaccard": _near_duplicates(5),
    "op4_decontamination": _DECONTAMINATION,
    "op7_warc": _WARC,
    "op8_quality_rules": _QUALITY,
    "op9_license_scan": _licenses(),
    "op10_url_lists": _URL_LISTS,
    "op11_circulant_minhash": _near_duplicates(4, ", words.id = component_id AS kept"),
    "op12_merkle_manifest": _MERKLE,
    "op13_vector_codes": _vector_codes(),
}
