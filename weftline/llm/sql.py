"""SQL, for DuckDB, that gives the same rows as the queries that SQL can express."""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

OP6 = rf"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END AS s
  FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id, doc_id AS c FROM sets UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.c = links.a),
least AS (SELECT doc_id, min(c) AS c FROM reach GROUP BY doc_id)
SELECT doc_id, len(s) AS n_shingles, c AS component_id, doc_id = c AS kept FROM sets JOIN least USING (doc_id)
"""

OP9 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5(concat_ws(':', doc_id::VARCHAR, md5(text), (row_number() OVER (PARTITION BY doc_id, source, text) - 1)::VARCHAR, '17')) AS draw
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_rows FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM s),
f AS (SELECT *, (2 * source_size)::DOUBLE / weight AS full_at FROM w),
l AS (
  SELECT *, row_number() OVER (ORDER BY full_at, source NULLS LAST) AS place, (1.5::DOUBLE * (SELECT sum(source_size) FROM s)::DOUBLE
      - coalesce(sum(2 * source_size) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
      / (sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM f),
t AS (SELECT source, source_size, n_rows, least((2 * source_size)::DOUBLE, (SELECT min_by(level, place) FROM l WHERE level <= full_at) * weight) AS target FROM l),
m AS (SELECT floor(1.5::DOUBLE * sum(source_size)::DOUBLE + 0.5)::BIGINT AS blocks FROM t),
g AS (
  SELECT d.*, source_size, target,
    ('0x' || substr(draw, 1, 8))::BIGINT % greatest(ceil(source_size::DOUBLE / 200000)::BIGINT, ceil(n_rows::DOUBLE / 20000)::BIGINT) AS shard
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
h AS (
  SELECT source, shard, sum(size)::BIGINT AS shard_size, coalesce(any_value(target) * sum(size)::BIGINT / nullif(any_value(source_size), 0), 0) AS votes
  FROM g GROUP BY source, shard),
-- no shard wins more than its rounded share of all blocks and half a block for each shard
k AS (
  SELECT source, shard, votes / (2 * unnest(range(1, floor(votes * (blocks + n / 2.0 + 2) / total + 2)::BIGINT)) - 1) AS quotient
  FROM h, m, (SELECT sum(votes) AS total, count(*)::DOUBLE AS n FROM h) WHERE votes > 0),
z AS (
  SELECT source, shard, count(*) AS quota
  FROM (SELECT *, row_number() OVER (ORDER BY quotient DESC, source NULLS LAST, shard) AS place FROM k) WHERE place <= (SELECT blocks FROM m)
  GROUP BY source, shard),
b AS (
  SELECT *, greatest(ceil(shard_size::DOUBLE / block)::BIGINT, 1) AS n_blocks, quota % greatest(shard_size, 1) AS rest, quota // greatest(shard_size, 1) AS times
  FROM (
    SELECT h.source, h.shard, shard_size, greatest(1, least(128, shard_size // 64)) AS block, least(coalesce(quota, 0), 2 * shard_size) AS quota,
      ('0x' || substr(md5(concat_ws(':', h.source, h.shard::VARCHAR, '17')), 1, 8))::BIGINT AS start
    FROM h LEFT JOIN z ON h.source IS NOT DISTINCT FROM z.source AND h.shard = z.shard)),
p AS (SELECT *, (sum(size) OVER (PARTITION BY source, shard ORDER BY draw ROWS UNBOUNDED PRECEDING))::BIGINT AS stop FROM g),
r AS (SELECT p.*, n_blocks, block, rest, times, start, stop - size AS begin FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source AND p.shard = b.shard),
-- a row for each stretch of a document's words: its place in the permutation, and how many of its words count
q AS (
  SELECT *, (j * 2147483647 + start) % n_blocks AS place
  FROM (SELECT *, unnest(range(begin // block, CASE WHEN size = 0 THEN begin // block ELSE (stop - 1) // block + 1 END)) AS j FROM r)),
w2 AS (
  SELECT draw, sum(greatest(0, least(stop, j * block + CASE WHEN place < rest // block THEN block WHEN place = rest // block THEN rest % block ELSE 0 END) - greatest(begin, j * block))) AS words
  FROM q GROUP BY draw)
SELECT doc_id, size, source_size, target, (times * size + coalesce(words, 0))::BIGINT AS taken FROM r LEFT JOIN w2 USING (draw)
"""

OP8 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest FROM p),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS last FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < last THEN last END AS refers_to
FROM m
"""


def op3(known: dict[str, str], alike: list[tuple[str, str]], title: str, copyright: str, number: str, not_word: str) -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"  # noqa: E731

    def canonical(column: str) -> str:
        out = f"regexp_replace(translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {quoted(title)}, chr(10))"
        out = f"regexp_replace(regexp_replace({out}, {quoted(copyright)}, chr(10), 'g'), {quoted(number)}, chr(10), 'g')"
        for other, usual in alike:
            out = f"replace({out}, {quoted(other)}, {quoted(usual)})"
        return f"sha256(trim(regexp_replace({out}, {quoted(not_word)}, ' ', 'g')))"

    rows = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in known.items())
    return f"""
    WITH known AS (SELECT {canonical("text")} AS d, min(license_id) AS license_id FROM (VALUES {rows}) t(license_id, text) GROUP BY 1),
    docs AS (SELECT doc_id, {canonical("text")} AS license_digest FROM documents)
    SELECT doc_id, license_digest, license_id FROM docs LEFT JOIN known ON d = license_digest
    """


OP5 = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id, vec_id AS c FROM embeddings UNION SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.c = links.a),
least AS (SELECT vec_id, min(c) AS c FROM reach GROUP BY vec_id),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept FROM least LEFT JOIN counts ON a = vec_id
"""


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11 = rf"""
WITH d AS (SELECT doc_id, {_TERMS} AS w FROM documents), c AS (SELECT doc_id, w, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
g AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM c),
tf AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM c) GROUP BY doc_id, n, term),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
q AS (SELECT item_id, term, count(*)::BIGINT AS k FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY item_id, term),
x AS (SELECT item_id, term, k * floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS weight FROM q JOIN df USING (term), g),
s AS (
  SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))))::BIGINT AS score
  FROM x JOIN tf USING (term), g GROUP BY item_id, doc_id)
SELECT * FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0) WHERE rank <= 20
"""


def op13() -> str:
    """Rows are repaired from the last to the first; each state holds its least (cost, audit) and the text behind it."""
    step = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    into = {0: 2, 1: 2, 2: 3, 3: 2}
    role = {2: "user", 3: "assistant"}
    never = "{'cost': 1000000000000::BIGINT, 'audit': '', 'text': NULL::VARCHAR}"

    def then(after: str, cost: str, letter: str, line: str | None) -> str:
        text = f"{after}.text" if line is None else f"{line} || coalesce(chr(10) || {after}.text, '')"
        return f"{{'cost': ({after}.cost + {cost})::BIGINT, 'audit': '{letter}' || {after}.audit, 'text': {text}}}"

    own = "role || ':' || text"

    def taken(s: int) -> str:
        keep = " ".join(f"WHEN init = '{c}' THEN {then(f'a[{t + 1}]', 'cut', 'K', own)}" for c, t in step[s].items())
        t = into[s]
        rerole = then(f"a[{t + 1}]", "2 + cut", "R", f"'{role[t]}:' || text")
        return f"list_min([{then(f'a[{s + 1}]', '3', 'D', None)}, CASE WHEN must THEN {never} {keep} ELSE {never} END, CASE WHEN must THEN {never} ELSE {rerole} END])"

    def put_in(s: int, after: str) -> str:
        return then(f"{after}[{into[s] + 1}]", "2", "I", f"'{role[into[s]]}:'")

    # inserts before a row: first into the two states that lead on, then into the others
    first = f"[b[1], b[2], list_min([b[3], {put_in(2, 'b')}]), list_min([b[4], {put_in(3, 'b')}])]"
    closed = f"[list_min([i[1], {put_in(0, 'i')}]), list_min([i[2], {put_in(1, 'i')}]), i[3], i[4]]"
    nothing = "{'cost': 0::BIGINT, 'audit': '', 'text': NULL::VARCHAR}"
    return rf"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
bits AS (
  SELECT key, 0 AS i, 4294967295::BIGINT AS c FROM (SELECT DISTINCT key FROM k)
  UNION ALL SELECT key, i + 1, xor(x // 2, 3988292384::BIGINT * (x % 2))
  FROM (SELECT key, i, CASE WHEN i % 8 = 0 THEN xor(c, unicode(substr(key, i // 8 + 1, 1))::BIGINT) ELSE c END AS x FROM bits WHERE i < 8 * length(key))),
h AS (SELECT key, xor(c, 4294967295::BIGINT) % 20 AS harm FROM bits WHERE i = 8 * length(key)),
r AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role, CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE harm WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM k JOIN h USING (key)),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS p,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, NOT regexp_matches(text, '[^ 	-]') AS blank
  FROM r),
f AS (
  SELECT conv_id, turn, role, text, p, blank, NOT blank AND nth > 1 AS again, blank OR nth > 1 AS must, left(role, 1) AS init,
    (NOT blank AND nth = 1 AND regexp_matches(text, '[^.!? 	-][ 	-]*$'))::INT AS cut
  FROM o),
n AS (SELECT conv_id, coalesce(max(p), 0) AS n FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN f USING (conv_id) GROUP BY conv_id),
ends AS (SELECT conv_id, n + 1 AS p, {first.replace('b[1]', nothing).replace('b[2]', never).replace('b[3]', never).replace('b[4]', nothing)} AS i FROM n),
g AS (
  SELECT conv_id, p, {closed} AS a FROM ends
  UNION ALL SELECT conv_id, p, {closed}
  FROM (SELECT conv_id, p, {first} AS i FROM (SELECT g.conv_id, f.p, [{', '.join(map(taken, range(4)))}] AS b FROM g JOIN f ON f.conv_id = g.conv_id AND f.p = g.p - 1))),
e AS (SELECT conv_id, a[1] AS best FROM g WHERE p = 1),
pairs AS (SELECT conv_id, count(*) FILTER (WHERE before || init NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT conv_id, init, lag(init) OVER (PARTITION BY conv_id ORDER BY p) AS before FROM f) GROUP BY conv_id),
faults AS (
  SELECT conv_id, (coalesce(max(turn) - min(turn) + 1, 0) - count(DISTINCT turn))::BIGINT AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again) AS duplicate, sum(cut)::BIGINT AS truncated
  FROM f GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, best.cost AS cost, best.audit AS audit, sha256(coalesce(best.text, '')) AS repaired_sha256
FROM e LEFT JOIN faults USING (conv_id) LEFT JOIN pairs USING (conv_id)
"""
