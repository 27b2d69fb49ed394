"""SQL for DuckDB of the queries that SQL can say."""

HARD_NEGATIVES = """
WITH points AS (
    SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v,
        CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.place AS anchor, a.vec_id AS anchor_id, b.place, b.vec_id, a.label = b.label AS alike,
        list_dot_product(a.v, b.v)::BIGINT AS score
    FROM points a JOIN points b ON a.place <> b.place AND len(a.v) = len(b.v)
    WHERE a.vec_id % 100 = 0
), positives AS (
    SELECT * FROM scored WHERE alike
    QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, place) <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY n.score DESC, n.vec_id, n.place)::INTEGER AS rank
FROM positives p JOIN scored n
    ON n.anchor = p.anchor AND NOT n.alike AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10
"""

SPELLING = """
WITH RECURSIVE steps(i, k, c) AS (
    SELECT i, 0, i::BIGINT FROM range(256) t(i)
    UNION ALL
    SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8
), crc AS (
    SELECT list(c ORDER BY i) AS next FROM steps WHERE k = 8
), runs AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
    FROM documents
), counted AS (
    SELECT run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS bytes
    FROM runs GROUP BY doc_id, run
), summed AS (
    SELECT run, n, xor(list_reduce(
        list_transform(range(len(bytes) // 2), lambda i: ('0x' || substr(bytes, 2 * i + 1, 2))::BIGINT),
        lambda h, b: xor(h >> 8, next[(xor(h, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h
    FROM counted, crc
), words AS (
    SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::BIGINT AS n
    FROM summed GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3
), cut AS (
    SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM words, range(1, length(word) + 1) t(i)
), pairs AS (
    SELECT a.word, b.word AS near, a.n, b.n AS near_n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION
    SELECT c.word, w.word, c.n, w.n FROM cut c JOIN words w ON c.rest = w.word
    UNION
    SELECT w.word, c.word, w.n, c.n FROM cut c JOIN words w ON c.rest = w.word
), best AS (
    SELECT word, any_value(n) AS n, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n
    FROM pairs GROUP BY word
), forms AS (
    SELECT word, n_near, CASE WHEN near_n >= 2 * n THEN near END AS form, CASE WHEN near_n >= 2 * n THEN near_n END AS form_n FROM best
), follow(word, root, depth) AS (
    SELECT word, form, 1 FROM forms WHERE form IS NOT NULL
    UNION ALL
    SELECT f.word, g.form, depth + 1 FROM follow f JOIN forms g ON g.word = f.root WHERE g.form IS NOT NULL
), roots AS (
    SELECT word, last(root ORDER BY depth) AS root FROM follow GROUP BY word
)
SELECT word, form, coalesce(root, word) AS root, n, coalesce(n_near, 0) AS n_near, form_n
FROM words LEFT JOIN forms USING (word) LEFT JOIN roots USING (word)
"""

ORACLE: dict[str, str] = {
    "op11_hard_negatives": HARD_NEGATIVES,
    "op13_spelling": SPELLING,
}
