"""SQL for the rows of the queries that SQL can express on whole tables, stated without the operators' methods."""

FILL_IN_MIDDLE = r"""
WITH units AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS h FROM documents
), drawn AS (
    SELECT doc_id, text, u, len(u) AS n, list_transform(range(4), lambda k: CAST('0x' || substr(h, CAST(8 * k + 1 AS BIGINT), 8) AS BIGINT)) AS d FROM units
), cut AS (
    SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS low, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS high,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 90 THEN 'plain' WHEN d[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
    SELECT *, array_to_string(u[1:low], '') AS p, array_to_string(u[low + 1:high], '') AS m, array_to_string(u[high + 1:n], '') AS s FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts
"""

#: The table of CRC-32 is made from its polynomial.
INTERVAL_JOIN = """
WITH crc AS (
    SELECT list(list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) x(i)
), timed AS (
    SELECT client_id, ts, coalesce(kind = 'click', false) AS click, coalesce(ts - lag(ts) OVER (PARTITION BY client_id ORDER BY ts) > INTERVAL 5 MINUTE, true) AS begins FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL
), numbered AS (
    SELECT client_id, ts, click, sum(CAST(begins AS INTEGER)) OVER (PARTITION BY client_id ORDER BY ts) AS session FROM timed
), runs AS (
    SELECT client_id, min(ts) AS first, max(ts) AS last, bool_or(click) FILTER (WHERE at_end) AS open FROM (SELECT *, ts = max(ts) OVER (PARTITION BY client_id, session) AS at_end FROM numbered) GROUP BY client_id, session
), sessions AS (
    SELECT client_id, CAST(floor(epoch_us(first) / 86400000000) AS BIGINT) AS a, CASE WHEN open THEN 9000000000 ELSE CAST(floor(epoch_us(last) / 86400000000) AS BIGINT) END AS b,
        xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(epoch_us(first) AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS crc
    FROM runs, crc
), held AS (
    SELECT sale_id, client_id, CAST(floor(epoch_us(sold_at) / 86400000000) AS BIGINT) AS a, CASE WHEN status = 'held' THEN 9000000000 ELSE CAST(floor(epoch_us(greatest(sold_at, coalesce(shipped, sold_at))) / 86400000000) AS BIGINT) END AS b
    FROM sales LEFT JOIN (SELECT sale_id, max(shipped_at) AS shipped FROM sale_lines GROUP BY sale_id) USING (sale_id) WHERE client_id IS NOT NULL AND sold_at IS NOT NULL
), pairs AS (
    SELECT sale_id, CASE WHEN v.a < s.a THEN CASE WHEN v.b < s.b THEN 'overlaps' WHEN v.b = s.b THEN 'finished_by' ELSE 'contains' END
        WHEN v.a = s.a THEN CASE WHEN v.b < s.b THEN 'starts' WHEN v.b = s.b THEN 'equals' ELSE 'started_by' END
        ELSE CASE WHEN v.b < s.b THEN 'during' WHEN v.b = s.b THEN 'finishes' ELSE 'overlapped_by' END END AS relation,
        CASE WHEN least(v.b, s.b) < 9000000000 THEN least(v.b, s.b) - greatest(v.a, s.a) + 1 END AS shared, crc
    FROM held v JOIN sessions s ON v.client_id = s.client_id AND v.a <= s.b AND s.a <= v.b
)
SELECT sale_id, relation, count(*) AS n_pairs, CAST(sum(shared) AS BIGINT) AS overlap_slots, CAST(sum(crc) AS BIGINT) AS sessions_crc FROM pairs GROUP BY sale_id, relation
"""

EXACT_DEDUP = r"""
WITH texts AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents
), ranked AS (
    SELECT doc_id, bare, first_value(doc_id) OVER (PARTITION BY bare ORDER BY length(text) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size FROM texts
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(bare) AS text_sha256 FROM ranked
"""

ORACLE_SQL = {"op11_fill_in_middle": FILL_IN_MIDDLE, "op12_interval_join": INTERVAL_JOIN, "op13_exact_dedup": EXACT_DEDUP}
