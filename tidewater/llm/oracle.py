"""DuckDB SQL for those text queries that SQL can express, written independently of them."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def escaped(text: str) -> str:
    """A backslash before each backslash and inside each control string."""
    out = f"replace({text}, '\\', '\\\\')"
    for a, b in (("<|", "<\\|"), ("<s>", "<\\s>"), ("</s>", "<\\/s>"), ("[INST]", "[\\INST]"), ("[/INST]", "[\\/INST]")):
        out = f"replace({out}, '{a}', '{b}')"
    return out


OP2 = f"""WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
    CAST(sum(length('<|turn|>') + length({escaped('role')}) + length('<|text|>') + length({escaped('text')}) + length('<|end|>') + 1) AS BIGINT) AS formatted_chars
  FROM said GROUP BY conv_id"""


def words(table: str, key: str) -> str:
    """(key, w: list of words) of a table."""
    return f"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}"


OP6 = f"""WITH d AS ({words('documents', 'doc_id')}), b AS ({words('benchmark', 'item_id')}),
  cut AS (SELECT item_id, w, least(len(w), 10) AS k FROM b WHERE item_id IS NOT NULL AND len(w) > 0),
  windows AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM cut)),
  seen AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM windows))),
  met AS (SELECT doc_id, k, i, item_id FROM seen JOIN windows USING (k, s)),
  hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM met) GROUP BY doc_id),
  items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY doc_id)
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
    coalesce(hit.n, 0) > 0 AS contaminated FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""

#: Five hexadecimal digits are four of base 32.
BASE32 = "list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, 1 + 5 * (i // 4), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER), 1))"

OP7 = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
  first AS (SELECT payload, max(page_id) AS last FROM p GROUP BY payload), h AS (SELECT page_id, payload, last, sha1(payload) AS h FROM p JOIN first USING (payload))
  SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, array_to_string({BASE32}, '') AS payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> last THEN last END AS refers_to FROM h"""

#: Patterns by kind, and the bytes that the last of their groups has to have at least; marks that no text has.
SECRETS = {
    "assign": (r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20), "hex": (r"[0-9a-f]+", 0, 24), "private": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0), "github": (r"gh[oprsu]_[A-Za-z0-9]{36,255}", 0, 0),
    "google": (r"AIza[A-Za-z0-9_-]{35}", 0, 0), "slack": (r"xox[abeoprs]-[A-Za-z0-9-]{10,250}", 0, 0), "web_token": (r"eyJ[A-Za-z0-9_-]{8,1000}\.eyJ[A-Za-z0-9_-]{8,1000}\.[A-Za-z0-9_-]{8,1000}", 0, 0),
    "payment": (r"[rs]k_live_[A-Za-z0-9]{16,250}", 0, 0), "login": (r"(https?|ftp|postgres|postgresql|mysql|mongodb|redis|amqp)://[A-Za-z0-9._%+-]{1,250}:[A-Za-z0-9._%+-]{1,250}@", 0, 0),
}
OPEN, CLOSE = "chr(57344)", "chr(57345)"


def matches(kind: str, place: int) -> str:
    """(r, kind, place, a, b): matches of a kind, found by marking them and adding the lengths of what lies before."""
    pattern, group, least = SECRETS[kind]
    quoted = pattern.replace("'", "''")
    return f"""SELECT r, '{kind}' AS kind, {place} AS place, a, a + length(m) AS b FROM (
      SELECT r, i, split_part(part, {CLOSE}, 1) AS m, sum(length(part) - CAST(i > 1 AS INT)) OVER (PARTITION BY r ORDER BY i) - length(part) + CAST(i > 1 AS INT) AS a FROM (
        SELECT r, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM (
          SELECT r, string_split(regexp_replace(t, '{quoted}', {OPEN} || '\\0' || {CLOSE}, 'g'), {OPEN}) AS parts FROM d WHERE regexp_matches(t, '{quoted}'))))
    WHERE i > 1 AND strlen(regexp_extract(m, '{quoted}', {group})) >= {least}"""


SPAN = "string_agg({} kind || ':' || CAST(a AS BIGINT) || ':' || CAST(b AS BIGINT), ',' ORDER BY a, place)"
OP11 = f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
  s AS ({' UNION ALL '.join(matches(k, i) for i, k in enumerate(SECRETS))}),
  told AS (SELECT r, count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex,
    {SPAN.format('')} FILTER (place < 3) AS base, {SPAN.format('')} AS spans FROM s GROUP BY r)
  SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN told USING (r)"""

SHIFT = "CASE WHEN {0} & 1 = 1 THEN xor(3988292384, {0} >> 1) ELSE {0} >> 1 END"


def edit(way: str, cost: str, letter: str) -> str:
    """A path, cost and edits as one text that sorts like them, with an edit more."""
    return f"lpad(CAST(CAST({way}[:15] AS BIGINT) + {cost} AS VARCHAR), 15, '0') || {way}[16:] || {letter}"


NEVER12 = 1 << 40
FIRST, LEGAL = "'000000000000000'", "('su', 'ua', 'au')"
I2 = f"least(c2, {', '.join(edit(c, '3', chr(39) + 'I' + chr(39)) for c in ('c0', 'c1', 'c3'))})"
I3 = f"least(c3, {edit('c2', '3', chr(39) + 'I' + chr(39))}, {edit('c0', '6', chr(39) + 'II' + chr(39))}, {edit('c1', '6', chr(39) + 'II' + chr(39))})"
GONE = lambda c: edit(c, "4", "'D'")
KEPT = lambda c, x: edit(c, f"more + (CASE WHEN x = '{x}' THEN 0 ELSE 3 END)", f"(CASE WHEN x = '{x}' THEN 'K' ELSE 'R' END)")
OP12 = f"""WITH RECURSIVE one AS (SELECT i, {SHIFT.format('i')} AS c FROM range(256) t(i)),
  two AS (SELECT i, {SHIFT.format('c')} AS c FROM one), three AS (SELECT i, {SHIFT.format('c')} AS c FROM two), four AS (SELECT i, {SHIFT.format('c')} AS c FROM three),
  five AS (SELECT i, {SHIFT.format('c')} AS c FROM four), six AS (SELECT i, {SHIFT.format('c')} AS c FROM five), seven AS (SELECT i, {SHIFT.format('c')} AS c FROM six), eight AS (SELECT i, {SHIFT.format('c')} AS c FROM seven),
  crc AS MATERIALIZED (SELECT list(CAST(c AS BIGINT) ORDER BY i) AS t FROM eight),
  key AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
  kind AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(k, ''), lambda c: CAST(ord(c) AS BIGINT))), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])), 4294967295) % 20 AS f FROM key, crc),
  bad AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN f = 3 THEN [0, 1] ELSE [0] END) AS copy FROM kind WHERE f <> 0),
  placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS seq FROM bad),
  first AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY seq) AS nth, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY seq) AS before, substr(role, 1, 1) AS x FROM placed),
  rows AS MATERIALIZED (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b' WHEN nth > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 't' ELSE '-' END AS fault FROM first),
  asked AS MATERIALIZED (SELECT conv_id, seq, x, CASE WHEN fault IN ('b', 'd') THEN {NEVER12} WHEN fault = 't' THEN 3 ELSE 0 END AS more FROM rows),
  walk AS (SELECT conv_id, CAST(0 AS BIGINT) AS seq, {FIRST} AS c0, lpad('{NEVER12}', 15, '0') AS c1, lpad('{NEVER12}', 15, '0') AS c2, lpad('{NEVER12}', 15, '0') AS c3 FROM (SELECT DISTINCT conv_id FROM asked)
    UNION ALL SELECT conv_id, seq, {GONE('c0')}, least({GONE('c1')}, {edit('c0', f"more + (CASE WHEN x = 's' THEN 0 ELSE {NEVER12} END)", "'K'")}),
      least({GONE('i2')}, {KEPT('c0', 'u')}, {KEPT('c1', 'u')}, {KEPT('i3', 'u')}), least({GONE('i3')}, {KEPT('i2', 'a')})
    FROM (SELECT w.conv_id, a.seq, a.x, a.more, c0, c1, {I2} AS i2, {I3} AS i3 FROM walk w JOIN asked a ON w.conv_id IS NOT DISTINCT FROM a.conv_id AND a.seq = w.seq + 1)),
  best AS (SELECT w.conv_id, least(c0, {I3}) AS p FROM walk w JOIN (SELECT conv_id, max(seq) AS n FROM asked GROUP BY conv_id) l ON w.conv_id IS NOT DISTINCT FROM l.conv_id AND w.seq = l.n),
  steps AS (SELECT conv_id, unnest(string_split(p[16:], '')) AS e, generate_subscripts(string_split(p[16:], ''), 1) AS i FROM best WHERE length(p) > 15),
  told AS (SELECT conv_id, e, i, sum(CAST(e <> 'I' AS INT)) OVER v AS seq, sum(CAST(e <> 'D' AS INT)) OVER v - 1 AS place FROM steps WINDOW v AS (PARTITION BY conv_id ORDER BY i)),
  lined AS (SELECT t.conv_id, t.i, CASE e WHEN 'K' THEN r.role || ':' || r.text WHEN 'R' THEN 'R:' || r.text ELSE 'R:' END AS line, t.place, max(CAST(e = 'K' AND r.x = 's' AS INT)) OVER (PARTITION BY t.conv_id) AS lead
    FROM told t LEFT JOIN rows r ON t.conv_id IS NOT DISTINCT FROM r.conv_id AND r.seq = t.seq AND e <> 'I' WHERE e <> 'D'),
  final AS (SELECT conv_id, sha256(string_agg(CASE WHEN line[:2] = 'R:' THEN (CASE WHEN (place - lead) % 2 = 0 THEN 'user' ELSE 'assistant' END) || line[2:] ELSE line END, chr(10) ORDER BY i)) AS digest FROM lined GROUP BY conv_id),
  faults AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (seq > 1 AND before || x NOT IN {LEGAL}) AS illegal FROM rows GROUP BY conv_id)
  SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    CAST(coalesce(p[:15], '0') AS BIGINT) AS cost, coalesce(p[16:], '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
  FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN faults f ON c.conv_id IS NOT DISTINCT FROM f.conv_id LEFT JOIN best b ON c.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN final d ON c.conv_id IS NOT DISTINCT FROM d.conv_id"""

#: Squared distances times 16 plus the entry: the least one is the nearest, ties going to the lower entry.
NEAR13 = """a{0} AS MATERIALIZED (SELECT r, p, min(de) AS de FROM (SELECT r, c.p, sum((c.x - b.x) * (c.x - b.x)) * 16 + e AS de FROM c JOIN b{0} b USING (p, i) GROUP BY r, c.p, e) GROUP BY r, p)"""
MEAN13 = """b{1} AS MATERIALIZED (SELECT b.p, b.e, b.i, coalesce(n.x, b.x) AS x FROM b{0} b LEFT JOIN (
    SELECT p, CAST(de % 16 AS BIGINT) AS e, i, CAST(floor(sum(c.x) / count(*)) AS BIGINT) AS x FROM c JOIN a{0} USING (r, p) GROUP BY ALL) n USING (p, e, i))"""
ROUNDS13 = ", ".join(f"{NEAR13.format(i)}, {MEAN13.format(i, i + 1)}" for i in range(6))
OP13 = f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, embedding AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  c AS MATERIALIZED (SELECT r, (j - 1) // (n // 8) AS p, (j - 1) % (n // 8) AS i, CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM (SELECT r, len(v) AS n, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM kept)),
  b0 AS MATERIALIZED (SELECT p, r - 1 AS e, i, x FROM c WHERE r <= 16), {ROUNDS13}, {NEAR13.format(6)},
  coded AS (SELECT r, string_agg(printf('%02x', CAST(de % 16 AS INT)), '' ORDER BY p) AS code, CAST(sum(de // 16) AS BIGINT) AS error FROM a6 GROUP BY r),
  books AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) AS h FROM b6)
  SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM kept JOIN coded USING (r), books"""

SQL = {"op2_chat": OP2, "op6_decontaminate": OP6, "op7_warc": OP7, "op11_secrets": OP11, "op12_repair": OP12, "op13_vectors": OP13}
