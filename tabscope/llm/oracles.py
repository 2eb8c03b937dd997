"""DuckDB SQL for the queries that SQL can express."""

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_EXACT = f"""
WITH t AS (SELECT doc_id, sha256({_LOWERED}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)"""


def _family(level: str, parents: str, above: str, weight: str, budget: str) -> str:
    """Two CTEs: the children of one level with their running sums, and their amounts."""
    keys = f"{parents}, " if parents else ""
    part = f"PARTITION BY {parents}" if parents else ""
    join = f"JOIN {above} USING ({parents})" if parents else ""
    order = f"{part} ORDER BY c / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return f"""
{level}_n AS (SELECT {keys}{level}, sum(n_tokens * 3) AS c, {weight} AS w FROM leaves GROUP BY ALL),
{level}_r AS (SELECT {level}_n.*, {budget} AS b, sum(c) OVER ({order}) AS caps, sum(w) OVER ({order}) AS passed,
       sum(w) OVER ({part}) AS ws FROM {level}_n {join}),
{level}_f AS (SELECT *, (b - caps)::HUGEINT * w >= c::HUGEINT * (ws - passed) AS is_full FROM {level}_r),
{level}_a AS (SELECT {keys}{level}, CASE WHEN is_full THEN c ELSE
       (b - coalesce(sum(CASE WHEN is_full THEN c END) OVER ({part}), 0))::HUGEINT * w
       // sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({part}) END AS {level}_amount FROM {level}_f)"""


_DOMAIN = """CASE WHEN source IS NULL THEN 'unknown' WHEN regexp_full_match(source, 'src[0-9]+')
       THEN 'domain' || (substr(source, 4)::BIGINT % 4) ELSE 'other' END"""
_DOMAIN_WEIGHT = "CASE domain WHEN 'domain0' THEN 2 WHEN 'domain1' THEN 3 WHEN 'domain3' THEN 2 ELSE 1 END"
_LANGUAGE_WEIGHT = "CASE language WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 3 ELSE 1 END"

_MIX = f"""
WITH rows AS (SELECT doc_id, {_DOMAIN} AS domain, coalesce(lang, 'unknown') AS language, coalesce(source, 'unknown') AS origin,
       len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT domain, language, origin, sum(n_tokens) AS n_tokens FROM rows GROUP BY ALL),
total AS (SELECT floor(sum(n_tokens)::DOUBLE * 0.6::DOUBLE)::BIGINT AS budget FROM leaves),
{_family("domain", "", "", _DOMAIN_WEIGHT, "(SELECT budget FROM total)")},
{_family("language", "domain", "domain_a", _LANGUAGE_WEIGHT, "domain_amount")},
{_family("origin", "domain, language", "language_a", "1", "language_amount")},
amounts AS (SELECT domain, language, origin, CASE WHEN n_tokens > 0 THEN origin_amount // n_tokens ELSE 0 END AS whole,
       CASE WHEN n_tokens > 0 THEN origin_amount % n_tokens ELSE 0 END AS rest FROM leaves JOIN origin_a USING (domain, language, origin)),
placed AS (SELECT rows.*, whole, rest, ('0x' || substr(md5('7|' || (whole + 1)::BIGINT || '|' || doc_id), 1, 15))::BIGINT AS place
       FROM rows JOIN amounts USING (domain, language, origin))
SELECT doc_id, domain, language, origin, n_tokens, (whole + CASE WHEN rest > 0 AND sum(n_tokens) OVER (
       PARTITION BY domain, language, origin ORDER BY place, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= rest
       THEN 1 ELSE 0 END)::BIGINT AS copies
FROM placed"""

# The checksum bit by bit, a dynamic program over rows instead of spans, and roles told from their places in the result.
_REPAIR = r"""
WITH RECURSIVE told AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
kinds AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(name, ''), lambda x: ascii(x)::BIGINT)),
         lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)),
         4294967295) % 20 AS kind FROM told),
kept AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM kinds WHERE kind <> 0),
placed AS (
  SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS r,
         regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) AS last FROM kept),
faulty AS (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY r) > 1 THEN 'duplicate'
         WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, lag(initial) OVER (PARTITION BY conv_id ORDER BY r) AS before FROM placed),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faulty GROUP BY conv_id),
reads(p, initial, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
inserts(p, q, n) AS (VALUES (0, 0, 0), (0, 2, 1), (0, 3, 2), (1, 1, 0), (1, 2, 1), (1, 3, 2), (2, 2, 0), (2, 3, 1), (3, 3, 0), (3, 2, 1)),
edits AS (
  SELECT p, NULL AS initial, p AS q, 4 AS cost, 'D' AS letter, 'any' AS fit FROM (VALUES (0), (1), (2), (3)) s(p)
  UNION ALL SELECT p, initial, q, 0, 'K', 'own' FROM reads
  UNION ALL SELECT p, NULL, q, 3, 'R', 'sound' FROM reads WHERE initial <> 's'),
best AS (
  SELECT conv_id, 0::BIGINT AS r, 0 AS state, {'cost': 0::BIGINT, 'audit': ''} AS cell FROM counts
  UNION ALL
  SELECT conv_id, r, state, cell FROM (
    SELECT b.conv_id, f.r, e.q AS state, min({'cost': (b.cell.cost + 3 * i.n + e.cost + CASE WHEN f.fault = 'truncated' AND e.letter <> 'D' THEN 3 ELSE 0 END)::BIGINT,
           'audit': b.cell.audit || repeat('I', i.n) || e.letter}) AS cell
    FROM best b JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.r = b.r + 1
    JOIN inserts i ON i.p = b.state
    JOIN edits e ON e.p = i.q AND (e.fit = 'any' OR f.fault NOT IN ('blank', 'duplicate') AND (e.fit = 'sound' OR e.initial = f.initial))
    GROUP BY b.conv_id, f.r, e.q)),
ended AS (
  SELECT b.conv_id, min({'cost': (b.cell.cost + 3 * i.n)::BIGINT, 'audit': b.cell.audit || repeat('I', i.n)}) AS cell
  FROM best b JOIN counts c ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.r = c.n JOIN inserts i ON i.p = b.state AND i.q IN (0, 3) GROUP BY b.conv_id),
letters AS (SELECT conv_id, unnest(string_split(cell.audit, '')) AS letter, generate_subscripts(string_split(cell.audit, ''), 1) AS spot FROM ended WHERE cell.audit <> ''),
numbered AS (SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv_id ORDER BY spot) AS r FROM letters),
left_over AS (
  SELECT l.conv_id, l.spot, l.letter, f.role, f.text, row_number() OVER (PARTITION BY l.conv_id ORDER BY l.spot) AS place,
         first_value(CASE WHEN l.letter = 'K' AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.conv_id ORDER BY l.spot) AS lead
  FROM numbered l LEFT JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM l.conv_id AND f.r = l.r AND l.letter <> 'I' WHERE l.letter <> 'D'),
texts AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - lead) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''),
         chr(10) ORDER BY spot) AS text FROM left_over GROUP BY conv_id)
SELECT i.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated,
       coalesce(c.illegal, 0) AS illegal, coalesce(e.cell.cost, 0) AS cost, coalesce(e.cell.audit, '') AS audit, sha256(coalesce(t.text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM i.conv_id"""


def _codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """All distances in every round, for equally long vectors."""
    def nearest(book: str) -> str:
        return f"""SELECT x.vec_id, x.part, min({{'d': x.xx - 2 * list_dot_product(x.x, c.x) + c.xx, 'entry': c.entry}}) AS best
       FROM pieces x JOIN {book} c USING (part) GROUP BY x.vec_id, x.part"""

    steps = [f"""whole AS (SELECT vec_id, label, list_transform(embedding, lambda z: floor(1024 * z::DOUBLE)) AS x FROM embeddings
       WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0),
pieces AS MATERIALIZED (SELECT vec_id, part, x, list_dot_product(x, x) AS xx FROM (
       SELECT vec_id, part, list_slice(x, part * (len(x) // {parts}) + 1, (part + 1) * (len(x) // {parts})) AS x FROM whole, range({parts}) p(part))),
book0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x, xx FROM pieces
       QUALIFY row_number() OVER (PARTITION BY part ORDER BY vec_id) <= {entries})"""]
    for i in range(rounds):
        steps.append(f"""near{i} AS MATERIALIZED ({nearest(f"book{i}")}),
means{i} AS (SELECT part, entry, list(z ORDER BY spot) AS x FROM (
       SELECT n.part, n.best.entry AS entry, spot, floor(sum(p.x[spot]) / count(*)) AS z FROM near{i} n JOIN pieces p USING (vec_id, part), (SELECT unnest(range(1, (SELECT max(len(x)) + 1 FROM pieces))) AS spot)
       GROUP BY n.part, n.best.entry, spot) GROUP BY part, entry),
book{i + 1} AS MATERIALIZED (SELECT part, entry, x, list_dot_product(x, x) AS xx FROM (
       SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book{i} b LEFT JOIN means{i} m USING (part, entry)))""")
    return f"""WITH {", ".join(steps)},
coded AS (SELECT vec_id, string_agg(format('{{:02x}}', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM ({nearest(f"book{rounds}")}) GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda z: z::BIGINT), ','), ',' ORDER BY part, entry)) FROM book{rounds}) AS codebooks_sha256
FROM coded JOIN whole USING (vec_id)"""


ORACLES: dict[str, str] = {"op3_source_mixing": _MIX, "op9_exact_dedup": _EXACT, "op12_conversation_repair": _REPAIR, "op13_vector_codes": _codes()}
