"""SQL for the queries whose operators SQL can express, over whole tables."""

from __future__ import annotations

from .license_scan import BASE_NOTICES
from .secrets import BASE_RULES, RULES, Rule


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _spans(number: int, rule: Rule) -> str:
    """(rid, rule, start, stop): stretches between matches add up to offsets."""
    pattern = _text(rule.pattern)
    return f"""SELECT rid, {number} AS rule, upto - length(whole) AS start, upto AS stop FROM (
  SELECT *, sum(length(gap) + length(whole)) OVER (PARTITION BY rid ORDER BY i) AS upto FROM (
    SELECT rid, unnest(range(len(m))) AS i, unnest(m) AS whole, unnest(g) AS grp, unnest(p[1:len(m)]) AS gap FROM (
      SELECT rid, regexp_extract_all(t, {pattern}) AS m, regexp_extract_all(t, {pattern}, {rule.group}) AS g, string_split_regex(t, {pattern}) AS p FROM d WHERE regexp_matches(t, {pattern}))))
  WHERE length(grp) >= {rule.least}"""


def _secrets() -> str:
    kinds = "[" + ", ".join(_text(r.kind) for r in RULES) + "]"
    part = f"{kinds}[rule + 1] || ':' || start || ':' || stop"
    base = len(BASE_RULES)
    counts = ", ".join(f"count(*) FILTER (WHERE rule = {i}) AS n_{r.kind}" for i, r in enumerate(BASE_RULES))
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(_spans(i, r) for i, r in enumerate(RULES))})
SELECT any_value(doc_id) AS doc_id, {counts}, sha256(coalesce(string_agg({part}, ',' ORDER BY start, rule) FILTER (WHERE rule < {base}), '')) AS base_sha256,
coalesce(string_agg({part}, ',' ORDER BY start, rule) FILTER (WHERE rule IS NOT NULL), '') AS spans FROM d LEFT JOIN s USING (rid) GROUP BY rid"""


def _dedup(width: int = 35) -> str:
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT rid, i, md5(array_to_string(w[i:i + {width - 1}], ' ')) AS k FROM (SELECT rid, w, unnest(range(1, len(w) - {width - 2})) AS i FROM d WHERE len(w) >= {width})),
twice AS (SELECT k FROM windows GROUP BY k HAVING count(*) > 1),
begins AS (SELECT rid, i FROM windows JOIN twice USING (k)),
words AS (SELECT rid, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d),
marked AS (SELECT words.rid, words.i, word, max(CASE WHEN begins.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY words.rid ORDER BY words.i ROWS BETWEEN {width - 1} PRECEDING AND CURRENT ROW) AS gone FROM words LEFT JOIN begins ON begins.rid = words.rid AND begins.i = words.i),
summed AS (SELECT rid, sum(gone) AS n, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM marked GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN summed USING (rid)"""


def _base_licenses() -> str:
    places = " UNION ALL ".join(
        f"SELECT rid, i, {_text(n.label)} AS label FROM words WHERE w[i + 1:i + {len(n.phrase.split())}] = [{', '.join(map(_text, n.phrase.split()))}]" for n in BASE_NOTICES
    )
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
words AS (SELECT rid, w, unnest(range(len(w))) AS i FROM d), places AS ({places})
SELECT any_value(doc_id) AS doc_id, any_value(len(w))::BIGINT AS n_words, count(i) AS n_base, min(i) AS first_word, max(i) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels FROM d LEFT JOIN places USING (rid) GROUP BY rid"""


#: crc32 by its table, byte after byte; xor(list_reduce(bytes, crc32 step, start), start) is the sum.
_CRC_TABLE = "crcs AS MATERIALIZED (SELECT list(c ORDER BY byte) AS t FROM (SELECT byte, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, byte) AS c FROM (SELECT unnest(range(256)) AS byte)))"


def _held_out(n: int, rest: int, more: str) -> str:
    """Folds by the crc32 of the id's digits."""
    digits = "list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i::INT, 1)))"
    return f"WITH {_CRC_TABLE} SELECT doc_id, xor(list_reduce({digits}, lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]), 4294967295::BIGINT), 4294967295) % {n} = {rest} AS held_out, {more} FROM documents, crcs"


def _resampling(percent: int = 25, least: int = 20, buckets: int = 10_000, seed: int = 7) -> str:
    """Features are hashed once each."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {words} AS w FROM documents),
b AS (SELECT -row_number() OVER () AS rid, {words} AS w FROM benchmark),
f AS MATERIALIZED (SELECT rid, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS feature FROM (SELECT rid, w FROM d UNION ALL SELECT rid, w FROM b)),
{_CRC_TABLE},
octets AS (SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM f)),
hashed AS MATERIALIZED (SELECT feature, xor(list_reduce(list_transform(range(0, len(h) // 2), lambda i: (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1),
  lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]), 4294967295::BIGINT), 4294967295) % {buckets} AS bucket FROM octets, crcs),
g AS MATERIALIZED (SELECT rid, bucket FROM f JOIN hashed USING (feature)),
counts AS (SELECT bucket, count(*) FILTER (WHERE rid > 0) AS s, count(*) FILTER (WHERE rid < 0) AS t FROM g GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM counts)::DOUBLE + {buckets}) / ((s + 1) * ((SELECT sum(t) FROM counts)::DOUBLE + {buckets})))) AS gain FROM counts),
means AS (SELECT rid, count(*) AS n, floor(sum(gain) / count(*))::BIGINT AS weight FROM g JOIN gains USING (bucket) WHERE rid > 0 GROUP BY rid),
scored AS (SELECT rid, doc_id, len(w) AS words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN means USING (rid)),
pool AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id, rid) AS place, count(*) OVER () AS all_rows FROM scored WHERE words >= {least} AND score IS NOT NULL)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN place <= {percent} * all_rows // 100 THEN place END AS rank FROM scored LEFT JOIN pool USING (rid)"""


def oracle_sql() -> dict[str, str]:
    return {
        "base_licenses": _base_licenses(), "op7_substring_dedup": _dedup(), "op9_secrets": _secrets(), "op13_importance_resampling": _resampling(),
        "quality_held_out": _held_out(4, 2, "true AS consistent"), "language_held_out": _held_out(5, 0, r"NOT regexp_matches(coalesce(text, ''), '\p{L}') AS unknown, true AS consistent"),
    }
