"""DuckDB SQL that must give the rows of the queries it is named after."""

from __future__ import annotations

from siteledger.llm.licenses import BAND, SHARE, STANDARD, gram_rows


def _level(name: str, parents: list[str], weight: str, up: str) -> str:
    """Common table expressions that share `up`'s quotas among the children at level `name`."""
    keys = ", ".join([*parents, name])
    part = f"PARTITION BY {', '.join(parents)}" if parents else ""
    join = " AND ".join(f"n.{p} IS NOT DISTINCT FROM u.{p}" for p in parents) or "TRUE"
    budget = "u.quota" if parents else "u.budget"
    return f"""
{name}_nodes AS (
  SELECT n.*, {budget}::HUGEINT AS budget FROM (
    SELECT {keys}, SUM(cap)::HUGEINT AS cap, ({weight})::HUGEINT AS weight FROM leaves GROUP BY {keys}
  ) n JOIN {up} u ON {join} WHERE n.cap > 0 AND n.weight > 0),
{name}_order AS (
  SELECT *,
    COALESCE(SUM(cap) OVER ({part} ORDER BY cap / weight, {name} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS taken,
    SUM(weight) OVER ({part} ORDER BY cap / weight, {name} NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS opened
  FROM {name}_nodes),
{name}_full AS (SELECT *, cap * opened <= (budget - taken) * weight AS is_full FROM {name}_order),
{name}_sums AS (
  SELECT *, SUM(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({part})::HUGEINT AS filled,
    SUM(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({part})::HUGEINT AS weights
  FROM {name}_full),
{name}_given AS (
  SELECT {keys}, CASE WHEN is_full THEN cap ELSE (budget - filled) * weight // weights END AS quota
  FROM {name}_sums)"""


OP1 = rf"""
WITH tokens AS (
  SELECT doc_id, lang, source,
    CASE WHEN source IN ('src0', 'src3', 'src6', 'src9') THEN 'web'
      WHEN source IN ('src1', 'src4', 'src7', 'src10') THEN 'reference' ELSE 'forum' END AS domain,
    LEN(REGEXP_EXTRACT_ALL(text, '[^\x20\x09-\x0D]+'))::BIGINT AS n,
    CAST('0x' || LEFT(MD5('17:' || doc_id), 8) AS BIGINT) AS place
  FROM documents),
docs AS (SELECT *, place % 4096 AS slice FROM tokens WHERE n > 0),
leaves AS (
  SELECT domain, lang, source, SUM(n)::HUGEINT AS tokens, SUM(n)::HUGEINT * 2 AS cap
  FROM docs GROUP BY domain, lang, source),
top AS (SELECT FLOOR(SUM(tokens)::DOUBLE * 0.6) AS budget FROM leaves),
{_level("domain", [], "CASE domain WHEN 'web' THEN 5 WHEN 'reference' THEN 3 ELSE 2 END", "top")},
{_level("lang", ["domain"], "CASE lang WHEN 'en' THEN 6 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END", "domain_given")},
{_level("source", ["domain", "lang"], "CASE source WHEN 'src0' THEN 3 ELSE 1 END", "lang_given")},
shares AS (
  SELECT l.domain, l.lang, l.source, (quota // tokens)::BIGINT AS passes, (quota % tokens)::BIGINT AS rest
  FROM leaves l JOIN source_given g
    ON l.domain IS NOT DISTINCT FROM g.domain AND l.lang IS NOT DISTINCT FROM g.lang AND l.source IS NOT DISTINCT FROM g.source
  WHERE quota > 0),
ordered AS (
  SELECT d.*, s.passes, s.rest,
    SUM(n) OVER (PARTITION BY d.domain, d.lang, d.source ORDER BY slice, place, doc_id, n
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT - n AS before
  FROM docs d JOIN shares s
    ON d.domain IS NOT DISTINCT FROM s.domain AND d.lang IS NOT DISTINCT FROM s.lang AND d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, domain, lang, source, UNNEST(RANGE(passes)) AS epoch, n AS tokens, n AS taken FROM ordered
UNION ALL
SELECT doc_id, domain, lang, source, passes AS epoch, n AS tokens, LEAST(n, rest - before) AS taken
FROM ordered WHERE before < rest
"""

OP4 = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents),
w AS (
  SELECT doc_id, norm, MAX(doc_id) OVER (PARTITION BY norm) AS keep_id,
    COUNT(*) OVER (PARTITION BY norm) AS group_size,
    ROW_NUMBER() OVER (PARTITION BY norm ORDER BY doc_id DESC) AS place
  FROM d)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM w
"""



def _crc32(text: str) -> str:
    """crc32 of an ASCII text, one bit of the shift register after the other."""
    bits = f"FLATTEN([[ASCII(c), 0, 0, 0, 0, 0, 0, 0] FOR c IN STRING_SPLIT({text}, '')])"
    step = "xor(xor(s, e) >> 1, 3988292384 * (xor(s, e) & 1))"
    return f"xor(LIST_REDUCE(LIST_TRANSFORM({bits}, lambda e: e::BIGINT), lambda s, e: {step}, 4294967295::BIGINT), 4294967295)"


def _encoded(column: str) -> str:
    return f"COALESCE(STRLEN({column}::VARCHAR)::VARCHAR || ':' || {column}::VARCHAR, '-')"


def _tree(name: str, leaves: str, scope: str) -> str:
    """Levels of every tree in `leaves` (scope, pos, digest), and each node's siblings in its run."""
    return f"""
{name}_levels AS (
  SELECT {scope}, 0 AS lvl, pos, digest, COUNT(*) OVER (PARTITION BY {scope}) AS n FROM {leaves}
  UNION ALL
  SELECT {scope}, lvl + 1, pos // 8, sha256(STRING_AGG(digest, '' ORDER BY pos)), ANY_VALUE((n + 7) // 8)
  FROM {name}_levels WHERE n > 1 GROUP BY {scope}, lvl, pos // 8),
{name}_runs AS (
  SELECT *, COALESCE(STRING_AGG(digest, '') OVER (PARTITION BY {scope}, lvl, pos // 8 ORDER BY pos
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    COALESCE(STRING_AGG(digest, '') OVER (PARTITION BY {scope}, lvl, pos // 8 ORDER BY pos
      ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {name}_levels),
{name}_paths AS (
  SELECT p.{scope}, p.pos, LIST({{'l': x.l, 'r': x.r}} ORDER BY x.lvl) FILTER (x.n > 1) AS path
  FROM {leaves} p JOIN {name}_runs x ON p.{scope} = x.{scope} AND x.pos = p.pos // (8 ** x.lvl)::BIGINT
  GROUP BY p.{scope}, p.pos),
{name}_tops AS (SELECT {scope}, digest AS top FROM {name}_levels WHERE n = 1)"""


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LEAF = "sha256(" + " || ".join(_encoded(c) for c in ("doc_id", "source", "lang", "n_chars", "{}")) + ")"
_PLAIN = _LEAF.replace("{}", "text")
_ALTERED = _LEAF.replace("{}", _LOWER.format("text"))
OP11 = f"""
WITH RECURSIVE rows_ AS (
  SELECT doc_id, COALESCE('=' || lang, '-') AS tree, {_PLAIN} AS digest,
    CASE WHEN {_crc32("doc_id::VARCHAR")} % 3 = 0 THEN {_ALTERED} END AS altered
  FROM documents),
leaves AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS pos FROM rows_),
{_tree("low", "leaves", "tree")},
subroots AS (
  SELECT 0 AS whole, tree, top AS digest, ROW_NUMBER() OVER (ORDER BY ENCODE(tree)) - 1 AS pos FROM low_tops),
{_tree("up", "subroots", "whole")},
found AS (
  SELECT v.doc_id, v.digest AS leaf, COALESCE(v.altered, v.digest) AS start, s.digest AS subroot, t.top AS root,
    COALESCE(p.path, []) || COALESCE(q.path, []) AS path
  FROM leaves v JOIN low_paths p ON v.tree = p.tree AND v.pos = p.pos
  JOIN subroots s ON v.tree = s.tree JOIN up_paths q ON s.pos = q.pos CROSS JOIN up_tops t),
done AS (
  SELECT doc_id, leaf, subroot, root, sha256(ARRAY_TO_STRING(LIST_TRANSFORM(path, lambda x: x.l || x.r), '')) AS proof_sha256,
    LIST_REDUCE(LIST_TRANSFORM(path, lambda x: {{'l': x.l, 'r': x.r}}), lambda a, x: {{'l': sha256(x.l || a.l || x.r), 'r': ''}},
      {{'l': start, 'r': ''}}).l AS folded_root
  FROM found)
SELECT *, folded_root = root AS verified FROM done
"""

_GRAMS = ", ".join(
    f"({n}, '{label}', {base}, {exact}, {size}, {at}, '{w0}', '{w1}', {f"'{w2}'" if w2 else 'NULL'})"
    for n, label, base, exact, size, at, w0, w1, w2 in gram_rows(STANDARD)
)
_LABELS = "COALESCE(STRING_AGG(DISTINCT label, ',' ORDER BY label) FILTER ({}), '')"
OP13 = rf"""
WITH grams(template, label, base, exact, size, place, w0, w1, w2) AS (VALUES {_GRAMS}),
words AS (
  SELECT ROW_NUMBER() OVER () AS uid, doc_id,
    REGEXP_EXTRACT_ALL({_LOWER.format("COALESCE(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
rolled AS (SELECT uid, w, UNNEST(RANGE(LEN(w))) AS pos FROM words),
votes AS (
  SELECT uid, template, label, base, exact, size, pos - place AS diagonal, BIT_OR(1::BIGINT << place) AS votes
  FROM rolled JOIN grams ON w[pos + 1] = w0 AND w[pos + 2] = w1 AND (w2 IS NULL OR w[pos + 3] = w2) GROUP BY ALL),
banded AS (
  SELECT *, UNNEST(CASE WHEN exact THEN [diagonal]
    ELSE [FLOOR(diagonal / {BAND})::BIGINT - 1, FLOOR(diagonal / {BAND})::BIGINT] END) AS band FROM votes),
places AS (
  SELECT uid, label, base, exact, GREATEST(MIN(diagonal), 0) AS first, BIT_COUNT(BIT_OR(votes)) / size AS similarity
  FROM banded GROUP BY uid, template, label, base, exact, size, band),
found AS (SELECT * FROM places WHERE similarity >= CASE WHEN exact THEN 1 ELSE {SHARE} END)
SELECT doc_id, LEN(ANY_VALUE(w))::BIGINT AS n_words, COUNT(*) FILTER (base) AS n_base, MIN(first) FILTER (base) AS first_word,
  MAX(first) FILTER (base) AS last_word, {_LABELS.format("base")} AS base_labels, {_LABELS.format("TRUE")} AS labels,
  COALESCE(MAX(similarity), 0)::DOUBLE AS score
FROM words LEFT JOIN found USING (uid) GROUP BY uid, doc_id
"""

SQL: dict[str, str] = {
    "op1_mixing": OP1,
    "op4_content_sort": OP4,
    "op11_merkle_manifest": OP11,
    "op13_license_diagonals": OP13,
}
