"""Pieces of SQL that the queries' SQL forms share."""

from __future__ import annotations

from loresmith.functions import lookups as L


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_of(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {quoted(w)})" for w in words) + ")" if words else "FALSE"


def first_rule(column: str, rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_of(column, words)} THEN {value}" for value, words in rules) + f" ELSE {default} END"


def values(rows, columns: str) -> str:
    cell = lambda v: quoted(v) if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") AS t({columns})"


POSTS = "posts AS (SELECT doc_id AS post_id, split_part(text, chr(10), 1) AS title, substr(text, 1, 500) AS content, source AS community, n_chars AS score FROM documents)"
SERVICES = """services AS (SELECT p_partkey AS ord, p_name AS name, lower(p_type) AS category, concat_ws(' ', p_name, p_brand, p_type) AS description,
  'https://' || replace(p_name, ' ', '-') || CASE p_partkey % 3 WHEN 0 THEN '.ai/docs' WHEN 1 THEN '.org/blog/x' ELSE '.org' END AS url, p_brand AS source FROM part)"""
ITEMS = """items AS (SELECT event_id AS ord, 'Svc' || user_id AS service,
  CASE event_type WHEN 'error' THEN 'problems' WHEN 'click' THEN 'tips' WHEN 'purchase' THEN 'cost_info' ELSE 'settings' END AS list_name,
  event_type || ' ' || props AS item, CAST(1 AS BIGINT) AS batch_size, ts FROM events)"""

_VARIATIONS = [(c, v) for c, vs in L.VARIATIONS for v in vs]
VARIATIONS = "variations AS (SELECT * FROM " + values([(i, c, v) for i, (c, v) in enumerate(_VARIATIONS)], "ord, canonical, variation") + ")"
_TEMPLATES = [(k, p) for k, ps in L.QUERY_TEMPLATES for p in ps]
TEMPLATES = "templates AS (SELECT * FROM " + values([(i, k, p) for i, (k, p) in enumerate(_TEMPLATES)], "template_ord, pattern_type, pattern") + ")"


def normal(c: str) -> str:
    return f"regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')"


def canonical(c: str) -> str:
    return f"regexp_replace(regexp_replace(lower({c}), '\\s*(ai|api|platform|tool|app|\\.ai|\\.io|\\.com)$', ''), '[^a-z0-9]', '', 'g')"


def similarity(a: str, b: str) -> str:
    x, y = normal(a), normal(b)
    return f"CASE WHEN {x} = {y} THEN 1.0::DOUBLE WHEN contains({x}, {y}) OR contains({y}, {x}) THEN 0.8::DOUBLE ELSE 1 - levenshtein({x}, {y})::DOUBLE / greatest(length({x}), length({y})) END"


#: Names that resolve at each tier, and some that do not.
NAMES = ("Eleven Labs", "eleven-labs", "HEYGEN", "Hey Gen!", "Claude", "the midjourney bot", "runwayml gen", "pika", "Unity", "zzz", "open  ai", "D-ID", "luma")
RESOLVE = f"""
  alias_rows AS (SELECT canonical, lower(variation) AS alias, ord * 4 AS pos FROM variations UNION ALL SELECT canonical, {normal('variation')}, ord * 4 + 1 FROM variations),
  aliases AS (SELECT alias, arg_max(canonical, pos) AS canonical FROM alias_rows GROUP BY alias)"""


def resolved(c: str) -> str:
    """Scalar SQL of the canonical name of a column (within a query that has RESOLVE and VARIATIONS)."""
    return f"""coalesce((SELECT canonical FROM aliases WHERE alias = lower({c})), (SELECT canonical FROM aliases WHERE alias = {normal(c)}),
      (SELECT arg_min(canonical, ord) FROM variations WHERE contains(lower({c}), lower(variation)) OR contains(lower(variation), lower({c}))))"""
