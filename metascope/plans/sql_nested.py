"""The items of nested records in SQL: a recursive walk over JSON that hands owners down."""

_ONE = "CASE json_type({h}) WHEN 'OBJECT' THEN coalesce(nullif({h}->>'module', '') || '.', '') || ({h}->>'method') WHEN 'NULL' THEN NULL WHEN 'ARRAY' THEN NULL ELSE {h}->>'$' END"
_FIELDS = "('forms', 'elements', 'events', 'by_event', 'sources', 'type', 'type_set', 'group', 'commands')"


def _handlers(h: str) -> str:
    return f"CASE WHEN json_type({h}) = 'ARRAY' THEN list_transform(CAST({h} AS JSON[]), lambda x: {_ONE.format(h='x')}) ELSE [{_ONE.format(h=h)}] END"


FOUND_ITEMS = rf"""WITH RECURSIVE rec AS (SELECT DISTINCT record_id, CAST(ltrim(payload, chr(65279)) AS JSON) AS v FROM raw_records WHERE json_valid(ltrim(payload, chr(65279)))),
node AS (
  SELECT record_id, '' AS field, '' AS up, json_object('$', v) AS v, 'OBJECT' AS t, false AS member, '' AS form, '' AS kind, '' AS own, '' AS k2, '' AS up_own, '' AS up_kind FROM rec
  UNION ALL
  SELECT record_id, field, up, v, t, member,
    CASE WHEN k2 = 'form' THEN coalesce(v->>'form_name', '') ELSE form END,
    CASE WHEN k2 = '' THEN kind ELSE k2 END,
    CASE k2 WHEN 'form' THEN coalesce(v->>'form_name', '') WHEN 'subscription' THEN coalesce({_ONE.format(h="(v->'handler')")}, '') WHEN 'element' THEN form || '/' || coalesce(nullif(v->>'element_id', ''), v->>'element_name', '') ELSE own END,
    k2, own, kind
  FROM (SELECT *, CASE WHEN t <> 'OBJECT' THEN '' WHEN field <> 'elements' AND json_exists(v, '$.form_name') THEN 'form' WHEN field = 'subscription' OR (field = '$' AND up = '' AND json_exists(v, '$.sources')) THEN 'subscription'
      WHEN field = 'elements' AND kind IN ('form', 'element') THEN 'element' ELSE '' END AS k2
    FROM (SELECT record_id, field, up, CASE WHEN unwrap THEN CAST(c->>'$' AS JSON) ELSE c END AS v, json_type(CASE WHEN unwrap THEN CAST(c->>'$' AS JSON) ELSE c END) AS t, member, form, kind, own
      FROM (SELECT n.record_id, CASE WHEN n.t = 'ARRAY' THEN n.field ELSE e.key END AS field, CASE WHEN n.t = 'ARRAY' THEN n.up ELSE n.field END AS up, e.value AS c, n.form, n.kind, n.own,
          n.t = 'OBJECT' AND (n.field = 'by_event' OR (n.field = 'events' AND NOT json_exists(n.v, '$.event') AND NOT json_exists(n.v, '$.by_event'))) AS member,
          json_type(e.value) = 'VARCHAR' AND (CASE WHEN n.t = 'ARRAY' THEN n.field ELSE e.key END) IN {_FIELDS} AND regexp_matches(e.value->>'$', '^\s*[\[{{]') AND json_valid(e.value->>'$') AS unwrap
        FROM node n, json_each(n.v) e WHERE n.t IN ('OBJECT', 'ARRAY'))))
),
handled AS (SELECT record_id, own, v->>'event' AS event, unnest({_handlers("(v->'handler')")}) AS h FROM node WHERE field = 'events' AND t = 'OBJECT' AND json_exists(v, '$.event') AND kind IN ('form', 'element')
  UNION ALL SELECT record_id, own, field, unnest({_handlers("v")}) FROM node WHERE member AND kind IN ('form', 'element'))
SELECT DISTINCT record_id, 'element' AS item_kind, own AS item_key, up_own AS parent_key FROM node WHERE k2 = 'element'
UNION SELECT record_id, 'handler', event || '=' || h, own FROM handled WHERE trim(h) <> ''
UNION SELECT record_id, 'source', v->>'$', own FROM node WHERE kind = 'subscription' AND field IN ('sources', 'type', 'type_set', 'group') AND t NOT IN ('OBJECT', 'ARRAY', 'NULL') AND trim(v->>'$') <> ''"""
