"""SQL that builds the node table and block features, for comparison only.

The tag stack is a recursive query that advances all pages by one token per step.
"""

from __future__ import annotations

# Public HTML facts, written out here once more so that a wrong entry of the engine shows.
VOID_TAGS = (
    "area", "base", "basefont", "br", "col", "embed", "frame", "hr", "img", "input", "isindex", "link", "meta", "param",
    "source", "track", "wbr",
)
HEAD_TAGS = ("title", "meta", "link", "base", "script", "style")
END_STRENGTH = {"div": 1, "td": 2, "th": 2, "tr": 3, "thead": 4, "tbody": 4, "tfoot": 4, "table": 5}
# the start tags that occur in the given pages, and the open tags each ends
CLOSES = {
    "p": ("p", "h1", "h2", "h3", "h4", "h5", "h6", "tt", "i", "b", "u", "s", "strike", "big", "small"),
    "h1": ("p", "h1", "h2", "h3", "h4", "h5", "h6"),
    "li": ("li", "p", "h1", "h2", "h3", "h4", "h5", "h6", "dl", "address", "pre"),
    "a": ("a",),
    "div": ("p",),
    "ul": ("p",),
}


def _quoted(names) -> str:
    return "[" + ", ".join(f"'{n}'" for n in sorted(names)) + "]"


NOISE = r"(?is)<(script|style|embed|object).*?>.*?</(script|style|embed|object)>"
CLEAN = f"""
clean AS (
  SELECT page_id, url, html AS raw,
         regexp_replace(regexp_replace(html, '{NOISE}', '', 'g'), '(?is)</?body.*?>', '', 'g') AS html
  FROM pages
)"""

_CLOSE_ROWS = ", ".join(f"('{tag}', {_quoted(closed)})" for tag, closed in CLOSES.items())
_STRENGTH = "CASE {0} " + " ".join(f"WHEN '{t}' THEN {n}" for t, n in END_STRENGTH.items()) + " ELSE 0 END"


def decode(text: str) -> str:
    """Entities of the fixture; the ampersand last."""
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        text = f"replace({text}, '{name}', '{char}')"
    return text


def nodes(source: str = "clean") -> str:
    """CTEs ending in ``nodes(page_id, id, path, tag, text, attrs, pre)``; ``path`` lists the open ancestors."""
    return f"""
tokens AS (
  SELECT page_id, unnest(toks) AS t, generate_subscripts(toks, 1) AS i
  FROM (SELECT page_id, regexp_extract_all(html, '(?s)(<!--.*?-->|<[^>]*>|[^<]+)', 1) AS toks FROM {source})
),
closes(tag, closed) AS (VALUES {_CLOSE_ROWS}),
spans AS (
  SELECT *, coalesce(sum(length(t)) OVER (PARTITION BY page_id ORDER BY i
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at0
  FROM tokens
),
kinds AS (
  SELECT k.page_id, k.i, k.t, k.at0, k.kind, k.tag, coalesce(c.closed, []) AS closed
  FROM (
    SELECT *, CASE WHEN t LIKE '<!--%' THEN 'c' WHEN t LIKE '<!%' THEN 'd' WHEN t LIKE '</%' THEN 'e'
                   WHEN t LIKE '<%' THEN 's' ELSE 't' END AS kind,
           lower(regexp_extract(t, '^</?([a-zA-Z][^\\s/>]*)', 1)) AS tag
    FROM spans) k LEFT JOIN closes c ON c.tag = k.tag
),
steps AS (
  WITH RECURSIVE walk(page_id, i, base, stack) AS (
    SELECT page_id, 0::BIGINT, [{{'id': 0.0::DOUBLE, 'tag': 'html'}}], [{{'id': 0.0::DOUBLE, 'tag': 'html'}}]
    FROM (SELECT DISTINCT page_id FROM kinds)
    UNION ALL
    SELECT page_id, i, base,
           CASE WHEN kind = 's' AND tag <> 'html' AND NOT list_contains({_quoted(VOID_TAGS)}, tag)
                THEN list_append(base, {{'id': i::DOUBLE, 'tag': tag}}) ELSE base END
    FROM (
      SELECT page_id, i, kind, tag,
             CASE WHEN kind = 'e' AND hit IS NOT NULL AND above <= mine THEN list_slice(s1, 1, len(s1) - hit)
                  WHEN kind = 's' THEN list_slice(s1, 1, len(s1) - coalesce(
                       list_position(list_transform(list_reverse(s1), lambda x: list_contains(closed, x.tag)), false) - 1,
                       len(s1)))
                  ELSE s1 END AS base
      FROM (
        SELECT *, CASE WHEN kind = 'e' AND tag NOT IN ('html', 'body')
                       THEN list_position(list_transform(list_reverse(s1), lambda x: x.tag), tag) END AS hit,
               coalesce(list_max(list_transform(
                 list_slice(list_reverse(s1), 1, list_position(list_transform(list_reverse(s1), lambda x: x.tag), tag) - 1),
                 lambda x: {_STRENGTH.format("x.tag")})), 0) AS above,
               {_STRENGTH.format("tag")} AS mine
        FROM (
          SELECT k.page_id, k.i, k.kind, k.tag, k.closed,
                 CASE WHEN k.kind = 's' AND k.tag IN ('head', 'body') THEN list_slice(w.stack, 1, 1)
                      WHEN (k.kind = 's' AND k.tag <> 'html' AND NOT list_contains({_quoted(HEAD_TAGS)}, k.tag)
                            AND NOT list_contains(list_transform(w.stack, lambda x: x.tag), 'body'))
                      THEN list_append(list_slice(w.stack, 1, 1), {{'id': k.i - 0.5, 'tag': 'body'}})
                      ELSE w.stack END AS s1
          FROM walk w JOIN kinds k ON k.page_id = w.page_id AND k.i = w.i + 1
        )
      )
    )
  )
  SELECT * FROM walk
),
raw_nodes AS (
  SELECT k.page_id, k.i::DOUBLE AS id, s.base AS path,
         CASE k.kind WHEN 't' THEN '#text' WHEN 'c' THEN '#comment' ELSE k.tag END AS tag,
         CASE k.kind WHEN 't' THEN {decode("k.t")} WHEN 'c' THEN k.t[5:-4] END AS text,
         CASE k.kind WHEN 's' THEN regexp_extract(k.t, '(?s)^<[a-zA-Z][^\\s/>]*([^>]*)>$', 1) END AS attrs,
         k.at0
  FROM kinds k JOIN steps s ON s.page_id = k.page_id AND s.i = k.i
  WHERE k.kind IN ('s', 't', 'c') AND NOT (k.kind = 's' AND k.tag = 'html')
    AND NOT (k.kind = 't' AND len(s.base) <= 2 AND trim(k.t) = ''
             AND NOT list_contains(list_transform(s.base, lambda x: x.tag), 'body'))
  UNION ALL
  SELECT page_id, 0.0, [], 'html', NULL, '', 0 FROM (SELECT DISTINCT page_id FROM kinds)
  UNION ALL
  SELECT DISTINCT s.page_id, b.id, list_slice(s.stack, 1, 1), 'body', NULL, '',
         (SELECT k.at0 FROM kinds k WHERE k.page_id = s.page_id AND k.i = (b.id + 0.5)::BIGINT)
  FROM steps s, unnest(s.stack) AS u(b) WHERE b.tag = 'body' AND b.id <> floor(b.id)
),
nodes AS (
  SELECT *, (row_number() OVER (PARTITION BY page_id ORDER BY id) - 1)::BIGINT AS pre,
         len(path)::BIGINT AS depth, path[-1].id AS parent
  FROM raw_nodes
)"""


def ends(html_length: str = "(SELECT length(c.html) FROM clean c WHERE c.page_id = k.page_id)") -> str:
    """CTE ``ends(page_id, id, src_end)``: where each element was closed."""
    return f"""
ends AS (
  SELECT k.page_id, k.id, coalesce(min(CASE WHEN m.kind = 'e' AND m.tag = k.tag
            AND len(s.stack) = k.depth THEN m.at0 + length(m.t) ELSE m.at0 END), any_value({html_length})) AS src_end
  FROM nodes k
  LEFT JOIN (
    SELECT page_id, id, min(i) AS gone FROM (
      SELECT n.page_id, n.id, s.i FROM nodes n JOIN steps s ON s.page_id = n.page_id AND s.i > n.id
      WHERE NOT list_contains(list_transform(s.stack, lambda x: x.id), n.id)
        AND n.tag IN ('div', 'section', 'article')
    ) GROUP BY page_id, id) g ON g.page_id = k.page_id AND g.id = k.id
  LEFT JOIN kinds m ON m.page_id = g.page_id AND m.i = g.gone
  LEFT JOIN steps s ON s.page_id = g.page_id AND s.i = g.gone
  WHERE k.tag IN ('div', 'section', 'article')
  GROUP BY k.page_id, k.id
)"""


_WORDS = {"f_none_n": "none|hidden|hide", "f_side_n": "left|right|side", "f_main_n": "main|body|content", "f_nav_n": "nav"}


def features() -> str:
    """CTEs ending in ``feats``: one row per block, the 21 features and ``f_all_tags``; needs ``nodes``."""
    spaceless = "strlen(replace(text, ' ', ''))"
    escaped = "strlen(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), ' ', ''))"
    words = ",\n".join(
        f"         len(regexp_extract_all(markup, '{pattern}'))::BIGINT AS w_{name}" for name, pattern in _WORDS.items()
    )
    word_sums = ", ".join(f"sum(w_{name})::BIGINT AS {name}" for name in _WORDS)
    return f"""
near AS (
  SELECT *, lead(path) OVER w AS next_path, lag(tag) OVER w AS last_tag, lag(depth) OVER w AS last_depth
  FROM nodes WINDOW w AS (PARTITION BY page_id ORDER BY id)
),
islands AS (
  SELECT *, sum(CASE WHEN tag = '#text' AND last_tag = '#text' AND depth = last_depth - 1 THEN 0 ELSE 1 END)
              OVER (PARTITION BY page_id ORDER BY id) AS island
  FROM near
),
measured AS (
  SELECT *, CASE WHEN tag = '#text' AND (next_path IS NULL OR NOT list_contains(list_transform(next_path, lambda x: x.id), parent))
                 AND (row_number() OVER (PARTITION BY page_id, island ORDER BY id) % 2 = 1) THEN {escaped} END AS capture,
         CASE WHEN tag = '#text' THEN strlen(text) ELSE 0 END AS bytes,
         CASE WHEN tag = '#text' THEN {spaceless} ELSE 0 END AS spaceless,
         CASE WHEN tag LIKE '#%' THEN text ELSE tag || ' ' || attrs ||
              CASE WHEN list_contains({_quoted(VOID_TAGS)}, tag) THEN '' ELSE ' ' || tag END END AS markup
  FROM islands
),
counted AS (
  SELECT *,
{words}
  FROM measured
),
siblings AS (
  SELECT page_id, id, tag, text, lag(id) OVER s AS tail_of, lag(tag) OVER s AS tail_tag
  FROM nodes WINDOW s AS (PARTITION BY page_id, parent ORDER BY id)
),
linked AS (
  SELECT n.page_id, a.id AS a_id, sum(n.spaceless) AS bytes
  FROM measured n, unnest(n.path) AS u(a) WHERE a.tag = 'a' GROUP BY ALL
),
links AS (
  SELECT n.page_id, n.id, n.path, coalesce(l.bytes, 0) + coalesce(t.bytes, 0) AS bytes
  FROM nodes n
  LEFT JOIN linked l ON l.page_id = n.page_id AND l.a_id = n.id
  LEFT JOIN (SELECT page_id, tail_of, {spaceless} AS bytes FROM siblings
             WHERE tag = '#text' AND tail_tag = 'a') t ON t.page_id = n.page_id AND t.tail_of = n.id
  WHERE n.tag = 'a'
),
rowed AS (
  SELECT b.id AS blk, n.*, true AS inside FROM counted n, unnest(n.path) AS u(b)
  WHERE b.tag IN ('div', 'section', 'article')
  UNION ALL BY NAME
  SELECT id AS blk, *, true AS inside FROM counted WHERE tag IN ('div', 'section', 'article')
  UNION ALL BY NAME
  SELECT s.tail_of AS blk, c.*, false AS inside FROM counted c
  JOIN siblings s ON s.page_id = c.page_id AND s.id = c.id
  WHERE c.tag = '#text' AND s.tail_tag IN ('div', 'section', 'article')
),
li_links AS (
  SELECT DISTINCT n.page_id, l.id AS li_id FROM nodes n, unnest(n.path) AS u(l)
  WHERE n.tag = 'a' AND l.tag IN ('li', 'ol')
),
block_links AS (
  SELECT l.page_id, b.id AS blk, sum(l.bytes) AS bytes FROM links l, unnest(l.path) AS u(b)
  WHERE b.tag IN ('div', 'section', 'article') GROUP BY ALL
),
sums AS (
  SELECT r.page_id, r.blk,
    sum(bytes)::BIGINT AS f_text_n,
    count(*) FILTER (inside AND tag IN ('p', 'blockquote')) AS f_p_n,
    count(*) FILTER (inside AND tag <> '#text') AS f_tag_n,
    count(*) FILTER (inside AND tag IN ('h1', 'h2', 'h3', 'h4', 'h5')) AS f_h_n,
    count(*) FILTER (inside AND tag NOT LIKE '#%' AND tag NOT IN ('p', 'h1', 'h2', 'h3', 'h4', 'h5', 'blockquote',
       'span', 'div', 'table', 'tr', 'td', 'th', 'img', 'br')) AS f_np_n,
    count(*) FILTER (inside AND tag = 'img') AS f_img_n,
    count(*) FILTER (inside AND tag = 'a') AS f_a_n,
    count(*) FILTER (inside AND tag IN ('form', 'input', 'textarea')) AS f_form_element_n,
    coalesce(max(capture) FILTER (inside), 0)::BIGINT AS f_element_maxtextlen,
    {word_sums},
    count(*) FILTER (inside AND r.parent = r.blk AND tag IN ('div', 'section', 'article')) AS f_child_div_n,
    count(*) FILTER (inside AND r.parent = r.blk AND tag IN ('p', 'blockquote')) AS f_child_p_n,
    count(*) FILTER (inside AND tag IN ('li', 'ol')) AS f_li_n,
    count(*) FILTER (inside AND tag IN ('li', 'ol') AND x.li_id IS NOT NULL) AS f_li_a_n,
    count(*) FILTER (inside AND tag = 'h1') AS f_h1_n,
    (max(r.depth) FILTER (inside AND tag NOT LIKE '#%') - min(r.depth) FILTER (inside AND r.id = r.blk))::BIGINT AS f_dom_depth,
    least(20, coalesce(min(r.depth) FILTER (inside AND tag IN ('p', 'blockquote'))
                       - min(r.depth) FILTER (inside AND r.id = r.blk), 20))::BIGINT AS f_depth_to_p,
    sum(spaceless) AS spaceless,
    max(r.id) FILTER (inside) AS last_id,
    min(r.at0) FILTER (inside AND r.id = r.blk) AS src_start,
    list_sort(list(DISTINCT tag) FILTER (inside AND tag NOT LIKE '#%')) AS f_all_tags
  FROM rowed r LEFT JOIN li_links x ON x.page_id = r.page_id AND x.li_id = r.id
  GROUP BY r.page_id, r.blk
),
feats AS (
  SELECT s.*, n.pre, CASE WHEN s.spaceless = 0 THEN 0.0 ELSE coalesce(b.bytes, 0)::DOUBLE / s.spaceless END AS f_link_density
  FROM sums s JOIN nodes n ON n.page_id = s.page_id AND n.id = s.blk
  LEFT JOIN block_links b ON b.page_id = s.page_id AND b.blk = s.blk
)"""
