"""Pages: projection, links, tree, blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafsift.functions import html as H
from leafsift.functions import urls as U
from leafsift.functions.dates import asctime_to_date_text
from leafsift.functions.text import first_or_empty
from leafsift.operators import blocks as B
from leafsift.operators import links as L
from leafsift.operators.profile import with_text
from leafsift.operators.projection import route_by_type
from leafsift.operators.tree import BLOCK_TAGS, element_html, element_text, node_table, page_text, with_page_fields
from leafsift.plans import extract as X
from leafsift.plans.storing import append_samples, remove_samples, sample_store
from leafsift.session import scratch_path
from leafsift.sources.fixed import ALLOWED_DOMAINS, START_URLS, URL_RULES, start_urls, url_rules
from queries import registrar
from queries import sql_tree as T
from queries import views as V

QUERIES: dict = {}
SQL: dict[str, str] = {}
query = registrar(QUERIES, SQL)


# ---------------------------------------------------------------- projection

_RAW_TITLE = r"""regexp_extract(html, '(?is)<title[^>]*>(.*?)</title', 1)"""


@query("p01_title", f"SELECT page_id, {T.decode(_RAW_TITLE)} AS title FROM pages")
def p01(spark, sf):
    # The SQL reads the given pages: what was put into them must not change the title.
    return with_page_fields(V.tricky_pages(spark, sf).select("page_id", "html")).select("page_id", "title")


@query("p02_description", "SELECT page_id, 'page ' || page_id || ' &amp; ''q'' > end' AS description FROM pages")
def p02(spark, sf):
    return with_page_fields(V.tricky_pages(spark, sf).select("page_id", "html")).select("page_id", "description")


@query("p03_body", r"SELECT page_id, regexp_extract(html, '(?s)<body>(?:.*</body>|.*)', 0) AS body FROM pages")
def p03(spark, sf):
    return V.pages(spark, sf).select("page_id", H.page_body(F.col("html")).alias("body"))


@query("p04_first_or_empty",
       r"SELECT page_id, coalesce(regexp_extract_all(html, '<h1>([^<]*)</h1>', 1)[1], '') AS heading, "
       r"coalesce(regexp_extract_all(html, '<h2>([^<]*)</h2>', 1)[1], '') AS subheading FROM pages")  # fmt: skip
def p04(spark, sf):
    def first(tag):
        return first_or_empty(F.regexp_extract_all("html", F.lit(f"<{tag}>([^<]*)</{tag}>"), F.lit(1)))

    return V.pages(spark, sf).select("page_id", first("h1").alias("heading"), first("h2").alias("subheading"))


def _response_kind():
    return (
        F.when(F.col("page_id") % 5 == 0, F.lit(None))
        .when(F.col("page_id") % 5 == 1, "image/png")
        .when(F.col("page_id") % 5 == 2, "Application/JSON")
        .when(F.col("page_id") % 5 == 3, "application/json; charset=utf-8")
        .otherwise("text/html")
    )


def _responses(spark, sf) -> DataFrame:
    return V.pages(spark, sf).withColumn("content_type", _response_kind())


@query("p05_route",
       "SELECT page_id, CASE WHEN page_id % 5 = 2 THEN 'json' ELSE 'html' END AS route FROM pages WHERE page_id % 5 >= 2")
def p05(spark, sf):
    return route_by_type(_responses(spark, sf)).select("page_id", "route")


@query("p06_date",
       "SELECT page_id, strftime(TIMESTAMP '2024-01-31' - to_hours(page_id * 3 % 720), '%Y-%m-%d %H:%M:%S') AS date_text, "
       "strftime(TIMESTAMP '2024-01-31' - to_hours(page_id * 3 % 720), '%a %b ') || "
       "lpad(day(TIMESTAMP '2024-01-31' - to_hours(page_id * 3 % 720))::VARCHAR, 2, ' ') || "
       "strftime(TIMESTAMP '2024-01-31' - to_hours(page_id * 3 % 720), ' %H:%M:%S %Y') AS crawled FROM pages")  # fmt: skip
def p06(spark, sf):
    rows = V.rss(spark, sf)
    return rows.select(F.col("id").alias("page_id"), asctime_to_date_text(F.col("date")).alias("date_text"), F.col("date").alias("crawled"))


# ---------------------------------------------------------------- links

_GIVEN_LINKS = r"""
given AS (
  SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*"([^"]*)"', 1)) AS href FROM pages
)"""
# the given pages' links, and those that were put into every page
_LINKS = _GIVEN_LINKS + """,
links AS (
  SELECT * FROM given
  UNION ALL SELECT page_id, url, unnest(['/q?x=1&y=' || page_id, '/part#one', '/part#two', 'mailto:a@b.example.com', 'javascript:void(0)']) FROM pages
)"""
_ROOT = r"regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)', 1)"
_TARGETS = (
    _LINKS + f", targets AS (SELECT page_id, url, href, {_ROOT} || regexp_replace(href, '#.*$', '') AS target FROM links WHERE href NOT LIKE '%:%')"
)
_NO_FRAGMENT = "regexp_replace(url, '#.*$', '')"
_SITE = r"regexp_extract({0}, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)"
_PATH = r"regexp_extract({0}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


@query("u01_links", f"WITH {_LINKS} SELECT page_id, href FROM links")
def u01(spark, sf):
    return L.page_links(V.tricky_pages(spark, sf)).select("page_id", "href")


@query("u01_links_by_tree", f"WITH {_LINKS} SELECT page_id, count(*) AS n, min(href) AS lowest, max(href) AS highest FROM links GROUP BY page_id")
def u01_tree(spark, sf):
    rows = L.anchor_nodes(V.tricky_pages(spark, sf))
    return rows.groupBy("page_id").agg(F.count("href").alias("n"), F.min("href").alias("lowest"), F.max("href").alias("highest"))


@query("u02_json_links",
       r"""SELECT page_id, unnest(regexp_extract_all('{"u":"' || url || '","v":["http://a.b/c","x"],"t":"' || replace(html, '"', '') || '"}',
 '(?i)https?://[^"''><]+')) AS link FROM pages""")
def u02(spark, sf):
    body = F.concat(F.lit('{"u":"'), F.col("url"), F.lit('","v":["http://a.b/c","x"],"t":"'), F.replace("html", F.lit('"'), F.lit("")), F.lit('"}'))
    return V.pages(spark, sf).select("page_id", F.explode(H.urls_in_json(body)).alias("link"))


# the folder above the page's own; the root has none above it
_PARENT = f"CASE WHEN regexp_matches({_PATH.format('url')}, '/[^/]*/') THEN regexp_replace({_PATH.format('url')}, '[^/]*/[^/]*$', '') ELSE '/' END"
_FORMS = ["/a/./b/../c", "//other.example.com/x", "?q=1", "#part", "https://abs.example.org/z?y"]


@query("u03_resolve",
       f"""SELECT page_id, {_ROOT} || '/a/c' AS r0, regexp_extract(url, '^([a-z]+):', 1) || '://other.example.com/x' AS r1,
 regexp_replace(regexp_replace(url, '#.*$', ''), '\\?.*$', '') || '?q=1' AS r2, regexp_replace(url, '#.*$', '') || '#part' AS r3,
 'https://abs.example.org/z?y' AS r4,
 {_ROOT} || regexp_replace({_PATH.format("url")}, '[^/]*$', '') || 'up/x.html' AS r5,
 {_ROOT} || {_PARENT} || 'up/x.html' AS r6, {_ROOT} || {_PARENT} || 'b?c' AS r7 FROM pages""")
def u03(spark, sf):
    forms = [*_FORMS, "./up/x.html", "../up/./x.html", "a/../../b?c"]
    return V.pages(spark, sf).select(
        "page_id", *[U.resolve(F.col("url"), F.lit(f)).alias(f"r{i}") for i, f in enumerate(forms)]
    )


# The fixture's hosts are invented, so the rules are tried on hosts that rotate over the rule table.
_RULE_HOSTS = [d for d, _ in URL_RULES] + ["none.example.com"]
_RULE_PATHS = ["/abs/", "/news/", "/latest", "/articles/", "/p/", "/story", "/content/2", "/x/"]


def _rule_url():
    hosts = F.array(*[F.lit(h) for h in _RULE_HOSTS])
    paths = F.array(*[F.lit(p) for p in _RULE_PATHS])
    host = F.element_at(hosts, (F.col("page_id") % len(_RULE_HOSTS) + 1).cast("int"))
    path = F.element_at(paths, (F.floor(F.col("page_id") / len(_RULE_HOSTS)) % len(_RULE_PATHS) + 1).cast("int"))
    return F.concat(F.lit("https://m."), host, path, F.col("page_id").cast("string"), F.lit("?u="), F.col("url"))


_SQL_RULE_URL = (
    f"'https://m.' || {_RULE_HOSTS!r}[page_id % {len(_RULE_HOSTS)} + 1] || "
    f"{_RULE_PATHS!r}[(page_id // {len(_RULE_HOSTS)}) % {len(_RULE_PATHS)} + 1] || page_id || '?u=' || url"
)


def _sql_rules(url: str, first_only: bool) -> str:
    cases = []
    for domain, prefixes in URL_RULES:
        tested = prefixes[:1] if first_only else prefixes
        test = " OR ".join(f"starts_with({_PATH.format(url)}, '{p}')" for p in tested)
        cases.append(f"WHEN contains({_SITE.format(url)}, '{domain}') THEN {test}")
    return "CASE " + " ".join(cases) + " ELSE true END"


@query("u04_prefix_rules",
       f"SELECT page_id, u AS target, ({_sql_rules('u', True)})::INT::BIGINT AS first_rule, ({_sql_rules('u', False)})::INT::BIGINT AS any_rule "
       f"FROM (SELECT page_id, {_SQL_RULE_URL} AS u FROM pages)")
def u04(spark, sf):
    rows = V.pages(spark, sf).select("page_id", _rule_url().alias("target"))
    target = F.col("target")
    return rows.select(
        "page_id", "target",
        L.matches_rules(target, URL_RULES, "first").cast("bigint").alias("first_rule"),
        L.matches_rules(target, URL_RULES, "any").cast("bigint").alias("any_rule"),
    )


@query("u05_allowed_domains",
       f"SELECT page_id FROM (SELECT page_id, {_SITE.format('u')} AS h FROM (SELECT page_id, {_SQL_RULE_URL} AS u FROM pages)) "
       f"WHERE EXISTS (SELECT 1 FROM (SELECT unnest({ALLOWED_DOMAINS!r}) AS d) WHERE h = d OR ends_with(h, '.' || d))")
def u05(spark, sf):
    rows = V.pages(spark, sf).select("page_id", _rule_url().alias("target"))
    return rows.filter(L.in_domains(F.col("target"), ALLOWED_DOMAINS)).select("page_id")


@query("u06_unseen",
       f"WITH {_TARGETS} SELECT DISTINCT target FROM targets WHERE target NOT IN "
       f"(SELECT {_ROOT} || '/de' FROM pages UNION ALL SELECT {_NO_FRAGMENT} FROM pages) UNION ALL SELECT unnest(['mailto:a@b.example.com', 'javascript:void(0)'])")
def u06(spark, sf):
    p = V.tricky_pages(spark, sf)
    seen = p.select(U.resolve(F.col("url"), F.lit("/de")).alias("url")).unionByName(p.select("url"))
    return L.not_seen(L.resolve_links(L.page_links(p)).select("target"), seen)


@query("u07_site", f"SELECT page_id, {_SITE.format('url')} AS site FROM pages")
def u07(spark, sf):
    return V.pages(spark, sf).select("page_id", U.site(F.col("url")).alias("site"))


@query("u08_rewrite_links",
       f"""SELECT page_id, strlen(a) AS n_plain, md5(a) AS plain, strlen(b) AS n_full, md5(b) AS whole FROM (
 SELECT page_id, replace(replace(html, 'src="/', 'src=' || {_SITE.format('url')} || '/'), 'href="/', 'href="' || {_SITE.format('url')} || '/') AS a,
 replace(replace(html, 'src="/', 'src="' || {_ROOT} || '/'), 'href="/', 'href="' || {_ROOT} || '/') AS b FROM pages)""")
def u08(spark, sf):
    def form(faithful):
        return U.rewrite_root_links(F.col("html"), F.col("url"), faithful)

    rows = V.pages(spark, sf).select("page_id", form(True).alias("a"), form(False).alias("b"))
    return rows.select(
        "page_id", F.octet_length("a").cast("bigint").alias("n_plain"), F.md5(F.col("a").cast("binary")).alias("plain"),
        F.octet_length("b").cast("bigint").alias("n_full"), F.md5(F.col("b").cast("binary")).alias("whole"),
    )


_DOMAINS = ["example.net", "example.org"]
# JSON bodies name one URL under the page's host and one elsewhere
_JSON = f"""json AS (
  SELECT page_id, unnest([{_ROOT} || '/json/' || page_id % 7, 'https://other.example.com/x']) AS target FROM pages WHERE page_id % 5 = 2
)"""


@query("u09_frontier",
       f"WITH {_TARGETS}, {_JSON}, found AS (SELECT page_id, target FROM targets WHERE page_id % 5 > 2 UNION ALL SELECT page_id, target FROM json) "
       f"SELECT target, count(*) AS n_links, min(page_id) AS first_page FROM found WHERE target NOT IN (SELECT {_NO_FRAGMENT} FROM pages) "
       f"AND ({_SITE.format('target')} LIKE '%.example.net' OR {_SITE.format('target')} LIKE '%.example.org') GROUP BY target")
def u09(spark, sf):
    p = V.tricky_pages(spark, sf)
    root = F.regexp_extract("url", r"^([a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*)", 1)
    body = F.concat(F.lit('{"u": "'), root, F.lit("/json/"), (F.col("page_id") % 7).cast("string"), F.lit('#top", "v": ["https://other.example.com/x"]}'))
    kind = _response_kind()
    responses = p.withColumn("content_type", kind).withColumn("html", F.when(F.lower(kind) == "application/json", body).otherwise(F.col("html")))
    return L.frontier(responses, URL_RULES, _DOMAINS, seen=p.select("url"))


@query("s18_page_rules",
       f"SELECT page_id, s AS seed, d AS domain FROM (SELECT page_id, {_SITE.format('u')} AS h FROM (SELECT page_id, {_SQL_RULE_URL} AS u FROM pages)) "
       f"LEFT JOIN (SELECT min(x) AS s, regexp_extract(x, '^[a-z]+://([^/?#]*)', 1) AS sh FROM (SELECT unnest({START_URLS!r}) AS x) GROUP BY 2) ON h = 'm.' || sh "
       f"LEFT JOIN (SELECT unnest({[d for d, _ in URL_RULES]!r}) AS d) ON h = 'm.' || d")
def s18(spark, sf):
    """Which seed and which rule the page hosts fall under, by joins with the seed tables."""
    host = F.regexp_replace(U.host(_rule_url()), r"^m\.", "")
    rows = V.pages(spark, sf).select("page_id", host.alias("host"))
    seeds = start_urls(spark).groupBy(U.host(F.col("url")).alias("host")).agg(F.min("url").alias("seed"))
    rules = url_rules(spark).select(F.col("domain").alias("host"), "domain")
    return rows.join(seeds, "host", "left").join(rules, "host", "left").select("page_id", "seed", "domain")


@query("u10_images",
       f"""SELECT page_id AS id, '/i/' || page_id || '.png' AS src, {_ROOT} || '/i/' || page_id || '.png' AS image_url FROM pages
 UNION ALL SELECT page_id, 'https://cdn.example.com/' || page_id, 'https://cdn.example.com/' || page_id FROM pages""")
def u10(spark, sf):
    # The given pages hold no image, so three are added to every body: by src, by data-src, and inline data.
    n = F.col("page_id").cast("string")
    images = F.concat(
        F.lit('<img alt="a" src="/i/'), n, F.lit('.png"><img src="" data-src="https://cdn.example.com/'), n,
        F.lit('"><img src="data:image/png;base64,AA">'),
    )
    rows = V.pages(spark, sf).select(F.col("page_id").alias("id"), F.concat("html", images).alias("body"), F.col("url").alias("link"))
    return L.image_urls(rows)


# ---------------------------------------------------------------- tree

_TREE = f"WITH {T.CLEAN}, {T.nodes()}"


@query("h01_nodes",
       _TREE + " SELECT page_id, pre, tag, depth, coalesce(text, '') AS text FROM nodes")
def h01(spark, sf):
    return node_table(V.cleaned(spark, sf)).select(
        "page_id", F.col("pre").cast("bigint").alias("pre"), "tag", F.col("depth").cast("bigint").alias("depth"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


@query("h02_element_text",
       _TREE + """, runs AS (SELECT page_id, id, tag, text, path, lag(id) OVER s AS tail_of FROM nodes WINDOW s AS (PARTITION BY page_id, parent ORDER BY id)),
 pieces AS (SELECT r.page_id, b.id AS el, r.id, r.text FROM runs r, unnest(r.path) AS u(b) WHERE r.tag = '#text'
            UNION ALL SELECT page_id, tail_of, id, text FROM runs WHERE tag = '#text' AND tail_of IS NOT NULL)
 SELECT e.page_id, e.pre, coalesce(string_agg(p.text, '' ORDER BY p.id), '') AS text
 FROM nodes e LEFT JOIN pieces p ON p.page_id = e.page_id AND p.el = e.id WHERE e.tag NOT LIKE '#%' GROUP BY e.page_id, e.pre""")
def h02(spark, sf):
    """Every element, with the text right after it."""
    cleaned = V.cleaned(spark, sf)
    elements = node_table(cleaned).filter(~F.startswith("tag", F.lit("#")))
    texts = with_text(cleaned, "html").select("page_id", "text")
    return element_text(elements, texts).select("page_id", F.col("pre").cast("bigint").alias("pre"), "text")


@query("h03_element_html",
       f"WITH {T.CLEAN}, {T.nodes()}, {T.ends()} SELECT e.page_id, n.pre, substr(c.html, n.at0 + 1, e.src_end - n.at0) AS html "
       "FROM ends e JOIN nodes n ON n.page_id = e.page_id AND n.id = e.id JOIN clean c ON c.page_id = e.page_id")
def h03(spark, sf):
    pages = X.clean_pages(V.stored_pages(spark, sf))
    blocks = node_table(pages).filter(F.col("tag").isin(*BLOCK_TAGS)).select("page_id", "pre", "src_start", "src_end")
    return element_html(blocks, pages).select("page_id", F.col("pre").cast("bigint").alias("pre"), "html")


@query("h04_strip_noise", f"WITH {T.CLEAN} SELECT page_id, html FROM clean")
def h04(spark, sf):
    return V.cleaned(spark, sf).select("page_id", "html")


@query("h05_candidate_blocks", _TREE + " SELECT page_id, pre, tag FROM nodes WHERE tag IN ('div', 'section', 'article')")
def h05(spark, sf):
    rows = node_table(V.cleaned(spark, sf)).filter(F.col("tag").isin(*BLOCK_TAGS))
    return rows.select("page_id", F.col("pre").cast("bigint").alias("pre"), "tag")


_FEATS = f"WITH {T.CLEAN}, {T.nodes()}, {T.features()}"


@query("h06_long_blocks", _FEATS + " SELECT page_id, pre, f_text_n FROM feats WHERE f_text_n > 100")
def h06(spark, sf):
    rows = B.block_features(node_table(V.cleaned(spark, sf))).filter(F.col("f_text_n") > 100)
    return rows.select("page_id", F.col("pre").cast("bigint").alias("pre"), "f_text_n")


@query("h11_page_text",
       _TREE + " SELECT page_id, coalesce(string_agg(text, '' ORDER BY id) FILTER (tag = '#text'), '') AS text FROM nodes GROUP BY page_id")
def h11(spark, sf):
    return with_text(V.cleaned(spark, sf), "html").select("page_id", "text")


@query("h11_page_text_by_nodes", SQL["h11_page_text"])
def h11_nodes(spark, sf):
    return page_text(node_table(V.cleaned(spark, sf))).select("page_id", "text")


# every kind of reference, and what must stay or be decoded once only
_REFERENCES = "a&#x27;b &#38;lt; &amp;lt; &#128512; &#x1F600; &#0; &#55296; &#1114112; &#00000000065; &unknown; &amp &quot;"
_DECODED = "a''b &lt; &lt; 😀 😀 \ufffd \ufffd \ufffd A &unknown; &amp \""


@query("h12_entities", f"SELECT page_id, {T.decode('html')} || '{_DECODED}' AS text FROM pages")
def h12(spark, sf):
    return V.pages(spark, sf).select("page_id", H.decode_entities(F.concat("html", F.lit(_REFERENCES))).alias("text"))


# ---------------------------------------------------------------- block features


def _features(spark, sf, tags=False) -> DataFrame:
    return B.block_features(node_table(V.cleaned(spark, sf)), with_tags=tags).withColumn("pre", F.col("pre").cast("bigint"))


def _feature_query(number: int, name: str):
    is_ratio = name == "f_link_density"
    shown = f"round({name}, 9)" if is_ratio else name

    def run(spark, sf):
        value = F.round(name, 9) if is_ratio else F.col(name)
        return _features(spark, sf).select("page_id", "pre", value.alias(name))

    QUERIES[f"f{number:02d}_{name[2:]}"] = run
    SQL[f"f{number:02d}_{name[2:]}"] = _FEATS + f" SELECT page_id, pre, {shown} AS {name} FROM feats"


for _n, _name in enumerate(B.FEATURES, 1):
    _feature_query(_n, _name)


@query("f22_all_tags", _FEATS + " SELECT page_id, pre, array_to_string(f_all_tags, ' ') AS tags FROM feats")
def f22(spark, sf):
    return _features(spark, sf, True).select("page_id", "pre", F.array_join("f_all_tags", " ").alias("tags"))


@query("f22_block_tags", _FEATS + " SELECT page_id, pre, unnest(f_all_tags) AS tag FROM feats")
def f22_rows(spark, sf):
    return B.block_tags(node_table(V.cleaned(spark, sf))).select("page_id", F.col("pre").cast("bigint").alias("pre"), "tag")


def _shown(names):
    return ", ".join(f"round({n}, 9) AS {n}" if n == "f_link_density" else n for n in names)


def _columns(names):
    return [F.round(n, 9).alias(n) if n == "f_link_density" else F.col(n) for n in names]


@query("f23_vector_v1", _FEATS + f" SELECT page_id, pre, {_shown(B.FEATURES_V1)} FROM feats")
def f23(spark, sf):
    return _features(spark, sf).select("page_id", "pre", *_columns(B.FEATURES_V1))


@query("f24_vector_v2", _FEATS + f" SELECT page_id, pre, {_shown(B.FEATURES)}, array_to_string(f_all_tags, ' ') AS tags FROM feats")
def f24(spark, sf):
    return _features(spark, sf, True).select("page_id", "pre", *_columns(B.FEATURES), F.array_join("f_all_tags", " ").alias("tags"))


# ---------------------------------------------------------------- block choice

# Slot order of the dense block features, for comparison with the engine's.
SLOTS_SQL = (
    "f_p_n", "f_tag_n", "f_h_n", "f_np_n", "f_text_n", "f_img_n", "f_a_n", "f_form_element_n", "f_element_maxtextlen",
    "f_none_n", "f_side_n", "f_main_n", "f_child_div_n", "f_child_p_n", "f_link_density", "f_nav_n", "f_li_n", "f_li_a_n",
    "f_h1_n", "f_dom_depth", "f_depth_to_p",
)


def sql_scaled(name: str) -> str:
    return f"ln(1e-4 + {name})" if name == "f_link_density" else f"ln(1 + {name}::DOUBLE)"


def sql_block_entries(source: str = "feats", keys: str = "page_id, pre") -> str:
    """CTEs ``slots`` (one row per block and feature) and ``entries`` (keys, idx, value)."""
    rows = " UNION ALL ".join(
        f"SELECT {keys}, {i} AS slot, '{n}' AS name, {sql_scaled(n)} AS x FROM {source}" for i, n in enumerate(SLOTS_SQL)
    )
    step = V.sql_bucket("name || ':' || trunc(x * 3)::BIGINT", 9000)
    tag = V.sql_bucket("'f_all_tags:' || tag", 9000)
    return f"""
slots AS ({rows}),
entries AS (
  SELECT {keys}, slot::BIGINT AS idx, x AS value FROM slots
  UNION ALL SELECT {keys}, 1000 + {step}, 1.0 FROM slots
  UNION ALL SELECT {keys}, 1000 + {tag}, 1.0 FROM (SELECT {keys}, unnest(f_all_tags) AS tag FROM {source})
)"""


BLOCK_SCORES = (
    f"{_FEATS}, {sql_block_entries()}, {V.SQL_MODEL}, "
    f"scores AS (SELECT page_id, pre, round(sum(value * weight) + {V.SQL_INTERCEPT}, 9) AS score "
    "FROM entries JOIN model USING (idx) GROUP BY page_id, pre), "
    "scored AS (SELECT f.*, s.score FROM feats f JOIN scores s USING (page_id, pre))"
)
_BEST = (
    "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pre) AS r FROM scored "
    "WHERE f_text_n > 100) WHERE r = 1 AND score >= -0.1)"
)
_MAIN = (
    BLOCK_SCORES + f", {T.ends()}, " + _BEST + ", main AS (SELECT c.page_id, coalesce(substr(c.html, b.src_start + 1, e.src_end - b.src_start), '') AS body "
    "FROM clean c LEFT JOIN best b ON b.page_id = c.page_id LEFT JOIN ends e ON e.page_id = b.page_id AND e.id = b.blk)"
)


def scored(spark, sf) -> DataFrame:
    return X.score_blocks(V.cleaned(spark, sf), V.model(spark))


@query("h07_main_content", _MAIN + " SELECT page_id, body FROM main")
def h07(spark, sf):
    return X.main_content(X.clean_pages(V.stored_pages(spark, sf)), V.model(spark))


@query("h08_ranked_blocks",
       BLOCK_SCORES + " SELECT page_id, pre, round(score, 6) AS score, f_text_n, f_tag_n, "
       "row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pre) AS rank FROM scored")
def h08(spark, sf):
    rows = X.rank_blocks(V.cleaned(spark, sf), V.model(spark))
    return rows.select(
        "page_id", F.col("pre").cast("bigint").alias("pre"), F.round("score", 6).alias("score"), "f_text_n", "f_tag_n",
        F.col("rank").cast("bigint").alias("rank"),
    )


_ARTICLES = (
    _MAIN + ", texts AS (SELECT b.page_id, string_agg(n.text, '' ORDER BY n.id) AS text FROM best b JOIN nodes n "
    "ON n.page_id = b.page_id AND n.tag = '#text' AND list_contains(list_transform(n.path, lambda x: x.id), b.blk) GROUP BY b.page_id)"
)


@query("h09_article_gate",
       _ARTICLES + " SELECT m.page_id, CASE WHEN strlen(coalesce(t.text, '')) >= 500 THEN 'article' ELSE 'short' END AS outcome "
       "FROM main m LEFT JOIN texts t USING (page_id)")
def h09(spark, sf):
    _, outcomes = X.extract_articles(_rss_html(spark, sf), V.model(spark), html_col="html")
    return outcomes.select(F.col("id").alias("page_id"), "outcome")


def _rss_html(spark, sf) -> DataFrame:
    return V.stored_rss(spark, sf)


@query("h10_articles",
       _ARTICLES + f" SELECT m.page_id AS id, {T.decode(_RAW_TITLE.replace('html', 'c.raw'))} AS title, c.url AS link, m.body, "
       "strftime(TIMESTAMP '2024-01-31' - to_hours(m.page_id * 3 % 720), '%Y-%m-%d %H:%M:%S') AS date "
       "FROM main m JOIN texts t USING (page_id) JOIN clean c USING (page_id) WHERE strlen(t.text) >= 500")
def h10(spark, sf):
    rows, _ = X.extract_articles(_rss_html(spark, sf), V.model(spark), html_col="html")
    return rows.select("id", "title", "link", "body", "date")


@query("w01_first_best_block", BLOCK_SCORES + ", " + _BEST + " SELECT page_id, pre, round(score, 6) AS score FROM best")
def w01(spark, sf):
    rows = B.best_blocks(scored(spark, sf))
    return rows.select("page_id", F.col("pre").cast("bigint").alias("pre"), F.round("score", 6).alias("score"))


@query("w03_running_counts",
       _TREE + " SELECT page_id, pre, sum(CASE WHEN tag = 'p' THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pre "
       "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS p_so_far FROM nodes")
def w03(spark, sf):
    rows = B.running_counts(node_table(V.cleaned(spark, sf)), F.col("tag") == "p")
    return rows.select("page_id", F.col("pre").cast("bigint").alias("pre"), F.col("n").alias("p_so_far"))


@query("a05_best_score", BLOCK_SCORES + " SELECT page_id, round(max(score), 6) AS score FROM scored GROUP BY page_id")
def a05(spark, sf):
    return scored(spark, sf).groupBy("page_id").agg(F.round(F.max("score"), 6).alias("score"))


_PARA = "(tag IN ('p', 'blockquote'))"


@query("j09_containment",
       _TREE + """ SELECT b.page_id, b.pre, count(*) AS n_nodes, max(n.pre) AS last FROM nodes b JOIN nodes n ON n.page_id = b.page_id
 AND (n.id = b.id OR list_contains(list_transform(n.path, lambda x: x.id), b.id)) WHERE b.tag IN ('div', 'section', 'article')
 GROUP BY b.page_id, b.pre""")
def j09(spark, sf):
    """Nodes inside a block: the running number of nodes at its last less that before its first."""
    nodes = node_table(V.cleaned(spark, sf)).filter(F.col("tag").isin(*BLOCK_TAGS))
    inside = (F.col("last") - F.col("pre") + 1).cast("bigint")
    return nodes.select("page_id", F.col("pre").cast("bigint").alias("pre"), inside.alias("n_nodes"), F.col("last").cast("bigint").alias("last"))


_FRAGMENTS = """
fragments AS (
  SELECT page_id * 4 AS id, regexp_extract(html, '(?s)<article[ >].*</article>', 0) AS body, 1 AS y FROM pages
  UNION ALL SELECT page_id * 4 + 1, regexp_extract(html, '(?s)<nav[ >].*</nav>', 0), -1 FROM pages
  UNION ALL SELECT page_id * 4 + 2, regexp_extract(html, '(?s)<footer[ >].*</footer>', 0), -1 FROM pages
  UNION ALL SELECT page_id * 4 + 3, regexp_extract(html, '(?s)<div[ >].*</div>', 0), -1 FROM pages
)"""
_FRAGMENT_PAGES = _FRAGMENTS + ", fragment_pages AS (SELECT id AS page_id, body AS html FROM fragments)"
_DOCUMENT = f"""WITH {_FRAGMENT_PAGES}, {T.nodes("fragment_pages")},
 sums AS (SELECT n.page_id, sum(CASE WHEN tag = '#text' THEN strlen(text) ELSE 0 END)::BIGINT AS f_text_n,
  count(*) FILTER ({_PARA}) AS f_p_n, count(*) FILTER (tag <> '#text') AS f_tag_n,
  count(*) FILTER (tag IN ('h1', 'h2', 'h3', 'h4', 'h5')) AS f_h_n,
  coalesce(sum(CASE WHEN tag = '#text' AND len(list_filter(path, lambda x: x.tag = 'a')) > 0 THEN strlen(replace(text, ' ', '')) ELSE 0 END)::DOUBLE
   / nullif(sum(CASE WHEN tag = '#text' THEN strlen(replace(text, ' ', '')) ELSE 0 END), 0), 0) AS f_link_density,
  count(*) FILTER (tag NOT LIKE '#%' AND tag NOT IN ('p', 'h1', 'h2', 'h3', 'h4', 'h5', 'blockquote', 'span', 'div', 'table',
   'tr', 'td', 'th', 'img', 'br')) AS f_np_n FROM nodes n GROUP BY n.page_id)"""


@query("s13_labelled_blocks",
       _DOCUMENT + " SELECT f.id, f.body, f.y::BIGINT AS y, s.f_text_n, s.f_p_n, s.f_tag_n - 2 AS f_tag_n, s.f_h_n, s.f_np_n - 2 AS f_np_n, "
       "round(s.f_link_density, 9) AS f_link_density FROM fragments f JOIN sums s ON s.page_id = f.id")
def s13(spark, sf):
    from leafsift.operators.samples import labelled_blocks

    rows = labelled_blocks(V.fragments(spark, sf))
    density = F.round("f_link_density", 9).alias("f_link_density")
    return rows.select("id", "body", F.col("y").cast("bigint").alias("y"), "f_text_n", "f_p_n", "f_tag_n", "f_h_n", "f_np_n", density)


@query("s13_labelled_blocks_as_documents",
       _DOCUMENT + " SELECT f.id, s.f_text_n, s.f_p_n, s.f_tag_n, s.f_h_n, s.f_np_n FROM fragments f JOIN sums s ON s.page_id = f.id")
def s13_documents(spark, sf):
    from leafsift.operators.samples import labelled_blocks

    rows = labelled_blocks(V.fragments(spark, sf), "document")
    return rows.select("id", "f_text_n", "f_p_n", "f_tag_n", "f_h_n", "f_np_n")


@query("s14_remove_samples",
       f"WITH {_FRAGMENTS} SELECT id, y::BIGINT AS y, strlen(body) AS n FROM fragments WHERE id NOT IN (SELECT page_id * 3 FROM pages)")
def s14(spark, sf):
    store = sample_store(spark, scratch_path(spark, "samples"))
    append_samples(store, V.fragments(spark, sf))
    for _ in range(2):
        remove_samples(store, V.pages(spark, sf).select((F.col("page_id") * 3).alias("id")))
    rows = store.read()
    return rows.select("id", F.col("y").cast("bigint").alias("y"), F.octet_length("body").cast("bigint").alias("n"))


@query("s15_samples", f"WITH {_FRAGMENTS} SELECT y::BIGINT AS y, body FROM fragments")
def s15(spark, sf):
    store = sample_store(spark, scratch_path(spark, "samples"))
    append_samples(store, V.fragments(spark, sf))
    return store.read().select(F.col("y").cast("bigint").alias("y"), "body")


@query("l12_review_sample",
       _DOCUMENT + ", one AS (SELECT * FROM fragments ORDER BY md5(id || '-7'), id LIMIT 1) "
       "SELECT o.id, o.y::BIGINT AS y, s.f_text_n, s.f_p_n, s.f_tag_n - 2 AS f_tag_n, s.f_h_n, s.f_np_n - 2 AS f_np_n, "
       "round(s.f_link_density, 9) AS f_link_density, true AS score_is_decision FROM one o JOIN sums s ON s.page_id = o.id")
def l12(spark, sf):
    from leafsift.operators.encoding import with_block_entries
    from leafsift.operators.linear import decision_values
    from leafsift.operators.samples import review

    one = review(V.fragments(spark, sf), V.model(spark), 7)
    again = decision_values(with_block_entries(one.drop("score")), V.model(spark)).select(F.col("score").alias("_again"))
    rows = one.join(again, F.abs(F.col("score") - F.col("_again")) < 1e-9, "left")
    names = ("f_text_n", "f_p_n", "f_tag_n", "f_h_n", "f_np_n")
    density = F.round("f_link_density", 9).alias("f_link_density")
    return rows.select("id", F.col("y").cast("bigint").alias("y"), *names, density, F.col("_again").isNotNull().alias("score_is_decision"))
