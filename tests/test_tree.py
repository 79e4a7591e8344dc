import random

from pyspark.sql import functions as F

from leafsift.operators import blocks as B
from leafsift.operators.encoding import SLOTS
from leafsift.operators.tree import TEXT, VOID_TAGS, node_table, page_nodes
from leafsift.plans import extract as X
from queries import views as V


def shape(source):
    """Nested lists of tags, text in quotes; html and body left out."""
    rows = page_nodes(source)
    children = {}
    for r in rows:
        children.setdefault(r[2], []).append(r)

    def build(r):
        if r[4] == TEXT:
            return repr(r[6])
        inner = [build(c) for c in children.get(r[0], [])]
        return f"{r[4]}({' '.join(inner)})" if inner else r[4]

    body = next((r for r in rows if r[4] == "body"), None)
    return " ".join(build(c) for c in children.get(body[0], [])) if body else ""


def test_recovery():
    assert shape("<p>a<p>b") == "p('a') p('b')"
    assert shape("<ul><li>a<li>b</ul>") == "ul(li('a') li('b'))"
    assert shape("<table><tr><td>a<td>b<tr><td>c</table>") == "table(tr(td('a') td('b')) tr(td('c')))"
    assert shape("<p><b>x<p>y") == "p(b('x')) p('y')"
    assert shape("<div>a</span>b</div>c") == "div('ab') 'c'"
    assert shape("<div><p>a</div>b") == "div(p('a')) 'b'"
    assert shape("<table><tr><td></div>x</table>") == "table(tr(td('x')))"
    assert shape("a<br>b<img src=q>c<input>") == "p('a' br 'b' img 'c' input)"
    assert shape("<div/>x") == "div 'x'"
    assert shape("<p>1 < 2 &amp; 3</p>") == "p('1 < 2 & 3')"
    assert shape('<a title="x>y">t</a><!-- c -->') == "a('t') #comment"
    assert shape("<div><script>if (a</b) '</p>'</script>z</div>") == "div(script(\"if (a</b) '</p>'\") 'z')"
    assert shape("") == ""
    assert shape("<html><head><title>t</title></head><nav>n</nav></html>") == "nav('n')"


def test_nested_set_is_consistent():
    rng = random.Random(3)
    tags = ["div", "p", "b", "li", "ul", "a", "td", "tr", "table", "br", "section", "h1"]
    for _ in range(200):
        source = "".join(
            rng.choice(["<%s>", "</%s>", "t%s ", "<!-- %s -->"]) % rng.choice(tags) for _ in range(rng.randint(0, 40))
        )
        rows = page_nodes(source)
        assert [r[0] for r in rows] == list(range(len(rows)))
        for r in rows[1:]:
            parent = rows[r[2]]
            assert parent[0] < r[0] <= r[1] <= parent[1] and r[3] == parent[3] + 1
            assert r[9] == parent[9] + (r[4] == "a")
        runs = [r[6] for r in rows if r[4] == TEXT]
        assert all(runs)


def features(spark, *pages, **options):
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    rows = B.block_features(node_table(df), with_tags=True, **options).collect()
    return {(r["page_id"], r["pre"]): r for r in rows}


def test_feature_values_by_hand(spark):
    page = (
        '<div id="main"><h1>Té t</h1><p class="left">a b <a href="x">l k</a>after</p><ul><li>one<li><a>two</a></ul>'
        '<ol><li>q</ol><section><img src=s><blockquote>deep</blockquote></section><form><input></form></div> tail'
    )
    rows = features(spark, page)
    assert len(rows) == 2
    top = rows[0, 2]
    # Té t=5, "a b "=4, "l k"=3, after=5, one=3, two=3, q=1, deep=4, " tail"=5
    # longest capture: "Tét"; "after" is not one, as the match before it takes its opening tag
    want = {
        "f_text_n": 33, "f_p_n": 2, "f_tag_n": 15, "f_h_n": 1, "f_np_n": 10, "f_img_n": 1, "f_a_n": 2,
        "f_form_element_n": 2, "f_element_maxtextlen": 4, "f_side_n": 1, "f_main_n": 1, "f_child_div_n": 1,
        "f_child_p_n": 1, "f_li_n": 4, "f_li_a_n": 1, "f_h1_n": 1, "f_dom_depth": 3, "f_depth_to_p": 1, "f_nav_n": 0,
    }
    assert {k: top[k] for k in want} == want
    # links: "lk" + "after" (the tail of a) + "two" over all bytes without blanks
    assert abs(top["f_link_density"] - (2 + 5 + 3) / (4 + 2 + 2 + 5 + 3 + 3 + 1 + 4 + 4)) < 1e-12
    inner = next(r for (_, pre), r in rows.items() if pre != 2)
    assert (inner["f_depth_to_p"], inner["f_dom_depth"], inner["f_text_n"]) == (1, 1, 4)
    assert inner["f_all_tags"] == ["blockquote", "img", "section"]


def test_tail_is_optional_and_depth_capped(spark):
    page = "<div>abc</div>tail" + "<section>" + "<span>" * 30 + "<p>x</p>"
    with_tail, without = features(spark, page), features(spark, page, with_tail=False)
    assert with_tail[0, 2]["f_text_n"] == 7 and without[0, 2]["f_text_n"] == 3
    section = with_tail[0, 5]
    assert section["f_depth_to_p"] == 20 and section["f_dom_depth"] == 31


def test_features_do_not_depend_on_partitions(spark):
    pages = ["<div>" * (i % 5 + 1) + f"text {i}" + "<p>x</p>" * (i % 3) for i in range(40)]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    one = B.block_features(node_table(df.repartition(1)), with_tags=True)
    many = B.block_features(node_table(df.repartition(7)), with_tags=True)
    assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, many.collect()), key=str)


def naive(rows, block):
    """The features of one block by walking its nodes again."""
    inside = [r for r in rows if block[0] <= r[0] <= block[1]]
    elements = [r for r in inside if not r[4].startswith("#")]
    tails = [r for r in rows if r[4] == TEXT and r[11] == block[0]]
    texts = [r[6] for r in inside if r[4] == TEXT] + [r[6] for r in tails]
    size = lambda t: len(t.replace(" ", "").encode())

    def sub(r):
        return sum(size(x[6]) for x in rows if x[4] == TEXT and (r[0] <= x[0] <= r[1] or x[11] == r[0]))

    links = sum(sub(r) for r in elements if r[4] == "a" and r[0] != block[0])
    total = sum(map(size, texts))
    paragraphs = [r[3] for r in elements if r[4] in ("p", "blockquote")]
    return {
        "f_text_n": sum(len(t.encode()) for t in texts),
        "f_tag_n": len([r for r in inside if r[4] != TEXT]),
        "f_link_density": links / total if total else 0.0,
        "f_child_p_n": len([r for r in elements if r[2] == block[0] and r[4] in ("p", "blockquote")]),
        "f_child_div_n": len([r for r in elements if r[2] == block[0] and r[4] in ("div", "section", "article")]),
        "f_li_a_n": len([r for r in elements if r[4] in ("li", "ol") and any(x[4] == "a" and r[0] < x[0] <= r[1] for x in rows)]),
        "f_dom_depth": max(r[3] for r in elements) - block[3],
        "f_depth_to_p": min([20] + [d - block[3] for d in paragraphs]),
        "f_np_n": len([r for r in elements if r[4] not in B.PLAIN_TAGS]),
    }


def test_features_equal_a_walk_over_each_block(spark):
    rng = random.Random(11)
    tags = ["div", "p", "a", "li", "ol", "section", "span", "b", "img", "blockquote", "article", "h2"]
    pages = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 60)):
            tag = rng.choice(tags)
            parts.append(rng.choice([f"<{tag}>", f"</{tag}>", "wörd x ", "<!-- hide -->", f"<{tag}>"]))
        pages.append("".join(parts))
    got = features(spark, *pages)
    seen = 0
    for number, source in enumerate(pages):
        rows = page_nodes(source)
        for block in (r for r in rows if r[4] in ("div", "section", "article")):
            row = got[number, block[0]]
            for name, value in naive(rows, block).items():
                assert abs(row[name] - value) < 1e-9, (source, block, name)
            seen += 1
    assert seen == len(got) > 100


def serialised(rows, block):
    """Markup of a block written out again, attributes left out."""
    out, stack = [], []
    for r in rows:
        if not block[0] <= r[0] <= block[1]:
            continue
        while stack and stack[-1][1] < r[0]:
            out.append(f"</{stack.pop()[4]}>")
        if r[4] == TEXT:
            out.append(r[6].replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))
        elif r[4] == "#comment":
            out.append("<!--c-->")
        else:
            out.append(f"<{r[4]}>")
            if r[4] not in VOID_TAGS:
                stack.append(r)
    return "".join(out) + "".join(f"</{r[4]}>" for r in reversed(stack))


def test_longest_capture_equals_the_pattern(spark):
    import re

    rng = random.Random(5)
    tags = ["div", "p", "b", "span", "br", "section", "i"]
    pages = []
    for _ in range(80):
        parts = [rng.choice(["<%s>", "</%s>", "</%s>"]) % rng.choice(tags) if rng.random() < 0.65
                 else "w" * rng.randint(1, 9) + rng.choice(["", " ", "&amp;"]) for _ in range(50)]
        pages.append("<div>" + "".join(parts))
    got = features(spark, *pages)
    for number, source in enumerate(pages):
        rows = page_nodes(source)
        for block in (r for r in rows if r[4] in ("div", "section")):
            found = re.findall(r"<.+?>([^<>]+?)</.+?>", serialised(rows, block), re.S)
            want = max([0] + [len(x.replace(" ", "").encode()) for x in found])
            assert got[number, block[0]]["f_element_maxtextlen"] == want, (source, block)


def model_of(spark, **weights):
    rows = [("m", SLOTS.index(k), float(v)) for k, v in weights.items() if k != "b"] + [("m", -1, float(weights.get("b", 0)))]
    return spark.createDataFrame(rows, "model string, idx int, weight double")


def test_block_choice(spark):
    long = "word " * 30
    pages = [
        f"<div>{long}<section><p>{long}</p><article>{long}</article></section></div><div>{long}</div>",
        "<p>no block here</p>",
        f"<div>{long}</div><div>{long}</div>",
        "<div>short</div>",
    ]
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")
    main = {r["page_id"]: r["body"] for r in X.main_content(df, model_of(spark, f_p_n=1, f_child_div_n=-1)).collect()}
    assert main[0] == f"<div>{long}<section><p>{long}</p><article>{long}</article></section></div>"
    # section and the outer div score the same, the first one wins; two equal divs as well
    assert main[1] == "" and main[3] == "" and main[2] == f"<div>{long}</div>"
    low = X.main_content(df, model_of(spark, b=-0.11)).collect()
    assert {r["body"] for r in low} == {""}
    edge = X.main_content(df, model_of(spark, b=-0.1)).filter(F.col("body") != "").count()
    assert edge == 2


def test_ranked_blocks_keep_short_ones(spark):
    df = spark.createDataFrame([(1, "<div>a<section>b</section></div>")], "page_id long, html string")
    rows = X.rank_blocks(df, model_of(spark, f_child_div_n=1)).orderBy("rank").collect()
    assert [(r["rank"], r["pre"]) for r in rows] == [(1, 2), (2, 4)]


def test_outcomes_are_recorded_and_skipped_next_time(spark):
    rss = spark.createDataFrame(
        [(1, "t", "http://h/1", "<div>" + "word " * 120 + "</div>", "Mon May  6 20:07:54 2019"), (2, "u", "http://h/2", "<div>x</div>", "Mon May  6 20:07:54 2019")],
        "id long, title string, link string, body string, date string",
    )
    articles, outcomes = X.extract_articles(rss, model_of(spark, b=1))
    assert [(r["id"], r["date"]) for r in articles.collect()] == [(1, "2019-05-06 20:07:54")]
    assert {r["id"]: r["outcome"] for r in outcomes.collect()} == {1: "article", 2: "short"}
    again, rest = X.extract_articles(rss, model_of(spark, b=1), done=outcomes)
    assert again.count() == 0 and rest.count() == 0


def test_fragments_measure_their_own_root_or_the_document(spark):
    rows = [(1, "<section><div>a</div><p>b</p></section>x"), (2, "lead <div><p>q</p></div>"), (3, "<!-- c --><article>z</article>")]
    df = spark.createDataFrame(rows, "id long, body string")
    own = {r["page_id"]: r for r in B.fragment_features(df, "id", "body").collect()}
    assert (own[1]["f_tag_n"], own[1]["f_child_div_n"], own[1]["f_child_p_n"], own[1]["f_text_n"]) == (3, 1, 1, 3)
    assert own[1]["f_all_tags"] == ["div", "p", "section"]
    whole = {r["page_id"]: r for r in B.fragment_features(df, "id", "body", "document").collect()}
    assert (whole[1]["f_tag_n"], whole[1]["f_child_div_n"], whole[1]["f_text_n"]) == (5, 0, 3)
    assert whole[1]["f_all_tags"] == ["body", "div", "html", "p", "section"]
    assert own[3]["f_tag_n"] == 1


def test_view_of_articles_has_the_declared_columns(spark):
    assert "score" in V.articles(spark, "/root/testdata/sf0.001").columns


def test_folds_over_nested_ranges_equal_slices():
    import numpy as np

    rng = random.Random(5)
    for _ in range(200):
        n = rng.randint(1, 30)
        ranges, open_ = [], []
        for i in range(n):  # nested like elements
            while open_ and rng.random() < 0.4:
                ranges[open_.pop()][1] = i - 1
            if rng.random() < 0.6:
                ranges.append([i, n - 1])
                open_.append(len(ranges) - 1)
        ranges = [(a, max(a, b)) for a, b in ranges]
        pre, last = (np.array([r[k] for r in ranges], np.int64) for k in (0, 1))
        values = np.array([rng.randint(0, 99) for _ in range(n)])
        sums = B.running_sums(values)
        assert (sums[last + 1] - sums[pre]).tolist() == [values[a : b + 1].sum() for a, b in ranges]
        assert B.folded(pre, last, values, np.maximum).tolist() == [values[a : b + 1].max() for a, b in ranges]
        bits = np.array([1 << int(v) for v in values], dtype=object)
        assert B.folded(pre, last, bits, np.bitwise_or).tolist() == [int(np.bitwise_or.reduce(bits[a : b + 1])) for a, b in ranges]


def test_deeply_nested_page_in_bounded_memory(spark):
    """Twenty thousand divs in one another: lists of enclosing blocks would take some 3 GB."""
    import resource

    n = 20_000
    page = "<body>" + "<div>t" * n + "<p>end</p>" + "</div>" * n + "</body>"
    before = resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss
    df = spark.createDataFrame([(1, page), (2, "<div>x</div>")], "page_id long, html string").coalesce(1)
    found = B.block_features(node_table(df), with_tags=True)
    total = found.groupBy("page_id").agg(F.count(F.lit(1)).alias("n"), F.max("f_text_n").alias("text"), F.max("f_dom_depth").alias("deep"), F.sum("f_p_n").alias("p"), F.min(F.size("f_all_tags")).alias("tags"))
    rows = {r["page_id"]: r for r in total.collect()}
    assert (rows[1]["n"], rows[1]["text"], rows[1]["deep"], rows[1]["p"], rows[1]["tags"]) == (n, n + 3, n, n, 2)
    assert (rows[2]["n"], rows[2]["text"]) == (1, 1)
    assert resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss - before < 1_000_000  # KB


def test_pages_cut_anywhere_by_batches_are_measured_whole(spark):
    df = spark.createDataFrame([(i, "<div>a<section><p>b</p></section>tail</div>" * (i % 5)) for i in range(60)], "page_id long, html string").coalesce(2)
    want = sorted(map(tuple, B.block_features(node_table(df), with_tags=True).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = sorted(map(tuple, B.block_features(node_table(df), with_tags=True).collect()))
        counts = {(r["page_id"], r["pre"]): r["n"] for r in B.running_counts(node_table(df), F.col("tag") == "p").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    assert got == want and len(want) == 2 * sum(i % 5 for i in range(60))
    assert all(n == sum(r["tag"] == "p" for r in node_table(df).filter(f"page_id = {i} and pre <= {pre}").collect()) for (i, pre), n in list(counts.items())[::40])


def test_every_element_has_its_piece_of_the_text():
    from leafsift.operators.tree import with_text_ranges

    rng = random.Random(6)
    tags = ["div", "p", "b", "li", "ul", "a", "br", "section"]
    for _ in range(100):
        source = "".join(rng.choice(["<%s>", "</%s>", "\U0001f600%s ", "<!-- %s -->"]) % rng.choice(tags) for _ in range(rng.randint(0, 40)))
        rows = with_text_ranges(page_nodes(source))
        whole = "".join(r[6] for r in rows if r[4] == TEXT)
        for r in rows:
            inside = "".join(x[6] for x in rows[r[0] : r[1] + 1] if x[4] == TEXT)
            tail = "".join(x[6] for x in rows if x[4] == TEXT and x[11] == r[0])
            assert whole[r[14] : r[15]] == inside and whole[r[14] : r[16]] == inside + tail
