from tidemark.llm import html_extract


def texts(pages):
    wrapper = html_extract.induce(pages)
    return wrapper, [html_extract.extract(p, wrapper) for p in pages]


def test_title_and_standfirst_beside_the_body_stay():
    body = "long text of the article number {k} " * 20
    pages = [("<body><article><header><h1>Title {k}</h1><p>standfirst {k}</p></header><div class=body><p>" + body + "</p></div></article></body>").format(k=k) for k in range(9)]
    wrapper, got = texts(pages)
    assert wrapper["root"][-1] == "article"
    assert all(g.startswith(f"Title {k} standfirst {k} long text") for k, g in enumerate(got))
    other = pages[3].replace("<article>", "<div>only this page</div><article>")
    assert html_extract.extract(other, wrapper).startswith("only this page Title 3")


def test_marked_wrapper_around_the_article_is_opened():
    body = "words of the article {k} " * 30
    for cls in ("content no-sidebar", "with-navbar", "sidebar-layout related"):
        pages = [f"<body><nav>menu {k}</nav><div class='{cls}'><article><h1>Title {k}</h1><p>{body.format(k=k)}</p></article></div><footer>f {k}</footer></body>" for k in range(9)]
        wrapper, got = texts(pages)
        assert all(g.startswith(f"Title {k} words of") and "menu" not in g and "f " + str(k) not in g.split() for k, g in enumerate(got)), cls
        assert html_extract.extract(pages[0], None).startswith("Title 0 words of")


def test_template_is_counted_over_all_pages_and_copies_count_once(spark):
    def page(k, body, more=""):
        return f"<body><article><h1>Title {k}</h1><p>{body}</p>{more}</article></body>"
    long = " ".join(f"long paragraph {k}" for k in range(30))
    rows = [(k, f"https://a.example/{k}", page(k, f"a text of its own, number {k}", "<div class=late><p>Follow us</p></div>" if k >= 20 else "")) for k in range(60)]
    rows += [(100 + k, f"https://b.example/{k}", page("same", long, f"<p>shared paragraph</p><p>revision {k}</p>")) for k in range(3)]
    rows += [(200 + k, f"https://c.example/{k}", rows[30][2]) for k in range(8)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(df).collect()}
    assert all(got[k] == f"Title {k} a text of its own, number {k}" for k in range(60))
    assert got[100] == f"Title same {long} shared paragraph revision 0"
    assert got[200] == "Title 30 a text of its own, number 30 Follow us"


def test_all_different_pages_show_what_a_marked_node_holds(spark):
    def page(k, body):
        return f"<body>{'<div class=rail><p>line</p></div>' if k % 2 else ''}<div class=box><h1>Title {k}</h1><p>short text {k}</p></div>{'<hr><div class=box>more</div>' * (k % 7)}{body}</body>"
    long = {k: " ".join(f"sentence {j} of the story {k}" for j in range(300)) for k in (54, 55)}
    rows = [(k, f"https://a.example/{k}", page(k, "")) for k in range(100, 260)]
    rows += [(k, f"https://a.example/{k}", page(k, f"<div class='related'><p>{t}</p></div>")) for k, t in long.items()]
    rows += [rows[3], (60, None, page(0, "")), (61, "https://a.example/e", ""), (62, "https://a.example/n", None)]
    # two of 163 pages hold most of the host's text, and a page with a little of it in the same node shows that this node counts for the host
    rows += [(70, "https://a.example/70", page(70, "<div class='related'><p>an addition</p></div>"))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract_pages(df.repartition(3)).collect()}
    assert got[54].endswith(long[54]) and got[55].endswith(long[55])
    assert got[70].endswith("an addition") and got[70].startswith("Title 70 short text 70")
    assert got[61] == got[62] == "" and got[60].startswith("Title 0")


def test_trees_of_a_host_are_aligned_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "FAN", 3)
    trees = [["", 0, [["body", 0, [[f"div.c{k % 5}", k + 1, [["p", 2, []]]], ["div.z!", 1, []]]]]] for k in range(11)]
    rows = [("h", html_extract.json.dumps(t)) for t in trees] + [("one", html_extract.json.dumps(trees[0]))]
    got = {r["host"]: html_extract.json.loads(r["tree"]) for r in html_extract.templates(spark.createDataFrame(rows, "host string, tree string")).collect()}

    def total(t):
        return t[1] + sum(map(total, t[2]))
    assert got["one"] == trees[0] and total(got["h"]) == sum(map(total, trees))
    body = got["h"][2]
    assert [c[0] for c in body] == ["body"] and [(c[0], c[1]) for c in body[0][2] if c[0].endswith("!")] == [("div.z!", 11)]
