"""Page shredding, selectors, product extraction and ranked links."""

import time

import pytest
from pyspark.sql import functions as F

from shopmill.operators.extract import (
    alternative_prices,
    content_types,
    extract_products,
    page_categories,
    select_elements,
    split_throttled,
)
from shopmill.operators.rank import bestseller_links, check_ranks, result_counts, search_links
from shopmill.operators.select import SelectorSet, element, steps_of
from shopmill.operators import shred as shred_module
from shopmill.operators.shred import _inspector, _shred, elements_table, shred, slice_text
from shopmill.schemas import PRODUCT
from shopmill.sources.tables import read_pages

ODD = (
    "<!DOCTYPE html><html><body><!-- <p>no</p> --><p>a<b>x<p>b &amp; c<ul><li>1<li>2 <a href='/dp/x>y'>k</a></ul>"
    "<table><tr><td>Brand<td>Acme</table><script>var t = '</p>';</script><div hidden>no<i>deep</i></div>"
    "<DIV CLASS='q  r' style='color:red; DISPLAY : none'>z</DIV><br/>tail</b></body></html>"
)


def elements(spark, html, **prune):
    pages = spark.createDataFrame([(1, html)], "page_id bigint, html string")
    rows = elements_table(shred(pages, **prune)).orderBy("pos").collect()
    return {f"{r['tag']}{r['nth']}@{r['depth']}": r for r in rows}


def test_tree_of_sloppy_markup(spark):
    found = elements(spark, ODD)
    assert list(found) == [
        "html1@0", "body1@1", "p1@2", "b1@3", "p2@2", "ul1@2", "li1@3", "li2@3", "a1@4", "table1@2", "tr1@3",
        "td1@4", "td2@4", "script1@2", "div1@2", "i1@3", "div2@2", "br1@2",
    ]
    assert found["a1@4"]["attrs"] == {"href": "/dp/x>y"}
    assert found["p2@2"]["text"] == "b & c" and found["table1@2"]["text"] == "BrandAcme"
    assert found["div2@2"]["classes"] == ["q", "r"]
    assert [k for k, r in found.items() if not r["visible"]] == ["div1@2", "i1@3", "div2@2"]
    assert found["li2@3"]["last_child"] and not found["li1@3"]["last_child"]
    assert found["html1@0"]["end_pos"] == 17 and found["ul1@2"]["end_pos"] == found["a1@4"]["pos"]


def test_shown_text_leaves_out_scripts_and_hidden_parts(spark):
    pages = spark.createDataFrame([(1, ODD), (2, None), (3, "plain <"), (4, "<p>a</b></p><p unclosed='x")], "page_id int, html string")
    rows = {r["page_id"]: r for r in shred(pages).collect()}
    assert rows[1]["shown"].strip().split("\n") == ["ax", "b & c", "1", "2 k", "Brand\tAcme", "", "tail"]
    assert rows[2]["elements"] == [] and rows[3]["shown"] == "plain <"
    assert [e["tag"] for e in rows[4]["elements"]] == ["p"]


def test_pruning_keeps_what_selectors_need(spark):
    found = elements(spark, ODD, probes=["/dp/", "<td"], levels=1)
    assert list(found) == ["li2@3", "a1@4", "tr1@3", "td1@4", "td2@4"]


@pytest.mark.parametrize(
    "selector, texts",
    [
        (("ID", "one"), ["1"]),
        (("CSS_SELECTOR", "#one"), ["1"]),
        (("CSS_SELECTOR", "p.x.y"), ["2"]),
        (("CSS_SELECTOR", "div .x"), ["1", "2", "4"]),
        (("CSS_SELECTOR", "div div .x"), ["4"]),
        (("CSS_SELECTOR", "[data-k]"), ["2", "3"]),
        (("CSS_SELECTOR", '[data-k="v w"]'), ["2"]),
        (("CSS_SELECTOR", "p[class*='x y'], #one"), ["1", "2"]),
        (("CSS_SELECTOR", "section .x:first-child"), ["5"]),
        (("CSS_SELECTOR", "section .x:last-child"), ["6"]),
        (("CSS_SELECTOR", '.x:not([data-k="v w"])'), ["1", "4", "5", "6"]),
        (("XPATH", "//p[@id='one']"), ["1"]),
        (("XPATH", "//div[contains(@class, 'in')]//p"), ["4"]),
        (("XPATH", "//section/p[2]"), ["6"]),
        (("XPATH", "//section[contains(.,'5')]/p"), ["5", "6"]),
        (("XPATH", "//p[@class='x'][contains(text(),'6')]"), ["6"]),
        (("XPATH", "//p[@class='x y']/.."), ["1 2 3 4"]),
        (("XPATH", "//*[@data-k='k']"), ["3"]),
        (("XPATH", "//p[@class='x'][2]"), ["6"]),
        (("XPATH", "//div/p[contains(@data-k,' ')][1]"), ["2"]),
        (("XPATH", "//p[@data-k='k'][1]"), ["3"]),
        (("XPATH", "//p[contains(@class,'x')][2][@data-k='v w']"), ["2"]),
        (("XPATH", "//p[contains(@class,'x')][2][@data-k='k']"), []),
        (("XPATH", "//p[contains(@class,'x')][2][1]"), ["2", "6"]),
        (("XPATH", "//div/*[4]"), ["4"]),
        (("XPATH", "//div[contains(text(),'4')]"), []),
        (("XPATH", "//DIV[contains(.,'4')]//p"), ["1", "2", "3", "4"]),
        (("CSS_SELECTOR", "[DATA-K]"), ["2", "3"]),
    ],
)
def test_selectors(pages, selector, texts):
    html = (
        "<div><p id='one' class='x'>1</p> <p class='x y' data-k='v w'>2</p> <p data-k=k>3</p> "
        "<div class='inner'><p class='x'>4</p></div></div><section><p class='x'>5</p><p class='x'>6</p></section>"
    )
    levels = 1 if ".." in selector[1] else 0
    chosen = SelectorSet([selector])
    found = shred(pages(html).select("page_id", "html"), chosen.probes, levels).withColumn("hits", chosen.hits())
    each = F.transform(chosen.indexes(selector), lambda i: slice_text(F.col("text"), element(i)))
    assert found.select(each.alias("t")).first()["t"] == texts


def test_attribute_names_in_any_case_and_first_runs_of_text(pages):
    html = "<b DATA-Kind=x>1</b><b title='data-kind'>2</b><i>one<u>two</u>three</i><i>f<!-- -->our</i><i>a</zz>b</i>"
    wanted = {
        ("CSS_SELECTOR", "[data-kind]"): 1,
        ("XPATH", "//b[@Data-Kind='x']"): 1,
        ("XPATH", "//i[contains(text(),'one')]"): 1,
        ("XPATH", "//i[contains(text(),'two')]"): 0,
        ("XPATH", "//i[contains(text(),'three')]"): 0,
        ("XPATH", "//i[contains(text(),'our')]"): 0,
        ("XPATH", "//i[contains(text(),'ab')]"): 1,
    }
    chosen = SelectorSet(list(wanted))
    found = shred(pages(html).select("page_id", "html"), chosen.probes).withColumn("hits", chosen.hits())
    assert found.select(F.transform("hits", F.size)).first()[0] == list(wanted.values())


@pytest.mark.parametrize("bad", [("CSS_SELECTOR", "a > b"), ("XPATH", "//a[last()]"), ("NAME", "x")])
def test_unknown_selectors_are_refused(bad):
    with pytest.raises(ValueError):
        steps_of(bad)


def test_selector_chains(pages):
    html = "<p class='b' hidden>hidden</p><p class='b'>second</p><p class='c'>third</p><p class='c'>4</p>"
    chain = [("CSS_SELECTOR", ".a"), ("CSS_SELECTOR", ".b"), ("CSS_SELECTOR", ".c")]
    found = select_elements(pages(html), chain).orderBy("pos").collect()
    assert [r["text"] for r in found] == ["hidden", "second"]
    each = select_elements(pages(html), chain, chain=False).orderBy("pos").collect()
    assert [(r["priority"], r["text"]) for r in each] == [(2, "hidden"), (2, "second"), (3, "third"), (3, "4")]
    chosen = SelectorSet(chain)
    page = shred(pages(html).select("page_id", "html"), chosen.probes).withColumn("hits", chosen.hits())
    # a hidden first element sends the chain to the next selector, not to the next element
    assert page.select(chosen.first_text(chain, visible=True).alias("t")).first()["t"] == "third"
    assert page.select(chosen.first_text(chain).alias("t")).first()["t"] == "hidden"


def product(pages, body, **options):
    rows = extract_products(pages(f"<body>{body}</body>"), **options).collect()
    return rows[0] if rows else None


TITLE = "<span id=productTitle> Acme  Shoe </span>"


@pytest.mark.parametrize(
    "body, price",
    [
        ("<i class='a-price'><b class='a-offscreen'>$1,299.00</b></i>", "1299.00"),
        ("<i class='apexPriceToPay'><b class='a-offscreen'>$2</b></i>", "2.00"),
        ("<b id='priceblock_ourprice'>$3</b><b id='priceblock_dealprice'>$4</b>", "3.00"),
        ("<b id='priceblock_dealprice'>$4.5</b>", "4.50"),
        ("<b class='a-price-whole'>12.</b><b class='a-price-fraction'>34</b>", "12.34"),
        ("<b class='a-price-whole'>12.</b>", None),
        ("<i class='a-price'><b class='a-offscreen'></b></i>\"price\": \"$7.5\"", "7.50"),
        ("<script>{\"price\":\"8\"}</script>", "8.00"),
        ("<i class='a-price'><b class='a-offscreen'>soon</b></i>", None),
    ],
)
def test_current_price(pages, body, price):
    found = product(pages, TITLE + body)["price"]["current_price"]
    assert (None if found is None else str(found)) == price


def test_other_prices(pages):
    row = product(
        pages,
        TITLE + "<i class='a-price a-text-price' data-a-strike='true'><b class='a-offscreen'>$15</b></i>"
        "<b class='savingsPercentage'>-13.5%</b><b class='priceBlockSavingsString'>$2</b>",
    )["price"]
    assert [str(row["original_price"]), str(row["savings"]["amount"]), str(row["savings"]["percentage"])] == [
        "15.00", "13.50", "13.50",
    ]
    assert row["deal_price"] is None and row["price_range"]["min"] is None


def test_alternative_price_tries_on_after_an_unreadable_element(pages):
    bodies = [
        "<b id='priceblock_ourprice'>ask</b><i class='a-price a-text-price'><span aria-hidden='true'>$9</span></i>",
        "<b id='priceblock_dealprice'>$1,000</b>",
        "<b>none</b>",
    ]
    found = alternative_prices(pages(*bodies)).orderBy("page_id").collect()
    assert [None if r["price"] is None else str(r["price"]) for r in found] == ["9.00", "1000.00", None]


@pytest.mark.parametrize(
    "body, status",
    [
        ("<input id='add-to-cart-button'><b id='outOfStock'>x</b>", "In Stock"),
        ("<input id='buy-now-button'>", "In Stock"),
        ("<b class='out-of-stock'>x</b><b id='preOrderButton'>x</b>", "Currently unavailable"),
        ("<b id='preOrderButton'>x</b>", "Available for Pre-order"),
        ("<div id='availability'><span> In 2 days </span></div>", "In 2 days"),
        ("<div id='availability'><span> </span></div><b id='merchantInfoFeature'>m</b>", "m"),
        ("<b id='buybox-see-all-buying-choices'>more</b>", "more"),
        ("<script>{\"price\": 5}</script><b class='a-color-price'>x</b>", "In Stock"),
        ("<b class='a-color-price'>Soon</b>", "Soon"),
        ("<input id='add-to-cart-button' disabled>", "In Stock"),
        ("<b class='price-info'></b>", "In Stock"),
        ("", "Status Unknown"),
    ],
)
def test_availability(pages, body, status):
    assert product(pages, TITLE + body, fields=["availability"])["availability"] == status


def test_record_layout(spark, pages, tmp_path):
    pages(TITLE).write.parquet(str(tmp_path / "pages"))
    stored = read_pages(spark, str(tmp_path / "pages"))
    found = extract_products(stored, category=F.lit("c"), at=F.lit("2025-01-01"))
    assert [(f.name, f.dataType) for f in found.drop("page_id").schema] == [(f.name, f.dataType) for f in PRODUCT]
    assert found.first()["title"] == "Acme  Shoe"


def test_description_sections(pages):
    body = (
        "<div id='feature-bullets'><li>Good.<li>Read more</div><div id='productDescription'><p>Good.<script>f()</script></div>"
        "<div id='detailBullets_feature_div'>Please return it</div>"
        "<div id='productDetails_techSpec_section_1' hidden>Size: S</div>"
    )
    assert product(pages, TITLE + body)["description"] == "Product Description:\nGood.\n\nTechnical Details:\nSize: S"
    long = f"<div id='productDescription'>{'Word. ' * 8000}</div><div id='feature-bullets'>next</div>"
    found = product(pages, TITLE + long)["description"]
    assert len(found) <= 32000 and found.startswith("Product Description:\nWord.")


def test_brand_rating_image_and_reviews(pages):
    row = product(
        pages,
        TITLE + "<a id=bylineInfo href='/stores/foo-bar/x'> </a><i class='a-icon-alt'>4.0 out of 5 stars</i>"
        "<p>12 answered</p><p>1,002 global ratings</p><img id=landingImage hidden src=a><img class=a-dynamic-image src='b?x&amp;y'>",
    )
    assert (row["brand"], row["rating"], row["review_count"], row["image_url"]) == ("Foo Bar", 4.0, 1002, "b?x&y")
    assert product(pages, TITLE)["brand"] == "Acme"
    assert product(pages, TITLE + "<table><tr><td>Brand<td>Zed</table>")["brand"] == "Zed"


def test_records_need_title_or_price_and_a_readable_page(pages):
    assert product(pages, "<p>nothing</p>") is None
    assert product(pages, "<span id=productTitle> </span>") is None
    throttled = "Request was throttled. Please wait a moment and refresh the page"
    assert product(pages, TITLE + throttled) is None
    readable, again = split_throttled(pages("<p>a</p>", throttled, None))
    assert [readable.count(), again.count()] == [2, 1]


def test_category_and_content_type(pages):
    htmls = ["<h1 class='a-size-large'> Toys  now </h1><title>t</title>", "<title>T</title>", "<p>x</p>"]
    assert [r["category"] for r in page_categories(pages(*htmls)).orderBy("page_id").collect()] == [
        "Toys now", "T", "Amazon_Bestsellers",
    ]
    html = "<div id='x-Overview'><b class='pick'>1</b></div><b class='pick aplus'>2</b><b class=pick>3</b>"
    found = content_types(pages(html), [("CSS_SELECTOR", ".pick")]).orderBy("pos").collect()
    assert [r["content_type"] for r in found] == ["Product Overview", "Additional Information", None]


def item(asin, extra=""):
    return f"<div data-component-type='s-search-result'>{extra}<a href='/x/dp/{asin}/r'>t</a></div>"


def links(df):
    return [(r["source"], r["rank"], r["asin"][-1]) for r in df.orderBy("page_id", "rank", "pos").collect()]


def test_search_links(pages):
    badge = "<b class='zg-badge-text'>#{}</b>".format
    html = (
        item("B000000001", badge(3)) + item("B000000002", "<p data-component-type='sp-sponsored-result'></p>")
        + item("B000000003") + item("B000000001") + item("b000000009") + item("B000000004", badge("new"))
        + item("B000000005", badge(1))
    )
    assert links(search_links(pages(html), 10)) == [(0, 1, "5"), (0, 3, "1"), (0, 3, "3"), (0, 6, "4")]
    # the cut comes first: the repeated product takes the place of another one
    assert links(search_links(pages(html), 4)) == [(0, 1, "5"), (0, 3, "1"), (0, 3, "3")]
    counts = result_counts(pages(html), 7).first()
    assert (counts["items"], counts["enough"]) == (7, True)


def test_search_fallbacks(pages):
    bare = "<a href='/dp/B000000008'>x</a>" * 2 + "<a href='/dp/B000000009'>x</a>"
    second = "<li class='s-result-item' data-asin><a class='a-link-normal' href='/dp/B000000001'>x</a></li>" * 2
    third = "<li class='sg-col-inner'><a class='a-text-normal' href='/dp/B000000002'>x</a></li>"
    assert links(search_links(pages(bare, second + third + bare, third, "<p>none</p>"))) == [
        (5, 1, "8"), (5, 2, "9"), (2, 1, "1"), (3, 1, "2"),
    ]


def test_bestseller_links(pages):
    card = "<div class='zg-item'><i><b class='zg-bdg-text'>#{}</b></i><a href='/dp/B00000000{}'>x</a></div>".format
    nested = f"<div class='zg-grid-item'><a href='/dp/B000000009'>x</a>{card(1, 1)}</div>"
    assert links(bestseller_links(pages(card(2, 2) + nested + card("new", 3) + card(2, 2)), 3)) == [
        (0, 1, "1"), (0, 2, "2"), (0, 2, "2"),
    ]

    def deep(levels, n):
        return f"<ul><a href='/dp/B00000000{n}'>x</a>{'<div>' * levels}<b class='zg-ranking'>{n}</b>{'</div>' * levels}</ul>"

    html = deep(4, 1) + deep(5, 2)
    # five levels up from the second badge there is no link yet; its sixth ancestor would hold one
    assert links(bestseller_links(pages(html), 10)) == [(3, 1, "1")]
    assert links(bestseller_links(pages("<b class='zg-bdg-text'>#1</b><a href='/dp/B000000001'>x</a>"), 10)) == []


def test_rank_check(spark):
    rows = [(1, 1, 5), (1, 2, 6), (2, 1, 5), (2, 3, 6), (3, 2, 1), (3, 1, 2), (4, 1, 1), (4, 1, 2), (5, 1, 1)]
    found = check_ranks(spark.createDataFrame(rows, "page_id int, rank int, pos int")).collect()
    assert {r["page_id"]: (r["links"], r["in_order"]) for r in found} == {
        1: (2, True), 2: (2, False), 3: (2, False), 4: (2, False), 5: (1, True),
    }


@pytest.mark.parametrize(
    "piece",
    ["<a", "<a x ", "</a", "<a x=", "<a x = ", "<a x=y\"", "<a \"='", "x ", "<!--", "<!x", '<a x="', "<a x='", "<script></script", "<p><button>", "<div></b>", "<table><td>"],
)
def test_markup_that_never_ends_takes_linear_time(piece):
    def seconds(size):
        start = time.perf_counter()
        _shred((piece * (size // len(piece) + 1))[:size], _inspector(["none"]), 0, 1)
        return time.perf_counter() - start

    assert seconds(1_000_000) < 10


def test_end_tags_and_implied_ends_do_not_walk_deep_trees():
    page = "<p><button>" + "<b>" * 50_000 + "<div></i></div>" * 50_000
    start = time.perf_counter()
    _shred(page, _inspector(["none"]), 0, 1)
    assert time.perf_counter() - start < 10


@pytest.mark.parametrize("tail", ["<b", "<b x", '<b title="x>y', "</p", "<!-- x", "<!doctype", "<b x='>"])
def test_a_tag_cut_off_by_the_end_of_the_page_is_dropped(tail):
    # also where the page ends with ">": an open value quote takes it in
    text, _, elements, _ = _shred("<p>kept" + tail, _inspector(None), 0)
    assert text == "kept"
    assert [e[5] for e in elements] == ["p"]


@pytest.mark.parametrize(
    "tag, attributes",
    [
        ("<b x y>", {"x": "", "y": ""}),
        ("<b x = 1 y=a/b>", {"x": "1", "y": "a/b"}),
        ("<b x='a>b' y=\"c'>d\">", {"x": "a>b", "y": "c'>d"}),
        ("<b x=\"1\"y='2'z=3>", {"x": "1", "y": "2", "z": "3"}),
        ("<b x=a\"b=c'd>", {"x": "a\"b=c'd"}),  # quotes and = inside a bare value
        ("<b a\"b' c>", {"a\"b'": "", "c": ""}),  # quotes in names open nothing
        ("<b x= y>", {"x": "y"}),
        ("<b x=>", {"x": ""}),
        ("<b/x/y=1/>", {"x": "", "y": "1/"}),
        ("<b X=1 x=2>", {"x": "1"}),  # the first of equal names counts
        ("<b x='&lt;&amp;'>", {"x": "<&"}),
    ],
)
def test_attributes_of_a_start_tag(tag, attributes):
    text, _, elements, _ = _shred(f"{tag}in</b>out", _inspector(None), 0)
    (found,) = elements
    assert (text, found[5], found[11]) == ("inout", "b", attributes)


def test_an_end_tag_may_hold_attributes_and_comments_hide_tags():
    text, _, elements, _ = _shred("<p>a</p x='>'>b<!-- <i> -->c<!x y>d<?z <u>e", _inspector(None), 0)
    assert (text, [e[5] for e in elements]) == ("abcde", ["p"])


def test_a_tag_is_taken_apart_once(monkeypatch):
    class Counted:
        searches = 0

        def search(self, *where):
            self.searches += 1
            return token.search(*where)

    token, counted = shred_module.TOKEN, Counted()
    monkeypatch.setattr(shred_module, "TOKEN", counted)
    page = "<ul>" + "<li class='a>b'>x &amp; y</li >\n" * 500 + "</ul>"
    text, _, elements, having = _shred(page, _inspector(["a>b"]), 0, 1)
    assert len(elements) == 500 and having == [list(range(500))] and text == "x & y\n" * 500
    assert elements[499][10] == ["a>b"] and elements[499][6] == 500
    assert counted.searches < 600  # start tags with a > in a quote are looked at again, all others once


def test_a_full_table_of_tags_changes_nothing(monkeypatch):
    page = "".join(f"<p id='{i % 7}'>{i}<b>x</b></p><br>" for i in range(60))
    whole = _shred(page, _inspector(["<p", "<b"]), 0, 2)
    monkeypatch.setattr(shred_module, "KNOWN_TAGS", 3)
    assert _shred(page, _inspector(["<p", "<b"]), 0, 2) == whole and len(whole[2]) == 120
