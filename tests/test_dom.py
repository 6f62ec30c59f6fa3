"""Nodes and records of written pages."""

from pyspark.sql import functions as F

from tessera.operators import dom

PAGE = """<div class="x list-group-item"><div><a href=# class="product-link">B01</a><p>text<p>more</div><h4 class="t product-title">\n A &amp; B <b>bold</b></h4>
<div><h5 class="product-price">$1,200.50 to $1,300</h5></div></div><ul><li>one<li>two<ul><li>inner</ul><li>three</ul>
<div class='list-group-item'><h5 class=product-price> $7 </h5><h4 class=product-title>Second</h4><span><a class=product-link>B02</a></span></div><div class="list-group-items">no</div>"""

MARKET = """<div data-asin="M1" data-component-type="s-search-result"><h2 class="a-size-mini s"><a><span> Mug, blue </span></a></h2><div class="s-price-instructions-style"><i><span class="a-offscreen">$9.99</span></i></div></div>
<div data-component-type='s-search-result' data-asin='M2'><div><div><h2 class=a-size-mini>Bed</h2></div></div></div><div data-component-type="other" data-asin="M3"></div>"""

AUCTION = """<ul><li class="clearfix s-item__wrapper"><a class="s-item__link" href="https://site/itm/111?x=1"><h3 class="s-item__title">Shop on eBay</h3></a></li>
<li class="s-item__wrapper clearfix"><span class=s-item__price>$5.00 to $6.50</span><a href='https://site/itm/222?hash=3' class=s-item__link><h3 class=s-item__title>Lamp</h3></a></ul>"""

SHOP_ITEM = """<h2>Blue mug</h2><img src="/a.png"><h4>Price: $12.5</h4><h4>Rating: N.A.</h4><div class="radio-toolbar"><input name="color" type=radio><label>red</label><input name="color"><label>blue</label></div>
<div class="radio-toolbar"><label>L</label><input name="size"></div><p class="product-info"> Good. </p><ul><li> a </li><li>b</li></ul>"""

MARKET_ITEM = """<div id="twister_feature_div"><ul data-a-button-group='{"name":"twister_color_name"}'><li><img alt=" red " src=r.png><li><span> plain </span><li></ul></div>
<span id=productTitle> Mug, big </span><span class="x apexPriceToPay"><span class=a-offscreen>$1,034.00</span></span><div id="productDescription_feature_div"><div id=productDescription><p>One.</p><b>no</b><p>Two.</p></div></div>"""

AUCTION_ITEM = """<h1 class=x-item-title__mainTitle><span>Lamp</span></h1><div class=mainPrice>US $5.25 each</div><div id=mainImgHldr><img id=other src=o><img id=icImg src=i.jpg></div><span class=reviews-star-rating title="4.5 out of 5"></span>
<select class="msku-sel" name="Color:"><option>- Select -</option><option>Red<option>Blue</select><div class=x-about-this-item>About</div>"""


def test_tree():
    nodes = dom.parse(PAGE)
    assert all(n["at"] == i and n["at"] < n["end"] <= len(nodes) for i, n in enumerate(nodes))
    for n in nodes:
        if n["parent"] is not None:
            p = nodes[n["parent"]]
            assert p["at"] < n["at"] and n["end"] <= p["end"]
    li = [n for n in nodes if n["tag"] == "li"]
    depth = lambda n: 0 if n["parent"] is None else 1 + depth(nodes[n["parent"]])
    assert [depth(n) for n in li] == [1, 1, 3, 1]
    assert dom.parse(None) == [] and [n["tag"] for n in dom.parse("</p><br/>x<div")][:2] == ["br", "#text"]


def test_results(spark):
    rows = spark.createDataFrame([("shop", PAGE), ("market", MARKET), ("auction", AUCTION), ("shop", None), ("unknown", PAGE), ("market", "<p>")], "site string, html string")
    got = [(r.site, r.records and [tuple(x) for x in r.records]) for r in dom.read_results(rows).collect()]
    assert got == [
        ("shop", [("B01", "A & B bold", "$1,200.50 to $1,300", 1200.5, 1300.0), ("B02", "Second", "$7", 7.0, None)]),
        ("market", [("M1", "Mug, blue", "$9.99", 9.99, None), ("M2", "Bed", "N/A", None, None)]),
        ("auction", [("222", "Lamp", "$5.00 to $6.50", 5.0, 6.5)]),
        ("shop", []), ("unknown", None), ("market", []),
    ]


def test_items(spark):
    rows = spark.createDataFrame([("shop", SHOP_ITEM), ("market", MARKET_ITEM), ("auction", AUCTION_ITEM), ("market", "")], "site string, html string")
    got = [{k: [tuple(o) for o in v] if k == "options" else v for k, v in r.item.asDict().items()} for r in dom.read_items(rows).collect()]
    none = dict.fromkeys(dom.ITEM_FIELDS, "N/A")
    assert got[0] == {"title": "Blue mug", "price": "12.5", "rating": "N.A.", "image": "/a.png", "description": "Good.", "features": "a\nb", "low": 12.5, "options": [("color", ["red", "blue"]), ("size", ["L"])]}
    assert got[1] == none | {"title": "Mug big", "price": "$1,034.00", "description": "One. Two.", "low": 1034.0, "options": [("color", ["red", "plain"])]}
    assert got[2] == none | {"title": "Lamp", "price": "US $5.25 each", "rating": "4.5", "image": "i.jpg", "features": "About", "low": 5.25, "options": [("Color", ["Red", "Blue"])]}
    assert got[3] == none | {"low": None, "options": []}


def test_nesting_and_order_do_not_matter(spark):
    parts = ['<a class="product-link">Z</a>', '<h4 class="product-title">T</h4>', '<h5 class="product-price">$3</h5>']
    pages = [f'<div class="list-group-item">{"".join(p)}</div>' for p in (parts, parts[::-1])]
    pages += [f'<section><div class="a list-group-item b"><div><div>{parts[1]}</div></div><span>{parts[2]}{parts[0]}</span></div></section>']
    got = dom.read_results(spark.createDataFrame([("shop", p) for p in pages], "site string, html string")).select(F.explode("records").alias("r")).select("r.*").distinct().collect()
    assert [tuple(r) for r in got] == [("Z", "T", "$3", 3.0, None)]


def test_pages_are_parsed_in_portions(spark):
    assert dom.PAGES <= 1_000
    pages = [f"<ul>{'<li class=a>x</li>' * (i % 3)}</ul>" for i in range(2 * dom.PAGES + 3)]
    rows = spark.createDataFrame(list(enumerate(pages)), "i int, html string").repartition(1)
    got = rows.select("i", dom.nodes(F.col("html")).alias("n")).collect()
    assert {r.i: [(n["at"], n["end"], n["tag"]) for n in r.n] for r in got} == {i: [(n["at"], n["end"], n["tag"]) for n in dom.parse(p)] for i, p in enumerate(pages)}
