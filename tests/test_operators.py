"""Operators against plain recursive or looping versions, on small written cases."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import catalogue, conversations, episodes, fuzzy, goals, model_math, pages, search, sessions, trees


def random_tree(rng, n):
    rows = [(1, 1, None, 0, 0, "root", 0.5)]
    depth = {1: 0}
    for i in range(2, n + 1):
        p = rng.randint(max(1, i - 6), i - 1)
        depth[i] = depth[p] + 1
        rows.append((1, i, p, i, depth[i], f"a{rng.randint(0, 2)}", None if rng.random() < 0.2 else rng.uniform(-1, 1)))
    return rows


EDGES = "tree_id bigint, node_id bigint, parent_id bigint, child_idx int, depth int, action string, reward double"


def children(rows):
    out = {}
    for r in rows:
        out.setdefault(r[2], []).append(r)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_backups(spark, seed):
    rows = random_tree(random.Random(seed), 40)
    kids = children(rows)
    edges = spark.createDataFrame(rows, EDGES)

    def q(r):
        below = kids.get(r[1], [])
        return 0.9 * max(q(c) for c in below) if below else (r[6] or 0.0)

    def leaves(r):
        below = kids.get(r[1], [])
        return [x for c in below for x in leaves(c)] if below else [r[6] or 0.0]

    def mean(r):
        found = leaves(r)
        return sum(found) / len(found)

    def pseudo(r, h):
        below = kids.get(r[1], [])
        if not below:
            return mean(r) * sum(0.9**i for i in range(h)) if h > 1 else mean(r)
        return mean(r) + 0.9 * max(pseudo(c, h - 1) for c in below)

    got = {r.node_id: r.q_value for r in trees.q_backup(edges).collect()}
    means = {r.node_id: r.mean_reward for r in trees.mean_leaf_reward(edges).collect()}
    deep = {r.node_id: r.q_value for r in trees.pseudo_depth_backup(edges).collect()}
    for r in rows:
        assert got[r[1]] == pytest.approx(q(r))
        assert means[r[1]] == pytest.approx(mean(r))
        assert deep[r[1]] == pytest.approx(pseudo(r, 5 - r[4]))


def test_ancestors_of_a_chain(spark):
    rows = [(1, i, i - 1 if i > 1 else None, 0, i - 1, "a", 1.0) for i in range(1, 71)]
    got = {r.node_id: r.path for r in trees.ancestors(spark.createDataFrame(rows, EDGES), max_depth=70).collect()}
    assert got == {i: list(range(i - 1, 0, -1)) for i in range(1, 71)}


def test_empty_tree_table(spark):
    empty = spark.createDataFrame([], EDGES)
    assert trees.q_backup(empty).count() == 0
    assert trees.top_paths(empty, trees.q_backup(empty)).count() == 0


def test_min_max_of_equal_values(spark):
    rows = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 1.0), (2, 3.0)], "tree_id int, label double")
    assert sorted(map(tuple, trees.min_max(rows).collect())) == [(1, 0.0), (1, 0.0), (2, 0.0), (2, 1.0)]


def loop_pairs(sizes, budget):
    head, rest = sizes[:3], sizes[3:]
    while sum(head) + sum(rest) > budget and len(rest) > 4:
        rest = rest[2:]
    return head + rest


def loop_singles(sizes, budget):
    head, rest = sizes[:3], sizes[3:]
    while rest and sum(head) + sum(rest) > budget:
        rest = rest[1:]
    return head + rest


def test_trimming(spark):
    rng = random.Random(4)
    cases = {c: [rng.randint(1, 9) for _ in range(rng.randint(1, 14))] for c in range(60)}
    rows = [(c, i, "user", "x " * s) for c, sizes in cases.items() for i, s in enumerate(sizes)]
    turns = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    size = (F.length("text") / 2).cast("int")
    for budget in (10, 30):
        for function, loop in ((conversations.trim_pairs, loop_pairs), (conversations.trim_singles, loop_singles)):
            kept = {}
            for r in function(turns, size, budget).orderBy("conv_id", "turn").collect():
                kept.setdefault(r.conv_id, []).append(r.size)
            assert kept == {c: loop(s, budget) for c, s in cases.items()}


def test_render_leaves_out_null_system_and_opens_last_turn(spark):
    rows = spark.createDataFrame([(1, [("system", None), ("user", "hi"), ("assistant", None)])], "conv_id int, messages array<struct<role:string,content:string>>")
    got = rows.select(conversations.render(F.col("messages"), "llama2").alias("a"), conversations.render(F.col("messages"), "llama3").alias("b")).first()
    assert got.a == "[INST] hi [/INST]"
    assert got.b == "<|start_header_id|>user<|end_header_id|>\n\nhi<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n"
    with pytest.raises(ValueError):
        conversations.render(F.col("messages"), "other")


def test_length_profile(spark):
    rng = random.Random(1)
    for n in (1, 2, 19, 40, 101):
        values = [rng.randint(1, 30) for _ in range(n)]
        got = conversations.length_profile(spark.createDataFrame([(x,) for x in values], "size int"), "size", 20).first()
        values.sort()
        middle = (values[(n - 1) // 2] + values[n // 2]) / 2
        assert (got["count"], got["median"], got["p95"], got["max"], got["over"]) == (n, middle, values[int(0.95 * n)], values[-1], sum(x > 20 for x in values))


def test_best_first_wins_ties(spark):
    rows = [(1, 0, 0.5, 0.0, False), (1, 1, 0.0, 0.5, True), (2, 0, None, 0.1, False), (2, 1, 0.0, 0.0, False)]
    got = episodes.choose_best(spark.createDataFrame(rows, "state int, cand_idx int, q_value double, env_reward double, finished boolean"), ["state"])
    assert {r.state: r.cand_idx for r in got.collect()} == {1: 0, 2: 1}


def test_prices(spark):
    cases = {None: [100.0], "": [100.0], "$5": [5.0], "$1,200.50 to $2": [1200.5, 2.0], "$1 $2 $3": [1.0, 2.0]}
    rows = spark.createDataFrame([(k,) for k in cases], "p string").select("p", catalogue.prices(F.col("p")).alias("x"))
    assert {r.p: r.x.pricing for r in rows.collect()} == cases


def test_option_combinations(spark):
    rows = spark.createDataFrame([({"size": ["s", "m"], "color": ["red", "blue"]},), ({},)], "o map<string,array<string>>")
    got = [r.c for r in rows.select(catalogue.option_combinations(F.col("o")).alias("c")).collect()]
    assert got[0] == [[f"color: {c}", f"size: {s}"] for c, s in itertools.product(["red", "blue"], ["s", "m"])]
    assert got[1] == [[]]


def test_token_set_score():
    assert fuzzy.word_set_score(["blue", "mug"], ["blue", "mug"]) == 100
    assert fuzzy.word_set_score(["blue", "large", "mug"], ["blue", "mug"]) == 100
    assert fuzzy.word_set_score(["red"], ["dishwasher"]) < 50
    assert fuzzy.word_set_score([], ["x"]) == 0


def test_fuzzy_hits(spark):
    rows = spark.createDataFrame([(1, ["Blue Mug", "steel"], ["mug blue"], "a steel thing"), (2, ["wood"], ["plastic"], None), (3, ["x"], [], "y")], "k int, goal array<string>, bought array<string>, title string")
    got = goals.attribute_reward(rows, ["k"], "goal", "bought", ["title"]).collect()
    assert {r.k: (r.n_hits, r.n_goal) for r in got} == {1: (2, 2), 2: (0, 1), 3: (0, 1)}


def test_type_reward_order(spark):
    case = lambda bq, gq, nouns_b, nouns_g: (bq, gq, "a › b", "a › c", nouns_b, nouns_g)
    rows = [case("q", "q", ["mug"], ["mug"]), case("q", "q", ["cup"], ["mug"]), case("p", "q", ["m1"], [f"m{i}" for i in range(1, 12)]), case("p", "q", ["m1"], [f"m{i}" for i in range(1, 8)]), case("p", "q", [], [])]
    df = spark.createDataFrame(rows, "bq string, gq string, bp string, gp string, bn array<string>, gn array<string>")
    got = df.select(goals.type_reward(*(F.col(c) for c in ("bq", "gq", "bp", "gp", "bn", "gn"))).alias("t"))
    assert [r.t.r_type for r in got.collect()] == [1.0, 0.0, 0.1, 0.5, 0.5]


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><input id="search_input"><button class="btn btn-x">Buy Now</button>
<a class="product-link" href="/b1">B001</a><label>red</label><input type="radio" value="red"><p>plain <b>bold</b></p><script>no()</script><!-- no --></body></html>"""


def test_pages(spark):
    rows = spark.createDataFrame([(1, PAGE, 'http://x/{"color":"red"}', ["B001"]), (2, None, None, [])], "id int, html string, url string, seen array<string>")
    got = rows.select("id", pages.rich_text(F.col("html"), F.col("url"), F.col("seen")).alias("t"), pages.clickables(F.col("html")).alias("c"), pages.visible_text(F.col("html")).alias("v")).orderBy("id").collect()
    assert got[0].c.has_search_bar and got[0].c.clickables == ["buy now", "b001", "red"]
    assert got[0].t.startswith("You have clicked red.\n") and "[clicked button] B001 [clicked button_]" in got[0].t and "[button] Buy Now [button_]" in got[0].t
    assert "no()" not in got[0].t and got[0].v == "Buy Now [SEP] B001 [SEP] red [SEP] plain [SEP] bold"
    assert got[1].t == "" and got[1].v is None


def test_parse_call(spark):
    rows = spark.createDataFrame([("R1, R2 = Search(a (b) c) tail (x)",), ("R3 = Go()",)], "line string")
    got = [tuple(r.c) for r in rows.select(sessions.parse_call(F.col("line")).alias("c")).collect()]
    assert got == [(["R1", "R2"], "Search", "a (b) c"), (["R3"], "Go", "")]


def test_ngrams_of_short_texts(spark):
    rows = spark.createDataFrame([([],), (["a"],), (["a", "b", "c"],)], "w array<string>")
    assert [r.g for r in rows.select(search.ngrams(F.col("w"), 2).alias("g")).collect()] == [[], [], ["a b", "b c"]]
    assert [r.g for r in rows.select(search.ngrams(F.col("w"), 3).alias("g")).collect()] == [[], [], ["a b c"]]


def test_mlp_head(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    layers = [(rng.normal(size=(4, 3)), rng.normal(size=3)), (rng.normal(size=(3, 1)), rng.normal(size=1))]
    x = rng.normal(size=(5, 4))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i int, v array<double>")
    got = {r.i: r.s for r in rows.select("i", model_math.mlp_head(F.col("v"), layers, sigmoid=True).alias("s")).collect()}
    want = 1 / (1 + np.exp(-((np.maximum(x @ layers[0][0] + layers[0][1], 0) @ layers[1][0] + layers[1][1])[:, 0])))
    assert [got[i] for i in range(5)] == pytest.approx(want.tolist())


def test_last_token_index(spark):
    rows = spark.createDataFrame([([5, 6, 0],), ([5, 6, 7],), ([0, 0, 0],)], "ids array<int>")
    assert [r.a for r in rows.select(model_math.last_token_index(F.col("ids"), 0).alias("a")).collect()] == [1, 2, 2]
    assert [r.a for r in rows.select(model_math.last_index_clamped(F.col("ids"), 0, 3).alias("a")).collect()] == [1, 2, 0]


def test_list_literals(spark):
    from ast import literal_eval

    texts = ["""["it's", "b"]""", r"""['it\'s', 'b']""", "['a, b', \"c]\"]", "[]", "[ 'x' , ]", r"""['a\\n', "t\tb", 'say "hi"']""", "['']"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "plain words", "['open", "['a' 'b'"])], "i int, t string")
    got = {r.i: r.k for r in rows.select("i", sessions.parse_keywords(F.col("t")).alias("k")).collect()}
    assert [got[i] for i in range(len(texts))] == [literal_eval(t) for t in texts]
    assert [got[len(texts) + i] for i in range(3)] == [["plain words"], None, None]


def test_trees_of_any_depth(spark):
    deep = [(1, k, k - 1 if k > 1 else None, k - 1, 1.0 if k == 101 else 0.0) for k in range(1, 102)] + [(2, 1, None, 0, 5.0)]
    edges = spark.createDataFrame(deep, "tree_id int, node_id bigint, parent_id bigint, depth int, reward double")
    got = {(r.tree_id, r.node_id): r.q_value for r in trees.q_backup(edges).collect()}
    assert len(got) == 102 and got[2, 1] == 5.0
    assert all(abs(got[1, k] - 0.9 ** (101 - k)) < 1e-12 for k in range(1, 102))


def test_price_limit_against_a_list_of_tens(spark):
    prices = [None, -5.0, 0.0, 9.99, 10.0, 15.0, 955.0, 960.0, 969.5, 970.0, 979.0, 980.0, 990.0, 5000.0, float("nan"), float("inf")]
    rows = [(p, a / 10, b / 10) for p in prices for a in range(0, 10, 3) for b in range(0, 10, 3)]
    df = spark.createDataFrame(rows, "p double, a double, b double")
    for r in df.select("*", catalogue.price_limit(F.col("p"), F.col("a"), F.col("b")).alias("l")).collect():
        above = [x * 10.0 for x in range(1, 100) if r.p is not None and x * 10.0 > r.p][:4]
        if len(above) < 2:
            assert (r.l.upper, r.l.text) == (1_000_000.0, "")
        else:
            first, second = int(r.a * len(above)), int(r.b * (len(above) - 1))
            upper = max(above[first], above[second + (second >= first)])
            assert r.l.upper == upper and r.l.text == f", and price lower than {upper:.2f} dollars"


def test_tfidf_moves_texts_and_no_postings(spark):
    from tessera.operators import search

    docs = spark.createDataFrame([("x", 1, "b a b"), ("x", 2, "a c"), ("y", 1, "c")], "lang string, doc int, text string").repartition("lang", "doc")
    scores = search.tfidf(docs, "lang", "doc", F.split("text", " "), max_features=2)
    assert scores._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    idf = {"a": math.log(3 / 3) + 1, "b": math.log(3 / 2) + 1}
    norm = math.hypot(idf["a"], 2 * idf["b"])
    want = {("x", 1, "a"): idf["a"] / norm, ("x", 1, "b"): 2 * idf["b"] / norm, ("x", 2, "a"): 1.0, ("y", 1, "c"): 1.0}
    assert {(r.lang, r.doc, r.term): pytest.approx(r.score) for r in scores.collect()} == want


def test_semantic_top_k_in_tiles(spark, monkeypatch):
    from tessera.operators import search

    monkeypatch.setattr(search, "VECTORS", 7)
    rng = random.Random(3)
    rows = [(i, i % 3, [rng.choice([-1.0, 0.5, 2.0]) for _ in range(4)]) for i in range(60)] + [(60, 9, [1.0] * 4), (61, 8, [1.0] * 4), (62, 8, None)]
    table = spark.createDataFrame(rows, "id int, label int, v array<float>")
    asked = table.where("id % 5 = 0 or id > 59").select(F.col("id").alias("query_id"), "label", F.col("v").alias("q"))
    got = search.semantic_top_k(asked, table.select(F.col("id").alias("item_id"), "label", F.col("v").alias("e")), "label", 3)
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))
    want = {(61, 1): (62, None), (62, 1): (61, None)}  # the only vector of a label has no other, a null vector no score
    for i, label, v in rows[:60]:
        best = sorted((-round(cosine(v, w), 9), j) for j, other, w in rows if other == label and j != i)[:3]
        want |= {(i, n + 1): (j, pytest.approx(-s)) for n, (s, j) in enumerate(best) if i % 5 == 0}
    assert {(r.query_id, r["rank"]): (r.item_id, r.score) for r in got.collect()} == want


def test_bm25_moves_a_posting_once_however_many_ask(spark, monkeypatch):
    from tessera.operators import score_groups, search

    monkeypatch.setattr(score_groups, "GROUP_DOCS", 5)
    monkeypatch.setattr(score_groups, "TILE", 3)
    monkeypatch.setattr(score_groups, "STRIP", 2)
    rng = random.Random(4)
    docs = {d: [rng.choice("abcdefgh") for _ in range(rng.randint(0, 9))] for d in range(40)}
    asked = [(q, t) for q in range(10) for t in rng.sample("abcdxyz", 3)]
    table = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc int, text string")
    words = F.filter(F.split("text", " "), lambda w: w != "")
    queries = spark.createDataFrame(asked, "query_id int, term string")
    found = search.bm25(search.term_table(table, "doc", words, queries), search.corpus_statistics(table, F.size(words)), queries, "doc", k=4)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().executedPlan().toString()
    mean = sum(map(len, docs.values())) / len(docs)
    df = {t: sum(t in w for w in docs.values()) for t in "abcdefghxyz"}
    want = {}
    for q in range(10):
        scores = {d: sum(math.log(1 + (40 - df[t] + 0.5) / (df[t] + 0.5)) * w.count(t) / (w.count(t) + 0.9 * (0.6 + 0.4 * len(w) / mean)) for p, t in asked if p == q and t in w) for d, w in docs.items()}
        best = sorted((-round(s, 9), d) for d, s in scores.items() if s > 0)[:4]
        want |= {(q, n + 1): (d, pytest.approx(-s)) for n, (s, d) in enumerate(best)}
    assert {(r.query_id, r["rank"]): (r.doc, r.score) for r in found.collect()} == want
