"""Products of mixed forms against what the same file says in Python."""

import json

from pyspark.sql import functions as F

from tessera.sources import products

ITEMS = [
    {"asin": "a", "name": "N", "small_description": "one", "customization_options": {"Size": [{"value": " 5/6\t", "image": "i"}], "COLOR": [{"value": "Red"}, {"value": "BLUE", "image": None}]}},
    {"asin": "b", "small_description": ["x", 5, None, True], "customization_options": {"size": "odd", "Color": [{"value": "Red"}], "empty": None, "none": []}},
    {"asin": "c", "small_description": None, "customization_options": {}, "images": ["u", "v"]},
    {"asin": "d", "customization_options": None, "pricing": 12.5},
    {"asin": "e", "small_description": 7, "customization_options": {"z": [{"value": "1"}], "a": [{"value": "2"}, {"image": "no value"}, "no item", {"value": 3}], "Z": [{"value": "9", "image": "last"}]}},
    {"asin": "f", "small_description": [], "customization_options": ["no", "object"], "images": "no list"},
    {"asin": 6, "small_description": {"k": [1]}, "customization_options": "text", "full_description": "ü \" } ] ,"},
]


def plain(p):
    bullets = p["small_description"] if isinstance(p.get("small_description"), list) else [p.get("small_description")]
    options, images = {}, {}
    given = p.get("customization_options")
    for name, contents in (given if isinstance(given, dict) else {}).items():
        if isinstance(contents, list):
            values = []
            for o in contents:
                if isinstance(o, dict) and o.get("value") is not None:
                    value = str(o["value"]).strip().replace("/", " | ").lower()
                    values.append(value)
                    images[value] = o.get("image")
            options[name.lower()] = values
    text = lambda x: None if x is None else x if isinstance(x, str) else json.dumps(x, separators=(",", ":"))
    return {"asin": text(p["asin"]), "bullet_points": [text(b) for b in bullets], "options": list(options.items()), "option_to_image": images, "images": p["images"] if isinstance(p.get("images"), list) else [], "pricing": text(p.get("pricing")), "full_description": p.get("full_description")}


def test_mixed_forms(spark, tmp_path):
    for name, options in (("a", {}), ("b", {"indent": 2})):
        (tmp_path / f"{name}.json").write_text(json.dumps(ITEMS, **options))
    got = {"a": [], "b": []}
    for r in products.read_products(spark, str(tmp_path)).withColumn("names", F.map_keys("options")).orderBy("block", "at").collect():
        row = r.asDict()
        row["options"] = [(n, row["options"][n]) for n in row["names"]]
        got[row["source_file"][-6]].append({k: row[k] for k in plain(ITEMS[0])})
    assert got["a"] == got["b"] == [plain(p) for p in ITEMS]


def test_what_is_no_product(spark, tmp_path):
    (tmp_path / "x.json").write_text('[null, 5, {"asin": "q"}, "text", [1]]')
    got = products.read_products(spark, str(tmp_path)).collect()
    assert sorted(str(r.asin) for r in got) == ["None", "None", "None", "None", "q"] and all(r.options == {} for r in got)
