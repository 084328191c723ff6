import json
import random

from canopy.operators import nested

SCHEMA = "id long, value string, table_name string, position int"


def links(v, at="", around=""):
    """Brute force: (parent, child) of objects that are array elements, recursively."""
    out = []
    esc = lambda k: k.replace("~", "~0").replace("/", "~1")
    if isinstance(v, dict):
        for k, x in v.items():
            out += links(x, f"{at}/{esc(k)}", at)
    elif isinstance(v, list):
        for i, x in enumerate(v):
            if isinstance(x, dict):
                out.append((around, f"{at}/{i}"))
                for k, y in x.items():
                    out += links(y, f"{at}/{i}/{esc(k)}", f"{at}/{i}")
            elif isinstance(x, list):
                out += links(x, f"{at}/{i}", around)
    return out


def value(rng, depth=0):
    k = rng.random()
    if depth > 4 or k < 0.3:
        return rng.choice([1, 2.5, "x", None, True, '{"a":[{}]}'])
    if k < 0.65:
        return {rng.choice(["a", "b/c", "~", "0", "-OiABCDEFGHIJ", "ü"]): value(rng, depth + 1) for _ in range(rng.randrange(4))}
    return [value(rng, depth + 1) for _ in range(rng.randrange(4))]


def test_links_are_brute_force(spark):
    rng = random.Random(5)
    texts = [json.dumps(value(rng)) for _ in range(400)] + [None, "", "{", "NaN", '{"a":[{}', "[[[{}]]]", '{"a":[{"x":"' + "y" * 100_000 + '"}]}', '[{"a":1}]', '[{"a":1}]']
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], SCHEMA)
    got = sorted((r.row_id, r.parent_path, r.child_path) for r in nested.array_children(nested.flatten_objects(df, "t", "id", "value")).collect())
    want = []
    for i, t in enumerate(texts):
        try:
            v = json.loads(t, parse_constant=lambda x: 1 / 0)
        except (TypeError, ValueError, ZeroDivisionError):
            continue
        want += [(i, p, c) for p, c in links(v)]
    assert got == sorted(want)
    assert nested.flatten_objects(df.limit(0), "t", "id", "value").count() == 0


def test_variants_supertypes_and_typed_tables(spark, tmp_path):
    texts = [
        '{"lines":[{"sku":"a","qty":1},{"sku":"b","qty":2,"gift":{"note":"n"}}]}',
        '{"lines":[{"sku":"c","qty":3}]}',
        '{"members":{"u12":{"role":"host"},"u99":{"role":"guest"}}}',
    ]
    o = nested.flatten_objects(spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(texts)], SCHEMA), "t", "id", "value").cache()
    cat = {(r.position, tuple((f.key, f.kind) for f in r.fields)): (r.variant, r.objects) for r in nested.variants(o).collect()}
    line = (("qty", "bigint"), ("sku", "string"))
    assert cat[("$.lines[]", line)][1] == 2
    assert cat[("$.lines[]", (("gift", "object"), *line))][1] == 1
    assert cat[("$.members.*", (("role", "string"),))][1] == 2  # a map's keys are data
    sup = {r.position: [(k.key, k.kinds) for k in r.common_keys or []] for r in nested.supertypes(o).collect()}
    assert sup["$.lines[]"] == [("qty", "bigint"), ("sku", "string")]
    typed = nested.subtype_table(o, "t", "$.lines[]", cat[("$.lines[]", line)][0])
    assert sorted((r.row_id, r.parent_path, r.child_path, r.f_sku, r.f_qty) for r in typed.collect()) == [(0, "", "/lines/0", "a", 1), (1, "", "/lines/0", "c", 3)]
    nested.route(o, str(tmp_path / "routed"))
    back = spark.read.parquet(str(tmp_path / "routed"))
    assert back.count() == o.count() and back.filter("in_array").count() == 3


def test_keys_are_fields_or_data_by_who_holds_them(spark):
    texts = [json.dumps({"address1": "x", **({"address2": "y"} if i % 3 else {}), f"u{i}": 1}) for i in range(300)]
    texts += [json.dumps({"people": {name: {"n": 1}}}) for name in ("".join(chr(97 + (i // 26**j) % 26) for j in range(3)) for i in range(400))]
    o = nested.flatten_objects(spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(texts)], SCHEMA), "t", "id", "value").cache()
    shape = {(r.position, r.key): r.field for r in nested.key_shapes(o).collect()}
    assert shape[("$", "address1")] and shape[("$", "address2")] and shape[("$", "people")] and not shape[("$", "u7")] and not shape[("$.people", "baa")]
    got = {(r.position, tuple((f.key, f.kind) for f in r.fields)): r.objects for r in nested.subtypes(o).filter("position in ('$', '$.people')").collect()}
    assert got == {
        ("$", (("*", "bigint|string"), ("address1", "string"))): 100,
        ("$", (("*", "bigint|string"), ("address1", "string"), ("address2", "string"))): 200,
        ("$", (("people", "object"),)): 400,
        ("$.people", (("*", "any"),)): 400,
    }


def test_children_join_their_parents_in_the_routed_table(spark, tmp_path):
    rng = random.Random(6)
    texts = [json.dumps(value(rng)) for _ in range(200)] + ['{"a":' * 2000 + "[{}]" + "}" * 2000]
    df = spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(texts)], SCHEMA)
    routed = nested.route(nested.flatten_objects(df, "t", "id", "value"), str(tmp_path / "r"))
    j = nested.with_parents(routed)
    assert j.count() == routed.count() and j.filter("parent_path is null").count() > 0
    # every parent is there, but for the root where it is an array
    lost = j.filter("parent_path is not null and parent_position is null").select("row_id", "parent_path").collect()
    assert all(r.parent_path == "" and texts[r.row_id][0] == "[" for r in lost)
    assert routed.filter("position = '$'").select("variant").distinct().count() == nested.variants(routed).filter("position = '$'").count()
