"""json_records: each text is read in its row, and gives what a walk of its nodes gives."""

import json
import random
import re

from pyspark.sql import functions as F

import __spark_entry__
from advisorium.operators import json_objects, json_text

ID = re.compile(r"(?i)CVE-\d{4}-\d{4,}", re.A)


def ordered(body):
    def members(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("a name twice")
        return dict(sorted(pairs))

    try:
        return json.loads(body, object_pairs_hook=members)
    except ValueError:
        return None


def nodes(node, name=None, upper=None):
    """node and all within it, each before its own: (name, names of what it is in, node)."""
    yield name, upper, node
    for k, v in node.items() if isinstance(node, dict) else ((None, v) for v in node):
        if isinstance(v, (dict, list)):
            yield from nodes(v, k, name)


def texts(node):
    return [v for v in (node.values() if isinstance(node, dict) else node) if isinstance(v, str)]


def first(record, pick):
    return next((x for _, _, n in nodes(record) for x in pick(n) if x is not None), None)


def url_list(members):
    for x in members:
        u = (x.get("url") if isinstance(x.get("url"), str) and x.get("url") else x.get("URL")) if isinstance(x, dict) else x
        if isinstance(u, str) and u.startswith("http"):
            yield u
        if isinstance(x, (dict, list)):
            yield from urls(x)


def urls(node):
    """In the order of the text, members by name, those of lists called references only."""
    for k, v in node.items() if isinstance(node, dict) else ((None, v) for v in node):
        if isinstance(v, list) and isinstance(k, str) and k.lower() in ("references", "refs"):
            yield from url_list(v)
        elif isinstance(v, (dict, list)):
            yield from urls(v)


def walked(body):
    root = ordered(body)
    if not isinstance(root, (dict, list)):
        return []
    holds = lambda n: isinstance(n, dict) and any(ID.search(t) for _, _, x in nodes(n) for t in texts(x))
    lists = [n for _, _, n in nodes(root) if isinstance(n, list)]
    best = max(lists, key=lambda n: sum(map(holds, n)), default=[])
    found = [(i, x) for i, x in enumerate(best) if holds(x)] or [(0, root)] * holds(root)
    named = lambda keys: lambda n: [str(v) for k, v in n.items() if k.lower() in keys and isinstance(v, (str, int)) and not isinstance(v, bool) and v != ""] if isinstance(n, dict) else []
    out = []
    for at, r in found:
        english = first(r, lambda n: [n["value"]] if isinstance(n, dict) and n.get("lang") == "en" and isinstance(n.get("value"), str) and n["value"] else [])
        fields = {k: first(r, named(v)) for k, v in json_objects.ALIASES.items()}
        out.append((at, first(r, lambda n: [m[0].upper() for t in texts(n) if (m := ID.search(t))]), english or fields["description"], *[fields[k] for k in fields if k not in ("description", "product", "vendor")], list(dict.fromkeys(urls(r)))))
    return out


def some_json(draw, deep):
    names = ["id", "title", "Name", "severity", "score", "fix", "references", "Refs", "url", "URL", "lang", "value", "summary", "", ":", ":title", "{:title", 'q"k', "\\", "CVE-2020-7777", "a,b{", "é", "1000000001"]
    said = [":title", ":CVE-2020-1111", 'k":"CVE-2020-2222', "", "en", "en", "http://a", "http://b", "https://c", "ftp://x", "\x1cVE-2020-0001", 'say "http://q" \\ {[,:]} \n', "see cve-2021-12345", "é\U0001f600\\", ",", "]", "].0]"]
    k = draw.random()
    if deep <= 0 or k < 0.3:
        return draw.choice(["1", "-5", "true", "null", json.dumps("CVE-2020-%04d" % draw.randrange(9999)), *[json.dumps(draw.choice(said), ensure_ascii=draw.random() < 0.5)] * 5])
    gap, n = draw.choice(["", " ", "\n"]), draw.choice([0, 1, 2, 3, 5])
    if k < 0.65:
        return "[" + f",{gap}".join(some_json(draw, deep - 1) for _ in range(n)) + "]"
    return "{" + gap + ",".join(f"{json.dumps(x)}{gap}:{gap}{some_json(draw, deep - 1)}" for x in draw.sample(names, n)) + gap + "}"


def test_records_are_those_of_a_walk(spark):
    draw = random.Random(11)
    def refs():
        members = [draw.choice(['"http://a"', '"http://b"', '"http://c"', '"ftp://x"', "1", '{"url": "http://d"}', '{"url": "", "URL": "http://e"}', '{"url": 1, "Refs": ["http://f", {"URL": "http://g"}]}', some_json(draw, 2)]) for _ in range(4)]
        return "[" + ",".join(members) + "]"

    bodies = [f'{{"refs": {refs()}, "id": "CVE-2020-0001", "x": {some_json(draw, 5)}}}' if i % 3 else some_json(draw, 6) for i in range(1200)]
    found = json_objects.json_records(spark.createDataFrame(list(enumerate(bodies)), "doc int, body string"), 1000).select(
        "doc", "at", "cve_id", "description", "title", "severity", "score", "versions", "solution", "refs"
    )
    got = sorted(map(tuple, found.collect()), key=lambda r: r[:2])
    want = [(doc, *r) for doc, body in enumerate(bodies) for r in walked(body)]
    assert got == want and len(want) > 900 and sum(len(r[-1]) > 1 for r in want) > 30


def test_escapes_make_no_ids_and_urls_keep_their_order(spark):
    bodies = ['{"a": "\\u001cVE-2020-0001"}', '{"id": "CVE-2020-0002", "refs": ["ftp://x", "http://c", {"url": "http://b"}, "http://d"], "score": 1e3}', '{"a": "[{\\"id\\": \\"CVE-2020-0003\\"}]"}', '{"id": "CVE-2020-0004", "id": 1}', '{"CVE-2020-0005": 1}']
    found = json_objects.json_records(spark.createDataFrame(list(enumerate(bodies)), "doc int, body string")).select("doc", "cve_id", "refs", "score").collect()
    assert sorted(map(tuple, found)) == [(1, "CVE-2020-0002", ["http://c", "http://b", "http://d"], "1000.0"), (2, "CVE-2020-0003", [], None)]


def test_depth_is_told_and_long_texts_are_read(spark):
    nested = lambda n: '{"a":' * (n - 1) + '{"id":"CVE-2020-0001"}' + "}" * (n - 1)
    long = '{"l": [' + ",".join(f'{{"id": "CVE-2020-{i:06d}", "refs": [{{"url": "http://{i}"}}], "t": "{"x" * 20}"}}' for i in range(20000)) + "]}"
    rows = spark.createDataFrame([(1, nested(64)), (2, nested(65)), (3, long), (4, '{"id": "CVE-2020-0002", "t": "' + "[{" * 90 + '"}'), (5, '{"id": "CVE-2020-0003", "t": "' + "\\n" * 200000 + '"}')], "doc int, body string")
    assert {r.doc: r.n for r in json_objects.json_records(rows).groupBy("doc").agg(F.count("*").alias("n")).collect()} == {1: 1, 3: 20000, 4: 1, 5: 1}


def test_a_text_is_read_in_its_row(spark):
    rows = spark.createDataFrame([(1, '{"id": "CVE-2020-0001"}')], "doc int, body string")
    plan = json_objects.json_records(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("Window|Aggregate|Repartition|Join", plan)


def test_tasks_follow_the_table(spark, tmp_path):
    spark.range(450_000).selectExpr("id event_id", "id % 7 user_id").write.parquet(f"{tmp_path}/events.parquet")
    plan = __spark_entry__.queries()["json_records"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"RepartitionByExpression \[event_id#\d+L?\], 5\b", plan)


def test_own_values_come_first(spark):
    body = '{"z": {"k": [1]}, "a": [{"n": 2.50}, "t", [], [3]], "b": true}'
    row = spark.createDataFrame([(body,)], "body string").select(json_text.own_first(json_text.canonical(F.col("body"))).alias("t")).first()
    assert row.t == '{":b":true,"{:a":{"1000000001":"t","[1000000002":[],"{1000000000":{":n":2.5},"{1000000003":{"1000000004":3}},"{:z":{"{:k":{"1000000007":1}}}'
