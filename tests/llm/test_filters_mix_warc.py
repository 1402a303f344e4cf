import random
import re
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from palisade.llm import decontam, mixing, url_filter, warc
from palisade.llm import queries as Q
from tests.compare import duck, same
from tests.llm import helpers


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    same(Q.QUERIES[name](spark, sf), duck(sf).execute(Q.ORACLE_SQL[name]).df())


ITEM = "A train leaves the station at 60 km an hour and a second train follows Maria after 3 hours, when do both meet on the way?"


def test_templates(spark, make_docs):
    bench = spark.createDataFrame([(1, ITEM), (2, "too short"), (3, None), (None, ITEM)], "item_id long, text string")
    other = ITEM.replace("60", "85.5").replace("Maria", "Peter").replace("3 hours", "7 days")
    mixed = "They went to 5 towns. " + ITEM.lower() + " Nobody knows."
    docs = make_docs([(1, ITEM), (2, "Intro here. " + other), (3, mixed), (4, "A train leaves the station quickly."), (5, None), (6, ""), (7, ITEM + " " + ITEM), (8, "filler words " * 50000 + ITEM), (None, ITEM)])
    got = {r["doc_id"]: r for r in decontam.contaminated(docs, bench).collect()}
    assert set(got) >= {1, 2, 7, 8} and not set(got) & {4, 5, 6, None}
    assert got[1]["exact"] and not got[2]["exact"] and got[2]["n_slots"] >= 4
    assert {r["doc_id"] for r in decontam.clean(docs, bench).collect()} >= {4, 5, 6, None}
    assert decontam.contaminated(make_docs([]), bench).count() == 0 and decontam.contaminated(docs, bench.limit(0)).count() == 0


def test_copies_in_other_case_and_lines(spark, make_docs):
    item = "Natalia sold clips to 48 of her friends in April, and then Natalia sold half as many clips in May. How many clips did Natalia sell altogether in April and May?"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    wrapped = [item.replace("in ", "in\n"), item.replace("in ", "in  "), item.replace("in ", "in (").replace("then ", 'then "')]
    docs = make_docs([(i, t) for i, t in enumerate([item, item.lower(), item.upper(), *wrapped])] + [(9, "Nobody sold clips in April, and then Maria came in May to see how many friends were there.")])
    got = {r["doc_id"]: r["exact"] for r in decontam.contaminated(docs, bench).collect()}
    assert got == dict.fromkeys(range(6), True)
    # other names on wrapped lines are still names
    assert {r["doc_id"] for r in decontam.contaminated(make_docs([(1, wrapped[0].replace("April", "June").replace("May", "July"))]), bench).collect()} == {1}


TWELVE = "Tom has twelve apples and gives three apples to Anna every day for two weeks, how many apples are left?"


def test_numbers_in_words_and_runs_of_names(spark, make_docs):
    """Questions asked again with other numbers, in words and digits, other names of more or fewer words, and glued units."""
    names = "Last spring Mary Ann planted 8 trees before early June and then Mary Ann sold 5kg of fruit to her cousin"
    bench = spark.createDataFrame([(1, TWELVE), (2, names)], "item_id long, text string")
    other = lambda *n: TWELVE.replace("twelve", n[0]).replace("three", n[1]).replace("two", n[2])
    docs = make_docs([(1, other("twenty", "seven", "five")), (2, other("20", "7", "5")), (3, other("Twenty-one", "forty two", "9")), (4, other("12", "3", "2")), (5, other("many", "some", "few")),
                      (11, names.replace("Mary Ann", "Olga")), (12, names.replace("Mary Ann", "Jean Luc Picard").replace("5kg", "12 pounds")), (13, names.lower()), (14, names.replace("Mary Ann", "Olga", 1)), (15, names.replace("planted", "saw").replace("then", "yet").replace("fruit", "nuts"))])
    got = {(r["doc_id"], r["item_id"]): r["exact"] for r in decontam.contaminated(docs, bench).collect()}
    assert got.keys() >= {(1, 1), (2, 1), (3, 1), (4, 1), (11, 2), (12, 2), (13, 2)} and not got.keys() & {(5, 1), (15, 2)}
    assert got[4, 1] and got[13, 2] and not got[1, 1] and not got[2, 1] and not got[12, 2]


def test_slots_must_agree(spark, make_docs):
    item = "Buy 7 apples and sell 7 apples then count 7 apples again before the shop closes for good"
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = make_docs([(1, item.replace("7", "9")), (2, "Buy 1 apples and sell 2 apples then count 3 apples again before the shop closes for good")])
    assert {r["doc_id"] for r in decontam.contaminated(docs, bench).collect()} == {1}


def test_real_leaks_equal_brute_force(spark, sf):
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    items = {r["item_id"]: words(r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    at, n = defaultdict(set), defaultdict(int)
    for k, w in items.items():
        for i in range(len(w) - 7):
            at[tuple(w[i:i + 8])].add(k)
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        w = words(r["text"])
        for i in range(len(w) - 7):
            for k in at.get(tuple(w[i:i + 8]), ()):
                n[r["doc_id"], k] += 1
    want = {p for p, c in n.items() if c >= min(6, len(items[p[1]]) - 7)}
    assert {(r["doc_id"], r["item_id"]) for r in Q.op4_decontam(spark, sf).collect()} == want


def test_templates_equal_brute_force(spark, sf, make_docs):
    """All documents of the table and copies of items with other numbers, names, letter case and lines; short items; numbers in a row."""
    rng = random.Random(8)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    ask = [(10_000 + i, t) for i, t in enumerate([ITEM, "Tom has 12 apples and Anna has 7 pears, so how many kg do Tom and Anna carry home in 3 days", " ".join(str(i) for i in range(14)), "what is the answer here", "one two three", "A 5 km, 6 km, 7 km, 8 km, 9 km run takes Max 3 hours", "", "In May Mary Ann Lee baked twenty-five pies, and Tom Sawyer ate Thirty two of them within 40min, so who owes whom?", TWELVE])]
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for _, t in rng.sample(items, 20) + ask:
        fresh = re.sub("[0-9]+", lambda m: str(rng.randint(1, 99)), t)
        texts += [f"Before it. {fresh} After it.", t.upper(), t.replace(" ", "\n"), t[: len(t) // 2], fresh.replace("Tom", "Ben").replace("Anna", "Eva").replace("Maria", "Olaf"), fresh.replace("Mary Ann Lee", "Jo").replace("Sawyer", "van der Berg"), t.replace("twelve", "one hundred and 5").replace("three", "17").replace("two", "Twenty Six"), fresh.replace(" km", "KM").replace(" hours", "hours"), "5 " + t + " " + t]
    texts += [" ".join(str(rng.randint(0, 50)) for _ in range(3000)), "So what is THE answer, here?", None]
    rows = list(enumerate(texts))
    bench = spark.createDataFrame([*items, *ask, *ask[:1], (None, ITEM), (77, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["n_windows"], r["n_slots"], r["exact"]) for r in decontam.contaminated(make_docs([*rows, rows[-2]]), bench).collect()}
    want = helpers.template_matches(rows, [*items, *ask], decontam.UNITS, decontam.NUMBERS)
    assert got == want
    assert {k for _, k in want} >= {10_000, 10_001, 10_002, 10_003, 10_005, 10_007, 10_008} and not {k for _, k in want} & {10_004, 10_006}


T0 = 1000


def test_url_lists_in_time(spark):
    cap = spark.createDataFrame([(1, "http://a.b.example/x/y", 5), (2, "http://a.b.example/x/y", 15), (3, "http://A.B.example:80", 15), (4, None, 5), (5, "nonsense", 5), (6, "http://u@c.example/?q", 25), (7, "http://c.example/", None), (8, "http://a.b.example/x/y", 20)], "page_id long, url string, fetched_at long").withColumn("key", F.lit("own"))
    ent = spark.createDataFrame([("l", "b.example", "block", "add", 0), ("l", "b.example", "block", "remove", 20), ("l", "a.b.example/x", "allow", "add", 10), ("l", "c.example", "block", "add", 0), ("m", "c.example", "block", "add", 0), ("l", None, "block", "add", 0), ("l", "c.example", "block", "add", 0)], "list string, key string, verdict string, action string, at long")
    got = {r["page_id"]: (r["decision"], r["matched_key"], r["n_active"]) for r in url_filter.as_of(cap, ent).collect()}
    assert got == {1: ("block", "b.example", 1), 2: ("allow", "a.b.example/x", 2), 3: ("block", "b.example", 1), 4: ("none", None, 0), 5: ("none", None, 0), 6: ("block", "c.example", 2), 7: ("none", None, 0), 8: ("allow", "a.b.example/x", 1)}
    assert url_filter.as_of(cap.limit(0), ent).count() == 0
    assert {r["decision"] for r in url_filter.as_of(cap, ent.limit(0)).collect()} == {"none"}


def test_url_lists_in_any_case(spark, tmp_path):
    cap = spark.createDataFrame([(1, "http://A.example/Wiki/x", 5), (2, "http://a.example/wiki", 5), (3, "http://a.example/WIKI", 15), (4, "http://a.example/Casino", 5)], "page_id long, url string, fetched_at long")
    ent = spark.createDataFrame([("l", "A.Example/Wiki", "block", "add", 0), ("l", "a.example/Wiki", "block", "remove", 10), ("m", "a.example/casino", "allow", "add", 0)], "list string, key string, verdict string, action string, at long")
    got = {r["page_id"]: (r["decision"], r["matched_key"], r["n_active"]) for r in url_filter.as_of(cap, ent).collect()}
    assert got == {1: ("block", "a.example/wiki", 1), 2: ("block", "a.example/wiki", 1), 3: ("none", None, 0), 4: ("allow", "a.example/casino", 1)}
    # the registered query against its SQL, on pages whose sections have capitals, some beside the same word without
    urls = [f"https://h{i % 40}.example/{('Wiki', 'wiki', 'WIKI', 'Casino%d' % (i % 7), 'news')[i % 5]}/{i}" for i in range(600)]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"file://{tmp_path}/pages.parquet")
    pages = duckdb.connect()
    pages.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    same(Q.op5_url_filter(spark, f"file://{tmp_path}"), pages.execute(Q.ORACLE_SQL["op5_url_filter"]).df())


def test_url_lists_odd_rows(spark):
    """Repeated captures come back as one, a very long url is matched by its keys, ties of verdicts go to allow."""
    long = "http://deep." * 1 + "a." * 60 + "example/s/" + "x" * 200_000
    cap = spark.createDataFrame([(1, "http://h.example/s", 5), (1, "http://h.example/s", 5), (2, long, 5), (3, "", 5)], "page_id long, url string, fetched_at long").selectExpr("*", "'own' as list", "'own' as verdict")
    ent = spark.createDataFrame([("l", "h.example", "block", "add", 0), ("m", "h.example", "allow", "add", 0), ("m", "h.example", "allow", "add", 0), ("l", "a.example", "block", "add", 5)], "list string, key string, verdict string, action string, at long").selectExpr("*", "'own' as url")
    got = sorted((r["page_id"], r["decision"], r["matched_key"], r["n_active"]) for r in url_filter.as_of(cap, ent).collect())
    assert got == [(1, "allow", "h.example", 2), (2, "block", "a.example", 1), (3, "none", None, 0)]
    assert url_filter.as_of(cap.limit(0), ent.limit(0)).count() == 0


def test_targets(spark):
    s = spark.createDataFrame([("a", 100), ("b", 1), ("c", 100), (None, 50)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(s).collect()}
    # 251 words by 1, 2, 3, 1: b stops at 3, the rest is shared by 1, 3, 1
    assert got["b"] == 3.0 and [round(got[k], 6) for k in ("a", "c", None)] == [49.6, 148.8, 49.6]
    assert mixing.targets(s.limit(0)).count() == 0


def test_mix(make_docs):
    docs = make_docs([(i, "w " * (i % 30 + 1), None, ("a", "b", None)[i % 3]) for i in range(600)] + [(900, None, None, "a"), (901, "", None, "b"), (902, " \n", None, "z")])
    out = mixing.pareto_mix(docs).orderBy("doc_id").collect()
    assert len(out) == 603 and out == mixing.pareto_mix(docs.repartition(7)).orderBy("doc_id").collect()
    for source in ("a", "b", None):
        own = [r for r in out if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 2
    assert all(r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0) for r in out)
    assert mixing.pareto_mix(make_docs([])).count() == 0


def test_mix_has_unequal_odds(make_docs):
    """Long documents are taken less often than short ones of the same source, also beside certain copies."""
    sizes = [2, 60, 900]
    docs = make_docs([(i, "w " * sizes[i % 3], None, "ab"[i % 7 == 0]) for i in range(3000)])
    out = mixing.pareto_mix(docs).collect()
    for source in "ab":
        own = [r for r in out if r["source"] == source]
        mean = [sum(r["taken"] for r in own if r["size"] == n) / (n * sum(r["size"] == n for r in own)) for n in sizes]
        assert mean == sorted(mean, reverse=True) and (source == "b" and mean[2] == 3 or mean[0] > 1.5 * mean[2])
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 900


def test_mix_odd_rows(make_docs):
    docs = make_docs([(None, "a b c", None, "s"), (1, "x y", None, "s"), (1, "x y", None, "s"), *[(i, "p q r s", None, "t") for i in range(10, 60)]])
    own = docs.withColumns({"source_size": F.lit("own"), "target": F.lit("own"), "taken": F.lit("own"), "size": F.lit("own"), "bits": F.lit("own"), "words": F.lit("own")})
    out = mixing.pareto_mix(own).collect()
    assert len(out) == 53 and {r["bits"] for r in out} == {"own"} and {r["source_size"] for r in out} == {7, 200}


def test_mix_names_of_its_own(make_docs):
    """No column of the caller clashes with those used inside, nor is it changed."""
    plain = make_docs([(i, "w " * (i % 30 + 1), None, ("a", "b", None)[i % 3]) for i in range(200)])
    names = ("_s", "_c", "_n", "_t", "_x", "_b", "_whole", "_extra", "_rest", "_q", "_p", "_last", "_got", "_first", "key", "doc", "h", "g", "bits", "whole", "p", "count")
    own = plain.withColumns({n: F.lit("own") for n in names})
    out = mixing.pareto_mix(own)
    assert out.columns == [*own.columns, "size", "source_size", "target", "taken"]
    rows = out.collect()
    assert all(r[n] == "own" for r in rows for n in names)
    assert {(r["doc_id"], r["taken"]) for r in rows} == {(r["doc_id"], r["taken"]) for r in mixing.pareto_mix(plain).collect()}


def test_mix_repeated_ids_meet_the_target(make_docs):
    docs = make_docs([*[(7, "w " * 50, None, "a")] * 100, *[(8, f"{i} " * 50, None, "a") for i in range(100)], *[(i, "x " * 50, None, "b") for i in range(100, 140)]])
    out = mixing.pareto_mix(docs).orderBy("doc_id", "text", "taken").collect()
    assert len(out) == 240 and all(r["taken"] % 50 == 0 and r["taken"] <= 150 for r in out)
    for source in "ab":
        own = [r for r in out if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 25
    assert out == mixing.pareto_mix(docs.repartition(9)).orderBy("doc_id", "text", "taken").collect()


def pages(spark):
    big = "<p>é" * 60
    return spark.createDataFrame([(5, "http://a/", big), (3, "http://b/", big), (9, None, big), (1, "u", "short"), (2, "u", "short"), (4, "x\r\nInjected: 1", None), (6, "u", ""), (7, "http://long/", "z" * 400000)], "page_id long, url string, html string").withColumn("digest", F.lit("own"))


def test_warc_round_trip(spark):
    p = pages(spark)
    index = warc.write(p)
    back = {r["page_id"]: r for r in warc.read(index).collect()}
    want = {r["page_id"]: (r["html"] or "").encode() for r in p.collect()}
    assert set(back) == set(want)
    assert {k: r["refers_to"] for k, r in back.items() if r["record_type"] == "revisit"} == {5: 3, 9: 3}
    for k, r in back.items():
        assert r["payload_bytes"] == len(want[k])
        assert r["record_type"] == "revisit" or bytes(r["payload"]) == want[k]
    assert warc.write(p.limit(0)).count() == 0
    # selected records only, and ranges that lie apart
    some = warc.read(index.where("page_id in (3, 7)"), gap=0, most=10).collect()
    assert {r["page_id"] for r in some} == {3, 7}


def test_warc_files_are_plain_warc(spark, tmp_path):
    import gzip

    index = warc.write(pages(spark), f"file://{tmp_path}/w").collect()
    text = b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "w").iterdir()))
    assert text.count(b"WARC/1.1\r\n") == len(index) == 8
    assert b"\r\nInjected" not in text


def test_warc_records_by_the_format(spark, tmp_path):
    """Every record has the fields that WARC/1.1 asks for, a block of the length it names, and an id of its own."""
    import gzip
    import hashlib

    p = pages(spark).withColumn("date", F.when(F.col("page_id") != 9, F.lit("2024-03-01 10:20:30").cast("timestamp")))
    index = warc.write(p, f"file://{tmp_path}/w")
    ids, refers = {}, []
    for r in index.collect():
        with open(r["file"].removeprefix("file://"), "rb") as f:
            f.seek(r["offset"])
            text = gzip.decompress(f.read(r["length"]))
        head, _, rest = text.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        assert lines[0] == "WARC/1.1" and re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", fields["WARC-Record-ID"])
        assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", fields["WARC-Date"]) and fields["WARC-Date"].startswith("1970" if r["page_id"] == 9 else "2024-03-01T10:20:30")
        assert fields["Content-Type"] == "application/http; msgtype=response" and len(rest) == int(fields["Content-Length"]) + 4 and rest.endswith(b"\r\n\r\n")
        http, _, body = rest[:-4].partition(b"\r\n\r\n")
        assert http.startswith(b"HTTP/1.1 200 OK\r\n") and fields["WARC-Target-URI"]
        if r["record_type"] == "response":
            assert fields["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(body).hexdigest()
        else:
            assert body == b""
            refers.append((fields["WARC-Refers-To"], r["refers_to"]))
        ids[r["page_id"]] = fields["WARC-Record-ID"]
    assert len(set(ids.values())) == len(ids) == 8 and refers and all(ids[k] == u for u, k in refers)
    assert {r["url"] for r in warc.read(index).where("page_id = 9").collect()} == {None}
    assert warc.read(index.limit(0)).count() == 0


def test_warc_repeated_ids(spark):
    p = spark.createDataFrame([(1, "u", "x" * 200), (1, "u", "x" * 200), (2, "u", "x" * 200), (1, "v", "y" * 200)], "page_id long, url string, html string")
    got = sorted((r["page_id"], r["record_type"], r["refers_to"], bytes(r["payload"] or b"")[:1]) for r in warc.read(warc.write(p)).collect())
    assert got == [(1, "response", None, b"x"), (1, "response", None, b"x"), (1, "response", None, b"y"), (2, "revisit", 1, b"")]


def test_warc_odd_dates_and_urls(spark):
    """A date that is none, and urls that look like the names that pages without a url get."""
    df = spark.createDataFrame([(1, "urn:page:5", "x" * 120, "last week"), (2, None, "y", None), (3, " ", "z", "2024-05-01 10:00:00"), (4, "http://a.b/", "x" * 120, "soon")], "page_id long, url string, html string, date string")
    out = {r["page_id"]: r for r in warc.read(warc.write(df)).collect()}
    assert {k: r["url"] for k, r in out.items()} == {1: "urn:page:5", 2: None, 3: "", 4: "http://a.b/"} and out[4]["refers_to"] == 1
