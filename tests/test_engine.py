"""The engine: fixtures of text preparation, exact and ranked semantics, generations, windows, maintenance."""

import os
import random
import threading
import time
import weakref

import duckdb
import pytest
from pyspark.sql import functions as F

from quarrylight import queries
from quarrylight.engine import Engine
from quarrylight.errors import EngineError
from quarrylight.functions import expressions as E
from quarrylight.operators import exact, inventory, objects, prepare, ranked, results
from quarrylight.operators.windows import Window, check_page
from quarrylight.plans.generation import faults
from quarrylight.sources import files
from quarrylight.streaming.watch import watch

MIXED = "α\r\nβ\nγ\rδ".encode()
LAYOUT = "α\r\nbeta\nlong_unicode_βγδε\rfinal".encode()


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    found = queries.QUERIES[name](spark, sf_dir)
    con.execute(queries.ORACLE[name])
    names = [d[0] for d in con.description]
    assert sorted(names) == sorted(found.columns)
    assert sorted(map(str, found.select(*names).collect())) == sorted(str(r) for r in spark.createDataFrame(con.fetchall() or [], found.select(*names).schema).collect())


def test_lines():
    assert prepare.line_ends(MIXED) == [4, 7, 10, 12] and prepare.line_ends(b"") == [] and prepare.line_ends(b"a\n") == [2]


def test_line_spans(spark):
    got = prepare.line_spans(spark.createDataFrame([(1, MIXED.decode()), (2, ""), (3, "a\n")], "source_id int, text string")).orderBy("source_id", "line_index").collect()
    assert [(r.start, r.content_end, r.end) for r in got if r.source_id == 1] == [(0, 2, 4), (4, 6, 7), (7, 9, 10), (10, 12, 12)]
    assert [r.source_id for r in got] == [1] * 4 + [3]


def test_unit_layout():
    assert prepare.units(LAYOUT, 5, 9) == [(0, 4, 0, 1, True, True), (4, 9, 1, 2, True, True), (9, 14, 2, 3, True, False), (14, 19, 2, 3, False, False), (19, 24, 2, 3, False, False), (24, 31, 2, 3, False, True), (31, 36, 3, 4, True, True)]
    assert [u[:2] for u in prepare.units(b"abcdefghijkl", 4, 8)] == [(0, 4), (4, 12)]
    assert [u[:2] for u in prepare.units(b"exact\ntext", 4, 8)] == [(0, 6), (6, 10)]
    with pytest.raises(prepare.UnitTooLarge):
        prepare.units("α".encode(), 1, 1)
    r = random.Random(1)
    for _ in range(500):
        data = "".join(r.choice("aβ漢\U0001f600\r\n ") for _ in range(r.randrange(40))).encode()
        spans = prepare.units(data, 4, 9)
        assert b"".join(data[a:b] for a, b, *_ in spans) == data and all(b - a <= 9 for a, b, *_ in spans)
        [data[a:b].decode() for a, b, *_ in spans]


def test_gaps(spark):
    rows = [(1, b"a\0b"), (2, b"\xff"), (3, b"\x01\x02\x03"), (4, b"\x01\x02\x03\x04"), (5, b"\0\xff"), (6, b""), (7, b"x" * 50), (8, "α".encode()), (9, b"a\nb")]
    frame = spark.createDataFrame(rows, "source_id int, content binary")
    got = {r.source_id: (r.gap, r.units and len(r.units)) for r in prepare.prepare(frame, 16, 64, max_input=40).collect()}
    assert got == {1: ("binary_content", None), 2: ("invalid_utf8", None), 3: (None, 1), 4: ("binary_content", None), 5: ("binary_content", None), 6: (None, 0) if got[6][1] else (None, got[6][1]), 7: ("input_too_large", None), 8: (None, 1), 9: (None, 1)}
    assert not got[6][1]
    assert prepare.prepare(frame.filter("source_id = 8"), 1, 1).first().gap == "unit_too_large"
    assert prepare.prepare(frame.filter("source_id = 9"), 16, 64, max_lines=1).first().gap == "too_many_lines"


def test_saved_layout_is_accepted(spark):
    frame = spark.createDataFrame([(1, bytearray(LAYOUT))], "source_id int, content binary")
    made = prepare.prepare(frame, 5, 9).withColumn("digest", E.digest(F.col("content"))).withColumn("bytes", F.octet_length("content").cast("long"))
    assert prepare.inspected(made, 9).first().fault is None and prepare.inspected(made, 6).first().fault == "unit_size"
    assert prepare.accepted(made, made, 9).first().fault is None
    assert prepare.accepted(made, made.withColumn("bytes", F.lit(1).cast("long")), 9).first().fault == "binding"
    assert prepare.accepted(made, made.filter("false"), 9).first().fault == "binding"
    assert prepare.inspected(made.withColumn("bytes", F.lit(1).cast("long")), 9).first().fault == "size"
    assert prepare.inspected(made.withColumn("content", F.lit(None).cast("binary")), 9).first().fault == "missing"
    spans = [u.asDict() for u in made.first().units]
    assert prepare.layout_fault(LAYOUT, spans, 9) is None and prepare.layout_fault(b"", [], 9) is None
    odd = "long_é".encode()
    whole = {"start": 0, "end": 6, "line_start": 0, "line_end": 1, "starts_at_line_boundary": True, "ends_at_line_boundary": False}
    rest = {"start": 6, "end": 7, "line_start": 0, "line_end": 1, "starts_at_line_boundary": False, "ends_at_line_boundary": True}
    assert prepare.layout_fault(odd, [whole, rest], 9) == "character" and prepare.layout_fault(odd, [], 9) == "coverage"
    assert prepare.layout_fault(odd, [{**whole, "end": 9}], 9) == "coverage"
    for k in range(len(spans)):
        for key, fault in (("line_start", "line_range"), ("line_end", "line_range"), ("starts_at_line_boundary", "flags"), ("ends_at_line_boundary", "flags")):
            bad = [{**u, key: (not u[key]) if fault == "flags" else u[key] + 1} if i == k else u for i, u in enumerate(spans)]
            assert prepare.layout_fault(LAYOUT, bad, 9) == fault
    r = random.Random(2)
    for _ in range(300):
        data = "".join(r.choice("aβ漢\U0001f600\r\n ") for _ in range(r.randrange(40))).encode()
        keys = ("start", "end", "line_start", "line_end", "starts_at_line_boundary", "ends_at_line_boundary")
        assert prepare.layout_fault(data, [dict(zip(keys, u)) for u in prepare.units(data, 4, 9)], 9) is None


def test_classes(spark):
    cases = {"/a/vendor/x.md": "vendor", "/a/vendor": "primary", "/a/x.MD": "documentation", "/a/VENDOR/b/x": "vendor", "/a/.md": "primary", "/a/vendored/x.rst": "documentation"}
    frame = spark.createDataFrame([(p,) for p in cases], "path string")
    assert {r[0]: r[1] for r in frame.select("path", E.source_class(F.col("path"))).collect()} == cases
    below = {r[0] for r in spark.createDataFrame([("/a/b",), ("/a/bc",), ("/a/b/c",)], "path string").filter(E.below(F.col("path"), "/a/b")).collect()}
    assert below == {"/a/b", "/a/b/c"}


def test_tokens(spark):
    cases = {"snake_case": ["snake", "case", "snake_case"], "camelCase": ["camel", "case", "camelcase"], "HTTPServer": ["http", "server", "httpserver"], "sha256 B2B": ["sha256", "b2b"], "a-b": ["a", "b"], "": []}
    frame = spark.createDataFrame([(t,) for t in cases], "text string")
    assert {r[0]: r[1] for r in frame.select("text", E.tokens(F.col("text"))).collect()} == cases
    assert all(E.query_terms(t) == v for t, v in cases.items())
    assert E.excerpt_terms("ab Token tokens token_x É") == ["token_x", "tokens", "token"]


def facts(spark, rows, literal):
    return exact.summary(spark.createDataFrame(rows, "source_id int, content binary"), literal).first()


def test_exact_facts(spark):
    assert (r := facts(spark, [(1, b"x"), (2, b"y"), (3, b"z")], "q")).complete_negative and r.scanned_sources == 3
    assert not facts(spark, [], "q").complete_negative
    r = facts(spark, [(1, b"x"), (2, b"y"), (3, None)], "q")
    assert not r.complete_negative and not r.scan_complete and r.missing_sources == 1
    assert facts(spark, [(1, b"aaaa"), (2, b"\xff\\E.aa")], b"aa").matches == 4
    assert facts(spark, [(1, b"\xff\\E.*(a")], b"\\E.*(").matches == 1


def test_exact_items(spark):
    rows = [(1, "one\ntwo aa\naaa é".encode()), (2, None), (3, b"none"), (4, b"aa" * 50)]
    got = exact.items(spark.createDataFrame(rows, "source_id int, content binary"), "aa", 6).collect()
    assert [(r.source_id, r.kind, r.start, r.line) for r in got] == [(1, "match", 8, 2), (1, "match", 11, 3), (1, "match", 12, 3), (2, "gap", None, None), (4, "match", 0, 1), (4, "match", 1, 1)]
    assert got[0].excerpt == "two aa\n" and got[0].hex == "6161" and got[0].ascii == "aa"
    assert exact.line_excerpt("é".encode() * 400, 0, 401) == (274, 786)


def test_selection_rules(spark):
    frame = spark.createDataFrame([("a", "/x/a.md", "documentation"), ("b", "/x/b", "primary")], "source_id string, path string, source_class string")
    for code, options in (("EXACT_EMPTY_SELECTION", {"ids": []}), ("EXACT_SOURCE_NOT_PUBLISHED", {"ids": ["z"]}), ("EXACT_SOURCE_REPEATED", {"ids": ["a", "a"]}), ("EXACT_PREFIX_INVALID", {"prefix": "x"}), ("EXACT_PREFIX_INVALID", {"prefix": "/x/../y"}), ("EXACT_SELECTION_EMPTY", {"prefix": "/y"})):
        with pytest.raises(EngineError) as e:
            exact.select(frame, **options)
        assert e.value.code == code
    assert [r.source_id for r in exact.select(frame, prefix="/x", source_class="primary").collect()] == ["b"]
    for bad in ("", "x" * 5000):
        with pytest.raises(EngineError):
            exact.check(bad)


def test_diversity_and_weights(spark):
    rows = [("s", "primary", i, 10.0 - i) for i in range(3)] + [("v", "vendor", 0, 20.0), ("d", "documentation", 0, 12.0)]
    got = ranked.ranked(spark.createDataFrame(rows, "source_id string, source_class string, unit int, score double"), 10).collect()
    assert [(r.source_id, r.unit) for r in got] == [("s", 0), ("s", 1), ("d", 0), ("v", 0)]


def test_ranked_excerpt():
    data = ("é" * 400 + " needle " + "x" * 400).encode()
    a, b = ranked.excerpt(data, ["absent", "needle"])
    assert b - a <= 512 and "needle" in data[a:b].decode() and ranked.excerpt(b"short", []) == (0, 5) and ranked.excerpt(data, [])[0] == 0


def test_excerpts_of_all_hits(spark, sf_dir):
    rows = queries._bodies(spark, sf_dir).select("path", "unit", "body").collect()
    want = {}
    for r in rows:
        text = bytes(r["body"]).decode()
        data, start = text.encode(), 0
        places = [(data.lower().find(t), len(t)) for t in (b"worthless", b"token", b"trash", b"the") if t in data.lower()]
        if len(data) > 512 and places:
            start = min(max(0, places[0][0] - (512 - places[0][1]) // 2), len(data) - 512)
        bounds = [len(text[:i].encode()) for i in range(len(text) + 1)]
        start = min(b for b in bounds if b >= start)
        want[r["path"], r["unit"]] = (start, max(b for b in bounds if b <= start + 512))
    got = {(r["path"], r["unit"]): (r["excerpt_start"], r["excerpt_end"]) for r in queries.excerpts(spark, sf_dir).collect()}
    assert got == want and len(got) == 64 and any(len(r["body"]) > 512 for r in rows)


def test_objects(spark):
    store = objects.stored(spark.createDataFrame([(b"a",), (b"a",), (b"bb",)], "content binary"), "source")
    assert store.count() == 2
    refs = store.select("kind", "digest", "bytes")
    bad = store.withColumn("content", F.when(F.col("bytes") == 1, F.lit(b"z")).otherwise(F.col("content"))).filter("bytes = 1")
    assert sorted(r.status for r in objects.read(refs, bad).collect()) == ["integrity_failure", "missing"]
    with pytest.raises(EngineError):
        objects.marks(refs, refs.withColumn("bytes", F.col("bytes") + 1))


def test_upsert(spark):
    saved = spark.createDataFrame([("/a", 1, "d1", 1)], "path string, row_revision long, digest string, bytes long")
    assert inventory.upsert(saved, "/a", 1, "d1", 1)[1] is False
    rows, changed = inventory.upsert(saved, "/a", 1, "d2", 2)
    assert changed and rows.first().row_revision == 2 and inventory.upsert(saved, "/b", None, "x", 1)[0].count() == 2
    with pytest.raises(EngineError):
        inventory.upsert(saved, "/a", 2, "d2", 2)


def test_window():
    now = [0.0]
    data = {"s": "aé needle b".encode()}
    w = Window([{"kind": "match", "source_id": "s", "start": 4, "end": 10}, {"kind": "gap", "source_id": "t"}], 1, data.__getitem__, ttl_s=10, clock=lambda: now[0])
    with pytest.raises(EngineError):
        w.expand(0, 0, 0)
    p = w.page(1)
    assert p["next"] == 1 and not p["done"] and w.page(1) == p
    w.ack(0, 1)
    assert w.page(5)["items"][0]["kind"] == "gap"
    assert w.expand(0, 1, 2) == {"before": (3, " "), "after": (10, " b")}
    for index, before, after, code in ((0, 9, 0, "WINDOW_RANGE_INVALID"), (0, 0, 9, "WINDOW_RANGE_INVALID"), (0, 2, 0, "WINDOW_UTF8_BOUNDARY"), (1, 0, 0, "WINDOW_ITEM_IS_GAP")):
        with pytest.raises(EngineError) as e:
            w.expand(index, before, after)
        assert e.value.code == code
    now[0] = 11
    with pytest.raises(EngineError):
        w.page()


def test_output_fit():
    items = [{"source_id": k, "text": "é" * 10} for k in range(5)]
    whole = results.size(items)
    assert [results.fitting(items, n) for n in (0, 2, whole - 1, whole)] == [0, 0, 4, 5] and results.fitting([], 2) == 0
    shown = {"status": "available", "saved_path_hint": "/" + "p" * 300, "reason": None, "live_status": "not_checked"}
    answer = {"items": [{**i, "source_info": shown} for i in items], "stop": "complete", "matches": 5}
    assert results.fit(answer) == answer
    small = results.fit(answer, 1200, keep_items=True)
    assert len(small["items"]) == 5 and small["stop"] == "complete" and small["matches"] == 5
    assert {i["source_info"]["reason"] for i in small["items"]} == {"output_limit"} and answer["items"][0]["source_info"] is shown
    cut = results.fit(answer, 1200)
    assert 0 < len(cut["items"]) < 5 and cut["stop"] == "output_limit" and results.size(cut) <= 1200


def test_source_info(spark):
    paths = {"/a/b": "available", "file:/a": "available", "s3a://b/k": "available", "a/b": "invalid_locator", "": "invalid_locator", "/a\0": "invalid_locator", None: "invalid_locator", "/" + "x" * 65_536: "output_limit"}
    frame = spark.createDataFrame([(p,) for p in paths], "path string").select("path", results.source_info(F.col("path")).alias("i"))
    got = {r.path: r.i for r in frame.collect()}
    assert {p: i.reason or i.status for p, i in got.items()} == paths and all((i.saved_path_hint is None) == (i.status == "unavailable") for i in got.values())


def test_pages_are_checked():
    items = [{"kind": "match", "source_id": "a", "start": k, "end": k + 1} for k in range(3)] + [{"kind": "gap", "source_id": "b", "start": None}]
    w = Window(items, 1, None)
    page = w.page(3)
    check_page(page, [], 3)
    w.ack(0, 3)
    check_page(w.page(3), items[:3], 3)
    for change in ({"generation": 0}, {"first": 1}, {"next": 2}, {"retained": 65}, {"done": True}, {"items": items[:2]}, {"stop": "output_limit"}, {"items": [items[1], items[0], items[2]]}, {"items": [items[0], items[0], items[2]]}):
        with pytest.raises(EngineError):
            check_page(page | change, [], 3)
    hits = [{"kind": "hit", "source_id": "a", "unit": k, "rank": k + 1} for k in range(3)]
    page = Window(hits, 1, None).page(3)
    check_page(page, [], 3)
    for bad in ([hits[1], hits[0], hits[2]], [hits[0], {**hits[0], "rank": 2}, hits[2]]):
        with pytest.raises(EngineError):
            check_page(page | {"items": bad}, [], 3)
    small = Window(items, 1, None, frame=results.size(items[:2]))
    page = small.page(3)
    assert (page["next"], page["stop"], page["done"]) == (2, "output_limit", False)
    check_page(page, [], 3)
    with pytest.raises(EngineError):
        Window(items, 1, None, frame=5).page(3)


def test_session(spark, sf_dir):
    engine, now = queries.engine(spark, sf_dir), [0.0]
    session = engine.session(ttl_s=10, clock=lambda: now[0])

    def refused(code, work):
        with pytest.raises(EngineError) as e:
            work()
        assert e.value.code == code

    refused("WINDOW_NOT_OPEN", lambda: session.next(1))
    assert session.open(2, literal="tion ", limit=20)["retained"] == 20
    refused("SESSION_REQUEST_ID_INVALID", lambda: session.next(2))
    refused("WINDOW_ALREADY_OPEN", lambda: session.open(3, literal="x"))
    first = session.next(4, 16)
    session.cancel(4)  # over already
    refused("SESSION_NO_ACTIVE_REQUEST", lambda: session.cancel(9))
    assert len(first["items"]) == 16 and session.next(5, 16)["done"] and session.expand(6, 0, 0, 0)["before"][1] == ""
    # A cancel from another thread ends the running request; the window stays.
    started, errors = threading.Event(), []
    held = session.window.page
    session.window.page = lambda size: (started.set(), spark.range(1 << 40).selectExpr("sum(hash(id))").collect())

    def run():
        try:
            session.next(7)
        except EngineError as e:
            errors.append(e.code)

    thread = threading.Thread(target=run)
    thread.start()
    started.wait(30)
    refused("SESSION_REQUEST_IN_FLIGHT", lambda: session.next(8))
    refused("QUERY_RESPONSE_MISMATCH", lambda: session.cancel(99))
    time.sleep(1)
    session.cancel(7)
    thread.join(60)
    session.window.page = held
    assert errors == ["QUERY_CANCELLED"] and session.next(8)["done"]
    now[0] = 11
    refused("WINDOW_EXPIRED", lambda: session.next(9))
    session.close(10)
    refused("WINDOW_CLOSED", lambda: session.next(11))


def test_damaged_preparations_are_not_published(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "root")).initialize()
    rows = spark.createDataFrame([("/a", bytearray(b"one\ntwo")), ("/b", bytearray(b"three"))], "path string, content binary")
    engine.index_rows(rows)
    m = engine.root.manifest()
    folder = engine.root.at("preparations", f"snapshot={m['snapshot']}")
    spark.read.parquet(folder).withColumn("units", F.expr("transform(units, u -> named_struct('start', u.start, 'end', u.end, 'line_start', u.line_start, 'line_end', u.line_end + 1, 'starts_at_line_boundary', u.starts_at_line_boundary, 'ends_at_line_boundary', u.ends_at_line_boundary))")).write.parquet(str(tmp_path / "bad"))
    engine.root.delete("preparations", f"snapshot={m['snapshot']}")
    spark.read.parquet(str(tmp_path / "bad")).write.parquet(folder)
    engine.root.write_manifest(m | {"wanted_revision": m["wanted_revision"] + 1}, m)
    with pytest.raises(EngineError) as e:
        engine.publish()
    assert e.value.code == "PUBLICATION_GRAPH_INVALID" and engine.exact("three")["matches"] == 1


def test_class_lane_and_locators(spark, sf_dir):
    engine = queries.engine(spark, sf_dir)
    every, docs = engine.search("the token", 64), engine.search("the token", 64, "documentation")
    assert {h["source_class"] for h in docs} == {"documentation"} and [h["rank"] for h in docs] == list(range(1, len(docs) + 1))
    both = {(h["path"], h["unit"]): h["score"] for h in every}
    assert all(abs(both.get((h["path"], h["unit"]), h["score"]) - h["score"]) < 1e-9 for h in docs)
    found = engine.exact("tion ", limit=3, source_info=True)
    assert all(i["source_info"]["saved_path_hint"].startswith("/corpus/") and i["source_info"]["live_status"] == "not_checked" for i in found["items"])


def test_engine_end_to_end(spark, tmp_path):
    tree = tmp_path / "tree"
    for name, body in {"a.txt": b"alpha AlphaWord after\nneedle here\n", "vendor/v.txt": b"needle needle", "doc.md": b"needle in docs", "bin": b"\0\1", "skip.log": b"needle", "keep.log": b"alpha_suffix", "sub/deep.tmp": b"needle", ".gitignore": b"*.log\n!keep.log\nsub/*.tmp\n", ".git/x": b"needle"}.items():
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_bytes(body)
    engine = Engine(spark, str(tmp_path / "root"))
    assert engine.inspect() == "absent"
    engine.initialize()
    first = engine.index(str(tree))
    view = engine.open_verified()
    assert {os.path.relpath(r.path, tree) for r in view.sources.collect()} == {"a.txt", "vendor/v.txt", "doc.md", "bin", "keep.log"}
    assert engine.index()["published"] is False
    hits = engine.search("needle", 5)
    assert [os.path.basename(h["path"]) for h in hits][-1] == "v.txt" or len(hits) == 3
    assert all(view.read(h["source_id"])[h["excerpt"]["start"] : h["excerpt"]["end"]].decode() == h["excerpt"]["text"] for h in hits)
    assert [os.path.basename(h["path"]) for h in engine.search("alphaword")] == ["a.txt"]
    found = engine.exact("needle")
    assert found["matches"] == 4 and not found["scan_complete"] and found["summary"]["published_preparation_gaps"] == 1
    raw = engine.exact(b"needle", mode="raw", source_class="primary", prefix=str(tree))
    assert raw["matches"] == 1 and raw["scan_complete"]
    w = view.window(literal="needle", limit=2)
    w.page()
    item = next(i for i in w.items if i["kind"] == "match")
    assert w.expand(w.items.index(item), 0, 0)["before"][1] == ""
    (tree / "a.txt").write_bytes(b"changed")
    (tree / "doc.md").unlink()
    (tree / ".gitignore").write_bytes(b"*.log\n")
    second = engine.index()
    assert second["published"] and second["generation"] == first["generation"] + 1
    assert len(view.sources.collect()) == 5 and view.exact("AlphaWord")["matches"] == 1
    now = {os.path.basename(r.path): r.row_revision for r in engine.pin().sources.collect()}
    assert now["a.txt"] == 2 and "doc.md" not in now and now["keep.log"] == 1
    assert engine.collect_objects()["deleted"] == 0 and view.exact("AlphaWord")["matches"] == 1
    swept = engine.collect_objects(grace_s=0)
    assert swept["deleted"] == 2 and engine.exact("AlphaWord")["matches"] == 0
    engine.export(str(tmp_path / "archive"))
    other = Engine(spark, str(tmp_path / "other"))
    other.import_archive(str(tmp_path / "archive"))
    assert other.exact("changed")["matches"] == 1 and other.pin().sources.count() == engine.pin().sources.count()
    assert engine.retain_file(str(tree / "skip.log"))["changed"] == 1
    assert engine.pin().summary()["control"]["known_control_lag"]
    with pytest.raises(EngineError):
        Engine(spark, str(tmp_path / "nothing")).search("x")
    with pytest.raises(EngineError):
        engine.search("")


def test_a_root_takes_little_disk(spark, sf_dir):
    """Postings without ids and units without texts: a root is about as large as its texts. A unit's text is still shown."""
    engine = queries.engine(spark, sf_dir)
    top = engine.root.path.removeprefix("file://")
    view = engine.pin()
    texts = view.sources.agg(F.sum("bytes")).first()[0]
    held = sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(top) for f in names)
    assert held < 2 * texts and "text" not in view.units.columns and "source_id" not in view.postings.columns, held / texts
    row = view.units.filter("unit = 1").first()
    shown = view.unit(row["source_id"], 1)
    assert shown["text"].encode() == view.read(row["source_id"])[row["start"] : row["end"]] and shown["point_id"] == row["point_id"]


def test_an_index_is_built_in_slices(spark, tmp_path, monkeypatch):
    """Every digest is in one slice, and an index of three slices, each written by itself, is whole."""
    monkeypatch.setattr(objects, "SLICE_BYTES", 100)
    bodies = [b"needle %d %d" % (i, i % 3) for i in range(24)]
    inside = objects.slices(250)
    held = spark.createDataFrame([(b,) for b in map(bytearray, bodies)], "content binary").select(E.digest(F.col("content")).alias("digest"))
    counts = held.agg(*(F.count_if(c).alias(f"c{i}") for i, c in enumerate(inside))).first()
    assert len(inside) == 3 and sum(counts) == 24 and min(counts) > 0
    engine, modes = Engine(spark, str(tmp_path / "root")).initialize(), []
    real = engine.root.write
    monkeypatch.setattr(engine.root, "write", lambda df, *names, mode="overwrite": modes.append((names[0], mode)) or real(df, *names, mode=mode))
    engine.index_rows(spark.createDataFrame([(f"/{i}", bytearray(b)) for i, b in enumerate(bodies)], "path string, content binary"))
    assert modes.count(("postings", "append")) == sum(map(len, bodies)) // 100 + 1 > 1
    view = engine.pin()
    assert view.postings.filter("term = 'needle'").count() == 24 and view.current["tokens"] == 72 and len(engine.search("needle", 64)) == 24


def test_a_slice_is_let_go_before_the_next(spark, tmp_path, monkeypatch):
    """Between two slices the driver's garbage is collected once when nothing holds the last one's frames and shuffle files."""
    monkeypatch.setattr(objects, "SLICE_BYTES", 100)
    engine = Engine(spark, str(tmp_path / "root")).initialize()
    write, tidy, seen = engine.root.write, engine.root.tidy, []

    def watched_write(df, *names, mode="overwrite"):
        if names[0] == "postings":
            seen.append((weakref.ref(df), []))
        write(df, *names, mode=mode)

    def watched_tidy():
        tidy()
        if seen:
            seen[-1][1].append(seen[-1][0]() is not None)

    monkeypatch.setattr(engine.root, "write", watched_write)
    monkeypatch.setattr(engine.root, "tidy", watched_tidy)
    engine.index_rows(spark.createDataFrame([(f"/{i}", bytearray(b"needle %d" % i)) for i in range(24)], "path string, content binary"))
    assert len(seen) > 1 and all(not all(held) for _, held in seen)


def test_terms_are_let_go_before_the_graph_is_checked(spark, tmp_path, monkeypatch):
    """write() itself can't let go of the shuffle files of the frame that its caller holds."""
    engine, seen = Engine(spark, str(tmp_path / "root")).initialize(), []
    write, tidy = engine.root.write, engine.root.tidy
    monkeypatch.setattr(engine.root, "write", lambda df, *names, mode="overwrite": write(df, *names, mode=mode) or seen.append(names[0]))
    monkeypatch.setattr(engine.root, "tidy", lambda: tidy() or seen.append("tidy"))
    monkeypatch.setattr("quarrylight.engine.faults", lambda *a: seen.append("faults") or faults(*a))
    engine.index_rows(spark.createDataFrame([("/a", bytearray(b"needle"))], "path string, content binary"))
    assert seen[seen.index("terms") :][:3] == ["terms", "tidy", "faults"]


def test_terms_hold_the_sums_of_their_postings(spark, tmp_path):
    """So that nobody has to shuffle all postings for them; the tokens of a generation are their sum."""
    engine = Engine(spark, str(tmp_path / "root")).initialize()
    engine.index_rows(spark.createDataFrame([("/a", bytearray(b"one two two")), ("/b", bytearray(b"two")), ("/c", bytearray(b""))], "path string, content binary"))
    view = engine.pin()
    assert sorted(map(tuple, view.terms.select("term", "df", "tf").collect())) == [("one", 1, 1), ("two", 2, 3)] and view.current["tokens"] == 4
    engine.index_rows(spark.createDataFrame([("/c", bytearray(b""))], "path string, content binary"))
    assert engine.pin().terms.count() == 0 and engine.pin().current["tokens"] == 0


def test_a_slice_has_few_files(spark, tmp_path):
    """Postings are sorted in each file, which holds its terms; many small ones, one a shuffle partition, hold them more often."""
    engine = Engine(spark, str(tmp_path / "root")).initialize()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        engine.index_rows(spark.createDataFrame([(f"/{i}", bytearray(b"needle %d" % i)) for i in range(200)], "path string, content binary"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    view = engine.pin()
    assert view.postings.count() == 400 and len(view.postings.inputFiles()) <= spark.sparkContext.defaultParallelism


def test_a_sweep_drops_generations_first(spark, tmp_path, monkeypatch):
    """The disk doesn't hold a generation whose grace is over besides the store's next version."""
    engine = Engine(spark, str(tmp_path / "root")).initialize()
    rows = spark.createDataFrame([("/a", bytearray(b"one needle")), ("/b", bytearray(b"two"))], "path string, content binary")
    engine.index_rows(rows)
    engine.index_rows(rows.filter("path = '/a'"))
    write, found = engine.root.write, {}

    def watched(df, *names, mode="overwrite"):
        found[names] = engine.root.exists("postings", "generation=1"), engine.root.manifest()["retired"]
        write(df, *names, mode=mode)

    monkeypatch.setattr(engine.root, "write", watched)
    assert engine.collect_objects(grace_s=0) == {"marked": 1, "verified": 1, "deleted": 1, "preserved": 1}
    assert found == {("objects", "version=1"): (False, [])}
    assert engine.open_verified().sources.count() == 1 and engine.exact("needle")["matches"] == 1


def test_trees_one_after_the_other(spark, tmp_path):
    """What was kept of a tree is served although its files are gone, once it is published."""
    engine = Engine(spark, str(tmp_path / "root")).initialize()
    for k in range(2):
        (tmp_path / f"tree{k}").mkdir()
        (tmp_path / f"tree{k}" / "a.txt").write_bytes(b"needle %d" % k)
        assert engine.index(str(tmp_path / f"tree{k}"), publish=False) == {"published": False, "changed": 1}
        (tmp_path / f"tree{k}" / "a.txt").unlink()
    with pytest.raises(EngineError):
        engine.pin()
    engine.publish()
    assert engine.open_verified().sources.count() == 2 and engine.exact("needle")["matches"] == 2


def test_an_archive_is_taken(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "root")).initialize()
    engine.index_rows(spark.createDataFrame([("/a", bytearray(b"one needle")), ("/b", bytearray(b"two"))], "path string, content binary"))
    engine.export(str(tmp_path / "archive"))
    other = Engine(spark, str(tmp_path / "new" / "other"))
    other.import_archive(str(tmp_path / "archive"), take=True)
    assert not (tmp_path / "archive").exists() and other.open_verified().sources.count() == 2 and other.exact("needle")["matches"] == 1


def test_postings_of_units(spark):
    frame = spark.createDataFrame([(1, "b a b snakeCase"), (2, ""), (3, None), (4, "a \u4f60 a\x01a")], "k int, text string")
    got = sorted((r.k, r.term, r.tf, r.dl) for r in ranked.postings(frame, "k").collect())
    assert got == [(1, "a", 1, 6), (1, "b", 2, 6), (1, "case", 1, 6), (1, "snake", 1, 6), (1, "snakecase", 1, 6), (4, "a", 3, 4), (4, "\u4f60", 1, 4)]


TREE = {
    "_a/b.txt": 1, "__init__.py": 1, "_config.yml": 1, ".x": 0, ".kept": 1, ".gitignore": 0, ".ignore": 0, "a.log": 0, "keep.log": 1, "sub/.gitignore": 0, "sub/a.log": 1, "sub/x.tmp": 0, "sub/deep/y.tmp": 0, "sub/z/only.txt": 0, "other/z/only.txt": 1,
    "build/out.o": 0, "doc/build": 1, "a b.txt": 1, "#hash": 0, "sp ": 0, "x[1].c": 0, "deep/one/two/data.bin": 0, "deep/data.bin": 0, "end/a/b": 0, "both.txt": 1, "parent.bak": 0, "excluded.me": 0, ".git/info/exclude": 0, "é_ü.txt": 1,
}


def test_tree_rules(spark, tmp_path):
    """Names and rules of each kind, nested and above the tree."""
    top = tmp_path / "above" / "tree"
    for name in TREE:
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(b"x")
    (top / ".gitignore").write_bytes("*.log\n!keep.log\n!.kept\nbuild/\n\\#hash\nsp\\ \nx\\[[0-9]].c\ndeep/**/data.bin\nend/**\nboth.txt\n".encode())
    (top / ".ignore").write_bytes(b"!both.txt\n")
    (top / "sub/.gitignore").write_bytes(b"!a.log\n*.tmp\n/z/*\n")
    (top / ".git/info/exclude").write_bytes(b"excluded.me\n")
    (tmp_path / "above/.gitignore").write_bytes(b"*.bak\n")
    found = files.scan(spark, str(top), "tree", f"{tmp_path}/scratch")
    assert {os.path.relpath(r.path, top) for r in found.collect()} == {n for n, kept in TREE.items() if kept}
    read = {os.path.relpath(r.path, top): bytes(r.content) for r in files.contents(found).collect()}
    assert set(read.values()) == {b"x"} and set(read) == {n for n, kept in TREE.items() if kept}
    (top / "__init__.py").write_bytes(b"longer")
    with pytest.raises(Exception, match="INDEX_SCAN_CHANGED"):
        files.contents(found).collect()
    (top / "link").symlink_to(top / "a b.txt")
    with pytest.raises(Exception, match="INDEX_LINK_REFUSED"):
        files.scan(spark, str(top), "tree", f"{tmp_path}/scratch2").collect()
    with pytest.raises(EngineError, match="INDEX_SCAN_FAILED"):
        files.scan(spark, str(tmp_path / "none"), "tree", f"{tmp_path}/scratch3")


def test_absence_needs_every_file(spark, tmp_path):
    tree = tmp_path / "tree"
    tree.mkdir()
    (tree / "_under.txt").write_bytes(b"hidden needle")
    (tree / "a.txt").write_bytes(b"nothing")
    engine = Engine(spark, str(tmp_path / "root")).initialize()
    engine.index(str(tree))
    assert engine.exact("needle")["matches"] == 1
    (tree / "_under.txt").unlink()
    assert engine.index()["changed"] == 1 and engine.exact("needle")["complete_negative"]


def test_watch():
    said, results = [], iter([{"n": 1}, EngineError("X"), {"n": 2}])

    def run():
        r = next(results)
        if isinstance(r, Exception):
            raise r
        return r

    assert watch(run, 1, rounds=3, report=said.append, sleep=lambda s: None) == 0
    assert [s["ok"] for s in said] == [True, False, True] and said[1]["code"] == "X"


def test_entry_without_llm(monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    assert set(queries.ORACLE) <= set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    try:
        assert set(importlib.reload(__spark_entry__).queries()) == set(queries.QUERIES)
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)
