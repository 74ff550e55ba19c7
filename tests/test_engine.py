"""The engine from documents to answers, and the places for models."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from docloom.engine import Engine
from docloom.operators import chunking, compute, models

DOCS = [("hr/leave.md", "正式员工每年享有十个工作日的带薪年假。"), ("fin/travel.txt", "员工应在差旅结束后的三十个自然日内提交费用报销申请。"), ("it/security.txt", "办公系统密码每九十天必须更换一次。\n\n" + "plain words " * 200)]


def test_engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "ix"))
    e.build(spark.createDataFrame(DOCS, "source_path string, text string"))
    q = spark.createDataFrame([(1, "密码多久更换"), (2, "一共有几个文件"), (3, "qqqq")], "query_id int, query string")
    answers, sources = e.ask(q)
    got = {r.query_id: r for r in answers.collect()}
    assert got[1].answer.startswith("办公系统密码") and got[1]["mode"] == "local_fallback" and got[1].answer.splitlines()[0].endswith("[1]")
    assert got[2].answer == "共 3 个文件" and got[2].intent == "inventory_count" and got[3]["mode"] == "empty"
    assert sources.where("query_id = 1 AND rank = 1").first()["filename"] == "security.txt"
    assert e.diagnose().count() == 0
    new = [DOCS[0], (DOCS[1][0], DOCS[1][1] + "新"), ("new.txt", "新文件")]
    did = {r["path"]: r.action for r in e.sync(spark.createDataFrame(new, "source_path string, text string")).collect()}
    assert did["fin/travel.txt"] == "skipped" or did["fin/travel.txt"] == "updated"
    assert {r.filename for r in e.documents().collect()} == {"leave.md", "travel.txt", "new.txt"}
    e.delete(["NEW.txt"])
    assert e.documents().count() == 2
    with pytest.raises(ValueError):
        e.search(q, 0)
    plan, out = e.compute("", None, [compute.Sheet("a", "b", ("c",))])
    assert plan.clarify and out is None


def test_models(spark):
    df = spark.createDataFrame([(1, 1, "q", "aa"), (1, 2, "q", "a")], "query_id int, id int, query string, content string")
    with pytest.raises(models.OfflineError):
        models.embed(df, None, ["id"])
    assert {r.id: r.embedding for r in models.embed(df, lambda t: [[len(x), 1] for x in t], ["id"], batch=1).collect()} == {1: [2.0, 1.0], 2: [1.0, 1.0]}
    best = models.rerank(df, lambda q, t: [-len(x) for x in t], 1, ["id"]).collect()
    assert [r.id for r in best] == [2]
    h = spark.createDataFrame([("它呢", "h"), ("plain", "h")], "query string, history string")
    assert {r["query"] for r in models.rewrite(h, lambda q, h: [x + "!" for x in q]).collect()} == {"它呢!", "plain"}


def test_recursive_split(spark):
    rng = random.Random(1)
    text = "".join(rng.choice(["word ", "句子。", "line\n", "para\n\n", "x" * 30]) for _ in range(200))
    got = spark.createDataFrame([(text,)], "t string").select(chunking.recursive_split("t", 80, 10)).first()[0]
    assert all(0 < len(p) <= 80 for p in got) and set("".join(text.split())) == set("".join("".join(got).split()))
    assert spark.createDataFrame([(None,)], "t string").select(F.size(chunking.recursive_split("t"))).first()[0] == 0


def test_search_filters_and_fallback(spark, tmp_path):
    from docloom.engine import Engine

    e = Engine(spark, f"file://{tmp_path}/filtered")
    e.build(spark.createDataFrame([("a/travel.txt", "expense report within thirty days"), ("b/leave.txt", "annual leave of ten days")], "source_path string, text string"))
    q = spark.createDataFrame([(1, "days"), (2, "zzz"), (3, "leave.txt")], "query_id int, query string")
    hits = lambda **kw: {(r.query_id, r.filename) for r in e.search(q, 2, **kw).collect()}
    assert {(1, "travel.txt"), (1, "leave.txt"), (3, "leave.txt")} <= hits() and not any(q == 2 for q, _ in hits())
    assert {f for _, f in hits(source_paths=("A/TRAVEL.txt",))} == {"travel.txt"}
    assert hits(node_types=("table",)) == set()
    assert (2, "travel.txt") in hits(fallback=True) and (2, "leave.txt") in hits(fallback=True)


def test_vacuum_needs_a_pointer(spark, tmp_path):
    from docloom.operators.index import VersionedIndex

    v = VersionedIndex(spark, f"file://{tmp_path}/versions")
    one = v.commit({"t": spark.range(1)})
    two = v.commit({"t": spark.range(2)})
    assert v.version() == two != one and v.vacuum() == 1 and v.read("t").count() == 2
    v._fs.delete(v._path(f"{v.root}/CURRENT"), False)
    assert v.vacuum() == 0


def _files(root):
    return {p.relative_to(root): p.stat().st_mtime_ns for p in root.rglob("*.parquet")}


def test_sync_writes_changed_buckets_only(spark, tmp_path):
    root = tmp_path / "ix"
    e = Engine(spark, f"file://{root}", buckets=8)
    rows = [(f"d{i}.txt", f"document number {i} about topic{i}") for i in range(12)]
    frame = lambda r: spark.createDataFrame(r, "source_path string, text string")
    e.build(frame(rows))
    before, first = _files(root), e.store.version()
    assert {r.action for r in e.sync(frame(rows)).collect()} == {"skipped"}
    assert _files(root) == before and e.store.version() == first  # nothing changed: nothing is written
    held = e.store.manifest()["tables"]["documents"]["buckets"]
    new = [(p, "a changed text with zebra" if p == "d3.txt" else t) for p, t in rows if p != "d5.txt"] + [("extra.txt", "one more")]
    done = {r["path"]: r.action for r in e.sync(frame(new)).collect()}
    assert {p: a for p, a in done.items() if a != "skipped"} == {"d3.txt": "updated", "d5.txt": "removed", "extra.txt": "added"}
    now = e.store.manifest()["tables"]["documents"]["buckets"]
    assert {b for b in held if now.get(b) == held[b]}  # some buckets lie where they lay
    assert all(_files(root)[f] == t for f, t in before.items())
    assert {(r.source_path, r.text) for r in e.documents().collect()} == set(new) and e.diagnose().count() == 0
    whole = Engine(spark, f"file://{tmp_path}/whole", buckets=8)
    whole.build(frame(new))
    q = spark.createDataFrame([(1, "zebra"), (2, "topic9"), (3, "topic5")], "query_id int, query string")
    found = lambda x: sorted(map(tuple, x.search(q, 3).select("query_id", "filename", "score", "rank").collect()))
    assert found(e) == found(whole)  # same hits, scores and statistics as an index built at once
    e.delete(["EXTRA.txt"])
    e.store.vacuum()
    assert {r.source_path for r in e.documents().collect()} == {p for p, _ in new} - {"extra.txt"} and e.diagnose().count() == 0


def test_crash_before_the_pointer(spark, tmp_path, monkeypatch):
    e = Engine(spark, f"file://{tmp_path}/ix", buckets=4)
    frame = lambda r: spark.createDataFrame(r, "source_path string, text string")
    e.build(frame([("a.txt", "old words")]))
    monkeypatch.setattr(type(e.store), "_publish", lambda self, version: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        e.sync(frame([("a.txt", "new words")]))
    monkeypatch.undo()
    assert [r.text for r in e.documents().collect()] == ["old words"] and e.store.vacuum() == 1
    e.delete(["a.txt"])
    assert e.documents().count() == 0 and e.documents().columns
    assert {r.action for r in e.sync(frame([("a.txt", "new words")])).collect()} == {"added"}
    assert [r.text for r in e.documents().collect()] == ["new words"]
