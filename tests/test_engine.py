"""Search against an independent full-text engine, upserts, packs, lifecycle, files, table and tools."""

import json
import re
import sqlite3
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep import cli, tools
from lorekeep.api import MemoryStore
from lorekeep.operators import lifecycle, pack, search, segment, stats, upsert, verify
from lorekeep.operators.index import build_index, update_index
from lorekeep.plans.table import ConflictError, MemoryTable
from lorekeep.schema import INPUT, MEMORIES

NOW = datetime(2026, 4, 12, 20)


def now():
    return F.lit("2026-04-12 20:00:00").cast("timestamp")


NUMBERED = T.StructType([*INPUT.fields, T.StructField("seq", T.LongType())])


def remember(spark, memories, rows):
    """rows: dicts of input fields."""
    df = spark.createDataFrame([(*[r.get(n) for n in INPUT.fieldNames()], k) for k, r in enumerate(rows)], NUMBERED)
    return upsert.remember(memories, upsert.checked(df), now(), NOW)


def rows_of(df):
    return sorted((r.asDict(True) for r in df.collect()), key=lambda r: r["rowid"])


BASE = [
    {"scope": "p", "kind": "decision", "title": "Archive in Parquet", "content": "We agreed that the archive is kept in Parquet files for cheap scans.", "importance": 0.95, "certainty": 0.9, "tags": ["parquet"]},
    {"scope": "p", "kind": "note", "title": "Loose idea", "content": "Perhaps a sorted copy speeds the scans up one day.", "importance": 0.2},
    {"scope": "q", "kind": "decision", "title": "Elsewhere", "content": "Parquet scans in another team altogether.", "importance": 0.9},
    {"scope": "p", "kind": "constraint", "title": "Small images", "content": "Container images must stay small on a slow uplink.", "importance": 0.98},
]


@pytest.fixture(scope="module")
def base(spark):
    after, _ = remember(spark, spark.createDataFrame([], MEMORIES), BASE)
    rows = after.orderBy("rowid").collect()
    return spark.createDataFrame(rows, MEMORIES)


def test_inserts_are_numbered_in_order(base):
    got = rows_of(base)
    assert [r["rowid"] for r in got] == [1, 2, 3, 4]
    assert [r["title"] for r in got] == [b["title"] for b in BASE]


def test_bm25_equals_another_engine(spark, base):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(title, summary, content, tags_text, stems_text, tokenize='unicode61 remove_diacritics 2')")
    for r in rows_of(base):
        con.execute("insert into f(rowid, title, summary, content, tags_text, stems_text) values (?,?,?,?,?,?)", [r[c] for c in ("rowid", "title", "summary", "content", "tags_text", "stems_text")])
    for query in ("parquet scans cheap", "images uplink", "scan scans", "nothing here at all zzz"):
        terms = [t for t in query.split() if t not in ("at",)]
        want = {r[0]: r[1] for r in con.execute("select rowid, bm25(f, 5.0, 2.5, 1.0, 1.5) from f where f match ?", [" OR ".join(f"{t}*" for t in terms)])}
        q = spark.createDataFrame([(1, query)], "qid long, query string")
        got = {r.rowid: r.bm25 for r in search.match(search.prepare(q), build_index(base), base).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_search_branches(spark, base):
    q = spark.createDataFrame([(1, "parquet scans cheap", "p"), (2, "econd zz", None), (3, "rchiv", None), (4, "the", "p"), (5, None, None)], "qid long, query string, scope string")
    got = {}
    for r in search.search(q, base, now(), 3).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.title))
    assert got[1][0] == (1, "Archive in Parquet") and all(t != "Elsewhere" for _, t in got[1])
    assert 2 not in got
    assert got[3] == [(1, "Archive in Parquet")]
    assert got[4][0][1] == "Small images" and [t for _, t in got[5]] == ["Small images", "Archive in Parquet", "Elsewhere"]


def test_cross_prefix_recall(spark):
    rows = [{"scope": "s", "kind": "note", "title": f"t{i}", "content": c} for i, c in enumerate(["Заготовила звіт ранком", "Готовити план завтра", "Зовсім інше"])]
    m, _ = remember(spark, spark.createDataFrame([], MEMORIES), rows)
    q = spark.createDataFrame([(k, w) for k, w in enumerate(("готовити", "заготовила"))], "qid long, query string")
    for hits in [{r.title for r in search.search(q, m.cache(), now(), 5).where(f"qid = {k}").collect()} for k in range(2)]:
        assert hits == {"t0", "t1"}


def test_upsert_merges(spark, base):
    again = [
        {"scope": "P", "kind": "decision", "title": "ARCHIVE, in parquet!", "content": BASE[0]["content"], "tags": ["files"], "importance": 0.5, "source": "s2"},
        {"scope": "p", "kind": "note", "title": "Loose idea", "content": "Perhaps a sorted copy speeds the scans up one day, or never, who can tell.", "source": "s1"},
        {"scope": "p", "kind": "note", "title": "New", "content": "Something else altogether."},
        {"scope": "p", "kind": "note", "title": "New", "content": "Something else altogether."},
    ]
    after, report = remember(spark, base, again)
    assert [r.action for r in report.orderBy("seq").collect()] == ["updated", "updated", "created", "updated"]
    got = {r["rowid"]: r for r in rows_of(after)}
    assert len(got) == 5
    assert got[1]["tags"] == ["parquet", "files"] and got[1]["importance"] == 0.95 and got[1]["scope"] == "p" and abs(got[1]["certainty"] - 0.92) < 1e-9
    assert got[2]["content"].endswith("who can tell.") and got[2]["source"] == "s1"
    assert verify.drift(after).count() == 0


def test_remembering_brings_back_archived_only(spark, base):
    m = lifecycle.archive(base, base.where("rowid <= 2").select("id"), now())
    m = m.withColumn("superseded_by", F.when(F.col("rowid") == 2, F.lit("x")).otherwise(F.col("superseded_by")))
    after, _ = remember(spark, m, BASE[:2])
    got = rows_of(after)
    assert got[0]["archived_at"] is None and got[1]["archived_at"] is None and got[1]["superseded_by"] == "x"


def test_invalid_inputs(spark):
    df = spark.createDataFrame([("s", "wrong", "t", "c", 0.5), ("", "note", "t", "c", 0.5), ("s", "note", "t", "c", 2.0), ("s", "Note ", "t", "c", 0.5), (None, None, None, None, None)], "scope string, kind string, title string, content string, importance double")
    good, bad = upsert.validate(df)
    assert good.count() == 1 and bad.count() == 4 and all(r.problem for r in bad.collect())
    with pytest.raises(Exception, match="unknown kind|is empty|not between"):
        upsert.checked(df).collect()


def test_ingest_is_idempotent(spark):
    text = "- We agreed to keep the archive in Parquet.\n- Images must stay small and plain.\n- TODO: write the restore guide."
    t = spark.createDataFrame([(text, "p")], "text string, scope string")
    m, first = upsert.remember(spark.createDataFrame([], MEMORIES), segment.preview(t), now(), NOW)
    m = spark.createDataFrame(m.collect(), MEMORIES)
    m2, second = upsert.remember(m, segment.preview(t), now(), NOW)
    assert {r.action for r in first.collect()} == {"created"} and {r.action for r in second.collect()} == {"updated"} and m2.count() == 3


def test_packs(spark, base):
    twin = {"scope": "p", "kind": "note", "title": "Twin", "content": "Container images must stay small on a slow uplink today."}
    m, _ = remember(spark, base, [twin])
    m = spark.createDataFrame(m.collect(), MEMORIES)
    q = spark.createDataFrame([(1, "images uplink"), (2, "щось інше")], "qid long, query string")
    packs = {r.qid: r for r in pack.context_packs(q, m, now(), budget=2000)[0].collect()}
    assert len([i for i in packs[1]["items"] if i.title in ("Twin", "Small images")]) == 1
    assert "no direct match" in packs[2].rendered and len(packs[2]["items"]) > 0
    both = pack.context_packs(q.where("qid = 1"), m, now(), budget=2000, threshold=1.0)[0].first()
    assert {i.title for i in both["items"]} >= {"Twin", "Small images"}
    for budget in (60, 120, 220):
        p = pack.context_packs(q.where("qid = 1"), m, now(), budget=budget)[0].first()
        assert p.used_chars == len(p.rendered) <= budget and len(p["items"]) >= 1
    wake = pack.wake_up_packs(spark.createDataFrame([(1, None)], "qid long, scope string"), m, now(), 280, 3)[0].first()
    assert wake["items"][0].title == "Small images" and wake.rendered.startswith("Wake-up pack")


def test_lifecycle(spark, base):
    ids = {r["rowid"]: r["id"] for r in rows_of(base)}
    one = spark.createDataFrame([(ids[1],)], "id string")
    hidden = lifecycle.archive(base, one, now())
    assert stats.totals(hidden).first().asDict() == {"total": 4, "active": 3, "archived": 1}
    q = spark.createDataFrame([(1, "parquet")], "qid long, query string")
    assert ids[1] not in {r.id for r in search.search(q, hidden, now()).collect()}
    assert lifecycle.restore(hidden, one, now()).where("archived_at is not null").count() == 0
    pair = lambda a, b: spark.createDataFrame([(a, b)], "old_id string, new_id string")
    assert lifecycle.supersede(base, pair(ids[2], ids[1]), now()).where(F.col("superseded_by") == ids[1]).count() == 1
    for bad in (pair(ids[1], ids[1]), pair("nope", ids[1])):
        with pytest.raises(Exception, match="supersede itself|no such memory"):
            lifecycle.supersede(base, bad, now()).collect()
    assert {r.found for r in lifecycle.found(base, spark.createDataFrame([("nope",)], "id string")).collect()} == {False}


def test_decay(spark, base):
    old = base.withColumn("created_at", F.lit("2026-01-12 20:00:00").cast("timestamp")).withColumns({"importance": F.lit(0.5), "kind": F.when(F.col("rowid") == 2, "note").otherwise(F.col("kind"))})
    got = lifecycle.decay_candidates(old, now()).collect()
    assert [(r.rowid, r.retention, r.fades) for r in got] == [(2, 0.2875, True)]
    assert lifecycle.decay(old, now()).where("archived_at is not null").count() == 1
    log = spark.createDataFrame([(got[0].id, NOW)] * 3, "id string, at timestamp")
    assert lifecycle.fold_accesses(old, log).where("rowid = 2").first().access_count == 3


def test_index_follows_changes(spark, base):
    changed = base.withColumn("content", F.when(F.col("rowid") == 1, F.lit("entirely new words")).otherwise(F.col("content"))).where("rowid <> 2")
    fresh, kept = build_index(changed), update_index(build_index(base), changed, spark.createDataFrame([(1,), (2,)], "rowid long"))
    assert {tuple(r) for r in fresh.postings.select("rowid", "term", "weight", "dl").collect()} == {tuple(r) for r in kept.postings.select("rowid", "term", "weight", "dl").collect()}
    assert fresh.stats.first() == kept.stats.first()
    assert verify.verify(changed, fresh).first().healthy is True or verify.drift(changed).count() > 0
    assert verify.index_drift(changed, build_index(base)).collect()[0].rowid == 2


def test_migrations(spark, base):
    for version, missing in ((1, ["fingerprint", "stems_text", "archived_at", "superseded_by"]), (2, ["stems_text", "archived_at", "superseded_by"]), (3, ["archived_at", "superseded_by"])):
        assert verify.verify(verify.migrate(base.drop(*missing), version)).first().healthy


def test_store(spark, tmp_path):
    with MemoryStore(spark, str(tmp_path / "t"), clock=lambda: NOW) as s:
        made = s.remember(scope="p", kind="decision", title="Use Spark", content="We use Spark for everything here.")
        assert made["action"] == "created" and s.get(made["id"])["access_count"] == 0
        assert s.search("spark")[0]["id"] == made["id"]
        assert s.get(made["id"])["access_count"] == 1
        assert s.update(made["id"], title="Use Spark now")["title"] == "Use Spark now"
        with pytest.raises(KeyError):
            s.update("nope", title="x")
        path = str(tmp_path / "out.jsonl")
        s.export_jsonl(path)
        snapshot = json.loads(s.export_json())
        assert snapshot["count"] == 1 and snapshot["memories"][0]["title"] == "Use Spark now"
        (tmp_path / "one.json").write_text(json.dumps(snapshot), encoding="utf-8-sig")
        assert s.archive(made["id"]) and not s.archive("nope")
        assert s.import_file(path) == {"imported": 1, "created": 0, "updated": 1}
        assert s.import_file(str(tmp_path / "one.json"))["updated"] == 1
        assert s.get(made["id"])["archived_at"] is None
        assert s.verify()["healthy"] and s.stats()["total"] == 1
        with pytest.raises(ValueError):
            s.update(made["id"])
        old = s.remember(scope="p", kind="note", title="Faint", content="A faint memory of little weight.", importance=0.1)
        s.clock = lambda: datetime(2026, 8, 1)
        assert [r.id for r in s.decay().collect()] == [old["id"]] and s.get(old["id"])["archived_at"] is None
        assert [r.id for r in s.decay(dry_run=False).collect()] == [old["id"]] and s.get(old["id"])["archived_at"] is not None
        s.table.vacuum()
        assert s.stats()["total"] == 2
        assert s.delete(made["id"]) and not s.delete(made["id"])


def test_bad_import_time(spark, base):
    r = spark.createDataFrame([(0, "a", "s", "note", "t", "c", "yesterday")], "seq long, id string, scope string, kind string, title string, content string, created_at string")
    with pytest.raises(Exception, match="no timestamp"):
        upsert.import_memories(base, r, now())[0].collect()


def test_command_line(spark, tmp_path, capsys):
    t = ["--table", str(tmp_path / "c")]
    assert cli.main([*t, "remember", "--scope", "s", "--kind", "note", "--title", "T", "--content", "some content here", "--json"], spark) == 0
    made = json.loads(capsys.readouterr().out)
    assert cli.main([*t, "show", "--id", made["id"]], spark) == 0 and cli.main([*t, "show", "--id", "nope"], spark) == 1
    assert cli.main([*t, "verify"], spark) == 0 and cli.main([*t, "stats", "--since", "x"], spark) == 1
    assert cli.main(["completion", "bash"], spark) == 0 and "wake-up" in capsys.readouterr().out
    assert cli.parse_since("7d", NOW) == datetime(2026, 4, 5, 20)


# ---- the table is never lost


def test_a_crash_at_any_step_loses_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    with MemoryStore(spark, path, clock=lambda: NOW) as s:
        s.remember(scope="p", kind="note", title="Kept", content="This one stays whatever happens.")

    def failing(at):
        table = MemoryTable.open(spark, path)
        m = table.manifest()
        with monkeypatch.context() as patch:
            if at == "publish":
                patch.setattr(MemoryTable, "_publish", lambda *a: (_ for _ in ()).throw(OSError("crash")))
            elif at == "link":
                patch.setattr("lorekeep.plans.table.os.link", lambda *a: (_ for _ in ()).throw(OSError("crash")))
            after = table.current(m)
            if at == "write":
                after = after.withColumn("title", F.raise_error(F.lit("crash")))
            with pytest.raises(Exception, match="crash"):
                table.commit(after, m)

    for at in ("write", "publish", "link"):
        failing(at)
        with MemoryStore(spark, path, clock=lambda: NOW) as s:
            assert s.stats()["total"] == 1
    with MemoryStore(spark, path, clock=lambda: NOW) as s:
        s.remember(scope="p", kind="note", title="Later", content="A later one is added as usual.")
        s.table.vacuum(1)
        assert s.stats()["total"] == 2
    for f in (tmp_path / "t").glob("manifest-*"):
        f.unlink()
    with pytest.raises(RuntimeError, match="no manifest"):
        MemoryTable.open(spark, path)
    assert list((tmp_path / "t").glob("snapshot-*"))


def test_of_two_writers_one_fails(spark, tmp_path):
    one, two = (MemoryTable.open(spark, str(tmp_path / "t")) for _ in range(2))
    a, b = one.manifest(), two.manifest()
    rows, _ = remember(spark, one.current(a), BASE[:1])
    one.commit(rows, a)
    other, _ = remember(spark, two.current(b), BASE[1:3])
    with pytest.raises(ConflictError):
        two.commit(other, b)
    assert [r.title for r in two.memories().collect()] == ["Archive in Parquet"]
    assert len(list((tmp_path / "t").glob("snapshot-*"))) == 2


def test_recalls_during_a_change_are_kept(spark, tmp_path):
    table = MemoryTable.open(spark, str(tmp_path / "t"))
    m = table.manifest()
    table.commit(remember(spark, table.current(m), BASE[:1])[0], m)
    ids = table.memories().select("id")
    table.record_access(ids, now())
    m = table.manifest()
    before = table.current(m)
    table.record_access(ids, now())  # while a change is being made
    table.commit(before, m, new_log=True)
    assert table.memories().first().access_count == 1 and table.current().first().access_count == 2
    table.vacuum(1)
    table.compact()
    assert table.memories().first().access_count == 2 == table.current().first().access_count


def test_index_is_stored_and_follows_changes(spark, tmp_path, monkeypatch):
    table = MemoryTable.open(spark, str(tmp_path / "t"))
    m = table.manifest()
    table.commit(remember(spark, table.current(m), BASE[:3])[0], m)
    table.index()
    m = table.manifest()
    after = remember(spark, table.current(m), [BASE[3]])[0].withColumn("content", F.when(F.col("rowid") == 1, F.lit("other words")).otherwise(F.col("content"))).where("rowid <> 2")
    table.commit(after, m)
    want = build_index(table.memories())
    monkeypatch.setattr("lorekeep.plans.table.build_index", lambda *a: pytest.fail("the index is built anew"))
    got = MemoryTable.open(spark, str(tmp_path / "t")).index()
    rows = lambda i: {tuple(r) for r in i.postings.select("rowid", "term", "weight", "stems", "dl").collect()}
    assert rows(got) == rows(want) and got.stats.first() == want.stats.first()


# ---- upserts and imports


def test_titles_of_equal_canonical_forms_meet(spark):
    long = "the quarterly archive of the northern branch is written to two places every"
    rows = [{"scope": "s", "kind": "note", "title": t, "content": "Same text in both of them."} for t in (f"{long} night", f"The: quarterly archive, of the northern branch is written to two places (every) night!")]
    after, report = remember(spark, spark.createDataFrame([], MEMORIES), rows)
    assert [r.action for r in report.orderBy("seq").collect()] == ["created", "updated"] and after.count() == 1


def test_upsert_against_one_by_one(spark):
    """Many inputs at once equal the same inputs one after the other."""
    import random

    rnd = random.Random(4)
    words = [f"word{k}" for k in range(30)]
    rows = []
    for k in range(60):
        content = " ".join(rnd.sample(words, rnd.randrange(3, 9))) + "."
        rows.append({"scope": rnd.choice("ab"), "kind": "note", "title": rnd.choice(("First title", "Second title", "first title!")), "content": content, "tags": [rnd.choice(words)], "importance": rnd.random()})
    rows += rows[:10]
    empty = spark.createDataFrame([], MEMORIES)
    stored, _ = remember(spark, empty, rows[:20])
    stored = spark.createDataFrame(stored.collect(), MEMORIES)
    together, report = remember(spark, stored.repartition(5), rows[20:])
    from lorekeep.operators.upsert import _Fold

    fold = _Fold(NOW)
    for r in rows_of(stored):
        fold.add({**r, "seq": None, "action": None})
    given = spark.createDataFrame([(*[r.get(n) for n in INPUT.fieldNames()], k) for k, r in enumerate(rows[20:])], NUMBERED)
    fresh = upsert._derived(upsert.checked(given)).orderBy("seq").collect()
    for r in fresh:
        fold.add({**{c: None for c in MEMORIES.fieldNames()}, **r.asDict(True), "id": "x", "updated_at": NOW, "action": None})
    want = [(r["title"], r["content"], tuple(r["tags"]), r["importance"]) for r in fold.result() if r.get("action") is None]
    got = [(r["title"], r["content"], tuple(r["tags"]), r["importance"]) for r in rows_of(together)]
    assert got == want
    assert [r.action for r in report.orderBy("seq").collect()] == [r["action"] for r in fold.report]
    assert verify.drift(together).count() == 0


def test_stored_rows_without_fingerprints(spark, base):
    """They get theirs in the merge, whether it touches them or not, and meet as others do."""
    bare = base.withColumn("fingerprint", F.lit(None).cast("string"))
    again = {**BASE[0], "tags": ["again"]}
    near = {**BASE[3], "content": "Nothing alike is said here about anything."}
    got, report = remember(spark, bare, [again, near])
    want, _ = remember(spark, base, [again, near])
    assert rows_of(got) == rows_of(want) and [r.action for r in report.orderBy("seq").collect()] == ["updated", "created"]
    assert verify.drift(got).count() == 0


def test_rows_that_meet_but_stay_are_left_alone(spark, base):
    """A stored row that no input merges into keeps all its columns."""
    odd = base.withColumn("stems_text", F.lit("as it was"))
    got, _ = remember(spark, odd, [{**BASE[3], "content": "Nothing alike is said here about anything."}, {**BASE[1], "scope": "elsewhere"}])
    kept = [r for r in rows_of(got) if r["rowid"] <= 4]
    assert kept == rows_of(odd)


def test_broken_imports_fail(spark, tmp_path):
    with MemoryStore(spark, str(tmp_path / "t"), clock=lambda: NOW) as s:
        for name, text in (("a.json", '[{"scope": "s", "kind": "note"'), ("b.json", "no json"), ("c.jsonl", '{"scope": "s", "kind": "note", "title": "t", "content": "c c"}\n{"scope": ')):
            (tmp_path / name).write_text(text)
            with pytest.raises(Exception, match="no JSON"):
                s.import_file(str(tmp_path / name))
        assert s.stats()["total"] == 0 and s.table.manifest()["number"] == 1


def test_lines_are_imported_in_the_order_of_files_and_lines(spark, tmp_path):
    (tmp_path / "many.jsonl").mkdir()
    line = lambda k: json.dumps({"id": f"m{k % 3}", "scope": "s", "kind": "note", "title": f"t{k}", "content": "some text"})
    for part in range(5):  # later parts are shorter, and are packed together before earlier ones
        (tmp_path / "many.jsonl" / f"part-{part}.json").write_text("".join(line(part * 100 + k) + "\n" for k in range(60 - 10 * part)))
    with MemoryStore(spark, str(tmp_path / "t"), clock=lambda: NOW) as s:
        assert s.import_file(str(tmp_path / "many.jsonl"))["created"] == 3
        assert sorted(m["title"] for m in s.list()) == ["t417", "t418", "t419"]


# ---- phrases


def test_phrases_of_several_tokens_and_of_one_letter(spark):
    texts = ["the load_date column holds it", "load one date later", "load dates twice: load date and load date", "x marks it", "xylophones here"]
    m, _ = remember(spark, spark.createDataFrame([], MEMORIES), [{"scope": "s", "kind": "note", "title": f"t{k}", "content": c} for k, c in enumerate(texts)])
    m = spark.createDataFrame(m.collect(), MEMORIES)
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table f using fts5(title, summary, content, tags_text, stems_text, tokenize='unicode61 remove_diacritics 2')")
    for r in rows_of(m):
        con.execute("insert into f(rowid, title, summary, content, tags_text, stems_text) values (?,?,?,?,?,?)", [r[c] for c in ("rowid", "title", "summary", "content", "tags_text", "stems_text")])
    for query, asked in (("load_date", '"load date"*'), ("load_date marks", '"load date"* OR marks*')):
        want = {r[0]: r[1] for r in con.execute("select rowid, bm25(f, 5.0, 2.5, 1.0, 1.5) from f where f match ?", [asked])}
        got = {r.rowid: r.bm25 for r in search.match(search.prepare(spark.createDataFrame([(1, query)], "qid long, query string")), build_index(m), m).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    one = spark.createDataFrame([(1, [("x", False)])], "qid long, phrases array<struct<text:string,scoped:boolean>>")
    assert {r.rowid for r in search.match(one, build_index(m), m).collect()} == {4, 5}


# ---- agents and prompts


def test_protocol(spark, tmp_path):
    import io

    def talk(store, *messages):
        out = io.StringIO()
        tools.serve(store, [m if isinstance(m, str) else json.dumps({"jsonrpc": "2.0", **m}) for m in messages], out)
        return [json.loads(x) for x in out.getvalue().splitlines()]

    ask = lambda id, tool, **arguments: {"id": id, "method": "tools/call", "params": {"name": tool, "arguments": arguments}}
    with MemoryStore(spark, str(tmp_path / "t"), clock=lambda: NOW) as s:
        hello, listed, unknown, broken = talk(
            s, {"id": 0, "method": "initialize", "params": {"protocolVersion": "2025-03-26", "capabilities": {}}}, {"method": "notifications/initialized"}, {"id": 1, "method": "tools/list"}, {"id": 2, "method": "nope"}, "{"
        )
        assert hello["result"]["protocolVersion"] == "2025-03-26" and "tools" in hello["result"]["capabilities"]
        by_name = {t["name"]: t for t in listed["result"]["tools"]}
        assert len(by_name) == 8 and unknown["error"]["code"] == -32601 and broken["error"]["code"] == -32700
        assert {n for n, t in by_name.items() if t["annotations"]["readOnlyHint"]} == {"memory_search", "memory_build_context", "memory_wake_up", "memory_list", "memory_stats"}
        assert by_name["memory_remember"]["inputSchema"]["properties"]["scope"]["type"] == "string"
        texts = [
            (r["result"]["content"][0]["text"], r["result"]["isError"])
            for r in talk(
                s,
                ask(1, "memory_remember", scope="p", kind="note", title="Blue door", content="The blue door opens at nine."),
                ask(2, "memory_search", query="blue door", response_format="json"),
                ask(3, "memory_search", query="blue door", limit=99),
                ask(4, "memory_search", query="blue", colour="red"),
                ask(5, "memory_build_context", query="blue door", budget_chars=120),
                ask(6, "memory_list"),
                ask(7, "memory_stats", since="yesterday"),
                ask(8, "memory_forget", memory_id="nope"),
                ask(9, "memory_remember", scope="p", kind="rumour", title="x", content="y"),
            )
        ]
        assert json.loads(texts[0][0])["action"] == "created" and json.loads(texts[1][0])[0]["title"] == "Blue door"
        assert [wrong for _, wrong in texts] == [False, False, True, True, False, False, True, True, True]
        assert "limit must be between 1 and 50" in texts[2][0] and "unknown argument" in texts[3][0] and len(texts[4][0]) <= 120 and "Blue door" in texts[5][0]
        assert "since" in texts[6][0] and "no such memory" in texts[7][0] and "must be one of" in texts[8][0]


def test_ingest_by_dialogue(spark, tmp_path, capsys, monkeypatch):
    t = ["--table", str(tmp_path / "c"), "ingest", "--interactive"]

    def answers(*said):
        it = iter(said)

        def read(prompt=""):
            x = next(it)
            if x is EOFError:
                raise EOFError
            return x

        monkeypatch.setattr("builtins.input", read)

    answers("team.x", "call-3", "red blue", "- The lamp in the hall is broken.", "- TODO: order two new lamps.", EOFError, "n")
    assert cli.main(t, spark) == 0 and "Nothing was stored" in capsys.readouterr().out
    answers("team.x", "call-3", "red blue", "- The lamp in the hall is broken.", "- TODO: order two new lamps.", EOFError, "yes")
    assert cli.main(t, spark) == 0 and "2 stored: 2 new" in capsys.readouterr().out
    answers("")
    assert cli.main(t, spark) == 1 and "scope is required" in capsys.readouterr().err
    answers("s", "", "", EOFError)
    assert cli.main(t, spark) == 1 and cli.main([*t, "--text", "x"], spark) == 1
    with MemoryStore(spark, str(tmp_path / "c")) as s:
        assert s.stats()["total"] == 2 and all(set(m["tags"]) >= {"red", "blue"} for m in s.list())
    assert cli.main(["--table", str(tmp_path / "c"), "update", "--id", s.list()[0]["id"]], spark) == 1
    assert cli.main(["--table", str(tmp_path / "c"), "list"], spark) == 0 and "/team.x]" in capsys.readouterr().out
    assert cli.main(["--table", str(tmp_path / "c"), "verify"], spark) == 0 and "healthy, version" in capsys.readouterr().out


PHRASES = ["parquet scans", "s a_ p", "sort_copy", "archive_is kept_in", "of and", "zzz", "переказ порядку", "a_"]


def test_matching_texts_needs_no_index(spark, monkeypatch):
    rows = [*BASE, {"scope": "q", "kind": "fact", "title": "Порядок", "content": "Перекази про порядок ÀÉ sort_copy sort copy, a p"}, {"scope": "q", "kind": "fact", "title": "-", "content": "-"}]
    m, _ = remember(spark, spark.createDataFrame([], MEMORIES), rows)
    m = m.cache()
    asked = search.prepare(spark.createDataFrame(list(enumerate(PHRASES)), "qid long, query string"))
    bm25 = lambda df: {(r.qid, r.rowid): round(r.bm25, 9) for r in df.collect()}
    want = bm25(search.match(asked, build_index(m), m))
    assert len({q for q, _ in want}) >= 5
    monkeypatch.setattr(search, "build_index", None)
    hits = search.match_texts(asked, m)
    assert bm25(hits) == want
    # hits are grouped where their rows lie: the one exchange deals the rows, and is not of (rowid, qid)
    single = search.match_texts(search.prepare(spark.createDataFrame([(1, "parquet scans")], "qid long, query string")), m)
    assert single._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    only = m.where("rowid > 1").select("rowid")
    assert bm25(search.match_texts(asked, m, only)) == {k: v for k, v in want.items() if k[1] > 1}
    few = search._numbered(hits, [F.asc("bm25")], 2)
    assert "WindowGroupLimit" in few._jdf.queryExecution().executedPlan().toString()


def test_a_batch_of_many_words_gets_an_index(spark, monkeypatch):
    m, _ = remember(spark, spark.createDataFrame([], MEMORIES), BASE)
    asked = search.prepare(spark.createDataFrame([(1, "parquet scans")], "qid long, query string"))
    want = {(r.qid, r.rowid, r.bm25) for r in search.match(asked, build_index(m), m).collect()}
    monkeypatch.setattr(search, "NEEDLES", 1)
    assert want and {(r.qid, r.rowid, r.bm25) for r in search.match_texts(asked, m).collect()} == want


def test_search_shuffles_no_text(spark, monkeypatch):
    m, _ = remember(spark, spark.createDataFrame([], MEMORIES), BASE)
    m = spark.createDataFrame(m.collect(), m.schema)
    asked = spark.createDataFrame([(1, "parquet scans"), (2, "sorted copy")], "qid long, query string")
    want = [(r.qid, r.rank, r.rowid, r.score) for r in search.search(asked, m, now(), 3, build_index(m)).collect()]
    monkeypatch.setattr(search, "build_index", None)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pool = search.retrieve(search.prepare(asked), m, None, 3)
        plan = pool._jdf.queryExecution().sparkPlan().toString()
        found = search.search(asked, m, now(), 3)
        assert want and sorted((r.qid, r.rank, r.rowid, r.score) for r in found.collect()) == sorted(want)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # texts meet the pools by broadcast; the pools' rows alone are joined with the batch
    assert re.findall(r"SortMergeJoin \[(\w+)#", plan) == ["qid"] and "LeftSemi" in plan


def test_packs_need_no_index(spark, monkeypatch):
    m, _ = remember(spark, spark.createDataFrame([], MEMORIES), BASE)
    m = spark.createDataFrame(m.collect(), m.schema)
    asked = spark.createDataFrame([(1, "parquet scans"), (2, "sorted copy")], "qid long, query string")
    want = sorted(r.rendered for r in pack.context_packs(asked, m, now(), index=build_index(m))[0].collect())
    monkeypatch.setattr(search, "build_index", None)
    monkeypatch.setattr(pack, "build_index", None, raising=False)
    monkeypatch.setattr(pack, "search_hot", None)  # each query has hits
    assert sorted(r.rendered for r in pack.context_packs(asked, m, now())[0].collect()) == want
