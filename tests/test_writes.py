import io
import zipfile

import pytest
from pyspark.sql import functions as F

from folia.operators import diff, writer
from folia.operators.index import chunk_lines
from folia.sources import readers, store


def events(spark, rows):
    return spark.createDataFrame(rows, "event_id string, title string, language string, date string, location string")


def test_batches_are_all_or_nothing(spark):
    e = events(spark, [("1", "Day ~ 01", "English", None, None), ("2", "Day ~ 02", "en", None, None)])
    cols = "action string, title string, language string, date string, location string"
    good = spark.createDataFrame([("add", "Day ~ 03", "English", "1970", None), ("modify", "day – 01", "en", "1971", None), ("delete", "Day ~ 02", "English", None, None)], cols)
    planned = writer.plan_batch(e, good)
    after, report = writer.apply_batch(e, planned)
    assert {(r.title, r.date) for r in after.collect()} == {("Day ~ 03", "1970"), ("Day ~ 01", "1971")}  # a modified document keeps its title
    assert all(r.ok for r in report.collect())
    bad = good.unionByName(spark.createDataFrame([("delete", "Absent", "English", None, None)], cols))
    after, report = writer.apply_batch(e, writer.plan_batch(e, bad))
    assert after.count() == 2 and {(r.action, r.ok) for r in report.collect()} >= {("delete", False)}
    after, _ = writer.apply_batch(e, planned, dry_run=True)
    assert after.count() == 2


def test_patch_and_tags(spark):
    e = events(spark, [("1", "Day ~ 01", "English", None, None)])
    assert writer.patch(e, "1", {"location": "Pune"}).first().location == "Pune"
    with pytest.raises(ValueError):
        writer.patch(e, "1", {"event_id": "2"})
    tags = spark.createDataFrame([("1", "old"), ("2", "kept")], "event_id string, tag string")
    assert {tuple(r) for r in writer.set_tags(tags, "1", [" New ", "", "new"]).collect()} == {("1", "new"), ("2", "kept")}


def test_imputation(spark):
    e = events(spark, [("1", "S ~ 1", "en", "1970-01-02", "X"), ("2", "S ~ 2", "en", None, None), ("3", "T ~ 1", "en", "1975", None), ("4", "U ~ 1", "en", None, ""), ("5", "P one ~ 1", "en", "1990", None)])
    bounds = ((1972, "early"), (None, "late"))
    assert {r.event_id: r.location for r in writer.impute_locations(e, (("P", "Somewhere"),), bounds).collect()} == {"1": "X", "2": "X", "3": "late", "4": None, "5": "Somewhere"}
    assert {r.event_id: r.date for r in writer.impute_dates(e).collect()}["2"] == "1970-01-01"


def test_diff(spark):
    def snap(rows):
        docs = spark.createDataFrame(rows, "event_id string, title string, language string, date string, text string")
        return diff.keyed(docs, chunk_lines(docs, "event_id"))

    old = snap([("1", "A", "en", "1970", "x\ny"), ("2", "B", "en", None, "x"), ("3", "C", "en", None, "x")])
    new = snap([("1", "A ", "en", "1971", "x\ny\nz"), ("2", "B", "en", None, "x"), ("4", "D", "en", None, "q")])
    got = {r.title: (r.status, r.notes) for r in diff.diff(old, new).collect()}
    assert got == {"A": ("MODIFIED", "date, paragraphs 2 to 3"), "B": ("UNCHANGED", ""), "C": ("REMOVED", ""), "D": ("ADDED", "")}


def test_headers(spark):
    lines = [("f", i, t, None) for i, t in enumerate(["@title=Day ~ 01", "@Language=EN", "", "@eventText= opening", "@not a field", "rest"])] + [("g", 0, "body only", "style - Main Talking"), ("h", 0, "@title=T", None)]
    heads, body = readers.header_and_body(spark.createDataFrame(lines, "path string, pos int, text string, style string"))
    assert {r.path: r.fields for r in heads.collect()} == {"f": {"title": "Day ~ 01", "language": "EN"}, "h": {"title": "T"}}
    assert [(r.path, r.sequence_number, r.content, r.role) for r in body.orderBy("path", "sequence_number").collect()] == [("f", 1, "opening", None), ("f", 2, "@not a field", None), ("f", 3, "rest", None), ("g", 1, "body only", "main_talking")]
    assert {r.path: r.error for r in readers.document_errors(heads, body).collect()} == {"f": None, "g": "missing title", "h": "no body"}


def test_word_files(spark, tmp_path):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f'<w:document {ns}><w:body><w:p><w:pPr><w:pStyle w:val="S1"/></w:pPr><w:r><w:t>Hello</w:t><w:tab/><w:t>there</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>End</w:t></w:r></w:p></w:body></w:document>')
        z.writestr("word/styles.xml", f'<w:styles {ns}><w:style w:styleId="S1"><w:name w:val="style - Main Talking"/></w:style></w:styles>')
    for name, data in (("Add/a.docx", buffer.getvalue()), ("Add/~$a.docx", b"lock"), ("Delete/b.docx", b"broken")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    rows = readers.batch_actions(readers.read_word_files(spark, str(tmp_path))).orderBy("pos").collect()
    assert [(r.action, r.text, r.style) for r in rows] == [("add", "Hello\tthere", "style - Main Talking"), ("add", "End", None)]


def test_archives_of_word_files(spark, tmp_path):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p></w:body></w:document>")
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for name, data in (("Add/a.docx", inner.getvalue()), ("Modify/b.docx", b"broken"), ("__MACOSX/Add/a.docx", b"x"), ("Add/~$a.docx", b"x"), ("more.zip", b"x")):
            z.writestr(name, data)
    (tmp_path / "bad.zip").write_bytes(b"nothing")
    with zipfile.ZipFile(tmp_path / "none.zip", "w") as z:
        z.writestr("readme.txt", "x")
    rows = readers.read_word_archives(spark, str(tmp_path)).collect()
    got = {r.path.split("/", 3)[-1].rsplit("/", 1)[-1] if "!" not in r.path else r.path[r.path.index("!") :]: (r.pos, r.text, r.error) for r in rows}
    assert got == {"!/Add/a.docx": (0, "Hello", None), "!/Modify/b.docx": (None, None, "unreadable"), "!/more.zip": (None, None, "an archive inside an archive"), "bad.zip": (None, None, "not an archive"), "none.zip": (None, None, "empty archive")}
    assert [r.action for r in readers.batch_actions(readers.read_word_archives(spark, str(tmp_path)).where("error IS NULL")).collect()] == ["add"]


def test_csv_and_json(spark, tmp_path):
    (tmp_path / "d.csv").write_text('id,title,time,language,eventText\n1,A,1970,en,"place: Pune\nfirst\x0bsecond"\n,B,1971,en,skipped\n1,C,1972,en,more\n')
    e, p = readers.read_csv_dump(spark, str(tmp_path / "d.csv"))
    assert [(r.title, r.location) for r in e.collect()] == [("A", "Pune")]
    assert sorted(r.content for r in p.collect()) == ["first", "more", "place: Pune", "second"]
    docs = spark.createDataFrame([("T", "en", "x" * 30 + "\n\n" + "y" * 30), ("U", "en", "no")], "title string, language string, content string")
    good, paras, bad = readers.ingest_json(docs)
    assert good.count() == 1 and [r.sequence_number for r in paras.orderBy("sequence_number").collect()] == [1, 2] and bad.first().title == "U"


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    assert s.version() == 0 and s.read("events", store.EVENTS).count() == 0
    first = spark.createDataFrame([("1", "A")], "event_id string, title string")
    assert s.publish({"events": first}, 0) == 1
    assert s.read("events", store.EVENTS).columns == store.EVENTS.fieldNames()  # an older table gains columns
    with pytest.raises(store.Busy):
        s.publish({"events": first}, 0)
    assert s.publish({"events": first.union(first)}, 1) == 2 and s.read("events").count() == 2 and s.read("events", version=1).count() == 1
    copy = s.copy_to(str(tmp_path / "t"))
    assert copy.manifest() == s.manifest()
    with pytest.raises(FileExistsError):
        s.copy_to(str(tmp_path / "t"))


def test_stream(spark, tmp_path):
    from folia.streaming.incremental import index_stream, read_stream

    docs = spark.createDataFrame([(1, "one two"), (2, "two")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    q = index_stream(read_stream(spark, str(tmp_path / "in"), docs), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.where(F.col("term") == "two").count() == 2


def test_header_events(spark):
    rows = [("a_LHI.docx", {"title": "T", "translatedfrom": "en", "sourceshort": "B"}), ("b.docx", {"title": "U", "language": "french", "translatedfrom": "none", "sourceshort": "B"}), ("c.docx", {"title": " "})]
    got = {r.path: tuple(r)[1:] for r in readers.header_events(spark.createDataFrame(rows, "path string, fields map<string,string>")).collect()}
    assert got == {"a_LHI.docx": ("T", None, "Hindi", "English", "B"), "b.docx": ("U", None, "French", "none", None), "c.docx": (None, None, "Unknown", None, None)}


def whole(spark):
    return {
        "events": events(spark, [("1", "Day ~ 01", "English", None, None), ("2", "Day ~ 02", "en", None, None)]),
        "paragraphs": spark.createDataFrame([("1", 1, "old river", "r"), ("1", 2, "older", None), ("2", 1, "gone stone", None)], "event_id string, sequence_number int, content string, role string"),
        "tags": spark.createDataFrame([("1", "kept"), ("2", "lost")], "event_id string, tag string"),
    }


def test_batches_write_whole_documents(spark, tmp_path):
    tables = whole(spark)
    cols = "action string, title string, language string, date string, location string, paragraphs array<struct<content:string,role:string>>"
    batch = spark.createDataFrame([("add", "Day ~ 03", "English", "1970", None, [("third", "x")]), ("modify", "day – 01", "en", "1971", None, [("new cloud", None), ("second", "y")]), ("delete", "Day ~ 02", "English", None, None, [])], cols)
    after, _ = writer.apply_documents(tables, writer.plan_batch(tables["events"], batch))
    ids = {r.title: r.event_id for r in after["events"].collect()}
    assert set(ids) == {"Day ~ 01", "Day ~ 03"} and ids["Day ~ 01"] == "1"
    assert {tuple(r) for r in after["paragraphs"].collect()} == {("1", 1, "new cloud", None), ("1", 2, "second", "y"), (ids["Day ~ 03"], 1, "third", "x")}
    assert {tuple(r) for r in after["tags"].collect()} == {("1", "kept")}
    from folia.archive import Archive

    e = after["events"].withColumn("translated_from", F.lit(None).cast("string"))
    a = Archive(e, after["paragraphs"], after["tags"])
    a.reindex(str(tmp_path / "i"))
    assert [r.event_id for r in a.search("cloud").collect()] == ["1"] and not a.search("stone").collect() and not a.search("old").collect()
    bad = batch.unionByName(spark.createDataFrame([("delete", "Absent", "English", None, None, [])], cols))
    same, _ = writer.apply_documents(tables, writer.plan_batch(tables["events"], bad))
    assert same is tables


def test_bulk_ingest_goes_as_far_as_it_can(spark):
    tables = whole(spark)
    batch = spark.createDataFrame([("Day ~ 02", "en", None, None, ["fresh"]), (" ", "en", None, None, ["x"]), ("New", "en", None, None, []), ("New two", "en", None, None, ["a", "b"])], "title string, language string, date string, location string, paragraphs array<string>")
    after, report = writer.ingest_best_effort(tables, batch)
    assert {(r.title, r.error) for r in report.collect()} == {("Day ~ 02", None), (" ", "missing title"), ("New", "no body"), ("New two", None)}
    assert after["events"].count() == 3 and {r.content for r in after["paragraphs"].where("event_id <> '1'").collect()} == {"fresh", "a", "b"}


def test_a_writer_that_dies_leaves_the_version_before(spark, tmp_path, monkeypatch):
    s = store.Store(spark, str(tmp_path / "s"))
    df = spark.createDataFrame([("1", "A")], "event_id string, title string")
    s.publish({"events": df}, 0)

    def die(*_):
        raise SystemExit

    with monkeypatch.context() as m:
        m.setattr(store.Store, "_commit", die)
        m.setattr(store.Store, "publish", lambda self, t, base: (t["events"].write.parquet(f"{self.path}/data/dead/events"), die()))
        with pytest.raises(SystemExit):
            s.publish({"events": df}, 1)
    (tmp_path / "s" / "commits" / "00000002").touch()  # died between creating and writing its commit
    assert s.version() == 1 and s.read("events").count() == 1
    with pytest.raises(store.Busy):
        s.publish({"events": df}, 1)
    assert s.sweep() >= 2 and s.publish({"events": df.union(df)}, 1) == 2 and s.read("events").count() == 2


def test_two_writers_of_one_version(spark, tmp_path):
    a, b = (store.Store(spark, str(tmp_path / "s")) for _ in range(2))
    df = spark.createDataFrame([("1", "A")], "event_id string, title string")
    a.publish({"events": df}, 0)
    with pytest.raises(store.Busy):
        b._commit(1, "other")
    assert a.read("events").count() == 1


def test_reports_are_never_cut(spark):
    assert store.dumps(spark.range(3)) == '[{"id": 0}, {"id": 1}, {"id": 2}]'
    with pytest.raises(ValueError):
        store.dumps(spark.range(1001))


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace as N

    from folia.shipping import shared_dir

    session = lambda master, path=None: N(conf=N(get=lambda *_: path), sparkContext=N(master=master, applicationId="app-1"))
    assert shared_dir(session("yarn", "hdfs:/x/")) == "hdfs:/x"
    assert shared_dir(session("local[4]")) == shared_dir(session("local[4]"))
    with pytest.raises(ValueError):
        shared_dir(session("spark://host:7077"))
