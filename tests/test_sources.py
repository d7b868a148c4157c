from __future__ import annotations

import io
import json
import zipfile

import pytest

from factloom.sources import readers, sinks


def test_archives_expand(spark):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for name in ("a/b.txt", "__MACOSX/x.txt", "a/.hidden.txt", "pic.png", "c.md"):
            z.writestr(name, f"text of {name}")
    df = spark.createDataFrame([("up.zip", bytearray(buf.getvalue())), ("d.txt", bytearray(b"\xffplain "))], "filename string, content binary")
    got = {r.filename: (r.appears_at, r.text) for r in readers.texts(readers.expanded(df)).collect()}
    assert got == {"a__b.txt": ("upload://up.zip/a/b.txt", "text of a/b.txt"), "c.md": ("upload://up.zip/c.md", "text of c.md"), "d.txt": ("upload://d.txt", "plain ")}


def test_sitemaps_and_suites(spark, tmp_path):
    xml = spark.createDataFrame([("s", "<urlset><url><loc> https://x.com/a </loc></url><url><loc>https://x.com/b</loc></url></urlset>")], "source string, xml string")
    assert [r.url for r in readers.sitemap_urls(xml).collect()] == ["https://x.com/a", "https://x.com/b"]
    for name, suite, n in (("one", "s1", 1), ("two", "s2", 2), ("_skip", "s3", 3)):
        (tmp_path / f"{name}.json").write_text(json.dumps({"suite_id": suite, "agent_name": "A", "cases": [{"id": str(i), "question": "q"} for i in range(n)]}))
    assert {(r.suite_id, r.id) for r in readers.golden_cases(spark, str(tmp_path)).collect()} == {("s2", "0"), ("s2", "1")}
    with pytest.raises(readers.SourceNotConfiguredError):
        readers.connector("jira")


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], "k string, t int, v string")
    new = spark.createDataFrame([("a", 1, "n"), ("b", 4, "n"), ("c", 2, "n"), ("c", 1, "m")], "k string, t int, v string")
    assert sorted(map(tuple, sinks.upserted(old, new, ["k"], "t").select("k", "t", "v").collect())) == [("a", 1, "n"), ("b", 5, "y"), ("c", 2, "n")]
    assert sorted(map(tuple, sinks.inserted_if_absent(old, new, ["k"], "t").collect())) == [("a", 1, "x"), ("b", 5, "y"), ("c", 1, "m")]
    counters = sinks.merged_counters(spark.createDataFrame([("p", 1, 2)], "path_key string, wins long, losses long"), spark.createDataFrame([("p", True), ("q", False)], "path_key string, won boolean"))
    assert sorted(map(tuple, counters.collect())) == [("p", 2, 2), ("q", 0, 1)]
    sinks.append(old, str(tmp_path / "t"), ["k"])
    sinks.append(old, str(tmp_path / "t"), ["k"])
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4


def test_archives_tell_what_they_leave_out(spark, monkeypatch):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for name in ("a.txt", "b.txt", "c.txt", "pic.png", "__MACOSX/x.txt"):
            z.writestr(name, "text")
    df = spark.createDataFrame([("up.zip", bytearray(buf.getvalue()))], "filename string, content binary")
    monkeypatch.setattr(readers, "MAX_FILES", 2)
    assert {(r.member, r.reason) for r in readers.left_out(df).collect()} == {("c.txt", "count"), ("pic.png", "kind")}
    with pytest.raises(readers.NoFilesError):
        readers.landed(readers.expanded(df).where("false"))


def test_seeded_urls(spark):
    loc = lambda *urls: "".join(f"<url><loc>{u}</loc></url>" for u in urls)
    stored = [
        ("https://www.x.com/robots.txt", "User-agent: *\nSitemap: https://x.com/maps/main.xml\n"), ("https://x.com/maps/main.xml", loc("https://x.com/a?q=1", "https://other.com/b", "https://x.com/maps/more.xml")),
        ("https://x.com/maps/more.xml", loc("https://x.com/c#top", "https://x.com/a")), ("https://y.com/sitemap.xml", loc("https://y.com/only")), ("https://y.com/unlinked.xml", loc("https://y.com/hidden")),
    ]
    got = readers.seeded_urls(spark.createDataFrame(stored, "url string, text string"))
    assert sorted(map(tuple, got.collect())) == [("x.com", "https://x.com/a"), ("x.com", "https://x.com/c"), ("y.com", "https://y.com/only")]


def test_connectors_and_samples(spark, tmp_path):
    for name in ("b.md", "a.txt", "c.png"):
        (tmp_path / name).write_text(name)
    assert [(r.filename, bytes(r.content)) for r in readers.connector("sample")(spark, str(tmp_path)).collect()] == [("a.txt", b"a.txt"), ("b.md", b"b.md")]
    with pytest.raises(readers.SourceNotConfiguredError, match="isn't known"):
        readers.connector("nothing")


def test_office_files(spark):
    def packed(**parts: str) -> bytearray:
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w") as z:
            for name, xml in parts.items():
                z.writestr(name.replace("__", "/") + ".xml", xml)
        return bytearray(buf.getvalue())

    docx = packed(word__document="<w:document><w:p><w:r><w:t>One &amp; </w:t></w:r><w:r><w:t xml:space='preserve'>two</w:t></w:r></w:p><w:p></w:p><w:p><w:t>three</w:t></w:p></w:document>")
    slide = "<p:sp><p:txBody><a:p><a:r><a:t>{}</a:t></a:r></a:p><a:p><a:t>b</a:t></a:p></p:txBody></p:sp>"
    pptx = packed(ppt__slides__slide10=slide.format("ten"), ppt__slides__slide2=slide.format("two"))
    xlsx = packed(xl__workbook='<sheets><sheet name="A&amp;B" sheetId="1"/></sheets>', xl__sharedStrings="<sst><si><t>name</t></si><si><r><t>x</t></r><r><t>y</t></r></si></sst>", xl__worksheets__sheet1='<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>3</v></c></row><row r="2"><c r="A2"/></row><row r="3"><c r="A3" t="s"><v>1</v></c></row>')
    df = spark.createDataFrame([("a.docx", docx), ("b.pptx", pptx), ("c.xlsx", xlsx), ("d.docx", bytearray(b"broken")), ("e.txt", bytearray(b"text"))], "filename string, content binary")
    got = {r.filename: r.text for r in readers.office_texts(df).collect()}
    assert got == {"a.docx": "One & two\nthree", "b.pptx": "two\nb\n\nten\nb", "c.xlsx": "# Sheet A&B\nname | 3\nxy", "d.docx": None, "e.txt": None}
