import io
import zipfile

import duckdb
import pytest

from weftline.plans.chunking import ORACLE_SQL, QUERIES
from weftline.sources import corpus
from weftline.sources.markup import book_parts, books
from weftline.sources.paged import PagedSource
from weftline.sources.text import text_files


def lit(i, text="一段足够长的文字在这里", **more):
    import json

    return json.dumps({"chunk_id": f"lit:{i}", "book": "《红楼梦》", "character": "黛玉", "imagery": "落花", "emotion": ["哀伤"], "text": text} | more, ensure_ascii=False)


def test_corpus(spark, tmp_path):
    p = tmp_path / "literature.jsonl"
    p.write_text("// 注释\n\n" + lit(1) + "\n" + lit(2, imagery=["月", "水"]) + "\n")
    rows = {r["chunk_id"]: r for r in corpus.load(spark, {"literature": str(p)}).collect()}
    assert rows["lit:1"]["imagery"] == ["落花"] and rows["lit:2"]["imagery"] == ["月", "水"] and rows["lit:1"]["work"] == "红楼梦"


@pytest.mark.parametrize(("bad", "what"), [("{x", "no JSON object"), (lit(3, book=""), "missing book"), (lit(3, text="短"), "text is too short"), (lit(1), "not unique"), ('{"chunk_id": 1}', "missing")])
def test_corpus_errors_tell_the_line(spark, tmp_path, bad, what):
    p = tmp_path / "literature.jsonl"
    p.write_text(lit(1) + "\n\n" + bad + "\n")
    with pytest.raises(ValueError, match=what) as e:
        corpus.load(spark, {"literature": str(p)})
    assert "literature.jsonl:3" in str(e.value) or "literature.jsonl:1 " in str(e.value)


def test_edges(spark, tmp_path):
    p = tmp_path / "e.jsonl"
    p.write_text('{"source":"落花","source_type":"Imagery","target":"哀伤","target_type":"Emotion","relation":"ASSOCIATED_WITH"}\n{"source":"a","source_type":"X","target":"b","target_type":"Emotion","relation":"CO_OCCURS","weight":0.5}\n')
    rows = corpus.edges(corpus.numbered_lines(spark, str(p))).orderBy("line").collect()
    assert rows[0]["error"] is None and rows[0]["weight"] == 1.0 and "unknown node type" in rows[1]["error"]


def book():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/b.opf"/></rootfiles></container>')
        items = {"c": "cover.xhtml", "two": "b%20two.xhtml", "one": "a.xhtml", "n": "notes.xhtml"}
        z.writestr("O/b.opf", "<package><manifest>" + "".join(f'<item id="{k}" href="{v}"/>' for k, v in items.items()) + '</manifest><spine><itemref idref="c"/><itemref idref="one"/><itemref idref="two"/><itemref idref="n" linear="no"/></spine></package>')
        for name, text in (("cover", "C"), ("b two", "Second &amp; last"), ("a", "First<br/>line"), ("notes", "N")):
            z.writestr(f"O/{name}.xhtml", f"<html><head><title>t</title></head><body><p>{text}</p></body></html>")
    return out.getvalue()


def test_book(spark, tmp_path):
    assert [t for _, _, t in book_parts(book())] == ["First\nline", "Second & last"]
    (tmp_path / "b.epub").write_bytes(book())
    (tmp_path / "t.txt").write_bytes("中文".encode("gb18030"))
    assert [r["position"] for r in books(spark, str(tmp_path)).orderBy("position").collect()] == [0, 1]
    files = {r["path"][-5:]: r for r in text_files(spark, str(tmp_path)).collect()}
    assert files["t.txt"]["text"] == "中文" and not files["t.txt"]["is_zip"] and files[".epub"]["is_zip"]


def pages(id_, cursor, count):
    if id_ == "broken" and cursor:
        raise OSError("gone")
    items = [{"comment_id": i, "text": f"t{i}" if i % 7 else "", "like_count": i} for i in range(cursor, min(cursor + count, 45))]
    return {"items": items, "next_cursor": cursor + count, "has_more": cursor + count < 45}


def test_paged(spark):
    spark.dataSource.register(PagedSource)
    df = spark.read.format("paged").option("provider", "tests.test_sources:pages").option("ids", "a,broken").load()
    n = {r["id"]: r["count"] for r in df.groupBy("id").count().collect()}
    assert n == {"a": 45 - 7, "broken": 20 - 3}
    assert spark.read.format("paged").option("provider", "tests.test_sources:pages").option("ids", "a").option("limit", "5").load().count() == 5


def made(parts, decode=str.encode):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="b.opf"/></rootfiles></container>')
        items = "".join(f'<item id="i{k}" href="{n}.xhtml"/>' for k, n in enumerate(parts))
        z.writestr("b.opf", f"<package><manifest>{items}</manifest><spine>{''.join(f'<itemref idref=\"i{k}\"/>' for k in range(len(parts)))}</spine></package>")
        for n in parts:
            z.writestr(f"{n}.xhtml", decode(f"<p>{n}之文</p>"))
    return out.getvalue()


def test_book_names_and_encodings():
    names = ["cover", "Cover-Image", "toc_2", "nav", "titlepage", "copyright", "coverage", "discovery", "navy", "protocol", "titles"]
    assert [t for _, _, t in book_parts(made(names))] == [f"{n}之文" for n in names[6:]]
    assert [t for _, _, t in book_parts(made(["a"], lambda s: s.encode("gb18030")))] == ["a之文"]
    with pytest.raises(ValueError, match="encoding"):
        list(book_parts(made(["a"], lambda s: s.encode("utf-16") + b"\xff")))
    with pytest.raises(ValueError, match="parts"):
        list(book_parts(made([f"p{k}" for k in range(2001)])))


def named(id_, cursor, count):
    if id_ == "down":
        raise OSError("down")
    return {"items": [{"id": cursor, "body": {"text": f"t{cursor}"}, "stats": {"likes": 3}}], "page": {"cursor": cursor + 1}, "has_more": cursor < 4}


def test_paged_fields_and_failures(spark):
    spark.dataSource.register(PagedSource)
    fields = '{"comment_id": "id", "text": "body.text", "like_count": "stats.likes"}'
    read = spark.read.format("paged").option("provider", "tests.test_sources:named").option("fields", fields)
    assert [(r["comment_id"], r["text"], r["like_count"], r["cut_short"]) for r in read.option("ids", "a").load().orderBy("comment_id").collect()] == [(str(k), f"t{k}", 3, False) for k in range(5)]
    with pytest.raises(Exception, match="down"):
        read.option("ids", "down").load().collect()
    cut = spark.read.format("paged").option("provider", "tests.test_sources:pages").option("ids", "broken").load().collect()
    assert cut and all(r["cut_short"] for r in cut)


def grown(path, cursor, count):
    """A source that grows: its rows are the lines of the file that is its id."""
    with open(path) as f:
        lines = f.read().splitlines()
    return {"items": [{"comment_id": k, "text": lines[k]} for k in range(cursor, min(len(lines), cursor + count))], "has_more": cursor + count < len(lines), "cursor": cursor + count}


def length(path):
    with open(path) as f:
        return len(f.read().splitlines())


def test_paged_stream_goes_on_at_its_cursors(spark, tmp_path):
    spark.dataSource.register(PagedSource)
    paths = [tmp_path / x for x in ("one", "two")]
    sizes = [(450, 0), (450, 7), (501, 7)]
    for n in sizes:
        for p, k in zip(paths, n):
            p.write_text("".join(f"line {x}\n" if x % 50 else " \n" for x in range(k)))
        stream = spark.readStream.format("paged").option("provider", "tests.test_sources:grown").option("ends", "tests.test_sources:length").option("ids", ",".join(map(str, paths))).load()
        stream.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/progress").trigger(availableNow=True).start().awaitTermination()
        got = sorted((r["id"], int(r["comment_id"])) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
        assert got == sorted((str(p), x) for p, k in zip(paths, n) for x in range(k) if x % 50)
    with pytest.raises(Exception, match="ends"):
        spark.readStream.format("paged").option("provider", "tests.test_sources:grown").option("ids", "a").load().writeStream.format("noop").option("checkpointLocation", f"file://{tmp_path}/p2").trigger(availableNow=True).start().awaitTermination()


def test_a_filter_does_not_stay_with_the_source(spark, tmp_path):
    spark.dataSource.register(PagedSource)
    for name in ("one", "two"):
        (tmp_path / name).write_text("a\nb\n")
    df = spark.read.format("paged").option("provider", "tests.test_sources:grown").option("ids", f"{tmp_path}/one,{tmp_path}/two").load()
    assert [df.count(), df.filter(df["id"] == f"{tmp_path}/one").count(), df.count()] == [4, 2, 4]
    assert spark.read.format("paged").option("provider", "tests.test_sources:grown").option("ids", "").load().count() == 0


def test_references_without_their_semicolon(spark, tmp_path):
    """The SQL of html_blocks decodes them where the query does: before a tag as well as at the end."""
    pages = [(1, "<h1>a&amp;&amp</h1><p>b &am</p>c&amp"), (2, "<p>&amp;lt; &copy 1 &ampx</p>"), (3, None)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in QUERIES["html_blocks"](spark, str(tmp_path)).collect())
    with duckdb.connect() as c:
        c.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
        assert sorted(c.execute(ORACLE_SQL["html_blocks"]).fetchall()) == got
