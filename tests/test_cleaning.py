import unicodedata

from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import comments as C
from weftline.plans import cleaning as P
from weftline.sources.text import split_items


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "text string").select(f(F.col("text")).alias("x")).first()["x"]


def test_normalise(spark):
    assert one(spark, "太好看了！", lambda c: T.normalise(c, compose=True)) == "太好看了!"
    assert one(spark, " a​ \n b ", T.normalise) == "a b"
    assert one(spark, None, T.normalise) == ""


def test_fingerprint_ignores_marks_and_emoji(spark):
    same = {one(spark, t, lambda c: T.fingerprint(T.normalise(c, True))) for t in ("太好看了！！", "太好看了😭😭", "太好看了", "@张三 太好看了 https://a.b/c")}
    assert len(same) == 1


def test_flags(spark):
    rows = [("加V情感疗愈",), ("私我领取",), ("哈哈哈哈哈哈哈哈哈哈哈哈",), ("aaaaaaaaaaaa",), ("😭😭",), ("",), (None,), ("我月入5000",), ("好",), ("看 http://a.cn",), ("电话12345678号",), ("12345678",)]
    got = [r["filter_reason"] for r in C.flagged(spark.createDataFrame(rows, "text string")).collect()]
    assert got == ["ad", "ad", None, "spam", "empty", "empty", "empty", None, None, "ad", "ad", None]


def test_duplicates_keep_the_most_liked_and_ads_do_not_count(spark):
    rows = [(1, "一样的话", 10), (2, "一样的话！", 99), (3, "一样的话", 1), (4, "加V领取", 5), (5, "加V领取", 5), (6, "一样的话", 99)]
    told = C.marked_duplicates(C.flagged(spark.createDataFrame(rows, "id int, text string, likes int"), compose=True), "likes", "id")
    assert {r["id"] for r in told.filter("is_duplicate").collect()} == {1, 3, 6}
    t = C.tally(told).first()
    assert (t["total"], t["kept"], t["ads"], t["duplicates"], t["spam"], t["empty"]) == (6, 1, 2, 3, 0, 0)


def test_tally_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "id int, text string, likes int")
    assert C.tally(C.marked_duplicates(C.flagged(empty), "likes", "id")).first()["total"] == 0


def test_split(spark):
    df = spark.createDataFrame([(1, "  第一条  \n\n第二条\n   \n第三条\n"), (2, None), (3, "a\r\nb\rc")], "id int, text string")
    got = [(r["id"], r["item_id"], r["body"]) for r in split_items(df, "id", "text", "line", 2).collect()]
    assert got == [(1, "txt-0001", "第一条"), (1, "txt-0002", "第二条"), (3, "txt-0001", "a"), (3, "txt-0002", "b")]


def test_coercion(spark):
    assert one(spark, "true", T.to_long) is None
    assert one(spark, "12", T.to_long) == 12
    assert one(spark, "1700000000", lambda c: F.unix_seconds(T.to_time(c))) == one(spark, "1700000000000", lambda c: F.unix_seconds(T.to_time(c))) == 1700000000
    assert one(spark, "..\\x/a<b>.txt", T.safe_filename) == "ab.txt"


def test_cleaning_queries_compose(spark, tmp_path):
    """Full-width and ligature forms are the plain ones in every query of cleaning, as in plain Python."""
    texts = ["我也是 abc 123", "我也是　ＡＢＣ １２３".lower(), "ﬁne office", "fine oﬃce", "加ｖｘ：ａｂｃ１２３４５", "ｗｗｗ．example.com 好看", "打电话１３８１２３４５６７８", "看看"]
    spark.createDataFrame([(i, t, len(texts) - i) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    flags = {r["doc_id"]: r for r in P.clean_flags(spark, str(tmp_path)).collect()}
    plain = spark.createDataFrame([(i, unicodedata.normalize("NFKC", t)) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in C.flagged(plain, compose=False).collect():
        assert (flags[r["doc_id"]]["reason"], flags[r["doc_id"]]["dedup_key"]) == (r["filter_reason"], r["dedup_key"])
    assert {i for i in flags if flags[i]["reason"] == "ad"} == {4, 5, 6}
    assert {r["doc_id"] for r in P.mark_duplicates(spark, str(tmp_path)).collect() if r["is_duplicate"]} == {1, 3}
    assert P.clean_tally(spark, str(tmp_path)).first().asDict() == {"total": 8, "kept": 3, "ads": 3, "spam": 0, "duplicates": 2, "empty": 0}
    assert {r["reason"]: r["n"] for r in P.clean_reasons(spark, str(tmp_path)).collect()} == {"ad": 3, "duplicate": 2}
    assert {r["doc_id"]: r["length"] for r in P.visible_comments(spark, str(tmp_path)).collect()} == {0: 11, 2: 11, 7: 2}


def test_ads_with_digits_of_any_script(spark):
    """Digits of all scripts count in the strong rules, as they do in the others."""
    ads = ["q\u0661\u0662\u0663\u0664\u0665\u0666", "Q Q: 123456", "1\u30003\u0668", "13\u0661\u0662\u0663\u0664\u0665\u0666\u0667\u0668\u0669 ok", "+\u00a0v good"]
    rows = spark.createDataFrame([(x,) for x in ads], "t string").select(T.is_ad(F.col("t")).alias("ad")).collect()
    assert [r["ad"] for r in rows] == [True, True, False, True, True]


def test_patterns_in_one_pass(spark):
    """Runs, visible characters and keys as the plain patterns tell them, without the slow ones: a back reference tried at each character, emoji cut out before others."""
    texts = [c * n for c in ("a", "é", "微", "!", "😀", "①", "Ⅷ", "❶", "٣") for n in (1, 9, 10, 11)] + ["", " ", "x" * 9 + "y" * 9, "a" * 9 + "\n" + "a", "微" * 12 + "b" * 10, "aaaaa aaaaa", "☃1⬛2"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([x for t in texts for x in (t, "aaaaa")])], "id int, body string").coalesce(1)
    body = F.col("body")
    run, seen = body.rlike(rf"([^{T.CJK}])\1{{9,}}"), F.regexp_replace(body, T.EMOJI, "").rlike(r"[\p{L}\p{N}]")
    key = F.md5(F.regexp_replace(F.regexp_replace(body, T.EMOJI, ""), r"[^\p{L}\p{N}]+", ""))
    for new, old in ((T.is_spam(body), (body == "") | ~seen | run), (T.visible(body), seen), (T.fingerprint(body), key)):
        assert df.filter(~new.eqNullSafe(old)).collect() == []
    plan = df.select(T.is_spam(body))._jdf.queryExecution().analyzed().toString()
    assert "\\1{" not in plan and "regexp_replace" not in plan
