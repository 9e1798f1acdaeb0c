from pyspark.sql import functions as F

from graphloom.functions import lists, numbers, text
from graphloom.operators import evidence, scoring
from graphloom.sources import tables
from graphloom.streaming import ingest


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def arr(*values):
    return F.array(*map(F.lit, values))


def test_lists(spark):
    got = one(spark, lists.incremental(arr("1", "2", "3"), arr("1", "2"), arr("2", "4")), lists.capped(arr("a", "b", "c"), 2), lists.capped(arr("a", "b", "c"), 2, "KEEP"), lists.subtract(arr("a", "b", "a"), arr("b")), lists.ordered_union(arr("b", ""), arr("a", "b")))
    assert got == (["2", "3", "4"], ["b", "c"], ["a", "b"], ["a", "a"], ["b", "a"])
    assert one(spark, lists.non_empty_subsets(arr("image", "table")))[0] == [["image"], ["table"], ["image", "table"]]


def test_sanitize(spark):
    assert one(spark, text.sanitize(F.lit(" a\x00\x85b &lt;p&gt; &amp;lt; &#39;x&#39;\uffff\t ")))[0].strip() == "ab <p> &lt; 'x'"
    assert one(spark, text.sanitize(F.lit(None).cast("string"))) == (None,)


def test_answer_scores(spark):
    score = lambda kind, a, p: one(spark, scoring.answer_score(arr(*a), arr(*p), F.lit(kind)))[0]
    assert [score("Int", ["3"], ["3.0"]), score("Int", ["3"], ["x"]), score("Float", ["50"], ["0.5"]), score("Float", ["1.234"], ["$1.23"]), score("Float", ["1.5"], ["n/a"])] == [1, 0, 1, 1, 0]
    assert [score("Str", ["Abcd"], ["abce"]), score("Str", ["page 3"], ["page 4"]), score("None", ["Not answerable"], ["not answerable"])] == [0.75, 0, 1]
    assert [score("List", ["b", "a"], ["A", "B"]), score("List", ["a"], ["a", "b"]), score("List", ["1", "2"], ["2", "1"]), score("List", ["abcd", "wxyz"], ["abce", "wxyz"])] == [1, 0, 1, 0.75]


def test_query_mode(spark):
    q = lambda s: tuple(one(spark, text.query_mode(F.lit(s)))[0])
    assert q("/local[use mermaid format for diagrams] query string") == ("local", False, "use mermaid format for diagrams", "query string")
    assert q("plain words") == ("mix", False, None, "plain words")
    assert q("/naivecontext what") == ("naive", True, None, "what")


def test_numbers(spark):
    quota = lambda i: numbers.linear_quota(F.lit(i), F.lit(3), 5, 1)
    assert one(spark, quota(0), quota(1), quota(2)) == (5, 3, 1)
    assert one(spark, numbers.anls(F.lit(""), F.lit("")), numbers.anls(F.lit("abcd"), F.lit("abce")), numbers.anls(F.lit("ab"), F.lit("xy"))) == (1.0, 0.75, 0.0)
    assert one(spark, numbers.float_equal(F.lit(0.5), F.lit(50.0)), numbers.float_equal(F.lit(1.0), F.lit(2.0)), numbers.clean_answer(F.lit(" '$12 (usd)' "))) == (True, False, "12")


def test_names(spark):
    given = {
        '"Ａlpha"': "Alpha", "12": "", "1.2": "", "1.2.34": "1.2.34", ".1.2.": "", "123": "123", "<p>x</p>": "x", "a<BR>b<br/>": "ab", "it's": "it's",
        '"a" and "b"': '"a" and "b"', "'single'": "single", "《书》": "书", "《a》 and 《b》": "《a》 and 《b》", "“q”": "q", "北京 Hello": "北京Hello", "(中文) 名": "(中文)名", "北 京": "北京",
        "New York 3": "New York 3", "！？：": "！？：", "（ｘ）－＋／＊—": "(x)-+/*-", "中“文”": "中文", '中"文" x': "中文 x", "a\u00a0b": "a b", "k\u202fm 5\u202f6": "k m 5\u202f6", "　pad　": "pad", "": "",
    }
    rows = spark.createDataFrame([(k,) for k in given], "t string").select("t", text.normalize_name(F.col("t")).alias("n"))
    assert {r.t: r.n for r in rows.collect()} == given
    assert one(spark, text.normalized(F.lit("中“文”")), text.normalized(F.lit('"x"')), F.length(text.normalize_name(F.lit("n" * 300)))) == ("中“文”", "x", 256)


def test_damaged_separators(spark):
    from graphloom.operators import extraction

    damaged = ["<|##|>", "<|#||#|>", "<|\\#|>", "<|>", "<||>", "<X|#|>", "<|#|Y>", "<||#||>", "<#>", "<#|>", "<|#>", "<X#|>", "<|#X>", "<|#|", "<|#||", "<|#:", "<||#>", "<||", "|#|>", "<|#|>|", "||#||"]
    rows = spark.createDataFrame([(x, f"a{x}b") for x in damaged] + [("whole", "a<|#|>b"), ("none", "a # b | c < d")], "k string, t string").select("k", extraction.mended(F.col("t")).alias("m"))
    assert {r.k: r.m for r in rows.collect()} == dict.fromkeys([*damaged, "whole"], "a<|#|>b") | {"none": "a # b | c < d"}
    out = "entity<|#|>A<|#|>kind<|#|>told<|#|>relation<|#|>A<|#|>B<|#|>k<|#|>linked\nentity<|#|>C<|#|>my Kind<|#|>x<|#|>entity<|#|>D<|#|>k/d<|#|>bad type\n<|COMPLETE|>"
    records = extraction.parsed_records(spark.createDataFrame([("c", out), ("n", None)], "chunk_id string, output string"))
    assert sorted((r.entity_id, r.entity_type) for r in extraction.entities(records).collect()) == [("A", "kind"), ("C", "mykind")]
    assert [(r.src, r.tgt, r.description, r.weight) for r in extraction.relations(records).collect()] == [("A", "B", "linked", 1.0)]


def test_groups():
    assert evidence.expanded(["image", "layout"], {"layout": ["header", "footer", "page_number", "page_footnote"]}) == ["image", "header", "footer", "page_number", "page_footnote"]


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "c.txt").write_text("  ")
    assert [r.content for r in tables.read_texts(spark, str(tmp_path)).collect()] == ["hello"]
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "list.json").write_text('[{"type":"text","text":"t","page_idx":0},{"type":"table","table_body":"b","page_idx":1}]')
    assert [(r.ord, r.type, r.page_idx) for r in tables.read_content_lists(spark, str(tmp_path / "j")).orderBy("ord").collect()] == [(0, "text", 0), (1, "table", 1)]


def test_stream(spark, tmp_path):
    rows = [(1, "one", "s"), (2, "two", "s"), (3, "one", "t")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = ingest.document_stream(spark, str(tmp_path / "in"))
    ingest.ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    spark.createDataFrame([(4, "two", "u"), (5, "new", "u")], "doc_id long, text string, source string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ingest.ingest(ingest.document_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.content_summary for r in got.collect()) == ["new", "one", "two"]


def test_parts_are_trimmed_of_white_space_only(spark):
    from graphloom.operators import extraction

    got = spark.createDataFrame([("0 zero ; 1 one;  22 ",)], "t string").select(text.split_markers(F.col("t"), ";").alias("p")).first().p
    assert got == ["0 zero", "1 one", "22"]
    record = spark.createDataFrame([("c", "entity<|#|> 1 Main St 1 <|#|>Place 2<|#|> 3 floors")], "chunk_id string, output string")
    assert extraction.parsed_records(record).first().fields == ["entity", "1 Main St 1", "Place 2", "3 floors"]


def test_answers_with_units(spark):
    from graphloom.functions import numbers

    given = ["$1,200 Miles", "5 kg", "'about' 12 million", "£30%", "3 (three)", "team"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string")
    got = [r.c for r in rows.select("i", numbers.clean_answer_with_units(F.col("t")).alias("c")).orderBy("i").collect()]
    assert got == ["1200", "5", "about' 12", "30", "3", "tea"]


def test_texts_of_models(spark):
    rows = spark.createDataFrame([(0, 'x {"high_level_keywords": ["a"], "low_level_keywords": ["b", "c"]} y', "p Extracted answer: [1] Answer format: List"), (1, "no", "plain")], "i int, k string, a string")
    r0, r1 = rows.select("i", text.keywords(F.col("k")).alias("k"), text.extracted_answer(F.col("a")).alias("a"), text.has_cjk(F.col("a")).alias("cjk")).orderBy("i").collect()
    assert (list(r0.k.high), list(r0.k.low), r0.a) == (["a"], ["b", "c"], "[1]")
    assert (list(r1.k.high), list(r1.k.low), r1.a, r1.cjk) == ([], [], "plain", False)
    q = rows.limit(1).select(text.resolved_keywords(F.lit("short query"), F.array().cast("array<string>"), F.array().cast("array<string>")).alias("k")).first().k
    assert (list(q.high), list(q.low)) == ([], ["short query"])


def test_uuid(spark):
    import hashlib
    import uuid

    want = uuid.UUID(bytes=hashlib.sha256("größe".encode()).digest()[:16], version=4).hex
    assert spark.range(1).select(text.uuid_of(F.lit("größe")).alias("u")).first().u == want
