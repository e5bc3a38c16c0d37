import pytest
from pyspark.sql import functions as F

from postloom.functions import dates, text
from postloom.operators import headers, mime, render
from postloom.operators.lexicon import child_bucket, hit_rank, line_types, wrote_count


def column(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def test_message_ids(spark):
    assert column(spark, ["a@b", "a b@c", "@b", "a@", "a@b@c", "a<b@c", "ab", None], text.is_msgid) == [True, True, False, False, False, False, False, False]


def test_tokens(spark):
    got = column(spark, ["Foo.bar's 1,000.5 a_b__ x:y don't 12;34 it's_ok __z abc-def"], text.tokens)
    assert got == [["foo.bar's", "1,000.5", "a_b", "x:y", "don't", "12;34", "it's_ok", "abc", "def"]]


def test_quotation_levels(spark):
    assert column(spark, ["text", "> a", "> > a", "AB> a", ":) hi", ": a", ">| a"], text.quote_level) == [0, 1, 2, 1, 0, 1, 2]


def test_attributions(spark):
    bodies = ["John wrote:\n> hi\nx", "On Monday\nJohn wrote:\n> hi\nx", "hello\nworld\nx", "> hi\nx\ny"]
    assert column(spark, bodies, lambda v: wrote_count(F.split(v, "\n"))) == [1, 2, 0, 0]


def test_subjects(spark):
    assert column(spark, ["Re: RE[2]:  Odp: test", "Re[1]: x", "Was: x"], text.subject_kill) == ["test", "Re[1]: x", "Was: x"]
    assert column(spark, ["te st"], lambda v: text.same_subject(v, F.lit("Re: test"))) == [True]


def test_names(spark):
    authors = ['"J \\"K\\" Doe" <a@b.c>', "a@b.c (John)", "a@b.c", "<a@b.c>"]
    assert column(spark, authors, headers.real_name) == ['J "K" Doe', "John", "a@b.c", "a@b.c"]


@pytest.mark.parametrize(
    ("head", "epoch", "compat"),
    [
        ("Date: Tue, 05 Jan 1999 12:00:00 +0100", 915534000, False),
        ("Date: Tue, 05 Jan 1999 12:00:00 GMT", 915537600, False),
        ("Date: Tue, 05 Jan 1999 12:00:00 -0500", 915555600, False),
        ("Date: Tue, 05 Jan 1999 12:00:00 -0500", 915537600, True),
        ("Date: 12-Jan-87 10:00:00 GMT", 537444000, False),
        ("Date: junk\nNNTP-Posting-Date: Sun, 29 Feb 2004 23:59:00 GMT", 1078099140, False),
        ("Date: Wed, 20 Jan 1999 00:00:00 GMT\nReceived: by x; Tue, 05 Jan 1999 12:00:00 GMT", 915537600, False),
        ("Received: a; 3 Jan 1999 00:00 GMT\nReceived: b; 4 Jan 1999 00:00 GMT\nReceived: c; 12 Jan 1999 00:00 GMT", 915321600, False),
        ("Subject: x", 0, False),
    ],
)
def test_dates(head, epoch, compat):
    assert dates.parse_date(head, compat)[0] == epoch


def test_ranks(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (0, 63), (0, 127), (1, 0), (1, 31), (5, 0), (6, 3)], "t int, p int")
    got = [round(r[0], 6) for r in rows.select(hit_rank(F.col("t"), F.col("p"))).collect()]
    assert got == [1000, 992.913386, 553.543307, 100, 150, 15, 1, 0.061429]
    totals = spark.createDataFrame([(1,), (8,), (9,), (249,), (1000,)], "n long")
    assert [r[0] for r in totals.select(child_bucket(F.col("n"))).collect()] == [0, 0, 1, 31, 31]


def test_line_types(spark):
    body = "\n\nJohn wrote:\n> hi\n>> deep\nmine\n-- \nsig"
    assert [x["type"] for x in column(spark, [body], line_types)[0]] == [7, 1, 2, 0, 4, 4]


def test_small_functions(spark):
    assert column(spark, ["Hello, świat"], text.rot13) == ["Uryyb, śjvng"]
    assert column(spark, ["a<b & \"c\">"], text.html_escape) == ["a&lt;b &amp; &quot;c&quot;&gt;"]
    assert column(spark, ["50% + %"], lambda v: text.uri_decode(text.uri_encode(v))) == ["50% + %"]
    assert column(spark, ["a%25b%41"], lambda v: text.uri_decode(v, compat=True)) == ["a%b%"]
    assert column(spark, ["see http://a.b/c), news:x.y. ab://q"], text.find_urls) == [["http://a.b/c", "news:x.y"]]
    assert column(spark, ["¿aba"], text.fix_mojibake) == ["żaba"]
    assert column(spark, ["abcab", "abc", "a😀bcd"], lambda v: text.char_grams(v, 4)) == [["abca", "bcab"], [], ["a😀bc", "😀bcd"]]
    assert column(spark, ["é", "9", "!"], lambda v: F.array(text.is_alpha(v), text.is_alnum(v), text.is_punct(v))) == [[True, True, False], [False, True, False], [False, False, True]]


RAW = "From: \"Jan\" <j@x.y>\nMessage-ID: <1@x>\nReferences: <a@b> <c d@e>\nSubject: Re: hi\nDate: Tue, 05 Jan 1999 12:00:00 GMT\nNewsgroups: a.b, c.d\nXref: srv a.b:7\n\n\nbody *bold* http://x.yz/q\n> quoted\n-- \nsig"


def test_messages_from_raw_text(spark):
    m = headers.messages(spark.createDataFrame([(0, RAW), (1, "Subject:\n\nx"), (2, "")], "idx long, raw string")).orderBy("idx").collect()
    assert (m[0].msgid, m[0].refs, m[0].epoch, m[0].realname, m[0].subject, m[0].newsgroups, m[0].xref) == ("1@x", ["a@b", "cd@e"], 915537600, "Jan", "Re: hi", "a.b, c.d", "srv a.b:7")
    assert m[0].body.startswith("body") and m[0].size == len(RAW)
    assert m[1].subject == "(no subject)" and m[1].msgid.endswith("@archive.invalid") and m[1].date_status == "bad"
    assert m[1].msgid != m[2].msgid


def test_references_stop_at_what_is_no_id(spark):
    raw = ["References: <x@h> <bad\n\n", "In-Reply-To: <x@h> from a@x.y at 12/12/1999\n\n", "References: <x@h>\n\n", "\n\n"]
    assert column(spark, raw, headers.references) == [[], ["x@h"], ["x@h"], []]


def test_encodings():
    assert mime.guess("żółw".encode("iso8859-2")) == "żółw" and mime.guess("żółw".encode()) == "żółw"
    raw = b"Subject: =?iso-8859-2?Q?=BF=F3=B3w?=\nContent-Type: multipart/mixed; boundary=B\n\n--B\nContent-Type: text/html\n\n<p>no</p>\n--B\nContent-Type: text/plain; charset=iso-8859-2\n\n\xbf\xf3\xb3w\n--B--\n"
    got = mime.readable(raw)
    assert got.startswith("Subject: żółw\n") and got.endswith("żółw") or got.endswith("żółw\n")


def test_rendering(spark):
    raw = spark.createDataFrame([(0, RAW)], "idx long, raw string")
    lines = render.lines(raw, 40).orderBy("line").collect()
    assert [r.text for r in lines if r.kind == "header"][0].startswith("From") and not any("Xref" in r.text for r in lines)
    assert [(r.kind, r.level) for r in lines if r.kind != "header"][-3:] == [("body", 1), ("signature", 0), ("signature", 0)]
    assert any(r.urls == ["http://x.yz/q"] for r in lines) and any("bold" in r.decorations for r in lines)
    m = headers.messages(raw)
    assert "&lt;j@x.y&gt;" in render.html(m).first().html
    assert "quoted" in render.previews(m, ["quoted"]).first().preview and "sig" not in render.previews(m, ["quoted"]).first().preview


def test_utf8_table(spark):
    raw = spark.createDataFrame([(0, bytearray(RAW.encode())), (1, None)], "idx long, content binary")
    assert {r.idx: r.raw[:5] for r in mime.to_utf8(raw).collect()} == {0: "From:", 1: ""}


def test_functions_in_sql_are_those_of_columns(spark):
    from postloom.functions import registry

    assert "parse_message_date" in registry.register(spark)
    values = ["Re: RE[2]: it's_ok 1,000.5", "> > a <b>", "a@b", "50% \"q\"", None]
    spark.createDataFrame([(v,) for v in values], "v string").createOrReplaceTempView("values_of_s")
    for name, f in (("subject_kill", text.subject_kill), ("rot13", text.rot13), ("html_escape", text.html_escape), ("uri_encode", text.uri_encode), ("is_msgid", text.is_msgid), ("quote_level", text.quote_level), ("index_words", text.tokens)):
        got = spark.sql(f"SELECT {name}(v) AS x FROM values_of_s").collect()
        want = spark.table("values_of_s").select(f(F.col("v")).alias("x")).collect()
        assert got == want, name
    assert spark.sql("SELECT parse_message_date('Date: 5 Jan 1999 12:00:00 GMT').epoch AS e").first().e == 915537600
