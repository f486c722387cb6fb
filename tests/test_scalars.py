"""Table-driven cases of the scalar rules and predicates."""

import pytest
from pyspark.sql import functions as F

from tessera.errors import AccessDenied
from tessera.functions import predicates as P
from tessera.functions import scalars as S


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("path", "ext"), [("a.PNG", "png"), (".mp4", None), ("..x.mp4", "mp4"), ("foo.", None), ("a..mp4", "mp4"), ("noext", None), ("d.x/noext", None)])
def test_extension(spark, path, ext):
    assert one(spark, path, S.extension) == ext


@pytest.mark.parametrize(
    ("size", "text"),
    [(0, "0 B"), (1023, "1023 B"), (1024, "1.00 KB"), (1152, "1.12 KB"), (1408, "1.38 KB"), (1048575, "1024.00 KB"), (1048576, "1.00 MB"), (1024**6, "1024.00 PB")],
)
def test_human_size(spark, size, text):
    assert one(spark, size, S.human_size, "long") == text


@pytest.mark.parametrize(
    ("url", "video"),
    [
        ("https://www.youtube.com/watch?v=abc123&t=9", "abc123"), ("https://youtu.be/abc123?t=9", "abc123"), ("https://youtu.be/abc123#x", "abc123#x"),
        ("https://www.youtube.com/watch?list=1&v=zz#f", "zz#f"), ("https://www.youtube.com/shorts/abc", None), ("https://WWW.YOUTUBE.COM/watch?v=a", None), ("https://www.youtube.com/watch?v=", ""),
    ],
)
def test_youtube(spark, url, video):
    assert one(spark, url, S.youtube_id) == video
    assert one(spark, url, P.is_youtube) is bool(video)


def test_keys(spark):
    assert one(spark, "#a/x.png", lambda c: S.item_id(F.lit("/lib"), c)) == "861a02cf65fbd48e4a42823dd12de50d741bf41f"
    assert one(spark, "https://x.y/", lambda c: S.media_id(F.lit("bookmark"), c, F.lit(None))) == "a11a04f0b4fad49d35c6c46a120fbcc4dd7a814b"


@pytest.mark.parametrize(("tag", "clean"), [("##deep ", "deep"), ("#", None), ("# ##a", "##a"), ("#\u00a0x\u3000", "x")])
def test_clean_tag(spark, tag, clean):
    assert one(spark, tag, S.clean_tag) == clean


def test_encoding(spark):
    text = "a b/ü*~+&#(1)!:"
    assert one(spark, text, S.percent_encode) == "a%20b/%C3%BC%2A~%2B%26%23%281%29%21%3A"
    assert one(spark, "C:/a b", lambda c: S.percent_encode(c, colon=True)) == "C:/a%20b"
    assert one(spark, "a b*~/", S.form_encode) == "a+b%2A~%2F"


@pytest.mark.parametrize(
    ("page", "image"),
    [
        ('<META property="og:image" content="http://h/b?x=1&amp;y=2">', "http://h/b?x=1&y=2"),
        ('<meta content="http://h/b" property="og:image">', None), ("<meta property='og:image' content='u&copy=1'>", "u©=1"), (None, None),
    ],
)
def test_og_image(spark, page, image):
    assert one(spark, page, lambda c: S.html_unescape(S.og_image(c))) == image


@pytest.mark.parametrize(("kind", "url", "ext"), [("image/jpeg", None, "jpg"), (None, "http://h/p.WEBP?x", "webp"), (None, None, "jpg"), ("", "not a url", "jpg")])
def test_image_extension(spark, kind, url, ext):
    row = spark.createDataFrame([(kind, url)], "k string, u string").select(S.image_extension(F.col("k"), F.col("u")).alias("y")).first()
    assert row.y == ext


def test_lists(spark):
    assert one(spark, [" a", "a", "", "b"], S.ordered_distinct, "array<string>") == ["a", "b"]
    assert one(spark, None, S.ordered_distinct, "array<string>") == []
    assert one(spark, ["a", "", None, "b"], S.join_labels, "array<string>") == "a / b"
    assert one(spark, "[1", S.decode_list) == []
    assert one(spark, [], S.encode_list, "array<string>") is None


def test_counts(spark):
    rows = spark.createDataFrame([("0", "7", None, None), ("x", None, None, None), (None, None, None, "0")], "a string, b string, c string, d string")
    assert [r.n for r in rows.select(S.first_count(*map(F.col, "abcd")).alias("n")).collect()] == [7, None, 0]


def test_small_rules(spark):
    assert one(spark, "  two words", S.first_word) == "two"
    assert one(spark, " \u2003", S.first_word) is None
    assert one(spark, 1.0, S.seek_second, "double") == 1.0
    assert one(spark, None, S.seek_second, "double") == 1.0
    assert one(spark, "a/b/../c", S.normal_path) == "a/c"
    assert one(spark, "Dev", S.folder_title) == "📁 Dev"
    assert S.parse_flag(" Yes") and not S.parse_flag("no")


def test_paths():
    assert P.safe_relative("a/./b/../c") == "a/c"
    assert P.safe_relative(None) == ""
    for bad in ("../x", "/abs", "a/../../b"):
        with pytest.raises(AccessDenied):
            P.safe_relative(bad)


def mode(**terms):
    lists = {k: F.array(*map(F.lit, terms.get(k, []))).cast("array<string>").alias(k) for k in ("keywords", "folders", "include_urls", "exclude_keywords", "exclude_urls")}
    return F.struct(F.lit(terms.get("id", "m")).alias("id"), *lists.values())


@pytest.mark.parametrize(
    ("terms", "hit"),
    [
        ({"keywords": ["spark"]}, True), ({"keywords": ["spark"], "exclude_keywords": ["talk"]}, False), ({"keywords": ["nope"], "folders": ["dev"]}, True),
        ({"exclude_urls": ["nope"]}, True), ({}, True), ({"keywords": ["nope"]}, False), ({"include_urls": ["youtu.be"]}, True), ({"id": "all", "keywords": ["nope"]}, True),
    ],
)
def test_focus(spark, terms, hit):
    row = spark.createDataFrame([("Spark talk", "https://YOUTU.be/x", ["Bar", "Dev"])], "n string, u string, l array<string>")
    assert row.select(P.focus_match(mode(**terms), F.col("n"), F.col("u"), F.col("l")).alias("y")).first().y is hit
