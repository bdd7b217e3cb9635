from xml.etree import ElementTree

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tidemark.functions import media, text, urls

HOST = "https://media.example.org"


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first().x


def test_image_id(spark):
    """The parameter ``id``, else ``imageId``, else the last segment, else the one before a rendition; nothing from other services."""
    below = ["https://pics.example.net/app", HOST]
    cases = [
        (f"{HOST}/any/page?id=k7", "k7"),
        (f"{HOST}/any/page?imageId=k8&id=k9", "k9"),
        (f"{HOST}/page?size=2&imageId=k8#top", "k8"),
        (f"{HOST}/deep/er/k10", "k10"),
        (f"{HOST}/k11?size=3", "k11"),
        ("https://pics.example.net/app/x/k12", "k12"),
        ("https://pics.example.net/other", ""),
        ("http://media.example.org/k13", ""),
        ("k14", ""),
        (HOST, ""),
    ]
    cases += [(f"{HOST}/s/k{n}/{r}", f"k{n}") for n, r in enumerate(urls.RENDITIONS)]
    rows = spark.createDataFrame(cases, "url string, want string").select("url", "want", urls.image_id("url", below).alias("got")).collect()
    assert [(r.url, r.got) for r in rows] == [(r.url, r.want) for r in rows]


@pytest.mark.parametrize(
    "header,total,want",
    [
        ("bytes=7-19", 64, [(7, 19, 13)]),
        ("bytes=3-3,60-,-10", 64, [(3, 3, 1), (60, 63, 4), (54, 63, 10)]),
        ("", 100, [(0, 99, 100)]),
        (None, 100, [(0, 99, 100)]),
        ("bytes=-", 100, None),
    ],
)
def test_byte_ranges(spark, header, total, want):
    df = spark.createDataFrame([(header, total)], "h string, n long")
    got = df.select(media.byte_ranges("h", "n").alias("r")).first().r
    assert (got and [tuple(r) for r in got]) == want


@pytest.mark.parametrize(
    "url,admin,want",
    [
        ("https://u:p@h.example.org/x", False, "https://****:****@h.example.org/x"),
        ("https://u@h.example.org/x", False, "https://****@h.example.org/x"),
        ("https://u:p@h.example.org/x", True, "https://u:p@h.example.org/x"),
        ("not a url", False, "not a url"),
        (None, False, None),
    ],
)
def test_mask_credentials(spark, url, admin, want):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(urls.mask_credentials("u", admin).alias("x")).first().x == want


def test_strip_credentials(spark):
    df = spark.createDataFrame([("http://a:b@c/d",), (" ",), ("http://c/d@e",)], "u string")
    assert [r.x for r in df.select(urls.strip_credentials("u").alias("x")).collect()] == ["http://c/d", "", "http://c/d@e"]


def test_text(spark):
    df = spark.createDataFrame([("a|b|c\n\nd",), (None,), ("\x01",)], "t string")
    got = df.select(text.drop_first_marks("t").alias("a"), text.drop_marks("t").alias("b"), text.one_line("t").alias("c"), text.strip_control("t").alias("d"), text.sanitise_value("t").alias("e")).collect()
    assert tuple(got[0])[:3] == ("ab|c\n\nd", "abc\n\nd", "a|b|c d")
    assert tuple(got[1]) == (None, None, None, None, "")
    assert got[2].d is None
    assert one(spark, text.sanitise_value("v"), v="a\0b") == "YQBi"
    assert one(spark, text.joined("v", F.lit(None).cast("string"), "v"), v="x") == "xx"
    assert one(spark, text.highlight("v", "cat"), v="a Cat sat") == "a <b>Cat</b> sat"
    assert [one(spark, text.as_flag("v"), v=v) for v in ("ON", "true", "no")] == [True, True, False]
    assert one(spark, text.exif_date("v"), v="2020:02:03 14:05:06").hour == 14
    assert one(spark, text.exif_date("v"), v="never") is None


def test_media(spark):
    assert one(spark, media.human_size("n"), n=1536) == "1.5 KB"
    assert one(spark, media.human_size("n"), n=0) == "0 B"
    assert tuple(one(spark, media.thumb_bounds("w", "h", 300, 300), w=600, h=1200)) == (150, 300)
    assert tuple(one(spark, media.parse_colour("c"), c="#ff0080")) == (255, 0, 128, 255)
    assert tuple(one(spark, media.parse_colour("c"), c="rgb(1, 2,3)")) == (1, 2, 3, 255)
    assert tuple(one(spark, media.parse_colour("c"), c="f0a")) == (255, 0, 170, 255)
    assert one(spark, media.parse_colour("c"), c="red") is None
    assert one(spark, media.zoom_levels("w", "h"), w=1024, h=300) == 3
    assert one(spark, media.tile_can_exist("a", "b"), a=3, b=4) is False
    assert one(spark, media.extension("m", "f"), m="audio/x", f="a.WAV") == "wav"
    assert one(spark, media.extension("m"), m="other") == "jpg"
    assert one(spark, media.mm_per_pixel("p", "a", "u"), p=10.0, a=2.0, u="inches") == pytest.approx(5.08)
    rules = [("Width", r"(\d+) pixels", "$1 px"), ("width", ".*", "?")]
    assert one(spark, media.first_rule("n", "v", rules), n="width", v="20 pixels") == "20 px"
    assert one(spark, media.first_rule("n", "v", rules), n="height", v="20 pixels") == "20 pixels"


def test_stage_filter(spark):
    def passes(rule, size=100, width=10, height=10, kind="image/png", fmt="png", animated=False, alpha=None):
        df = spark.createDataFrame([(size, width, height, kind, fmt, animated, alpha)], "s long, w int, h int, k string, f string, an boolean, al boolean")
        return df.select(media.stage_filter(rule, "s", "w", "h", "k", "f", "an", "al").alias("x")).first().x

    assert passes({})
    assert not passes({"minBytes": 200})
    assert passes({"minBytes": 200, "minBytesByFormat": {"png": 50}})
    assert not passes({"minBytesByFormat": {"PNG": 500}})
    assert not passes({"minPixels": 101}) and passes({"minPixels": 100})
    assert not passes({"contentTypes": ["audio/"]})
    assert passes({"animated": False}) and not passes({"animated": True})
    assert not passes({"alpha": True})


def test_redirects(spark):
    ok = lambda a, b: one(spark, urls.may_redirect("a", "b"), a=a, b=b)
    assert ok("http://a.example/x", "https://a.example/y")
    assert not ok("https://a.example/x", "http://a.example/y")
    assert not ok("https://a.example/x", "https://u:p@a.example/y")
    assert not ok("https://a.example/x", "ftp://a.example/y")
    assert not ok("https://a.example/x", "https://b.example/y?api_key=1")
    assert ok("https://a.example/x", "https://a.example/y?token=1")


def test_storage_path(spark):
    assert one(spark, urls.storage_path("v", "original"), v="abcd-1234") == "4/3/2/1/abcd-1234/original"
    assert one(spark, urls.is_uuid("v"), v="123e4567-e89b-12d3-a456-426614174000")


def visible(html):
    """The text that a browser would show, and the names of all elements, by another parser than the one under test."""
    tree = ElementTree.fromstring(f"<x>{html}</x>")
    return "".join(tree.itertext()), [e.tag for e in tree.iter()][1:], [e for e in tree.iter("a")]


KEPT, UNWRAPPED, REMOVED = ("em", "strong", "sub", "code"), ("div", "h2", "table", "font", "blink"), ("script", "style", "iframe")


@pytest.mark.parametrize("limit", [None, 0, 5, 17, 60])
@given(st.data())
@settings(max_examples=60, deadline=None)
def test_sanitise_keeps_its_rules(limit, data):
    """Built from pieces whose fate is known: what is formatting stays, what is layout leaves its text, what is a program goes."""
    from tidemark.functions.sanitise import safe_html

    html, shown, kept = "", "", []
    for _ in range(data.draw(st.integers(0, 6))):
        words = data.draw(st.text("owl 7&'`+=@é", max_size=12))
        kind, tag = data.draw(st.sampled_from([("kept", KEPT), ("unwrapped", UNWRAPPED), ("removed", REMOVED), ("link", ("a",)), ("none", ("",))]))
        tag = data.draw(st.sampled_from(tag))
        inner = words.replace("&", "&amp;")
        if kind == "link":
            scheme = data.draw(st.sampled_from(["https://owl.test/", "mailto:owl", "data:text/html,", "vbscript:", "/near"]))
            html += f"<a class=k href='{scheme}' onfocus='hoot()'>{inner}</a>"
            kept += ["a"] * scheme.startswith(("https://", "mailto:"))
        else:
            html += f"<{tag} style='x' onload=hoot()>{inner}</{tag}>" if tag else inner
            kept += [tag] * (kind == "kept")
        shown += "" if kind == "removed" else words
    text, names, links = visible(safe_html(html, limit))
    assert all(set(a.attrib) == {"href", "rel"} and a.get("rel") == "nofollow" for a in links)
    if limit is None or len(shown) <= limit:
        assert (text, names) == (shown, kept)
    else:
        assert names == kept[: len(names)] and text.endswith("...") and shown.startswith(text[:-3]) and len(text) <= limit + 3


def test_sanitise_open_and_stray_tags():
    from tidemark.functions.sanitise import safe_html

    assert safe_html("<em>barn <strong>owl") == "<em>barn <strong>owl</strong></em>"
    assert safe_html("barn</em> owl</h2>") == "barn owl"
    assert safe_html("3 < 5 and 6 > 4") == "3 &lt; 5 and 6 &gt; 4"
    assert safe_html(None) is None and safe_html("") == ""


def test_sanitise_column(spark):
    from tidemark.functions.sanitise import sanitise

    df = spark.createDataFrame([("<b>x",), (None,)], "t string")
    assert [r.x for r in df.select(sanitise("t").alias("x")).collect()] == ["<b>x</b>", None]


def test_sensitive_parameters(spark):
    df = spark.createDataFrame([("a=1&X-Amz-Signature=2",), ("apiKEY=3",), ("page=token",), ("",)], "q string")
    assert [bool(r.x) for r in df.select(urls.has_sensitive_params("q").alias("x")).collect()] == [True, True, False, False]
