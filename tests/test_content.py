"""Literal cases for codecs, block splitting, rendering, normalisation, outline and templates."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quire.functions import codecs as C
from quire.operators import blocks as B
from quire.operators import normalize as N
from quire.operators import outline as O
from quire.operators import render as R
from quire.operators import templates as T
from tests.conftest import rows


def one(spark, col_fn, value):
    return spark.createDataFrame([(value,)], "t string").select(col_fn(F.col("t"))).first()[0]


@pytest.mark.parametrize("src,want", [
    ("a &amp;lt; b", "a &lt; b"),          # one pass: no double decoding
    ("&#38;&#x26;&#X26;", "&&&"),
    ("&unknown; &amp", "&unknown; &amp"),  # unknown name and missing ';' are kept
    ("&#0; &#xD800;", "� �"),
    ("&#128512; &euro;&nbsp;", "😀 €\u00a0"),
    ("no refs", "no refs"),
])
def test_unescape(spark, src, want):
    assert one(spark, C.html_unescape, src) == want


def test_escape_unescape_round_trip(spark):
    s = "<a href=\"x\">Tom & Jerry's</a>"
    assert one(spark, C.html_escape, s) == "&lt;a href=&#34;x&#34;&gt;Tom &amp; Jerry&#39;s&lt;/a&gt;"
    assert one(spark, lambda c: C.html_unescape(C.html_escape(c)), s) == s


def test_base64_one_line_and_strict(spark):
    long = "x" * 300
    enc = one(spark, lambda c: C.b64_encode(C.utf8(c)), long)
    assert "\n" not in enc and "\r" not in enc and len(enc) == 400
    df = spark.createDataFrame([("aGk=",), ("aGk",), ("$aGk=",), ("",), ("aG k=",)], "t string")
    got = [None if r[0] is None else bytes(r[0]) for r in df.select(C.b64_decode(F.col("t"))).collect()]
    assert got == [b"hi", None, None, b"", None]


def test_json_html_safe(spark):
    df = spark.createDataFrame([(1, "<b>&</b>")], "id int, s string")
    assert df.select(C.json_html_safe(F.to_json(F.struct("id", "s")))).first()[0] == \
        '{"id":1,"s":"\\u003cb\\u003e\\u0026\\u003c/b\\u003e"}'


def test_html_blocks(spark):
    html = ("<html><head><title>t</title></head><body><script>var x='</p>';</script><!-- c -->"
            "<h2 class=x>Head &amp; more</h2><p>One<br>two</p><ul><li>a</li><li>b</li></ul><p> </p></body></html>")
    df = spark.createDataFrame([(1, html)], "doc_id bigint, content string")
    got = rows(B.html_blocks(df), "block_no", "kind", "level", "text")
    assert got == [(1, "heading", 2, "Head & more"), (2, "para", 0, "One two"), (3, "para", 0, ""),
                   (4, "item", 0, "a"), (5, "item", 0, "b"), (6, "para", 0, "")]
    stripped = rows(B.strip_empty_paragraphs(B.html_blocks(df)), "block_no")
    assert stripped == [(1,), (2,), (4,), (5,)]


def test_markdown_blocks_and_renderers(spark):
    md = "# Title\n\nFirst line\nsecond line\n- one\n- two\n\n## Sub\nlast"
    df = spark.createDataFrame([(1, md)], "doc_id bigint, content string")
    got = rows(B.text_blocks(df, "markdown"), "block_no", "kind", "level", "text")
    assert got == [(1, "heading", 1, "Title"), (2, "para", 0, "First line\nsecond line"), (3, "item", 0, "one"),
                   (4, "item", 0, "two"), (5, "heading", 2, "Sub"), (6, "para", 0, "last")]
    arr = B.markdown_block_array(F.col("content"))
    r = df.select(R.render_plain(arr).alias("p"), R.render_markdown(arr, atx=False).alias("m"),
                  R.render_html(arr).alias("h")).first()
    assert r.p == "Title\n\nFirst line\nsecond line\n\n- one\n\n- two\n\nSub\n\nlast"
    assert r.m.startswith("Title\n=====\n\n") and "Sub\n---" in r.m
    assert r.h == ("<h1>Title</h1>\n<p>First line\nsecond line</p>\n<ul>\n<li>one</li>\n<li>two</li>\n</ul>\n"
                   "<h2>Sub</h2>\n<p>last</p>")


def test_table_and_in_row_paths_agree(spark):
    html = "<h1>A</h1><p>x</p><p></p><li>i</li><p>y &lt; z</p>"
    df = spark.createDataFrame([(1, html), (2, "<p>only</p>")], "doc_id bigint, content string")
    table = R.assemble(B.strip_empty_paragraphs(B.html_blocks(df))).select("doc_id", R.render_plain("blocks"))
    inrow = df.select("doc_id", R.render_plain(B.drop_empty_paras(B.html_block_array(F.col("content")))))
    assert sorted(rows(table)) == sorted(rows(inrow))


def test_wrap_auto(spark):
    words = ("lorem ipsum " * 20).strip() + " " + "x" * 80 + " end"
    out = one(spark, lambda c: N.wrap(c, "auto", 20), words)
    lines = out.split("\n")
    assert " ".join(lines).split() == words.split()
    assert all(len(ln) <= 20 or " " not in ln for ln in lines)
    assert "x" * 80 in lines
    assert one(spark, lambda c: N.wrap(c, "none"), "a\nb\n\nc\nd") == "a b\n\nc d"


def test_expand_tabs_and_refs(spark):
    assert one(spark, lambda c: N.expand_tabs(c, 4), "a\tbc\tdefgh\tx\n\ty") == "a   bc  defgh   x\n    y"
    assert one(spark, N.ascii_refs, "café 😀") == "caf&#233; &#128512;"
    assert one(spark, N.email_refs, "mail a@b.io now") == "mail &#97;&#64;&#98;&#46;&#105;&#111; now"
    assert one(spark, lambda c: N.abbreviations(c, ["Dr.", "e.g."]), "Dr. Who e.g. this; XDr. no") == \
        "Dr.\u00a0Who e.g.\u00a0this; XDr. no"
    tracked = "<ins>new</ins> <del>old</del> same"
    assert one(spark, lambda c: N.track_changes(c, "accept"), tracked) == "new  same"
    assert one(spark, lambda c: N.track_changes(c, "reject"), tracked) == " old same"
    assert one(spark, lambda c: N.eol(c, "crlf"), "a\r\nb\nc") == "a\r\nb\r\nc"


def outline_blocks(spark):
    levels = [1, 2, 2, 1, 3, 2, 1]
    data = [(7, i + 1, "heading", lv, f"Sec {i}") for i, lv in enumerate(levels)]
    data.append((7, 20, "para", 0, "body"))
    return spark.createDataFrame(data, "doc_id bigint, block_no int, kind string, level int, text string")


def test_number_sections(spark):
    got = rows(O.number_sections(outline_blocks(spark), offset=0).orderBy("block_no"), "number")
    assert [g[0] for g in got] == ["1", "1.1", "1.2", "2", "2.0.1", "2.1", "3"]
    got = rows(O.number_sections(outline_blocks(spark), offset=4).orderBy("block_no"), "number")
    assert got[0][0] == "5" and got[4][0] == "6.0.1"


def test_header_ids_toc_sections(spark):
    b = outline_blocks(spark).withColumn("text", F.when(F.col("level") == 2, F.lit("Same Title!")).otherwise(
        F.col("text")))
    ids = [r[0] for r in O.header_ids(b, prefix="p-").orderBy("block_no").select("id").collect()]
    assert ids == ["p-sec-0", "p-same-title", "p-same-title-1", "p-sec-3", "p-sec-4", "p-same-title-2", "p-sec-6"]
    toc = O.toc(outline_blocks(spark), depth=2).first()
    assert toc.n_entries == 6 and toc.toc.split("\n")[1] == "  - Sec 1"
    secs = rows(O.split_sections(outline_blocks(spark), level=1).orderBy("section_no"), "section_no", "title", "n_blocks")
    assert secs == [(1, "Sec 0", 3), (2, "Sec 3", 3), (3, "Sec 6", 2)]
    shifted = rows(O.shift_headings(outline_blocks(spark), 6).orderBy("block_no"), "kind", "level")
    assert shifted[0] == ("heading", 6) and shifted[1] == ("para", 0)


@pytest.mark.parametrize("tpl,want", [
    ("$title$", "T"),
    ("$if(title)$yes$else$no$endif$", "yes"),
    ("$if(nothing)$yes$else$no$endif$", "no"),
    ("$if(empty)$yes$else$no$endif$", "no"),  # only empty values -> false
    ("$for(author)$$author$$sep$, $endfor$", "a, b"),
    ("$for(author)$[$author$]$endfor$", "[a][b]"),
    ("$author$", "ab"),  # outside a loop, values are joined without separator
    ("$if(title)$$if(author)$$for(author)$<$author$>$sep$$title$$endfor$$endif$$endif$", "<a>T<b>"),
    ("$$ $long-name$ $body$", "$ dash body-text"),
    ("$missing$|$for(missing)$x$endfor$|", "||"),
])
def test_template_cases(spark, tpl, want):
    df = spark.createDataFrame([(1, "body-text")], "doc_id bigint, content string")
    vars_ = spark.createDataFrame(
        [(1, "title", 0, "T"), (1, "author", 0, "a"), (1, "author", 1, "b"), (1, "empty", 0, ""),
         (1, "long-name", 0, "dash")], "doc_id bigint, name string, ord int, value string")
    out = T.template_render(df, T.gather_vars(vars_), tpl).first().rendered
    assert out == want


@pytest.mark.parametrize("tpl", ["$if(a)$x", "$else$", "$for(a)$x$endif$", "$if(a)$x$sep$y$endif$"])
def test_template_errors(tpl):
    with pytest.raises(T.TemplateError):
        T.parse_template(tpl)


def test_nested_blocks_parse():
    src = "$for(a)$$if(b)$$if(c)$x$else$y$endif$$endif$$sep$,$endfor$ $$ $some-name$"
    nodes = T.parse_template(src)
    assert [n.kind for n in nodes] == ["for", "text", "text", "text", "var"]
