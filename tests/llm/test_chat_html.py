"""Snapshots against brute force; pages against their expected layout."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from clustrial.llm import chat, html_text

SCHEMA = "conv_id long, turn long, role string, text string, n long, prefix string, k long"


def test_snapshots_collapse_to_maximal_conversations(spark):
    said = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")]
    talks = {
        1: said[:2], 2: said, 3: said, 4: said[:3], 5: [("user", "a")], 6: [("assistant", "a"), ("user", "b")], 7: [("user", None), (None, "x<|y")],
        8: [("user", "")], None: [("user", "z")], 9: said[:1] + said[2:],
    }
    rows = [(c, k, r, x, 0, "", 0) for c, turns in talks.items() for k, (r, x) in enumerate(turns)]
    rows += [rows[0], rows[3], (10, None, "user", "q", 0, "", 0), (10, None, "user", "r", 0, "", 0)]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert set(got) == {2, 6, 7, None, 9, 10}
    assert got[2].n_copies == 2 and got[2].n_turns == 4
    assert got[7].text == "<|im_start|>user\n<|im_end|>\n<|im_start|>unknown\nx< |y<|im_end|>\n"
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_turns_without_conversation_id_stay_apart(spark):
    rows = [(None, 0, "user", "a"), (None, 0, "user", "b"), (None, 1, "user", "c"), (None, 0, "user", "a"), (None, 2, "user", "c"), (4, 0, "user", "b"), (None, None, None, None), (5, 0, "user", "d"), (5, 1, "user", "e"), (None, 7, "user", "d")]
    df = spark.createDataFrame([(*r, 0, "", 0) for r in rows], SCHEMA).repartition(3)
    got = sorted((r.conv_id or 0, r.n_turns, r.n_copies, r.text.count("<|im_start|>"), r.text[:19]) for r in chat.format_chats(df).collect())
    assert got == [
        (0, 1, 1, 1, "<|im_start|>unknown"), (0, 1, 1, 1, "<|im_start|>user\na<"), (0, 1, 2, 1, "<|im_start|>user\nc<"),
        (4, 1, 2, 1, "<|im_start|>user\nb<"), (5, 2, 1, 2, "<|im_start|>user\nd<"),
    ]
    hot = spark.range(4000).selectExpr("cast(null as long) AS conv_id", "id AS turn", "'user' AS role", "cast(id AS string) AS text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = chat.prefix_hashes(hot).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 1 and max(r["count"] for r in sizes) < 3000
    assert chat.format_chats(hot).count() == 4000


PAGES = [
    ("<p>a<p>b <b>c</b>d<br>e", "a\n\nb cd\ne"),
    ("<ul><li>one<li>two<ol start=3><li>x<li>y</ol><li>three</ul>after", "- one\n- two\n  3. x\n  4. y\n- three\nafter"),
    ("<table><tr><th>Name<th>Qty<tr><td>apples<td>5<tr><td>kiwi<td>12</table>z", "Name    Qty\napples  5\nkiwi    12\n\nz"),
    ("<table><tr><td><table><tr><td>in<td>ner</table><td>out</table>", "in  ner  out"),
    ("<div hidden>n</div><i style='display:none'>n</i>yes<script>x<y</script><!-- c -->", "yes"),
    ("<pre>\n a  b\n\n  c</pre>z", " a  b\n\n  c\n\nz"),
    ("<head><title>t</title><p>hi", "hi"),
    ("a < b &amp; c &lt; d<hr>e", "a < b & c < d\n\n---\n\ne"),
    ("<details><summary>S</summary>gone</details><select><option>o1<option>o2</select>", "S\no1\no2"),
    ("<dl><dt>k<dd>v<dt>k2<dd>v2</dl></p>", "k\n  v\nk2\n  v2"),
    ("<td>stray</td></table></b>x", "strayx"),
    ("", ""),
    ("<", "<"),
]


@pytest.mark.parametrize(("html", "text"), PAGES)
def test_layout(html, text):
    assert html_text.render(html_text.parse(html)) == text


SHOWN = [
    ("<p>so <math><mi>x</mi> <mo>=</mo> <mfrac><mn>1</mn><mn>2</mn></mfrac></math> holds", "so x= 1 2 holds"),
    ("<math><semantics><mi>y</mi><annotation>no</annotation></semantics></math>", "y"),
    ("a<svg><title>t</title><desc>d<p>d</desc><defs><text>f</text></defs>loose<text x=1>one</text><g><text>two <tspan>x</tspan></text></g></svg>b", "a one two x b"),
    ("<p>k<svg><path d='m'/><foreignObject><div>in</div></foreignObject><text>l</text></svg>z", "k\nin\nl z"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
    ("<table><tr><td>p<td rowspan=0 colspan=2>q<td>r<tr><td>s<td>t<tbody><tr><td>u<td>v</table>", "p  q    r\ns       t\nu  v"),
    ("<div style='visibility:hidden'>n<b style='visibility: visible'>yes</b>n<hr></div>z", "yes\n\nz"),
    ("<ol><li>a<li style='visibility:hidden'>b<li>c</ol>", "1. a\n3. c"),
    ("<div style='display:none'><b style='visibility:visible'>n</b></div>z", "z"),
]


@pytest.mark.parametrize(("html", "text"), SHOWN)
def test_all_that_a_browser_shows(html, text):
    assert html_text.render(html_text.parse(html)) == text


STYLED = [
    ("<style>.no{display:none} #x{visibility:hidden}</style><p class='a no'>n<p id=x>n<b style='visibility:visible'>y</b><p class=nope>z", "y\n\nz"),
    ("<head><style>/* .z{display:none} */ i, em { color: red; DISPLAY : None !important }</style></head><i>n</i><em style='display:block'>n</em><p class=z>z", "z"),
    ("<style>.a{display:none}</style><p class=a style='display:block'>y<p class=a>n", "y"),
    ("<style>p{display:none} p.k{display:block} .k#j{display:none}</style><p>n<p class=k>y<p class=k id=j>n", "y"),
    ("<style>.k{display:none} .k{display:block}</style><p class=k>y", "y"),
    ("<style>@media print{p{display:none} .q{display:none}} @media screen { .s { display: none } }</style><p class=q>y<p class=s>n", "y"),
    ("<style media=print>p{display:none}</style><noscript><style>p{display:none}</style></noscript><p>y", "y"),
    ("<style>.m li, a:hover, [x], p > b { display: none } .c::after{content:'} p{display:none}'}</style><p><b>y</b><a>z</a>", "yz"),
    ("<style>[hidden]{} .v{display:block} dialog{display:revert}</style><div hidden class=v>y</div><dialog>n</dialog><div hidden>n</div>", "y"),
    ("<style>@import 'x.css'; .a{display:nonsense-9} .a{visibility:odd}</style><p class=a>y", "y"),
    ("<style>.a{display:none</style><p class=a>n</p><style>@media print{</style>z", "z"),
    ("<style>script{display:block}</style><script>n</script>z", "z"),
]


@pytest.mark.parametrize(("html", "text"), STYLED)
def test_the_page_s_own_styles_count(html, text):
    assert html_text.render(html_text.parse(html)) == text


def test_many_rules_and_many_elements_end():
    rules = "".join(f".a.b{i}{{display:none}}" for i in range(20_000)) + "{" * 20_000 + "@x{" * 20_000
    html_text.render(html_text.parse(f"<style>{rules}</style>" + "".join(f"<p class='a c{i}'>x" for i in range(20_000))))


def test_deep_and_broken_pages_end():
    for html in ("<div>" * 30_000 + "x", "<" * 30_000, '<a "' * 5_000, "<b><p>" * 3_000 + "x", "<table><tr><td>" * 800 + "x"):
        html_text.render(html_text.parse(html))


def test_every_row_comes_out(spark):
    df = spark.createDataFrame([(1, None, "u"), (2, "", "u"), (2, "<p>x", "u"), (None, "y", "u")], "page_id long, html string, text string")
    got = sorted(map(tuple, html_text.extract(df).collect()), key=str)
    assert got == sorted([(1, None), (2, ""), (2, "x"), (None, "y")], key=str)
    assert html_text.extract(df.limit(0)).count() == 0
