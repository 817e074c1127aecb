import re

from barograph.llm.html_text import extract, op10_html_text, visible_text


def test_blocks_lists_and_tables():
    page = """<!doctype html><title>no</title><style>p{}</style><body><h1>Head &amp; line</h1><p>One<p>two  three<br>four
      <ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>
      <table><caption>Cap</caption><tr><th>Name<th>n<tr><td>long name<td>1<tr><td>b<td>22</table><div hidden>no</div>
      <div style="visibility:hidden">no <b style="visibility: visible">yes</b></div><script>var no = "</p>";</script><pre>
  a
    b</pre></body>"""
    assert visible_text(page) == (
        "Head & line\n\nOne\n\ntwo three\nfour\n\n- a\n- b\n  3. x\n  4. y\n\nCap\nName      | n\nlong name | 1\nb         | 22\n\nyes\n\n  a\n    b"
    )


def test_edge_cases():
    assert visible_text(None) == visible_text("") == visible_text("<p></p><!-- x") == ""
    assert visible_text("a < b & c &lt;d") == "a < b & c <d"
    assert visible_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert visible_text('<p title="x>y">t</p><a "') .startswith("t")
    assert visible_text("x</p>y") == "x\n\ny"
    assert len(visible_text("<p>word " * 50_000)) == 50_000 * 6 - 2


def test_query_keeps_every_visible_word(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op10_html_text(spark, sf).collect()
    assert {r.page_id for r in rows} == set(pages) and len(rows) == len(pages)
    import html

    for r in rows:
        plain = re.sub(r"(?s)<(script|style|title)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ", pages[r.page_id])
        assert [w for w in r.text.split() if w != "-"] == [w for w in html.unescape(plain).split() if w != "-"]


def test_columns(spark):
    df = spark.createDataFrame([(1, "<p>x", "old"), (None, None, None), (1, "<p>x", "old")], "page_id long, html string, text string")
    assert [tuple(r) for r in extract(df).collect()] == [(1, "x"), (None, ""), (1, "x")]
    assert extract(df.limit(0)).count() == 0


def test_drawings_and_formulas():
    assert visible_text('<p>a<svg viewBox="0"><title/><defs/><path d="M"/><g>no<text>Label <tspan>one</tspan></text></g><text visibility="hidden">no</text><text><![CDATA[x > y]]></text></svg>b') == "a Label one x > y b"
    assert visible_text("<svg><title>no</title><desc>no<p>no</p></desc><defs><text>no</text></defs><metadata>no</metadata><foreignObject><p>yes</p></foreignObject></svg>") == "yes"
    assert visible_text("<svg><g><text>in</text><div>out</div>after") == "in\nout\nafter"
    assert visible_text("<p>so <math><semantics><mrow><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></mrow><annotation>no</annotation></semantics></math>.") == "so x=1 2."
    assert visible_text("<pre>a<svg><text>b</text></svg><math><mi>c</mi></math></pre>") == "a b c"


def test_rowspans_hold_their_columns():
    page = "<table><tr><th>A<th>B<th>C<tr><td rowspan=2>a<td>b1<td>c1<tr><td>b2<td>c2<tr><td>a3<td>b3<td>c3</table>"
    assert visible_text(page) == "A  | B  | C\na  | b1 | c1\n   | b2 | c2\na3 | b3 | c3"
    assert visible_text("<table><tr><td>1<td rowspan=0 colspan=2>2<td>3<tr><td>4<td>5<tbody><tr><td>6<td>7<td>8<td>9</table>") == "1 | 2     | 3\n4 |       | 5\n6 | 7 | 8 | 9"
    # a row without text of its own uses up a row, and a span ends with its group
    assert visible_text("<table><tbody><tr><td rowspan=2>a<td>b<tr><tr><td>c<td>d<tbody><tr><td rowspan=9>e<td>f<tbody><tr><td>g<td>h</table>") == "a | b\nc | d\ne | f\ng | h"


def test_colspans_up_to_1000():
    cells = "".join(f"<td>{k % 10}" for k in range(151))
    assert visible_text(f"<table><tr><td colspan=150>wide<td>end<tr>{cells}</table>").split("\n")[0] == "wide".ljust(150 * 4 - 3) + " | end"
    assert visible_text("<table><tr><td colspan=1000>a<td>b<tr><td colspan=5000>c<td>d</table>") == "a | b\nc | d"
    assert len(visible_text("<table>" + ("<tr>" + "<td colspan=1000 rowspan=65534>x" * 300) * 20 + "</table>")) < 20_000_000


def test_a_closing_p_finds_its_p_under_deep_inline_tags():
    deep = "<i>" * 20
    assert visible_text(f"<p>a{deep}b</p>c") == "ab\n\nc"
    assert visible_text(f"<p>a<button>{deep}b</p>c</button>") == "ab\n\nc"


def test_deep_nesting_and_row_spans():
    assert visible_text("<table>" * 350) == "" and visible_text("<table><tr><td>" * 350 + "x") == "x"
    assert visible_text("<div>" * 5000 + "x" + "<b>" * 5000 + "y") == "xy"
    assert visible_text("<ul><li>" * 600 + "x").endswith("- x") and visible_text("<math><mrow>" * 600 + "<mi>x") == "x"
    assert visible_text("<table><tr><td rowspan=2>A<td>B<tr><td>C</table>") == "A | B\n  | C"
    outer = "<table><tr><td>a<td><table><tr><td>b<td>c<tr><td>dd<td>e</table><td>f</table>"
    assert visible_text(outer) == "a | b  | c | f\n  | dd | e |"


def test_style_sheets_hide():
    sheet = "<style>/* .c{display:none} */ .x, p#y { color: red; display: none } @media print { .z {display:none} } @media screen { .w{visibility:hidden} } div p .q{display:none} .v{display:none!important} b{display:none}</style>"
    page = f"{sheet}<p class=x>1</p><p id=y>2</p><div id=y>3</div><p class='z c'>4</p><p class=w>5<i style='visibility:visible'>6</i></p><p class=x style='display:block'>7</p><p class=v style='display:block'>8</p><p>9<b>10</b></p><p class=q>11</p>"
    assert visible_text(page).split() == ["3", "4", "6", "7", "9", "11"]
    assert visible_text("<style media=print>p{display:none}</style><p>a") == "a"
    assert visible_text("<style>p{display:none</style><p>a</p>b") == "b" and visible_text("<style>}}{{@x{p{</style><p>a") == "a"
    assert visible_text("<div style='display:none;display:block'>a</div>") == "a"


def test_random_tables_stand_in_columns():
    """Each cell begins where all others of its column begin, and reaches no further than to its last column's end."""
    import random

    draw = random.Random(7)
    for _ in range(300):
        columns, grid, page = draw.randint(1, 6), [], "<table>"
        for r in range(draw.randint(1, 6)):
            page, col = page + "<tr>", 0
            while col < columns:
                span = draw.randint(1, columns - col) if draw.random() < 0.4 else 1
                text = f"{r}.{col}" + "x" * draw.randint(0, 25)
                grid.append((r, col, col + span, text))
                page += f"<td colspan={span}>{text}</td>"
                col += span
        lines = visible_text(page).split("\n")
        begins, ends = {}, {}
        for r, start, stop, text in grid:
            at = lines[r].index(text)
            assert begins.setdefault(start, at) == at, (page, lines)
            ends[stop] = max(ends.get(stop, 0), at + len(text))
            assert lines[r][at - 3 : at] == (" | " if start else ""), (page, lines)
        for stop, reach in ends.items():
            assert stop not in begins or begins[stop] >= reach + 3
