import random
from html.parser import HTMLParser

from gridloom.llm import html_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>.gone, #x { display : none } p{margin:0}</style><script>var t="</p>";</script></head>
<body class=a><nav><ul><li><a href="/a">One</a><li>Two &amp; <b>three</b><ol start=3><li>x</li><li value="7">y<li>z</ol></ul></nav>
<!-- no --><div class="ad gone">hidden</div><p id=x>hidden</p><p hidden>hidden</p><p style="color:red;display:none">hidden</p>
<h1>Head  line</h1>text<br>next<p>para one<p>para
two<table><caption>Cap</caption><tr><th>Name<th>Value<tr><td>a long name<td>1<tr><td colspan=2>wide cell over both</table>
<pre>  keep
    this</pre><blockquote>quoted<p>more</blockquote><details><summary>Sum</summary>inner</details><q>said</q></body></html>"""

TEXT = """- One
- Two & three
  3. x
  7. y
  8. z

Head line

text
next

para one

para two

Cap
Name         Value
a long name  1
wide cell over both

  keep
    this

  quoted

  more

Sum
"said\""""


def test_layout():
    assert html_text.extract(PAGE) == TEXT


def test_odd_pages():
    assert html_text.extract(None) == html_text.extract("") == html_text.extract("<p>  </p>") == ""
    assert html_text.extract("just text < 3 & more") == "just text < 3 & more"
    assert html_text.extract("a<b") == "a"
    assert html_text.extract("<script>x") == ""
    assert html_text.extract("<!-- x") == ""
    assert html_text.extract("</p></td>x</table>") == "x"
    assert html_text.extract("<td>loose</td> cell") == "loose\ncell"
    deep = html_text.extract("<div>" * 5000 + "deep" + "</div>" * 5000 + "out")
    assert deep.replace("\n", "") == "deepout"
    assert len(html_text.extract("<p>" + "word " * 200_000)) == 999_999


class Words(HTMLParser):
    def __init__(self):
        super().__init__()
        self.skip, self.words = 0, []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head"):
            self.skip += 1

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head"):
            self.skip -= 1

    def handle_data(self, data):
        if not self.skip:
            self.words += data.split()


def test_all_visible_words_in_order(spark):
    r = random.Random(3)

    def block(depth):
        kind = r.choice(["p", "div", "section", "h2", "ul", "ol", "blockquote", "text", "table", "span", "script"])
        words = " ".join(r.choice(["alpha", "béta", "&lt;g&gt;", "d&eacute;", "1 2"]) for _ in range(r.randrange(1, 8)))
        if kind == "script":
            return " <script>if (a<b) '</p>'</script> "
        if kind == "text":
            return words + " "
        if kind in ("ul", "ol"):
            return f"<{kind}>" + "".join(f"<li>{words} {block(depth + 1) if depth < 3 else ''}</li>" for _ in range(2)) + f"</{kind}>"
        if kind == "table":
            return "<table>" + "".join(f"<tr><td>{words}</td><td>x</td></tr>" for _ in range(2)) + "</table>"
        inner = block(depth + 1) if depth < 4 and kind in ("div", "section", "blockquote", "span") else ""
        return f"<{kind}>{words} {inner}</{kind}> "

    pages = ["<html><head><title>no</title></head><body>" + "".join(block(0) for _ in range(12)) + "</body></html>" for _ in range(60)]
    frame = spark.createDataFrame([(i, f"u{i}", p, "clash") for i, p in enumerate(pages)] + [(60, None, None, "c"), (None, "u", "x", "c")], "page_id long, url string, html string, text string")
    got = {x.page_id: x.text for x in html_text.op10(frame).collect()}
    assert got[60] == "" and got[None] == "x" and len(got) == 62
    for i, p in enumerate(pages):
        want = Words()
        want.feed(p)
        marks = [w for w in got[i].split() if w != "-" and not (w[:-1].isdigit() and w.endswith("."))]
        if "<td>" not in p:
            assert marks == want.words
        else:
            assert sorted(marks) == sorted(want.words)
    assert html_text.op10(frame.limit(0)).count() == 0


def test_rules_that_do_not_hide_on_screens():
    from gridloom.llm.html_text import extract

    body = "<body><div class=nav>menu</div><aside>note</aside><p class=x>text</p>"
    shown = "menu\nnote\n\ntext"
    for css in (
        "@media print{.nav{display:none} aside{display:none}}",
        "@media (max-width:600px){.nav,aside{display:none}}",
        "@media screen and (max-width:600px){@supports (x:y){.nav{display:none}}}",
        "/* .nav{display:none} */ @import 'a.css'; .y{content:'}.nav{display:none}'}",
        ".z{color:red; .nav{display:none}}",
    ):
        assert extract(f"<style>{css}</style>{body}") == shown, css
    assert extract(f"<style media=print>.nav{{display:none}}</style>{body}") == shown
    for css in ("@media screen{.nav{display:none}}", "@media print, all{.nav{display:none}}", "@media not print{@layer a{.nav{display:none", "@media print{.x{display:none}} .nav{display:none}", "<!-- .nav{display:none} -->"):
        assert extract(f"<style>{css}</style>{body}") == "note\n\ntext", css


def test_text_of_drawings_and_formulas():
    from gridloom.llm.html_text import extract

    page = "<p>see <svg><title>T</title><defs><text>no</text></defs><desc>D</desc><desc/>stray<rect width='3'/><g><text>Axis <tspan>one</tspan></text><text>two</text><text display='none'>no</text></g></svg> and <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn> <mn>2</mn></mfrac><msubsup><mi>y</mi><mi>i</mi><mn>3</mn></msubsup><annotation>tex</annotation></math>.</p>"
    assert extract(page) == "see Axis one two and x=1/2y_i^3."


def test_rules_win_by_weight_and_order():
    extract = html_text.extract
    for css, want in (
        (".a{display:none}.a{display:block}", "x"),
        (".a{display:block}.a{display:none}", ""),
        ("#i{display:block} .a{display:none}", "x"),
        ("p.a{display:none} .a{display:block}", ""),
        (".a{display:none!important} #i{display:block}", ""),
        ("div .a{display:none}", ""),
        ("section .a{display:none}", "x"),
        ("div > p{display:none}", ""),
        ("body > p{display:none}", "x"),
        (".a:hover{display:none} .a[x]{display:none}", "x"),
    ):
        assert extract(f"<style>{css}</style><body><div><p class=a id=i>x</p></div>") == want, css
    assert extract("<style>.a{display:none}</style><p class=a style='display:block'>x") == "x"
    assert extract("<div style='visibility:hidden'>no <b style='visibility:visible'>yes</b> no<ul><li>no<li style='visibility:visible'>two</ul></div>") == "yes\n\n- two"
    assert extract("<style>p{display:block}</style><p hidden>x") == "x"
    assert extract("<table><tr><td>a<td style='visibility:hidden'>long cell<td>c").split() == ["a", "c"]


def test_offsets_and_depth():
    extract = html_text.extract
    assert extract("\u0130" * 20 + "<script>no</script>rest<STYLE>no</Style> end<script>no</scriptx></script>!") == "\u0130" * 20 + "rest end!"
    for n in (250, 20_000):
        assert extract("<div>" * n + "<p hidden>no</p><i style='display:none'>no</i>yes" + "</div>" * n + "out") == "yes\nout"
        assert extract("<b>" * n + "x" + "</b>" * n + "y") == "xy"


def test_visibility_against_a_tree_of_its_own():
    """Random trees, written as pages and judged by the same rules without any parsing."""
    r = random.Random(9)
    css = {"g": "display:none", "b": "display:block", "v": "visibility:hidden", "s": "visibility:visible"}
    for _ in range(300):
        order = r.sample(sorted(css), 4)
        n = [0]

        def build(depth):
            out = []
            for _ in range(r.randrange(1, 4)):
                if depth == 6 or r.random() < 0.4:
                    n[0] += 1
                    out.append(f"w{n[0]}")
                else:
                    out.append((r.choice(["div", "span", "p", "li", "section", "b"]) if depth == 0 else r.choice(["span", "b", "i"]), r.sample("gbvs", r.choice([0, 0, 1, 2])), r.random() < 0.1, r.choice([None, None, None, "display:none", "visibility:visible", "display:inline"]), build(depth + 1)))
            return out

        def write(kids):
            return " ".join(k if isinstance(k, str) else f"<{k[0]} class='{' '.join(k[1])}'{' hidden' if k[2] else ''}{f' style={k[3]}' if k[3] else ''}>{write(k[4])}</{k[0]}>" for k in kids)

        def seen(kids, veiled):
            for k in kids:
                if isinstance(k, str):
                    if not veiled:
                        yield k
                    continue
                rules = [css[c] for c in order if c in k[1]] + [k[3] or ""]
                display = [x.split(":")[1] for x in rules if x.startswith("display")]
                sight = [x.split(":")[1] for x in rules if x.startswith("visibility")]
                if (display[-1] == "none") if display else k[2]:
                    continue
                yield from seen(k[4], sight[-1] == "hidden" if sight else veiled)

        tree = build(0)
        page = "<style>" + " ".join(f".{c}{{{css[c]}}}" for c in order) + "</style><body>" + write(tree)
        assert [w for w in html_text.extract(page).split() if w != "-"] == list(seen(tree, False)), page
