"""Layout-aware text of pages."""

import html
import random
import re

import pytest
from rookery.llm import html_layout, queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("page,text", [
    ("", ""), (None, ""), ("plain & simple", "plain & simple"), ("<p>One<p>Two <b>bold</b>\n text", "One\n\nTwo bold text"),
    ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>", "- a\n- b\n  3. x\n  4. y\n- c"),
    ("<table><tr><th>Name<th>Value<tr><td>alpha<td>1<tr><td colspan=2>both columns</table>", "Name   Value\nalpha  1\nboth columns"),
    ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"),
    ("<table><tr><td>x<td><table><tr><td>in<td>ner</table></table>after", "x  in  ner\n\nafter"),
    ("<pre>\n a\n   b</pre>", " a\n   b"), ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<blockquote>q<p>r</blockquote>", "> q\n\n> r"), ("<dl><dt>t<dd>d</dl>", "t\n    d"),
    ("<title>no</title><script>if(a<b)no()</script><style>p{}</style><noscript>no</noscript>yes", "yes"),
    ("<div hidden>no</div><i style='display: none'>no</i><input type=hidden value=no>yes", "yes"),
    ("<div style='visibility:hidden'>no <i style='visibility:visible'>yes</i></div>", "yes"),
    ("<style>.ad, #x {display:none} p.q{display:none}</style><b class='z ad'>no</b><i id=x>no</i><p class=q>no<p>yes", "yes"),
    ("<details>no<summary>yes</summary>no</details>", "yes"), ("<!-- no -->y&eacute;s&nbsp;&copy;", "yés ©"),
    ("<head><meta charset=x><p>body", "body"), ("</p></div></b>x</table>", "x"), ("a < b and c > d", "a < b and c > d"),
    ("<select><option>one<option>two</select>", "one\ntwo"), ("<h1>T</h1>x<div>y</div>z", "T\n\nx\ny\nz"),
])
def test_pages(page, text):
    assert html_layout.render(page)[0] == text


NO = "{ .x { display:none } }"


@pytest.mark.parametrize("page,text", [
    (f"<style>@media print {NO}</style><p class=x>yes", "yes"), (f"<style>@media (max-width:600px) {NO}</style><p class=x>yes", "yes"),
    (f"<style>@media screen and (min-width: 600px) {NO}</style><p class=x>no<p>yes", "yes"), (f"<style>@media print, screen {NO}</style><p class=x>no<p>yes", "yes"),
    (f"<style>@media not print {NO}</style><p class=x>no<p>yes", "yes"), (f"<style>@media screen {{ @media print {NO} }} .y{{}}</style><p class=x>yes", "yes"),
    ("<style media=print>.x{display:none}</style><p class=x>yes", "yes"), ("<style media=screen>.x{display:none}</style><p class=x>no<p>yes", "yes"),
    ("<style>@import 'a{b'; .x{display:none} @font-face{font-family:a}</style><p class=x>no<p>yes", "yes"),
    ("<style>.x{display:none} .x{color:red;display:block}</style><p class=x>yes", "yes"), ("<style>.x{display:none !important} .x{display:block}</style><p class=x>no<p>yes", "yes"),
    ("<style>#i{display:block} .x{display:none}</style><p class=x id=i>yes", "yes"), ("<style>.x{display:none}</style><p class=x style='display:block'>yes", "yes"),
    ("<style>.a{color:red; .x{color:red;display:none}}</style><p class='a'>yes <b class=x>yes</b>", "yes yes"),
    ("<p>so <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math> holds", "so x=1 holds"),
    ("<svg><title>no</title><defs><text>no</text></defs><path d='M0'/>no<text>Up</text><text>Down <tspan>left</tspan></text></svg>", "Up Down left"),
    ("<object data=a.swf><param name=a>fallback</object>", "fallback"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
    ("<table><tr><td>aa<td rowspan=2>b<td>c<tr><td>d<td>e</table>", "aa  b  c\nd      e"),
    ("<table><tr><td rowspan=0 colspan=2>ab<td>c<tr><td>d<tr><td>e<tbody><tr><td>f<td>g</table>", "ab    c\n      d\n      e\nf  g"),
])
def test_visible_text_stays(page, text):
    assert html_layout.render(page)[0] == text


@pytest.mark.parametrize("page,text", [
    ("<style>.a .b{display:none}</style><div class=a><i><b class=b>no</b></i></div><b class=b>yes</b>", "yes"),
    ("<style>.a > .b{display:none}</style><div class=a><b class=b>no</b><i><b class=b>yes</b></i></div>", "yes"),
    ("<style>p.a.b{display:none}</style><p class='b c a'>no<p class=a>yes<div class='a b'>yes</div>", "yes\n\nyes"),
    ("<style>.h{visibility:hidden}.v{visibility:visible}</style><div class=h>no<b class=v>yes</b><i>no</i></div>", "yes"),
    ("<style>div.h p{visibility:hidden} p{visibility:visible}</style><div class=h><p>no</div><p>yes", "yes"),
    ("<style>ul li a[rel=x],A[data-y~='q']{display:none}</style><ul><li><a rel=x>no</a><a rel=xx>yes</a></ul><a rel=x data-y='p q'>no</a>", "- yes"),
    ("<style>.a .b{display:none}.b{display:block}</style><div class=a><b class=b>no</b></div>yes", "yes"),
    ("<style>.a:hover .b,.a + .b,.a ~ .b{display:none}</style><div class=a><b class=b>yes</b></div><b class=b>yes</b>", "yes\nyes"),
    ("<style>html body div#x span{display:none}</style><div id=x><p><span>no</span>yes", "yes"),
])
def test_selectors_and_visibility(page, text):
    assert html_layout.render(page)[0] == text


def plain_matches(node, parents, parts):
    """Whether the last compound fits the node and the others its ancestors, by trying all."""
    child, tag, ids, classes, attributes = parts[-1]
    a = node.attrs
    if tag not in ("*", node.tag) or any(a.get("id") != i for i in ids) or any(c not in a.get("class", "").split() for c in classes):
        return False
    if any(n not in a or sign == "=" and a[n] != v for n, sign, v in attributes):
        return False
    if len(parts) == 1:
        return True
    if child:
        return bool(parents) and plain_matches(parents[-1], parents[:-1], parts[:-1])
    return any(plain_matches(parents[i], parents[:i], parts[:-1]) for i in range(len(parents)))


def plain_visible(node, parents, seen, rules):
    """Words seen, by the definition of the cascade."""
    won = {}
    for place, (selector, says) in enumerate(rules):
        parts = html_layout.compounds(selector)
        if parts and plain_matches(node, parents, parts):
            weight = sum(10_000 * len(p[2]) + 100 * (len(p[3]) + len(p[4])) + (p[1] != "*") for p in parts)
            for name, value in says.items():
                won[name] = max(won.get(name, (-1, -1, "")), (weight, place, value))
    if won.get("display", (0, 0, "block"))[2] == "none":
        return []
    if "visibility" in won:
        seen = won["visibility"][2] == "visible"
    out = []
    for c in node.children:
        out += ([c.strip()] if seen and c.strip() else []) if isinstance(c, str) else plain_visible(c, [*parents, node], seen, rules)
    return out


@pytest.mark.parametrize("seed", range(30))
def test_rules_against_a_plain_matcher(seed):
    rng = random.Random(seed)

    def compound():
        return rng.choice(["", "div", "span", "*"]) + "".join(rng.sample([".a", ".b", ".c", "#i", "#j", "[t]", "[t=x]"], rng.randint(0, 2))) or "span"

    def element(depth):
        attrs = rng.choice(["", " class=a", " class='b a'", " class=c", " id=i", " id=j class=b", " t=x", " t=y class=a"])
        inner = "".join(rng.choice([f" w{rng.randint(0, 999)} ", element(depth - 1)]) for _ in range(rng.randint(1, 3))) if depth else f" w{rng.randint(0, 999)} "
        tag = rng.choice(["div", "span"])
        return f"<{tag}{attrs}>{inner}</{tag}>"

    rules = [(rng.choice([" ", " > ", "  "]).join(compound() for _ in range(rng.randint(1, 3))),
              {rng.choice(["display", "visibility"]): rng.choice(["none", "block"])}) for _ in range(6)]
    rules = [(s, {n: v if n == "display" else {"none": "hidden", "block": "visible"}[v] for n, v in says.items()}) for s, says in rules]
    sheet = "".join(f"{s}{{{';'.join(f'{n}:{v}' for n, v in says.items())}}}" for s, says in rules)
    page = "".join(element(4) for _ in range(4))
    builder = html_layout.TreeBuilder()
    builder.feed(page)
    builder.close()
    want = " ".join(plain_visible(builder.root, [], True, rules)).split()
    assert html_layout.render(f"<style>{sheet}</style>{page}")[0].split() == want


def test_descendant_rules_in_a_deep_page():
    page = "<style>.a .b .c{display:none}</style>" + "<div class='b c'>" * 20_000 + "deep"
    assert html_layout.render(page)[0] == "deep"


@pytest.mark.parametrize("page", ["<div>" * 30000 + "deep" + "</div>" * 30000, "<table><tr><td>" * 3000 + "deep", "<p>" * 30000 + "<b>" * 5000 + "deep", "<ul><li>" * 2000 + "deep", "deep" + "</div>" * 50000])
def test_depth_is_no_limit(page):
    assert html_layout.render(page)[0].strip().endswith("deep")


def visible(page):
    page = re.sub(r"(?s)<head>.*?</head>|<script.*?</script>|<style.*?</style>|<!--.*?-->", "", page)
    return re.sub(r"\s", "", html.unescape(re.sub(r"<[a-zA-Z/!][^>]*>", "", page)))


def test_query_loses_no_visible_text(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op3_html_text(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert re.sub(r"\s", "", re.sub(r"(?m)^\s*- ", "", r.text)) == visible(pages[r.page_id])
        assert r.n_chars == len(r.text) and r.n_lines == (len(r.text.split("\n")) if r.text else 0)


def test_nulls_repeats_and_empty_table(spark):
    kind = "page_id long, url string, html string, text string"
    rows = [(1, None, None, "x"), (None, "u", "<p>a", "x"), (2, "u", "", "x"), (2, "u", "", "x")]
    got = sorted((str(r.page_id), r.url, r.text, r.n_lines) for r in html_layout.extract(spark.createDataFrame(rows, kind)).collect())
    assert got == [("1", None, "", 0), ("2", "u", "", 0), ("2", "u", "", 0), ("None", "u", "a", 1)]
    assert html_layout.extract(spark.createDataFrame([], kind)).collect() == []
