import pytest
from pyspark.sql import functions as F

from sheafwork.llm import markup as M

CASES = [
    ("plain text, 5 < 6 and a > b & c", []),
    ("# Title\n\ntext", ["heading"]),
    ("Title\n=====\n\ntext", ["heading"]),
    ("== Title ==\n\ntext", ["heading"]),
    ("\\section*{Title}\ntext", ["heading"]),
    ("<H2 class=x>Title</H2>", ["heading"]),
    ("#5 is open, ticket #6 is closed", []),
    ("* a\n* b", ["list"]),
    ("1. a\n2. b", ["list"]),
    ("<ul><li>a<li>b</ul>", ["list"]),
    ("\\begin{itemize}\n\\item a\n\\end{itemize}", ["list"]),
    ("# [[a b]]\n# [[c d]]", ["list", "inline"]),
    ("== x ==\n\n# a\n# b", ["heading", "list"]),
    ("a line\n- not more - of it", []),
    ("```\n# no\n**no** <b>\n```", ["code"]),
    ("~~~x\n$a$\n~~~", ["code"]),
    ("run `a | b` now", ["code"]),
    ("<pre><code>x &lt; y</code></pre>", ["code"]),
    ("\\verb|<b>| and \\begin{verbatim}\n$x$\n\\end{verbatim}", ["code"]),
    ("$x^2$ and $$\ny\n$$", ["formula"]),
    ("<math><mi>p</mi></math>", ["formula"]),
    ("\\[ p = \\frac{F}{A} \\]", ["formula"]),
    ("costs $ 5 plus $ 6, or $5 and $6", []),
    ("| a | b |\n|---|---|\n| 1 | 2 |", ["table"]),
    ("{| class=\"x\"\n! a !! b\n|-\n| 1 || 2\n|}", ["table"]),
    ("<table border='1'><tr><td>1</td></tr></table>", ["table"]),
    ("\\begin{tabular}{l|r}\na & 1 \\\\\n\\end{tabular}", ["table"]),
    ("Row 1 | row 2 share", []),
    ("so **bold**, *not* and ~~gone~~", ["inline"]),
    ("'''bold''' text", ["inline"]),
    ("[text](http://x.example/a) [^1]", ["inline"]),
    ("a\u00a0b &nbsp;&ndash; c<br/>", ["inline"]),
    ("<!-- note -->x", ["inline"]),
    ("lost 3\\,\\% of load \\cite{a}", ["inline"]),
    ("{{note|x|type=y}} z", ["inline"]),
    ("Use <serial> and leave <date> blank, she typed \\o/ and <3", []),
    ("C:\\section\\list\\7, 80 * 12 * 3, max_token_count, R&D @ 5, a == b, ~5 mm, {name}, [89] and [draft]", []),
    ("", []), ("  \n ", []),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_elements(text, want):
    assert M.parse(text)[1] == want


def test_clean_text():
    md = "# T #\n\nSee **bold** [link](http://x) `a*b*`.\n\n* x\n  * y\n\n1. z\n\n$p$\n\n| a | b |\n|---|---|\n| 1 | 2 |"
    assert M.parse(md)[0] == "# T\n\nSee bold link `a*b*`.\n\n- x\n  - y\n\n1. z\n\n$p$\n\n| a | b |\n| 1 | 2 |"
    assert M.parse("<h2>T</h2><p>a &amp; b</p><ol><li>x<li>y</ol><pre>c &lt; d</pre>")[0] == "## T\n\na & b\n\n1. x\n2. y\n\n```\nc < d\n```"
    assert M.parse("\\section{T}\n\\noindent a \\emph{b} 3\\,\\% \\cite{c}.\n\\begin{enumerate}\n\\item x\n\\end{enumerate}")[0] == "## T\n\na b 3 % .\n\n1. x"
    assert M.parse("== T ==\n\n[[page|text]] '''b'''\n\n{|\n! n !! m\n|-\n| [[a|1]] || 2\n|}")[0].startswith("## T\n\ntext b\n\n| n | m |\n| ")


def test_long_and_hostile_texts():
    for t in ("*" * 20_000, "[" * 20_000, "$" * 9_999, "<" * 20_000, "`" * 9_999, "a_" * 20_000, "\\begin{verbatim}" * 2_000, "{{" * 9_000, "x\n" * 30_000, "| a |\n" * 9_000, "&" * 20_000, "''" * 9_000):
        M.parse(t)


def test_rows_and_nulls(spark):
    df = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (3, "**a**", "s"), (3, "**a**", "s")], "id long, text string, src string").withColumn("elements", F.lit(1)).withColumn("_text", F.lit("x"))
    got = sorted((r["id"], r["clean_text"], r["elements"]) for r in M.clean_markup(df, "id", "text", ["src"]).collect() if r["id"] > 1)
    assert got == [(2, "", []), (3, "a", ["inline"]), (3, "a", ["inline"])]
    assert M.clean_markup(df, "id", "text").where("clean_text IS NULL AND elements IS NULL").count() == 1
    assert M.clean_markup(df.limit(0), "id", "text", ["src"]).count() == 0


def test_templates(spark):
    pages = [(i, "h", f"<row><cell>{i}</cell></row> <serial> and <odd>x</odd>" + "<odd>" * (i % 2)) for i in range(6)] + [(10 + i, "g", "<list>" + "<unit><date>d</date></unit>" * (i + 1) + "</list> <row> alone") for i in range(3)] + [(20, "n", None)]
    df = spark.createDataFrame(pages, "id long, host string, text string")
    got = {(r["host"], tuple(r["members"])): r["inside"] for r in M.template_tokens(df, ["host"], "id", "text").collect()}
    # names with one vector are one class; another vector inside it is nested
    assert got == {("h", ("cell", "row")): None, ("g", ("list",)): None, ("g", ("date", "unit")): ["list"]}
    # a source's template is its own
    names = {r["host"]: r["_names"] for r in M.with_template(df, ["host"], "id", "text").select("host", "_names").distinct().collect()}
    assert names == {"h": ["cell", "row"], "g": ["date", "list", "unit"], "n": None}
    el = {r["id"]: r["elements"] for r in M.clean_markup(df, "id", "text", ["host"]).collect()}
    assert el[0] == ["inline"] and el[10] == ["inline"] and el[20] is None
    lone = spark.createDataFrame([(1, "z", "<row>a</row>"), (2, "h", "<cell>")], "id long, host string, text string")
    assert [r["elements"] for r in M.clean_markup(lone, "id", "text", ["host"]).collect()] == [[], []]
    s = sorted((r["id"], r["slot"], r["path"], r["text"]) for r in M.slots(df, ["host"], "id", "text").where("id IN (0, 11)").collect())
    assert s == [(0, 0, "row/cell", "0"), (0, 1, "", "<serial> and <odd>x</odd>"), (11, 0, "list/unit/date", "d"), (11, 1, "list/unit/date", "d"), (11, 2, "", "<row> alone")]


@pytest.mark.parametrize("n", [10, 79, 399, 401, 5000])
def test_a_formula_of_any_length(n):
    assert M.parse("so $x_1 + " + "y + " * (n // 4) + "z$ holds")[1] == ["formula"]


def test_numbers_of_lists():
    assert M.parse("999. a\n1000. b\n1001. c")[1] == ["list"] and M.parse("998. a\n999. b")[1] == ["list"]
    assert M.parse("1998. That year was dry.")[1] == []


@pytest.mark.parametrize("deep", [1, 4, 5, 12])
def test_nesting_of_any_depth(deep):
    assert M.parse("a {{x|" * deep + "in" + "}}" * deep + " b")[0].count("{") == 0
    assert M.parse("\\textbf{" * deep + "in" + "}" * deep)[0] == "in"
