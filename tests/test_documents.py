import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sheafwork.errors import SheafError
from sheafwork.functions import text as tx
from sheafwork.operators import chunking as C
from sheafwork.sources import extract as X
from sheafwork.sources import files

O = C.Options(20, 5, 6)  # noqa: E741


def test_encodings():
    assert X.decode(b"\xef\xbb\xbfabc") == "abc" and X.decode("é".encode("utf-16")) == "é" and X.decode("é".encode()) == "é" and X.decode("é".encode("latin-1")) == "é"
    assert X.decode(b"a" * (X.PROBE - 1) + "é".encode()).endswith("é")
    with pytest.raises(SheafError, match="6106"):
        X.decode(b"\xe9", strict=True)


def test_plain_text_blocks():
    text, blocks, _ = X.plain_text("﻿one\r\n \r\ntwo\rlines\n\n\n three \n")
    assert [text[b.start : b.end] for b in blocks] == ["one", "two\nlines", "three"]
    assert X.plain_text("")[1] == [] and X.plain_text(" \n\n ")[1] == []


def test_markdown_blocks():
    md = "---\ntitle: T\n---\n\nLead.\n\n# One\n\n- a\n- b\n  more\n\n```\n# no\n```\n\n| x | y |\n|---|---|\n| 1 | 2 |\n\nTwo\n===\n\n> q\n\n<b>raw</b>\n\n***\n\n[r]: http://x\n"
    text, blocks, meta = X.markdown(md)
    assert [(b.kind, text[b.start : b.end]) for b in blocks] == [
        ("Paragraph", "Lead."), ("Heading", "# One"), ("ListItem", "- a"), ("ListItem", "- b\n  more"), ("Code", "```\n# no\n```"), ("TableRow", "| x | y |"), ("TableRow", "| 1 | 2 |"), ("Heading", "Two"), ("Quote", "> q"), ("Paragraph", "<b>raw</b>"),
    ]
    assert meta == {"title": "T"} and [b.level for b in blocks if b.kind == "Heading"] == [1, 1]


def docx(body, styles=None):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        if styles:
            z.writestr("word/styles.xml", f"<w:styles {w}>{styles}</w:styles>")
        z.writestr("word/footnotes.xml", f"<w:footnotes {w}><w:footnote><w:p><w:r><w:t>note</w:t></w:r></w:p></w:footnote></w:footnotes>")
    return out.getvalue()


def test_docx():
    p = lambda t, pr="": f"<w:p><w:pPr>{pr}</w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = p("Title", '<w:pStyle w:val="H"/>') + p("item", "<w:numPr/>") + "<w:p><w:r><w:t>kept</w:t></w:r><w:del><w:r><w:t>gone</w:t></w:r></w:del><w:r><w:tab/><w:t>x</w:t></w:r></w:p>" + f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>"
    text, blocks, _ = X.docx(docx(body, '<w:style w:styleId="H"><w:pPr><w:outlineLvl w:val="1"/></w:pPr></w:style>'))
    assert [(b.kind, text[b.start : b.end], b.level) for b in blocks] == [("Heading", "Title", 2), ("ListItem", "item", 0), ("Paragraph", "kept\tx", 0), ("TableRow", "a | b", 0), ("Footer", "note", 0)]


def test_registry():
    r = X.Registry()
    assert r.find("Text/Markdown; charset=x", None)[0] == "markdown" and r.find(None, "a.log")[0] == "plain-text" and r.find("image/png", "a.png") is None
    r.add("mine", {"text/plain"}, set(), lambda d: ("x", [], {}))
    assert r.find("text/plain", None)[0] == "mine"
    with pytest.raises(ValueError):
        r.add("mine", set(), set(), lambda d: ("x", [], {}))


def test_budget():
    o = C.resolve(256)
    assert (o.max_tokens, o.overlap_tokens, o.min_tokens) == (222, 32, 27)
    for kw, code in (({"max_tokens": 300}, 6003), ({"overlap_tokens": 200}, 6153), ({"min_tokens": 0}, 6003), ({"heading_budget": 0}, 6003)):
        with pytest.raises(SheafError, match=str(code)):
            C.resolve(256, **kw)


def covers(text, spans):
    at = 0
    for a, b in spans:
        assert not text[at:a].strip()
        at = max(at, b)
    assert not text[at:].strip()


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab cdé.\n!？́中 ", max_size=300), st.integers(4, 30))
def test_windows_cover_and_keep_the_budget(text, most):
    o = C.Options(most, most // 4, 2)
    spans = list(C.windows(text, 0, len(text), o, C.units))
    covers(text, [(a, b) for a, b, _ in spans])
    for a, b, n in spans:
        assert n == C.units(text[a:b]) and (n <= most or len(C.GRAPHEME.findall(text[a:b])) == 1)
    assert [a for a, _, _ in spans] == sorted({a for a, _, _ in spans})


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abc d.é\n中", max_size=80), st.integers(0, 80), st.integers(0, 80))
def test_counting_spans(text, a, b):
    a, b = sorted((min(a, len(text)), min(b, len(text))))
    assert C.unit_spans(text)(a, b) == C.units(text[a:b])


def test_long_token_and_overlap():
    spans = list(C.windows("A" * 500, 0, 500, O, C.units))
    assert all(n <= 20 for _, _, n in spans) and spans[-1][1] == 500 and spans[1][0] < spans[0][1]
    text = "One two three four. Five six seven eight nine. Ten eleven twelve thirteen fourteen fifteen sixteen seventeen."
    a, b, _ = next(C.windows(text, 0, len(text), C.Options(12, 3, 2), C.units))
    assert text[a:b].endswith(".")


def test_plain_merges_blocks():
    text, blocks, _ = X.plain_text("a b c\n\nd e f\n\n" + "g " * 19 + "\n\nh")
    got = C.plain(text, blocks, O)
    assert [c.text for c in got] == ["a b c\n\nd e f", "g " * 19 + "\n\nh"] and [c.ordinal for c in got] == [0, 1]
    with pytest.raises(SheafError):
        C.plain(*X.plain_text("x " * 50)[:2], C.Options(20, 5, 6, overflow="throw"))
    assert len(C.plain(*X.plain_text("x " * 50)[:2], C.Options(20, 5, 6, overflow="truncate"))) == 1


def test_sections_by_heading():
    md = "Lead text.\n\n# Top\n\nBody one.\n\n## Second\n\nBody two.\n\n#### Deep\n\nstays.\n\n# Last\n\n" + "word " * 30
    text, blocks, _ = X.markdown(md)
    got = C.by_headings(text, blocks, C.Options(20, 5, 6))
    assert [c.path for c in got[:3]] == [(), ("Top",), ("Last",)] and got[0].text == "Lead text."
    # a short section takes in the next, headings included, under its own path
    assert got[1].text == "Body one.\n\n## Second\n\nBody two.\n\n#### Deep\n\nstays."
    assert got[2].embed_text.startswith("Last\n\nword") and all(c.tokens <= 20 for c in got)
    assert C.by_headings(text, blocks, C.Options(20, 5, 6, include_preamble=False))[0].path == ("Top",)
    assert C.by_headings(text, blocks, C.Options(20, 5, 6, prepend_headings=False))[1].embed_text == got[1].text


def test_tables_repeat_their_header():
    md = "# T\n\n| k | v |\n|---|---|\n" + "".join(f"| key{i} | {i} |\n" for i in range(12))
    text, blocks, _ = X.markdown(md)
    got = C.by_headings(text, blocks, C.Options(24, 5, 6))
    assert len(got) > 1 and all(c.text.startswith("| k | v |\n") and c.tokens <= 24 for c in got)


def test_headings():
    assert [C.heading_title(t) for t in ("## A b ##", "### x\ty", "#no", "Plain", "## ##", "# a › b › c", "# C#")] == ["A b", "x y", "#no", "Plain", "", "a b c", "C#"]
    o = C.Options(50, 5, 6, heading_budget=3)
    assert C.fit_path(("one two", "three", "four"), o, C.units) == ("three", "four") or C.fit_path(("one two", "three", "four"), o, C.units) == ("four",)
    assert C.units(C.fit_path(("a b c d e f",), o, C.units)[0]) <= 3


def test_unknown_chunker():
    with pytest.raises(SheafError, match="6005"):
        C.chunk_text("x", [], "text/plain", O, "other")


def test_chunk_documents(spark):
    df = spark.createDataFrame([(1, "a b c", "text/plain"), (2, None, None), (3, " ", "text/plain"), (4, "# H\n\nx", "text/markdown")], "id long, t string, m string")
    got = C.chunk_documents(df, "id", "t", "m", O).collect()
    assert [(r["id"], r["text"], list(r["heading_path"])) for r in sorted(got)] == [(1, "a b c", []), (4, "x", ["H"])]
    assert C.chunk_documents(df.limit(0), "id", "t", "m", O).count() == 0


def test_text_expressions(spark):
    df = spark.createDataFrame([("﻿a\r\nb\rc d é", "a\tb › c › d", "dir.x/f.MD"), (None, None, None)], "t string, h string, p string")
    r = df.select(tx.normalized(df.t).alias("n"), tx.heading(df.h).alias("h"), tx.media_type_of_path(df.p).alias("m"), tx.token_estimate(df.t).alias("e"), tx.content_hash(df.t, df.h).alias("c")).collect()
    assert r[0]["n"] == "a\nb\nc d é" and r[0]["h"] == "a b c d" and r[0]["m"] == "text/markdown" and r[1]["n"] is None and r[1]["m"] == "application/octet-stream" and r[1]["e"] == 0 and len(r[1]["c"]) == 32


def test_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "b.md").write_text("# H\n\nx")
    (tmp_path / "sub" / "a.txt").write_bytes("é".encode("latin-1"))
    (tmp_path / "sub" / "c.bin").write_bytes(b"\0")
    (tmp_path / "empty.txt").write_text(" ")
    df = files.folder(spark, f"file://{tmp_path}")
    assert sorted(r["document_id"] for r in df.select("document_id").collect()) == ["b.md", "empty.txt", "sub/a.txt", "sub/c.bin"]
    assert [r["document_id"] for r in files.folder(spark, f"file://{tmp_path}", "*.md").collect()] == ["b.md"]
    got = {r["document_id"]: r for r in files.extract(df).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"b.md": "Indexed", "sub/a.txt": "Indexed", "sub/c.bin": "Unsupported", "empty.txt": "NoTextLayer"}
    assert got["sub/a.txt"]["text"] == "é" and [b["kind"] for b in got["b.md"]["blocks"]] == ["Heading", "Paragraph"]
    assert files.extract(df, most_bytes=3).where("status = 'Failed'").count() == 1
    assert files.files(spark, [f"file://{tmp_path}/b.md"]).count() == 1


def test_items_of_a_table(spark):
    df = files.items(spark.createDataFrame([(1, "x y", None), (2, None, "text/markdown")], "id long, t string, m string"), "id", "t", "m")
    got = {r["document_id"]: (r["status"], r["text"]) for r in files.extract(df).collect()}
    assert got == {"1": ("Indexed", "x y"), "2": ("NoTextLayer", "")}


def test_queries_use_every_row(spark, monkeypatch):
    from sheafwork.plans import pipeline_queries as P
    from sheafwork.sources.versioned import VersionedTable

    docs = spark.createDataFrame([(1, "a", "text/plain"), (2, "b", "Text/Plain; charset=utf-8"), (3, " ", None), (4, "# c", "text/markdown;x=y")], "doc_id long, text string, media_type string")
    orders = spark.range(40).selectExpr("id AS o_orderkey", "id AS o_custkey", "'O' AS o_orderstatus")
    monkeypatch.setattr(P, "table", lambda spark, d, name: docs if name == "documents" else orders)
    got = {(r["kind"], r["status"]): r["n"] for r in P.extract_all_documents(spark, "").collect()}
    assert got == {("text/plain", "Indexed"): 2, ("text/plain", "NoTextLayer"): 1, ("text/markdown", "Indexed"): 1}
    added = []
    commit = VersionedTable.commit
    monkeypatch.setattr(VersionedTable, "commit", lambda self, **kw: (added.append(kw["add"].count()) if "add" in kw else None, commit(self, **kw))[1])
    assert [tuple(r) for r in P.table_changes(spark, "").collect()] == [(1, "O", 10, 10)] and added == [30, 10]


def test_elements_and_back(spark):
    from sheafwork.sources import adapters, files

    rows = [("a", "# H\n\nOne para.\n\n- x\n- y\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\nend ", "text/markdown"), ("b", "One.\n \n\nTwo.", "text/plain"), ("c", None, None), ("d", "", "text/plain")]
    got = files.extract(files.items(spark.createDataFrame(rows, "id string, text string, kind string"), "id", "text", "kind"))
    back = adapters.from_elements(adapters.elements(got))
    key = lambda df: {r["document_id"]: (r["text"], r["blocks"], r["status"]) for r in df.select(*got.columns).collect()}
    assert key(back) == key(got)
    kinds = {r["document_id"]: [e["kind"] for e in r["elements"] if e["kind"] != "Gap"] for r in adapters.elements(got).collect() if r["elements"]}
    assert kinds["b"] == ["Paragraph", "Paragraph"] and kinds["a"][0] == "Heading"
    # elements of another model, which has no gaps
    text, blocks = adapters.together([{"kind": "Heading", "text": "H", "level": 1, "page": None}, {"kind": "Paragraph", "text": "p", "level": None, "page": 2}])
    assert text == "H\n\np" and [(b["start"], b["end"], b["level"], b["page"]) for b in blocks] == [(0, 1, 1, -1), (3, 4, 0, 2)]
    assert adapters.from_elements(adapters.elements(got.limit(0))).count() == 0
