"""Markup residue: which elements a text marks in HTML, Markdown, wiki or LaTeX, and its clean text.

Three steps. ``template_tokens`` deduces templates over the records of one source, as pages of one
host: tag tokens with the same occurrence vector (the same number in every record) form an
equivalence class, and a class is valid if its tokens nest, an opening one always before
its closing one. Valid classes are nested: a class lies in another if it stands inside that one's tokens in every record
that has it. ``slots`` takes a record apart by its source's template: what its tokens leave over, with the path of
tags around it. So names in angle brackets that no known language has, but that behave
as tags in their source, are told from placeholders, and names that are words besides from words. The template says nothing of
marks without tags, nor what a tag marks: ``parse`` reads each record with its source's template and the known languages,
checks every sign where it stands, and turns it into plain text in which headings, lists, code, formulas and
tables have one spelling.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafwork.runtime import materialize, small_enough

#: Names of tags by what they mark.
CODE_TAGS = "pre code source syntaxhighlight tt kbd samp nowiki"
LIST_TAGS = "ul ol li dl dt dd menu dir"
TABLE_TAGS = "table thead tbody tfoot tr td th caption col colgroup"
MATH_TAGS = "math mi mo mn mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mtext mspace mtable mtr mtd semantics annotation ce chem"
INLINE_TAGS = (
    "a abbr acronym address area article aside audio b base basefont bdi bdo big blink blockquote body br button canvas center cite data datalist del details dfn dialog div em embed "
    "fieldset figcaption figure font footer form frame frameset head header hgroup hr html i iframe img input ins label legend link main map mark meta meter nav nobr noscript object "
    "optgroup option output p param picture progress q rp rt ruby s script section select small span strike strong style sub summary sup svg template textarea time title track u var video wbr "
    "ref references gallery noinclude includeonly onlyinclude poem blockquote section"
)
#: Names that are also words in prose, and count as tags only with attributes, a closing tag or a slash.
WORDLIKE = frozenset("address area article base body button caption center cite code data date details dir figure font form frame header input label legend link main map mark menu meta meter object option output param picture progress ref section select small source strike strong style summary table template time title track video var".split())
HEADING_COMMANDS = "part|chapter|section|subsection|subsubsection|paragraph|subparagraph"
MATH_ENVIRONMENTS = "equation|align|gather|multline|eqnarray|displaymath|math|alignat|flalign"
CODE_ENVIRONMENTS = "verbatim|lstlisting|minted|Verbatim|alltt"
TABLE_ENVIRONMENTS = "tabular|tabularx|longtable|table|array|tabulary"
LIST_ENVIRONMENTS = "itemize|enumerate|description"
#: LaTeX commands with a text argument that stays, with an argument that goes, and without any.
KEEPING = "textbf|textit|texttt|textsc|textsf|textrm|textsl|textup|textmd|emph|underline|uline|mbox|text|footnote|caption|title|author|uppercase|MakeUppercase|enquote|section|sout|st"
DROPPING = "cite[a-z]*|ref|eqref|pageref|autoref|cref|Cref|label|index|vspace|hspace|input|include|includegraphics|bibliography|bibliographystyle|usepackage|documentclass|pagestyle|thispagestyle|footnotemark|begin|end|hypersetup"
BARE = "noindent|indent|par|newline|linebreak|pagebreak|newpage|clearpage|bigskip|medskip|smallskip|quad|qquad|centering|hfill|vfill|maketitle|tableofcontents|hline|toprule|midrule|bottomrule|item|bfseries|itshape|small|large|Large|huge|footnotesize|ldots|dots|LaTeX|TeX|appendix"

_tags = lambda names: "|".join(sorted(set(names.split()), key=lambda n: (-len(n), n)))

#: Where code, a formula or a comment may begin.
SIGN = re.compile(r"[`<$]|~~~|\\[bvlBVL\[(]")
FENCE = re.compile(r"(`{3,}|~{3,})[^\n`]*\n(.*?)(?:^[ \t]{0,3}\1[`~]*[ \t]*$|\Z)", re.S | re.M)
TICKS = re.compile(r"(`+)(?!`)((?:[^`\n]|\n(?!\s*\n)|(?<!`)`+(?!`)(?!\1))+?)(?<!`)\1(?!`)")
CODE_TAG = re.compile(rf"<({_tags(CODE_TAGS)})\b[^<>]*>(.*?)</\1\s*>", re.S | re.I)
MATH_TAG = re.compile(r"<math\b[^<>]*>(.*?)</math\s*>", re.S | re.I)
COMMENT = re.compile(r"<!--.*?-->", re.S)
CODE_ENV = re.compile(rf"\\begin\{{((?:{CODE_ENVIRONMENTS})\*?)\}}(.*?)\\end\{{\1\}}", re.S)
MATH_ENV = re.compile(rf"\\begin\{{((?:{MATH_ENVIRONMENTS})\*?)\}}(.*?)\\end\{{\1\}}", re.S)
VERB = re.compile(r"\\(?:verb\*?|lstinline)([^\w\s{*])([^\n]*?)\1")
DISPLAY = re.compile(r"\$\$([^$]+?)\$\$")
DOLLAR = re.compile(r"\$(?=[^\s$])((?:[^$\n]|\n(?!\s*\n))+?)(?<=[^\s\\])\$(?![\w$])")
BRACKETED = re.compile(r"\\\[((?:(?!\\\[)[^\n]|\n(?!\s*\n))+?)\\\]")
IN_LINE = re.compile(r"\\\(([^\n]+?)\\\)")
TEX_SIGN = re.compile(r"\\(?:begin\{|end\{|item\b|cite|ref\{|emph\{|text[a-z]+\{|href\{|noindent\b|[a-z]*section\*?\{|chapter\*?\{|paragraph\{)")
HINT = re.compile(r"[<\\*_#|`$&{\[~=']|^[ \t]*(?:[-+]|\d{1,9}[.)])[ \t]|^-{3,}", re.M)
MATHLIKE = re.compile(r"[\\^_=+<>/]|\b[a-zA-Z]\b")
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)\b((?:\s[^<>]*)?)(/?)>")
HTML_HEADING = re.compile(r"<h([1-6])\b[^<>]*>(.*?)(?:</h[1-6]\s*>|$)", re.S | re.I)
ATX = re.compile(r"^[ \t]{0,3}(#{1,6})[ \t]+(\S[^\n]*?)[ \t]*#*[ \t]*$", re.M)
UNDERLINE = re.compile(r"\n[ \t]{0,3}(={3,}|-{3,})[ \t]*(?=\n|\Z)")
NO_TITLE = re.compile(r"[ \t]*(?:[|>#*+]|-[ \t]|\d+[.)][ \t]|$)")
WIKI_HEADING = re.compile(r"^(={1,6})[ \t]*([^=\s](?:[^\n]*?[^=\s])?)[ \t]*\1[ \t]*$", re.M)
TEX_HEADING = re.compile(rf"(?<![\w:\\])\\({HEADING_COMMANDS})\*?[ \t]*(?:\[[^\]\n]*\])?\{{([^{{}}\n]*(?:\{{[^{{}}\n]*\}}[^{{}}\n]*)*)\}}")
BULLET = re.compile(r"^([ \t]*)(?:([*+-])[ \t]+(?:\[[ xX]\][ \t]+)?|(\d{1,9})[.)][ \t]+)(?=\S)")
WIKI_ITEM = re.compile(r"^([*#:;]+)[ \t]*(?=[^\s*#:;])")
RULE = re.compile(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)*\|?[ \t]*$")
ROW = re.compile(r"^[ \t]*\|(?![-}+]).*\|[ \t]*$")
WIKI_TABLE = re.compile(r"^[ \t:]*\{\|[^\n]*\n(.*?)(?:^[ \t]*\|\}|\Z)", re.S | re.M)
TEX_ENV = re.compile(r"\\(begin|end)\{([a-zA-Z]+)\*?\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?")
TEX_KEEP = re.compile(rf"(?<![\w:\\])\\(?:{KEEPING})\*?(?:\[[^\]\n]*\])?\{{([^{{}}]*)\}}")
TEX_HREF = re.compile(r"(?<![\w:\\])\\href\{[^{}\n]*\}\{([^{}]*)\}|(?<![\w:\\])\\url\{([^{}\n]*)\}")
TEX_DROP = re.compile(rf"~?(?<![\w:\\])\\(?:{DROPPING})\*?(?:\[[^\]\n]*\])?\{{[^{{}}\n]*\}}")
TEX_ANY = re.compile(r"(?<![\w:\\])\\[a-zA-Z]{2,}\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}")
TEX_BARE = re.compile(rf"(?<![\w:\\])\\(?:{BARE})(?![a-zA-Z\\])[ \t]*")
ESCAPED = re.compile(r"(?<![\\\w:])\\([`*_{}\[\]()#+\-.!|<>~$&%])|(?<=\w)\\([%&_#$])")
SPACING = re.compile(r"\\[,;:! ](?=\S)|(?<=\w)~(?=\\)")
TEX_BREAK = re.compile(r"\\\\(?:\[[^\]\n]*\])?[ \t]*(?=\n|$)", re.M)
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,31});")
LINK = re.compile(r"!?\[([^\[\]\n]*)\]\((?:<[^<>\n]*>|[^()\s]+)(?:\s+[\"'(][^\n]*?[\"')])?\)")
REFERENCE = re.compile(r"!?\[([^\[\]\n]+)\]\[[^\[\]\n]*\]")
DEFINITION = re.compile(r"^[ \t]{0,3}\[[^\]\n]+\]:[ \t]+\S+[^\n]*$", re.M)
NOTE = re.compile(r"\[\^[^\]\s]+\]:?")
AUTO = re.compile(r"<(?:https?://|mailto:)[^<>\s]+>")
WIKI_LINK = re.compile(r"\[\[(?:[^\[\]\n|]*\|)*([^\[\]\n|]*)\]\]")
WIKI_OUT = re.compile(r"\[https?://[^\s\]]+(?:[ \t]+([^\]\n]*))?\]")
TEMPLATE = re.compile(r"\{\{([^{}]*)\}\}")
MAGIC = re.compile(r"__[A-Z]{3,}__")
QUOTES = re.compile(r"'''''(?=\S)([^\n]+?)'''''|'''(?=[^'\s])([^\n]+?)'''|''(?=[^'\s])([^\n]+?)''")
_run = r"(?:[^\n]|\n(?!\s*\n))"
EMPHASIS = [
    re.compile(rf"(?<![\w*\\])(\*{{1,3}})(?=[^\s*])({_run}+?)(?<=[^\s*\\])\1(?![\w*])"),
    re.compile(rf"(?<![\w_\\])(_{{1,3}})(?=[^\s_])({_run}+?)(?<=[^\s_\\])\1(?![\w_])"),
    re.compile(rf"(?<![~\\])(~~)(?=[^\s~])({_run}+?)(?<=[^\s~])\1(?!~)"),
]
BOLD_TIGHT = re.compile(rf"(?<![*\\])(\*\*)(?=[^\s*])({_run}+?)(?<=[^\s*\\])\1(?!\*)")
PRIVATE = re.compile("\ue000(\\d+)\ue001")
#: Tag tokens, for Java and for Python.
TOKEN_JAVA = r"</?([a-zA-Z][a-zA-Z0-9]*)(?=[\s/>])"
TOKEN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)(?=[\s/>])[^<>]*>")

KIND: dict[str, str] = {}
for _kind, _names in (("inline", INLINE_TAGS), ("code", CODE_TAGS), ("list", LIST_TAGS), ("table", TABLE_TAGS), ("formula", MATH_TAGS), ("heading", "h1 h2 h3 h4 h5 h6")):
    KIND |= dict.fromkeys(_names.split(), _kind)
ELEMENTS = ("heading", "list", "code", "formula", "table", "inline")


class Record:
    """One text being read: ``found`` gets the kinds of elements, ``w`` is what is left of the text."""

    def __init__(self, text: str, names: frozenset[str] = frozenset()):
        self.found: set[str] = set()
        self.kept: list[str] = []
        self.names = names
        self.w = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")

    def keep(self, s: str) -> str:
        self.kept.append(s)
        return f"\ue000{len(self.kept) - 1}\ue001"

    def sub(self, pattern: re.Pattern, to, kind: str = "inline") -> None:  # noqa: ANN001
        w, n = pattern.subn(to, self.w)
        if n:
            self.found.add(kind)
            self.w = w

    def all(self, pattern: re.Pattern, to) -> None:  # noqa: ANN001
        """The same from the innermost outwards, until nothing is left of it; each time the text gets shorter."""
        was = None
        while was != self.w:
            was = self.w
            self.sub(pattern, to)

    # -- code, formulas, comments: nothing inside them counts

    def protect(self) -> None:
        w, out, done, at = self.w, [], 0, 0
        self.tex = "\\" in w and TEX_SIGN.search(w) is not None
        while m := SIGN.search(w, at):
            p = m.start()
            got = self._protected(w, p)
            if got is None:
                at = p + 1
                while w[p] == "`" and at < len(w) and w[at] == "`":
                    at += 1
                continue
            end, put = got
            out += [w[done:p], put]
            done = at = end
        if out:
            self.w = "".join([*out, w[done:]])

    def _protected(self, w: str, p: int) -> tuple[int, str] | None:
        """(end, what stands for it) of the code, formula or comment that begins at ``p``, if one does."""
        c = w[p]
        if c in "`~":
            line = w.rfind("\n", 0, p) + 1
            if p - line <= 3 and not w[line:p].strip() and (m := FENCE.match(w, p)):
                return m.end(), self._code(m.group(2), True)
            if c == "`" and (p == 0 or w[p - 1] not in "`\\") and (m := TICKS.match(w, p)):
                return m.end(), self._code(m.group(2), False)
        elif c == "<":
            if m := CODE_TAG.match(w, p):
                name, body = m.group(1).lower(), m.group(2)
                if name == "nowiki":
                    self.found.add("inline")
                    return m.end(), self.keep(body)
                body = html.unescape(re.sub(r"</?code\b[^<>]*>", "", body))
                return m.end(), self._code(body, name in ("pre", "source", "syntaxhighlight") or "\n" in body)
            if m := MATH_TAG.match(w, p):
                return m.end(), self._formula(html.unescape(re.sub(r"<[^<>]*>", "", m.group(1))), False)
            if m := COMMENT.match(w, p):
                self.found.add("inline")
                return m.end(), ""
        elif c == "$":
            if p and w[p - 1] == "\\":
                return None
            if m := DISPLAY.match(w, p):
                return m.end(), self._formula(m.group(1), True)
            if not (p and (w[p - 1] == "$" or w[p - 1].isalnum())) and (m := DOLLAR.match(w, p)):
                return m.end(), self._formula(m.group(1), False)
        elif not (p and w[p - 1] == "\\"):
            if (m := CODE_ENV.match(w, p)) or (m := VERB.match(w, p)):
                return m.end(), self._code(m.group(2), m.re is CODE_ENV)
            if m := MATH_ENV.match(w, p):
                return m.end(), self._formula(m.group(2), True)
            if (m := BRACKETED.match(w, p)) or (m := IN_LINE.match(w, p)):
                # elsewhere than in LaTeX these are escaped brackets
                if self.tex or MATHLIKE.search(m.group(1)):
                    return m.end(), self._formula(m.group(1), m.re is BRACKETED)
        return None

    def _code(self, body: str, block: bool) -> str:
        self.found.add("code")
        return "\n\n" + self.keep("```\n" + body.strip("\n") + "\n```") + "\n\n" if block else self.keep(f"`{body.strip()}`")

    def _formula(self, body: str, block: bool) -> str:
        self.found.add("formula")
        return self.keep(f"$${body.strip()}$$" if block else f"${body.strip()}$")

    # -- what the record is written in, for signs that two languages read differently

    def languages(self) -> None:
        w = self.w
        self.wiki = bool("[[" in w and WIKI_LINK.search(w)) or bool("''" in w and QUOTES.search(w)) or "{|" in w or bool(MAGIC.search(w)) or bool("{{" in w and TEMPLATE.search(w)) or bool("==" in w and WIKI_HEADING.search(w)) or bool(re.search(r"<ref\b", w))
        self.markdown = bool(LINK.search(w)) or bool(re.search(r"^ {0,3}(?:- \[[ xX]\]|\+ |\d{1,9}[.)] )|\[\^\w+\]|~~\w|^\|[ :-]+\|", w, re.M)) or bool(BOLD_TIGHT.search(w)) or any(True for _ in self.underlined())

    def tags(self) -> None:
        if "<" not in self.w:
            return
        closed = {m.group(2).lower() for m in TAG.finditer(self.w) if m.group(1)}

        def known(m: re.Match) -> str | None:
            name = m.group(2).lower()
            kind = KIND.get(name)
            if name in self.names:  # the source's template has it
                return kind or "inline"
            if kind is None:
                return None
            if name in WORDLIKE and not (m.group(1) or m.group(3).strip() or m.group(4) or name in closed):
                return None
            return kind

        def heading(m: re.Match) -> str:
            self.found.add("heading")
            return "\n\n" + self.keep("#" * int(m.group(1)) + " ") + " ".join(m.group(2).split()) + "\n\n"

        self.w = HTML_HEADING.sub(heading, self.w)
        order: list[list] = []

        def one(m: re.Match) -> str:
            kind = known(m)
            if kind is None:
                return m.group()
            self.found.add(kind)
            name, end = m.group(2).lower(), bool(m.group(1))
            if name in ("ul", "ol", "menu", "dir", "dl"):
                if end:
                    if order:
                        order.pop()
                else:
                    order.append([name, 0])
                return "\n" if len(order) > (0 if end else 1) else "\n\n"
            if name in ("li", "dt", "dd"):
                if end:
                    return ""
                deep = max(0, len(order) - 1)
                if order and order[-1][0] == "ol":
                    order[-1][1] += 1
                    return "\n" + self.keep("  " * deep + f"{order[-1][1]}. ")
                return "\n" + self.keep("  " * deep + "- ")
            if name in ("table", "tbody", "thead", "tfoot"):
                return "\n\n" if name == "table" else "\n"
            if name == "tr":
                return "\n" + self.keep("|") if not end else "\n"
            if name in ("td", "th"):
                return " " if not end else " " + self.keep("|")
            if name in ("p", "div", "section", "article", "blockquote", "header", "footer", "center", "figure"):
                return "\n\n"
            return "\n" if name in ("br", "hr") else ""

        self.w = TAG.sub(one, self.w)
        self.sub(AUTO, lambda m: m.group()[1:-1].removeprefix("mailto:"))

    # -- lines: headings, lists, tables

    def tables(self) -> None:
        if "{|" in self.w:

            def wiki(m: re.Match) -> str:
                self.found.add("table")
                rows: list[list[str]] = [[]]
                for line in m.group(1).split("\n"):
                    s = line.strip()
                    if s.startswith("|-"):
                        rows.append([])
                    elif s[:1] in "|!" and s:
                        rows[-1] += [c.rpartition("|")[2].strip() if "[[" not in c else c.strip() for c in re.split(r"\|\||!!", s.lstrip("|!+"))]
                    elif s and rows[-1]:
                        rows[-1][-1] += " " + s
                return "\n" + "\n".join(self.keep("| ") + self.keep(" | ").join(r) + self.keep(" |") for r in rows if r) + "\n"

            self.w = WIKI_TABLE.sub(wiki, self.w)
        if "|" not in self.w:
            return
        lines = self.w.split("\n")
        out, i = [], 0
        while i < len(lines):
            line = lines[i]
            if "|" in line and i + 1 < len(lines) and (("|" in lines[i + 1] and RULE.match(lines[i + 1])) or (ROW.match(line) and ROW.match(lines[i + 1]))):
                self.found.add("table")
                while i < len(lines) and "|" in lines[i] and lines[i].strip():
                    if not RULE.match(lines[i]):
                        cells = [c.strip() for c in re.split(r"(?<!\\)\|", lines[i].strip().strip("|"))]
                        out.append(self.keep("| ") + self.keep(" | ").join(cells) + self.keep(" |"))
                    i += 1
                continue
            out.append(line)
            i += 1
        self.w = "\n".join(out)

    def environments(self) -> None:
        if "\\begin" not in self.w and "\\end" not in self.w and "\\item" not in self.w:
            return

        def one(m: re.Match) -> str:
            name = m.group(2)
            kind = "table" if re.fullmatch(TABLE_ENVIRONMENTS, name) else "list" if re.fullmatch(LIST_ENVIRONMENTS, name) else "code" if re.fullmatch(CODE_ENVIRONMENTS, name) else "formula" if re.fullmatch(MATH_ENVIRONMENTS, name) else "inline"
            self.found.add(kind)
            return "\n" + self.keep(f"<{m.group(1)} {kind} {name}>") + "\n"

        w = TEX_ENV.sub(one, self.w)
        out, stack = [], []
        for line in w.split("\n"):
            m = PRIVATE.fullmatch(line)
            mark = self.kept[int(m.group(1))] if m else ""
            if re.fullmatch(r"<(?:begin|end) \w+ \w+>", mark):
                way, kind, name = mark[1:-1].split()
                if way == "begin":
                    stack.append([kind, name, 0])
                elif stack:
                    stack.pop()
                out.append("")
                continue
            s = line.strip()
            if s.startswith("\\item") and not s[5:6].isalpha():
                self.found.add("list")
                body = re.sub(r"^\[([^\]\n]*)\]", r"\1", s[5:].lstrip()).strip()
                if stack and stack[-1][1] == "enumerate":
                    stack[-1][2] += 1
                    out.append(self.keep(f"{stack[-1][2]}. ") + body)
                else:
                    out.append(self.keep("  " * max(0, len(stack) - 1) + "- ") + body)
            elif stack and stack[-1][0] == "table" and s:
                s = re.sub(r"\\(?:hline|toprule|midrule|bottomrule|cline\{[^}]*\})", "", re.sub(r"\\\\(?:\[[^\]]*\])?\s*$", "", s)).strip()
                if s:
                    out.append(self.keep("| ") + self.keep(" | ").join(c.strip() for c in re.split(r"(?<!\\)&", s)) + self.keep(" |"))
            else:
                out.append(line)
        self.w = "\n".join(out)

    def headings(self) -> None:
        self.w = TEX_HEADING.sub(lambda m: self._heading(max(1, HEADING_COMMANDS.split("|").index(m.group(1))), m.group(2)), self.w)
        if "=" in self.w:
            self.w = WIKI_HEADING.sub(lambda m: self._heading(len(m.group(1)), m.group(2)), self.w)
        at, out, w = 0, [], self.w
        for start, end, level in self.underlined():
            out += [w[at:start], self._heading(level, w[start : w.index("\n", start)])]
            at = end
        if out:
            self.w = "".join([*out, w[at:]])

    def underlined(self) -> Iterator[tuple[int, int, int]]:
        """(start, end, level) of titles underlined with equals signs or hyphens."""
        w, last = self.w, 0
        for m in UNDERLINE.finditer(w):
            start = w.rfind("\n", 0, m.start()) + 1
            if start >= last and not NO_TITLE.match(w[start : m.start()]) and "\n" in w[start:]:
                yield start, m.end(), 1 if m.group(1)[0] == "=" else 2
                last = m.end()

    def _heading(self, level: int, title: str) -> str:
        self.found.add("heading")
        return "\n\n" + self.keep("#" * level + " ") + " ".join(title.split()) + "\n\n"

    def lines(self) -> None:
        """Number signs, bullets and numbers at a line's start."""
        if not re.search(r"^[ \t]*(?:[*+#:;-]|\d{1,9}[.)][ \t])", self.w, re.M):
            return
        lines = self.w.split("\n")
        out: list[str] = []
        for i, line in enumerate(lines):
            before = lines[i - 1].strip() if i else ""
            after = lines[i + 1].strip() if i + 1 < len(lines) else ""
            m = ATX.match(line)
            if m:
                body = m.group(2)
                run = before.startswith("#") or after.startswith("#")
                if body.startswith("[[") or (self.wiki and (run or not self.markdown)):
                    self.found.add("list")
                    out.append(self.keep("  " * (len(m.group(1)) - 1) + "1. ") + line.lstrip("# \t"))
                else:
                    out.append(self._heading(len(m.group(1)), body))
                continue
            free = not before or BULLET.match(lines[i - 1]) or WIKI_ITEM.match(lines[i - 1]) or before.endswith((":", "：")) or PRIVATE.match(before)
            m = BULLET.match(line)
            if m and len(m.group(3) or "") > 3:  # a year, or a number in prose, unless the items next to it count on
                near = (BULLET.match(lines[k]) for k in (i - 1, i + 1) if 0 <= k < len(lines))
                if not any(x and x.group(3) and abs(int(x.group(3)) - int(m.group(3))) == 1 for x in near):
                    m = None
            if m and (free or (i and out and out[-1].startswith("\ue000"))):
                self.found.add("list")
                out.append(self.keep(" " * len(m.group(1).expandtabs(4)) + (f"{m.group(3)}. " if m.group(3) else "- ")) + line[m.end() :])
                continue
            m = WIKI_ITEM.match(line)
            if m and self.wiki and free and (len(m.group(1)) > 1 or m.group(1) in "*#" or m.group(1) in ";:" and line[1:2] == " "):
                self.found.add("list")
                deep = "  " * (len(m.group(1)) - 1)
                out.append(self.keep(deep + ("1. " if m.group(1)[-1] == "#" else "- ")) + line[m.end() :])
                continue
            out.append(line)
        self.w = "\n".join(out)

    # -- marks within lines

    def marks(self) -> None:
        w = self.w
        if "[" in w:
            self.sub(WIKI_LINK, lambda m: m.group(1))
            self.sub(LINK, lambda m: m.group(1))
            self.sub(NOTE, "")
            self.sub(WIKI_OUT, lambda m: m.group(1) or "")
            if DEFINITION.search(self.w):
                self.sub(DEFINITION, "")
                self.sub(REFERENCE, lambda m: m.group(1))
        if "{{" in w:
            self.all(TEMPLATE, lambda m: next((p.strip() for p in m.group(1).split("|")[1:] if "=" not in p), ""))
        if "__" in w:
            self.sub(MAGIC, "")
        if "''" in w:
            self.sub(QUOTES, lambda m: m.group(1) or m.group(2) or m.group(3))
        if "\\" in w:
            self.sub(TEX_HREF, lambda m: m.group(1) or m.group(2))
            self.all(TEX_KEEP, lambda m: m.group(1))
            self.sub(TEX_DROP, "")
            self.all(TEX_ANY, lambda m: m.group(1))
            if self.tex or re.search(r"\\(?:noindent|bigskip|medskip|smallskip|par|newpage|quad|qquad)\b", w):
                self.sub(TEX_BARE, "")
                self.sub(TEX_BREAK, "")
            self.sub(SPACING, " ")
            self.sub(ESCAPED, lambda m: self.keep(m.group(1) or m.group(2)))
        for p, sign in zip([*EMPHASIS, BOLD_TIGHT], "*_~*", strict=True):
            if sign in self.w:
                self.sub(p, lambda m: m.group(2))
        if "&" in self.w:
            self.w = ENTITY.sub(self._entity, self.w)

    def _entity(self, m: re.Match) -> str:
        if m.group()[1] != "#" and m.group()[1:] not in html5:
            return m.group()
        self.found.add("inline")
        return self.keep(html.unescape(m.group()))

    def clean(self) -> str:
        w = self.w
        while "\ue000" in w:  # what is kept holds only what was kept before it
            w = PRIVATE.sub(lambda m: self.kept[int(m.group(1))], w)
        w = re.sub(r"[ \t]+$", "", w, flags=re.M)
        return re.sub(r"\n{3,}", "\n\n", w).strip("\n")


def parse(text: str, names: frozenset[str] = frozenset()) -> tuple[str, list[str]]:
    """(clean text, kinds of elements in the order of ``ELEMENTS``) of one record."""
    r = Record(text.replace("\ue000", "").replace("\ue001", ""), names)
    if not HINT.search(r.w):
        return r.w, []
    r.protect()
    r.languages()
    r.tags()
    r.environments()
    r.tables()
    r.headings()
    r.lines()
    r.marks()
    return r.clean(), [e for e in ELEMENTS if e in r.found]


def template_tokens(df: DataFrame, by: list[str], key: str, text: str, least: int = 3) -> DataFrame:
    """(``*by``, ``members``, ``records``, ``inside``): valid equivalence classes of tag tokens of each source, and the class that each is nested in, or null.

    A token's occurrence vector is how often each record has it; it is summed up as one hash over
    (record, number) pairs, so that grouping needs no vector in one place. A class
    is valid if at least ``least`` records have it and it holds a name's opening and closing token,
    which nest: in no record does the closing one come first or more often. It lies inside
    another one if it does so in every record that has it; of several, inside the one that begins last.
    """
    names = F.regexp_extract_all(F.col(text), F.lit(TOKEN_JAVA), F.lit(0))
    t = df.where(F.col(text).contains("<")).select(*by, F.col(key).alias("_k"), names.alias("_t")).select(*by, "_k", F.posexplode("_t").alias("at", "token"))
    per = t.withColumn("token", F.lower("token")).groupBy(*by, "_k", "token").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last"))
    # where its closing token stands first, a name's tokens don't nest
    name, closes = F.regexp_replace("token", "^</?", ""), F.col("token").startswith("</")
    both = per.groupBy(*by, "_k", name.alias("name")).agg(
        F.min(F.when(~closes, F.col("first"))).alias("o"), F.min(F.when(closes, F.col("first"))).alias("c"), F.max("last").alias("z"),
        F.sum(F.when(~closes, F.col("n")).otherwise(0)).alias("no"), F.sum(F.when(closes, F.col("n")).otherwise(0)).alias("nc"),
    )
    both = materialize(both, "tag-vectors")
    vec = lambda n: F.sum(F.xxhash64("_k", n).cast("decimal(20,0)"))
    v = both.groupBy(*by, "name").agg(vec("no").alias("vo"), vec("nc").alias("vc"), F.count("*").alias("records"), F.min(F.coalesce(F.col("o") < F.col("c"), F.lit(False))).alias("nests"))
    valid = materialize(v.where((F.col("vo") == F.col("vc")) & F.col("nests") & (F.col("records") >= least)).select(*by, "name", "vo", "records"), "tag-classes")
    classes = valid.groupBy(*by, "vo").agg(F.sort_array(F.collect_set("name")).alias("members"), F.max("records").alias("records"))
    # where each class begins and ends in each record
    same = lambda a, b, cols: _all([F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols])
    v = small_enough(valid.select(*by, "name", "vo")).alias("v")
    span = both.alias("b").join(v, same("b", "v", [*by, "name"])).select(*[F.col(f"b.{c}") for c in by], "b._k", "v.vo", "b.o", "b.z").groupBy(*by, "_k", "vo").agg(F.min("o").alias("o"), F.max("z").alias("z"))
    span = materialize(span, "tag-spans")
    a, b = span.alias("a"), span.alias("b")
    within = a.join(b, same("a", "b", [*by, "_k"]) & (F.col("a.vo") != F.col("b.vo")) & (F.col("a.o") > F.col("b.o")) & (F.col("a.z") < F.col("b.z")))
    within = within.groupBy(*[F.col(f"a.{c}") for c in by], F.col("a.vo").alias("vo"), F.col("b.vo").alias("in")).agg(F.count("*").alias("n"), F.sum("b.o").alias("o"))
    w = within.alias("w").join(classes.alias("c"), same("w", "c", [*by, "vo"]) & (F.col("w.n") == F.col("c.records")))
    outer = w.groupBy(*[F.col(f"w.{c}") for c in by], F.col("w.vo").alias("vo")).agg(F.max_by("w.in", F.struct("w.o", "w.in")).alias("in"))
    k = classes.alias("k").join(outer.alias("o"), same("k", "o", [*by, "vo"]), "left").select("k.*", "o.in").alias("k")
    p = classes.select(*by, F.col("vo").alias("in"), F.col("members").alias("inside")).alias("p")
    return k.join(p, _all([F.col(f"k.{c}").eqNullSafe(F.col(f"p.{c}")) for c in by]) & (F.col("k.in") == F.col("p.in")), "left").select(*[F.col(f"k.{c}") for c in by], "k.members", "k.records", "p.inside")


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def with_template(df: DataFrame, by: list[str], key: str, text: str) -> DataFrame:
    """``df`` with ``_names``: the names of its source's valid classes, in order. One row a source is joined, broadcast while they are few."""
    t = template_tokens(df, by, key, text).groupBy(*by).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("members")))).alias("_names"))
    t = small_enough(materialize(t, "templates")).alias("t")
    d = df.drop("_names").alias("d")
    return d.join(t, _all([F.col(f"d.{c}").eqNullSafe(F.col(f"t.{c}")) for c in by]), "left").select("d.*", "t._names")


def slots_of(text: str, names: frozenset[str]) -> list[tuple[str, str]]:
    """(path, text) of the slots of a record: what stands between the tokens of its template, with the tags around it."""
    out: list[tuple[str, str]] = []
    path: list[str] = []
    at = 0
    for m in TOKEN.finditer(text):
        name = m.group(2).lower()
        if name not in names:
            continue
        if text[at : m.start()].strip():
            out.append(("/".join(path), text[at : m.start()].strip()))
        at = m.end()
        if not m.group(1):
            path.append(name)
        elif name in path:
            del path[len(path) - 1 - path[::-1].index(name) :]
    if text[at:].strip():
        out.append(("/".join(path), text[at:].strip()))
    return out


def slots(df: DataFrame, by: list[str], key: str, text: str) -> DataFrame:
    """(``key``, ``slot``, ``path``, ``text``): each record taken apart by its source's template; null and blank texts have no slots."""
    d = with_template(df, by, key, text).select(F.col(key).alias("_key"), F.col(text).alias("_text"), "_names")
    kind = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("slot", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("text", T.StringType())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, got = [], []
            for i, (t, n) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                s = slots_of(t or "", frozenset(n or ()))
                rows += [i] * len(s)
                got += [(k, *x) for k, x in enumerate(s)]
            cols = list(zip(*got, strict=True)) if got else [()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=kind.names)

    return d.mapInArrow(of, kind)


def clean_markup(df: DataFrame, key: str, text: str, by: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """``df``'s rows with their ``clean_text`` and ``elements``.

    ``by``: columns that tell the source, whose records are the pages that templates are
    deduced from (none: no deduction). A null text gives nulls; an empty or blank one itself and no
    elements. All columns are kept, or those of ``keep``; ones named ``clean_text`` and ``elements`` are replaced. Equal
    rows stay as many.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("clean_text", "elements", "_names")]
    at = keep.index(text) if text in keep else len(keep)
    d = with_template(df, by, key, text) if by else df.withColumn("_names", F.lit(None).cast("array<string>"))
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField("clean_text", T.StringType()), T.StructField("elements", T.ArrayType(T.StringType()))])
    d = d.select(*keep, *([] if text in keep else [text]), "_names")
    last = len(d.columns) - 1

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets: dict[tuple, frozenset[str]] = {}
            got = []
            for t, n in zip(b.column(at).to_pylist(), b.column(last).to_pylist(), strict=True):
                n = tuple(n or ())
                got.append((None, None) if t is None else parse(t, sets.setdefault(n, frozenset(n))))
            cols = [*(b.column(i) for i in range(len(keep))), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "clean_text", "elements"])

    return d.mapInArrow(of, schema)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(``origin``, ``record_id``, ``collection``, ``source_id``, ``text``) of both tables."""
    e = spark.read.parquet(f"{sf_dir}/extracted_document.parquet").select(F.lit("extracted").alias("origin"), "record_id", "collection", "source_id", "text")
    d = spark.read.parquet(f"{sf_dir}/chunk_draft.parquet").select(F.lit("draft").alias("origin"), F.col("draft_id").alias("record_id"), "collection", "source_id", F.col("embed_text").alias("text"))
    return e.unionByName(d)


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = records(spark, sf_dir).withColumn("page", F.struct("origin", "record_id"))
    return clean_markup(df, "page", "text", ["collection", "source_id"], ["origin", "record_id"])


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per record and kind of marked element."""
    return cleaned(spark, sf_dir).select("origin", "record_id", F.explode("elements").alias("element"))


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean text of every record."""
    return cleaned(spark, sf_dir).select("origin", "record_id", "clean_text")
