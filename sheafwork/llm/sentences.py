"""Sentence boundaries in any language and script, by linear-chain sequence models.

Every character is tagged as the end of a unit or as inside one. In text with end marks the rest is inside for
certain: blank lines end units, and of all other characters only end marks (and spaces in Thai, Lao and Khmer) are candidates that
need a decision; each is described by features of what stands around it. In a paragraph of a script without spaces (Chinese, Japanese) that has
no end mark at all, every character is a candidate, described by the characters around it. The weights of features and of tag
pairs come from a structured perceptron, and Viterbi decoding finds the best tags of a paragraph. Both models are trained
here: one on sentences of the seed corpus in ``seed.py`` joined in random ways, so that the true ends
are known, its Thai part without any punctuation; the other on sentences of the same kind stripped of their punctuation.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sheafwork.functions.text import WHITE_SPACE
from sheafwork.llm import seed

BLANK = re.compile(r"(?:\r\n|\r|\n)[^\S\r\n]*(?:\r\n|\r|\n)\s*")
HEADING = re.compile(r"^#{1,6}[^\S\r\n].*$", re.M)
MASKED = re.compile(r"(?:https?://|www\.)[^\s<>\"“”«»）」。，]*[^\s<>\"“”«»）」。，.,;:!?)\]}']|[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.\w+")
MARKS = ".!?…。！？｡．؟۔।॥‼⁇⁈⁉။៕។།༎։።፧᠃᱾"
#: Marks that end a unit by themselves, in scripts where they stand for nothing else.
FULL = "。｡．।॥۔။៕។།༎։።᠃᱾"
OPENING = "([{“‘„‚«‹「『（【〈《［"
CLOSING = ")]}”’»›」』）】〉》］"
#: Which opening signs a closing sign ends.
ENDS = {
    ")": "(", "]": "[", "}": "{", "”": "“„", "’": "‘‚", "»": "«", "›": "‹", "」": "「", "』": "『", "）": "（(", "】": "【", "〉": "〈", "》": "《", "］": "［",
    "“": "„", "‘": "‚", "«": "»", "‹": "›", '"': '"', "'": "'",
}
LAST_WORD = re.compile(r"[^\W\d_]+$")
EVENT = re.compile("[" + re.escape(MARKS + OPENING + CLOSING + "\"'") + "]")
#: Scripts that part sentences by spaces: Thai and Lao, and Khmer where it has no marks.
THAI, KHMER = re.compile(r"[\u0e00-\u0eff]"), re.compile(r"[\u1780-\u17ff]")
WIDE = re.compile(r"[\u3041-\u3096\u30a1-\u30fa\u30fc\u3005\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff]")
THAI_SPACE = re.compile(r"[^\S\r\n]+")
WS = frozenset("\t\n\x0b\x0c\r \x85\xa0  　  " + "".join(map(chr, range(0x2000, 0x200B))) + "  ")

#: Abbreviations by how they end. Never: a name or number follows. Titles: a name follows. May end: closes a sentence if a new one follows.
NEVER = set(
    "eq ref vs cf approx ca i.e e.g ie eg viz al vgl bzw evtl ggf inkl hrsg s.o s.u éd env aprox núm c.-à-d р напр им е z d h u o ej c ص م पृ".split()
)
NUMBERED = set("no nos p pp sec secs fig figs nr art pág págs pag n n.º § lot item vol ch abb kap tab bd cap est tel ext рис табл гл стр см п ст тел".split())
TITLES = set("dr drs mr mrs ms prof st mt sr sra srta dra dn dña mme mlle m hr fr frl dipl ing rev gen col capt lt sgt hon gov sen rep mons г-н г-жа проф акад д-р др д أ डॉ श्री प्रो د".split())
MAY_END = set("etc usw usf u.s.w a.m p.m inc ltd co corp llc jr bros std min sek мин ч г гг в вв д п кг руб коп т.д т.п آخ".split())
#: Words before a number that make it an ordinal in German.
ORDINAL = set("der die das den dem des am im vom zum zur ab bis beim seit ein eine einen einem einer jeder jede jedes jeden und oder".split())


def _script(c: str) -> str:
    """Coarse class of a character that may begin a unit."""
    if c.isupper():
        return "upper"
    if c.islower():
        return "lower"
    if c.isdigit():
        return "digit"
    if c.isalpha():
        return "thai" if "฀" <= c <= "๿" else "wide" if c >= "぀" and not "가" <= c <= "힣" else "caseless"
    return "other"


def _next(text: str, at: int, end: int) -> tuple[str, bool]:
    """What follows a candidate, and whether white space lies between."""
    i = at
    while i < end and text[i] in WS:
        i += 1
    if i >= end:
        return "none", True
    gap, c = i > at, text[i]
    if c in "¿¡":
        return "upper", gap
    if c in OPENING or c in "\"'" or (c in "—–-" and i + 1 < end and (text[i + 1] in "¿¡" or text[i + 1].isupper())):
        j = i + 1
        while j < end and (text[j] in OPENING or text[j] in "\"'¿¡" or text[j] in WS):
            j += 1
        kind = _script(text[j]) if j < end else "other"
        return ("open-" + kind), gap
    if c in "—–-":
        return "dash", gap
    if c in ",;:、，；：،؛/%":
        return "comma", gap
    kind = _script(c)
    if kind == "lower":  # a name such as eBook, or jBoss
        j = i + 1
        while j < end and text[j].isalpha() and j < i + 3:
            if text[j].isupper():
                return "camel", gap
            j += 1
    return kind, gap


def _before(text: str, start: int, at: int) -> tuple[str, str]:
    """The class of what a mark follows, and the script of its last character."""
    if at <= start or text[at - 1] in WS:
        return "space", "none"
    lo = max(start, at - 40)
    word = text[lo:at].split()[-1]
    word = word.lstrip("".join(OPENING) + "\"'¿¡—–-").rstrip(")]”»")
    script = _script(text[at - 1])
    if not word:
        return "closed", script
    low = word.lower()
    if word.isdigit():
        prev = text[lo : at - len(word)].split()
        return ("ordinal" if len(word) <= 2 and prev and LAST_WORD.findall(prev[-1].lower())[-1:] and LAST_WORD.findall(prev[-1].lower())[-1] in ORDINAL else "number"), script
    if len(word) == 1 and word.isupper():
        return "initial", script
    if low in MAY_END:
        return "may-end", script
    if low in NUMBERED:
        return "numbered", script
    if low in TITLES and not (word[0].islower() and word[0] < "ɐ"):
        return "title", script
    if low in NEVER:
        return "never", script
    if "." in word[:-1] and len(word) <= 4 and word[-1].isupper():
        return "initial", script
    if len(word) == 1 and word.islower():
        return "never", script
    return "word", script


def _spans(text: str, start: int, end: int, events: list[tuple[int, str]]) -> list[tuple[int, int]]:
    """Pairs of opening and closing quotes and brackets, matched within a paragraph."""
    stack: list[tuple[str, int]] = []
    out: list[tuple[int, int]] = []
    for at, c in events:
        before = text[at - 1] if at > start else " "
        after = text[at + 1] if at + 1 < end else " "
        if c in ENDS:
            if c in "'’‘" and before.isalnum() and after.isalnum():
                continue
            if not (c in "\"'" and before in WS and after not in WS):
                k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in ENDS[c]), None)
                if k is not None:
                    out.append((stack[k][1], at))
                    del stack[k:]
                    continue
            if c in "\"'»›":  # the same sign opens, or one of a reversed pair
                if after not in WS and not (c in "'»›" and before not in WS):
                    stack.append((c, at))
                continue
        if c in OPENING:
            stack.append((c, at))
    return out


#: A candidate: where a unit would end, and its features.
Candidate = tuple[int, tuple[str, ...]]


def candidates(text: str, start: int, end: int, masked: list[tuple[int, int]]) -> list[Candidate]:
    """The candidates of one paragraph, in order."""
    found = [(m.start(), m.group()) for m in EVENT.finditer(text, start, end)]
    if masked:
        found = [x for x in found if not any(a <= x[0] < z for a, z in masked)]
    spans = _spans(text, start, end, [x for x in found if x[1] not in MARKS]) if any(x[1] not in MARKS for x in found) else []
    closing = {z: a for a, z in spans}
    out: list[Candidate] = []
    i, n = 0, len(found)
    while i < n:
        at, c = found[i]
        i += 1
        if c not in MARKS:
            continue
        first, last = at, at
        while i < n and found[i][0] == last + 1 and found[i][1] in MARKS:
            last = found[i][0]
            i += 1
        mark = text[first : last + 1]
        stop, opened = last + 1, -1
        while stop < end:
            j = stop
            if text[j] in "\xa0  " and j + 1 < end and text[j + 1] in "»›":
                j += 1
            if j not in closing:
                break
            opened, stop = closing[j], j + 1
        if mark.strip(FULL) == "":
            kind = "full"
        elif mark == ".":
            kind = "point"
        elif any(ch in "!?！？؟‼⁇⁈⁉፧" for ch in mark):
            kind = "bang"
        else:
            kind = "dots"
        after, gap = _next(text, stop, end)
        if after == "none":
            out.append((stop, ("sure",)))
            continue
        before, script = _before(text, start, first) if kind == "point" else ("", "")
        if before == "numbered" and after != "digit":
            before = "word"
        inside = any(a < first and stop <= z for a, z in spans)
        quote = ""
        if opened >= 0:
            k = opened - 1
            while k >= start and text[k] in WS:
                k -= 1
            lead = text[k] if k >= start else "^"
            quote = ("bracket" if text[opened] in "([{（【［" else "quote") + ("-alone" if lead == "^" or lead in MARKS or lead in CLOSING or lead in "\"'" else "-led" if lead in ":：" else "-in")
        base = f"{kind}|{before}|{after}"
        out.append((stop, (
            "inside" if inside else "outside", f"k {kind} {'inside' if inside else ''}", f"b {before}", f"a {after}", base if not quote else f"{kind}|{before}", f"g {kind} {gap} {after}",
            f"q {quote} {after}", f"q {quote}", f"s {kind} {script} {after if script in ('caseless', 'wide') else ''}", f"in {inside} {quote}",
        )))
    if THAI.search(text, start, end) or (not out and KHMER.search(text, start, end)):
        spaced = lambda c: "\u0e00" <= c <= "\u0eff" or "\u1780" <= c <= "\u17ff"
        ends = {p for p, _ in out}
        for m in THAI_SPACE.finditer(text, start, end):
            a, z = m.span()
            if a <= start or z >= end or a in ends or text[z] in "\r\n" or text[a - 1] in "\r\n":
                continue
            left, right = text[a - 1], text[z]
            if not (spaced(left) or spaced(right)):
                continue
            inside = any(p < a and z <= q for p, q in spans)
            side = lambda c: "repeat" if c in "ๆໆៗ" else "thai" if spaced(c) and not c.isdigit() else "digit" if c.isdigit() else "latin" if c.isalpha() and c < "ɐ" else "sign"
            le, ri = side(left), side(right)
            out.append((a, ("inside" if inside else "outside", f"t {le} {ri}", f"tl {le}", f"tr {ri}")))
        out.sort()
    return out


def characters(text: str, start: int, end: int) -> list[Candidate]:
    """Every place between two characters of a script without spaces, in a paragraph without end marks; none in any other."""
    if not WIDE.search(text, start, end) or any(m.group() in MARKS for m in EVENT.finditer(text, start, end)):
        return []
    out: list[Candidate] = []
    wide = [bool(WIDE.match(c)) for c in text[start:end]]
    for i in range(1, len(wide)):
        j = i
        while j < len(wide) and text[start + j] in WS:
            j += 1
        if not wide[i - 1] or j >= len(wide) or not wide[j]:
            continue
        at, to = start + i, start + j
        p, n = text[max(start, at - 3) : at], text[to : min(end, to + 3)]
        out.append((at, (f"p {p[-1]}", f"pp {p[-2:]}", f"ppp {p}", f"n {n[0]}", f"nn {n[:2]}", f"nnn {n}", f"pn {p[-1]} {n[0]}", "gap" if j > i else "tight")))
    return out


class Model:
    """Weights of features for a boundary, and of pairs of tags."""

    def __init__(self, weights: dict[str, float], pairs: tuple[float, float, float, float]):
        self.weights, self.pairs = weights, pairs
        self._kept: dict[tuple[str, ...], float] = {}

    def score(self, features: tuple[str, ...]) -> float:
        s = self._kept.get(features)
        if s is None:
            w = self.weights
            s = self._kept[features] = 1e9 if features == ("sure",) else sum(w.get(f, 0.0) for f in features)
        return s

    def decode(self, cands: list[Candidate]) -> list[int]:
        """Viterbi: 1 where a unit ends. Pairs: inside-inside, inside-end, end-inside, end-end."""
        ii, ie, ei, ee = self.pairs
        a, b = 0.0, -1e9  # best score with the last tag inside, end
        back: list[tuple[bool, bool]] = []
        for _, f in cands:
            s = self.score(f)
            na, fa = (a + ii, False) if a + ii >= b + ei else (b + ei, True)
            nb, fb = (a + ie, False) if a + ie >= b + ee else (b + ee, True)
            back.append((fa, fb))
            a, b = na, nb + s
        tags, on = [], b > a
        for fa, fb in reversed(back):
            tags.append(int(on))
            on = fb if on else fa
        return tags[::-1]


def _documents(rounds: int, rng: random.Random) -> Iterator[tuple[str, set[int]]]:
    """Seed sentences joined at random, with the true ends."""
    for _ in range(rounds):
        for name, sentences in seed.SENTENCES.items():
            text, ends = "", set()
            for s in rng.sample(sentences, rng.randint(1, min(6, len(sentences)))):
                if text:
                    whole = text[-1] in seed.TIGHT
                    text += " " if name == "th" else "" if name in ("zh", "ja") and rng.random() < 0.9 else "" if whole and rng.random() < 0.2 else "\n" if rng.random() < 0.05 else " "
                text += s
                ends.add(len(text))
            yield text, ends


def _stripped(rounds: int, rng: random.Random) -> Iterator[tuple[str, set[int]]]:
    """Sentences of scripts without spaces, stripped of their punctuation and joined, with the true ends; names and titles stand alone."""
    for _ in range(rounds):
        for language in ("zh", "ja"):
            text, ends = "", set()
            for _ in range(rng.randint(1, 5)):
                if rng.random() < 0.15:
                    s = "".join(c for c in rng.choice(seed.SENTENCES[language]) if WIDE.match(c))
                else:
                    s = "".join(rng.choice(part) for part in rng.choice(seed.PATTERNS[language]))
                text += s
                ends.add(len(text))
            yield text, ends
            title = "".join(rng.choice(part) for part in seed.TITLES[language])
            yield title, {len(title)}


def perceptron(examples: Iterator[tuple[list[Candidate], list[int]]]) -> Model:
    """An averaged structured perceptron: weights of what is right go up and of what was guessed instead down."""
    w: dict[str, float] = defaultdict(float)
    total: dict[str, float] = defaultdict(float)
    step = 0
    for cands, gold in examples:
        step += 1
        if not cands:
            continue
        guess = Model(w, tuple(w[f"p{k}"] for k in range(4))).decode(cands)
        if guess == gold:
            continue
        for tags, sign in ((gold, 1.0), (guess, -1.0)):
            last = 0
            for (_, f), t in zip(cands, tags, strict=True):
                if t:
                    for x in f:
                        w[x] += sign
                        total[x] += sign * step
                w[f"p{2 * last + t}"] += sign * 0.1
                total[f"p{2 * last + t}"] += sign * 0.1 * step
                last = t
    mean = {k: v - total[k] / (step + 1) for k, v in w.items()}
    return Model({k: v for k, v in mean.items() if k not in ("p0", "p1", "p2", "p3") and v}, tuple(mean.get(f"p{k}", 0.0) for k in range(4)))


@lru_cache(maxsize=1)
def trained(rounds: int = 150, rng_seed: int = 3) -> Model:
    """The model of text with end marks, or with spaces between its sentences: trained on the seed corpus."""

    def examples() -> Iterator[tuple[list[Candidate], list[int]]]:
        for text, ends in _documents(rounds, random.Random(rng_seed)):
            cands = [c for c in candidates(text, 0, len(text), mask(text)) if c[1] != ("sure",)]
            yield cands, [int(p in ends) for p, _ in cands]

    return perceptron(examples())


@lru_cache(maxsize=1)
def tagger(rounds: int = 1500, rng_seed: int = 5) -> Model:
    """The model that tags every character of text without any marks: trained on stripped sentences."""

    def examples() -> Iterator[tuple[list[Candidate], list[int]]]:
        for text, ends in _stripped(rounds, random.Random(rng_seed)):
            cands = characters(text, 0, len(text))
            yield cands, [int(p in ends) for p, _ in cands]

    return perceptron(examples())


def mask(text: str) -> list[tuple[int, int]]:
    """Addresses, whose points are no end marks."""
    return [m.span() for m in MASKED.finditer(text)] if "://" in text or "@" in text or "www." in text else []


def paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """Stretches between blank lines, and headings of their own, without white space at their ends."""
    at, cuts = 0, [m.span() for m in BLANK.finditer(text)]
    if "#" in text:
        cuts = sorted([*cuts, *(s for m in HEADING.finditer(text) for s in ((m.start(), m.start()), (m.end(), m.end())))])
    for a, z in [*cuts, (len(text), len(text))]:
        lo, hi = at, a
        while lo < hi and text[lo] in WS:
            lo += 1
        while hi > lo and text[hi - 1] in WS:
            hi -= 1
        if lo < hi:
            yield lo, hi
        at = max(at, z)


def units(text: str, model: Model, tags: Model | None = None) -> list[tuple[int, int]]:
    """(start, end) of the sentence units of a text, in order; ``tags`` is the model for text without marks."""
    out = []
    masked = mask(text)
    for start, end in paragraphs(text):
        cands, by = candidates(text, start, end, masked), model
        if not cands and tags and (cands := characters(text, start, end)):
            by = tags
        at = start
        if cands:
            for (p, _), tag in zip(cands, by.decode(cands), strict=True):
                if tag and p > at:
                    out.append((at, p))
                    at = p
                    while at < end and text[at] in WS:
                        at += 1
        if at < end:
            out.append((at, end))
    return out


def split_sentences(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(``key``, ``unit``, ``char_start``, ``char_end``): the sentence units of every text, in order.

    Offsets are code points from 0, the end exclusive. A null, empty or blank text has no units. Rows that stand twice
    are taken twice; other columns are left out. One task holds one text at a time.
    """
    models = [(m.weights, m.pairs) for m in (trained(), tagger())]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, tags = (Model(*x) for x in models)
        for b in batches:
            rows, no, a, z = [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                if t:
                    u = units(t, m, tags)
                    rows += [i] * len(u)
                    no += range(len(u))
                    a += [x for x, _ in u]
                    z += [x for _, x in u]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(no, pa.int32()), pa.array(a, pa.int64()), pa.array(z, pa.int64())], names=[key, "unit", "char_start", "char_end"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(of, f"`{key}` {kind}, unit int, char_start long, char_end long")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sentence unit of every document."""
    return split_sentences(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "char_start", "char_end")


def cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every text: how many characters but white space its units have, and how many of its units don't begin after the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("text IS NOT NULL")
    u = split_sentences(docs)
    j = docs.join(u, "doc_id", "left")
    bare = F.length(F.regexp_replace(F.expr("substring(text, CAST(char_start AS INT) + 1, CAST(char_end - char_start AS INT))"), f"[{WHITE_SPACE}]", ""))
    before = F.lag("char_end", 1, 0).over(Window.partitionBy("doc_id").orderBy("unit"))
    j = j.withColumn("n", F.coalesce(bare, F.lit(0)).cast("long")).withColumn("bad", F.coalesce((F.col("char_start") < before).cast("int"), F.lit(0)))
    return j.groupBy("doc_id").agg(F.sum("n").alias("chars"), F.sum("bad").alias("gaps"))
