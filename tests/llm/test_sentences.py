import random

import pytest
from pyspark.sql import functions as F

from sheafwork.llm import sentences as S

CASES = [
    ["He came at 8 a.m. in the rain.", "She left at 5 p.m.", "Was it late?"],
    ["Dr. Wells met J. R. Moore and Ms. Lake.", "They spoke."],
    ["Tools, rags, etc. are there.", "He took tools, rags, etc.", "Keep them dry."],
    ["It ran for a while ... then it stopped.", "Wait… the cap is off?!", "Yes."],
    ["“Is it shut?” asked the clerk from the hall.", "\"Stop it!\" she called across the yard.", "‘Never mind the cap.’ was all he said.", "He wrote: \"It is shut.\"", "Good."],
    ["(The foreman has the key.)", "See Fig. 3 and Sec. 4.5 on p. 7.", "Go."],
    ["Version v2.14 moved it to pump.cfg and https://x.example/a.b?c=1 now.", "Set 5e-5.", "qDepot keeps it."],
    ["Die Feier am 9. Mai kostete z. B. 3.5 bar, d. h. wenig.", "Der 2. Versuch dauerte 4 Std. und endete.", "„Ist es spät?“, fragte er.", "Im Korb liegen Band usw.", "Gut."],
    ["Le Dr Roy écrit : «\xa0La vanne est à changer.\xa0»", "«\xa0Est-ce tard\xa0?\xa0» demande-t-il.", "Fin !", "M. Petit est là."],
    ["—¿Está listo? —preguntó el conserje.", "¡No lo abra!", "El Sr. Gil dijo: «Queda así.»", "Esperamos... pero no."],
    ["А. В. Белов измерил 3.5 бар, т. е. норму.", "В ящике винты и т. д.", "В 2024 г. насос сменили.", "«Поздно?» — спросил он."],
    ["قال د. سروان إن الباب مغلق.", "«هل هو فارغ؟» سأل الحارس.", "كتب: «هو قديم.»", "نعم."],
    ["डॉ. ओझा ने 3.5 बार मापा।", "\"क्या वह ढीला है?\" उसने पूछा।", "रुको!"],
]


@pytest.mark.parametrize("sentences", CASES)
def test_cases(sentences):
    text, at, want = " ".join(sentences), 0, []
    for s in sentences:
        want.append(s)
        at += len(s) + 1
    assert [text[a:z] for a, z in S.units(text, S.trained())] == want


@pytest.mark.parametrize("sentences", [["档案员找到96个HR-3725。", "见第17.2节，然后冲洗……再看索引。", "蔺舟野（看门人。夜班）清洗了它。", "“是不是潮湿？”档案员问道。", "真的吗？！"], ["「止めて。早く！」と叫んだ人は外にいた。", "第4.2節を読みます。", "なぜですか？"]])
def test_scripts_without_spaces(sentences):
    text = "".join(sentences)
    assert [text[a:z] for a, z in S.units(text, S.trained())] == sentences


def test_thai():
    text = "กรุณารอ 11 นาทีแล้วปิดตัวกรอง เครื่อง MC-43 แสดงค่า ผู้ตรวจบอกว่าเสียบ่อย ๆ ในช่วงกลางคืน น้ำหมด"
    assert [text[a:z] for a, z in S.units(text, S.trained())] == ["กรุณารอ 11 นาทีแล้วปิดตัวกรอง", "เครื่อง MC-43 แสดงค่า", "ผู้ตรวจบอกว่าเสียบ่อย ๆ ในช่วงกลางคืน", "น้ำหมด"]


def test_lines_and_headings():
    text = "  A heading\n \nOne line\ngoes on. Two!Three?\r\n\r\nNext\n# Mark\nrest"
    assert [text[a:z] for a, z in S.units(text, S.trained())] == ["A heading", "One line\ngoes on.", "Two!", "Three?", "Next", "# Mark", "rest"]


def test_held_out_accuracy():
    m, wrong, all_ = S.trained(), 0, 0
    for text, ends in S._documents(40, random.Random(77)):
        got = {z for _, z in S.units(text, m)}
        wrong += len(got ^ ends)
        all_ += len(ends)
    assert wrong / all_ < 0.02


def test_units_cover_the_text():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice("ab A.!?…\"'“”()\n 。「」ก 1-é») «\xa0") for _ in range(rng.randint(0, 120)))
        at = 0
        for a, z in S.units(text, S.trained()):
            assert a < z and not text[at:a].strip() and text[a] not in S.WS and text[z - 1] not in S.WS
            at = z
        assert not text[at:].strip()


def test_viterbi_equals_enumeration():
    from itertools import product

    m = S.Model({"a": 0.7, "b": -0.4, "c": 0.1}, (0.2, -0.3, 0.1, -0.6))
    c = [(i, (f,)) for i, f in enumerate("abcacb")]

    def value(tags):
        v, last = 0.0, 0
        for (_, f), t in zip(c, tags, strict=True):
            v += m.pairs[2 * last + t] + (m.score(f) if t else 0)
            last = t
        return v

    assert value(m.decode(c)) == pytest.approx(max(value(t) for t in product((0, 1), repeat=6)))


UNMARKED = [
    ["今天天气很好", "我们去公园散步", "他没有来"],
    ["昨天老师买了两本书", "她很高兴"],
    ["私は昨日学校へ行きました", "先生はとても元気です", "明日も行きます"],
]


@pytest.mark.parametrize("sentences", UNMARKED)
def test_text_without_marks(sentences):
    text = "".join(sentences)
    assert [text[a:z] for a, z in S.units(text, S.trained(), S.tagger())] == sentences


def test_held_out_accuracy_without_marks():
    right = found = true = 0
    for text, ends in S._stripped(300, random.Random(91)):
        got = {z for _, z in S.units(text, S.trained(), S.tagger())}
        right, found, true = right + len(got & ends), found + len(got), true + len(ends)
    assert right / found > 0.95 and right / true > 0.95


def test_a_title_is_one_unit():
    for t in ("水泵维修记录", "设备检查方法", "機械の点検について", "図書貸出の手引き"):
        assert len(S.units(t, S.trained(), S.tagger())) == 1


@pytest.mark.parametrize(
    "sentences",
    [["မင်္ဂလာပါ။", "နေကောင်းလား။"], ["ខ្ញុំទៅផ្សារ។", "គាត់នៅផ្ទះ។"], ["བོད་ཡིག།", "སྐད་ཆ།"], ["ሰላም ነው።", "ደህና ነህ፧", "አዎ።"], ["Բարեւ ձեզ։", "Ինչպես եք։"]],
)
def test_marks_of_other_scripts(sentences):
    text = " ".join(sentences)
    assert [text[a:z] for a, z in S.units(text, S.trained(), S.tagger())] == sentences


def test_spaces_of_lao_and_khmer():
    for parts in (["ຂ້ອຍໄປຕະຫຼາດ", "ລາວຢູ່ເຮືອນ"], ["ខ្ញុំទៅផ្សារ", "គាត់នៅផ្ទះ"]):
        assert [" ".join(parts)[a:z] for a, z in S.units(" ".join(parts), S.trained())] == parts
    # with its own mark, Khmer's spaces are inside
    t = "ខ្ញុំទៅផ្សារ គាត់នៅផ្ទះ។ ចប់។"
    assert [t[a:z] for a, z in S.units(t, S.trained())] == ["ខ្ញុំទៅផ្សារ គាត់នៅផ្ទះ។", "ចប់។"]


def test_rows(spark):
    df = spark.createDataFrame([(1, "Aa bb. Cc dd."), (2, None), (3, ""), (4, " \n"), (1, "Aa bb. Cc dd."), (5, "x" * 200_000 + ". Y.")], "doc_id long, text string").withColumn("unit", F.lit("clash"))
    got = sorted((r["doc_id"], r["unit"], r["char_start"], r["char_end"]) for r in S.split_sentences(df).collect())
    assert got == [(1, 0, 0, 6), (1, 0, 0, 6), (1, 1, 7, 13), (1, 1, 7, 13), (5, 0, 0, 200_001), (5, 1, 200_002, 200_004)]
    assert S.split_sentences(df.limit(0)).count() == 0
