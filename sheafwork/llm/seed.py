"""Seed corpus for the sentence model: invented sentences whose ends are known.

Fixed values. Each language has single sentence units that show what a point, a quotation or a
bracket may be besides an end.
"""

#: Marks after which a following sentence may stand without a space.
TIGHT = "!?。！？؟।"

SENTENCES: dict[str, list[str]] = {
    "en": [
        "The lamp is on.", "Who moved the ladder?", "Stop that at once!", "It rained for an hour.", "We bought nails, glue, string, etc.", "Bolts, nuts, etc. are on the shelf.",
        "Dr. Harlow and Ms. Pine left at 9 a.m. by train.", "They came back at 4 p.m.", "See Fig. 3 and Sec. 4.2 before you go.", "The sign (cf. page no. 7, p. 12) is wrong.",
        "Approx. 3.5 kg vs. 4.1 kg is the gap.", "It weighs 2.5 kg, i.e. less than before.", "Ask P. Q. Larkin about it.", "Mr. Stone, e.g. on Mondays, sings.", "Next to bay No. 5 is a door.",
        "“Is it late?” asked the clerk.", "\"Stop the car!\" she cried.", "‘Never mind.’ was all he said.", "The guard wrote: \"The gate was shut.\"", "“I am done,” he said.", "She called it “a mess”.",
        "It went on ... then the light failed.", "Wait… the box is open?!", "Nobody knew…", "Version v2.1 is in setup.cfg now.", "Write to a.b@c.example or open https://d.example/e.html from here.",
        "bMail keeps the letters.", "Set it to 3e-5 and go.", "(The key is under the mat.)", "He left (see p. 4).", "The answer is no.", "There are 26.", "Was it B-4411?", "The tag says HV-8410.",
        "30 boxes came.", "12 men ran.", "5 lamps broke.", "4411 is his number.", "See Figs. 2 and 3.", "He wears a cap.", "It is cold in the tab.", "The firm is Ray & Sons Ltd.", "Inc. and Ltd. firms pay.", "[Draft. Not final.] is stamped on it.", "Our guide (a cook. A good one.) laughed.", "We met J. Wood.",
    ],
    "de": [
        "Die Lampe brennt.", "Wer hat die Leiter bewegt?", "Halt!", "Im Korb liegen Nägel, Leim usw.", "Nägel, Leim usw. liegen im Korb.", "Um ca. 9 Uhr kam Frau Dr. Hell.",
        "Der 3. Anlauf dauerte 2,5 Std. und kostete viel.", "Am 7. Mai fuhr er fort.", "Vgl. Abb. 4 und Nr. 5,2 auf S. 9.", "Er wog z. B. 3.5 kg, d. h. zu viel.", "Das Tor bzw. die Tür klemmt … aber er blieb.",
        "„Ist es spät?“, fragte die Wache.", "„Halt!“ rief sie.", "Herr Prof. Stein meint: „Es ist kalt.“", "Die Datei a.cfg der Version 2.1.3 fehlt.", "Sie sagte: »Das reicht.«", "Es sind 26.", "(Siehe oben.)",
        "Im Jahr 1990 war es warm.", "Die 2. Fassung gilt.", "Der 2. Gang zum Keller dauerte lang.", "Das 12. Fass war leer.", "Im 4. Stock brennt Licht.", "Der 5. Brief kam spät an.", "Seite 14 der Akte fehlt.", "Das Teil heißt KM-3611.", "Es dauert 3 Min.", "Regal 30 ist leer.", "5 Kisten fehlen.", "27 Leute kamen.",
    ],
    "fr": [
        "La lampe est allumée.", "Qui a bougé l'échelle ?", "Ne touchez rien !", "Des clous, de la colle, etc. restent ici.", "Il a pris des clous, de la colle, etc.", "Le Dr Morel écrit : «\xa0La vanne est à changer.\xa0»",
        "«\xa0Est-ce tard\xa0?\xa0» demande le gardien.", "M. Petit a mesuré 3.5 bars, cf. p. 9, avant la nuit.", "On attendait… mais rien ne venait.", "Le fichier a.cfg (éd. 2,1) règle tout.", "La série no. 4 est finie.",
        "Mme Roy et M. Gil sont là.", "« Assez ! » dit-elle.", "Il a dit « non ».", "C'était fini...", "La fiche EW-9302 manque.", "Il en reste 26.", "40 caisses sont là.",
    ],
    "es": [
        "La lámpara está encendida.", "¿Quién movió la escalera?", "¡No toque nada!", "Clavos, cola, etc. van aquí.", "Compró clavos, cola, etc.", "El Sr. Gil midió 3.5 bares, p. ej. en casa, antes de salir.",
        "La Dra. Vega escribió: «La válvula está rota.»", "—¿Es tarde? —preguntó el guardia.", "Esperamos... pero no vino.", "Aprox. 3.5 litros, según la pág. 5, salieron.", "El lote n.º 7 está listo.", "El archivo a.cfg es de la versión 2.1.3.",
        "«¿Dónde está?» dijo.", "Así fue…", "Quedan 26.", "40 cajas llegaron.", "3 personas vieron todo.", "El equipo SC-8641 falla.", "¡Qué frío!",
    ],
    "ru": [
        "Лампа горит.", "Кто сдвинул лестницу?", "Стойте!", "В ящике гвозди, клей и т. д.", "Гвозди, клей и т. д. лежат в ящике.", "А. В. Белов измерил 3.5 бар, т. е. норму.", "См. рис. 4 и табл. 5, прежде чем начать.",
        "В 2019 г. насос сменили.", "Его построили в 1990 г.", "«Неужели поздно?» — спросил сторож.", "Она сказала: «Хватит.»", "Мы ждали… но никто не пришёл.", "Файл a.cfg нужен.", "Осталось 26.", "40 ящиков пришло.", "Проф. Лист ушёл.", "Деталь VD-7259 цела.",
        "«Хватит!» — крикнула она.",
    ],
    "ar": [
        "المصباح مضاء.", "من حرك السلم؟", "لا تلمس الباب الآن!", "قال د. كريم إن الباب مغلق.", "«هل الوقت متأخر؟» سأل الحارس من البيت.", "كتب الفني: «الباب مكسور.»", "بلغ الضغط 3.5 بار اليوم.", "الجهاز LD-66 قديم.", "انتظرنا... لكن لم يأت أحد.",
        "قالت: «هل انتهيت؟»", "بقي 26.", "40 صندوقا وصلت.",
    ],
    "hi": [
        "दीपक जल रहा है।", "सीढ़ी किसने हटाई?", "इसे अभी मत छुएँ!", "डॉ. शर्मा ने 3.5 बार मापा और लिखा।", "\"क्या देर हो गई है?\" चौकीदार ने पूछा।", "उसने लिखा: \"दरवाज़ा टूटा है।\"", "81 मिनट रुकें।", "हम रुके... पर कोई नहीं आया।", "सामान, दस्ताने आदि यहाँ रखें।",
        "40 डिब्बे आए।", "TH-14 पर 8.4 kg दिखा।", "“रुको!” उसने कहा।",
    ],
    "zh": [
        "灯亮着。", "谁动了梯子？", "不要碰门！", "见第3.2节，然后关灯……再看门。", "李明（管理员。夜班）关了门。", "“现在晚了吗？”门卫问道。", "他写道：“门坏了。”", "参数写在a.cfg里，数值为3.5。", "真的吗？！", "设备VP-8显示2.5bar，但是灯仍然亮着。", "我们等了……但是没有人来。",
        "「停！」她喊道。", "（见附录。）", "技术员说：「灯坏了。快换！」",
    ],
    "ja": [
        "灯りがついています。", "誰がはしごを動かしましたか？", "扉に触れないでください！", "「遅いですか？」と門番が尋ねました。", "「止めて。早く！」と叫んだ人は外にいました。", "田中さん（係。夜勤）は扉を閉めました。", "第3.2節を読み、灯りを消します。", "設定はa.cfgにあり、値は3.5です。", "本当に壊れたのですか！？", "待っていた……しかし誰も来なかった。",
        "彼は書いた。", "FP-35の表示は2.5barです。", "『終わり。』と書いてあります。",
    ],
    "th": [
        "ไฟติดอยู่", "ใครย้ายบันได", "กรุณารอ 11 นาทีแล้วปิดประตู", "เครื่อง MC-43 แสดงค่าสูง", "ผู้ตรวจบอกว่าเสียบ่อย ๆ ในช่วงกลางคืน", "ไฟล์ a.log ใช้ตั้งค่าเครื่อง", "ค่าที่วัดได้คือ 3.5 บาร์ในห้อง", "ฝนตกหนักมาก", "อย่าแตะประตู", "เด็กได้ทำความสะอาดห้อง", "มีของเก่า ๆ อยู่", "น้ำหมดแล้ว",
        "วันที่ 5 ฝนตก", "รอ 3 วัน",
    ],
}

#: Parts of invented sentences in scripts without spaces, as lists to choose from, one after another.
PATTERNS: dict[str, list[list[list[str]]]] = {
    "zh": [
        [["", "今天", "昨天", "明天", "早上", "晚上", "上个月", "现在", "后来", "周末"], ["我", "你", "他", "她", "我们", "他们", "老师", "工人", "妈妈", "经理", "邻居", "孩子们", "这位客人", "小李"], ["去", "来", "回", "到", "去过"], ["学校", "公园", "商店", "北京", "医院", "车站", "办公室"], ["", "了", "买东西", "看朋友", "上班", "散步", "开会了"]],
        [["我", "你", "他", "她", "我们", "大家", "师傅", "姐姐", "那个人"], ["看了", "买了", "修好了", "洗了", "写完了", "打开了", "喜欢", "需要", "想要", "正在找", "没有带", "忘了"], ["一本书", "两个苹果", "水泵", "机器", "报告", "窗户", "衣服", "钥匙", "新电脑", "这份文件"]],
        [["天气", "水", "这个房间", "那台机器", "饭菜", "路", "他的声音", "外面", "价格", "问题"], ["很", "非常", "不太", "有点", "真"], ["好", "冷", "热", "大", "干净", "便宜", "远", "安静", "复杂", "奇怪"], ["", "了", "啊"]],
        [["你", "你们", "他", "老板", "客人"], ["是不是", "什么时候", "为什么", "会不会", "能不能", "要不要"], ["来", "走", "吃饭", "回家", "打电话", "休息", "参加会议"], ["", "呢", "啊"]],
        [["你", "他", "大家", "你们"], ["吃饭", "下班", "准备好", "听见", "明白", "到家"], ["了吗", "了没有", "吗"]],
        [["请", "请你", "别", "不要", "我们"], ["关门", "坐下", "等一下", "说话", "慢慢走", "早点睡", "一起吃饭"], ["", "吧", "好吗"]],
        [["因为下雨", "虽然很累", "如果你有空", "吃完饭以后", "下课的时候", "听到消息后"], ["我们", "他", "大家", "孩子", "我"], ["都", "就", "还是", "马上", ""], ["回家", "出去玩", "继续工作", "睡觉", "高兴", "走"], ["了", "起来", ""]],
        [["这", "那", "这里", "他", "她哥哥"], ["是", "不是"], ["我的书", "一个老师", "学校", "一家工厂", "新来的医生", "去年买的车"]],
    ],
    "ja": [
        [["", "今日", "昨日", "明日", "朝", "先週", "今", "その後"], ["私は", "彼は", "彼女は", "母は", "先生は", "子供たちは", "友達が", "田中さんは", "猫が"], ["学校へ", "公園に", "店で", "駅まで", "会社に", "家で"], ["行きます", "行きました", "来ます", "来ました", "働いています", "寝ています", "行った", "着いた"]],
        [["私は", "彼は", "姉が", "みんなで", "父は", ""], ["本を", "水を", "窓を", "写真を", "手紙を", "新しい車を", "ご飯を"], ["読みます", "読みました", "飲みました", "開けてください", "撮りました", "書いた", "買いました", "食べた", "見ています"]],
        [["天気が", "この部屋は", "水は", "値段が", "外は", "その機械は"], ["とても", "少し", "かなり", ""], ["いいです", "寒いです", "きれいでした", "高いです", "静かだ", "安かった", "古いです", "暑い"]],
        [["これは", "それは", "彼は", "ここは"], ["私の本", "学生", "駅", "新しい工場", "去年の写真", "医者"], ["です", "でした", "だ", "ではありません", "ですか"]],
        [["雨が降ったので", "疲れていたけれど", "時間があれば", "駅に着いてから"], ["私は", "みんな", "彼は", "すぐ", ""], ["帰りました", "出かけます", "仕事を続けました", "休みました", "電話します"]],
        [["どこへ", "何を", "いつ", "誰が"], ["行きますか", "しますか", "来ますか", "食べましたか"]],
    ],
}

#: Titles of a script without spaces, which are one unit.
TITLES: dict[str, list[list[str]]] = {
    "zh": [["水泵", "机器", "仓库", "设备", "客户", "安全", "春季", "夜间", "员工", "图书"], ["检查", "维修", "使用", "管理", "清洗", "培训", "借阅", "运输"], ["记录", "说明", "手册", "报告", "方法", "表", "规定", "常见问题", "指南"]],
    "ja": [["機械", "倉庫", "設備", "安全", "図書", "窯", "夜間", "顧客"], ["点検", "修理", "使用", "管理", "清掃", "研修", "貸出"], ["記録", "説明", "の手引き", "報告", "の方法", "表", "について"]],
}
