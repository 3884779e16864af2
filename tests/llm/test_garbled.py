from tesserae.llm import garbled as G

S = "doc_id bigint, text string, spans int"
GOOD = ["Die Änderung läuft später über Größe.", "La función leyó más de una línea.", "In Zoë’s words: “done” — so Ångvik.", "Следующий шаг: сравнить таблицы.", "次の手順は索引を作り直すことです。", "Cost ≈ 5 € per run, 4 °C."]


def corpus():
    return [(k, f"{GOOD[k % len(GOOD)]} {k}") for k in range(120)]


def scan(spark, rows):
    return {r.doc_id: r for r in G.scan(spark.createDataFrame([(*r, 1) for r in rows], S)).collect()}


def test_restores(spark):
    bad = [
        (1000, G.misread(GOOD[0], "utf-8", "cp1252")), (1001, G.misread(GOOD[1], "utf-8", "latin-1")), (1002, G.misread(GOOD[2], "utf-8", "cp1250")), (1003, G.misread(GOOD[3], "koi8-r", "cp1251")),
        (1004, G.misread(GOOD[0], "utf-8", "cp437")), (1005, G.misread(G.misread(GOOD[0], "utf-8", "latin-1"), "utf-8", "latin-1")), (1006, "plain start, " + G.misread("später", "utf-8", "cp1252") + ", und später weiter"),
        (1007, G.misread(GOOD[4], "utf-8", "latin-1")), (1008, G.misread("La función leyó más.", "cp1252", "mac-roman")),
    ]
    got = scan(spark, corpus() + bad)
    assert set(got) == {d for d, _ in bad}
    for d, want in ((1000, GOOD[0]), (1001, GOOD[1]), (1002, GOOD[2]), (1004, GOOD[0]), (1005, GOOD[0]), (1006, "plain start, später, und später weiter"), (1007, GOOD[4])):
        assert got[d].restored == want and got[d].complete, d


def test_mentions_and_defined_cases(spark):
    rows = corpus() + [
        (1, None), (2, ""), (3, "   "), (4, 'a test named "shows_Ã¼_when_latin1"'), (5, "a search for `Ã©` means"), (6, "Do not strip � (U+FFFD) here"), (7, "print `�` for each"), (8, "n�mlich, �ber"), (9, "flags 'â€™' in it"),
    ]
    rows = [(d + 5000 if d > 9 or t in (c for _, c in corpus()) else d, t) for d, t in rows]
    got = scan(spark, rows)
    assert set(got) == {8} and not got[8].complete
    assert scan(spark, []) == {}


def test_long_text(spark):
    long = "später " * 20000 + G.misread("Änderung", "utf-8", "cp1252")
    got = scan(spark, corpus() + [(999, long)])
    assert got[999].spans >= 1 and got[999].restored.endswith("Änderung")


def test_chunks_are_whole_words():
    got = G.chunks("A função de tun e a repetição mudou; até já. „Prüfung“ isn’t 5 °C — see 4° é que")
    assert got == {"função", "repetição", "até", "já", "„Prüfung“", "Prüfung", "isn’t", "°C", "— see", "é que"}


def test_garbling_of_many_documents(spark):
    many = [(2000 + k, G.misread(GOOD[3], "cp1251", "cp1252")) for k in range(8)] + [(2100 + k, G.misread(GOOD[1], "cp1252", "mac-roman")) for k in range(8)]
    got = scan(spark, corpus() + many)
    assert set(got) == {d for d, _ in many}
    assert got[2000].restored == GOOD[3] and got[2100].restored == GOOD[1]


def test_evidence_of_a_form():
    assert G.certain("çàïèñü", "запись", 50, 60, G.AMBIGUOUS) and G.certain("gPRS÷e", "größe", 90, 60, G.AMBIGUOUS)
    assert G.certain("запись", "çàïèñü", 60, 50, G.AMBIGUOUS) is None  # never the correct one by the garbled one
    assert G.certain("nćo", "não", 10, 60, G.AMBIGUOUS) is False and G.certain("nćo", "não", 1, 60, G.AMBIGUOUS)
    a = G.fixed_automaton()
    own = {g: (x, False, frozenset([("cp1252", "cp1257")])) for g, x in (("nćo", "não"), ("mćo", "mão"))}
    assert G.spans("nćo", a, own) == [] and len(G.spans("nćo e mćo", a, own)) == 2
    assert G.natural("¡Faltan") == G.natural("¿función") == G.natural("°C") == 2 and G.natural("°Faltan") == 0


def test_whatever_the_corpus_holds(spark):
    """One garbled document among clean ones of another kind: neither its words nor its characters occur elsewhere, at any size of the corpus."""
    greek, polish, kanji = "Η βάση δεδομένων άλλαξε χθες", "Zażółć gęślą jaźń", "鬱蒼とした森"
    bad = [
        (1, G.misread(greek, "utf-8", "cp1252"), greek), (2, "then " + G.misread("ł", "utf-8", "cp1252"), "then ł"), (3, G.misread(kanji, "utf-8", "cp1251"), kanji), (4, G.misread(polish, "utf-8", "cp1250"), polish),
        (5, G.misread(kanji, "euc-jp", "latin-1"), kanji), (6, "x " + G.misread("ø", "utf-8", "cp437"), "x ø"), (7, "209Ã—7366 cells", "209×7366 cells"), (8, "one â†’ two → three", "one → two → three"),
        (9, "See Â§ 1181, 119 Ã— 2720 ¶ 8", "See § 1181, 119 × 2720 ¶ 8"), (10, "## " + G.misread("影響", "cp932", "cp1252") + "\n\n記憶領域が不足した", "## 影響\n\n記憶領域が不足した"),
        (11, "ok " + G.misread("✅ 👍 Ångvik", "utf-8", "cp1252"), "ok ✅ 👍 Ångvik"), (12, "таблицы Рё x", "таблицы и x"),
    ]
    for size in (10, 3000):
        clean = [(1000 + k, f"Plain words only, {k} of them; naïve") for k in range(size)]
        got = scan(spark, clean + [b[:2] for b in bad])
        assert {k: r.restored for k, r in got.items()} == {b[0]: b[2] for b in bad} and all(r.complete for r in got.values())


def test_correct_text_that_looks_garbled(spark):
    rows = ["la créée année, naïve et coïncidée", "пёс и копёр у реки; Рёбра", "‚Übung‘ macht den Meister", "caféAuLait et éA", "from –∞ to +∞", "IRMÃ” e AMANHÃ…", "ATENÇÃO: INFORMAÇÃO E Þóra", "a repetição", "ää öö üü jää-äär", "Łódź, Ångström — „Ärger“ … “Ö”", "the façade’s “nested” part isn’t “done” for Mañuel — ¿no? À la une, É bom"]
    assert scan(spark, list(enumerate(rows))) == {}


def test_many_rounds(spark):
    text = "Die Größe läuft über"
    for k in range(1, 6):
        text = G.misread(text, "utf-8", "latin-1" if k % 2 else "cp1252")
        got = scan(spark, [*corpus(), (900, text)])[900]
        assert got.restored == "Die Größe läuft über" and got.complete, k
    lost = scan(spark, [*corpus(), (901, "Gr� und " + G.misread("über", "utf-8", "cp1252"))])[901]
    assert "über" in lost.restored and not lost.complete


def test_rare_words(spark):
    rows = corpus() + [(500 + k, f"Потом Żółwiński видит редкость {k}") for k in range(4)]
    bad = [(900, "then " + G.misread("редкость", "cp866", "cp1252")), (901, "then " + G.misread("Żółwiński", "iso8859-2", "cp850")), (902, "then " + G.misread("видит", "cp1251", "latin-1"))]
    got = scan(spark, rows + bad)
    assert set(got) == {900, 901, 902}
    assert [got[k].restored for k in (900, 901, 902)] == ["then редкость", "then Żółwiński", "then видит"]
