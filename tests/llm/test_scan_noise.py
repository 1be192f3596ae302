import random

from pruefwerk.llm.scan_noise import Vocabulary, corrected, furniture, is_header, line_parts, looks, paragraphs, repair, without_furniture

BODY = "Das Register speichert einen Wert und die Steuerung liest ihn wieder aus. Der Vergleich der beiden Werte dauert einen Takt."
WORDS = Vocabulary(frozenset(BODY.lower().replace(".", "").split() + ["vergleichswert"]), {looks(w): w for w in BODY.lower().replace(".", "").split()})


def test_looks():
    for good, bad in [("menge", "rnenge"), ("hash", "liasli"), ("über", "iiber"), ("takt", "talct"), ("wert", "vvcrf"), ("einen", "e1ncri")]:
        assert looks(good) == looks(bad)
    assert looks("dem") != looks("den")


def test_line_parts():
    assert line_parts("– 23 –")[:3] == ("", 23, "– # –")
    assert line_parts("Praxis der Theorie   Seite 7")[1:3] == (7, "Seite #")
    assert line_parts("12 / 80\tPraxis der Theorie")[0] == line_parts("Prax1s dcr Theorie")[0]
    assert line_parts("1.2 Steuerung")[1] is None
    assert line_parts("Kapitel 3: Bäume")[3] == line_parts("Kapitcl 4: Pfade")[3] == f"{looks('kapitel')} #"


def test_paragraphs():
    text, divided = paragraphs(["Der Ver-", "gleich der Read-", "Modify-Stufe, Ein- ", "und Ausgabe", "", "Neuer Absatz", "```", "a b", "c", "```"], WORDS)
    assert divided and text == "Der Vergleich der Read-Modify-Stufe, Ein- und Ausgabe\n\nNeuer Absatz\n```\na b\nc\n```"
    assert not paragraphs(["Die Read-", "Modify-Stufe"], WORDS)[1]
    assert paragraphs(["Der Ver­", "gleich"], WORDS) == ("Der Vergleich", True)


def test_corrected():
    assert corrected("Das Regisfer liesf", WORDS) == ("Das Register liest", True)
    assert corrected("S t e u e r u n g", WORDS) == ("Steuerung", True)
    for text in (BODY, "R21 und 0x1E, s2", "A  B  Y\n0  1  1", "```\nRegisfer\n```", "Fremdwort"):
        assert corrected(text, WORDS) == (text, False)


def test_operator(spark):
    rnd, rows, kinds, bodies = random.Random(2), [], {}, {}
    for page in range(1, 31):
        body = " ".join(rnd.sample(BODY.replace(".", "").split(), 12)) + " " + BODY + " " + " ".join(rnd.sample(BODY.replace(".", "").split(), 12))
        at = body.index(" ", 100)
        lines, own = [body[:at], body[at:].strip()], set()
        if page % 2:
            lines.insert(0, "Grundlagen der Technik" if page % 6 else "Grund1agen der Technik")
            own.add("running_header")
        if page % 3 == 0:
            lines.append(f"– {page + 2} –")
            own.add("page_number")
        if page == 8:
            lines.append("Ergebnis:\n10")
        if page == 10:
            lines[0], lines[1] = body[: body.index("Vergleich") + 3] + "-", body[body.index("Vergleich") + 3 :]
            own.add("hyphenation")
        if page == 14:
            lines = [line.replace("speichert", "speiehert") for line in lines]
            own.add("misread")
        kinds[page], bodies[page] = own, body
        rows.append(("p", page, "s", page, "\n".join(lines), "x"))
    rows += [("p", 100, "s", 40, None, "x"), ("p", 101, None, None, "", "x"), ("p", 102, None, 3, " \n", "x"), ("p", 103, "neu", 1, (BODY + "\n") * 400, "x")]
    rows += [("c", 200, "s", None, BODY + "\n– 7 –\nGrundlagen der Technik\n" + BODY, "x"), ("c", 201, "s", None, "Ergebnis:\n477", "x")]
    df = spark.createDataFrame(rows + [rows[0]], "field string, record_id bigint, script_id string, page_number int, text string, noise string")
    pages = df.where("field = 'p'").select("script_id", "page_number", "text")
    out = repair(df, pages).collect()
    assert len(out) == len(rows) + 1
    got = {(r.field, r.record_id): r for r in out}
    for page, own in kinds.items():
        assert set(got["p", page].noise) == own, page
        if page != 8:
            assert got["p", page].text == bodies[page]
    assert got["p", 100].text is None and got["p", 101].text == "" and got["p", 102].text == ""
    assert got["c", 200].noise == ["page_number", "running_header"] and got["c", 201].noise == []
    assert repair(df.limit(0), pages.limit(0)).count() == 0


def _pages(spark, texts, script="s"):
    return spark.createDataFrame([(script, i + 1, t) for i, t in enumerate(texts)], "script_id string, page_number int, text string")


def _body(rnd, n=6):
    nouns = ["Register", "Speicher", "Takt", "Knoten", "Baum", "Pfad", "Puffer", "Zähler", "Graph", "Befehl"]
    return "\n".join(f"{rnd.choice(['Ein', 'Jeder', 'Kein'])} {rnd.choice(nouns)} mit {rnd.randrange(999)} {rnd.choice(nouns)} liest {rnd.choice(nouns)} {rnd.randrange(99)}" for _ in range(n))


def test_long_headers(spark):
    rnd = random.Random(3)
    title = "Grundlagen der technischen Informatik und ihrer Anwendung in eingebetteten Systemen mit besonderer Rücksicht auf Speicher und Register, Teil zwei von vieren"
    assert len(title) > 130
    pages = _pages(spark, [title + "\n" + _body(rnd) for _ in range(20)])
    assert furniture(pages).first().headers == [line_parts(title)[0]]
    script = {"headers": [line_parts(title)[0]], "style": None, "distance": None, "first_number": None, "last_number": None}
    assert without_furniture([title, "Inhalt " * 40], 1, script, True) == (["Inhalt " * 40], {"running_header"})


def test_headers_that_are_garbled_on_every_page(spark):
    rnd = random.Random(4)
    title, texts = "Einführung in die Rechnerarchitektur", []
    for _ in range(30):
        letters = list(title)
        for at in rnd.sample(range(len(letters)), 2):
            letters[at] = rnd.choice("xyzjpä")
        texts.append("".join(letters) + "\n" + _body(rnd))
    assert len({t.split("\n")[0] for t in texts}) == 30
    headers = furniture(_pages(spark, texts)).first().headers
    found = [is_header(line_parts(t.split("\n")[0])[0], None, headers) for t in texts]
    assert sum(found) >= 27 and not any(is_header(line_parts(line)[0], None, headers) for t in texts for line in t.split("\n")[1:])


def test_sentences_that_begin_alike_are_no_headers(spark):
    rnd = random.Random(5)
    texts = ["Eine Verletzung dieser Regel erkennt man daran, dass " + _body(rnd, 1) + ".\n" + _body(rnd) for _ in range(12)]
    assert furniture(_pages(spark, texts)).first().headers == []


def test_words_and_lines_of_any_length():
    long = "donaudampfschifffahrtselektrizitätenhauptbetriebswerk"
    words = Vocabulary([long, "der", "bau"], {looks(long): long})
    assert len(long) > 45 and paragraphs(["Der Bau " * 40 + long[:25] + "-", long[25:]], words) == ("Der Bau " * 40 + long, True)
    assert corrected(long.replace("u", "v", 1), words) == (long, True)
    assert corrected("ab" * 30 + "1" + "cd" * 5, words)[1]
    line_parts("| " * 5000 + " " * 20000 + "x")  # at once
