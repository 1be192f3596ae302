import time

from pruefwerk.llm.pairs import copies_question, declines, defect_of, defective_pairs, stops_inside, tiles

Q = "Was versteht man unter Registerblock, und wodurch unterscheidet sich dieser Begriff von der Pfadregel?"
SOUND = "Unter Registerblock versteht man den Speicher mit genau 12 Einträgen. Die Pfadregel ist davon nicht betroffen."


def test_tiles_are_the_longest_common_runs():
    assert tiles("a b c d x a b".split(), "x a b c d".split()) == [(0, 1, 4)] or tiles("a b c d x a b".split(), "x a b c d".split())[0] == (0, 1, 4)


def test_tiles_of_words_that_repeat_are_found_at_once():
    began = time.perf_counter()
    assert tiles(["wort"] * 400, ["wort"] * 400) == [(0, 0, 400)] and copies_question("wort " * 400, "wort " * 400)
    assert sum(n for _, _, n in tiles("a b c a b d a b c d".split() * 50, "a b c d".split() * 50)) >= 150
    assert time.perf_counter() - began < 1


def test_declines():
    for text in (
        "Leider kann ich diese Frage nicht beantworten. Bitte wenden Sie sich an die Kursleitung.",
        "I'm sorry, but I cannot help with that request.", "Je ne peux pas répondre à cette question.", "Ich weiß es nicht.",
        "Mir ist die Regel nicht bekannt, sodass ich passen muss.", "Mir liegen dazu leider keine Angaben vor.", "Hierzu fehlen mir die Angaben.",
        "I do not have enough information. Please ask your lecturer.", "Das ist mir nicht möglich.", "Es tut mir leid. Dazu muss ich passen.", "Zu dieser Frage gebe ich keine Auskunft.", "Ik kan deze vraag niet beantwoorden.",
        "Lo siento, no puedo responder a esta pregunta.",
    ):
        assert declines(text), text
    for text in (
        "Leider ist der Block nicht eindeutig; festgelegt wird er erst durch die Regel.", "Es ist nicht möglich, beide Register zugleich zu lesen.",
        "Leider kann ich nur kurz antworten. " + SOUND, "Das Modul kann diese Eingabe nicht verarbeiten.", SOUND,
        "Der Block darf nicht leer sein.", "We cannot read both registers at once.", "Es fehlt der zweite Operand.", "Das Register ist nicht bekannt.", "Es ist kein Takt nötig.",
    ):
        assert not declines(text), text


def test_copies():
    for text in (Q, Q.upper(), f"Die Frage lautet: „{Q}“", f"{Q}\n{Q}", "  " + Q[:-1] + " ...", Q.replace("Begriff", "hier"), "Frage: " + Q):
        assert copies_question(Q, text), text
    for text in (SOUND, Q + "\n" + SOUND, "Registerblock und Pfadregel sind verwandt.", ""):
        assert not copies_question(Q, text), text


def test_stops_inside():
    for text in ("Der Wert ist 12 und die", "Der Wert beträgt $n \\geq", "Satz.\n```\nadd R1", "Satz (vgl. Reg", "Es gilt der Sa…", "Man spricht von „page li", "Das Sig",
        "Das ist **wichtig.", "<b>Das ist gut.", 'Er sagte: "das ist.', "1. Erster Punkt.\n2.", "Es gilt \\(a + b.", "Es gilt \\[x = 1", "Das ist <em", "| a | b |\n| 1 | 2", "| a | b |\n| 1 |",
        "- Ein Satz.\n- Noch ein Satz.\n- Und ein", "Gut.\n\n```\na[1\n"):
        assert stops_inside(text), text
    for text in (
        "Der Wert ist 12.", "Daraus folgt $n \\geq 3$", "Satz.\n\n```\nadd R1, R2\n```", "Satz. (vgl. Register)", "Satz.\n\n- Baum\n- Pfad", "| a | b |\n| 1 | 2 |",
        "Satz.\n\nErgebnis: 54 Bit", "Gut. Gesamturteil: B", "Knoten, Kanten usw.", "Er sagt „ja.“", "",
        "Das ist **wichtig**.", "<b>Das</b> ist gut.", 'Er sagte: "das ist."', "1. Erster Punkt.\n2. Zweiter.", "Es gilt \\(a + b\\).", "Mit `a[` geht es weiter.", "List<String> ist gut.", "a < b und b > c gilt.",
        "| a | b |\n|---|---|\n| 1 | 2 |", '5" und 7" sind die Größen.', "2**3 ist 8.", "- a\n- b", "Ein Zitat: \"offen\n\nNeuer Absatz.", "Erst $a$, dann $$b$$.", " \n", "...",
    ):
        assert not stops_inside(text), text


def test_first_defect_wins():
    assert defect_of(Q, SOUND) is None
    assert defect_of(Q, "Hay que comprobar además que el circuito de control no modifica la memoria compartida. En general") == "other_language"
    assert defect_of(Q, "Die Antwort nennt das logische") == "truncated"
    assert defect_of(Q, "Это ответ на другой язык, который мы не") == "other_language"


def test_operator(spark):
    rows = [
        (1, Q, None), (2, Q, ""), (3, Q, " —\n"), (4, Q, "k. A."), (5, Q, SOUND), (6, Q, SOUND), (7, Q, Q), (8, None, None), (9, " ", "Der"),
        (10, Q, "Der Wert ist"), (11, Q, "Ich darf dazu keine Auskunft geben."), (12, Q, (SOUND + " ") * 3000), (13, Q, "<leer>"),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows + rows[:1]], "id bigint, q string, a string, defects string")
    found = sorted((r.id, r.defect) for r in defective_pairs(df, "q", "a").collect())
    assert found == [(1, "empty"), (1, "empty"), (2, "empty"), (3, "empty"), (4, "empty"), (7, "copied_question"), (10, "truncated"), (11, "refusal"), (13, "empty")]
    assert defective_pairs(df.limit(0), "q", "a").count() == 0
