import random

from pruefwerk.llm.truncation import final_classes, other_defect, truncated, truncation_rates

ADJECTIVES = ["schnelle", "lokale", "globale", "leere", "geordnete", "statische"]
NOUNS = [a + b for a in ("Pfad", "Takt", "Kosten", "Symbol", "Seiten", "Kanal") for b in ("tabelle", "funktion", "leitung", "variable", "steuerung")]


def sentence(rnd):
    a, n, m = rnd.choice(ADJECTIVES), rnd.choice(NOUNS), rnd.choice(NOUNS)
    return rnd.choice([f"Die {a} {n} verwendet die {m} nicht.", f"Mit {rnd.randrange(99)} Bit wird die {n} dargestellt.", f"Für die {a} {n} gilt $n = {rnd.randrange(9)}$ immer."])


def records(spark):
    rnd, rows, cut = random.Random(1), [], set()
    for i in range(4000):
        text = " ".join(sentence(rnd) for _ in range(rnd.randrange(3, 8)))
        kind = rnd.random()
        if kind < 0.08:
            text = text[: rnd.randrange(len(text) // 2, len(text) - 3)]
            if text.rstrip().endswith(".") or text.rstrip().endswith("$"):
                text = text.rstrip(" .$")[:-2]
            text += rnd.choice(["", " ", "…", "...", "\n"])
            cut.add(i)
        elif kind < 0.16:
            text += rnd.choice(["\n\n- " + rnd.choice(NOUNS) + "\n- " + rnd.choice(NOUNS), "\n\nErgebnis: 12 Bit", "\n\n| a | b |\n| 1 | 2 |", "\n\n```\nadd R1, R2\n```"])
        rows.append(("k", i, text, f"m{i % 3}"))
    rows += [("k", 5000, None, "m0"), ("k", 5001, "", None), ("k", 5002, " .- ", None), ("k", 5003, "Ja", "m1"), ("k", 5004, sentence(rnd) * 500, "m1")]
    return spark.createDataFrame(rows, "kind string, id bigint, text string, model string"), cut


def test_found_and_rates(spark):
    df, cut = records(spark)
    found = truncated(df)
    ids = {r.id for r in found.collect()}
    assert len(ids & cut) >= 0.97 * len(cut)
    assert len(ids - cut) <= 0.02 * len(cut)
    rates = {r.model: r for r in truncation_rates(df, found, "model").collect()}
    assert sum(r.n_records for r in rates.values()) == df.count() and rates[None].n_truncated == 0
    assert sum(r.n_truncated for r in rates.values()) == len(ids)


def test_empty_and_tiny_tables(spark):
    df, _ = records(spark)
    assert truncated(df.limit(0)).count() == 0
    assert truncation_rates(df.limit(0), truncated(df.limit(0)), "model").count() == 0
    assert truncated(df.where("id >= 5000")).count() == 0


def test_final_words_of_any_length(spark):
    texts = ["Der kurze Satz " + "x" * 250, "Der Satz\n" * 90 + "wort", "a\n\n\nb", "Ein " + "sehr " * 300 + "langer Satz"]
    got = final_classes(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")).collect()
    assert {r.id: (r.a, r.b, r.c) for r in got} == {0: ("kurze", "Satz", "aa"), 1: ("Satz", "/", "wort"), 2: ("a", "/", "b"), 3: ("sehr", "aa", "Satz")}


def test_other_defects_in_sql_are_those_of_problem_3(spark):
    q = "Was versteht man unter Registerblock, und wodurch unterscheidet sich dieser Begriff von der Pfadregel?"
    texts = ["None", "Leider kann ich diese Frage nicht beantworten. Bitte wenden Sie sich an die Kurs", "Was versteht man unter Registerblock, und wodurch unterscheidet sich die", "Frage: " + q[:70],
             "Hay que comprobar además que el circuito de control no modifica la memoria compartida. En general", "Это ответ на другой язык, который мы не",
             "Unter Registerblock versteht man den Speicher mit genau 12 Einträgen. Die", "Die Pfadregel ist davon nicht", None]
    df = spark.createDataFrame([(i, q if i < 9 else None, t) for i, t in enumerate(texts)] + [(20, None, "None"), (21, " ", "Leider kann ich nicht helfen.")], "id int, question string, given string")
    assert sorted(r.id for r in other_defect(df, "question", "given").where("defective").collect()) == [0, 1, 2, 3, 4, 5, 8]
