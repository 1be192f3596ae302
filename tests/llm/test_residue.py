import random

import numpy as np
from pyspark.sql import functions as F

from pruefwerk.llm.residue import BUCKETS, FIELD, KINDS, _Hashes, features, fitted, held_out, kinds_of, parts_of, residue, validation, weak_kinds

NOUNS = ["Register", "Speicher", "Takt", "Knoten", "Baum", "Pfad", "Puffer", "Zähler"]


def content(rnd, n):
    return " ".join(f"Der {rnd.choice(NOUNS)} verwendet den {rnd.choice(NOUNS)} erst nach {rnd.randrange(90)} Zyklen im Normalfall." for _ in range(n))


def test_fields_and_code():
    assert FIELD in "".join(parts_of("Verantwortlich ist {{ name }}.")) and FIELD in "".join(parts_of("Abgabe bis [Datum ergänzen] in XXXX"))
    for text in ("Die Menge $\\{a, b\\}$", "Mit `${HOME}/bin` und `{{ titel }}`", 'f"{anzahl} Treffer"', "map[key] und a[i]", "<script> im Kopf", "Tupel $2^{3}$", "x < y und y > z"):
        assert FIELD not in "".join(parts_of(text)), text


def weak(text):
    parts = parts_of(text)
    return weak_kinds(parts, features([parts], _Hashes()).odd)


def test_weak_kinds_believe_the_context():
    assert weak("404 – Diese Seite wurde nicht gefunden.") == ["error_page"]
    quoted = weak("Lorem ipsum ist ein Blindtext. " + content(random.Random(1), 3))
    assert set(quoted) == {"content"}
    assert weak("wort wort wort wort wort") == weak("jfdw srdj swle wjrq") == ["filler"]
    assert weak("§ 5 des Gesetzes regelt die Vergabe der Plätze im Praktikum.") == ["content"]


def test_long_and_odd_parts_have_features():
    for part in ("x", "-----", "😀", "wort " * 5000, "a1b2" * 3000):
        found = features([[part, "Rest"], ["Ende"]], _Hashes())
        assert len(found.ids) == len(found.of) and set(found.of) == {0, 1, 2} and list(found.document) == [0, 0, 1]
        assert len(found.n_words) == 3 and found.n_words.min() >= 1 and 0 <= found.ids.min() and found.ids.max() < BUCKETS


def test_documents_are_featurized_alike_alone_and_together():
    rnd = random.Random(2)
    documents = [parts_of(content(rnd, rnd.randrange(1, 5)) + " asdf" * (i % 3)) for i in range(20)]
    together, at = features(documents, _Hashes()), 0
    for parts in documents:
        alone = features([parts], _Hashes())
        for i in range(len(parts)):
            assert sorted(alone.ids[alone.of == i]) == sorted(together.ids[together.of == at + i])
        at += len(parts)


def test_scores_alone_decide():
    weights, intercepts = np.zeros((len(KINDS), BUCKETS)), np.zeros(len(KINDS))
    intercepts[0] = 1
    assert kinds_of(["asdf " * 50, "{{ name }}", "404 Not Found", "wort wort wort wort wort wort", "Lorem ipsum"], weights, intercepts, _Hashes()) == [None] * 5


def test_operator(spark):
    rnd, rows, true = random.Random(4), [], {}
    kinds = {
        "error_page": lambda: rnd.choice(["404 – Die Seite wurde nicht gefunden.", "Zugriff verweigert. Bitte anmelden.", "Connection timed out after 30 ms", "Traceback (most recent call last):\n  File \"x.py\", line 3\nKeyError: 'a'"]),
        "script_notice": lambda: rnd.choice(["Bitte aktivieren Sie JavaScript, um die Seite zu sehen.", "This site requires JavaScript to run.", "Ihr Browser blockiert Skripte, daher bleibt die Seite leer."]),
        "filler": lambda: rnd.choice(["Lorem ipsum dolor amet ipsum lorem.", "This is sample text. Your text goes here.", "asdf asdf asdf asdf asdf asdf asdf"]),
        "placeholder": lambda: content(rnd, 1) + rnd.choice([" Verantwortlich ist {{ name }}.", " Die Abgabe ist am [Datum ergänzen].", " Aufgabe <THEMA HIER EINTRAGEN> folgt im Raum ${raum}."]),
    }
    for i in range(900):
        if i % 6 == 0:
            kind = list(kinds)[i // 6 % 4]
            rows.append((i, f"h{i % 23}", kinds[kind](), "x"))
            true[i] = kind
        else:
            rows.append((i, f"h{i % 23}", content(rnd, rnd.randrange(2, 6)), "x"))
    rows += [(2000, "h1", None, "x"), (2001, None, "", "x"), (2002, None, " \n", "x"), (2003, None, content(rnd, 2000), "x"), (2004, "h1", "Lorem ipsum nennt man einen Blindtext. " + content(rnd, 4), "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, kind string")
    found = {r.doc_id: r.kind for r in residue(docs).collect()}
    assert sum(found.get(i) == kind for i, kind in true.items()) >= 0.95 * len(true)
    assert len(set(found) - set(true)) <= 0.02 * len(rows) and not {2000, 2001, 2002, 2003} & set(found)
    report = {r.kind: r for r in validation(docs).collect()}
    assert all(report[kind].n_both >= 0.9 * report[kind].n_weak > 0 for kind in KINDS)
    assert residue(docs.limit(0)).count() == 0
    assert residue(docs.where("doc_id = 2003")).count() == 0


def test_unseen_hosts_and_phrases(spark):
    """On hosts that are left out, residue is found that no phrase names."""
    rnd, rows, planted = random.Random(6), [], {}
    ends = ["Zurück zur Startseite oder Anmeldung am Portal.", "Startseite des Portals, Anmeldung, Kontakt."]
    for i in range(1500):
        text = content(rnd, rnd.randrange(2, 5))
        if i % 5 == 0:
            text = rnd.choice(["404 Server Portal Adresse", "Error 503 Server Portal antwortet", "403 – Adresse im Portal gesperrt"]) + "\n" + rnd.choice(ends)
        rows.append((i, f"h{i % 40}", text))
    unseen = [f"h{h}" for h in range(40)]
    unseen = [r.source for r in spark.createDataFrame([(h,) for h in unseen], "source string").where(held_out()).collect()]
    for i, source in enumerate(unseen):
        planted[5000 + i] = "Adresse im Portal gesperrt, Server antwortet kaum.\n" + rnd.choice(ends)
        assert weak(planted[5000 + i]) == [None, None] or "error_page" not in weak(planted[5000 + i])
        rows.append((5000 + i, source, planted[5000 + i]))
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    model = fitted(docs)
    assert model is not None and planted and set(kinds_of(list(planted.values()), *model, _Hashes())) == {"error_page"}
    assert docs.where(held_out()).where(F.col("doc_id") >= 5000).count() == len(planted)
