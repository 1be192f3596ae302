"""Queries of the numbered problems do their whole job where texts are longer than a cut would show."""

from pruefwerk.llm.pairs import defective_pairs
from pruefwerk.llm.residue import training_parts


def test_defects_of_answers_of_any_length(spark):
    q = "Was versteht man unter Registerblock, und wodurch unterscheidet sich dieser Begriff von der Pfadregel?"
    sound = "Unter Registerblock versteht man den Speicher mit genau 12 Einträgen. Die Pfadregel ist davon nicht betroffen. "
    refusal = "Leider kann ich diese Frage nicht beantworten. Bitte wenden Sie sich an die Kursleitung. "
    answers = [refusal * 12, " ".join([q] * 9), "\n".join(["Frage: " + q] * 40), "n/a" + " - " * 100, "\n" * 300 + "(Keine Angabe)", refusal * 12 + sound, (sound * 20).strip(), q + " " + sound * 20]
    found = defective_pairs(spark.createDataFrame([(i, q, a) for i, a in enumerate(answers)], "id bigint, q string, a string"), "q", "a")
    assert {r.id: r.defect for r in found.collect()} == {0: "refusal", 1: "copied_question", 2: "copied_question", 3: "empty", 4: "empty"}


def test_residue_learns_from_every_part_within_its_bounds(spark):
    sentence = "Der Scheduler ordnet jedem Prozess eine feste Zeitscheibe zu und legt danach die Reihenfolge der Wartenden fest. "
    long = "\n\n".join(sentence * 4 for _ in range(10))
    docs = spark.createDataFrame([(i, long if i < 12 else sentence * 2) for i in range(40)], "doc_id bigint, text string")
    assert len(long) > 3000 and training_parts(docs).count() == 12 * 40 + 28 * 2
