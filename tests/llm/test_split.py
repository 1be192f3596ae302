from hypothesis import given, settings
from hypothesis import strategies as st

from pruefwerk.llm.split import cut_positions, split_oversized

SCHEMA = "id bigint, text string, record_id string, piece_no string"


def pieces_of(spark, texts, most, overlap):
    rows = [(i, t, None, None) for i, t in enumerate(texts)]
    return split_oversized(spark.createDataFrame(rows, SCHEMA), "id", "text", most, overlap).orderBy("record_id", "piece_no").collect()


def test_pieces_join_up_to_the_text(spark):
    long = "Ein Satz über Register. Noch ein Satz 😀 mit Zeichen.\n\n" * 120
    texts = [None, "", "x" * 300, "x" * 301, long, long, "ohnebruch" * 400, "\n# Titel\n" + "Wort " * 200]
    rows = pieces_of(spark, texts, 300, 40)
    by = {}
    for r in rows:
        by.setdefault(r.record_id, []).append(r)
    assert sorted(by) == [3, 4, 5, 6, 7]
    for i, parts in by.items():
        assert [p.piece_no for p in parts] == list(range(1, parts[0].n_pieces + 1))
        assert all(len(p.piece) <= 300 for p in parts)
        assert parts[0].piece + "".join(p.piece[40:] for p in parts[1:]) == texts[i]
        for a, b in zip(parts, parts[1:]):
            assert b.piece[:40] == a.piece[-40:]
        assert all(texts[i][p.start_char :].startswith(p.piece) for p in parts)


def test_cuts_are_at_the_strongest_boundary():
    text = "Wort " * 30 + "Ende.\n\n" + "Wort " * 30
    assert cut_positions(text, 200, 20)[1] == text.index("\n\n") + 2


def test_empty_table(spark):
    assert pieces_of(spark, [], 300, 40) == []


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .\n#,é", max_size=900), st.integers(30, 90), st.integers(0, 14))
def test_every_piece_is_under_the_limit(text, most, overlap):
    if len(text) <= most:
        return
    starts = cut_positions(text, most, overlap)
    ends = [*starts[1:], len(text)]
    for i, (a, b) in enumerate(zip(starts, ends)):
        assert b - a + (overlap if i else 0) <= most
        assert b > a and (i == len(starts) - 1 or b - a + (overlap if i else 0) >= overlap)
