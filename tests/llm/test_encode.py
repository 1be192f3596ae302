import random

from hypothesis import given, settings
from hypothesis import strategies as st

from pruefwerk.llm.encode import encode_parts, segments, token_ids
from pruefwerk.llm.tokenizers import encoding


def by_parts(text, unit):
    own = encoding("byte_bpe_50k")
    cut = segments(text, unit)
    assert "".join(part for _, part, _ in cut) == text
    return encode_parts([own.encode_ordinary(p) for _, p, _ in cut], [j for _, _, j in cut], own.encode_ordinary, own.decode_bytes)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aen s'tlÄé😀.,!1 \n\t漢​", max_size=200), st.integers(3, 40))
def test_segments_give_the_ids_of_the_whole(text, unit):
    assert by_parts(text, unit) == encoding("byte_bpe_50k").encode_ordinary(text)


def test_unsplit_texts():
    rnd = random.Random(5)
    for text in ["a" * 5000, " " * 4000, "😀" * 900, "".join(rnd.choice("abcdefghij'sltre!.0123") for _ in range(6000)), "\n \n" * 900]:
        for unit in (64, 500):
            assert by_parts(text, unit) == encoding("byte_bpe_50k").encode_ordinary(text)


def test_operator(spark):
    texts = [None, "", " ", "Hallo <|endoftext|> Welt", "Hallo", "Hallo", "Satz mit Wörtern. " * 700, "x" * 9000, "Zeile\n" * 3000]
    rows = [(i // 2 * 2 if i in (4, 5) else i, t, "ids") for i, t in enumerate(texts)]
    out = token_ids(spark.createDataFrame(rows, "key bigint, text string, doc_id string"), "key", "text", unit=512).collect()
    own = encoding("byte_bpe_50k")
    expected = sorted((i, own.encode_ordinary(t or "")) for i, t, _ in rows)
    assert sorted((r.doc_id, list(r.ids)) for r in out) == expected


def test_empty_table(spark):
    assert token_ids(spark.createDataFrame([], "key bigint, text string"), "key", "text").count() == 0
