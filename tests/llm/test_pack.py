from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from pruefwerk.llm.pack import pack_documents, pack_histogram, packing_report, slot_table
from pruefwerk.llm.tokenizers import encoding


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 400), max_size=25))
def test_histogram_is_packed_whole(histogram):
    groups = pack_histogram(histogram, 60)
    packed = Counter()
    for packs, items in groups:
        assert packs > 0 and sum(length * copies for length, copies in items) <= 60
        for length, copies in items:
            packed[length] += packs * copies
    assert packed == Counter(histogram)
    slots = slot_table(groups)
    for length, n in histogram.items():
        own = slots[slots["size"] == length].sort_values("from_rank")
        assert own["from_rank"].iloc[0] == 0 and own["to_rank"].iloc[-1] == n
        assert (own["from_rank"].iloc[1:].values == own["to_rank"].iloc[:-1].values).all()


def test_documents(spark):
    texts = [None, "", "Wort " * 5, "Wort " * 5, "Wort " * 5, "Satz eins zwei drei. " * 90, "a"] + ["kurz und gut"] * 200
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("doc_id", "text", "'x' AS size", "0 AS container_kind")
    kinds = spark.createDataFrame([("a", "byte_bpe_50k", 64), ("b", "byte_bpe_multi_50k", 100)], "container_kind string, tokenizer string, capacity int")
    packed = pack_documents(docs, "doc_id", "text", kinds, together=50)
    rows = packed.collect()
    for kind, name, capacity in [("a", "byte_bpe_50k", 64), ("b", "byte_bpe_multi_50k", 100)]:
        own = [r for r in rows if r.container_kind == kind]
        fill, parts = Counter(), Counter()
        for r in own:
            fill[r.container_id] += r.part_tokens
            parts[r.doc_id] += r.part_tokens
        assert max(fill.values()) <= capacity
        assert dict(parts) == {i: len(encoding(name).encode_ordinary(t or "")) for i, t in enumerate(texts)}
        n = Counter(r.doc_id for r in own)
        assert all(n[i] == max(1, -(-parts[i] // capacity)) for i in parts)
        assert set(range(max(fill) + 1)) == set(fill)
        used = packing_report(packed, kinds).where(f"container_kind = '{kind}'").first()
        assert used.n_containers <= 1.2 * used.fewest_containers + 1


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    kinds = spark.createDataFrame([("a", "byte_bpe_50k", 64)], "container_kind string, tokenizer string, capacity int")
    assert pack_documents(docs, "doc_id", "text", kinds).count() == 0
    assert pack_documents(docs, "doc_id", "text", kinds.limit(0)).count() == 0
