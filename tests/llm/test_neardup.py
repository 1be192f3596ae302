import random
from itertools import combinations

import numpy as np
import pytest

from pruefwerk.llm.neardup import _band_keys, _features, all_pairs, groups, least_matches, near_copies, shares_words

SCHEMA = "field int, id bigint, text string, bag string, bands string"


def records(spark, texts):
    return spark.createDataFrame([(0, i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA)


def edited(rnd, words, share):
    out = list(words)
    for at in rnd.sample(range(len(out)), int(share * len(out))):
        out[at] = f"neu{rnd.randrange(10**6)}"
    if rnd.random() < 0.3:
        rnd.shuffle(out)
    return " ".join(out)


def brute(texts):
    known = [(i, t) for i, t in enumerate(texts) if t]
    return {(a, b) for (a, x), (b, y) in combinations(known, 2) if shares_words(x, y)}


def test_against_all_pairs(spark):
    rnd = random.Random(3)
    texts = [None, "", " .,- ", "eins", "Eins!", "eins zwei", "zwei eins", "lang " * 6000, "lang " * 5000]
    for _ in range(40):
        words = [f"wort{rnd.randrange(3000)}" for _ in range(60)] + ["der", "die", "das"] * 10
        texts += [" ".join(words)] + [edited(rnd, words, rnd.choice([0, 0.02, 0.05, 0.08, 0.5])) for _ in range(3)]
    texts += [texts[20]] * 30
    members, links = near_copies(records(spark, texts))
    found = [(r.id_a, r.id_b) for r in all_pairs(members, links).collect()]
    assert len(found) == len(set(found))
    assert set(found) ^ brute(texts) == set()
    rows = {r.id: r for r in groups(members, links).collect()}
    assert set(rows) == {i for i, t in enumerate(texts) if t and t.strip(" .,-")}
    for a, b in brute(texts):
        assert rows[a].group_id == rows[b].group_id
    degree = {i: 0 for i in rows}
    for pair in brute(texts):
        for i in pair:
            degree[i] += 1
    assert degree == {i: r.n_links for i, r in rows.items()}
    assert all(r.group_id == i for i, r in rows.items() if not r.n_links)


def test_long_chain_is_one_group(spark):
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words[i : i + 20]) for i in range(0, 120, 3)]
    members, links = near_copies(records(spark, texts))
    assert {r.group_id for r in groups(members, links).collect()} == {0}


def test_empty(spark):
    members, links = near_copies(records(spark, []))
    assert all_pairs(members, links).count() == 0 and groups(members, links).count() == 0


def test_bounds_are_those_of_the_posterior():
    for n, fewest in least_matches(0.6):
        assert 0 < fewest < 0.6 * n


@pytest.mark.parametrize("overlap", [0.75, 0.8])
@pytest.mark.parametrize("uncommon", [0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])
def test_recall_at_the_bound(uncommon, overlap):
    """Pairs of 200 words right at the bound, all edits in uncommon words: nine of ten are candidates at least."""
    rnd, found, n = np.random.default_rng(5), 0, 200
    for _ in range(300):
        of_uncommon = round(uncommon * n)
        edits = min(round((1 - overlap) * n), of_uncommon)
        words = rnd.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
        words[of_uncommon:] += np.uint64(1)  # odd words are common
        copy = words.copy()
        copy[:edits] = rnd.integers(0, 2**63, edits, dtype=np.uint64) * np.uint64(2)
        keys = [_band_keys(_features(np.sort(x)), np.sort(x) % 2 == 1, 0) for x in (words, copy)]
        found += bool(np.intersect1d(*keys).size)
    assert found >= 0.9 * 300


@pytest.mark.parametrize("uncommon", [0.4, 0.6, 0.8, 1.0])
def test_recall_at_the_bound_with_edits_everywhere(uncommon):
    rnd, found, n = np.random.default_rng(7), 0, 200
    for _ in range(300):
        words = rnd.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + (rnd.random(n) >= uncommon)
        copy = words.copy()
        at = rnd.choice(n, n // 4, replace=False)
        copy[at] = rnd.integers(0, 2**63, n // 4, dtype=np.uint64) * np.uint64(2) + words[at] % 2
        keys = [_band_keys(_features(np.sort(x)), np.sort(x) % 2 == 1, 0) for x in (words, copy)]
        found += bool(np.intersect1d(*keys).size)
    assert found >= 0.9 * 300
