import numpy as np
import pytest

from ledgerloom.llm import chosen_path, similarity_join

from ..conftest import rows
from .test_documents import near_copies, shingles, table


def components(items, percent):
    sets = {i: shingles(t) for i, t in items}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return sorted(((i, len(sets[i]), root(i), root(i) == i) for i in ids), key=repr)


COLUMNS = "doc_id", "n_shingles", "component_id", "kept"


@pytest.mark.parametrize("percent, leaf", [(85, 128), (85, 3), (60, 4)])
def test_chosen_path_against_all_pairs(spark, percent, leaf):
    items = list(enumerate(near_copies()))
    got = chosen_path.near_duplicates(table(spark, [(i, t, None, None) for i, t in items]), percent=percent, leaf=leaf)
    assert rows(got, *COLUMNS) == components(items, percent)


def test_one_of_each_component_stays(spark):
    items = list(enumerate(near_copies()))
    df = table(spark, [(i, t, None, None) for i, t in items] + [(None, items[0][1], None, None)] * 2)
    stay = {c for _, _, c, _ in components(items, 85)}
    left = chosen_path.deduplicated(df).collect()
    assert sorted(r["doc_id"] for r in left if r["doc_id"] is not None) == sorted(stay) and sum(r["doc_id"] is None for r in left) == 2
    assert left[0].__fields__ == df.columns


def test_edges(spark):
    assert chosen_path.near_duplicates(table(spark, [])).count() == 0
    blank = chosen_path.near_duplicates(table(spark, [(1, None, None, None), (2, " ", None, None)]))
    assert rows(blank, *COLUMNS) == [(1, 0, 1, True), (2, 0, 2, True)]
    again = chosen_path.near_duplicates(table(spark, [(7, "a b c d e f", None, None)] * 3 + [(9, "A b c\nd e f", None, None), (None, "a b c d e f", None, None), (None, "", None, None)]))
    assert rows(again, *COLUMNS) == sorted([(7, 2, 7, True)] * 3 + [(9, 2, 7, False), (None, 2, 7, False), (None, 0, None, True)], key=repr)


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("find", [similarity_join.similar_documents, chosen_path.near_duplicates])
def test_words_with_equal_sums_of_powers_are_not_linked(spark, find):
    word = thue_morse(512)
    other = word.translate({97: 98, 98: 97})
    items = [(1, f"{word} w x y z"), (2, f"{other} w x y z"), (3, f"{word} {other} w x y"), (4, f"{other} {word} w x y")]
    got = find(table(spark, [(*x, None, None) for x in items]))
    assert rows(got, "doc_id", "class_id", "component_id") == [(i, i, i) for i in (1, 2, 3, 4)]


def test_sets_that_are_equal_are_linked_whatever_the_order_of_words(spark):
    items = [(1, "a b c d e f " * 3), (2, "a b c d e f " * 5), (3, "z " * 9), (4, "z " * 90)]
    for find in (similarity_join.similar_documents, chosen_path.near_duplicates):
        assert rows(find(table(spark, [(*x, None, None) for x in items])), "doc_id", "component_id") == [(1, 1), (2, 1), (3, 3), (4, 3)]


def test_trees_reach_their_recall():
    """Sets of similarity 0.85, three levels down: more than 0.4 of trees hold both."""
    rng, met, n = np.random.default_rng(3), 0, 300
    for _ in range(n):
        base = rng.integers(0, 2**63, 216).astype(np.uint64)
        x, y = (np.unique(base[s]) for s in (slice(0, 200), slice(16, 216)))
        assert len(np.intersect1d(x, y)) / 216 == pytest.approx(0.852, abs=0.01)
        values = np.stack([np.frombuffer(b, dtype="<u4") for b in chosen_path.minwise([x, y])])
        node, used = (np.array([v, v], dtype=np.uint64) for v in (rng.integers(1, 2**62), 0))
        pair = [(node, used)]
        for _ in range(3):
            below = []
            for node, used in pair:
                row, child, mask = chosen_path.branches(node, used, values, 85)
                own = [{c: m for r, c, m in zip(row, child, mask, strict=True) if r == i} for i in (0, 1)]
                below += [(np.array([c, c], dtype=np.uint64), np.array([m, m], dtype=np.uint64)) for c, m in own[0].items() if c in own[1]]
            pair = below
        met += bool(pair)
    assert met / n > chosen_path.PER_TREE
    assert chosen_path.trees_for(0.9999) == 19


def test_minwise_values_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 1200).astype(np.uint64)
    x, y = np.unique(base[:900]), np.unique(base[300:])
    agree = [np.mean(np.equal(*(np.frombuffer(b, dtype="<u4") for b in chosen_path.minwise([x + np.uint64(k), y + np.uint64(k)])))) for k in range(40)]
    assert np.mean(agree) == pytest.approx(0.5, abs=0.03)
