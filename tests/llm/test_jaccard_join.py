import random

from tidemark.llm.components import components
from tidemark.llm.jaccard_join import near_duplicates


def plain(rows, width, percent):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        size = min(width, len(words))
        sets.append({tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    classes = {}
    for i in range(len(rows)):
        classes.setdefault(root(i), []).append(rows[i][0])
    low = {k: min((x for x in v if x is not None), default=None) for k, v in classes.items()}
    return sorted(((rows[i][0], len(sets[i]), low[root(i)]) for i in range(len(rows))), key=repr)


def got(df, width, percent):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(df, width, percent).collect()), key=repr)


def corpus(seed):
    """Copies with few and many edits, chains of copies of copies, passages shared by different texts, and texts of their own."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(40))
    texts = []
    for _ in range(6):
        origin = [word() for _ in range(rng.choice([20, 60, 150]))]
        chain = list(origin)
        for _ in range(25):
            copy = list(origin)
            for _ in range(rng.randrange(0, 7)):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                del copy[rng.randrange(len(copy)) :][:3]
            texts.append(" ".join(copy))
            chain[rng.randrange(len(chain))] = word()
            texts.append(" ".join(chain))
    shared = " ".join(word() for _ in range(60))
    texts += [f"{' '.join(word() for _ in range(rng.randrange(3, 40)))} {shared}" for _ in range(40)]
    texts += [" ".join(word() for _ in range(rng.randrange(1, 50))) for _ in range(40)] + ["a", "A", "a b", "a  b\n", "", " ", None]
    rng.shuffle(texts)
    return [(i * 3 % 1009, t) for i, t in enumerate(texts)]


def test_classes_equal_all_pairs(spark):
    for seed, width, percent in ((1, 4, 85), (2, 5, 80), (3, 2, 60)):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        assert got(df, width, percent) == plain(rows, width, percent)


def test_odd_and_empty(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got(odd, 5, 80) == plain(rows, 5, 80)
    assert near_duplicates(none).collect() == []


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    rows = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert rows == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 140)}}
