from collections import Counter

from corpuslab.operators import splits


def corpus57(spark):
    return spark.createDataFrame([(i, "ABC"[i % 3]) for i in range(57)], "id int, label string")


def test_split_sizes_and_independence(spark):
    rows = splits.stratified_splits(corpus57(spark), "id", "label").collect()
    assert len(rows) == 57 * 5
    for s in range(5):
        test = [r for r in rows if r.split == s and r.role == "test"]
        assert Counter(r.label for r in test) == {"A": 4, "B": 4, "C": 4}
    sides = {s: frozenset(r.id for r in rows if r.split == s and r.role == "test") for s in range(5)}
    assert len(set(sides.values())) == 5


def test_split_equals_full_ranking(spark):
    import hashlib

    docs = [(i, "L" if i % 3 else "M") for i in range(500)]
    rows = splits.stratified_splits(spark.createDataFrame(docs, "id int, label string"), "id", "label", 2).collect()
    for s in range(2):
        for label in "LM":
            own = sorted((hashlib.md5(f"{i}|{s}|42".encode()).hexdigest(), i) for i, x in docs if x == label)
            want = {i for _, i in own[: round(0.2 * len(own))]}
            assert {r.id for r in rows if r.split == s and r.label == label and r.role == "test"} == want


def test_a_stratum_too_small_for_a_test_row(spark):
    rows = splits.stratified_splits(spark.createDataFrame([(1, "A"), (2, "A")], "id int, label string"), "id", "label", 1).collect()
    assert [r.role for r in rows] == ["train", "train"]


def test_three_way(spark):
    docs = spark.createDataFrame([(i, "AB"[i % 2]) for i in range(200)], "id int, label string")
    got = Counter((r.label, r.role) for r in splits.three_way_split(docs, "id", "label").collect())
    assert got == {(x, r): n for x in "AB" for r, n in (("train", 90), ("eval", 5), ("test", 5))}


def test_folds_are_contiguous_blocks(spark):
    docs = spark.createDataFrame([(i, "AB"[i % 2]) for i in range(23)], "id int, label string")
    rows = splits.stratified_folds(docs, "label", "id").collect()
    for label, n in (("A", 12), ("B", 11)):
        folds = [r.fold for r in sorted(rows, key=lambda r: r.id) if r.label == label]
        assert folds == sorted(folds) and len(folds) == n
        sizes = list(Counter(folds).values())
        assert max(sizes) - min(sizes) <= 1 and sizes == sorted(sizes, reverse=True)
