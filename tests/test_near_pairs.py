"""Near pairs of names against all pairs, short and repetitive names too."""

import random

from archivolt.operators import graph


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_near_pairs_of_short_names_match_all_pairs(spark):
    rnd = random.Random(4)
    names = {"".join(rnd.choice("abcd") for _ in range(rnd.randrange(13))) for _ in range(150)} | {"aaaaaaa", "aabaaa", "xy", "x", "yx", ""}
    got = graph.near_pairs(spark.createDataFrame([(n,) for n in [*names, None]], "name string")).collect()
    want = {(a, b, distance(a, b)) for a in names for b in names if a < b and distance(a, b) <= 2}
    assert len(got) == len(want) and {(r.a, r.b, r.distance) for r in got} == want
