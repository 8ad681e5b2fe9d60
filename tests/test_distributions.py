import random

import numpy as np

from mirepoix.operators import report


def test_exact_figures_of_tight_groups_with_an_outlier(spark):
    rng = random.Random(5)
    groups = {"tight": [1 + rng.random() * 1e-9 for _ in range(4000)] + [1e300, -1e300], "one": [3.0], "same": [2.0] * 50, "signs": [rng.gauss(0, 1) * 10 ** rng.randrange(-8, 8) for _ in range(3000)], None: [1.0, 2.0]}
    odd = [("one", None), ("one", float("nan")), ("same", float("inf")), ("same", float("-inf")), ("gone", float("nan")), ("gone", None)]
    rows = spark.createDataFrame([(g, v) for g, values in groups.items() for v in values] + odd, "g string, v double")
    shares = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    got = {r.g: r for r in report.distribution(rows, ["g"], "v", shares).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        assert (got[g].n, got[g].least, got[g].most) == (len(values), min(values), max(values))
        for name, share in shares.items():
            assert np.isclose(got[g][name], np.quantile(values, share), rtol=1e-12, atol=0), (g, name)
    assert report.distribution(rows.limit(0), ["g"], "v", shares).collect() == []
