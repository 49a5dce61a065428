import numpy as np
import pandas as pd

from cairn.operators.joins import asof_join
from cairn.operators.windows import sequence

RNG = np.random.default_rng(9)


def test_asof_join_matches_merge_asof(spark):
    n = 400
    left = pd.DataFrame({"lid": np.arange(n), "key": RNG.choice(["hot"] * 6 + ["x", "y"], n),
                         "ts": RNG.integers(0, 1000, n)})
    right = pd.DataFrame({"rid": np.arange(300), "key": RNG.choice(["hot"] * 6 + ["x", "z"], 300),
                          "rts": RNG.choice(np.arange(0, 1000, 3), 300, replace=False), "val": RNG.random(300)})
    got = asof_join(spark.createDataFrame(left), spark.createDataFrame(right), ["key"], "ts", "rts",
                    ["lid"], ["rid"], ["rid", "rts", "val"], num_buckets=5).toPandas()
    exp = pd.merge_asof(left.sort_values("ts"), right.sort_values("rts"), left_on="ts", right_on="rts",
                        by="key", direction="backward")
    m = got.merge(exp, on="lid", suffixes=("", "_e"))
    assert len(m) == n
    assert ((m.rid == m.rid_e) | (m.rid.isna() & m.rid_e.isna())).all()


def test_sequence_lead_lag(spark):
    pdf = pd.DataFrame({"c": RNG.choice(["hot", "a"], 200, p=[0.8, 0.2]), "t": RNG.integers(0, 50, 200),
                        "id": np.arange(200)})
    got = sequence(spark.createDataFrame(pdf), ["c"], ["t"], ["id"], lead_cols=["t"], lag_cols=["id"],
                   num_buckets=4).toPandas()
    exp = pdf.sort_values(["c", "t", "id"]).copy()
    exp["rn"] = exp.groupby("c").cumcount() + 1
    exp["lead_t"] = exp.groupby("c").t.shift(-1)
    exp["lag_id"] = exp.groupby("c").id.shift(1)
    m = got.merge(exp, on="id", suffixes=("", "_e"))
    assert (m.row_number == m.rn).all()
    assert np.allclose(m.lead_t.astype(float), m.lead_t_e.astype(float), equal_nan=True)
    assert np.allclose(m.lag_id.astype(float), m.lag_id_e.astype(float), equal_nan=True)
