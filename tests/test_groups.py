import numpy as np
import pytest
from pyspark.sql import functions as F

from docsift.operators import groups as gr
from docsift.operators.groups import group_vectors, grouped_search
from docsift.operators.vectors import vector_search


def table(spark, x, sources=3):
    rows = [(f"c{i}", i, v.tolist(), f"s{i % sources}") for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "chunk_id string, ordinal int, embedding array<double>, source_file string").repartition(3)


def clustered(seed, n, parts, spread, d=16):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(parts, d))
    return middle[r.integers(0, parts, n)] + spread * r.normal(size=(n, d))


def found(df):
    return {(str(h.qid), h.rank): (h.chunk_id, h.score) for h in df.collect()}


@pytest.mark.parametrize(("seed", "parts", "spread", "groups"), [(1, 20, 0.1, None), (2, 1, 1.0, 10), (3, 5, 0.0, 4), (4, 30, 0.3, 1)])
def test_grouped_search_is_exact(spark, seed, parts, spread, groups):
    x = clustered(seed, 900, parts, spread)
    vectors = table(spark, x)
    asked = vectors.where("ordinal % 15 = 0").select(F.struct(F.col("ordinal").alias("q")).alias("qid"), "embedding", F.when(F.col("ordinal") % 2 == 0, F.array(F.lit("s1"))).when(F.col("ordinal") % 45 == 0, F.array().cast("array<string>")).alias("sources"))
    index = group_vectors(vectors, groups)
    assert index.groups.agg(F.sum("n")).first()[0] == 900
    for k in (1, 5, 2000):
        got, share = grouped_search(index, asked, k)
        assert found(got) == found(vector_search(vectors, asked, k)) and 0 < share <= 1
    if parts == 20:
        assert grouped_search(index, asked.drop("sources"), 5)[1] < 0.3


def test_the_bound_holds_for_every_vector():
    x, q = clustered(5, 500, 9, 0.5), clustered(6, 40, 3, 2.0)
    held = gr.centres(x, 12)
    grp = gr._nearest(x, held)
    for g in set(grp.tolist()):
        own = x[grp == g]
        radius = np.sqrt(((own - held[g]) ** 2).sum(axis=1)).max()
        assert ((q @ own.T).max(axis=1) <= q @ held[g] + np.sqrt((q * q).sum(axis=1)) * radius + 1e-9).all()


def test_groups_of_few_null_and_repeated_vectors(spark):
    rows = [("a", 1, [1.0, 0.0], None), ("b", 2, None, "s"), ("c", 3, [1.0, 0.0], "s"), ("d", 4, [0.0, 2.0], "s")]
    vectors = spark.createDataFrame(rows, "chunk_id string, ordinal int, embedding array<double>, source_file string")
    asked = spark.createDataFrame([(1, [1.0, 0.1]), (2, None), (3, [-1.0, -1.0])], "qid int, embedding array<double>")
    index = group_vectors(vectors)
    got, _ = grouped_search(index, asked, 2)
    assert found(got) == found(vector_search(vectors, asked, 2)) == {("1", 1): ("a", 1.0), ("1", 2): ("c", 1.0)}
    assert grouped_search(index, asked.limit(0), 2)[0].count() == 0
    empty = group_vectors(vectors.limit(0))
    assert grouped_search(empty, asked, 2)[0].count() == 0
    only = spark.createDataFrame([(1, "s")], "qid int, source_file string")
    assert found(grouped_search(index, asked, 2, allowed=only)[0]) == {("1", 1): ("c", 1.0), ("1", 2): ("d", 0.2)}


def test_other_lengths_and_large_batches(spark, monkeypatch):
    vectors = table(spark, clustered(7, 60, 4, 0.1, 4))
    index = group_vectors(vectors)
    with pytest.raises(ValueError, match="build the index again"):
        grouped_search(index, spark.createDataFrame([(1, [1.0])], "qid int, embedding array<double>"), 2)
    mixed = vectors.unionByName(spark.createDataFrame([("z", 99, [1.0], "s")], vectors.schema))
    with pytest.raises(Exception, match="lengths"):
        group_vectors(mixed).groups.count()
    asked = vectors.select(F.col("ordinal").alias("qid"), "embedding")
    want = found(vector_search(vectors, asked, 3))
    monkeypatch.setattr(gr, "QUERIES_AT_ONCE", 10)
    got, share = grouped_search(index, asked, 3)
    assert found(got) == want and share == 1.0
