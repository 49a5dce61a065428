"""Results that must not depend on the order of rows, columns whose names clash, and bounds on what one task learns."""

import itertools

from pyspark.sql import functions as F

from cairn.llm import op1_ann, op2_toxicity, op3_token_counts, op7_simhash


def test_a_repeated_id_has_one_vector_whatever_the_order(spark):
    """Id 100 comes with two vectors: as a query and in the index it is the same one."""
    rows = [(100, [1.0, 0.0]), (100, [0.0, 1.0]), (1, [0.99, 0.14]), (2, [0.14, 0.99]), (3, [-1.0, 0.0]), (4, [-1.0, 0.0])]
    seen = set()
    for order in itertools.permutations(range(3)):
        some = [rows[i] for i in order] + rows[3:]
        df = spark.createDataFrame(some, "vec_id long, embedding array<double>").coalesce(1)
        got = op1_ann.nearest(df, F.col("vec_id") % 100 == 0, k=3).orderBy("rank").collect()
        back = {r.query_id: r.score for r in op1_ann.nearest(df, F.col("vec_id") == 1, k=4).collect() if r.vec_id == 100}
        assert round(back[1], 9) in {round(r.score, 9) for r in got if r.vec_id == 1}
        seen.add(tuple((r.query_id, r.vec_id, round(r.score, 9)) for r in got))
    assert len(seen) == 1
    # a query column beside the id: the id's vector is still the index's
    marked = spark.createDataFrame([(i, v, j == 1) for j, (i, v) in enumerate(rows)],
                                   "vec_id long, embedding array<double>, ask boolean")
    by_mark = op1_ann.nearest(marked, F.col("ask"), k=3).orderBy("rank").collect()
    assert {tuple((r.query_id, r.vec_id, round(r.score, 9)) for r in by_mark)} == seen


def test_near_duplicates_with_columns_of_inner_names(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(1, text), (1, text + " "), (2, text), (3, "something else that nobody wrote before now at all"), (None, text)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("group", "fp", "component_id", "text_hash", "node", "shard", "home"):
        docs = docs.withColumn(name, F.lit("kept"))
    got = op7_simhash.deduplicate(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.group) for r in got.collect()) == [(0, "kept"), (1, "kept"), (3, "kept")]


def test_token_counts_with_columns_of_inner_names(spark):
    docs = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    odd = docs.withColumn("segment_chars", F.lit("x")).withColumn("segment_tokens", F.lit("y")).withColumn("edits", F.lit(3))
    edits = spark.createDataFrame([(1, 0, 0, 3, "ten")], "doc_id long, seq int, start long, end long, replacement string")
    got = op3_token_counts.apply_edits(op3_token_counts.attach_edits(odd, edits), keep=True).first()
    assert got.text == "ten two three" and got.n_tokens == 3
    again = op3_token_counts.apply_edits(op3_token_counts.attach_edits(op3_token_counts.build(odd), edits), state=True).first()
    assert (again.n_tokens, again.edited_tokens) == (got.n_tokens, got.edited_tokens)


def test_an_id_with_many_rows_trains_one_text(spark):
    """The learning task gets at most one text an id, the same in any order."""
    many = [(1, f"bad words number {i} here") for i in range(300)] + [(i, f"plain talk {i}") for i in range(2, 12)]
    labels = spark.createDataFrame([(i, 0, int(i == 1)) for i in range(1, 12)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(many, "doc_id long, text string")
    first = op2_toxicity.fit(docs.repartition(7), labels)
    again = op2_toxicity.fit(docs.orderBy(F.desc("text")), labels)
    assert (first == again).all()
    # the model is that of one of the id's texts
    assert any((op2_toxicity.fit(docs.filter((F.col("doc_id") > 1) | (F.col("text") == t)), labels) == first).all()
               for _, t in [chosen(docs)])


def chosen(docs):
    r = docs.filter("doc_id = 1").select(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("s")).first()["s"]
    return r.h, r.text


def test_an_id_with_a_third_of_the_rows_is_dealt_over_ranges(spark, documents):
    """Files in id order and fingerprints of neighbours with one id on a third of the rows; ranges are bounded."""
    import hashlib
    from collections import Counter
    from cairn.llm import common, op6_fingerprints, op9_binary

    rows = [(i, f"text {i}") for i in range(200)] + [(77, f"other text {k} of one id") for k in range(100)] + \
        [(None, f"no id {k}") for k in range(60)]
    placed, n = common.range_buckets(documents(rows), "doc_id", 36, tie="text")
    sizes = Counter(r["__bucket"] for r in placed.select("__bucket").collect())
    assert max(sizes) < n == 36 and max(sizes.values()) <= 30
    assert common.range_buckets(documents(rows), "doc_id", 10 ** 6, tie="text")[1] == common.MAX_RANGES

    path = common.scratch(spark, "test-order")
    op9_binary.write(documents(rows), path, docs_per_range=10)
    blocks = spark.read.parquet(path).selectExpr("input_file_name() AS file", "range", "block", "doc_ids").collect()
    by_file = sorted(blocks, key=lambda r: (r.file, r.range, r.block))
    ids = [-1 if i is None else i for r in by_file for i in r.doc_ids]
    assert ids == sorted(-1 if i is None else i for i, _ in rows)
    got = sorted(op9_binary.read_back(spark, path).collect(), key=lambda r: r.start)
    assert len(got) == len(rows) and all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:]))

    # every document has one other document's start in its edited text, and each start is used once
    got = op6_fingerprints.compare_with_next(documents(rows), docs_per_range=10).collect()
    halves = [t[:len(t) - len(t) // 2] for _, t in rows]
    edits = {hashlib.sha256((h + t[:len(own) // 2]).encode()).hexdigest(): j
             for h, (_, own) in zip(halves, rows) for j, (_, t) in enumerate(rows)}
    assert len(got) == len(rows) and all(r.edited_sha256 in edits for r in got)
    alone = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id != 77}
    for i in (199, 120, 79, 50, 1):
        own, after = f"text {i}", f"text {i - 1}"
        assert alone[i].edited_sha256 == hashlib.sha256(
            (own[:len(own) - len(own) // 2] + after[:len(own) // 2]).encode()).hexdigest()
