"""Corpus operators on rows that samples, ids and distances used to leave out."""

from pyspark.sql import functions as F

from lakeask.llm import common, language, secrets


def test_a_rare_language_keeps_its_model(spark):
    common_rows = spark.range(6000).select("id", F.concat(F.lit("plain words of an ordinary line "), "id").alias("text"), F.lit("en").alias("lang"))
    rare = spark.range(3).select(F.lit(None).cast("long").alias("id"), F.concat(F.lit("это обычный русский текст про погоду "), "id").alias("text"), F.lit("ru").alias("lang"))
    docs = common_rows.union(rare).withColumnRenamed("id", "doc_id")
    models = language.train(docs, F.lit(True), train_docs=60)
    assert models.langs == ["en", "ru"]
    found = language.identify(rare.withColumnRenamed("id", "doc_id"), models).collect()
    assert {(r["lang_pred"], r["rejected"]) for r in found} == {("ru", False)}


def test_a_sample_is_dealt_evenly(spark):
    rows = spark.range(30_000).select("id", F.when(F.col("id") < 20, "c").when(F.col("id") < 10_000, "b").otherwise("a").alias("lang"))
    got = {r[0]: r[1] for r in common.sample_each_by_hash(rows, "lang", ["id"], 2020).groupBy("lang").count().collect()}
    assert got["c"] == 20 and abs(got["a"] - 1000) < 150 and abs(got["b"] - 1000) < 150
    assert common.sample_each_by_hash(rows, "lang", ["id"], 30_000).count() == 30_000
    assert common.sample_each_by_hash(rows.limit(0), "lang", ["id"], 5).count() == 0


def test_one_row_of_each_group_stays_whatever_its_id(spark, sf, tmp_path, monkeypatch):
    """Null ids, ids used again and whole rows that repeat: of equal texts one row stays, of near copies one, and no others go."""
    import corpus_pipeline

    prose = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    long = "\n".join(prose[:20])
    near, alone = [long, long + " end", long + " done"], [prose[21] + " first", prose[25] + " second", prose[30] + " third"]
    rows = [(None, alone[0]), (None, alone[0]), (7, alone[1]), (7, alone[1]), (7, alone[2])]  # exact copies, and one id's other text
    rows += [(None, near[0]), (None, near[1]), (7, near[2]), (3, near[0])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    unlike = corpus_pipeline.simhash.simhash_dedup(docs.select(F.monotonically_increasing_id().alias("doc_id"), "text")).select("component_id").distinct().count()
    assert unlike == 4
    exact = corpus_pipeline.drop_exact_copies(spark, docs, "")
    assert exact.columns == docs.columns
    assert sorted(((r["doc_id"] or 0), r["text"]) for r in exact.collect()) == sorted([(0, alone[0]), (7, alone[1]), (7, alone[2]), (3, near[0]), (0, near[1]), (7, near[2])])
    left = corpus_pipeline.drop_near_copies(spark, exact, "")
    want = [(0, alone[0]), (3, near[0]), (7, alone[1]), (7, alone[2])]
    assert left.columns == docs.columns and sorted(((r["doc_id"] or 0), r["text"]) for r in left.collect()) == sorted(want)
    monkeypatch.setattr(corpus_pipeline, "keep_known_language", lambda spark, docs, d: docs)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("language_id", lambda s, d, f: d), *corpus_pipeline.STAGES[1:]])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()
    assert {r["doc_id"] for r in packed} == {None, 3, 7}


def test_long_values_keep_their_neighbours(spark):
    weak = "Ab3" + "kLmN0pQr" * 4
    rows, want = [], {}
    for size in (5, 390, 401, 799, 800, 1601, 5000):
        for gap in (0, 1, 380, 399, 400, 401, 800):
            for long in (f"token={'z' * size}", f"https://{'z' * size}"):
                for at in (0, 7, 399):
                    part = "client_id=abc" if long.startswith("token") else weak
                    for first, text in ((True, f"{part}{'~' * gap}{long}"), (False, f"{long}{'~' * gap}{part}")):
                        if gap == 0 or (size < 6 and long.startswith("token")):
                            continue
                        text = "~" * at + text
                        if not first and long.startswith("http"):
                            text = text.replace("z~", "z ", 1)  # an address ends at a space
                        want[len(rows)] = gap <= secrets.SCOPE
                        rows.append((len(rows), text))
    found = secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r[0]: r[1] for r in found.select("row.doc_id", F.exists("spans", lambda s: s["kind"].isin(3, 5))).collect()}
    assert got == want and set(want.values()) == {True, False}
