import zlib

from loomline.llm.langid import Settings, bucket_counts, held_out, identify, learn, predict, subwords, train
from pyspark.sql import functions as F

FAST = Settings(rows_per_language=120)
TWO = [(bucket_counts(t, FAST.buckets), lang) for t, lang in [("abc def", "x"), ("ghi jkl", "y")] * 20]


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = learn(docs, settings=FAST)
    rows = identify(docs, model).where(held_out(F.col("doc_id"))).select("doc_id", "lang", "lang_pred", "score", "rejected").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) and sum(r.rejected for r in rows) <= 0.01 * len(rows)


def test_only_rows_to_learn_from_matter(spark, docs):
    swapped = docs.withColumn("lang", F.when(held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    a, b = learn(docs, settings=FAST), learn(swapped, settings=FAST)
    assert a.languages == b.languages and (a.table == b.table).all()


def test_without_letters_or_languages():
    model = train(TWO, FAST)
    assert predict("12 + !", model) == predict(None, model) == predict("", model) == ("und", 0.0)
    assert predict("abc def abc", model)[0] == "x" and predict("abc", train([], FAST)) == ("und", 0.0)


def test_long_texts_equal_their_parts():
    model = train(TWO, FAST)
    assert predict("ghi jkl " * 90_000, model)[0] == "y"


def test_awkward_rows(awkward, empty, docs):
    model = learn(docs, settings=FAST)
    out = identify(awkward("score"), model).collect()
    assert len(out) == 9 and {r.lang_pred for r in out if r.doc_id in (2, 3, 4)} == {"und"} and all(r.rejected for r in out if r.doc_id in (2, 3, 4))
    assert identify(empty, model).count() == 0 and learn(empty).languages == ()


def test_whole_texts_are_counted():
    text = "le la " * 100_000
    used, n = bucket_counts(text, 1 << 15)
    found = subwords(text, 1 << 15)
    assert abs(int(n.sum()) - len(found)) < 100 and set(used) == set(found)


def test_labels_and_rows_are_bounded(spark):
    rows = [(i, f"words of label {i % 7}", f"l{i % 7}") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert len(learn(df, settings=FAST).languages) == 7
    assert len(learn(df, settings=Settings(most_languages=6)).languages) == 6
    dirty = spark.createDataFrame(rows + [(1000 + i, "some text", f"dirty {i}") for i in range(300)], df.schema)
    found = learn(dirty, settings=Settings(most_languages=9)).languages
    assert len(found) == 9 and {f"l{i}" for i in range(7)} < set(found)
