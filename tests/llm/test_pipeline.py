import collections
import random

import corpus_pipeline as C
from vecindario.llm import near_duplicates as N, quality_model

STEMS = {"aa": ["kolu", "mira", "tano", "pelu", "sira"], "bb": ["schtra", "gruft", "kampf", "wirst", "bald"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choices(STEMS[lang], k=rng.randint(1, 3))) for _ in range(n)) + "."


def tables(spark, path):
    rng = random.Random(9)
    items = [(i, prose(rng, "aa", 25)) for i in range(10)]
    rows, expected, bad = [], set(), set()
    for i in range(240):
        lang = rng.choice(list(STEMS))
        text = prose(rng, lang, rng.randint(60, 150))
        kind = i % 8
        if kind == 0:
            text = " | ".join(text.upper().split()) + " ### $$$ !!!"
            bad.add(i)
        elif kind == 1:
            text += " " + items[i % 10][1] + " " + prose(rng, lang, 20)
        elif kind == 6:
            source = rows[-1]
            words = source[1].split()
            words[len(words) // 2] = "edited"
            text = " ".join(words) if i % 16 == 6 else source[1]
        else:
            expected.add(i)
        rows.append((i, text, lang, f"src{i % 3}", len(text)))
    extra = [(1000, None, None, None, None), (1001, "", "aa", None, 0), (1002, "... 123", "aa", "s", 7), rows[3], rows[3]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows + extra, schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] not in bad), 0) for r in rows if r[0] % 3], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return rows, expected, bad


def test_stages(spark, tmp_path):
    rows, expected, bad = tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, []
    for i, (_, stage) in enumerate(C.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if i < 4:
            assert docs.columns == columns
            docs.write.parquet(f"{tmp_path}/stage{i}")
            docs = spark.read.parquet(f"{tmp_path}/stage{i}")
        kept.append([r.doc_id for r in docs.select("doc_id").collect()])
    after_quality = set(kept[0])
    assert not after_quality & bad and expected <= after_quality
    assert not set(kept[1]) & {1000, 1001, 1002}
    assert len(kept[2]) == len(set(kept[2]))
    for i in range(6, 240, 8):
        assert i - 1 in kept[2] and i not in kept[2]
    assert not [i for i in kept[3] if i % 8 == 1] and expected - set(kept[3]) == set()
    assert set(kept[4]) == set(kept[3])


def test_run_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert C.run(spark, str(tmp_path)).count() == 0


def test_one_row_of_each_class(spark):
    rows = [(5, "a b c d e f"), (5, "other text of its own here"), (5, "a b c d e f"), (3, "other text of its own here"), (None, "nothing known of this one"),
            (None, "nothing known of that one, either"), (7, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.text) for r in N.firsts(df).collect())
    assert got == collections.Counter([rows[0], rows[3], rows[4], rows[5], rows[6]])
    assert quality_model.Model().score(quality_model.np.zeros((1, len(quality_model.STATISTICS)))).tolist() == [0.5]


CLASHES = ["score", "stats", "lang_pred", "_text", "_node", "_row", "node", "label", "class_id", "component", "held_out", "length"]


def test_columns_of_any_name_pass_through(spark, tmp_path):
    tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, name in enumerate(CLASHES):
        docs = docs.withColumn(name, C.F.concat(C.F.lit(f"{i}-"), C.F.col("doc_id").cast("string")))
    for _, stage in C.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        rows = out.select("doc_id", *CLASHES).collect()
        assert rows and all(tuple(r[1:]) == tuple(f"{i}-{r.doc_id}" for i in range(len(CLASHES))) for r in rows)
    assert C.packed(spark, docs, str(tmp_path)).count() >= docs.count()


def test_texts_without_letters_go_and_clean_ones_stay(spark, tmp_path):
    tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").filter("doc_id < 1000")
    planted = spark.createDataFrame([(5000, "12345 --- 777", None, "s", 3), (5001, "", None, "s", 0)], docs.schema)
    kept = {r.doc_id for r in C.languages(spark, docs.unionByName(planted), str(tmp_path)).collect()}
    assert kept == {r.doc_id for r in docs.collect()}
