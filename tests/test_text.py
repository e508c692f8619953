import pytest
from pyspark.sql import functions as F

from vecindario.functions import arrays as A, hashing as H, text as T


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "line string").select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("text, words", [
    ("", []), ("hola", ["hola"]), ("yo y tú", ["yo", "tú"]),
    ("¿sólo así irse? ¡x!", ["sólo", "así", "irse"]), ("A1_b  C2-ca-", ["a1_b", "c2", "ca"]),
])
def test_tokenize(spark, text, words):
    assert one(spark, text, T.tokenize(F.col("line"))) == words


def test_blank_tokens_have_no_empties(spark):
    assert one(spark, " a1  b2 ", T.tokenize_ws(F.col("line"))) == ["a1", "b2"]
    assert one(spark, "", T.tokenize_ws(F.col("line"))) == []


def test_clean_text(spark):
    assert one(spark, " ¿Niño, sí? ", T.clean_text(F.col("line"))) == "niño sí"
    assert one(spark, "Niño, sí", T.clean_text(F.col("line"), ascii_only=True)) == "nio s"


def test_clean_text_short(spark):
    assert one(spark, "ya es (muy) tarde\u0085 ca- así", T.clean_text_short(F.col("line"))) == "muytardeasí"  # blanks go with what precedes them


def test_decode_replaces_bad_bytes(spark):
    df = spark.createDataFrame([(bytearray(b"a\xffb"),)], "raw binary")
    assert df.select(T.decode(F.col("raw"))).first()[0] == "a�b"


def test_stop_words(spark):
    tokens = F.split("line", " ")
    assert one(spark, "el sol de la tarde", T.remove_stop_words(tokens, T.stop_words("spanish"))) == ["sol", "tarde"]


@pytest.mark.parametrize("text, grams", [("", []), ("ab", ["ab"]), ("abcd", ["abc", "bcd"])])
def test_char_ngrams(spark, text, grams):
    assert one(spark, text, T.char_ngrams(F.col("line"), 3)) == grams


def test_odd_size():
    assert [A.odd_size(n) for n in (1, 4, 5)] == [1, 5, 5]
    with pytest.raises(ValueError):
        A.odd_size(0)


def test_hash01_is_stable(spark):
    u = one(spark, "niño", H.hash01("line", seed=42))
    assert 0 <= u < 1 and u == one(spark, "niño", H.hash01("line", seed=42)) != one(spark, "niño", H.hash01("line", seed=1))


def test_format_vector_has_no_negative_zero(spark):
    assert one(spark, "", T.format_vector(F.array(F.lit(-1e-9), F.lit(0.5)))) == "0.000000 0.500000"


def test_shingles_of_a_long_line_are_linear(spark):
    from pyspark.sql import functions as F

    from vecindario.functions import text as T
    long = "añb " * 25_000
    row = spark.createDataFrame([(long,), ("ab",), ("abc",), ("",), ("a\nb😀c",)], "s string").select(T.char_ngrams(F.col("s"), 3).alias("g")).collect()
    assert row[0].g == [long[i:i + 3] for i in range(len(long) - 2)]
    assert [r.g for r in row[1:]] == [["ab"], ["abc"], [], ["a\nb", "\nb😀", "b😀c"]]
