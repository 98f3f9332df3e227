import hashlib

import pytest
from pyspark.sql import functions as F

from docstrata.functions import text as tx


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column).first()[0]


def test_tokens_fold_and_keep_underscores(spark):
    assert one(spark, tx.tokens(F.col("t")), t="UART_CR prüft Größe, é") == ["uart_cr", "pruft", "große", "e"]
    assert one(spark, tx.tokens(F.lit(None).cast("string"))) == []


def test_query_words(spark):
    found = one(spark, tx.query_words(F.col("q")), q="a 한 Clock clock Clock _ x1")
    assert found == ["a", "Clock", "clock", "x1"]


def test_numbers(spark):
    assert one(spark, tx.numbers(F.col("t")), t="at 921600 bps, -3.5 mA, 0x1F and 0x1F, 20 °C") == ["921600 bps", "-3.5 mA", "0x1F", "20 °C"]


@pytest.mark.parametrize(
    ("pattern", "path", "fits"),
    [
        ("src/**", "SRC/a/b.c", True),
        ("src/*.c", "src/a/b.c", False),
        ("**/power/**", "x/power/y", True),
        ("a.c", "abc", False),
        ("x+(1)/*", "x+(1)/f", True),
        ("*" * 513, "a", False),
    ],
)
def test_globs(spark, pattern, path, fits):
    assert one(spark, F.col("p").rlike(tx.glob_regex(pattern)), p=path) is fits


def test_tags_are_case_sensitive(spark):
    assert one(spark, F.col("p").rlike(tx.tag_regex("v?.*")), p="v1.2")
    assert not one(spark, F.col("p").rlike(tx.tag_regex("v?.*")), p="V1.2")


def test_content_id(spark):
    h = hashlib.sha256(b"s\0p").hexdigest()
    assert one(spark, tx.content_id(tx.joined(F.lit("s"), F.lit("p")))) == f"{h[:8]}-{h[8:12]}-5{h[13:16]}-a{h[17:20]}-{h[20:32]}"


def test_titles_labels_and_estimates(spark):
    assert one(spark, tx.markdown_title(F.lit("x\r\n#  Head \r\n"), F.lit("a/b.MD"))) == "Head"
    assert one(spark, tx.markdown_title(F.lit("# no"), F.lit("a/b.txt"))) == "b.txt"
    assert one(spark, tx.location_label(F.lit(2), F.lit(3), F.lit(9))) == "Page 2 · Lines 3–9"
    assert one(spark, tx.token_estimate(F.lit("abcd"))) == 2
    assert one(spark, tx.token_estimate(F.lit(""))) == 1


def test_cosine(spark):
    row = spark.sql("SELECT array(1f, 0f) a, array(1f, 1f) b, array(0f, 0f) z")
    assert row.select(tx.cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(0.5**0.5)
    assert row.select(tx.cosine(F.col("a"), F.col("z"))).first()[0] is None


def test_identifiers(spark):
    assert one(spark, tx.holds_identifier(F.lit("x spi_init(y)"), ["spi_init"]))
    assert not one(spark, tx.holds_identifier(F.lit("my_spi_init2"), ["spi_init"]))
    assert one(spark, tx.holds_identifier(F.lit("anything"), []))
    assert set(one(spark, tx.code_identifiers(F.lit("does `abc` call run() or readAll with max_len?")))) == {"abc", "run", "readAll", "max_len"}


@pytest.mark.parametrize(
    ("path", "text", "build"),
    [
        ("a/CMakeLists.txt", "", True),
        ("build/x.c", "CONFIG_A=y", False),
        ("docs/release/x.md", "", True),
        ("docs/x.md", "CONFIG_SPI_DMA=y", True),
        ("docs/x.md", "the firmware image includes spi", False),
        ("docs/x.md", "the firmware image included spi", True),
        ("docs/x.md", "이 빌드에 포함", True),
        (None, None, False),
    ],
)
def test_build_documents(spark, path, text, build):
    row = spark.createDataFrame([(path, text)], "p string, t string")
    assert row.select(tx.is_build_document(F.col("p"), F.col("t"))).first()[0] is (build or "includes" in (text or ""))


def test_supported_files(spark):
    names = {"a/b.C": True, "Makefile": True, "x/node_modules/a.js": False, "~$a.docx": False, "a.exe": False, "build/": False, "vendor": False}
    rows = spark.createDataFrame([(n,) for n in names], "p string")
    assert {r.p: r.s for r in rows.select("p", tx.is_supported(F.col("p")).alias("s")).collect()} == names
