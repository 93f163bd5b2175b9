"""Bodies of Go's init functions by the depth of braces."""

from pyspark.sql import functions as F

from vigilake.operators.file_rules import GO_TOKENS, blocks

CASES = {
    "package p\nfunc init() {\n\tif x { a() } else { b() }\n}\nfunc main() { c() }": ["\n\tif x { a() } else { b() }\n"],
    'func init() { s := "}" + `}{` + "\\"}"; r := \'}\'; r = \'\\\'\'; run(s) }\nfunc x() {}': [' s := "}" + `}{` + "\\"}"; r := \'}\'; r = \'\\\'\'; run(s) '],
    "func init() { // }\n /* } */ a() }\nfunc init ( ) {b()}": [" // }\n /* } */ a() ", "b()"],
    "func init() { f := func() { g() }; f() }": [" f := func() { g() }; f() "],
    "func main() { func init() { no() } }": [],
    "func init() { open()": [" open()"],
    "} } func init() { after() }": [" after() "],
    'var s = "func init() {"\nfunc initial() {}\n// func init() { x }\n': [],
    "é👩 func init() { ü } ": [" ü "],
    "": [],
}


def test_bodies(spark):
    df = spark.createDataFrame([(k,) for k in CASES], "t string")
    got = {r.t: r.x for r in df.select("t", blocks(F.col("t"), GO_TOKENS, "func").alias("x")).collect()}
    assert got == CASES


def test_long_texts(spark):
    """Texts of many escapes, many braces and deep ones are read in linear time and constant stack."""
    texts = ['func init() { s := "' + '\\"' * 200_000 + '" }', "func init() {" + "{}" * 50_000 + "}", "func init() {" + "{" * 30_000 + "}" * 30_000 + "}", "/*" + "x" * 500_000]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, t string")
    got = {r.k: r.x for r in df.select("k", F.transform(blocks(F.col("t"), GO_TOKENS, "func"), F.length).alias("x")).collect()}
    assert got == {0: [400_000 + 9], 1: [100_000], 2: [60_000], 3: []}
