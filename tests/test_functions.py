"""Column functions against literal expectations."""

import pytest
from pyspark.sql import functions as F

from traceloom.functions import text as tx
from traceloom.functions import urls, values


def one(spark, expr, **cells):
    df = spark.createDataFrame([tuple(cells.values()) or ("",)], ", ".join(f"{k} string" for k in cells) or "x string")
    return df.select(expr.alias("v")).first()[0]


def table(spark, expr, cases):
    df = spark.createDataFrame([(i, k) for i, (k, _) in enumerate(cases)], "i int, s string")
    got = {r.i: r.v for r in df.select("i", expr(F.col("s")).alias("v")).collect()}
    for i, (text, want) in enumerate(cases):
        value = got[i]
        value = set(value) if isinstance(want, set) else value
        assert value == want, (text, value, want)


def test_label_keys(spark):
    cases = [("  Broadcom  BCM2712 ", "broadcom bcm2712"), ("Straße", "strasse"), ("ﬁlm", "film"), (None, "")]
    table(spark, tx.label_key, cases)
    table(spark, tx.folded_key, [("ﬁ Straße", "ﬁ strasse".casefold()), (None, "")])
    table(spark, tx.native_label_key, [(" A  b\tC ", "a b c"), ("Straße ΣΟΦΟΣ", "strasse σοφοσ"), (None, "")])


def test_with_label_key_folds_each_label_once(spark):
    df = spark.createDataFrame([("Straße", 1), ("Straße", 2), (None, 3)], "label string, n int")
    got = {(r.n, r.k) for r in tx.with_label_key(df, "label", "k").collect()}
    assert got == {(1, "strasse"), (2, "strasse"), (3, "")}


def test_tokens(spark):
    table(
        spark, tx.part_tokens,
        [("12mp ultrawide snapper", set()), ("kioxia 256gb nand", set()), ("100% recycled cobalt 2023", set()), ("bcm2712 a76", {"bcm2712", "a76"})],
    )
    table(spark, tx.word_tokens, [("the rear of a main camera", {"rear", "main", "camera"})])
    table(
        spark, tx.tidy_label,
        [("kioxia-256gb-nand-flash-memory", "kioxia 256gb nand flash memory"), ("Ti-6Al-4V", "Ti-6Al-4V"), ("Cortex-A76", "Cortex-A76"), (" x ", "x")],
    )


def test_label_classes(spark):
    table(spark, tx.software_artifact, [("brcmfmac43455-sdio.bin", True), ("brcmfmac driver", True), ("Arm Cortex-A76 CPU cluster", False)])
    table(
        spark, tx.interface_feature,
        [("USB 3.0 Ports", True), ("Wi-Fi 6 (802.11ax)", True), ("40-pin GPIO header", True), ("Gigabit Ethernet", True), ("Broadcom BCM54213 PHY", False)],
    )
    table(spark, tx.accessory, [("USB-C Charge Cable (1 m)", True), ("Official Board Case", True), ("display flex", False)])
    assert not one(spark, tx.interface_feature("l", "n"), l="micro-HDMI connector", n="10118194")
    assert not one(spark, tx.accessory("l", None, "m"), l="Ceramic Shield front cover glass", m="Corning")


def test_preferred_label(spark):
    def prefers(now, new):
        return one(spark, tx.prefers("a", "b", tx.native_label_key("a"), tx.native_label_key("b")), a=now, b=new)

    assert prefers("D0 stepping of the BCM2712 application processor", "BCM2712")
    assert not prefers("Broadcom BCM2712", "BCM2712")
    assert prefers("main application processor", "BCM2712")
    assert not prefers("BCM2712", "application processor")


def test_shares_in_words(spark):
    share = F.lit(0.3)
    table(
        spark, lambda s: tx.share_stated(s, share),
        [("assembles 30% of units", True), ("builds the majority of phones", True), ("one in 5 phones", False), ("3 out of 4 units", True), ("uses its plant thanks to orders", False), ("a 3nm process", False)],
    )


BODY = (
    "The phone is powered by the A17 Pro,[12] a 3‑nm chip.\nApple’s Taptic Engine uses   100% recycled\n"
    "tungsten. Raw Materials Supply\n\nMajor Suppliers: GlobalWafers, SUMCO."
)


@pytest.mark.parametrize(
    "quote,want",
    [
        ("Taptic Engine uses", "Taptic Engine uses"),
        ("uses 100% recycled tungsten", "uses   100% recycled\ntungsten"),
        ("the A17 Pro, a 3-nm chip", "the A17 Pro,[12] a 3‑nm chip"),
        ("Apple's Taptic Engine", "Apple’s Taptic Engine"),
        ("Raw Materials Supply Major Suppliers: GlobalWafers", "Raw Materials Supply\n\nMajor Suppliers: GlobalWafers"),
        ("the A18 Pro", None),
        ("", None),
    ],
)
def test_tolerant_quotes(spark, quote, want):
    assert one(spark, tx.locate_quote("b", "q"), b=BODY, q=quote) == want


def test_quote_helpers(spark):
    assert one(spark, tx.quote_window("b", "q", 2), b="abcdefgh", q="de") == "bcdefg"
    assert one(spark, tx.quote_window("b", "q", 2), b="abcdefgh", q="zz") == "zz"
    assert one(spark, tx.char_locator("b", "q"), b="abcdefgh", q="de") == "chars 3:5"
    assert one(spark, tx.occurs_once("b", "q"), b="aXaXb", q="Xb")
    assert not one(spark, tx.occurs_once("b", "q"), b="aaa", q="aa")


def test_passages(spark):
    text = "intro " * 3000 + "BCM2712 datasheet " * 500 + "filler " * 4000 + "BCM2712 again " * 300
    df = spark.createDataFrame([("short text",), (text,)], "body string").withColumn("low", F.lower("body"))
    out = df.withColumn("s", tx.passage_spans("body", "low", ["Broadcom BCM2712"]))
    short, long = [r for r in out.withColumn("p", tx.passage_text("body", F.col("s"))).collect()]
    assert short.p == "short text" and [tuple(w) for w in short.s] == [(0, 10)]
    assert tuple(long.s[0]) == (0, 8000) and len(long.s) == 3
    lower, best = text.lower(), []
    for start in range(8000, len(text), 6000):
        hits = sum(lower[start : start + 6000].count(w) for w in ("broadcom", "bcm2712"))
        best.append((-hits, start))
    chosen = sorted(s for n, s in sorted(best)[:2] if n)
    assert [w[0] for w in long.s[1:]] == chosen
    assert long.p.count(tx.OMITTED) == 2


def test_urls(spark):
    table(
        spark, urls.public_url,
        [
            ("https://example.org/a?b", True), ("http://example.org:8080/", True), ("ftp://example.org/", False),
            ("https://user:pw@example.org/", False), ("https://10.0.0.1/", False), ("https://[::1]/", False),
            ("https://localhost/", False), ("https://printer.local/", False), ("https://x.internal/", False), ("junk", False), (None, False),
        ],
    )
    table(spark, urls.skipped_host, [("https://www.youtube.com/x", True), ("https://m.reddit.com/", True), ("https://notx.com/", False), ("https://x.com", True)])
    table(spark, urls.host_of, [("https://WWW.Example.org/a", "example.org"), ("nope", "")])


def test_time_and_rounding(spark):
    table(
        spark, lambda s: values.stamp(values.parse_time(s)),
        [
            ("2026-09-05T12:23:45.678-04:00", "2026-09-05T16:23:45.678Z"), ("2026-01-01", "2026-01-01T00:00:00.000Z"),
            ("2026-01-01T10:00:00Z", "2026-01-01T10:00:00.000Z"), ("not a date", None), (None, None),
        ],
    )
    df = spark.createDataFrame([(0.6995,), (0.3004999,)], "x double")
    assert [r[0] for r in df.select(values.round_half_up_3("x")).collect()] == [0.7, 0.3]
    cost = spark.range(1).select(values.cost_minor(F.lit(1000), F.lit(10), F.lit(2), F.lit(40.0), F.lit(160.0), F.lit(0.8)).alias("c"))
    assert cost.first()[0] == 2
    none = spark.range(1).select(values.cost_minor(F.lit(1), F.lit(1), F.lit(1), F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0)).alias("c"))
    assert none.first()[0] is None


def test_public_drops_private_fields_except_custom(spark):
    df = spark.sql(
        "select 1 as id, 'b' as _body, named_struct('a', 1, '_p', 2, 'custom', named_struct('_k', 3)) as data, "
        "array(named_struct('x', 1, '_y', 2)) as items, named_struct('_z', 1) as custom"
    )
    row = values.public(df).first().asDict(recursive=True)
    assert row == {"id": 1, "data": {"a": 1, "custom": {"_k": 3}}, "items": [{"x": 1}], "custom": {"_z": 1}}


def test_merge_patch_and_layers(spark):
    df = spark.sql(
        "select named_struct('a', 1, 'n', named_struct('x', 1, 'y', 2), 'm', map('k', 'v', 'q', 'r')) as base, "
        "named_struct('a', cast(null as int), 'n', named_struct('x', 9, 'y', cast(null as int)), 'm', map('k', 'w')) as patch"
    )
    out = df.select(values.merge_patch("base", "patch", df.schema["base"].dataType).alias("o")).first().o.asDict(recursive=True)
    assert out == {"a": 1, "n": {"x": 9, "y": 2}, "m": {"k": "w", "q": "r"}}
    layers = spark.sql("select array('custom', 'market') as l, map('a', '1') as c")
    row = layers.select(values.user_layer_violation("l").alias("v"), values.user_custom("c").alias("c")).first()
    assert row.v == "computed_layer" and row.c["a"].support_label == "user_asserted"


def test_canonical_json_keeps_nulls(spark):
    df = spark.sql("select 'é' as component, cast(null as double) as quantity")
    assert df.select(values.canonical_json("component", "quantity")).first()[0] == '{"component":"é","quantity":null}'
    assert len(df.select(values.digest("component")).first()[0]) == 64
