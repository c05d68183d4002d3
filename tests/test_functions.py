from pyspark.sql import functions as F

from reviewlens.functions import images, lists, names, numbers, rules, text


def values(spark, *columns):
    return list(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_text(spark):
    got = values(
        spark,
        text.basic_clean(F.lit("Don't  STOP_it — now!")),
        text.basic_clean(F.lit("a_b"), keep_underscore=True),
        text.repeat_text(F.lit(" ab "), 3), text.repeat_text(F.lit("NaN"), 3),
        text.has_any(F.lit("education"), ["cat"]),
        text.paragraphs(F.lit("a\n\n b\n \n\nc\n\n")),
        text.ngrams(text.word_tokens(F.lit("Don't dé café x yy")), 1, 3),
        text.ngrams(text.word_tokens(F.lit("one")), 1, 2),
        text.strip(F.lit("  x \n")))
    assert got == [
        "don't stop it now", "a_b", "ab ab ab", "", True, ["a", "b", "c"],
        ["don", "dé", "café", "yy", "don dé", "dé café", "café yy", "don dé café", "dé café yy"], ["one"], "x"]


def test_numbers(spark):
    rating = lambda x: numbers.weak_label(F.lit(x))
    got = values(
        spark, *[rating(x) for x in [1.0, 2.0, 2.5, 3.0, 3.5]],
        *[numbers.coerce_number(F.lit(x)) for x in ["5", " 2.5", "bad", "5d", "NaN"]],
        numbers.fixed(F.lit(4.645), 2), numbers.round_even(F.lit(86.25), 1), numbers.round_exact(F.lit(0.0625), 3),
        numbers.grouped(F.lit(1234567)), *[numbers.evidence_strength(F.lit(n)) for n in [29, 30, 99, 100]],
        numbers.clip01(F.lit(1.2)), numbers.clip01(F.lit(None).cast("double")))
    assert got == ["negative", "negative", "positive", "neutral", "positive", 5.0, 2.5, None, None, None,
                   "4.64", 86.2, 0.062, "1,234,567", "Low", "Medium", "Medium", "High", 1.0, None]


def test_names(spark):
    got = values(
        spark,
        names.grouping_name(F.lit('Echo (White),,, Fire "x"')), names.grouping_name(F.lit("A\\nB")),
        names.grouping_name(F.lit("Amazon - Amazon Tap")), names.grouping_name(F.lit(None).cast("string")),
        names.grouping_name(F.lit(",,,")),
        names.display_name(F.lit("Amazon - Amazon Tap  Speaker | x")), names.display_name(F.lit("amazon - kindle Hd y")),
        names.canonical_name(F.lit("Kindle Paperwhite 6 inch, 4 GB - Black")),
        names.slug(F.lit("  Fire TV!! 4K ")), names.slug(F.lit("!!")),
        names.image_key(F.lit("Echo Dot (Previous generation)")),
        names.image_tokens(F.lit("Amazon Echo Dot dot for TV")))
    assert got == ["Echo (White)", "A", "Amazon Tap", "", ",,,", "Amazon Tap Speaker", "Amazon kindle HD y",
                   "paperwhite", "fire_tv_4k", "product", "echo dot", ["echo", "dot"]]


def test_rule_order(spark):
    got = values(
        spark,
        rules.product_family(F.lit("Kids Edition Tablet with case")), rules.product_family(F.lit("Tablet Case")),
        rules.structured_tokens(F.lit("AAA Batteries")),
        rules.taxonomy(F.lit("Fire TV case"), F.lit("cat"), F.lit(1))["corrected_category"],
        rules.taxonomy(F.lit("Fire HD 8 case"), F.lit(""), F.lit(1))["corrected_category"],
        rules.taxonomy(F.lit("Paper"), F.lit(None), F.lit(7))["corrected_category"],
        rules.product_type(F.lit("Non-Electronics"), F.lit("box")),
        rules.fitting_strengths(F.lit("Echo"), F.lit("smart speaker product"), F.array(F.lit("clear screen or picture"))),
        rules.fitting_strengths(F.lit("AA battery"), F.lit("x"), lists.text_array()),
        rules.fitting_concerns(F.lit("Cable"), F.lit("electronic accessory"), F.array(F.lit("slow performance"))))
    assert got == ["family_fire_tablet", "family_accessory_case_cover",
                   "family_accessory_battery word_battery word_aa word_aaa", "Fire TV & Streaming", "Fire Tablets",
                   "Cluster 7", "non-electronic product", ["useful for this product type"],
                   ["useful for everyday battery needs"], ["reliability concerns may matter for some buyers"]]


def test_images_and_lists(spark):
    got = values(
        spark,
        images.best_url(F.lit("http://a.b/x_sx300.jpg, https://m.media-amazon.com/i._SL500_.jpg ,http://x/barcode.png")),
        images.best_url(F.lit("ftp://x,http://x/_ss40_.png")),
        images.url_score(F.lit("https://m.media-amazon.com/i._SL500_.jpg")),
        images.url_score(F.lit("http://x/thumb_sl99999999999.png")),
        lists.parse_list(F.lit("['a', 'b']")), lists.parse_list(F.lit("bad")))
    assert got == ["https://m.media-amazon.com/i._SL500_.jpg", "", 77, 132, ["a", "b"], []]
