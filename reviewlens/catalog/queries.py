"""Registry of checked queries: every entry runs library operators over the given tables.

``sql`` is the same result written independently for a second engine; entries
without it (learned models, iterative clustering) are covered by property tests.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.catalog import oracle as o
from reviewlens.catalog.views import Views
from reviewlens.functions import fixed_values as fixed
from reviewlens.functions import images as image_fn
from reviewlens.functions import lists, names, numbers, rules, text
from reviewlens.operators import (cards, clustering, evidence, features, gallery, images, metrics, reviews,
                                  sentiment, splits, taxonomy)
from reviewlens.plans import cards as card_plan
from reviewlens.plans import clustering as cluster_plan
from reviewlens.runtime import materialise, together
from reviewlens.sources import reports
from reviewlens.sources import reviews as review_source

QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn: Callable[[Views], DataFrame]):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = o.build(sql)
        return fn
    return register


def r6(column: str | Column, name: str | None = None) -> Column:
    col = F.col(column) if isinstance(column, str) else column
    return F.round(col, 6).alias(name or column)


def joined(col: Column | str, name: str) -> Column:
    return F.array_join(col, " | ").alias(name)


# --- shared inputs ---------------------------------------------------------------

def raw_reviews(v: Views) -> DataFrame:
    return v["v_raw_text"].withColumnsRenamed(
        {"rating": "reviews.rating", "title": "reviews.title", "text": "reviews.text"})


def cell_reviews(v: Views) -> DataFrame:
    return reviews.to_reviews(raw_reviews(v), keep=("doc_id", "source_file"))


def text_reviews(v: Views) -> DataFrame:
    return reviews.review_table(raw_reviews(v), keep=("doc_id", "source_file"), order=F.col("doc_id"))


def predictions(v: Views) -> DataFrame:
    rule = (F.when(F.col("doc_id") % 7 == 0, "neutral").when(F.col("doc_id") % 11 == 0, "positive")
            .when(F.col("doc_id") % 17 == 0, "negative").otherwise(F.col("label")))
    return text_reviews(v).withColumn("prediction", rule).withColumn("predicted_sentiment", rule)


def scored_reviews(v: Views) -> DataFrame:
    return reviews.label_reviews(reviews.valid_reviews(v["v_scored_raw"], require_name=True))


def clustered_products(v: Views) -> DataFrame:
    named = v["v_products"].filter(F.length("name") > 0)
    return named.groupBy(F.col("name").alias("product_name")).agg(
        F.min("categories").alias("category"), F.count("*").alias("review_rows")).withColumn(
        "cluster_id", (F.length("product_name") % 8).cast("int"))


def corrected_products(v: Views) -> DataFrame:
    return taxonomy.apply_taxonomy(clustered_products(v)).withColumn(
        "product_family", rules.product_family(F.col("product_name")))


def product_evidence_of(v: Views) -> DataFrame:
    return evidence.product_evidence(scored_reviews(v), corrected_products(v))


def selected_facts(v: Views) -> DataFrame:
    products = product_evidence_of(v)
    return cards.card_facts(cards.select_products(products), products)


def template_cards_of(v: Views) -> DataFrame:
    return cards.assemble_cards(cards.choose_card(selected_facts(v), None, "product_name"))


def gallery_of(v: Views) -> DataFrame:
    return gallery.gallery_table(template_cards_of(v))


def lookup_of(v: Views) -> DataFrame:
    return images.image_lookup(v["v_images"])


def vectors_of(v: Views) -> DataFrame:
    return v["embeddings"].select(F.col("vec_id"), F.col("embedding").cast("array<double>").alias("vector"),
                                  F.col("label").alias("cluster_id"))


def prepared_reviews(v: Views) -> DataFrame:
    return text_reviews(v).select("doc_id", "label", "text", text.basic_clean(F.col("text")).alias("prepared"))


# --- review table ------------------------------------------------------------------

@query("SELECT doc_id, product_name, category_text, review_title, review_text, rating, text FROM {review_cells}")
def review_projection(v):
    return cell_reviews(v).drop("source_file")


@query("SELECT doc_id, product_name, rating FROM {valid} WHERE length(product_name) > 0")
def valid_reviews(v):
    return reviews.valid_reviews(cell_reviews(v), require_name=True).select("doc_id", "product_name", "rating")


@query("SELECT doc_id, product_name, category_text, review_title, rating, label FROM {reviews}")
def dedupe_reviews(v):
    return text_reviews(v).select("doc_id", "product_name", "category_text", "review_title", "rating", "label")


@query("""SELECT doc_id, product_name, category_text FROM {review_cells} QUALIFY row_number() OVER
 (PARTITION BY product_name, category_text, review_title, review_text ORDER BY doc_id) = 1""")
def dedupe_product_reviews(v):
    return reviews.dedupe_reviews(cell_reviews(v), reviews.PRODUCT_REVIEW_KEYS, order=F.col("doc_id")).select(
        "doc_id", "product_name", "category_text")


@query("""SELECT count(*) AS rows_before, count(DISTINCT (product_name, category_text, text, rating)) AS rows_after,
 count(*) - count(DISTINCT (product_name, category_text, text, rating)) AS rows_removed FROM {v_scored_raw}""")
def dedupe_audit(v):
    return reviews.dedupe_audit(v["v_scored_raw"], ["product_name", "category_text", "text", "rating"])


@query(f"SELECT {o.label('rating')} AS label, count(*) AS n FROM {{v_scored_raw}} GROUP BY 1")
def weak_label_dist(v):
    return reviews.frequency_table(reviews.label_reviews(v["v_scored_raw"]), "label", name="n")


@query("SELECT doc_id, label, CASE label WHEN 'negative' THEN 0.0 WHEN 'neutral' THEN 1.0 ELSE 2.0 END::DOUBLE AS label_id, "
       "label AS label_back FROM {reviews}")
def label_ids(v):
    return text_reviews(v).select("doc_id", "label", numbers.label_id(F.col("label")).alias("label_id"),
                                  numbers.id_label(numbers.label_id(F.col("label"))).alias("label_back"))


@query("SELECT source_file, rating, count(*) AS n FROM {review_cells} GROUP BY ALL")
def rating_distribution(v):
    return reviews.frequency_table(cell_reviews(v), "source_file", "rating", name="n")


@query("""SELECT unnest(['doc_id', 'source_file', 'name', 'categories', 'rating', 'title', 'text']) AS column_name,
 count(*) AS row_count, unnest([count(*) - count(doc_id), count(*) - count(source_file), count(*) - count(name),
 count(*) - count(categories), count(*) - count(rating), count(*) - count(title), count(*) - count(text)])
 AS missing_count FROM {v_raw_text}""")
def null_profile(v):
    return reviews.null_profile(v["v_raw_text"])


@query("""SELECT count(*) AS row_count, count(DISTINCT name) AS distinct_name, count(DISTINCT categories)
 AS distinct_categories, count(DISTINCT p_partkey) AS distinct_p_partkey FROM {v_products}""")
def distinct_counts(v):
    return reviews.distinct_counts(v["v_products"], ["name", "categories", "p_partkey"])


@query("""SELECT 'documents' AS source_file, count(*) AS row_count, 5::BIGINT AS column_count FROM {documents} UNION ALL
 SELECT 'pages', count(*), 3 FROM {pages} UNION ALL SELECT 'conversations', count(*), 4 FROM {conversations}
 UNION ALL SELECT 'lineitem', count(*), 11 FROM {lineitem}""")
def file_shapes(v):
    return reviews.file_shapes({n: v[n] for n in ["documents", "pages", "conversations", "lineitem"]})


@query("""SELECT doc_id, product_name, review_title, review_text, rating, label AS true_label_from_rating,
 prediction AS predicted_sentiment, contradiction_type FROM {contradicted} WHERE contradiction_type IS NOT NULL""")
def contradictions(v):
    return reviews.contradiction_table(predictions(v), ("doc_id",))


@query("""SELECT contradiction_type, doc_id, CAST(row_number() OVER (PARTITION BY contradiction_type ORDER BY doc_id) AS INT)
 AS example FROM {contradicted} WHERE contradiction_type IS NOT NULL QUALIFY example <= 3""")
def contradictions_top3(v):
    return reviews.contradiction_examples(predictions(v), [F.col("doc_id")]).select(
        "contradiction_type", "doc_id", "example")


@query("SELECT doc_id, label FROM {predicted} WHERE label = prediction")
def consistent_rows(v):
    return reviews.consistent_rows(predictions(v)).select("doc_id", "label")


@query("""SELECT doc_id AS id, text, lang, NULL AS role FROM {documents} UNION ALL
 SELECT conv_id * 1000 + turn, text, NULL, role FROM {conversations}""")
def union_reviews(v):
    docs = v["documents"].select(F.col("doc_id").alias("id"), "text", "lang")
    talks = v["conversations"].select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text", "role")
    return review_source.union_reviews([docs, talks])


@query('SELECT 1::INT AS source_rank, row_ord, name, imageURLs AS "imageURLs" FROM {v_images}')
def image_rows(v):
    return review_source.image_rows(v["v_images"], 1, "row_ord")


# --- column functions --------------------------------------------------------------

@query(f"SELECT doc_id, {o.clean('text')} AS clean, {o.clean('text', True)} AS clean_underscore, text AS raw FROM {{documents}}")
def basic_clean(v):
    col = F.col("text")
    return v["documents"].select("doc_id", text.basic_clean(col).alias("clean"),
                                 text.basic_clean(col, True).alias("clean_underscore"),
                                 text.raw_tokens(col).alias("raw"))


@query(f"""SELECT doc_id, CASE WHEN {o.strip("coalesce(title, '')")} IN ('', 'nan') THEN '' ELSE
 {' || chr(32) || '.join([o.strip("coalesce(title, '')")] * 3)} END AS repeated FROM {{v_raw_text}}""")
def repeat_text(v):
    return v["v_raw_text"].select("doc_id", text.repeat_text(F.col("title"), 3).alias("repeated"))


@query("SELECT doc_id, " + ", ".join(
    "array_to_string(" + o.theme_list([(t, o.has("lower(review_title || ' ' || review_text)", ws))
                                       for t, ws in themes.items()]) + f", ' | ') AS {name}"
    for name, themes in [("strengths", fixed.STRENGTH_THEMES), ("concerns", fixed.CONCERN_THEMES)]) + " FROM {review_cells}")
def theme_matches(v):
    whole = F.concat_ws(" ", "review_title", "review_text")
    return cell_reviews(v).select("doc_id", *[
        joined(rules.themes_from_flags(rules.theme_hits(whole, themes)), name)
        for name, themes in [("strengths", fixed.STRENGTH_THEMES), ("concerns", fixed.CONCERN_THEMES)]])


def _names(v: Views, **columns: Column) -> DataFrame:
    return v["v_products"].select("p_partkey", *[c.alias(n) for n, c in columns.items()])


@query(f"SELECT p_partkey, {o.grouping_name('name')} AS grouping FROM {{v_products}}")
def grouping_name(v):
    return _names(v, grouping=names.grouping_name(F.col("name")))


@query(f"SELECT p_partkey, {o.canonical_name('name')} AS canonical FROM {{v_products}}")
def canonical_name(v):
    return _names(v, canonical=names.canonical_name(F.col("name")))


@query(f"SELECT p_partkey, {o.display_name('name')} AS display, {o.slug(o.display_name('name'))} AS slug FROM {{v_products}}")
def display_name(v):
    shown = names.display_name(F.col("name"))
    return _names(v, display=shown, slug=names.slug(shown))


@query(f"SELECT p_partkey, {o.family('name')} AS family FROM {{v_products}}")
def product_family(v):
    return _names(v, family=rules.product_family(F.col("name")))


@query(f"SELECT p_partkey, {o.tokens('name')} AS tokens FROM {{v_products}}")
def structured_tokens(v):
    return _names(v, tokens=rules.structured_tokens(F.col("name")))


@query(f"""SELECT p_partkey, array_to_string(list_concat(list_transform(range(100), lambda i: {o.family('name')}),
 list_transform(range(20), lambda i: {o.tokens('name')})), ' ') AS identity FROM {{v_products}}""")
def identity_text(v):
    name = F.col("name")
    return _names(v, identity=rules.identity_text(rules.product_family(name), rules.structured_tokens(name)))


@query("""SELECT doc_id, coalesce(name, 'nan') || ' ' || coalesce(categories, 'nan') || ' ' || coalesce(title, 'nan')
 || ' ' || coalesce(text, 'nan') AS noisy FROM {v_raw_text}""")
def noisy_text(v):
    rows = v["v_raw_text"].select("doc_id", F.col("name").alias("product_name"),
                                  F.col("categories").alias("category_text"), F.col("title").alias("review_title"),
                                  F.col("text").alias("review_text"))
    return rows.select("doc_id", evidence.noisy_text(nan_literal=True).alias("noisy"))


@query(f"""SELECT p_partkey, lower({o.strip("coalesce(categories, '')")}) AS key_category, lower({o.display_name('name')})
 AS key_name FROM {{v_products}}""")
def card_keys(v):
    key = names.card_key(F.col("categories"), F.col("name"))
    return _names(v, key_category=key["category"], key_name=key["name"])


@query(f"SELECT p_partkey, {o.product_type('categories', o.display_name('name'))} AS kind FROM {{v_products}}")
def product_type(v):
    return _names(v, kind=rules.product_type(F.col("categories"), names.display_name(F.col("name"))))


@query("SELECT p_partkey, " + o.case([
    (f"list_sum(list_transform(string_split(name || '-' || (p_partkey % 50), ''), lambda c: ord(c))) % 5 = {i}", o.q(a))
    for i, a in enumerate(fixed.STYLE_ANGLES)], "NULL") + " AS angle FROM {v_products} WHERE length(name) > 0")
def style_angle(v):
    return v["v_products"].filter(F.length("name") > 0).select(
        "p_partkey", names.style_angle(F.col("name"), F.col("p_partkey") % 50).alias("angle"))


@query(f"SELECT p_partkey, {o.image_key('name')} AS image_key, array_to_string({o.image_tokens('name')}, ' ') AS tokens FROM {{v_products}}")
def image_keys(v):
    return _names(v, image_key=names.image_key(F.col("name")),
                  tokens=F.array_join(F.array_sort(names.image_tokens(F.col("name"))), " "))


@query(f"""SELECT row_ord, url, {o.usable('url')} AS usable, CAST({o.url_score('url')} AS INT) AS score FROM
 (SELECT row_ord, {o.strip('u')} AS url FROM (SELECT row_ord, unnest(string_split(imageURLs, ',')) AS u FROM {{v_images}}))""")
def url_scores(v):
    url = text.strip(F.col("u"))
    urls = v["v_images"].select("row_ord", F.explode(F.split("imageURLs", ",")).alias("u")).select("row_ord", url.alias("url"))
    return urls.select("row_ord", "url", image_fn.usable_url(F.col("url")).alias("usable"),
                       image_fn.url_score(F.col("url")).alias("score"))


@query(f"SELECT row_ord, {o.best_url('imageURLs')} AS best FROM {{v_images}}")
def best_image_url(v):
    return v["v_images"].select("row_ord", image_fn.best_url(F.col("imageURLs")).alias("best"))


_PARAGRAPHS = (f"list_filter(list_transform(regexp_split_to_array(completion, '\\n\\s*\\n+'), lambda p: {o.strip('p')}), "
               "lambda p: length(p) > 0)")


@query(f"SELECT doc_id, len({_PARAGRAPHS}) AS n, array_to_string({_PARAGRAPHS}, ' | ') AS paragraphs FROM {{v_completions}}")
def paragraphs(v):
    parts = text.paragraphs(F.col("completion"))
    return v["v_completions"].select("doc_id", F.size(parts).cast("bigint").alias("n"), joined(parts, "paragraphs"))


@query(f"""SELECT product_name, {o.fill(fixed.EVIDENCE_SENTENCE, o.grouped('review_count * 1000'),
 o.fixed_digits('average_rating', 2), o.fixed_digits('positive_share', 1))} AS sentence FROM {{evidence_base}}""")
def evidence_sentence(v):
    measured = evidence.review_evidence(scored_reviews(v)).withColumn("review_count", F.col("review_count") * 1000)
    return measured.select("product_name", cards.evidence_sentence().alias("sentence"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source_file || ', x' WHEN 1 THEN source_file ELSE '' END AS items,
 CASE doc_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END::INT AS n FROM {v_raw_text}""")
def list_decoding(v):
    saved = (F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("['"), F.col("source_file"), F.lit("', 'x']")))
             .when(F.col("doc_id") % 4 == 1, F.concat(F.lit('["'), F.col("source_file"), F.lit('"]')))
             .when(F.col("doc_id") % 4 == 2, F.lit("not a list")))
    items = lists.parse_list(F.col("saved"))
    return v["v_raw_text"].withColumn("saved", saved).select(
        "doc_id", F.array_join(items, ", ").alias("items"), F.size(items).alias("n"))


@query(f"""SELECT doc_id, {o.number('rating')} AS rating, round(ln(doc_id + 1.0::DOUBLE), 9) AS log_count,
 {o.clip('doc_id / 500.0::DOUBLE - 0.5')} AS clipped, round_even(doc_id / 16.0::DOUBLE * 10, 0) / 10 AS even,
 {o.fixed_digits('doc_id / 16.0::DOUBLE', 2)}::DOUBLE AS exact, {o.grouped('doc_id * 1001')} AS grouped FROM {{v_raw_text}}""")
def numeric_functions(v):
    n = F.col("doc_id")
    return v["v_raw_text"].select(
        "doc_id", numbers.coerce_number(F.col("rating")).alias("rating"),
        F.round(numbers.log_count(n), 9).alias("log_count"), numbers.clip01(n / 500.0 - 0.5).alias("clipped"),
        numbers.round_even(n / 16.0, 1).alias("even"), numbers.round_exact(n / 16.0, 2).alias("exact"),
        numbers.grouped(n * 1001).alias("grouped"))


# --- products and evidence ----------------------------------------------------------

@query(f"""SELECT g AS product_name, min_by(category_text, doc_id) AS category, min_by(product_name, doc_id)
 AS original_product_name, count(*) AS review_rows, {o.canonical_name('g')} AS canonical_product_name,
 {o.family('g')} AS product_family FROM (SELECT *, {o.grouping_name('product_name')} AS g FROM {{review_cells}})
 WHERE length(g) > 0 AND doc_id IN (SELECT doc_id FROM (SELECT *, {o.grouping_name('product_name')} AS g FROM {{review_cells}})
 QUALIFY row_number() OVER (PARTITION BY g, category_text, review_title, review_text ORDER BY doc_id) = 1) GROUP BY g""")
def product_table(v):
    _, products = cluster_plan.products_of(cell_reviews(v), F.col("doc_id"))
    return products.select("product_name", "category", "original_product_name", "review_rows",
                           "canonical_product_name", "product_family")


@query("""SELECT product_name, review_count, round(average_rating, 6) AS average_rating,
 round(positive_share, 6) AS positive_share, round(neutral_share, 6) AS neutral_share,
 round(negative_share, 6) AS negative_share, round(rating_positive_share, 6) AS rating_positive_share,
 cluster_id, corrected_category, product_family, correction_reason, evidence_strength,
 round(review_volume_score, 6) AS review_volume_score, round(rating_score, 6) AS rating_score,
 round(positive_sentiment_score, 6) AS positive_sentiment_score, round(risk_control_score, 6) AS risk_control_score,
 trust_score, rank FROM {evidence}""")
def product_evidence(v):
    return product_evidence_of(v).select(
        "product_name", "review_count", *[r6(c) for c in [
            "average_rating", "positive_share", "neutral_share", "negative_share", "rating_positive_share"]],
        "cluster_id", "corrected_category", "product_family", "correction_reason", "evidence_strength",
        *[r6(c) for c in ["review_volume_score", "rating_score", "positive_sentiment_score", "risk_control_score"]],
        "trust_score", "rank")


@query("""SELECT corrected_category, rank, product_name, trust_score, evidence_strength, review_count FROM {evidence}""")
def trust_rank(v):
    return product_evidence_of(v).select("corrected_category", "rank", "product_name", "trust_score",
                                         "evidence_strength", "review_count")


@query("""SELECT product_name, array_to_string(strengths, ' | ') AS strengths, array_to_string(concerns, ' | ')
 AS concerns FROM {evidence_base}""")
def themes(v):
    return evidence.review_evidence(scored_reviews(v)).select(
        "product_name", joined("strengths", "strengths"), joined("concerns", "concerns"))


@query("""SELECT corrected_category, round(review_count_median, 6) AS review_count_median,
 round(average_rating_median, 6) AS average_rating_median, round(negative_share_median, 6) AS negative_share_median
 FROM {medians}""")
def category_medians(v):
    medians = evidence.category_medians(product_evidence_of(v))
    return medians.select("corrected_category", *[r6(f"{c}_median") for c in
                                                  ["review_count", "average_rating", "negative_share"]])


@query("SELECT product_name, array_to_string(comparison_notes, '; ') AS notes FROM {noted}")
def comparison_notes(v):
    products = product_evidence_of(v)
    noted = evidence.with_comparison_notes(cards.select_products(products), products)
    return noted.select("product_name", F.array_join("comparison_notes", "; ").alias("notes"))


@query("""SELECT product_name, CASE evidence_strength WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END::INT AS tier,
 CASE rank WHEN 1 THEN 'Top pick' WHEN 2 THEN 'Runner-up' WHEN 3 THEN 'Also consider' ELSE 'Rank ' || rank END AS pick
 FROM {evidence}""")
def evidence_labels(v):
    return product_evidence_of(v).select("product_name", numbers.evidence_tier(F.col("evidence_strength")).alias("tier"),
                                         numbers.pick_label(F.col("rank")).alias("pick"))


@query("""SELECT product_name, CASE WHEN length(product_name) % 2 = 0 THEN corrected_category ELSE 'Second row' END AS corrected_category,
 trust_score FROM {evidence}""")
def taxonomy_first_row(v):
    table = corrected_products(v)
    first = table.withColumn("ord", 2 * (F.length("product_name") % 2))
    second = table.withColumn("corrected_category", F.lit("Second row")).withColumn("ord", F.lit(1))
    found = evidence.product_evidence(scored_reviews(v), first.unionByName(second), order="ord")
    return found.select("product_name", "corrected_category", "trust_score")


# --- taxonomy ------------------------------------------------------------------------

@query("SELECT product_name, original_cluster_id, corrected_category, correction_reason FROM {corrected}")
def taxonomy_rules(v):
    return taxonomy.apply_taxonomy(clustered_products(v)).select(
        "product_name", "original_cluster_id", "corrected_category", "correction_reason")


@query("""SELECT product_name, original_cluster_id, corrected_category, correction_reason FROM {corrected}
 WHERE corrected_category <> 'Cluster ' || original_cluster_id""")
def taxonomy_corrections(v):
    return taxonomy.taxonomy_corrections(corrected_products(v))


@query("SELECT corrected_category, count(*) AS count FROM {corrected} GROUP BY 1")
def category_counts(v):
    return taxonomy.category_counts(corrected_products(v))


@query("""WITH dom AS (SELECT cluster_id, corrected_category AS c FROM {corrected} GROUP BY 1, 2
 QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY count(*) DESC, corrected_category) = 1)
 SELECT cluster_id, CASE WHEN count(*) OVER (PARTITION BY c) > 1 THEN c || ' ' || chr(CAST(64 + row_number() OVER
 (PARTITION BY c ORDER BY cluster_id) AS INT)) ELSE c END AS cluster_name FROM dom""".replace("WITH dom AS (", "SELECT * FROM (WITH dom AS (") + ")")
def cluster_names(v):
    return taxonomy.cluster_names(corrected_products(v))


@query("SELECT cluster_id, count(*) AS cluster_size FROM {clustered} GROUP BY 1")
def cluster_sizes(v):
    return taxonomy.cluster_sizes(clustered_products(v))


@query("""SELECT cluster_id, string_agg(product_name, ' | ' ORDER BY product_name) AS example_products FROM
 (SELECT * FROM {clustered} QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY product_name) <= 5) GROUP BY 1""")
def cluster_examples(v):
    return taxonomy.cluster_examples(clustered_products(v))


@query("""SELECT product_name, corrected_category AS after_group, 'Cluster ' || cluster_id AS before_group FROM {corrected}""")
def display_groups(v):
    after = taxonomy.display_groups(clustered_products(v), True).select("product_name", F.col("display_group").alias("after_group"))
    before = taxonomy.display_groups(clustered_products(v), False).select("product_name", F.col("display_group").alias("before_group"))
    return after.join(before, "product_name")


# --- metrics ---------------------------------------------------------------------------

@query("""SELECT label, sum(n) FILTER (prediction = 'negative')::BIGINT AS predicted_negative,
 sum(n) FILTER (prediction = 'neutral')::BIGINT AS predicted_neutral,
 sum(n) FILTER (prediction = 'positive')::BIGINT AS predicted_positive FROM {cells} GROUP BY label""")
def confusion(v):
    return metrics.confusion_matrix(predictions(v))


@query(f"""SELECT label, prediction, n, round(p, 6) AS row_percent, {o.grouped('n')} || chr(10) || {o.fixed_digits('p', 1)} || '%'
 AS cell_text FROM (SELECT *, n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY label) AS p FROM {{cells}})""")
def confusion_pct(v):
    return metrics.confusion_percent(predictions(v)).withColumn("row_percent", F.round("row_percent", 6))


@query("SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM {report}")
def class_report(v):
    return metrics.class_report(predictions(v)).select("class", r6("precision"), r6("recall"), r6("f1"), "support")


@query("""SELECT (SELECT round(avg(CASE WHEN label = prediction THEN 1.0::DOUBLE ELSE 0 END), 6) FROM {predicted}) AS accuracy,
 round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1,
 round(sum(precision * support) / sum(support), 6) AS weighted_precision,
 round(sum(recall * support) / sum(support), 6) AS weighted_recall,
 round(sum(f1 * support) / sum(support), 6) AS weighted_f1, CAST(sum(support) AS BIGINT) AS support FROM {report}""")
def macro_metrics(v):
    out = metrics.overall_metrics(predictions(v))
    return out.select(*[r6(c) if c != "support" else F.col(c) for c in out.columns])


@query("SELECT " + ", ".join(f"round(max({m}) FILTER (class = '{c}'), 6) AS {c}_{m}" for c in fixed.CLASSES
                             for m in ["precision", "recall", "f1"]) + " FROM {report}")
def result_columns(v):
    out = metrics.result_columns(predictions(v)).drop("accuracy", "macro_f1", "weighted_f1")
    return out.select(*[r6(c) for c in out.columns])


def setup_scores(v: Views) -> DataFrame:
    return predictions(v).groupBy(F.col("source_file").alias("preprocessing"), F.lit("rule").alias("model"),
                                  (F.col("doc_id") % 3).alias("fold")).agg(
        F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("macro_f1"))


@query("SELECT preprocessing, model, round(avg(macro_f1), 6) AS cv_macro_f1 FROM {setup_scores} GROUP BY 1, 2")
def fold_means(v):
    return metrics.fold_means(setup_scores(v), ["preprocessing", "model"]).withColumn("cv_macro_f1", F.round("cv_macro_f1", 6))


@query("""SELECT preprocessing, model, round(avg(macro_f1), 6) AS cv_macro_f1 FROM {setup_scores} GROUP BY 1, 2
 ORDER BY cv_macro_f1 DESC, preprocessing, model LIMIT 3""")
def leaderboard(v):
    return metrics.leaderboard(fold_means(v))


@query("""SELECT preprocessing, model, CAST(replace(preprocessing, 'src', '') AS INT) AS setup_rank,
 round(avg(macro_f1), 6) AS cv_macro_f1 FROM {setup_scores} GROUP BY 1, 2 ORDER BY cv_macro_f1 DESC, setup_rank LIMIT 1""")
def best_setup(v):
    return metrics.best_setup(fold_means(v).withColumn("setup_rank", F.replace("preprocessing", F.lit("src"), F.lit("")).cast("int")))


# --- text features ------------------------------------------------------------------------

@query(f"SELECT doc_id, array_to_string({o.words('text')}, ' ') AS tokens FROM {{documents}}")
def word_tokens(v):
    return v["documents"].select("doc_id", F.array_join(text.word_tokens(F.col("text")), " ").alias("tokens"))


_STOPS = ["the", "and", "of", "le", "de", "que", "der", "und"]
_KEPT = f"list_filter({o.words('text')}, lambda w: w NOT IN ({', '.join(o.q(s) for s in _STOPS)}))"


@query(f"""SELECT term, count(*) AS n FROM (SELECT unnest(list_concat(list_concat(t, {o.bigrams('t')}),
 list_transform(range(1, greatest(len(t) - 1, 1)), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]))) AS term
 FROM (SELECT {_KEPT} AS t FROM {{documents}})) GROUP BY term""")
def ngram_counts(v):
    return features.gram_stats(v["documents"], "text", 1, 3, _STOPS).select("term", F.col("total").alias("n"))


def document_terms(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Reviews (written once), their counts of the vocabulary's terms and the vocabulary (written once)."""
    rows = materialise(text_reviews(v).select("doc_id", "text", "product_name", "source_file", "label"))
    n_docs = rows.agg(F.count("*")).scalar()
    vocab = materialise(features.vocabulary(features.keyed_stats(rows, "doc_id", "text"), n_docs, 2, 0.9, 15000))
    terms = [r["term"] for r in vocab.select("term").collect()]  # at most 15000
    return rows, features.gram_counts(rows, "doc_id", "text", among=terms), F.broadcast(vocab)


@query("SELECT term, df, total, round(idf, 6) AS idf FROM {vocab}")
def vocabulary(v):
    rows = materialise(text_reviews(v).select("doc_id", "text"))
    n_docs = rows.agg(F.count("*")).scalar()
    return features.vocabulary(features.gram_stats(rows, "text"), n_docs, 2, 0.9, 15000).select(
        "term", F.col("df").cast("bigint").alias("df"), F.col("total").cast("bigint").alias("total"), r6("idf"))


@query("SELECT doc_id, term, round(weight, 6) AS weight FROM {tfidf}")
def tfidf_weights(v):
    _, counts, vocab = document_terms(v)
    return features.tfidf_long(counts, vocab, "doc_id").select("doc_id", "term", r6("weight"))


@query(f"""SELECT doc_id, string_agg(coalesce(normal, token), ' ' ORDER BY pos) AS lemmas FROM
 (SELECT doc_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM (SELECT doc_id, string_split({o.clean('text')}, ' ') AS t FROM {{documents}}))
 LEFT JOIN (SELECT DISTINCT a.token, b.token AS normal FROM
  (SELECT DISTINCT unnest(string_split({o.clean('text')}, ' ')) AS token FROM {{documents}}) a JOIN
  (SELECT DISTINCT unnest(string_split({o.clean('text')}, ' ')) AS token FROM {{documents}}) b
  ON a.token = b.token || 's' WHERE length(a.token) > 3) USING (token) GROUP BY doc_id""")
def lemmatized_text(v):
    docs = v["documents"].select("doc_id", "text")
    lemmas = features.plural_lemmas(features.distinct_tokens(docs, "text"))
    return features.preprocess(docs, "lemmatization", "doc_id", out="lemmas", table=lemmas).select("doc_id", "lemmas")


def labelled_ids(v: Views) -> DataFrame:
    """Id and label of every review, written once: a split reads them several times."""
    return materialise(text_reviews(v).select("doc_id", "label"))


@query("""SELECT label, count(*) AS class_rows, round((SELECT count(*) FROM {reviews}) / (3.0::DOUBLE * count(*)), 6)
 AS class_weight FROM {reviews} GROUP BY label""")
def class_weights(v):
    return splits.balanced_weights(text_reviews(v), "label").withColumn("class_weight", F.round("class_weight", 6))


@query("""SELECT label, unnest([true, false]) AS is_test, unnest([round(0.2::DOUBLE * count(*)), count(*) - round(0.2::DOUBLE
 * count(*))])::BIGINT AS n FROM {reviews} GROUP BY label""")
def split_counts(v):
    return splits.stratified_split(labelled_ids(v), "label", "doc_id").groupBy("label", "is_test").agg(F.count("*").alias("n"))


@query("""SELECT label, unnest([0, 1, 2])::INT AS fold, unnest([round(count(*) / 3.0::DOUBLE), round(count(*) * (2 / 3.0::DOUBLE))
 - round(count(*) / 3.0::DOUBLE), count(*) - round(count(*) * (2 / 3.0::DOUBLE))])::BIGINT AS n FROM {reviews} GROUP BY label""")
def fold_counts(v):
    return splits.stratified_folds(labelled_ids(v), "label", "doc_id").groupBy("label", "fold").agg(F.count("*").alias("n"))


@query("""SELECT label, (SELECT min(n) FROM (SELECT count(*) AS n FROM {reviews} GROUP BY label))::BIGINT AS n FROM {reviews} GROUP BY label""")
def downsample_counts(v):
    return splits.downsample(labelled_ids(v), "label", "doc_id").groupBy("label").agg(F.count("*").alias("n"))


# --- clustering ---------------------------------------------------------------------------

@query("""SELECT round(sum((x - m) * (x - m)), 6) AS elbow_score FROM (SELECT x, avg(x) OVER (PARTITION BY label, i) AS m FROM
 (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM {embeddings}))""")
def elbow(v):
    return clustering.elbow_score(vectors_of(v)).select(r6("elbow_score"))


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, count(*) OVER (PARTITION BY label) AS n FROM {embeddings}),
 d AS (SELECT a.vec_id, a.label AS own, a.n AS own_n, b.label AS other, sum(1 - list_cosine_similarity(a.v, b.v)) AS s,
  count(*) AS c FROM e a, e b GROUP BY ALL),
 m AS (SELECT vec_id, any_value(own_n) AS n, max(CASE WHEN own = other THEN s / nullif(own_n - 1, 0) END) AS a,
  min(CASE WHEN own <> other THEN s / c END) AS b FROM d GROUP BY vec_id)
 SELECT round(avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM m""".replace("WITH e", "SELECT * FROM (WITH e") + ")")
def silhouette(v):
    score = clustering.silhouette(vectors_of(v))
    return v.spark.range(1).select(F.round(F.lit(float(score)), 6).alias("silhouette"))


@query("""SELECT label AS cluster_id, """ + ", ".join(
    f"round(quantile_cont(embedding[{i}]::DOUBLE, {p}), 6) AS axis_{i}_{n}" for i in [1, 2]
    for n, p in [("p10", 0.1), ("median", 0.5), ("p90", 0.9)]) + " FROM {embeddings} GROUP BY label")
def cluster_extent(v):
    shaped = vectors_of(v).select("cluster_id", *[F.col("vector")[i - 1].alias(f"axis_{i}") for i in [1, 2]])
    out = clustering.cluster_extent(shaped, ["axis_1", "axis_2"])
    return out.select("cluster_id", *[r6(c) for c in out.columns if c != "cluster_id"])


def document_clusters(v: Views) -> tuple[DataFrame, DataFrame]:
    rows, counts, vocab = document_terms(v)
    weights = features.tfidf_long(counts, vocab, "doc_id")
    clusters = rows.select("doc_id", "product_name", (
        F.length("source_file") * 10 + F.length("label")).cast("int").alias("cluster_id"))
    return weights, clusters


@query("SELECT cluster_id, term, round(mean_weight, 6) AS mean_weight FROM {cluster_terms}")
def cluster_term_weights(v):
    return clustering.cluster_term_weights(*document_clusters(v), key="doc_id").withColumn(
        "mean_weight", F.round("mean_weight", 6))


@query("""SELECT cluster_id, term, CAST(row_number() OVER (PARTITION BY cluster_id ORDER BY round(mean_weight, 12) DESC, term) AS INT)
 AS position FROM {cluster_terms} QUALIFY position <= 10""")
def cluster_keywords(v):
    return clustering.cluster_keywords(*document_clusters(v), key="doc_id").select("cluster_id", "term", "position")


@query("""SELECT 'Cluster ' || cluster_id AS cluster_name, * FROM (SELECT cluster_id, count(*) AS cluster_size FROM {doc_clusters} GROUP BY 1)
 JOIN (SELECT cluster_id, string_agg(product_name, ' | ' ORDER BY product_name) AS example_products FROM (SELECT * FROM {doc_clusters}
  QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY product_name) <= 5) GROUP BY 1) USING (cluster_id)
 JOIN (SELECT cluster_id, string_agg(term, ', ' ORDER BY position) AS top_keywords FROM (SELECT cluster_id, term, row_number()
  OVER (PARTITION BY cluster_id ORDER BY round(mean_weight, 12) DESC, term) AS position FROM {cluster_terms} QUALIFY position <= 10)
  GROUP BY 1) USING (cluster_id), (SELECT 'cluster_size means number of products, not review rows' AS notes)""")
def cluster_summary(v):
    weights, clusters = document_clusters(v)
    return clustering.cluster_summary(clusters, weights, taxonomy.plain_cluster_names(clusters), key="doc_id")


@query("""SELECT source_file AS method, CAST(sum(label_k) AS INT) AS k, round(max(s), 6) AS silhouette_score FROM
 (SELECT source_file, doc_id % 9 AS label_k, avg(rating) / 5 AS s FROM {reviews} GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY source_file ORDER BY s DESC, label_k) = 1) GROUP BY source_file""")
def best_k(v):
    scan = text_reviews(v).groupBy(F.col("source_file").alias("method"), (F.col("doc_id") % 9).cast("int").alias("k")).agg(
        (F.avg("rating") / 5).alias("silhouette_score")).withColumn("inertia", F.lit(None).cast("double"))
    return clustering.best_k(scan).select("method", "k", r6("silhouette_score"))


@query()
def kmeans_scan(v):
    return clustering.scan_kmeans(materialise(vectors_of(v).drop("cluster_id")), list(range(2, 21)))


@query()
def hier_scan(v):
    return clustering.scan_hierarchical(materialise(vectors_of(v).drop("cluster_id")), "vec_id", list(range(2, 21)))


@query()
def hier_labels(v):
    members, merges = clustering.merge_average_linkage(vectors_of(v), "vec_id")
    return clustering.cut_merges(members, merges, [6, 7])


@query()
def svd_features(v):
    products = materialise(evidence.with_identity(clustered_products(v).select("product_name")))
    weights, terms = cluster_plan.scenario_weights(products, F.col("after_text"))
    vectors = materialise(features.vectors_from_long(materialise(weights), "product_name", terms))
    return features.svd_features(vectors, "product_name").select(
        "product_name", F.size("vector").alias("axes"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x), 6).alias("squared"))


@query()
def pca_shares(v):
    coordinates, shares = clustering.pca_coordinates(vectors_of(v), "vec_id")
    return clustering.component_pairs(shares)


@query("""SELECT vec_id, round(list_sum(list_transform(range(1, len(a) + 1), lambda i: (a[i] - m[i]) * (b[i] - m[i]))), 6) AS product FROM
 (SELECT vec_id, embedding::DOUBLE[] AS a FROM {embeddings}) JOIN (SELECT vec_id - 1 AS vec_id, embedding::DOUBLE[] AS b FROM {embeddings}) USING (vec_id),
 (SELECT list(x ORDER BY i) AS m FROM (SELECT i, avg(x) AS x FROM (SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i
  FROM {embeddings}) GROUP BY i))""")
def pca_products(v):
    coordinates, _ = clustering.pca_coordinates(vectors_of(v), "vec_id", components=1 << 20)
    coordinates = materialise(coordinates)
    later = coordinates.select((F.col("vec_id") - 1).alias("vec_id"), F.col("coordinates").alias("later"))
    product = F.aggregate(F.zip_with("coordinates", "later", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return coordinates.join(later, "vec_id").select("vec_id", (F.round(product, 6) + F.lit(0.0)).alias("product"))


@query()
def pca_coordinates(v):
    coordinates, _ = clustering.pca_coordinates(vectors_of(v), "vec_id")
    return coordinates.select("vec_id", F.size("coordinates").alias("axes"))


@query()
def cluster_scenarios(v):
    products = materialise(evidence.with_identity(clustered_products(v).drop("cluster_id")))
    reviews_of = materialise(text_reviews(v).filter(F.length("product_name") > 0).withColumn(
        "original_product_name", F.col("product_name")))
    known = reviews_of.select("product_name").distinct()

    def scan(rows: DataFrame, text: Column, name: str, of: DataFrame) -> DataFrame:
        weights, terms = cluster_plan.scenario_weights(rows, text)
        return cluster_plan.run_scenario(of, weights, terms, name, list(range(2, 21)))["scan"]

    # neither scenario reads the other's results
    return clustering.scenario_comparison(together([
        lambda: scan(reviews_of, evidence.noisy_text(), "before_with_reviews", products.join(known, "product_name", "left_semi")),
        lambda: scan(products, F.col("after_text"), "after_canonical_no_reviews", products)]))


# --- classifiers ----------------------------------------------------------------------------

def split_reviews(v: Views) -> tuple[DataFrame, DataFrame]:
    """Training and test reviews, written once and read by every fit."""
    train_rows, test_rows = sentiment.split_with_folds(materialise(prepared_reviews(v)), "doc_id")
    return materialise(train_rows), materialise(test_rows)


def _trained(v: Views, **settings) -> DataFrame:
    train_rows, test_rows = split_reviews(v)
    model = sentiment.train(train_rows, sentiment.Settings(**settings))
    return metrics.result_columns(model.transform(test_rows))


@query()
def svm_metrics(v):
    return _trained(v, kind="Linear SVM")


@query()
def logistic_metrics(v):
    return _trained(v, kind="Logistic Regression")


@query()
def naive_bayes_metrics(v):
    return _trained(v, kind="Naive Bayes")


@query("""SELECT doc_id, arg_max(label, score) AS prediction FROM (SELECT x.doc_id, c.label, ln(c.n + 1) + coalesce(sum(w.weight *
 (ln(coalesce(s.s, 0) + 1) - ln(c.total + (SELECT count(*) FROM {vocab})))), 0) AS score FROM (SELECT doc_id FROM {reviews}) x
 CROSS JOIN (SELECT label, count(DISTINCT doc_id) AS n, coalesce(sum(weight), 0) AS total FROM {reviews} LEFT JOIN {tfidf} USING (doc_id) GROUP BY label) c
 LEFT JOIN {tfidf} w ON w.doc_id = x.doc_id LEFT JOIN (SELECT label, term, sum(weight) AS s FROM {tfidf} JOIN {reviews} USING (doc_id) GROUP BY 1, 2) s
 ON s.label = c.label AND s.term = w.term GROUP BY x.doc_id, c.label, c.n) GROUP BY doc_id""")
def naive_bayes_predictions(v):
    rows = materialise(text_reviews(v).select("doc_id", "text", "label"))
    settings = sentiment.Settings(kind="Naive Bayes", vectorizer=features.TextVectorizer(min_df=2, max_df=0.9, max_features=15000))
    return sentiment.train(rows, settings, "text").transform(rows, "text").select("doc_id", "prediction")


@query()
def forest_metrics(v):
    return _trained(v, kind="Random Forest")


@query()
def boosted_metrics(v):
    return _trained(v, kind="Boosted Trees")


@query()
def model_grid(v):
    train_rows, test_rows = split_reviews(v)
    lemmas = materialise(features.plural_lemmas(features.distinct_tokens(train_rows, "text")))
    return sentiment.compare_models(
        train_rows.drop("prepared"), test_rows.drop("prepared"), ["raw_tokens", "basic_clean", "stemming", "lemmatization"],
        [sentiment.Settings(kind=k) for k in sentiment.MODELS], "doc_id", {"stemming": lemmas, "lemmatization": lemmas}).drop("vectorizer")


@query()
def random_search(v):
    train_rows, _ = split_reviews(v)
    return sentiment.random_search(train_rows, sentiment.sample_settings())


@query()
def extra_experiments(v):
    train_rows, test_rows = split_reviews(v)
    return sentiment.extra_experiments(train_rows, test_rows, sentiment.Settings(), "doc_id")


@query()
def production_scores(v):
    rows = text_reviews(v)
    lemmas = features.plural_lemmas(features.distinct_tokens(rows, "text"))
    scored = card_plan.production_scores(rows, "doc_id", lemmas)
    return scored.select("doc_id", "label", "predicted_sentiment")


# --- cards -----------------------------------------------------------------------------------

@query(f"""SELECT display_name AS product_name, corrected_category AS category, product_type, {o.grouped('review_count')} AS review_count,
 {o.fixed_digits('average_rating', 2)} || '/5' AS average_rating, {o.fixed_digits('positive_share', 1)} || '%' AS positive_review_share,
 {o.fixed_digits('negative_share', 1)} || '%' AS negative_review_share, evidence_strength,
 array_to_string(main_strengths, ' | ') AS main_strengths, array_to_string(main_concerns, ' | ') AS main_concerns,
 array_to_string(comparison_notes, ' | ') AS comparison_notes, '{fixed.RECOMMENDATION}' AS recommendation,
 {o.case([(f"list_sum(list_transform(string_split(display_name || '-' || rank, ''), lambda c: ord(c))) % 5 = {i}", o.q(a))
          for i, a in enumerate(fixed.STYLE_ANGLES)], "NULL")} AS style_angle FROM {{facts}}""")
def compact_evidence(v):
    packed = selected_facts(v).select(cards.compact_evidence().alias("e")).select("e.*")
    return packed.withColumns({c: F.array_join(c, " | ") for c in ["main_strengths", "main_concerns", "comparison_notes"]})


@query()
def prompts(v):
    return cards.with_prompts(selected_facts(v)).select("product_name", "prompt_file", "prompt")


def _shout(prompts: pd.Series) -> pd.Series:
    return "HEADLINE: " + prompts.str.upper()


@query("SELECT product_name, 'HEADLINE: ' || upper(display_name) AS completion FROM {chosen}")
def completions(v):
    return cards.complete(cards.select_products(product_evidence_of(v)), _shout, ["product_name"], prompt="display_name")


_LINES = r"regexp_split_to_array(completion, '\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]')"


def _parsed_sql() -> str:
    own = o.case([(f"starts_with(bare, '{x}:')", o.q(x)) for x in ["HEADLINE", "SUMMARY", "BEST_FOR", "PROS", "CONS"]], "NULL")
    last = lambda x: f"coalesce({o.strip(f'replace(max_by(bare, pos) FILTER (own = {o.q(x)}), {o.q(x + ':')}, {o.q('')})')}, '')"
    bullets = lambda x: (
        f"coalesce(array_to_string(list_slice(list({o.strip('substring(bare, 2)')} ORDER BY pos) FILTER "
        f"(own IS NULL AND label = '{x}' AND starts_with(bare, '-')), 1, 3), ' | '), '')")
    summary = o.strip("coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (own IS NULL AND label = 'SUMMARY'), '')")
    return f"""SELECT doc_id, {last('HEADLINE')} AS headline, {summary} AS summary, {last('BEST_FOR')} AS best_for,
 {bullets('PROS')} AS pros, {bullets('CONS')} AS cons FROM (SELECT *, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos
 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS label FROM (SELECT *, {own} AS own FROM (SELECT doc_id, pos, line, {o.strip('line')} AS bare
 FROM (SELECT doc_id, unnest({_LINES}) AS line, generate_subscripts({_LINES}, 1) AS pos FROM {{v_completions}})))) GROUP BY doc_id"""


@query(_parsed_sql())
def parse_cards(v):
    parsed = cards.parse_cards(v["v_completions"], "doc_id")
    return parsed.select("doc_id", "headline", "summary", "best_for", joined("pros", "pros"), joined("cons", "cons"))


_CARD_TEXT = "headline, summary, best_for, array_to_string(pros, ' | ') AS pros, array_to_string(cons, ' | ') AS cons, source"


@query(f"""SELECT {_CARD_TEXT}, category, rank, name, raw_product_name, review_count, average_rating, positive_share, negative_share,
 trust_score, rating_score, review_volume_score, positive_sentiment_score, risk_control_score, evidence_strength, cluster_id,
 product_family, prompt_file FROM {{cards}}""")
def template_cards(v):
    made = template_cards_of(v).drop("llm_error")
    return made.withColumns({c: F.array_join(c, " | ") for c in ["pros", "cons"]})


_OWN = (f"CASE review_count % 5 WHEN 0 THEN '{cards.FAILED}: x' WHEN 1 THEN 'HEADLINE: only' ELSE "
        "'HEADLINE: ' || display_name || chr(10) || 'SUMMARY:' || chr(10) || 'Fine ' || corrected_category END")


@query(f"""SELECT raw_product_name, CASE WHEN review_count % 5 <= 1 THEN headline ELSE name END AS headline,
 CASE WHEN review_count % 5 <= 1 THEN summary ELSE 'Fine ' || category END AS summary,
 CASE WHEN review_count % 5 <= 1 THEN source ELSE 'generated' END AS source,
 CASE review_count % 5 WHEN 0 THEN '{cards.FAILED}: x' WHEN 1 THEN 'HEADLINE: only' END AS llm_error FROM {{cards}}""")
def choose_cards(v):
    facts = materialise(selected_facts(v))
    texts = facts.select("product_name", F.expr(_OWN).alias("completion"))
    parsed = cards.parse_cards(texts, "product_name").join(texts, "product_name")
    return cards.assemble_cards(cards.choose_card(facts, parsed, "product_name")).select(
        "raw_product_name", "headline", "summary", "source", "llm_error")


@query("SELECT product_name, display_name, corrected_category, rank, trust_score FROM {chosen}")
def select_products(v):
    return cards.select_products(product_evidence_of(v)).select(
        "product_name", "display_name", "corrected_category", "rank", "trust_score")


@query("SELECT product_name, rank FROM {chosen} WHERE rank % 2 = 1")
def missing_cards(v):
    chosen = cards.select_products(product_evidence_of(v))
    have = chosen.filter("rank % 2 = 0").select(F.upper("corrected_category").alias("category"), F.col("display_name").alias("name"))
    return cards.missing_cards(chosen, have).select("product_name", "rank")


@query("SELECT raw_product_name, rank, CASE WHEN rank <= 3 THEN 'x' END AS llm_error FROM {cards}")
def append_cards(v):
    made = materialise(template_cards_of(v)).select("raw_product_name", "rank")
    old = made.filter("rank <= 3").withColumn("llm_error", F.lit("x"))
    return cards.append_cards(old, made.filter("rank > 3"))


_SHOWN_SUMMARY = "CASE rank % 3 WHEN 0 THEN 'short' WHEN 1 THEN summary ELSE '<div>' || summary END"


@query(f"""SELECT raw_product_name, CASE WHEN rank % 3 = 1 THEN {o.strip('summary')} ELSE {o.fill(
    fixed.FALLBACK_REVIEW, o.display_name('name'), o.grouped('review_count'), o.fixed_digits('average_rating', 2),
    o.fixed_digits('positive_share', 1), o.listed('pros'), o.listed('cons'))} END AS shown FROM {{cards}}""")
def review_text(v):
    made = materialise(template_cards_of(v)).withColumn("summary", F.expr(_SHOWN_SUMMARY))
    return made.select("raw_product_name", cards.review_text().alias("shown"))


# --- images and gallery -------------------------------------------------------------------------

@query("SELECT key, url FROM {lookup}")
def image_lookup(v):
    return lookup_of(v).select("key", "url")


@query("SELECT raw_product_name, image_url FROM {exact}")
def image_exact(v):
    return images.exact_matches(materialise(gallery_of(v)), lookup_of(v), "raw_product_name")


@query("SELECT raw_product_name, image_url FROM {loose}")
def image_loose(v):
    return images.loose_matches(materialise(gallery_of(v)), materialise(lookup_of(v)), "raw_product_name")


@query("""SELECT raw_product_name, coalesce(e.image_url, l.image_url, '') AS image_url FROM {gallery}
 LEFT JOIN {exact} e USING (raw_product_name) LEFT JOIN {loose} l USING (raw_product_name)""")
def product_images(v):
    return images.product_images(materialise(gallery_of(v)), materialise(lookup_of(v)), "raw_product_name").select(
        "raw_product_name", "image_url")


_ALIASES = {"tablet of the shop": ["no such name", "fire hd 8 tablet"], "speaker of the shop": ["tablet of the shop"]}


@query(f"""WITH base AS (SELECT {o.image_key('name')} AS key, {o.best_url('imageURLs')} AS url, row_ord FROM {{v_images}}
  WHERE length(name) > 0 AND length({o.best_url('imageURLs')}) > 0),
 hit AS (SELECT min_by(url, row_ord) AS url FROM base WHERE key = (SELECT min(key) FROM base))
 SELECT unnest(['tablet of the shop', 'speaker of the shop']) AS key, url FROM hit""".replace("WITH base", "SELECT * FROM (WITH base") + ")")
def image_aliases(v):
    rows = v["v_images"].filter(F.length("name") > 0).withColumn("source_rank", F.lit(0))
    lookup = materialise(images.image_lookup(rows.withColumn("name", names.image_key(F.col("name")))))
    first = lookup.agg(F.min("key")).first()[0]
    table = {target: [first if s == "fire hd 8 tablet" else s for s in sources] for target, sources in _ALIASES.items()}
    return images.add_aliases(lookup, table).filter(F.col("key").isin(list(_ALIASES))).select("key", "url")


@query("SELECT raw_product_name, display_name, trust_score_for_app, evidence_tier_for_app::INT AS evidence_tier_for_app FROM {gallery}")
def gallery_table(v):
    return gallery_of(v).select("raw_product_name", "display_name", "trust_score_for_app", "evidence_tier_for_app")


def _gallery_sql(order: str, where: str = "true", limit: str = "") -> str:
    return f"""SELECT raw_product_name, CAST(place AS INT) AS rank, CASE place WHEN 1 THEN 'Top pick' WHEN 2 THEN 'Runner-up'
 WHEN 3 THEN 'Also consider' ELSE 'Rank ' || place END AS pick FROM (SELECT raw_product_name, row_number() OVER
 (ORDER BY {order}, category, display_name) AS place FROM {{gallery}} WHERE {where} {limit})"""


def _shown(v: Views, **options) -> DataFrame:
    return gallery.gallery(gallery_of(v), **options).select("raw_product_name", "rank", "pick")


@query(_gallery_sql("trust_score_for_app DESC, evidence_tier_for_app DESC, review_count DESC"))
def gallery_recommended(v):
    return _shown(v)


@query(_gallery_sql("average_rating DESC, evidence_tier_for_app DESC, review_count DESC", "evidence_strength IN ('Medium', 'High')"))
def gallery_highest_rating(v):
    return _shown(v, sort="highest_rating", evidence="medium")


@query(_gallery_sql("review_count DESC, evidence_tier_for_app DESC, trust_score_for_app DESC", "true", "QUALIFY place <= 25"))
def gallery_most_reviews(v):
    return _shown(v, sort="most_reviews", top_n=25)


@query(_gallery_sql("negative_share ASC, evidence_tier_for_app DESC, trust_score_for_app DESC", "category = 'Electronic Accessories'"))
def gallery_low_risk(v):
    return _shown(v, sort="lowest_risk", category="Electronic Accessories")


@query("""SELECT rank, category, name, display_name AS clean_product_name, trust_score_for_app AS product_score, evidence_strength,
 average_rating, review_count, positive_share AS text_positive_rate, negative_share AS text_negative_rate, cluster_id, product_family
 FROM {gallery}""")
def ranking_table(v):
    return gallery.ranking_table(gallery_of(v))


@query(f"""SELECT raw_product_name, {o.fixed_digits(
    "(40 * least(average_rating / 5, 1) + 30 * 0.5::DOUBLE + 20 * (positive_share / 100) + 10 * (1 - negative_share / 100))", 1)}::DOUBLE
 AS score FROM {{cards}}""")
def score_fallback(v):
    old = template_cards_of(v).drop("trust_score", "review_volume_score")
    return old.select("raw_product_name", gallery.shown_score(old).alias("score"))


# --- reports --------------------------------------------------------------------------------------

@query("""SELECT 0 AS section, '-inf'::DOUBLE AS place, '' AS name, 0 AS part, '# Ratings that contradict their texts' AS line UNION ALL
 SELECT 0, '-inf'::DOUBLE, '', 1, '' UNION ALL
 SELECT DISTINCT 1, 0.0::DOUBLE, contradiction_type, 0, '## ' || contradiction_type FROM {contradicted} WHERE contradiction_type IS NOT NULL UNION ALL
 SELECT 1, 0.0::DOUBLE, contradiction_type, CAST(n AS INT), '- Rating ' || rating || ', predicted ' || prediction || ': ' || review_title FROM
 (SELECT *, row_number() OVER (PARTITION BY contradiction_type ORDER BY doc_id) AS n FROM {contradicted} WHERE contradiction_type IS NOT NULL) WHERE n <= 3""")
def contradiction_report(v):
    return reports.contradiction_report(reviews.contradiction_examples(predictions(v), [F.col("doc_id")]))


@query("""SELECT 0 AS section, '-inf'::DOUBLE AS place, '' AS name, 0 AS part, '# Setups' AS line UNION ALL
 SELECT 1, -cv, preprocessing, unnest([0, 1, 2]), unnest(['## ' || preprocessing || ' + ' || model, '', '- Cross-validated macro-F1: ' || printf('%.3f', cv)])
 FROM (SELECT preprocessing, model, round(avg(macro_f1), 6) AS cv FROM {setup_scores} GROUP BY 1, 2)""")
def setup_report(v):
    scores = fold_means(v)
    title = F.concat(F.lit("## "), F.col("preprocessing"), F.lit(" + "), F.col("model"))
    line = F.concat(F.lit("- Cross-validated macro-F1: "), numbers.fixed(F.col("cv_macro_f1"), 3))
    return reports.document(reports.heading(scores, 0, "# Setups"),
                            reports.section(scores, 1, [title, "", line], -F.col("cv_macro_f1"), F.col("preprocessing")))


@query("""SELECT "group", 1::INT AS part, product_name, '- ' || product_name || ' (' || review_rows || ' review rows | family: ' || product_family || ')'
 AS line FROM (SELECT *, corrected_category AS "group" FROM {corrected}) UNION ALL
 SELECT corrected_category, 0, '', '### corrected_category: ' || corrected_category || ' (' || count(*) || ' products)' FROM {corrected} GROUP BY 1""")
def report_lines(v):
    return reports.product_group_lines(corrected_products(v), "corrected_category").select("group", "part", "product_name", "line")


@query("""SELECT category, rank, name, '## ' || category || ' | #' || rank || ' | ' || name || chr(10) || chr(10) || '**' || headline || '**'
 || chr(10) || chr(10) || summary || chr(10) || chr(10) || '**Best for:** ' || best_for || chr(10) || chr(10) || '**Pros:**' || chr(10) || '- '
 || array_to_string(pros, chr(10) || '- ') || chr(10) || chr(10) || '**Cons:**' || chr(10) || '- ' || array_to_string(cons, chr(10) || '- ')
 || chr(10) || chr(10) || '---' || chr(10) AS line FROM {cards}""")
def card_report(v):
    return reports.card_lines(template_cards_of(v))


@query("""SELECT contradiction_type, CAST(row_number() OVER (PARTITION BY contradiction_type ORDER BY doc_id) AS INT) AS example,
 '- Rating ' || rating || ', predicted ' || prediction || ': ' || review_title AS line FROM {contradicted}
 WHERE contradiction_type IS NOT NULL QUALIFY example <= 3""")
def contradiction_report(v):
    return reports.contradiction_lines(reviews.contradiction_examples(predictions(v), [F.col("doc_id")]))


@query(f"""SELECT class, '| ' || class || ' | ' || {o.fixed_digits('precision', 3)} || ' | ' || {o.fixed_digits('recall', 3)} || ' | '
 || {o.fixed_digits('f1', 3)} || ' |' AS line FROM {{report}}""")
def class_report_lines(v):
    return reports.class_report_lines(metrics.class_report(predictions(v)))
