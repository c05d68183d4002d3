"""The same results in SQL, written for a second engine."""

from __future__ import annotations

import re

from reviewlens.catalog import views
from reviewlens.functions import fixed_values as fixed

SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BREAKS = r"[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rep(x: str, pattern: str, to: str = " ", flags: str = "g") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, '{flags}')"


def strip(x: str) -> str:
    return rep(x, f"^{SPACE}+|{SPACE}+$", "")


def squeeze(x: str) -> str:
    return f"trim({rep(x, SPACE + '+')})"


def clean(x: str, underscore: bool = False) -> str:
    return f"trim({rep(rep(f'lower({x})', '[^a-z0-9_\\s' + chr(39) + ']' if underscore else '[^a-z0-9\\s' + chr(39) + ']'), '\\s+')})"


def has(x: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(t)})" for t in terms) + ")"


def has_every(x: str, terms: list[str]) -> str:
    return "(" + " AND ".join(f"contains({x}, {q(t)})" for t in terms) + ")"


def first_part(split: str, trimmed: str) -> str:
    return (f"list_extract(list_filter(list_transform({split}, lambda p: {trimmed}), "
            f"lambda p: length(p) > 0), 1)")


def grouping_name(x: str) -> str:
    text = f"coalesce({x}, '')"
    lines = f"replace(replace({text}, chr(92) || 'r', chr(10)), chr(92) || 'n', chr(10))"
    split = f"regexp_split_to_array({lines}, {q(',,,|\\n|' + chr(34))})"
    first = first_part(split, "trim(p, ' ,')")
    amazon = rep(first, r"\bAmazon\s*-\s*Amazon\b", "Amazon", "gi")
    return f"coalesce(trim({squeeze(amazon)}, ' ,'), {strip(text)})"


def canonical_name(x: str) -> str:
    out = rep(clean(x, True), r"\bamazon\s+amazon\b", "amazon")
    for p in fixed.CANONICAL_PHRASES:
        out = f"replace({out}, {q(p)}, ' ')"
    for p in fixed.CANONICAL_PATTERNS:
        out = rep(out, p)
    return squeeze(out)


def display_name(x: str) -> str:
    text = f"coalesce({x}, '')"
    split = f"regexp_split_to_array(replace(replace({text}, ',,,', chr(10)), '|', chr(10)), {q(BREAKS)})"
    chars = q(' ,-"')
    out = f"coalesce({first_part(split, f'trim({squeeze('p')}, {chars})')}, {strip(text)})"
    out = rep(out, r"^amazon\s*-\s*amazon\s+", "Amazon ", "i")
    out = rep(out, r"^amazon\s+amazon\s+", "Amazon ", "i")
    out = rep(out, r"^amazon\s*-\s*(kindle|fire|echo)", r"Amazon \1", "i")
    out = f"trim({squeeze(out)}, {chars})"
    return f"replace(replace({out}, ' Fire Hd ', ' Fire HD '), ' Hd ', ' HD ')"


def slug(x: str) -> str:
    return f"coalesce(nullif(substring(trim({rep(f'lower({x})', '[^a-z0-9]+', '_')}, '_'), 1, 80), ''), 'product')"


def image_key(x: str) -> str:
    out = f"lower({display_name(x)})"
    for p in fixed.IMAGE_NOISE_PATTERNS:
        out = rep(out, p)
    return f"trim({rep(out, '[^a-z0-9]+')})"


def image_tokens(x: str) -> str:
    stops = ", ".join(q(t) for t in fixed.IMAGE_STOP_TOKENS)
    return (f"list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+'), "
            f"lambda t: length(t) > 2 AND t NOT IN ({stops}))))")


def case(rules: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in rules) + f" ELSE {default} END"


def family(x: str) -> str:
    low = f"lower(coalesce({x}, ''))"
    return case([(has(low, t) + (f" AND NOT {has(low, e)}" if e else ""), q(f)) for t, e, f in fixed.FAMILY_RULES],
                q(fixed.FAMILY_DEFAULT))


def tokens(x: str) -> str:
    """Helper tokens in rule order; a repeated token counts at its first word."""
    low, merged = f"lower(coalesce({x}, ''))", {}
    for word, token in fixed.WORD_TOKENS:
        merged.setdefault(token, []).append(word)
    parts = " || ".join(f"CASE WHEN {has(low, words)} THEN {q(' ' + token)} ELSE '' END"
                        for token, words in merged.items())
    return f"{family(x)} || {parts}"


def taxonomy(name: str, category: str, cluster: str, part: str) -> str:
    texts = {"name": f"lower(coalesce({name}, ''))"}
    texts["both"] = f"({texts['name']} || ' ' || lower(coalesce({category}, '')))"
    return case([(has(texts[w], t) + (f" AND NOT {has(texts[w], e)}" if e else ""),
                  q(label if part == "category" else reason)) for w, t, e, label, reason in fixed.TAXONOMY_RULES],
                f"'Cluster ' || {cluster}" if part == "category" else q(fixed.TAXONOMY_DEFAULT_REASON))


def product_type(category: str, name: str) -> str:
    texts = {"both": f"lower(coalesce({category}, '') || ' ' || coalesce({name}, ''))",
             "category": f"lower(coalesce({category}, ''))"}
    return case([(has(texts[w], t), q(k)) for w, t, k in fixed.PRODUCT_TYPE_RULES], q(fixed.PRODUCT_TYPE_DEFAULT))


def or_default(x: str, default: str) -> str:
    return f"CASE WHEN len({x}) > 0 THEN {x} ELSE [{q(default)}] END"


def strengths(name: str, kind: str, listed: str) -> str:
    low, base = f"lower({name})", or_default(listed, fixed.NO_STRENGTHS)
    allowed = ", ".join(q(s) for s in fixed.BATTERY_STRENGTHS)
    battery = f"list_filter({base}, lambda s: s IN ({allowed}))"
    accessory = f"list_filter({base}, lambda s: NOT {has('lower(s)', fixed.ACCESSORY_BLOCKED_STRENGTHS)})"
    quiet = f"({kind} = 'smart speaker product' AND NOT {has(low, fixed.SCREEN_NAME_WORDS)})"
    other = f"list_filter({base}, lambda s: NOT ({quiet} AND {has('lower(s)', fixed.SCREEN_THEME_WORDS)}))"
    return (f"list_slice(CASE WHEN {has(low, fixed.BATTERY_WORDS)} THEN {or_default(battery, fixed.NO_BATTERY_STRENGTHS)} "
            f"WHEN {kind} = 'electronic accessory' THEN {or_default(accessory, fixed.NO_ACCESSORY_STRENGTHS)} "
            f"ELSE {or_default(other, fixed.NO_STRENGTHS)} END, 1, 4)")


def concerns(name: str, kind: str, listed: str) -> str:
    low, base = f"lower({name})", or_default(listed, fixed.NO_CONCERNS)
    allowed = ", ".join(q(s) for s in fixed.BATTERY_CONCERNS)
    battery = f"list_filter({base}, lambda s: s IN ({allowed}))"
    accessory = f"list_filter({base}, lambda s: NOT {has('lower(s)', fixed.ACCESSORY_BLOCKED_CONCERNS)})"
    return (f"list_slice(CASE WHEN {has(low, fixed.BATTERY_WORDS)} THEN {or_default(battery, fixed.NO_BATTERY_CONCERNS)} "
            f"WHEN {kind} = 'electronic accessory' THEN {or_default(accessory, fixed.NO_ACCESSORY_CONCERNS)} "
            f"ELSE {base} END, 1, 4)")


def theme_list(flags: list[tuple[str, str]]) -> str:
    """The first four themes whose condition holds."""
    parts = ", ".join(f"CASE WHEN {c} THEN {q(t)} END" for t, c in flags)
    return f"list_slice(list_filter([{parts}], lambda t: t IS NOT NULL), 1, 4)"


def usable(u: str) -> str:
    return f"(starts_with(lower({u}), 'http') AND NOT {has(f'lower({u})', fixed.BLOCKED_URL_MARKS)})"


def url_score(u: str) -> str:
    low = f"lower({u})"
    points = " + ".join([f"CASE WHEN starts_with({low}, 'https://') THEN 5 ELSE 0 END"]
                        + [f"CASE WHEN {has(low, m)} THEN {p} ELSE 0 END" for m, p in fixed.URL_POINTS])
    found = " , ".join(f"regexp_extract_all({low}, {q(p)}, 1)" for p in fixed.URL_DIMENSION_PATTERNS)
    size = f"list_max(list_transform(list_concat({found}), lambda d: CAST(d AS HUGEINT)))"
    return f"({points} + coalesce(least({size}, 2000) // 10, 0))"


def best_url(x: str) -> str:
    items = f"list_filter(list_transform(string_split(coalesce({x}, ''), ','), lambda u: {strip('u')}), lambda u: {usable('u')})"
    best = f"list_max(list_transform({items}, lambda u: {{'s': CAST({url_score('u')} AS BIGINT), 'u': u}}))"
    return f"coalesce(({best}).u, '')"


def fixed_digits(x: str, digits: int) -> str:
    """Half-even on the exact binary value."""
    return f"printf('%.{digits}f', CAST({x} AS DOUBLE))"


def grouped(x: str) -> str:
    return f"format('{{:,}}', CAST({x} AS BIGINT))"


def number(x: str) -> str:
    t = f"trim({x})"
    return (f"CASE WHEN regexp_full_match({t}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') "
            f"THEN TRY_CAST({t} AS DOUBLE) END")


def words(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+'), lambda t: length(t) > 1)"


def bigrams(t: str) -> str:
    return (f"list_transform(range(1, greatest(len({t}), 1)), "
            f"lambda i: list_extract({t}, i) || ' ' || list_extract({t}, i + 1))")


def label(rating: str) -> str:
    return f"CASE WHEN {rating} <= 2 THEN 'negative' WHEN {rating} = 3 THEN 'neutral' ELSE 'positive' END"


def clip(x: str) -> str:
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, {x}))"


def fill(pattern: str, *parts: str) -> str:
    pieces = [p.replace("%%", "%") for p in pattern.split("%s")]
    out = [q(pieces[0])]
    for part, piece in zip(parts, pieces[1:], strict=True):
        out += [f"({part})", q(piece)]
    return " || ".join(out).replace("\n", "' || chr(10) || '")


def listed(x: str) -> str:
    return f"array_to_string(list_slice({x}, 1, 3), ', ')"


def _themes(sentiment: str, themes: dict[str, list[str]], prefix: str) -> tuple[str, str]:
    flags = ", ".join(f"bool_or(predicted_sentiment = '{sentiment}' AND {has('lower(text)', ws)}) AS {prefix}{i}"
                      for i, ws in enumerate(themes.values()))
    return flags, theme_list([(t, f"{prefix}{i}") for i, t in enumerate(themes)])


_POS, _STRENGTHS = _themes("positive", fixed.STRENGTH_THEMES, "s")
_NEG, _CONCERNS = _themes("negative", fixed.CONCERN_THEMES, "c")
_NOTES = fixed.COMPARISON_NOTES

# Building blocks; {name} refers to a given table, a view or another block.
BLOCKS = {
    "scored": f"""SELECT *, {label('rating')} AS label FROM {{v_scored_raw}}
WHERE rating IS NOT NULL AND length(text) > 0 AND length(product_name) > 0""",
    "measured": f"""SELECT product_name, count(*) AS review_count, avg(rating) AS average_rating,
 100.0::DOUBLE * count(*) FILTER (predicted_sentiment = 'positive') / count(*) AS positive_share,
 100.0::DOUBLE * count(*) FILTER (predicted_sentiment = 'neutral') / count(*) AS neutral_share,
 100.0::DOUBLE * count(*) FILTER (predicted_sentiment = 'negative') / count(*) AS negative_share,
 100.0::DOUBLE * count(*) FILTER (label = 'positive') / count(*) AS rating_positive_share,
 {_POS}, {_NEG} FROM {{scored}} GROUP BY product_name""",
    "evidence_base": f"""SELECT product_name, review_count, average_rating, positive_share, neutral_share, negative_share,
 rating_positive_share, {_STRENGTHS} AS strengths, {_CONCERNS} AS concerns FROM {{measured}}""",
    "clustered": """SELECT name AS product_name, min(categories) AS category, count(*) AS review_rows,
 CAST(length(name) % 8 AS INT) AS cluster_id FROM {v_products} WHERE length(name) > 0 GROUP BY name""",
    "corrected": f"""SELECT *, cluster_id AS original_cluster_id,
 {taxonomy('product_name', 'category', 'cluster_id', 'category')} AS corrected_category,
 {taxonomy('product_name', 'category', 'cluster_id', 'reason')} AS correction_reason,
 {family('product_name')} AS product_family FROM {{clustered}}""",
    "joined": """SELECT e.*, t.cluster_id, t.corrected_category, t.product_family, t.correction_reason,
 ln(review_count + 1.0::DOUBLE) AS v FROM {evidence_base} e JOIN {corrected} t USING (product_name)""",
    "parts": f"""SELECT *, CASE WHEN review_count >= 100 THEN 'High' WHEN review_count >= 30 THEN 'Medium' ELSE 'Low' END AS evidence_strength,
 (v - (SELECT min(v) FROM {{joined}})) / ((SELECT max(v) FROM {{joined}}) - (SELECT min(v) FROM {{joined}})) AS review_volume_score,
 {clip('average_rating / 5')} AS rating_score, {clip('positive_share / 100')} AS positive_sentiment_score,
 {clip('1 - negative_share / 100')} AS risk_control_score FROM {{joined}}""",
    "trusted": """SELECT *, round_even((40 * rating_score + 30 * review_volume_score + 20 * positive_sentiment_score
 + 10 * risk_control_score) * 10, 0) / 10 AS trust_score FROM {parts}""",
    "evidence": """SELECT *, trust_score AS rank_score, CAST(row_number() OVER (PARTITION BY corrected_category
 ORDER BY trust_score DESC, product_name) AS INT) AS rank FROM {trusted}""",
    "medians": """SELECT corrected_category, median(review_count::DOUBLE) AS review_count_median,
 median(average_rating) AS average_rating_median, median(negative_share) AS negative_share_median
 FROM {evidence} GROUP BY corrected_category""",
    "noted": f"""SELECT e.*,
 [CASE WHEN review_count >= review_count_median THEN {q(_NOTES['volume'][0])} ELSE {q(_NOTES['volume'][1])} END,
  CASE WHEN average_rating >= average_rating_median THEN {q(_NOTES['rating'][0])} ELSE {q(_NOTES['rating'][1])} END,
  CASE WHEN negative_share >= negative_share_median THEN {q(_NOTES['risk'][0])} ELSE {q(_NOTES['risk'][1])} END]
 AS comparison_notes FROM {{chosen}} e JOIN {{medians}} USING (corrected_category)""",
    "named": f"SELECT *, {display_name('product_name')} AS display_name FROM {{evidence}}",
    "chosen": """SELECT * REPLACE (CAST(row_number() OVER (PARTITION BY corrected_category
 ORDER BY rank_score DESC, display_name) AS INT) AS rank) FROM (SELECT * FROM {named}
 QUALIFY row_number() OVER (PARTITION BY corrected_category, display_name
 ORDER BY rank_score DESC, review_count DESC, product_name) = 1)""",
    "typed": f"SELECT *, {product_type('corrected_category', 'display_name')} AS product_type FROM {{noted}}",
    "facts": f"""SELECT *, {strengths('display_name', 'product_type', 'strengths')} AS main_strengths,
 {concerns('display_name', 'product_type', 'concerns')} AS main_concerns FROM {{typed}}""",
    "cards": f"""SELECT {q(fixed.TEMPLATE_CARD['headline'])} AS headline,
 {fill(fixed.TEMPLATE_CARD['summary'], 'display_name', 'product_type', 'corrected_category', grouped('review_count'),
       fixed_digits('average_rating', 2), fixed_digits('positive_share', 1), listed('main_strengths'),
       listed('main_concerns'), "array_to_string(comparison_notes, '; ')")} AS summary,
 {q(fixed.TEMPLATE_CARD['best_for'])} AS best_for, list_slice(main_strengths, 1, 3) AS pros,
 list_slice(main_concerns, 1, 3) AS cons, {q(fixed.TEMPLATE_CARD['source'])} AS source,
 corrected_category AS category, rank, display_name AS name, product_name AS raw_product_name, review_count,
 {fixed_digits('average_rating', 3)}::DOUBLE AS average_rating, {fixed_digits('positive_share', 1)}::DOUBLE AS positive_share,
 {fixed_digits('negative_share', 1)}::DOUBLE AS negative_share, {fixed_digits('trust_score', 1)}::DOUBLE AS trust_score,
 {fixed_digits('rating_score', 3)}::DOUBLE AS rating_score, {fixed_digits('review_volume_score', 3)}::DOUBLE AS review_volume_score,
 {fixed_digits('positive_sentiment_score', 3)}::DOUBLE AS positive_sentiment_score,
 {fixed_digits('risk_control_score', 3)}::DOUBLE AS risk_control_score, evidence_strength, cluster_id,
 coalesce(product_family, '') AS product_family,
 {slug('corrected_category')} || '_' || {slug('display_name')} || '_prompt.txt' AS prompt_file FROM {{facts}}""",
    "gallery": f"""SELECT *, {display_name('name')} AS display_name, trust_score AS trust_score_for_app,
 CASE evidence_strength WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 1 ELSE 0 END AS evidence_tier_for_app
 FROM {{cards}} QUALIFY row_number() OVER (PARTITION BY category, {display_name('name')}
 ORDER BY trust_score DESC, review_count DESC, raw_product_name) = 1""",
    "review_cells": f"""SELECT doc_id, source_file, coalesce(name, '') AS product_name, coalesce(categories, '') AS category_text,
 coalesce(title, '') AS review_title, coalesce(text, '') AS review_text, {number('rating')} AS rating,
 {strip("coalesce(title, '') || ' ' || coalesce(text, '')")} AS text FROM {{v_raw_text}}""",
    "valid": "SELECT * FROM {review_cells} WHERE rating IS NOT NULL AND length(text) > 0",
    "reviews": f"""SELECT *, {label('rating')} AS label FROM {{valid}} WHERE length(product_name) > 0
 QUALIFY row_number() OVER (PARTITION BY product_name, review_title, review_text, rating ORDER BY doc_id) = 1""",
    "predicted": """SELECT *, CASE WHEN doc_id % 7 = 0 THEN 'neutral' WHEN doc_id % 11 = 0 THEN 'positive'
 WHEN doc_id % 17 = 0 THEN 'negative' ELSE label END AS prediction FROM {reviews}""",
    "cells": """SELECT a.c AS label, p.c AS prediction, (SELECT count(*) FROM {predicted} x
 WHERE x.label = a.c AND x.prediction = p.c) AS n
 FROM (SELECT unnest(['negative', 'neutral', 'positive']) AS c) a, (SELECT unnest(['negative', 'neutral', 'positive']) AS c) p""",
    "report": """SELECT c AS class, coalesce(hits / nullif(pred, 0)::DOUBLE, 0) AS precision,
 coalesce(hits / nullif(support, 0)::DOUBLE, 0) AS recall, coalesce(2.0::DOUBLE * hits / nullif(pred + support, 0), 0) AS f1,
 CAST(support AS BIGINT) AS support FROM (SELECT c,
  (SELECT sum(n) FROM {cells} WHERE label = c AND prediction = c) AS hits,
  (SELECT sum(n) FROM {cells} WHERE label = c) AS support,
  (SELECT sum(n) FROM {cells} WHERE prediction = c) AS pred
  FROM (SELECT unnest(['negative', 'neutral', 'positive']) AS c))""",
    "contradicted": """SELECT *, CASE WHEN rating <= 2 AND prediction = 'positive' THEN 'low_rating_positive_text'
 WHEN rating >= 4 AND prediction = 'negative' THEN 'high_rating_negative_text'
 WHEN rating = 3 AND prediction = 'positive' THEN 'neutral_rating_positive_text'
 WHEN rating = 3 AND prediction = 'negative' THEN 'neutral_rating_negative_text' END AS contradiction_type FROM {predicted}""",
    "setup_scores": """SELECT source_file AS preprocessing, 'rule' AS model, doc_id % 3 AS fold,
 avg(CASE WHEN label = prediction THEN 1.0::DOUBLE ELSE 0 END) AS macro_f1 FROM {predicted} GROUP BY ALL""",
    "term_rows": f"""SELECT doc_id, unnest(list_concat(t, {bigrams('t')})) AS term
 FROM (SELECT doc_id, {words('text')} AS t FROM {{reviews}})""",
    "tf": "SELECT doc_id, term, count(*) AS tf FROM {term_rows} GROUP BY ALL",
    "vocab": """SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS total,
 ln(((SELECT count(*) FROM {reviews}) + 1.0::DOUBLE) / (count(*) + 1)) + 1 AS idf FROM {tf} GROUP BY term
 HAVING count(*) >= 2 AND count(*) <= 0.9::DOUBLE * (SELECT count(*) FROM {reviews}) ORDER BY total DESC, term LIMIT 15000""",
    "tfidf": """SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight
 FROM (SELECT doc_id, term, (ln(tf::DOUBLE) + 1) * idf AS w FROM {tf} JOIN {vocab} USING (term))""",
    "doc_clusters": "SELECT doc_id, CAST(length(source_file) * 10 + length(label) AS INT) AS cluster_id, product_name FROM {reviews}",
    "cluster_terms": """SELECT cluster_id, term, sum(weight) / any_value(size) AS mean_weight
 FROM {tfidf} JOIN {doc_clusters} USING (doc_id)
 JOIN (SELECT cluster_id, count(*) AS size FROM {doc_clusters} GROUP BY 1) USING (cluster_id) GROUP BY 1, 2""",
    "lookup_rows": f"""SELECT *, {best_url('imageURLs')} AS best FROM (SELECT * FROM {{v_images}}
 WHERE name IS NOT NULL AND imageURLs IS NOT NULL
 QUALIFY row_number() OVER (PARTITION BY source_rank, name ORDER BY row_ord) = 1)""",
    "lookup_keys": f"""SELECT source_rank, row_ord, best AS url, unnest([0, 1]) AS form,
 unnest([lower({display_name('name')}), {image_key(display_name('name'))}]) AS key FROM {{lookup_rows}} WHERE length(best) > 0""",
    "lookup": """SELECT key, url, source_rank, row_ord, form FROM {lookup_keys}
 QUALIFY row_number() OVER (PARTITION BY key ORDER BY source_rank, row_ord, form) = 1""",
    "exact_keys": f"""SELECT raw_product_name, unnest(range(8)) AS pos, unnest([
 {', '.join(x for c in ['display_name', display_name('name'), 'raw_product_name', 'product_family']
            for x in (f'lower({strip(c)})', image_key(c)))}]) AS key FROM {{gallery}}""",
    "exact": """SELECT raw_product_name, min_by(url, pos) AS image_url FROM {exact_keys} JOIN {lookup} USING (key)
 WHERE length(key) > 0 GROUP BY raw_product_name""",
    "token_sets": f"""SELECT raw_product_name, {image_tokens('name')} AS pt, lower(name || ' ' || category) AS pt_text FROM {{gallery}}""",
    "lookup_sets": f"SELECT key, url, source_rank, row_ord, form, {image_tokens('key')} AS it FROM {{lookup}}",
    "loose_best": """SELECT raw_product_name, pt, pt_text, it, url, len(list_intersect(pt, it)) AS shared
 FROM {token_sets}, {lookup_sets} WHERE len(pt) >= 2 AND len(it) > 0
 QUALIFY row_number() OVER (PARTITION BY raw_product_name
 ORDER BY shared DESC, source_rank, row_ord, form) = 1""",
}
_families = case([(has_every("pt_text", ws), "(" + " AND ".join(f"list_contains(it, {q(w)})" for w in ws) + ")")
                  for ws in fixed.IMAGE_FAMILY_WORDS], "shared / len(pt)::DOUBLE >= 0.65")
BLOCKS["loose"] = (f"SELECT raw_product_name, url AS image_url FROM {{loose_best}} WHERE shared >= 3 "
                   f"AND shared / len(pt)::DOUBLE >= 0.45 AND {_families}")


def build(sql: str) -> str:
    """Resolve the ``{name}`` references of a statement into one WITH chain."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in views.inputs_of(text):
            if name in views.TABLES or name in order:
                continue
            visit(BLOCKS.get(name) or views.SQL[name])
            order.append(name)

    visit(sql)
    plain = lambda text: re.sub(r"\{([a-z][a-z_]+)\}", r"\1", text)
    blocks = [f"{n} AS MATERIALIZED ({plain(BLOCKS.get(n) or views.SQL[n])})" for n in order]
    return ("WITH " + ",\n".join(blocks) + "\n" if blocks else "") + plain(sql)
