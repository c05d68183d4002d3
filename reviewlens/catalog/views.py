"""Review-shaped views over the given tables.

Each view is plain SQL that reads the same on Spark and on the checking engine;
``{name}`` stands for a given table or another view.  Rows are derived from the
given tables one to one, so every query over them grows with the tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

PHRASES = [
    "Easy to set up and works well",
    "Battery drains fast, charging is slow",
    "The screen is clear and the picture is great",
    "My kids love it",
    "Stopped working after a week, dead on arrival",
    "Handy, lightweight and portable",
    "App content and ads are annoying",
    "Wifi connection trouble, pairing fails",
    "Solid build quality",
    "Education for happy people",
    "Display crack and frozen screen",
    "Fine.",
    "",
]


def phrase(number: str) -> str:
    cases = " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PHRASES))
    return f"CASE ({number}) % {len(PHRASES)} {cases} END"


_PN = "p_name || ' ' || replace(p_brand, '#', ' ')"

SQL = {
    # Product names that hit every clean-up step and rule, in all brands and kinds.
    "v_products": f"""
SELECT p_partkey,
  CASE p_partkey % 16
    WHEN 0 THEN 'Fire HD 8 Tablet, 16 GB - Black ' || {_PN} || ',,,Fire HD 8 Tablet, 16 GB - Black'
    WHEN 1 THEN 'Amazon - Amazon Tap Portable Speaker - ' || {_PN}
    WHEN 2 THEN 'Kindle Paperwhite E-reader - White ' || {_PN}
    WHEN 3 THEN 'AA Alkaline Batteries (48 Count) ' || p_name
    WHEN 4 THEN 'Echo Dot (Previous generation) ' || {_PN}
    WHEN 5 THEN 'USB Charger and Power  Adapter ' || p_name || ' '
    WHEN 6 THEN 'Amazon - Fire TV Stick Streaming Media Player ' || {_PN}
    WHEN 7 THEN 'Kids Edition Tablet with Kid-Proof Case ' || {_PN}
    WHEN 8 THEN 'Keyboard Sleeve Cover for 10 Inch Devices ' || p_brand
    WHEN 9 THEN 'Expanding File Folder, 12 Pocket | ' || {_PN}
    WHEN 10 THEN 'Hard-Sided Pet Kennel ' || {_PN}
    WHEN 11 THEN 'Kindle Voyage | 6" Display, 300 ppi ' || {_PN}
    WHEN 12 THEN 'AmazonBasics Nylon Tool Set Hd ' || {_PN}
    WHEN 13 THEN 'Notebook Paper, 3 Pack ' || p_name || chr(92) || 'n' || {_PN}
    WHEN 14 THEN ''
  END AS name,
  CASE p_partkey % 7
    WHEN 0 THEN 'Electronics,' || p_type
    WHEN 1 THEN 'Office Products,' || p_type
    WHEN 2 THEN 'Kindle Store'
    WHEN 3 THEN 'Non-Consumer,' || p_type
    WHEN 4 THEN CAST(NULL AS VARCHAR(20))
    ELSE p_type
  END AS categories
FROM {{part}}""",
    # Many short reviews, one per line item, with a sentiment prediction.
    "v_scored_raw": f"""
SELECT p.name AS product_name, coalesce(p.categories, '') AS category_text,
  {phrase('l.l_orderkey')} AS text,
  CAST(CASE CAST(round(l.l_tax * 100) AS INT)
    WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN 4 ELSE 5 END AS DOUBLE) AS rating,
  CASE WHEN round(l.l_discount * 100) <= 1 THEN 'negative' WHEN round(l.l_discount * 100) = 2 THEN 'neutral'
    ELSE 'positive' END AS predicted_sentiment
FROM {{lineitem}} l JOIN {{v_products}} p ON l.l_partkey = p.p_partkey""",
    # Long reviews in several languages, one per document, as they come from a file.
    "v_raw_text": f"""
SELECT d.doc_id, d.source AS source_file, p.name AS name, p.categories AS categories,
  CASE WHEN d.doc_id % 97 = 0 THEN CAST(NULL AS VARCHAR(10)) WHEN d.doc_id % 89 = 0 THEN 'bad'
    WHEN l.toxic = 1 THEN '1'
    WHEN l.quality = 0 THEN CASE d.doc_id % 3 WHEN 0 THEN '2' WHEN 1 THEN '3' ELSE ' 2.5' END
    WHEN l.quality = 1 THEN '5' ELSE '4' END AS rating,
  CASE WHEN d.n_chars % 5 = 4 THEN CAST(NULL AS VARCHAR(10)) ELSE {phrase('d.n_chars')} END AS title,
  CASE WHEN d.doc_id % 101 = 0 THEN '' ELSE d.text END AS text
FROM {{documents}} d LEFT JOIN {{labels}} l ON d.doc_id = l.doc_id
LEFT JOIN {{v_products}} p ON p.p_partkey = (d.n_chars * 13) % (SELECT max(p_partkey) + 1 FROM {{part}})""",
    # Image lists of products, as found in three files.
    "v_images": """
SELECT CAST(page_id % 3 AS INT) AS source_rank, page_id AS row_ord, p.name AS name,
  CASE WHEN page_id % 11 = 9 THEN CAST(NULL AS VARCHAR(10))
    WHEN page_id % 10 = 9 THEN 'http://x.example/barcode.png'
    WHEN page_id % 5 = 1 THEN 'https://m.media-amazon.com/i._SL' || CAST(page_id * 10 AS VARCHAR(20)) || '_.jpg,'
      || url || ',http://x.example/upccode.png'
    ELSE url || ', https://images.example/a_sx' || CAST(page_id AS VARCHAR(20)) || '.png ,ftp://b' END AS imageURLs
FROM {pages} LEFT JOIN {v_products} p ON p.p_partkey = page_id""",
    # Labelled completions with missing parts, stray lines and failures.
    "v_completions": f"""
SELECT doc_id,
  CASE WHEN doc_id % 17 = 0 THEN 'generation failed: timeout'
  ELSE 'Sure, here it is.' || chr(10) || 'HEADLINE: Pick ' || CAST(doc_id AS VARCHAR(20)) || chr(13) || chr(10)
    || CASE WHEN doc_id % 13 = 0 THEN '' ELSE 'SUMMARY: ignored' || chr(10) || text || chr(10) || chr(10)
      || '  - Second paragraph.' || chr(10) END
    || ' BEST_FOR: people in ' || lang || chr(10) || 'PROS:' || chr(10) || '- {PHRASES[0]}' || chr(10)
    || 'not a bullet' || chr(10) || '-' || source || chr(10)
    || CASE WHEN doc_id % 3 > 0 THEN '- third' || chr(10) ELSE '' END
    || CASE WHEN doc_id % 3 > 1 THEN '- fourth' || chr(10) ELSE '' END
    || 'CONS:' || chr(10) || CASE WHEN doc_id % 5 = 0 THEN '' ELSE '- {PHRASES[1]}' END END AS completion
FROM {{documents}}""",
}

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def inputs_of(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{([a-z][a-z_]+)\}", sql)))


class Views:
    """Given tables and views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getitem__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        sql = SQL[name]
        return self.spark.sql(sql, **{n: self[n] for n in inputs_of(sql)})
