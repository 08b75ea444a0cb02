"""Line dedup (1): boilerplate by distinct-site spread, in DataFrame operations.

A line (spaces trimmed, empty ones aside) that occurs on at least `min_sites`
different sites is boilerplate and goes from every document.

Each line's hash has a HyperLogLog sketch of its sites; sketches are merged by
aggregation, in the tasks first, so a line or a site with a third of all rows
sends one sketch for each task.  Estimates clear of the threshold decide; lines
within the sketch's error of it (NEAR standard errors, 2 sites at least) get an
exact distinct count.

Texts are split once, into a materialised table of line hashes.  It meets the
boilerplate lines by broadcast where these are few, and otherwise with the most
frequent ones broadcast (`lookup`), so a line of every page stays where it is.
Texts move once, to meet the positions of their removed lines.  Lines are keyed
by 128 bits of hash.

Defined cases: a null text has no line and stays null; a null site counts for
nothing; the lines kept are joined as they were; rows stay, with any id: rows
are told apart by id and text, and equal rows are treated alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelfactor.llm._spark import cut, documents, lookup, masked

MIN_SITES = 10
#: log2 of a sketch's buckets; its relative standard error is 1.04 / sqrt(2 ** LG_K)
LG_K, NEAR = 11, 4


def _lines(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    """Rows (id, row, ..., pos, k1, k2) for each line that is not empty."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("row"), *more, F.posexplode(F.split(text_col, "\n", -1)).alias("pos", "line"))
    rows = rows.withColumn("line", F.trim("line")).where("line <> ''")
    return rows.withColumns({"k1": F.xxhash64("line"), "k2": F.xxhash64(F.lit(1), "line")}).drop("line")


def _boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """Rows (k1, k2, n) of the lines (k1, k2, site) that at least min_sites sites have; n is how often they occur."""
    sketches = lines.groupBy("k1", "k2").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.count("*").alias("n"))
    spread = sketches.select("k1", "k2", F.hll_sketch_estimate("sketch").alias("sites"), "n")
    band = max(2, round(NEAR * 1.04 / 2 ** (LG_K / 2) * min_sites))
    spread = cut(spread.where(F.col("sites") >= min_sites - band))
    sure = spread.where(F.col("sites") > min_sites + band).select("k1", "k2", "n")
    near = spread.where(F.col("sites") <= min_sites + band).select("k1", "k2", "n")
    if near.isEmpty():
        return sure
    places = lookup(lines.where("site is not null").select("k1", "k2", "site"), near, ["k1", "k2"], "n", "inner").distinct()
    exact = places.groupBy("k1", "k2").agg(F.count("*").alias("sites")).where(F.col("sites") >= min_sites)
    return sure.union(near.join(exact, ["k1", "k2"]).select("k1", "k2", "n"))


def boilerplate(docs: DataFrame, site_col: str = "source", text_col: str = "text", min_sites: int = MIN_SITES) -> DataFrame:
    """Rows (k1, k2): the lines that at least min_sites sites have."""
    plain, (site, text) = masked(docs, site_col, text_col)
    lines = cut(_lines(plain.withColumn("none", F.lit(0)), "none", text, F.col(site).cast("string").alias("site")))
    return _boilerplate(lines, min_sites).select("k1", "k2")


def remove(docs: DataFrame, id_col: str = "doc_id", site_col: str = "source", text_col: str = "text", min_sites: int = MIN_SITES) -> DataFrame:
    """docs without boilerplate lines in their text, and with columns n_lines and n_removed (long)."""
    plain, (own_id, site, own_text) = masked(docs, id_col, site_col, text_col)
    lines = cut(_lines(plain, own_id, own_text, F.col(site).cast("string").alias("site")))
    found = cut(_boilerplate(lines, min_sites))
    gone = lookup(lines.select("id", "row", "pos", "k1", "k2"), found, ["k1", "k2"], "n", "inner").groupBy("id", "row").agg(F.collect_set("pos").alias("gone"))
    joined = plain.withColumn("key", F.xxhash64(own_text)).join(gone, (F.col("key") == F.col("row")) & F.col(own_id).eqNullSafe(F.col("id")), "left")
    kept = F.array_join(F.filter(F.split(own_text, "\n", -1), lambda line, pos: ~F.array_contains("gone", pos)), "\n")
    n_lines = F.when(F.col(own_text).isNull(), 0).otherwise(F.length(own_text) - F.length(F.translate(own_text, "\n", "")) + 1)
    text = F.when(F.col("gone").isNull(), F.col(own_text)).otherwise(kept)
    out = joined.select(*(text.alias(c) if c == own_text else F.col(c) for c in plain.columns), n_lines.cast("long"), F.coalesce(F.size("gone"), F.lit(0)).cast("long"))
    return out.toDF(*docs.columns, "n_lines", "n_removed")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return remove(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


SQL = f"""
WITH lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL
),
boiler AS (
  SELECT trim(line, ' ') AS line FROM lines WHERE trim(line, ' ') <> ''
  GROUP BY 1 HAVING count(DISTINCT source) >= {MIN_SITES}
),
marked AS (
  SELECT l.doc_id, l.pos, l.line, b.line IS NOT NULL AS gone
  FROM lines l LEFT JOIN boiler b ON trim(l.line, ' ') = b.line
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
UNION ALL
SELECT doc_id, 0, 0, sha256('') FROM documents WHERE text IS NULL
"""
