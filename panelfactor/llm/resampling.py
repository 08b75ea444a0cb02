"""Importance resampling (13): documents drawn towards a target text distribution.

Features are runs of one to three words, hashed to BUCKETS buckets by CRC-32.
The counts of all documents are a sparse matrix, document by bucket, that is
written once as blocks of compressed sparse rows (CSR): for each block the ids
and sizes of its documents, and for all their entries together the bucket and
the count.  A document has BUCKETS entries at most, whatever its length.  All
that follows reads these blocks and no text:

* column sums: each task adds its blocks to one vector of BUCKETS counts, and
  the vectors are summed, which gives the distribution of all documents;
* gains: log ratios of the target's and that distribution with one added to
  each bucket, BUCKETS whole numbers that fit a broadcast;
* weights: the product of the matrix with the gains, block by block;
* scores: weight plus Gumbel noise from a hash of the seed and the id, so the
  highest scores are a sample without replacement in proportion to exp(weight);
* ranks: a quantile bounds the scores that can be drawn; those alone are sorted
  over ranges of (score, id), and a row's rank is its place in its range after
  the sizes of the ranges before it.

A null text has no words; without words n_features and weight are 0.  A null id
stands as nothing in the noise's key and sorts after all others.  Repeated rows
are scored each by itself.  Documents with fewer than `least` words are scored
but not drawn.  Empty documents or an empty target give defined gains by the
added one.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelfactor.llm import _crc
from panelfactor.llm import _spark
from panelfactor.llm import _words as W

BUCKETS, RUN, SEED = 10_000, 3, 42
#: documents and entries in one CSR block at most (a single document may have BUCKETS entries), and bytes of text read together
BLOCK_ROWS, BLOCK_ENTRIES, SLICE = 4096, 1 << 16, 1 << 20
#: a reader unpacks 4,096 rows of a row group at once, and a writer looks at its size after 100 rows or more: with blocks of
#: half a MB as rows both would hold all blocks of a task, which are four times as large as its texts
ROW_GROUPS = {"parquet.block.size": 4 << 20, "parquet.page.size": 1 << 20, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 8}

BLOCK_SCHEMA = "ids array<bigint>, n_words array<bigint>, n_features array<bigint>, row_end binary, bucket binary, count binary"


def feature_buckets(words: W.Words, run: int = RUN, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Document and bucket of every run of 1 to `run` words that lies inside one document."""
    doc = np.repeat(np.arange(len(words.first) - 1), words.counts())
    size = words.end - words.start
    one = _crc.registers(words.data, words.start, words.end)
    spaced = _crc.joined(_crc.registers(np.array([32], np.uint8), np.array([0]), np.array([1])), one, size)  # a space and the word
    docs, found, last, total = [], [], one, size
    for k in range(run):
        if k:
            n = len(one) - k
            if n <= 0:
                break
            more = size[k:] + 1
            last, total = _crc.joined(last[:n], spaced[k:], more), total[:n] + more
            inside = doc[:n] == doc[k:]
        else:
            inside = np.ones(len(one), bool)
        docs.append(doc[: len(inside)][inside])
        found.append(_crc.checksum(last, total)[inside] % np.uint32(buckets))
    return (np.concatenate(docs), np.concatenate(found).astype(np.int64)) if docs else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _matrix(run: int, buckets: int, block_rows: int):
    def block(rows: list) -> pa.RecordBatch:
        """One CSR block from (id, words, features, bucket array, count array) of each document."""
        ends = np.cumsum([len(r[3]) for r in rows], dtype="<i8")
        narrow = np.concatenate([r[3] for r in rows]), np.concatenate([r[4] for r in rows])
        kinds = [pa.list_(pa.int64())] * 3 + [pa.binary()] * 3
        cells = [[r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], ends.tobytes(), narrow[0].astype("<u4").tobytes(), narrow[1].astype("<u4").tobytes()]
        return pa.record_batch([pa.array([c], kind) for c, kind in zip(cells, kinds, strict=True)], names=["ids", "n_words", "n_features", "row_end", "bucket", "count"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, entries = [], 0
        for batch in batches:
            for part in W.slices(batch, "text", SLICE):
                words = W.words(part.column("text"), keep=W.ALNUM, lower=True)
                doc, bucket = feature_buckets(words, run, buckets)
                key, count = np.unique(doc * buckets + bucket, return_counts=True)
                cut = np.searchsorted(key, np.arange(part.num_rows + 1) * buckets)
                own = key % buckets
                features = np.bincount(doc, minlength=part.num_rows)
                for i, (name, n) in enumerate(zip(part.column("id").to_pylist(), words.counts().tolist(), strict=True)):
                    a, b = cut[i], cut[i + 1]
                    if rows and (len(rows) >= block_rows or entries + b - a > BLOCK_ENTRIES):
                        yield block(rows)
                        rows, entries = [], 0
                    rows.append((name, n, int(features[i]), own[a:b], count[a:b]))
                    entries += b - a
        if rows:
            yield block(rows)

    return work


def matrix(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, buckets: int = BUCKETS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Write the documents' CSR blocks to Parquet at path, and read them."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    _spark.arrow(rows, _matrix(run, buckets, block_rows), BLOCK_SCHEMA).write.options(compression="zstd", **ROW_GROUPS).parquet(path)
    return docs.sparkSession.read.schema(BLOCK_SCHEMA).parquet(path)


def _entries(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of the batch's block k."""
    return (np.frombuffer(batch.column(name)[k].as_buffer(), "<u4").astype(np.int64) for name in ("bucket", "count"))


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket; the driver gets one number for each bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                bucket, count = _entries(batch, k)
                total += np.bincount(bucket, weights=count, minlength=buckets).astype(np.int64)  # exact: below 2**53 a block
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    parts = _spark.arrow(blocks.select("bucket", "count"), work, "bucket long, n long")
    table = parts.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return out


def gains(have: np.ndarray, want: np.ndarray) -> np.ndarray:
    """floor(1000 ln(p / q)) for each bucket, p of the target and q of the documents, each with one added to its counts."""
    n, all_have, all_want = len(have), int(have.sum()), int(want.sum())
    return np.array([math.floor(1000 * math.log(((int(t) + 1) * (all_have + n)) / ((int(s) + 1) * (all_want + n)))) for s, t in zip(have, want, strict=True)], np.int64)


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """One row for each document: id, n_words, n_features, weight; the matrix times the gains."""
    shared = blocks.sparkSession.sparkContext.broadcast(gain)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                bucket, count = _entries(batch, k)
                total = np.concatenate([[0], np.cumsum(shared.value[bucket] * count)])
                end = np.frombuffer(batch.column("row_end")[k].as_buffer(), "<i8")
                own = np.diff(total[np.concatenate([[0], end])])
                yield pa.record_batch([*(batch.column(c)[k].values for c in ("ids", "n_words", "n_features")), pa.array(own)], names=["id", "n_words", "n_features", "weight"])

    return _spark.arrow(blocks, work, "id long, n_words long, n_features long, weight long")


def scored(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """rows with score: weight + floor(-1000 ln(-ln u)), u from the first 32 bits of sha256(`seed:id`)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.log(-F.log((h + 0.5) / float(1 << 32))) * -1000.0)
    return rows.withColumn("score", F.col("weight") + noise)


def drawn(rows: DataFrame, percent: int = 5, least: int = 20) -> DataFrame:
    """rows (materialised, with a score) with rank: 1, 2, ... of the highest scores of documents of `least` words or more, null where not drawn."""
    able = F.col("n_words") >= least
    n, low = rows.where(able).agg(F.count("*"), F.percentile_approx("score", max(0.0, 1 - percent / 100 - 0.005), 10_000)).first()
    take = percent * n // 100
    if not take:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    near = able & (F.col("score") >= low)
    if rows.where(near).count() < take:
        near = able
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("n_features"), F.asc("weight")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = _spark.cut(rows.where(near).repartitionByRange(parts, *order).sortWithinPartitions(*order))
    placed = ranged.withColumns({"_p": F.spark_partition_id(), "_k": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    sizes = sorted((r["_p"], r["count"]) for r in placed.groupBy("_p").count().collect())  # a row for each partition
    before, offsets = 0, []
    for p, size in sizes:
        offsets.append((p, before))
        before += size
    table = F.broadcast(rows.sparkSession.createDataFrame(offsets, "_p int, _before long"))
    place = F.col("_before") + F.col("_k") + 1
    ranked = placed.join(table, "_p").select(*rows.columns, F.when(place <= take, place).alias("rank"))
    return ranked.unionByName(rows.where(~F.coalesce(near, F.lit(False))).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least: int = 20, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", seed: int = SEED, run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """One row for each row of docs: id, n_words, n_features, weight, score, rank."""
    spark = docs.sparkSession
    folder = f"{_spark.shared_folder(spark).rstrip('/')}/resampling-{uuid.uuid4().hex}"
    wanted = target.select(F.lit(None).cast("long").alias("id"), F.col(target_text).alias("text"))
    have, want = matrix(docs, f"{folder}/docs", id_col, text_col, run, buckets), matrix(wanted, f"{folder}/target", "id", "text", run, buckets)
    gain = gains(column_sums(have, buckets), column_sums(want, buckets))
    rows = _spark.cut(scored(weights(have, gain), seed))
    _spark.delete(spark, folder)
    return drawn(rows, percent, least)


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(_spark.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


#: the same in DuckDB SQL, which has no CRC-32: a byte at a time over distinct features
SQL = r"""
WITH RECURSIVE bits AS (SELECT b, b AS s, 0 AS k FROM range(256) AS t(b) UNION ALL SELECT b, CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(s ORDER BY b) AS t FROM bits WHERE k = 8),
texts AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), text FROM benchmark),
words AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
runs AS (SELECT side, id, array_to_string(w[s:s + n - 1], ' ') AS f, count(*) AS c FROM words, range(1, 4) AS r(n), unnest(range(1, len(w) - n + 2)) AS t(s) GROUP BY ALL),
hashed AS (SELECT f, xor(list_reduce(list_transform(range(0, strlen(f) * 2, 2), lambda i: ('0x' || substr(x, i + 1, 2))::BIGINT), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295) % 10000 AS bucket
           FROM (SELECT DISTINCT f, hex(encode(f)) AS x FROM runs), tab),
cells AS (SELECT side, id, bucket, sum(c) AS c FROM runs JOIN hashed USING (f) GROUP BY ALL),
sums AS (SELECT b AS bucket, coalesce(sum(c) FILTER (WHERE side = 0), 0) AS s, coalesce(sum(c) FILTER (WHERE side = 1), 0) AS t FROM range(10000) AS r(b) LEFT JOIN cells ON bucket = b GROUP BY b),
gains AS (SELECT bucket, floor(1000 * ln(((t + 1) * (sum(s) OVER () + 10000))::DOUBLE / ((s + 1) * (sum(t) OVER () + 10000))::DOUBLE))::BIGINT AS g FROM sums),
weighed AS (SELECT id, sum(c) AS n, sum(c * g) AS w FROM cells JOIN gains USING (bucket) WHERE side = 0 GROUP BY id),
scored AS (SELECT id AS doc_id, len(words.w) AS n_words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weighed.w, 0)::BIGINT AS weight,
                  coalesce(weighed.w, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
           FROM words LEFT JOIN weighed USING (id) WHERE side = 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND r <= 5 * n // 100 THEN r END AS rank FROM placed"""
