"""URL rules by a sort-merge range join over reversed-host keys.

A rule (host, path) fits its host and all subdomains where the URL's path starts with the rule's.
Reversing a host's labels (``www.example.org`` becomes ``org.example.www.``) makes "this host and
its subdomains" the interval of keys with the rule's reversed host as prefix. URLs are cut into key
ranges by sampled bounds, each rule goes to every range that its interval meets, and each range is
swept in key order with a stack of the nested rules that are active.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rules of the registered query: verdict, host, path.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Above any character that UTF-8 can hold, so above every key with the same prefix.
_LAST = "\U0010ffff"


def split_url(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or where ``://`` is missing."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(F.coalesce(rest, F.lit("")), r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substr(F.coalesce(rest, F.lit("")), F.char_length(host) + 1), r"\A[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def host_key(host: F.Column) -> F.Column:
    """Labels in reverse order, each followed by a dot; empty for an empty host."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def rule_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", ranges: int | None = None, sample_rows: int = 20_000) -> DataFrame:
    """``pages`` plus host, path, rule and verdict columns (columns of these names are replaced).

    The longest fitting rule (characters of host and path together, then of the host) wins; between
    two rules of the same host and path ``block`` wins. Rules with a null part or an empty host are
    ignored; rule hosts are lower-cased as URLs' are. A URL without a host gets ``default``. Null ids,
    repeated rows and empty tables pass through. ``rule`` is host followed by path.

    ``sample_rows`` bounds the keys sampled for range bounds, which only balance the work. A host with
    many pages spreads over ranges, as bounds also hold the path and a hash of the row.
    """
    spark = pages.sparkSession
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = split_url(F.col(f"`{url}`").cast("string"))
    given = pages.select(*[F.col(f"`{c}`") for c in kept], host.alias("__host"), path.alias("__path"))
    given = given.withColumn("__key", host_key(F.col("__host")))
    given = given.withColumn("__salt", F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in kept[:4]]))
    parts = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = given.count()
    bounds: list[tuple] = []
    if total > parts:
        share = min(1.0, sample_rows / total)
        seen = given.where(F.abs(F.xxhash64("__salt", F.lit(7)) % 1_000_000) < int(share * 1_000_000) + 1) if share < 1 else given
        keys = sorted(tuple(r) for r in seen.select("__key", "__path", "__salt").limit(2 * sample_rows).collect())
        bounds = sorted({keys[len(keys) * i // parts] for i in range(1, parts)})
    shared = spark.sparkContext.broadcast(bounds)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("__key").to_pylist(), batch.column("__path").to_pylist(), batch.column("__salt").to_pylist(), strict=True)
            yield batch.append_column("__part", pa.array([bisect_right(shared.value, r) for r in rows], pa.int32()))

    def spanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [list(range(bisect_right(shared.value, (k, "", -(2**63))), bisect_right(shared.value, (k + _LAST, "", 0)) + 1)) for k in batch.column("__key").to_pylist()]
            yield batch.append_column("__parts", pa.array(spans, pa.list_(pa.int32())))

    schema = T.StructType([*given.schema.fields, T.StructField("__part", T.IntegerType())])
    located = given.mapInArrow(placed, schema)
    clean = rules.select(F.col("verdict"), F.translate("host", _UPPER, _LOWER).alias("host"), F.col("path")).dropna()
    clean = clean.where("host <> ''").groupBy("host", "path").agg(F.max("verdict").alias("__verdict"))
    clean = clean.select(F.concat("host", "path").alias("__rule"), F.col("path").alias("__path"), F.char_length("host").alias("__size"), host_key(F.col("host")).alias("__key"), "__verdict")
    spread = clean.mapInArrow(spanned, T.StructType([*clean.schema.fields, T.StructField("__parts", T.ArrayType(T.IntegerType()))]))
    spread = spread.select("__rule", "__path", "__size", "__key", "__verdict", F.explode("__parts").alias("__part"))
    # Rules sort before the pages of the same key.
    union = located.withColumn("__page", F.lit(True)).unionByName(spread.withColumn("__page", F.lit(False)), allowMissingColumns=True)
    union = union.repartition(parts, "__part").sortWithinPartitions("__part", "__key", "__page")
    out = T.StructType([pages.schema[c] for c in kept] + [T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")])

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, list]] = []
        part = None
        for batch in batches:
            col = {c: batch.column(c).to_pylist() for c in ("__part", "__key", "__page", "__path", "__rule", "__size", "__verdict")}
            take, rule, verdict = [], [], []
            for i, key in enumerate(col["__key"]):
                if col["__part"][i] != part:
                    part, stack = col["__part"][i], []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if not col["__page"][i]:
                    entry = (len(col["__rule"][i]), col["__size"][i], col["__path"][i], col["__rule"][i], col["__verdict"][i])
                    if stack and stack[-1][0] == key:
                        stack[-1][1].append(entry)
                    else:
                        stack.append((key, [entry]))
                    continue
                path = col["__path"][i]
                best = max((e for _, entries in stack for e in entries if path.startswith(e[2])), default=None)
                take.append(i)
                rule.append(best[3] if best else None)
                verdict.append(best[4] if best else default)
            if take:
                rows = batch.take(pa.array(take))
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in kept], rows.column("__host"), rows.column("__path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[*kept, "host", "path", "rule", "verdict"])

    return union.mapInArrow(swept, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, rule_frame(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '\A[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '\A[^/?#]*')) + 1), '\A[^?#]*') AS path FROM p
), r(verdict, rh, rp) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), m AS (
  SELECT h.page_id, h.host, h.path, r.rh || r.rp AS rule, r.verdict,
         row_number() OVER (PARTITION BY h.page_id ORDER BY length(r.rh || r.rp) DESC, length(r.rh) DESC) AS n
  FROM h LEFT JOIN r ON (h.host = r.rh OR ends_with(h.host, '.' || r.rh)) AND starts_with(h.path, r.rp)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE n = 1
"""
