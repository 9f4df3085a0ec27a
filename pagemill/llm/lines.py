"""Problem 2: lines repeated across the records of one site.

Lines are hashed natively (letters only, lower case), distinct records are counted per site and hash, hashes
above the record share are kept, and each record looks its own hashes up in the short list of its site. Contents are
read once; only arrays of hashes are shuffled, never texts. Counts are combined before they are shuffled by site and
hash, and what is joined by site alone is cut into parts of each site.

Defined cases: null contents are no records; a record without any host in its URLs belongs to no site and has no
rows; lines without letters are never repeated; several rows of one id count as one record, the latest delivery
(by ``ingested_at``, then the content's hash) standing for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, scrapes, site

MIN_RECORDS = 6
#: A repeated line occurs in at least one of so many records of its site (2 %).
ONE_IN = 50
#: Parts of each site in the look-up join, so that no task holds a large site alone.
SALT = 32


def line_hashes(content: Column) -> Column:
    """A hash for each line of ``content`` in order, null for lines without letters."""
    lines = F.split(F.regexp_replace(F.lower(content), r"[^\p{L}\n]+", ""), "\n", -1)
    return F.transform(lines, lambda x: F.when(x != "", F.xxhash64(x)))


def records(df: DataFrame) -> DataFrame:
    """(scrape_id, site, hashes) of each record with content, one row an id."""
    rows = df.where("content IS NOT NULL").select(
        "scrape_id",
        F.struct(F.col("ingested_at"), F.xxhash64("content").alias("tie"), site(F.col("metadata.source_url"), F.col("final_url")).alias("site"), line_hashes(F.col("content")).alias("hashes")).alias("r"),
    )
    return rows.groupBy("scrape_id").agg(F.max_by("r", F.struct("r.ingested_at", "r.tie")).alias("r")).select("scrape_id", F.col("r.site").alias("site"), F.col("r.hashes").alias("hashes"))


def repeated(recs: DataFrame, min_records: int = MIN_RECORDS, one_in: int = ONE_IN) -> DataFrame:
    """(site, hash, n_records, site_records) of the lines repeated excessively within a site."""
    recs = recs.where("site IS NOT NULL")
    sizes = recs.groupBy("site").agg(F.count("*").alias("site_records"))
    counts = recs.select("site", F.explode(F.array_distinct("hashes")).alias("hash")).where("hash IS NOT NULL").groupBy("site", "hash").agg(F.count("*").alias("n_records")).where(F.col("n_records") >= min_records)
    # a site's size goes to each part of the site
    parts = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = counts.withColumn("salt", F.pmod("hash", F.lit(SALT)).cast("int"))
    return salted.join(parts, ["site", "salt"]).drop("salt").where(F.col("n_records") * one_in >= F.col("site_records"))


def with_repeated(recs: DataFrame, found: DataFrame, salt: int = SALT) -> DataFrame:
    """``recs`` of sites that have repeated lines, with these lines' hashes as ``bad``: per site at most
    ``ONE_IN`` times the mean number of lines of a record."""
    lists = found.groupBy("site").agg(F.collect_list("hash").alias("bad")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return recs.withColumn("salt", F.pmod(F.xxhash64("scrape_id"), F.lit(salt)).cast("int")).join(lists, ["site", "salt"]).drop("salt")


def found_lines(df: DataFrame, min_records: int = MIN_RECORDS, one_in: int = ONE_IN) -> DataFrame:
    """(scrape_id, line_no) of each occurrence of a repeated line."""
    recs = cut(records(df))
    # the record's own lines among its site's list, met by hash; their places then by the few that are
    hit = with_repeated(recs.where("site IS NOT NULL"), repeated(recs, min_records, one_in)).select("scrape_id", "hashes", F.array_intersect("hashes", "bad").alias("own")).where(F.size("own") > 0)
    marks = F.filter(F.transform("hashes", lambda h, i: F.when(F.array_contains(F.col("own"), h), (i + 1).cast("bigint"))), lambda x: x.isNotNull())
    return hit.select("scrape_id", F.explode(marks).alias("line_no"))


def without_repeated(df: DataFrame, min_records: int = MIN_RECORDS, one_in: int = ONE_IN) -> DataFrame:
    """(scrape_id, content, removed) of every record, rebuilt without the repeated lines of its site."""
    bad = found_lines(df, min_records, one_in).groupBy("scrape_id").agg(F.collect_set("line_no").alias("bad"))  # a record's own lines
    texts = df.where("content IS NOT NULL").groupBy("scrape_id").agg(F.max_by("content", F.struct("ingested_at", F.xxhash64("content"))).alias("content"))
    out = texts.join(bad, "scrape_id", "left")
    kept = F.filter(F.split("content", "\n", -1), lambda x, i: ~F.array_contains(F.col("bad"), (i + 1).cast("bigint")))
    return out.select("scrape_id", F.when(F.col("bad").isNull(), F.col("content")).otherwise(F.array_join(kept, "\n")).alias("content"), F.when(F.col("bad").isNull(), 0).otherwise(F.size("bad")).cast("bigint").alias("removed"))


def p2_found(spark, sf):
    """(scrape_id, line_no) of the repeated lines."""
    return found_lines(scrapes(spark, sf))


def p2_clean(spark, sf):
    """Every record's content without the repeated lines of its site."""
    return without_repeated(scrapes(spark, sf))


def p2_lines(spark, sf):
    """The repeated lines of each site, by hash, with their records and the site's."""
    return repeated(records(scrapes(spark, sf)))
