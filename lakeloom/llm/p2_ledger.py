r"""Problem 2: duplicates hidden by formatting.

Each text has a plain key, of its letters and digits only, so that white space, letter case and punctuation don't
count; a record of ``Field: value`` pairs (lines, one line with ``;``, ``|`` or ``,``, JSON) also has a record key, of its
pairs in sorted order. Texts that share either key are copies, and so are texts that a third one links.
The ledger holds one row for each pair of keys: (bucket, key, record, copies, first_id), stored by bucket of the key's hash
(``Ledger``). A batch is aggregated, the buckets it has keys in are read and full outer joined to it, counts are added, the earliest
representative (smallest id) is kept, and those buckets alone are written anew; files of the others stay as they are. ``groups``
links the ledger's rows: a plain key goes with its record key, and record keys that share a plain key are
connected as components.

Defined cases: null, empty and blank texts take no part. A text without any letter or digit is its
own key without its white space. Equal ids count as often as they occur. An empty batch leaves the
ledger as it is, and an empty ledger becomes the batch. All of it runs in the JVM.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import clusters
from .common import JAVA_SPACE, cut, not_blank, shared_dir, table, written

#: Buckets of the ledger; a batch touches only those it has keys in.
BUCKETS = 64
LEDGER = "bucket int, key binary, record binary, copies long, first_id string"
_NAME = r"^\s*(?:[-*+•‣·–—◦▪]\s+)?\*{0,3}\p{L}[\p{L}\p{N}_ \-]{0,40}?\s?\*{0,3}\s?:"
_FIELD = _NAME + r"\s*[^\s].*$"
_LINE_FIELD = _NAME + r"\*{0,3}\s+[^\s].*$"
#: The start of a text that any of the record forms may accept.
_START = r"^[\s;|,]*(?:\{\s*\"|(?:[-*+•‣·–—◦▪]\s+)?\*{0,3}\p{L}[\p{L}\p{N}_\s\-]*\*{0,3}\s?:)"
_JSON = r"(?s)^\s*\{\s*\"[^\"]*\"\s*:.*\}\s*$"


def _bare(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", "")


def _pairs(parts: Column) -> Column:
    """The pairs in order of their text; each value stays with its field, for the split is at the first colon."""
    bare = F.transform(parts, lambda x: F.concat(_bare(F.regexp_extract(x, r"(?s)^(.*?):(.*)$", 1)), F.lit("\u0001"), _bare(F.regexp_extract(x, r"(?s)^(.*?):(.*)$", 2))))
    return F.array_join(F.array_sort(bare), "\u0002")


def _json_pairs(c: Column) -> Column:
    entries = F.map_entries(F.from_json(c, "map<string,string>"))
    bare = F.transform(entries, lambda e: F.concat(_bare(e["key"]), F.lit("\u0001"), _bare(F.coalesce(e["value"], F.lit("null")))))
    return F.array_join(F.array_sort(bare), "\u0002")


def plain_text(c: Column) -> Column:
    """The letters and digits of a text; null for null and blank texts."""
    plain = _bare(c)
    return F.when(not_blank(c), F.when(plain != "", plain).otherwise(F.concat(F.lit("\u0003"), F.regexp_replace(c, JAVA_SPACE, ""))))


def record_text(c: Column) -> Column:
    """The sorted pairs of a record; null for other texts."""
    text = F.regexp_replace(F.regexp_replace(c, r"\r", "\n"), r"[   -   　]", " ")
    lines = F.filter(F.split(text, r"\n"), lambda x: x.rlike(r"\S"))
    flat = F.regexp_replace(text, r"\s+", " ")
    semi, pipe, comma = (F.filter(F.split(flat, s), lambda x: x.rlike(r"\S")) for s in (";", r"\|", ","))
    all_fields = lambda a, p: (F.size(a) > 1) & F.forall(a, lambda x: x.rlike(p))
    record = (
        F.when(text.rlike(_JSON), _json_pairs(text))
        .when(all_fields(lines, _LINE_FIELD), _pairs(lines))
        .when(flat.contains(";") & all_fields(semi, _FIELD), _pairs(semi))
        .when(flat.contains("|") & all_fields(pipe, _FIELD), _pairs(pipe))
        .when(flat.contains(",") & all_fields(comma, _FIELD), _pairs(comma))
    )
    return F.when(text.rlike(_START), record)


def canonical_text(c: Column) -> Column:
    """The canonical form of a text, as one string, a record's where it is one; null for null and blank texts."""
    return F.when(not_blank(c), F.coalesce(record_text(c), plain_text(c)))


def keyed(df: DataFrame, id_col: str = "id", text: str = "content", also: tuple[str, ...] = ()) -> DataFrame:
    """(bucket, key, record, id, ...): SHA-256 of the plain form, and of the record form or null."""
    c = F.col(text)
    form = df.select(F.col(id_col).alias("id"), *also, plain_text(c).alias("form"), record_text(c).alias("pairs")).where("form is not null")
    hashed = form.select(F.unhex(F.sha2("form", 256)).alias("key"), F.unhex(F.sha2("pairs", 256)).alias("record"), "id", *also)
    return hashed.select(F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int").alias("bucket"), "key", "record", "id", *also)


def batch_counts(keys: DataFrame) -> DataFrame:
    return keys.groupBy("bucket", "key", "record").agg(F.count("*").alias("copies"), F.min("id").cast("string").alias("first_id"))


def merge_ledger(ledger: DataFrame, batch: DataFrame) -> DataFrame:
    """The ledger after the counts of a batch."""
    old, new = ledger.alias("o"), batch.alias("n")
    both = old.join(new, (F.col("o.bucket") == F.col("n.bucket")) & (F.col("o.key") == F.col("n.key")) & F.col("o.record").eqNullSafe(F.col("n.record")), "full_outer")
    return both.select(
        F.coalesce("o.bucket", "n.bucket").alias("bucket"),
        F.coalesce("o.key", "n.key").alias("key"),
        F.coalesce("o.record", "n.record").alias("record"),
        (F.coalesce("o.copies", F.lit(0)) + F.coalesce("n.copies", F.lit(0))).cast("long").alias("copies"),
        F.least("o.first_id", "n.first_id").alias("first_id"),
    )


def _batches(keys: DataFrame, when: str) -> list[DataFrame]:
    """The rows up to the middle of their times, and the later ones with those without a time."""
    ends = keys.agg(F.min(when).cast("double").alias("a"), F.max(when).cast("double").alias("z")).first()
    if ends is None or ends["a"] is None:
        return [keys]
    early = F.coalesce(F.col(when).cast("double") <= (ends["a"] + ends["z"]) / 2, F.lit(False))
    return [keys.where(early), keys.where(~early)]


class Ledger:
    """A ledger stored by bucket: ``path/g=<generation>/bucket=<bucket>``; a bucket's latest generation holds.

    A generation counts once it is complete, so a batch that fails leaves the ledger as it was. Old generations may be removed
    by ``vacuum`` when nobody reads them.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"

    def _list(self, path: str, prefix: str) -> list[int]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix))

    def _complete(self) -> list[int]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = hadoop(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [g for g in self._list(self.path, "g=") if fs.exists(hadoop(f"{self.path}/g={g}/_SUCCESS"))]

    def latest(self) -> dict[int, int]:
        """The generation that holds for each bucket."""
        return {b: g for g in self._complete() for b in self._list(f"{self.path}/g={g}", "bucket=")}

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The ledger, or some of its buckets; no other bucket's files are read."""
        by: dict[int, list[int]] = {}
        for b, g in self.latest().items():
            if buckets is None or b in buckets:
                by.setdefault(g, []).append(b)
        parts = [self.spark.read.schema(LEDGER).parquet(f"{self.path}/g={g}").where(F.col("bucket").isin(bs)) for g, bs in sorted(by.items())]
        return reduce(DataFrame.unionByName, parts) if parts else self.spark.createDataFrame([], LEDGER)

    def add(self, keys: DataFrame) -> Ledger:
        """Add a batch of keys."""
        batch = written(batch_counts(keys))
        touched = [r["bucket"] for r in batch.select("bucket").distinct().collect()]  # BUCKETS at most
        if touched:
            merged = merge_ledger(self.read(touched), batch).repartition("bucket")
            merged.write.partitionBy("bucket").parquet(f"{self.path}/g={1 + max(self._list(self.path, 'g='), default=0)}")
        return self

    def vacuum(self) -> None:
        """Remove generations that no bucket needs any more."""
        kept = set(self.latest().values())
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = hadoop(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        for g in self._list(self.path, "g="):
            if g not in kept:
                fs.delete(hadoop(f"{self.path}/g={g}"), True)


def build_ledger(batches: list[DataFrame], path: str | None = None) -> DataFrame:
    """The ledger after all batches of keys, one after the other; ``path`` is that of a ledger to go on with."""
    ledger = Ledger(batches[0].sparkSession, path)
    for batch in batches:
        ledger.add(batch)
    return ledger.read()


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(keyed(table(spark, sf_dir, "simulated_vector_db").select("id", "content", "ingested_at"), also=("ingested_at",)))


def groups(ledger: DataFrame) -> DataFrame:
    """(bucket, key, group, copies, first_id): each plain key with its group, and that group's count and representative."""
    ends = ledger.groupBy("bucket", "key").agg(F.sum("copies").alias("n"), F.min("first_id").alias("first"), F.min("record").alias("record"), F.max("record").alias("last"))
    ends = cut(ends)
    several = ends.where("record <> last").select("bucket", "key", F.col("record").alias("a"))
    links = several.join(ledger.select("bucket", "key", F.col("record").alias("b")), ["bucket", "key"]).where("a <> b").select("a", "b")
    parts = clusters(links).select(F.col("id").alias("record"), "cluster")
    named = ends.join(parts, "record", "left").select("bucket", "key", F.coalesce("cluster", "record", "key").alias("group"), "n", "first")
    whole = named.groupBy("group").agg(F.sum("n").alias("copies"), F.min("first").alias("first_id"))
    return named.select("bucket", "key", "group").join(whole, "group").select("bucket", "key", "group", "copies", "first_id")


def copies(keys: DataFrame, ledger: DataFrame) -> DataFrame:
    """(first_id, copy_id) for each record that is not its group's representative."""
    more = groups(ledger).where("copies > 1").select("bucket", "key", "first_id")
    return keys.select("bucket", "key", F.col("id").alias("copy_id")).join(more, ["bucket", "key"]).where("copy_id <> first_id").select("first_id", "copy_id")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _keys(spark, sf_dir)
    return copies(keys, build_ledger(_batches(keys, "ingested_at")))


def p2_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(build_ledger(_batches(_keys(spark, sf_dir), "ingested_at"))).select("group", "first_id", "copies").distinct().select("first_id", "copies")


QUERIES = {"p2_found": p2_found, "p2_ledger": p2_ledger}
SQL: dict[str, str] = {}
