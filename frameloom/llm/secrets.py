"""Secret scans with an incremental blob ledger, in DataFrame operations only.

Every version of every path is content-addressed (SHA-256). The ledger holds one row for each
blob and rule version that has been scanned, with its spans; a run scans only pairs that the
ledger lacks, appends them, and joins the spans back to all paths that ever held the blob.

Positions come from the text itself: split() by a pattern gives what lies between its matches,
regexp_extract_all() the matches; running sums of both lengths are the spans, in code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frameloom.llm.common import materialize, release

#: kind: (pattern, group whose length counts, least length). The order is the order of kinds at equal starts.
#: A run of hex digits or an access key matches whole, so that the least length can stand in the pattern; a short
#: assignment still consumes its text, so that it is dropped after matching.
RULES: dict[str, tuple[str, int, int]] = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": (r"(AKIA[A-Z0-9]{12,})", 1, 16),
    "hex": (r"([0-9a-f]{32,})", 1, 32),
}
RULE_VERSION = "base-1"


SPANS = "array<struct<start:int,kind_no:int,kind:string,end:int>>"
_LENGTHS = "array<struct<kind_no:int,place:int,gap:int,whole:int,part:int>>"


def _lengths(text: Column, kind: str) -> Column:
    """Of each match of a kind: its number, how far it is from the last, how long it is, and its measured group."""
    pattern, group, _ = RULES[kind]
    lit = F.lit(pattern)
    sizes = lambda found: F.transform(found, F.length)
    whole, part = (sizes(F.regexp_extract_all(text, lit, F.lit(g))) for g in (0, group))
    gaps = sizes(F.split(text, pattern, -1))
    rows = F.transform(
        F.arrays_zip(whole.alias("whole"), part.alias("part"), gaps.alias("gap")),
        lambda x, i: F.struct(F.lit(list(RULES).index(kind)).alias("kind_no"), i.alias("place"), x["gap"].alias("gap"), x["whole"].alias("whole"), x["part"].alias("part")),
    )
    matches = F.filter(rows, lambda x: x["whole"].isNotNull())  # the text after the last match has a length, but no match
    return F.when(F.regexp_like(text, lit), matches.cast(_LENGTHS)).otherwise(F.array().cast(_LENGTHS))


def lengths(text: Column) -> Column:
    """All matches of a text by their lengths. Null or empty text: an empty array."""
    text = F.coalesce(text, F.lit(""))
    return F.concat(*(_lengths(text, k) for k in RULES))


def placed(scanned: DataFrame, key: str) -> DataFrame:
    """(key, spans) of scanned(key, lengths), key distinct: running sums of the lengths are the places.

    One row a match, summed in windows: the work grows with the matches, however many a text has. Spans are sorted
    by start, then kind as listed; a key without a span has an empty array.
    """
    upto = Window.partitionBy(key, "kind_no").orderBy("place")
    matches = scanned.select(key, F.inline("lengths"))
    ends = matches.withColumn("end", F.sum(F.col("gap") + F.col("whole")).over(upto).cast("int"))
    least = F.element_at(F.array(*(F.lit(least) for _, _, least in RULES.values())), F.col("kind_no") + 1)
    kind = F.element_at(F.array(*map(F.lit, RULES)), F.col("kind_no") + 1)
    span = F.struct((F.col("end") - F.col("whole")).alias("start"), "kind_no", kind.alias("kind"), "end")
    spans = ends.where(F.col("part") >= least).groupBy(key).agg(F.array_sort(F.collect_list(span)).cast(SPANS).alias("spans"))
    return scanned.select(key).join(spans, key, "left").select(key, F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def blob_id(text: Column) -> Column:
    """SHA-256 of the UTF-8 text; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def update_ledger(versions: DataFrame, path_col: str, text_col: str, ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(what this run adds to the ledger, path -> blob).

    versions holds a row for each historical version of a path; only path_col and text_col are read.
    ledger(blob_id, rule_version, spans) is what earlier runs have added. Blobs that it holds under
    this rule version are not scanned again; a blob that occurs under many paths is scanned once.
    """
    named = versions.select(F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    paths = materialize(named.select("path", blob_id(F.col("text")).alias("blob_id")), "paths")
    unseen = paths.groupBy("blob_id").agg(F.min("path").alias("path"))
    if ledger is not None:
        known = ledger.where(F.col("rule_version") == rule_version).select("blob_id").distinct()
        unseen = unseen.join(known, "blob_id", "left_anti")
    unseen = unseen.withColumnRenamed("path", "first_path").withColumnRenamed("blob_id", "first_blob")
    texts = named.join(unseen, F.col("path").eqNullSafe(F.col("first_path")) & (blob_id(F.col("text")) == F.col("first_blob")))
    # a path may hold a blob more than once (repeated rows, or null paths)
    scanned = materialize(texts.select(F.col("first_blob").alias("blob_id"), lengths(F.col("text")).alias("lengths")).groupBy("blob_id").agg(F.first("lengths").alias("lengths")), "scanned")
    added = materialize(placed(scanned, "blob_id").select("blob_id", F.lit(rule_version).alias("rule_version"), "spans"), "ledger")
    release(scanned)
    return added, paths


def _report(paths: DataFrame, known: DataFrame) -> DataFrame:
    hits = known.where(F.size("spans") > 0).select("blob_id", "spans").dropDuplicates(["blob_id"])
    return paths.join(hits, "blob_id", "left").select("path", "blob_id", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def secrets(versions: DataFrame, path_col: str = "doc_id", text_col: str = "text", ledger: DataFrame | None = None, rule_version: str = RULE_VERSION) -> DataFrame:
    """(path, blob_id, spans): for each row of versions, the spans of its text, from the ledger and this run.

    Null text is scanned as empty. Rows that repeat stay. Null paths are reported like others. Texts are scanned whole,
    in time that grows with their length. Other columns are not read. An empty table gives no rows.
    """
    added, paths = update_ledger(versions, path_col, text_col, ledger, rule_version)
    return _report(paths, added if ledger is None else ledger.where(F.col("rule_version") == rule_version).select(*added.columns).union(added))


LEDGER = f"blob_id string, rule_version string, spans {SPANS}"


def scan_versions(versions: DataFrame, ledger_path: str, path_col: str = "doc_id", text_col: str = "text", rule_version: str = RULE_VERSION) -> DataFrame:
    """secrets() with a ledger kept at ledger_path: what it lacks is scanned and appended, a folder for each rule version.

    A run that is broken off has appended all of its blobs or none. Two runs at once may scan a blob twice; its spans are
    the same. Nulls, repeated rows, other columns and the empty table: as in secrets().
    """
    spark = versions.sparkSession
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(ledger_path)
    there = at.getFileSystem(sc._jsc.hadoopConfiguration()).exists(at)
    ledger = spark.read.schema(LEDGER).parquet(ledger_path) if there else spark.createDataFrame([], LEDGER)
    added, paths = update_ledger(versions, path_col, text_col, ledger, rule_version)
    added.write.mode("append").partitionBy("rule_version").parquet(ledger_path)
    release(added)
    return _report(paths, spark.read.schema(LEDGER).parquet(ledger_path).where(F.col("rule_version") == rule_version))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined; no spans: the empty string."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


#: A text is cut into blocks of so many characters once, so that what lies between two spans is found without walking the text from its beginning.
_BLOCK = 1024


def merged(df: DataFrame, key: str, spans: str = "spans") -> DataFrame:
    """(key, runs) of df(key, spans), key distinct: runs of overlapping spans as one, (start, end), sorted. Keys without spans are left out."""
    flat = df.select(key, F.inline(spans))
    before = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    begins = flat.withColumn("reached", F.max("end").over(before)).withColumn("begins", F.when(F.col("reached") > F.col("start"), 0).otherwise(1))
    numbered = begins.withColumn("run", F.sum("begins").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy(key, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return runs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"))


def redact(text: Column, runs: Column, mask: str = "[SECRET]") -> Column:
    """text with each of runs (start, end; sorted, apart) replaced by mask. Null text, and text without runs (null or empty), stays as it is."""
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))

    def between(block: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / _BLOCK).cast("int")
        some = F.array_join(F.slice(block, first + 1, F.floor(end / _BLOCK).cast("int") - first + 1), "")
        return F.substring(some, start - first * _BLOCK + 1, end - start)

    def cut(block: Column) -> Column:
        stop = lambda i: F.when(i > 0, F.get(runs, i - 1)["end"]).otherwise(0)
        head = F.transform(runs, lambda r, i: F.concat(between(block, stop(i), r["start"]), F.lit(mask)))
        return F.concat(F.array_join(head, ""), between(block, F.element_at(runs, -1)["end"], F.length(text)))

    # the blocks are an element of an array, so that they are cut once, not for each run
    return F.when(F.coalesce(F.size(runs), F.lit(0)) > 0, F.get(F.transform(F.array(blocks), cut), F.lit(0))).otherwise(text)
