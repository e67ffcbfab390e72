"""Ledger text: entries rendered for two text backends, written in a stable order.

Lines are rendered on the executors, one string an entry, and written by a range-sorted text sink: part files in name
order are the journal, whatever its size.  A digest of the sorted entries tells whether a new journal differs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.functions.formatting import sanitized_text

def amount_text(paise: Column) -> Column:
    return (paise.cast("decimal(22,2)") / 100).cast("decimal(20,2)").cast("string")


def entries(postings: DataFrame, rows: DataFrame) -> DataFrame:
    """One row an entry: id, date, payee and its postings in order."""
    payee = F.coalesce(F.nullif(sanitized_text(F.coalesce("counterparty", "raw_description")), F.lit("")), F.lit("Unknown"))
    g = postings.groupBy("id", "date").agg(F.array_sort(F.collect_list(F.struct("leg", "account", "commodity", "amount_paise"))).alias("postings"))
    return g.join(rows.select(F.col("id").alias("_i"), payee.alias("payee")), F.col("id") == F.col("_i")).drop("_i")


def ledger_entry(date: Column, payee: Column, postings: Column) -> Column:
    """``date * payee`` and an indented line a posting: account, amounts right-aligned at column 52, commodity."""
    line = lambda p: F.concat(F.lit("    "), F.rpad(p["account"], 36, " "), F.lpad(amount_text(p["amount_paise"]), 14, " "), F.lit(" "), p["commodity"])
    return F.concat(F.date_format(date, "yyyy/MM/dd"), F.lit(" * "), payee, F.lit("\n"), F.concat_ws("\n", F.transform(postings, line)))


def beancount_account(name: Column) -> Column:
    """Account parts with a capital first and only letters, digits and dashes."""
    part = lambda p: F.regexp_replace(F.concat(F.upper(F.left(p, F.lit(1))), F.substring(p, F.lit(2), F.length(p))), "[^A-Za-z0-9-]", "-")
    return F.concat_ws(":", F.transform(F.split(name, ":"), part))


def beancount_entry(date: Column, payee: Column, postings: Column) -> Column:
    line = lambda p: F.concat(F.lit("  "), beancount_account(p["account"]), F.lit("  "), amount_text(p["amount_paise"]), F.lit(" "), p["commodity"])
    quoted = F.concat(F.lit('"'), F.replace(payee, F.lit('"'), F.lit("'")), F.lit('"'))
    return F.concat(date.cast("string"), F.lit(" * "), quoted, F.lit("\n"), F.concat_ws("\n", F.transform(postings, line)))


def open_directives(postings: DataFrame) -> DataFrame:
    """The first use of every account, and its commodities."""
    g = postings.groupBy(beancount_account(F.col("account")).alias("account")).agg(F.min("date").alias("opened"), F.array_sort(F.collect_set("commodity")).alias("commodities"))
    return g.select("account", F.concat(F.col("opened").cast("string"), F.lit(" open "), F.col("account"), F.lit(" "), F.concat_ws(",", "commodities")).alias("line"))


def write_journal(texts: DataFrame, path: str) -> None:
    """``texts`` (date, id, text) as text files in (date, id) order."""
    texts.orderBy("date", "id").select("text").write.mode("overwrite").text(path)


#: The first line of folders that ``publish`` writes; others are not overwritten.
SENTINEL = "; written by tallyspark, changes by hand are lost"


class _Folder:
    """Renames and deletions below a journal's folder, on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self.of = path.rstrip("/"), spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.of(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def has(self, name: str) -> bool:
        return self.fs.exists(self.of(f"{self.path}/{name}"))

    def delete(self, name: str) -> None:
        self.fs.delete(self.of(f"{self.path}/{name}"), True)

    def rename(self, old: str, new: str) -> None:
        if not self.fs.rename(self.of(f"{self.path}/{old}"), self.of(f"{self.path}/{new}")):
            raise OSError(f"{self.path}/{old} can't be renamed to {new}")


def recover(spark: SparkSession, path: str) -> None:
    """Ends what a failed ``publish`` began: a journal that was complete is put in its place, one that wasn't is removed."""
    f = _Folder(spark, path)
    if f.has("ready"):
        for name in ("entries", "about"):
            if f.has(f"ready/{name}"):
                f.delete(name)
                f.rename(f"ready/{name}", name)
        f.delete("ready")
    if f.has("next"):
        f.delete("next")


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a published journal, that of the last ``publish`` that came as far as a complete new one."""
    return spark.read.text(f"{path}/ready/entries" if _Folder(spark, path).has("ready/entries") else f"{path}/entries")


def publish(texts: DataFrame, path: str) -> str:
    """``write_journal`` behind the sentinel, and what was done: unchanged where the folder's digest is the new one's, refused
    where a folder is there without the sentinel, else written.

    The new journal and its digest are written aside; one rename of that folder makes them the journal, and only then does the old
    one go.  A failure at any step leaves the old or the new journal whole, which ``recover`` (called first) puts in place."""
    spark = texts.sparkSession
    f = _Folder(spark, path)
    told = f"{SENTINEL} {' '.join(str(x) for x in digest(texts).first())}"
    if f.has("about") or f.has("ready/about"):
        about = f"{path}/ready/about" if f.has("ready/about") else f"{path}/about"
        old = [r["value"] for r in spark.read.text(about).limit(1).collect()]
        if not old or not old[0].startswith(SENTINEL):
            return "refused"
        recover(spark, path)
        if old[0] == told:
            return "unchanged"
    elif f.has("entries"):
        return "refused"
    f.delete("next")
    write_journal(texts, f"{path}/next/entries")
    spark.createDataFrame([(told,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/next/about")
    f.rename("next", "ready")  # the commit
    recover(spark, path)
    return "written"


def day_hashes(texts: DataFrame) -> DataFrame:
    """(date, entries, digest) of each day, whatever its size: the exact sum of its entries' hashes.  The sum over the days is the
    journal's ``digest``."""
    return texts.groupBy("date").agg(F.count(F.lit(1)).alias("entries"), F.sum(F.xxhash64("date", "id", "text").cast("decimal(20,0)")).alias("digest"))


def changed_days(old: DataFrame, new: DataFrame) -> DataFrame:
    """(date, change) of the days that differ between two journals' ``day_hashes``: added, removed or changed."""
    o = old.select(F.col("date").alias("_d"), F.struct("entries", "digest").alias("_o"))
    j = new.select("date", F.struct("entries", "digest").alias("_n")).join(o, F.col("date").eqNullSafe(F.col("_d")), "full_outer").where(~F.col("_n").eqNullSafe(F.col("_o")))
    return j.select(F.coalesce("date", "_d").alias("date"), F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").otherwise("changed").alias("change"))


def digest(texts: DataFrame) -> DataFrame:
    """One row that changes when any entry does, whatever the order: entries and the exact sum of their hashes."""
    return texts.agg(F.count(F.lit(1)).alias("entries"), F.sum(F.xxhash64("date", "id", "text").cast("decimal(20,0)")).alias("digest"))
