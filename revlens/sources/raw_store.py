"""Raw tables: CSV batches in, Parquet by ``batch_date`` out, published once audited."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace
from datetime import date

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from revlens.sources.day_table import DayTable, Staged
from revlens.sources.files import COMPRESSION, data_files, exists, is_complete
from revlens.sources.schemas import DAILY_TABLES, RAW_TABLES, raw_schema

# How batches are written and read: quotes are doubled inside quoted text, which may
# hold commas and line breaks; blanks at the ends of a value belong to it. A file whose
# values hold line breaks is read by one task, so large ones come as folders of parts.
CSV = {"header": True, "quote": '"', "escape": '"', "multiLine": True,
       "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


LOADS_AT_ONCE = 4
PART_ROWS = 500_000
# A load takes up its files in slices, so that only a slice's rows are shuffled at once: of so many
# bytes at least, and of no less than this share of all, so that a day has few files.
SLICE_BYTES, SLICES = 512 << 20, 16
_BROKEN = "_broken_record"
_MALFORMED, _STRAY = "malformed record", "date of another batch"
_REJECT = "load string, file string, reason string, record string"


class BatchError(ValueError):
    """A batch that does not fit its table: columns, values or dates."""


def write_raw_csv(rows: DataFrame, path: str) -> None:
    """A folder of compressed parts. One task reads such a part, so each holds few rows."""
    rows.write.options(**CSV, compression="gzip", maxRecordsPerFile=PART_ROWS).csv(path)


def spans_lines(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether a quoted value may run over a line end: then some line has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def _header(spark: SparkSession, path: str, table: str) -> list[str] | None:
    """The columns of a raw CSV file or folder; None when it is absent or has no header."""
    if not exists(spark, path):
        return None
    try:
        names = spark.read.options(**CSV).csv(path).columns
    except AnalysisException as error:
        if error.getCondition() == "UNABLE_TO_INFER_SCHEMA":  # a folder without files
            return None
        raise
    if not names:
        return None
    wanted = raw_schema(table).names
    missing, unknown = sorted(set(wanted) - set(names)), sorted(set(names) - set(wanted))
    if missing or unknown:
        raise BatchError(f"{path}: columns missing {missing}, unknown {unknown}")
    return names


def _text(spark: SparkSession, path: str | list[str], table: str, names: list[str], broken: bool) -> DataFrame:
    wanted = raw_schema(table).names
    text = T.StructType([T.StructField(n, T.StringType()) for n in [*names, *([_BROKEN] if broken else [])]])
    # Only a file whose values run over line ends has to be read by one task.
    options = {**CSV, "multiLine": spans_lines(spark, path)}
    rows = spark.read.schema(text).options(**options, enforceSchema=False, columnNameOfCorruptRecord=_BROKEN).csv(path)
    return rows.select(*wanted, *([_BROKEN] if broken else []))


def read_text_csv(spark: SparkSession, path: str, table: str, broken: bool = False) -> DataFrame | None:
    """A raw CSV file (or folder of parts) as text, columns by the names in its header.

    None when it is absent or has no header. Unknown and missing columns are errors,
    and so are parts whose header differs from the first one's. With ``broken`` a further
    column holds the records that have too few or too many values.
    """
    names = _header(spark, path, table)
    return None if names is None else _text(spark, path, table, names, broken)


def read_text_slices(spark: SparkSession, path: str, table: str) -> list[DataFrame]:
    """As ``read_text_csv`` with broken records, each file of a folder in one of a few slices; none when it is absent."""
    names = _header(spark, path, table)
    if names is None:
        return []
    found = data_files(spark, path)
    most = max(SLICE_BYTES, sum(size for _, size in found) // SLICES)
    slices: list[list[str]] = []
    room = 0
    for file, size in found:
        if not slices or size > room:
            slices.append([])
            room = most
        slices[-1].append(file)
        room -= size
    return [_text(spark, files, table, names, broken=True) for files in (slices if len(slices) > 1 else [path])]


def converted(text: DataFrame, table: str) -> DataFrame:
    """Text columns as the table's types; a value that does not parse becomes NULL."""
    return text.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in raw_schema(table)])


def _typed(table: str) -> list[T.StructField]:
    return [f for f in raw_schema(table) if not isinstance(f.dataType, T.StringType)]


def _problem_names(table: str) -> list[str]:
    return [_MALFORMED, _STRAY, *[f.name for f in _typed(table)]]


def _problems(table: str, batch_date: date | None) -> Column:
    """What keeps a row of text out of the table: the columns whose value is there but does not parse,
    another date than the batch's, a malformed record."""
    unreadable = [F.when((F.trim(f.name) != "") & F.col(f.name).try_cast(f.dataType).isNull(), f.name)
                  for f in _typed(table)]
    malformed = F.when(F.col(_BROKEN).isNotNull(), _MALFORMED)
    if batch_date is not None:
        own = F.col("batch_date").try_cast("date").eqNullSafe(F.lit(batch_date))
        unreadable.append(F.when(~own, _STRAY))
    return F.array_compact(F.array(malformed, *unreadable))


def read_raw_csv(spark: SparkSession, path: str, table: str) -> DataFrame | None:
    """One raw CSV file (or folder of parts) with header; None when it is absent.

    Columns are read as text and converted by name, so the file is never scanned
    to guess types and a value that does not parse becomes NULL. Loads into a store
    count the rows with such values and set them aside or stop.
    """
    text = read_text_csv(spark, path, table)
    return None if text is None else converted(text, table)


class RawStore:
    """The six raw tables below one folder.

    Every load is staged, audited and only then published (``DayTable``): one that fails
    leaves all tables as they were. Rows that cannot be taken in - malformed records, values
    that do not parse, another date than the batch's - go to the table's rejects with reason
    and record. A load whose share of them is above ``max_reject_share`` stops; by default
    a single one stops it.
    """

    def __init__(self, spark: SparkSession, root: str, max_reject_share: float = 0.0):
        self.spark, self.root, self.max_reject_share = spark, root.rstrip("/"), max_reject_share

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def table(self, table: str) -> DayTable:
        return DayTable(self.spark, self.path(table), "batch_date")

    def read(self, table: str) -> DataFrame:
        stored = self.table(table)
        return stored.read() if stored.exists() else self.spark.createDataFrame([], raw_schema(table))

    def read_all(self) -> dict[str, DataFrame]:
        return {t: self.read(t) for t in RAW_TABLES}

    def keys(self, table: str, *columns: str) -> DataFrame:
        """Only the key columns of the current state, to link a new batch to."""
        return self.read(table).select(*columns)

    def rejects(self, table: str) -> DataFrame:
        """What loads did not take in, of stopped loads as well: load, file, reason, record."""
        path = f"{self.path(table)}_rejects"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], _REJECT)
        return self.spark.read.schema(_REJECT).parquet(path)

    def append(self, table: str, rows: DataFrame) -> None:
        stored = self.table(table)
        stored.publish_more(stored.stage(rows))

    def replace(self, table: str, rows: DataFrame) -> None:
        """All rows anew."""
        stored = self.table(table)
        stored.publish_all(stored.stage(rows))

    def replace_all(self, tables: Mapping[str, DataFrame]) -> None:
        """Several tables anew: staged by concurrent jobs, published when the last is written."""
        with ThreadPoolExecutor(LOADS_AT_ONCE) as pool:
            runs = {t: pool.submit(self.table(t).stage, rows) for t, rows in tables.items()}
        for table, run in runs.items():
            if any(r.exception() for r in runs.values()) and not run.exception():
                self.table(table).discard(run.result())
        staged = {t: run.result() for t, run in runs.items()}  # raises what a job has raised
        for table, rows in staged.items():
            self.table(table).publish_all(rows)

    def replace_batch(self, table: str, rows: DataFrame, batch_date: date) -> None:
        """Swap the rows of one batch date for those of ``rows``, none included.

        Rows stamped with another date (or none) are an error: appending them would
        add them again on every rerun.
        """
        seen, stored = Observation(), self.table(table)
        stray = F.count_if(~F.col("batch_date").eqNullSafe(F.lit(batch_date))).alias("stray")
        staged = stored.stage(rows.observe(seen, stray))
        if staged.days and seen.get["stray"]:
            stored.discard(staged)
            raise BatchError(f"{table}: rows of another date than {batch_date} in its batch")
        stored.publish_days(staged, [batch_date])

    def _stage_text(self, table: str, slices: list[DataFrame], batch_date: date | None) -> Staged:
        """Stage the rows of a file that can be taken in, one slice after the other; the audit of all slices
        stops the load or sets the others aside."""
        stored, found, parts, broken = self.table(table), Counter(), [], []
        counts = [F.count(F.lit(1)).alias("rows"), F.count_if(F.size("_problems") > 0).alias("bad"),
                  *[F.count_if(F.array_contains("_problems", p)).alias(p) for p in _problem_names(table)]]
        try:
            for text in slices:
                seen, marked = Observation(), text.withColumn("_problems", _problems(table, batch_date))
                good = converted(marked.observe(seen, *counts).where(F.size("_problems") == 0), table)
                parts.append(stored.stage(good))
                # Spark may skip an observation where nothing was left to write.
                here = seen.get if parts[-1].days else marked.agg(*counts).first().asDict()
                found.update(here)
                broken += [marked] if here["bad"] else []
            for marked in broken:
                self._set_aside(table, marked, parts[0].load)
        except BaseException:
            for part in parts:
                stored.discard(part)
            raise
        staged = replace(parts[0], also=tuple(parts[1:]))
        if found["bad"] and found["bad"] > self.max_reject_share * found["rows"]:
            stored.discard(staged)
            why = {p: found[p] for p in _problem_names(table) if found[p]}
            stray = f"rows of another date than {batch_date} in its batch; " if why.get(_STRAY) else ""
            raise BatchError(f"{table}: {stray}{found['bad']} of {found['rows']} rows cannot be taken in, by column {why}; "
                             "load a mended batch")
        return staged

    def _set_aside(self, table: str, marked: DataFrame, load: str) -> None:
        columns = [F.coalesce(F.col(c), F.lit("")) for c in raw_schema(table).names]
        record = F.coalesce(F.col(_BROKEN), F.to_csv(F.struct(*columns)))
        marked.where(F.size("_problems") > 0).select(
            F.lit(load).alias("load"), F.col("_metadata.file_path").alias("file"),
            F.array_join("_problems", ", ").alias("reason"), record.alias("record"),
        ).write.mode("append").parquet(f"{self.path(table)}_rejects", compression=COMPRESSION)

    def _load(self, texts: dict[str, list[DataFrame]], publish: Callable[[DayTable, Staged], None],
              batch_date: date | None = None) -> list[str]:
        """Stage and audit all tables at once, and publish when the last has passed."""
        with ThreadPoolExecutor(LOADS_AT_ONCE) as pool:
            runs = {t: pool.submit(self._stage_text, t, text, batch_date) for t, text in texts.items()}
        failed = [run.exception() for run in runs.values() if run.exception()]
        for table, run in runs.items():
            if not failed:
                publish(self.table(table), run.result())
            elif not run.exception():
                self.table(table).discard(run.result())
        if failed:
            raise failed[0]
        return list(texts)

    def load_backfill(self, folder: str) -> list[str]:
        """Load ``raw_<table>.csv`` of every table; a missing or empty file is
        skipped. The table is replaced, so a repeated backfill adds nothing."""
        texts = {t: read_text_slices(self.spark, f"{folder}/{t}.csv", t) for t in RAW_TABLES}
        texts = {t: slices for t, slices in texts.items() if any(not text.isEmpty() for text in slices)}
        return self._load(texts, lambda stored, staged: stored.publish_all(staged))

    def load_daily(self, folder: str, batch_date: date) -> list[str]:
        """Load one day's files again and again with the same outcome. A file
        with only a header empties the batch, a missing file changes nothing."""
        texts = {t: read_text_slices(self.spark, f"{folder}/{t}.csv", t) for t in DAILY_TABLES}
        texts = {t: slices for t, slices in texts.items() if slices}
        return self._load(texts, lambda stored, staged: stored.publish_days(staged, [batch_date]), batch_date)


def write_batch_once(rows: DataFrame, path: str) -> None:
    """Write a batch unless a complete one is there; a rerun keeps the first version.

    What a dead job left behind has no commit marker and is overwritten.
    """
    if not is_complete(rows.sparkSession, path):
        rows.write.mode("overwrite").options(**CSV).csv(path)
