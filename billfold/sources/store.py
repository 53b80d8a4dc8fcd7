"""The tables of a billing store: parquet folders by batch, made visible by the commit log."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from billfold.operators.cleaning import CLEANED_SCHEMA
from billfold.operators.fields import INVOICE_SCHEMA, ROW_SCHEMA
from billfold.operators.merge import evolve_schema, new_rows
from billfold.operators.reconcile import nest_by_invoice
from billfold.sources.commits import Change, CommitLog, State
from billfold.sources.text_files import mounted_folder, read_text_files, write_text_files

KEYS = {
    "invoices": ["file_hash"],
    "rows": ["invoice_number", "file_name", "row_number"],
    "failures": ["file", "error"],
}
TABLES = {
    "invoices": INVOICE_SCHEMA,
    "rows": ROW_SCHEMA,
    "failures": "file string, error string",
    "cleaned": CLEANED_SCHEMA,
    "items": CLEANED_SCHEMA,
    "totals": "invoice_number string, type string, raw string, parsed_amount double, "
    "file_name string, row_number int",
    "verification": "invoice_number string, items_sum double, parsed_subtotal double, parsed_tax double, "
    "parsed_total double, difference_items_vs_subtotal double, mismatch_flag boolean",
    "reconciled": "done boolean",
}
_FIRST_BATCH = "none"
_VERSION = "version-"
VERIFICATION_BUCKETS = 32
_CODEC = "zstd"  # takes about two thirds of the room of Spark's default
_DROPS_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_folder(spark: SparkSession) -> str:
    """A fresh folder for intermediate tables that every executor can reach.

    Taken below ``spark.checkpoint.dir``, the shared folder of the cluster, which must be set.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/billfold-{uuid.uuid4().hex}"
    raise ValueError("set spark.checkpoint.dir to a folder all executors share")


@contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a write inside go once it is done, not when the driver collects garbage next."""
    before = spark.conf.get(_DROPS_SHUFFLES, None)
    spark.conf.set(_DROPS_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(_DROPS_SHUFFLES) if before is None else spark.conf.set(_DROPS_SHUFFLES, before)


def write_parquet(df: DataFrame, path: str, mode: str = "error", partition_by: Sequence[str] = ()) -> None:
    with dropped_shuffles(df.sparkSession):
        df.write.mode(mode).option("compression", _CODEC).parquet(path, partitionBy=list(partition_by) or None)


class BillingStore:
    """Named tables under one folder.

    A table is made of batches; a batch that is written again replaces itself. What belongs together is
    written in one ``transaction`` and becomes visible at once, or not at all. Folders of
    older stores and of other writers, ``<table>/batch=<name>``, are read as they lie, with
    the columns they have.
    """

    def __init__(self, spark: SparkSession, root: str, verification_buckets: int = VERIFICATION_BUCKETS):
        self.spark = spark
        self.root = root.rstrip("/")
        self.staged: list[str] = []
        self.log = CommitLog(spark, self.root)
        self._buckets = verification_buckets

    def path(self, name: str, batch: str | None = None) -> str:
        return f"{self.root}/{name}" + (f"/batch={batch}" if batch else "")

    def ensure(self, *names: str) -> None:
        """Creates the tables that do not exist yet, empty and typed."""
        for name in names:
            empty = self.spark.createDataFrame([], TABLES[name])
            empty.write.mode("ignore").parquet(self.path(name, _FIRST_BATCH))

    def read(self, name: str, without_batch: str | None = None) -> DataFrame:
        """A table, the newest version of a replaced one; columns that older files lack are null.

        Leaves out one batch if named.
        """
        return self._read(self.log.state(), name, lambda batch: batch != without_batch).drop("batch")

    def read_batches(self, name: str, batches: Iterable[str]) -> DataFrame:
        """Some batches of a table, with the column ``batch``; only their folders are read."""
        return self._read(self.log.state(), name, set(batches).__contains__)

    def _read(self, state: State, name: str, wanted: Callable[[str], bool]) -> DataFrame:
        """The wanted batches of a version of the store, with the column ``batch``."""
        parts = state.parts(name)
        folders = [f"{self.root}/{p.folder}" for b, p in parts.items() if p.folder and wanted(b)]
        unlogged = self._unlogged(name)
        if versions := self._versions(name):
            unlogged = {b: f for b, f in unlogged.items() if b == versions[-1]}
        beside = [f for b, f in unlogged.items() if b not in parts and wanted(b)]
        schema = self._schema(state, name, beside)
        frames = []
        for paths, inner in ((folders, "commit string, batch string"), (beside, "batch string")):
            if paths:
                reader = self.spark.read.option("basePath", self.path(name)).schema(f"{schema}, {inner}")
                frames.append(reader.parquet(*paths).drop("commit"))
        if frames:
            return reduce(DataFrame.unionByName, frames)
        typed = T.StructType.fromDDL(f"{schema}, batch string")
        none = (F.lit(None).cast(f.dataType).alias(f.name) for f in typed.fields)
        return self.spark.range(1).select(*none).where(F.lit(False))  # the optimizer knows that it is empty

    def _schema(self, state: State, name: str, beside: Iterable[str] = ()) -> str:
        """The fixed columns, those added later, and those only folders outside the log have."""
        added = dict(state.columns.get(name, {}))
        known = {c.split(" ")[0].lower() for c in TABLES[name].split(", ")} | {c.lower() for c in added} | {"batch"}
        if beside := list(beside):
            found = self.spark.read.option("basePath", self.path(name)).option("mergeSchema", True).parquet(*beside)
            added |= {f.name: f.dataType.simpleString() for f in found.schema.fields if f.name.lower() not in known}
        return ", ".join([TABLES[name], *(f"`{c}` {t}" for c, t in added.items())])

    def _paths(self, pattern: str) -> list:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(pattern)
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(path)
        return [f.getPath() for f in found or ()]

    def _unlogged(self, name: str) -> dict[str, str]:
        """Folders by batch that lie beside those of the log."""
        found = {p.getName().removeprefix("batch="): p.toString() for p in self._paths(f"{self.path(name)}/batch=*")}
        return {b: f for b, f in found.items() if b != _FIRST_BATCH}

    def batches(self, name: str) -> set[str]:
        """The batches of a table, also those that have no rows; none if there is no table."""
        return set(self.versions_of_batches(name))

    def versions_of_batches(self, name: str) -> dict[str, int]:
        """The version of the store that each batch of a table is of, -1 for those outside the log."""
        logged = {b: p.version for b, p in self.log.state().parts(name).items()}
        return dict.fromkeys(self._unlogged(name), -1) | logged

    def _versions(self, name: str) -> list[str]:
        """The versions of a replaced table that were written to their end, oldest first."""
        done = self._paths(f"{self.path(name)}/batch={_VERSION}*/_SUCCESS")
        return sorted(p.getParent().getName().removeprefix("batch=") for p in done)

    def transaction(self) -> Transaction:
        """Changes that become visible together: ``with store.transaction() as changes: ...``."""
        return Transaction(self)

    def write(self, name: str, df: DataFrame, batch: str) -> None:
        """Replaces one batch of a table."""
        with self.transaction() as changes:
            changes.write(name, df, batch)

    def add_columns(self, name: str, ddl: str) -> None:
        """Adds columns to a table for good; rows stored before have nulls there. Ones it has stay as they are."""
        state = self.log.state()
        have = {f.name.lower() for f in T.StructType.fromDDL(self._schema(state, name)).fields}
        new = {f.name: f.dataType.simpleString() for f in T.StructType.fromDDL(ddl).fields if f.name.lower() not in have}
        if new:
            self.log.commit(state, Change(columns={name: new}))

    def verification_buckets(self, state: State) -> int:
        """The number of buckets is that of the first run of a store."""
        return state.settings.get("verification_buckets", self._buckets)

    def replace(self, name: str, df: DataFrame) -> None:
        """Replaces a whole table; an empty frame leaves an empty, typed table.

        The rows go into a folder of their own, which counts once it is complete; until then,
        and if the job dies, readers get the version before. That one stays for those who
        have begun to read it, older ones are deleted.
        """
        there = self._versions(name)
        number = int(there[-1].removeprefix(_VERSION)) + 1 if there else 0
        typed = evolve_schema(df, TABLES[name]).select(*T.StructType.fromDDL(TABLES[name]).names)
        write_parquet(typed, self.path(name, f"{_VERSION}{number:012d}"), "overwrite")
        for old in there[:-1]:
            self.log.delete(self.path(name, old))

    def stage(self, df: DataFrame, name: str = "staging") -> DataFrame:
        """Writes an intermediate frame and reads it back: computed once, lineage cut."""
        path = f"{self.path(name)}/{uuid.uuid4().hex}"
        write_parquet(df, path)
        self.staged.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop_staged(self, name: str | None = None) -> None:
        """Deletes what this object has staged (under that name), when nothing reads it any more."""
        gone = [p for p in self.staged if name is None or p.startswith(f"{self.path(name)}/")]
        self.staged = [p for p in self.staged if p not in gone]
        for path in gone:
            self.log.delete(path)


class Transaction:
    """Reads one version of a store with its own changes on top, and commits these as the next one.

    Data are written as they come, into folders that nobody reads. Leaving the block commits;
    an exception in it leaves the store as it was. A commit fails with ``Conflict`` if a table that was read
    whole, or a batch that is replaced, has changed in the meantime.
    """

    def __init__(self, store: BillingStore):
        self.store = store
        self.state = store.log.state()
        self.change = Change()
        self._read: set[str | tuple[str, str]] = set()
        self._folder = f"commit={uuid.uuid4().hex}"

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is not None:
            self.discard()
            return
        try:
            self.commit()
        except Exception:
            self.discard()
            raise

    def commit(self) -> State:
        return self.store.log.commit(self.state, self.change, self._read)

    def discard(self) -> None:
        """Deletes what was written; a run that dies leaves it, unread."""
        for table in self.change.folders:
            self.store.log.delete(f"{self.store.path(table)}/{self._folder}")

    def _now(self) -> State:
        return self.state.after(self.change, self.state.version)

    def read(self, name: str, without_batch: str | None = None) -> DataFrame:
        self._read.add(name)
        return self.store._read(self._now(), name, lambda batch: batch != without_batch).drop("batch")

    def read_batches(self, name: str, batches: Iterable[str], before: bool = False) -> DataFrame:
        """Some batches with the column ``batch``; ``before``: as they were when the transaction began."""
        batches = set(batches)
        self._read.update((name, b) for b in batches)
        return self.store._read(self.state if before else self._now(), name, batches.__contains__)

    def write(self, name: str, df: DataFrame, batch: str) -> None:
        """Replaces one batch of a table; columns that the table lacks are left out."""
        folder = f"{name}/{self._folder}/batch={batch}"
        write_parquet(self._typed(name, df), f"{self.store.root}/{folder}", "overwrite")
        self.change.folders.setdefault(name, {})[batch] = folder

    def write_batches(self, name: str, df: DataFrame, batches: Iterable[str]) -> None:
        """Replaces these batches of a table by what ``df``, with a column ``batch``, has of each: maybe nothing."""
        top = f"{name}/{self._folder}"
        typed = self._typed(name, df, "batch")
        write_parquet(typed, f"{self.store.root}/{top}", "append", ["batch"])
        written = {p.getName().removeprefix("batch=") for p in self.store._paths(f"{self.store.root}/{top}/batch=*")}
        of = self.change.folders.setdefault(name, {})
        of.update({b: f"{top}/batch={b}" if b in written else None for b in batches})

    def add_ignore(self, name: str, df: DataFrame, batch: str) -> None:
        """Insert-or-ignore of one batch, keyed like the table; the first file path wins.

        No key column is null: a document without a hash is a failure before it is extracted.
        """
        stored = self.read(name, without_batch=batch)
        order = ["file_path"] if "file_path" in df.columns else KEYS[name]
        self.write(name, new_rows(stored, df, KEYS[name], order, null_keys=False, stage=self.store.stage), batch)

    def set(self, **settings: int) -> None:
        self.change.settings.update(settings)

    def _typed(self, name: str, df: DataFrame, *more: str) -> DataFrame:
        schema = T.StructType.fromDDL(self.store._schema(self._now(), name))
        return evolve_schema(df, schema).select(*schema.names, *more)


def export_tables(tables: Mapping[str, DataFrame], path: str, file_format: str = "parquet") -> None:
    """One folder per table, as parquet, csv or json; array columns go into csv as JSON.

    Tables with an invoice number are sorted by it over all their files, then by file and row.
    """
    for name, df in tables.items():
        order = [c for c in ("invoice_number", "file_name", "row_number") if c in df.columns]
        if file_format == "csv":  # before the sort: as text they are shorter in its shuffle
            df = df.select(
                *(
                    F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "struct") else f.name
                    for f in df.schema.fields
                )
            )
        df = df.orderBy(*order) if order else df
        options = {"csv": {"header": True, "escape": '"'}, "json": {"ignoreNullFields": False}}
        writer = df.write.mode("overwrite").options(**options.get(file_format, {}))
        with dropped_shuffles(df.sparkSession):
            writer.format(file_format).save(f"{path.rstrip('/')}/{name}")


def export_json(items: DataFrame, totals: DataFrame, verification: DataFrame, path: str) -> None:
    """The flat tables and the nested form per invoice and file, one JSON object per line."""
    export_tables(
        {
            "items": items,
            "totals": totals,
            "verification": verification,
            "by_invoice": nest_by_invoice(items, totals, verification),
        },
        path,
        "json",
    )


def dump_text(texts: DataFrame, path: str, batch: str) -> None:
    """The raw texts of a batch with their file stems (a debugging aid); other batches stay as they are."""
    texts.select("file_stem", "text").write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def export_texts(texts: DataFrame, path: str) -> None:
    """Each raw text as a file of its own, in a folder of its stem: ``file_stem=<stem>/part-...txt``.

    Texts that share a stem are files of one folder. Every file ends in one line end more than its
    text has; ``read_texts`` takes it off. In a folder of a file system that is mounted, where Hadoop starts a
    process to set the mode of every file and folder it makes, tasks write the files themselves.
    """
    columns = texts.select("file_stem", F.coalesce("text", F.lit("")).alias("value"))
    folder = mounted_folder(texts.sparkSession, path)
    if folder is None:
        columns.write.mode("overwrite").option("maxRecordsPerFile", 1).partitionBy("file_stem").text(path)
    else:
        write_text_files(columns, folder)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``(file_stem, text)`` of exported texts."""
    folder = mounted_folder(spark, path)
    if folder is None or not os.path.isdir(folder):
        found = spark.read.schema("value string, file_stem string").text(path, wholetext=True)
    else:
        found = read_text_files(spark, folder)
    return found.select("file_stem", F.regexp_replace("value", r"\n\z", "").alias("text"))
