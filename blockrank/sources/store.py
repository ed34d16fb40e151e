"""The index on disk, as a log of segments, and the job log.

A commit writes one segment: the rows of the notes that it adds or changes, and marks (tombstones) of the notes
whose older rows no longer count. So an update costs what it changes. Rows lie in folders by a hash of their note
(vectors: by the cell of their nearest centre), so that reads of one note, or of some cells, skip the rest. A
segment also holds what it moves in the counts of terms; counts of blocks and words are in the manifest.
Small segments are merged so that each one is at least RATIO times all newer ones together: there are never more
than about log2(rows) of them, and a row is rewritten as often at most.

The file `CURRENT` is the manifest: which segments are live. One atomic rename replaces it. Readers of an old state
are not disturbed, and a job that fails leaves the live state as it was; what it wrote, and segments that were
merged, are taken away by `vacuum`."""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterable
from functools import reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import porter
from ..functions.text import embedding_input
from ..operators import ann, lexical

TABLES = ("notes", "blocks", "links", "vectors", "postings")
#: The column of each table that names its note.
NOTE = {"notes": "path", "blocks": "note_path", "vectors": "note_path", "postings": "note_path", "links": "src_note_path"}
#: Folders by note hash: one for each NOTES_A_BUCKET notes of the first segment, within these bounds.
NOTES_A_BUCKET, BUCKETS = 2000, (16, 4096)
RATIO = 2
#: Values of a folder name that are listed in a filter at most; beyond that all folders are read.
LISTED = 1024


def file_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """old, new (path, content_hash) -> path, change: added, modified or deleted."""
    a, b = old.select("path", F.col("content_hash").alias("was")), new.select("path", F.col("content_hash").alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "modified")
    return a.join(b, "path", "full_outer").select("path", change.alias("change")).filter("change is not null")


def delete_notes(tables: dict[str, DataFrame], paths: DataFrame) -> dict[str, DataFrame]:
    """Cascade: notes, blocks, vectors and postings of the paths, and links from or to them."""
    gone = paths.select("path").distinct()
    without = lambda df, c: df.join(gone.withColumnRenamed("path", c), c, "left_anti")
    out = dict(tables)
    for name, column in (*NOTE.items(), ("links", "dst_note_path")):
        if name in out:
            out[name] = without(out[name], column)
    return out


def job_latest(log: DataFrame) -> DataFrame:
    """log(id, seq, status, detail): the last state of each job."""
    return log.groupBy("id").agg(F.max_by(F.struct("status", "detail"), "seq").alias("s"), F.count(F.lit(1)).alias("events")).select("id", "s.status", "s.detail", "events")


def index_status(notes: DataFrame, blocks: DataFrame, links: DataFrame, log: DataFrame) -> DataFrame:
    """One row: counts of the tables, and the last job."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    last = job_latest(log).agg(F.max("id").alias("last_job"), F.max_by("status", "id").alias("last_status"))
    return count(notes, "notes").crossJoin(count(blocks, "blocks")).crossJoin(count(links, "links")).crossJoin(last)


def blocks_by_note(blocks: DataFrame) -> DataFrame:
    """Blocks with their place in the note, by char_start."""
    return blocks.withColumn("place", F.row_number().over(W.partitionBy("note_path").orderBy("char_start", "block_uid")))


class Store:
    """The index under a folder that Spark can write; one writer at a time (a second one's commit fails)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    # the manifest

    def manifest(self) -> dict:
        """The live state; {} before the first commit."""
        if not self._fs().exists(self._path("CURRENT")):
            return {}
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.root}/CURRENT", wholetext=True).collect()))

    def version(self) -> int:
        return self.manifest().get("version", 0)

    def _publish(self, manifest: dict) -> int:
        if self.version() != manifest["version"] - 1:
            raise RuntimeError("another job has written this store meanwhile")
        fs, temp = self._fs(), self._path(f"NEXT-{uuid.uuid4().hex}")
        out = fs.create(temp, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        options = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        overwrite = self.spark.sparkContext._gateway.new_array(options, 1)
        overwrite[0] = options.OVERWRITE
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), fs.getConf())
        context.rename(fs.makeQualified(temp), fs.makeQualified(self._path("CURRENT")), overwrite)
        return manifest["version"]

    # reading

    def _marks(self, segments: list[dict]) -> DataFrame | None:
        """path, since (older rows of the note are gone), gone (older links to it, too); None without any."""
        parts = [self._segment(s, "marks").withColumn("seq", F.lit(s["seq"])) for s in segments if s["marks"]]
        if not parts:
            return None
        return reduce(DataFrame.unionByName, parts).groupBy("path").agg(F.max("seq").alias("since"), F.max(F.when(F.col("deleted"), F.col("seq"))).alias("gone"))

    def _segment(self, segment: dict, table: str) -> DataFrame:
        return self.spark.read.schema(T.StructType.fromJson(segment["schemas"][table])).parquet(f"{self.root}/{segment['folder']}/{table}")

    def _live(self, manifest: dict, table: str, segments: list[dict] | None = None, folders: Iterable[int] | None = None) -> DataFrame:
        """Live rows of a table, with their folder, of some segments, or some folders, only."""
        every = manifest["segments"]
        own = every if segments is None else segments
        part = "cell" if table == "vectors" else "bucket"
        rows = reduce(DataFrame.unionByName, [self._segment(s, table).withColumn("seq", F.lit(s["seq"])) for s in own])
        if folders is not None:
            rows = rows.filter(F.col(part).isin(list(folders)))
        oldest = min(s["seq"] for s in own)
        marks = self._marks([s for s in every if s["seq"] > oldest])
        if marks is None:
            return rows.drop("seq")
        left = rows.join(marks.select(F.col("path").alias(NOTE[table]), "since"), (NOTE[table]), "left").filter(F.col("since").isNull() | (F.col("seq") >= F.col("since"))).drop("since")
        if table == "links":
            left = left.join(marks.filter("gone is not null").select(F.col("path").alias("dst_note_path"), "gone"), "dst_note_path", "left").filter(F.col("gone").isNull() | (F.col("seq") >= F.col("gone"))).drop("gone")
        return left.select(*[c for c in rows.columns if c != "seq"])

    def _read(self, table: str, paths: list[str] | None = None) -> DataFrame:
        manifest = self.manifest()
        buckets = None if paths is None else [_bucket_of(p, manifest["buckets"]) for p in paths]
        rows = self._live(manifest, table, folders=None if table == "vectors" else buckets)
        rows = rows if paths is None else rows.filter(F.col(NOTE[table]).isin(paths))
        return rows.drop("cell" if table == "vectors" else "bucket")

    def read(self) -> dict[str, DataFrame]:
        """All tables as they are now; {} before the first commit."""
        return {t: self._read(t) for t in TABLES} if self.manifest() else {}

    def embedded(self, paths: list[str] | DataFrame) -> DataFrame | None:
        """note_path, text (what was embedded), embedding of the blocks of these notes; None before the first commit."""
        if not self.manifest():
            return None
        if isinstance(paths, DataFrame):
            only = lambda df: df.join(paths.select(F.col("path").alias("note_path")).distinct(), "note_path", "left_semi")
            blocks, vectors = only(self._read("blocks")), only(self._read("vectors"))
        else:
            blocks, vectors = self._read("blocks", paths), self._read("vectors", paths)
        text = embedding_input(F.col("heading_path"), F.col("clean_text"))
        return blocks.select("block_uid", "note_path", text.alias("text")).join(vectors.select("block_uid", "embedding"), "block_uid").drop("block_uid")

    def terms(self) -> DataFrame:
        """term, df: the moves of all segments together; no posting is read."""
        parts = [self._segment(s, "terms") for s in self.manifest()["segments"] if s["terms"]]
        return reduce(DataFrame.unionByName, parts).groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")

    def totals(self) -> DataFrame:
        """One row: n blocks and their average length, from the manifest."""
        m = self.manifest()
        return self.spark.createDataFrame([(m["blocks"], m["words"] / m["blocks"] if m["blocks"] else None)], "n long, avgdl double")

    def index(self) -> lexical.LexicalIndex:
        """The lexical index as stored: nothing is tokenised or counted again."""
        tables = self.read()
        docs = tables["blocks"].select("block_uid", "note_path", "dl", "clean_text")
        return lexical.LexicalIndex(docs, self.totals(), None, self.terms(), tables["postings"].select("term", "block_uid", "tf", "positions"), porter.vocabulary)

    def cells(self) -> ann.CellIndex:
        """The vector index as stored: centres, and vectors in folders by cell."""
        manifest = self.manifest()
        centres = self._centres(manifest)
        return ann.stored(centres, self._live(manifest, "vectors").filter("cell >= 0").withColumnRenamed("cell", "row"), manifest["probes"])

    def _centres(self, manifest: dict) -> np.ndarray:
        if not manifest.get("centres"):
            return np.zeros((0, 1))
        rows = self.spark.read.parquet(f"{self.root}/{manifest['centres']}").orderBy("cell").collect()  # at most ann.MOST_CELLS rows
        return np.array([r.centre for r in rows], dtype=np.float64)

    # writing

    def _place(self, table: str, rows: DataFrame, manifest: dict, centres: np.ndarray) -> DataFrame:
        """Rows with their folder, dealt out by it; Spark splits folders of many rows."""
        if table == "vectors":
            placed = ann.place(rows, centres)
            return placed.hint("rebalance", "cell").sortWithinPartitions("cell", "note_path")
        placed = rows.withColumn("bucket", _bucket(F.col(NOTE[table]), manifest["buckets"]))
        by = ("bucket", "term") if table == "postings" else ("bucket", NOTE[table])  # so that a scan skips row groups
        return placed.hint("rebalance", "bucket").sortWithinPartitions(*by)

    def _write_segment(self, folder: str, manifest: dict, tables: dict[str, DataFrame], marks: DataFrame | None, terms: DataFrame | None, seq: int, placed: bool = False) -> dict:
        centres = self._centres(manifest)
        schemas = {}
        for name in TABLES:
            rows = tables[name] if placed else self._place(name, tables[name], manifest, centres)
            part = "cell" if name == "vectors" else "bucket"
            rows.write.partitionBy(part).parquet(f"{self.root}/{folder}/{name}")
            schemas[name] = T.StructType([*(f for f in rows.schema if f.name != part), rows.schema[part]]).jsonValue()
        for name, rows in (("marks", marks), ("terms", terms)):
            if rows is not None:
                rows.write.parquet(f"{self.root}/{folder}/{name}")
                schemas[name] = rows.schema.jsonValue()
        size = self._fs().getContentSummary(self._path(folder)).getLength()
        return {"folder": folder, "seq": seq, "bytes": size, "schemas": schemas, "marks": marks is not None, "terms": terms is not None}

    def write(self, tables: dict[str, DataFrame]) -> int:
        """All tables anew: one segment, with centres fitted to its vectors."""
        version = self.version() + 1
        low, high = BUCKETS
        notes = tables["notes"].count()
        manifest = {"version": version, "buckets": max(low, min(high, -(-notes // NOTES_A_BUCKET)))}
        # read for the centres and again for the segment, so embedded once
        tables = tables | {"vectors": tables["vectors"].persist(StorageLevel.MEMORY_AND_DISK)}
        try:
            return self._write_all(tables, manifest)
        finally:
            tables["vectors"].unpersist()

    def _write_all(self, tables: dict[str, DataFrame], manifest: dict) -> int:
        version = manifest["version"]
        centres, manifest["probes"] = ann.centres_of(tables["vectors"])
        if len(centres):
            manifest["centres"] = f"centres-{version:08d}-{uuid.uuid4().hex}"
            self.spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{self.root}/{manifest['centres']}")
        terms = tables["postings"].groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        folder = f"seg-{version:08d}-{uuid.uuid4().hex}"
        manifest["segments"] = [self._write_segment(folder, manifest, tables, None, terms, version)]
        # counted from what was written, so the tables are computed once
        return self._publish(manifest | _sizes(self._segment(manifest["segments"][0], "blocks")))

    def apply(self, fresh: dict[str, DataFrame], replaced: list[str] | DataFrame, deleted: list[str] | DataFrame = ()) -> int:
        """One commit: the notes of `replaced` lose their rows and get those of `fresh`; the notes of `deleted` lose
        theirs, and links to them. Both are paths, as a list (few notes: only their folders are read) or a table."""
        manifest = self.manifest()
        if not manifest:
            return self.write(fresh)
        version = manifest["version"] + 1
        paths = lambda x, flag: (x.select("path") if isinstance(x, DataFrame) else self.spark.createDataFrame([(p,) for p in x], "path string")).withColumn("deleted", F.lit(flag))
        marks = paths(replaced, False).unionByName(paths(deleted, True)).groupBy("path").agg(F.max("deleted").alias("deleted"))
        buckets = None
        if not isinstance(replaced, DataFrame) and not isinstance(deleted, DataFrame):
            found = {_bucket_of(p, manifest["buckets"]) for p in (*replaced, *deleted)}
            buckets = found if len(found) <= LISTED else None
        named = F.broadcast if buckets is not None else (lambda x: x)
        old = lambda t: self._live(manifest, t, folders=buckets).join(named(marks.select(F.col("path").alias(NOTE[t]))), NOTE[t], "left_semi")
        folder = f"seg-{version:08d}-{uuid.uuid4().hex}"
        moves = fresh["postings"].select("term", F.lit(1).cast("long").alias("df")).unionByName(old("postings").select("term", F.lit(-1).cast("long").alias("df")))
        segment = self._write_segment(folder, manifest, fresh, marks, moves.groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0"), version)
        came, went = _sizes(self._segment(segment, "blocks")), _sizes(old("blocks"))
        new = manifest | {"version": version, "segments": [*manifest["segments"], segment]} | {k: manifest[k] + came[k] - went[k] for k in came}
        return self._publish(self._merged(new))

    def _merged(self, manifest: dict) -> dict:
        """Merge the newest segments into one, from the oldest that is not RATIO times as large as all newer ones."""
        segments = manifest["segments"]
        newer = lambda i: sum(s["bytes"] for s in segments[i + 1 :])
        first = next((i for i in range(len(segments) - 1) if segments[i]["bytes"] < RATIO * newer(i)), None)
        return manifest if first is None else self._merge(manifest, first)

    def _merge(self, manifest: dict, first: int) -> dict:
        keep, old = manifest["segments"][:first], manifest["segments"][first:]
        rows = {}
        for t in TABLES:
            part, then = ("cell", "note_path") if t == "vectors" else ("bucket", "term" if t == "postings" else NOTE[t])
            rows[t] = self._live(manifest, t, old).hint("rebalance", part).sortWithinPartitions(part, then)
        marks = None
        if keep:
            parts = [self._segment(s, "marks") for s in old if s["marks"]]
            marks = reduce(DataFrame.unionByName, parts).groupBy("path").agg(F.max("deleted").alias("deleted")) if parts else None
        terms = reduce(DataFrame.unionByName, [self._segment(s, "terms") for s in old if s["terms"]]).groupBy("term").agg(F.sum("df").alias("df")).filter("df <> 0")
        folder = f"seg-{old[-1]['seq']:08d}-{uuid.uuid4().hex}"
        return manifest | {"segments": [*keep, self._write_segment(folder, manifest, rows, marks, terms, old[-1]["seq"], placed=True)]}

    def compact(self) -> int:
        """All segments into one."""
        manifest = self.manifest()
        return self._publish(self._merge(manifest, 0) | {"version": manifest["version"] + 1})

    def vacuum(self) -> list[str]:
        """Take away the segments that are not live, those of failed jobs included; not while others read them."""
        fs, manifest = self._fs(), self.manifest()
        live = {manifest.get("centres"), *(s["folder"] for s in manifest.get("segments", []))}
        names = [f.getPath().getName() for f in fs.listStatus(self._path(""))]
        gone = [n for n in names if n.startswith(("seg-", "centres-", "NEXT-")) and n not in live]
        for n in gone:
            fs.delete(self._path(n), True)
        return [n for n in gone if n.startswith("seg-")]

    # point reads: only the folder of the note is read

    def note(self, path: str) -> DataFrame:
        return self._read("notes", [path])

    def block(self, block_uid: str) -> DataFrame:
        return self._read("blocks").filter(F.col("block_uid") == block_uid)

    def blocks_of(self, path: str) -> DataFrame:
        return blocks_by_note(self._read("blocks", [path]))

    def links_from(self, path: str) -> DataFrame:
        return self._read("links", [path])

    def dashboard(self, vault_files: DataFrame | None = None) -> DataFrame:
        """One row: counts of the tables, the last job, the notes that changed last, and, given the vault's files
        (path), how many there are and how many of them are not indexed yet."""
        t = self.read()
        recent = t["notes"].orderBy(F.desc("mtime"), "path").limit(10).agg(F.collect_list("path").alias("recent"))
        out = index_status(t["notes"], t["blocks"], t["links"], self.jobs()).crossJoin(recent)
        if vault_files is None:
            return out
        known = t["notes"].select("path", F.lit(1).alias("known"))
        return out.crossJoin(vault_files.select("path").join(known, "path", "left").agg(F.count(F.lit(1)).alias("vault_files"), F.count(F.when(F.col("known").isNull(), 1)).alias("not_indexed")))

    def clear(self) -> dict[str, int]:
        """Empty all tables; the counts of what went. The job log stays."""
        old = self.read()
        counts = {t: df.count() for t, df in old.items()}
        if old:
            self.write({t: df.limit(0) for t, df in old.items()})
        return counts

    def log_job(self, job_id: int, seq: int, job_type: str, status: str, detail: str = "{}") -> None:
        row = [(job_id, seq, job_type, status, detail)]
        self.spark.createDataFrame(row, "id long, seq long, job_type string, status string, detail string").withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{self.root}/jobs")

    def jobs(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/jobs")


def _bucket(path, buckets: int):
    return F.pmod(F.crc32(path), F.lit(buckets)).cast("int")


def _bucket_of(path: str, buckets: int) -> int:
    return zlib.crc32(path.encode()) % buckets


def _sizes(blocks: DataFrame) -> dict[str, int]:
    r = blocks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("dl"), F.lit(0)).alias("dl")).first()
    return {"blocks": r.n, "words": r.dl}
