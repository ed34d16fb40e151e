"""Index jobs: rebuild, incremental sync, one file, deletion, and their log.

A note that cannot be read, or whose block ids repeat, does not stop a job: it is listed in the job's failures
(the first 20), and the job ends as `partial_success`, or as `failed` where nothing could be indexed."""

from __future__ import annotations

import json
import time

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .config import Settings, load
from .functions import porter
from .functions import text as T
from .operators.blocks import note_blocks
from .operators.links import extract_links
from .sources import store as S
from .sources import vault

FAILURES = 20


def _vectors(blocks: DataFrame, embed, old: DataFrame | None) -> DataFrame:
    """block_uid, note_path, embedding. Blocks that old(note_path, text, embedding) has in the same note with the
    same input, wherever they stood, keep their vector; only the others reach the embedder."""
    text = T.embedding_input(F.col("heading_path"), F.col("clean_text"))
    asked = blocks.select("block_uid", "note_path", text.alias("text"))
    # a blank input has no vector rather than another block's
    made = lambda rows: rows.select("block_uid", "note_path", F.when(F.trim("text") != "", embed(F.col("text"))).alias("embedding"))
    if old is None:
        return made(asked)
    known = old.filter("embedding is not null").groupBy("note_path", F.sha2("text", 256).alias("same")).agg(F.first("embedding").alias("embedding"))
    asked = asked.withColumn("same", F.sha2("text", 256))
    kept = asked.join(known, ["note_path", "same"]).select("block_uid", "note_path", "embedding")
    return kept.unionByName(made(asked.join(known, ["note_path", "same"], "left_anti")))


def index_tables(notes: DataFrame, cfg: Settings, embed=T.pseudo_embedding, old: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables of the given notes. embed: a column function of the embedding input (a pandas UDF fits too); old:
    what these notes' blocks were embedded from before, and their vectors. A note whose block ids repeat keeps the
    first of each."""
    blocks = note_blocks(notes, cfg.min_chars, cfg.max_chars)
    first = F.row_number().over(W.partitionBy("block_uid").orderBy("char_start", "ord"))
    words = F.regexp_extract_all("clean_text", F.lit(porter.WORD), F.lit(0))
    blocks = blocks.withColumn("nth", first).filter("nth = 1").drop("nth").withColumn("dl", F.size(words).cast("long"))
    vectors = _vectors(blocks, embed, old)
    flat = blocks.select("block_uid", "note_path", F.posexplode(words).alias("pos", "word")).groupBy("block_uid", "note_path", "word").agg(F.collect_list("pos").alias("at"))
    met = flat.join(porter.vocabulary(flat), "word").groupBy("term", "block_uid", "note_path").agg(F.array_sort(F.flatten(F.collect_list("at"))).alias("positions"))
    postings = met.select("term", "block_uid", "note_path", F.size("positions").cast("long").alias("tf"), "positions")
    return {"notes": notes, "blocks": blocks, "links": extract_links(notes).drop("kind", "no"), "vectors": vectors, "postings": postings}


def repeated_blocks(notes: DataFrame, cfg: Settings) -> DataFrame:
    """(path, error) of notes with a block id more than once."""
    ids = note_blocks(notes, cfg.min_chars, cfg.max_chars).groupBy("note_path", "block_uid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return ids.groupBy(F.col("note_path").alias("path")).agg(F.concat(F.lit("repeated block id "), F.min("block_uid")).alias("error"))


class Indexer:
    def __init__(self, spark: SparkSession, vault_root: str, store_root: str, globs=(), dirs=(), cfg: Settings | None = None, embed=T.pseudo_embedding):
        self.spark, self.vault_root, self.globs, self.dirs, self.embed = spark, vault_root, list(globs), list(dirs), embed
        self.store, self.cfg = S.Store(spark, store_root), cfg or load(spark)

    def _parsed(self) -> DataFrame:
        """Each file is read and parsed once for a job: all of its tables are of the same state."""
        return vault.parse_files(vault.scan(self.spark, self.vault_root, self.globs, self.dirs)).persist(StorageLevel.MEMORY_AND_DISK)

    def _job(self, job_id: int, kind: str, run) -> dict:
        self.store.log_job(job_id, 0, kind, "running")
        began = time.monotonic()
        ms = lambda: int((time.monotonic() - began) * 1000)
        try:
            detail = run()
        except Exception as e:
            self.store.log_job(job_id, 2, kind, "failed", json.dumps({"error": str(e)[:500], "elapsed_ms": ms()}))
            raise
        detail["elapsed_ms"] = ms()
        failed = detail.get("failed_files", 0)
        detail["status"] = "success" if not failed else "partial_success" if detail.get("indexed_files") or kind == "sync" else "failed"
        self.store.log_job(job_id, 2, kind, detail["status"], json.dumps(detail, ensure_ascii=False))
        return detail

    def _outcome(self, job_id: int, kind: str, notes: DataFrame, failed: DataFrame) -> dict:
        """Counts of what is about to be indexed, logged as progress, and the failures."""
        failed = failed.unionByName(repeated_blocks(notes, self.cfg))
        bad = {r.path: r.error for r in failed.orderBy("path").limit(FAILURES).collect()}
        detail = {"indexed_files": notes.count(), "failed_files": failed.count()}
        self.store.log_job(job_id, 1, kind, "running", json.dumps(detail))
        return detail | ({"failures": [{"path": k, "error": v} for k, v in bad.items()]} if bad else {})

    def rebuild(self, job_id: int = 1) -> dict:
        """A snapshot of what is on disk now; notes that are gone from disk, or can't be read, are gone from it."""

        def run():
            parsed = self._parsed()
            try:
                notes, failed = vault.notes_of(parsed), parsed.filter("error is not null").select("path", "error")
                detail = self._outcome(job_id, "rebuild", notes, failed)
                return {"version": self.store.write(index_tables(notes, self.cfg, self.embed)), "total_files": parsed.count()} | detail
            finally:
                parsed.unpersist()

        return self._job(job_id, "rebuild", run)

    def sync(self, job_id: int = 2) -> dict:
        """Only added and modified notes are cut and embedded again; deleted ones cascade. A note that can't be
        read now stays as it was."""

        def run():
            old = self.store.read()
            if not old:
                return self.rebuild(job_id * 1000)
            parsed = self._parsed()
            try:
                notes, failed = vault.notes_of(parsed), parsed.filter("error is not null").select("path", "error")
                diff = S.file_diff(old["notes"], notes).join(failed, "path", "left_anti").persist()
                kinds = {r["change"]: r["count"] for r in diff.groupBy("change").count().collect()}
                changed = notes.join(diff.filter("change <> 'deleted'").select("path"), "path", "left_semi")
                detail = self._outcome(job_id, "sync", changed, failed)
                if kinds:
                    # links that point at a changed note stay; only a deleted note takes them along
                    self._commit(changed, diff.filter("change <> 'deleted'"), diff.filter("change = 'deleted'"), sum(kinds.values()))
                diff.unpersist()
                return {"version": self.store.version(), **kinds} | detail
            finally:
                parsed.unpersist()

        return self._job(job_id, "sync", run)

    def _commit(self, notes: DataFrame, replaced: DataFrame, deleted: DataFrame, changes: int) -> int:
        """The given notes' rows in place of those of the changed paths; few paths go as a list, so that only their
        folders are read."""
        if changes <= S.LISTED:
            replaced, deleted = ([r.path for r in x.select("path").collect()] for x in (replaced, deleted))
        return self.store.apply(self._tables(notes, replaced), replaced, deleted)

    def _tables(self, notes: DataFrame, replaced) -> dict[str, DataFrame]:
        return index_tables(notes, self.cfg, self.embed, self.store.embedded(replaced))

    def index_file(self, path: str, job_id: int = 3) -> dict:
        """One note, given by its path under the vault, is indexed again; one that the rules exclude is skipped."""
        named = self.spark.createDataFrame([(path,)], "path string")
        if named.filter(vault.excluded(F.col("path"), self.globs, self.dirs, self.vault_root)).count():
            return {"skipped": path, "reason": "excluded"}

        def run():
            parsed = vault.parse_files(vault.scan(self.spark, self.vault_root, only=path)).persist()
            try:
                bad = parsed.filter("error is not null").first()
                if bad:
                    raise ValueError(f"{path}: {bad.error}")
                notes = vault.notes_of(parsed)
                if not notes.count():
                    raise FileNotFoundError(path)
                version = self.store.apply(self._tables(notes, [path]), [path])
                return {"indexed": path, "version": version, "indexed_files": 1}
            finally:
                parsed.unpersist()

        return self._job(job_id, "index_file", run)

    def clear(self, job_id: int = 4) -> dict[str, int]:
        return self._job(job_id, "clear", lambda: {"deleted": self.store.clear()})["deleted"]
