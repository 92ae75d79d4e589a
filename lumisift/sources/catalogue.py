"""The catalogue: items, faces and state as Parquet, laid out in parts by a hash of the key.

Merges are pure functions from frames to frames. `Catalogue` applies them to the parts that a batch touches, writes those parts
beside the old ones and then publishes a new version: a small file that names the folder of every part. A version's file is
made by a rename that fails where another writer was first; then the change goes on top of that version, and is computed anew
only where both touched the same part. So a reader sees a whole version, old or new, and writers of different parts don't wait.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumisift import schema
from lumisift.operators.stats import face_candidates

#: What an upsert leaves as it is, and what it only fills.
KEPT_FIELDS, FILLED_FIELDS = ("features", "analyzed", "analysis_error"), ("ts", "precision")


def upsert_items(catalogue: DataFrame, batch: DataFrame) -> DataFrame:
    """MERGE by id with a column `added`: per field the batch wins, null or not; columns that it lacks stay as they are."""
    old, new = catalogue.alias("o"), batch.alias("n")
    joined = old.withColumn("_old", F.lit(True)).alias("o").join(new.withColumn("_new", F.lit(True)).alias("n"), F.col("o.id") == F.col("n.id"), "full_outer")
    is_new, was = F.col("n._new"), F.col("o._old")
    out = [F.coalesce("n.id", "o.id").alias("id")]
    for c in catalogue.columns:
        if c == "id":
            continue
        before = F.col(f"o.`{c}`")
        if c in KEPT_FIELDS:
            value = F.when(was, before).otherwise(F.lit(False)) if c == "analyzed" else before
        elif c not in batch.columns:
            value = before
        elif c in FILLED_FIELDS:
            value = F.coalesce(F.col(f"n.`{c}`"), before)
        else:
            value = F.when(is_new, F.col(f"n.`{c}`")).otherwise(before)
        out.append(value.alias(c))
    return joined.select(*out, (is_new & was.isNull()).alias("added"), is_new.isNotNull().alias("touched"))


def upsert_counts(merged: DataFrame) -> DataFrame:
    return merged.agg(F.count_if(F.coalesce("added", F.lit(False))).alias("added"), F.count_if(F.col("touched") & ~F.coalesce("added", F.lit(False))).alias("updated"))


def save_features(catalogue: DataFrame, results: DataFrame) -> DataFrame:
    """results (id, features, error): success replaces the features, failure keeps them, with its reason and pending again."""
    r = results.select("id", F.col("features").alias("_f"), F.col("error").alias("_e"), F.lit(True).alias("_r"))
    out = catalogue.join(r, "id", "left")
    failed = F.col("_e").isNotNull()
    return out.withColumns(
        {
            "features": F.when(F.col("_r") & ~failed, F.col("_f")).otherwise(F.col("features")),
            "analyzed": F.when(F.col("_r"), ~failed).otherwise(F.col("analyzed")),
            "analysis_error": F.when(F.col("_r"), F.col("_e")).otherwise(F.col("analysis_error")),
        }
    ).drop("_f", "_e", "_r")


def replace_faces(faces: DataFrame, found: DataFrame, analysed: DataFrame) -> DataFrame:
    """The faces of the analysed photos (photo_id) are those found; others stay."""
    kept = faces.join(analysed.select("photo_id"), "photo_id", "left_anti").select(faces.columns)
    return kept.unionByName(found.join(analysed.select("photo_id"), "photo_id", "left_semi").select(faces.columns))


def mark_scanned(items: DataFrame, analysed: DataFrame) -> DataFrame:
    """The items of the analysed photos (photo_id) are scanned, with nobody known yet."""
    seen = analysed.select(F.col("photo_id").alias("id"), F.lit(True).alias("_seen")).distinct()
    marked = items.join(seen, "id", "left").withColumns(
        {"people_scanned": F.coalesce("_seen", "people_scanned"), "people": F.when(F.col("_seen"), F.array().cast("array<int>")).otherwise(F.col("people"))}
    )
    return marked.drop("_seen")


def save_faces(items: DataFrame, faces: DataFrame, found: DataFrame, analysed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after some photos have been analysed."""
    return mark_scanned(items, analysed), replace_faces(faces, found, analysed)


def save_people(items: DataFrame, people: DataFrame) -> DataFrame:
    """people (photo_id, people): assigns, also an explicit empty list; items that it lacks stay."""
    new = people.select(F.col("photo_id").alias("id"), F.col("people").alias("_people"))
    return items.join(new, "id", "left").withColumn("people", F.coalesce("_people", "people")).drop("_people")


def mark_kept(items: DataFrame, ids: DataFrame, kept: bool, at: int | None = None) -> DataFrame:
    hit = ids.select("id", F.lit(True).alias("_hit")).distinct()
    value, time = (F.lit(True), F.lit(at).cast("long")) if kept else (F.lit(None).cast("boolean"), F.lit(None).cast("long"))
    out = items.join(hit, "id", "left")
    changes = {"kept": F.when(F.col("_hit"), value).otherwise(F.col("kept"))}
    if "kept_at" in items.columns:
        changes["kept_at"] = F.when(F.col("_hit"), time).otherwise(F.col("kept_at"))
    return out.withColumns(changes).drop("_hit")


def clear_kept(items: DataFrame) -> DataFrame:
    return items.withColumn("kept", F.lit(None).cast("boolean"))


def mark_ids(items: DataFrame, ids: DataFrame, patch: dict) -> DataFrame:
    hit = ids.select("id", F.lit(True).alias("_hit")).distinct()
    kinds = dict(items.dtypes)
    return items.join(hit, "id", "left").withColumns({k: F.when(F.col("_hit"), F.lit(v).cast(kinds[k])).otherwise(F.col(k)) for k, v in patch.items()}).drop("_hit")


def delete_items(items: DataFrame, faces: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = ids.select("id")
    return items.join(gone, "id", "left_anti").select(items.columns), faces.join(gone.withColumnRenamed("id", "photo_id"), "photo_id", "left_anti").select(faces.columns)


def clear_people(items: DataFrame) -> DataFrame:
    return items.withColumns({"people": F.lit(None).cast("array<int>")})


def clear_faces(items: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    return items.withColumns({"people": F.lit(None).cast("array<int>"), "people_scanned": F.lit(False)}), faces.limit(0)


def pending(items: DataFrame, limit: int | None = None) -> DataFrame:
    """Items still to be analysed: the filter reaches the scan."""
    out = items.filter(~F.coalesce("analyzed", F.lit(False)) & F.col("url").isNotNull())
    return out.orderBy("id").limit(limit) if limit else out


def people_candidates(items: DataFrame, limit: int | None = 240, least: float = 0.35) -> DataFrame:
    out = face_candidates(items, least).filter(~F.coalesce("people_scanned", F.lit(False)))
    return out.orderBy("id").limit(limit) if limit else out


def faces_of(faces: DataFrame, photo_id: str) -> DataFrame:
    return faces.filter(F.col("photo_id") == photo_id)


def face_row_id(photo_id, index):
    return F.concat(photo_id, F.lit("#"), index.cast("string"))


#: Columns of the tables, and the key that deals each of them into parts.
TABLES = {"items": schema.ITEM, "faces": schema.FACE, "pending": f"{schema.ITEM}, batch long, page long, place int"}
KEYS = {"items": "id", "faces": "photo_id", "pending": "id"}
#: Changes that are tried anew where other writers were first.
TRIES = 50


class Conflict(Exception):
    """Other writers were first, again and again."""


class Within(NamedTuple):
    """Parts, of so many, that are known to hold some keys, so that no job has to ask for them."""

    of: int
    parts: list[int]


class Catalogue:
    """Versioned tables below a folder that driver and executors share.

    parts: of a table that is made here; some 100,000 rows a part keep small batches small. keep: versions that readers may still be
    reading; what older ones alone name is deleted.
    """

    def __init__(self, spark: SparkSession, path: str, parts: int = 32, keep: int = 10):
        self.spark, self.path, self.parts, self.keep = spark, path.rstrip("/"), parts, keep

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path

    def _names(self, below: str = "") -> list[str]:
        fs, path = self._fs()
        p = path(f"{self.path}/{below}")
        return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []

    def _delete(self, name: str) -> None:
        fs, path = self._fs()
        fs.delete(path(f"{self.path}/{name}"), True)

    def _read_text(self, name: str) -> str | None:
        fs, path = self._fs()
        p = path(f"{self.path}/{name}")
        if not fs.exists(p):
            return None
        file = fs.open(p)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8")
        finally:
            file.close()

    def _write_text(self, name: str, text: str, replace: bool = True) -> bool:
        """Written beside and renamed in one step, so a crash leaves the old text or the new one. Without replace, False where the name is taken."""
        fs, path = self._fs()
        target, temp = path(f"{self.path}/{name}"), path(f"{self.path}/_{uuid.uuid4().hex}")
        out = fs.create(temp)
        out.write(bytearray(text.encode()))
        out.close()
        java = self.spark._jvm
        kind = getattr(java.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE if replace else kind.NONE
        try:
            java.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else fs.getUri(), self.spark._jsc.hadoopConfiguration()).rename(temp, target, how)
        except Py4JJavaError as e:
            if replace or "FileAlreadyExists" not in str(e.java_exception):
                raise
            fs.delete(temp, False)
            return False
        return True

    def version(self, table: str) -> int:
        """The last published version; 0 before the first."""
        return max((int(n[len(table) + 2 : -5]) for n in self._names() if n.startswith(f"{table}.v")), default=0)

    def _state(self, table: str) -> tuple[int, dict]:
        """The last version, its number of parts and their folders."""
        while True:
            version = self.version(table)
            text = self._read_text(f"{table}.v{version:012d}.json") if version else None
            if text or not version:
                found = json.loads(text) if text else {"parts": self.parts, "files": {}}
                return version, found | {"files": {int(k): v for k, v in found["files"].items()}}

    def _frame(self, table: str, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(*[f"{self.path}/{f}" for f in folders])

    @staticmethod
    def _part(key: str | Column, parts: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")

    def _parts_of(self, keys: DataFrame, parts: int) -> list[int]:
        return sorted(r[0] for r in keys.select(self._part(keys.columns[0], parts)).distinct().collect())  # `parts` at most

    def dealt(self, ids: DataFrame) -> tuple[int, DataFrame]:
        """The number of the items' parts, and ids with the part that each lies in."""
        parts = self._state("items")[1]["parts"]
        return parts, ids.withColumn("_part", self._part("id", parts))

    def read(self, table: str) -> DataFrame:
        return self._frame(table, list(self._state(table)[1]["files"].values()))

    def _near(self, keys: DataFrame, state: dict, within: Within | None) -> list[int]:
        return within.parts if within and within.of == state["parts"] else self._parts_of(keys, state["parts"])

    def read_near(self, table: str, keys: DataFrame, within: Within | None = None) -> DataFrame:
        """The parts of a table that hold any of the keys (their first column), with whatever else is in them."""
        state = self._state(table)[1]
        return self._frame(table, [state["files"][p] for p in self._near(keys, state, within) if p in state["files"]])

    def _publish(self, table: str, version: int, state: dict) -> bool:
        if not self._write_text(f"{table}.v{version:012d}.json", json.dumps(state), replace=False):
            return False
        for name in self._names():
            if name.startswith(f"{table}.v") and int(name[len(table) + 2 : -5]) <= version - self.keep:
                for folder in json.loads(self._read_text(name) or "{}").get("replaced", []):  # none of the versions since then names them
                    self._delete(folder)
                self._delete(name)
        return True

    def _apply(self, table: str, touched: Callable[[dict], list[int]], merge: Callable[[DataFrame], DataFrame]) -> int:
        for _ in range(TRIES):
            version, state = self._state(table)
            parts, files = state["parts"], state["files"]
            here = touched(state)
            if not here:
                return version
            folder = f"{table}-{uuid.uuid4().hex}"
            new = merge(self._frame(table, [files[p] for p in here if p in files])).withColumn("_part", self._part(KEYS[table], parts))
            new.hint("rebalance", "_part").write.partitionBy("_part").parquet(f"{self.path}/{folder}")  # a large part is written by several tasks
            made = {int(n.partition("=")[2]): f"{folder}/{n}" for n in self._names(folder) if n.startswith("_part=")}
            now = state
            while now["parts"] == parts and all(now["files"].get(p) == files.get(p) for p in here):
                rest = {p: f for p, f in now["files"].items() if p not in here}
                if self._publish(table, version + 1, {"parts": parts, "files": rest | made, "replaced": [files[p] for p in here if p in files]}):
                    return version + 1
                version, now = self._state(table)
            self._delete(folder)
        raise Conflict(table)

    def change(self, table: str, keys: DataFrame, merge: Callable[[DataFrame], DataFrame], within: Within | None = None) -> int:
        """Replace the parts that hold any of the keys (their first column) by what merge makes of their rows; the version that has it."""
        return self._apply(table, lambda state: self._near(keys, state, within), merge)

    def write(self, table: str, df: DataFrame) -> int:
        """Replace a whole table."""
        return self._apply(table, lambda state: list(range(state["parts"])), lambda _: df)

    def deal_anew(self, table: str, parts: int) -> None:
        """Lay a table out in another number of parts; nobody else may write meanwhile."""
        version, state = self._state(table)
        folder = f"{table}-{uuid.uuid4().hex}"
        self.read(table).withColumn("_part", self._part(KEYS[table], parts)).repartition("_part").write.partitionBy("_part").parquet(f"{self.path}/{folder}")
        made = {int(n.partition("=")[2]): f"{folder}/{n}" for n in self._names(folder) if n.startswith("_part=")}
        if not self._publish(table, version + 1, {"parts": parts, "files": made, "replaced": list(state["files"].values())}):
            raise Conflict(table)

    def upsert(self, batch: DataFrame) -> int:
        return self.change("items", batch.select("id"), lambda old: upsert_items(old, batch).select(old.columns))

    def save_features(self, results: DataFrame, within: Within | None = None) -> int:
        return self.change("items", results.select("id"), lambda old: save_features(old, results).select(old.columns), within)

    def save_faces(self, found: DataFrame, analysed: DataFrame, within: Within | None = None) -> int:
        """The faces first: a photo that isn't marked is only read again, and its faces replaced."""
        photos = analysed.select("photo_id")
        self.change("faces", photos, lambda old: replace_faces(old, found, analysed), within)
        return self.change("items", photos, lambda old: mark_scanned(old, analysed).select(old.columns), within)

    def save_people(self, people: DataFrame) -> int:
        return self.change("items", people.select("photo_id"), lambda old: save_people(old, people).select(old.columns))

    def mark_kept(self, ids: DataFrame, kept: bool, at: int | None = None) -> int:
        return self.change("items", ids.select("id"), lambda old: mark_kept(old, ids, kept, at).select(old.columns))

    def mark_ids(self, ids: DataFrame, patch: dict) -> int:
        return self.change("items", ids.select("id"), lambda old: mark_ids(old, ids, patch).select(old.columns))

    def delete(self, ids: DataFrame) -> int:
        """Items and their faces; the faces first, so none is left without its item."""
        self.change("faces", ids.select("id"), lambda old: old.join(ids.select(F.col("id").alias("photo_id")), "photo_id", "left_anti").select(old.columns))
        return self.change("items", ids.select("id"), lambda old: old.join(ids.select("id"), "id", "left_anti").select(old.columns))

    def clear(self) -> None:
        for table in TABLES:
            self.write(table, self.read(table).limit(0))

    def ids(self) -> DataFrame:
        return self.read("items").select("id")

    def counts(self) -> dict[str, int]:
        return {t: self.read(t).count() for t in ("items", "faces")}

    def get_meta(self, key: str, default=None):
        text = self._read_text(f"meta-{key}.json")
        return default if text is None else json.loads(text)

    def set_meta(self, key: str, value) -> None:
        self._write_text(f"meta-{key}.json", json.dumps(value))

    def note_progress(self, oldest: int | None) -> int | None:
        """The oldest instant handled so far; it never rises and outlives a reset."""
        known = self.get_meta("progress", {}).get("oldest")
        value = min((v for v in (known, oldest) if v is not None), default=None)
        self.set_meta("progress", {"oldest": value})
        return value

    def export_json(self, path: str, params: dict) -> None:
        """The items as JSON lines, and the parameters beside them."""
        self.read("items").write.json(f"{path}/items")
        self.spark.createDataFrame([(json.dumps(params),)], "value string").coalesce(1).write.text(f"{path}/params")
