"""Manifests with checksums, and snapshots of frames that are kept with them."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.sources import files


@dataclasses.dataclass(frozen=True)
class SourceManifest:
    source_id: str
    uri: str
    sha256: str | None
    retrieved_at: str
    evidence_available_at: str
    content_type: str = "application/octet-stream"
    row_count: int | None = None
    complete: bool = True
    redistributable: bool = False
    notes: str = ""

    def __post_init__(self) -> None:
        if not self.source_id.strip() or not self.uri.strip():
            raise ValueError("source_id and uri must not be empty")
        if self.sha256 is not None and (len(self.sha256) != 64 or set(self.sha256.lower()) - set("0123456789abcdef")):
            raise ValueError("sha256 must be 64 hexadecimal digits")
        if self.row_count is not None and self.row_count < 0:
            raise ValueError("row_count must not be negative")
        datetime.fromisoformat(self.retrieved_at)
        datetime.fromisoformat(self.evidence_available_at)

    def verify(self, payload: bytes) -> bool:
        """False without a checksum."""
        return self.sha256 is not None and hashlib.sha256(payload).hexdigest() == self.sha256.lower()

    def to_json(self) -> str:
        return json.dumps(dataclasses.asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> SourceManifest:
        return cls(**json.loads(text))


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of every file under a path, hashed where Spark reads them."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


class MemoryCache:
    """Payloads by key with their manifests. Writing a payload without a manifest drops the one that was there."""

    def __init__(self) -> None:
        self.payloads: dict = {}
        self.manifests: dict[str, SourceManifest] = {}

    def put(self, key: str, payload, manifest: SourceManifest | None = None) -> None:
        self.payloads[key] = payload
        if manifest is None:
            self.manifests.pop(key, None)
        else:
            self.manifests[key] = manifest

    def get(self, key: str):
        return self.payloads.get(key)

    def manifest(self, key: str) -> SourceManifest | None:
        return self.manifests.get(key)

    def delete(self, key: str) -> None:
        self.payloads.pop(key, None)
        self.manifests.pop(key, None)

    def clear(self) -> None:
        self.payloads.clear()
        self.manifests.clear()

    def __contains__(self, key: str) -> bool:
        return key in self.payloads


class SnapshotCache:
    """Frames as Parquet under a root that Spark can reach, in folders named by the key's hash.

    Every put() writes a version of its own, rows and manifest, and then one small file, `current`, that names it and is renamed into place last. So a put that fails leaves the snapshot as it was, readers of an
    older version keep it, a frame read from a key may be put under it again, and rows never meet another version's manifest. Older versions stay until clean() or delete(). Of two puts at once, the one that renames last counts.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, key: str) -> str:
        return f"{self.root}/{hashlib.sha256(key.encode()).hexdigest()}"

    def _current(self, key: str) -> str | None:
        name = files.read_text(self.spark, f"{self._at(key)}/current")
        return f"{self._at(key)}/{name}" if name else None

    def put(self, key: str, frame: DataFrame, manifest: SourceManifest | None = None) -> None:
        name = f"version-{uuid.uuid4().hex}"
        at = f"{self._at(key)}/{name}"
        try:
            frame.write.parquet(f"{at}/rows")
            files.write_text(self.spark, f"{at}/manifest.json", manifest.to_json() if manifest else "")
            files.write_text(self.spark, f"{at}/pointer", name)
        except Exception:
            files.remove(self.spark, at)
            raise
        files.replace(self.spark, f"{at}/pointer", f"{self._at(key)}/current")

    def __contains__(self, key: str) -> bool:
        return self._current(key) is not None

    def get(self, key: str) -> DataFrame | None:
        at = self._current(key)
        return self.spark.read.parquet(f"{at}/rows") if at else None

    def manifest(self, key: str) -> SourceManifest | None:
        at = self._current(key)
        text = files.read_text(self.spark, f"{at}/manifest.json") if at else None
        return SourceManifest.from_json(text) if text else None

    def versions(self, key: str) -> list[str]:
        """The folders of all versions that are kept, those of puts under way too."""
        return files.folders(self.spark, self._at(key))

    def clean(self, key: str) -> int:
        """Removes all versions but the current one, when nothing reads or writes them any more; their number."""
        now = self._current(key)
        gone = [v for v in self.versions(key) if not now or v.rpartition("/")[2] != now.rpartition("/")[2]]
        for version in gone:
            files.remove(self.spark, version)
        return len(gone)

    def delete(self, key: str) -> None:
        for path in (f"{self._at(key)}/current", self._at(key)):  # the pointer first: a snapshot is there as a whole or not at all
            files.remove(self.spark, path)
