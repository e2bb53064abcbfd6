"""Published generations: tables of one state in a folder, a manifest, and a pointer that is written last."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def row_sums(table: DataFrame, key: str = "") -> DataFrame:
    """n and sums: sums of four parts of the rows' SHA-256 (with a key before each row), which don't depend on the order and in which equal rows add up."""
    row = F.sha2(F.concat(F.lit(key), F.to_json(F.struct(*sorted(table.columns)))), 256)
    parts = [F.sum(F.conv(F.substring(row, i, 15), 16, 10).cast("decimal(38,0)")) for i in (1, 16, 31, 46)]
    return table.agg(F.count("*").alias("n"), F.concat_ws(":", *(F.coalesce(p, F.lit(0)).cast("string") for p in parts)).alias("sums"))


def digest(table: DataFrame) -> DataFrame:
    """n and a checksum of the rows that doesn't depend on their order."""
    return row_sums(table).select("n", F.sha2("sums", 256).alias("checksum"))


class Publication:
    """Generations below a folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _place(self, generation: int) -> str:
        return f"{self.folder}/gen={generation:012d}"

    def _write(self, name: str, text: str) -> None:
        """Written beside and renamed, so that readers see all of it or nothing."""
        part, whole = self._path(f"{self.folder}/{name}.part"), self._path(f"{self.folder}/{name}")
        out = self._fs.create(part, True)
        out.write(bytearray(text.encode()))
        out.close()
        self._fs.delete(whole, False)
        if not self._fs.rename(part, whole):
            raise OSError(f"{name} can't be put in place")

    def _read(self, name: str) -> str | None:
        path = f"{self.folder}/{name}"
        return "\n".join(r[0] for r in self.spark.read.text(path).collect()) if self._fs.exists(self._path(path)) else None  # one small file

    def generations(self) -> list[int]:
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        return sorted(int(n[4:]) for n in names if n.startswith("gen="))

    def active(self) -> int | None:
        pointer = self._read("ACTIVE")
        return int(pointer) if pointer else None

    def publish(self, generation: int, cursor: int, **tables: DataFrame) -> None:
        """Writes the tables, reads them again to verify, writes the manifest and at last the pointer."""
        place, manifest = self._place(generation), {"generation": generation, "cursor": cursor, "tables": {}}
        for name, table in tables.items():
            table.write.mode("overwrite").parquet(f"{place}/{name}")
            n, checksum = digest(self.spark.read.parquet(f"{place}/{name}")).first()
            manifest["tables"][name] = {"n": n, "checksum": checksum}
        self._write(f"gen={generation:012d}/manifest.json", json.dumps(manifest))
        self._write("ACTIVE", str(generation))

    def manifest(self, generation: int) -> dict | None:
        text = self._read(f"gen={generation:012d}/manifest.json")
        return json.loads(text) if text else None

    def verified(self, generation: int) -> dict[str, DataFrame] | None:
        """The tables of a generation whose manifest agrees with them, else None."""
        manifest, out = self.manifest(generation), {}
        if manifest is None:
            return None
        for name, told in manifest["tables"].items():
            try:
                table = self.spark.read.parquet(f"{self._place(generation)}/{name}")
                n, checksum = digest(table).first()
            except Exception:  # whatever can't be read isn't whole
                return None
            if (n, checksum) != (told["n"], told["checksum"]):
                return None
            out[name] = table
        return out

    def open_latest(self) -> tuple[int, dict[str, DataFrame]] | None:
        """From the active generation downwards the first that is whole; the others are moved aside."""
        active = self.active()
        for generation in reversed([g for g in self.generations() if active is None or g <= active]):
            tables = self.verified(generation)
            if tables is not None:
                return generation, tables
            self._fs.mkdirs(self._path(f"{self.folder}/quarantine"))
            self._fs.rename(self._path(self._place(generation)), self._path(f"{self.folder}/quarantine/gen={generation:012d}"))
        return None
