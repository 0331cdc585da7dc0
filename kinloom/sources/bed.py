"""Binary genotypes as a Spark data source.

``spark.dataSource.register(BedSource)``, then
``spark.read.format("bed").option("stem", "/data/x").load()`` gives
(iid, snp_id, dosage): copies of the first allele, null where not called.
Tasks read disjoint ranges of variants, so no task or driver holds the file.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The file starts so when variants follow each other.
MAGIC = b"\x6c\x1b\x01"
#: Two bits to copies of the first allele; 1 is not called.
COPIES = np.array([2, -1, 1, 0], dtype=np.int8)


class Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class BedReader(DataSourceReader):
    def __init__(self, options):
        self.stem, self.per_task, self.per_batch = options["stem"], int(options.get("variants_per_task", 20_000)), int(options.get("cells_per_batch", 2_000_000))

    def _file(self, end):
        where, path = fs.FileSystem.from_uri(self.stem) if "://" in self.stem else (fs.LocalFileSystem(), self.stem)
        return where.open_input_file(path + end)

    def _names(self, end):
        with self._file(end) as f:
            return [w[1].decode() for line in f.read().split(b"\n") if len(w := line.split()) > 1]

    def partitions(self):
        stride = -(-len(self._names(".fam")) // 4)
        with self._file(".bed") as f:
            if f.read(3) != MAGIC:
                raise ValueError("not a genotype file with variants one after the other")
            n = (f.size() - 3) // max(stride, 1)
        return [Range(i, min(i + self.per_task, n)) for i in range(0, n, self.per_task)] or [Range(0, 0)]

    def read(self, part):
        people, variants = self._names(".fam"), self._names(".bim")
        stride, names = -(-len(people) // 4), pa.array(people, pa.string())
        step = max(1, self.per_batch // max(len(people), 1))
        with self._file(".bed") as f:
            f.seek(3 + part.first * stride)
            for k in range(part.first, part.last, step):
                count = min(step, part.last - k)
                packed = np.frombuffer(f.read(count * stride), np.uint8).reshape(count, stride)
                codes = (packed[:, :, None] >> np.array([0, 2, 4, 6], np.uint8)) & 3
                dosage = COPIES[codes.reshape(count, -1)[:, : len(people)]].reshape(-1)
                index = pa.array(np.tile(np.arange(len(people)), count))
                ids = pa.array(variants[k : k + count], pa.string()).take(pa.array(np.repeat(np.arange(count), len(people))))
                yield pa.RecordBatch.from_arrays([names.take(index), ids, pa.array(dosage.astype(np.int32), mask=dosage < 0)], names=["iid", "snp_id", "dosage"])


class BedSource(DataSource):
    @classmethod
    def name(cls):
        return "bed"

    def schema(self):
        return "iid string, snp_id string, dosage int"

    def reader(self, schema):
        return BedReader(self.options)
