"""What a worker holds while a table is written."""

import pyarrow as pa
from pyspark.sql import functions as F

from loomline.llm.common import give_back, written


def test_written_tables_are_built_from_small_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows], pa.int64()), pa.array([b.nbytes], pa.int64())], names=["rows", "size"])
        give_back()

    texts = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("words "), 1500).alias("text"))
    out = written(texts.mapInArrow(sizes, "rows long, size long"), "batch-sizes").collect()
    assert sum(r["rows"] for r in out) == 3000
    assert max(r["size"] for r in out) < 6 << 20  # 27 MB in all
    assert spark.conf.get(key, None) == before
