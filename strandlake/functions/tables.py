"""Table functions that SQL can call."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def register_sequence_blocks(spark: SparkSession, name: str = "sequence_blocks", block: int = 5_000, context: int = 10_000, key_type: str = "long") -> None:
    """Makes name(TABLE(...) PARTITION BY key ORDER BY line) known to SQL: blocks of sequences that come in pieces.

    The table has the columns key, line and piece; a partition is one sequence. The result is (key, block, piece): consecutive
    blocks of `block` letters with context / 2 letters on either side, N beyond the sequence. What is held of a sequence is one
    block and its context, however long it is. Null pieces are empty; a sequence without letters has no block.
    """
    before = context // 2
    width = block + 2 * before

    class Blocks:
        """One sequence: eval gets its pieces in order, terminate its end."""

        def __init__(self) -> None:
            self.key: pa.Scalar | None = None
            self.held, self.letters, self.made = "N" * before, 0, 0

        def _table(self, pieces: list[str]) -> pa.Table:
            first, self.made = self.made, self.made + len(pieces)
            key = pa.array([self.key.as_py()] * len(pieces), self.key.type)
            return pa.table({"key": key, "block": pa.array(range(first, self.made), pa.int64()), "piece": pa.array(pieces, pa.string())})

        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            out = []
            for key, piece in zip(batch.column("key"), batch.column("piece"), strict=True):
                self.key, text = key, piece.as_py() or ""
                self.held += text
                self.letters += len(text)
                at = 0
                while len(self.held) - at >= width:
                    out.append(self.held[at : at + width])
                    at += block
                self.held = self.held[at:]
            if out:
                yield self._table(out)

        def terminate(self) -> Iterator[pa.Table]:
            left = -(-self.letters // block) - self.made
            if left > 0:
                yield self._table([self.held[k * block :][:width].ljust(width, "N") for k in range(left)])

    made = F.arrow_udtf(Blocks, returnType=f"key {key_type}, block long, piece string")
    spark.udtf.register(name, made)
