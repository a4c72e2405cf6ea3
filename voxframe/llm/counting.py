"""Token counts without token ids.

A text is parted into pre-tokens (words between white space). Each distinct
pre-token is sent to one task, which asks the tokenizer once for its number of
pieces and multiplies it with the pre-token's frequency in each document; the
products are summed per document. The most frequent pre-tokens would make hot
keys, so a table of those that are at least one in ``share`` of all (hence at
most ``share`` entries) is handed to every task and their part is summed where
the text is read. Which pre-tokens are in that table changes no result.

NULL and empty texts count 0 tokens, repeated rows each keep their own row; an
empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .units import unit_encoder

SHARE = 1 << 18  # a common pre-token is at least one in so many, so there are at most so many of them


def _pieces(tokenizer: str, units: list[str]) -> list[int]:
    return [len(ids) // 4 for ids in unit_encoder(tokenizer).encode(units)]


def common_units(texts: DataFrame, tokenizer: str, share: int) -> dict[str, int]:
    """Pieces of the pre-tokens that make up at least one in ``share`` of all, by count over all texts."""

    def propose(batches):
        encoder, seen, total = unit_encoder(tokenizer), Counter(), 0
        for batch in batches:
            for text in batch.column("text").to_pylist():
                units = encoder.units(text)
                seen.update(units)
                total += len(units)
            if len(seen) > 2_000_000:  # what is rare in this task so far is let go
                seen = Counter({u: n for u, n in seen.items() if n * share >= total})
        often = [(u, n) for u, n in seen.items() if u and n > 1 and n * share >= total]
        yield pa.RecordBatch.from_arrays([pa.array([None, *[u for u, _ in often]], pa.string()), pa.array([total, *[n for _, n in often]], pa.int64())],
                                         names=["unit", "n"])

    counts = cut_lineage(texts.mapInArrow(propose, "unit string, n bigint").groupBy("unit").agg(F.sum("n").alias("n")))
    total = counts.where("unit is null").agg(F.sum("n")).first()[0] or 0

    def count(batches):
        for batch in batches:
            units = batch.column("unit").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(units, pa.string()), pa.array(_pieces(tokenizer, units), pa.int64())], names=["unit", "pieces"])

    often = counts.where(F.col("unit").isNotNull() & (F.col("n") * share >= total)).select("unit")
    return {r.unit: r.pieces for r in often.mapInArrow(count, "unit string, pieces bigint").collect()}


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, share: int = SHARE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every row of ``docs``."""
    texts = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("bigint").alias("n_bytes"), F.monotonically_increasing_id().alias("row"),
    )
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(common_units(texts.select("text"), tokenizer, share))
    kind = texts.schema["doc_id"].dataType.simpleString()

    def frequencies(batches):
        """A row for each document with the sum of its common units, and one for each other unit in it."""
        encoder, pieces = unit_encoder(tokenizer), known.value
        lookup = pieces.get
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                sums, units, counts, owners = [], [], [], []
                for i, body in enumerate(part.column("text").to_pylist()):
                    done, rare = 0, []
                    for unit in encoder.units(body):
                        n = lookup(unit)
                        if n is None:
                            rare.append(unit)
                        else:
                            done += n
                    sums.append(done)
                    found = Counter(rare)
                    found.pop("", None)
                    units.append(list(found))
                    counts += found.values()
                    owners += [i] * len(found)
                n, m = part.num_rows, len(owners)
                flat = pa.array(chain.from_iterable(units), pa.string())
                yield pa.RecordBatch.from_arrays([
                    pa.concat_arrays([part.column("row"), part.column("row").take(pa.array(owners, pa.int64()))]),
                    pa.concat_arrays([part.column("doc_id"), pa.nulls(m, part.column("doc_id").type)]),
                    pa.concat_arrays([part.column("n_bytes"), pa.nulls(m, pa.int64())]),
                    pa.concat_arrays([pa.nulls(n, pa.string()), flat]),
                    pa.array(sums + counts, pa.int64()),
                ], names=["row", "doc_id", "n_bytes", "unit", "n"])

    schema = f"row bigint, doc_id {kind}, n_bytes bigint, unit string, n bigint"
    key = F.coalesce("unit", F.col("row").cast("string"))
    dealt = texts.mapInArrow(frequencies, schema).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key)

    def products(batches):
        for batch in batches:
            units = batch.column("unit")
            rare = units.drop_null().to_pylist()
            distinct = list(set(rare))
            pieces = dict(zip(distinct, _pieces(tokenizer, distinct)))
            n = [a if u is None else a * pieces[u] for a, u in zip(batch.column("n").to_pylist(), units.to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())],
                                             names=["row", "doc_id", "n_bytes", "n"])

    counted = dealt.sortWithinPartitions("unit").mapInArrow(products, f"row bigint, doc_id {kind}, n_bytes bigint, n bigint")
    sums = counted.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return sums.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
