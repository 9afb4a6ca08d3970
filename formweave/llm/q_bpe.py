"""op13: token ids of all documents and the text that they decode to."""

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formweave.llm import bpe
from formweave.llm.tables import table

TOKENIZER = "word_bpe_49k.json"
ROWS = 1000  # texts whose ids are held at a time


def _digests(codec: bpe.Codec, b: pa.RecordBatch) -> pa.RecordBatch:
    """Per row: id, number of tokens, digest of the ids in their 32-bit form, digest of the text that these ids decode to."""
    n, ids_sha, text_sha = [], [], []
    for k in range(0, b.num_rows, ROWS):
        ids = bpe.id_lists(codec, b.column(1).slice(k, ROWS))
        sizes = pc.list_value_length(ids).cast(pa.int64())
        raw, ends = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4").tobytes(), [0, *pc.cumulative_sum(sizes).to_pylist()]
        n += sizes.to_pylist()
        ids_sha += [hashlib.sha256(raw[4 * x : 4 * y]).hexdigest() for x, y in zip(ends, ends[1:], strict=False)]
        text_sha += [hashlib.sha256(t.as_py().encode()).hexdigest() for t in bpe.texts_of(codec, ids)]
    return pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    codec = bpe.codec(public_tokenizers.path(TOKENIZER))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    return bpe.mapped(docs, codec, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", _digests)


QUERIES = {"op13_bpe_codec": op13}
ORACLE: dict = {}
